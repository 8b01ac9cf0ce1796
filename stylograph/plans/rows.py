"""Plugins that may fail on some rows: what fails is null there and named in a map of errors, and all else goes on.

A row plugin is an expression with a reason to refuse a row, so that Spark never evaluates it there; a Python plugin is a function of
one row's struct, run over Arrow batches, whose exceptions are caught row by row. Requirements are checked per row: where one has
failed, what needs it is skipped. The order is that of plugins.order; unavailable plugins are left out, and what needs them is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import plugins

Results = dict[str, Column]
NO_RESULT = "no result"


@dataclass(frozen=True)
class RowPlugin:
    """compute: the result from the results of the requirements (and the frame's columns); null counts as a failure. Expressions that raise
    (a cast, a division, an index) are to be written with try_ functions, or kept from bad rows by refuse: why a row can't be handled, or null."""

    name: str
    compute: Callable[[Results], Column]
    requires: tuple[str, ...] = ()
    refuse: Callable[[Results], Column] | None = None
    available: Callable[[], bool] = lambda: True

    def outcome(self, held: Results) -> tuple[Column, Column]:
        """(result, error) where all requirements are met."""
        no = self.refuse(held) if self.refuse else F.lit(None).cast("string")
        result = F.when(no.isNull(), self.compute(held))
        return result, F.coalesce(no, F.when(result.isNull(), NO_RESULT))


@dataclass(frozen=True)
class PythonPlugin:
    """run: a dict of the given columns and requirements' results, and what warm_up made, to a dict of the schema's fields.

    Any other value becomes {"raw_result": value}. warm_up is called once a worker; if it fails, so does every row.
    """

    name: str
    run: Callable[[dict, Any], Any]
    schema: T.StructType
    columns: tuple[str, ...] = ("text",)
    requires: tuple[str, ...] = ()
    warm_up: Callable[[], Any] = lambda: None
    available: Callable[[], bool] = lambda: True

    def outcome(self, held: Results) -> tuple[Column, Column]:
        call, warm_up, names = self.run, self.warm_up, self.schema.fieldNames()
        ready: list[tuple[Any, str | None]] = []  # filled in the worker's copy

        def one(row: dict) -> dict:
            state, error = ready[0]
            if error or not row.pop("_met"):
                return {"error": error}
            try:
                got = call(row, state)
            except Exception as e:
                return {"error": f"{type(e).__name__}: {e}"}
            return got if isinstance(got, dict) else {"raw_result": got}

        def called(rows: pd.DataFrame) -> pd.DataFrame:
            if not ready:
                try:
                    ready.append((warm_up(), None))
                except Exception as e:
                    ready.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=[*names, "error"], dtype=object)

        met = F.lit(True)
        for r in self.requires:
            met = met & held[r].isNotNull()
        given = F.struct(*(held[c].alias(c) for c in (*self.columns, *self.requires)), met.alias("_met"))
        out = F.pandas_udf(called, T.StructType([*self.schema.fields, T.StructField("error", T.StringType())]))(given)
        return F.when(out["error"].isNull(), F.struct(*(out[k].alias(k) for k in names))), out["error"]


def run(docs: DataFrame, steps: list[RowPlugin | PythonPlugin], errors: str = "errors") -> DataFrame:
    """docs with a column for each plugin (null where it failed or was skipped) and errors, map<string,string> of those, in the plugins' order."""
    frame, said = docs, []
    for p in plugins.order(steps):
        if not p.available():
            frame = frame.withColumn(p.name, F.lit(None).cast("string"))
            continue
        held = {c: F.col(c) for c in frame.columns}
        lost = F.array_compact(F.array(*(F.when(held[r].isNull(), F.lit(r)) for r in p.requires))) if p.requires else F.array().cast("array<string>")
        result, error = p.outcome(held)
        skipped = F.when(F.size(lost) > 0, F.concat(F.lit("skipped: requires "), F.array_join(lost, ", ")))
        why = f"_error_{p.name}"
        if isinstance(p, PythonPlugin):  # it is told which rows are skipped
            frame = frame.withColumn("_out", F.struct(result.alias("result"), F.coalesce(skipped, error).alias("error")))
        else:  # nothing is evaluated for rows that are skipped
            frame = frame.withColumn("_out", F.when(skipped.isNull(), F.struct(result.alias("result"), error.alias("error"))).otherwise(F.struct(F.when(skipped.isNull(), result).alias("result"), skipped.alias("error"))))
        frame = frame.withColumns({p.name: F.when(F.col("_out.error").isNull(), F.col("_out.result")), why: F.col("_out.error")}).drop("_out")
        said.append((p.name, why))
    every = F.array_compact(F.array(*(F.when(F.col(why).isNotNull(), F.struct(F.lit(n).alias("key"), F.col(why).alias("value"))) for n, why in said)))
    empty = F.create_map().cast("map<string,string>")
    return frame.withColumn(errors, F.map_from_entries(every) if said else empty).drop(*(why for _, why in said))
