"""Plugins: named steps with requirements, ordered on the driver and compiled into one plan."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Plugin:
    """build adds what the plugin computes to a frame of documents. Its requirements have run before it."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    requires: tuple[str, ...] = ()
    available: Callable[[], bool] = lambda: True


@dataclass(frozen=True)
class Config:
    """Which plugins run, and how. References and watermark are off unless asked for.

    report_path and report_format ("html" or "json"): where reports() writes each document's report. dictionary: a table of n-gram
    counts (write_dictionary) for the perplexity of texts. tokens: perplexity by tokens, from a column of per-token values that a model made
    (token_column), where it isn't null. catalogue: references are looked up in a table of works, else judged offline. device is where such a
    model runs; no model runs here.
    """

    stylometric: bool = True
    reasoning: bool = True
    hallucination: bool = True
    perplexity: bool = True
    references: bool = False
    watermark: bool = False
    report: bool = True
    report_path: str | None = None
    report_format: str = "html"
    device: str | None = None
    dictionary: str | None = None
    tokens: bool = True
    catalogue: bool = True

    def names(self) -> list[str]:
        return [k for k in ("stylometric", "reasoning", "hallucination", "perplexity", "references", "watermark") if getattr(self, k)]


def order(plugins: list[Plugin]) -> list[Plugin]:
    """Topological, ties by name; of equal names the last one counts."""
    by = {p.name: p for p in plugins}
    if missing := {(p.name, r) for p in by.values() for r in p.requires if r not in by}:
        raise ValueError(f"unknown requirements: {sorted(missing)}")
    waiting = {n: len(set(p.requires)) for n, p in by.items()}
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(by[name := heapq.heappop(ready)])
        for n, p in by.items():
            if name in p.requires:
                waiting[n] -= 1
                if not waiting[n]:
                    heapq.heappush(ready, n)
    if len(out) < len(by):
        raise ValueError(f"circular requirements among {sorted(n for n, k in waiting.items() if k)}")
    return out


def run(docs: DataFrame, plugins: list[Plugin]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all plugins' columns, and why plugins were left out: not available, a requirement left out, or an error in building."""
    errors: dict[str, str] = {}
    for p in order(plugins):
        if lost := [r for r in p.requires if r in errors]:
            errors[p.name] = f"requires {', '.join(sorted(lost))}"
        elif not p.available():
            errors[p.name] = "not available"
        else:
            try:
                docs = p.build(docs)
            except Exception as e:  # a plugin never breaks the others
                errors[p.name] = f"{type(e).__name__}: {e}"
    return docs, errors


def standard(config: Config = Config(), text_col: str = "text", ids_col: str = "token_ids", token_column: str = "token_ppl", year: int = 2025, id_col: str = "doc_id") -> list[Plugin]:
    """The plugins that config asks for. watermark takes token ids (ids_col, array<int>), tokens a column of per-token perplexities."""
    from pyspark.sql import functions as F

    from ..functions import columns as C
    from ..operators import citations, corpus, features, risk, style, watermark

    def perplexity(df: DataFrame) -> DataFrame:
        out = features.perplexity(df, text_col, "perplexity").withColumn("tier", F.lit("tier1"))
        if config.tokens and token_column in df.columns:
            some = F.size(token_column) > 0
            mean = F.when(some, C.mean(F.col(token_column))).otherwise(F.col("perplexity.proxy_perplexity_mean"))
            out = out.withColumns({"perplexity": F.col("perplexity").withField("proxy_perplexity_mean", mean), "tier": F.when(some, "tier2").otherwise("tier1")})
        if config.dictionary:
            counts = df.sparkSession.read.parquet(config.dictionary)
            known = corpus.dictionary_perplexity(df, counts, id_col, text_col).select(F.col("id").alias(id_col), F.col("ppl").alias("dictionary_perplexity"))
            out = out.join(known, id_col, "left")
        return out.withColumn("perplexity_risk", risk.perplexity_risk(F.col("perplexity"), F.size(C.tok_word(F.coalesce(F.col(text_col), F.lit(""))))))

    known = {
        "stylometric": Plugin("stylometric", lambda df: style.stylometric(df, text_col, "stylometric")),
        "reasoning": Plugin("reasoning", lambda df: features.reasoning(df, text_col, "reasoning").withColumn("reasoning_risk", risk.reasoning_risk(F.col("reasoning")))),
        "hallucination": Plugin("hallucination", lambda df: features.hallucination(df, text_col, "hallucination").withColumn("hallucination_risk", risk.hallucination_risk(F.col("hallucination")))),
        "perplexity": Plugin("perplexity", perplexity),
        "references": Plugin("references", lambda df: df.withColumn("references", citations.features(F.coalesce(F.col(text_col), F.lit("")), year))),
        "watermark": Plugin("watermark", lambda df: df.withColumn("watermark", watermark.green_test(ids_col))),
    }
    return [known[n] for n in config.names()]
