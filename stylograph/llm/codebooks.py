"""Vector code compression: product codebooks learned by integer rounds, nearest entries found in kd-trees.

Components become integers, a vector is cut into equal consecutive parts, and each part position has a codebook of its own.
Every round broadcasts a kd-tree per codebook. A part's nearest entry is found by branch and bound: the child whose box is
nearer goes first, and a box is visited if its bound is no larger than the best distance so far, equal ones too, as they may
hold an entry of lower index at the same distance. Tasks add up integers, Spark adds up the tasks, so the same vectors give
the same codebooks whatever their order and partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers stay under this, so that squared distances and sums of a whole table fit 64 bits.
MOST = 1 << 27
LEAF = 4


@dataclass
class Node:
    """A box of codebook entries. index: ascending; children, or none for a leaf."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray
    entries: np.ndarray
    children: tuple[Node, Node] | None


def tree(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Split at the median of the widest dimension until LEAF entries are left, or all are equal."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    low, high = own.min(0), own.max(0)
    wide = int((high - low).argmax())
    if len(index) <= LEAF or low[wide] == high[wide]:
        return Node(low, high, index, own, None)
    order = index[np.argsort(own[:, wide], kind="stable")]
    half = len(order) // 2
    return Node(low, high, index, own, (tree(entries, np.sort(order[:half])), tree(entries, np.sort(order[half:]))))


def _bound(node: Node, x: np.ndarray) -> np.ndarray:
    away = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return (away * away).sum(1)


def _visit(node: Node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
    if not len(rows):
        return
    own = x[rows]
    if node.children is None:
        away = own[:, None, :] - node.entries[None]
        far = (away * away).sum(2)
        first = far.argmin(1)  # of equal ones the first, which has the lowest index
        d, i = far[np.arange(len(rows)), first], node.index[first]
        better = (d < best[rows]) | (d == best[rows]) & (i < at[rows])
        best[rows[better]], at[rows[better]] = d[better], i[better]
        return
    bounds = [_bound(child, own) for child in node.children]
    left = bounds[0] <= bounds[1]
    for near, where in ((0, left), (1, ~left)):
        _visit(node.children[near], x, rows[where], best, at)
        there = bounds[1 - near][where] <= best[rows[where]]
        _visit(node.children[1 - near], x, rows[where][there], best, at)


def nearest(node: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equally near ones, and its squared distance."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
    _visit(node, x, np.arange(len(x)), best, at)
    return at, best


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Whether all components are there, finite and in range; false for null and empty vectors."""
    within = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < MOST / SCALE)  # noqa: E731  NaN counts as larger than any
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, within)


def _cuts(dims: int, parts: int) -> list[int]:
    return [round(k * dims / parts) for k in range(parts + 1)]


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dims)


def _sums(trees, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each part, entry and position: how many parts took the entry, and the sum of their components. A row each per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, total = _cuts(dims, len(trees.value)), {}
        for batch in batches:
            v = _vectors(batch, dims)
            for p, root in enumerate(trees.value):
                x = v[:, cuts[p] : cuts[p + 1]]
                at, _ = nearest(root, x)
                k = len(root.index)
                n = np.bincount(at, minlength=k)
                # under 2^53 in a batch, so the floating-point sums are exact
                s = np.stack([np.bincount(at, weights=x[:, j], minlength=k).astype(np.int64) for j in range(x.shape[1])], 1)
                had = total.get(p)
                total[p] = (n, s) if had is None else (had[0] + n, had[1] + s)
        for p, (n, s) in total.items():
            e, j = np.nonzero(np.broadcast_to(n[:, None] > 0, s.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p), pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(n[e]), pa.array(s[e, j])], names=["part", "entry", "position", "n", "s"])

    return run


def _codes(trees, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(dims, max(1, len(trees.value)))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch, dims)
            found = [nearest(root, v[:, cuts[p] : cuts[p + 1]]) for p, root in enumerate(trees.value)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    return run


def learn(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, an array of entries a part. kept: id, v (array<bigint> of dims); at least one row.

    The driver gets the first vectors and, each round, a row for each part, entry and position.
    """
    spark, cuts = kept.sparkSession, _cuts(dims, parts)
    first = np.array([r["v"] for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], np.int64)
    books = [first[:, cuts[p] : cuts[p + 1]].copy() for p in range(parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([tree(b) for b in books])
        sums = kept.select("v").mapInArrow(_sums(trees, dims), "part int, entry int, position int, n long, s long").groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in sums.collect():
            books[r["part"]][r["entry"], r["position"]] = r["s"] // r["n"]
        trees.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error) and the codebooks. code: two hex digits a part; label_error: error summed over equal labels.

    Rows whose vector is null or empty, or holds a null, a NaN, an infinity or a value of MOST / SCALE (32,768) or more, are left
    out, and so are vectors of another length than that of the smallest id, which have no place in its codebooks. Parts are
    equal where their number divides the length, else they differ by one. Rows without an id come last, equal ids in the order
    of their vectors; repeated rows count each. Fewer rows than entries make codebooks of as many entries. No rows: no rows, and
    no codebooks. Rows without a label share one label_error. Other columns play no part.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    named = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kept = scratch.table(named.filter(usable(F.col("v"))).withColumn("v", integers(F.col("v"))), "integers")
    head = kept.orderBy(F.asc_nulls_last("id"), F.size("v"), "v").limit(1).collect()
    dims = len(head[0]["v"]) if head else 0
    kept = kept.filter(F.size("v") == dims)
    books = learn(kept, dims, parts, entries, rounds) if head else []
    trees = kept.sparkSession.sparkContext.broadcast([tree(b) for b in books])
    kind = dict(kept.dtypes)
    coded = scratch.table(kept.mapInArrow(_codes(trees, dims), f"id {kind['id']}, label {kind['label']}, code string, error long"), "coded")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    sums = scratch.table(coded.groupBy(key).agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    return lookup(coded.select("*", key), sums, "key", "n", coded.count()).drop("key"), books


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, over the table embeddings."""
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, cut.p, min(256 * CAST(list_sum([(cut.x[j] - c.x[j]) * (cut.x[j] - c.x[j]) FOR j IN range(1, len(cut.x) + 1)]) AS BIGINT) + c.e) AS best FROM cut JOIN c{k} c ON cut.p = c.p GROUP BY vec_id, cut.p)")
        if k < rounds:
            out.append(f"s{k} AS (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT cut.p, best % 256 AS e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS y FROM cut JOIN a{k} a ON cut.vec_id = a.vec_id AND cut.p = a.p) GROUP BY p, e, j)")
            floored = "list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j)"
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, {floored} AS x FROM s{k} GROUP BY p, e) u ON c.p = u.p AND c.e = u.e)")
    return f"""
        WITH {", ".join(out)},
        r AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
        FROM r JOIN kept k ON r.vec_id = k.vec_id
    """
