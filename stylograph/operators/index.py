"""A vector index: cells by centroid, top-k by cosine from the cells that are probed, and a scorer of the caller's over what is found.

Centroids are fitted on a bounded sample; every vector is indexed. A query meets the vectors of its nearest cells in bounded units of work,
each of some neighbouring cells or a part of a large one, of which only each query's k best leave: it is sent once a unit, not once a cell. With exact=True the k-th best score so far then says which other cells can hold
a better one: those whose centroid is no farther from the query than that score's angle and the cell's radius together (triangle
inequality of angles). They are probed as well, so nothing is missed; otherwise recall() measures what is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage

#: Vectors that centroids are fitted on, cells at most, rows of a unit of work on either side.
SAMPLE, CELLS, TILE = 20_000, 4096, 8192
PROBES = 4
SLACK = 1e-6


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def kmeans(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centroid without rows stays. sample: unit vectors."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 1024] @ centroids.T).argmax(1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        some = np.bincount(at, minlength=len(centroids)) > 0
        centroids[some] = unit(sums[some])
    return centroids


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def usable(v: Column, dims: int | None = None) -> Column:
    """Vectors of numbers that aren't all zero, of the index's length."""
    right = v.isNotNull() & (F.size(v) == dims if dims else F.size(v) > 0)
    return right & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)


@dataclass
class Index:
    """vectors: id, v (array<double>), cell; a written table. radius: of each cell, negative for an empty one. tiles: of a cell, by its rows.
    unit: of each cell; one of several tiles is alone in its unit."""

    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    tiles: np.ndarray
    unit: np.ndarray


def lowest(rows: DataFrame, by: Column, then: str, n: int, total: int) -> DataFrame:
    """The n rows of least hash, ties by another column, of so many in all. Rows far above are dropped first, or one task would sort whole partitions."""
    share = 2 * n / max(total, 1)
    while share < 1:
        some = rows.filter(by < int(-(2**63) + share * 2**64))
        if some.count() >= n:
            rows = some
            break
        share *= 4
    return rows.orderBy(by, then).limit(n)


def _units(centroids: np.ndarray, rows: np.ndarray, tile: int) -> np.ndarray:
    """The unit of each cell: neighbours share one as far as they have a tile's rows together."""
    near = (centroids @ kmeans(centroids, max(1, -(-int(rows.sum()) // tile))).T).argmax(1)
    out, unit, held, group = np.zeros(len(rows), np.int64), -1, 0, -1
    for c in np.lexsort((np.arange(len(rows)), near)):
        if near[c] != group or held + rows[c] > tile:
            unit, held, group = unit + 1, 0, near[c]
        out[c], held = unit, held + rows[c]
    return out


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = unit(_matrix(batch.column("v"))) @ centroids.T
            cell = cosines.argmax(1)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "v", "cell", "angle"])

    return run


def build(vectors: DataFrame, stage: Stage, id_col: str, vector_col: str, cells: int | None = None, sample: int = SAMPLE, tile: int = TILE) -> Index:
    """Vectors that are null, zero, or hold what is no finite number, and those of another length than most of the sample, are left out; ids
    needn't be unique. An empty table makes an index that finds nothing."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    rows = stage.table(rows, "rows")
    n = rows.count()
    drawn = lowest(rows, F.xxhash64("v"), "id", sample, n).select("v").toArrow().column("v").combine_chunks()  # as numbers, not as objects
    lengths, many = np.unique(pc.list_value_length(drawn).to_numpy(zero_copy_only=False), return_counts=True)
    dims = int(lengths[many == many.max()].max()) if len(lengths) else 1
    chosen = unit(drawn.filter(pc.equal(pc.list_value_length(drawn), dims)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
    centroids = kmeans(chosen, cells or min(CELLS, max(1, math.isqrt(n)))) if len(chosen) else np.zeros((1, dims))
    kind = dict(rows.dtypes)["id"]
    placed = stage.table(rows.filter(F.size("v") == dims).mapInArrow(_assigned(centroids), f"id {kind}, v array<double>, cell int, angle double"), "cells")
    radius, held = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], held[r["cell"]] = r["radius"], r["n"]
    return Index(placed.drop("angle"), centroids, radius, np.maximum(1, -(-held // tile)), _units(centroids, held, tile))


def _angles(index: Index, x: np.ndarray, full: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ index.centroids[full].T, -1, 1))


def _probed(index: Index, probes: int, exact: bool):
    """Cells to probe, by unit: the nearest ones, or, for queries with their k-th best score (bound), all others that may hold better."""
    radius, units = index.radius, index.unit
    index = replace(index, vectors=None)  # a task has no use for it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(radius >= 0)
        full = full[np.argsort(units[full], kind="stable")]
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            angles = _angles(index, _matrix(batch.column("v")), full)
            asks = np.zeros(angles.shape, bool)
            np.put_along_axis(asks, _order(angles, full)[:, :probes], True, 1)
            if exact:
                bound = np.arccos(np.clip(np.array([-1.0 if x is None else x for x in batch.column("bound").to_pylist()]), -1, 1))
                asks = ~asks & (angles - radius[full][None] <= bound[:, None] + SLACK)  # the nearest have been
            q, c = np.nonzero(asks)
            u = units[full[c]]
            first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (u[1:] != u[:-1])]) if len(q) else np.zeros(0, np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)], pa.int32()), pa.array(full[c], pa.int32()))
            each = pa.StructArray.from_arrays([pa.array(u[first], pa.int32()), cells], names=["unit", "cells"])
            ends = np.r_[0, np.cumsum(np.bincount(q[first], minlength=batch.num_rows))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["id", "v", "asks"])

    return run


def _order(angles: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Places in `full` of each query's cells, nearest first, ties by cell."""
    by_cell = np.argsort(full, kind="stable")
    return by_cell[np.argsort(angles[:, by_cell], axis=1, kind="stable")]


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite scores; of equal ones the least columns."""
    m = scores.shape[1]
    least = np.partition(scores, m - k, axis=1)[:, m - k, None] if m > k else -np.inf
    i, j = np.nonzero((scores >= least) & np.isfinite(scores))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def _best(k: int, same: bool):
    """A unit's k best vectors for each of its queries, which have the cells they ask for; a vector has its own."""

    def run(rows: pa.Table) -> pa.Table:
        lists = rows.column("cells").combine_chunks()
        many = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        cell = rows.column("cell").to_numpy()
        ids, x = rows.column("id"), unit(_matrix(rows.column("v")))
        q, p = np.flatnonzero(cell < 0), np.flatnonzero(cell >= 0)
        out_q, out_p, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(p):
            names = ids.to_numpy()
            # in the order of ids, so that of equal scores the least ids stay
            p = p[np.argsort(names[p], kind="stable")]
            here, at = np.unique(cell[p], return_inverse=True)
            asked = lists.flatten().to_numpy()
            known = np.isin(asked, here)
            asks = np.zeros((len(rows), len(here)), bool)
            asks[np.repeat(np.arange(len(rows)), many)[known], np.searchsorted(here, asked[known])] = True
            q = q[np.argsort(asks[q].argmax(1), kind="stable")]
            for block in (q[i : i + 512] for i in range(0, len(q), 512)):
                mine = asks[block]
                some = np.flatnonzero(mine.any(0)[at])  # vectors of cells that one of the block asks for
                if not len(some):
                    continue
                scores = x[block] @ x[p[some]].T
                scores[~mine[:, at[some]]] = -np.inf
                if same:
                    low, high = (np.searchsorted(names[p[some]], names[block], side) for side in ("left", "right"))
                    for r in np.flatnonzero(low < high):
                        scores[r, low[r] : high[r]] = -np.inf
                i, j = _top(scores, k)
                out_q.append(block[i])
                out_p.append(p[some[j]])
                out_s.append(scores[i, j])
        found = np.concatenate(out_p)
        return pa.table({"query": ids.take(pa.array(np.concatenate(out_q))), "id": ids.take(pa.array(found)), "score": np.concatenate(out_s), "cell": pa.array(cell[found], pa.int32())})

    return run


def _found(index: Index, asked: DataFrame, k: int, same: bool, query_tile: int) -> DataFrame:
    """query, id, score, cell: each query's k best of each unit. asked: id, v, asks; a written table. Units that many queries ask are cut by those, too."""
    spark, kind = asked.sparkSession, dict(asked.dtypes)["id"]
    load = {r["unit"]: r["count"] for r in asked.select(F.explode("asks.unit").alias("unit")).groupBy("unit").count().collect()}  # a row a unit
    cut = [(c, int(u), int(t), -(-load[u] // query_tile)) for c, (u, t) in enumerate(zip(index.unit.tolist(), index.tiles.tolist(), strict=True)) if u in load]
    cells = spark.createDataFrame(cut, "cell int, unit int, tiles int, slices int")  # a row a cell
    # cells that nobody asks for drop out
    own = index.vectors.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = own.select("id", "v", "cell", F.lit(None).cast("array<int>").alias("cells"), "unit", "tile", "slice")
    come = asked.select("id", "v", F.explode("asks").alias("a")).select("id", "v", "a.unit", "a.cells").join(F.broadcast(cells.groupBy("unit").agg(F.max("tiles").alias("tiles"), F.max("slices").alias("slices"))), "unit")
    come = come.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("id", "v", F.lit(-1).alias("cell"), "cells", "unit", "tile", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int").alias("slice"))
    return own.unionByName(come).groupBy("unit", "tile", "slice").applyInArrow(_best(k, same), f"query {kind}, id {kind}, score double, cell int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A query has k rows a unit, so its group is bounded by k and the units it met."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, stage: Stage, id_col: str, vector_col: str, k: int = 10, probes: int = PROBES, exact: bool = False, same: bool = False, query_tile: int = TILE) -> DataFrame:
    """query, rank (from 1), id, score: the k vectors of largest cosine, ties by id. same: queries are rows of the index and don't find themselves.

    Query ids are unique. Queries without a usable vector of the index's length find nothing.
    """
    return _search(index, queries, stage, id_col, vector_col, k, probes, exact, same, query_tile).select("query", "rank", "id", "score")


def _search(index: Index, queries: DataFrame, stage: Stage, id_col: str, vector_col: str, k: int, probes: int, exact: bool, same: bool, query_tile: int) -> DataFrame:
    """search(), with the cell of each vector found."""
    dims = index.centroids.shape[1]
    kind = dict(index.vectors.dtypes)["id"]
    asked = stage.table(queries.select(F.col(id_col).cast(kind).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v"), dims)), "asked")
    schema = f"id {kind}, v array<double>, asks array<struct<unit: int, cells: array<int>>>"
    near = stage.table(asked.mapInArrow(_probed(index, probes, False), schema), "near")
    first = stage.table(_ranked(_found(index, near, k, same, query_tile), k), "first")
    if not exact:
        return first
    bound = first.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    rest = stage.table(asked.join(bound, "id", "left").mapInArrow(_probed(index, probes, True), schema).filter(F.size("asks") > 0), "rest")
    return _ranked(first.drop("rank").unionByName(_found(index, rest, k, same, query_tile)), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours (query, id) that were found."""
    n = true.count()
    return true.join(found, ["query", "id"], "left_semi").count() / n if n else 1.0


def tuned(index: Index, queries: DataFrame, stage: Stage, id_col: str, vector_col: str, k: int = 10, target: float = 0.95, at_most: int = 500, same: bool = False) -> int:
    """The least power of two of probes that finds this share of the true neighbours of a bounded sample of the queries."""
    asked = queries.select(id_col, vector_col)
    some = stage.table(lowest(asked, F.xxhash64(id_col), id_col, at_most, asked.count()), "tuning")
    true = _search(index, some, stage, id_col, vector_col, k, PROBES, True, same, TILE)
    kind = dict(index.vectors.dtypes)["id"]
    pairs = true.select("query", "cell").join(some.select(F.col(id_col).cast(kind).alias("query"), F.col(vector_col).cast("array<double>").alias("v")), "query").select("cell", "v")
    # a true neighbour is found as soon as its cell is probed, as only better ones could take its place
    ranks = {r["at"]: r["count"] for r in pairs.mapInArrow(_ranks(index), "at int").groupBy("at").count().collect()}  # a row a cell at most
    probes, n = 1, sum(ranks.values())
    while probes < len(index.centroids) and sum(c for at, c in ranks.items() if at < probes) < target * n:
        probes *= 2
    return min(probes, len(index.centroids))


def _ranks(index: Index):
    """How many cells are nearer to a query than a cell."""
    index = replace(index, vectors=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(index.radius >= 0)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            order = full[_order(_angles(index, _matrix(batch.column("v")), full), full)]
            yield pa.RecordBatch.from_arrays([pa.array((order == batch.column("cell").to_numpy()[:, None]).argmax(1), pa.int32())], names=["at"])

    return run


def attribute(docs: DataFrame, profiles: DataFrame, stage: Stage, id_col: str, vector_col: str, author_col: str, profile_col: str, scorer: Callable[[Column, Column], Column] | None = None, k: int = 5, **how) -> DataFrame:
    """doc, author, score, rank: the k authors of nearest profiles, ranked by the scorer (of the document's and the profile's vector; by default
    their cosine), ties by name. Authors are strings with one profile each; a document meets the profiles of probed cells, not all."""
    index = build(profiles.select(F.col(author_col).cast("string").alias("a"), F.col(profile_col).alias("v")), stage, "a", "v")
    asked = docs.select(F.col(id_col).cast("string").alias("d"), F.col(vector_col).cast("array<double>").alias("v"))
    near = search(index, asked, stage, "d", "v", k, **how)
    both = near.join(asked.withColumnRenamed("v", "dv"), near["query"] == F.col("d")).join(index.vectors.select(F.col("id").alias("a"), F.col("v").alias("pv")), near["id"] == F.col("a"))
    scored = both.select(F.col("d").alias("doc"), F.col("a").alias("author"), (scorer(F.col("dv"), F.col("pv")) if scorer else F.col("score")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "author")))  # k rows a document
