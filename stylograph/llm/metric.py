"""Embedding near-duplicates: an exact range join in the metric space of angles.

Vectors link at a cosine of `threshold` or more, that is, at an angle of r or less. Pivots partition them: a vector's home is the
cell of the nearest pivot. Members within r/2 of their pivot are the cell's core, the others its shell; by the triangle
inequality all of a core link with each other, so a dense group costs no comparison inside. Of two cells one is the host for the
pairs between them, and a vector of the other is sent there only if a member can be within r of it:

* its angle to the host's pivot is at most r more than that of the host's farthest member (triangle inequality);
* its angle to the great sphere that halves the way between the two pivots, behind which the host's members lie, is at most r.

Cells join independently. A large cell is cut into tiles and what is sent to it into slices, each pair of which is one bounded
unit of work: blocks of cosines, of which only a count of links for each vector and a spanning forest leave. Cosines are
computed in single precision; those too near the threshold to tell, in double.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lookup

THRESHOLD = 0.95
#: Pivots at most, vectors they are chosen from, components of all of the latter. Any pivots give the same links.
PIVOTS, SAMPLE, SAMPLED = 4096, 4096, 1 << 21
#: Components in a tile at most, vectors in one at least.
TILE, LEAST = 1 << 22, 1024
#: Cells of vectors whose length isn't that of the pivots, by length.
ODD = 16
#: Angles are taken as equal up to this; far over the rounding of an arc cosine.
SLACK = 1e-6
#: Cosines in a block.
BLOCK = 1 << 21


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: false for null, empty and zero vectors and those with null or non-finite components."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))  # noqa: E731  NaN counts as larger
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each the farthest from those before it; fewer if the rest coincide with them."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        x = int(nearest.argmin())
        if nearest[x] > 1 - 1e-9:
            break
        chosen.append(x)
        nearest = np.maximum(nearest, sample @ sample[x])
    return sample[chosen]


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of column v."""
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy().astype(np.float64, copy=False), np.concatenate(([0], np.cumsum(sizes)))
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, flat[starts[rows][:, None] + np.arange(n)] if len(rows) < len(sizes) else flat.reshape(-1, n)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _home(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cosines to the pivots, nearest pivot, angle to it, and cell: twice the pivot, plus one for its core."""
    cosines = x @ pivots.T
    home = cosines.argmax(1)
    angle = _angle(cosines[np.arange(len(x)), home])
    return cosines, home, angle, 2 * home + (angle <= r / 2 - SLACK)


def _odd(n: int, pivots: np.ndarray) -> int:
    return 2 * (len(pivots) + n % ODD)


def _cells(pivots: np.ndarray, r: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.empty(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for n, rows, v in _by_length(batch):
                if n == pivots.shape[1]:
                    _, _, angle[rows], cell[rows] = _home(unit(v), pivots, r)
                else:
                    cell[rows] = _odd(n, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(cell), pa.array(angle)], names=["node", "copies", "cell", "angle"])

    return run


def _targets(pivots: np.ndarray, r: float, reach: np.ndarray):
    """Adds the home cell, and the others to which a vector is sent. reach: the largest angle in each cell, negative for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots)
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))
        far = r + SLACK
        number = np.arange(k)
        for batch in batches:
            cell, to = np.empty(batch.num_rows, np.int32), [[]] * batch.num_rows
            for n, rows, v in _by_length(batch):
                if n != pivots.shape[1]:
                    cell[rows] = _odd(n, pivots)
                    continue
                cosines, home, _, cell[rows] = _home(unit(v), pivots, r)
                angles, own = _angle(cosines), cosines[np.arange(len(rows)), home][:, None]
                host = np.where((home[:, None] + number) % 2 == 0, number < home[:, None], number > home[:, None])
                near = host & ((own - cosines) / apart[home] <= math.sin(min(far, math.pi / 2)))
                own_shell = (number == home[:, None]) & (cell[rows] % 2 == 0)[:, None]  # a shell meets its own cell's core
                shell = near & (reach[0::2] >= 0) & (angles <= reach[0::2] + far)
                core = (near | own_shell) & (reach[1::2] >= 0) & (angles <= reach[1::2] + far)
                for side, sent in ((0, shell), (1, core)):
                    i, c = np.nonzero(sent)
                    for part, row in zip(np.split(c, np.searchsorted(i, np.arange(1, len(rows)))), rows.tolist(), strict=True):
                        if len(part):
                            to[row] = [*to[row], *(2 * part + side).tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "v", "copies")), pa.array(cell), pa.array(to, pa.list_(pa.int32()))], names=["node", "v", "copies", "cell", "to"])

    return run


def merge(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i] in up (a node's parent, the smallest node of a component for a root)."""
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (over := up[up])).any():
            up[:] = over


def _compare(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b (of a with itself, if b is None) with a cosine of the threshold or more, block by block."""
    x, y = a.astype(np.float32), None if b is None else b.astype(np.float32)
    doubt = 1e-6 + 2e-7 * a.shape[1]
    step = max(1, BLOCK // max(1, len(a if b is None else b)))
    for at in range(0, len(a), step):
        other, first = (x[at + 1 :], at + 1) if y is None else (y, 0)
        cosines = x[at : at + step] @ other.T
        i, j = np.nonzero(cosines >= threshold - doubt)
        near = cosines[i, j]
        i, j = i + at, j + first
        if y is None:
            near, i, j = near[i < j], *(v[i < j] for v in (i, j))
        sure = near > threshold + doubt
        if not sure.all():
            rest = np.flatnonzero(~sure)
            sure[rest] = (a[i[rest]] * (a if b is None else b)[j[rest]]).sum(1) >= threshold
        if sure.any():
            yield i[sure], j[sure]


def _join(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """A unit's links: for each vector with any, how many (copies of a partner count each) and the first node of its component."""

    def run(rows: pa.Table) -> pa.Table:
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        side, same = rows.column("side").to_numpy(), rows.column("same")[0].as_py()
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        count, up = np.zeros(len(node), np.int64), np.arange(len(node))
        for _, own, v in _by_length(rows):
            x = unit(v)
            sides = [own] if same else [own[side[own] == 0], own[side[own] == 1]]
            parts = [x] if same else [x[side[own] == 0], x[side[own] == 1]]
            if not all(map(len, sides)):
                continue
            for i, j in _compare(parts[0], None if same else parts[1], threshold):
                i, j = sides[0][i], sides[-1][j]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                merge(up, rank[i], rank[j])
        found = np.flatnonzero(count)
        return pa.table({"node": node[found], "links": count[found], "root": node[order][up[rank[found]]]})

    return run


def links(reps: DataFrame, n: int, scratch: Scratch, threshold: float = THRESHOLD, pivots: int | None = None, tile: int | None = None) -> DataFrame:
    """(node, links, root), several rows a node: links to other nodes' vectors add up, equal roots connect.

    reps: node bigint, v (a vector with a direction), copies bigint; each vector once; n: its rows. pivots and tile: by n, if not given.
    """
    r = math.acos(threshold)
    spark = reps.sparkSession
    sample = [np.asarray(x["v"], np.float64) for x in reps.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").collect()]
    lengths = [len(x) for x in sample]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 1
    chosen = [x for x in sample if len(x) == dims][: max(1, SAMPLED // dims)]
    tile = tile or max(LEAST, TILE // dims)
    of = spread(unit(np.stack(chosen)), pivots or min(PIVOTS, max(1, math.isqrt(n) // 16, n // tile))) if chosen else np.zeros((1, 1))
    tile = min(tile, max(LEAST, n // len(of)))

    homes = reps.mapInArrow(_cells(of, r), "node bigint, copies bigint, cell int, angle double")
    sizes = {x["cell"]: x for x in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"), F.sum("copies").alias("copies"), F.min("node").alias("first")).collect()}
    reach = np.array([sizes[c]["reach"] if c in sizes else -1.0 for c in range(2 * len(of))])
    sent = scratch.table(reps.mapInArrow(_targets(of, r, reach), f"node bigint, v {dict(reps.dtypes)['v']}, copies bigint, cell int, to array<int>"), "sent")
    guests = {x["cell"]: x["n"] for x in sent.select(F.explode("to").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}

    # a row a cell: at most 2 * (PIVOTS + ODD)
    plan = [(c, -(-x["n"] // tile), -(-guests.get(c, 0) // (2 * tile)), c % 2 == 1, x["copies"], x["first"]) for c, x in sizes.items()]
    cells = F.broadcast(spark.createDataFrame(plan, "cell int, tiles long, slices long, core boolean, all_copies long, first long"))
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.greatest(n, F.lit(1)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own, cut = F.col("own"), F.col("cut")
    task = lambda a, b, side, guest: F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"), F.lit(guest).alias("guest"))
    inside = F.when(~F.col("core"), F.transform(upto(F.col("tiles")), lambda k: task(F.least(own, k), F.greatest(own, k), own > k, False)))
    outside = F.when(F.col("slices") > 0, F.transform(upto(F.col("slices")), lambda k: task(own, k, F.lit(0), True)))
    none = F.array().cast("array<struct<a:bigint,b:bigint,side:int,guest:boolean>>")
    at_home = sent.join(cells, "cell").withColumn("own", dealt(1, F.col("tiles"))).select("node", "v", "copies", "cell", F.explode(F.concat(F.coalesce(inside, none), F.coalesce(outside, none))).alias("task"))
    abroad = sent.select("node", "v", "copies", F.explode("to").alias("cell")).join(cells, "cell").withColumn("cut", dealt(2, F.col("slices")))
    abroad = abroad.select("node", "v", "copies", "cell", F.explode(F.transform(upto(F.col("tiles")), lambda k: task(k, cut, F.lit(1), True))).alias("task"))
    units = at_home.unionByName(abroad).select("node", "v", "copies", "cell", "task.*").withColumn("same", ~F.col("guest") & (F.col("a") == F.col("b")))
    found = units.groupBy("cell", "a", "b", "guest").applyInArrow(_join(threshold), "node bigint, links bigint, root bigint")
    among = sent.select("node", "copies", "cell").join(cells.filter("core"), "cell").select("node", (F.col("all_copies") - F.col("copies")).alias("links"), F.col("first").alias("root"))
    return found.unionByName(among)


def near_vectors(vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, pivots: int | None = None, tile: int | None = None, local_edges: int = 1_000_000) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link at a cosine of threshold or more, in double precision; threshold lies between 0 and 1, both excluded. Null, empty
    and zero vectors and those with null or non-finite components link with nothing; vectors of different lengths don't link.
    Equal vectors are compared once, and link. Rows are told apart by their vectors: rows that repeat an id each have their own
    links. A row without id is linked like any other, never names a component, and is kept if nothing with an id is reachable.
    An empty table gives no rows. Other columns play no part.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    fit = usable(F.col("v"))
    groups = rows.filter(fit).groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    reps = scratch.table(groups.withColumn("node", F.monotonically_increasing_id()), "reps")  # ids hold once they are written
    n = reps.count()
    found = scratch.table(links(reps.select("node", "v", "copies"), n, scratch, threshold, pivots, tile), "links")
    joined = components(found.select("node", "root"), scratch, local_edges)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = scratch.table(reps.join(counted, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    named = placed.filter("links > 0").groupBy("component").agg(F.min("first_id").alias("named"))
    own = placed.filter("links > 0").join(named, "component")
    alone = placed.filter("links is null or links = 0").withColumn("named", F.col("first_id"))
    every = (x.select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("named").alias("component_id")) for x in (own, alone))
    table = scratch.table(next(every).unionByName(next(every)), "classes")
    linked = lookup(rows.filter(fit), table, "v", "copies", vectors.count()).select("id", "n_links", "component_id")
    free = rows.filter(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(free).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id)


def sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over the table embeddings, by comparing all pairs."""
    return f"""
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v,
            coalesce(embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0, false) AS fit FROM embeddings),
        l AS MATERIALIZED (SELECT a.k, b.k AS other FROM e a JOIN e b ON a.k <> b.k AND a.fit AND b.fit AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
        r(k, other) AS (SELECT k, k FROM e UNION SELECT r.k, l.other FROM r JOIN l ON r.other = l.k),
        c AS (SELECT r.k, min(e.vec_id) AS component_id FROM r JOIN e ON r.other = e.k GROUP BY r.k),
        n AS (SELECT k, count(*) AS n_links FROM l GROUP BY k)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c ON e.k = c.k LEFT JOIN n ON e.k = n.k
    """
