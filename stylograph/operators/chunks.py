"""Long token sequences in overlapping chunks, and per-token values of the chunks put together again.

Chunks have `size` tokens, each starting size - overlap after the one before; the last is the first that is shorter. A model gives a value for
all tokens of a chunk but the last (or for all). Of every chunk but the first the overlap's values are dropped, as the one before has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 1024, 64, 20


def chunks(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<chunk, start, tokens>>; empty for no token. A sequence ends with the first chunk of under `size` tokens."""
    n, step = F.size(tokens), size - overlap
    last = F.least(F.when(n < size, 0).otherwise(F.floor((n - size) / step) + 1), F.floor((n - 1) / step)).cast("int")
    number = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(number, lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.slice(tokens, k * step + 1, size).alias("tokens")))


def explode_chunks(docs: DataFrame, id_col: str, tokens_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk, start, tokens: a row a chunk, to be scored by a model in any order."""
    return docs.select(F.col(id_col), F.explode(chunks(F.col(tokens_col), size, overlap)).alias("c")).select(id_col, "c.chunk", "c.start", "c.tokens")


def stitched(scored: DataFrame, id_col: str, values_col: str = "values", overlap: int = OVERLAP) -> DataFrame:
    """id, values: the values of a sequence's chunks in order, without doubled heads. scored: id, chunk (from 0), values. A chunk of no more values
    than the overlap adds none; null values count as none. With a value for every token the result is that of the whole sequence; with one less a
    chunk, the value at the seam is lost. The group of a sequence holds its own values alone."""
    kept = F.when(F.col("chunk") == 0, F.col(values_col)).otherwise(F.slice(values_col, overlap + 1, F.greatest(F.size(values_col), F.lit(1))))
    each = scored.select(id_col, "chunk", F.coalesce(kept, F.array().cast(dict(scored.dtypes)[values_col])).alias("kept"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "kept")))
    return each.groupBy(id_col).agg(ordered.alias("c")).select(id_col, F.flatten(F.transform("c", lambda x: x["kept"])).alias("values"))
