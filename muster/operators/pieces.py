"""Long sequences of a key cut into pieces of time, so that no key is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.sources.shared import written

#: Pieces of a long key, and how many rows of all, as one in so many, make a key long.
PIECES, LONG = 256, 4096


def with_pieces(events: DataFrame, key: str, at: str, pieces: int | None = None) -> DataFrame:
    """``events`` with ``piece``: 0, or for keys with more than one in LONG of all rows the
    number of quantiles of the key's own times ``at`` that the row is not before.

    A piece of a long key has about one in ``pieces`` (PIECES if not given) of its rows, however uneven its times
    are (rows of equal time stay together).  Cuts are written once, so that every reading of
    the result cuts alike; there are fewer than LONG long keys, which are broadcast.
    """
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    long = counts.where(F.col("n") * LONG > total).select(key)
    pieces = pieces or PIECES
    inner = [k / pieces for k in range(1, pieces)]
    seen = events.join(F.broadcast(long.withColumnRenamed(key, "_k")), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    cuts = written(seen.groupBy(F.col(key).alias("_k")).agg(F.percentile_approx(at, inner, 10_000).alias("_cuts")), "cuts")
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(at))), F.lit(0))
    return events.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_k", "_cuts")
