"""Differences between two snapshots of results, leaf by leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.sources.shared import written

TOLERANCE = 1e-12


def _depth(snapshot: DataFrame) -> int:
    """The deepest nesting of brackets in the documents, those inside strings left out."""
    bare = F.regexp_replace(F.regexp_replace("payload", r"\\.", ""), '"[^"]*"', "")
    marks = F.filter(F.split(bare, ""), lambda c: c.isin("{", "[", "}", "]"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return snapshot.agg(F.max(F.aggregate(marks, start, step, lambda acc: acc["most"]))).first()[0] or 0


def leaves(snapshot: DataFrame, levels: int = 16) -> DataFrame:
    """key, path, value of every scalar of JSON documents (key, payload), however deep it is.

    Each level of nesting is one lateral explosion; what is nested deeper than ``levels``
    is written once, and the next levels go on from there.
    """
    explode = snapshot.sparkSession.tvf.variant_explode
    deepest = _depth(snapshot)
    todo = snapshot.select(F.col("key").alias("doc"), F.lit("").alias("path"), F.parse_json("payload").alias("v"))
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    out = None
    for level in range(deepest + 1):
        last = level == deepest
        done = todo if last else todo.where(~nested)
        done = done.select(F.col("doc").alias("key"), "path", F.when(nested, F.to_json("v")).otherwise(F.col("v").try_cast("string")).alias("value"))
        out = done if out is None else out.unionByName(done)
        if not last:
            step = F.concat("path", F.when(F.col("path") == "", "").otherwise("."), F.coalesce("key", F.col("pos").cast("string")))
            todo = todo.where(nested).lateralJoin(explode(F.col("v").outer())).select("doc", step.alias("path"), F.col("value").alias("v"))
            if (level + 1) % levels == 0:
                todo = written(todo, "leaves")
    return out


def snapshot_diff(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Leaves (key, path, value) that differ, and by how much they do if both are numbers.

    A leaf on one side only is a difference; numbers within ``tolerance`` are rounding.
    """
    left, right = a.select("key", "path", F.col("value").alias("a")), b.select("key", "path", F.col("value").alias("b"))
    x, y = F.expr("try_cast(a AS double)"), F.expr("try_cast(b AS double)")
    kind = (F.when(F.col("a").eqNullSafe(F.col("b")), "same").when(F.col("a").isNull() | F.col("b").isNull(), "one side")
            .when(F.abs(x - y) <= tolerance, "rounding").otherwise("difference"))
    return left.join(right, ["key", "path"], "full").withColumn("kind", kind).where("kind != 'same'").withColumn("gap", F.abs(x - y))


def compare_all(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> dict[str, int]:
    """Counts of compared leaves, differences and roundings; refuses to compare nothing."""
    compared = a.join(b, ["key", "path"], "full").count()
    if not compared:
        raise ValueError("nothing was compared")
    kinds = {r["kind"]: r["count"] for r in snapshot_diff(a, b, tolerance).groupBy("kind").count().collect()}  # three rows at most
    return {"compared": compared, "differences": kinds.get("difference", 0) + kinds.get("one side", 0), "rounding": kinds.get("rounding", 0)}
