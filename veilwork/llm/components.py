"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join, so no vertex's
neighbours ever meet in one task: the join key carries a salt, and the minimum is replicated to the
salts. The number of steps is logarithmic in the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written

SALTS = 16


def _with_min(edges: DataFrame) -> DataFrame:
    """Adds to each (u, v) the least neighbour of u, as column m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("u", "w")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col("u") == F.col("w")) & (salted["salt"] == least["salt"])).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), long, in any direction -> (v, label): each vertex that has an edge, with the least vertex it reaches.

    Loops, repeated edges and an empty table are allowed; edges with a null end are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = written(pairs, "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_min(large)
        ends = F.array(*(F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("u", "v")))  # one pass over the joins, not a union of two
        step = small.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = written(step, "edges")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("v"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
