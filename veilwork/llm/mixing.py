"""Mixing sources to target weights by systematic sampling.

Targets. Sources in code-point order (null last) take the weights in turn; all targets together are
`share` times all sizes. A target stops at `most` times its source's size and the excess is shared
again by weight. With the sources sorted by the level (target / weight) at which each stops, the first
one that stays below its own stop gives the level at which all that settles.

Sampling. Every document of a source expects target / source size copies. The expected copies are
summed along the source's documents, one offset in [0, 1) is added, and a document is emitted once for
each whole number that its stretch of the sum crosses: never more than `most` times, and a source's
copies add up to its expectation, give or take one.

Scale. The order of a source's documents is by size class (eight to a doubling), then by one of about
sqrt(rows) / 8 hash buckets, then by size up or down in alternation, then doc_id. Neighbours are alike in
size, so a source's taken words come near its target and not only its copies. Ranks within a source are
taken in two levels, over ranges of its rows and over the ranges' sizes, so no task holds a source, nor the
rows that share an id and a text. Words are counted once, into a thin table (id,
source, size, digest of the text); sums, ranks and copies are made on that, and whole rows are shuffled once,
when they meet their copies. The table of sources (four numbers each) passes through one task.
Everything derives from ids, texts and the seed, so reruns and retries agree.

Defined cases: a null text has size 0, a text of any length is read whole; a source whose sizes are all 0
takes nothing; a null source is a source; rows that share an id are documents of their own, ordered by size,
then digest; rows that share id, source and text share what they are given, in the order of their other columns (maps as JSON); an empty
table gives no rows; other columns pass through `mixed` untouched, names that begin with `__` excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .store import ordered, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Parts of a source's rows, for the join with its rate.
SALTS = 16


def _hex(key: Column, begin: int, seed: str) -> Column:
    """32 bits of an MD5 of the seed and a string as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), begin, 8), 16, 10).cast("long")


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, rate, target; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("needs", F.col("stop") / F.col("w"))
    by_need = Window.orderBy("needs", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = w.withColumn("full", F.coalesce(F.sum("stop").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("open", F.sum("w").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    w = w.withColumn("pos", F.row_number().over(by_need))
    first = F.min(F.when(F.col("level") <= F.col("needs"), F.struct("pos", "level"))).over(everything)
    w = w.withColumn("settled", first["level"])
    target = F.least("stop", F.coalesce("settled", F.lit(float("inf"))) * F.col("w"))
    return w.select("source", "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs -> doc_id, source, digest, size, source_size, target, copies; a thin row for each row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    thin = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), _digest().alias("digest")), "sizes")
    totals = written(thin.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "sources")
    n = totals.agg(F.sum("n")).first()[0] or 0
    buckets = int(n**0.5) // 8 + 1
    grade = F.length(F.bin("size")) * 8 + F.pmod(F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"), F.lit(8))
    lot = _hex(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("digest")), 1, seed)
    rows = thin.withColumn("bucket", grade * buckets + F.pmod(lot, F.lit(buckets))).withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())

    plan = _targets(totals.select("source", "source_size"), weights, share, most)
    u = _hex(F.coalesce("source", F.lit("")), 9, seed) / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(F.coalesce("source", F.lit("")).alias("key_"), F.col("source").isNull().alias("none_"), "source_size", "target", rate.alias("rate"), u.alias("u"))
    plan = plan.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    way = F.when(F.col("bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    ranks = ranked(rows, ["key", "none"], ["bucket", way, "doc_id", "digest"], "rank", write=written)
    both = ranks.join(plan, (F.col("key") == F.col("key_")) & (F.col("none") == F.col("none_")) & (F.col("rank") % SALTS == F.col("salt_")))
    upto = lambda k: F.floor(k * F.col("rate") + F.col("u"))
    copies = (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("long")
    return both.select("doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"))


def mixing_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    plan = mixing_plan(docs.select("doc_id", "text", "source"), **how)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix: every document as often as it is taken, with the columns of docs."""
    plan = mixing_plan(docs.select("doc_id", "text", "source"), **how)
    key = lambda *parts: F.coalesce(F.sha1(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})), F.lit(""))  # noqa: E731  never null
    given = plan.groupBy(key("doc_id", "source", "digest").alias("__of")).agg(F.sum("copies").alias("__all"), F.count("*").alias("__rows")).where("__all > 0")
    given = written(given.select("__of", F.expr("__all div __rows").alias("__each"), (F.col("__all") % F.col("__rows")).alias("__rest")), "given")
    keyed = docs.withColumn("__key", key(F.col("doc_id").cast("long").alias("doc_id"), "source", _digest().alias("digest")))
    rows = lambda part: keyed.join(given.where(part), F.col("__key") == F.col("__of")).drop("__of")
    out = rows("__rest = 0").select(*docs.columns, F.col("__each").cast("int").alias("__copies"))
    if given.where("__rest > 0").take(1):  # of repeated rows whose copies do not come out even, the first by their other columns get one more
        order = [F.col(f.name) if ordered(f.dataType) else F.to_json(F.struct(f.name)) for f in docs.schema if f.name not in ("doc_id", "source", "text")]
        uneven = ranked(rows("__rest > 0"), ["__key"], order, "__place", write=written)
        out = out.union(uneven.select(*docs.columns, (F.col("__each") + (F.col("__place") < F.col("__rest")).cast("long")).cast("int").alias("__copies")))
    return out.select(F.explode(F.array_repeat(F.struct(*docs.columns), F.col("__copies"))).alias("__row")).select("__row.*")
