"""Codes for sessions of several documents: one value, one code, numbered in call order.

A session may hold a third of all documents, so nothing of it is gathered in one task: a session's distinct values,
and the numbers that its texts reserve, are ranked in two levels (`ranking`). The k-th number that is not reserved is
found by one more ranking: with r_1 < r_2 < ... reserved, r_j has r_j - j free numbers below it, so it goes before the
k-th value exactly if r_j - j < k. In that common order of values and reserved numbers, a row's rank is its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ranking import ranked
from .replace import LABELS, label_of, reserved_tokens, token
from .rewrite import rewritten
from .spans import merge_confirmed


def _values(docs: DataFrame, body: Column, spans: str, *keys: Column | str) -> DataFrame:
    """keys, start, end, type, original: a row for each union of a document's spans."""
    rows = docs.select(*keys, body.alias("__body"), F.explode_outer(merge_confirmed(body, F.col(spans))).alias("s")).where("s is not null")
    value = F.substring(F.col("__body"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select(*(c for c in rows.columns if c not in ("__body", "s")), "s.start", "s.end", "s.type", value.alias("original"))


def reserved_numbers(docs: DataFrame, session: str, text: str = "text") -> DataFrame:
    """session, type, number: the numbers of codes that the session's own texts hold already, in any case."""
    tokens = docs.select(F.col(session).alias("session"), F.explode(reserved_tokens(F.col(text))).alias("t")).distinct()
    label, number = F.upper(F.regexp_extract("t", r"^\[\[(.*)_\d+\]\]$", 1)), F.expr(r"try_cast(regexp_extract(t, '_(\\d+)\\]\\]$', 1) AS long)")
    kind = F.lit(None).cast("string")
    for name, shown in LABELS.items():
        kind = F.when(label == shown, name).otherwise(kind)
    rows = tokens.select("session", "t", kind.alias("type"), number.alias("number")).where("type is not null and number > 0")
    return rows.where(F.lower(token(label_of(F.col("type")), F.col("number"))) == F.col("t")).select("session", "type", "number")


def free_numbers(values: DataFrame, reserved: DataFrame) -> DataFrame:
    """values (session, type, ord, ...) -> the same and number: along ord, the session's and type's numbers that are not reserved (session, type, number)."""
    group = ["session", "type"]
    rows = ranked(values, group, ["ord"], "k")
    reserved = stored(reserved, "reserved")
    if not reserved.take(1):
        return rows.withColumn("number", F.col("k") + 1).drop("k")
    own = ranked(reserved, group, ["number"], "j").select(*group, (F.col("number") - F.col("j") - 1).alias("k"), F.lit(1).alias("side"))
    both = rows.withColumn("k", F.col("k") + 1).withColumn("side", F.lit(0)).unionByName(own, allowMissingColumns=True)
    return ranked(both, group, ["k", "side"], "number").where("side = 0").withColumn("number", F.col("number") + 1).select(*values.columns, "number")


def session_codes(docs: DataFrame, session: str, order: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """(session, original, pseudonym, type, ord) for documents taken in `order`; all their source tokens are reserved.

    First occurrences are a grouped minimum, so a session's repeats are combined before the shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = _values(docs, body, spans, F.col(session).alias("session"), F.col(order).alias("o"))
    firsts = found.groupBy("session", "type", "original").agg(F.min(F.struct("o", "start")).alias("at"))
    placed = ranked(firsts, ["session"], ["at", "original"], "ord").withColumn("ord", (F.col("ord") + 1).cast("int"))
    numbered = free_numbers(placed, reserved_numbers(docs, session, text))
    return numbered.select("session", "original", token(label_of(F.col("type")), F.col("number")).alias("pseudonym"), "type", "ord")


def anonymize_sessions(docs: DataFrame, codes: DataFrame, session: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds `anonymized`: each span takes the code of its session, type and value. Spans meet codes by a join, a document's codes are not searched."""
    body = F.coalesce(F.col(text), F.lit(""))
    uid = docs.withColumn("__row", F.monotonically_increasing_id())
    found = _values(uid, body, spans, "__row", F.col(session).alias("__session"))
    own = codes.select(F.col("session").alias("__of"), F.col("type").alias("__type"), F.col("original").alias("__original"), "pseudonym")
    met = found.join(own, F.col("__session").eqNullSafe(F.col("__of")) & (F.col("type") == F.col("__type")) & (F.col("original") == F.col("__original")))
    marks = met.groupBy(F.col("__row").alias("__at")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("pseudonym").alias("mark")))).alias("__marks"))
    both = uid.join(marks, F.col("__row") == F.col("__at"), "left")
    return both.withColumn("anonymized", rewritten(body, F.col("__marks"))).drop("__row", "__at", "__marks")
