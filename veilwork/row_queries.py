"""Queries of the operators on rows: islands, sessions, terms, token predictions, metrics and changed texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes
from .operators.detect import long_spans
from .operators.evaluate import metrics
from .operators.islands import confirmed, ranges, redacted, resolved
from .operators.lexicon import detect_with_lexicon
from .operators.persons import person_runs, person_spans, with_persons
from .operators.replace import redact
from .operators.review import reviewed
from .operators.sessions import session_codes
from .plans.rules import regex_candidates
from .queries import _EMAIL, _FULL_ORDER, _IPV4, _RAW, _SPAN, _islands, _raw_spans, duck_matches, query
from .session import dealt, shared_dir, table
from .streaming.mapper import STORE, map_sessions


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query(f"""WITH {_RAW}, {_islands(_FULL_ORDER)}
SELECT doc_id, min(start) AS start, max(stop) AS "end", CASE WHEN count(DISTINCT type) FILTER (grows) > 1 THEN 'detail' ELSE min(type) FILTER (grows) END AS type, max(confidence) FILTER (grows) AS confidence
FROM i GROUP BY doc_id, island""")
def islands_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a table, one a row."""
    return resolved(_raw_rows(spark, sf_dir)).drop("layer")


@query(f"""WITH {_RAW}, {_islands("start, stop DESC")}, u AS (SELECT doc_id, min(start) AS start, max(stop) AS "end", CASE WHEN count(DISTINCT type) > 1 THEN 'detail' ELSE min(type) END AS type FROM i GROUP BY doc_id, island)
SELECT * FROM u UNION ALL SELECT doc_id, start, "end", NULL FROM u""")
def islands_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions with their types, and without."""
    rows = _raw_rows(spark, sf_dir)
    return confirmed(rows).unionByName(ranges(rows).withColumn("type", F.lit(None).cast("string")))


def _found(docs: DataFrame, *keys: str) -> DataFrame:
    return long_spans(docs, *keys, spans=regex_candidates(F.coalesce("text", F.lit("")), ["email", "ipv4"]))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_EMAIL}', '[REMOVED]', 'g'), '{_IPV4}', '[REMOVED]', 'g') AS redacted FROM documents")
def islands_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts redacted by a table of spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redacted(docs, _found(docs, "doc_id")).select("doc_id", "redacted")


@query("""
WITH v AS (SELECT c_nationkey AS session, 'a' || c_custkey || '@b.de' AS original, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
r AS (SELECT DISTINCT c_nationkey AS session, c_custkey % 40 + 1 AS number FROM customer WHERE c_custkey % 7 = 0),
f AS (SELECT s.session, n.number, row_number() OVER (PARTITION BY s.session ORDER BY n.number) AS k FROM (SELECT session, count(*) AS n FROM v GROUP BY session) s
  JOIN (SELECT unnest(range(1, (SELECT count(*) + 60 FROM customer)::BIGINT)) AS number) n ON n.number <= s.n + 40 LEFT JOIN r ON r.session = s.session AND r.number = n.number WHERE r.number IS NULL)
SELECT session, original, '[[EMAIL_' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END || ']]' AS pseudonym, 'email' AS type, k::INTEGER AS ord FROM v JOIN f USING (session, k)""")
def session_reserved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each nation; every seventh customer's text holds what looks like one of the codes."""
    k = F.col("c_custkey").cast("string")
    held = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" [[eMail_"), F.lpad((F.col("c_custkey") % 40 + 1).cast("string"), 3, "0"), F.lit("]] [[email_1]]"))).otherwise("")
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_nationkey", F.concat(F.lit("to a"), k, F.lit("@b.de"), held).alias("text"))
    return session_codes(docs.withColumn("spans", regex_candidates(F.col("text"), ["email"])), "c_nationkey", "c_custkey")


_E = f"""
e AS (SELECT doc_id, start, value, 'email' AS type, 'EMAIL' AS label FROM ({duck_matches('documents', 'doc_id', 'text', _EMAIL)}) UNION ALL SELECT doc_id, start, value, 'ip', 'IP' FROM ({duck_matches('documents', 'doc_id', 'text', _IPV4)}))"""


@query(f"""WITH {_E.strip()},
s AS (SELECT d.source AS session, e.type, e.label, e.value, min((d.doc_id, e.start)) AS place FROM e JOIN documents d USING (doc_id) GROUP BY ALL),
c AS (SELECT session, type, value, '[[' || label || '_' || lpad(row_number() OVER (PARTITION BY session, type ORDER BY place)::VARCHAR, 3, '0') || ']]' AS code FROM s),
p AS (SELECT e.doc_id, e.start, e.value, c.code, coalesce(lag(e.start + length(e.value)) OVER (PARTITION BY e.doc_id ORDER BY e.start), 0) AS prior, max(e.start + length(e.value)) OVER (PARTITION BY e.doc_id) AS final
  FROM e JOIN documents d USING (doc_id) JOIN c ON c.session IS NOT DISTINCT FROM d.source AND c.type = e.type AND c.value = e.value),
a AS (SELECT p.doc_id, string_agg(substr(d.text, p.prior + 1, p.start - p.prior) || p.code, '' ORDER BY p.start) || substr(any_value(d.text), any_value(p.final) + 1) AS anonymized, count(DISTINCT p.code) AS n_codes FROM p JOIN documents d USING (doc_id) GROUP BY p.doc_id)
SELECT d.source, d.doc_id, coalesce(anonymized, d.text, '') AS anonymized, coalesce(n_codes, 0)::INTEGER AS n_codes FROM documents d LEFT JOIN a USING (doc_id)""")
def mapped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that go on: a stream over the first half of the documents, stopped, and started again over the rest. A session for each source."""
    path = f"{shared_dir(spark)}/veilwork/mapped-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    spark.conf.set(*STORE)
    for part in (F.col("doc_id") <= half, F.col("doc_id") > half):
        docs.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{path}/in").withColumn("spans", regex_candidates(F.col("text"), ["email", "ipv4"]))
        run = map_sessions(stream, "source", "doc_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("source", "doc_id", "anonymized", F.size("codes").alias("n_codes"))


_TEXT = "'İİ ask Bo Smit' || c_custkey || ', ẞ or BO SMIT' || c_custkey || ' of the STRASSE ' || c_custkey"


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'İİ ask [REMOVED], ẞ or [REMOVED] of the STRASSE ' || c_custkey WHEN 1 THEN 'İİ ask [REMOVED] or BO SMIT' || c_custkey || ' of the STRASSE ' || c_custkey
  ELSE 'İİ ask Bo Smit' || c_custkey || ', ẞ or BO [REMOVED] STRASSE ' || c_custkey END AS redacted FROM customer""")
def reviewed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms whose places lie behind letters that change their length in lower case, that cross a detected span, and that overlap each other."""
    k = F.col("c_custkey").cast("string")
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT.replace("c_custkey", "CAST(c_custkey AS STRING)")).alias("text"))
    spans = docs.where("c_custkey % 3 = 1").select("c_custkey", F.lit(7).alias("start"), (F.lit(14) + F.length(k)).alias("end"), F.lit("name").alias("type"))
    decisions = spans.select("c_custkey", "start", "end", F.lit(False).alias("confirmed"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("bo smit"), k))).when(F.col("c_custkey") % 3 == 1, F.array(F.concat(k, F.lit(", ß")))).otherwise(F.array(F.concat(F.lit("smit"), k, F.lit(" of")), F.concat(k, F.lit(" OF the"))))
    terms = docs.select("c_custkey", F.explode(said).alias("term"), F.lit("name").alias("type"))
    return reviewed(docs, spans, decisions, terms, "c_custkey").select("c_custkey", redact(F.col("text"), F.col("confirmed")).alias("redacted"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS seq FROM documents),
t AS (SELECT doc_id, seq, CASE WHEN seq % 7 = 3 THEN '##' || w ELSE w END AS word, CASE length(w) % 5 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' ELSE 'O' END AS tag, (5 + seq % 6) / 10.0::DOUBLE AS score FROM w),
p AS (SELECT *, tag <> 'O' AS person, starts_with(word, '##') AS goes_on, coalesce(lag(tag <> 'O') OVER (PARTITION BY doc_id ORDER BY seq), FALSE) AS open FROM t),
b AS (SELECT *, person AND NOT (open AND (goes_on OR tag <> 'B-PER')) AS begins FROM p),
r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, run::BIGINT AS run, string_agg(CASE WHEN begins OR goes_on THEN '' ELSE ' ' END || CASE WHEN goes_on THEN substr(word, 3) ELSE word END, '' ORDER BY seq) AS word, min(score) AS score
FROM r WHERE person GROUP BY doc_id, run HAVING min(score) >= 0.6 AND length(string_agg(CASE WHEN begins OR goes_on THEN '' ELSE ' ' END || CASE WHEN goes_on THEN substr(word, 3) ELSE word END, '' ORDER BY seq)) >= 2""")
def person_tag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents is a token, tagged by its length; every seventh goes on with the word before it."""
    w = F.col("w")
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("seq", "w"))
    tag = F.when(F.length(w) % 5 == 0, "B-PER").when(F.length(w) % 5 == 1, "I-PER").otherwise("O")
    tokens = words.select("doc_id", "seq", F.when(F.col("seq") % 7 == 3, F.concat(F.lit("##"), w)).otherwise(w).alias("word"), tag.alias("tag"), ((5 + F.col("seq") % 6) / F.lit(10.0)).alias("score"))
    return person_runs(tokens)


@query("""
WITH c AS (SELECT c_custkey, 'K' || c_custkey AS k, (5 + c_custkey % 6) / 10.0::DOUBLE AS s FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 9 END AS start, (14 + length(k))::INTEGER AS "end", CASE WHEN c_custkey % 2 = 0 THEN 'detail' ELSE 'name' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'regex' ELSE 'ner' END AS layer,
  CASE WHEN c_custkey % 2 = 0 THEN 0.9::DOUBLE ELSE least(0.8::DOUBLE, s) END AS confidence FROM c WHERE s >= 0.6
UNION ALL SELECT c_custkey, 6, 12, 'detail', 'regex', 0.9::DOUBLE FROM c WHERE s < 0.6 AND c_custkey % 2 = 0""")
def person_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name in pieces of several scores; for every other customer a span of another layer crosses it."""
    k, key = F.col("c_custkey").cast("string"), "c_custkey"
    docs = table(spark, sf_dir, "customer").select(key, F.concat(F.lit("spoke to Anna K"), k, F.lit("; Kay left")).alias("text"))
    piece = lambda n, word, tag, score: F.struct(F.lit(n).alias("seq"), word.alias("word"), F.lit(tag).alias("tag"), score.alias("score"))
    tokens = docs.select(key, F.explode(F.array(piece(0, F.lit("Anna"), "B-PER", F.lit(0.9)), piece(1, F.lit("K"), "I-PER", F.lit(0.8)), piece(2, F.concat(F.lit("##"), k), "I-PER", (5 + F.col(key) % 6) / F.lit(10.0)), piece(3, F.lit("left"), "O", F.lit(1.0)))).alias("t")).select(key, "t.*")
    other = docs.where("c_custkey % 2 = 0").select(key, F.lit(6).alias("start"), F.lit(12).alias("end"), F.lit("detail").alias("type"), F.lit("regex").alias("layer"), F.lit(0.9).alias("confidence"), F.lit(121).alias("priority"), F.lit(1).alias("rule_seq"))
    return with_persons(other, person_spans(docs, tokens, key), key)


@query(f"""WITH {_E.strip()},
s AS (SELECT e.doc_id, e.start, (e.start + length(e.value))::BIGINT AS stop, e.value, CASE WHEN doc_id % 3 = 0 THEN 'detail' ELSE e.type END AS type, e.label AS rule, lang FROM e JOIN documents USING (doc_id)),
n AS (SELECT DISTINCT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN value[2:] ELSE value END AS value, CASE WHEN doc_id % 5 = 0 THEN 'url' ELSE type END AS type, lang FROM e JOIN documents USING (doc_id)),
i AS (SELECT doc_id, value, type, lang, unnest(list_filter(range(length(text)), lambda i: substr(text, i + 1, length(value)) = value)) AS start FROM n),
m AS (SELECT unnest(['strict', 'lenient']) AS matching),
h AS (SELECT matching, i.doc_id, i.value, i.type, i.lang, i.start, min(s.rule) AS rule FROM m CROSS JOIN i LEFT JOIN s ON s.doc_id = i.doc_id AND s.start <= i.start AND s.stop >= i.start + length(i.value) AND (s.type = i.type OR (matching = 'lenient' AND s.type = 'detail')) GROUP BY ALL),
w AS (SELECT matching, s.* FROM m CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = s.doc_id AND (contains(n.value, s.value) OR contains(s.value, n.value)) AND (s.type = n.type OR (matching = 'lenient' AND s.type = 'detail')))),
f AS (SELECT matching, type, rule, lang, 1 AS o, (rule IS NOT NULL)::INT AS h, 0 AS d, 0 AS f FROM h UNION ALL SELECT matching, type, rule, lang, 0, 0, 1, 0 FROM m CROSS JOIN s UNION ALL SELECT matching, type, rule, lang, 0, 0, 0, 1 FROM w),
g AS (SELECT matching, type, rule, lang, CASE grouping(type, rule, lang) WHEN 7 THEN 'all' WHEN 3 THEN 'type' WHEN 6 THEN 'lang' WHEN 2 THEN 'type and lang' WHEN 5 THEN 'rule' END AS by, sum(o)::BIGINT AS occurrences, sum(h)::BIGINT AS hits, sum(d)::BIGINT AS detections, sum(f)::BIGINT AS false_positives
  FROM f GROUP BY GROUPING SETS ((matching), (matching, type), (matching, lang), (matching, type, lang), (matching, rule)))
SELECT *, CASE WHEN occurrences > 0 THEN hits / occurrences END AS recall, CASE WHEN detections > 0 THEN false_positives / detections END AS false_rate FROM g""")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the documents' addresses, some shortened and some of another type, against spans of which a third are details."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = _found(docs, "doc_id", "lang", "text").withColumn("rule", F.when(F.col("type") == "email", "EMAIL").otherwise("IP"))
    spans = found.withColumn("type", F.when(F.col("doc_id") % 3 == 0, "detail").otherwise(F.col("type"))).drop("text")
    value = F.when(F.col("doc_id") % 4 == 0, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    notes = found.select("doc_id", "text", value.alias("value"), F.when(F.col("doc_id") % 5 == 0, "url").otherwise(F.col("type")).alias("type"), "lang")
    return metrics(notes, spans)


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' x' || doc_id || '@y.de' ELSE coalesce(text, '') END AS text FROM documents)
SELECT doc_id, doc_id % 10 = 0 AS computed, {_SPAN} FROM ({duck_matches('d', 'doc_id', 'text', _EMAIL)})""")
def changed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every tenth document change between two runs; computed tells whose spans the second run found."""
    email = lambda rows: rows.withColumn("spans", regex_candidates(F.col("text"), ["email"]))
    first = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    memo, _ = changes.refreshed(first, find=email)
    second = first.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" x"), F.col("doc_id").cast("string"), F.lit("@y.de"))).otherwise(F.col("text")))
    memo, new = changes.refreshed(second, memo, find=email)
    rows = changes.remembered(second, memo).join(new.select("digest", F.lit(True).alias("__new")), "digest", "left")
    return long_spans(rows.withColumn("computed", F.coalesce("__new", F.lit(False))), "doc_id", "computed").select("doc_id", "computed", "start", "end", "value")


_LETTERS = "translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')"


@query(f"""
WITH n AS (SELECT c_custkey, 'Ga' || {_LETTERS} AS given, 'Fom' || {_LETTERS} AS family FROM customer)
SELECT c_custkey, 7 AS start, (7 + length(value))::INTEGER AS "end", value, 'name' AS type, 'list' AS layer, confidence FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN family ELSE given || ' ' || family END AS value, CASE c_custkey % 3 WHEN 0 THEN 0.69::DOUBLE ELSE 0.94::DOUBLE END AS confidence FROM n WHERE c_custkey % 3 < 2)""")
def lexicon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon with two names for each customer, as a table; a third of the texts hold names that are not in it."""
    letters = F.expr(_LETTERS)
    base = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Ga"), letters).alias("given"), F.concat(F.lit("Fom"), letters).alias("family"))
    names = base.select(F.explode(F.array(F.struct(F.lower("given").alias("name"), F.lit("given").alias("kind")), F.struct(F.upper("family").alias("name"), F.lit("family").alias("kind")))).alias("n")).select("n.*")
    said = F.when(F.col("c_custkey") % 3 == 0, F.col("family")).when(F.col("c_custkey") % 3 == 1, F.concat("given", F.lit(" "), "family")).otherwise(F.concat(F.lit("Xu"), letters))
    docs = base.select("c_custkey", F.concat(F.lit("we saw "), said, F.lit(" there")).alias("text"))
    return long_spans(detect_with_lexicon(docs, names, "c_custkey", columns=False), "c_custkey").where("type = 'name'")
