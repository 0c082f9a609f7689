"""Queries over the library's own operators, each with DuckDB SQL that gives the same rows.

Rules without hits in the given tables run on texts made from other tables' columns with `concat`; their
SQL computes the expected spans from those columns, not with the same patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import excel_date
from .functions.textops import WORD, fold, name_key
from .operators.detect import detect, long_spans
from .operators.evaluate import score
from .operators.matching import matches
from .operators.names import SEED_FAMILY, SEED_GIVEN, NameLists
from .operators.replace import MALFORMED, MISSING, UNKNOWN, anonymize, code_table, redact, reserved_tokens, restore, restore_flags
from .operators.sessions import session_codes
from .operators.spans import apply_manual, merge_confirmed, merge_ranges, resolve_overlaps
from .plans.rules import regex_candidates
from .session import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REPORTED = ["start", "end", "value", "type"]


def query(oracle: str = "") -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def rule_rows(df: DataFrame, key: str, text: Column, *rules: str) -> DataFrame:
    """Spans that the named rules alone resolve to, one a row."""
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("text"))
    return long_spans(rows, key, spans=resolve_overlaps(F.col("text"), regex_candidates(F.col("text"), list(rules)))).select(key, *REPORTED)


def duck_matches(table_: str, key: str, text: str, pattern: str) -> str:
    """SQL rows (key, start, value) of a pattern's matches."""
    return f"""
SELECT {key}, (list_sum(list_transform(g[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i], lambda x: length(x))), 0))::INTEGER AS start, m[i + 1] AS value
FROM (SELECT {key}, m, g, unnest(range(len(m))) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {table_}))"""


_EMAIL = r"[\p{L}\p{N}\p{M}.!#$%&''*+/=?^_`{|}~\-]+[@＠][\p{L}\p{N}](?:[\p{L}\p{N}\p{M}\-]{0,61}[\p{L}\p{N}\p{M}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}\-]{0,61}[\p{L}\p{N}\p{M}])?)+"
_IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
_PHONE = r"\+\s?\d{1,3}(?:[\s().-]*\d){6,13}"
_SPAN = "start, (start + length(value))::INTEGER AS \"end\", value"


def _all_documents() -> str:
    parts = [f"SELECT doc_id, {_SPAN}, '{kind}' AS type FROM ({duck_matches('documents', 'doc_id', 'text', pattern)})" for kind, pattern in (("email", _EMAIL), ("ip", _IPV4), ("phone", _PHONE))]
    return " UNION ALL ".join(parts)


@query(_all_documents())
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over documents; e-mail, IPv4 and phone are what they hold."""
    return long_spans(detect(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").select("doc_id", *REPORTED)


@query(f"SELECT doc_id, {_SPAN}, 'email' AS type FROM ({duck_matches('documents', 'doc_id', 'text', _EMAIL)})")
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "email")


@query(f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{_EMAIL}', '[REMOVED]', 'g') AS redacted FROM documents")
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", redact(text, regex_candidates(text, ["email"])).alias("redacted"))


@query(f"SELECT doc_id, {_SPAN}, 'ip' AS type FROM ({duck_matches('documents', 'doc_id', 'text', _IPV4)})")
def detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "ipv4")


@query(f"SELECT doc_id, {_SPAN}, 'phone' AS type FROM ({duck_matches('documents', 'doc_id', 'text', _PHONE)})")
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "phone_intl", "phone_nanp")


@query(f"""
SELECT page_id, start, (start + length(value))::INTEGER AS "end", value, 'url' AS type
FROM (SELECT page_id, start, regexp_replace(value, '[.,;:!?]+$', '') AS value FROM ({duck_matches('pages', 'page_id', 'html', "(?i)(?:https?://|www[.])[^[:space:]<>\"'']+")}))""")
def detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "url")


def _made(prefix: str, value: str, kind: str, key: str, table_: str, valid: str = "TRUE") -> str:
    """SQL for one expected span behind a prefix."""
    return f"SELECT {key}, length({prefix})::INTEGER AS start, (length({prefix}) + length({value}))::INTEGER AS \"end\", {value} AS value, '{kind}' AS type FROM {table_} WHERE {valid}"


def _zeros(column: str, n: int) -> Column:
    return F.lpad(F.col(column).cast("string"), n, "0")


@query(_made("'Pupil ' || o_orderkey || ', geboortedatum: '", "strftime(o_orderdate, '%d/%m/%y')", "date", "o_orderkey", "orders"))
def dob_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Pupil "), F.col("o_orderkey"), F.lit(", geboortedatum: "), F.date_format("o_orderdate", "dd/MM/yy"), F.lit(" in class"))
    return rule_rows(dealt(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", text, "date_dob_label")


_DAY = "(o_orderkey % 32 + 1)"
_DATE = f"lpad({_DAY}::VARCHAR, 2, '0') || '-' || strftime(o_orderdate, '%m-%Y')"


@query(_made("'Order of '", _DATE, "date", "o_orderkey", "orders", f"{_DAY} <= day(last_day(o_orderdate)) OR ({_DAY} <= 12 AND month(o_orderdate) <= day(last_day(make_date(year(o_orderdate), least({_DAY}, 12), 1))))"))
def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days run from 1 to 32, so some dates do not exist."""
    day = F.lpad((F.col("o_orderkey") % 32 + 1).cast("string"), 2, "0")
    text = F.concat(F.lit("Order of "), day, F.lit("-"), F.date_format("o_orderdate", "MM-yyyy"), F.lit(" came late"))
    return rule_rows(dealt(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", text, "date_numeric")


@query(_made("'On '", "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-d %B %Y') ELSE strftime(o_orderdate, '%b. %-d, %Y') END", "date", "o_orderkey", "orders"))
def month_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMM. d, yyyy"))
    return rule_rows(dealt(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", F.concat(F.lit("On "), when, F.lit(" we met.")), "date_dmy_text", "date_mdy_text")


_NINE = "lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0')"
_ELEVEN = " + ".join(f"substr({_NINE}, {k}, 1)::INTEGER * {10 - k}" for k in range(1, 9)) + f" - substr({_NINE}, 9, 1)::INTEGER"


@query(_made("'BSN is: '", _NINE, "bsn", "c_custkey", "customer", f"({_ELEVEN}) % 11 = 0 AND {_NINE} <> '000000000'"))
def bsn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nine = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    return rule_rows(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", F.concat(F.lit("BSN is: "), nine, F.lit(".")), "bsn_label")


_IBAN = "'nl' || lpad((s_suppkey % 97)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN ' ABNA ' ELSE 'ABNA' END || lpad(s_suppkey::VARCHAR, 10, '0')"


@query(_made("'pay to '", _IBAN, "iban", "s_suppkey", "supplier"))
def ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing digits do not belong to an IBAN of this country's length."""
    bank = F.when(F.col("s_suppkey") % 2 == 0, " ABNA ").otherwise("ABNA")
    value = F.concat(F.lit("nl"), F.lpad((F.col("s_suppkey") % 97).cast("string"), 2, "0"), bank, _zeros("s_suppkey", 10))
    return rule_rows(dealt(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", F.concat(F.lit("pay to "), value, F.lit(" 77 now")), "iban")


@query(" UNION ALL ".join([
    _made("'Lives at '", "c_custkey % 90 + 1 || ' Old Oak Lane'", "address", "c_custkey", "customer"),
    _made("'Lives at ' || (c_custkey % 90 + 1) || ' Old Oak Lane, '", "(1000 + c_custkey % 9000) || ' ' || chr((65 + c_nationkey)::INTEGER) || 'B'", "postcode", "c_custkey", "customer"),
]))
def addresses_and_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("Lives at "), (k % 90 + 1).cast("string"), F.lit(" Old Oak Lane, "), (F.lit(1000) + k % 9000).cast("string"), F.lit(" "), F.chr(F.lit(65) + F.col("c_nationkey")), F.lit("B."))
    return rule_rows(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", text, "addr_num_first", "postcode_nl")


@query(_made("'see '", "'kerkstraat ' || (c_custkey % 300 + 1) || CASE WHEN c_custkey % 3 = 0 THEN '-A' ELSE '' END", "address", "c_custkey", "customer"))
def dutch_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("see "), F.lit("kerkstraat "), (k % 300 + 1).cast("string"), F.when(k % 3 == 0, "-A").otherwise(""), F.lit(", please"))
    return rule_rows(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", text, "addr_nl_compound")


@query(" UNION ALL ".join([
    _made("'Open '", "'part_' || p_partkey || '.pdf'", "filename", "p_partkey", "part"),
    _made("'Open part_' || p_partkey || '.pdf in \"'", "'C:\\own files\\' || p_partkey", "filename", "p_partkey", "part"),
]))
def filenames_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Open part_"), k, F.lit('.pdf in "C:\\own files\\'), k, F.lit('" now'))
    return rule_rows(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", text, "filename_token", "path_dquote")


@query(" UNION ALL ".join([
    _made("'student no: '", "'AB' || lpad(c_custkey::VARCHAR, 6, '0')", "detail", "c_custkey", "customer"),
    _made("'student no: AB' || lpad(c_custkey::VARCHAR, 6, '0') || '; passport #'", "'X' || lpad(c_custkey::VARCHAR, 8, '0')", "detail", "c_custkey", "customer"),
]))
def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("student no: AB"), _zeros("c_custkey", 6), F.lit("; passport #X"), _zeros("c_custkey", 8), F.lit(";"))
    return rule_rows(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", text, "id_student", "id_staff")


@query("SELECT c_custkey, 3 AS start, (3 + length(v))::INTEGER AS \"end\", v AS value, 'ip' AS type FROM (SELECT c_custkey, 'fe80::' || lower(to_hex(c_custkey % 65536)) AS v FROM customer)")
def ipv6_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("at fe80::"), F.lower(F.hex(F.col("c_custkey") % 65536)), F.lit(" up"))
    return rule_rows(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", text, "ipv6")


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, length('Name;B-S N') + 1 + row_number() OVER w * 0 AS head, c_name || ';' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS line,
  length(c_name) + 1 AS inset, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS nine FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
p AS (SELECT *, (head + coalesce(sum(length(line) + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + inset)::INTEGER AS start FROM c)
SELECT c_nationkey, start, start + 9 AS "end", nine AS value, 'bsn' AS type FROM p
WHERE (substr(nine, 1, 1)::INT * 9 + substr(nine, 2, 1)::INT * 8 + substr(nine, 3, 1)::INT * 7 + substr(nine, 4, 1)::INT * 6 + substr(nine, 5, 1)::INT * 5 + substr(nine, 6, 1)::INT * 4
  + substr(nine, 7, 1)::INT * 3 + substr(nine, 8, 1)::INT * 2 - substr(nine, 9, 1)::INT) % 11 = 0 AND nine <> '000000000'""")
def bsn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited block per nation, with one column of identity numbers."""
    nine = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat("c_name", F.lit(";"), nine).alias("line")))).alias("x"))
    blocks = lines.select("c_nationkey", F.concat(F.lit("Name;B-S N\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
    return long_spans(detect(blocks), "c_nationkey").where("type = 'bsn'").select("c_nationkey", *REPORTED)


_WORDS = r"\p{L}[\p{L}\p{M}]*(?:[''’-]\p{L}[\p{L}\p{M}]*)*"


@query(f"SELECT doc_id, {_SPAN} FROM ({duck_matches('conversations', 'conv_id * 100 + turn AS doc_id', 'text', _WORDS).replace('SELECT conv_id * 100 + turn AS doc_id, (', 'SELECT doc_id, (').replace('(SELECT conv_id * 100 + turn AS doc_id, m, g,', '(SELECT doc_id, m, g,')})")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return long_spans(rows, "doc_id", spans=matches(F.col("text"), WORD))


@query(f"""
SELECT word, regexp_replace(replace(replace(replace(replace(replace(lower(strip_accents(word)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS word FROM documents) GROUP BY word""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are made for distinct words only."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", name_key(F.col("word")).alias("key"), "n")


_GIVEN = ", ".join(f"'{x}'" for x in SEED_GIVEN)
_FAMILY = ", ".join(f"'{x}'" for x in SEED_FAMILY)


@query(f"""
WITH g AS (SELECT [{_GIVEN}] AS given, [{_FAMILY}] AS family),
t AS (SELECT c_custkey, upper(given[1 + c_custkey % {len(SEED_GIVEN)}][1]) || given[1 + c_custkey % {len(SEED_GIVEN)}][2:] AS a, upper(family[1 + c_nationkey % {len(SEED_FAMILY)}][1]) || family[1 + c_nationkey % {len(SEED_FAMILY)}][2:] AS b FROM customer, g),
v AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN a || ' van der ' || b WHEN 1 THEN a || ' ' || b ELSE b || ', ' || a END AS value, CASE WHEN c_custkey % 3 = 2 THEN 0.91 ELSE 0.94 END AS confidence FROM t)
SELECT c_custkey, 4 AS start, (4 + length(value))::INTEGER AS "end", value, 'name' AS type, 'list' AS layer, confidence::DOUBLE AS confidence FROM v""")
def list_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given and family names of the seed lexicon, with particles and in both orders."""
    given, family = (F.array(*map(F.lit, x)) for x in (SEED_GIVEN, SEED_FAMILY))
    a = F.initcap(F.get(given, (F.col("c_custkey") % len(SEED_GIVEN)).cast("int")))
    b = F.initcap(F.get(family, (F.col("c_nationkey") % len(SEED_FAMILY)).cast("int")))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(a, F.lit(" van der "), b)).when(F.col("c_custkey") % 3 == 1, F.concat(a, F.lit(" "), b)).otherwise(F.concat(b, F.lit(", "), a))
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("and "), name, F.lit(" spoke")).alias("text"))
    return long_spans(detect(docs, lists=NameLists(SEED_GIVEN, SEED_FAMILY), columns=False), "c_custkey").where("type = 'name'")


@query("""
SELECT c_custkey, 3 AS start, (3 + length(value))::INTEGER AS "end", value, 'name' AS type, 'custom' AS layer, confidence FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'zóe müller' WHEN 1 THEN 'MULLER Zoe' WHEN 2 THEN 'zoe' ELSE 'mullerzoe' END AS value,
    [0.995, 0.985, 0.96, 0.99][1 + c_custkey % 4]::DOUBLE AS confidence FROM customer)""")
def custom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "zóe müller").when(k == 1, "MULLER Zoe").when(k == 2, "zoe").otherwise("mullerzoe")
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("to "), said, F.lit("!")).alias("text"))
    return long_spans(detect(docs, lists=NameLists(custom=[("Zoë", "Müller")]), columns=False), "c_custkey")


# Synthetic spans: twelve events make a document of 100 characters.
_RAW = """
raw AS (SELECT event_id // 12 AS doc_id, (event_id * 37 % 90)::INTEGER AS start, (event_id * 37 % 90 + event_id * 13 % 9)::INTEGER AS stop,
  ['name', 'email', 'date', 'detail'][1 + event_id % 4] AS type, [80, 120, 105, 121][1 + event_id % 4] AS priority, (event_id % 7)::INTEGER AS seq, (50 + event_id % 50) / 100.0::DOUBLE AS confidence FROM events),
ok AS (SELECT * FROM raw WHERE stop > start)"""
_TEXT = "repeat('abcdefghij', 10)"


def _raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    start = (k * 37 % 90).cast("int")
    span = F.struct(
        start.alias("start"), (start + k * 13 % 9).cast("int").alias("end"), F.get(F.array(*map(F.lit, ("name", "email", "date", "detail"))), (k % 4).cast("int")).alias("type"), F.lit("regex").alias("layer"),
        ((50 + k % 50) / F.lit(100.0)).alias("confidence"), F.get(F.array(*map(F.lit, (80, 120, 105, 121))), (k % 4).cast("int")).alias("priority"), (k % 7).cast("int").alias("rule_seq"),
    )
    return e.groupBy(F.floor(k / 12).alias("doc_id")).agg(F.collect_list(span).alias("spans")).withColumn("text", F.lit("abcdefghij" * 10))


def _islands(order: str) -> str:
    return f"""
m AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
n AS (SELECT *, before IS NULL OR start >= before AS fresh, before IS NULL OR start >= before OR stop > before AS grows FROM m),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM n)"""


_FULL_ORDER = "start, stop DESC, priority DESC, seq, type, confidence"


@query(f"""WITH {_RAW}, {_islands(_FULL_ORDER)}
SELECT doc_id, min(start) AS start, max(stop) AS "end", substr({_TEXT}, min(start) + 1, max(stop) - min(start)) AS value,
  CASE WHEN count(DISTINCT type) FILTER (grows) > 1 THEN 'detail' ELSE min(type) FILTER (grows) END AS type, max(confidence) FILTER (grows) AS confidence
FROM i GROUP BY doc_id, island""")
def resolve_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_spans(spark, sf_dir).select("doc_id", F.explode(resolve_overlaps(F.col("text"), F.col("spans"))).alias("s"))
    return rows.select("doc_id", *(F.col("s")[c].alias(c) for c in (*REPORTED, "confidence")))


@query(f"""WITH {_RAW}, {_islands("start, stop DESC")}
SELECT doc_id, min(start) AS start, max(stop) AS "end", CASE WHEN count(DISTINCT type) > 1 THEN 'detail' ELSE min(type) END AS type FROM i GROUP BY doc_id, island""")
def merge_confirmed_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_spans(spark, sf_dir).select("doc_id", F.explode(merge_confirmed(F.col("text"), F.col("spans"))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(f"""WITH {_RAW}, {_islands("start, stop DESC")} SELECT doc_id, min(start) AS start, max(stop) AS "end" FROM i GROUP BY doc_id, island""")
def merge_ranges_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_spans(spark, sf_dir).select("doc_id", F.explode(merge_ranges(F.col("text"), F.col("spans"))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(f"""WITH {_RAW}, {_islands("start, stop DESC")},
r AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, island),
p AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prior, max(stop) OVER (PARTITION BY doc_id) AS final FROM r)
SELECT doc_id, string_agg(substr({_TEXT}, prior + 1, start - prior) || '[REMOVED]', '' ORDER BY start) || substr({_TEXT}, any_value(final) + 1) AS redacted FROM p GROUP BY doc_id""")
def redact_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_spans(spark, sf_dir).where(F.exists("spans", lambda s: s["end"] > s["start"]))
    return rows.select("doc_id", redact(F.col("text"), F.col("spans")).alias("redacted"))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("spans", regex_candidates(F.col("text"), ["email", "ipv4"]))
    return found.where(F.size("spans") > 0).withColumn("codes", code_table(F.col("text"), F.col("spans")))


_CODED = f"""
e AS (SELECT doc_id, start, value, 'email' AS type, 'EMAIL' AS label FROM ({duck_matches('documents', 'doc_id', 'text', _EMAIL)}) UNION ALL SELECT doc_id, start, value, 'ip', 'IP' FROM ({duck_matches('documents', 'doc_id', 'text', _IPV4)})),
f AS (SELECT doc_id, type, label, value AS original, min(start) AS place FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY place) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INTEGER AS ord FROM f),
c AS (SELECT doc_id, original, '[[' || label || '_' || lpad(n::VARCHAR, 3, '0') || ']]' AS pseudonym, type, ord FROM k)"""


@query(f"WITH {_CODED} SELECT * FROM c")
def code_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("doc_id", F.explode("codes").alias("c")).select("doc_id", "c.*")


@query(f"""WITH {_CODED}, p AS (SELECT e.doc_id, e.start, e.value, c.pseudonym, coalesce(lag(e.start + length(e.value)) OVER (PARTITION BY e.doc_id ORDER BY e.start), 0) AS prior, max(e.start + length(e.value)) OVER (PARTITION BY e.doc_id) AS final
  FROM e JOIN c ON e.doc_id = c.doc_id AND e.type = c.type AND e.value = c.original)
SELECT p.doc_id, string_agg(substr(d.text, p.prior + 1, p.start - p.prior) || p.pseudonym, '' ORDER BY p.start) || substr(any_value(d.text), any_value(p.final) + 1) AS anonymized, TRUE AS restored_exactly
FROM p JOIN documents d USING (doc_id) GROUP BY p.doc_id""")
def anonymize_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coded(spark, sf_dir).withColumn("anonymized", anonymize(F.col("text"), F.col("spans"), F.col("codes")))
    return rows.select("doc_id", "anonymized", (restore(F.col("anonymized"), F.col("codes")) == F.col("text")).alias("restored_exactly"))


@query(f"""WITH {_CODED}
SELECT doc_id, pseudonym, '{MISSING}' AS reason FROM c WHERE ord > 1
UNION ALL SELECT DISTINCT doc_id, '[[PERSON_999]]', '{UNKNOWN}' FROM c
UNION ALL SELECT DISTINCT doc_id, '[DATE_1]', '{MALFORMED}' FROM c""")
def restore_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply that holds the first code in lower case, an unknown one and a malformed one."""
    reply = F.concat(F.lit("Dear "), F.lower(F.get("codes", F.lit(0))["pseudonym"]), F.lit(" and [[PERSON_999]] of [DATE_1]"))
    rows = _coded(spark, sf_dir).select("doc_id", F.explode(restore_flags(reply, F.col("codes"), reserved_tokens(F.col("text")))).alias("f"))
    return rows.select("doc_id", "f.pseudonym", "f.reason")


@query(f"""WITH {_CODED.strip()},
s AS (SELECT d.source AS session, e.type, e.label, e.value AS original, min((d.doc_id, e.start)) AS place FROM e JOIN documents d USING (doc_id) GROUP BY ALL)
SELECT session, original, '[[' || label || '_' || lpad(row_number() OVER (PARTITION BY session, type ORDER BY place)::VARCHAR, 3, '0') || ']]' AS pseudonym, type, row_number() OVER (PARTITION BY session ORDER BY place)::INTEGER AS ord FROM s""")
def session_code_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per source, its documents in the order of their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return session_codes(docs.withColumn("spans", regex_candidates(F.col("text"), ["email", "ipv4"])), "source", "doc_id")


@query(f"SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_all_documents()}) JOIN documents USING (doc_id) GROUP BY lang, type")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return long_spans(detect(docs), "doc_id", "lang").groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""
SELECT event_id // 12 AS doc_id, 3 AS start, 9 AS "end", 'defghi' AS value, 'date' AS type FROM events GROUP BY ALL
UNION ALL SELECT event_id // 12, 13, 17, 'defg', 'date' FROM events GROUP BY ALL""")
def manual_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `dEfG` (in any case) becomes a date; the first grows over the name span that it crosses."""
    docs = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 12).alias("doc_id")).distinct().withColumn("text", F.lit("abcdefghij" * 2))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit("name").alias("type"), F.lit("list").alias("layer"), F.lit(0.9).alias("confidence")))
    rows = docs.select("doc_id", F.explode(apply_manual(F.col("text"), spans, matches(F.col("text"), r"(?iu)\QdEfG\E"), "date")).alias("s"))
    return rows.select("doc_id", *(F.col("s")[c].alias(c) for c in REPORTED))


@query("""
WITH d AS (SELECT count(*) AS n FROM customer)
SELECT 2 * n AS occurrences, n + (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0) AS hits, 2 * n AS detections, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS false_positives,
  (n + (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0)) / (2 * n)::DOUBLE AS recall, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) / (2 * n)::DOUBLE AS false_rate FROM d""")
def evaluate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated texts: each holds its number twice; every fifth document's second span is somewhere else and of another type."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("id "), _zeros("c_custkey", 9), F.lit(" and "), _zeros("c_custkey", 9), F.lit(" end")).alias("text"), _zeros("c_custkey", 9).alias("value"))
    notes = base.withColumn("type", F.lit("bsn"))
    first = base.select("doc_id", F.lit(3).alias("start"), F.lit(12).alias("end"), "value", F.lit("bsn").alias("type"))
    moved = F.col("doc_id") % 5 == 0
    second = base.select("doc_id", F.when(moved, 0).otherwise(17).alias("start"), F.when(moved, 2).otherwise(26).alias("end"), F.when(moved, "id").otherwise(F.col("value")).alias("value"), F.when(moved, "name").otherwise("detail").alias("type"))
    return score(notes, first.union(second))


@query("""
SELECT o_orderkey, s AS serial, CASE WHEN s = 60 THEN '1900-02-29' ELSE (DATE '1899-12-31' + (s - (s > 60)::INT)::INT)::VARCHAR END || CASE WHEN s % 4 = 0 THEN '' ELSE 'T' || ['06:00:00', '12:00:00', '18:00:00'][s % 4] END AS iso
FROM (SELECT o_orderkey, (o_orderkey % 50000)::INTEGER AS s FROM orders)""")
def excel_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's key as the serial of a day and a quarter of it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50_000).cast("int").alias("serial"))
    return rows.select("o_orderkey", "serial", excel_date(F.col("serial") + (F.col("serial") % 4) / 4.0).alias("iso"))


@query("SELECT c_nationkey, string_agg('File name: \"' || c_name || '\"', chr(10) ORDER BY c_name) AS text FROM customer GROUP BY c_nationkey")
def filename_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted lists of file names, with blank lines and blanks around names."""
    from .sources.files import filename_lines

    pasted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list("c_name")), lambda x: F.concat(F.lit(" "), x)), "\r\n\n")).alias("pasted"))
    return pasted.select("c_nationkey", filename_lines(F.col("pasted")).alias("text"))


@query(r"SELECT p_partkey, lower(strip_accents(p_name || ' Ünïcode Œuvre')) AS plain, p_partkey AS n FROM part".replace("lower(strip_accents(p_name || ' Ünïcode Œuvre'))", "replace(lower(strip_accents(p_name || ' Ünïcode Œuvre')), 'œ', 'oe')"))
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fold(F.concat("p_name", F.lit(" Ünïcode Œuvre"))).alias("plain"), F.col("p_partkey").alias("n"))
