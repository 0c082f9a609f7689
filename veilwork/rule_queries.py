"""Queries of rules that the given tables have no hits for, of columns, lists, files and the review.

Texts are made from other tables' columns. An expression is valid in Spark and in DuckDB, so each query's text
and the span that it must hold are written once; which of the values are valid is told by a condition on the columns, not by the
rule's pattern.
"""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.detect import detect, long_spans
from .operators.names import SEED_FAMILY, NameLists
from .operators.replace import code_table, redact
from .operators.review import prompt, request_text, reviewed
from .operators.spans import known_type
from .plans.rules import regex_candidates
from .queries import ORACLES, QUERIES, REPORTED, query, rule_rows
from .session import dealt, shared_dir, table
from .sources.delimited import name_records
from .sources.files import decode_plain, extract_files, read_files
from .streaming.stream import redact_folder

_LF, _Q, _BACK = "chr(10)", "chr(39)", "chr(92)"
_K, _P = "CAST(c_custkey AS STRING)", "CAST(p_partkey AS STRING)"
_SIX = f"lpad({_K}, 6, '0')"
_HOUSE = "CAST(c_custkey % 900 + 1 AS STRING)"
_MAYBE = f"CASE WHEN c_custkey % 5 = 0 THEN 'nergens' ELSE {_HOUSE} END"

#: name -> (rule, table, key, text before the value, value, text after it, type, which values are valid)
MADE = {
    "filename_labels": ("filename_label", "part", "p_partkey", f"'Hello' || {_LF} || ' Bestandsnaam : '", f"'verslag ' || {_P} || ' (2).docx'", f"{_LF} || 'bye'", "filename", "TRUE"),
    "filename_own_lines": ("filename_line", "part", "p_partkey", f"'see' || {_LF} || '  '", f"'my plan ' || {_P} || CASE WHEN p_partkey % 3 = 0 THEN '.exe' ELSE '.XLSX' END", f"' ' || {_LF} || 'end'", "filename", "p_partkey % 3 <> 0"),
    "quoted_paths": ("path_squote", "part", "p_partkey", f"'open ' || {_Q}", f"CASE WHEN p_partkey % 2 = 0 THEN '/srv/own data/' ELSE 'C:' || {_BACK} || 'own files' || {_BACK} END || {_P}", f"{_Q} || ' now'", "filename", "TRUE"),
    "paths_with_extension": ("path_ext", "part", "p_partkey", "'see '", f"'/home/user/my files/plan ' || {_P} || '.pdf'", "' now'", "filename", "TRUE"),
    "bare_paths": ("path_bare", "part", "p_partkey", "'in '", f"CASE WHEN p_partkey % 4 = 0 THEN '/opt/app' ELSE '/var/log/app' END || {_P} || '/out'", "', then'", "filename", "p_partkey % 4 <> 0"),
    "addresses_with_term_first": ("addr_term_num", "customer", "c_custkey", "'stay at '", f"'Grande Via ' || {_HOUSE}", "', please'", "address", "TRUE"),
    "dutch_addresses_of_several_words": ("addr_nl_multi", "customer", "c_custkey", "'1: '", f"'jan van galenstraat ' || {_HOUSE} || CASE WHEN c_custkey % 2 = 0 THEN '-A' ELSE '' END", "'.'", "address", "TRUE"),
    "dutch_addresses_by_prefix": ("addr_nl_prefix", "customer", "c_custkey", "'at '", f"'laan van meerdervoort ' || {_HOUSE}", "'; ok'", "address", "TRUE"),
    "labelled_addresses": ("addr_label", "customer", "c_custkey", f"'x' || {_LF} || 'Adres: '", f"'Dorpskern ' || {_MAYBE}", "''", "address", "c_custkey % 5 <> 0"),
    "labelled_home_addresses": ("home_addr_label", "customer", "c_custkey", "'Postal  address : '", f"'Green Hill, ' || {_MAYBE}", f"{_LF} || 'y'", "detail", "c_custkey % 5 <> 0"),
    "american_phones": ("phone_nanp", "customer", "c_custkey", "'call '", f"CASE WHEN c_custkey % 2 = 0 THEN '(555) ' ELSE '555-' END || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0')", "' now'", "phone", "TRUE"),
    "dutch_student_numbers": ("id_student_nl", "customer", "c_custkey", "'leerlingnummer '", f"CASE WHEN c_custkey % 3 = 0 THEN 'ABCDEF' ELSE 'AB' || {_SIX} END", "', ok'", "detail", "c_custkey % 3 <> 0"),
    "dutch_staff_numbers": ("id_staff_nl", "customer", "c_custkey", "'Personeelsnummer: '", f"'P-' || {_SIX}", "';'", "detail", "TRUE"),
    "ipv4_numbers": ("ipv4", "customer", "c_custkey", "'at '", "CAST(c_custkey % 400 AS STRING) || '.0.0.' || CAST(c_custkey % 7 AS STRING)", "' up'", "ip", "c_custkey % 400 <= 255"),
    "ipv6_shapes": ("ipv6", "customer", "c_custkey", "'at '", "CASE c_custkey % 4 WHEN 0 THEN 'dead:beef::cafe' WHEN 1 THEN '1:2:3:4:5:6:7:8' WHEN 2 THEN '1:2:3' ELSE '1::2::3' END", "' up'", "ip", "c_custkey % 4 < 2"),
    "urls_in_brackets": ("url", "customer", "c_custkey", "'see ('", f"'https://e.org/a_(b)' || {_K} || CASE WHEN c_custkey % 2 = 0 THEN '[1]' ELSE '' END", "').'", "url", "TRUE"),
    "foreign_ibans": ("iban", "supplier", "s_suppkey", "'to '", "CASE s_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'BE' ELSE 'XX' END || '12' || lpad(CAST(s_suppkey AS STRING), CASE s_suppkey % 3 WHEN 1 THEN 12 ELSE 18 END, '0')", "', ok'", "iban", "s_suppkey % 3 < 2"),
    "short_birth_dates": ("date_dob_label", "customer", "c_custkey", "'DOB '", "lpad(CAST(c_custkey % 40 AS STRING), 2, '0') || '.' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '.' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')", "' end'", "date", "c_custkey % 40 BETWEEN 1 AND 12 OR (c_custkey % 28 + 1 <= 12 AND c_custkey % 40 BETWEEN 1 AND day(last_day(make_date(CAST(CASE WHEN c_custkey % 100 <= 49 THEN 2000 ELSE 1900 END + c_custkey % 100 AS INTEGER), CAST(LEAST(c_custkey % 28 + 1, 12) AS INTEGER), 1))))"),
}


def _made(name: str) -> None:
    rule, source, key, before, value, after, kind, valid = MADE[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_rows(dealt(spark, sf_dir, source, key), key, F.expr(f"{before} || {value} || {after}"), rule)

    run.__name__, run.__doc__ = name, f"The rule `{rule}` on texts made from {source}."
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, length({before})::INTEGER AS start, (length({before}) + length({value}))::INTEGER AS \"end\", {value} AS value, '{kind}' AS type FROM {source} WHERE {valid}"


for _name in MADE:
    _made(_name)

_DOB = "lpad(CAST(c_custkey % 31 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '-1999'"
_CELL = "c_name || ','"


@query(f"""SELECT c_custkey, length('Name,Date of Birth') + 1 + length({_CELL}) AS start, length('Name,Date of Birth') + 1 + length({_CELL}) + 10 AS "end", {_DOB} AS value, 'date' AS type FROM customer
WHERE c_custkey % 31 + 1 <= day(last_day(make_date(1999, (c_custkey % 12 + 1)::INTEGER, 1))) OR c_custkey % 31 + 1 <= 12""")
def dob_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one row for each customer, with days up to 31 in every month."""
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr(f"'Name,Date of Birth' || chr(10) || {_CELL} || {_DOB}").alias("text"))
    return long_spans(detect(docs), "c_custkey").where("type = 'date'").select("c_custkey", *REPORTED)


_QUOTED = "'\"' || c_name || ', jr\";'"


@query(f"""SELECT c_custkey, length('Name;Student-ID') + 1 + length({_QUOTED}) AS start, length('Name;Student-ID') + 1 + length({_QUOTED}) + 7 AS "end", 'S' || {_SIX} AS value, 'detail' AS type FROM customer""")
def id_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell before the number is quoted and holds a comma."""
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr(f"'Name;Student-ID' || chr(10) || {_QUOTED} || 'S' || {_SIX}").alias("text"))
    return long_spans(detect(docs), "c_custkey").where("type = 'detail'").select("c_custkey", *REPORTED)


_FAMILY = ", ".join(f"'{x}'" for x in SEED_FAMILY)


@query(f"""WITH f AS (SELECT c_custkey, [{_FAMILY}][1 + c_custkey % {len(SEED_FAMILY)}] AS low FROM customer),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(low) ELSE upper(low[1]) || low[2:] END AS value, low FROM f)
SELECT c_custkey, 12 AS start, (12 + length(value))::INTEGER AS "end", value, 'name' AS type, 'list' AS layer, 0.69::DOUBLE AS confidence FROM n WHERE length(low) >= 4""")
def family_names_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family name by itself counts from four letters on; `ito` does not."""
    low = F.get(F.array(*map(F.lit, SEED_FAMILY)), (F.col("c_custkey") % len(SEED_FAMILY)).cast("int"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper(low)).otherwise(F.initcap(low))
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("we saw that "), name, F.lit(" had left")).alias("text"))
    return long_spans(detect(docs, lists=NameLists(family=SEED_FAMILY), columns=False), "c_custkey").where("type = 'name'")


_LIST = f"'Klas 3' || {_LF} || 'Achternaam;Tussenvoegsel;Voornaam' || {_LF} || '\"Vries; ' || {_K} || '\";de;Zoë' || {_LF} || {_LF} || c_name || ';;\"A \"\"B\"\"\"' || {_LF} || c_name || ';;\"A \"\"B\"\"\"'"


@query(f"""SELECT c_custkey, 'Zoë' AS first, 'de Vries; ' || {_K} AS last, NULL::VARCHAR AS error FROM customer
UNION ALL SELECT c_custkey, 'A "B"', c_name, NULL FROM customer""")
def name_list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with a title row, a header in another order, prefixes, quoted cells, empty and repeated rows."""
    return name_records(dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr(_LIST).alias("text")), "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_name || ' é漢😀' END AS text FROM customer""")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 with and without its mark, UTF-16 of both orders, and bytes that are neither."""
    k, text = F.col("c_custkey"), F.concat("c_name", F.lit(" é漢😀"))
    mark = lambda x: F.unhex(F.lit(x))
    utf16 = F.when(k % 8 < 4, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).otherwise(F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
    content = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8"))).when(k % 4 == 2, utf16).otherwise(F.concat(F.encode(text, "UTF-8"), mark("C328")))
    return table(spark, sf_dir, "customer").select("c_custkey", decode_plain(content).alias("text"))


@query("""SELECT n_regionkey, string_agg(n_nationkey || ';' || n_name || chr(10), '' ORDER BY n_nationkey) AS text, NULL::VARCHAR AS error_code FROM nation GROUP BY n_regionkey""")
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file for each region, written by Spark and read as a source; the line with the file's name is left out."""
    path = f"{shared_dir(spark)}/veilwork/files-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat_ws(";", "n_nationkey", "n_name").alias("value"))
    lines.repartition(5, "n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    rows = read_files(spark, path).where("path like '%.txt'")
    return rows.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"), F.regexp_replace("text", "^File name: [^\n]*\n\n", "").alias("text"), "error_code")


_SAID = "'mail a' || c_custkey || '@b.de or 10.0.0.' || (c_custkey % 250) || ', ask Bo Smit'"


@query(f"""WITH t AS (SELECT c_custkey, 'a' || c_custkey || '@b.de' AS mail, '10.0.0.' || (c_custkey % 250) AS ip FROM customer)
SELECT c_custkey, 'Personal details were taken out of the text below and [REMOVED] stands in their place. Do not guess what was removed.' || chr(10) || chr(10) || 'REQUEST' || chr(10) || 'Sum it up' || chr(10) || chr(10) || 'TEXT' || chr(10)
  || 'mail ' || CASE WHEN c_custkey % 3 = 1 THEN mail ELSE '[REMOVED]' END || ' or ' || CASE WHEN c_custkey % 3 = 2 THEN ip ELSE '[REMOVED]' END || ', ask ' || CASE WHEN c_custkey % 2 = 0 THEN '[REMOVED]' ELSE 'Bo Smit' END AS prompt FROM t""")
def reviewed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions reject the address of every third customer and the number of another third; every other customer has a manual term."""
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", request_text(F.lit(" Sum it up "), F.expr(_SAID.replace("c_custkey ||", "CAST(c_custkey AS STRING) ||").replace("(c_custkey % 250)", "CAST(c_custkey % 250 AS STRING)"))).alias("text"))
    spans = long_spans(docs, "c_custkey", spans=regex_candidates(F.col("text"), ["email", "ipv4"]))
    away = F.when(F.col("type") == "email", F.col("c_custkey") % 3 == 1).otherwise(F.col("c_custkey") % 3 == 2)
    decisions = spans.select("c_custkey", "start", "end", (~away).alias("confirmed")).where("not confirmed or c_custkey % 5 = 0")
    terms = docs.where("c_custkey % 2 = 0").select("c_custkey", F.lit("bo SMIT ").alias("term"), F.lit("name").alias("type"))
    rows = reviewed(docs, spans, decisions, terms, "c_custkey")
    return rows.select("c_custkey", prompt(redact(F.col("text"), F.col("confirmed")), "remove").alias("prompt"))


_REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
#: Small office packages by extension: part -> XML, with {0} for a name.
PACKAGES = {
    "docx": {
        "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Dear {0}</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>',
        "word/_rels/document.xml.rels": _REL.format('<Relationship Id="a" Type="http://x/comments" Target="comments.xml"/>'),
        "word/comments.xml": '<w:comments xmlns:w="w"><w:comment w:author="Jo"><w:p><w:t>Note</w:t></w:p></w:comment></w:comments>',
    },
    "xlsx": {
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" state="hidden" r:id="q"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": _REL.format('<Relationship Id="q" Type="http://x/worksheet" Target="/xl/s1.xml"/>'),
        "xl/s1.xml": '<s xmlns="x"><row><c t="s"><v>0</v></c><c s="1"><v>40251</v></c><c t="inlineStr"><is><t>{0}</t></is></c><c><f>A1+1</f><v>3</v></c></row></s>',
        "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>",
        "xl/styles.xml": '<st><numFmts/><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></st>',
    },
    "pptx": {
        "ppt/presentation.xml": '<p xmlns:r="r"><sldId r:id="2"/><sldId r:id="1"/></p>',
        "ppt/_rels/presentation.xml.rels": _REL.format('<Relationship Id="1" Type="http://x/slide" Target="slides/a.xml"/><Relationship Id="2" Type="http://x/slide" Target="slides/b.xml"/>'),
        "ppt/slides/a.xml": '<p:sld xmlns:p="p" xmlns:a="a" show="0"><a:p><a:t>{0}</a:t></a:p></p:sld>',
        "ppt/slides/b.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>second</a:t></a:p></p:sld>',
    },
    "ods": {"content.xml": '<o xmlns:t="t" xmlns:x="x"><t:body><t:spreadsheet><t:table t:name="T"><t:table-row x:number-rows-repeated="9"><t:table-cell><t:p>a<t:s t:c="3"/>{0}</t:p></t:table-cell></t:table-row></t:table></t:spreadsheet></t:body></o>'},
}


def _package(kind: str, name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, body in PACKAGES.get(kind, {}).items():
            z.writestr(part, body.replace("{0}", name))
    return out.getvalue() if kind in PACKAGES else b"not a package"


_LF2 = "chr(10) || chr(10)"


@query(f"""WITH n AS (SELECT c_custkey, c_name, ['docx', 'xlsx', 'pptx', 'ods', 'odt', 'exe'][1 + c_custkey % 6] AS kind FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN 'File name: "f' || c_custkey || '.' || kind || '"' || {_LF2} || CASE kind
    WHEN 'docx' THEN '[document]' || chr(10) || 'Dear ' || c_name || chr(9) || 'x' || {_LF2} || '[word/comments.xml]' || chr(10) || 'Jo' || chr(10) || 'Note'
    WHEN 'xlsx' THEN '[sheet S hidden]' || chr(10) || 'shared' || chr(9) || '2010-03-14' || chr(9) || c_name || chr(9) || '3 [Formula: A1+1]'
    WHEN 'pptx' THEN '[slide 1]' || chr(10) || 'second' || {_LF2} || '[slide 2 hidden]' || chr(10) || c_name
    ELSE '[table T]' || chr(10) || 'a   ' || c_name END END AS text,
  [1, 0, 0, 0, 0, 0][1 + c_custkey % 6] AS comments, [0, 0, 2, 0, 0, 0][1 + c_custkey % 6] AS slides, [0, 1, 1, 0, 0, 0][1 + c_custkey % 6] AS hidden,
  ['import_document', 'import_spreadsheet', 'import_slides', 'import_repeated,import_spreadsheet', '', ''][1 + c_custkey % 6] AS warnings,
  CASE c_custkey % 6 WHEN 4 THEN 'file_archive' WHEN 5 THEN 'file_unsupported' END AS error_code FROM n""")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of one of four kinds for each customer, a broken one and a file of another kind."""
    pack = F.udf(_package, "binary")  # makes the fixture; what is queried runs on its bytes
    kind = F.get(F.array(*map(F.lit, (*PACKAGES, "odt", "exe"))), (F.col("c_custkey") % 6).cast("int"))
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", kind.alias("kind"), pack(kind, F.col("c_name")).alias("content"))
    files = rows.select(F.concat(F.lit("/in/f"), F.col("c_custkey").cast("string"), F.lit("."), "kind").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    found = extract_files(files)
    return found.select(F.regexp_extract("path", "/f([0-9]+)", 1).cast("long").alias("c_custkey"), "text", "counts.comments", "counts.slides", "counts.hidden", F.array_join("warnings", ",").alias("warnings"), "error_code")


@query("""SELECT c_custkey, 'mail [REMOVED], or not' AS redacted FROM customer""")
def streamed_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, redacted by a stream into another folder."""
    path = f"{shared_dir(spark)}/veilwork/stream-{uuid.uuid4().hex}"
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("mail a"), F.col("c_custkey").cast("string"), F.lit("@b.de, or not")).alias("text"))
    docs.write.parquet(f"{path}/in")
    redact_folder(spark, "c_custkey long, text string", f"{path}/in", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("""WITH k AS (SELECT c_custkey, c_custkey % 3 + 1 AS taken FROM customer)
SELECT c_custkey, 'a' || c_custkey || '@b.de' AS original, '[[EMAIL_00' || CASE WHEN taken = 1 THEN 2 ELSE 1 END || ']]' AS pseudonym FROM k
UNION ALL SELECT c_custkey, 'c' || c_custkey || '@b.de', '[[EMAIL_00' || CASE WHEN taken = 3 THEN 2 ELSE 3 END || ']]' FROM k""")
def reserved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text holds what looks like one of the codes; its number is left out."""
    k = F.col("c_custkey").cast("string")
    docs = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(F.lit("[[email_00"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("]] a"), k, F.lit("@b.de c"), k, F.lit("@b.de")).alias("text"))
    codes = docs.select("c_custkey", F.explode_outer(code_table(F.col("text"), regex_candidates(F.col("text"), ["email"]))).alias("c"))
    return codes.select("c_custkey", "c.original", "c.pseudonym")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'iban' ELSE 'detail' END AS type FROM events""")
def normal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that are none of the known ones, and null, count as details."""
    kind = F.get(F.array(F.lit("email"), F.lit("iban"), F.lit("Email "), F.lit(None).cast("string")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", known_type(kind).alias("type"))
