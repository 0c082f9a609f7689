"""The registry of detection rules: data, in the order that breaks ties.

A rule's pattern, type and confidence are fixed values. `group`: the value is that group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.textops import BLANKS, EDGE, LINE, LINE_END, WS
from ..operators.matching import matches, none_found

TYPES = ("name", "email", "phone", "iban", "bsn", "postcode", "date", "ip", "url", "address", "detail", "filename")
# Ranks for exact ties.
PRIORITY = {"filename": 125, "detail": 121, "email": 120, "url": 115, "iban": 110, "phone": 108, "date": 105, "ip": 104, "postcode": 103, "bsn": 102, "address": 95}
CUSTOM_PRIORITY, PAIR_PRIORITY, SINGLE_PRIORITY = 80, 70, 60
SPANS = "array<struct<start:int,end:int,value:string,type:string,layer:string,confidence:double,priority:int,rule_seq:int>>"


@dataclass(frozen=True)
class Rule:
    seq: int
    name: str
    type: str
    confidence: float
    pattern: str
    group: int = 0
    test: Callable[[Column], Column] | None = None
    trim: Callable[[Column], Column] | None = None
    guard: str = ""  # a cheaper pattern that every hit contains
    needs: str = "digit"  # what any text with a hit contains, see NEEDS


# Patterns and their parts.
EXTENSION = "(?:pdf|docx?|xlsx?|csv|txt|pptx?|odt|ods|rtf|jpe?g|png|zip)"
ROOT = rf"(?<![\p{{L}}\p{{N}}:/\\])(?:[A-Z]:[\\/]|\\\\[^\\/{BLANKS}<>\"']+[\\/]|/(?:Users|home|Volumes|tmp|var|mnt|media)/)"
LOCAL = r"[\p{L}\p{N}\p{M}.!#$%&'*+/=?^_`{|}~\-\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}\-\x{200B}-\x{200D}\x{2060}\x{FEFF}]{0,61}[\p{L}\p{N}\p{M}])?"
MONTH = "(?:" + "|".join(sorted(v.MONTHS, key=len, reverse=True)) + ")"
HOUSE = rf"\d{{1,5}}(?:{WS}?[A-Z]|{WS}?(?:bis|hs|zwart|rood))?(?:[-/]{WS}?[A-Z0-9]+)?(?:{WS}?(?:bis|hs|zwart|rood|I{{1,4}}))?"
STREETS = (
    "street st road rd avenue ave lane ln drive dr boulevard blvd court ct place pl way square terrace highway close crescent straat laan weg plein gracht kade dijk "
    "singel hof allee platz strasse straße rue chemin avenida calle carrer via viale piazza ulica ul prospekt sokak cadde mahala"
).split()
DOTTED = "st rd ave ln dr blvd ct pl ul".split()
STREET = "(?i:" + "|".join(t + (r"\.?" if t in DOTTED else "") for t in STREETS) + ")"
PART = r"\p{L}[\p{L}\p{M}'\x{2019}.-]*"
COMPOUND = "(?:straat|laan|weg|plein|gracht|kade|dijk|singel|hof)"
SEP = r"([/.-])"
GAP = rf"[{BLANKS}().-]*"
CODE = rf"([A-Z0-9][A-Z0-9/_-]{{3,19}}){EDGE}"
LONG_CODE = rf"([A-Z0-9][A-Z0-9/_-]{{3,24}}){EDGE}"

RULES = [
    Rule(1, "filename_label", "filename", 0.99, rf"(?iu)(?:{LINE}|\n)[ \t]*(?:file[ \t]*name|bestandsnaam|dateiname|nom du fichier|nombre del archivo)[ \t]*:[ \t]*([^\r\n]{{1,500}})", 1, guard=r"(?iu)(?:name|archivo|fichier|bestandsnaam)[ \t]*:", needs="colon"),
    Rule(2, "filename_line", "filename", 0.95, rf"(?iu)(?:{LINE}|\n)[ \t]*([^\r\n]{{1,250}}\.{EXTENSION})[ \t]*(?=\r?{LINE_END})", 1, needs="extension"),
    Rule(3, "filename_token", "filename", 0.92, rf"(?iu)(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.-]{{0,200}}\.{EXTENSION}{EDGE}", needs="extension"),
    Rule(4, "path_dquote", "filename", 0.98, r'(?iu)"((?:[A-Z]:[\\/]|\\\\|/)[^"\r\n]{1,1000})"', 1, needs="slash"),
    Rule(5, "path_squote", "filename", 0.98, r"(?iu)'((?:[A-Z]:[\\/]|\\\\|/)[^'\r\n]{1,1000})'", 1, needs="slash"),
    Rule(6, "path_ext", "filename", 0.98, rf"(?iu){ROOT}[^<>\"'\r\n]{{1,1000}}?\.{EXTENSION}{EDGE}", guard=rf"(?i)[\\/][^\r\n]*\.{EXTENSION}", needs="extension"),
    Rule(7, "path_bare", "filename", 0.97, rf"(?iu){ROOT}[^{BLANKS}<>\"'\r\n]{{1,1000}}", trim=v.clean_url, needs="slash"),
    Rule(8, "email", "email", 0.99, rf"(?iu)(?<!{LOCAL}){LOCAL}++[@＠]{LABEL}(?:\.{LABEL}(?![\p{{L}}\p{{N}}\p{{M}}\-]))++", needs="at"),
    Rule(9, "url", "url", 0.98, rf"(?iu){EDGE}(?:https?://|www\.)[^{BLANKS}<>\"']+", trim=v.clean_url, needs="link"),
    Rule(10, "iban", "iban", 0.99, rf"(?iu){EDGE}[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]){{11,30}}{EDGE}", test=v.valid_iban, trim=v.iban_trim, guard=r"(?i)[A-Z]{2}\d{2}"),
    Rule(11, "date_numeric", "date", 0.98, rf"{EDGE}(?:\d{{1,2}}{SEP}\d{{1,2}}\1\d{{4}}|\d{{4}}{SEP}\d{{1,2}}\2\d{{1,2}}){EDGE}", test=v.valid_numeric_date, guard=r"\d[/.-]\d"),
    Rule(12, "date_dmy_text", "date", 0.98, rf"(?iu){EDGE}\d{{1,2}}(?:st|nd|rd|th)?{WS}+{MONTH}\.?{WS}*,?{WS}*\d{{4}}{EDGE}", test=v.valid_day_month, guard=r"\d{4}"),
    Rule(13, "date_mdy_text", "date", 0.98, rf"(?iu){EDGE}{MONTH}\.?{WS}+\d{{1,2}}(?:st|nd|rd|th)?{WS}*,?{WS}*\d{{4}}{EDGE}", test=v.valid_month_day, guard=r"\d{4}"),
    Rule(14, "date_dob_label", "date", 0.99, rf"(?iu){EDGE}(?:dob|date{WS}+of{WS}+birth|birth{WS}+date|geboortedatum|geboren{WS}+op){WS}*[:=-]?{WS}*(\d{{1,2}}{SEP}\d{{1,2}}\2\d{{2}}(?:\d{{2}})?){EDGE}", 1, test=v.valid_birth_date, guard=r"\d[/.-]\d"),
    Rule(15, "ipv4", "ip", 0.99, r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", test=v.valid_ipv4, guard=r"\d\.\d"),
    Rule(16, "ipv6", "ip", 0.97, r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}(?![0-9a-f:])", test=v.valid_ipv6, guard=":[0-9a-fA-F]{0,4}:", needs="colon"),
    Rule(17, "postcode_nl", "postcode", 0.97, rf"(?iu)(?<![\d/.-]){EDGE}[1-9]\d{{3}}{WS}?[A-Z]{{2}}{EDGE}", guard=r"[1-9]\d{3}"),
    Rule(18, "bsn_label", "bsn", 0.995, rf"(?iu){EDGE}(?:bsn|burgerservicenummer|sofinummer)(?:{WS}+(?:on{WS}+file|is))?{WS}*[:=#-]?{WS}*(\d{{8,9}}){EDGE}", 1, test=v.valid_bsn, guard=r"\d{8}"),
    Rule(21, "addr_num_first", "address", 0.93, rf"{EDGE}{HOUSE}{WS}*,?{WS}+(?:{PART}{WS}+){{1,5}}{STREET}{EDGE}", guard=STREET),
    Rule(22, "addr_term_num", "address", 0.93, rf"{EDGE}(?:[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}][\p{{L}}\p{{M}}'\x{{2019}}.-]*{WS}+){{0,5}}{STREET}{WS}+{HOUSE}{EDGE}", guard=rf"{STREET}{WS}+\d"),
    Rule(23, "addr_nl_compound", "address", 0.94, rf"(?iu){EDGE}{PART}{COMPOUND}{WS}+\d{{1,5}}[A-Z]?(?:-[A-Z0-9]+)?{EDGE}", guard=rf"(?iu){COMPOUND}{WS}+\d"),
    Rule(24, "addr_nl_multi", "address", 0.96, rf"(?iu){EDGE}(?:{PART}{WS}+){{0,5}}{PART}{COMPOUND}{WS}+{HOUSE}{EDGE}", guard=rf"(?iu){COMPOUND}{WS}+\d"),
    Rule(25, "addr_nl_prefix", "address", 0.96, rf"(?iu){EDGE}(?:laan|plein|hof|singel|kade|dijk|gracht){WS}+(?:{PART}{WS}+){{1,5}}{HOUSE}{EDGE}", guard=rf"(?iu)(?:laan|plein|hof|singel|kade|dijk|gracht){WS}"),
    Rule(26, "addr_label", "address", 0.99, rf"(?iu)(?:{LINE}|\n)[ \t]*(?:address|adres|adresse|direcci[oó]n){WS}*:{WS}*([^\r\n]{{5,200}})", 1, test=v.has_digit, guard="(?iu)(?:adres|address|direcc)"),
    Rule(27, "home_addr_label", "detail", 0.99, rf"(?iu)(?:{LINE}|\n)[ \t]*(?:(?:home|postal|mailing|residential){WS}+address|woonadres|postadres|huisadres){WS}*:{WS}*([^\r\n]{{5,200}})", 1, test=v.has_digit, guard="(?iu)(?:adres|address)"),
    Rule(28, "phone_intl", "phone", 0.91, rf"(?:\+{WS}?\d{{1,3}}(?:{GAP}\d){{6,13}}|{EDGE}00\d{{1,3}}(?:{GAP}\d){{6,13}}|{EDGE}0[1-9](?:{GAP}\d){{8,13}})(?!\d)", test=v.valid_phone, trim=v.phone_trim, guard=r"[+0]"),
    Rule(29, "phone_nanp", "phone", 0.93, r"(?<!\d)(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)", test=v.valid_nanp, guard=r"\d{3}[ .-]\d{4}"),
    Rule(30, "id_student", "detail", 0.98, rf"(?iu){EDGE}(?:student|pupil|learner){WS}*(?:id|number|no\.?|nr\.?){WS}*[:=#-]?{WS}*{CODE}", 1, test=v.has_digit, guard="(?iu)(?:student|pupil|learner)"),
    Rule(31, "id_student_nl", "detail", 0.98, rf"(?iu){EDGE}(?:leerlingnummer|leerlingnr\.?|studentnummer|studentnr\.?|stamnummer){WS}*[:=#-]?{WS}*{CODE}", 1, test=v.has_digit, guard="(?iu)(?:nummer|nr)"),
    Rule(32, "id_staff", "detail", 0.98, rf"(?iu){EDGE}(?:staff|employee|personnel|payroll|passport|national{WS}+id){WS}*(?:id|number|no\.?|nr\.?)?{WS}*[:=#-]{WS}*{LONG_CODE}", 1, test=v.has_digit, guard="(?iu)(?:staff|employee|personnel|payroll|passport|national)"),
    Rule(33, "id_staff_nl", "detail", 0.98, rf"(?iu){EDGE}(?:personeelsnummer|medewerkernummer|paspoortnummer){WS}*[:=#-]?{WS}*{LONG_CODE}", 1, test=v.has_digit, guard="(?iu)nummer"),
]
BY_NAME = {r.name: r for r in RULES}

#: Tests that are made once for all the rules that name them; most texts fail most of them.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "digit": lambda text: text.rlike("[0-9]"),
    "colon": lambda text: text.contains(":"),
    "slash": lambda text: text.contains("/") | text.contains("\\"),
    "extension": lambda text: text.contains(".") & text.rlike(rf"(?i)\.{EXTENSION}"),
    "at": lambda text: text.contains("@") | text.contains("＠"),
    "link": lambda text: text.contains("://") | text.rlike(r"[wW]{3}\."),
}


def rule_spans(text: Column, rule: Rule) -> Column:
    """Candidate spans of one rule, with its type, confidence, priority and place in the order."""
    found = matches(text, rule.pattern, rule.group, rule.trim, rule.test, text.rlike(rule.guard) if rule.guard else None)
    kind = [F.lit(rule.type).alias("type"), F.lit("regex").alias("layer"), F.lit(rule.confidence).alias("confidence"), F.lit(PRIORITY[rule.type]).alias("priority"), F.lit(rule.seq).alias("rule_seq")]
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *kind))


def regex_candidates(text: Column, names: list[str] | None = None) -> Column:
    """Candidate spans of the rules (all, or the named ones)."""
    chosen = [BY_NAME[n] for n in names] if names else RULES
    parts = []
    for need, test in NEEDS.items():
        own = [r for r in chosen if r.needs == need]
        if own:
            parts.append(F.when(test(text), F.concat(none_found(SPANS), *(rule_spans(text, r) for r in own))).otherwise(none_found(SPANS)))
    return F.concat(*parts)
