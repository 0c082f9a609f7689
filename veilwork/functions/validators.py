"""Validity of matched values and right-trimming, as column expressions usable inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import WS, bound

# Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18, "DO": 28, "EE": 20,
    "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20,
    "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27, "MU": 30, "MD": 24, "MC": 27, "ME": 22, "NL": 18, "NO": 15,
    "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SM": 27, "SA": 24, "RS": 22, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TN": 24, "TR": 26,
    "AE": 23, "GB": 22, "VG": 24,
}
# Month names and abbreviations, English and Dutch.
MONTHS = {
    "january": 1, "jan": 1, "januari": 1, "february": 2, "feb": 2, "februari": 2, "march": 3, "mar": 3, "maart": 3, "april": 4, "apr": 4, "may": 5, "mei": 5,
    "june": 6, "jun": 6, "juni": 6, "july": 7, "jul": 7, "juli": 7, "august": 8, "aug": 8, "augustus": 8, "september": 9, "sept": 9, "sep": 9,
    "october": 10, "oct": 10, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}


def _lookup(key: Column, table: dict) -> Column:
    out = F.lit(None).cast("int")
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    for v, keys in by_value.items():
        out = F.when(key.isin(keys), v).otherwise(out)
    return out


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def has_digit(value: Column) -> Column:
    return value.rlike("[0-9]")


def real_date(day: Column, month: Column, year: Column) -> Column:
    """A calendar day of the years 1000 to 2999."""
    fits = year.between(1000, 2999) & month.between(1, 12) & (day >= 1)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    most = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return fits & (day <= most)


def _parts(value: Column) -> Column:
    """The three numbers of a date."""
    return bound(F.split(value, "[/.-]"), lambda p: F.struct(*(F.get(p, F.lit(k)).try_cast("int").alias("abc"[k]) for k in range(3))))


def valid_numeric_date(value: Column) -> Column:
    """Year first, or day and month in either order; four-digit years."""
    return bound(_parts(value), lambda p: F.when(value.rlike("^[0-9]{4}[/.-]"), real_date(p["c"], p["b"], p["a"])).otherwise(real_date(p["a"], p["b"], p["c"]) | real_date(p["b"], p["a"], p["c"])))


def valid_birth_date(value: Column) -> Column:
    """As a numeric date; a two-digit year up to 49 is of this century."""
    short = F.length(F.regexp_extract(value, "[/.-]([0-9]{2}|[0-9]{4})$", 1))  # digits of a year that comes last

    def judged(p: Column) -> Column:
        c = p["c"]
        year = F.when(p["n"] == 2, F.when(c <= 49, c + 2000).otherwise(c + 1900)).otherwise(c)
        last = bound(year, lambda y: real_date(p["a"], p["b"], y) | real_date(p["b"], p["a"], y))
        return F.when(value.rlike("^[0-9]{4}[/.-]"), real_date(c, p["b"], p["a"])).when(p["n"] > 0, last).otherwise(F.lit(False))

    return bound(bound(_parts(value), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["c"].alias("c"), short.alias("n"))), judged)


def _month(word: Column) -> Column:
    return _lookup(F.lower(word), MONTHS)


def _dated(value: Column, shape: str, day: int, month: int) -> Column:
    parts = F.struct(F.regexp_extract(value, shape, day).try_cast("int").alias("d"), _month(F.regexp_extract(value, shape, month)).alias("m"), F.regexp_extract(value, shape, 3).try_cast("int").alias("y"))
    return bound(parts, lambda p: real_date(p["d"], p["m"], p["y"]))


def valid_day_month(value: Column) -> Column:
    shape = rf"(?iu)^([0-9]{{1,2}})(?:st|nd|rd|th)?{WS}+([^\s,.]+)\.?{WS}*,?{WS}*([0-9]{{4}})$"
    return _dated(value, shape, 1, 2)


def valid_month_day(value: Column) -> Column:
    shape = rf"(?iu)^([^\s,.]+)\.?{WS}+([0-9]{{1,2}})(?:st|nd|rd|th)?{WS}*,?{WS}*([0-9]{{4}})$"
    return _dated(value, shape, 2, 1)


def valid_bsn(value: Column) -> Column:
    """Eight or nine digits, not all zero, whose weighted sum is a multiple of eleven."""
    nine = F.lpad(digits(value), 9, "0")
    digit = lambda k: F.substring(nine, k, 1).try_cast("int")
    total = sum((digit(k) * (10 - k) for k in range(1, 9)), F.lit(0)) - digit(9)
    return F.length(digits(value)).isin(8, 9) & (nine != "000000000") & (total % 11 == 0)


def valid_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda p: p.try_cast("int") <= 255)


def valid_ipv6(value: Column) -> Column:
    """Hexadecimal groups: eight, or fewer around one `::`."""
    doubles = F.regexp_count(value, F.lit("(?=::)"))
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    count, short = F.size(groups), F.regexp_count(value, F.lit("::")) == 1
    clean = F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    whole = ~value.startswith(":") & ~value.endswith(":")
    tail = (value.rlike("^(?:::|[^:])") & value.rlike("(?:::|[^:])$")) & (doubles == 1)
    return value.contains(":") & clean & F.when(short, tail & (count < 8)).otherwise(whole & (count == 8) & (F.regexp_count(value, F.lit("::")) == 0))


def iban_trim(value: Column) -> Column:
    """Cut after as many letters and digits as the country's IBANs have; a shorter or foreign value stays."""
    size = _lookup(F.upper(F.substring(value, 1, 2)), IBAN_LENGTHS)
    cut = F.regexp_substr(value, F.concat(F.lit("^(?:[^A-Za-z0-9]*[A-Za-z0-9]){"), F.coalesce(size, F.lit(1)).cast("string"), F.lit("}")))
    return F.when(size.isNull(), value).otherwise(F.coalesce(cut, value))


def valid_iban(value: Column) -> Column:
    compact = F.upper(F.regexp_replace(value, WS, ""))
    return compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & _lookup(F.substring(compact, 1, 2), IBAN_LENGTHS).isNotNull()


def clean_url(value: Column) -> Column:
    """Without closing punctuation, then without closing brackets that nothing opens."""
    out = F.regexp_replace(value, "[.,;:!?]+$", "")
    for open_, close in ("()", "[]", "{}"):
        out = bound(out, _unclosed(open_, close))
    return out


def _unclosed(open_: str, close: str) -> Callable[[Column], Column]:
    def cut(value: Column) -> Column:
        run = F.length(F.regexp_extract(value, "\\" + close + "*$", 0))
        count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
        extra = F.greatest(F.lit(0), F.least(run, count(close) - count(open_)))
        return F.substring(value, F.lit(1), F.length(value) - extra)

    return cut


def phone_trim(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?:{WS}|[.,;:])+$", "")


def valid_phone(value: Column) -> Column:
    n = F.length(digits(value))
    bare = ~F.trim(value).startswith("+") & ~value.rlike(rf"{WS}|[().-]")
    return n.between(9, 15) & ~(bare & (n < 10))


def valid_nanp(value: Column) -> Column:
    return F.length(digits(value)) == 10


def valid_code(value: Column) -> Column:
    return value.rlike("(?i)^[A-Z0-9][A-Z0-9/_-]{3,19}$") & has_digit(value)
