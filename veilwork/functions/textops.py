"""Text functions as column expressions: folding, name keys, words, and regular-expression fragments.

Java's `\\b`, `\\s`, `^` and `$` differ from the browser's, so patterns are written with the fragments
below. Offsets are 0-based, half-open and count code points.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters and anything else.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: A line's first place: after LF, CR, U+2028 or U+2029.
LINE = r"(?:^|(?<=[\n\r\x{2028}\x{2029}]))"
#: A line's last place.
LINE_END = r"(?=[\n\r\x{2028}\x{2029}]|\z)"
#: What counts as white space, for use inside a class, and as a class.
BLANKS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{BLANKS}]"
#: A letter, then letters or marks, joined by an apostrophe or hyphen only before a letter.
WORD = r"\p{L}[\p{L}\p{M}]*+(?:['\x{2019}-]\p{L}[\p{L}\p{M}]*+)*+"

# Letters that have no decomposition but a plain spelling.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŋ": "n", "ħ": "h"}
MARKS = "[\\x{0300}-\\x{036F}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_cuts(text: Column, n: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, size) is that part of the text; n: how often it is about to be called.

    Spark finds a place in a text by counting from its beginning. So the text is held in about sqrt(n) pieces, and a part is
    counted from the beginning of its piece: n parts take sqrt(n) times the text, not n times.
    """
    many = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    width = F.greatest(F.lit(1), F.ceil(F.length(text) / many).cast("int"))

    def pieces(width: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.substring(text, k * width + 1, width))

        def cut(held: Column, start: Column, size: Column) -> Column:
            first = F.floor(start / width).cast("int")
            last = F.floor((start + size) / width).cast("int")
            return F.substring(F.array_join(F.slice(held, first + 1, last - first + 1), ""), (start - first * width + 1).cast("int"), size.cast("int"))

        return bound(own, lambda held: use(lambda start, size: cut(held, start, size)))

    return bound(width, pieces)


@functools.cache
def _plain_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks of U+0300..U+036F, and those characters."""
    made, plain = [], []
    for code in range(0xA0, 0xFB50):
        if 0xAC00 <= code <= 0xD7FF:
            continue
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ"]
        if len(parts) == 1 and parts[0] != chr(code):
            made.append(chr(code))
            plain.append(parts[0])
    return "".join(made), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents: cafÉ -> cafe, Straße -> strasse."""
    out = F.lower(F.regexp_replace(F.translate(text, *_plain_letters()), MARKS, ""))
    single = {k: v for k, v in SPECIAL.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in SPECIAL.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def name_key(text: Column) -> Column:
    """The folded text's letters and digits."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def fold_text(value: str) -> str:
    """`fold` for a Python string."""
    out = "".join(c for c in unicodedata.normalize("NFD", value) if not "̀" <= c <= "ͯ").lower()
    return "".join(SPECIAL.get(c, c) for c in out)


def key_text(value: str) -> str:
    """`name_key` for a Python string."""
    return "".join(c for c in fold_text(value) if c.isalpha() or unicodedata.category(c)[0] in "LN")
