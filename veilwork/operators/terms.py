"""Places of many terms in many texts, by automata: linear in the text, however many the terms.

The terms of a text become an Aho-Corasick automaton over folded code points. Folding maps each code point to one code
point (simple case folding), so a place in the folded text is the same place in the text itself: `İ`, whose lower case
is two code points, stands for itself, and `ẞ` meets `ß`. Documents with the same terms share an automaton.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<start:int,end:int,n:int>>"


@functools.lru_cache(maxsize=200_000)
def fold_letter(c: str) -> str:
    """Simple case folding: one code point for one code point."""
    folded = c.casefold()
    return folded if len(folded) == 1 else low if len(low := c.lower()) == 1 else c


def fold_each(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(fold_letter, text))


@functools.lru_cache(maxsize=64)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for n, term in enumerate(terms):
        if term:
            made.add_word(term, (*made.get(term, ()), n))
    made.make_automaton()
    return made


def places(text: str, terms: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the term): for each term by itself, its places from left to right that do not overlap."""
    if not any(terms) or not text:
        return
    reach = [0] * len(terms)
    for last, found in automaton(terms).iter(text):
        for n in found:
            start = last + 1 - len(terms[n])
            if start >= reach[n]:
                reach[n] = last + 1
                yield start, last + 1, n


def term_places(text: Column, terms: Column, fold: bool = True) -> Column:
    """array<struct<start, end, n>>: where the terms (an array of strings) stand in the text, in any case if `fold`; n is a term's index from 0."""

    @F.pandas_udf(PLACES)
    def found(texts: pd.Series, lists: pd.Series) -> pd.Series:
        way = fold_each if fold else str
        out = []
        for body, own in zip(texts, lists, strict=True):
            own = tuple(way(t or "") for t in own) if own is not None else ()
            out.append([{"start": a, "end": b, "n": n} for a, b, n in places(way(body or ""), own)])
        return pd.Series(out, dtype=object)

    return found(text, terms)
