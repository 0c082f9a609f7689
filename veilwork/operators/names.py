"""Names from a lexicon and from supplied lists.

The lists are bounded inputs (checked), so they travel to the workers and texts stay in place; joining
every word with a lexicon table would shuffle or explode the whole corpus instead. The seed lexicon
is a small sample: recall on names depends on the lexicon that the caller supplies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textops import key_text
from ..sources.delimited import check_names
from .columns import KIND

#: Most entries of a lexicon that is sent to workers; beyond it, split the lexicon and union the candidates.
MOST_ENTRIES = 500_000
MOST_WORDS = 32

# Particles inside names, and words that are no name by themselves.
PARTICLES = frozenset("al el bin bint da das de del della der des di dos du la le van von den ten ter y".split())
STOP_WORDS = frozenset((
    "a an and are as at be but by can could did do does for from had has have he her hers him his i if in into is it its may might must my no nor not of on or our ours she "
    "should so than that the their theirs them then there these they this those to us was we were what when where which who why will with would you your yours dear hello hi "
    "regards thanks thank monday tuesday wednesday thursday friday saturday sunday maandag dinsdag woensdag donderdag vrijdag zaterdag zondag january february march april may june "
    "july august september october november december januari februari maart mei juni juli augustus oktober today tomorrow yesterday morning afternoon evening school college "
    "university office department class teacher student principal doctor professor mr mrs ms miss dr sir madam team group company committee board amsterdam rotterdam utrecht "
    "eindhoven groningen hague netherlands nederland europe european english dutch french german street road avenue lane drive square park station hospital library room building "
    "north south east west new old young black white brown green gray grey orange rose violet summer winter autumn spring mark bill grant hope faith joy home page contact subject "
    "date name email phone address website information message document file meeting report"
).split())

SEED_GIVEN = "anna ben clara daan emma fatima george hanna ivan julia kofi lena maria noah olga pedro quinn rosa sam tess uma victor wei yara zoe".split()
SEED_FAMILY = "abbott bakker chen dijkstra evans fischer garcia hughes ito jansen kaya lopez meyer nguyen okafor patel rossi smit tanaka vries williams yilmaz".split()

_WORD = regex.compile(r"\p{L}(?:[\p{L}\p{M}]|['’-](?=\p{L}))*+")
_GAP = regex.compile(r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF,'’-]+")
_UPPER, _LETTERS = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class NameLists:
    """given and family: lexicon names; custom: (first, last) records that win over the lexicon's caution."""

    given: Iterable[str] = ()
    family: Iterable[str] = ()
    custom: Iterable[tuple[str, str]] = ()
    stop: frozenset[str] = STOP_WORDS
    particles: frozenset[str] = field(default=PARTICLES)

    @classmethod
    def from_table(cls, names: DataFrame, custom: Iterable[tuple[str, str]] = ()) -> NameLists:
        """names (name, kind: `given` or `family`), of at most MOST_ENTRIES rows; rows of other kinds and nulls are left out."""
        rows = names.where("name is not null and kind in ('given', 'family')").select("name", "kind").distinct().limit(MOST_ENTRIES + 1).collect()
        return cls([r[0] for r in rows if r[1] == "given"], [r[0] for r in rows if r[1] == "family"], custom)

    def __post_init__(self) -> None:
        keys = lambda names: frozenset(k for k in map(key_text, names) if k)
        object.__setattr__(self, "given", keys(self.given))
        object.__setattr__(self, "family", keys(self.family))
        object.__setattr__(self, "custom", tuple((a or "", b or "") for a, b in self.custom))
        if len(self.given) + len(self.family) > MOST_ENTRIES:
            raise ValueError(f"a lexicon of more than {MOST_ENTRIES} entries: split it")
        check_names([*self.custom])


def words(text: str) -> list[tuple[str, str, int, int]]:
    """(word, key, start, end) of a text's words."""
    return [(m[0], key_text(m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]


def name_cased(word: str) -> bool:
    return bool(_UPPER.match(word)) or (bool(_LETTERS.fullmatch(word)) and word == word.upper())


class Finder:
    """Candidates of one set of lists."""

    def __init__(self, lists: NameLists) -> None:
        self.lists = lists
        self.patterns: dict[tuple[str, ...], float] = {}
        self.compact: set[str] = set()
        for first, last in lists.custom:
            a, b = (tuple(w[1] for w in words(x) if w[1]) for x in (first, last))
            offers = [(a + b, 0.995), (b + a, 0.985)] if a and b else [(a + b, 0.995)]
            for parts, confidence in [*offers, (a, 0.96), (b, 0.96)]:
                if parts:
                    self.patterns.setdefault(parts, confidence)
            if a and b:
                self.compact |= {"".join(a + b), "".join(b + a)}
        self.lengths = sorted({len(p) for p in self.patterns if len(p) <= MOST_WORDS})

    def candidates(self, text: str) -> Iterator[dict]:
        found = words(text)
        n = len(found)
        joins = [i + 1 < n and bool(_GAP.fullmatch(text, found[i][3], found[i + 1][2])) for i in range(n)]
        yield from self._custom(text, found, joins)
        yield from self._lexicon(text, found, joins)

    @staticmethod
    def _span(text: str, start: int, end: int, layer: str, confidence: float, priority: int, seq: int) -> dict:
        return {"start": start, "end": end, "value": text[start:end], "type": "name", "layer": layer, "confidence": confidence, "priority": priority, "rule_seq": seq}

    def _custom(self, text: str, found: list, joins: list[bool]) -> Iterator[dict]:
        keys = [w[1] for w in found]
        reach = [0] * (len(found) + 1)  # words from here on that are joined without a break
        for i in range(len(found) - 1, -1, -1):
            reach[i] = 1 + (reach[i + 1] if joins[i] else 0)
        for i in range(len(found)):
            for k in self.lengths:
                confidence = self.patterns.get(tuple(keys[i : i + k])) if k <= reach[i] else None
                if confidence:
                    yield self._span(text, found[i][2], found[i + k - 1][3], "custom", confidence, 80, 35)
        for _, key, start, end in found:
            if key in self.compact:
                yield self._span(text, start, end, "custom", 0.99, 80, 36)

    def _lexicon(self, text: str, found: list, joins: list[bool]) -> Iterator[dict]:
        given, family, stop, particles = self.lists.given, self.lists.family, self.lists.stop, self.lists.particles
        if not given and not family:
            return
        for i, (value, key, start, end) in enumerate(found):
            if key in given and name_cased(value):
                best = 0
                for j in range(i + 1, min(len(found), i + 4)):
                    if not joins[j - 1]:
                        break
                    other, k = found[j][0], found[j][1]
                    if k in particles:
                        continue
                    if not name_cased(other) or not (k in given or k in family):
                        break
                    if k in family:
                        best = j
                if best:
                    yield self._span(text, start, found[best][3], "list", 0.94, 70, 37)
                elif len(key) >= 3 and key not in stop:
                    yield self._span(text, start, end, "list", 0.76, 60, 37)
            if key in family and key not in stop and name_cased(value):
                if joins[i] and found[i + 1][1] in given and found[i + 1][1] not in stop and name_cased(found[i + 1][0]):
                    yield self._span(text, start, found[i + 1][3], "list", 0.91, 70, 38)
                if key not in given and len(key) >= 4:
                    yield self._span(text, start, end, "list", 0.69, 60, 39)


def name_candidates(text: Column, lists: NameLists) -> Column:
    """Candidate spans of the lexicon and list rules, in Arrow batches."""
    made: list[Finder] = []

    @F.pandas_udf(KIND)
    def found(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Finder(lists))
        return pd.Series([list(made[0].candidates(t or "")) for t in texts], dtype=object)

    return found(text)
