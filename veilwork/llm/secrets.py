"""Secret scanning: candidate strings judged by a random forest.

A candidate is one of these; whatever is no secret is left to the forest.

* Announced: the value after a name that holds a word of ANNOUNCE, LEAST_TOLD bytes or more: between quotes
  all that stands there, else up to a blank, quote, comma, semicolon or ampersand. After blanks alone
  (`Bearer x`, `--password x`) it is the next such stretch.
* Prefixed: a run that has a known start (PREFIX), from that start on.
* By shape: a maximal run of `A-Z a-z 0-9 _ + / . -` of LEAST bytes or more, with one or two `=` after it if
  they are padding, so `key=value` is two runs. What the first two kinds cover is cut out of it.

Text before a run in a PEM private key is the key's first line, so each of its lines is announced. Features:
length, character classes, transitions between classes, letter-pair plausibility, dictionary coverage,
entropy, shape (hexadecimal, UUID, path-like, known start), the path it comes from, and the words beside it: those
within AROUND bytes before and behind. The forest is trained from labelled findings (candidate, words before, words
behind, path, label); `labelled_findings` makes such a table from stated rules with a seed, and a caller may pass its own.

Defined cases: null and empty texts have no candidates; candidates are found in whole texts of any
length; rows are independent, so repeated ids repeat their findings; a null path is empty; an empty table gives no
rows; other columns are ignored; findings carry a digest of the candidate, not the candidate.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import char_counts, sub_batches, table, text_buffers, word_bounds

LEAST, LEAST_TOLD, AROUND = 16, 4, 64
_RUN = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_RUN[list(b"_+/.-")] = True

# Words that make a candidate look like a name, and words that announce a secret or a mere digest.
DICTIONARY = ("account address admin application array assets background build button cache change class client code color common component config content context control copyright create css data database date default delete document domain download element email error event example export false field file filter font format function google group handler header height html http https icon image import index info input interface item javascript key label language layout library license link list load local location login main manager master media menu message method model module name network node null number object office option order package page parameter password path photo plugin point port post private product profile project public query read request resource response result return root sample script search section select server service session setting simple site size source start state static status string style system table target task template test text theme time title token tool true type update upload url user value version video view web width window word your").split()
ANNOUNCE = "secret token password passwd pwd apikey api_key api-key access_key private_key credential auth bearer client_secret passphrase".split() + ["private key"]
HARMLESS = "sha1 sha256 sha512 md5 checksum integrity commit digest etag uuid guid hash revision example placeholder sample version".split()
HARMLESS_PATHS = "test tests example examples fixture fixtures sample docs lock vendor".split()

_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_OTHER = {"auth": "auth(?!or(?!i[sz]))", "secret": "secret(?!ar)", "token": "token(?!i[sz])"}  # author, secretary, tokenizer announce nothing
_TOLD_WORDS = "|".join(_OTHER.get(w, w) for w in sorted((w for w in ANNOUNCE if w != "private key"), key=len, reverse=True))
_NAME = rf"(?:{_TOLD_WORDS})[A-Za-z0-9_.-]*"
_GIVEN = r"""[\"'`]?\]?[ \t]*(?:=>|:=|==?|:)[ \t]*(?:[Bb]earer[ \t]+|[Bb]asic[ \t]+)?"""
_VALUE = rf"""(?:"(?P<d>[^"\r\n]{{{LEAST_TOLD},}})"|'(?P<s>[^'\r\n]{{{LEAST_TOLD},}})'|`(?P<b>[^`\r\n]{{{LEAST_TOLD},}})`|["'`]?(?P<v>[^\s"'`,;&]{{{LEAST_TOLD}}}))"""
#: From the end of a name on; of a stretch without quotes only the first bytes, for `_STRETCH` to go on.
_TOLD = re.compile(rf"(?:{_GIVEN}|[ \t]+){_VALUE}".encode())
_STRETCH = re.compile(rb"""[^\s"'`,;&]*""")
_NAME_RUN = re.compile(rb"[A-Za-z0-9_.-]*")
_TOLD_GUARD = re.compile(f"(?i:{_TOLD_WORDS})".encode())
_TOLD_END = re.compile(rf"(?i:{_NAME}|private key-*)(?P<given>{_GIVEN}|\s+)[\"'`]?$")
_STARTS = "AKIA ASIA AGPA AIDA AROA AIPA ANPA ANVA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ rk_live_ sk_test_ xoxa- xoxb- xoxp- xoxr- xoxs- AIza ya29. eyJ npm_ pypi- dop_v1_ hf_ SG.".split()
PREFIX = re.compile("(?:" + "|".join(map(re.escape, _STARTS)) + r")[A-Za-z0-9_+/.-]{8,}")
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9]){PREFIX.pattern}(?:={{1,2}}(?![A-Za-z0-9_+/.=-]))?".encode())
_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?=((?:(?!-----)[\s\S])*))")
_COMMON_PAIRS = {a + b for w in DICTIONARY for a, b in zip(w, w[1:], strict=False)}


# Values that stand for a secret, or for none.
_CODE = re.compile(r"[(){}\[\]<>$%*]|^(?:os|self|process|env|this|config|request|settings|getpass)\.")
_DUMMIES = set("none null true false undefined string required optional enabled disabled str bytes self empty changed expired invalid missing field input hidden text".split())
_HOLDERS = "your example changeme placeholder dummy redacted sample".split()


def _told(before: str) -> tuple[bool, bool]:
    """Whether the text before ends with a name that announces a secret, and whether a sign of assignment follows it."""
    m = _TOLD_END.search(before)
    return bool(m), bool(m) and any(c in m["given"] for c in "=:")


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = [kinds.count(k) / n for k in "dulo"]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = value.lower()
    letters = [(a, b) for a, b in zip(low, low[1:], strict=False) if a.isalpha() and b.isalpha()]
    plausible = sum(a + b in _COMMON_PAIRS for a, b in letters) / max(1, len(letters))
    covered = [False] * n
    for word in DICTIONARY:
        at = low.find(word) if len(word) > 3 else -1
        while at >= 0:
            covered[at : at + len(word)] = [True] * len(word)
            at = low.find(word, at + 1)
    counts = [low.count(c) / n for c in set(low)]
    entropy = -sum(p * math.log2(p) for p in counts)
    near, behind, where = before.lower(), after.lower(), path.lower()
    return [
        n, *share, turns, plausible, sum(covered) / n, entropy, entropy / math.log2(max(2, n)), bool(_HEX.fullmatch(value)), bool(_UUID.fullmatch(value)),
        value.count("/"), value.count("."), value.count("-") + value.count("_"), len(set(low)) / n,
        any(w in near for w in ANNOUNCE), any(w in near for w in HARMLESS), any(c in before[-4:] for c in "=:"), any(c in before[-2:] for c in "\"'`"),
        any(w in re.split(r"[/._-]", where) for w in HARMLESS_PATHS), "xxxx" in low or "1234567" in low or "abcdef" in low,
        *_told(before), bool(PREFIX.match(value)), bool(_CODE.search(value)), low in _DUMMIES or any(w in low for w in _HOLDERS), any(w == low for w in DICTIONARY), covered[0],
        any(w in behind for w in ANNOUNCE), any(w in behind for w in (*HARMLESS, *_HOLDERS)), after[:1] in ("", " ", "\n", "\r"), after[:1] != "" and after[:1] in "\"'`",
    ]


_PASS = "correct horse battery staple dragon monkey summer winter sunshine purple mountain tiger coffee banana wizard falcon thunder silver shadow orange cherry river ocean forest pepper rocket guitar hunter castle marble velvet copper".split()
_PROSE = "ation ement ially istic inter counter under natural press communi stand over electro psycho logical izing ness able trans form micro photo hydro graph retro ible super onal".split()
_WORDS = "must will should was from with that which been have expires ends and the for were based more than about after policy rotation strength".split()


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before it, text behind it, path, 1 for a secret) rows made by stated rules."""
    r, out = random.Random(seed), []
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(n):
        kind = r.randrange(20)
        path = r.choice(["src/app.py", "config/settings.yml", "src0", "deploy/env", "tests/test_login.py", "docs/guide.md", "web/yarn.lock", "src7"])
        announce = r.choice(ANNOUNCE) + r.choice([' = "', ": ", "=", ' = \'', '": "'])
        harmless = r.choice(HARMLESS) + r.choice([": ", " ", "=", '": "', "-"])
        prose = r.choice(["see the ", "and then ", "in the file ", "of ", "http://example.com/", "open "])
        if kind < 3:
            value, before, y = draw(hexa, r.choice([32, 40, 40, 64])), announce, 1
        elif kind == 3:
            value, before, y = draw(alnum, r.randrange(20, 64)), announce, 1
        elif kind == 4:
            value, before, y = draw(alnum + "+/", r.randrange(30, 60)) + "=", announce, 1
        elif kind == 5:
            value, before, y = r.choice(["AKIA", "ghp_", "sk-", "xoxb-"]) + draw(alnum, r.randrange(16, 40)), r.choice([announce, prose]), 1
        elif kind == 6:
            value, before, y = draw(hexa, r.choice([32, 40, 64])), harmless, 0
        elif kind == 7:
            value, before, y = "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice([harmless, prose, "id: "]), 0
        elif kind == 8:
            value, before, y = r.choice("_-./").join(r.choice(DICTIONARY) for _ in range(r.randrange(3, 7))) + draw("0123456789", r.randrange(2, 9)), r.choice([prose, announce]), 0
        elif kind == 10:
            value, before, y = "".join(w.title() if r.random() < 0.2 else w for w in r.sample(_PASS, r.randrange(1, 5))) + draw("0123456789!@#$", r.choice([0, 0, 1, 2, 3])), announce, 1
        elif kind == 11:
            value, before, y = "".join(r.choice("aA@4")if c == "a" else r.choice("eE3") if c == "e" else r.choice("sS5$") if c == "s" else c for c in r.choice(_PASS).title() + r.choice([*_PASS, "Secret", "Key", "Pass", "SecretKey", "Login", "Admin"]).title()) + draw("0123456789!?#", r.randrange(0, 4)), announce, 1
        elif kind == 12:
            value, before, y = draw(r.choice([alnum, alnum[:52], alnum[26:52], alnum + "!@#$%^&*+/"]), r.randrange(7, 40)), r.choice([announce, announce, "Authorization: Bearer ", "--password "]), 1
        elif kind == 13:
            value, before, y = r.choice(["AKIA", "ASIA"]) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), r.choice([announce, prose, ""]), 1
        elif kind == 14:
            pem = "-----BEGIN " + r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "CERTIFICATE", "CERTIFICATE", "PUBLIC KEY"]) + "-----\n"
            value, before, y = draw(alnum + "+/", r.choice([64, 64, 64, r.randrange(16, 64)])) + r.choice(["", "", "=", "=="]), pem, int("PRIVATE" in pem)
        elif kind == 15:
            value, before, y = "".join(r.choice(_PROSE) for _ in range(r.randrange(3, 7))), r.choice([prose, prose, "", "the "]), 0
        elif kind == 16:
            value = r.choice([lambda: r.choice("_-./ ").join(r.choice([*DICTIONARY, *_WORDS]) for _ in range(r.randrange(2, 7))), lambda: "//" + r.choice(["www.", ""]) + "/".join(r.choice(DICTIONARY) for _ in range(r.randrange(2, 6))) + r.choice(["", ".html", ".com"]), lambda: "".join(w.title() for w in r.sample(DICTIONARY, 4)), lambda: draw(r.choice("-_./+x"), r.randrange(16, 80)), lambda: draw("abcdefghijklmnopqrstuvwxyz", r.randrange(3, 9)) + "-" * r.randrange(10, 60), lambda: "CERTIFICATE-----", lambda: "-----BEGIN"])()
            value, before, y = value, r.choice([prose, prose, "", announce]), 0
        elif kind == 17:
            value, before, y = r.choice([r.choice([*_WORDS, *DICTIONARY]), "".join(r.choice(_PROSE) for _ in range(r.randrange(1, 4)))]), r.choice(ANNOUNCE) + r.choice(["", "s", "ed", "entication", "ority"]) + " ", 0
        elif kind == 18:
            word = r.choice(DICTIONARY)
            value, before, y = r.choice(["None", "null", "true", "false", "undefined", "string", "required", "optional", "str", "bytes", "password", "changeme", f"os.environ[{word}]", f"getpass.{word}()", f"self.{word}", f"request.{word}", f"${{{word.upper()}}}", f"<{word}>", f"{{{{ {word} }}}}", f"get_{word}(", "********", f"your-{word}-here", f"your_{word}", f"process.env.{word.upper()}", f"example{word}", word, f"%({word})s", f"{word}_{r.choice(DICTIONARY)}"]), announce, 0
        elif kind == 19:
            value, before, y = draw(alnum + "+/", 64) + r.choice(["", "=", "=="]), draw(alnum + "+/", 47) + "\n", 0
        else:
            value, before, y = r.choice(["xxxxxxxxxxxxxxxx", "your-token-here-", "example", "abcdef1234567890"]) + draw("0123456789x", r.randrange(8, 20)), announce, 0
        close = before[-1] if before[-1:] in ("'", '"') else r.choice(["", "", ";", ",", "\n"])
        remark = r.choice(["", "", " // example", " (sha256)", " # placeholder"]) if kind in (6, 7, 9, 18) else r.choice(["", "", "", " // secret", " # rotate this token"]) if y else ""
        out.append((value, draw("abcdefgh ", r.randrange(0, 20)) + " " + before, close + remark + r.choice(["", " ", "\n"]) + draw("abcdefgh ", r.randrange(0, 30)), path, y))
    return out


class Forest:
    """A random forest of Gini trees kept as flat arrays; predictions walk all rows level by level."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 1) -> None:
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(y), len(y))
            self.grown.append(self._grow(x[rows], y[rows]))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, left, value = [], [], [], []
        todo = [(np.arange(len(y)), 0, -1)]
        while todo:
            rows, deep, slot = todo.pop()
            me = len(feature)
            feature.append(-1), cut.append(0.0), left.append((0, 0)), value.append(float(y[rows].mean()))
            if slot >= 0:
                parent, side = divmod(slot, 2)
                pair = list(left[parent])
                pair[side] = me
                left[parent] = tuple(pair)
            best = self._split(x[rows], y[rows]) if deep < self.depth and len(rows) >= 2 * self.least and 0 < value[me] < 1 else None
            if best:
                feature[me], cut[me] = best
                go = x[rows, best[0]] <= best[1]
                todo += [(rows[go], deep + 1, 2 * me), (rows[~go], deep + 1, 2 * me + 1)]
        return np.array(feature), np.array(cut), np.array(left), np.array(value)

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, least = None, np.inf
        for f in self.rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= self.least) & (at <= len(y) - self.least)]
            if not len(at):
                continue
            a, b, n = ones[at - 1], ones[-1] - ones[at - 1], len(y)
            gini = a * (1 - a / at) + b * (1 - b / (n - at))
            k = int(np.argmin(gini))
            if gini[k] < least:
                middle = float((v[at[k]] + v[at[k] - 1]) / 2)
                best, least = (int(f), middle if middle < v[at[k]] else float(v[at[k] - 1])), gini[k]  # neighbours: the middle may round up
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, child, value in self.grown:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, child[at, right.astype(int)], at)
            out += value[at]
        return out / max(1, len(self.grown))


def train_forest(findings: list[tuple[str, str, str, str, int]], **how) -> Forest:
    """findings: (candidate, text before it, text behind it, path, 1 for a secret)."""
    x = np.array([features(*f[:4]) for f in findings], float)
    return Forest(**how).fit(x, np.array([f[4] for f in findings], float))


def _special(text: bytes) -> list[tuple[int, int]]:
    """Announced and prefixed spans of a text in order, disjoint; of two that overlap, the one that begins first stays."""
    found = [m.span() for m in _PREFIXED.finditer(text)]
    at = _TOLD_GUARD.search(text)
    stretch = 0  # where the last stretch without quotes ends; one that begins in it ends there too
    while at:  # a value may itself be the name of the next one: `auth: token=x`
        # All names in a run of name characters end where it ends, and what follows a name holds none of these.
        step = _NAME_RUN.match(text, at.end()).end()
        m = _TOLD.match(text, step)
        if m:
            begin, end = m.span(m.lastgroup)
            if m.lastgroup != "v":
                found.append((begin, end))
                step = end
            elif not _names_next(text, begin):
                stretch = stretch if end <= stretch else _STRETCH.match(text, end).end()
                found.append((begin, begin + len(text[begin:stretch].rstrip(b")]}>.:"))))
                step = max(step, stretch)
        at = _TOLD_GUARD.search(text, step)
    out: list[tuple[int, int]] = []
    for begin, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if end - begin >= LEAST_TOLD and (not out or begin >= out[-1][1]):
            out.append((begin, end))
    return out


def _names_next(text: bytes, begin: int) -> bool:
    """Whether a stretch goes on with a name and a sign of assignment: then it is no value."""
    end = _NAME_RUN.match(text, begin).end()
    return bool(_NEXT_GIVEN.match(text, end)) and bool(_TOLD_GUARD.search(text, begin, end))


_NEXT_GIVEN = re.compile(rf"{_GIVEN}[^\s]".encode())


def candidates(column: pa.Array) -> list[tuple[int, int, int, str, str, str]]:
    """(row, start, end in code points, candidate, text before it, text behind it) of a text column."""
    data, off = text_buffers(column)
    starts, ends, _ = word_bounds(data, off, _RUN)
    long = ends - starts >= LEAST - 2
    starts, ends = starts[long], ends[long]
    row, chars = np.searchsorted(off, starts, "right") - 1, char_counts(data)
    runs: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
        pad = e
        while pad < off[r + 1] and pad < e + 3 and data[pad] == 0x3D:
            pad += 1
        if pad <= e + 2 and (pad == off[r + 1] or not _RUN[data[pad]]):
            e = pad
        runs.setdefault(r, []).append((s, e))
    out = []
    for r in range(len(off) - 1):
        base = int(off[r])
        text = data[base : off[r + 1]].tobytes()
        special = _special(text)
        spans, heads = list(special), [(m.start(1), m.end(1), m.group(0)) for m in _PEM.finditer(text)] if b"PRIVATE KEY" in text else []
        k = 0
        for s, e in runs.get(r, ()):
            s, e = s - base, e - base
            while k < len(special) and special[k][1] <= s:
                k += 1
            j = k
            while j < len(special) and special[j][0] < e:
                if special[j][0] - s >= LEAST:
                    spans.append((s, special[j][0]))
                s = special[j][1]
                j += 1
            if e - s >= LEAST:
                spans.append((s, e))
        firsts = [h[0] for h in heads]
        for s, e in sorted(spans):
            near = bisect.bisect_right(firsts, s) - 1  # keys lie apart
            head = heads[near][2] if near >= 0 and s < heads[near][1] else None
            before = text[max(0, s - AROUND) : s] if head is None else head[-AROUND:] + b"\n"
            out.append((r, int(chars[base + s] - chars[base]), int(chars[base + e] - chars[base]), text[s:e].decode(errors="ignore"), before.decode(errors="ignore"), text[e : e + AROUND].decode(errors="ignore")))
    return out


FOUND = "doc_id long, start long, end long, candidate_sha256 string, score double, secret boolean"


def scan_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, path, text) -> one row per candidate with the forest's score and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            found = candidates(batch.column(2))
            if not found:
                continue
            rows = pa.array([f[0] for f in found], pa.int64())
            paths = batch.column(1).take(rows).to_pylist()
            score = np.round(shared.value.predict(np.array([features(*f[3:6], p or "") for f, p in zip(found, paths, strict=True)], float)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([hashlib.sha256(f[3].encode()).hexdigest() for f in found]), pa.array(score), pa.array(score >= threshold)], ["doc_id", "start", "end", "candidate_sha256", "score", "secret"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text").mapInArrow(run, FOUND)
