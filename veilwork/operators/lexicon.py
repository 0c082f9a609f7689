"""Name lexicons of any size: a Bloom filter on the workers, then an exact join for the words that pass.

The filter has BITS_A_KEY bits for each key, MOST_BITS at most, whatever the lexicon's size: that much travels to the workers (beyond
it more words pass by chance; none is lost). Words of the texts that look like names and pass it are joined with the
lexicon by their keys, once for each distinct key, and each text gets its own few names back. So what is shuffled grows with
the words that are names, not with the corpus, and candidates are those of a lexicon that every worker holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textops import key_text
from .columns import KIND
from .detect import candidates
from .names import PARTICLES, STOP_WORDS, Finder, NameLists, words
from .spans import resolve_overlaps

BITS_A_KEY, HASHES, MOST_BITS = 12, 8, 1 << 28
FOUND = "array<struct<key:string,given:boolean,family:boolean>>"


def _slots(keys: list[str], bits: int) -> np.ndarray:
    """HASHES places of each key, by double hashing of one digest."""
    drawn = np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2)
    return ((drawn[:, :1] + drawn[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def keyed(names: DataFrame) -> DataFrame:
    """names (name, kind: `given` or `family`) -> key, given, family: one row for each key; nulls, other kinds and names without letters are left out."""

    @F.pandas_udf("string")
    def key(column: pd.Series) -> pd.Series:
        return column.map(key_text)

    rows = names.where("name is not null and kind in ('given', 'family')").select(key("name").alias("key"), "kind").where("key <> ''")
    return rows.groupBy("key").agg(F.max(F.col("kind") == "given").alias("given"), F.max(F.col("kind") == "family").alias("family"))


def bloom(lexicon: DataFrame) -> np.ndarray:
    """The filter of a lexicon's keys: packed bits. Partitions make their own, and equal parts of these are joined by OR, so that no task holds more than one filter."""
    n = lexicon.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, n) * BITS_A_KEY)), 10, np.log2(MOST_BITS)))
    part = min(bits // 8, 1 << 16)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(bits, bool)
        for batch in batches:
            made[_slots(batch.column(0).to_pylist(), bits).ravel()] = True
        packed = np.packbits(made).reshape(-1, part)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[k].tobytes() for k in used], pa.binary())], ["part", "bits"])

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(part, np.uint8)
        for bits_ in rows["bits"]:
            whole |= np.frombuffer(bits_, np.uint8)
        return pd.DataFrame({"part": [key[0]], "bits": [whole.tobytes()]})

    # A few partitions of keys make few filters; their parts meet by place.
    rows = lexicon.select("key").coalesce(16).mapInArrow(own, "part int, bits binary").groupBy("part").applyInPandas(joined, "part int, bits binary")
    out = np.zeros((bits // 8 // part, part), np.uint8)
    for r in rows.toLocalIterator():  # MOST_BITS at most in all
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(filter_: np.ndarray, keys: list[str]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    at = _slots(keys, len(filter_) * 8)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def hits(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, text) -> key, names: the text's words that the lexicon (key, given, family) has. Texts without any have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(lexicon))

    @F.pandas_udf("array<string>")
    def likely(texts: pd.Series) -> pd.Series:
        found = [sorted({w[1] for w in words(t or "") if w[1]}) for t in texts]
        good = iter(passes(shared.value, [k for own in found for k in own]).tolist())
        return pd.Series([[k for k in own if next(good)] for own in found], dtype=object)

    told = docs.select(F.col(key).alias("__doc"), F.explode(likely(F.col(text))).alias("__word"))
    both = told.join(lexicon, F.col("__word") == F.col("key"))
    return both.groupBy("__doc").agg(F.collect_set(F.struct("key", "given", "family")).alias("names")).select(F.col("__doc").alias(key), "names")


def own_candidates(text: Column, names: Column, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """Candidates of a text from the names of a lexicon that it holds (as of `hits`) and from supplied records."""
    made: list[Finder] = []

    @F.pandas_udf(KIND)
    def found(texts: pd.Series, lists: pd.Series) -> pd.Series:
        if not made:
            made.append(Finder(NameLists(custom=custom)))
        out = []
        for body, own in zip(texts, lists, strict=True):
            own = own if own is not None else ()
            made[0].lists = _Own(frozenset(n["key"] for n in own if n["given"]), frozenset(n["key"] for n in own if n["family"]))
            out.append(list(made[0].candidates(body or "")))
        return pd.Series(out, dtype=object)

    return found(text, names.cast(FOUND))


class _Own:
    """The names of one text, where `Finder` looks for a lexicon."""

    stop, particles = STOP_WORDS, PARTICLES

    def __init__(self, given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family


def detect_with_lexicon(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", custom: tuple[tuple[str, str], ...] = (), columns: bool = True, into: str = "spans") -> DataFrame:
    """As `detect` with lists, for a table of names (name, kind) of any size. key identifies a document; rows with a null key have no names of the lexicon."""
    own = hits(docs, keyed(names), key, text).select(F.col(key).alias("__of"), F.col("names").alias("__names"))
    rows = docs.join(own, F.col(key) == F.col("__of"), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(candidates(body, columns=columns), own_candidates(body, F.col("__names"), custom))
    return rows.withColumn("__candidates", found).withColumn(into, resolve_overlaps(body, F.col("__candidates"))).drop("__candidates", "__of", "__names")
