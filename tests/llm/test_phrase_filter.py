"""Decontamination by a benchmark of several passes: documents are computed once, and few go through the passes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilwork.llm.decontaminate import PhraseFilter, contamination, keep_clean

from .test_operators import rows

WORDS = [f"w{k}" for k in range(60)]


def made(seed, n, longest):
    pick = random.Random(seed)
    return [" ".join(pick.choices(WORDS, k=pick.randrange(longest))) for _ in range(n)]


def test_filter_passes_all_that_hold_a_phrase():
    items, texts = made(1, 40, 9), made(2, 300, 30)
    phrases = {tuple(w[k : k + 4]) for w in map(str.split, items) for k in range(max(1, len(w) - 3) if w else 0)}
    for bits in (1 << 6, 1 << 16):  # a full filter lets all pass, but loses none
        told = PhraseFilter(bits)
        told.add(items[:25], 4)
        told.add([*items[25:], None, "", "..."], 4)
        may = told.may_hold(pa.array([*texts, None, "", "- -"])).tolist()
        holds = [any(tuple(w[k : k + len(p)]) == p for p in phrases for k in range(len(w) - len(p) + 1)) for w in map(str.split, texts)]
        assert all(m for m, h in zip(may, holds) if h) and may[-3:] == [False] * 3
    assert sum(may) < sum(holds) + 10 and not all(holds)
    assert not any(PhraseFilter(1 << 6).may_hold(pa.array(texts)))


def test_documents_are_computed_once(spark):
    texts = made(3, 200, 60) + [None, "", " ".join(WORDS)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([(k % 150, t, {"a": k}) for k, t in enumerate(texts)], "doc_id long, text string, extra map<string,int>")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(WORDS[5:40]), *made(4, 30, 8)])], "item_id long, text string")
    docs = plain.mapInArrow(count, plain.schema)
    told = contamination(docs, bench, window=5, block_bytes=40, pass_bytes=90)
    assert rows(told) == rows(contamination(plain, bench, window=5))
    assert told.where("n_hit > 0").count() and told.where("n_hit = 0").count()
    assert seen.value == len(texts)
    seen.value = 0
    key = F.struct("doc_id", "text", F.col("extra")["a"].alias("a"))
    kept = keep_clean(docs, bench, window=5, block_bytes=40, pass_bytes=90)
    assert kept.columns == plain.columns and rows(kept.select(key)) == rows(keep_clean(plain, bench, window=5).select(key))
    assert seen.value == len(texts)
    assert keep_clean(plain.limit(0), bench, block_bytes=40, pass_bytes=90).count() == 0
