"""Each stage of the pipeline on its own input, against brute force."""

import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_operators import base_counts, brute_components, brute_hits, shingles
from veilwork.llm.encode import encoder
from veilwork.llm.queries import vocabulary
from veilwork.llm.store import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """The input, and what each stage leaves."""
    r = np.random.default_rng(8)
    vocabulary_ = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "sul") for b in ("ta", "ven", "dor", "pi", "xu", "s", "nd")]
    good = [" ".join(r.choice(vocabulary_, 70)) for _ in range(60)]
    junk = [" | ".join(r.choice(["###", "zzq", "$$", "xx9"], 60)) for _ in range(20)]
    near = [t + " and one" for t in good[:8]] + good[8:12]
    bench = " ".join(r.choice(vocabulary_, 14))
    bad = [f"{t} {bench} {bench}" for t in [" ".join(r.choice(vocabulary_, 60)) for _ in range(4)]]
    texts = [*good, *junk, *near, *bad, "short", None, good[0]]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    rows += [(None, good[20], None, None, None), rows[3], rows[3]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(5, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(d)), "stage")
        out.append(docs.collect())
    return bench, out


def test_quality_rejects_junk_and_keeps_prose(ran):
    before, after = ran[1][0], ran[1][1]
    kept = Counter(map(tuple, after))
    for r in before:
        n = base_counts(r.text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        junk = r.doc_id is not None and 60 <= r.doc_id < 80
        assert (tuple(r) in kept) == (not failed and not junk)
    assert sum(r.doc_id == 3 for r in after) == 3  # repeated rows stay


def test_one_document_of_each_group_stays(ran):
    before, after = ran[1][1], ran[1][2]
    texts = {r.doc_id: shingles(r.text, 5) for r in before if r.doc_id is not None}
    links = [(a, b) for a, b in combinations(texts, 2) if texts[a] and texts[b] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    label = brute_components(links, texts)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({*label.values()})
    assert sum(r.doc_id is None for r in after) == 0  # its text is that of a document with an id


def test_contaminated_documents_go(ran):
    bench, out = ran
    words = bench.split()
    phrases = {tuple(words[k : k + 13]): {"5"} for k in range(2)}
    want = [r for r in out[2] if not (x := brute_hits(r.text, phrases))[1] or 20 * x[1] < x[0]]
    assert Counter(map(tuple, out[3])) == Counter(map(tuple, want)) and len(want) < len(out[2])


def test_the_mix_repeats_documents_twice_at_most(ran):
    before, after = (Counter(map(tuple, x)) for x in (ran[1][3], ran[1][4]))
    assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items())
    words = lambda rows: sum(len((t[1] or "").split()) * n for t, n in rows.items())
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)


def test_token_files_hold_every_document(ran):
    tool, at = encoder(vocabulary()), 0
    want = sorted(((r.doc_id, r.text) for r in ran[1][4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for g, (doc, text) in zip(sorted(ran[1][5], key=lambda r: r.start), want, strict=True):
        ids = [*tool.raw([text or ""])[0], 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_texts_that_share_an_id(spark):
    """Id 5 has a text of its own and a copy of document 3's; only the copy goes, and in `near_duplicates` id 5 is one vertex."""
    from corpus_pipeline import near_dedup
    from veilwork.llm.near_dup import near_duplicates

    other, copied = " ".join(f"alpha{k}" for k in range(40)), " ".join(f"beta{k}" for k in range(40))
    more = [" ".join(f"gamma{n}x{k}" for k in range(40)) for n in range(4)]
    made = [(3, copied, "a"), (5, other, "b"), (5, copied, "c"), (5, other, "b"), (6, other, "d"), *((7, t, "e") for t in more), (8, more[3], "e"), (9, None, "e"), (9, "", "e"), (None, copied, "e")]
    d = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in near_dedup(spark, d, "").collect()), key=str)
    assert [sum(t == x for _, t in got) for x in (other, *more, copied)] == [1, 1, 1, 1, 1, 1]
    assert (3, copied) in got and len(got) == 8  # the row without an id goes too
    labels = {}
    for r in near_duplicates(d, 5, 80).where("doc_id is not null").collect():
        labels.setdefault(r.doc_id, set()).add(r.component_id)
    assert labels == {3: {3}, 5: {3}, 6: {3}, 7: {7}, 8: {7}, 9: {9}}


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    columns = COLUMNS + ", kept boolean, size long, rep long, digest string, set_key string, label long, n long, copies long"
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, "en", "a", 0, False, 1, 2, "d", "s", 3, 4, 5), (2, words, "en", "a", 0, None, 1, 2, "d", "s", 3, 4, 5), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for made, left in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(made, columns)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = written(out, "stage")
            assert name == "mixing" or docs.where("doc_id = 1").count() == left
        assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_pass_maps_and_long_texts(spark, tmp_path):
    """Rows equal in id and text stay apart by their other columns, in one order whatever the partitions."""
    words = lambda n, k: " ".join(f"w{i}x{n}" for i in range(k))
    made = [(1, words(1, 80), "en", "a", 0, {"k": str(v)}) for v in range(3)] + [(2, words(2, 90_000), "en", "a", 0, None), (3, None, "en", None, 0, {}), (4, words(4, 70), "en", "b", 0, {"b": "c", "a": None})]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, mixes = spark.createDataFrame(made, COLUMNS + ", tags map<string,string>"), []
    tagged = lambda rows: Counter((r.doc_id, str(sorted((r.tags or {}).items()))) for r in rows)
    for parts in (1, 5):
        mixes.append(tagged(corpus_pipeline.mixing(spark, docs.repartition(parts), str(tmp_path)).collect()))
    assert mixes[0] == mixes[1] and sum(n for (i, _), n in mixes[0].items() if i == 1) > 0
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        if name == "near-duplicates":
            assert tagged(docs.collect()) == Counter({(1, "[('k', '0')]"): 1, (2, "[]"): 1, (4, "[('a', None), ('b', 'c')]"): 1})
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()


def test_run_deletes_the_tables_of_its_stages(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from veilwork.session import shared_dir

    words = [" ".join(f"w{k}x{n}" for k in range(80)) for n in range(6)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(words)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "veilwork"
    before = {*folder.iterdir()} if folder.exists() else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert sorted(p.name.split("-")[0] for p in {*folder.iterdir()} - before) == ["token", "tokens"]
