import random

from pyspark.sql import functions as F

from veilwork.operators import lexicon
from veilwork.operators.detect import detect
from veilwork.operators.names import SEED_FAMILY, SEED_GIVEN, NameLists


def test_a_filter_passes_every_key_and_few_others(spark):
    keys = [f"name{k}" for k in range(20_000)]
    made = lexicon.bloom(spark.createDataFrame([(k,) for k in keys], "key string").repartition(5))
    assert lexicon.passes(made, keys).all() and lexicon.passes(made, [f"other{k}" for k in range(20_000)]).mean() < 0.02
    assert not lexicon.passes(lexicon.bloom(spark.createDataFrame([], "key string")), ["a"]).any() and not len(lexicon.passes(made, []))


def test_candidates_are_those_of_a_list_on_every_worker(spark):
    r = random.Random(3)
    words = [*map(str.title, SEED_GIVEN), *map(str.title, SEED_FAMILY), *SEED_GIVEN[:4], "Zoë", "van", "der", "and", "met", "Rose,", "May.", "a@b.de", "10.0.0.1", "O'Neil", "ITO"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randrange(1, 25)))) for k in range(150)] + [(998, None), (999, "")], "doc_id long, text string").repartition(4)
    names = spark.createDataFrame([(n, "given") for n in SEED_GIVEN] + [(n, "family") for n in SEED_FAMILY] + [("Zoë", "given"), ("x", "other"), (None, "given"), ("--", "family")], "name string, kind string")
    custom = (("Anna", "Smit"),)
    got = {x.doc_id: x.spans for x in lexicon.detect_with_lexicon(docs, names, custom=custom, columns=False).collect()}
    want = {x.doc_id: x.spans for x in detect(docs, lists=NameLists.from_table(names, custom), columns=False).collect()}
    assert got == want and sum(map(len, want.values())) > 300


def test_only_hits_are_shuffled(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "Anna Smit").otherwise("nothing to see here at all").alias("text"))
    names = spark.createDataFrame([("Anna", "given"), ("Smit", "family")], "name string, kind string")
    found = lexicon.hits(docs, lexicon.keyed(names)).collect()
    assert [(x.doc_id, sorted(n.key for n in x.names)) for x in found] == [(7, ["anna", "smit"])]
