from collections import defaultdict

from pyspark.sql import functions as F

from veilwork.operators.ranking import ranked


def test_ranks_of_groups_of_any_size(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else "small", k * 7919 % 1000) for k in range(3000)] + [(None, "hot", None)] * 40
    found = ranked(spark.createDataFrame(rows, "k long, g string, v long").repartition(5), ["g"], ["v", F.col("k").alias("x")], "pos", "n").collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.g].append((r.pos, r.n, (r.v is not None, r.v or 0, r.k or 0)))
    assert len(found) == len(rows) and set(groups) == {"hot", "small", None}
    for own in groups.values():
        own.sort()
        assert [(p, n) for p, n, _ in own] == [(i, len(own)) for i in range(len(own))]
        assert [v for _, _, v in own] == sorted(v for _, _, v in own)
    assert ranked(spark.createDataFrame([], "k long, g string"), ["g"], ["k"]).collect() == []
