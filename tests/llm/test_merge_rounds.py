"""The index is the same whatever the number of runs that are merged at once."""

import functools

import pytest
from pyspark.sql import functions as F

from veilwork.llm import warc


@pytest.mark.parametrize(("fan_in", "files"), [(2, 9), (3, 10)])
def test_merging_in_rounds(spark, monkeypatch, fan_in, files):
    rows = [(k, f"http://h{k % 7}.org/p{k % 11}?q={k}", "x" * (k % 1500)) for k in range(120)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parts = [pages.where(F.coalesce("page_id", F.lit(0)) % files == k) for k in range(files)]
    archives = functools.reduce(lambda a, b: a.union(b), [warc.write_archives(p, warc.new_path(spark, "warc"), 1000) for p in parts])
    assert archives.count() == files
    facts = [c for c in warc._NAMES if c != "length"]
    whole = [tuple(r[c] for c in facts) for r in warc.merged_index(archives).collect()]
    assert len(whole) == 121 and [r[:2] for r in whole] == sorted(r[:2] for r in whole)
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RANGE_ROWS", 30)
    assert [tuple(r[c] for c in facts) for r in warc.merged_index(archives).collect()] == whole
