"""Tables of few bytes whose rows are much work: a file of one row group is dealt over several tasks."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("customers"))
    rows = spark.range(0, 25_000, 1, 1).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.write.parquet(f"{at}/customer.parquet")
    return at


@pytest.mark.parametrize("name", ["reserved_codes", "id_columns", "dob_columns", "streamed_redactions", "office_files", "american_phones", "labelled_ids"])
def test_rows_are_dealt(spark, customers, name):
    found = queries()[name](spark, customers)
    task = F.input_file_name() if name == "streamed_redactions" else F.spark_partition_id()  # a stream's task writes a file
    tasks = found.groupBy(task).agg(F.countDistinct("c_custkey").alias("n")).collect()
    least = 24_000 if name == "dob_columns" else 25_000  # some of the days do not exist
    assert len(tasks) == 3 and least <= sum(t.n for t in tasks) <= 25_000 and max(t.n for t in tasks) < 10_000
