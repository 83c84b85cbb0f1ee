import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import settled
from tidemark.store import written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("write", [settled, written])
def test_written_tables_leave_no_shuffle_files(spark, write):
    made = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count()
    before = shuffle_files(spark)
    first = write(made, "t")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    # the same frame can be written and read again, and the session keeps its settings
    assert write(made, "t").count() == made.count() == first.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
