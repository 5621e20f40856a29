"""The run store's many small files are written by several tasks, whatever few bytes they have."""

import re

from pairwell.catalog import storage
from pairwell.catalog.base import Tables


def test_store_is_written_by_several_tasks(spark):
    files = spark.read.option("recursiveFileLookup", True).text(storage.write_store(Tables(spark, "/root/testdata/sf0.001")), wholetext=True)
    names = [r[0] for r in files.select("_metadata.file_name").collect()]
    assert len({re.match(r"part-(\d+)", n)[1] for n in names}) > 1
