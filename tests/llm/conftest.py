import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = "doc_id long, text string"


@pytest.fixture
def stored(spark, tmp_path):
    """Writes rows as a Parquet table of several files and reads it again."""

    def make(rows, schema=DOCUMENTS, files=3, name="documents"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make
