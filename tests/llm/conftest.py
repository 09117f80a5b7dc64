import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, source])."""

    def docs(rows, extra=()):
        out = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            out = out.withColumn(name, F.lit("clash"))
        return out

    return docs
