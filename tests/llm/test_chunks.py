import math

import pytest
from pyspark.sql import functions as F

from quern.llm import ctw, store


@pytest.fixture
def sizes(spark):
    yield "spark.sql.files.maxPartitionBytes"
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scores_do_not_depend_on_file_splits(spark, data, sizes, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 1 << 16)

    def scores():
        out = ctw.score(docs, F.col("doc_id") % 7 != 2, carry=("doc_id",), scanned=True)
        return sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in out.collect())

    want = scores()
    assert not any(math.isnan(x) for r in want for x in r)
    table = store.table

    def resplit(*args):
        out = table(*args)
        spark.conf.set(sizes, "50000")
        return out

    monkeypatch.setattr(store, "table", resplit)
    assert scores() == want
