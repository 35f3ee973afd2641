"""The registered queries: SQL where there is some, and the pipeline's stages one after another."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert names == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.ORACLES)))
def test_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_stages(spark, edges):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edges.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = after.cache()
            assert docs.count() > 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert rows.count() > 0
