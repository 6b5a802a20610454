"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from ticksmith.llm.oracles import ORACLE
from ticksmith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()
    assert set(ORACLE) <= set(E.oracle_sql()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from ticksmith.llm.common import stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns
        if name in ("quality_rules", "simhash_near_dedup"):
            assert 0 < out.count() <= docs.count()
        if name == "pii":
            assert out.count() == docs.count()
            assert out.where("text rlike '[a-z]@mail'").isEmpty()
        docs = out
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert n and C.run(spark, SF).count() == packed.count()
