"""The registered queries on the smallest tables, against their SQL, and the pipeline stage by stage."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def same(df, sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    names = sorted(df.columns)
    want = con.execute(sql)
    at = [c[0] for c in want.description]
    rows = [tuple(r[at.index(n)] for n in names) for r in want.fetchall()]
    assert sorted(at) == names
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_lm_scoring", "op3_benchmark_decontamination", "op7_substring_dedup", "op10_minhash_near_dedup", "op12_source_divergence"])
def test_oracles(spark, name):
    from reelquery.llm import queries

    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_all_queries_are_registered():
    from reelquery.llm import queries

    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from reelquery.llm import decontam, neardup

    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "pii", "harmonic_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] >= seen[1] >= seen[2] == seen[3]
    assert neardup.near_duplicates(docs, percent=80).where("not kept").count() <= len(seen[0] - seen[1])
    assert decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen[-1]
