"""Queries against their SQL, and the pipeline's stages, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from gridcast.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()
    key = list(got.columns[:3]) if name == "op13_filter_audit" else got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0
    assert docs.filter("not round_trip").count() == 0


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing names, stage by stage; and
    each stage on an empty table."""
    some = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    odd = [(None, "a text without an id " * 9, None, None, None), (9001, None, "en", None, None), (9002, "", None, "s", 0),
           (9003, " \t\n", "en", "s", 3), (9004, "one", "en", None, 3), (9004, "one", "en", None, 3), (9005, "long words " * 30_000, "de", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, place string, score string, key string"
    docs = spark.createDataFrame([(*r, "a", None, "b", "c") for r in [*some, *odd]], schema)
    nothing, columns = docs.limit(0), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nothing, SF).count() == 0, name
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"e{k}"))
        docs = spark.read.parquet(str(tmp_path / f"e{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.filter("n_chars is not null and n_chars <> length(text)").count() == 0
    assert docs.count() > 0 and docs.filter("not round_trip").count() == 0


def test_mixed_rows_are_in_shard_order(spark):
    from gridcast.llm import mixing
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranked = mixing.mix(docs).select("doc_id", "shard", "place", "text").collect()
    want = [(r.doc_id, r.text) for r in sorted(ranked, key=lambda r: (r.shard, r.place))]
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    parts = mixed.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, r.doc_id, r.text) for r in rows]).collect()
    by = {}
    for i, d, t in parts:
        by.setdefault(i, []).append((d, t))
    shards = {s: [(r.doc_id, r.text) for r in sorted(ranked, key=lambda r: r.place) if r.shard == s] for s in {r.shard for r in ranked}}
    assert sum(map(len, by.values())) == len(want)
    flat = [x for rows in by.values() for x in rows]
    for rows in shards.values():             # each shard's rows stand together, in its order
        at = flat.index(rows[0])
        assert flat[at:at + len(rows)] == rows
