"""The registered queries: against their SQL, by held-out accuracy, and the pipeline stage by stage."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def _oracles():
    from bandwise.llm.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", _oracles())
def test_against_sql(spark, duck, name):
    from bandwise.llm.queries import ORACLES, QUERIES

    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_languages_held_out(spark):
    from bandwise.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = QUERIES["op7_language_id"](spark, SF_DIR).join(docs, "doc_id").filter("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_toxicity_held_out(spark):
    from bandwise.llm.queries import QUERIES

    got = QUERIES["op8_toxicity"](spark, SF_DIR)
    assert got.count() == 1000 and got.filter("not score between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_of_labelled_rows_held_out(spark):
    """At the largest scale, where there are toxic documents enough to count."""
    from bandwise.llm.queries import QUERIES

    folder = SF_DIR.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    held = QUERIES["op8_toxicity"](spark, folder).filter("held_out").join(labels, "doc_id")
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    toxic, clean = (sum(n for (label, _), n in seen.items() if label == want) for want in (1, 0))
    assert toxic > 50 and clean > 500
    assert seen[1, 1] / toxic >= 0.8 and seen.get((0, 1), 0) / clean <= 0.03


def test_decontamination_finds_every_verbatim_item(spark):
    from bandwise.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["contaminated"] for r in QUERIES["op4_benchmark_decontamination"](spark, SF_DIR).collect()}
    assert got == {i: any(t in text for t in items) for i, text in docs.items()}


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (None, "Some words of text.", None, None, 19)], docs.schema)
    docs = docs.unionByName(odd).withColumn("component_id", F.lit("clash"))
    counts = [docs.count()]
    for name, stage in C.STAGES:
        done = C.stored(stage(spark, docs, SF_DIR), name)
        if name != "source_mix":
            assert done.columns == docs.columns
        docs = done
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.98 * counts[0] and counts[-1] > 700
    assert docs.filter("taken <= 0 or taken > 2 * size").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as C

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
