"""The pipeline's stages on their own inputs, and the whole."""

import corpus_pipeline as P
import pytest
from test_llm_operators import brute_components
from pyspark.sql import functions as F

from hearthline.llm import common

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_return_the_columns_of_documents(spark, docs):
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_toxicity_rejects_labelled_and_keeps_clean(spark, docs):
    kept = ids(P.toxicity_stage(spark, docs, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    toxic, clean = {r.doc_id for r in labels if r.toxic}, {r.doc_id for r in labels if not r.toxic}
    assert len(toxic - kept) >= 0.75 * len(toxic) and len(clean & kept) >= 0.98 * len(clean)


def test_line_dedup_drops_only_what_is_covered(spark, docs):
    out = {r.doc_id: r.text for r in P.line_dedup_stage(spark, docs, SF).collect()}
    lines, first = {}, set()
    for r in docs.orderBy("doc_id").collect():
        got, gone = r.text.split("\n"), set()
        for k in range(len(got) - 2):
            key = tuple(got[k : k + 3])
            gone |= {k, k + 1, k + 2} if key in first else set()
            first.add(key)
        lines[r.doc_id] = "\n".join(x for k, x in enumerate(got) if k not in gone) if len(gone) < len(got) else None
    assert out == {i: t for i, t in lines.items() if t is not None}


def test_near_dedup_stage_is_op6_at_eighty_percent(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(400).collect()]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(P.near_dedup_stage(spark, few, SF)) == {i for i, (_, c) in brute_components(rows, 80).items() if i == c}


def test_decontamination_drops_documents_with_items(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    kept = ids(P.decontamination_stage(spark, docs, SF))
    assert leaking and not leaking & kept and len(kept) >= docs.count() - len(leaking) - 3


def odd_tables(spark, folder, docs):
    """A folder of tables with these documents and the given others."""
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a few words"), (9003, "a few words"), (9004, "x" * 20_000), (None, "no id")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in given.dtypes if c not in ("doc_id", "text")), F.lit("clash").alias("score"))
    out = P.run(spark, odd_tables(spark, tmp_path / "odd", given.withColumn("score", F.lit("clash")).unionByName(odd)))
    assert {9001, 9002, 9003, 9004} <= ids(out) and out.where("doc_id = 9003").count() == 2
    assert P.run(spark, odd_tables(spark, tmp_path / "none", given.where("false"))).count() == 0


def test_run(spark):
    left = len(common.tables_made())
    out = P.run(spark, "/root/testdata/sf0.001")
    r = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()
    assert out.count() > 0 and r[0] <= 4096
    assert len(common.tables_made()) == left + 1  # the result; everything else is deleted
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"] and P.ORACLE_SQL is None
