from cases import documents, texts
import corpus_pipeline as P
from sorrel.llm.simhash import fingerprint
from sorrel.llm import secrets as S
from sorrel.llm.quality import score_quality
from sorrel.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at, columns = docs.cache(), docs.columns
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, at, SF).cache()
        assert out.columns == columns, name
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (at, out))
        assert set(after) <= set(before) and len(after) > 0
        if name == "quality":
            assert set(after) == {r.doc_id for r in score_quality(spark, at, labels).where("predicted = 1").collect()}
        elif name == "toxicity":
            assert set(after) == {r.doc_id for r in score_toxicity(spark, at, labels).where("predicted = 0").collect()}
        elif name == "near_dedup":
            fps = [fingerprint(t.encode()) for t in after.values()]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
        else:
            assert set(after) == set(before) and any("[SECRET]" in t for t in after.values())
            assert S.secret_report(out).where("n_access + n_hex > 0").count() == 0
        at = out
    assert {r.doc_id for r in P.STAGES[-1][1](spark, at, SF).collect()} == set(after)


def test_odd_rows_and_empty_tables(spark):
    for stage in (P.STAGES[0][1], P.STAGES[1][1], P.STAGES[2][1], P.STAGES[3][1]):
        out = stage(spark, documents(spark), SF)
        assert out.columns == documents(spark).columns and 0 < out.count() <= len(texts())
        assert stage(spark, documents(spark, []), SF).count() == 0


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 100
