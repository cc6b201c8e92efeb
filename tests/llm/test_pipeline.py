"""The stages against brute force, each on its own input."""

import corpus_pipeline as p
from pyspark.sql import functions as F
from quillspark.llm import op6_toxicity, op7_decontaminate, op9_pii

from test_similar import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("extra"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, toxicity), (_, near), (_, clean), (_, pii), (_, mixing) = p.STAGES

    kept = toxicity(spark, docs, SF)
    scores = op6_toxicity.score(docs.drop("score"), op6_toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores.filter("predicted = 0").collect()}

    one = near(spark, kept, SF)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == brute([(r["doc_id"], r["text"]) for r in kept.collect()])

    rest = clean(spark, one, SF)
    marked = op7_decontaminate.decontaminate(one, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert rest.columns == docs.columns and sorted(r["doc_id"] for r in rest.collect()) == sorted(r["doc_id"] for r in marked.filter("not contaminated").collect())

    masked = pii(spark, rest, SF)
    assert masked.columns == docs.columns and masked.count() == rest.count()
    left = op9_pii.find(masked).select(F.explode("spans").alias("s")).filter("s.base").count()
    assert left == 0
    mixed = mixing(spark, masked, SF)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in masked.collect()}


def test_run(spark):
    assert p.run(spark, SF).count() > 0


EDGE = [
    (1, None, "en", "a", None),
    (None, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three four five six seven eight", "en", "a", 39),
    (3, "one two three four five six seven eight", "en", "a", 39),
    (3, "another text under the same number as the one above", "fr", "b", 51),
    (None, "nobody has given this one a number yet", "de", None, 38),
    (None, "nor has anybody thought of this other one", "de", None, 41),
    (9, "write to a@b.co or 10.0.0.1 " * 400, "en", "c", 11200),
    (8, "write to a@b.co or 10.0.0.1 " * 400, "en", "c", 11200),
]


def test_stages_on_nulls_repeats_and_ties(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(EDGE, kind).withColumn("score", F.lit("extra")).withColumn("spans", F.lit(1)).withColumn("component", F.lit(2)).withColumn("row", F.lit(3))
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    (_, toxicity), (_, near), (_, clean), (_, pii), (_, mixing) = p.STAGES
    for stage in (toxicity, clean):
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    kept = near(spark, docs, sf)
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(1, None), (3, EDGE[3][1]), (3, EDGE[5][1]), (None, EDGE[6][1]), (None, EDGE[7][1]), (8, EDGE[8][1])]
    assert kept.columns == docs.columns and sorted(map(str, texts)) == sorted(map(str, want))
    masked = pii(spark, docs, sf)
    assert masked.columns == docs.columns and masked.count() == len(EDGE)
    for r in masked.collect():
        if r["doc_id"] in (8, 9):
            assert r["text"] == "write to [EMAIL] or [IP] " * 400 and r["n_chars"] == len(r["text"])
        else:
            assert (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) in EDGE
    used = mixing(spark, docs, sf).filter("epoch = 0").collect()
    assert sorted(str(r["doc_id"]) for r in used) == sorted(str(e[0]) for e in EDGE)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in p.STAGES:
        found = stage(spark, docs, sf)
        assert found.count() == 0 and (name == "mixing" or found.columns == docs.columns)
