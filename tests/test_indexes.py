"""Vector and full-text indexes against full scans."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.indexes import postings as P
from quillspark.indexes import vectors as N

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors")) + "/index"
    N.build(spark.read.parquet(f"{SF}/embeddings.parquet"), path)
    return path


def brute(rows, queries, k):
    ids = np.array([r["vec_id"] for r in rows])
    x = N.units(np.array([r["embedding"] for r in rows], dtype=float))
    out = {}
    for r in queries:
        near = x @ N.units(np.array([r["embedding"]], dtype=float))[0]
        out[r["vec_id"]] = [int(ids[i]) for i in np.lexsort((ids, -near)) if ids[i] != r["vec_id"]][:k]
    return out


@pytest.mark.parametrize("block", [N.BLOCK, 37])
def test_recall_of_all_hundredth_rows(spark, index, block):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    queries = [r for r in rows if r["vec_id"] % 100 == 0]
    want = brute(rows, queries, 10)
    asked = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in queries], "query_id long, q array<float>")
    got = {}
    for r in N.neighbours(asked, index, 10, block=block).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    every = {}
    for r in N.neighbours(asked, index, 10, probes=10_000, block=block).orderBy("query_id", F.desc("similarity"), "id").collect():
        every.setdefault(r["query_id"], []).append(r["id"])
    assert every == want


def test_search_prunes_folders_and_exact_search_loses_nothing(spark, index):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    for r in rows[:3]:
        few = N.search(spark, index, r["embedding"], 5, probes=2)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list" in plan
        known = N.centroids(spark, index, 2)
        files = [x[0] for x in N.in_lists(spark, index, known, known.order(np.array(r["embedding"]))[0][:2]).select(F.input_file_name()).distinct().collect()]
        assert 1 <= len({f.split("list=")[1].split("/")[0] for f in files}) <= 2
        exact = [x["id"] for x in N.search(spark, index, r["embedding"], 6, exact=True).collect() if x["id"] != r["vec_id"]][:5]
        assert exact == brute(rows, [r], 5)[r["vec_id"]]


def test_clustered_vectors_open_few_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16))
    data = [(i, (middles[i % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1000)] + [(5000, [0.0] * 16), (5001, None), (7, middles[7].tolist())]
    N.build(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("a.b", F.lit(1)), str(tmp_path / "i"), lists=20)
    known = N.centroids(spark, str(tmp_path / "i"))
    assert known.probes <= 3 and known.n.sum() == 1002
    got = [r["id"] for r in N.search(spark, str(tmp_path / "i"), middles[3].tolist(), 50, exact=True).collect()]
    assert set(got) == set(range(3, 1000, 20))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, None)]])
def test_tiny_indexes(spark, tmp_path, rows):
    N.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), str(tmp_path / "i"))
    assert N.search(spark, str(tmp_path / "i"), [1.0, 0.0], 3, exact=True).count() == sum(v is not None for _, v in rows)


# --- posting lists

CHUNKS = [
    (1, "a", "en", "k1", "The cat sat on the mat the cat"), (2, "a", "en", "k2", "a cat, the dog and THE cat"), (3, "b", "en", "k1", "dog only"), (4, "b", None, "k1", "the cat shared"),
    (5, "c", "de", "k1", "the cat der Hund"), (6, "c", "en", "k1", None), (7, "c", "en", "k1", " "), (None, "c", "en", "k1", "the cat"), (8, None, "en", "k1", "the cat"), (9, "d", "en", "k1", "the " * 300 + "cat"),
    *[(i, f"s{i % 7}", "en", "k3", "hot " * (i % 3 + 1) + f"w{i}") for i in range(100, 400)],
]


@pytest.fixture
def chunk_table(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, source_id string, workspace_id string, kb_id string, content string").withColumn("a.b", F.lit(1)).repartition(3)


def scan(rows, workspace, query, kb=None):
    """(chunk_id, frequency, weight) of the chunks with all terms, read plainly."""
    out, wanted = [], list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    for chunk, source, own, k, text in rows:
        if chunk is None or source is None or own != workspace or kb not in (None, k):
            continue
        at = [[i for i, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1) if w == t] for t in wanted]
        if all(at):
            kept, left = [p[:256] for p in at], 1.0
            for i in range(len(kept)):
                for j in range(i):
                    for x in kept[i]:
                        for y in kept[j]:
                            left *= 1 - math.sqrt(0.01 * (1e-30 if abs(x - y) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2))))
            weight = 1 - left if len(kept) > 1 else sum(0.1 / i**2 for i in range(1, len(kept[0]) + 1)) / 1.64493406685
            out.append((chunk, sum(map(len, at)), round(weight, 9)))
    return out


@pytest.mark.parametrize("block", [P.BLOCK, 7])
def test_postings_find_what_a_scan_finds(spark, chunk_table, tmp_path, block):
    path = str(tmp_path / "i")
    P.write(chunk_table, path, buckets=8, block=block)
    for workspace, query, kb in (("en", "the cat", None), ("en", "the cat", "k1"), (None, "cat", None), ("en", "hot", None), ("en", "hot w150", None), ("en", "THE dog cat", None), ("xx", "cat", None), ("en", "none such", None)):
        want = scan(CHUNKS, workspace, query, kb)
        got = P.search(spark, path, workspace, query, 1000, kb=kb, rank="weighted").collect()
        assert [(r["chunk_id"], r["frequency"], pytest.approx(r["weight"], abs=2e-9)) for r in got] == sorted(want, key=lambda r: (-r[2], r[0]))
        assert [r["chunk_id"] for r in P.search(spark, path, workspace, query, 5, kb=kb).collect()] == [r[0] for r in sorted(want, key=lambda r: (-r[1], r[0]))][:5]
    assert P.search(spark, path, "en", " ! ", 5).count() == 0
    longest = spark.read.parquet(f"{path}/blocks").agg(F.max(F.size("postings"))).first()[0]
    assert longest <= block


def test_a_search_reads_its_buckets_alone(spark, chunk_table, tmp_path):
    path = str(tmp_path / "i")
    P.write(chunk_table, path, buckets=8)
    found = P.search(spark, path, "en", "cat", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term" in plan or "EqualTo(term" in plan
    files = P.live(spark, path)[0].filter("workspace = 'en'").filter(F.col("bucket") == P.bucket_of(F.lit("cat"), 8)).select(F.input_file_name()).distinct().collect()
    assert {f[0].split("bucket=")[1].split("/")[0] for f in files} == {str(spark.range(1).select(P.bucket_of(F.lit("cat"), 8)).first()[0])}


def test_reingest_and_compaction(spark, chunk_table, tmp_path):
    path = str(tmp_path / "i")
    P.write(chunk_table, path, buckets=4, block=5)
    fresh = [(1, "a", "en", "k1", "nothing now"), (20, "a", "en", "k1", "the cat anew")]
    assert P.replace(spark.createDataFrame(fresh, "chunk_id long, source_id string, workspace_id string, kb_id string, content string"), path) == 2
    left = [c for c in CHUNKS if c[1] != "a"] + fresh
    want = sorted((r[0] for r in scan(left, "en", "the cat")))
    assert sorted(r["chunk_id"] for r in P.search(spark, path, "en", "the cat", 99).collect()) == want
    # a generation without a note, as a run that failed leaves it, isn't read
    spark.read.parquet(f"{path}/blocks").limit(50).withColumn("part", F.lit("00000009-x")).write.mode("append").partitionBy("part", "workspace", "bucket").parquet(f"{path}/blocks")
    assert sorted(r["chunk_id"] for r in P.search(spark, path, "en", "the cat", 99).collect()) == want
    P.compacted(spark, path, str(tmp_path / "c"))
    assert sorted(r["chunk_id"] for r in P.search(spark, str(tmp_path / "c"), "en", "the cat", 99).collect()) == want
    with pytest.raises(ValueError):
        P.search(spark, path, "en", "cat", 5, rank="other")
