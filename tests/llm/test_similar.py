"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as p
import numpy as np
from quillspark.llm import graph, op5_simhash, similar
from quillspark.llm.common import FREED


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    """The least id of each component, by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    out = [None, "", "  ", "one two", "One  TWO", "one two three four five", "one two three four five six"]
    for k in range(40):  # a text, and copies with one to eight words changed: similarities from about 0.5 to 0.98
        base = [word() for _ in range(rng.choice([60, 120, 200, 300]))]
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(1, 9)):
                copy[at] = word()
            out.append(" ".join(copy))
    chain = [word() for _ in range(400)]
    out += [" ".join(chain[i : i + 150]) for i in range(0, 240, 8)]  # neighbours are alike, ends are not
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = dict(p.STAGES)["near_duplicates"](spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows)


def test_pairs_the_leader_does_not_link(spark, monkeypatch):
    """All classes in one bucket: its leader links few, the rest must still be compared."""
    monkeypatch.setattr(similar, "with_bands", lambda df, *how, f=similar.with_bands: f(df, *how).withColumn("bands", similar.F.expr("if(size > 0, array(1L), null)")))
    rows = texts()[:120]
    kept = op5_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=5, least=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows)


def test_index_of_operator_5_is_used(spark, monkeypatch):
    """Without any MinHash bucket, what its index links is compared exactly: near copies go, texts alike in bits alone stay."""
    monkeypatch.setattr(similar, "with_bands", lambda df, *how, f=similar.with_bands: f(df, *how).withColumn("bands", similar.F.expr("cast(null as array<bigint>)")))
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(base[:100])), (4, " ".join(base * 2))]  # 4 has the shingles of 1 and a few more
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in op5_simhash.keep_one(df, words=5, least=0.8).collect()) == brute(rows) == [1, 3]
    twice = [(1, " ".join(base[:200] * 20 + base[200:400])), (2, " ".join(base[:200] * 20 + base[400:600]))]  # nearly one fingerprint, half the set
    kept = op5_simhash.keep_one(spark.createDataFrame(twice, "doc_id long, text string"), words=5, least=0.8, max_diff=20)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(twice) == [1, 2]


def test_nodes_beyond_the_limit(spark, monkeypatch):
    """One bucket for all classes, dealt to dozens of blocks at both steps: no pair is lost, whatever the size of its node."""
    monkeypatch.setattr(similar, "with_bands", lambda df, *how, f=similar.with_bands: f(df, *how).withColumn("bands", similar.F.expr("if(size > 0, array(1L), null)")))
    monkeypatch.setattr(similar, "NODE_SHINGLES", 2000)
    rows = texts()
    kept = op5_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=5, least=0.8, node_limit=16)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows)


def test_each_pair_of_a_node_has_a_cell(spark):
    rows = spark.createDataFrame([(b, f, f, 10) for b, n in ((1, 40), (2, 3)) for f in range(n)], "bucket long, fingerprint long, component long, size long")
    held = {}
    for r in similar.cells(rows, 50).collect():
        held.setdefault((r["bucket"], r["low"], r["high"]), set()).add(r["fingerprint"])
    for bucket, n in ((1, 40), (2, 3)):
        mine = [c for (b, *_), c in held.items() if b == bucket]
        assert all(any({x, y} <= c for c in mine) for x in range(n) for y in range(x))
    assert sum(b == 2 for b, *_ in held) == 1 < max(len(c) for c in held.values()) < 40


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    """Disk is that of the largest step, not the sum of all: only the last step, which the caller runs, may still hold files."""
    df = spark.createDataFrame(texts()[:120], "doc_id long, text string").repartition(4)
    before = shuffle_files(spark)
    kept = op5_simhash.keep_one(df, words=5, least=0.8)
    assert not shuffle_files(spark) - before
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(texts()[:120])
    assert spark.conf.get(FREED) == "false"


def test_a_round_of_components_has_few_tasks(spark, monkeypatch):
    """The edges of a round are read in few tasks and exchanged twice, however many partitions a shuffle has."""
    before, parts = spark.conf.get("spark.sql.shuffle.partitions"), 60
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    tracker, rounds = spark.sparkContext.statusTracker(), []
    monkeypatch.setattr(graph, "stored", lambda *a, f=graph.stored: rounds.append(1) or f(*a))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 900) if i % 30 != 29], "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = graph.connected_components(edges).collect()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert {r["id"]: r["component"] for r in got} == {i: i - i % 30 for i in range(900)} and len(got) == 900
    assert tasks <= 5 * parts * len(rounds)


def test_components_of_any_graph(spark):
    rng = random.Random(11)
    for n, m in ((1, 0), (40, 25), (60, 60), (50, 200)):
        pairs = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)]
        root = {x: x for p in pairs for x in p if p[0] != p[1]}
        for _ in root:
            for a, b in pairs:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        got = graph.connected_components(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()
        assert len(got) == len(root) and {r["id"]: r["component"] for r in got} == root


def test_overlaps_in_pieces(monkeypatch):
    rng = random.Random(2)
    sets = [np.array(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(50)]
    want = {(i, j, len(set(a.tolist()) & set(b.tolist()))) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    for at_once in (1, 500, 1 << 22):
        monkeypatch.setattr(similar, "AT_ONCE", at_once)
        got = {t for piece in similar.overlaps(sets) for t in zip(*(x.tolist() for x in piece), strict=True)}
        assert got == {t for t in want if t[2]}
