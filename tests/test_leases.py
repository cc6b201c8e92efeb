"""Claims under races, fencing, snapshots, and timers of silent sources."""

import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import leases as L

NOW = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
KIND = "source_id string, status string, heartbeat_at timestamp, processing_started_at timestamp, created_at timestamp"
later = lambda s: NOW + datetime.timedelta(seconds=s)


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([(x, "pending", None, None, later(-99)) for x in "abcdef"], KIND).withColumn("x.y", F.lit(1))


def outcomes(df):
    return {r["source_id"]: r["outcome"] for r in df.collect()}


def test_a_commit_is_created_once(spark, tmp_path):
    path = str(tmp_path / "c" / "1")
    assert L.create_once(spark, path, "a\n") and not L.create_once(spark, path, "b\n")
    assert open(path).read() == "a\n"
    won = []
    gate = threading.Barrier(8)

    def race(i):
        gate.wait()
        if L.create_once(spark, f"file://{tmp_path}/c/2", f"{i}\n"):
            won.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and open(tmp_path / "c" / "2").read() == f"{won[0]}\n"


def test_two_racing_runs_make_one_claim(spark, sources, tmp_path):
    log = L.Leases(spark, str(tmp_path / "log"))
    first = L.Leases.state
    gate, met = threading.Barrier(2, timeout=60), set()

    def together(self):
        got = first(self)
        if threading.get_ident() not in met:  # both read the same version before either commits
            met.add(threading.get_ident())
            gate.wait()
        return got

    found = {}
    racers = [type("Racing", (L.Leases,), {"state": together})(spark, log.path) for _ in range(2)]
    wanted = spark.createDataFrame([(x,) for x in ["a", "b", "b", "zz", None]], "source_id string")
    threads = [threading.Thread(target=lambda i=i: found.update({i: outcomes(racers[i].claim(sources, wanted, f"run{i}", NOW))})) for i in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    for x in "ab":
        assert sorted(found[i][x] for i in range(2)) == ["claimed", "refused"]
    assert all(found[i]["zz"] == "not found" for i in range(2))
    winner = next(i for i in range(2) if found[i]["a"] == "claimed")
    assert {r["source_id"]: r["run_id"] for r in log.state()[1].collect()} == {"a": f"run{winner}", "b": f"run{winner}"}


def test_lost_leases_are_fenced_and_snapshots_keep_the_state(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SNAPSHOT", 3)
    log = L.Leases(spark, str(tmp_path / "log"))
    wanted = sources.select("source_id")
    assert set(outcomes(log.claim(sources, wanted, "one", NOW)).values()) == {"claimed"}
    assert log.beat("two", later(5)).count() == 0
    assert log.beat("one", later(100)).count() == 6
    assert set(outcomes(log.claim(sources, wanted, "two", later(2400))).values()) == {"refused"}
    assert set(outcomes(log.claim(sources, wanted, "two", later(2600))).values()) == {"claimed"}  # 2500 s after the last sign of life
    ended = spark.createDataFrame([("a", "ready"), ("b", "failed")], "source_id string, status string")
    assert log.finish("one", ended, later(2601)).count() == 0
    assert log.finish("two", ended, later(2602)).count() == 2
    assert any(kind == "snapshot" for _, kind, _ in L.commits(spark, log.path))
    assert {r["source_id"]: (r["run_id"], r["status"]) for r in log.state()[1].collect()} == {"a": ("two", "ready"), "b": ("two", "failed"), **{x: ("two", "processing") for x in "cdef"}}
    assert outcomes(log.claim(sources, wanted.filter("source_id in ('a', 'c')"), "three", later(2603))) == {"a": "claimed", "c": "refused"}


def test_a_silent_source_returns_without_a_new_event(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    L.state_store(spark)
    try:
        kind = "source_id string, kind string, at timestamp"

        def put(*rows):
            spark.createDataFrame([(s, k, NOW) for s, k in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        put(("silent", "started"), ("silent", "beat"), ("done", "started"), (None, "started"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = L.silent_sources(stream, silence_seconds=20).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
        try:
            end, ended = time.time() + 90, False
            while time.time() < end and spark.table("silent").count() == 0:
                if not ended and q.recentProgress and any(p["numInputRows"] for p in q.recentProgress):
                    put(("done", "finished"))
                    ended = True
                time.sleep(0.3)
            time.sleep(3)
            assert [tuple(r) for r in spark.table("silent").collect()] == [("silent", "pending", 2)]
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
