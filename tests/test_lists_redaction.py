"""Redaction against its patterns applied one after another, lists of conversations, and equal contents of hits."""

import datetime
import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import catalog, retrieval


def test_redaction_equals_all_passes(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "@", "_", "%", ".com", "x.y@z", "1234 5678 9012 3456", "1234-567890123456", "+49 (30) 123-4567", "12345678", "123456789", "1234567890", "01.02.2003", "-", " ", "\n", "word", "(", ")", "7", "[email]", "1 2 3 4 5 6 7 8 9"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 9))) for _ in range(400)] + [None, "", "9" * 50_000, "a" * 2000 + "@", "a@b.com_x@c.de.f@g.hi"]

    def plain(t):
        for pattern, mark in X.REDACTIONS:
            t = re.sub(pattern, mark, t or "", flags=re.ASCII)
        return t or ""

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.redact(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [plain(t) for t in texts]
    long = "a" * 1_000_000 + "@" + "b" * 1_000_000  # a run is read once, not from each of its places
    assert spark.createDataFrame([(long,)], "t string").select(X.redact(F.col("t")) == F.col("t")).first()[0]


def test_places_are_those_of_each_owner_list(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("u", "a", at(1), None), ("u", "b", at(3), False), ("u", "c", at(2), True), ("u", "d", at(3), None), ("v", "e", at(9), None), (None, "f", at(1), True), ("u", "g", None, None)]
    df = spark.createDataFrame(rows, "user_id string, conversation_id string, created_at timestamp, pinned boolean")
    assert [r["conversation_id"] for r in catalog.conversation_list(df, "u").collect()] == ["c", "b", "d", "a", "g"]
    placed = {r["conversation_id"]: r["place"] for r in catalog.conversation_places(df).collect()}
    assert placed == {"c": 1, "b": 2, "d": 3, "a": 4, "g": 5, "e": 1, "f": 1}


def test_blank_hits_stay_and_equal_ones_go(spark):
    rows = [(0, "One  two"), (1, " "), (2, "one two"), (3, None), (4, "three"), (5, ""), (6, "ONE TWO "), (7, "blank 1")]
    kept = retrieval.dedupe_content(spark.createDataFrame(rows, "position int, content string"))
    want, seen = [], set()
    for position, content in rows:
        key = spark.createDataFrame([(content,)], "c string").select(X.content_hash(F.col("c"))).first()[0]
        if not (content or "").strip() or key not in seen:
            want.append(position)
        seen.add(key)
    assert sorted(r["position"] for r in kept.collect()) == want and kept.columns == ["position", "content"]
