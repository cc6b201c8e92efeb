"""Operators 11 to 13 against plain versions of their contracts: nulls, ties, repeated rows, long paths, hot groups, empty tables
and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillspark.llm import op11_trie, op12_sharding, op13_audit, ordered
from quillspark.llm import queries as q

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- places in an order


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordered_places(spark, partitions):
    rows = [(i % 5 if i % 3 else 2, i, i % 4 + 1) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = ordered.ordered(spark.createDataFrame(rows, "g long, i long, w long"), ["g", "i"], "g", "w", "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want, total, seen = [], 0, Counter()
    for n, (g, i, w) in enumerate(want_rows := sorted(rows)):
        total += w
        want.append((g, i, w, n, seen[g], n + 1 == len(rows) or want_rows[n + 1][0] != g, total))
        seen[g] += 1
    assert sorted((r["g"], r["i"], r["w"], r["row"], r["rank"], r["closing"], r["through"]) for r in got) == want


# --- 11


def trie(turns, family=5, heads=9):
    """The contract over (conv_id, turn, role, text), read plainly."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(own.get(c - c % family, [])[:h] + rows[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items()], key=repr)


TURNS = [
    *[(c, t, ["user", "assistant"][t % 2], f"same {t}") for c in range(0, 40) for t in range(c % 7)],
    *[(c, t, "user", f"{c % 3} {t}") for c in range(50, 75) for t in range(12)],
    *[(81, t, "user", "own") for t in range(9)],  # no base conversation
    *[(90, t, "user", f"long {t}") for t in range(70)],
    *[(91, t, "user", f"long {t}") for t in range(70)],
    *[(93, t, "user", f"long {t}" if t < 50 else "other") for t in range(64)],
    (100, None, None, None), (100, None, "user", "é"), (100, 3, "", ""), (100, 3, "", ""), (100, 3, "user", None), (101, 1, "user", "é"),
    (None, 0, "user", "nobody's"), (7, 0, "user", "again"), (7, 0, "user", "again"),
    *[(c, 0, "user", "hot") for c in range(1000, 1300)],
]


@pytest.mark.parametrize("block", [9, 16, 256])
def test_trie_contract(spark, block):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("x") for n in ("base", "part", "a.b", "digest", "j")}).repartition(5)
    assert rows_of(op11_trie.build(turns, block=block)) == trie(TURNS)


def test_trie_of_an_empty_table_and_bad_blocks(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op11_trie.build(none).count() == 0
    with pytest.raises(ValueError):
        op11_trie.build(none, block=8)


def test_digests_of_many_ends_stream_in_packs(spark, monkeypatch):
    monkeypatch.setattr(op11_trie, "PACK", 7)
    turns = spark.createDataFrame([(c, 0, "user", "one") for c in range(500)], "conv_id long, turn long, role string, text string")
    assert rows_of(op11_trie.build(turns)) == trie([tuple(r) for r in turns.collect()])


# --- 12


def walk(groups, capacity):
    """Greedy cuts over group sizes; a group beyond the capacity stands alone."""
    cuts, held, x = [], 0, 0
    for g in groups:
        if held and held + g > capacity:
            cuts.append(x)
            held = 0
        held, x = held + g, x + g
    return [*cuts, x] if groups else []


def brute_cuts(groups, shards):
    low, high = 0, sum(groups)
    while low < high:
        middle = (low + high) // 2
        if len(walk(groups, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low, walk(groups, low)


@pytest.mark.parametrize("blocks, shards", [(2, 3), (16, 10), (1 << 14, 10), (1 << 14, 1)])
def test_cuts_are_the_greedy_ones_at_the_least_capacity(spark, blocks, shards):
    for groups in ([16], [16] * 40, [20, 900, 17, 16, 5000, 30, 30] * 20, [i * i % 977 + 16 for i in range(500)], [16] * 100 + [90_000] + [40] * 100):
        ends = [(sum(groups[: i + 1]),) for i in range(len(groups))]
        assert op12_sharding.least_cuts(spark.createDataFrame(ends, "through long"), shards, blocks) == brute_cuts(groups, shards)


SHARDED = [(i, f"text {i % 37} " + "x" * (i * i % 911)) for i in range(300)] + [(i, "hot copy") for i in range(1000, 1200)] + [(None, "hot copy"), (None, "hot copy"), (5, None), (5, ""), (5, None), (9, "é🙂"), (9, "y" * 300_000)]


def test_shards_contract(spark, tmp_path):
    docs = spark.createDataFrame(SHARDED, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("size", "part", "digest", "copy", "a.b", "shard")}).repartition(6)
    got = op12_sharding.place(docs, blocks=32).collect()
    by_text = defaultdict(list)
    for i, t in SHARDED:
        by_text[hashlib.sha256((t or "").encode()).digest()].append((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    groups = [sum(r[2] for r in rows) for _, rows in sorted(by_text.items())]
    _, cuts = brute_cuts(groups, 40)
    want, through, shard, slot = [], 0, 0, 0
    for _, rows in sorted(by_text.items()):
        if shard < len(cuts) and through == cuts[shard]:
            shard, slot = shard + 1, 0
        for known, i, size, crc in sorted(rows):
            want.append((i if known else None, size, crc, shard, slot))
            slot, through = slot + 1, through + size
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert max(held.values()) == max(max(groups), brute_cuts(groups, 40)[0])

    cuts = op12_sharding.write(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect() if r["doc_id"] is not None) == sorted((r["doc_id"], r["shard"]) for r in got if r["doc_id"] is not None)
    assert back.count() == len(SHARDED) and len(cuts.digests) == len(cuts.ends) and {"a.b", "copy", "text"} <= set(back.columns)


def test_shards_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op12_sharding.place(none).count() == 0
    assert op12_sharding.shard(none, op12_sharding.plan(op12_sharding.in_order(none))).count() == 0


# --- 13


def failing(docs):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = (len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + 8 * bool(re.search("[#$%&*|]", t)) + 16 * (i is not None and i > least[t])
        yield i, part or "", bits


def audited(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    masks = list(failing(docs))
    out = {}
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone, kept = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                shares[x] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), sum(bool(m & bit) for _, m in own) - len(gone), sum(m == bit for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return sorted([(*k, *v) for k, v in out.items()], key=repr)


LONG = " ".join(f"w{i}" for i in range(3000))
AUDITED = [
    (1, "a b c", "en"), (2, "a b c", "de"), (2, "a b c", "de"), (3, "a b c", None), (None, "a b c", "en"), (None, "only null", "en"), (None, "only null", "en"),
    (4, None, "en"), (5, "", "en"), (6, "", None), (7, LONG, "en"), (8, LONG + "!", "en"), (9, LONG, "fr"), (10, LONG[:-1] + "x", "fr"), (11, LONG[:-1] + "x", "fr"),
    (12, "SHOUT " * 120, "en"), (13, "plain " * 120, "en"), (14, " ".join(f"d{i}" for i in range(100)), "en"), (15, " ".join(f"d{i}" for i in range(99)) + " # ", "en"),
    (16, "é\x0b🙂\x85\xa0 x", "es"), (17, "é\x0b🙂\x85\xa0 x", "es"), *[(i, "hot one", "en") for i in range(100, 400)], (50, "A" * 70 + "b", "en"), (51, "A" * 70 + "c", "en"), (52, "A" * 70 + "b", "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (9, 1, None), (None, 1, 1), (12, 0, 0), (150, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("hash_mask, slots", [(-1, op13_audit.SLOTS), (1, 1 << 16), (0, 1)])
def test_audit_contract(spark, hash_mask, slots):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string").withColumns({n: F.lit(1) for n in ("part", "class", "length", "a.b", "bits")}).repartition(4)
    found = op13_audit.failures(docs, hash_mask=hash_mask, slots=slots)
    assert rows_of(found) == sorted(failing(AUDITED), key=repr)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = op13_audit.audit(found, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert rows_of(got) == audited(AUDITED, LABELS)


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op13_audit.audit(op13_audit.failures(none), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).count() == 0
    assert op13_audit.failures(spark.createDataFrame([(1, "x", "en")], none.schema)).count() == 1


def test_audit_of_very_long_texts(spark):
    big = "word and " * 400_000
    docs = [(1, big, "en"), (2, big, "en"), (3, big + "x", "en")]
    assert rows_of(op13_audit.failures(spark.createDataFrame(docs, "doc_id long, text string, lang string"))) == sorted(failing(docs), key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_shards", "op13_filter_audit"])
def test_queries_match_sql(spark, name):
    import compare

    sf = "/root/testdata/sf0.001"
    assert compare.difference(spark, compare.connect(sf), name, q.QUERIES[name], q.ORACLES[name], sf) is None
