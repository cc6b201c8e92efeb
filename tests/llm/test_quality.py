"""Operator 1 against a plain computation: bins, naive Bayes and its calibration, priors' strengths, posteriors and scores."""

import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import op1_quality


def bins_of(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w]
    n, count = max(len(t), 1), max(len(words), 1)
    cap = lambda x: min(max(int(x), 0), 11)
    share = lambda of, scale: cap(math.ceil(sum(map(of, t)) / n * scale))
    return [
        share(str.isupper, 15),
        share(lambda c: c in "%&$#*@~^<>=_{}\\", 60),
        share(lambda c: c == "|", 100),
        share(lambda c: c == "!", 100),
        cap(math.floor((1 - len(set(words)) / count) * 12)),
        cap(n // count),
        cap(math.floor(math.log2(1 + count / (1 + t.count("\n"))))),
        cap(math.floor(math.log2(1 + count))),
    ]


def evidence_of(rows, labels):
    fit = [(bins_of(t), labels[i]) for i, t, *_ in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    good, bad = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    seen = defaultdict(lambda: [0, 0])
    for bins, y in fit:
        for f, b in enumerate(bins):
            seen[f, b][y] += 1
    rate = lambda k, n, both: (k + 2 * (both + 1) / (good + bad + 1)) / (n + 2)
    weight = {at: math.log(rate(g, good, g + b)) - math.log(rate(b, bad, g + b)) for at, (b, g) in seen.items()}
    raw = lambda bins: sum(weight.get((f, b), 0.0) for f, b in enumerate(bins))
    points = [(round(max(-40.0, min(40.0, raw(b))), 1), y) for b, y in fit]
    slope, shift = 0.5, 0.0
    for _ in range(60):  # Newton's method for the penalised logistic fit
        g0, g1, a, b, c = -0.1 * slope, -0.1 * shift, 0.1, 0.0, 0.1
        for x, y in points:
            p = 1 / (1 + math.exp(-(slope * x + shift)))
            g0, g1, a, b, c = g0 + x * (y - p), g1 + y - p, a + x * x * p * (1 - p), b + x * p * (1 - p), c + p * (1 - p)
        det = a * c - b * b
        slope, shift = slope + max(-2, min(2, (c * g0 - b * g1) / det)), shift + max(-2, min(2, (a * g1 - b * g0) / det))
    return [max(-12.0, min(12.0, slope * raw(bins_of(t)) + shift)) for _, t, *_ in rows]


def strength_of(families, within):
    """families: for each parent the lists of its groups' probabilities."""
    v = free = spread = 0.0
    for groups in families:
        if len(groups) > 1:
            n = sum(map(len, groups))
            mean = sum(map(sum, groups)) / n
            v += sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
            free += len(groups) - 1
            spread += n - sum(len(g) ** 2 for g in groups) / n
    return min(max(within / max((v - free * within) / spread, 1e-9), 1.0), 1e6) if free else 1e6


def scores_of(rows, evidence):
    p = [1 / (1 + math.exp(-e)) for e in evidence]
    by_path = defaultdict(list)
    for (_, _, host, path), x in zip(rows, p, strict=True):
        by_path[host or "", path or ""].append(x)
    by_host = defaultdict(list)
    for (host, _), xs in by_path.items():
        by_host[host].append(xs)
    mean = sum(p) / len(p)
    around = sum((x - sum(xs) / len(xs)) ** 2 for xs in by_path.values() for x in xs)
    within = max(around / max(sum(len(xs) - 1 for xs in by_path.values()), 1), 1e-6)
    k_host = strength_of([[[x for xs in groups for x in xs] for groups in by_host.values()]], within)
    k_path = strength_of(by_host.values(), within)
    out = []
    for (_, _, host, path), x, e in zip(rows, p, evidence, strict=True):
        all_host = [y for xs in by_host[host or ""] for y in xs]
        clip = lambda q: min(max(q, 1e-6), 1 - 1e-6)
        of_host = clip((sum(all_host) - x + k_host * mean) / (len(all_host) - 1 + k_host))
        xs = by_path[host or "", path or ""]
        of_path = clip((sum(xs) - x + k_path * of_host) / (len(xs) - 1 + k_path))
        out.append((of_host, of_path, 1 / (1 + math.exp(-(e + math.log(of_path / (1 - of_path)) - math.log(mean / (1 - mean)))))))
    return out


def made_rows():
    rng = random.Random(4)
    out = []
    for i in range(240):
        host, path = rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])
        good = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.5, None: 0.6}[host] * (0.5 if path == "x" else 1)
        words = [rng.choice("river stone wander calm light evening".split() if good else "BUY! NOW! $$$ win|win offer OFFER".split()) for _ in range(rng.randrange(5, 60))]
        out.append((i, rng.choice([" ", "\n"]).join(words), host, path))
    return out + [(300, None, "a", "x"), (301, "", "a", "x"), (302, " \n ", "lone", "p"), (5, out[5][1], "a", "x"), (5, "BUY! " * 400_000, "b", "y"), (None, "calm evening", None, None)]


def test_equals_a_plain_computation(spark):
    """Nulls, empty texts, repeated rows and ids, a text of megabytes, and columns named like the operator's own."""
    rows = made_rows()
    labels = {i: int("BUY" not in t and "$" not in t) for i, t, *_ in rows[:240]}
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").repartition(5)
    named = df.withColumns({"bins": F.lit("b"), "__words": F.lit(1), "p": F.lit(2), "evidence": F.lit(3), "a.b": F.lit(4), "quality": F.lit(9)})
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = op1_quality.assess(named, known, F.col("host"), F.col("path")).collect()
    evidence = evidence_of(rows, labels)
    want = sorted(((i is None, i or 0, h or "", p or "", e, *s) for (i, _, h, p), e, s in zip(rows, evidence, scores_of(rows, evidence), strict=True)))
    ours = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["host"], r["path"], r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]) for r in got)
    assert [w[:4] for w in want] == [o[:4] for o in ours]
    for w, o in zip(want, ours, strict=True):
        assert o[4:] == pytest.approx(w[4:], abs=1e-6)
    assert all(r["keep"] == (r["score"] >= 0.5) for r in got)


def test_spread_of_hosts_is_no_spread_of_paths(spark):
    """Paths that vary within their host as chance has it are shrunk wholly towards it, however far apart hosts lie."""
    rows = [(h, 20, 20 * (0.1 if h < 5 else 0.9)) for h in range(10) for _ in range(4)]
    groups = spark.createDataFrame(rows, "parent long, n long, s double")
    assert op1_quality.strength(groups, 0.02) == 1e6
    assert op1_quality.strength(groups.withColumn("parent", F.lit(0)), 0.02) < 2
    assert op1_quality.strength(groups.limit(0), 0.02) == op1_quality.strength(groups.limit(1), 0.02) == 1e6
