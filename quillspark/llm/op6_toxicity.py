"""Toxicity by compression distance.

Training texts are grouped by the profile of their letter trigrams, by text alone, around centres of the ordinary ones: languages and
registers come apart without being named. Each group with toxic texts of its own has a pair of zstandard dictionaries. The ordinary one is trained on the group's
ordinary texts; the toxic one holds the same, and what is trained on the toxic texts' passages that set them apart: word
parts whose letter grams they use at least `CONTRAST` times as often as the group's ordinary texts do, beyond chance, in
a good share of the toxic texts. Both are of one length, so a window's distance, its compressed length under the ordinary
dictionary less that under the toxic one, shows that part alone. (A toxic dictionary trained on whole toxic texts finds little, as most of
such a text is ordinary; README.)

A text goes to the group nearest to its profile. It is cut into windows of one word each, between paddings that both dictionaries
hold. Thresholds on the distance are calibrated by the window's length: a (distance, length) cell that toxic texts show clearly more
often counts with the log of how much more. The score is a logistic function, fitted on the group's training rows, of
the cells' sum over a power of the window count.

Training rows are a bounded sample of the labelled rows outside the held-out fold: the MAX_TOXIC and MAX_ORDINARY
first by a hash of the id, at most max_chars characters a class. Scores use the text alone; whole texts are scored,
without a shuffle. Columns called score or predicted are replaced.

Defined cases: null, empty and wordless texts go to the first group, with a sum of 0 and the score that follows; without training rows
of both classes every score is 0; where no group has `LEAST_TOXIC` toxic texts, all texts are one group; rows are scored each for itself, so
repeated rows and ids with several texts get a row each; null labels aren't learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_by_text, held_out, with_text_columns

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, MAX_PIECES = 1500, 3000, 24_000_000, 20_000
GROUPS, LEAST_TOXIC, PROFILE = 6, 12, 512
CONTRAST, BEYOND_CHANCE, SHARE = 4, 5.0, 0.3  # times as often; standard deviations; share of the group's toxic texts
CELL_THRESHOLD = 1.0  # a cell counts if toxic documents show it e times as often
POWER = 0.65
GRAM, START = 5, 4
DICT_BYTES = 8192
SAMPLE_BYTES = 16
THRESHOLD = 0.7
CACHED_WORDS = 100_000
HEAD, TAIL = b"~|window of words|~", b"0123456789"
WORD = re.compile(r"[^\W\d_]+")
ZSTD = dict(window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
DISTANCES, LENGTHS, SHIFT = 40, 20, 15


@dataclass
class Group:
    centre: np.ndarray  # unit profile
    ordinary: bytes
    toxic: bytes
    cells: np.ndarray  # log likelihood ratio by distance and word length
    slope: float
    intercept: float


@dataclass
class Model:
    groups: list[Group]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Windows:
    """Cells of the windows of texts under two dictionaries; a word's cell is computed once while it is cached."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compress = []
        for content in (ordinary, toxic):
            params = zstandard.ZstdCompressionParameters(**ZSTD)
            d = zstandard.ZstdCompressionDict(content + TAIL + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        self.cache: dict[str, int] = {}

    def cell(self, word: str) -> int:
        raw = word.encode()
        window = HEAD + b" " + raw + b" " + TAIL
        distance = len(self.compress[0](window)) - len(self.compress[1](window))
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        found = self.cache[word] = min(max(distance + SHIFT, 0), DISTANCES - 1) * LENGTHS + min(len(raw), LENGTHS - 1)
        return found

    def cells(self, words: Sequence[str]) -> np.ndarray:
        known = self.cache.get
        return np.array([c if (c := known(w)) is not None else self.cell(w) for w in words], dtype=np.int64)


def evidence(windows: Windows, cells: np.ndarray, words: Sequence[str]) -> float:
    at = windows.cells(words)
    return float(cells[at].sum() / len(at) ** POWER) if len(at) else 0.0


def profile(words: Sequence[str]) -> np.ndarray:
    """Roots of the counts of hashed byte trigrams, as a unit vector; zeros for a text without any."""
    a = np.frombuffer(" ".join(words).encode(), np.uint8).astype(np.uint64)
    if len(a) < 3:
        return np.zeros(PROFILE)
    hashed = ((a[:-2] << np.uint64(16) | a[1:-1] << np.uint64(8) | a[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    counts = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=PROFILE))
    return counts / np.linalg.norm(counts)


def grouped(profiles: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centres of at most k groups of unit profiles, by spherical k-means from far starts; the same for the same rows."""
    rng = np.random.default_rng(0)
    filled = profiles[np.linalg.norm(profiles, axis=1) > 0]
    if not len(filled):
        return np.zeros((1, PROFILE))
    centres = filled[[rng.integers(len(filled))]]
    while len(centres) < k:
        far = np.maximum(1 - (filled @ centres.T).max(axis=1), 0) ** 2
        if far.sum() < 1e-9:
            break
        centres = np.concatenate([centres, filled[[rng.choice(len(filled), p=far / far.sum())]]])
    for _ in range(rounds):
        own = (filled @ centres.T).argmax(axis=1)
        sums = np.array([filled[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def grams_of(word: str) -> list[str]:
    """The word's grams, its edges counted as spaces, and its start, which is shorter."""
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)] + ([padded[:START]] if len(padded) > START else [])


def runs_of(word: str, chosen: set[str]) -> list[str]:
    """The parts of a word that chosen grams cover."""
    padded = f" {word} "
    ends = [(i, i + GRAM) for i in range(len(padded) - GRAM + 1) if padded[i : i + GRAM] in chosen]
    if padded[:START] in chosen and len(padded) > START:
        ends.insert(0, (0, START))
    out: list[list[int]] = []
    for a, b in ends:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [padded[a:b] for a, b in out]


def samples_of(parts: Iterable[bytes]) -> list[bytes]:
    """Successive parts joined to samples of SAMPLE_BYTES at least, as the trainer passes over shorter ones."""
    out, held = [], b""
    for part in parts:
        held += (b"|" if held else b"") + part
        if len(held) >= SAMPLE_BYTES:
            out.append(held)
            held = b""
    return [*out, held] if held else out


def dictionary(samples: list[bytes], k: int) -> bytes:
    """A trained dictionary of DICT_BYTES, or of a quarter of the samples where they are fewer. The trainer refuses less than
    about eight samples: those few are the dictionary, whole."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(512, sum(map(len, samples)) // 4)), samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"|".join(samples)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge as classes may be separable."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - np.array([1e-2, 0]) * beta
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def set_apart(toxic: Sequence[Sequence[str]], ordinary: Sequence[Sequence[str]]) -> set[str]:
    """The grams that toxic texts use more often than ordinary ones, beyond chance, in a share of the texts."""
    counts = [Counter(g for words in texts for w in set(words) for g in grams_of(w)) for texts in (toxic, ordinary)]  # a word counts once a text
    held = Counter(g for words in toxic for g in {g for w in set(words) for g in grams_of(w)})
    totals = [max(sum(c.values()), 1) for c in counts]
    out = set()
    for g, n in counts[0].items():
        likewise = counts[1][g] * totals[0] / totals[1]
        expected = (n + counts[1][g]) * totals[0] / sum(totals)
        if held[g] >= max(3, SHARE * len(toxic)) and n >= CONTRAST * likewise and n - expected >= BEYOND_CHANCE * expected**0.5:
            out.add(g)
    return out


def group_of(centre: np.ndarray, toxic: Sequence[Sequence[str]], ordinary: Sequence[Sequence[str]], max_pieces: int) -> Group:
    """The group's dictionaries, cells and logistic function, from its texts as words."""
    chosen = set_apart(toxic, ordinary)
    own = {w: runs_of(w, chosen) for words in (*toxic, *ordinary) for w in set(words)}
    apart = samples_of("|".join(runs).encode() for words in toxic if (runs := [r for w in dict.fromkeys(words) for r in own[w]]))
    lines = [" ".join(w for w in words if not own[w]).encode() for words in ordinary]
    plain = [piece for line in lines for piece in (line[i : i + 256] for i in range(0, len(line), 256)) if len(piece) > 12]
    shared, added = dictionary(plain[:: max(1, len(plain) // max_pieces)], 64), dictionary(apart, 32)
    group = Group(centre, shared + b"#" * len(added), shared + added, np.zeros(DISTANCES * LENGTHS), 0.0, 0.0)
    windows = Windows(group.ordinary, group.toxic)
    counts = [sum((np.bincount(windows.cells(words), minlength=DISTANCES * LENGTHS) for words in texts), np.zeros(DISTANCES * LENGTHS)) for texts in (toxic, ordinary)]
    totals = np.array([max(c.sum(), 1) for c in counts])
    smooth = 3 * totals / totals.sum()
    ratio = np.log((counts[0] + smooth[0]) / totals[0]) - np.log((counts[1] + smooth[1]) / totals[1])
    group.cells = np.where(ratio >= CELL_THRESHOLD, ratio, 0.0)
    x = np.array([evidence(windows, group.cells, words) for words in (*toxic, *ordinary)])
    group.slope, group.intercept = fit_logistic(x, np.array([1] * len(toxic) + [0] * len(ordinary)))
    return group


def train_on(toxic: Sequence[str], ordinary: Sequence[str], max_pieces: int = MAX_PIECES) -> Model | None:
    """The model of these texts. An ordinary dictionary is trained on max_pieces pieces of 256 bytes, evenly spaced."""
    words = [[words_of(t) for t in sorted(set(texts))] for texts in (toxic, ordinary)]
    if not words[0] or not words[1]:
        return None
    profiles = [np.array([profile(w) for w in texts]) for texts in words]
    centres = grouped(profiles[1], GROUPS)  # ordinary texts tell the groups, so no group is one of toxic texts alone
    toxic_at, ordinary_at = ((p @ centres.T).argmax(axis=1) for p in profiles)
    kept = [i for i in range(len(centres)) if (toxic_at == i).sum() >= LEAST_TOXIC and (ordinary_at == i).any()]
    centres = centres[kept] if kept else np.zeros((1, PROFILE))
    toxic_at, ordinary_at = ((p @ centres.T).argmax(axis=1) for p in profiles)
    return Model([group_of(c, [w for w, i in zip(words[0], toxic_at, strict=True) if i == g], [w for w, i in zip(words[1], ordinary_at, strict=True) if i == g], max_pieces) for g, c in enumerate(centres)])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> Model | None:
    """A model from labels (doc_id, toxic) outside the held-out fold. The sample's ids come from the labels alone: at most
    max_toxic + max_ordinary, which are broadcast to find their texts. A class whose texts exceed max_chars goes on with
    those that still fit. An id with labels of both kinds counts as toxic; an id with several texts learns from each."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for kind, most in ((1, max_toxic), (0, max_ordinary)):
        part = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    held: dict[int, list[str]] = {0: [], 1: []}
    room = {0: max_chars, 1: max_chars}
    for row in texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).toLocalIterator():  # keys without texts: Spark samples them to the driver
        if len(row["text"]) <= room[row["toxic"]]:
            room[row["toxic"]] -= len(row["text"])
            held[row["toxic"]].append(row["text"])
    return train_on(held[1], held[0])


def scorer(model: Model | None):
    """A function from texts to scores."""
    if model is None:
        return lambda texts: [0.0] * len(texts)
    centres = np.array([g.centre for g in model.groups])
    windows = [Windows(g.ordinary, g.toxic) for g in model.groups]

    def score_of(text: str | None) -> float:
        words = words_of(text)
        at = int((centres @ profile(words)).argmax()) if len(centres) > 1 else 0
        group = model.groups[at]
        return float(1 / (1 + np.exp(-np.clip(group.slope * evidence(windows[at], group.cells, words) + group.intercept, -30, 30))))

    return lambda texts: [score_of(t) for t in texts]


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds `score` and `predicted`."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a small table a group

    def make():
        scores = scorer(shared.value)
        return lambda texts: {"score": scores(texts)}

    return with_text_columns(df, text_col, [T.StructField("score", T.DoubleType())], make).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with the columns of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = scorer(shared.value)
        return lambda texts: [s < THRESHOLD for s in scores(texts)]

    return filter_by_text(df, text_col, make)
