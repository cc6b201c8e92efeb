"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from strict patterns (the base kinds email, ip, card, phone) and loose ones (contact: a
spelled-out address, number: a number in groups without a country code, ssn, iban). Four labelers vote on each:

* regex: the strict form holds (octets, Luhn, digit counts);
* gazetteer: a listed domain ending, country code, card issuer or private network begins or ends it;
* context: a cue word of the kind stands within the 40 characters before it;
* bounds: it isn't part of a longer word or number.

Counts of (kind, votes, length class), a bounded table, go through expectation-maximisation: a prior per kind and
each labeler's hit and false-alarm rates. The soft labels train the final classifier, a log-linear model over kind,
votes and length class; a candidate whose posterior reaches `ACCEPT` is a span. Base spans always stay.

Places are code points, ends exclusive. `mask` replaces spans in the text by [KIND].

Defined cases: a null text counts as empty, and stays null when masked; repeated rows each get a row; without
candidates the prior stands; overlapping spans of different kinds are both reported and masked as one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "contact", "number", "ssn", "iban")
# Fixed patterns of the base kinds, anchored where a run starts or the last match ended, so that a long run is
# read once; possessive groups can't overflow the stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # of the runs of digits only those of 13 and more: a shorter one can't be a card, and most numbers in a text are such
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "number": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "phone": "+", "contact": "at"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FORMS = {
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$",
    "contact": r"[A-Za-z]{2,}$",
    "number": r"^\(?[2-9]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^[A-Z]{2}(?!0[01]|99)[0-9]{2}",
}
# Gazetteers and cue words.
LISTED = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us)$",
    "ip": r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|169\.254|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "contact": r"(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us)$",
    "number": r"^\(?[2-9][0-9]{2}",
    "ssn": r"^[0-7]",
    "iban": r"^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|PT|PL|SE|NO|DK|FI|IE|LU)",
}
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse|servidor|serveur",
    "card": "card|visa|credit|karte|tarjeta|carte|payment",
    "phone": "phone|call|tel|mobile|fax|handy|móvil|appel",
    "contact": "mail|contact|write|kontakt|correo|courriel",
    "number": "phone|call|tel|mobile|fax|handy|móvil|appel",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|cuenta|compte",
}
VOTES = ("regex", "gazetteer", "context", "bounds")
SIZES = 5  # length classes
ACCEPT = 0.9
ROUNDS = 30
CHUNK = 256
FAR = 1 << 34
#: characters of a piece from which mask() takes what stands between spans
PIECE = 20_000


PLACE = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"


def running(values: str, zero: str, op: str) -> str:
    """SQL for what op, of {u} and {w}, makes of zero and all values before each value of a non-empty array. op is associative;
    values are folded in chunks, as appending copies what a fold holds: linear for any text that a row can hold."""

    def before(x: str, start: str) -> str:
        step = op.format(u="acc.at", w="v")
        return f"aggregate({x}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (acc, v) -> named_struct('at', {step}, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"

    chunks = f"transform(sequence(0, cast(floor((size(x) - 1) / {CHUNK}) as int)), k -> slice(x, k * {CHUNK} + 1, {CHUNK}))"
    totals = f"transform(t, y -> aggregate(y, {zero}, (u, w) -> {op.format(u="u", w="w")}))"
    folded = f"flatten(zip_with(t, {before(totals, zero)}, (c, z) -> {before('c', 'z')}))"
    return f"transform(array({values}), x -> transform(array({chunks}), t -> {folded})[0])[0]"


def matches(text: str, pattern: str, need: str | None) -> Column:
    """Array of (start, end, match, 40 characters before, character after) of the leftmost non-overlapping matches in the column
    `text`, from the matches and what splits them. What stands before reaches back to the last match but one."""
    found = f"regexp_extract_all({text}, r'{pattern}', 0)"
    if need:
        found = f"if(contains({text}, '{need}'), {found}, cast(array() as array<string>))"
    starts = running("zip_with(slice(b.gaps, 1, size(b.ms)), b.ms, (g, m) -> cast(length(g) + length(m) as bigint))", "0L", "{u} + {w}")
    place = """named_struct(
        'start', get(s.starts, i) + length(get(s.gaps, i)),
        'end', get(s.starts, i) + length(get(s.gaps, i)) + length(m),
        'match', m,
        'before', right(concat(coalesce(get(s.gaps, i - 1), ''), coalesce(get(s.ms, i - 1), ''), get(s.gaps, i)), 40),
        'after', left(concat(get(s.gaps, i + 1), coalesce(get(s.ms, i + 1), '')), 1))"""
    placed = f"""transform(transform(array(named_struct('gaps', split({text}, r'{pattern}', -1), 'ms', f)),
        b -> named_struct('gaps', b.gaps, 'ms', b.ms, 'starts', {starts})), s -> transform(s.ms, (m, i) -> {place}))[0]"""
    return F.expr(f"transform(array({found}), f -> if(size(f) > 0, {placed}, cast(array() as {PLACE})))[0]")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(x)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substring(x, n - i + 1, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("even")))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v["even"], F.when(v["d"] > 4, 2 * v["d"] - 9).otherwise(2 * v["d"])).otherwise(v["d"]))
    return (n > 0) & (total % 10 == 0)


def form_holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "card":
        d = digits(match)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return match.rlike(FORMS[kind])


def with_candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `candidates`: array of (kind, start, end, base, votes as four 0/1, length class), by kind as listed, then start."""
    kinds = {**STRICT, **LOOSE}
    found = df.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumns({f"__{k}": matches("__text", p, NEEDS.get(k)) for k, p in kinds.items()})

    def judged(kind: str) -> Column:
        def one(x: Column) -> Column:
            before, last, after = F.lower(x["before"]), F.right(x["before"], F.lit(1)), x["after"]
            holds = form_holds(kind, x["match"])
            as_vote = lambda c: F.coalesce(c, F.lit(False)).cast("int")
            return F.struct(
                F.lit(kind).alias("kind"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                (F.lit(kind in BASE_KINDS) & holds).alias("base"),
                as_vote(holds).alias("regex"),
                as_vote(x["match"].rlike(LISTED[kind])).alias("gazetteer"),
                as_vote(before.rlike(CUES[kind])).alias("context"),
                as_vote(~last.rlike(r"[\p{L}\p{N}_]") & ~after.rlike(r"[\p{L}\p{N}_]")).alias("bounds"),
                F.least(F.length(x["match"]) / 8, F.lit(4)).cast("int").alias("size"),
            )

        return F.transform(F.filter(F.col(f"__{kind}"), lambda x: F.length(digits(x["match"])) <= 19) if kind == "card" else F.col(f"__{kind}"), one)

    strict = F.concat(*[judged(k) for k in STRICT])
    out = found.withColumn("candidates", strict)
    out = out.withColumn("__base", F.filter("candidates", lambda x: x["base"])).withColumn("__loose", F.concat(*[judged(k) for k in LOOSE]))
    loose = F.when(F.size("__loose") > 0, clear_of_base("__base", "__loose")).otherwise(F.col("__loose"))
    return out.withColumn("candidates", F.concat("candidates", loose)).drop("__text", "__base", "__loose", *[f"__{k}" for k in kinds])


def clear_of_base(base: str, loose: str) -> Column:
    """The loose candidates that overlap no base span, by kind, then start. In the order of starts, no base span ahead ends
    after their start and the next base span starts at their end or later."""
    key = "named_struct('start', c.start, 'own', {}, 'end', c.end, 'of', c)".format
    both = f"array_sort(concat(transform({base}, c -> {key(0)}), transform({loose}, c -> {key(1)})))"
    ends = running("transform(o, n -> if(n.own = 0, n.end, 0L))", "0L", "greatest({u}, {w})")
    starts = running(f"reverse(transform(o, n -> if(n.own = 0, n.start, {FAR}L)))", f"{FAR}L", "least({u}, {w})")
    seen = f"zip_with(zip_with(o, {ends}, (d, e) -> named_struct('d', d, 'reach', e)), reverse({starts}), (d, e) -> named_struct('d', d.d, 'reach', d.reach, 'next', e))"
    free = f"filter({seen}, q -> q.d.own = 1 and q.reach <= q.d.start and q.next >= q.d.end)"
    rank = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    return F.expr(f"transform(array_sort(transform(transform(array({both}), o -> {free})[0], q -> named_struct('rank', case q.d.of.kind {rank} end, 'start', q.d.start, 'of', q.d.of))), q -> q.of)")


@dataclass
class Model:
    kind: dict[str, float]  # log odds of the kind
    vote: list[tuple[float, float]]  # added log odds of a vote 0, 1
    size: list[float]  # added log odds of a length class


def vote_counts(candidates: DataFrame) -> list[tuple]:
    """Counts by (kind, votes, length class): at most 8 * 16 * 5 rows."""
    x = candidates.select(F.explode("candidates").alias("c")).select("c.kind", *[f"c.{v}" for v in VOTES], "c.size")
    return [tuple(r) for r in x.groupBy("kind", *VOTES, "size").count().collect()]


def train(counts: Sequence[tuple]) -> Model:
    """Reliabilities by expectation-maximisation over the vote counts, then the log-linear classifier of its soft labels."""
    prior = dict.fromkeys(KINDS, 0.5)
    hit, alarm = [0.9] * len(VOTES), [0.2] * len(VOTES)
    soft: list[float] = []
    for _ in range(ROUNDS):
        soft = []
        for kind, *rest in counts:
            yes, no = prior[kind], 1 - prior[kind]
            for v, h, a in zip(rest[: len(VOTES)], hit, alarm, strict=True):
                yes, no = yes * (h if v else 1 - h), no * (a if v else 1 - a)
            soft.append(yes / (yes + no))
        for kind in KINDS:
            n = [(c[-1], s) for c, s in zip(counts, soft, strict=True) if c[0] == kind]
            prior[kind] = (sum(k * s for k, s in n) + 1) / (sum(k for k, _ in n) + 2)
        for j in range(len(VOTES)):
            pos, neg = sum(c[-1] * s for c, s in zip(counts, soft, strict=True)), sum(c[-1] * (1 - s) for c, s in zip(counts, soft, strict=True))
            # pseudo-counts keep each labeler better than chance, so the classes can't change places
            hit[j] = max(0.5, (sum(c[-1] * s * c[1 + j] for c, s in zip(counts, soft, strict=True)) + 9) / (pos + 10))
            alarm[j] = min(0.5, (sum(c[-1] * (1 - s) * c[1 + j] for c, s in zip(counts, soft, strict=True)) + 2) / (neg + 10))
    return classifier(counts, soft)


def classifier(counts: Sequence[tuple], soft: Sequence[float]) -> Model:
    """The log-linear span classifier: a logistic regression of the soft labels on kind, votes and length class, by Newton steps
    over the count table with a ridge, which stands for the prior where nothing was seen."""
    x = np.zeros((len(counts), len(KINDS) + len(VOTES) + SIZES))
    for row, (kind, *rest) in zip(x, counts, strict=True):
        row[KINDS.index(kind)] = 1
        row[len(KINDS) : len(KINDS) + len(VOTES)] = [2 * v - 1 for v in rest[: len(VOTES)]]
        row[len(KINDS) + len(VOTES) + rest[len(VOTES)]] = 1
    n, y, beta = np.array([c[-1] for c in counts], float), np.array(soft, float), np.zeros(x.shape[1])
    for _ in range(ROUNDS if len(counts) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)), x.T @ (n * (y - p)) - beta)
        beta += np.clip(step, -3, 3)
    kind, vote, size = np.split(beta, [len(KINDS), len(KINDS) + len(VOTES)])
    return Model(dict(zip(KINDS, kind.tolist(), strict=True)), [(-v, v) for v in vote.tolist()], size.tolist())


def accepted(candidates: Column, model: Model) -> Column:
    """The candidates that are spans: base ones and those whose posterior reaches ACCEPT, with base marked."""
    least = math.log(ACCEPT / (1 - ACCEPT))

    def logit(x: Column) -> Column:
        total = F.lit(0.0)
        for k, w in model.kind.items():
            total = F.when(x["kind"] == k, F.lit(w)).otherwise(total)
        for v, (no, yes) in zip(VOTES, model.vote, strict=True):
            total = total + F.when(x[v] == 1, F.lit(yes)).otherwise(F.lit(no))
        for i, w in enumerate(model.size):
            total = total + F.when(x["size"] == i, F.lit(w)).otherwise(F.lit(0.0))
        return total

    return F.filter(candidates, lambda x: x["base"] | (logit(x) >= least))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, base), by kind as listed, then start. One pass over the
    texts; the candidates are checkpointed, the model is learned from them, then applied."""
    rows = checkpointed(with_candidates(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).select("doc_id", "candidates"))
    model = train(vote_counts(rows))
    return rows.select("doc_id", F.transform(accepted(F.col("candidates"), model), lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"])).alias("spans"))


def between(pieces: str, a: str, b: str) -> str:
    """SQL for the characters from a to b of a text cut into pieces of PIECE: a place in a long text is only found by walking
    there."""
    first, last = (f"least(cast(floor({x} / {PIECE}) as int), size({pieces}) - 1)" for x in (a, b))
    into = f"cast({a} - {first} * {PIECE} + 1 as int)"
    one = f"substring(get({pieces}, {first}), {into}, cast(least(greatest({b} - {a}, 0L), {PIECE}) as int))"
    inner = f"array_join(slice({pieces}, {first} + 2, greatest({last} - {first} - 1, 0)), '')"
    more = f"concat(substring(get({pieces}, {first}), {into}, {PIECE}), {inner}, substring(get({pieces}, {last}), 1, cast(least({b} - {last} * {PIECE}, {PIECE}) as int)))"
    return f"if({first} = {last}, {one}, {more})"


def mask(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with every span in the text replaced by [KIND]; the character count, if there, follows. Two passes over the
    texts: one for the vote counts, one that masks."""
    model = train(vote_counts(with_candidates(df.select(F.col(f"`{text_col}`").alias("text")))))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    spans = F.array_sort(F.transform(accepted(F.col("candidates"), model), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    reach = running("transform(spans, n -> n.end)", "0L", "greatest({u}, {w})")
    pieces = f"transform(sequence(0, cast(floor(length(text) / {PIECE}) as int)), k -> substring(text, k * {PIECE} + 1, {PIECE}))"
    fresh = "filter(zip_with(f.spans, f.reach, (d, e) -> named_struct('s', d, 'r', e)), d -> d.s.start >= d.r)"
    parts = f"transform({fresh}, d -> concat({between('f.pieces', 'd.r', 'd.s.start')}, '[', upper(d.s.kind), ']'))"
    rest = between("f.pieces", "array_max(transform(f.spans, n -> n.end))", f"{FAR}L")
    folded = F.expr(f"transform(array(named_struct('spans', spans, 'reach', {reach}, 'pieces', {pieces})), f -> concat(array_join({parts}, ''), {rest}))[0]")
    done = with_candidates(packed).withColumn("spans", spans).withColumn("masked", F.when(F.size("spans") > 0, folded).otherwise(F.col("text")))
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(F.col("masked").alias(c))
        elif c == chars_col:
            out.append(F.when(F.size("spans") > 0, F.length("masked").cast(df.schema[c].dataType)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return done.select(*out)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
