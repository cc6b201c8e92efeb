"""Intents, places, media choices, full texts, expansion, claims and turns: known results and brute-force versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark import seams
from quillspark.operators import fulltext, intents, media, people, places, retrieval, structure
from quillspark.streaming import jobs

SEGMENTS = "source_id string, document_id int, page_no int, start_ms int, text string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("message", "want"),
    [("What FILES are here", (True, False, False, False)), ("نام ببر", (False, False, False, False)), ("نام ببر کدام سند", (True, False, False, False)), ("Send it", (False, True, False, False)), (" Continue ", (False, False, False, True)), ("continue with " + "x" * 40, (False, False, False, False)), ("please TRANSLATE", (False, False, True, False)), (None, (False,) * 4), ("", (False,) * 4)],
)
def test_intents(spark, message, want):
    x = F.col("x")
    assert tuple(one(spark, F.array(intents.wants_list(x), intents.wants_verbatim(x), intents.wants_translation(x), intents.wants_more(x)), message)) == want


@pytest.fixture(scope="module")
def library(spark):
    files = spark.createDataFrame([("a", "Annual Summary.docx"), ("b", "Other notes.txt"), ("c", None)], "source_id string, filename string")
    segments = spark.createDataFrame([("a", 1, 2, 0, "second"), ("a", 1, 1, 0, " first "), ("a", 1, 3, 0, "  "), ("a", 1, 4, 0, None), ("b", 2, 1, 0, "x" * 40)], SEGMENTS)
    return files, segments


def test_named_file(spark, library):
    row = intents.named_file_text(*library, "read the annual summary").first()
    assert (row["source_id"], row["text"], row["truncated"]) == ("a", "first\n\nsecond", False)
    assert intents.named_file_text(*library, "nothing of that name").count() == 0
    cut = intents.named_file_text(*library, "other", cap=10).first()
    assert cut["text"] == "x" * 10 + intents.CUT_MARK and cut["truncated"]


def test_verbatim_answer(library):
    assert intents.verbatim_answer(*library, "send it: annual summary").first()["text"] == "first\n\nsecond"
    assert intents.verbatim_answer(*library, "what does the annual summary say").count() == 0
    assert intents.verbatim_answer(*library, "send it: other", cap=5).first()["text"] == "xxxxx"


def test_capped_text_takes_what_matters(spark):
    rows = [("s", 1, i, 0, "ab"[i % 2] * (i % 3)) for i in range(500)]
    whole = "\n\n".join(t for *_, t in rows if t)
    for cap in (1, 7, 50, 5000):
        got = intents.capped_text(spark.createDataFrame(rows, SEGMENTS), ("page_no",), cap).first()
        assert got["text"] == whole[:cap] + (intents.CUT_MARK if len(whole) > cap else "") and got["truncated"] == (len(whole) > cap)


HITS = "source_id string, filename string, position int"


@pytest.mark.parametrize(
    ("query", "hits", "want"),
    [
        ("annual summary", [("b", "x.txt", 0), ("b", "x.txt", 1), ("a", "q.txt", 2)], ("a", "named")),
        ("translate the file summary.docx please", [("b", "x.txt", 0), ("c", "old summary.docx", 1)], ("c", "file")),
        ("tell me more", [("b", "x.txt", 0), ("b", "x.txt", 1), ("c", "y.txt", 2)], ("b", "dominant")),
        ("tell me more", [("b", "x.txt", 0), ("c", "y.txt", 1)], None),
        ("tell me more", [(None, "x.txt", 0), (None, "x.txt", 1)], None),
    ],
)
def test_chosen_source(spark, query, hits, want):
    titles = spark.createDataFrame([("a", "The Annual Summary"), ("a", "short"), ("b", None)], "source_id string, title string")
    row = fulltext.chosen_source(spark.createDataFrame(hits, HITS), titles, query).first()
    assert (row and (row["source_id"], row["rule"])) == want


def test_one_rule_alone(spark):
    titles = spark.createDataFrame([("a", "The Annual Summary")], "source_id string, title string")
    hits = spark.createDataFrame([("b", "x.txt", 0), ("b", "x.txt", 1), ("a", "q.txt", 2)], HITS)
    row = fulltext.chosen_source(hits, titles, "annual summary", rules=("dominant",)).first()
    assert (row["source_id"], row["rule"]) == ("b", "dominant")


def test_fulltext_needs_text(spark):
    titles = spark.createDataFrame([("b", "t")], "source_id string, title string")
    hits = spark.createDataFrame([("b", "x.txt", 0), ("b", "x.txt", 1)], HITS)
    segments = spark.createDataFrame([("b", 1, 1, 0, " ")], SEGMENTS)
    assert fulltext.source_fulltext(hits, titles, segments, "tell me").count() == 0


SCORED = "chunk_id string, score double, position int"


def scored(spark, *rows):
    return spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(rows)], SCORED)


def test_expansion_only_where_thin(spark):
    many, few = scored(spark, ("a", 0.9), ("b", 0.8)), scored(spark, ("a", 0.5))
    called = []

    def search(q):
        called.append(q)
        return scored(spark, ("a", 0.9), (q, 0.7))

    assert fulltext.expanded(many, lambda: ["q"], search) is many and not called
    assert fulltext.expanded(few, lambda: 1 / 0, search) is few
    got = fulltext.expanded(few, lambda: [" q ", "q", "r", "", "s", "t"], search).orderBy("position").collect()
    assert called == ["q", "r", "s"] and [r["chunk_id"] for r in got] == ["a", "q", "r", "s"]


def test_merged_context_appends_sheets(spark):
    got = fulltext.merged_context([scored(spark, ("a", 0.1), ("b", 0.3)), scored(spark, ("b", 0.2), ("c", 0.2))], scored(spark, ("x", 0.9)), top=2).orderBy("position").collect()
    assert [(r["chunk_id"], r["position"]) for r in got] == [("b", 0), ("c", 1), ("x", 2)]


def test_padding_loses_no_hit(spark):
    hits = scored(spark, ("a", 0.9), ("b", 0.8), ("c", 0.7))
    ranked = spark.createDataFrame([("c", 0), ("c", 5), ("zz", 1)], "chunk_id string, place int")
    assert [r["chunk_id"] for r in fulltext.padded(ranked, hits).orderBy("position").collect()] == ["c", "a", "b"]
    assert fulltext.padded(ranked, hits, 2).count() == 2


def test_locator(spark):
    at = lambda v: one(spark, fulltext.locator(F.col("x.p"), F.col("x.s"), F.col("x.e")), v, "struct<p:int,s:int,e:int>")
    assert [at(v) for v in ((3, None, None), (0, 1, 9), (None, None, None))] == ["p.3", "1-9ms", "?"]


def test_context_blocks(spark):
    kind = "kind string, position int, source string, detail string, content string"
    hits = spark.createDataFrame([("W", 3, "b.txt", " ", "two"), ("X", 9, "s.xlsx", "May", "42"), ("W", 1, "a.txt", "Title", "one"), ("G", 5, None, None, None), ("?", 0, "z", "z", "z")], kind)
    got = [(r["kind"], r["block"]) for r in fulltext.context_blocks(hits).orderBy("place").collect()]
    assert got == [("G", "[G1] () "), ("W", "[W1] (a.txt / Title) one\n\n[W2] (b.txt) two"), ("X", "[X1] (s.xlsx / sheet May) 42")]
    assert fulltext.context_blocks(hits.limit(0)).count() == 0


def test_debug_context(spark):
    kind = "position int, filename string, page_no int, start_ms int, end_ms int, content string"
    hits = spark.createDataFrame([(1, None, None, 5, 8, "two"), (0, "a.txt", 2, None, None, "one")], kind)
    assert fulltext.debug_context(hits).first()["context"] == "[1] (a.txt p.2)\none\n\n[2] (? 5-8ms)\ntwo"
    assert fulltext.debug_context(hits.limit(0)).first()["context"] == ""


def test_latest_plan(spark):
    rows = spark.createDataFrame([("u", 1, 5, ["a"]), ("u", 2, 9, []), ("u", 3, 7, ["b"]), ("u", 4, 8, None), ("v", 5, 1, None)], "user_id string, conversation_id int, created_at int, plan array<string>")
    assert [(r["user_id"], r["conversation_id"], r["plan"]) for r in people.latest_plan(rows).collect()] == [("u", 3, ["b"])]


def test_places(spark):
    x = F.col("x")
    assert one(spark, places.city(x)["name"], "کافه در شیراز") == "شیراز" and one(spark, places.city(x), "elsewhere") is None
    assert one(spark, places.map_filter(x), "Good COFFEE") == '["amenity"="cafe"]'
    assert one(spark, places.map_filter(x), "ab Blue Star") == '["name"~"Blue|Star",i]'
    assert one(spark, places.map_filter(x), None) == '["name"~".",i]'


def test_triage(spark):
    figures = spark.createDataFrame([("d", 1, i, c) for i, c in enumerate(["Figure with 42 apples sold", "", None, "short 1", "long caption without digits"])] + [("d", 2, 9, "")], "doc string, page_no int, figure_no int, caption string")
    pages = spark.createDataFrame([("d", 1, "x" * 300), ("d", 2, "7" + "x" * 300)], "doc string, page_no int, text string")
    got = {r["figure_no"]: r["decision"] for r in media.figure_triage(figures, pages, "doc", most=3).collect()}
    assert got == {0: "caption-data", 1: "describe", 2: "describe", 3: "describe", 4: "over-cap", 9: "page-rich"}


def test_pieces_shift_back(spark):
    rows = media.audio_pieces(spark.createDataFrame([("a", 250, 90.0), ("b", 250, 0.0)], "id string, n_bytes long, duration_s double"), cap=100)
    assert sorted((r["id"], r["start_s"], r["length_s"]) for r in rows.collect()) == [("a", 0.0, 30.0), ("a", 30.0, 30.0), ("a", 60.0, 30.0), ("b", 0.0, None)]
    said = spark.createDataFrame([("a", 1, 10, 20, " hi "), ("a", 0, 0, 5, " ")], "id string, piece_no int, start_ms long, end_ms long, text string")
    assert [tuple(r) for r in media.shifted(said, rows, "id").collect()] == [("a", 30010, 30020, "hi")]


def test_page_batches(spark):
    texts = ["a", "b", "c", "", None, "d", " ", "e"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, page_no int, text string")
    got = [(r["route"], r["batch_no"]) for r in media.page_batches(rows, "doc", 2).orderBy("page_no").collect()]
    assert got == [("text", 1), ("text", 1), ("text", 2), ("vision", 3), ("vision", 4), ("text", 5), ("vision", 6), ("text", 7)]


def test_names(spark):
    assert [one(spark, media.transcriber(F.col("x")), m) for m in ("gemini-2.5", "gpt-4o-mini-transcribe", "whisper-1", None)] == ["gemini", "chat-transcribe", "whisper", "whisper"]
    assert one(spark, media.image_line(F.lit(3), F.lit(4), F.lit("PNG"), F.col("x")), "n.png") == "[image 3x4 PNG n.png]"


def pieces_of(text, size):
    """Brute force: paragraphs packed, giants cut."""
    out, held = [], ""
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if held and len(held) + 2 + len(p) > size:
            out, held = [*out, held], p
        else:
            held = f"{held}\n\n{p}" if held else p
    out, whole = [], [*out, held]
    for w in whole:
        while len(w) > 2 * size:
            out, w = [*out, w[:size]], w[size:]
        out.append(w)
    return out


@pytest.mark.parametrize("lengths", [(3, 4, 5), (25, 3), (20, 1), (21,), (3, 47, 3, 3), (10, 10), (60, 60)])
def test_hard_split(spark, lengths):
    text = "\n\n".join(chr(97 + i) * n for i, n in enumerate(lengths))
    got = one(spark, structure.packed(F.split("x", "\n\n"), 10, 10), text)
    assert got == pieces_of(text, 10)


def test_translation_cursor(spark):
    text = "\n\n".join(f"{i} " + "x" * 3000 for i in range(4))
    said = ["continue", "translate a", "continue", "hello", "translate b", "continue", "continue", "continue", "translate short", "continue"]
    named = [None, text, None, None, text[:7000], None, None, None, "short", None]
    got = jobs.translation_turns(spark.createDataFrame([("k", i, s, n) for i, (s, n) in enumerate(zip(said, named, strict=True))], "conversation_id string, seq int, text string, named_text string"))
    want, left, total = [], [], 0
    for i, (s, n) in enumerate(zip(said, named, strict=True)):
        if s == "continue" and left:
            want.append((i, total - len(left) + 1, total, left.pop(0)))
        elif s.startswith("translate") and len(n) > jobs.LONG_CHARS and len(parts := pieces_of(n, jobs.PIECE_CHARS)) > 1:
            want.append((i, 1, len(parts), parts[0]))
            left, total = parts[1:], len(parts)
    assert [tuple(r)[1:] for r in got.orderBy("seq").collect()] == want and len(want) == 4


def test_tool_turns_stream(spark, tmp_path):
    events = [("k", 0, "result", False), ("k", 1, "message", True), ("k", 2, "result", True), ("k", 3, "result", True), ("k", 4, "result", False), ("k", 5, "message", False)]
    kind = "conversation_id string, seq int, kind string, needs_tool boolean"
    spark.createDataFrame(events, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.tool_turns(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["outcome"] for r in spark.table("turns").orderBy("seq").collect()] == ["conflict", "paused", "paused", "answered", "conflict", "answered"]


def test_claims(spark):
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    kind = "source_id string, status string, heartbeat_at timestamp, processing_started_at timestamp, created_at timestamp"
    sources = spark.createDataFrame([("a", "pending", None, None, ago(9)), ("b", "processing", None, ago(9), ago(99)), ("c", "processing", ago(9), ago(9999), ago(9999)), ("d", "processing", None, ago(9999), ago(9999))], kind)
    wanted = spark.createDataFrame([(x,) for x in ["a", "a", "b", "c", "d", "e", None]], "source_id string")
    got = {r["source_id"]: (r["outcome"], r["status"]) for r in jobs.claimed(sources, wanted, now).collect()}
    assert got == {"a": ("claimed", "processing"), "b": ("refused", "processing"), "c": ("refused", "processing"), "d": ("claimed", "processing"), "e": ("not found", None)}


def test_registry():
    r = seams.Registry(a=lambda q: [], b=lambda q: 1 / 0, c=lambda q: [q])
    assert r.first(["a", "b", "zz", "c"], "q") == (["q"], "c") and r.first(["a"], "q") == (None, None)
    assert list(r.allowed(["c", "zz", "a", "c"])) == ["c", "a"]
    with pytest.raises(KeyError):
        r.get("zz")


def test_query_tokens_match_expression(spark):
    for q in ("ك‌ي Annual  x", "file Summary.docx"):
        assert one(spark, intents.X.tokens(F.col("x")), q) == retrieval.query_tokens(q)
