"""Small fixtures with known results, and the brute-force versions of what SQL can't express."""

import datetime
import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import seams, session
from quillspark.functions import text as X
from quillspark.operators import catalog, evaluation, ledger, people, retrieval, scope, structure, tabular
from quillspark.sources import files, sinks, web, workbook
from quillspark.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


CHUNKS = "chunk_id string, source_id string, workspace_id string, kb_id string, title string, filename string, content string, embedding array<double>, status string, type string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "A", "KB1", "acids donate protons in water", [1.0, 0, 0, 0]), ("b", "A", "KB1", "bases accept protons hydroxide", [0, 1.0, 0, 0]), ("c", "A", "KB2", "salts form from neutralization", [0, 0, 1.0, 0]), ("d", "B", "KB3", "acids donate protons in water", [1.0, 0, 0, 0])]
    return spark.createDataFrame([(i, i, w, k, "d", "n", t, [float(x) for x in v], "ready", "txt") for i, w, k, t, v in rows], CHUNKS)


def test_search_ranks_and_isolates(chunks):
    hits = retrieval.hybrid_search(chunks, "A", "acids", [1.0, 0, 0, 0], top_k=5).orderBy("position").collect()
    assert hits[0]["content"].startswith("acids") and hits[0]["vector_rank"] == 0
    assert sorted(h["chunk_id"] for h in hits) == ["a", "b", "c"]
    assert [h["chunk_id"] for h in retrieval.hybrid_search(chunks, "A", "acids", [1.0, 0, 0, 0], kb="KB2").collect()] == ["c"]
    assert {h["chunk_id"]: h["fts_rank"] for h in retrieval.hybrid_search(chunks, "A", "bases accept", [0, 0, 0, 1.0]).collect()}["b"] == 0


def test_search_needs_a_workspace(chunks):
    with pytest.raises(scope.MissingWorkspace):
        retrieval.hybrid_search(chunks, None, "acids", [1.0, 0, 0, 0])


def test_search_hides_unready_and_repeated(chunks):
    more = chunks.filter("chunk_id = 'a'").withColumn("chunk_id", F.lit("z")).withColumn("source_id", F.lit("z"))
    rows = chunks.unionByName(more)
    assert [h["chunk_id"] for h in retrieval.hybrid_search(rows, "A", "acids", [1.0, 0, 0, 0]).filter("content like 'acids%'").collect()] == ["a"]
    assert retrieval.hybrid_search(chunks.withColumn("status", F.lit("processing")), "A", "acids", [1.0, 0, 0, 0]).count() == 0


def test_a_trace_costs_no_job(spark, chunks):
    rows = scope.candidates(chunks, "A")
    jobs_of = {}
    for name, trace in (("plain", None), ("traced", {})):
        spark.sparkContext.setJobGroup(name, name)
        got = retrieval.search_in(rows, "acids donate", [1.0, 0, 0, 0], 2, trace=trace).collect()
        jobs_of[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = retrieval.traced(trace)
    assert jobs_of["plain"] == jobs_of["traced"] and {n: x["rows"] for n, x in found.items()} == {"vector": 3, "fts": 1, "title": 0, "fused": 2, "kept": len(got)}
    assert found["vector"]["best"] == pytest.approx(1.0) and found["title"]["best"] is None


def test_limits():
    assert retrieval.limits(4) == (4, 12) and retrieval.limits(None) == (8, 24) and retrieval.limits(500) == (50, 150)


def test_passage_takes_its_heading(spark):
    kind = "chunk_id string, document_id string, page_no int, content string, element_id string, parent_id string"
    rows = spark.createDataFrame([("1", "d", 1, "Heading", "e1", ""), ("2", "d", 2, "x", "e2", "e1"), ("3", "d", 3, "y", "e3", "e1"), ("4", "d", 4, "table", "e4", "e1")], kind)
    hits = spark.createDataFrame([("4", 1.0), ("3", 0.5)], "chunk_id string, score double")
    found = {r["chunk_id"]: r["passage"] for r in retrieval.passages(hits, rows).collect()}
    assert found["4"] == "[Heading]\ny\ntable" and found["3"] == "[Heading]\nx\ny\ntable"


def test_normalize(spark):
    assert one(spark, X.normalize(F.col("x")), "يكة‌ ًـ") == "یکه  "
    assert one(spark, X.normalize(X.normalize(F.col("x"))), "كتاب") == one(spark, X.normalize(F.col("x")), "كتاب")


@pytest.mark.parametrize(("given", "want"), [("mail a@b.co now", "mail [email] now"), ("1234 5678 1234 5678", "[card]"), ("call +98 912 345 6789", "call [phone]"), ("nothing", "nothing"), (None, "")])
def test_redact(spark, given, want):
    assert one(spark, X.redact(F.col("x")), given) == want


def test_scalars(spark):
    assert one(spark, X.clock_ms(F.col("x")), "01:02.500") == 62_500
    assert one(spark, X.sanitize_name(F.col("x"), F.lit("col_1")), " Total (USD) ") == "total_usd"
    assert one(spark, X.sanitize_name(F.col("x"), F.lit("col_1")), "نام") == "col_1"
    assert one(spark, X.sanitize_name(F.col("x"), F.lit("col_1")), "2024 sales") == "col_1"
    assert one(spark, X.sanitize_name(F.col("x"), F.lit("col_1"), digit_first=True), "2024 sales") == "2024_sales"
    assert one(spark, X.json_object(F.col("x")), 'sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.json_strings(F.col("x")), 'x ["a", "a", " b "]') == ["a", "b"]
    assert one(spark, X.render("hi {name}", name=F.col("x")), "Al") == "hi Al" and one(spark, X.render("hi {other}", name=F.col("x")), "Al") is None
    assert one(spark, X.looks_like_heading(F.col("x")), "Chapter one") is True and one(spark, X.looks_like_heading(F.col("x")), "Ends here.") is False


@pytest.mark.parametrize(
    ("segments", "want"),
    [
        ([(0, 30000), (30000, 60000), (300000, 330000), (330000, 360000)], [(0, 60000), (300000, 360000)]),
        ([(0, 200000), (500000, 510000), (900000, 1100000)], [(0, 510000), (900000, 1100000)]),
        ([(0, 0)], [(0, 0)]),
        ([], []),
    ],
)
def test_chapters(spark, segments, want):
    rows = spark.createDataFrame([(1, s, e, "words here") for s, e in segments], "k int, start_ms long, end_ms long, text string")
    assert [(r["start_ms"], r["end_ms"]) for r in structure.chapterize(rows, "k").orderBy("chapter_no").collect()] == want


def brute_windows(segments):
    out, buf, start, end = [], [], None, None
    for s, e, t in segments:
        start = s if start is None else start
        end = e or start
        buf.append(t)
        if end - start >= 45_000:
            out.append((start, end, " ".join(buf)))
            buf, start = [], None
    return out + ([(start, end, " ".join(buf))] if buf else [])


def test_transcript_windows(spark):
    segments = [(30_000 * i, 30_000 * i + 30_000, f"t{i}") for i in range(9)]
    rows = spark.createDataFrame([(1, *s) for s in segments], "k int, start_ms long, end_ms long, text string")
    assert [(r[2], r[3], r[4]) for r in structure.transcript_windows(rows, "k").orderBy("window_no").collect()] == brute_windows(segments)


def test_packing_keeps_all(spark):
    paragraphs = ["x" * n for n in (700, 700, 200, 1600, 10)]
    pages = one(spark, structure.packed(F.col("x")), paragraphs, "array<string>")
    assert "\n\n".join(pages) == "\n\n".join(paragraphs) and [len(p) for p in pages] == [1402, 200, 1600, 10]


def test_sections(spark):
    rows = spark.createDataFrame([(1, "# One\n\nsome words that make a long sentence here, with an end.\n\n- a\n- b\n\n## Two\nlast words end.")], "k int, text string")
    found = structure.section_chain(structure.blocks(rows), "k").orderBy("document_order").collect()
    assert [(r["kind"], r["section"], r["parent_id"]) for r in found] == [("heading", "", ""), ("paragraph", "One", "e1"), ("list", "One", "e1"), ("heading", "One", "e1"), ("paragraph", "Two", "e4")]


def test_table_parts_repeat_the_header(spark):
    block = "\n".join(["| a | b |", "|---|---|", *[f"| row {i} | w w |" for i in range(300)]])
    parts = one(spark, structure.table_parts(F.col("x")), block)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == block.split("\n")[2:]


def test_cues_and_pages(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:04.000\n<b>Hello</b> world\n\n01:02.500 --> 01:05.000\nSecond line\n"
    rows = spark.createDataFrame([(1, vtt)], "k int, text string")
    assert [tuple(r)[2:] for r in web.cues(rows, "k").orderBy("cue_no").collect()] == [(1000, 4000, "Hello world"), (62500, 65000, "Second line")]
    marked = spark.createDataFrame([(1, "```text\n[PAGE 1]\na\n[PAGE 3]\nb\n```")], "k int, text string")
    assert [(r["page_no"], r["text"]) for r in web.marked_pages(marked, "k").orderBy("page_no").collect()] == [(1, "a"), (3, "b")]


def test_sheets(spark):
    sales = spark.createDataFrame([("Tehran", 100, 2), ("Tehran", 200, 3), ("Shiraz", 150, 1)], "region string, amount long, units long")
    infos = [tabular.info("sales", sales)]
    assert tabular.run(tabular.ask("sum of amount", infos), {"sales": sales}).first()["value"] == 450
    assert {r["group_value"]: r["value"] for r in tabular.run(tabular.ask("count units by region", infos), {"sales": sales}).collect()} == {"Tehran": 2, "Shiraz": 1}
    with pytest.raises(tabular.NotAllowed):
        tabular.run(tabular.Aggregate("sum", "sales", "nothing"), {"sales": sales})


def test_joined_sheets(spark):
    orders = spark.createDataFrame([(1, "C1", 100), (2, "C2", 200), (3, "C1", 50)], "order_id long, customer_id string, amount long")
    customers = spark.createDataFrame([("C1", "Ali"), ("C2", "Sara")], "customer_id string, name string")
    tables = {"orders": orders, "customers": customers}
    dtypes = {n: {c: k for c, _, k in tabular.info(n, d).columns} for n, d in tables.items()}
    found = tabular.relations(tabular.value_pools(tables, {"orders": ["order_id"], "customers": ["customer_id"]}, dtypes)).collect()
    assert [(r["from_table"], r["from_col"], r["to_table"], r["kind"]) for r in found] == [("customers", "customer_id", "orders", "shared-column")]
    edges = [tabular.Edge(r["from_table"], r["from_col"], r["to_table"], r["to_col"]) for r in found]
    plan = tabular.ask_joined("sum amount of orders by name of customers", [tabular.info(n, d) for n, d in tables.items()], edges)
    assert {r["group_value"]: r["value"] for r in tabular.run(plan, tables, edges).collect()} == {"Ali": 150, "Sara": 200}
    with pytest.raises(tabular.NotAllowed):
        tabular.run(plan, tables, [])


def test_joined_questions_of_each_form(spark):
    orders = spark.createDataFrame([(1, "C1", 100), (2, "C2", 200), (3, "C1", 50)], "order_id long, customer_id string, amount long")
    customers = spark.createDataFrame([("C1", "Ali"), ("C2", "Sara")], "customer_id string, name string")
    tables, edges = {"Orders": orders, "Customers": customers}, [tabular.Edge("Orders", "customer_id", "Customers", "customer_id")]
    infos = [tabular.info(n, d) for n, d in tables.items()]
    ask = lambda q: tabular.ask_joined(q, infos, edges)
    run = lambda q: [tuple(r) for r in tabular.run(ask(q), tables, edges).collect()]
    assert run("total amount of orders for customers") == [(350,)]
    assert run("count orders amount by name") == [(50, 1), (100, 1), (200, 1)]
    assert run("count amount of customers") == [(3,)]
    assert run("average amount by name") == [("Ali", 75.0), ("Sara", 200.0)]
    plan = ask("list name and amount")
    assert isinstance(plan, tabular.Selection) and plan.columns == (("Orders", "amount"), ("Customers", "name"))
    assert [tuple(r) for r in tabular.select(plan, tables, edges).collect()] == [(50, "Ali"), (100, "Ali"), (200, "Sara")]
    assert tabular.described(plan) == "SELECT Orders.amount, Customers.name FROM Orders JOIN Customers ON Orders.customer_id = Customers.customer_id LIMIT 200"
    assert ask("sum of name by amount") is not None and ask("max by name") is None and ask("amount") is None
    assert tabular.ask_joined("list name and amount", infos, []) is None
    with pytest.raises(tabular.NotAllowed):
        tabular.select(plan, tables, [])
    with pytest.raises(tabular.NotAllowed):
        tabular.select(tabular.Selection((("Orders", "zz"),), edges[0]), tables, edges)


def test_a_broken_or_slow_source_does_not_stop_the_others(spark):
    good = spark.createDataFrame([("x", 1), ("y", 2)], "label string, amount long")
    slow = good.withColumn("amount", F.udf(lambda n: (time.sleep(60), n)[1], "long")("amount"))

    def broken():
        raise OSError("no such file")

    book = lambda i, load: tabular.Workbook(str(i), f"{i}.xlsx", load)
    began = time.time()
    found, passed = tabular.answers("sum of amount", [book(1, broken), book(2, lambda: {"s": slow}), book(3, lambda: {"sales": good}), book(4, lambda: {"sales": good})], seconds=4)
    assert time.time() - began < 40 and [(a.source_id, a.rows) for a in found] == [("3", (("3",),))]
    assert passed == [("1", "OSError"), ("2", "ScanTimeout")]
    assert found[0].chunk_id == "excel:3:sales" and found[0].content.endswith("(SQL: SELECT SUM(sales.amount) FROM sales)\nvalue\n3")
    assert tabular.answers("hello there", [book(1, lambda: {"sales": good})]) == ([], [("1", "no plan")])
    assert session.bounded(spark, 30, good.count) == 2
    with pytest.raises(ZeroDivisionError):
        session.bounded(spark, 30, lambda: 1 // 0)


def test_headers():
    assert tabular.header_names(["Name", "name", "", "2nd", None]) == ["name", "name_2", "col_3", "col_4"]


def test_costs(spark):
    kind = "provider string, model string, prompt_tokens long, completion_tokens long"
    rows = spark.createDataFrame([("openai_compat", "gpt-4o-mini", 1000, 1000), ("x", "gpt-4o-mini", 1000, 1000), ("x", "none", 5, 5), ("gemini", "gemini-2.0-flash", -5, -5)], kind)
    assert [r["cost_usd"] for r in ledger.with_cost(rows, ledger.prices(spark)).collect()] == [0.00075, 0.00075, None, 0.0]


def test_profile(spark):
    answers = spark.createDataFrame([(1, t, "5" if t == "S" else "2") for t in "RIASEC" for _ in range(3)] + [(2, "S", "5")], "person int, interest string, answer string")
    rows = people.quiz_scores(answers, "person").collect()
    assert len(rows) == 1 and rows[0]["code"].startswith("S") and rows[0]["S"] == 15
    jobs_ = spark.createDataFrame([(1, "a", "g", "SEA"), (2, "b", "g", "RIE"), (3, "c", "g", "SIA"), (4, "d", "g", "x")], "job_id int, title string, job_group string, interests string")
    found = people.match_jobs(jobs_, "SIA").orderBy(F.desc("matched")).collect()
    assert [r["matched"] for r in found] == [3, 2, 1] and {r["total"] for r in found} == {3}


def test_leads(spark, tmp_path):
    kind = "workspace_id string, lead_id int, name string, address string"
    batch = spark.createDataFrame([("w", 1, " Cafe", "a"), ("w", 2, "Cafe", "a"), ("w", 3, "", "b")], kind)
    fresh = people.new_leads(batch, batch.limit(0), "lead_id")
    assert [r["lead_id"] for r in fresh.collect()] == [1]
    assert people.new_leads(batch, fresh, "lead_id").count() == 0
    sinks.write_leads(fresh, str(tmp_path / "leads"))
    part = next(p for p in (tmp_path / "leads").iterdir() if p.suffix == ".csv").read_bytes()
    assert part.decode().startswith("﻿name,address")


@pytest.mark.parametrize(
    "html, want",
    [("<p>1 < 2</p>", "1 < 2"), ("<p>a<b>c</b> <3 & x</p>", "a\nc\n<3 & x"), ("a<script>if (1 < 2) '</p>'</script>b", "a\nb"), ("<NAV x=1>n</NAV >m<style>p{}</style><!-- <p> -->e", "m\ne"), ("k<header>never closed", "k"), ("<headerless>t</headerless>", "t"), (None, ""), ("x <", "x <")],
)
def test_page_text(spark, html, want):
    assert one(spark, web.html_text(F.col("x")), html) == want


def test_cues_of_three_forms_are_equal(spark):
    vtt = "WEBVTT\n\n00:01.500 --> 00:00:03.000 align:start\nHello <i>there</i>\nyou\n\nNOTE x\n\n01:00:00.000 --> 01:00:01.000\n1 & 2"
    srt = "1\r\n00:00:01,500 --> 00:00:03,000\r\nHello there\r\nyou\r\n\r\n2\r\n01:00:00,000 --> 01:00:01,000\r\n1 & 2\r\n"
    ttml = '<?xml version="1.0"?><tt><body><div><p begin="00:00:01.500" end="00:00:03.000">Hello <span>there</span><br/>you</p>\n<P  xml:id=\'b\' end="01:00:01.000" region="r" begin="01:00:00.000">1 &amp; 2</P><p>untimed</p><p begin="00:00:09.000" end="x">bad</p></div></body></tt>'
    rows = web.cues(spark.createDataFrame([("vtt", vtt), ("srt", srt), ("ttml", ttml), ("none", None), ("blank", "<p begin='00:00:01.0' end='00:00:02.0'> </p>")], "f string, text string"), "f").collect()
    by = {f: sorted((r["start_ms"], r["end_ms"], r["text"]) for r in rows if r["f"] == f) for f in ("vtt", "srt", "ttml", "none", "blank")}
    assert by["vtt"] == by["srt"] == by["ttml"] == [(1500, 3000, "Hello there you"), (3_600_000, 3_601_000, "1 & 2")] and by["none"] == by["blank"] == []


def test_free_form_states(spark):
    kind = "id int, state string"
    states = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "n": 1.5, "s": "x"}'), (2, "not json"), (3, None), (4, "[1, 2]"), (5, '{"keep": true}')], kind)
    patches = spark.createDataFrame([(1, '{"a": {"d": 2}, "new": [true]}'), (2, '{"x": {"y": 1}}'), (3, '{"z": null}'), (6, '{"only": "patch"}')], kind)
    got = {r["id"]: json.loads(r["state"]) for r in catalog.patched_json(states, patches, "id").collect()}
    assert got == {1: {"a": {"d": 2}, "n": 1.5, "s": "x", "new": [True]}, 2: {"x": {"y": 1}}, 3: {"z": None}, 4: {}, 5: {"keep": True}, 6: {"only": "patch"}}
    at = lambda path, kind: one(spark, catalog.at_path(F.col("x"), path, kind), '{"a": {"b": [1, {"c": "deep"}]}}')
    assert at("$.a.b[1].c", "string") == "deep" and at("$.a.b[0]", "long") == 1 and at("$.a.z", "string") is None and at("$.a.b[1].c", "long") is None


def test_metrics(spark):
    questions = spark.createDataFrame([(1, ["acids", "missing"], ["a", "b", "zz"]), (2, ["acids"], []), (3, [], [])], "question_id int, expected array<string>, keywords array<string>")
    returned = spark.createDataFrame([(1, 1, "other", "a"), (1, 2, "acids", "b"), (2, 1, "other", ""), (2, 2, "acids", ""), (2, 3, "acids", "")], "question_id int, rank int, source string, text string")
    rows = {r["question_id"]: r for r in evaluation.question_metrics(questions, returned).collect()}
    assert (rows[1]["recall_at_k"], rows[1]["mrr"], rows[1]["keyword_coverage"]) == (0.5, 0.5, 0.6667)
    assert (rows[2]["recall_at_k"], rows[2]["precision_at_k"], rows[2]["ndcg_at_k"]) == (1.0, 0.6667, 0.6934)
    assert (rows[3]["recall_at_k"], rows[3]["ndcg_at_k"], rows[3]["hits"]) == (1.0, 1.0, 0)


def test_rate_limit(spark):
    times = [0.0, 1.0, 2.0, 3.0, 60.0, 60.5, 62.5, 70.0]
    rows = spark.createDataFrame([("u", t) for t in times], "user string, at double")
    allowed, _ = jobs.admit(times, [], 3, 60.0)
    assert allowed[:4] == [True, True, True, False]
    assert [r["allowed"] for r in jobs.rate_limited_batch(rows, "user").orderBy("at").collect()] == allowed


def test_rate_limit_of_one_large_key(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 > 0, F.concat(F.lit("u"), F.col("id") % 100)).alias("user"), (F.col("id") * 7919 % 40_009).cast("double").alias("at"))
    found = jobs.rate_limited_batch(rows.unionByName(rows.limit(1).withColumn("at", F.lit(None).cast("double"))), "user")
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no key's rows in one array
    want = {}
    for r in rows.collect():
        want.setdefault(r["user"], []).append(r["at"])
    want = sorted((str(k), t, ok) for k, v in want.items() for t, ok in zip(sorted(v), jobs.admit(sorted(v), [], 3, 60.0)[0], strict=True))
    assert sorted((str(r["user"]), r["at"], r["allowed"]) for r in found.collect()) == want


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([("u", float(t)) for t in range(5)], "user string, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, at double").parquet(str(tmp_path / "in"))
    q = jobs.rate_limited(stream, "user").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("limited").filter("allowed").count() == 3


def test_office_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<d xmlns="{w}"><body><p><r><t>Hello</t></r></p><tbl><tr><tc><p><r><t>a</t></r></p></tc><tc><p><r><t>b</t></r></p></tc></tr></tbl></body></d>')
    (tmp_path / "x.docx").write_bytes(buf.getvalue())
    found = files.read_files(spark, str(tmp_path))
    assert files.docx_texts(found).first()["text"] == "Hello\na | b"
    assert files.validated(found).first()["problem"] is None
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_text("﻿Region;Amount\nTehran;100\nShiraz;150\n")
    assert {r["region"]: r["amount"] for r in files.read_delimited(spark, str(tmp_path / "csv")).collect()} == {"Tehran": "100", "Shiraz": "150"}


def test_embeddings(spark):
    rows = spark.createDataFrame([("a b",), ("c",)], "content string")
    assert [len(r["embedding"]) for r in seams.with_embeddings(rows, seams.hash_embedder(8)).collect()] == [8, 8]


def test_reingest(spark):
    stored = spark.createDataFrame([("s1", "old"), ("s2", "kept")], "source_id string, content string")
    fresh = spark.createDataFrame([("s1", "new")], "source_id string, content string")
    assert sorted(tuple(r) for r in sinks.replaced(stored, fresh).collect()) == [("s1", "new"), ("s2", "kept")]


def test_workbook_relations_types_and_dispatch(spark, tmp_path):
    head = '<workbook xmlns:r="u"><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a"/></sheets></workbook>'
    sheet = lambda rows: "<worksheet><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>"
    cell = lambda r, v, more="": f'<c r="{r}" {more}><v>{v}</v></c>'
    said = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    first = sheet([said("A1", "ok") + said("B1", "day") + said("C1", "n") + said("D1", "x"), cell("A2", 1, 't="b"') + cell("B2", 45292.5, 's="1"') + cell("C2", 7) + cell("D2", 1.5), cell("A3", 0, 't="b"') + cell("B3", 45293, 's="1"') + cell("C3", 8) + said("D3", "2e3")])
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("xl/workbook.xml", head)
        z.writestr("xl/_rels/workbook.xml.rels", '<r><x Id="a" Target="worksheets/sheet2.xml"/><x Id="b" Target="/xl/worksheets/sheet1.xml"/></r>')
        z.writestr("xl/styles.xml", '<s><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></s>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([said("A1", "other")]))
        z.writestr("xl/worksheets/sheet2.xml", first)
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "b.xlsx").write_bytes(blob.getvalue())
    cells = files.parse_source(spark, "excel", str(tmp_path / "book"))
    rows = sorted((r["sheet"], r["row_no"], r["cells"]) for r in cells.collect())
    assert rows[0] == ("First", 1, ["ok", "day", "n", "x"]) and rows[1][2] == ["true", "2024-01-01 12:00:00", "7", "1.5"] and rows[-1][:2] == ("Second", 1)
    workbook.register(spark)
    reader = spark.read.format("workbook")
    every = reader.option("cells", "true").load(str(tmp_path / "book"))
    assert every.rdd.getNumPartitions() == 2 and sorted((r["_sheet"], r["_row_no"], r["cells"]) for r in every.collect()) == rows
    typed = spark.read.format("workbook").option("sheet", "First").load(str(tmp_path / "book"))
    assert typed.dtypes == [("ok", "boolean"), ("day", "timestamp_ntz"), ("n", "bigint"), ("x", "double")]
    assert [tuple(r) for r in typed.orderBy("n").collect()] == [(True, datetime.datetime(2024, 1, 1, 12), 7, 1.5), (False, datetime.datetime(2024, 1, 2), 8, 2000.0)]
    strings = files.sheet_table(cells, cells.first()["path"], "First")
    assert [tuple(r) for r in strings.select(tabular.coerce(F.col("n"), "int"), tabular.coerce(F.col("x"), "float")).collect()] == [(r["n"], r["x"]) for r in typed.orderBy("n").collect()]
    named = spark.read.format("workbook").option("columns", "names").load(str(tmp_path / "book" / "b.xlsx"))
    assert named.columns == ["other", "_path", "_sheet", "_row_no"] and named.count() == 0  # the first sheet: a header alone
    (tmp_path / "book" / "a.xlsx").write_bytes(b"not a workbook")
    with pytest.raises(Exception, match="a.xlsx is no workbook"):
        spark.read.format("workbook").load(str(tmp_path / "book")).count()
    with pytest.raises(Exception, match="has no header"):
        spark.read.format("workbook").option("sheet", "Third").load(str(tmp_path / "book" / "b.xlsx"))
    (tmp_path / "book" / "a.xlsx").unlink()
    df = spark.createDataFrame([(i, *r[2]) for i, r in enumerate(rows[1:3])], "i int, ok string, day string, n string, x string").withColumn("none", F.lit(" "))
    kinds = {r["column"]: r["dtype"] for r in tabular.infer_sheet_types(df, "i", ["ok", "day", "n", "x", "none"]).collect()}
    assert kinds == {"ok": "bool", "day": "date", "n": "int", "x": "float", "none": "text"}
    (tmp_path / "c.csv").write_text('name;note\n"a, b";"two\nlines"\nc;"d, e, f"\n')
    assert [tuple(r) for r in files.parse_source(spark, "csv", str(tmp_path / "c.csv")).collect()] == [("a, b", "twolines"), ("c", "d, e, f")]
    for kind in ("parquet", "pdf"):
        with pytest.raises(ValueError):
            files.parse_source(spark, kind, str(tmp_path))
    assert files.parse_source(spark, "pdf", str(tmp_path / "book"), {"pdf": lambda f: f.select("path")}).count() == 1


def test_numbered_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1009).repartition(7)
    rows = session.numbered(df, "n", F.desc("k")).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: -r["k"])] == list(range(1000))
    assert session.numbered(df.filter("id < 0"), "n", F.desc("k")).count() == 0
