"""Queries over texts: normalisation, chunks, sections, packing, HTML, redaction, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import structure as T
from ..session import table
from ..sources import web
from .registry import folded, packed, query, quoted, strip, tokens, words

ARABIC = "كتابي مدرسة بَـ "

CHUNK_CTE = f"""w AS (SELECT doc_id, lang, source, {words("text")} AS ws FROM documents),
k AS (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 400) / 340e0))::BIGINT)) AS no FROM w WHERE len(ws) > 0)"""


@query(f"""SELECT doc_id, sha1(norm) AS norm_sha1, len({words("norm")})::BIGINT AS n_words, len({tokens("norm")})::BIGINT AS n_tokens,
 trunc(len({words("norm")}) * 1.3e0)::BIGINT AS token_estimate
FROM (SELECT doc_id, translate({quoted(ARABIC)} || text, {quoted(X.FOLD_FROM + X.FOLD_DELETE)}, {quoted(X.FOLD_TO)}) AS norm FROM documents)""")
def normalize_tokens(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.concat(F.lit(ARABIC), "text")).alias("norm"))
    n = F.size(X.words(F.col("norm")))
    return norm.select("doc_id", F.sha1("norm").alias("norm_sha1"), n.cast("long").alias("n_words"), F.size(X.tokens(F.col("norm"))).cast("long").alias("n_tokens"), X.token_estimate(n).cast("long").alias("token_estimate"))


@query(f"""WITH {CHUNK_CTE}
SELECT doc_id, no AS chunk_no, least(400, len(ws) - no * 340)::BIGINT AS n_words, trunc(least(400, len(ws) - no * 340) * 1.3e0)::BIGINT AS tokens,
 sha1(array_to_string(ws[no * 340 + 1 : no * 340 + 400], ' ')) AS content_sha1 FROM k""")
def chunk_words(spark, sf_dir):
    rows = T.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_words").cast("long").alias("n_words"), F.col("tokens").cast("long").alias("tokens"), F.sha1("content").alias("content_sha1"))


def segments(spark, sf_dir):
    """Turns as a transcript: 30 seconds each, with a silence of 100 seconds before every fifth."""
    turn = F.col("turn").cast("long")
    start = turn * 30_000 + F.floor(turn / 5).cast("long") * 100_000
    return table(spark, sf_dir, "conversations").select("conv_id", start.alias("start_ms"), (start + 30_000).alias("end_ms"), "text")


SEGMENTS = "seg AS (SELECT conv_id, turn * 30000 + (turn // 5) * 100000 AS s, turn * 30000 + (turn // 5) * 100000 + 30000 AS e, text FROM conversations)"


@query(f"""WITH RECURSIVE {SEGMENTS}, g AS (SELECT conv_id, s, e, t, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, t) AS rn FROM (SELECT conv_id, s, e, {strip("coalesce(text, '')")} AS t FROM seg) WHERE t <> ''),
f AS (SELECT conv_id, rn, 0::BIGINT AS no, s, e, t, e - s >= {T.TRANSCRIPT_MS} AS closed FROM g WHERE rn = 1
 UNION ALL SELECT g.conv_id, g.rn, f.no + f.closed::BIGINT, CASE WHEN f.closed THEN g.s ELSE f.s END, g.e, CASE WHEN f.closed THEN g.t ELSE f.t || ' ' || g.t END, g.e - CASE WHEN f.closed THEN g.s ELSE f.s END >= {T.TRANSCRIPT_MS} FROM f JOIN g ON g.conv_id = f.conv_id AND g.rn = f.rn + 1)
SELECT conv_id, no AS window_no, s::BIGINT AS start_ms, e::BIGINT AS end_ms, t AS content FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, no ORDER BY rn DESC) = 1""")
def transcript_windows(spark, sf_dir):
    return T.transcript_windows(segments(spark, sf_dir), "conv_id").withColumn("window_no", F.col("window_no").cast("long"))


@query(f"""WITH {SEGMENTS}, said AS (SELECT conv_id, s, e, {strip("text")} AS t FROM seg WHERE {strip("coalesce(text, '')")} <> ''),
cut AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY conv_id ORDER BY s, e, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 90000 THEN 1 ELSE 0 END AS c FROM said),
raw AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY s, e, t ROWS UNBOUNDED PRECEDING) AS r FROM cut),
parts AS (SELECT conv_id, r, min(s) AS s, max(e) AS e, string_agg(t, ' ' ORDER BY s, e, t) AS t FROM raw GROUP BY ALL),
kept AS (SELECT *, CASE WHEN r > 0 AND r < max(r) OVER (PARTITION BY conv_id) AND e - s < 120000 THEN 0 ELSE 1 END AS keep FROM parts),
num AS (SELECT *, sum(keep) OVER (PARTITION BY conv_id ORDER BY r ROWS UNBOUNDED PRECEDING) - 1 AS n FROM kept)
SELECT conv_id, n::BIGINT AS chapter_no, min(s)::BIGINT AS start_ms, max(e)::BIGINT AS end_ms,
 array_to_string(({words("string_agg(t, ' ' ORDER BY r)")})[1:8], ' ') AS title FROM num GROUP BY conv_id, n""")
def chapterize(spark, sf_dir):
    return T.chapterize(segments(spark, sf_dir), "conv_id").withColumn("chapter_no", F.col("chapter_no").cast("long"))


@query(f"""WITH {SEGMENTS}, ch AS (SELECT conv_id, s AS at FROM seg WHERE (s // 30000) % 4 = 0)
SELECT seg.conv_id, seg.s AS start_ms, max(ch.at) AS chapter_start_ms, count(*) AS copies FROM seg LEFT JOIN ch ON ch.conv_id = seg.conv_id AND ch.at <= seg.s GROUP BY seg.conv_id, seg.s""")
def chapter_asof(spark, sf_dir):
    seg = segments(spark, sf_dir)
    chapters = seg.filter(F.floor(F.col("start_ms") / 30_000) % 4 == 0).select("conv_id", "start_ms", F.lit("t").alias("title"))
    found = T.with_chapter(seg.select("conv_id", "start_ms"), chapters, "conv_id")
    starts = seg.groupBy("conv_id", "start_ms").agg(F.count("*").alias("n"))
    before = chapters.groupBy("conv_id").agg(F.collect_list("start_ms").alias("at"))
    counted = starts.join(before, "conv_id", "left").select("conv_id", "start_ms", (F.col("n") * F.greatest(F.lit(1), F.size(F.filter(F.coalesce("at", F.array().cast("array<bigint>")), lambda a: a <= F.col("start_ms"))))).alias("copies"))
    return found.select("conv_id", "start_ms", "chapter_start_ms").distinct().join(counted, ["conv_id", "start_ms"])


@query(f"""WITH b AS (SELECT doc_id, {strip("b")} AS block FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS b FROM documents)),
c AS (SELECT doc_id, block, {strip("split_part(block, chr(10), 1)")} AS line, regexp_matches({strip("split_part(block, chr(10), 1)")}, '^#{{1,6}}\\s') AS marked FROM b WHERE block <> ''),
e AS (SELECT doc_id, true AS marked, {strip("regexp_replace(regexp_replace(line, '^#+', ''), '#+$', '')")} AS p FROM c WHERE marked
 UNION ALL SELECT doc_id, false, {strip("substring(block, instr(block, chr(10)) + 1)")} FROM c WHERE marked AND contains(block, chr(10)) UNION ALL SELECT doc_id, false, block FROM c WHERE NOT marked),
l AS (SELECT *, len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, {quoted(X.LIST_MARK)}))) AS items, len(list_filter(string_split(p, chr(10)), lambda x: {strip("x")} <> '')) AS n FROM e WHERE p <> ''),
k AS (SELECT doc_id, p, CASE WHEN marked THEN 'heading' WHEN items >= 1 AND items * 2 >= n THEN 'list'
 WHEN NOT contains(p, chr(10)) AND length(p) <= {X.HEADING_CHARS} AND len({words("p")}) <= {X.HEADING_WORDS} AND p[1] <> '[' AND NOT regexp_matches(p, {quoted(X.LIST_MARK)}) AND NOT contains({quoted(X.HEADING_BAD_END)}, p[-1]) THEN 'heading' ELSE 'paragraph' END AS kind FROM l)
SELECT doc_id, count(*) AS blocks, count(CASE WHEN kind = 'heading' THEN 1 END) AS headings, count(CASE WHEN kind = 'list' THEN 1 END) AS lists, max(length(p)) AS longest FROM k GROUP BY doc_id""")
def text_blocks(spark, sf_dir):
    """All blocks of each document by kind: a Markdown heading line is one, what follows it in its block another."""
    rows = T.blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), of("heading").alias("headings"), of("list").alias("lists"), F.max(F.length("block")).cast("long").alias("longest"))


LINES = "SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents"


@query(f"""WITH l AS (SELECT doc_id, i, {strip("line")} AS b FROM ({LINES})),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(b, {quoted(X.LIST_MARK)}) THEN 'list'
 WHEN length(b) <= {X.HEADING_CHARS} AND len({words("b")}) <= {X.HEADING_WORDS} AND b[1] <> '[' AND NOT contains({quoted(X.HEADING_BAD_END)}, b[-1]) THEN 'heading' ELSE 'paragraph' END AS kind,
 CASE WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN {strip("regexp_replace(regexp_replace(b, '^#+', ''), '#+$', '')")} ELSE b END AS block FROM l WHERE b <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k WHERE block <> ''),
h AS (SELECT *, max(CASE WHEN kind = 'heading' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM o)
SELECT h.doc_id, h.n AS document_order, h.kind, 'e' || h.n AS element_id, coalesce(p.block, '') AS section, CASE WHEN h.at IS NULL THEN '' ELSE 'e' || h.at END AS parent_id, sha1(h.block) AS block_sha1 FROM h LEFT JOIN o AS p ON p.doc_id = h.doc_id AND p.n = h.at""")
def section_chain(spark, sf_dir):
    rows = T.chained_blocks(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")))
    return rows.select("doc_id", F.col("document_order").cast("long").alias("document_order"), "kind", "element_id", "section", "parent_id", F.sha1("block").alias("block_sha1"))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (SELECT doc_id, i, {strip("line")} AS p FROM ({LINES})) WHERE p <> ''), {packed("l", "doc_id", T.PACK_CHARS)}
SELECT doc_id, page_no, length(page)::BIGINT AS n_chars, sha1(page) AS page_sha1 FROM pages_of""")
def pack_paragraphs(spark, sf_dir):
    pages = T.packed(F.split(X.empty(F.col("text")), "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page_no", "page"))
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.length("page").cast("long").alias("n_chars"), F.sha1("page").alias("page_sha1"))


RULE = r"'^\s*\|[\s:|-]*-[\s:|-]*$'"


@query(f"""WITH RECURSIVE l AS (SELECT *, starts_with({strip("line")}, '|') AS pipe, regexp_matches(line, {RULE}) AS rule FROM ({LINES})),
c AS (SELECT *, CASE WHEN pipe <> lag(pipe, 1, pipe) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS cut FROM l),
r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run_no ORDER BY i) AS row_no, len({words("line")}) AS n FROM r),
g AS (SELECT doc_id, run_no, count(*) AS n_lines, bool_and(pipe) AND (count(*) >= 3 OR (count(*) = 2 AND bool_or(rule AND row_no = 2))) AS is_table, count(CASE WHEN pipe AND NOT rule THEN 1 END) AS n_rows,
 coalesce(max(CASE WHEN pipe AND NOT rule THEN len(string_split(regexp_replace({strip("line")}, '^\\||\\|$', '', 'g'), '|')) END), 0)::BIGINT AS n_cols, sum(n) AS n FROM p GROUP BY doc_id, run_no),
b AS (SELECT doc_id, run_no, n, row_number() OVER (PARTITION BY doc_id, run_no ORDER BY i) - 2 AS rn FROM p JOIN (SELECT doc_id, run_no FROM g WHERE n > {T.TABLE_WORDS}) USING (doc_id, run_no) WHERE {strip("line")} <> ''),
f AS (SELECT doc_id, run_no, rn, n AS held, 1::BIGINT AS parts FROM b WHERE rn = 1
 UNION ALL SELECT b.doc_id, b.run_no, b.rn, CASE WHEN f.held >= {T.PART_WORDS} THEN b.n ELSE f.held + b.n END, CASE WHEN f.held >= {T.PART_WORDS} THEN f.parts + 1 ELSE f.parts END FROM f JOIN b ON b.doc_id = f.doc_id AND b.run_no = f.run_no AND b.rn = f.rn + 1)
SELECT g.doc_id, g.run_no, g.n_lines, g.is_table, g.n_rows, g.n_cols, CASE WHEN g.n <= {T.TABLE_WORDS} THEN 1 ELSE coalesce((SELECT max(parts) FROM f WHERE f.doc_id = g.doc_id AND f.run_no = g.run_no), 0) END AS parts FROM g""")
def table_blocks(spark, sf_dir):
    rows = T.table_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select("*", F.inline(F.array(T.table_shape(F.col("block")))))  # one look at a block for both figures
    return rows.select("doc_id", F.col("run_no").cast("long").alias("run_no"), "n_lines", "is_table", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), F.size(T.table_parts(F.col("block"))).cast("long").alias("parts"))


@query(
    """WITH p AS (SELECT page_id, url, i, x, lower(regexp_extract(x, '^/?[A-Za-z][A-Za-z0-9]*')) AS tag FROM (SELECT page_id, url, unnest(range(len(cut))) AS i, unnest(cut) AS x FROM (SELECT *, string_split(regexp_replace(html, '<([A-Za-z/!?])', chr(1) || '\\1', 'g'), chr(1)) AS cut FROM pages))),
r AS (SELECT *, sum(CASE WHEN tag IN ('script', 'style') THEN 1 WHEN tag IN ('/script', '/style') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS raw FROM p),
d AS (SELECT *, sum(CASE WHEN raw > 0 THEN 0 WHEN tag IN ('nav', 'footer', 'header') THEN 1 WHEN tag IN ('/nav', '/footer', '/header') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM r),
t AS (SELECT page_id, url, i, tag, replace(replace(replace(replace(CASE WHEN i = 0 THEN x WHEN x LIKE '!--%' THEN substring(x, strpos(x, '-->') + 3) ELSE substring(x, strpos(x, '>') + 1) END, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS said FROM d WHERE raw = 0 AND depth = 0),
l AS (SELECT page_id, url, i, tag, unnest(range(len(string_split(said, chr(10))))) AS j, trim(unnest(string_split(said, chr(10))), E' \t\r\u00a0') AS line FROM t),
b AS (SELECT page_id, url, substring(string_agg(line, chr(10) ORDER BY i, j), 1, 20000) AS body, min(CASE WHEN tag = 'title' THEN line END) AS title FROM l WHERE line <> '' GROUP BY page_id, url),
u AS (SELECT page_id, lower(split_part(split_part(split_part(url, '//', 2), '/', 1), ':', 1)) AS host, CASE WHEN title IS NOT NULL THEN title || chr(10) || body ELSE body END AS x FROM b)
SELECT page_id, host, CASE WHEN list_contains(['youtube.com', 'youtu.be'], array_to_string(string_split(host, '.')[-2:], '.')) THEN 'youtube' WHEN array_to_string(string_split(host, '.')[-2:], '.') = 'instagram.com' THEN 'instagram' WHEN array_to_string(string_split(host, '.')[-2:], '.') = 'aparat.com' THEN 'aparat' ELSE 'generic' END AS provider, sha1(x) AS text_sha1, length(x)::BIGINT AS n_chars FROM u"""
)
def html_to_text(spark, sf_dir):
    rows = web.page_texts(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "provider", F.sha1("text").alias("text_sha1"), F.length("text").cast("long").alias("n_chars"))


@query("""SELECT conv_id, kind, count(*)::BIGINT AS n, sum(turn * 4000 + 100)::BIGINT AS starts, sum(turn * 4000 + 2600)::BIGINT AS ends, sha1(string_agg(x, '|' ORDER BY turn)) AS text_sha1
 FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations), (SELECT unnest(['srt', 'ttml', 'vtt']) AS kind) WHERE x <> '' GROUP BY ALL""")
def subtitle_forms(spark, sf_dir):
    """Each conversation as a VTT, an SRT and a TTML file: the cues of the three are those of its turns."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("x"), (F.col("turn") * 4000 + 100).alias("a"), (F.col("turn") * 4000 + 2600).alias("b"))

    def clock(ms, point):
        part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
        return F.concat(part(F.col(ms) / 3_600_000, 2), F.lit(":"), part(F.col(ms) / 60_000 % 60, 2), F.lit(":"), part(F.col(ms) / 1000 % 60, 2), F.lit(point), part(F.col(ms) % 1000, 3))

    escaped = F.replace(F.replace(F.replace("x", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    forms = {
        "vtt": ("WEBVTT\n\n", F.concat(clock("a", "."), F.lit(" --> "), clock("b", "."), F.lit(" align:start\n"), F.col("x")), "\n\n"),
        "srt": ("", F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), clock("a", ","), F.lit(" --> "), clock("b", ","), F.lit("\n"), F.col("x")), "\n\n"),
        "ttml": ("<tt><body><div>", F.concat(F.lit('<p xml:id="p" end="'), clock("b", "."), F.lit('" begin="'), clock("a", "."), F.lit('"><span>'), escaped, F.lit("</span></p>")), "\n"),
    }
    out = None
    for kind, (head, block, between) in forms.items():
        files = t.groupBy("conv_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), between)).alias("text"))
        found = web.cues(files, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "text"))), lambda x: x["text"]), "|")).alias("text_sha1"))
        part = found.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    r"""SELECT doc_id, sha1(t) AS redacted_sha1, ((length(t) - length(replace(t, '[email]', ''))) // 7)::BIGINT AS emails FROM (SELECT doc_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[card]', 'g'), '\+?\d[\d\s\-()]{7,}\d', '[phone]', 'g'), '\b\d{10}\b', '[id-number]', 'g') AS t FROM documents)"""
)
def pii_redact(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha1("t").alias("redacted_sha1"), F.regexp_count("t", F.lit(r"\[email\]")).cast("long").alias("emails"))


HINTS = ["translate", "continue", "file", "the "]


@query(f"""SELECT conv_id, turn, regexp_matches(coalesce(text, ''), {quoted("(?i)" + X.INJECTION)}) AS injection,
 list_has_any([{", ".join(quoted(h) for h in HINTS)}], list_filter([{", ".join(quoted(h) for h in HINTS)}], lambda h: contains(lower(coalesce(text, '')), h))) AS hinted,
 substring({strip("coalesce(text, '')")}, 1, 40) AS head FROM conversations""")
def injection_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.injection_attempt(F.col("text")).alias("injection"), X.contains_any(F.col("text"), HINTS).alias("hinted"), F.substring(X.strip(X.empty(F.col("text"))), 1, 40).alias("head"))


@query(f"""SELECT doc_id, {folded("text")}[1:20] AS head FROM documents WHERE len({words("text")}) > 0""")
def blank_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(X.strip(X.empty(F.col("text"))) != "")
    return docs.select("doc_id", F.substring(F.lower(X.normalize(F.col("text"))), 1, 20).alias("head"))
