"""Queries of retrieval and its evaluation.

Test tables stand in for the model: documents are chunked by words; language is the workspace, source the knowledge base,
the first words the title; embeddings join on their id, and vector 0 is the query's.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import vectors as V
from ..indexes import postings as P
from ..indexes import vectors as N
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import scope as S
from ..operators import structure as T
from ..session import numbered, shared_path, stored, table
from .registry import folded, listed, query, quoted, strip, terms, tokens, words
from .text_queries import CHUNK_CTE

WORKSPACE, QUESTION, TITLE_QUESTION, TOP = "en", "the with that", "doc the and with", 8
SETTINGS = R.Settings(rerank="heuristic")
SHARED_KBS = ["src1", "src2", "src3"]
PASSAGE = 9000


def chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.select("*", X.title_fallback(F.col("text")).alias("title"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = T.chunk_words(docs).join(vectors, "doc_id", "left")
    return rows.select(
        (F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("chunk_id"),
        F.col("doc_id").alias("source_id"),
        F.col("doc_id").alias("document_id"),
        F.col("chunk_no").cast("long").alias("page_no"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("kb_id"),
        "title",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "content",
        F.when(F.col("doc_id") % 17 == 0, "processing").otherwise("ready").alias("status"),
        F.lit("text").alias("type"),
        "embedding",
    )


def stored_chunks(spark, sf_dir, scope=None):
    """The chunks in scope with their terms, cut and tokenised once for all streams, as ingestion stores them."""
    rows = chunks(spark, sf_dir)
    return stored((rows.filter(scope) if scope is not None else rows).withColumn("terms", X.terms(F.col("content"))), "chunks")


def query_vector(spark, sf_dir):
    """One vector: the query's."""
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else [0.0] * 64


def cte(scope: str, table_name: str = "cand") -> str:
    return f"""{CHUNK_CTE},
chunks AS (SELECT k.doc_id * 100000 + no AS chunk_id, k.doc_id AS source_id, no AS page_no, lang AS workspace_id, source AS kb_id, substring(array_to_string(ws[1:6], ' '), 1, 80) AS title,
 'doc-' || k.doc_id || '.txt' AS filename, array_to_string(ws[no * 340 + 1 : no * 340 + 400], ' ') AS content, CASE WHEN k.doc_id % 17 = 0 THEN 'processing' ELSE 'ready' END AS status, embedding::DOUBLE[] AS embedding
 FROM k LEFT JOIN embeddings ON vec_id = k.doc_id),
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
{table_name} AS (SELECT * FROM chunks WHERE {scope} AND status = 'ready')"""


LIMIT = TOP * R.MULTIPLIER
OWN = f"workspace_id = '{WORKSPACE}'"
TERMS = R.query_terms(QUESTION)
TOKENS = sorted(set(R.query_tokens(QUESTION)))
TITLE_TOKENS = [t for t in R.query_tokens(TITLE_QUESTION) if len(t) > 2][:6]
NAMED = tokens("coalesce(title, '') || ' ' || coalesce(filename, '')")


def streams(title_tokens: list[str]) -> str:
    like = " OR ".join(f"contains(lower(title), {quoted(t)}) OR contains(lower(filename), {quoted(t)})" for t in title_tokens) or "false"
    return f"""v AS (SELECT *, row_number() OVER (ORDER BY m DESC, chunk_id) - 1 AS r FROM (SELECT chunk_id, list_cosine_similarity(embedding, qv) AS m FROM cand, q WHERE embedding IS NOT NULL) QUALIFY r < {LIMIT}),
h AS (SELECT chunk_id, list_filter({terms("content")}, lambda t: list_contains({listed(TERMS)}, t)) AS hit FROM cand),
f AS (SELECT *, row_number() OVER (ORDER BY m DESC, chunk_id) - 1 AS r FROM (SELECT chunk_id, len(hit) AS m FROM h WHERE len(list_distinct(hit)) = {len(TERMS)}) QUALIFY r < {LIMIT}),
t AS (SELECT *, row_number() OVER (ORDER BY m DESC, chunk_id) - 1 AS r FROM (SELECT chunk_id, len(list_filter({listed(title_tokens)}, lambda t: list_contains({NAMED}, t))) AS m FROM cand WHERE {like}) WHERE m > 0 QUALIFY r < {LIMIT})"""


def fused(title_tokens: list[str]) -> str:
    return f"""{streams(title_tokens)},
u AS (SELECT chunk_id, max(vr) AS vr, max(fr) AS fr, max(tr) AS tr FROM (SELECT chunk_id, r AS vr, NULL::BIGINT AS fr, NULL::BIGINT AS tr FROM v UNION ALL SELECT chunk_id, NULL, r, NULL FROM f UNION ALL SELECT chunk_id, NULL, NULL, r FROM t) GROUP BY chunk_id),
s AS (SELECT *, coalesce(1e0 / (61 + vr), 0e0) + coalesce(1e0 / (61 + fr), 0e0) + coalesce(1e0 / (61 + tr), 0e0) AS score, coalesce(vr, 1000000 + fr, 2000000 + tr) AS seen FROM u),
fu AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen) - 1 AS p FROM s QUALIFY p < {TOP}),
b0 AS (SELECT fu.*, cand.content, cand.filename, cand.source_id, cand.title, len(list_intersect(list_distinct({NAMED}), {listed(TOKENS)})) / {float(len(TOKENS))}e0 AS c FROM fu JOIN cand USING (chunk_id)),
b1 AS (SELECT * REPLACE (score * (1 + c) + CASE WHEN c >= 0.99 THEN 0.25e0 ELSE 0e0 END AS score) FROM b0),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, p) - 1 AS pos FROM b1),
d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY sha1({_norm("content")}) ORDER BY pos) = 1)"""


def _norm(x: str) -> str:
    return folded(x).removeprefix("lower(").removesuffix(")")


RERANK = f"""rr AS (SELECT *, {tokens("content")} AS tk FROM d),
final AS (SELECT *, CASE WHEN len(tk) > 0 THEN len(list_intersect(list_distinct(tk), {listed(TOKENS)})) / {float(len(TOKENS))}e0 + 0.5e0 * (len(list_intersect(list_distinct(tk[1:30]), {listed(TOKENS)})) / {float(len(TOKENS))}e0)
 + CASE WHEN contains(array_to_string(tk, ' '), {quoted(" ".join(R.query_tokens(QUESTION)))}) THEN 0.5e0 ELSE 0e0 END + len(list_intersect(list_distinct({tokens("filename")}), {listed(TOKENS)})) / {float(len(TOKENS))}e0 + 0.01e0 * score ELSE 0e0 END AS rs FROM rr)"""
FINAL = "SELECT row_number() OVER (ORDER BY rs DESC, pos) - 1 AS position, chunk_id, source_id, round(score, 6) AS score, round(rs, 6) AS rerank_score, vr::BIGINT AS vector_rank, fr::BIGINT AS fts_rank, tr::BIGINT AS title_rank FROM final"
PLAIN_TITLES = [t for t in R.query_tokens(QUESTION) if len(t) > 2][:6]


def shown(hits):
    return hits.select(F.col("position").cast("long").alias("position"), "chunk_id", "source_id", F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"), *[F.col(r).cast("long").alias(r) for r in ("vector_rank", "fts_rank", "title_rank")])


@query(f"WITH {cte(OWN)}, {fused(PLAIN_TITLES)}, {RERANK} {FINAL}")
def hybrid_search(spark, sf_dir):
    return shown(R.hybrid_search(stored_chunks(spark, sf_dir, F.col("workspace_id") == WORKSPACE), WORKSPACE, QUESTION, query_vector(spark, sf_dir), top_k=TOP, settings=SETTINGS))


@query(f"""WITH {cte(OWN)}, {fused(PLAIN_TITLES)} SELECT 'vector' AS stream, count(*) AS n, round(max(m), 6) AS best FROM v UNION ALL SELECT 'fts', count(*), max(m) FROM f UNION ALL SELECT 'title', count(*), max(m) FROM t
 UNION ALL SELECT 'fused', count(*), NULL FROM fu UNION ALL SELECT 'kept', count(*), NULL FROM d""")
def search_trace(spark, sf_dir):
    """What a search counts while it runs."""
    trace: R.Trace = {}
    rows = S.candidates(stored_chunks(spark, sf_dir, F.col("workspace_id") == WORKSPACE), WORKSPACE)
    R.search_in(rows, QUESTION, query_vector(spark, sf_dir), TOP, SETTINGS, trace).collect()
    return spark.createDataFrame([(name, x["rows"], x.get("best")) for name, x in R.traced(trace).items()], "stream string, n long, best double").withColumn("best", F.round("best", 6))


@query(f"WITH {cte(f'kb_id IN ({", ".join(map(quoted, SHARED_KBS))})')}, {fused(PLAIN_TITLES)}, {RERANK} {FINAL}")
def hybrid_search_global(spark, sf_dir):
    shared = stored_chunks(spark, sf_dir, F.col("kb_id").isin(SHARED_KBS)).withColumn("workspace_id", F.lit(None).cast("string"))
    return shown(R.hybrid_search_global(shared, SHARED_KBS, QUESTION, query_vector(spark, sf_dir), top_k=TOP, settings=SETTINGS))


@query(f"WITH {cte(OWN)} SELECT kb_id, count(*) AS n_chunks, count(DISTINCT source_id) AS n_sources, count(embedding) AS n_embedded FROM cand GROUP BY kb_id")
def candidate_filter(spark, sf_dir):
    rows = S.candidates(chunks(spark, sf_dir), WORKSPACE)
    return rows.groupBy("kb_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("source_id").alias("n_sources"), F.count("embedding").alias("n_embedded"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS workspace_id, source AS kb_id FROM documents), a AS (SELECT DISTINCT lang AS workspace_id, source AS kb_id FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, workspace_id, kb_id FROM d WHERE workspace_id = 'en' OR (workspace_id IS NULL AND EXISTS (SELECT 1 FROM a WHERE a.workspace_id = 'en' AND a.kb_id = d.kb_id))""")
def row_security(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("workspace_id"), F.col("source").alias("kb_id"))
    given = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("lang").alias("workspace_id"), F.col("source").alias("kb_id")).distinct()
    return S.visible_rows(docs, S.Scope("en"), given)


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label::BIGINT AS label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, vec_id LIMIT {LIMIT}""")
def vector_topk(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    scored = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), V.cosine(F.col("embedding"), V.vector(q), F.lit(sum(x * x for x in q) ** 0.5)).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(LIMIT).select("vec_id", "label", F.round("s", 6).alias("similarity"))


def stream_shown(df, metric, rank):
    return df.select("chunk_id", F.col(metric).cast("long").alias(metric), F.col(rank).cast("long").alias(rank))


@query(f"WITH {cte(OWN)}, {streams(PLAIN_TITLES)} SELECT chunk_id, m::BIGINT AS frequency, r AS fts_rank FROM f")
def fts_all_terms(spark, sf_dir):
    return stream_shown(R.fulltext_stream(S.candidates(chunks(spark, sf_dir), WORKSPACE), QUESTION, LIMIT), "frequency", "fts_rank")


def text_index(spark, sf_dir):
    """Posting lists of all ready chunks of every workspace."""
    path = shared_path(spark, "postings")
    P.write(chunks(spark, sf_dir).filter("status = 'ready'"), path)
    return path


@query(f"WITH {cte(OWN)}, {streams(PLAIN_TITLES)} SELECT chunk_id, m::BIGINT AS frequency, r AS fts_rank FROM f")
def fts_indexed(spark, sf_dir):
    return stream_shown(P.search(spark, text_index(spark, sf_dir), WORKSPACE, QUESTION, LIMIT), "frequency", "fts_rank")


NEAR = "CASE WHEN a.pos = b.pos THEN 1e0 ELSE 1 - sqrt(0.01e0 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005e0 + 0.05e0 * exp(abs(a.pos - b.pos) / 1.5e0 - 2)) END) END"


@query(f"""WITH {cte(OWN)}, oc AS (SELECT chunk_id, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT chunk_id, {terms("content")} AS ts FROM cand)),
mt AS (SELECT chunk_id, term, pos FROM oc WHERE term IN ({", ".join(map(quoted, TERMS))}) QUALIFY row_number() OVER (PARTITION BY chunk_id, term ORDER BY pos) <= 256),
wt AS (SELECT a.chunk_id, round(1 - product({NEAR}), 9) AS weight FROM mt AS a JOIN mt AS b ON a.chunk_id = b.chunk_id AND a.term < b.term GROUP BY 1),
fr AS (SELECT chunk_id, count(*) AS frequency FROM mt GROUP BY 1 HAVING count(DISTINCT term) = {len(TERMS)})
SELECT chunk_id, frequency, round(weight, 6) AS weight, row_number() OVER (ORDER BY weight DESC, chunk_id) - 1 AS fts_rank FROM fr JOIN wt USING (chunk_id) QUALIFY fts_rank < {LIMIT}""")
def fts_weighted(spark, sf_dir):
    found = P.search(spark, text_index(spark, sf_dir), WORKSPACE, QUESTION, LIMIT, rank="weighted")
    return found.select("chunk_id", "frequency", F.round("weight", 6).alias("weight"), F.col("fts_rank").cast("long").alias("fts_rank"))


def vector_index(spark, sf_dir):
    path = shared_path(spark, "vectors")
    N.build(table(spark, sf_dir, "embeddings"), path)
    return path


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, vec_id LIMIT {LIMIT}""")
def ann_exact(spark, sf_dir):
    """The index opens every list that can hold a nearer vector, so the rows are those of a full scan."""
    found = N.search(spark, vector_index(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, exact=True)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query()
def ann_neighbours(spark, sf_dir):
    """Ten neighbours of each row whose id is divisible by 100, among all rows, in the lists that reach the index's recall; no SQL, as a list
    that isn't opened is lost by design: tests hold its recall against brute force."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return N.neighbours(asked, vector_index(spark, sf_dir)).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {cte(OWN)} SELECT chunk_id, m::BIGINT AS frequency, row_number() OVER (ORDER BY m DESC, chunk_id) - 1 AS fts_rank FROM (SELECT chunk_id, {" + ".join(f"contains(content, {quoted(t)})::INT" for t in TOKENS)} AS m FROM cand) WHERE m > 0 QUALIFY fts_rank < {LIMIT}""")
def fts_any_term(spark, sf_dir):
    return stream_shown(R.fulltext_stream(S.candidates(chunks(spark, sf_dir), WORKSPACE), QUESTION, LIMIT, all_terms=False), "frequency", "fts_rank")


@query(f"WITH {cte(OWN)}, {streams(TITLE_TOKENS)} SELECT chunk_id, m::BIGINT AS cover, r AS title_rank FROM t")
def title_stream(spark, sf_dir):
    return stream_shown(R.title_stream(S.candidates(chunks(spark, sf_dir), WORKSPACE), TITLE_QUESTION, LIMIT), "cover", "title_rank")


def three_streams(spark, sf_dir):
    rows = S.candidates(stored_chunks(spark, sf_dir, F.col("workspace_id") == WORKSPACE), WORKSPACE)
    return [(R.vector_stream(rows, query_vector(spark, sf_dir), LIMIT), "vector_rank"), (R.fulltext_stream(rows, QUESTION, LIMIT), "fts_rank"), (R.title_stream(rows, QUESTION, LIMIT), "title_rank")]


@query(f"WITH {cte(OWN)}, {fused(PLAIN_TITLES)} SELECT p AS position, chunk_id, round(score, 6) AS score FROM fu")
def rrf_fusion(spark, sf_dir):
    return R.fuse(three_streams(spark, sf_dir), TOP).select(F.col("position").cast("long").alias("position"), "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {cte(OWN)}, {fused(PLAIN_TITLES)} SELECT pos AS position, chunk_id, round(score, 6) AS score FROM b")
def title_boost(spark, sf_dir):
    return R.title_boost(R.fuse(three_streams(spark, sf_dir), TOP), QUESTION).select(F.col("position").cast("long").alias("position"), "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {cte(OWN)}, {fused(PLAIN_TITLES)} SELECT chunk_id FROM fu WHERE score >= 0.016e0")
def threshold(spark, sf_dir):
    return R.threshold(R.fuse(three_streams(spark, sf_dir), TOP), 0.016).select("chunk_id")


@query(f"""WITH {cte("true", "cand")}, pl AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id DESC) - 1 AS position, sha1({_norm("content")}) AS h, {strip("content")} = '' AS blank FROM cand)
SELECT chunk_id, position FROM pl WHERE blank OR position = (SELECT min(position) FROM pl AS o WHERE o.h = pl.h)""")
def content_dedupe(spark, sf_dir):
    """All chunks as hits, the last chunk first: of equal contents the best-placed one stays."""
    rows = chunks(spark, sf_dir).filter("status = 'ready'").select("chunk_id", "content")
    return R.dedupe_content(numbered(rows, "position", F.desc("chunk_id"))).select("chunk_id", "position")


@query(f"""WITH RECURSIVE {cte(OWN)}, {fused(PLAIN_TITLES)}, near AS (SELECT c.chunk_id, max(fu.score - abs(c.page_no - a.page_no) * 1e-4) AS score FROM fu JOIN cand AS a USING (chunk_id) JOIN cand AS c ON c.source_id = a.source_id GROUP BY c.chunk_id),
n AS (SELECT chunk_id, source_id, page_no, list(chunk_id) OVER o AS ids, array_to_string(list(content) OVER o, chr(10)) AS x, first_value(content) OVER (PARTITION BY source_id ORDER BY page_no) AS head FROM cand WINDOW o AS (PARTITION BY source_id ORDER BY page_no, chunk_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
win AS (SELECT n.*, score, CASE WHEN page_no >= 2 AND page_no % 3 <> 2 AND {strip("head")} <> '' THEN '[' || {strip("head")} || ']' || chr(10) ELSE '' END || x AS whole, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) AS rn FROM near JOIN n USING (chunk_id)),
cover AS (SELECT source_id, rn, chunk_id, true AS kept, ids AS seen FROM win WHERE rn = 1
 UNION ALL SELECT source_id, rn, chunk_id, fresh, CASE WHEN fresh THEN list_concat(seen, ids) ELSE seen END FROM (SELECT w.source_id, w.rn, w.chunk_id, w.ids, c.seen, NOT list_has_all(c.seen, w.ids) AS fresh FROM cover AS c JOIN win AS w ON w.source_id = c.source_id AND w.rn = c.rn + 1)),
cut AS (SELECT chunk_id, score, CASE WHEN length(whole) > {PASSAGE} THEN whole[1:{PASSAGE}] || '…' ELSE whole END AS passage FROM win JOIN cover USING (chunk_id) WHERE kept)
SELECT chunk_id, round(score, 6) AS score, length(passage)::BIGINT AS n_chars, sha1(passage) AS passage_sha1 FROM cut""")
def passage_windows(spark, sf_dir):
    """Windows of all chunks of the documents that hold a fused hit, those near to it first: most are covered by better ones. A
    document's first chunk is the heading of two chunks in three."""
    rows = S.candidates(stored_chunks(spark, sf_dir, F.col("workspace_id") == WORKSPACE), WORKSPACE)
    rows = rows.withColumn("element_id", F.concat(F.lit("c"), F.col("page_no").cast("string"))).withColumn("parent_id", F.when(F.col("page_no") % 3 != 2, "c0"))
    hits = R.fuse(three_streams(spark, sf_dir), TOP).select("chunk_id", "score")
    found = rows.select("chunk_id", "document_id", "page_no").join(F.broadcast(hits), "chunk_id").select("document_id", F.col("page_no").alias("at"), "score")
    near = rows.select("chunk_id", "document_id", "page_no").join(F.broadcast(found), "document_id").groupBy("chunk_id").agg(F.max(F.col("score") - F.abs(F.col("page_no") - F.col("at")) * F.lit(1e-4)).alias("score"))
    own = R.passages(near, rows, cap=PASSAGE)
    return own.select("chunk_id", F.round("score", 6).alias("score"), F.length("passage").cast("long").alias("n_chars"), F.sha1("passage").alias("passage_sha1"))


@query(f"WITH {cte(OWN)}, {fused(PLAIN_TITLES)}, so AS (SELECT source_id, count(*) AS n, min(pos) AS first FROM b GROUP BY source_id), sh AS (SELECT *, n / sum(n) OVER () AS share FROM so) SELECT source_id, n, round(share, 6) AS share FROM sh WHERE n >= 1 AND share >= 0.05 ORDER BY n DESC, first LIMIT 1")
def fulltext_trigger(spark, sf_dir):
    hits = R.title_boost(R.fuse(three_streams(spark, sf_dir), TOP), QUESTION)
    return R.dominant_source(hits, share=0.05, least=1).withColumn("share", F.round("share", 6))


@query(f"""WITH {cte("true")}, x AS (SELECT chunk_id, list_cosine_similarity(embedding, qv) AS m, 0 AS src FROM cand, q WHERE workspace_id = 'en' AND embedding IS NOT NULL UNION ALL SELECT chunk_id, list_cosine_similarity(embedding, qv) * 0.9e0, 1 FROM cand, q WHERE kb_id IN ('src1', 'src2', 'src3') AND embedding IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY m DESC, chunk_id) AS r FROM x), best AS (SELECT * FROM o WHERE r <= 10 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY m DESC, src) = 1)
SELECT row_number() OVER (ORDER BY m DESC, src, chunk_id) - 1 AS position, chunk_id, round(m, 6) AS score FROM best QUALIFY position < 6""")
def kb_fanout_merge(spark, sf_dir):
    rows, q = chunks(spark, sf_dir).filter("status = 'ready'"), query_vector(spark, sf_dir)
    a = R.vector_stream(rows.filter("workspace_id = 'en'"), q, 10).select("chunk_id", F.col("similarity").alias("score"))
    b = R.vector_stream(rows.filter(F.col("kb_id").isin(SHARED_KBS)), q, 10).select("chunk_id", (F.col("similarity") * 0.9).alias("score"))
    return R.merge_scopes([a, b], 6).select(F.col("position").cast("long").alias("position"), "chunk_id", F.round("score", 6).alias("score"))


def eval_inputs(spark, sf_dir):
    """Benchmark items as questions: documents with an item's first eight words are expected; those that share most of its
    longer words come back (eight at most). Both meet on words, and each item's ranking is cut inside its group."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), X.words(F.lower(F.col("text"))).alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.words(F.lower(F.col("text"))).alias("w"))
    start = lambda i: F.xxhash64(F.slice("w", i, F.lit(8)))  # noqa: E731  eight words as one number: no text is built or shuffled
    keys = items.filter(F.size("w") >= 8).select("question_id", start(F.lit(1)).alias("key"))
    there = docs.filter(F.size("w") >= 8).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), start)).alias("key"))
    there = there.join(keys.select("key").distinct(), "key", "left_semi").distinct()
    expected = keys.join(there, "key").groupBy("question_id").agg(F.collect_set(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("expected"))
    questions = items.select("question_id").join(expected, "question_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>"))).withColumn("keywords", F.array().cast("array<string>"))
    longer = lambda df, name: df.select(name, F.explode(F.array_distinct(F.filter("w", lambda x: F.length(x) > 6))).alias("t"))
    # an index of the items by word: the documents' words meet it once, and a hot word carries its questions as one row
    index = longer(items, "question_id").groupBy("t").agg(F.collect_list("question_id").alias("questions"))
    shared = longer(docs, "doc_id").join(index, "t").select("doc_id", F.explode("questions").alias("question_id")).groupBy("question_id", "doc_id").agg(F.count("*").alias("n"))
    ranked = shared.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("n"), "doc_id"))).filter("rank <= 8")
    returned = ranked.select("question_id", "rank", "n", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), F.lit("").alias("text"))
    return questions, returned


LOW = words("lower(text)")
def evaluated(most: int) -> str:
    return f"""i AS (SELECT item_id AS question_id, {LOW} AS w FROM benchmark), d AS (SELECT doc_id, {LOW} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS j FROM d WHERE len(w) >= 8)),
ex AS (SELECT question_id, doc_id FROM (SELECT question_id, array_to_string(w[1:8], ' ') AS key FROM i WHERE len(w) >= 8) JOIN sh USING (key)),
qt AS (SELECT DISTINCT question_id, t FROM (SELECT question_id, unnest(w) AS t FROM i) WHERE length(t) > 6), dt AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE length(t) > 6),
ra AS (SELECT question_id, doc_id, n, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT question_id, doc_id, count(*) AS n FROM qt JOIN dt USING (t) GROUP BY ALL) QUALIFY rank <= {most}),
rel AS (SELECT ra.*, (ex.doc_id IS NOT NULL)::INT AS rel FROM ra LEFT JOIN ex USING (question_id, doc_id)),
pq AS (SELECT question_id, count(*) AS hits, sum(rel) AS rel, sum(rel / log2(rank + 1)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first, max(n) AS top FROM rel GROUP BY question_id),
ne AS (SELECT question_id, count(*) AS ne FROM ex GROUP BY question_id),
id AS (SELECT question_id, sum(1e0 / log2(g + 1)) AS idcg FROM (SELECT question_id, unnest(range(1, rel::BIGINT + 1)) AS g FROM pq) GROUP BY question_id),
m AS (SELECT i.question_id, coalesce(hits, 0) AS hits, coalesce(ne, 0) AS ne, round(CASE WHEN ne > 0 THEN coalesce(rel, 0) / ne ELSE 1 END, 4) AS recall_at_k, round(CASE WHEN hits > 0 THEN rel / hits WHEN ne IS NULL THEN 1 ELSE 0 END, 4) AS precision_at_k,
 round(CASE WHEN idcg > 0 THEN dcg / idcg WHEN ne IS NULL THEN 1 ELSE 0 END, 4) AS ndcg_at_k, round(coalesce(1e0 / first, 0), 4) AS mrr, 1e0 AS keyword_coverage, coalesce(top, 0) AS top FROM i LEFT JOIN pq USING (question_id) LEFT JOIN ne USING (question_id) LEFT JOIN id USING (question_id))"""


EVAL = evaluated(8)


@query(f"WITH {EVAL} SELECT question_id, hits, recall_at_k, precision_at_k, ndcg_at_k, mrr, keyword_coverage FROM m")
def eval_rows(spark, sf_dir):
    return E.question_metrics(*eval_inputs(spark, sf_dir))


def eval_arms(spark, sf_dir):
    """Both arms' metrics: the ranking as it is, and with its first four results alone."""
    questions, returned = eval_inputs(spark, sf_dir)
    top = returned.groupBy("question_id").agg(F.max("n").cast("double").alias("top_score"))
    answerable = questions.select("question_id", (F.size("expected") == 0).alias("unanswerable"), F.when(F.col("question_id") % 2 == 0, "factual").otherwise("multi").alias("type"))
    arms = None
    for arm, most in (("none", 8), ("short", 4)):
        part = E.question_metrics(questions, returned.filter(F.col("rank") <= most)).withColumn("arm", F.lit(arm))
        arms = part if arms is None else arms.unionByName(part)
    return arms.join(answerable, "question_id").join(top, "question_id", "left")


@query(f"WITH {EVAL} SELECT 'none' AS arm, count(*) AS n, count(CASE WHEN ne > 0 THEN 1 END) AS n_answerable, round(avg(CASE WHEN ne > 0 THEN recall_at_k END), 2) AS avg_recall_at_k, round(avg(CASE WHEN ne = 0 THEN top END), 4) AS unanswerable_avg_top_score FROM m")
def eval_summary(spark, sf_dir):
    rows = E.summary(eval_arms(spark, sf_dir).filter("arm = 'none'"), "arm")
    return rows.select("arm", "n", "n_answerable", "avg_recall_at_k", "unanswerable_avg_top_score")


LONG = "UNPIVOT (SELECT question_id, recall_at_k, precision_at_k, ndcg_at_k, mrr, keyword_coverage FROM m) ON COLUMNS(* EXCLUDE question_id) INTO NAME metric VALUE v"


@query(f"""WITH a AS (WITH {EVAL} {LONG}), b AS (WITH {evaluated(4)} {LONG})
SELECT question_id, metric, a.v AS base, b.v AS other, round(b.v - a.v, 4) AS delta FROM a JOIN b USING (question_id, metric)""")
def eval_delta(spark, sf_dir):
    return E.arm_delta(eval_arms(spark, sf_dir), "none", "short")
