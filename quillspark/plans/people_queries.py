"""Queries of the usage ledger, memory, profiles, plans, leads and ingest states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ledger as L
from ..operators import people as P
from ..operators import scope as S
from ..session import table
from ..streaming import jobs as J
from .registry import listed, query, quoted, strip, words

MODELS = ["gpt-4o-mini", "gemini-2.0-flash", "unlisted-model"]


def usage(spark, sf_dir):
    """events as usage: the type is the span, tokens come from ids, the value is the latency, errors are failures."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("span"),
        F.when(n % 3 == 1, "gemini").otherwise("openai_compat").alias("provider"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (n % 3 + 1).cast("int")).alias("model"),
        (n % 1000).alias("prompt_tokens"),
        (n % 500).alias("completion_tokens"),
        F.lit(1).alias("calls"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
    )


USAGE = """u0 AS (SELECT event_id, ts AS created_at, user_id::VARCHAR AS user_id, event_type AS span, CASE WHEN event_id % 3 = 1 THEN 'gemini' ELSE 'openai_compat' END AS provider,
 ['gpt-4o-mini', 'gemini-2.0-flash', 'unlisted-model'][event_id % 3 + 1] AS model, event_id % 1000 AS prompt_tokens, event_id % 500 AS completion_tokens, 1 AS calls, value AS latency_ms, event_type <> 'error' AS ok FROM events),
u AS (SELECT *, CASE model WHEN 'gpt-4o-mini' THEN round((prompt_tokens * 0.00015 + completion_tokens * 0.00060) * 0.001, 6)::DOUBLE WHEN 'gemini-2.0-flash' THEN round((prompt_tokens * 0.00010 + completion_tokens * 0.00040) * 0.001, 6)::DOUBLE END AS cost_usd FROM u0)"""
SUMS = "count(*) AS events, coalesce(sum(calls), 0)::BIGINT AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, round(coalesce(sum(cost_usd), 0e0), 4) AS cost_usd, count(CASE WHEN NOT ok THEN 1 END) AS errors, round(avg(latency_ms), 1) AS avg_latency_ms"


def priced(spark, sf_dir):
    return L.with_cost(usage(spark, sf_dir), L.prices(spark))


@query(f"WITH {USAGE} SELECT event_id, cost_usd FROM u")
def usage_cost(spark, sf_dir):
    return priced(spark, sf_dir).select("event_id", "cost_usd")


@query(f"WITH {USAGE} SELECT {SUMS} FROM u WHERE created_at >= TIMESTAMP '2024-01-02'")
def usage_totals(spark, sf_dir):
    rows = L.filtered(priced(spark, sf_dir), since="2024-01-02T00:00:00Z")
    return L.totals(rows).withColumn("cost_usd", F.round("cost_usd", 4))


@query(f"WITH {USAGE} SELECT span, provider, model, {SUMS} FROM u GROUP BY span, provider, model")
def usage_by_model(spark, sf_dir):
    return L.by_model(priced(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 4))


@query("SELECT event_id, user_id::VARCHAR AS user_id, event_type AS span FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def usage_recent(spark, sf_dir):
    return L.recent(L.filtered(usage(spark, sf_dir), span="purchase")).select("event_id", "user_id", "span")


@query("SELECT event_id, greatest(event_id % 7 - 3, 0) AS prompt_tokens, greatest(event_id % 3, 1) AS calls, substring(repeat(event_type, 20), 1, 50) AS provider FROM events WHERE event_type IN ('click', 'view')")
def usage_append(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("span"), (F.col("event_id") % 7 - 3).alias("prompt_tokens"), (F.col("event_id") % 3).alias("calls"), F.repeat("event_type", 20).alias("provider"))
    return L.cleaned(rows, ["click", "view"]).select("event_id", "prompt_tokens", "calls", "provider")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def memory_latest(spark, sf_dir):
    return P.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


CATEGORY = {0: "goal", 1: "preference"}
MEMORY_WORDS = ["en", "le", "the", "with"]


@query(f"""WITH f AS (SELECT conv_id, turn, list_distinct(list_filter({words("lower(coalesce(text, ''))")}, lambda t: length(t) > 1)) AS w, CASE conv_id % 3 WHEN 0 THEN 2.0e0 WHEN 1 THEN 1.5e0 ELSE 1.0e0 END AS b FROM conversations WHERE role = 'user')
SELECT conv_id, turn, len(list_intersect(w, {listed(MEMORY_WORDS)})) * b AS score FROM f WHERE len(list_intersect(w, {listed(MEMORY_WORDS)})) > 0 ORDER BY score DESC, conv_id * 1000 + turn DESC LIMIT 20""")
def memory_recall(spark, sf_dir):
    user = table(spark, sf_dir, "conversations").filter("role = 'user'")
    kind = F.when(F.col("conv_id") % 3 == 0, "goal").when(F.col("conv_id") % 3 == 1, "preference").otherwise("fact")
    facts = user.select("conv_id", "turn", F.lit("").alias("key"), F.col("text").alias("value"), kind.alias("category"), (F.col("conv_id") * 1000 + F.col("turn")).alias("updated_at"))
    return P.recall(facts, " ".join(MEMORY_WORDS), 20).select("conv_id", "turn", "score")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)")
def history_last_n(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return P.history(rows, "conv_id", "turn", 2).withColumn("place", F.col("place").cast("long"))


@query("""WITH a AS (SELECT user_id, ['R','I','A','S','E','C'][event_id % 6 + 1] AS t, (event_id // 6) % 7 AS v FROM events), s AS (SELECT user_id, t, sum(v) AS s, count(*) AS n FROM a WHERE v BETWEEN 1 AND 5 GROUP BY ALL),
g AS (SELECT user_id, t, coalesce(s, 0) AS s FROM (SELECT DISTINCT user_id FROM s) CROSS JOIN (SELECT unnest(['R','I','A','S','E','C']) AS t) LEFT JOIN s USING (user_id, t)), n AS (SELECT user_id, sum(n)::BIGINT AS answered FROM s GROUP BY user_id)
SELECT user_id, answered, string_agg(t, '' ORDER BY s DESC, t) [1:3] AS code FROM g JOIN n USING (user_id) WHERE answered >= 12 GROUP BY ALL""")
def quiz_score(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.element_at(F.split(F.lit("R,I,A,S,E,C"), ","), (n % 6 + 1).cast("int")).alias("interest"), F.floor(n / 6).cast("long").alias("q")).withColumn("answer", (F.col("q") % 7).cast("string"))
    return P.quiz_scores(rows, "user_id").select("user_id", "answered", "code")


@query("""WITH j AS (SELECT p_partkey AS job_id, p_brand AS title, p_type AS job_group, ['SIA', 'RIE', 'SEA', 'xx'][p_partkey % 4 + 1] AS interests FROM part),
m AS (SELECT *, upper(regexp_extract(interests, '^\\s*([A-Za-z]{3})', 1)) AS code FROM j), c AS (SELECT *, contains(code, 'S')::INT + contains(code, 'I')::INT + contains(code, 'A')::INT AS matched FROM m WHERE code <> ''),
o AS (SELECT * FROM c WHERE matched > 0 QUALIFY row_number() OVER (PARTITION BY title, job_group ORDER BY job_id) = 1)
SELECT title, job_group, code, matched::BIGINT AS matched, count(*) OVER () AS total FROM o ORDER BY matched DESC, title, job_group LIMIT 20""")
def job_match(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in ("SIA", "RIE", "SEA", "xx")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_brand").alias("title"), F.col("p_type").alias("job_group"), code.alias("interests"))
    return P.match_jobs(jobs, "SIA").withColumn("matched", F.col("matched").cast("long"))


@query("""WITH b AS (SELECT c_custkey, c_nationkey::VARCHAR AS ws, c_mktsegment AS name, (c_custkey % 50)::VARCHAR AS address FROM customer), s AS (SELECT s_nationkey::VARCHAR AS ws, 'BUILDING' AS name, (s_suppkey % 50)::VARCHAR AS address FROM supplier)
SELECT ws AS workspace_id, min(c_custkey) AS lead_id, name, address FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ws = b.ws AND s.name = b.name AND s.address = b.address) GROUP BY ws, name, address""")
def lead_dedupe(spark, sf_dir):
    batch = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("workspace_id"), F.col("c_custkey").alias("lead_id"), F.concat(F.lit(" "), "c_mktsegment").alias("name"), (F.col("c_custkey") % 50).cast("string").alias("address"))
    stored = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("workspace_id"), F.lit("BUILDING").alias("name"), (F.col("s_suppkey") % 50).cast("string").alias("address"))
    return P.new_leads(batch, stored, "lead_id").withColumn("name", X.strip(F.col("name")))


@query("""WITH r AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 7 AS k FROM documents),
c AS (SELECT doc_id, t, k, trim(left(t, 300), E' \t\n\r') AS name FROM r WHERE k <> 0)
SELECT doc_id AS place_id, sha1(name) AS name_sha1, length(trim(left(t || t, 1000), E' \t\n\r'))::BIGINT AS address_chars, length(trim(left(t, 100), E' \t\n\r'))::BIGINT AS phone_chars,
 CASE WHEN k = 1 THEN 'open' ELSE 'late' END AS hours, CASE WHEN k = 2 THEN 'HTTPS://x.example/' || doc_id ELSE '' END AS website, CASE WHEN k IN (3, 4) THEN doc_id * 1.5e0 END AS lat, CASE WHEN k <> 5 THEN doc_id / 4e0 END AS lng FROM c WHERE name <> ''""")
def places_clean(spark, sf_dir):
    """Documents as untrusted places; no bound on the rows, so that all of them are seen."""
    n, k, t = F.col("doc_id"), F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    number = lambda x: F.concat(F.lit(" "), x.cast("string"), F.lit(" "))
    rows = table(spark, sf_dir, "documents").select(
        n.alias("place_id"), F.when(k != 0, t).otherwise("  ").alias("name"), F.concat(t, t).alias("address"), t.alias("phone"),
        F.when(k == 1, "open").alias("hours"), F.lit(" late").alias("opening_hours"), F.concat(F.when(k == 2, " HTTPS://x.example/").otherwise("javascript:"), n.cast("string")).alias("website"),
        F.when(k.isin(3, 4), number(n * 1.5)).otherwise("north").alias("lat"), F.when(k != 5, number(n / 4)).alias("lon"), F.lit(None).cast("string").alias("lng"),
    )
    clean = P.clean_places(rows, most=None)
    return clean.select("place_id", F.sha1("name").alias("name_sha1"), F.length("address").cast("long").alias("address_chars"), F.length("phone").cast("long").alias("phone_chars"), "hours", "website", "lat", "lng")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'http://x.example/' || doc_id ELSE 'title' END AS title, CASE WHEN doc_id % 4 IN (1, 2) THEN 'http://x.example/' || doc_id ELSE '' END AS uri,
 length(trim(left(coalesce(text, ''), 2000), E' \t\n\r'))::BIGINT AS snippet_chars FROM documents""")
def web_clean(spark, sf_dir):
    """Documents as untrusted web results: addresses that aren't http count as content before they are blanked."""
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k >= 2, " title ").otherwise("").alias("title"), F.concat(F.when(k.isin(1, 2), "http://x.example/").otherwise("ftp:"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"))
    return P.clean_web(rows, most=None).select("doc_id", "title", "uri", F.length("snippet").cast("long").alias("snippet_chars"))


@query("""WITH o AS (SELECT doc_id, 'doc ' || source || '.txt' AS filename, lang FROM documents WHERE lang = 'en'), g AS (SELECT doc_id, 'doc ' || source || '.txt' AS filename FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id AS source_id, filename, CASE WHEN doc_id IN (SELECT doc_id FROM o) THEN 'workspace' ELSE 'global' END AS scope FROM (SELECT doc_id, filename FROM o UNION SELECT doc_id, filename FROM g)""")
def file_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.concat_ws("", F.lit("doc "), "source", F.lit(".txt")).alias("filename"), "lang")
    return P.file_inventory(docs.filter("lang = 'en'").drop("lang"), docs.filter("source_id % 5 = 0").drop("lang"))


@query("""SELECT 'doc ' || source || '.txt' AS filename, 1::BIGINT AS overlap FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY 1 LIMIT 4""")
def file_ambiguity(spark, sf_dir):
    files = table(spark, sf_dir, "documents").filter("source is not null").select(F.concat_ws("", F.lit("doc "), "source", F.lit(".txt")).alias("filename"))
    return P.file_options(files, "read doc please").withColumn("overlap", F.col("overlap").cast("long"))


@query("""SELECT doc_id, CASE WHEN s = 'failed' THEN 'failed' WHEN s = 'ready' THEN 'done' WHEN s = 'processing' AND doc_id % 2 = 1 THEN 'active' ELSE 'waiting' END AS vision, CASE WHEN s = 'failed' THEN 'failed' WHEN s = 'ready' THEN 'done' ELSE 'waiting' END AS result
FROM (SELECT doc_id, ['pending', 'processing', 'ready', 'failed'][doc_id % 4 + 1] AS s FROM documents)""")
def stage_status(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in ("pending", "processing", "ready", "failed")]), (F.col("doc_id") % 4 + 1).cast("int"))
    stages = P.stage_list(s, F.col("doc_id") % 2 == 1, F.lit(False), F.lit(True), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", stages.alias("st"))
    at = lambda i, n: F.col("st")[i]["state"].alias(n)
    return rows.select("doc_id", at(3, "vision"), at(5, "result"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stale_ingest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    work = e.filter("event_type = 'view'").select("event_id", F.lit(None).cast("timestamp_ntz").alias("beat"), "ts")
    return work.filter(S.stale(F.col("beat"), F.col("ts"), F.lit(now).cast("timestamp_ntz") - F.expr("interval 30 minutes"))).select("event_id")


@query("""WITH w AS (SELECT conv_id, turn // 2 AS i, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS j FROM conversations)
SELECT conv_id AS plan_id, 'w' || (i + 1) || 't' || (j + 1) AS task_id FROM w WHERE i < 12 AND j < 10""")
def study_plan_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    weeks = c.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("i")).agg(F.array_sort(F.collect_list("turn")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("w"))
    plans = weeks.select(F.col("conv_id").alias("plan_id"), F.transform("w", lambda x: x["t"]).alias("weeks"))
    return P.study_tasks(plans).select("plan_id", "task_id")


@query("""SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 AND n_nationkey % 10 <> 0 THEN 'a' || n_nationkey WHEN n_nationkey % 2 = 0 THEN 'w' || n_nationkey ELSE 'd' || n_nationkey END AS value,
 CASE WHEN n_nationkey % 10 = 5 THEN 'agent' WHEN n_nationkey % 2 = 0 THEN 'workspace' ELSE 'default' END AS layer FROM nation""")
def layered_settings(spark, sf_dir):
    """Nations as settings: all have a default, some a workspace's value, some an agent's, which is null for some."""
    rows, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    layer = lambda name, held, value: rows.filter(held).select(F.col("n_name").alias("key"), value.alias("value"), F.lit(name).alias("layer"))
    own = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    layers = [layer("default", F.lit(True), own("d")), layer("workspace", k % 2 == 0, own("w")), layer("agent", k % 5 == 0, F.when(k % 10 != 0, own("a")))]
    return L.merged_settings(layers, [r["n_name"] for r in rows.select("n_name").collect()])


@query("""WITH t AS (SELECT DISTINCT conv_id AS plan_id, 'w' || (turn // 2 + 1) || 't' || (turn % 2 + 1) AS task_id FROM conversations)
SELECT plan_id, count(CASE WHEN (hash_key % 3) = 0 THEN 1 END) AS done, count(*) AS total FROM (SELECT plan_id, task_id, ascii(task_id[2]) AS hash_key FROM t) GROUP BY plan_id""")
def plan_progress(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    task = F.concat(F.lit("w"), (F.floor(F.col("turn") / 2) + 1).cast("string"), F.lit("t"), (F.col("turn") % 2 + 1).cast("string"))
    tasks = turns.select(F.col("conv_id").alias("plan_id"), task.alias("task_id")).distinct()
    done = tasks.filter(F.ascii(F.substring("task_id", 2, 1)) % 3 == 0)
    return P.plan_progress(tasks, done.unionByName(done).unionByName(done.withColumn("task_id", F.lit("w0t1"))))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts)::DOUBLE AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE ts IS NOT NULL),
w AS (SELECT user_id, "at", rn, true AS allowed, ["at"] AS held FROM e WHERE rn = 1
 UNION ALL SELECT user_id, "at", rn, len(held) < 3 AS allowed, CASE WHEN len(held) < 3 THEN list_append(held, "at") ELSE held END FROM (SELECT e.user_id, e."at", e.rn, list_filter(w.held, lambda h: h >= e."at" - 86400000) AS held FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.rn = w.rn + 1))
SELECT user_id, "at", allowed FROM w""")
def rate_limit(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return J.rate_limited_batch(calls, "user_id", calls=3, period=86_400_000.0)
