"""Memory facts, conversations, interest profiles and job matches, study plans, leads and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from .retrieval import strings

# How much a category counts in recall; the six interest types.
CATEGORY_BOOST = {"goal": 2.0, "preference": 1.5, "plan": 1.5}
INTERESTS = "RIASEC"
LEAST_ANSWERS = 12
LEAD_COLUMNS = ("name", "address", "phone", "hours", "website", "lat", "lng", "query", "source", "status", "created_at")


def latest(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Upsert semantics: of the rows of a key the newest one. An aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("x"))
    return best.select(*keys, *[F.col("x").getField(c).alias(c) for c in rest])


def memory_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(X.words(F.lower(X.empty(x))), lambda w: F.length(w) > 1))


def recall(facts: DataFrame, query: str, top_k: int = 8) -> DataFrame:
    """A user's facts (key, value, category, updated_at) that share words with the query, by shared words times the
    category's boost, newest first among equals."""
    wanted = sorted({w for w in query.lower().split() if len(w) > 1})
    shared = F.size(F.array_intersect(memory_tokens(F.concat_ws(" ", X.empty(F.col("key")), X.empty(F.col("value")))), strings(wanted)))
    boost = F.lit(1.0)
    for category, by in CATEGORY_BOOST.items():
        boost = F.when(F.col("category") == category, by).otherwise(boost)
    scored = facts.withColumn("score", shared * boost).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("updated_at"), "key").limit(max(1, min(top_k, 50)))


def history(messages: DataFrame, key: str, order: str, turns: int = 12) -> DataFrame:
    """The last 2 * turns messages of each conversation, in order, with their place."""
    newest = messages.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__n") <= 2 * turns)
    return newest.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("int")).drop("__n")


def quiz_scores(answers: DataFrame, key: str) -> DataFrame:
    """(key, answered, code, scores): Likert answers 1 to 5 summed by interest; the code is the best three, ties by letter.
    People with fewer than 12 valid answers are left out. answers: key, interest, answer."""
    valid = answers.withColumn("v", F.col("answer").try_cast("int")).filter("v between 1 and 5").filter(F.col("interest").isin(*INTERESTS))
    sums = [F.coalesce(F.sum(F.when(F.col("interest") == t, F.col("v"))), F.lit(0)).cast("int").alias(t) for t in INTERESTS]
    rows = valid.groupBy(key).agg(F.count("*").alias("answered"), *sums).filter(F.col("answered") >= LEAST_ANSWERS)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("s"), F.lit(t).alias("t")) for t in sorted(INTERESTS)]))
    code = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["t"]), "")
    return rows.select(key, "answered", code.alias("code"), *INTERESTS)


def match_jobs(jobs: DataFrame, code: str, limit: int = 20) -> DataFrame:
    """Jobs (title, job_group, interests) whose three-letter code shares letters with a person's code, by how many, then
    title; the first of equal (title, group). Adds the total before the limit."""
    letters = [c for c in dict.fromkeys(code.upper()) if c in INTERESTS][:3]
    theirs = X.code3(F.col("interests"))
    shared = sum((F.contains(theirs, F.lit(c)).cast("int") for c in letters), F.lit(0))
    found = jobs.withColumn("code", theirs).withColumn("matched", shared).filter((F.col("code") != "") & (F.col("matched") > 0))
    once = found.groupBy("title", "job_group").agg(F.min_by(F.struct("code", "matched"), "job_id").alias("x")).select("title", "job_group", "x.*")
    best = once.orderBy(F.desc("matched"), "title", "job_group").limit(max(1, limit))
    return best.crossJoin(F.broadcast(once.agg(F.count("*").alias("total"))))


def study_tasks(plans: DataFrame, weeks: str = "weeks", most_weeks: int = 12, most_tasks: int = 10) -> DataFrame:
    """(plan_id, task_id, week_no, task) with ids w{i}t{j} from an array of arrays of tasks."""
    w = plans.select("plan_id", F.posexplode(F.slice(weeks, 1, most_weeks)).alias("i", "tasks"))
    t = w.select("plan_id", "i", F.posexplode(F.slice("tasks", 1, most_tasks)).alias("j", "task"))
    return t.select("plan_id", F.concat(F.lit("w"), (F.col("i") + 1).cast("string"), F.lit("t"), (F.col("j") + 1).cast("string")).alias("task_id"), (F.col("i") + 1).alias("week_no"), "task")


def plan_progress(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """(plan_id, done, total): distinct done task ids that the plan has; unknown ids don't count."""
    marks = done.select("plan_id", "task_id").distinct().withColumn("__d", F.lit(1))
    return tasks.join(marks, ["plan_id", "task_id"], "left").groupBy("plan_id").agg(F.count("__d").alias("done"), F.count("*").alias("total"))


def latest_plan(conversations: DataFrame, key: str = "user_id") -> DataFrame:
    """Each person's newest conversation (conversation_id, created_at, plan array) that holds a plan. An aggregate with
    map-side combine."""
    planned = conversations.filter(F.size("plan") > 0)
    best = planned.groupBy(key).agg(F.max_by(F.struct("conversation_id", "created_at", "plan"), F.struct("created_at", "conversation_id")).alias("x"))
    return best.select(key, "x.*")


def unknown_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return done.join(tasks.select("plan_id", "task_id"), ["plan_id", "task_id"], "left_anti")


def lead_key() -> list[Column]:
    return [X.strip(X.empty(F.col("name"))).alias("__name"), X.strip(X.empty(F.col("address"))).alias("__address")]


def new_leads(batch: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Rows of a workspace's batch with a name that isn't stored yet: the first of each (name, address)."""
    keyed = batch.select("*", *lead_key()).filter("__name <> ''")
    known = stored.select("workspace_id", *lead_key())
    fresh = keyed.join(known, ["workspace_id", "__name", "__address"], "left_anti")
    rest = [c for c in batch.columns if c != "workspace_id"]
    first = fresh.groupBy("workspace_id", "__name", "__address").agg(F.min_by(F.struct(*rest), order).alias("x"))
    return first.select("workspace_id", *[F.col("x").getField(c).alias(c) for c in rest])


def list_leads(leads: DataFrame, workspace: str, status: str | None = None, limit: int = 100) -> DataFrame:
    df = leads.filter(F.col("workspace_id") == workspace)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.desc("created_at"), "name").limit(max(1, min(limit, 1000)))


def set_status(leads: DataFrame, workspace: str, ids: Sequence[str], status: str) -> DataFrame:
    """All leads, with the status of the workspace's listed ones changed."""
    hit = (F.col("workspace_id") == workspace) & F.col("lead_id").cast("string").isin(*map(str, ids))
    return leads.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


PLACE_COLUMNS = ("name", "address", "phone", "hours", "opening_hours", "website", "lat", "lng", "lon", "maps_uri", "rating")


def _listed(rows: DataFrame, order: str | None, most: int | None) -> DataFrame:
    """The first `most` rows by a column; all of them without one."""
    return rows if most is None or order is None else rows.orderBy(order).limit(max(1, most))


def clean_places(rows: DataFrame, order: str | None = None, most: int | None = 30) -> DataFrame:
    """Untrusted place rows (strings), the first `most` of them: a name is required, texts are cut, then stripped, numbers must
    be numbers, links http. What the known columns don't hold stays as it is, and also comes, cut, in the map `raw`."""
    there = lambda *names: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names if c in rows.columns], F.lit(""))
    cut = lambda n, *names: X.strip(F.substring(there(*names), 1, n)).alias(names[0])
    number = lambda *names: X.strip(there(*names)).try_cast("double").alias(names[0])
    link = lambda c: F.when(cut(1000, c).rlike("(?i)^https?://"), cut(1000, c)).otherwise("").alias(c)
    own = [c for c in rows.columns if c not in PLACE_COLUMNS]
    known = F.array(*[F.struct(F.lit(c[:80]).alias("key"), F.substring(F.col(c).cast("string"), 1, 500).alias("value")) for c in own])
    raw = F.map_from_entries(F.filter(known, lambda x: x["value"].isNotNull())) if own else F.lit(None).cast("map<string,string>")
    cleaned = _listed(rows, order, most).select(
        *own, cut(300, "name"), cut(1000, "address"), cut(100, "phone"), cut(300, "hours", "opening_hours"), link("website"),
        number("lat"), number("lng", "lon"), link("maps_uri"), number("rating"), raw.alias("raw"),
    )
    return cleaned.filter("name <> ''")


def clean_web(rows: DataFrame, order: str | None = None, most: int | None = 10) -> DataFrame:
    """Untrusted web rows, the first `most` of them: texts are cut, then stripped; one of title, address and snippet is required,
    then addresses that aren't http are blanked, and an address stands in for an empty title."""
    there = lambda *names: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names if c in rows.columns], F.lit(""))
    cut = lambda n, *names: X.strip(F.substring(there(*names), 1, n)).alias(names[0])
    kept = _listed(rows, order, most).select(*[c for c in rows.columns if c not in ("title", "uri", "url", "snippet", "content")], cut(300, "title"), cut(1000, "uri", "url"), cut(2000, "snippet", "content"))
    kept = kept.filter("title <> '' or uri <> '' or snippet <> ''").withColumn("uri", F.when(F.col("uri").rlike("(?i)^https?://"), F.col("uri")).otherwise(""))
    return kept.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("uri")))


def file_inventory(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Files of both scopes, each source once (the workspace's row wins), by name."""
    both = own.withColumn("scope", F.lit("workspace")).unionByName(shared.withColumn("scope", F.lit("global")), allowMissingColumns=True)
    rest = [c for c in both.columns if c != "source_id"]
    once = both.groupBy("source_id").agg(F.max_by(F.struct(*rest), "scope").alias("x"))
    return once.select("source_id", *[F.col("x").getField(c).alias(c) for c in rest]).orderBy("filename", "source_id")


def file_options(files: DataFrame, query: str, most: int = 4) -> DataFrame:
    """(filename, overlap): names to choose from where the two best matches of a query tie; unique, `most` at most."""
    wanted = sorted({t for t in query.lower().split() if len(t) > 1})
    named = F.array_distinct(X.tokens(F.regexp_replace(F.col("filename"), "[._-]+", " ")))
    scored = files.withColumn("overlap", F.size(F.array_intersect(named, strings(wanted)))).filter("overlap > 0").groupBy("filename").agg(F.max("overlap").alias("overlap"), F.count("*").alias("files"))
    ranked = scored.orderBy(F.desc("overlap"), "filename").limit(max(2, most))
    whole = W.partitionBy()  # over `most` names alone
    tied = ranked.withColumn("__best", F.max("overlap").over(whole))
    return tied.withColumn("__ties", F.sum((F.col("overlap") == F.col("__best")).cast("int")).over(whole)).filter("__ties >= 2").select("filename", "overlap")


def stage_list(status: Column, has_text: Column, ocr: Column, vision: Column, chunks: Column) -> Column:
    """The ingest stages of a source with their states."""
    state = lambda done, active: F.when(status == "failed", "failed").when(done, "done").when(active, "active").otherwise("waiting")
    ready, working = status == "ready", status == "processing"
    stages = [
        ("upload", F.lit("done")),
        ("parsing", state(ready | has_text, working & ~has_text)),
        ("ocr", F.when(~ocr, "skipped").otherwise(state(ready | has_text, working & ~has_text))),
        ("vision", F.when(~vision, "skipped").otherwise(state(ready, working & has_text))),
        ("chunking", state(ready | (chunks > 0), working & has_text)),
        ("result", state(ready, F.lit(False))),
    ]
    return F.array(*[F.struct(F.lit(n).alias("stage"), s.alias("state")) for n, s in stages])
