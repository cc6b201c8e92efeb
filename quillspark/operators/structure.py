"""From texts to chunks: word windows, transcript windows and chapters, sections, paragraph packing, table parts.

What looks at one row is an expression over arrays and needs no shuffle. What looks at a sequence (segments, elements)
windows over its document, so one document's rows, not one source's, meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions.text import bound

WINDOW, OVERLAP = 400, 60
TRANSCRIPT_MS = 45_000
GAP_MS, LEAST_CHAPTER_MS = 90_000, 120_000
PACK_CHARS = 1500
TABLE_WORDS, PART_WORDS = 600, 400


def word_windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of (chunk_no, text, n_words): windows of `size` words, each `overlap` words into the one before."""
    step = size - overlap
    found = F.transform(F.array(X.words(text)), lambda w: F.struct(w.alias("w"), (F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")).alias("last")))[0]
    starts = F.when(F.size(found["w"]) > 0, F.sequence(F.lit(0), found["last"])).otherwise(F.array().cast("array<int>"))

    def one(k: Column) -> Column:
        piece = F.slice(found["w"], k * step + 1, size)
        return F.struct(k.alias("chunk_no"), F.array_join(piece, " ").alias("text"), F.size(piece).alias("n_words"))

    return F.transform(starts, one)


def chunk_words(df: DataFrame, text_col: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """A row per window; blank texts give none. Other columns stay."""
    # blank texts go by a test that ends at the first word: a filter on the words themselves would be pushed down and split twice
    words = df.filter(F.col(text_col).rlike(X.WORD_PATTERN)).withColumn("__w", X.words(F.col(text_col))).drop(text_col)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("__w") - size) / step)).cast("int")
    rows = words.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    piece = F.slice("__w", F.col("chunk_no") * step + 1, size)
    rows = rows.withColumn("__p", piece).drop("__w")
    return rows.select(*[c for c in df.columns if c != text_col], "chunk_no", F.array_join("__p", " ").alias("content"), F.size("__p").alias("n_words"), X.token_estimate(F.size("__p")).alias("tokens"))


def transcript_windows(segments: DataFrame, key: str, window_ms: int = TRANSCRIPT_MS) -> DataFrame:
    """(key, window_no, start_ms, end_ms, content): segments joined until a window lasts `window_ms`, in one fold.

    segments: (key, start_ms, end_ms, text); blank ones are skipped. A transcript is the unit of a fold.
    """
    said = segments.filter(X.strip(X.empty(F.col("text"))) != "")
    item = F.struct(F.coalesce("start_ms", F.lit(0)).cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"), X.strip(F.col("text")).alias("t"))
    rows = said.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("segs"))
    kind = "array<struct<start_ms:bigint,end_ms:bigint,content:array<string>>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"), F.array().cast("array<string>").alias("buf"))

    def window(acc: Column) -> Column:
        return F.struct(acc["s"].alias("start_ms"), acc["e"].alias("end_ms"), acc["buf"].alias("content"))

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(acc["s"], x["s"])
        end = F.when(F.coalesce(x["e"], F.lit(0)) == 0, start).otherwise(x["e"])
        grown = F.struct(acc["done"].alias("done"), start.alias("s"), end.alias("e"), F.array_append(acc["buf"], x["t"]).alias("buf"))
        closed = F.struct(F.array_append(acc["done"], window(grown)).alias("done"), zero["s"].alias("s"), zero["e"].alias("e"), zero["buf"].alias("buf"))
        return F.when(end - start >= window_ms, closed).otherwise(grown)

    done = F.aggregate("segs", zero, step, lambda acc: F.when(F.size(acc["buf"]) > 0, F.array_append(acc["done"], window(acc))).otherwise(acc["done"]))
    out = rows.select(key, F.posexplode(done).alias("window_no", "w"))
    return out.select(key, "window_no", "w.start_ms", "w.end_ms", F.array_join("w.content", " ").alias("content"))


def chapterize(segments: DataFrame, key: str, gap_ms: int = GAP_MS, least_ms: int = LEAST_CHAPTER_MS, title_words: int = 8) -> DataFrame:
    """(key, chapter_no, start_ms, end_ms, title): a chapter ends at a silence of gap_ms; short middle ones join the one before.

    Segments without a duration are left out where others have one; where none has, they make one chapter 0..0.
    """
    said = segments.select(key, F.coalesce("start_ms", F.lit(0)).cast("long").alias("s"), F.coalesce("end_ms", F.lit(0)).cast("long").alias("e"), X.strip(X.empty(F.col("text"))).alias("t")).filter("t <> ''")
    own = W.partitionBy(key).orderBy("s", "e", "t")
    marked = said.withColumn("timed", F.max(F.col("e") > F.col("s")).over(W.partitionBy(key)))
    first = marked.filter("not timed").withColumn("rn", F.row_number().over(own)).filter("rn = 1")
    untimed = first.select(key, F.lit(0).alias("chapter_no"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"), F.array_join(F.slice(X.words(F.col("t")), 1, title_words), " ").alias("title"))
    timed = marked.filter("timed and e > s")
    end_before = F.max("e").over(own.rowsBetween(W.unboundedPreceding, -1))
    cut = (F.col("s") - end_before >= max(1000, gap_ms)).cast("int")
    # the running end restarts with each chapter in the definition; as a cut needs a start beyond it, the overall one agrees
    raw = timed.withColumn("raw_no", F.sum(F.coalesce(cut, F.lit(0))).over(own))
    lead_words = F.slice(X.words(F.col("t")), 1, title_words)
    parts = raw.groupBy(key, "raw_no").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("s", "e", "t", lead_words.alias("w")))).alias("segs"))
    by_raw = W.partitionBy(key).orderBy("raw_no")
    short = (F.col("raw_no") > 0) & (F.col("raw_no") < F.max("raw_no").over(W.partitionBy(key))) & (F.col("e") - F.col("s") < max(0, least_ms))
    kept = parts.withColumn("chapter_no", F.sum((~short).cast("int")).over(by_raw) - 1)
    merged = kept.groupBy(key, "chapter_no").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.array_sort(F.collect_list(F.struct("raw_no", "segs"))).alias("parts"))
    words = F.flatten(F.transform("parts", lambda p: F.flatten(p["segs"]["w"])))
    return merged.select(key, F.col("chapter_no").cast("int").alias("chapter_no"), "start_ms", "end_ms", F.array_join(F.slice(words, 1, title_words), " ").alias("title")).unionByName(untimed)


def with_chapter(windows: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Each window's last chapter that starts at or before it (an as-of join): both sides meet in one sort per document."""
    a = windows.withColumn("__side", F.lit(1)).withColumn("__at", F.col("start_ms"))
    b = chapters.select(key, F.col("start_ms").alias("__at"), F.struct(F.col("start_ms").alias("chapter_start_ms"), F.col("title").alias("section")).alias("__ch"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__ch", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*windows.columns, "__last.chapter_start_ms", "__last.section")


def block_list(text: Column) -> Column:
    """Array of (kind, block): the text split at blank lines, a heading line apart from the rest of its block."""
    pieces = F.filter(F.transform(F.split(X.empty(text), "\n\n"), lambda b: X.strip(b)), lambda b: b != "")
    typed = "struct<kind:string,block:string>"

    def entry(kind: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), block.alias("block"))

    def plain(b: Column) -> Column:
        one_line = ~F.contains(b, F.lit("\n"))
        return F.when(X.looks_like_list(b), entry("list", b)).when(one_line & X.looks_like_heading(b), entry("heading", b)).otherwise(entry("paragraph", b))

    def split(b: Column) -> Column:
        head = F.when(b.startswith("#"), X.atx(F.substring_index(b, "\n", 1)))
        rest = F.when(F.contains(b, F.lit("\n")), X.strip(F.substring(b, F.instr(b, "\n") + 1, F.length(b)))).otherwise(F.lit(""))
        both = F.when(rest != "", F.array(entry("heading", head["title"]), plain(rest))).otherwise(F.array(entry("heading", head["title"])))
        return F.when(head.isNotNull(), both).otherwise(F.array(plain(b)))

    return F.filter(F.flatten(F.transform(pieces, split)).cast(f"array<{typed}>"), lambda x: x["block"] != "")


def blocks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per block (split at blank lines) with kind heading, list or paragraph; a heading line takes the rest of its
    block as a block of its own. Adds (block_no, kind, block); other columns stay."""
    rows = df.select(*[c for c in df.columns if c != text_col], F.posexplode(block_list(F.col(text_col))).alias("block_no", "x"))
    return rows.select(*[c for c in df.columns if c != text_col], "block_no", "x.kind", "x.block")


def chained_blocks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """What section_chain adds to blocks, each text in its own row: no block is shuffled to meet its heading."""

    def chain(found: Column, heads: Column) -> Column:
        """The blocks after each heading up to the next one, itself included; heads: places of headings from 1, after a 0."""

        def after(h: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1), F.size(found))
            head, at = F.get(found, h - 1), F.when(h > 0, F.concat(F.lit("e"), h.cast("string"))).otherwise("")

            def one(x: Column, j: Column) -> Column:
                n = h + j + 1
                element = F.concat(F.lit("e"), n.cast("string"))
                return F.struct((n - 1).alias("block_no"), x["kind"].alias("kind"), x["block"].alias("block"), n.alias("document_order"), element.alias("element_id"), F.coalesce(head["block"], F.lit("")).alias("section"), at.alias("parent_id"))

            return F.transform(F.slice(found, h + 1, end - h), one)

        return F.flatten(F.transform(heads, after))

    places = lambda found: F.filter(F.transform(found, lambda x, i: F.when(x["kind"] == "heading", i + 1)), lambda i: i.isNotNull())
    chained = bound(block_list(F.col(text_col)), lambda found: bound(F.concat(F.array(F.lit(0)), places(found)), lambda heads: chain(found, heads)))
    return df.select(*[c for c in df.columns if c != text_col], F.inline(chained))


def section_chain(elements: DataFrame, key: str, order: str = "block_no") -> DataFrame:
    """Adds element_id, document_order, section and parent_id: the last heading before each element ('' at first)."""
    own = W.partitionBy(key).orderBy(order)
    heading = F.when(F.col("kind") == "heading", F.struct(F.col("block").alias("t"), F.col("document_order").alias("n")))
    before = own.rowsBetween(W.unboundedPreceding, -1)
    out = elements.withColumn("document_order", F.row_number().over(own)).withColumn("__h", F.last(heading, ignorenulls=True).over(before))
    return out.select(
        *elements.columns,
        "document_order",
        F.concat(F.lit("e"), F.col("document_order").cast("string")).alias("element_id"),
        F.coalesce("__h.t", F.lit("")).alias("section"),
        F.coalesce(F.concat(F.lit("e"), F.col("__h.n").cast("string")), F.lit("")).alias("parent_id"),
    )


def packed(paragraphs: Column, longest: int = PACK_CHARS, hard: int | None = None) -> Column:
    """Array of pages: paragraphs joined by blank lines while a page stays within `longest` characters. A paragraph over
    twice `hard` is first cut into pieces of `hard` characters, the last of them up to twice as long."""
    items = F.filter(F.transform(paragraphs, X.strip), lambda p: p != "")
    if hard:
        cuts = lambda p: F.ceil((F.length(p) - 2 * hard) / hard).cast("int")
        cut = lambda p: F.transform(F.sequence(F.lit(0), cuts(p)), lambda k: F.substring(p, k * hard + 1, F.when(k < cuts(p), hard).otherwise(2 * hard)))
        items = F.flatten(F.transform(items, lambda p: F.when(F.length(p) > 2 * hard, cut(p)).otherwise(F.array(p))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        grown = acc["n"] + F.length(p) + F.when(acc["n"] > 0, 2).otherwise(0)
        fits = (acc["n"] == 0) | (grown <= longest)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.array_append(acc["buf"], p).alias("buf"), grown.alias("n"))).otherwise(
            F.struct(F.array_append(acc["done"], F.array_join(acc["buf"], "\n\n")).alias("done"), F.array(p).alias("buf"), F.length(p).alias("n"))
        )

    return F.aggregate(items, zero, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], F.array_join(acc["buf"], "\n\n"))).otherwise(acc["done"]))


def table_runs(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, run_no, first_line, n_lines, is_table, block): lines grouped into pipe-line runs and the text between them.

    A run of pipe lines is a table with three lines, or with a separator as its second. A text is cut in its own row, without a shuffle.
    """

    def runs(lines: Column, pipe: Column, starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(lines)) - at
            separator = F.coalesce(F.get(lines, at + 1).rlike(r"^\s*\|[\s:|-]*-[\s:|-]*$"), F.lit(False))
            is_table = F.get(pipe, at) & ((n >= 3) | ((n >= 2) & separator))
            return F.struct(k.alias("run_no"), at.alias("first_line"), n.cast("long").alias("n_lines"), is_table.alias("is_table"), F.array_join(F.slice(lines, at + 1, n), "\n").alias("block"))

        return F.transform(starts, one)

    def cuts(pipe: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(pipe) - 1), lambda i: (i == 0) | (F.get(pipe, i) != F.get(pipe, i - 1)))

    flags = lambda lines: F.transform(lines, lambda x: x.rlike(rf"^[{X.SPACE}]*\|"))
    found = bound(F.split(X.empty(F.col(text_col)), "\n"), lambda lines: bound(flags(lines), lambda pipe: bound(cuts(pipe), lambda starts: runs(lines, pipe, starts))))
    return df.select(key, F.inline(found))


def table_shape(block: Column) -> Column:
    """(rows without the separator, most cells in a row) of a pipe table."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(rf"^[{X.SPACE}]*\|") & ~x.rlike(r"^\s*\|[\s:|-]*-[\s:|-]*$"))
    cells = lambda found: F.transform(found, lambda x: F.size(F.split(F.regexp_replace(X.strip(x), r"^\||\|$", ""), r"\|")))
    return bound(lines, lambda found: F.struct(F.size(found).alias("n_rows"), F.coalesce(F.array_max(cells(found)), F.lit(0)).alias("n_cols")))


def table_parts(block: Column, most: int = TABLE_WORDS, least: int = PART_WORDS, header_lines: int = 2) -> Column:
    """Array of table texts: a table over `most` words is cut into row groups of at least `least` words, each under the
    header. header_lines=3 repeats the first body row as well, for compatibility."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(X.WORD_PATTERN))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        buf = F.array_append(acc["buf"], x)

        def grown(n: Column) -> Column:
            full = F.struct(F.array_append(acc["done"], buf).alias("done"), zero["buf"].alias("buf"), F.lit(0).alias("n"))
            return F.when(n >= least, full).otherwise(F.struct(acc["done"].alias("done"), buf.alias("buf"), n.alias("n")))

        return bound(acc["n"] + F.size(X.words(x)), grown)

    def cut(found: Column) -> Column:
        head, body = F.slice(found, 1, header_lines), F.slice(found, header_lines + 1, F.greatest(F.size(found), F.lit(1)))
        groups = F.aggregate(body, zero, step, lambda acc: F.when(F.size(acc["buf"]) > 0, F.array_append(acc["done"], acc["buf"])).otherwise(acc["done"]))
        return F.transform(groups, lambda g: F.array_join(F.concat(head, g), "\n"))

    return F.when(F.size(X.words(block)) <= most, F.array(block)).otherwise(bound(lines, cut))


def transcript_text(segments: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, full_text, duration_ms): segments in order, blank ones dropped, a blank line between them."""
    rows = segments.filter(X.strip(X.empty(F.col("text"))) != "")
    listed = F.array_sort(F.collect_list(F.struct(*order, X.strip(F.col("text")).alias("t"))))
    out = rows.groupBy(key).agg(listed.alias("l"), F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration_ms"))
    return out.select(key, F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("full_text"), "duration_ms")
