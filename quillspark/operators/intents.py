"""What a message asks for: the list of files, a file's text word for word, a translation, the next part; and the file it names.

Predicates are expressions over the message. A named file's text is read from its segments up to a cap, so only as many
segments as can matter are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import query_tokens, strings

# Phrases that mark each intent, and words that show that a message is about files.
LIST_HINTS = ["چه فایل", "چه فایلهای", "چه فایل‌هایی", "لیست فایل", "فهرست فایل", "فایلهای من", "فایل های من", "چه چیزهایی", "چی داری", "موجودی", "فهرست", "list files", "what files", "show files", "which files", "list all", "name the files"]
WEAK_LIST_HINTS = ["اسماشون", "اسماشو", "اسامیشون", "نام ببر", "نام ببرید", "کدوم فایل", "کدام فایل", "فایل چی"]
LIST_CONTEXT = ["فایل", "سند", "مدرک", "بیس", "پایگاه", "دانش", "file"]
VERBATIM_HINTS = ["عین متن", "متن کامل", "کل متن", "همه متن", "کلمه به کلمه", "متنش را کامل", "متنش رو کامل", "کلش رو بفرست", "کلش را بفرست", "بفرست", "exact text", "full text", "entire text", "verbatim", "send me the", "send it"]
TRANSLATE_HINTS = ["ترجمه", "ترجمه کن", "ترجمه‌اش", "translate", "translation"]
CONTINUE_HINTS = ["ادامه بده", "ادامه", "بقیه", "بخش بعد", "قسمت بعد", "continue", "next", "بده بقیه"]
UNCERTAIN_MARKS = ["نامشخص", "واضح نیست", "مشخص نیست", "نمی‌بینم", "نمی‌توانم", "دیده نمی‌شود", "unclear", "cannot see"]
FILE_WORDS = ["فایل", "متن", "سند", "مدرک", "file"]
CONTINUE_CHARS = 38  # a longer message is a new request
FILE_CHARS, VERBATIM_CHARS, SHORTEST_NAME_TOKEN = 30_000, 15_000, 3
CUT_MARK = "\n…(truncated)"


def has_any(x: Column, hints: Sequence[str]) -> Column:
    """A hint occurs anywhere in the lower-case text; false for null."""
    low = F.lower(X.empty(x))
    found = F.lit(False)
    for h in hints:
        found = found | F.contains(low, F.lit(h))
    return found


def wants_list(x: Column) -> Column:
    return has_any(x, LIST_HINTS) | (has_any(x, WEAK_LIST_HINTS) & has_any(x, LIST_CONTEXT))


def wants_verbatim(x: Column) -> Column:
    return has_any(x, VERBATIM_HINTS)


def wants_translation(x: Column) -> Column:
    return has_any(x, TRANSLATE_HINTS)


def wants_more(x: Column) -> Column:
    return (F.length(X.strip(X.empty(x))) <= CONTINUE_CHARS) & has_any(X.strip(x), CONTINUE_HINTS)


def sounds_uncertain(x: Column) -> Column:
    return has_any(x, UNCERTAIN_MARKS)


def name_tokens(filename: Column) -> Column:
    """Words of a file name of three characters or more, with and without its extension."""
    both = F.concat_ws(" ", X.empty(filename), F.regexp_replace(X.empty(filename), r"\.[^.]*$", ""))
    return F.array_distinct(F.filter(X.tokens(both), lambda t: F.length(t) >= SHORTEST_NAME_TOKEN))


def named_files(files: DataFrame, query: str) -> DataFrame:
    """files that share a name token with the query, with `overlap`."""
    shared = F.size(F.array_intersect(name_tokens(F.col("filename")), strings(query_tokens(query))))
    return files.withColumn("overlap", shared).filter("overlap > 0")


def capped_text(segments: DataFrame, order: Sequence[str], cap: int, text_col: str = "text") -> DataFrame:
    """(text, truncated) of one source's segments: blank ones dropped, joined by a blank line in order, cut at `cap`; no row
    if nothing is left.

    A segment adds three characters at least, so the first cap // 3 + 2 of them, each cut just past the cap, settle the result.
    """
    said = segments.select(*order, F.substring(X.strip(F.col(text_col)), 1, cap + 1).alias("__t")).filter("__t <> ''")
    first = said.orderBy(*order, "__t").limit(cap // 3 + 2)
    listed = F.array_sort(F.collect_list(F.struct(*order, "__t")))
    whole = first.agg(F.array_join(F.transform(listed, lambda s: s["__t"]), "\n\n").alias("__w")).filter("__w <> ''")
    return whole.select(X.truncated(F.col("__w"), cap, CUT_MARK).alias("text"), (F.length("__w") > cap).alias("truncated"))


def of_source(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The segments of the one source in `chosen` (a row, so it is broadcast)."""
    return segments.join(F.broadcast(chosen.select("source_id")), "source_id", "left_semi")


def named_file_text(files: DataFrame, segments: DataFrame, query: str, order: Sequence[str] = ("document_id", "page_no", "start_ms"), cap: int = FILE_CHARS) -> DataFrame:
    """(source_id, filename, text, truncated) of the file that the query names best, ties by name; no row if none is named.

    files: source_id, filename. segments: source_id, text and the order columns.
    """
    best = named_files(files, query).orderBy(F.desc("overlap"), "filename", "source_id").limit(1).select("source_id", "filename")
    return best.crossJoin(F.broadcast(capped_text(of_source(segments, best), order, cap)))  # one row by one row


def verbatim_answer(files: DataFrame, segments: DataFrame, message: str, order: Sequence[str] = ("document_id", "page_no", "start_ms"), cap: int = VERBATIM_CHARS) -> DataFrame:
    """The named file's own text as the answer, where the message asks for it; no row otherwise."""
    asked = files.sparkSession.range(1).filter(wants_verbatim(F.lit(message))).select()
    found = named_file_text(files, segments, message, order, FILE_CHARS).crossJoin(F.broadcast(asked))
    return found.select("source_id", "filename", F.substring("text", 1, cap).alias("text"), (F.col("truncated") | (F.length("text") > cap)).alias("truncated"))
