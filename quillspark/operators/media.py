"""Media: which subtitle track, video file and figures to use, how to cut long audio, which pages go to a model together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

# Languages in order of choice, limits of figure triage, the size that an unlabelled file counts with.
LANGUAGES = ("fa", "en")
SIMPLE_FORMATS = ("vtt", "srt")
CAPTION_CHARS, PAGE_CHARS, MOST_FIGURES, LEAST_PIXELS = 20, 200, 5, 120
UNKNOWN_BYTES = 10**12
PAGES_A_CALL = 5
SPEECH_BYTES = 25 * 1024 * 1024


def subtitle_track(tracks: DataFrame, key: str) -> DataFrame:
    """A row per `key`: manual subtitles before automatic ones, then the languages above (simple formats first), then the
    first of any other language. tracks: key, automatic, lang, ext, url, position."""
    language = F.lit(len(LANGUAGES))
    for i, code in reversed(list(enumerate(LANGUAGES))):
        language = F.when(F.col("lang") == code, i).otherwise(language)
    harder = ((language < len(LANGUAGES)) & ~F.coalesce(F.col("ext").isin(*SIMPLE_FORMATS), F.lit(False))).cast("int")
    chosen = F.min_by(F.struct("automatic", "lang", "ext", "url"), F.struct("automatic", language, harder, "position"))
    return tracks.filter(X.empty(F.col("url")) != "").groupBy(key).agg(chosen.alias("x")).select(key, "x.*")


def smallest_video(links: DataFrame, key: str) -> DataFrame:
    """The mp4 link of each `key` whose label names the fewest bytes, unlabelled ones last. links: key, url, label, position."""
    size = F.coalesce(X.size_bytes(F.col("label")).cast("long"), F.lit(UNKNOWN_BYTES))
    best = F.min_by("url", F.struct(size, "position"))
    return links.filter(F.contains("url", F.lit(".mp4"))).groupBy(key).agg(best.alias("url"))


def largest_figures(figures: DataFrame, key: str, most: int = MOST_FIGURES, least_px: int = LEAST_PIXELS) -> DataFrame:
    """The largest figures of each document, icons left out. figures: key, page_no, figure_no, width, height."""
    big = figures.filter((F.col("width") >= least_px) & (F.col("height") >= least_px))
    own = W.partitionBy(key).orderBy(F.desc(F.col("width").cast("long") * F.col("height")), "page_no", "figure_no")
    return big.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= most).drop("__n")


def carries_data(x: Column, least: int) -> Column:
    """Long enough and with a digit."""
    return (F.length(X.empty(x)) >= least) & X.empty(x).rlike(r"\p{Nd}")


def figure_triage(figures: DataFrame, pages: DataFrame, key: str, most: int = MOST_FIGURES) -> DataFrame:
    """figures with `decision`: caption-data and page-rich need no vision, then `most` of a document are described in order,
    the rest are over-cap. figures: key, page_no, figure_no, caption; pages: key, page_no, text."""
    rich = pages.groupBy(key, "page_no").agg(F.max(carries_data(F.col("text"), PAGE_CHARS)).alias("__rich"))
    seen = figures.join(rich, [key, "page_no"], "left")
    reason = F.when(carries_data(X.strip(F.col("caption")), CAPTION_CHARS), "caption-data").when(F.col("__rich"), "page-rich")
    own = W.partitionBy(key, F.col("__reason").isNull()).orderBy("figure_no")
    ranked = seen.withColumn("__reason", reason).withColumn("__n", F.row_number().over(own))
    return ranked.withColumn("decision", F.coalesce("__reason", F.when(F.col("__n") <= most, "describe").otherwise("over-cap"))).select(*figures.columns, "decision")


def audio_pieces(media: DataFrame, cap: int = SPEECH_BYTES) -> DataFrame:
    """media (n_bytes, duration_s) exploded into piece_no, start_s, length_s: one whole piece (no length), or as many even
    ones as keep each under the cap, two at least."""
    split = (F.col("n_bytes") > cap) & (F.col("duration_s") > 0)
    n = F.when(split, F.greatest(F.lit(2), F.ceil(F.col("n_bytes") / cap).cast("int"))).otherwise(1)
    step = F.col("duration_s") / n
    rows = media.withColumn("__step", F.when(split, step)).withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("start_s", F.coalesce(F.round(F.col("piece_no") * F.col("__step"), 2), F.lit(0.0))).withColumn("length_s", F.round("__step", 2)).drop("__step")


def shifted(segments: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """(key, start_ms, end_ms, text): the pieces' segments in the time of the whole, blank ones dropped."""
    at = (F.col("start_s") * 1000).cast("long")
    rows = segments.join(pieces.select(key, "piece_no", "start_s"), [key, "piece_no"])
    return rows.select(key, (F.col("start_ms") + at).alias("start_ms"), (F.col("end_ms") + at).alias("end_ms"), X.strip(F.col("text")).alias("text")).filter("text <> ''")


def page_batches(pages: DataFrame, key: str, size: int = PAGES_A_CALL) -> DataFrame:
    """pages with `route` and `batch_no`: runs of pages with text go to a model `size` at a time, a page without text alone
    to vision. A document's pages are the unit of the windows."""
    own = W.partitionBy(key).orderBy("page_no")
    blank = X.strip(X.empty(F.col("text"))) == ""
    runs = pages.withColumn("__blank", blank.cast("int")).withColumn("__run", F.sum("__blank").over(own.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(key, "__run", "__blank").orderBy("page_no")) - 1
    first = (F.col("__blank") == 1) | (F.col("__place") % size == 0)
    batch = F.sum(first.cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0))
    rows = runs.withColumn("__place", place).withColumn("batch_no", batch)
    return rows.withColumn("route", F.when(F.col("__blank") == 1, "vision").otherwise("text")).drop("__blank", "__run", "__place")


def transcriber(model: Column) -> Column:
    """The kind of service that a model's name stands for."""
    name = F.lower(X.empty(model))
    return F.when(name.startswith("gemini-"), "gemini").when(name.rlike("^gpt-4o.*-transcribe"), "chat-transcribe").otherwise("whisper")


def image_line(width: Column, height: Column, kind: Column, name: Column) -> Column:
    """The line that stands for a picture in a text."""
    return F.concat(F.lit("[image "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" "), kind, F.lit(" "), name, F.lit("]"))
