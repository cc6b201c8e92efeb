"""Web pages, link and note descriptors, subtitles: parsed by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MOST_CHARS = 20_000
# Host names by provider, and the elements whose text isn't content.
PROVIDERS = {"youtube": ("youtube.com", "youtu.be"), "instagram": ("instagram.com",), "aparat": ("aparat.com",)}
DROPPED = ("script", "style", "nav", "footer", "header")
ENTITIES = (("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
LINE_ENDS = "[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
MOST_HTML = 2 * 1024 * 1024  # characters of a page that are read


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(X.empty(url), r"^[A-Za-z]+://([^/:?#]*)", 1))


def provider(url: Column) -> Column:
    at, out = host(url), F.lit("generic")
    for name, suffixes in PROVIDERS.items():
        for s in suffixes:
            out = F.when((at == s) | at.endswith("." + s), name).otherwise(out)
    return out


def unescaped(x: Column) -> Column:
    """Numeric references (decimal or hexadecimal) and the listed named ones as characters."""
    pieces = F.split(x, r"(?i)&#(?=[0-9]{1,7};|x[0-9a-f]{1,6};)")

    def char(p: Column) -> Column:
        digits = F.substring_index(p, ";", 1)
        point = F.when(digits.rlike("(?i)^x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("long")
        return F.concat(F.decode(F.unhex(F.lpad(F.hex(F.when(point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF), point).otherwise(0xFFFD)), 8, "0")), "UTF-32"), F.substring(p, F.length(digits) + 2, F.length(p)))

    x = F.when(F.contains(x, F.lit("&#")), F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(char(p))), "")).otherwise(x)
    for name, own in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(own))
    return x


def html_text(html: Column) -> Column:
    """The page's text, a line per run between tags, blank lines dropped; 20,000 characters at most, as the feature says.

    Elements whose text isn't content go whole, each up to its own end tag, scripts and comments first (their text may hold tags); one
    that is never closed takes the rest. A tag begins with a letter, `/`, `!` or `?`: a bare `<` is text.
    """
    x = F.substring(X.empty(html), 1, MOST_HTML)
    raw, blocks = DROPPED[:2], DROPPED[2:]
    # a pass for both kinds: each match ends at its own name's end tag
    x = F.regexp_replace(x, rf"(?is)<!--.*?-->|<({'|'.join(raw)})(?=[\s/>]).*?(?:</\1\s*>|\z)", "\n")
    x = F.regexp_replace(x, rf"(?is)<({'|'.join(blocks)})(?=[\s/>]).*?(?:</\1\s*>|\z)", "\n")
    lines = F.split(unescaped(F.regexp_replace(x, r"(?s)<[A-Za-z/!?][^>]*>", "\n")), LINE_ENDS)
    return F.substring(F.array_join(F.filter(F.transform(lines, X.strip), lambda line: line != ""), "\n"), 1, MOST_CHARS)


def html_title(html: Column) -> Column:
    return X.strip(unescaped(F.regexp_extract(X.empty(html), r"(?is)<title(?=[\s>])[^>]*>(.*?)</title", 1)))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, provider, title, text) of (page_id, url, html): the title's line, if there is a title, then the body.
    Without a title element the first line is the title."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), provider(F.col("url")).alias("provider"), html_title(F.col("html")).alias("__t"), html_text(F.col("html")).alias("__b"))
    text = F.when((F.col("__t") != "") & (F.col("__b") != ""), F.concat_ws("\n", "__t", "__b")).otherwise(F.col("__b"))
    first = F.substring(F.substring_index("__b", "\n", 1), 1, 300)
    return rows.select("page_id", "url", "host", "provider", F.when(F.col("__t") != "", F.col("__t")).otherwise(first).alias("title"), text.alias("text"))


def open_graph(html: Column, name: str) -> Column:
    return F.regexp_extract(X.empty(html), rf'(?is)<meta[^>]+property=["\']og:{name}["\'][^>]+content=["\']([^"\']*)["\']', 1)


def descriptors(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Note and link descriptors ({title, content} or {title, url, text}): title, text and provider_error. A link without
    text falls back to its title and address."""
    d = F.from_json(json_col, "title string, content string, url string, text string, transcript string")
    x = rows.withColumn("__d", d)
    link = F.col("__d.url").isNotNull()
    body = F.coalesce("__d.content", "__d.text", "__d.transcript")
    has = X.strip(X.empty(body)) != ""
    text = F.when(has, body).when(link, F.concat_ws("\n", F.col("__d.title"), F.col("__d.url"))).otherwise("")
    return x.select(*rows.columns, F.coalesce("__d.title", F.lit("")).alias("title"), text.alias("text"), F.when(link, provider(F.col("__d.url"))).alias("provider"), (link & ~has).alias("provider_error"))


def cues(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, cue_no, start_ms, end_ms, text) of WebVTT, SRT or TTML files: tags stripped, what isn't a cue skipped. A file with timed `p`
    elements is TTML; their attributes stand in any order, and a line break is a space."""
    time = r"(?:[0-9]+:)?[0-9]{1,2}:[0-9]{1,2}[.,][0-9]{1,3}"
    said = X.empty(F.col(text_col))
    timed = F.regexp_extract_all(said, F.lit(r"(?is)<p\s[^>]*\bbegin\s*=[^>]*>.*?</p\s*>"), F.lit(0))
    value = lambda p, name: F.regexp_extract(p, rf"""(?is)^<p\s(?:[^>]*\s)?{name}\s*=\s*["']([^"']*)["']""", 1)
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?is)^<p\s[^>]*>|</p\s*>$", ""), r"(?i)<br\s*/?>", "\n")
    as_blocks = F.transform(timed, lambda p: F.concat(value(p, "begin"), F.lit(" --> "), value(p, "end"), F.lit("\n"), unescaped(body(p))))
    blocks = F.when(F.size(timed) > 0, as_blocks).otherwise(F.split(F.regexp_replace(said, "\r\n?", "\n"), "\n[ \t]*\n"))
    b = rows.select(key, F.posexplode(blocks).alias("cue_no", "b"))
    pattern = rf"(?s)({time})\s*-->\s*({time})[^\n]*\n(.*)"
    text = X.strip(F.regexp_replace(F.regexp_replace(F.regexp_extract("b", pattern, 3), r"<[^>]*>", ""), r"\s*\n\s*", " "))
    out = b.filter(F.col("b").rlike(pattern)).select(key, "cue_no", X.clock_ms(F.regexp_extract("b", pattern, 1)).alias("start_ms"), X.clock_ms(F.regexp_extract("b", pattern, 2)).alias("end_ms"), text.alias("text"))
    return out.filter("text <> ''")


def marked_pages(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, page_no, text) of answers split at [PAGE n] marks, a code fence stripped; the first of repeated pages counts."""
    clean = F.regexp_replace(F.regexp_replace(X.strip(X.empty(F.col(text_col))), r"^```[a-z]*\n", ""), r"\n?```$", "")
    numbers = F.regexp_extract_all(clean, F.lit(r"\[PAGE ([0-9]+)\]"), F.lit(1))
    bodies = F.slice(F.split(clean, r"\[PAGE [0-9]+\]"), 2, F.greatest(F.size(numbers), F.lit(1)))
    x = rows.select(key, F.posexplode(F.arrays_zip(numbers.alias("n"), bodies.alias("t"))).alias("i", "p"))
    return x.groupBy(key, F.col("p.n").cast("int").alias("page_no")).agg(X.strip(F.min_by("p.t", "i")).alias("text"))
