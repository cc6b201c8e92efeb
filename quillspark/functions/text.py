"""Text expressions: normalisation, tokens, headings, redaction, file names, clock times.

White space is the set that Unicode-aware splitting uses, written as an explicit class so that Java and RE2 patterns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and the Arabic-script letters that are unified or deleted.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FOLD_FROM = "\u064a\u0643\u0629\u200c"
FOLD_TO = "\u06cc\u06a9\u0647 "
FOLD_DELETE = "".join(map(chr, range(0x64B, 0x653))) + "\u0670\u0640"
WORD_PATTERN = f"[^{SPACE}]+"
TERM_PATTERN = r"[\p{L}\p{N}_]+"
# The same runs for Java, with frequent characters ahead of the class that decides the rest: half the time.
FAST_WORD, FAST_TERM = rf"[!-~\xC0-\x{{24F}}\x{{600}}-\x{{6FF}}[^{SPACE}]]+", r"[a-z0-9_\p{L}\p{N}]+"

# Redaction patterns in order, and the phrases that mark an injection attempt.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[card]"),
    (r"\+?\d[\d\s\-()]{7,}\d", "[phone]"),
    (r"\b\d{10}\b", "[id-number]"),
)
#: What a card, a phone number and an id of these patterns each have in them.
LONG_NUMBER = r"\d[\d\s\-()]{7,}\d"
INJECTION = r"(ignore (all )?previous instructions|disregard .*instructions|system prompt|jailbreak|pretend (you are|to be)|do anything now|DAN mode)"
# Bounds of a heading, the marks that end none, and what begins a list item.
HEADING_CHARS, HEADING_WORDS, HEADING_BAD_END = 100, 12, ".!?؟…:؛,،;"
LIST_MARK = r"^\s*(?:[-*•–—]|\d{1,3}[.)–-])\s+"
MAX_MESSAGE = 4000


def empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often it is used, inside lambdas too."""
    return F.transform(F.array(x), use)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(x: Column) -> Column:
    """The maximal runs of non-space characters; none for null."""
    return F.regexp_extract_all(empty(x), F.lit(FAST_WORD), F.lit(0))


def normalize(x: Column) -> Column:
    """Arabic-script letters unified, marks and tatweel deleted, the zero-width non-joiner made a space. Idempotent."""
    return F.translate(x, FOLD_FROM + FOLD_DELETE, FOLD_TO)


def tokens(x: Column) -> Column:
    """Normalised lower-case words of two characters or more."""
    return F.filter(words(F.lower(normalize(empty(x)))), lambda w: F.length(w) > 1)


def terms(x: Column) -> Column:
    """Full-text terms: runs of letters, digits and underscores of the normalised lower-case text."""
    return F.regexp_extract_all(F.lower(normalize(empty(x))), F.lit(FAST_TERM), F.lit(0))


def token_estimate(n_words: Column) -> Column:
    return (n_words * F.lit(1.3)).cast("int")


def content_hash(x: Column) -> Column:
    return F.sha1(normalize(empty(x)))


def sanitize_name(x: Column, fallback: Column, digit_first: bool = False) -> Column:
    """A column name: [a-z0-9_], single inner underscores, 60 characters at most; no leading digit unless digit_first."""
    name = F.regexp_replace(F.regexp_replace(F.lower(strip(empty(x))), "[^a-z0-9_]", "_"), "_+", "_")
    name = F.regexp_replace(name, "^_|_$", "")
    unfit = (name == "") if digit_first else name.rlike("^[0-9]") | (name == "")
    return F.substring(F.when(unfit, fallback).otherwise(name), 1, 60)


def value_norm(x: Column) -> Column:
    """How a cell counts in overlap tests."""
    return F.array_join(words(F.lower(x.cast("string"))), " ")


def squeezed(x: Column) -> Column:
    """Lower case without any white space, for substring tests of names."""
    return F.regexp_replace(F.lower(empty(x)), f"[{SPACE}]+", "")


def redact(x: Column) -> Column:
    """E-mail addresses, card numbers, phone numbers and ten-digit ids, replaced in this order; null gives ''. A text without an @, or
    without nine digits in a row of digits and separators, which each of the three kinds of numbers has, skips their passes."""

    def replaced(y: Column, kinds: list[tuple[str, str]]) -> Column:
        for pattern, mark in kinds:
            y = F.regexp_replace(y, pattern, mark.replace("[", r"\["))
        return y

    # a match begins where a run of its first characters does, or where the last match ended: a long run is read once
    email = [(r"(?:\G|(?<![A-Za-z0-9._%+-]))" + pattern, mark) for pattern, mark in REDACTIONS[:1]]
    out = F.when(F.contains(empty(x), F.lit("@")), replaced(empty(x), email)).otherwise(empty(x))
    return F.when(out.rlike(LONG_NUMBER), replaced(out, REDACTIONS[1:])).otherwise(out)


def injection_attempt(x: Column) -> Column:
    return empty(x).rlike("(?i)" + INJECTION)


def contains_any(x: Column, hints: list[str]) -> Column:
    low = F.lower(empty(x))
    found = F.lit(False)
    for h in hints:
        found = found | F.contains(low, F.lit(h.lower()))
    return found


def atx(line: Column) -> Column:
    """(level, title) of a Markdown heading line, else null."""
    pattern = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    at = strip(line)
    return F.when(at.rlike(pattern), F.struct(F.length(F.regexp_extract(at, pattern, 1)).alias("level"), strip(F.regexp_extract(at, pattern, 2)).alias("title")))


def looks_like_heading(line: Column) -> Column:
    """Short, one line, no final punctuation, neither a list item nor bracketed."""

    def fits(t: Column) -> Column:
        last = F.substring(t, -1, 1)
        return (
            (t != "")
            & (F.length(t) <= HEADING_CHARS)
            & ~F.contains(t, F.lit("\n"))
            & ~t.startswith("[")
            & ~t.rlike(LIST_MARK)
            & (F.instr(F.lit(HEADING_BAD_END), last) == 0)
            & (F.size(words(t)) <= HEADING_WORDS)
        )

    return bound(strip(empty(line)), fits)


def looks_like_list(block: Column) -> Column:
    """One marked line at least, and at least half of the lines that aren't blank."""
    lines = F.filter(F.split(empty(block), "\n"), lambda x: strip(x) != "")
    marked = F.size(F.filter(lines, lambda x: x.rlike(LIST_MARK)))
    # most blocks have no mark at all: one pass tells them
    return empty(block).rlike("(?md)" + LIST_MARK) & (marked >= 1) & (marked * 2 >= F.size(lines))


def clock_ms(x: Column) -> Column:
    """[HH:]MM:SS[.,mmm] in milliseconds; null where it isn't one."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(x, pattern, i).try_cast("long"), F.lit(0))
    millis = F.rpad(F.regexp_extract(x, pattern, 4), 3, "0").try_cast("long")
    return F.when(x.rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + F.coalesce(millis, F.lit(0)))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(empty(name), r"(\.[^./\\]+)$", 1))


def safe_filename(name: Column, longest: int = 120) -> Column:
    """The last path part with anything but letters, digits, dots, dashes and underscores made '_'; never empty."""
    last = F.regexp_extract(empty(name), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+", "")
    return F.when(clean == "", F.lit("file")).otherwise(F.substring(clean, -longest, longest))


def storage_key(workspace: Column, source: Column, name: Column) -> Column:
    return F.concat_ws("/", workspace.cast("string"), source.cast("string"), safe_filename(name))


def title_fallback(x: Column, n_words: int = 6, longest: int = 80) -> Column:
    return F.substring(F.array_join(F.slice(words(x), 1, n_words), " "), 1, longest)


def renamed(old: Column, new: Column) -> Column:
    """The new name, with the old one's extension (12 characters at most) where it has none."""
    ext = F.regexp_extract(old, r"(\.[^.]{1,11})$", 1)
    return F.when((ext != "") & ~F.lower(new).endswith(F.lower(ext)), F.concat(new, ext)).otherwise(new)


def truncated(x: Column, longest: int, mark: str = "…") -> Column:
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest), F.lit(mark))).otherwise(x)


def render(template: str, **values: Column) -> Column:
    """{name} replaced by values; null if a placeholder is left."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), empty(v.cast("string")))
    return F.when(out.rlike(r"\{[A-Za-z_]+\}"), F.lit(None).cast("string")).otherwise(out)


def message(x: Column) -> Column:
    """A chat message: stripped, 4000 characters at most, null if blank."""
    t = strip(empty(x))
    return F.when(t != "", F.substring(t, 1, MAX_MESSAGE))


def since(x: Column) -> Column:
    """An ISO time, or null where it can't be read."""
    return F.try_to_timestamp(x)


def size_bytes(label: Column) -> Column:
    """'N megabytes', in either language, in bytes; null otherwise."""
    return (F.regexp_extract(F.lower(empty(label)), r"(\d+(?:\.\d+)?)\s*(?:megabytes|مگابایت)", 1).try_cast("double") * 1_048_576).cast("long")


def code3(x: Column) -> Column:
    """Three letters at the start, upper case; '' where there are fewer."""
    return F.regexp_extract(F.upper(empty(x)), r"^\s*([A-Z]{3})", 1)


def interest_code(x: Column) -> Column:
    """The first three letters of RIASEC that occur."""
    return F.substring(F.regexp_replace(F.upper(empty(x)), "[^RIASEC]", ""), 1, 3)


def json_object(x: Column) -> Column:
    """The JSON object in a model's answer, as text: the whole answer, else a fenced block, else from the first { to the last }."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    is_object = lambda c: F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{")
    return F.when(is_object(x), x).when(is_object(fenced), fenced).when(is_object(braces), braces)


def json_strings(x: Column, most: int = 3, longest: int = 200) -> Column:
    """The list of strings in a model's answer: stripped, cut, distinct, `most` at most."""
    listed = F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "array<string>")
    clean = F.filter(F.transform(listed, lambda s: F.substring(strip(empty(s)), 1, longest)), lambda s: s != "")
    return F.slice(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>"))), 1, most)


def positional_score(position: Column) -> Column:
    """0.95 less 0.05 a place, for rows that come without a score."""
    return F.round(F.lit(0.95) - position * F.lit(0.05), 3)


def token_digest(x: Column) -> Column:
    return F.sha2(x, 256)
