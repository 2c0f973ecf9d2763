"""Text helpers as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters that count as white space and as line ends.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
_SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Letters, numbers and the underscore make words.
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

# Month names accepted in dates, full names before short ones.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Without the binding the optimizer may inline ``value`` into a lambda and
    evaluate it once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for blank or null text."""
    return let(
        F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"),
        lambda w: F.size(w)
        - F.when(F.element_at(w, 1) == "", 1).otherwise(0)
        - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0),
    )


def estimate_tokens(text: Column) -> Column:
    """About 1.3 tokens per word, truncated, never below 1."""
    words = word_count(text)
    return F.greatest(F.lit(1), (words * F.lit(1.3).cast("double")).cast("int"))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.split(whole, LINE_END)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def paragraphs(text: Column) -> Column:
    """Blocks separated by at least two newlines, stripped, blanks dropped."""
    parts = F.transform(F.split(text, r"\n{2,}"), strip)
    return F.filter(parts, lambda p: p != "")


def first_non_empty(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v != ""), 0)


def rfind(text: Column, needle: str) -> Column:
    """Zero-based position of the last occurrence, -1 where there is none."""
    from_end = F.instr(F.reverse(text), needle[::-1])
    return F.when(from_end > 0, F.length(text) - from_end - (len(needle) - 1)).otherwise(F.lit(-1))


def head(text: Column, n: int | Column) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def ellipsized(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(head(text, limit), F.lit("…"))).otherwise(text)


def word_list(text: Column) -> Column:
    """Lower-case words (runs of letters, numbers, underscores) in text order."""
    return F.filter(F.split(F.lower(text), NON_WORD_RUN), lambda w: w != "")


# --- slugs -----------------------------------------------------------------

def slugify(text: Column, style: str = "post", *, year: Column | None = None) -> Column:
    """URL-safe names. Styles: post, tag, topic, export, export_topic.

    post    keeps Unicode words, cut to 80 as the last step
    tag     ASCII only, ``&`` spelled out
    topic   ASCII only, cut to 50 at a dash, optional year at the end
    export  every other character becomes a dash; export_topic also cuts to 60
    """
    lowered = F.lower(text)
    if style == "post":
        kept = F.regexp_replace(strip(lowered), rf"[^\p{{L}}\p{{N}}_\-{_SPACES}]", "")
        dashed = F.regexp_replace(kept, rf"(?:{SPACE}|_)+", "-")
        return head(_trim_dashes(F.regexp_replace(dashed, "-+", "-")), 80)
    if style == "tag":
        return _trim_dashes(F.regexp_replace(F.replace(lowered, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"))
    if style == "topic":
        base = _trim_dashes(F.regexp_replace(lowered, "[^a-z0-9]+", "-"))
        short = let(
            base,
            lambda s: F.when(F.length(s) <= 50, s).otherwise(
                let(
                    head(s, 50),
                    lambda c: F.when(F.instr(c, "-") > 0, head(c, rfind(c, "-"))).otherwise(c),
                )
            ),
        )
        if year is None:
            return short
        return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(short, F.lit("-"), year.cast("string"))).otherwise(short)
    if style in ("export", "export_topic"):
        dashed = F.regexp_replace(strip(lowered), r"[^\p{L}\p{N}_\-]", "-")
        return head(dashed, 60) if style == "export_topic" else dashed
    raise ValueError(f"unknown slug style {style!r}")


def _trim_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"\A-+|-+\z", "")


# --- dates -----------------------------------------------------------------

_ISO = rf"(?<!{WORD_CHAR})(\d{{4}}-\d{{2}}-\d{{2}})(?!{WORD_CHAR})"
_DASH_RANGE = r"(?:\s*[-–—]\s*\d{1,2})?"
_WORDY_RANGE = r"(?:\s*[-–—]\s*\d{1,2}|\s+to\s+\d{1,2}|\s+and\s+\d{1,2})?"
_MONTH_YEAR = rf"(?i)(?<!{WORD_CHAR})({MONTHS})\.?\s+(\d{{4}})(?!{WORD_CHAR})"
_MONTH_DAY = rf"(?i)(?<!{WORD_CHAR})({MONTHS})\s+(\d{{1,2}})(?!{WORD_CHAR})"


def _month_day_year(between: str) -> str:
    return rf"(?i)({MONTHS})\.?\s+(\d{{1,2}}){between},\s*(\d{{4}})"


def _date_of(year: Column, month_name: Column, day: Column) -> Column:
    start = F.instr(F.lit(_MONTH_STARTS), F.lower(F.substring(month_name, 1, 3)))
    month = F.lpad(F.floor((start + 2) / 3).cast("string"), 2, "0")
    text = F.concat_ws("-", year, month, F.lpad(day, 2, "0"))
    return F.when(month_name != "", _iso_date(text))


def _iso_date(text: Column) -> Column:
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(date) >= 1, date)


def first_date(text: Column, *, wordy_ranges: bool) -> Column:
    """The date named by one text: ISO, else Month Day[range], Year, else Month Year.

    Each pattern offers only its first match; an impossible date falls through
    to the next pattern.
    """
    mdy = _month_day_year(_WORDY_RANGE if wordy_ranges else _DASH_RANGE)
    return F.coalesce(
        _iso_date(F.regexp_extract(text, _ISO, 1)),
        _date_of(F.regexp_extract(text, mdy, 3), F.regexp_extract(text, mdy, 1), F.regexp_extract(text, mdy, 2)),
        _date_of(F.regexp_extract(text, _MONTH_YEAR, 2), F.regexp_extract(text, _MONTH_YEAR, 1), F.lit("01")),
    )


def detect_date(texts: Column) -> Column:
    """The date of the first text in the array that names one."""
    return F.aggregate(
        texts,
        F.lit(None).cast("date"),
        lambda found, t: F.coalesce(found, first_date(t, wordy_ranges=True)),
    )


def month_day_date(text: Column, year: Column) -> Column:
    """A day without a year, completed by a year known from elsewhere."""
    return _date_of(year, F.regexp_extract(text, _MONTH_DAY, 1), F.regexp_extract(text, _MONTH_DAY, 2))


def parse_iso(text: Column) -> Column:
    return F.when(text.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(text, "yyyy-M-d"))


def quarter_name(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


# --- markdown ---------------------------------------------------------------

def strip_markdown(text: Column) -> Column:
    """Plain text: markers of headings, emphasis, images, links, code and lists go."""
    # The patterns removed and what stays of each.
    steps = [
        (r"#{1,6}\s+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"!\[[^\]]*\]\([^)]+\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"`[^`]+`", ""),
        (r"(?m)^[-*+]\s+", ""),
        (r"(?m)^\d+\.\s+", ""),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def extract_summary(body: Column, max_words: int = 60) -> Column:
    """Leading sentences until 30 words, never past ``max_words`` but for the first."""
    state = "struct<summary:string,words:int,stop:boolean>"

    def step(acc: Column, sentence: Column) -> Column:
        def advance(pair: Column) -> Column:
            text, n = pair["t"], pair["n"]
            too_long = (acc["words"] + n > max_words) & (acc["summary"] != "")
            joined = F.when(acc["summary"] == "", text).otherwise(F.concat(acc["summary"], F.lit(" "), text))
            return F.when(too_long, F.struct(acc["summary"].alias("summary"), acc["words"].alias("words"), F.lit(True).alias("stop"))).otherwise(
                F.struct(
                    joined.alias("summary"),
                    (acc["words"] + n).alias("words"),
                    (acc["words"] + n >= 30).alias("stop"),
                )
            )

        trimmed = strip(sentence)
        counted = F.struct(trimmed.alias("t"), F.greatest(F.lit(1), word_count(trimmed)).alias("n"))
        return F.when(acc["stop"], acc).otherwise(let(counted, advance))

    def summarize(plain: Column) -> Column:
        start = F.struct(F.lit("").alias("summary"), F.lit(0).alias("words"), F.lit(False).alias("stop")).cast(state)
        folded = F.aggregate(F.split(plain, r"(?<=[.!?])\s+"), start, step, lambda acc: acc["summary"])
        return F.coalesce(null_if_empty(folded), F.rtrim(head(plain, 250)))

    return let(strip_markdown(body), summarize)
