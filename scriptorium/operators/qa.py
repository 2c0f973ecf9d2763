"""Draft checks and review tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.rules import inline_strings
from scriptorium.functions.text import let, strip, word_count

_DRAFT_TYPE = "headline string, summary string, body string, suggested_slug string, seo_summary string, hashtags array<string>"
_EMPTY = "array<string>"


@dataclass(frozen=True)
class StyleRules:
    """Word bounds, phrases and the number of sources a draft must meet."""

    # Default bounds in words, and sources.
    headline_words: tuple[int, int] = (5, 14)
    summary_words: tuple[int, int] = (18, 45)
    min_sources: int = 1
    banned: tuple[str, ...] = ()
    discouraged: tuple[str, ...] = ()


def parse_draft(raw: Column) -> Column:
    """A draft from a fenced JSON block, else the outermost braces, else the text as its body."""
    def usable(text: Column) -> Column:
        parsed = F.from_json(F.when(text != "", text), _DRAFT_TYPE)
        well_formed = F.get_json_object(text, "$").isNotNull() & text.startswith("{")
        return F.when(well_formed, parsed)

    fenced = F.regexp_extract(raw, r"(?i)```json\s*([\s\S]*?)\s*```", 1)
    braces = F.regexp_extract(raw, r"\{[\s\S]*\}", 0)
    default = F.struct(
        F.lit("").alias("headline"),
        F.lit("").alias("summary"),
        strip(raw).alias("body"),
        F.lit("").alias("suggested_slug"),
        F.lit("").alias("seo_summary"),
        F.array().cast(_EMPTY).alias("hashtags"),
    )
    found = F.coalesce(usable(fenced), usable(braces), default)
    return let(found, lambda d: d.withField("hashtags", F.coalesce(d["hashtags"], F.array().cast(_EMPTY))))


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _bounds(label: str, words: Column, low: int, high: int) -> list[Column]:
    return [
        F.when(words < low, F.format_string(f"QA [{label}]: too short (%d words, min {low}).", words)),
        F.when(words > high, F.format_string(f"QA [{label}]: too long (%d words, max {high}).", words)),
    ]


def _phrases(phrases: tuple[str, ...], text: Column, message: str) -> Column:
    """One message per phrase the text contains, in the order of the phrases."""
    return let(
        F.lower(text),
        lambda lowered: F.transform(
            F.filter(inline_strings(list(phrases)), lambda p: lowered.contains(F.lower(p))),
            lambda p: F.concat(F.lit(f'{message} — "'), p, F.lit('".')),
        ),
    )


# Fixed value: the message about drafts without sources.
_UNGROUNDED = "QA [grounding]: body text present but no sources retrieved — claims cannot be verified."


def _sources(minimum: int) -> Column:
    return F.when(
        F.col("n_sources") < minimum, F.format_string(f"QA [sources]: fewer than {minimum} source(s) (got %d).", "n_sources")
    )


def style_qa(drafts: DataFrame, rules: StyleRules) -> DataFrame:
    """Add ``style_warnings`` to ``drafts(headline, summary, body, n_sources)``."""
    headline, summary, body = _text("headline"), _text("summary"), _text("body")
    none = F.array().cast(_EMPTY)

    def listed(*messages: Column) -> Column:
        return F.array_compact(F.array(*messages))

    no_dot = [F.regexp_replace(t, r"\.+\z", "") for t in (summary, headline)]
    about_headline = F.when(headline == "", F.array(F.lit("QA [headline]: missing."))).otherwise(
        F.concat(
            listed(
                *_bounds("headline", word_count(headline), *rules.headline_words),
                F.when(headline.endswith("?"), "QA [headline]: is a question — avoid question headlines."),
            ),
            _phrases(rules.banned, headline, "QA [headline]: banned phrase") if rules.banned else none,
        )
    )
    about_summary = F.when(summary == "", F.array(F.lit("QA [summary]: missing."))).otherwise(
        listed(
            *_bounds("summary", word_count(summary), *rules.summary_words),
            F.when((headline != "") & (no_dot[0] == no_dot[1]), "QA [summary]: identical to headline."),
        )
    )
    whole = F.concat_ws(" ", headline, summary, body)
    about_style = [
        _phrases(phrases, whole, message)
        for phrases, message in (
            (rules.banned, "QA [style]: banned phrase in draft"),
            (rules.discouraged, "QA [style]: discouraged phrase in draft"),
        )
        if phrases
    ]
    about_sources = listed(_sources(rules.min_sources), F.when((body != "") & (F.col("n_sources") == 0), _UNGROUNDED))
    return drafts.withColumn("style_warnings", F.concat(about_headline, about_summary, *about_style, about_sources))


def has_duplicate_sentence(body: Column) -> Column:
    """Two sentences of more than 25 characters that are equal but for case and spacing."""
    sentences = F.transform(
        F.split(body, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(F.lower(strip(s)), r"\s+", " ")
    )
    return let(F.filter(sentences, lambda s: F.length(s) > 25), lambda s: F.size(s) > F.size(F.array_distinct(s)))


def mode_qa(drafts: DataFrame, modes: DataFrame, *, min_sources: int | None = 1) -> DataFrame:
    """Add ``mode_warnings``; ``modes(mode, min_words, max_words)``, 0 meaning no bound."""
    body = _text("body")
    words = word_count(body)
    joined = drafts.join(modes, "mode", "left")

    def unnamed(column: str, label: str, noun: str) -> Column:
        names = F.coalesce(F.col(column), F.array().cast(_EMPTY))
        absent = ~let(F.lower(body), lambda b: F.exists(names, lambda n: b.contains(F.lower(n))))
        return F.when(
            (F.size(names) > 0) & (body != "") & absent,
            F.concat(
                F.lit(f"QA [{label}]: retrieved sources reference {noun} ("),
                F.array_join(F.slice(names, 1, 3), ", "),
                F.lit(") but none appear in the draft body."),
            ),
        )

    low, high = F.col("min_words"), F.col("max_words")
    messages = [
        F.when((low > 0) & (words < low), F.format_string("QA [mode/length]: body too short (%d words, min %d).", words, low)),
        F.when((high > 0) & (words > high), F.format_string("QA [mode/length]: body too long (%d words, max %d).", words, high)),
        F.when((body != "") & has_duplicate_sentence(body), "QA [quality]: duplicate sentence detected in body."),
        F.when((body != "") & (F.col("n_sources") == 0), _UNGROUNDED),
    ]
    if min_sources is not None:
        messages.append(_sources(min_sources))
    messages += [unnamed("organizations", "partner", "organizations"), unnamed("programs", "entity", "programs")]
    return joined.withColumn("mode_warnings", F.array_compact(F.array(*messages))).drop("min_words", "max_words")


def merge_warnings(drafts: DataFrame) -> DataFrame:
    """Add ``qa_warnings``: both lists in order, each message once."""
    return drafts.withColumn("qa_warnings", F.array_distinct(F.concat("style_warnings", "mode_warnings")))


# --- review tables -------------------------------------------------------------------

# What an editor may change, and what only the generator writes.
EDITABLE = ("headline", "summary", "body", "suggested_slug")
_GENERATED = ("seo_summary", "model", "generated_at")
REVIEW_STATUSES = ("pending_review", "approved", "rejected")
DEFAULT_STATUS = "pending_review"


def _review_status() -> Column:
    return F.coalesce("review_status", F.lit(DEFAULT_STATUS))


def effective_draft(jobs: DataFrame) -> DataFrame:
    """Edited fields where they are not empty, else generated ones, from two JSON columns."""
    result, edits = F.col("result_json"), F.col("draft_json")

    def field(source: Column, name: str) -> Column:
        return F.get_json_object(source, f"$.{name}")

    def non_empty(value: Column) -> Column:
        return F.when(value != "", value)

    edited = [
        F.coalesce(non_empty(field(edits, n)), field(result, n), F.lit("")).alias(n) for n in EDITABLE
    ]
    generated = [F.coalesce(field(result, n), F.lit("")).alias(n) for n in _GENERATED]
    lists = [
        F.coalesce(F.from_json(field(result, n), _EMPTY), F.array().cast(_EMPTY)).alias(n) for n in ("hashtags", "qa_warnings")
    ]
    return jobs.select("job_id", *edited, *generated, *lists)


def draft_patch(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Merge the non-null fields of ``edits(job_id, headline, ...)`` into each job's ``draft_json``."""
    fresh = edits.select("job_id", F.from_json(F.to_json(F.struct(*EDITABLE)), "map<string,string>").alias("__new"))
    old = F.coalesce(F.from_json("draft_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    joined = jobs.join(fresh, "job_id", "left")
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("__new"), k))
    merged = F.to_json(F.map_concat(kept, F.col("__new")))
    return joined.withColumn("draft_json", F.when(F.col("__new").isNotNull(), merged).otherwise(F.col("draft_json"))).drop("__new")


def review_queue(jobs: DataFrame, status: str | None = None, newest: int = 50) -> DataFrame:
    """The newest finished jobs, all or with one review status."""
    done = jobs.where("status = 'done' AND result_json IS NOT NULL").withColumn("review_status", _review_status())
    if status in REVIEW_STATUSES:
        done = done.where(F.col("review_status") == status)
    return done.orderBy(F.desc("id")).limit(newest)


def recent_jobs(jobs: DataFrame, newest: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(newest)


def set_review_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(job_id, review_status)``; the other jobs stay as they are."""
    new = changes.select("job_id", F.col("review_status").alias("__new"))
    return jobs.join(new, "job_id", "left").withColumn("review_status", F.coalesce("__new", "review_status")).drop("__new")


def version_history(versions: DataFrame, name: str | None = None, newest: int = 30) -> DataFrame:
    """The newest versions of one configuration, or of each; older ones go before the shuffle."""
    kept = versions if name is None else versions.where(F.col("config_name") == name)
    order = Window.partitionBy("config_name").orderBy(F.desc("id"))
    return kept.withColumn("age", F.row_number().over(order)).where(F.col("age") <= newest)


def rollback(versions: DataFrame, current: DataFrame, version_id: int, saved_at: Column) -> tuple[DataFrame, DataFrame]:
    """``(versions, current)`` after restoring a version; what was current becomes a version.

    ``current(config_name, content)``.
    """
    chosen = versions.where(F.col("id") == version_id).select("config_name", F.col("content").alias("restored"))
    last = versions.agg(F.max("id")).scalar()
    snapshot = current.join(chosen, "config_name").select(
        (last + 1).alias("id"),
        "config_name",
        "content",
        saved_at.alias("saved_at"),
        F.lit(f"pre-rollback snapshot (restoring v{version_id})").alias("note"),
    )
    restored = current.join(chosen, "config_name", "left").select("config_name", F.coalesce("restored", "content").alias("content"))
    return versions.unionByName(snapshot), restored
