"""Draft QA and review table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import qa
from workloads import fixtures as fx

RULES = qa.StyleRules(headline_words=(2, 9), summary_words=(4, 20), min_sources=2, banned=("the", "que el"), discouraged=("und", "of"))
MODES = [("website", 20, 60), ("social", 0, 40), ("magazine", 50, 0)]


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a draft: first line, second line, whole text."""
    turns = fx.table(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    ln = F.split("text", "\n")
    empty = F.array().cast("array<string>")
    return turns.select(
        (i * 1000 + F.col("turn")).alias("draft_id"),
        F.element_at(F.array(F.lit("website"), F.lit("social"), F.lit("magazine")), (i % 3 + 1).cast("int")).alias("mode"),
        F.get(ln, 0).alias("headline"),
        F.coalesce(F.get(ln, 1), F.lit("")).alias("summary"),
        F.col("text").alias("body"),
        (i % 4).cast("int").alias("n_sources"),
        F.when(i % 2 == 0, F.array(F.lit("The Of"), F.lit("Le La"))).otherwise(empty).alias("organizations"),
        F.when(i % 3 == 0, F.array(F.lit("Ing "))).otherwise(empty).alias("programs"),
    )


DRAFTS_SQL = r"""
drafts AS MATERIALIZED (
  SELECT conv_id * 1000 + turn AS draft_id, ['website', 'social', 'magazine'][conv_id % 3 + 1] AS mode, trim(string_split(text, chr(10))[1]) AS headline,
    trim(coalesce(string_split(text, chr(10))[2], '')) AS summary, trim(text, ' ' || chr(10)) AS body, (conv_id % 4)::INT AS n_sources, conv_id % 2 = 0 AS orgs, conv_id % 3 = 0 AS progs
  FROM conversations
),
sized AS (
  SELECT *, len(regexp_extract_all(headline, '\S+')) AS hw, len(regexp_extract_all(summary, '\S+')) AS sw, len(regexp_extract_all(body, '\S+')) AS bw,
    lower(concat_ws(' ', headline, summary, body)) AS whole FROM drafts
),
style AS MATERIALIZED (
  SELECT draft_id, mode, list_filter([
    CASE WHEN headline = '' THEN 'QA [headline]: missing.' END,
    CASE WHEN headline <> '' AND hw < 2 THEN 'QA [headline]: too short (' || hw || ' words, min 2).' END,
    CASE WHEN hw > 9 THEN 'QA [headline]: too long (' || hw || ' words, max 9).' END,
    CASE WHEN headline LIKE '%?' THEN 'QA [headline]: is a question — avoid question headlines.' END,
    CASE WHEN contains(lower(headline), 'the') THEN 'QA [headline]: banned phrase — "the".' END,
    CASE WHEN contains(lower(headline), 'que el') THEN 'QA [headline]: banned phrase — "que el".' END,
    CASE WHEN summary = '' THEN 'QA [summary]: missing.' END,
    CASE WHEN summary <> '' AND sw < 4 THEN 'QA [summary]: too short (' || sw || ' words, min 4).' END,
    CASE WHEN sw > 20 THEN 'QA [summary]: too long (' || sw || ' words, max 20).' END,
    CASE WHEN summary <> '' AND headline <> '' AND rtrim(summary, '.') = rtrim(headline, '.') THEN 'QA [summary]: identical to headline.' END,
    CASE WHEN contains(whole, 'the') THEN 'QA [style]: banned phrase in draft — "the".' END,
    CASE WHEN contains(whole, 'que el') THEN 'QA [style]: banned phrase in draft — "que el".' END,
    CASE WHEN contains(whole, 'und') THEN 'QA [style]: discouraged phrase in draft — "und".' END,
    CASE WHEN contains(whole, 'of') THEN 'QA [style]: discouraged phrase in draft — "of".' END,
    CASE WHEN n_sources < 2 THEN 'QA [sources]: fewer than 2 source(s) (got ' || n_sources || ').' END,
    CASE WHEN body <> '' AND n_sources = 0 THEN 'QA [grounding]: body text present but no sources retrieved — claims cannot be verified.' END
  ], lambda w: w IS NOT NULL) AS w FROM sized
),
sentences AS (
  SELECT draft_id, trim(regexp_replace(lower(unnest(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), '\s+', ' ', 'g')) AS s FROM drafts
),
repeated AS (SELECT DISTINCT draft_id FROM (SELECT draft_id, s FROM sentences WHERE len(s) > 25 GROUP BY draft_id, s HAVING count(*) > 1)),
modes(mode, low, high) AS (VALUES ('website', 20, 60), ('social', 0, 40), ('magazine', 50, 0)),
by_mode AS MATERIALIZED (
  SELECT draft_id, list_filter([
    CASE WHEN low > 0 AND bw < low THEN 'QA [mode/length]: body too short (' || bw || ' words, min ' || low || ').' END,
    CASE WHEN high > 0 AND bw > high THEN 'QA [mode/length]: body too long (' || bw || ' words, max ' || high || ').' END,
    CASE WHEN draft_id IN (SELECT draft_id FROM repeated) THEN 'QA [quality]: duplicate sentence detected in body.' END,
    CASE WHEN body <> '' AND n_sources = 0 THEN 'QA [grounding]: body text present but no sources retrieved — claims cannot be verified.' END,
    CASE WHEN n_sources < 1 THEN 'QA [sources]: fewer than 1 source(s) (got ' || n_sources || ').' END,
    CASE WHEN orgs AND NOT contains(lower(body), 'the of') AND NOT contains(lower(body), 'le la')
      THEN 'QA [partner]: retrieved sources reference organizations (The Of, Le La) but none appear in the draft body.' END,
    CASE WHEN progs AND NOT contains(lower(body), 'ing ') THEN 'QA [entity]: retrieved sources reference programs (Ing ) but none appear in the draft body.' END
  ], lambda w: w IS NOT NULL) AS w FROM sized JOIN modes USING (mode)
)"""


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, min_words int, max_words int")


def style_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.style_qa(drafts(spark, sf_dir), RULES).select("draft_id", F.array_join("style_warnings", "\n").alias("warnings"))


def mode_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.mode_qa(drafts(spark, sf_dir), modes(spark)).select("draft_id", F.array_join("mode_warnings", "\n").alias("warnings"))


def merge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = qa.mode_qa(qa.style_qa(drafts(spark, sf_dir), RULES), modes(spark))
    return qa.merge_warnings(checked).select("draft_id", F.size("qa_warnings").alias("n"), F.array_join(F.array_sort("qa_warnings"), "\n").alias("warnings"))


def ordered_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged warnings as they stand: style first, each message at its first place."""
    checked = qa.mode_qa(qa.style_qa(drafts(spark, sf_dir), RULES), modes(spark))
    return qa.merge_warnings(checked).select("draft_id", F.array_join("qa_warnings", "\n").alias("warnings"))


def parse_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns wrapped as a model would answer: fenced JSON, bare JSON, broken JSON, plain text."""
    turns = fx.table(spark, sf_dir, "conversations")
    i = F.col("conv_id") % 4
    payload = F.to_json(F.struct(F.col("role").alias("headline"), F.col("text").alias("body")))
    raw = (
        F.when(i == 0, F.concat(F.lit("Here:\n```json\n"), payload, F.lit("\n```\nDone.")))
        .when(i == 1, F.concat(F.lit("Sure. "), payload))
        .when(i == 2, F.concat(F.lit(" {broken "), F.col("text"), F.lit("} ")))
        .otherwise(F.concat(F.lit("\n"), F.col("text")))
    )
    parsed = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("draft_id"), qa.parse_draft(raw).alias("d"))
    return parsed.select("draft_id", F.coalesce("d.headline", F.lit("")).alias("headline"), "d.body", F.size("d.hashtags").alias("n_tags"))


PARSE_SQL = r"""SELECT conv_id * 1000 + turn AS draft_id, CASE WHEN conv_id % 4 < 2 THEN role ELSE '' END AS headline,
  CASE conv_id % 4 WHEN 2 THEN '{broken ' || text || '}' WHEN 3 THEN trim(text, ' ' || chr(10)) ELSE text END AS body, 0 AS n_tags FROM conversations"""


# --- review tables ----------------------------------------------------------------------

def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    i = F.col("event_id")
    result = F.to_json(
        F.struct(
            F.concat(F.lit("Result "), i.cast("string")).alias("headline"),
            F.col("event_type").alias("summary"),
            F.col("props").alias("body"),
            F.lit("seo").alias("seo_summary"),
            F.array("event_type").alias("hashtags"),
        )
    )
    draft = F.to_json(F.struct(F.concat(F.lit("Edited "), i.cast("string")).alias("headline"), F.lit("").alias("summary")))
    return e.select(
        i.alias("id"),
        i.cast("string").alias("job_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
        F.when(F.col("value") > 10, "approved").when(F.col("value") > 5, "rejected").alias("review_status"),
        F.when(i % 13 != 0, result).alias("result_json"),
        F.when(i % 4 == 0, draft).alias("draft_json"),
    )


JOBS_SQL = """
jobs AS MATERIALIZED (
  SELECT event_id AS id, event_id::VARCHAR AS job_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
    CASE WHEN value > 10 THEN 'approved' WHEN value > 5 THEN 'rejected' END AS review_status, event_id % 13 <> 0 AS has_result, event_id % 4 = 0 AS has_draft, event_type, props FROM events
)"""


def effective_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.effective_draft(jobs(spark, sf_dir)).select("job_id", "headline", "summary", "body", "suggested_slug", "seo_summary", F.array_join("hashtags", "|").alias("hashtags"))


EFFECTIVE_SQL = f"""WITH {JOBS_SQL}
SELECT job_id, CASE WHEN has_draft THEN 'Edited ' || id WHEN has_result THEN 'Result ' || id ELSE '' END AS headline, CASE WHEN has_result THEN event_type ELSE '' END AS summary,
  CASE WHEN has_result THEN props ELSE '' END AS body, '' AS suggested_slug, CASE WHEN has_result THEN 'seo' ELSE '' END AS seo_summary, CASE WHEN has_result THEN event_type ELSE '' END AS hashtags FROM jobs"""


def draft_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third job gets a new summary; a patched headline replaces the edited one."""
    all_jobs = jobs(spark, sf_dir)
    i = F.col("id")
    edits = all_jobs.where("status = 'done'").select(
        "job_id",
        F.when(i % 6 == 0, F.lit("Patched")).alias("headline"),
        F.when(i % 3 == 0, F.lit("New summary")).alias("summary"),
        F.lit(None).cast("string").alias("body"),
        F.lit(None).cast("string").alias("suggested_slug"),
    )
    patched = qa.effective_draft(qa.draft_patch(all_jobs, edits))
    return patched.select("job_id", "headline", "summary")


PATCH_SQL = f"""WITH {JOBS_SQL}
SELECT job_id, CASE WHEN status = 'done' AND id % 6 = 0 THEN 'Patched' WHEN has_draft THEN 'Edited ' || id WHEN has_result THEN 'Result ' || id ELSE '' END AS headline,
  CASE WHEN status = 'done' AND id % 3 = 0 THEN 'New summary' WHEN has_result THEN event_type ELSE '' END AS summary FROM jobs"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.review_queue(jobs(spark, sf_dir), "pending_review").select("id", "job_id", "review_status")


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.recent_jobs(jobs(spark, sf_dir)).select("id", "job_id", "status")


def set_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are approved, errors sent back; counted by resulting status."""
    e = fx.table(spark, sf_dir, "events")
    changes = e.where("event_type IN ('purchase', 'error')").select(
        F.col("event_id").cast("string").alias("job_id"), F.when(F.col("event_type") == "purchase", "approved").otherwise("pending_review").alias("review_status")
    )
    return qa.set_review_status(jobs(spark, sf_dir), changes).select("job_id", "review_status")


SET_STATUS_SQL = f"""WITH {JOBS_SQL}
SELECT job_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'pending_review' ELSE review_status END AS review_status FROM jobs"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("config_name"), F.col("props").alias("content"), F.col("ts").cast("string").alias("saved_at"), F.lit("").alias("note")
    )


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.version_history(versions(spark, sf_dir)).select("config_name", "id", F.col("age").cast("long").alias("age"))


def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore version 7; both resulting tables in one."""
    all_versions = versions(spark, sf_dir)
    current = all_versions.groupBy("config_name").agg(F.max_by("content", "id").alias("content"))
    after, restored = qa.rollback(all_versions, current, 7, F.lit("2024-06-01"))
    snapshot = after.where("note <> ''").select(F.lit("version").alias("kind"), "config_name", "content", "note")
    return snapshot.unionByName(restored.select(F.lit("current").alias("kind"), "config_name", "content", F.lit("").alias("note")))


ROLLBACK_SQL = """WITH cur AS (SELECT event_type AS config_name, arg_max(props, event_id) AS content FROM events GROUP BY event_type),
old AS (SELECT event_type AS config_name, props FROM events WHERE event_id = 7)
SELECT 'version' AS kind, config_name, content, 'pre-rollback snapshot (restoring v7)' AS note FROM cur JOIN old USING (config_name)
UNION ALL SELECT 'current', config_name, coalesce(props, content), '' FROM cur LEFT JOIN old USING (config_name)"""

QUERIES = {
    "style_qa": (style_qa, f"WITH {DRAFTS_SQL} SELECT draft_id, array_to_string(w, chr(10)) AS warnings FROM style"),
    "mode_qa": (mode_qa, f"WITH {DRAFTS_SQL} SELECT draft_id, array_to_string(w, chr(10)) AS warnings FROM by_mode"),
    "merge_warnings": (
        merge_warnings,
        f"""WITH {DRAFTS_SQL}, m AS (SELECT draft_id, list_sort(list_distinct(list_concat(s.w, b.w))) AS w FROM style s JOIN by_mode b USING (draft_id))
        SELECT draft_id, len(w)::INT AS n, array_to_string(w, chr(10)) AS warnings FROM m""",
    ),
    "ordered_warnings": (
        ordered_warnings,
        f"""WITH {DRAFTS_SQL}, m AS (SELECT draft_id, list_concat(s.w, b.w) AS w FROM style s JOIN by_mode b USING (draft_id))
        SELECT draft_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), chr(10)) AS warnings FROM m""",
    ),
    "parse_draft": (parse_draft, PARSE_SQL),
    "effective_draft": (effective_draft, EFFECTIVE_SQL),
    "draft_patch": (draft_patch, PATCH_SQL),
    "review_queue": (
        review_queue,
        f"WITH {JOBS_SQL} SELECT id, job_id, 'pending_review' AS review_status FROM jobs WHERE status = 'done' AND has_result AND review_status IS NULL ORDER BY id DESC LIMIT 50",
    ),
    "recent_jobs": (recent_jobs, f"WITH {JOBS_SQL} SELECT id, job_id, status FROM jobs ORDER BY id DESC LIMIT 20"),
    "set_review_status": (set_review_status, SET_STATUS_SQL),
    "version_history": (
        version_history,
        "SELECT * FROM (SELECT event_type AS config_name, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events) WHERE age <= 30",
    ),
    "rollback": (rollback, ROLLBACK_SQL),
}
