"""Operator inputs derived from the shared tables, in Spark and in SQL.

Each derivation exists twice: as a DataFrame and as a SQL fragment with the
same name, so that a query and its SQL counterpart start from equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators.classify import ClassificationRules
from scriptorium.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- posts -------------------------------------------------------------------

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    i = F.col("doc_id")
    ln = F.col("ln")
    dated = F.element_at(
        F.array(
            F.lit("Held on 2024-03-15."),
            F.lit("Held on March 5, 2024."),
            F.lit("Held on March 4–8, 2024."),
            F.lit("Held in March 2024."),
        ),
        (i % 4 + 1).cast("int"),
    )
    body_lines = F.transform(
        F.slice(ln, 2, F.size(ln)),
        lambda line: F.when(
            F.size(F.split(line, " +")) <= 3, F.concat(F.repeat(F.lit("#"), F.size(F.split(line, " +"))), F.lit(" "), line)
        ).otherwise(line),
    )
    date = F.when(i % 10 != 3, F.date_add(F.lit("2022-01-01").cast("date"), ((i * 7) % 1460).cast("int")))
    name = F.concat(F.lit("images/"), F.col("source"), F.lit("-"), (i % 50).cast("string"), F.lit(".jpg"))
    gallery = F.array(
        F.concat(F.lit("images/g"), (i % 30).cast("string"), F.lit(".png")),
        F.concat(F.lit("images/g"), (i % 20).cast("string"), F.lit(".jpg")),
    )
    return (
        docs.withColumn("ln", F.split("text", "\n"))
        .select(
            "doc_id",
            F.concat(F.lit("doc-"), i.cast("string")).alias("slug"),
            F.concat(F.lit("post-"), i.cast("string")).alias("internal"),
            F.substring(F.get(ln, 0), 1, 80).alias("title"),
            F.substring(F.coalesce(F.get(ln, 1), F.lit("")), 1, 200).alias("summary"),
            F.array_join(F.when(i % 10 == 3, F.concat(F.array(dated), body_lines)).otherwise(body_lines), "\n\n").alias(
                "body"
            ),
            date.alias("date"),
            F.lit("").alias("category"),
            F.array().cast("array<string>").alias("tags"),
            F.when(i % 6 == 0, F.concat(F.lit("city-"), F.col("lang"))).otherwise("").alias("location"),
            F.when(i % 5 == 0, F.col("source")).otherwise("").alias("partner"),
            F.when(i % 4 != 0, name).otherwise("").alias("featured_image"),
            F.when(i % 3 == 0, gallery).otherwise(F.array().cast("array<string>")).alias("gallery_images"),
            F.substring(F.get(ln, 0), 1, 60).alias("seo_title"),
            F.lit("").alias("seo_description"),
            F.col("source").alias("source_document"),
            F.substring(F.get(ln, 0), 1, 80).alias("source_section"),
            F.lit(0).alias("source_page"),
            F.col("lang").alias("language"),
            F.when(i % 17 == 0, "draft").otherwise("approved").alias("status"),
            F.lit("public").alias("visibility"),
            F.lit(True).alias("published"),
        )
        .withColumn("year", F.year("date"))
        .withColumn("quarter", F.concat(F.lit("Q"), F.quarter("date").cast("string")))
    )


POSTS_SQL = r"""
posts_base AS (
  SELECT doc_id, lang, source, string_split(text, chr(10)) AS ln FROM documents
),
posts_dated AS MATERIALIZED (
  SELECT
    doc_id,
    'doc-' || doc_id AS slug,
    'post-' || doc_id AS internal,
    substr(ln[1], 1, 80) AS title,
    substr(coalesce(ln[2], ''), 1, 200) AS summary,
    array_to_string(
      list_concat(
        CASE WHEN doc_id % 10 = 3
             THEN [['Held on 2024-03-15.', 'Held on March 5, 2024.', 'Held on March 4–8, 2024.', 'Held in March 2024.'][doc_id % 4 + 1]]
             ELSE []::VARCHAR[] END,
        list_transform(ln[2:], lambda l: CASE WHEN len(regexp_split_to_array(l, ' +')) <= 3
                                                  THEN repeat('#', len(regexp_split_to_array(l, ' +'))) || ' ' || l ELSE l END)
      ), chr(10) || chr(10)) AS body,
    CASE WHEN doc_id % 10 <> 3 THEN DATE '2022-01-01' + CAST((doc_id * 7) % 1460 AS INTEGER) END AS date,
    CASE WHEN doc_id % 6 = 0 THEN 'city-' || lang ELSE '' END AS location,
    CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS partner,
    CASE WHEN doc_id % 4 <> 0 THEN 'images/' || source || '-' || (doc_id % 50) || '.jpg' ELSE '' END AS featured_image,
    CASE WHEN doc_id % 3 = 0 THEN ['images/g' || (doc_id % 30) || '.png', 'images/g' || (doc_id % 20) || '.jpg']
         ELSE []::VARCHAR[] END AS gallery_images,
    substr(ln[1], 1, 60) AS seo_title,
    source AS source_document,
    substr(ln[1], 1, 80) AS source_section,
    lang AS language,
    CASE WHEN doc_id % 17 = 0 THEN 'draft' ELSE 'approved' END AS status,
    'public' AS visibility,
    true AS published
  FROM posts_base
),
posts AS MATERIALIZED (
  SELECT *, year(date) AS year, 'Q' || quarter(date) AS quarter FROM posts_dated
)"""


# --- assets ------------------------------------------------------------------

def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of a media folder; some are used by posts, some are not."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = F.array(
        F.concat(F.col("source"), F.lit("-"), (i % 40).cast("string"), F.lit(".jpg")),
        F.concat(F.lit("g"), (i % 35).cast("string"), F.lit(".png")),
    )
    return docs.select(F.explode(names).alias("name")).distinct()


IMAGE_NAMES_SQL = """
image_names AS (
  SELECT DISTINCT unnest([source || '-' || (doc_id % 40) || '.jpg', 'g' || (doc_id % 35) || '.png']) AS name
  FROM documents
)"""


# --- dictionary --------------------------------------------------------------

# (type, position, canonical name, terms)
DICTIONARY = [
    ("organizations", 1, "The Works", ["The Works", "the"]),
    ("organizations", 2, "Of Trust", ["Of Trust", "of", "von"]),
    ("organizations", 3, "And Partners", ["And Partners", "et la"]),
    ("programs", 4, "To Program", ["To Program", "to"]),
    ("programs", 5, "In Course", ["In Course", "in that"]),
    ("locations", 6, "That Town", ["That Town", "that", "des"]),
    ("locations", 7, "Por City", ["Por City", "por"]),
    ("credentials", 8, "For Certificate", ["For Certificate", "the,"]),
    ("credentials", 9, "With Diploma", ["With Diploma", "with", "mit"]),
    ("people", 10, "Is Person", ["Is Person", "it is"]),
    ("people", 11, "Una Person", ["Una Person", "una", "und"]),
    ("activities", 12, "Graduation", ["Graduation", "from"]),
    ("activities", 13, "Agreement", ["Agreement", "by the"]),
    ("activities", 14, "Media Coverage", ["Media Coverage", "shat"]),
    ("activities", 15, "Certification", ["Certification", "als"]),
]


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [(e, p, c, t) for e, p, c, terms in DICTIONARY for t in terms]
    return spark.createDataFrame(rows, "etype string, entry_pos int, canonical string, alias string")


def _quoted(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


DICTIONARY_SQL = values_sql(
    "dictionary",
    ["etype", "entry_pos", "canonical", "alias"],
    [(e, p, c, t) for e, p, c, terms in DICTIONARY for t in terms],
)


# --- classification rules -------------------------------------------------------

CATEGORY_ORDER = [
    ("Partnerships & Agreements", 1),
    ("Events & Ceremonies", 2),
    ("Accreditation & Compliance", 3),
    ("Training Programs", 4),
    ("Community Outreach", 5),
    ("Media", 6),
]
CAT_SIGNALS = [
    ("Partnerships & Agreements", "activity", "Agreement"),
    ("Partnerships & Agreements", "organization", "The Works"),
    ("Events & Ceremonies", "activity", "Graduation"),
    ("Accreditation & Compliance", "entity_type", "credentials"),
    ("Accreditation & Compliance", "activity", "Certification"),
    ("Training Programs", "entity_type", "programs"),
    ("Training Programs", "program", "In Course"),
    ("Community Outreach", "entity_type", "locations"),
    ("Community Outreach", "entity_type", "people"),
    ("Media", "activity", "Media Coverage"),
    ("Media", "credential", "With Diploma"),
]
CAT_PATTERNS = [
    ("Partnerships & Agreements", 1, "organization"),
    ("Partnerships & Agreements", 1, "Agreement"),
    ("Training Programs", 2, "program"),
    ("Training Programs", 2, "location"),
    ("Media", 3, "Media Coverage"),
    ("Media", 3, "person"),
]
# (position, category, subcategory, kind of condition, value)
SUBCAT_RULES = [
    (1, "Partnerships & Agreements", "Trust Deals", "organization", "Of Trust"),
    (1, "Partnerships & Agreements", "Trust Deals", "activity", "Agreement"),
    (2, "Partnerships & Agreements", "Works Deals", "organization", "The Works"),
    (2, "Partnerships & Agreements", "Works Deals", "organization", "And Partners"),
    (3, "Events & Ceremonies", "Town Events", "location", "That Town"),
    (4, "Training Programs", "Courses", "program", "In Course"),
    (5, "Community Outreach", "Cities", "location", "Por City"),
]
KEYWORD_RULES = [
    ("Events & Ceremonies", "les"),
    ("Events & Ceremonies", "der"),
    ("Training Programs", "que"),
    ("Training Programs", "est"),
    ("Community Outreach", "is and"),
    ("Media", "une"),
]
TAG_CAPS = [("organizations", 2), ("programs", 1), ("locations", 3), ("credentials", 3), ("people", 1), ("activities", 3)]
THEMATIC_RULES = [
    (1, "Workforce", "category", "Training Programs"),
    (2, "Employers", "activity", "Agreement"),
    (3, "Inclusion", "text", "une"),
    (4, "Technology", "program", "In Course"),
    (5, "Hidden", "text", "the"),
    (6, "Abroad", "location", "Por City"),
]
ALLOWED_THEMATIC = ("Workforce", "Employers", "Inclusion", "Technology", "Abroad")
DISALLOWED_TAGS = ("Una Person",)
# (position, name, keyword)
ORDERED_RULES = [
    (1, "pressing", "press"),
    (1, "pressing", "ition"),
    (2, "streets", " str"),
    (3, "mentions", "ment"),
    (4, "others", "oth"),
    (4, "others", "and the"),
    (5, "unions", "ung"),
    (6, "ashes", "ash"),
    (7, "cions", "ción"),
    (8, "endings", "ing "),
    (9, "thats", "that,"),
]

RULES_SQL = ", ".join(
    [
        values_sql("category_order", ["category", "pos"], CATEGORY_ORDER),
        values_sql("cat_signals", ["category", "kind", "value"], CAT_SIGNALS),
        values_sql("cat_patterns", ["category", "pattern_id", "element"], CAT_PATTERNS),
        values_sql("subcat_rules", ["rule_pos", "category", "subcategory", "cond_kind", "value"], SUBCAT_RULES),
        values_sql("keyword_rules", ["category", "keyword"], KEYWORD_RULES),
        values_sql("tag_caps", ["etype", "max_per_doc"], TAG_CAPS),
        values_sql("thematic_rules", ["thematic_pos", "tag", "cond_kind", "value"], THEMATIC_RULES),
    ]
)
ORDERED_RULES_SQL = values_sql("ordered_rules", ["rule_pos", "name", "keyword"], ORDERED_RULES)


def ordered_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDERED_RULES, "rule_pos int, name string, keyword string")


def classification_rules(spark: SparkSession) -> ClassificationRules:
    def frame(rows: list, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    return ClassificationRules(
        category_order=frame(CATEGORY_ORDER, "category string, pos int"),
        cat_signals=frame(CAT_SIGNALS, "category string, kind string, value string"),
        cat_patterns=frame(CAT_PATTERNS, "category string, pattern_id int, element string"),
        subcat_rules=frame(SUBCAT_RULES, "rule_pos int, category string, subcategory string, cond_kind string, value string"),
        keyword_rules=frame(KEYWORD_RULES, "category string, keyword string"),
        tag_caps=frame(TAG_CAPS, "etype string, max_per_doc int"),
        thematic_rules=frame(THEMATIC_RULES, "thematic_pos int, tag string, cond_kind string, value string"),
        allowed_thematic=ALLOWED_THEMATIC,
        disallowed_tags=DISALLOWED_TAGS,
    )


# --- knowledge documents ----------------------------------------------------------

# Tags that end a paragraph, list item or heading, closed or not.
_BLOCK = "h1|h2|p|li|ul|ol|div|nav|article|footer|body|html"


def page_elements(html: Column) -> Column:
    """``array<struct<kind, text>>``: headings, paragraphs and list items of the article, in order.

    An element goes to the next block tag, because pages leave some unclosed.
    Inline tags are dropped, ``<br>`` is a blank; elements without text are left out.
    """
    article = F.regexp_extract(html, r"(?s)<article>(.*?)(?:</article>|<footer|\z)", 1)
    pattern = F.lit(rf"(?s)<(h1|p|li)>(.*?)(?=</?(?:{_BLOCK})\b|\z)")

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, "<br ?/?>", " "), "<[^>]*>", "")

    both = F.zip_with(
        F.regexp_extract_all(article, pattern, 1),
        F.regexp_extract_all(article, pattern, 2),
        lambda kind, text: F.struct(kind.alias("kind"), plain(text).alias("text")),
    )
    return F.filter(both, lambda e: e["text"] != "")


# Another way to the same rows: tags become marks, then the article is split at them.
PAGE_ELEMENTS_SQL = rf"""
  SELECT page_id, i, kind, text FROM (
    SELECT page_id, i, split_part(piece, chr(2), 1) AS kind,
      regexp_replace(regexp_replace(substr(piece, strpos(piece, chr(2)) + 1), '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS text
    FROM (
      SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (
        SELECT page_id, string_split(regexp_replace(regexp_replace(
          split_part(split_part(substr(html, strpos(html, '<article>') + 9), '</article>', 1), '<footer', 1),
          '<(h1|p|li)>', chr(1) || '\1' || chr(2), 'g'), '</?(?:{_BLOCK})>', chr(1) || 'end' || chr(2), 'g'), chr(1)) AS pieces
        FROM pages WHERE contains(html, '<article>'))))
  WHERE kind IN ('h1', 'p', 'li') AND text <> ''"""


def knowledge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    i = F.col("page_id")
    kinds = F.array(F.lit("faq"), F.lit("editorial_guidelines"), F.lit("program"))
    return pages.select(
        F.regexp_extract("html", "<h1>([^<]+)<", 1).alias("title"),
        F.concat(F.lit("page-"), i.cast("string")).alias("slug"),
        F.element_at(kinds, (i % 3 + 1).cast("int")).alias("knowledge_type"),
        F.when(i % 11 == 0, "draft").otherwise("approved").alias("status"),
        F.lit(True).alias("published"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"),
        F.when(i % 13 == 0, "").otherwise(F.element_at(F.array(F.lit("high"), F.lit("low")), (i % 2 + 1).cast("int"))).alias("priority"),
        F.when(i % 25 == 0, "news").otherwise("knowledge").alias("memory_layer"),
        F.array_join(
            F.transform(F.filter(page_elements(F.col("html")), lambda e: e["kind"] != "h1"), lambda e: e["text"]), "\n\n"
        ).alias("body"),
        F.col("url").alias("source_file"),
    )


KNOWLEDGE_SQL = rf"""
knowledge_docs AS MATERIALIZED (
  WITH bodies AS (
    SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS body FROM ({PAGE_ELEMENTS_SQL}) WHERE kind <> 'h1' GROUP BY page_id)
  SELECT regexp_extract(html, '<h1>([^<]+)<', 1) AS title, 'page-' || page_id AS slug,
    ['faq', 'editorial_guidelines', 'program'][page_id % 3 + 1] AS knowledge_type,
    CASE WHEN page_id % 11 = 0 THEN 'draft' ELSE 'approved' END AS status, true AS published,
    regexp_extract(html, 'lang="([a-z]+)"', 1) AS language,
    CASE WHEN page_id % 13 = 0 THEN '' ELSE ['high', 'low'][page_id % 2 + 1] END AS priority,
    CASE WHEN page_id % 25 = 0 THEN 'news' ELSE 'knowledge' END AS memory_layer,
    coalesce(body, '') AS body,
    url AS source_file
  FROM pages LEFT JOIN bodies USING (page_id)
)"""


# --- queries -----------------------------------------------------------------------

def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

# (kind, phrase)
ROUTE_SIGNALS = [
    ("draft", "thouth"), ("draft", "queeau"),
    ("news", "and the"), ("news", "shat"), ("news", "der "), ("news", "par la"),
    ("knowledge", "it is"), ("knowledge", "tion of"), ("knowledge", "und"), ("knowledge", "ción"),
]
ROUTE_SIGNALS_SQL = values_sql("route_signals", ["kind", "phrase"], ROUTE_SIGNALS)


def route_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTE_SIGNALS, "kind string, phrase string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a query, some with an explicit intent."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        F.when(F.col("conv_id") % 7 == 0, "news").when(F.col("conv_id") % 11 == 0, "knowledge").alias("intent"),
    )


ASKED_SQL = """
asked AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS query,
         CASE WHEN conv_id % 7 = 0 THEN 'news' WHEN conv_id % 11 = 0 THEN 'knowledge' END AS intent FROM conversations
)"""
