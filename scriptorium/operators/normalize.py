"""From documents to posts, and from raw posts to normalized posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.matching import inline_substrings, joined_hits, text_key
from scriptorium.functions.rules import MAX_INLINE_RULES, fits_inline, inline_array
from scriptorium.operators.validate import basename, media_list
from scriptorium.session import written

LINE_TYPE = "struct<level:int,text:string,is_list:boolean,image:string>"


# --- documents to posts --------------------------------------------------------

def segment_posts(docs: DataFrame, split_level: int = 1) -> DataFrame:
    """Cut documents into sections at headings of at most ``split_level``.

    ``docs(source_document, lines)`` holds one array of line structs per
    document. Where level 1 cuts nothing, level 2 is tried; where nothing cuts,
    the whole document is one section. Lines before the first cut are dropped.
    """
    section_type = f"array<struct<title:string,lines:array<{LINE_TYPE}>>>"

    def sections(ls: Column) -> Column:
        def is_cut(line: Column, level: Column) -> Column:
            return (line["level"] > 0) & (line["level"] <= level)

        level = F.when(
            F.lit(split_level == 1) & ~F.exists(ls, lambda x: is_cut(x, F.lit(1))), F.lit(2)
        ).otherwise(F.lit(split_level))

        def cuts(at_level: Column) -> Column:
            return F.filter(F.transform(ls, lambda x, i: F.when(is_cut(x, at_level), i)), lambda i: i.isNotNull())

        def between(heads: Column) -> Column:
            return F.transform(
                heads,
                lambda h, k: F.struct(
                    tx.strip(F.get(ls, h)["text"]).alias("title"),
                    F.slice(ls, h + 2, F.coalesce(F.get(heads, k + 1), F.size(ls)) - h - 1).alias("lines"),
                ),
            )

        found = tx.let(tx.let(level, cuts), between)
        real = F.filter(
            found, lambda s: (s["title"] != "") | F.exists(s["lines"], lambda x: tx.strip(x["text"]) != "")
        )
        stem = F.regexp_replace(basename(F.col("source_document")), r"(?<=.)\.[^.]*$", "")
        whole = F.array(F.struct(stem.alias("title"), ls.alias("lines"))).cast(section_type)
        return tx.let(real, lambda r: F.when(F.size(r) > 0, r.cast(section_type)).otherwise(whole))

    return docs.select(
        "source_document", F.posexplode(tx.let(F.col("lines"), sections)).alias("pos", "section")
    ).select("source_document", (F.col("pos") + 1).alias("section_no"), "section.title", "section.lines")


def clean_title(title: Column, site_codes: tuple[str, ...] = ()) -> Column:
    """Drop a trailing "Internal" mark, with a site code in brackets before it if there is one."""
    codes = f"(?:{'|'.join(site_codes)})?" if site_codes else ""
    return tx.strip(F.regexp_replace(title, rf"(?i)\s*[(\[]*{codes}[)\]]*\s*[–—\-]*\s*Internal\s*$", ""))


def build_posts(sections: DataFrame, site_codes: tuple[str, ...] = ()) -> DataFrame:
    """One post per section, with fallbacks for titles and slugs."""
    number = F.lpad(F.col("section_no").cast("string"), F.greatest(F.length(F.col("section_no").cast("string")), F.lit(3)), F.lit("0"))
    texts = F.transform("lines", lambda x: tx.strip(x["text"]))
    first_text = tx.first_non_empty(texts)
    full = F.filter("lines", lambda x: tx.strip(x["text"]) != "")
    body = F.array_join(
        F.transform(
            full,
            lambda x: F.concat(
                F.when(x["level"] > 0, F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" ")))
                .when(x["is_list"], F.lit("- "))
                .otherwise(""),
                tx.strip(x["text"]),
            ),
        ),
        "\n",
    )
    images = F.transform(
        F.array_distinct(F.filter(F.transform("lines", lambda x: x["image"]), lambda i: i.isNotNull() & (i != ""))),
        lambda name: F.concat(F.lit("images/"), name),
    )
    date_texts = F.concat(
        F.filter(F.array("title"), lambda t: t != ""), F.transform("lines", lambda x: x["text"])
    )
    return (
        sections.select(
            F.concat(F.lit("post-"), number).alias("internal"),
            F.coalesce(
                tx.null_if_empty(clean_title(F.col("title"), site_codes)),
                tx.head(first_text, 80),
                F.concat(F.lit("Untitled Post "), number),
            ).alias("title"),
            tx.detect_date(date_texts).alias("date"),
            F.coalesce(tx.ellipsized(first_text, 200), F.lit("")).alias("summary"),
            tx.strip(F.regexp_replace(body, r"\n{3,}", "\n\n")).alias("body"),
            images.alias("images"),
            "source_document",
        )
        .withColumn("slug", F.coalesce(tx.null_if_empty(tx.slugify(F.col("title"))), F.col("internal")))
        .select(
            "slug",
            "internal",
            "title",
            "summary",
            "body",
            "date",
            F.year("date").alias("year"),
            tx.quarter_name(F.col("date")).alias("quarter"),
            F.lit("").alias("category"),
            F.array().cast("array<string>").alias("tags"),
            F.lit("").alias("location"),
            F.lit("").alias("partner"),
            F.coalesce(F.get("images", F.lit(0)), F.lit("")).alias("featured_image"),
            F.slice("images", 2, F.greatest(F.size("images"), F.lit(1))).alias("gallery_images"),
            tx.head(F.col("title"), 60).alias("seo_title"),
            tx.head(F.col("summary"), 155).alias("seo_description"),
            "source_document",
            F.col("title").alias("source_section"),
            F.lit(0).alias("source_page"),
        )
    )


# --- normalization ---------------------------------------------------------------

def backfill_date(posts: DataFrame) -> DataFrame:
    """Fill an empty date from title, summary or body; else a day without a year is
    completed by the year in the source name. Year and quarter follow the date."""
    whole = F.coalesce(
        *[tx.first_date(F.coalesce(c, F.lit("")), wordy_ranges=False) for c in ("title", "summary", "body")]
    )
    year = F.regexp_extract(F.coalesce("source_document", F.lit("")), r"(\d{4})", 1)
    partial = F.when(
        year != "",
        F.coalesce(*[tx.month_day_date(F.coalesce(c, F.lit("")), year) for c in ("summary", "body")]),
    )
    return date_parts(posts.withColumn("date", F.coalesce("date", whole, partial)))


def date_parts(posts: DataFrame) -> DataFrame:
    return (
        posts.withColumn("year", F.year("date"))
        .withColumn("quarter", tx.quarter_name(F.col("date")))
        .withColumn("month", F.month("date"))
    )


def _haystack() -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "body")])


def rule_names(posts: DataFrame, rules: DataFrame, *, max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """Add ``rule_names``: distinct names of the rules with a keyword anywhere in the text.

    ``rules(rule_pos, name, keyword)``; names come in rule order, those of one
    position by name. Keywords match as substrings, so ``press`` also hits
    ``pressure``.
    """
    if fits_inline(rules, max_inline):
        ordered = rules.where("keyword <> ''").withColumn("t", F.lower("keyword")).orderBy("rule_pos", "name", "t")
        hits = inline_substrings(_haystack(), inline_array(ordered, "name", "t"))
        return posts.withColumn("rule_names", F.array_distinct(F.transform(hits, lambda h: h["name"])))
    # Matches come back by text, so posts may share a slug or have none.
    keyed = posts.withColumn("__key", text_key(_haystack()))
    pairs = joined_hits(
        keyed.select("__key", _haystack().alias("__text")), ["__key"], "__text", rules, ["rule_pos", "name", "keyword"], "keyword", mode="substring"
    )
    found = pairs.groupBy("__key").agg(F.collect_set(F.struct("rule_pos", "name")).alias("__h"))
    names = F.array_distinct(F.transform(F.array_sort("__h"), lambda h: h["name"]))
    return (
        keyed.join(found, "__key", "left")
        .withColumn("rule_names", F.coalesce(names, F.array().cast("array<string>")))
        .drop("__h", "__key")
    )


def assign_category(posts: DataFrame, rules: DataFrame, default: str, **how: object) -> DataFrame:
    """The name of the first rule that hits."""
    return (
        rule_names(posts, rules, **how)
        .withColumn("category", F.coalesce(F.get("rule_names", F.lit(0)), F.lit(default)))
        .drop("rule_names")
    )


def assign_tags(posts: DataFrame, rules: DataFrame, *, min_tags: int = 3, max_tags: int = 7, **how: object) -> DataFrame:
    """The names of all rules that hit, at most ``max_tags``."""
    names = F.col("rule_names")
    kept = F.when(F.size(names) < min_tags, names).otherwise(F.slice(names, 1, max_tags))
    return rule_names(posts, rules, **how).withColumn("tags", kept).drop("rule_names")


def tag_rules(topics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Topic rules followed by one rule per organization, location and credential."""
    # Entity types that become tags, in this order.
    types = F.array(*[F.lit(t) for t in ("organizations", "locations", "credentials")])
    entities = dictionary.where(F.array_contains(types, F.col("etype"))).select(
        F.array_position(types, F.col("etype")).cast("int").alias("a"),
        F.col("entry_pos").alias("b"),
        tx.slugify(F.col("canonical"), "tag").alias("name"),
        F.lower("alias").alias("keyword"),
    )
    # Positions behind the last topic, by type, then entry: two small aggregates instead of a global order.
    behind = F.coalesce(topics.agg(F.max("rule_pos")).scalar(), F.lit(0)) + 1
    step = F.coalesce(entities.agg(F.max("b")).scalar(), F.lit(0)) + 1
    placed = entities.select((behind + (F.col("a") - 1) * step + F.col("b")).cast("int").alias("rule_pos"), "name", "keyword")
    return topics.select(F.col("rule_pos").cast("int").alias("rule_pos"), "name", "keyword").unionByName(placed)


def clean_summary(body: Column, stored: Column, limit: int = 200) -> Column:
    """The first plain line of the body, cut at a sentence, else at a word."""
    def usable(line: Column) -> Column:
        return (line != "") & ~line.startswith("#") & ~line.startswith("http")

    from_body = F.get(F.filter(F.transform(tx.lines(body), tx.strip), usable), 0)
    from_stored = tx.strip(F.regexp_replace(tx.strip(F.coalesce(stored, F.lit(""))), "…+$", ""))

    def cut(raw: Column) -> Column:
        def shorten(chunk: Column) -> Column:
            result = F.when(tx.rfind(chunk, " ") > 60, F.concat(tx.head(chunk, tx.rfind(chunk, " ")), F.lit("…"))).otherwise(
                F.concat(tx.strip(chunk), F.lit("…"))
            )
            # Sentence ends, in the order in which they are tried.
            for stop in reversed([". ", "! ", "? "]):
                at = tx.rfind(chunk, stop)
                result = F.when(at > 60, tx.head(chunk, at + 1)).otherwise(result)
            return result

        return F.when(F.length(raw) <= limit, raw).otherwise(tx.let(tx.head(raw, limit), shorten))

    return tx.let(F.coalesce(from_body, from_stored), cut)


def seo_description(summary: Column, limit: int = 155) -> Column:
    def cut(chunk: Column) -> Column:
        return F.when(F.instr(chunk, " ") > 0, F.concat(tx.head(chunk, tx.rfind(chunk, " ")), F.lit("…"))).otherwise(chunk)

    return F.when(F.length(summary) <= limit, summary).otherwise(tx.let(tx.head(summary, limit), cut))


def seo_title(title: Column, limit: int = 60) -> Column:
    def cut(chunk: Column) -> Column:
        at = tx.rfind(chunk, " ")
        return F.regexp_replace(F.when(at > 20, tx.head(chunk, at)).otherwise(chunk), r"[- ,]+\z", "")

    return F.when(F.length(title) <= limit, title).otherwise(tx.let(tx.head(title, limit), cut))


def media_refs(posts: DataFrame, assets: DataFrame, *carried: str) -> DataFrame:
    """``(slug, seq, old_ref, new_ref, missing)``: references renumbered to ``{slug}-{nn}.{ext}``.

    References to files that ``assets(name)`` does not list stay as they are.
    Columns of the post named in ``carried`` come along.
    """
    refs = posts.select(
        "slug", *carried, F.posexplode(media_list(F.col("featured_image"), F.col("gallery_images"))).alias("pos", "old_ref")
    ).select("slug", *carried, (F.col("pos") + 1).alias("seq"), "old_ref", basename(F.col("old_ref")).alias("name"))
    known = assets.select("name").distinct().withColumn("known", F.lit(True))
    suffix = F.lower(F.regexp_extract("name", r"(?<=.)(\.[^.]+)$", 1))
    seq = F.lpad(F.col("seq").cast("string"), F.greatest(F.length(F.col("seq").cast("string")), F.lit(2)), F.lit("0"))
    renamed = F.concat(F.lit("images/"), F.col("slug"), F.lit("-"), seq, suffix)
    return refs.join(known, "name", "left").select(
        "slug",
        *carried,
        "seq",
        "old_ref",
        F.when(F.col("known"), renamed).otherwise(F.col("old_ref")).alias("new_ref"),
        F.col("known").isNull().alias("missing"),
    )


def media_key() -> Column:
    """What the references of a post depend on. Posts that share a slug may differ in their images."""
    return F.sha2(F.to_json(F.struct("slug", media_list(F.col("featured_image"), F.col("gallery_images")).alias("refs"))), 256)


def renamed_media(refs: DataFrame, key: str = "slug") -> DataFrame:
    """Per ``key`` the new featured image, gallery and warnings from :func:`media_refs`."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "old_ref", "new_ref", "missing")))
    return (
        refs.distinct()
        .groupBy(key)
        .agg(ordered.alias("r"))
        .select(
            key,
            F.get("r", F.lit(0))["new_ref"].alias("featured_image"),
            F.transform(F.slice("r", 2, F.greatest(F.size("r"), F.lit(1))), lambda x: x["new_ref"]).alias("gallery_images"),
            F.transform(
                F.filter("r", lambda x: x["missing"]), lambda x: F.concat(F.lit("missing image file: "), x["old_ref"])
            ).alias("media_warnings"),
            F.transform("r", lambda x: x["old_ref"]).alias("original_media"),
        )
    )


def sort_posts(posts: DataFrame) -> DataFrame:
    """Undated posts, then newest first; equal dates by slug."""
    return posts.orderBy(F.col("date").isNull().desc(), F.col("date").desc(), "slug")


def number_posts(posts: DataFrame) -> DataFrame:
    """Add ``feed_position``, from 1 in the order of ``sort_posts``; posts that tie in date and slug in any order.

    Rows count within the parts of the sorted table, which is stored once, and
    parts start where the earlier ones end, so no task sees all posts. An empty
    table stays empty.
    """
    ordered = written(sort_posts(posts).withColumn("__at", F.monotonically_increasing_id()))
    # The id holds the part above bit 33 and the row's place in the part below.
    part = F.shiftright("__at", 33).alias("__part")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy(part)
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return (
        ordered.select("*", part)
        .join(F.broadcast(starts), "__part")
        .withColumn("feed_position", F.col("__start") + place + 1)
        .drop("__at", "__part", "__start")
    )


def summarize_posts(posts: DataFrame) -> DataFrame:
    """Fresh summary and search-engine description."""
    return posts.withColumn("summary", clean_summary(F.col("body"), F.col("summary"))).withColumn(
        "seo_description", seo_description(F.col("summary"))
    )
