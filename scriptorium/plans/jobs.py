"""Whole jobs composed from operators: tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from scriptorium.operators import buckets, context, graph, index, media, normalize, qa, refresh, routing, search, tagging, validate
from scriptorium.session import spread, written
from scriptorium.sources import writers


# --- from documents to posts ------------------------------------------------------

@dataclass(frozen=True)
class NormalizationRules:
    """``category_rules`` and ``tag_rules`` are ``(rule_pos, name, keyword)`` tables."""

    category_rules: DataFrame
    tag_rules: DataFrame
    default_category: str = "General"
    min_tags: int = 3
    max_tags: int = 7


def extract_corpus(documents: DataFrame, *, split_level: int = 1, site_codes: tuple[str, ...] = ()) -> DataFrame:
    """Posts of ``documents(source_document, lines)``."""
    return normalize.build_posts(normalize.segment_posts(documents, split_level), site_codes)


def normalize_metadata(posts: DataFrame, rules: NormalizationRules) -> DataFrame:
    """Dates, category, tags and summaries, all in the row of their post."""
    dated = normalize.backfill_date(posts)
    sorted_in = normalize.assign_category(dated, rules.category_rules, rules.default_category)
    tagged = normalize.assign_tags(sorted_in, rules.tag_rules, min_tags=rules.min_tags, max_tags=rules.max_tags)
    return normalize.summarize_posts(tagged)


def normalize_corpus(posts: DataFrame, assets: DataFrame, rules: NormalizationRules) -> tuple[DataFrame, DataFrame]:
    """``(posts, issues)``: normalized posts with renumbered media, and what is wrong with each."""
    keyed = posts.withColumn("media_key", normalize.media_key())
    ready = normalize_metadata(keyed, rules)
    media_names = normalize.renamed_media(normalize.media_refs(keyed, assets, "media_key"), "media_key")
    none = F.array().cast("array<string>")
    joined = (
        ready.drop("featured_image", "gallery_images")
        .join(media_names, "media_key", "left")
        .drop("media_key")
        .withColumn("featured_image", F.coalesce("featured_image", F.lit("")))
        .withColumns({c: F.coalesce(c, none) for c in ("gallery_images", "original_media", "media_warnings")})
    )
    issues = validate.validate_normalized(joined, assets, min_tags=rules.min_tags)
    return joined.drop("original_media"), issues


# --- index and search --------------------------------------------------------------

def build_index(posts: DataFrame, dictionary: DataFrame, path: str, **checks: bool) -> tuple[DataFrame, DataFrame]:
    """Write the news index to ``path``; returns it and the failed posts."""
    rows, failed = index.ingest_posts(posts, dictionary, **checks)
    index.rebuild_index(rows, path)
    return posts.sparkSession.read.parquet(path), failed


def batch_search(queries: DataFrame, news: DataFrame, *columns: str, **options: object) -> DataFrame:
    """Live hits of every query with the given index columns."""
    return search.with_payload(search.retrieve(search.embed_queries(queries), news, **options), news, *columns)


def routed_context(
    queries: DataFrame, signals: DataFrame, news: DataFrame, knowledge: DataFrame, nodes: DataFrame, edges: DataFrame, *, limit: int = search.DEFAULT_LIMIT
) -> DataFrame:
    """``(query_id, route, context, over_budget)``: one context text per query.

    Routes decide the lanes; lanes bring hits; hits and queries name graph
    entities, whose profiles close the text. What several later steps read is
    written once.
    """
    asked = queries if "intent" in queries.columns else queries.withColumn("intent", F.lit(None).cast("string"))
    routed = written(routing.route_queries(search.embed_queries(asked), signals))
    lanes = written(routing.lane_retrieve(routed, news, knowledge, limit=limit))
    shown = written(_with_lane_payload(lanes, news, knowledge))
    blocks = context.lane_blocks(shown)
    names = _names_of_hits(shown)
    profiles = _graph_profiles(routed, names, nodes, edges)
    entities = context.entity_block(tagging.entities_for_hits(shown.where("lane <> 'editorial'")))
    packed = context.context_pack(routed, blocks, profiles, entities)
    return routed.select("query_id", "route").join(packed, "query_id")


def _with_lane_payload(lanes: DataFrame, news: DataFrame, knowledge: DataFrame) -> DataFrame:
    entities = [f"entities_{t}" for t in tagging.ENTITY_TYPES]
    text = F.lit(None).cast("string")
    of_news = news.select(
        "chunk_id", "slug", "chunk_text", "title", "date", "category", "tags", text.alias("knowledge_type"), text.alias("section"), *entities
    )
    of_knowledge = knowledge.select(
        "chunk_id", "slug", "chunk_text", "title", text.alias("date"), text.alias("category"),
        F.array().cast("array<string>").alias("tags"), "knowledge_type", "section", *entities,
    )
    from_news = lanes.where("lane = 'news'").join(of_news, "chunk_id")
    return from_news.unionByName(lanes.where("lane <> 'news'").join(of_knowledge, "chunk_id"))


def _names_of_hits(shown: DataFrame) -> DataFrame:
    # Entity types whose names are looked up in the graph.
    kinds = ("organizations", "programs", "people", "credentials")
    found = tagging.entities_for_hits(shown.where("lane <> 'editorial'"))
    return found.where(F.col("etype").isin(*kinds)).select("query_id", "name").distinct()


def _graph_profiles(queries: DataFrame, names: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    everything = graph.all_nodes(nodes, edges)
    aliases = written(graph.name_index(nodes))
    detected = written(graph.detect_graph_entities(queries.select("query_id", "query"), aliases, written(names)))
    blocks = graph.context_blocks(detected.select("id"), everything, edges)
    return detected.join(blocks, "id").select("query_id", "pos", "block")


# --- drafts ---------------------------------------------------------------------------

def draft_qa(drafts: DataFrame, style: qa.StyleRules, modes: DataFrame) -> DataFrame:
    """Drafts with all their warnings, each once."""
    return qa.merge_warnings(qa.mode_qa(qa.style_qa(drafts, style), modes))


# --- media ------------------------------------------------------------------------------

def rank_media(assets: DataFrame, threshold: int = 8) -> DataFrame:
    """``(part, name, leader, total, group_size, duplicate, rank, role)`` of every asset."""
    groups = written(media.near_duplicate_groups(assets, threshold=threshold))
    scores = media.quality_score(assets).select(F.col("event_id").alias("part"), F.col("filename").alias("name"), "total")
    return media.hero_gallery(media.keep_best(groups, scores))


# --- refresh ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Refreshed:
    posts: DataFrame
    index: DataFrame
    replaced: DataFrame
    failed: DataFrame
    report: DataFrame


def refresh_corpus(
    posts: DataFrame, news: DataFrame, incoming: DataFrame, dictionary: DataFrame, *, order: list[Column] | None = None, dry_run: bool = False
) -> Refreshed:
    """Replace everything that came from the sources of ``incoming``.

    Tables are returned, not overwritten: write them to a new place and move the
    live view there, so that a lost job leaves the old state untouched. Run
    twice with the same input, the result is the same.
    """
    replaced = refresh.match_existing(posts, incoming.select("source_document").distinct())
    # A post of another source whose slug comes in is replaced, too.
    gone = replaced.select("slug").union(incoming.select("slug"))
    new_posts = refresh.replace_source(posts, incoming, order)
    # Tagged and chunked once, in tasks of one length, though index and report both read the chunks.
    fresh = spread(written(index.latest(incoming, "slug", order or index.slug_order(incoming))))
    rows, failed = index.ingest_posts(fresh, dictionary, one_each=True)
    new_index = refresh.refresh_index(news, gone, written(rows))
    report = refresh.refresh_report(posts, new_posts, replaced, incoming, news, new_index, dry_run=dry_run)
    if dry_run:
        return Refreshed(posts, news, replaced, failed, report)
    return Refreshed(new_posts, new_index, replaced, failed, report)


def refresh_stored(
    posts: DataFrame, layout: buckets.Layout, incoming: DataFrame, dictionary: DataFrame, *, order: list[Column] | None = None
) -> tuple[DataFrame, buckets.Change]:
    """:func:`refresh_corpus` for an index on disk: the new posts, and what changed in the index at ``layout``.

    Only the buckets that hold replaced slugs or receive new chunks are read and written.
    """
    fresh = written(index.latest(incoming, "slug", order or index.slug_order(incoming)))
    sources = written(incoming.select("source_document").distinct())
    gone = refresh.match_existing(posts, sources).select("slug").union(fresh.select("slug"))
    rows, _ = index.ingest_posts(fresh, dictionary, one_each=True)
    changed = buckets.change_index(posts.sparkSession, layout, rows, gone)
    return index.upsert(refresh.without_sources(posts, sources), fresh, "slug"), changed


@dataclass(frozen=True)
class RefreshOptions:
    """Which stages of :func:`refresh_archive` run."""

    dry_run: bool = False
    backup: bool = True
    delete_existing: bool = True
    reinsert: bool = True
    regenerate: bool = True
    cms_manifest: bool = True
    base_url: str = ""
    title: str = "News"


@dataclass(frozen=True)
class Archive:
    """``records`` are the incoming posts as they were published, ``issues`` what validation says about them."""

    posts: DataFrame
    records: DataFrame
    issues: DataFrame
    failed: DataFrame
    orphans: DataFrame
    changed: buckets.Change
    report: DataFrame


def refresh_archive(
    posts: DataFrame, layout: buckets.Layout, incoming: DataFrame, dictionary: DataFrame, rules: NormalizationRules, assets: DataFrame, path: str, stamp: str,
    options: RefreshOptions = RefreshOptions(), order: list[Column] | None = None,
) -> Archive:
    """Bring new versions of whole sources into the archive, stage by stage.

    1. Posts of the incoming sources are found and, with ``backup``, kept under
       ``path/snapshots`` (in a dry run as well: nothing is lost by it).
    2. With ``regenerate`` the incoming posts are normalized, else they are taken as they are.
    3. With ``delete_existing`` the found posts and their chunks go; else they stay
       where no incoming post has their slug. Of incoming posts with the same slug one stays, the first by ``order``.
    4. With ``reinsert`` the incoming posts are tagged, chunked and put into the
       index at ``layout``, of which only the touched buckets are written.
    5. Feeds of all posts, manifest and review sheet of the incoming ones and, with
       ``cms_manifest``, their CMS records are written under ``path``.
    6. Media that no post refers to any more are listed.

    A dry run changes neither posts nor index and writes nothing but the snapshot.
    The new posts are returned, not written over the old ones. Run twice with
    the same input, the result is the same.
    """
    spark, o = posts.sparkSession, options
    sources = written(incoming.select("source_document").distinct())
    matched, found = _counted(refresh.match_existing(posts, sources))
    if o.backup and found:
        refresh.write_snapshot(matched, f"{path}/snapshots", stamp)
    old_index = buckets.read_index(spark, layout)
    points_found = index.count_for_slugs(old_index, matched.select("slug").distinct()).first()["n_chunks"]

    if o.regenerate:
        ready, issues = normalize_corpus(incoming, assets, rules)
        issues = written(issues)
    else:
        ready, issues = incoming, spark.createDataFrame([], "slug string, issues array<string>")
    records, extracted = _counted(ready)
    fresh = written(index.latest(records, "slug", order or index.slug_order(records)))
    kept = refresh.without_sources(posts, sources) if o.delete_existing else posts
    after = posts if o.dry_run else written(index.upsert(kept, fresh, "slug"))

    rows, failed, produced = None, spark.createDataFrame([], incoming.schema), 0
    if o.reinsert:
        made, failed = index.ingest_posts(layout.deal(fresh), dictionary, one_each=True)
        rows, produced = _counted(made)
    changed = buckets.Change([], 0)
    if not o.dry_run and (rows is not None or o.delete_existing):
        # A post of another source whose slug comes in is replaced, too.
        gone = matched.select("slug").union(fresh.select("slug")) if o.reinsert else matched.select("slug")
        changed = buckets.change_index(spark, layout, rows, gone if o.delete_existing else None, dealt=produced)
    points = produced
    if not o.dry_run:
        points = index.count_for_slugs(buckets.read_index(spark, layout), fresh.select("slug")).first()["n_chunks"]
        _publish_refresh(after, records, issues, path, o)
    orphans = written(validate.orphan_media(assets, after))

    refs = matched.select(F.explode(validate.media_list(F.col("featured_image"), F.col("gallery_images"))).alias("ref"))
    images = refs.agg(F.countDistinct(validate.basename(F.col("ref"))).alias("images_found"))
    report = images.select(
        F.lit(o.dry_run).alias("dry_run"), F.lit(found).alias("posts_found"), "images_found", F.lit(points_found).alias("points_found"),
        F.lit(extracted).alias("posts_extracted"), F.lit(produced).alias("chunks_produced"), F.lit(changed.upserted).alias("points_upserted"),
        F.lit(points).alias("index_points"), after.agg(F.count("*")).scalar().alias("posts_after"),
        issues.where(F.size("issues") > 0).agg(F.count("*")).scalar().alias("missing_metadata"),
        validate.duplicate_slugs(records).agg(F.count("*")).scalar().alias("duplicate_slugs"),
        orphans.agg(F.count("*")).scalar().alias("orphan_images"),
    )
    return Archive(after, records, issues, failed, orphans, changed, report)


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a stored table, and its rows, counted while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return table, seen.get["rows"]


def _publish_refresh(posts: DataFrame, records: DataFrame, issues: DataFrame, path: str, options: RefreshOptions) -> None:
    writers.write_posts_feed(posts, f"{path}/posts", options.base_url)
    writers.write_json_feed(posts, f"{path}/feed", options.title, options.base_url)
    writers.publishing_manifest(records).write.mode("overwrite").json(f"{path}/manifest")
    writers.write_review_csv(writers.review_sheet(records, issues.dropDuplicates(["slug"])), f"{path}/review")
    if options.cms_manifest:
        writers.cms_articles(records).write.mode("overwrite").json(f"{path}/cms_articles")
        writers.cms_media(records).write.mode("overwrite").json(f"{path}/cms_media")


# --- publishing ------------------------------------------------------------------------------

def publish(posts: DataFrame, assets: DataFrame, path: str, *, title: str, base_url: str = "") -> None:
    """Write feeds, manifests, the review sheet and the coverage report under ``path``."""
    writers.write_posts_feed(posts, f"{path}/posts", base_url)
    writers.write_json_feed(posts, f"{path}/feed", title, base_url)
    writers.publishing_manifest(posts).write.mode("overwrite").json(f"{path}/manifest")
    writers.write_review_csv(writers.review_sheet(posts, validate.validate_normalized(posts, assets)), f"{path}/review")
    writers.cms_articles(posts).write.mode("overwrite").json(f"{path}/cms_articles")
    writers.cms_media(posts).write.mode("overwrite").json(f"{path}/cms_media")
    validate.coverage_report(posts).write.mode("overwrite").json(f"{path}/coverage")
    validate.coverage_gaps(posts).write.mode("overwrite").json(f"{path}/coverage_gaps")

