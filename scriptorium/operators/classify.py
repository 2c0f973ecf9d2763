"""Rule-scored categories, subcategories and tags.

Every rule table is small configuration and rides in the plan; a document is
scored inside its own row, so classifying a corpus is one narrow stage.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.matching import inline_hits, joined_hits, prepare_terms, text_key
from scriptorium.functions.rules import MAX_INLINE_RULES, fits_inline, inline_array, inline_nested, inline_strings
from scriptorium.functions.text import let
from scriptorium.operators.tagging import CLASSIFIER_TYPES, entities_flat, tag_entities

# The weight of each kind of signal, and the score a category needs.
DEFAULT_WEIGHTS = {
    "activity": 40, "pattern": 35, "credential": 30, "program": 25, "organization": 15, "location": 8,
    "keyword": 5, "threshold": 45,
}

# Words in a pattern that stand for any entity of a type.
_TYPE_WORDS = {
    "organization": "organizations", "organizations": "organizations",
    "program": "programs", "programs": "programs",
    "location": "locations", "locations": "locations",
    "credential": "credentials", "credentials": "credentials",
    "person": "people", "people": "people",
    "activity": "activities", "activities": "activities",
}

# Entities of these types score with the weight named here.
_TYPE_WEIGHT = {
    "programs": "program", "credentials": "credential", "locations": "location",
    "organizations": "organization", "people": "organization",
}


@dataclass(frozen=True)
class TieBreaker:
    """Lifts ``category`` above the leader where all given conditions hold."""

    category: str
    any_activity: tuple[str, ...] = ()
    no_activity: tuple[str, ...] = ()
    min_organizations: int = 0
    min_credentials: int = 0


# Tie-breakers in the order in which they apply.
DEFAULT_TIE_BREAKERS = (
    TieBreaker("Events & Ceremonies", any_activity=("Graduation",), no_activity=("Media Coverage",)),
    TieBreaker("Partnerships & Agreements", any_activity=("Agreement", "Memorandum of Understanding"), min_organizations=2),
    TieBreaker("Accreditation & Compliance", any_activity=("Accreditation", "Certification", "Endorsement"), min_credentials=1),
)


@dataclass(frozen=True)
class ClassificationRules:
    """Rule tables; see the README for their columns."""

    category_order: DataFrame
    cat_signals: DataFrame
    cat_patterns: DataFrame
    subcat_rules: DataFrame
    keyword_rules: DataFrame
    tag_caps: DataFrame
    thematic_rules: DataFrame
    weights: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    tie_breakers: tuple[TieBreaker, ...] = DEFAULT_TIE_BREAKERS
    allowed_thematic: tuple[str, ...] = ()
    disallowed_tags: tuple[str, ...] = ()
    max_tags: int = 9
    default_category: str = "General"
    default_subcategory: str = "General"


def _entities(etype: str) -> Column:
    return F.col(f"e_{etype}")


def _size_of(etype: Column) -> Column:
    """How many entities of a type, the type being a value."""
    total = F.lit(0)
    for name in CLASSIFIER_TYPES:
        total = F.when(etype == name, F.size(_entities(name))).otherwise(total)
    return total


def _has(kind: Column, value: Column) -> Column:
    """Whether the entities of the type that ``kind`` names hold ``value``."""
    found = F.lit(False)
    for singular, plural in (
        ("activity", "activities"), ("program", "programs"), ("organization", "organizations"),
        ("credential", "credentials"), ("location", "locations"), ("person", "people"),
    ):
        found = F.when(kind == singular, F.array_contains(_entities(plural), value)).otherwise(found)
    return found


def _category_literal(rules: ClassificationRules) -> Column:
    weights = rules.weights
    order = {r["category"]: r["pos"] for r in rules.category_order.collect()}
    signals: dict[str, list] = defaultdict(list)
    for r in rules.cat_signals.collect():
        kind, value = r["kind"], r["value"]
        if kind == "entity_type":
            signals[r["category"]].append({"kind": kind, "value": value, "w": weights[_TYPE_WEIGHT[value]]})
        else:
            signals[r["category"]].append({"kind": kind, "value": value, "w": weights[kind]})
    patterns: dict[str, dict] = defaultdict(lambda: defaultdict(list))
    for r in rules.cat_patterns.collect():
        as_type = _TYPE_WORDS.get(r["element"].lower())
        patterns[r["category"]][r["pattern_id"]].append({"etype": as_type, "name": r["element"]})
    labels = list(dict.fromkeys([*order, *signals, *patterns, *[t.category for t in rules.tie_breakers]]))
    rows = [
        {
            "category": label,
            "pos": order.get(label),
            "signals": signals.get(label, []),
            "patterns": [{"elements": e} for e in patterns.get(label, {}).values()],
        }
        for label in labels
    ]
    return inline_nested(
        rows,
        "array<struct<category:string,pos:int,"
        "signals:array<struct<kind:string,value:string,w:int>>,"
        "patterns:array<struct<elements:array<struct<etype:string,name:string>>>>>>",
    )


def score_categories(docs: DataFrame, rules: ClassificationRules) -> DataFrame:
    """Add ``scores``: ``array<struct<category, pos, score>>`` from entity signals and patterns.

    Needs the arrays ``e_organizations`` ... ``e_activities``.
    """
    pattern_weight = rules.weights["pattern"]
    everything = entities_flat("e_")

    def signal_score(s: Column) -> Column:
        count = F.when(s["kind"] == "entity_type", _size_of(s["value"])).otherwise(
            _has(s["kind"], s["value"]).cast("int")
        )
        return count * s["w"]

    def pattern_holds(p: Column, names: Column) -> Column:
        return F.forall(
            p["elements"],
            lambda e: F.when(e["etype"].isNotNull(), _size_of(e["etype"]) > 0).otherwise(
                F.array_contains(names, e["name"])
            ),
        )

    def score(c: Column, names: Column) -> Column:
        from_signals = F.aggregate(c["signals"], F.lit(0), lambda acc, s: acc + signal_score(s))
        from_patterns = F.size(F.filter(c["patterns"], lambda p: pattern_holds(p, names))) * pattern_weight
        return F.struct(c["category"].alias("category"), c["pos"].alias("pos"), (from_signals + from_patterns).alias("score"))

    literal = _category_literal(rules)
    return docs.withColumn("scores", let(everything, lambda names: F.transform(literal, lambda c: score(c, names))))


def apply_tie_breakers(docs: DataFrame, rules: ClassificationRules) -> DataFrame:
    """Bump categories in ``scores`` one tie-breaker after the other."""
    threshold = rules.weights["threshold"]
    for breaker in rules.tie_breakers:
        holds = (F.size("e_organizations") >= breaker.min_organizations) & (
            F.size("e_credentials") >= breaker.min_credentials
        )
        if breaker.any_activity:
            holds = holds & F.arrays_overlap("e_activities", inline_strings(list(breaker.any_activity)))
        if breaker.no_activity:
            holds = holds & ~F.arrays_overlap("e_activities", inline_strings(list(breaker.no_activity)))

        docs = docs.withColumn("scores", F.when(holds, _bump(breaker.category, threshold)).otherwise(F.col("scores")))
    return docs


def _bump(category: str, threshold: int) -> Column:
    """``scores`` with one category lifted above the leader and the threshold."""
    leader = F.greatest(F.array_max(F.transform("scores", lambda s: s["score"])), F.lit(threshold))

    def lift(top: Column) -> Column:
        return F.transform(
            "scores",
            lambda s: F.when(
                s["category"] == category, s.withField("score", F.greatest(s["score"], top + 1))
            ).otherwise(s),
        )

    return let(leader, lift)


def score_keywords(
    docs: DataFrame, rules: ClassificationRules, *, text: Column, max_inline: int = MAX_INLINE_RULES
) -> DataFrame:
    """Add ``keyword_hits``: the category of every keyword that stands alone in the text, sorted; a repeated rule counts once."""
    keywords = rules.keyword_rules.select("category", "keyword").distinct()
    if fits_inline(keywords, max_inline):
        literal = inline_array(prepare_terms(keywords, "keyword"), "category", "t", "word", "pattern")
        hits = inline_hits(text, literal, bounded=True)
        return docs.withColumn("keyword_hits", F.array_sort(F.transform(hits, lambda h: h["category"])))
    # Matches come back by text, so documents may share a slug or have none.
    keyed = docs.withColumn("__key", text_key(text))
    pairs = joined_hits(
        keyed.select("__key", text.alias("__text")), ["__key"], "__text", keywords.where(F.trim("keyword") != ""), ["category", "keyword"], "keyword", mode="bounded"
    )
    found = pairs.groupBy("__key").agg(F.array_sort(F.collect_list("category")).alias("keyword_hits"))
    return (
        keyed.join(found, "__key", "left")
        .withColumn("keyword_hits", F.coalesce("keyword_hits", F.array().cast("array<string>")))
        .drop("__key")
    )


def pick_category(docs: DataFrame, rules: ClassificationRules) -> DataFrame:
    """Add ``category``, ``entity_score``, ``keyword_score``, ``used_fallback`` and ``source``.

    The best entity score wins, earlier categories first on ties. Only where no
    category has any entity score, the first category with a keyword is taken.
    """
    order = inline_array(rules.category_order.orderBy("pos"), "category", "pos")
    threshold, keyword_weight = rules.weights["threshold"], rules.weights["keyword"]
    ranked = F.filter("scores", lambda s: s["pos"].isNotNull() & (s["score"] > 0))
    best = F.array_max(
        F.transform(ranked, lambda s: F.struct(s["score"].alias("score"), (-s["pos"]).alias("rank"), s["category"].alias("category")))
    )
    by_keyword = F.get(F.filter(order, lambda o: F.array_contains(F.col("keyword_hits"), o["category"])), 0)["category"]
    return (
        docs.withColumn("__best", best)
        .withColumn("__keyword", F.when(F.col("__best").isNull(), by_keyword))
        .withColumn("category", F.coalesce("__best.category", "__keyword", F.lit(rules.default_category)))
        .withColumn("used_fallback", F.col("__keyword").isNotNull())
        .withColumn(
            "entity_score",
            F.coalesce(F.array_max(F.transform(F.filter("scores", lambda s: s["category"] == F.col("category")), lambda s: s["score"])), F.lit(0)),
        )
        .withColumn(
            "keyword_score",
            F.size(F.filter("keyword_hits", lambda c: c == F.col("category"))) * keyword_weight,
        )
        .withColumn(
            "source",
            F.when(F.col("entity_score") >= threshold, F.when(F.col("keyword_score") > 0, "hybrid").otherwise("entity_match"))
            .when(F.col("used_fallback"), "keyword_fallback")
            .when(F.col("entity_score") > 0, "entity_match")
            .otherwise("default"),
        )
        .drop("__best", "__keyword")
    )


def resolve_subcategory(docs: DataFrame, rules: ClassificationRules) -> DataFrame:
    """Add ``subcategory`` and ``subcategory_matched``: the first rule whose conditions all hold."""
    grouped: dict[tuple, dict] = {}
    for r in rules.subcat_rules.orderBy("rule_pos").collect():
        row = grouped.setdefault(
            (r["rule_pos"],), {"category": r["category"], "subcategory": r["subcategory"], "conditions": defaultdict(list)}
        )
        if r["cond_kind"]:
            row["conditions"][r["cond_kind"]].append(r["value"])
    rows = [
        {**row, "conditions": [{"kind": k, "anyof": v} for k, v in row["conditions"].items()]} for row in grouped.values()
    ]
    literal = inline_nested(
        rows,
        "array<struct<category:string,subcategory:string,conditions:array<struct<kind:string,anyof:array<string>>>>>",
    )

    def holds(rule: Column) -> Column:
        conditions = F.forall(rule["conditions"], lambda c: F.exists(c["anyof"], lambda v: _has(c["kind"], v)))
        return (rule["category"] == F.col("category")) & conditions

    first = F.get(F.filter(literal, holds), 0)["subcategory"]
    return docs.withColumn("__sub", first).select(
        "*",
        F.coalesce("__sub", F.lit(rules.default_subcategory)).alias("subcategory"),
        F.col("__sub").isNotNull().alias("subcategory_matched"),
    ).drop("__sub")


def confidence(docs: DataFrame) -> DataFrame:
    """Add ``category_score``, ``subcategory_score`` and ``entity_extraction_score``."""
    category = F.least(F.lit(100), F.col("entity_score") + F.when(F.col("used_fallback"), F.col("keyword_score")).otherwise(0))
    present = sum((F.when(F.size(_entities(t)) > 0, 1).otherwise(0) for t in CLASSIFIER_TYPES), F.lit(0))
    return (
        docs.withColumn("category_score", category.cast("int"))
        .withColumn(
            "subcategory_score",
            F.when(F.col("subcategory_matched"), F.least(F.lit(100), _round_half_up(F.col("category_score") * F.lit(0.85).cast("double"))))
            .otherwise(F.least(F.lit(40), F.col("category_score"))),
        )
        .withColumn("entity_extraction_score", _round_half_up(present / F.lit(6) * 100))
    )


def _round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def generate_tags(docs: DataFrame, rules: ClassificationRules, *, text: Column) -> DataFrame:
    """Add ``class_tags``: capped entities by type, then thematic tags, at most ``max_tags``."""
    caps = {r["etype"]: r["max_per_doc"] for r in rules.tag_caps.collect()}
    disallowed = inline_strings([t.lower() for t in rules.disallowed_tags])
    by_type = []
    # Types contribute tags in this order.
    for etype in ("organizations", "programs", "credentials", "locations", "activities", "people"):
        names = _entities(etype)
        if etype in caps:
            names = F.slice(names, 1, caps[etype])
        by_type.append(F.filter(names, lambda n: ~F.array_contains(disallowed, F.lower(n))))
    themes = inline_array(rules.thematic_rules.orderBy("thematic_pos"), "tag", "cond_kind", "value")
    allowed = inline_strings(list(rules.allowed_thematic))

    def thematic(lowered: Column) -> Column:
        def applies(rule: Column) -> Column:
            condition = (
                F.when(rule["cond_kind"] == "category", rule["value"] == F.col("category"))
                .when(rule["cond_kind"] == "text", lowered.contains(rule["value"]))
                .otherwise(_has(rule["cond_kind"], rule["value"]))
            )
            return F.array_contains(allowed, rule["tag"]) & condition

        return F.transform(F.filter(themes, applies), lambda r: r["tag"])

    tags = F.concat(*by_type, let(F.lower(text), thematic))
    return docs.withColumn("class_tags", F.slice(F.array_distinct(tags), 1, rules.max_tags))


def classify_corpus(posts: DataFrame, dictionary: DataFrame, rules: ClassificationRules) -> DataFrame:
    """Entities, category, subcategory, confidence and tags of every post."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.trim(F.coalesce("body", F.lit(""))))
    docs = posts.drop("category")
    docs = tag_entities(docs, dictionary, text=text, bounded=True, prefix="e_")
    docs = score_keywords(docs, rules, text=text)
    docs = apply_tie_breakers(score_categories(docs, rules), rules)
    docs = resolve_subcategory(pick_category(docs, rules), rules)
    return generate_tags(confidence(docs), rules, text=text)


def classification_counts(classified: DataFrame) -> DataFrame:
    """``(kind, name, n)``: how many posts per category and per classification source."""
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")),
    )
    return (
        classified.select(F.explode(kinds).alias("k"))
        .groupBy("k.kind", "k.name")
        .agg(F.count("*").alias("n"))
    )
