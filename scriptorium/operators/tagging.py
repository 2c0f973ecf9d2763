"""Dictionary tagging: which known entities a text names.

A dictionary is a table ``(etype, entry_pos, canonical, alias)`` with one row
per term, the canonical name being one of its own terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.matching import inline_hits, joined_hits, prepare_terms, text_key
from scriptorium.functions.rules import MAX_INLINE_RULES, fits_inline, inline_array

# Entity types in the order in which they are listed everywhere.
ENTITY_TYPES = ["organizations", "programs", "locations", "credentials", "people"]
CLASSIFIER_TYPES = [*ENTITY_TYPES, "activities"]

_HIT_FIELDS = ("etype", "entry_pos", "canonical")


def document_text(*columns: str) -> Column:
    """The given columns in order, blank ones left out, one per line."""
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n")


def tag_entities(
    docs: DataFrame,
    dictionary: DataFrame,
    *,
    text: Column | None = None,
    bounded: bool = False,
    types: list[str] | None = None,
    prefix: str = "entities_",
    max_inline: int = MAX_INLINE_RULES,
) -> DataFrame:
    """Add one sorted array of canonical names per entity type.

    Single-word terms match whole words, other terms match as substrings, case
    is ignored. With ``bounded`` no term may touch a word character, and arrays
    follow dictionary order instead of the alphabet.
    """
    types = types or (CLASSIFIER_TYPES if bounded else ENTITY_TYPES)
    text = document_text("title", "summary", "body") if text is None else text
    if fits_inline(dictionary, max_inline):
        terms = prepare_terms(dictionary.where(F.col("etype").isin(types)), "alias")
        literal = inline_array(terms.orderBy("entry_pos"), *_HIT_FIELDS, "t", "word", "pattern")
        tagged = docs.withColumn("__hits", inline_hits(text, literal, bounded=bounded))
        return _arrays_per_type(tagged, types, prefix, bounded).drop("__hits")
    # Matches come back by text, so documents may share a slug or have none.
    keyed = docs.withColumn("__text", text).withColumn("__key", text_key(F.col("__text")))
    hits = (
        long_tags(keyed, dictionary, key="__key", text="__text", bounded=bounded)
        .groupBy("__key")
        .agg(F.collect_set(F.struct(*_HIT_FIELDS)).alias("__hits"))
    )
    empty = F.array().cast("array<struct<etype:string,entry_pos:int,canonical:string>>")
    joined = keyed.drop("__text").join(hits, "__key", "left").withColumn("__hits", F.coalesce("__hits", empty))
    return _arrays_per_type(joined, types, prefix, bounded).drop("__hits", "__key")


def _arrays_per_type(tagged: DataFrame, types: list[str], prefix: str, in_order: bool) -> DataFrame:
    def names(etype: str) -> Column:
        of_type = F.filter("__hits", lambda h: h["etype"] == etype)
        if in_order:
            pairs = F.array_sort(F.transform(of_type, lambda h: F.struct(h["entry_pos"].alias("p"), h["canonical"].alias("c"))))
            return F.array_distinct(F.transform(pairs, lambda s: s["c"]))
        return F.array_sort(F.array_distinct(F.transform(of_type, lambda h: h["canonical"])))

    return tagged.withColumns({f"{prefix}{etype}": names(etype) for etype in types})


def long_tags(docs: DataFrame, dictionary: DataFrame, *, key: str, text: str, bounded: bool) -> DataFrame:
    """Distinct ``(key, etype, entry_pos, canonical)`` by an equi-join; any dictionary size.

    Rows with the same key share their tags.
    """
    return joined_hits(
        docs,
        [key],
        text,
        dictionary.where(F.trim("alias") != ""),
        list(_HIT_FIELDS),
        "alias",
        mode="bounded" if bounded else "dictionary",
    )


def entity_metadata(names: DataFrame, attributes: DataFrame) -> DataFrame:
    """``names(canonical)`` with the extra attributes known for them, if any."""
    return names.join(attributes, "canonical", "left")


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """Number of terms per entity type."""
    return dictionary.where(F.trim("alias") != "").groupBy("etype").agg(F.count("*").alias("n_terms"))


def mention_counts(index: DataFrame) -> DataFrame:
    """Distinct documents per lower-cased entity name over all entity arrays."""
    arrays = [F.coalesce(F.col(f"entities_{t}"), F.array().cast("array<string>")) for t in ENTITY_TYPES]
    names = F.array_distinct(F.transform(F.concat(*arrays), lambda n: F.lower(n)))
    return (
        index.select("slug", F.explode(names).alias("name"))
        .where("name <> ''")
        .groupBy("name")
        .agg(F.countDistinct(F.when(F.col("slug") != "", F.col("slug"))).alias("n_docs"))
    )


def entities_for_hits(hits: DataFrame) -> DataFrame:
    """``(query_id, etype, name)``: the entities named by the hits of each query."""
    def typed_names(etype: str) -> Column:
        names = F.coalesce(F.col(f"entities_{etype}"), F.array().cast("array<string>"))
        return F.transform(names, lambda n: F.struct(F.lit(etype).alias("etype"), n.alias("name")))

    typed = F.concat(*[typed_names(t) for t in ENTITY_TYPES])
    return hits.select("query_id", F.explode(typed).alias("e")).select("query_id", "e.etype", "e.name").distinct()


def entities_flat(prefix: str = "entities_", types: list[str] | None = None) -> Column:
    """All entity arrays of a row in type order."""
    return F.concat(*[F.col(f"{prefix}{t}") for t in (types or CLASSIFIER_TYPES)])
