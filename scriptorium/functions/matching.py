"""Finding terms in texts.

Two equivalent ways for each kind of match:

* *inline*: the terms ride in the plan as an array literal and every text is
  searched in its own row. No shuffle. For term tables of a checked size.
* *joined*: every place of a text offers short keys that meet the terms in an equi-join,
  so the cost grows with the text and not with text times terms. For term
  tables of any size. Up to a checked number of terms only matches are shuffled; beyond
  it places are, each with a few segments around it. Whole texts never are.

Texts are cut between word characters and other characters into *segments*. A term of
several segments can only occur where its cuts are cuts of the text, so its key is what
stands to the left or right of one of them; a term within one segment has a gram of it as
its key. Of all grams that a term offers it takes the rarest one: the number of terms
that offer the same gram, times how often texts hold it, is least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.functions.text import WORD_CHAR, let, word_list
from scriptorium.session import written

_SEGMENT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
# Characters of a gram within a segment, and beside a cut.
_GRAM = 8
_EDGE = 16
MAX_BROADCAST_TERMS = 200_000
# One of so many texts is looked at for the frequency of grams. That decides how long a join takes, not what it finds.
_SAMPLE = 16


def segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SEGMENT), 0)


def text_key(text: Column) -> Column:
    """Stands for a text in joins. What terms a text holds depends on the text alone, so rows may share it."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def is_word(term: Column) -> Column:
    return term.rlike(rf"\A{WORD_CHAR}+\z")


def guarded_pattern(term: Column) -> Column:
    """A regex for ``term`` with no word character on either side."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit(f"(?<!{WORD_CHAR})"), quoted, F.lit(f"(?!{WORD_CHAR})"))


# --- inline ------------------------------------------------------------------

def prepare_terms(terms: DataFrame, term: str) -> DataFrame:
    """Add what the inline matchers need: ``t`` (lower case), ``word``, ``pattern``."""
    lowered = F.lower(F.col(term))
    return terms.where(F.trim(F.col(term)) != "").select(
        "*", lowered.alias("t"), is_word(lowered).alias("word"), guarded_pattern(lowered).alias("pattern")
    )


def inline_hits(text: Column, terms: Column, *, bounded: bool) -> Column:
    """Those of ``terms`` (structs with t, word, pattern) that occur in ``text``.

    ``bounded`` wants no word character next to any term; otherwise only terms
    that are single words are bounded, and the others match as substrings.
    """
    known_words = F.transform(F.filter(terms, lambda d: d["word"]), lambda d: d["t"])

    def search(lowered: Column) -> Column:
        words = F.array_intersect(word_list(lowered), known_words)

        def keep(found: Column) -> Column:
            def hit(d: Column) -> Column:
                phrase = lowered.contains(d["t"])
                if bounded:
                    phrase = phrase & F.regexp_like(lowered, d["pattern"])
                return F.when(d["word"], F.array_contains(found, d["t"])).otherwise(phrase)

            return F.filter(terms, hit)

        return let(words, keep)

    return let(F.lower(F.coalesce(text, F.lit(""))), search)


def inline_substrings(text: Column, terms: Column) -> Column:
    """Those of ``terms`` (structs with t) contained anywhere in lower-cased ``text``."""
    return let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda lowered: F.filter(terms, lambda d: lowered.contains(d["t"])),
    )


# --- joined ------------------------------------------------------------------

# Keys are whole words, grams inside a segment, and grams to the left and right of a cut.
_WORD, _INSIDE, _LEFT, _RIGHT = "W", "I", "L", "R"


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _offers(term: Column, whole_words: bool) -> Column:
    """The keys a term could have: ``array<struct<kind, g, gram, off>>``; ``off`` characters of the term lie before its place."""
    def offer(kind: str, gram: Column, off: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.length(gram).alias("g"), gram.alias("gram"), off.alias("off"))

    def beside(s: Column, kind: str) -> Column:
        def at(i: Column) -> Column:
            left, right = F.array_join(F.slice(s, F.lit(1), i), ""), F.array_join(F.slice(s, i + 1, F.size(s)), "")
            gram = F.right(left, F.lit(_EDGE)) if kind == _LEFT else F.left(right, F.lit(_EDGE))
            return offer(kind, gram, F.length(left))

        return F.transform(F.sequence(F.lit(1), F.size(s) - 1), at)

    length = F.least(F.lit(_GRAM), F.length(term))
    inside = F.transform(F.sequence(F.lit(1), F.length(term) - length + 1), lambda p: offer(_INSIDE, F.substring(term, p, length), p - 1))
    word = F.array(F.struct(F.lit(_WORD).alias("kind"), F.lit(0).alias("g"), term.alias("gram"), F.lit(0).alias("off")))
    return let(
        segments(term),
        lambda s: F.when((F.size(s) == 1) & is_word(term) & F.lit(whole_words), word)
        .when(F.size(s) == 1, inside)
        .otherwise(F.concat(beside(s, _LEFT), beside(s, _RIGHT))),
    )


# A kind of key, its length, and the largest number of segments that one of its grams touches.
Shape = tuple[str, int, int]


def _shapes(keys: DataFrame) -> list[Shape]:
    """The kinds and lengths of the keys, at most three dozen whatever the number of terms."""
    found = keys.groupBy("__kind", "__g").agg(F.max(F.size(segments(F.col("__gram")))).alias("n"))
    return sorted((r["__kind"], int(r["__g"]), r["n"]) for r in found.collect())


def _places(texts: DataFrame, text_id: list[str], text: str, shapes: list[Shape]) -> DataFrame:
    """``(__x, __i, __p, __kind, __g, __gram)``: what every place of a text offers.

    ``__x`` holds the ids and the segments ``segs`` of the text, ``__i`` counts segments from 0,
    ``__p`` characters of a segment from 1. All of it is generated code without lambdas,
    and no row is copied until something is kept of it.
    """
    def listed(kinds: tuple[str, ...]) -> Column:
        of_kind = [F.struct(F.lit(kind).alias("kind"), F.lit(g).alias("g")) for kind, g, _ in shapes if kind in kinds]
        return F.array(*of_kind) if of_kind else F.array().cast("array<struct<kind:string,g:int>>")

    def deep(kind: str) -> int:
        return max([n for k, _, n in shapes if k == kind], default=0)

    x, i, p = F.col("__x"), F.col("__i"), F.col("__p")
    held = texts.select(F.struct(*text_id, segments(_lowered(F.col(text))).alias("segs")).alias("__x"))
    rows = held.where(F.size("__x.segs") > 0).select("__x", F.explode(F.sequence(F.lit(0), F.size("__x.segs") - 1)).alias("__i"))
    left, right = deep(_LEFT), deep(_RIGHT)
    sides = {
        "__left": F.array_join(F.slice(x["segs"], F.greatest(F.lit(1), i - left + 1), F.least(i, F.lit(left))), ""),
        "__right": F.when(i > 0, F.array_join(F.slice(x["segs"], i + 1, F.lit(right)), "")).otherwise(""),
        "__seg": F.get(x["segs"], i),
    }
    rows = rows.select("__x", "__i", *[side.alias(name) for name, side in sides.items()])
    # Place 0 is the whole segment and the cut before it, the others are its characters.
    last = F.length("__seg") if deep(_INSIDE) else F.lit(0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("__p"))
    shape = F.when(p == 0, listed((_WORD, _LEFT, _RIGHT))).otherwise(listed((_INSIDE,)))
    rows = rows.select("*", F.explode(shape).alias("__shape")).select("*", F.col("__shape.kind").alias("__kind"), F.col("__shape.g").alias("__g"))
    g = F.col("__g")
    gram = (
        F.when(F.col("__kind") == _WORD, F.col("__seg"))
        .when(F.col("__kind") == _LEFT, F.right("__left", g))
        .when(F.col("__kind") == _RIGHT, F.left("__right", g))
        .otherwise(F.substring("__seg", p, g))
    )
    rows = rows.select("__x", "__i", F.greatest(p, F.lit(1)).alias("__p"), "__kind", "__g", gram.alias("__gram"))
    return rows.where((F.col("__kind") == _WORD) | (F.length("__gram") == g))


def _around(segs: Column, i: Column, p: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """What lies before and after a place, with so many whole segments of either side."""
    seg = F.get(segs, i)
    first = F.greatest(F.lit(1), i - before + 1)
    left = F.concat(F.array_join(F.slice(segs, first, i - first + 1), ""), F.left(seg, p - 1))
    return left, F.concat(F.substring(seg, p, F.length(seg)), F.array_join(F.slice(segs, i + 2, after), ""))


def _cut_windows(texts: DataFrame, text_id: list[str], text: str, shapes: list[Shape], reach: int) -> DataFrame:
    """The places of texts as rows that can be sent around: ids, kind, length, gram, and ``reach`` segments on either side."""
    rows = _places(texts, text_id, text, shapes)
    before, after = _around(F.col("__x.segs"), F.col("__i"), F.col("__p"), F.lit(reach), F.lit(reach))
    ids = [F.col("__x")[c].alias(c) for c in text_id]
    return rows.select(*ids, "__kind", F.col("__g").cast("string").alias("__g"), "__gram", before.alias("__before"), after.alias("__after"))


_KEY = ["__kind", "__g", "__gram"]


def _hash() -> Column:
    """Keys meet under a number. What is found under it is compared with the text, so two keys may share one."""
    return F.xxhash64("__kind", F.col("__g").cast("int"), "__gram")


def rarest_keys(texts: DataFrame, text: str, lowered: DataFrame, whole_words: bool) -> DataFrame:
    """``(__t, __kind, __g, __gram, __off)``: the key of each term of ``lowered(__t)``."""
    offers = lowered.select("__t").distinct().select("__t", F.explode(_offers(F.col("__t"), whole_words)).alias("o"))
    offers = written(offers.select("__t", F.col("o.kind").alias("__kind"), F.col("o.g").cast("string").alias("__g"), F.col("o.gram").alias("__gram"), F.col("o.off").alias("__off")))
    shapes = _shapes(offers)
    if not shapes:
        return offers
    grams = written(offers.groupBy(*_KEY).agg(F.countDistinct("__t").alias("terms")).withColumn("__h", _hash()))
    some = texts.select(text).where(F.pmod(F.xxhash64(text), F.lit(_SAMPLE)) == 0)
    known = grams.select("__h").distinct()
    seen = _places(some, [], text, shapes).select(_hash().alias("__h")).join(known, "__h", "left_semi").groupBy("__h").agg(F.count("*").alias("texts"))
    weighed = grams.join(seen, "__h", "left").withColumn("weight", F.col("terms") * (F.coalesce("texts", F.lit(0)) + 1))
    # Of equally rare grams the longer one.
    choice = F.struct("weight", (-F.col("__g").cast("int")).alias("short"), "__kind", "__gram", "__off")
    best = offers.join(weighed.select(*_KEY, "weight"), _KEY).groupBy("__t").agg(F.min_by(F.struct(*_KEY, "__off"), choice).alias("k"))
    return written(best.select("__t", "k.*"))


def joined_hits(
    texts: DataFrame,
    text_id: list[str],
    text: str,
    terms: DataFrame,
    term_id: list[str],
    term: str,
    *,
    mode: str,
) -> DataFrame:
    """Distinct ``(text_id..., term_id...)`` pairs; ``mode`` is substring, dictionary or bounded.

    substring   the term occurs anywhere
    dictionary  single words are bounded, other terms occur anywhere
    bounded     no word character next to the term
    """
    if mode not in ("substring", "dictionary", "bounded"):
        raise ValueError(f"unknown mode {mode!r}")
    lowered = terms.where(F.col(term) != "").select(*term_id, _lowered(F.col(term)).alias("__t"))
    keys = rarest_keys(texts, text, lowered, mode != "substring")
    shapes = _shapes(keys)
    if not shapes:
        fields = texts.select(*text_id).schema.fields + terms.select(*term_id).schema.fields
        return texts.sparkSession.createDataFrame([], T.StructType(fields))
    size = keys.agg(F.max(F.size(segments(F.col("__t")))).alias("m"), F.count("*").alias("n")).first()
    rest = F.expr("substring(__t, __off + 1)")
    bounded = {"substring": F.lit(False), "dictionary": is_word(F.col("__t")), "bounded": F.lit(True)}[mode]
    # The term's two parts, the segments that they touch and, on either side, the one behind them.
    shaped = lowered.join(keys, "__t").select(
        *[F.col(c).alias(f"__id_{n}") for n, c in enumerate(term_id)],
        _hash().alias("__h"),
        F.expr("left(__t, __off)").alias("__head"),
        rest.alias("__tail"),
        F.col("__off").alias("__off"),
        F.length(rest).alias("__rest"),
        (F.size(segments(F.expr("left(__t, __off)"))) + 1).alias("__m"),
        (F.size(segments(rest)) + 1).alias("__n"),
        bounded.alias("__bounded"),
    )
    if size["n"] <= MAX_BROADCAST_TERMS:
        # Terms come to the texts, what surrounds a place is looked at where a key has met.
        met = _places(texts, text_id, text, shapes).withColumn("__h", _hash()).join(F.broadcast(shaped), "__h")
        before, after = _around(F.col("__x.segs"), F.col("__i"), F.col("__p"), F.col("__m"), F.col("__n"))
        ids = [F.col("__x")[c].alias(c) for c in text_id]
    else:
        # Both sides are sorted.
        windows = _cut_windows(texts, text_id, text, shapes, size["m"] + 1).withColumn("__h", _hash())
        met = windows.drop(*_KEY).join(shaped.hint("merge"), "__h")
        before, after = F.col("__before"), F.col("__after")
        ids = [F.col(c) for c in text_id]
    met = met.select(*ids, *[F.col(f"__id_{n}").alias(c) for n, c in enumerate(term_id)], before.alias("__b"), after.alias("__a"), *_TERM)
    placed = (F.expr("right(__b, __off)") == F.col("__head")) & (F.expr("left(__a, __rest)") == F.col("__tail"))
    beside = F.concat(F.when(F.length("__b") > F.col("__off"), F.expr("left(right(__b, __off + 1), 1)")).otherwise(""), F.expr("substring(__a, __rest + 1, 1)"))
    free = ~F.col("__bounded") | ~beside.rlike(WORD_CHAR)
    return met.where(placed & free).select(*text_id, *term_id).distinct()


_TERM = ("__head", "__tail", "__off", "__rest", "__bounded")
