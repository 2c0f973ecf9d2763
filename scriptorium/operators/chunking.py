"""Heading-aware, overlapping chunks.

Chunking is one narrow stage: a document is cut, packed and numbered inside its
own row and then exploded, so no text is ever shuffled and the work scales with
the number of input splits. What a task holds at once is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.text import blank, estimate_tokens, let, lines, paragraphs, strip, word_count

NEWS_LIMITS = (700, 100)
# Limits given in words are turned into tokens: int(450 * 1.3), int(50 * 1.3).
KNOWLEDGE_LIMITS = (585, 65)

_HEADING = r"\A(#{1,6})\s+(.*)"


def split_sections(body: Column) -> Column:
    """``array<struct<level, heading, text>>``: one section per heading line.

    Lines before the first heading form a section of level 0.
    """
    def cut(ls: Column) -> Column:
        heads = F.filter(
            F.transform(ls, lambda line, i: F.when(line.startswith("#") & line.rlike(_HEADING), i)),
            lambda i: i.isNotNull(),
        )

        def with_heads(h: Column) -> Column:
            def text_between(first: Column, last: Column) -> Column:
                return strip(F.array_join(F.slice(ls, first + 1, F.greatest(last - first, F.lit(0))), "\n"))

            lead_end = F.coalesce(F.get(h, 0), F.size(ls))
            lead = F.when(
                lead_end > 0,
                F.array(_section(F.lit(0), F.lit(""), text_between(F.lit(0), lead_end))),
            ).otherwise(F.array().cast("array<struct<level:int,heading:string,text:string>>"))
            rest = F.transform(
                h,
                lambda at, k: _section(
                    F.length(F.regexp_extract(F.get(ls, at), _HEADING, 1)),
                    strip(F.regexp_extract(F.get(ls, at), _HEADING, 2)),
                    text_between(at + 1, F.coalesce(F.get(h, k + 1), F.size(ls))),
                ),
            )
            return F.concat(lead, rest)

        return let(heads, with_heads)

    return let(lines(body), cut)


def _section(level: Column, heading: Column, text: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), heading.alias("heading"), text.alias("text"))


def heading_paths(sections: Column, root: Column) -> Column:
    """The headings above and including each section, joined by `` / ``.

    Text before any heading has ``root`` as its path; deeper paths leave it out.
    """
    stack_type = "array<struct<level:int,heading:string>>"
    start = F.struct(F.array().cast(stack_type).alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, s: Column) -> Column:
        open_headings = F.filter(acc["stack"], lambda a: a["level"] < s["level"])
        pushed = F.concat(open_headings, F.array(F.struct(s["level"].alias("level"), s["heading"].alias("heading"))))

        def push(stack: Column) -> Column:
            path = F.array_join(F.transform(stack, lambda a: a["heading"]), " / ")
            return F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(path)).alias("paths"))

        keep = F.struct(acc["stack"].alias("stack"), F.concat(acc["paths"], F.array(root)).alias("paths"))
        return F.when(s["level"] == 0, keep).otherwise(let(pushed, push))

    return F.aggregate(sections, start, step, lambda acc: acc["paths"])


def pack_paragraphs(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Greedy runs of paragraphs as texts; see :func:`pack_bounds` for the rules."""
    return let(
        paragraphs(text),
        lambda ps: F.transform(
            pack_bounds(F.transform(ps, estimate_tokens), max_tokens, overlap_tokens),
            lambda b: F.array_join(F.slice(ps, b["first"] + 1, b["end"] - b["first"]), "\n\n"),
        ),
    )


def pack_bounds(tokens: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """``array<struct<first, end>>`` over token counts of paragraphs, end exclusive.

    A run is closed when the next paragraph would pass ``max_tokens``. The next
    run opens with as many of the last paragraphs as fit ``overlap_tokens`` and
    then takes the new paragraph unchecked. No paragraph is split. Only positions
    are folded, so the state stays small however long the texts are.
    """
    bounds_type = "array<struct<first:int,end:int>>"

    def fold(ts: Column) -> Column:
        start = F.struct(
            F.array().cast(bounds_type).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("tokens")
        )

        def step(acc: Column, i: Column) -> Column:
            size = F.get(ts, i)
            extended = F.struct(
                acc["done"].alias("done"), acc["first"].alias("first"), (acc["tokens"] + size).alias("tokens")
            )

            def reopen(tail: Column) -> Column:
                return F.struct(
                    F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), i.alias("end")))).alias("done"),
                    (i - tail["n"]).alias("first"),
                    (tail["tokens"] + size).alias("tokens"),
                )

            full = (i > acc["first"]) & (acc["tokens"] + size > max_tokens)
            tail = _overlap(F.slice(ts, acc["first"] + 1, i - acc["first"]), overlap_tokens)
            return F.when(full, let(tail, reopen)).otherwise(extended)

        def finish(acc: Column) -> Column:
            last = F.struct(acc["first"].alias("first"), F.size(ts).alias("end"))
            return F.concat(acc["done"], F.array(last))

        positions = F.sequence(F.lit(0), F.size(ts) - 1)
        return F.when(F.size(ts) > 0, F.aggregate(positions, start, step, finish)).otherwise(
            F.array().cast(bounds_type)
        )

    return let(tokens, fold)


def _overlap(tokens: Column, limit: int) -> Column:
    """How many trailing paragraphs fit, up to the first that does not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(True).alias("open"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["open"] & (acc["tokens"] + size <= limit)
        return F.struct(
            F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(fits, acc["tokens"] + size).otherwise(acc["tokens"]).alias("tokens"),
            fits.alias("open"),
        )

    return F.aggregate(F.reverse(tokens), start, step)


def chunk_array(title: Column, summary: Column, body: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """All chunks of one document, in order, as ``array<struct<type, path, text>>``."""
    title, summary = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    intro = F.array_join(F.filter(F.array(title, summary), lambda p: ~blank(p)), "\n\n")

    def piece(kind: str, path: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), path.alias("path"), text.alias("text"))

    none = F.array().cast("array<struct<type:string,path:string,text:string>>")
    first = let(intro, lambda t: F.when(t != "", F.array(piece("summary", title, t))).otherwise(none))

    def pieces_of(sections: Column) -> Column:
        def with_paths(paths: Column) -> Column:
            def of_section(s: Column, k: Column) -> Column:
                opening = F.when(s["level"] > 0, s["heading"]).otherwise(F.lit(""))
                text = F.array_join(F.filter(F.array(opening, s["text"]), lambda p: p != ""), "\n\n")
                return F.transform(
                    pack_paragraphs(text, max_tokens, overlap_tokens),
                    lambda t: piece("body", F.get(paths, k), t),
                )

            return F.flatten(F.transform(sections, of_section))

        return let(heading_paths(sections, title), with_paths)

    return F.concat(first, let(split_sections(body), pieces_of))


def make_chunks(
    posts: DataFrame, max_tokens: int = NEWS_LIMITS[0], overlap_tokens: int = NEWS_LIMITS[1], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Chunks of ``posts(slug, title, summary, body)``; ``keep`` names columns carried along.

    The outer explode keeps the optimizer from deriving a filter on the exploded
    array, which would chunk every document twice.
    """
    pieces = chunk_array(F.col("title"), F.col("summary"), F.col("body"), max_tokens, overlap_tokens)
    return (
        posts.select("slug", *keep, F.posexplode_outer(pieces).alias("chunk_index", "piece"))
        .where("piece IS NOT NULL")
        .select(
            F.concat(F.col("slug"), F.lit("__"), _three_digits(F.col("chunk_index"))).alias("chunk_id"),
            "slug",
            *keep,
            "chunk_index",
            F.col("piece.type").alias("chunk_type"),
            F.col("piece.path").alias("heading_path"),
            F.col("piece.text").alias("chunk_text"),
        )
        .withColumn("word_count", word_count(F.col("chunk_text")))
    )


def _three_digits(n: Column) -> Column:
    """At least three digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))


# Words in a heading path that tell the type of a knowledge chunk.
_FAQ_WORDS = ["faq", "frequently asked", "questions & answers", "q&a"]
_DEFINITION_WORDS = ["definition", "glossary", "terminology", "key terms", "terms"]


def map_chunk_type(chunk_type: Column, heading_path: Column) -> Column:
    """overview, faq, definition or section."""
    path = F.lower(F.coalesce(heading_path, F.lit("")))

    def mentions(words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | path.contains(word)
        return found

    return (
        F.when(chunk_type == "summary", "overview")
        .when(mentions(_FAQ_WORDS), "faq")
        .when(mentions(_DEFINITION_WORDS), "definition")
        .otherwise("section")
    )


# The DNS namespace of RFC 4122.
_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def stable_id(name: Column) -> Column:
    """Version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "utf-8")))

    def layout(h: Column) -> Column:
        variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8
        return F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(F.lower(F.hex(variant.cast("long"))), F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )

    return let(digest, layout)
