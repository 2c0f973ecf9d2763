"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch has cells that hold how many digests fell there, their exclusive or,
and that of their check values; every digest falls into one cell of each of
three tables. The sketches of two versions subtract cell by cell: what both have
cancels. Cells left with a single digest are peeled off, which may leave others
with a single one. If nothing can be peeled although cells are left, the sketch
was too small for the difference, and the digests are dealt over more sketches.

All of it is DataFrame expressions. Digests, not texts, are compared; texts move
once to meet the beginning of the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.text import let
from scriptorium.llm.common import text_of
from scriptorium.session import written

# A paragraph is a line; longer ones are cut after so many words.
PARAGRAPH_WORDS = 32
TABLES = 3
# Cells of a table; a power of two.
CELLS = 8
ROUNDS = 8
# Digests per sketch of a pair in the second attempt; every further one has half as many.
LOAD = 10
ATTEMPTS = 6

_LONG = "bigint"
_CELLS_TYPE = "array<struct<n:int,key:bigint,chk:bigint>>"
_PURE_TYPE = "array<struct<n:int,key:bigint>>"


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; none for a text without words."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{PARAGRAPH_WORDS - 1}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, table: Column | int) -> Column:
    """The digest's cell within a table: bits of its own for every table."""
    shift = F.lit(table * 6) if isinstance(table, int) else table * 6
    return F.call_function("shiftrightunsigned", key, shift).bitwiseAND(F.lit(CELLS - 1).cast(_LONG))


def _xor(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast(_LONG), lambda s, v: s.bitwiseXOR(of(v)))


def sketch(digests: Column) -> Column:
    """The cells of all tables, one table after the other."""
    def table(t: int) -> Column:
        def cell(j: Column) -> Column:
            return let(
                F.filter(digests, lambda d: _place(d, t) == j),
                lambda hit: F.struct(F.size(hit).alias("n"), _xor(hit, lambda d: d).alias("key"), _xor(hit, _check).alias("chk")),
            )

        return F.transform(F.sequence(F.lit(0).cast(_LONG), F.lit(CELLS - 1).cast(_LONG)), cell)

    return F.concat(*[table(t) for t in range(TABLES)]).cast(_CELLS_TYPE)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b,
        lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")),
    ).cast(_CELLS_TYPE)


def peel(cells: Column) -> Column:
    """``struct(ok, gone, come)``: whether all cells could be emptied, and the digests only the first and only the second had."""
    pure = lambda cs: F.array_distinct(
        F.transform(
            F.filter(cs, lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["chk"])),
            lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key")),
        )
    ).cast(_PURE_TYPE)

    def without(cs: Column, found: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            hit = F.filter(found, lambda f: _place(f["key"], F.floor(i / CELLS).cast("int")) == F.pmod(i, F.lit(CELLS)))
            return let(
                hit,
                lambda h: F.struct(
                    (c["n"] - F.aggregate(h, F.lit(0), lambda s, f: s + f["n"])).alias("n"),
                    c["key"].bitwiseXOR(_xor(h, lambda f: f["key"])).alias("key"),
                    c["chk"].bitwiseXOR(_xor(h, lambda f: _check(f["key"]))).alias("chk"),
                ),
            )

        return F.transform(cs, cell).cast(_CELLS_TYPE)

    def step(state: Column, _: Column) -> Column:
        return let(
            pure(state["cells"]),
            lambda found: F.when(F.size(found) == 0, state).otherwise(
                F.struct(without(state["cells"], found).alias("cells"), F.concat(state["found"], found).cast(_PURE_TYPE).alias("found"))
            ),
        )

    start = F.struct(cells.alias("cells"), F.array().cast(_PURE_TYPE).alias("found"))

    def result(state: Column) -> Column:
        empty = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0))
        side = lambda n: F.size(F.filter(state["found"], lambda f: f["n"] == n))
        return F.struct(empty.alias("ok"), side(1).alias("gone"), side(-1).alias("come"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def _likeness(n_first: Column, peeled: Column) -> Column:
    """Common digests over all digests, 1 for two empty sets; null if peeling failed."""
    share = F.when(n_first + peeled["come"] == 0, 1.0).otherwise((n_first - peeled["gone"]) / (n_first + peeled["come"]))
    return F.when(peeled["ok"], share)


def dealt_likeness(a: Column, b: Column, load: int) -> Column:
    """As comparing two sketches, but over as many as hold about ``load`` digests of both sets each."""
    def parts(n: Column) -> Column:
        def part(i: Column) -> Column:
            mine = lambda ds: F.filter(ds, lambda d: F.pmod(F.shiftrightunsigned(d, 32), n) == i)
            return let(mine(a), lambda x: let(mine(b), lambda y: peel(subtract(sketch(x), sketch(y)))))

        return F.transform(F.sequence(F.lit(0).cast(_LONG), n - 1), part)

    both = F.size(a) + F.size(b)
    n_parts = F.greatest(F.lit(1), F.ceil(both / load)).cast(_LONG)
    total = let(
        let(n_parts, parts),
        lambda ps: F.struct(
            F.forall(ps, lambda p: p["ok"]).alias("ok"),
            F.aggregate(ps, F.lit(0), lambda s, p: s + p["gone"]).alias("gone"),
            F.aggregate(ps, F.lit(0), lambda s, p: s + p["come"]).alias("come"),
        ),
    )
    return let(total, lambda p: _likeness(F.size(a), p))


def exact_likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def printed(cells: Column) -> Column:
    """A sketch as text: count, digests and check values of every cell in hexadecimal digits."""
    def cell(c: Column) -> Column:
        return F.concat(
            F.lpad(F.hex(c["n"].cast(_LONG).bitwiseAND(F.lit(0xFFFF).cast(_LONG))), 4, "0"),
            F.lpad(F.hex(c["key"]), 16, "0"),
            F.lpad(F.hex(c["chk"]), 8, "0"),
        )

    return F.base64(F.unhex(F.array_join(F.transform(cells, cell), "")))


def next_rows(rows: DataFrame) -> DataFrame:
    """For distinct rows ``(rid, th, doc_id, n)`` the row that follows by ``doc_id, th``; the first follows the last.

    Rows are dealt out by ranges; only the first row of every range is compared
    with other ranges.
    """
    dealt = written(rows.repartitionByRange("doc_id", "th").withColumn("part", F.spark_partition_id()))
    row = F.struct("rid", "th", "n")
    own = Window.partitionBy("part").orderBy("doc_id", "th")
    # One row per range.
    firsts = dealt.groupBy("part").agg(F.min_by(row, F.struct("doc_id", "th")).alias("first"))
    parts = Window.orderBy("part")
    after = firsts.select(
        "part",
        F.coalesce(
            F.lead("first").over(parts),
            F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    led = dealt.withColumn("inside", F.lead(row).over(own)).join(after, "part")
    return led.select("rid", "th", "n", F.coalesce("inside", "after").alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The edited text has the last quarter of the code points (rounded down)
    replaced by as many, or all, from the beginning of the next document. The
    next document is that by ascending id, rows of one id by a hash of their
    text, the first after the last; null ids come first. Of rows equal in id and
    text one is followed by the next document, the others by their like.

    Likeness is the share of common paragraphs among all of two texts, found by
    peeling; two texts without words are alike. A null text is empty. Paragraphs
    that a text repeats count once. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("rid"),
        text_of(text_col).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    distinct = written(
        rows.groupBy("rid", "th").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first(F.length("text")).alias("n"))
    )
    chain = written(next_rows(distinct.select("rid", "th", "doc_id", "n")))
    texts = rows.groupBy("rid", "th").agg(F.first("text").alias("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")

    # What a row gives to the one before it: the beginning of its text, and its digests.
    givers = chain.select(
        F.col("rid").alias("to_rid"), F.col("th").alias("to_th"), quarter.alias("wanted"), F.col("next.rid").alias("rid"), F.col("next.th").alias("th")
    )
    given = texts.join(givers, ["rid", "th"]).select(
        F.col("to_rid").alias("rid"), F.col("to_th").alias("th"), F.left("text", "wanted").alias("head"), paragraph_digests(F.col("text")).alias("x")
    )
    alone, like = F.struct(F.lit(False).alias("like"), F.lit(1).cast(_LONG).alias("times")), F.struct(F.lit(True).alias("like"), (F.col("copies") - 1).alias("times"))
    joined = (
        texts.join(distinct, ["rid", "th"])
        .join(given, ["rid", "th"])
        .withColumn("a", paragraph_digests(F.col("text")))
        .withColumn("kind", F.explode(F.when(F.col("copies") > 1, F.array(alone, like)).otherwise(F.array(alone))))
        .withColumn("head", F.when(F.col("kind.like"), F.left("text", quarter)).otherwise(F.col("head")))
        .withColumn("x", F.when(F.col("kind.like"), F.col("a")).otherwise(F.col("x")))
        .withColumn("edited", F.concat(F.left("text", F.col("n") - quarter), "head"))
        .select("doc_id", F.col("kind.times").alias("times"), "n", F.sha2("edited", 256).alias("sha"), "a", paragraph_digests(F.col("edited")).alias("e"), "x")
    )

    def compared(own: Column, other: Column, digests: Column, others: Column) -> Column:
        first = let(peel(subtract(own, other)), lambda p: _likeness(F.size(digests), p))
        return F.coalesce(first, dealt_likeness(digests, others, LOAD))

    a, e, x = F.col("a"), F.col("e"), F.col("x")
    near = let(
        sketch(a),
        lambda sa: let(
            sketch(e),
            lambda se: F.struct(
                printed(sa).alias("fp"), printed(se).alias("efp"),
                compared(sa, se, a, e).alias("edited"), compared(sa, sketch(x), a, x).alias("next"),
            ),
        ),
    )
    failed = F.col("s.edited").isNull() | F.col("s.next").isNull()
    done = written(
        joined.withColumn("s", near).select(
            "doc_id", "times", "n", "sha", "s.fp", "s.efp", F.col("s.edited").alias("near_edited"), F.col("s.next").alias("near_next"),
            *[F.when(failed, F.col(c)).alias(c) for c in ("a", "e", "x")],
        )
    )

    # Larger sketches for what could not be peeled, until all is; at last the sets themselves.
    open_ = F.col("near_edited").isNull() | F.col("near_next").isNull()
    finished, pending = done.where(~open_), done.where(open_)
    for attempt in range(ATTEMPTS + 1):
        if not pending.limit(1).count():
            break
        load = max(1, LOAD >> (attempt + 1))
        again = exact_likeness if attempt == ATTEMPTS else lambda p, q, load=load: dealt_likeness(p, q, load)
        tried = written(pending.withColumns({"near_edited": F.coalesce("near_edited", again(a, e)), "near_next": F.coalesce("near_next", again(a, x))}))
        finished, pending = finished.unionByName(tried.where(~open_)), tried.where(open_)
    return finished.withColumn("copy", F.explode(F.sequence(F.lit(1).cast(_LONG), F.col("times")))).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        F.col("efp").alias("edited_fingerprint"), "near_edited", "near_next",
    )
