"""Language identification by prediction by partial matching.

One byte context tree per language. A byte not seen in a context escapes to the
next shorter one at the cost of the escape probability, down to uniform bytes.
The statistics are frozen after training, so the code length of a text under a
language is a sum over its bytes; the language with the shortest code wins.
"""

from __future__ import annotations

import sys
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import blocks, fold, share, shared, text_of
from scriptorium.llm.context_tree import BOUNDARY, ContextTree, GramCounter, build_tree, chunks, grams, stream_of
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

ORDER = 4
# Learned from about so many documents of a language, chosen by a hash of their text.
DOCS_PER_LANGUAGE = 2000
# Contexts seen less often are left out of a tree; with MAX_CONTEXTS this bounds the model.
MIN_COUNT = 8
MAX_CONTEXTS = 6000
UNKNOWN = "und"

_WHITE = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _streams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Streams of bounded size and where their boundaries are; white space is one kind."""
    for _, _, offsets, data in blocks(texts, 1 << 21):
        raw = data.tobytes().translate(_WHITE)
        stream = stream_of([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        yield stream, np.flatnonzero(stream == BOUNDARY)


def fit_languages(
    texts: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    per_language: int = DOCS_PER_LANGUAGE,
    min_count: int = MIN_COUNT,
    max_contexts: int = MAX_CONTEXTS,
) -> dict[str, ContextTree]:
    """A tree for every language among ``texts``; rows with a null text or language are not learned from.

    A bounded sample: texts whose hash falls under ``per_language`` over the
    language's number of documents, all of a language with fewer. Grams are
    counted where the texts are, and only counts of the ``max_contexts`` most
    frequent contexts of a language reach the driver.
    """
    known = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    # One row per language.
    sample = known.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, GramCounter] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = batch.column(1).filter(pa.array(langs == lang))
                for stream, _ in _streams(own):
                    packed = grams(stream, order)
                    counters.setdefault(lang, GramCounter()).add(packed[stream[1:] != BOUNDARY])
        for lang, counter in counters.items():
            for keys, counts in chunks(*counter.merge()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(work, "lang string, gram long, n long")
    context = F.shiftright("gram", 8)
    suffixes = F.transform(
        F.sequence(F.lit(0), F.lit(order)),
        lambda d: F.struct(d.alias("d"), context.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), d * 8) - 1).alias("context")),
    )
    length = F.when(context == 0, 0).otherwise(F.floor(F.length(F.hex(context)) / 2 + 0.5)).cast("int")
    rows = written(
        counted.select("lang", F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n", F.explode(F.slice(suffixes, F.lit(1), length + 1)).alias("s"))
        .groupBy("lang", "s.d", "s.context", "symbol")
        .agg(F.sum("n").alias("n"))
    )
    totals = rows.groupBy("lang", "d", "context").agg(F.sum("n").alias("total"))
    trees = {}
    for lang in sorted(r["lang"] for r in rows.select("lang").distinct().collect()):
        own = totals.where(F.col("lang") == lang)
        # A context is at least as frequent as any longer one that ends with it, so suffixes are kept, ties by length.
        kept = own.where((F.col("total") >= min_count) | (F.col("d") == 0)).orderBy(F.desc("total"), "d", "context").limit(max_contexts)
        table = rows.where(F.col("lang") == lang).join(F.broadcast(kept.select("d", "context")), ["d", "context"]).select("d", "context", "symbol", "n").toArrow()
        d, contexts, symbols, counts = (table.column(i).to_numpy() for i in range(4))
        trees[lang] = build_tree(d, contexts, symbols.astype(np.uint8), counts.astype(np.float64), depth=order, alphabet=256, blend=False)
    return trees


def identify_languages(
    docs: DataFrame, trees: dict[str, ContextTree], id_col: str = "doc_id", text_col: str = "text", folds: int = 5
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, in one narrow stage.

    ``score`` is the posterior probability of the language under equal priors.
    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if no language was learned. Ties go to the first language in
    alphabetical order. Whole texts are read, ids only copied, other columns
    ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = share(docs.sparkSession, trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared(sent)
        names = sorted(models)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for stream, at in _streams(batch.column(3)):
                lengths = []
                for name in names:
                    costs = models[name].costs(stream)
                    costs[at[1:] - 1] = 0  # the end of a text is not part of it
                    sums = np.concatenate(([0.0], np.cumsum(costs, dtype=np.float64)))
                    lengths.append(sums[at[1:]] - sums[at[:-1]])
                if not names:
                    langs += [UNKNOWN] * (len(at) - 1)
                    scores += [0.0] * (len(at) - 1)
                    continue
                bits = np.stack(lengths, axis=1)
                least = bits.argmin(axis=1)
                weight = np.exp(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000) * math.log(2))
                langs += [names[i] for i in least]
                scores += (1.0 / weight.sum(axis=1)).tolist()
            letters = batch.column(2).to_pylist()
            langs = [lang if letter else UNKNOWN for lang, letter in zip(langs, letters, strict=True)]
            scores = [score if letter and lang != UNKNOWN else 0.0 for score, lang, letter in zip(scores, langs, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold(id_col, folds) == 0).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"), text_of(text_col).alias("text"),
    )
    return rows.mapInArrow(work, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
