"""Language-model scores from a probabilistic suffix tree, next to a unigram baseline.

Contexts are the last one, two or three words, whatever words they are. A
context becomes a state if its next-symbol distribution diverges from that of
its longest state among the shorter suffixes: told by every occurrence with
that occurrence left out, so a context seen once says nothing and two copies of
a rare passage say much. Distributions are smoothed with those of the suffix.
Symbols are the frequent words, the end of a text, and one for all other words;
a token is scored in the longest state before it, times the share that its word
has of its symbol in the unigram model, so tree and baseline are distributions
over the same tokens, all unknown words being one of them.

All suffixes of a context share its last word, so the tree falls apart into
branches, one per last word, that are counted, tested and asked apart: tokens
travel to the branches and bring back what they gain. A last word with more
tokens than a group should have is split by the word before it; each part gets
the word's own distribution, which is counted beforehand. Nothing of the tree
is held anywhere as a whole, and it grows with the corpus.

The unigram model needs the corpus count of every word. Frequent words ride
along as a table of bounded size; all others are joined.
"""

from __future__ import annotations

import sys
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import blocks, fold, share, shared, text_of
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

# Longest context, in words.
DEPTH = 3
# Occurrences that a state needs, and how many nats its distribution must save over its suffix's.
MIN_COUNT = 2
KEEP = 4.0
# A group of branches has about so many tokens; a task takes about so many groups, one after the other.
GROUP_TOKENS = 1 << 18
GROUPS_PER_TASK = 4
# Pairs of a split word and what follows it that a task counts before it sends them on.
COUNTED_PAIRS = 1_000_000
# Bounds the table of frequent words that is sent to the executors.
MAX_WORDS = 131_072
MAX_WORD_BYTES = 64


@dataclass
class Branches:
    """What every task knows of the model: symbols, their unigram probabilities, and where contexts go.

    Symbols count up from the most frequent word; the last but one stands for
    all other words, the last for the end. As part of a context, a word that is
    no symbol has a number of its own, beyond all symbols.
    """

    code: dict[bytes, int]
    root: np.ndarray
    groups: int
    # Symbols whose branch is split, sorted, and into how many parts.
    split: np.ndarray
    parts: np.ndarray
    depth: int = DEPTH
    min_count: int = MIN_COUNT
    keep: float = KEEP

    @property
    def end(self) -> int:
        return len(self.root) - 1

    def tokens(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, symbol, before)`` of every token; ``before[d - 1]`` is the word ``d`` back, -1 beyond the text's beginning."""
        get, other = self.code.get, self.end - 1
        sent, flat = [b""], [self.end]
        for words in lists:
            sent += words
            flat.extend(map(get, words, repeat(-1)))
            sent.append(b"")
            flat.append(self.end)
        stream = np.array(flat, np.int64)
        unknown = np.flatnonzero(stream < 0)
        stream[unknown] = [_BEYOND | xxhash.xxh3_64_intdigest(sent[i]) >> 2 for i in unknown.tolist()]
        n = len(stream) - 1
        padded = np.concatenate((np.full(self.depth, self.end, np.int64), stream))
        before = np.empty((self.depth, n), np.int64)
        alive = np.ones(n, bool)
        for d in range(1, self.depth + 1):
            word = padded[self.depth + 1 - d : self.depth + 1 - d + n]
            before[d - 1] = np.where(alive, word, -1)
            alive &= word != self.end
        symbol = np.where(stream[1:] > self.end, other, stream[1:]).astype(np.int32)
        return np.repeat(np.arange(len(lists)), [len(words) + 1 for words in lists]), symbol, before

    def group(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The group that has the branch of every token."""
        home = _mixed(before[0])
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, before[0]), len(self.split) - 1)
            parts = np.where(self.split[at] == before[0], self.parts[at], 1).astype(np.uint64)
            # Behind the beginning there are no longer contexts to keep together.
            by = before[1] if self.depth > 1 else np.full(len(symbol), -1)
            home = home + _mixed(np.where(by < 0, symbol, by)) % parts
        return (home % np.uint64(self.groups)).astype(np.int64)

    def bucket(self, word: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where pairs of a split word and the symbol behind it are added up."""
        parts = self.parts[np.searchsorted(self.split, word)].astype(np.uint64)
        home = _mixed(word) + _mixed(symbol) % parts
        return (home % np.uint64(self.groups // GROUPS_PER_TASK + 1)).astype(np.int64)

    def gains(self, symbol: np.ndarray, before: np.ndarray, times: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of every token's probability in its state over that in the unigram model.

        ``times`` says how often the token occurs in training texts, 0 for held-out ones.
        ``known`` has the distributions of split words: ``(word, symbol, n)``.
        """
        word, follower, n = known
        probability = self.root[symbol]
        # At the first level the counted distribution of a split word takes the place of the tokens here.
        first = _deeper(
            np.concatenate((before[0], word)), np.concatenate((symbol, follower)),
            np.concatenate((np.where(np.isin(before[0], self.split), 0, times), n)),
            np.concatenate((probability, self.root[follower])), self.min_count, self.keep,
        )
        probability, key = first[: len(symbol)], _mixed(before[0])
        for d in range(1, self.depth):
            key = _mixed(key ^ before[d].astype(np.uint64))
            at = np.flatnonzero(before[d] >= 0)
            if len(at):
                probability[at] = _deeper(key[at], symbol[at], times[at], probability[at], self.min_count, self.keep)
        return np.log10(probability / self.root[symbol])


# Numbers of words that are no symbols have this bit.
_BEYOND = 1 << 62


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _deeper(context: np.ndarray, symbol: np.ndarray, times: np.ndarray, below: np.ndarray, min_count: int, keep: float) -> np.ndarray:
    """The probability of every token one level deeper: that of its context if this diverges from ``below``, else ``below``."""
    if not len(context):
        return below
    order = np.lexsort((symbol, context))
    new_context = np.concatenate(([True], np.diff(context[order]) != 0))
    new_pair = new_context | np.concatenate(([True], np.diff(symbol[order]) != 0))
    pairs = np.flatnonzero(new_pair)
    n = np.add.reduceat(times[order].astype(np.int64), pairs).astype(np.float64)
    suffix = below[order][pairs]
    contexts = np.flatnonzero(new_context[pairs])
    of_pair = np.cumsum(new_context[pairs]) - 1
    seen = np.add.reduceat(n, contexts)
    distinct = np.maximum(np.add.reduceat((n > 0).astype(np.float64), contexts), 1)
    # Every occurrence as foretold by the others.
    others = (np.maximum(n - 1, 0) + distinct[of_pair] * suffix) / (np.maximum(seen - 1, 0) + distinct)[of_pair]
    divergence = np.add.reduceat(n * np.log(others / suffix), contexts)
    kept = (seen >= min_count) & (divergence > keep)
    smoothed = (n + distinct[of_pair] * suffix) / (seen + distinct)[of_pair]
    out = np.empty(len(context))
    out[order] = np.where(kept[of_pair], smoothed, suffix)[np.cumsum(new_pair) - 1]
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, bytes of equal weight side by side, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, *types: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _token_lists(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of every text, A-Z lower-cased, in runs of bounded size."""
    for _, _, offsets, data in blocks(texts):
        raw = data.tobytes().lower()
        yield [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)``, counted per task first; the end of a text is the empty word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        words: Counter = Counter()
        for batch in batches:
            for lists in _token_lists(batch.column(0)):
                for ws in lists:
                    words.update(ws)
                words[b""] += len(lists)
                if len(words) > 400_000:
                    yield rows(words)
                    words = Counter()
        yield rows(words)

    return texts.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _frequent(words: DataFrame, limit: int) -> dict[bytes, int]:
    """The most frequent words, as many whole classes of equal (rounded) frequency as ``limit`` allows."""
    rank = F.floor(F.log2("n") * 4).cast("int")
    short = words.where(F.octet_length("word").between(1, MAX_WORD_BYTES))
    held, least = 0, None
    for row in sorted(short.groupBy(rank.alias("r")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["r"]):
        held += row["k"]
        if held > limit:
            break
        least = row["r"]
    if least is None:
        return {}
    table = short.where(rank >= least).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))


def plan_branches(
    frequent: dict[bytes, int],
    ends: int,
    total: int,
    kinds: int,
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    keep: float = KEEP,
    group_tokens: int = GROUP_TOKENS,
) -> Branches:
    """Symbols and groups from the unigram counts: ``total`` tokens of ``kinds`` kinds."""
    first = sorted(frequent.items(), key=lambda item: (-item[1], item[0]))
    counts = np.array([n for _, n in first] + [0, ends], np.float64)
    root = (counts + 1) / (total + kinds + 1)
    root[-2] = max(1 - root.sum() + root[-2], 1e-12)
    split = np.flatnonzero(counts > group_tokens)
    groups = total // group_tokens + 1
    parts = np.minimum(np.ceil(counts[split] / group_tokens), groups).astype(np.int64)
    return Branches({word: i for i, (word, _) in enumerate(first)}, root, groups, split, parts, depth, min_count, keep)


def _text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


_PARCEL = "group_ long, run long, kind int, data binary"
# Kinds of parcels: tokens of a run for a group, the keys of a run's texts, the distribution of a split word, gains of a run's texts.
_TOKENS, _KEYS, _KNOWN, _GAINS = range(4)


def _parcels(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["group_", "run", "kind", "data"])


def _counted_pairs(training: DataFrame, model: Branches, sent: Broadcast) -> DataFrame:
    """``(bucket, data)``: what follows the split words in the texts of a task, one row for every bucket.

    A bucket gets the pairs of as many tokens as a task of branches at most, so there
    are as few rows as that allows; a row never has less than one pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        empty = np.zeros(0, np.int64)
        pairs, n, pending, waiting = empty, empty, [], 0

        def rows() -> pa.RecordBatch:
            word, symbol = pairs // len(model.root), pairs % len(model.root)
            bucket = model.bucket(word, symbol)
            order = np.argsort(bucket, kind="stable")
            bounds = np.concatenate((np.flatnonzero(np.diff(bucket[order], prepend=-1)), [len(order)])).tolist()
            found, data = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                at = order[low:high]
                found.append(int(bucket[at[0]]))
                data.append(_packed(word[at].astype(np.int32), symbol[at].astype(np.int32), n[at]))
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate((pairs, *pending)), return_inverse=True)
            times = np.concatenate((n, np.ones(waiting, np.int64)))
            return found, np.bincount(place, times, len(found)).astype(np.int64)

        # Counted over the runs of a task, as far as COUNTED_PAIRS bounds them.
        for batch in batches:
            for lists in _token_lists(batch.column(0)):
                _, symbol, before = model.tokens(lists)
                at = np.isin(before[0], model.split)
                pending.append(before[0][at] * len(model.root) + symbol[at])
                waiting += len(pending[-1])
                if waiting > COUNTED_PAIRS:
                    (pairs, n), pending, waiting = merged(), [], 0
                    if len(pairs) > COUNTED_PAIRS:
                        yield rows()
                        pairs, n = empty, empty
        pairs, n = merged()
        yield rows()

    return training.mapInArrow(count, "bucket long, data binary")


def _split_words(training: DataFrame, model: Branches, sent: Broadcast, sent_bare: Broadcast) -> DataFrame:
    """Parcels with the distributions of the split words, one for every part; ``sent_bare`` is the model without its words."""

    def add(table: pa.Table) -> pa.Table:
        packed = [_unpacked(data, np.int32, np.int32, np.int64) for data in table.column("data").to_pylist()]
        word, symbol, n = (np.concatenate(x) for x in zip(*packed, strict=True))
        packed.clear()
        order = np.lexsort((symbol, word))
        word, symbol, n = word[order], symbol[order], n[order]
        pairs = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(symbol, prepend=-1) != 0))
        n, word, symbol = np.add.reduceat(n, pairs), word[pairs], symbol[pairs]
        bounds = np.concatenate((np.flatnonzero(np.diff(word, prepend=-1)), [len(word)])).tolist()
        data = [_packed(symbol[a:b], n[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"word": pa.array(word[bounds[:-1]].astype(np.int64)), "data": pa.array(data, pa.binary())})

    def parcel(table: pa.Table) -> pa.Table:
        model = shared(sent_bare)
        word = table.column("word")[0].as_py()
        symbol, n = (np.concatenate(x) for x in zip(*(_unpacked(data, np.int32, np.int64) for data in table.column("data").to_pylist()), strict=True))
        data = _packed(np.full(len(symbol), word, np.int64), symbol, n)
        home = int(_mixed(np.array([word]))[0])
        parts = int(model.parts[np.searchsorted(model.split, word)])
        # Wraps around as the sum of 64 bits in Branches.group does.
        return pa.Table.from_batches([_parcels([((home + j) % (1 << 64) % model.groups, 0, _KNOWN, data) for j in range(parts)])])

    added = _counted_pairs(training, model, sent).groupBy("bucket").applyInArrow(add, "word long, data binary")
    # One group per split word, with a row per bucket and a number per symbol at most.
    return added.groupBy("word").applyInArrow(parcel, _PARCEL)


def tree_gains(rows: DataFrame, model: Branches) -> DataFrame:
    """``(key, gain)`` for every distinct sequence of words in ``rows`` (``held_out, text``): log10 of the tree's over the unigram probability."""
    spark = rows.sparkSession
    sent = share(spark, model)
    # Branches ask by number; the words would only fill memory there.
    sent_bare = share(spark, replace(model, code={}))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            held, done = batch.column(0).to_numpy(zero_copy_only=False), 0
            for lists in _token_lists(batch.column(1)):
                # Copies within a run travel once.
                texts: dict[bytes, list] = {}
                for words, held_out in zip(lists, held[done : done + len(lists)], strict=True):
                    texts.setdefault(_text_key(words), [words, 0])[1] += not held_out
                done += len(lists)
                text, symbol, before = model.tokens([words for words, _ in texts.values()])
                times = np.array([n for _, n in texts.values()], np.int64)
                group = model.group(symbol, before)
                order = np.argsort(group, kind="stable")
                bounds = np.concatenate((np.flatnonzero(np.diff(group[order], prepend=-1)), [len(order)])).tolist()
                out = [(run % model.groups, run, _KEYS, b"".join(texts))]
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    at = order[low:high]
                    step = np.diff(text[at], prepend=0).astype(np.uint32)
                    data = _packed(step, times[text[at]].astype(np.int32), symbol[at], *before[:, at])
                    out.append((int(group[at[0]]), run, _TOKENS, data))
                yield _parcels(out)
                run += 1

    def ask(table: pa.Table) -> pa.Table:
        model = shared(sent_bare)
        out, owners, tokens, known = [], [], [], [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for run, kind, data in zip(*(table.column(c).to_pylist() for c in ("run", "kind", "data")), strict=True):
            if kind == _KEYS:
                out.append((0, run, _KEYS, data))
            elif kind == _KNOWN:
                known.append(_unpacked(data, np.int64, np.int32, np.int64))
            else:
                step, *rest = _unpacked(data, np.uint32, np.int32, np.int32, *[np.int64] * model.depth)
                owners.append((run, np.cumsum(step, dtype=np.int64)))
                tokens.append(rest)
        if tokens:
            times, symbol = (np.concatenate([x[i] for x in tokens]) for i in range(2))
            before = np.stack([np.concatenate([x[2 + d] for x in tokens]) for d in range(model.depth)])
            tokens.clear()
            gains = model.gains(symbol, before, times, tuple(np.concatenate(x) for x in zip(*known, strict=True)))
            done = 0
            for run, text in owners:
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                sums = np.add.reduceat(gains[done : done + len(text)], starts).astype(np.float32)
                out.append((0, run, _GAINS, _packed(np.diff(text[starts], prepend=0).astype(np.uint32), sums)))
                done += len(text)
        return pa.Table.from_batches([_parcels(out)])

    def gather(table: pa.Table) -> pa.Table:
        keys, parts = b"", []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == _KEYS:
                keys = data
            else:
                parts.append(_unpacked(data, np.uint32, np.float32))
        texts = [keys[i : i + 16] for i in range(0, len(keys), 16)]
        total = np.zeros(len(texts))
        for step, gain in parts:
            total[np.cumsum(step, dtype=np.int64)] += gain
        return pa.table({"key": pa.array(texts, pa.binary()), "gain": pa.array(total)})

    parcels = rows.select("held_out", "text").mapInArrow(send, _PARCEL)
    if len(model.split):
        training = rows.where(~F.col("held_out")).select("text")
        parcels = parcels.unionByName(_split_words(training, model, sent, sent_bare))
    # By the number of groups, at least one per task slot: parcels are compressed, so sizes do not tell the work.
    width = max(model.groups // GROUPS_PER_TASK, spark.sparkContext.defaultParallelism)
    answers = parcels.repartition(width, "group_").groupBy("group_").applyInArrow(ask, _PARCEL)
    gains = answers.drop("group_").groupBy("run").applyInArrow(gather, "key binary, gain double")
    return gains.groupBy("key").agg(F.min("gain").alias("gain"))


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held: int = 2,
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Learns from all rows outside fold ``held``, repeated rows as often as they
    occur. Tokens are the words between ASCII white space, A-Z lower-cased, and
    the end of the text; a null text is empty and has only its end. Without
    training rows every token is unknown; an empty table gives an empty one. Ids
    are only copied, other columns ignored. Texts of any length are read whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold(id_col, folds) == held).alias("held_out"), text_of(text_col).alias("text")
    )
    training = rows.where(~F.col("held_out")).select("text")
    words = written(_word_counts(training))
    sizes = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("ends")).first()
    total, kinds, ends = sizes["n"] or 0, sizes["v"], sizes["ends"] or 0
    frequent = _frequent(words, max_words)
    gains = written(tree_gains(rows, plan_branches(frequent, ends, total, kinds, depth, min_count, KEEP, group_tokens)))
    log_divisor = math.log10(total + kinds + 1)
    sent = share(docs.sparkSession, frequent)
    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, key binary, "
        "rare array<struct<word: binary, n: long>>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {word: math.log10(n + 1) - log_divisor for word, n in shared(sent).items()}
        end_log = math.log10(ends + 1) - log_divisor
        for batch in batches:
            done = 0
            for lists in _token_lists(batch.column(2)):
                n_tokens, n_known, base, keys, edges, rare, times = [], [], [], [], [0], [], []
                for ws in lists:
                    keys.append(_text_key(ws))
                    known, sum_logs = int(ends > 0), end_log
                    for word, n in Counter(ws).items():
                        log = logs.get(word)
                        if log is None:
                            rare.append(word)
                            times.append(n)
                        else:
                            known += n
                            sum_logs += n * log
                    n_tokens.append(len(ws) + 1)
                    n_known.append(known)
                    base.append(sum_logs)
                    edges.append(len(rare))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(lists)), batch.column(1).slice(done, len(lists)), pa.array(n_tokens, pa.int64()),
                     pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "key", "rare"],
                )
                done += len(lists)

    # The row key is stored with the rows, so every reader sees the same.
    scored = written(rows.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rest = (
        asked.join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"),
            F.sum("times").alias("tokens"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"),
        )
    )
    none = F.lit(0)
    return (
        scored.drop("rare")
        .join(rest, "row", "left")
        .join(gains, "key")
        .withColumn("base_score", F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.coalesce("tokens", none) * F.lit(log_divisor))
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", none)).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"),
        )
    )
