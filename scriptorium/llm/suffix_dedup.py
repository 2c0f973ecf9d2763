"""Removing byte strings that occur more than once, by suffix arrays of bounded size.

Every window of ``length`` bytes is named by its least 16-byte gram (the
leftmost of equal ones), so equal windows have the same name. Consecutive
windows with the same gram form a stretch. Names that occur once cannot hold a
repeat and are left. Stretches with equal bytes repeat as a whole. The other
stretches of a name are laid out in 16-byte units from the gram on and sorted by
a suffix array; windows whose units agree are neighbours there, and a
comparison of the up to 16 bytes around the units tells which are equal.

Stretches are dealt to tasks by name, and arrays are built over runs of whole
names. A name with more than MAX_TEXTS different stretches does not go to one
task: its windows are dealt out singly by their digests and counted.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import SPACE, Scratch, blocks, text_of, unused
from scriptorium.llm.suffix_array import suffix_array
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 16
UNIT = 16
MAX_TEXTS = 8192
# Bytes of the stretches that share one suffix array, beyond the last name.
ARRAY_BYTES = 1 << 20
# Bytes that stand for a word where words are compared; seven bits each, so that they are text.
WORD_BYTES = 6
# Texts are handled in runs of this size, longer ones cut into segments that overlap by a window;
# a run takes about a hundred times its size while it is cut into stretches.
SEGMENT = 1 << 18

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64((1 << 26) - 1)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of any stretch of ``data``, independent of where it lies."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        scaled = _powers(_BASE, len(data))
        scaled *= _byte_values(seed)[data]
        np.cumsum(scaled, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The stretches of a run of texts: ``row, pos, run, anchor, name, content``.

    A stretch holds the windows that start at ``pos`` to ``pos + run`` of the
    row's text and have their gram at ``pos + anchor``.
    """
    sizes = np.diff(offsets)
    n_windows = np.maximum(sizes - length + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = _Hashes(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    del hashes
    least = _sliding_least((grams & ~_PLACE) | at.astype(np.uint64), length - GRAM + 1)
    del at
    row = np.repeat(np.arange(len(sizes)), n_windows)
    start = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + offsets[:-1][row]
    place = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((first[1:], [total])) - 1
    begin, run = start[first], last - first
    anchor = place[first]
    content = _Hashes(data, 2).of(begin, begin + run + length)
    return row[first], begin - offsets[row[first]], run, anchor - begin, grams[anchor], content


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    """``(key, pos, reach, run, anchor, name, content, n)``; ``n`` equal stretches in a row begin at ``pos`` to ``reach``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, offsets, data in blocks(batch.column(1), SEGMENT):
                for shift in range(0, max(len(data), 1), SEGMENT) if len(offsets) == 2 else (0,):
                    part = data[shift : shift + SEGMENT + length - 1] if len(offsets) == 2 else data
                    own = np.array([0, len(part)]) if len(offsets) == 2 else offsets
                    row, pos, run, anchor, name, content = stretches(part, own, length)
                    if not len(row):
                        continue
                    # Equal stretches one after the other (periodic text) are one row.
                    new = np.flatnonzero(
                        np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1]) | (content[1:] != content[:-1]) | (run[1:] != run[:-1])))
                    )
                    stop = np.concatenate((new[1:], [len(row)])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(first_row + row[new])), pa.array(pos[new] + shift), pa.array(pos[stop - 1] + shift),
                         pa.array(run[new]), pa.array(anchor[new]), pa.array(name[new].view(np.int64)), pa.array(content[new].view(np.int64)), pa.array(stop - new)],
                        names=["key", "pos", "reach", "run", "anchor", "name", "content", "n"],
                    )

    return docs.mapInArrow(work, "key binary, pos long, reach long, run long, anchor long, name long, content long, n long")


def repeated_windows(texts: list[bytes], runs: np.ndarray, anchors: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each stretch the runs of window starts ``(first, last)`` whose windows occur in it again or in another.

    All stretches whose windows could be equal must be among ``texts``.
    """
    data = np.frombuffer(b"".join(texts) + bytes(UNIT), np.uint8)
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    skip = anchors % UNIT
    n_units = (sizes - skip) // UNIT
    # Units of all stretches, each stretch followed by a separator.
    text_of_unit = np.repeat(np.arange(len(texts)), n_units + 1)
    index = np.arange(len(text_of_unit)) - np.repeat(np.cumsum(n_units + 1) - n_units - 1, n_units + 1)
    where = offsets[text_of_unit] + skip[text_of_unit] + index * UNIT
    real = index < n_units[text_of_unit]
    words = np.lib.stride_tricks.sliding_window_view(data, UNIT)[where[real]]
    ranks = np.zeros(len(real), np.int64)
    ranks[real] = np.unique(np.ascontiguousarray(words).view(f"V{UNIT}").ravel(), return_inverse=True)[1] + 1
    order = suffix_array(ranks)

    needed = (length - UNIT + 1) // UNIT
    enough = index[order] + needed <= n_units[text_of_unit[order]]
    order = order[enough]
    view = np.lib.stride_tricks.sliding_window_view(ranks, needed) if len(ranks) >= needed else np.zeros((0, needed), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for part in range(0, len(same), 100_000):
        a, b = order[part : part + 100_000], order[part + 1 : part + 100_001]
        a = a[: len(b)]
        same[part : part + len(b)] = (view[a] == view[b]).all(axis=1)
    cluster = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    many = np.bincount(cluster)[cluster] > 1 if len(order) else np.zeros(0, bool)
    unit, cluster = order[many], cluster[many]

    # Windows that start 0 to 15 bytes before the first unit of their neighbourhood.
    owner, byte = text_of_unit[unit], where[unit]
    flagged: list[np.ndarray] = []
    rest = length - needed * UNIT
    for before in range(UNIT):
        window = byte - before - offsets[owner]
        fits = (window >= 0) & (window <= runs[owner])
        after = rest - before
        if after < 0:
            continue
        b, c = byte[fits], cluster[fits]
        if len(b) < 2:
            continue
        left = data[(b - before)[:, None] + np.arange(before)]
        right = data[(b + needed * UNIT)[:, None] + np.arange(after)]
        edge = np.concatenate((left, right), axis=1)
        keyed = np.concatenate((c.astype(">u8").view(np.uint8).reshape(-1, 8), edge), axis=1)
        _, inverse, counts = np.unique(np.ascontiguousarray(keyed).view(f"V{8 + rest}").ravel(), return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        flagged.append(np.stack([owner[fits][again], window[fits][again]]))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if flagged:
        found = np.unique(np.concatenate(flagged, axis=1), axis=1)
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(found[0]) != 0) | (np.diff(found[1]) != 1))))
        stop = np.concatenate((cut[1:], [found.shape[1]])) - 1
        for text, a, b in zip(found[0][cut].tolist(), found[1][cut].tolist(), found[1][stop].tolist(), strict=True):
            out[text].append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _array_spans(slices: DataFrame, length: int) -> DataFrame:
    """``(name, content, a, b)`` from one suffix array per run of whole names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            spans = repeated_windows([h[4] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held]), length)
            rows = [(h[0], h[1], a, b) for h, own in zip(held, spans, strict=True) for a, b in own]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["name", "content", "a", "b"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if size > ARRAY_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done()

    dealt = slices.select("name", "content", "run", "anchor", "raw").repartition("name").sortWithinPartitions("name", "content")
    return dealt.mapInArrow(work, "name long, content long, a long, b long")


def _digest_spans(slices: DataFrame, length: int, store: Scratch) -> DataFrame:
    """``(name, content, a, b)`` for crowded names: windows dealt out by digest and counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(len(raw) - length + 1)
                digests = [hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in starts]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(digests, pa.binary())],
                    names=["name", "content", "a", "digest"],
                )

    windows = store.written(slices.select("name", "content", "raw").repartition("name", "content").mapInArrow(work, "name long, content long, a long, digest binary"))
    often = store.written(windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    return windows.join(often, "digest").select("name", "content", "a", F.col("a").alias("b"))


def _row_key(sha: Column) -> Column:
    return F.substring(F.unhex(sha), 1, 16)


def repeated_spans(
    docs: DataFrame, store: Scratch, length: int = LENGTH, text_col: str = "text", max_texts: int = MAX_TEXTS, with_text: bool = True
) -> DataFrame:
    """``(key, text, spans)`` for the distinct texts that hold a repeated string; without ``text`` fewer texts are stored on the way.

    ``key`` is the start of the text's sha256, ``spans`` the byte intervals ``(start, end)`` to
    remove, one per stretch; they may overlap. Every string of ``length`` bytes that
    starts at two or more places, in one text or several, copies of a text
    included, is covered. Tables on the way lie in ``store``; empty it when the
    result has been written.
    """
    keyed = docs.select(text_of(text_col).alias("text")).withColumn("key", _row_key(F.sha2("text", 256)))
    long = keyed.where(F.octet_length("text") >= length)
    rows = store.written(_stretch_rows(long.select("key", "text"), length))
    # Names that occur at least twice, then the stretches that have them.
    names = store.written(rows.groupBy("name").agg(F.sum("n").alias("total")).where("total > 1").select("name"))
    again = store.written(rows.join(names, "name"))
    kinds = store.written(
        again.groupBy("name", "content", "run", "anchor").agg(F.sum("n").alias("n"), F.min(F.struct("key", "pos")).alias("at"))
    )
    crowds = store.written(kinds.groupBy("name").agg(F.count("*").alias("texts")))
    kinds = store.written(kinds.join(crowds, "name"))
    # Copies of a text have the same stretches.
    placed = store.written(
        again.select("key", "pos", "reach", "run", "name", "content").distinct()
        .join(kinds.select("name", "content", F.col("n").alias("times"), "texts"), ["name", "content"])
    )
    wanted = kinds.where("texts > 1").groupBy("at.key").agg(
        F.collect_list(F.struct("at.pos", "run", "anchor", "name", "content", "texts")).alias("wanted")
    )
    # The texts that matter, once each.
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    if with_text:
        touched = placed.where("times > 1 OR texts > 1").select("key").distinct()
        texts = store.written(texts.join(touched, "key").join(wanted, "key", "left"))
    else:
        texts = texts.join(wanted, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                raw, rows = text.as_py(), own.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[f] for r in rows], pa.int64()) for f in ("name", "content", "run", "anchor", "texts")]
                    + [pa.array([raw[r["pos"] : r["pos"] + r["run"] + length] for r in rows], pa.binary())],
                    names=["name", "content", "run", "anchor", "texts", "raw"],
                )

    slices = store.written(
        texts.where("wanted IS NOT NULL").select(F.encode("text", "UTF-8").alias("raw"), "wanted")
        .mapInArrow(cut, "name long, content long, run long, anchor long, texts long, raw binary")
    )
    found = _array_spans(slices.where(F.col("texts") <= max_texts), length)
    if slices.where(F.col("texts") > max_texts).limit(1).count():
        found = found.union(_digest_spans(slices.where(F.col("texts") > max_texts), length, store))
    found = store.written(found.groupBy("name", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs")))

    whole = placed.where("times > 1").select("key", F.array(F.struct(F.col("pos").alias("start"), (F.col("reach") + F.col("run") + length).alias("end"))).alias("spans"))
    single = placed.where("times = 1").select("key", "pos", "name", "content").join(found, ["name", "content"])
    partly = single.select(
        "key", F.transform("runs", lambda r: F.struct((F.col("pos") + r["a"]).alias("start"), (F.col("pos") + r["b"] + length).alias("end"))).alias("spans")
    )
    spans = whole.union(partly).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return texts.select("key", "text").join(spans, "key") if with_text else spans


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def removal_counts(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_texts: int = MAX_TEXTS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    A byte is removed if a string of ``length`` bytes covers it that starts at
    another place of the corpus as well; strings are judged on the input.
    Null and empty texts have no bytes, texts shorter than ``length`` lose
    none, repeated rows lose all of theirs if they are as long. Ids are only
    copied, other columns ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans = text.as_py(), _merged(own.as_py())
                removed.append(sum(b - a for a, b in spans))
                runs.append(len(spans))
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
                names=["key", "n_removed", "n_spans", "kept"],
            )

    store = Scratch(docs.sparkSession)
    spans = repeated_spans(docs, store, length, text_col, max_texts).select("key", F.encode("text", "UTF-8").alias("raw"), "spans")
    counts = written(spans.mapInArrow(work, "key binary, n_removed long, n_spans long, kept string"))
    store.empty()
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    none = F.lit(0).cast("long")
    return rows.withColumn("key", _row_key(F.col("sha"))).join(counts, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )


class _Codes(dict):
    """Words to the bytes that stand for them."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = bytes(b & 0x7F for b in hashlib.blake2b(word, digest_size=WORD_BYTES).digest())
        return code


def _coded(docs: DataFrame, text_col: str) -> DataFrame:
    """``(key, code)``, one row per row: the text's key and its words as codes of equal size, white space left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = _Codes().__getitem__
        for batch in batches:
            for first, last, offsets, data in blocks(batch.column(1)):
                raw = data.tobytes()
                codes = [b"".join(map(code_of, raw[a:b].split())).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(codes, pa.string())], names=["key", "code"])

    text = text_of(text_col)
    return docs.select(_row_key(F.sha2(text, 256)).alias("key"), text.alias("text")).mapInArrow(work, "key binary, code string")


def _word_spans(docs: DataFrame, store: Scratch, words: int, text_col: str, max_texts: int) -> DataFrame:
    """``(key, runs)`` for the distinct texts that hold a repeated run of ``words`` words: ``repeated_spans`` over their codes."""
    coded = _coded(docs, text_col).where(F.octet_length("code") >= words * WORD_BYTES)
    found = store.written(repeated_spans(coded, store, words * WORD_BYTES, "code", max_texts, with_text=False).select(F.col("key").alias("code_key"), F.col("spans").alias("runs")))
    # Texts that differ in white space share a code.
    texts = store.written(coded.select("key", _row_key(F.sha2("code", 256)).alias("code_key")).distinct())
    return texts.join(found, "code_key").select("key", "runs")


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        yield a, b


def _of_words(raw: bytes, runs: list[dict]) -> Iterator[tuple[int, int]]:
    """Intervals of codes as bytes of the text, from the first word's start to the last one's end.

    Not merged before: the white space between two runs that touch belongs to neither.
    """
    places = [m.span() for m in re.finditer(rb"[^" + SPACE + rb"]+", raw)]
    for run in runs:
        first, last = -(-run["start"] // WORD_BYTES), run["end"] // WORD_BYTES
        if first < last:
            yield places[first][0], places[last - 1][1]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, text_col: str = "text", max_texts: int = MAX_TEXTS, words: int | None = None
) -> DataFrame:
    """``docs`` with the repeated strings taken out of their texts, all rows and columns kept.

    As ``removal_counts``, but a character of which only some bytes would go
    stays whole. With ``words``, runs of so many words between ASCII white space
    that start at two or more places go too, however few bytes they have and
    whatever white space is between them; words are compared by 42 bits of a
    digest. Both are judged on the input. Null texts stay null.
    """
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, own, runs in zip(batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                if not own.is_valid and not runs.is_valid:
                    kept.append(text.as_py())
                    continue
                raw, parts, done = text.as_py().encode(), [], 0
                spans = [*_whole_characters(raw, _merged(own.as_py() or [])), *_of_words(raw, runs.as_py() or [])]
                for a, b in _merged([{"start": a, "end": b} for a, b in spans]):
                    parts.append(raw[done:a])
                    done = b
                kept.append(b"".join([*parts, raw[done:]]).decode())
            columns = batch.columns[:-2]
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    store = Scratch(docs.sparkSession)
    cuts = written(repeated_spans(docs, store, length, text_col, max_texts, with_text=False))
    store.empty()
    if words:
        store = Scratch(docs.sparkSession)
        runs = written(_word_spans(docs, store, words, text_col, max_texts))
        store.empty()
        cuts = cuts.join(runs, "key", "full")
    else:
        cuts = cuts.withColumn("runs", F.lit(None).cast(cuts.schema["spans"].dataType))
    key, spans, runs = unused(docs, "__key"), unused(docs, "__spans"), unused(docs, "__runs")
    keyed = docs.withColumn(key, _row_key(F.sha2(text_of(text_col), 256)))
    joined = keyed.join(cuts.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("runs").alias(runs)), key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], spans, runs).mapInArrow(work, docs.schema)
