import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import suffix_dedup
from scriptorium.llm.suffix_array import suffix_array
from tests.llm.helpers import frame, hard_texts


def test_suffix_array_matches_sorting():
    r = np.random.default_rng(0)
    for t in range(1500):
        n = int(r.integers(0, 40))
        s = r.integers(0, int(r.integers(1, 5)), n)
        if t % 3 == 0 and n > 3:
            s = np.tile(s[: n // 4 + 1], 4)
        want = sorted(range(len(s)), key=lambda i: s.tolist()[i:])
        assert suffix_array(s).tolist() == want


def removed_mask(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    masks = []
    for r in raw:
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return raw, masks


def corpus(length, seed):
    rnd = random.Random(seed)
    pieces = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(8)]
    texts = hard_texts(seed)
    for _ in range(30):
        text = "".join(rnd.choice(pieces) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, length))) for _ in range(3))
        cut = rnd.randrange(len(text) + 1)
        texts.append(text[:cut] + "Z" * rnd.randint(0, 1) + text[cut:])
    return texts + texts[-5:]


@pytest.mark.parametrize("length,max_texts,segment", [(60, 8192, 1 << 21), (400, 8192, 700), (60, 2, 1 << 21)])
def test_counts_match_brute_force(spark, monkeypatch, length, max_texts, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    texts = corpus(length, length)
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removal_counts(docs, length, max_texts=max_texts).collect()}
    for i, (raw, mask) in enumerate(zip(*removed_mask(texts, length), strict=True)):
        edges = np.diff(np.concatenate(([0], mask.astype(int), [0])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        assert got[i] == (len(raw), mask.sum(), (edges == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_texts_without_repeats(spark):
    texts = corpus(60, 3)
    docs = frame(spark, list(enumerate(texts)))
    out = suffix_dedup.remove_repeats(docs, 60)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, (text, raw, mask) in enumerate(zip(texts, *removed_mask(texts, 60), strict=True)):
        kept, at = "", 0
        for c in text or "":
            size = len(c.encode())
            if not mask[at : at + size].all():
                kept += c
            at += size
        assert got[i] == (None if text is None else kept)


def word_mask(texts, n):
    """Bytes under runs of ``n`` words that start at two or more places."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    masks = []
    for text, own, w in zip(texts, places, words, strict=True):
        mask = np.zeros(len((text or "").encode()), bool)
        for i in range(len(w) - n + 1):
            if counts[tuple(w[i : i + n])] > 1:
                mask[own[i][0] : own[i + n - 1][1]] = True
        masks.append(mask)
    return masks


@pytest.mark.parametrize("max_texts", [8192, 2])
def test_runs_of_words_against_brute_force(spark, max_texts):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.choice([1, 1, 2, 12])))
    passages = [[word() for _ in range(n)] for n in (9, 10, 11, 14, 30)]
    texts = hard_texts(4) + ["x " * 10, "y " * 11]
    for _ in range(80):
        parts = [w for _ in range(3) for w in ([word() for _ in range(rnd.randrange(12))] + rnd.choice(passages)[rnd.randrange(3) :])]
        texts.append("".join(w + rnd.choice([" ", " ", "\n", " \t "]) for w in parts))
    docs = frame(spark, list(enumerate(texts + texts[-3:])))
    texts += texts[-3:]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs, 60, max_texts=max_texts, words=10).collect()}
    for i, (text, raw, mask, by_word) in enumerate(zip(texts, *removed_mask(texts, 60), word_mask(texts, 10), strict=True)):
        kept, at = "", 0
        for c in text or "":
            size = len(c.encode())
            if not (mask[at : at + size].all() or by_word[at : at + size].all()):
                kept += c
            at += size
        assert got[i] == (None if text is None else kept)


def test_stage_takes_passages_of_51_short_words(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("aeiou")
    passage, short = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(50))
    assert len(passage.encode()) < suffix_dedup.LENGTH
    texts = [f"begin{i} {passage} mid{i} {short} end{i}" for i in range(3)] + [f"begin3 {passage.replace(' ', chr(10))} end3"]
    docs = frame(spark, [(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeat_removal(spark, docs, "").collect()}
    want = [f"begin{i}  mid{i} {short} end{i}" for i in range(3)] + ["begin3  end3"]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_stage_stores_no_texts_on_the_way(spark, monkeypatch):
    columns = []
    stored = suffix_dedup.Scratch.written
    monkeypatch.setattr(suffix_dedup.Scratch, "written", lambda self, df: columns.extend(df.columns) or stored(self, df))
    docs = frame(spark, list(enumerate(corpus(60, 60))))
    suffix_dedup.remove_repeats(docs, 60, words=10).count()
    assert "raw" in columns and not {"text", "code"} & set(columns)


def test_spans_are_the_same_without_texts(spark):
    docs = frame(spark, list(enumerate(corpus(60, 61))))

    def spans(**options):
        rows = suffix_dedup.repeated_spans(docs, suffix_dedup.Scratch(spark), 60, **options).collect()
        return {bytes(r["key"]): sorted(map(tuple, r["spans"])) for r in rows}

    assert spans(with_text=False) == spans() != {}


def test_empty_table(spark):
    docs = frame(spark, [(1, "x")]).where(F.lit(False))
    assert suffix_dedup.removal_counts(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
