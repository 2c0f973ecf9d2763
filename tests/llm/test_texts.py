"""Quality, language, language model, token counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scriptorium.llm import language_id, lm_scoring, quality, token_counts
from scriptorium.llm.common import fold, share
from scriptorium.session import shared_folder
from tests.llm.helpers import frame, hard_texts, words

SF_DIR = "/root/testdata/sf0.01"


def crc(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


# --- quality -------------------------------------------------------------------

def test_quality_tells_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97


def test_quality_edges(spark):
    rnd = random.Random(0)
    rows = [(i, words(rnd, 60) if i % 4 else "| " + " | ".join(words(rnd, 60).split())) for i in range(400)] + [(None, None), (401, ""), (3, None)]
    docs = frame(spark, rows + [(1, rows[1][1])] * 2 + [(500 + i, t) for i, t in enumerate(hard_texts())])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert sum(by_id[i] >= 0.5 for i in range(8, 400) if i % 4) > 280 and sum(by_id[i] < 0.5 for i in range(8, 400, 4)) > 90
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score_quality(docs.where(F.lit(False)), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 0), (2, 1), (3, 1)]])
def test_quality_without_enough_labels(spark, labels):
    docs = frame(spark, [(1, "a b"), (2, "c d"), (3, ""), (4, None)])
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), folds=1000)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, model).collect())


# --- languages -----------------------------------------------------------------

def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = language_id.fit_languages(docs.where(fold("doc_id", 5) != 0))
    rows = language_id.identify_languages(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_code_lengths_match_escapes_step_by_step(spark):
    texts = ["abracadabra", "abab\ncdcd", "añb añb"] * 4
    trees = language_id.fit_languages(frame(spark, [(t, "xx") for t in texts], "text string, lang string"), min_count=3, order=3)
    tree = trees["xx"]
    raw = [t.encode().translate(language_id._WHITE) for t in texts]
    counts = {}
    for r in raw:
        for i, b in enumerate(r):
            before = b"\n" + r[:i]
            for d in range(min(3, len(before)) + 1):
                counts.setdefault(before[len(before) - d :], Counter())[b] += 1
    counts = {c: n for c, n in counts.items() if not c or sum(n.values()) >= 3}

    def probability(context, b):
        while context not in counts:
            context = context[1:]
        n = counts[context]
        if b in n:
            return n[b] / (n.total() + len(n))
        below = probability(context[1:], b) if context else 1 / 256
        return len(n) / (n.total() + len(n)) * below

    for text in (b"abracax", b"a\xc3\xb1b zz", b"q"):
        stream = language_id.stream_of([text])
        bits = tree.costs(stream)[: len(text)]
        want = [-math.log2(probability((b"\n" + text[:i])[-3:], b)) for i, b in enumerate(text)]
        assert bits == pytest.approx(want, rel=1e-4)


def test_language_edges(spark):
    rnd = random.Random(2)
    rows = [(i, words(rnd, 40), "aa") for i in range(30)] + [(100 + i, words(rnd, 40, "xyz xzy yyz zzx".split()), "bb") for i in range(30)]
    rows += [(None, None, "aa"), (200, "12 ?!", "aa"), (201, "xyz zzx xyz", None), (202, "", None), (203, "x", "cc")]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    trees = language_id.fit_languages(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(docs, trees).collect()}
    assert got[None] == got[200] == got[202] == ("und", 0.0)
    assert got[201][0] == "bb" and all(got[i][0] == "aa" for i in range(30)) and all(0 <= s <= 1 for _, s in got.values())
    assert {p for p, _ in ((r["lang_pred"], 0) for r in language_id.identify_languages(docs, {}).collect())} == {"und"}
    assert language_id.fit_languages(docs.where(F.lit(False))) == {}


# --- language model ------------------------------------------------------------

@pytest.mark.parametrize("max_words", [131_072, 0, 5])
def test_baseline_matches_brute_force(spark, max_words):
    texts = hard_texts() + [words(random.Random(9), 30, "new unseen Words only".split())]
    rows = list(enumerate(texts)) + [(None, "ab null id"), (3, "x")]
    got = lm_scoring.score_texts(frame(spark, rows), max_words=max_words, min_count=20).collect()
    lists = [((t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [b""], crc(i, 7) == 2) for i, t in rows]
    counts = Counter(w for ws, held in lists if not held for w in ws)
    total, kinds = counts.total(), len(counts)
    want = Counter((held, len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for ws, held in lists)
    assert Counter((r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)


def test_tree_beats_the_baseline(spark):
    rnd = random.Random(4)
    pairs = [("red", "apple"), ("blue", "sea"), ("old", "stone")]
    rows = [(i, " ".join(" ".join(rnd.choice(pairs)) for _ in range(60))) for i in range(80)]
    docs = frame(spark, rows)
    got = lm_scoring.score_texts(docs, min_count=20).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] + 10 for r in got)


class PlainTree:
    """The suffix tree over all training texts at once, symbol by symbol."""

    def __init__(self, lists, frequent, total, kinds, ends, depth, min_count, keep):
        self.frequent, self.depth = frequent, depth
        known = {w: (n + 1) / (total + kinds + 1) for w, n in frequent.items()}
        known[b""] = (ends + 1) / (total + kinds + 1)
        self.root = {**known, None: max(1 - sum(known.values()), 1e-12)}
        self.followers, self.states = {}, {}
        for words in lists:
            for context, symbol in self.tokens(words):
                for d in range(1, len(context) + 1):
                    self.followers.setdefault(context[-d:], Counter())[symbol] += 1
        for context in sorted(self.followers, key=len):
            counts = self.followers[context]
            below, n, k = self.state(context[1:]), counts.total(), len(counts)
            saved = sum(c * math.log((c - 1 + k * below[s]) / (n - 1 + k) / below[s]) for s, c in counts.items())
            if n >= min_count and saved > keep:
                self.states[context] = {s: (counts[s] + k * p) / (n + k) for s, p in below.items()}

    def state(self, context):
        while context and context not in self.states:
            context = context[1:]
        return self.states.get(context, self.root)

    def tokens(self, words):
        line = [b"", *words, b""]
        for i in range(1, len(line)):
            yield tuple(line[max(0, i - self.depth) : i]), line[i] if line[i] in self.root else None

    def gain(self, words):
        return sum(math.log10(self.state(c)[s] / self.root[s]) for c, s in self.tokens(words))


@pytest.mark.parametrize("max_words, group_tokens", [(1000, 1 << 20), (1000, 300), (12, 1 << 20), (12, 300)])
def test_tree_matches_brute_force(spark, max_words, group_tokens):
    rnd = random.Random(4)
    copied = [" ".join(f"w{rnd.randrange(400)}" for _ in range(40)) for _ in range(4)]
    texts = hard_texts() + [words(rnd, 40, ["red apple", "blue sea", "old stone", "The"]) for _ in range(30)] + copied * 2
    rows = list(enumerate(texts)) + [(None, copied[0]), (3, copied[1])]
    got = lm_scoring.score_texts(frame(spark, rows), max_words=max_words, group_tokens=group_tokens).collect()
    lists = [((t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), crc(i, 7) == 2) for i, t in rows]
    training = [ws for ws, held in lists if not held]
    counts = Counter(w for ws in training for w in ws)
    total, kinds = counts.total() + len(training), len(counts) + 1
    docs = frame(spark, [(i, t) for i, t in rows if crc(i, 7) != 2])
    frequent = lm_scoring._frequent(lm_scoring._word_counts(docs.select(F.coalesce("text", F.lit("")).alias("text"))), max_words)
    tree = PlainTree(training, frequent, total, kinds, len(training), lm_scoring.DEPTH, lm_scoring.MIN_COUNT, lm_scoring.KEEP)
    assert {len(c) for c in tree.states} == {1, 2, 3} and all(sum(s.values()) == pytest.approx(1) for s in tree.states.values())
    assert all(r["score"] < 0 for r in got)
    assert sorted(r["score"] - r["base_score"] for r in got) == pytest.approx(sorted(tree.gain(ws) for ws, _ in lists), rel=1e-4, abs=1e-3)


def test_counts_of_split_words_travel_in_buckets(spark):
    """A task sends a row for every bucket, however many pairs it has counted, and every part gets the whole distribution."""
    rnd = random.Random(6)
    texts = [" ".join(f"w{min(rnd.randrange(1, 40), rnd.randrange(1, 40))}" for _ in range(50)) for _ in range(120)]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = Counter(w.encode() for t in texts for w in t.split())
    model = lm_scoring.plan_branches(dict(counts), len(texts), counts.total() + len(texts), len(counts) + 1, group_tokens=200)
    assert len(model.split) > 5 and max(model.parts) > 1
    sent = share(spark, model)
    rows = lm_scoring._counted_pairs(training, model, sent).collect()
    assert len(rows) <= 3 * (model.groups // lm_scoring.GROUPS_PER_TASK + 1)
    code = {w.decode(): i for w, i in model.code.items()}
    pairs = Counter()
    for t in texts:
        line = [model.end, *(code[w] for w in t.split()), model.end]
        pairs.update((a, b) for a, b in zip(line, line[1:]) if a in model.split)
    assert len(rows) < len(pairs)
    found, homes = {}, Counter()
    for r in lm_scoring._split_words(training, model, sent, sent).collect():
        word, symbol, n = lm_scoring._unpacked(bytes(r["data"]), np.int64, np.int32, np.int64)
        homes[int(word[0])] += 1
        found |= {(int(a), int(b)): int(c) for a, b, c in zip(word, symbol, n)}
    assert found == pairs
    assert homes == dict(zip(model.split.tolist(), model.parts.tolist()))


def test_tree_grows_with_the_corpus(spark):
    """A rare passage that occurs in two documents is foretold in both, however large the rest."""
    for size in (200, 2000):
        rnd = random.Random(size)
        rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(50))) for i in range(size)]
        twice = [i for i in range(size, size + 40) if crc(i, 7) != 2][:20]
        texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(50)) for _ in range(10)]
        docs = frame(spark, rows + [(i, texts[n // 2]) for n, i in enumerate(twice)])
        gain = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in lm_scoring.score_texts(docs).collect()}
        others = sorted(g for i, g in gain.items() if i < size)
        assert min(gain[i] for i in twice) > others[int(0.99 * len(others))]


def test_language_model_without_training_rows(spark):
    held = [i for i in range(50) if crc(i, 7) == 2]
    got = lm_scoring.score_texts(frame(spark, [(i, "a b") for i in held])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and r["base_score"] == 0 for r in got)
    assert lm_scoring.score_texts(frame(spark, [(1, "a")]).where(F.lit(False))).count() == 0


# --- token counts --------------------------------------------------------------

def test_counts_and_cache(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = hard_texts() + ["<s> </s> <unk> a", "  lead and trail  "]
    docs = frame(spark, list(enumerate(texts)))
    cache = f"{shared_folder(spark)}/cache_test_{random.random()}"
    for _ in range(2):
        got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, path, cache, limit=50).collect()}
        want = {i: (len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in enumerate(texts)}
        assert got == {i: (b, n, n > 50) for i, (b, n) in want.items()}
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    more = frame(spark, [(1, "a new text"), (2, texts[9])])
    token_counts.count_tokens(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.count_tokens(more, other, cache).count() == 2
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts.count_tokens(docs.where(F.lit(False)), path, cache).count() == 0
