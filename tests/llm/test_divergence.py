import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import divergence
from tests.llm.helpers import frame, hard_texts, words

SCHEMA = "doc_id long, text string, lang string, source string"
# The columns that this operator reads stay out of the clashing ones.
FIELDS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    having, counts, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        having[lang].update(set(terms))
    kept = {lang: {t for t, n in having[lang].items() if n >= min_docs} for lang, _, _ in docs}
    for lang, source, terms in docs:
        own = [t for t in terms if t in kept[lang]]
        counts[lang, source].update(own)
        total[lang].update(own)

    def share(counter, lang, term):
        return 1 + 1_000_000_000 * (counter[term] + 1) // (sum(counter.values()) + len(kept[lang]))

    out = []
    for lang, source in {(a, b) for a, b, _ in docs}:
        c = counts[lang, source]
        pairs = []
        for other in {b for a, b, _ in docs if a == lang and b != source}:
            value = 0
            for t in kept[lang]:
                p, q = share(c, lang, t), share(counts[lang, other], lang, t)
                value += (p - q) ** 2 // q
            pairs.append((-value, other.encode(), other))
        out += [(lang, source, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
        terms = []
        for t in kept[lang]:
            p, q = share(c, lang, t), share(total[lang], lang, t)
            if c[t] and p > q:
                terms.append((-((p - q) ** 2 // q), t.encode(), t))
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    texts = hard_texts() + ["Ärger-und ÄRGER, don't 3x x3 élan", "naïve_naïve", "\x00a\x7fb"] * 3
    vocabulary = [words(rnd, 1) + words(rnd, 1) for _ in range(60)]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))) for _ in range(80)]
    return [(i % 50, t, rnd.choice(["en", "de", None]), rnd.choice([None, "", "a", "b", "c", "é", "z"])) for i, t in enumerate(texts)]


def result(df):
    assert df.columns == FIELDS
    return sorted(tuple(r) for r in df.collect())


def test_all_divergences_match_brute_force_in_one_cell_and_in_many(spark):
    rows = corpus() + [(1, None, "xx", "lone"), (2, "once only", "yy", "p"), (3, None, "yy", "q")]
    docs = frame(spark, rows, SCHEMA)
    want = brute(rows)
    assert result(divergence.divergences(docs)) == want
    assert result(divergence.divergences(docs, tile=2, postings=20)) == want


def test_top_terms_ties_and_thresholds(spark):
    rows = [(i, f"t{'abcdefgh'[i % 8] * 3} common {'q' * (i % 3 + 1)}", "en", "ab"[i % 2]) for i in range(40)]
    for min_docs, top in ((1, 3), (5, 2), (100, 5)):
        assert result(divergence.divergences(frame(spark, rows, SCHEMA), min_docs, top)) == brute(rows, min_docs, top)


def test_empty_table_and_very_long_text(spark):
    docs = frame(spark, [(1, "alpha Beta " * 700_000, "en", "a"), (2, "alpha gamma", "en", "b"), (3, "beta", "en", "b")], SCHEMA)
    assert result(divergence.divergences(docs.where(F.lit(False)))) == []
    got = result(divergence.divergences(docs, min_docs=2))
    assert got == brute([(1, "alpha Beta " * 700_000, "en", "a"), (2, "alpha gamma", "en", "b"), (3, "beta", "en", "b")], 2)


def test_counts_beyond_nine_digits_do_not_overflow(spark):
    shown = spark.sql(f"SELECT {divergence._share('20000000000', '30000000000', '7')} AS p").first()["p"]
    assert shown == 1 + 10**9 * (2 * 10**10 + 1) // (3 * 10**10 + 7)
