"""Small corpora for brute-force comparisons."""

import random

# Names that operators use for columns of their own.
CLASHES = "key string, n int, fp string, row int, name string, word string, size int, __row int, __key int, place int, score int, text_ string"


def words(rnd, n, vocabulary="ab cd ef gh ij kl mn op qr st uv wx".split()):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string", clashes=True, parts=3):
    df = spark.createDataFrame(rows, schema)
    if clashes:
        for column in CLASHES.split(", "):
            name, kind = column.split()
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(parts)


def hard_texts(seed=1):
    """Nulls, empty, white, long, periodic and repeated texts, and others."""
    rnd = random.Random(seed)
    texts = [None, "", " \n\t ", "x", "one two", "Ünïcode ñandú 漢字 🎉 text", "a" * 3000, "ab " * 2000, words(rnd, 5000)]
    base = [words(rnd, rnd.randint(1, 120)) for _ in range(25)]
    texts += base + base[:6] + [t[: len(t) // 2] + " ZZ " + t[len(t) // 2 :] for t in base[:8]] + ["x", None]
    return texts
