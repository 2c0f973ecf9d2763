import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-13-45 then March 2024", datetime.date(2024, 3, 1)),
        ("on 2024-02-03 and March 5, 2023", datetime.date(2024, 2, 3)),
        ("Jan. 4 to 6, 2026", datetime.date(2026, 1, 4)),
        ("January 25 and 26, 2026", datetime.date(2026, 1, 25)),
        ("March 4–8, 2024", datetime.date(2024, 3, 4)),
        ("March 45, 2024 but May 2023", datetime.date(2023, 5, 1)),
        ("Sept 3, 2021", None),
        ("SEP 3, 2021", datetime.date(2021, 9, 3)),
        ("2023-02-30", None),
        ("nothing", None),
    ],
)
def test_first_date(spark, text, want):
    assert one(spark, tx.first_date(F.lit(text), wordy_ranges=True)) == want


def test_backfill_accepts_only_dashes(spark):
    text = F.lit("Jan. 4 to 6, 2026")
    assert one(spark, tx.first_date(text, wordy_ranges=False)) is None
    assert one(spark, tx.month_day_date(F.lit("on June 7 we met"), F.lit("2022"))) == datetime.date(2022, 6, 7)


def test_date_of_first_text_that_has_one(spark):
    texts = F.array(F.lit("no date"), F.lit("May 2020"), F.lit("2021-01-01"))
    assert one(spark, tx.detect_date(texts)) == datetime.date(2020, 5, 1)


@pytest.mark.parametrize(
    "style, text, want",
    [
        ("post", "A & B — C", "a-b-c"),
        ("post", "Über  uns_heute!", "über-uns-heute"),
        ("post", "  ", ""),
        ("tag", "A & B — C", "a-and-b-c"),
        ("topic", "x" * 20 + " " + "y" * 20 + " " + "z" * 20, "x" * 20 + "-" + "y" * 20),
        ("export", "A b.c", "a-b-c"),
    ],
)
def test_slugify(spark, style, text, want):
    assert one(spark, tx.slugify(F.lit(text), style)) == want


def test_post_slug_is_cut_last(spark):
    text = "a" * 79 + " b"
    assert one(spark, tx.slugify(F.lit(text))) == "a" * 79 + "-"


def test_words_and_tokens(spark):
    assert one(spark, tx.word_count(F.lit("  a b\n c "))) == 3
    assert one(spark, tx.word_count(F.lit("  "))) == 0
    assert one(spark, tx.estimate_tokens(F.lit(""))) == 1
    assert one(spark, tx.estimate_tokens(F.lit("a b c"))) == 3


def test_lines_and_rfind(spark):
    assert one(spark, tx.lines(F.lit("a\r\nb\n\nc\n"))) == ["a", "b", "", "c"]
    assert one(spark, tx.rfind(F.lit("a. b. c"), ". ")) == 4
    assert one(spark, tx.rfind(F.lit("abc"), "x")) == -1


def test_strip_markdown(spark):
    text = "# Head\n\n**bold** and *it* ![i](u) [link](u) `code`\n- item\n1. first\n\n\n\nend"
    assert one(spark, tx.strip_markdown(F.lit(text))) == "Head\n\nbold and it  link \nitem\nfirst\n\nend"


def test_extract_summary(spark):
    long = "w " * 39 + "w."
    assert one(spark, tx.extract_summary(F.lit(f"One two. {long} Next."))) == f"One two. {long}"
    assert one(spark, tx.extract_summary(F.lit(f"{'v ' * 70}v. Next."))) == "v " * 70 + "v."
    first = "a " * 28 + "a."
    assert one(spark, tx.extract_summary(F.lit(f"{first} {'b ' * 40}b."))) == first
