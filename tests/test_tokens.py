import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.tokens import ACCENTED, BASE, BYTES, TokenizerConfig, file_words, words
from palimpsest.operators.postings import text_postings, word_counts
from tests.oracles import tokens

VECTORS = [
    ("hello world words", {"hello", "world", "words"}), ("word", {"word"}), ("word\n", set()), ("a tree", {"tree"}),
    ("tree house\n", {"house"}), ("HELLO hello Hello\n", {"hello"}), ("foo2bars3bazzy", {"bazzy"}),
    ("Test with special chars: @#$%^&*()!\n", {"chars", "special"}), ("internationalization", set()),
    ("abcdefghijklmn opqrstuvwxyzabc q", {"abcdefghijklmn"}), ("x abcdefghijklmnopqrs", {"abcdefghijklmnopqrs"}),
    ("x abcdefghijklmnopqrst", set()), ("Straße über naïve café\n", set()), ("don’t stop—believing\n", {"aobelieving"}),
    ("", set()), ("     \n", set()), (None, set()),
]


def test_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VECTORS)], "i int, t string")
    got = {r["i"]: set(r["w"]) for r in rows.select("i", words(F.col("t")).alias("w")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(VECTORS)}


def test_random_bytes_equal_plain_version(spark):
    rng = random.Random(7)
    data = [bytes(rng.choice(b"abcdeXYZ \n-3\xc3\xa4\xa9\xe2\x80\x94\x99") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(f"/d/x{i}.txt", bytearray(d)) for i, d in enumerate(data)], "path string, content binary")
    got = {r["path"]: set(r["w"]) for r in rows.select("path", file_words(F.col("path"), F.col("content")).alias("w")).collect()}
    assert got == {f"/d/x{i}.txt": tokens(d) | tokens(f"x{i}.txt".encode()) for i, d in enumerate(data)}


@pytest.mark.parametrize(
    ("path", "want"),
    [("/d/unique_test.txt", {"unique"}), ("/d/notes.md", set()), ("/d/myREADME", set()), ("/d/.txt", set()), ("/d/A_Longname.txt", {"longname"})],
)
def test_file_names(spark, path, want):
    rows = spark.createDataFrame([(path, bytearray(b""))], "path string, content binary")
    assert set(rows.select(file_words(F.col("path"), F.col("content"))).first()[0]) == want


def test_letter_table():
    want = "ä a ß s Ô o é e Ÿ y ñ n ç c î i Ù u".split()
    assert {a: BYTES[chr(a.encode()[-1])] for a in want[::2]} == dict(zip(want[::2], want[1::2]))
    assert len(ACCENTED) == len(BASE) == len(set(ACCENTED)) == 55 and len(BYTES) == 55 + 26


def test_folded_accents(spark):
    rows = spark.createDataFrame([("über cafés naïve\n",)], "t string")
    assert set(rows.select(words(F.col("t"), TokenizerConfig(accents="folded"))).first()[0]) == {"cafes", "naive"}


def test_postings_edges(spark):
    rows = spark.createDataFrame([(1, "apple apple pears\n", 0), (1, "apple apple pears\n", 0), (2, None, 1), (None, "ghost words\n", 2)], "k long, t string, word int")
    got = {tuple(r) for r in text_postings(rows, "k", "t").collect()}
    assert got == {("a", "apple", 1), ("p", "pears", 1)}
    assert {tuple(r) for r in word_counts(rows.where("k IS NOT NULL").distinct(), "k", "t").collect()} == {(1, 2), (2, 0)}
    assert text_postings(rows.where("false"), "k", "t").count() == 0
