import random
import unicodedata

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from palimpsest.llm.lookalikes import alike_classes, alike_pairs, merged_entries, one_form_array, shown


def form(*texts):
    return one_form_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｗｉｄｅ", "wide"), ("café", "café"), ("ậ", "ậ"), ("ậ", "ậ"), ("​zero‍﻿", "zero"), ("a b", "a b"),
     ("  a   b　", "a b"), ("ﬁne", "fine"), ("ﬆop", "stop"), ("соre", "core"), ("ⅰⅼⅾ", "ild"), ("օne", "one"), ("ɡο", "go"), ("Å", "Å"), ("ё", "ë"), ("so­ft", "soft"), ("한", "한")],
)
def test_alike(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("A", "a"), ("x²", "x2"), ("й", "и"), ("ab", "a b"), ("ſ", "s"), ("o", "ö"), ("š", "ś")])
def test_not_alike(a, b):
    assert form(a) != form(b)


def test_edges():
    assert form(None, "", "​  ", "x") == [None, "", "", "x"] and form() == []
    assert form("́a") == ["́a"] and form("a", "́") == ["a", "́"]
    long = "Ｅ́x " * 300_000
    assert form(long, "y", long)[::2] == ["Éx " * 299_999 + "Éx"] * 2


def test_equals_plain_version_over_random_marks():
    rng = random.Random(9)
    pool = "aeouAnyzс е" + "̧̣́̀̂̈̊​" + "éậЙё각ﬁＺ" + "".join(map(chr, range(0x1100, 0x1104))) + "".join(map(chr, range(0x1161, 0x1164))) + "ᆨᆩ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(5000)]

    def plain(text):
        parts = "".join(chr(x) for c in text for x in shown(ord(c)))
        return " ".join(unicodedata.normalize("NFD", parts).split(" ")).strip(" ") if parts else ""

    got = form(*texts)
    for text, one in zip(texts, got):
        want = plain(text)
        while "  " in want:
            want = want.replace("  ", " ")
        assert unicodedata.normalize("NFD", one) == want


def test_same_form_again():
    texts = ["ｊｕ́v", "соrе̣̂", "ﬁ́"]
    assert form(*form(*texts)) == form(*texts)


ENTRIES = [(1, 7, "core", [1, 2, 0]), (2, 7, "соre", [2, 3]), (2, 7, "соre", [2, 3]), (3, 7, "core", None), (4, 8, "соre", []), (5, 7, None, [9]), (6, None, "core", [1]), (7, 7, "ｃｏｒｅ", [4]), (8, 7, "Core", [5])]


def test_pairs_and_merge(spark):
    rows = spark.createDataFrame(ENTRIES, "entry_id long, seg long, form string, ids array<long>").withColumnRenamed("form", "word")
    assert {tuple(r) for r in alike_pairs(rows, "seg", "entry_id", "word").collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    got = {(r["seg"], r["form"]): tuple(r)[2:] for r in merged_entries(rows, "seg", "entry_id", "word", "ids").collect()}
    assert got[7, "core"] == (4, 3, 5) and got[8, "core"] == (1, 1, 0) and got[None, "core"] == (1, 1, 1) and got[7, "Core"] == (1, 1, 1)
    assert alike_pairs(rows.where("false"), "seg", "entry_id", "word").count() == 0


@pytest.mark.parametrize(("a", "b"), [("αγορά", "ayopá"), ("ᎪᏟ", "AC"), ("ꓐꓮꓢꓰ", "BASE"), ("ⲞⲢⲈⲚ", "OPEN"), ("𐐬𐑀", "o𐑀"), ("ᑭᑌᒪ", "PUL"), ("ОТУ", "OTY")])
def test_other_scripts(a, b):
    assert form(a) == form(b)


def test_one_spelling_in_many_entries_is_never_paired(spark):
    rows = spark.range(20_000).select(F.col("id").alias("entry_id"), F.lit(1).alias("seg"), F.lit("core").alias("word"))
    rows = rows.unionByName(spark.createDataFrame([(-1, 1, "соre"), (-2, 1, "ｃore"), (-3, 2, "core")], "entry_id long, seg int, word string"))
    pairs = alike_pairs(rows, "seg", "entry_id", "word")
    assert pairs.count() == 40_001
    classes = {r["entry_id"]: (r["form"], r["n_links"]) for r in alike_classes(rows, "seg", "entry_id", "word").where("entry_id < 1").collect()}
    assert classes == {0: ("core", 2), -1: ("core", 20_001), -2: ("core", 20_001), -3: ("core", 0)}
    assert alike_classes(rows.where("false"), "seg", "entry_id", "word").count() == 0
