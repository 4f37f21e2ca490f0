import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.graph_weights import degrees, most_neighbours, term_degrees, weigh_hits
from palimpsest.llm.vocabulary import marked, record_count, term_counts


def plain_degrees(tokens, window):
    near = defaultdict(set)
    for i, a in enumerate(tokens):
        for b in tokens[max(0, i - window) : i + window + 1]:
            if a is not None and b is not None:
                near[a].add(b)
    return {t: (n, len(near[t] - {t})) for t, n in Counter(t for t in tokens if t is not None).items()}


@pytest.mark.parametrize("window", [1, 4])
def test_degrees_equal_plain(spark, window):
    rng = random.Random(window)
    docs = [(i, [rng.choice(["a", "b", "c", "dé", "", "f", "g"]) for _ in range(rng.randint(0, 30))], i) for i in range(80)]
    docs += [(100, None, 0), (None, ["a", "b"], 0)]
    rows = spark.createDataFrame(docs, "id long, words array<string>, term int")
    got = defaultdict(dict)
    for r in term_degrees(rows, "id", "words", window).collect():
        got[r["id"]][r["term"]] = (r["n_times"], r["degree"])
    assert got == {i: plain_degrees(w, window) for i, w, _ in docs if w}


def test_repeating_in_one_spot_adds_nothing(spark):
    rows = spark.createDataFrame([(1, "x x x x a b c d e f".split()), (2, "x a b x c d x e f x".split())], "id long, words array<string>")
    degree = {r["id"]: r["degree"] for r in term_degrees(rows, "id", "words", 2).where("term = 'x'").collect()}
    assert degree == {1: 2, 2: 6}


def test_null_tokens_and_empty(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"])], "id long, words array<string>")
    assert {(r["term"], r["n_times"]) for r in term_degrees(rows, "id", "words").collect()} == {("a", 1), ("b", 1)}
    assert term_degrees(rows.where("false"), "id", "words").count() == 0


def test_most_neighbours(spark):
    """No record gives a term more neighbours; one that spreads it out gives it as many."""
    cases = [(c, n) for c in (None, 0, -1, 1, 2, 3, 7) for n in (None, 0, 1, 2, 5, 9)]
    rows = spark.createDataFrame(cases, "c long, n long")
    for r in rows.select("c", "n", most_neighbours(F.col("c"), F.col("n"), 2).alias("r")).collect():
        assert r["r"] == (min(4 * r["c"], r["n"]) if (r["c"] or 0) > 0 and r["n"] else 0)
    rng = random.Random(6)
    records = [[rng.choice(["x", *"abcdefgh"]) for _ in range(rng.randint(1, 20))] for _ in range(300)] + [list("axbcxdexf")]
    row, code, times, near, terms = degrees(pa.array(records), 1)
    terms = terms.to_pylist()
    for r, c, t, n in zip(row, code, times, near):
        assert n <= min(2 * t, len(set(records[r])))
    assert [(t, n) for r, c, t, n in zip(row, code, times, near) if r == 300 and terms[c] == "x"] == [(3, 6)]


def test_scores(spark):
    hits = spark.createDataFrame([(1, "rare", 6, 9), (1, "rare", 5, 9), (1, "common", 6, 9), (2, "rare", None, 9), (None, "rare", 1, 9), (3, "rare", 2, 9), (4, "new", 1, 0)], "path_id long, word string, count long, n_paths int")
    lengths = spark.createDataFrame([(1, 12), (2, 5), (3, 0), (4, 2)], "path_id long, length long")
    counts = spark.createDataFrame([("rare", 2), ("common", 90)], "term string, n_records long")
    got = {(r["path_id"], r["word"]): r for r in weigh_hits(hits, lengths, counts, 100).collect()}
    assert set(got) == {(1, "rare"), (1, "common"), (4, "new")}
    assert got[1, "rare"]["count"] == 6 and got[1, "rare"]["degree"] == 12
    assert got[1, "rare"]["score"] == pytest.approx(math.log(101 / 2), abs=1e-6)
    assert got[1, "rare"]["score"] > got[1, "common"]["score"] > 0
    assert got[4, "new"]["n_paths"] == 0


def test_counts_equal_plain(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.3 else rng.choice(["", "a", "b", "né", None]), rng.choice([None, *range(60)]), rng.randint(0, 3)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string, r long, n_rows int")
    good = [(t, r) for t, r, _ in rows if t is not None and r is not None]
    got = {x["term"]: (x["n_rows"], x["n_records"]) for x in term_counts(df, "t", "r", parts=5).collect()}
    assert got == {t: (n, len({r for u, r in good if u == t})) for t, n in Counter(t for t, _ in good).items()}
    assert spark.range(1).select(record_count(df, "t", "r")).first()[0] == len({r for _, r in good})


def test_counts_over_small_batches_and_text_records(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(f"w{i % 5}", f"r{i % 11}") for i in range(500)] * 2, "t string, r string")
        assert {tuple(r) for r in term_counts(df, "t", "r", parts=3).collect()} == {(f"w{i}", 200, 11) for i in range(5)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks(spark):
    counts = spark.createDataFrame([("a", 5, 1), ("b", 5, 3), ("c", 9, 21), ("d", 9, 20)], "term string, n_rows long, n_records long")
    assert {r["term"]: r["mark"] for r in marked(counts, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}
    assert {r["mark"] for r in marked(counts.where("term = 'a'"), 2).collect()} == {"rare"}
    assert term_counts(counts.where("false"), "term", "n_rows").count() == 0
