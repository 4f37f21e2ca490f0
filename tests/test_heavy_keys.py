import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsest.operators.heavy_keys import heavy_keys, key_counts, key_lists, pair_counts, with_prefix


def rows_of(rng, n=3000):
    """A third of the rows has one key; ties, repeats and nulls in every column."""
    out = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice([None, "", "a", "b", "c", "dé"])
        out.append((key, rng.choice([None, *range(400)]), rng.choice([None, 0, 1, 5, -2]), rng.choice(["x", None])))
    return out


SCHEMA = "k string, v long, w long, n string"


def test_counts_equal_plain(spark):
    rows = rows_of(random.Random(1))
    got = {r["k"]: (r["n_rows"], r["n_values"]) for r in key_counts(spark.createDataFrame(rows, SCHEMA), ["k"], ["v"], parts=7).collect()}
    want = {k: (sum(r[0] == k for r in rows), len({r[1] for r in rows if r[0] == k and r[1] is not None})) for k in {r[0] for r in rows}}
    assert got == want


def test_prefix_equals_plain(spark):
    rows = rows_of(random.Random(2))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = with_prefix(df, ["k"], ["v"], weight="w", parts=9)
    by = defaultdict(list)
    for r in out.collect():
        by[r["k"]].append(r)
    assert Counter((r["k"], r["v"], r["w"], r["n"]) for v in by.values() for r in v) == Counter(rows)
    for group in by.values():
        group.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in group] == list(range(len(group)))
        order = [(r["v"] is not None, r["v"] or 0) for r in group]
        assert order == sorted(order)
        total = 0
        for r in group:
            assert r["before"] == total
            total += r["w"] or 0


def test_a_heavy_key_is_spread_and_unions_keep_ranks(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), "id")
    out = with_prefix(df, ["k"], ["id"], parts=8)
    assert out.rdd.getNumPartitions() == 8
    sizes = [n for n in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
    assert max(sizes) < 1500
    both = spark.range(10).select(F.lit("z").alias("k"), "id", F.col("id").alias("rank"), F.lit(0).cast("long").alias("before")).unionByName(out)
    assert both.where("k = 'k' AND rank <> id").count() == 0


def test_no_keys_is_one_order(spark):
    out = with_prefix(spark.range(100).repartition(4), [], ["id"], parts=6)
    assert out.where("rank <> id").count() == 0


def test_lists(spark):
    rows = rows_of(random.Random(3), 500)
    got = defaultdict(list)
    for r in key_lists(spark.createDataFrame(rows, SCHEMA), "k", "v", chunk=10, parts=5).orderBy("chunk_no").collect():
        assert r["n_values"] == len(r["values"]) <= 10 and (r["first_value"], r["last_value"]) == (r["values"][0], r["values"][-1])
        got[r["k"]] += r["values"]
    assert got == {k: sorted({r[1] for r in rows if r[0] == k and r[1] is not None}) for k in {r[0] for r in rows}}


def test_heavy_and_empty(spark):
    df = spark.createDataFrame(rows_of(random.Random(4)), SCHEMA)
    assert [r["k"] for r in heavy_keys(df, ["k"], ["v"], 0.25).collect()] == ["hot"]
    pairs = pair_counts(df, ["k", "v"])
    assert [r["k"] for r in heavy_keys(pairs, ["k"], ["v"], 0.25, "n").collect()] == ["hot"]
    assert heavy_keys(pairs.where("false"), ["k"], ["v"], 0.1, "n").count() == 0
    empty = df.where("false")
    assert heavy_keys(empty, ["k"], ["v"], 0.1).count() == 0 and with_prefix(empty, ["k"], ["v"]).count() == 0
    assert key_lists(empty, "k", "v").count() == 0


def test_a_pair_with_a_third_of_all_rows_is_spread_and_counted_once(spark):
    rows = [("hot", 7)] * 2000 + [("hot", i) for i in range(500)] + [(f"k{i % 300}", i % 5) for i in range(3000)] + [("hot", None)] * 600 + [(None, None)] * 700
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    want = {k: (sum(r[0] == k for r in rows), len({r[1] for r in rows if r[0] == k and r[1] is not None})) for k in {r[0] for r in rows}}
    for parts in (1, 3, 16, 64):
        assert {r["k"]: (r["n_rows"], r["n_values"]) for r in key_counts(df, ["k"], ["v"], parts=parts).collect()} == want
    two = key_counts(df, ["k", "v"], ["v"], parts=9)
    assert two.where("n_rows = 2001 AND n_values = 1").count() == 1 and two.agg(F.sum("n_rows")).first()[0] == len(rows)
