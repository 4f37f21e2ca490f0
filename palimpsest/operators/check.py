"""Integrity of an index as constraint queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schemas import CHECKS

LONGEST = 255


def _facts(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One pass over `rows`: per rule the number of violations and the least of what they are."""
    count = lambda i: F.coalesce(F.sum(F.when(F.col(f"b{i}"), F.col("__n"))), F.lit(0)).cast("long")
    flags = rows.select("__n", *[F.coalesce(bad, F.lit(False)).alias(f"b{i}") for i, (bad, _) in enumerate(rules.values())],
                        *[what.cast("string").alias(f"w{i}") for i, (_, what) in enumerate(rules.values())])
    facts = flags.agg(*[F.struct(F.lit(name).alias("check"), count(i).alias("violations"), F.min(F.when(F.col(f"b{i}"), F.col(f"w{i}"))).alias("sample")).alias(f"r{i}") for i, name in enumerate(rules)])
    return facts.select(F.explode(F.array(*facts.columns)).alias("r")).select("r.*")


def check(postings: DataFrame, paths: DataFrame, fresh: bool = False) -> DataFrame:
    """CHECKS: one row per constraint, with the number of violations and the least of them.

    `fresh`: the index comes from one full run, so that word counts must equal
    the words held. Additive merges keep old words, and then they need not.

    The postings are read once for what a row shows by itself, and once for
    what rows of a pair, then of a path, show together.
    """
    word, path_id, one = F.col("word"), F.col("path_id"), F.lit(1)
    total = F.broadcast(paths.agg(F.count(one).alias("__total")))  # one row
    found = _facts(postings.withColumn("__n", one), {
        "C1 word not empty": (word.isNull() | (F.length(word) < 1), F.coalesce(word, F.lit(""))),
        "C2 word not too long": (F.octet_length(word) > LONGEST, word),
        "C3 only a-z": (~word.rlike("^[a-z]*$"), word),
        "C5 letter is the first of the word": (~F.col("letter").eqNullSafe(F.substring(word, 1, 1)), word),
        "C11 path id not empty": (path_id.isNull() | (path_id < 1), F.coalesce(word, F.lit(""))),
    })
    pairs = postings.groupBy("path_id", "word").agg(F.count(one).alias("n"))
    by_path = pairs.groupBy("path_id").agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_twice"), F.min(F.when(F.col("n") > 1, word)).alias("twice"), F.lit(True).alias("posted")
    )
    ids = paths.groupBy("path_id").agg(F.count(one).alias("n_paths"), F.min("word_count").alias("low"), F.max("word_count").alias("high"), F.lit(True).alias("named"))
    both = by_path.join(ids.withColumnRenamed("path_id", "id"), F.col("path_id").eqNullSafe(F.col("id")), "full")
    both = both.withColumn("path_id", F.coalesce("path_id", "id"))
    known = F.col("n_paths").isNotNull()
    held = F.coalesce("n_rows", F.lit(0))
    found = found.unionByName(_facts(both.withColumn("__n", F.col("n_twice")), {"C4 no word twice for a path": (F.col("n_twice") > 0, F.col("twice"))}))
    found = found.unionByName(_facts(both.withColumn("__n", F.col("n_rows")), {"C9 path id known": (F.col("posted") & ~known & path_id.isNotNull() & (path_id >= 1), path_id)}))
    rules = {"C6 path id unique": (F.col("n_paths") > 1, path_id)}
    if fresh:
        rules["C7 word count right"] = (known & ((F.col("low") != held) | (F.col("high") != held)), path_id)
    found = found.unionByName(_facts(both.withColumn("__n", one), rules))
    found = found.unionByName(_facts(paths.withColumn("__n", one).join(total), {
        "C6 path ids 1 to n": (path_id.isNull() | (path_id < 1) | (path_id > F.col("__total")), path_id),
        "C7 word count given": (F.col("word_count").isNull() | (F.col("word_count") < 0), path_id),
    }))
    by_name = paths.groupBy("path").agg(F.count(one).alias("n")).withColumn("__n", one)
    found = found.unionByName(_facts(by_name, {"C6 path given and unique": (F.col("path").isNull() | (F.col("n") > 1), F.coalesce(F.col("path"), F.lit("")))}))
    return found.withColumn("ok", F.col("violations") == 0).select(*CHECKS.names)


def report(checks: DataFrame) -> str:
    bad = [r for r in checks.orderBy("check").collect() if not r["ok"]]
    if not bad:
        return "No corruption found."
    return "\n".join(f"{r['check']}: {r['violations']} violations, such as {r['sample']}" for r in bad)
