"""Taking new documents into an index, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.heavy_keys import with_prefix
from palimpsest.operators.postings import first_letter


def path_changes(old: DataFrame, fresh: DataFrame, last: int | None = None) -> DataFrame:
    """PATHS rows that a merge adds or renews. `fresh`: path, word_count, mtime, each path once.

    A known path keeps its id and gets the new count and time; new paths get
    the next ids in order of the path. `last`: the highest id of `old`.
    """
    known = fresh.join(old.select("path", "path_id"), "path", "left")
    if last is None:
        last = old.agg(F.coalesce(F.max("path_id"), F.lit(0))).first()[0]
    columns = ("path_id", "path", "word_count", "mtime")
    added = with_prefix(known.where("path_id IS NULL").drop("path_id"), [], ["path"]).withColumn("path_id", F.col("rank") + last + 1)
    return known.where("path_id IS NOT NULL").select(*columns).unionByName(added.select(*columns))


def numbered_paths(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """PATHS after a merge: `old` with the changes that `fresh` makes."""
    kept = old.join(fresh.select("path"), "path", "left_anti").select("path_id", "path", "word_count", "mtime")
    return kept.unionByName(path_changes(old, fresh))


def pairs(tokenized: DataFrame, paths: DataFrame) -> DataFrame:
    """POSTINGS of (path, words) rows, each path once and its words distinct.

    Ids are joined while a path is still one row, so that no path travels with
    every word.
    """
    rows = tokenized.select("path", "words").join(paths.select("path", "path_id"), "path")
    flat = rows.select("path_id", F.explode("words").alias("word"))
    return flat.select(first_letter(F.col("word")).alias("letter"), "word", "path_id")


def unknown_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Postings of `new` that `old` lacks: all that an additive merge has to write."""
    return new.join(old.select("word", "path_id"), ["word", "path_id"], "left_anti").select("letter", "word", "path_id")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two sets of postings. Nothing is ever removed; merging again changes nothing."""
    return old.unionByName(unknown_pairs(new, old))


def without_paths(postings: DataFrame, paths: DataFrame) -> DataFrame:
    """Postings of other paths than those: what a replacing merge keeps."""
    return postings.join(paths.select("path_id"), "path_id", "left_anti").select("letter", "word", "path_id")
