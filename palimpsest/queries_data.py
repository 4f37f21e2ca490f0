"""Queries over the index tables with the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.heavy_keys import heavy_keys, key_counts, key_lists, pair_counts
from palimpsest.operators.incremental import replay
from palimpsest.session import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return replay(read_table(spark, folder, "scan_listing"), read_table(spark, folder, "run_config"))


P3_FOUND = """
WITH ok AS (SELECT DISTINCT run_id, index_path, started_at, coalesce(config_updated_files_only, 'true') = 'true' AS only_new
            FROM run_config WHERE status = 'ok'),
seen AS (SELECT DISTINCT l.run_id, l.path, l.mtime, l.length, o.index_path, o.started_at, o.only_new
         FROM scan_listing l JOIN ok o ON l.run_id = o.run_id),
prev AS (SELECT *, lag(run_id) OVER w AS before, lag(mtime) OVER w AS m0, lag(length) OVER w AS l0
         FROM seen WINDOW w AS (PARTITION BY index_path, path ORDER BY started_at, run_id))
SELECT run_id, path FROM prev
WHERE only_new AND (before IS NULL OR m0 IS DISTINCT FROM mtime OR l0 IS DISTINCT FROM length)
"""


def valid_postings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings").select("word", "path_id").where("word IS NOT NULL AND path_id <> 0")


def reversed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """words_reversed laid flat; a repeated row (same entry_id) counts once."""
    entries = read_table(spark, folder, "words_reversed").where("word IS NOT NULL").dropDuplicates(["entry_id"])
    return entries.select("word", F.explode("reversed").alias("path_id")).where("path_id <> 0")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pair_counts(valid_postings(spark, folder), ["word", "path_id"])
    words = heavy_keys(pairs, ["word"], ["path_id"], 0.015, "n").select(F.lit("word").alias("field"), F.col("word").alias("value"))
    paths = heavy_keys(pairs, ["path_id"], ["word"], 0.015, "n").select(
        F.lit("path_id").alias("field"), F.col("path_id").cast("string").alias("value")
    )
    return words.unionByName(paths)


P6_FOUND = """
WITH p AS (SELECT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0)
SELECT 'word' AS field, word AS value FROM p GROUP BY word HAVING count(*) > 0.015 * (SELECT count(*) FROM p)
UNION ALL
SELECT 'path_id', CAST(path_id AS VARCHAR) FROM p GROUP BY path_id HAVING count(*) > 0.015 * (SELECT count(*) FROM p)
"""


def p6_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return key_counts(valid_postings(spark, folder), ["word"], ["path_id"])


P6_WORD_COUNTS = """
SELECT word, count(*) AS n_rows, count(DISTINCT path_id) AS n_values
FROM postings WHERE word IS NOT NULL AND path_id <> 0 GROUP BY word
"""


def p6_path_counts(spark: SparkSession, folder: str) -> DataFrame:
    return key_counts(valid_postings(spark, folder), ["path_id"], ["word"])


P6_PATH_COUNTS = """
SELECT path_id, count(*) AS n_rows, count(DISTINCT word) AS n_values
FROM postings WHERE word IS NOT NULL AND path_id <> 0 GROUP BY path_id
"""


def p6_reversed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return key_counts(reversed_pairs(spark, folder), ["word"], ["path_id"])


P6_REVERSED_COUNTS = """
SELECT word, count(*) AS n_rows, count(DISTINCT path_id) AS n_values
FROM (SELECT word, unnest(reversed) AS path_id
      FROM (SELECT DISTINCT ON (entry_id) entry_id, word, reversed FROM words_reversed WHERE word IS NOT NULL))
WHERE path_id <> 0 GROUP BY word
"""


def p6_word_lists(spark: SparkSession, folder: str) -> DataFrame:
    return key_lists(valid_postings(spark, folder), "word", "path_id", chunk=1000)


P6_WORD_LISTS = """
WITH r AS (SELECT word, path_id, (row_number() OVER (PARTITION BY word ORDER BY path_id) - 1) // 1000 AS chunk_no
           FROM (SELECT DISTINCT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0))
SELECT word, chunk_no, count(*) AS n_values, min(path_id) AS first_value, max(path_id) AS last_value,
       list(path_id ORDER BY path_id) AS "values"
FROM r GROUP BY word, chunk_no
"""


def p6_path_lists(spark: SparkSession, folder: str) -> DataFrame:
    return key_lists(valid_postings(spark, folder), "path_id", "word", chunk=1000)


P6_PATH_LISTS = """
WITH r AS (SELECT path_id, word, (row_number() OVER (PARTITION BY path_id ORDER BY word) - 1) // 1000 AS chunk_no
           FROM (SELECT DISTINCT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0))
SELECT path_id, chunk_no, count(*) AS n_values, min(word) AS first_value, max(word) AS last_value,
       list(word ORDER BY word) AS "values"
FROM r GROUP BY path_id, chunk_no
"""

QUERIES = {
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p6_word_counts": p6_word_counts,
    "p6_path_counts": p6_path_counts,
    "p6_reversed_counts": p6_reversed_counts,
    "p6_word_lists": p6_word_lists,
    "p6_path_lists": p6_path_lists,
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
