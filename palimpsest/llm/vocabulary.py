"""Occurrences and records of every term, by last-seen counters.

Tokens are hash-partitioned on the term and a bucket of the record, so that
all tokens of a (term, record) pair meet in one partition while a term with a
third of all tokens spreads over all of them. Inside a partition they come
ordered by record, and each term keeps three numbers: its occurrences, its
records, and the record that it was last seen in. No set of records is kept.
The partial counters, at most one per term and partition, are then added up.

Defined cases: rows with a null term or a null record are left out; empty text
is a term like any other; repeated rows are occurrences; an empty table gives
no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import shuffle_partitions


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[str, int] = {}
    seen = np.zeros((3, 1024), np.int64)  # occurrences, records, last record
    place, previous = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        known = np.array([ids.setdefault(t, len(ids)) for t in coded.dictionary.to_pylist()], np.int64)
        term = known[coded.indices.to_numpy(zero_copy_only=False)]
        record = batch.column(1)
        fresh = np.ones(len(record), np.int64)
        fresh[1:] = pc.not_equal(record[1:], record[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = previous is None or record[0].as_py() != previous
        number = place + np.cumsum(fresh)
        place, previous = int(number[-1]), record[-1].as_py()
        if len(ids) > seen.shape[1]:
            seen = np.concatenate((seen, np.zeros((3, len(ids)), np.int64)), axis=1)
        by_term = np.argsort(term, kind="stable")
        t, n = term[by_term], number[by_term]
        first = np.concatenate(([True], t[1:] != t[:-1]))
        new = np.concatenate(([True], n[1:] != n[:-1]))
        new = np.where(first, seen[2, t] != n, new)
        width = len(ids)
        seen[0, :width] += np.bincount(t, minlength=width)
        seen[1, :width] += np.bincount(t[new], minlength=width)
        seen[2, t] = n
    if ids:
        terms = pa.array(list(ids), pa.string())
        yield pa.RecordBatch.from_arrays(
            [terms, pa.array(seen[0, : len(ids)]), pa.array(seen[1, : len(ids)])], names=["term", "n_rows", "n_records"]
        )


def term_counts(tokens: DataFrame, term: str, record: str, parts: int | None = None) -> DataFrame:
    """(term, n_rows, n_records) of every distinct term."""
    n = parts or shuffle_partitions(tokens.sparkSession)
    rows = tokens.select(F.col(term).cast("string").alias("term"), F.col(record).alias("record")).where(
        "term IS NOT NULL AND record IS NOT NULL"
    )
    ordered = rows.repartition(n, "term", F.pmod(F.xxhash64("record"), F.lit(n))).sortWithinPartitions("record")
    counted = ordered.mapInArrow(_last_seen, "term string, n_rows long, n_records long")
    return counted.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def record_count(tokens: DataFrame, term: str, record: str) -> Column:
    """Distinct records with a term, as a scalar of the plan that it is used in: nothing runs before that does."""
    return tokens.where(F.col(term).isNotNull()).agg(F.count_distinct(F.col(record)).alias("n")).scalar()


def marked(counts: DataFrame, n_records: Column | int, rare: int = 2, common: float = 0.2) -> DataFrame:
    """`counts` with `mark`: ``rare`` in at most `rare` records, ``common`` in more than
    the share `common` of all `n_records`, null between. Where both hold, ``rare``."""
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.lit(common) * n_records, "common")
    return counts.withColumn("mark", mark.cast(T.StringType()))
