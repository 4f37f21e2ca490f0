"""How much a term marks a record: graph-of-words degree times rarity.

A record is a sequence of places. Places at most `window` apart are joined by
an edge, and a term weighs as much as it has distinct neighbours: saying it
twice in one spot adds nothing, saying it all over the record does. The weight
is multiplied by how rare the term is in the collection, ln((N + 1) / n).

`term_degrees` builds the edges of token sequences. An index keeps no sequence,
only how often a term stands (`count`) in a record and how many distinct words
that has (`length`), so edges of hits cannot be built; `most_neighbours` is the
degree that the count still allows, two neighbours an occurrence and no more
than the record has words. A term of full degree can stand beside every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.session import checkpointed, sized_broadcast


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is there; a plain sort beats hashing here."""
    values = np.sort(values)
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.diff(np.append(heads, len(values)))


def degrees(tokens: pa.ListArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term code, occurrences, distinct neighbours) of each term of each row, and the terms."""
    coded = tokens.flatten().dictionary_encode()
    lengths = np.asarray(tokens.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(tokens)), lengths)
    null = coded.indices.null_count
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if null:
        row, code = row[code >= 0], code[code >= 0]
    size = max(1, len(coded.dictionary))
    found, times = _distinct(row * size + code)
    node = np.searchsorted(found, row * size + code)
    edges = [np.zeros(0, np.int64)]
    for gap in range(1, window + 1):
        joined = np.flatnonzero((row[:-gap] == row[gap:]) & (code[:-gap] != code[gap:]))
        a, b = node[joined], node[joined + gap]
        edges += [a * len(found) + b, b * len(found) + a]
    pairs, _ = _distinct(np.concatenate(edges))
    near = np.bincount(pairs // max(1, len(found)), minlength=len(found))
    return found // size, found % size, times, near, coded.dictionary


def term_degrees(records: DataFrame, record: str, tokens: str, window: int = 4) -> DataFrame:
    """(record, term, n_times, degree) of every distinct term of every record.

    Edges are built inside the record, without a shuffle. A null or empty token
    array yields no rows; null tokens are skipped; a term alone in its record
    has degree 0; rows with the same record id stay apart.
    """
    schema = T.StructType([records.schema[record], T.StructField("term", T.StringType()), T.StructField("n_times", T.LongType()), T.StructField("degree", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, times, near, terms = degrees(batch.column(1), window)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), terms.take(pa.array(code)), pa.array(times, pa.int64()), pa.array(near, pa.int64())],
                names=[record, "term", "n_times", "degree"],
            )

    return records.select(record, F.col(tokens).cast("array<string>")).mapInArrow(work, schema)


def most_neighbours(count: Column, length: Column, window: int = 1) -> Column:
    """The greatest degree of a term with `count` occurrences in a record of `length` words.

    Null or below 1 on either side gives 0.
    """
    degree = F.least(count * (2 * window), length)
    return F.when((count >= 1) & (length >= 1), degree).otherwise(0).cast("long")


def rarity(n_records: Column, total: Column | int) -> Column:
    """ln((N + 1) / n); a term in no record is as rare as one in a single record."""
    whole = F.lit(total) if isinstance(total, int) else total
    return F.log((whole + 1) / F.greatest(n_records, F.lit(1)))


def weigh_hits(hits: DataFrame, lengths: DataFrame, counts: DataFrame, total: Column | int, window: int = 1) -> DataFrame:
    """Score of every (path_id, word) of `hits`.

    `hits`: path_id, word, count. `lengths`: path_id, length. `counts`: term,
    n_records. Result: path_id, word, count, length, n_paths, degree, score with
    score = degree / length * rarity. Of several hits of a word and path the
    largest count holds. Hits without word, path, count or length are left out.
    """
    best = (
        hits.where("path_id IS NOT NULL AND word IS NOT NULL AND count IS NOT NULL")
        .groupBy("path_id", "word").agg(F.max("count").alias("count"))
    )
    known = lengths.where("length > 0").select("path_id", "length")
    rare = counts.select(F.col("term").alias("word"), F.col("n_records").alias("n_paths"))
    rows = best.join(known, "path_id").join(rare, "word", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    rows = rows.withColumn("degree", most_neighbours(F.col("count"), F.col("length"), window))
    score = F.round(F.col("degree") / F.col("length") * rarity(F.col("n_paths"), total), 6)
    return rows.select("path_id", "word", "count", "length", "n_paths", "degree", score.alias("score"))


def _best_of_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of neighbouring rows of one record the `most` best; a run across two batches counts as two."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        record = batch.column(0)
        fresh = np.ones(n, bool)
        fresh[1:] = pc.fill_null(pc.not_equal(record[1:], record[:-1]), True).to_numpy(zero_copy_only=False)
        run = np.cumsum(fresh)
        order = pc.sort_indices(
            pa.table({"run": run, "score": batch.column("score"), "term": batch.column("term")}),
            sort_keys=[("run", "ascending"), ("score", "descending"), ("term", "ascending")],
        ).to_numpy()
        sorted_run = run[order]
        place = np.arange(n) - np.searchsorted(sorted_run, sorted_run)
        yield batch.take(pa.array(order[place < most]))


def key_terms(records: DataFrame, record: str, tokens: str, most: int = 3, window: int = 4) -> DataFrame:
    """(record, place, term, degree, n_records, score): the `most` terms that mark each record best.

    score = degree * rarity; equal scores in order of the term. Records are
    taken as they are: the same id twice is two records in one ranking. Terms
    of a record that stand together are cut down to the best before the
    ranking shuffles them. The records are checkpointed, since counts and
    degrees both read them.
    """
    rows = checkpointed(records.select(record, F.col(tokens).cast("array<string>").alias("__tokens")))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    held = rows.select(F.explode(F.array_distinct("__tokens")).alias("term")).where("term IS NOT NULL")
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"))
    weighed = term_degrees(rows, record, "__tokens", window).join(sized_broadcast(counts, 1_000_000), "term")
    score = F.round(F.col("degree") * rarity(F.col("n_records"), total), 6)
    weighed = weighed.select(record, "term", "degree", "n_records", score.alias("score"))
    few = weighed.mapInArrow(lambda batches: _best_of_runs(batches, most), weighed.schema)
    best = Window.partitionBy(record).orderBy(F.desc("score"), "term")
    ranked = few.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= most)
    return ranked.select(record, "place", "term", "degree", "n_records", "score")
