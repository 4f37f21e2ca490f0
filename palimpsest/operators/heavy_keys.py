"""Per-key results when a few keys hold most of the rows.

Rows are range-partitioned on the composite (key, order) with quantiles that
Spark samples, so a heavy key is spread over as many partitions as its share
of the rows asks for. Every partition works out partial states of its own
stretch; the states of keys that cross a boundary are stitched afterwards.

Defined cases, for all functions here: a null key is a key of its own; a null
order value sorts first; repeated rows stay separate rows and are ranked next
to each other in no fixed order; an empty input gives an empty result; other
columns are carried along untouched (their names must not start with ``__``;
columns named like a result are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import checkpointed, shuffle_partitions

_STATE = (
    "part int, n long, first_key long, first_n long, first_w long, "
    "last_key long, last_n long, last_w long, one_key boolean"
)


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """`df` range-partitioned on keys and order, sorted inside partitions."""
    n = parts or shuffle_partitions(df.sparkSession)
    by = [F.col(c) for c in (*keys, *order)]
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _key_states(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One partial state per key of a sorted range partition, as they come: the first and the last are edges.

    Columns in: the key columns, then hash of the key, rows, values. The state
    of the key that a batch ends with is held back until the next key comes.
    """
    width = len(names)
    held, first = None, True  # named columns, hash, rows, values

    def state(named, edge, rows, values) -> pa.RecordBatch:
        columns = [pa.array(np.asarray(edge, bool)), pa.array(np.asarray(rows, np.int64)), pa.array(np.asarray(values, np.int64))]
        return pa.RecordBatch.from_arrays([*named, *columns], names=[*names, "__edge", "n_rows", "n_values"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, v = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        rows, values = np.add.reduceat(n, starts), np.add.reduceat(v, starts)
        named = [batch.column(i).take(pa.array(starts)) for i in range(width)]
        if held is not None:
            if held[1] == key[0]:
                rows[0] += held[2]
                values[0] += held[3]
            else:
                yield state(held[0], [first], [held[2]], [held[3]])
                first = False
        done = len(starts) - 1
        if done:
            edge = np.zeros(done, bool)
            edge[0], first = first, False
            yield state([c.slice(0, done) for c in named], edge, rows[:done], values[:done])
        held = ([c.slice(done, 1) for c in named], key[-1], int(rows[-1]), int(values[-1]))
    if held is not None:
        yield state(held[0], [True], [held[2]], [held[3]])


def key_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, times: str | None = None) -> DataFrame:
    """(keys, n_rows, n_values): rows and distinct order values of each key.

    Equal (key, order) pairs are counted together before anything is spread,
    so that even a pair with a third of all rows takes up one row. Pairs are
    range-partitioned on key and order; each partition states what it holds of
    each key. Only its first and its last key can go on in a neighbour, and
    only those states, at most two a partition, are shuffled and stitched. The
    states are checkpointed, since both halves must see the same boundaries.
    `n_values` counts the distinct non-null combinations of the order columns.
    With `times`, `df` has each pair once already, and that column says how
    often it stands for a row.
    """
    own = [*keys, *[c for c in order if c not in keys]]
    pairs = df.select(*own, F.col(times).alias("__n")) if times else df.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"))
    held = F.lit(True)
    for c in order:
        held = held & F.col(c).isNotNull()
    nulls = [F.col(c).isNull() for c in keys]
    stated = spread(pairs, keys, [c for c in order if c not in keys], parts).select(
        *keys, F.xxhash64(F.lit(0), *keys, *nulls).alias("__key"), "__n", held.cast("long").alias("__values")
    )
    counts = [("__edge", T.BooleanType()), ("n_rows", T.LongType()), ("n_values", T.LongType())]
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, k) for c, k in counts)])
    names = list(keys)
    states = checkpointed(stated.mapInArrow(lambda batches: _key_states(batches, names), schema))
    stitched = states.where("__edge").groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))
    return states.where("NOT __edge").drop("__edge").unionByName(stitched)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per range partition: its first and its last key, with their rows and weights."""
    n = part = 0
    first = last = None
    first_n = first_w = last_n = last_w = 0
    one = True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        weight = batch.column(1).to_numpy(zero_copy_only=False)
        part = batch.column(2)[0].as_py()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        ends = np.append(cuts, len(key))
        sums = np.concatenate(([0], np.cumsum(weight)))
        if first is None:
            first = last = key[0]
        elif key[0] != last:
            one, last, last_n, last_w = False, key[0], 0, 0
        if one:
            first_n += int(ends[0])
            first_w += int(sums[ends[0]])
        if len(cuts):
            one, last, last_n, last_w = False, key[-1], 0, 0
            last_n, last_w = int(len(key) - cuts[-1]), int(sums[-1] - sums[cuts[-1]])
        else:
            last_n += len(key)
            last_w += int(sums[-1])
        n += len(key)
    if n:
        yield pa.RecordBatch.from_pylist(
            [dict(part=part, n=n, first_key=int(first), first_n=first_n, first_w=first_w,
                  last_key=int(last), last_n=last_n, last_w=last_w, one_key=one)],
            schema=pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in
                             ("n", "first_key", "first_n", "first_w", "last_key", "last_n", "last_w")),
                             ("one_key", pa.bool_())]),
        )


def _carried(states: list) -> dict[int, tuple[int, int, int]]:
    """For each partition: the key it may go on with, and what came before."""
    carry: dict[int, tuple[int, int, int]] = {}
    key, n, w = None, 0, 0
    for s in sorted(states, key=lambda x: x["part"]):
        if key is not None and s["first_key"] == key:
            carry[s["part"]] = (key, n, w)
        else:
            n = w = 0
        if s["one_key"]:
            key, n, w = s["last_key"], n + s["last_n"], w + s["last_w"]
        else:
            key, n, w = s["last_key"], s["last_n"], s["last_w"]
    return carry


def with_prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None, parts: int | None = None
) -> DataFrame:
    """`df` with ``rank`` (0-based place in its key) and ``before`` (sum of
    `weight` over the earlier rows of the key; a null weight counts 0).

    Equivalent to two window functions partitioned by key, without one task
    per key. The spread rows are checkpointed, since both passes must see the
    same partitions. The driver gathers one state per partition, not per key.
    """
    own = [c for c in df.columns if c not in ("rank", "before")]
    slim = df.select(
        F.xxhash64(F.lit(0), *[F.col(c) for c in keys]).alias("__key"),
        F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("__w") if weight else F.lit(1).cast("long").alias("__w"),
        *own,
    )
    # the number of a range partition is kept as a column: a task's own number is another one inside a union
    numbered = spread(slim, keys, order, parts).select("__key", "__w", F.spark_partition_id().alias("__part"), *own)
    ranged = checkpointed(numbered)
    carry = _carried(ranged.select("__key", "__w", "__part").mapInArrow(_states, _STATE).collect())
    schema = T.StructType([*df.select(*own).schema.fields, T.StructField("rank", T.LongType()), T.StructField("before", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, w = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(2)[0].as_py()
                last, n, w = carry.get(part, (None, 0, 0))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            sums = np.concatenate(([0], np.cumsum(weights)))
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            lengths = np.diff(np.append(starts, len(key)))
            base = np.repeat(starts, lengths)
            rank, before = np.arange(len(key)) - base, sums[:-1] - sums[base]
            if last is not None and key[0] == last:
                rank[: lengths[0]] += n
                before[: lengths[0]] += w
            last, n, w = key[-1], int(rank[-1]) + 1, int(before[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(rank, pa.int64()), pa.array(before, pa.int64())],
                names=[*own, "rank", "before"],
            )

    return ranged.mapInArrow(number, schema)


def key_lists(df: DataFrame, key: str, value: str, chunk: int = 10_000, parts: int | None = None) -> DataFrame:
    """(key, chunk_no, n_values, first_value, last_value, values): the sorted
    distinct non-null values of each key, in chunks of `chunk` values.

    The posting list of a word, however long, never gathers in one task; a key
    whose values are all null has no list.
    """
    pairs = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    ranked = with_prefix(pairs, [key], [value], parts=parts)
    listed = F.sort_array(F.collect_list(value))
    return (
        ranked.withColumn("chunk_no", F.floor(F.col("rank") / chunk).cast("long"))
        .groupBy(key, "chunk_no")
        .agg(listed.alias("values"))
        .select(
            key, "chunk_no", F.size("values").cast("long").alias("n_values"),
            F.element_at("values", 1).alias("first_value"), F.element_at("values", -1).alias("last_value"), "values",
        )
    )


def pair_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n): how often each combination stands in `rows`; checkpointed, for several `heavy_keys` to read."""
    return checkpointed(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))


def heavy_keys(rows: DataFrame, keys: Sequence[str], order: Sequence[str], share: float, times: str | None = None) -> DataFrame:
    """Keys (with n_rows, n_values) that hold more than `share` of all `rows`. `times`: as for `key_counts`."""
    total = rows.agg(F.coalesce(F.sum(times) if times else F.count(F.lit(1)), F.lit(0)).alias("t")).scalar()
    return key_counts(rows, keys, order, times=times).where(F.col("n_rows") > F.lit(share) * total)
