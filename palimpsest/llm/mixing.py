"""Mixing sources to target shares of the total size.

The largest total is taken that the targets allow: the scarcest source, read
as often as it may be, settles it. A source then contributes whole passes over
its documents and a last, partial one, to within half a document of its share.

A source's documents stand in a random order, cut into blocks of about
BLOCK_TOKENS. One block of one pass is a unit. How many units of each source an
output shard gets is drawn by a splitting tree: the units of a node are split
between its two halves by a multivariate hypergeometric draw, down to single
shards, so that the quotas add up exactly and look like one large shuffle.
Every node draws from a generator seeded by its address, so an executor finds
the shard of a unit by walking down from the root, and no table of quotas is
made anywhere. Units are dealt in an order permuted by a keyed Feistel network,
which makes the draws disjoint, and each shard is shuffled in itself. Places
inside a source come from stitched prefix sums: no source, however large,
meets in one task.

Defined cases: rows with a null id or source, or a source without target, take
no part; repeated rows count once; null text has no tokens; targets are
renormalised over the sources that have tokens; a target that is null or not
above 0 takes nothing, repeats that are null or below 1 count as 1; without
tokens or targets the mixture is empty.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.operators.heavy_keys import with_prefix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the rank files of byte-level BPE split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 20_000
SHARD_TOKENS = 1_000_000
MAX_TARGETS = 10_000
SAMPLER = 10**9  # numpy's hypergeometric sampler takes less than so many

MIXTURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()),
    T.StructField("copy", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()),
])


@cache
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the public tokenizer whose rank file is at `path`, on every executor. Null has 0."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = _tokenizer(path).encode_ordinary
        return pa.array([0 if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return count(text)


@dataclass(frozen=True)
class Quota:
    source: str
    share: float  # of the mixture, as aimed at
    size: int  # tokens of the source
    want: int  # tokens of it in the mixture
    passes: int  # whole ones
    rest: int  # tokens of the partial pass


def quotas(targets: dict[str, tuple[float, int]], sizes: dict[str, int], total: int | None = None) -> list[Quota]:
    """What to take of each source. `targets`: share and most repeats. `total` limits the mixture."""
    open_ = {s: (t, max(1, m)) for s, (t, m) in targets.items() if t > 0 and sizes.get(s, 0) > 0}
    whole = sum(t for t, _ in open_.values())
    if not open_:
        return []
    most = min(m * sizes[s] * whole / t for s, (t, m) in open_.items())
    most = min(most, total) if total is not None else most
    out = []
    for s, (t, m) in sorted(open_.items()):
        want = min(round(most * t / whole), m * sizes[s])
        out.append(Quota(s, t / whole, sizes[s], want, want // sizes[s], want % sizes[s]))
    return out


def node_draw(held: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Units of each source that the left half of the node over shards first..last-1 gets of those it holds."""
    rng = np.random.default_rng([seed, first, last])
    left, total = (first + last) // 2 - first, int(held.sum())
    return multivariate(held, total * left // (last - first), rng)


def multivariate(held: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, one source at a time (the draws of each are hypergeometric)."""
    out, rest = np.zeros_like(held), int(held.sum())
    for i, n in enumerate(held.tolist()):
        rest -= n
        if take and n:
            out[i] = hypergeometric(n, rest, take, rng)
        take -= int(out[i])
    return out


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` units drawn from `good` and `bad` ones are good."""
    if good < SAMPLER and bad < SAMPLER:
        return int(rng.hypergeometric(good, bad, take))
    return by_rejection(good, bad, take, rng)


def by_rejection(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """The same distribution by ratio of uniforms under its density, for numbers of any size."""
    total = good + bad
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mean = take * good / total
    spread = math.sqrt(max(0.0, mean * (bad / total) * (total - take) / max(1, total - 1)) + 0.5)
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))

    def log_density(k: int) -> float:
        """Relative to the mode, by ratios of factorials that are near each other."""
        rises = ((good, mode, k), (bad, take - mode, take - k))
        return sum(_log_choose_ratio(n, a, b) for n, a, b in rises)

    width = 1.7156 * spread + 0.8989  # fixed values: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), which cover the density
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / u
        if low <= x < high + 1 and 2 * math.log(u) <= log_density(int(x)):
            return int(x)


def _log_choose_ratio(n: int, a: int, b: int) -> float:
    """log of (n choose b) over (n choose a), exact to rounding also where both are huge."""
    return _log_factorial_ratio(a, b) + _log_factorial_ratio(n - a, n - b)


def _log_factorial_ratio(a: int, b: int) -> float:
    """log(a! / b!)."""
    if abs(a - b) < 64:
        low, high = sorted((a, b))
        value = sum(math.log(x) for x in range(low + 1, high + 1))
        return value if a > b else -value
    if min(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    # Stirling's series, with what is near equal taken together
    x, y = a + 0.5, b + 0.5
    return (a - b) * math.log(y) + x * math.log1p((a - b) / y) - (a - b) - (1 / x - 1 / y) / 24


def shards_of(source: int, unit: np.ndarray, units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard of each unit of a source, by walking the splitting tree: all units at a node go down together."""
    out = np.zeros(len(unit), np.int64)
    nodes = [(0, shards, units.astype(np.int64), np.arange(len(unit)), unit.astype(np.int64))]
    while nodes:
        first, last, held, which, place = nodes.pop()
        if last - first == 1:
            out[which] = first
            continue
        left = node_draw(held, first, last, seed)
        down = place < left[source]
        middle = (first + last) // 2
        if down.any():
            nodes.append((first, middle, left, which[down], place[down]))
        if not down.all():
            nodes.append((middle, last, held - left, which[~down], place[~down] - left[source]))
    return out


def permuted(unit: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed random permutation of 0..count-1 at `unit`: a Feistel network, walked until inside."""
    if count < 2:
        return unit
    half = max(1, ((count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, outside = unit.astype(np.uint64), np.arange(len(unit))
    while len(outside):
        x = out[outside]
        for turn in range(8):
            mixed = (x & mask) + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2**64 - 1))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = ((x & mask) << np.uint64(half)) | ((x >> np.uint64(half)) ^ ((mixed >> np.uint64(20)) & mask))
        out[outside] = x
        outside = outside[x >= count]
    return out.astype(np.int64)


def mixture(
    documents: DataFrame, targets: DataFrame, doc: str, source: str, text: str, total: int | None = None,
    tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 1,
) -> DataFrame:
    """(doc_id, source, tokens, copy, shard, place): the documents of the mixture, in `place` order in each `shard`."""
    spark = documents.sparkSession
    aims = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_TARGETS + 1).collect()
    if len(aims) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources")
    goal = {r[0]: (r[1] or 0.0, r[2] or 1) for r in aims}
    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).alias("source"), text)
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(goal)))
    sized = (
        rows.select("doc_id", "source", token_count(F.col(text), tokenizer).alias("tokens"))
        .groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))
        .withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
    )
    placed = with_prefix(sized, ["source"], ["turn", "doc_id"], weight="tokens")
    sizes = {r[0]: r[1] for r in placed.groupBy("source").agg(F.sum("tokens")).collect()}
    plan = quotas(goal, sizes, total)
    if not plan:
        return spark.createDataFrame([], MIXTURE)
    per_pass = np.array([-(-q.size // block_tokens) for q in plan], np.int64)
    last_pass = np.array([-(-q.rest // block_tokens) for q in plan], np.int64)
    units = np.array([q.passes for q in plan], np.int64) * per_pass + last_pass
    shards = max(1, round(sum(q.want for q in plan) / shard_tokens))
    number = {q.source: i for i, q in enumerate(plan)}

    parts = spark.createDataFrame(
        [(q.source, number[q.source], q.passes, q.rest) for q in plan], "source string, number int, passes long, rest long"
    )
    # of the partial pass come the documents whose middle lies before its end: no source is off by more than half a document
    times = F.col("passes") + F.when((F.col("before") + F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    copies = (
        placed.join(F.broadcast(parts), "source")
        .withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
        .withColumn("block", F.expr(f"before div {block_tokens}"))
    )

    @F.arrow_udf(T.LongType())
    def shard_of(number: pa.Array, copy: pa.Array, block: pa.Array) -> pa.Array:
        n, c, b = (x.to_numpy(zero_copy_only=False) for x in (number, copy, block))
        out = np.zeros(len(n), np.int64)
        for i in np.unique(n):
            own = n == i
            unit, back = np.unique(np.minimum(c[own] * per_pass[i] + b[own], units[i] - 1), return_inverse=True)
            place = permuted(unit, int(units[i]), seed * MAX_TARGETS + int(i))
            out[own] = shards_of(int(i), place, units, shards, seed)[back]
        return pa.array(out)

    dealt = copies.withColumn("shard", shard_of("number", "copy", "block"))
    # a shard is bounded by its tokens, so its order may be settled in one task
    turn = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(~seed)), "doc_id", "copy")
    return dealt.select("doc_id", "source", "tokens", "copy", "shard", (F.row_number().over(turn) - 1).cast("long").alias("place"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, n_docs, most_copies): what the mixture came to, for each row of `targets`."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("n_docs"), (F.max("copy") + 1).alias("most_copies"))
    tokens = F.coalesce("tokens", F.lit(0))
    # one row per source of the mixture, of which there are at most MAX_TARGETS
    whole = by.withColumn("__share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    return targets.select("source", "target_share").join(whole, "source", "left").select(
        "source", "target_share", tokens.alias("tokens"), F.round(F.coalesce("__share", F.lit(0.0)), 6).alias("share"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def kept_rules(mixed: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(source, target_share, near, within_repeats, n_twice) for each row of `targets`: whether the share is
    within `tolerance`, whether no document comes oftener than it may, and places or copies that are there twice."""
    by = mixed.groupBy("source").agg(
        F.sum("tokens").alias("__tokens"), (F.max("copy") + 1).alias("__most"),
        (2 * F.count(F.lit(1)) - F.count_distinct("doc_id", "copy") - F.count_distinct("shard", "place")).alias("__twice"),
    )
    whole = by.withColumn("__share", F.col("__tokens") / F.sum("__tokens").over(Window.partitionBy()))
    return targets.join(whole, "source", "left").select(
        "source", "target_share", (F.abs(F.coalesce("__share", F.lit(0.0)) - F.col("target_share")) <= tolerance).alias("near"),
        (F.coalesce("__most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("__twice", F.lit(0)).alias("n_twice"),
    )
