"""Evaluation passages in training text, by suffix arrays over shards of the text.

Every shard of the training text (some megabytes of whole documents) is turned
into folded words and gets a suffix array: all its suffixes in order of their
words, by prefix doubling over what is still tied. Every suffix of every
evaluation item is binary-searched in it, word by word, and each match is
followed in both directions to its longest verbatim extent, which comes out
with its place in the document and in the item. A match that is long enough is
a finding; a shorter one is compared further along its diagonal, so that a
passage with single words exchanged is found as well.

A stretch of n words with at most n // 10 exchanged always holds a run of
`search_depth(n)` equal words, so the search by that many words is complete:
6 for the default stretch of 20, all of them for items under ten words.

Remarks in brackets may interrupt a passage or be one: a document that has any
is searched twice, with them and without, and so is an item. Nothing depends
on how documents fall into shards, batches or partitions.

Stock formulas are no passage of an item. A match is dropped only where all of
it is formula: every SEED words in a row of it stand in at least FORMULA_ITEMS
items of different text, and more than FORMULA_TEXTS different folded texts of
the whole corpus hold them in a match of which nothing else is left. A match
with other words of the item in it always counts, as does a passage of one
item, however many documents hold it.

Items are the stated query set; they are sent out in blocks of bounded size,
PASS_BLOCKS of them to one pass over the documents, which never leave their
task.

Defined cases: null texts and null ids are left out; an item shorter than the
stretch counts where all of it is found, an item without words never; repeated
documents or items give one row; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.codepoints import slices
from palimpsest.llm.words import forms, joined_lines, word_hashes
from palimpsest.session import checkpointed

SEED = 6
FORMULA_ITEMS = 3  # items of different text that share a formula of the house
FORMULA_TEXTS = 8  # different texts that may hold such words and nothing else of an item
STRETCH = 20
BLOCK_BYTES = 4_000_000  # of item text; some ten times that when prepared
PASS_BLOCKS = 8
SHARD_BYTES = 4_000_000
CHUNK = 100_000


def search_depth(words: np.ndarray) -> np.ndarray:
    """Equal words in a row that `words` words with one in ten exchanged always hold, SEED at most."""
    changed = words // 10
    return np.minimum(-(-(words - changed) // (changed + 1)), np.where(changed > 0, SEED, words))


@dataclass
class Items:
    """Words of all items of a block, end to end."""

    ids: np.ndarray
    words: np.ndarray  # hashes
    row: np.ndarray
    need: np.ndarray  # words that a finding must span, by item
    depth: np.ndarray  # words that a search must match, by item
    starts: np.ndarray  # suffixes that are searched
    bounds: np.ndarray  # first place of each item, and the end
    suffixes: np.ndarray  # starts that have SEED words
    seeds: np.ndarray  # hash of each suffix's SEED words
    own: np.ndarray  # by place: suffixes before it that few items share


@dataclass
class Shard:
    """Words of some documents, end to end, and all their suffixes in order."""

    words: np.ndarray
    row: np.ndarray
    end: np.ndarray  # by place: where its row ends
    suffixes: np.ndarray
    first: np.ndarray  # first word of each suffix, in order


def seed_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash of the SEED words at each start."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(SEED):
        out = (out ^ hashes[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def text_hash(hashes: np.ndarray) -> int:
    """One hash of a folded text."""
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def seed_starts(row: np.ndarray) -> np.ndarray:
    """Places that have SEED words of one row."""
    return np.flatnonzero(row[: len(row) - SEED + 1] == row[SEED - 1 :]) if len(row) >= SEED else np.zeros(0, np.int64)


def prepare(ids: list[int], texts: list[str], stretch: int = STRETCH, shared: np.ndarray | None = None) -> Items:
    """`shared`: seed hashes that FORMULA_ITEMS items or more have."""
    words, row, parent = forms(pa.array(texts, pa.large_string()))
    lengths = np.bincount(row, minlength=len(parent)).astype(np.int64)
    need = np.minimum(lengths, stretch)
    depth = search_depth(need)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    place = np.arange(len(words))
    # an item that must be matched in whole is searched from its beginning
    searched = (place + depth[row] <= bounds[row + 1]) & ((depth[row] < lengths[row]) | (place == bounds[row]))
    suffixes = seed_starts(row)
    seeds = seed_hashes(words, suffixes)
    own = np.zeros(len(words) + 1, np.int64)
    own[suffixes + 1] = ~np.isin(seeds, [] if shared is None else shared)
    return Items(np.array(ids, np.int64)[parent], words, row, need, depth, np.flatnonzero(searched), bounds, suffixes, seeds, np.cumsum(own))


def suffix_array(words: np.ndarray, row: np.ndarray) -> Shard:
    """All suffixes in order of their words; a suffix ends with its row, before any longer one.

    Prefix doubling: suffixes of equal first k words are told apart by the
    ranks of what follows them, until none that goes on is tied.
    """
    n = len(words)
    end = np.searchsorted(row, row, "right")
    order = np.argsort(words, kind="stable")
    first = words[order]
    rank = np.zeros(n, np.int64)  # 1 + place in the order of the first suffix of equal words
    slots, keys, k = np.arange(n), first, 1
    while len(slots):
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads] + 1, sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        places = order[slots]
        beyond = places + k
        going = beyond < end[places]
        keys = rank[places] * (n + 1)
        keys[going] += rank[beyond[going]]
        sorting = np.argsort(keys, kind="stable")
        order[slots], keys, going = places[sorting], keys[sorting], going[sorting]
        # what ends here and is tied is equal, and stays before what goes on
        slots, keys = slots[going], keys[going]
        k *= 2
    return Shard(words, row, end, order, first)


def _word(shard: Shard, places: np.ndarray, after: int) -> np.ndarray:
    """The word `after` each place, 0 beyond its row."""
    at = places + after
    return np.where(at < shard.end[places], shard.words[np.minimum(at, len(shard.words) - 1)], np.uint64(0))


def _bisect(shard: Shard, low: np.ndarray, high: np.ndarray, after: int, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, of all queries at once, among suffixes that agree up to `after`."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        word = _word(shard, shard.suffixes[middle], after)
        up = word <= wanted[open_] if right else word < wanted[open_]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


def ranges(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item suffix, first, end) of those whose first words begin suffixes first..end-1 of the shard's order."""
    wanted = items.words[items.starts]
    low, high = np.searchsorted(shard.first, wanted, "left"), np.searchsorted(shard.first, wanted, "right")
    depth = items.depth[items.row[items.starts]]
    live = np.flatnonzero(high > low)
    for after in range(1, int(depth.max(initial=0))):
        go = depth[live] > after
        some = live[go]
        word = items.words[items.starts[some] + after]
        a, b = (_bisect(shard, low[some], high[some], after, word, right) for right in (False, True))
        low[some], high[some] = a, b
        live = np.sort(np.concatenate((live[~go], some[b > a])))
    return items.starts[live], low[live], high[live]


def matches(shard: Shard, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the shard, place in the items) of matches of as many words as an item asks for that can't begin earlier."""
    found, low, high = ranges(shard, items)
    many = high - low
    ends = np.cumsum(many)
    total, done = int(ends[-1]) if len(ends) else 0, 0
    words, row = shard.words, shard.row
    while done < total:  # in chunks: a formula of the house meets many documents
        index = np.arange(done, min(done + 10 * CHUNK, total))
        which = np.searchsorted(ends, index, "right")
        place = shard.suffixes[low[which] + index - (ends[which] - many[which])]
        item = found[which]
        before = (place > 0) & (item > 0) & (row[place - 1] == row[place]) & (items.row[item - 1] == items.row[item]) & (words[place - 1] == items.words[item - 1])
        yield place[~before], item[~before]
        done = int(index[-1]) + 1


def _equal(shard, items, place, item, step):
    """Whether the words `step` after the two places are equal, inside the same document and item."""
    p, q = place + step, item + step
    ok = (p >= 0) & (p < len(shard.words)) & (q >= 0) & (q < len(items.words))
    p, q = np.where(ok, p, 0), np.where(ok, q, 0)
    return ok & (shard.words[p] == items.words[q]) & (shard.row[p] == shard.row[place]) & (items.row[q] == items.row[item])


def matched_length(shard, items, place, item) -> np.ndarray:
    length, going = items.depth[items.row[item]], np.arange(len(place))
    while len(going):
        going = going[_equal(shard, items, place[going], item[going], length[going])]
        length[going] += 1
    return length


def spans(shard, items, place, item, length, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a window around the match has enough equal words: all but one in ten; its begin and end in the items).

    The begin and end of a long enough match are its own; of several windows
    that will do it is the one with most words that few items share.
    """
    need = items.need[items.row[item]]
    out, first, last = length >= need, item.copy(), item + length
    for begin in range(0, len(place), CHUNK):
        some = begin + np.flatnonzero(~out[begin : begin + CHUNK])
        if not len(some):
            continue
        a, b, n = place[some], item[some], need[some]
        sums = np.zeros((len(some), 3 * stretch), np.int32)
        for k in range(1, 3 * stretch):
            sums[:, k] = sums[:, k - 1] + _equal(shard, items, a, b, k - stretch)
        enough = sums[:, -1] >= n - n // 10
        some, b, n, sums = some[enough], b[enough], n[enough], sums[enough]
        span = np.arange(3 * stretch)
        until = np.minimum(span[None, :] + n[:, None], 3 * stretch - 1)
        inside = np.take_along_axis(sums, until, 1) - sums
        good = inside >= (n - n // 10)[:, None]
        any_ = good.any(1)
        some, b, n, good = some[any_], b[any_], n[any_], good[any_]
        start = b[:, None] + span[None, :] + 1 - stretch
        of = items.row[b]
        low, high = np.maximum(start, items.bounds[of][:, None]), np.minimum(start + n[:, None], items.bounds[of + 1][:, None])
        best = np.where(good, own_seeds(items, low, high), -1).argmax(1)[:, None]
        out[some] = True
        first[some], last[some] = np.take_along_axis(low, best, 1)[:, 0], np.take_along_axis(high, best, 1)[:, 0]
    return out, first, last


def own_seeds(items: Items, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many SEED words in a row between two places of an item few items share."""
    return items.own[np.clip(last - SEED + 1, 0, len(items.own) - 1)] - items.own[np.clip(first, 0, len(items.own) - 1)]


@dataclass
class Found:
    """Matches that are long enough: arrays of one length."""

    row: np.ndarray  # of the document
    number: np.ndarray  # of the item
    longest: np.ndarray  # words of the verbatim match
    place: np.ndarray  # where it begins in the document, in words
    at: np.ndarray  # and in the item
    first: np.ndarray  # begin and end in the items of what counts as held
    last: np.ndarray

    def where(self, some: np.ndarray) -> Found:
        return Found(*(getattr(self, n)[some] for n in self.__dataclass_fields__))


def all_matches(shard: Shard, items: Items, stretch: int) -> Found:
    out = [[np.zeros(0, np.int64)] for _ in Found.__dataclass_fields__]
    if len(shard.words) and len(items.starts):
        for place, item in matches(shard, items):
            length = matched_length(shard, items, place, item)
            good, first, last = spans(shard, items, place, item, length, stretch)
            heads = np.searchsorted(shard.row, shard.row[place], "left")
            number = items.row[item]
            for column, values in zip(out, (shard.row[place], number, length, place - heads, item - items.bounds[number], first, last), strict=True):
                column.append(values[good])
    return Found(*map(np.concatenate, out))


def longest_of(found: Found) -> Found:
    """The longest verbatim match of each document and item, the first in the document of equal ones."""
    order = np.lexsort((found.at, found.place, -found.longest, found.number, found.row))
    found = found.where(order)
    first = np.ones(len(order), bool)
    first[1:] = (found.row[1:] != found.row[:-1]) | (found.number[1:] != found.number[:-1])
    return found.where(first)


def search(texts: pa.Array, items: Items, stretch: int = STRETCH) -> Found:
    """The longest match of each text and item, formulas included."""
    return longest_of(all_matches(suffix_array(*word_hashes(texts)), items, stretch))


def shared_seeds(items: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of SEED words in a row that FORMULA_ITEMS items of different folded text have."""
    texts = items.where(F.col(text).isNotNull()).select(joined_lines(F.col(text)).alias("__text")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, parent = forms(batch.column(0))
            of = text_hashes(words, row, parent)
            starts = seed_starts(row)
            yield pa.RecordBatch.from_arrays([pa.array(seed_hashes(words, starts)), pa.array(of[row[starts]], pa.int64())], names=["seed", "of"])

    held = texts.mapInArrow(work, "seed long, of long").distinct().groupBy("seed").count().where(F.col("count") >= FORMULA_ITEMS)
    return np.array(sorted(r[0] for r in held.select("seed").collect()), np.int64)


def text_hashes(words: np.ndarray, row: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """By row: one hash of the folded text without remarks that it comes from."""
    bounds = np.searchsorted(row, np.arange(int(parent.max(initial=-1)) + 2))
    return np.array([text_hash(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)[parent]


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of at most `block_bytes`, or of one item; read one partition at a time."""
    clean = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), joined_lines(F.col(text))).distinct()
    ids, texts, held = [], [], 0
    for r in clean.toLocalIterator():
        size = len(r[1].encode())
        if ids and held + size > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += size
    if ids:
        yield ids, texts


def leaked(
    documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str,
    stretch: int = STRETCH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc, item, longest, doc_word, item_word): documents that hold an item, or `stretch` words
    of it with at most one in ten exchanged; `longest` is the longest verbatim match in words,
    which begins at word `doc_word` of the document and `item_word` of the item, from 0, counted
    without remarks unless the match holds one."""
    numbers = [T.StructField(n, T.LongType()) for n in ("longest", "doc_word", "item_word")]
    schema = T.StructType([
        documents.schema[doc], items.schema[item], *numbers, T.StructField("__of", T.LongType()), T.StructField("__seeds", T.ArrayType(T.LongType())),
    ])
    texts = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, joined_lines(F.col(text)).alias("__text"))
    spark, out = documents.sparkSession, None
    shared = shared_seeds(items, item_text)
    prepared = (prepare(ids, words, stretch, shared) for ids, words in _blocks(items, item, item_text, block_bytes))
    for blocks in batched(prepared, PASS_BLOCKS):
        sent = [spark.sparkContext.broadcast(b) for b in blocks]

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, part in slices(batch.column(1), SHARD_BYTES):
                    words, row, parent = forms(part)
                    shard, of = suffix_array(words, row), text_hashes(words, row, parent)
                    for block in sent:
                        rows, *columns = _found_in(shard, block.value, of, stretch)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + parent[rows])), *columns], names=schema.names)

        part = texts.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType(schema.fields[:5]))
    if len(shared):
        out = _without_formulas(out, doc, item)
    best = F.max(F.struct("longest", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return out.groupBy(doc, item).agg(best).select(doc, item, "b.longest", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def _found_in(shard: Shard, items: Items, of: np.ndarray, stretch: int) -> list:
    """Columns of the findings; what may be formula has its text and its seeds with it, to be told apart once the whole corpus is counted."""
    found = all_matches(shard, items, stretch)
    sure = (own_seeds(items, found.first, found.last) > 0) | (found.last - found.first < SEED)
    doubted, found = found.where(~sure), longest_of(found.where(sure))
    seeds = [items.seeds[slice(*np.searchsorted(items.suffixes, (a, b - SEED + 1)))] for a, b in zip(doubted.first, doubted.last, strict=True)]
    both = [np.concatenate((getattr(found, n), getattr(doubted, n))) for n in ("row", "number", "longest", "place", "at")]
    known = [None] * len(found.row)
    return [
        both[0], pa.array(items.ids[both[1]], pa.int64()), *(pa.array(x, pa.int64()) for x in both[2:]),
        pa.array(known + of[doubted.row].tolist(), pa.int64()), pa.array(known + seeds, pa.list_(pa.int64())),
    ]


def _without_formulas(found: DataFrame, doc: str, item: str) -> DataFrame:
    """Matches without those whose seeds (null: surely no formula) all stand in more than FORMULA_TEXTS texts."""
    found = checkpointed(found)
    seeds = found.where("__of IS NOT NULL").select("__of", F.explode("__seeds").alias("__seed"))
    rare = seeds.distinct().groupBy("__seed").count().where(F.col("count") <= FORMULA_TEXTS).select("__seed")
    own = found.columns[:5]
    held = found.where("__of IS NOT NULL").withColumn("__seed", F.explode("__seeds")).join(rare, "__seed", "left_semi").select(*own)
    return found.where("__of IS NULL").select(*own).unionByName(held)


def without_leaks(documents: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """`documents` that no row of `found` names. Rows with a null id stay."""
    return documents.join(found.select(doc).distinct(), doc, "left_anti")
