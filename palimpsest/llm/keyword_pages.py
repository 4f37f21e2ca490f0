"""Pages of repeated keywords, links or tags instead of sentences.

A text is read as chunks between blanks. A function word stands for itself,
any other chunk for its class: small, capital or all-capital word, number,
link, tag, bare mark, and whether the word was said a moment ago; a closing
mark follows as a symbol of its own. Three models of these symbols are trained
on prose: one by one, in threes, and in threes with all function words taken as
one. A stretch of text is abnormal where the mean surprise of the symbols
around, under any of them, is far above or far below what prose held out of
the training shows. (Threes alone are fooled by text that, once strange, goes
on alike; single symbols by keywords whose surprise is like that of words.)

An abnormal stretch counts if links, tags, bare marks, article codes or words,
other than function words, that the page repeats make up enough of it: that keeps division lists and
order papers, which are no prose either but repeat nothing. Refrains are prose
to the model. A page is found if more than half of its characters are in such
stretches.

The training text is an argument, prose from outside of the documents, by
default the passages of `prose.py`; the documents are only scored, so neither
their number nor the share of such pages among them changes what is found.

Defined cases: null or blank text is never found; null ids are left out; a
repeated row gives one result; an empty table gives none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.codepoints import LIMIT, row_heads, slices, to_codes
from palimpsest.llm.prose import PASSAGES
from palimpsest.llm.words import _powers, folding

FOLDS = 6  # parts of the training text, each of which the others hold out
FUNCTION_WORDS = 120  # words that are symbols of their own, by the texts that have them
COMMON = 0.02  # share of the texts that has any other common word; those are one symbol
AROUND = 10  # symbols on either side that a stretch takes in
RECENT = 12  # chunks within which a word counts as said a moment ago
FAR = 2.5  # standard deviations from prose that was held out
DENSE = 0.45  # share of links, tags, marks and repeated words
TIMES = 3  # so often in a page is repeated

SMALL, CAPITAL, CAPITALS, DIGITS, LINK, TAG, MARK = range(7)
CLASSES = 7 + 4  # the four word classes again, as said a moment ago
CLOSING = ".,;:!?"
SYMBOLS = CLASSES + len(CLOSING) + 1  # the last: a common word; function words come after these


@cache
def _kinds() -> np.ndarray:
    """0 blank, 1 letter, 2 capital, 3 digit, 4 other."""
    out = np.full(LIMIT, 4, np.uint8)
    for code in range(0x30000):
        kind = unicodedata.category(chr(code))
        out[code] = 0 if kind[0] == "Z" or code in (9, 10, 11, 12, 13) else 2 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 3 if kind[0] == "N" else 4
    return out


@cache
def _plain() -> np.ndarray:
    """The first folded character of each character, for hashing words."""
    table = folding()
    return np.where(table.length > 0, table.pool[np.minimum(table.start, len(table.pool) - 1)], 0x20).astype(np.uint64)


@dataclass
class Chunks:
    row: np.ndarray
    size: np.ndarray  # characters
    shape: np.ndarray
    hash: np.ndarray
    recent: np.ndarray  # said a moment ago
    often: np.ndarray  # times in the row
    mixed: np.ndarray  # letters and digits in one chunk, as in the code of an article
    closing: np.ndarray  # index in CLOSING, -1 for none


def chunks(column: pa.Array) -> Chunks:
    codes, offsets, _ = to_codes(column)
    kind = _kinds()[codes]
    place = np.flatnonzero(kind)
    if not len(place):
        none = np.zeros(0, np.int64)
        no = none.astype(bool)
        return Chunks(none, none, none, none.astype(np.uint64), no, none, no, none)
    heads = row_heads(len(codes), offsets)[place]
    begin = np.concatenate(([True], (np.diff(place) > 1) | heads[1:]))
    firsts = np.flatnonzero(begin)
    count = len(firsts)
    code, k = codes[place], kind[place]
    size = np.diff(np.append(firsts, len(place)))
    ends = firsts + size - 1
    number = np.repeat(np.arange(count, dtype=np.int32), size)
    letter = (k == 1) | (k == 2)
    solid = k < 4
    has = lambda mask: np.add.reduceat(mask.view(np.uint8), firsts, dtype=np.int32)
    n_letters, n_capital = has(letter), has(k == 2)
    n_digits = has(solid) - n_letters

    dots = np.flatnonzero(code == ord("."))
    for step in (-2, -1, 1, 2):
        at = np.clip(dots + step, 0, len(place) - 1)
        dots = dots[letter[at] & (number[at] == number[dots])]
    slashes = np.flatnonzero(code == ord("/"))
    slashes = slashes[1:][(np.diff(slashes) == 1) & (number[slashes[1:]] == number[slashes[:-1]])]
    odd = np.flatnonzero((code == ord("<")) | (code == ord(">")) | (code == ord("@")))
    link = np.zeros(count, bool)
    link[number[np.concatenate((dots, slashes, odd))]] = True
    tag = (code[firsts] == ord("#")) & (n_letters + n_digits > 0)
    opens = np.zeros(count, bool)
    letters = np.flatnonzero(letter)
    if len(letters):
        leads = letters[np.concatenate(([True], number[letters][1:] != number[letters][:-1]))]
        opens[number[leads]] = k[leads] == 2
    shape = np.select(
        [link, tag, n_letters + n_digits == 0, n_letters == 0, (n_capital == n_letters) & (n_letters > 1), opens],
        [LINK, TAG, MARK, DIGITS, CAPITALS, CAPITAL], SMALL,
    )
    # the place of a letter counts from the first letter or digit, so that an opening quote changes nothing
    said = np.flatnonzero(solid)
    word = np.zeros(count, np.uint64)
    if len(said):
        owner = number[said]
        bounds = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        within = (np.arange(len(said)) - np.repeat(bounds, np.diff(np.append(bounds, len(said))))) & 63
        terms = (_plain()[code[said]] + np.uint64(1)) * _powers()[within]
        word[owner[bounds]] = np.add.reduceat(terms, bounds)
    word ^= word >> np.uint64(29)
    closing = np.full(count, -1)
    for i, mark in enumerate(CLOSING):
        closing[(code[ends] == ord(mark)) & (shape != MARK)] = i
    row = np.searchsorted(offsets, place[firsts], side="right") - 1
    recent, often = _repeats(row, word)
    return Chunks(row, size, shape, word, recent, often, (n_letters > 0) & (n_digits > 0), closing)


def _repeats(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the word of each chunk stood at most RECENT chunks before, and how often it stands in its row."""
    key = word ^ (row.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(key, kind="stable")
    key, r = key[order], row[order]
    same = (key[1:] == key[:-1]) & (r[1:] == r[:-1])
    recent = np.zeros(len(row), bool)
    recent[order[1:]] = same & (np.diff(order) <= RECENT)
    group = np.concatenate(([0], np.cumsum(~same)))
    often = np.empty(len(row), np.int64)
    often[order] = np.bincount(group)[group]
    return recent, often


@dataclass
class Prose:
    words: np.ndarray  # sorted hashes of function words and common words
    symbol: np.ndarray  # of each of them
    single: np.ndarray  # surprise by symbol
    triple: np.ndarray  # surprise by symbol and the two before
    classes: np.ndarray  # the same with function words as one symbol
    middle: tuple[float, ...] = (0.0, 0.0, 0.0)  # of the mean surprise around under each model, in prose
    spread: tuple[float, ...] = (1.0, 1.0, 1.0)


def _known(c: Chunks, words: np.ndarray) -> np.ndarray:
    """Place of the word of each chunk among `words`, -1 for none."""
    if not len(words):
        return np.full(len(c.hash), -1)
    at = np.minimum(np.searchsorted(words, c.hash), len(words) - 1)
    return np.where((words[at] == c.hash) & (c.shape <= CAPITALS), at, -1)


def symbols(c: Chunks, known: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, chunk of each symbol). `known`: place of each chunk's word, `symbol`: of the words."""
    again = c.recent & (c.shape <= DIGITS)
    own = c.shape + np.where(again, 7, 0)
    own[known >= 0] = symbol[known[known >= 0]]
    both = np.stack((own, np.where(c.closing >= 0, CLASSES + c.closing, -1)), axis=1).ravel()
    kept = np.flatnonzero(both >= 0)
    return both[kept], kept // 2


def _contexts(symbol: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each; `size` stands for the beginning of the text."""
    one, two = np.full(len(symbol), size), np.full(len(symbol), size)
    one[1:] = np.where(row[1:] == row[:-1], symbol[:-1], size)
    two[2:] = np.where(row[2:] == row[:-2], symbol[:-2], size)
    return one, two


def _window(values: np.ndarray, row: np.ndarray, around: int) -> np.ndarray:
    """Mean over up to `around` neighbours on either side in the same row."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    places = np.arange(len(values))
    begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else places
    lengths = np.diff(np.append(begins, len(row)))
    first, last = np.repeat(begins, lengths), np.repeat(begins + lengths, lengths)
    low, high = np.maximum(first, places - around), np.minimum(last, places + around + 1)
    return (sums[high] - sums[low]) / (high - low)


def _common_words(c: Chunks, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, symbols) of words by the number of texts that have them: a text counts once."""
    plain = kept[c.row] & (c.shape <= CAPITALS)
    pairs = np.unique(np.stack((c.hash[plain], c.row[plain].astype(np.uint64)), axis=1), axis=0)
    hashes, texts = np.unique(pairs[:, 0], return_counts=True)
    order = np.argsort(-texts, kind="stable")
    order = order[texts[order] >= max(2, COMMON * kept.sum())]
    symbol = np.minimum(np.arange(len(order)), FUNCTION_WORDS)
    symbol = np.where(symbol < FUNCTION_WORDS, SYMBOLS + symbol, SYMBOLS - 1)
    back = np.argsort(hashes[order])
    return hashes[order][back], symbol[back]


def _fit(c: Chunks, kept: np.ndarray) -> Prose:
    words, own = _common_words(c, kept)
    symbol, chunk = symbols(c, _known(c, words), own)
    row, size = c.row[chunk], SYMBOLS + FUNCTION_WORDS
    use = kept[row]
    uni = np.bincount(symbol[use], minlength=size)
    single = (uni + 0.5) / (uni.sum() + 0.5 * size)
    return Prose(words, own, -np.log2(single), _in_threes(symbol, row, use, size), _in_threes(_coarse(symbol), row, use, SYMBOLS))


def _coarse(symbol: np.ndarray) -> np.ndarray:
    """Function words as one symbol, and words with and without a capital, which languages use as they please, alike."""
    out = np.minimum(symbol, SYMBOLS - 1)
    return np.where((out == CAPITAL) | (out == CAPITAL + 7), out - CAPITAL + SMALL, out)


def _in_threes(symbol: np.ndarray, row: np.ndarray, use: np.ndarray, size: int) -> np.ndarray:
    """Surprise by the two symbols before and the symbol, each backed by what is known with fewer."""
    one, two = _contexts(symbol, row, size)
    states = (size + 1) ** 2 * size
    tri = np.bincount(((two * (size + 1) + one) * size + symbol)[use], minlength=states).reshape(size + 1, size + 1, size)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p = (uni + 0.5) / (uni.sum() + 0.5 * size)
    p = (bi + 5 * p) / (bi.sum(1, keepdims=True) + 5)
    p = (tri + 5 * p) / (tri.sum(2, keepdims=True) + 5)
    return -np.log2(p).astype(np.float32)


def _surprises(c: Chunks, prose: Prose) -> tuple[list[np.ndarray], np.ndarray]:
    """(mean surprise around each chunk under each model, place of its word among the common ones)."""
    known = _known(c, prose.words)
    symbol, chunk = symbols(c, known, prose.symbol)
    row = c.row[chunk]
    one, two = _contexts(symbol, row, SYMBOLS + FUNCTION_WORDS)
    coarse = _coarse(symbol)
    before, earlier = _contexts(coarse, row, SYMBOLS)
    own = np.ones(len(chunk), bool)
    own[1:] = chunk[1:] != chunk[:-1]
    values = (prose.single[symbol], prose.triple[two, one, symbol], prose.classes[earlier, before, coarse])
    return [_window(v, row, AROUND)[own] for v in values], known


def train(texts: Sequence[str], folds: int = FOLDS) -> Prose:
    """A model of `texts`, all of which are prose. What is usual is measured on texts that a model has not seen."""
    c = chunks(pa.array(list(texts), pa.large_string()))
    all_ = np.ones(max(1, len(texts)), bool)
    prose = _fit(c, all_)
    if not len(c.row):
        return prose
    held: list[list[np.ndarray]] = [[], [], []]
    for fold in range(min(folds, len(texts))):
        kept = np.arange(len(texts)) % folds != fold if len(texts) > 1 else all_
        for part, values in zip(held, _surprises(c, _fit(c, kept))[0], strict=True):
            part.append(values[~kept[c.row]] if len(texts) > 1 else values)
    scores = [np.concatenate(part) for part in held]
    prose.middle = tuple(float(np.median(x)) for x in scores)
    prose.spread = tuple(max(0.05, float(1.4826 * np.median(np.abs(x - m)))) for x, m in zip(scores, prose.middle, strict=True))
    return prose


def page_shares(column: pa.Array, prose: Prose) -> tuple[np.ndarray, np.ndarray]:
    """(share of abnormal text, share of keyword text) of each row."""
    parts = [_shares(part, prose) for _, part in slices(column)] or [(np.zeros(0), np.zeros(0))]
    return np.concatenate([a for a, _ in parts]), np.concatenate([k for _, k in parts])


def _shares(column: pa.Array, prose: Prose) -> tuple[np.ndarray, np.ndarray]:
    c, n = chunks(column), len(column)
    if not len(c.row):
        return np.zeros(n), np.zeros(n)
    means, known = _surprises(c, prose)
    abnormal = np.zeros(len(c.row), bool)
    for mean, middle, spread in zip(means, prose.middle, prose.spread, strict=True):
        abnormal |= np.abs(mean - middle) > FAR * spread
    stuffed = (c.shape >= LINK) | c.mixed | ((c.often >= TIMES) & (known < 0) & (c.shape != DIGITS))
    dense = _window(stuffed.astype(float), c.row, AROUND) >= DENSE
    total = np.maximum(1, np.bincount(c.row, c.size, minlength=n))
    return np.bincount(c.row, c.size * abnormal, minlength=n) / total, np.bincount(c.row, c.size * (abnormal & dense), minlength=n) / total


@lru_cache(maxsize=8)
def trained(texts: tuple[str, ...] = tuple(PASSAGES)) -> Prose:
    return train(texts)


def scored(documents: DataFrame, doc: str, text: str, prose: Sequence[str] = PASSAGES) -> DataFrame:
    """(doc, abnormal, keywords): shares of the text of each document. `prose`: texts that are prose."""
    rows = documents.select(doc, text).where(F.col(doc).isNotNull() & F.col(text).isNotNull())
    sent = documents.sparkSession.sparkContext.broadcast(trained(tuple(prose)))
    schema = T.StructType([documents.schema[doc], T.StructField("abnormal", T.DoubleType()), T.StructField("keywords", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            abnormal, keywords = page_shares(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(abnormal), pa.array(keywords)], names=schema.names)

    return rows.mapInArrow(work, schema)


def keyword_pages(documents: DataFrame, doc: str, text: str, share: float = 0.5, prose: Sequence[str] = PASSAGES) -> DataFrame:
    """The documents of which more than `share` is keywords, links or tags."""
    return scored(documents, doc, text, prose).where(F.col("keywords") > share).select(doc).distinct()
