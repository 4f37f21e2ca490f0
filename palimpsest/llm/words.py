"""Folded words of Arrow text as arrays of hashes.

Folding makes words equal that differ only in the way they are written or set:
case, accents, width, ligatures, look-alike letters, invisible characters,
punctuation around them, hyphenation at line ends. The folding table follows from the Unicode database.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.llm.codepoints import CharTable, replacements, row_heads, slices, to_codes
from palimpsest.llm.lookalikes import shown

SEPARATOR = 0x20


OPENING, CLOSING, DASHES, BLANKS = (np.array([ord(c) for c in x], np.uint32) for x in ("([", ")]", "–—", " \t\r\n\u00a0"))
STAR, COLON = ord("*"), ord(":")


def joined_lines(text: Column) -> Column:
    """Line-end hyphens joined."""
    return F.regexp_replace(text, r"[-‐­][ \t]*\r?\n[ \t]*(?=\p{Ll})", "")


def in_remarks(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a remark is, of any length: in brackets (one may interrupt another), between runs of
    asterisks, or between dashes that stand alone, with a colon after whoever speaks.

    What opens and is not closed in its row is no remark.
    """
    begins, ends = [], []
    marks = np.flatnonzero(np.isin(codes, np.concatenate((OPENING, CLOSING))))
    for _ in range(2):
        opens = np.isin(codes[marks], OPENING)
        row = np.searchsorted(offsets, marks, "right")
        pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (row[:-1] == row[1:])) if len(marks) > 1 else np.zeros(0, np.int64)
        begins.append(marks[pair])
        ends.append(marks[pair + 1])
        marks = np.delete(marks, np.concatenate((pair, pair + 1)))
    stars = np.flatnonzero(codes == STAR)
    if len(stars):
        row = np.searchsorted(offsets, stars, "right")
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(stars) > 1) | (row[1:] != row[:-1]))))
        many = np.diff(np.append(heads, len(stars))) > 1
        pair = _in_turn(many[:-1] & many[1:] & (row[heads[:-1]] == row[heads[1:]]))
        begins.append(stars[heads[pair]])
        ends.append(stars[heads[pair + 1]])
    dashes = np.flatnonzero(np.isin(codes, DASHES))
    if len(dashes):
        around = np.concatenate(([0x20], codes, [0x20]))
        dashes = dashes[np.isin(around[dashes], BLANKS) & np.isin(around[dashes + 2], BLANKS)]
        row = np.searchsorted(offsets, dashes, "right")
        colons = np.searchsorted(np.flatnonzero(codes == COLON), dashes)
        pair = _in_turn((colons[1:] > colons[:-1]) & (row[1:] == row[:-1])) if len(dashes) else dashes
        begins.append(dashes[pair])
        ends.append(dashes[pair + 1])
    depth = np.zeros(len(codes) + 1, np.int32)
    np.add.at(depth, np.concatenate(begins), 1)
    np.add.at(depth, np.concatenate(ends) + 1, -1)
    return np.cumsum(depth)[:-1] > 0


def _in_turn(follows: np.ndarray) -> np.ndarray:
    """Of stretches between neighbouring marks those that count, the first of each chain and every second after it:
    what closes one does not open another."""
    held = np.flatnonzero(follows)
    if not len(held):
        return held
    chain = np.cumsum(np.concatenate(([True], np.diff(held) > 1)))
    return held[(np.arange(len(held)) - np.searchsorted(chain, chain)) % 2 == 0]


def _folded(code: int) -> tuple[int, ...]:
    text = "".join(map(chr, shown(code)))
    kept = [c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c)]
    kept = [c for x in kept for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)]
    if not text or (not kept and unicodedata.combining(chr(code))):
        return ()
    return tuple(ord(c) if c.isalnum() else SEPARATOR for c in kept) or (SEPARATOR,)


@cache
def folding() -> CharTable:
    return CharTable(replacements(_folded))


@cache
def _powers() -> np.ndarray:
    out = np.ones(64, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, 64):
            out[i] = out[i - 1] * np.uint64(0x9E3779B97F4A7C15)
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word), in text order."""
    return marked_words(column, False)[:2]


def marked_words(column: pa.Array, remarks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row of each word, whether it is in a remark), in text order."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for first, part in slices(column):
        h, r, m = _word_hashes(part, remarks)
        parts.append((h, r + first, m))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _word_hashes(column: pa.Array, remarks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, offsets, _ = to_codes(column)
    table = folding()
    marked = np.repeat(in_remarks(codes, offsets), table.length[codes]) if remarks else None
    codes, offsets = table.apply(codes, offsets)
    inside = codes != SEPARATOR
    heads = row_heads(len(codes), offsets)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | heads[1:]
    places = np.flatnonzero(inside)
    if not len(places):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    number = np.cumsum(begins[places]) - 1
    starts = np.flatnonzero(begins)
    letters = codes[places].astype(np.uint64) + np.uint64(1)
    terms = letters * _powers()[(places - starts[number]) & 63]
    sums = np.add.reduceat(terms, np.flatnonzero(begins[places]))
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(32)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return sums, rows, marked[starts] if remarks else np.zeros(len(starts), bool)


def forms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, row of each, parent of each row): every text without its remarks, as row i,
    and each text that has any once more with them, as a row behind all of those."""
    words, row, marked = marked_words(column)
    held = np.unique(row[marked])
    again = np.flatnonzero(np.isin(row, held)) if len(held) else np.zeros(0, np.int64)
    behind = len(column) + np.searchsorted(held, row[again])
    bare = ~marked
    return np.concatenate((words[bare], words[again])), np.concatenate((row[bare], behind)), np.concatenate((np.arange(len(column)), held))
