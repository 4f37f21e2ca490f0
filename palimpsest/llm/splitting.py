"""Cutting oversized content into overlapping pieces at natural boundaries.

Content is read as Latin-1, one character per byte, so that a bounded
quantifier counts bytes. One regular expression with alternatives in order of
boundary strength (paragraph, line, word; each first in the upper half of the
room, then anywhere; then a character end) consumes the content piece by
piece. Lookback offsets then put the end of each piece before the next. All
of it is built-in array and string functions.

The first alternative takes content that fits as a whole, so that the
expression alone decides what is cut. Offsets are prefix sums over the lengths
of the pieces, by blocks of BLOCK, so that the work is in proportion to them.

Defined cases: null content, and empty content, has no pieces; content within
the limit is one piece; a null limit or one below 1 does not cut; a limit too
small for the overlap halves it; bytes that are not UTF-8 are cut anywhere;
repeated rows are cut each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP = 255
BLOCK = 1024

#: What a piece may end with, strongest first, and what no cut may be followed by.
PARAGRAPH = r"(?<=\n\n|\n\r\n)"
LINE = r"(?<=\n|\r(?!\n))"
WORD = r"(?<=[ \t]|\xE3\x80\x80|\xE2\x80[\x80-\x8A\xA8\xA9])"
CHARACTER = r"(?![\x80-\xBF])"


def overlap_bytes(limit: Column, overlap: int = OVERLAP) -> Column:
    """Bytes repeated from the piece before; at least 4 bytes and half the limit stay for new content."""
    return F.greatest(F.least(F.lit(overlap), F.floor((limit - 4) / 2)), F.lit(0)).cast("int")


def _pattern(limit: Column, room: Column) -> Column:
    half = F.greatest(F.floor(room / 2), F.lit(1)).cast("int")
    upper = lambda end: [F.lit("|.{"), half.cast("string"), F.lit(","), room.cast("string"), F.lit("}" + end)]
    whole = lambda end: [F.lit("|.{1,"), room.cast("string"), F.lit("}" + end)]
    rest = [F.lit(r"(?s)(?:\A.{1,"), limit.cast("string"), F.lit(r"}\z|.{1,"), room.cast("string"), F.lit(r"}\z")]
    return F.concat(
        *rest, *upper(PARAGRAPH), *upper(LINE), *upper(WORD), *whole(PARAGRAPH), *whole(LINE), *whole(WORD), *whole(CHARACTER), *whole(""), F.lit(")")
    )


def bodies(content: Column, limit: Column, overlap: int = OVERLAP) -> Column:
    """The new content of each piece, as Latin-1 strings that join to the whole."""
    text = F.decode(content, "ISO-8859-1")
    room = (limit - overlap_bytes(limit, overlap)).cast("int")
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), F.array().cast("array<string>"))
        .when(limit.isNull() | (limit < 1), F.array(text))
        .otherwise(F.regexp_extract_all(text, _pattern(F.least(limit, F.lit(2**31 - 2)), room), F.lit(0)))
    )


def _running(base: Column, values: Column) -> Column:
    """`base`, then `base` and each of the running sums of `values`."""
    return F.aggregate(values, F.array(base), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def prefix_sums(values: Column) -> Column:
    """The sum of the values before each one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")
    bases = _running(zero, F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, n: acc + n)))
    each = F.zip_with(blocks, F.slice(bases, 1, F.size(bases) - 1), lambda b, base: F.slice(_running(base, b), 1, F.size(b)))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def pieces(items: DataFrame, content: str, limit: str, overlap: int = OVERLAP) -> DataFrame:
    """`items` without `content`, one row per piece: piece_no (from 0), start (of
    the new content, in bytes), overlap (bytes repeated), piece (BINARY). These
    replace columns of the same name."""
    rest = [c for c in items.columns if c not in (content, "piece_no", "start", "overlap", "piece")]
    sizes = F.transform(bodies(F.col(content), F.col(limit), overlap), F.length)
    at = items.withColumn("__sizes", sizes).withColumn("__starts", prefix_sums(F.col("__sizes").cast("array<bigint>")))

    def cut(size: Column, i: Column) -> Column:
        start = F.element_at("__starts", i + 1).cast("int")
        room = F.least(start, overlap_bytes(F.col(limit), overlap))
        before = F.decode(F.substring(F.col(content), start - room + 1, room), "ISO-8859-1")
        back = F.when((i == 0) | (room == 0), 0).otherwise(F.length(F.regexp_replace(before, r"^[\x80-\xBF]{1,3}", "")))
        return F.struct(
            i.alias("piece_no"), start.cast("long").alias("start"), back.cast("long").alias("overlap"),
            F.substring(F.col(content), start - back + 1, back + size).alias("piece"),
        )

    return at.select(*rest, F.explode(F.transform("__sizes", cut)).alias("__p")).select(*rest, "__p.*")


def rejoined(items: DataFrame, keys: list[str], content: str, limit: str, overlap: int = OVERLAP) -> DataFrame:
    """(keys, n_bytes, digest, n_too_long, n_misplaced, n_wrong_overlaps, cut) of the pieces of each item.

    The digest is that of the new contents joined; misplaced is a piece whose
    start is not the sum of the new contents before it; a wrong overlap is not
    the end of the piece before, or further from the length asked for than a
    character is long. `keys` name an item, whose pieces meet in one row.
    """
    parts = pieces(items, content, limit, overlap)
    fields = F.struct("piece_no", "start", "overlap", "piece")
    all_ = parts.groupBy(*keys, limit).agg(F.sort_array(F.collect_list(fields)).alias("__p"))
    fresh = F.transform("__p", _tail)
    before = F.slice(F.concat(F.array(F.lit(None).cast("binary")), F.col("__p.piece")), 1, F.size("__p"))
    asked = overlap_bytes(F.col(limit), overlap)
    wrong = F.zip_with("__p", before, lambda p, b: F.when(
        (p["piece_no"] > 0) & ((p["overlap"] > asked) | (p["overlap"] < F.least(asked, F.octet_length(b)) - 3)
                               | (F.substring(p["piece"], F.lit(1), p["overlap"].cast("int")) != F.substring(b, F.octet_length(b) - p["overlap"].cast("int") + 1, p["overlap"].cast("int")))), 1))
    placed = F.zip_with(F.col("__p.start"), prefix_sums(F.transform(fresh, lambda x: F.octet_length(x).cast("long"))), lambda a, b: F.when(a != b, 1))
    count = lambda flags: F.size(F.filter(flags, lambda x: x.isNotNull())).cast("long")
    long_ = F.transform("__p", lambda p: F.when(F.octet_length(p["piece"]) > F.col(limit), 1))
    whole = F.aggregate(fresh, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return all_.select(
        *keys, F.octet_length(whole).cast("long").alias("n_bytes"), F.md5(whole).alias("digest"), count(long_).alias("n_too_long"),
        count(placed).alias("n_misplaced"), count(wrong).alias("n_wrong_overlaps"), (F.size("__p") > 1).alias("cut"),
    )


def _tail(p: Column) -> Column:
    """The new content of a piece."""
    return F.substring(p["piece"], p["overlap"].cast("int") + 1, F.octet_length(p["piece"]))
