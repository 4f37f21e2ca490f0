"""One form for text that looks the same.

Full-width and narrow forms, ligatures and other compatibility forms that
display like plain letters, letters of other scripts that look like Latin
ones, precomposed and combining accents, blanks of every kind and invisible
characters come out alike. A visible accent, a capital, a superscript or a
dash of another length stays different.

Text columns are copied to code-point arrays, replaced by table gathers with
expansion offsets, and marks are put in order and composed for the whole
column at once. The tables follow from rules over the Unicode database.

Defined cases: null stays null; text of blanks and invisible characters alone
becomes empty text; invisible characters go wherever they stand, runs of
blanks become one space, none at the ends; invalid UTF-8 is mended first.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.codepoints import LIMIT, CharTable, keep, replacements, row_heads, slices, to_codes, to_text

#: Letters of other scripts, and rare Latin ones, with the Latin letter or mark that they look like.
#: One line a script: Cyrillic small, rare Latin, Cyrillic capital, Greek small, Greek capital, Armenian,
#: Cherokee, Lisu, Coptic, Deseret, Canadian syllabics, marks.
ALIKE = [
    ("аеорсухѕіјһԛԝԁӏգ", "aeopcyxsijhqwdlq"),
    ("ᴏᴠᴡᴢᴄɡɑ", "ovwzcga"),
    ("АВЕКМНОРСТУХЅІЈԚԜӀ", "ABEKMHOPCTYXSIJQWI"),
    ("αγινορυϲϳ", "ayivopucj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("օսհոցյՕՍ", "ouhngjOU"),
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏚᏞᏟᏢᏦᏧᏴ", "DRTAJEWMHGZ4RWSLCPKdB"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BEHIKMNOPCTYXopc"),
    ("𐐄𐐕𐐛𐐠𐐬𐐽", "OCLSoc"),
    ("ᐯᑌᑭᒍᒪᔑᕼᖇᖴᗞᗰᗷ᙭", "VUPJLSHRFDMBX"),
    ("‐ʼ", "-’"),
]
LOOKALIKE = {a: b for others, latin in ALIKE for a, b in zip(others, latin, strict=True)}

#: Decompositions whose result looks like the character itself.
SHOWN_ALIKE = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}

#: Default-ignorable ranges that are not format characters, and format characters that show.
IGNORED = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
VISIBLE_FORMAT = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
BLANK = 0x20
HANGUL = (0xAC00, 0xD7A3)


def _within(code: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= code <= b for a, b in ranges)


def shown(code: int) -> tuple[int, ...]:
    """What a character displays as, decomposed."""
    char = chr(code)
    kind = unicodedata.category(char)
    if char in LOOKALIKE:
        return (ord(LOOKALIKE[char]),)
    if kind in ("Zs", "Zl", "Zp") or code in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2800):
        return (BLANK,)
    if kind == "Cc" or _within(code, IGNORED) or (kind == "Cf" and not _within(code, VISIBLE_FORMAT)):
        return ()
    if 0xAC00 <= code <= 0xD7A3:
        return tuple(map(ord, unicodedata.normalize("NFD", char)))
    parts = unicodedata.decomposition(char).split()
    if not parts or char == "ſ":
        return (code,)
    if parts[0][0] == "<" and (parts[0] not in SHOWN_ALIKE or parts[1] == "0020"):
        return (code,)
    return tuple(x for p in parts if p[0] != "<" for x in shown(int(p, 16)))


@cache
def tables() -> tuple[CharTable, np.ndarray, np.ndarray, np.ndarray]:
    """(replacements, combining classes, sorted keys of pairs that compose, what they compose to)."""
    changed = replacements(shown)
    changed |= {code: () for code in range(0xE0000, 0xE1000)}
    order = np.zeros(LIMIT, np.uint8)
    pairs = {}
    for code in range(0x323B0):
        char = chr(code)
        order[code] = unicodedata.combining(char)
        if 0xAC00 <= code <= 0xD7A3:
            place = (code - 0xAC00) % 28
            first, last = (code - place, 0x11A7 + place) if place else map(ord, unicodedata.normalize("NFD", char))
        else:
            parts = unicodedata.decomposition(char).split()
            if len(parts) != 2 or parts[0][0] == "<" or unicodedata.normalize("NFC", char) != char:
                continue
            first, last = int(parts[0], 16), int(parts[1], 16)
        pairs[first << 21 | last] = code
    keys = np.array(sorted(pairs), np.int64)
    return CharTable(changed), order, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _in_order(codes: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Marks after a base sorted by combining class, as the standard orders them."""
    rank = order[codes]
    marks = np.flatnonzero(rank)
    if len(marks) < 2:
        return codes
    runs = np.cumsum((rank == 0) | row_heads(len(codes), offsets))
    sorting = np.argsort(runs[marks] * 256 + rank[marks], kind="stable")
    codes = codes.copy()
    codes[marks] = codes[marks[sorting]]
    return codes


def _composed(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, order, keys, made = tables()
    while len(codes) > 1:
        second = np.flatnonzero(~row_heads(len(codes), offsets)[1:] & ((order[codes[1:]] > 0) | (codes[1:] > 0x7F))) + 1
        second = second[order[codes[second - 1]] == 0]
        pair = codes[second - 1].astype(np.int64) << 21 | codes[second]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[at] == pair
        second, at = second[hit], at[hit]
        if len(second):
            apart = np.concatenate(([True], np.diff(second) > 1))
            second, at = second[apart], at[apart]
        if not len(second):
            break
        codes = codes.copy()
        codes[second - 1] = made[at]
        mask = np.ones(len(codes), bool)
        mask[second] = False
        codes, offsets = keep(mask, codes, offsets)
    return codes, offsets


def one_form_array(column: pa.Array) -> pa.Array:
    parts = [_one_form_of(part) for _, part in slices(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _one_form_of(column: pa.Array) -> pa.Array:
    codes, offsets, valid = to_codes(column)
    table, order, _, _ = tables()
    codes, offsets = table.apply(codes, offsets)
    codes, offsets = _composed(_in_order(codes, offsets, order), offsets)
    if len(codes):
        blank = codes == BLANK
        heads = row_heads(len(codes), offsets)
        codes, offsets = keep(~(blank & (heads | np.concatenate(([False], blank[:-1])))), codes, offsets)
    if len(codes):
        last = np.zeros(len(codes), bool)
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        codes, offsets = keep(~(last & (codes == BLANK)), codes, offsets)
    return to_text(codes, offsets, valid)


@F.arrow_udf(T.StringType())
def _one_form(column: pa.Array) -> pa.Array:
    return one_form_array(column)


def one_form(column: Column | str) -> Column:
    return _one_form(column)


def alike_pairs(entries: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(key_a, key_b): entries of one group with different texts that look the same.

    Rows with a null group, key or text have no partner; repeated rows count
    once; the smaller key comes first. Spellings are paired first, each once
    however many entries have it, and only those that have a partner are joined
    with their entries: entries of one spelling never meet, so the work is in
    proportion to the pairs that come out.
    """
    e = (
        entries.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("t"))
        .where("g IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL")
        .distinct()
    )
    spelled = e.select("g", "t").distinct().withColumn("form", one_form("t"))
    # most forms have one spelling; arrays hold the spellings of a form, not its entries
    several = spelled.groupBy("g", "form").agg(F.sort_array(F.collect_list("t")).alias("ts")).where("size(ts) > 1")
    firsts = several.select("g", "ts", F.posexplode("ts").alias("n", "ta"))
    spellings = firsts.select("g", "ta", F.explode(F.expr("slice(ts, n + 2, size(ts))")).alias("tb"))
    a = e.select("g", F.col("k").alias("a"), F.col("t").alias("ta"))
    b = e.select("g", F.col("k").alias("b"), F.col("t").alias("tb"))
    pairs = spellings.join(a, ["g", "ta"]).join(b, ["g", "tb"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()


def alike_classes(entries: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(key, form, n_links): one row per entry, the form that names its class in its group, and how
    many entries of other spelling it holds. Repeated rows count once; null parts leave a row out."""
    e = entries.select(group, key, F.col(text).alias("__t")).where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col("__t").isNotNull())
    spelled = e.distinct().groupBy(group, "__t").agg(F.count(F.lit(1)).alias("__n")).withColumn("form", one_form("__t"))
    classes = spelled.groupBy(group, "form").agg(F.sum("__n").alias("__all"))
    links = spelled.join(classes, [group, "form"]).select(group, "__t", "form", (F.col("__all") - F.col("__n")).alias("n_links"))
    return e.distinct().join(links, [group, "__t"]).select(key, "form", "n_links")


def merged_entries(entries: DataFrame, group: str, key: str, text: str, values: str) -> DataFrame:
    """(group, form, n_entries, n_spellings, n_values): each group holds a form once.

    `n_values` counts the distinct non-null elements of the arrays in `values`.
    A null or empty array adds nothing; null texts are left out.
    """
    e = entries.select(group, key, F.col(text).alias("__t"), values).where(F.col(text).isNotNull())
    e = e.withColumn("form", one_form("__t"))
    keys = [F.col(group), F.col("form")]
    seen = e.groupBy(*keys).agg(F.countDistinct(key).alias("n_entries"), F.countDistinct("__t").alias("n_spellings"))
    held = (
        e.select(*keys, F.explode(values).alias("__v")).distinct().groupBy(group, "form").agg(F.count("__v").alias("n_values"))
    )
    joined = seen.join(held.withColumnRenamed(group, "__g").withColumnRenamed("form", "__f"),
                       F.col(group).eqNullSafe(F.col("__g")) & (F.col("form") == F.col("__f")), "left")
    return joined.select(group, "form", "n_entries", "n_spellings", F.coalesce("n_values", F.lit(0)).alias("n_values"))
