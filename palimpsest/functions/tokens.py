"""Words of a text as Spark expressions, without a UDF.

A word is a run of a-z after folding capitals and accented letters. Runs of 5
to 14 letters count, the run that touches the end of the text with 4 to 19.

Accents are folded byte by byte by default: every byte of UTF-8 text is looked
up on its own, so that the first byte of an accented letter ends a run and its
last byte may begin the next. ``accents="folded"`` folds whole characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base letters and the accented letters that fold to them.
FOLDED = {
    "a": "äÄåÅàÀáÁâÂãÃ",
    "o": "öÖòÒóÓôÔõÕ",
    "e": "éÉèÈêÊëË",
    "u": "üÜùÙúÚûÛ",
    "i": "ìÌíÍîÎïÏ",
    "n": "ñÑ",
    "y": "ýÝÿŸ",
    "c": "çÇ",
    "s": "ß",
}
ACCENTED = "".join(FOLDED.values())
BASE = "".join(base * len(accented) for base, accented in FOLDED.items())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte (as a Latin-1 character) to letter: capitals, and the last byte of each accented letter.
BYTES = dict(zip(UPPER, LOWER)) | {chr(a.encode()[-1]): b for a, b in zip(ACCENTED, BASE)}


@dataclass(frozen=True)
class TokenizerConfig:
    accents: str = "bytewise"
    inner: tuple[int, int] = (5, 14)
    last: tuple[int, int] = (4, 19)


DEFAULT = TokenizerConfig()


def _bytes_as_text(content: Column) -> Column:
    """Bytes as Latin-1 characters; text must be encoded first."""
    return F.decode(content, "ISO-8859-1")


def letters(text: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """`text` with letters folded; all else is left in place to separate words."""
    if config.accents == "folded":
        text = F.translate(text, ACCENTED, BASE)
    elif config.accents != "bytewise":
        raise ValueError(f"accents: {config.accents}")
    return F.translate(_bytes_as_text(F.encode(text, "UTF-8")), "".join(BYTES), "".join(BYTES.values()))


def letters_of_bytes(content: Column, config: TokenizerConfig = DEFAULT) -> Column:
    if config.accents == "folded":
        return letters(F.decode(content, "UTF-8"), config)
    return F.translate(_bytes_as_text(content), "".join(BYTES), "".join(BYTES.values()))


def runs(folded: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """Array of words of a folded text, repeats included."""
    parts = F.split(folded, "[^a-z]", -1)
    inner = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda w: F.length(w).between(*config.inner))
    last = F.filter(F.slice(parts, -1, 1), lambda w: F.length(w).between(*config.last))
    return F.concat(inner, last)


def words(text: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """Distinct words of a text column; null gives no words."""
    return F.array_distinct(runs(letters(F.coalesce(text, F.lit("")), config), config))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the file name; a name that only begins with a dot has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def file_words(path: Column, content: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """Distinct words of a file and of its name. Only ``.txt`` files have words."""
    body = runs(letters_of_bytes(F.coalesce(content, F.encode(F.lit(""), "UTF-8")), config), config)
    name = runs(letters(file_name(path), config), config)
    none = F.array().cast("array<string>")
    return F.when(extension(path) == ".txt", F.array_union(body, name)).otherwise(none)
