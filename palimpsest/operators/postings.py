"""Documents to postings, and views of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.tokens import DEFAULT, TokenizerConfig, file_words, words


def first_letter(word: Column) -> Column:
    return F.substring(word, 1, 1)


def text_postings(texts: DataFrame, key: str, text: str, config: TokenizerConfig = DEFAULT) -> DataFrame:
    """(letter, word, path_id) of a text table; `key` serves as path id.

    A null text has no words; a null key is left out; of repeated keys each
    pair of word and key comes out once.
    """
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("path_id"), F.explode(words(F.col(text), config)).alias("word"))
    return rows.distinct().select(first_letter(F.col("word")).alias("letter"), "word", "path_id")


def word_counts(texts: DataFrame, key: str, text: str, config: TokenizerConfig = DEFAULT) -> DataFrame:
    """(path_id, word_count) of each row."""
    return texts.select(F.col(key).cast("long").alias("path_id"), F.size(words(F.col(text), config)).cast("long").alias("word_count"))


def tokenized_files(documents: DataFrame, config: TokenizerConfig = DEFAULT, *more: str) -> DataFrame:
    """(path, mtime, length, more, words) of files read with their content; every file has a row."""
    return documents.select("path", "mtime", "length", *more, file_words(F.col("path"), F.col("content"), config).alias("words"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(word, n_paths); the pairs of `postings` are distinct."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("n_paths"))


def letter_table(postings: DataFrame) -> DataFrame:
    """(letter, n_words, first_word): where each letter begins in the dictionary."""
    return postings.select("letter", "word").distinct().groupBy("letter").agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first_word"))


def corpus_counters(documents: DataFrame, size: str) -> DataFrame:
    """(n_files, n_bytes, n_empty)."""
    return documents.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"), F.count_if(F.col(size) == 0).alias("n_empty")
    )
