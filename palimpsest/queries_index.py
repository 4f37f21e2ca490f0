"""Queries of the index and search operators over the test tables, with SQL for each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.tokens import ACCENTED, BASE, BYTES, LOWER, TokenizerConfig
from palimpsest.operators.check import check
from palimpsest.operators.merge import merged, numbered_paths, pairs, without_paths
from palimpsest.operators.postings import (
    corpus_counters,
    document_frequencies,
    letter_table,
    text_postings,
    tokenized_files,
    word_counts,
)
from palimpsest.plans.boolean import ranked, relational, search
from palimpsest.plans.query import SearchConfig
from palimpsest.session import read_spread, read_table
from palimpsest.sources.files import wanted

QUERIES: dict = {}
SQL: dict = {}


def put(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# ---- SQL that several queries share

_LETTERS = ", ".join(f"'{ord(a):02X}': '{b}'" for a, b in (BYTES | dict(zip(LOWER, LOWER))).items())


def folded_sql(hexed: str) -> str:
    """Text of a-z, with ``!`` for every other byte, from hexadecimal digits."""
    return f"array_to_string(list_transform(regexp_extract_all({hexed}, '..'), lambda h: coalesce(MAP {{{_LETTERS}}}[h], '!')), '')"


def _words_sql(source: str, key: str, folded: str) -> str:
    """CTE words(key, word): distinct words of `source`."""
    return f"""runs AS (SELECT {key}, string_split_regex({folded}, '[^a-z]') AS a FROM {source}),
words AS (SELECT DISTINCT {key}, word FROM (SELECT {key}, unnest(a[:len(a) - 1]) AS word FROM runs) WHERE length(word) BETWEEN 5 AND 14
          UNION SELECT {key}, a[-1] FROM runs WHERE length(a[-1]) BETWEEN 4 AND 19)"""


DOC_WORDS = _words_sql("documents", "doc_id", folded_sql("hex(encode(coalesce(text, '')))"))
POSTINGS = f"WITH {DOC_WORDS}, p AS (SELECT left(word, 1) AS letter, word, doc_id AS path_id FROM words)"


def doc_postings(spark: SparkSession, folder: str) -> DataFrame:
    return text_postings(documents(spark, folder), "doc_id", "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "documents").select("doc_id", "text")


# ---- tokens and dictionary

put("tok_postings", doc_postings, f"{POSTINGS} SELECT letter, word, path_id FROM p")
put(
    "tok_word_count",
    lambda s, d: word_counts(documents(s, d), "doc_id", "text").distinct(),
    f"{POSTINGS} SELECT d.doc_id AS path_id, count(word) AS word_count FROM (SELECT DISTINCT doc_id FROM documents) d "
    "LEFT JOIN p ON p.path_id = d.doc_id GROUP BY ALL",
)
put(
    "tok_folded",
    lambda s, d: text_postings(documents(s, d), "doc_id", "text", TokenizerConfig(accents="folded")),
    f"WITH {_words_sql('documents', 'doc_id', folded_sql(f'''hex(encode(translate(coalesce(text, {chr(39) * 2}), {chr(39)}{ACCENTED}{chr(39)}, {chr(39)}{BASE}{chr(39)})))'''))} "
    "SELECT left(word, 1) AS letter, word, doc_id AS path_id FROM words",
)


def _file_rows(spark: SparkSession, folder: str) -> DataFrame:
    files = read_table(spark, folder, "files")
    return files.groupBy("path").agg(F.max_by("content", F.struct("modificationtime", "run_id")).alias("content"), F.max("modificationtime").alias("mtime"))


def tok_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = _file_rows(spark, folder).withColumn("length", F.octet_length("content").cast("long"))
    return tokenized_files(rows).select("path", F.explode("words").alias("word"))


put(
    "tok_files",
    tok_files,
    f"""WITH f AS (SELECT path, arg_max(content, (modificationtime, run_id)) AS content FROM files GROUP BY path),
parts AS (SELECT path, hex(coalesce(content, ''::BLOB)) AS x FROM f WHERE path LIKE '%.txt' UNION ALL
         SELECT path, hex(encode(string_split(path, '/')[-1])) FROM f WHERE path LIKE '%.txt'),
{_words_sql("parts", "path", folded_sql("x"))} SELECT path, word FROM words""",
)
put("dict_words", lambda s, d: doc_postings(s, d).select("word").distinct(), f"{POSTINGS} SELECT DISTINCT word FROM p")
put("dict_letters", lambda s, d: letter_table(doc_postings(s, d)), f"{POSTINGS} SELECT letter, count(DISTINCT word) AS n_words, min(word) AS first_word FROM p GROUP BY letter")
put("dict_doc_freq", lambda s, d: document_frequencies(doc_postings(s, d)), f"{POSTINGS} SELECT word, count(*) AS n_paths FROM p GROUP BY word")


def dict_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    from palimpsest.operators.heavy_keys import key_lists

    return key_lists(doc_postings(spark, folder), "word", "path_id", chunk=500).select("word", "chunk_no", "values")


put(
    "dict_posting_lists",
    dict_posting_lists,
    f"""{POSTINGS} SELECT word, chunk_no, list(path_id ORDER BY path_id) AS "values"
FROM (SELECT word, path_id, (row_number() OVER (PARTITION BY word ORDER BY path_id) - 1) // 500 AS chunk_no FROM p) GROUP BY word, chunk_no""",
)

# ---- terms and boolean queries


def _term(word: str, exact: bool = False) -> str:
    return f"(SELECT path_id, count(*) AS n FROM p WHERE word {'= ' if exact else 'LIKE '}'{word}{'' if exact else '%'}' GROUP BY path_id)"


def _or(*sides: str) -> str:
    return f"(SELECT path_id, sum(n) AS n FROM ({' UNION ALL '.join(f'SELECT * FROM {x}' for x in sides)}) GROUP BY path_id)"


def _and(a: str, b: str) -> str:
    return f"(SELECT l.path_id, l.n + r.n AS n FROM {a} l JOIN {b} r ON l.path_id = r.path_id)"


def _not(a: str, b: str) -> str:
    return f"(SELECT l.* FROM {a} l WHERE NOT EXISTS (SELECT 1 FROM {b} r WHERE r.path_id = l.path_id))"


H, FI, O, B = _term("harbour"), _term("fishing"), _term("orchard"), _term("bakery")
NONE = "(SELECT path_id, n FROM (SELECT CAST(0 AS BIGINT) AS path_id, CAST(0 AS BIGINT) AS n) WHERE false)"

#: name: (query as typed, the same in SQL, settings)
BOOLEAN = {
    "term_exact": ('"harbour"', _term("harbour", True), {}),
    "term_prefix": ("harbo", _term("harbo"), {}),
    "term_min_char_gate": ("harb", NONE, {}),
    "term_min_char_lower": ("harb", _term("harb"), {"min_char": 3}),
    "term_missing": ("xyzzyqwkplm", NONE, {}),
    "term_capitals": ("HarBOUR", H, {}),
    "term_exact_config": ("harbour", _term("harbour", True), {"exact_match": True}),
    "q_or_implicit": ("harbour fishing", _or(H, FI), {}),
    "q_or": ("harbour OR fishing", _or(H, FI), {}),
    "q_and": ("harbour AND fishing", _and(H, FI), {}),
    "q_not": ("harbour NOT fishing", _not(H, FI), {}),
    "q_nested": ("((harbour OR fishing) AND orchard) NOT bakery", _not(_and(_or(H, FI), O), B), {}),
    "q_left_to_right": ("harbour OR fishing AND orchard", _and(_or(H, FI), O), {}),
    "q_grouped_right": ("harbour OR (fishing AND orchard)", _or(H, _and(FI, O)), {}),
    "q_leading_not": ("NOT harbour", NONE, {}),
    "q_leading_not_then_or": ("NOT harbour fishing", FI, {}),
    "q_trailing_and": ("harbour AND", H, {}),
    "q_repeat_term": ("harbour harbour", _or(H, H), {}),
    "q_mixed_exact_prefix": ('"harbour" AND fishi', _and(_term("harbour", True), _term("fishi")), {}),
    "q_or_then_not": ("harbour OR NOT fishing", _not(H, FI), {}),
    "q_and_then_or": ("harbour AND OR fishing", _and(H, FI), {}),
    "q_glue": ("rur al", _term("rural"), {}),
    "q_glue_off": ("rur al harbour", H, {"glue_short": False}),
    "q_phrase_quotes": ('"harbour dues orchard"', _or(H, _or(_term("dues"), _term("orchard", True))), {"min_char": 3}),
    "q_first_group_only": ("harbour) (fishing", H, {}),
    "q_run_into_parenthesis": ("harbour AND(fishing)", H, {}),
    "q_unbalanced": ("(harbour", NONE, {}),
}


def _boolean(text: str, settings: dict):
    return lambda s, d: search(doc_postings(s, d), text, SearchConfig(**settings))


for _name, (_text, _sql, _settings) in BOOLEAN.items():
    put(_name, _boolean(_text, _settings), f"{POSTINGS} SELECT path_id, CAST(n AS BIGINT) AS count FROM {_sql}")

put("set_and_join", lambda s, d: relational(doc_postings(s, d), "harbour AND fishing"), SQL["q_and"])
put("set_or_union", lambda s, d: relational(doc_postings(s, d), "harbour OR fishing"), SQL["q_or"])
put("set_not_anti", lambda s, d: relational(doc_postings(s, d), "harbour NOT fishing"), SQL["q_not"])
put("set_many_terms", lambda s, d: search(doc_postings(s, d), BOOLEAN["q_nested"][0], most_columns=1), SQL["q_nested"])

# ---- ranking: over the stored index, whose postings and paths are cleaned first


def stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "postings").where("word RLIKE '^[a-z]+$' AND path_id >= 1")
    return rows.select(F.substring("word", 1, 1).alias("letter"), "word", "path_id").distinct()


def stored_paths(spark: SparkSession, folder: str) -> DataFrame:
    """One row per path: the latest by mtime; a path without a count counts 0."""
    rows = read_table(spark, folder, "paths").where("path_id IS NOT NULL")
    last = F.max(F.struct(F.col("mtime").isNotNull(), "mtime", "word_count", "path")).alias("l")
    return rows.groupBy("path_id").agg(last).select("path_id", "l.path", F.coalesce("l.word_count", F.lit(0)).alias("word_count"), "l.mtime")


STORED = """WITH p AS (SELECT DISTINCT word, path_id FROM postings WHERE regexp_full_match(word, '[a-z]+') AND path_id >= 1),
names AS (SELECT DISTINCT path_id, path FROM paths WHERE path_id IS NOT NULL)"""
_STORED_QUERY = _or(_and(_term("yeeng"), _term("diesh")), _not(_term("heesut"), _term("mastaing")))
STORED_QUERY = "(yeeng AND diesh) OR (heesut NOT mastaing)"
_RANKED = f"""{STORED}, found AS (SELECT path_id, CAST(n AS BIGINT) AS count FROM {_STORED_QUERY})
SELECT row_number() OVER (ORDER BY count DESC, f.path_id) - 1 AS rank, f.path_id, coalesce(path, '') AS path, count
FROM found f LEFT JOIN names ON names.path_id = f.path_id"""


def rank_all(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(search(stored_postings(spark, folder), STORED_QUERY), stored_paths(spark, folder))


def rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(search(stored_postings(spark, folder), STORED_QUERY), stored_paths(spark, folder), limit=20)


put("rank_all", rank_all, _RANKED)
put("rank_topk", rank_topk, f"SELECT * FROM ({_RANKED}) WHERE rank < 20")

# ---- merging


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    all_ = documents(spark, folder)
    return all_.where("doc_id % 2 = 0"), all_.where("doc_id % 2 = 1")


def merge_additive(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (text_postings(h, "doc_id", "text") for h in _halves(spark, folder))
    return merged(first, second)


def merge_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    once = doc_postings(spark, folder)
    return merged(merged(once, once), once)


def merge_updated(spark: SparkSession, folder: str) -> DataFrame:
    """Every document changes to another text; the words that it had stay."""
    changed = documents(spark, folder).withColumn("text", F.concat(F.lit("amended schedule "), F.col("text"), F.lit(" annex")))
    return merged(doc_postings(spark, folder), text_postings(changed, "doc_id", "text"))


def merge_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Replacing: the even documents are read again as one word."""
    even = documents(spark, folder).where("doc_id % 2 = 0")
    new = text_postings(even.withColumn("text", F.lit("replaced\n")), "doc_id", "text")
    return without_paths(doc_postings(spark, folder), even.select(F.col("doc_id").alias("path_id"))).unionByName(new)


put("merge_additive", merge_additive, SQL["tok_postings"])
put("merge_idempotent", merge_idempotent, SQL["tok_postings"])
_CHANGED = _words_sql("(SELECT doc_id, 'amended schedule ' || text || ' annex' AS text FROM documents)", "doc_id", folded_sql("hex(encode(coalesce(text, '')))"))
put(
    "merge_updated",
    merge_updated,
    f"""{POSTINGS}, q AS (WITH {_CHANGED} SELECT left(word, 1) AS letter, word, doc_id AS path_id FROM words)
SELECT letter, word, path_id FROM p UNION SELECT letter, word, path_id FROM q""",
)
put(
    "merge_replaced",
    merge_replaced,
    f"{POSTINGS} SELECT letter, word, path_id FROM p WHERE path_id % 2 = 1 UNION SELECT DISTINCT 'r', 'replaced', doc_id FROM documents WHERE doc_id % 2 = 0",
)


def _merge_input(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All stored paths as the index, and all files of the listing as read again or new."""
    fresh = read_table(spark, folder, "scan_listing").where("path IS NOT NULL").groupBy("path")
    return stored_paths(spark, folder), fresh.agg(F.max("length").alias("word_count"), F.max("mtime").alias("mtime"))


def merge_path_ids(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_paths(*_merge_input(spark, folder))


put(
    "merge_path_ids",
    merge_path_ids,
    """WITH old AS (SELECT path_id, path, word_count AS wc, mtime AS mt FROM (SELECT *, row_number() OVER (PARTITION BY path_id
         ORDER BY mtime DESC NULLS LAST, word_count DESC NULLS LAST, path DESC) AS k FROM paths WHERE path_id IS NOT NULL) WHERE k = 1),
fresh AS (SELECT path, max(length) AS wc, max(mtime) AS mt FROM scan_listing WHERE path IS NOT NULL GROUP BY path)
SELECT o.path_id, o.path, CASE WHEN f.path IS NULL THEN coalesce(o.wc, 0) ELSE f.wc END AS word_count,
       CASE WHEN f.path IS NULL THEN o.mt ELSE f.mt END AS mtime
FROM old o LEFT JOIN fresh f ON f.path = o.path
UNION ALL
SELECT (SELECT max(path_id) FROM old) + row_number() OVER (ORDER BY encode(path)), path, wc, mt
FROM fresh WHERE path NOT IN (SELECT path FROM old)""",
)


def merge_word_count(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the files after two runs, the second over all of them."""
    rows = _file_rows(spark, folder).withColumn("length", F.octet_length("content").cast("long"))
    both = tokenized_files(rows)
    fresh = both.select("path", F.size("words").cast("long").alias("word_count"), "mtime")
    nothing = fresh.select(F.lit(0).cast("long").alias("path_id"), "path", "word_count", "mtime").where("false")
    paths = numbered_paths(nothing, fresh)
    counts = pairs(both, paths).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    return paths.join(counts, "path_id", "left").select("path_id", "path", "word_count", F.coalesce("n", F.lit(0)).alias("n_postings"))


put(
    "merge_word_count",
    merge_word_count,
    SQL["tok_files"].replace("SELECT path, word FROM words", """
SELECT row_number() OVER (ORDER BY encode(f.path)) AS path_id, f.path, count(word) AS word_count, count(word) AS n_postings
FROM f LEFT JOIN words ON words.path = f.path GROUP BY f.path"""),
)

# ---- scanning

LISTED = [
    "/c/a.txt", "/c/b.md", "/c/empty.txt", "/c/_u.txt", "/c/f.TXT", "/c/g.log", "/c/.h.txt", "/c/.dot/e.txt",
    "/c/sub/.hid/d.txt", "/c/sub/c.txt", "/c/.txt", "/c/x.y.txt", "/c/txt", "/c/noext.", None,
]


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, dt.datetime(2024, 1, 1 + i)) for i, p in enumerate(LISTED)], "path string, mtime timestamp_ntz")


_VALUES = ", ".join(f"({'NULL' if p is None else repr(p)}, TIMESTAMP '2024-01-{1 + i:02d}')" for i, p in enumerate(LISTED))
_WANTED = "regexp_matches(path, '[^/]\\.(txt|md)$') AND path NOT LIKE '%/.%'"
put("scan_filters", lambda s, d: wanted(_listed(s)).select("path"), f"SELECT path FROM (VALUES {_VALUES}) v(path, mtime) WHERE {_WANTED}")
put(
    "scan_mtime_filter",
    lambda s, d: wanted(_listed(s), dt.datetime(2024, 1, 4)).select("path"),
    f"SELECT path FROM (VALUES {_VALUES}) v(path, mtime) WHERE {_WANTED} AND mtime >= TIMESTAMP '2024-01-04'",
)
SINCE = dt.datetime(2024, 1, 1)
put(
    "scan_changed_files",
    lambda s, d: wanted(read_table(s, d, "scan_listing"), SINCE).select("path", "mtime").distinct(),
    f"SELECT DISTINCT path, mtime FROM scan_listing WHERE {_WANTED} AND mtime >= TIMESTAMP '2024-01-01'",
)

# ---- integrity and counters

_CHECKS = {
    "C1 word not empty": ("postings", "coalesce(word, '')", "word IS NULL OR length(word) < 1"),
    "C2 word not too long": ("postings", "word", "octet_length(encode(word)) > 255"),
    "C3 only a-z": ("postings", "word", "NOT regexp_full_match(word, '[a-z]*')"),
    "C4 no word twice for a path": ("(SELECT word, path_id FROM postings GROUP BY ALL HAVING count(*) > 1)", "word", "true"),
    "C5 letter is the first of the word": ("postings", "word", "letter IS DISTINCT FROM left(word, 1)"),
    "C6 path given and unique": ("(SELECT path, count(*) AS n FROM paths GROUP BY path)", "coalesce(path, '')", "path IS NULL OR n > 1"),
    "C6 path ids 1 to n": ("paths", "CAST(path_id AS VARCHAR)", "path_id IS NULL OR path_id < 1 OR path_id > (SELECT count(*) FROM paths)"),
    "C6 path id unique": ("(SELECT path_id FROM paths GROUP BY path_id HAVING count(*) > 1)", "CAST(path_id AS VARCHAR)", "true"),
    "C7 word count given": ("paths", "CAST(path_id AS VARCHAR)", "word_count IS NULL OR word_count < 0"),
    "C9 path id known": ("postings", "CAST(path_id AS VARCHAR)", "path_id >= 1 AND path_id NOT IN (SELECT path_id FROM paths WHERE path_id IS NOT NULL)"),
    "C11 path id not empty": ("postings", "coalesce(word, '')", "path_id IS NULL OR path_id < 1"),
}
_CHECK_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS "check", count(*) = 0 AS ok, count(*) AS violations, min({what}) AS sample FROM {table} WHERE {bad}"""
    for name, (table, what, bad) in _CHECKS.items()
)
put("check_detects", lambda s, d: check(read_table(s, d, "postings"), read_table(s, d, "paths")), _CHECK_SQL)
put(
    "check_ok",
    lambda s, d: check(doc_postings(s, d), _doc_paths(s, d), fresh=True).select("check", "ok", "violations"),
    " UNION ALL ".join(f"""SELECT '{n}' AS "check", true AS ok, 0::BIGINT AS violations""" for n in [*_CHECKS, "C7 word count right"]),
)


def _doc_paths(spark: SparkSession, folder: str) -> DataFrame:
    """One path per document; ids are dense already, from 1 or from 0."""
    counts = word_counts(documents(spark, folder), "doc_id", "text").distinct()
    return counts.select("path_id", F.concat(F.lit("doc_"), F.col("path_id"), F.lit(".txt")).alias("path"), "word_count", F.lit(None).cast("timestamp").alias("mtime"))


put(
    "corpus_stats",
    lambda s, d: corpus_counters(_file_rows(s, d).withColumn("size", F.octet_length("content").cast("long")), "size"),
    """SELECT count(*) AS n_files, CAST(coalesce(sum(octet_length(content)), 0) AS BIGINT) AS n_bytes, count(*) FILTER (octet_length(content) = 0) AS n_empty
FROM (SELECT path, arg_max(content, (modificationtime, run_id)) AS content FROM files GROUP BY path)""",
)
