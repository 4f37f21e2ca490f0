"""Queries through an index on disk and the parts around it, with SQL for each.

The index is written to a working folder of the session and read back from
there; one that several queries read is built once per application and table.
"""

from __future__ import annotations

import datetime as dt
import io
import logging
import os
import socket
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import queries_index as qi
from palimpsest.cli import LEVELS, log_to, main, parse_arguments
from palimpsest.engine import Engine
from palimpsest.operators.check import report
from palimpsest.plans.boolean import result_lines
from palimpsest.session import read_table, working_folder
from palimpsest.sources.config import DEFAULTS, ConfigError, EngineConfig, load, parse_lines
from palimpsest.sources.files import _opened, list_tree, read_files, wanted
from palimpsest.store.lock import IndexLock

QUERIES: dict = {}
SQL: dict = {}
ROOT = "/c"
NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
_BUILT: dict[tuple[str, str, str], object] = {}


def put(sql: str):
    def keep(query):
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return keep


def _once(spark: SparkSession, folder: str, kind: str, make):
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _engine(spark: SparkSession, name: str, scan: str = ROOT, **settings) -> Engine:
    return Engine(spark, EngineConfig(working_folder(spark, name), scan, lock_timeout=0, **settings))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files: path, mtime, length, content, and the id."""
    d = qi.documents(spark, folder).where("doc_id IS NOT NULL")
    return d.select(
        F.concat(F.lit(f"{ROOT}/doc_"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.lit(NOW.replace(tzinfo=None)).cast("timestamp").alias("mtime"),
        F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"), "doc_id",
    )


def built(spark: SparkSession, folder: str) -> Engine:
    """All documents taken in by one run."""

    def make() -> Engine:
        engine = _engine(spark, "index")
        engine.take_in(document_files(spark, folder).drop("doc_id"), NOW)
        return engine

    return _once(spark, folder, "built", make)


def merged(spark: SparkSession, folder: str) -> Engine:
    """Documents of even id by a first run, of odd id by a second, all of them again by a third."""

    def make() -> Engine:
        engine, files = _engine(spark, "merged"), document_files(spark, folder)
        for some in (files.where("doc_id % 2 = 0"), files.where("doc_id % 2 <> 0"), files):
            engine.take_in(some.drop("doc_id"), NOW)
        return engine

    return _once(spark, folder, "merged", make)


PATHS_SQL = f"""{qi.POSTINGS}, f AS (SELECT DISTINCT doc_id, '{ROOT}/doc_' || doc_id || '.txt' AS path FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT row_number() OVER (ORDER BY encode(path)) AS id, path, doc_id FROM f)"""
WORDS_SQL = f"{PATHS_SQL} SELECT path, letter, word FROM p JOIN q ON q.doc_id = p.path_id"


def _words_of(engine: Engine) -> DataFrame:
    return engine.store.postings().join(engine.store.paths(), "path_id").select("path", "letter", "word")


@put(WORDS_SQL)
def store_first_write(spark: SparkSession, folder: str) -> DataFrame:
    return _words_of(built(spark, folder))


@put(WORDS_SQL)
def store_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs hold what one would."""
    return _words_of(merged(spark, folder))


@put(f"""{PATHS_SQL} SELECT id AS path_id, path, count(word) AS word_count, TIMESTAMP '2024-01-01' AS mtime
FROM q LEFT JOIN p ON p.path_id = q.doc_id GROUP BY id, path""")
def store_paths(spark: SparkSession, folder: str) -> DataFrame:
    return built(spark, folder).store.paths().select("path_id", "path", "word_count", F.col("mtime").cast("timestamp_ntz").alias("mtime"))


@put(f"{PATHS_SQL} SELECT letter, count(*) AS n_postings, count(DISTINCT word) AS n_words, min(word) AS first_word FROM p GROUP BY letter")
def store_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The letters that the index is parted by."""
    return built(spark, folder).store.postings().groupBy("letter").agg(
        F.count(F.lit(1)).alias("n_postings"), F.count_distinct("word").alias("n_words"), F.min("word").alias("first_word")
    )


def _hits(found: str) -> str:
    """CTE found(id, path, n) of a boolean query in SQL."""
    return f"{PATHS_SQL}, found AS (SELECT id, q.path, CAST(n AS BIGINT) AS n FROM {found} r JOIN q ON q.doc_id = r.path_id)"


_RANKED = "SELECT row_number() OVER (ORDER BY n DESC, id) - 1 AS rank, id AS path_id, path, n AS count FROM found"


def _stored_search(text: str, settings: dict):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        engine = built(spark, folder)
        return Engine(spark, EngineConfig(engine.config.index_path, ROOT, **settings)).search(text)

    return query


#: which queries of the memory index are also put to the index on disk
STORED = ["term_exact", "term_prefix", "term_min_char_lower", "term_exact_config", "q_or", "q_and", "q_not", "q_nested", "q_left_to_right", "q_leading_not", "q_unbalanced"]
for _name in STORED:
    _text, _found, _settings = qi.BOOLEAN[_name]
    QUERIES[f"store_{_name}"], SQL[f"store_{_name}"] = _stored_search(_text, _settings), f"{_hits(_found)} {_RANKED}"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], columns: str, kinds: str = "") -> str:
    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int):
            return f"CAST({x} AS BIGINT)"
        return "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


@put(f"""{PATHS_SQL} SELECT (SELECT count(*) FROM q) AS paths, count(*) AS postings, count(DISTINCT word) AS words,
CAST(3 AS BIGINT) AS version, CAST(3 AS BIGINT) AS segments FROM p""")
def store_sizes(spark: SparkSession, folder: str) -> DataFrame:
    stats = merged(spark, folder).store.stats()
    return _table(spark, [tuple(stats[k] for k in ("paths", "postings", "words", "version", "segments"))], "paths long, postings long, words long, version long, segments long")


@put(f"""{WORDS_SQL.replace("SELECT path, letter, word", "SELECT path, letter, word, CAST(1 AS BIGINT) AS n_segments")}""")
def store_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """All segments as one hold what they held."""

    def make() -> Engine:
        engine, files = _engine(spark, "compacted"), document_files(spark, folder)
        for some in (files.where("doc_id % 2 = 0"), files):
            engine.take_in(some.drop("doc_id"), NOW)
        engine.store.compact()
        return engine

    engine = _once(spark, folder, "compacted", make)
    return _words_of(engine).withColumn("n_segments", F.lit(len(engine.store.manifest()["segments"])).cast("long"))


@put(f"""{PATHS_SQL} SELECT path, letter, word FROM p JOIN q ON q.doc_id = p.path_id WHERE doc_id % 2 <> 0
UNION SELECT path, 'r', 'replaced' FROM q WHERE doc_id % 2 = 0""")
def store_replace(spark: SparkSession, folder: str) -> DataFrame:
    """A replacing run keeps only the present words of the paths that it reads."""

    def make() -> Engine:
        engine, files = _engine(spark, "replaced"), document_files(spark, folder)
        engine.take_in(files.drop("doc_id"), NOW)
        changed = files.where("doc_id % 2 = 0").drop("doc_id").withColumn("content", F.encode(F.lit("replaced\n"), "UTF-8"))
        engine.take_in(changed, NOW, mode="replace")
        return engine

    return _words_of(_once(spark, folder, "replaced", make))


_CHECK_NAMES = [n for n in qi._CHECKS]


@put(_values([(n, True, 0) for n in [*_CHECK_NAMES, "C7 word count right"]], '"check", ok, violations'))
def store_check(spark: SparkSession, folder: str) -> DataFrame:
    return built(spark, folder).check().select("check", "ok", "violations")


@put(_values([("No corruption found.",)], "report"))
def store_check_report(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, [(report(built(spark, folder).check()),)], "report string")


@put(f"""{_hits(qi.BOOLEAN["q_nested"][1])} SELECT rank AS line_no, chr(10) || ' ' || rank || '. ' || path || ' with ' || n || ' matches.' AS line
FROM (SELECT row_number() OVER (ORDER BY n DESC, id) - 1 AS rank, path, n FROM found)""")
def cli_result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What the command line writes for a query."""
    lines: list[str] = []
    main([f"--index_path={built(spark, folder).config.index_path}", f"--config_path_to_scan={ROOT}", "--config_file=/none", qi.BOOLEAN["q_nested"][0]], spark=spark, write=lines.append)
    return _table(spark, list(enumerate(lines)), "line_no long, line string")


@put(_values([(0, "\nNo results found.")], "line_no, line"))
def cli_no_results(spark: SparkSession, folder: str) -> DataFrame:
    page = result_lines(built(spark, folder).search("xyzzyqwkplm"))
    return _table(spark, [(i, line.removesuffix("\n")) for i, line in enumerate(page)], "line_no long, line string")


_INTERACTIVE = ["xyzzyqwkplm", "(unbalanced", "exit", "never asked"]


@put(_values([(0, "\nNo results found."), (1, "\nNo results found.")], "line_no, line"))
def cli_interactive(spark: SparkSession, folder: str) -> DataFrame:
    """A session of queries until one that ends it."""
    lines, typed = [], iter(_INTERACTIVE)
    main(["-s", f"--index_path={built(spark, folder).config.index_path}", f"--config_path_to_scan={ROOT}", "--config_file=/none"], spark=spark, read=lambda _: next(typed), write=lines.append)
    return _table(spark, list(enumerate(lines)), "line_no long, line string")


_ARGUMENTS = [
    (["-i", "--index_path=/i", "word", "-x"], "i", "index_path=/i", "word -x"),
    (["--check", "-v"], "check v", "", ""),
    (["-a", "-c", "--config_exact_match=true"], "a c", "config_exact_match=true", ""),
    (["--k=v=w", "(one", "AND", "two)"], "", "k=v=w", "(one AND two)"),
    (["--config_file=/a", "--config_file=/b", "--k=1", "--k=2"], "", "config_file=/a k=2", ""),
    (["-h"], "h", "", ""),
    ([], "", "", ""),
]


@put(_values([(i, o, s, q) for i, (_, o, s, q) in enumerate(_ARGUMENTS)], "line_no, options, settings, query"))
def cli_arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for i, (argv, *_) in enumerate(_ARGUMENTS):
        a = parse_arguments(argv)
        rows.append((i, " ".join(a.options), " ".join(f"{k}={v}" for k, v in a.settings.items()), a.query))
    return _table(spark, rows, "line_no long, options string, settings string, query string")


_EXITS = [([], 0, "help"), (["-h"], 0, "help"), (["-i", "--config_file=/none"], 1, "Invalid settings"), (["--index_path=/i", "--config_path_to_scan=/s", "--config_file=/none"], 0, "help")]


@put(_values([(i, code, said) for i, (_, code, said) in enumerate(_EXITS)], "line_no, code, said"))
def cli_exits(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for i, (argv, *_) in enumerate(_EXITS):
        lines: list[str] = []
        code = main(argv, spark=spark, write=lines.append)
        rows.append((i, code, "help" if "--help" in lines[-1] else lines[-1].partition(":")[0]))
    return _table(spark, rows, "line_no long, code long, said string")


# ---- settings

_LINES = ["# a note", "index_path=/i=x", "config_path_to_scan=/s", "unknown=1", "config_threads_to_use=4", "config_updated_files_only=True", "config_local_index_memory=10", "config_min_log_level=9", "lock_acquisition_timeout=-5", "config_exact_match=", "no sign"]
_OVERRIDES = {"config_threads_to_use": "2", "junk": "x"}
_LOADED = {
    "index_path": "/i=x", "path_to_scan": "/s", "lock_timeout": "0", "scan_dot_paths": "False", "updated_files_only": "False", "threads": "2",
    "memory": "50000", "log_level": "3", "exact_match": "False", "min_char": "4",
}


@put(_values([(k, v) for k, v in _LOADED.items()], "setting, value"))
def config_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults, then a file, then the command line."""
    config = load(_OVERRIDES | {k: v for k, v in parse_lines(_LINES).items() if k not in _OVERRIDES})
    return _table(spark, [(k, str(getattr(config, k))) for k in _LOADED], "setting string, value string")


@put("""SELECT run_id, max(index_path) AS index_path, max(coalesce(config_threads_to_use, 1)) AS threads,
max(greatest(coalesce(config_local_index_memory, 50000), 50000)) AS memory,
max(CASE WHEN coalesce(config_min_log_level, 3) BETWEEN 1 AND 4 THEN coalesce(config_min_log_level, 3) ELSE 3 END) AS log_level,
bool_and(coalesce(config_updated_files_only, 'true') = 'true') AS updated_files_only
FROM run_config WHERE run_id IS NOT NULL AND index_path IS NOT NULL AND config_path_to_scan IS NOT NULL AND coalesce(config_threads_to_use, 1) >= 1 GROUP BY run_id""")
def config_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The settings of every recorded run, as the engine takes them."""
    keys = ["index_path", "config_path_to_scan", "config_threads_to_use", "config_local_index_memory", "config_min_log_level", "config_updated_files_only"]
    rows = read_table(spark, folder, "run_config").where("run_id IS NOT NULL AND index_path IS NOT NULL AND config_path_to_scan IS NOT NULL AND coalesce(config_threads_to_use, 1) >= 1")
    rows = rows.select(F.col("run_id").cast("long"), *[F.col(k).cast("string") for k in keys]).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            configs = [load({k: v for k, v in r.items() if k in keys and v is not None}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "run_id": batch.column(0), "index_path": [c.index_path for c in configs], "threads": pa.array([c.threads for c in configs], pa.int64()),
                "memory": pa.array([c.memory for c in configs], pa.int64()), "log_level": pa.array([c.log_level for c in configs], pa.int64()),
                "updated_files_only": pa.array([c.updated_files_only for c in configs], pa.bool_()),
            })

    return rows.mapInArrow(work, "run_id long, index_path string, threads long, memory long, log_level long, updated_files_only boolean")


_BAD = [({}, "not set"), ({"index_path": "/i"}, "not set"), ({"index_path": "/i", "config_path_to_scan": "/s", "config_threads_to_use": "many"}, "config_threads_to_use is not a number"), ({"index_path": "/i", "config_path_to_scan": "/s"}, "fine")]


@put(_values([(i, said) for i, (_, said) in enumerate(_BAD)], "line_no, said"))
def config_refused(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for i, (settings, _) in enumerate(_BAD):
        try:
            load(settings)
            rows.append((i, "fine"))
        except ConfigError as e:
            rows.append((i, str(e).partition(":")[0]))
    return _table(spark, rows, "line_no long, said string")


@put(_values(list(DEFAULTS.items()), "setting, value"))
def config_defaults(spark: SparkSession, folder: str) -> DataFrame:
    config = load({"index_path": "-", "config_path_to_scan": "-"})
    shown = {
        "index_path": "", "config_path_to_scan": "", "lock_acquisition_timeout": config.lock_timeout, "config_scan_dot_paths": config.scan_dot_paths,
        "config_updated_files_only": config.updated_files_only, "config_threads_to_use": config.threads, "config_local_index_memory": config.memory,
        "config_min_log_level": config.log_level, "config_exact_match": config.exact_match, "config_min_char_for_match": config.min_char,
    }
    return _table(spark, [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in shown.items()], "setting string, value string")


# ---- a tree on disk


def _tree(spark: SparkSession, folder: str) -> str:
    """The last content of every path of `files`, written below a working folder by the executors."""

    def make() -> str:
        root = working_folder(spark, "tree").removeprefix("file:")
        rows = qi._file_rows(spark, folder).select("path", "content").where("path IS NOT NULL")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    system, inner, _ = _opened(f"{root}/{path.lstrip('/')}")
                    if system is not None:
                        system.create_dir(inner.rpartition("/")[0])
                        with system.open_output_stream(inner) as f:
                            f.write(content or b"")
                        continue
                    os.makedirs(os.path.dirname(inner), exist_ok=True)
                    with open(inner, "wb") as f:
                        f.write(content or b"")
                yield batch.select(["path"])

        rows.mapInArrow(work, "path string").count()
        # folders that look like files are none
        for name in ("folder.txt", "sub/folder.md"):
            system, inner, _ = _opened(f"{root}/{name}")
            system.create_dir(inner) if system is not None else os.makedirs(inner, exist_ok=True)
        return root

    return _once(spark, folder, "tree", make)


_FILES = "f AS (SELECT path, arg_max(content, (modificationtime, run_id)) AS content FROM files WHERE path IS NOT NULL GROUP BY path)"
_BELOW = "regexp_replace('/' || ltrim(path, '/'), '/+', '/', 'g')"


@put(f"WITH {_FILES} SELECT {_BELOW} AS path, coalesce(octet_length(content), 0) AS length FROM f")
def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a root, with its size."""
    root = _tree(spark, folder)
    return list_tree(spark, root).select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "length")


@put(f"WITH {_FILES} SELECT {_BELOW} AS path, md5(coalesce(content, ''::BLOB)) AS digest FROM f WHERE {qi._WANTED}")
def scan_read(spark: SparkSession, folder: str) -> DataFrame:
    """What is wanted of it, read."""
    root = _tree(spark, folder)
    listing = wanted(list_tree(spark, root).withColumn("inside", F.substr("path", F.lit(len(root) + 1))).where("NOT inside LIKE '%/.%'"))
    return read_files(listing, parts=8).select(F.substr("path", F.lit(len(root) + 1)).alias("path"), F.md5("content").alias("digest"))


def _indexed(spark: SparkSession, folder: str) -> Engine:
    def make() -> Engine:
        engine = _engine(spark, "run", _tree(spark, folder), threads=4)
        engine.index()
        return engine

    return _once(spark, folder, "indexed", make)


@put(qi.SQL["tok_files"].replace("SELECT path, word FROM words", f"SELECT {_BELOW} AS path, word FROM words").replace("FROM files GROUP", "FROM files WHERE path IS NOT NULL GROUP"))
def index_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run of the engine over the tree: walk, filter, read, tokenize, write."""
    engine = _indexed(spark, folder)
    return _words_of(engine).select(F.substr("path", F.lit(len(engine.config.path_to_scan) + 1)).alias("path"), "word")


@put(f"WITH {_FILES} SELECT count(*) AS n_paths, true AS unchanged, CAST(0 AS BIGINT) AS n_unread FROM f WHERE {qi._WANTED}")
def index_run_again(spark: SparkSession, folder: str) -> DataFrame:
    """A second run, of changed files only, finds none and commits nothing but its time."""
    engine = _indexed(spark, folder)
    before = engine.store.manifest()
    after = engine.index()
    return _table(spark, [(after["n_paths"], before["segments"] == after["segments"], engine.store.unread().count())], "n_paths long, unchanged boolean, n_unread long")


@put(f"WITH {_FILES} SELECT 'read ' || count(*) || ' files, ' || coalesce(sum(octet_length(content)), 0) || ' bytes, ' || count(*) FILTER (coalesce(octet_length(content), 0) = 0) || ' empty' AS line FROM f WHERE {qi._WANTED}")
def index_run_log(spark: SparkSession, folder: str) -> DataFrame:
    """The totals that a run writes to its log."""
    engine, out = _engine(spark, "logged", _tree(spark, folder)), io.StringIO()
    log_to(out, LEVELS[2])
    try:
        engine.index(full=True)
    finally:
        logging.getLogger("palimpsest").handlers = []
    lines = [line.split(" INFO ", 1)[1] for line in out.getvalue().splitlines() if " INFO read" in line]
    return _table(spark, [(line,) for line in lines], "line string")


# ---- lock, health, recovery


@put(_values([(0, "free"), (1, "ours"), (2, "taken"), (3, "refused"), (4, "free"), (5, "free"), (6, "ours"), (7, "free")], "step, status"))
def lock_states(spark: SparkSession, folder: str) -> DataFrame:
    """A lock through its life, and a leftover of a process that is gone."""
    files = _engine(spark, "lock").store.files
    one, other = IndexLock(files, 0), IndexLock(files, 0)
    seen = [one.status()]
    one.acquire()
    seen += [one.status(), other.status()]
    try:
        other.acquire()
        seen.append("got it")
    except TimeoutError:
        seen.append("refused")
    one.release()
    seen.append(one.status())
    files.create("index.lock", f"{socket.gethostname()} 999999999")
    seen.append(other.status())
    other.acquire()
    seen.append(other.status())
    other.release()
    seen.append(other.status())
    return _table(spark, list(enumerate(seen)), "step long, status string")


@put(_values([("empty", True, 0), ("committed", True, 1), ("broken", True, 1), ("mended", True, 2), ("lost", False, 2)], "step, healthy, version"))
def store_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """A commit that breaks off leaves the version before in force, and what it left is cleaned away."""
    engine, files = _engine(spark, "recovery"), document_files(spark, folder).drop("doc_id")
    state = lambda: (engine.store.healthy(), engine.store.manifest()["version"])
    rows = [("empty", *state())]
    engine.take_in(files, NOW)
    rows.append(("committed", *state()))
    write = engine.store.files.write_json
    try:
        engine.store.files.write_json = lambda *a: (_ for _ in ()).throw(OSError("gone"))
        engine.take_in(files, NOW)
    except OSError:
        rows.append(("broken", *state()))
    finally:
        engine.store.files.write_json = write
    engine.store.clean()
    engine.take_in(files, NOW)
    rows.append(("mended", *state()))
    engine.store.files.delete(engine.store.manifest()["paths"][-1])
    rows.append(("lost", *state()))
    return _table(spark, rows, "step string, healthy boolean, version long")


@put(f"{PATHS_SQL} SELECT path, word_count, TIMESTAMP '2024-01-01' AS last_updated FROM (SELECT path, count(word) AS word_count FROM q LEFT JOIN p ON p.path_id = q.doc_id GROUP BY path)")
def store_known_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, counts and the watermark, read anew by another engine on the same folder."""
    again = Engine(spark, EngineConfig(built(spark, folder).config.index_path, ROOT))
    mark = again.store.last_updated().replace(tzinfo=None)
    return again.store.paths().select("path", "word_count", F.lit(mark).cast("timestamp_ntz").alias("last_updated"))


@put(_values([(0, 0, 0, 0, 0, True)], "n_hits, paths, postings, words, version, healthy"))
def store_empty(spark: SparkSession, folder: str) -> DataFrame:
    """A folder without an index is an empty one."""
    engine = _engine(spark, "empty")
    stats = engine.store.stats()
    row = (engine.search("anything").count(), *(stats[k] for k in ("paths", "postings", "words", "version")), engine.store.healthy())
    return _table(spark, [row], "n_hits long, paths long, postings long, words long, version long, healthy boolean")


@put(f"""WITH {_FILES} SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS line_no,
unnest(['Indexed: version 1, ' || count(*) || ' paths.', 'No corruption found.', chr(10) || 'No results found.']) AS line FROM f WHERE {qi._WANTED}""")
def cli_index_check_query(spark: SparkSession, folder: str) -> DataFrame:
    """Index, check and query by the command line, with a settings file whose root an option replaces."""
    engine, lines = _engine(spark, "by hand", _tree(spark, folder)), []
    settings = os.path.join(tempfile.mkdtemp(prefix="palimpsest-settings-"), "config.txt")
    with open(settings, "w") as f:
        f.write(f"# where\nindex_path={engine.config.index_path}\nconfig_path_to_scan=/nowhere\nlock_acquisition_timeout=0\n")
    main([f"--config_file={settings}", f"--config_path_to_scan={engine.config.path_to_scan}", "-i", "--check", "xyzzyqwkplm"], spark=spark, write=lines.append)
    return _table(spark, list(enumerate(lines)), "line_no long, line string")


@put(f"WITH {_FILES} SELECT {_BELOW} AS path FROM f WHERE {qi._WANTED} AND path LIKE '%.txt'")
def cli_current_folder(spark: SparkSession, folder: str) -> DataFrame:
    """What is indexed of the folder that the command is given in: all of it, whatever the settings say."""
    root, engine = _tree(spark, folder), _engine(spark, "current", "/nowhere")
    before = os.getcwd()
    try:
        os.chdir(root)
        main(["-c", "-i", f"--index_path={engine.config.index_path}", "--config_path_to_scan=/nowhere", "--config_file=/none"], spark=spark, write=lambda _: None)
    finally:
        os.chdir(before)
    below = engine.store.paths().select(F.regexp_replace("path", f"^.*{os.path.basename(root)}", "").alias("path"))
    return below.where("path LIKE '%.txt'")
