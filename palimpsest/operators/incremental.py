"""Processing only what is new or changed since the last successful run.

A manifest lists every input file that a committed run has taken in, with its
size and a checksum. A run writes the part of its listing that the manifest
lacks, once, under its batch identifier; it processes that copy, writes the
output under the identifier and then commits the copy as a further part of the
manifest, by one entry of a log. What arrives while a run is going on is not
in the copy, so it is neither processed nor committed and stays for the next
run. A run that breaks off before its commit leaves the log as it was, and its
folders are overwritten when the batch is tried again, so nothing is skipped
and nothing is taken in twice. One run at a time: a lock keeps others out.

Parts of the manifest are joined into one after every COMPACT commits; the log
entry names the parts in force, so a run reads one entry and those parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.session import sized_broadcast, working_folder
from palimpsest.store.lock import IndexLock, link_or_copy

STATE = ("length", "checksum")
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("turn", T.LongType()),
])
COMPACT = 20


class FileStore:
    """A folder on any file system that Spark's Hadoop layer can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        fs, path = self._fs(name), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read_text(self, name: str) -> str | None:
        """None where there is no such file."""
        if not self.exists(name):
            return None
        stream = self._fs(name).open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read_text(name) or "")

    def age(self, name: str) -> float:
        """Seconds since the file was written, 0 where there is none."""
        if not self.exists(name):
            return 0.0
        return max(0.0, (self._jvm.java.lang.System.currentTimeMillis() - self._fs(name).getFileStatus(self._path(name)).getModificationTime()) / 1000)

    def _write(self, name: str, text: str) -> None:
        stream = self._fs(name).create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with its text in one step. False where there is one already."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        self._write(fresh, text)
        return self.move(fresh, name)

    def move(self, name: str, to: str) -> bool:
        """Renames in one step. False, and `name` is gone, where `to` exists."""
        try:
            uri = self._path(name).toUri()
            if (uri.getScheme() or self._fs(name).getUri().getScheme()) == "file":
                # renaming overwrites on local disks, a link doesn't
                return link_or_copy(uri.getPath(), self._path(to).toUri().getPath())
            try:
                self._rename(name, to, "NONE")
            except Exception:
                if self.exists(to):
                    return False
                raise
            return True
        finally:
            self.delete(name)

    def _rename(self, name: str, to: str, how: str) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = getattr(rename, how)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(to).toUri(), self._conf).rename(self._path(name), self._path(to), options)

    def write_json(self, name: str, value: dict) -> None:
        """Replaces the file in one step: readers see the old text or the new."""
        self._write(f"{name}.next", json.dumps(value, sort_keys=True))
        self._rename(f"{name}.next", name, "OVERWRITE")


class IncrementalJob:
    """Runs of one job over a growing set of files.

    `root` holds ``todo/<batch>`` (what a batch took in, and a part of the
    manifest once committed), ``out/batch=<batch>``, ``manifest/<turn>`` (parts
    joined) and ``log/<turn>.<batch>.json``. `keys` name a file.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("path",), lock_timeout: float = 30):
        self.spark, self.store, self.keys = spark, FileStore(spark, root), keys
        self.lock_timeout = lock_timeout
        extra = [T.StructField(k, T.StringType()) for k in keys if k != "path"]
        self.schema = T.StructType([*extra, *MANIFEST.fields])

    def lock(self) -> IndexLock:
        return IndexLock(self.store, self.lock_timeout)

    def _log(self) -> list[str]:
        return [n for n in self.store.names("log") if n.endswith(".json")]

    def batches(self) -> list[str]:
        """Identifiers of the committed batches, in order."""
        return [unquote(n.split(".", 1)[1].removesuffix(".json")) for n in self._log()]

    def _last(self) -> dict:
        log = self._log()
        return self.store.read_json(f"log/{log[-1]}") if log else {"turn": 0, "parts": []}

    def manifest(self) -> DataFrame:
        """Each file once, as the last batch that took it in saw it."""
        parts = self._last()["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.store.root}/{p}" for p in parts])
        if len(parts) == 1 and parts[0].startswith("manifest/"):
            return rows
        own = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*own), "turn").alias("m"))
        return last.select(*[c if c in self.keys else F.col("m")[c].alias(c) for c in self.schema.names])

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of `listing` (keys, length, checksum, ...) not in the manifest as they are.

        Null keys are left out; of differing rows of a file the one of the
        greatest length, then checksum, comes out, and the file once; a null
        length or checksum equals a null one.
        """
        rest = [c for c in listing.columns if c not in self.keys]
        given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        best = F.max_by(F.struct(*rest), F.struct(*STATE, F.xxhash64(*rest)))
        clean = listing.where(given).groupBy(*self.keys).agg(best.alias("r"))
        clean = clean.select(*[c if c in self.keys else F.col("r")[c].alias(c) for c in listing.columns])
        return unseen(clean, self.manifest(), list(self.keys), list(STATE))

    def run(self, batch_id: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Takes in what is pending. False: the batch was committed before."""
        return self._commit(batch_id, lambda: self.pending(listing), process)

    def catch_up(self, batch_id: str, history: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Many runs that are known already, as one batch: the same as `run` with one after the other.

        `history`: keys, length, checksum, batch_id (of the run), turn (its
        place among the runs), wanted (false: it commits what it lists, but
        nothing comes out); each file of a run once. Every entry is in force
        until the next run that lists the file; a run's rows are anti-joined
        with those in force for it. What is committed already is in force for
        the first run.
        """

        def todo() -> DataFrame:
            started = self._last()["turn"]
            rows = history.withColumn("turn", F.col("turn") + started)
            old = self.manifest().withColumn("wanted", F.lit(False))
            return rows.unionByName(old.select(*rows.columns)) if started else rows

        def pending(copy: DataFrame) -> DataFrame:
            by_file = Window.partitionBy(*self.keys).orderBy("turn")
            force = copy.select(*self.keys, *STATE, F.lead("turn").over(by_file).alias("turn")).where("turn IS NOT NULL")
            return process(unseen(copy.where("wanted").drop("wanted"), force, [*self.keys, "turn"], list(STATE)))

        return self._commit(batch_id, todo, pending, turns=history)

    def _commit(self, batch_id: str, todo: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], turns: DataFrame | None = None) -> bool:
        with self.lock():
            if batch_id in self.batches():
                return False
            name, last = quote(batch_id, safe=""), self._last()
            copy_at, turn = f"{self.store.root}/todo/{name}", last["turn"] + 1
            rows = todo()
            if turns is None:
                rows = rows.withColumns({"batch_id": F.lit(batch_id), "turn": F.lit(turn).cast("long")})
            rows.write.mode("overwrite").parquet(copy_at)
            copy = self.spark.read.schema(rows.schema).parquet(copy_at)
            process(copy).write.mode("overwrite").parquet(f"{self.store.root}/out/batch={name}")
            if turns is not None:
                turn = max(turn, copy.agg(F.max("turn")).first()[0] or 0)
            parts = [*last["parts"], f"todo/{name}"]
            if len(parts) > COMPACT:
                parts = [self._joined(parts, turn)]
            self.store.create(f"log/{turn:012d}.{name}.json", json.dumps({"turn": turn, "parts": parts}))
            return True

    def _joined(self, parts: list[str], turn: int) -> str:
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.store.root}/{p}" for p in parts])
        own = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*own), "turn").alias("m"))
        last = last.select(*[c if c in self.keys else F.col("m")[c].alias(c) for c in self.schema.names])
        last.write.mode("overwrite").parquet(f"{self.store.root}/manifest/{turn}")
        return f"manifest/{turn}"

    def output(self) -> DataFrame | None:
        """What the committed batches wrote; nothing of broken ones."""
        paths = [f"{self.store.root}/out/batch={quote(b, safe='')}" for b in self.batches()]
        return self.spark.read.option("basePath", f"{self.store.root}/out").parquet(*paths) if paths else None


def unseen(listing: DataFrame, manifest: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """Left anti join of a listing with a manifest; nulls equal nulls in `state`."""
    m = manifest.select(*[F.col(c).alias(f"__{c}") for c in (*keys, *state)])
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"__{c}"))
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return listing.join(m, same, "left_anti")


def history_of(listing: DataFrame, runs: DataFrame) -> DataFrame:
    """A recorded history as `catch_up` takes it: index_path, path, length, checksum, batch_id, turn, wanted.

    `listing`: run_id, path, mtime, length, seen_at. `runs`: run_id, index_path,
    config_updated_files_only, started_at, status. The checksum that a listing
    has is its time of change. Runs that failed commit nothing and are left
    out; full runs commit entries but take in everything, so nothing of theirs
    is wanted here.

    Repeated rows count once; of different rows of a run and path the last by
    seen_at holds; rows with a null path, run or index are left out; runs with
    one started_at are ordered by run_id, and a null started_at is the earliest.
    """
    ok = (
        runs.where((F.col("status") == "ok") & F.col("index_path").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("started_at", "index_path", "config_updated_files_only")).alias("r"))
        .select("run_id", "r.*")
        .withColumn("turn", F.row_number().over(Window.partitionBy("index_path").orderBy("started_at", "run_id")).cast("long"))
        .select("run_id", "index_path", "turn", F.coalesce(F.col("config_updated_files_only") == "true", F.lit(True)).alias("wanted"))
    )
    seen = (
        listing.where(F.col("path").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("run_id", "path")
        .agg(F.max(F.struct("seen_at", "mtime", "length")).alias("s"))
    )
    return seen.join(sized_broadcast(ok, 1_000_000), "run_id").select(
        "index_path", "path", F.col("s.length").alias("length"), F.col("s.mtime").cast("string").alias("checksum"),
        F.col("run_id").cast("string").alias("batch_id"), "turn", "wanted",
    )


def replay(listing: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """(run_id, path): what each incremental run of a recorded history had to take in.

    The history is taken in by an IncrementalJob in `root` (a new working
    folder if null) and the rows are what it wrote and committed.
    """
    spark = listing.sparkSession
    job = IncrementalJob(spark, root or working_folder(spark, "replay"), keys=("index_path", "path"))
    job.catch_up("history", history_of(listing, runs), lambda todo: todo.select(F.col("batch_id").cast("long").alias("run_id"), "path"))
    return job.output().select("run_id", "path")
