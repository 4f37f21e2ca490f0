"""Index snapshots: immutable folders and one manifest that is replaced in a step.

Postings are kept as segments that only add up, and so is the path table, in
which the last row of a path id holds; a merge writes one more segment of each,
with what is new or changed. ``MANIFEST.json`` names the folders in force, so
readers never see half a commit, and a writer that breaks off leaves nothing
but folders that nobody names. Files that could not be read are kept in a
folder of their own, for the next run to try again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.incremental import FileStore
from palimpsest.schemas import PATHS, POSTINGS
from palimpsest.session import shuffle_partitions
from palimpsest.store.lock import IndexLock

EMPTY = {"version": 0, "segments": [], "paths": [], "unread": None, "last_updated": None, "n_paths": 0, "fresh": True}


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, FileStore(spark, root)

    def manifest(self) -> dict:
        return self.files.read_json("MANIFEST.json") if self.files.exists("MANIFEST.json") else dict(EMPTY)

    def healthy(self) -> bool:
        """The manifest can be read and all that it names is there."""
        try:
            m = self.manifest()
        except Exception:
            return False
        return all(self.files.exists(x) for x in _named(m))

    def postings(self) -> DataFrame:
        segments = self.manifest()["segments"]
        if not segments:
            return self.spark.createDataFrame([], POSTINGS)
        parted = T.StructType([*POSTINGS.fields, T.StructField("segment", T.LongType())])
        reader = self.spark.read.schema(parted).option("basePath", f"{self.files.root}/postings")
        return reader.parquet(*[f"{self.files.root}/{s}" for s in segments]).select(*POSTINGS.names)

    def paths(self) -> DataFrame:
        """One row per path id: the last that was written."""
        names = self.manifest()["paths"]
        if not names:
            return self.spark.createDataFrame([], PATHS)
        rows = self._path_rows(names)
        if len(names) == 1:
            return rows.select(*PATHS.names)
        last = rows.groupBy("path_id").agg(F.max_by(F.struct("path", "word_count", "mtime"), "version").alias("r"))
        return last.select("path_id", "r.*")

    def _path_rows(self, names: list[str]) -> DataFrame:
        parted = T.StructType([*PATHS.fields, T.StructField("version", T.LongType())])
        reader = self.spark.read.schema(parted).option("basePath", f"{self.files.root}/paths")
        return reader.parquet(*[f"{self.files.root}/{n}" for n in names])

    def unread(self) -> DataFrame:
        """Paths that the last run could not read."""
        name = self.manifest().get("unread")
        return self.spark.read.schema("path string").parquet(f"{self.files.root}/{name}") if name else self.spark.createDataFrame([], "path string")

    def write_segment(self, postings: DataFrame, name: str) -> None:
        """Parted by letter and sorted by word, so that a term's scan skips files and row groups.

        A letter is spread over several tasks by word: letters are skewed, and
        so are words, whose paths are spread as well.
        """
        n = shuffle_partitions(self.spark)
        spread = postings.repartitionByRange(n, "letter", "word", "path_id").sortWithinPartitions("letter", "word", "path_id")
        spread.write.mode("overwrite").partitionBy("letter").parquet(f"{self.files.root}/{name}")

    def commit(
        self, postings: DataFrame, paths: DataFrame, n_paths: int, started: dt.datetime, replace: bool = False,
        streams: dict[str, int] | None = None, unread: DataFrame | None = None,
    ) -> dict:
        """Adds a segment of postings (or, replacing, makes it the only one) and one of the paths that are new or changed."""
        old = self.manifest()
        version = old["version"] + 1
        segment, table = f"postings/segment={version}", f"paths/version={version}"
        paths.select(*PATHS.names).write.mode("overwrite").parquet(f"{self.files.root}/{table}")
        self.write_segment(postings.select(*POSTINGS.names), segment)
        failed = f"unread/version={version}" if unread is not None else None
        if failed:
            unread.select("path").write.mode("overwrite").parquet(f"{self.files.root}/{failed}")
        new = {
            "version": version,
            "segments": [segment] if replace else [*old["segments"], segment],
            "paths": [*old["paths"], table],
            "unread": failed,
            "last_updated": started.astimezone(dt.timezone.utc).isoformat(),
            "n_paths": n_paths,
            "fresh": replace or not old["segments"],
            "streams": old.get("streams", {}) | (streams or {}),
        }
        self.files.write_json("MANIFEST.json", new)
        self.clean(keep=_named(old))
        return new

    def clean(self, keep: list[str] = ()) -> list[str]:
        """Deletes folders that neither the manifest nor `keep` names: leftovers of broken runs and older versions."""
        named = {*_named(self.manifest()), *keep}
        gone = [f"{kind}/{x}" for kind in ("paths", "postings", "unread") for x in self.files.names(kind) if f"{kind}/{x}" not in named]
        for x in gone:
            self.files.delete(x)
        return gone

    def last_updated(self) -> dt.datetime | None:
        text = self.manifest()["last_updated"]
        return dt.datetime.fromisoformat(text) if text else None

    def lock(self, timeout: float = 30) -> IndexLock:
        return IndexLock(self.files, timeout)

    def compact(self, timeout: float = 30) -> dict:
        """All segments as one, under the lock, so that no commit is lost."""
        with self.lock(timeout):
            m = self.manifest()
            version = m["version"] + 1
            name, table = f"postings/segment={version}", f"paths/version={version}"
            self.write_segment(self.postings(), name)
            self.paths().select(*PATHS.names).write.mode("overwrite").parquet(f"{self.files.root}/{table}")
            new = m | {"version": version, "segments": [name], "paths": [table]}
            self.files.write_json("MANIFEST.json", new)
            return new

    def stats(self) -> dict:
        postings = self.postings()
        row = postings.agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("word").alias("words")).first()
        m = self.manifest()
        return {"paths": m["n_paths"], "postings": row["postings"], "words": row["words"], "version": m["version"], "segments": len(m["segments"])}


def _named(manifest: dict) -> list[str]:
    """Folders that a manifest names."""
    unread = manifest.get("unread")
    return [*manifest["segments"], *manifest["paths"], *([unread] if unread else [])]
