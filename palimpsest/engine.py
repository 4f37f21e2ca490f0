"""The engine: index a tree, search it, check it."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.tokens import DEFAULT, TokenizerConfig
from palimpsest.operators.check import check
from palimpsest.operators.merge import pairs, path_changes, unknown_pairs, without_paths
from palimpsest.operators.postings import corpus_counters, tokenized_files
from palimpsest.plans.boolean import ranked, search
from palimpsest.plans.query import SearchConfig
from palimpsest.session import checkpointed, sized_broadcast
from palimpsest.sources.config import EngineConfig
from palimpsest.sources.files import list_tree, parts_for, read_files, wanted
from palimpsest.store.lock import IndexLock
from palimpsest.store.snapshot import IndexStore

log = logging.getLogger("palimpsest")


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig, tokenizer: TokenizerConfig = DEFAULT):
        self.spark, self.config, self.tokenizer = spark, config, tokenizer
        self.store = IndexStore(spark, config.index_path)

    def lock(self) -> IndexLock:
        return self.store.lock(self.config.lock_timeout)

    def index(self, full: bool | None = None, path: str | None = None, mode: str = "additive") -> dict:
        """Takes in the files of the tree, changed ones only unless `full`. Returns the manifest.

        ``additive`` keeps all words that a path ever had; ``replace`` keeps
        those of its present content.
        """
        full = not self.config.updated_files_only if full is None else full
        started = dt.datetime.now(dt.timezone.utc)
        with self.lock():
            found = list_tree(self.spark, path or self.config.path_to_scan)
            listing = wanted(found, None if full else self.store.last_updated())
            if not full and self.store.manifest().get("unread"):
                # what could not be read last time is tried again, changed or not
                again = wanted(found).join(self.store.unread(), "path", "left_semi")
                listing = listing.unionByName(again).dropDuplicates(["path"])
            listing = checkpointed(listing)
            # the memory of the settings is shared by their threads; a task holds a megabyte at least
            held = max(1_000_000, self.config.memory // self.config.threads)
            documents = read_files(listing, parts_for(listing, self.config.threads), held)
            return self.take_in(documents, started, mode, retry=True)

    def take_in(
        self, documents: DataFrame, started: dt.datetime, mode: str = "additive", streams: dict[str, int] | None = None, retry: bool = False
    ) -> dict:
        """Merges documents (path, mtime, length, content) into the index and commits.

        `streams`: last batches of streams, recorded by the same commit. With
        `retry` a null content is a file that could not be read: it is not
        taken in but kept for the next run; else it is a file without words.
        """
        if mode not in ("additive", "replace"):
            raise ValueError(f"mode: {mode}")
        # content is cut down to words before anything is shuffled
        rows = documents.where(F.col("path").isNotNull()).withColumn("__unread", F.col("content").isNull() & F.lit(retry))
        all_ = tokenized_files(rows, self.tokenizer, "__unread")
        # a listing of a run has each path once, and its words stay where they were read
        all_ = checkpointed(all_ if retry else all_.dropDuplicates(["path"]))
        tokenized, failed = all_.where("NOT __unread").drop("__unread"), all_.where("__unread").select("path")
        counters = corpus_counters(tokenized, "length").first()
        lost = failed.count() if retry else 0
        log.info("read %s files, %s bytes, %s empty", counters["n_files"], counters["n_bytes"], counters["n_empty"])
        if lost:
            log.warning("%s files could not be read; the next run tries them again", lost)
        old_state = self.store.manifest()
        if not counters["n_files"] and not lost:
            new = old_state | {"last_updated": started.isoformat(), "streams": old_state.get("streams", {}) | (streams or {}), "unread": None}
            self.store.files.write_json("MANIFEST.json", new)
            return new
        fresh = tokenized.select("path", F.size("words").cast("long").alias("word_count"), "mtime")
        before, last = self.store.paths(), old_state["n_paths"]
        changes = checkpointed(path_changes(before, fresh, last))
        known = changes.where(F.col("path_id") <= last).select("path_id")
        n_paths = last + changes.where(F.col("path_id") > last).count()
        new, old = pairs(tokenized, changes), self.store.postings()
        done = {"streams": streams, "unread": failed if lost else None}
        if mode == "replace":
            made = self.store.commit(without_paths(old, known).unionByName(new), changes, n_paths, started, replace=True, **done)
        else:
            if old_state["segments"] and not known.isEmpty():
                # only paths that are read again can have postings already
                held = old.join(sized_broadcast(known, 1_000_000), "path_id", "left_semi")
                new = unknown_pairs(new, held)
            made = self.store.commit(new, changes, n_paths, started, **done)
        log.info("committed version %s with %s paths", made["version"], made["n_paths"])
        return made

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        """(rank, path_id, path, count) of the paths that the query finds."""
        settings = SearchConfig(self.config.exact_match, self.config.min_char)
        return ranked(search(self.store.postings(), text, settings), self.store.paths(), limit)

    def check(self) -> DataFrame:
        with self.lock():
            return check(self.store.postings(), self.store.paths(), fresh=self.store.manifest()["fresh"])
