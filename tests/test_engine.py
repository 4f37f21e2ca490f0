import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.cli import main, parse_arguments
from palimpsest.engine import Engine
from palimpsest.operators.check import check, report
from palimpsest.schemas import DOCS
from palimpsest.sources.config import ConfigError, EngineConfig, load
from palimpsest.sources.files import list_tree, read_files, wanted
from palimpsest.store.lock import IndexLock, LockTimeout
from palimpsest.streaming.ingest import ingest, take_batch


def write(folder, name, text=""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "scan"
    write(root, "one.txt", "which people would there\n")
    write(root, "sub/two.txt", "people garden which garden\n")
    write(root, "notes.md", "people people people\n")
    return root


@pytest.fixture
def engine(spark, tree, tmp_path):
    return Engine(spark, EngineConfig(str(tmp_path / "index"), str(tree), lock_timeout=0))


def hits(engine, query):
    return {os.path.basename(r["path"]): r["count"] for r in engine.search(query).collect()}


def test_six_phases(engine, tree, spark):
    first = engine.index()
    assert first["n_paths"] == 3 and "No corruption" in report(engine.check())
    ids = {r["path"]: r["path_id"] for r in engine.store.paths().collect()}
    write(tree, "three.txt", "would garden orchard\n")
    engine.index(full=True)
    assert "No corruption" in report(engine.check())
    now = {r["path"]: r["path_id"] for r in engine.store.paths().collect()}
    assert ids.items() <= now.items() and sorted(now.values()) == [1, 2, 3, 4]
    assert hits(engine, "xyzzyqwkplm") == {}
    assert hits(engine, "which") == {"one.txt": 1, "two.txt": 1}
    assert hits(engine, '"people"') == {"one.txt": 1, "two.txt": 1}
    assert hits(engine, "(which AND would)") == {"one.txt": 2}
    assert hits(engine, "((which OR would) AND garden)") == {"two.txt": 2, "three.txt": 2}
    write(tree, "unique_test.txt", "zyxwvutsrqp here\nzyxwvutsrqp\n")
    engine.index()
    assert hits(engine, "zyxwvutsrqp") == {"unique_test.txt": 1} and hits(engine, "unique") == {"unique_test.txt": 1}
    write(tree, "empty.txt")
    write(tree, "whitespace.txt", "     \n")
    write(tree, "special.txt", "Test with special chars: @#$%^&*()!\n")
    assert engine.index(full=True)["n_paths"] == 8
    assert "No corruption" in report(engine.check()) and hits(engine, "chars") == {"special.txt": 1}
    before = engine.store.postings().count()
    engine.index(full=True)
    assert engine.store.postings().count() == before
    assert engine.store.compact()["segments"] and engine.store.postings().count() == before


def test_additive_and_replacing(engine, tree):
    engine.index()
    write(tree, "one.txt", "orchard meadow\n")
    engine.index(full=True)
    assert hits(engine, "which") == {"one.txt": 1, "two.txt": 1} and hits(engine, "meadow") == {"one.txt": 1}
    counts = {os.path.basename(r["path"]): r["word_count"] for r in engine.store.paths().collect()}
    assert counts == {"one.txt": 2, "two.txt": 3, "notes.md": 0}
    engine.index(full=True, mode="replace")
    assert hits(engine, "which") == {"two.txt": 1} and engine.store.manifest()["fresh"]
    assert "No corruption" in report(engine.check())


def test_watermark(engine, tree):
    engine.index()
    mark = engine.store.last_updated()
    old = write(tree, "old.txt", "forgotten words\n")
    os.utime(old, (0, 0))
    same = write(tree, "same.txt", "exactly then\n")
    os.utime(same, ns=(0, int(mark.timestamp() * 1_000_000) * 1000))
    engine.index()
    assert hits(engine, "forgotten") == {} and hits(engine, "exactly") == {"same.txt": 1}


def test_broken_commit_leaves_the_old_version(engine, tree, monkeypatch):
    engine.index()
    write(tree, "three.txt", "orchard words\n")
    with monkeypatch.context() as m:
        m.setattr(type(engine.store.files), "write_json", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            engine.index(full=True)
    assert engine.store.healthy() and engine.store.manifest()["version"] == 1 and hits(engine, "orchard") == {}
    assert engine.store.clean() == ["paths/version=2", "postings/segment=2"]
    engine.index(full=True)
    assert hits(engine, "orchard") == {"three.txt": 1}


def test_nothing_to_add_and_empty_index(spark, tmp_path):
    (tmp_path / "none").mkdir()
    e = Engine(spark, EngineConfig(str(tmp_path / "i"), str(tmp_path / "none"), lock_timeout=0))
    assert hits(e, "anything") == {} and e.index()["n_paths"] == 0 and hits(e, "anything") == {}
    assert e.store.stats() == {"paths": 0, "postings": 0, "words": 0, "version": 0, "segments": 0}


def test_only_wordless_files(spark, tmp_path):
    write(tmp_path / "s", "a.md", "markdown words\n")
    e = Engine(spark, EngineConfig(str(tmp_path / "i"), str(tmp_path / "s"), lock_timeout=0))
    assert e.index()["n_paths"] == 1 and hits(e, "markdown") == {} and e.store.postings().count() == 0
    assert "No corruption" in report(e.check())


def test_listing_and_reading(spark, tmp_path):
    root = tmp_path / "t"
    for name in ("a.txt", "sub/c.txt", "b.md", "empty.txt", "_u.txt", "f.TXT", "g.log", ".h.txt", ".dot/e.txt", "sub/.hid/d.txt"):
        write(root, name, "" if name == "empty.txt" else name)
    (root / "dir.txt").mkdir()
    os.symlink(root / "sub", root / "link")
    kept = wanted(list_tree(spark, str(root)))
    got = {os.path.relpath(r["path"], root): bytes(r["content"]).decode() for r in read_files(kept).collect()}
    assert got == {n: ("" if n == "empty.txt" else n) for n in ("a.txt", "sub/c.txt", "b.md", "empty.txt", "_u.txt")}
    assert list_tree(spark, str(tmp_path / "missing")).count() == 0


CORRUPT = {
    "C3 only a-z": (("A", "Apple", 1), None), "C4 no word twice for a path": (("a", "apple", 1), None),
    "C11 path id not empty": (("a", "acorn", 0), None), "C9 path id known": (("a", "acorn", 9), None),
    "C5 letter is the first of the word": (("b", "acorn", 1), None), "C7 word count given": (None, (3, "/c", None)),
    "C6 path given and unique": (None, (3, "/a", 0)), "C1 word not empty": (("", "", 1), None),
    "C2 word not too long": (("a", "a" * 256, 2), None), "C6 path ids 1 to n": (None, (7, "/c", 0)), "C6 path id unique": (None, (2, "/c", 0)),
}


@pytest.mark.parametrize("name", CORRUPT)
def test_check_finds(spark, name):
    posting, path = CORRUPT[name]
    postings = spark.createDataFrame([("a", "apple", 1), ("b", "berry", 2), *([posting] if posting else [])], "letter string, word string, path_id long")
    paths = spark.createDataFrame([(1, "/a", 1), (2, "/b", 1), *([path] if path else [])], "path_id long, path string, word_count long").withColumn("mtime", F.lit(None).cast("timestamp"))
    bad = {r["check"]: r["violations"] for r in check(postings, paths).where("NOT ok").collect()}
    assert bad.get(name) == 1 and set(bad) <= {name, "C6 path ids 1 to n"}


def test_check_empty(spark):
    store = spark.createDataFrame([], "letter string, word string, path_id long"), spark.createDataFrame([], "path_id long, path string, word_count long, mtime timestamp")
    assert check(*store, fresh=True).where("NOT ok").count() == 0


def test_config(tmp_path):
    file = write(tmp_path, "c.txt", "# note\nindex_path=/i=x\nconfig_path_to_scan=/s\nunknown=1\nconfig_threads_to_use=4\nconfig_updated_files_only=True\nconfig_local_index_memory=10\n")
    c = load({"config_threads_to_use": "2", "junk": "x"}, file)
    assert (c.index_path, c.threads, c.updated_files_only, c.memory, c.min_char) == ("/i=x", 2, False, 50_000, 4)
    with pytest.raises(ConfigError):
        load({"index_path": "/i"}, tmp_path / "missing")
    with pytest.raises(ConfigError):
        load({"index_path": "/i", "config_path_to_scan": "/s", "config_threads_to_use": "many"})


def test_lock(tmp_path):
    lock = IndexLock(tmp_path, timeout=0)
    with lock:
        assert lock.status() == "ours" and IndexLock(tmp_path).status() == "taken"
        with pytest.raises(LockTimeout):
            IndexLock(tmp_path, timeout=0).acquire()
    assert lock.status() == "free"
    import socket

    lock.path.write_text(f"{socket.gethostname()} 999999999")
    with IndexLock(tmp_path, timeout=0) as taken:
        assert taken.held


def test_stream_takes_each_batch_once(spark, engine, tmp_path):
    folder = tmp_path / "incoming"
    rows = lambda *names: spark.createDataFrame([(f"/in/{n}.txt", dt.datetime(2024, 1, 1), 9, bytearray(f"{n} words\n".encode())) for n in names], DOCS)
    rows("first", "second").write.parquet(str(folder))
    stream = lambda: spark.readStream.schema(DOCS).parquet(str(folder))
    ingest(engine, stream(), "in", str(tmp_path / "mark")).awaitTermination()
    assert hits(engine, "first") == {"first.txt": 1} and engine.store.manifest()["streams"] == {"in": 0}
    rows("third").write.mode("append").parquet(str(folder))
    ingest(engine, stream(), "in", str(tmp_path / "mark")).awaitTermination()
    assert hits(engine, "words") == {"first.txt": 1, "second.txt": 1, "third.txt": 1}
    assert not take_batch(engine, "in", rows("again"), 1) and hits(engine, "again") == {}
    assert take_batch(engine, "in", rows(), 2) and engine.store.manifest()["streams"] == {"in": 2}


def test_command_line(spark, tree, tmp_path):
    said = []
    say = lambda *a, **k: main(list(a), spark=spark, write=said.append, **k)
    paths = [f"--index_path={tmp_path / 'i'}", f"--config_path_to_scan={tree}", "--lock_acquisition_timeout=0", "--config_file=/none"]
    assert say() == 0 and "query" in said[-1]
    assert say("-i", *paths) == 0 and "3 paths" in said[-1]
    assert say(*paths, "which", "AND", "would") == 0 and "one.txt with 2 matches" in said[-1]
    assert say("--check", "-v", *paths) == 0 and said[-1] == "No corruption found."
    typed = iter(["garden", "q"])
    assert say("-s", *paths, read=lambda _: next(typed)) == 0 and "two.txt" in said[-1]
    assert say("-i", "--config_file=/none") == 1
    args = parse_arguments(["-a", "--k=v=w", "--check", "some", "-x"])
    assert (args.options, args.settings, args.query) == (["a", "check"], {"k": "v=w"}, "some -x")


def test_unread_files_are_tried_again(engine, tree, monkeypatch, spark):
    bad = write(tree, "locked.txt", "hidden treasure\n")
    os.utime(bad, (0, 0))
    import palimpsest.engine as module

    read = module.read_files
    with monkeypatch.context() as m:
        # permissions do not stop root, so the content is taken away on the way
        m.setattr(module, "read_files", lambda *a: read(*a).withColumn("content", F.when(F.col("path").endswith("/locked.txt"), None).otherwise(F.col("content"))))
        assert engine.index()["n_paths"] == 3
    assert hits(engine, "treasure") == {} and [r["path"] for r in engine.store.unread().collect()] == [str(bad)]
    assert engine.index()["n_paths"] == 4 and hits(engine, "treasure") == {"locked.txt": 1}
    assert engine.store.unread().count() == 0 and "No corruption" in report(engine.check())
    assert read_files(spark.createDataFrame([("/none/at/all", None, 1)], "path string, mtime timestamp, length long")).first()["content"] is None


def test_a_root_with_a_scheme(spark, tree):
    plain, named = (wanted(list_tree(spark, r)) for r in (str(tree), f"file://{tree}"))
    a = {(os.path.basename(r["path"]), r["mtime"], bytes(r["content"])) for r in read_files(plain).collect()}
    b = {(os.path.basename(r["path"]), r["mtime"], bytes(r["content"])) for r in read_files(named, parts=3).collect()}
    assert a == b and len(a) == 3
    assert list_tree(spark, f"file://{tree}/missing").count() == 0


def test_a_flat_folder_is_read_by_many_tasks(spark, tmp_path):
    for i in range(200):
        write(tmp_path / "flat", f"f{i}.txt", "some words\n")
    listing = list_tree(spark, str(tmp_path / "flat"))
    assert listing.rdd.getNumPartitions() > 4
    sizes = [r["count"] for r in listing.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 and max(sizes) < 100


def test_runs_write_only_what_changed(engine, tree):
    engine.index()
    write(tree, "three.txt", "orchard words\n")
    made = engine.index()
    assert made["paths"] == ["paths/version=1", "paths/version=2"]
    assert engine.store._path_rows(["paths/version=2"]).count() < 4 and engine.store.paths().count() == 4
    with engine.lock(), pytest.raises(LockTimeout):
        engine.store.compact(timeout=0)
    assert engine.store.compact()["paths"] == ["paths/version=3"] and engine.store.paths().count() == 4


def test_totals_are_logged(spark, tree, tmp_path, capsys):
    paths = [f"--index_path={tmp_path / 'i'}", f"--config_path_to_scan={tree}", "--config_file=/none"]
    assert main(["-i", "--config_min_log_level=2", *paths], spark=spark, write=lambda _: None) == 0
    assert "read 3 files" in capsys.readouterr().err
    assert main(["-i", "-a", *paths], spark=spark, write=lambda _: None) == 0
    assert "read" not in capsys.readouterr().err


def test_leftover_locks(tmp_path):
    lock = IndexLock(tmp_path, timeout=0)
    lock.path.write_text("")
    assert lock.status() == "taken"  # somebody may be about to write
    with pytest.raises(LockTimeout):
        lock.acquire()
    os.utime(lock.path, (0, 0))
    assert lock.status() == "free"
    with lock, pytest.raises(LockTimeout):
        IndexLock(tmp_path, timeout=0).acquire()
    assert os.listdir(tmp_path) == []


def test_two_takers_of_a_leftover_lock(tmp_path):
    """One has seen the leftover; before it acts, the other takes it over."""
    slow, quick = IndexLock(tmp_path, timeout=0), IndexLock(tmp_path, timeout=0)
    slow.path.write_text("nobody")
    os.utime(slow.path, (0, 0))
    read = slow.files.read_text
    calls = []

    def late(name):
        text = read(name)
        if not calls:
            calls.append(1)
            quick.acquire()
        return text

    slow.files.read_text = late
    slow._stale = lambda text: True
    slow._remove_leftover()
    assert read(quick.path.name) == quick.mark and quick.held


def test_locks_without_links(tmp_path, monkeypatch):
    """On a file system that has none."""
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError("no links here")))
    one, other = IndexLock(tmp_path, timeout=0), IndexLock(tmp_path, timeout=0)
    with one, pytest.raises(LockTimeout):
        other.acquire()
    one.path.write_text("nobody")
    os.utime(one.path, (0, 0))
    with other:
        assert one.status() == "taken"
    assert os.listdir(tmp_path) == []
