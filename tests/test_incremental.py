import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import incremental
from palimpsest.operators.incremental import IncrementalJob, history_of, replay
from palimpsest.store.lock import LockTimeout

LISTING = "path string, length long, checksum string, batch_id string"


def listing(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LISTING)


def test_only_new_and_changed_and_failures(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    count = lambda df: df.select("path", F.upper("path").alias("loud"))
    first = listing(spark, ("/a", 1, "x"), ("/a", 1, "x"), ("/b", 2, None), (None, 3, "z"))
    assert job.output() is None and job.run("b1", first, count)
    assert not job.run("b1", first, count)
    second = listing(spark, ("/a", 1, "y"), ("/b", 2, None), ("/c", None, None))

    def breaks(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/job/out/batch=b2")
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        job.run("b2", second, breaks)
    assert {r["path"] for r in job.output().collect()} == {"/a", "/b"}
    assert {r["path"] for r in job.pending(second).collect()} == {"/a", "/c"}
    assert job.run("b2", second, count)
    assert sorted((r["path"], r["batch"]) for r in job.output().collect()) == [("/a", "b1"), ("/a", "b2"), ("/b", "b1"), ("/c", "b2")]
    assert job.pending(second).count() == 0 and job.manifest().count() == 3
    assert job.run("b3", listing(spark), count) and job.manifest().count() == 3


def test_commit_that_breaks_off_repeats_nothing(spark, tmp_path, monkeypatch):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    rows = listing(spark, ("/a", 1, "x"))
    with monkeypatch.context() as m:
        make = type(job.store).create
        m.setattr(type(job.store), "create", lambda self, name, text: make(self, name, text) if "lock" in name else (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            job.run("b1", rows, lambda df: df.select("path"))
    assert job.output() is None and job.pending(rows).count() == 1
    assert job.run("b1", rows, lambda df: df.select("path")) and job.output().count() == 1


def test_files_that_arrive_during_a_run_wait_for_the_next(spark, tmp_path):
    """The listing is read from a folder that grows between the writes of a run."""
    folder = tmp_path / "listing"
    add = lambda *rows: listing(spark, *rows).write.mode("append").parquet(str(folder))
    add(("/a", 1, "x"), ("/b", 1, "x"))
    seen = lambda: spark.read.schema(LISTING).parquet(str(folder))
    job = IncrementalJob(spark, str(tmp_path / "job"))

    def late(df):
        if not (tmp_path / "done").exists():
            (tmp_path / "done").touch()
            add(("/late", 1, "x"), ("/a", 2, "y"))
        return df.select("path", "length")

    growing = spark.read.schema(LISTING).parquet(str(folder))
    assert job.run("b1", growing, late)
    assert {tuple(r)[:2] for r in job.output().collect()} == {("/a", 1), ("/b", 1)}
    assert {r["path"] for r in job.pending(seen()).collect()} == {"/a", "/late"}
    assert job.run("b2", seen(), late)
    assert sorted((r["path"], r["length"], r["batch"]) for r in job.output().collect()) == [("/a", 1, "b1"), ("/a", 2, "b2"), ("/b", 1, "b1"), ("/late", 1, "b2")]
    assert job.pending(seen()).count() == 0


def test_many_batches_are_compacted_and_one_runs_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 3)
    job = IncrementalJob(spark, str(tmp_path / "job"), lock_timeout=0)
    for i in range(5):
        assert job.run(f"day {i}/x", listing(spark, ("/same", 1, "x"), (f"/{i}", i, None)), lambda df: df.select("path"))
    assert job.batches() == [f"day {i}/x" for i in range(5)] and not job.run("day 2/x", listing(spark, ("/new", 1, "x")), lambda df: df)
    assert {r["path"]: r["batch_id"] for r in job.manifest().collect()} == {"/same": "day 0/x"} | {f"/{i}": f"day {i}/x" for i in range(5)}
    assert len(job._last()["parts"]) <= 3 and job.output().count() == 6
    with job.lock(), pytest.raises(LockTimeout):
        job.run("again", listing(spark), lambda df: df.select("path"))


def test_of_differing_rows_one_state_holds(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    rows = listing(spark, ("/a", 1, "x"), ("/a", 3, "b"), ("/a", 3, "c"), ("/a", None, "z"))
    assert [(r["length"], r["checksum"]) for r in job.pending(rows.repartition(3)).collect()] == [(3, "c")]


def test_catching_up_is_one_run_after_the_other(spark, tmp_path):
    rng = random.Random(8)
    runs = [(i, rng.choice(["/x", "/y"]), rng.choice(["true", "true", "false"]), f"2024-01-{i + 1:02d}", rng.choice(["ok", "ok", "ok", "crashed"])) for i in range(8)]
    seen = [(i, p, rng.choice(["t1", "t2", None]), rng.choice([1, 2, None]), "now") for i in range(8) for p in rng.sample(["/a", "/b", "/c", "/d"], 3)]
    l = spark.createDataFrame(seen, "run_id long, path string, mtime string, length long, seen_at string")
    r = spark.createDataFrame(runs, "run_id long, index_path string, config_updated_files_only string, started_at string, status string")
    rows = history_of(l, r).cache()
    single = IncrementalJob(spark, str(tmp_path / "single"), keys=("index_path", "path"))
    pick = lambda df: df.select("batch_id", "path")
    for i, *_ in sorted((x for x in runs if x[4] == "ok"), key=lambda x: x[3]):
        of_run = rows.where(F.col("batch_id") == str(i))
        # a full run commits what it lists; what it takes in is no case
        keep = (lambda df: pick(df)) if of_run.first()["wanted"] else (lambda df: pick(df).where("false"))
        assert single.run(str(i), of_run.select("index_path", "path", "length", "checksum"), keep)
    at_once = IncrementalJob(spark, str(tmp_path / "at once"), keys=("index_path", "path"))
    assert at_once.catch_up("all", rows, pick) and not at_once.catch_up("all", rows, pick)
    got = {tuple(x)[:2] for x in at_once.output().collect()}
    assert got == {tuple(x)[:2] for x in single.output().collect()} and len(got) > 5
    assert {tuple(x)[:4] for x in at_once.manifest().collect()} == {tuple(x)[:4] for x in single.manifest().collect()}
    # and goes on from there, at once or run by run
    more = spark.createDataFrame([("/x", "/a", 9, "t9")], "index_path string, path string, length long, checksum string")
    assert at_once.run("next", more, pick)
    later = rows.where("wanted").withColumn("batch_id", F.concat(F.lit("again"), "batch_id"))
    one, two = (IncrementalJob(spark, str(tmp_path / n), keys=("index_path", "path")) for n in ("at once", "single"))
    assert two.run("next", more, pick)
    assert one.catch_up("later", later, pick)
    for b in sorted({x["batch_id"] for x in later.select("batch_id").collect()}, key=lambda b: int(b[5:])):
        two.run(b, later.where(F.col("batch_id") == b).select("index_path", "path", "length", "checksum"), pick)
    assert sorted((x["batch_id"], x["path"]) for x in one.output().collect()) == sorted((x["batch_id"], x["path"]) for x in two.output().collect())


def plain(runs, seen):
    """Walks the runs of each index in order of time."""
    out, state = set(), {}
    for run in sorted({r for r in runs if r[4] == "ok" and r[1]}, key=lambda r: (r[3], r[0])):
        for rid, path, mtime, length, _ in {s for s in seen if s[0] == run[0] and s[1] is not None}:
            key = (run[1], path)
            if run[2] in (None, "true") and state.get(key) != (mtime, length):
                out.add((rid, path))
            state[key] = (mtime, length)
    return out


def test_replay_equals_plain(spark):
    rng = random.Random(5)
    runs = [(i, rng.choice(["/x", "/y", None]), rng.choice(["true", None, "false", "True", ""]), f"2024-01-{rng.randint(1, 28):02d}", rng.choice(["ok", "ok", "failed", "crashed"])) for i in range(40)]
    seen = [(r[0], rng.choice(["/a", "/b", "/c", None]), rng.choice(["t1", "t2", None]), rng.choice([1, 2, None])) for r in runs for _ in range(2)]
    seen = [(*s, "now") for s in {(s[0], s[1]): s for s in seen}.values()]
    l = spark.createDataFrame(seen + seen[:9], "run_id long, path string, mtime string, length long, seen_at string")
    r = spark.createDataFrame(runs + runs[:5], "run_id long, index_path string, config_updated_files_only string, started_at string, status string")
    assert {tuple(x) for x in replay(l, r).collect()} == plain(runs, seen)
    assert replay(l, r).count() == len(plain(runs, seen))
    assert replay(l.where("false"), r).count() == 0 and replay(l, r.where("false")).count() == 0
