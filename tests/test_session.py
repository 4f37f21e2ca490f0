import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from palimpsest.session import clean_up, shared_folder, working_folder


def fake(master, named=None):
    """A session that has made no checkpoint yet."""
    held = {"dir": None}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held["dir"], setCheckpointDir=lambda d: held.update(dir=d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named or default))


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://host:7077"))
    assert shared_folder(fake("spark://host:7077", "/shared")) == "/shared"
    assert shared_folder(fake("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert "palimpsest" in shared_folder(fake("local[4]"))
    one = fake("local", "/shared")
    assert working_folder(one, "x") != working_folder(one, "x") and working_folder(one, "x").startswith("/shared/palimpsest/x-")


def test_clean_up_removes_what_was_written():
    """In a session of its own, whose folders no other test reads."""
    code = """
from palimpsest.session import checkpointed, clean_up, local_session, working_folder
import os
spark = local_session(2)
checkpointed(spark.range(10)).count()
folder = working_folder(spark, "t")
spark.range(5).write.parquet(folder)
root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
assert len(os.listdir(root)) == 2, os.listdir(root)
clean_up(spark)
assert not os.path.exists(root)
print("clean")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=120)
    assert done.stdout.strip().endswith("clean"), done.stderr[-2000:]
    clean_up(fake("local"))  # nothing was written: nothing to remove


def test_the_entry_does_without_the_llm_part(tmp_path):
    """Also where a module of it is broken or missing."""
    import shutil

    root = Path(__file__).parent.parent
    shutil.copytree(root / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('p'))[0])"
    count = lambda: subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=120).stdout.split()
    broken = tmp_path / "palimpsest/llm"
    if broken.exists():
        (broken / "words.py").unlink()
        assert count()[1] == "p3_found"
        shutil.rmtree(broken)
    found = count()
    assert found[1] == "p3_found" and int(found[0]) > 90
