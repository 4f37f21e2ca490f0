"""Session settings, table access and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "palimpsest") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one named in ``spark.checkpoint.dir``.

    A local session that names none (tests, a laptop) gets a temporary folder;
    a cluster must name one, since its executors share no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return context.getCheckpointDir()


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables beside the checkpoints; `clean_up` removes it with them."""
    return f"{shared_folder(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Removes checkpoints and written tables of this application. Results that still read them are lost."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes
    it once nothing refers to it any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most_rows` rows.

    Above that it comes back as it is, and the join that it enters shuffles.
    The rows of `df` must be narrow: their number is the bound.
    """
    return df.hint("broadcast") if df.count() <= most_rows else df


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table, redistributed where its files give work to less than half of the cores.

    A large table has more splits than that and is left as it is read.
    """
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python may not have it on its path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-code-")) / "palimpsest.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
