"""Where intermediate tables go, and how a lineage is cut.

Intermediate results that several later steps read are written once as
Parquet into the shared folder named by ``spark.checkpoint.dir`` and read
back.  A written table survives the loss of executors, is columnar (later
steps read only the columns they need) and gives the optimizer real sizes.

Inside `run_scope` the tables go to a folder of the caller instead: a run
that lost its driver finds the finished ones again, and a run that ends well
deletes them.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's setting that removes the shuffle files of a query when it has ended (unknown to older versions).
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster the folder must be named by the session; only a local
    session that names none gets a folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="linkloom-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass
class _Run:
    folder: str
    written: Counter = field(default_factory=Counter)

    def path(self, name: str) -> str:
        """The n-th table of a name has the same path in every attempt of the run."""
        self.written[name] += 1
        return f"{self.folder}/{name}-{self.written[name]}"


_RUN: ContextVar[_Run | None] = ContextVar("run", default=None)


def _located(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms, whatever the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table has the mark that Spark leaves at the end of a write."""
    files, mark = _located(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def input_digest(spark: SparkSession, paths: list[str], parameters: str = "") -> str:
    """A name for a run over these input files: names, sizes, times and parameters.

    The files are listed, not read; one row per path reaches the driver.
    """
    digest = hashlib.sha256(parameters.encode())
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        row = files.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("length").alias("length"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mark"),
        ).first()
        digest.update(f"|{path}|{row['n']}|{row['length']}|{row['mark']}".encode())
    return digest.hexdigest()[:32]


@contextmanager
def run_scope(spark: SparkSession, folder: str) -> Iterator[str]:
    """Keep the tables of a run in ``folder`` while the run lasts.

    ``folder`` belongs to this run alone and is shared by all executors.  A
    table that an earlier attempt finished is read again instead of computed,
    so the steps and inputs of both attempts must be the same; put
    `input_digest` into the name of the folder.  Results must be written
    elsewhere before the scope ends: then the folder is deleted.  After an
    error it stays for the next attempt.
    """
    root = folder.rstrip("/")
    token = _RUN.set(_Run(root))
    try:
        yield root
    finally:
        _RUN.reset(token)
    files, place = _located(spark, root)
    files.delete(place, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; else these lie until the driver collects garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    What was shuffled for it is removed at once: the table takes its place.
    """
    spark, run = df.sparkSession, _RUN.get()
    path = run.path(name) if run else fresh_path(spark, name)
    with swept(spark):
        if run is None:
            df.write.parquet(path)
        elif not is_complete(spark, path):
            df.write.mode("overwrite").parquet(path)  # over what a lost attempt left
    return spark.read.schema(df.schema).parquet(path)
