"""Session helpers shared by every module."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows that ``settle`` takes: some thousand draws for each of some hundred components.
SETTLE_ROWS = 2_000_000


def get_session(app: str = "panelwave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: the one the cluster names in
    ``spark.checkpoint.dir``.  Where that setting is absent, a single-machine session
    gets a temporary folder and any other one an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="panelwave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """File system and path of a folder, as the session's Hadoop configuration sees it.  A Spark
    Connect session has neither; what needs them says so by failing here."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@dataclass
class Scope:
    """Persisted tables and scratch folders that were made while the scope was open."""

    spark: SparkSession
    tables: list[DataFrame] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def release(self) -> None:
        for df in self.tables:
            df.unpersist()
        for folder in self.folders:
            fs, where = hadoop_path(self.spark, folder)
            fs.delete(where, True)
        self.tables, self.folders = [], []


_OPEN: ContextVar[Scope | None] = ContextVar("panelwave_scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Release at the end what operators persisted or wrote as scratch inside the block.

    Results are lazy, so whoever opens a scope reads or writes them inside it.  Scopes nest: an
    inner one owns what is made inside it.  Without a scope tables stay until the session
    ends, as callers may still need them.
    """
    mine = Scope(spark)
    token = _OPEN.set(mine)
    try:
        yield mine
    finally:
        _OPEN.reset(token)
        mine.release()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    folder = f"{shared_dir(spark).rstrip('/')}/panelwave-{uuid.uuid4().hex}"
    if (owner := _OPEN.get()) is not None:
        owner.folders.append(folder)
    return f"{folder}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once whose size parameters bound: cells, weights, draws, cohorts.

    It becomes a local relation in one partition: the optimiser knows its true size, later
    plans carry none of its lineage, and work among such tables needs no exchange.  Tables that
    grow with the data are for ``persisted``: more than ``SETTLE_ROWS`` rows are an error, and
    ``spark.driver.maxResultSize`` stops what would not fit the driver.
    """
    arrow = df.toArrow()
    if arrow.num_rows > SETTLE_ROWS:
        raise ValueError(f"more than {SETTLE_ROWS} rows to settle; parameters do not bound this table")
    return df.sparkSession.createDataFrame(arrow, schema=df.schema).coalesce(1)


def persisted(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it distributed; it spills to disk, and a lost block is
    computed again from its inputs.  An open ``scope`` releases it."""
    if (owner := _OPEN.get()) is not None:
        owner.tables.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of driver-side values (parameters, cell lists).

    It goes through Arrow, which makes it a local relation of known size; a table made
    from Python rows has no size estimate and would never be broadcast by itself.
    """
    target = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)
    columns = list(zip(*rows)) if rows else [()] * len(target)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=target).coalesce(1)
