"""Typed readers and partitioned writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from panelwave.operators.frames import stack
from panelwave.session import hadoop_path, settle


def _misfit(c: str, kind: str) -> Column:
    """Whether text stands in a column that its type does not take."""
    return F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()


def observe_misfits(df: DataFrame, schema: Mapping[str, str], account: Observation) -> DataFrame:
    """The same rows, counted on their way: after an action ``account.get`` has ``n_rows`` and, for
    each column of ``schema``, ``rejected_<column>``, the number of rows whose text does not fit."""
    counters = [F.count_if(_misfit(c, kind)).alias(f"rejected_{c}") for c, kind in schema.items()]
    return df.observe(account, F.count(F.lit(1)).alias("n_rows"), *counters)


def rejected_rows(df: DataFrame, schema: Mapping[str, str], out: str = "rejected") -> DataFrame:
    """Rows with text that does not fit its declared type, as read, and the names of these
    columns in ``out``."""
    names = F.array_compact(F.array(*[F.when(_misfit(c, kind), F.lit(c)) for c, kind in schema.items()]))
    return df.withColumn(out, names).filter(F.size(out) > 0)


def read_typed(
    spark: SparkSession, path: str, schema: T.StructType | str, rename: Mapping[str, str] | None = None,
    mode: str = "PERMISSIVE", account: Observation | None = None,
) -> DataFrame:
    """UTF-8 CSV with a header and a declared schema; ``rename`` maps source to target
    names and selects exactly those columns.

    Columns are found by the names in the header of ``path``, in whatever order they stand;
    a declared column that the header lacks is an error.  Text that does not fit its
    type becomes NULL, or stops the job with ``mode="FAILFAST"``.  With an ``account`` the text is
    read as it is, the misfits are counted by column in the same pass (``observe_misfits``, by
    the names of the file) and the columns are cast as ``cast_declared`` does.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.csv(path, header=True).columns
    if missing := [f.name for f in declared if f.name not in header]:
        raise ValueError(f"{path} has no columns {missing}; its header is {header}")
    types = {f.name: f.dataType for f in declared} if account is None else {}
    ordered = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = spark.read.csv(path, header=True, schema=ordered, enforceSchema=False, mode=mode)
    df = df.select(*[f"`{f.name}`" for f in declared])
    if account is not None:
        df = cast_declared(df, {f.name: f.dataType.simpleString() for f in declared}, account)
    if not rename:
        return df
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in rename.items()])


def read_legacy(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    key_pattern: str = r"^\d{6} ",
    sep: str = ";",
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """Old statistics export: preamble lines, a header, data lines, a total line and
    notes in one text.  Data lines are known by their key, so the other lines are
    dropped wherever they stand, and the file can be split between tasks.  Rows with
    a missing field are dropped as well.  All fields stay text; see ``cast_declared``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(
        path,
        schema=schema,
        sep=sep,
        encoding=encoding,
        header=False,
        mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    return df.filter(F.col(f"`{columns[0]}`").rlike(key_pattern)).dropna("any")


def cast_declared(df: DataFrame, schema: Mapping[str, str], account: Observation | None = None) -> DataFrame:
    """Cast the named columns; text that does not fit becomes NULL, counted by ``account`` if
    one is given (see ``observe_misfits``)."""
    if account is not None:
        df = observe_misfits(df, schema, account)
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in schema.items()})


def read_extract(
    spark: SparkSession,
    path: str,
    cols: Mapping[str, tuple[str, str]],
    fmt: str = "parquet",
    account: Observation | None = None,
) -> DataFrame:
    """A few columns of an exported sheet: ``cols`` maps target name to
    (source name, type).  Only those columns are read.  ``account`` counts misfits by source name."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if account is not None:
        df = observe_misfits(df, dict(cols.values()), account)
    return df.select(*[F.col(f"`{src}`").try_cast(t).alias(new) for new, (src, t) in cols.items()])


def union_yearly(
    spark: SparkSession,
    paths: Mapping[int, str],
    canonical: Sequence[str],
    fmt: str = "csv",
    year_col: str = "year",
) -> DataFrame:
    """Stack yearly files whose headers differ while their column order is the same.

    The names in ``canonical`` are imposed by position and the year is added.  Files
    are headered CSV (all text) or Parquet.
    """
    frames = []
    for year, path in paths.items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True)
        df = reader.load(path)
        if len(df.columns) != len(canonical):
            raise ValueError(f"{path} has {len(df.columns)} columns, expected {len(canonical)}")
        frames.append(df.toDF(*canonical).withColumn(year_col, F.lit(year)))
    return stack(*frames)


def write_panel(
    df: DataFrame, path: str, partition: str | None = "year", fmt: str = "parquet", file_rows: int = 1_000_000
) -> None:
    """Write a table in folders by ``partition``, so that a year filter prunes files.

    Rows are counted per year first, which reads that column alone, and each year gets one
    salt per ``file_rows`` rows.  Rows are then dealt by year and salt: a year that holds a third of the
    table is written by many tasks, a small one by a single task, and no year has more
    files than its rows ask for, however many tasks the job had.  The salt is a hash of the row, so
    a lost task deals its rows the same way again; rows that are equal in all columns share
    one, and beyond ``file_rows`` of them their task starts further files.
    """
    if partition:
        year = F.col(f"`{partition}`")
        counts = df.groupBy(year.alias("__year")).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("__salts"))
        files = counts.agg(F.sum("__salts")).first()[0] or 1
        counts = settle(counts.filter("__salts > 1"))  # no more rows than files
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce("__salts", F.lit(1)))
        dealt = df.join(counts, year.eqNullSafe(F.col("__year")), "left").withColumn("__salt", salt)
        dealt = dealt.repartition(min(int(files), 10_000), year, F.col("__salt"))
        df = dealt.select(*[f"`{c}`" for c in df.columns])
    writer = df.write.mode("overwrite").format(fmt).option("maxRecordsPerFile", file_rows)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


_FINGERPRINT = "_fingerprint"


def _is_complete(spark: SparkSession, path: str) -> bool:
    fs, marker = hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def _read_fingerprint(spark: SparkSession, path: str) -> dict[str, object] | None:
    fs, where = hadoop_path(spark, f"{path}/{_FINGERPRINT}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, staging: str, path: str) -> None:
    """Give a finished staging folder its name, unless a finished table has it already."""
    fs, source = hadoop_path(spark, staging)
    _, target = hadoop_path(spark, path)
    if fs.exists(target) and not _is_complete(spark, path):
        fs.delete(target, True)
    if _is_complete(spark, path) or not fs.rename(source, target):
        fs.delete(source, True)  # another writer was faster; its table stays
    fs.delete(hadoop_path(spark, f"{path}/{staging.rsplit('/', 1)[-1]}")[1], True)  # renamed into a table just published
    if not _is_complete(spark, path):
        raise OSError(f"{path} could not be published")


def materialize_once(
    spark: SparkSession,
    path: str,
    builder: Callable[[], DataFrame],
    partition: str | None = None,
    params: Mapping[str, object] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read ``path`` if a finished table stands there, otherwise build and publish it.

    The table is written to a sibling folder of its own and renamed when it is finished.  So
    ``path`` never holds a half-written table of this function, two writers do not mix their
    files, and the one that comes second finds the first one's table and uses it.  What an
    older job left there without a ``_SUCCESS`` marker is replaced.

    A fingerprint of the table's schema and of ``params`` (plain values) is kept with it.  A
    finished table is used only if its fingerprint has the ``params`` and the ``schema`` that
    the caller states; a different one is an error that names both.
    """
    wanted = {"params": None if params is None else dict(params), "schema": None}
    if schema is not None:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        wanted["schema"] = _names_and_types(declared)
    if not _is_complete(spark, path):
        df = builder()
        built = {"params": wanted["params"], "schema": _names_and_types(df.schema)}
        if wanted["schema"] not in (None, built["schema"]):
            raise ValueError(f"the builder gives {built['schema']}, declared is {wanted['schema']}")
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        write_panel(df, staging, partition)
        fs, note = hadoop_path(spark, f"{staging}/{_FINGERPRINT}")
        stream = fs.create(note)
        stream.write(bytearray(json.dumps(built, sort_keys=True, default=str), "utf-8"))
        stream.close()
        _publish(spark, staging, path.rstrip("/"))
    found = _read_fingerprint(spark, path) or {}
    for key, value in json.loads(json.dumps(wanted, default=str)).items():
        if value is not None and found.get(key) != value:
            raise ValueError(f"{path} was made with {key} {found.get(key)}, not {value}")
    return spark.read.parquet(path)


def _names_and_types(schema: T.StructType) -> dict[str, str]:
    """Columns by name; a partition column moves to the end of a stored table."""
    return {f.name: f.dataType.simpleString() for f in schema}
