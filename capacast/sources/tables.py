"""Table access: batch and stream scans, overwrite, append, guarded append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType,
    TimestampNTZType,
)
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException

from ..operators.joins import new_rows_only
from ..operators.rows import conform
from ..session import materialise


def load(spark: SparkSession, name: str, folder: str | None = None,
         schema: StructType | str | None = None) -> DataFrame:
    """A catalog table, or ``<folder>/<name>.parquet`` when a folder is given.

    Give the schema when it is known: inferring it reads file footers first.
    """
    if folder is None:
        return spark.table(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, path: str, schema: StructType | str,
           files_per_batch: int | None = None) -> DataFrame:
    """Incremental scan of the Parquet files below ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


WIDER = [
    (ByteType(), ShortType()), (ShortType(), IntegerType()), (IntegerType(), LongType()), (IntegerType(), DoubleType()),
    (FloatType(), DoubleType()), (DateType(), TimestampNTZType()),
]


def widened(one: DataType, other: DataType) -> DataType:
    """The narrowest type that holds all values of both and that the Parquet reader gives for either."""
    def reach(kind: DataType) -> list[DataType]:
        found = [kind]
        for narrow in found:
            found += [wide for low, wide in WIDER if low == narrow and wide not in found]
        return found

    held = reach(other)
    for kind in reach(one):
        if kind in held:
            return kind
    if {one, other} <= {ByteType(), ShortType(), IntegerType(), FloatType(), DoubleType()}:
        return DoubleType()
    raise TypeError(f"no type holds both {one.simpleString()} and {other.simpleString()} without loss")


def _agreeing(spark: SparkSession, path: str, *files: str) -> DataFrame | None:
    """The files (all below the path by default) as one table, or None if a column has differing types in them."""
    try:
        return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*(files or (path,)))
    except (PySparkException, Py4JJavaError) as problem:  # the latter if tasks have found it
        if "CANNOT_MERGE" not in str(problem):
            raise
        return None


def _schemas(spark: SparkSession, path: str, files: list[str]) -> list[StructType]:
    """Schemas of groups of files that agree; a group that does not is halved."""
    found = _agreeing(spark, path, *files)
    if found is not None:
        return [found.schema]
    middle = len(files) // 2
    return _schemas(spark, path, files[:middle]) + _schemas(spark, path, files[middle:])


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Read files written with different column sets and types as one table; a column has the widest of its types.

    Columns missing in a file read null.  Spark merges what agrees.  Otherwise files are taken in order of their age, in
    which types change seldom, and halved until a group agrees: about log(files) inferences for each change of type.  The
    files are then read in one scan, as the Parquet reader widens values itself.  Types without a common wider one, such as
    bigint and double, fail.
    """
    alike = _agreeing(spark, path)
    if alike is not None:
        return alike
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path).select("path", "modificationTime").collect()
    files = [r.path for r in sorted(listed, key=lambda r: (r.modificationTime, r.path))]
    kinds: dict[str, DataType] = {}
    for schema in _schemas(spark, path, files):
        for field in schema:
            kinds[field.name] = widened(kinds.get(field.name, field.dataType), field.dataType)
    return spark.read.schema(StructType([StructField(name, kind) for name, kind in kinds.items()])).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_history(df: DataFrame, path: str, time: str, keys: Sequence[str], replace_days: bool = False) -> None:
    """Write partitioned by day and sorted by key and time, for pruned time-range scans.

    Rows are appended, or with ``replace_days`` take the place of all rows of their days; other days stay as they are.
    Adaptive execution cuts a busy day into as many tasks as its size asks for, and puts quiet days together.
    """
    (
        df.withColumn("day", F.to_date(time))
        .hint("rebalance", "day")
        .sortWithinPartitions("day", *keys, time)
        .write.mode("overwrite" if replace_days else "append").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )


def replace_days(df: DataFrame, path: str) -> None:
    """Put rows, which bear their day, in the place of all rows of these days."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_history`` has written from rows of that schema, with their day; no rows if there is nothing yet."""
    dated = StructType([*schema.fields, StructField("day", DateType())])
    if not exists(spark, path):
        return spark.createDataFrame([], dated)
    return spark.read.schema(dated).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table of files at the path, on any file system that Spark reads."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _version(spark: SparkSession, path: str) -> int:
    if not exists(spark, f"{path}/versions"):
        return 0
    return spark.read.schema("version int").parquet(f"{path}/versions").agg(F.max("version")).first()[0] or 0


def current_version(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``add_version`` has written last; none at first."""
    number = _version(spark, path)
    if not number:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{number}")


def add_version(df: DataFrame, path: str) -> None:
    """Write a table anew beside its former version, which ``df`` may read, and then make it the current one.

    What a broken attempt has left is replaced, as only a version that is listed counts.
    """
    number = _version(df.sparkSession, path) + 1
    overwrite(df, f"{path}/v{number}")
    append(df.sparkSession.createDataFrame([(number,)], "version int"), f"{path}/versions")


def files_by_day(spark: SparkSession, path: str) -> DataFrame:
    """(file, day) of a table partitioned by day, from its listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path)
    day = F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1)
    return files.select(F.col("path").alias("file"), F.to_date(F.nullif(day, F.lit(""))).alias("day"))


def create_if_missing(spark: SparkSession, table: str, schema: StructType) -> None:
    """Create an empty Parquet table with declared columns unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def insert(df: DataFrame, table: str, overwrite_all: bool = False) -> None:
    """Append to (or replace) a declared table; columns are matched by name, then cast."""
    target = df.sparkSession.table(table).schema
    conform(df, target).write.insertInto(table, overwrite=overwrite_all)


def append_new(rows: DataFrame, path: str, keys: Sequence[str], among: Column | None = None) -> None:
    """Append the rows whose keys the target lacks, so a rerun adds nothing.

    Only the key columns of the target are scanned.  ``among`` narrows the
    target rows that count as existing, such as those still running.
    """
    try:
        existing = rows.sparkSession.read.parquet(path)
        existing = (existing if among is None else existing.where(among)).select(*keys)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = rows.select(*keys).limit(0)
    new_rows_only(rows, existing, keys).write.mode("append").parquet(path)


def bucket_column(buckets: int) -> str:
    """The number of buckets is part of the name, so a table cannot be read or written with another one unnoticed."""
    return f"bucket_of_{buckets}"


def append_to_buckets(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> None:
    """``append_new`` for a target that is too large to scan at each append.

    The target is laid out by a hash of the keys.  Equal keys lie in one bucket, so only buckets that hold keys of ``rows``
    are read.  The rows are written once before, as they are asked for their buckets and then appended.
    """
    name, spark = bucket_column(buckets), rows.sparkSession
    placed = materialise(rows.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "placed")
    if exists(spark, path):
        touched = [r[0] for r in placed.select(name).distinct().collect()]  # as many as there are buckets at most
        existing = in_buckets(spark, path, placed.schema, name, touched).select(*keys)
    else:
        existing = placed.select(*keys).limit(0)
    fresh = new_rows_only(placed, existing, keys)
    fresh.hint("rebalance", name).write.mode("append").partitionBy(name).parquet(path)


def in_buckets(spark: SparkSession, path: str, schema: StructType, name: str, touched: Sequence[int]) -> DataFrame:
    """Rows of these buckets; the folders of the others are not listed among the files to read."""
    return spark.read.schema(schema).parquet(path).where(F.col(name).isin(list(touched)))


def insert_new(rows: DataFrame, table: str, keys: Sequence[str]) -> None:
    """``append_new`` for a catalog table."""
    insert(new_rows_only(rows, rows.sparkSession.table(table).select(*keys), keys), table)
