"""Parquet datasets: scans with pruning and pushdown, partitioned writes, manifests, compaction, projections.

Everything goes through Spark's readers and writers, so any file system it knows will do.  Layout:
exchange=/symbol=/timeframe=/year=/month=/day=.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.schemas import enforce

LAYOUT = ("exchange", "symbol", "timeframe", "year", "month", "day")
_OPS = {"==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "in": lambda c, v: c.isin(list(v))}


def predicate(filters: list[tuple]) -> Column:
    """All of any number of (field, operator, value)."""
    return reduce(lambda a, b: a & b, [_OPS[op](F.col(f), v) for f, op, v in filters], F.lit(True))


def day_range(start: dt.datetime, end: dt.datetime) -> Column:
    """Partition predicate on year, month and day that covers a range; the reader prunes folders by it."""
    key = F.col("year").cast("int") * 10000 + F.col("month").cast("int") * 100 + F.col("day").cast("int")
    a, b = (x.year * 10000 + x.month * 100 + x.day for x in (start, end))
    years = F.col("year").between(start.year, end.year)
    same_month = (F.col("month") == start.month) if (start.year, start.month) == (end.year, end.month) else F.lit(True)
    return years & same_month & key.between(a, b)


def scan(spark: SparkSession, base: str, columns: list[str] | None = None, filters: list[tuple] = (), start: dt.datetime | None = None, end: dt.datetime | None = None, most: int | None = None) -> DataFrame:
    """Filtered and projected scan; hidden and temporary files are skipped by the reader; damaged ones on request of the session."""
    df = spark.read.parquet(base).where(predicate(list(filters)))
    if start and end:
        ms = lambda x: int(x.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        if {"year", "month", "day"} <= set(df.columns):
            df = df.where(day_range(start, end))
        df = df.where(F.col("timestamp").between(ms(start), ms(end)))
    df = df.select(*columns) if columns else df
    return df.limit(most) if most else df


def scan_symbol(spark: SparkSession, base: str, exchange: str, symbol: str, timeframe: str | None = None, **kw) -> DataFrame:
    """The scan of one exchange, symbol and timeframe, whose folders alone are read."""
    wanted = [("exchange", "==", exchange), ("symbol", "==", symbol), *([("timeframe", "==", timeframe)] if timeframe else [])]
    return scan(spark, base, filters=wanted, **kw)


def transformed(df: DataFrame, transform, schema: str) -> DataFrame:
    """A hook on a scan: a function from one Arrow table to another, batch by batch."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield from transform(pa.Table.from_batches([b])).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def checked(schema: str, strict: bool = True):
    """A decorator for functions that return a DataFrame: columns and types must be as stated (or are cast, if not strict)."""
    from functools import wraps

    from pyspark.sql.types import StructType

    def wrap(f):
        @wraps(f)
        def run(*a, **kw):
            df, want = f(*a, **kw), StructType.fromDDL(schema)
            have = {x.name: x.dataType for x in df.schema.fields}
            if lacking := [x.name for x in want.fields if x.name not in have]:
                raise TypeError(f"{f.__name__} lacks {', '.join(lacking)}")
            if strict and (odd := [x.name for x in want.fields if have[x.name] != x.dataType]):
                raise TypeError(f"{f.__name__} has other types of {', '.join(odd)}")
            return df.select(*[F.col(x.name).try_cast(x.dataType).alias(x.name) for x in want.fields])

        return run

    return wrap


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Skips files that can't be read."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)


def repair(spark: SparkSession, path: str, out: str, keys: list[str]) -> DataFrame:
    """Rewrites what can be read of a dataset, without rows that lack a key and repeated rows, and reads it back."""
    df = read_lenient(spark, path).na.drop(subset=keys).dropDuplicates()
    df.write.mode("overwrite").parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def validate_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Per file: rows, bytes, and of the wanted columns how many values are missing."""
    df = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(path)
    lacking = [F.lit(None).alias(c) for c in columns if c not in df.columns]
    x = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), *[F.col(c) for c in columns if c in df.columns], *lacking)
    return x.groupBy("file").agg(F.count("*").alias("rows"), F.first("bytes").alias("bytes"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_missing") for c in columns])


def first_available(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first path that can be read."""
    error: Exception | None = None
    for p in paths:
        try:
            return spark.read.parquet(p)
        except Exception as e:  # noqa: BLE001 - Spark raises several kinds for a missing or empty path
            error = e
    raise error or FileNotFoundError("no paths")


def partitions(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """Distinct partition values with files and rows (from metadata, one pass over no column)."""
    return spark.read.parquet(base).select(*keys, F.col("_metadata.file_path").alias("_p")).groupBy(*keys).agg(F.count_distinct("_p").alias("files"), F.count("*").alias("rows"))


def size_estimate(spark: SparkSession, base: str) -> DataFrame:
    """Rows, files and bytes of a dataset."""
    df = spark.read.parquet(base)
    return df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p").agg(F.count("*").alias("n"), F.first("s").alias("s")).agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("s").alias("bytes"))


def write_partitioned(df: DataFrame, base: str, by: list[str], schema: str | None = None, records: int = 1_000_000, mode: str = "overwrite") -> None:
    """Partitioned by columns, one file per partition and task; only the partitions at hand are replaced."""
    df = enforce(df, schema) if schema else df
    (df.repartition(*[F.col(c) for c in by]).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", records).option("compression", "snappy").partitionBy(*by).parquet(base))


def write_daily(df: DataFrame, base: str, layout: tuple[str, ...] = LAYOUT) -> None:
    """One folder per day."""
    from tidewell.operators.clean import add_date_parts

    write_partitioned(add_date_parts(df), base, [c for c in layout if c in (*df.columns, "year", "month", "day")])


def write_flat(df: DataFrame, path: str, files: int = 1) -> None:
    df.coalesce(files).write.mode("overwrite").option("compression", "snappy").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, base: str) -> dict:
    """File count, rows, first and latest timestamp over all files; written as JSON beside the data, hidden from scans."""
    x = spark.read.parquet(base)
    r = x.select(F.col("_metadata.file_path").alias("_p"), "timestamp").agg(F.count_distinct("_p").alias("files"), F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("latest")).first()
    out = {"file_count": r.files, "rows": r.rows, "first_timestamp": r.first, "latest_timestamp": r.latest}
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_manifest")
    return out


def read_manifest(spark: SparkSession, base: str) -> dict:
    return json.loads(spark.read.text(f"{base}/_manifest/part-*").first()[0])


def compact(spark: SparkSession, base: str, by: list[str], out: str | None = None) -> str:
    """Rewrites a dataset with one file per partition to ``<base>_compacted``."""
    out = out or f"{base.rstrip('/')}_compacted"
    write_partitioned(spark.read.parquet(base), out, by)
    return out


def migrate_flat(spark: SparkSession, flat: str, base: str, **constants: str) -> None:
    """Flat files to the partitioned layout with constant columns."""
    df = spark.read.option("mergeSchema", "true").parquet(flat)
    write_daily(df.withColumns({k: F.lit(v) for k, v in constants.items()}), base)


def materialise(spark: SparkSession, base: str, out: str, columns: list[str], filters: list[tuple] = ()) -> DataFrame:
    """Writes a projection; an empty one is an error."""
    df = scan(spark, base, columns, filters)
    df.write.mode("overwrite").parquet(out)
    got = spark.read.schema(df.schema).parquet(out)
    if got.isEmpty():
        raise ValueError("the projection is empty")
    return got


def projection_key(base: str, columns: list[str], filters: list[tuple]) -> str:
    return hashlib.md5(json.dumps([base, columns, [list(map(str, f)) for f in filters]]).encode()).hexdigest()


def cached_projection(spark: SparkSession, base: str, cache: str, columns: list[str], filters: list[tuple] = (), ttl: float = 0.0) -> DataFrame:
    """A projection kept for ``ttl`` seconds under a key of its query."""
    path = f"{cache}/{projection_key(base, columns, list(filters))}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(conf)
    if ttl > 0 and fs.exists(p):
        age = dt.datetime.now(dt.timezone.utc).timestamp() - fs.getFileStatus(p).getModificationTime() / 1000
        if age <= ttl:
            return spark.read.parquet(path)
    return materialise(spark, base, path, columns, filters)


def missing_dates(have: DataFrame, want: DataFrame) -> DataFrame:
    """Days of ``want`` (column day) that ``have`` doesn't hold."""
    return want.select("day").distinct().join(have.select("day").distinct(), "day", "left_anti")


def date_window(df: DataFrame, today: dt.date, lookback: int, exclude: int = 0, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Rows of files whose name's date lies in the window that ends ``exclude`` days ago; undated files stay."""
    name = F.regexp_extract(F.input_file_name(), pattern, 1)
    d = F.try_to_timestamp(F.col("_d")).cast("date")
    last = today - dt.timedelta(days=exclude)
    x = df.withColumn("_d", name).withColumn("_dd", d)
    return x.where((F.col("_d") == "") | F.col("_dd").between(last - dt.timedelta(days=lookback), last)).drop("_d", "_dd")


def read_csv(spark: SparkSession, path: str, schema: str, checks: dict[str, str] | None = None, key: str = "timestamp") -> DataFrame:
    """CSV by an explicit schema: malformed rows and missing keys go, the first row of a key stays, failing checks raise.

    checks: name to SQL condition that every row must meet.
    """
    from tidewell.operators.clean import keep_one

    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt_record string").csv(path)
    df = df.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    df = keep_one(df.withColumn("_at", F.monotonically_increasing_id()), [key], ["_at"], last=False).drop("_at")
    if checks:
        bad = df.agg(*[F.coalesce(F.sum(F.coalesce((~F.expr(c)).cast("int"), F.lit(1))), F.lit(0)).alias(n) for n, c in checks.items()]).first().asDict()
        if failed := [n for n, v in bad.items() if v]:
            raise ValueError(f"rows fail: {', '.join(failed)}")
    return df


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON as it is; CSV with structs flattened."""
    if kind == "csv":
        flat = [F.col(f"{c}.{f}").alias(f"{c}_{f}") if t.startswith("struct") else F.col(c) for c, t in df.dtypes for f in ([x.name for x in df.schema[c].dataType] if t.startswith("struct") else [None])]
        df.select(*flat).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: of each key the new row if there is one, else the old."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def pivot_fields(df: DataFrame, row_key: str, column_key: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide by a known list of names; mean of repeated values."""
    return df.groupBy(row_key).pivot(column_key, names).agg(F.avg(value))


def segment(df: DataFrame, days: int = 30, ts: str = "ts") -> DataFrame:
    """Number of the time segment a row lies in, from the first day on."""
    first = df.agg(F.min(F.to_date(ts)).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn("segment", F.floor(F.datediff(F.to_date(ts), "_first") / days).cast("int")).drop("_first")  # one row
