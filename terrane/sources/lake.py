"""Tables in and out: the lake, dumps, forecast documents, trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lake(df: DataFrame, path: str, partitions: tuple[str, ...] = ("market", "year")) -> None:
    """Rewrite only the partitions that ``df`` holds; writing the same rows again changes nothing."""
    spread = df.repartition(*partitions, F.pmod(F.xxhash64("security_id"), F.lit(16))).sortWithinPartitions(*partitions, "security_id", "session")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_lake(spark: SparkSession, path: str, markets: list[str], first: int, last: int) -> DataFrame:
    """The lake's rows of some markets and years; the other partitions are not read."""
    return spark.read.parquet(path).where(F.col("market").isin(markets) & F.col("year").between(first, last))


def dump(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """One folder for each table."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/{name}") if kind == "csv" else writer.format(kind).save(f"{path}/{name}")


def forecast_documents(run: DataFrame, zones: DataFrame) -> DataFrame:
    """security_id, as_of, document: one JSON text a forecast, zones nearest first. A forecast has few zones."""
    z = F.struct(F.abs("distance_atr").alias("d"), "zone_id", "side", "lower", "upper", "center", "p_touch")
    grouped = zones.groupBy("security_id", "as_of").agg(F.array_sort(F.collect_list(z)).alias("zones"))
    items = F.transform("zones", lambda x: F.struct(x["zone_id"].alias("zone_id"), x["side"].alias("side"), x["lower"].alias("lower"), x["upper"].alias("upper"), x["center"].alias("center"), x["p_touch"].alias("p_touch")))
    both = run.select("security_id", "as_of", "spot", "atr").join(grouped, ["security_id", "as_of"], "left")
    return both.select("security_id", "as_of", F.to_json(F.struct("security_id", F.col("as_of").cast("string").alias("as_of"), "spot", F.col("atr").alias("atr20"), items.alias("zones"))).alias("document"))


def flattened(documents: DataFrame) -> DataFrame:
    schema = "security_id long, as_of string, spot double, atr20 double, zones array<struct<zone_id:string,side:string,lower:double,upper:double,center:double,p_touch:double>>"
    parsed = documents.select(F.from_json("document", schema).alias("d"))
    return parsed.select("d.security_id", F.col("d.as_of").cast("date").alias("as_of"), "d.spot", F.explode("d.zones").alias("z")).select("security_id", "as_of", "spot", "z.*")


TRIALS = "trial string, at timestamp, sharpe double, params string"


def append_trials(df: DataFrame, path: str) -> None:
    df.select("trial", "at", "sharpe", "params").write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIALS).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """A SQL table, read in ranges of ``column`` (a number, date or timestamp, as are the bounds); single-precision columns become double."""
    bounds = {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": str(partitions)}
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()
    return df.select(*(F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))


def pull_jdbc(spark: SparkSession, url: str, table: str, column: str, partitions: int, after: str | None = None, **options: str) -> DataFrame | None:
    """The rows of a SQL table whose ``column`` (a number, date or timestamp) is above ``after`` (a SQL literal; all rows without it), read in ``partitions`` ranges between the bounds that the
    database itself reports for them; null keys come with the first range. A pull is resumed with the largest key of the one before, and asks the database for new keys alone.
    None if there are none."""
    source = table if after is None else f"(SELECT * FROM {table} WHERE {column} > {after}) new_rows"
    bounds = spark.read.jdbc(url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source.replace(' new_rows', ' old_rows')}) bounds", properties=options).first()
    low, high = bounds[0], bounds[1]
    if low is None:
        return None if after is not None else read_whole(spark, url, table, options)
    if low == high:
        return read_whole(spark, url, source, options)
    return read_jdbc(spark, url, source, column, str(low), str(high), partitions, **options)


def read_whole(spark: SparkSession, url: str, source: str, options: dict[str, str]) -> DataFrame | None:
    """A SQL table in one range: its keys are all the same or null. None if it is empty."""
    df = spark.read.jdbc(url, source, properties=options)
    df = df.select(*(F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))
    return df if df.limit(1).count() else None
