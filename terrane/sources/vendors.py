"""Daily-bar files of three dialects, with header checks, snapshot choice and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Each dialect's header, and which of its columns are date, open, high, low, close, volume.
HEADERS = {
    "stooq": "Date,Open,High,Low,Close,Volume",
    "tiingo": "date,close,high,low,open,volume,adjClose,adjHigh,adjLow,adjOpen,adjVolume,divCash,splitFactor",
    "yahoo": "Date,Open,High,Low,Close,Adj Close,Volume",
}
SUFFIXES = {("stooq", "US"): ".US", ("stooq", "HK"): ".HK", ("tiingo", "US"): "", ("yahoo", "US"): "", ("yahoo", "HK"): ".HK"}


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no, line of text files: the line's place in its own file, from its order within the read."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "[\\r\\ufeff]", "").alias("line"))
    return raw.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("block", "at"))).select("path", "line_no", "line")


def parse(lines: DataFrame, dialect: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejected). Bars: path, session, open, high, low, close, volume, ordinal. A file whose first line is not the dialect's header is
    rejected as a whole; the Yahoo dialect drops rows without close or high."""
    header = HEADERS[dialect]
    head = lines.where("line_no = 1").select("path", (F.trim("line") == header).alias("ok"))
    rejected = head.where(~F.col("ok")).select("path", F.lit(f"not {dialect}").alias("reason"))
    rows = lines.where("line_no > 1 and trim(line) != ''").join(head.where("ok").select("path"), "path", "left_semi")
    at = {name.lower(): i for i, name in enumerate(header.split(","))}
    cells = F.split("line", ",")
    cell = lambda name: F.nullif(F.trim(F.get(cells, F.lit(at[name]))), F.lit(""))
    number = lambda name: cell(name).try_cast("double").alias(name)
    bars = rows.select("path", F.substring(cell("date"), 1, 10).try_cast("date").alias("session"), *(number(c) for c in ("open", "high", "low", "close", "volume")), F.col("line_no").alias("ordinal"))
    bars = bars.where("session is not null")
    return (bars.where("close is not null and high is not null") if dialect == "yahoo" else bars), rejected


def last_of_session(bars: DataFrame, key: str = "path") -> DataFrame:
    """One row for each session: the last of the file."""
    w = Window.partitionBy(key, "session").orderBy(F.desc("ordinal"))
    return bars.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "ordinal")


def pick_snapshots(files: DataFrame, as_of: Column) -> DataFrame:
    """The file of each symbol: the newest fetched by ``as_of``, else the newest at all. ``files`` has path: .../symbol/yyyy-mm-dd.csv; other names are left out."""
    day = F.regexp_extract("path", r"/([0-9]{4}-[0-9]{2}-[0-9]{2})\.csv$", 1)
    found = files.withColumns({"symbol": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), "fetched": F.nullif(day, F.lit("")).try_cast("date")}).where("fetched is not null")
    w = Window.partitionBy("symbol").orderBy(F.desc(F.col("fetched") <= as_of), F.desc("fetched"))
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def symbol(provider: str, ticker: Column, market: Column) -> Column:
    """The provider's name for a ticker; null for a market that it does not serve. Numeric Hong Kong codes are padded to four digits, never cut."""
    code = F.upper(F.trim(ticker))
    code = F.when((market == "HK") & code.rlike("^[0-9]+$") & (F.length(code) < 4), F.lpad(code, 4, "0")).otherwise(code)
    out = F.lit(None).cast("string")
    for (p, m), suffix in SUFFIXES.items():
        if p == provider:
            out = F.when(market == m, F.concat(code, F.lit(suffix))).otherwise(out)
    return out
