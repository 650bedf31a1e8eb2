"""Files of series: wide CSV with one series a row, and catalogues."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; on a local master without it, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="foresail-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, read again from the shared folder: what was worked out once is not worked out again for each use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_wide(obs: DataFrame, path: str, value: str = "y") -> None:
    """One line a series: id, then its values oldest first; trailing columns stay empty.  Widths come from one maximum."""
    width = obs.agg(F.max("t")).head()[0] or 0
    packs = obs.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("at"))
    # a line is an array of cells: no column, and no aggregate, for each point in time
    cells = F.transform(F.sequence(F.lit(1), F.lit(max(width, 1))), lambda t: F.coalesce(F.try_element_at("at", t.cast("long")).cast("string"), F.lit("")))
    quoted = F.concat(F.lit('"'), F.regexp_replace("series_id", '"', '""'), F.lit('"'))
    lines = packs.select(F.concat_ws(",", quoted, *([F.concat_ws(",", cells)] if width else [])).alias("value"))
    write_lines(lines, ",".join(f"V{i + 1}" for i in range(width + 1)), path)


def write_lines(lines: DataFrame, header: str | None, path: str) -> None:
    """Writes (value) as text; every file begins with the header, if there is one."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": pa.array([header], pa.string())})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": batch.column(0)})

    (lines if header is None else lines.mapInArrow(headed, "value string")).write.text(path)


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `place`, the number of each row in an order, from 1.

    Rows are sorted in range partitions and written; a range begins behind the rows of those before it.
    """
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name)
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = held.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("__part", "n")).alias("__all"))  # one entry a range
    first = F.aggregate(F.filter("__all", lambda x: x["__part"] < F.col("__part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return held.join(F.broadcast(before), F.lit(True)).withColumn("place", first + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__all")


def read_rows(spark: SparkSession, path: str, letters: str = "HDWMQY") -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a headerless CSV of ids and values, a line at a time: bad are the lines whose id begins with none of the letters."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).select(F.trim(F.get(cells, F.lit(0))).alias("series_id"), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))).alias("cells"), "value")
    good = F.col("series_id").rlike(f"^[{letters}]")
    long = lines.where(good).select("series_id", F.posexplode("cells").alias("i", "x"))
    rows = long.select("series_id", (F.col("i") + 1).cast("long").alias("t"), F.expr("try_cast(x as double)").alias("value")).where("value is not null")
    return rows, lines.where(~F.coalesce(good, F.lit(False))).select("value")


def until_blank(values: DataFrame) -> DataFrame:
    """(series_id, t, value) rows before the first t that a series lacks."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("series_id").orderBy("t"))
    return values.withColumn("__k", at).where(F.col("t") == F.col("__k")).drop("__k")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, t, value) of a CSV of numbers only: a series is a line, named by its number in the order of the files."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    cells = F.posexplode(F.split("value", ",")).alias("i", "x")
    rows = placed(lines, ["file", "at"], "lines").select(F.col("place").cast("string").alias("series_id"), cells)
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("t"), F.expr("try_cast(x as double)").alias("value")).where("value is not null")


def read_wide(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(series_id, t, value) of a wide CSV; quotes go, blanks at the end end the series, rows without an id are skipped."""
    raw = spark.read.option("header", header).option("quote", '"').option("escape", '"').csv(path)
    first, *rest = raw.columns
    values = F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in rest])
    rows = raw.where(F.col(first).isNotNull()).select(F.trim(first).alias("series_id"), F.posexplode(values).alias("i", "value"))
    return rows.where(F.col("value").isNotNull()).select("series_id", (F.col("i") + 1).cast("long").alias("t"), "value")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, start_year, start_period, end_year, end_period, freq) of catalogue lines that begin with >."""
    parts = F.split(F.trim(F.col("value")), "\\s+")
    number = lambda i: F.get(parts, F.lit(i)).cast("long")
    return spark.read.text(path).where(F.col("value").startswith(">")).select(
        F.substring(F.get(parts, F.lit(0)), 2, 1000).alias("series_id"), number(1).alias("start_year"), number(2).alias("start_period"), number(3).alias("end_year"), number(4).alias("end_period"), number(5).alias("freq")
    )
