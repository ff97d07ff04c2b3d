"""Price files, table and report sinks, and saved encoder artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventide.sources import schemas


MAX_LAYOUTS = 200


def _layouts(spark: SparkSession, path: str, ticker_column: str | None) -> tuple[DataFrame, list[str]]:
    """The header line of each file, and the distinct header lines; raises if a file lacks a column."""
    wanted = sorted(schemas.REQUIRED_PRICE_COLUMNS)
    is_header = F.col("value").rlike(rf'(^|,)\s*"?({"|".join(wanted)})"?\s*(,|$)')
    heads = (spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), "value")
             .groupBy("_file").agg(F.max(F.when(is_header, F.col("value"))).alias("_header")))
    found = heads.groupBy("_header").agg(F.min("_file").alias("example")).limit(MAX_LAYOUTS + 1).collect()
    if len(found) > MAX_LAYOUTS:
        raise ValueError(f"{path} holds more than {MAX_LAYOUTS} column layouts")
    for row in found:
        missing = sorted(set(wanted) - set(_names(row._header or "")))
        if missing:
            raise ValueError(f"{row.example} lacks required columns: {missing}")
    return heads, [row._header for row in found]


def _names(header: str) -> list[str]:
    return [c.strip().strip('"') for c in header.split(",")]


def read_prices_csv(spark: SparkSession, path: str, start: str | None = None,
                    end: str | None = None, ticker_column: str | None = None) -> DataFrame:
    """Daily prices of many CSV files, columns taken by each file's own header.

    The ticker is the upper-cased file name, or a partition column if named. Files are
    read once per distinct header; one that lacks a required column raises first.
    """
    heads, headers = _layouts(spark, path, ticker_column)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv.*$", "")
    parts = []
    for header in headers:
        schema = schemas.T.StructType([
            schemas.PRICE_CSV[c] if c in schemas.PRICE_CSV.names else schemas.T.StructField(c, schemas.T.StringType())
            for c in _names(header) if c != ticker_column])
        if ticker_column:
            schema = schema.add(ticker_column, schemas.T.StringType())
        rows = spark.read.option("header", True).schema(schema).csv(path)
        ticker = F.col(ticker_column) if ticker_column else name
        rows = rows.select(*schemas.REQUIRED_PRICE_COLUMNS, F.upper(ticker).alias("ticker_at_date"),
                           F.col("_metadata.file_path").alias("_file"))
        if len(headers) > 1:
            rows = rows.join(heads.where(F.col("_header") == header).select("_file"), "_file", "left_semi")
        parts.append(rows.drop("_file"))
    out = stack(parts)
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def with_entity(prices: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach the entity of each ticker; unknown tickers keep a null entity."""
    return prices.join(companies.select(F.col("ticker").alias("ticker_at_date"),
                                        "internal_company_id"), "ticker_at_date", "left")


def stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, columns).select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                cluster_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table, rows sorted inside files so later scans can skip."""
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and return its row count, observed during the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def write_report_csv(summary: DataFrame, path: str) -> None:
    """One-row-per-portfolio metrics; a report-sized table, hence a single file."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_run(row: DataFrame, path: str) -> None:
    """Add a run to the registry table."""
    row.write.mode("append").parquet(path)


def save_encoder(encoder: dict[str, DataFrame], path: str) -> None:
    for name, df in encoder.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_encoder(spark: SparkSession, path: str, derived: bool = True) -> dict[str, DataFrame]:
    names = ["feature_map", "scaler"] + (["derived_scaler"] if derived else [])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def refresh_cohort(spark: SparkSession, scores: DataFrame, path: str, force: bool = False,
                   ) -> tuple[DataFrame, bool]:
    """Stored scores of the newest quarter; rewritten when the scores it came from have changed.

    A sign of the source's content (row count and a sum of row hashes) is stored with
    each version. Returns the stored table and whether it was rewritten. Each version
    goes to a folder named by quarter and sign, so readers of the old one are
    undisturbed and a read error is never mistaken for a missing version.
    """
    from eventide.operators.diagnostics import latest_cohort
    latest = latest_cohort(scores)
    quarter = F.date_format(F.date_trunc("quarter", F.max("entry_date")), "yyyy-MM-dd")
    row = scores.agg(quarter.alias("quarter")).first()
    sign = latest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(
        F.sum(F.xxhash64(*sorted(latest.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    version = spark.createDataFrame([(row.quarter, f"{sign.n}-{sign.h}")], "quarter string, sign string")
    target = f"{path}/quarter={row.quarter}/sign={sign.n}_{sign.h}"
    held = None if force else _versions(spark, path)
    if held is not None and not held.join(version, ["quarter", "sign"], "left_semi").isEmpty():
        return spark.read.parquet(target), False
    latest.write.mode("overwrite").parquet(target)
    version.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return spark.read.parquet(target), True


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The versions written below ``path``; None only where there is no such table yet."""
    try:
        return spark.read.schema("quarter string, sign string").parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def positional_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def manifest(counts: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in counts.items()]
    return stack(parts)
