"""Leak-free encoding of reported facts: opaque feature ids, period offsets, robust scaling.

The point-in-time join is the costly step. Two validity intervals are computed
on the fact side first, so that the join with samples yields close to the
final rows instead of every (sample, older fact) pair:

* a fact version is current from its acceptance until a better version of the
  same (entity, feature, period) is accepted;
* a period can be among an entity's newest P only until P newer periods are
  visible.

Facts are first reduced to one row per entity, feature, period, form rank and
acceptance date, so a hot entity is bounded by distinct facts, not by raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators.ordered import exact_quantiles

ENTITY = "internal_company_id"
CONCEPT = ["taxonomy", "concept_name", "unit"]
PERIODS_BACK = 8


def visible_facts(facts: DataFrame, train_samples: DataFrame) -> DataFrame:
    """Facts accepted no later than the last training sample."""
    last = train_samples.agg(F.max(S.event_day(train_samples))).scalar()
    return facts.where(F.col("accepted_date") <= last)


def concept_coverage(facts: DataFrame) -> DataFrame:
    """(concept, company_count, fact_count), counted per entity first."""
    named = facts.where(F.col("concept_name").isNotNull() & F.col("unit").isNotNull())
    return (named.groupBy(*CONCEPT, ENTITY).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*CONCEPT).agg(F.count(ENTITY).alias("company_count"),
                                   F.sum("_n").alias("fact_count")))


def fit_feature_map(facts: DataFrame, *, min_companies: int = 100,
                    min_coverage_pct: float = 1.0, max_missing_pct: float = 99.0,
                    n_samples: Column | None = None, version: str = "v1") -> DataFrame:
    """Numbered opaque ids for concepts that enough entities report.

    Coverage is fact rows per sample in percent and can exceed 100. The ids
    are numbered in one window over the surviving concepts, whose number is a
    vocabulary size and not a data size.
    """
    stats = concept_coverage(facts).where(F.col("company_count") >= min_companies)
    if n_samples is not None:
        stats = stats.withColumn("coverage_pct", F.col("fact_count") * 100.0 / n_samples)
        stats = stats.where((F.col("coverage_pct") >= min_coverage_pct)
                            & (F.lit(100.0) - F.col("coverage_pct") <= max_missing_pct))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*CONCEPT)) - 1
    return stats.select(F.format_string("feature_%06d", number).alias("anonymous_feature_id"),
                        *CONCEPT, F.lit(version).alias("mapping_version"),
                        F.lit(True).alias("active"), "company_count", "fact_count")


def extend_feature_map(known: DataFrame, refit: DataFrame) -> DataFrame:
    """Keep the ids of ``known``; number concepts new in ``refit`` after them."""
    fresh = refit.join(known.select(*CONCEPT), CONCEPT, "left_anti")
    last = known.agg(F.max(F.substring("anonymous_feature_id", 9, 12).cast("int"))).scalar()
    number = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*CONCEPT))
              + F.coalesce(last, F.lit(-1)))
    return known.unionByName(fresh.withColumn("anonymous_feature_id",
                                              F.format_string("feature_%06d", number)),
                             allowMissingColumns=True)


def map_facts(facts: DataFrame, feature_map: DataFrame) -> DataFrame:
    """Attach feature ids; unmapped facts drop out."""
    return facts.join(feature_map.select(*CONCEPT, "anonymous_feature_id"), CONCEPT)


def fact_versions(mapped: DataFrame) -> DataFrame:
    """Distinct fact versions with the dates [valid_from, valid_to) they are current.

    Annual forms beat quarterly ones beat the rest; then the later acceptance
    wins; the smallest fact id settles what is left.
    """
    rank = F.when(F.col("form_type") == "10-K", 2).when(F.col("form_type") == "10-Q", 1).otherwise(0)
    key = [ENTITY, "anonymous_feature_id", "period_end_date"]
    distinct = (mapped.where(F.col("value").isNotNull())
                .groupBy(*key, rank.alias("form_rank"), F.col("accepted_date").alias("valid_from"))
                .agg(F.min(F.struct("fact_id", "value", "fiscal_period")).alias("_f")))
    # Distinct versions meet by entity here, where ``fact_cells`` asks for them, and do not move again.
    distinct = distinct.repartition(ENTITY)
    whole = Window.partitionBy(*key)
    later = F.lead("valid_from").over(
        Window.partitionBy(*key, "form_rank").orderBy("valid_from"))
    first = lambda k: F.min(F.when(F.col("form_rank") == k, F.col("valid_from"))).over(whole)
    ended = F.least(later, F.when(F.col("form_rank") < 2, first(2)),
                    F.when(F.col("form_rank") < 1, first(1)))
    return (distinct.withColumn("valid_to", ended)
            .where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
            .select(*key, "valid_from", "valid_to", F.col("_f.value").alias("value"),
                    F.col("_f.fiscal_period").alias("fiscal_period")))


def _current(day: Column) -> Column:
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def sample_periods(samples: DataFrame, versions: DataFrame,
                   periods_back: int = PERIODS_BACK, keep: Sequence[str] = ()) -> DataFrame:
    """(sample, period_offset, period_end_date): the newest visible periods, newest first.

    A sample id belongs to one entity, so its periods are ranked where the entity's rows
    already are. ``keep`` names further columns of the samples to carry along.
    """
    return _ranked_periods(samples, versions, periods_back, keep).drop("_reported")


def _ranked_periods(samples: DataFrame, versions: DataFrame, periods_back: int, keep: Sequence[str],
                    *reported: str) -> DataFrame:
    """``sample_periods`` with ``_reported``: those columns of the period's versions current on the sample's day."""
    newest_first = Window.partitionBy(ENTITY).orderBy(F.col("period_end_date").desc())
    newer = newest_first.rowsBetween(-periods_back, -1)
    own = F.collect_list(F.struct("valid_from", "valid_to", *reported)) if reported else F.lit(None)
    periods = (versions.groupBy(ENTITY, "period_end_date")
               .agg(F.min("valid_from").alias("valid_from"), own.alias("_versions"))
               .withColumn("valid_to", F.when(F.count("valid_from").over(newer) == periods_back,
                                              F.max("valid_from").over(newer))))
    asked = samples.select("sample_id", ENTITY, "entry_date", *keep,
                           S.event_day(samples).alias("_day"))
    current = (F.filter("_versions", lambda v: (v["valid_from"] <= F.col("_day"))
                        & (v["valid_to"].isNull() | (F.col("_day") < v["valid_to"]))) if reported else F.lit(None))
    order = Window.partitionBy(ENTITY, "sample_id").orderBy(F.col("period_end_date").desc())
    return (asked.join(periods, ENTITY).where(_current(F.col("_day")))
            .withColumn("_reported", current).drop("valid_from", "valid_to", "_versions")
            .withColumn("period_offset", F.row_number().over(order) - 1)
            .where(F.col("period_offset") < periods_back))


def fact_cells(samples: DataFrame, versions: DataFrame,
               periods_back: int = PERIODS_BACK, keep: Sequence[str] = ()) -> DataFrame:
    """Known cells (sample, period_offset, feature) with value and timing; absent cells have no row.

    A period brings its versions along to the samples of its entity, so versions, the samples'
    periods and cells do not move again. Its list is bounded by the distinct facts of one entity
    and period, and an entity's samples by the days of the calendar.
    """
    periods = _ranked_periods(samples, versions, periods_back, keep, "anonymous_feature_id", "value", "fiscal_period")
    return (periods.where(F.col("period_end_date").isNotNull()).withColumn("_f", F.explode("_reported"))
            .select("sample_id", "period_offset", "_f.anonymous_feature_id", "_f.value", "entry_date",
                    "period_end_date", "_f.fiscal_period", F.col("_f.valid_from").alias("accepted_date"), *keep))


def period_metadata(cells: DataFrame) -> DataFrame:
    """Filing delay, fiscal period and age of each sample period, from its first feature."""
    first = F.min_by(F.struct("accepted_date", "fiscal_period", "entry_date", "period_end_date"),
                     "anonymous_feature_id")
    return (cells.groupBy("sample_id", "period_offset").agg(first.alias("m"))
            .select("sample_id", "period_offset",
                    S.filing_delay_days("m.accepted_date", "m.period_end_date")
                    .alias("filing_delay_days"),
                    S.fiscal_period_index("m.fiscal_period").alias("fiscal_period_index"),
                    S.months_since("m.entry_date", "m.period_end_date")
                    .alias("months_since_period_end")))


def fit_cell_scaler(cells: DataFrame) -> DataFrame:
    """Median and IQR of the signed log per (period_offset, feature); fit on training cells."""
    logged = cells.withColumn("_v", S.signed_log("value"))
    q = exact_quantiles(logged, ["period_offset", "anonymous_feature_id"], "_v",
                        [0.25, 0.5, 0.75], "_q")
    return q.select("period_offset", "anonymous_feature_id", F.col("_q")[1].alias("median"),
                    (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def scale_cells(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace ``value`` by its robust-scaled signed log; cells unseen in training saturate."""
    return (cells.join(stats, ["period_offset", "anonymous_feature_id"], "left")
            .withColumn("value", S.robust_scaled(S.signed_log("value"),
                                                 F.coalesce("median", F.lit(0.0)), F.col("iqr")))
            .drop("median", "iqr"))


def derived_cells(cells: DataFrame, lookback: int = 4) -> DataFrame:
    """Year-on-year difference and z-score of the latest value, as cells at offset 0."""
    at = lambda p: F.max(F.when(F.col("period_offset") == p, F.col("value")))
    per = (cells.groupBy("sample_id", "anonymous_feature_id")
           .agg(at(0).alias("v0"), at(lookback).alias("vk"), F.avg("value").alias("mu"),
                F.stddev_samp("value").alias("sd")))
    z = F.when(F.col("sd") > 1e-9, (F.col("v0") - F.col("mu")) / F.col("sd"))
    kinds = F.array(F.struct(F.lit("derived_yoy_").alias("kind"),
                             (F.col("v0") - F.col("vk")).alias("value")),
                    F.struct(F.lit("derived_z_").alias("kind"), z.alias("value")))
    return (per.select("sample_id", "anonymous_feature_id", F.explode(kinds).alias("k"))
            .where(F.col("k.value").isNotNull())
            .select("sample_id", F.lit(0).alias("period_offset"),
                    F.concat("k.kind", "anonymous_feature_id").alias("anonymous_feature_id"),
                    F.col("k.value").alias("value")))


def derived_feature_map(feature_map: DataFrame) -> DataFrame:
    """The map with one raw, one yoy and one z row per feature."""
    kind = F.explode(F.array(F.lit("raw"), F.lit("yoy"), F.lit("z")))
    rows = feature_map.withColumn("derived_kind", kind)
    prefix = F.when(F.col("derived_kind") == "raw", "").otherwise(
        F.concat(F.lit("derived_"), F.col("derived_kind"), F.lit("_")))
    return rows.withColumn("anonymous_feature_id", F.concat(prefix, "anonymous_feature_id"))


def fit_encoder(train: DataFrame, facts: DataFrame, *, min_companies: int = 100,
                periods_back: int = PERIODS_BACK, derived: bool = True,
                stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Encoder tables (feature_map, scaler, derived_scaler) fitted on training samples only.

    Quantiles read their rows several times; ``stage`` may write the map and the cells, so
    that the point-in-time join runs once.
    """
    visible = visible_facts(facts, train)
    feature_map = stage(fit_feature_map(visible, min_companies=min_companies,
                                        n_samples=train.agg(F.count(F.lit(1))).scalar()))
    cells = stage(fact_cells(train, fact_versions(map_facts(facts, feature_map)), periods_back))
    out = {"feature_map": feature_map, "scaler": fit_cell_scaler(cells)}
    if derived:
        out["derived_scaler"] = fit_cell_scaler(stage(derived_cells(cells)))
    return out


def encode(samples: DataFrame, facts: DataFrame, encoder: dict[str, DataFrame],
           periods_back: int = PERIODS_BACK) -> DataFrame:
    """Scaled cells of ``samples`` under a fitted encoder; nothing is refitted."""
    versions = fact_versions(map_facts(facts, encoder["feature_map"]))
    return scaled_with_derived(fact_cells(samples, versions, periods_back), encoder)


def scaled_with_derived(cells: DataFrame, encoder: dict[str, DataFrame]) -> DataFrame:
    """Raw cells scaled by a fitted encoder, with the derived cells if it has a scaler for them."""
    columns = ["sample_id", "period_offset", "anonymous_feature_id", "value"]
    scaled = scale_cells(cells, encoder["scaler"]).select(*columns)
    if "derived_scaler" in encoder:
        extra = scale_cells(derived_cells(cells), encoder["derived_scaler"]).select(*columns)
        scaled = scaled.unionByName(extra)
    return scaled


def dense_frame(samples: DataFrame, cells: DataFrame, metadata: DataFrame,
                feature_ids: list[str], periods_back: int = PERIODS_BACK) -> DataFrame:
    """One row per sample: ``<id>_o<p>_value``, ``<id>_o<p>_missing`` and period metadata.

    For a few hundred columns; wider sets belong in ``model_cells`` and ``cell_arrays``.
    """
    values, flags = [], []
    for fid in feature_ids:
        for p in range(periods_back):
            here = (F.col("anonymous_feature_id") == fid) & (F.col("period_offset") == p)
            values.append(F.max(F.when(here, F.col("value"))).alias(f"{fid}_o{p}"))
    wide = cells.groupBy("sample_id").agg(*values)
    names = ["filing_delay_days", "fiscal_period_index", "months_since_period_end"]
    meta = metadata.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("period_offset") == p, F.col(n))).alias(f"meta_{n}_o{p}")
        for n in names for p in range(periods_back)])
    joined = samples.select("sample_id").join(wide, "sample_id", "left").join(
        meta, "sample_id", "left")
    for fid in feature_ids:
        for p in range(periods_back):
            c = F.col(f"{fid}_o{p}")
            flags += [F.coalesce(c, F.lit(0.0)).alias(f"{c_name(fid, p)}_value"),
                      c.isNull().cast("int").alias(f"{c_name(fid, p)}_missing")]
    return joined.select("sample_id", *flags, *[
        F.coalesce(f"meta_{n}_o{p}", F.lit(0.0)).alias(f"meta_{n}_o{p}")
        for n in names for p in range(periods_back)])


def c_name(feature_id: str, offset: int) -> str:
    return f"{feature_id}_o{offset}"


def model_cells(scaled: DataFrame, metadata: DataFrame | None = None, wide: DataFrame | None = None) -> DataFrame:
    """All model inputs as cells (sample_id, name, value); a cell that is absent counts as 0.

    A fact cell gives ``<id>_o<p>_value`` and ``<id>_o<p>_known`` (1), so a value that scales
    to 0 differs from one that is missing. ``wide`` holds further plain columns per sample.
    """
    at = F.concat(F.col("anonymous_feature_id"), F.lit("_o"), F.col("period_offset").cast("string"))
    kinds = F.explode(F.array(F.struct(F.concat(at, F.lit("_value")).alias("name"), F.col("value").cast("double").alias("value")),
                              F.struct(F.concat(at, F.lit("_known")).alias("name"), F.lit(1.0).alias("value"))))
    rows = scaled.select("sample_id", kinds.alias("c")).select("sample_id", "c.name", "c.value")
    if metadata is not None:
        names = [c for c in metadata.columns if c not in ("sample_id", "period_offset")]
        flat = metadata.select("sample_id", "period_offset", *[F.col(c).cast("double") for c in names])
        long = flat.unpivot(["sample_id", "period_offset"], names, "kind", "value")
        rows = rows.unionByName(long.select("sample_id", F.concat(
            F.lit("meta_"), "kind", F.lit("_o"), F.col("period_offset").cast("string")).alias("name"), "value"))
    if wide is not None:
        names = [c for c in wide.columns if c != "sample_id"]
        rows = rows.unionByName(wide.select("sample_id", *[F.col(c).cast("double") for c in names])
                                .unpivot("sample_id", names, "name", "value"))
    return rows.where("value IS NOT NULL")


def cell_index(cells: DataFrame) -> DataFrame:
    """(name, position): the distinct names numbered from 0 in order.

    Names are dealt to ranges, numbered inside each, and shifted by the sizes of the
    ranges before; only the range sizes meet in one task.
    """
    names = cells.select("name").distinct().repartitionByRange("name").select("name", F.spark_partition_id().alias("part"))
    sizes = names.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return names.withColumn("inside", inside).join(before, "part").select(
        "name", (F.col("before") + F.col("inside")).cast("int").alias("position"))


def cell_arrays(cells: DataFrame, index: DataFrame) -> DataFrame:
    """(sample_id, indices, values): each sample's cells in order of position; names without one drop out."""
    rows = cells.join(index, "name").groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "value"))).alias("_c"))
    return rows.select("sample_id", F.col("_c.position").alias("indices"), F.col("_c.value").alias("values"))


def sparse_struct(arrays: DataFrame, size: int, out: str = "features") -> DataFrame:
    """``cell_arrays`` as the struct that Spark ML stores sparse vectors in.

    Written as Parquet and read back under ``VectorUDT`` (``read_vectors``) it is a
    vector column; no Python runs.
    """
    return arrays.withColumn(out, F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                                           "indices", "values")).drop("indices", "values")


def read_vectors(spark, path: str, out: str = "features") -> DataFrame:
    """A written table whose ``out`` column is a vector struct, with that column as a vector."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    plain = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(out, VectorUDT()) if f.name == out else f for f in plain])).parquet(path)
