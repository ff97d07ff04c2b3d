"""Nested JSON documents to flat tables.

Every reader takes a frame with one document per row in ``raw``, so documents
spread over tasks; a malformed document yields no rows instead of failing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.sources import schemas

DEFAULT_FORMS = ("10-Q", "10-K")


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, raw): whole files below ``path``."""
    return (spark.read.option("wholetext", True).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def company_directory(documents: DataFrame) -> DataFrame:
    """One row per entity from an object of objects, or a list of them; the first entry wins."""
    items = F.coalesce(F.map_values(F.from_json("raw", schemas.COMPANY_MAP)),
                       F.from_json("raw", schemas.COMPANY_LIST))
    source = F.col("path") if "path" in documents.columns else F.lit("")
    rows = documents.select(source.alias("_doc"), F.posexplode(items).alias("_pos", "_i"))
    number = F.coalesce(F.nullif("_i.cik_str", F.lit("")), "_i.cik")
    rows = rows.where(number.isNotNull() & F.col("_i.ticker").isNotNull())
    flat = rows.select("_doc", "_pos", S.entity_id(number).alias("internal_company_id"),
                       S.normalize_entity_key(number).alias("cik"),
                       F.upper("_i.ticker").alias("ticker"),
                       F.coalesce(F.nullif("_i.title", F.lit("")), "_i.name").alias("company_name"),
                       F.col("_i.exchange").alias("exchange"),
                       F.lit("common_stock").alias("security_type"))
    rest = [c for c in flat.columns if c not in ("_doc", "_pos", "cik")]
    first = F.min_by(F.struct(*rest), F.struct("_doc", "_pos"))
    return (flat.where(F.col("cik").isNotNull()).groupBy("cik").agg(first.alias("_f"))
            .select("cik", "_f.*"))


def event_list(documents: DataFrame, forms: tuple[str, ...] = DEFAULT_FORMS,
               include_amendments: bool = False) -> DataFrame:
    """Events from parallel arrays, cut to the shortest array.

    ``accepted_datetime`` is an instant (text without a zone is New York time);
    ``accepted_text`` keeps what the document says.
    """
    doc = documents.select(F.from_json("raw", schemas.EVENT_DOCUMENT).alias("_d"))
    recent = [F.col(f"_d.filings.recent.{n}") for n in schemas.EVENT_ARRAYS]
    shortest = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in recent])
    zipped = F.when(shortest > 0, F.slice(F.arrays_zip(*recent), 1, shortest))
    rows = doc.select(S.normalize_entity_key("_d.cik").alias("cik"), F.explode(zipped).alias("_e"))
    e = {n: F.col(f"_e.{n}") for n in schemas.EVENT_ARRAYS}
    amended = F.endswith(e["form"], F.lit("/A"))
    wanted = e["form"].isin(*forms)
    if include_amendments:
        wanted = wanted | amended
    return rows.where(wanted & F.col("cik").isNotNull()).select(
        S.hash_id("FILING_", ["cik", e["accessionNumber"]], 16).alias("filing_event_id"),
        S.entity_id("cik").alias("internal_company_id"), "cik",
        e["accessionNumber"].alias("accession_number"), e["form"].alias("form_type"),
        e["filingDate"].try_cast("date").alias("filed_date"),
        S.eastern_instant(e["acceptanceDateTime"]).alias("accepted_datetime"),
        e["acceptanceDateTime"].alias("accepted_text"),
        e["reportDate"].try_cast("date").alias("report_period_end_date"),
        e["primaryDocument"].alias("primary_document"), amended.alias("is_amendment"))


def fact_documents(documents: DataFrame, id_with_start: bool = True) -> DataFrame:
    """Long facts from taxonomy -> concept -> unit -> observations.

    ``id_with_start`` keeps a quarter and a year-to-date value ending on the
    same day apart; False reproduces ids that let them collide.
    """
    doc = documents.select(F.from_json("raw", schemas.FACT_DOCUMENT).alias("_d"))
    rows = (doc.select(S.normalize_entity_key("_d.cik").alias("cik"),
                       F.explode("_d.facts").alias("taxonomy", "_c"))
            .select("cik", "taxonomy", F.explode("_c").alias("concept_name", "_u"))
            .select("cik", "taxonomy", "concept_name", F.explode("_u.units").alias("unit", "_o"))
            .select("cik", "taxonomy", "concept_name", "unit", F.explode("_o").alias("_v")))
    parts = ["cik", "taxonomy", "concept_name", F.coalesce(F.col("_v.accn"), F.lit("")),
             F.col("_v.end"), "unit"]
    if id_with_start:
        parts.append(F.col("_v.start"))
    return rows.where(F.col("cik").isNotNull()).select(
        S.hash_id("FACT_", parts, 20).alias("fact_id"),
        S.entity_id("cik").alias("internal_company_id"), "cik", "taxonomy", "concept_name", "unit",
        S.to_double("_v.val").alias("value"),
        F.col("_v.start").try_cast("date").alias("period_start_date"),
        F.col("_v.end").try_cast("date").alias("period_end_date"),
        F.col("_v.fy").try_cast("int").alias("fiscal_year"), F.col("_v.fp").alias("fiscal_period"),
        F.col("_v.form").alias("form_type"), F.col("_v.accn").alias("accession_number"),
        F.col("_v.filed").try_cast("date").alias("accepted_date"), F.col("_v.frame").alias("frame"))


def sector_table(documents: DataFrame) -> DataFrame:
    """Entity with its industry code, description and division."""
    d = documents.select(F.from_json("raw", schemas.EVENT_DOCUMENT).alias("_d"))
    code = F.coalesce(F.nullif("_d.sic", F.lit("")), F.nullif("_d.sicCode", F.lit("")))
    key = S.normalize_entity_key("_d.cik")
    return d.where(key.isNotNull()).select(
        key.alias("cik"), S.entity_id("_d.cik").alias("internal_company_id"), code.alias("sic"),
        F.coalesce("_d.sicDescription", "_d.sic_description").alias("sic_description"),
        S.industry_division(code).alias("sic_division"))


def constituent_list(df: DataFrame) -> DataFrame:
    """Normalise a constituent table: known columns, padded ids, dashed tickers."""
    renames = {"Symbol": "ticker", "Security": "name", "GICS Sector": "sector",
               "GICS Sub-Industry": "sub_industry", "CIK": "cik"}
    named = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    out = named.select(*[c for c in renames.values() if c in named.columns])
    if "cik" in out.columns:
        plain = F.regexp_replace(F.col("cik").cast("string"), r"\.0$", "")
        out = out.withColumn("cik", F.lpad(plain, F.greatest(F.length(plain), F.lit(10)), F.lit("0")))
    return out.withColumn("ticker_yf", F.translate(F.col("ticker").cast("string"), ".", "-"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row of each key in a stated order; reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
            .select(key, "_f.*"))


def rebuild_tables(spark: SparkSession, events_dir: str, facts_dir: str, out_dir: str,
                   forms: tuple[str, ...] = DEFAULT_FORMS, include_amendments: bool = False,
                   known_missing: DataFrame | None = None) -> dict[str, int]:
    """Parse raw folders again, de-duplicate by id, write both tables, return their row counts.

    ``known_missing`` (cik) leaves out entities known to have no facts.
    """
    from eventide.sources.tables import write_counted
    events = event_list(read_documents(spark, events_dir), forms, include_amendments)
    facts = fact_documents(read_documents(spark, facts_dir))
    if known_missing is not None:
        events = events.join(known_missing, "cik", "left_anti")
        facts = facts.join(known_missing, "cik", "left_anti")
    return {"filings": write_counted(first_per_key(events, "filing_event_id", ["accession_number"]),
                                     f"{out_dir}/filings"),
            "facts": write_counted(first_per_key(facts, "fact_id", ["accession_number", "frame"]),
                                   f"{out_dir}/facts")}
