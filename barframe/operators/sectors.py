"""Company dimension: seeding from facts and sector labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.numbers import literal_lookup
from barframe.operators.reports import modal_value

# Industry names and the coarse bucket they belong to.
INDUSTRY_BUCKET = {
    "Telecommunication - Services": "Telecom",
    "Telecommunication - Equipment": "Telecom",
    "Cables - Telecom": "Telecom",
    "Construction": "Infrastructure",
    "Cement And Cement Products": "Infrastructure",
    "Power": "Infrastructure",
    "Engineering": "Infrastructure",
    "Shipping": "Infrastructure",
    "Cables - Power": "Infrastructure",
    "Electrical Equipment": "Infrastructure",
    "Steel And Steel Products": "Metals",
    "Metals": "Metals",
    "Mining": "Metals",
    "Computers - Software": "IT",
    "Computers - Hardware": "IT",
    "Pharmaceuticals": "Pharma",
    "Banks": "Financials",
    "Finance": "Financials",
}

# Names put into one bucket whatever their industry says.
DEFENCE_NAMES = (
    "HAL", "BEL", "BDL", "BEML", "MAZDOCK", "COCHINSHIP", "GRSE", "MIDHANI", "DATAPATTNS",
    "PARAS", "ZENTEC", "ASTRAMICRO", "IDEAFORGE", "SOLARINDS", "DYNAMATECH", "APOLLO",
    "APOLLOMIC", "MTARTECH", "AZAD", "UNIMECH", "TANEJAAERO", "BHARATFORG", "WALCHANNAG",
    "PREMEXPLN", "SIKA", "CENTUMELEC", "HBLENGINE", "TITAGARH", "RTNPOWER", "KRBL",
    "SHIVALIK", "VALIANTLAB",
)


def missing_companies(companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Dimension rows for symbols seen in filings but not yet known."""
    seen = filings.where("symbol is not null").groupBy(F.col("symbol").alias("ticker")).agg(
        F.coalesce(F.max("company_name"), F.max("symbol")).alias("name")
    )
    return seen.join(companies.select("ticker"), "ticker", "left_anti")


def assign_sectors(
    companies: DataFrame, filings: DataFrame, mapping: dict | None = None,
    overrides: dict[str, tuple] | None = None,
) -> DataFrame:
    """Sector = override list, else bucket of the modal industry, else that industry, else as before."""
    mapping = INDUSTRY_BUCKET if mapping is None else mapping
    overrides = {"Defence": DEFENCE_NAMES} if overrides is None else overrides
    usable = filings.where("sm_industry is not null and sm_industry <> '-'")
    modal = modal_value(usable, "symbol", "sm_industry").select(F.col("symbol").alias("ticker"), "sm_industry")
    joined = companies.join(modal, "ticker", "left")
    forced = F.lit(None).cast("string")
    for label, names in overrides.items():
        forced = F.coalesce(forced, F.when(F.col("ticker").isin(*names), label))
    mapped = literal_lookup(F.col("sm_industry"), mapping) if mapping else F.lit(None)
    return joined.withColumn("sector", F.coalesce(forced, mapped, "sm_industry", "sector")).drop("sm_industry")


def sector_sizes(companies: DataFrame, n: int = 12) -> DataFrame:
    return (
        companies.groupBy(F.coalesce("sector", F.lit("(none)")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "sector").limit(n)
    )
