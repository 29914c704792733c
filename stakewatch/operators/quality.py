"""Data-quality checks: rule lists per record, summaries, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stakewatch import params
from stakewatch.functions.dates import parse_date
from stakewatch.functions.identity import VERSION_PATTERN
from stakewatch.functions.numeric import safe_number

CIK = r"^[0-9]{10}$"
ACCESSION = r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$"
QUALITY_LEVELS = ["high", "acceptable", "limited", "unusable"]


def found(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules]))


def quality_level(errors: Column, warnings: Column) -> Column:
    return F.when(F.size(errors) > 0, "unusable").when(F.size(warnings) > 0, "limited").otherwise("high")


def quality_rows(df: DataFrame, artifact: str, record_id: Column, prefix: str, checks: int, errors: Column, warnings: Column, count_warnings: bool = False) -> DataFrame:
    failed = F.size(errors)
    passed = F.lit(checks) - failed - (F.size(warnings) if count_warnings else F.lit(0))
    return df.withColumns({"_errors": errors, "_warnings": warnings}).select(
        F.concat(F.lit(f"{prefix}:"), F.coalesce(record_id, F.lit(""))).alias("quality_id"),
        F.lit(artifact).alias("artifact_name"),
        F.coalesce(record_id, F.lit("")).alias("record_id"),
        quality_level(F.col("_errors"), F.col("_warnings")).alias("quality"),
        F.greatest(passed, F.lit(0)).alias("checks_passed"),
        failed.alias("checks_failed"),
        F.array_join("_warnings", "|").alias("warnings"),
        F.array_join("_errors", "|").alias("errors"),
    )


def check_filings(filings: DataFrame) -> DataFrame:
    errors = found(
        (~F.coalesce("accession_number", F.lit("")).rlike(ACCESSION), "invalid_accession"),
        (~F.coalesce("issuer_cik", F.lit("")).rlike(CIK), "invalid_issuer_cik"),
        (~F.coalesce("form_type", F.lit("")).isin("4", "4/A"), "invalid_form_type"),
        (parse_date(F.col("filing_date")).isNull(), "invalid_filing_date"),
    )
    none = F.array().cast("array<string>")
    return quality_rows(filings, "filings", F.col("filing_id"), "filing", 4, errors, none)


def check_identities(issuers: DataFrame, people: DataFrame) -> DataFrame:
    def errors(cik: str, name: str) -> Column:
        number = F.coalesce(F.col(cik), F.lit(""))
        return found(
            ((number != "") & ~number.rlike(CIK), "invalid_cik"),
            (F.trim(F.coalesce(F.col(name), F.lit(""))) == "", "missing_name"),
        )

    none = F.array().cast("array<string>")
    missing = found((F.coalesce("owner_cik", F.lit("")) == "", "missing_owner_cik"))
    return quality_rows(
        issuers, "issuers", F.col("issuer_cik"), "issuers", 2, errors("issuer_cik", "issuer_name"), none
    ).unionByName(
        quality_rows(people, "insiders", F.col("insider_id"), "insiders", 2, errors("owner_cik", "canonical_name"), missing)
    )


def check_transactions(lots: DataFrame) -> DataFrame:
    code = F.trim(F.coalesce("transaction_code", F.lit("")))
    side = F.trim(F.coalesce("acquired_disposed_code", F.lit("")))
    day, filed = parse_date(F.col("transaction_date")), parse_date(F.col("filing_date"))
    qualifies = F.coalesce("is_qualifying_purchase", F.lit(False))

    def not_positive(name: str) -> Column:
        return qualifies & ~F.coalesce(safe_number(F.col(name), None) > 0, F.lit(False))

    errors = found(
        ((side != "") & ~side.isin("A", "D"), "invalid_acquired_disposed_code"),
        (day.isNull(), "invalid_transaction_date"),
        (filed.isNull(), "invalid_filing_date"),
        (not_positive("shares"), "invalid_shares"),
        (not_positive("price_per_share"), "invalid_price_per_share"),
        (not_positive("reported_value"), "invalid_reported_value"),
        (qualifies & ~F.coalesce("is_non_derivative", F.lit(False)), "derivative_misclassified"),
        (qualifies & ((code != "P") | (side != "A")), "qualifying_rule_mismatch"),
        (safe_number(F.col("shares_owned_after"), None) < 0, "negative_holdings_after"),
    )
    warnings = found(
        ((code != "") & ~code.isin(params.TRANSACTION_CODES), "unknown_transaction_code"),
        (day > filed, "transaction_after_filing"),
    )
    return quality_rows(lots, "transactions", F.col("transaction_id"), "transaction", 8, errors, warnings, True)


def check_prices(prices: DataFrame, as_of: str | Column, position: str = "load_no") -> DataFrame:
    """Checks per price file. Rows per (file, date) are counted first, so a file is judged from partial aggregates;
    the order check compares neighbours in load order within blocks and across block ends."""
    day = parse_date(F.col("date"))
    typed = prices.withColumn("_day", day).withColumns(
        {c: safe_number(F.col(c), None).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume", "stock_splits")}
    )
    n = F.count(F.lit(1))
    per_day = typed.groupBy("file_ticker", "_day").agg(
        n.alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"bad_{c}") for c in ("open", "high", "low", "close", "adj_close")],
        F.count_if(F.col("volume") < 0).alias("bad_volume"),
        F.count_if(
            (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
        ).alias("bad_range"),
        F.count_if(F.col("stock_splits") < 0).alias("bad_split"),
        F.count_if(~F.col("ticker").eqNullSafe(F.col("file_ticker"))).alias("other_ticker"),
        F.min(position).alias("first_place"),
        F.max(position).alias("last_place"),
    )
    # Load order is by date exactly when each day's last row comes before the next day's first one.
    line = Window.partitionBy("file_ticker").orderBy("_day")
    ordered = per_day.withColumn("_earlier", F.max("last_place").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    facts = ordered.groupBy("file_ticker").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("_day").isNull(), F.col("n")).otherwise(F.lit(0))).alias("no_day"),
        F.max("n").alias("most_per_day"),
        F.max("_day").alias("newest"),
        F.max(F.coalesce(F.col("_earlier") > F.col("first_place"), F.lit(False))).alias("unsorted"),
        *[F.sum(c).alias(c) for c in per_day.columns if c.startswith("bad_") or c == "other_ticker"],
    )
    limit = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    errors = found(
        (F.col("no_day") > 0, "invalid_dates"),
        (F.col("most_per_day") > 1, "duplicate_dates"),
        *[(F.col(f"bad_{c}") > 0, f"nonfinite_{c}") for c in ("open", "high", "low", "close", "adj_close")],
        (F.col("bad_volume") > 0, "negative_volume"),
        (F.col("bad_range") > 0, "ohlc_inconsistent"),
        (F.col("bad_split") > 0, "invalid_split"),
    )
    warnings = found(
        (F.col("unsorted"), "unsorted_dates"),
        (F.col("other_ticker") > 0, "ticker_inconsistent"),
        (F.datediff(limit, F.col("newest")) > 10, "stale"),
        (F.col("rows") < 252, "limited_history"),
    )
    return facts.withColumns({"_errors": errors, "_warnings": warnings}).select(
        F.col("file_ticker").alias("ticker"),
        "rows",
        quality_level(F.col("_errors"), F.col("_warnings")).alias("quality"),
        F.array_join("_warnings", "|").alias("warnings"),
        F.array_join("_errors", "|").alias("errors"),
    )


def quality_summary(*reports: DataFrame) -> DataFrame:
    """Records and unusable records per artifact."""
    rows = None
    for report in reports:
        part = report.select("artifact_name", "quality")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("artifact_name").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("quality") == "unusable").alias("unusable")
    )


# Required fields per table, besides the common ones (fixed values of the record contracts).
COMMON_FIELDS = ["schema_version", "source_lineage", "generated_at_utc", "quality", "quality_flags"]
REQUIRED_FIELDS = {
    "filings": ["filing_id", "accession_number", "form_type", "issuer_cik", "filing_date"],
    "issuers": ["issuer_cik", "issuer_name"],
    "insiders": ["insider_id", "canonical_name"],
    "securities": ["security_id", "issuer_cik", "security_title"],
    "footnotes": ["footnote_id", "accession_number", "footnote_text"],
    "transactions": ["transaction_id", "accession_number", "issuer_cik", "transaction_date"],
    "purchase_events": ["event_id", "issuer_cik", "transaction_date", "purchase_value"],
    "purchase_campaigns": ["campaign_id", "issuer_cik", "start_date", "end_date", "purchase_value"],
    "executive_histories": ["history_id", "issuer_cik", "insider_id", "as_of_date"],
    "event_signals": ["signal_id", "event_id", "behavior_change_score"],
    "company_signals": ["company_signal_id", "issuer_cik", "as_of_date", "conviction_score"],
    "rankings": ["ranking_id", "category", "rank", "issuer_cik"],
    "quality_reports": ["quality_id", "artifact_name"],
    "pipeline_runs": ["run_id", "status", "started_at_utc"],
    "manifest": ["manifest_id", "pipeline_version"],
}


def check_contract(df: DataFrame, fields: list[str]) -> DataFrame:
    """Violations per rule in one pass: missing required fields, unknown quality levels, bad version texts."""
    rules = {f"missing_{f}": F.col(f).isNull() | (F.col(f).cast("string") == "") for f in fields if f in df.columns}
    rules |= {f"missing_{f}": F.lit(True) for f in fields if f not in df.columns}
    if "quality" in df.columns:
        rules["unknown_quality"] = ~F.coalesce(F.col("quality"), F.lit("")).isin(QUALITY_LEVELS)
    if "schema_version" in df.columns:
        rules["bad_schema_version"] = ~F.trim(F.coalesce(F.col("schema_version"), F.lit(""))).rlike(VERSION_PATTERN)
    one = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def require_contract(df: DataFrame, fields: list[str], table: str) -> DataFrame:
    """The same table, failing the job at the first row that breaks a required field."""
    bad = F.lit(False)
    for field in fields:
        bad = bad | F.col(field).isNull() | (F.col(field).cast("string") == "")
    stop = F.raise_error(F.lit(f"{table}: a required field is empty")).cast("boolean")
    return df.filter(F.when(bad, stop).otherwise(F.lit(True)))


def check_weights(weights: DataFrame) -> DataFrame:
    """Weight groups: in [0, 1] and summing to one. Columns: weight_group, name, weight."""
    facts = weights.groupBy("weight_group").agg(
        F.sum("weight").alias("total"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.count(F.lit(1)).alias("members")
    )
    good = (F.abs(F.col("total") - 1) < 1e-9) & (F.col("low") >= 0) & (F.col("high") <= 1)
    return facts.select("weight_group", "members", F.round("total", 6).alias("total"), good.alias("valid"))


def check_thresholds(thresholds: DataFrame) -> DataFrame:
    """Thresholds: none negative, and each low bound below its high one; a missing bound is no bound. Columns: name, low, high."""
    known = F.coalesce(F.col("low") >= 0, F.lit(True)) & F.coalesce(F.col("high") >= 0, F.lit(True))
    good = known & F.coalesce(F.col("low") < F.col("high"), F.lit(True))
    return thresholds.select("name", good.alias("valid"))


def own_weights(spark: SparkSession) -> DataFrame:
    """The project's own weight groups as a table (``weight_group``, ``name``, ``weight``)."""
    groups = {"behavior": params.BEHAVIOR_WEIGHTS, "conviction": params.CONVICTION_WEIGHTS, "evidence": params.EVIDENCE_WEIGHTS}
    rows = [(group, name, float(weight)) for group, weights in groups.items() for name, weight in weights.items()]
    return spark.createDataFrame(rows, "weight_group string, name string, weight double")


def own_thresholds(spark: SparkSession) -> DataFrame:
    """The project's own limits as a table (``name``, ``low``, ``high``): eligibility, penalties, role values, and windows, which
    must grow from one to the next."""
    limits = params.ELIGIBILITY
    rows = [("market_cap", limits["market_cap_min"], limits["market_cap_max"]), ("price", limits["price_min"], None), ("dollar_volume", limits["dollar_volume_min"], None)]
    rows += [(f"penalty {name}", float(value), None) for name, value in params.PENALTIES.items()]
    rows += [(f"role {name}", float(value), None) for name, value in params.ROLE_QUALITY.items()]
    for name, windows in (("velocity", params.VELOCITY_DAYS), ("forward", params.FORWARD_SESSIONS), ("prior", params.PRIOR_SESSIONS)):
        rows += [(f"{name} {low}", float(low), float(high)) for low, high in zip(windows, windows[1:])]
    return spark.createDataFrame(rows, "name string, low double, high double")
