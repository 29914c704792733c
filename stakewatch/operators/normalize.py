"""Filings, lots and identities in normal form: reference joins, amendments, copies, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stakewatch.functions.identity import lineage, stable_id
from stakewatch.functions.roles import roles_from_title
from stakewatch.functions.text import clean_name, filing_symbol, market_symbol
from stakewatch.operators.grouping import last_per_key, mark_copies, spread_out

AMENDMENT_KEYS = [
    "issuer_cik",
    "owner_cik",
    "transaction_date",
    "security_title",
    "transaction_code",
    "direct_indirect_code",
]


def nonzero_cik(col: Column) -> Column:
    """Ten-digit number, null when missing or all zeros."""
    padded = F.lpad(F.coalesce(col, F.lit("")), 10, "0")
    return F.when(padded != "0000000000", padded)


def filing_rows(parsed: DataFrame) -> DataFrame:
    """One row per filing document (columns as ``sources.filings.parse_documents`` gives them)."""
    form = F.coalesce(
        F.nullif("document_type", F.lit("")), F.when(F.coalesce("is_amendment", F.lit(False)), "4/A").otherwise("4")
    )
    broken = F.size(F.coalesce("quality_flags", F.array())) > 0
    return parsed.select(
        stable_id(F.col("accession_number")).alias("filing_id"),
        "accession_number",
        form.alias("form_type"),
        "issuer_cik",
        "issuer_name",
        "filing_date",
        "period_of_report",
        (form == "4/A").alias("is_amendment"),
        F.when(broken, "unusable").otherwise("active").alias("status"),
        F.when(broken, "unusable").otherwise("high").alias("quality"),
        "quality_flags",
        lineage("sec_xml", F.col("path"), F.col("accession_number")).alias("source_lineage"),
    )


def lot_rows(parsed: DataFrame) -> DataFrame:
    """One row per owner and transaction lot. A filing without owners keeps one row per lot with no owner."""
    owner = F.col("owner")
    lot = F.col("lot")
    insider = F.coalesce(nonzero_cik(owner["owner_cik"]), stable_id(F.col("issuer_cik"), F.coalesce(owner["owner_name"], F.lit(""))))
    form = F.coalesce(
        F.nullif("document_type", F.lit("")), F.when(F.coalesce("is_amendment", F.lit(False)), "4/A").otherwise("4")
    )
    shares, price = lot["shares"], lot["price_per_share"]
    qualifies = F.coalesce(
        lot["is_non_derivative"] & (lot["transaction_code"] == "P") & (lot["acquired_disposed_code"] == "A") & (shares > 0) & (price > 0),
        F.lit(False),
    )
    roles = roles_from_title(owner["officer_title"], owner["is_director"], owner["is_ten_percent_owner"], owner["is_officer"])
    spread = spread_out(parsed.withColumn("owner", F.explode_outer("owners")), "lots", "lot")
    return spread.select(
        stable_id(
            F.col("accession_number"), insider, lot["sequence"], lot["transaction_date"], lot["security_title"],
            lot["transaction_code"], shares, price, lot["direct_indirect_code"],
        ).alias("transaction_id"),
        "accession_number",
        "issuer_cik",
        insider.alias("insider_id"),
        nonzero_cik(owner["owner_cik"]).alias("owner_cik"),
        owner["owner_name"].alias("owner_name"),
        "ticker",
        lot["transaction_date"].alias("transaction_date"),
        "filing_date",
        form.alias("form_type"),
        lot["security_title"].alias("security_title"),
        lot["transaction_code"].alias("transaction_code"),
        lot["acquired_disposed_code"].alias("acquired_disposed_code"),
        shares.alias("shares"),
        price.alias("price_per_share"),
        (shares * price).alias("reported_value"),
        lot["shares_owned_after"].alias("shares_owned_after"),
        lot["direct_indirect_code"].alias("direct_indirect_code"),
        roles.alias("normalized_roles"),
        footnote_texts(lot["footnote_refs"], F.col("footnotes")).alias("footnotes"),
        lot["is_non_derivative"].alias("is_non_derivative"),
        (lot["is_non_derivative"] & (lot["transaction_code"] == "P")).alias("is_open_market_purchase"),
        qualifies.alias("is_qualifying_purchase"),
        (form == "4/A").alias("is_amendment"),
        F.when(qualifies | ~lot["is_non_derivative"], "high").otherwise("acceptable").alias("quality"),
    )


def footnote_texts(refs: Column, notes: Column) -> Column:
    """Texts of the referenced footnotes in order, empty ones left out. The notes sit in the same filing row."""
    known = F.map_from_entries(F.transform(notes, lambda n: F.struct(n["id"], n["text"])))
    found = F.transform(refs, lambda ref: F.coalesce(F.try_element_at(known, ref), F.lit("")))
    return F.array_join(F.filter(found, lambda text: text != ""), "|")


def join_footnotes(refs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Footnotes kept in their own table: references as rows (key, accession, ref, place) to one text per lot."""
    found = refs.join(notes, ["accession_number", "footnote_ref"]).filter("footnote_text <> ''")
    return found.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "footnote_text"))), lambda n: n["footnote_text"]), "|"
        ).alias("footnotes")
    )


def footnote_rows(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("note", F.explode("footnotes")).select(
        stable_id(F.col("accession_number"), F.col("note.id")).alias("footnote_id"),
        "accession_number",
        "issuer_cik",
        F.col("note.id").alias("footnote_ref"),
        F.col("note.text").alias("footnote_text"),
    )


def mark_duplicates(lots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Status of exact repeats: the first by the order stays active, the others are duplicates of limited quality."""
    marked = mark_copies(lots, keys, order)
    return marked.withColumn("status", F.when(F.col("is_copy"), "duplicate").otherwise("active")).withColumn(
        "quality", F.when(F.col("is_copy"), "limited").otherwise(F.col("quality"))
    )


def mark_superseded(lots: DataFrame, keys: list[str] = AMENDMENT_KEYS) -> DataFrame:
    """Active originals with an amendment of the same issuer, owner, date, security, code and ownership form.

    The amended keys are first made distinct, so the join never multiplies rows; missing values compare as empty.
    """
    folded = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    amended = lots.filter("is_amendment").select(*folded).distinct().withColumn("_amended", F.lit(True))
    out = lots.select("*", *folded).join(amended, [f"_{k}" for k in keys], "left").drop(*[f"_{k}" for k in keys])
    hit = F.coalesce("_amended", F.lit(False)) & ~F.col("is_amendment") & (F.col("status") == "active")
    return (
        out.withColumn("is_superseded", hit)
        .withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
        .drop("_amended")
    )


def resolve_issuers(issuers: DataFrame, reference: DataFrame) -> DataFrame:
    """Issuers with their ticker: that of the reference list, else the one of the filing.

    The reference list (one row per listed company) is joined by equality; Spark broadcasts it when its size allows.
    """
    ref = reference.select("issuer_cik", filing_symbol(F.col("reference_ticker")).alias("_ref"), "reference_title")
    joined = issuers.join(ref, "issuer_cik", "left")
    own, given = F.coalesce("_ref", F.lit("")), filing_symbol(F.col("filing_ticker"))
    ticker = F.when(own != "", own).otherwise(given)
    flags = F.array_compact(
        F.array(
            F.when((F.coalesce("filing_ticker", F.lit("")) != "") & (given == ""), F.lit("invalid_filing_ticker")),
            F.when((own != "") & (given != "") & (own != given), F.lit("filing_ticker_differs_from_sec_reference")),
        )
    )
    return joined.select(
        "issuer_cik",
        F.coalesce(F.nullif("issuer_name", F.lit("")), "reference_title", F.lit("")).alias("issuer_name"),
        ticker.alias("primary_ticker"),
        market_symbol(ticker).alias("yf_ticker"),
        F.when(own != "", "exact_cik").when(given != "", "filing_symbol").otherwise("unresolved").alias("mapping_quality"),
        F.when(own != "", "high").when(given != "", "acceptable").otherwise("limited").alias("quality"),
        flags.alias("quality_flags"),
    )


def merge_people(appearances: DataFrame) -> DataFrame:
    """People over all their filings: first and last date, union of roles, other fields from the last filing."""
    place = F.struct("filing_date", "accession_number", "line_no")
    return appearances.groupBy("insider_id").agg(
        F.min("filing_date").alias("first_seen_date"),
        F.max("filing_date").alias("last_seen_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("normalized_roles")))).alias("normalized_roles"),
        F.max_by("raw_officer_title", place).alias("raw_officer_title"),
        F.max_by("issuer_cik", place).alias("issuer_cik"),
        clean_name(F.max_by("owner_name", place)).alias("canonical_name"),
    )


def merge_securities(lots: DataFrame, order: list[Column]) -> DataFrame:
    """One row per issuer, title and derivative flag; the last appearance wins."""
    rows = lots.select("issuer_cik", "security_title", "is_non_derivative", "ticker", *order)
    last = last_per_key(rows, ["issuer_cik", "security_title", "is_non_derivative"], order)
    derivative = ~F.col("is_non_derivative")
    flag_text = F.when(derivative, F.lit("True")).otherwise(F.lit("False"))
    return last.select(
        stable_id(F.col("issuer_cik"), F.col("security_title"), flag_text).alias("security_id"),
        "issuer_cik",
        "security_title",
        "ticker",
        F.when(derivative, "derivative").otherwise("non_derivative").alias("security_type"),
        (~derivative & F.lower("security_title").contains("common")).alias("is_common_stock"),
    )
