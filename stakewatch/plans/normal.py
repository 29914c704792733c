"""Queries on sources, normal forms, quality checks and scalar expressions."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stakewatch import params
from stakewatch.functions import dates, identity, numeric, text
from stakewatch.functions.numeric import round_to
from stakewatch.functions.roles import roles_from_title
from stakewatch.functions.text import joined
from stakewatch.operators import activity, normalize, quality
from stakewatch.operators.events import purchase_events
from stakewatch.operators.grouping import spread_out
from stakewatch.plans import tables
from stakewatch.plans.oracle import TITLE_SQL, compact, feed_money, fixed, money, r, roles_sql, sid, trimmed
from stakewatch.plans.registry import query
from stakewatch.session import shared_folder
from stakewatch.sources import filings as filing_source
from stakewatch.sources import indexes, sinks
from stakewatch.sources import tables as table_source

_numbers = itertools.count()


def scratch(spark: SparkSession, name: str) -> str:
    """New folder in the shared space for a query that writes files and reads them back."""
    return f"{shared_folder(spark)}/stakewatch/{spark.sparkContext.applicationId}/files/{name}-{next(_numbers)}"


def pick(number: Column, *choices: Column) -> Column:
    """The choice at number modulo their count."""
    out = choices[-1]
    for place in range(len(choices) - 2, -1, -1):
        out = F.when(number % len(choices) == place, choices[place]).otherwise(out)
    return out


def pick_sql(number: str, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"CASE ({number}) % {len(choices)} {whens} ELSE {choices[-1]} END"


# --- sources ----------------------------------------------------------------------------------------------------

def _document(raw_orders: DataFrame) -> DataFrame:
    """Ownership documents written from orders; every ninth one is cut off, every fifth has no owner."""
    key = F.col("o_orderkey")
    owner = F.concat(
        F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), F.col("o_custkey").cast("string"),
        F.lit("</rptOwnerCik><rptOwnerName>Buyer, "), F.col("o_custkey").cast("string"),
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector>"
              "<officerTitle>Chief Executive Officer</officerTitle></reportingOwnerRelationship></reportingOwner>"),
    )
    lot = F.concat(
        F.lit('<nonDerivativeTransaction><securityTitle><value>Common Stock</value></securityTitle><transactionDate><value>'),
        F.col("o_orderdate").cast("date").cast("string"),
        F.lit('</value></transactionDate><transactionCoding><transactionCode>'),
        F.when(F.col("o_orderstatus") == "F", "P").otherwise("S"),
        F.lit('</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>'),
        (key % 100 + 1).cast("string"),
        F.lit('</value><footnoteId id="F1"/></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare>'
              '<transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts>'
              '<postTransactionAmounts><sharesOwnedFollowingTransaction><value>500</value></sharesOwnedFollowingTransaction></postTransactionAmounts>'
              '<ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>'),
    )
    whole = F.concat(
        F.lit('<ownershipDocument xmlns="urn:forms"><documentType>'),
        F.when(F.col("o_orderpriority").like("5%"), "4/A").otherwise("4"),
        F.lit("</documentType><periodOfReport>2000-01-01</periodOfReport><issuer><issuerCik>"),
        (key % 97).cast("string"),
        F.lit("</issuerCik><issuerName>Issuer</issuerName><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer>"),
        F.when(key % 5 == 0, F.lit("")).otherwise(owner),
        F.lit("<nonDerivativeTable>"), lot, F.when(key % 2 == 0, lot).otherwise(F.lit("")),
        F.lit('</nonDerivativeTable><footnotes><footnote id="F1">Held by a trust.</footnote></footnotes></ownershipDocument>'),
    )
    return raw_orders.select(
        F.when(key % 9 == 0, F.substring(whole, 1, 300)).otherwise(whole).alias("xml"),
        F.lpad(key.cast("string"), 10, "0").alias("accession_number"),
        F.col("o_orderdate").cast("date").cast("string").alias("filing_date"),
        F.concat(F.lit("filings/"), key.cast("string")).alias("path"),
    )


@query(
    "src1_ownership_documents",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS accession_number,
     CASE WHEN o_orderkey%9<>0 THEN CASE WHEN o_orderpriority LIKE '5%' THEN '4/A' ELSE '4' END END AS document_type,
     CASE WHEN o_orderkey%9<>0 THEN lpad(CAST(o_orderkey%97 AS VARCHAR),10,'0') END AS issuer_cik,
     CASE WHEN o_orderkey%9=0 OR o_orderkey%5=0 THEN 0 ELSE 1 END AS owners,
     CASE WHEN o_orderkey%9=0 THEN 0 WHEN o_orderkey%2=0 THEN 2 ELSE 1 END AS lots,
     CASE WHEN o_orderkey%9=0 THEN 'malformed_xml' ELSE '' END AS quality_flags FROM orders""",
)
def src1(spark, sf_dir):
    parsed = filing_source.parse_documents(_document(tables.raw(spark, sf_dir, "orders")))
    return parsed.select(
        "accession_number", "document_type", "issuer_cik", F.size("owners").alias("owners"), F.size("lots").alias("lots"),
        joined(F.col("quality_flags")).alias("quality_flags"),
    )


@query(
    "src1_document_lots",
    """SELECT accession_number, insider, roles, footnotes, is_qualifying_purchase, count(*) AS lots, sum(reported_value) AS reported_value FROM (
     SELECT lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS accession_number, CASE WHEN o_orderkey%5=0 OR o_custkey=0 THEN NULL ELSE lpad(CAST(o_custkey AS VARCHAR),10,'0') END AS insider,
      CASE WHEN o_orderkey%5=0 THEN '' ELSE 'ceo|director|operating_executive' END AS roles, 'Held by a trust.' AS footnotes,
      o_orderstatus='F' AS is_qualifying_purchase, (o_orderkey%100+1)*2.5e0 AS reported_value
     FROM orders, range(CASE WHEN o_orderkey%2=0 THEN 2 ELSE 1 END) WHERE o_orderkey%9<>0) GROUP BY 1,2,3,4,5""",
)
def src1_lots(spark, sf_dir):
    rows = normalize.lot_rows(filing_source.parse_documents(_document(tables.raw(spark, sf_dir, "orders"))))
    return rows.groupBy(
        "accession_number", F.col("owner_cik").alias("insider"), joined(F.col("normalized_roles")).alias("roles"), "footnotes", "is_qualifying_purchase"
    ).agg(F.count(F.lit(1)).alias("lots"), F.sum("reported_value").alias("reported_value"))


def _option_document(lines: DataFrame) -> DataFrame:
    """Ownership documents with a derivative lot per line, two owners, and elements that no table asks for."""
    def wrapped(tag: str, value: Column, inside: str = "") -> Column:
        return F.concat(F.lit(f"<{tag}><value>"), value.cast("string"), F.lit(f"</value>{inside}</{tag}>"))

    number = F.col("l_linenumber")
    lot = F.concat(
        F.lit("<derivativeTransaction>"), wrapped("securityTitle", F.lit("007 Call")), wrapped("conversionOrExercisePrice", F.col("l_quantity"), '<footnoteId id="F3"/>'),
        wrapped("transactionDate", F.col("l_shipdate").cast("date")), wrapped("deemedExecutionDate", F.date_add("l_shipdate", 1)),
        F.lit("<transactionCoding><transactionFormType>4</transactionFormType><transactionCode>M</transactionCode><equitySwapInvolved>"), (number % 2).cast("string"), F.lit("</equitySwapInvolved></transactionCoding>"),
        wrapped("exerciseDate", F.date_add("l_shipdate", 30)), wrapped("expirationDate", F.lit("2010-01-01")),
        F.lit("<underlyingSecurity>"), wrapped("underlyingSecurityTitle", F.lit("Common")), wrapped("underlyingSecurityShares", F.col("l_partkey")), F.lit("</underlyingSecurity>"),
        F.when(number % 3 == 0, F.lit('<unknown><deep><footnoteId id="F9"/><footnoteId id="F1"/></deep></unknown>')).otherwise(""), F.lit("</derivativeTransaction>"),
    )
    owners = "".join(
        f"<reportingOwner><reportingOwnerId><rptOwnerCik>{n}</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isOther>{n - 1}</isOther><otherText>{text}</otherText></reportingOwnerRelationship></reportingOwner>"
        for n, text in ((1, ""), (2, "Trustee"))
    )
    head = F.lit(f"<ownershipDocument><documentType>4/A</documentType><remarks>Corrects line 1.</remarks>{owners}<derivativeTable>")
    return lines.select(
        F.concat(head, lot, F.lit("</derivativeTable></ownershipDocument>")).alias("xml"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("accession_number"),
        F.col("l_shipdate").cast("date").cast("string").alias("filing_date"), F.lit("x").alias("path"), F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit("T16:30:00")).alias("accepted_at"),
    )


@query(
    "src1_derivative_terms",
    """SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey AS accession_number, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)||'T16:30:00' AS accepted_at, 'Corrects line 1.' AS amendment_description, 'false|true' AS others, '|Trustee' AS other_texts,
     '007 Call' AS security_title, '4' AS transaction_form_type, l_linenumber%2=1 AS equity_swap_involved, CAST(CAST(l_shipdate AS DATE)+1 AS VARCHAR) AS deemed_execution_date, l_quantity*1e0 AS conversion_price,
     CAST(CAST(l_shipdate AS DATE)+30 AS VARCHAR) AS exercise_date, '2010-01-01' AS expiration_date, 'Common' AS underlying_security_title, l_partkey*1e0 AS underlying_shares, CASE WHEN l_linenumber%3=0 THEN 'F1|F3|F9' ELSE 'F3' END AS footnote_refs FROM lineitem""",
)
def src1_terms(spark, sf_dir):
    parsed = filing_source.parse_documents(_option_document(tables.raw(spark, sf_dir, "lineitem")))
    rows = spread_out(parsed.select("accession_number", "accepted_at", "amendment_description", "owners", "lots"), "lots", "lot")
    return rows.select(
        "accession_number", "accepted_at", "amendment_description", F.array_join(F.transform("owners", lambda o: o["is_other"].cast("string")), "|").alias("others"),
        F.array_join(F.transform("owners", lambda o: F.coalesce(o["other_text"], F.lit(""))), "|").alias("other_texts"),
        *[F.col(f"lot.{c}").alias(c) for c in ("security_title", "transaction_form_type", "equity_swap_involved", "deemed_execution_date", "conversion_price", "exercise_date", "expiration_date", "underlying_security_title", "underlying_shares")],
        F.array_join("lot.footnote_refs", "|").alias("footnote_refs"),
    )


@query(
    "src2_block_extraction",
    """SELECT page_id, coalesce(
      trim(list_filter(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1), lambda b: contains(b,'<b') OR contains(b,':b'))[1], ' \n\r\t'),
      CASE WHEN contains(html,'<b') AND contains(html,'</b>') THEN
       substr(html, CASE WHEN position('<?xml' IN html)>0 THEN position('<?xml' IN html) ELSE position('<b' IN html) END,
        CAST(length(html)-position('>b/<' IN reverse(html))+1-(CASE WHEN position('<?xml' IN html)>0 THEN position('<?xml' IN html) ELSE position('<b' IN html) END)+1 AS BIGINT)) END) AS block
    FROM pages""",
)
def src2(spark, sf_dir):
    return tables.raw(spark, sf_dir, "pages").select("page_id", filing_source.extract_block(F.col("html"), "p", "b").alias("block"))


def _index_lines(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    data = F.concat_ws(
        "|", F.col("o_custkey").cast("string"), F.concat(F.lit("Company "), F.col("o_custkey").cast("string")),
        pick(key, F.lit("4"), F.lit("4/A"), F.lit("10-K")), F.col("o_orderdate").cast("date").cast("string"),
        F.concat(F.lit("edgar/data/"), F.col("o_custkey").cast("string"), F.lit("/"), F.lpad(key.cast("string"), 10, "0"), F.lit(".txt")),
    )
    line = pick(key, data, data, data, F.lit("CIK|Company Name|Form Type|Date Filed|Filename"), F.lit("--------"), F.lit("1|short|4"), data)
    return orders.select(line.alias("value"))


_INDEX_SQL = """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS filing_date, lpad(CAST(o_custkey AS VARCHAR),10,'0') AS issuer_cik,
 'Company '||o_custkey AS company_name, CASE o_orderkey%3 WHEN 0 THEN '4' ELSE '4/A' END AS form_type,
 lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS accession_number FROM orders WHERE o_orderkey%3<>2 AND o_orderkey%7 NOT IN (3,4,5)"""


@query("src3_daily_index", _INDEX_SQL)
def src3(spark, sf_dir):
    # Written as text and read back, so the file path of the source is exercised.
    path = scratch(spark, "index")
    _index_lines(tables.raw(spark, sf_dir, "orders")).write.mode("overwrite").text(path)
    return indexes.read_index(spark, path).drop("filing_path")


@query(
    "src4_recent_filings",
    """WITH days AS (SELECT lpad(CAST(l_orderkey AS VARCHAR),10,'0') AS accession_number, lpad(CAST(l_suppkey AS VARCHAR),10,'0') AS issuer_cik,
      CAST(l_shipdate AS DATE) AS index_date FROM lineitem), top AS (SELECT max(index_date) AS m FROM days)
    SELECT accession_number, issuer_cik, index_date FROM (SELECT d.*, row_number() OVER (PARTITION BY accession_number ORDER BY index_date DESC, issuer_cik) AS rn
     FROM days d, top WHERE isodow(index_date)<6 AND m-index_date BETWEEN 0 AND 89) WHERE rn=1""",
)
def src4(spark, sf_dir):
    days = tables.raw(spark, sf_dir, "lineitem").select(
        tables.padded("l_orderkey").alias("accession_number"), tables.padded("l_suppkey").alias("issuer_cik"),
        F.col("l_shipdate").cast("date").alias("index_date"),
    )
    newest = days.agg(F.max("index_date")).scalar()
    return indexes.recent_filings(days, newest, 90)


_PAGE_LINK = r"""(?i)href=["']([^"']+)["']"""


@query(
    "src5_page_links",
    """SELECT page_id, year, quarter, arg_max(href, place) AS url FROM (
     SELECT page_id, href, place, CAST(2006+length(href)%9 AS INTEGER) AS year, CAST(1+length(href)%4 AS INTEGER) AS quarter FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href,
       generate_subscripts(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1),1) AS place FROM pages)) WHERE year>=2008 GROUP BY 1,2,3""",
)
def src5(spark, sf_dir):
    # The driver's pages hold no archive names, so year and quarter come from the link text; same last-link rule.
    from stakewatch.operators.grouping import last_per_key

    links = tables.raw(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_PAGE_LINK), F.lit(1))).alias("place", "url")
    )
    dated = links.withColumns({"year": F.length("url") % 9 + 2006, "quarter": F.length("url") % 4 + 1}).filter("year >= 2008")
    return last_per_key(dated, ["page_id", "year", "quarter"], [F.col("place")]).drop("place")


@query(
    "src5_archive_links",
    """SELECT page_id, 2010+CAST(page_id%12 AS INTEGER) AS year, 1+CAST(page_id%4 AS INTEGER) AS quarter,
     'https://archive.example/files/b/'||CAST(2010+page_id%12 AS VARCHAR)||'q'||CAST(1+page_id%4 AS VARCHAR)||'_form345.zip' AS url
    FROM pages WHERE 2010+page_id%12>=2015""",
)
def src5_archives(spark, sf_dir):
    stem = F.concat((F.col("page_id") % 12 + 2010).cast("string"), F.lit("q"), (F.col("page_id") % 4 + 1).cast("string"), F.lit("_form345.zip"))
    pages = tables.raw(spark, sf_dir, "pages").withColumn(
        "html", F.concat("html", F.lit('<a href="/files/a/'), stem, F.lit('">old</a><a href="/files/b/'), stem, F.lit('">new</a>'))
    )
    return indexes.archive_links(pages, "https://archive.example", 2015)


@query(
    "src6_archive_row_counts",
    "SELECT o_orderstatus AS folder, count(*) AS lines FROM orders GROUP BY 1",
)
def src6(spark, sf_dir):
    path = scratch(spark, "archive")
    tables.raw(spark, sf_dir, "orders").select(F.col("o_orderstatus"), F.col("o_orderkey").cast("string").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("o_orderstatus").text(path)
    # Each written file has a row less than lines; how many files a folder has is up to Spark.
    folder = F.regexp_extract("path", r"o_orderstatus=([^/]+)/", 1)
    return indexes.archive_row_counts(spark, path).groupBy(folder.alias("folder")).agg(F.sum(F.col("rows") + 1).alias("lines"))


@query(
    "src7_reference_tickers",
    "SELECT lpad(CAST(s_suppkey AS VARCHAR),10,'0') AS issuer_cik, 'S'||s_suppkey AS reference_ticker, s_name AS reference_title FROM supplier",
)
def src7(spark, sf_dir):
    entry = F.struct(F.col("s_suppkey").cast("string").alias("cik_str"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"))
    # One JSON object per row keeps each file splittable; the list form is the same map with more entries.
    raw = tables.raw(spark, sf_dir, "supplier").select(F.to_json(F.create_map(F.col("s_suppkey").cast("string"), entry)).alias("value"))
    return table_source.reference_tickers(raw)


@query(
    "src8_company_metadata",
    """SELECT 'S'||s_suppkey AS ticker, CASE WHEN s_suppkey%4=0 THEN '' ELSE s_name END AS company_name, CASE WHEN s_suppkey%4=0 THEN NULL ELSE s_acctbal END AS market_cap,
     CASE WHEN s_suppkey%4=0 THEN '' ELSE 'N'||s_nationkey END AS sector, '' AS industry, CASE WHEN s_suppkey%4=0 THEN 'limited' ELSE 'high' END AS metadata_quality FROM supplier""",
)
def src8(spark, sf_dir):
    info = F.to_json(F.struct(F.col("s_name").alias("shortName"), F.col("s_acctbal").alias("marketCap"), F.concat(F.lit("N"), "s_nationkey").alias("sector")))
    raw = tables.raw(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("{}")).otherwise(info).alias("value")
    )
    return table_source.company_metadata(raw).drop("exchange", "quote_type")


@query(
    "src9_csv_round_trip",
    "SELECT issuer_cik, insider_id, count(*) AS lots, sum(shares) AS shares FROM lots GROUP BY 1,2",
    ("lots",),
)
def src9(spark, sf_dir):
    path = scratch(spark, "csv")
    table_source.write_csv(tables.lots(spark, sf_dir).select("issuer_cik", "insider_id", "shares"), path)
    back = table_source.read_csv(spark, path, "issuer_cik string, insider_id string, shares double")
    return back.groupBy("issuer_cik", "insider_id").agg(F.count(F.lit(1)).alias("lots"), F.sum("shares").alias("shares"))


@query(
    "src10_normalize_download",
    """SELECT CAST(l_shipdate AS DATE) AS date, 'S'||l_suppkey AS ticker, l_extendedprice AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low,
     l_extendedprice AS close, CAST(NULL AS DOUBLE) AS adj_close, l_quantity AS volume, 0e0 AS dividends, 0e0 AS stock_splits FROM lineitem""",
)
def src10(spark, sf_dir):
    download = tables.raw(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Open"), F.col("l_extendedprice").alias("Close "),
        F.col("l_quantity").alias("Volume"), "l_suppkey",
    )
    return table_source.normalize_download(download, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).drop("source")


def _loads(spark, sf_dir):
    """A stored part of the price table and a later load that overlaps it with other values."""
    base = tables.prices(spark, sf_dir)
    stored = base.filter("date < '2000-01-01'").withColumn("load_no", F.lit(1))
    fresh = base.filter("date >= '1999-06-01'").withColumn("load_no", F.lit(2)).withColumn("close", F.col("close") + 1)
    return stored, fresh


PRICE_MERGE_SQL = f"""SELECT ticker, date, {r("close+CASE WHEN date>=DATE '1999-06-01' THEN 1 ELSE 0 END")} AS close,
 CASE WHEN date>=DATE '1999-06-01' THEN 2 ELSE 1 END AS load_no FROM prices"""


@query("src11_price_merge", PRICE_MERGE_SQL, ("prices",))
def src11(spark, sf_dir):
    return table_source.merge_prices(*_loads(spark, sf_dir)).select("ticker", "date", round_to(F.col("close"), 6).alias("close"), "load_no")


@query(
    "src12_strict_page_text",
    """SELECT issuer_cik, ticker, company_name, sector, CASE WHEN market_cap>=0 THEN market_cap END AS market_cap, 7 AS names FROM companies""",
    ("companies",),
)
def src12(spark, sf_dir):
    odd = F.when(F.col("market_cap") < 0, F.lit(float("nan"))).otherwise(F.col("market_cap"))
    companies = tables.companies(spark, sf_dir).withColumn("market_cap", odd).withColumn("missing", F.lit(None).cast("string"))
    pages = sinks.page_text(companies, "issuer_cik")
    read = F.from_json("payload", "ticker string, company_name string, sector string, market_cap double")
    names = F.size(F.json_object_keys("payload"))
    return pages.select("issuer_cik", read.alias("page"), names.cast("int").alias("names")).select("issuer_cik", "page.*", "names")


@query(
    "src13_manifest",
    """SELECT 'issuer_cik='||issuer_cik AS folder, sha256(page||chr(10)) AS sha256, strlen(page)+1 AS bytes FROM
     (SELECT issuer_cik, '{"ticker":"'||ticker||'","company_name":"'||company_name||'","sector":"'||sector||'"}' AS page FROM companies)""",
    ("companies",),
)
def src13(spark, sf_dir):
    path = scratch(spark, "pages")
    pages = sinks.page_text(tables.companies(spark, sf_dir).select("issuer_cik", "ticker", "company_name", "sector"), "issuer_cik")
    sinks.write_pages(pages, path, "issuer_cik")
    return sinks.manifest(spark, path, "*.txt").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), "sha256", "bytes")


# --- normal forms -----------------------------------------------------------------------------------------------

@query(
    "p1_filing_rows",
    f"""SELECT {sid("lpad(CAST(o_orderkey AS VARCHAR),10,'0')")} AS filing_id, CASE WHEN o_orderpriority LIKE '5%' THEN '4/A' ELSE '4' END AS form_type,
     o_orderpriority LIKE '5%' AS is_amendment, CASE WHEN o_orderstatus='P' THEN 'unusable' ELSE 'active' END AS status,
     CASE WHEN o_orderstatus='P' THEN 'unusable' ELSE 'high' END AS quality FROM orders""",
)
def p1(spark, sf_dir):
    amended = F.col("o_orderpriority").like("5%")
    parsed = tables.raw(spark, sf_dir, "orders").select(
        tables.padded("o_orderkey").alias("accession_number"),
        # half of the documents name their type, the others only carry the flag
        F.when(F.col("o_orderkey") % 2 == 0, F.when(amended, "4/A").otherwise("4")).otherwise("").alias("document_type"),
        amended.alias("is_amendment"),
        tables.padded("o_custkey").alias("issuer_cik"),
        F.lit("").alias("issuer_name"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.lit("").alias("period_of_report"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("malformed_xml"))).alias("quality_flags"),
        F.lit("").alias("path"),
    )
    return normalize.filing_rows(parsed).select("filing_id", "form_type", "is_amendment", "status", "quality")


def _nested_lines(spark, sf_dir) -> DataFrame:
    """One document per line item with none, one or two owners."""
    line = F.col("l_linenumber")
    owner = F.struct(
        tables.padded("c_nationkey").alias("owner_cik"), F.col("c_name").alias("owner_name"), F.lit("Chief Financial Officer").alias("officer_title"),
        F.lit(True).alias("is_director"), F.lit(True).alias("is_officer"), F.lit(False).alias("is_ten_percent_owner"),
    )
    second = F.struct(
        F.lit("0000000000").alias("owner_cik"), F.lit("Second Owner").alias("owner_name"), F.lit("").alias("officer_title"),
        F.lit(False).alias("is_director"), F.lit(True).alias("is_officer"), F.lit(True).alias("is_ten_percent_owner"),
    )
    lot = F.struct(
        line.alias("sequence"), F.lit("Common Stock").alias("security_title"), F.col("l_shipdate").cast("date").cast("string").alias("transaction_date"),
        F.when(F.col("l_returnflag") == "N", "P").otherwise("S").alias("transaction_code"), F.col("l_quantity").alias("shares"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_share"), F.lit("A").alias("acquired_disposed_code"),
        F.lit(1.0).alias("shares_owned_after"), F.col("l_linestatus").alias("direct_indirect_code"),
        F.array(F.lit("F1"), F.lit("F2")).alias("footnote_refs"), (line % 2 == 0).alias("is_non_derivative"),
    )
    joined_lines = (
        tables.raw(spark, sf_dir, "lineitem")
        .join(tables.raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables.raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined_lines.select(
        tables.padded("l_orderkey").alias("accession_number"), F.lit("4").alias("document_type"), F.lit(False).alias("is_amendment"),
        tables.padded("l_suppkey").alias("issuer_cik"), F.lit("ABC").alias("ticker"), F.lit("").alias("filing_date"),
        F.when(line % 5 == 0, F.array().cast(f"array<{owner_type()}>")).when(line % 3 == 0, F.array(owner, second)).otherwise(F.array(owner)).alias("owners"),
        F.array(lot).alias("lots"),
        F.array(
            F.struct(F.lit("F1").alias("id"), F.col("o_orderpriority").alias("text")), F.struct(F.lit("F2").alias("id"), F.lit("").alias("text"))
        ).alias("footnotes"),
    )


def owner_type() -> str:
    return "struct<owner_cik:string,owner_name:string,officer_title:string,is_director:boolean,is_officer:boolean,is_ten_percent_owner:boolean>"


_LINES = "FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey"
_LINE_FACTS = f"""lpad(CAST(l_orderkey AS VARCHAR),10,'0') AS accession_number, lpad(CAST(l_suppkey AS VARCHAR),10,'0') AS issuer_cik,
 l_quantity AS shares, CASE WHEN l_tax>0 THEN {r('l_quantity*(l_extendedprice/l_quantity)')} END AS reported_value, o_orderpriority AS footnotes,
 l_linenumber%2=0 AND l_returnflag='N' AND l_tax>0 AS is_qualifying_purchase, l_linenumber%2=0 AND l_returnflag='N' AS is_open_market_purchase,
 CASE WHEN (l_linenumber%2=0 AND l_returnflag='N' AND l_tax>0) OR l_linenumber%2<>0 THEN 'high' ELSE 'acceptable' END AS quality"""


@query(
    "p2_transaction_rows",
    f"""SELECT {_LINE_FACTS}, CASE WHEN c_nationkey=0 THEN {sid("lpad(CAST(l_suppkey AS VARCHAR),10,'0')", 'c_name')} ELSE lpad(CAST(c_nationkey AS VARCHAR),10,'0') END AS insider_id, 'cfo|director|operating_executive' AS normalized_roles {_LINES} WHERE l_linenumber%5<>0
    UNION ALL SELECT {_LINE_FACTS}, {sid("lpad(CAST(l_suppkey AS VARCHAR),10,'0')", "'Second Owner'")}, 'other_officer|ten_percent_owner' {_LINES} WHERE l_linenumber%5<>0 AND l_linenumber%3=0
    UNION ALL SELECT {_LINE_FACTS}, {sid("lpad(CAST(l_suppkey AS VARCHAR),10,'0')", "''")}, '' {_LINES} WHERE l_linenumber%5=0""",
)
def p2(spark, sf_dir):
    rows = normalize.lot_rows(_nested_lines(spark, sf_dir))
    return rows.select(
        "accession_number", "issuer_cik", "insider_id", "shares", round_to(F.col("reported_value"), 6).alias("reported_value"), "footnotes",
        "is_qualifying_purchase", "is_open_market_purchase", "quality", joined(F.col("normalized_roles")).alias("normalized_roles"),
    )


def _issuer_tables(spark, sf_dir):
    key = F.col("s_suppkey")
    supplier = tables.raw(spark, sf_dir, "supplier")
    own = F.concat(F.lit("S"), key.cast("string"))
    issuers = supplier.select(
        tables.padded("s_suppkey").alias("issuer_cik"), F.when(key % 5 == 0, "").otherwise(F.col("s_name")).alias("issuer_name"),
        pick(key, own, F.concat(F.lit("(s"), key.cast("string"), F.lit(")")), F.lit("n/a"), F.lit("")).alias("filing_ticker"),
    )
    reference = supplier.filter(key % 3 != 0).select(
        tables.padded("s_suppkey").alias("issuer_cik"), F.when(key % 6 == 1, F.concat(F.lit("S."), key.cast("string"))).otherwise(own).alias("reference_ticker"),
        F.concat(F.lit("Ref "), "s_name").alias("reference_title"),
    )
    return issuers, reference


@query(
    "j1_issuer_reference",
    """SELECT issuer_cik, issuer_name, ticker AS primary_ticker, replace(ticker,'.','-') AS yf_ticker,
     CASE WHEN ref<>'' THEN 'exact_cik' WHEN given<>'' THEN 'filing_symbol' ELSE 'unresolved' END AS mapping_quality,
     CASE WHEN ref<>'' THEN 'high' WHEN given<>'' THEN 'acceptable' ELSE 'limited' END AS quality,
     array_to_string(list_filter([CASE WHEN raw<>'' AND given='' THEN 'invalid_filing_ticker' END,
       CASE WHEN ref<>'' AND given<>'' AND ref<>given THEN 'filing_ticker_differs_from_sec_reference' END], lambda x: x IS NOT NULL),'|') AS quality_flags
    FROM (SELECT *, CASE WHEN ref<>'' THEN ref ELSE given END AS ticker FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR),10,'0') AS issuer_cik,
      CASE WHEN s_suppkey%5<>0 THEN s_name WHEN s_suppkey%3<>0 THEN 'Ref '||s_name ELSE '' END AS issuer_name,
      CASE WHEN s_suppkey%3=0 THEN '' WHEN s_suppkey%6=1 THEN 'S.'||s_suppkey ELSE 'S'||s_suppkey END AS ref,
      CASE WHEN s_suppkey%4<2 THEN 'S'||s_suppkey ELSE '' END AS given, CASE WHEN s_suppkey%4=3 THEN '' ELSE 'x' END AS raw FROM supplier))""",
)
def j1(spark, sf_dir):
    return normalize.resolve_issuers(*_issuer_tables(spark, sf_dir)).withColumn("quality_flags", joined(F.col("quality_flags")))


@query(
    "j2_footnote_texts",
    """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_partkey%3=0 THEN o_orderstatus WHEN l_partkey%3=1 THEN o_orderpriority END,
      CASE WHEN l_suppkey%3=0 THEN o_orderstatus WHEN l_suppkey%3=1 THEN o_orderpriority END) AS footnotes
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
)
def j2(spark, sf_dir):
    line = tables.raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = tables.raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    notes = F.array(
        F.struct(F.lit("F0").alias("id"), F.col("o_orderstatus").alias("text")), F.struct(F.lit("F1").alias("id"), F.col("o_orderpriority").alias("text")),
        F.struct(F.lit("F2").alias("id"), F.lit("").alias("text")),
    )
    refs = F.array(F.concat(F.lit("F"), F.col("l_partkey") % 3), F.concat(F.lit("F"), F.col("l_suppkey") % 3))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", normalize.footnote_texts(refs, notes).alias("footnotes")
    )


@query(
    "j2_footnote_table_join",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS accession_number, o_orderpriority||'|'||o_orderstatus AS footnotes FROM orders""",
)
def j2_join(spark, sf_dir):
    orders = tables.raw(spark, sf_dir, "orders").select(tables.padded("o_orderkey").alias("accession_number"), "o_orderstatus", "o_orderpriority")
    notes = orders.select("accession_number", F.explode(F.create_map(F.lit("F1"), F.col("o_orderstatus"), F.lit("F2"), F.col("o_orderpriority"), F.lit("F3"), F.lit(""))).alias("footnote_ref", "footnote_text"))
    refs = orders.select("accession_number", F.posexplode(F.array(F.lit("F2"), F.lit("F3"), F.lit("F1"), F.lit("F9"))).alias("place", "footnote_ref"))
    return normalize.join_footnotes(refs, notes, ["accession_number"])


_COPY_ORDER = "not_amendment, issuer_cik, part_no, shares, reported_value, shares_owned_after"
_MARKED = f"""(SELECT *, CASE WHEN row_number() OVER (PARTITION BY accession_number,line_no ORDER BY {_COPY_ORDER})=1 THEN 'active' ELSE 'duplicate' END AS status
 FROM (SELECT *, NOT is_amendment AS not_amendment FROM lots))"""


def _marked(spark, sf_dir) -> DataFrame:
    keep = ["accession_number", "line_no", "issuer_cik", "owner_cik", "part_no", "transaction_date", "security_title", "transaction_code",
            "direct_indirect_code", "shares", "reported_value", "shares_owned_after", "is_amendment", "quality", "is_qualifying_purchase"]
    lots = tables.lots(spark, sf_dir).select(*keep, (~F.col("is_amendment")).alias("not_amendment"))
    return normalize.mark_duplicates(lots, ["accession_number", "line_no"], _COPY_ORDER.split(", "))


@query(
    "a5_duplicate_transactions",
    f"SELECT accession_number, line_no, issuer_cik, part_no, shares, shares_owned_after, status, CASE WHEN status='duplicate' THEN 'limited' ELSE quality END AS quality FROM {_MARKED}",
    ("lots",),
)
def a5(spark, sf_dir):
    return _marked(spark, sf_dir).select("accession_number", "line_no", "issuer_cik", "part_no", "shares", "shares_owned_after", "status", "quality")


_AMEND = "issuer_cik,owner_cik,transaction_date,security_title,transaction_code,direct_indirect_code"


@query(
    "j3_superseded_originals",
    f"""SELECT accession_number, line_no, issuer_cik, part_no, shares, is_superseded, CASE WHEN is_superseded THEN 'superseded' ELSE status END AS status FROM (
      SELECT m.*, NOT is_amendment AND status='active' AND ({_AMEND}) IN (SELECT ({_AMEND}) FROM lots WHERE is_amendment) AS is_superseded FROM {_MARKED} m)""",
    ("lots",),
)
def j3(spark, sf_dir):
    return normalize.mark_superseded(_marked(spark, sf_dir)).select(
        "accession_number", "line_no", "issuer_cik", "part_no", "shares", "is_superseded", "status"
    )


@query(
    "a1_active_only_events",
    f"""SELECT issuer_cik, owner_cik, transaction_date, count(*) AS events, CAST(sum(lots) AS BIGINT) AS lots FROM (SELECT issuer_cik, owner_cik, transaction_date, security_title, direct_indirect_code, accession_number, count(*) AS lots
     FROM (SELECT m.*, NOT is_amendment AND status='active' AND ({_AMEND}) IN (SELECT ({_AMEND}) FROM lots WHERE is_amendment) AS gone FROM {_MARKED} m)
     WHERE is_qualifying_purchase AND status='active' AND NOT gone GROUP BY ALL) GROUP BY 1,2,3""",
    ("lots",),
)
def a1_active(spark, sf_dir):
    lots = normalize.mark_superseded(_marked(spark, sf_dir)).withColumns(
        {
            "insider_id": F.col("owner_cik"), "ticker": F.lit(""), "filing_date": F.col("transaction_date"),
            "normalized_roles": F.array().cast("array<string>"), "footnotes": F.lit(""),
        }
    )
    return purchase_events(lots, active_only=True).groupBy("issuer_cik", "owner_cik", "transaction_date").agg(
        F.count(F.lit(1)).alias("events"), F.sum("lot_count").alias("lots")
    )


@query(
    "a3_merged_people",
    f"""SELECT insider_id, min(filing_date) AS first_seen_date, max(filing_date) AS last_seen_date, array_to_string(list_sort(list_distinct(flatten(list(normalized_roles)))),'|') AS normalized_roles,
     arg_max({TITLE_SQL.format('segment')}, (filing_date,accession_number,line_no)) AS raw_officer_title, 'Buyer '||insider_id AS canonical_name FROM lots GROUP BY insider_id""",
    ("lots",),
)
def a3(spark, sf_dir):
    seen = tables.lots(spark, sf_dir).withColumns(
        {"raw_officer_title": tables.title_of(F.col("segment")), "owner_name": F.concat(F.lit("buyer,  "), "insider_id")}
    )
    return normalize.merge_people(seen).drop("issuer_cik").withColumn("normalized_roles", joined(F.col("normalized_roles")))


@query(
    "a4_securities",
    f"""SELECT {sid('issuer_cik', 'security_title', "CASE WHEN is_non_derivative THEN 'False' ELSE 'True' END")} AS security_id, issuer_cik, security_title, ticker,
     CASE WHEN is_non_derivative THEN 'non_derivative' ELSE 'derivative' END AS security_type, is_non_derivative AND contains(lower(security_title),'common') AS is_common_stock
    FROM (SELECT DISTINCT issuer_cik, security_title, is_non_derivative, ticker FROM lots)""",
    ("lots",),
)
def a4(spark, sf_dir):
    return normalize.merge_securities(tables.lots(spark, sf_dir), [F.col("accession_number"), F.col("line_no")])


@query(
    "a4_first_per_accession",
    "SELECT accession_number, min(issuer_cik) AS issuer_cik FROM lots GROUP BY 1",
    ("lots",),
)
def a4_first(spark, sf_dir):
    from stakewatch.operators.grouping import first_per_key

    return first_per_key(tables.lots(spark, sf_dir).select("accession_number", "issuer_cik"), ["accession_number"], [F.col("issuer_cik")])


# --- quality ----------------------------------------------------------------------------------------------------

def _filings_to_check(spark, sf_dir):
    key = F.col("o_orderkey")
    return tables.raw(spark, sf_dir, "orders").select(
        key.cast("string").alias("filing_id"),
        F.when(key % 7 == 0, "bad").otherwise(F.concat(F.lpad(key.cast("string"), 10, "0"), F.lit("-99-000001"))).alias("accession_number"),
        F.when(key % 11 == 0, F.col("o_custkey").cast("string")).otherwise(tables.padded("o_custkey")).alias("issuer_cik"),
        pick(key, F.lit("4"), F.lit("4/A"), F.lit("4"), F.lit("5")).alias("form_type"),
        F.when(key % 13 == 0, "").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("filing_date"),
    )


_FILING_CHECK = """SELECT 'filing:'||o_orderkey AS quality_id, CASE WHEN len(e)>0 THEN 'unusable' ELSE 'high' END AS quality, CAST(4-len(e) AS INTEGER) AS checks_passed,
 CAST(len(e) AS INTEGER) AS checks_failed, array_to_string(e,'|') AS errors, 'filings' AS artifact_name FROM (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey%7=0 THEN 'invalid_accession' END,
 CASE WHEN o_orderkey%11=0 THEN 'invalid_issuer_cik' END, CASE WHEN o_orderkey%4=3 THEN 'invalid_form_type' END, CASE WHEN o_orderkey%13=0 THEN 'invalid_filing_date' END], lambda x: x IS NOT NULL) AS e FROM orders)"""


@query("v1_filing_checks", _FILING_CHECK)
def v1(spark, sf_dir):
    return quality.check_filings(_filings_to_check(spark, sf_dir)).select(
        "quality_id", "artifact_name", "quality", "checks_passed", "checks_failed", "errors"
    )


def _identities(spark, sf_dir):
    key = F.col("s_suppkey")
    issuers = tables.raw(spark, sf_dir, "supplier").select(
        F.when(key % 4 == 0, "12x").otherwise(tables.padded("s_suppkey")).alias("issuer_cik"), F.when(key % 5 == 0, "  ").otherwise(F.col("s_name")).alias("issuer_name")
    )
    number = F.col("c_custkey")
    people = tables.raw(spark, sf_dir, "customer").select(
        number.cast("string").alias("insider_id"), pick(number, tables.padded("c_custkey"), F.lit(""), F.lit("77")).alias("owner_cik"), F.col("c_name").alias("canonical_name")
    )
    return quality.check_identities(issuers, people)


@query(
    "v2_identity_checks",
    """SELECT artifact_name, artifact_name||':'||id AS quality_id, CASE WHEN len(e)>0 THEN 'unusable' WHEN w<>'' THEN 'limited' ELSE 'high' END AS quality,
     CAST(2-len(e) AS INTEGER) AS checks_passed, array_to_string(e,'|') AS errors, w AS warnings FROM (
     SELECT 'issuers' AS artifact_name, CASE WHEN s_suppkey%4=0 THEN '12x' ELSE lpad(CAST(s_suppkey AS VARCHAR),10,'0') END AS id,
      list_filter([CASE WHEN s_suppkey%4=0 THEN 'invalid_cik' END, CASE WHEN s_suppkey%5=0 THEN 'missing_name' END], lambda x: x IS NOT NULL) AS e, '' AS w FROM supplier
     UNION ALL SELECT 'insiders', CAST(c_custkey AS VARCHAR), list_filter([CASE WHEN c_custkey%3=2 THEN 'invalid_cik' END], lambda x: x IS NOT NULL),
      CASE WHEN c_custkey%3=1 THEN 'missing_owner_cik' ELSE '' END FROM customer)""",
)
def v2(spark, sf_dir):
    return _identities(spark, sf_dir).select("artifact_name", "quality_id", "quality", "checks_passed", "errors", "warnings")


def _transactions_to_check(spark, sf_dir):
    part = F.col("part_no")
    return tables.lots(spark, sf_dir).select(
        F.concat_ws("-", "accession_number", F.col("line_no").cast("string"), part.cast("string"), F.col("shares").cast("int").cast("string"), "issuer_cik").alias("transaction_id"),
        F.when(part % 9 == 0, "Q").otherwise(F.col("transaction_code")).alias("transaction_code"),
        F.when(part % 10 == 0, "X").otherwise(F.col("acquired_disposed_code")).alias("acquired_disposed_code"),
        F.col("transaction_date").cast("string").alias("transaction_date"),
        F.when(part % 12 == 0, "none").otherwise(F.date_format("filing_date_raw", "yyyyMMdd")).alias("filing_date"),
        "is_qualifying_purchase", "is_non_derivative", "shares", "price_per_share",
        F.when(part % 14 == 0, F.lit(0.0)).otherwise(F.col("reported_value")).alias("reported_value"),
        F.when(part % 15 == 0, -F.col("shares_owned_after")).otherwise(F.col("shares_owned_after")).alias("shares_owned_after"),
    )


_TX_CHECK = """SELECT 'transactions' AS artifact_name, tid AS record_id, CASE WHEN len(e)>0 THEN 'unusable' WHEN len(w)>0 THEN 'limited' ELSE 'high' END AS quality, CAST(greatest(8-len(e)-len(w),0) AS INTEGER) AS checks_passed,
 array_to_string(e,'|') AS errors, array_to_string(w,'|') AS warnings FROM (SELECT concat_ws('-',accession_number,line_no,part_no,CAST(shares AS INTEGER),issuer_cik) AS tid,
 list_filter([CASE WHEN part_no%10=0 THEN 'invalid_acquired_disposed_code' END, CASE WHEN part_no%12=0 THEN 'invalid_filing_date' END,
  CASE WHEN is_qualifying_purchase AND part_no%14=0 THEN 'invalid_reported_value' END,
  CASE WHEN is_qualifying_purchase AND (part_no%9=0 OR part_no%10=0) THEN 'qualifying_rule_mismatch' END, CASE WHEN part_no%15=0 THEN 'negative_holdings_after' END], lambda x: x IS NOT NULL) AS e,
 list_filter([CASE WHEN part_no%9=0 THEN 'unknown_transaction_code' END, CASE WHEN part_no%12<>0 AND transaction_date>filing_date_raw THEN 'transaction_after_filing' END], lambda x: x IS NOT NULL) AS w FROM lots)"""


@query("v3_v5_transaction_checks", _TX_CHECK, ("lots",))
def v3(spark, sf_dir):
    return quality.check_transactions(_transactions_to_check(spark, sf_dir)).select(
        "artifact_name", "record_id", "quality", "checks_passed", "errors", "warnings"
    )


@query(
    "v4_price_checks",
    """SELECT ticker, rows, CASE WHEN len(e)>0 THEN 'unusable' WHEN len(w)>0 THEN 'limited' ELSE 'high' END AS quality, array_to_string(e,'|') AS errors, array_to_string(w,'|') AS warnings FROM (
     SELECT ticker, rows, list_filter([CASE WHEN k%4=0 THEN 'duplicate_dates' END, CASE WHEN k%5=0 THEN 'nonfinite_adj_close' END, CASE WHEN k%7=0 THEN 'negative_volume' END,
      CASE WHEN k%6=0 THEN 'ohlc_inconsistent' END], lambda x: x IS NOT NULL) AS e,
      list_filter([CASE WHEN k%3=0 AND days>1 THEN 'unsorted_dates' END, CASE WHEN k%8=0 THEN 'ticker_inconsistent' END, CASE WHEN DATE '2001-11-15'-newest>10 THEN 'stale' END,
       CASE WHEN rows<252 THEN 'limited_history' END], lambda x: x IS NOT NULL) AS w FROM (
      SELECT ticker, CAST(substr(ticker,2) AS BIGINT) AS k, count(*)+CASE WHEN CAST(substr(ticker,2) AS BIGINT)%4=0 THEN count(*) ELSE 0 END AS rows, count(DISTINCT date) AS days, max(date) AS newest FROM prices GROUP BY 1))""",
    ("prices",),
)
def v4(spark, sf_dir):
    key = F.substring("ticker", 2, 20).cast("bigint")
    base = tables.prices(spark, sf_dir).withColumns({"file_ticker": F.col("ticker"), "k": key, "load_no": F.unix_date("date")})
    base = base.withColumns(
        {
            "load_no": F.when(F.col("k") % 3 == 0, -F.col("load_no")).otherwise(F.col("load_no")),
            "adj_close": F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.col("adj_close")),
            "volume": F.when(F.col("k") % 7 == 0, -F.col("volume")).otherwise(F.col("volume")),
            "high": F.when(F.col("k") % 6 == 0, F.col("low") - 1).otherwise(F.col("high")),
            "ticker": F.when(F.col("k") % 8 == 0, F.lit("OTHER")).otherwise(F.col("ticker")),
        }
    )
    twice = base.unionByName(base.filter("k % 4 = 0"))
    return quality.check_prices(twice, "2001-11-15")


@query(
    "v6_validation_summary",
    f"""SELECT artifact_name, count(*) AS records, sum(CASE WHEN quality='unusable' THEN 1 ELSE 0 END)::BIGINT AS unusable FROM (
     SELECT artifact_name, quality FROM ({_FILING_CHECK}) UNION ALL SELECT artifact_name, quality FROM ({_TX_CHECK})) GROUP BY 1""",
    ("lots",),
)
def v6(spark, sf_dir):
    return quality.quality_summary(
        quality.check_filings(_filings_to_check(spark, sf_dir)), quality.check_transactions(_transactions_to_check(spark, sf_dir))
    )


@query(
    "a24_outstanding_warnings",
    f"""SELECT artifact_name, sum(CASE WHEN warnings<>'' THEN 1 ELSE 0 END)::BIGINT AS outstanding_warnings FROM ({_TX_CHECK}) GROUP BY 1""",
    ("lots",),
)
def a24_warnings(spark, sf_dir):
    return activity.outstanding_warnings(quality.check_transactions(_transactions_to_check(spark, sf_dir)))


@query(
    "v8_thresholds",
    """SELECT 'nation '||s_nationkey AS name, coalesce(min(CASE WHEN s_acctbal>0 THEN s_acctbal END)>=0,true) AND coalesce(max(s_acctbal)>=0,true) AND coalesce(min(CASE WHEN s_acctbal>0 THEN s_acctbal END)<max(s_acctbal),true) AS valid FROM supplier GROUP BY s_nationkey
    UNION ALL SELECT 'supplier '||s_suppkey, s_acctbal>=0 FROM supplier""",
)
def v8_thresholds(spark, sf_dir):
    """Balances as limits: their range by nation, and each alone, with no upper limit."""
    supplier, balance = tables.raw(spark, sf_dir, "supplier"), F.col("s_acctbal")
    ranges = supplier.groupBy(F.concat(F.lit("nation "), "s_nationkey").alias("name")).agg(F.min(F.when(balance > 0, balance)).alias("low"), F.max(balance).alias("high"))
    single = supplier.select(F.concat(F.lit("supplier "), "s_suppkey").alias("name"), balance.alias("low"), F.lit(None).cast("double").alias("high"))
    return quality.check_thresholds(ranges.unionByName(single))


@query(
    "v7_contract_check",
    """SELECT unnest(['missing_event_id','missing_issuer_cik','missing_transaction_date','missing_purchase_value','unknown_quality','bad_schema_version']) AS rule,
     unnest([0, sum(CASE WHEN lot_count>1 THEN 1 ELSE 0 END), 0, sum(CASE WHEN total_shares<3 THEN 1 ELSE 0 END), sum(CASE WHEN total_shares>=49 THEN 1 ELSE 0 END), sum(CASE WHEN direct_indirect_code='I' THEN 1 ELSE 0 END)])::BIGINT AS violations FROM pe""",
    ("pe",),
)
def v7(spark, sf_dir):
    rows = tables.events(spark, sf_dir).withColumns(
        {
            "issuer_cik": F.when(F.col("lot_count") > 1, "").otherwise(F.col("issuer_cik")),
            "purchase_value": F.when(F.col("total_shares") >= 3, F.col("purchase_value")),
            "quality": F.when(F.col("total_shares") >= 49, "fine").otherwise(F.col("event_quality")),
            "schema_version": F.when(F.col("direct_indirect_code") == "I", "1.0").otherwise("v1.2"),
        }
    )
    return quality.check_contract(rows, quality.REQUIRED_FIELDS["purchase_events"])


@query(
    "v8_weight_groups",
    """SELECT weight_group, count(*) AS members, round(sum(weight),6) AS total, abs(sum(weight)-1)<1e-9 AND min(weight)>=0 AND max(weight)<=1 AS valid FROM (
     SELECT 'region '||n_regionkey AS weight_group, count(*)*1e0/sum(count(*)) OVER (PARTITION BY n_regionkey) AS weight FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY n_regionkey, n_nationkey
     UNION ALL SELECT 'raw '||n_regionkey, count(*)*1e0 FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY n_regionkey, n_nationkey) GROUP BY 1""",
)
def v8(spark, sf_dir):
    customers = tables.raw(spark, sf_dir, "customer").join(tables.raw(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = customers.groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = counts.groupBy("n_regionkey").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "n_regionkey").select(
        F.concat(F.lit("region "), "n_regionkey").alias("weight_group"), F.col("n_nationkey").cast("string").alias("name"), (F.col("n") / F.col("all")).alias("weight")
    )
    raw = counts.select(F.concat(F.lit("raw "), "n_regionkey").alias("weight_group"), F.col("n_nationkey").cast("string").alias("name"), F.col("n").alias("weight"))
    return quality.check_weights(shares.unionByName(raw))


# --- scalar families --------------------------------------------------------------------------------------------

@query(
    "s1_clean_name",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(
      trim(regexp_replace(replace(text, ',', ' '), '\\s+', ' ', 'g')), '(\\p{L}+|\\P{L}+)', 1), lambda x: CASE WHEN x[1]='ß' THEN 'Ss' ELSE upper(x[1]) END||lower(x[2:])), '') AS name
    FROM documents""",
)
def s1(spark, sf_dir):
    return tables.raw(spark, sf_dir, "documents").select("doc_id", text.clean_name(F.col("text")).alias("name"))


@query(
    "s2_stable_id",
    f"SELECT o_orderkey, {sid('o_orderkey', 'o_orderstatus', 'o_orderpriority')} AS stable_id FROM orders",
)
def s2(spark, sf_dir):
    return tables.raw(spark, sf_dir, "orders").select(
        "o_orderkey", identity.stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("stable_id")
    )


@query(
    "s3_parse_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey%6<4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def s3(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    shown = pick(
        F.col("o_orderkey"), F.date_format(day, "yyyyMMdd"), day.cast("string"), F.concat(day.cast("string"), F.lit("T08:30:00+00:00")),
        F.concat(F.lit(" "), day.cast("string"), F.lit(" ")), F.lit("20011399"), F.lit("not a date"),
    )
    return tables.raw(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(shown).alias("day"))


def _symbols(spark, sf_dir):
    key = F.col("p_partkey")
    word = F.upper(F.regexp_replace("p_name", " ", ""))
    short = F.concat(F.substring(word, 1, 3), key.cast("string"))
    return tables.raw(spark, sf_dir, "part").select(
        "p_partkey",
        pick(key, short, F.concat(F.lit("("), F.lower(short), F.lit(")")), F.concat(short, F.lit(".B")), F.concat(short, F.lit("/A")), F.lit("N/A"), key.cast("string"),
             F.concat(F.lit(" $"), short), F.concat(short, F.lit("LONGERTHANALLOWED"))).alias("symbol"),
    )


_SHORT = "upper(substr(replace(p_name,' ',''),1,3))||p_partkey"


@query(
    "s4_symbols",
    f"""SELECT p_partkey, {pick_sql('p_partkey', _SHORT, _SHORT, _SHORT + "||'.B'", _SHORT + "||'/A'", "''", "''", "''", "''")} AS filing_symbol,
     {pick_sql('p_partkey', _SHORT, _SHORT, _SHORT + "||'-B'", _SHORT + "||'-A'", "''", "''", "''", "''")} AS market_symbol,
     {pick_sql('p_partkey', _SHORT, _SHORT, _SHORT + "||'-B'", _SHORT + "||'-A'", "''", "''", _SHORT, "''")} AS price_symbol FROM part""",
)
def s4(spark, sf_dir):
    s = F.col("symbol")
    return _symbols(spark, sf_dir).select(
        "p_partkey", text.filing_symbol(s).alias("filing_symbol"), text.market_symbol(s).alias("market_symbol"), text.price_symbol(s).alias("price_symbol")
    )


@query("s5_symbol_list", "SELECT DISTINCT upper(p_brand) AS symbol FROM part WHERE p_partkey%3<>0")
def s5(spark, sf_dir):
    symbols = tables.raw(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit(" "), F.upper("p_brand"))).alias("symbol")
    )
    return table_source.symbol_list(symbols, "symbol")


_ROLE_TITLE = "CASE WHEN p_size%2=0 THEN 'Former  ' ELSE '' END || CASE p_type WHEN 'ECONOMY' THEN 'Interim CEO & Director' WHEN 'STANDARD' THEN 'Senior Vice President' WHEN 'PROMO' THEN 'Co-Founder, Chief Operating Officer' WHEN 'LARGE' THEN 'Executive Chairman' ELSE 'President' END"


@query(
    "s6_roles_from_title",
    f"SELECT p_partkey, array_to_string({roles_sql(_ROLE_TITLE)},'|') AS roles FROM part",
)
def s6(spark, sf_dir):
    kind = F.col("p_type")
    title = F.concat(
        F.when(F.col("p_size") % 2 == 0, "Former  ").otherwise(""),
        F.when(kind == "ECONOMY", "Interim CEO & Director").when(kind == "STANDARD", "Senior Vice President")
        .when(kind == "PROMO", "Co-Founder, Chief Operating Officer").when(kind == "LARGE", "Executive Chairman").otherwise("President"),
    )
    return tables.raw(spark, sf_dir, "part").select("p_partkey", joined(roles_from_title(title)).alias("roles"))


@query(
    "s7_tolerant_boolean",
    f"SELECT p_partkey, {pick_sql('p_partkey', 'true', 'true', 'true', 'true', 'true', 'false', 'false', 'false')} AS flag FROM part",
)
def s7(spark, sf_dir):
    shown = pick(F.col("p_partkey"), *[F.lit(x) for x in ("TRUE", " yes ", "1", "y", "t", "no", "", "2")])
    return tables.raw(spark, sf_dir, "part").select("p_partkey", text.tolerant_boolean(shown).alias("flag"))


@query(
    "s8_list_tokens",
    f"""SELECT p_partkey, {pick_sql('p_partkey', "p_brand||';'||p_type", "p_brand||';'||p_type", "replace(p_name,' ',';')", "''", "'['||p_brand")} AS tokens FROM part""",
)
def s8(spark, sf_dir):
    brand, kind = F.col("p_brand"), F.col("p_type")
    shown = pick(
        F.col("p_partkey"), F.to_json(F.array(brand, F.lit(" "), kind)), F.concat(brand, F.lit(" | |"), kind), F.regexp_replace("p_name", " ", " , "),
        F.lit("  "), F.concat(F.lit("["), brand),
    )
    return tables.raw(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tokens(shown), ";").alias("tokens"))


@query(
    "s9_safe_number",
    f"SELECT p_partkey, {pick_sql('p_partkey', 'p_retailprice', '0e0', '0e0', '0e0', '0e0')} AS number FROM part",
)
def s9(spark, sf_dir):
    shown = pick(F.col("p_partkey"), F.concat(F.lit(" "), F.col("p_retailprice").cast("string")), F.lit("NaN"), F.lit("Infinity"), F.lit("abc"), F.lit(None).cast("string"))
    return tables.raw(spark, sf_dir, "part").select("p_partkey", numeric.safe_number(shown).alias("number"))


@query(
    "s10_slug",
    """SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'),'-'),''),'unknown') AS slug FROM documents""",
)
def s10(spark, sf_dir):
    return tables.raw(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    "s11_unit_hash",
    f"""SELECT o_orderkey, {r("CAST(('0x'||substr(sha256('angle:'||o_orderkey),1,16))::UBIGINT AS DOUBLE)/18446744073709551615e0", 9)} AS unit FROM orders""",
)
def s11(spark, sf_dir):
    return tables.raw(spark, sf_dir, "orders").select(
        "o_orderkey", round_to(identity.unit_hash(F.col("o_orderkey").cast("string"), "angle"), 9).alias("unit")
    )


@query(
    "s20_filing_delay",
    "SELECT accession_number, line_no, part_no, CAST(greatest(0, filing_date_raw-transaction_date) AS INTEGER) AS delay FROM lots",
    ("lots",),
)
def s20(spark, sf_dir):
    return tables.lots(spark, sf_dir).select(
        "accession_number", "line_no", "part_no", dates.filing_delay(F.col("transaction_date"), F.col("filing_date_raw")).alias("delay")
    )


_MULT = "purchase_value/100000e0"


@query(
    "s22_formatted_numbers",
    f"""SELECT event_id, {feed_money('purchase_value*100')} AS feed, {money('purchase_value*1000')} AS currency, {compact('total_shares')} AS number,
     {trimmed('total_shares/7e0', 1)}||'%' AS percent, {fixed('total_shares/7e0', 0)} AS score,
     CASE WHEN {_MULT}>=10 THEN {trimmed(_MULT, 1)} ELSE {trimmed(_MULT, 2)} END||'×' AS multiple FROM pe""",
    ("pe",),
)
def s22(spark, sf_dir):
    value, shares = F.col("purchase_value"), F.col("total_shares")
    return tables.events(spark, sf_dir).select(
        "event_id", numeric.feed_currency(value * 100).alias("feed"), numeric.currency_text(value * 1000).alias("currency"),
        numeric.number_text(shares).alias("number"), numeric.percent_text(shares / 7.0).alias("percent"), numeric.score_text(shares / 7.0).alias("score"),
        numeric.multiple_text(value / 100000.0).alias("multiple"),
    )


@query(
    "s24_scales",
    f"""SELECT event_id, {r("4+greatest(0e0,least(1e0,(purchase_value-lo)/(hi-lo)))*20")} AS linear,
     {r("4+greatest(0e0,least(1e0,(log10(greatest(purchase_value,1e0))-log10(greatest(lo,1e0)))/(log10(greatest(hi,greatest(lo,1e0)+1))-log10(greatest(lo,1e0)))))*20")} AS logarithmic FROM pe, (SELECT min(purchase_value) AS lo, max(purchase_value) AS hi FROM pe) b""",
    ("pe",),
)
def s24(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    bounds = events.agg(F.struct(F.min("purchase_value").alias("lo"), F.max("purchase_value").alias("hi")).alias("b")).scalar()
    placed = events.select("event_id", "purchase_value", bounds.alias("b"))
    value, low, high = F.col("purchase_value"), F.col("b.lo"), F.col("b.hi")
    return placed.select(
        "event_id", round_to(numeric.scale_linear(value, low, high, 4.0, 24.0), 6).alias("linear"),
        round_to(numeric.scale_log(value, low, high, 4.0, 24.0), 6).alias("logarithmic"),
    )


@query(
    "s26_first_text",
    """SELECT doc_id, CASE doc_id%4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN trim(text, ' ') ELSE 'Unclassified' END AS chosen FROM documents""",
)
def s26(spark, sf_dir):
    key = F.col("doc_id")
    return tables.raw(spark, sf_dir, "documents").select(
        "doc_id",
        text.first_text(
            F.when(key % 4 == 0, F.concat(F.lit(" "), "source")).when(key % 4 == 1, F.lit("None")), F.when(key % 4 == 1, F.col("lang")).otherwise(F.lit(" nan")),
            F.when(key % 4 == 2, F.col("text")), fallback="Unclassified",
        ).alias("chosen"),
    )


@query(
    "s28_lineage",
    """SELECT accession_number, '{"parser_version":"v1","source_identifier":"'||accession_number||'","source_path":"filings/'||accession_number||'","source_sha256":"","source_type":"sec_xml"}' AS source_lineage
    FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR),10,'0') AS accession_number FROM orders)""",
)
def s28(spark, sf_dir):
    orders = tables.raw(spark, sf_dir, "orders").select(tables.padded("o_orderkey").alias("accession_number"))
    accession = F.col("accession_number")
    return orders.select("accession_number", F.to_json(identity.lineage("sec_xml", F.concat(F.lit("filings/"), accession), accession)).alias("source_lineage"))


@query(
    "s29_schema_versions",
    """SELECT p_partkey, CASE WHEN p_partkey%3<2 THEN CAST(p_size%4 AS INTEGER) END AS major, CASE WHEN p_partkey%3=0 THEN CAST(p_partkey%5 AS INTEGER) WHEN p_partkey%3=1 THEN 0 END AS minor,
     CASE WHEN p_partkey%3<2 THEN p_size%4=1 AND CASE WHEN p_partkey%3=0 THEN p_partkey%5 ELSE 0 END<=2 END AS readable FROM part""",
)
def s29(spark, sf_dir):
    major, minor = (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 5).cast("string")
    shown = pick(F.col("p_partkey"), F.concat(F.lit("v"), major, F.lit("."), minor), F.concat(F.lit(" v"), major, F.lit(" ")), F.concat(major, F.lit("."), minor))
    return tables.raw(spark, sf_dir, "part").select(
        "p_partkey", identity.version_part(shown, 1).alias("major"), identity.version_part(shown, 2).alias("minor"),
        identity.version_readable(F.lit("v1.2"), shown).alias("readable"),
    )


# --- set operations ---------------------------------------------------------------------------------------------

@query(
    "u1_union_all",
    "SELECT 'lot' AS kind, issuer_cik, shares, CAST(NULL AS DOUBLE) AS purchase_value FROM lots UNION ALL SELECT 'event', issuer_cik, NULL, purchase_value FROM pe",
    ("lots", "pe"),
)
def u1(spark, sf_dir):
    lots = tables.lots(spark, sf_dir).select(F.lit("lot").alias("kind"), "issuer_cik", "shares")
    events = tables.events(spark, sf_dir).select(F.lit("event").alias("kind"), "issuer_cik", "purchase_value")
    return lots.unionByName(events, allowMissingColumns=True)


@query(
    "u2_u3_role_sets",
    """SELECT issuer_cik, insider_id, array_to_string(list_sort(roles),'|') AS roles, list_has_any(roles, ['ceo','cfo','coo','president','operating_executive']) AS operating,
     list_has_all(roles, ['founder','ceo']) AS founder_ceo FROM (SELECT issuer_cik, insider_id, list_distinct(flatten(list(normalized_roles))) AS roles FROM pe GROUP BY 1,2)""",
    ("pe",),
)
def u2(spark, sf_dir):
    grouped = tables.events(spark, sf_dir).groupBy("issuer_cik", "insider_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("normalized_roles")))).alias("_r")
    )
    roles = F.col("_r")
    return grouped.select(
        "issuer_cik", "insider_id", joined(roles).alias("roles"),
        F.arrays_overlap(roles, F.array(*map(F.lit, params.OPERATING_ROLES))).alias("operating"),
        (F.size(F.array_except(F.array(F.lit("founder"), F.lit("ceo")), roles)) == 0).alias("founder_ceo"),
    )
