"""Ownership filings: XML out of submission texts, and XML documents to nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Only the elements the tables need; attributes come as _id. Forms wrap most element values in <value>; where they do not,
# the value is the element's own text.
_VALUE = "struct<value:string,_VALUE:string>"
_LOT = (
    "struct<"
    f"securityTitle:{_VALUE},transactionDate:{_VALUE},deemedExecutionDate:{_VALUE},"
    f"transactionCoding:struct<transactionCode:string,transactionFormType:string,equitySwapInvolved:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>,"
    f"ownershipNature:struct<directOrIndirectOwnership:{_VALUE},natureOfOwnership:{_VALUE}>,"
    f"conversionOrExercisePrice:{_VALUE},exerciseDate:{_VALUE},expirationDate:{_VALUE},"
    f"underlyingSecurity:struct<underlyingSecurityTitle:{_VALUE},underlyingSecurityShares:{_VALUE}>>"
)
# The same lots as semi-structured values, with whatever elements they have.
ANY_SCHEMA = "nonDerivativeTable struct<nonDerivativeTransaction:array<variant>>, derivativeTable struct<derivativeTransaction:array<variant>>"
DOCUMENT_SCHEMA = (
    "documentType string, periodOfReport string, remarks string,"
    " issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>,"
    " reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,isOther:string,officerTitle:string,otherText:string>>>,"
    f" nonDerivativeTable struct<nonDerivativeTransaction:array<{_LOT}>>,"
    f" derivativeTable struct<derivativeTransaction:array<{_LOT}>>,"
    " footnotes struct<footnote:array<struct<_id:string,_VALUE:string>>>,"
    " _corrupt_record string"
)


def extract_block(text: Column, tag: str, root: str) -> Column:
    """First ``<tag>`` block that holds the root element; else the text from the root element to its last end.

    ``root`` may carry a namespace prefix inside a block.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    held = F.filter(blocks, lambda b: b.contains(f"<{root}") | b.contains(f":{root}"))
    block = F.trim(F.try_element_at(held, F.lit(1)), F.lit(" \n\r\t"))
    start = F.coalesce(F.nullif(F.locate("<?xml", text), F.lit(0)), F.nullif(F.locate(f"<{root}", text), F.lit(0)))
    end_tag = f"</{root}>"
    # Last end of the root element: everything up to it, matched greedily.
    upto = F.regexp_extract(text, rf"(?s)^(.*{end_tag})", 1)
    rest = F.when(
        text.contains(f"<{root}") & text.contains(end_tag), F.substr(upto, start, F.length(upto))
    )
    return F.coalesce(block, rest)


def flag(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit("")))).isin("1", "true", "yes", "y")


def footnote_refs(lot: Column) -> Column:
    """Ids that any element inside a semi-structured lot refers to, sorted, each once."""
    references = F.regexp_extract_all(F.to_json(lot), F.lit(r'"footnoteId":(\[[^\]]*\]|\{[^}]*\})'), F.lit(1))
    ids = F.flatten(F.transform(references, lambda r: F.regexp_extract_all(r, F.lit(r'"_id":"?([^",}\]]*)'), F.lit(1))))
    return F.coalesce(F.array_sort(F.array_distinct(ids)), F.array().cast("array<string>"))


def _lots(items: Column, anything: Column, non_derivative: bool) -> Column:
    def one(lot: Column, place: Column) -> Column:
        def text(path: str) -> Column:
            node = lot
            for part in path.split("."):
                if part == "value":
                    node = F.coalesce(node["value"], node["_VALUE"])
                else:
                    node = node[part]
            return F.trim(node)

        def number(path: str) -> Column:
            return text(path).try_cast("double")

        def term(value: Column, kind: str) -> Column:
            return F.lit(None).cast(kind) if non_derivative else value

        return F.struct(
            (place + 1).alias("sequence"),
            text("securityTitle.value").alias("security_title"),
            text("transactionDate.value").alias("transaction_date"),
            text("deemedExecutionDate.value").alias("deemed_execution_date"),
            text("transactionCoding.transactionCode").alias("transaction_code"),
            text("transactionCoding.transactionFormType").alias("transaction_form_type"),
            flag(lot["transactionCoding"]["equitySwapInvolved"]).alias("equity_swap_involved"),
            number("transactionAmounts.transactionShares.value").alias("shares"),
            number("transactionAmounts.transactionPricePerShare.value").alias("price_per_share"),
            text("transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed_code"),
            number("postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("shares_owned_after"),
            text("ownershipNature.directOrIndirectOwnership.value").alias("direct_indirect_code"),
            text("ownershipNature.natureOfOwnership.value").alias("nature_of_ownership"),
            footnote_refs(F.get(anything, place)).alias("footnote_refs"),
            F.lit(non_derivative).alias("is_non_derivative"),
            term(number("conversionOrExercisePrice.value"), "double").alias("conversion_price"),
            term(text("exerciseDate.value"), "string").alias("exercise_date"),
            term(text("expirationDate.value"), "string").alias("expiration_date"),
            term(text("underlyingSecurity.underlyingSecurityTitle.value"), "string").alias("underlying_security_title"),
            term(number("underlyingSecurity.underlyingSecurityShares.value"), "double").alias("underlying_shares"),
        )

    return F.coalesce(F.transform(items, one), F.array().cast(_LOT_ROW))


_LOT_ROW = (
    "array<struct<sequence:int,security_title:string,transaction_date:string,deemed_execution_date:string,transaction_code:string,"
    "transaction_form_type:string,equity_swap_involved:boolean,shares:double,price_per_share:double,acquired_disposed_code:string,"
    "shares_owned_after:double,direct_indirect_code:string,nature_of_ownership:string,footnote_refs:array<string>,is_non_derivative:boolean,"
    "conversion_price:double,exercise_date:string,expiration_date:string,underlying_security_title:string,underlying_shares:double>>"
)


def parse_documents(documents: DataFrame) -> DataFrame:
    """Nested rows from a table of documents (xml, accession_number, filing_date, path and, if known, accepted_at).

    Values come from a typed reading, which keeps texts as they are; references to footnotes from a semi-structured one,
    so an element that no table asks for still counts.

    Namespaces are ignored; a document that cannot be read keeps its row with a quality flag and no lots.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    doc = F.col("_doc")
    accepted = F.col("accepted_at") if "accepted_at" in documents.columns else F.lit("")
    read = documents.withColumns({"_doc": F.from_xml("xml", DOCUMENT_SCHEMA, options), "_any": F.from_xml("xml", ANY_SCHEMA, options), "_accepted": accepted})
    anything = F.col("_any")
    broken = doc["_corrupt_record"].isNotNull() | doc.isNull()
    owners = F.transform(
        F.coalesce(doc["reportingOwner"], F.array()),
        lambda o: F.struct(
            F.lpad(F.coalesce(F.trim(o["reportingOwnerId"]["rptOwnerCik"]), F.lit("")), 10, "0").alias("owner_cik"),
            F.trim(o["reportingOwnerId"]["rptOwnerName"]).alias("owner_name"),
            flag(o["reportingOwnerRelationship"]["isDirector"]).alias("is_director"),
            flag(o["reportingOwnerRelationship"]["isOfficer"]).alias("is_officer"),
            flag(o["reportingOwnerRelationship"]["isTenPercentOwner"]).alias("is_ten_percent_owner"),
            flag(o["reportingOwnerRelationship"]["isOther"]).alias("is_other"),
            F.trim(o["reportingOwnerRelationship"]["officerTitle"]).alias("officer_title"),
            F.trim(o["reportingOwnerRelationship"]["otherText"]).alias("other_text"),
        ),
    )
    form = F.trim(doc["documentType"])
    notes = F.transform(
        F.coalesce(doc["footnotes"]["footnote"], F.array()), lambda n: F.struct(n["_id"].alias("id"), F.trim(n["_VALUE"]).alias("text"))
    )
    lots = F.concat(
        _lots(doc["nonDerivativeTable"]["nonDerivativeTransaction"], anything["nonDerivativeTable"]["nonDerivativeTransaction"], True),
        _lots(doc["derivativeTable"]["derivativeTransaction"], anything["derivativeTable"]["derivativeTransaction"], False),
    )
    return read.select(
        "accession_number",
        "filing_date",
        "path",
        form.alias("document_type"),
        F.trim(doc["periodOfReport"]).alias("period_of_report"),
        (form == "4/A").alias("is_amendment"),
        F.col("_accepted").cast("string").alias("accepted_at"),
        F.coalesce(F.trim(doc["remarks"]), F.lit("")).alias("amendment_description"),
        F.when(~broken, F.lpad(F.coalesce(F.trim(doc["issuer"]["issuerCik"]), F.lit("")), 10, "0")).alias("issuer_cik"),
        F.trim(doc["issuer"]["issuerName"]).alias("issuer_name"),
        F.trim(doc["issuer"]["issuerTradingSymbol"]).alias("ticker"),
        owners.alias("owners"),
        F.when(~broken, lots).otherwise(F.array().cast(_LOT_ROW)).alias("lots"),
        notes.alias("footnotes"),
        F.when(broken, F.array(F.lit("malformed_xml"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )
