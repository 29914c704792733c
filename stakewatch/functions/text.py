"""Text: names, symbols, list tokens, slugs, tolerant booleans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for "no symbol" or "no value".
SYMBOL_STOP_WORDS = ["", "N/A", "NA", "NONE", "NULL", "NYSE:", "NASDAQ:", "AMEX:"]
DISPLAY_STOP_WORDS = ["NONE", "NULL", "NAN", "N/A", "NA", "UNDEFINED", "-", "."]
EMPTY_WORDS = ["nan", "none", "null", "undefined"]
TRUE_WORDS = ["true", "1", "yes", "y", "t"]


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def title_case(col: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))

    def cased_run(run: Column) -> Column:
        first = F.substring(run, 1, 1)
        capital = F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first))
        return F.concat(capital, F.lower(F.substr(run, F.lit(2))))

    cased = F.transform(runs, cased_run)
    return F.array_join(cased, "")


def clean_name(col: Column) -> Column:
    return title_case(squeeze(F.regexp_replace(F.coalesce(col, F.lit("")), ",", " ")))


def filing_symbol(col: Column) -> Column:
    """Symbol as found in a filing; empty text when it is a placeholder or malformed."""
    raw = F.regexp_replace(F.upper(F.trim(F.coalesce(col, F.lit("")))), " ", "")
    bare = F.regexp_replace(raw, r"^\((.*)\)$", "$1")
    valid = ~bare.isin(SYMBOL_STOP_WORDS) & ~bare.rlike(r"^[0-9]+$") & bare.rlike(r"^[A-Z0-9][A-Z0-9.\-/]{0,14}$")
    return F.when(valid, bare).otherwise(F.lit(""))


def market_symbol(col: Column) -> Column:
    """Filing symbol in the form used by the price files: class dots and slashes become dashes."""
    return F.regexp_replace(filing_symbol(col), r"[./]", "-")


def price_symbol(col: Column) -> Column:
    """Stricter symbol used before a price lookup (also drops ``$``)."""
    raw = F.regexp_replace(F.upper(F.trim(F.coalesce(col, F.lit("")))), r"[$ ]", "")
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\((.*)\)$", "$1"), r"[./]", "-")
    valid = (
        ~raw.isin(SYMBOL_STOP_WORDS)
        & ~bare.isin(SYMBOL_STOP_WORDS)
        & bare.rlike(r"^[A-Z0-9][A-Z0-9-]{0,14}$")
        & ~bare.rlike(r"^[0-9]+$")
    )
    return F.when(valid, bare).otherwise(F.lit(""))


def display_ticker(col: Column) -> Column:
    """Ticker fit for display, else empty."""
    raw = F.upper(usable_text(col))
    valid = raw.rlike(r"^[A-Z0-9][A-Z0-9.-]{0,14}$") & ~raw.isin(DISPLAY_STOP_WORDS)
    return F.when(valid, raw).otherwise(F.lit(""))


def usable_text(col: Column, fallback: str = "") -> Column:
    """Trimmed text, or the fallback when it is empty or a spelled-out missing value."""
    raw = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return F.when((raw == "") | F.lower(raw).isin(EMPTY_WORDS), F.lit(fallback)).otherwise(raw)


def first_text(*cols: Column, fallback: str = "") -> Column:
    """First column that holds usable text."""
    return F.coalesce(*[F.nullif(usable_text(c), F.lit("")) for c in cols], F.lit(fallback))


def tolerant_boolean(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit("")))).isin(TRUE_WORDS)


def tokens(col: Column) -> Column:
    """List kept as text: a JSON array, ``|``-separated, or comma-separated."""
    raw = F.trim(F.coalesce(col, F.lit("")))
    parts = F.when(raw.contains("|"), F.split(raw, r"\|")).otherwise(F.split(raw, ","))
    decoded = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    chosen = F.coalesce(decoded, F.transform(parts, lambda part: F.trim(part)))
    return F.filter(chosen, lambda part: F.trim(part) != "")


def slug(col: Column, fallback: str = "unknown") -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit("")), F.lit(fallback))


def joined(col: Column) -> Column:
    """Array to the delimited text of the file formats."""
    return F.array_join(col, "|")


def contains_folded(needle: str, *cols: Column) -> Column:
    """Case-blind substring search over several columns joined by blanks."""
    return F.lower(F.concat_ws(" ", *cols)).contains(needle.strip().lower())
