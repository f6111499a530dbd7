"""Text columns: numbers as people type them, labels, reference and verification numbers, display formats."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_KEYS = ("id", "external_id", "plot_id", "feature_id")
AREA_KEYS = ("asserted_area_ha", "area_ha", "asserted_area", "area")
WKT_KEYS = ("wkt", "WKT", "geom_wkt", "geometry_wkt")
LOW, HIGH, MORE = "Low", "High", "More info needed"
LABELS = (LOW, HIGH, MORE)
TIER_LABELS = {"low": LOW, "high": HIGH, "more-info-needed": MORE}
TIERS = ("low", "more-info-needed", "high")

# Accepted spellings of a label, in lower case and with single blanks.
LABEL_SPELLINGS = {
    "low": LOW,
    "low risk": LOW,
    "high": HIGH,
    "high risk": HIGH,
    "more info needed": MORE,
    "more information needed": MORE,
    "moreinfoneeded": MORE,
    "more-info-needed": MORE,
}


def first_present(properties: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that a map of text holds and that is not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(properties, F.lit(k)), F.lit("")) for k in keys])


def locale_number(text: Column) -> Column:
    """A number with decimal point or comma; empty and NaN are null, and so is what is no number (see is_bad_number)."""
    trimmed = _trimmed(text)
    dotted = F.when(F.contains(trimmed, F.lit(",")) & ~F.contains(trimmed, F.lit(".")), F.regexp_replace(trimmed, ",", ".")).otherwise(trimmed)
    value = dotted.try_cast("double")
    return F.when(~F.isnan(value), value)


def is_bad_number(text: Column) -> Column:
    """Whether a cell holds something that is no number; such rows go to a reject table."""
    trimmed = _trimmed(text)
    return F.coalesce((trimmed != "") & locale_number(text).isNull() & (F.lower(trimmed) != "nan"), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^﻿", ""))


def label(text: Column) -> Column:
    """One of the three labels; null where the spelling is not known."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.create_map(*[F.lit(x) for pair in LABEL_SPELLINGS.items() for x in pair])[key]


def tier_label(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair])[tier]


def payload_label(payload: Column) -> Column:
    """The label in a response: at the top, in data, or in the first element of data."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in ("$.Risk_PCrop", "$.data.Risk_PCrop", "$.data[0].Risk_PCrop")])


def reference_number(consignment: Column, day: Column, run_id: Column) -> Column:
    return F.concat(F.lit("EUDR-"), F.year(day).cast("string"), F.lit("-"), consignment, F.lit("-"), F.upper(F.substring(run_id, 1, 8)))


def verification_number(reference: Column, salt: str) -> Column:
    """First 32 hex digits of HMAC-SHA-256 of the reference under the salt. The key's pads are computed once, here."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, reference.cast("binary")), 256))
    return F.upper(F.substring(F.sha2(F.concat(outer, first), 256), 1, 32))


def is_pair(reference: Column, verification: Column, salt: str) -> Column:
    """Whether a verification number belongs to a reference number; false for null or empty."""
    return F.coalesce((reference != "") & (verification != "") & (verification_number(reference, salt) == verification), F.lit(False))


def hectares_text(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f ha", value), F.lit("NOT ASSESSED"))


def percent_text(fraction: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f%%", fraction * 100), F.lit("NOT ASSESSED"))


def coordinate_text(x: Column, y: Column) -> Column:
    return F.format_string("%.6f, %.6f", x / 1e6, y / 1e6)


def tier_colour(tier: Column) -> Column:
    return F.when(tier == "high", "red").when(tier == "low", "green").when(tier == "more-info-needed", "amber").otherwise("grey")
