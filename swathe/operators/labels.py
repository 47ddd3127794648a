"""Labels, codes, keys and row rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code, commodity, service, group.
COMMODITIES = [
    ("AA", "Anhydrous ammonia", "Transmission", "Other"),
    ("CO2", "Carbon dioxide", "Transmission", "Other"),
    ("CRO", "Crude oil", "Transmission", "Crude oil"),
    ("CRL", "Crude oil", "Gathering", "Crude oil"),
    ("CFL", "Crude full well stream", "Gathering", "Crude oil"),
    ("CRA", "Crude oil, offshore", "Offshore gathering", "Crude oil"),
    ("HVL", "Highly volatile liquid", "Transmission", "Highly volatile liquid"),
    ("NGT", "Natural gas", "Transmission", "Natural gas"),
    ("NGG", "Natural gas", "Gathering", "Natural gas"),
    ("NFG", "Natural gas, full well stream", "Gathering", "Natural gas"),
    ("NGZ", "Natural gas, offshore", "Offshore gathering", "Natural gas"),
    ("PRD", "Refined liquid product", "Transmission", "Refined product"),
    ("OGT", "Other gas", "Transmission", "Other"),
]
NO_COMMODITY = {"commodity": "Not in the RRC code list", "service": "Unknown", "commodity_group": "Unknown"}
#: Labels of status and of who regulates a line.
STATUS = {"I": "In service", "B": "Abandoned", "R": "Revoked (code not in the RRC definitions; inferred)"}
INTERSTATE = {"Y": "Interstate", "N": "Intrastate"}
#: Accuracy code, label, largest error in metres.
ACCURACY = {"E": ("Within 50 ft", 15.2), "V": ("51-300 ft", 91.4), "G": ("301-500 ft", 152.4), "P": ("501-1,000 ft", 304.8), "U": ("Unknown", None)}
#: Limits of outside diameters in inches, and the classes between them.
DIAMETERS = [4.5, 8.63, 12.75, 16.0, 24.0, 36.0]
DIAMETER_CLASSES = ["Under 4.5 in", "4.5-8.6 in", "8.6-12.75 in", "12.75-16 in", "16-24 in", "24-36 in", "Over 36 in"]


def code(c: Column) -> Column:
    return F.upper(F.trim(c))


def commodity(rows: DataFrame, column: str) -> DataFrame:
    """Labels of a code; an unknown code is kept and says so."""
    dim = rows.sparkSession.createDataFrame(COMMODITIES, "code string, commodity string, service string, commodity_group string")
    joined = rows.join(F.broadcast(dim), code(F.col(column)) == dim["code"], "left").drop("code")
    return joined.withColumns({c: F.coalesce(c, F.lit(other)) for c, other in NO_COMMODITY.items()})


def lookup(values: dict, c: Column, default: str | None = "Not recorded") -> Column:
    """Label or number of a code from a small dictionary."""
    return F.coalesce(*(F.when(code(c) == k, F.lit(v)) for k, v in values.items() if v is not None), F.lit(default))


def diameter_class(c: Column) -> Column:
    """Left-closed bins; what is no positive number is not recorded."""
    d = c.try_cast("double")
    out = F.when(d.isNull() | (d <= 0) | F.isnan(d), "Not recorded")
    for high, name in zip(DIAMETERS, DIAMETER_CLASSES, strict=False):
        out = out.when(d < high, name)
    return out.otherwise(DIAMETER_CLASSES[-1])


def fips(c: Column) -> Column:
    """State and county code; a longer text is never cut."""
    return F.concat(F.lit("48"), F.when(F.length(c) < 3, F.lpad(c, 3, "0")).otherwise(c))


def station(metres: Column) -> Column:
    """P5: engineering station of a distance, in feet."""
    feet = F.rint(metres * 3.28084).cast("long")
    return F.concat(F.floor(feet / 100).cast("string"), F.lit("+"), F.lpad((feet % 100).cast("string"), 2, "0"))


def split_zone(c: Column) -> tuple[Column, Column]:
    """Unit and ring of a zone id, cut at the last ``_r``."""
    return F.regexp_extract(c, "^(.*)_r(.*)$", 1), F.regexp_extract(c, "^(.*)_r(.*)$", 2)


def normal_id(c: Column) -> Column:
    """Number, underscore, rest."""
    return F.regexp_replace(c, r"^(\d+)[ _]", "$1_")


def slug(c: Column) -> Column:
    """P11."""
    return F.translate(F.lower(c), "/ ", "__")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Text of the first rule that fails, else empty."""
    out = F.lit("")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def spring_status(start: Column, end: Column, event: Column) -> Column:
    """P27."""
    return F.when(end < event, "before").when(start > event, "after").otherwise("during")


def utm_zone(lon: Column) -> Column:
    """P30."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def keyword_region(c: Column, keywords: list[str]) -> Column:
    """P10: the first keyword that the letters of a name hold."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.coalesce(*(F.when(letters.contains(k), k) for k in keywords), F.lit("none"))
