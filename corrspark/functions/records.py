"""Scalar accessors and labels over identifiers, CVSS blobs and ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corrspark import lexicon

# Fixed value: a well-formed CVE identifier.
CVE_ID = r"^CVE-\d{4}-\d{4,7}$"
NVD_URL = "https://nvd.nist.gov/vuln/detail/"
CAPEC_URL = "https://capec.mitre.org/data/definitions/"


def is_cve_id(col: Column) -> Column:
    return F.coalesce(col.rlike(CVE_ID), F.lit(False))


def cve_year(col: Column) -> Column:
    return F.split_part(col, F.lit("-"), F.lit(2)).try_cast("int")


def cve_key(col: Column) -> tuple[Column, Column]:
    """(year, number) of an id; null when it does not parse."""
    pattern = r"^CVE-(\d{4})-(\d+)"
    return F.regexp_extract(col, pattern, 1).try_cast("int"), F.regexp_extract(col, pattern, 2).try_cast("long")


def cve_sort_key(col: Column) -> list[Column]:
    """Year then number; ids that do not parse sort last."""
    return [part.asc_nulls_last() for part in cve_key(col)]


def capec_number(col: Column) -> Column:
    return F.regexp_extract(col, r"^CAPEC-(\d+)", 1).try_cast("int")


def summary(col: Column, length: int = 100) -> Column:
    return F.when(F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit("..."))).otherwise(col)


def is_valid_record(description: Column) -> Column:
    return ~F.startswith(description, F.lit("Rejected reason"))


def is_rated(impact_v2: Column, impact_v3: Column) -> Column:
    return impact_v2.isNotNull() | impact_v3.isNotNull()


def is_active(status: Column) -> Column:
    """Not deprecated; a null status counts as active."""
    return ~status.eqNullSafe(F.lit("Deprecated"))


# The default text of each CVSS v3 accessor.
CVSS_V3_DEFAULTS = {
    "vectorString": "No vector string available.",
    "attackVector": "No attack vector available.",
    "attackComplexity": "No attack complexity available.",
    "privilegesRequired": "No privileges required information available.",
    "userInteraction": "No user interaction information available.",
    "scope": "No scope information available.",
    "confidentialityImpact": "No confidentiality impact information available.",
    "integrityImpact": "No integrity impact information available.",
    "availabilityImpact": "No availability impact information available.",
    "baseScore": "No base score available.",
    "baseSeverity": "No base severity information available.",
}
CVSS_V2_KEYS = (
    "vectorString", "accessVector", "accessComplexity", "authentication",
    "confidentialityImpact", "integrityImpact", "availabilityImpact", "baseScore",
)


def cvss_v2(impact: Column, key: str) -> Column:
    return F.coalesce(impact["cvssV2"][key].cast("string"), F.lit("N/A"))


def cvss_v3(impact: Column, key: str) -> Column:
    value = F.coalesce(impact["cvssV3"][key].cast("string"), F.lit(CVSS_V3_DEFAULTS[key]))
    return F.when(impact["cvssV3"].isNull(), "Impact V3 data is not available.").otherwise(value)


def cvss_v3_info(impact: Column, key: str) -> Column:
    return F.coalesce(impact["cvssV3"][key].cast("string"), F.lit("N/A"))


def severity(score: Column) -> Column:
    """Bucket of a base score; scores in the gaps between ranges have none."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(lexicon.SEVERITY_RANGES):
        label = F.when(score.between(low, high), name).otherwise(label)
    return label


def overall_severity(impact_v2: Column, impact_v3: Column) -> Column:
    """The v3 rating when v3 data exists, else the v2 rating, else null."""
    v2, v3 = impact_v2["cvssV2"], impact_v3["cvssV3"]
    return F.when(v3.isNotNull(), severity(v3["baseScore"])).when(v2.isNotNull(), severity(v2["baseScore"]))


def nvd_link(cve_id: Column) -> Column:
    return F.concat(F.lit(NVD_URL), cve_id)


def capec_link(capec_id: Column) -> Column:
    number = F.element_at(F.split(capec_id, "-"), -1)
    return F.when(F.startswith(capec_id, F.lit("CAPEC-")), F.concat(F.lit(CAPEC_URL), number, F.lit(".html")))


def rank_colour(rank: Column, top: int = 10) -> Column:
    return (
        F.when(rank == 1, "dark green")
        .when((rank > 1) & (rank <= top), "light green")
        .when((rank > top) & (rank <= 30), "yellow")
        .when((rank > 30) & (rank <= 50), "orange")
        .when(rank > 50, "red")
    )


def edge_colour(rank: Column) -> Column:
    return (
        F.when(rank == 1, "gold")
        .when(rank.between(2, 5), "darkgreen")
        .when(rank.between(6, 10), "lightgreen")
        .when(rank.between(11, 20), "orange")
        .otherwise("red")
    )


def facet_match(cols: list[Column], query: str) -> Column:
    """Case-insensitive contains over any of several columns."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(F.contains(F.lower(col.cast("string")), needle), F.lit(False))
    return hit
