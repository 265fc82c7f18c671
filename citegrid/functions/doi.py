"""Column expressions that detect and repair faults in DOI strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolver spellings that are removed wherever they occur. The dots are
# pattern dots and the second spelling keeps its slash, which the slash rule removes.
RESOLVERS = r"https://doi.org/|http://doi.org|http://dx.doi.org/"

# Prefixes of registration-agency test accounts.
TEST_PREFIXES = (
    "10.5555", "10.88888", "10.30444", "10.30446", "10.30447",
    "10.30448", "10.30449", "10.50505", "10.30443",
)

# Fixed value: identifiers whose prefix runs on with dots where a slash belongs.
DOTTED_STRUCTURE = r"^10\.\d+\.\d+\.\d+"

# Fixed value: the label is anchored in upper case only.
LABEL = r"^DOI:|doi:"


def has_resolver(doi: Column) -> Column:
    return doi.startswith("https://doi.org/") | doi.startswith("http://doi.org/")


def has_scheme(doi: Column) -> Column:
    return doi.startswith("https:") | doi.startswith("http:")


def strip_resolver(doi: Column) -> Column:
    return F.regexp_replace(doi, RESOLVERS, "")


def has_encoded_slash(doi: Column) -> Column:
    return doi.contains("%2F")


def decode_slash(doi: Column) -> Column:
    return F.replace(doi, F.lit("%2F"), F.lit("/"))


def ends_with_period(doi: Column) -> Column:
    return doi.endswith(".")


def strip_periods(doi: Column) -> Column:
    return F.rtrim(doi, F.lit("."))


def has_outer_slash(doi: Column) -> Column:
    return doi.startswith("/") | doi.endswith("/")


def has_space(doi: Column) -> Column:
    return doi.contains(" ")


def strip_leading_slashes(doi: Column) -> Column:
    """Only leading slashes go; a trailing one may belong to the identifier."""
    return F.ltrim(doi, F.lit("/"))


def is_not_available(doi: Column) -> Column:
    return doi.startswith("NA") | doi.startswith("NF")


def null_if_not_found(doi: Column) -> Column:
    return F.nullif(doi, F.lit("NF"))


def has_dotted_structure(doi: Column) -> Column:
    return doi.rlike(DOTTED_STRUCTURE)


def has_test_prefix(doi: Column, strict: bool = False) -> Column:
    """By default the prefixes match anywhere with pattern dots; strict anchors them."""
    if strict:
        return doi.rlike("^(" + "|".join(p.replace(".", r"\.") for p in TEST_PREFIXES) + ")/")
    return doi.rlike("|".join(TEST_PREFIXES))


def has_label(doi: Column) -> Column:
    return doi.rlike(LABEL)


def strip_label(doi: Column) -> Column:
    return F.regexp_replace(doi, LABEL, "")


def has_two_dois(doi: Column) -> Column:
    """A second ``10.<digits>/`` behind the first one."""
    return doi.rlike(r"10\.\d{4,9}/.*10\.\d{4,9}/")


def strip_resolver_prefix(doi: Column) -> Column:
    """Bare identifier from a resolver link."""
    return F.regexp_replace(doi, r"^https://doi\.org/", "")


def repair(doi: Column) -> Column:
    """The textual repairs before overrides: resolver, ``%2F``, periods, leading slashes."""
    return strip_leading_slashes(strip_periods(decode_slash(strip_resolver(doi))))
