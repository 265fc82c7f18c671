"""Column expressions over nested metadata records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def unnest(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Fields of a struct as columns, optionally prefixed; a null struct gives nulls."""
    kind = df.schema[column].dataType
    if not isinstance(kind, StructType):
        raise TypeError(f"{column} is not a struct")
    return df.select("*", *[F.col(f"{column}.{f.name}").alias(prefix + f.name) for f in kind.fields])


def author_names(authorships: Column) -> Column:
    names = F.transform(authorships, lambda a: a["author"]["display_name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def institutions(authorships: Column, last_only: bool = False) -> Column:
    """``(display_name, ror)`` of named institutions, all or the last of each author."""
    if last_only:
        picked = F.transform(authorships, lambda a: F.try_element_at(a["institutions"], F.lit(-1)))
    else:
        picked = F.flatten(F.transform(authorships, lambda a: a["institutions"]))
    return F.filter(picked, lambda i: i["display_name"].isNotNull() & (i["display_name"] != ""))


def abstract_text(inverted_index: Column) -> Column:
    """Text from ``{word: [positions]}``."""
    placed = F.flatten(F.transform(
        F.map_entries(inverted_index),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
    ))
    return F.array_join(F.transform(F.array_sort(placed), lambda z: z["w"]), " ")


def first_display_name(records: Column) -> Column:
    return F.get(records, F.lit(0))["display_name"]


def display_names(records: Column) -> Column:
    return F.transform(records, lambda r: r["display_name"])


def keywords_long(df: DataFrame, key: str = "id", column: str = "keywords") -> DataFrame:
    return df.select(key, F.posexplode_outer(display_names(F.col(column))).alias("pos", "keyword"))


def keywords_wide(df: DataFrame, width: int | None = None, key: str = "id", column: str = "keywords") -> DataFrame:
    """One column per keyword position; without a ``width`` as many as the longest list has.

    A list longer than a given width is an error, so no keyword is lost.
    """
    names = display_names(F.col(column))
    if width is not None:
        names = F.when(F.size(column) > width, F.raise_error(F.lit(f"more than {width} keywords"))).otherwise(names)
    if width is None:
        width = df.select(F.max(F.size(column))).first()[0] or 0
    return df.select(key, *[F.get(names, F.lit(i)).alias(f"keyword_{i}") for i in range(width)])


def records_to_columns(df: DataFrame, column: str, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """One row per record of a list, its fields as columns beside the key and its position."""
    return df.select(key, F.posexplode(F.col(column)).alias("pos", "record")).select(
        key, "pos", *[F.col(f"record.{f}").alias(f) for f in fields])


def id_from_link(link: Column) -> Column:
    """Fourth ``/``-separated part of an identifier link."""
    return F.try_element_at(F.split(link, "/"), F.lit(4))


def best_location(location: Column) -> list[Column]:
    """Licence, access flag and file link; null where there is no location."""
    return [location["is_oa"].alias("is_oa"), location["license"].alias("license"),
            location["pdf_url"].alias("url")]
