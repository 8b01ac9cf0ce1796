"""Catalogue records of three shapes as one: title, authors, year, journal, doi.

Records are JSON text, parsed once into a VARIANT; a table of paths for each shape says where a field is. Broken JSON, and records that are no
object, give null. Missing and null fields give an empty string or list, and a null year, as do values of another type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

META = "struct<title:string,authors:array<string>,year:int,journal:string,doi:string>"


@dataclass(frozen=True)
class Shape:
    """Paths of the fields, in order of preference. authors: the list; name: a name in it; whole: whether that is a full name, whose last word counts."""

    title: tuple[str, ...]
    authors: str
    name: str
    whole: bool
    year: tuple[str, ...]
    journal: tuple[str, ...]
    doi: str


#: The fields of the catalogues' records.
SHAPES = {
    "crossref": Shape(("$.title[0]", "$.title"), "$.author", "$.family", False, tuple(f"$['{k}']['date-parts'][0][0]" for k in ("published-print", "published-online", "created")), ("$['container-title'][0]", "$['container-title']"), "$.DOI"),
    "openalex": Shape(("$.display_name", "$.title"), "$.authorships", "$.author.display_name", True, ("$.publication_year",), ("$.primary_location.source.display_name",), "$.doi"),
    "semantic_scholar": Shape(("$.title",), "$.authors", "$.name", True, ("$.year",), ("$.venue",), "$.externalIds.DOI"),
}
PREFIX = "https://doi.org/"


def _text(v: Column, path: str) -> Column:
    """A string at the path; null for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _first(v: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(_text(v, p), F.lit("")) for p in paths), F.lit(""))


def _surname(name: Column, whole: bool) -> Column:
    words = F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " ")
    return F.lower(F.element_at(words, -1) if whole else name)


def normal(v: Column, shape: str) -> Column:
    """META of a VARIANT record of the shape; null if it is no object."""
    s = SHAPES[shape]
    people = F.coalesce(F.try_variant_get(v, s.authors, "array<variant>"), F.array().cast("array<variant>"))
    names = F.filter(F.transform(people, lambda p: F.coalesce(_text(p, s.name), F.lit(""))), lambda n: F.trim(n) != "")
    year = F.coalesce(*(F.nullif(F.try_variant_get(v, p, "int"), F.lit(0)) for p in s.year))
    doi = _first(v, (s.doi,))
    bare = F.when(doi.startswith(PREFIX), F.substring(doi, len(PREFIX) + 1, 10_000)).otherwise(doi) if shape == "openalex" else doi
    fields = {"title": _first(v, s.title), "authors": F.transform(names, lambda n: _surname(n, s.whole)), "year": year, "journal": _first(v, s.journal), "doi": bare}
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(*(c.alias(k) for k, c in fields.items())).cast(META))


def meta(json: Column, shape: Column) -> Column:
    """META of a JSON record by the name of its shape; null for broken JSON and unknown shapes."""
    v = F.try_parse_json(json)
    out = F.lit(None).cast(META)
    for name in SHAPES:
        out = F.when(shape == name, normal(v, name)).otherwise(out)
    return out
