"""Values of rows that come from outside: JSON, counts, sources, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lit, present

SECTION = "struct<title:string,content:string>"
#: Words before a name that declare it.
DECLARING = ("def", "class", "function", "const", "let", "var", "export")
PAGE = f"struct<intro:string,sections:array<{SECTION}>,mermaid:string>"


def json_object(raw: Column) -> Column:
    """The text of a JSON object; {} for null, other JSON values and what is no JSON.

    The parser passes over what follows a value, so the text is parsed inside of an array and of an object: whatever
    follows breaks at least one of the two, or is a second element.
    """
    listed = F.try_parse_json(F.concat(lit("["), raw, lit("]")))
    keyed = F.try_parse_json(F.concat(lit('{"v":'), raw, lit("}")))
    alone = keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(F.startswith(F.schema_of_variant(listed), lit("ARRAY<OBJECT")) & alone, raw).otherwise(lit("{}"))


def star_count(value: Column) -> Column:
    """Whole number of a text of digits with an optional sign, blanks around it allowed; null for anything else."""
    bare = F.trim(value, lit(" \t\r\n"))
    return F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("long"))


def display_description(given: Column, generated: Column) -> Column:
    """The first of the two with something other than blanks, trimmed."""
    return F.coalesce(present(F.trim(given)), present(F.trim(generated)))


def valid_source(source: Column) -> Column:
    """Not null or empty, not `unknown` in any case, with or without a category before it."""
    bare = F.lower(F.coalesce(source, lit("")))
    return (bare != "") & (bare != "unknown") & ~bare.endswith(":unknown")


def complete_artifacts(structure: Column, contents: Column) -> Column:
    """Whether a structure address and at least one content address are there."""
    return F.coalesce(structure != "", lit(False)) & F.coalesce(F.size(F.filter(contents, lambda c: c.isNotNull() & (c != ""))) > 0, lit(False))


def quoted(text: Column) -> Column:
    """A pattern for a text as it stands."""
    return F.concat(lit("\\Q"), F.replace(text, lit("\\E"), lit("\\E\\\\E\\Q")), lit("\\E"))


def first_line_of(text: Column, symbol: Column) -> Column:
    """Number of the first line that declares the symbol or uses it before =, : or (, in any case; null where none does."""
    pattern = F.concat(lit(rf"(?i)(?:{'|'.join(DECLARING)})\s+"), quoted(symbol), lit("|"), quoted(symbol), lit(r"\s*[=:(]"))
    at = F.array_position(F.transform(F.split(text, "\n"), lambda x: F.call_function("rlike", x, pattern)), lit(True))
    return F.when((at > 0) & (symbol != ""), at.cast("long"))


def wiki_page(raw: Column) -> Column:
    """intro, sections and mermaid of a page's JSON. An intro that is itself JSON of a page gives its non-empty fields
    instead; what is no page gives an empty one."""
    page = F.from_json(raw, PAGE)
    nested = F.when(F.trim(page["intro"]).startswith("{"), F.from_json(page["intro"], PAGE))
    is_page = page["intro"].isNotNull() & page["sections"].isNotNull()
    some = lambda f, none: F.coalesce(present(nested[f]), page[f], none)
    empty = F.array().cast(f"array<{SECTION}>")
    return F.struct(
        F.when(is_page, some("intro", lit(""))).otherwise("").alias("intro"),
        F.when(is_page, F.coalesce(nested["sections"], page["sections"])).otherwise(empty).alias("sections"),
        F.when(is_page, some("mermaid", lit(""))).otherwise("").alias("mermaid"),
    )
