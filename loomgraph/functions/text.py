"""Names, paths and short texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(c: Column) -> Column:
    """What follows the last dot of a name."""
    return F.substring_index(c, ".", -1)


def base_name(c: Column) -> Column:
    """What follows the last separator of a path, of either sort."""
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def file_stem(c: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(c, "[.][^.]*$", "")


def name_tokens(c: Column) -> Column:
    """Lower-case tokens of an identifier: split at dots, other punctuation and before capitals, each once."""
    spaced = F.regexp_replace(F.replace(c, F.lit("::"), F.lit(".")), "(?<=[^.])(?=[A-Z])", "_")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[_\W]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: shared over all; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both).cast("double")).otherwise(0.0)


def rendered(counts: str) -> Column:
    """A map of counts as text: key=count, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def line_count(text: Column) -> Column:
    """Lines of a text; the empty text has one."""
    return F.size(F.split(text, "\n"))


def access_kind(expression: Column, name: Column) -> Column:
    """How an expression's source text uses a field of that name: read, write or read_write.

    Assigning to it or handing it out writes; compound assignment, ++ and --, and handing it over by reference do both.
    The first use that is not a mere read decides.
    """
    field = F.concat(F.lit(r"(?:\b[\w.]+\.)?\b"), name, F.lit(r"\b"))
    has = lambda before, after: F.regexp_like(expression, F.concat(F.lit(before), field, F.lit(after)))
    both = has("", r"\s*(?:[-+*/%&|^]|<<|>>|\?\?)=(?!=)") | has("", r"\s*(?:\+\+|--)") | has(r"(?:\+\+|--)\s*", "") | has(r"\bref\s+", "")
    write = has("", r"\s*=(?![=>])") | has(r"\bout\s+", "")
    return F.when(F.coalesce(both, F.lit(False)), "read_write").when(F.coalesce(write, F.lit(False)), "write").otherwise("read")
