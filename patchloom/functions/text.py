"""Identifiers, masks, entropy, ranges and ratios as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(rule: Column, path: Column, line: Column, mark: Column) -> Column:
    """F- and ten hex digits of sha1 over the parts; a null line reads None and a null mark as nothing."""
    part = lambda c, empty: F.coalesce(c.cast("string"), F.lit(empty))
    return F.concat(F.lit("F-"), F.substring(F.sha1(F.concat_ws("|", part(rule, ""), part(path, ""), part(line, "None"), part(mark, "")).cast("binary")), 1, 10))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def markdown(text: Column) -> Column:
    """HTML characters escaped, & first."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def shared_suffix(a: Column, b: Column) -> Column:
    """How many path parts two paths share from the right."""
    same = F.zip_with(F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/")), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
