"""Normalising text (N01-N08) and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Fixed pattern: what may follow a quote that closes.
_CLOSED = r'[\s,;:.)\]}"!?]'
_UNNESTED = rf'^[^"]*+(?:"[^"]*+"(?={_CLOSED}|$)[^"]*+)*+(?:"[^"]*+)?$'


def fold(text: Column) -> Column:
    """Digit runs become #, outermost quoted runs a placeholder, nested quotes included.

    A quote that is open to the end hides the rest.  Texts whose quotes don't nest need two
    replacements; others are walked quote by quote.
    """
    return let(text, lambda t: F.regexp_replace(F.when(~t.contains('"'), t).when(t.rlike(f"(?s){_UNNESTED}"), F.regexp_replace(t, '"[^"]*("|$)', '"…"')).otherwise(let(F.split(t, '"'), _walked)), "[0-9]+", "#"))


def _walked(pieces: Column) -> Column:
    step = F.struct(F.element_at(pieces, 1).alias("out"), F.lit(0).alias("depth"))

    def over(acc: Column, i: Column) -> Column:
        # the quote before piece i; an empty piece stands before another quote or the end
        piece, last = F.get(pieces, i), i == F.size(pieces) - 1
        ends = F.when(piece == "", F.lit(True)).otherwise(piece.rlike(f"^{_CLOSED}"))
        depth = F.when(acc["depth"] == 0, F.lit(1)).when(ends | (last & (piece == "")), acc["depth"] - 1).otherwise(acc["depth"] + 1)
        out = F.concat(acc["out"], F.when(acc["depth"] == 0, F.lit('"…"')).otherwise(F.lit("")), F.when(depth == 0, piece).otherwise(F.lit("")))
        return F.struct(out.alias("out"), depth.alias("depth"))

    return F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), step, over, lambda a: a["out"])


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, then an ellipsis."""
    return let(text, lambda t: F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("…"))).otherwise(t))


def cache_key(key: Column) -> Column:
    return truncate(fold(F.trim(key)), 200)


def short_class(name: Column) -> Column:
    return F.substring_index(name, "\\", -1)


def signature(exception: Column, head: Column) -> Column:
    """Short class and folded first line, at most 160 characters."""
    return truncate(F.concat(F.coalesce(F.concat(short_class(exception), F.lit(": ")), F.lit("")), fold(head)), 160)


def one_line_sql(sql: Column) -> Column:
    """White space collapsed, at most 400 characters."""
    return truncate(F.trim(F.regexp_replace(sql, r"\s+", " ")), 400)


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


# Fixed pattern: a path segment that names one thing - digits, a UUID, 16 or more hex digits.
_IDENTIFIER = "(?:[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,})"


def url_target(url: Column) -> Column:
    """Host and path without query, fragment, scheme and credentials; identifiers folded."""
    return let(F.regexp_replace(F.trim(url), r"(?s)[?#].*$", ""), _target)


def _target(bare: Column) -> Column:
    return let(F.when(bare.contains("://"), F.regexp_replace(bare, r"(?s)^.*?://", "")).otherwise(bare), _folded_path)


def _folded_path(bare: Column) -> Column:
    host = F.lower(F.substring_index(F.substring_index(bare, "/", 1), "@", -1))
    parts = F.filter(F.split(F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(s.rlike(f"^{_IDENTIFIER}$"), F.lit("#")).when(s.rlike(f"^{_IDENTIFIER}\\.[a-zA-Z0-9]{{1,5}}$"), F.concat(F.lit("#."), F.substring_index(s, ".", -1))).otherwise(s))
    return truncate(F.array_join(F.concat(F.array(host), named), "/"), 200)
