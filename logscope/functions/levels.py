"""Log levels (P07, P08): a rank from 0 to 7 and its names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names by rank, their numeric codes and four-letter forms.
NAMES = ("DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY")
CODES = (100, 200, 250, 300, 400, 500, 550, 600)
SHORT = ("DEBG", "INFO", "NOTC", "WARN", "ERRO", "CRIT", "ALRT", "EMER")
ERROR = NAMES.index("ERROR")


def _lookup(key: Column, keys: tuple, to: tuple) -> Column:
    table = F.create_map(*(F.lit(x) for pair in zip(keys, to, strict=True) for x in pair))
    return F.try_element_at(table, key)


def rank_of_name(name: Column) -> Column:
    """Rank of an upper-case name; null for any other text."""
    return _lookup(name, NAMES, tuple(range(8))).cast("tinyint")


def rank_of_code(code: Column) -> Column:
    return _lookup(code.cast("int"), CODES, tuple(range(8))).cast("tinyint")


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), rank.cast("int") + 1)


def level_lower(rank: Column) -> Column:
    return F.lower(level_name(rank))


def level_short(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SHORT)), rank.cast("int") + 1)


def is_error(rank: Column) -> Column:
    return rank >= F.lit(ERROR)
