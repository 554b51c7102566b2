"""A physical line to an entry (P01-P06), mostly in the JVM.

``parse`` adds ``ts, level, channel, message, context, extra`` to lines; ``level`` is null where
the line is no entry of its own.  A text line's message ends at the leftmost place from
which the rest is exactly one or two JSON values.

The leftmost place is split into one or two values by column functions.  The JVM's parser
ignores what follows a value, so each is parsed inside an array that ends with the value's own
hash: only where the hash comes back as the last element was the text one value and no more.
Lines that this leaves undecided carry their body to an Arrow function that tries every place.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.functions.levels import CODES, NAMES


def _finite(text: str) -> float:
    if math.isinf(value := float(text)):
        raise ValueError(text)
    return value


def _no_constant(text: str) -> float:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_float=_finite)
_JSON_SPACE = " \t\n\r"


def split_exact(body: str | None) -> dict | None:
    """Message, context and extra of a body by trying every place, from the left."""
    if body is None:
        return None
    at = 0
    while True:
        found = [p for p in (body.find(" {", at), body.find(" [", at)) if p >= 0]
        if not found:
            return {"message": body.rstrip(), "context": None, "extra": None}
        i = min(found)
        values = _one_or_two(body[i + 1 :])
        if values:
            texts = [json.dumps(v, ensure_ascii=False) for v in values]
            return {"message": body[:i].rstrip(), "context": texts[0], "extra": texts[1] if len(texts) > 1 else None}
        at = i + 1


def _one_or_two(tail: str) -> list | None:
    values, at = [], 0
    while True:
        while at < len(tail) and tail[at] in _JSON_SPACE:
            at += 1
        if at == len(tail):
            return values or None
        if len(values) == 2:
            return None
        try:
            value, at = _DECODER.raw_decode(tail, at)
            json.dumps(value, ensure_ascii=False).encode()  # no lone surrogates
        except (ValueError, RecursionError):
            return None
        values.append(value)


_SPLIT = T.StructType([T.StructField(c, T.StringType()) for c in ("message", "context", "extra")])


@F.arrow_udf(_SPLIT)
def _split_rest(bodies: pa.Array) -> pa.Array:
    """Bodies of text lines, and whole JSON lines (their value is in ``context``)."""
    names = _SPLIT.fieldNames()
    if bodies.null_count == len(bodies):
        return pa.StructArray.from_arrays([pa.nulls(len(bodies), pa.string())] * 3, names)
    rows = []
    for text in bodies.to_pylist():
        if text is not None and text.startswith("J"):
            whole = _one_or_two(text[1:]) or ()
            rows.append({"context": json.dumps(whole[0], ensure_ascii=False) if len(whole) == 1 else None})
        else:
            rows.append(split_exact(text and text[1:]) or {})
    return pa.StructArray.from_arrays([pa.array([r.get(n) for r in rows], pa.string()) for n in names], names)


# marked so that no later filter is copied below it, with all that it reads
_split_rest = _split_rest.asNondeterministic()


def timestamp(text: Column) -> Column:
    """RFC 3339, or date and time without a zone in the session's zone; else null."""
    text = F.trim(text)
    plain = text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
    # fractions beyond microseconds are cut by the cast
    return F.when(plain, text.try_cast("timestamp"))


def useful(value: Column, hollow: Column) -> Column:
    """Null for JSON null and for empty objects and arrays (P05); ``hollow`` says whether the text
    that it was read from has such a one anywhere, as writing a value out to see costs more."""
    shown = value.cast("string")
    return F.when(F.is_variant_null(value) | (hollow & shown.isin("{}", "[]")), F.lit(None)).otherwise(value)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def text_of(v: Column, path: str) -> Column:
    """A JSON string at the path; null for any other type."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def _case(value: str, keys: tuple) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k!r} THEN {i}Y" for i, k in enumerate(keys)) + " END"


def _string(v: str) -> str:
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS STRING) END"


def _same(array: str, text: str) -> str:
    """Whether the array is the text's one value and its hash, and no more."""
    return f"(try_variant_get({array}, '$[1]', 'bigint') = xxhash64({text}) AND try_variant_get({array}, '$[2]', 'variant') IS NULL)"


#: What the two JSON parsers read differently: half a surrogate pair, numbers beyond a double.
_HOLLOW = r"[{\[][ \t\n\r]*+[}\]]"
#: The fields of a JSON line, each of any type.
_FIELDS = f"STRUCT<{', '.join(f'{c}: VARIANT' for c in ('level', 'level_name', 'datetime', 'channel', 'message', 'context', 'extra'))}>"
_RISKY = r"\\u[dD]|[0-9][eE]\+?[0-9]{3}"


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` (with ``value``) and the entry's fields; ``value`` goes.

    Each step is one projection, so nothing is parsed or searched twice.
    """
    keep = [c for c in lines.columns if c != "value"]
    line = F.rtrim(F.ltrim("value", F.lit(" \t\n\x0b\f\r")), F.lit("\r\n"))
    d = lines.select(*keep, line.alias("_line"))
    # text header: date up to the first ], channel and level up to the first :
    d = d.selectExpr(*keep, "_line", "startswith(_line, '{') AS _is_json", "CASE WHEN startswith(_line, '[') THEN nullif(instr(_line, ']'), 0) END AS _close")
    d = d.selectExpr("*", "ltrim(substring(_line, _close + 1)) AS _rest")
    d = d.selectExpr("*", "CASE WHEN instr(_rest, ':') > 0 THEN left(_rest, instr(_rest, ':') - 1) END AS _head")
    d = d.selectExpr("*", "CASE WHEN instr(_head, '.') > 0 THEN substring_index(_head, '.', -1) END AS _word")
    d = d.selectExpr(*keep, "_line", "_is_json", "_close", "_head", "_word", "_rest", f"{_case('trim(_word)', NAMES)} AS _level")
    d = d.selectExpr(*keep, "_line", "_is_json", "_close", "_level", "CASE WHEN _level IS NOT NULL THEN trim(left(_head, length(_head) - length(_word) - 1)) END AS _channel", "CASE WHEN _level IS NOT NULL THEN ltrim(substring(_rest, length(_head) + 2)) END AS _body")
    # the leftmost place where JSON may begin, and where a second value may
    d = d.selectExpr("*", "nullif(least(coalesce(nullif(instr(_body, ' {'), 0), 2147483647), coalesce(nullif(instr(_body, ' ['), 0), 2147483647)), 2147483647) AS _cut")
    d = d.selectExpr("*", "CASE WHEN _is_json THEN rtrim(_line) ELSE rtrim(substring(_body, _cut + 1)) END AS _tail")
    d = d.withColumn("_second", F.when(~F.col("_is_json"), F.length(F.regexp_extract("_tail", r"(?s)^.*[}\]][ \t\n\r]+(?=[{\[])", 0))))
    d = d.selectExpr("*", "CASE WHEN _second > 0 THEN rtrim(left(_tail, _second)) ELSE _tail END AS _v1", "CASE WHEN _second > 0 THEN substring(_tail, _second + 1) END AS _v2")
    array = "try_parse_json(concat('[', {0}, ',', xxhash64({0}), ']'))"
    d = d.selectExpr("*", f"{array.format('_v1')} AS _a1", f"CASE WHEN _v2 NOT IN ('[]', '{{}}') THEN {array.format('_v2')} END AS _a2")
    d = d.withColumn("_risky", F.col("_tail").rlike(_RISKY))
    d = d.selectExpr("*", f"(_tail IS NULL OR (NOT _risky AND {_same('_a1', '_v1')} AND (_v2 IS NULL OR _v2 IN ('[]', '{{}}') OR {_same('_a2', '_v2')}))) IS TRUE AS _ok")
    d = d.withColumn("_exact", _split_rest(F.expr("CASE WHEN NOT _ok AND _is_json THEN concat('J', _line) WHEN NOT _ok AND _body IS NOT NULL THEN concat('B', _body) END")))
    d = d.selectExpr(
        *keep, "_is_json", "_level", "_channel", "CASE WHEN _level IS NOT NULL THEN substring(_line, 2, _close - 2) END AS _stamp", f"_line RLIKE r'{_HOLLOW}' AS _hollow",
        "CASE WHEN _body IS NULL THEN NULL WHEN _tail IS NULL THEN rtrim(_body) WHEN _ok THEN rtrim(left(_body, _cut - 1)) ELSE _exact.message END AS _message",
        # arrays whose first element is the value
        "CASE WHEN _ok THEN _a1 ELSE try_parse_json(concat('[', _exact.context, ']')) END AS _one",
        "CASE WHEN _ok THEN _a2 ELSE try_parse_json(concat('[', _exact.extra, ']')) END AS _two",
    )
    # a JSON line's fields in one pass over it
    d = d.selectExpr("*", f"CASE WHEN _is_json THEN try_variant_get(_one, '$[0]', '{_FIELDS}') END AS _object")
    # JSON lines: the level by name, else by code; without either it is no entry
    code = f"CASE WHEN schema_of_variant(_object.level) = 'BIGINT' THEN {_case('CAST(_object.level AS BIGINT)', CODES)} END"
    name = _case(_string("_object.level_name"), NAMES)
    d = d.selectExpr("*", f"CASE WHEN _is_json THEN coalesce({name}, {code}) ELSE _level END AS level")
    d = d.selectExpr(
        *keep, "level", "_stamp", "_hollow", "_channel", "_message", "_one", "_two", "_object", "(_is_json AND level IS NOT NULL) AS _from_json", "_is_json", "try_variant_get(_object.datetime, '$.date', 'variant') AS _inner",
    )
    date = f"CASE WHEN _from_json THEN coalesce({_string('_object.datetime')}, {_string('_inner')}) ELSE _stamp END"
    d = d.selectExpr(
        *keep, "level", "_hollow", f"{date} AS _date",
        f"CASE WHEN _from_json THEN coalesce({_string('_object.channel')}, 'app') ELSE _channel END AS channel",
        f"CASE WHEN _from_json THEN coalesce({_string('_object.message')}, '') ELSE _message END AS message",
        "CASE WHEN _from_json THEN _object.context WHEN NOT _is_json THEN try_variant_get(_one, '$[0]', 'variant') END AS context",
        "CASE WHEN _from_json THEN _object.extra WHEN NOT _is_json THEN try_variant_get(_two, '$[0]', 'variant') END AS extra",
    )
    return d.select(*keep, timestamp(F.col("_date")).alias("ts"), "level", "channel", "message", useful(F.col("context"), F.col("_hollow")).alias("context"), useful(F.col("extra"), F.col("_hollow")).alias("extra"))
