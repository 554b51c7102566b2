"""Fields of an entry (F01-F17): look-ups in context and extra, durations, status, endpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys tried for a duration and for the correlation token, in order.
DURATION_KEYS = ("duration_ms", "duration", "elapsed_ms", "elapsed", "response_time", "execution_time", "exec_time", "runtime", "request_time")
TOKEN_KEYS = ("token", "uid", "request_id", "x-request-id", "trace_id")
_NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT"
# The keys of which the first that is there decides, and the others that are read.
URI_KEYS = ("request_uri", "uri", "url")
STATUS_KEYS = ("status", "status_code", "http_status", "response_code")
CALL_STATUS_KEYS = ("http_code", "status_code", "status")
VERB_KEYS = ("http_method", "method")
TEXT_KEYS = ("route", "method", "sql", "url", "class", "key", "command", "exception")
OTHER_KEYS = ("total_time", "message_id", "code")


def prepare(entries: DataFrame, duration_keys: tuple[str, ...] = DURATION_KEYS, token_keys: tuple[str, ...] = TOKEN_KEYS, unit: str = "auto") -> DataFrame:
    """``entries`` and what their context and extra hold, each key looked up once.

    context[key], else extra[key]; JSON null is then null and shadows extra.  Adds head,
    durations, tokens, ``t:<key>`` for texts, ``v:<key>`` for values of any type, and the
    first value there is of the keys for an address, a status and a verb; context goes, but for
    ``context_json`` of errors, and so does extra.
    """
    keys = dict.fromkeys((*duration_keys, *token_keys, *URI_KEYS, *STATUS_KEYS, *CALL_STATUS_KEYS, *VERB_KEYS, *TEXT_KEYS, *OTHER_KEYS))
    # one pass over a side's entries puts those that are asked for in their places
    shape = f"STRUCT<{', '.join(f'`{k}`: VARIANT' for k in dict.fromkeys((*keys, 'route_parameters')))}>"
    cols = [c for c in entries.columns if c not in ("context", "extra")]
    sides = entries.selectExpr(*cols, *(f"try_cast({side} AS {shape}) AS _{side}" for side in ("context", "extra")), "CASE WHEN is_error THEN to_json(context) END AS context_json")
    get = lambda key: F.expr(f"coalesce(_context.`{key}`, _extra.`{key}`)").alias(f"v:{key}")
    raw = sides.select(*cols, "context_json", first_line(F.col("message")).alias("head"), F.lower("channel").alias("_chan"), F.col("_context.route_parameters").alias("_route_parameters"), *map(get, keys))
    there = lambda key: f"CASE WHEN NOT is_variant_null(`v:{key}`) THEN `v:{key}` END"
    first = lambda of: F.expr(f"coalesce({', '.join(map(there, of))})")
    return raw.select(
        *cols, "context_json", "head", "_chan", "_route_parameters", durations(duration_keys, unit).alias("durations"), tokens(token_keys).alias("tokens"),
        *(as_text(F.col(f"`v:{k}`")).alias(f"t:{k}") for k in TEXT_KEYS), *(F.expr(there(k)).alias(f"v:{k}") for k in OTHER_KEYS),
        first(URI_KEYS).alias("_uri"), first(STATUS_KEYS).alias("_status"), first(CALL_STATUS_KEYS).alias("_call_status"), first(VERB_KEYS).alias("_verb"),
        text_at(F.col("`v:exception`"), "$.class").alias("_thrown_class"), text_at(F.col("`v:exception`"), "$.file").alias("_thrown_file"),
    )


def lookup(key: str) -> Column:
    """The value of a key in prepared entries."""
    return F.col(f"`v:{key}`")


def text(key: str) -> Column:
    """The text under a key in prepared entries."""
    return F.col(f"`t:{key}`")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_text(v: Column) -> Column:
    """The value of a JSON string; null for any other type."""
    return F.when(kind(v) == "STRING", v.cast("string"))


def text_at(v: Column, path: str) -> Column:
    """A JSON string at the path; null for any other type."""
    return as_text(F.try_variant_get(v, path, "variant"))


def is_number(v: Column) -> Column:
    return kind(v).rlike(f"^({_NUMBER})$")


def as_number(v: Column) -> Column:
    return F.when(is_number(v), v.try_cast("double"))


def as_integer(v: Column) -> Column:
    """A JSON integer, or an integer in a string."""
    shown = F.trim(v.cast("string"))
    return F.when(kind(v).isin("BIGINT", "STRING") & shown.rlike(r"^[+-]?[0-9]+$"), shown.try_cast("bigint"))


def status_code(v: Column) -> Column:
    """An HTTP status from a number or a string."""
    code = as_integer(v)
    return F.when(code.between(100, 599), code.cast("smallint"))


def non_negative(v: Column) -> Column:
    raw = F.coalesce(as_number(v), F.trim(as_text(v)).try_cast("double"))
    return F.when((raw >= 0) & (raw < float("inf")), raw)


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")


def quoted(text: Column) -> Column:
    """The first double-quoted run."""
    got = F.regexp_extract(text, r'^[^"]*"([^"]*)"', 1)
    return F.when(text.rlike(r'^[^"]*"[^"]*"'), got)


def route() -> Column:
    return F.coalesce(text("route"), text_at(F.col("_route_parameters"), "$._route"))


def request_uri() -> Column:
    """The first of three keys that is there (F03); never on the outbound channel."""
    return F.when(F.col("_chan") != "http_client", as_text(F.col("_uri")))


def method() -> Column:
    return text("method")


def status() -> Column:
    """The first key that is there decides, valid or not."""
    return status_code(F.col("_status"))


def endpoint() -> Column:
    return F.coalesce(route(), F.substring_index(request_uri(), "?", 1))


def exception_class() -> Column:
    """Class of an exception, from its object or its text form."""
    thrown = text("exception")
    after = F.regexp_extract(thrown, r"(?s)^[^(]*\((.*)$", 1)
    cut = F.when(after.contains("("), F.substring_index(after, "(", 1)).otherwise(F.substring_index(after, ":", 1))
    return F.coalesce("_thrown_class", F.when(thrown.contains("("), F.nullif(F.trim(cut), F.lit(""))))


def exception_origin() -> Column:
    """Where an exception was raised, path:line (F08): after the last `` at `` of the first line."""
    head = F.regexp_replace(F.rtrim(first_line(text("exception"))), r"\)$", "")
    return F.coalesce("_thrown_file", F.when(head.contains(" at "), F.nullif(F.trim(F.substring_index(head, " at ", -1)), F.lit(""))))


def unit_of_key(key: str) -> str:
    """ms, s or us by the key's ending; empty where that says nothing."""
    k = key.lower()
    return "ms" if k.endswith("ms") else "us" if k.endswith(("_us", "micro")) else "s" if k.endswith(("_s", "_sec", "seconds")) else ""


def to_millis(v: Column, key: str | Column, forced: str = "auto") -> Column:
    """A duration in ms from a number, or from a string with or without a unit.

    ``key`` is the key's name, or a column with what ``unit_of_key`` says of it.  Without a
    unit by either, values with a fraction below 30 are seconds.
    """
    hint = F.lit(unit_of_key(key)) if isinstance(key, str) else key
    text = F.trim(as_text(v))
    number = F.coalesce(as_number(v), F.regexp_extract(text, r"^([0-9.+-]*)", 1).try_cast("double"))
    word = F.lower(F.trim(F.regexp_extract(text, r"(?s)^[0-9.+-]*(.*)$", 1)))
    written = F.when(word.isin("ms", "msec"), "ms").when(word.isin("s", "sec", "secs"), "s").when(word.isin("us", "µs", "μs"), "us")
    known = text.isNull() | (word == "") | written.isNotNull()
    by_size = F.when((number > 0) & (number < 30) & (number % 1 != 0), F.lit("s")).otherwise(F.lit("ms"))
    unit = F.coalesce(written, F.nullif(hint, F.lit("")), by_size) if forced == "auto" else F.lit(forced)
    ms = F.when(unit == "s", number * 1000).when(unit == "us", number / 1000).otherwise(number)
    return F.when(known & (number >= 0) & (number < float("inf")), ms)


def durations(keys: tuple[str, ...], forced: str = "auto") -> Column:
    """(key, ms) of the keys that hold a duration; most lines have none, and no array is walked."""
    there = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(unit_of_key(k)).alias("unit"), lookup(k).alias("v")) for k in keys)), lambda x: x["v"].isNotNull())
    found = F.filter(F.transform(there, lambda x: F.struct(x["key"].alias("key"), to_millis(x["v"], x["unit"], forced).alias("ms"))), lambda x: x["ms"].isNotNull())
    return F.when(F.coalesce(*map(lookup, keys)).isNotNull(), found).otherwise(F.array().cast("array<struct<key: string, ms: double>>"))


def tokens(keys: tuple[str, ...]) -> Column:
    """(key, token) of the keys that hold a text that isn't empty."""
    none = F.array().cast("array<struct<key: string, token: string>>")
    held = lambda k: F.array(F.struct(F.lit(k).alias("key"), as_text(lookup(k)).alias("token")))
    return F.concat(*(F.when(as_text(lookup(k)) != "", held(k)).otherwise(none) for k in keys))


def of_key(pairs: str, key: str | None, what: str, kind: str) -> Column:
    """The value under the key in an array of ``durations`` or ``tokens``."""
    if key is None:
        return F.lit(None).cast(kind)
    return F.get(F.filter(pairs, lambda x: x["key"] == key), F.lit(0))[what]


def is_matched_route() -> Column:
    return (F.col("channel") == "request") & F.col("message").startswith("Matched route")


def is_off_request() -> Column:
    return F.col("_chan") == "console"
