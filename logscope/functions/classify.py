"""One entry to at most one typed event per kind (D01-D13), as struct columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions import fields as f
from logscope.functions.text import cache_key, fold, truncate, url_target


# Fixed values below: the texts that the log's producers write.


def _words(text: Column, k: int) -> Column:
    return F.try_element_at(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.lit(k))


def http_parts(d: DataFrame) -> DataFrame:
    """``d`` with what an outbound line's head says, column by column, for ``http_call``."""
    head = F.col("head")
    d = d.withColumn("_call", (F.col("_chan") == "http_client") & ~F.ltrim(head).startswith("Request:"))
    d = d.withColumn("_inside", F.when(F.col("_call") & head.rlike(r'(?s)^[^"]*".*"'), F.trim(F.regexp_extract(head, r'(?s)^[^"]*"(.*)"', 1))))
    first = F.regexp_extract("_inside", r"^(\S+)\s", 1)
    code = F.when(first.rlike(r"^\+?[0-9]{1,5}$"), first.try_cast("int"))
    d = d.withColumns({"_code": F.when(code.between(100, 599), code.cast("smallint")), "_after": F.when(F.col("_inside").isNotNull(), F.split(F.trim(F.regexp_extract(head, r'(?s)"([^"]*)$', 1)), r"\s+"))})
    written = F.when(F.col("_code").isNotNull(), F.trim(F.regexp_extract("_inside", r"(?s)^\S+\s(.*)$", 1))).otherwise(F.col("_inside"))
    seconds = F.when(F.get("_after", F.lit(1)).startswith("second"), F.get("_after", F.lit(0)).try_cast("double"))
    verb = F.trim(f.as_text(F.col("_verb")))
    return d.withColumns({
        "_url": F.when(F.col("_call"), F.coalesce(f.text("url"), F.nullif(written, F.lit("")))), "_seconds": seconds,
        "_called": F.when(F.col("_call") & verb.rlike("^[A-Za-z]{1,16}$"), F.upper(verb)),
    }).drop("_inside", "_after")


def http_call() -> Column:
    """shape, status, ms of an outbound response (D01-D03), after ``http_parts``."""
    status = F.coalesce(f.status_code(F.col("_call_status")), F.col("_code"))
    took = F.coalesce(f.non_negative(f.lookup("total_time")), F.col("_seconds"))
    shape = F.concat_ws(" ", F.col("_called"), url_target(F.col("_url")))
    return F.when(F.trim("_url") != "", F.struct(shape.alias("shape"), status.alias("status"), (took * 1000).alias("ms")))


# Fixed pattern of the audit lines: [id] Sent|Received class.
_AUDIT = r"(?s)^\[([^\]]*)\]\s*(Sent|Received)\s+([^\s{]\S*)"


def message_parts(d: DataFrame) -> DataFrame:
    """``d`` with what a message-bus line's head says, column by column, for ``message_event``."""
    d = d.withColumn("_bus", F.when(F.col("_chan").startswith("messenger"), F.trim("head")))
    head = F.col("_bus")
    core = (
        F.when(head.startswith("Error thrown while handling message "), F.when(head.contains("Removing from transport"), "failed").otherwise("retried"))
        .when(head.startswith("Sending message "), "dispatched")
        .when(head.startswith("Rejected message "), "failed")
        .when(head.startswith("No handler for message "), "no_handler")
        .when(head.contains("was handled successfully"), "handled")
        .when(head.startswith("Message ") & head.contains(" handled by "), "ran")
    )
    d = d.withColumns({"_core": core, "_audit": F.when(head.rlike(_AUDIT), F.trim(F.regexp_extract(head, _AUDIT, 1)))})
    rest = F.when(F.col("_core") == "handled", head).when(F.col("_core") != "ran", F.regexp_replace(head, r"^(Sending message|No handler for message|Error thrown while handling message|Rejected message) ", ""))
    return d.withColumn("_word", F.regexp_replace(F.regexp_extract(rest, r"^\s*(\S*)", 1), r"\.+$", ""))


def message_event() -> Column:
    """event, class, id, audited of a message-bus line (D06-D09), after ``message_parts``."""
    head, core, word = F.col("_bus"), F.col("_core"), F.col("_word")
    named = F.nullif(F.trim(f.text("class")), F.lit(""))
    is_audit = F.coalesce(F.col("_audit") != "", F.lit(False))
    audit_event = F.when(F.regexp_extract(head, _AUDIT, 2) == "Sent", "dispatched").otherwise("handled")
    template = F.when((word != "") & ~word.startswith("{"), word)
    id_value = f.lookup("message_id")
    core_id = F.coalesce(F.nullif(F.trim(f.as_text(id_value)), F.lit("")), F.when(f.is_number(id_value), id_value.cast("string")))
    made = F.struct(
        F.when(is_audit, audit_event).otherwise(core).alias("event"), F.coalesce(named, F.when(is_audit, F.regexp_extract(head, _AUDIT, 3)).otherwise(template)).alias("class"),
        F.when(is_audit, F.col("_audit")).otherwise(core_id).alias("id"), is_audit.alias("audited"),
    )
    return F.when(head.isNotNull() & (is_audit | core.isNotNull()), made)


def cache_miss() -> Column:
    """event, key (folded) of a cache line."""
    head = F.col("head")
    event = F.when(head.contains("now computing item "), "computed").when(head.contains("is locked, waiting for it to be released"), "contended")
    in_context = f.text("key")
    key = F.coalesce(F.trim(in_context), f.quoted(head))
    good = (F.col("_chan") == "cache") & event.isNotNull() & (key != "") & ~key.startswith("{")
    return F.when(good, F.struct(event.alias("event"), cache_key(key).alias("key")))


def command() -> Column:
    """name, code, exited, threw of a console line."""
    head = F.col("head")
    exited = head.startswith("Command ") & head.contains(" exited with code ")
    threw = head.startswith("Error thrown while running command ")
    name = _words(F.coalesce(f.text("command"), f.quoted(head)), 1)
    code_value = f.lookup("code")
    written = F.regexp_replace(F.trim(F.substring_index(head, "exited with code ", -1)), r'^"+|"+$', "")
    code = F.when(code_value.isNotNull(), f.as_integer(code_value)).otherwise(F.when(written.rlike(r"^[+-]?[0-9]+$"), written.try_cast("bigint")))
    good = (F.col("_chan") == "console") & (exited | threw) & (name != "") & ~name.startswith("{")
    return F.when(good, F.struct(name.alias("name"), F.when(exited, code).alias("code"), exited.alias("exited"), threw.alias("threw")))


def deprecation() -> Column:
    """message, origin (both folded) and the body's first line."""
    body = F.regexp_replace("message", r"^(User Deprecated|Deprecated): ", "")
    is_one = F.col("message").startswith("User Deprecated: ") | F.col("message").startswith("Deprecated: ")
    line, origin = f.first_line(body), f.exception_origin()
    return F.when(is_one, F.struct(truncate(fold(line), 200).alias("message"), F.coalesce(truncate(fold(origin), 200), F.lit("")).alias("origin_key"), line.alias("line"), origin.alias("origin")))


def sql_statement() -> Column:
    return f.text("sql")
