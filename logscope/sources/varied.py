"""A log written from the ``events`` table with a shape of line for every rule of the parser.

Event e has shape e modulo the number of shapes.  Each is a template over the event's id, value,
time and user; ``plans.varied`` says in SQL what each must give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Templates of the lines: {e} the event's id, {m} its minute of the hour, {v} its value, {u} its user,
#: {ts} its time as RFC 3339 and {day} without a zone.
SHAPES = (
    # JSON: numeric level, date in an object, status in a string, exception as an object
    '{"message":"Failed","context":{"exception":{"class":"App\\\\X","file":"/src/Y.php:{m}"},"request_uri":"/items/{e}?q=1","http_status":"503"},"level":400,"channel":"app","datetime":{"date":"{day}","timezone":"UTC"},"extra":{"token":"u{u}"}}',
    '[{ts}] app.INFO: Step done {"elapsed":"{v} us"} {"token":"u{u}"}',
    '[{ts}] app.INFO: Step done {"response_time":"{v}ms"} {"token":"u{u}"}',
    '[{ts}] app.NOTICE: Shadowed {"route":null,"method":"PUT","status":"abc"} {"route":"hidden","token":"u{u}"}',
    '[{ts}] messenger.WARNING: Error thrown while handling message App\\M. Sending for retry #1 using 1000 ms delay. Error: "x" {"class":"App\\\\M","message_id":{e}} {"token":"u{u}"}',
    '[{ts}] messenger.CRITICAL: Error thrown while handling message App\\M. Removing from transport after 3 retries. Error: "x" {"class":"App\\\\M","message_id":"m{e}"} {"token":"u{u}"}',
    '[{ts}] messenger.INFO: Rejected message App\\R will be sent to the failure transport. [] {"token":"u{u}"}',
    '[{ts}] messenger.INFO: No handler for message App\\N [] {"token":"u{u}"}',
    '[{ts}] messenger.INFO: Message App\\M handled by App\\H::__invoke {"class":"App\\\\M"} {"token":"u{u}"}',
    '[{ts}] messenger_audit.INFO: [id{u}] Sent App\\M [] {"token":"u{u}"}',
    '[{ts}] messenger_audit.INFO: [id{u}] Received App\\M [] {"token":"u{u}"}',
    '[{ts}] cache.INFO: Item "menu_{e}_de" is locked, waiting for it to be released [] {"token":"u{u}"}',
    '[{ts}] console.CRITICAL: Error thrown while running command "app:sync --all {e}". Message: "no {m}" [] {"token":"u{u}"}',
    '[{ts}] http_client.INFO: Response: "404 https://me:pw@Shop.Test:8443/v2/users/550e8400-e29b-41d4-a716-446655440000/0123456789abcdef0123/{e}.json?key=1#x" 0.25 seconds {"http_method":"post"} {"token":"u{u}"}',
    # empty JSON is dropped; text that looks like JSON stays in the message
    '[{ts}] app.ALERT: Notified "a{e}" of {nothing} "b" {} []',
    '{"message":"Old","context":[],"level_name":"WARNING","channel":"php","datetime":"{ts}","extra":{}}',
    '[{ts}] php.INFO: User Deprecated: The "x{m}" option of {e} is old {"exception":"[object] (ErrorException(code: 0): old at /src/Z.php:{m})"} {"token":"u{u}"}',
    '[{ts}] console.DEBUG: Command "app:sync --all {e}" exited with code "{m}" [] {"token":"u{u}"}',
)


def _filled(template: str, **values: Column) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    # a name that is no value is text
    return F.concat(*(values[p] if k % 2 and p in values else F.lit(f"{{{p}}}" if k % 2 else p) for k, p in enumerate(pieces) if p or k % 2))


def varied_log(events: DataFrame) -> DataFrame:
    """source, ord, value: one line an event."""
    text = lambda c: F.col(c).cast("string")
    minute = F.minute("ts").cast("string")
    stamp = lambda form, end="": F.concat(F.date_format("ts", form), F.lit(end))
    values = {"e": text("event_id"), "m": minute, "v": F.format_string("%.3f", F.col("value").cast("double")), "u": text("user_id"), "ts": stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "+00:00"), "day": stamp("yyyy-MM-dd HH:mm:ss.SSSSSS")}
    line = F.lit(None).cast("string")
    for n, template in reversed(list(enumerate(SHAPES))):
        line = F.when(F.col("event_id") % len(SHAPES) == n, _filled(template, **values)).otherwise(line)
    return events.select(F.lit(0).alias("source"), F.col("event_id").cast("long").alias("ord"), line.alias("value"))
