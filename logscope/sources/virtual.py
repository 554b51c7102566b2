"""A log written from the ``events`` table: every channel of the engine, in both formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Events of one task: writing and typing their lines takes it some seconds.
TASK = 100_000


def dealt(events: DataFrame) -> DataFrame:
    """The events over tasks of a bounded number of rows.

    They may lie in one row group, which one task would read.  Dealt by their key they need no
    sort, which a deal in turn would make of all rows of the task that reads them.
    """
    cores = events.sparkSession.sparkContext.defaultParallelism
    waves = max(1, -(-events.count() // (cores * TASK)))
    return events.repartition(cores * waves, "event_id")


def kind(event_type, k):
    """What an event is in the log, looked up by its type and the last digit of k."""
    ten = {"view": ["route"] * 10, "click": ["sql"] * 7 + ["cache"] * 3, "purchase": ["http"] * 10, "signup": ["sent"] * 6 + ["handled"] * 2 + ["command"] * 2, "error": ["error"] * 8 + ["deprecation"] * 2}
    table = F.create_map(*(F.lit(x) for t, of in ten.items() for d, name in enumerate(of) for x in (f"{t}{d}", name)))
    return F.try_element_at(table, F.concat(event_type, (k % 10).cast("string")))


def virtual_log(events: DataFrame) -> DataFrame:
    """source, ord, value: one line an event; even events as text, odd ones as JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.select("event_id", "ts", "user_id", "value", k.alias("k"), kind(F.col("event_type"), k).alias("kind"))
    code = F.when(F.col("k") % 10 == 0, 500).when(F.col("k") % 10 == 1, 404).otherwise(200)
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s = lambda c: F.col(c).cast("string")
    token = text("u", s("user_id"), "d", F.date_format("ts", "dd"))
    k4, k5, k3 = (F.col("k") % 4).cast("string"), (F.col("k") % 5).cast("string"), (F.col("k") % 3).cast("string")

    def choose(**of):
        """The value of the line's kind; the others aren't made."""
        chosen = F.lit(None).cast("string")
        for name, v in reversed(of.items()):
            chosen = F.when(F.col("kind") == name, v if not isinstance(v, str) else F.lit(v)).otherwise(chosen)
        return chosen

    channel = choose(route="request", sql="doctrine", cache="cache", http="http_client", sent="messenger", handled="messenger", command="console", error="request", deprecation="php")
    level = choose(route="INFO", sql="DEBUG", cache="INFO", http="INFO", sent="INFO", handled="INFO", command="DEBUG", error="CRITICAL", deprecation="INFO")
    url = text("https://user:pw@API.p", k3, ".test/v1/items/", s("event_id"), "?key=secret")
    message = choose(
        route=text('Matched route "r', (F.col("user_id") % 8).cast("string"), '".'),
        sql="Executing statement",
        cache=text('Lock acquired, now computing item "item_', s("k"), '_view"'),
        http=text('Response: "200 ', url, '" 0.5 seconds'),
        sent=text("Sending message App\\Message\\M", k4, " with async sender"),
        handled=text("App\\Message\\M", k4, " was handled successfully (acknowledging to transport)."),
        command=text('Command "app:job', k3, ' --all" exited with code "', (F.col("k") % 2).cast("string"), '"'),
        error=text("Uncaught PHP Exception App\\E", k4, ': "Item ', s("event_id"), ' missing" at X.php line ', s("k")),
        deprecation=text("User Deprecated: Call number ", s("event_id"), " of old", k5, " is deprecated"),
    )
    fields = {
        "duration_ms": F.when(F.col("kind") == "route", F.col("value")),
        "route": F.when(F.col("kind") == "route", text("r", (F.col("user_id") % 8).cast("string"))),
        "status": F.when(F.col("kind") == "route", code),
        "sql": F.when(F.col("kind") == "sql", text("SELECT *\n  FROM t", k5, " WHERE id = ?")),
        "http_method": F.when(F.col("kind") == "http", "get"),
        "http_code": F.when(F.col("kind") == "http", code),
        "total_time": F.when(F.col("kind") == "http", F.col("value") / 1000),
        "class": F.when(F.col("kind").isin("sent", "handled"), text("App\\Message\\M", k4)),
        "message_id": F.when(F.col("kind").isin("sent", "handled"), F.col("user_id")),
        "exception": F.when(F.col("kind") == "error", text("[object] (App\\E", k4, "(code: 0): gone at /src/X.php:", s("k"), ")")),
    }
    context = F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    extra = F.to_json(F.struct(token.alias("token")))
    when = text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "+00:00")
    line = text("[", when, "] ", channel, ".", level, ": ", message, " ", context, " ", extra)
    raw = F.to_json(F.struct(message.alias("message"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("context"), level.alias("level_name"), channel.alias("channel"), when.alias("datetime"), F.struct(token.alias("token")).alias("extra")))
    return e.select(F.lit(0).alias("source"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 2 == 0, line).otherwise(raw).alias("value"))
