"""A seeded synthetic log (S18) of a lending library's web application.

What it must hold, so that every table of a report has rows: requests on a few routes of
very unequal frequency and duration; statements, some of them repeated once per row read; calls
to another service that are slow or fail; messages in both vocabularies, of which a part is
never handled; cache misses that are computed or waited for; commands that succeed, fail or
throw; deprecations; failing requests whose exception goes on over several lines; and lines in
the text and the JSON form.  Each draw is a hash of the request's number, the seed and a
name, so the log doesn't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Routes from the most to the least frequent; each is asked for half as often as the one before
#: and takes half as long again.
ROUTES = ("shelf", "book", "find", "reader", "loan", "fine", "stocktaking")
FASTEST_MS, START_MS, APART_MS = 18.0, 1_750_000_000_000, 40
#: Room for the lines of one request in the order of lines.
LINES = 256


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _line(after: Column | int, channel: str, level: Column | str, message: Column | str, **context: Column | str | int) -> Column:
    of = {k: v if isinstance(v, Column) else F.lit(v) for k, v in context.items()}
    fields = F.to_json(F.struct(*(v.alias(k) for k, v in of.items()))) if of else F.lit("{}")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(after).cast("long").alias("after"), F.lit(channel).alias("channel"), as_column(level).alias("level"), as_column(message).alias("message"), fields.alias("context"))


def generate(spark: SparkSession, requests: int, seed: int = 1, failing: float = 0.05, repeating: float = 0.1, json_share: float = 0.25, durations: bool = True, tokens: bool = True, partitions: int | None = None) -> DataFrame:
    """source, ord, value: all lines of ``requests`` requests."""
    def draw(name: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 20)) / float(1 << 20)

    none = F.array().cast("array<struct<after:bigint,channel:string,level:string,message:string,context:string>>")
    some = lambda when, *lines: F.when(when, F.array(*lines)).otherwise(none)
    # the rank of the route: as many as a fair coin falls on one side in a row
    rank = F.least(F.floor(-F.log2(1 - draw("route"))), F.lit(len(ROUTES) - 1)).cast("int")
    base = spark.range(requests, numPartitions=partitions) if partitions else spark.range(requests)
    r = base.select("id", rank.alias("rank"))
    r = r.withColumns({
        "route": F.element_at(F.array(*map(F.lit, ROUTES)), F.col("rank") + 1),
        "ms": F.round(F.lit(FASTEST_MS) * F.pow(F.lit(1.5), "rank") * F.exp((draw("a") + draw("b") + draw("c") - 1.5) * 2), 2),
        "fails": draw("fails") < failing, "item": F.floor(draw("item") * 5000).cast("long").cast("string"),
    })
    end, item, route = F.ceil("ms"), F.col("item"), F.col("route")
    timed = {"duration_ms": F.col("ms")} if durations else {}
    status = F.when(F.col("fails"), 500).when(draw("lost") < 0.03, 404).otherwise(200)
    exception = _text("[object] (Library\\Lending\\Refused(code: 0): copy ", item, " is lent at /srv/src/Lending.php:", (F.col("rank") + 40).cast("string"), ")")
    statement = F.array(_line(2, "doctrine", "DEBUG", "Executing statement", sql="SELECT * FROM copies WHERE book_id = ? AND lent = 0"))
    times = F.when(draw("repeats") < repeating, 12 + F.floor(draw("times") * 30)).otherwise(1 + F.floor(draw("times") * 3)).cast("int")
    late = draw("late") < 0.2
    number = F.when(draw("command") < 0.7, 0).otherwise(F.floor(draw("code") * 3)).cast("int")
    job = _text("library:", F.element_at(F.array(*map(F.lit, ("remind", "index", "tidy"))), (F.floor(draw("job") * 3) + 1).cast("int")))
    letter, id_ = "Library\\Letter\\Reminder", F.sha1(_text("letter", F.col("id").cast("string"))).substr(1, 8)
    is_job, sends = draw("job?") < 0.02, draw("sends") < 0.15
    request = F.concat(
        F.array(_line(0, "request", "INFO", _text('Matched route "', route, '".'), route=route, request_uri=_text("/", route, "/", item), method=F.when(F.col("rank") > 3, "POST").otherwise("GET"))),
        F.flatten(F.array_repeat(statement, times)),
        some(draw("misses") < 0.1, _line(3, "cache", "INFO", F.when(draw("waits") < 0.3, _text('Item "cover_', item, '" is locked, waiting for it to be released')).otherwise(_text('Lock acquired, now computing item "cover_', item, '"')))),
        some(draw("calls") < 0.25, _line(4, "http_client", "INFO", _text('Request: "GET https://covers.example.test/v2/', item, '"')), _line(F.when(late, 700).otherwise(30), "http_client", "INFO", _text('Response: "', F.when(late, "503").otherwise("200"), " https://covers.example.test/v2/", item, '?key=hidden" ', F.when(late, "0.7").otherwise("0.03"), " seconds"), http_method="GET", http_code=F.when(late, 503).otherwise(200), total_time=F.when(late, 0.7).otherwise(0.03))),
        some(sends, _line(5, "messenger", "INFO", f"Sending message {letter} with post sender", message_id=id_, **{"class": letter}), _line(5, "messenger_audit", "INFO", _text("[", id_, "] Sent ", letter))),
        some(sends & (draw("handled") < 0.8), _line(400, "messenger", "INFO", f"{letter} was handled successfully (acknowledging to transport).", message_id=id_, **{"class": letter}), _line(400, "messenger_audit", "INFO", _text("[", id_, "] Received ", letter))),
        some(draw("old") < 0.05, _line(6, "php", "INFO", _text("User Deprecated: Parameter ", (F.col("rank") % 3).cast("string"), " of Shelf::sort() is deprecated"))),
        some(F.col("fails"), _line(end, "request", "CRITICAL", _text('Uncaught PHP Exception Library\\Lending\\Refused: "copy ', item, ' is lent"'), exception=exception), *(F.struct(end.cast("long").alias("after"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("level"), F.lit(f"  #{k} /srv/src/Lending.php({90 + k}): Library\\Lending->lend()").alias("message"), F.lit("{}").alias("context")) for k in range(3))),
        F.array(_line(end, "request", "INFO", "Request finished", route=route, status=status, **timed)),
    )
    command = F.concat(
        F.array(_line(0, "doctrine", "DEBUG", "Executing statement", sql="UPDATE loans SET reminded = 1 WHERE id = ?")),
        some(number == 2, _line(end, "console", "CRITICAL", _text('Error thrown while running command "', job, '". Message: "no paper"'), command=job)),
        F.array(_line(end + 1, "console", "DEBUG", _text('Command "', job, '" exited with code "', number.cast("string"), '"'), command=job, code=number)),
    )
    lines = r.withColumn("lines", F.when(is_job, command).otherwise(request)).select("id", F.posexplode("lines").alias("pos", "x")).select("id", "pos", "x.*")
    ts = F.timestamp_millis(F.lit(START_MS) + F.col("id") * APART_MS + F.col("after"))
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    extra = F.to_json(F.struct(F.sha1(_text(str(seed), "-", F.col("id").cast("string"))).substr(1, 16).alias("token"))) if tokens else F.lit("[]")
    plain = _text("[", stamp, "] ", F.col("channel"), ".", F.col("level"), ": ", F.col("message"), " ", F.when(F.col("context") == "{}", "[]").otherwise(F.col("context")), " ", extra)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    as_json = _text('{"message":', quoted(F.col("message")), ',"context":', F.col("context"), ',"level_name":', quoted(F.col("level")), ',"channel":', quoted(F.col("channel")), ',"datetime":', quoted(stamp), ',"extra":', extra, "}")
    value = F.when(F.col("channel").isNull(), F.col("message")).when(draw("form") < json_share, as_json).otherwise(plain)
    return lines.select(F.lit(0).alias("source"), (F.col("id") * LINES + F.col("pos")).alias("ord"), value.alias("value"))
