"""The generated log fills every table, and doesn't depend on its partitions."""

from logscope.operators import tables
from logscope.operators.analysis import Analysis, Options
from logscope.operators.assemble import assemble
from logscope.sources.generate import ROUTES, generate


def test_generated_log_fills_every_table(spark):
    log = generate(spark, 1500)
    assert sorted(map(tuple, generate(spark, 300, partitions=3).collect())) == sorted(map(tuple, generate(spark, 300, partitions=7).collect()))
    entries, skipped = assemble(log)
    a = Analysis(entries, Options(duration_key="duration_ms", correlate_key="token"))
    t = tables.totals(a).first()
    assert skipped.count() == 0 and t["requests"] == t["timed"] > 1300 and 0.02 < t["request_error_rate"] < 0.1
    assert {r["endpoint"] for r in tables.endpoints(a).collect()} == set(ROUTES)
    for table in (tables.errors, tables.deprecations, tables.nplus1, tables.commands, tables.cache_keys, tables.messages, tables.outbound, tables.channels):
        assert table(a).count() > 0
    assert all("#2 /srv/src/Lending.php(92)" in r["message"] for r in a.lines.where("exception is not null").collect())
    (m,) = tables.messages(a).collect()
    assert 0 < m["waiting"] < m["dispatched"] and m["paired"] > 0
    c = tables.commands(a).agg({"failed": "sum", "threw": "sum"}).first()
    assert c[0] > 0 and c[1] > 0
