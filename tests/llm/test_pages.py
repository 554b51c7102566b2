"""Pages whose main content the template of their host could hide."""

from logscope.llm import op7_wrappers as op7


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in op7.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_each_page_is_judged_for_itself(spark):
    long = "A paragraph with more than forty characters of text in it, number"
    art = lambda k: f"<html><body><nav>Menu</nav><article><h1>Head {k}</h1><p>{long} {k}</p></article><footer>Foot</footer></body></html>"
    div = lambda k: f"<html><body><nav>Menu</nav><div class=post><h2>Intro</h2><p>{long} {k}</p><p>Short</p></div><footer>Foot</footer></body></html>"
    rows = [(k, "http://a.test/x", art(k)) for k in range(8)] + [(8, "http://a.test/y", div(8))]
    rows += [(9, "http://b.test/", div(9)), (10, None, div(10)), (11, "/rel", art(11)), (12, "http://b.test/", div(9))]
    rows += [(20 + k, "http://c.test/", f"<div>Welcome to this site</div><p>{long} {k}</p>") for k in range(9)]
    got = texts(spark, rows)
    for k in (*range(8), 11):
        assert got[k] == f"Head {k}\n{long} {k}"
    for k in (8, 9, 10):
        assert got[k] == f"Intro\n{long} {k}\nShort"
    assert got[12] == got[9]
    assert all(got[20 + k] == f"{long} {k}" for k in range(9))  # what many pages share stays the template's


def test_elements_without_an_end_tag_hide_nothing(spark):
    cases = ["<svg width='1' />", "<math/>", "<svg-icon name=x></svg-icon>", "<style-guide>", "<svg>", "<iframe src=x>", "<svg/><svg><text>no</text></svg>", "<noscript>no</noscript>", "<template><p>no</p></template>", "<svg/>" * 5_000 + "<svg>" * 5_000]
    rows = [(k, f"http://h{k}.test/", f"<article><p>Before it</p>{c}<p>After it</p></article>") for k, c in enumerate(cases)]
    rows.append((99, "http://z.test/", "<article><p>Before it</p><script>var x = '<p>no</p>'"))
    got = texts(spark, rows)
    assert got.pop(99) == "Before it"
    assert got == {k: "Before it\nAfter it" for k in range(len(cases))}
