"""HTML tree rules, listing round trip details, task-stream decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitlens.operators import extract as E
from admitlens.streaming import tasks as T


def _el(spark, html, tag, **kw):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return E.explode_elements(pages, tag, **kw).orderBy("pos").collect()


def test_unclosed_row_nests_the_next(spark):
    rows = _el(spark, "<table><tr><td>a</td><tr><td>b</td></tr></table>", "tr")
    assert [r.text for r in rows] == ["ab", "b"]


def test_stray_end_tag_ignored_and_script_text_skipped(spark):
    html = ("<div><p>x</span>y</p><script>var t='</p>';</script><!-- c --><p> z <b>w</b></p>"
            "<br><p>&amp;q</p></div>")
    rows = _el(spark, html, "p")
    assert [r.text for r in rows] == ["xy", "zw", "&q"]
    assert rows[1].nodes == ["z", "w"]


def test_comment_separator_parity(spark):
    html = ("<table><tr><td><div class='tw-font-medium tw-text-gray-900 tw-text-sm'>U</div></td>"
            "<td><span>P</span><span>D</span></td><td>Jan 1, 2025</td><td>Accepted on 2 Feb</td>"
            "<td><a href='/r/1'>go</a></td></tr><tr><td><div class='tw-inline-flex'>Fall 2026"
            "</div><div class='tw-inline-flex'>GRE 3 digits? no</div></td></tr>"
            "<tr><td><p>one <b>two</b></p></td></tr></table>")
    pages = spark.createDataFrame([(1, "x", html)], "page_id long, url string, html string")
    a = E.extract_listing(pages, "https://h.test/a/b", comment_separator="p").first()
    b = E.extract_listing(pages, "https://h.test/a/b").first()
    assert a.comment == "oneptwo"
    assert b.comment == "one two"
    assert (b.university, b.program, b.degree_type, b.status, b.status_date) == \
        ("U", "P", "D", "Accepted", "2 Feb")
    assert b.url == "https://h.test/r/1" and b.semester == "Fall 2026"
    assert b.gre is None and b.bad_fields == 1


def test_null_page_id_and_a_page_that_fails(spark, monkeypatch):
    row = ("<tr><td><div class='tw-font-medium tw-text-gray-900 tw-text-sm'>U</div></td></tr>")
    pages = spark.createDataFrame([(None, "x", row), (2**60 + 1, "x", row), (3, "x", None), (4, "x", "<p>no rows</p>"),
                                   (5, "x", "FAIL" + row)], "page_id long, url string, html string")

    def explode(html, tag, with_desc, whole=E._explode_page):
        if html and html.startswith("FAIL"):
            raise RuntimeError("broken page")
        return whole(html, tag, with_desc)

    monkeypatch.setattr(E, "_explode_page", explode)
    got = {r.page_id: r.university for r in E.extract_listing(pages).collect()}
    assert got == {None: "U", 2**60 + 1: "U"}
    issues = {r.page_id: (r.rows, r.records, r.failure) for r in E.extraction_issues(pages).collect()}
    assert issues[2**60 + 1] == (1, 1, None) and issues[3] == issues[4] == (0, 0, None)
    assert issues[5] == (0, 0, "RuntimeError: broken page") and issues[None] == (1, 1, None)


def test_unclosed_rows_stay_bounded(spark):
    row = ("<tr><td><div class='tw-font-medium tw-text-gray-900 tw-text-sm'>U{0}</div></td><td><span>P</span><span>D</span>"
           "<td>Jan<td>Accepted<div class='tw-inline-flex'>GPA 3.5</div><p>c")
    pages = spark.createDataFrame([(1, "x", "<table>" + "".join(row.format(i) for i in range(400)))],
                                  "page_id long, url string, html string")
    got = E.extract_listing(pages).orderBy("record_no").collect()
    assert [r.university for r in got] == [f"U{i}" for i in range(400)]
    assert sum(len(x["descendants"]) for x in E._explode_page(pages.first().html, "tr", "listing")) < 100_000


def test_decode_tells_bad_json_from_empty_object(spark):
    msgs = spark.createDataFrame([('{"kind": "x", "payload": {"a": 1}}',), ("{}",),
                                  ("not valid json{{{",), ("[1]",), ('"text"',)], "value string")
    got = [(r.status, r.kind, r.payload) for r in T.decode_tasks(msgs).collect()]
    assert got == [("ok", "x", '{"a":1}'), ("ok", "", "{}"), ("malformed", None, None),
                   ("malformed", None, None), ("malformed", None, None)]


def test_task_message_shape(spark):
    df = spark.createDataFrame([("scrape_new_data", None)], "kind string, payload string") \
        .withColumn("ts", F.lit("2025-01-01 10:00:00").cast("timestamp_ntz"))
    v = T.encode_tasks(df, "kind", "ts", "payload").first().value
    assert v == '{"kind":"scrape_new_data","ts":"2025-01-01T10:00:00","payload":{}}'


def test_one_file_a_batch_lists_every_batch(spark, tmp_path):
    src, progress = str(tmp_path / "in"), str(tmp_path / "p")
    spark.range(0, 12, 1, 3).selectExpr("""concat('{"kind": "a", "n": ', id, '}') AS value""").write.option(
        "maxRecordsPerFile", 1).text(src)
    T.consume(spark, src, {"a": lambda df, b: None}, str(tmp_path / "d"), str(tmp_path / "c"), progress_path=progress)
    assert sorted(tuple(r) for r in T.read_progress(spark, progress).collect()) == [(i, 1) for i in range(12)]


def test_kinds_run_in_message_order_and_only_when_met(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([('{"kind": "b"}',), ('{"kind": "a"}',), ('{"kind": "bad"}',), ('{"kind": "b"}',)],
                          "value string").coalesce(1).write.text(src)
    ran, log = [], []

    def fail(df, b):
        raise RuntimeError("no")

    handlers = {"a": lambda df, b: ran.append(("a", df.count())), "never": lambda df, b: ran.append("never"),
                "b": lambda df, b: ran.append(("b", df.count())), "bad": fail}
    progress = str(tmp_path / "p")
    T.consume(spark, src, handlers, str(tmp_path / "d"), str(tmp_path / "c"), log=log, progress_path=progress)
    assert ran == [("b", 1), ("a", 1), ("b", 1)] and [x[1] for x in log] == ["bad"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "d")).collect()] == ["handler_failed"]
    assert [tuple(r) for r in T.read_progress(spark, progress).collect()] == [(0, 4)]


def test_dead_letters_are_not_duplicated_on_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("bad{",), ('{"kind": "nope"}',), ('{"kind": "ok"}',)], "value string") \
        .coalesce(1).write.text(src)
    dead = str(tmp_path / "dead")
    handled = []
    for ck in ("c1", "c2"):  # a replay with a fresh checkpoint re-runs batch 0
        T.consume(spark, src, {"ok": lambda df, b: handled.append(df.count())}, dead,
                  str(tmp_path / ck))
    got = sorted(r.reason for r in spark.read.parquet(dead).collect())
    assert got == ["malformed", "unknown_kind"]
    assert handled == [1, 1]


def test_resolve_url_matches_urljoin(spark):
    from urllib.parse import urljoin

    from admitlens.functions.records import resolve_url

    base = "https://a.test/x/y/z?q=1#f"
    hrefs = ["/r/1", "../b", "./c", "?p=2", "#frag", "//cdn.test/x", "mailto:me@x", "",
             "https://b.test/k", "http://c.test/./d/../e", "rel/path", "/a/../b", None]
    df = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    got = [r[0] for r in df.select(resolve_url(F.col("base"), F.col("href"))).collect()]
    assert got == [None if h is None else urljoin(base, h) for h in hrefs]


def _tree_rows(tree):
    tree.close_to(tree.root)
    return [(n.tag, n.attrs, n.nth, n.end, tree.texts[n.text:n.text_end]) for n in tree.order], tree.texts


def test_plain_markup_gives_the_parsers_tree():
    """Random markup: what the scan takes is the standard parser's tree; the rest is left to it."""
    import random

    rnd = random.Random(5)
    tokens = ["<tr>", "</tr>", "<TD class='a b'>", "</td >", "<p>", "</p>", "<br>", "<br/>", "<div id=\"x\" hidden>", "</div>",
              "<a href='/r?a=1'>", "</a>", " one ", "t&amp;wo", "&lt;b&gt;", "&nbsp;", "&copy x", "<!-- c <p> -->", "<!-- a--b -->", "<!DOCTYPE html>",
              "<template>", "</template>", "<span\n class=\"q\"\n>", "</span>", "<x-y z:w=\"1\">", "</x-y>", "<img src=\"i.png\" />", "\n", "<b/>", "</nope>",
              "<a href=/bare>", "<a href=\"/q&amp;r\">", "<script>if (a < b) '</p>'</script>", "<title>T <b></title>", " < ", "<3", "<p class=\"open>", "&#65", "<>"]
    taken = 0
    for i in range(4000):
        html = "".join(rnd.choice(tokens[:30] if i % 3 else tokens) for _ in range(rnd.randint(0, 25)))
        plain = E._plain_tree(html)
        b = E._TreeBuilder()
        b.feed(html)
        b.close()
        if plain is not None:
            taken += 1
            assert _tree_rows(plain) == _tree_rows(b.tree), html
    assert taken > 1500


def test_a_listing_page_parses_fast():
    """At most 25 ms for a page of 80 records, as the best of several runs."""
    import time

    row = ("<tr><td><div class=\"tw-font-medium tw-text-gray-900 tw-text-sm\">U{0}</div></td><td><span>P</span><span>D</span></td><td>Jan 1</td>"
           "<td>Accepted on 2 Feb</td><td><a href=\"/r/{0}\">go</a></td></tr><tr><td><div class=\"tw-inline-flex\">GPA 3.5</div></td></tr>")
    page = "<table>" + "".join(row.format(i) for i in range(80)) + "</table>"
    best = 1.0
    for _ in range(8):
        t0 = time.perf_counter()
        assert len(E._explode_page(page, "tr", "listing")) == 160
        best = min(best, time.perf_counter() - t0)
    assert best < 0.025


def test_plain_tags_are_cut_as_the_parser_reads_them():
    import random

    bits = ["<", "<a>", "</a>", "<a href='x>y'>", '<a HREF="q" b>', "<td>", "</td>", "<tr class='a b'>", "</tr>", "text", "&amp;", " ", "<br/>",
            "<p/>", "<!doctype html>", "<!-- c -->", ">", "</p >", "< b>", "<a b=c>", "<template>x</template>", '<a title="a<b">', "&lt", "<p"]

    def dump(tree):
        tree.close_to(tree.root)
        return [(n.tag, n.attrs, n.nth, n.at, n.end, n.text, n.text_end, n.parent.at) for n in tree.order], tree.texts

    rnd, seen = random.Random(1), 0
    for _ in range(5000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        tree = E._simple_tree(html)
        if tree is not None:
            seen += 1
            parser = E._TreeBuilder()
            parser.feed(html)
            parser.close()
            assert dump(tree) == dump(parser.tree), html
    assert seen > 500


def test_elements_come_whole_in_every_mode(spark):
    """Pages in many batches: with all descendants, none, or those of listings."""
    html = "<tr class='x y'><td>a<p>b</p></td><td><span>c</span><a href='/1'>d</a></td></tr><tr></tr>"
    pages = spark.createDataFrame([(i, html) for i in range(5)] + [(5, None), (6, "")], "page_id long, html string")
    for mode in (True, False, "listing"):
        got = {r.page_id: r["items"] for r in E.page_elements(pages, "tr", with_descendants=mode).collect()}
        rows = E._explode_page(html, "tr", mode)
        assert got[5] == got[6] == [] and len(got) == 7
        for i in range(5):
            assert [x.asDict(True) for x in got[i]] == [{**r, "classes": list(r["classes"]), "descendants": r["descendants"] and [
                {**d, "classes": list(d["classes"])} for d in r["descendants"]] if r["descendants"] is not None else None} for r in rows]



def test_a_page_as_columns_is_its_tree():
    """Random listing markup: what is read of rows and cells is the same from the columns
    that are cut at the tags and from the standard parser's tree."""
    import random

    marker = "<div class='tw-font-medium tw-text-gray-900 tw-text-sm'>"
    bits = ["<tr>", "</tr>", "<tr class='a b'>", "<td>", "</td>", "<td class='tw-inline-flex'>", "<td/>", marker, "</div>", "<div class='tw-inline-flex q'>",
            "<span>", "</span>", "<p>", "</p>", "<a href='/1'>", "<a>", "</a>", "<br>", "<template>", "</template>", "text", " u ", "&amp;", "<table>", "</table>"]
    rnd, seen = random.Random(7), 0
    for _ in range(3000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        assert E._simple_page(html) is not None, html
        by_parser = html + "<!-- -- -->"        # no plain markup: left to the parser
        assert E._simple_page(by_parser) is None
        for mode in ("listing", True, False):
            for tag in ("tr", "td", "a"):
                got = E._explode_page(html, tag, mode)
                assert got == E._explode_page(by_parser, tag, mode), (html, tag, mode)
                seen += len(got)
    assert seen > 10_000


def test_the_collector_rests_while_pages_are_parsed(spark, monkeypatch):
    """The elements of a page hold no cycles: none of them waits for the collector."""
    import gc

    html = "<table>" + "<tr><td><div class='tw-inline-flex'>GPA 3.5</div></td></tr>" * 50 + "</table>"

    def explode(html, tag, with_desc, whole=E._explode_page):
        if gc.isenabled():
            raise RuntimeError("the collector runs")
        return whole(html, tag, with_desc)

    monkeypatch.setattr(E, "_explode_page", explode)
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.error for r in E.page_elements(pages, "tr").collect()] == [None]
    monkeypatch.undo()
    gc.collect()
    gc.disable()
    try:
        E._explode_page(html, "tr", "listing")
        assert gc.collect() < 20
    finally:
        gc.enable()


def test_unreadable_badges_are_counted_by_kind(spark):
    from admitlens.functions.records import badge_issue_count

    badges = [["GPA 3.5", "GPA n/a", "GRE 167", "GRE x", "GRE V 150", "GRE V nan", "GRE AW 4.5", "GRE AW -", "Fall 2026", "other", None], [], None]
    df = spark.createDataFrame([(b,) for b in badges], "b array<string>")
    assert [r[0] for r in df.select(badge_issue_count(F.col("b"))).collect()] == [4, 0, None]
