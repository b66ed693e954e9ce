"""Pages read by array steps over a batch: the same elements as a page at a time."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from admitlens.operators import extract as E
from admitlens.operators import extract_batch as B

DESC = pa.list_(pa.struct([("tag", pa.string()), ("nth", pa.int32()), ("cell", pa.int32()), ("classes", pa.list_(pa.string())),
                           ("nodes", pa.list_(pa.string())), ("href", pa.string())]))
MARKER = " class='tw-font-medium tw-text-gray-900 tw-text-sm'"
ATTRS = ["", " class='a b'", " class='tw-inline-flex q'", " href='/1'", " href", ' HREF="/2" ', ' href="/3"', ' class="x  y" href="/4" title="t"',
         ' href="/5" href="/6"', " href=\"\" id='q'", ' title=" href=" href="/é"', " title=' href=\"/8\"'", "\n href=\"/9\"\n"]


def _plain(rows):
    return [{**r, "classes": list(r["classes"]), "descendants": None if r["descendants"] is None else [
        {**d, "classes": list(d["classes"])} for d in r["descendants"]]} for r in rows]


def _same(pages, tag, mode) -> int:
    read, items = B.read_pages(pa.array(pages, pa.string()), tag, mode, DESC)
    got = items.to_pylist() if items is not None else []
    taken = [p for p, r in zip(pages, read) if r]
    assert len(got) == len(taken)
    for page, rows in zip(taken, got):
        assert rows == _plain(E._explode_page(page, tag, mode)), (page, tag, mode)
    return sum(map(len, got))


def _markup(rnd, depth=0) -> str:
    out = []
    for _ in range(rnd.randint(0, 4)):
        k = rnd.random()
        if k < 0.25:
            out.append(rnd.choice(["text", " u ", "&amp;", "\n\xa0", "\x1f", "x &lt y", "é "]))
        elif k < 0.35:
            out.append(rnd.choice(["<br>", "<td/>", "<img src='x'>", "<hr/>", "<p/>", '<a href="/0"/>']))
        elif k < 0.37:
            out.append(rnd.choice(["</p>", "<tr>", "<!-- c -->", "<template>q</template>", "<", "a > b", "<a b=c>", "<title>x</title>", "<!doctype html>"]))
        elif depth < 7:
            name = rnd.choice(["tr", "td", "div", "span", "p", "a", "b", "table"])
            attrs = MARKER if name == "div" and rnd.random() < 0.5 else rnd.choice(ATTRS)
            out.append(f"<{name.upper() if rnd.random() < 0.1 else name}{attrs}>{_markup(rnd, depth + 1)}</{name}>")
    return "".join(out)


def test_a_batch_gives_the_elements_of_its_pages():
    rnd, seen = random.Random(3), 0
    for i in range(250):
        pages = [None, ""] * (i % 3 == 0) + [rnd.choice(["", "<!DOCTYPE html>\n", " \n<!doctype html>", "lead"]) + _markup(rnd) for _ in range(6)] + [""] * (i % 2)
        for mode in ("listing", True, False):
            for tag in ("tr", "td", "a"):
                seen += _same(pages, tag, mode)
    assert seen > 1000


def test_listing_pages_are_read_as_a_batch(monkeypatch):
    """Tags are read once per kind of tag, not once per page, record or link."""
    row = ("<tr><td><div class=\"tw-font-medium tw-text-gray-900 tw-text-sm\">U {0}</div></td><td><span>P &amp; Q</span> <span>D</span></td><td>Jan 1</td>"
           "<td>Accepted on 2 Feb</td><td><a href=\"/r/{0}\">go</a></td></tr><tr><td><div class=\"tw-inline-flex\">GPA 3.5</div></td></tr>\n")
    pages = ["<!DOCTYPE html><html><body><table>" + "".join(row.format(100 * p + i) for i in range(20)) + "</table></body></html>" for p in range(30)]
    read, calls = E._tag, []
    monkeypatch.setattr(E, "_tag", lambda inside: calls.append(inside) or read(inside))
    E._tags.clear()
    assert B.read_pages(pa.array(pages), "tr", "listing", DESC)[0].all()
    assert 0 < len(calls) < 30
    assert _same(pages, "tr", "listing") == 1200


@pytest.mark.parametrize("mode", [True, False, "listing"])
def test_odd_pages_beside_plain_ones_lose_nothing(spark, mode):
    """Plain pages, pages left to the parser, empty and null ones in one batch."""
    html = ["<tr><td>a<p>b</p></td></tr>", "<tr><td>open", None, "", "<!-- c --><tr class='x'></tr>", "lead<tr><td>q</td></tr>", "<p>no rows</p>",
            "<tr><td><tr><td>in</td></tr></td></tr>", "<tr><td>&eacute;&nbsp;</td></tr>"]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1)
    got = {r.page_id: [x.asDict(True) for x in r["items"]] for r in E.page_elements(pages, "tr", with_descendants=mode).collect()}
    assert got == {i: _plain(E._explode_page(h, "tr", mode)) for i, h in enumerate(html)}


def test_large_batches_are_read_in_slices(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "html": ["x" * 100, None, "", "y" * 500, "z", "w" * 300, None]})
    monkeypatch.setattr(E, "OUT_TEXT", 256)
    some = list(E._slices(batch, 1))
    assert pa.Table.from_batches(some).equals(pa.Table.from_batches([batch])) and len(some) > 2
    assert list(E._slices(batch.slice(0, 0), 1)) == []


def test_record_numbers_count_the_starts_of_a_page(spark):
    start = f"<tr><td><div{MARKER}>U</div></td></tr>"
    pages = spark.createDataFrame([(1, f"<table><tr></tr>{start}<tr></tr>{start}{start}<tr></tr></table>"), (2, "<tr></tr>"), (3, start)], "page_id long, html string")
    got = [tuple(r) for r in E.listing_rows(pages).orderBy("page_id", "pos").select("page_id", "pos", "is_start", "record_no").collect()]
    assert got == [(1, 0, False, None), (1, 1, True, 0), (1, 2, False, None), (1, 3, True, 1), (1, 4, True, 2), (1, 5, False, None),
                   (2, 0, False, None), (3, 0, True, 0)]


def test_records_are_shuffled_before_they_become_pages(spark):
    """Rendered pages lie in as many parts as shuffles have, and only records are shuffled."""
    from admitlens.plans.listing import RENDERED, render_listing

    types = {"p_id": "long", "datePosted": "date", **{c: "double" for c in ("gpa", "gre", "gre_v", "gre_aw")}}
    records = spark.range(400).select(*[F.lit(None).cast(types.get(c, "string")).alias(c) if c != "p_id" else F.col("id").alias(c) for c in RENDERED])
    pages = render_listing(records)
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = pages._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "fragment" not in plan[plan.index("Exchange hashpartitioning"):]
    assert sorted(r.page_id for r in pages.collect()) == list(range(5))


def test_a_wave_meets_the_table_once(spark, monkeypatch):
    from admitlens.operators import incremental as I

    pages = spark.range(40).select(F.col("id").alias("page_id"))
    table = spark.range(200, 240).select(F.col("id").alias("p_id"), F.concat(F.lit("u"), F.col("id") - 200 + 90).alias("url"))
    asked, whole = [], I.known_flag
    monkeypatch.setattr(I, "known_flag", lambda *a, **k: asked.append(1) or whole(*a, **k))

    def parse(some):
        return some.select("page_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("record_no")).select(
            "*", F.concat(F.lit("u"), F.col("page_id") * 3 + F.col("record_no")).alias("url"))

    waves = []
    got = I.incremental_pull(pages, parse, table, first_wave=4, waves=waves).collect()
    assert [w[2] for w in waves] == [None, None, None, 30] and len(asked) == len(waves)
    assert sorted((r.p_id, r.url) for r in got) == [(240 + i, f"u{i}") for i in range(90)]
