"""Top-k, pages, conversations, the pipeline and the queries with SQL."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from admitlens.llm import chat, html_text, queries, topk

TABLES = "documents embeddings pages benchmark labels conversations".split()


def slow_top(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, qv in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != qi and len(v) == len(qv))[:k]
        out |= {(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("query_block", [4096, 3])
def test_top_k_is_that_of_all_scores(spark, query_block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]                 # one very common vector: ties
    rows += [(50_000, [0.5, 0.5, 0.5, 0.5]), (50_000, [0.5, 0.5, 0.5, 0.5]), (7, None), (8, [1.0, None, 0.0, 0.0]),
             (9, [float("nan"), 0.0, 0.0, 0.0]), (10, [float("inf")] * 4), (None, [9.0] * 4), (100_000, [1.0, 2.0]),
             (100_001, [1.0, 2.0]), (150_000, []), (200_000, [3e10, 3e10, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, score string, q string")
    v = topk.quantised(df.repartition(4))
    got = topk.exact_top_k(v, v.where("vec_id % 50 = 0"), 5, query_block)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == slow_top(rows, 5)
    empty = topk.quantised(df.where("false"))
    assert topk.exact_top_k(empty, empty).count() == 0
    assert topk.exact_top_k(v, empty).count() == 0


PAGES = [
    ("article", "<html><head><title>t</title></head><body><nav><a href=/x>Menu</a></nav><header>Top</header>"
     "<article><h1>T &amp; U</h1><p>One <b>two</b>\n three<p>four<br>five</p><aside>side</aside><form>f</form>"
     "<div class='comments'><p>reader</p></div><script>var a='</p>';</script><ul><li>a<li>b</ul></article>"
     "<footer>&copy; foot</footer></body>", "T & U\n\nOne two three\n\nfour five\n\na\n\nb"),
    ("none", "<body><div id=content><p>x &lt;y&gt; &eacute;&nbsp;z</p>tail</div><div class=sidebar>s</div></body>", "x <y> é z\n\ntail"),
    ("unclosed", "<article><p><b>bold<br><p>next <i>it", "bold\n\nnext it"),
    ("comment", "<article><p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
    ("quotes", "<article><p title=\"a>b\" data-x='</p>'>in</p><a href=\"x>out</article>", "in\n\nout"),
    ("empty", "", ""), ("null", None, ""), ("text", "just text & more", "just text & more"), ("lt", "<article>1 < 2 <3</article>", "1 < 2 <3"),
    ("notice", "<article><p>keep</p><div role=alert>note</div><p hidden>h</p><div style='display: none'>d</div></article>", "keep"),
]


def test_main_text_of_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.test/", h, "x", "y", "z") for i, (_, h, _) in enumerate(PAGES)] +
                               [(0, "http://h0.test/", PAGES[0][1], "x", "y", "z"), (None, None, "<article>n</article>", "", "", "")],
                               "page_id long, url string, html string, text string, k string, template string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()]
    want = [(i, t, len(t)) for i, (_, _, t) in enumerate(PAGES)] + [(0, PAGES[0][2], len(PAGES[0][2])), (None, "n", 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert html_text.extract(df.where("false")).count() == 0


def test_recurring_subtrees_of_a_host_go(spark):
    """Boxes that say nothing of themselves go by recurring on their host alone;
    a passage of an article stays however often it recurs."""
    box = "<div><span>Buy</span> our things</div>"
    pages = [(i, "http://A.test:80/p", f"<body>{box}<article><p>every page says this</p>{box}<p>own {i}</p></article>{box}</body>") for i in range(12)]
    pages += [(100 + i, f"http://b{i}.test/", f"<body>{box}<p>b{i}</p></body>") for i in range(6)]
    pages += [(200, "http://c.test/", f"<body>{box}<p>same</p></body>")] * 30          # one page, repeated
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"every page says this\n\nown {i}" for i in range(12))
    assert all(got[100 + i] == f"Buy our things\n\nb{i}" for i in range(6))
    assert got[200] == "Buy our things\n\nsame"


def test_article_text_stays_in_any_container_and_on_any_copy(spark):
    """Copies of a page under other URLs count once, and no element that holds
    running text of the article goes, with an article element or without."""
    story = "<div><p>A story that many pages hold.</p><p>Its end.</p></div>"
    said = "A story that many pages hold.\n\nIts end."
    shared = "<section><p>s</p></section><ul><li>a</li></ul><table><tr><td>c</td></tr></table><div><div><p>d</p></div></div>"
    box = "<div><span>Buy</span> our things</div>"
    pages = [(i, "http://a.test/p", f"<body>{box}<article>{story}</article></body>") for i in range(60)]
    pages += [(100 + i, "http://b.test/p", f"<body>{box}{story}<div>seen {i}</div></body>") for i in range(60)]
    pages += [(200 + i, "http://c.test/p", f"<body><article>{box}{shared}<p>own {i}</p></article></body>") for i in range(60)]
    pages += [(300 + i, "http://d.test/p", f"<body>{box}<div>{shared}<p>own story number {i}</p></div></body>") for i in range(60)]
    pages += [(400 + i, "http://e.test/p", f"<body>{box}<article>{story if i < 4 else '<p>own %d</p>' % i}</article></body>") for i in range(40)]
    pages = [(i, f"{u}{i}", h) for i, u, h in pages]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Buy our things\n\n{said}" or got[i] == said for i in range(60))
    assert all(said in got[100 + i] for i in range(60))
    assert all(got[200 + i] == f"s\n\na\n\nc\n\nd\n\nown {i}" for i in range(60))
    assert all(got[300 + i] == f"s\n\na\n\nc\n\nd\n\nown story number {i}" for i in range(60))
    assert all(got[400 + i] == (said if i < 4 else f"own {i}") for i in range(40))


@pytest.mark.parametrize("inside, want", [
    ('<h2 id="related-work">Related work</h2><p>a</p>', "Related work\n\na"),
    ('<section id="social-history"><p>a</p></section>', "a"),
    ('<div class="notice-period">Three months.</div>', "Three months."),
    ('<p class="comment-free">a</p>', "a"),
    ('<h1 class="header">T</h1><p>a</p>', "T\n\na"),
    ('<p>a</p><div class="related-posts"><p>x</p></div><ul id="comments"><li>x</li></ul>', "a"),
    ('<p>a</p><div class="cookie-notice big">x</div><div class="ad-3">x</div><p class="notice">x</p>', "a"),
    ('<p>a</p><div class="col user-comments"><p>x</p></div>', "a"),
    ("<p>a</p><svg><path d='m'><p>b</p>", "a\n\nb"),
    ("<p>a</p><textarea>typed<p>b</p>", "a\n\nb"),
    ("<p>a</p><svg/><p>b</p><select><option>x<option>y</div><p>c</p>", "a\n\nb\n\nc"),
    ("<p>a</p><script>var x;<p>b</p><script>if (1 < 2) x;</script>", "a"),
])
def test_names_in_an_article_count_whole(inside, want):
    for around in ("article", "main"):
        assert html_text.main_text(f"<body><{around}>{inside}</{around}></body>") == want


def test_odd_pages_take_linear_time():
    import time

    for page in ("<div>" * 20_000, "<a href='" * 20_000, "<p" * 50_000, "</x>" * 50_000, "<!-- " * 50_000, "<b>" * 3_000 + "</p>" * 20_000,
                 "&" * 100_000, "<tr>" * 20_000 + "x", "<svg>" * 20_000, "<svg/>" * 20_000):
        t = time.time()
        html_text.main_text("<article>" + page)
        html_text.subtree_hashes(page)
        assert time.time() - t < 20


def test_preference_formatting(spark):
    u, a = {"role": "user"}, {"role": "assistant"}
    t = [(1, [u | {"text": "q"}, a | {"text": "yes"}], [u | {"text": "q"}, a | {"text": "no <|end|>"}]),
         (2, [u | {"text": "q"}], [u | {"text": "q"}]), (3, None, [a | {"text": "r"}]), (4, [], []),
         (5, [a | {"text": "x"}, u | {"text": "y"}], [u | {"text": "x"}, a | {"text": None}]),
         (6, [u | {"text": "q"}, a | {"text": "b"}], [u | {"text": "q"}])]
    df = spark.createDataFrame(t, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in chat.preferences(df).collect()}
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n" and got[1]["prompt_turns"] == 1 and got[1]["valid"]
    assert got[1]["rejected"] == "<|assistant|>\nno < |end|><|end|>\n"
    assert [(s["text"], s["learn"]) for s in got[1]["chosen_segments"]] == [("<|assistant|>\n", False), ("yes<|end|>\n", True)]
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["valid"]) == ("", "", False)
    assert not got[3]["valid"] and not got[4]["valid"] and not got[6]["valid"] and got[4]["prompt"] == ""
    assert got[5]["prompt"] == "" and got[5]["valid"]
    for r in got.values():
        assert r["chosen"] == "".join(s["text"] or "" for s in r["chosen_segments"])


def test_exchanged_replies_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 3, "assistant", None),
            (2, 4, "user", "after"), (3, 0, "user", "alone"), (None, 0, "assistant", "x"), (9000, None, None, "n"), (9000, 1, "assistant", "z")]
    df = spark.createDataFrame([r + ("e",) for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["pair_id"]: r for r in chat.preferences(chat.exchanged_replies(df)).collect()}
    assert set(got) == {1, 2, 9000}
    assert got[1]["prompt_turns"] == 2 and got[1]["rejected"] == "<|assistant|>\n<|end|>\n"
    assert got[2]["rejected"] == "<|assistant|>\nb<|end|>\n" and "after" not in got[2]["chosen"]
    assert not got[9000]["valid"] and got[9000]["prompt"].startswith("<||>\nn")
    assert chat.preferences(chat.exchanged_replies(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_small)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, rel.fetchall()))


def test_a_query_for_each_operator(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_native_operators_run_no_python(spark, sf_small):
    for name in ("op8_mixing", "op10_preferences"):
        plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_stages_take_effect(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_small), name)
        assert docs.columns == first
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == counts[4]
    whole = corpus_pipeline.run(spark, sf_small)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))


def test_pipeline_of_no_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_small), name)
    assert docs.count() == 0
