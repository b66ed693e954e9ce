"""URL filter: parsing and rules by brute force, the model on hosts it has not met."""

from __future__ import annotations

import re

import pytest

from admitlens.llm import queries, url_filter

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path, rules=RULES):
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    return max(fits)[2:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/1", "https://example.com/en",
        "https://www.example.com/en/x?y#z", "https://a.www.example.com/en/x", "https://notexample.com/en/1", "http://x.net/es/", "http://x.net/fr/?q",
        "http://x.net/de/", "http://net/es/1", "http://xnet/es/1", "http://x.com?a/en/", "http://x.com#://y/", "a://b://c/d", "x://É.Com/ü",
        "http://example.com:8080/en/1", "http://.com/", "http://com./", "http://h.test/" + "long/" * 20_000, "https://www.casino-pills.test/en/9"]


def test_hosts_paths_and_rules_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS + URLS[:3])] + [(None, "http://q.com/", "x", 1.0)],
                               "page_id long, url string, host string, score double").repartition(3)
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    examples = spark.createDataFrame(url_filter.LABELLED, "url string, block boolean")
    got = url_filter.judge(df, rules, examples).collect()
    assert len(got) == len(URLS) + 4
    for r in got:
        host, path = slow_parts(URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else "http://q.com/")
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert url_filter.judge(df.where("false"), rules, examples).count() == 0
    none = url_filter.judge(df, rules.where("false"), examples.where("false")).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    with pytest.raises(ValueError):
        url_filter.judge(df, spark.range(url_filter.MAX_RULES + 1).selectExpr("concat('h', id, '/') rule", "'block' verdict"), examples)


def test_long_rule_lists_and_ties():
    rules = {"b.c": [("/x", "allow")], "c": [("/x/y", "block"), ("/", "allow")], "a.b.c": [("", "block")]}
    assert url_filter.fitting_rule(rules, "a.b.c", "/x/y") == ("a.b.c", "block")       # 5 letters each: the nearer host
    assert url_filter.fitting_rule(rules, "q.c", "/x/yz") == ("c/x/y", "block")
    assert url_filter.fitting_rule(rules, "d", "/x") is None


def test_the_same_table_gives_the_same_model(spark):
    examples = spark.createDataFrame(url_filter.LABELLED, "url string, block boolean")
    a, b = url_filter.trained(examples, rounds=20), url_filter.trained(examples.repartition(7), rounds=20)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_urls_of_hosts_not_labelled(spark):
    """Hosts of the kinds to block and others, none of them in the labelled table."""
    got = queries.QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.1")
    kinds = re.compile("pills|casino|bets|spam|adult|ads-")
    rows = got.select("host", "path", "rule", "score", "verdict").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/pages.parquet").count()
    bad = [r for r in rows if kinds.search(r["host"])]
    good = [r for r in rows if not kinds.search(r["host"])]
    assert sum(r["score"] >= 0.5 for r in bad) >= 0.95 * len(bad) > 0
    assert sum(r["score"] < 0.5 for r in good) >= 0.98 * len(good) > 0
    for r in rows:
        assert r["rule"] == slow_rule(r["host"], r["path"])[0]
