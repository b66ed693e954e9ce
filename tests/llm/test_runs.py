"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from admitlens.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            long = j - i + q
            if long >= max(least, exponent * q) and not any(
                    q % p == 0 and all(w[x] == w[x + p] for x in range(i, i + long - p)) for p in range(1, q)):
                out.append((i, long, q))
            i = j
    return sorted(out)


def slow_query(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def made_words(rng):
    n, k = rng.randint(0, 260), rng.choice([1, 2, 2, 3, 5, 40])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 10:
            a = rng.randrange(n)
            p, length = rng.randint(1, max(1, (n - a) // rng.randint(3, 6))), rng.randint(0, n - a)
            for i in range(a, a + length):
                w[i] = w[a + (i - a) % p]
    return w


def test_all_runs_are_found():
    rng, some = random.Random(13), 0
    for _ in range(800):
        w = made_words(rng)
        expected = slow_runs(w)
        some += len(expected)
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == expected
    assert some > 1000


def test_runs_inside_runs_and_of_long_periods():
    inner = [1] * 40 + [2]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(1)
    long = [rng.randrange(9) for _ in range(97)]
    for w in (inner * 6, fib[-1], fib[-1] * 5, [0, 0, 1] * 33 + [0, 0], long * 5 + long[:50], [5] * 300, [1, 2, 3, 4, 5, 6, 7, 8] * 9):
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == slow_runs(w)


TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x y " * 9, "é é\x0bé\x0cé\té\ré é",
         "a b c " * 300, "so it goes on, " * 3, "  " * 7]


@pytest.mark.parametrize("chunk", [periodic_runs.CHUNK_WORDS, 50])
def test_query_rows_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", chunk)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in made_words(rng))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(3, "a b"), (3, "a b"), (None, "a " * 8), (None, None), (-7, "z " * 20)]
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows],
                               "doc_id long, text string, runs string, id long, n_words long").repartition(3)
    got = periodic_runs.run_digest(periodic_runs.find_runs(periodic_runs.with_periodic_tails(df)))
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted((slow_query(i, t) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == expected
    assert sum(r[1] > 0 for r in expected) > 40
    assert periodic_runs.find_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, exponent=3)


def test_registered_query_against_brute_force(spark, sf_small):
    got = queries.QUERIES["op13_periodic_runs"](spark, sf_small)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    expected = {slow_query(i, t) for i, t in docs if len(WORD.findall(t or "")) < 1500}
    found = {tuple(r) for r in got.collect()}
    assert len(found) == len(docs) and expected <= found
    assert any(r[1] for r in expected)
