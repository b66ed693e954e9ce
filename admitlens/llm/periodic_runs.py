"""Periodic run detection by string synchronising sets (operator 13).

A run is a stretch of words with smallest period q, at least ``exponent`` times as
long as q, that no neighbouring word extends. At every dyadic scale t the positions
j are selected where the hash of the t words at j or at j + t is the least of the
hashes at j .. j + t (Kempa and Kociumaka, 2019): whether a position is selected
depends on the 2 t words from there alone, and each t neighbouring positions hold a
selected one. Two selected positions with equal contexts of 2 t words, the nearest
of their kind, propose their distance as a period. For a run of period q take the t
with t <= q < 2 t: the run's first t positions hold a selected one, its context and
that of the position q words on lie inside 3 t + q <= 4 q words, and no distance
below q has equal contexts, since two periods on 2 t > q words would make q
divisible (Fine and Wilf). So no run of exponent 4 or more is missed.

Windows of t words with a period of at most min(SMALL, t / 3) take no part in the
selection (they would be selected all over); the stretches of periods up to SMALL
are found by comparing the words at that distance, and give the runs of these
periods. Proposals are compared word by word before they count, so hashes decide
nothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 8                # periods found without selected positions: the first scale
EXPONENT = 4             # least length of a run in periods
LEAST_WORDS = 6
CHUNK_WORDS = 400_000    # words of several texts that are worked on together
MIX = np.uint64(0x9E3779B97F4A7C15)   # odd multiplier of the hashes
TURN = np.uint64(29)

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    return (h ^ (h >> TURN)) * MIX


def stretches(words: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of period ``q`` (not always the
    smallest) with at least ``least`` words."""
    at = np.flatnonzero(words[:-q] == words[q:])
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first = at[np.concatenate(([0], cut))]
    last = at[np.concatenate((cut - 1, [len(at) - 1]))]
    long = last + 1 + q - first >= least
    return list(zip(first[long].tolist(), (last[long] + 1 + q).tolist()))


def _reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """Equal words of ``words`` from a and from b on (a < b), onwards for step 1,
    backwards from a - 1 and b - 1 for step -1."""
    room = len(words) - b if step > 0 else a
    done, size = 0, 64
    while done < room:
        n = min(size, room - done)
        if step > 0:
            same = words[a + done:a + done + n] == words[b + done:b + done + n]
        else:
            same = (words[a - done - n:a - done] == words[b - done - n:b - done])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + n, size * 4
    return done


def proposals(words: np.ndarray, hashes: np.ndarray, t: int, flat: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(position, period) of equal contexts at scale ``t``; ``hashes`` are those of
    the t words at each position, ``flat`` the (start, end, period) of stretches of
    small periods."""
    n = len(hashes)
    if n <= t:
        return
    context = _mixed(hashes[:n - t] * MIX + hashes[t:])
    keep = hashes.copy()
    omit = np.zeros(n + 1, dtype=np.int32)
    for start, end, p in flat:
        if 3 * p <= t and end - start >= t:
            omit[start] += 1
            omit[end - t + 1] -= 1
    keep[np.cumsum(omit[:n]) > 0] = np.iinfo(np.uint64).max
    least, size = keep, 1
    while size < t:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n - t], keep[t:])
    chosen = np.flatnonzero(((keep[:n - t] == least) | (keep[t:] == least)) & (least != np.iinfo(np.uint64).max))
    if len(chosen) < 2:
        return
    c = context[chosen]
    order = np.argsort(c, kind="stable")
    a, b = chosen[order[:-1]], chosen[order[1:]]
    near = (c[order[:-1]] == c[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
    yield from sorted(zip(a[near].tolist(), (b - a)[near].tolist()))


def runs_of(words: np.ndarray, exponent: int = EXPONENT, least_words: int = LEAST_WORDS,
            longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words`` (integers that tell words
    apart), by start and period. ``longest``: no run has more words, where known."""
    longest = len(words) if longest is None else longest
    found: set[tuple[int, int, int]] = set()
    flat: list[tuple[int, int, int]] = []

    def smallest(start: int, end: int, q: int) -> bool:
        # Of a stretch of two periods or more a smaller period divides q.
        return not any(q % p == 0 and np.array_equal(words[start:end - p], words[start + p:end])
                       for p in range(1, q // 2 + 1))

    for q in range(1, min(SMALL, len(words) // 3 + 1)):
        for start, end in stretches(words, q, max(3 * q, LEAST_WORDS)):
            flat.append((start, end, q))
            if end - start >= max(least_words, exponent * q) and smallest(start, end, q):
                found.add((start, end - start, q))
    hashes, size, t = _mixed(words.astype(np.uint64)), 1, SMALL
    while exponent * t <= longest:
        while size < t:
            hashes = _mixed(hashes[:-size] * MIX + hashes[size:])
            size *= 2
        seen: dict[int, int] = {}      # by period: where its last stretch ends
        for at, q in proposals(words, hashes, t, flat):
            if at + q < seen.get(q, 0):
                continue
            start = at - _reach(words, at, at + q, -1)
            end = at + q + _reach(words, at, at + q, 1)
            seen[q] = max(end, seen.get(q, 0))
            if end - start >= max(least_words, exponent * q) and smallest(start, end, q):
                found.add((start, end - start, q))
        t *= 2
    return sorted(found)


def _runs_of_texts(texts: list[list[bytes]], exponent: int, least_words: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, found over all of them in one array; a number of its own
    stands after each text, so no stretch goes beyond one."""
    numbers: dict[bytes, int] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    able = [i for i, w in enumerate(texts) if len(w) >= least_words]
    if not able:
        return out
    parts = []
    for i in able:
        w = texts[i]
        parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), dtype=np.int64, count=len(w)))
    begins, at = [], 0
    joined = np.empty(sum(map(len, parts)) + len(parts), dtype=np.int64)
    for k, p in enumerate(parts):
        begins.append(at)
        joined[at:at + len(p)] = p
        joined[at + len(p)] = len(numbers) + k
        at += len(p) + 1
    places = np.array(begins)
    for start, length, q in runs_of(joined, exponent, least_words, max(map(len, parts))):
        k = int(np.searchsorted(places, start, side="right")) - 1
        out[able[k]].append((start - begins[k], length, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words but those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    out = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, q in runs:
        out[start + q] += 1
        out[start + length] -= 1
    gone = np.cumsum(out[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", exponent: int = EXPONENT,
              least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row of ``docs``: the runs of its
    whole text as (start, length, period) in words, by start and period, and the
    text without the words that a run repeats, joined by one space.

    Words are runs of anything but ASCII white space. Nothing is shuffled; a task
    holds about ``CHUNK_WORDS`` words at a time, or one text. Repeated rows and ids
    give a row each, null texts and texts without words no runs and an empty text;
    null ids stay null. An empty table gives none; other columns are not read.
    ``exponent`` is at least 4: shorter runs need other scales."""
    if exponent < EXPONENT:
        raise ValueError("runs of an exponent below 4 are not looked for")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, texts):
            found = _runs_of_texts(texts, exponent, least_words)
            flat = [r for rows in found for r in rows]
            value = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                ids, pa.array([len(w) for w in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), value),
                pa.array([_collapsed(w, r) for w, r in zip(texts, found)], pa.binary())],
                names=["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            begin, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1])
                if size >= CHUNK_WORDS or i == batch.num_rows - 1:
                    yield done(batch.column(0).slice(begin, len(texts)), texts)
                    begin, texts, size = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(work, f"id {kind}, n_words bigint, runs {RUN_TYPE}, collapsed binary")
    return made.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the contract of the query rewrites it: with
    h = crc32(doc_id as text) and g = floor(h / 10), the words from a = g % n on of
    a text of n > 0 words with h % 10 = 0 become those of the period
    p = 1 + floor((n - a) / (3 + g % 8)) that begins at a. Rows without id or text
    stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    chosen = F.col("text").isNotNull() & (h % 10 == 0)
    n = F.size("w").cast("long")
    d = docs.select("doc_id", "text", g.alias("g"), F.when(chosen, words).alias("w"))
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n))
    d = d.withColumn("p", F.when(n > 0, F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1))
    at = F.sequence(F.lit(0).cast("long"), n - 1)
    source = F.transform(at, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return d.select("doc_id", F.when(n > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The query's columns from those of ``find_runs``: number of runs, the one of
    the greatest exact length / period (ties: smallest start, then period), and the
    digests of all runs and of the collapsed text."""
    def better(a, b):   # exact comparison of length / period
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(right > left, b).otherwise(a)

    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
