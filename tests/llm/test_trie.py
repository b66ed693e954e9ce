"""Conversation prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from admitlens.llm import prefix_trie, queries

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow_rebuilt(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    said = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in said.items()}
    out = {}
    for c, t in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + t[h:]
    return out


def slow_trie(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    saved = {k: (len(m) - 1) * (len(k[-1][1]) if k else 0) for k, m in members.items()}
    kids, leaves, total = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            total[k[:d]] += saved[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], total[k],
                   sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)))) for k, m in members.items())


def rows_of(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def made_rows(rng):
    rows = []
    texts = ["", "a", "é", "hello there", None, "x" * 50]
    for c in [*range(0, 260), *range(1001, 1031), -5, -100, -103, -199, 10**15, 10**15 + 1, 7 * 10**15 + 99]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 8, 30])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    same = [(t, "user", f"turn {t}") for t in range(9)]
    rows += [(2000 + c, *x) for c in range(120) for x in same]                       # copies
    rows += [(3000 + c, *x) for c in range(60) for x in same[:c % 9 + 1]]            # beginnings of each other
    rows += [(3000 + c, 50, "user", f"own {c}") for c in range(60)]
    for c in range(4000, 4010):                                                      # long and alike
        n = rng.choice([7, 8, 9, 24, 25, 60, 90])
        rows += [(c, t, "user", "same" if t < 30 else f"{c % 2}") for t in range(n)]
    rows += [(5000, 1, "user", "again")] * 40                                        # one row over and over
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("segment, shard, block", [(64, 400_000, 1024), (8, 60, 3), (1, 25, 1), (5, 100, 2)])
def test_nodes_are_those_of_brute_force(spark, monkeypatch, segment, shard, block):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", block)
    rows = made_rows(random.Random(segment))
    df = spark.createDataFrame([(*r, "c", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, context string, n int").repartition(5)
    convs = slow_rebuilt(rows)
    assert any(not t for t in convs.values())                                        # turnless ones
    turns, ids = prefix_trie.rebuilt(prefix_trie.placed_turns(df))
    assert rows_of(prefix_trie.prefix_trie(turns, ids)) == slow_trie(convs)


def test_conversations_as_they_are(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (3, 1, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.placed_turns(df)
    got = rows_of(prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()))
    convs = {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    assert got == slow_trie(convs)
    empty = prefix_trie.placed_turns(df.where("false"))
    assert prefix_trie.prefix_trie(empty, empty.select("conv_id")).count() == 0


def test_splitters_cut_the_items_into_shares(spark):
    turns = prefix_trie.placed_turns(spark.range(400).selectExpr("id conv_id", "1L turn", "'user' role", "'one and the same' text"))
    items = prefix_trie.path_items(turns, turns.select("conv_id"))
    cuts = prefix_trie.splitters_of(items, 4, 400)
    assert len(cuts) == 3 and len({c[3] for c in cuts}) == 3          # copies are dealt out by id


def test_registered_query_against_brute_force(spark, sf_small):
    got = rows_of(queries.QUERIES["op11_prefix_trie"](spark, sf_small))
    rows = spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == slow_trie(slow_rebuilt([tuple(r) for r in rows]))
