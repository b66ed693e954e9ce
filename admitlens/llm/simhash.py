"""SimHash near-duplicates by the general pigeonhole principle (operator 2).

Fingerprints within ``distance`` bits are found without comparing all pairs: the
64 bits are grouped into partitions of correlated bits, each partition gets its
own threshold (possibly none), and two fingerprints within the distance must
agree within the threshold on at least one partition as long as the thresholds
sum to distance - partitions + 1 (Qin et al., GPH, 2018). A dynamic programme
picks the thresholds of the least estimated cost from bit statistics of all
fingerprints. Fingerprints that share a probed key meet in a bucket and are
verified there; a bucket reports a spanning forest of its links, never all
pairs. Buckets too large for one task are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from admitlens.llm.common import row_hash, stored
from admitlens.llm.graph import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
PIECE = 1 << 14          # shingles whose bits are counted at once
BUCKET_ROWS = 2048       # a larger bucket is dealt out in blocks of about this
KEY_COST, PAIR_COST = 8000.0, 1.0   # nanoseconds per emitted key, per pair compared
ALL_BITS = (1 << 64) - 1


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: ASCII lower case, words between ASCII white space,
    shingles of ``width`` words with repeats (the whole sequence if shorter; none:
    zero), XXH64 of each; a bit is set if it is in over half of the hashes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(width, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE)
        spans = zip(starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n)
    return sum(1 << int(b) for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_column(text: str | Column = "text", width: int = SHINGLE) -> Column:
    """Fingerprint as a signed long; a null text has no words."""
    def run(batches):
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_buffer() if t.is_valid else None
                out.append(_signed(fingerprint(t.to_pybytes(), width)) if t else 0)
            yield pa.array(out, pa.int64())

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    c = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(run, LongType()).asNondeterministic()(c.cast("binary"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for a in range(0, len(x), 1 << 20):
                total += x[a:a + (1 << 20)].T @ x[a:a + (1 << 20)]
            n += len(v)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i.ravel(), -1)), pa.array(np.append(j.ravel(), -1)),
             pa.array(np.append(total.ravel().astype(np.int64), n))], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:                          # 64 * 64 + 1 rows
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of (nearly) equal size; correlated bits go together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        first = max(left, key=lambda b: (abs(p[b] - 0.5), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(group)
    return groups


def _meet(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two fingerprints agree on a bit, and on both of two bits."""
    p = np.diag(both) / max(n, 1)
    one = np.clip(p ** 2 + (1 - p) ** 2, 1e-9, 1)
    p11 = both / max(n, 1)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    two = p11 ** 2 + p10 ** 2 + p01 ** 2 + (1 - p11 - p10 - p01) ** 2
    return one, np.clip(two, 1e-9, 1)


def estimated_costs(n: int, both: np.ndarray, group: list[int], most: int) -> dict[int, float]:
    """Cost of probing a group at thresholds -1 (left out) to ``most``."""
    one, two = _meet(n, both)
    same = one[group[0]]
    for a, b in zip(group, group[1:]):
        same *= min(1.0, max(two[a, b] / one[a], one[b]))
    loose = 1 / one[group]
    costs, keys, pairs = {-1: 0.0}, 1.0, np.poly1d([1.0])
    for x in loose:
        pairs *= np.poly1d([x, 1.0])        # elementary symmetric sums
    for t in range(most + 1):
        keys = math.comb(len(group), t)
        costs[t] = n * keys * KEY_COST + n * n / 2 * same * float(pairs.coeffs[::-1][t]) * PAIR_COST
    return costs


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, extra in c.items():
                new = (cost + extra, chosen + [t])
                if s + t not in step or new < step[s + t]:
                    step[s + t] = new
        best = step
    return best.get(total, (math.inf, []))


def probe_masks(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[int]:
    """Bit masks such that any two fingerprints within ``distance`` bits agree on
    all bits of at least one mask, of the least estimated cost."""
    plans = []
    for m in range(1, min(64, 2 * distance + 2) + 1):
        groups = correlated_groups(n, both, m)
        most = min(2, distance)
        cost, chosen = allocate([estimated_costs(n, both, g, min(most, len(g))) for g in groups], distance - m + 1)
        if chosen:
            plans.append((cost, m, groups, chosen))
    _, _, groups, chosen = min(plans, key=lambda p: p[:2])
    masks = []
    for group, t in zip(groups, chosen):
        if t >= 0:
            for out in combinations(group, t):
                masks.append(sum(1 << b for b in group if b not in out))
    return masks


def forest(f: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Spanning forest of the links among a bucket's fingerprints: each one is
    compared with those only that no tree holds yet."""
    rest, out = f, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(rest ^ u) <= distance
            if near.any():
                new = rest[near]
                out += [(int(u), int(v)) for v in new]
                queue += list(new)
                rest = rest[~near]
    return out


def links(fps: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) within ``distance``,
    enough of them that the same components result."""
    n, both = bit_statistics(fps)
    masks = [_signed(m) for m in probe_masks(n, both, distance)]
    probes = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
                       for i, m in enumerate(masks)])
    keys = fps.select("fp", F.explode(probes).alias("k")).select("fp", "k.mask", "k.value")
    large = stored(keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") > bucket_rows), "buckets")
    n_large = large.count()
    zero = F.lit(0).cast("long")
    if n_large:
        large = large.select("mask", "value", F.ceil(F.col("n") / bucket_rows).alias("blocks"))
        keys = keys.join(F.broadcast(large) if n_large <= 50_000 else large, ["mask", "value"], "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        # A block meets itself and every other: each pair of blocks is one group.
        keys = (keys.withColumn("block", F.coalesce(block, zero))
                .withColumn("other", F.explode(F.sequence(zero, F.coalesce(F.col("blocks"), zero + 1) - 1)))
                .select("fp", "mask", "value", F.least("block", "other").alias("lo"),
                        F.greatest("block", "other").alias("hi")))
    else:
        keys = keys.withColumn("lo", zero).withColumn("hi", zero)

    def run(batches):
        carried = None
        schema = ["a", "b"]

        def found(key, f):
            pairs = []
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for part in np.split(f, cuts):
                if len(part) > 1:
                    pairs += forest(part, distance)
            v = np.array(pairs, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], schema)

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                            for c in ("mask", "value", "lo", "hi")], axis=1)
            f = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if carried is not None:
                key, f = np.concatenate([carried[0], key]), np.concatenate([carried[1], f])
            if not len(f):
                continue
            # The last bucket may go on in the next batch.
            last = int(np.argmax(np.all(key == key[-1], axis=1)))
            carried = (key[last:], f[last:])
            if last:
                yield found(key[:last], f[:last])
        if carried is not None:
            yield found(*carried)

    by = ["mask", "value", "lo", "hi"]
    return (keys.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct())


def _with_components(fps: DataFrame) -> DataFrame:
    """(fp, ..., doc_id) rows -> (fp, component): component names a fingerprint."""
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    found = components(links(distinct))
    return (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of
    ``docs`` (doc_id, text): the smallest doc_id reachable over links of at most
    three differing bits, itself included.

    Null and empty texts have the fingerprint zero and are linked like any other.
    A null doc_id is never the smallest; a component of null ids only has a null
    component_id. Repeated rows are rows of one component. Equal fingerprints are
    brought together before any links are searched.
    """
    fps = stored(docs.select("doc_id", fingerprint_column("text", width).alias("fp")), "simhash")
    owner = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = stored(_with_components(fps).join(owner, "fp"), "components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The row of the smallest doc_id of every component, all columns kept. Among
    rows of that one id the smaller hash of id and text stays, of rows equal in both
    the first by the other columns (maps, which have no order, aside), once. A null
    doc_id counts as the greatest; null and empty texts are near copies of each other."""
    h = row_hash(SEED, "doc_id", "text")
    fps = stored(docs.select("doc_id", h.alias("h"), fingerprint_column("text", width).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))).alias("first")
    best = fps.groupBy("fp").agg(first)
    kept = (_with_components(fps).join(best, "fp").groupBy("component").agg(F.min("first").alias("first"))
            .select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("h")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), h.alias("hash"))
    rows = rows.join(kept, (F.col("hash") == F.col("h")) & F.col("own").eqNullSafe(F.col("id")), "left_semi")
    order = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    once = F.row_number().over(Window.partitionBy("hash", "own").orderBy(*order))
    return rows.withColumn("place", once).where("place = 1").select("row.*")
