"""Best dictionary entry by Ratcliff–Obershelp ratio (stdlib ``difflib``
semantics), as an exact similarity join.

The ratio is 2·M/(la+lb), and the M matched characters form a common subsequence, so
a ratio ≥ c leaves at most e_d = ld − M letters of the entry and e_q = lq − M of the
name unmatched. Of n disjoint pieces of the entry at least n − e_d lose no letter, and
of these at most e_q / (t + 1) have more than t foreign letters between theirs: so at
least n − e_d − ⌊e_q / (t + 1)⌋ pieces stand in the name with at most t letters in
between. For each pair of lengths that occurs, n and t are chosen so that two pieces
must match, where the letters allow it, at the fewest expected chance hits. Which
pieces an entry gives is decided by their frequency: letter statistics of the whole
dictionary are counted first, and the entry's cuts make the sum of its pieces' expected
hits least. Hits are an equi-join on (length of the name, piece); moved too far, of too
few letters in common (whatever their order) or too few, they are no candidates.

Candidates meet a bit-parallel bound on the longest common subsequence (Hyyrö, 2004)
before ``difflib`` computes the ratio of the few left, both in an Arrow-batched UDF.

Only the best entry counts, so names meet the dictionary by falling cut-offs: a name that
has an entry of at least some ratio has its best one among those, and is done. Equal names
cost a plain join, near ones long pieces and few keys; the others alone are cut into keys
for the cut-off asked for, in rounds of so many keys that their shuffle stays bounded.
No cross join, no cap on candidates: every pair that can reach the cut-off is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from admitlens.session import cut_lineage, shuffled, store, store_and_clean

EPS = 1e-9
LETTERS = 12             # letters of equal chance that stand for an alphabet in the choice of n and t
KEY_COST = 10            # of a key made of a name, in hits
SCORE_COST = 3           # of a candidate, in hits
BAG, DEEP = 32, 4        # kinds of letters told apart, and how many of each are counted singly
MOST_GRAMS = 200_000     # most frequent letter triples kept as statistics (they choose cuts, not results)
GRAM = 3
CELLS = 2_000_000        # of the table in which an entry's cuts are chosen, for entries taken at once
ROUND_KEYS = 200_000_000  # keys of names that are shuffled at a time (about 20 bytes each)


class Plan(NamedTuple):
    """How names of one length and entries of another meet."""
    pieces: int
    between: int         # foreign letters allowed in a piece
    matches: int         # pieces that must match
    lost: int            # letters of the entry that may stay unmatched
    extra: int           # letters of the name that may


def least_common(lq: int, ld: int, cutoff: float) -> int:
    return math.ceil((lq + ld) * cutoff / 2 - EPS)


@lru_cache(maxsize=100_000)
def plan_of(lq: int, ld: int, cutoff: float, entries: int) -> Plan | None:
    """The cheapest plan for these lengths, by expected hits and by keys made of a
    name; None where they cannot reach the cut-off."""
    m = least_common(lq, ld, cutoff)
    if m > min(lq, ld):
        return None
    m = max(m, 1)
    lost, extra = ld - m, lq - m
    best = None
    for n in range(lost + 1, min(ld, lost + extra + 3) + 1):
        size = ld // n
        for t in range(extra + 1):
            matches = min(n - lost - extra // (t + 1), 2)
            if matches < 1:
                continue
            ways = math.comb(size - 1 + t, t)
            hits = n * ways * (lost + extra + 1) * entries / LETTERS ** (ld / n)
            keys = (ways + math.comb(size + t, t)) * lq
            scored = hits if matches == 1 else hits * hits / max(entries, 1)
            cost = KEY_COST * keys + hits + SCORE_COST * scored
            if best is None or cost < best[0]:
                best = cost, Plan(n, t, matches, lost, extra)
    return best[1]


@lru_cache(maxsize=10_000)
def patterns(size: int, between: int) -> tuple[tuple[int, tuple[tuple[int, int], ...]], ...]:
    """(foreign letters, (start, end) of the parts) of all ways in which ``size``
    letters stand in order with at most ``between`` foreign ones in between."""
    out = []
    for u in range(between + 1 if size > 1 else 1):
        span = size + u
        for foreign in combinations(range(1, span - 1), u):
            cuts, parts = [-1, *foreign, span], []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    parts.append((a + 1, b))
            out.append((u, tuple(parts)))
    return tuple(out)


class Chances(NamedTuple):
    """Log chances of letters, each after the two before it, by the letter statistics."""
    known: list[tuple[np.ndarray, np.ndarray]]      # by letters of the gram: ascending codes, log chances
    unseen: float


def _code(letters: list) -> int | np.ndarray:
    code = letters[0]
    for x in letters[1:]:
        code = code << 21 | x
    return code


def chances_by(grams: dict[str, int]) -> Chances:
    total = max(sum(n for g, n in grams.items() if len(g) == 1), 1)
    known = []
    for n in range(1, GRAM + 1):
        some = sorted((_code([ord(c) for c in g]), math.log(seen / max(grams.get(g[:-1], total) if n > 1 else total, seen)))
                      for g, seen in grams.items() if len(g) == n)
        known.append((np.array([c for c, _ in some], dtype=np.int64), np.array([x for _, x in some], dtype=np.float64)))
    return Chances(known, -math.log(total) / 2)


def _log_chances(letters: np.ndarray, chances: Chances) -> list[np.ndarray]:
    """For each entry and place, the log chance of its letter, by 1, 2 and 3 letters."""
    count, length = letters.shape
    out = []
    for n, (codes, logs) in enumerate(chances.known, 1):
        found = np.full((count, length), chances.unseen)
        if n <= length and len(codes):
            code = _code([letters[:, i:length - n + 1 + i] for i in range(n)])
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found[:, n - 1:] = np.where(codes[at] == code, logs[at], chances.unseen)
        out.append(found)
    return out


def chosen_pieces(letters: np.ndarray, plan: Plan, chances: Chances) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes), a row per entry of ``letters`` (entries of one length, a row of
    letter codes each): ``plan.pieces`` disjoint pieces with the least sum of chances."""
    (count, length), n = letters.shape, plan.pieces
    one, two, three = _log_chances(letters, chances)
    summed = np.zeros((count, length + 1))
    np.cumsum(three, axis=1, out=summed[:, 1:])
    best = np.full((length + 1, n + 1, count), np.inf)       # best[i][k]: k pieces from i on
    step = np.zeros((length + 1, n + 1, count), dtype=np.int16)     # the size taken at i, 0: none starts there
    best[:, 0] = 0.0
    for i in range(length - 1, -1, -1):
        best[i, 1:] = best[i + 1, 1:]
        for size in range(length // n, min(length // n + 1, length - i) + 1):
            log_p = one[:, i] + (two[:, i + 1] if size > 1 else 0) + (summed[:, i + size] - summed[:, i + 2] if size > 2 else 0)
            x = np.exp(log_p) * math.comb(size - 1 + plan.between, plan.between) + best[i + size, :-1]
            less = x < best[i, 1:]
            best[i, 1:][less] = x[less]
            step[i, 1:][less] = size
    rows = np.arange(count)
    starts, sizes = np.zeros((count, n), dtype=np.int32), np.zeros((count, n), dtype=np.int32)
    at, left = np.zeros(count, dtype=np.int64), np.full(count, n)
    for _ in range(length):
        s = step[at, left, rows]
        taken = (s > 0) & (left > 0)
        starts[rows[taken], n - left[taken]], sizes[rows[taken], n - left[taken]] = at[taken], s[taken]
        left[taken] -= 1
        at = np.minimum(at + np.maximum(np.where(taken, s, 0), 1), length)
    return starts, sizes


def common_letters(masks: dict[str, int], length: int, b: str) -> int:
    """Length of the longest common subsequence of ``b`` and the string of ``length``
    letters whose places ``masks`` give."""
    full = (1 << length) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def masks_of(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def letter_bag(text: str) -> tuple[int, int, int]:
    """The letters of ``text`` without their order: two 64-bit words with a bit for each of
    the first ``DEEP`` letters of a kind, and the number of those that have no bit."""
    counts = [0] * BAG
    for c in text:
        counts[ord(c) % BAG] += 1
    bits = 0
    for i, n in enumerate(counts):
        bits |= ((1 << min(n, DEEP)) - 1) << i * DEEP
    words = ((bits >> at & (1 << 64) - 1) for at in (0, 64))
    low, high = (w - (1 << 64) if w >> 63 else w for w in words)
    return low, high, sum(max(n - DEEP, 0) for n in counts)


def _ratio_udf(cutoff: float):
    @F.pandas_udf(T.DoubleType())
    def ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
        """SequenceMatcher(None, candidate, query).ratio(), as get_close_matches
        computes it (candidate is the first sequence, the query the second, whose
        index is kept); NULL where an upper bound is below the cut-off."""
        from difflib import SequenceMatcher

        m, last, masks, set_to, out = SequenceMatcher(None), None, {}, None, []
        for a, b in zip(candidate, query):
            if b != last:
                masks, last = masks_of(b), b
            if common_letters(masks, len(b), a) < least_common(len(b), len(a), cutoff):
                out.append(None)
                continue
            if set_to != b:
                m.set_seq2(b)
                set_to = b
            m.set_seq1(a)
            out.append(m.ratio())
        return pd.Series(out, dtype="float64")

    # Marked non-deterministic only so that the filter on the score is not
    # pushed below the projection, which would run the Python ratio twice.
    return ratio.asNondeterministic()


def _named(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct names that hold letters, numbered and stored. They are few bytes and
    much work, so they are dealt to as many tasks as shuffles have, not to as few as
    their bytes would fill."""
    d = df.select(F.col(col).alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    d = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)
    return cut_lineage(d.select(F.monotonically_increasing_id().alias(f"{name}_id"), name))


def _lengths(df: DataFrame, col: str) -> list[int]:
    """Distinct lengths of a column: no more than the longest string has letters."""
    return sorted(r["n"] for r in df.select(F.length(col).alias("n")).distinct().collect())


def _gram_counts(d: DataFrame) -> dict[str, int]:
    """Counts of letters, pairs and triples over all entries."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for entry in batch.column(0).to_pylist():
                for n in range(1, GRAM + 1):
                    found.update([entry[i:i + n] for i in range(len(entry) - n + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["g", "n"])

    counts = d.select("d").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("count"))
    return {r["g"]: r["count"] for r in counts.orderBy(F.desc("count"), "g").limit(MOST_GRAMS).collect()}


KINDS = {"piece": pa.string(), **dict.fromkeys(("d_id", "d_low", "d_high"), pa.int64())}


class Pieces(NamedTuple):
    """Pieces of all entries, and by the names' lengths the (size, letters between) they have."""
    rows: DataFrame
    made: dict[int, list[tuple[int, int]]]


def piece_hits(q: DataFrame, d: DataFrame, cutoff: float) -> DataFrame:
    """(q_id, d_id, k, matches): pieces k of entries ``d`` (d_id, d) that stand in
    names ``q`` (q_id, q) no farther off than the letters left over allow."""
    return hits_of(q, pieces_of(_lengths(q, "q"), d, cutoff, _gram_counts(d)))


def pieces_of(of_names: list[int], d: DataFrame, cutoff: float, counts: dict[str, int]) -> Pieces:
    """Pieces of the entries ``d`` (d_id, d) for names of these lengths."""
    spark = d.sparkSession
    entries = d.count()
    of_entries = _lengths(d, "d")
    plans = {ld: [(lq, p) for lq in of_names if (p := plan_of(lq, ld, cutoff, entries))] for ld in of_entries}
    grams = spark.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = chances_by(grams.value)
        for batch in batches:
            by_length: dict[int, list[tuple[int, str]]] = {}
            for d_id, entry in zip(*(c.to_pylist() for c in batch.columns)):
                by_length.setdefault(len(entry), []).append((d_id, entry))
            for length, some in by_length.items():
                known = plans.get(length, ())
                width = (length + 1) * max([p.pieces + 1 for _, p in known], default=1)
                for a in range(0, len(some), at_once := max(CELLS // width, 1)):
                    if rows := rows_of(some[a:a + at_once], length, known, chances):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), piece_type)], schema=piece_type)

    def rows_of(some: list[tuple[int, str]], length: int, known, chances: Chances) -> list[tuple]:
        letters = np.frombuffer("".join([e for _, e in some]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.int64)
        cuts: dict[tuple[int, int], list] = {}
        for _, plan in known:
            if (key := (plan.pieces, plan.between)) not in cuts:
                cuts[key] = [list(zip(*x)) for x in zip(*(y.tolist() for y in chosen_pieces(letters, plan, chances)))]
        rows = []
        for i, (d_id, entry) in enumerate(some):
            bag = letter_bag(entry)
            for lq, plan in known:
                rows += [(d_id, lq, entry[at:at + s], k, at, *plan[1:], *bag) for k, (at, s) in enumerate(cuts[plan.pieces, plan.between][i])]
        return rows

    piece_type = pa.schema([(c, KINDS.get(c, pa.int32())) for c in (
        "d_id", "lq", "piece", "k", "start", "between", "matches", "lost", "extra", "d_low", "d_high", "d_more")])
    pieces = store(d.select("d_id", "d").mapInArrow(cut, from_arrow_schema(piece_type)), "pieces")
    # Sizes and gaps that occur for names of each length: a few rows per length.
    made: dict[int, list[tuple[int, int]]] = {}
    for r in pieces.groupBy("lq", F.length("piece").alias("size")).agg(F.max("between").alias("between")).collect():
        made.setdefault(r["lq"], []).append((r["size"], r["between"]))
    return Pieces(pieces, made)


def keys_of_length(length: int, made: dict[int, list[tuple[int, int]]]) -> int:
    """Keys that a name of this length gives, equal ones counted apart."""
    return sum(max(length - size - u + 1, 0) for size, between in made.get(length, ()) for u, _ in patterns(size, between))


def hits_of(q: DataFrame, pieces: Pieces) -> DataFrame:
    """``piece_hits`` of names by the entries' pieces."""
    made = pieces.made

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for q_id, name in zip(*(c.to_pylist() for c in batch.columns)):
                found, bag = set(), letter_bag(name)
                for size, between in made.get(len(name), ()):
                    for u, parts in patterns(size, between):
                        for at in range(len(name) - size - u + 1):
                            found.add(("".join([name[at + a:at + b] for a, b in parts]), at, u))
                out += [(q_id, len(name), *x, *bag) for x in found]
                if len(out) >= 100_000:
                    yield key_batch(out)
                    out = []
            if out:
                yield key_batch(out)

    key_type = pa.schema([(c, KINDS.get(c.replace("q_", "d_"), pa.int32())) for c in (
        "q_id", "lq", "piece", "at", "u", "q_low", "q_high", "q_more")])

    def key_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), key_type)], schema=key_type)

    of_name = q.select("q_id", "q").mapInArrow(keys, from_arrow_schema(key_type))
    moved, u = F.col("at") - F.col("start"), F.col("u")
    left = F.col("extra") - F.col("lost") - moved - u       # what is to move after the piece
    none = F.lit(0)
    inserted = F.greatest(moved, none) + u + F.greatest(left, none)
    deleted = F.greatest(-moved, none) + F.greatest(-left, none)
    # No more letters match than both have in common, in any order.
    common = F.bit_count(F.col("q_low").bitwiseAND(F.col("d_low"))) + F.bit_count(F.col("q_high").bitwiseAND(F.col("d_high"))) \
        + F.least("q_more", "d_more")
    needed = F.col("lq") - F.col("extra")
    return of_name.join(shuffled(pieces.rows), ["lq", "piece"]).where(
        (common >= needed) & (u <= F.col("between")) & (inserted <= F.col("extra")) & (deleted <= F.col("lost"))).select("q_id", "d_id", "k", "matches")


def candidate_ids(q: DataFrame, d: DataFrame, cutoff: float) -> DataFrame:
    """(q_id, d_id): pairs with as many matching pieces as their lengths ask for.
    Pieces are told apart by bits; of more than 63 some share one, so those pairs stay."""
    return _matched(piece_hits(q, d, cutoff))


def _matched(hits: DataFrame) -> DataFrame:
    hits = hits.groupBy("q_id", "d_id").agg(
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, k % 63)"))).alias("met"), F.max("k").alias("last"),
        F.max("matches").alias("matches"))
    return hits.where((F.col("met") >= F.col("matches")) | (F.col("last") >= 63)).select("q_id", "d_id")


def candidate_pairs(names: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """(q, d): every pair of names that can reach the cut-off, few others; from
    ``names`` (q) and ``entries`` (d)."""
    q, d = _named(names, "q", "q"), _named(entries, "d", "d")
    return candidate_ids(q, d, cutoff).join(shuffled(q), "q_id").join(shuffled(d), "d_id").select("q", "d")


def _best_of(q: DataFrame, d: DataFrame, cutoff: float, counts: dict[str, int]) -> DataFrame:
    """(q_id, q, b): names with an entry of ratio ≥ cutoff and the best of these, in
    rounds of names; a round's shuffle files are gone before the next begins."""
    names = {r["n"]: r["count"] for r in q.groupBy(F.length("q").alias("n")).count().collect()}
    pieces = pieces_of(sorted(names), d, cutoff, counts)
    rounds = math.ceil(sum(n * keys_of_length(length, pieces.made) for length, n in names.items()) / ROUND_KEYS)
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for i in range(max(rounds, 1)):
        some = q if rounds < 2 else q.where(F.pmod(F.xxhash64("q_id"), F.lit(rounds)) == i)
        some = some.repartition(tasks, "q_id")      # few bytes and much work, as in _named
        pairs = _matched(hits_of(some, pieces)).join(shuffled(some), "q_id").join(shuffled(d), "d_id")
        scored = pairs.withColumn("score", _ratio_udf(cutoff)(F.col("d"), F.col("q"))).filter(F.col("score") >= F.lit(cutoff))
        found.append(store_and_clean(scored.groupBy("q_id", "q").agg(F.max(F.struct("score", "d")).alias("b")), "best"))
    return reduce(DataFrame.unionByName, found)


def fuzzy_match(names: DataFrame, name_col: str, dictionary: DataFrame, cutoff: float,
                dict_col: str = "name", out_col: str = "match") -> DataFrame:
    """Distinct names of ``names[name_col]`` with their best dictionary entry of
    ratio ≥ cutoff (ties: the larger string), NULL when none / empty name /
    empty dictionary. Returns DataFrame(name_col, out_col, score)."""
    q = _named(names, name_col, "q")
    d = _named(dictionary.select(F.col(dict_col).alias("d")), "d", "d")
    equal = F.struct(F.lit(1.0).alias("score"), "d")
    met = store_and_clean(q.join(shuffled(d.select("d")), (F.col("q") == F.col("d")) & F.lit(cutoff <= 1), "left")
                          .select("q_id", "q", F.when(F.col("d").isNotNull(), equal).alias("b")), "equal")
    found = [met.where("b is not null")]
    left = met.where("b is null").drop("b")
    counts = None
    for level in sorted({(1 + cutoff) / 2, cutoff}, reverse=True):      # the near ones first
        if level >= 1 or left.isEmpty():        # 1 is reached by equal names alone
            continue
        counts = _gram_counts(d) if counts is None else counts
        found.append(_best_of(left, d, level, counts))
        left = store_and_clean(left.join(shuffled(found[-1].select("q_id")), "q_id", "left_anti"), "left")
    best = reduce(DataFrame.unionByName, found)
    return q.join(shuffled(best.select("q", "b")), "q", "left").select(
        F.col("q").alias(name_col), F.col("b.d").alias(out_col), F.col("b.score").alias("score"))
