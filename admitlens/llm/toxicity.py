"""Toxicity by nearest labelled examples (operator 9).

Labelled examples live in an inverted index over TF-IDF weights; a text's score
is the calibrated, distance-weighted vote of the examples of the highest exact
cosine. Postings lie in blocks of examples, each with the largest weight of every
term in it, so whole blocks that cannot reach the current k-th cosine are passed
over and none of the nearest is missed. The space is spanned by the terms (words
and word stems) whose presence tells the labels apart beyond chance: in the space
of all words, cosines of long texts are made of chance words. Document
frequencies for the weights are counted over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from admitlens.llm.common import held_out, row_hash, stored
from admitlens.llm.contamination import words_of

MAX_EXAMPLES = 20_000    # labelled examples used, by a seeded hash (a bound on the fit)
MAX_TERMS = 4_000        # terms that span the space, by significance
CHANCE = 0.05            # expected terms taken by chance
LIFT = 8.0               # least ratio of a term's rates under label 1 and label 0
STEMS = range(4, 9)      # bytes at the start of a longer word that make stem terms
NEIGHBOURS = 15
PRIOR = 0.5              # weight of the prior in a vote
BLOCK = 64               # examples in a block
BINS = 20                # of the calibration
THRESHOLD = 0.3
SEED = 9


def terms_of(word: bytes) -> list[bytes]:
    """A word (ASCII lower case, ASCII punctuation apart) and its stems."""
    return [word] + [word[:n] + b"*" for n in STEMS if n < len(word)]


class Index:
    """Block-max inverted index of labelled examples."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, prior: float):
        self.at = {t: i for i, t in enumerate(terms)}
        self.idf = idf
        self.prior = prior
        self.bins = np.full(BINS + 1, prior)     # the last: texts without any term
        self.memory: dict[tuple, tuple] = {}     # scores of vectors met
        self.known: dict[bytes, tuple] = {}      # terms of words met

    def counts(self, text: bytes) -> dict[int, int]:
        """Occurrences of the space's terms in ``text``."""
        count: dict[int, int] = {}
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in words_of(text):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(self.at[t] for t in terms_of(w) if t in self.at)
            for i in ids:
                count[i] = count.get(i, 0) + 1
        return count

    def vector(self, text: bytes) -> tuple[tuple[int, ...], np.ndarray]:
        """Terms of the space in ``text`` and their weights, of length 1."""
        return self.weights(self.counts(text))

    def weights(self, count: dict[int, int]) -> tuple[tuple[int, ...], np.ndarray]:
        ids = tuple(sorted(count))
        v = np.array([(1 + math.log(count[i])) * self.idf[i] for i in ids])
        n = math.sqrt(float(v @ v)) if len(v) else 0.0
        return ids, v / n if n else v

    def build(self, examples: list[tuple[int, int, dict[int, int]]]) -> "Index":
        """``examples``: (doc_id, label, term counts) with at least one term."""
        rows = [(d, y, *self.weights(c)) for d, y, c in examples if c]
        # Alike examples go to one block: their maxima then tell blocks apart.
        rows.sort(key=lambda r: (r[2][int(np.argmax(r[3]))], r[1], r[2], r[0]))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.labels = np.array([r[1] for r in rows], dtype=np.float64)
        blocks = -(-len(rows) // BLOCK)
        self.peak = np.zeros((len(self.at), blocks), dtype=np.float64)
        self.postings = []                       # per block: its terms, weights[example, term]
        for b in range(blocks):
            part = rows[b * BLOCK:(b + 1) * BLOCK]
            terms = np.array(sorted({t for r in part for t in r[2]}), dtype=np.int64)
            w = np.zeros((len(part), len(terms)))
            for i, (_, _, ids, v) in enumerate(part):
                w[i, np.searchsorted(terms, ids)] = v
            self.postings.append((terms, w))
            self.peak[terms, b] = w.max(axis=0)
        return self

    def nearest(self, ids: tuple[int, ...], v: np.ndarray, k: int, without: int | None = None):
        """Exact k nearest: (cosines, positions), ties to the smaller position."""
        if not len(ids) or not len(self.ids):
            return np.empty(0), np.empty(0, dtype=np.int64)
        bound = v @ self.peak[list(ids)]
        query = np.zeros(len(self.at))
        query[list(ids)] = v
        best_s, best_e = np.empty(0), np.empty(0, dtype=np.int64)
        for b in np.lexsort((np.arange(len(bound)), -bound)):
            if bound[b] <= 0 or len(best_s) == k and bound[b] < best_s[-1] - 1e-12:
                break
            terms, w = self.postings[b]
            s = w @ query[terms]
            e = np.flatnonzero(s > 0)
            s, e = s[e], e + b * BLOCK
            if without is not None:
                s, e = s[e != without], e[e != without]
            best_s, best_e = np.concatenate([best_s, s]), np.concatenate([best_e, e])
            order = np.lexsort((best_e, -np.round(best_s, 12)))[:k]
            best_s, best_e = best_s[order], best_e[order]
        return best_s, best_e

    def vote(self, s: np.ndarray, e: np.ndarray) -> float:
        """Share of label 1, near examples weighing more; the prior fills in."""
        w = s / (1.0 + 4.0 * (1.0 - np.minimum(s, 1.0)))
        return float((w @ self.labels[e] + PRIOR * self.prior) / (w.sum() + PRIOR))

    def bin(self, vote: float, empty: bool) -> int:
        return BINS if empty else min(BINS - 1, int(vote * BINS))

    def score(self, text: bytes, k: int = NEIGHBOURS) -> tuple[float, list[int], list[float]]:
        """(calibrated score, nearest doc_ids, their cosines)."""
        ids, v = self.vector(text)
        key = (ids, v.tobytes())
        if key not in self.memory:
            if len(self.memory) > 50_000:
                self.memory.clear()
            s, e = self.nearest(ids, v, k)
            vote = self.vote(s, e)
            b = self.bin(vote, not len(s))
            # Halfway between the vote and what votes like it came to.
            p = float(self.bins[b]) if not len(s) else 0.5 * vote + 0.5 * float(self.bins[b])
            self.memory[key] = (min(1.0, max(0.0, p)), self.ids[e].tolist(), s.tolist())
        return self.memory[key]


def _shipped(spark, index: Index):
    """Broadcast of the index, bounded by the examples and terms it may hold."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(index))


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[DataFrame, int, int]:
    """Stored sample (doc_id, text, y) of the rows one may learn from, its size
    and its rows of label 1. A document labelled more than once takes the larger
    label; of rows of one id the smallest text counts, once."""
    y = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
         .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("y")))
    learnable = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(y, "doc_id")
    total = y.count()
    share = F.pmod(row_hash(SEED, "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_examples / max(total, 1))))
    sample = stored(learnable.where(share).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "examples")
    r = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
    return sample, r["n"], r["ones"] or 0


def _telling_terms(sample: DataFrame, n: int, ones: int, max_terms: int) -> list[bytes]:
    """Terms whose presence tells the labels apart beyond chance."""
    def run(batches):
        for batch in batches:
            count: dict[bytes, list[int]] = {}
            for t, y in zip(batch.column(0), batch.column(1)):
                y = y.as_py()
                for w in {x for v in set(words_of(t.as_buffer().to_pybytes())) for x in terms_of(v)}:
                    count.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.binary()), pa.array([c[0] for c in count.values()], pa.int64()),
                 pa.array([c[1] for c in count.values()], pa.int64())], ["term", "zeros", "ones"])

    zeros = n - ones
    if not zeros or not ones:
        return []
    counted = stored(sample.select(F.col("text").cast("binary"), "y")
                     .mapInArrow(run, "term binary, zeros long, ones long")
                     .groupBy("term").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
                     .where(F.col("zeros") + F.col("ones") >= 2), "terms")
    tried = max(1, counted.count())
    # Log-likelihood ratio of the two rates against one common rate; its natural
    # scale makes exp(-g) the order of a chance term's probability.
    a, b = F.col("ones").cast("double"), F.col("zeros").cast("double")

    def part(x, total, of):
        return F.when(x > 0, x * F.log(x / (total * of))).otherwise(0.0)

    both = (a + b) / n
    g = (part(a, F.lit(float(ones)), both) + part(b, F.lit(float(zeros)), both)
         + part(ones - a, F.lit(float(ones)), 1 - both) + part(zeros - b, F.lit(float(zeros)), 1 - both))
    # Terms that speak for label 1; in long texts small differences of common
    # words are many and tell nothing.
    lift = (a + 0.5) / ones >= F.lit(LIFT) * (b + 0.5) / zeros
    rows = (counted.withColumn("g", g).where((F.col("g") > math.log(tried / CHANCE)) & lift)
            .orderBy(F.desc("g"), "term").limit(max_terms).collect())
    return sorted(bytes(r["term"]) for r in rows)


def _document_frequencies(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all documents."""
    shared = _shipped(docs.sparkSession, index)

    def run(batches):
        ix = cloudpickle.loads(shared.value)
        df, n = Counter(), 0
        for batch in batches:
            for t in batch.column(0):
                n += 1
                if t.is_valid:
                    df.update(ix.vector(t.as_buffer().to_pybytes())[0])
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["t", "n"])

    rows = (docs.select(F.col("text").cast("binary")).mapInArrow(run, "t long, n long")
            .groupBy("t").agg(F.sum("n").alias("n")).collect())          # a row per term of the space
    df = {r["t"]: r["n"] for r in rows}
    return df.pop(-1, 0), np.array([df.get(i, 0) for i in range(len(index.at))], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Index:
    """Learn from labelled rows that are not held out (at most about
    ``max_examples`` of them, by a seeded hash of the id). Without labels, or
    with labels of one kind only, every text scores the smoothed rate of 1s."""
    sample, n, ones = _examples(docs, labels, max_examples)
    prior = (ones + 0.5) / (n + 1.0) if n else 0.5 * THRESHOLD
    terms = _telling_terms(sample, n, ones, max_terms)
    total, df = _document_frequencies(docs, Index(terms, np.ones(len(terms)), prior))
    index = Index(terms, np.log((total + 1.0) / (df + 1.0)) + 1.0, prior)
    spark = docs.sparkSession

    def vectors(batches):
        ix = cloudpickle.loads(shared.value)
        for batch in batches:
            out, empty = [], [0, 0]
            for d, t, y in zip(*(batch.column(i) for i in range(3))):
                count = ix.counts(t.as_buffer().to_pybytes())
                if count:
                    out.append((d.as_py(), y.as_py(), list(count), list(count.values())))
                else:
                    empty[y.as_py()] += 1
            out += [(None, y, [], [m]) for y, m in enumerate(empty) if m]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32()))],
                ["doc_id", "y", "t", "n"])

    shared = _shipped(spark, index)
    # Bounded: one row per example that holds a term, each of a few numbers.
    rows = sample.select("doc_id", F.col("text").cast("binary"), "y").mapInArrow(
        vectors, "doc_id long, y int, t array<int>, n array<int>").collect()
    index.build(sorted((r["doc_id"], r["y"], dict(zip(r["t"], r["n"]))) for r in rows if r["doc_id"] is not None))
    bare = [sum(r["n"][0] for r in rows if r["doc_id"] is None and r["y"] == y) for y in (0, 1)]
    _calibrate(spark, index, bare)
    return index


def _calibrate(spark, index: Index, bare: list[int]) -> None:
    """Votes of each example by the others, against what their labels were:
    smoothed rates per bin of votes, made to rise with the vote."""
    zeros, ones = np.zeros(BINS + 1), np.zeros(BINS + 1)
    zeros[BINS], ones[BINS] = bare
    n = len(index.ids)
    if n:
        shared = _shipped(spark, index)

        def run(batches):
            ix = cloudpickle.loads(shared.value)
            out = Counter()
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    terms, w = ix.postings[b]
                    for i in range(len(w)):
                        has = np.flatnonzero(w[i])
                        s, near = ix.nearest(tuple(terms[has].tolist()), w[i, has], NEIGHBOURS, b * BLOCK + i)
                        out[(ix.bin(ix.vote(s, near), not len(s)), int(ix.labels[b * BLOCK + i]))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()),
                 pa.array(list(out.values()), pa.int64())], ["bin", "y", "n"])

        blocks = -(-n // BLOCK)
        for r in (spark.range(blocks).mapInArrow(run, "bin long, y long, n long")
                  .groupBy("bin", "y").agg(F.sum("n").alias("n")).collect()):     # two rows a bin
            (ones if r["y"] else zeros)[r["bin"]] += r["n"]
    mid = np.append((np.arange(BINS) + 0.5) / BINS, index.prior)
    rate = (ones + 2.0 * mid) / (ones + zeros + 2.0)
    weight = ones + zeros + 2.0
    pools: list[list[float]] = []                # pool adjacent violators
    for r, w in zip(rate[:BINS], weight[:BINS]):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            r2, w2, n2 = pools.pop()
            r1, w1, n1 = pools.pop()
            pools.append([(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    index.bins = np.append(np.concatenate([np.full(int(n_), r) for r, _, n_ in pools]), rate[BINS])
    index.memory, index.known = {}, {}


SCORED = StructType([StructField("score", DoubleType()), StructField("evidence", ArrayType(LongType())),
                     StructField("similarity", ArrayType(DoubleType()))])


def scored_column(spark, index: Index, text: str | Column = "text", evidence: int = 5) -> Column:
    """score, and the nearest examples behind it (doc_ids, cosines)."""
    shared = _shipped(spark, index)
    types = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ix = cloudpickle.loads(shared.value)
        for texts in batches:
            rows = [ix.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            cols = ([r[0] for r in rows], [r[1][:evidence] for r in rows], [r[2][:evidence] for r in rows])
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["score", "evidence", "similarity"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    c = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(run, SCORED).asNondeterministic()(c.cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on),
    evidence (doc_ids of the nearest examples) and similarity for every row.

    Null and empty texts, and texts without any telling term, score the rate of
    such texts among the examples. A null doc_id is not held out. Repeated rows
    score alike. Labels of unknown documents and null labels teach nothing."""
    index = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **how)
    s = docs.select("doc_id", held_out().alias("held_out"), scored_column(docs.sparkSession, index).alias("s"))
    return s.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"),
                    "s.evidence", "s.similarity")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns kept."""
    index = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       scored_column(docs.sparkSession, index, "text", 0).alias("s"))
    return rows.where(F.col("s.score") < threshold).select("row.*")
