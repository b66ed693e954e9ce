"""Language identification by language-bitmask n-gram filters (operator 3).

One bit-sliced Bloom filter holds, for every n-gram, the set of languages that
use it: each of its rows is a bitmask over languages, and the AND of the rows an
n-gram hashes to returns all its languages at once. Bits are counted per language
over a text's n-grams, the counts are corrected for the chance hits that the fill
of each language's slice makes likely, and the largest share decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from admitlens.llm.common import held_out, row_hash, stored

SIZES = (2, 3, 4)        # letters of an n-gram; other characters count as a blank
EXAMPLES = 4_000         # labelled rows used per language, by a seeded hash (a bound on the fit)
GRAMS = 20_000           # n-grams kept per language, by frequency
SHARE = 0.1              # of an n-gram's highest rate that makes a language use it
ROWS = 1 << 18           # rows of the filter
PROBES = 2
PIECE = 1 << 18          # characters looked at at once
SEED = 3
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a whole text, in bounded pieces; a text without
    letters has none. N-grams hold at most one non-letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters[c]
    if not is_letter.any():
        return
    c = np.concatenate([[32], np.where(is_letter, c, 32), [32]]).astype(np.uint64)
    is_letter = np.concatenate([[False], is_letter, [False]]).astype(np.int8)
    for at in range(0, len(c), PIECE):
        for n in SIZES:
            x, k = c[at:at + PIECE + n - 1], is_letter[at:at + PIECE + n - 1]
            m = len(x) - n + 1
            if m <= 0:
                continue
            h, count = np.full(m, n, dtype=np.uint64), np.zeros(m, dtype=np.int8)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + x[j:j + m]
                count += k[j:j + m]
            h = h[count >= n - 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield h ^ (h >> np.uint64(32))


def _probe(h: np.ndarray, i: int) -> np.ndarray:
    """Row of the filter: bits of the hash, others for every probe."""
    return ((h * np.uint64(2 * i + 1)) >> np.uint64(20 + 18 * i)) & np.uint64(ROWS - 1)


class Filter:
    """Bit-sliced Bloom filter over the learned languages."""

    def __init__(self, languages: list[str], most_common: int = 0):
        self.languages, self.most_common = languages, most_common
        self.width = max(1, math.ceil(len(languages) / 8))     # bytes of a mask
        self.rows = np.zeros((ROWS, self.width), dtype=np.uint8)

    def add(self, language: int, hashes: np.ndarray) -> None:
        for i in range(PROBES):
            self.rows[_probe(hashes, i), language // 8] |= np.uint8(1 << language % 8)

    def close(self) -> "Filter":
        fill = np.unpackbits(self.rows, axis=1, bitorder="little").mean(axis=0)[:len(self.languages)]
        self.chance = np.minimum(fill ** PROBES, 0.999)
        return self

    def masks(self, h: np.ndarray) -> np.ndarray:
        m = self.rows[_probe(h, 0)]
        for i in range(1, PROBES):
            m = m & self.rows[_probe(h, i)]
        return m

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        counts, n = np.zeros(self.width * 8, dtype=np.int64), 0
        for h in grams(text or "", letters):
            counts += np.unpackbits(self.masks(h), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        hits = np.maximum((counts[:len(self.languages)] - n * self.chance) / (1 - self.chance), 0.0)
        if not hits.any():
            return self.languages[self.most_common], 0.0
        best = int(np.argmax(hits))               # ties: the first by name
        return self.languages[best], float(hits[best] / hits.sum())


def fit(docs: DataFrame, examples: int = EXAMPLES, max_grams: int = GRAMS) -> Filter:
    """Learn from rows with text and language that are not held out, at most
    about ``examples`` of each language. Without any, every text is ``und``."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()   # a row per language
    languages = [r["lang"] for r in counted]
    if not languages:
        return Filter([]).close()
    place = F.create_map(*[x for i, r in enumerate(counted) for x in (F.lit(r["lang"]), F.lit(i))])
    share = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1.0, examples / r["n"])))])
    sample = rows.where(F.pmod(row_hash(SEED, "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def run(batches):
        letters = letter_table()
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for t, i in zip(batch.column(0), batch.column(1)):
                by.setdefault(i.as_py(), []).extend(grams(t.as_py(), letters))
            for i, parts in by.items():
                g, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(np.full(len(g), i, dtype=np.int32)), pa.array(n.astype(np.int64))],
                    ["g", "l", "n"])

    found = (sample.select("text", F.element_at(place, F.col("lang")).alias("l"))
             .mapInArrow(run, "g long, l int, n long").groupBy("g", "l").agg(F.sum("n").alias("n")))
    found = stored(found.where("n >= 2"), "grams")
    totals = {r["l"]: r["t"] for r in found.groupBy("l").agg(F.sum("n").alias("t")).collect()}
    if not totals:
        return Filter(languages).close()
    total = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))])
    rate = found.withColumn("r", F.col("n") / F.element_at(total, F.col("l")))
    used = (rate.withColumn("top", F.max("r").over(Window.partitionBy("g"))).where(F.col("r") >= SHARE * F.col("top"))
            .withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g")))
            .where(F.col("place") <= max_grams).select("l", "g").collect())
    out = Filter(languages, max(range(len(counted)), key=lambda i: counted[i]["n"]))
    for i in range(len(languages)):
        out.add(i, np.array([r["g"] for r in used if r["l"] == i], dtype=np.int64).view(np.uint64))
    return out.close()


PREDICTED = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predicted_column(spark, model: Filter, text: str | Column = "text") -> Column:
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))    # fixed size: the filter

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ix, letters = cloudpickle.loads(shared.value), letter_table()
        for texts in batches:
            rows = [ix.predict(t.as_py(), letters) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    c = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(run, PREDICTED).asNondeterministic()(c)


def language(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) for every row.

    ``und`` with score 0 where the text is null, empty or has no letter; a text
    of letters none of whose n-grams is known takes the most common language
    with score 0. Ties go to the first language by name. Null languages teach
    nothing; a null doc_id is not held out. Repeated rows score alike.
    """
    model = fit(docs.select("doc_id", "text", "lang"), **how)
    rows = docs.select("doc_id", held_out().alias("held_out"), predicted_column(docs.sparkSession, model).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
