"""Benchmark decontamination by a distributed positional inverted index
(operator 6).

Corpus counts of all test terms tell the rarest terms of every test window. The
index stores postings of those terms: (term, document, position) with the words
around it. Postings, moved back by the term's offset in an item, give alignments
of item and document; an alignment at which both rarest terms of a window meet
is checked word by word against the stored surroundings. No document text is
shuffled and nothing that grows is broadcast: tasks know the test terms by a
bitmap of fixed size, whose chance hits fall out in the join.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.llm.common import row_hash, stored

WINDOW = 13
BITS = 1 << 22           # bitmap of test terms: 512 KB whatever the benchmark's size
NEAR = 4                 # rarest present terms of an item's window that tell of its proximity
OUT_ROWS = 2048
SEED = 6
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# ASCII letters in lower case, ASCII digits and all else beyond ASCII are words.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_KEEP).split()


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bitmap(terms: DataFrame) -> bytes:
    """Bitmap over crc32 of column ``word``; at most BITS / 32768 rows come here."""
    bit = (F.crc32(F.col("word").cast("binary")) % BITS) + 1
    rows = (terms.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect())
    out = bytearray(BITS // 8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at:at + 4096] = r["m"]
    return bytes(out)


def _known(bits: bytes, word: bytes) -> bool:
    b = zlib.crc32(word) % BITS
    return bool(bits[b >> 3] >> (b & 7) & 1)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(tid, item_id, n, words): distinct item texts with their word lists; items
    of equal words share a tid."""
    return (benchmark.select("item_id", F.regexp_extract_all(_lower(F.col("text")), F.lit(TERMS), 0).alias("words"))
            .where(F.size("words") > 0)
            .select("item_id", F.size("words").alias("n"), "words", F.xxhash64("words").alias("tid")).distinct())


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, cf): occurrences of each test term in all documents."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(bitmap(terms))

    def run(batches):
        bits, total = shared.value, Counter()
        for batch in batches:
            seen = Counter()
            for t in batch.column(0):
                if t.is_valid:
                    seen.update(words_of(t.as_buffer().to_pybytes()))
            for w, n in seen.items():
                if _known(bits, w):
                    total[w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            ["word", "n"])

    counted = (docs.select(F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("cf")))
    return terms.join(counted, "word", "left").select("word", F.coalesce("cf", F.lit(0)).alias("cf"))


def windows(items: DataFrame, counts: DataFrame, width: int = WINDOW) -> DataFrame:
    """(tid, s, len, first, second): the offsets of each window's two rarest
    terms; one and the same for a window of a single term."""
    tokens = (items.select("tid", "n", F.posexplode("words").alias("o", "word")).distinct().join(counts, "word"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    each = tokens.withColumn("s", F.explode(F.sequence(F.greatest(F.col("o") - width + 1, F.lit(0)),
                                                       F.least(F.col("o"), last))))
    each = each.groupBy("tid", "n", "s", "word", "cf").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("tid", "s").orderBy("cf", "word"))
    return (each.withColumn("place", place).where("place <= 2")
            .groupBy("tid", "s", "n").agg(F.min(F.when(F.col("place") == 1, F.col("o"))).alias("first"),
                                          F.min(F.when(F.col("place") == 2, F.col("o"))).alias("second"),
                                          F.min("cf").alias("cf"))
            .where("cf > 0")
            .select("tid", "s", F.least("n", F.lit(width)).alias("len"), "first",
                    F.coalesce("second", "first").alias("second")))


def positional_index(docs: DataFrame, terms: DataFrame, around: int = WINDOW - 1) -> DataFrame:
    """Stored index: a row (rid, h, doc_id, n_words) per document, word null, and
    a posting (rid, word, pos, left, near) per occurrence of a term; ``near`` are
    the words from ``left`` places before it to ``around`` behind it."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms))
    names = ["rid", "h", "doc_id", "n_words", "word", "pos", "left", "near"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        bits, rid = shared.value, TaskContext.get().partitionId() << 33
        memory: dict[bytes, bool] = {}
        rows: list[tuple] = []

        def flush():
            cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for h, d, t in zip(*(batch.column(c) for c in ("h", "doc_id", "text"))):
                words = words_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                rows.append((rid, h.as_py(), d.as_py(), len(words), None, None, None, None))
                distinct = set(words)
                fresh = [w for w in distinct if w not in memory]
                if len(memory) + len(fresh) > 300_000:
                    memory.clear()
                    fresh = distinct
                for w in fresh:
                    memory[w] = _known(bits, w)
                hits = {w for w in distinct if memory[w]}
                if hits:
                    for i, w in enumerate(words):
                        if w in hits:
                            a = max(0, i - around)
                            rows.append((rid, None, None, None, w.decode(), i, i - a,
                                         [x.decode() for x in words[a:i + around + 1]]))
                            if len(rows) >= OUT_ROWS:
                                yield flush()
                                rows = []
                rid += 1
                if len(rows) >= OUT_ROWS:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    schema = ("rid long, h long, doc_id long, n_words long, word string, pos long, left int, near array<string>")
    picked = docs.select(row_hash(SEED, "doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("binary").alias("text"))
    return stored(picked.mapInArrow(run, schema), "positional-index")


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table is broadcast only up to a counted size."""
    return F.broadcast(df) if df.count() <= rows else df


def phrase_matches(index: DataFrame, items: DataFrame, wins: DataFrame) -> DataFrame:
    """(rid, tid, start, len): every exact occurrence of every window."""
    ends = wins.select("tid", F.explode(F.array_distinct(F.array("first", "second"))).alias("o")).distinct()
    tokens = items.select("tid", "n", F.posexplode("words").alias("o", "word")).distinct()
    anchors = stored(ends.join(tokens, ["tid", "o"]).select("tid", "word", "o"), "anchors")
    postings = index.where(F.col("word").isNotNull()).select("rid", "word", "pos", "left", "near")
    # Offset-adjusted lists: the place in the document at which the item starts.
    aligned = (postings.join(_small(anchors), "word")
               .groupBy("rid", "tid", (F.col("pos") - F.col("o")).alias("at"))
               .agg(F.collect_list(F.struct("o", "left", "near")).alias("met")))   # at most one per item word
    texts = items.select("tid", "words").distinct()
    wins = stored(wins.join(texts, "tid").select(
        "tid", "s", "len", "first", "second", F.slice("words", F.col("s") + 1, F.col("len")).alias("words")), "windows")
    # A window meets the alignments that hold its first rarest term, not all of its item.
    pairs = aligned.select("rid", "tid", "at", F.transform("met", lambda m: m["o"]).alias("offsets"), F.explode("met").alias("own"))
    pairs = pairs.withColumn("first", F.col("own.o")).join(_small(wins), ["tid", "first"])
    pairs = pairs.where(F.array_contains("offsets", F.col("second")) & (F.col("at") + F.col("s") >= 0))
    there = F.slice(F.col("own.near"), F.greatest(F.col("own.left") - (F.col("first") - F.col("s")) + 1, F.lit(1)), F.col("len"))
    fits = (F.col("own.left") >= F.col("first") - F.col("s")) & (there == F.col("words"))
    return pairs.where(fits).select("rid", "tid", (F.col("at") + F.col("s")).alias("start"), "len")


def near_terms(items: DataFrame, counts: DataFrame, width: int = WINDOW) -> DataFrame:
    """(tid, o): offsets of the NEAR rarest terms of each window, of those that
    the corpus has at all; of the whole item where it is shorter."""
    tokens = (items.select("tid", "n", F.posexplode("words").alias("o", "word")).distinct()
              .join(counts.where("cf > 0"), "word"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    each = tokens.withColumn("s", F.explode(F.sequence(F.greatest(F.col("o") - width + 1, F.lit(0)),
                                                       F.least(F.col("o"), last))))
    each = each.groupBy("tid", "s", "word", "cf").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("tid", "s").orderBy("cf", "word"))
    return each.withColumn("place", place).where(F.col("place") <= NEAR).select("tid", "o").distinct()


def proximity_matches(index: DataFrame, items: DataFrame, wins: DataFrame, span: int = 2 * WINDOW,
                      least: int = 3) -> DataFrame:
    """(rid, tid, start, n_terms): places from which ``span`` words hold at least
    ``least`` different terms of an item, in any order, or all words of an item
    that has fewer. ``wins`` are windows or near_terms; the terms are theirs."""
    tokens = items.select("tid", F.posexplode("words").alias("o", "word"), F.size(F.array_distinct("words")).alias("own"))
    ends = (wins.select("tid", F.explode(F.array("first", "second")).alias("o")) if "first" in wins.columns
            else wins.select("tid", "o")).distinct()
    terms = stored(ends.join(tokens, ["tid", "o"])
                   .select("tid", "word", F.least("own", F.lit(least)).alias("least")).distinct(), "terms")
    ahead = Window.partitionBy("rid", "tid").orderBy("pos").rangeBetween(0, span - 1)   # span postings at most
    near = index.where(F.col("word").isNotNull()).select("rid", "word", "pos").join(_small(terms), "word")
    return (near.withColumn("n_terms", F.size(F.collect_set("word").over(ahead)))
            .where(F.col("n_terms") >= F.col("least")).select("rid", "tid", F.col("pos").alias("start"), "n_terms"))


def proximity(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, span: int = 2 * WINDOW,
              least: int = 3) -> DataFrame:
    """doc_id, n_words, n_near, near_ids per row of ``docs``: the items, by id as
    text, of which the row has a proximity match, whether word for word or not."""
    items = stored(item_terms(benchmark), "items")
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    wins = stored(near_terms(items, stored(term_counts(docs, vocabulary), "term-counts"), width), "near-terms")
    tokens = items.select("tid", F.posexplode("words").alias("o", "word")).distinct()
    index = positional_index(docs, wins.join(tokens, ["tid", "o"]).select("word").distinct(), 0)
    near = proximity_matches(index, items, wins, span, least).select("rid", "tid").distinct()
    named = (near.join(items.where(F.col("item_id").isNotNull()).select("tid", F.col("item_id").cast("string").alias("i")).distinct(), "tid")
             .groupBy("rid").agg(F.sort_array(F.collect_set("i")).alias("ids")))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (index.where(F.col("word").isNull()).select("rid", "doc_id", "n_words").join(named, "rid", "left")
            .select("doc_id", "n_words", F.size(ids).cast("long").alias("n_near"), ids.alias("near_ids")))


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW):
    """(index, items, windows) of the distributed search, index stored."""
    items = stored(item_terms(benchmark), "items")
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    counts = stored(term_counts(docs, vocabulary), "term-counts")
    wins = stored(windows(items, counts, width), "rarest")
    tokens = items.select("tid", F.posexplode("words").alias("o", "word")).distinct()
    ends = wins.select("tid", F.explode(F.array("first", "second")).alias("o")).distinct()
    terms = ends.join(tokens, ["tid", "o"]).select("word").distinct()
    return positional_index(docs, terms, width - 1), items, wins


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, h per row of
    ``docs`` (doc_id, text); h is the row's hash.

    Words are runs of ASCII letters, digits and anything beyond ASCII, in ASCII
    lower case. A window is ``width`` consecutive words of an item, or a whole
    shorter item. A null or empty text has no words and is never hit; so are null
    or wordless items. Items without an id mark hits but are not counted or
    named. Repeated items count once by id; repeated documents are rows of their
    own. An empty benchmark contaminates nothing.
    """
    index, items, wins = search(docs, benchmark, width)
    found = stored(phrase_matches(index, items, wins).distinct(), "matches")
    end = F.col("start") + F.col("len")
    spans = found.select("rid", "start", end.alias("end")).distinct()
    # One document's spans: the part of each that no earlier one covers.
    so_far = F.max("end").over(Window.partitionBy("rid").orderBy("start", "end")
                               .rowsBetween(Window.unboundedPreceding, -1))
    hits = (spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(so_far, F.lit(0))))
            .groupBy("rid").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit")))
    named = (found.select("rid", "tid").distinct()
             .join(items.where(F.col("item_id").isNotNull()).select("tid", F.col("item_id").cast("string").alias("i")).distinct(), "tid")
             .groupBy("rid").agg(F.sort_array(F.collect_set("i")).alias("ids")))
    rows = index.where(F.col("word").isNull()).select("rid", "h", "doc_id", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (rows.join(hits, "rid", "left").join(named, "rid", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "h"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept."""
    bad = stored(contamination(docs, benchmark, width).where("contaminated").select("h").distinct(), "contaminated")
    h = row_hash(SEED, "doc_id", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), h.alias("h"))
    return rows.join(_small(bad, 1_000_000), "h", "left_anti").select("row.*")
