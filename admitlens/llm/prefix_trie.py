"""Conversation prefix trie by a splitter skeleton (operator 11).

Conversations are paths of turns. They are sorted by path into range partitions;
the trie of the paths that split the range is the skeleton, broadcast to all tasks.
A node off the skeleton has all its members in one partition, so a pass over the
sorted partition finishes it; skeleton nodes get a partial aggregate from every
partition, which are reduced.

Paths of any length: a path is cut into segments of ``SEGMENT`` turns. A segment's
item is sorted under its context, the digest of the segments before it, so no item
holds more than one segment; the top of a context is the deepest node of the segment
above. Such nodes and those above them are reduced like the skeleton's.

A node's own figures (saved tokens, being a leaf) are known after the reduction. They
belong to its smallest member, and sums over subtrees are sums over the later depths
of the members, taken per segment and then per turn, so a conversation of any length
passes through no single task in full.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.llm.common import stored
from admitlens.session import maybe_broadcast

SEGMENT = 64             # turns of a path in one item
DIGEST = 32              # hexadecimal digits of a digest
SHARD_TURNS = 400_000    # turns aimed at in a range partition
SAMPLES = 20             # sampled items a partition, from which the splitters come
BLOCK_IDS = 1024         # ids of one node that are written together
SEED = 11


# --- conversations as ordered turns ------------------------------------------

def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns numbered from 1 by turn (null first), then
    role and the SHA-256 of the text; null roles and texts are empty; rows without
    conv_id take no part. Texts are left behind; the digest tells (role, text) apart.

    Turns are range-partitioned, and a conversation that spans partitions is numbered
    by adding up its counts, so none is sorted by one task."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("of_text"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("nth"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nth deals out equal rows; their order makes no difference.
    rows = stored(rows.repartitionByRange(parts, "conv_id", "turn", "role", "of_text", "nth").drop("nth")
                  .withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "of_text"))
    return rows.withColumn("local", local).join(counts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("local")).alias("pos"),
        F.substring(F.sha2(F.concat(F.col("of_text"), F.col("role")), 256), 1, DIGEST).alias("digest"), "chars")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared beginnings: every conv_id c begins with the first h
    turns of conversation c - c % ``group`` (all, if fewer; none, if absent), in place
    of its own first h; h = crc32(c as text) % ``heads``. Returns the turns and the
    distinct conv_ids, turnless ones too."""
    own = turns.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long"))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("begin"))   # less than heads turns
    convs = turns.where("pos = 1").select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(first, "base", "left")
    convs = convs.withColumn("begin", F.slice(F.coalesce("begin", F.array().cast(f"array<{TURN}>")), F.lit(1), F.col("h")))
    convs = stored(convs.select("conv_id", "begin"), "beginnings")
    begun = convs.select("conv_id", F.explode("begin").alias("t")).select("conv_id", "t.pos", "t.digest", "t.chars")
    rest = own.where(F.col("pos") > F.col("h")).join(convs.select("conv_id", F.size("begin").alias("k")), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "chars")
    return begun.unionByName(rest), convs.select("conv_id")


# --- items --------------------------------------------------------------------

ROOT = "root"
TURN = "struct<pos:bigint,digest:string,chars:bigint>"


def _key(level: Column, context: Column, prefix_sha: Column) -> Column:
    """Key of the node at a prefix of a segment, from the prefix's SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", level.cast("string"), context, prefix_sha), 256), 1, DIGEST)


def node_key(level: int, context: str, prefix: str) -> str:
    of = hashlib.sha256(prefix.encode()).hexdigest()
    return hashlib.sha256(f"{level}|{context}|{of}".encode()).hexdigest()[:DIGEST]


def path_items(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and segment of its path: conv_id, level (segments
    before), context, up (key of the node at the top), path (digests one after
    another), chars (of each turn's text), goes_on (whether a segment follows).

    A context is the sum, in two lanes, of the digests of the segments before with
    their levels, so a running sum over one row per segment gives it."""
    rows = turns.withColumn("level", F.expr(f"cast((pos - 1) div {SEGMENT} as int)")).unionByName(
        convs.select("conv_id", F.lit(0).alias("level")), allowMissingColumns=True)
    said = F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "chars"))
    items = stored(rows.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(said)).alias("t")).select(
        "conv_id", "level", F.array_join(F.col("t.digest"), "").alias("path"), F.col("t.chars").alias("chars")), "segments")
    full = F.char_length("path") == DIGEST * SEGMENT
    plain = items.where(~full & (F.col("level") == 0)).withColumn("context", F.lit("0:0")).withColumn(
        "up", F.lit(ROOT)).withColumn("goes_on", F.lit(False))
    of = F.sha2("path", 256)

    def lane(start):
        digits = F.substring(F.sha2(F.concat_ws("|", F.col("level").cast("string"), of), 256), start, 15)
        return F.conv(digits, 16, 10).cast("decimal(38,0)")

    above = items.where(full).select("conv_id", "level", of.alias("of"), lane(1).alias("a"), lane(16).alias("b"))
    by = Window.partitionBy("conv_id").orderBy("level")

    def context(upto):
        return F.concat_ws(":", *[F.coalesce(F.sum(x).over(by.rowsBetween(Window.unboundedPreceding, upto)),
                                             F.lit(0).cast("decimal(38,0)")).cast("string") for x in "ab"])

    above = above.select("conv_id", (F.col("level") + 1).alias("level"), context(0).alias("context"),
                         _key(F.col("level"), context(-1), F.col("of")).alias("up"))
    later = items.where("level > 0").select("conv_id", (F.col("level") - 1).alias("level"), F.lit(True).alias("goes_on"))
    long = items.where(full | (F.col("level") > 0)).join(above, ["conv_id", "level"], "left").join(
        later, ["conv_id", "level"], "left").withColumns({
            "context": F.coalesce("context", F.lit("0:0")), "up": F.coalesce("up", F.lit(ROOT)),
            "goes_on": F.coalesce("goes_on", F.lit(False))})
    return plain.unionByName(long)


# --- the pass over sorted partitions ------------------------------------------

NODE, PARTIAL, ENDS = 0, 1, 2
PASS_TYPE = ("kind int, key string, parent_key string, conv_id long, depth long, parent_conv long, n long, ch long, "
             "lv long, sv long, chars long, below boolean, ends string")
COLUMNS = ("kind", "key", "parent_key", "conv_id", "depth", "parent_conv", "n", "ch", "lv", "sv", "chars", "below", "ends")
NONE = hashlib.sha256(b"").hexdigest()


def common_turns(a: str, b: str) -> int:
    """Turns at the start that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    at = 0
    while a[at:at + DIGEST] == b[at:at + DIGEST]:
        at += DIGEST
    return at // DIGEST


class Shard:
    """Local trie of one partition, built from its items in order. ``edges``: the
    splitters at its two ends; their paths are the skeleton's share in it."""

    def __init__(self, edges: list[tuple[int, str, str, int]]):
        self.edges = edges
        self.depth, self.parent, self.n, self.least = array("q"), array("q"), array("q"), array("q")
        self.children, self.leaves, self.saved, self.chars = array("q"), array("q"), array("q"), array("q")
        self.keys: dict[int, str] = {}           # of nodes that are reduced
        self.below: set[int] = set()             # of those, tops of later segments
        self.ends: dict[int, str] = {}           # digests of nodes done here
        self.blocks: list[tuple[str, int, str]] = []
        self.stack: list[int] = []
        self.ended: list[array] = []             # per node of the stack: members that end there
        self.open: list[bool] = []               # per node of the stack: to be reduced
        self.top: tuple | None = None
        self.path = ""

    def push(self, chars: int, is_open: bool) -> None:
        at = len(self.n)
        self.depth.append(self.top[0] * SEGMENT + len(self.stack))
        self.parent.append(self.stack[-1] if self.stack else -1)
        for x in (self.n, self.children, self.leaves, self.saved):
            x.append(0)
        self.least.append((1 << 63) - 1)
        self.chars.append(chars)
        self.stack.append(at)
        self.ended.append(array("q"))
        self.open.append(is_open)

    def pop(self) -> None:
        at, ended, is_open, j = self.stack.pop(), self.ended.pop(), self.open.pop(), len(self.stack)
        up = self.parent[at]
        if is_open:
            level, context, above = self.top
            if j:
                self.keys[at] = node_key(level, context, self.path[:DIGEST * j])
            else:
                self.keys[at] = above
                if level:
                    self.below.add(at)
            for i in range(0, len(ended), BLOCK_IDS):
                self.blocks.append((self.keys[at], ended[i], ",".join(map(str, ended[i:i + BLOCK_IDS]))))
        else:
            self.leaves[at] += not self.children[at]
            self.saved[at] += (self.n[at] - 1) * self.chars[at]
            self.children[up] += 1
            if ended:
                self.ends[at] = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        if up >= 0:
            self.n[up] += self.n[at]
            self.least[up] = min(self.least[up], self.least[at])
            self.leaves[up] += self.leaves[at]
            self.saved[up] += self.saved[at]
            self.open[-1] |= is_open

    def add(self, level: int, context: str, up: str, path: str, chars: list[int], conv_id: int, goes_on: bool) -> None:
        shared = common_turns(self.path, path)
        if self.top is None or self.top[:2] != (level, context):
            shared = -1
        while len(self.stack) > shared + 1:
            self.pop()
        self.path = path
        if shared < 0:
            self.top = (level, context, up)
            self.push(0, True)
        skeleton = max([common_turns(e[2], path) for e in self.edges if e[:2] == (level, context)], default=0)
        for j in range(len(self.stack), len(path) // DIGEST + 1):
            self.push(chars[j - 1], j <= skeleton)
        at = self.stack[-1]
        self.n[at] += 1
        self.least[at] = min(self.least[at], conv_id)
        if goes_on:
            self.open[-1] = True
        else:
            self.ended[-1].append(conv_id)

    def rows(self) -> Iterator[tuple]:
        while self.stack:
            self.pop()
        for at in range(len(self.n)):
            up = self.parent[at]
            key, above = self.keys.get(at), self.keys.get(up)
            yield (PARTIAL if key else NODE, key, above, self.least[at], self.depth[at],
                   self.least[up] if above is None and up >= 0 else None, self.n[at], self.children[at], self.leaves[at],
                   self.saved[at], self.chars[at], at in self.below, None if key else self.ends.get(at, NONE))
        for key, first, ids in self.blocks:
            yield (ENDS, key, None, first, *[None] * 7, False, ids)


def splitters_of(items: DataFrame, parts: int, total: int) -> list[tuple[int, str, str, int]]:
    """At most ``parts`` - 1 items that cut the sorted items into like shares, from a
    bounded sample; they decide where nodes are made, not which."""
    if parts < 2 or not total:
        return []
    sample = items.select("level", "context", "path", "conv_id")
    if total > parts * SAMPLES:
        sample = sample.sample(False, parts * SAMPLES / total, SEED)
    found = sorted(tuple(r) for r in sample.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)} if found else [])


def local_tries(items: DataFrame) -> DataFrame:
    """Rows of ``PASS_TYPE`` from all range partitions: nodes that are done, partial
    aggregates of the others, and blocks of the ids that end at those."""
    spark = items.sparkSession
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("chars")), F.lit(0)).alias("turns")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["turns"] // SHARD_TURNS), 1)
    cuts = splitters_of(items, parts, size["rows"])
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(level, context, path, conv_id):
        at = held.value
        return level.__class__([bisect_right(at, x) for x in zip(level.tolist(), context, path, conv_id.tolist())], dtype="int32")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"kind": pa.int32(), "key": pa.string(), "parent_key": pa.string(), "below": pa.bool_(), "ends": pa.string()}

        def made(trie: Shard) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in trie.rows():
                rows.append(row)
                if len(rows) == 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kinds.get(c, pa.int64())) for c, x in zip(COLUMNS, zip(*rows))], names=list(COLUMNS))

        cuts, trie, now = held.value, None, None
        for batch in batches:
            for shard, *item in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if trie is not None:
                        yield from made(trie)
                    trie, now = Shard(cuts[max(shard - 1, 0):shard + 1]), shard
                trie.add(*item)
        if trie is not None:
            yield from made(trie)

    dealt = items.withColumn("shard", shard_of("level", "context", "path", "conv_id")).repartitionById(len(cuts) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "level", "context", "path", "conv_id").select(
        "shard", "level", "context", "up", "path", "chars", "conv_id", "goes_on")
    return dealt.mapInArrow(work, PASS_TYPE)


# --- the reduction ------------------------------------------------------------

def _digested(blocks: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of each node, whose blocks stream by in order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            keys, ends = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        ends.append(h.hexdigest())
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], names=["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], names=["key", "ends"])

    return blocks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(
        work, "key string, ends string")


def _reduced(local: DataFrame, items: DataFrame) -> DataFrame:
    """Skeleton nodes and others that several items share, from their partial
    aggregates: conv_id, depth, key, parent_key, n, ch, lv, sv, ends."""
    own = ~F.col("below")
    nodes = stored(local.where(F.col("kind") == PARTIAL).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n"), F.sum("ch").alias("ch"), F.max("chars").alias("chars"),
        *[F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name) for c, cond, name in
          (("lv", own, "lv"), ("sv", own, "sv"), ("lv", ~own, "lv_below"), ("sv", ~own, "sv_below"))]), "partials")
    kids = nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = stored(nodes.join(kids, "key", "left").withColumn("ch", F.col("ch") + F.coalesce("kids", F.lit(0))).drop("kids"), "skeleton")

    # What each node adds to itself and to all above it, as its smallest member's.
    adds = nodes.select(
        "conv_id", F.expr(f"cast(greatest(depth - 1, 0) div {SEGMENT} as int)").alias("level"), "depth",
        (F.col("lv_below") + (F.col("ch") == 0).cast("long")).alias("lv"),
        (F.col("sv_below") + (F.col("n") - 1) * F.col("chars")).alias("sv")).where("lv <> 0 or sv <> 0")
    # One row per segment, with at most a segment's depths in it.
    adds = adds.groupBy("conv_id", "level").agg(
        F.collect_list(F.struct((F.col("depth") - F.col("level") * SEGMENT).cast("int").alias("j"), "lv", "sv")).alias("adds"),
        F.sum("lv").alias("lv"), F.sum("sv").alias("sv"))
    last = adds.groupBy("conv_id").agg(F.max("level").alias("last"))
    paths = items.select("conv_id", "level", "context", "path").join(last, "conv_id").where("level <= last")
    paths = paths.join(adds, ["conv_id", "level"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = paths.select("conv_id", "level", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_later") for c in ("lv", "sv")])
    paths = paths.drop("lv", "sv").join(later, ["conv_id", "level"])
    none = F.array().cast("array<struct<j:int,lv:bigint,sv:bigint>>")
    paths = paths.withColumn("adds", F.coalesce("adds", none))
    # The top of a later segment is the deepest node of the one before.
    reach = F.when(F.col("level") < F.col("last"), F.lit(SEGMENT)).otherwise(F.array_max(F.col("adds.j")))
    steps = paths.withColumn("j", F.explode(F.sequence(F.when(F.col("level") > 0, 1).otherwise(0), reach)))

    def summed(c):
        return F.aggregate(F.filter("adds", lambda x: x["j"] >= F.col("j")), F.col(f"{c}_later"), lambda n, x: n + x[c])

    prefix = F.sha2(F.substring(F.col("path"), F.lit(1), F.col("j") * DIGEST), 256)
    key = F.when(F.col("j") == 0, F.lit(ROOT)).otherwise(_key(F.col("level"), F.col("context"), prefix))
    more = steps.select(key.alias("key"), summed("lv").alias("lv_more"), summed("sv").alias("sv_more")).groupBy("key").agg(
        F.sum("lv_more").alias("lv_more"), F.sum("sv_more").alias("sv_more"))
    ends = _digested(local.where(F.col("kind") == ENDS))
    return nodes.join(more, "key", "left").join(ends, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n", "ch", (F.col("lv") + F.coalesce("lv_more", F.lit(0))).alias("lv"),
        (F.col("sv") + F.coalesce("sv_more", F.lit(0))).alias("sv"), F.coalesce("ends", F.lit(NONE)).alias("ends"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members but one times characters of the last text), ends_sha256 (of the
    ids of the members that end there, ascending, joined by commas).

    ``turns`` (conv_id, pos, digest, chars) hold each conversation's turns at pos 1, 2,
    ... (see ``placed_turns``), ``convs`` (conv_id) every conversation once, turnless
    ones too. No conversation: no node, not even the root. The ids of one node are
    digested in order by one task, as the digest asks; it holds one block at a time.
    Copies of a conversation are sorted by id too, so many of them spread over
    partitions."""
    items = stored(path_items(turns, convs), "items")
    local = stored(local_tries(items), "tries")
    shared = stored(_reduced(local, items), "shared")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    columns = ["conv_id", "depth", F.coalesce("parent_conv", "of_parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
               F.col("ch").alias("n_children"), F.col("lv").alias("n_leaves"), F.col("sv").alias("saved_tokens"),
               F.col("ends").alias("ends_sha256")]
    done = local.where(F.col("kind") == NODE).drop("kind", "key", "chars", "below")
    shared = shared.drop("key").withColumn("parent_conv", F.lit(None).cast("long"))
    return done.unionByName(shared).join(maybe_broadcast(parents), "parent_key", "left").select(*columns)
