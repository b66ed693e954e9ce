"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 8).

Sizes are added up per source; targets share the total by weight, none above a
multiple of what its source holds. Equal-token blocks then go to the sources by
the highest quotients target / (2 j + 1), and each source's blocks go to its
shards the same way, so that every shard knows an integer quota. Within a shard
documents stand in a seeded order and the quota is taken from the front, going
round again where it is larger than the shard. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.llm.common import WHITE, row_hash, stored

BLOCK = 128              # tokens in a block
SHARD_TOKENS = 1 << 20   # a shard holds about so many tokens
SHARD_ROWS = 1 << 16     # ... or so many documents, whichever makes more shards
MAX_EPOCHS = 3


def ranked(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """Position from 0 in ``order`` without a one-task sort: range partitions,
    a count of each, running offsets over those counts."""
    parts = stored(df.repartitionByRange(order).withColumn("part", F.spark_partition_id())
                   .withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1), "ranked")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range partition.
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (parts.join(offsets, "part").withColumn(name, F.col("before") + F.col("place"))
            .drop("part", "place", "before"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, ...) -> the same with ``sid`` (place of the source
    in the order) and ``target``.

    Sources by code point, null last, weigh ``weights`` over and over. Targets
    share all tokens by weight; one above ``max_epochs`` times its source stops
    there and the excess is shared anew by weight until none is above.
    """
    sources = stored(
        ranked(sources, F.col("source").asc_nulls_last(), "sid").withColumn(
            "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                              (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs), "sources")
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = None           # tokens per unit of weight among the sources not capped
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.col("w") * F.lit(level)
        r = sources.agg(F.sum(F.when(capped, F.col("cap"))).alias("fixed"),
                        F.sum(F.when(~capped, F.col("w"))).alias("w"),
                        F.count_if(capped).alias("n")).first()
        if not r["w"]:
            break
        new = (float(total) - (r["fixed"] or 0.0)) / r["w"]
        # The level only rises; it stands when no further source is capped.
        more = sources.where(F.col("cap") < F.col("w") * F.lit(new)).count()
        level = new
        if more == r["n"]:
            break
    target = F.least(F.col("cap"), F.col("w") * F.lit(float(level or 0.0)))
    return sources.withColumn("target", target).drop("w", "cap")


def apportioned(df: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Sainte-Laguë: ``seats`` go one by one to the row with the highest quotient
    share / (2 j + 1), ties to the smaller ``key``. With ``group`` each group
    deals out its own ``seats``; without, the whole frame does, and ``key`` is
    unique in it. Adds column ``quota``.

    Rows start with round(share / divisor) at the plain divisor (all shares over
    all seats), which is what the highest quotients down to 1 / (2 divisor) give;
    what is missing or too much, at most half a seat a row, is settled by ranking
    the next quotients alone. No row per seat is ever made.
    """
    if group is None:
        def total(d, c):   # one number, without a one-task window
            return F.lit(d.agg(c.alias("x")).first()["x"])
    else:
        def total(d, c):
            return c.over(Window.partitionBy(group))
    d = df.withColumn("_all", total(df, F.sum("share"))).withColumn("_rows", total(df, F.count(F.lit(1))))
    d = d.withColumn("_fair", F.when(F.col("_all") > 0, F.col("share") / F.col("_all") * F.col("seats")).otherwise(0.0))\
         .withColumn("_base", F.floor(F.col("_fair") + 0.5).cast("long"))
    d = d.withColumn("_left", F.when(F.col("_all") > 0, F.col("seats") - total(d, F.sum("_base"))).otherwise(0))
    # A row gains or loses at most fair * (left + rows) / seats + 1 of the rest.
    reach = F.ceil(F.col("_fair") * (F.abs("_left") + F.col("_rows")) / F.greatest(F.col("seats"), F.lit(1))) + 1
    reach = F.when(F.col("_left") > 0, F.least(reach, F.col("_left")))\
        .when(F.col("_left") < 0, F.least(reach, -F.col("_left"), F.col("_base"))).otherwise(0).cast("long")
    # Missing seats go to the highest next quotients; spare ones leave the lowest.
    gain = F.col("_left") > 0
    steps = (d.withColumn("_step", F.explode(F.when(reach > 0, F.sequence(F.lit(1).cast("long"), reach))))
             .withColumn("_q", F.col("share") / (2 * (F.col("_base") + F.when(gain, F.col("_step") - 1)
                                                      .otherwise(-F.col("_step"))) + 1))
             .withColumn("_order", F.when(gain, -F.col("_q")).otherwise(F.col("_q"))))
    if group is None:
        steps = ranked(steps.select(key, "_left", "_order", "_step"),
                       F.struct("_order", key, "_step").asc(), "_place")
        at = [key]
    else:
        steps = steps.withColumn("_place", F.row_number().over(
            Window.partitionBy(group).orderBy("_order", key, "_step")) - 1)
        at = [group, key]
    moved = (steps.where(F.col("_place") < F.abs("_left"))
             .groupBy(*at).agg(F.sum(F.signum("_left")).cast("long").alias("_moved")))
    return (d.join(moved, at, "left").withColumn("quota", F.col("_base") + F.coalesce("_moved", F.lit(0)))
            .select(*df.columns, "quota"))


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WHITE)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, weights, block: int, max_epochs: int, seed: int):
    """Sized documents, sources with targets, shards with their words."""
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"),
                               row_hash(seed, "doc_id", "text").alias("h")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    t = targets(sources, weights, max_epochs)
    total = t.agg(F.sum("target").alias("x")).first()["x"] or 0.0
    t = apportioned(t.withColumn("seats", F.lit(int(total / block + 0.5))).withColumn("share", F.col("target")), "sid")
    t = stored(t.select(
        "source", "sid", "source_size", "target", F.col("quota").alias("blocks"),
        F.greatest(F.ceil(F.col("source_size") / SHARD_TOKENS), F.ceil(F.col("docs") / SHARD_ROWS),
                   F.lit(1)).alias("shards")), "targets")
    placed = _placed(sized, t, seed)
    shards = (placed.groupBy("sid", "shard")
              .agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("seats"))
              .withColumn("share", F.col("shard_size").cast("double")))
    words = F.least(F.col("quota") * block, F.col("shard_size") * max_epochs)
    shards = (apportioned(shards, "shard", "sid").select("sid", "shard", "shard_size", words.alias("words"))
              .withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size")))
                          .otherwise(0).cast("long"))
              .withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
              .select("sid", "shard", "rounds", "rest"))
    return t, placed, stored(shards, "shards")


def _small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A stored table of few columns is broadcast only up to a counted size."""
    return F.broadcast(df) if df.count() <= rows else df


def _placed(sized: DataFrame, t: DataFrame, seed: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col("h")), F.col("shards"))
    t = t.withColumnRenamed("source", "_source")
    return (sized.join(_small(t), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("shard", shard).drop("_source", "shards"))


def _taken(placed: DataFrame, shards: DataFrame) -> DataFrame:
    """A shard is bounded in tokens and rows, so its order is a bounded sort."""
    before = F.sum("size").over(Window.partitionBy("sid", "shard").orderBy("h", "doc_id")
                                .rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(before, F.lit(0))))
    return placed.join(shards, ["sid", "shard"]).withColumn("part", part)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block: int = BLOCK,
        max_epochs: int = MAX_EPOCHS, seed: int = 8) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document.

    Size: words of the text (null or empty: 0). ``taken``: words the mix takes
    of the document, repeats counted: whole rounds of its shard, and in the last
    round what the quota covers in the shard's seeded order (a document on the
    edge is taken in part). Nothing is taken above ``max_epochs`` times a size.
    Null sources are one source; null ids and texts are hashed as such. Repeated
    rows are documents of their own. Equal seeds give equal results. An empty
    table gives an empty result, as does a corpus without words zeros.
    """
    _, placed, shards = _plan(docs, weights, block, max_epochs, seed)
    return _taken(placed, shards).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block: int = BLOCK,
                    max_epochs: int = MAX_EPOCHS, seed: int = 8) -> DataFrame:
    """The mix as rows of ``docs``, all columns kept: each whole document as many
    times as the mix takes it; documents not taken go. The document on the edge
    of its shard's quota is taken whole if at least half of it is, and not at all
    otherwise; equal rows stand or fall together. Texts are not shuffled: every
    shard is told by one hash, up to which its documents have a round more.
    """
    t, placed, shards = _plan(docs, weights, block, max_epochs, seed)
    edge = (_taken(placed, shards).where((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")))
            .groupBy("sid", "shard").agg(F.max("h").alias("edge")))
    edges = stored(shards.join(edge, ["sid", "shard"], "left").select("sid", "shard", "rounds", "edge"), "edges")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source"),
                       row_hash(seed, "doc_id", "text").alias("h"))
    n = (F.col("rounds") + F.when(F.col("h") <= F.col("edge"), 1).otherwise(0)).cast("int")
    return (_placed(rows, t, seed).join(_small(edges), ["sid", "shard"]).select("row", n.alias("n"))
            .where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*"))
