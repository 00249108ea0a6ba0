r"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words (``[^\x20\x09-\x0D]+``). A source's documents, in a hashed order, are one stream that is cut into
blocks of ``BLOCK`` words. The mix is a list of output slots of one block each, in shards of ``SHARD``. A source's
quota is the number of slots at which it meets its target with its mean words a block. Each slot of a shard draws its
source by the quotas' shares, so a shard's counts are multinomial. Draws beyond a source's quota are void, and what
is short of a quota goes to settlement shards at the end, so that the totals are the quotas. A source's slots are
numbered through, and slot q takes block pi(q mod n) of its n blocks, where pi is a pseudorandom permutation (a
Feistel network over a grid of about n cells, walked on until it lands inside) that changes with each pass q div n.
Nothing is random at run time: reruns agree. Sources are few (tens or hundreds): their shares are one array.

Defined cases: a null text has size 0; null is a source of its own, the last one; ids may be null or repeated (order
within a source is by id and text, so only identical rows tie, and they count alike); a source without words has
target 0; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialize, maybe_broadcast

BLOCK = 64
SHARD = 4096
LIMIT = 3
WEIGHTS = (5, 2, 1)
CHUNK_DOCS = 4096
ROUNDS = 6
WORD_GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> target: weights cycle by code point order; water-filling under ``limit`` times a size.

    Sources that stop at their limit are those with the least limit/weight, so one pass in that order finds the level.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("double")
    df = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * float(limit)).withColumn("ratio", F.col("top") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    df = df.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    df = df.withColumn("nth", F.row_number().over(by))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every)["level"]  # the first that fits
    return df.withColumn("level", level).drop("nth").withColumn("target", F.least(F.col("top"), F.col("w") * F.col("level"))).drop("level", "top", "ratio")


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """pi(x) for x in 0..n-1: a permutation of these numbers for each key.

    The grid has a * b >= n cells, fewer than a too many. A number that lands on one of these walks on until it is home,
    which takes as many steps as there are such cells at most.
    """
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")
    turn = lambda v, by, i, m: (v + F.pmod(F.xxhash64(by, i, *key), m)) % m

    def spin(v: Column) -> Column:
        cell = F.struct((v % a).alias("l"), ((v - v % a) / a).cast("long").alias("r"))
        step = lambda s, i: F.when(i % 2 == 0, F.struct(turn(s["l"], s["r"], i, a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), turn(s["r"], s["l"], i, b).alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cell, step, lambda s: s["r"] * a + s["l"])

    walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), a * b - n)), y, lambda z, _: F.when(z < n, z).otherwise(spin(z)))
    return F.transform(F.array(spin(x)), lambda y: F.when(y < n, y).otherwise(walk(y)))[0]


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], limit: int, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their offset in their source's stream, sources with target, blocks and quota)."""
    text = F.col(text_col)
    kept = [text.alias("text")] if texts else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("h"), *kept)
    rows = materialize(rows, "sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / CHUNK_DOCS).alias("chunks"))
    stats = targets(stats, weights, limit).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * limit)).otherwise(0)
    stats = stats.withColumn("quota", quota.cast("long"))
    stats = materialize(stats.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "sources")

    # Offsets in the source's stream: sums inside chunks of some thousand documents, then sums of chunks.
    sized = rows.join(maybe_broadcast(stats), rows.source.eqNullSafe(stats.source)).drop(stats.source)
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("id", "h", F.lit(1)), F.col("chunks")))
    starts = sized.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("sid", "chunk", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "chunk").orderBy(F.xxhash64("id", "h", F.lit(2)), "id", "h").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("size").over(inside)).join(maybe_broadcast(starts), ["sid", "chunk"])
    placed = placed.select("sid", "id", "source", "size", "source_size", "target", (F.col("start") + F.col("end") - F.col("size")).alias("off"), *(["text"] if texts else []))
    return materialize(placed.withColumn("row", F.monotonically_increasing_id()), "placed"), stats


def _spread(placed: DataFrame, *more: str) -> DataFrame:
    """A row for each block that a document reaches into, with its first word there (from 0) and the number of them."""
    first, last = F.floor(F.col("off") / BLOCK), F.floor((F.col("off") + F.col("size") - 1) / BLOCK)
    df = placed.where("size > 0").select("row", "sid", "off", "size", *more, F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("off"))
    return df.withColumn("start", start).withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("off")) - start)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """A row per document: id, source, size, source_size, target and ``taken``, the words that the mix takes of it."""
    placed, stats = _placed(docs, id_col, text_col, source_col, weights, limit)
    uses = slots(stats).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    # Both sides grow with the data although they are spun from few rows, which the planner would take for small.
    taken = _spread(placed).join(uses.hint("merge"), ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = placed.join(taken.hint("merge"), "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself: a row per output slot, with ``shard``, ``source``, ``block``, ``n_words`` and the block's ``text``."""
    placed, stats = _placed(docs, id_col, text_col, source_col, weights, limit, texts=True)
    words = F.filter(F.split("text", WORD_GAP, -1), lambda w: w != "")
    part = F.slice(words, (F.col("start") + 1).cast("int"), F.col("words").cast("int"))
    pieces = _spread(placed, "text").select("sid", "block", F.struct("off", part.alias("w")).alias("p"))
    # A block has 64 words, so 64 documents at most.
    blocks = pieces.groupBy("sid", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"])).alias("w"))
    out = slots(stats).join(blocks.hint("merge"), ["sid", "block"]).join(maybe_broadcast(stats.select("sid", "source")), "sid")
    return out.select("shard", "source", "block", F.size("w").alias("n_words"), F.array_join("w", " ").alias("text"))


def draws(stats: DataFrame) -> tuple[DataFrame, int]:
    """((shard, sid, n): multinomial counts of each shard's sources, number of shards)."""
    share = stats.where("quota > 0").select("sid", "quota").orderBy("sid").collect()  # one row a source
    total = sum(r.quota for r in share)
    shards, upto, sums = -(-total // SHARD), 0, []
    for r in share:
        upto += r.quota
        sums.append(upto)
    spark, tasks = stats.sparkSession, int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A shard is drawn in one task, shards are dealt out.
    df = spark.range(0, shards, 1, max(1, min(shards, tasks))).withColumnRenamed("id", "shard")
    df = df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SHARD), F.lit(total) - F.col("shard") * SHARD) - 1)))
    at = F.floor(_unit(F.col("shard"), F.col("slot"), F.lit("source")) * total)
    before = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sums]) if sums else F.array().cast("array<bigint>"), lambda x: x <= at))
    sid = F.get(F.array(*[F.lit(r.sid) for r in share]) if share else F.array().cast("array<int>"), before)
    return df.groupBy("shard", sid.alias("sid")).agg(F.count("*").alias("n")), shards


def slots(stats: DataFrame) -> DataFrame:
    """(shard, sid, block): the output slots, each with the block that it takes."""
    counts, shards = draws(stats)
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Numbers of a source's slots run through the shards: sums inside groups of shards, then sums of groups.
    counts = materialize(counts.withColumn("group", F.floor(F.col("shard") / SHARD)), "draws")
    ahead = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("sid", "group").agg(F.sum("n").alias("n"))
    starts = starts.select("sid", "group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counts.withColumn("q0", F.sum("n").over(inside) - F.col("n")).join(starts.hint("merge"), ["sid", "group"])
    drawn = numbered.select("shard", "sid", (F.col("q0") + F.col("start")).alias("q0"), "n")
    had = counts.groupBy("sid").agg(F.sum("n").alias("had"))
    short = stats.join(maybe_broadcast(had), "sid", "left").select("sid", "quota", F.coalesce("had", F.lit(0)).alias("had")).where("quota > had")
    short = short.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("had") - 1) / SHARD))))
    short = short.select((F.col("k") + shards).alias("shard"), "sid", (F.col("had") + F.col("k") * SHARD).alias("q0"), F.least(F.lit(SHARD).cast("long"), F.col("quota") - F.col("had") - F.col("k") * SHARD).alias("n"))
    df = drawn.unionByName(short).join(maybe_broadcast(stats.select("sid", "blocks", "quota")), "sid")
    upper = F.least(F.col("q0") + F.col("n"), F.col("quota")) - 1
    # A shard's rows are dealt out before they are spun to its slots.
    df = df.where(upper >= F.col("q0")).repartition(tasks, "sid", "shard")
    df = df.select("shard", "sid", "blocks", F.explode(F.sequence(F.col("q0"), upper)).alias("q"))
    block = permuted(F.col("q") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.floor(F.col("q") / F.col("blocks")))
    return df.select("shard", "sid", block.alias("block"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them: taken/size times, the fraction rounded by a hash of the id."""
    times = mix(docs).where("size > 0").groupBy("doc_id", "size").agg(F.avg("taken").alias("taken"))
    n = F.floor(F.col("taken") / F.col("size") + _unit(F.col("doc_id"), F.lit("copies"))).cast("int")
    one, two, own, often, k = (fresh(docs, c) for c in ("_id", "_words", "_size", "_times", "_k"))
    times = times.select(F.col("doc_id").alias(one), F.col("size").alias(two), n.alias(often)).where(F.col(often) > 0)
    df = docs.withColumn(own, n_words(F.col("text")))
    out = df.join(times, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(own) == F.col(two))).drop(one, two, own)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(often)))).drop(k, often)


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
