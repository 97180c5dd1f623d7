"""Sharding by balanced label propagation over links between equal texts; DataFrame functions only.

Law ``rows``: shard sizes differ by one row at most.  The graph links documents with equal texts.
Documents of a text are pre-aggregated into at most ``salts`` units (text, salt), so no text, not
even one that holds a third of all rows, is ever one unit.  Each unit starts on a hashed shard;
then, for some rounds, every unit asks for the shard where most of its neighbours are (a text too
large for one shard spreads over its most popular ones), and shards grant requests while their
quota lasts.  Rows without links fill what is left.  At last each shard numbers its rows, linked
ones first; rows beyond the exact quota move to the gaps of other shards, which cuts links only
where linked rows alone overfill a shard.

Requests are granted by hash buckets: ``shards`` x ``buckets`` sums decide, so no shard's requests
are sorted in one task; ranks are counted per (shard, bucket) in the same way.

Defined results: null text counts as empty (size 16, linked with empty texts); repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dfprofile.llm.common import cut, drop_stash, load, stash, text_bytes


def _before(partition: str | list[str] | None, *order: str):
    w = Window.partitionBy(partition) if partition else Window.partitionBy()
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def propagate(units: DataFrame, quota: float, shards: int, rounds: int, buckets: int,
              fill: float = 0.8) -> DataFrame:
    """Move ``units`` (digest, salt, n, shard), those with links, towards their neighbours."""
    text = Window.partitionBy("digest")
    for _ in range(rounds):
        by_shard = units.groupBy("digest", "shard").agg(F.sum("n").alias("here"))
        liked = by_shard.withColumn("place", F.row_number().over(
            text.orderBy(F.desc("here"), F.xxhash64("digest", "shard"))) - 1)
        # the k-th share of a text, in the order of its shards, asks for its k-th popular shard
        state = (units.join(liked, ["digest", "shard"])
                 .withColumn("cum", F.coalesce(F.sum("n").over(
                     text.orderBy("place", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .withColumn("want", F.floor(F.col("cum") / F.lit(max(1.0, fill * quota))).cast("int")))
        wish = liked.select("digest", F.col("place").alias("want"), F.col("shard").alias("to"))
        state = (state.join(wish, ["digest", "want"], "left")
                 .withColumn("to", F.coalesce("to", "shard"))
                 .withColumn("bucket", F.pmod(F.xxhash64("digest", "salt"), F.lit(buckets))))
        state = cut(state.select("digest", "salt", "n", "shard", "to", "bucket"))
        # room of a shard: its quota less the linked rows that stay
        stay = state.where("shard = to").groupBy(F.col("to")).agg(F.sum("n").alias("held"))
        asks = state.where("shard <> to").groupBy("to", "bucket").agg(F.sum("n").alias("asked"))
        granted = (asks.join(stay, "to", "left")
                   .withColumn("sum", F.sum("asked").over(
                       Window.partitionBy("to").orderBy("bucket")))
                   .where(F.col("sum") + F.coalesce("held", F.lit(0)) <= quota)
                   .select("to", "bucket", F.lit(True).alias("ok")))
        units = state.join(granted, ["to", "bucket"], "left").select(
            "digest", "salt", "n", F.when(F.col("ok"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
    return cut(units)


def shard(docs: DataFrame, shards: int = 40, salts: int = 64, rounds: int = 3,
          buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group (digest of the text)."""
    bytes_ = text_bytes()
    base = stash(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(bytes_).cast("long") + 16).alias("size"),
        F.crc32(bytes_).alias("text_crc32"), F.unhex(F.md5(bytes_)).alias("digest"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(salts)).cast("int")), "shard")
    units = base.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"))
    linked = units.groupBy("digest").agg(F.sum("n").alias("of")).where("of > 1").select("digest")
    n = base.count()
    quota = n / shards
    units = cut(units.join(linked, "digest").withColumn(
        "shard", F.pmod(F.xxhash64("digest", "salt", F.lit(1)), F.lit(shards)).cast("int")))
    units = propagate(units, quota, shards, rounds, buckets)

    own = F.pmod(F.xxhash64("doc_id", "digest", F.lit(2)), F.lit(shards)).cast("int")
    rows = base.join(units.select("digest", "salt", F.col("shard").alias("to")), ["digest", "salt"], "left")
    rows = cut(rows.select(
        "doc_id", "size", "text_crc32", "digest", F.coalesce("to", own).alias("at"),
        # linked rows take the first buckets, a text's rows one bucket
        F.when(F.col("to").isNotNull(), F.pmod(F.xxhash64("digest", "salt"), F.lit(buckets)))
        .otherwise(buckets + F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).alias("bucket")))
    drop_stash(base)
    counts = rows.groupBy("at", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("at", "bucket", F.coalesce(F.sum("n").over(_before("at", "bucket")), F.lit(0)).alias("first"))
    inside = Window.partitionBy("at", "bucket").orderBy(
        "digest", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(F.broadcast(firsts), ["at", "bucket"])
    # one row a shard: exact quota, rows beyond it, gaps below it
    spark = docs.sparkSession
    held = {r["at"]: r["n"] for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    moves, gaps, over, under = [], [], 0, 0
    for s in range(shards):
        want = n // shards + (s < n % shards)
        have = held.get(s, 0)
        moves.append((s, want, over))
        over += max(0, have - want)
        if have < want:
            gaps.append((s, have, under, under + want - have))
            under += want - have
    moves = spark.createDataFrame(moves, "at int, want long, over long")
    gaps = spark.createDataFrame(gaps or [(0, 0, 0, 0)], "gap int, have long, lo long, hi long")
    placed = (ranked.join(F.broadcast(moves), "at")
              .withColumn("pos", F.col("r") + F.col("first"))
              .withColumn("moved", F.when(F.col("pos") >= F.col("want"), F.col("over") + F.col("pos") - F.col("want"))))
    placed = placed.join(F.broadcast(gaps), (F.col("moved") >= F.col("lo")) & (F.col("moved") < F.col("hi")), "left")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.coalesce("gap", "at").alias("shard"),
        F.coalesce(F.col("have") + F.col("moved") - F.col("lo"), F.col("pos")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.hex("digest").alias("group"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))
