"""Exact deduplication through an extendible-hash index on shared files. DataFrame functions only.

1. Every text is hashed to 64 bits; rows of equal hash are counted before anything is shuffled.
2. The directory starts at the depth that the number of keys calls for. While a bucket holds more than
   `capacity` keys, the directory doubles and only overfull buckets split. It has 2**max_depth slots at most;
   buckets that are full then grow, and the tasks that own them spill.
3. Owner tasks hold ranges of buckets and write their keys as files in the shared folder: the index. Whoever
   looks a text up takes the first bits of its hash to the directory, which names the bucket, and then reads
   the bucket's entry for the hash.
4. Texts that look up an entry of several rows are candidates. Each slice of the reading tasks sends one copy of a
   text to the owner of its bucket. The owner compares bytes, so the copies of all slices meet, and chains the
   different texts of one hash: a collision never merges two texts.

Only the texts of candidates travel, and a text that a third of all rows share reaches its owner SLICES times at most.

Defined results: a null text counts as empty, and empty texts are equal to each other; texts of any length are compared
whole. Null ids are smaller than all others. Rows that repeat both id and text are rows of the group; each that carries
the largest id is kept. Columns other than doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Keys of one bucket before it splits.
CAPACITY = 50_000
#: The directory has 2**MAX_DEPTH slots at most, 24 bytes each, so 24 MB: it is broadcast.
MAX_DEPTH = 20
#: Copies of one text that its owner gets at most.
SLICES = 64
#: Candidate keys that are broadcast at most: 16 bytes each, so 32 MB. More are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def text_hash(hash_bits: int = 64) -> Column:
    """The key of a text; fewer bits than 64 are for tests of collisions."""
    h = F.xxhash64("text")
    return h if hash_bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for each directory slot in use, and the global depth; keys: column `h`.

    A slot is the first `max_depth` bits of the hash; a bucket is named by its first slot.
    """
    slots = stored(keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).agg(F.count("*").alias("load")), "slots")
    total = slots.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    depth = 0
    while depth < max_depth and (capacity << depth) < total:
        depth += 1

    def bucket(d: int) -> Column:
        return F.shiftleft(F.shiftright("slot", max_depth - d), max_depth - d)

    state = slots.select("slot", "load", bucket(depth).alias("bucket"), F.lit(depth).alias("local_depth"))
    while depth < max_depth:
        full = state.groupBy("bucket", "local_depth").agg(F.sum("load").alias("held")).where(F.col("held") > capacity)
        if full.isEmpty():
            break
        depth += 1  # the directory doubles; buckets that are not overfull keep their local depth
        marked = state.join(F.broadcast(full.select("bucket", "local_depth", F.lit(True).alias("split"))), ["bucket", "local_depth"], "left")
        state = stored(
            marked.select(
                "slot",
                "load",
                F.when(F.col("split"), bucket(depth)).otherwise(F.col("bucket")).alias("bucket"),
                F.when(F.col("split"), F.lit(depth)).otherwise(F.col("local_depth")).alias("local_depth"),
            ),
            "directory",
        )
    return state.select("slot", "bucket", "local_depth"), depth


def lookup_table(slots: DataFrame, depth: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The directory at its global depth, written: slot (the first `depth` bits of a hash) and its bucket."""
    return stored(slots.select(F.shiftright("slot", max_depth - depth).alias("slot"), "bucket").distinct(), "lookup")


def looked_up(rows: DataFrame, lookup: DataFrame, depth: int) -> DataFrame:
    """rows (h, ...) with the bucket that the directory names for h."""
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    return rows.withColumn("slot", slot).join(F.broadcast(lookup), "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The index, written (bucket, h, rows: one entry for each hash), the directory and its depth.

    docs: text (no nulls).
    """
    keys = stored(docs.select(text_hash(hash_bits).alias("h")).groupBy("h").agg(F.count("*").alias("rows")), "keys")
    slots, depth = directory(keys, capacity, max_depth)
    lookup = lookup_table(slots, depth, max_depth)
    owned = looked_up(keys, lookup, depth).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h")
    return stored(owned.select("bucket", "h", "rows"), "index"), lookup, depth


def chains(candidates: DataFrame) -> DataFrame:
    """bucket, h, links, sha, n, size, keep: each different text of the candidates (bucket, h, text, doc_id), in its bucket's chain.

    One task owns all of a bucket; what it gets is one row a slice and text.
    """
    sliced = candidates.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    sent = sliced.groupBy("slice", "bucket", "h", "text").agg(F.count("*").alias("size"), F.max("doc_id").alias("keep"))
    owned = sent.select("bucket", "h", "text", "size", "keep").repartitionByRange("bucket")
    # The range of buckets satisfies both groupings: bytes are compared and chained where the bucket is owned.
    told = owned.groupBy("bucket", "h", "text").agg(F.sum("size").alias("size"), F.max("keep").alias("keep"))
    rows = told.select("bucket", "h", F.sha2("text", 256).alias("sha"), F.length(F.encode("text", "UTF-8")).alias("n"), "size", "keep")
    return rows.withColumn("links", F.count("*").over(Window.partitionBy("bucket", "h")))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every row of docs (doc_id, text).

    Of equal texts the row with the largest doc_id stays.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    index, lookup, depth = build_index(docs, capacity, max_depth, hash_bits)
    shared = index.where("rows > 1").select("bucket", "h")
    small = shared.limit(broadcast_keys + 1).count() <= broadcast_keys
    near = F.broadcast if small else (lambda df: df)

    keyed = looked_up(docs.withColumn("h", text_hash(hash_bits)), lookup, depth)
    links = stored(chains(keyed.join(near(shared), ["bucket", "h"], "left_semi")), "chains")
    heads = links.where("links = 1").select("bucket", "h", F.struct("size", "keep").alias("head"))

    rows = keyed.select("doc_id", "bucket", "h", F.sha2("text", 256).alias("sha"), F.length(F.encode("text", "UTF-8")).alias("n"))
    found = rows.join(near(heads), ["bucket", "h"], "left")
    if not links.where("links > 1").isEmpty():
        # Collided hashes: each text of the chain is found by its digest and length, which told the
        # compared texts apart, or the two would be one text for any reader.
        more = links.where("links > 1").select("bucket", "h", "sha", "n", F.struct("size", "keep").alias("link"))
        few = more.limit(broadcast_keys // 4 + 1).count() <= broadcast_keys // 4  # digests make these rows wider
        found = found.join(F.broadcast(more) if few else more, ["bucket", "h", "sha", "n"], "left").withColumn("head", F.coalesce("link", "head"))
    size = F.coalesce(F.col("head.size"), F.lit(1).cast("long"))
    keep = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.keep"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("n").cast("long").alias("n_bytes"),
    )
