"""Exact deduplication by an extendible-hash index on shared files.

The directory has an entry for each bucket: the first bits that the hashes in it have in common, and how many
these are, its depth. It is built round by round: a bucket over capacity is split by its next bit, so buckets
differ in depth. `locate` finds a hash's bucket through the directory, by the bucket's own depth. Every hash
is filed in its bucket; the files lie in the shared folder, each with the buckets of one owner's key range.

Hashes that several rows have are read from these files, with their buckets, and only texts of such hashes are moved.
Equal texts are combined where they are read, so a group of copies reaches its owner as a row for each task that read
some, however many copies there are. The grouping key is the text itself, so bytes are compared, not hashes;
the owner of a bucket's range then chains the different texts of one hash in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, discard, fresh, if_small, save

CAPACITY = 4096


@dataclass
class Index:
    """`directory` (bucket, depth): the buckets by their first key bits; `keys` (bucket, depth, hash, records,
    top): every hash in the files of its bucket; `chains` (bucket, hash, chain, text, top, size): each
    different text of a hash that several rows have."""

    directory: DataFrame
    keys: DataFrame
    chains: DataFrame


def _prefix(depth: int | Column, of: str = "hash") -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    # The first `depth` bits of the key, the rest 0.
    mask = F.when(depth == 0, F.lit(0)).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - depth).cast("int")))
    return F.col(of).bitwiseAND(mask.cast("bigint"))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The buckets (bucket, depth) over distinct hashes, split until none holds more than
    `capacity` or else a single hash; `bucket` is the first `depth` bits, the rest 0. Every split bucket holds more
    than `capacity` keys, so the directory has at most a few rows per `capacity` keys."""
    total = keys.count()
    depth = max(0, (total // capacity).bit_length())
    pending, done = keys.select("hash"), None
    while True:
        counted = save(pending.groupBy(_prefix(depth).alias("bucket")).agg(
            F.count(F.lit(1)).alias("held"),
            (F.min("hash") < F.max("hash")).alias("splits")), "exact-directory")
        splits = (F.col("held") > capacity) & F.col("splits")
        fits = counted.filter(~splits).select("bucket", F.lit(depth).alias("depth"))
        done = fits if done is None else done.unionByName(fits)
        over = counted.filter(splits).select("bucket")
        left = over.count()
        if not left:
            return save(done, "exact-directory")
        # Only keys of overfull buckets are looked at again, a bit deeper.
        pending = pending.join(if_small(over, left), _prefix(depth) == F.col("bucket"),
                               "left_semi")
        depth += 1


def locate(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """`keys` (hash, ...) with `bucket` and `depth`, looked up in the directory `buckets`.

    A hash is first taken to the entries that begin with as many bits as the shallowest bucket has, few as
    each is a bucket or stems from one that was split; among these the one bucket whose own depth's bits are the
    hash's is found. Every hash has exactly one, as buckets share out all hashes that they were built over; a
    hash whose bits no bucket has is left out. An empty directory finds nothing."""
    least, entries = buckets.agg(F.coalesce(F.min("depth"), F.lit(0)), F.count(F.lit(1))).first()
    entry = buckets.withColumn("_root", _prefix(least, "bucket"))
    return keys.join(if_small(entry, entries, 24), (_prefix(least) == F.col("_root"))
                     & (_prefix(F.col("depth")) == F.col("bucket"))).drop("_root")


def hashed(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, the normalised text, its hash (the first `hash_bits` of it) and its length."""
    text = ascii_lower(F.col("text"))
    key = F.xxhash64("text")
    if hash_bits < 64:
        key = F.call_function("shiftleft", F.call_function("shiftright", key,
                                                           F.lit(64 - hash_bits)),
                              F.lit(64 - hash_bits))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn(
        "hash", key)


def build_index(docs: DataFrame, records: DataFrame, capacity: int = CAPACITY,
                hash_bits: int = 64) -> Index:
    """Index the texts of `docs`; `records` are its saved (doc_id, hash, text_sha256)."""
    keys = save(records.groupBy("hash").agg(
        F.count(F.lit(1)).alias("records"), F.max("doc_id").alias("top")), "exact-keys")
    buckets = directory(keys, capacity)
    # Range partitioning gives each owner whole buckets, in order of their key ranges.
    filed = save(locate(keys, buckets).repartitionByRange("bucket").sortWithinPartitions(
        "bucket", "hash"), "exact-buckets")
    discard(keys)
    shared = save(filed.filter("records > 1").select("hash", "bucket"), "exact-shared")
    texts = hashed(docs, hash_bits).join(if_small(shared), "hash")
    # The group's key is the text: its bytes are compared, first where rows are read.
    combined = texts.groupBy("bucket", "hash", "text").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size"))
    owned = combined.repartitionByRange("bucket", "hash")
    link = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("text")) - 1
    chains = owned.select("bucket", "hash", link.alias("chain"), "text", "top", "size")
    return Index(buckets, filed, save(chains, "exact-chains"))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
    texts the row with the largest doc_id stays, and of rows that repeat that doc_id, one. Null
    doc_ids count as smallest; in a group of nothing else one row stays, with keep_id null. An
    empty table gives no rows; other columns of `docs` are not looked at.
    """
    records = save(hashed(docs, hash_bits).select(
        "doc_id", "hash", F.sha2("text", 256).alias("text_sha256")), "exact-records")
    index = build_index(docs, records, capacity, hash_bits)
    # Rows of one doc_id with one text are told apart by number.
    once = records.groupBy("doc_id", "hash", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    links = index.chains.select("hash", F.sha2("text", 256).alias("link_sha256"),
                                F.col("top").alias("keep_id"), F.col("size").alias("group_size"))
    # The hash of a text that occurs once has no chain. In a chain the digest finds the link
    # whose bytes were compared.
    found = once.join(links, (once["hash"] == links["hash"])
                      & (once.text_sha256 == links.link_sha256), "left")
    alone = F.col("group_size").isNull()
    turn = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    rows = found.select(
        once.doc_id, F.when(alone, once.doc_id).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        "text_sha256", turn.alias("turn"))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        "text_sha256")


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns. Of rows that repeat doc_id and text one
    is kept, whatever their other columns hold."""
    groups = exact_groups(docs, capacity)
    stay = groups.filter("kept").select(
        F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha256"))
    name = fresh(docs, "dedup_sha256")
    keyed = docs.withColumn(name, F.sha2(ascii_lower(F.col("text")), 256))
    same = keyed.doc_id.eqNullSafe(stay.stay_id) & (keyed[name] == stay.stay_sha256)
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)


ORACLE_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size,
  doc_id is not distinct from keep_id and row_number() over (partition by t.norm, doc_id) = 1 as kept,
  sha256(t.norm) as text_sha256
from t join g using (norm)"""
