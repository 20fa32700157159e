"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow with a weight. Its documents, in shuffled order and as often as they may
repeat, queue one after the other; a document's virtual finish time is its source's words so far, its own
included, divided by the weight. One order by finish time over all sources, cut where the words
reach the budget, gives each source its weight's share; a source that runs out leaves its
share to the others, so the targets are the shares filled up level by level.

Running sums never run over a whole source or the whole table: rows fall into even buckets of the
shuffle key, then of the finish time; sums of buckets are added up first, and rows only within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, save
from .words import PATTERN

#: Documents of each source fall into 16 to this power buckets of their shuffle key.
KEY_DIGITS = 3
TIME_BUCKETS = 4096
#: Sources in the order of their names weigh 1, 2, 3, and so on in turn.
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   repeats: int = MOST_REPEATS) -> DataFrame:
    """`sizes` (source, source_size, largest) with weight, budget, target and `end`.

    Sources are put in order by code point, null last. A target stops at `repeats` times its
    source's size; the excess goes to the other sources by weight. With sources ordered by the
    level (limit over weight) at which they are full, the level that remains open after the
    first k is (budget - their limits) / (weight of the rest), and the first source that it does
    not fill fixes it. No row of the mix finishes after `end`. One row a source, whatever the
    corpus holds, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                          (turn + 1).cast("int"))
    limit = F.col("source_size") * repeats
    full_at = F.col("source_size") / F.col("weight")
    before = Window.orderBy(full_at, F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = (
        sizes.withColumn("weight", weight)
        .withColumn("budget", F.sum("source_size").over(every))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(every)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    open_here = limit * F.col("shares") > F.col("weight") * F.col("left")
    level = F.min(F.when(open_here, F.struct(full_at.alias("full_at"), "left", "shares")))
    found = rest.withColumn("level", level.over(every))
    share = F.col("weight") * F.col("level.left") / F.col("level.shares")
    whole = limit.cast("double")
    target = F.when(whole <= share, whole).otherwise(F.coalesce(share, whole))
    end = (F.max(F.col("target") / F.col("weight")).over(every)
           + F.max(F.col("largest") / F.col("weight")).over(every))
    return found.withColumn("target", target).withColumn("end", end).select(
        "source", "source_size", "weight", "budget", "target", "end")


IDENTITY = ("doc_id", "source", "size", "row_key")


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's text and of all its other columns but maps, and of which are null: rows that
    differ anywhere are told apart, and equal ones stand for each other."""
    others = [c for c, kind in docs.dtypes if c != "text" and "map<" not in kind]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in ["text", *others]])
    return F.xxhash64("text", nulls, *[F.col(f"`{c}`") for c in others])


def queued(docs: DataFrame, seed: str = "0", weights: tuple[int, ...] = WEIGHTS,
           repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per document: its identity, its source's figures, and `passed`, the words of its
    source up to and with it in shuffled order. `part` numbers rows that are equal."""
    sized = docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"),
                        row_key(docs).alias("row_key"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    rows = save(sized.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("copies"))
                .select(*IDENTITY, key.alias("key"), part.alias("part")), "mix-sizes")
    bucket = F.substring("key", 1, KEY_DIGITS)
    sums = save(rows.groupBy("source", bucket.alias("bucket")).agg(
        F.sum("size").alias("words"), F.max("size").alias("largest")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.max("largest").alias("largest")), weights, repeats)
    starts = sums.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
         - F.col("words")).alias("skipped"))
    placed = starts.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row_key", "part")
    running = rows.withColumn("bucket", bucket).withColumn("inside", F.sum("size").over(within))
    return save(running.join(
        placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    ).select(*IDENTITY, "part", "key", "source_size", "weight", "budget", "target", "end",
             (F.col("skipped") + F.col("inside")).alias("passed")), "mix-queue")


def cut(queue: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """The mix as rows of the queue, one for each time a document is taken: its identity and
    part, `repeat` from 0, its virtual `finish` time, and `words_before` it in the mix."""
    last = F.when(F.col("size") > 0, F.lit(repeats - 1)).otherwise(0).cast("bigint")
    items = queue.withColumn(
        "repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    ).withColumn(
        "finish", (F.col("repeat") * F.col("source_size") + F.col("passed")) / F.col("weight"))
    slot = F.when(F.col("end") > 0, F.floor(F.col("finish") / F.col("end") * TIME_BUCKETS))
    timed = items.filter(F.col("finish") <= F.col("end")).withColumn(
        "slot", F.coalesce(slot, F.lit(0)))
    starts = timed.groupBy("slot").agg(F.sum("size").alias("words")).select(
        F.col("slot").alias("at"),
        (F.sum("words").over(Window.orderBy("slot")) - F.col("words")).alias("skipped"))
    order = Window.partitionBy("slot").orderBy(
        "finish", "key", F.col("source").asc_nulls_last(), "doc_id", "row_key", "part", "repeat")
    upto = F.col("skipped") + F.sum("size").over(order)
    # At most TIME_BUCKETS + 1 rows are broadcast.
    return (
        timed.join(F.broadcast(starts), F.col("slot") == F.col("at"))
        .withColumn("upto", upto).filter(F.col("upto") <= F.col("budget"))
        .select(*IDENTITY, "part", "repeat", "finish",
                (F.col("upto") - F.col("size")).alias("words_before"))
    )


def mix(docs: DataFrame, seed: str = "0", weights: tuple[int, ...] = WEIGHTS,
        repeats: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents: a row for each time a document is taken, with all columns of `docs`,
    `mix_repeat` from 0, `mix_finish` (virtual finish time) and `mix_words_before`; sort by
    `mix_words_before`, `mix_finish`, `doc_id` for the order of the mix.

    It is cut before the first row that would take the words over those of all documents. Null
    text has no words; a document without words is taken once if it stands before the cut. Null
    sources are one source, sorted last. Equal rows are mixed like different documents, and so are rows
    that share doc_id, source and text but differ elsewhere. An empty table gives no rows. Columns beyond doc_id, source and text are carried along, but for
    any that have the added names. What is taken depends on the seed and the rows, never on their order.
    """
    items = cut(queued(docs, seed, weights, repeats), repeats)
    took = items.toDF(*[f"mix_{c}" for c in items.columns])
    name = fresh(docs, "mix_row_key")
    one = docs.withColumn(name, row_key(docs)).dropDuplicates(["doc_id", "source", name])
    same = (one.doc_id.eqNullSafe(took.mix_doc_id) & one.source.eqNullSafe(took.mix_source)
            & (one[name] == took.mix_row_key))
    added = ["mix_repeat", "mix_finish", "mix_words_before"]
    return one.join(took, same).select(
        *[one[c] for c in docs.columns if c not in added], *[took[c] for c in added])


def taken_words(docs: DataFrame, seed: str = "0", weights: tuple[int, ...] = WEIGHTS,
                repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and `taken`, the words of it that
    the mix takes, repeats counted (0 if it is left out). Cases as for `mix`."""
    queue = queued(docs, seed, weights, repeats)
    parts = [*IDENTITY, "part"]
    took = cut(queue, repeats).groupBy(*parts).agg(F.sum("size").alias("taken")).toDF(
        *[f"took_{c}" for c in parts], "taken")
    same = [F.col(c).eqNullSafe(F.col(f"took_{c}")) for c in parts]
    return queue.join(took, same, "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


ORACLE_SQL = """
with sized as (
  select doc_id, source, text, md5('0:' || coalesce(cast(doc_id as varchar), '')) as key,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sized group by source),
rest as (
  select *, cast(sum(source_size) over () as bigint) as budget,
    cast(sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0) as bigint) as remains,
    cast(sum(weight) over () - coalesce(sum(weight) over w, 0) as bigint) as shares
  from sources window w as (order by source_size / weight, source nulls last
                            rows between unbounded preceding and 1 preceding)),
level as (
  select remains, shares from rest where 3 * source_size * shares > weight * remains
  order by source_size / weight, remains limit 1),
targets as (
  select r.source, source_size, weight, budget,
    least(cast(3 * source_size as double),
          coalesce(weight * l.remains / l.shares, cast(3 * source_size as double))) as target
  from rest r left join level l on true),
queue as (
  select d.*, source_size, weight, budget, target,
    sum(size) over (partition by d.source order by key, d.doc_id, text
                    rows unbounded preceding) as passed
  from sized d join targets t on d.source is not distinct from t.source),
items as (
  select *, cast(turn * source_size + passed as bigint) / weight as finish
  from queue, (select unnest([0, 1, 2]) as turn) where turn = 0 or size > 0),
run as (
  select *, sum(size) over (order by finish, key, source nulls last, doc_id, text, turn
                            rows unbounded preceding) as upto
  from items)
select doc_id, size, source_size, target,
  cast(sum(case when upto <= budget then size else 0 end) as bigint) as taken
from run group by doc_id, source, text, size, source_size, target, passed"""
