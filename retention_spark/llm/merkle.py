"""Merkle manifest of a dataset: digests of documents folded into one root, labelled by intervals.

Every document is a leaf. Leaves of one language are ranked by doc_id and folded eight at a time
until one node is left, the language's subroot; subroots are ranked by language and folded the same way.
Nested-interval labels: each node carries the interval [low, high] of the leaf ranks it covers. A
node's ancestors are the nodes whose intervals contain its own; a join bucketed by level finds
them, the key being the ancestor's place on its level. Its siblings are what the parent's interval
holds beside its own. Paths are attached from the top down, so the long join has a row for every
eight documents, and no text is moved at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, if_small, save

FANOUT = 8
_STEP = "array<struct<left:string,right:string>>"


@dataclass
class Forest:
    """`levels[k]` has the nodes of level k + 1: tree, size (its leaves), low, high, digest, bucket
    and `children`, the nodes below in order as (low, high, digest, item). A tree of one leaf has
    one node, with the leaf's own digest."""

    levels: list[DataFrame]

    def subroots(self) -> DataFrame:
        """The last node of every tree: tree, digest."""
        tops = [self._ended(k) for k in range(len(self.levels))]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out.select("tree", "digest")

    def nodes(self) -> DataFrame:
        """All nodes above the leaves: tree, level, low, high, digest."""
        out = None
        for level, rows in enumerate(self.levels, 1):
            rows = rows.select("tree", F.lit(level).alias("level"), "low", "high", "digest")
            out = rows if out is None else out.unionByName(rows)
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """Leaves with their steps to the root: item, digest, path and the other columns of
        `tops`. `tops` (tree, path, ...) has the steps above each tree."""
        more = [c for c in tops.columns if c not in ("tree", "path")]
        above = None
        for k in reversed(range(len(self.levels))):
            rows = self._ended(k).join(tops, "tree")
            if above is not None:
                rows = rows.unionByName(self._attached(k, above, more))
            above = rows
        own = F.col("own")
        lone = F.col("size") == 1
        path = F.when(lone, F.col("path")).otherwise(
            F.concat(F.array(_step(own["low"], own["high"])), "path"))
        return above.select("size", "path", "children", F.explode("children").alias("own"), *more).select(
            own["item"].alias("item"), own["digest"].alias("digest"), path.alias("path"), *more)

    def _ended(self, k: int) -> DataFrame:
        """Nodes of level k + 1 that are the last of their trees."""
        return self.levels[k].filter(F.col("size") <= FANOUT ** (k + 1))

    def _attached(self, k: int, above: DataFrame, more: list[str]) -> DataFrame:
        """The other nodes of level k + 1 with the steps above them, from the containing node."""
        below = self.levels[k].filter(F.col("size") > FANOUT ** (k + 1)).withColumn(
            "up", F.call_function("div", F.col("low"), F.lit(FANOUT ** (k + 2))))
        over = above.select(
            F.col("tree").alias("over_tree"), F.col("bucket").alias("over_bucket"),
            F.col("low").alias("over_low"), F.col("high").alias("over_high"),
            F.col("children").alias("beside"), "path", *more)
        held = below.join(over, (F.col("tree") == F.col("over_tree"))
                          & (F.col("up") == F.col("over_bucket"))
                          & (F.col("over_low") <= F.col("low"))
                          & (F.col("high") <= F.col("over_high")))
        step = F.array(_step(F.col("low"), F.col("high"), "beside"))
        return held.select("tree", "size", "low", "high", "digest", "bucket", "children",
                           F.concat(step, "path").alias("path"), *more)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


def _step(low: Column, high: Column, among: str = "children") -> Column:
    """The siblings of [low, high]: what the parent's interval has before and after it."""
    return F.struct(
        _joined(F.filter(among, lambda node: node["high"] < low)).alias("left"),
        _joined(F.filter(among, lambda node: node["low"] > high)).alias("right"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Saved rows with `rank`, their place in their `tree` by `order`, and `size`, the tree's rows.

    Rows are dealt out by range, so a tree with most of all rows is spread over tasks; a row's
    rank is its place within its task and what earlier tasks hold of its tree. Rows that tie in
    `order` follow one another in any order.
    """
    placed = save(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                  .withColumn("at", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("tree", part).agg(
        F.min("at").alias("begin"), F.count(F.lit(1)).alias("held"))
    # A tree has at most one run for each task that sorted.
    earlier = Window.partitionBy("tree").orderBy("part")
    runs = save(runs.select(
        F.col("tree").alias("run_tree"), F.col("part").alias("run_part"), "begin",
        (F.sum("held").over(earlier) - F.col("held")).alias("before"),
        F.sum("held").over(Window.partitionBy("tree")).alias("size")), "merkle-runs")
    same = (F.col("tree") == F.col("run_tree")) & (F.shiftright("at", 33) == F.col("run_part"))
    return placed.join(if_small(runs), same).select(
        *rows.columns, (F.col("before") + F.col("at") - F.col("begin")).alias("rank"), "size")


def forest(leaves: DataFrame) -> Forest:
    """Fold leaves (tree, rank, size, digest, item) into one node per tree, level by level."""
    nodes = leaves.select("tree", "size", F.col("rank").alias("low"), F.col("rank").alias("high"),
                          "digest", "item")
    kind = nodes.schema["item"].dataType
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    while not levels or FANOUT ** len(levels) < largest:
        span = FANOUT ** (len(levels) + 1)
        place = F.call_function("div", F.col("low"), F.lit(span)).alias("bucket")
        grouped = nodes.groupBy("tree", "size", place).agg(F.sort_array(F.collect_list(
            F.struct("low", "high", "digest", "item"))).alias("children"))
        folded = F.sha2(_joined(F.col("children")), 256)
        level = save(grouped.select(
            "tree", "size", F.col("children")[0]["low"].alias("low"),
            F.element_at("children", -1)["high"].alias("high"),
            F.when(F.col("size") == 1, F.col("children")[0]["digest"]).otherwise(folded)
            .alias("digest"), "bucket", "children"), "merkle-level")
        levels.append(level)
        nodes = level.filter(F.col("size") > span).select(
            "tree", "size", "low", "high", "digest", F.lit(None).cast(kind).alias("item"))
    return Forest(levels)


def _field(column: str, text: Column | None = None) -> Column:
    value = F.col(column).cast("string") if text is None else text
    sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.when(value.isNull(), "-").otherwise(sized)


def leaf_digest(text: Column | None = None) -> Column:
    """H of doc_id, source, lang, n_chars and text, each with its length, so that no two rows
    share an encoding; null is `-`. `text` stands in for the row's own."""
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field("text", text)), 256)


def tree_of(lang: Column) -> Column:
    """A name for the language's tree that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def manifest(docs: DataFrame, item: Column | None = None) -> tuple[Forest, Forest, str | None]:
    """The languages' forest, the one tree over their subroots, and the root (null if empty).

    The item is carried to the leaves of `Forest.paths`; by default it is the doc_id.
    """
    item = F.col("doc_id").cast("bigint") if item is None else item
    # Texts are hashed once, before rows are ranked.
    hashed = save(docs.select(
        tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest().alias("digest"), item.alias("item")), "merkle-leaves")
    below = forest(ranked(hashed, ["doc_id", "digest"]))
    heads = below.subroots().select(F.lit("").alias("tree"), F.col("tree").alias("item"), "digest")
    top = forest(ranked(heads, ["item"]))
    root = top.subroots().first()
    return below, top, root and root.digest


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda held, step: F.sha2(
        F.concat(step["left"], held, step["right"]), 256))


def proofs(below: Forest, top: Forest, root: str | None) -> DataFrame:
    """One row per leaf: item, digest, subroot, root and path, the siblings level by level as
    (left, right), via the subroot to the root."""
    start = top.subroots().select("tree", F.array().cast(_STEP).alias("path"))
    tops = top.paths(start).select(F.col("item").alias("tree"), "path",
                                   F.col("digest").alias("subroot"))
    return below.paths(tops).withColumn("root", F.lit(root).cast("string"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose crc32(doc_id) is divisible by 3 are read back with the A-Z of their text in lower
    case; the root is recomputed from what was read and the stored siblings, so `verified` is
    false where the text had such a letter. Null fields count as `-` and differ from empty ones; a null doc_id
    sorts first in its language and is never tampered with. Rows that repeat a doc_id are
    ordered by their digest, and equal rows are leaves each. An empty table gives no rows; columns
    other than doc_id, source, lang, n_chars and text are not looked at. Texts of any length
    are hashed whole.
    """
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    # A null text stays null: ascii_lower would make it empty.
    lower = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    changed = touched & (lower != F.col("text"))
    read = F.when(changed, leaf_digest(lower))
    item = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), read.alias("read"))
    below, top, root = manifest(docs, item)
    found = proofs(below, top, root)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    again = folded(F.coalesce("item.read", "digest"), F.col("path"))
    return found.select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_trees(leaves: str, levels: str) -> str:
    """Recursive tables: nodes of each level, and families, the children of each parent."""
    return f"""
{levels} as (
  select tree, size, 0 as level, rank as place, digest, size as held from {leaves}
  union all
  select tree, size, level + 1, place // 8, sha256(string_agg(digest, '' order by place)),
         (held + 7) // 8
  from {levels} where held > 1 group by tree, size, level, held, place // 8),
{levels}_families as (
  select tree, level, place // 8 as parent, list(digest order by place) as digests
  from {levels} where held > 1 group by tree, level, place // 8)"""


#: crc32 byte by byte, bit by bit; 3988292384 and 4294967295 are its fixed values.
ORACLE_SQL = f"""
with recursive fields as (
  select doc_id, lang, text,
    case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                         'abcdefghijklmnopqrstuvwxyz') else text end as read,
    {{head}} as head
  from (select *, xor(list_reduce(
      list_transform(range(0, strlen(doc_id::varchar)),
                     lambda i: ascii(substr(doc_id::varchar, i + 1, 1))),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)),
                               xor(c, b)), 4294967295), 4294967295) as crc
    from documents)),
leaves as (
  select doc_id, coalesce('=' || lang, '') as tree, digest, again,
    row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as rank,
    count(*) over (partition by lang) as size
  from (select *, sha256(head || {{text}}) as digest, sha256(head || {{read}}) as again
        from fields)),
{_sql_trees('leaves', 'low')},
heads as (
  select tree as item, '' as tree, digest, row_number() over (order by tree) - 1 as rank,
         count(*) over () as size
  from low where held = 1),
{_sql_trees('heads', 'top')},
walk as (
  select l.doc_id, l.tree, l.digest as leaf, 0 as part, 0 as level, l.rank as place, l.again as held,
         '' as proof from leaves l
  union all
  select w.doc_id, w.tree, w.leaf, w.part, w.level + 1, w.place // 8,
    sha256(array_to_string(f.digests[1:w.place % 8], '') || w.held
           || array_to_string(f.digests[w.place % 8 + 2:], '')),
    w.proof || array_to_string(f.digests[1:w.place % 8], '')
            || array_to_string(f.digests[w.place % 8 + 2:], '')
  from walk w join low_families f
    on w.tree = f.tree and w.level = f.level and w.place // 8 = f.parent),
reached as (
  select w.*, n.digest as subroot, h.rank from walk w
  join low n on w.tree = n.tree and w.level = n.level and n.held = 1 join heads h on h.item = w.tree),
climb as (
  select doc_id, leaf, subroot, 0 as level, rank as place, held, proof from reached
  union all
  select c.doc_id, c.leaf, c.subroot, c.level + 1, c.place // 8,
    sha256(array_to_string(f.digests[1:c.place % 8], '') || c.held
           || array_to_string(f.digests[c.place % 8 + 2:], '')),
    c.proof || array_to_string(f.digests[1:c.place % 8], '')
            || array_to_string(f.digests[c.place % 8 + 2:], '')
  from climb c join top_families f on c.level = f.level and c.place // 8 = f.parent)
select c.doc_id, c.leaf, c.subroot, n.digest as root, sha256(c.proof) as proof_sha256,
       c.held as folded_root, c.held = n.digest as verified
from climb c join top n on c.level = n.level and n.held = 1""".format(
    head=" || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
                     for c in ("doc_id", "source", "lang", "n_chars")),
    text="coalesce(strlen(text) || ':' || text, '-')",
    read="coalesce(strlen(read) || ':' || read, '-')")
