"""Quality rules whose thresholds come from quantile sketches per language and source.

Every document is measured on its whole text, without moving it. The measures of a language and
source are summarised in a sketch: counts of logarithmic buckets, `2**BITS` to each power of two.
A value below `2**BITS` is a bucket of its own; above, a bucket's ends differ by less than one part in
`2**BITS`, so a quantile is off by less than that. Bucket counts add up, so sketches of parts of
the data merge into the sketch of all, whatever the order, and reruns agree.

A rule's threshold lies outside the middle half of its group: so many quartile ranges, at least
the rule's own `slack`, beyond the upper or below the lower quartile. Thresholds are joined back to the
documents. A group with few documents takes the thresholds of its language, one without those of all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import if_small, save

BITS = 7
WINDOW = 5
GAPS = r"[\x20\x09-\x0D]+"
LETTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: How many quartile ranges beyond a quartile a document may lie.
FENCES = 6
#: Documents a group needs for thresholds of its own.
MIN_DOCS = 50


@dataclass(frozen=True)
class Rule:
    """A measure, the side on which it is bad and the least quartile range it is given. Measures
    are whole numbers; shares are in ten-thousandths."""

    name: str
    upper: bool
    slack: int


RULES = (
    Rule("word_length", True, 80),  # hundredths of a character
    Rule("word_length", False, 40),
    Rule("symbol_share", True, 150),
    Rule("dup_line_share", True, 600),
    Rule("repeat_share", True, 400),
)
KEYS = ("lang_key", "source_key")
MEASURES = tuple(dict.fromkeys(rule.name for rule in RULES))
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# Measures

def _let(value: Column, use) -> Column:
    """`use(value)`, the value computed once for a row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order: maximal runs of other than space and 0x09-0x0D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five that the text has twice or more.

    Windows are told apart by two 64-bit hashes with different beginnings. Only a text in which a hash
    repeats has its windows sorted: equal ones are neighbours then, and the union of their places is counted
    from left to right.
    """
    def hashed(w: Column, first: int | None, at: Column) -> Column:
        five = [w[at + i] for i in range(WINDOW)]
        return F.xxhash64(*([] if first is None else [F.lit(first)]), *five)

    def places(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - WINDOW)

    def meet(a: Column, b: Column) -> Column:
        same = (a["h"] == b["h"]) & (a["g"] == b["g"])
        return F.when(same, F.array(a["at"], b["at"]))

    def covered(w: Column) -> Column:
        windows = F.sort_array(F.transform(places(w), lambda at: F.struct(
            hashed(w, None, at).alias("h"), hashed(w, 1, at).alias("g"), at.alias("at"))))
        pairs = _let(windows, lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), meet))
        at = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(at, start, lambda held, place: F.struct(
            (place + WINDOW).alias("end"),
            (held["total"] + WINDOW - F.greatest(held["end"] - place, F.lit(0))).alias("total")),
            lambda held: held["total"])

    def count(w: Column) -> Column:
        seen = F.size(F.array_distinct(F.transform(places(w), lambda at: hashed(w, None, at))))
        return F.when(F.size(w) <= WINDOW, 0).when(seen == F.size(w) - WINDOW + 1, 0).otherwise(
            covered(w))

    return _let(words, count).cast("bigint")


def measures() -> Column:
    """Group keys, base counts and the measures of the rules, as one struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(LETTER))

    def of_lines(held: Column) -> Column:
        return F.struct(F.size(held).alias("n"),
                        (F.size(held) - F.size(F.array_distinct(held))).alias("dup"))

    def of_words(held: Column) -> Column:
        return F.struct(F.size(held).alias("n"),
                        F.char_length(F.array_join(held, "")).alias("chars"),
                        repeated_words(held).alias("repeat"))

    def ruled(counted: Column) -> Column:
        words, at = counted["words"], counted["lines"]
        return F.struct(
            *[group_key(F.col(c)).alias(f"{c}_key") for c in ("lang", "source")],
            words["n"].cast("bigint").alias("n_words"),
            words["chars"].cast("bigint").alias("word_chars"),
            counted["n_symbols"].cast("bigint").alias("n_symbols"),
            at["dup"].cast("bigint").alias("n_dup_lines"),
            words["repeat"].cast("bigint").alias("n_repeat_words"),
            _share(words["chars"], words["n"], 100).alias("word_length"),
            _share(counted["n_symbols"], words["chars"]).alias("symbol_share"),
            _share(at["dup"], at["n"]).alias("dup_line_share"),
            _share(words["repeat"], words["n"]).alias("repeat_share"))

    return _let(F.struct(_let(words_of(text), of_words).alias("words"),
                         _let(lines, of_lines).alias("lines"), n_symbols.alias("n_symbols")), ruled)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, group keys and whole-number measures of every document, one row each."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), measures().alias("found"))
    return found.select("doc_id", "found.*")


def _share(part: Column, whole: Column, unit: int = 10_000) -> Column:
    filled = F.call_function("div", part.cast("bigint") * F.lit(unit), whole.cast("bigint"))
    return F.when(whole > 0, filled).otherwise(F.lit(0).cast("bigint"))


def group_key(value: Column) -> Column:
    """A key that is never null and tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


# Sketches

def bucket(value: Column) -> Column:
    """The bucket of a whole number from 0: a power of two and the `BITS` bits after the first."""
    drop = F.greatest(F.length(F.bin(value)) - 1 - BITS, F.lit(0))
    return (drop * F.lit(2**BITS) + F.call_function("shiftright", value, drop)).cast("int")


def bucket_low(number: Column) -> Column:
    """The least value of a bucket."""
    drop = F.greatest(F.call_function("div", number, F.lit(2**BITS)) - 1, F.lit(0)).cast("int")
    rest = (number - drop * F.lit(2**BITS)).cast("bigint")
    return F.call_function("shiftleft", rest, drop)


def sketch(rows: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """The sketch of each group and measure: `by`, measure, bucket, held. It has at most
    `2**BITS` rows for each power of two, however many rows are summarised."""
    kinds = [F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures]
    return rows.select(*by, F.inline(F.array(*kinds))).groupBy(*by, "measure", "bucket").agg(
        F.count(F.lit(1)).alias("held"))


def merged(sketches: list[DataFrame], by: list[str]) -> DataFrame:
    """The sketch of all the rows that the given sketches summarise, by these columns."""
    parts = [s.select(*by, "measure", "bucket", "held") for s in sketches]
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "measure", "bucket").agg(
        F.sum("held").alias("held"))


def quantiles(sketched: DataFrame, by: list[str], at: dict[str, tuple[int, int]]) -> DataFrame:
    """`by`, measure, docs, and for each name of `at` the value at that share (part, whole).

    The value at a share is the least of the bucket that holds the row of that rank. A group has few
    buckets, so ordering them is a small task.
    """
    group = [*by, "measure"]
    upto = F.sum("held").over(Window.partitionBy(*group).orderBy("bucket"))
    total = F.sum("held").over(Window.partitionBy(*group))
    ranked = sketched.select(*group, "bucket", upto.alias("upto"), total.alias("docs"))
    values = [
        F.min(F.when(F.col("upto") * whole > (F.col("docs") - 1) * part, bucket_low(F.col("bucket"))))
        .alias(name) for name, (part, whole) in at.items()]
    return ranked.groupBy(*group).agg(F.max("docs").alias("docs"), *values)


# Thresholds and filter

def thresholds(sketched: DataFrame, by: list[str], fences: int = FENCES) -> DataFrame:
    """`by`, docs and the threshold of each rule, one row per group of a sketch."""
    found = quantiles(sketched, by, {"q1": (1, 4), "q3": (3, 4)})
    columns = []
    for rule in RULES:
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(rule.slack)) * fences
        bound = F.col("q3") + reach if rule.upper else F.col("q1") - reach
        columns.append(F.max(F.when(F.col("measure") == rule.name, bound)).alias(_column(rule)))
    return found.groupBy(*by).agg(F.max("docs").alias("docs"), *columns)


def _column(rule: Rule) -> str:
    return f"{'most' if rule.upper else 'least'}_{rule.name}"


def group_sketch(rows: DataFrame) -> DataFrame:
    """Sketches per language and source of the rows of `measured` that pass the base rules; what
    those drop would move the thresholds."""
    return sketch(rows.filter(~base_failed()), list(KEYS))


def judged(rows: DataFrame, fine: DataFrame, fences: int = FENCES,
           min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows with the columns of `measured`, with the threshold of each rule from a saved
    `group_sketch` and `passes`, whether all rules hold."""
    names = [_column(rule) for rule in RULES]

    def found(prefix: str, by: list[str]) -> DataFrame:
        own = thresholds(merged([fine], by), by, fences).filter(F.col("docs") >= min_docs)
        return save(own.select(*[F.col(c).alias(f"{prefix}_{c}") for c in [*by, *names]]),
                    f"quality-{prefix}")

    groups, langs = found("group", list(KEYS)), found("lang", ["lang_key"])
    # One row, whatever the table holds.
    every = thresholds(merged([fine], []), [], fences).select(*names).first()
    own = rows.join(if_small(groups), (F.col("lang_key") == F.col("group_lang_key"))
                    & (F.col("source_key") == F.col("group_source_key")), "left")
    own = own.join(if_small(langs), F.col("lang_key") == F.col("lang_lang_key"), "left")
    bounds = {name: F.coalesce(f"group_{name}", f"lang_{name}",
                               F.lit(every and every[name]).cast("bigint")) for name in names}
    holds = [F.col(r.name) <= F.col(_column(r)) if r.upper else F.col(r.name) >= F.col(_column(r))
             for r in RULES]
    passes = F.coalesce(reduce(lambda a, b: a & b, holds), F.lit(True))
    return own.select(*rows.columns, *[bound.alias(name) for name, bound in bounds.items()]
                      ).withColumn("passes", passes)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def quality(docs: DataFrame, fences: int = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the threshold of each rule.

    A null text counts as empty: no words, so base_failed. Null and empty lang or source are groups of
    their own. Rows that repeat are measured and counted each; a measure equal to its threshold
    passes. Where no document passes the base rules, thresholds are null and
    base_failed alone decides. An empty table gives no rows; other columns are not looked at.
    """
    rows = save(measured(docs), "quality-measures")
    fine = save(group_sketch(rows), "quality-sketch")
    return judged(rows, fine, fences, min_docs).select(
        "doc_id", *_BASE, base_failed().alias("base_failed"),
        (~base_failed() & F.col("passes")).alias("kept"), *[_column(rule) for rule in RULES])


def well_made(docs: DataFrame, fences: int = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that `quality` keeps, with all their columns. Texts are measured twice, for the
    sketches and for the filter, rather than moved."""
    fine = save(group_sketch(measured(docs)), "quality-sketch")
    rows = docs.select(F.struct("*").alias("row"), measures().alias("found")).select("row", "found.*")
    found = judged(rows, fine, fences, min_docs)
    return found.filter(~base_failed() & F.col("passes")).select("row.*")


def _sql_bucket(value: str) -> str:
    drop = f"greatest(length(bin({value})) - 1 - {BITS}, 0)"
    return f"({drop} * {2**BITS} + ({value} >> ({drop})::integer))"


def _sql_thresholds(by: str) -> str:
    """The threshold of each rule per group, from the sketch of the rows that pass the base rules."""
    group = f"{by}, measure" if by else "measure"
    quartile = (f"min(case when upto * 4 > (docs - 1) * {{}} then (number - drop * {2**BITS}) << drop end)")
    bounds = ", ".join(
        f"max(case when measure = '{r.name}' then " + (
            f"q3 + greatest(q3 - q1, {r.slack}) * {FENCES}" if r.upper
            else f"q1 - greatest(q3 - q1, {r.slack}) * {FENCES}") + f" end)::bigint as {_column(r)}"
        for r in RULES)
    select = f"{by}, " if by else ""
    return f"""
  select {select}max(docs) as docs, {bounds}
  from (select {group}, max(docs) as docs, {quartile.format(1)} as q1, {quartile.format(3)} as q3
        from (select *, greatest(number // {2**BITS} - 1, 0)::bigint as drop,
                sum(held) over (partition by {group} order by number) as upto,
                sum(held) over (partition by {group}) as docs
              from (select {group}, number::bigint as number, count(*) as held from buckets
                    group by {group}, number))
        group by {group})
  {f"group by {by}" if by else ""}"""


def _sql() -> str:
    shares = {
        "word_length": "word_chars * 100 // n_words", "symbol_share": "n_symbols * 10000 // word_chars",
        "dup_line_share": "n_dup_lines * 10000 // n_lines",
        "repeat_share": "n_repeat_words * 10000 // n_words"}
    share = ", ".join(f"coalesce({expr}, 0)::bigint as {name}" for name, expr in shares.items())
    failed = (f"(n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})")
    bounds = ", ".join(f"coalesce(g.{c}, l.{c}, e.{c}) as {c}" for c in map(_column, RULES))
    holds = " and ".join(f"{r.name} {'<=' if r.upper else '>='} {_column(r)}" for r in RULES)
    buckets = " union all ".join(
        f"select lang_key, source_key, '{m}' as measure, {_sql_bucket(m)} as number from fine"
        for m in MEASURES)
    return rf"""
with split as (
  select row_number() over () as row, doc_id,
    coalesce('=' || lang, '') as lang_key, coalesce('=' || source, '') as source_key,
    regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda line: regexp_matches(line, '[^ 	-]')) as lines,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')) as n_symbols
  from documents),
starts as (
  select row, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') as five
  from (select row, words, unnest(range(len(words) - {WINDOW - 1})) as i from split
        where len(words) >= {WINDOW})),
repeated as (
  select row, count(distinct i + k) as n_repeat_words
  from (select row, i from starts qualify count(*) over (partition by row, five) > 1)
  cross join (select unnest(range({WINDOW})) as k) group by row),
counted as (
  select row, doc_id, lang_key, source_key, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    nullif(len(lines), 0) as n_lines
  from split left join repeated using (row)),
rows as (
  select * replace (coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars),
    {failed} as base_failed
  from (select * replace (nullif(n_words, 0) as n_words, nullif(word_chars, 0) as word_chars), {share}
        from counted)),
fine as (select * from rows where not base_failed),
buckets as ({buckets}),
groups as ({_sql_thresholds("lang_key, source_key")}),
langs as ({_sql_thresholds("lang_key")}),
every as ({_sql_thresholds("")}),
bounded as (
  select r.*, {bounds}
  from rows r left join groups g on r.lang_key = g.lang_key and r.source_key = g.source_key
    and g.docs >= {MIN_DOCS}
  left join langs l on r.lang_key = l.lang_key and l.docs >= {MIN_DOCS} cross join every e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  coalesce(base_failed, true) as base_failed,
  not coalesce(base_failed, true) and coalesce({holds}, true) as kept, {", ".join(map(_column, RULES))}
from bounded"""


ORACLE_SQL = _sql()
