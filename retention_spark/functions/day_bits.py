"""Sets of days of one observation window as bits of bigint words.

Counting distinct days per user normally costs a second shuffle on (user, day). One bit per day,
merged with `bit_or`, gives the same count from a plain one-pass aggregate: the buffer is a few
bigints per user, it combines before the shuffle, and a user holding a third of all rows leaves
every map task as a single row. Because the days stay known, the set can later be cut to
each user's own interval without going back to the usage rows.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def word_count(days: int) -> int:
    return -(-days // WORD)


def _one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def collect_days(day: Column, keep: Column, start: date, days: int) -> list[Column]:
    """Aggregates, one per word: the days on which `keep` held. `day` must lie in the window."""
    offset = F.datediff(day, F.lit(start))
    words = []
    for word in range(word_count(days)):
        position = offset - word * WORD
        words.append(F.bit_or(F.when(keep & position.between(0, WORD - 1), _one_bit(position))))
    return words


def count_days(words: list[Column]) -> Column:
    """Number of days in the set; a NULL word is an empty one."""
    return reduce(add, (F.coalesce(F.bit_count(word), F.lit(0)) for word in words)).cast("bigint")


def count_days_between(words: list[Column], start: date, first: Column, last: Column) -> Column:
    """Number of days of the set inside the interval [first, last] of each row.

    An interval with an unknown end, or one that ends before it starts, holds no day.
    """
    kept = []
    for number, word in enumerate(words):
        base = number * WORD
        low = F.greatest(F.datediff(first, F.lit(start)) - base, F.lit(0))
        high = F.least(F.datediff(last, F.lit(start)) - base, F.lit(WORD - 1))
        ones = F.call_function(
            "shiftrightunsigned", F.lit(-1).cast("bigint"), WORD - 1 - (high - low)
        )
        # greatest and least pass over NULL, so unknown ends are kept out by the first test.
        holds_days = (first <= last) & (low <= high)
        mask = F.when(holds_days, F.call_function("shiftleft", ones, low))
        kept.append(word.bitwiseAND(mask))
    return count_days(kept)
