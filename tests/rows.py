"""Hand-made tables in the test calendar: window 2000-10-01 .. 2000-12-31, cut at its end."""

from __future__ import annotations

import random
from datetime import date, timedelta

from retention_spark.sources.schemas import CLEAN
from retention_spark.sources.tables import Tables, read_clean, write_clean

WIN_START, WIN_END = date(2000, 10, 1), date(2000, 12, 31)


def payment(msno, on=date(2000, 9, 15), plan=30, paid=149, auto=0, until=date(2001, 1, 15),
            cancel=0, method=41, price=None):
    return (msno, method, plan, paid if price is None else price, paid, auto, on, until, cancel)


def member(msno, registered=date(1999, 1, 1), city=1, bd=30, gender="male", via=7):
    return (msno, city, bd, gender, via, registered)


def listen(msno, on, n25=0, n50=0, n75=0, n985=0, n100=0, secs=60.0, unq=1):
    return (msno, on, n25, n50, n75, n985, n100, unq, secs)


def tables(spark, train=(), members=(), transactions=(), user_logs=()) -> Tables:
    rows = {"train": train, "members": members, "transactions": transactions,
            "user_logs": user_logs}
    return Tables(lambda name: spark.createDataFrame(list(rows[name]), CLEAN[name]))


def stored_tables(spark, folder, **rows) -> Tables:
    """The same tables written as cleaning writes them and read back."""
    made = tables(spark, **rows)
    for table in CLEAN:
        write_clean(getattr(made, table), f"{folder}/{table}", table)
    return Tables(lambda table: read_clean(spark, f"{folder}/{table}", table))


def random_rows(seed: int, users: int = 300) -> dict[str, list[tuple]]:
    """Users with every kind of gap: missing rows, NULL fields, ties, activity out of bounds."""
    r = random.Random(seed)

    def day(first: date, last: date) -> date:
        return first + timedelta(days=r.randint(0, (last - first).days))

    def maybe(value, chance=0.04):
        return None if r.random() < chance else value

    rows: dict[str, list[tuple]] = {t: [] for t in CLEAN}
    for i in range(users):
        msno = f"user{i}"
        if r.random() < 0.9:
            rows["train"].append((msno, int(r.random() < 0.3)))
        if r.random() < 0.85:
            rows["members"].append(member(
                msno, maybe(day(date(2000, 8, 1), date(2000, 12, 20))), r.randint(1, 22),
                maybe(r.randint(13, 85)), maybe("female"), r.choice([3, 4, 7, 9, 13])))
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            plan = maybe(r.choice([0, 7, 8, 30, 30, 30, 31, 90, 91, 100, 180, 195, 360, 410]))
            on = r.choice([day(date(2000, 6, 1), date(2001, 1, 31)), date(2000, 12, 1)])
            rows["transactions"].append(payment(
                msno, maybe(on), plan, maybe(r.randint(0, 2000)), r.randint(0, 1),
                maybe(on + timedelta(days=r.randint(-40, 120))), r.randint(0, 1),
                maybe(r.randint(1, 5))))
        for _ in range(r.choice([0, 0, 1, 5, 20, 120])):
            n = [maybe(r.choice([0, 0, 0, 1, 5]), 0.02) for _ in range(5)]
            rows["user_logs"].append(listen(
                msno, maybe(day(date(2000, 9, 20), date(2001, 1, 10)), 0.01), *n,
                secs=maybe(r.randint(0, 9_000_000) / 100)))
    return rows
