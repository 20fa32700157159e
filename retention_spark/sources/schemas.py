"""Declared schemas of the four tables, before and after cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_INT, _LONG, _TEXT, _DATE, _DOUBLE = (
    IntegerType(), LongType(), StringType(), DateType(), DoubleType(),
)

RAW: dict[str, StructType] = {
    "train": _struct(msno=_TEXT, is_churn=_INT),
    "members": _struct(
        msno=_TEXT, city=_INT, bd=_INT, gender=_TEXT, registered_via=_INT,
        registration_init_time=_LONG,
    ),
    "transactions": _struct(
        msno=_TEXT, payment_method_id=_INT, payment_plan_days=_INT, plan_list_price=_INT,
        actual_amount_paid=_INT, is_auto_renew=_INT, transaction_date=_INT,
        membership_expire_date=_INT, is_cancel=_INT,
    ),
    "user_logs": _struct(
        msno=_TEXT, date=_INT, num_25=_INT, num_50=_INT, num_75=_INT, num_985=_INT, num_100=_INT,
        num_unq=_INT, total_secs=_DOUBLE,
    ),
}

# Columns that cleaning turns into calendar dates.
DATE_COLUMNS: dict[str, tuple[str, ...]] = {
    "train": (),
    "members": ("registration_init_time",),
    "transactions": ("transaction_date", "membership_expire_date"),
    "user_logs": ("date",),
}

CLEAN: dict[str, StructType] = {
    table: StructType([
        StructField(f.name, _DATE if f.name in DATE_COLUMNS[table] else f.dataType)
        for f in schema.fields
    ])
    for table, schema in RAW.items()
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in declared order; raises when one is missing or of another type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: {found[f.name].simpleString() if f.name in found else 'missing'}"
        f" instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df.select(schema.fieldNames())
