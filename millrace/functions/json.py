"""JSON parsing and binding as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import CORRUPT


def parse(text: Column | str, schema: T.StructType) -> Column:
    """PRJ-1: JSON text to a struct; unreadable text is kept in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(text, full, {"columnNameOfCorruptRecord": CORRUPT})


def computed_once(df: DataFrame, *, through: tuple[str, ...] = ()) -> DataFrame:
    """The same rows, with every column but ``through`` shielded from rewriting.

    Spark moves a filter on a computed column below the projection and repeats
    the computation there, once per mention.  For parsed JSON that multiplies
    the dearest step of the plan.  Filters do not pass a generator, so one that
    yields exactly one row per row keeps the columns computed once.
    """
    others = [c for c in df.columns if c not in through]
    return df.select(*through, F.inline(F.array(F.struct(*others))))


def as_long(text: Column) -> Column:
    """FN-3: whole number from JSON text (``"12"`` or ``12.0``), else null."""
    return text.try_cast("decimal(38,9)").try_cast("bigint")


def record_to_json(*columns: Column | str) -> Column:
    """PRJ-10: one JSON object; null fields are left out."""
    return F.to_json(F.struct(*columns))


def bind(
    df: DataFrame, schema: T.StructType, *, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """PRJ-2: bind JSON text to a typed record, keeping the columns in ``keep``.

    FN-16: absent numbers become zero, absent text stays null.  Records that do
    not bind are left out here; :func:`unbound` lists them.
    """
    names = [f.name for f in schema.fields]
    return judged(df, schema, value=value, keep=keep).where("reject IS NULL").select(*keep, *names)


def unbound(
    df: DataFrame, schema: T.StructType, *, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """D1: the records :func:`bind` leaves out, as ``value`` with ``keep``."""
    return judged(df, schema, value=value, keep=keep).where("reject IS NOT NULL").select(*keep, value)


def judged(
    df: DataFrame, schema: T.StructType, *, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """PRJ-1, PRJ-2, D1: every record, parsed once: ``keep``, ``value``, ``reject`` and the typed fields.

    ``reject`` is null for usable records, else ``no_value``, ``bad_json`` or ``bad_number``.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    others = tuple(c for c in keep if c != value)
    parsed = computed_once(
        df.select(*others, value, parse(value, texts).alias("_r")), through=(*others, value)
    )
    numeric = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    unreadable = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    # Numbers are read once, before the verdict and the typed fields that both need them.
    read = parsed.select(
        *others,
        value,
        unreadable.alias("_unreadable"),
        *[(F.col(f"_r.{f.name}") if f not in numeric else _number(f)).alias(f.name) for f in schema.fields],
        *[_present(f).isNotNull().alias(f"_has_{f.name}") for f in numeric],
    )
    read = computed_once(read, through=(*others, value))
    # A number that is present but unreadable rejects the record: a silent zero
    # would be a wrong result.
    unusable = [F.col(f"_has_{f.name}") & F.col(f.name).isNull() for f in numeric]
    reject = (
        F.when(F.col(value).isNull(), "no_value")
        .when(F.col("_unreadable"), "bad_json")
        .when(reduce(or_, unusable, F.lit(False)), "bad_number")
    )
    return read.select(*others, value, reject.alias("reject"), *[_typed(f).alias(f.name) for f in schema.fields])


def _present(field: T.StructField) -> Column:
    return F.nullif(F.col(f"_r.{field.name}"), F.lit(""))


def _number(field: T.StructField) -> Column:
    text = _present(field)
    if isinstance(field.dataType, T.LongType):
        return as_long(text)
    return text.try_cast(field.dataType)


def _typed(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    return F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))


def project_by_name(
    df: DataFrame, names: list[str], extra: dict[str, Column] | None = None
) -> DataFrame:
    """PRJ-11: the listed columns that exist in ``df`` or in ``extra``, in order.

    ``extra`` wins over a column of the same name; names found in neither are
    skipped.
    """
    extra = extra or {}
    have = set(df.columns)
    return df.select(
        *[extra[n].alias(n) if n in extra else F.col(n) for n in names if n in extra or n in have]
    )
