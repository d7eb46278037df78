"""Change-record split: facts by table and operation, dimensions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json import computed_once, parse
from millrace.operators.keyed import latest_per_key
from millrace.schemas import CHANGE_ENVELOPE, CHANGE_OPS, CORRUPT, TOPIC_DB_REJECT

#: Table lists up to this size become a literal filter; longer ones a join.
MAX_LITERAL_NAMES = 10_000


def change_op(kind: Column | str) -> Column:
    """FN-5: ``I``, ``U`` or ``D``; null for change types nobody asked for."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    op = F.lit(None).cast("string")
    for name, letter in reversed(CHANGE_OPS.items()):
        op = F.when(kind == name, F.lit(letter)).otherwise(op)
    return op


def changes(raw: DataFrame, *, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-1, PRJ-16, FLT-5: parsed change records that carry a known operation.

    Columns: ``keep``, ``table``, ``op``, ``data`` (the row image as JSON text).
    """
    return wanted(judged(raw, value=value, keep=keep)).select(*keep, "table", "op", "data")


def bad_changes(raw: DataFrame, *, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """D1: change records that are unreadable, or wanted but without table or data."""
    return judged(raw, value=value, keep=keep).where("reject IS NOT NULL").select(*keep, value)


def wanted(records: DataFrame) -> DataFrame:
    """Of judged records, those to be routed; the rest are rejects, and changes of types nobody asked for."""
    return records.where(F.col("reject").isNull() & F.col("op").isNotNull())


def judged(raw: DataFrame, *, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every change record, parsed once: ``keep``, ``value``, ``reject``, ``table``, ``op``, ``data``.

    ``reject`` is ``no_value``, ``bad_json``, or for wanted changes ``no_table`` or ``no_data``; else null.
    """
    carried = (*[c for c in keep if c != value], value)
    env = F.col("_env")
    parsed = computed_once(
        raw.select(*carried, parse(value, CHANGE_ENVELOPE).alias("_env")), through=carried
    )
    fields = parsed.select(
        *carried,
        (env.isNull() | env[CORRUPT].isNotNull()).alias("_unreadable"),
        env["table"].alias("table"),
        change_op(env["type"]).alias("op"),
        env["data"].alias("data"),
    )
    reject = (
        F.when(F.col(value).isNull(), "no_value")
        .when(F.col("_unreadable"), "bad_json")
        .when(F.col("op").isNull(), None)
        .when(F.col("table").isNull(), "no_table")
        .when(F.col("data").isNull(), "no_data")
    )
    return fields.select(*carried, reject.alias("reject"), "table", "op", "data")


def reject_records(records: DataFrame, *, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """D1: the rejects of judged records as ``(topic, key, value)``, with the reason as key."""
    bad = records.where(F.col("reject").isNotNull())
    return bad.select(*keep, F.lit(TOPIC_DB_REJECT).alias("topic"), F.col("reject").alias("key"), F.col(value).alias("value"))


def name_filter(names: DataFrame, column: str = "table_name") -> list[str] | None:
    """SRC-7: the configured table names, or ``None`` when there are too many to list."""
    rows = names.select(column).distinct().limit(MAX_LITERAL_NAMES + 1).collect()
    return None if len(rows) > MAX_LITERAL_NAMES else [r[0] for r in rows]


def keep_listed(df: DataFrame, names: DataFrame, *, on: str = "table", column: str = "table_name") -> DataFrame:
    """JN-10: rows whose ``on`` is in the list; names are compared as they are (F3).

    A short list (its length is checked) becomes a literal set, so the filter is
    narrow and no join on the very uneven table name is needed.  A longer list
    is semi-joined; the rows of a large table are then split by adaptive
    execution.
    """
    listed = name_filter(names, column)
    if listed is None:
        keys = names.select(F.col(column).alias(on)).distinct()
        return df.join(keys, on, "left_semi")
    return df.where(F.col(on).isin(listed)) if listed else df.where(F.lit(False))


def fact_topic() -> Column:
    """SNK-4, FN-6: ``DWD_<TABLE>_<op>``."""
    return F.concat(F.lit("DWD_"), F.upper("table"), F.lit("_"), F.col("op"))


def fact_records(
    changed: DataFrame,
    fact_tables: DataFrame,
    *,
    key: str | None = None,
    keep: tuple[str, ...] = (),
    fields: tuple[str, ...] = (),
) -> DataFrame:
    """RTE-2, SNK-1, SNK-2: ``(topic, value)`` rows of fact tables.

    ``key`` names a field of the row image to use as the record key; ``fields`` are others to give as columns.
    The image is parsed once for all of them.
    """
    listed = keep_listed(changed, fact_tables)
    names = [*([key] if key else []), *fields]
    read = [F.json_tuple("data", *names).alias(*(["key"] if key else []), *fields)] if names else []
    return listed.select(*keep, fact_topic().alias("topic"), *read, F.col("data").alias("value"))


def dim_changes(changed: DataFrame, dim_tables: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """RTE-2, SNK-6: dimension row images by ``(dim, id)``.

    The operation is not looked at: a delete stores the row image too (F4).
    """
    return keep_listed(changed, dim_tables).select(
        *keep,
        F.upper("table").alias("dim"),
        F.get_json_object("data", "$.id").alias("id"),
        F.col("data"),
    )


def current_dims(dim_log: DataFrame, order: list[str]) -> DataFrame:
    """AGG-4, F5: the row image that arrived last for every ``(dim, id)``."""
    return latest_per_key(dim_log, ["dim", "id"], order).select("dim", "id", "data")
