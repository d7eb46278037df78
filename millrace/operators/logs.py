"""App-log split: one nested record to page, display, action, start and error rows.

The record is parsed once.  :func:`flatten` yields one row per record with the
reason it cannot be split, if any; the row functions project from it, and
:func:`route` emits every output of a record in a single narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json import as_long, computed_once, parse, record_to_json
from millrace.schemas import (
    ACTION_FIELDS,
    COMMON_FIELDS,
    CORRUPT,
    DISPLAY_FIELDS,
    PAGE_FIELDS,
    RAW_LOG,
    START_FIELDS,
    TOPIC_ACTION,
    TOPIC_DISPLAY,
    TOPIC_ERROR,
    TOPIC_LOG_REJECT,
    TOPIC_PAGE,
    TOPIC_START,
)

COMMON = list(COMMON_FIELDS.values())
PAGE = list(PAGE_FIELDS.values())
START = list(START_FIELDS.values())
_NUMERIC = {"during_time", "action_ts", "open_ad_skip_ms", "open_ad_ms", "loading_time", "open_ad_id"}


def _fields(source: Column, names: dict[str, str]) -> list[Column]:
    """Fields of a parsed object under their output names (PRJ-3..7)."""
    return [
        (as_long(source[raw]) if out in _NUMERIC else source[raw]).alias(out)
        for raw, out in names.items()
    ]


def _present(source: Column, names: dict[str, str]) -> Column:
    return F.when(source.isNotNull(), F.struct(*_fields(source, names)))


def flatten(raw: DataFrame, *, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-1, PRJ-3, FLT-1..4: one row per record.

    Columns: ``keep``, ``value``, ``is_error``, ``reject`` (why the record cannot be
    split, null if it can), the common columns, ``ts``, and the nested ``page``,
    ``displays``, ``actions`` and ``start``.
    """
    log = F.col("_log")
    carried = (*[c for c in keep if c != value], value)
    parsed = computed_once(raw.select(*carried, parse(value, RAW_LOG).alias("_log")), through=carried)
    has_page = log["page"].isNotNull()
    page = _present(log["page"], PAGE_FIELDS)
    start = _present(log["start"], START_FIELDS)
    # FLT-4: displays and actions count only inside a page record.
    displays = F.when(has_page, log["displays"])
    actions = F.when(has_page, log["actions"])
    flat = parsed.select(
        *carried,
        F.col("_log").isNull().alias("_no_value"),
        log[CORRUPT].isNotNull().alias("_corrupt"),
        log["common"].isNull().alias("_no_common"),
        F.coalesce(log["err"].isNotNull(), F.lit(False)).alias("is_error"),
        *_fields(log["common"], COMMON_FIELDS),
        as_long(log["ts"]).alias("ts"),
        page.alias("page"),
        displays.alias("displays"),
        actions.alias("actions"),
        start.alias("start"),
    )
    judged = flat.withColumn("reject", _reject_reason()).drop("_no_value", "_corrupt", "_no_common")
    return computed_once(judged, through=carried)


def _reject_reason() -> Column:
    """D1: a record whose required parts are missing goes to the reject output."""
    page_number = F.col("page").isNotNull() & F.col("page.during_time").isNull()
    start_number = F.col("start").isNotNull() & F.greatest(
        *[F.col(f"start.{c}").isNull() for c in START if c in _NUMERIC]
    )
    bad_display = F.exists("displays", lambda d: d.isNull())
    bad_action = F.exists("actions", lambda a: a.isNull() | as_long(a["ts"]).isNull())
    return (
        F.when(F.col("is_error"), F.lit(None).cast("string"))
        .when(F.col("_no_value"), "no_value")
        .when(F.col("_corrupt"), "bad_json")
        .when(F.col("_no_common"), "no_common")
        .when(F.col("ts").isNull(), "no_ts")
        .when(page_number | start_number, "bad_number")
        .when(F.coalesce(bad_display, F.lit(False)) | F.coalesce(bad_action, F.lit(False)), "bad_item")
    )


def _usable(flat: DataFrame) -> DataFrame:
    return flat.where(~F.col("is_error") & F.col("reject").isNull())


def error_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-8, FLT-1: error records, unchanged."""
    return flat.where("is_error").select(*keep, "value")


def reject_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """D1: records that cannot be split, with the reason."""
    return flat.where(F.col("reject").isNotNull()).select(*keep, "reject", "value")


def page_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-4, FLT-2: page views."""
    return _usable(flat).where("page IS NOT NULL").select(*keep, *COMMON, "page.*", "ts")


def display_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-5, PRJ-9: one row per display of a page view."""
    items = _usable(flat).select(*keep, *COMMON, "page.*", "ts", F.explode("displays").alias("_item"))
    return items.select(*keep, *COMMON, *PAGE, *_fields(F.col("_item"), DISPLAY_FIELDS), "ts")


def action_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-6, PRJ-9: one row per action of a page view."""
    items = _usable(flat).select(*keep, *COMMON, "page.*", "ts", F.explode("actions").alias("_item"))
    return items.select(*keep, *COMMON, *PAGE, *_fields(F.col("_item"), ACTION_FIELDS), "ts")


def start_rows(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-7, FLT-3: app starts; independent of the page part."""
    return _usable(flat).where("start IS NOT NULL").select(*keep, *COMMON, "start.*", "ts")


def route(flat: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """RTE-1, SNK-3: ``(topic, value)`` rows for every output of every record.

    All outputs of a record are built as one array and exploded, so the input is
    read and parsed once however many topics it feeds.
    """
    common = [F.col(c) for c in COMMON]
    page = [F.col(f"page.{c}").alias(c) for c in PAGE]
    start = [F.col(f"start.{c}").alias(c) for c in START]
    usable = ~F.col("is_error") & F.col("reject").isNull()

    def out(topic: str, value: Column) -> Column:
        return F.struct(F.lit(topic).alias("topic"), value.alias("value"))

    def item_json(names: dict[str, str]):
        return lambda item: record_to_json(*common, *page, *_fields(item, names), F.col("ts"))

    single = F.array(
        F.when(F.col("is_error"), out(TOPIC_ERROR, F.col("value"))),
        F.when(
            F.col("reject").isNotNull(),
            out(TOPIC_LOG_REJECT, record_to_json("reject", "value")),
        ),
        F.when(
            usable & F.col("page").isNotNull(),
            out(TOPIC_PAGE, record_to_json(*common, *page, F.col("ts"))),
        ),
        F.when(
            usable & F.col("start").isNotNull(),
            out(TOPIC_START, record_to_json(*common, *start, F.col("ts"))),
        ),
    )

    def many(topic: str, items: str, names: dict[str, str]) -> Column:
        to_json = item_json(names)
        rows = F.transform(items, lambda item: out(topic, to_json(item)))
        return F.when(usable & F.col(items).isNotNull(), rows).otherwise(F.array())

    outputs = F.concat(
        F.array_compact(single),
        many(TOPIC_DISPLAY, "displays", DISPLAY_FIELDS),
        many(TOPIC_ACTION, "actions", ACTION_FIELDS),
    )
    return flat.select(*keep, F.explode(outputs).alias("_out")).select(*keep, "_out.topic", "_out.value")
