"""Validity history of changing entity attributes, from stored checkpoints and deltas.

An append-only log of statements ``(entity, attribute, value, time, id)`` is
stored (``stored``) as two tables in the shared folder:

* **patches**: a row for each change of an attribute within a period (of several
  statements at one moment the row with the largest id holds), and
* **versions**: the full version of every entity at the start of each period:
  its attributes with the values that hold then, since when, and until when. What
  never changes again is written once and belongs to all later versions.

``validity`` folds the patches of each period forward from the version at its start,
up to what the next version says about its end. ``as_of`` reads the nearest
version before a moment and the patches between the two. Neither a fold nor a
sort ever covers more than one period of one attribute, however many rows an
entity has; only one row per attribute and period is carried between periods.

Defined cases: rows with null time, null or blank value say nothing; null
entities and attributes are kept as keys of their own; repeated rows and
repeated values open no version; equal times are settled by the id; an empty
log gives an empty history; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import UNSEEN, fold_key
from fathomline.session import cut

#: Stands for a null key between the shuffles.
_NULL = "\x00null"

#: Length of a period in microseconds (90 days).
PERIOD_US = 90 * 86_400 * 1_000_000


class Store(NamedTuple):
    """The two tables of a log, and the length of their periods."""

    patches: DataFrame
    versions: DataFrame
    period_us: int


def patches(
    log: DataFrame,
    entity: str = "user_id",
    attribute: str = "field",
    value: str = "value",
    at: str = "created_at",
    order: str = "id",
    period_us: int = PERIOD_US,
) -> DataFrame:
    """``entity, attribute, period, ts, value``: what the log says, one row per moment."""
    said = log.select(
        F.coalesce(fold_key(F.col(entity)), F.lit(_NULL)).alias("entity"),
        F.coalesce(fold_key(F.col(attribute)), F.lit(_NULL)).alias("attribute"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("ts"),
        fold_key(F.col(value)).alias("value"),
        F.col(order).alias("_order"),
    ).where(F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("value").rlike(rf"[^{UNSEEN}]"))
    return (
        said.withColumn("period", F.floor(F.col("ts") / F.lit(period_us)))
        .repartition("entity", "attribute", "period")
        .groupBy("entity", "attribute", "period", "ts")
        .agg(F.max_by("value", "_order").alias("value"))
    )


def _key(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(_NULL)).alias(name)


def _changes(patch: DataFrame) -> DataFrame:
    """Per period, the patches that differ from the one before them; the period's first is always kept.

    The first one also carries ``run``: when the second and the last change of its period are, and to what the last is.
    """
    within = Window.partitionBy("entity", "attribute", "period").orderBy("ts")
    all_of = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = F.struct(
        F.min(F.when(~F.col("first"), F.col("ts"))).over(all_of).alias("second_ts"),
        F.max("ts").over(all_of).alias("last_ts"),
        F.last("value").over(all_of).alias("last_value"),
    )
    return (
        patch.withColumn("_before", F.lag("value").over(within))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("value")))
        .withColumn("first", F.col("_before").isNull())
        .drop("_before")
        .withColumn("run", run)
        .withColumn("run", F.when(F.col("first"), F.col("run")))
    )


def _versions(changes: DataFrame, period_us: int, at_us: int | None) -> DataFrame:
    """``entity, attribute, version, value, since, until, opens, ends``: what holds when period ``version`` begins.

    ``until`` is -1 for what still holds; such a row stands for all later versions
    as well, so a far moment in a log doesn't multiply the others. ``opens`` says that the period has
    patches of the attribute, ``ends`` that the period before it has. With ``at_us``
    only the version nearest before that moment is made.
    """
    keys = ["entity", "attribute"]
    runs = changes.where("first").select(
        *keys, "period", F.col("ts").alias("first_ts"), F.col("value").alias("first_value"), "run.second_ts", "run.last_ts", F.col("run.last_value").alias("value")
    )
    forward = Window.partitionBy(*keys).orderBy("period")
    later = forward.rowsBetween(1, Window.unboundedFollowing)
    before = F.lag("value").over(forward)
    started = F.when(before.isNull() | (before != F.col("first_value")), F.col("first_ts")).otherwise(F.col("second_ts"))
    # a period that only repeats what held before it starts nothing
    since = F.when(F.col("started").isNotNull(), F.col("last_ts"))
    carried = (
        runs.withColumn("started", started)
        .withColumn("since", F.last(since, ignorenulls=True).over(forward))
        .withColumn("until", F.coalesce(F.min("started").over(later), F.lit(-1)))
        .withColumn("next", F.lead("period").over(forward))
    )
    if at_us is None:
        rows = carried.withColumn("version", F.explode(F.sequence(F.col("period") + 1, F.coalesce("next", F.col("period") + 1))))
    else:
        wanted = at_us // period_us
        rows = carried.where((F.col("period") < wanted) & (F.col("next").isNull() | (F.col("next") >= wanted))).withColumn(
            "version", F.lit(wanted).cast("long")
        )
    opens = F.coalesce(F.col("version") == F.col("next"), F.lit(False)).alias("opens")
    return rows.select(*keys, "version", "value", "since", "until", opens, (F.col("version") == F.col("period") + 1).alias("ends"))


def stored(log: DataFrame, period_us: int = PERIOD_US, at_us: int | None = None, **names: str) -> Store:
    """Write a log's patches and versions. With ``at_us`` only the version is written that a reader of the moment needs."""
    changes = cut(_changes(patches(log, period_us=period_us, **names)))
    return Store(changes, cut(_versions(changes, period_us, at_us)), period_us)


def validity(log: DataFrame, period_us: int = PERIOD_US, **names: str) -> DataFrame:
    """``entity, attribute, value, valid_from_us, valid_to_us`` for every version of a value; -1 is still valid."""
    return folded(stored(log, period_us, **names))


def folded(store: Store) -> DataFrame:
    """The validity rows of a store: the patches of each period, folded forward from the version before them.

    A period's version, its patches and what the next version says about its end
    are put in order together, so one shuffle serves all.
    """
    keys = ["entity", "attribute", "period"]
    none = F.lit(None).cast("long")
    first = store.versions.where("opens").select(
        *keys[:2], F.col("version").alias("period"), F.lit(0).alias("kind"), none.alias("ts"), "value"
    )
    middle = store.patches.select(*keys, F.lit(1).alias("kind"), "ts", "value")
    end = store.versions.where("ends").select(
        *keys[:2], (F.col("version") - 1).alias("period"), F.lit(2).alias("kind"), F.col("until").alias("ts"), F.lit(None).cast("string").alias("value")
    )
    inside = Window.partitionBy(*keys).orderBy("kind", "ts")
    rows = (
        first.unionByName(middle)
        .unionByName(end)
        .withColumn("before", F.lag("value").over(inside))
        .withColumn("valid_to_us", F.lead("ts").over(inside))
    )
    return rows.where((F.col("kind") == 1) & (F.col("before").isNull() | (F.col("before") != F.col("value")))).select(
        _key("entity"), _key("attribute"), "value", F.col("ts").alias("valid_from_us"), "valid_to_us"
    )


def full_versions(log: DataFrame, period_us: int = PERIOD_US, **names: str) -> DataFrame:
    """``entity, version_at_us, attribute, value, since_us, stands``: the stored versions of every entity.

    A row that ``stands`` belongs to all versions from its own on.
    """
    at = (F.col("version") * F.lit(period_us)).alias("version_at_us")
    return stored(log, period_us, **names).versions.select(_key("entity"), at, _key("attribute"), "value", F.col("since").alias("since_us"), (F.col("until") == -1).alias("stands"))


def as_of(log: DataFrame, at_us: int, period_us: int = PERIOD_US, **names: str) -> DataFrame:
    """The value of each attribute at a moment; ``entity, attribute, value, since_us``."""
    return read_as_of(stored(log, period_us, at_us, **names), at_us)


def read_as_of(store: Store, at_us: int) -> DataFrame:
    """``as_of`` from a store: the version nearest before the moment, and the patches between the two.

    The newest patch of an attribute holds; if it is the first one and
    repeats what the version says, that goes on.
    """
    nearest = at_us // store.period_us
    stands = (F.col("version") == nearest) | ((F.col("version") < nearest) & (F.col("until") == -1))
    base = store.versions.where(stands).select(
        "entity", "attribute", F.lit(None).cast("long").alias("ts"), "value", "since", F.lit(False).alias("first")
    )
    later = store.patches.where((F.col("ts") >= nearest * store.period_us) & (F.col("ts") <= at_us)).select(
        "entity", "attribute", "ts", "value", F.lit(None).cast("long").alias("since"), "first"
    )
    newest = F.max_by(F.struct("value", "ts", "first"), "ts")
    held = F.max(F.when(F.col("ts").isNull(), F.struct("value", "since")))
    both = base.unionByName(later).groupBy("entity", "attribute").agg(newest.alias("p"), held.alias("v"))
    goes_on = F.coalesce((F.col("p.value") == F.col("v.value")) & F.col("p.first"), F.col("p").isNull())
    return both.select(
        _key("entity"),
        _key("attribute"),
        F.when(goes_on, F.col("v.value")).otherwise(F.col("p.value")).alias("value"),
        F.when(goes_on, F.col("v.since")).otherwise(F.col("p.ts")).alias("since_us"),
    )
