"""Neighbours and ranks inside a key without putting the whole key into one task.

A plain window per node would place every row of that node in one task, and one node may hold a
third of the data. Here rows are cut into time slots: windows run per (key, slot), and only the two edge
rows of each slot meet per key, so a key gathers at most twice the time span divided by the slot width.
slot_seconds_for measures the slot width for data that is denser than the default expects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import as_col, micros

SLOT_SECONDS = 3600


def time_slot(ts, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(float(seconds * 1_000_000)))


def slot_seconds_for(df: DataFrame, keys: list[str], ts: str, max_rows: int = 4_000_000, start: int = 86_400) -> int:
    """Widest slot (a day or a fraction of it) whose fullest (key, slot) stays under max_rows.

    Costs one partially aggregated count per halving; use it when the density of the data is unknown.
    """
    width = start
    while width > 1:
        fullest = (
            df.groupBy(*keys, time_slot(ts, width).alias("_slot")).count().agg(F.max("count")).first()[0]
        )
        if fullest is None or fullest <= max_rows:
            break
        width = max(1, width // max(2, -(-fullest // max_rows)))
    return width


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    ts: str,
    carry: list[str],
    tie: str | None = None,
    lag: bool = True,
    lead: bool = False,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Adds, per key in (ts, tie) order, prev_<c> and / or next_<c> for the carried columns.

    Two windows in one pass over the data: the first per (key, slot); the second brings only the first
    and last row of every slot together per key, where a slot's first row finds the last row of the slot
    before it. (ts, tie) must be unique inside a key.
    """
    order = [ts] if tie is None else [ts, tie]
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    inner = [F.lag(c).over(in_slot).alias(f"_p_{c}") for c in carry] if lag else []
    inner += [F.lead(c).over(in_slot).alias(f"_n_{c}") for c in carry] if lead else []
    body = (
        df.withColumn("_slot", time_slot(ts, slot_seconds))
        .select(*df.columns, "_slot", *inner, (F.row_number().over(in_slot) == 1).alias("_first"),
                F.lead(F.lit(1)).over(in_slot).isNull().alias("_last"))
        .withColumn("_slot", F.when(~(F.col("_first") | F.col("_last")), F.col("_slot"))))
    edges = Window.partitionBy(*keys, "_slot").orderBy(*order)  # slot is null for all edge rows of a key
    cols: list[Column] = []
    if lag:
        cols += [F.when(F.col("_first"), F.lag(c).over(edges)).otherwise(F.col(f"_p_{c}")).alias(f"prev_{c}") for c in carry]
    if lead:
        cols += [F.when(F.col("_last"), F.lead(c).over(edges)).otherwise(F.col(f"_n_{c}")).alias(f"next_{c}") for c in carry]
    return body.select(*[F.col(c) for c in df.columns], *cols)


def with_position(df: DataFrame, keys: list[str], ts: str, tie: str | None = None,
                  slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Adds the 0-based position `pos` per key in (ts, tie) order and the group size `group_size`.

    Rows are numbered inside their slot; what earlier slots hold comes from slot counts, a partially
    aggregated table of one row per key and slot.
    """
    body = df.withColumn("_slot", time_slot(ts, slot_seconds))
    per_key = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = body.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_rows")).select(
        *keys, "_slot", F.coalesce(F.sum("_rows").over(per_key), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("group_size"))
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*([ts] if tie is None else [ts, tie]))
    return body.join(counts, [*keys, "_slot"]).select(
        *[F.col(c) for c in df.columns], (F.col("_offset") + F.row_number().over(in_slot) - 1).alias("pos"), "group_size")


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "n") -> DataFrame:
    """Rows of the same key in (ts - seconds, ts], by the exact microsecond.

    A row enters its own slot at ts and, from the slot before, leaves at ts + seconds. With slots as wide
    as the period the count is what the previous slot held, less those that left, plus those that entered:
    running sums, where a sliding range frame would count its whole frame again for every row.
    """
    width = seconds * 1_000_000
    us = micros(ts)
    slot = F.floor(us / F.lit(float(width)))
    enter = F.struct(slot.alias("_slot"), (us * 2 + 1).alias("_at"), F.lit(1).alias("_step"))
    leave = F.struct((slot + 1).alias("_slot"), ((us + width) * 2).alias("_at"), F.lit(-1).alias("_step"))
    moves = df.select(*df.columns, F.explode(F.array(enter, leave)).alias("_m")).select(*df.columns, "_m.*")
    group = Window.partitionBy(*keys, "_slot")
    so_far = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.count_if(F.col("_step") < 0).over(group)
    return (
        moves.withColumn(name, held + F.sum("_step").over(so_far))
        .filter("_step > 0").select(*df.columns, name))


def competition_rank(df: DataFrame, value: str, ascending: bool = False, name: str = "rank") -> DataFrame:
    """1 + number of rows with a strictly better value, over the whole table.

    Equal values collapse in the partial count, values are then ranked inside unit-wide buckets, and
    only the bucket totals (one row per whole number) meet in one place.
    """
    bucket = F.floor(as_col(value)).alias("_bucket")
    counts = df.groupBy(bucket, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    order = F.col("_value").asc() if ascending else F.col("_value").desc()
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    border = F.col("_bucket").asc() if ascending else F.col("_bucket").desc()
    above = Window.orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("_bucket").agg(F.sum("_rows").alias("_total"))
    buckets = buckets.select("_bucket", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_above"))
    ranked = counts.withColumn("_better", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(buckets, "_bucket")
    ranked = ranked.select("_value", (F.col("_better") + F.col("_above") + 1).alias(name))
    return df.join(ranked, df[value] == ranked["_value"]).drop("_value")
