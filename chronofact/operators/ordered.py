"""Neighbours, numbers and sums in an order, for keys of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.session import stored

Values = dict[str, Column]


def _quoted(names: Sequence[str], side: str = "") -> list[Column]:
    return [F.col(side + "`" + n.replace("`", "``") + "`") for n in names]


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def scanned(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, number: str | None = None, lag: Values | None = None, lead: Values | None = None, last: Values | None = None, total: Values | None = None
) -> DataFrame:
    """Adds what windows over the keys in ``order`` (ascending, nulls first) would give, without sorting a hot key in one task.

    ``number`` names the row's number from 1; ``lag`` and ``lead`` give the previous and the next row's values, null at the
    ends; ``last`` the latest value that isn't null up to the row itself; ``total`` the sum up to the row itself. Rows are
    windowed within (keys, bucket), where ``bucket`` is a non-decreasing function of the order such as the date. Each
    bucket leaves one row of its ends, count and sums; those rows are scanned by key, and what came before a bucket (or
    comes after it) is carried to its rows. Structs tell "no neighbour" (null) from null values. The order must be total,
    but for rows that are equal in all that is asked for.
    """
    lag, lead, last, total = lag or {}, lead or {}, last or {}, total or {}
    by = F.struct(*order)
    packed = {"_lag": lag, "_lead": lead, "_last": last, "_total": total}
    rows = df.withColumn("_bucket", bucket)
    for name, values in packed.items():
        if values:
            rows = rows.withColumn(name, F.struct(*[c.alias(n) for n, c in values.items()]))
    place = [*keys, "_bucket"]
    inner = Window.partitionBy(*place).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_bucket")
    upto, earlier = inner.rowsBetween(Window.unboundedPreceding, 0), outer.rowsBetween(Window.unboundedPreceding, -1)

    aggs = [F.count("*").alias("_n")]
    if lag:
        aggs.append(F.max_by("_lag", by).alias("_end"))
    if lead:
        aggs.append(F.min_by("_lead", by).alias("_start"))
    for n in last:
        # Nested in a struct, so that the latest of the values that aren't null is taken as it is.
        aggs.append(F.max_by(F.col(f"_last.{n}"), F.when(F.col(f"_last.{n}").isNotNull(), by)).alias(f"_last_{n}"))
    aggs += [F.sum(f"_total.{n}").alias(f"_sum_{n}") for n in total]
    ends = rows.groupBy(*place).agg(*aggs)
    carried = {}
    if number:
        carried["_before_n"] = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    if lag:
        carried["_before"] = F.lag("_end").over(outer)
    if lead:
        carried["_after"] = F.lead("_start").over(outer)
    carried |= {f"_held_{n}": F.last(f"_last_{n}", ignorenulls=True).over(earlier) for n in last}
    carried |= {f"_summed_{n}": F.sum(f"_sum_{n}").over(earlier) for n in total}
    ends = ends.select(*place, *[c.alias(n) for n, c in carried.items()])

    local = {}
    if number:
        local["_no"] = F.row_number().over(inner)
    if lag:
        local |= {"_previous": F.lag("_lag").over(inner), "_first": F.lag(F.lit(1)).over(inner).isNull()}
    if lead:
        local |= {"_next": F.lead("_lead").over(inner), "_final": F.lead(F.lit(1)).over(inner).isNull()}
    local |= {f"_here_{n}": F.last(f"_last.{n}", ignorenulls=True).over(upto) for n in last}
    local |= {f"_so_far_{n}": F.sum(f"_total.{n}").over(upto) for n in total}
    windowed = rows.select(*_quoted(df.columns), "_bucket", *[c.alias(n) for n, c in local.items()])

    both = windowed.alias("r").join(ends.alias("e"), _same("r", "e", place), "left")
    out = []
    if number:
        out.append((F.col("e._before_n") + F.col("r._no")).cast("long").alias(number))
    if lag:
        previous = F.when(F.col("r._first"), F.col("e._before")).otherwise(F.col("r._previous"))
        out += [previous[n].alias(n) for n in lag]
    if lead:
        following = F.when(F.col("r._final"), F.col("e._after")).otherwise(F.col("r._next"))
        out += [following[n].alias(n) for n in lead]
    out += [F.coalesce(F.col(f"r._here_{n}"), F.col(f"e._held_{n}")).alias(n) for n in last]
    for n in total:
        a, b = F.col(f"r._so_far_{n}"), F.col(f"e._summed_{n}")
        out.append(F.coalesce(a + b, a, b).alias(n))
    return both.select(*_quoted(df.columns, "r."), *out)


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: Values) -> DataFrame:
    """Adds for each name of ``values`` the value of the previous row of the keys in ``order``, null for the first (see ``scanned``)."""
    return scanned(df, keys, order, bucket, lag=values)


def with_position(df: DataFrame, order: Sequence[Column], position: str = "position") -> DataFrame:
    """Adds each row's place from 0 in an order over the whole table.

    Rows are dealt by ranges of the whole order, which Spark cuts by a sample of the rows, so no task gets much more than
    its share, whatever day or null holds most of them. They are stored with their part and place in it; the parts' row
    counts, one row each, are summed and added.
    """
    sorted_rows = df.orderBy(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    held = stored(sorted_rows.select("row", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "positions")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return held.join(before, "part").select("row.*", (F.col("before") + F.col("place")).alias(position))


def as_of(facts: DataFrame, probes: DataFrame, keys: list[str], order: list[str], at: str, bucket: Column, values: list[str]) -> DataFrame:
    """probes with ``values`` of the facts that hold at their time: the key's last fact at or before it by (time, ``order``).

    Both have the keys and the column ``at``; ``bucket`` is an expression over it. Facts and probes are scanned together,
    so a hot key's rows meet in buckets of time and only one row a bucket is carried on. Probes before any fact, with a
    null time or of unknown keys get nulls; a null in a key is a key like others. Facts without a time hold for none.
    """
    fact = F.struct(*[F.col(v).alias(v) for v in values])
    ordering = [f for f in facts.schema.fields if f.name in order]
    left = facts.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("_side"), *order, fact.alias("_fact"), F.lit(None).cast(probes.schema).alias("_probe"))
    right = probes.select(*keys, at, F.lit(1).alias("_side"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in sorted(ordering, key=lambda f: order.index(f.name))], F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), F.struct("*").alias("_probe"))
    both = scanned(left.unionByName(right), keys, [at, "_side", *order], bucket, last={"_held": F.col("_fact")})
    return both.where("_side = 1").select("_probe.*", *[F.col(f"_held.{v}").alias(v) for v in values])
