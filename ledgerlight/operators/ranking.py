"""Rank, running counts and quantiles inside groups of any size.

A window ``PARTITION BY tier ORDER BY value`` puts every row of a tier on one
task; with three tiers that is three tasks for the whole table. Here one path
serves every size:

1. Rows become distinct (group, value) pairs with a count, combined before the
   shuffle. A value that most rows share is one pair, so ties never pile up.
2. The pairs are range-partitioned by (group, value) and written once, with
   the number of their partition. Partitions are of even size whatever the
   sizes of the groups are.
3. A running count inside each (group, partition), plus the group's counts in
   the partitions before it (one number per group and partition), is the
   running count inside the group.

Nothing is collected and no size decides on the plan. Ranks go back to the rows
by an equi-join on (group, value), where a hot value is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import materialize

_PART = "__part"


def _order(value_col: str, descending: bool) -> Column:
    return F.col(value_col).desc_nulls_last() if descending else F.col(value_col).asc_nulls_last()


def running_counts(df: DataFrame, group_cols: list[str], value_col: str, descending: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """One row per distinct (group, value): ``__c`` its rows, ``__cum`` the
    rows of the group up to and including it in the given order (NULL last),
    ``__n`` the rows of the group."""
    pairs = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("__c"))
    keys = [F.col(g) for g in group_cols] + [_order(value_col, descending)]
    dealt = pairs.repartitionByRange(partitions, *keys) if partitions else pairs.repartitionByRange(*keys)
    dealt = materialize(dealt.withColumn(_PART, F.spark_partition_id()))
    sums = dealt.groupBy(*group_cols, _PART).agg(F.sum("__c").alias("__s"))
    by_part = Window.partitionBy(*group_cols).orderBy(_PART)
    offsets = sums.select(
        *[F.col(g).alias(f"__k{i}") for i, g in enumerate(group_cols)], F.col(_PART).alias("__p"),
        F.coalesce(F.sum("__s").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__s").over(Window.partitionBy(*group_cols)).alias("__n"))
    inside = Window.partitionBy(*group_cols, _PART).orderBy(_order(value_col, descending)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("__l", F.sum("__c").over(inside))
    same = F.col(_PART) == F.col("__p")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    return local.join(offsets, same).select(
        *group_cols, value_col, "__c", (F.col("__off") + F.col("__l")).alias("__cum"), "__n")


def rank_in_groups(df: DataFrame, group_cols: list[str], value_col: str, descending: bool = True,
                   rank_col: str = "rank", pct_col: str | None = "percent_rank",
                   partitions: int | None = None) -> DataFrame:
    """Add SQL ``RANK()`` and ``PERCENT_RANK()`` over
    ``PARTITION BY group_cols ORDER BY value_col [DESC]``; NULLs order last,
    a NULL group is a group."""
    cum = running_counts(df, group_cols, value_col, descending, partitions)
    keys = [*group_cols, value_col]
    ranks = cum.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)],
                       (F.col("__cum") - F.col("__c") + 1).cast("bigint").alias(rank_col), "__n")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = df.join(ranks, same)
    if pct_col:
        out = out.withColumn(pct_col, F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(
            (F.col(rank_col) - 1).cast("double") / (F.col("__n") - 1).cast("double")))
    return out.drop("__n", *[f"__k{i}" for i in range(len(keys))])


def _at(index: Column, value_col: str) -> Column:
    """The value whose run of equal rows [cum - c, cum) holds ``index``."""
    hit = (F.col("__cum") - F.col("__c") <= index) & (index < F.col("__cum"))
    return F.min(F.when(hit, F.col(value_col)))


def nearest_rank_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                             probs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Per group, the element at 0-based index ``floor(n * p)`` of the values
    sorted ascending (sort-then-index percentile) for each named p. NULL
    values are ignored."""
    cum = running_counts(df.where(F.col(value_col).isNotNull()), group_cols, value_col, partitions=partitions)
    return cum.groupBy(*group_cols).agg(
        *[_at(F.floor(F.col("__n") * F.lit(p)), value_col).alias(name) for name, p in probs.items()])


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Per group, the linearly interpolated quantile (SQL ``percentile`` /
    ``quantile_cont``) for each named p, computed exactly from running counts
    instead of one in-memory value map per group. NULL values are ignored.
    With no group columns the whole frame is one group (one output row)."""
    if not group_cols:
        one = exact_quantiles(df.withColumn("__g", F.lit(0)), ["__g"], value_col, probs, partitions)
        return one.drop("__g")
    cum = running_counts(df.where(F.col(value_col).isNotNull()), group_cols, value_col, partitions=partitions)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(p)
        aggs += [_at(F.floor(pos), value_col).alias(f"__{name}_lo"), _at(F.ceil(pos), value_col).alias(f"__{name}_hi"),
                 F.first(pos - F.floor(pos)).alias(f"__{name}_frac")]
    outs = []
    for name in probs:
        lo, hi, fr = F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), F.col(f"__{name}_frac")
        outs.append((lo.cast("double") + fr * (hi.cast("double") - lo.cast("double"))).alias(name))
    return cum.groupBy(*group_cols).agg(*aggs).select(*group_cols, *outs)


def quantiles_of_columns(df: DataFrame, wanted: dict[str, dict[str, float]], partitions: int | None = None) -> DataFrame:
    """One row with the interpolated quantiles of several numeric columns of the
    whole frame: ``wanted[column][name] = p`` gives the column ``name``. All
    columns share one pass and one range shuffle: their rows become (column,
    value) pairs, counted before the shuffle, and each column is a group. NULL
    values are ignored; a column without values gives NULL."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__value")) for c in wanted]))
    long = df.select(pairs.alias("__pair")).select("__pair.*").where("__value is not null")
    cum = running_counts(long, ["__column"], "__value", partitions=partitions)
    aggs, outs = [], []
    for c, probs in wanted.items():
        mine = F.col("__column") == c
        for name, p in probs.items():
            pos = (F.col("__n") - 1) * F.lit(p)
            for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
                hit = mine & (F.col("__cum") - F.col("__c") <= at) & (at < F.col("__cum"))
                aggs.append(F.min(F.when(hit, F.col("__value"))).alias(f"__{name}_{end}"))
            aggs.append(F.max(F.when(mine, pos - F.floor(pos))).alias(f"__{name}_part"))
            lo, hi, part = (F.col(f"__{name}_{x}") for x in ("lo", "hi", "part"))
            outs.append((lo + part * (hi - lo)).alias(name))
    return cum.agg(*aggs).select(*outs)
