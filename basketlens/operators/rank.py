"""Exact quantiles and tie-stable n-tiles without sorting the data in one task.

One way for every size. Quantiles are selected: a few passes count the leading bits of the values, then the next bits of those
that lie where a wanted rank does, until all bits are known. No value is sorted, sent to another task or gathered.

Where every row needs its rank (n-tiles, splits), the rows of an order are range-partitioned into slices, sorted inside
their slice and written once. What precedes a slice is the sum over the slices before it, so a
rank or running count is that sum plus the row's place in its own slice. Only one row per
(group, slice) is ever summed in one place, and ties are split by the key that completes the
order. Nothing is approximate, sampled or collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import join_on_keys


def running(df: DataFrame, ids: Sequence[str], order: Sequence[str], amount: Column, slices: int | None = None) -> DataFrame:
    """``df`` with ``cum``, the sum of ``amount`` up to and with the row, and ``n``, that of its group.

    ``order`` must tell the rows of a group apart. ``slices`` is left to adaptive execution unless
    given.
    """
    ids, keys = list(ids), [*map(F.col, ids), *map(F.col, order)]
    spread = df.withColumn("__amount", amount)
    spread = spread.repartitionByRange(slices, *keys) if slices else spread.repartitionByRange(*keys)
    parts = written(spread.withColumn("__slice", F.spark_partition_id()))
    inside = W.partitionBy(*ids, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = parts.withColumn("__local", F.sum("__amount").over(inside))
    totals = parts.groupBy(*ids, "__slice").agg(F.sum("__amount").alias("__sum"))
    group = W.partitionBy(*ids)
    before = group.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *ids, "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
        F.sum("__sum").over(group).alias("n"))
    placed = join_on_keys(local, offsets, [*ids, "__slice"])
    return placed.withColumn("cum", F.col("__local") + F.col("__before")).drop("__amount", "__slice", "__local", "__before")


# --------------------------------------------------------------------------- quantiles

_FRACTION = 1 << 52  # fixed values of the double format: fraction bits, exponent offset, exponent of infinity
_OFFSET, _TOP = 1023, 2047


def order_bits(x: Column) -> Column:
    """A long in the order of the double ``x``: its bits, negated below zero. Null and NaN have none; both zeros have 0."""
    a = F.abs(x)
    guess = F.greatest(F.floor(F.log2(a)).cast("double"), F.lit(1.0 - _OFFSET))
    power = lambda e: F.pow(F.lit(2.0), e)
    # the logarithm may be off by its last digit
    e = F.when(power(guess) > a, F.greatest(guess - 1, F.lit(1.0 - _OFFSET))).when(power(guess + 1) <= a, guess + 1).otherwise(guess)
    scaled = a / power(e)  # exact: in [1, 2), below 1 for the smallest numbers
    normal = scaled >= 1
    magnitude = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(_TOP * _FRACTION))
        .otherwise(
            F.when(normal, e + _OFFSET).otherwise(0).cast("long") * _FRACTION
            + ((scaled - F.when(normal, 1.0).otherwise(0.0)) * float(_FRACTION)).cast("long")))
    return F.when(~F.isnan(x), F.when(x < 0, -magnitude).otherwise(magnitude))


def from_order_bits(key: Column) -> Column:
    """The double that ``order_bits`` turned into ``key``."""
    e = F.shiftright(F.abs(key), 52)
    fraction = F.abs(key).bitwiseAND(_FRACTION - 1).cast("double") / float(_FRACTION)
    normal = e > 0
    power = F.pow(F.lit(2.0), F.when(normal, e - _OFFSET).otherwise(1 - _OFFSET).cast("double"))
    value = F.when(e == _TOP, F.lit(float("inf"))).otherwise((fraction + F.when(normal, 1.0).otherwise(0.0)) * power)
    return F.when(key < 0, -value).otherwise(value)


def with_order_bits(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its double ``column`` replaced by its ``order_bits``.

    The same numbers in steps: every part that several others need is a column of its own, so that a value takes one logarithm
    and two powers, and generated methods stay small enough to be compiled.
    """
    low, names = F.lit(1.0 - _OFFSET), [c for c in df.columns if c != column]
    x, a, guess, power, e, unit, scaled = (F.col(f"__{n}") for n in ("x", "a", "guess", "power", "e", "unit", "scaled"))
    steps = df.withColumnRenamed(column, "__x").withColumn("__a", F.abs(x))
    steps = steps.withColumn("__guess", F.greatest(F.floor(F.log2(a)).cast("double"), low))
    steps = steps.withColumn("__power", F.pow(F.lit(2.0), guess))
    # the logarithm may be off by its last digit
    steps = steps.withColumn(
        "__e", F.when(power > a, F.greatest(guess - 1, low)).when(power * 2 <= a, guess + 1).otherwise(guess))
    steps = steps.withColumn("__unit", F.pow(F.lit(2.0), e)).withColumn("__scaled", a / unit)
    normal = scaled >= 1
    magnitude = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(_TOP * _FRACTION))
        .when(
            ~F.isnan(a),
            F.when(normal, e + _OFFSET).otherwise(0).cast("long") * _FRACTION
            + ((scaled - F.when(normal, 1.0).otherwise(0.0)) * float(_FRACTION)).cast("long")))
    steps = steps.withColumn("__magnitude", magnitude)
    signed = F.when(x < 0, -F.col("__magnitude")).otherwise(F.col("__magnitude"))
    return steps.select(*[F.col(f"`{c}`") for c in names], signed.alias(column))


def select_ranks(rows: DataFrame, ids: Sequence[str], key: str, wants: Column, bits: int = 22) -> DataFrame:
    """``ids..., key, wants``: the long at wanted ranks of each group, by radix selection.

    ``wants`` is an array of structs with a rank ``r`` (from 1), formed from ``n``, the number of keys of the group. Each pass
    counts the next ``bits`` bits of the keys that share all higher ones with a wanted key, which tells those bits of the wanted
    ones. Rows are only counted where they lie: what is shuffled is at most 2 ** bits counts a task, group and wanted prefix.
    A wanted key that is the least or the greatest of those that share its bits is known at once; passes end when all are, so
    that small groups and few different values take one. ``rows`` is read once a pass. Null keys are not counted; a group
    without keys has a null one for all its ranks.
    """
    ids, state, upper, found = list(ids), None, None, []
    before, cnt, lo, hi = (F.col(f"__{c}") for c in ("before", "cnt", "lo", "hi"))
    for shift in [*range(64 - bits, 0, -bits), 0]:
        cell = F.shiftright(F.col(key), shift).alias("__cell")
        counted = [F.count(key).alias("__cnt"), F.min(key).alias("__lo"), F.max(key).alias("__hi")]
        if state is None:
            cells = rows.groupBy(*ids, cell).agg(*counted).withColumn("n", F.sum("__cnt").over(W.partitionBy(*ids)))
            cells, inside = cells.withColumn("wants", wants), ids
        else:
            prefixed = rows.withColumn("__prefix", F.shiftright(F.col(key), upper))
            inside = [*ids, "__prefix"]
            # the wants join the counts, not the rows: an aggregate over an array would have to sort them
            mine = join_on_keys(prefixed, state.select(*inside), inside).groupBy(*inside, cell).agg(*counted)
            cells = join_on_keys(mine, state, inside)
        cum = F.sum("__cnt").over(W.partitionBy(*inside).orderBy("__cell"))
        cells = cells.withColumn("__before", cum - F.col("__cnt"))
        # a null cell counts nothing; it holds the ranks of groups that have no key, none of which is above 0
        here = F.filter("wants", lambda w: (w["r"] <= before + cnt) & ((w["r"] > before) | F.col("__cell").isNull()))
        held = cells.withColumn("wants", F.transform(here, lambda w: w.withField("r", w["r"] - before))).where(F.size("wants") > 0)
        held = written(held.select(*ids, "__cell", "__cnt", "__lo", "__hi", "wants"))
        least = lambda w: (w["r"] <= 1) | lo.eqNullSafe(hi)
        most = lambda w: ~least(w) & (w["r"] == cnt)
        ends = [F.struct(k.alias(key), F.filter("wants", f).alias("wants")) for k, f in ((lo, least), (hi, most))]
        found.append(held.select(*ids, F.inline(F.array(*ends))).where(F.size("wants") > 0))
        rest = F.filter("wants", lambda w: ~least(w) & ~most(w))
        state = held.select(*ids, F.col("__cell").alias("__prefix"), rest.alias("wants")).where(F.size("wants") > 0)
        upper = shift
        if shift and state.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _selected(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], bits: int) -> DataFrame:
    """``by..., __variable, value, p, end, weight``: for every quantile the values at the two ranks around it."""
    by = list(by)
    cells = [F.struct(F.lit(i).alias("__variable"), F.col(c).cast("double").alias("__key")) for i, c in enumerate(columns)]
    rows = written(with_order_bits(df.select(*by, F.inline(F.array(*cells))), "__key"))

    def want(p: float) -> list[Column]:
        position = (F.col("n") - 1) * F.lit(p)
        first = F.floor(position + 1e-9) + 1
        weight = F.greatest(position - (first - 1), F.lit(0.0))
        ends = (first, F.least(first + 1, F.col("n")))
        # one of nothing is rank 0
        return [F.struct(
            F.least(r, F.col("n")).cast("long").alias("r"), F.lit(p).alias("p"), F.lit(i).alias("end"), weight.alias("weight"),
        ) for i, r in enumerate(ends)]

    wants = F.array(*[w for p in dict.fromkeys(map(float, probs)) for w in want(p)])
    ids = [*by, "__variable"]
    found = select_ranks(rows, ids, "__key", wants, bits).withColumn("value", from_order_bits(F.col("__key")))
    return found.select(*ids, "value", F.inline("wants"))


def _between(where: Column | None = None) -> Column:
    """The quantile that the selected values ``where`` a condition holds lie around, as an aggregate."""
    def only(c: str, end: int | None = None) -> Column:
        conditions = [x for x in (where, None if end is None else F.col("end") == end) if x is not None]
        return F.max(F.when(reduce(Column.__and__, conditions), F.col(c)) if conditions else F.col(c))

    lo, hi, weight = only("value", 0), only("value", 1), only("weight")
    return F.when((lo == hi) | (weight < 1e-9), lo).otherwise((1 - weight) * lo + weight * hi)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), bits: int = 22,
) -> DataFrame:
    """Linear-interpolation quantiles: ``by..., Variable, p, value``. Null and NaN are ignored.

    The values' bits are written once, a row each, and the wanted ranks selected from them ``bits`` bits a pass. A group
    without values has nulls.
    """
    by = list(by)
    picked = _selected(df, columns, probs, by, bits).groupBy(*by, "__variable", "p").agg(_between().alias("value"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("__variable") + 1)
    return picked.select(*by, name.alias("Variable"), "p", "value")


def quantile_columns(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = (),
) -> DataFrame:
    """One row per group with a column per wanted ``name -> (column, probability)``."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    # straight from the selected values: one grouping, also where there are many groups
    return _selected(df, columns, probs, by, 22).groupBy(*by).agg(*[
        _between((F.col("__variable") == columns.index(c)) & (F.col("p") == float(p))).alias(name)
        for name, (c, p) in wanted.items()
    ])


def summarise(
    df: DataFrame,
    aggregates: Sequence[Column],
    quantiles: Mapping[str, str | tuple[str, float]] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Plain aggregates plus exact quantiles, one row per group.

    ``quantiles`` maps an output name to a column (its median) or a (column, probability) pair.
    """
    wanted = {k: (v, 0.5) if isinstance(v, str) else v for k, v in (quantiles or {}).items()}
    if not wanted:
        return df.groupBy(*by).agg(*aggregates)
    wide = quantile_columns(df, wanted, by)
    return join_on_keys(df.groupBy(*by).agg(*aggregates), wide, by, "left") if aggregates else wide


# --------------------------------------------------------------------------- n-tiles


@dataclass(frozen=True)
class NTile:
    """Score ``out`` 1..buckets by ``value`` ascending (or descending) within ``by``."""

    out: str
    value: str
    descending: bool = False
    by: tuple[str, ...] = ()
    buckets: int = 5


def add_ntiles(df: DataFrame, specs: Sequence[NTile], tie: str, slices: int | None = None) -> DataFrame:
    """Add n-tile scores; ties are ordered by the unique key ``tie``; null values score null.

    A spec may group by the score of an earlier one; specs that do not are scored in one pass.
    """
    level: list[NTile] = []
    for spec in specs:
        if level and (spec.by != level[0].by or {s.out for s in level} & set(spec.by)):
            df, level = _add_level(df, level, tie, slices), []
        level.append(spec)
    return _add_level(df, level, tie, slices) if level else df


def _add_level(df: DataFrame, specs: Sequence[NTile], tie: str, slices: int | None) -> DataFrame:
    by = list(specs[0].by)
    cells = [
        F.struct(F.lit(i).alias("__spec"), (-F.col(s.value) if s.descending else F.col(s.value)).alias("__x"))
        for i, s in enumerate(specs)
    ]
    rows = df.select(*by, tie, F.inline(F.array(*cells))).where("__x is not null")
    ranked = running(rows, [*by, "__spec"], ["__x", tie], F.lit(1), slices)
    buckets = F.element_at(F.array(*[F.lit(s.buckets) for s in specs]), F.col("__spec") + 1)
    size, larger = F.floor(F.col("n") / buckets), F.col("n") % buckets
    edge = larger * (size + 1)  # the first n % buckets tiles hold one more
    tile = F.when(F.col("cum") <= edge, F.ceil(F.col("cum") / (size + 1))).otherwise(
        larger + F.ceil((F.col("cum") - edge) / F.greatest(size, F.lit(1))))
    scores = ranked.withColumn("__tile", tile.cast("int")).groupBy(tie).agg(*[
        F.max(F.when(F.col("__spec") == i, F.col("__tile"))).alias(s.out) for i, s in enumerate(specs)
    ])
    kept = df.drop(*[s.out for s in specs])
    return join_on_keys(kept, scores, [tie], "left")


def lowest_share(df: DataFrame, by: str, order: Sequence[str], share: float, out: str, slices: int | None = None) -> DataFrame:
    """``df`` with ``out``: whether the row is among the ceil(share * n) lowest of its group."""
    ranked = running(df, [by], order, F.lit(1), slices)
    return ranked.withColumn(out, F.col("cum") <= F.ceil(F.col("n") * F.lit(share))).drop("cum", "n")
