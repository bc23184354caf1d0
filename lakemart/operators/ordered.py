"""Neighbours, running totals, positions and counts inside a key, whatever the size of the key.

A window over a key puts all its rows into one task. Here rows are first cut into slices
of about equal size along (key, time, ties), as a range partitioning does, so a slice
holds many small keys, or a part of a large one, or of its rows of one time. Windows run
per (slice, key) after one shuffle by slice. Only the two keys at a slice's edges go on
in another slice. Their rows are summed up per slice, before any shuffle; the summaries
are scanned along the slices, and each slice gets what lies before or behind it.

The plan is the same for all sizes and keys. Slices are as many as the session's shuffle
partitions; cuts and summaries are a row or two per slice. Cuts come from a sample of
the ordering columns, which steers the sizes of slices only: results are exact. They meet
the rows as a broadcast row: as constants they would stand in every step of every plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE, PLACED, CUTS, NUMBER = "_slice", "_placed", "_cuts", "_dealt_as"
SAMPLED = 32  # rows a slice


@dataclass(frozen=True)
class OrderedRows:
    """Rows of each key in the order of ``time``, then ``ties``; NULL times come last."""

    df: DataFrame
    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    #: of these the rows of the cut keys before they are shuffled, while none has gone; summaries are taken from here
    flat: DataFrame | None = None

    def with_df(self, df: DataFrame) -> OrderedRows:
        return OrderedRows(df, self.keys, self.time, self.ties)

    def with_column(self, df: DataFrame) -> OrderedRows:
        """The same rows with more columns."""
        return OrderedRows(df, self.keys, self.time, self.ties, self.flat)

    def where(self, condition: Column) -> OrderedRows:
        return self.with_df(self.df.where(condition))

    def part(self):
        return Window.partitionBy(SLICE, *self.keys)

    def window(self):
        order = [F.col(self.time).asc_nulls_last(), *[F.col(t).asc_nulls_first() for t in self.ties]]
        return self.part().orderBy(*order)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE, PLACED)


def _plain(df: DataFrame, name: str) -> Column:
    """A value of the same order that JSON holds unchanged."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), column)
    return column


def _place(df: DataFrame, keys: tuple[str, ...], time: Column, rest: list[Column]) -> Column:
    """Orders rows as the windows do: by key, then time with NULLs last, then the rest."""
    key = F.struct(*[_plain(df, k).alias(f"k{i}") for i, k in enumerate(keys)])
    moment = F.struct(key.alias("key"), time.isNull().alias("none"), time.alias("at"))
    return F.struct(moment.alias("moment"), *[c.alias(f"r{i}") for i, c in enumerate(rest)])


def _cuts(probe: DataFrame, place: Column, slices: int) -> DataFrame:
    """The places at which a slice begins, in order, as one array in one row, fixed here.

    Beside each place: the first cut at the same place, at the same key and at the same
    key and time. A place that holds many rows is cut several times.
    """
    rows = probe.select(place.alias("place"))
    n = rows.count()
    share = min(1.0, SAMPLED * slices / max(n, 1))
    taken = rows.where(F.rand(7) < share).agg(F.sort_array(F.collect_list("place")).alias("all"))
    at = F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.floor(i * F.size("all") / slices).cast("int"))
    some = taken.where(F.size("all") > 0).select(F.posexplode(F.transform(at, lambda i: F.get("all", i))).alias("i", "place"))
    along = Window.partitionBy(F.lit(0)).orderBy("i")  # a row per slice

    def first(value: Column) -> Column:
        begins = F.when(F.col("i") == 0, True).otherwise(~value.eqNullSafe(F.lag(value).over(along)))
        return F.max(F.when(begins, F.col("i"))).over(along)

    same = {"place": F.col("place"), "key": F.col("place.moment.key"), "moment": F.col("place.moment")}
    found = some.select("i", "place", *[first(value).alias(f"first_{name}") for name, value in same.items()])
    listed = found.agg(F.sort_array(F.collect_list(F.struct(*found.columns))).alias("cuts"))
    text = listed.select(F.to_json("cuts")).first()[0]
    fixed = probe.sparkSession.createDataFrame([(text,)], "text string")
    return fixed.select(F.from_json("text", listed.schema["cuts"].dataType).alias(CUTS))


def _placed(df: DataFrame, cuts: DataFrame, place: Column, slices: int) -> DataFrame:
    """Adds a struct. ``slice`` of the row; ``run``: the cut key it belongs to, by number of its first cut, where its
    slice's edge cuts its key; ``before`` and ``behind``: likewise where an edge cuts even its time.

    Each step of the binary search is a projection, so that all of it is compiled; a higher-order function is not.
    """
    p, at, listed = F.col("_place"), F.col("_upto"), F.col(CUTS)
    found = df if NUMBER in df.columns else df.withColumn(NUMBER, F.monotonically_increasing_id())
    found = found.crossJoin(F.broadcast(cuts)).withColumns({"_place": place, "_upto": F.lit(0)})
    for k in range(slices.bit_length() - 1, -1, -1):  # cuts at or before the place
        step = F.lit(1 << k)
        found = found.withColumn("_upto", F.when(F.get(listed, at + step - 1)["place"] <= p, at + step).otherwise(at))
    # Spark follows a join's key back and puts each projection into the one above, so a key that names the step before
    # three times grows by 3 to the number of steps; it goes back to a generator only
    found = found.withColumn("_upto", F.explode(F.array("_upto")))
    last = F.get(listed, at - 1)
    many = last["place"].eqNullSafe(p) & (last["first_place"] < at - 1)
    # rows of one place with several cuts are dealt over the slices between these
    dealt = last["first_place"] + F.pmod(NUMBER, at - last["first_place"] + 1).cast("int")
    found = found.withColumn(SLICE, F.when(many, dealt).otherwise(at))
    low, high = F.get(listed, F.col(SLICE) - 1), F.get(listed, F.col(SLICE))

    def cut(edge: Column, part: str) -> Column:
        mine, inside = (v["moment"]["key"] if part == "key" else v["moment"] for v in (edge["place"], p))
        return F.when(mine.eqNullSafe(inside) & edge.isNotNull(), edge[f"first_{part}"])

    edges = F.struct(
        F.coalesce(cut(low, "key"), cut(high, "key")).alias("run"),
        cut(low, "moment").alias("before"),
        cut(high, "moment").alias("behind"),
    )
    return found.withColumn(PLACED, edges).drop("_place", "_upto", CUTS, NUMBER)


def _slices_of(df: DataFrame, slices: int | None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _of_cut_keys(df: DataFrame, cuts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows whose key a cut falls into: no other has an edge. They keep the numbers by which equal places are dealt."""
    cut = cuts.select(F.explode(F.transform(CUTS, lambda c: c["place"]["moment"]["key"])).alias("_key")).select("_key.*")
    same = [_plain(df, k).eqNullSafe(cut[f"k{i}"]) for i, k in enumerate(keys)]
    return df.withColumn(NUMBER, F.monotonically_increasing_id()).join(F.broadcast(cut), reduce(and_, same), "left_semi")


def _dealt(cut: DataFrame, slices: int | None) -> DataFrame:
    return cut.repartitionById(max(2, _slices_of(cut, slices)), F.col(SLICE))


def ordered_rows(
    df: DataFrame,
    keys: str | list[str],
    time: str,
    ties: tuple[str, ...] = (),
    slices: int | None = None,
    probe: DataFrame | None = None,
) -> OrderedRows:
    """The frame ready for the windows below, cut into slices.

    The sample is taken from ``probe``, a cheaper frame with keys, time and ties, where one is given.
    """
    keys, ties = (keys,) if isinstance(keys, str) else tuple(keys), tuple(ties)
    places = [_place(f, keys, _plain(f, time), [_plain(f, t) for t in ties]) for f in (df, df if probe is None else probe)]
    n = max(2, _slices_of(df, slices))
    cuts = _cuts(df if probe is None else probe, places[1], n)
    edges = _placed(_of_cut_keys(df, cuts, keys), cuts, places[0], n)
    return OrderedRows(_dealt(_placed(df, cuts, places[0], n), slices), keys, time, ties, edges)


def with_group_size(df: DataFrame, keys: str | list[str], name: str) -> DataFrame:
    """Add the number of rows of the row's key; NULL keys form one group.

    Counts are partial in each task, so a hot key costs no more than any other there; in
    the join, adaptive execution splits the rows of a hot key over tasks.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).alias("c")
    same = reduce(and_, [F.col(f"r.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys])
    return df.alias("r").join(counts, same).select("r.*", f"c.`{name}`")


def _carried(rows: OrderedRows, summary: Column, carry, part: str = "run") -> DataFrame:
    """Summarise each slice's rows of an edge key and hand the result on along the slices of that key.

    ``_run``, ``_at``, ``_carry``: at most two rows per slice, whatever the rows. The
    summary is over the columns that the rows were cut with.
    """
    df = rows.df if rows.flat is None else rows.flat
    run = F.col(f"{PLACED}.{part}")
    along = Window.partitionBy("_run").orderBy("_at")
    return (
        df.where(run.isNotNull())
        .groupBy(run.alias("_run"), F.col(SLICE).alias("_at"))
        .agg(summary.alias("_summary"))
        .select("_run", "_at", carry(F.col("_summary"), along).alias("_carry"))
    )


def _join_carry(rows: OrderedRows, df: DataFrame, carried: DataFrame) -> DataFrame:
    same = (F.col(f"{PLACED}.run") == F.col("_run")) & (F.col(SLICE) == F.col("_at"))
    return df.join(F.broadcast(carried), same, "left").drop("_run", "_at")


def _order(rows: OrderedRows) -> Column:
    return F.struct(F.col(rows.time).isNull(), F.col(rows.time), *[F.col(t) for t in rows.ties])


def with_previous(rows: OrderedRows, columns: list[str], name: str = "_prev") -> OrderedRows:
    """Add a struct of the previous row's columns; NULL on the first row of a key."""
    packed = F.struct(*[F.col(c) for c in columns])
    last = _carried(rows, F.max_by(packed, _order(rows)), lambda s, w: F.lag(s).over(w))
    df = _join_carry(rows, rows.df.withColumn(name, F.lag(packed).over(rows.window())), last)
    return rows.with_column(df.withColumn(name, F.coalesce(name, "_carry")).drop("_carry"))


def with_next(rows: OrderedRows, name: str = "_next") -> OrderedRows:
    """Add the next row's time; NULL on the last row of a key."""
    first = _carried(rows, F.min_by(F.struct(rows.time), _order(rows)), lambda s, w: F.lead(s[rows.time]).over(w))
    df = rows.df.withColumn(name, F.lead(rows.time).over(rows.window()))
    df = _join_carry(rows, df.withColumn("_end", F.lead(F.lit(1)).over(rows.window()).isNull()), first)
    return rows.with_column(df.withColumn(name, F.when(F.col("_end"), F.col("_carry")).otherwise(F.col(name))).drop("_carry", "_end"))


def _with_sum_before(rows: OrderedRows, df: DataFrame, amount: Column, name: str) -> DataFrame:
    earlier = _carried(rows, amount, lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return _join_carry(rows, df, earlier).withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def _sums_elsewhere(rows: OrderedRows, amount: Column) -> DataFrame:
    """``_run``, ``_at``, ``_behind``, ``_sum``: what other slices add to the running total of an edge key's rows.

    That is the sum of the slices before and, for rows whose time goes on behind the slice, of the rows of this time there.
    The rows are summed up once for both, to a few rows per slice.
    """
    df = rows.df if rows.flat is None else rows.flat
    parts = (F.col(f"{PLACED}.run").alias("_run"), F.col(SLICE).alias("_at"), F.col(f"{PLACED}.before").alias("_before"), F.col(f"{PLACED}.behind").alias("_behind"))
    sums = df.where(F.col(f"{PLACED}.run").isNotNull()).groupBy(*parts).agg(F.sum(amount).alias("_own"))
    earlier = F.sum("_own").over(Window.partitionBy("_run").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    # each sum counts for the time at its slice's beginning, and is asked for the time at its slice's end
    none = F.lit(None).cast("int")
    given = F.struct(F.col("_before").alias("time"), none.alias("asks"), F.col("_own").alias("own"))
    asked = F.struct(F.col("_behind").alias("time"), F.col("_behind").alias("asks"), F.lit(None).alias("own"))
    both = sums.withColumn("_earlier", earlier).withColumn("_part", F.explode(F.array(given, asked)))
    later = F.sum("_part.own").over(Window.partitionBy("_part.time").orderBy("_at").rangeBetween(1, Window.unboundedFollowing))
    here = F.when(F.col("_part.asks").isNotNull(), later)
    return both.select("_run", "_at", "_behind", "_earlier", here.alias("_later")).groupBy("_run", "_at", "_behind").agg(
        (F.coalesce(F.max("_earlier"), F.lit(0)) + F.coalesce(F.max("_later"), F.lit(0))).alias("_sum")
    )


def with_running_total(rows: OrderedRows, amount: Column, name: str) -> OrderedRows:
    """Running sum up to the row, rows with an equal time sharing one value."""
    window = rows.part().orderBy(F.col(rows.time).asc_nulls_last())
    df = rows.df.withColumn(name, F.sum(amount).over(window))
    same = (F.col(f"{PLACED}.run") == F.col("_run")) & (F.col(SLICE) == F.col("_at")) & F.col(f"{PLACED}.behind").eqNullSafe(F.col("_behind"))
    df = df.join(F.broadcast(_sums_elsewhere(rows, amount)), same, "left")
    df = df.withColumn(name, F.col(name) + F.coalesce("_sum", F.lit(0)))
    return rows.with_column(df.drop("_run", "_at", "_behind", "_sum"))


def with_position(rows: OrderedRows, name: str) -> OrderedRows:
    """Position of the row in its key, from 1."""
    inside = rows.df.withColumn(name, F.row_number().over(rows.window()).cast("long"))
    return rows.with_column(_with_sum_before(rows, inside, F.count(F.lit(1)), name))


def with_counts(rows: OrderedRows, **conditions: Column) -> OrderedRows:
    """For each condition a struct: ``upto``, the key's rows that meet it up to the row, and ``total``, all of the key's that do."""
    # one order for both, so that rows are held once
    sofar, whole = (rows.window().rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    df = rows.df
    for name, met in conditions.items():
        df = df.withColumn(name, F.struct(F.count_if(met).over(sofar).alias("upto"), F.count_if(met).over(whole).alias("total")))

    def elsewhere(summary: Column, along) -> Column:
        before, every = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_run")
        both = [(n, F.sum(summary[n]).over(before), F.sum(summary[n]).over(every) - summary[n]) for n in conditions]
        return F.struct(*[F.struct(upto.alias("upto"), total.alias("total")).alias(n) for n, upto, total in both])

    df = _join_carry(rows, df, _carried(rows, F.struct(*[F.count_if(met).alias(n) for n, met in conditions.items()]), elsewhere))
    for name in conditions:
        sums = [(F.col(f"{name}.{part}") + F.coalesce(f"_carry.{name}.{part}", F.lit(0))).alias(part) for part in ("upto", "total")]
        df = df.withColumn(name, F.struct(*sums))
    return rows.with_column(df.drop("_carry"))
