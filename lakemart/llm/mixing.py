"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakemart.llm.common import Words, free_names, rebatched, stored, text_key

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows that one task rounds at a time, and groups whose leftovers meet in one task of the next level.
CHUNK_ROWS = 50_000
FAN_IN = 1_000

ROUNDED = "source string, chunk long, row long, id long, size long, copies long, share double, level int"
ROUNDED_NAMES = [part.split()[0] for part in ROUNDED.split(", ")]


def source_sizes(rows: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``n_rows`` and ``place`` (0, 1, 2 … by code point, null last).

    The order is found by range partitions and row numbers inside them, so no task sees all sources.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranged = sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    before, total = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):
        before[part] = total
        total += count
    if not before:
        return inside.select("source", "source_size", "n_rows", F.lit(0).cast("long").alias("place"))
    offset = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))[F.col("part").cast("long")]
    return inside.select("source", "source_size", "n_rows", (offset + F.col("rank") - 1).alias("place"))


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target``: shares of the total by weight, none above ``most`` times its size.

    The excess of a capped source goes to the others by weight until none is above. The
    level (target of weight 1) rises from round to round; each round is one aggregate.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most)), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        free, taken, count = sources.agg(
            F.sum(F.when(~over, F.col("weight"))), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(over.cast("long")), F.lit(0))
        ).first()
        if not free or count == capped:
            break
        capped, level = count, (total - taken) / free
    target = F.when(F.col("most") <= F.col("weight") * F.lit(level), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def pivotal(sizes: list[int], shares: list[float], rng: random.Random) -> tuple[list[int], int | None, float]:
    """Round shares to 0 or 1 so that the sum of size times share is kept.

    Of two fractional entries mass moves from one to the other, in a random direction that
    keeps the expectation of both, until one is 0 or 1. Returns the rounded entries, the
    index of the one left fractional (or None) and its share.
    """
    out = [0] * len(sizes)
    held: int | None = None
    p = 0.0
    for j, (b, q) in enumerate(zip(sizes, shares)):
        if q <= 0 or b <= 0:
            continue
        if q >= 1:
            out[j] = 1
            continue
        if held is None:
            held, p = j, q
            continue
        a = sizes[held]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if rng.random() * (up + down) < down:  # towards the held entry
            if (1 - p) * a <= q * b:
                out[held], held, p = 1, j, q - up / b
            else:
                p += up / a
        elif p * a <= (1 - q) * b:
            held, p = j, q + down / b
        else:
            out[j], p = 1, p - down / a
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[held], held, p = int(p > 0.5), None, 0.0
    return out, held, p


def _rng(*parts) -> random.Random:
    return random.Random(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest())


def round_level(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Round the shares of every (source, chunk); at the last level also the one left over."""

    def group(key, table):
        rng = _rng(seed, level, key[0].as_py(), key[1].as_py())
        table = table.sort_by([("row", "ascending"), ("id", "ascending"), ("size", "ascending")])
        out, held, p = pivotal(table["size"].to_pylist(), table["share"].to_pylist(), rng)
        if held is not None and last:
            out[held], held = int(rng.random() < p), None
        share = np.zeros(table.num_rows)
        if held is not None:
            share[held] = p
        copies = np.asarray(table["copies"]) + np.asarray(out, np.int64)
        columns = [*(table[c] for c in ("source", "chunk", "row", "id", "size")), copies, share, np.full(table.num_rows, level, np.int32)]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=ROUNDED_NAMES)

    return rows.groupBy("source", "chunk").applyInArrow(group, ROUNDED)


def _sizes(batches):
    for batch in rebatched(batches):
        size = Words(batch.column(1)).count.astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array(size)], ["source", "row", "id", "size"])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row: id, ``row`` (hash that tells texts apart), size, source_size, target, copies, taken.

    A row's size is its number of words (null text: 0). Every row of a source gets
    target / source_size copies: the whole part at once, the fraction by pivotal rounding
    that keeps the words of the source. Rows are dealt to chunks by hash, each chunk leaves
    at most one fractional row, and the leftovers of ``fan_in`` chunks meet in one group of
    the next level until one is left, which is drawn. So a source misses its target by less
    than its longest row. Rounding depends on ids, sizes, texts and the seed only, so reruns
    agree; equal rows are interchangeable. Null sources are a source of their own, listed
    last; rows of size 0 take no words; an empty table gives no rows.
    """
    found = _mixed(docs, weights, most, seed, id_column, text_column, source_column, chunk_rows, fan_in)
    return found.drop("source")


def _mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.col(source_column).alias("source"), text_key(F.col(text_column)).alias("row")
    )
    rows = stored(rows.mapInArrow(_sizes, "source string, row long, id long, size long"), "sizes")
    sources = stored(with_targets(source_sizes(rows), weights, most), "targets")
    largest = sources.agg(F.max("n_rows")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(share), F.lit(most))
    count = F.ceil(F.col("n_rows") / chunk_rows)
    chunk = F.pmod(F.xxhash64("row", "id", F.lit(seed)), count)
    s = sources.select(F.col("source").alias("name"), "source_size", "n_rows", "target")
    dealt = rows.join(s, F.col("source").eqNullSafe(F.col("name"))).select(
        "source", chunk.cast("long").alias("chunk"), "row", "id", "size", whole.cast("long").alias("copies"), (share - whole).alias("share"), F.lit(0).alias("level")
    )
    levels = _levels(largest, chunk_rows, fan_in)
    settled, current = [], dealt
    for level in range(levels):
        current = stored(round_level(current, level, seed, level == levels - 1), f"level{level}")
        settled.append(current.where("share = 0"))
        current = current.where("share > 0").withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
    result = settled[0]
    for more in settled[1:]:
        result = result.union(more)
    out = result.join(s, F.col("source").eqNullSafe(F.col("name")))
    return out.select(
        F.col("id").alias(id_column), "row", "size", "source_size", "target", "copies", "source", (F.col("copies") * F.col("size")).alias("taken")
    )


def _levels(rows: int, chunk_rows: int, fan_in: int) -> int:
    groups, levels = max(1, math.ceil(rows / chunk_rows)), 1
    while groups > 1:
        groups, levels = math.ceil(groups / fan_in), levels + 1
    return levels


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies``; those it leaves out are gone.

    Rows are told apart by id, text and source; of rows equal in these, as many are left
    with as many copies as the mix gives them. A column ``copies`` of the documents is
    replaced. Null ids, texts and sources as in ``mix``; an empty table gives no rows.
    """
    docs = docs.drop("copies")
    own_id, own_row, own_source, key, number, place = free_names(docs.withColumn("copies", F.lit(0)), "_id", "_row", "_source", "_key", "_number", "_place")
    found = _mixed(docs, **options).select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("source").alias(own_source), "copies")
    found = found.withColumn(number, F.row_number().over(Window.partitionBy(own_id, own_row, own_source).orderBy(F.desc("copies"))))
    found = found.where("copies > 0")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    keyed = keyed.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", key, "source").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_row)) & F.col("source").eqNullSafe(F.col(own_source))
    return keyed.join(found, same & (F.col(place) == F.col(number))).select(*docs.columns, "copies")
