"""Shared parts of the exact set-similarity joins: prefix entries by bin, key filters, cutting of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import give_back, group_edges, mix, spread

#: An entry of the prefix index: a token (what its bin leaves of it) and a set that holds it in its prefix.
ENTRY = np.dtype([("cls", "<i8"), ("token", "<u4"), ("size", "<u4"), ("place", "<u2")])
#: The same with a bitmap of the rarer half of the set's tokens, for sets of up to some hundred tokens.
MAP_BITS = 256
#: Sets of up to so many tokens are mapped whole: half of them would say next to nothing.
WHOLE_MAPPED = 8
MAPPED = np.dtype([*ENTRY.descr, ("map", "<u8", (MAP_BITS // 64,))])
#: Sets of one token that are held against each other by bitmap at once; larger runs are cut and compared later.
MOST_PAIRED = 20_000
PAIRS = 1 << 18
BUNDLE = "bin int, data binary"
#: Bytes of entries that a bin should hold and at most holds in memory.
BIN_BYTES = 8 << 20
MOST_BYTES = 64 << 20
#: Words (64 bits) of a key filter; its size is fixed.
FILTER_WORDS = 1 << 18


def threshold_overlap(a, b, percent: int = 75):
    """The least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size, percent: int = 75):
    """Sets that reach the similarity share one of so many first tokens, in any one order of all tokens."""
    return size - -(-percent * size // 100) + 1


def bundled(tokens: np.ndarray, owner: np.ndarray, place: np.ndarray, cls: np.ndarray, size: np.ndarray, bins: int, maps: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries by bin of their token, one row for each bin met; ``owner`` says which set each token and place is of."""
    kind = ENTRY if maps is None else MAPPED
    number = (tokens % np.uint64(bins)).astype(np.uint16 if bins <= 1 << 16 else np.int32)  # short numbers are sorted by radix
    order = np.argsort(number, kind="stable")
    tokens, owner, number = tokens[order], owner[order], number[order]
    columns = {"cls": cls[owner], "token": tokens >> np.uint64(32), "size": size[owner], "place": np.minimum(place[order], 65_535)}
    if maps is not None:
        columns["map"] = maps[owner]
    data = [(memoryview(columns[name].astype(kind[name].base, copy=False).tobytes()), kind[name].itemsize) for name in kind.names]
    edges = group_edges(number).tolist()
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(b"".join(held[a * width : b * width] for held, width in data)) for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["bin", "data"])


def unbundled(data: bytes, kind: np.dtype) -> dict[str, np.ndarray]:
    """The columns of a bundle's entries."""
    n = len(data) // kind.itemsize
    out, at = {}, 0
    for name in kind.names:
        field = kind[name]
        out[name] = np.frombuffer(data, field.base, n * int(np.prod(field.shape)), at).reshape(n, *field.shape)
        at += n * field.itemsize
    return out


def mapped_length(size):
    """How many first tokens of a set its small bitmap holds: all of a small set, else the rarer half."""
    return np.where(size <= WHOLE_MAPPED, size, (size + 1) // 2)


def mapped_overlap(a, b, need):
    """The least overlap of the mapped tokens of sets of sizes a and b that share ``need`` tokens.

    The mapped tokens of one of the two end first in the order of all tokens. Those of them
    that the other set holds at all are mapped there too, and at most ``size - need`` are not held.
    """
    return np.minimum(mapped_length(a) - a, mapped_length(b) - b) + need


def small_maps(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bitmap of MAP_BITS for the first half of each set of consecutive tokens, which are in the order of all tokens."""
    length = mapped_length(size)
    owner = np.repeat(np.arange(len(first)), length)
    index = np.arange(len(owner)) + np.repeat(first - (np.cumsum(length) - length), length)
    place = (mix(tokens[index] + np.uint64(1)) % np.uint64(MAP_BITS)).astype(np.int64)
    out = np.zeros((len(first), MAP_BITS // 64), np.uint64)
    np.bitwise_or.at(out, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def shared_entries(batches, other, percent: int = 75, kind: np.dtype = ENTRY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From bundles sorted by bin: (run, cls) of all sets that share a prefix token with a set of fitting size.

    Tokens with the same sets give one run (named by a hash of the sets). Entries with
    bitmaps are held against each other at once and give edges of a forest, (other cls, cls),
    over the pairs that can be similar. A bin beyond what memory takes is passed on by token,
    unfiltered. Rows of negative bins, which come first, go to ``other`` with their bin.
    """
    held, size, current = [], 0, None
    unpacker = zstandard.ZstdDecompressor()

    def close(whole: bool):
        nonlocal held, size
        if held:
            entries = {name: np.concatenate([e[name] for e in held]) for name in kind.names}
            found = _shared(entries, percent) if whole else (_token_names(current, entries["token"]), entries["cls"])
            if len(found[0]):
                yield found
        held, size = [], 0

    whole = True
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number < 0:
                yield from other(number, data)
                continue
            if number != current:
                yield from close(whole)
                current, whole = number, True
            elif size >= MOST_BYTES:
                whole = False
                yield from close(whole)
            data = unpacker.decompress(data)
            held.append(unbundled(data, kind))
            size += len(data)
    yield from close(whole)
    give_back()


def _token_names(number: int, tokens: np.ndarray) -> np.ndarray:
    return mix(tokens.astype(np.uint64) + (np.uint64(number) << np.uint64(32))).view(np.int64)


def _shared(entries: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Narrow columns decide which entries stay; only of these the others are taken."""
    name = entries["token"].astype(np.uint64) << np.uint64(32) | entries["size"]
    order = np.argsort(name)
    name = name[order]
    size = (name & np.uint64(0xFFFFFFFF)).astype(np.int64)
    token = name >> np.uint64(32)
    same = token[1:] == token[:-1]
    # sizes are sorted within a token: a set without a neighbour of fitting size has no partner there
    fits = same & (100 * size[:-1] >= percent * size[1:])
    near = np.zeros(len(order), bool)
    near[1:] |= fits
    near[:-1] |= fits
    order, token, size = order[near], token[near], size[near]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs of one token and neighbouring sizes
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
    run = np.cumsum(new) - 1
    rest = size - entries["place"][order]
    fit = _positional(run, size, rest, percent)
    order, run, size, rest = order[fit], run[fit], size[fit], rest[fit]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = entries["cls"][order]
    if "map" in entries:
        x, y = _mapped(run, size, rest, entries["map"][order], percent)
        pairs = np.unique(np.stack([cls[x], cls[y]]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]
    order = np.lexsort((cls, run))
    run, cls = run[order], cls[order]
    once = np.ones(len(run), bool)
    once[1:] = (run[1:] != run[:-1]) | (cls[1:] != cls[:-1])
    run, cls = run[once], cls[once]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    count = np.diff(np.append(starts, len(run)))
    run = np.repeat(np.arange(len(starts)), count)
    name = mix(np.add.reduceat(mix(cls.view(np.uint64)), starts) + count.astype(np.uint64))
    first = np.zeros(len(name), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = (first & (count > 1))[run]
    return name[run][keep].view(np.int64), cls[keep]


def _positional(run: np.ndarray, size: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Positional filter: entries whose rest (words from the shared one on) can hold the overlap with some other of the run.

    Exact for runs of two; in longer runs the largest rest and the smallest fitting size stand for the others.
    """
    count = np.bincount(run)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    most = np.maximum.reduceat(rest, starts)[run]
    least = np.maximum(np.minimum.reduceat(size, starts)[run], -(-percent * size // 100))
    able = np.minimum(rest, most) >= threshold_overlap(size, least, percent)
    two = starts[count == 2]
    both = np.minimum(rest[two], rest[two + 1]) >= threshold_overlap(size[two], size[two + 1], percent)
    able[two], able[two + 1] = both, both
    return able


def _mapped(run: np.ndarray, size: np.ndarray, rest: np.ndarray, maps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over the entries that by size, place and bitmap can be similar.

    Entries of a run beyond MOST_PAIRED are joined to its first one unseen.
    """
    n = len(run)
    edges = group_edges(run)
    long = np.repeat(np.diff(edges) > MOST_PAIRED, np.diff(edges))
    head = np.repeat(edges[:-1], np.diff(edges))
    found = [(head[long], np.flatnonzero(long))]
    name = run.astype(np.int64) << 32  # sorted by run and size: the last partner of a fitting size
    last = np.searchsorted(name + size, name + 100 * size // percent, side="right")
    count = np.where(long, 0, last - np.arange(n) - 1)
    extra = mapped_length(size) - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    label = np.arange(n)
    ends = np.cumsum(count)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        c = count[start:stop]
        x = np.repeat(np.arange(start, stop), c)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        need = threshold_overlap(size[x], size[y], percent)
        fit = np.minimum(rest[x], rest[y]) >= need
        x, y, need = x[fit], y[fit], need[fit]
        common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1).astype(np.int64)
        fit = common + np.minimum(extra[x], extra[y]) >= mapped_overlap(size[x], size[y], need)
        x, y = x[fit], y[fit]
        while True:  # the least entry that each is joined to
            least = np.minimum(label[x], label[y])
            if (least == label[x]).all() and (least == label[y]).all():
                break
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
        met = np.unique(np.concatenate((x, y)))
        met = met[label[met] != met]
        found.append((label[met], met))
        start = stop
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit set of fixed size (2 MiB) that holds every key; others pass by chance, so joins still decide."""
    key = F.col(column)
    word, bit = F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    found = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[np.asarray(found["word"])] = np.asarray(found["bits"])
    return bits.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    word = (keys >> 6) % FILTER_WORDS
    return (bits[word] >> (keys % 64).astype(np.uint64)) & np.uint64(1) > 0


def filtered(df: DataFrame, column: str, bits: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows whose key may be in the filter, or (``keep`` false) those whose key is not.

    Only keys go through Python; texts and other columns stay where they are.
    """
    held = df.sparkSession.sparkContext.broadcast(bits)

    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, keys.to_numpy()) == keep)

    return df.where(F.pandas_udf(test, "boolean")(F.col(column)))


def dealt(groups: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Adds ``a``, ``b``: every two rows of a key meet in a group (key, a, b) of about ``2 * most`` rows at most.

    Keys with up to ``most`` rows stay one group. A larger one is cut in parts by hash and
    each row goes to all groups of its part, so no key fills a task.
    """
    large = groups.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_parts")).where("_parts > 1")
    rows = groups.join(large, F.col(key) == F.col("_key"), "left")
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64(member), parts).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("a", F.least("_own", "_other")).withColumn("b", F.greatest("_own", "_other")).drop("_key", "_parts", "_own", "_other")


def grouped(groups: DataFrame, key: str) -> DataFrame:
    """Rows of a group next to each other in one task."""
    return spread(groups, key, "a", "b").sortWithinPartitions(key, "a", "b")
