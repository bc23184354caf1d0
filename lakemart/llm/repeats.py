"""Substring dedup: windows of words meet by minimiser, packed as super-k-mers.

Consecutive windows that share a minimiser travel as one packed string to the bucket of
that minimiser, where sorting their hashes (128 bits) finds equal windows. A word goes if
a window over it starts earlier in the corpus as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakemart.llm.common import Words, combine, group_edges, rebatched, spread, stored, text_key

WINDOW = 20
MINIMISER = 3
#: Bytes of text a task packs at a time, and bytes of packed strings that a bucket should hold.
PACK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
#: A bucket this many times the mean is split; its windows then meet once more by their hash.
HOT_TIMES = 4
#: Windows in one packed string at most (runs of one word repeated share a minimiser for ever).
LONGEST_RUN = 128
LAST_ID = (1 << 63) - 1

PACKED = "bin int, part int, ids binary, strings binary"
FOUND = "id long, row long, begin int, stop int, high long, low long"
_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def ordered_id(column: Column) -> Column:
    """Null ids come after all others."""
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_kmers(words: Words, window: int, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share one in a text."""
    none = np.zeros(0, np.int64)
    if len(words.begin) < window:
        return none, none, none.astype(np.uint64)
    least = sliding_min(combine(words.hash, minimiser), window - minimiser + 1)
    doc = words.doc
    valid = doc[: len(least)] == doc[window - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1] | (doc[1 : len(least)] != doc[: len(least) - 1])
    starts = np.flatnonzero(new)
    place = np.arange(len(least)) - np.repeat(starts, np.diff(np.append(starts, len(least))))
    starts = np.flatnonzero(valid & (place % LONGEST_RUN == 0))
    run = np.cumsum(valid & (place % LONGEST_RUN == 0))[valid] - 1
    return starts, np.bincount(run, minlength=len(starts)), least[starts]


def _packed_bytes(words: Words, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    return words.end[starts + counts + window - 2] - words.begin[starts]


def _bucket_sizes(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Bytes of packed strings by bucket, over all texts."""

    def sized(batches):
        total = np.zeros(buckets, np.int64)
        for batch in rebatched(batches, limit=PACK_BYTES):
            words = Words(batch.column(1))
            starts, counts, least = super_kmers(words, window)
            ids = np.asarray(batch.column(0))[words.doc[starts]]
            kept, _ = _first_in_batch(words, starts, counts, ids, np.asarray(batch.column(2))[words.doc[starts]], window)
            total += np.bincount((least[kept] % np.uint64(buckets)).astype(np.int64), weights=_packed_bytes(words, starts[kept], counts[kept], window), minlength=buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bin", "bytes"])

    return docs.mapInArrow(sized, "bin int, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes"))


def _first_in_batch(words: Words, starts, counts, ids, rows, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal strings in a batch the earliest are sent; the others are repeats as a whole.

    Strings of up to ``window`` windows are told apart by their first and last window. Those
    that start at the same place of the same id are equally early and all kept, unless they
    are the same row twice.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = combine(words.hash, window, 1)
    first, last = at[starts], at[starts + counts - 1]
    name = first * np.uint64(0x9E3779B97F4A7C15) ^ last ^ counts.astype(np.uint64)
    offset = starts - words.first[words.doc[starts]]
    order = np.lexsort((rows, offset, ids, name))
    n, i, o, r = name[order], ids[order], offset[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = n[1:] != n[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    tie = (i == i[head]) & (o == o[head])
    same = np.zeros(len(order), bool)
    same[1:] = ~new[1:] & tie[1:] & (r[1:] == r[:-1])
    long = counts[order] > window
    return order[(tie & ~same) | long], order[~tie & ~long]


def _pack(docs: DataFrame, buckets: int, split: dict[int, int], window: int) -> DataFrame:
    """Packed strings of each batch by bucket, and (in negative buckets) the repeats found within a batch."""

    def packed(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in rebatched(batches, limit=PACK_BYTES):
            words = Words(batch.column(1))
            starts, counts, least = super_kmers(words, window)
            if not len(starts):
                continue
            doc = words.doc[starts]
            ids, rows = np.asarray(batch.column(0))[doc], np.asarray(batch.column(2))[doc]
            offset = starts - words.first[doc]
            kept, repeats = _first_in_batch(words, starts, counts, ids, rows, window)
            salt = int(np.uint64(rows[0].view(np.uint64) if hasattr(rows[0], "view") else rows[0]) % np.uint64(1 << 20))
            if len(repeats):
                whole = np.stack([ids[repeats], rows[repeats], offset[repeats], offset[repeats] + counts[repeats] + window - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - salt], pa.int32()), pa.array([0], pa.int32()), pa.array([packer.compress(whole.astype(np.int64).tobytes())]), pa.array([b""])], ["bin", "part", "ids", "strings"]
                )
            bins = (least[kept] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            kept, bins = kept[order], bins[order]
            begin, stop = words.begin[starts[kept]], words.end[starts[kept] + counts[kept] + window - 2]
            data = words.data.tobytes()
            edges = group_edges(bins)
            out: list[list] = [[], [], [], []]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                k = kept[a:b]
                strings = b"".join([data[x:y] for x, y in zip(begin[a:b].tolist(), stop[a:b].tolist())])
                facts = np.stack([ids[k], rows[k], offset[k], (stop - begin)[a:b]]).astype(np.int64)
                bucket = int(bins[a])
                out[0].append(bucket)
                out[1].append(salt % split.get(bucket, 1))
                out[2].append(packer.compress(facts.tobytes()))
                out[3].append(packer.compress(strings))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bin", "part", "ids", "strings"])

    return docs.mapInArrow(packed, PACKED)


def _intervals(ids, rows, place, window: int) -> pa.RecordBatch:
    """Windows (sorted by row and place) merged to intervals of words."""
    order = np.lexsort((place, rows, ids))
    i, r, p = ids[order], rows[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (p[1:] > p[:-1] + window)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order)) - 1
    none = pa.nulls(len(starts), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array(r[starts]), pa.array(p[starts].astype(np.int32)), pa.array((p[ends] + window).astype(np.int32)), none, none], _NAMES)


def _repeats_in(facts: np.ndarray, strings: bytes, window: int, open_bucket: bool):
    """Windows of a bucket (or part of one) that start earlier in it; of an open bucket also the first ones."""
    ids, rows, offset, length = facts
    ends = np.concatenate(([0], np.cumsum(length)))
    array = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(strings)])
    words = Words(array)
    high, low = combine(words.hash, window, 1), combine(words.hash, window, 2)
    inside = words.doc[: len(high)] == words.doc[window - 1 :] if len(high) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    high, low = high[at], low[at]
    string = words.doc[at]
    place = offset[string] + at - words.first[string]
    order = np.argsort(high, kind="stable")
    h = high[order]
    same = np.zeros(len(order), bool)
    same[1:] = h[1:] == h[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    some = order[shared]
    if len(some):
        some = some[np.lexsort((place[some], ids[string[some]], low[some], high[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (high[some][1:] != high[some][:-1]) | (low[some][1:] != low[some][:-1])
        head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        later = some[(ids[string[some]] != ids[string[head]]) | (place[some] != place[head])]
        if len(later):
            yield _intervals(ids[string[later]], rows[string[later]], place[later], window)
    else:
        later = some
    if open_bucket:
        first = np.ones(len(at), bool)
        first[later] = False
        first = np.flatnonzero(first)
        s = string[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[s]), pa.array(rows[s]), pa.array(place[first].astype(np.int32)), pa.array((place[first] + window).astype(np.int32)), pa.array(high[first].view(np.int64)), pa.array(low[first].view(np.int64))], _NAMES
        )


def _sort_buckets(packed: DataFrame, split: dict[int, int], window: int, most: int) -> DataFrame:
    """Per bucket: intervals of words that repeat; for split buckets also their first windows with their hashes.

    A bucket is held in memory up to ``most`` bytes; a larger one is sorted in parts and left open as if it were split.
    """

    def sort(batches):
        unpacker = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, bytes]] = []
        size, current, parts = 0, None, 0

        def close(last: bool):
            nonlocal held, size, parts
            if held:
                open_bucket = split.get(current[0], 1) > 1 or parts > 0 or not last
                yield from _repeats_in(np.concatenate([f for f, _ in held], axis=1), b"".join(s for _, s in held), window, open_bucket)
                parts += 1
            held, size = [], 0

        for batch in batches:
            for bucket, part, ids, strings in zip(*(batch.column(k).to_pylist() for k in range(4))):
                facts = np.frombuffer(unpacker.decompress(ids), np.int64).reshape(4, -1)
                if bucket < 0:
                    i, r, begin, stop = facts
                    none = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(r), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), none, none], _NAMES)
                    continue
                if (bucket, part) != current:
                    yield from close(True)
                    current, parts = (bucket, part), 0
                elif size >= most:
                    yield from close(False)
                text = unpacker.decompress(strings)
                held.append((facts, text))
                size += len(text)
        yield from close(True)

    return packed.mapInArrow(sort, FOUND)


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id``, ``row``, ``ranges`` (word intervals, end exclusive) of every row with words that repeat.

    ``docs`` holds ``id`` (from ``ordered_id``), ``text`` and ``row`` (from ``text_key``). All
    texts are counted first, so that buckets far above the mean are known and split.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, 3 * size // BUCKET_BYTES)
    sizes = _bucket_sizes(docs, buckets, window)
    hot = int(HOT_TIMES * max(3 * size / buckets, BUCKET_BYTES))
    split = {r["bin"]: -(-r["bytes"] // max(1, hot // 2)) for r in sizes.where(F.col("bytes") > hot).collect()}
    packed = spread(_pack(docs, buckets, split, window), "bin", "part").sortWithinPartitions("bin", "part")
    found = stored(_sort_buckets(packed, split, window, hot), "repeats")
    by_window = Window.partitionBy("high", "low")
    place = F.struct("id", "begin")
    again = found.where("high is not null").withColumn("first", F.min(place).over(by_window)).where(place > F.col("first"))
    marks = found.where("high is null").select("id", "row", "begin", "stop").union(again.select("id", "row", "begin", "stop"))
    return marks.groupBy("id", "row").agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))


def _covered(ranges: pa.Array, first: np.ndarray, words: int) -> np.ndarray:
    """Which words of a batch the ranges of its texts cover."""
    steps = np.zeros(words + 1, np.int64)
    flat = ranges.flatten()
    owner = np.repeat(np.arange(len(ranges)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ranges), 0)))
    np.add.at(steps, first[owner] + np.asarray(flat.field("begin")), 1)
    np.add.at(steps, first[owner] + np.asarray(flat.field("stop")), -1)
    return np.cumsum(steps)[:words] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (the words left, joined by one space).

    A word goes if a window over it has an equal window that starts earlier: in a row with a
    smaller id, or at an earlier word of the same id. Rows of one id at the same word are
    equally early, so a row that is there twice loses nothing to itself. Null ids come last.
    Windows are judged on the input. Null and empty texts have no words.
    """
    rows = docs.select(F.col(id_column).alias("given"), ordered_id(F.col(id_column)).alias("id"), F.col(text_column).alias("text"), text_key(F.col(text_column)).alias("row"))
    marks = repeated_words(rows.select("id", "text", "row"), window).select(F.col("id").alias("i"), F.col("row").alias("r"), "ranges")
    joined = rows.join(marks, (F.col("id") == F.col("i")) & (F.col("row") == F.col("r")), "left").select("given", "text", "ranges")

    def kept(batches):
        for batch in rebatched(batches):
            words = Words(batch.column(1))
            gone = _covered(batch.column(2), words.first, len(words.begin))
            texts = [words.text(d, ~gone) for d in range(words.n)]
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (words.count > 0) if words.n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = dict(rows.dtypes)["given"]
    out = joined.mapInArrow(kept, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_column)
