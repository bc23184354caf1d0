"""Words, hashes and stored steps shared by the operators of this subpackage.

Text work inside tasks runs on whole Arrow batches: bytes, words and shingles of
many documents are numpy arrays, never one Python object per word.
"""

from __future__ import annotations

import ctypes
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.session import work_folder

#: Bytes of text that a task takes into numpy at a time, and of those hashed at a time.
BATCH_BYTES = 4 << 20
HASH_BYTES = 1 << 20
#: Words up to so many bytes are hashed in chunks of eight bytes by ``chunk_hashes``.
CHUNKED = 64

_MULTIPLIER = 0x9E3779B97F4A7C15


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package also where only the driver's path names it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lineage ends, lost executors cost no rerun."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many tasks as the session shuffles to, also where few bytes ask for much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame lacks, like those given."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_key(text: Column) -> Column:
    """Tells texts of one id apart where ids repeat; null and empty texts differ."""
    return F.xxhash64(text, F.length(text))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        base = _MULTIPLIER
        tables = []
        for value in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tables[0], tables[1]
    return _powers


@lru_cache(maxsize=8)
def byte_set(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


BLANKS = b" \t\n\x0b\x0c\r"
SIGNS = bytes(i for i in range(128) if not chr(i).isalnum())


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Code points of scripts that are written without blanks between words: Thai, Lao, Myanmar, Khmer, Tai, Balinese,
#: Javanese, ideographs with their radicals and marks, kana, Bopomofo, Yi, Tangut, Khitan, Nushu.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF),
    (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFD),
)
SIGN, ALONE = 1, 2


@lru_cache(maxsize=1)
def code_point_kinds() -> np.ndarray:
    """For each code point beyond ASCII: SIGN if it parts words (punctuation, blanks, controls), ALONE if it is a word of its own, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for first, last in UNSPACED:
        kinds[first : last + 1] = ALONE
    signs = [c for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Zs", "Zl", "Zp", "Cc")]
    kinds[[*signs, 0x200B, 0xFEFF]] = SIGN
    return kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, bytes and kind of each code point beyond ASCII in UTF-8 bytes."""
    at = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0).astype(np.int64)
    code = data[at].astype(np.int32) & (0xFF >> (size + 1)).astype(np.int32)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F
    return at, size, code_point_kinds()[np.minimum(code, 0x10FFFF)]


def _hash_block(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial over random byte values, taken to the word's own start."""
    base = begin[0]
    data = data[base : end[-1]]
    powers, inverse = _power_tables(len(data) + 1)
    values = np.append(_byte_values()[data] * powers[: len(data)], np.uint64(0))
    edges = np.empty(2 * len(begin), np.int64)
    edges[0::2], edges[1::2] = begin - base, end - base
    sums = np.add.reduceat(values, edges)[0::2]
    return mix(sums * inverse[begin - base] + (end - begin).astype(np.uint64))


def chunk_hashes(w: Words) -> np.ndarray:
    """Another hash of each word, from eight of its bytes at a time; for most words that is once. Words beyond CHUNKED bytes take the polynomial."""
    data = np.concatenate((w.data, np.zeros(8, np.uint8)))
    at_byte = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = w.end - w.begin
    out = mix((size.astype(np.uint64) * np.uint64(_MULTIPLIER)) ^ (at_byte[w.begin] & masks[np.minimum(size, 8)]))
    more, done = np.flatnonzero((size > 8) & (size <= CHUNKED)), 8
    while len(more):
        chunk = at_byte[w.begin[more] + done] & masks[np.minimum(size[more] - done, 8)]
        out[more] = mix((out[more] * np.uint64(_MULTIPLIER)) ^ chunk)
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > CHUNKED):
        out[k] = _hash_block(w.data, w.begin[k : k + 1], w.end[k : k + 1])[0]
    return out


class Words:
    """The words of a batch of texts: ``hash``, ``doc``, ``begin`` and ``end`` (bytes in ``data``) of each.

    ``first[d]:first[d + 1]`` are the words of text ``d``. A null text has no words. With
    ``scripts``, signs beyond ASCII part words too, and each code point of a script that is
    written without blanks is a word.
    """

    def __init__(self, texts: pa.Array, separators: bytes = BLANKS, lower: bool = False, scripts: bool = False):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and len(offsets) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            data = lower_table()[data]
        self.n, self.offsets, self.data = n, offsets, data
        inside = ~byte_set(separators)[data]
        cut = np.zeros(len(data) + 1, bool)  # a word ends before the byte and one may begin there
        if scripts and (data >= 0xC0).any():
            at, size, kind = code_points(data)
            for k in range(4):
                inside[np.minimum(at[(kind == SIGN) & (size > k)] + k, len(data) - 1)] = False
            alone = kind == ALONE
            cut[at[alone]] = True
            cut[np.minimum(at[alone] + size[alone], len(data))] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        for edge, at in ((begins, offsets[:-1]), (last, offsets[1:] - 1)):  # no word reaches over the edge of a text
            full = at[offsets[1:] > offsets[:-1]]
            edge[full] = inside[full]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = np.empty(len(self.begin), np.uint64)
            at = 0
            while at < len(self.begin):  # a block of bytes at a time, at least one word
                stop = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + HASH_BYTES, side="right")))
                self._hash[at:stop] = _hash_block(self.data, self.begin[at:stop], self.end[at:stop])
                at = stop
        return self._hash

    def text(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """The words of one text, or those kept of them, joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        words = self.data[self.offsets[d] : self.offsets[d + 1]].tobytes().split()
        if keep is not None:
            words = [w for w, k in zip(words, keep[a:b].tolist()) if k]
        return b" ".join(words)


def combine(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive values; one value per start (``len - length + 1``)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((0xD1342543DE82EF95 + 2 * seed) | 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * step + hashes[k : k + n]
    return mix(total + np.uint64(seed))


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes in a column, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def rebatched(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, limit)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(task: Callable) -> Callable:
    """A task's function for ``mapInArrow``; memory goes back once all that the task held is freed, its variables as well."""

    def whole(batches):
        yield from task(batches)
        give_back()

    return whole


def runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that arrive sorted by ``key``.

    Waits until ``rows`` rows are there, then gives all groups that are complete.
    """
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.Table.from_batches(kept)
        edge = _last_group(table, key)
        if edge:
            yield table.slice(0, edge)
        rest = table.slice(edge)
        kept, held = rest.to_batches(), 0  # a long group is looked at again only after as many new rows
    if kept:
        yield pa.Table.from_batches(kept)
    kept = []
    give_back()


def _last_group(table: pa.Table, key: list[str]) -> int:
    same = np.ones(table.num_rows, bool)
    for name in key:
        column = table.column(name)
        last = column[-1]
        same &= np.asarray(pc.fill_null(pc.equal(column, last), False)) if last.is_valid else np.asarray(column.is_null())
    return 0 if same.all() else int(len(same) - np.argmin(same[::-1]))


def group_edges(values: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start, and the length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
