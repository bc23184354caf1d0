"""Line dedup: an exact set-similarity join of the words of lines.

Words are ordered by rarity; two lines that are similar share a word among the first few
of that order. Lines that meet there pass length and positional filters, are verified,
and a line goes if an earlier one is similar.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import Words, chunk_hashes, free_names, group_edges, mix, rebatched, released, runs, spread, stored, text_key
from lakemart.llm.components import components
from lakemart.llm.repeats import ordered_id
from lakemart.llm.sets import (
    BIN_BYTES,
    BUNDLE,
    MAPPED,
    bundled,
    dealt,
    filtered,
    grouped,
    key_filter,
    passes,
    prefix_length,
    shared_entries,
    small_maps,
    threshold_overlap,
)

#: Lines are similar from this Jaccard similarity of their words. Callers that name no bound leave lines of fewer different words alone.
PERCENT = 75
LEAST_WORDS = 5
#: Words whose counts are sent to tasks; all others are rarer and ordered by hash.
COMMON_WORDS = 1 << 16
#: First bits of a hash by which common words are looked up.
SLOT_BITS = 20
#: Lines of a block that are compared in one task.
GROUP_LINES = 8_000
#: Groups in which every two lines are compared as they are.
SMALL_GROUP = 32
#: Leaders that a line is held against before all earlier lines are looked up.
MOST_LEADERS = 64
PACK_BYTES = 4 << 20
#: Words with counts that a task holds before it sums them up.
MOST_COUNTED = 2 << 20
#: Spreads line numbers over the low bits of a place's key; the product of a line number with it stays below 2**63.
PLACE_FACTOR = 2_654_435_761

FOUND = "kind int, run long, cls long, id long, row long, line int"
_NAMES = [part.split()[0] for part in FOUND.split(", ")]
#: TIE: another row at the very place of the earliest line of a class.
MEMBER, CLASS, REPEAT, TIE = 0, 1, 2, 3
#: A bin of places takes the lines of so many bins of entries, which are about as many bytes.
PLACE_BINS = 8
#: Places of a bin that a task holds before only the earliest of each class stay.
MOST_PLACES = 1 << 19


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different words and their counts, from parts that each hold a word once."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, counts = np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(words)
    words, edges = words[order], group_edges(words[order])
    return words[edges[:-1]], np.add.reduceat(counts[order], edges[:-1]) if len(words) else counts


def common_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the most common words of all texts, by falling count, and the bytes of all texts."""

    def counted(batches):
        parts, held, size = [], 0, 0

        def rows():
            words, counts = _summed(parts)
            # what is none of the most common here, or met once among so many, hardly is one of all; any order of words is exact
            often = np.argpartition(counts, -COMMON_WORDS)[-COMMON_WORDS:] if len(words) > COMMON_WORDS else np.arange(len(words))
            often = often[counts[often] > 1]
            return pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], ["word", "n"])

        for batch in rebatched(batches, 0, PACK_BYTES):
            size += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
            parts.append(np.unique(chunk_hashes(Words(batch.column(0))), return_counts=True))
            held += len(parts[-1][0])
            if held > MOST_COUNTED:  # words that the batches share become one; if most differ, they go
                parts[:] = [_summed(parts)]
                held = len(parts[0][0])
                if held > MOST_COUNTED // 2:
                    yield rows()
                    parts.clear()
                    held = 0
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([size], pa.int64())], ["word", "n"])

    sums = docs.select("text").mapInArrow(released(counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # the bytes stand where a word would, and first: no word is met more often than there are bytes
    top = sums.orderBy(F.desc("n"), F.asc_nulls_first("word")).limit(COMMON_WORDS + 1).toArrow()
    word = top["word"].combine_chunks()
    size = pc.sum(top["n"].filter(word.is_null())).as_py() or 0
    return np.asarray(word.drop_null()).view(np.uint64), size


class Rarity:
    """The order of words: rare ones by hash, then the common ones by rising count."""

    def __init__(self, common: np.ndarray):
        self.sorted = np.sort(common)
        self.rank = np.uint64(1 << 63) + ((len(common) - 1 - np.argsort(common)).astype(np.uint64) << np.uint64(24))  # above the bits that a line sorts by
        edges = np.searchsorted(self.sorted, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        self.first = edges.astype(np.int32)  # of the common words with the same first bits
        self.count = np.diff(np.append(edges, len(common))).astype(np.int32)
        if len(common):  # most words are the first of their slot; without one it shows a word of another slot
            edges = np.minimum(edges, len(common) - 1)
            self.head, self.head_rank = self.sorted[edges], self.rank[edges]
        self.common = common

    def __reduce__(self):
        return Rarity, (self.common,)  # tasks get the words and build the tables themselves

    def of(self, words: np.ndarray) -> np.ndarray:
        out = words >> np.uint64(1)
        if not len(self.common):
            return out
        slot = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = np.flatnonzero(self.head[slot] == words)
        out[at] = self.head_rank[slot[at]]
        count = self.count[slot]
        for k in range(1, int(self.count.max())):
            at = np.flatnonzero(count > k)
            place = self.first[slot[at]] + k
            same = self.sorted[place] == words[at]
            out[at[same]] = self.rank[place[same]]
        return out


class Lines:
    """The lines of a batch with at least ``least`` different words, each as its words in order of rarity."""

    def __init__(self, texts: pa.Array, rarity: Rarity, least: int = LEAST_WORDS):
        w = Words(texts)
        breaks = np.flatnonzero(w.data == 10)
        after = np.searchsorted(w.begin, breaks)  # the first word after each break
        starts = np.unique(np.concatenate((after, w.first)))
        starts = starts[starts < len(w.begin)]
        doc = np.searchsorted(w.first, starts, side="right") - 1
        number = np.searchsorted(after, starts, side="right") - np.searchsorted(breaks, w.offsets)[doc]
        line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w.begin))))
        hashes = chunk_hashes(w)
        order_of = rarity.of(hashes)
        name = (line.astype(np.uint64) << np.uint64(40)) | (order_of >> np.uint64(24))
        order = np.argsort(name)
        sorted_name, token = name[order], hashes[order]
        if ((sorted_name[1:] == sorted_name[:-1]) & (token[1:] != token[:-1])).any():  # words that differ in their last bits only
            order = np.lexsort((order_of, line))
            token = hashes[order]
        line = line[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, line = token[once], line[once]
        size = np.bincount(line, minlength=len(starts))
        first = np.concatenate(([0], np.cumsum(size)))
        sums = np.add.reduceat(np.append(mix(self.token), np.uint64(0)), first[:-1]) if len(size) else np.zeros(0, np.uint64)
        keep = np.flatnonzero(size >= least)
        self.size, self.first = size[keep], first[:-1][keep]
        self.cls = mix(sums[keep] + size[keep].astype(np.uint64)).view(np.int64)
        self.doc, self.number = doc[keep], number[keep]

    def tokens(self, k: int) -> np.ndarray:
        return self.token[self.first[k] : self.first[k] + self.size[k]]


def _earliest(cls: np.ndarray, ids: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places of each class the earliest, others at the very same place, and the later ones."""
    order = np.lexsort((rows, numbers, ids, cls))
    c, i, n, r = cls[order], ids[order], numbers[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = c[1:] != c[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    tie = (i == i[head]) & (n == n[head])
    twice = np.zeros(len(order), bool)
    twice[1:] = ~new[1:] & tie[1:] & (r[1:] == r[:-1])
    return order[new], order[tie & ~new & ~twice], order[~tie]


class _Places:
    """Settles the places of classes, which arrive by bin, so that one of each class is the earliest of all texts."""

    def __init__(self):
        self.bin, self.held, self.size, self.most = None, [], 0, MOST_PLACES

    def add(self, number: int, data: bytes):
        kind, *columns = np.frombuffer(data, np.int64).reshape(5, -1)
        if kind[0] == REPEAT:
            yield kind, *columns
            return
        if number != self.bin:
            yield from self.close()
            self.bin = number
        self.held.append(columns)
        self.size += len(kind)
        if self.size > self.most:
            first, tie, later = self._settled()
            yield np.full(len(later[0]), REPEAT), *later
            self.held = [first, tie]
            self.size = len(first[0]) + len(tie[0])
            self.most = max(MOST_PLACES, 2 * self.size)

    def _settled(self):
        columns = [np.concatenate(parts) for parts in zip(*self.held)]
        return [[c[k] for c in columns] for k in _earliest(*columns)]

    def close(self):
        if self.held:
            for kind, columns in zip((CLASS, TIE, REPEAT), self._settled()):
                if len(columns[0]):
                    yield np.full(len(columns[0]), kind), *columns
        self.held, self.size, self.most = [], 0, MOST_PLACES


def _places(kind: int, cls, ids, rows, numbers) -> bytes:
    out = np.zeros((5, len(cls)), np.int64)
    out[0], out[1], out[2], out[3], out[4] = kind, cls, ids, rows, numbers
    return out.tobytes()


def _index(docs: DataFrame, rarity: Rarity, bins: int, least: int) -> DataFrame:
    def entries(batches):
        for batch in rebatched(batches, limit=PACK_BYTES):
            lines = Lines(batch.column(1), rarity, least)
            if not len(lines.cls):
                continue
            ids, rows = np.asarray(batch.column(0))[lines.doc], np.asarray(batch.column(2))[lines.doc]
            first, tie, later = _earliest(lines.cls, ids, rows, lines.number)
            # repeats only pass through, the other places of a class meet in its bin
            parts = [(-1 - int(rows[0] % (1 << 20)), REPEAT, later)] if len(later) else []
            earliest = np.concatenate((first, tie))
            number = (lines.cls[earliest].view(np.uint64) % np.uint64(-(-bins // PLACE_BINS))).astype(np.int64)
            order = np.argsort(number, kind="stable")
            earliest, edges = earliest[order], group_edges(number[order])
            parts += [(-1 - int(number[order[a]]), CLASS, earliest[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            data = [_places(kind, lines.cls[k], ids[k], rows[k], lines.number[k]) for _, kind, k in parts]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array(data, pa.binary())], ["bin", "data"])
            one = first
            one = one[100 * lines.size[one] >= PERCENT * (lines.size[one] + 1)]  # smaller sets are similar to equal ones only, which are their class
            if not len(one):
                continue
            length = prefix_length(lines.size[one], PERCENT)
            owner = np.repeat(np.arange(len(one)), length)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            cls, begin, size = lines.cls[one], lines.first[one], lines.size[one]
            yield bundled(lines.token[begin[owner] + place], owner, place, cls, size, bins, small_maps(lines.token, begin, size))

    return docs.mapInArrow(released(entries), BUNDLE)


def _meet(bundles: DataFrame) -> DataFrame:
    def met(batches):
        places = _Places()
        for found in chain(shared_entries(batches, places.add, PERCENT, MAPPED), places.close()):
            if len(found) == 2:
                run, cls = found
                none = pa.nulls(len(run), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), MEMBER, np.int32)), pa.array(run), pa.array(cls), none, none, pa.nulls(len(run), pa.int32())], _NAMES)
            else:
                kind, cls, ids, rows, numbers = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.astype(np.int32)), pa.nulls(len(cls), pa.int64()), pa.array(cls), pa.array(ids), pa.array(rows), pa.array(numbers.astype(np.int32))], _NAMES
                )

    return spread(bundles, "bin").sortWithinPartitions("bin").mapInArrow(released(met), FOUND)


def _place_key(row, line):
    """Of columns or of arrays, as 64-bit values."""
    spread_line = line * PLACE_FACTOR
    return row.bitwiseXOR(spread_line) if isinstance(row, Column) else row ^ spread_line


def _lines_at(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Array:
    """The lines whose place may be in the filter, each as a text."""
    texts = batch.column(1).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    breaks = np.flatnonzero(data == 10)
    upto = np.searchsorted(breaks, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(upto) + 1)  # a line more than breaks
    first = upto[:-1] + np.arange(len(texts))
    number = np.arange(len(doc)) - first[doc]
    begin, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    begin[first], end[first + np.diff(upto)] = offsets[:-1], offsets[1:]
    after = np.ones(len(doc), bool)
    after[first] = False
    begin[after] = breaks + 1
    end[np.roll(after, -1)] = breaks
    some = np.flatnonzero(passes(bits, _place_key(np.asarray(batch.column(2))[doc], number)))
    held = data.tobytes()
    return pa.array([held[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist())], pa.large_binary())


def _words_of(docs: DataFrame, rarity: Rarity, rows_filter: np.ndarray, place_filter: np.ndarray, least: int) -> DataFrame:
    """``cls``, ``tokens`` of the lines that met others, from their earliest places; only these lines are cut into words."""

    def sets(batches):
        for batch in rebatched(batches, limit=PACK_BYTES):
            batch = batch.filter(pa.array(passes(rows_filter, np.asarray(batch.column(2)))))
            if not batch.num_rows:
                continue
            lines = Lines(_lines_at(batch, place_filter), rarity, least)
            one = np.unique(lines.cls, return_index=True)[1]
            tokens = [lines.tokens(k) for k in one]
            yield pa.RecordBatch.from_arrays([pa.array(lines.cls[one]), pa.array([t.tobytes() for t in tokens], pa.binary())], ["cls", "tokens"])

    return docs.mapInArrow(released(sets), "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def later_matches(sizes: np.ndarray, tokens: list[np.ndarray], places: list, percent: int = PERCENT) -> np.ndarray:
    """Which sets (sorted by place) are similar to a set of an earlier place.

    A set is first held against leaders, the sets that matched none before; only where no
    leader is similar are all earlier sets looked up by their words.
    """
    n = len(sizes)
    gone = np.zeros(n, bool)
    members = [set(t.tolist()) for t in tokens]
    if n <= SMALL_GROUP:
        for i in range(1, n):
            size = len(members[i])
            gone[i] = any(
                places[j] < places[i]
                and 100 * min(size, len(members[j])) >= percent * max(size, len(members[j]))
                and len(members[i] & members[j]) >= threshold_overlap(size, len(members[j]), percent)
                for j in range(i)
            )
        return gone
    owner = np.repeat(np.arange(n), sizes)
    names, word = np.unique(np.concatenate(tokens), return_inverse=True)
    order = np.argsort(word, kind="stable")
    holders = owner[order]
    edges = np.searchsorted(word[order], np.arange(len(names) + 1))
    ends = np.cumsum(sizes)
    leaders: list[int] = []
    first_at = {}
    for i in range(n):
        first_at.setdefault(places[i], i)
    for i in range(n):
        before = first_at[places[i]]  # sets at the same place are not earlier
        if not before:
            leaders.append(i)
            continue
        size = int(sizes[i])
        for j in leaders[:MOST_LEADERS]:
            other = int(sizes[j])
            if j < before and 100 * min(size, other) >= percent * max(size, other) and len(members[i] & members[j]) >= threshold_overlap(size, other, percent):
                gone[i] = True
                break
        if gone[i]:
            continue
        mine = word[ends[i] - size : ends[i]]
        lists = [holders[a : a + np.searchsorted(holders[a:b], before)] for a, b in zip(edges[mine].tolist(), edges[mine + 1].tolist())]
        overlap = np.bincount(np.concatenate(lists), minlength=before)[:before]
        gone[i] = bool((overlap >= threshold_overlap(size, sizes[:before], percent)).any())
        if not gone[i]:
            leaders.append(i)
    return gone


def _resolve(groups: DataFrame) -> DataFrame:
    """The classes of each group (run, a, b) that an earlier class of the group matches."""

    def resolve(batches):
        for table in runs(batches, ["run", "a", "b"], rows=20_000):
            key = np.stack([np.asarray(table[c]) for c in ("run", "a", "b")])
            edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            cls, ids, numbers = (np.asarray(table[c]) for c in ("cls", "id", "line"))
            data = table["tokens"].to_pylist()
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a < 2:
                    continue
                order = a + np.lexsort((cls[a:b], numbers[a:b], ids[a:b]))
                tokens = [np.frombuffer(data[k], np.uint64) for k in order]
                sizes = np.array([len(t) for t in tokens])
                gone = later_matches(sizes, tokens, [(int(ids[k]), int(numbers[k])) for k in order])
                out.append(cls[order[gone]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["cls"])

    return groups.mapInArrow(released(resolve), "cls long")


def later_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id``, ``row``, ``lines`` (numbers from 0) of all lines that match an earlier one.

    ``docs`` holds ``id`` (from ``ordered_id``), ``text`` and ``row`` (from ``text_key``).
    """
    common, size = common_words(docs)
    rarity = Rarity(common)
    found = stored(_meet(_index(docs, rarity, max(1, size // BIN_BYTES), least_words)), "lines")
    members = found.where((F.col("kind") == MEMBER) & (F.col("run") != F.col("cls"))).select("run", "cls").distinct()
    earliest = found.where(F.col("kind") == CLASS).select("cls", "id", "row", "line")  # one of each class
    met = members.select("cls").union(members.select("run")).distinct()
    wanted = stored(earliest.join(met, "cls"), "wanted")
    at = wanted.select(_place_key(F.col("row"), F.col("line").cast("long")).alias("at"))
    sets = stored(_words_of(docs, rarity, key_filter(wanted, "row"), key_filter(at, "at"), least_words), "sets")
    blocks = components(members.select(F.col("run").alias("a"), F.col("cls").alias("b"))).select(F.col("node").alias("cls"), F.col("root").alias("run"))
    groups = dealt(blocks, "run", "cls", GROUP_LINES).join(wanted.select("cls", "id", "line").join(sets, "cls"), "cls")
    matched = stored(_resolve(grouped(groups, "run")).distinct(), "matched")
    ties = found.where(F.col("kind") == TIE).select("cls", "id", "row", "line")
    later = wanted.select("cls", "id", "row", "line").union(ties).join(matched, "cls").select("id", "row", "line")
    repeats = found.where(F.col("kind") == REPEAT).select("id", "row", "line")
    return later.union(repeats).groupBy("id", "row").agg(F.collect_set("line").alias("lines"))


def with_later_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS, lines_column: str = "_lines"
) -> DataFrame:
    """The documents with ``lines_column``: numbers of the lines that go, null where all stay.

    Only texts that may have such lines are shuffled to meet their numbers.
    """
    own_id, own_row, other_id, other_row = free_names(docs.withColumn(lines_column, F.lit(0)), "_id", "_row", "_i", "_r")
    keyed = docs.withColumn(own_id, ordered_id(F.col(id_column))).withColumn(own_row, text_key(F.col(text_column)))
    rows = keyed.select(F.col(own_id).alias("id"), F.col(text_column).alias("text"), F.col(own_row).alias("row"))
    gone = later_lines(rows, least_words).select(F.col("id").alias(other_id), F.col("row").alias(other_row), F.col("lines").alias(lines_column))
    gone = stored(gone, "gone")
    bits = key_filter(gone, other_row)
    clean = filtered(keyed, own_row, bits, keep=False).withColumn(lines_column, F.lit(None).cast("array<int>"))
    same = (F.col(own_id) == F.col(other_id)) & (F.col(own_row) == F.col(other_row))
    some = filtered(keyed, own_row, bits).join(gone.hint("shuffle_hash"), same, "left")  # texts are not sorted
    return clean.unionByName(some.drop(other_id, other_row)).drop(own_id, own_row)


def without_later_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without the lines that are similar to an earlier line, all columns and rows kept.

    A line is a set of words (runs without white space); two lines are similar if the
    Jaccard similarity of their sets is 0.75 or more. Earlier is a smaller id, or an earlier
    line of the same id; all lines of the input count, those that go as well. Lines at one
    place of one id (repeated rows) are equally early, null ids come last. Lines of fewer
    than ``least_words`` different words stay; with 1 only lines without words do, as in
    the query and the pipeline. Null and empty texts stay as they are; a text whose lines
    all go becomes empty. Where there is a column of lengths it is set to the new length.
    """
    (lines,) = free_names(docs, "_lines")
    marked = with_later_lines(docs, id_column, text_column, least_words, lines)
    cut = F.array_join(_kept_lines(F.col(text_column), F.col(lines)), "\n")
    text = F.when(F.col(lines).isNull(), F.col(text_column)).otherwise(cut)
    out = marked.withColumn(text_column, text)
    if chars_column in docs.columns:
        length = F.when(F.col(lines).isNull(), F.col(chars_column)).otherwise(F.length(text_column))
        out = out.withColumn(chars_column, length.cast(dict(docs.dtypes)[chars_column]))
    return out.select(docs.columns)


def _kept_lines(text, numbers):
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), numbers)
    both = F.array(F.struct(parts.alias("parts"), kept.alias("kept")))  # bound once, so that a line is not searched in a list
    return F.transform(both, lambda b: F.transform(b["kept"], lambda k: F.get(b["parts"], k)))[0]


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row: id, ``n_lines``, ``n_removed`` and the hash of the text that is left (null text: as empty)."""
    marked = with_later_lines(docs.select(id_column, text_column), id_column, text_column, least_words)
    removed = F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    text = F.coalesce(F.col(text_column), F.lit(""))
    left = F.when(F.col("_lines").isNull(), text).otherwise(F.array_join(_kept_lines(text, F.col("_lines")), "\n"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(F.col(text_column).isNull(), 0).otherwise(breaks + 1)
    return marked.select(id_column, lines.cast("long").alias("n_lines"), removed.alias("n_removed"), F.sha2(left, 256).alias("kept_sha256"))
