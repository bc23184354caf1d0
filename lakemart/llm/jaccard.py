"""N-gram Jaccard join by signature trees.

Documents that share a shingle of their prefix meet in runs. In a run a tree is laid over
the documents by size: every node holds the OR of the token bitmaps below and the range of
their sizes, and two trees are walked together, leaving out pairs of nodes that cannot reach
the overlap asked for. What is left joins documents to blocks, in which the shingles
themselves are compared along such a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakemart.llm.common import Words, combine, free_names, mix, rebatched, released, runs, spread, stored, text_key
from lakemart.llm.components import components
from lakemart.llm.sets import (
    BIN_BYTES,
    BUNDLE,
    bundled,
    dealt,
    filtered,
    grouped,
    key_filter,
    passes,
    prefix_length,
    shared_entries,
    threshold_overlap,
)

SHINGLE = 5
PERCENT = 75
PACK_BYTES = 4 << 20
#: Shingles that occur in this share of a batch's documents are listed; the most frequent ones come last in the order.
COMMON_SHARE = 1 / 256
COMMON_SHINGLES = 1 << 16
#: Bits of a document's bitmap: a power of two, at least twice its size, within these bounds.
LEAST_BITS, MOST_BITS = 512, 1 << 15
#: Documents of a run or block that are compared in one task; documents below a leaf; children of a node.
GROUP_ROWS = 4_000
BLOCK_ROWS = 4_000
LEAF, FAN = 8, 8


class Shingles:
    """The distinct shingles of each text, sorted: ``token[first[d]:first[d + 1]]``, and ``cls``, a hash of the set."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        values = combine(w.hash, SHINGLE)
        inside = w.doc[: len(values)] == w.doc[SHINGLE - 1 :] if len(values) else np.zeros(0, bool)
        token, doc = values[inside], w.doc[: len(values)][inside]
        short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
        if len(short):  # a text of fewer words is one sequence
            whole = np.array([int(mix(combine(w.hash[w.first[d] : w.first[d + 1]], int(w.count[d]), 7 + int(w.count[d])))[0]) for d in short], np.uint64)
            token, doc = np.concatenate((token, whole)), np.concatenate((doc, short))
            order = np.argsort(doc, kind="stable")
            token, doc = token[order], doc[order]
        n = w.n
        del w, values, inside  # a batch's words take more memory than its shingles
        edges = np.searchsorted(doc, np.arange(n + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            token[a:b].sort()
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[once], doc[once]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.size = np.diff(self.first)
        sums = np.add.reduceat(np.append(mix(self.token), np.uint64(0)), self.first[:-1]) if n else np.zeros(0, np.uint64)
        self.cls = np.where(self.size > 0, mix(sums + self.size.astype(np.uint64)).view(np.int64), 0)

    def tokens(self, d: int) -> np.ndarray:
        return self.token[self.first[d] : self.first[d + 1]]


CLASSES = "id long, row long, cls long, size long, common binary"


def _classes(docs: DataFrame) -> DataFrame:
    """Id, row, class and size of every text; with the first row of a batch the shingles that are common in it."""

    def classes(batches):
        for batch in rebatched(batches, limit=PACK_BYTES):
            s = Shingles(batch.column(1))
            found, count = np.unique(s.token, return_counts=True)
            often = count >= max(8, COMMON_SHARE * batch.num_rows)
            pairs = np.stack([found[often].view(np.int64), count[often]]).astype(np.int64)
            common = [pairs.tobytes()] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s.cls), pa.array(s.size.astype(np.int64)), pa.array(common, pa.binary())], ["id", "row", "cls", "size", "common"])

    return docs.mapInArrow(released(classes), CLASSES)


def _common(classes: DataFrame) -> np.ndarray:
    """The most frequent shingles, of those that are common in some batch of documents."""

    def listed(batches):
        for batch in batches:
            for data in batch.column(0).drop_null().to_pylist():
                token, count = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], ["token", "n"])

    sums = classes.select("common").mapInArrow(released(listed), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(np.asarray(sums.orderBy(F.desc("n"), "token").limit(COMMON_SHINGLES).select("token").toArrow()["token"]).view(np.uint64))


def _index(docs: DataFrame, common: np.ndarray, bins: int) -> DataFrame:
    """Prefix entries of each class of a batch: by hash, common shingles last."""

    def entries(batches):
        for batch in rebatched(batches, limit=PACK_BYTES):
            s = Shingles(batch.column(1))
            _, one = np.unique(s.cls, return_index=True)
            one = one[s.size[one] > 0]
            if not len(one):
                continue
            place = np.minimum(np.searchsorted(common, s.token), max(len(common) - 1, 0))
            late = common[place] == s.token if len(common) else np.zeros(len(s.token), bool)
            order = np.lexsort((late, s.doc)) if late.any() else np.arange(len(s.token))  # stable: by hash within both
            token = s.token[order]
            length = prefix_length(s.size[one], PERCENT)
            owner = np.repeat(one, length)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            yield bundled(token[s.first[owner] + at], owner, at, s.cls, s.size, bins)

    return docs.mapInArrow(released(entries), BUNDLE)


def _meet(bundles: DataFrame) -> DataFrame:
    def met(batches):
        for run, cls in shared_entries(batches, lambda number, data: (), PERCENT):
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(cls)], ["run", "cls"])

    return spread(bundles, "bin").sortWithinPartitions("bin").mapInArrow(released(met), "run long, cls long")


def bits_for(size: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, 2 << int(size - 1).bit_length())))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the tokens; the bitmap of half as many bits is the OR of its halves."""
    out = np.zeros(bits // 64, np.uint64)
    place = (mix(tokens) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def _maps(docs: DataFrame, rows_filter: np.ndarray, cls_filter: np.ndarray) -> DataFrame:
    """``cls``, ``size``, ``bitmap`` of the classes that met others."""

    def maps(batches):
        for s, one in _picked(batches, rows_filter, cls_filter):
            maps = [bitmap(s.tokens(d), bits_for(int(s.size[d]))).tobytes() for d in one]
            yield pa.RecordBatch.from_arrays([pa.array(s.cls[one]), pa.array(s.size[one].astype(np.int32)), pa.array(maps, pa.binary())], ["cls", "size", "bitmap"])

    found = docs.mapInArrow(released(maps), "cls long, size int, bitmap binary")
    return found.groupBy("cls").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"))


def _tokens(docs: DataFrame, rows_filter: np.ndarray, cls_filter: np.ndarray) -> DataFrame:
    """``cls``, ``tokens`` of the classes that are in a block."""

    def sets(batches):
        for s, one in _picked(batches, rows_filter, cls_filter):
            yield pa.RecordBatch.from_arrays([pa.array(s.cls[one]), pa.array([s.tokens(d).tobytes() for d in one], pa.binary())], ["cls", "tokens"])

    return docs.mapInArrow(released(sets), "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def _picked(batches, rows_filter: np.ndarray, cls_filter: np.ndarray):
    """Shingles of the texts that pass both filters, one text of a class in a batch."""
    for batch in rebatched(batches, limit=PACK_BYTES):
        batch = batch.filter(pa.array(passes(rows_filter, np.asarray(batch.column(2)))))
        if batch.num_rows:
            s = Shingles(batch.column(1))
            _, one = np.unique(s.cls, return_index=True)
            yield s, one[(s.size[one] > 0) & passes(cls_filter, s.cls[one])]


class Tree:
    """Nodes over documents sorted by size, leaves first: OR of bitmaps, least and most size, most collisions."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        extra = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = []
        low, high, step = sizes, sizes, LEAF
        while True:
            starts = np.arange(0, len(low), step)
            maps = np.bitwise_or.reduceat(maps, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            extra = np.maximum.reduceat(extra, starts)
            self.levels.append((maps, low, high, extra))
            if len(starts) == 1:
                break
            step = FAN


def _possible(a, b, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether documents under nodes x of level a and y of level b can be similar, by sizes and by the most overlap."""
    maps_a, low_a, high_a, extra_a = a
    maps_b, low_b, high_b, extra_b = b
    sizes = (100 * high_a[x] >= percent * low_b[y]) & (100 * high_b[y] >= percent * low_a[x])
    common = np.bitwise_count(maps_a[x] & maps_b[y]).sum(axis=1).astype(np.int64)
    most = np.minimum(np.minimum(common + extra_a[x], common + extra_b[y]), np.minimum(high_a[x], high_b[y]))
    return sizes & (most >= threshold_overlap(low_a[x], low_b[y], percent))


def similar_pairs(sizes: np.ndarray, maps: np.ndarray, percent: int = PERCENT, batch: int = 1 << 15):
    """Pairs (i, j), i < j, of documents sorted by size that their bitmaps let be similar, in batches.

    The tree is walked against itself from the root down; only pairs of nodes that can
    still hold a similar pair are opened.
    """
    documents = (maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64))
    levels = [documents, *Tree(sizes, maps).levels]
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if len(x) > batch:
            half = len(x) // 2
            stack += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
            continue
        fit = _possible(levels[level], levels[level], x, y, percent)
        if level == 0:
            fit &= x < y
        x, y = x[fit], y[fit]
        if not len(x):
            continue
        if level == 0:
            yield x, y
            continue
        step = LEAF if level == 1 else FAN
        below = len(levels[level - 1][1])
        i = (x[:, None] * step + np.arange(step))[:, :, None]
        j = (y[:, None] * step + np.arange(step))[:, None, :]
        i, j = np.broadcast_arrays(i, j)
        keep = (i < below) & (j < below) & (i <= j)
        stack.append((level - 1, i[keep], j[keep]))


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _folded(data: list[bytes], bits: int) -> np.ndarray:
    out = np.empty((len(data), bits // 64), np.uint64)
    for k, raw in enumerate(data):
        words = np.frombuffer(raw, np.uint64)
        while len(words) > bits // 64:
            words = words[: len(words) // 2] | words[len(words) // 2 :]
        out[k] = words
    return out


def linked(sizes: np.ndarray, data: list[bytes], union: Union, test=None, percent: int = PERCENT) -> None:
    """Join the documents of a group that can be (or by ``test`` are) similar.

    Similar documents have bitmaps of one width or of two neighbouring ones, so each width
    is walked together with the next, folded. Pairs that are joined already are not tested.
    """
    widths = np.array([len(d) * 8 for d in data])
    for bits in np.unique(widths):
        pick = np.flatnonzero((widths == bits) | (widths == 2 * bits))
        if not (widths[pick] == bits).any() or len(pick) < 2:
            continue
        pick = pick[np.argsort(sizes[pick], kind="stable")]
        for x, y in similar_pairs(sizes[pick], _folded([data[k] for k in pick], int(bits)), percent):
            for i, j in zip(pick[x].tolist(), pick[y].tolist()):
                if union.find(i) != union.find(j) and (test is None or test(i, j)):
                    union.join(i, j)


def _groups(table: pa.Table, key: str):
    keys = np.stack([np.asarray(table[c]) for c in (key, "a", "b")])
    edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
    yield from ((a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a > 1)


def _edges(found: list[tuple[np.ndarray, Union]]) -> pa.RecordBatch:
    a, b = [], []
    for cls, union in found:
        for k in range(len(cls)):
            root = union.find(k)
            if root != k:
                a.append(cls[k])
                b.append(cls[root])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def possible_edges(met: DataFrame, maps: DataFrame) -> DataFrame:
    """Edges of a forest over the documents of each run that their bitmaps let be similar."""

    def walk(batches):
        for table in runs(batches, ["run", "a", "b"], rows=20_000):
            cls, sizes, maps = np.asarray(table["cls"]), np.asarray(table["size"]).astype(np.int64), table["bitmap"].to_pylist()
            found = []
            for a, b in _groups(table, "run"):
                union = Union(b - a)
                linked(sizes[a:b], maps[a:b], union)
                found.append((cls[a:b], union))
            yield _edges(found)

    return grouped(dealt(met, "run", "cls", GROUP_ROWS).join(maps.select("cls", "size", "bitmap"), "cls"), "run").mapInArrow(released(walk), "a long, b long")


def _links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges of a forest over the documents of each block that are similar, by their shingles."""

    def walk(batches):
        for table in runs(batches, ["block", "a", "b"], rows=2_000):
            cls, sizes, maps = np.asarray(table["cls"]), np.asarray(table["size"]).astype(np.int64), table["bitmap"].to_pylist()
            tokens = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
            found = []
            for a, b in _groups(table, "block"):
                mine = tokens[a:b]

                def similar(i: int, j: int, mine=mine) -> bool:
                    x, y = mine[i], mine[j]
                    if len(x) > len(y):
                        x, y = y, x
                    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[place] == x).sum())
                    return 100 * common >= PERCENT * (len(x) + len(y) - common)

                union = Union(b - a)
                linked(sizes[a:b], maps[a:b], union, similar)
                found.append((cls[a:b], union))
            yield _edges(found)

    return grouped(dealt(blocks, "block", "cls", BLOCK_ROWS).join(sets, "cls"), "block").mapInArrow(released(walk), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``row`` (tells texts of one id apart), ``n_shingles``, ``component_id``.

    A text's set are its distinct runs of five words, A-Z in lower case; a text of fewer
    words is one sequence; without words it is empty and links with nothing. Texts link when
    100 * overlap >= 75 * union. The component is the smallest id reachable by links, the
    row's own included. Equal sets are one class, so copies are never paired. Null ids take
    part and are never the smallest; a component of null ids alone has a null id. Sets are
    told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), text_key(F.col(text_column)).alias("row"))
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    classes = stored(_classes(rows), "classes")
    common = _common(classes)
    met = stored(_meet(_index(rows, common, max(1, size // BIN_BYTES))).distinct(), "met")
    full = classes.where("size > 0")
    places = full.groupBy("cls").agg(F.min("row").alias("row"))
    wanted = stored(places.join(met.select("cls").distinct(), "cls"), "wanted")
    maps = stored(_maps(rows, key_filter(wanted, "row"), key_filter(wanted, "cls")), "maps")
    blocks = components(possible_edges(met, maps)).select(F.col("node").alias("cls"), F.col("root").alias("block"))
    inside = stored(blocks.join(wanted, "cls"), "blocks")
    tokens = _tokens(rows, key_filter(inside, "row"), key_filter(inside, "cls"))
    links = components(_links(blocks, maps.join(tokens, "cls")))
    labels = full.groupBy("cls").agg(F.min("id").alias("least"))
    labels = labels.join(links.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = labels.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(labels.join(smallest, "root").select("cls", "component"), "named")
    out = classes.join(named, "cls", "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), "row", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; all columns kept.

    Of rows of one id in a group the one with the smallest text key stays, and of rows equal
    in id and text the first by the other columns. Texts without words are groups of their
    own, and so are the texts of groups that have null ids alone. Only texts that may go are
    shuffled to meet the decision.
    """
    found = stored(near_duplicates(docs), "components")
    grouped_rows = found.where("n_shingles > 0 and component_id is not null")
    heads = grouped_rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("head"))
    heads = heads.withColumnRenamed("component_id", "c")
    judged = grouped_rows.join(heads, F.col("component_id") == F.col("c"))
    goes = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("head")))
    judged = judged.where(goes).select("doc_id", "row", F.lit(True).alias("goes"))
    twice = found.groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row", F.lit(False).alias("goes"))
    named = judged.union(twice).groupBy("doc_id", "row").agg(F.max("goes").alias("_goes"))
    own_id, own_row, key, goes, first, order = free_names(docs, "_id", "_row", "_key", "_goes", "_first", "_order")
    named = stored(named.select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("_goes").alias(goes)), "judged")
    bits = key_filter(named, own_row)
    keyed = docs.withColumn(key, text_key(F.col("text")))
    some = filtered(keyed, key, bits).join(named, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_row)), "left")
    # maps have no order: rows are put in order by what they hold as JSON
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    some = some.where(~F.coalesce(F.col(goes), F.lit(False))).withColumn(order, F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(""))
    some = some.withColumn(first, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order))).where(F.col(first) == 1)
    return filtered(keyed, key, bits, keep=False).select(docs.columns).unionByName(some.select(docs.columns))
