"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage in k words (inserted, dropped, changed).
Cut in k + 1 pieces, one piece of it must stand in the passage as it is: exact hits of
pieces propose places, and Myers' bit-parallel distance, over words, verifies them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import SIGNS, Words, combine, group_edges, rebatched, released, slices

#: Errors allowed for each word of an item, words an item needs where callers name no bound, and bytes of items sent to tasks at a time.
ERROR_SHARE = 0.2
LEAST_WORDS = 5
BLOCK_BYTES = 8 << 20
PACK_BYTES = 2 << 20


def word_hashes(texts: pa.Array) -> Words:
    """Words are runs of letters, digits and symbols beyond ASCII, A-Z in lower case, and single code points of scripts without blanks; other signs part them."""
    return Words(texts, separators=SIGNS, lower=True, scripts=True)


class Items:
    """Test items with the pieces of each, by length of piece."""

    def __init__(self, ids: list[int], texts: list[str | None], share: float = ERROR_SHARE, least: int = LEAST_WORDS):
        w = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.words, self.budget = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for d, n in enumerate(w.count.tolist()):
            if n < max(least, 1):
                continue
            words = w.hash[w.first[d] : w.first[d + 1]]
            budget = math.floor(share * n)
            k = len(self.ids)
            self.ids.append(ids[d])
            self.words.append(words)
            self.budget.append(budget)
            edges = [n * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(edges[:-1], edges[1:]):
                pieces.setdefault(b - a, []).append((int(combine(words[a:b], b - a)[0]), k, a))
        self.lengths = {}
        for length, rows in pieces.items():
            rows.sort()
            self.lengths[length] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        self.masks: dict[int, dict[int, int]] = {}

    def mask(self, k: int) -> dict[int, int]:
        """For each word of an item the bits of the places where it stands."""
        if k not in self.masks:
            places: dict[int, int] = {}
            for i, word in enumerate(self.words[k].tolist()):
                places[word] = places.get(word, 0) | 1 << i
            self.masks[k] = places
        return self.masks[k]


def best_match(mask: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern of n words to any part of a text, and where that part ends first (Myers)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, at = n, 0
    for j, word in enumerate(text):
        equal = mask.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        raised = down | ~(horizontal | up) & full
        lowered = up & horizontal
        if raised & top:
            score += 1
        elif lowered & top:
            score -= 1
        raised, lowered = raised << 1 & full, lowered << 1 & full
        up = lowered | ~(vertical | raised) & full
        down = raised & vertical
        if score < best:
            best, at = score, j + 1
    return best, at


def batch_matches(words: Words, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, distance, end word) for each text of a batch and item within its budget, the best place of each."""
    hits = []
    for length, (pieces, item, offset) in items.lengths.items():
        values = combine(words.hash, length)
        if not len(values):
            continue
        inside = words.doc[: len(values)] == words.doc[length - 1 :]
        left = np.searchsorted(pieces, values)
        found = np.flatnonzero(inside & (pieces[np.minimum(left, len(pieces) - 1)] == values))
        if not len(found):
            continue
        a, b = left[found], np.searchsorted(pieces, values[found], side="right")
        count = b - a
        at = np.repeat(found, count)
        entry = np.repeat(a - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        hits.append(np.stack([words.doc[at], item[entry], at - offset[entry]]))
    if not hits:
        return
    doc, item, start = np.concatenate(hits, axis=1)
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    pair = group_edges(doc * max(len(items.ids), 1) + item)
    for a, b in zip(pair[:-1].tolist(), pair[1:].tolist()):
        d, k = int(doc[a]), int(item[a])
        n, budget = len(items.words[k]), items.budget[k]
        first, last = int(words.first[d]), int(words.first[d + 1])
        if not budget:  # the one piece is the whole item
            at = next((s for s in start[a:b].tolist() if np.array_equal(words.hash[s : s + n], items.words[k])), None)
            if at is not None:
                yield d, k, 0, at + n - first
            continue
        best, end = budget + 1, 0
        stop = -1
        begin = None
        spans = []
        for s in start[a:b].tolist():  # places that overlap are looked at in one go
            low, high = max(first, s - budget), min(last, s + n + budget)
            if begin is None or low > stop:
                if begin is not None:
                    spans.append((begin, stop))
                begin, stop = low, high
            else:
                stop = max(stop, high)
        spans.append((begin, stop))
        for low, high in spans:
            distance, at = best_match(items.mask(k), n, words.hash[low:high].tolist())
            if distance < best:
                best, end = distance, low + at - first
        if best <= budget:
            yield d, k, best, end


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_column: str = "item_id", text_column: str = "text", *, least: int = LEAST_WORDS) -> Iterator[Items]:
    """The test items in blocks of about ``block_bytes`` of text, so what a task gets is bounded; equal rows count once."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, 2 * size // block_bytes)
    for block in range(blocks):
        table = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").toArrow()
        for part in slices(pa.RecordBatch.from_arrays([table["id"].combine_chunks(), table["text"].combine_chunks()], ["id", "text"]), limit=block_bytes) if table.num_rows else ():
            yield Items(part.column(0).to_pylist(), part.column(1).to_pylist(), least=least)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row per document row and test item found in it: id, ``item_id``, ``distance``, ``end_word``, ``item_words``.

    An item is found if some part of the text is within floor(0.2 * words) edits of words.
    The place is where the best match ends, the first of equally good ones. Items of fewer
    than ``least_words`` words match nothing; with 1 only items without words do, as in the
    query and the pipeline. Items of fewer than five words allow no edit. Null and empty texts hold nothing; null ids and repeated
    rows are searched like any other; repeated items count once.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, item_id long, distance int, end_word long, item_words int"

    def matches(items: Items):
        def search(batches):
            for batch in rebatched(batches, limit=PACK_BYTES):
                found = list(batch_matches(word_hashes(batch.column(1)), items))
                d, k, distance, end = (list(c) for c in zip(*found)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(d, pa.int64())), pa.array([items.ids[i] for i in k], pa.int64()), pa.array(distance, pa.int32()),
                        pa.array(end, pa.int64()), pa.array([len(items.words[i]) for i in k], pa.int32()),
                    ],
                    ["id", "item_id", "distance", "end_word", "item_words"],
                )

        return rows.mapInArrow(released(search), schema)

    out = None
    for items in item_blocks(benchmark, least=least_words):
        found = matches(items)
        out = found if out is None else out.union(found)
    if out is None:
        out = matches(Items([], []))
    return out.withColumnRenamed("id", id_column)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold no test item, all columns kept; texts are judged where they stand."""
    place = docs.columns.index(text_column)

    def without(items: Items):
        def keep(batches):
            for batch in rebatched(batches, place, PACK_BYTES):
                good = np.ones(batch.num_rows, bool)
                for d, *_ in batch_matches(word_hashes(batch.column(place)), items):
                    good[d] = False
                yield batch.filter(pa.array(good))

        return keep

    for items in item_blocks(benchmark, least=least_words):
        docs = docs.mapInArrow(released(without(items)), docs.schema)
    return docs
