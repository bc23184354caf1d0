"""Alignment of two tokenizers' tokens by the byte offsets where both end one.

Texts are encoded and aligned inside Arrow batches. Shared cuts are found by divide and
conquer: each interval of tokens is cut at a common end near its middle, found by bisect
among the other side's ends, and both halves are cut on; an interval without a cut is a
group. All intervals of a block go through each level together, as arrays.

How often two ids are linked in the whole corpus is counted by a shuffle. Ids come with
very uneven frequency, so the most frequent pairs (a bounded table) answer nearly all
links where they lie; the links of all other pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.common import rebatched, stored

#: Bytes of text encoded and aligned at a time, and the length of a part from which texts are split.
BLOCK_BYTES = 1 << 20
LONG_TEXT = 1 << 15
#: Signs of words whose ids a task remembers.
KNOWN_SIGNS = 4 << 20
#: Most pairs of ids that are sent to all tasks with their counts (17 bytes each).
FREQUENT_PAIRS = 1 << 18


# ---- vocabularies


def byte_level_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(c): b for c, b in [*((b, b) for b in visible), *((256 + k, b) for k, b in enumerate(hidden))]}


#: Spaces between two signs that are no blanks: neither side joins anything over one.
SAFE_SPACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


AFTER_SPACE, BEFORE_SPACE = re.compile(r" [\s▁]"), re.compile(r"[^\S ] |▁ ")
TOGETHER = 64  # words that are encoded as one text


class Vocabulary:
    """Encodes texts to ids; ``bytes[id]`` is what a token stands for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [
                bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
            ]
            self.encode = lambda texts: model.encode(texts, num_threads=1)  # which adds the space before a text
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True
            values = byte_level_values()
            entries = model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(entries.values()) + 1)
            for entry, i in entries.items():
                self.bytes[i] = bytes(values[c] for c in entry) if all(c in values for c in entry) else entry.encode()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        self.size = len(self.bytes)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, how many each has, and which words' ids don't spell a space and the word."""
        texts = [" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        flat = np.array(list(chain.from_iterable(self.encode(texts))), np.int64)
        if b"".join(map(self.bytes.__getitem__, flat.tolist())) == f" {' '.join(words)}".encode():
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            stops = np.searchsorted(np.cumsum(self.lengths[flat]), ends) + 1
            return flat, np.diff(stops, prepend=0), np.zeros(len(words), bool)
        ids = self.encode(words)
        spelled = [b"".join(map(self.bytes.__getitem__, i)) for i in ids]
        wrong = np.array([s != f" {w}".encode() for s, w in zip(spelled, words)])
        return np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64), wrong


class Encoded:
    """Ids by both vocabularies of the words that were met, each encoded once."""

    def __init__(self, sides: tuple[Vocabulary, Vocabulary]):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.signs = 0
        none = np.zeros(0, np.int64)
        self.flat, self.first, self.size = [none, none], [none, none], [none, none]
        self.wrong = np.zeros(0, bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        if self.signs > KNOWN_SIGNS:
            self.clear()
        new = list(set(words).difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.signs += sum(map(len, new))
            broken = np.zeros(len(new), bool)
            for k, side in enumerate(self.sides):
                flat, size, wrong = side.encoded(new)
                self.first[k] = np.concatenate([self.first[k], len(self.flat[k]) + np.cumsum(size) - size])
                self.size[k] = np.concatenate([self.size[k], size])
                self.flat[k] = np.concatenate([self.flat[k], flat])
                broken |= wrong
            self.wrong = np.concatenate([self.wrong, broken])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def ids(self, side: int, numbers: np.ndarray) -> np.ndarray:
        first, size = self.first[side][numbers], self.size[side][numbers]
        return self.flat[side][np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def words_of(text: str) -> list[str]:
    """What stands between safe spaces."""
    if AFTER_SPACE.search(text) or BEFORE_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return SAFE_SPACE.split(text)
    return text.split(" ")


def parts_of(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """Parts of a text, cut at spaces between two signs that are no blanks, which go.

    Neither side joins anything over such a space, and each part gets one before it
    again, so the parts' tokens are the text's. A text without such a space stays whole.
    """
    start = 0
    while len(text) - start > longest:
        cut = text.find(" ", start + longest)
        while cut != -1 and not (cut + 1 < len(text) and _plain(text[cut - 1]) and _plain(text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def _plain(sign: str) -> bool:
    return not sign.isspace() and sign != "▁"


# ---- shared cuts


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B after which both sides are cut, in order, without the last ones of the intervals.

    ``ends_a`` and ``ends_b`` rise; interval k holds the A tokens ``first[k]`` to
    ``last[k] - 1``, and both sides end with it. Every end inside is looked at once at
    least, so no shared cut is missed.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, high = first.astype(np.int64), last.astype(np.int64) - 1  # ends that may be cuts
    open_ = low < high
    low, high = low[open_], high[open_]
    while len(low):
        cut_a, cut_b = _near_middle(ends_a, ends_b, low, high)
        cut = cut_a >= 0  # the others are leaf groups
        low, high, cut_a = low[cut], high[cut], cut_a[cut]
        found_a.append(cut_a)
        found_b.append(cut_b[cut])
        low, high = np.concatenate([low, cut_a + 1]), np.concatenate([cut_a, high])
        open_ = low < high
        low, high = low[open_], high[open_]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _near_middle(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the common end nearest its middle as tokens of A and B, or -1.

    Looks at the middle, then at rings around it that double in width, so that a long
    interval without cuts takes few steps.
    """
    cut_a, cut_b = np.full(len(low), -1), np.full(len(low), -1)
    middle = (low + high) // 2
    todo = np.arange(len(low))
    inner, width = 0, 1
    while len(todo):
        m = middle[todo]
        if not inner:
            owner, tried = todo, m
        else:
            left = np.maximum(m - inner - width + 1, low[todo]), np.maximum(m - inner + 1, low[todo])
            right = np.minimum(m + inner, high[todo]), np.minimum(m + inner + width, high[todo])
            owner, tried = _ranges(np.concatenate([todo, todo]), np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]]))
        at = np.searchsorted(ends_b, ends_a[tried])  # the bisect
        common = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[tried]
        owner, tried, at = owner[common], tried[common], at[common]
        if len(owner):
            order = np.lexsort((np.abs(tried - middle[owner]), owner))
            owner, tried, at = owner[order], tried[order], at[order]
            nearest = np.concatenate([[True], owner[1:] != owner[:-1]])
            cut_a[owner[nearest]], cut_b[owner[nearest]] = tried[nearest], at[nearest]
        inner, width = (inner + width, width) if not inner else (inner + width, 2 * width)
        todo = todo[cut_a[todo] < 0]
        todo = todo[(middle[todo] - inner >= low[todo]) | (middle[todo] + inner < high[todo])]
    return cut_a, cut_b


def _ranges(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, each with its range's owner."""
    size = np.maximum(stop - start, 0)
    ramp = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(owner, size), np.repeat(start, size) + ramp


# ---- blocks of texts


@dataclass
class Aligned:
    """What is known of one text."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = None
    pairs: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    broken: bool = False


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Vocabulary(path_a), Vocabulary(path_b)
        self.words = Encoded((self.a, self.b))
        self.spelled = [f"{i}{mark}" for mark in ",|;" for i in range(max(self.a.size, self.b.size))]

    def block(self, owners: list[int], parts: list[str], known: dict[int, Aligned]) -> None:
        """Aligns parts of texts and adds what is found to their texts' entries."""
        split = [words_of(part) for part in parts]
        numbers = self.words.numbers(list(chain.from_iterable(split)))
        part_of = np.repeat(np.arange(len(parts)), list(map(len, split)))
        wrong = np.bincount(part_of, weights=self.words.wrong[numbers], minlength=len(parts)) > 0
        for k in np.flatnonzero(wrong):
            known[owners[k]].broken = True
        kept = [k for k, owner in enumerate(owners) if not known[owner].broken]
        if not kept:
            return
        whole = np.isin(part_of, kept)
        numbers, part_of = numbers[whole], part_of[whole]
        kept = [owners[k] for k in kept]
        a, b = self.words.ids(0, numbers), self.words.ids(1, numbers)
        edges = np.append(np.flatnonzero(np.diff(part_of)), len(part_of) - 1)  # the last word of each part
        last_a, last_b = (np.cumsum(size[numbers])[edges] for size in self.words.size)
        owner = np.array(kept)
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        first_a = np.concatenate([[0], last_a[:-1]])
        inside_a, inside_b = shared_cuts(ends_a, ends_b, first_a, last_a)
        group_a = np.sort(np.concatenate([inside_a, last_a - 1])) + 1  # where groups stop
        group_b = np.sort(np.concatenate([inside_b, last_b - 1])) + 1

        is_cut = np.zeros(len(a) + 1, bool)
        is_cut[group_a] = True
        reach = np.searchsorted(ends_b, ends_a)  # the B token in which an A token ends
        begin = np.concatenate([[0], reach[:-1] + is_cut[1:-1]])
        of_link, link_b = _ranges(np.arange(len(a)), begin, reach + 1)
        text_of_a = np.repeat(owner, np.diff(np.concatenate([[0], last_a])))
        keys, counts = np.unique((text_of_a[of_link] << 40) | (a[of_link] * self.b.size + b[link_b]), return_counts=True)
        texts, starts = np.unique(keys >> 40, return_index=True)
        stops = np.append(starts[1:], len(keys))

        spelled = self._spelled(a, b, group_a, group_b)
        links = np.add.reduceat(reach + 1 - begin, first_a)
        groups = np.searchsorted(group_a, last_a, side="right")
        at_group = at_a = at_b = 0
        for k, text in enumerate(kept):
            entry = known[text]
            piece = "".join(map(self.spelled.__getitem__, spelled[at_a + at_b : last_a[k] + last_b[k]].tolist()))[:-1]
            if entry.digest is None:
                entry.digest = hashlib.sha256()
            else:
                entry.digest.update(b";")
            entry.digest.update(piece.encode())
            entry.n_a += int(last_a[k] - at_a)
            entry.n_b += int(last_b[k] - at_b)
            entry.n_groups += int(groups[k] - at_group)
            entry.n_links += int(links[k])
            at_a, at_b, at_group = last_a[k], last_b[k], groups[k]
        for text, start, stop in zip(texts.tolist(), starts, stops):
            known[text].pairs.append(keys[start:stop] & ((1 << 40) - 1))
            known[text].counts.append(counts[start:stop])

    def _spelled(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """Both sides' tokens in the order of their groups, as places in ``spelled``."""
        size = len(self.spelled) // 3
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[group_a - 1], mark_b[group_b - 1] = 1, 2
        sizes_a, sizes_b = np.diff(np.concatenate([[0], group_a])), np.diff(np.concatenate([[0], group_b]))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(group_b - sizes_b, sizes_a)] = a + size * mark_a
        out[np.arange(len(b)) + np.repeat(group_a, sizes_b)] = b + size * mark_b
        return out

    def aligned(self, texts: list[str | None]) -> list[Aligned]:
        known = {i: Aligned() for i in range(len(texts))}
        owners: list[int] = []
        parts: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            for part in parts_of(text) if text else ():
                owners.append(i)
                parts.append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    self.block(owners, parts, known)
                    owners, parts, size = [], [], 0
        if parts:
            self.block(owners, parts, known)
        for i, entry in known.items():
            if entry.broken:
                known[i] = Aligned(broken=True)
            elif len(entry.pairs) > 1:
                pairs, place = np.unique(np.concatenate(entry.pairs), return_inverse=True)
                entry.pairs = [pairs]
                entry.counts = [np.bincount(place, weights=np.concatenate(entry.counts)).astype(np.int64)]
        return [known[i] for i in range(len(texts))]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(path_a, path_b)


def _lists(values: list[list[np.ndarray]], kind: pa.DataType) -> pa.Array:
    flat = [v[0] for v in values if v]
    ends = np.cumsum([0, *(len(v[0]) if v else 0 for v in values)]).astype(np.int32)
    joined = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(joined, kind))


def aligned_texts(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``row`` (a number of its own), ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs``, ``counts``.

    ``pairs`` holds each different pair of linked ids once, as A id * B's size + B id, ``counts`` how often it is linked.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def aligned(batches):
        both = aligner(path_a, path_b)
        for batch in rebatched(batches):
            found = both.aligned(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    batch.column(0),
                    *(pa.array([getattr(t, name) for t in found], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array([t.digest.hexdigest() if t.digest else "" for t in found]),
                    _lists([t.pairs for t in found], pa.int64()),
                    _lists([t.counts for t in found], pa.int32()),
                ],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"],
            )

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"
    return rows.mapInArrow(aligned, schema)


# ---- counts over the corpus


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n`` (links in all texts), ``best`` (no other pair of its B id has more).

    Pairs are added up in each task before the shuffle. A B id has at most as many rows
    as A has ids.
    """
    counted = texts.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    of_b = Window.partitionBy(F.pmod("pair", F.lit(size_b)))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _frequency(n: str):
    return F.floor(8 * F.log2(F.col(n))).cast("int")


def frequent_pairs(pairs: DataFrame, most: int = FREQUENT_PAIRS) -> tuple[pa.Table, int]:
    """The pairs of the highest frequencies, at most ``most``, sorted, and the frequency class from which all are there."""
    classes = sorted(((r["f"], r["count"]) for r in pairs.groupBy(_frequency("n").alias("f")).count().collect()), reverse=True)
    least, held = 1 << 30, 0
    for f, count in classes:
        if held + count > most:
            break
        least, held = f, held + count
    return pairs.where(_frequency("n") >= least).toArrow().sort_by("pair"), least


def token_alignment(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    most_frequent: int = FREQUENT_PAIRS,
) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``path_a`` is a byte-level ``.json`` file, ``path_b`` a ``.model`` file, both on every
    executor. Null and empty texts, and texts whose tokens don't spell a space and the
    text again, have no tokens: zeros and ''. Repeated rows and null ids are aligned and
    counted like any other row; ties for a B id's highest count are all best. An empty
    table gives no rows. Other columns are not read. ``most_frequent`` bounds the pairs
    that are sent to all tasks; whatever it is, the result is the same.
    """
    size_b = Vocabulary(path_b).size
    texts = stored(aligned_texts(docs, path_a, path_b, id_column, text_column), "aligned")
    pairs = stored(pair_counts(texts, size_b), "pair-counts")
    frequent, least = frequent_pairs(pairs, most_frequent)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))

    def resolved(batches):
        known, n, best = sent.value
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            pair, count = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(known):
                np.add.at(n_best, text[hit], count[hit] * best[at[hit]])
                np.add.at(total, text[hit], count[hit] * n[at[hit]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (pair[~hit], count[~hit])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total), *rest], ["row", "n_best", "total", "pair", "n"])

    schema = "row long, n_best long, total long, pair array<long>, n array<long>"
    parts = stored(texts.select("row", "pairs", "counts").mapInArrow(resolved, schema), "resolved")
    rare = parts.select("row", F.inline(F.arrays_zip("pair", "n"))).withColumnRenamed("n", "links")
    rare = rare.join(pairs.where(_frequency("n") < least), "pair")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("total")
    )
    added = parts.select("row", "n_best", "total").union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("total").alias("count_sum"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return texts.drop("pairs", "counts").join(added, "row").select(F.col("id").alias(id_column), *columns)
