"""Embedding near-dedup: an exact metric range join over pivot cells.

Unit vectors lie at distance sqrt(2 - 2 cos), so a cosine bound is a distance bound r.
Every vector belongs to the cell of its nearest pivot and is stored once, in a file by
cell. Two cells are joined on what of them can be within r: along the line through their
pivots, vectors within r lie within r as well, while those at home in two cells lie on
two sides of the middle. Cells whose pivots are over r and both radii apart don't meet.
What is left is compared on the few directions that hold most of the vectors; the lengths
of the rest bound what it can add to a cosine, so whole vectors are only read of near pairs.
A task holds one block of cells and reads the others from the store, a block at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import group_edges, released, spread, stored
from lakemart.llm.components import components
from lakemart.llm.warc import file_system
from lakemart.session import work_folder

#: Vectors a cell should hold, the most pivots and their bytes, and the bytes of vectors in a block.
CELL_ROWS = 4_000
MOST_PIVOTS = 4_096
PIVOT_BYTES = 8 << 20
SIDE_BYTES = 1 << 24
#: Vectors that are looked at where there are enough, besides twice as many as pivots.
LEAST_SAMPLE = 512
#: Vectors that a block holds at least where there are enough, blocks that these are cut in, and the most cells of a block.
LEAST_SIDE = 512
LEAST_BLOCKS = 36
BLOCK_CELLS = 128
#: Rows and columns of cosines taken at once, and numbers in other matrices of a task.
TILE_ROWS, TILE_COLUMNS = 128, 4_096
CHUNK = 1 << 22
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows, in the column's precision."""
    flat = np.asarray(column.flatten())
    flat = flat if flat.dtype == np.float32 else flat.astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length 1, in double precision."""
    rows = matrix(column).astype(np.float64)
    if len(rows):
        rows = rows / np.abs(rows).max(axis=1)[:, None]
        rows /= np.sqrt(np.square(rows).sum(axis=1))[:, None]
    return rows


def band(length: int) -> float:
    """More than a cosine of vectors of that length is off in single precision."""
    return (length + 16) * 2.0**-22


@dataclass
class Cells:
    """Pivots of one vector length, in single precision, and where the blocks of their cells are stored."""

    pivots: np.ndarray
    reach: float
    #: Orthonormal directions to compare vectors on first, as columns, if that pays.
    turn: np.ndarray | None = None
    #: For each cell its first block and the number of blocks it is cut in.
    first: np.ndarray | None = None
    parts: np.ndarray | None = None
    #: Blocks by number, and the core of each cell: rows with copies, and the smallest class.
    blocks: dict[int, Place] = field(default_factory=dict)
    copies: np.ndarray | None = None
    least: np.ndarray | None = None

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row of length 1 and the cosine to its pivot."""
        home, own = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.float32)
        step = max(1, CHUNK // len(self.pivots))
        for start in range(0, len(rows), step):
            cosine = rows[start : start + step].astype(np.float32) @ self.pivots.T
            best = cosine.argmax(axis=1)
            home[start : start + step], own[start : start + step] = best, cosine[np.arange(len(best)), best]
        return home, own

    def core(self, own: np.ndarray) -> np.ndarray:
        """Whether rows lie within r / 2 of their pivot: any two such rows of a cell are linked."""
        return own >= 1 - self.reach**2 / 8 + band(self.pivots.shape[1])


@dataclass
class Place:
    """Where a block is stored, and of its cells in order: number, rows, rows outside the core, radius."""

    file: str
    cells: np.ndarray
    rows: np.ndarray
    shell: np.ndarray
    radius: np.ndarray


def choose_pivots(sample: np.ndarray, count: int, reach: float) -> np.ndarray:
    """Up to ``count`` rows of the sample, each over r from those before, so that a dense group has one pivot."""
    chosen = [0]
    nearest = sample @ sample[0]
    for i in range(1, len(sample)):
        if len(chosen) >= count:
            break
        if 2 - 2 * nearest[i] > reach**2:
            chosen.append(i)
            nearest = np.maximum(nearest, sample @ sample[i])
    return sample[chosen]


def choose_turn(sample: np.ndarray, threshold: float) -> np.ndarray | None:
    """The first directions by how much of the sample they hold, as many as make comparing cheapest; none for short vectors."""
    length = sample.shape[1]
    if length <= 16 or len(sample) < 32:
        return None
    turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    some = sample[:512]
    cosine, turned = (some @ some.T)[np.triu_indices(len(some), 1)], some @ turn
    near = (cosine >= np.quantile(cosine, 0.9)) & (cosine < threshold)
    # ns for a pair: a product of that many numbers, and a pair that is looked at as a whole, mostly the only one at hand
    best, least = None, 0.8 * length / 22
    for m in sorted({m for k in range(3, 11) for m in (1 << k, 3 << k - 1) if m < length}):
        held = turned[:, :m]
        rest = np.sqrt(np.maximum(1 - np.square(held).sum(axis=1), 0))
        bound = (held @ held.T + np.outer(rest, rest))[np.triu_indices(len(some), 1)]
        cost = (m + 1) / 22 + (bound[near] >= threshold).mean() * (10_000 + 2 * length) if near.any() else least
        if cost < least:
            best, least = m, cost
    return None if best is None else np.ascontiguousarray(turn[:, :best]).astype(np.float32)


def _cells_for(classes: DataFrame, reach: float, threshold: float) -> dict[int, Cells]:
    """Cells for each vector length, from a sample of at most twice MOST_PIVOTS vectors by hash order."""
    cells = {}
    for length, rows in classes.groupBy("length").count().collect():
        wanted = int(min(MOST_PIVOTS, max(1, PIVOT_BYTES // (4 * length)), max(1, rows // CELL_ROWS)))
        key, take = F.xxhash64("cls"), max(2 * wanted, LEAST_SAMPLE)
        # of many rows only some twice those to take are sorted
        some = F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, (2 * take + 1_000) / rows))
        picked = classes.where((F.col("length") == length) & some).orderBy(key).limit(take).select("v").toArrow()
        sample = unit_rows(picked["v"].combine_chunks())
        cells[length] = Cells(choose_pivots(sample, wanted, reach).astype(np.float32), reach, choose_turn(sample, threshold))
    return cells


def _by_length(batch: pa.RecordBatch):
    lengths = np.asarray(batch.column("length"))
    for length in np.unique(lengths):
        yield int(length), batch.filter(pa.array(lengths == length))


def _lay_out(classes: DataFrame, cells: dict[int, Cells], tasks: int) -> int:
    """Gives each cell its blocks, from the number of its rows; returns the number of blocks.

    Small cells share a block, large ones are cut in parts by hash.
    """

    def counted(batches):
        for batch in batches:
            for length, part in _by_length(batch):
                seen, rows = np.unique(cells[length].home(unit_rows(part.column("v")))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), length, np.int32)), pa.array(seen), pa.array(rows)], ["length", "cell", "rows"])

    counts = {length: np.zeros(len(c.pivots), np.int64) for length, c in cells.items()}
    for length, cell, rows in classes.mapInArrow(released(counted), "length int, cell int, rows long").groupBy("length", "cell").agg(F.sum("rows")).collect():
        counts[length][cell] = rows
    block = 0
    for length in sorted(cells):
        rows = counts[length]
        side = max(128, min(SIDE_BYTES // (4 * length), max(LEAST_SIDE, int(rows.sum()) // tasks)))
        parts = np.maximum(-(-rows // side), 1)
        first = np.zeros(len(rows), np.int64)
        held = shared = 0
        for cell, (size, cut) in enumerate(zip(rows.tolist(), parts.tolist())):
            if shared and (cut > 1 or held + size > side or shared >= BLOCK_CELLS):
                block, held, shared = block + 1, 0, 0
            first[cell] = block
            held, shared = held + size, shared + 1
            if cut > 1:
                block, held, shared = block + cut, 0, 0
        block += shared > 0
        cells[length].first, cells[length].parts = first, parts
    return block


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a power of two, so that nothing is lost, and their lengths then."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    rows = np.ldexp(rows, -exponent[:, None])
    return rows, np.sqrt(np.square(rows.astype(np.float64)).sum(axis=1))


#: What a block holds of each row before the vectors.
HEAD = [("cell", "<i4"), ("core", "?"), ("cls", "<i8"), ("n", "<i8"), ("own", "<f4"), ("norm", "<f8")]


def _packed(columns: dict[str, np.ndarray], vectors: np.ndarray) -> bytes:
    return b"".join([*(columns[name].astype(kind, copy=False).tobytes() for name, kind in HEAD), vectors.tobytes()])


def _unpacked(data, length: int, kind: np.dtype) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n = len(data) // (sum(np.dtype(k).itemsize for _, k in HEAD) + length * kind.itemsize)
    out, at = {}, 0
    for name, k in HEAD:
        out[name] = np.frombuffer(data, k, n, at)
        at += n * np.dtype(k).itemsize
    return out, np.frombuffer(data, kind, n * length, at).reshape(n, length)


def _store_blocks(classes: DataFrame, cells: dict[int, Cells], folder: str) -> None:
    """Writes each block to a file, its rows by cell, those outside the core first.

    Core and radius are taken from what is written, so a row is never counted differently than it is joined.
    """
    kind = _kind(classes)

    def packed(batches):
        for batch in batches:
            for length, part in _by_length(batch):
                held = cells[length]
                vectors, norm = _scaled(matrix(part.column("v")))
                cell, own = held.home(vectors / norm[:, None])
                cls = np.asarray(part.column("cls"))
                number = held.first[cell] + (cls.view(np.uint64) >> np.uint64(3)).astype(np.int64) % held.parts[cell]
                order = np.argsort(number, kind="stable")
                columns = {"cell": cell, "core": held.core(own), "cls": cls, "n": np.asarray(part.column("n")), "own": own, "norm": norm}
                edges = group_edges(number[order]).tolist()
                data = [_packed({name: c[order[a:b]] for name, c in columns.items()}, vectors[order[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data), length, np.int32)), pa.array(number[order[edges[:-1]]].astype(np.int32)), pa.array(data, pa.binary())], ["length", "block", "data"]
                )

    def write(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        current, bundles = None, []

        def close():
            if current is None:
                return
            length, block = current
            read = [_unpacked(data, length, kind) for data in bundles]
            columns = {name: np.concatenate([c[name] for c, _ in read]) for name, _ in HEAD}
            order = np.lexsort((columns["cls"], columns["core"], columns["cell"]))
            columns = {name: c[order] for name, c in columns.items()}
            name = f"{uuid.uuid4().hex}.cells"  # another one for each attempt of a task
            with fs.open_output_stream(f"{path}/{name}", compression=None) as stream:
                for column, k in HEAD:
                    stream.write(columns[column].astype(k, copy=False).tobytes())
                vectors = np.concatenate([v for _, v in read])
                del read
                for start in range(0, len(order), 4_096):
                    stream.write(vectors[order[start : start + 4_096]].tobytes())
            edges = group_edges(columns["cell"])
            starts, rows = edges[:-1], np.diff(edges)
            core = columns["core"].astype(np.int64)
            least = np.minimum.reduceat(np.where(columns["core"], columns["cls"], np.iinfo(np.int64).max), starts)
            low = np.minimum.reduceat(columns["own"], starts).astype(np.float64) - band(length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), length, np.int32)), pa.array(np.full(len(rows), block, np.int32)), pa.array([name] * len(rows)), pa.array(columns["cell"][starts]), pa.array(rows),
                    pa.array(rows - np.add.reduceat(core, starts)), pa.array(np.sqrt(np.maximum(2 - 2 * low, 0))), pa.array(np.add.reduceat(core * columns["n"], starts)), pa.array(least),
                ],
                ["length", "block", "file", "cell", "rows", "shell", "radius", "copies", "least"],
            )

        for batch in batches:
            for length, block, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (length, block) != current:
                    yield from close() or ()
                    current, bundles = (length, block), []
                bundles.append(data)
        yield from close() or ()

    rows = spread(classes.mapInArrow(released(packed), "length int, block int, data binary"), "block").sortWithinPartitions("block")
    written = rows.mapInArrow(released(write), "length int, block int, file string, cell int, rows long, shell long, radius double, copies long, least long")
    for c in cells.values():
        c.copies, c.least = np.zeros(len(c.pivots), np.int64), np.full(len(c.pivots), np.iinfo(np.int64).max)
    found = written.toArrow().sort_by([("block", "ascending"), ("cell", "ascending")]).combine_chunks()
    at = {name: np.asarray(found[name]) for name in found.column_names if name != "file"}
    files = found["file"].to_pylist()
    edges = group_edges(at["block"]).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        held = cells[int(at["length"][a])]
        held.blocks[int(at["block"][a])] = Place(files[a], *(at[name][a:b] for name in ("cell", "rows", "shell", "radius")))
        np.add.at(held.copies, at["cell"][a:b], at["copies"][a:b])
        np.minimum.at(held.least, at["cell"][a:b], at["least"][a:b])


def _kind(classes: DataFrame) -> np.dtype:
    return np.dtype(np.float32 if dict(classes.dtypes)["v"] == "array<float>" else np.float64)


class Block:
    """A stored block in memory: vectors by cell, as they were scaled, and their columns."""

    def __init__(self, fs, path: str, held: Cells, place: Place, kind: np.dtype):
        self.length = held.pivots.shape[1]
        with fs.open_input_file(f"{path}/{place.file}") as stream:
            self.columns, self.vectors = _unpacked(stream.read_buffer(), self.length, kind)
        self.cells, self.radius, self.pivots = place.cells, place.radius, held.pivots[place.cells]
        self.edges = np.concatenate(([0], np.cumsum(place.rows)))
        self.core = self.edges[:-1] + place.shell
        self.inverse = (1 / self.columns["norm"]).astype(np.float32)
        self.own, self.turn = self.columns["own"], held.turn
        self.head = self._head()

    def __len__(self) -> int:
        return len(self.inverse)

    def unit(self, rows) -> np.ndarray:
        """Rows of length 1 in single precision."""
        return (self.vectors[rows] * self.inverse[rows, None]).astype(np.float32, copy=False)

    def _head(self) -> np.ndarray:
        """Rows whose products are no less than the cosines: along the first directions, and the length of the rest."""
        if self.turn is None:
            return self.unit(slice(None))
        out = np.empty((len(self), self.turn.shape[1] + 1), np.float32)
        step = max(1, CHUNK // self.length)
        for start in range(0, len(self), step):
            held = self.unit(slice(start, start + step)) @ self.turn
            out[start : start + step, :-1] = held
            out[start : start + step, -1] = np.sqrt(np.maximum(1 + band(self.length) - np.square(held).sum(axis=1), 0))
        return out

    def exact(self, rows) -> np.ndarray:
        return self.vectors[rows].astype(np.float64) / self.columns["norm"][rows, None]


def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x and y, pair by pair; the root of a tree is its least node."""
    while len(x):
        for nodes in (x, y):
            root = parent[nodes]
            while (parent[root] != root).any():
                root = parent[root]
            parent[nodes] = root
        a, b = parent[x], parent[y]
        differ = a != b
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _set(mask: np.ndarray) -> np.ndarray:
    """Where a matrix is set, as places of its rows one after the other; most of it is not."""
    flat = mask.ravel()
    even = len(flat) & ~7
    words = np.flatnonzero(flat[:even].view(np.uint64))
    if len(words) * 16 > len(flat):
        return np.flatnonzero(flat)
    places = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate((places[flat[places]], even + np.flatnonzero(flat[even:])))


class Join:
    """A block that is held against itself and others; ``links`` and ``parent`` tell what was found for its rows."""

    def __init__(self, held: Cells, block: Block, threshold: float):
        self.held, self.a, self.threshold = held, block, threshold
        self.off = band(block.length)
        self.rows = block.head if block.turn is None else block.unit(slice(None))
        self.cell = np.repeat(np.arange(len(block.cells)), np.diff(block.edges))
        self.links = np.zeros(len(block), np.int64)
        self.parent = np.arange(len(block))

    def against(self, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links and parents (among the rows of both blocks) of the rows of another block, or of this one (``same``)."""
        a = self.a
        links = self.links if same else np.zeros(len(b), np.int64)
        parent = self.parent if same else np.concatenate((self.parent, np.arange(len(a), len(a) + len(b))))
        apart = np.sqrt(np.maximum(2 - 2 * (a.pivots.astype(np.float64) @ b.pivots.astype(np.float64).T), 0))
        equal = a.cells[:, None] == b.cells[None, :]
        far = ~equal & (apart > a.radius[:, None] + b.radius[None, :] + self.held.reach + SLACK)
        if same:
            far |= np.tri(len(a.cells), k=-1, dtype=bool)  # two cells of the block meet once
        apart = np.maximum(np.where(equal, 1, apart), 1e-3)

        def found(x, y):
            for at in range(0, len(x), CHUNK // 4):
                i, j = x[at : at + CHUNK // 4], y[at : at + CHUNK // 4]
                self.links += np.bincount(i, b.columns["n"][j], len(a)).astype(np.int64)
                links[:] += np.bincount(j, a.columns["n"][i], len(b)).astype(np.int64)
                _unite(parent, i, j if same else j + len(a))

        met = np.flatnonzero(~far.all(axis=0))
        group = max(1, CHUNK // len(a))
        for first in range(0, len(met), group):
            cosines = b.pivots[met[first : first + group]] @ self.rows.T
            for k, cosine in zip(met[first : first + group].tolist(), cosines):
                lo, hi = int(b.edges[k]), int(b.edges[k + 1])
                for c in np.flatnonzero(equal[:, k] & ~far[:, k]).tolist():
                    self._whole(c, b, k, same, found)
                near = np.flatnonzero(~far[:, k] & ~equal[:, k])
                if not len(near):
                    continue
                width = apart[:, k].astype(np.float32)
                before = (a.own - cosine) / width[self.cell]
                step = max(1, CHUNK // len(near))
                for start in range(lo, hi, step):
                    self._between(near, width, before, b, start, min(start + step, hi), found)
        if not same:
            self.parent = parent[: len(a)].copy()
        return links, parent

    def _between(self, near, apart, before, b: Block, lo: int, hi: int, found) -> None:
        """Rows of the cells ``near`` against rows lo to hi of the other block, which are of one cell.

        Of both the place along the line through the two pivots is known, as the distance
        ``before`` and ``beyond`` the middle: of two rows within r these add up to r at most.
        """
        a = self.a
        inverse = b.inverse[lo:hi]
        vectors = b.vectors[lo:hi].astype(np.float32, copy=False)
        beyond = (b.own[lo:hi] - (a.pivots[near] @ vectors.T) * inverse) / apart[near, None]
        limit = np.full(len(a.cells), -np.inf, np.float32)
        limit[near] = self.held.reach + SLACK + 4 * self.off / apart[near]
        most = limit.copy()
        most[near] -= beyond.min(axis=1)
        able = np.flatnonzero(before <= most[self.cell])
        cuts = np.searchsorted(able, a.edges)
        for c, row in zip(near.tolist(), beyond):
            x = able[cuts[c] : cuts[c + 1]]
            if not len(x):
                continue
            order = np.argsort(before[x])
            x = x[order]
            reach = limit[c] - before[x]
            y = np.flatnonzero(row <= reach[0])
            y = y[np.argsort(row[y])]
            if not len(y):
                continue
            stops = np.searchsorted(row[y], reach[::TILE_ROWS], side="right")
            y += lo
            head = b.head[y]
            for start, stop in zip(range(0, len(x), TILE_ROWS), stops.tolist()):
                for left in range(0, stop, TILE_COLUMNS):
                    right = min(left + TILE_COLUMNS, stop)
                    self._tile(x[start : start + TILE_ROWS], b, y[left:right], head[left:right], found)

    def _whole(self, c: int, b: Block, k: int, same: bool, found) -> None:
        """A cell against itself or another part of it, without the pairs inside the core, which are counted as a whole."""
        a = self.a
        begin, core, end = int(a.edges[c]), int(a.core[c]), int(a.edges[c + 1])
        for start in range(begin, end, TILE_ROWS):
            x = np.arange(start, min(start + TILE_ROWS, end))
            for part in (x[x < core], x[x >= core]):
                if not len(part):
                    continue
                inside = part[0] >= core
                if same and inside:
                    break  # met as the other side of rows outside the core
                lo, hi = (start if same else int(b.edges[k])), int(b.core[k] if inside else b.edges[k + 1])
                for left in range(lo, hi, TILE_COLUMNS):
                    right = min(left + TILE_COLUMNS, hi)
                    self._tile(part, b, np.arange(left, right), b.head[left:right], found, later=same)

    def _tile(self, x: np.ndarray, b: Block, y: np.ndarray, head: np.ndarray, found, later: bool = False) -> None:
        """Finds the linked pairs of some rows; where single precision leaves it open, in double precision."""
        least = self.threshold - self.off
        cosine = self.a.head[x] @ head.T
        hits = _set(cosine >= (least if b.turn is None else least - self.off))
        if not len(hits):
            return
        if b.turn is not None and len(hits) * 16 > cosine.size:
            cosine = self.rows[x] @ b.unit(y).T
            hits = _set(cosine >= least)
            value = cosine.ravel()[hits]
        elif b.turn is not None:
            value = np.concatenate([np.einsum("ij,ij->i", self.rows[x[h // len(y)]], b.unit(y[h % len(y)])) for h in np.array_split(hits, -(-len(hits) * b.length // CHUNK))])
        else:
            value = cosine.ravel()[hits]
        keep = value >= least
        hits, value = hits[keep], value[keep]
        i, j = x[hits // len(y)], y[hits % len(y)]
        if later:
            after = j > i
            i, j, value = i[after], j[after], value[after]
        keep = value >= self.threshold + self.off
        open_ = np.flatnonzero(~keep)
        step = max(1, CHUNK // 8 // self.a.length)
        for at in range(0, len(open_), step):
            p = open_[at : at + step]
            keep[p] = np.einsum("ij,ij->i", self.a.exact(i[p]), b.exact(j[p])) >= self.threshold
        found(i[keep], j[keep])


def _join_blocks(spark, cells: dict[int, Cells], blocks: int, folder: str, kind: np.dtype, threshold: float) -> DataFrame:
    """Rows (cls, links, root): links found and a class that the row's class is linked with, by whatever way."""
    index = spark.sparkContext.broadcast(cells)

    def rows_of(cls, links, root, touched):
        return pa.RecordBatch.from_arrays([pa.array(cls[touched]), pa.array(links[touched]), pa.array(root[touched])], ["cls", "links", "root"])

    def joined(batches):
        fs, path = file_system(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                held = next((c for c in index.value.values() if number in c.blocks), None)
                if held is None:  # all its rows are in other blocks
                    continue
                yield from meet(fs, path, held, number)

    def meet(fs, path, held: Cells, number: int) -> Iterator[pa.RecordBatch]:
        numbers = sorted(held.blocks)
        place, n = numbers.index(number), len(numbers)
        a = Block(fs, path, held, held.blocks[number], kind)
        join = Join(held, a, threshold)
        join.against(a, True)
        cls = a.columns["cls"]
        for step in range(1, n // 2 + 1):
            other = (place + step) % n
            if 2 * step == n and other < place:  # two blocks meet once
                continue
            target = held.blocks[numbers[other]]
            if not _meet(held, a, target):
                continue
            b = Block(fs, path, held, target, kind)
            links, parent = join.against(b, False)
            touched = np.flatnonzero(links)
            if len(touched):
                names = np.concatenate((cls, b.columns["cls"]))
                root = parent[len(a) :]
                while (parent[root] != root).any():
                    root = parent[root]
                yield rows_of(b.columns["cls"], links, names[root], touched)
        root = join.parent
        while (join.parent[root] != root).any():
            root = join.parent[root]
        touched = np.flatnonzero(join.links)
        yield rows_of(cls, join.links, cls[root], touched)
        core = np.flatnonzero(a.columns["core"])
        cell = a.columns["cell"][core]
        yield rows_of(cls[core], held.copies[cell] - a.columns["n"][core], held.least[cell], slice(None))

    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(released(joined), "cls long, links long, root long")


def _meet(held: Cells, a: Block, place: Place) -> bool:
    """Whether some cell of the block can hold a vector within r of one in the other."""
    apart = np.sqrt(np.maximum(2 - 2 * (a.pivots.astype(np.float64) @ held.pivots[place.cells].astype(np.float64).T), 0))
    return bool((apart <= a.radius[:, None] + place.radius[None, :] + held.reach + SLACK).any())


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: id, ``n_links`` (other rows with cosine >= threshold), ``component_id``, ``kept``.

    The component is the smallest id reachable by links, the row itself included; a row is
    kept if that is its own id. Equal vectors are one class with a count, so copies are never
    paired. Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor do vectors of different length. Null ids take part; a component of null
    ids alone has a null id. Repeated rows are rows of their own. Pivots come from a sample
    of at most 2 * MOST_PIVOTS vectors, which bounds what is sent to tasks; the result does
    not depend on it.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    base = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    base = base.withColumn("cls", F.when(usable(F.col("v")), F.xxhash64(F.size("v"), F.col("v"))))
    classes = base.where("cls is not null").groupBy("cls", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("length", F.size("v")), "classes")
    cells = _cells_for(classes, reach, threshold)
    spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession, "cells")
    blocks = _lay_out(classes, cells, max(LEAST_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    _store_blocks(classes, cells, folder)
    found = stored(_join_blocks(spark, cells, blocks, folder, _kind(classes), threshold), "links")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "rep", "n").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    per_class = stored(named.join(smallest, "root").join(sums, "cls", "left").select("cls", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    out = base.drop("v").join(per_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )
