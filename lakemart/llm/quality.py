"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import Words, byte_set, rebatched, released, stored

#: The statistics of a text, in the order of a row of ``statistics``.
NAMES = (
    "words", "word_length", "upper", "digits", "signs", "marks", "bars", "exclaims", "capital_words",
    "same_as_before", "same_as_two_before", "distinct", "long_words", "lines", "short_lines", "same_line", "word_ends", "other_bytes",
)
D = len(NAMES)
SEPARATORS = b"|"
ODD = b"#$%&*@^~<>{}[]=_\\"
#: Text whose statistics are taken at a time; running sums over its bytes take many times that.
PACK_BYTES = 1 << 20


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; shares are on a log-odds-like scale, lengths on a log scale."""
    w = Words(texts)
    data, n, hashes = w.data, w.n, w.hash
    size = np.maximum(np.diff(w.offsets), 1)
    count = w.count
    words = np.maximum(count, 1)
    of = lambda flags: np.bincount(w.doc, weights=flags, minlength=n) if len(flags) else np.zeros(n)
    length = (w.end - w.begin).astype(float)
    upper = byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")[data]
    letters = upper | byte_set(b"abcdefghijklmnopqrstuvwxyz")[data]
    uppers = np.concatenate(([0], np.cumsum(upper)))
    before = lambda k: np.concatenate((np.zeros(min(k, len(hashes)), bool), (hashes[k:] == hashes[:-k]) & (w.doc[k:] == w.doc[:-k])))
    order = np.lexsort((hashes, w.doc))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n) if len(order) else np.zeros(n)
    lines = Words(texts, separators=b"\n")
    line_hash = lines.hash
    line_same = np.zeros(len(line_hash), bool)
    if len(line_hash):
        o = np.lexsort((line_hash, lines.doc))
        line_same[o[1:]] = (line_hash[o][1:] == line_hash[o][:-1]) & (lines.doc[o][1:] == lines.doc[o][:-1])
    line_count = np.maximum(lines.count, 1)
    line_of = lambda flags: np.bincount(lines.doc, weights=flags, minlength=n) if len(flags) else np.zeros(n)
    last = data[w.end - 1] if len(w.end) else data[:0]
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0) + 1e-3)
    columns = (
        np.log1p(count),
        of(length) / words,
        share(_sums(upper, w.offsets), size),
        share(_sums(byte_set(b"0123456789")[data], w.offsets), size),
        share(_sums(byte_set(ODD)[data], w.offsets), size),
        share(_sums(byte_set(b".,;:")[data], w.offsets), words),
        share(_sums(byte_set(SEPARATORS)[data], w.offsets), words),
        share(_sums(byte_set(b"!?")[data], w.offsets), words),
        share(of((uppers[w.end] - uppers[w.begin] >= 0.5 * length) & (length > 1)), words),
        share(of(before(1)), words),
        share(of(before(2)), words),
        np.log((distinct + 0.5) / (words + 0.5)) / np.log(words + 2.0),
        share(of(length > 12), words),
        np.log1p(lines.count),
        share(line_of((lines.end - lines.begin) < 20), line_count),
        share(line_of(line_same), line_count),
        share(of(byte_set(ODD + b"!")[last]), words),
        share(_sums(~letters & (data < 128) & ~byte_set(b" \n.,")[data], w.offsets), size),
    )
    return np.stack(columns, axis=1).astype(np.float64)


class Discriminant:
    """Two Gaussian classes with shrunk covariances; scores from differences of log densities.

    Each covariance is drawn towards the pooled one and then towards its own diagonal mean,
    so it can be inverted also where a statistic is constant in a class. The Cholesky
    factors are computed once; a score costs two triangular products.
    """

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, round_shape: float = 0.02):
        total = sum(m[0] for m in moments.values())
        self.constant = None if len(moments) == 2 else float(next(iter(moments), 1))
        if self.constant is not None:
            return
        means = {c: s / n for c, (n, s, _) in moments.items()}
        covariances = {c: ss / n - np.outer(means[c], means[c]) for c, (n, _, ss) in moments.items()}
        common = sum(covariances[c] * moments[c][0] for c in moments) / total
        grand = sum(moments[c][1] for c in moments) / total
        spread = sum(moments[c][2] for c in moments) / total - np.outer(grand, grand)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))  # statistics are compared in units of their spread
        self.grand, self.scale, self.classes = grand, scale, {}
        for c, (n, _, _) in moments.items():
            shape = ((1 - pooled) * covariances[c] + pooled * common) / np.outer(scale, scale)
            shape = (1 - round_shape) * shape + round_shape * np.eye(len(scale)) * max(np.trace(shape) / len(scale), 1e-3)
            factor = np.linalg.cholesky(shape)
            inverse = np.linalg.inv(factor)
            constant = np.log(n / total) - np.log(np.diag(factor)).sum()
            self.classes[c] = ((means[c] - grand) / scale, inverse, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.grand) / self.scale
        density = {}
        for c, (mean, inverse, constant) in self.classes.items():
            density[c] = constant - 0.5 * np.square((z - mean) @ inverse.T).sum(axis=1)
        return np.round(1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60))), 9)


def held_out(id_column: str):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``x`` (the statistics, an array of doubles) of every row; a null text counts as empty."""

    def rows(batches):
        for batch in rebatched(batches, limit=PACK_BYTES):
            x = statistics(batch.column(1)) if batch.num_rows else np.zeros((0, D))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "x"])

    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return source.mapInArrow(released(rows), f"id {dict(source.dtypes)['id']}, x array<double>")


def fit(statistics_of: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Discriminant:
    """A discriminant from all labelled rows that are not held out.

    Labels other than 0 and 1 and null ids are left out; a row with several labels counts
    once for each. Moments are summed inside tasks and then by Spark, so the driver gets two
    rows of numbers per class whatever the size. With labels of one class (or none) every
    score is that class (or 1).
    """
    votes = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    votes = votes.groupBy(F.col(id_column).alias("_id")).agg(
        F.sum(F.when(F.col(label_column) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(label_column) == 1, 1).otherwise(0)).alias("n1")
    )
    rows = statistics_of.join(votes, F.col("id") == F.col("_id")).select("x", "n0", "n1")

    def moments(batches):
        sums = {0: np.zeros(1 + D + D * D), 1: np.zeros(1 + D + D * D)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(-1, D)
            for c in (0, 1):
                n = np.asarray(batch.column(1 + c)).astype(float)
                weighted = x * n[:, None]
                sums[c] += np.concatenate(([n.sum()], weighted.sum(axis=0), (weighted.T @ x).ravel()))
        place = np.arange(1 + D + D * D)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c, np.int32)), pa.array(place.astype(np.int32)), pa.array(s)], ["label", "place", "value"])

    parts = rows.mapInArrow(released(moments), "label int, place int, value double")
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["label"], np.zeros(1 + D + D * D))[r["place"]] = r["value"]
    full = {c: (s[0], s[1 : 1 + D], s[1 + D :].reshape(D, D)) for c, s in found.items() if s[0] > 0}
    return Discriminant(full)


def quality_scores(
    docs: DataFrame, labels: DataFrame, least: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1, higher: class 1 likelier), ``predicted`` (score >= least).

    Texts alone decide the score; a null text is scored as empty. Repeated rows and null ids
    are scored like any other row, other columns are not read.
    """
    stats = stored(text_statistics(docs, id_column, text_column), "statistics")
    model = fit(stats, labels, id_column, label_column)

    def scored(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    out = stats.mapInArrow(scored, f"id {dict(stats.dtypes)['id']}, score double").withColumnRenamed("id", id_column)
    return out.select(id_column, held_out(id_column).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def accepted_rows(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept.

    The model is fitted on the statistics of all labelled rows, then every row is judged
    where it stands, so texts are never shuffled. The statistics are stored in between: a task
    that also sums up the moments of its rows would keep two Python workers.
    """
    model = fit(stored(text_statistics(docs, "doc_id", "text"), "statistics"), labels)
    names = docs.columns

    def kept(batches):
        for batch in rebatched(batches, names.index("text"), PACK_BYTES):
            texts = batch.column(names.index("text"))
            keep = model.score(statistics(texts.fill_null(""))) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(kept), docs.schema)
