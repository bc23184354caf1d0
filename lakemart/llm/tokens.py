"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import rebatched

#: Bytes handed to the encoder at a time, and the length from which a text is split.
ENCODE_BYTES = 1 << 20
LONG_TEXT = 1 << 16


def split_points(text: str, longest: int) -> Iterator[str]:
    """Parts of a text, cut at single spaces between two words, which go.

    The encoder puts a space mark before every text it gets and joins nothing over a
    mark inside a word, so the parts hold together as many tokens as the whole. A text
    without such a space stays whole.
    """
    start = 0
    while len(text) - start > longest:
        cut = text.find(" ", start + longest)
        while cut != -1 and not (cut + 1 < len(text) and text[cut - 1] not in " ▁" and text[cut + 1] not in " ▁"):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def piece_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths by a sentencepiece model, without begin, end or added tokens.

    Parts of texts repeat (copies, frequent sentences); one encoding serves a batch.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def json_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths by a tokenizers file; its special strings are handled as the library does by default."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def counted(texts: list[str], encode: Callable[[list[str]], list[int]], splittable: bool, longest: int = LONG_TEXT) -> np.ndarray:
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for part in split_points(text, longest) if splittable and len(text) > longest else (text,):
            parts.append(part)
            owner.append(i)
    distinct = dict.fromkeys(parts)
    todo = list(distinct)
    start = 0
    while start < len(todo):  # batches balanced by length
        stop, size = start, 0
        while stop < len(todo) and (size < ENCODE_BYTES or stop == start):
            size += len(todo[stop])
            stop += 1
        for part, length in zip(todo[start:stop], encode(todo[start:stop])):
            distinct[part] = length
        start = stop
    return np.bincount(owner, weights=[distinct[p] for p in parts], minlength=len(texts)).astype(np.int64)


def token_counts(
    docs: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``model`` is the path of a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file
    that every executor has. Null texts count as empty, with 0 bytes and tokens. Repeated
    rows and null ids are counted like any other row; other columns are not read. Texts
    over 64 KiB are cut at safe boundaries only for sentencepiece, whose pieces never
    hold a space mark inside.
    """

    def lengths(batches):
        splittable = model.endswith(".model")
        encode = (piece_encoder if splittable else json_encoder)(model)
        for batch in rebatched(batches):
            texts = batch.column(1).to_pylist()
            counts = counted([t or "" for t in texts], encode, splittable)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = dict(rows.dtypes)["id"]
    counts = rows.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
    return counts.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
