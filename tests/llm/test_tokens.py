from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakemart.llm.tokens import counted, piece_encoder, split_points, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb \n c", "▁a ▁ b▁", "<s> x </s><unk>", "ﬁ Ａ é　b\tc", "\x00 a\x00b", "1.5 2,5",
    "word " * 40_000, "x" * 150_000, " " * 9_000 + "y z" * 30_000, "añ ▁ö " * 25_000, "a  b " * 30_000,
]


def test_whole_texts_give_the_library_counts(spark, docs, documents):
    texts = HARD + [d[1] for d in documents[:60]]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = token_counts(docs([(i if i else None, t) for i, t in enumerate(texts)]), MODEL, limit=5)
    got = {r["doc_id"]: r for r in df.collect()}
    for i, text in enumerate(texts):
        row = got[i if i else None]
        want = len(model.encode(text or ""))
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (want, len((text or "").encode()), want > 5), text and text[:30]


@pytest.mark.parametrize("longest", [1, 3, 10])
def test_parts_of_texts_hold_as_many_tokens(documents, longest):
    texts = [t or "" for t in HARD[:14]] + [d[1][:2000] for d in documents[:40]]
    encode = piece_encoder(MODEL)
    assert counted(texts, encode, True, longest).tolist() == encode(texts)


def test_parts_join_to_the_text(documents):
    for text in [t or "" for t in HARD] + [d[1] for d in documents[:40]]:
        assert " ".join(split_points(text, 50)) == text


def test_json_model(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b", "", None, "x<|endoftext|>y", "word " * 30_000]
    model = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs(list(enumerate(texts))), path).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_repeats_and_empty_table(spark, docs):
    assert token_counts(docs([]), MODEL).count() == 0
    assert [r["n_tokens"] for r in token_counts(docs([(1, "a b"), (1, "a b")]), MODEL).collect()] == [2, 2]
