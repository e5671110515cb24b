import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from shelfprice.llm import op02_tokens as tok
from shelfprice.llm import op05_bpe as bpe
from shelfprice.llm.common import shared_folder, slices
from shelfprice.llm.op05_bpe import Encoder, Vocabulary, encode_documents

FILE = path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n ", "a", "aaaa aaaaaaa", "It's 1234 don't", "&'s <|endoftext|>X<|startoftext|>", "ΣΑΣ İ ß é é", "x\x1cy\x85z w",
    "½ ² ١٢ 中文 \U0001f600\U0001f600", "word " * 3000, "###$$$ !!! a|b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.load(FILE))


def test_encoding_and_decoding_equal_the_library(documents, library):
    pairs = [*enumerate(TEXTS), (None, "null key"), (3, "repeated key"), (3, "repeated key")]
    rows = encode_documents(documents(pairs), FILE, decode=True).collect()
    assert len(rows) == len(pairs)
    for (key, text), row in zip(pairs, rows, strict=True):
        expected = library.encode(text or "", add_special_tokens=False)
        assert (row.doc_id, row.n_tokens) == (key, len(expected.ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == expected.ids
        assert row.decoded == library.decode(expected.ids, skip_special_tokens=False)


def test_empty_table(documents):
    assert encode_documents(documents([]), FILE).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40), max_size=5))
def test_any_text(texts):
    own, library = test_any_text.parts
    ids, counts = own.encode(texts)
    assert counts.tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids]


test_any_text.parts = Encoder(Vocabulary.load(FILE)), Tokenizer.from_file(FILE)


def test_forgotten_words_come_again(encoder, library, monkeypatch):
    monkeypatch.setattr("shelfprice.llm.op05_bpe.CACHE_WORDS", 3)
    for text in ("one two three four", "five six one", "one two"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 4096, 4 << 20])
def test_token_counts_over_blocks(spark, documents, encoder, block):
    pairs = [(i - 3, x) for i, x in enumerate(TEXTS)] + [(None, "null key"), (1, "again"), (1 << 62, "large"), (-(1 << 63), "least")]
    folder = shared_folder(spark)
    tok.write_token_files(documents(pairs), Vocabulary.load(FILE), 49407, folder)
    counts = tok.token_counts(spark, folder, 49407, head=tok.KEY_TOKENS, block_bytes=block)
    rows = counts.select("path", "document", tok.key_column("head").alias("doc_id"), "n_tokens", "closed").collect()
    plain = Encoder(Vocabulary(**{**encoder.vocabulary.__dict__, "special": {}}))
    expected = sorted((str(k), int(plain.encode([x or ""])[1][0])) for k, x in pairs)
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == expected
    assert all(r.closed for r in rows)


def test_open_end_and_empty_documents(spark, tmp_path):
    (tmp_path / "a").write_bytes(np.array([5, 6, 9, 9, 7], "<u2").tobytes() + b"\x01")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(np.array([9], "<u2").tobytes())
    rows = tok.token_counts(spark, str(tmp_path), 9, block_bytes=4).collect()
    found = sorted((r.path[-1], r.document, r.start, r.n_tokens, r.closed) for r in rows)
    assert found == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, False), ("c", 0, 0, 0, True)]


def test_digests(spark, documents, tmp_path, library):
    from pyspark.sql import functions as F

    from shelfprice.llm.op05_bpe import op5_bpe

    documents([(1, "Hello world"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op5_bpe(spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()}
    ids = library.encode("Hello world", add_special_tokens=False).ids
    assert rows[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_runs_that_are_encoded_at_once_are_short(documents, monkeypatch):
    asked = []
    monkeypatch.setattr(bpe, "map_batches", lambda frame, each, schema, *size: asked.append(size) or frame)
    encode_documents(documents([(1, "a")]), path("word_bpe_49k.json"))
    texts = ["word " * 20_000, None, "", *["x" * 1000] * 900, "y" * 700_000, "z"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    runs = list(slices(batch, *asked[0]))
    assert [x for run in runs for x in run.column(1).to_pylist()] == texts
    assert all(run.num_rows == 1 or sum(len(x or "") for x in run.column(1).to_pylist()) <= 512 << 10 for run in runs)
