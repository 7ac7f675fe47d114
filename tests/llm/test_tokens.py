"""Token files, counts, and BPE encoding (operators 3, 4 and 10) against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from camtrail.llm import heap_bpe, token_counts, token_files
from camtrail.llm.bpe_words import as_u32, library_bpe
from samples import corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ids_of = lambda t: LIBRARY.encode(t or "", add_special_tokens=False).ids

TEXTS = st.one_of(st.text(max_size=60), st.text("ab'stremvld \n\t\r\x85\xa0\x1c0²é", max_size=60), st.text("a <|endoftext|>", max_size=60))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoders_agree_with_the_library(text):
    assert library_bpe(PATH).encode(text) == as_u32(ids_of(text))
    assert heap_bpe.heap_bpe(PATH).encode(text) == as_u32(ids_of(text))
    assert heap_bpe.heap_bpe(PATH).decode(as_u32(ids_of(text))).decode() == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


def test_long_piece():
    text = "ab" * 20_000
    assert heap_bpe.heap_bpe(PATH).encode(text) == as_u32(ids_of(text))


def test_decode_of_any_ids():
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(5)]
        assert heap_bpe.heap_bpe(PATH).decode(as_u32(ids)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_decode(stored):
    docs = corpus() + [(0, "again"), (0, "again"), (None, None)]
    rows = stored([(*d, "x") for d in docs], "doc_id long, text string, n_tokens string")
    found = heap_bpe.encode_decode(rows, PATH, digests=True).collect()
    want = sorted((d is None, d, len(i := ids_of(t)), hashlib.sha256(as_u32(i)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    plain = heap_bpe.encode_decode(rows, PATH).where("doc_id = 7").first()
    assert plain["ids"] == ids_of(dict(docs)[7]) and plain["decoded"] == (dict(docs)[7] or "")


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (300, 40), (50, 3)])
def test_counts(stored, chunk, overlap):
    docs = corpus() + [(0, "again"), (0, "again"), (None, None)]
    clash = "doc_id long, text string, row_id string, n_bytes string, k string, n_tokens string"
    found = token_counts.token_counts(stored([(*d, *"abcd") for d in docs], clash), PATH, chunk, overlap).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((d, len((t or "").encode()), len(ids_of(t))) for d, t in docs), key=key)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=key) == want


def test_counts_of_nothing(stored):
    assert token_counts.token_counts(stored([]), PATH).count() == 0


def test_files(spark, stored, tmp_path):
    docs = corpus()
    path = str(tmp_path / "tokens")
    clash = "doc_id long, text string, part string, part_start string, ids string, n_tokens string"
    token_files.write_tokens(stored([(*d, *"abcd") for d in docs], clash), path, PATH, partitions=5)
    found = {r["doc_id"]: r for r in token_files.token_digests(token_files.read_tokens(spark, path)).collect()}
    start = 0
    for doc_id, text in sorted(docs):
        ids = [*ids_of(text), 0]
        r = found[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_tokens(spark, path, 7, 70)
    assert sorted(r["doc_id"] for r in some.select("doc_id").collect()) == sorted(d for d, _ in docs if 7 <= d <= 70)
    assert some.where("doc_id = 7").first()["start"] == found[7]["start"]
    assert "ids" not in token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()


def test_files_of_odd_rows(spark, stored, tmp_path):
    for name, docs in (("none", []), ("odd", [(None, None), (1, "b"), (1, "a"), (1, "a")])):
        path = str(tmp_path / f"out-{name}")
        token_files.write_tokens(stored(docs, name=name), path, PATH, partitions=3)
        found = token_files.token_digests(token_files.read_tokens(spark, path)).orderBy("start").collect()
        assert [(r["doc_id"], r["n_tokens"]) for r in found] == [(d, len(ids_of(t)) + 1) for d, t in docs]


def test_file_encodings(spark, stored, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_tokens(stored(corpus()), path, PATH, partitions=1)
    group = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
