"""The registered queries' own columns, on the smallest tables: against their SQL, or against plain versions."""

import struct
import zlib

import brute
import duckdb
import pytest
from tokenizers import Tokenizer

from camtrail.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, TOKEN_LIMIT

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        found.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return found


@pytest.fixture(scope="module")
def docs(tables):
    return tables.sql("select doc_id, text, lang from documents order by doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(BYTE_BPE)
    return [e.ids for e in library.encode_batch([t or "" for _, t, _ in docs], add_special_tokens=False)]


def rows_of(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, SF_DIR).select(*columns).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tables, name):
    want = tables.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_token_queries(spark, docs, ids):
    packed = [struct.pack(f"<{len(i)}I", *i) for i in ids]
    starts = [sum(len(i) + 1 for i in ids[:k]) for k in range(len(ids))]
    want = [(d, s, len(i) + 1, zlib.crc32(p + bytes(4))) for (d, _, _), s, i, p in zip(docs, starts, ids, packed)]
    assert rows_of(spark, "op3_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == want
    want = [(d, len((t or "").encode()), len(i), len(i) > TOKEN_LIMIT) for (d, t, _), i in zip(docs, ids)]
    assert rows_of(spark, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    library = Tokenizer.from_file(BYTE_BPE)
    want = [(d, len(i), brute.sha(p), brute.sha(library.decode(i, skip_special_tokens=False))) for (d, _, _), i, p in zip(docs, ids, packed)]
    assert rows_of(spark, "op10_bpe_encode_decode", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_personal_data_query(spark, docs):
    found = rows_of(spark, "op5_personal_data", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    order = ["email", "ip", "card", "phone"]
    for (doc_id, text, _), row in zip(docs, found, strict=True):
        base = brute.private(text)
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert row[:6] == (doc_id, *(sum(k == kind for k, _, _ in base) for kind in order), brute.sha(",".join(written)))
        spans = row[6].split(",") if row[6] else []
        assert set(written) <= set(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(0 <= int(a) < int(b) <= len(text) for _, a, b in (s.split(":") for s in spans))


def test_language_query(spark, docs):
    known = {lang for _, _, lang in docs if lang is not None}
    found = rows_of(spark, "op9_language_id", "doc_id", "held_out", "lang_pred", "score")
    for (doc_id, text, _), row in zip(docs, found, strict=True):
        assert row[:2] == (doc_id, zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert (row[2] == "und") == (not any(c.isalpha() for c in text or "")) and row[2] in known | {"und"} and 0 <= row[3] <= 1


def test_scores_query(spark, docs):
    found = rows_of(spark, "op2_context_mixing", "doc_id", "held_out", "score")
    assert [r[:2] for r in found] == [(d, zlib.crc32(str(d).encode()) % 10 == 0) for d, _, _ in docs]
    assert all(r[2] < 0 for r in found)
