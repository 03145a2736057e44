"""Queries with SQL equal it; the others equal brute force or the public library, on whole small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tests.llm.brute import components, shingle_set
from tests.oracle import compare, connect
from tidemark.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) == []


def test_entry_has_all_operators():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {m[0] for x in names if (m := re.match(r"op\d+", x))} and "pipeline" in names


def test_tokens_equal_the_library(spark, sf_dir, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counted = {r["doc_id"]: r for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()}
    coded = {r["doc_id"]: r for r in QUERIES["op10_bpe_codec"](spark, sf_dir).collect()}
    assert len(counted) == len(coded) == len(documents)
    for doc, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text, add_special_tokens=False).ids
        a, b = counted[doc], coded[doc]
        assert (a["n_bytes"], a["n_tokens"], a["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 2048)
        assert b["n_tokens"] == len(ids)
        assert b["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert b["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, texts, library):
    """Every piece is right, sequences are gapless and not too long, and there are few of them."""
    pieces, places, total = defaultdict(dict), defaultdict(list), 0
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        got, at = pieces[doc], 0
        assert sorted(got) == list(range(-(-len(ids) // 1024)))
        for k in sorted(got):
            r = got[k]
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), total


def test_packing(spark, sf_dir, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    used, total = check_packing(rows, dict(zip(documents.doc_id, documents.text)), library)
    assert used <= 1.02 * -(-total // 1024) + 1


def test_near_duplicates_equal_brute_force(spark, sf_dir, documents):
    sets = {d: shingle_set(t) for d, t in zip(documents.doc_id, documents.text)}
    want = components(sets)
    got = QUERIES["op7_minhash"](spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.9), ("op6_quality_ranking", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    big = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, big)
    rows = scored.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows) > 0
    cut = 0.5 if label == "toxic" else 0.3
    assert all(r["predicted"] == int(r["score"] >= cut) for r in rows)
    for r in scored.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
