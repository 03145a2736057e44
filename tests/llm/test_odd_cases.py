"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.brute import components, shingle_set
from tests.llm.fixtures import CLASHING, ODD, empty_docs, odd_docs
from tidemark.llm import bpe, licenses, minhash, packing, quality, rules, token_counts, topk, toxicity, warc

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


# 1 -----------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows, query_rows", [(4096, 1024), (16, 3)])
def test_top_k_equals_brute_force(spark, bucket_rows, query_rows):
    draw = random.Random(5)
    vectors = {i: [draw.gauss(0, 1) * draw.choice([0.1, 1, 3]) for _ in range(6)] for i in range(150)}
    for i in range(150, 220):  # one vector that a third of the rows share
        vectors[i] = vectors[20]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, v int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, bucket_rows=bucket_rows, query_rows=query_rows).collect()
    floored = {i: np.floor(64 * np.array(v)) for i, v in vectors.items()}
    assert by_row(got, "query_id", "rank", "vec_id", "score") == sorted(brute_top(floored, range(0, 220, 20), 7), key=repr)


@pytest.mark.parametrize("bucket_rows", [4096, 64, 16])
def test_top_k_of_an_id_on_more_than_k_rows(spark, bucket_rows):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(7, [4.0 + n % 3] * 6) for n in range(40)]  # the longest vectors, all under one id
    rows += [(40, [draw.gauss(0, 2) for _ in range(6)]) for _ in range(5)]  # a query with several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, bucket_rows=bucket_rows, query_rows=3).collect()
    best: dict = {}
    floored = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    for q, a in floored:
        for i, b in floored:
            if q % 20 == 0 and i != q:
                best.setdefault(q, {})[i] = max(best.get(q, {}).get(i, -(1 << 60)), int(a @ b))
    want = [(q, n + 1, i, s) for q, x in best.items() for n, (i, s) in enumerate(sorted(x.items(), key=lambda p: (-p[1], p[0]))[:7])]
    assert by_row(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_odd_rows(spark):
    kinds = "vec_id long, embedding array<float>, norm int, bucket int, is_query int"
    rows = [
        (0, [1.0, 1.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (1, [2.0]), (2, []), (3, [-0.01, 0.0]), (3, [-0.01, 0.0]),
    ]
    got = topk.top_k(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], kinds), F.col("vec_id") % 20 == 0).collect()
    assert by_row(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 8192), (0, 2, 2, 0), (0, 3, 3, -64)]
    assert topk.top_k(spark.createDataFrame([], kinds), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_keeps_every_candidate():
    draw = np.random.default_rng(1)
    vectors = draw.integers(-100, 100, (500, 5)) * draw.integers(1, 5, (500, 1))
    bucket = topk.Bucket(np.arange(500), vectors)
    pruned = 0
    for q in draw.integers(-100, 100, (60, 5)):
        scores = bucket.vectors @ q
        for threshold in np.percentile(scores[scores > 0], [50, 90, 99]) if (scores > 0).any() else []:
            found = bucket.candidates(q, float(np.linalg.norm(q)), float(threshold))
            assert set(np.flatnonzero(scores >= threshold)) <= set(found)
            pruned += 500 - len(found)
    assert pruned > 10_000


def test_large_components():
    a = np.array([[1 << 40, 3]])
    assert topk._exact_scores(a, np.array([1 << 20, 1])).tolist() == [(1 << 60) + 3]
    with pytest.raises(OverflowError):
        topk._exact_scores(a, np.array([1 << 40, 1]))


# 2 -----------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("ІDІОТ id​iot 1d10t m0r0n Ｓcum idíot") == "idiot idiot idiot moron scum idiot"
    assert toxicity.fold("trash$$$ 2024 4785380592391139 $5") == "trash$$$ 2024 4785380592391139 $5"
    assert toxicity.words(toxicity.fold("$$$trash*** stupid!!!you Дурак")) == ["trash", "stupid", "you", toxicity.fold("Дурак")]
    long = "x" * 200_000 + "1" * 200_000 + "!" * 200_000
    assert len(toxicity.fold(long)) == len(long)


def test_exceptions_and_weights():
    model = toxicity.Model({"clo": 1.0, "clown ": 3.0, "scum ": 2.0}, ["clown fish", "close"])
    m = model.matcher()
    total = lambda t: np.expm1(toxicity.measures(m, t)[1])
    assert total("a clown and scum") == pytest.approx(5)
    assert total("clown fish close by") == pytest.approx(0)
    assert total("clone") == pytest.approx(1)
    assert total("xclown scummy") == pytest.approx(0)


def test_other_readings_of_disguised_runs():
    bad = ["idiot", "disgusting", "worthless", "loser", "clown", "asshole", "trash", "killer"]
    m = toxicity.Model({"scu": 1.0} | {f"{w} ": 2.0 for w in bad}, ["clown fish", "scuba"]).matcher()
    total = lambda t: np.expm1(toxicity.measures(m, t)[1])
    for t in (
        "idio7", "disgustin9", "worthle$$", "1oser", "c1own", "wor7h1ess", "a$$hole", "ki11er", "k1l13r", "1d1ot2024", "!idiot", "$$loser",
        "idio7!!!", "trash$$$", "trash$", "TRA$H", "you 1о5еr you",
    ):
        assert total(t) == pytest.approx(2), t
    assert total("worthle$$ 1oser, idio7") == pytest.approx(6)
    assert total("c1own fish 5cuba") == pytest.approx(0)
    assert total("5cum") == pytest.approx(1)
    for t in ("worthles", "io5er", "a55", "c1owns", "idio7x", "1d107", "x1oser", "дidio7", "idio7д", "2024 $$$ 1111", "trashs$x"):
        assert total(t) == pytest.approx(0), t
    assert toxicity.measures(m, "1oser you")[3:] == toxicity.measures(m, "loser you")[3:]
    for t in ("x" * 200_000 + "1" * 200_000 + "!" * 200_000, "!" * 200_000 + "idiot", "x1!!" * 100_000):
        toxicity.measures(m, t)


def toxic_world(spark):
    draw = random.Random(3)
    common = [a + b for a in "bdfgklm" for b in ("ala", "ene", "iri", "opo", "utu")]
    rows, labels = [], []
    for i in range(300):
        words, toxic = draw.choices(common, k=40), i % 4 == 0
        if toxic:
            words[draw.randrange(40)] = draw.choice(["vilewretch", "nastybrute"])
        rows.append((i, " ".join(words), *range(len(CLASHING))))
        labels.append((i, int(toxic), 1))
    kinds = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame(rows, kinds), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_and_scores_odd_rows(spark):
    docs, labels = toxic_world(spark)
    model = toxicity.fit(docs, labels)
    assert {"vilewretch ", "nastybrute "} <= set(model.entries)
    probe = odd_docs(spark, [*ODD, (100, "you v1lewretch, you"), (101, "you Vіlewretch")])
    got = toxicity.score(probe, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= 0.5} == {100, 101}
    assert toxicity.score(empty_docs(spark), model).count() == 0
    kept = toxicity.keep(probe, model)
    assert kept.columns == probe.columns and kept.count() == len(ODD)


def test_toxicity_learns_exception_phrases(spark):
    docs, labels = toxic_world(spark)
    harmless = {1: "clown fish", 2: "rodeo clown troupe"}  # a pair; a triple whose pairs also stand in toxic documents
    hurtful = ["you clown", "rodeo clown", "clown troupe"]
    put = F.udf(lambda i, t: f"{t} {hurtful[i // 4 % 3] if i % 4 == 0 else harmless.get(i % 20, '')}")
    model = toxicity.fit(docs.withColumn("text", put("doc_id", "text")), labels)
    assert "clown " in model.entries
    assert {"clown fish", "rodeo clown troupe"} <= set(model.exceptions) and not set(hurtful) & set(model.exceptions)
    matched = lambda t: toxicity.measures(model.matcher(), t)[1] > 0
    assert [matched(t) for t in ("see the clown fish swim", "a rodeo clown troupe", "oh you clown", "that rodeo clown")] == [False, False, True, True]
    probe = odd_docs(spark, [(1, "see the clown fish swim"), (2, "oh you clown")])
    assert {r["doc_id"] for r in toxicity.score(probe, model).collect() if r["score"] >= 0.5} == {2}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_world(spark)
    for none in (labels.filter("toxic = 0"), labels.filter("doc_id < 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(docs, none)
        assert model.entries == {} and all(r["score"] < 0.5 for r in toxicity.score(docs, model).collect())


# 3 -----------------------------------------------------------------------------------------------


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut(1, 1024) == [(0, 1)]


def test_ids_equal_the_library():
    own, library = packing.ids_of(*BYTE), Tokenizer.from_file(BYTE[0])
    for text in [t or "" for _, t in ODD] + ["a  b\n\n c \n", " lead", "I'll  go\n \nnow ", "12 3.4!! ¿Qué?"]:
        assert own(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("group_items", [40_000, 25])
def test_packing_is_whole_and_tight(spark, group_items):
    draw = random.Random(2)
    lengths = [draw.randrange(1, 101) for _ in range(900)] + [1] * 300 + [100] * 40
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES).repartition(9)
    rows = packing.sequences(packing.pack(items, 100, group_items)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 100 and len(ends) <= 1.04 * sum(lengths) / 100 + 1


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(odd_docs(spark), *BYTE).collect()
    library = Tokenizer.from_file(BYTE[0])
    want = []
    for doc, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((doc, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    assert by_row(rows, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    assert packing.pack_documents(empty_docs(spark), *BYTE).count() == 0


# 4 -----------------------------------------------------------------------------------------------


def test_warc_odd_rows(spark):
    long = "<p>é</p>" * 40
    rows = [(7, "u", long), (3, None, long), (9, "a b\r\nX: y", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", "z" * 300_000), (None, "u", "n" * 200), (3, None, long)]
    pages = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, key int, first int")
    got = warc.round_trip(pages).collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 3 if html == long and page != 3 else None
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert by_row(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(records, dictionary=b"WARC/1.1 dictionary " * 20):
    import io

    out = io.BytesIO()
    writer = warc.Writer(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def test_warc_reader_validates():
    import io

    payload = b"<html>" * 50
    good = warc.record(1, "http://x", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
    data = archive([good, good])
    assert [warc.parse(f)["payload"] for f in warc.frames(io.BytesIO(data), 7)] == [payload, payload]
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.frames(io.BytesIO(data[8:])))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.frames(io.BytesIO(data[:-3])))
    for bad, why in [
        (good.replace(b"<html>", b"<HTML>", 1), "digest"), (good[:-1], "Content-Length"), (good.replace(b"WARC/1.1", b"WARC/9.9"), "record"),
        (good.replace(b"WARC-Date: ", b"X-Date: "), "missing"), (good.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 4"), "length"),
    ]:
        with pytest.raises(ValueError, match=why):
            warc.parse(bad)


# 5 -----------------------------------------------------------------------------------------------


def test_repeated_words_equals_brute_force():
    draw = random.Random(8)
    for n, kinds in [(0, 1), (4, 1), (5, 1), (30, 2), (200, 3), (200, 60), (5000, 4), (6000, 900)]:
        ids = [draw.randrange(kinds) for _ in range(n)]
        at = {}
        for i in range(n - 4):
            at.setdefault(tuple(ids[i : i + 5]), []).append(i)
        want = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 5)}
        assert rules.repeated_words(np.array(ids, np.int64)) == len(want)


def test_ledger_policies_and_ablations(spark):
    texts = [t for _, t in ODD] + ["one two three four five six seven eight nine ten", "a$ b$ c$ d$ e$ f$ g$ h$ i$ j$ k$", "LOUD!! " * 12]
    kept = rules.apply_policy(rules.ledger(odd_docs(spark, list(enumerate(texts))))).cache()
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert not rows[3]["kept"] and rows[3]["n_words"] == 0 and rows[3]["failed"] == rules.BIT["too_few_words"]
    assert rows[0]["kept"] and rows[11]["kept"] and not rows[12]["kept"] and not rows[13]["kept"]
    assert rows[12]["failed"] == rules.BIT["symbols"]
    base = {r["doc_id"]: r["kept"] for r in rules.apply_policy(kept.drop("kept"), "base").collect()}
    assert base[12] and not base[13]
    found = {r["rule"]: (r["failing"], r["only_this"]) for r in rules.ablations(kept).collect()}
    for name, bit in rules.BIT.items():
        assert found[name] == (sum(bool(r["failed"] & bit) for r in rows.values()), sum(r["failed"] == bit for r in rows.values()))
    whole = rules.summary(kept).collect()[0]
    assert whole["any_failed"] == np.bitwise_or.reduce([r["failed"] for r in rows.values()]) and whole["n"] == len(rows)
    docs = odd_docs(spark)
    assert rules.ledger(docs).count() == len(ODD) and rules.ledger(empty_docs(spark)).count() == 0
    assert rules.keep(docs).columns == docs.columns and rules.keep(empty_docs(spark)).count() == 0
    assert sorted(r["doc_id"] for r in rules.keep(docs).collect()) == [1, 2, 2]


# 6 -----------------------------------------------------------------------------------------------


def test_bradley_terry_orders_and_cuts():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + draw.logistic(size=400) * 0.5 > -1).astype(int)
    ranking = quality.rank(x, y)
    assert ranking.weights[0] > 0 > ranking.weights[1]
    scores = np.array([ranking.score(list(r)) for r in x])
    assert (scores < quality.CUT).sum() == (y == 0).sum()  # the cut is the quantile of the poor share
    assert quality.rank(x, np.ones(400)).score([0.0] * len(quality.FEATURES)) == pytest.approx(quality.CUT)
    better, worse = quality.preferences(y)
    assert set(worse) == set(np.flatnonzero(y == 0)) and set(better) == set(np.flatnonzero(y == 1))


def test_quality_odd_rows(spark):
    docs, labels = toxic_world(spark)
    ranking = quality.fit(docs, labels.withColumn("quality", 1 - F.col("toxic")))
    got = quality.score(odd_docs(spark), ranking).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty_docs(spark), ranking).count() == 0
    assert quality.fit(docs, labels.filter("doc_id < 0")) == quality.Ranking()


# 7 -----------------------------------------------------------------------------------------------


def near_world():
    """Families of near copies around the threshold, exact copies, short texts, and one hot family."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, n = {}, 0
    for family in range(30):
        base = draw.choices(vocabulary, k=draw.randrange(30, 200))
        for _ in range(60 if family == 0 else draw.randrange(1, 6)):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + len(words) // 28)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts[n] = " ".join(words)
            n += 1
    for text in ["", None, "one two", "One  TWO", "one two three", texts[3], texts[3].upper().replace(" ", "\n")]:
        texts[n] = text
        n += 1
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_world()
    got = minhash.near_duplicates(odd_docs(spark, list(texts.items()))).collect()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = components(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_hidden_pass_finds_what_stars_miss(spark):
    """Pairs of different components in one bucket are found, unless too few of their shingles are common."""
    base = [f"w{i}" for i in range(100)]
    texts = {1: base, 5: [*base[:90], *"abcdefghij"], 6: [*base[:95], "x", "y"], 7: [*base[:40], *(f"v{i}" for i in range(60))]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    sigs = spark.createDataFrame([(i, bytes(np.array([9] * minhash.HASHES, np.uint16))) for i in texts], "id long, sig binary")
    bands = spark.createDataFrame([(7, 0, i) for i in texts], "bucket long, band int, id long")
    none = spark.createDataFrame([], "node long, component long")
    assert by_row(minhash._hidden(bands, none, sigs, docs).collect(), "a", "b") == [(1, 5), (1, 6), (5, 6)]
    joined = spark.createDataFrame([(5, 1)], "node long, component long")
    assert by_row(minhash._hidden(bands, joined, sigs, docs).collect(), "a", "b") in ([(1, 6)], [(5, 6)], [(1, 6), (5, 6)])  # one link between two components is enough


def test_star_centres_are_the_most_accompanied(spark):
    bands = spark.createDataFrame([(1, 0, 3), (1, 0, 9), (2, 1, 9), (2, 1, 4), (3, 2, 9), (3, 2, 5), (4, 3, 8)], "bucket long, band int, id long")
    shared, pairs = minhash._stars(bands)
    assert by_row(pairs.collect(), "a", "b") == [(3, 9), (4, 9), (5, 9)]
    assert shared.count() == 6


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    got = minhash.near_duplicates(docs).collect()
    assert by_row(got, "doc_id", "component_id", "kept") == sorted(
        [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (9, 9, True)], key=repr
    )
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, None, 5, 6, 7, 8, 9], key=repr)
    twice = odd_docs(spark, [(1, ODD[0][1]), (1, ODD[0][1]), (2, "b c")])
    assert sorted(r["doc_id"] for r in minhash.keep(twice).collect()) == [1, 2]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(500, i) for i in range(90)], [(3, 2), (2, 3), (9, 8), (8, 2)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in minhash.alternate(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {i: {i} for e in edges for i in e}
    for a, b in edges:
        groups[a] |= groups[b]
        for i in groups[a]:
            groups[i] = groups[a]
    assert all(got.get(i, i) == min(g) for i, g in groups.items())


# 8 -----------------------------------------------------------------------------------------------


def test_license_scan_of_whole_texts(spark):
    own = "Copyright (c) 2021, Jane Doe\nAll rights reserved.\n\n"
    stars = "\n".join(line.replace("1. ", "* ").replace("2. ", "* ") for line in licenses.BSD_2.split("\n"))
    want = {
        1: ("BSD-3-Clause", f"BSD 3-Clause License\n\n{own}{licenses.BSD_3}"), 2: ("BSD-2-Clause", own + stars), 3: ("0BSD", own + licenses.ZERO_BSD),
        4: ("Unlicense", licenses.UNLICENSE.upper()), 5: ("MIT", f"MIT License\n\n{own}{licenses.MIT}"), 6: ("ISC", own + licenses.ISC),
        7: ("Apache-2.0", own + "\n".join(f"# {x}" for x in licenses.APACHE_HEADER.split("\n"))),
        8: ("GPL-3.0-or-later", f"/*\n{own}{licenses.GPL_3_HEADER}\n*/"), 9: ("GPL-2.0-or-later", own + licenses.GPL_2_HEADER),
        10: ("BSD-2-Clause", own + licenses.BSD_2),
    }
    docs = odd_docs(spark, [(i, t) for i, (_, t) in want.items()])
    known = licenses.known_digests(spark)
    assert known.select("digest").distinct().count() == known.count()  # one licence per digest
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, known).collect()} == {i: x for i, (x, _) in want.items()}
    given = spark.createDataFrame([("House", "Use it\nas you like."), ("None", None)], "license_id string, text string")
    got = licenses.scan(odd_docs(spark, [(1, "use it as YOU like"), (2, "use it")]), licenses.known_digests(spark, given)).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {1: "House", 2: None}


def test_license_scan(spark):
    own = "Copyright (c) 2020 Jane Doe. All rights reserved.\n\n" + licenses.MIT.replace("Permission", "PERMISSION").replace("\n", "\n  ")
    rows = [*ODD, (20, own), (21, "text\nreleased under the MIT licence\nmore\nLicensed under CC-BY-NC 4.0"), (22, "see: released under the MIT License.")]
    got = licenses.scan(odd_docs(spark, rows), licenses.known_digests(spark)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["license_id"] for r in got if r["license_id"]} == {20: "MIT"}
    assert {r["doc_id"]: r["notices"] for r in got if r["notices"]} == {21: "CC-BY-NC-4.0,MIT"}
    assert {r["doc_id"] for r in got if r["digest"] is None} == {3, 4, 5}
    assert licenses.scan(empty_docs(spark), licenses.known_digests(spark)).count() == 0


# 9, 10 -------------------------------------------------------------------------------------------


def test_tokens_of_odd_rows(spark):
    library = Tokenizer.from_file(WORD)
    counted, coded = token_counts.count_tokens(odd_docs(spark), WORD).collect(), bpe.encode_documents(odd_docs(spark), WORD).collect()
    want = []
    for doc, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert by_row(counted, "doc_id", "n_bytes", "n_tokens") == sorted(((d, len((t or "").encode()), w[1]) for (d, t), w in zip(ODD, want)), key=repr)
    assert token_counts.count_tokens(empty_docs(spark), WORD).count() == bpe.encode_documents(empty_docs(spark), WORD).count() == 0


def test_chunks_compose():
    """The count does not depend on where chunks are cut, and composition is associative."""
    text = "The  quick brown\n\nfox's jump'd " * 7 + "x" * 90 + " end"
    whole = token_counts.Counter(WORD).count(text)
    for size in (1, 2, 7, 64):
        assert token_counts.Counter.count(small := _with_chunks(size), text) == whole
    maps = [small.chunk_map(text[i : i + 5].lower(), True) for i in range(0, 60, 5)]
    a, b, c = maps[:3]
    assert a.then(b, small.run).then(c, small.run) == a.then(b.then(c, small.run), small.run)
    prefix, scanned = maps[0], token_counts.scan(maps, small.run)
    for m, s in zip(maps[1:], scanned[1:]):
        prefix = prefix.then(m, small.run)
        assert prefix == s


def _with_chunks(size):
    own = token_counts.counter(WORD)
    own.chunk_chars = size
    return own


def test_transducer_and_fragments_equal_the_library():
    draw = random.Random(6)
    library, own, coder = Tokenizer.from_file(WORD), token_counts.Counter(WORD), bpe.Codec(WORD)
    for _ in range(1500):
        word = "".join(draw.choices("aeinorstlhdcuéß'1!", k=draw.randrange(1, 25)))
        ids = library.encode(word, add_special_tokens=False).ids
        assert own.count(word) == len(ids), word
        assert coder.encode(word)[1] == " ".join(map(str, ids)), word
    parts = ["é"] * 3 + ["zq"] * 400
    long = "".join(parts)
    assert coder.encode(long)[1] == " ".join(map(str, library.encode(long, add_special_tokens=False).ids))


def test_cuts_never_cross_tokens():
    b = bpe.WordBpe(WORD)
    assert b.fragments(b.symbols("qzx")) != [tuple(b.symbols("qzx"))]  # a certain cut exists here
    assert [f for f in b.fragments(b.symbols("the"))] == [tuple(b.symbols("the"))]


# pipeline ----------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rule_mask = {i: rules.measure(t) for i, t in texts.items()}
    frame = pd.DataFrame.from_dict(rule_mask, orient="index", columns=rules.MEASURES)
    failed = np.zeros(len(frame), bool)
    for _, test in rules.RULES:
        failed |= frame.eval(test).to_numpy()
    left = {i: texts[i] for i in frame.index[~failed]}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    matcher = model.matcher()
    left = {i: t for i, t in left.items() if toxicity.probability(model, toxicity.measures(matcher, t)) < 0.5}
    groups = components({i: shingle_set(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    from tests.llm.test_queries import check_packing

    used, total = check_packing(got, left, Tokenizer.from_file(BYTE[0]))
    assert used <= 1.02 * -(-total // 1024) + 1


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in ODD], kinds)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf_dir).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()


# Findings of the second review ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [300, 20_000, 500_000])
def test_signatures_of_unlike_sets_differ_whatever_their_size(n):
    draw = np.random.default_rng(n)
    a, b = (minhash.signature(np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))) for _ in range(2))
    assert (a == b).sum() < 10


def test_near_duplicates_of_long_texts_equal_brute_force(spark):
    draw = random.Random(8)
    def text(n):
        return [f"w{draw.randrange(10**9)}" for _ in range(n)]
    base = text(100_000)
    near = base[:95_000] + text(5_000)
    far = base[:60_000] + text(40_000)
    rows = {i: " ".join(t) for i, t in enumerate([base, text(100_000), near, far, text(100_000), base, text(300)])}
    want = components({i: shingle_set(t) for i, t in rows.items()})
    got = minhash.near_duplicates(odd_docs(spark, list(rows.items()))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and want[2] == 0 and want[3] == 3


def test_keep_leaves_every_unlike_text_under_a_repeated_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(0, a), (3, a), (3, b), (5, c), (5, d), (7, d + " end"), (None, a), (8, None), (8, "")]
    kept = minhash.keep(odd_docs(spark, rows))
    assert kept.columns == odd_docs(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(0, a), (3, b), (5, c), (5, d), (None, a), (8, None), (8, "")], key=repr)


def test_pages_without_an_id_revisit_an_equal_page(spark):
    long, other = "p" * 200, "q" * 200
    rows = [(5, "u", long), (None, "u", long), (7, "u", long), (None, "u", other), (None, "u", other), (None, "u", "short"), (9, "u", "short")]
    got = warc.planned(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert by_row(got, "page_id", "bytes", "refers_to") == sorted(
        [(5, 200, None), (None, 200, 5), (7, 200, 5), (None, 200, None), (None, 200, None), (None, 5, None), (9, 5, None)], key=repr)


def test_matches_and_exceptions_equal_a_plain_search():
    draw = random.Random(3)
    model = toxicity.Model({"bad ": 1.0, "ug": 2.0, "ugly ": 3.0, "fool": 0.5}, ["ugly duck", "bad luck", "duck ugly duck", "uganda"])
    matcher = model.matcher()
    for _ in range(200):
        ws = [draw.choice(["bad", "ugly", "duck", "luck", "uganda", "fools", "fool", "ok"]) for _ in range(draw.randrange(1, 14))]
        covered = {k + j for e in model.exceptions for k in range(len(ws)) if ws[k : k + len(e.split())] == e.split() for j in range(len(e.split()))}
        want = {}
        for k, w in enumerate(ws):
            weights = [v for e, v in model.entries.items() if f"{w} ".startswith(e)]
            if weights and k not in covered:
                want[k] = max(weights)
        assert toxicity._hits(matcher, ws) == want


def test_many_matches_and_exceptions_take_linear_time():
    import time

    model = toxicity.Model({"bad ": 1.0}, ["bad luck"])
    matcher, words = model.matcher(), ["bad", "luck", "bad", "day"] * 50_000
    start = time.perf_counter()
    assert len(toxicity._hits(matcher, words)) == 50_000
    assert time.perf_counter() - start < 2
