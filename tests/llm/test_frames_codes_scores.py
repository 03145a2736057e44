"""Operators 11 to 13: odd rows, brute force, exact round trips, and probabilities that sum to one."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq_file
import pytest

from tests.llm.fixtures import ODD, empty_docs, odd_docs
from tidemark.llm import fim, lm, pq
from tidemark.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = [(20, "holds <P> itself"), (21, "a <M> b"), (22, "<S>"), (23, " leading and trailing \n"), (24, "<P" * 40), (25, "a\x0b\x0cb\x1cc d")]
MANY = [(100 + i, f"  word{i} né 中文 <S <P  {'x' * i}\t\n" * (1 + i % 5)) for i in range(60)]


def fill_in_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("frame_bytes", [5, 64, fim.FRAME_BYTES])
def test_fill_in_middle_equals_brute_force(spark, frame_bytes):
    rows = ODD + MARKED + MANY
    made = fim.transform(fim.store(odd_docs(spark, rows), frame_bytes=frame_bytes))
    got = sorted((tuple(r) for r in fim.digests(made).collect()), key=str)
    want = []
    for doc_id, text in rows:
        n, form, a, b, out = fill_in_middle(doc_id, text)
        want.append((doc_id, n, form, a, b, sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    forms = {r[2] for r in got}
    assert forms == {"plain", "spm", "psm"}
    texts = {(r["doc_id"], r["output_text"], r["restored_text"]) for r in fim.texts(made).collect()}
    assert texts == {(d, fill_in_middle(d, t)[4], t or "") for d, t in rows}


def test_fill_in_middle_of_empty_table(spark):
    out = fim.digests(fim.transform(fim.store(empty_docs(spark))))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and out.count() == 0


def test_only_cut_frames_are_decompressed(monkeypatch):
    text = b"some words of a text " * 2000
    frames = fim.Frames.of(text, 1000)
    read = []
    plain = fim.Frames.read
    monkeypatch.setattr(fim.Frames, "read", lambda self, i: read.append(i) or plain(self, i))
    out, a, b = fim.rearrange(frames, fim.PSM, 2500, 6000)
    assert len(frames.data) == 42 and len(set(read)) <= 4
    assert sum(f in frames.data for f in out.data) >= len(frames.data) - 2
    assert frames.units[-1] == 10_001 and frames.chars[-1] == len(text)
    monkeypatch.undo()
    assert b"".join(fim.restored(out, fim.PSM)) == text


def test_markers_may_straddle_frames():
    out = fim.Frames.empty()
    for part in (b"<", b"P>a<S", b">b<", b"M>c<M>"):
        out.add(part)
    assert b"".join(fim.restored(out, fim.PSM)) == b"ac<M>b"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by full distances, row by row."""
    kept = [(i, label, np.floor(4096 * np.array(v, float)).astype(np.int64).reshape(parts, -1))
            for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vectors = np.stack([v for *_, v in kept])
    first = {}
    for i, _, v in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2].ravel().tolist())):
        first.setdefault(i, v)
    books = np.stack(list(first.values())[:entries]).transpose(1, 0, 2)

    def assign():
        far = ((vectors.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(axis=-1)
        return far.argmin(axis=-1).T, far.min(axis=-1).T

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = vectors[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    codes, errors = assign()
    errors = errors.sum(axis=1)
    totals = Counter()
    for (_, label, _), e in zip(kept, errors):
        totals[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, bytes(c.astype(np.uint8)).hex(), int(e), totals[label], digest) for (i, label, _), c, e in zip(kept, codes, errors)), key=str)


def vectors_of(spark, rows):
    kinds = "vec_id long, label int, embedding array<float>, id int, v int, far int, code int, error int, part int, n int"
    return spark.createDataFrame([(*r, *range(7)) for r in rows], kinds)


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), int(i) % 3 if i % 5 else None, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in rng.permutation(n)]


@pytest.mark.parametrize("n", [1, 7, 300])
def test_codes_equal_brute_force_on_odd_rows(spark, n):
    rows = random_rows(n, n)
    odd = [None, [None] * 16, [float("nan")] + [0.0] * 15, [0.1] * 15 + [float("-inf")], [0.1] * 8 + [None] * 8]
    rows += [(-5 - i, 1, v) for i, v in enumerate(odd)] + [(None, None, [0.5] * 16)] + rows[:5] + [(rows[0][0], 9, [-0.25] * 16)]
    got = sorted((tuple(r) for r in pq.compress(vectors_of(spark, rows)).collect()), key=str)
    assert got == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([], [(1, 1, None)]):
        out = pq.compress(vectors_of(spark, rows))
        assert out.columns == names and out.count() == 0
    nameless = pq.compress(vectors_of(spark, [(None, 1, [0.5] * 8), (None, 2, [0.25] * 8)])).collect()
    assert {r["error"] for r in nameless} == {8 * 512 * 512} and all(r["code"] == "00" * 8 for r in nameless)
    assert pq.compress(vectors_of(spark, [(1, 1, []), (2, 1, [])])).count() == 2
    with pytest.raises(ValueError, match="cannot be cut"):
        pq.compress(vectors_of(spark, [(1, 1, [0.5] * 7)]))
    with pytest.raises(Exception, match="has not 8 components"):
        pq.compress(vectors_of(spark, [(1, 1, [0.5] * 8), (2, 1, [0.5] * 16)])).collect()


def test_pivots_prune_and_ties_go_to_the_lower_entry():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    entries = np.concatenate([centres[:8], centres[:8]])  # every distance ties
    pivots = pq.choose_pivots(entries, 4)
    found, best, evaluated = pq.nearest(parts, pq.distances(parts, pivots), pivots, entries)
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=-1)
    assert (found == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and found.max() < 8
    assert evaluated < 0.5 * full.size


def toy_model(texts):
    counts = np.zeros((256, 256), np.int64)
    for t in texts:
        data = b" " + b" ".join([*lm.words(t), b"\xff"])
        for pair in zip(data, data[1:]):
            counts[pair] += 1
    counts[255] = counts[32]
    code, bits = lm.Code.of(counts), lm.table_bits(1)
    tables = {name: np.zeros(2 << bits[name], np.int64) for name in lm.CONTEXTS}
    lm.count_pairs([p for t in texts for p in lm.chunks(lm.words(t))], code, tables)
    weights = np.random.default_rng(5).normal(0.4, 0.3, (lm.GATES, len(lm.CONTEXTS) + 1))
    return lm.Model(code, {n: lm.odds_of(t) for n, t in tables.items()}, weights)


def test_probabilities_sum_to_one():
    model = toy_model(["the cat sat on the mat", "the dog sat", "né 中文"])
    for before in (b"\xff" * 8, b"\xff" * 8 + b"the ca", b"\xff" * 8 + b"zzz"):
        logs = model.score([(before, bytes([b])) for b in range(256)])
        assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_codes_are_prefix_free_and_complete(spark):
    counts = np.zeros((256, 256), np.int64)
    counts[97, 200:] = np.arange(56)
    counts[32, 97] = 10**12
    code = lm.Code.of(counts)
    for before in (97, 32, 7):
        paths = [tuple(code.paths[s : s + n] & 1) for s, n in zip(code.start[256 * before :][:256], code.length[256 * before :][:256])]
        assert abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-12 and len(set(paths)) == 256
    tokens = spark.createDataFrame([(b"ab", 2), (b"a", 5), (None, 3)], "token binary, n long")
    found = lm.byte_counts(tokens)
    assert {(chr(a), chr(b)): int(found[a, b]) for a, b in zip(*found.nonzero()) if a != 255} == {
        (" ", "a"): 7, ("a", "b"): 2, ("b", " "): 2, ("a", " "): 5, (" ", "\xff"): 3}


def test_contexts_see_only_what_stands_before_and_weights_move():
    model = toy_model(["the cat sat on the mat " * 30])
    text = b"the cat sat on the mat " * 20
    together = model.score([(b"\xff" * 8, text[:300])])[0]
    assert together == pytest.approx(model.score([(b"\xff" * 8, text[:300]), (b"\xff" * 8, b"other words")])[0], rel=1e-5)
    still = lm.replace(model, rate=0.0)
    assert abs(still.score([(b"\xff" * 8, text)])[0]) > abs(model.score([(b"\xff" * 8, text)])[0])
    for name, h in zip(lm.CONTEXTS, lm.hashes(np.frombuffer(b"\xff" * 8 + b"abc abd abc", np.uint8))):
        reach = 9 if name == "word" else 1
        assert h[8 + 2] == h[8 + 10] if reach == 9 else h[8 + 2] != h[8 + 10], name


def test_long_texts_are_cut_into_chunks_that_keep_their_context(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 700)
    model = toy_model(["again and again " * 100])
    tokens = lm.words("again and again " * 300)
    pairs = list(lm.chunks(tokens))
    assert b"".join(b for _, b in pairs) == b"again and again " * 300 + b"\xff" and all(len(a) <= lm.REACH for a, _ in pairs)
    parts = -model.score(pairs)
    assert parts[1:-1].max() < 1.5 * parts[1:-1].min()


def test_frequent_endings_have_shorter_codes_of_their_own(spark, monkeypatch):
    rows = [(b"queen", 40), (b"quick", 9), (b"sad", 30), (b"sat", 30), (None, 5)]
    tokens = spark.createDataFrame(rows, "token binary, n long")
    own = lm.own_counts(tokens)
    text = np.frombuffer(b"\xff queen quick", np.uint8)
    after_qu = int(lm.endings(text)[3])
    assert lm.endings(text)[[0, 1, 7]].tolist() == [-1, -1, -1] and lm.endings(text)[9] == after_qu
    assert {chr(b): int(n) for b, n in enumerate(own[after_qu]) if n} == {"e": 40, "i": 9}
    monkeypatch.setattr(lm, "OWN_CODES", 2)
    assert set(lm.own_counts(tokens)) < set(own) and len(lm.own_counts(tokens)) == 2
    code, plain = lm.Code.of(lm.byte_counts(tokens), own), lm.Code.of(lm.byte_counts(tokens))
    assert len(code.spell(code.pairs(text))[0]) < len(plain.spell(plain.pairs(text))[0])
    shared = lm.Code.of(np.zeros((256, 256), np.int64), own)
    model = lm.Model(shared, {n: np.zeros(1 << 16, np.int8) for n in lm.CONTEXTS}, np.tile(lm.starting(), (lm.GATES, 1)))
    logs = model.score([(b"\xff" * 8 + b"qu", bytes([b])) for b in range(256)])
    assert abs(np.exp(logs).sum() - 1) < 1e-5 and shared.pairs(text)[4] >> 8 >= 256


def test_a_chunk_within_a_long_word_does_not_depend_on_its_group(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 700)
    model = toy_model(["x" * 3000])
    other, (_, second, *_) = (b"\xff" * 8, b"no end here"), lm.chunks([b"x" * 3000])
    assert model.score([other, second])[1] == pytest.approx(model.score([second])[0], rel=1e-5)
    assert (lm.hashes(lm.join([other, second])[0])[0][-50:] == lm.hashes(lm.join([second])[0])[0][-50:]).all()


def test_arrow_splits_texts_as_words_does():
    import pyarrow as pa

    texts = [None, "", " ", "A\x0bb\x0cC\x1cd\x85e\xa0f  İÉß\r\n", "\tZ[@`{ 中文 Q\x00q "] + [t for _, t in MANY]
    got = lm.split(pa.array(texts, pa.string())).cast(pa.list_(pa.binary())).to_pylist()
    assert [[w for w in g if w] for g in got] == [lm.words(t) for t in texts]


def brute_base(rows):
    folds = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 for d, _ in rows]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    c = Counter(x for own, f in zip(tokens, folds) if f for x in own)
    n, v = sum(c.values()), len(c)
    return {(d, f == 0, len(own), sum(c[x] > 0 for x in own), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), 6))
            for (d, _), own, f in zip(rows, tokens, folds)}


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_lm_scores_of_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = ODD + [(30, "It is a STOP"), (31, "a\x0ba É é")] + MANY[:20]
    got = lm.score(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(*r[:5], round(r["base_score"], 6)) for r in got} == brute_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and r["bits_per_byte"] > 0 for r in got)
    copies = [r["score"] for r in got if r["doc_id"] == 2]
    assert len(copies) == 2 and copies[0] == pytest.approx(copies[1], rel=1e-5)


def test_lm_scores_without_training_rows(spark):
    assert lm.score(empty_docs(spark)).count() == 0
    only = lm.score(odd_docs(spark, [(None, "a b"), (None, None)])).collect()
    assert {(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in only} == {(True, 3, 0, 0, 0.0), (True, 1, 0, 0, 0.0)}


def test_lm_query_equals_brute_force_and_beats_its_base(spark):
    big = "/root/testdata/sf0.01"
    docs = pq_file.read_table(f"{big}/documents.parquet").to_pandas()
    got = QUERIES["op13_lm_scoring"](spark, big).collect()
    assert {(*r[:5], round(r["base_score"], 6)) for r in got} == brute_base(list(zip(docs.doc_id, docs.text)))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_decoding_equals_the_library_on_ids_of_any_origin():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, draw = Tokenizer.from_file(path), bpe.Codec(path), np.random.default_rng(9)
    for n in (0, 1, 7, 500):
        ids = [int(i) for i in draw.integers(0, 49_408, n)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([49_406, 320, 49_407]) == library.decode([49_406, 320, 49_407], skip_special_tokens=False)
    assert own.decode([10**7]) == library.decode([10**7], skip_special_tokens=False) == ""


def test_fragments_equal_merging_one_pair_at_a_time():
    import public_tokenizers

    from tidemark.llm import bpe

    own, draw = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(2)

    def merged(parts):
        while True:
            found = [(own.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.ranks]
            if not found:
                return parts
            _, i = min(found)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    for _ in range(400):
        word = "".join(draw.choice(list("aaaeinorst'éß"), int(draw.integers(1, 90))))
        symbols = tuple(own.symbols(word))
        assert own.encode_fragment(symbols) == merged(list(symbols))


def test_cuts_of_bytes_are_cuts_of_symbols_and_merges_go_by_number():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, draw = bpe.WordBpe(path), Tokenizer.from_file(path), np.random.default_rng(3)
    for _ in range(400):
        word = "".join(draw.choice(list("aeinrstqzxjéß1'"), int(draw.integers(1, 60))))
        found = own.fragments(own.symbols(word))
        *inner, last = own.cut(word.encode())
        assert [len(f) for f in found] == [*map(len, inner), len(last)] and b"".join([*inner, last]) == word.encode()
        ids = [own.encode_inner(f) for f in inner] + [own.encode_closing(last)]
        assert ids == [[own.ids[t] for t in own.encode_fragment(f)] for f in found]
    word = "nzqth" * 30
    assert bpe.Codec(path).encode(word)[0] == library.encode(word, add_special_tokens=False).ids


def test_memo_keeps_what_is_in_use():
    from tidemark.llm.common import Memo

    made = []
    memo = Memo(lambda k: made.append(k) or len(k), 10, longest=5)
    for i in range(100):
        assert memo["hot"] == 3 and memo[f"k{i}"] == len(f"k{i}") and memo["long one"] == 8
    assert made.count("hot") == 1 and made.count("long one") == 100 and len(memo) + len(memo.old) <= 10
