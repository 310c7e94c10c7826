"""Ranked search, hard negatives and byte-level BPE against brute force and the tiktoken library."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from clickloom.llm import bpe, negatives, ranked

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_terms(text):
    out, word = [], []
    for c in text or "":
        if c.isascii() and not c.isalnum():
            out.append("".join(word))
            word = []
        else:
            word.append(c.lower() if "A" <= c <= "Z" else c)
    return [w for w in [*out, "".join(word)] if w]


def brute_search(docs, items, top=10):
    split = [(d, brute_terms(t)) for d, t in docs]
    split = [(d, t) for d, t in split if t]
    n, length = len(split), sum(len(t) for _, t in split)
    df = Counter(t for _, own in split for t in set(own))
    out = []
    for item, text in items:
        hits = []
        for d, own in split:
            tf, m = Counter(own), 25 + 75 * len(own) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in brute_terms(text) if tf[t]
            )
            if score > 0:
                hits.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, h[3], -h[0]) for k, h in enumerate(sorted(hits)[:top])]
    return out


def made(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "X9"]
    share = 1 / np.arange(1, len(words) + 1)
    text = [" ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum())) for _ in range(n)]
    text[::7] = [text[0]] * len(text[::7])  # many copies
    docs = [(i, t) for i, t in enumerate(text)] + [(None, text[3]), (None, None), (n, ""), (3, text[3]), (n + 1, "w1 " * 20_000), (n + 2, ".,;")]
    items = [(k, text[k][:80]) for k in range(0, 40, 3)] + [(100, None), (101, ""), (102, "none of these"), (0, text[0][:80]), (103, "w250 w250 W250")]
    return docs, items


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = made(spark)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, norm int").repartition(5)
    asked = spark.createDataFrame([(*i, 2, "y") for i in items], "item_id long, text string, score int, q string")
    want = sorted(map(str, brute_search(docs, items)))
    assert sorted(str(tuple(r)) for r in ranked.search(table, asked).collect()) == want
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)  # several blocks of items
    assert sorted(str(tuple(r)) for r in ranked.search(table, asked).collect()) == want
    none = table.limit(0)
    assert ranked.search(none, asked).count() == 0 and ranked.search(table, asked.limit(0)).count() == 0


def test_buckets_are_pruned_without_loss():
    rng = np.random.default_rng(2)
    docs, length = 600, 40
    query = ranked.Query(np.arange(20), np.ones(20, np.int64), rng.integers(1, 5000, 20))
    term = np.concatenate([np.sort(rng.choice(200, length, replace=False)) for _ in range(docs)])
    weight = np.zeros(200)
    weight[query.term] = query.weight
    impact = rng.integers(1, 100_000, len(term))
    part = np.sqrt(weight[term]) * impact
    norm = np.sqrt((part**2).reshape(docs, -1).sum(1))
    order = np.argsort(-norm, kind="stable")
    best, bar, scored = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], np.ones(1, np.int64), 0
    grid_t, grid_i = term.reshape(docs, -1), impact.reshape(docs, -1)
    for a in range(0, docs, 50):
        own = order[a : a + 50]
        scored += ranked.search_bucket(own, norm[own], grid_t[own].ravel(), np.full(len(own), length), grid_i[own].ravel(), [query], best, bar, 5)
    score = (weight[grid_t].astype(np.int64) * grid_i).sum(1)
    want = np.lexsort((np.arange(docs), -score))[:5]
    assert best[0][1].tolist() == want.tolist() and best[0][0].tolist() == score[want].tolist()
    assert scored < docs / 2


def brute_mine(rows, every=100):
    kept = [(i, l, np.floor(256 * np.array(v, float)).astype(int)) for i, v, l in rows
            if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in kept), default=0)
    kept = [(i, l, np.pad(v, (0, width - len(v)))) for i, l, v in kept]
    out = []
    for a, (i, l, v) in enumerate(kept):
        if i is None or i % every:
            continue
        other = sorted(((-int(v @ w), j is not None, j or 0, m) for b, (j, m, w) in enumerate(kept) if b != a), key=lambda o: o[:3])
        for s, known, p, _ in [o for o in other if o[3] == l][:5]:
            fit = [o for o in other if o[3] != l and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, p if known else None, k + 1, o[2] if o[1] else None, -s, -o[0]) for k, o in enumerate(fit)]
    return sorted(map(str, out))


def vectors(spark, n=700):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12))
    v = centre[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, 12))
    v[5::3] = v[5]  # one very common vector
    rows = [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(100, rows[7][1], 1), (100, rows[7][1], 1), (None, rows[8][1], 2), (900, [0.0] * 12, 1), (1000, [1.0, 2.0], 0), (1100, [], 1)]
    rows += [(1200, None, 1), (1300, rows[3][1], None), (1400, [None] + rows[3][1][1:], 1), (1500, [float("nan")] * 12, 1), (1600, [float("inf")] * 12, 1)]
    return rows


@pytest.mark.parametrize("block", [8192, 4])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    rows = vectors(spark)
    monkeypatch.setattr(negatives, "ANCHORS", block)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, key int").repartition(6)
    assert sorted(str(tuple(r)) for r in negatives.mine(table).collect()) == brute_mine(rows)
    assert negatives.mine(table.limit(0)).count() == 0


def test_intervals_hold_every_score():
    rng = np.random.default_rng(4)
    part = rng.integers(-300, 300, (200, 16))
    part[7] = 0
    reference = negatives.fit_references(part[:50].astype(float), 5)
    norm, angle = negatives.angles(part, reference)
    x = negatives.Rows(np.arange(200), np.zeros(200, int), np.arange(200), norm, angle, part)
    low, high = negatives.bounds(x, x)
    exact = part @ part.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (negatives.reach(x, x) >= exact.max(1)).all()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P

    ranks = bpe.load(bpe.default_ranks(), bpe.default_pattern()).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  ", "a \n b", "a\tb c", "\x1c a\x1f b", "it's  they'll 'S", "aaaaaaaaaaaaaaa", "ab" * 3000, "été  日本語🙂 x", " a", "é", "a  b", "1234 5678  9", "<|endoftext|>", "\x00 \x00"]


def test_bpe_equals_the_library(spark, odd, none, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 2000)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 500)
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 40)
    table = odd.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    for packed in (False, True):
        found = bpe.decode(bpe.encode(table, packed=packed)).collect()
        assert len(found) == table.count()
        for r in found:
            ids = np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids
            assert ids == library.encode_ordinary(r.text or ""), r.text
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none).count() == 0
    assert set(bpe.encode(odd).columns) == set(odd.columns)


def test_bpe_of_the_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in bpe.encode(docs.select("text")).collect():
        assert r.ids == library.encode_ordinary(r.text or "")


def test_other_pattern_and_unordered_ranks(spark, tmp_path, library):
    import base64

    docs = spark.createDataFrame([("some text  here, 12 and more",)], "text string")
    pattern = r"\S+\s*|\s+"
    own = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    assert bpe.encode(docs, pattern=pattern).first().ids == own.encode_ordinary(docs.first().text)
    ranks = {bytes([b]): b + 2 for b in range(256)} | {b"abc": 0, b"ab": 1}
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    with pytest.raises(ValueError):
        bpe.encode(docs, path=str(path))


def test_query_digests(spark):
    from clickloom.llm import queries

    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = {r.doc_id: r for r in bpe.encode(docs).collect()}
    for i, r in ids.items():
        assert got[i].n_tokens == len(r.ids) and got[i].ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
