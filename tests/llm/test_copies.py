"""Exact and near copies, and repeated strings, against brute force."""

import hashlib

import numpy as np
import xxhash

from clickloom.llm import exact_dedup, golomb, simhash, suffix_dedup
from clickloom.llm.components import components

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100, 70_000):
        v = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert np.array_equal(golomb.decode(golomb.encode(v)), v)
    v = np.array([0, 1, 2, (1 << 64) - 1], np.uint64)
    assert np.array_equal(golomb.decode(golomb.encode(v)), v)


def test_exact_classes(odd, none):
    rows = odd.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").encode().translate(LOW), []).append(r.doc_id)
    got = exact_dedup.classes(odd).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.classes(none).count() == 0


def test_exact_dedup_keeps_columns_and_one_row_each(odd, none):
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    texts = [(r.text or "").encode().translate(LOW) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").encode().translate(LOW) for r in odd.collect()})
    assert exact_dedup.dedup(none).count() == 0


def test_exact_dedup_shuffles_texts_once(spark, odd):
    """Also where no side of a join is small: the rest and the repeated rows came from two joins with all texts."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (small, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            plan = exact_dedup.dedup(odd)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Scan ExistingRDD") == 1
            above = [line for line in plan[: plan.index("Scan ExistingRDD")].splitlines() if "Exchange hashpartitioning" in line]
            assert len(above) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_suspects_are_found_without_a_shuffle_of_texts(spark, odd):
    """Where no side of a join is small, all texts were shuffled to meet the suspects' ids."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = exact_dedup.classes(odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Scan ExistingRDD") == 1
    lines = plan[: plan.index("Scan ExistingRDD")].splitlines()
    first = max(i for i, line in enumerate(lines) if "Exchange hash" in line)
    assert "hashpartitioning(norm" in lines[first] and any("HashAggregate(keys=[norm" in line for line in lines[first:])


def test_marked_rows_hold_all_suspects_and_few_others(spark):
    source = spark.range(4000).selectExpr("id - 2000 AS doc_id", "'t' AS text").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS doc_id, 't' AS text"))
    suspects = source.where("doc_id % 7 = 0 OR doc_id IS NULL")
    got = {r.doc_id for r in exact_dedup._marked(source, suspects).collect()}
    want = {r.doc_id for r in suspects.collect()}
    assert None in want and want <= got and len(got) <= len(want) + 10


def brute_print(text):
    w = (text or "").encode().translate(LOW).split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    texts = [r.text for r in odd.collect()]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert got.tolist() == [brute_print(t) for t in texts]


def test_probes_meet_every_near_pair():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 3):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = a.copy()
        for k in range(len(b)):
            for f in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                b[k] ^= np.uint64(1 << int(f))
        keys = [{} for _ in range(2)]
        for side, v in enumerate((a, b)):
            for at, key in simhash.probes(v, bits):
                for i, k in zip(np.broadcast_to(at, len(key)).tolist(), key.tolist()):
                    keys[side].setdefault(i, set()).add(k)
        assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_large_groups_find_the_same_links():
    rng = np.random.default_rng(3)
    v = np.unique(np.uint64(7) ^ np.left_shift(np.uint64(1), rng.integers(0, 64, 4000, dtype=np.uint64)) ^ rng.integers(0, 1 << 12, 4000, dtype=np.uint64))[:2500]
    want = {(int(x), int(y)) for k, x in enumerate(v) for y in v[k + 1 :] if int(x ^ y).bit_count() <= 1}
    i, j = simhash.links(v, 1)
    assert {tuple(sorted((int(v[a]), int(v[b])))) for a, b in zip(i, j)} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[k] == 100 for k in range(100, 160)) and got[61] == 60
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(odd, none):
    rows = [(r.doc_id, brute_print(r.text)) for r in odd.collect()]
    known = {}
    for d, f in rows:
        if d is not None:
            known[f] = min(d, known.get(f, d))
    top = {f: f for f in known}
    changed = True
    while changed:
        changed = False
        for f in known:
            for g in known:
                if (f ^ g).bit_count() <= 2 and known[top[f]] > known[top[g]]:
                    top[f], changed = top[g], True
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        f = r.fp % (1 << 64)
        assert r.component_id == (known[top[f]] if f in known else None)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.dedup(odd).columns == odd.columns and simhash.dedup(none).count() == 0


def brute_repeats(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[d] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def repeats(spark):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    line, passage = text(9), text(60)
    docs = [(i, text(40) + line + text(30) + (passage[i : i + 250] if i % 3 else "") + text(10)) for i in range(60)]
    docs += [(60, docs[3][1]), (61, docs[3][1][50:400]), (62, "ab" * 300), (63, "z" * 400), (64, "z" * 99), (65, None), (66, "é" * 200), (67, passage + passage)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def test_repeated_strings(spark, odd, none):
    docs, df = repeats(spark)
    want = brute_repeats(docs)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, text=True).collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_frequent_groups_give_the_same(spark, monkeypatch):
    docs, df = repeats(spark)
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", 2)
    large = [g for g in suffix_dedup._merge.__code__.co_names if g == "LARGE_GROUP"]
    assert large
    rows = suffix_dedup.keys(np.array([len(docs[0][1])]), np.arange(0, 200, 7), np.frombuffer(docs[0][1].encode(), np.uint8))[0]
    run = sorted({r.tobytes() for r in rows})
    assert [k for _, k in suffix_dedup.front_decode(suffix_dedup.front_code(run))] == run


def test_merge_carries_common_prefixes():
    rng = np.random.default_rng(4)
    runs = [sorted(bytes(rng.integers(0, 3, suffix_dedup.KEY, dtype=np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(7)]
    coded = [((lcp, key, n) for lcp, key in suffix_dedup.front_decode(suffix_dedup.front_code(r))) if r else iter(()) for n, r in enumerate(runs)]
    got = list(suffix_dedup.merge(coded))
    assert [k for _, k, _ in got] == sorted(k for r in runs for k in r)
    for (_, a, _), (lcp, b, _) in zip(got, got[1:]):
        assert lcp == suffix_dedup.common(a, b, 0)


def test_near_copies_are_judged_by_row(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = " ".join(f"beta{i}" for i in range(40))
    c = " ".join(f"gamma{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, row string, part int, fp int")
    kept = simhash.dedup(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("5", b), ("None", c), ("7", None)], key=lambda r: r[0])
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_anchors_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 50, 99, 100, 5000, 3, 20_000, 250)]
    whole = suffix_dedup.anchors(texts)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    assert np.array_equal(suffix_dedup.anchors(texts), whole)
