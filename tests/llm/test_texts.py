"""Tokens, language model, quality, benchmark passages and surrogates on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from clickloom.llm import decontaminate, lm, pieces, pii, quality, tokenfile

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def test_pieces_equal_the_library(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    random.seed(1)
    alpha = "aab  \n\teotnh.,'の日é🙂\x00 theinger01<>"
    texts = ["".join(random.choices(alpha, k=random.randint(0, 50))) for _ in range(3000)]
    texts += [" " * k + "the" for k in range(60)] + ["a" + " " * k for k in range(60)]
    model = pieces.load(pieces.default_model())
    got = model.encode(texts)
    assert [g.tolist() for g in got] == sp.encode(texts)
    assert model.decode(np.concatenate(got), np.cumsum([0] + [len(g) for g in got])) == texts
    out = pieces.decode(pieces.encode(odd)).collect()
    assert len(out) == odd.count() and all(r.decoded == (r.text or "") for r in out)
    key = lambda r: (str(r.doc_id), str(r.text), r.ids, r.decoded)
    assert sorted(map(key, pieces.encode_decode(odd).collect())) == sorted(map(key, out))
    assert pieces.encode(none).count() == pieces.encode_decode(none).count() == 0


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert tokenfile.code_lengths(counts, 4).max() == 4
    for limit in (4, 5, 18):
        assert sum(2.0 ** -x for x in tokenfile.code_lengths(counts, limit)) <= 1
    assert tokenfile.code_lengths(np.array([9]), 18).tolist() == [1]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n) % 5000 for n in (1, 255, 256, 257, 70_000)]
    ids, counts = np.unique(np.concatenate(blocks), return_counts=True)
    code = tokenfile.Code(ids, tokenfile.code_lengths(counts, 18))
    assert all(np.array_equal(a, b) for a, b in zip(code.decode([code.encode(b) for b in blocks]), blocks))


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.default_model())
    enc = tokenfile.load(tokenfile.default_model())
    random.seed(2)
    texts = ["".join(random.choices("abcé ßÉ12'!?<|>endoftext\n\t\x1f 日ǅ", k=30)) for _ in range(2000)] + ["don't <|endoftext|> it's é"]
    for x in texts:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]
    path, code = tokenfile.write(odd)
    got = tokenfile.read(path, code, spark).orderBy("start").collect()
    assert len(got) == odd.count()
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    by_id = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert all(r.ids == [*t.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in got if r.doc_id is not None)
    path, code = tokenfile.write(none)
    assert tokenfile.read(path, code, spark).count() == 0


def test_language_model(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = {r.doc_id: [*(r.text or "").encode().translate(LOW).split(), None] for r in docs.collect()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = c.total(), len(c)
    base = model = 0.0
    for r in lm.score(docs).collect():
        w = words[r.doc_id]
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and math.isfinite(r.score)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base
    assert lm.score(odd).count() == odd.count() and lm.score(none).count() == 0


def test_quality_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score(none, model).count() == 0 and quality.keep(odd, model).columns == odd.columns
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, blank).collect()} == {1.0}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = quality.Attention()
    x, count, y = rng.normal(size=(9, quality.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.forward(x, count)[-1]) + (1 - y) * np.log(1 - m.forward(x, count)[-1]))
    for k, g in m.gradients(x, count, y).items():
        i = tuple(0 for _ in g.shape)
        m.p[k][i] += 1e-6
        high = loss()
        m.p[k][i] -= 2e-6
        assert abs((high - loss()) / 2e-6 - g[i]) < 1e-5
        m.p[k][i] += 1e-6


def brute_tiles(a, b, least):
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        used_a.update(range(i, i + k))
        used_b.update(range(j, j + k))
        total += k


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 25)).astype(np.uint64), rng.integers(1, 5, rng.integers(1, 40)).astype(np.uint64)
        found = decontaminate.tiles(a, b, 3)
        assert sum(n for _, _, n in found) == brute_tiles(a.tolist(), b.tolist(), 3)


def test_reordered_passages_are_found(spark, odd, none):
    item = "the first part of it stands here now and then the second part follows after that one"
    w = item.split()
    swapped = "Intro words. " + " ".join(w[9:]).upper() + "; something, between: " + " ".join(w[:9]) + " outro"
    docs = spark.createDataFrame([(1, swapped), (2, " ".join(w[:6])), (3, None), (4, ""), (5, "quite other text " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.score(docs, bench).collect()}
    assert got[1].contaminated and got[1].item_id == 7
    assert not any(got[i].contaminated for i in (2, 3, 4, 5)) and len(got) == 5
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.score(none, bench).count() == 0 and decontaminate.score(odd, bench.limit(0)).count() == odd.count()


def test_score_equals_brute_force_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [[str(w) for w in rng.choice(vocabulary, n)] for n in (12, 20, 20, 33, 4, 3, 2, 1)] + [[f"u{i}" for i in range(40)]]
    items.append(items[1])
    docs = [[str(w) for w in rng.choice(vocabulary, 60)] for _ in range(20)]
    for item in items:
        for n in (3, 4):
            parts = [item[i : i + n] for i in range(0, len(item), n)]
            docs.append([w for k in rng.permutation(len(parts)) for w in ["gap", *parts[k]]])
        docs.append(["other" if i % 5 == 4 else w for i, w in enumerate(item)])
    # reordered, and every fifth word replaced: all tiles are shorter than five words
    u = items[8]
    docs += [[w for i in range(36, -1, -4) for w in u[i : i + 4]], ["other" if i % 5 == 4 else w for i, w in enumerate(u)]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in decontaminate.score(d, b).collect()}
    clean = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    for i, doc in enumerate(docs):
        share = [brute_tiles(w, doc, min(3, len(w))) / len(w) for w in items]
        share = [int(c > 0) if len(w) < 3 else c for w, c in zip(items, share)]
        assert got[i].coverage == max(share) and got[i].n_items == sum(c >= 0.8 for c in share)
        assert got[i].item_id == (share.index(max(share)) if max(share) else None)
        assert got[i].contaminated == (max(share) >= 0.8) == (i not in clean)
    assert all(got[len(docs) - k].contaminated for k in (1, 2)) and got[len(docs) - 1].coverage == 0.8


def test_surrogates(spark, odd, none):
    text = "Mail Anna.Lee@Site.org or anna.lee@site.org, call +1 (555) 123-4567 or +1 555 123 4567, from 10.200.3.44; card 4111 1111 1111 1111. Frau Anna Schmidt met Mr. Smith; token = \"0123456789abcdef0123\""
    docs = spark.createDataFrame([(1, text), (2, "again anna.lee@site.org"), (3, None), (3, None), (None, text)], "doc_id long, text string")
    got = pii.pseudonymise(docs, b"k").collect()
    assert len(got) == 5
    new = next(r.text for r in got if r.doc_id == 1)
    found = [n for _, _, k, n in pii.detect(new) if k == "email"]
    assert len(found) == 2 and found[0] == found[1] != "anna.lee@site.org"
    assert found[0] in next(r.text for r in got if r.doc_id == 2)
    assert new == next(r.text for r in got if r.doc_id is None)
    for old in ("Lee", "555", "4111", "10.200", "Schmidt", "Smith", "0123456789abcdef"):
        assert old not in new
    card = next(n for _, _, k, n in pii.detect(new) if k == "card")
    assert pii.luhn(card) and card[0] == "4"
    assert pii.pseudonymise(odd, b"k").columns == [*odd.columns, "n_entities"] and pii.pseudonymise(none, b"k").count() == 0


def test_later_mentions_take_the_same_surrogate(spark):
    text = "Frau Anna Schmidt came. Schmidt's car; SCHMIDT (Schmidt) and Anna, not Schmidtke or Schmidt2. Mr. Smith's dog saw Mr. Smith, Schmidt-Werke."
    docs = spark.createDataFrame([(1, text), (2, "Schmidt alone")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    new = got[1].text
    name, given = new.split()[2].rstrip("."), new.split()[1]
    assert new.count(name) == 4 and name.upper() in new and new.count(given) == 2
    assert f"{name}'s car; {name.upper()} ({name}) and {given}, not Schmidtke or Schmidt2." in new and f"{name}-Werke" in new
    assert "Smith" not in new and len({w.rstrip(".,").removesuffix("'s") for a, w in zip(new.split(), new.split()[1:]) if a == "Mr."}) == 1
    assert got[2].text == "Schmidt alone"


def test_surrogates_keep_the_script():
    names = {"greek": "Παπαδόπουλος", "armenian": "Սարգսյան", "arabic": "محمد", "hebrew": "כהן", "georgian": "ბერიძე", "cjk": "山田", "hangul": "김철수", "devanagari": "शर्मा", "thai": "สมชาย"}
    for script, name in names.items():
        found = pii.detect(f"Mr. {name}, he")
        assert [(k, n) for _, _, k, n in found] == [(f"surname:{script}:n", name.lower())]
        new = pii.surrogate(b"k", found[0][2], found[0][3])
        assert new != name.lower() and {pii.script(c) for c in new} == {script}
        local = pii.surrogate(b"k", "email", f"{name.lower()}@site.org").split("@")[0]
        assert {pii.script(c) for c in local if c.isalpha()} == {script} and local != name.lower()


def test_surrogates_stay_distinct(spark):
    rows = [(f"given:latin:f", f"name{i}") for i in range(200)] + [("address", f"1.1.1.{i}") for i in range(10)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, norm string"), b"k").collect()
    real = {(k.split(":")[0], n) for k, n in rows}
    new = [(r.kind.split(":")[0], r.new) for r in got]
    assert len(got) == len(rows) and len(set(new)) == len(new) and not set(new) & real


def test_full_shapes_widen(spark):
    """More entities than a shape has free values: octets of one digit, secrets, cards and phones that differ in few digits."""
    rows = [("address", ".".join(f"{i:04d}")) for i in range(6000)] + [("phone", f"+4912{i:03d}") for i in range(900)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, norm string"), b"k").collect()
    new = [(r.kind, r.new) for r in got]
    assert len(set(new)) == len(new) == len(rows) and not set(new) & set(rows)
    assert all(r.new.startswith("+49") for r in got if r.kind == "phone")
    for kind, norm, mention in (("email", "ab@x.org", "Ab@X.org"), ("card", "4111111111111111", "4111 1111 1111 1111"), ("secret", "0a1b2c3d4e5f60718293", "0a1b2c3d4e5f60718293")):
        long = pii.surrogate(b"k", kind, norm, 3 * pii.WIDEN)
        assert len(long) == len(norm) + 3
        written = pii.write_like(mention, kind, norm, long)
        assert len(written) == len(mention) + 3 and "".join(c for c in written.lower() if c != " ") == long
    assert pii.luhn(pii.surrogate(b"k", "card", "4111111111111111", 3 * pii.WIDEN))


def test_phones_keep_their_country_code():
    for number, code in (("+33123456789", "+33"), ("+49301234567", "+49"), ("+15551234567", "+1"), ("+351912345678", "+351"), ("+79161234567", "+7"), ("+4930123456", "+49")):
        [(_, _, kind, norm)] = pii.detect(f"call {number[:len(code)]} {number[len(code):]} now")
        new = pii.surrogate(b"k", kind, norm)
        assert (kind, norm) == ("phone", number) and new.startswith(code) and len(new) == len(number) and new != number


def test_rows_without_id_are_told_apart_by_text(spark):
    """Their redrawn entities are joined by text, not kept in one list of all rows without id."""
    texts = [f"from {'.'.join(f'{i:04d}')} and {'.'.join(f'{i + 1:04d}')}" for i in range(0, 4000, 2)]
    docs = spark.createDataFrame([(None, t, 1, 2) for t in texts] + [(None, texts[0], 1, 2), (7, texts[0], 1, 2)], "doc_id long, text string, _id int, _0 int")
    got = pii.pseudonymise(docs, b"k")
    assert got.columns == [*docs.columns, "n_entities"]
    rows = got.collect()
    assert len(rows) == 2002 and {r.n_entities for r in rows} == {2}
    new = {a for r in rows for a in r.text.removeprefix("from ").split(" and ")}
    assert len(new) == 4000 and not new & {".".join(f"{i:04d}") for i in range(4000)}
    assert len({r.text for r in rows}) == 2000


def test_training_reads_all_passages_within_the_bound(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(128 * n)), "L", 1.0) for i, n in enumerate([1, 70, 200, 3] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, n double")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as quality")
    seen = []
    fit, quality.Attention.fit = quality.Attention.fit, lambda self, bags, y, *a, **k: seen.append([len(b) for b in bags]) or self
    try:
        quality.train(docs, labels)
        quality.train(docs, labels, max_passages=150)
    finally:
        quality.Attention.fit = fit
    known = [n for (i, *_), n in zip(rows, [1, 70, 200, 3] * 5) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(seen[0]) == sorted(known) and max(known) == 200
    assert sum(seen[1]) <= 150 and seen[1]
