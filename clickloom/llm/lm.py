"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of words after a word, of words alone and of any word are mixed; the
mixture weights depend on how often the context word was seen, and expectation-maximisation learns them
on counts of training documents that were held back from the estimates.

Counting and scoring share one exchange. Documents are packed in batches; a batch sends its distinct
words and word pairs with their counts once to owners, owners add up and answer with the corpus counts
in the same order. So a frequent word costs a batch one entry, and the counts are those of the whole
corpus. Keys are 64-bit hashes of words.

Tokens are words without ASCII white space, A-Z lowered, and one end token for each document, which is
also the context of the first word. Null text is empty and has the end token alone. A document without
id counts as training.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import ASCII_LOWER, rows, tasks, text_batches
from clickloom.llm.golomb import runs
from clickloom.session import stage

FOLDS, EVAL_FOLD = 7, 2
DELETED = 10  # one of so many training documents is held back to learn the weights
BATCH_BYTES = 6 << 20
END = 0x9E3779B97F4A7C15  # id of the end token
BUCKETS = 40
BINS = 8  # histogram bins per factor of two of a probability
ZERO = -9999
EVAL, ESTIMATE, HELD = 0, 1, 2


def role(doc_id) -> int:
    if doc_id is None:
        return ESTIMATE
    c = zlib.crc32(str(doc_id).encode())
    return EVAL if c % FOLDS == EVAL_FOLD else HELD if c // FOLDS % DELETED == 0 else ESTIMATE


def tokens(text: bytes) -> np.ndarray:
    w = text.translate(ASCII_LOWER).split()
    return np.fromiter((*map(xxhash.xxh64_intdigest, w), END), np.uint64, len(w) + 1)


def pack(ids: list, texts: list[bytes]) -> bytes:
    """Documents of a batch in one compressed value. Text packs smaller than its tokens."""
    head = struct.pack("<I", len(ids)) + np.array([i is None for i in ids], np.uint8).tobytes()
    head += np.array([0 if i is None else i for i in ids], np.int64).tobytes() + np.array([len(t) for t in texts], np.int64).tobytes()
    return zstandard.compress(head + b"".join(texts), 3)


def unpack(blob: bytes) -> tuple[list, list[bytes]]:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    none = np.frombuffer(raw, np.uint8, n, 4).tolist()
    ids = np.frombuffer(raw, np.int64, n, 4 + n).tolist()
    ends = (np.cumsum(np.frombuffer(raw, np.int64, n, 4 + 9 * n)) + 4 + 17 * n).tolist()
    texts = [raw[a:b] for a, b in zip([4 + 17 * n, *ends], ends)]
    return [None if no else i for i, no in zip(ids, none)], texts


class Batch:
    """Documents as indices into the batch's own vocabulary, and their distinct word pairs."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, roles: np.ndarray, size: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.ids, self.none, self.roles, self.size, self.words, self.at = ids, none, roles, size, words, at
        end = int(np.searchsorted(words, np.uint64(END)))
        before = np.concatenate([[end], at[:-1]]).astype(np.int64)  # a document ends with the end token
        pair, self.pair_of = np.unique(before * len(words) + at, return_inverse=True)
        self.context, self.word = pair // len(words), pair % len(words)
        h = (words[self.context] ^ (words[self.context] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[self.word]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.pair_key = h ^ (h >> np.uint64(32))
        self.pair_order = np.argsort(self.pair_key, kind="stable")
        self.before = before
        self.doc = np.repeat(np.arange(len(size)), size)

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Batch:
        each = [tokens(t) for t in texts]
        words, at = np.unique(np.concatenate(each), return_inverse=True)
        return cls(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]),
                   np.array([role(i) for i in ids], np.uint8), np.array([len(e) for e in each], np.int64), words, at)

    @classmethod
    def unpack(cls, blob: bytes) -> Batch:
        return cls.of(*unpack(blob))

    def sent(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, sorted keys, counts to estimate from, counts of all training documents)."""
        by = self.roles[self.doc]
        out = []
        for kind, keys, of in ((1, self.words, self.at), (2, self.pair_key, self.pair_of)):
            est = np.bincount(of[by == ESTIMATE], minlength=len(keys))
            train = np.bincount(of[by != EVAL], minlength=len(keys))
            order = self.pair_order if kind == 2 else slice(None)
            out.append((kind, keys[order], est[order].astype(np.uint32), train[order].astype(np.uint32)))
        return out

    def counts(self, answers: pd.DataFrame, owners: int):
        """The answered corpus counts: (words, pairs), each (estimate, training)."""
        got = {(k, o): b for k, o, b in answers[["kind", "owner", "blob"]].itertuples(index=False)}
        out = []
        for kind, keys in ((1, self.words), (2, self.pair_key[self.pair_order])):
            both = [np.frombuffer(zstandard.decompress(got[kind, o]), np.int64).reshape(2, -1) for o, _, _ in runs(keys, owners)]
            both = np.concatenate(both, axis=1)
            if kind == 2:
                ranked, both = both, np.empty_like(both)
                both[:, self.pair_order] = ranked
            out.append(both)
        return out


def _pack_keys(keys: np.ndarray, est: np.ndarray, train: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = 8 if len(gaps) and int(gaps[1:].max(initial=0)) >> 48 else 6
    body = np.ascontiguousarray(gaps[1:].view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()
    counts = zstandard.compress(est.tobytes() + train.tobytes(), 1)
    return struct.pack("<IBQ", len(keys), wide, int(keys[0])) + body + counts


def _unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, first = struct.unpack_from("<IBQ", blob)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :wide] = np.frombuffer(blob, np.uint8, (n - 1) * wide, 13).reshape(-1, wide)
    keys = gaps.view(np.uint64)[:, 0].copy()
    keys[0] = first
    counts = np.frombuffer(zstandard.decompress(blob[13 + (n - 1) * wide :]), np.uint32).reshape(2, n)
    return np.cumsum(keys, dtype=np.uint64), counts


PACKED = pa.schema([("part", pa.int64()), ("held", pa.bool_()), ("blob", pa.binary())])


def _pack(batches):
    """Batches of documents; those that are held back from the estimates are packed apart."""
    part, some = TaskContext.get().partitionId() << 32, {False: ([], []), True: ([], [])}
    size = {False: 0, True: 0}
    for ids, texts in text_batches(batches, BATCH_BYTES):
        for i, t in zip(ids, texts):
            held = role(i) == HELD
            if some[held][0] and size[held] + len(t) > BATCH_BYTES:
                yield rows(PACKED, [part], [held], [pack(*some[held])])
                some[held], size[held], part = ([], []), 0, part + 1
            some[held][0].append(i)
            some[held][1].append(t)
            size[held] += len(t)
    for held in (False, True):
        if some[held][0]:
            yield rows(PACKED, [part], [held], [pack(*some[held])])
            part += 1


SENT = pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "part long, owner int, kind int, blob binary"


def _send(owners: int):
    def run(batches):
        for rb in batches:
            for part, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                out = []
                for k, keys, est, train in Batch.unpack(blob).sent():
                    out += [(part, o, k, _pack_keys(keys[a:e], est[a:e], train[a:e])) for o, a, e in runs(keys, owners)]
                yield rows(SENT, *zip(*out))

    return run


ANSWER = "part long, owner int, kind int, blob binary, n_est long, n_train long, v long"


def _answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    got = [_unpack_keys(b) for b in pdf["blob"]]
    keys, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    total = [np.bincount(where, weights=np.concatenate([g[1][i] for g in got]), minlength=len(keys)).astype(np.int64) for i in (0, 1)]
    del keys
    out, at = [], 0
    for part, owner, kind, (k, _) in zip(pdf["part"], pdf["owner"], pdf["kind"], got):
        pick = where[at : at + len(k)]
        out.append((part, owner, kind, zstandard.compress(np.stack([t[pick] for t in total]).tobytes(), 1), 0, 0, 0))
        at += len(k)
    if pdf["kind"].iloc[0] == 1:
        out.append((-1, -1, 0, b"", int(total[0].sum()), int(total[1].sum()), int((total[1] > 0).sum())))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


def bucket(context: np.ndarray) -> np.ndarray:
    """Context counts by powers of two; 0 for a context that was never seen."""
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def _binned(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), ZERO)
    some = p > 0
    out[some] = np.round(np.log2(p[some]) * BINS)
    return out


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _histogram(owners: int, n_est: int):
    def run(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "pair", "word", "n"]
        if not len(batch):
            return pd.DataFrame({c: [] for c in names})
        b = Batch.unpack(batch["blob"].iloc[0])
        (word, _), (pair, _) = b.counts(answers, owners)
        context = word[b.before]
        cells = np.stack([bucket(context), _binned(_share(pair[b.pair_of], context)), _binned(word[b.at] / max(1, n_est))])
        cells, n = np.unique(cells[:, (b.roles == HELD)[b.doc]], axis=1, return_counts=True)
        return pd.DataFrame(dict(zip(names, [*cells, n])))

    return run


def learn(cells: pd.DataFrame, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, any) of every bucket by expectation-maximisation.

    A bucket without held-back tokens takes the weights of all of them together.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    chance = lambda x: np.where(x == ZERO, 0.0, 2.0 ** (x / BINS))
    p = np.stack([chance(cells["pair"].to_numpy()), chance(cells["word"].to_numpy()), np.full(len(cells), 1 / (v + 1))], 1)
    n, of = cells["n"].to_numpy(float), cells["bucket"].to_numpy()

    def fit(p, n):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * w
            w = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) / n.sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    weights[:] = fit(p, n)
    for b in np.unique(of):
        weights[b] = fit(p[of == b], n[of == b])
    return weights


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(owners: int, weights: np.ndarray, n: int, v: int):
    def run(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORE.split(", ")]
        if not len(batch):
            return pd.DataFrame({c: [] for c in names})
        b = Batch.unpack(batch["blob"].iloc[0])
        (_, word), (_, pair) = b.counts(answers, owners)
        context, own = word[b.before], word[b.at]
        w = weights[bucket(context)]
        p = w[:, 0] * _share(pair[b.pair_of], context) + w[:, 1] * own / max(1, n) + w[:, 2] / (v + 1)
        docs = len(b.size)
        out = pd.DataFrame({
            "doc_id": pd.array(b.ids, "Int64"), "held_out": b.roles == EVAL, "n_tokens": b.size,
            "n_known": np.bincount(b.doc[own > 0], minlength=docs), "train_tokens": n,
            "base_score": np.bincount(b.doc, weights=np.log10((own + 1) / (n + v + 1)), minlength=docs),
            "score": np.bincount(b.doc, weights=np.log10(p), minlength=docs),
        })
        out.loc[b.none, "doc_id"] = pd.NA
        return out

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = tasks(spark, size, 16 << 20)
    batches = stage(source.mapInArrow(_pack, "part long, held boolean, blob binary"), "batches")
    sent = batches.select("part", "blob").mapInArrow(_send(owners), SENT_DDL)
    answers = stage(sent.groupBy("owner", "kind").applyInPandas(_answer, ANSWER), "counts")
    total = answers.where("part = -1").agg(F.sum("n_est"), F.sum("n_train"), F.sum("v")).first()
    n_est, n, v = (int(x or 0) for x in total)
    back = answers.where("part >= 0").select("part", "owner", "kind", "blob")
    held = batches.where("held")
    cells = (
        held.groupBy("part").cogroup(back.join(held.select("part"), "part", "left_semi").groupBy("part"))
        .applyInPandas(_histogram(owners, n_est), "bucket long, pair long, word long, n long")
        .groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
    )
    # at most BUCKETS x bins x bins cells, whatever the corpus
    weights = learn(cells.toPandas(), v)
    return batches.groupBy("part").cogroup(back.groupBy("part")).applyInPandas(_score(owners, weights, n, v), SCORE)
