"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages of 128 words. Every passage is encoded from its own text (kinds of
bytes, word shapes, repetition), a gated attention learned from document labels weighs the passages,
and the weighted representation gives the score. Labels, lang, source and doc_id are no inputs.

The model is fitted on at most MAX_DOCS labelled documents with MAX_PASSAGES passages in all, drawn by a
hash of the id; each gives all of its passages. Scoring reads all passages of all documents. Null and
empty texts are one passage without words. Rows are scored one by one, so repeated rows and ties need no
rule (a repeated labelled document is learned from as often as it occurs); an empty table has no
scores, and further columns are not read. A document with several labels counts as good when their mean is at
least one half; null labels are left out. Without labels of both kinds all documents score the share
of good ones (1 when there are none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import rows, text_batches
from clickloom.session import stage

MAX_DOCS = 6000
MAX_PASSAGES = 120_000
PASSAGE_WORDS = 128
THRESHOLD = 0.3
FOLDS = 5
WIDTH, GATE = 24, 12

KINDS = 16
_KIND = np.full(256, 15, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
for _k, _c in enumerate("!|*#$%&.,@"):
    _KIND[ord(_c)] = 5 + _k
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
FEATURES = 3 * KINDS + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = _KIND[buf]
    solid = kind != 0
    begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    first = np.searchsorted(begin, base)  # first word of each text
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    lead = np.cumsum(count) - count
    total = int(count.sum())
    x = np.zeros((total, FEATURES))
    x[:, -1] = -1.0
    if not len(begin):
        return x, count
    doc = np.repeat(np.arange(len(texts)), n_words)
    of = lead[doc] + (np.arange(len(begin)) - first[doc]) // PASSAGE_WORDS
    size = np.bincount(of, minlength=total).astype(float)
    safe = np.maximum(size, 1)
    word = np.repeat(np.arange(len(begin)), end - begin)
    at = np.flatnonzero(solid)
    bytes_of = np.bincount(of[word] * KINDS + kind[at], minlength=total * KINDS).reshape(total, KINDS)
    x[:, :KINDS] = bytes_of / np.maximum(bytes_of.sum(1, keepdims=True), 1)
    x[:, KINDS : 2 * KINDS] = np.bincount(of * KINDS + kind[end - 1], minlength=total * KINDS).reshape(total, KINDS) / safe[:, None]
    x[:, 2 * KINDS : 3 * KINDS] = np.bincount(of * KINDS + kind[begin], minlength=total * KINDS).reshape(total, KINDS) / safe[:, None]
    offset = (at - begin[word]) & 63
    h = np.add.reduceat((buf[at].astype(np.uint64) + np.uint64(1)) * _POWERS[offset], np.searchsorted(at, begin))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    own = h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, pick = np.unique(own, return_index=True)
    x[:, -6] = np.bincount(of, weights=same, minlength=total) / safe
    x[:, -5] = np.bincount(of[pick], minlength=total) / safe
    x[:, -4] = np.bincount(of, weights=end - begin, minlength=total) / safe / 10
    x[:, -3] = np.bincount(of, weights=(end - begin) == 1, minlength=total) / safe
    x[:, -2] = np.log1p(size) / 5
    x[:, -1] = 0.0
    return x, count


class Attention:
    """Encoder, gated attention and output layer, trained with Adam on whole bags."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(FEATURES, WIDTH), "b": np.zeros(WIDTH), "V": g(WIDTH, GATE), "U": g(WIDTH, GATE),
                  "w": g(GATE), "c": g(WIDTH), "o": np.zeros(1)}
        self.mean, self.scale, self.prior = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x, count):
        p, lead = self.p, np.cumsum(count) - count
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, lead), count))
        a = e / np.repeat(np.add.reduceat(e, lead), count)
        z = np.add.reduceat(a[:, None] * h, lead)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["o"], -30, 30)))
        return h, t, s, a, z, y

    def score(self, x, count):
        return np.full(len(count), self.prior) if self.prior is not None else self.forward(x, count)[-1]

    def gradients(self, x, count, label):
        p, lead = self.p, np.cumsum(count) - count
        h, t, s, a, z, y = self.forward(x, count)
        dy = (y - label) / len(label)
        dz = np.repeat(dy[:, None] * p["c"], count, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, lead), count))
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
                "w": (t * s).T @ de, "c": z.T @ dy, "o": dy.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 15, size: int = 128, rate: float = 0.01):
        if not len(labels) or labels.min() == labels.max():
            self.prior = float(labels.mean()) if len(labels) else 1.0
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        rng, m, v, step = np.random.default_rng(11), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), size):
                pick = order[at : at + size]
                g = self.gradients(np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick]), labels[pick])
                step += 1
                for k, d in g.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


BAG = pa.schema([("label", pa.float64()), ("n", pa.int32()), ("bag", pa.binary())])


def _bags(batches):
    for labels, texts in text_batches(batches, 1 << 20):
        x, count = passages(texts)
        out = np.split(x.astype(np.float32), np.cumsum(count)[:-1])
        yield rows(BAG, labels, count, [o.tobytes() for o in out])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Attention:
    """Fit on a bounded, hash-drawn sample of the labelled documents outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sample = stage(drawn, "labelled")
    # at most max_docs rows of 16 bytes
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    texts = own.join(F.broadcast(sample), F.col("doc") == F.col("_id")).select("label", "text")
    found = stage(texts.mapInArrow(_bags, "label double, n int, bag binary"), "bags").where(F.col("n") <= max_passages)
    order = [F.xxhash64("bag"), "label"]
    sizes = found.orderBy(*order).select("n").limit(max_docs).toPandas()["n"]  # at most max_docs numbers
    got = found.orderBy(*order).limit(int((sizes.cumsum() <= max_passages).sum())).toPandas()
    bags = [np.frombuffer(b, np.float32).reshape(n, FEATURES).astype(float) for b, n in zip(got["bag"], got["n"])]
    return Attention().fit(bags, got["label"].to_numpy(float))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(model: Attention):
    def run(batches):
        for ids, texts in text_batches(batches, 1 << 20):
            yield rows(SCORED, ids, model.score(*passages(texts)))

    return run


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(model: Attention, at: int, threshold: float):
    def run(batches):
        for rb in batches:
            texts = [b"" if t is None else t for t in rb.column(at).cast(pa.binary()).to_pylist()]
            if texts:
                yield rb.filter(pa.array(model.score(*passages(texts)) >= threshold))

    return run


def keep(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` that the classifier accepts, with all their columns."""
    return docs.mapInArrow(_keep(model, docs.columns.index("text"), threshold), docs.schema)
