"""Hard negatives by angular triangle filtering.

Every row keeps its length and its angles to a few reference directions. For an anchor and a row the
angles to one reference differ by at most, and add up to at least, the angle between the two; so all
references together give an interval of the cosine, and with the lengths an interval of the score. Only
rows whose interval overlaps what an anchor still looks for are scored, in integers.

Components are floor(256 x), and a score is the integer inner product. A row's positives are the first
`positives` other rows of its label; for each of them the negatives are the first `negatives` rows of
another label whose score lies between 80 % and 100 % of the positive's. Higher scores come first, ties by
smaller vec_id, null first.

1. References are fitted on at most `SAMPLE` rows. Rows are dealt by nearest reference and by the angle
   to it, equal angles by a hash, so that neighbouring rows have narrow windows of angles and copies spread.
2. Anchors are taken in blocks of at most about `ANCHORS` against all rows. A first pass finds the
   positives: the sample gives each anchor a first bar, and a chunk of rows whose windows lie too far is
   passed over at once. A second pass does the same for the windows of the negatives.

Every interval is widened by more than its rounding, so the filter loses nothing. Rows with a null label,
a null vector, or a null or non-finite component take no part. Shorter vectors count as filled with zeros;
zero vectors score 0. Rows that repeat a vec_id are rows of their own. Components must stay below 2^24 in
size after scaling, so that scores fit 64-bit integers; larger ones are refused. Further columns are not
read; an empty table has no result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import rows, tasks, tuned
from clickloom.session import stage

REFERENCES = 16
SAMPLE = 4096  # rows that references are fitted on
ANCHORS = 8192
CHUNK = 2048  # rows filtered together
SLICE = 512  # anchors filtered together
PAIRS = 1 << 15  # pairs scored together
WIDEN = 4e-6  # radians: single-precision angles, twice
NO_ID = -(1 << 63)
LEAST = np.int64(-(1 << 62))

ROW = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.int64()), ("row", pa.int64()), ("cell", pa.int32()), ("near", pa.float32()),
    ("norm", pa.float64()), ("angles", pa.binary()), ("parts", pa.binary()),
])
ROW_DDL = "vec_id long, label long, row long, cell int, near float, norm double, angles binary, parts binary"


@dataclass
class Rows:
    """Rows of one chunk, or anchors of one block."""

    id: np.ndarray
    label: np.ndarray
    row: np.ndarray
    norm: np.ndarray
    angle: np.ndarray  # rows x references
    part: np.ndarray  # rows x dimensions, integers

    def take(self, at) -> Rows:
        return Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def unpack(table: pa.Table) -> Rows:
    column = {n: table.column(n) for n in ("vec_id", "label", "row", "norm", "angles", "parts")}
    n = table.num_rows
    wide = {c: np.frombuffer(b"".join(column[c].to_pylist()), k).reshape(n, -1 if n else 1) for c, k in (("angles", "<f4"), ("parts", "<i4"))}
    return Rows(
        column["vec_id"].fill_null(NO_ID).to_numpy(), column["label"].to_numpy(), column["row"].to_numpy(),
        column["norm"].to_numpy(), wide["angles"], wide["parts"].astype(np.int64),
    )


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component, rows filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    if len(x) and np.abs(x).max() >= 1 << 24:
        raise ValueError("a component is too large for integer scores")
    out = np.zeros((len(size), width), np.int64)
    at = np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - at] = x
    return out


def fit_references(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit directions that lie near the rows: k-means on the sphere from evenly drawn rows."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centre = unit[np.unique(np.linspace(0, len(unit) - 1, count).astype(int))]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centre)
    return centre


def angles(part: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each row, its angles to the references; 0 for zero vectors)."""
    norm = np.sqrt((part * part).sum(1).astype(float))
    cosine = part @ reference.T / np.where(norm > 0, norm, np.inf)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0).astype(np.float32)


def _store(reference: np.ndarray, width: int):
    def run(batches):
        for rb in batches:
            part = integers(rb.column(3), width)
            norm, angle = angles(part, reference)
            cell = angle.argmin(1)
            yield rows(ROW, rb.column(0), rb.column(1), rb.column(2), cell, angle[np.arange(len(cell)), cell], norm,
                       [a.tobytes() for a in angle], [p.tobytes() for p in part.astype("<i4")])

    return run


def bounds(a: Rows, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every pair (anchor, row)."""
    apart = np.zeros((len(a.id), len(x.id)), np.float32)
    along = np.full_like(apart, np.pi)
    for r in range(a.angle.shape[1]):
        s, t = a.angle[:, r : r + 1], x.angle[:, r]
        np.maximum(apart, np.abs(s - t), out=apart)
        both = s + t
        np.minimum(along, np.minimum(both, np.float32(2 * np.pi) - both), out=along)
    size = a.norm[:, None] * x.norm
    slack = size * 1e-9 + 1e-6
    high = size * np.cos(np.maximum(apart.astype(float) - WIDEN, 0)) + slack
    low = size * np.cos(np.minimum(along.astype(float) + WIDEN, np.pi)) - slack
    return low, high


def reach(a: Rows, x: Rows) -> np.ndarray:
    """Greatest possible score of each anchor with any row of the chunk, from the chunk's windows of angles."""
    some = x.angle[x.norm > 0]
    if not len(some):
        return np.zeros(len(a.id))
    gap = np.maximum(np.maximum(a.angle - some.max(0), some.min(0) - a.angle), 0).max(1) if len(a.id) else np.zeros(0)
    size = a.norm * x.norm.max()
    cosine = np.cos(np.maximum(gap.astype(float) - WIDEN, 0))
    return np.maximum(size * cosine, 0) + size * 1e-9 + 1e-6


def scores(a: Rows, x: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for k in range(0, len(i), PAIRS):
        some = slice(k, k + PAIRS)
        out[some] = np.einsum("ij,ij->i", a.part[i[some]], x.part[j[some]])
    return out


class Lists:
    """The best rows found so far, `size` for each key: score, vec_id, row."""

    def __init__(self, keys: int, size: int, bar: np.ndarray | None = None):
        self.score = np.full((keys, size), LEAST)
        self.id = np.zeros((keys, size), np.int64)
        self.row = np.zeros((keys, size), np.int64)
        self.first = np.full(keys, LEAST) if bar is None else bar

    @property
    def bar(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.first)

    def add(self, key: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray):
        own = np.unique(key)
        held = self.score[own] > LEAST
        key = np.concatenate([key, np.repeat(own, held.sum(1))])
        score, id, row = (np.concatenate([n, getattr(self, f)[own][held]]) for f, n in (("score", score), ("id", id), ("row", row)))
        order = np.lexsort((row, id, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        order, key, place = (v[place < self.score.shape[1]] for v in (order, key, place))
        for f, v in (("score", score), ("id", id), ("row", row)):
            getattr(self, f)[key, place] = v[order]

    def found(self):
        """(key, score, id, row) of all entries."""
        key, place = np.nonzero(self.score > LEAST)
        return key, self.score[key, place], self.id[key, place], self.row[key, place]


def chunks(batches, size: int = CHUNK):
    some, n = [], 0
    for rb in batches:
        some.append(rb)
        n += rb.num_rows
        while n >= size:
            table = pa.Table.from_batches(some).combine_chunks()
            yield unpack(table.slice(0, size))
            some, n = table.slice(size).combine_chunks().to_batches(), n - size
    if n:
        yield unpack(pa.Table.from_batches(some).combine_chunks())


def near(a: Rows, x: Rows, lists: Lists) -> None:
    """Bring each anchor's list of rows with its label up to date."""
    use = np.flatnonzero(np.isin(a.label, x.label) & (reach(a, x) >= lists.bar))
    for label in np.unique(a.label[use]).tolist():
        own = use[a.label[use] == label]
        rest = x.take(x.label == label)
        for k in range(0, len(own), SLICE):
            at = own[k : k + SLICE]
            some = a.take(at)
            _, high = bounds(some, rest)
            i, j = np.nonzero((high >= lists.bar[at, None]) & (some.row[:, None] != rest.row))
            s = scores(some, rest, i, j)
            ok = s >= lists.bar[at[i]]
            lists.add(at[i[ok]], s[ok], rest.id[j[ok]], rest.row[j[ok]])


def hard(a: Rows, x: Rows, wanted: np.ndarray, lists: Lists) -> None:
    """Bring the lists of (anchor, positive) up to date. wanted: anchors x positives, the positives' scores, or -1."""
    n = wanted.shape[1]
    bar = lists.bar.reshape(-1, n)
    # 80 p <= 100 s, from the list's bar on
    bar = np.where(wanted < 0, -LEAST, np.maximum(bar, -(-80 * wanted // 100)))
    use = np.flatnonzero(reach(a, x) >= bar.min(1))
    for k in range(0, len(use), SLICE):
        at = use[k : k + SLICE]
        some = a.take(at)
        low, high = bounds(some, x)
        look = np.zeros(low.shape, bool)
        for p in range(n):
            look |= (high >= bar[at, p, None]) & (low <= wanted[at, p, None])
        i, j = np.nonzero(look & (some.label[:, None] != x.label))
        s = scores(some, x, i, j)
        for p in range(n):
            ok = (s >= bar[at[i], p]) & (s <= wanted[at[i], p])
            lists.add(at[i[ok]] * n + p, s[ok], x.id[j[ok]], x.row[j[ok]])


FOUND = pa.schema([("key", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])
FOUND_DDL = "key long, score long, vec_id long, row long"


def _pass(step, keys: int, size: int, bar: np.ndarray | None = None):
    def run(batches):
        lists = Lists(keys, size, bar)
        for x in chunks(batches):
            step(x, lists)
        key, score, id, row = lists.found()
        yield rows(FOUND, key, score, pa.array(id, pa.int64(), mask=id == NO_ID), row)

    return run


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _block(stored: DataFrame, a: Rows, sample: Rows, positives: int, negatives: int) -> DataFrame:
    spark = stored.sparkSession
    start = Lists(len(a.id), positives)
    for k in range(0, len(sample.id), CHUNK):
        near(a, sample.take(slice(k, k + CHUNK)), start)
    first = _first(stored.mapInArrow(_pass(lambda x, lists: near(a, x, lists), len(a.id), positives, start.bar), FOUND_DDL), positives)
    wanted = np.full((len(a.id), positives), -1, np.int64)  # a negative score has no window
    found = [(r.key, r.rank, r.vec_id, r.score) for r in first.collect()]  # at most ANCHORS x positives rows
    for key, rank, _, score in found:
        wanted[key, rank - 1] = score if score >= 0 else -1
    hits = _first(
        stored.mapInArrow(_pass(lambda x, lists: hard(a, x, wanted, lists), wanted.size, negatives), FOUND_DDL), negatives
    )
    named = [(k * positives + r - 1, None if a.id[k] == NO_ID else int(a.id[k]), i, s) for k, r, i, s in found]
    names = spark.createDataFrame(named, "key long, anchor_id long, positive_id long, positive_score long")
    return hits.join(names, "key").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """Hard negatives of the rows (vec_id, embedding, label) whose vec_id is divisible by `every`."""
    spark = tuned(vectors.sparkSession)
    finite = "embedding is not null and label is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kept = vectors.where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.monotonically_increasing_id().alias("row"), "embedding",
    )
    width = max(1, kept.agg(F.max(F.size("embedding"))).first()[0] or 0)
    drawn = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("embedding").toArrow()
    reference = fit_references(integers(drawn.column(0).combine_chunks(), width).astype(float), REFERENCES)
    dealt = kept.mapInArrow(_store(reference, width), ROW_DDL).repartitionByRange(tasks(spark), "cell", "near", F.xxhash64("row"))
    stored = stage(dealt.sortWithinPartitions("cell", "near"), "angles")
    sample = unpack(stored.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toArrow())
    asked = stored.where(F.col("vec_id") % every == 0)
    n = max(1, math.ceil(asked.count() / ANCHORS))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for k in range(n):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).toArrow()  # about ANCHORS rows
        if block.num_rows:
            out = out.unionByName(_block(stored, unpack(block), sample, positives, negatives))
    return out
