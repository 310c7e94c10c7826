"""Ranked lexical search: impact vectors in buckets of falling length, pruned by Cauchy-Schwarz.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z is lower-cased.
With w = floor(1000 ln((2N + 2) / (2 df + 1))) and the impact (10^9 tf) div (1000 tf + 8 m), where
m = 25 + (75 n N) div L, a document's score is the sum of w times impact over an item's terms, repeats
included. Written as an inner product, an item has sqrt(w) times its count of a term, a document sqrt(w)
times the impact.

1. One pass over the texts leaves, per document, its length and its counts of the items' terms.
2. Document vectors are dealt by falling length; equal lengths are dealt by a hash, so copies spread.
   Within a task they form buckets of neighbouring lengths.
3. The longest vectors are searched first; the lowest score of each item's list there is a bar for all.
   An item skips a bucket when its length times the bucket's longest vector stays below its bar.
4. Inside a bucket an item's heaviest coordinates are summed exactly, and Cauchy-Schwarz bounds the rest of
   each vector by what is left of both lengths. Survivors get their exact score in 64-bit integers.

Bounds are rounded up, so nothing that could enter a list is lost. Items are read in blocks of
`BLOCK_BYTES` of text; every block meets all documents. Null and empty texts have no terms: such
documents are in no list and in neither N nor L, and such items have no list. Every row of items has a
list of its own, and every row of documents a place of its own, also when rows repeat. Equal scores go by
ascending doc_id, null first. Further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import rows, tasks, text_batches
from clickloom.session import stage

TOP = 10
BLOCK_BYTES = 16 << 20  # of item texts searched together
BUCKET = 4096  # documents of neighbouring length
FOCUS = 8  # coordinates summed before the bound
LEAD = 1 / 64  # share of the longest vectors that set the first bars
SAFE = 1 + 1e-9  # rounding of the bounds
NO_ID = -(1 << 63)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Vocabulary(dict):
    def __missing__(self, term: bytes) -> int:
        return -1


VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
VECTOR_DDL = "doc_id long, n long, terms binary, counts binary"


def _count(vocabulary: dict[bytes, int]):
    """Length of every document, and its counts of the vocabulary's terms."""

    def run(batches):
        number, size = _Vocabulary(vocabulary).__getitem__, len(vocabulary)
        for ids, texts in text_batches(batches, 4 << 20):
            split = [np.fromiter(map(number, terms(t)), np.int64) for t in texts]
            n = [len(s) for s in split]
            key = np.concatenate(split)
            key = (np.repeat(np.arange(len(n)), n) * size + key)[key >= 0]
            key, times = np.unique(key, return_counts=True)
            edge = np.searchsorted(key, np.arange(len(n) + 1) * size).tolist()
            term, times = (key % max(size, 1)).astype("<i4"), times.astype("<i4")
            cut = [(a, b) for a, b in zip(edge, edge[1:])]
            yield rows(VECTOR, ids, n, [term[a:b].tobytes() for a, b in cut], [times[a:b].tobytes() for a, b in cut])

    return run


def _flat(column: pa.Array, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each row has) of a column of packed arrays."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def _frequencies(size: int):
    """Documents that hold each term: one row per term and task."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for rb in batches:
            total += np.bincount(_flat(rb.column(0))[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["term", "df"])

    return run


IMPACT = pa.schema([("doc_id", pa.int64()), ("norm", pa.float64()), ("terms", pa.binary()), ("impacts", pa.binary())])
IMPACT_DDL = "doc_id long, norm double, terms binary, impacts binary"


def _impacts(documents: int, length: int, weight: np.ndarray):
    def run(batches):
        for rb in batches:
            term, size = _flat(rb.column(2))
            tf = _flat(rb.column(3))[0].astype(np.int64)
            m = np.array([25 + 75 * n * documents // length for n in rb.column(1).to_pylist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
            square = np.append(0.0, np.cumsum(weight[term] * impact.astype(float) ** 2))
            edge = np.append(0, np.cumsum(size))
            # the running sum rounds by less than this
            norm = np.sqrt(np.maximum(square[edge[1:]] - square[edge[:-1]], 0) + square[-1] * 1e-13)
            raw, at = impact.astype("<i4"), edge.tolist()
            yield rows(IMPACT, rb.column(0), norm, rb.column(2), [raw[a:b].tobytes() for a, b in zip(at, at[1:])])

    return run


@dataclass
class Query:
    """Terms of one item, heaviest coordinate first."""

    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        heavy = np.argsort(-self.times * np.sqrt(self.weight), kind="stable")
        self.term, self.times, self.weight = self.term[heavy], self.times[heavy], self.weight[heavy]
        self.coordinate = self.times * np.sqrt(self.weight)
        self.norm = float(np.sqrt((self.coordinate**2).sum()))
        self.rest = float(np.sqrt((self.coordinate[FOCUS:] ** 2).sum()))
        self.gain = self.times * self.weight


def _best(score: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, -score))[:top]
    return score[order], doc[order]


HIT = pa.schema([("q", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())])
HIT_DDL = "q int, score long, doc_id long"


def search_bucket(doc, norm, term, size, impact, queries: list[Query], best: list, bar: np.ndarray, top: int) -> int:
    """Bring the lists `best` and the bars up to date with one bucket; the number of scored documents."""
    order = np.argsort(term, kind="stable")
    term, impact = term[order], impact[order].astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), size)[order]
    longest, scored = float(norm.max()), 0
    for q in np.flatnonzero(np.array([x.norm for x in queries]) * longest * SAFE >= bar).tolist():
        query = queries[q]
        begin, end = np.searchsorted(term, query.term), np.searchsorted(term, query.term, "right")
        part, used = np.zeros(len(doc)), np.zeros(len(doc))
        for k in range(min(FOCUS, len(begin))):
            own = slice(begin[k], end[k])
            x = math.sqrt(query.weight[k]) * impact[own]
            part[owner[own]] += query.coordinate[k] * x
            used[owner[own]] += x * x
        bound = part + query.rest * np.sqrt(np.maximum(norm * norm - used, 0) + norm * norm * 1e-12)
        near = bound * SAFE >= bar[q]
        if not near.any():
            continue
        score = np.zeros(len(doc), np.int64)
        for gain, a, b in zip(query.gain.tolist(), begin.tolist(), end.tolist()):
            score[owner[a:b]] += gain * impact[a:b]
        scored += int(near.sum())
        near &= score >= bar[q]
        if near.any():
            best[q] = _best(np.append(best[q][0], score[near]), np.append(best[q][1], doc[near]), top)
            if len(best[q][0]) == top:
                bar[q] = max(bar[q], best[q][0][-1])
    return scored


def _search(queries: list[Query], bars: np.ndarray, top: int):
    """The best documents of one task for every item; buckets come by falling length."""

    def buckets(batches):
        some, n = [], 0
        for rb in batches:
            some.append(rb)
            n += rb.num_rows
            if n >= BUCKET:
                yield some
                some, n = [], 0
        if n:
            yield some

    def run(batches):
        bar = bars.copy()
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)
        for some in buckets(batches):
            table = pa.Table.from_batches(some).combine_chunks()
            doc = table.column(0).fill_null(NO_ID).to_numpy()
            term, size = _flat(table.column(2))
            search_bucket(doc, table.column(1).to_numpy(), term, size, _flat(table.column(3))[0], queries, best, bar, top)
        for a in range(0, len(queries), 1024):
            part = best[a : a + 1024]
            doc = np.concatenate([d for _, d in part])
            yield rows(HIT, np.repeat(np.arange(a, a + len(part)), [len(s) for s, _ in part]), np.concatenate([s for s, _ in part]),
                       pa.array(doc, pa.int64(), mask=doc == NO_ID))

    return run


def _block(documents: DataFrame, items: list, top: int) -> DataFrame:
    spark = documents.sparkSession
    found = [np.unique(terms(r.text.encode()), return_counts=True) for r in items]
    vocabulary = {bytes(t): k for k, t in enumerate(sorted({bytes(t) for own, _ in found for t in own}))}
    vectors = stage(documents.mapInArrow(_count(vocabulary), VECTOR_DDL), "counts")
    counted = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    frequent = vectors.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long")
    weight = np.zeros(len(vocabulary), np.int64)  # a term that no document has adds nothing
    for r in frequent.groupBy("term").agg(F.sum("df").alias("df")).collect():  # as many rows as the block has terms
        weight[r.term] = math.floor(1000 * math.log((2 * counted.docs + 2) / (2 * r.df + 1)))
    queries = [
        Query(np.array([vocabulary[bytes(t)] for t in own], np.int64), times.astype(np.int64), weight[[vocabulary[bytes(t)] for t in own]])
        for own, times in found
    ]
    made = vectors.where("octet_length(terms) > 0").mapInArrow(_impacts(counted.docs, counted.length or 1, weight), IMPACT_DDL)
    impacts = stage(made.where("norm > 0"), "impacts")
    cut = impacts.approxQuantile("norm", [1 - LEAD], 0.002)

    def best(some: DataFrame, bars: np.ndarray) -> DataFrame:
        n = tasks(spark)
        dealt = some.repartitionByRange(n, F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))
        hits = dealt.mapInArrow(_search(queries, bars, top), HIT_DDL)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    bars = np.ones(len(queries), np.int64)  # scores above 0
    if cut:
        lead = best(impacts.where(F.col("norm") >= cut[0]), bars)
        for r in lead.where(F.col("rank") == top).collect():  # a row per item of the block
            bars[r.q] = r.score
    # below this length no vector reaches any bar
    least = min((b / x.norm for b, x in zip(bars.tolist(), queries) if x.norm > 0), default=0.0) / SAFE**2
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(items)], "q int, item_id long")
    hits = best(impacts.where(F.col("norm") >= least), bars)
    return hits.join(names, "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """For every row of `items` (item_id, text) its `top` documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(n):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about BLOCK_BYTES
        if block:
            out = out.unionByName(_block(documents, block, top))
    return out
