"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into two segments. Two fingerprints within d bits differ by at most d // 2 bits in
the first, or by fewer than the rest in the second: so every fingerprint enumerates that small Hamming
ball of its segment, meets others in a hash table (a shuffle on the key) and whole distances are checked.
The key also carries one block of the other segment, in which the pair must agree; this keeps groups of
near copies apart. Of each pair only the side with a zero in the lowest flipped bit probes.

Null text is empty. A text without words has fingerprint zero, and links like any other. Equal
fingerprints are collapsed before the search, so copies cost one row. A document without id still gets
its fingerprint; its component is that of its fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import ASCII_LOWER, rows, tasks, text_batches
from clickloom.llm.components import components
from clickloom.session import stage

SEED = 42
BITS = np.array([[(v >> (7 - b)) & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    prints, sizes = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        w = t.translate(ASCII_LOWER).split()
        if not w:
            continue
        line = b" ".join(w)
        if len(w) <= words:
            prints.append(digest(line, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        first = np.concatenate([[0], ends[:-words] + 1]).tolist()
        last = ends[words - 1 :].tolist()
        prints += [digest(line[a:b], SEED) for a, b in zip(first, last)]
        sizes[i] = len(last)
    h = np.array(prints, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    doc = np.repeat(np.arange(len(texts)), sizes) * 256
    out = np.zeros(len(texts), np.uint64)
    for byte in range(8):
        seen = np.bincount(doc + h[:, byte], minlength=256 * len(texts)).reshape(-1, 256)
        ones = (seen @ BITS) * 2 > sizes[:, None]
        out = (out << np.uint64(8)) | np.packbits(ones, axis=1)[:, 0].astype(np.uint64)
    return out


PRINTED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _prints(words: int):
    def run(batches):
        for ids, texts in text_batches(batches, 1 << 21):
            yield rows(PRINTED, ids, fingerprints(texts, words).view(np.int64))

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def probes(fp: np.ndarray, bits: int):
    """(row, key) arrays: the table entries and the probes of every fingerprint."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    sides = ((fp >> half, fp & low, bits // 2), (fp & low, fp >> half, bits - bits // 2 - 1))
    at = np.arange(len(fp))
    for side, (own, other, radius) in enumerate(sides):
        for weight in range(radius + 1):
            blocks = bits - weight + 1
            edges = [32 * j // blocks for j in range(blocks + 1)]
            for j in range(blocks):
                width = edges[j + 1] - edges[j]
                block = (other >> np.uint64(edges[j])) & np.uint64((1 << width) - 1)
                tag = np.uint64(((side * 64 + weight) * 64 + j) << 32)
                salt = _mix(block + np.uint64(0x9E3779B97F4A7C15))
                yield at, _mix(own | tag) ^ salt
                for flips in combinations(range(32), weight) if weight else ():
                    asks = ((own >> np.uint64(flips[0])) & np.uint64(1)) == 0
                    mask = np.uint64(sum(1 << f for f in flips))
                    yield at[asks], _mix((own[asks] ^ mask) | tag) ^ salt[asks]


KEYED = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])


def _probe(bits: int):
    def run(batches):
        for rb in batches:
            fp, rep = rb.column(0).to_numpy().view(np.uint64), rb.column(1).to_numpy()
            if not len(fp):
                continue
            found = list(probes(fp, bits))
            at, key = (np.concatenate(x) for x in zip(*found))
            yield rows(KEYED, key.view(np.int64), fp[at].view(np.int64), rep[at])

    return run


def links(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of distinct values within `bits`, in one group of equal keys."""
    if len(fp) <= 2048:
        found = [np.nonzero(np.bitwise_count(fp[a : a + 256, None] ^ fp[None, :]) <= bits) for a in range(0, len(fp), 256)]
        i = np.concatenate([f[0] + 256 * k for k, f in enumerate(found)])
        j = np.concatenate([f[1] for f in found])
        return i[i < j], j[i < j]
    # a large group: look up the ball of each value in the sorted group instead of comparing all
    order = np.argsort(fp)
    ranked, left, right = fp[order], [], []
    for weight in range(1, bits + 1):
        for flips in combinations(range(64), weight):
            ask = ranked ^ np.uint64(sum(1 << f for f in flips))
            hit = np.minimum(np.searchsorted(ranked, ask), len(fp) - 1)
            ok = np.flatnonzero((ranked[hit] == ask) & (ask > ranked))
            left.append(order[ok])
            right.append(order[hit[ok]])
    return np.concatenate(left), np.concatenate(right)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a group that join its parts: fewer than n, and the same components as all of them."""
    top, out = list(range(n)), []

    def root(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        p, q = root(a), root(b)
        if p != q:
            top[p] = q
            out.append((a, b))
    return out


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _groups(bits: int):
    def verify(key, fp, rep):
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = end - begin
        u, v = [], []
        pair = begin[size == 2]
        near = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= bits]
        u.append(rep[near])
        v.append(rep[near + 1])
        for a, b in zip(begin[size > 2].tolist(), end[size > 2].tolist()):
            own, first = np.unique(fp[a:b], return_index=True)
            for x, y in spanning(*links(own, bits), len(own)):
                u.append(rep[a + first[x : x + 1]])
                v.append(rep[a + first[y : y + 1]])
        return np.concatenate(u), np.concatenate(v)

    def run(batches):
        kept = []
        for rb in batches:
            kept.append(tuple(rb.column(i).to_numpy() for i in range(3)))
            if sum(len(k[0]) for k in kept) < 200_000:
                continue
            key, fp, rep = (np.concatenate(x) for x in zip(*kept))
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            kept = [(key[whole:], fp[whole:], rep[whole:])]
            if whole:
                yield rows(EDGES, *verify(key[:whole], fp[:whole].view(np.uint64), rep[:whole]))
        if kept:
            key, fp, rep = (np.concatenate(x) for x in zip(*kept))
            if len(key):
                yield rows(EDGES, *verify(key, fp.view(np.uint64), rep))

    return run


def _linked(printed: DataFrame, bits: int) -> DataFrame:
    """(fp, part, component_id) of every fingerprint of the rows (doc_id, fp); `part` names the component.

    Fingerprints themselves are the nodes, for rows that repeat a doc_id may hold different texts.
    """
    spark = printed.sparkSession
    own = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "own")
    keyed = own.select("fp", F.col("fp").alias("rep")).mapInArrow(_probe(bits), "key long, fp long, rep long")
    n = tasks(spark, 40 * own.count(), 4_000_000)
    edges = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_groups(bits), "u long, v long")
    reached = components(edges)
    met = own.join(reached, own.fp == reached.node).select("fp", "rep", F.col("component").alias("part"))
    smallest = met.groupBy("part").agg(F.min("rep").alias("component_id"))
    alone = own.join(reached, own.fp == reached.node, "left_anti").select("fp", F.col("fp").alias("part"), F.col("rep").alias("component_id"))
    return met.join(smallest, "part").select("fp", "part", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (smallest linked doc_id)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    printed = stage(source.mapInArrow(_prints(words), "doc_id long, fp long"), "simhash")
    return printed.join(_linked(printed, bits), "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """Rows of `docs` without the near copies: of each component one row stays, one with the smallest doc_id.

    Every row is judged by its own text, also where rows share a doc_id or have none; a row without id
    stays only if its component has no row with an id.
    """
    names = docs.columns
    own = stage(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("r"), F.monotonically_increasing_id().alias("row")), "rows")
    text = own.select("row", "r.text").mapInArrow(_prints(words), "row long, fp long")
    printed = stage(text.join(own.select("row", F.col("r.doc_id").cast("long").alias("doc_id")), "row"), "prints")
    placed = printed.join(_linked(printed.select("doc_id", "fp"), bits), "fp").select("part", "doc_id", "row")
    # the first row of each component, by partial aggregation: no group is brought together
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = placed.groupBy("part").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = stage(placed.select("row").join(first, "row", "left_anti"), "gone")
    return own.join(gone, "row", "left_anti").select(*[F.col(f"r.`{n}`") for n in names])
