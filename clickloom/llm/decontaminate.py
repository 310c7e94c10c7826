"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Documents and benchmark items that share a run of three words, the shortest tile, meet; then the longest
matching runs that do not overlap are marked again and again, so passages are found in any order. A
document is contaminated when tiles of three words or more cover 0.8 of an item's words. Words are
lower-cased (A-Z) and split at white space and ASCII punctuation. An item of fewer than three words is
found as a whole; an item without words matches nothing. Null texts are empty.

The words of an item that lie in runs shared with the document bound its coverage from above. Items are
tiled from the highest bound down, and only where the bound can still reach the threshold or the best
coverage so far, which changes no result.

The benchmark is the stated query set: it is sent to the tasks in blocks of bounded size and every block
meets all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import string
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes

TILE_WORDS = 3
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20  # of benchmark text that a task holds at once

_WORDS = bytearray(range(256))
for _c in string.ascii_uppercase:
    _WORDS[ord(_c)] = ord(_c.lower())
for _c in string.punctuation:
    _WORDS[ord(_c)] = 32
_WORDS = bytes(_WORDS)
_BASE = 0x9E3779B97F4A7C15


def words(text: bytes) -> np.ndarray:
    """64-bit ids of the words of a text."""
    w = text.translate(_WORDS).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + ids[k : k + len(out)]
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Non-overlapping (item position, document position, length), longest first."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    found, size = [], max(least, min(20, len(item)))
    while True:
        matches = _matches(item, doc, free_i, free_d, size)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * size:
            size = longest
            continue
        marked = False
        for i, j, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            # what an earlier tile has cut is searched again in the next round
            if free_i[i : i + n].all() and free_d[j : j + n].all():
                free_i[i : i + n] = free_d[j : j + n] = False
                found.append((i, j, n))
                marked = True
        if marked:
            continue
        if size == least:
            return found
        size = max(least, size // 2)


def _matches(item, doc, free_i, free_d, size):
    """Maximal runs of at least `size` equal unmarked words."""
    gi, gd = grams(item, size), grams(doc, size)
    if not len(gi) or not len(gd):
        return []
    open_i = np.flatnonzero(np.convolve(free_i, np.ones(size, int), "valid") == size)
    open_d = np.flatnonzero(np.convolve(free_d, np.ones(size, int), "valid") == size)
    order = open_i[np.argsort(gi[open_i], kind="stable")]
    ranked = gi[order]
    left = np.searchsorted(ranked, gd[open_d], "left")
    right = np.searchsorted(ranked, gd[open_d], "right")
    n = right - left
    j = np.repeat(open_d, n)
    i = order[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
    inner = (i > 0) & (j > 0)
    inner[inner] = (item[i[inner] - 1] == doc[j[inner] - 1]) & free_i[i[inner] - 1] & free_d[j[inner] - 1]
    out = []
    for a, b in zip(i[~inner].tolist(), j[~inner].tolist()):
        if not np.array_equal(item[a : a + size], doc[b : b + size]):
            continue
        k = size
        while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and free_i[a + k] and free_d[b + k]:
            k += 1
        out.append((a, b, k))
    return out


class Items:
    """One block of benchmark items: their words and a table of their runs of TILE_WORDS words."""

    def __init__(self, block: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in block]
        self.words = [words(t) for _, t in block]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.item_of = np.repeat(np.arange(len(block)), self.size)
        start = np.cumsum(self.size) - self.size
        self.tables = {}
        for n in {min(TILE_WORDS, len(w)) for w in self.words if len(w)}:
            own = [(grams(w, n), start[k]) for k, w in enumerate(self.words) if min(TILE_WORDS, len(w)) == n]
            seed = np.concatenate([g for g, _ in own])
            place = np.concatenate([at + np.arange(len(g)) for g, at in own])
            order = np.argsort(seed, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[seed >> np.uint64(44)] = True
            self.tables[n] = (seed[order], place[order], maybe)

    def candidates(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that share a run with the document, and the share of their words in such runs."""
        under = [np.zeros(0, np.int64)]
        for n, (seed, place, maybe) in self.tables.items():
            g = grams(doc, n)
            g = np.unique(g[maybe[g >> np.uint64(44)]])
            left, right = np.searchsorted(seed, g, "left"), np.searchsorted(seed, g, "right")
            count = right - left
            at = place[np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())]
            under += [at + k for k in range(n)]
        found, n = np.unique(self.item_of[np.unique(np.concatenate(under))], return_counts=True)
        return found, n / self.size[found]

    def covered(self, text: bytes, least: float, above: float = np.inf) -> list[tuple[int, float]]:
        """(item id, share of its words under tiles), in order of the items: all that reach `least` and,
        if it is more than `above`, the first with the largest share."""
        doc, out, top = words(text), {}, -1
        found, bound = self.candidates(doc)
        runs = grams(doc, TILE_WORDS)
        for x in np.lexsort((found, -bound)):
            k, most = int(found[x]), bound[x]
            if most < least and (most < above or most == above and (top < 0 or k > top)):
                if most < above:
                    break
                continue
            item = self.words[k]
            share = 1.0  # of a short item the whole was found
            if len(item) >= TILE_WORDS:
                # only words of runs that the item has can lie under a tile; one gap stands for all others in a row
                near = np.isin(runs, grams(item, TILE_WORDS))
                use = np.zeros(len(doc), bool)
                for s in range(TILE_WORDS):
                    use[s : s + len(near)] |= near
                gap = np.where(use, doc, np.uint64(0))[use | np.concatenate([[False], use[:-1]])]
                share = sum(n for _, _, n in tiles(item, gap)) / len(item)
            if share >= least or share > above or share == above and 0 <= k < top:
                out[k] = share
            if share > above or share == above and 0 <= k < top:
                above, top = share, k
        return [(self.ids[k], c) for k, c in sorted(out.items())]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The benchmark in blocks of at most `limit` bytes; a single longer item is a block of its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    block, size = [], 0
    for r in items.toLocalIterator():
        t = r.text.encode()
        if block and size + len(t) > limit:
            yield Items(block)
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield Items(block)


FOUND = "doc_id long, text string, item_id long, coverage double, n_items int"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_items", pa.int32())])


def _score(items: Items, coverage: float, last: bool):
    def run(batches):
        for rb in batches:
            best, share, n = (rb.column(k).to_pylist() for k in (2, 3, 4))
            for k, text in enumerate(as_bytes(rb.column(1))):
                for item, c in items.covered(text, coverage, share[k]):
                    n[k] += c >= coverage
                    if c > share[k]:
                        best[k], share[k] = item, c
            text = pa.nulls(rb.num_rows, pa.string()) if last else rb.column(1)
            cols = [rb.column(0), text, pa.array(best, pa.int64()), pa.array(share, pa.float64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, schema=FOUND_ARROW)

    return run


def score(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Per row of `docs`: doc_id, item_id (best covered, null if none), coverage, n_items, contaminated."""
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("item_id"),
        F.lit(0.0).alias("coverage"), F.lit(0).alias("n_items"),
    )
    all_blocks = list(blocks(benchmark))
    for k, items in enumerate(all_blocks):
        out = out.mapInArrow(_score(items, coverage, k == len(all_blocks) - 1), FOUND)
    return out.select("doc_id", "item_id", "coverage", "n_items", (F.col("n_items") > 0).alias("contaminated"))


def _clean(items: Items, coverage: float, at: int):
    def run(batches):
        for rb in batches:
            keep = [not items.covered(t, coverage) for t in as_bytes(rb.column(at))]
            yield rb.filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of `docs` that cover no benchmark item, with all their columns."""
    out = docs
    for items in blocks(benchmark):
        out = out.mapInArrow(_clean(items, coverage, docs.columns.index("text")), docs.schema)
    return out
