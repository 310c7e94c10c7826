"""Nearest items by cosine, exact or approximate, as a join of query groups with bins of items.

Items are routed to clusters (k-means centres, sampled pivots, or hyperplane signatures). Neighbouring
clusters share a bin of bounded size, and a cluster above that size has bins of its own. A query goes
once to every bin in which it probes a cluster, and takes along which ones. A (query group, bin) pair is
one task's work: it multiplies cluster by cluster and keeps the k best per query on the way, so what it
holds is bounded by the two sizes and it gives k hits per query and bin, never the pairs. Query groups
are cut by the measured load, so no busy bin ends in a single task.

The exact search lets every query meet every bin, and passes over the clusters that can hold nothing
better than the k-th hit so far by the triangle inequality.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import vectors as V
from clickloom.session import cut

MAX_CLUSTERS = 4096  # bounds everything that is kept per cluster on the driver or in a closure
ITEMS_PER_CLUSTER = 2048
BLOCK_VALUES = 8 << 20  # numbers in the vectors of a bin at most
GROUP_VALUES = 2 << 20  # numbers in the vectors of a query group at most
GROUP_HITS = 4 << 20  # hits kept for a query group at most
LEAST_GROUP = 256  # queries below which a group is not cut for the sake of more tasks
PIECE = 1 << 20  # scores held at once
SCORE_DIGITS = 9  # scores are ranked at this precision, so equal vectors tie whatever the summation order
PLACE_BITS = 22  # low bits of a key: the place among the items of a bin; the score is above them


@dataclass
class VectorIndex:
    """Unit item vectors with their cluster, and what is known per cluster (bounded rows)."""

    rows: DataFrame  # item_id, vec array<double>, cluster_id
    kind: str  # "centres", "planes", or "tree" for a stored index
    geometry: np.ndarray  # centres (clusters x dim), plane normals (bits x dim), or the tree of a stored index
    sizes: dict[int, int]  # rows per cluster, non-empty ones only; a bound where rows were replaced
    block_items: int | None  # rows of a bin at most, by their width if not given


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64).reshape(len(series), dim)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(sq, 0.0))


def _dim(index: VectorIndex) -> int:
    return (index.geometry.leaf if index.kind == "tree" else index.geometry).shape[1]


def _unit_rows(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    kept = df.filter(F.col(vec_col).isNotNull() & ~V.is_zero(vec_col))
    return kept.select(F.col(id_col).alias(name), V.unit(vec_col).alias("vec"))


def _route(rows: DataFrame, kind: str, geometry: np.ndarray) -> DataFrame:
    dim = geometry.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(geometry)  # at most MAX_CLUSTERS x dim numbers

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            x = _stack(pdf["vec"], dim)
            if kind == "centres":
                step = max(1, PIECE // len(g))
                parts = [_distances(x[a : a + step], g).argmin(1) for a in range(0, len(x), step)]
                cluster = np.concatenate(parts) if parts else np.zeros(0)
            else:
                cluster = ((x @ g.T) > 0).astype(np.int64) @ (1 << np.arange(len(g)))
            yield pdf.assign(cluster_id=cluster.astype(np.int32))

    return rows.mapInPandas(assign, "item_id string, vec array<double>, cluster_id int")


def _finish(rows: DataFrame, kind: str, geometry: np.ndarray, block_items: int | None) -> VectorIndex:
    routed = cut(_route(rows, kind, geometry))
    known = routed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MAX_CLUSTERS rows
    return VectorIndex(routed, kind, geometry, {r.cluster_id: r.n for r in known}, block_items)


def _cluster_count(n: int, wanted: int | None) -> int:
    if wanted and wanted > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} clusters")
    return max(1, min(MAX_CLUSTERS, n, wanted or math.ceil(n / ITEMS_PER_CLUSTER)))


def pivot_index(items: DataFrame, clusters: int | None = None, block_items: int | None = None) -> VectorIndex:
    """Clusters around items drawn by hash order: cheap to build, used for the exact search."""
    rows = _unit_rows(items, "item_id", "embedding", "item_id")
    count = _cluster_count(rows.count(), clusters)
    picked = rows.orderBy(F.md5("item_id"), "item_id").limit(count).collect()  # at most MAX_CLUSTERS rows
    return _finish(rows, "centres", np.array([r.vec for r in picked], dtype=np.float64), block_items)


def kmeans_index(
    items: DataFrame, clusters: int | None = None, block_items: int | None = None, seed: int = 42, max_iter: int = 10
) -> VectorIndex:
    """Clusters by k-means: the inverted-file index for approximate search."""
    rows = _unit_rows(items, "item_id", "embedding", "item_id")
    n = rows.count()
    count = _cluster_count(n, clusters or math.ceil(math.sqrt(n)))
    model = KMeans(k=max(2, count), seed=seed, maxIter=max_iter, featuresCol="f").fit(
        rows.select(array_to_vector("vec").alias("f"))
    )
    return _finish(rows, "centres", np.array(model.clusterCenters(), dtype=np.float64), block_items)


def plane_index(items: DataFrame, bits: int = 4, block_items: int | None = None, seed: int = 42) -> VectorIndex:
    """Buckets by the signs against random hyperplanes (locality-sensitive hashing for cosine)."""
    rows = _unit_rows(items, "item_id", "embedding", "item_id")
    dim = rows.select(F.max(F.size("vec")).alias("d")).first().d
    if 1 << bits > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} buckets")
    planes = np.random.default_rng(seed).standard_normal((bits, dim))
    return _finish(rows, "planes", planes, block_items)


def _layout(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters in order, the first bin of each, and its number of bins. Clusters in a row share a bin while it has room."""
    known = np.array(sorted(index.sizes), dtype=np.int64)
    room = min(index.block_items or max(1, BLOCK_VALUES // _dim(index)), 1 << (PLACE_BITS - 2))
    first, count, at, held = [], [], 0, 0
    for c in known.tolist():
        n = index.sizes[c]
        if held and held + n > room:
            at, held = at + 1, 0
        first.append(at)
        count.append(max(1, math.ceil(n / room)))
        if n > room:
            at, held = at + count[-1], 0
        else:
            held += n
    return known, np.array(first, dtype=np.int64), np.array(count, dtype=np.int64)


def _near(x: np.ndarray, index_kind: str, geometry: np.ndarray, known: np.ndarray, n_probe: int) -> np.ndarray:
    """The first n_probe clusters of every row; what is not among `known` does not count."""
    if index_kind == "tree":
        return geometry.near(x, n_probe)
    if index_kind == "centres":
        dist = _distances(x, geometry[known])
    else:
        # Cost of a bucket: the margins of all bits in which it differs from the query.
        margin = x @ geometry.T
        have = (known[:, None] >> np.arange(len(geometry))) & 1
        differs = (margin > 0).astype(np.int64)[:, None, :] != have[None, :, :]
        dist = (np.abs(margin)[:, None, :] * differs).sum(2)
    return known[np.argsort(dist, axis=1, kind="stable")[:, :n_probe]]


def probe(queries: DataFrame, index: VectorIndex, n_probe: int | None = None) -> DataFrame:
    """(query_id, vec, bin, cells): the bins of the first clusters of a query, with the clusters probed in each.

    Without `cells` it is all of the bin's. The number of clusters is `n_probe`, or that of the query's own column `n_probe`.
    """
    kind, dim = index.kind, _dim(index)
    shared = queries.sparkSession.sparkContext.broadcast((index.geometry, *_layout(index)))  # bounded as above

    def dealt(part: pd.DataFrame, n: int) -> pd.DataFrame:
        geometry, known, first, count = shared.value
        if n >= len(known):
            bins = int((first + count).max())
            return pd.DataFrame(
                {
                    "query_id": np.repeat(part["query_id"].to_numpy(), bins),
                    "vec": np.repeat(part["vec"].to_numpy(), bins),
                    "bin": np.tile(np.arange(bins, dtype=np.int32), len(part)),
                    "cells": pd.Series([None] * (bins * len(part)), dtype=object),
                }
            )
        near = _near(_stack(part["vec"], dim), kind, geometry, known, n)
        at = np.minimum(np.searchsorted(known, near), len(known) - 1)
        q, place = np.nonzero(known[at] == near)
        at = at[q, place]
        copies = count[at]  # a cluster with several bins is met in all of them
        q, cell, start = np.repeat(q, copies), np.repeat(known[at], copies), np.repeat(np.cumsum(copies) - copies, copies)
        bin_ = np.repeat(first[at], copies) + np.arange(len(q)) - start
        order = np.lexsort((bin_, q))
        q, cell, bin_ = q[order], cell[order], bin_[order]
        heads = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(bin_) != 0)]) if len(q) else np.zeros(0, int)
        cells = np.split(cell.astype(np.int32), heads[1:]) if len(q) else []
        rows = q[heads]
        return pd.DataFrame(
            {
                "query_id": part["query_id"].to_numpy()[rows],
                "vec": part["vec"].to_numpy()[rows],
                "bin": bin_[heads].astype(np.int32),
                "cells": pd.Series(cells, dtype=object),
            }
        )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, rows in pdf.groupby("n_probe") if n_probe is None else [(n_probe, pdf)]:
                for at in range(0, len(rows), 256):
                    yield dealt(rows.iloc[at : at + 256], int(n))

    return queries.mapInPandas(route, "query_id string, vec array<double>, bin int, cells array<int>")


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(len(col), dim)


def _bars(best: np.ndarray) -> np.ndarray:
    """The inner product that a row's next hit must reach, a little below the k-th best so far."""
    return (best[:, 0] >> PLACE_BITS) * (2.0 / 10**SCORE_DIGITS) - 1.0 - 4.0 / 10**SCORE_DIGITS


def merge_best(best: np.ndarray, rows: np.ndarray, dots: np.ndarray, place: np.ndarray) -> None:
    """Take the inner products of some rows with the items at `place` into the rows' best keys.

    A key is the rounded score and, below it, the place counted from the end: larger is better, and of equal
    scores the first place. The first of a row's keys is the smallest; -1 stands for none.
    """
    k = best.shape[1]
    r, c = np.nonzero(dots >= _bars(best[rows])[:, None])
    if not len(r):
        return
    units = np.maximum(np.rint((1.0 + dots[r, c]) / 2.0 * 10.0**SCORE_DIGITS), 0.0).astype(np.int64)
    key = (units << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - place[c])
    count = np.bincount(r, minlength=len(rows))
    met = np.flatnonzero(count)
    wide = np.full((len(met), k + count.max()), -1, dtype=np.int64)
    wide[:, :k] = best[rows[met]]
    wide[(np.cumsum(count > 0) - 1)[r], k + np.arange(len(r)) - (np.cumsum(count) - count)[r]] = key
    best[rows[met]] = np.partition(wide, wide.shape[1] - k, axis=1)[:, -k:]


def hits_of(best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and score of all hits, best first in each row."""
    keys = np.sort(best, axis=1)[:, ::-1]
    row, col = np.nonzero(keys >= 0)
    key = keys[row, col]
    return row, (1 << PLACE_BITS) - 1 - (key & ((1 << PLACE_BITS) - 1)), (key >> PLACE_BITS) / 10.0**SCORE_DIGITS


def moved(best: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Keys with every place p moved to to[p], where `to` keeps the order of the places."""
    low = (1 << PLACE_BITS) - 1
    at = np.where(best < 0, 0, low - (best & low))
    return np.where(best < 0, best, (best & ~low) | (low - (to[at] if len(to) else at)))


PACKED = "query_id string, best array<struct<n:double,item_id:string>>"


def score_bins(
    probes: DataFrame, index: VectorIndex, k: int, query_group: int | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """Best k per query and bin in one row: query_id, best (minus the score, item_id).

    `probes` (query_id, vec; bin and cells as from `probe`, or all bins and clusters without them) is read twice.
    Pairs of `exclude` (query_id, item_id) don't count: a query carries those of its bin.
    """
    spark, dim = probes.sparkSession, _dim(index)
    known, first, count = _layout(index)
    bins = int((first + count).max()) if len(known) else 0
    if "bin" not in probes.columns:
        total = probes.count()
        loads = {b: total for b in range(bins)} if total else {}
        asked = probes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max(0, bins - 1)))))
    else:
        loads = {r.bin: r["count"] for r in probes.groupBy("bin").count().collect()}  # one row per bin
        asked = probes
    group = query_group or max(1, min(GROUP_VALUES // dim, GROUP_HITS // k))
    tasks = 2 * spark.sparkContext.defaultParallelism / max(1, sum(loads.values()))
    salts = {b: max(math.ceil(n / group), min(math.ceil(n / LEAST_GROUP), math.ceil(n * tasks))) for b, n in loads.items()}
    load = spark.createDataFrame(list(salts.items()), "bin int, n_salts int")
    place = spark.createDataFrame(
        [(int(c), int(f), int(n)) for c, f, n in zip(known, first, count)], "cluster_id int, first int, n_bins int"
    )  # one row per cluster
    bin_of = (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("n_bins"))).cast("int").alias("bin")
    placed = lambda *cols: index.rows.join(place, "cluster_id").select("item_id", "cluster_id", bin_of, *cols)
    left = asked.join(load, "bin").withColumn("salt", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("n_salts")).cast("int"))
    right = placed("vec").join(load, "bin").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    carried = [c for c in ("query_id", "vec", "cells") if c in left.columns]
    if exclude is not None:
        held = exclude.join(placed(), "item_id").groupBy("query_id", "bin").agg(F.collect_set("item_id").alias("without"))  # at most a bin
        left, carried = left.join(held, ["query_id", "bin"], "left"), [*carried, "without"]

    def score(q: pa.Table, x: pa.Table) -> pa.Table:
        names = q["query_id"].combine_chunks() if q.num_rows else pa.array([], pa.string())
        best = np.full((q.num_rows, k), -1, dtype=np.int64)
        ids = pa.array([], pa.string())
        if q.num_rows and x.num_rows:
            ids = x["item_id"].combine_chunks()
            by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            ids = ids.take(pa.array(by_id))
            cluster = x["cluster_id"].to_numpy()[by_id]
            by_cell = np.argsort(cluster, kind="stable")
            items, queries = _matrix(x["vec"], dim)[by_id[by_cell]], _matrix(q["vec"], dim)
            cells, start = np.unique(cluster[by_cell], return_index=True)
            ends = np.r_[start[1:], len(items)]
            wanted = None
            if "cells" in q.column_names:
                lists = q["cells"].combine_chunks()
                whole = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(q.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                cell = lists.flatten().to_numpy()
                order = np.argsort(cell, kind="stable")
                row, cell = row[order], cell[order]
                wanted = lambda c: np.r_[whole, row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]]
            out_row = out_col = np.zeros(0, np.int64)
            if "without" in q.column_names:
                own = q["without"].combine_chunks()
                out_row = np.repeat(np.arange(q.num_rows), pc.fill_null(pc.list_value_length(own), 0).to_numpy())
                col = np.empty(len(by_cell), np.int64)
                col[by_cell] = np.arange(len(by_cell))
                out_col = col[pc.index_in(own.flatten(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)]
                order = np.argsort(out_col, kind="stable")
                out_row, out_col = out_row[order], out_col[order]
            middle = np.add.reduceat(items, start, axis=0) / (ends - start)[:, None]
            spot = np.empty(q.num_rows, np.int64)
            # the clusters nearest to the group come first: the better the hits so far, the more can be passed over
            for i in np.argsort(-(middle @ queries.mean(0)), kind="stable").tolist():
                a, b = int(start[i]), int(ends[i])
                rows = np.arange(q.num_rows) if wanted is None else wanted(cells[i])
                reach = _distances(items[a:b], middle[i : i + 1]).max()
                step = max(1, PIECE // (b - a))
                o, p = np.searchsorted(out_col, [a, b])
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    away = np.maximum(_distances(queries[some], middle[i : i + 1])[:, 0] - reach, 0.0)
                    some = some[~(1.0 - away * away / 2.0 < _bars(best[some]) - 1e-8)]
                    dots = queries[some] @ items[a:b].T
                    if p > o:
                        spot[:] = -1
                        spot[some] = np.arange(len(some))
                        r = spot[out_row[o:p]]
                        dots[r[r >= 0], out_col[o:p][r >= 0] - a] = -np.inf
                    merge_best(best, some, dots, by_cell[a:b])
        row, found, value = hits_of(best)
        flat = pa.StructArray.from_arrays([pa.array(-value), ids.take(pa.array(found))], ["n", "item_id"])
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=q.num_rows))].astype(np.int32)
        return pa.table({"query_id": names, "best": pa.ListArray.from_arrays(pa.array(ends), flat)})

    keys, parts = ["bin", "salt"], max(1, min(4 * sum(salts.values()), 4096))
    # as many partitions as there is work, whatever the bytes
    left = left.select(*keys, *carried).repartition(parts, *keys)
    right = right.select(*keys, "item_id", "vec", "cluster_id").repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, PACKED)


def ranked(packed: DataFrame, k: int) -> DataFrame:
    """The best k of all bins of a query: query_id, item_id, score, rank."""
    lists = packed.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    hits = lists.select("query_id", F.posexplode("best").alias("p", "h"))
    return hits.select("query_id", F.col("h.item_id").alias("item_id"), (0.0 - F.col("h.n")).alias("score"), (F.col("p") + 1).alias("rank"))


def _only(index: VectorIndex, cells: list[int]) -> DataFrame:
    """Rows of the given cells; a few cells become a filter that the scan can use."""
    return index.rows if 2 * len(cells) > len(index.sizes) else index.prune(cells)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    queries: DataFrame,
    index: VectorIndex,
    k: int,
    *,
    id_col: str = "query_id",
    vec_col: str = "vec",
    n_probe: int | None = None,
    exact: bool = True,
    query_group: int | None = None,
) -> DataFrame:
    """Top k items per query: query_id, item_id, score = (1 + cos) / 2, rank. Zero vectors find nothing.

    The exact search meets all clusters, whatever `n_probe`. A stored index brings its own number of probes, and
    only the cells that some query probes are read.
    """
    if exact and index.kind != "centres":
        raise ValueError("the exact search is for centre indexes")
    if n_probe is None:
        n_probe = index.probes if index.kind == "tree" else 8
    rows = _unit_rows(queries, id_col, vec_col, "query_id")
    probes = cut(rows if exact else probe(rows, index, n_probe))
    if index.kind == "tree":
        met = probes.select(F.explode_outer("cells").alias("c")).distinct().collect()  # at most the cells
        cells = [r.c for r in met]
        index = dataclasses.replace(index, rows=index.rows if None in cells else _only(index, cells))
    return ranked(score_bins(probes, index, k, query_group), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, over all queries."""
    found = approximate.select("query_id", "item_id").withColumn("hit", F.lit(1))
    return exact.join(found, ["query_id", "item_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )
