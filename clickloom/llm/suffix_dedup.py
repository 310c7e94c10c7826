"""Removal of repeated 100-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes when a 100-byte string over it also starts earlier (smaller doc_id, or the same document
and an earlier start). Matches never cross documents and are judged on the input.

1. Every 100-byte window designates one anchor, the leftmost smallest hash of its 32-byte strings, so
   equal windows have anchors at equal places. Anchor hashes are exchanged Golomb-coded; an anchor that
   nothing else shares has no repeated window, and its suffix needn't be sorted.
2. The suffixes at the other anchors (100 bytes on, then up to 68 bytes back) are sorted in each batch,
   cut at sampled splitters, and sent to owners as front-coded runs.
3. Owners merge the runs with a loser tree that carries common-prefix lengths and compares only bytes
   beyond them. Equal suffixes keep their earliest member; of suffixes with one anchor string the
   common parts are compared, and what reaches 100 bytes is cut from the later one.

Splitters are whole suffixes, so a frequent anchor string falls to several owners. Groups that a splitter
cuts, or with very many different contexts, are resolved by a distributed grouping of their windows. Null text is empty; rows of one doc_id are ordered as they were read; a null doc_id
counts as smaller than all others.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import golomb
from clickloom.llm.common import rows, tasks, text_batches
from clickloom.session import stage

SPAN = 100
GRAM = 32
BACK = SPAN - GRAM
KEY = SPAN + 1 + BACK + 1
BATCH_BYTES = 2 << 20
PIECE_BYTES = 1 << 18  # of text whose anchors are found at once
LARGE_GROUP = 16384
NO_ID = -(1 << 63)
_M = np.uint64(0x9E3779B97F4A7C15)
_B = 0x100000001B3


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_B, n - 1 - k, 1 << 64) for k in range(n)], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def gram_hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place."""
    out, p = np.zeros(len(at), np.uint64), _powers(GRAM)
    for k in range(GRAM):
        out += (buf[at + k].astype(np.uint64) + np.uint64(1)) * _M * p[k]
    return _finish(out)


def _anchors(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Anchor places of one piece of less than 8 MB; `ends` are the ends of its documents."""
    if len(buf) < SPAN:
        return np.zeros(0, np.int64)
    h, n = (buf.astype(np.uint64) + np.uint64(1)) * _M, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_B, n, 1 << 64)) + h[n:]
        n *= 2
    # the place in the low bits makes the leftmost of equal hashes the smallest
    h = (_finish(h) & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
    n, width = 1, SPAN - GRAM + 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    h = np.minimum(h[: len(h) - (width - n)], h[width - n :])
    inside = np.ones(len(h), bool)
    for e in ends[:-1].tolist():  # windows over the end of a document
        inside[max(0, e - SPAN + 1) : e] = False
    at = (h & np.uint64((1 << 23) - 1)).astype(np.int64)[inside]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def anchors(texts: list[bytes]) -> np.ndarray:
    """Anchor places in the joined texts, found piece by piece; neighbouring pieces share 99 bytes."""
    buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    out = [np.zeros(0, np.int64)]
    for a in range(0, max(1, len(buf) - SPAN + 1), PIECE_BYTES - SPAN + 1):
        piece = buf[a : a + PIECE_BYTES]
        inner = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(piece))]
        out.append(_anchors(piece, np.append(inner - a, len(piece))) + a)
    return np.unique(np.concatenate(out))


PACKED = pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("blob", pa.binary()), ("size", pa.int64())])
PACKED_DDL = "part long, owner int, blob binary, size long"


def pack(ids: list, texts: list[bytes], at: np.ndarray) -> bytes:
    """A batch of documents and its anchors in one compressed value."""
    doc = np.array([NO_ID if i is None else i for i in ids], np.int64)
    none = np.array([i is None for i in ids], np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    gaps = np.diff(at, prepend=0).astype(np.uint32)
    head = struct.pack("<II", len(ids), len(at))
    return zstandard.compress(head + doc.tobytes() + none.tobytes() + size.tobytes() + gaps.tobytes() + b"".join(texts), 3)


def unpack(blob: bytes):
    raw = zstandard.decompress(blob)
    n, k = struct.unpack_from("<II", raw)
    doc = np.frombuffer(raw, np.int64, n, 8)
    none = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
    size = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    at = np.cumsum(np.frombuffer(raw, np.uint32, k, 8 + 17 * n).astype(np.int64))
    return doc, none, size, at, np.frombuffer(raw, np.uint8, -1, 8 + 17 * n + 4 * k)


def _send(owners: int):
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for ids, texts in text_batches(batches, BATCH_BYTES):
            at = anchors(texts)
            h = np.unique(gram_hash(np.frombuffer(b"".join(texts), np.uint8), at))
            sent = golomb.runs(h, owners) if len(h) else []
            yield rows(PACKED, [part] * (1 + len(sent)), [-1] + [o for o, _, _ in sent],
                       [pack(ids, texts, at)] + [golomb.encode(h[a:b]) for _, a, b in sent],
                       [sum(map(len, texts))] + [0] * len(sent))
            part += 1

    return run


def _suspects(blob: bytes, marks: pd.DataFrame):
    """Anchors of a batch whose hash lies in another batch too, or twice in this one."""
    doc, none, size, at, buf = unpack(blob)
    h = gram_hash(buf, at)
    own, back, n = np.unique(h, return_inverse=True, return_counts=True)
    met = n > 1
    start = dict((o, (a, b)) for o, a, b in golomb.runs(own, int(marks["n"].iloc[0]))) if len(marks) else {}
    for o, bits in zip(marks["owner"], marks["bitmap"]):
        a, b = start[o]
        met[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return doc, size, at[met[back]], buf


def keys(size: np.ndarray, at: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length suffix keys: 100 bytes on, their number, 68 bytes back (nearest first), their number."""
    ends = np.cumsum(size)
    row = np.searchsorted(ends, at, "right")
    pos = at - (ends[row] - size[row])
    ahead, back = np.minimum(size[row] - pos, SPAN), np.minimum(pos, BACK)
    out = np.zeros((len(at), KEY), np.uint8)
    for k in range(SPAN):
        use = ahead > k
        out[use, k] = buf[at[use] + k]
    for k in range(BACK):
        use = back > k
        out[use, SPAN + 1 + k] = buf[at[use] - 1 - k]
    out[:, SPAN], out[:, -1] = ahead, back
    return out, row, pos


def front_code(run: list[bytes]) -> bytes:
    """Sorted keys as common-prefix lengths and remainders, compressed."""
    a = np.frombuffer(b"".join(run), np.uint8).reshape(-1, KEY)
    lcp = np.zeros(len(a), np.uint8)
    differ = a[1:] != a[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), KEY)
    rest = a[np.arange(KEY) >= lcp[:, None]]
    return zstandard.compress(struct.pack("<I", len(a)) + lcp.tobytes() + rest.tobytes(), 1)


def front_decode(blob: bytes):
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    key, at = b"", 4 + n
    for lcp in raw[4 : 4 + n]:
        key = key[:lcp] + raw[at : at + KEY - lcp]
        at += KEY - lcp
        yield lcp, key


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge(runs: list):
    """Loser tree over sorted runs of (lcp with the run's previous, key, payload).

    Yields (lcp with the last yielded key, key, payload). Every entry in the tree knows its common prefix
    with the last winner; the longer prefix is smaller, and only a tie is compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k  # with the last winner
    tree = [-1] * k
    top = b"\xff" * (KEY + 1)
    key = [h[1] if h else top for h in heads]

    def play(x: int, y: int) -> tuple[int, int]:
        lx, ly = lcp[x], lcp[y]
        if lx != ly:
            return (x, y) if lx > ly else (y, x)
        a, b = key[x], key[y]
        n = common(a, b, lx)
        if a[n:] <= b[n:]:
            lcp[y] = n
            return x, y
        lcp[x] = n
        return y, x

    # build: winners go up, losers stay
    level = list(range(k))
    base = k // 2
    while base >= 1:
        up = []
        for i in range(base):
            w, lose = play(level[2 * i], level[2 * i + 1])
            tree[base + i] = lose
            up.append(w)
        level, base = up, base // 2
    win = level[0]
    last = 0
    while heads[win] is not None:
        yield last, key[win], heads[win][2]
        nxt = next(runs[win], None)
        heads[win] = nxt
        if nxt is None:
            key[win], lcp[win] = top, 0
        else:
            key[win], lcp[win] = nxt[1], nxt[0]
        node = (win + k) // 2
        while node >= 1:
            win, tree[node] = play(win, tree[node])
            node //= 2
        last = lcp[win]


RUN = pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("blob", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])
RUN_DDL = "part long, owner int, blob binary, doc binary, place binary"


def local(doc, size, at, buf):
    """Sorted distinct suffixes of the anchors `at`, the earliest place of each, and the places that repeat one."""
    key, row, pos = keys(size, at, buf)
    flat = key.tobytes()
    key = [flat[i : i + KEY] for i in range(0, len(flat), KEY)]
    early = np.lexsort((pos, row, doc[row])).tolist()
    order = sorted(early, key=key.__getitem__)  # stable: of equal suffixes the earliest comes first
    again = [i for i, j in zip(order[1:], order) if key[i] == key[j]]
    drop = set(again)
    first = [i for i in order if i not in drop]
    return [key[i] for i in first], first, row, pos, [(int(row[i]), int(pos[i]), key[i]) for i in again]


def _sorted_runs(splitters: list[bytes]):
    """Sorted, front-coded runs of one batch, one per owner. What repeats in the batch is sent once."""

    def run(batch: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(marks):
            return pd.DataFrame({c: [] for c in RUN.names})
        part = int(batch["part"].iloc[0])
        doc, size, at, buf = _suspects(batch["blob"].iloc[0], marks)
        if not len(at):
            return pd.DataFrame({c: [] for c in RUN.names})
        key, first, row, pos, _ = local(doc, size, at, buf)
        edge = [0, *(bisect.bisect_left(key, s) for s in splitters), len(key)]
        out = []
        for owner, (a, b) in enumerate(zip(edge, edge[1:])):
            if a < b:
                pick = first[a:b]
                place = np.stack([row[pick], pos[pick]]).astype(np.uint32)
                out.append((part, owner, front_code(key[a:b]), doc[row[pick]].tobytes(), place.tobytes()))
        return pd.DataFrame(out, columns=RUN.names)

    return run


CUT = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("key", pa.binary()), ("doc", pa.int64()), ("pos", pa.int64())])
CUT_DDL = "part long, row long, begin long, end long, key binary, doc long, pos long"


def shared_parts(group: list[tuple[bytes, tuple]]) -> list[tuple[tuple, int, int]]:
    """(place, bytes back, bytes on) of what later members of one anchor string share with earlier ones.

    All shared strings of a member hold its anchor, so together they are one interval.
    """
    group.sort(key=lambda g: g[1])
    a = np.frombuffer(b"".join(k for k, _ in group), np.uint8).reshape(-1, KEY)
    ahead, behind = a[:, SPAN].astype(int), a[:, -1].astype(int)
    reach = np.zeros((2, len(group)), int)
    if len(group) <= 48:
        for j in range(1, len(group)):
            differ = a[:j] != a[j]
            on, back = differ[:, :SPAN], differ[:, SPAN + 1 : SPAN + 1 + BACK]
            on = np.where(on.any(1), on.argmax(1), SPAN)
            back = np.where(back.any(1), back.argmax(1), BACK)
            on = np.minimum(on, np.minimum(ahead[:j], ahead[j]))
            back = np.minimum(back, np.minimum(behind[:j], behind[j]))
            ok = on + back >= SPAN
            if ok.any():
                reach[:, j] = back[ok].max(), on[ok].max()
    else:
        for r in range(BACK + 1):
            own = np.flatnonzero((behind >= r) & (ahead >= SPAN - r))
            near = a[own, SPAN + 1 : SPAN + 1 + r][:, ::-1]
            window = np.ascontiguousarray(np.concatenate([near, a[own, : SPAN - r]], axis=1))
            seen: dict[bytes, int] = {}
            flat = window.tobytes()
            for k, i in enumerate(own.tolist()):
                if seen.setdefault(flat[k * SPAN : (k + 1) * SPAN], i) != i:
                    reach[:, i] = max(reach[0, i], r), max(reach[1, i], SPAN - r)
    return [(group[j][1], int(reach[0, j]), int(reach[1, j])) for j in np.flatnonzero(reach.sum(0)).tolist()]


def windows(key: bytes):
    """(bytes back, window) of every window of a key that holds its anchor."""
    on, back = key[:SPAN][: key[SPAN]], key[SPAN + 1 :][: key[-1]][::-1]
    for r in range(max(0, SPAN - len(on)), len(back) + 1):
        yield r, back[len(back) - r :] + on[: SPAN - r]


def _runs(pdf: pd.DataFrame):
    def entries(part, blob, doc, place):
        d = np.frombuffer(doc, np.int64).tolist()
        row, pos = np.frombuffer(place, np.uint32).reshape(2, -1).tolist()
        for (lcp, key), a, r, p in zip(front_decode(blob), d, row, pos):
            yield lcp, key, (a, part, r, p)

    return [entries(*x) for x in pdf[["part", "blob", "doc", "place"]].itertuples(index=False)]


def _merge(pdf: pd.DataFrame, split: set[bytes]):
    """Merge the runs of one owner: cuts, and the members of groups that one task can't resolve."""
    out, group = [], []

    def cut(place, back, on):
        out.append((place[1], place[2], place[3] - back, place[3] + on, None, None, None))

    def close():
        if len(group) > 1:
            for place, back, on in shared_parts(group):
                cut(place, back, on)
        group.clear()

    large = False
    for lcp, key, place in merge(_runs(pdf)):
        if lcp < GRAM:
            if not large:
                close()
            elif group:
                out.extend((p[1], p[2], None, None, k, p[0], p[3]) for k, p in group)
                group.clear()
            large = key[:GRAM] in split
        if lcp == KEY:
            # an equal suffix: the later of the two places loses all that its key holds
            first = group[-1][1]
            late = max(first, place)
            group[-1] = (key, min(first, place))
            if key[SPAN] + key[-1] >= SPAN:
                cut(late, key[-1], key[SPAN])
        else:
            group.append((key, place))
            if len(group) > (1 if large else LARGE_GROUP):
                large = True
                # the last member may still meet an equal one
                out.extend((p[1], p[2], None, None, k, p[0], p[3]) for k, p in group[:-1])
                del group[:-1]
        if len(out) > 50_000:
            yield rows(CUT, *zip(*out))
            out.clear()
    if large:
        out.extend((p[1], p[2], None, None, k, p[0], p[3]) for k, p in group)
    else:
        close()
    if out:
        yield rows(CUT, *zip(*out))


def _owner_merge(split: set[bytes]):
    def run(runs: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_merge(runs.to_pandas(), split)), schema=CUT)

    return run


WINDOW = pa.schema([
    ("window", pa.binary()), ("doc", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("begin", pa.int64()), ("cuts", pa.binary()),
])
WINDOW_DDL = "window binary, doc long, part long, row long, begin long, cuts binary"


class _Later:
    """Cuts of one task, packed by batch of documents."""

    def __init__(self):
        self.by_part: dict[int, list[int]] = {}

    def add(self, place: tuple):
        self.by_part.setdefault(place[1], []).extend((place[2], place[3], place[3] + SPAN))

    def rows(self):
        parts = list(self.by_part)
        packed = [np.array(self.by_part[p], np.int64).tobytes() for p in parts]
        self.by_part.clear()
        n = [None] * len(parts)
        return rows(WINDOW, n, n, parts, n, n, packed)


def _windows(batches):
    """The earliest place of every window in the task; later places are cut at once."""
    first: dict[bytes, tuple] = {}
    later = _Later()

    def flush():
        some = list(first.items())
        first.clear()
        for a in range(0, len(some), 10_000):
            b = some[a : a + 10_000]
            yield rows(WINDOW, [w for w, _ in b], *zip(*(p for _, p in b)), [None] * len(b))
        if later.by_part:
            yield later.rows()

    for rb in batches:
        for key, doc, part, row, pos in zip(*(rb.column(c).to_pylist() for c in ("key", "doc", "part", "row", "pos"))):
            for r, w in windows(key):
                place = (doc, part, row, pos - r)
                was = first.setdefault(w, place)
                # two anchors of a window give it twice in one place
                if was != place:
                    first[w] = min(was, place)
                    later.add(max(was, place))
        if len(first) > 200_000:
            yield from flush()
    yield from flush()


def _first_windows(batches):
    """Windows in sorted order: all places but the first of each are cut."""
    last, first, later, n = None, None, _Later(), 0
    for rb in batches:
        for w, *place in zip(*(rb.column(c).to_pylist() for c in ("window", "doc", "part", "row", "begin"))):
            if w != last:
                last, first = w, place
            elif place != first:
                later.add(tuple(place))
                n += 1
        if n > 200_000:
            yield later.rows()
            n = 0
    if later.by_part:
        yield later.rows()


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(text: bool):
    def run(batch: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({c.split()[0]: [] for c in (KEPT + ", kept binary" if text else KEPT).split(", ")})
        doc, none, size, at, buf = unpack(batch["blob"].iloc[0])
        first = np.cumsum(size) - size
        edge = np.zeros(len(buf) + 1, np.int32)
        # what repeats within the batch was not sent: the later places lose all that their key holds
        h = gram_hash(buf, at)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        for r, p, key in local(doc, size, at[n[back] > 1], buf)[-1]:
            if key[SPAN] + key[-1] >= SPAN:
                edge[first[r] + p - key[-1]] += 1
                edge[first[r] + p + key[SPAN]] -= 1
        some = [cuts.loc[cuts["cuts"].isna(), ["row", "begin", "end"]].to_numpy(np.int64)]
        some += [np.frombuffer(c, np.int64).reshape(-1, 3) for c in cuts["cuts"].dropna()]
        r, begin, end = np.concatenate(some).T
        np.add.at(edge, first[r] + begin, 1)
        np.add.at(edge, first[r] + end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for d, no, n, a in zip(doc.tolist(), none.tolist(), size.tolist(), first.tolist()):
            g = gone[a : a + n]
            kept = buf[a : a + n][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0])
            out.append((None if no else d, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if text else [])))
        pdf = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])])
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    return run


def _sample(batches):
    """A few suffixes of every batch, for the splitters."""
    for rb in batches:
        for part, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            _, _, size, at, buf = unpack(blob)
            key, _, _ = keys(size, at[:: max(1, len(at) // 64)][:64], buf)
            n = len(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([k.tobytes() for k in key], pa.binary())],
                names=["part", "n", "key"],
            )


def remove_repeats(docs: DataFrame, text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with `text` the kept bytes)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = tasks(spark, size, 32 << 20)
    packed = stage(source.mapInArrow(_send(owners), PACKED_DDL), "batches")
    whole = packed.where("owner = -1").select("part", "blob")
    marks = golomb.bitmaps(packed.where("owner >= 0")).withColumn("n", F.lit(owners))
    # splitters: at most 40 suffixes of 170 bytes for each owner
    drawn = whole.mapInArrow(_sample, "part long, n int, key binary").orderBy(F.xxhash64("part", "n"), "part", "n")
    drawn = sorted(bytes(r.key) for r in drawn.limit(40 * owners).select("key").collect())
    splitters = [drawn[len(drawn) * k // owners] for k in range(1, owners)] if drawn else []
    # an anchor string that several splitters fall into is frequent and is split; others stay whole
    often = Counter(k[:GRAM] for k in splitters)
    split = {g for g, n in often.items() if n > 1}
    splitters = sorted({k if k[:GRAM] in split else k[:GRAM] for k in splitters})
    runs = whole.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(_sorted_runs(splitters), RUN_DDL)
    found = stage(runs.groupBy("owner").applyInArrow(_owner_merge(split), CUT_DDL), "cuts")
    spread = stage(found.where("key is not null").mapInArrow(_windows, WINDOW_DDL), "windows")
    met = spread.where("cuts is null").repartition(owners, "window").sortWithinPartitions("window", "doc", "part", "row", "begin")
    packed_cuts = met.mapInArrow(_first_windows, WINDOW_DDL).unionByName(spread.where("cuts is not null"))
    cuts = found.where("key is null").select("part", "row", "begin", "end", F.lit(None).cast("binary").alias("cuts"))
    none = [F.lit(None).cast("long").alias(c) for c in ("row", "begin", "end")]
    cuts = cuts.unionByName(packed_cuts.select("part", *none, "cuts"))
    return whole.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(_apply(text), KEPT + (", kept binary" if text else ""))
