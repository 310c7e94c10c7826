"""Golomb-Rice coded exchange of sorted fingerprints.

Every partition sends the sorted distinct fingerprints that fall to an owner as one compressed row;
the owner answers with one bitmap that marks those another partition has sent too.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 1 << 15


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values. Quotients are unary, remainders k bits, in two streams per block."""
    out, last = [struct.pack("<I", len(values))], 0
    for at in range(0, len(values), BLOCK):
        v = values[at : at + BLOCK]
        gaps = np.diff(v, prepend=np.uint64(last))
        last = int(v[-1])
        mean = (last - int(v[0])) / len(v) + 1
        k = max(0, int(np.log2(mean * 0.69)))
        # a first gap far above the mean would cost a long unary run
        while (int(gaps.max()) >> k) > 64 * len(v):
            k += 1
        q = (gaps >> np.uint64(k)).astype(np.int64)
        unary = np.zeros(int(q.sum()) + len(v), np.uint8)
        unary[np.cumsum(q + 1) - 1] = 1
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        u, r = np.packbits(unary).tobytes(), np.packbits(rest).tobytes()
        out.append(struct.pack("<IBII", len(v), k, len(u), len(r)) + u + r)
    return b"".join(out)


def decode(blob: bytes) -> np.ndarray:
    total = struct.unpack_from("<I", blob)[0]
    at, parts, last = 4, [np.zeros(0, np.uint64)], np.uint64(0)
    while total:
        n, k, nu, nr = struct.unpack_from("<IBII", blob, at)
        at += 13
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, nu, at)))[:n]
        q = np.diff(ones, prepend=-1) - 1
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, nr, at + nu))[: n * k].reshape(n, k)
        rest = np.zeros(n, np.uint64)
        for j in range(k):
            rest = (rest << np.uint64(1)) | bits[:, j].astype(np.uint64)
        v = last + np.cumsum((q.astype(np.uint64) << np.uint64(k)) | rest, dtype=np.uint64)
        parts.append(v)
        last, at, total = v[-1], at + nu + nr, total - n
    return np.concatenate(parts)


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of the fingerprints, so a sorted array falls apart into sorted runs."""
    return (((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def runs(values: np.ndarray, owners: int):
    """(owner, first, end) of the sorted values that each owner gets."""
    owner = owner_of(values, owners)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(values)))]


def _answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    sent = [decode(b) for b in pdf["blob"]]
    both = np.concatenate(sent)
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    met = np.zeros(len(both), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    cuts = np.cumsum([len(s) for s in sent])[:-1]
    maps = [np.packbits(m).tobytes() for m in np.split(met, cuts)]
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bitmap": maps})


def bitmaps(sent: DataFrame) -> DataFrame:
    """(part, owner, blob) to (part, owner, bitmap): which fingerprints came from two partitions or more."""
    return (
        sent.select("part", "owner", "blob").groupBy("owner")
        .applyInPandas(_answer, "part long, owner int, bitmap binary")
    )
