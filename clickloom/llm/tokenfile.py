"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Token ids of all documents lie in ascending doc_id order in files of blocks. Code lengths come from the
corpus counts of the ids (package-merge, at most MAX_BITS bits); every block can be decoded alone, and
holds the bit offset of every STEP-th id, so that its parts are decoded side by side by table look-up.

A file is a Parquet file, one row per block: the bytes of the block, its documents and their lengths. It
is written by Spark, so it lies wherever Spark can write. Null texts are empty; every document ends with
END_ID. Rows without doc_id come first; rows of one doc_id follow each other in no fixed order.

Tokenising is the tokenizers library's: distinct strings between ASCII white space are encoded once per
worker, letters-only parts by the library's merge model, everything unusual by the whole pipeline.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import rows, tasks
from clickloom.session import new_path, stage

END_ID = 2
MAX_BITS = 18
BLOCK_IDS = 1 << 16
STEP = 256
CACHED = 500_000

# Safe text: letters whose lower case and composition are fixed, single digits, ASCII punctuation except
# what starts a contraction or a special token.
_UNSAFE = re.compile(r"[^a-zA-Z0-9À-ÖØ-öø-ÿ!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, by way of their distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the letters that stand for the bytes of characters up to U+00FF
        self.letters = {chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        self.alphabet = str.maketrans(self.letters)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            line = part if part.isascii() else part.translate(self.alphabet)
            got = np.array([t.id for t in self.tokenizer.model.tokenize(line)], "<u4").tobytes()
            if len(self.parts) >= CACHED:
                self.parts.clear()
            self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        if _UNSAFE.search(word):
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            got = b"".join([self._part(p) for p in _PARTS.findall(word.lower())])
        if len(self.words) >= CACHED:
            self.words.clear()
        self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with the end id."""
        known, new = self.words, self._word
        words = text.split() if text.isascii() and not _CONTROL.search(text) else _SPACE.split(text)
        out = []
        for w in words:
            got = known.get(w)
            out.append(new(w) if got is None else got)
        out.append(b"\x02\0\0\0")
        return b"".join(out)


_CONTROL = re.compile(r"[\x1c-\x1f]")  # white space to str.split only
_SPACE = re.compile(r"[\x20\x09-\x0d]+")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("sums", pa.list_(pa.int64()))])
TOKENS_DDL = "doc_id long, n long, ids binary, sums array<long>"


def _tokenise(path: str):
    def run(batches):
        model, total = load(path), np.zeros(1 << 16, np.int64)
        for rb in batches:
            ids = [np.frombuffer(model.encode(t or ""), "<u4") for t in rb.column(1).to_pylist()]
            if not ids:
                continue
            seen = np.bincount(np.concatenate(ids))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
            narrow = "<u2" if len(total) <= 1 << 16 else "<u4"
            yield rows(TOKENS, rb.column(0).to_pylist(), [len(i) for i in ids],
                       [narrow[2].encode() + i.astype(narrow).tobytes() for i in ids], [None] * len(ids))
        used = np.flatnonzero(total)
        if len(used):
            yield rows(TOKENS, [None], [-1], [None], [np.stack([used, total[used]], 1).ravel()])

    return run


# -- code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most `limit` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    level, kinds = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


class Code:
    """Canonical code: ids with their code lengths are all that has to be known."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(ids) else 1
        # codes of one length are consecutive; each starts where the shorter ones end
        step = np.left_shift(1, self.bits - self.lengths)
        self.first = np.cumsum(step) - step
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = (self.first >> (self.bits - self.lengths)).astype(np.uint64)
        self.length_of[self.ids] = self.lengths
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_length = np.ones(1 << self.bits, np.uint8)
        end = int(step.sum())
        self.table_id[:end] = np.repeat(self.ids, step)
        self.table_length[:end] = np.repeat(self.lengths, step)

    def encode(self, ids: np.ndarray) -> bytes:
        """Header, bit offset of every STEP-th id, bits."""
        size = self.length_of[ids]
        end = np.cumsum(size)
        start = end - size
        total = int(end[-1]) if len(ids) else 0
        word = self.code_of[ids] << (np.uint64(32) - size.astype(np.uint64) - (start & 7).astype(np.uint64))
        out = np.zeros((total + 7) // 8 + 4, np.int64)
        for k in range(4):  # bits never overlap, so sums are unions
            piece = (word >> np.uint64(24 - 8 * k)) & np.uint64(255)
            got = np.bincount((start >> 3) + k, weights=piece.astype(np.float64))
            out[: len(got)] += got.astype(np.int64)
        marks = start[::STEP].astype(np.uint64)
        return struct.pack("<II", len(ids), len(marks)) + marks.tobytes() + out.astype(np.uint8).tobytes()

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """Ids of blocks. Parts between checkpoints of all blocks go forward side by side."""
        bits, at, left, sizes, base = [], [], [], [], 0
        for b in blocks:
            n, k = struct.unpack_from("<II", b)
            body = np.frombuffer(b, np.uint8, -1, 8 + 8 * k)
            at.append(np.frombuffer(b, np.uint64, k, 8).astype(np.int64) + 8 * base)
            left.append(np.minimum(STEP, n - STEP * np.arange(k)))
            bits.append(body)
            sizes.append(n)
            base += len(body)
        raw = np.concatenate([*bits, np.zeros(4, np.uint8)]).astype(np.uint32)
        wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, left = np.concatenate(at), np.concatenate(left)
        out = np.zeros((len(at), STEP), np.uint32)
        live = np.arange(len(at))
        for k in range(STEP):
            live = live[left[live] > k]
            if not len(live):
                break
            pos = at[live]
            look = (wide[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[live, k] = self.table_id[look]
            at[live] = pos + self.table_length[look]
        flat = out[np.arange(STEP) < left[:, None]]
        return np.split(flat, np.cumsum(sizes)[:-1])


# -- files

BLOCK = pa.schema([
    ("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("body", pa.binary()),
])
BLOCK_DDL = "file int, block int, before long, n long, doc_ids array<long>, sizes array<long>, body binary"


def _blocks(code: Code):
    def run(batches):
        file, block, before = TaskContext.get().partitionId(), 0, 0
        docs, parts, size = [], [], 0

        def close():
            nonlocal block, before, docs, parts, size
            body = code.encode(np.concatenate(parts))
            out = rows(BLOCK, [file], [block], [before], [size], [docs], [[len(p) for p in parts]], [body])
            block, before = block + 1, before + size
            docs, parts, size = [], [], 0
            return out

        for rb in batches:
            for d, raw in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u" + raw[:1].decode(), -1, 1).astype(np.int64)
                docs.append(d)
                parts.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write(docs: DataFrame, model: str | None = None) -> tuple[str, Code]:
    """Write the files of `docs`; returns their folder and the code they are read with."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(source.mapInArrow(_tokenise(model or default_model()), TOKENS_DDL), "tokens")
    # at most one row per id of the vocabulary
    sums = (
        found.where("n = -1")
        .select(F.explode(F.expr("transform(sequence(0, cast(size(sums) / 2 as int) - 1), i -> struct(sums[2 * i] as id, sums[2 * i + 1] as c))")).alias("s"))
        .groupBy("s.id").agg(F.sum("s.c").alias("c")).toPandas()
    )
    ids, counts = sums["id"].to_numpy(np.int64), sums["c"].to_numpy(np.int64)
    limit = max(MAX_BITS, int(np.ceil(np.log2(max(2, len(ids))))) + 1)
    code = Code(ids, code_lengths(counts, limit)) if len(ids) else Code(np.array([END_ID]), np.ones(1, np.int64))
    path = new_path(spark, "tokenfile")
    total = int(counts.sum())
    kept = found.where("n >= 0").select("doc_id", "ids")
    ranged = kept.repartitionByRange(tasks(spark, total, 16_000_000), F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.mapInArrow(_blocks(code), BLOCK_DDL).write.option("compression", "uncompressed").parquet(path)
    return path, code


READ = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _decode(code: Code, ids: bool):
    def part(table: list[dict]):
        out = []
        for b, flat in zip(table, code.decode([b["body"] for b in table])):
            at = 0
            for d, n in zip(b["doc_ids"], b["sizes"]):
                own = flat[at : at + n]
                out.append((b["file"], d, b["before"] + at, n, zlib.crc32(own.astype("<u4").tobytes()), own.astype(np.int32) if ids else None))
                at += n
        return rows(READ, *zip(*out))

    def run(batches):
        some, size = [], 0
        for rb in batches:
            for b in rb.to_pylist():
                some.append(b)
                size += b["n"]
                if size >= 8 * BLOCK_IDS:
                    yield part(some)
                    some, size = [], 0
        if some:
            yield part(some)

    return run


def read(docs_path: str, code: Code, spark, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the files."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(docs_path)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    # one row per file
    base = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    found = blocks.mapInArrow(_decode(code, ids), "file int, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    out = found.join(base, "file").withColumn("start", F.col("start") + F.col("base")).drop("file", "base")
    return out if ids else out.drop("ids")
