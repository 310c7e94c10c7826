"""Byte-level BPE encoding and decoding by merge replay over all words of a batch.

The distinct words of a batch are laid out in one row of byte tokens. An inverted index leads from every
pair of neighbouring tokens that some merge joins to the places where it stands, in all words at once.
The merges are applied in rank order: each reads its places from the index, joins them, and only the
two neighbours of a joined place get new entries. What a worker has encoded it keeps, so a frequent word
is replayed once. Nothing is shuffled; the batch is the corpus of a replay, as any text is encoded alike.

Replaying in rank order gives the ids of the greedy rule (always the smallest rank in the word, the
leftmost first) if every token comes out of its own bytes by ascending merges. Then no merge can make a
pair of a smaller rank: the tokens of such a pair would fill the span of its token, and that span had
been joined at that smaller rank already. Rank files are tested for this before a job begins, and
refused otherwise (once, on the driver).

Texts are cut by `pattern` first, and each match is encoded on its own; a match that is a token as it
stands gets that id. Null texts are empty, an empty text has no ids. There are no special tokens. Rows
are handled one by one, so repeated rows, ties and null ids need no rule; further columns stay as they
are, except `ids` (by `encode`) and `decoded` (by `decode`), which are replaced. Decoding gives the exact bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20  # of text whose new words are replayed together
REPLAY_BYTES = 4 << 20  # of distinct words in one layout; a longer word stays whole
CACHED_CHUNKS = 400_000
CACHED_CHARS = 16 << 20
_BLANK = re.compile(r"[^\S \n]")  # white space other than spaces and line ends
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Index(dict):
    """Numbers of words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Ranks:
    """Merge tables of one rank file, and the words replayed so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing or max(self.ranks.values()) >= 1 << 31:
            raise ValueError(f"no ranks for the bytes {missing[:5]}" if missing else "ranks need 31 bits")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        joins = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    joins[left << 32 | right] = rank
        joins[(1 << 63) - 1] = -1
        self.keys = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.keys.tolist()], np.int64)
        self.cut = pattern == default_pattern()
        self._spell()
        self._forget()

    def _spell(self):
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        self.size, self.at = size, np.cumsum(size) - size
        self.spelling = np.zeros(int(size.sum()), np.uint8)
        for token, rank in self.ranks.items():
            self.spelling[self.at[rank] : self.at[rank] + len(token)] = np.frombuffer(token, np.uint8)

    def test(self):
        """Refuse ranks that are not in the order of merges."""
        tokens = list(self.ranks)
        ids, count = self.replay(tokens, ordered=True)
        if (count != 1).any() or ids.tolist() != [self.ranks[t] for t in tokens]:
            raise ValueError("these ranks are not in the order of merges")

    def pair(self, key: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, left << 32 | right; -1 where there is none, or at the end of a word (-1)."""
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], -1)

    def replay(self, words: list[bytes], ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each). `ordered` demands that no merge makes a pair of smaller rank."""
        size = np.array([len(w) for w in words], np.int64)
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(words)), size)  # one free slot behind each word
        token = np.full(len(place) + len(words) + 1, -1, np.int64)
        token[place] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        want = self.pair(token << 32 | np.append(token[1:], -1))
        # the index: places of the first pairs, sorted by rank, and places entered later
        due = np.flatnonzero(want >= 0)
        due = due[np.argsort(want[due], kind="stable")]
        cut = np.flatnonzero(np.diff(want[due], prepend=-1))
        ranks = want[due[cut]].tolist()
        first = dict(zip(ranks, zip(cut.tolist(), np.append(cut[1:], len(due)).tolist())))
        later: dict[int, list[int]] = {r: [] for r in ranks}
        while ranks:
            rank = heapq.heappop(ranks)
            a, b = first.get(rank, (0, 0))
            entered = later.pop(rank)
            at = np.concatenate([due[a:b], entered]).astype(np.int64) if entered else due[a:b]
            at = at[want[at] == rank]  # the others were touched by earlier merges
            if not len(at):
                continue
            at.sort()
            # in a chain of overlapping pairs the first, third, ... are joined
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(np.append(False, chained), 0, k))) % 2 == 0]
            gone = after[at]
            behind, ahead = after[gone], before[at]
            token[at], token[gone], want[gone] = rank, -1, -1
            after[at], before[behind] = behind, at
            left = token[ahead]
            if chained.any():  # what was joined just now stands in `at`
                left, ahead = left[left != rank], ahead[left != rank]
            touched = np.concatenate([ahead, at])
            new = self.pair(np.concatenate([left << 32 | rank, rank << 32 | token[behind]]))
            want[touched] = new
            for r, p in zip(new.tolist(), touched.tolist()):
                if r in later:
                    later[r].append(p)
                elif r >= 0:
                    if ordered and r <= rank:
                        raise ValueError("these ranks are not in the order of merges")
                    later[r] = [p]
                    heapq.heappush(ranks, r)
        left = token[place]
        count = np.bincount(np.repeat(np.arange(len(words)), size)[left >= 0], minlength=len(words))
        return left[left >= 0].astype(np.int32), count

    def _forget(self):
        self.index, self.known, self.held = _Index(), 0, 0
        self.ids, self.first, self.count, self.uses = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first id of each word, number of ids of each)."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        rest = np.flatnonzero(whole < 0)
        count, first, ids = np.ones(len(words), np.int64), np.zeros(len(words), np.int64), [whole[whole >= 0]]
        base = len(ids[0])
        first[whole >= 0] = np.arange(base)
        group = np.cumsum([0] + [len(words[i]) for i in rest])[:-1] // REPLAY_BYTES
        for part in np.split(rest, np.flatnonzero(np.diff(group)) + 1):
            some, n = self.replay([words[i] for i in part.tolist()])
            ids.append(some)
            count[part], first[part] = n, base + np.cumsum(n) - n
            base += len(some)
        return np.concatenate(ids), first, count

    def _learn(self):
        """Ids of the chunks that are new in the index."""
        chunks = [c[1:] if c[0] == " " else " " + c for c in list(self.index)[self.known :]]
        words = _Index()
        number, find = words.__getitem__, self.pattern.findall
        found = [list(map(number, find(c))) for c in chunks]
        if not found:
            return
        edge = np.cumsum([0] + [len(f) for f in found])
        seen = np.fromiter(chain.from_iterable(found), np.int32, int(edge[-1]))
        ids, first, count = self._words([w.encode() for w in words])
        size = np.diff(np.append(0, np.cumsum(count[seen]))[edge])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, size])
        self.ids = np.concatenate([self.ids, gather(ids, first[seen], count[seen])])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])
        self.known, self.held = len(self.index), self.held + sum(map(len, chunks))

    def _trim(self):
        """Forget the less used half of the chunks."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.known // 2])
        chunks, ids = list(self.index), gather(self.ids, self.first[keep], self.count[keep])
        count, uses = self.count[keep], self.uses[keep] // 2
        self._forget()
        for i in keep.tolist():
            self.held += len(chunks[i])
            self.index[chunks[i]]
        self.ids, self.count, self.first, self.uses, self.known = ids, count, np.cumsum(count) - count, uses, len(keep)

    def chunks(self, text: str) -> list[str]:
        """The text cut at single spaces between other characters, as keys of the index.

        No match of the shipped pattern reaches over such a space, which begins the next match. Keys
        stand for " " + key, except those that begin with a space: these stand for what follows it.
        """
        if not self.cut:
            return [" " + text]
        if _BLANK.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            cut = _CUT.split(text)
        else:
            cut = text.split(" ")
        cut[0] = " " + cut[0]
        return cut

    def encode(self, columns: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column of texts: (all ids, offsets of the texts)."""
        split, number = [], self.index.__getitem__
        for column in columns:
            found = [list(map(number, self.chunks(t))) if t else [] for t in column.to_pylist()]
            edge = np.cumsum([0] + [len(f) for f in found])
            split.append((np.fromiter(chain.from_iterable(found), np.int32, int(edge[-1])), edge))
        self._learn()
        out = []
        for chunk, edge in split:
            self.uses += np.bincount(chunk, minlength=self.known)
            size = np.append(0, np.cumsum(self.count[chunk]))
            out.append((gather(self.ids, self.first[chunk], self.count[chunk]), size[edge]))
        if self.known > CACHED_CHUNKS or self.held > CACHED_CHARS:
            self._trim()
        return out

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, offsets of the texts) of the ids between the offsets."""
        size = self.size[ids]
        return gather(self.spelling, self.at[ids], size), np.append(0, np.cumsum(size))[edge]


def gather(source: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of the stretches of `source` that begin at `first`."""
    end = np.cumsum(count)
    return source[np.repeat(first - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)]


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Ranks:
    """One set of tables per worker process."""
    return Ranks(path, pattern)


@functools.lru_cache(maxsize=2)
def _tested(path: str, pattern: str) -> None:
    Ranks(path, pattern).test()


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    at = edge * data.itemsize
    if len(data) * data.itemsize >= 1 << 31:
        return pa.array([data[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.large_binary())
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _with(rb: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rb.columns, column], names=[*rb.schema.names, name])


def _encode(path: str, pattern: str, at: int, packed: bool):
    def flush(model: Ranks, some: list[pa.RecordBatch]):
        for rb, (ids, edge) in zip(some, model.encode([rb.column(at) for rb in some])):
            if packed:
                column = _binary(ids.astype("<u4"), edge)
            else:
                column = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids, pa.int32()))
            yield _with(rb, "ids", column)

    def run(batches):
        model, some, size = load(path, pattern), [], 0
        for rb in batches:
            some.append(rb)
            size += rb.column(at).nbytes
            if size >= BATCH_BYTES:
                yield from flush(model, some)
                some, size = [], 0
        yield from flush(model, some)

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """`docs` with a further column `ids`: array<int>, or with `packed` little-endian unsigned 32-bit integers in a binary value."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    _tested(path, pattern)
    docs = docs.drop("ids")
    kind = "binary" if packed else "array<int>"
    schema = docs.select("*", F.lit(None).cast(kind).alias("ids")).schema
    run = _encode(path, pattern, docs.columns.index("text"), packed)
    return docs.mapInArrow(run, schema)


def _decode(path: str, pattern: str, at: int):
    def run(batches):
        model = load(path, pattern)
        for rb in batches:
            column = rb.column(at).fill_null(b"") if pa.types.is_binary(rb.column(at).type) else rb.column(at)
            if pa.types.is_binary(column.type):
                edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]].copy().view("<u4") if len(column) else np.zeros(0, "<u4")
                edge = (edge - edge[0]) // 4
            else:
                ids = column.flatten().to_numpy(zero_copy_only=False)
                edge = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            yield _with(rb, "decoded", _binary(*model.decode(ids.astype(np.int64), edge)))

    return run


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`encoded` with a further binary column `decoded`, the bytes that `ids` (of either form) stand for; null ids are none."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("binary").alias("decoded")).schema
    run = _decode(path or default_ranks(), pattern or default_pattern(), encoded.columns.index("ids"))
    return encoded.mapInArrow(run, schema)
