"""SentencePiece encoding and decoding by a batched Viterbi pass in NumPy.

Words of equal length advance together. At every place the hashes of all substrings that end there are
looked up in the sorted hashes of the pieces, and the vectorised maximum over the candidates stores a
backpointer.

For a unigram model a candidate scores the best score before it plus its own. For a byte-pair model the
segmentation is the one in which no merge could cross any border between two pieces, so a candidate
counts only if it is compatible with the last piece before it; exactly one is, and the maximum picks it.
Both give the ids of the sentencepiece library. Characters without a piece become bytes where the model
has byte pieces, else the unknown id.

Supported are models with the identity normaliser and kept white space, which are those shipped here;
others are refused. Null texts are empty, and an empty text has no ids. Decoding is exact for texts
without the character that stands for the space (U+2581), which reads back as a space.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import rows, text_batches

SPACE = "▁"
_B = 0x100000001B3
_MUL = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1
CACHED_WORDS = 150_000
SLOTS = 1 << 20
ADVANCED = 1 << 18  # characters of equal-length words that advance together
BATCH_BYTES = 3 << 20  # of text whose distinct words are encoded together


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _B + (ord(c) * _MUL & _FULL) + 1) & _FULL
    return h


class Pieces:
    """Piece tables of one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser that keep white space are supported")
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in spec.pieces):
            raise ValueError("user-defined pieces and white space as a suffix are not supported")
        self.merges = spec.trainer_spec.model_type == 2
        self.prefix = norm.add_dummy_prefix
        self.unknown = SentencePieceProcessor(model_file=path).unk_id()
        self.texts = [p.piece for p in spec.pieces]
        self.kinds = np.array([p.type for p in spec.pieces])
        self.scores = np.array([p.score for p in spec.pieces], np.float64)
        self.byte_ids = [None] * 256
        for i in np.flatnonzero(self.kinds == 6).tolist():
            self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        normal = np.flatnonzero(self.kinds == 1)
        self.id_of = {self.texts[i]: int(i) for i in normal.tolist()}
        self.longest = max(map(len, self.id_of))
        key = np.array([_hash(self.texts[i]) for i in normal.tolist()], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], normal[order].astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True
        self.powers = np.array([pow(_B, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.lone = self.id_of.get(SPACE, -1)
        inner = [t for t in self.id_of if SPACE in t.lstrip(SPACE)]
        if inner or self.merges and not all(c in self.id_of for t in self.id_of for c in t):
            raise ValueError("pieces that go on after a word or hold characters without a piece are not supported")
        runs = [t for t in self.id_of if len(t) > 1 and not t.strip(SPACE)]
        worst = min((s for t, s in zip(self.texts, self.scores) if t in self.id_of and t.strip(SPACE)), default=0)
        if self.merges and any(self.scores[self.id_of[t]] >= worst for t in runs):
            raise ValueError("space runs must be the last merges")
        self.space_run = {1, *map(len, runs)} if self.lone >= 0 and runs else set()
        if self.merges and len({self.scores[self.id_of[t]] for t in runs}) > 1:
            raise ValueError("space runs must have one score")
        # characters that no longer piece holds: words can be cut there
        joined = {c for t in self.id_of if len(t) > 1 for c in t}
        self.cuts = [c for c in "\n\t\r" if c not in joined]
        if self.merges:
            self._spines()
        sizes = [len(self._bytes(i)) for i in range(len(self.texts))]
        self.piece_bytes = np.frombuffer(b"".join(self._bytes(i) for i in range(len(self.texts))), np.uint8)
        self.piece_size = np.array(sizes)
        self.piece_at = np.cumsum(sizes) - self.piece_size
        self.cache: dict[str, bytes] = {}
        self.slot_key = np.full(SLOTS, _FULL, np.uint64)
        self.slot_value = np.zeros(SLOTS, bool)

    def _bytes(self, i: int) -> bytes:
        if self.kinds[i] == 6:
            return bytes([int(self.texts[i][1:-1], 16)])
        if self.kinds[i] == 3:
            return b""
        if self.kinds[i] == 2:
            return " ⁇ ".encode()
        return self.texts[i].replace(SPACE, " ").encode()

    # -- byte-pair models: what could merge across a border

    def _spines(self):
        """For every piece: the parts on its left and right edge while it is built, and when each goes up."""
        n = len(self.texts)
        split, ready = {}, {}
        for text, i in self.id_of.items():
            parts, when = list(text), {}
            while len(parts) > 1:
                best = None
                for k in range(len(parts) - 1):
                    j = self.id_of.get(parts[k] + parts[k + 1])
                    if j is not None and (best is None or self.scores[j] > best[0]):
                        best = (self.scores[j], k)
                if best is None:
                    break
                k = best[1]
                a, b = parts[k], parts[k + 1]
                when[a + b] = min(best[0], when.get(a, np.inf), when.get(b, np.inf))
                parts[k : k + 2] = [a + b]
                if len(parts) == 1:
                    split[i], ready[i] = (self.id_of[a], self.id_of[b]), when[a + b]
        self.ready = np.full(n, np.inf)
        for i, w in ready.items():
            self.ready[i] = w
        whole = np.zeros(n, bool)
        whole[[i for t, i in self.id_of.items() if len(t) == 1 or i in split]] = True
        self.whole = whole  # pieces that their own text is encoded as

        def spine(side):
            depth, found = 1, []
            for i in range(n):
                line, up = [i], [-np.inf]
                while line[-1] in split:
                    up.append(self.ready[line[-1]])
                    line.append(split[line[-1]][side])
                found.append((line, up))
                depth = max(depth, len(line))
            part, when = np.full((n, depth), -1, np.int64), np.full((n, depth), np.inf)
            for i, (line, up) in enumerate(found):
                part[i, : len(line)] = line
                when[i, : len(line)] = up
            return part, when

        self.left, self.left_up = spine(0)
        self.right, self.right_up = spine(1)
        self.left_n, self.right_n = (self.left >= 0).sum(1), (self.right >= 0).sum(1)
        self.hash_of = np.array([_hash(t) for t in self.texts], np.uint64)
        self.size_of = np.array([len(t) for t in self.texts])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        pos = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[pos] == h[at]
        out[at[hit]] = self.ids[pos[hit]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between pieces a and b; -1 stands for a character without a piece."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[both].astype(np.uint64) * np.uint64(1 << 24) + b[both].astype(np.uint64)
        slot = ((key * np.uint64(_MUL)) >> np.uint64(44)).astype(np.int64)
        out[both] = self.slot_value[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            fresh, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            value = self._crossed(a[both[miss[first]]], b[both[miss[first]]])
            out[both[miss]] = value[back]
            self.slot_key[slot[miss[first]]] = fresh
            self.slot_value[slot[miss[first]]] = value
        return out

    def _crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tries all parts on the right edge of a with all on the left edge of b, in one flat lookup."""
        n, m = self.right_n[a], self.left_n[b]
        pair = np.repeat(np.arange(len(a)), n * m)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        i, j = k // m[pair], k % m[pair]
        x, y = a[pair], b[pair]
        p, q = self.right[x, i], self.left[y, j]
        joint = self.lookup(self.hash_of[p] * self.powers[np.minimum(self.size_of[q], self.longest)] + self.hash_of[q])
        ok = np.flatnonzero((joint >= 0) & (self.size_of[p] + self.size_of[q] <= self.longest))
        p, q = p[ok], q[ok]
        when = np.minimum(self.scores[joint[ok]], np.minimum(self.ready[p], self.ready[q]))
        # equal times: the merge further to the left goes first
        first = (when > self.right_up[x[ok], i[ok]]) & (when >= self.left_up[y[ok], j[ok]])
        free = np.ones(len(a), bool)
        free[pair[ok[first]]] = False
        return free

    # -- Viterbi

    def words(self, units: list[str]) -> list[bytes]:
        """Ids of every unit as 32-bit integers; equal lengths advance together."""
        out: list = [None] * len(units)
        size = np.array([len(u) for u in units])
        for n in np.unique(size).tolist():
            pick = np.flatnonzero(size == n)
            for a in range(0, len(pick), max(1, ADVANCED // n)):
                some = pick[a : a + max(1, ADVANCED // n)]
                self._advance([units[i] for i in some.tolist()], n, some, out)
        return out

    def _advance(self, units: list[str], n: int, where: np.ndarray, out: list):
        char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        one = char.astype(np.uint64) * np.uint64(_MUL) + np.uint64(1)
        head = np.zeros((n + 1, len(units)), np.uint64)
        for i in range(n):
            head[i + 1] = head[i] * np.uint64(_B) + one[:, i]
        back = np.zeros((n + 1, len(units)), np.int16)  # length of the last piece of each prefix
        last = np.full((n + 1, len(units)), -1, np.int64)
        best = np.full((n + 1, len(units)), -np.inf)
        best[0] = 0.0
        low = self.scores[self.kinds == 1].min() - 10
        every = np.arange(len(units))
        for i in range(1, n + 1):
            reach = min(i, self.longest)
            sizes = np.arange(1, reach + 1)
            found = self.lookup((head[i] - head[i - sizes] * self.powers[sizes][:, None]).ravel()).reshape(reach, -1)
            use = found >= 0
            use[0] = True
            size, unit = np.nonzero(use & (best[i - sizes] > -np.inf))
            piece, before = found[size, unit], i - 1 - size
            gain = np.full((reach, len(units)), -np.inf)
            if self.merges:
                ok = (piece < 0) | self.whole[piece]
                ok &= (before == 0) | self.compatible(last[before, unit], piece)
                gain[size[ok], unit[ok]] = best[before[ok], unit[ok]] + 1.0
            else:
                gain[size, unit] = best[before, unit] + np.where(piece < 0, low, self.scores[piece])
            top = gain.argmax(0)
            best[i], last[i] = gain[top, every], found[top, every]
            back[i] = np.where(best[i] > -np.inf, top + 1, 0)
        if not back[n].all():
            raise RuntimeError("a word has no segmentation: the piece tables are not those of a merge model")
        pos = np.full(len(units), n)
        every = np.arange(len(units))
        steps = []
        while len(every):
            p = pos[every]
            steps.append((every, last[p, every], p))
            pos[every] = p - back[p, every]
            every = every[pos[every] > 0]
        unit = np.concatenate([s[0] for s in steps])
        piece = np.concatenate([s[1] for s in steps])
        place = np.concatenate([s[2] for s in steps])
        order = np.lexsort((place, unit))
        unit, piece, place = unit[order], piece[order], place[order]
        ids, cut = piece.astype(np.int32), np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        raw = ids.tobytes()
        strange = set(unit[piece < 0].tolist())
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if k not in strange:
                out[where[k]] = raw[4 * a : 4 * b]
                continue
            mixed = []
            for i, p in zip(ids[a:b].tolist(), place[a:b].tolist()):
                mixed += [i] if i >= 0 else self._bytes_of(chr(int(char[k, p - 1])))
            out[where[k]] = np.array(mixed, np.int32).tobytes()

    def _bytes_of(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in raw] if self.byte_ids[0] is not None else [self.unknown]

    def units(self, text: str) -> list[str]:
        """Cut where no piece can span: in front of a space, and around characters of no longer piece."""
        if not text:
            return []
        text = ((SPACE if self.prefix else "") + text).replace(" ", SPACE).replace(SPACE, "\x00" + SPACE)
        for c in self.cuts:
            text = text.replace(c, "\x00" + c + "\x00")
        return [u for u in text.split("\x00") if u]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cache = self.cache
        split = [self.units(t) if "\x00" not in t else self._with_nul(t) for t in texts]
        fresh = list(dict.fromkeys(u for s in split for u in s if u not in cache))
        cache.update(zip(fresh, self.words(fresh)))
        out = []
        for units in split:
            line = np.frombuffer(b"".join(map(cache.__getitem__, units)), np.int32)
            out.append(self._space_runs(line) if self.merges and self.space_run else line)
        if len(cache) > CACHED_WORDS:
            for u in list(itertools.islice(cache, len(cache) // 2)):
                del cache[u]
        return out

    def _with_nul(self, text: str) -> list[str]:
        """A text that holds the cut mark itself: its parts, with the mark as a unit of its own."""
        found = []
        for k, part in enumerate(text.split("\x00")):
            if k:
                found.append("\x00")
            u = self.units(part)
            if k and self.prefix and u:  # only the first part has the dummy prefix
                u = [u[0][1:], *u[1:]] if len(u[0]) > 1 else u[1:]
            found += u
        if self.prefix and found[0] == "\x00":
            found.insert(0, SPACE)
        return found

    def _space_runs(self, ids: np.ndarray) -> np.ndarray:
        """Neighbouring lone spaces merge last, the leftmost possible pair first."""
        lone = ids == self.lone
        if not (lone[1:] & lone[:-1]).any():
            return ids
        out, k = [], 0
        edge = np.flatnonzero(np.diff(lone.astype(np.int8), prepend=0, append=0))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            runs: list[int] = []
            for _ in range(b - a):
                runs.append(1)
                while len(runs) > 1 and runs[-2] + runs[-1] in self.space_run:
                    runs[-2:] = [runs[-2] + runs[-1]]
            out.append(ids[k:a])
            out.append(np.array([self.id_of[SPACE * r] for r in runs], ids.dtype))
            k = b
        return np.concatenate([*out, ids[k:]])

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> list[str]:
        """Texts of the ids between the offsets; one gather for all."""
        n = self.piece_size[ids]
        end = np.append(0, np.cumsum(n))
        kind = np.int32 if end[-1] < 1 << 31 else np.int64
        at = np.repeat((self.piece_at[ids] - end[:-1]).astype(kind), n) + np.arange(end[-1], dtype=kind)
        raw, cut = self.piece_bytes[at].tobytes(), end[edge].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts] if self.prefix else texts


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """One set of tables per worker process."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, at: int, decoded: bool):
    def ids(model, some: list[pa.RecordBatch]):
        found = model.encode([t or "" for rb in some for t in rb.column(at).to_pylist()])
        k = 0
        for rb in some:
            own = found[k : k + rb.num_rows]
            k += rb.num_rows
            offsets = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            back = {"decoded": pa.array(model.decode(flat, offsets), pa.string())} if decoded else {}
            yield pa.RecordBatch.from_arrays([*rb.columns, column, *back.values()], names=[*rb.schema.names, "ids", *back])

    def run(batches):
        model, some, size = load(path), [], 0
        for rb in batches:
            some.append(rb)
            size += rb.column(at).nbytes
            if size > BATCH_BYTES:
                yield from ids(model, some)
                some, size = [], 0
        yield from ids(model, some)

    return run


def encode(docs: DataFrame, path: str | None = None, name: str = "ids") -> DataFrame:
    """`docs` with a further column of token ids; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(name)).schema
    return docs.mapInArrow(_encode(path or default_model(), docs.columns.index("text"), False), schema)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`decode(encode(docs))` in one pass: one worker and one copy of the tables per task, one transfer of the rows."""
    docs = docs.drop("ids", "decoded")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema
    return docs.mapInArrow(_encode(path or default_model(), docs.columns.index("text"), True), schema)


def _decode(path: str, at: int):
    def run(batches):
        model = load(path)
        for rb in batches:
            column = rb.column(at)
            edge = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            texts = model.decode(column.flatten().to_numpy(zero_copy_only=False), edge)
            if column.null_count:
                texts = [None if gone else t for gone, t in zip(column.is_null().to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(texts, pa.string())], names=[*rb.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None, name: str = "ids") -> DataFrame:
    """`encoded` with a further column `decoded`."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("string").alias("decoded")).schema
    return encoded.mapInArrow(_decode(path or default_model(), encoded.columns.index(name)), schema)
