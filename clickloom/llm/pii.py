"""Personal data: detected entities receive keyed surrogates.

An entity is a type and a normal form (the digits of a phone or card number, the lower-cased e-mail
address, one part of a name). Its surrogate is drawn with a secret key from the same kind of values:
same lengths and places of letters and digits, letters of the same script, a phone number keeps its
country code, a card its first digit and whether its check digit holds, an address its valid octets, a
given name its gender. A name is found behind a title or by a common given name; its parts are then
replaced wherever else the document has them as whole words, unless written small. The surrogate is then written in the form of each mention, so one entity reads alike wherever and however it is written (coreference).

All distinct entities of the corpus are checked together: no two entities of a type may share a
surrogate, and no surrogate may be an entity of the corpus; the larger of two in conflict draws again
until none is left (distinctness). A shape whose values run out is widened with every `WIDEN` attempts:
one more digit or letter, or octets of any length, so a free value is always found. Nearly all entities
keep their first draw, which every task can make by itself, so only the others are joined back to documents.

Null texts stay null, other columns are kept, repeated rows give repeated rows. Rows without id, or with
one id, are told apart by their texts.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import stage

WIDEN = 4

# Calling codes of one and two digits; all others have three.
SHORT_CODES = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)

# Titles with the gender they tell.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f",
          "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "господин": "m", "госпожа": "f"}
# Common given names, by script and gender: both what is recognised and what first draws take.
GIVEN = {
    ("latin", "f"): "Anna Maria Sarah Laura Julia Emma Sophie Claire Elena Lucia Carmen Ingrid Alice Helen Marta".split(),
    ("latin", "m"): "John Peter Paul Thomas Michael David Daniel Martin Hans Pierre Jean Carlos Luis Miguel Robert".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Ирина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Михаил Николай".split(),
}
GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
}
ENDING = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н"}

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)")
ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
CARD = re.compile(r"(?<![\w.])(?:\d{4}[ -]?){3}\d{4}(?!\w)|(?<![\w.])\d{13,19}(?!\w)")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{16,})")
TITLED = re.compile(r"\b(" + "|".join(TITLES) + r")\b\.?[ ]")
NAMED = re.compile(r"\b(" + "|".join(GENDER) + r")\b")
_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTERS = rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*"
_RUN = re.compile(_LETTERS)
_PART = re.compile(rf"{_LETTERS}(?:[-'](?!s(?!\w)){_LETTERS})*")
_DIGIT = re.compile(r"[0-9]")


# Letters that surrogates of a script are made of; other scripts take all of their own.
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "armenian": "".join(map(chr, range(0x561, 0x587))), "georgian": "".join(map(chr, range(0x10D0, 0x10F1))),
    "hebrew": "".join(map(chr, range(0x5D0, 0x5EB))), "arabic": "".join(map(chr, [*range(0x628, 0x63B), *range(0x641, 0x649), 0x64A])),
    "cjk": "".join(map(chr, range(0x4E00, 0x9FA6))), "hangul": "".join(map(chr, range(0xAC00, 0xD7A4))),
}


def _named_script(c: str) -> str:
    named = unicodedata.name(c, "").split() or [""]
    return (named[1] if named[0] in ("FULLWIDTH", "HALFWIDTH") else named[0]).lower().removesuffix("-hiragana")


@lru_cache(1)
def _derived() -> dict[str, str]:
    """Small or caseless letters of all scripts."""
    out = {}
    for c in map(chr, range(0x20000)):
        if unicodedata.category(c) in ("Ll", "Lo") and len(c.upper()) == 1 and unicodedata.normalize("NFKC", c) == c:
            out.setdefault(_named_script(c), []).append(c)
    cased = {k: [c for c in v if unicodedata.category(c) == "Ll"] or v for k, v in out.items()}
    return {k: "".join(v) for k, v in cased.items() if len(v) >= 10}


@lru_cache(1 << 14)
def script(word: str) -> str:
    """The script of the first letter; signs that have none count as Latin."""
    own = _named_script(word[0])
    return own if own in ALPHABETS or own in _derived() else "latin"


def alphabet(writing: str) -> str:
    return ALPHABETS.get(writing) or _derived()[writing]


def _opens_name(c: str) -> bool:
    """A capital, or a letter of a script that has none."""
    return c.isupper() or c.istitle() or unicodedata.category(c) == "Lo" or script(c) == "georgian"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _names(text: str):
    """Name parts after a title, and known given names with a capitalised word after them."""
    at = 0
    for m in re.compile(f"{TITLED.pattern}|{NAMED.pattern}").finditer(text):
        if m.start() < at:
            continue
        title = m[1]
        pos, parts = (m.end(), []) if title else (m.start(), [])
        while len(parts) < 3:
            p = _PART.match(text, pos)
            if not p or not _opens_name(p[0][0]):
                break
            parts.append(p)
            if text[p.end() : p.end() + 1] != " ":
                break
            pos = p.end() + 1
        if not parts or not title and len(parts) < 2:
            continue
        at = parts[-1].end()
        gender = TITLES.get(title) or GENDER.get(parts[0][0], ("", "n"))[1]
        for p in parts[:-1]:
            yield p.start(), p.end(), f"given:{script(p[0])}:{GENDER.get(p[0], ('', gender))[1]}", p[0].lower()
        last = parts[-1]
        kind = "surname" if len(parts) > 1 or last[0] not in GENDER else f"given:{script(last[0])}:{gender}"
        yield last.start(), last.end(), kind if ":" in kind else f"surname:{script(last[0])}:n", last[0].lower()


def _mentioned(text: str, names: list[tuple[int, int, str, str]]):
    """Further whole-word mentions of the parts of names; a part of several kinds is of its first one."""
    kinds, count, low = {}, {}, text.lower()
    for _, _, kind, norm in names:
        kinds.setdefault(norm, kind)
        count[norm] = count.get(norm, 0) + 1
    if all(low.count(norm) <= n for norm, n in count.items()):
        return
    known = {a for a, *_ in names}
    for whole in _PART.finditer(text):
        for m in [whole] if whole[0].lower() in kinds else _RUN.finditer(text, whole.start(), whole.end()):
            a, b = m.span()
            around = text[a - 1 : a] + text[b : b + 1]
            if m[0].lower() in kinds and a not in known and _opens_name(m[0][0]) and not re.search(r"\w", around):
                yield a, b, kinds[m[0].lower()], m[0].lower()


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form), in order and without overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in SECRET.finditer(text):
            if _DIGIT.search(m[1]):
                found.append((m.start(1), m.end(1), "secret", m[1]))
        for m in ADDRESS.finditer(text):
            if all(int(o) < 256 for o in m[0].split(".")):
                found.append((m.start(), m.end(), "address", m[0]))
        for kind, pattern in (("card", CARD), ("phone", PHONE)):
            found += [(m.start(), m.end(), kind, "".join(c for c in m[0] if c.isdecimal() or c == "+")) for m in pattern.finditer(text)]
    if TITLED.search(text) or NAMED.search(text):
        names = list(_names(text))
        found += names
        found += _mentioned(text, names)
    found.sort(key=lambda f: (f[0], -f[1]))
    out, at = [], 0
    for f in found:
        if f[0] >= at:
            out.append(f)
            at = f[1]
    return out


class Draw:
    """A stream of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.pool = 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big")
            self.block, self.left = self.block + 1, 256
        self.pool, x = self.pool >> 32, self.pool & 0xFFFFFFFF
        self.left -= 32
        return x * n >> 32


def _like(c: str, draw: Draw) -> str:
    """A character of the same kind: digit, or letter of the same case and script."""
    if c in "0123456789":
        return "0123456789"[draw.below(10)]
    if c.isalpha():
        base = alphabet(script(c))
        new = base[draw.below(len(base))]
        return new.upper() if c.isupper() else new
    return c


def _kept(number: str) -> int:
    """How many leading characters of a phone number stay: sign and country code, else what is before ten digits."""
    if not number.startswith("+"):
        return max(0, len(number) - 10) or 1
    return 1 + next((n for n in (1, 2) if number[1 : 1 + n] in SHORT_CODES), 3)


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The normal form of the surrogate."""
    draw = Draw(key, kind, norm, attempt)
    wider = attempt // WIDEN
    digits = lambda n: "".join(str(draw.below(10)) for _ in range(n))
    if kind == "email":
        name, _, domain = norm.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(_like(c, draw) for c in name + "a" * wider) + "@" + "".join(_like(c, draw) for c in host) + "." + top
    if kind == "address":
        lows = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        return ".".join(str(a + draw.below(b - a)) for a, b in ((0, 256) if wider else lows[len(o)] for o in norm.split(".")))
    if kind == "card":
        body = norm[0] + digits(len(norm) - 2 + wider)
        check = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (check if luhn(norm) else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        keep = _kept(norm)
        return norm[:keep] + digits(len(norm) - keep + wider)
    if kind == "secret":
        lower_hex = not norm.strip("0123456789abcdef")
        shape = norm + "0" * wider
        return "".join("0123456789abcdef"[draw.below(16)] if lower_hex else _like(c, draw) for c in shape)
    part, writing, gender = kind.split(":")
    pool = GIVEN.get((writing, gender)) if part == "given" else None
    if pool and attempt == 0:
        return pool[draw.below(len(pool))].lower()
    parts = SYLLABLES.get(writing)
    if not parts:
        letters = alphabet(writing)
        return "".join(letters[draw.below(len(letters))] for _ in range(len(norm) + attempt // 8))
    # the more attempts, the longer the name, so a free one is always found
    name = "".join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 8))
    return name + (ENDING.get((writing, gender), "") if part == "given" else "")


def write_like(mention: str, kind: str, norm: str, new: str) -> str:
    """The surrogate in the form of the mention; what a widened one has more stands at its end."""
    if kind in ("card", "phone"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdecimal() else c for c in mention) + "".join(digits)
    if kind in ("address", "secret"):
        return new
    if mention.isupper():
        return new.upper()
    if kind == "email":
        more = len(new) - len(mention)
        form = mention.replace("@", " " * more + "@")
        return "".join(n.upper() if m.isupper() else n for m, n in zip(form, new))
    return new[:1].upper() + new[1:] if mention[:1].isupper() else new


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("kind", pa.string()), ("norm", pa.string())])


def _mentions(batches):
    for rb in batches:
        out = []
        for d, h, t in zip(*(rb.column(k).to_pylist() for k in range(3))):
            out += {(d, h, kind, norm) for _, _, kind, norm in detect(t or "")}
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, o)) for o in out], schema=FOUND)


def _draws(key: bytes):
    def run(batches):
        for rb in batches:
            kinds, norms, attempts = (rb.column(k).to_pylist() for k in range(3))
            new = [surrogate(key, k, n, a) for k, n, a in zip(kinds, norms, attempts)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(new, pa.string())], names=["kind", "norm", "attempt", "new"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm) to (kind, norm, attempt, new) without a shared or a real value among the surrogates.

    Ends because the shapes widen: n entities of one shape need about WIDEN * log10(n) rounds at most, and one
    or two in practice. Only IPv4 addresses cannot grow beyond their 2^32 values.
    """
    family = F.substring_index("kind", ":", 1)
    real = entities.select(family.alias("family"), F.col("norm").alias("new"), F.lit(True).alias("real")).distinct()
    now = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = stage(now.mapInArrow(_draws(key), "kind string, norm string, attempt int, new string"), "surrogates")
        first = drawn.groupBy(family.alias("family"), "new").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"), F.count("*").alias("k"))
        clash = first.join(real, ["family", "new"], "left").where("k > 1 or real").select("family", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        if clash.isEmpty():
            return drawn
        own = F.struct("attempt", "kind", "norm")
        again = F.coalesce(F.col("real") | (own != F.col("first")), F.lit(False))
        joined = drawn.withColumn("family", family).join(clash, ["family", "new"], "left")
        now = joined.select("kind", "norm", (F.col("attempt") + again.cast("int")).alias("attempt"))


def _replace(key: bytes, text: int, other: int):
    def run(batches):
        for rb in batches:
            out, count = [], []
            for t, redrawn in zip(rb.column(text).to_pylist(), rb.column(other).to_pylist()):
                found = detect(t) if t else []
                new = {(r["kind"], r["norm"]): r["new"] for r in redrawn or ()}
                parts, at = [], 0
                for a, b, kind, norm in found:
                    parts += [t[at:a], write_like(t[a:b], kind, norm, new.get((kind, norm)) or surrogate(key, kind, norm))]
                    at = b
                out.append("".join(parts) + t[at:] if found else t)
                count.append(len(found))
            cols = [c for k, c in enumerate(rb.columns) if k not in (text, other)]
            names = [n for k, n in enumerate(rb.schema.names) if k not in (text, other)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(count, pa.int32())], names=[*names, "text", "n_entities"])

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with surrogates in `text`, and a column n_entities (replacing one of that name)."""
    docs = docs.drop("n_entities")
    own_id, own_hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    mentions = docs.select(own_id.alias("doc_id"), own_hash.alias("text_hash"), "text")
    mentions = stage(mentions.mapInArrow(_mentions, "doc_id long, text_hash long, kind string, norm string"), "mentions")
    drawn = assign(mentions.select("kind", "norm").distinct(), key)
    redrawn = drawn.where("attempt > 0").select("kind", "norm", "new")
    # at most the redrawn entities of one text; free names, since `docs` may have any columns
    names = [n for n in ("_id", "_hash", "_redrawn", *(f"_{k}" for k in range(len(docs.columns) + 3))) if n not in docs.columns]
    key_id, key_hash, others = names[:3]
    by_doc = stage(
        mentions.join(redrawn, ["kind", "norm"]).groupBy(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash))
        .agg(F.collect_set(F.struct("kind", "norm", "new")).alias(others)), "redrawn",
    )
    rest = [c for c in docs.columns if c != "text"]
    same = own_id.eqNullSafe(F.col(key_id)) & (own_hash == F.col(key_hash))
    joined = docs.join(by_doc, same, "left").select(*rest, "text", others)
    schema = docs.select(*rest, F.col("text").cast("string").alias("text"), F.lit(0).alias("n_entities")).schema
    out = joined.mapInArrow(_replace(key, len(rest), len(rest) + 1), schema)
    return out.select(*docs.columns, "n_entities")
