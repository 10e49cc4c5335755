"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

An entity is (type, normal form): all its mentions, in whatever format, get one surrogate (coreference). A surrogate is
the entity under a keyed permutation of the values of its shape: letters go to letters of their script, case and kind
(vowel or consonant), digits to digits, and what check digits, networks, address classes, prefixes and the gender of a
name stand for is kept. Permutations cannot bring two entities to one surrogate (distinctness), and have no fixed point
where two or more characters are permuted. So texts are rewritten in one scan, whatever the number of entities;
``collisions`` checks distinctness over all entities of a corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_PATTERN = re.compile(
    r"""
      (?P<email>(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,24}(?![\w-]))
    | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    | (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
    | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
    | (?P<card>(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w-]))
    | (?P<secret>(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<value>[^\s"'<>]{6,})|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|(?<![\w/+])[0-9a-fA-F]{32,}(?![\w/+]))
    | (?P<name>\b(?P<title>Mrs|Mr|Ms|Miss|Herrn?|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|[Гг]осподину?|[Гг]оспож[аеу]|[Гг]-н|[Гг]-жа)\.?[ ](?P<full>[^\W\d_]{1,40}(?:[ -][^\W\d_]{1,40}){0,2}))
    | (?P<before>[\u4e00-\u9fff]{2,4}(?=先生|女士|小姐))
    """,
    re.X,
)
#: A text without any of these holds no entity; every alternative of the pattern needs one of them.
_HINT = re.compile(r"@|\d\d|\d\.\d|(?i:token|secret|passw|pwd|key)|\bA[KS]IA|\bgh[pousr]_|[0-9a-fA-F]{32}|\b(?:M(?:rs|r|s|iss|onsieur|adame|me)|Herrn?|Frau|Señora?|Sra?)\b|[Гг](?:оспо|-н|-ж)|先生|女士|小姐")
_FEMALE = frozenset("Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа госпожа Госпоже госпоже Госпожу госпожу Г-жа г-жа 女士 小姐".split())
_TITLES = _FEMALE | frozenset("Mr Herr Herrn Monsieur Señor Sr".split())
_GIVEN = {
    "f": "Alba Anna Berta Carla Clara Dora Edda Elena Emma Eva Flora Frida Greta Hanna Helga Ida Ilse Irma Jana Julia Karla Lara Lea Lena Lina Lisa Lotte Lucia Luise Mara Maria Marta Mila Mona Nina Nora Olga Paula Petra Rita Rosa Sara Selma Sofia Tina Ulla Vera Wanda Zita".split(),
    "m": "Adam Albert Anton Arno Bernd Bruno Carlo David Edgar Emil Erik Ernst Felix Franz Georg Gustav Hans Hugo Igor Ivan Jakob Jan Jonas Josef Karl Konrad Lars Leo Luis Marco Mario Martin Max Nico Nils Oskar Otto Pablo Paul Peter Ralf Rolf Rudi Simon Sven Theo Tim Udo Viktor Willi".split(),
}
_LOWER = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çñšžčß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъьіїє", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")
_UPPER = tuple("".join(c.upper() for c in group if len(c.upper()) == 1 and c.upper() != c) for group in _LOWER)
_RANGES = ((0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x0621, 0x064B), (0x05D0, 0x05EB), (0x0905, 0x093A), (0x0E01, 0x0E2F))
_NAMES = ("0123456789", *_LOWER, *_UPPER, *("".join(map(chr, range(*r))) for r in _RANGES))
_LATIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {
    alphabets: {c: (k, i) for k, group in enumerate(alphabets) for i, c in enumerate(group)} for alphabets in (_NAMES, _LATIN, ("0123456789abcdef",), ("0123456789ABCDEF",))
}
_ROUNDS, _CHUNK = 8, 48


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity mention, in order, never overlapping. A person named in full after
    a title is found without it too, wherever the text has the full name."""
    if not text or not _HINT.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    people: dict[str, str] = {}
    for m in _PATTERN.finditer(text):
        kind = next(k for k in ("email", "iban", "ip", "ssn", "phone", "card", "secret", "name", "before") if m.group(k) is not None)
        start, end = m.span("value") if kind == "secret" and m.group("value") else m.span("full") if kind == "name" else m.span()
        value = text[start:end]
        if kind == "secret":
            value = value.rstrip(".,;:!?") if m.group("value") else value
        if kind == "phone" and not 7 <= sum(map(str.isdigit, value)) <= 15:
            continue
        if kind == "name":
            value = _proper(value)
        if not value:
            continue
        end = start + len(value)
        norm = value.lower() if kind == "email" else value if kind == "secret" else re.sub(r"[^0-9A-Za-z]", "", value).upper() if kind in ("phone", "card", "ssn", "iban") else " ".join(value.split())
        if kind in ("name", "before"):
            title = m.group("title") or text[end : end + 2]
            norm, kind = ("f" if title in _FEMALE else "m") + ":" + norm, "name"
            if " " in value or "-" in value:
                people.setdefault(value, norm)
        out.append((start, end, kind, norm))
    if people:
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(people, key=lambda v: (-len(v), v)))) + r")(?!\w)")
        taken = sorted(x[:2] for x in out)
        for m in again.finditer(text):
            if not _meets(taken, *m.span()):
                out.append((*m.span(), "name", people[m.group()]))
        out.sort()
    return out


def _meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    from bisect import bisect_left

    k = bisect_left(taken, (end, -1))
    return k > 0 and taken[k - 1][1] > start


def _proper(value: str) -> str:
    """The leading words that are written as names are: with a capital and small letters, or in a script without case."""
    end = 0
    for m in re.finditer(r"[^ -]+", value):
        word = m.group()
        uncased = word.lower() == word.upper()
        if word in _TITLES or not (uncased and len(word) <= 12 or len(word) > 1 and word[0].isupper() and word[1:].islower()):
            break
        end = m.end()
    return value[:end]


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=40).digest(), "big")


def _feistel(key: bytes, x: int, n: int, radix: int, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the numbers of n digits to a radix, or its inverse."""
    a, b = radix ** (n // 2), radix ** (n - n // 2)
    left, right = divmod(x, b)
    for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        sign = -1 if back else 1
        if r % 2:
            right = (right + sign * _number(key, tweak, n, radix, r, left)) % b
        else:
            left = (left + sign * _number(key, tweak, n, radix, r, right)) % a
    return left * b + right


def _moved(key: bytes, x: int, n: int, radix: int, tweak: str) -> int:
    """The permutation that takes each number to the next of one keyed cycle through all of them: none stays."""
    if radix**n < 2:
        return x
    if n == 1:
        return (x + 1 + _number(key, tweak, radix) % (radix - 1)) % radix
    return _feistel(key, (_feistel(key, x, n, radix, tweak, True) + 1) % radix**n, n, radix, tweak)


def reshape(key: bytes, text: str, tweak: str, alphabets: tuple[str, ...] = _NAMES) -> str:
    """The text with the characters of each alphabet permuted, as one number to the alphabet's size, among their places."""
    places: dict[int, list[int]] = defaultdict(list)
    classes, out = _CLASSES[alphabets], list(text)
    for at, c in enumerate(text):
        if c in classes:
            places[classes[c][0]].append(at)
    for k, spots in places.items():
        group = alphabets[k]
        for first in range(0, len(spots), _CHUNK):
            some = spots[first : first + _CHUNK]
            x = 0
            for at in some:
                x = x * len(group) + classes[text[at]][1]
            x = _moved(key, x, len(some), len(group), f"{tweak}\0{k}\0{first}")
            for at in reversed(some):
                x, i = divmod(x, len(group))
                out[at] = group[i]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that belongs behind these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _address(key: bytes, norm: str) -> str:
    """IPv4 addresses are permuted among the private ranges, loopback, and what is neither that nor multicast, each."""
    x = int(ipaddress.IPv4Address(norm))
    for first, bits in ((10 << 24, 24), (0xAC100000, 20), (0xC0A80000, 16), (127 << 24, 24), (0, 24), (224 << 24, 28), (240 << 24, 28)):
        if x >> bits == first >> bits:
            return str(ipaddress.IPv4Address(first + _moved(key, x - first, bits, 2, f"ip{first}")))
    while True:  # along the permutation of all addresses up to the next one of this kind
        x = _moved(key, x, 32, 2, "ip")
        if not (x >> 24 in (0, 10, 127) or x >> 24 >= 224 or x >> 20 == 0xAC1 or x >> 16 == 0xC0A8):
            return str(ipaddress.IPv4Address(x))


def _given(key: bytes, gender: str, word: str) -> str:
    """Known given names are permuted among those of their gender; of others the last letter, which often tells the
    gender, stays."""
    names = _GIVEN[gender]
    if word in names:
        return names[_moved(key, names.index(word), 1, len(names), "given" + gender)]
    while True:
        word = _family(key, word)
        if word not in names:
            return word


def _family(key: bytes, word: str) -> str:
    return reshape(key, word[:-1], "name" + word[-1]) + word[-1] if len(word) > 1 else reshape(key, word, "name")


def surrogate(key: bytes, kind: str, norm: str) -> str:
    """The normal form of an entity's surrogate."""
    if kind == "card":  # the network's first digit stays; the check digit is as right or wrong as it was
        body = norm[0] + reshape(key, norm[1:-1], kind + norm[0], _LATIN)
        return body + str((luhn(body) + int(norm[-1]) - luhn(norm[:-1])) % 10)
    if kind in ("phone", "ssn"):
        return reshape(key, norm, kind, _LATIN)
    if kind == "iban":
        account = reshape(key, norm[4:], kind + norm[:2], _LATIN)
        return f"{norm[:2]}{(iban_check(norm[:2], account) + int(norm[2:4]) - iban_check(norm[:2], norm[4:])) % 100:02d}{account}"
    if kind == "ip":
        return _address(key, norm)
    if kind == "secret":
        keep = len(m.group()) if (m := re.match(r"AKIA|ASIA|gh[pousr]_", norm)) else 0
        digits = norm[keep:]
        alphabets = ("0123456789abcdef",) if re.fullmatch(r"[0-9a-f]+", digits) else ("0123456789ABCDEF",) if re.fullmatch(r"[0-9A-F]+", digits) else _LATIN
        return norm[:keep] + reshape(key, digits, kind, alphabets)
    if kind == "email":  # under a name that is reserved and never routed
        local, _, domain = norm.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{reshape(key, local, kind + domain)}@{reshape(key, host, 'host')}.{top}.example"
    gender, full = norm.split(":", 1)
    parts = re.split(r"([ -])", full)
    return f"{gender}:" + "".join(_given(key, gender, p) if k < len(parts) - 1 and k % 2 == 0 else p if k % 2 else _family(key, p) for k, p in enumerate(parts))


def _format(kind: str, value: str, norm: str) -> str:
    """The surrogate's normal form in the format of one mention: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(norm)
        return "".join((lambda s: s.lower() if c.islower() else s)(next(it)) if c.isalnum() and c.isascii() else c for c in value)
    if kind == "email":
        return norm.upper() if value.isupper() else norm
    return norm.split(":", 1)[1] if kind == "name" else norm


def replace(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and the spans in the new text."""
    found = find(text)
    if not found:
        return text, []
    out, spans, at, size, made = [], [], 0, 0, {}
    for start, end, kind, norm in found:
        if (kind, norm) not in made:
            made[kind, norm] = surrogate(key, kind, norm)
        new = _format(kind, text[start:end], made[kind, norm])
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size, at = size + len(new), end
    return "".join([*out, text[at:]]), spans


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, entities): surrogates that more than one entity of all texts would get, or that would leave an
    entity as it is; empty if distinctness holds. Entities are made distinct in each task and before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            seen = sorted({(k, n) for t in b.column(0).to_pylist() for _, _, k, n in find(t)})
            rows = [(k, n, surrogate(key, k, n)) for k, n in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], ["kind", "norm", "surrogate"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, norm string, surrogate string").distinct()
    found = made.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities"), F.max(F.col("norm") == F.col("surrogate")).alias("stays"))
    return found.filter("entities > 1 OR stays").select("kind", "surrogate", "entities")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_entities, spans (kind, start, end in the new text).

    Null text stays null, empty text empty; rows without an id are kept; repeated rows come back as often, with the same
    replacements; an empty table gives no rows. Texts without entities come back as they are. ``key`` (up to 64 bytes)
    is the caller's secret: with it surrogates can be computed again.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            done = [replace(t, key) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([len(d[1]) for d in done], pa.int32()), pa.array([d[1] for d in done], span)], ["doc_id", "text", "n_entities", "spans"])

    return base.mapInArrow(run, "doc_id long, text string, n_entities int, spans array<struct<kind:string,start:int,end:int>>")
