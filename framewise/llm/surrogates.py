"""Surrogates for personal data: keyed, type-consistent replacements.

Detected are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card-like numbers, IBANs whose check
digits hold, US social security numbers, secret hexadecimal tokens, keys of known prefixes and, after a title or
a phrase that introduces or signs, or as a listed given name, people's names; a name found so is also replaced wherever else
the same text has it as a whole word, in the same letter case. A surrogate has its entity's type, script,
letter case, separators and length. It is made by a keyed permutation of all strings of the entity's
pattern, without fixed points: the same entity has the same surrogate everywhere (coreference), and two
entities never share one (distinctness). Given names are permuted within the names of the same gender and
script. collisions() checks distinctness over a whole table; resolve() takes the next key until it holds.

Some listed names are words as well. common_words() counts over a whole table which of them stand more often in
lower case than capitalised within a sentence; such a word is no name by itself where a sentence begins, unless the
text has it as a name elsewhere. After a title, before a family name or within a sentence it is one.

Spellings that differ in case, separators or leading zeros of an address only are one entity. Null texts stay null and empty texts stay
empty. Repeated rows give equal rows. Columns that clash with the counts are replaced. An empty table gives an empty
result. Texts of any length are searched whole, one at a time. Where two kinds claim the same characters, the
one listed first in _PATTERNS has them. n_ip counts both kinds of address, n_secret tokens and keys.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored

KEY = b"framewise surrogate key"
#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Alice Anna Carla Clara Elena Emma Eva Fatima Greta Hanna Ines Julia Laura Lena Lucia Maria Nora Olivia Paula Sara Sofia Sophie Susan Valeria".split(),
    ("latin", "m"): "Adam Ahmed Albert Bruno Carlos Daniel David Diego Emil Felix Hugo Ivan Jakob James Jonas Karl Leon Lukas Mateo Noah Oscar Paul Pedro Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Дмитрий Егор Иван Михаил Павел Сергей".split(),
}
#: Titles before a name, with the gender of those that tell it.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Madame": "f", "Monsieur": "m", "Señor": "m", "Señora": "f"}
#: The letters that may stand for each other, by script.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáåæéèêëíìîïóòôöøœúùûüýÿ", "çñšžčćđðþ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
#: Han characters are one alphabet, those from U+4E00 to U+9FFF.
ALPHABETS.append("".join(map(chr, range(0x4E00, 0xA000))))
HEX = "0123456789abcdef"
#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|...")

#: How keys of some services begin.
KEY_PREFIX = re.compile(r"AKIA|ASIA|sk-|gh[pousr]_|xox[abp]-")
_KEY_MARKS = ("AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-")
KEY_LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz"]

_GIVEN = {n: k for k, names in NAMES.items() for n in names}
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯŠŽČĆĐ", "a-zß-öø-ÿа-яšžčćđ"
#: A capital, then letters of any case with single apostrophes or hyphens between them, one of them small: O'Neill, McDonald.
_NAME = rf"[{_UPPER}](?=[{_UPPER}'’-]*[{_LOWER}])(?:['’-]?[{_UPPER}{_LOWER}])+"
#: What stands before one to three names, and what before two or three.
INTRODUCED = ["my name is", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут"]
SIGNED = ["contact", "written by", "signed by", "sincerely,", "regards,", "Kontakt:", "contacto:", "автор:"]
#: The same before two to four Han characters.
INTRODUCED_HAN = ["我叫", "我的名字是", "my name is "]
_PATTERNS: list[tuple[str, re.Pattern[str], Callable[[str], bool]]] = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), lambda t: "@" in t),
    ("key", re.compile(r"(?<![\w-])(?:A[KS]IA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{20,})(?![\w-])"), lambda t: any(x in t for x in _KEY_MARKS)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"), lambda t: bool(_HEX_RUN.search(t))),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), lambda t: True),
    ("ipv6", re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{6,39}(?![\w:])(?!\.\d)"), lambda t: "::" in t or t.count(":") > 6),
    ("ip", re.compile(r"(?<![\d.])(?<!\bv)(?<!ersion )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d|\d)"), lambda t: True),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])"), lambda t: True),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"), lambda t: "-" in t),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w-])"), lambda t: True),
]
_HEX_RUN = re.compile(r"[0-9a-fA-F]{32}")
_TITLED = re.compile(rf"\b({'|'.join(TITLES)})\.? ({_NAME})(?: ({_NAME}))?")
_LISTED = re.compile(rf"\b({'|'.join(sorted(_GIVEN, key=len, reverse=True))})(?: ({_NAME}))?(?![\w'’-])")
_CUED = re.compile(rf"(?i:\b(?:{'|'.join(INTRODUCED)}))[: ]+({_NAME})(?: ({_NAME}))?(?: ({_NAME}))?|(?i:\b(?:{'|'.join(SIGNED)}))\s+({_NAME}) ({_NAME})(?: ({_NAME}))?(?![\w'’-])")
_CUES = tuple(x.lower() for x in INTRODUCED + SIGNED)
_CUED_HAN = re.compile(rf"(?:{'|'.join(INTRODUCED_HAN)})([\u4e00-\u9fff]{{2,4}})(?![\u4e00-\u9fff])")
_POSSESSIVE = re.compile(r"(?<=[^\W\d_]{2})(?:['’]s|['’-]+)$")
_WORD = re.compile(rf"(?<!\w){_NAME}(?:['’-]\w+)*(?!\w)|\w+(?:['’-]\w+)+")
_PART = re.compile(r"\w+")
_HAS_DIGITS = re.compile(r"\d(?:\d|\.\d)")
_NO_DIGIT_PAIR = ("email", "key", "secret", "ipv6")
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-ÞА-Я]\w*")
_QUOTES = " \t\"'‘’“”«»()[]¿¡"
#: For each listed name its lower-case form and itself, each with the pattern of the whole word.
_WHOLE = {n: tuple((w, re.compile(rf"{w}(?!\w)(?<!\w{w})")) for w in (n.lower(), n)) for n in _GIVEN}


def permute(x: int, size: int, secret: bytes, label: str) -> int:
    """A keyed permutation of 0..size-1 without fixed points (of one value it is that value).

    Four Feistel rounds on the next even number of bits, walked until the value is in range, give a
    permutation p; the result is p's inverse of the successor of p(x), which never equals x.
    """
    if size < 2:
        return x
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1

    def f(r: int, v: int) -> int:
        d = hmac.new(secret, f"{label}|{size}|{r}|{v}".encode(), hashlib.sha256).digest()
        while len(d) * 8 < half:
            d += hashlib.sha256(d).digest()
        return int.from_bytes(d, "big") & mask

    def forward(v: int) -> int:
        while True:
            a, b = v >> half, v & mask
            for r in range(4):
                a, b = b, a ^ f(r, b)
            v = a << half | b
            if v < size:
                return v

    def back(v: int) -> int:
        while True:
            a, b = v >> half, v & mask
            for r in (3, 2, 1, 0):
                a, b = b ^ f(r, a), a
            v = a << half | b
            if v < size:
                return v

    return back((forward(x) + 1) % size)


def respell(text: str, secret: bytes, label: str, alphabets: list[str] = ALPHABETS) -> str:
    """Another string of the same pattern: each letter or digit by one of its alphabet, case kept."""
    low = text.lower()
    sets = [next((a for a in alphabets if c in a), None) for c in low]
    if len(low) != len(text) or not any(sets):
        return text
    x, size = 0, 1
    for c, a in zip(low, sets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    pattern = "".join(str(alphabets.index(a)) if a else c for c, a in zip(low, sets, strict=True))
    y, out = permute(x, size, secret, f"{label}|{pattern}"), []
    for c, low_c, a in zip(reversed(text), reversed(low), reversed(sets), strict=True):
        if a:
            y, i = divmod(y, len(a))
            out.append(a[i].upper() if c != low_c else a[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    """The two digits that make an IBAN's remainder by 97 one; letters count from 10 on."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}"


def is_ipv6(text: str) -> bool:
    """An IPv6 address of more than one group, so that neither times nor '::1' are taken."""
    try:
        return len({*ipaddress.IPv6Address(text).exploded.split(":")} - {"0000"}) > 1 or text.count(":") == 7
    except ValueError:
        return False


_VALID: dict[str, Callable[[str], bool]] = {
    "iban": lambda t: (x := t.replace(" ", "")) and iban_check(x[:2], x[4:]) == x[2:4],
    "ipv6": is_ipv6,
    # Sixteen digits, or groups of four, are a card's by their form; others, such as times in milliseconds, need its check digit.
    "card": lambda t: len(t) == 16 or not t.isdecimal() or int(t[-1]) == luhn(t[:-1]),
}
_SSN = dict((k, p) for k, p, _ in _PATTERNS)["ssn"]


def _digits_into(form: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def surrogate(kind: str, entity: str, secret: bytes) -> str:
    """The replacement of one entity, in its own format."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, dot, top = domain.rpartition(".")
        mixed = respell(f"{local}@{name}", secret, f"email|{top.lower()}")
        return f"{mixed}{dot}{top}"
    if kind == "secret":
        return respell(entity, secret, "secret", [HEX])
    if kind == "key":
        head = KEY_PREFIX.match(entity)[0]
        return head + respell(entity[len(head) :], secret, f"key|{head}", KEY_LETTERS)
    if kind == "iban":
        x = canonical(kind, entity)
        rest = respell(x[4:], secret, f"iban|{x[:2]}")
        new = iter(x[:2] + iban_check(x[:2], rest) + rest)
        return "".join(c if c == " " else next(new) for c in entity)
    if kind == "ssn":
        # Numbers that are never given out are passed over, which leaves a permutation of the others.
        new = respell(entity, secret, "ssn")
        while not _SSN.fullmatch(new):
            new = respell(new, secret, "ssn")
        return new
    if kind == "ipv6":
        # Groups of zero stay, the others are permuted together, so short spellings stay short.
        groups = [int(g, 16) for g in canonical(kind, entity).split(":")]
        live = [g for g in groups if g]
        y = permute(sum((g - 1) * 65535**i for i, g in enumerate(live)), 65535 ** len(live), secret, f"ipv6|{[bool(g) for g in groups]}")
        for i, g in enumerate(groups):
            if g:
                y, rest = divmod(y, 65535)
                groups[i] = rest + 1
        full = ":".join(f"{g:04x}" for g in groups)
        new = ipaddress.IPv6Address(full).compressed if "::" in entity else full if len(entity) == 39 else ":".join(f"{g:x}" for g in groups)
        return new.upper() if entity.upper() == entity and entity.lower() != entity else new
    if kind == "ip":
        parts = [int(x) for x in canonical(kind, entity).split(".")]
        y = permute(sum(p << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, secret, "ip")
        return ".".join(str(y >> 8 * (3 - i) & 255) for i in range(4))
    if kind == "phone":
        digits = canonical(kind, entity)
        code = COUNTRY.match(digits[1:])[0] if digits[0] == "+" else ""
        digits = digits.removeprefix("+")
        return _digits_into(entity, code + respell(digits[len(code) :], secret, f"phone|{code}"))
    if kind == "card":
        digits = canonical(kind, entity)
        offset = (int(digits[-1]) - luhn(digits[:-1])) % 10
        body = respell(digits[:-1], secret, f"card|{offset}")
        return _digits_into(entity, body + str((luhn(body) + offset) % 10))
    if kind.startswith("given"):
        _, script, gender = kind.split("|")
        names = NAMES[script, gender]
        return names[permute(names.index(entity), len(names), secret, kind)]
    return respell(entity, secret, "family")


def canonical(kind: str, entity: str) -> str:
    """What spellings of one entity have in common; surrogates are derived from it. Digits are ASCII's.

    A phone number keeps its plus sign: '+555 123 4567' and '555-123-4567' are two entities.
    """
    if kind in ("phone", "card"):
        digits = "".join(str(int(c)) for c in entity if c.isdecimal())
        return "+" + digits if entity.startswith("+") else digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in entity.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(entity).exploded
    if kind == "iban":
        return entity.replace(" ", "")
    return entity.lower() if kind in ("email", "secret") else entity


Found = tuple[int, int, str, str]


def _begins_sentence(text: str, at: int) -> bool:
    """Whether only quotes and brackets stand between a place and the text's, line's or sentence's beginning."""
    while at and text[at - 1] in _QUOTES:
        at -= 1
    return not at or text[at - 1] in ".!?…:\n\r"


def find(text: str, common: frozenset[str] = frozenset()) -> list[Found]:
    """(begin, end, kind, entity) of all entities, in order, without overlaps; earlier kinds win.

    Names in `common` need more than the first place of a sentence.
    """
    found: list[Found] = []
    begins: list[int] = []  # of what was found, in order, with the ends beside it
    ends: list[int] = []

    def add(begin: int, end: int, kind: str) -> None:
        i = bisect.bisect_left(ends, begin + 1)
        if i == len(ends) or end <= begins[i]:
            begins.insert(i, begin)
            ends.insert(i, end)
            found.append((begin, end, kind, text[begin:end]))

    digits = bool(_HAS_DIGITS.search(text))
    for kind, pattern, worth in _PATTERNS:
        # The other kinds need two digits side by side, or with a point between them.
        if (digits or kind in _NO_DIGIT_PAIR) and worth(text):
            for m in pattern.finditer(text):
                if kind in _VALID and not _VALID[kind](m[0]):
                    continue
                add(m.start(), m.end(), kind)
    # Most texts hold neither a title nor a listed name; their capitalised words tell it sooner than the patterns.
    words = set(_CAPITALISED.findall(text))
    for pattern, with_title in ((_TITLED, True), (_LISTED, False)):
        if words.isdisjoint(TITLES if with_title else _GIVEN):
            continue
        for m in pattern.finditer(text):
            given, family = (2, 3) if with_title else (1, 2)
            if not with_title and not m[2] and m[1] in common and _begins_sentence(text, m.start()):
                continue
            for g in (given, family):
                if m[g]:
                    name = _POSSESSIVE.sub("", m[g])
                    script_gender = _GIVEN.get(name)
                    kind = f"given|{script_gender[0]}|{script_gender[1]}" if script_gender else "family"
                    add(m.start(g), m.start(g) + len(name), kind)
    low = text.lower()
    if any(x in low for x in _CUES):
        for m in _CUED.finditer(text):
            for g in range(1, 7):
                if m[g]:
                    name = _POSSESSIVE.sub("", m[g])
                    known = _GIVEN.get(name)
                    add(m.start(g), m.start(g) + len(name), f"given|{known[0]}|{known[1]}" if known else "family")
    if any(x in text for x in INTRODUCED_HAN):
        for name in {m[1] for m in _CUED_HAN.finditer(text)}:
            for m in re.finditer(name, text):  # words have no borders there
                add(m.start(), m.end(), "family")
    found.sort()
    names = {entity: kind for _, _, kind, entity in found if kind == "family" or kind.startswith("given")}
    return sorted(found + _mentions(text, names, found)) if names else found


def _mentions(text: str, names: dict[str, str], found: list[Found]) -> list[Found]:
    """All whole-word mentions of the names outside what was found, which is in order."""
    ends = [f[1] for f in found]
    out = []
    for m in _WORD.finditer(text):
        # A word is a name, or of its parts between hyphens and apostrophes some are.
        whole = _POSSESSIVE.sub("", m[0])
        parts = [(m.start(), whole)] if whole in names else [(m.start() + p.start(), p[0]) for p in _PART.finditer(m[0])]
        for begin, name in parts:
            if name in names:
                i = bisect.bisect_right(ends, begin)
                if i == len(found) or begin + len(name) <= found[i][0]:
                    out.append((begin, begin + len(name), names[name], name))
    return out


def replace(text: str, secret: bytes, cache: dict | None = None, common: frozenset[str] = frozenset()) -> tuple[str, list[Found], list[str]]:
    """The text with surrogates, what was found, and what stands in its place."""
    found = find(text, common)
    if not found:
        return text, found, []
    cache = {} if cache is None else cache
    out, at, new = [], 0, []
    for begin, end, kind, entity in found:
        if (kind, entity) not in cache:
            if len(cache) > 100_000:
                cache.clear()
            cache[kind, entity] = surrogate(kind, entity, secret)
        new.append(cache[kind, entity])
        out += [text[at:begin], new[-1]]
        at = end
    return "".join([*out, text[at:]]), found, new


KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "secret", "name")
_COUNTED = {"ipv6": "ip", "key": "secret"}


def common_words(docs: DataFrame) -> frozenset[str]:
    """Listed given names that the table has more often in lower case than capitalised within a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {n: [0, 0] for n in _GIVEN}
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                for name, (plain, inner) in _WHOLE.items():
                    # Words of a text are looked for only where it has their letters.
                    if plain[0] in text:
                        seen[name][0] += len(plain[1].findall(text))
                    if inner[0] in text:
                        seen[name][1] += sum(not _begins_sentence(text, m.start()) for m in inner[1].finditer(text))
        yield pa.RecordBatch.from_pylist([{"name": n, "plain": a, "inner": b} for n, (a, b) in seen.items()])

    counts = docs.select("text").mapInArrow(run, "name string, plain long, inner long")
    rows = counts.groupBy("name").agg(F.sum("plain").alias("plain"), F.sum("inner").alias("inner")).where("plain > inner")
    return frozenset(r.name for r in bounded(rows, len(_GIVEN), "given names"))


def anonymize(docs: DataFrame, secret: bytes = KEY, common: frozenset[str] = frozenset()) -> DataFrame:
    """docs with surrogates in text, and n_<kind> of each kind."""
    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, counts = [], []
                for x in part.column(place).to_pylist():
                    text, found, _ = (x, [], []) if x is None else replace(x, secret, cache, common)
                    texts.append(text)
                    kinds = [k if (k := _COUNTED.get(f[2], f[2])) in KINDS else "name" for f in found]
                    counts.append([kinds.count(k) for k in KINDS])
                columns = [pa.array(texts, pa.string()) if i == place else part.column(i) for i in range(len(names))]
                numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*names, *(f"n_{k}" for k in KINDS)])

    schema = docs.select(*names).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select(*names).mapInArrow(run, schema)


def entities(docs: DataFrame, secret: bytes = KEY, common: frozenset[str] = frozenset()) -> DataFrame:
    """kind, hashes of entity and surrogate in their canonical spelling: one row for each find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        digest = lambda k, e: hashlib.blake2b(canonical(k, e).encode(), digest_size=16).digest()
        for batch in batches:
            rows = set()
            for x in batch.column(0):
                _, found, new = replace(x.as_py() or "", secret, cache, common)
                rows.update((f[2], digest(f[2], f[3]), digest(f[2], n)) for f, n in zip(found, new, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, entity binary, surrogate binary")


def collisions(docs: DataFrame, secret: bytes = KEY, common: frozenset[str] = frozenset()) -> DataFrame:
    """Surrogates that two entities share, and entities with two surrogates.

    The texts are searched once: distinct pairs are written to the shared folder, and both checks read those.
    """
    pairs = stored(entities(docs, secret, common).distinct())
    shared = pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a != b").select("kind", F.lit("shared").alias("what"))
    split = pairs.groupBy("kind", "entity").agg(F.min("surrogate").alias("a"), F.max("surrogate").alias("b")).where("a != b").select("kind", F.lit("split").alias("what"))
    return shared.union(split)


def resolve(docs: DataFrame, secret: bytes = KEY, most: int = 4, common: frozenset[str] = frozenset()) -> bytes:
    """The first of successive keys under which the table has no collisions."""
    for n in range(most):
        key = secret if not n else hashlib.sha256(secret + bytes([n])).digest()
        if not collisions(docs, key, common).limit(1).count():
            return key
    raise RuntimeError(f"collisions under {most} keys")


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    part = docs.select("doc_id", "text")
    common = common_words(part)
    return anonymize(part, resolve(part, common=common), common)
