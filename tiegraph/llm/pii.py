"""PII: detected entities get keyed surrogates of the same type and format.

Found: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards, IBANs, US social security numbers, secrets
(keys, tokens, passwords after their name, long hexadecimal strings) and personal names. A name is a run of capitalised
words (in any script with capitals) that has a title, a listed given name, a word that introduces a person, or an e-mail
address or phone number right after it; Chinese names are found before their titles. Where a document has a full name,
its parts are found alone, too.

A surrogate comes from a keyed permutation without fixed points of all strings of the entity's format, so different
entities get different surrogates in the whole corpus, and an entity gets the same one everywhere, in any spelling,
without any table: names word by word, phones by their national digits, addresses by their numbers. Formats keep
separators, case, script, vowels and consonants, country and card checks, ranges of addresses, and for listed given names
the gender and script. A surrogate may be another entity of the document; that one is replaced as well, so the text
still tells the two apart. ``replace`` checks that no two entities of a document share a surrogate.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.llm import common

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Mary Elizabeth Jennifer Linda Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Laura Julia Sophie Emma Charlotte Claire Marie Camille Isabelle Nathalie Carmen Lucia Elena Sofia Isabel Pilar Ursula Monika Sabine Heike Ingrid Petra Birgit Helga",
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Paul Peter Kevin Brian George Pierre Jean Jacques Philippe Nicolas Antoine Carlos Juan Javier Miguel Pablo Diego Hans Klaus Jürgen Wolfgang Stefan Dieter Uwe Heinz",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Людмила",
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел Виктор Борис",
}
TITLES_F = "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа"
TITLES_M = "Mr Herr Monsieur Señor Sr Signor Господин"
TITLES = "Dr Prof Professor Doctor Sir Madam Lady Lord Rev Capt Judge"
INTRODUCES = "contact|dear|name is|named|called|signed|sincerely|regards|author|attn|hello|hi|ask for|speak to|écrivit|contactez|kontakt|ansprechpartner|atentamente|contacto"
#: Calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_GIVEN = {k: v.split() for k, v in GIVEN.items()}
_KIND = {n: (k, i) for k, names in _GIVEN.items() for i, n in enumerate(names)}

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)")
_CARD = re.compile(r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w]|[-.]\d)|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_NAMED_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{8,})")
_SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xox[abp])[-_][A-Za-z0-9_-]{16,}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128})\b")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_CODES = frozenset(TWO_DIGITS.split())


def _upper_class() -> str:
    """The capitals of all scripts, as ranges of a character class."""
    codes = [c for c in range(sys.maxunicode) if chr(c).isupper() and chr(c).isalpha()]
    ends = [i for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    starts = [0, *[i + 1 for i in ends[:-1]]]
    return "".join(f"{chr(codes[i])}-{chr(codes[j])}" for i, j in zip(starts, ends, strict=True))


_TITLED = frozenset([*TITLES_F.split(), *TITLES_M.split(), *TITLES.split()])
_UP = _upper_class()
_TITLE = "|".join(sorted(_TITLED, key=len, reverse=True))
_WORD = rf"(?:(?:{_TITLE})\.?(?= )|[{_UP}]\.(?= )|[{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)*)"
_RUN = re.compile(rf"(?<![^\W_])(?<![’'])(?:{_WORD})(?: {_WORD})*")
_INTRO = re.compile(rf"(?i)(?:\b(?:{INTRODUCES})[:,]?\s+)\Z")
_INTRO_WORDS = frozenset(w for w in INTRODUCES.split("|") if " " not in w)
_HAN = re.compile(r"([\u4e00-\u9fff]{1,4})(?=先生|女士|小姐|太太)")

ALPHABETS = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
_ALPHABET = {c: a for a in ALPHABETS for c in a}


class Permutation:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the next power of four, walked into range.

    ``shift`` conjugates a rotation with it: one cycle through all n values, so nothing maps to itself.
    """

    def __init__(self, key: bytes, n: int, tweak: bytes):
        self.n, self.half = n, max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(tweak + n.to_bytes(-(-n.bit_length() // 8), "big"), key=key[:64], digest_size=32).digest()

    def _f(self, r: int, x: int) -> int:
        size = -(-self.half // 8)
        out = b""
        while len(out) < size:
            out += hashlib.blake2s(bytes([r, len(out) & 255]) + x.to_bytes(size, "big"), key=self.key).digest()
        return int.from_bytes(out[:size], "big") & self.mask

    def _once(self, x: int, rounds: range) -> int:
        a, b = x >> self.half, x & self.mask
        back = rounds.step < 0
        for r in rounds:
            a, b = (b ^ self._f(r, a), a) if back else (b, a ^ self._f(r, b))
        return a << self.half | b

    def _walk(self, x: int, rounds: range) -> int:
        x = self._once(x, rounds)
        while x >= self.n:
            x = self._once(x, rounds)
        return x

    def shift(self, x: int) -> int:
        if self.n < 2:
            return x
        y = (self._walk(x, range(8)) + 1) % self.n
        return self._walk(y, range(7, -1, -1))


def permute_text(text: str, key: bytes, kind: str, keep: Callable[[str], bool] | None = None, ok: Callable[[str], object] | None = None) -> str:
    """Replace each letter and digit by one of its own class; the rest, and the case, stay.

    ``ok`` names the set of strings that ``text`` belongs to; the result is walked into the same set.
    """
    low = text.lower() if len(text.lower()) == len(text) else text
    fixed = [c not in _ALPHABET or (keep is not None and keep(c)) for c in low]
    form = kind + "|" + "".join(c if f else str(ALPHABETS.index(_ALPHABET[c])) + "_" for c, f in zip(low, fixed, strict=True))
    sets = [_ALPHABET[c] for c, f in zip(low, fixed, strict=True) if not f]
    n = 1
    for s in sets:
        n *= len(s)
    if n < 2:
        return text
    perm = Permutation(key, n, form.encode())
    x = 0
    for c, s in zip((c for c, f in zip(low, fixed, strict=True) if not f), sets, strict=True):
        x = x * len(s) + s.index(c)
    wanted = ok(low) if ok else None
    while True:
        x = perm.shift(x)
        y, chars = x, []
        for s in reversed(sets):
            y, r = divmod(y, len(s))
            chars.append(s[r])
        it = iter(reversed(chars))
        out = "".join(c if f else next(it) for c, f in zip(low, fixed, strict=True))
        if ok is None or ok(out) == wanted:
            return "".join(o.upper() if c != lo else o for o, c, lo in zip(out, text, low, strict=True))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_rest(text: str) -> int:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The surrogate of an entity; a function of its characters without separators and case."""
    if kind == "email":
        local, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return permute_text(f"{local}@{host}", key, kind) + "." + top
    if kind == "ip":
        number = 0
        for part in text.split("."):
            number = number << 8 | int(part)
        span = lambda n: (n >> 24 == 10, n >> 20 == 0xAC1, n >> 16 == 0xC0A8, n >> 24 == 127, n >> 28 >= 14, n >> 24 == 0)
        perm, want = Permutation(key, 1 << 32, b"ip"), span(number)
        number = perm.shift(number)
        while span(number) != want:
            number = perm.shift(number)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = _digits(text)
        body = permute_text(digits[1:-1], key, f"card{digits[0]}")
        rest = _luhn(digits)
        last = next(d for d in "0123456789" if _luhn(digits[0] + body + d) == rest)
        return _refill(text, digits[0] + body + last)
    if kind == "phone":
        digits = _digits(text)
        code = "" if not text.startswith("+") else digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in _CODES else digits[:3]
        sound = lambda d: tuple(d[i : i + 1] in "01" for i in (0, 3)) if len(d) == 10 else d[:1] == "0"
        # ten digits without a code are a North American number
        return _refill(text, code + permute_text(digits[len(code) :], key, f"phone{code or ('1' if len(digits) == 10 else '')}", ok=sound))
    if kind == "ssn":
        return _refill(text, permute_text(_digits(text), key, kind, ok=lambda d: (d[:3] in ("000", "666") or d[0] == "9", d[3:5] == "00", d[5:] == "0000")))
    if kind == "iban":
        plain = text.replace(" ", "")
        body = permute_text(plain[4:], key, f"iban{plain[:2]}")
        check = 98 - _iban_rest(plain[:2] + "00" + body)
        if _iban_rest(plain) != 1:
            return text[:4] + _like(text[4:], body)
        return plain[:2] + f"{check:02d}" + _like(text[4:], body)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]{8,}", text) and any(c.isalpha() for c in text):
        return f"{Permutation(key, 16 ** len(text), b'hex').shift(int(text, 16)):0{len(text)}x}"
    if kind == "ipv6":
        number = int(ipaddress.IPv6Address(text))
        rest = (1 << 112) - 1  # the first group tells what kind of address it is
        new = str(ipaddress.IPv6Address(number & ~rest | Permutation(key, 1 << 112, b"ipv6").shift(number & rest)))
        return new.upper() if text.upper() == text else new
    if kind == "name":
        return "".join(_name_part(role, word, key) for role, word in _parts(text))
    return permute_text(text, key, kind)


def _like(text: str, chars: str) -> str:
    it = iter(chars)
    return "".join(c if c == " " else next(it) for c in text)


def _parts(name: str) -> list[tuple[str, str]]:
    """The words of a name with their roles, and what is between them."""
    words = re.split(r"( )", name)
    last = len(words) - 1
    out = []
    for k, w in enumerate(words):
        if w == " " or w.rstrip(".") in _TITLED or len(w.rstrip(".")) == 1:
            out.append(("", w))
        else:
            out.append(("given" if k < last or w in _KIND and last == 0 else "family", w))
    return out


def _name_part(role: str, word: str, key: bytes) -> str:
    """Surrogate of a word of a name. Listed given names change within their list, other words among unlisted ones."""
    if not role:
        return word if len(word) != 2 or word[1] != "." else permute_text(word, key, "initial")
    if any("\u4e00" <= c <= "\u9fff" for c in word):
        return "".join(chr(0x4E00 + Permutation(key, 0x5200, b"han").shift(ord(c) - 0x4E00)) for c in word)
    head, dash, tail = word.partition("-")
    if role == "given" and head in _KIND:
        (script, gender), at = _KIND[head]
        names = _GIVEN[script, gender]
        new = names[Permutation(key, len(names), f"{script}{gender}".encode()).shift(at)]
        return new + dash + (_name_part(role, tail, key) if dash else "")
    return permute_text(word, key, "word", ok=lambda w: w.title() in _KIND)


def _names(text: str, free: Callable[[int, int], bool], starts: set[int]) -> list[tuple[int, int]]:
    """Places of names: runs of capitalised words with something that says person, then their parts alone."""
    found: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        words = [(a + w.start(), a + w.end(), w[0]) for w in re.finditer(r"\S+", m[0])]
        k = 0
        while k < len(words):
            word = words[k][2]
            titled = word.rstrip(".") in _TITLED
            rest = words[k + 1 :] if titled else words[k:]
            told = titled and bool(rest) and len(rest[0][2].rstrip(".")) > 1
            told |= len(rest) > 1 and word.partition("-")[0] in _KIND
            if not told and len(rest) > 1 and len(word) > 1:
                told = k > 0 and words[k - 1][2].lower() in _INTRO_WORDS or k == 0 and bool(_INTRO.search(text, max(0, a - 24), a)) or len(rest) == 2 and any(x in starts and not text[b:x].strip(" ,(<:") for x in range(b + 1, b + 4))
            if not told:
                k += 1
                continue
            n = 1
            while n < len(rest) and n < 3 and (n < 2 or len(rest[n - 1][2].rstrip(".")) == 1):
                n += 1
            start, end = rest[0][0], rest[n - 1][1]
            if free(start, end):
                found.append((start, end))
            k += n + titled
    found += [m.span(1) for m in _HAN.finditer(text) if free(*m.span(1))] if "先" in text or "女" in text or "小" in text or "太" in text else []
    parts = {w for a, b in found for role, w in _parts(text[a:b]) if role and len(w) > 2}
    if parts:
        whole = sorted(found)
        at = 0
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + r")(?![^\W_])", text):
            while at < len(whole) and whole[at][1] <= m.start():
                at += 1
            if (at == len(whole) or whole[at][0] >= m.end()) and free(*m.span()):
                found.append(m.span())
    return found


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, not overlapping: at a place the longest of the first kind in the order below."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))  # a mark for each character

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def add(pattern: re.Pattern, kind: str, group: int = 0, test: Callable[[str], bool] | None = None) -> None:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if (test is None or test(m[group])) and free(a, b):
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind))

    if "@" in text:
        add(_EMAIL, "email")
    if "=" in text or ":" in text:
        add(_NAMED_SECRET, "secret", 1, lambda s: any(c.isdigit() for c in s))
    if any(d in text for d in "0123456789"):
        add(_SECRET, "secret")
        add(_IBAN, "iban", test=lambda s: _iban_rest(s) == 1)
        add(_CARD, "card")
        add(_IP, "ip")
        if "::" in text or text.count(":") > 6:
            add(_IPV6, "ipv6", test=_is_ipv6)
        add(_SSN, "ssn")
        add(_PHONE, "phone", test=lambda s: 8 <= len(_digits(s)) <= 15)
    found += [(a, b, "name") for a, b in _names(text, free, {a for a, _, k in found if k in ("email", "phone")})]
    return sorted(found)


def _is_ipv6(text: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(text)) > 1 and any(c.isdigit() for c in text)
    except ValueError:
        return False


def _canonical(kind: str, text: str) -> str:
    """What an entity is, however it is written."""
    return {"ipv6": lambda: ipaddress.IPv6Address(text).exploded, "phone": lambda: _digits(text)[-10:], "card": lambda: _digits(text), "iban": lambda: text.replace(" ", "")}.get(kind, lambda: text)()


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' places in the original. Two entities of a document never share a
    surrogate: words, digits and addresses are permuted, and each surrogate is checked against those of the others."""
    spans = entities(text)
    if not spans:
        return text, spans
    made: dict[tuple[str, str], str] = {}
    owner: dict[tuple[str, str], str] = {}
    out, last = [], 0
    for a, b, kind in spans:
        raw = text[a:b]
        if (kind, raw) not in made:
            own, new = _canonical(kind, raw), surrogate(kind, raw, key)
            while owner.setdefault((kind, new), own) != own:  # cannot be by the permutations; else on to the next
                new = surrogate(kind, new, key)
            made[kind, raw] = new
        out += [text[last:a], made[kind, raw]]
        last = b
    return "".join(out) + text[last:], spans


def redact(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus n_entities and entity_kinds (kinds with counts, by name).

    All other columns stay (columns of those two names are replaced). Null texts stay null with 0 entities, texts
    without entities are unchanged, repeated rows are treated alike, an empty table gives one. Long texts take time in
    proportion to their length.
    """
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    slim = docs.select(*rest, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                new, spans = (None, []) if text is None else replace(text, key)
                texts.append(new)
                counts.append(len(spans))
                by = [k for _, _, k in spans]
                kinds.append(",".join(f"{k}:{by.count(k)}" for k in sorted(set(by))))
            made = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64()), "entity_kinds": pa.array(kinds, pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) if c in made else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return slim.mapInArrow(apply, slim.schema)
