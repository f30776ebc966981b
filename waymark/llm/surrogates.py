"""PII surrogates: keyed, type-consistent replacements that keep gender, script and format."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import forget, in_arrow, stored

#: Given names by (script, gender).
NAMES = {
    ("latin", "f"): "Alice Anna Carla Claire Diana Elena Emma Eva Grace Hanna Helen Ines Irene Julia Karen Laura Lena Linda Lucia Maria Marta Mary Nina Olivia Paula Petra Rosa Sara Sofia Susan Teresa Vera".split(),
    ("latin", "m"): "Adam Andrew Bruno Carlos Daniel David Emil Erik Felix Frank Hans Hugo Ivan James John Jorge Karl Louis Luis Mark Martin Max Miguel Oscar Otto Paul Peter Pierre Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Полина Раиса София Татьяна Ульяна Юлия".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Юрий".split(),
}
_WHERE = {name: (k, i) for k, v in NAMES.items() for i, name in enumerate(v)}
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()

#: The characters of a class are permuted among themselves; Han characters, by code point, are one more.
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ"]
_CLASS = {c: k for k, x in enumerate(_CLASSES) for c in x}
_HAN, _HAN_FROM, _HAN_SIZE = len(_CLASSES), 0x4E00, 0x9FA6 - 0x4E00


def _place(c: str) -> tuple[int, int, int] | None:
    """The class of a character, its place there and the size of the class."""
    if c in _CLASS:
        return _CLASS[c], _CLASSES[_CLASS[c]].index(c), len(_CLASSES[_CLASS[c]])
    at = ord(c) - _HAN_FROM
    return (_HAN, at, _HAN_SIZE) if 0 <= at < _HAN_SIZE else None


def _char(kind: int, at: int) -> str:
    return chr(_HAN_FROM + at) if kind == _HAN else _CLASSES[kind][at]


# Country calling codes of one and of two digits; all others have three.
_CALLING = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\\d{1,3}")

_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_WORD = f"[{_UPPER}][\\w'’-]+"
#: What a full name follows: a field of a form, or a sentence that gives one.
_INTROS = "Name:|Full name:|Patient:|Author:|Contact:|Signed:|Signed by|Yours sincerely,|[Mm]y name is|[Hh]is name is|[Hh]er name is|named|Имя:|ФИО:|[Мм]еня зовут|Nombre:|Nom :|Name ist|Mein Name ist|Όνομα:".split("|")
_PARTICLES = "van|von|de|del|der|la|di|da|al|bin"
_FINDERS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"[^\W_](?:[\w.+%-]*[\w+%-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}|(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)[^\s\"',;]{6,}|\b(?=[0-9a-f]*\d)[0-9a-f]{32,64}\b")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.]*[\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:(?![\w:])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)")),
    ("han", re.compile(r"(?<=姓名[:：])\s*[\u4e00-\u9fa5]{2,4}")),
    ("named", re.compile(rf"(?<!\w)(?:{'|'.join(_INTROS)})[ \t]+({_WORD}(?: (?:{_PARTICLES}|{_WORD})){{1,3}})(?!\w)")),
    ("name", re.compile(rf"\b(?:(?:{'|'.join(_TITLES)})\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(_WHERE)}) {_WORD})(?!\w)")),
]
_DIGITS, _WORDS = re.compile(r"\d"), re.compile(r"\w+")
_STARTS = {*_TITLES, *_WHERE}
_SAID = re.compile("|".join(_INTROS))
_WEIGHT = {c: k for k, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
_LABEL = re.compile(r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)|(?:AKIA|ASIA)|(?:ghp|gho|sk|pk|xox[abp])[_-]")


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, type), earlier finders first where they overlap."""
    digits, mail = _DIGITS.search(text), "@" in text
    label, names = _LABEL.search(text), not _STARTS.isdisjoint(_WORDS.findall(text))
    needs = {"email": mail, "secret": digits or label, "name": names, "named": _SAID.search(text), "han": "姓名" in text, "ip6": ":" in text}
    found: list[tuple[int, int, str]] = []
    said: set[str] = set()
    for kind, pattern in _FINDERS:  # what an entity of the type can't do without comes first: most texts have none of it
        if not needs.get(kind, digits):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "secret" and (label := _LABEL.match(m.group())):
                start += label.end()
            if kind == "name":
                start += next((len(t) for t in re.findall(rf"^(?:{'|'.join(_TITLES)})\.? ", m.group())), 0)
            if kind == "named":
                start, end = m.span(1)
                said.add(m[1])
            if kind == "han":
                start += len(m.group()) - len(m.group().lstrip())
                said.add(text[start:end])
            if kind == "ip6" and not _is_ip6(m.group()):
                continue
            if not any(a < end and start < b for a, b, _ in found):
                found.append((start, end, "name" if kind in ("named", "han") else "ip" if kind == "ip6" else kind))
    for name in said:  # a name once given is one wherever it stands
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b, _ in found):
                found.append((m.start(), m.end(), "name"))
    return sorted(found)


def _is_ip6(value: str) -> bool:
    try:
        return len(value) > 5 and bool(re.search(r"\d", value)) and isinstance(ipaddress.ip_address(value), ipaddress.IPv6Address)
    except ValueError:
        return False


def _iban_check(country: str, account: str) -> str:
    """The two check digits of an account (ISO 7064, 97-10)."""
    number = int("".join(str(_WEIGHT[c]) for c in f"{account}{country}00"))
    return f"{98 - number % 97:02d}"


def _cipher(key: bytes, tweak: str, size: int) -> tuple[Callable[[int], int], Callable[[int], int]]:
    """A keyed permutation of range(size) and its inverse: a Feistel network, walked until it lands in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(k: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{k}|{x}".encode(), key=key, digest_size=(half + 7) // 8).digest(), "big") & mask

    def forth(x: int) -> int:
        while True:
            a, b = x >> half, x & mask
            for k in range(8):
                a, b = b, a ^ f(k, b)
            x = a << half | b
            if x < size:
                return x

    def back(x: int) -> int:
        while True:
            a, b = x >> half, x & mask
            for k in reversed(range(8)):
                a, b = b ^ f(k, a), a
            x = a << half | b
            if x < size:
                return x

    return forth, back


def _next(key: bytes, tweak: str, x: int, size: int) -> int:
    """The place after x on a keyed cycle through range(size): one to one, and never x itself."""
    forth, back = _cipher(key, tweak, size)
    return back((forth(x) + 1) % size)


def _permuted(key: bytes, tweak: str, value: str) -> str:
    """value with each letter and digit exchanged within its class; one to one among values of the same shape."""
    low = value.lower()
    found = [(i, p) for i, c in enumerate(low) if len(low) == len(value) and (p := _place(c))]
    if not found:
        return value
    x = 0
    for _, (_, at, size) in found:
        x = x * size + at
    kinds = {i: p[0] for i, p in found}
    shape = "".join(f"{kinds[i]}" if i in kinds else c for i, c in enumerate(low))
    x = _next(key, f"{tweak}|{shape}", x, prod(p[2] for _, p in found))
    out = list(low)
    for i, (kind, _, size) in reversed(found):
        out[i] = _char(kind, x % size)
        x //= size
    return "".join(out)


def _cased(like: str, value: str) -> str:
    return "".join(v.upper() if c.isupper() else v for c, v in zip(like, value, strict=True)) if len(like) == len(value) else value


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return "+" * value.startswith("+") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ipaddress.ip_address(value).exploded if ":" in value else ".".join(str(int(x)) for x in value.split("."))
    return value.lower() if kind == "email" else value


def _digits_like(value: str, digits: str, skip: int = 0) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _spaced_like(value: str, plain: str) -> str:
    it = iter(plain)
    return "".join(c if c == " " else next(it) for c in value)


def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The replacement of one mention, in its own format. Different entities of a type get different ones."""
    tweak = f"{kind}|{turn}"
    own = canonical(kind, value)
    if kind == "card":
        valid = _luhn(own)
        if valid:  # the check digit follows from the others
            head = own[0] + _permuted(key, f"{tweak}|luhn|{own[0]}", own[1:-1])
            return _digits_like(value, head + next(d for d in "0123456789" if _luhn(head + d)))
        out = own
        while out == own or _luhn(out):  # the first digit, the kind of card, stays
            out = own[0] + _permuted(key, f"{tweak}|{own[0]}", out[1:])
        return _digits_like(value, out)
    if kind in ("phone", "ssn"):
        own, abroad = own.removeprefix("+"), own.startswith("+")
        n = len(_CALLING.match(own)[0]) if abroad else 0
        tweak += "|+" * abroad
        return _digits_like(value, own[:n] + _permuted(key, f"{tweak}|{own[:n]}", own[n:]))
    if kind == "ip" and ":" in own:
        new = ipaddress.ip_address(_next(key, tweak + "|6", int(ipaddress.ip_address(own)), 1 << 128))
        text = new.exploded if "::" not in value and len(value) == len(own) else str(new)
        return text.upper() if value.upper() == value else text
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, own.split("."))), "big")
        return ".".join(map(str, _next(key, tweak, x, 1 << 32).to_bytes(4, "big")))
    if kind == "email":
        local, _, domain = own.partition("@")
        name, dot, top = domain.rpartition(".")
        return _cased(value, f"{_permuted(key, tweak, local)}@{_permuted(key, tweak + '|domain', name)}{dot}{top}")
    if kind == "name":
        return " ".join(_name(key, tweak, x) for x in value.split(" "))
    if kind == "secret" and re.fullmatch(r"[0-9a-f]{2,}", value):
        return f"{_next(key, f'{tweak}|hex{len(value)}', int(value, 16), 16 ** len(value)):0{len(value)}x}"
    if kind == "iban":
        country, check, account = own[:2], own[2:4], own[4:]
        if check == _iban_check(country, account):  # the check digits follow from the others
            account = _permuted(key, f"{tweak}|valid|{country}", account).upper()
            return _spaced_like(value, country + _iban_check(country, account) + account)
        out = own
        while out == own or out[2:4] == _iban_check(country, out[4:]):
            out = country + _permuted(key, f"{tweak}|{country}", out[2:]).upper()
        return _spaced_like(value, out)
    return _cased(value, _permuted(key, tweak + "|" + "".join("A" if c.isupper() else "a" for c in value), value))


def _name(key: bytes, tweak: str, word: str) -> str:
    if word in _WHERE:
        (script, gender), i = _WHERE[word]
        pool = NAMES[script, gender]
        return pool[_next(key, f"{tweak}|{script}|{gender}", i, len(pool))]
    ending = re.search(r"(?:ова|ева|ина|ая|ский|ская|ов|ев)$", word)  # shows the gender
    stem, end = (word[: ending.start()], ending[0]) if ending and ending.start() else (word, "")
    out = _cased(stem, _permuted(key, f"{tweak}|{end}", stem)) + end
    return out if out not in _WHERE else _name(key, tweak, out)  # never a given name: those are taken


def _scan(key: bytes, turn: int) -> Callable[[str], tuple[str, list[tuple[str, str, str]]]]:
    def apply(text: str) -> tuple[str, list[tuple[str, str, str]]]:
        out, at, seen = [], 0, []
        for a, b, kind in find(text):
            new = surrogate(kind, text[a:b], key, turn)
            seen.append((kind, canonical(kind, text[a:b]), canonical(kind, new)))
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), seen

    return apply


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _replaced(docs: DataFrame, key: bytes, turn: int) -> DataFrame:
    """doc_id, text, n_entities, types and the (type, entity, surrogate) of each row."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = _scan(key, turn)
        for rb in batches:
            done = [(None, []) if t is None else apply(t) for t in rb.column(1).to_pylist()]
            seen = [[dict(zip(("type", "entity", "surrogate"), x, strict=True)) for x in sorted(set(s))] for _, s in done]
            kind = pa.list_(pa.struct([(c, pa.string()) for c in ("type", "entity", "surrogate")]))
            columns = [pa.array([x[0] for x in done], pa.string()), pa.array([len(x[1]) for x in done], pa.int64()), pa.array([",".join(sorted({y[0] for y in x[1]})) for x in done], pa.string()), pa.array(seen, kind)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *columns], ["doc_id", "text", "n_entities", "types", "found"])

    return _rows(docs).transform(in_arrow, out, "doc_id long, text string, n_entities long, types string, found array<struct<type: string, entity: string, surrogate: string>>")


def entities(replaced: DataFrame) -> DataFrame:
    """Distinct (type, entity, surrogate) of a corpus."""
    return replaced.select(F.inline("found")).distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that several entities of a type would share."""
    return found.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def splits(found: DataFrame) -> DataFrame:
    """Entities with several surrogates, whose mentions would come apart."""
    return found.groupBy("type", "entity").agg(F.count("*").alias("n")).where("n > 1")


def replace(docs: DataFrame, key: str, turns: int = 8) -> DataFrame:
    """doc_id, text with every detected entity replaced, n_entities, types (sorted names of the types found).

    Types: e-mail, secrets, IP (both versions), IBAN, SSN, phone, card and
    person names: after a title, with a known given name, or where a text gives
    one ("Name:", "my name is" and the like), and then wherever that text has it. A
    replacement depends on the key and the entity alone, so mentions of one
    entity stay one; it is a permutation within the entity's shape, so
    different entities stay different. An IBAN or phone is exchanged in its plain
    form and laid back into the mention's format. Both are checked over all
    entities of the corpus: one with several surrogates is an error; should two
    entities meet, all are drawn again with the next turn, and after `turns`
    draws it is an error. A phone with and one without + are two entities. Names keep gender and script, cards and IBANs
    their check digits, phones the country, e-mails the top domain, all their
    punctuation and case. The corpus is scanned once: texts and entities are
    stored together and the texts returned once the entities are checked.

    A null text stays null, an empty one empty; a text of any length is one
    string of a worker. Rows are independent, so a repeated doc_id is no matter.
    doc_id is cast to long (an error where it can't be). Other columns, whatever
    their names, are not carried. An empty table gives no rows.
    """
    secret = hashlib.sha256(key.encode()).digest()
    for turn in range(turns):
        done = stored(_replaced(docs, secret, turn))
        found = stored(entities(done))
        if not splits(found).isEmpty():
            raise RuntimeError("an entity has several surrogates")
        clash = not collisions(found).isEmpty()
        forget(found)
        if not clash:
            return done.select("doc_id", "text", "n_entities", "types")
        forget(done)
    raise RuntimeError("surrogates collide under every turn of this key")
