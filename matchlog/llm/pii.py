"""Surrogates for personal data: keyed, of the same type, gender, script and format.

An entity is replaced by a keyed permutation of its own shape: digits become digits, vowels
vowels and consonants consonants of the same script, hexadecimal digits the like; separators,
case and length stay. Being a permutation, it gives different entities different surrogates
(distinctness) and an entity the same surrogate in every document (coreference), without any
table, shuffle or shared state. Numbers with check digits get valid ones. Results that aren't
valid, or would be another entity's kind, are permuted again (cycle walking keeps that one to
one). First names from the name lists are permuted within list, that is gender and script;
other mentions of a person's names in the same document follow. ``collisions`` checks the
whole corpus: surrogates that two entities of a kind share, of which there should be none.

Formats of one entity have one canonical form: an e-mail address without case, a telephone
number's digits without the +1, a card's digits, a name without case.

Null and empty texts stay as they are. Each row is replaced on its own; identifiers play no
part. The key decides the surrogates; keep it as secret as the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: First names by (gender, script), plain examples.
NAMES = {
    ("f", "latin"): "Alice Amelia Anna Barbara Beatrice Camille Carmen Caroline Charlotte Clara Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jessica Julia Karen Katherine Laura Lena Linda Lucia Margaret Maria Marie Martha Mary Nancy Olivia Patricia Sarah Sofia Sophie Susan Teresa Victoria".split(),
    ("m", "latin"): "Albert Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Edward Francois Frank George Hans Henry Jack Jacques James Javier John Jonathan Joseph Juan Klaus Louis Luis Michael Miguel Oliver Paul Peter Pierre Richard Robert Stefan Thomas Walter William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Мария Надежда Наталья Ольга Полина Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Михаил Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Μιχάλης Νίκος Παναγιώτης Σπύρος".split(),
}
#: Forms of address.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra господин госпожа κύριος κυρία".split()
#: Letters a letter may become, by script and sound.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ"]
DIGITS = "0123456789"
HEX = "0123456789abcdef"


class Permutation:
    """A keyed one-to-one map of strings onto strings of the same shape."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _number(self, data: bytes, size: int) -> int:
        width = (size.bit_length() + 64 + 7) // 8
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(data + len(out).to_bytes(4, "big"), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:width], "big") % size

    def digits(self, kind: str, values: list[int], sizes: list[int]) -> list[int]:
        """A balanced Feistel network over mixed-radix numbers; one place alone is shifted."""
        half = (len(sizes) + 1) // 2
        parts = []
        for a, b in ((0, half), (half, len(sizes))):
            number, size = 0, 1
            for value, base in zip(values[a:b], sizes[a:b], strict=True):
                number, size = number * base + value, size * base
            parts.append([number, size])
        shape = f"{kind}:{sizes}:".encode()
        if parts[1][1] == 1:
            parts[0][0] = (parts[0][0] + 1 + self._number(shape, max(1, parts[0][1] - 1))) % parts[0][1]
        else:
            for k in range(self.rounds):
                one, other = parts[k % 2], parts[1 - k % 2]
                one[0] = (one[0] + self._number(shape + f"{k}:{other[0]}".encode(), one[1])) % one[1]
        out: list[int] = []
        for (number, _), (a, b) in zip(parts, ((0, half), (half, len(sizes))), strict=True):
            own = []
            for base in reversed(sizes[a:b]):
                number, value = divmod(number, base)
                own.append(value)
            out += own[::-1]
        return out

    def text(self, kind: str, text: str, alphabets: list[str]) -> str:
        """Letters within their alphabet, other characters as they are."""
        places = [(i, next((a for a in alphabets if c in a), None)) for i, c in enumerate(text)]
        places = [(i, a) for i, a in places if a]
        if not places:
            return text
        moved = {i for i, _ in places}
        fixed = "".join("." if i in moved else c for i, c in enumerate(text))
        new = self.digits(f"{kind}|{fixed}", [a.index(text[i]) for i, a in places], [len(a) for _, a in places])
        out = list(text)
        for (i, alphabet), value in zip(places, new, strict=True):
            out[i] = alphabet[value]
        return "".join(out)

    def walk(self, step: Callable[[str], str], text: str, valid: Callable[[str], bool]) -> str:
        """Applies the step until the result is valid; one to one on valid texts."""
        out = step(text)
        while not valid(out) and out != text:
            out = step(out)
        return out


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0


def issued(digits: str) -> bool:
    """Whether card numbers start so."""
    return digits[0] in "3456" or "22" <= digits[:2] <= "27"


def ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def iban_valid(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _octets(text: str) -> bool:
    parts = text.split(".")
    return all(len(p) == 1 or p[0] != "0" for p in parts) and all(int(p) < 256 for p in parts)


WORD = "[^\\W\\d_]"
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}")
SECRET = re.compile(r"(?i)(?:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)([A-Za-z0-9_\-/+]{16,200})|\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9\-]{20,100})\b")
# a pattern that starts with a set of characters is found faster than one that starts with
# a look-behind, so that comes second
IBAN = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"\d(?<![\w.+(]\d)(?:\d{12,18}|\d{3}(?:[ \-]\d{2,6}){2,4})(?!\w)")
SSN = re.compile(r"\d(?<![\w\-]\d)\d\d-\d{2}-\d{4}(?![\w\-])")
IP = re.compile(r"\d(?<![\w.]\d)\d{0,2}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
CAPITALS = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ"
CAPITAL = re.compile(rf"[{CAPITALS}](?<!\w[{CAPITALS}]){WORD}{{1,30}}(?!\w)")
INITIALS = "".join(sorted({t[0] for t in TITLES}))
ADDRESS = re.compile(rf"[{INITIALS}](?<!\w[{INITIALS}]){WORD}{{1,8}}")
ENDINGS, ADDRESSES = tuple(TITLES), frozenset(TITLES)
SECRET_WORDS = ("token", "secret", "passw", "api_key", "api-key", "apikey", "access")
SECRET_HEADS = ("AKIA", "ASIA", "gh", "sk-")
TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?[ ]$")
PHONE_SHAPES = re.compile(r"\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}|\+\d{8,14}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}")


class Surrogates:
    """Detects entities in a text and replaces them."""

    def __init__(self, key: bytes):
        self.map = Permutation(key)
        self.first = {name.lower(): group for group, names in NAMES.items() for name in names}
        self.known: dict[tuple[str, str], str] = {}

    # --- detection

    def entities(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, canonical form), in order, without overlaps."""
        found: list[tuple[int, int, str, str]] = []

        def add(start: int, end: int, kind: str, canonical: str) -> None:
            found.append((start, end, kind, canonical))

        if "@" in text:
            for m in EMAIL.finditer(text):
                add(m.start(), m.end(), "email", m[0].lower())
        lower = text.lower()
        for m in SECRET.finditer(text) if any(w in lower for w in SECRET_WORDS) or any(h in text for h in SECRET_HEADS) else ():
            group = 1 if m[1] else 2
            add(m.start(group), m.end(group), "secret", m[group])
        if re.search(r"\d", text):
            for m in IBAN.finditer(text):
                if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and iban_valid(plain):
                    add(m.start(), m.end(), "iban", plain)
            for m in SSN.finditer(text):
                if ssn(m[0]):
                    add(m.start(), m.end(), "ssn", m[0])
            for m in IP.finditer(text):
                if _octets(m[0]):
                    add(m.start(), m.end(), "ip", m[0])
            for m in CARD.finditer(text):
                digits = re.sub(r"\D", "", m[0])
                if 13 <= len(digits) <= 19 and issued(digits) and luhn(digits):
                    add(m.start(), m.end(), "card", digits)
            for m in PHONE_SHAPES.finditer(text):
                before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                digits = re.sub(r"\D", "", m[0])
                if 8 <= len(digits) <= 15 and not before.isalnum() and not after.isalnum():
                    add(m.start(), m.end(), "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits)
        self._names(text, add)
        found.sort(key=lambda e: (e[0], -e[1]))
        out, end = [], 0
        for entity in found:
            if entity[0] >= end:
                out.append(entity)
                end = entity[1]
        return out

    def _names(self, text: str, add: Callable[[int, int, str, str], None]) -> None:
        if self.first.keys().isdisjoint({w.lower() for w in CAPITAL.findall(text)}) and ADDRESSES.isdisjoint(ADDRESS.findall(text)):
            return
        words = [(m.start(), m.end(), m[0]) for m in CAPITAL.finditer(text)]
        people: dict[str, str] = {}
        for k, (start, end, word) in enumerate(words):
            before = text[max(0, start - 12) : start]
            titled = before.rstrip(" .").endswith(ENDINGS) and TITLE.search(before) is not None
            following = words[k + 1] if k + 1 < len(words) and text[end : words[k + 1][0]] == " " else None
            group = self.first.get(word.lower())
            if group and (titled or following):
                people[word.lower()] = "first:" + ":".join(group)
                if following and following[2].lower() not in self.first:
                    people[following[2].lower()] = "name"
            elif titled and word not in TITLES:
                people[word.lower()] = "name"
                if following and following[2] not in TITLES:
                    people[following[2].lower()] = "name"
        for start, end, word in words if people else ():
            if kind := people.get(word.lower()):
                add(start, end, kind, word.lower())

    # --- replacement

    def canonical(self, kind: str, entity: str) -> str:
        """The surrogate of a canonical form, in canonical form."""
        found = self.known.get((kind, entity))
        if found is None:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            found = self.known[kind, entity] = self._made(kind, entity)
        return found

    def _made(self, kind: str, entity: str) -> str:
        letters, p = ALPHABETS, self.map
        if kind == "email":
            local, domain = entity.split("@")
            labels, top = domain.rsplit(".", 1)
            done = p.text("email", f"{local}@{labels}", [*letters, DIGITS])
            return f"{done}.{top}"
        if kind == "secret":
            head, is_hex = secret_class(entity)
            alphabets = [HEX] if is_hex else [DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
            made = lambda t: head + p.text("secret" + head, t[len(head) :], alphabets)
            return p.walk(made, entity, lambda t: secret_class(t) == (head, is_hex))
        if kind == "card":
            check = lambda body: body + next(d for d in DIGITS if luhn(body + d))
            return p.walk(lambda t: check(t[0] + p.text("card" + t[0], t[1:-1], [DIGITS])), entity, issued)
        if kind == "iban":
            body = p.text("iban" + entity[:2], entity[4:], [DIGITS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
            check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
            return f"{entity[:2]}{check:02d}{body}"
        if kind == "ssn":
            return p.walk(lambda t: p.text("ssn", t, [DIGITS]), entity, ssn)
        if kind == "ip":
            parts = entity.split(".")  # an octet keeps its number of digits
            least = [0 if len(o) == 1 else 10 ** (len(o) - 1) for o in parts]
            sizes = [{1: 10, 2: 90, 3: 156}[len(o)] for o in parts]
            new = p.digits("ip", [int(o) - n for o, n in zip(parts, least, strict=True)], sizes)
            return ".".join(str(x + n) for x, n in zip(new, least, strict=True))
        if kind == "phone":
            if len(entity) == 10:  # area codes and exchanges that start with 2 to 9 stay so, others too
                fine = lambda t: (t[0] < "2", t[3] < "2") == (entity[0] < "2", entity[3] < "2")
                return p.walk(lambda t: p.text("phone", t, [DIGITS]), entity, fine)
            return entity[:2] + p.text("phone" + entity[:2], entity[2:], [DIGITS])
        if kind.startswith("first:"):
            names = sorted(n.lower() for n in NAMES[tuple(kind.split(":")[1:])])
            order = sorted(names, key=lambda n: self.map._number(f"{kind}:{n}".encode(), 1 << 64))
            return order[(order.index(entity) + 1) % len(order)]  # a cycle: no name stays
        return p.walk(lambda t: p.text("name", t, letters), entity, lambda t: t not in self.first)

    def fitted(self, original: str, kind: str, entity: str) -> str:
        """The surrogate in the original's format: its separators and its case."""
        new = self.canonical(kind, entity)
        if kind in ("card", "phone", "iban"):
            kept = [c for c in original if c.isalnum()]
            lead = len(kept) - len(new)
            fill = iter("".join(kept[:lead]) + new)
            return "".join(next(fill) if c.isalnum() else c for c in original)
        if kind == "secret" or len(new) != len(original) and not kind.startswith("first:"):
            return new
        if kind.startswith("first:") or kind == "name":
            return new.upper() if original.isupper() and len(original) > 1 else new[:1].upper() + new[1:]
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, original, strict=True))

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, canonical form, surrogate) of each entity."""
        out, done, end = [], [], 0
        for start, stop, kind, entity in self.entities(text):
            new = self.fitted(text[start:stop], kind, entity)
            out += [text[end:start], new]
            end = stop
            done.append((kind, entity, self.canonical(kind, entity)))
        return "".join([*out, text[end:]]) if out else text, done


def secret_class(secret: str) -> tuple[str, bool]:
    """(known beginning, whether it is hexadecimal): a surrogate is of the same class."""
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", secret)
    return head[0] if head else "", bool(re.fullmatch("[0-9a-f]+", secret))


def checked_key(docs: DataFrame, key: bytes, value: str = "text", attempts: int = 8) -> bytes:
    """The key, or the first one derived from it, under which no two entities of ``docs`` share
    a surrogate and none is its own. All entities of all texts are compared, by their distinct
    (kind, surrogate); one key for all keeps mentions of an entity alike."""
    for attempt in range(attempts):
        tried = key if not attempt else hashlib.blake2b(attempt.to_bytes(4, "little"), key=key[:64]).digest()
        if collisions(entities(docs, tried, value)).isEmpty():
            return tried
    raise ValueError(f"entities still share surrogates after {attempts} keys")


def replace(docs: DataFrame, key: bytes, value: str = "text") -> DataFrame:
    """Every column of ``docs``, the texts with surrogates, and n_entities and kinds (array of
    distinct kinds); columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(key)
    kept = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    docs = docs.select([F.col(f"`{c}`") for c in kept])
    at = kept.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = [maker.replace(t) if t else (t, []) for t in batch.column(at).to_pylist()]
                columns = [*batch.columns, pa.array([len(e) for _, e in found], pa.int64()), pa.array([sorted({k.split(":")[0] for k, _, _ in e}) for _, e in found], pa.list_(pa.string()))]
                columns[at] = pa.array([t for t, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_entities", "kinds"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("n_entities", "long").add("kinds", ArrayType(StringType())))


def entities(docs: DataFrame, key: bytes, value: str = "text") -> DataFrame:
    """(kind, entity, surrogate) of every mention, in canonical forms."""
    shared = docs.sparkSession.sparkContext.broadcast(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(shared.value)
        for batch in batches:
            rows = [e for t in batch.column(0).to_pylist() if t for e in maker.replace(t)[1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "entity", "surrogate"])

    return docs.select(F.col(f"`{value}`").alias("text")).mapInArrow(run, "kind string, entity string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, entities): surrogates that more than one entity of a kind has, or
    that are the entity itself."""
    distinct = found.distinct()
    own = F.sum(F.when(F.col("entity") == F.col("surrogate"), 1).otherwise(0))
    return distinct.groupBy("kind", "surrogate").agg(F.count("*").alias("entities"), own.alias("same")).filter("entities > 1 or same > 0")
