"""Surrogates for personal data: keyed stand-ins of the same type, format, script and gender.

Entities are found in whole texts, reduced to a normal form, and replaced by a function of a secret
key and that form, so all mentions of an entity in all documents get the same surrogate. Numbers,
addresses and tokens go through a keyed permutation of the strings of their shape; given and family
names are drawn each from lists by gender and script, so full and short mentions agree. A distributed check of the distinct entities makes sure that no
two entities of a type share a surrogate and that no surrogate is itself an entity of the corpus;
those that fail are drawn again, from a space that grows with every draw: names get more syllables,
other surrogates become longer than what they stand for, so every entity settles at any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import ship_with_tasks, written_table

ship_with_tasks(__name__)

# Given names by script and gender, family names by script.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Elena Emma Eva Julia Laura Lena Maria Marta Nina Nora Paula Rosa Sara Sofia Vera",
    ("latin", "m"): "Adam Albert Anton Bruno Daniel David Felix Hugo Jonas Leon Lukas Martin Oscar Paul Peter Simon Tom Victor",
    ("latin", "n"): "Alex Ariel Charlie Jamie Jordan Kim Lou Morgan Noa Robin Sam Sasha Sky Taylor Toni",
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Софья",
    ("cyrillic", "m"): "Антон Борис Иван Максим Олег Павел Пётр Юрий",
    ("cyrillic", "n"): "Женя Саша Валя Слава",
    ("greek", "f"): "Άννα Ελένη Μαρία Σοφία Νίκη",
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Παύλος Άρης",
    ("greek", "n"): "Άλεξ Χάρις",
}
FAMILY = {
    "latin": "Abel Becker Blanco Carter Costa Dubois Fischer Fuentes Garnier Hartman Keller Lambert Marin Moreau Novak Ortiz "
    "Parker Reyes Rossi Sanders Silva Torres Vogel Weber Winter Young",
    "cyrillic": "Белов Волков Громов Зайцев Карпов Лебедев Орлов Соколов",
    "greek": "Ιωάννου Κώστα Μάρκου Νικολάου Παύλου",
}
# Consonants and vowels of further family names by script.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρτ", "αεηιο")}
SAME_SHAPE = 3  # draws of the entity's own length
# Forms of address by gender.
ADDRESS = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "n": ["Mx", "Dr", "Prof"],
}

_GENDER = {form: gender for gender, forms in ADDRESS.items() for form in forms}
_FORMS = "|".join(sorted(_GENDER, key=len, reverse=True))
# All forms of address in a row are one match, with or without a name behind them, and are scanned once.
_NAME = re.compile(
    r"\b({0})\.?[ \t]++(?:(?:{0})\.?[ \t]++)*+(?:(?!(?:{0})\b)([^\W\d_]+(?:-[^\W\d_]+)*"
    r"(?:[ \t]+(?!(?:{0})\b)[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)*)?))?".format(_FORMS)
)
_CAPITALISED = re.compile(r"(?<!\w)[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)*(?!\w)")
_PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\w.])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?!\d)"
)
_IDENTITY = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)")
_ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(
    r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)\b\s*[=:]\s*[\"']?([\w+/=.-]{8,})"
    r"|(?<!\w)((?=[0-9]*[a-f])[0-9a-f]{32,}|(?=[A-Z0-9]*[A-Z])(?:AKIA|ASIA)[A-Z0-9]{16})(?!\w)"
)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = re.compile(r"[\w.%+-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of any length; parts before and behind an @ hold none, so each is looked at once."""
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > 0 and _LOCAL.match(text[begin - 1]):
            begin -= 1
        host = _HOST.match(text, at + 1)
        if begin < at and host:
            yield begin, host.end()
        at = text.find("@", at + 1)


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, type), in order and without overlap; earlier types in the list win."""
    found: list[tuple[int, int, str]] = [(a, b, "email") for a, b in _emails(text)]
    lower = text.lower()
    if any(w in lower for w in ("token", "key", "secret", "passw")) or re.search(r"[0-9a-fA-F]{16}", text):
        for m in _SECRET.finditer(text):
            found.append((*m.span(m.lastindex), "secret"))
    if re.search(r"\d", text):
        kinds = ((_IBAN, "iban"), (_ADDRESS, "address"), (_PHONE, "phone"), (_IDENTITY, "identity"), (_CARD, "card"))
        for pattern, kind in kinds:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    for m in _NAME.finditer(text):
        if m.group(2) and m.group(2)[0].isupper():
            found.append((*m.span(2), f"name-{_GENDER[m.group(1)]}"))
    taken: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if kind == "address" and any(int(p) > 255 for p in text[a:b].split(".")):
            continue
        if not taken or a >= taken[-1][1]:
            taken.append((a, b, kind))
    return taken


def find_mentions(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, type, normal form), with all further mentions of the names found.

    A name behind a form of address, its given and its family name are mentions wherever else the text
    has them as words with a capital. Type name-g with a name of one word stands for a family name, and
    name-g-given with a whole name for its given name alone. A person's gender is what the forms of
    address before the whole name say; those before a family name may be of others who share it.
    """
    found = [(a, b, kind, normal_form(kind, text[a:b])) for a, b, kind in find_entities(text)]
    names = [x for x in found if x[2].startswith("name")]
    if not names:
        return found
    told: dict[str, set[str]] = {}
    for _, _, kind, norm in names:
        told.setdefault(norm, set()).update({kind[-1]} - {"n"})
    people = [norm for norm in told if " " in norm]
    gender = {norm: min(told[norm]) if len(told[norm]) == 1 else "n" for norm in people}
    given: dict[str, str] = {}
    for norm in people:
        given.setdefault(norm.split(" ", 1)[0], norm)
    families = {norm.split(" ", 1)[1] for norm in people} | {norm for norm in told if " " not in norm and norm not in given}

    def short(word: str, own: str = "n") -> tuple[str, str] | None:
        if word in families:
            return f"name-{own}", word
        return (f"name-{gender[given[word]]}-given", given[word]) if word in given else None

    mentions = []
    for a, b, kind, norm in found:
        if norm in gender and kind == "name-n":
            kind = f"name-{gender[norm]}"
        elif kind.startswith("name") and norm not in gender:
            kind, norm = short(norm, kind[-1])
        mentions.append((a, b, kind, norm))
    words, at = [], 0
    for m in _CAPITALISED.finditer(text):
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if at == len(found) or m.end() <= found[at][0]:
            words.append((*m.span(), m.group().casefold()))
    skip = False
    for i, (a, b, word) in enumerate(words):
        if skip:
            skip = False
            continue
        if word in given and i + 1 < len(words) and text[b : words[i + 1][0]].isspace():
            whole = f"{word} {words[i + 1][2]}"
            if whole in gender:
                mentions.append((a, words[i + 1][1], f"name-{gender[whole]}", whole))
                skip = True
                continue
        if short(word):
            mentions.append((a, b, *short(word)))
        elif "-" in word:
            for m in re.finditer(r"[^-]+", text[a:b]):
                if m.group()[0].isupper() and short(m.group().casefold()):
                    mentions.append((a + m.start(), a + m.end(), *short(m.group().casefold())))
    return sorted(mentions)


def normal_form(kind: str, raw: str) -> str:
    """What mentions of one entity have in common: no separators in numbers, no case where it means nothing."""
    if kind in ("phone", "card", "iban", "identity"):
        return re.sub(r"[\s().-]", "", raw)
    if kind.startswith("name"):
        return " ".join(raw.split()).casefold()
    return raw.lower() if kind == "email" or re.fullmatch(r"[0-9a-fA-F]+", raw) else raw


class Keyed:
    """Pseudorandom numbers and permutations under a secret key."""

    def __init__(self, key: bytes):
        self.key = key

    def digits(self, n: int, *parts: object) -> bytes:
        import hashlib
        import hmac

        text, out, turn = "\x1f".join(map(str, parts)).encode(), b"", 0
        while len(out) < 2 * n:
            out += hmac.new(self.key, b"%d:" % turn + text, hashlib.sha256).digest()
            turn += 1
        return out

    def permuted(self, symbols: list[int], bases: list[int], *tweak: object) -> list[int]:
        """Image under a keyed permutation of all sequences with these bases (alternating rounds of added noise)."""
        x, half = list(symbols), (len(symbols) + 1) // 2
        for turn in range(10):
            a, b = (range(half), range(half, len(x))) if turn % 2 else (range(half, len(x)), range(half))
            noise = self.digits(len(b), *tweak, turn, [x[i] for i in a])
            for k, i in enumerate(b):
                x[i] = (x[i] + int.from_bytes(noise[2 * k : 2 * k + 2], "big")) % bases[i]
        return x


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]
_SYMBOLS = "+/=.-_"


@lru_cache(4096)
def _alphabet(c: str) -> str | None:
    """The like of a letter or digit: of other scripts than ASCII, its category within 128 code points."""
    import unicodedata

    if c.isascii() or not c.isalnum():
        return next((a for a in _ALPHABETS if c in a), None)
    block, category = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == category)


def _reshaped(keyed: Keyed, text: str, *tweak: object, hexadecimal: bool = False, symbols: bool = False) -> str:
    """Permute digits, small and capital letters among their like; all else stays.

    With ``symbols``, a text without letters and digits has its other symbols permuted.
    """
    kinds = [_HEX[0] if hexadecimal else _alphabet(c) for c in text]
    if symbols and not any(kinds):
        kinds = [_SYMBOLS if c in _SYMBOLS else None for c in text]
    at = [i for i, a in enumerate(kinds) if a]
    new = keyed.permuted([kinds[i].index(text[i]) for i in at], [len(kinds[i]) for i in at], *tweak)
    out = list(text)
    for i, value in zip(at, new):
        out[i] = kinds[i][value]
    return "".join(out)


def _luhn(digits: str) -> int:
    """Check digit that digits need behind them."""
    doubled = [int(d) * 2 if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _network(parts: list[int]) -> str:
    a, b = parts[:2]
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "loopback" if a == 127 else "none" if a == 0 else "multicast" if a >= 224 else "public"


def _script(text: str) -> str:
    import unicodedata

    first = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "")
    return "cyrillic" if first.startswith("CYRILLIC") else "greek" if first.startswith("GREEK") else "latin"


def _drawn(keyed: Keyed, symbols: str, n: int, *tweak: object) -> str:
    noise = keyed.digits(n, *tweak)
    return "".join(symbols[int.from_bytes(noise[2 * i : 2 * i + 2], "big") % len(symbols)] for i in range(n))


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """Stand-in for an entity in normal form: another for each attempt, from more and more that there are."""
    keyed, tweak = Keyed(key), (kind, attempt)
    longer = max(0, attempt - SAME_SHAPE + 1)
    digits = _drawn(keyed, _ALPHABETS[0], longer, *tweak, "longer", norm)
    letters = _drawn(keyed, _ALPHABETS[1], longer, *tweak, "longer", norm)
    if kind == "email":
        local, _, host = norm.rpartition("@")
        labels, _, top = host.rpartition(".")
        local = _reshaped(keyed, local, *tweak, "local", host) + letters
        return f"{local}@{_reshaped(keyed, labels, *tweak, 'host', top)}.{top}"
    if kind == "address":
        parts = [int(p) for p in norm.split(".")]
        home = _network(parts)
        while True:
            parts = keyed.permuted(parts, [256] * 4, *tweak)
            if _network(parts) == home:
                return ".".join([*map(str, parts), *digits])
    if kind == "card":
        body, offset = norm[:-1], (int(norm[-1]) - _luhn(norm[:-1])) % 10
        body = _reshaped(keyed, body, *tweak, len(norm)) + digits
        return body + str((_luhn(body) + offset) % 10)
    if kind.startswith("name"):
        role = kind.split("-")[1]
        if role not in ("given", "family"):
            first, _, rest = norm.partition(" ")
            second = surrogate(key, "name-family", rest or first, attempt)
            return f"{surrogate(key, f'name-given-{role}', first, attempt)} {second}" if rest else second
        script = _script(norm)
        pool = (GIVEN[script, kind[-1]] if role == "given" else FAMILY[script]).split()
        name = pool[int.from_bytes(keyed.digits(1, *tweak, norm)[:2], "big") % len(pool)]
        if attempt:  # the lists are short; further draws join a name of as many syllables
            parts = zip(*(_drawn(keyed, x, attempt, *tweak, i, norm) for i, x in enumerate(SYLLABLES[script])))
            name += "-" + "".join(map("".join, parts)).capitalize()
        return name
    hexadecimal = re.fullmatch(r"[0-9a-f]+", norm) is not None and kind == "secret"
    tail = digits if kind in ("phone", "identity", "iban") else letters
    return _reshaped(keyed, norm, *tweak, len(norm), hexadecimal=hexadecimal, symbols=kind == "secret") + tail


def fitted(kind: str, stand_in: str, raw: str) -> str:
    """A surrogate in the writing of one mention: its separators, its case."""
    if kind in ("phone", "card", "iban", "identity"):
        rest = iter(stand_in)
        return "".join(c if re.match(r"[\s().-]", c) else next(rest) for c in raw) + "".join(rest)
    if kind.startswith("name"):
        return stand_in.upper() if raw.isupper() else stand_in
    if kind == "email" or re.fullmatch(r"[0-9a-fA-F]+", raw):
        return stand_in.upper() if raw.isupper() else stand_in
    return stand_in


_MENTIONS = "doc_id long, text_key long, start int, stop int, kind string, norm string"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "start", "stop", "kind", "norm"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows += [(doc, key, *mention) for mention in find_mentions(text or "")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "norm", "attempt")))
            drawn = [(kind, surrogate(key, kind, norm, attempt)) for kind, norm, attempt in rows]
            new = [pa.array([x for _, x in drawn], pa.string()), pa.array([normal_form(*x) for x in drawn], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "drawn", "plain"])

    return run


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, kinds = [], [], []
        for text, mentions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out, at = [], 0
            for m in sorted(mentions or [], key=lambda m: m["start"]):
                out += [text[at : m["start"]], fitted(m["kind"], m["drawn"], text[m["start"] : m["stop"]])]
                at = m["stop"]
            texts.append(text if text is None else "".join(out) + text[at:])
            counts.append(len(mentions or []))
            kinds.append(sorted({m["kind"].split("-")[0] for m in mentions or []}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
            ["doc_id", "text", "n_entities", "kinds"],
        )


def entity_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """Surrogate of each distinct entity (kind, norm): kind, norm, drawn.

    Names are joined from the surrogates of their parts: of the family name, and of the given name and
    the gender. Where one gender alone is told for a whole name anywhere, mentions that tell none have it.
    """
    entities = written_table(entities.select("kind", "norm").distinct(), "entities")
    is_name = F.col("kind").startswith("name-")
    own, two = F.split_part("kind", F.lit("-"), F.lit(2)), F.contains("norm", F.lit(" "))
    told = F.collect_set(F.when(own != "n", own)).over(Window.partitionBy("norm"))
    gender = F.when((own == "n") & (F.size(told) == 1), F.element_at(told, 1)).otherwise(own)
    first = F.substring_index("norm", " ", 1)
    names = entities.where(is_name).select(
        "kind",
        "norm",
        F.when(two, F.concat(F.lit("name-given-"), gender)).alias("role"),
        F.when(two, first).alias("first"),
        F.when(two, F.expr("substr(norm, length(substring_index(norm, ' ', 1)) + 2)")).otherwise(F.col("norm")).alias("last"),
    )
    of_parts = names.where("first is not null").select(F.col("role").alias("kind"), F.col("first").alias("norm"))
    of_parts = of_parts.unionByName(names.select(F.lit("name-family").alias("kind"), F.col("last").alias("norm")))
    drawn = _settled(entities.where(~is_name).unionByName(of_parts), key)
    given = drawn.where("kind like 'name-given-%'").select(
        F.col("kind").alias("role"), F.col("norm").alias("first"), F.col("drawn").alias("given")
    )
    family = drawn.where("kind = 'name-family'").select(F.col("norm").alias("last"), F.col("drawn").alias("family"))
    whole = F.when(F.col("kind").endswith("-given"), F.col("given")).otherwise(F.concat_ws(" ", "given", "family"))
    joined = names.join(given, ["role", "first"], "left").join(family, "last").select("kind", "norm", whole.alias("drawn"))
    return drawn.where(~is_name).unionByName(joined)


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    """Surrogate of each distinct part of a name or other entity: kind, norm, drawn.

    Entities whose draw another entity of the type has, or that is an entity itself, draw again until
    every draw is new; draws count as equal if their normal forms are. As the number of possible draws
    multiplies from one to the next, few rounds do. Every round is a few equi-joins over what is still
    open.
    """
    entities = written_table(entities.select("kind", "norm").distinct(), "parts")
    family = F.split_part("kind", F.lit("-"), F.lit(1))
    real = entities.select(family.alias("of"), F.col("norm").alias("known")).distinct()
    open_, done, attempt = entities.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = written_table(
            open_.mapInArrow(_draw(key), "kind string, norm string, attempt int, drawn string, plain string"), "draws"
        )
        is_known = (F.col("family") == F.col("of")) & (F.col("plain") == F.col("known"))
        free = drawn.withColumn("family", family).join(real, is_known, "left_anti")
        if done is not None:
            used = done.select(family.alias("of"), F.col("plain").alias("known"))
            free = free.join(used, is_known, "left_anti")
        first = free.groupBy("family", "plain").agg(F.min(F.struct("norm", "kind", "drawn")).alias("owner"))
        settled = first.select("owner.kind", "owner.norm", "owner.drawn", "plain")
        settled = written_table(settled, "surrogates")
        done = settled if done is None else done.unionByName(settled)
        rest = drawn.join(settled.select("kind", "norm"), ["kind", "norm"], "left_anti")
        attempt += 1
        open_ = written_table(rest.select("kind", "norm", F.lit(attempt).alias("attempt")), "open")
        if open_.isEmpty():
            return done.drop("plain")


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text with its entities replaced: doc_id, text, n_entities and kinds (sorted, distinct).

    Types are e-mail, network address, phone, card, bank account, identity number, secret, and names
    behind a form of address, which tells the gender. Further mentions of such a name, of its given and
    of its family name are replaced in the same text wherever they are words with a capital, also where
    the word means something else there (Mr Young, Young people); a name in no form of address in a
    text stays. Formats are kept: separators, capitals, digits
    and letters in place, card checksums, private and public networks, top-level domains.

    A null text stays null, an empty one empty. Rows without id and repeated rows are treated like
    others; equal texts get equal results. Other columns are ignored. An empty table gives an empty
    result. The same key gives the same surrogates in every run over the same entities.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    mentions = written_table(base.mapInArrow(_detect, _MENTIONS), "mentions")
    chosen = entity_surrogates(mentions, key)
    changes = (
        mentions.join(chosen, ["kind", "norm"])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "stop", "kind", "drawn")).alias("mentions"))
        .withColumnsRenamed({"doc_id": "in_doc", "text_key": "in_key"})
    )
    mine = base["doc_id"].eqNullSafe(changes["in_doc"]) & (base["text_key"] == changes["in_key"])
    return (
        base.join(changes, mine, "left")
        .select("doc_id", "text", "mentions")
        .mapInArrow(_replace, "doc_id long, text string, n_entities long, kinds array<string>")
    )
