import random
import re

import pytest
from common import empty, hard
from hypothesis import given
from hypothesis import strategies as st

from flowlens.llm import surrogates
from flowlens.llm.surrogates import (
    Keyed, _luhn, entity_surrogates, find_entities, find_mentions, fitted, normal_form, replace_personal_data, surrogate,
)

KEY = b"secret"
TEXT = (
    "Mr John Smith (x.34@mail7.example.com, X.34@MAIL7.EXAMPLE.COM) called Mrs. Anna Ivanova and Госпожа Вера Белова "
    "at +1 (017) 555-7713 from 97.51.17.173 or 10.0.0.7; paid with 4111 1111 1111 1111 and 4111111111111111. "
    'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" and TOKEN="9233A8ECF7C5B09FE5949719B6B82BC439E9329B"; 078-05-1120; '
    "DE89 3704 0044 0532 0130 00; version 3.0.1 of 2024."
)


def kinds(text):
    return [(k, text[a:b]) for a, b, k in find_entities(text)]


def test_entities_are_found():
    assert kinds(TEXT) == [
        ("name-m", "John Smith"), ("email", "x.34@mail7.example.com"), ("email", "X.34@MAIL7.EXAMPLE.COM"),
        ("name-f", "Anna Ivanova"), ("name-f", "Вера Белова"), ("phone", "+1 (017) 555-7713"), ("address", "97.51.17.173"),
        ("address", "10.0.0.7"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"),
        ("secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"),
        ("identity", "078-05-1120"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ]
    assert kinds("@ a@b 1.2.3 300.1.1.1 12345 v1.2.3.4.5 key") == []
    assert kinds("y" * 100_000 + "@" + "x" * 100_000) == [] and kinds("9" * 100_000) == []


@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 3))
def test_permutation_keeps_strings_apart(digits, tweak):
    bases = [10] * len(digits)
    keyed = Keyed(KEY)
    image = keyed.permuted(digits, bases, tweak)
    other = [(d + (i == 0)) % 10 for i, d in enumerate(digits)]
    assert all(0 <= x < 10 for x in image) and keyed.permuted(other, bases, tweak) != image


def test_permutation_is_one_to_one():
    keyed = Keyed(KEY)
    images = {tuple(keyed.permuted([a, b, c], [10, 26, 3], "t")) for a in range(10) for b in range(26) for c in range(3)}
    assert len(images) == 780


@pytest.mark.parametrize("raw,kind", [(t, k) for k, t in kinds(TEXT)])
def test_formats_are_kept(raw, kind):
    norm = normal_form(kind, raw)
    new = fitted(kind, surrogate(KEY, kind, norm), raw)
    assert new != raw and surrogate(b"other", kind, norm) != surrogate(KEY, kind, norm)
    if kind in ("phone", "card", "iban", "identity", "secret"):
        shape = lambda s: re.sub("[A-F]", "A", re.sub("[a-f0-9]", "0", s)) if kind == "secret" else re.sub(r"\d", "0", re.sub("[A-Z]", "A", s))
        assert kind == "secret" and len(new) == len(raw) or shape(new) == shape(raw)
    if kind == "card":
        digits = re.sub(r"\D", "", new)
        assert int(digits[-1]) == _luhn(digits[:-1])
    if kind == "address":
        assert all(0 <= int(p) <= 255 for p in new.split(".")) and (raw.startswith("10.") == bool(re.match(r"10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.", new)))
    if kind == "email":
        assert new.lower().endswith(".com") and new.isupper() == raw.isupper()
    if kind.startswith("name"):
        script = "cyrillic" if re.match("[А-я]", raw) else "latin"
        assert new.split()[0] in surrogates.GIVEN[script, kind[-1]].split()


def test_coreference_and_distinctness(spark):
    rng = random.Random(4)
    people = [f"Mr {a} {b}" for a in ("Hal", "Ned", "Ian", "Rex") for b in ("Moss", "Hale", "Reed", "Lowe", "Pike")]
    # Every second name is one that the lists could draw.
    people += [f"Mr {a} {b}" for a in surrogates.GIVEN["latin", "m"].split()[:8] for b in surrogates.FAMILY["latin"].split()[:6]]
    rows = [(i, " ".join(f"{rng.choice(people)} met {rng.choice(people)} at 10.0.0.{i % 250}.".split())) for i in range(300)]
    got = replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), KEY)
    names, originals = {}, set()
    for doc, text in [(r["doc_id"], r["text"]) for r in got.collect()]:
        before = dict(rows)[doc]
        old = [normal_form(k, before[a:b]) for a, b, k in find_entities(before)]
        new = [text[a:b] for a, b, k in find_entities(text)]
        assert len(old) == len(new) == 3
        originals |= set(old)
        for o, n in zip(old, new):
            assert names.setdefault(o, n) == n
    assert len(set(names.values())) == len(names)
    assert not {normal_form("name-m", n) for n in names.values()} & originals


def test_draws_are_repeated_until_new(spark):
    """More names than the lists have pairs: all surrogates differ all the same, and none is a name of the corpus."""
    rows = [("name-m", f"hal n{i}") for i in range(900)] + [("name-m", "tom young"), ("name-f", "alice reyes")]
    got = entity_surrogates(spark.createDataFrame(rows, "kind string, norm string").repartition(4), KEY).collect()
    drawn = [r["drawn"].lower() for r in got]
    assert {(r["kind"], r["norm"]) for r in got} == set(rows)
    assert len(set(drawn)) == len(rows) and not {n for _, n in rows} & set(drawn)


def test_all_mentions_of_a_name_agree(spark):
    rows = [
        (1, "Mr John Smith came. John Smith spoke; JOHN paid, Smith's son and a smith left. Smith-led, Smith2, a.Smith@x.org"),
        (2, "Mr Smith met Dr John Smith and Prof. Dr. Smith. Smith, John\nSmith."),
        (3, "Dr John Smith and Mrs Smith"),
        (4, "Mr John and Mr John Smith Mrs Anna Young: Young Anna, John"),
        (5, "John Smith without address"),
    ]
    got = {r["doc_id"]: r for r in replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), KEY).collect()}
    john, smith = got[1]["text"].split()[1:3]
    mail = got[1]["text"].split()[-1]
    assert mail != "a.Smith@x.org" and len({john, smith, "John", "Smith"}) == 4
    assert got[1]["text"] == f"Mr {john} {smith} came. {john} {smith} spoke; {john.upper()} paid, {smith}'s son and a smith left. {smith}-led, Smith2, {mail}"
    assert got[2]["text"] == f"Mr {smith} met Dr {john} {smith} and Prof. Dr. {smith}. {smith}, {john} {smith}."
    assert got[3]["text"] == f"Dr {john} {smith} and Mrs {smith}"
    anna, young = got[4]["text"].split(":")[0].split()[-2:]
    assert got[4]["text"] == f"Mr {john} and Mr {john} {smith} Mrs {anna} {young}: {young} {anna}, {john}"
    assert got[5]["text"] == rows[4][1] and got[5]["n_entities"] == 0
    assert got[1]["n_entities"] == 6 and got[1]["kinds"] == ["email", "name"] and got[3]["kinds"] == ["name"]


def test_gender_is_decided_per_person(spark):
    rows = [("name-n", "kim lee"), ("name-f", "kim lee"), ("name-n-given", "kim lee"), ("name-m", "lee"), ("name-n", "lee")]
    rows += [("name-m", "kim moss"), ("name-n", "sam moss")]
    got = {(r["kind"], r["norm"]): r["drawn"] for r in entity_surrogates(spark.createDataFrame(rows, "kind string, norm string"), KEY).collect()}
    assert set(got) == set(rows)
    given, family = got["name-f", "kim lee"].split()
    assert given.split("-")[0] in surrogates.GIVEN["latin", "f"].split()
    assert got["name-n", "kim lee"] == f"{given} {family}" and got["name-n-given", "kim lee"] == given
    assert got["name-m", "lee"] == got["name-n", "lee"] == family
    assert got["name-m", "kim moss"].split()[0] != given and got["name-m", "kim moss"].split()[1] == got["name-n", "sam moss"].split()[1]
    assert [x[2:] for x in find_mentions("Dr Kim Lee, Mr Lee and Ms Kim Lee: Kim")] == [
        ("name-f", "kim lee"), ("name-m", "lee"), ("name-f", "kim lee"), ("name-f-given", "kim lee")
    ]


def test_every_entity_settles(spark):
    """Secrets without ASCII letters or digits, names beyond the Greek lists, more entities than their shape has strings."""
    secrets = ["_" * 16, "........", "--------", "абвгдежз", "パスワード漢字です", "+_" * 4]
    rows = [("secret", s) for s in secrets] + [("name-m", f"άλφα{chr(945 + i // 20)}{chr(945 + i % 20)}") for i in range(300)]
    rows += [("email", f"{a}@{b}.com") for a in "0123456789_" for b in "0123456789-"] + [("card", f"{i:013}") for i in range(50)]
    rows += [("address", f"10.0.0.{i}") for i in range(200)] + [("email", "ж@-.de"), ("name-f", "γιώργος")]
    got = entity_surrogates(spark.createDataFrame(rows, "kind string, norm string").repartition(4), KEY).collect()
    assert {(r["kind"], r["norm"]) for r in got} == set(rows) and len(got) == len(rows)
    drawn = {(r["kind"].split("-")[0], normal_form(r["kind"], r["drawn"])) for r in got}
    assert len(drawn) == len(rows) and not drawn & {(k.split("-")[0], n) for k, n in rows}
    texts = [(i, f"Password: {s}") for i, s in enumerate(secrets)]
    got = replace_personal_data(spark.createDataFrame(texts, "doc_id long, text string"), KEY).collect()
    assert all(r["n_entities"] == 1 and secrets[r["doc_id"]] not in r["text"] for r in got)


@pytest.mark.parametrize("kind,norm", [("card", "4111111111111111"), ("address", "10.0.0.7"), ("phone", "+10175557713"), ("email", "_@-.com"), ("secret", "....")])
def test_draws_get_longer(kind, norm):
    draws = [surrogate(KEY, kind, norm, i) for i in range(12)]
    assert len(draws[11]) > len(draws[6]) > len(norm) and len(set(draws[3:])) == 9
    assert fitted("phone", draws[11], "+1 (017) 555-7713").replace(" ", "").endswith(draws[11][-4:])
    if kind == "card":
        assert all(int(d[-1]) == _luhn(d[:-1]) for d in draws)


def test_hard_rows(spark):
    got = replace_personal_data(hard(spark), KEY).collect()
    before = {r["doc_id"]: r["text"] for r in hard(spark).collect() if r["doc_id"] is not None}
    assert len(got) == 13 and all(r["n_entities"] == 0 and r["text"] == before[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert replace_personal_data(empty(spark), KEY).collect() == []
    rows = [(1, "1.2.3.4 and 1.2.3.4"), (1, "1.2.3.4 and 1.2.3.4"), (None, "call 1.2.3.4"), (2, None)]
    got = replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    new = {re.findall(r"[\d.]{7,}", r["text"])[0] for r in got if r["text"]}
    assert len(got) == 4 and len(new) == 1 and "1.2.3.4" not in new
    assert sorted(r["n_entities"] for r in got) == [0, 1, 2, 2]


JUNK = ["!", ".", "?", "-", "Mr ", "Dr ", "Mr. Dr. ", "@", "0", "a", "a@", "a.", "key ", "token=", "Mr! Dr. @0a-? ", "12.", "A B ", "Mr A "]


@pytest.mark.parametrize("unit", JUNK)
def test_a_megabyte_of_anything_takes_little_time(unit):
    import time

    from flowlens.llm.surrogates import find_mentions

    text = unit * (1_000_000 // len(unit))
    begin = time.perf_counter()
    find_mentions(text)
    assert time.perf_counter() - begin < 8


def test_long_addresses_are_replaced_whole():
    from flowlens.llm.surrogates import find_entities

    for local, host in (("a" * 70, "b.org"), ("x.y" * 100, "m." * 200 + "example.com")):
        text = f"write to {local}@{host} now"
        assert [text[a:b] for a, b, kind in find_entities(text) if kind == "email"] == [f"{local}@{host}"]


def test_rows_of_forms_of_address():
    from flowlens.llm.surrogates import find_entities

    text = "Mr Mr Dr Smith met Mrs. Prof. Jane Doe, Dr 5, Mr Miss, Mr"
    assert [(text[a:b], kind) for a, b, kind in find_entities(text)] == [("Smith", "name-m"), ("Jane Doe", "name-f")]
