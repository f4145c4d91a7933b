import hashlib
import random

import pytest
from common import SMALL, empty, hard
from hypothesis import given
from hypothesis import strategies as st

from flowlens.llm.merkle import compare, edited_text, fingerprints, likeness, merkle_tree

TEXTS = st.text(alphabet=st.sampled_from("ab .!?\n\té"), max_size=300)


def leaves(node):
    return [node] if not node.children else [x for c in node.children for x in leaves(c)]


@given(TEXTS, TEXTS)
def test_tree_and_likeness(a, b):
    one, two = merkle_tree(a), merkle_tree(b)
    assert one.length == len(a) and sum(x.length for x in leaves(one)) == len(a)
    assert (one.digest == two.digest) == (a == b)
    assert 0 <= likeness(one, two) <= 1 and likeness(one, two) == pytest.approx(likeness(two, one))
    common, changed = compare(one, two)
    assert common + sum(n for _, n in changed) == len(a)


def test_differing_branches_locate_the_edit():
    lines = [f"Sentence {i} says this. And sentence {i} says that.\n" for i in range(40)]
    before = "".join(lines)
    lines[17] = "Something else stands here. And sentence 17 says that.\n"
    _, changed = compare(merkle_tree(before), merkle_tree("".join(lines)))
    assert len(changed) == 1
    start, n = changed[0]
    assert before[start : start + n].strip() == "Sentence 17 says this."


def test_long_pieces_are_linear():
    assert merkle_tree("x" * 2_000_000).length == 2_000_000
    assert merkle_tree("y " * 500_000).length == 1_000_000


@pytest.mark.parametrize("parts", [1, 6])
def test_fingerprints_of_the_documents(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(parts)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert edited == edited_text(text, following)
        r, tree = got[doc], merkle_tree(text)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (tree.digest.hex(), merkle_tree(edited).digest.hex())
        assert r["near_edited"] == likeness(tree, merkle_tree(edited))
        assert r["near_next"] == likeness(tree, merkle_tree(following))


def test_few_edits_leave_texts_alike():
    rng = random.Random(1)
    lines = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12)) + ". " for _ in range(100)]
    near = [l if i % 20 else "Changed. " for i, l in enumerate(lines)]
    far = [" ".join(rng.choices(["eps", "zeta", "eta"], k=12)) + ". " for _ in range(100)]
    tree = merkle_tree("".join(lines))
    assert likeness(tree, merkle_tree("".join(near))) > 0.9 and likeness(tree, merkle_tree("".join(far))) == 0


def test_hard_rows(spark):
    got = fingerprints(hard(spark)).collect()
    assert len(got) == 13 and {r["n_chars"] for r in got if r["doc_id"] in (1, 2)} == {0}
    blank = {r["fingerprint"] for r in got if r["n_chars"] == 0}
    assert len(blank) == 1 and len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["near_next"] == first["near_edited"] == 1.0
    assert fingerprints(empty(spark)).collect() == []
    alone = fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(5, 1.0)]
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


JUNK = ["!", ".", "?", "-", "Mr ", "Dr ", "@", "0", "a", "。", "! ", "Mr! Dr. @0a-? ", ".a", "a. \n"]


@pytest.mark.parametrize("unit", JUNK)
def test_a_megabyte_of_anything_takes_little_time(unit):
    import time

    text = unit * (1_000_000 // len(unit))
    begin = time.perf_counter()
    tree = merkle_tree(text)
    assert time.perf_counter() - begin < 8 and tree.length == len(text)


def test_sentences_end_at_marks_before_white_space():
    from flowlens.llm.merkle import _pieces

    text = "One!? Two.three... four.\tfive ?! six. "
    assert list(_pieces(text)) == ["One!? ", "Two.three... ", "four.\t", "five ?! ", "six. "]
    assert list(_pieces("!!!")) == ["!!!"] and list(_pieces("")) == []


@pytest.mark.parametrize("mark", ["", "。"])
def test_texts_without_spaces_are_compared_in_parts(mark):
    import random

    rng = random.Random(3)

    def prose(n):
        return "".join(mark if mark and rng.random() < 0.03 else chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))

    text, other = prose(3000), prose(3000)
    edited = text[:1500] + other[:1500]
    same, spans = compare(merkle_tree(edited), merkle_tree(text))
    assert 1400 <= same <= 1500 and spans[-1][0] + spans[-1][1] == 3000
    assert compare(merkle_tree(text), merkle_tree(other))[0] == 0
    middle = text[:1000] + "字" + text[1000:]
    assert compare(merkle_tree(middle), merkle_tree(text))[0] > 2850
