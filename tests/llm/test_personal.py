import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from foldline.llm import personal


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_patterns():
    draw, find = random.Random(4), personal.finder()
    for _ in range(30_000):
        text = "".join(draw.choice("a.@-+1234 5678()%é\n") for _ in range(draw.randint(0, 40)))
        assert find(text) == plain(text)
    assert find("4" * 400_000 + "a" * 400_000 + "@") == []  # no quadratic search


def test_whole_table(spark, sf, plain_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = personal.detect(docs, personal.trained(docs)).collect()
    texts = {i: t for i, t, *_ in plain_rows}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        listed = personal.span_list(base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == b[1] for b in base) for k in range(4))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        if not base:
            assert r.spans == ""


@pytest.fixture(scope="module")
def model(spark):
    return personal.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_consistency_across_a_text(model):
    find = personal.finder()

    def added(text):
        return [(text[a:b], personal.KINDS[k]) for a, k, b in personal.added_spans(text, find(text), find, model)]

    assert added("call +1 (702) 555-0742 now, or just 555-0742.") == [("555-0742", "phone")]
    assert added("just 555-0742.") == [] == added("call +1 (702) 555-0742 or 1999 or 12")
    assert added("card 4303624562121775, not 999.1.2.3") == []


def spans_of(text, model):
    find = personal.finder()
    return [(text[a:b], personal.KINDS[k]) for a, k, b in personal.added_spans(text, find(text), find, model)]


@pytest.mark.parametrize("between", [", ", " ", " and then some other words with 12 of 1999 things, ", "\n"])
@pytest.mark.parametrize("bare", ["555-0742", "5550742"])
def test_distant_mentions(model, bare, between):
    def found(text):
        spans = spans_of(text, model)
        assert {kind for _, kind in spans} == {"phone"}
        return sum(part.count(bare) for part, _ in spans)

    for repeats in (1, 100, 2000):
        assert found("+1 (702) 555-0742 is whole." + between + between.join([bare] * repeats)) == repeats
    assert found(between.join([bare] * 100) + ", whole: +1 (702) 555-0742") == 100


def test_distant_mentions_are_exact(model):
    """100 bare mentions side by side: each one's marginal by sums over all labels along the chain, the hub's label given."""
    find, text = personal.finder(), "+1 (702) 555-0742; " + " ".join(["555-0742"] * 100)
    places, shapes, observed, chain, groups = personal.tokens_of(text, find(text), find)
    n = len(places)
    assert len(set(groups[-101:])) == 1 and len(chain) == n - 1 and (observed[-100:] < 0).all() and (observed[:-100] == 4).all()
    got = personal.marginals(model, *personal.with_hubs(shapes, observed, chain, groups))[:n]
    own = np.exp(shapes @ model["unary"] + model["skip"][4])
    own[:-100] = np.eye(personal.N_LABELS)[4]
    pair, ahead, back = np.exp(model["chain"]), [own[0]], [np.ones(personal.N_LABELS)]
    for i in range(1, n):
        ahead.append(own[i] * (ahead[-1] @ pair))
        back.insert(0, pair @ (own[n - i] * back[0]))
        ahead[-1], back[0] = ahead[-1] / ahead[-1].sum(), back[0] / back[0].sum()
    want = np.array(ahead) * np.array(back)
    assert got == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-6)


@pytest.mark.parametrize("bare", ["030 123 4567", "123 4567", "030 1234567", "030/123-4567", "(030) 123.4567", "30 12 34 56 7", "0049 30 123 4567", "1234567"])
def test_grouped_numbers(model, bare):
    assert spans_of(f"ring +49 30 123 4567. In 2019 {bare}, of 17 rooms", model) == [(bare, "phone")]
    assert spans_of(f"ring +49 30 123 4567 12, else {bare}", model) == [(bare, "phone")]
    assert spans_of(f"ring {bare}", model) == []
    assert spans_of("ring +49 30 123 4567, else 030 123 4568 or 4567", model) == []


def test_similar_addresses(model):
    assert spans_of("ask ann.lee@corp.example or ann.lee@corp or ANN.LEE@ or x@other", model) == [("ann.lee@corp", "email"), ("ANN.LEE@", "email")]
    assert spans_of("ask ann.lee@corp.example or !@corp.example", model) == [("@corp.example", "email")]


def test_marginals_without_loops_are_exact(model):
    draw = np.random.default_rng(5)
    shapes = np.eye(len(personal.SHAPES))[draw.integers(0, len(personal.SHAPES), 4)]
    edges = np.array([[0, 1, 0], [1, 2, 1], [1, 3, 0]])
    observed = np.array([-1, -1, 2, -1])
    got = personal.marginals(model, shapes, observed, edges)
    weight = np.zeros((4, personal.N_LABELS))
    for labels in product(range(personal.N_LABELS), repeat=4):
        if labels[2] == 2:
            energy = sum(shapes[i] @ model["unary"][:, labels[i]] for i in (0, 1, 3))
            energy += sum(model[("chain", "skip")[k]][labels[a], labels[b]] for a, b, k in edges)
            weight[np.arange(4), labels] += np.exp(energy)
    assert got == pytest.approx(weight / weight.sum(axis=1, keepdims=True), abs=1e-3)


def enumerated(model, shapes, observed, edges, allowed):
    n, weight = len(observed), np.zeros((len(observed), personal.N_LABELS))
    may = [[observed[i]] if observed[i] >= 0 else np.flatnonzero(allowed[i]).tolist() for i in range(n)]
    for labels in product(*may):
        energy = sum(shapes[i] @ model["unary"][:, labels[i]] for i in range(n) if observed[i] < 0)
        energy += sum(model[("chain", "skip")[k]][labels[a], labels[b]] for a, b, k in edges)
        weight[np.arange(n), labels] += np.exp(energy)
    return weight / weight.sum(axis=1, keepdims=True)


def test_marginals_with_loops(model):
    """Six candidates in a chain, in groups at random, some observed: hubs are variables and make loops. Message passing is an approximation
    there; the error is 0.004 on average over 200 such graphs, 0.1 in the worst, and no label that is likely gets another."""
    errors = []
    for seed in range(60):
        draw = np.random.default_rng(seed)
        shapes = np.eye(len(personal.SHAPES))[draw.integers(0, personal.FIRST_VALID, 6)]
        observed = np.where(draw.random(6) < 0.4, draw.integers(1, personal.N_LABELS, 6), -1)
        group = draw.integers(0, 2, 6)
        groups = np.array([np.flatnonzero(group == g)[0] for g in group])
        whole = personal.with_hubs(shapes, observed, np.array([(i, i + 1) for i in range(5)]), groups)
        got, want = personal.marginals(model, *whole), enumerated(model, *whole)
        assert got.sum(axis=1) == pytest.approx(1) and not got[~whole[3]].any()
        errors.append(np.abs(got - want).mean())
        sure = want.max(axis=1) > 0.8
        assert (got.argmax(axis=1) == want.argmax(axis=1))[sure].all()
    assert np.mean(errors) < 0.01 and max(errors) < 0.15


def test_hubs_are_one_variable_a_group():
    observed, chain = np.array([-1, 4, 3, -1, -1, -1, 4, -1]), np.zeros((0, 2), int)
    groups = np.array([0, 0, 0, 3, 3, 5, 6, 6])
    shapes, seen, edges, allowed = personal.with_hubs(np.zeros((8, len(personal.SHAPES))), observed, chain, groups)
    assert seen[8:].tolist() == [-1, -1, 4] and len(shapes) == 11  # two kinds, no kind, one kind
    assert [np.flatnonzero(a).tolist() for a in allowed[8:]] == [[3, 4], [0, 1, 2, 3, 4], [4]]
    assert edges.tolist() == [[8, 0, 1], [8, 1, 1], [8, 2, 1], [9, 3, 1], [9, 4, 1], [10, 6, 1], [10, 7, 1]]


def test_a_group_of_two_kinds_settles_for_one(model):
    """Twice as a phone, once as a card: all members' evidence is weighed in the hub, the bare mention gets what it settles for."""
    n = personal.N_LABELS
    shapes, chain = np.zeros((5, len(personal.SHAPES))), np.zeros((0, 2), int)
    whole = personal.with_hubs(shapes, np.array([4, 4, 3, -1, -1]), chain, np.zeros(5, int))
    got = personal.marginals(model, *whole)
    assert got == pytest.approx(enumerated(model, *whole), abs=1e-6)  # a star has no loop
    assert got[5, 4] > got[5, 3] > 0 == got[5, 0] and got[3, 4] > got[3, 3]
    assert got.shape == (6, n)


def test_messages_that_swing_end():
    """An odd ring whose neighbours must differ, pulled hard: whole steps swing, smaller ones settle."""
    n, k = personal.N_LABELS, 9
    model = {"unary": np.zeros((len(personal.SHAPES), n)), "chain": -8 * np.eye(n), "skip": -8 * np.eye(n)}
    model["unary"][0, 0] = 0.1
    edges = np.array([(i, (i + j) % k, 0) for i in range(k) for j in (1, 2, 3)])
    shapes = np.zeros((k, len(personal.SHAPES)))
    shapes[:, 0] = 1
    got = personal.marginals(model, shapes, np.full(k, -1), edges)
    assert np.isfinite(got).all() and got.sum(axis=1) == pytest.approx(1)
    assert np.ptp(got, axis=0) == pytest.approx(0, abs=1e-3)  # the ring looks the same from everywhere


def test_repeated_ids_keep_the_sample_bounded(spark):
    rows = [(7, "call 12 or 13")] * 500 + [(7, "call 14")] * 20 + [(None, "call 15")] * 20 + [(i, f"at {i}") for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert personal.examples(docs).count() in (51, 52)
    assert all(personal.examples(docs, sample_docs=n).count() <= 2 * n for n in (1, 10, 30))


def test_edges(edges, empty, documents, model):
    rows = personal.detect(edges, personal.trained(edges)).collect()
    assert len(rows) == edges.count() and all(r.spans == "" for r in rows if r.doc_id in (1, 2, 3))
    assert personal.detect(empty, personal.trained(empty)).count() == 0
    docs = documents([(1, "write a.b@c.de or +49 30 1234567 today", "en", "a"), (2, None, "en", "a"), (3, "clean text 12", "en", None),
                      (4, "192.168.0.1.7 192.168.0.1", "en", "a")])
    out = personal.redacted(docs, model)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "write [EMAIL] or [PHONE] today" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean text 12"
    find = personal.finder()
    assert not any(find(r.text or "") for r in got.values())


def test_parts_of_any_length():
    """An address part of thousands of digits: zeros in front count for nothing, others are too many."""
    find = personal.finder()
    for part, good in (("0" * 5000 + "4", True), ("0" * 5000, True), ("4" * 5000, False), ("256", False), ("0255", True)):
        text = f"at 1.2.3.{part} now"
        assert ((3, 1, len(text) - 4) in find(text)) == good
