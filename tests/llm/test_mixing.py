import math

import pytest

from foldline.llm import mixing


def table(documents):
    """A source with most of the rows, and some small ones."""
    rows = [(i, "w " * (1 + i % 7), "en", "big") for i in range(900)]
    rows += [(1000 + i, "w " * (1 + i % 5), "en", f"s{i % 4}") for i in range(200)]
    return documents([*rows, (3000, "", "en", "none"), (3001, None, None, None), (3002, "a b", "en", None)])


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def tokens(frame):
    out = {}
    for r in mixing.token_counts(frame).collect():
        out.setdefault(r.source, []).append((r.doc_id, r.tokens))
    return out


def test_exponent_meets_the_target(spark, documents):
    held = {s: sum(n for _, n in own) for s, own in tokens(table(documents)).items()}
    total = sum(held.values())
    frame = spark.createDataFrame([(s, n) for s, n in held.items()], "source string, tokens long")

    def weights(a):
        raw = {s: (n / total) ** a for s, n in held.items() if n}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    natural, flat = entropy(weights(1).values()), math.log(sum(n > 0 for n in held.values()))
    a = mixing.exponent(frame, flatten=0.5, repeat_limit=1e9)
    assert entropy(weights(a).values()) == pytest.approx(natural + 0.5 * (flat - natural), abs=1e-6)
    b = mixing.exponent(frame, flatten=1.0, repeat_limit=3.0)
    assert max(w * total / held[s] for s, w in weights(b).items()) == pytest.approx(3, abs=1e-5)
    assert mixing.exponent(frame, flatten=0.0) == pytest.approx(1, abs=1e-6)


def test_budgets_and_permutations(documents):
    docs = table(documents)
    held = tokens(docs)
    taken, _ = mixing.mix(docs, flatten=0.7, repeat_limit=5.0)
    rows = taken.collect()
    total = sum(n for own in held.values() for _, n in own)
    for source, own in held.items():
        whole, longest = sum(n for _, n in own), max(n for _, n in own)
        mine = sorted((r["start"], r["copy"], r["doc_id"], r["tokens"]) for r in rows if r["source"] == source)
        if not whole:
            assert len(mine) == len(own)
            continue
        weight = next(r["weight"] for r in rows if r["source"] == source)
        budget = round(weight * total)
        spent = sum(m[3] for m in mine)
        assert budget - longest < spent <= budget
        at = 0
        for start, _, _, n in sorted(m for m in mine if m[3]):
            assert start == at
            at += n
        epochs = {}
        for _, copy, i, n in mine:
            if n:
                epochs.setdefault(copy, []).append(i)
        for copy, ids in epochs.items():
            assert len(set(ids)) == len(ids)
            if copy < budget // whole:
                assert sorted(ids) == sorted(i for i, n in own if n)
        if len(own) > 20 and len(epochs) > 1:
            assert epochs[0][:20] != epochs[1][:20]


def test_remixed_keeps_every_document(documents):
    docs = table(documents)
    out = mixing.remixed(docs, flatten=1.0, repeat_limit=2.0)
    assert out.schema == docs.schema
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert set(n) == {r.doc_id for r in docs.collect()}
    assert max(n.values()) == 2 and all(n[i] == 1 for i in range(900))


def test_edges(edges, empty):
    taken, _ = mixing.mix(edges)
    assert taken.where("tokens = 0").count() == edges.where("trim(regexp_replace(coalesce(text, ''), '[\\\\s]+', '')) = ''").count()
    assert mixing.remixed(edges).count() >= edges.count()
    taken, exponent = mixing.mix(empty)
    assert taken.count() == 0 and exponent == 1.0
    assert mixing.remixed(empty).count() == 0
