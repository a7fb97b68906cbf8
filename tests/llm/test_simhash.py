import random
import re
import string

import numpy as np
import xxhash

from foldline.llm import graph, simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id that links of 3 bits or fewer reach, from all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(1)
    masks = simhash.masks()
    assert len(masks) == 15
    for _ in range(3000):
        places = draw.sample(range(64), draw.randint(1, 3))
        changed = sum(1 << p for p in places)
        assert any(m & changed == 0 for m in masks)


def test_whole_table_as_all_pairs_say(spark, sf, plain_rows):
    rows = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    prints = {i: plain_print(t) for i, t, *_ in plain_rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


def test_a_crowded_bucket_is_dealt_out(spark):
    draw = np.random.default_rng(3)
    prints = {}
    while len(prints) < 300:  # chains around one centre
        value = int(0x0123456789ABCDEF)
        for p in draw.integers(0, 64, draw.integers(0, 9)):
            value ^= 1 << int(p)
        if value not in prints.values():
            prints[len(prints)] = value
    frame = spark.createDataFrame([(i, simhash._signed(v)) for i, v in prints.items()], "node long, fp long")
    for cell in (1 << 13, 40, 7):
        found = {r.node: r.component for r in graph.components(simhash.links(frame, cell=cell)).collect()}
        assert {i: found.get(i, i) for i in prints} == plain_components(prints)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(7, 7), (900, 901), (901, 900)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(401)}, 900: 900, 901: 900}


def test_edges(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == 11  # rows without an id take no part
    found = {r.doc_id: r for r in rows}
    assert found[1].fp == found[2].fp == found[3].fp == 0 and {found[i].component_id for i in (1, 2, 3)} == {1}
    assert found[5].component_id == found[6].component_id == 5
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [
        (False, i) for i in (-9, 1, 4, 5, 7, 8, 2**40)]
    assert kept.where("doc_id is null").count() == 2
