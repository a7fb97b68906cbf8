import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldline.llm import ctw

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Plain:
    """Context-tree weighting from its definition: counts in dictionaries, weights by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, byte in self.steps(t):
                for at in range(8):
                    node, bit = (1 << at) | byte >> (8 - at), byte >> (7 - at) & 1
                    for k in range(depth + 1):
                        own = context[depth - k:]
                        self.counts[own, node][bit] += 1
                        if k:
                            self.children[own[1:], node].add(own)
        self.known = {}

    def steps(self, text):
        data = b"\xff" * self.depth + text.translate(LOWER).encode() + b"\xff"
        return [(data[i - self.depth:i], data[i]) for i in range(self.depth, len(data))]

    def log_kt(self, context, node):
        a, b = self.counts[context, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_pw(self, context, node):
        if (context, node) not in self.known:
            own = self.log_kt(context, node)
            if len(context) < self.depth:
                below = sum(self.log_pw(c, node) for c in self.children[context, node])
                own = np.logaddexp(own, below) + math.log(0.5)
            self.known[context, node] = own
        return self.known[context, node]

    def one(self, context, node, k=0):
        own = context[self.depth - k:]
        a, b = self.counts.get((own, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if k == self.depth:
            return estimate
        weight = 0.5 * math.exp(self.log_kt(own, node) - self.log_pw(own, node)) if a + b else 0.5
        return weight * estimate + (1 - weight) * self.one(context, node, k + 1)

    def log10(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for at in range(8):
                one = self.one(context, (1 << at) | byte >> (8 - at))
                total += math.log10(one if byte >> (7 - at) & 1 else 1 - one)
        return total


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("depth, part_grams, block_bytes, fan", [
    (5, 200_000, 1 << 23, ctw.FAN), (4, 300, 700, ctw.FAN), (4, 2000, 400, 2), (3, 100, 1 << 23, 1)])
def test_as_the_definition_says(spark, plain_rows, depth, part_grams, block_bytes, fan):
    rows = [(i, t[:150]) for i, t, *_ in plain_rows[:25]] + [(1000, None), (1001, "zzz Ünseen ÿ"), (1004, "The the THE")]
    plain = Plain([t or "" for i, t in rows if not held_out(i)], depth)
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth, block_bytes, part_grams, fan).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    texts = dict(rows)
    for r in got:
        assert r.held_out == held_out(r.doc_id)
        assert r.score == pytest.approx(plain.log10(texts[r.doc_id] or ""), rel=1e-5)


def test_a_context_s_bytes_share_one(spark):
    texts = ["abcabcabd", "abcabe"]
    codes = [int.from_bytes(c + bytes([b]), "big") for c in (b"abcab", b"zzzzz", b"zzzab") for b in range(256)]
    import numpy as np

    from foldline.llm.bytegrams import pieces

    counted = Counter(np.concatenate([c for c, _ in pieces([t.encode() for t in texts], 5)]).tolist())
    grams = spark.createDataFrame([(c, counted.get(c, 0)) for c in {*codes, *counted}], "code long, n long").cache()
    found = {r.code: r.log10 for r in ctw.values(grams, 5, 300).collect()}
    for k in range(0, len(codes), 256):
        assert sum(10 ** found[c] for c in codes[k:k + 256]) == pytest.approx(1)


def test_base_over_whole_table(spark, sf, plain_rows):
    got = ctw.score(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=1 << 16).collect()
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), ""] for i, t, *_ in plain_rows}
    counts = Counter(w for i, own in words.items() if not held_out(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(words)
    for r in got:
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0


def test_pieces_in_two_steps(spark):
    """Twenty blocks by five ranges, then five bundles by twenty buckets: 200 rows at most instead of 400, with the same sums."""
    rows = spark.range(2000).selectExpr("pmod(id, 20) as block", "id % 5 <> 1 as learn", "concat('word', id % 97, ' and word', id) as text")
    straight = ctw.block_pieces(rows, 20, 20).cache()
    held = ctw.block_pieces(rows, 20, 5).cache()
    bundles = ctw.bundle_pieces(held, 5, 20).cache()
    assert held.count() <= 100 and bundles.count() <= 100 and straight.count() > 200
    sums = [sorted(ctw.bucket_sums(x, 20).where("code is not null").select("code", "n").collect()) for x in (straight, bundles)]
    assert sums[0] == sums[1]
    tokens = [ctw.bucket_sums(x, 20).where("code is null").selectExpr("sum(n)", "sum(kinds)").first() for x in (straight, bundles)]
    assert tokens[0] == tokens[1]


def test_tasks_follow_the_blocks(spark):
    rows = spark.range(10).selectExpr("id as block", "true as learn", "'a b' as text")
    assert ctw.block_pieces(rows, 50, 50).rdd.getNumPartitions() == 50 and ctw.spread(rows, 10**9, "block").rdd.getNumPartitions() == ctw.MOST_TASKS


def test_edges(edges, empty):
    rows = ctw.score(edges).collect()
    assert len(rows) == edges.count()
    blank = [r for r in rows if r.doc_id in (1, 2)]
    assert all(r.n_tokens == 1 for r in blank) and blank[0].score == pytest.approx(blank[1].score)
    assert sum(r.doc_id is None for r in rows) == 2 and not any(r.held_out for r in rows if r.doc_id is None)
    assert ctw.score(empty).count() == 0


def test_packed_numbers():
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 1000).astype("u8"))
    assert (ctw.grow_codes(ctw.shrink_codes(codes)) == codes).all()
    assert ctw.grow_words(ctw.shrink_words([b"", b"a", b"\xc3\xa9"])) == [b"", b"a", b"\xc3\xa9"]
    assert ctw.grow_words(ctw.shrink_words([b""])) == [b""]
