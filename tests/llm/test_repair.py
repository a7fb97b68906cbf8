import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import types as T

from foldline.llm import repair
from foldline.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("pos", "block", "key", "segment", "at")]])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def plain(rows):
    """One conversation by a shortest path search over (cost, audit), each node taken once with the least of both."""
    seen, faults = set(), []
    for _, turn, role, text in rows:
        if not text.strip(SPACE):
            faults.append("b")
        elif (role, text) in seen:
            faults.append("d")
        else:
            faults.append("t" if text.strip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, out = heapq.heappop(queue)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            break
        for role in "ua":
            if (last, role) in legal:
                heapq.heappush(queue, (cost + 2, audit + "I", at, role, (*out, ({"u": "user", "a": "assistant"}[role], ""))))
        if at < len(rows):
            _, _, own, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, last, out))
            if faults[at] in ("", "t"):
                more = faults[at] == "t"
                if (last, own[:1]) in legal:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, own[:1], (*out, (own, text))))
                for role in ("user", "assistant"):
                    if (last, role[0]) in legal:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, role[0], (*out, (role, text))))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def by_hand(rows):
    left = {}
    for row in damaged(rows):
        left.setdefault(row[0], []).append(row)
    return {conv: plain(sorted(left.get(conv, []), key=order)) for conv in {r[0] for r in rows}}


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *"vwxyz") for r in rows], SCHEMA).repartition(5)

    return make


def drawn(draw, conversations, longest):
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(draw.randrange(longest)):
            turn += draw.choice((0, 1, 1, 1, 2))
            role = draw.choice(("user", "assistant", "assistant", "system", "user", "tool", "", None, "uncle"))
            text = draw.choice(("Yes.", "No", " ", "", None, "What?", "go on \n", "漢。", "Fine!\t", f"text {draw.randrange(50)}.", f"line {draw.randrange(99)}"))
            rows.append((conv, draw.choice((turn, turn, turn, turn, None)), role, text))
    return rows


def test_random_conversations(table):
    rows = drawn(random.Random(1), 150, 14)
    assert found(repair.repair(table(rows))) == by_hand(rows)


def test_conversations_over_many_blocks(table, monkeypatch):
    """Blocks of four rows, so that most conversations go on over several; and runs of a few characters."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = drawn(random.Random(2), 60, 30)
    assert found(repair.repair(table(rows))) == by_hand(rows)


def test_prices_against_all_paths():
    """Lattice alone, from any state to any end, with and without an end of the conversation."""
    draw = random.Random(3)
    for _ in range(300):
        rows = [repair.Row(draw.choice(("s", "u", "a", "t", "")), draw.randrange(4), 1) for _ in range(draw.randrange(1, 9))]
        rows = [r._replace(weight=draw.randrange(1, 4)) if r.fault in (repair.BLANK, repair.DUPLICATE) else r for r in rows]
        got = repair.between(rows)
        for state in range(4):
            cost = {(0, state): 0}
            queue = [(0, 0, state)]
            lattice = repair.Lattice(rows, (0, 0, 0, 0), False)
            while queue:
                c, place, own = heapq.heappop(queue)
                if c > cost[place, own]:
                    continue
                for step in lattice.steps(place, own):
                    if c + step.cost < cost.get((step.place, step.state), repair.NEVER):
                        cost[step.place, step.state] = c + step.cost
                        heapq.heappush(queue, (c + step.cost, step.place, step.state))
            assert got[4 * state:4 * state + 4] == [cost.get((len(rows), end), repair.NEVER) for end in range(4)]


def test_work_is_linear_in_the_rows():
    draw = random.Random(4)
    rows = [repair.Row(draw.choice("suat"), draw.randrange(4), 1) for _ in range(4096)]
    work = [repair.Lattice(rows[:n], repair.ENDS, True).work for n in (1024, 4096)]
    assert work[1] < 5 * work[0] and work[1] < 60 * 4096


def test_one_conversation_with_most_rows(table):
    rows = [(7, i // 2, "user" if i % 3 else "assistant", f"line {i % 501}." if i % 7 else "same") for i in range(9000)]
    rows += [(8, 1, "user", "copied.")] * 3000 + [(None, None, "assistant", "Yes.")] * 500 + [(9, 0, "user", "Hi."), (9, 1, "assistant", "Ho.")]
    assert found(repair.repair(table(rows))) == by_hand(rows)


def test_edges(table):
    assert repair.repair(table([])).collect() == []
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (-3, 5, "system", "x" * 300_000)]
    got = found(repair.repair(table(rows)))
    assert got == by_hand(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == by_hand(rows)
