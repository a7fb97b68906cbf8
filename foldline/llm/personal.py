"""Personal data by fixed patterns and a skip-chain conditional random field.

The fixed patterns give the base spans. The field adds spans to them: it labels the candidates, each with one of the kinds or none.
Candidates are the base spans, which are observed; mentions of their numbers (below); and the remaining tokens (runs without white space)
that hold a digit or an @. Potentials are of a candidate's shape, of two neighbouring candidates' labels, and, by skip edges, of the
labels of distant candidates that resemble each other. So a number that stands with its country code in one place is found without
it in another. Tokens without a digit or an @ are never personal data of these kinds and hold no label.

A number is read over spaces, dots, brackets, dashes and slashes between its digit groups. Two resemble each other when their last
``TAIL`` digits are the same; shorter ones are too often alike by chance and resemble nothing. A mention of an observed number takes in the
groups before those digits as long as all its digits, without zeros in front, are the end of an observed number. E-mails and other tokens
with an @ resemble each other by the same local part, domain or whole, in lower case.

All candidates that resemble each other, directly or by way of others, share one hub, a variable of its own, and the skip edges go from it to
each of them: any two are two steps apart, and edges are in proportion to candidates. The hub's label is one of the kinds that are observed
among them, or any label, none too, if no kind is. So what a group has in common isn't outvoted by its number of bare mentions, and a group with
several kinds settles for one by the evidence of all its members. Neighbours and hubs make loops: messages are passed until none moves by
``SETTLED``. As many rounds as there are edges, after which all have settled where there is no loop and marginals are exact, take whole steps; after them steps
get smaller as long as messages don't calm down, down to ``LEAST_STEP``, so that every text ends. A candidate with an
observed one among those it resembles, whose marginal for a kind reaches ``SURE``, becomes a span.

Weights are fitted by pseudo-likelihood on the tokens of ``SAMPLE_DOCS`` documents at most (those of least hash that hold a
candidate, and ``SAMPLE_TOKENS`` of each at most), labelled by the patterns; the ends of an observed number, in
several ways of writing, are examples of its mentions. Half of the examples hide whether a token is valid by its pattern, so that the weights of shapes and links are learned too. Detection reads every
text whole.

Defined results: a null text counts as the empty one; rows with a null doc_id keep it and aren't learned from; repeated rows are searched
each, and of those that share an id one is learned from, by least hash of the text; a corpus
without a candidate has no model and adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, texts

# Fixed values of the contract: kinds, in this order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"  # a match never begins inside a run of digits
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SAMPLE_DOCS = 4000
SAMPLE_TOKENS = 64
SURE = 0.5
TAIL = 6
SETTLED = 1e-9
LEAST_STEP = 1e-3
CALM_ROUNDS = 16
N_LABELS = len(KINDS) + 1  # 0: none

Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def finder() -> Callable[[str], list[Span]]:
    """A function that gives a text's base spans, by start and kind."""
    domain, ip, card, phone, digit = (re.compile(p) for p in (DOMAIN, IP, CARD, PHONE, "[0-9]"))

    def emails(text: str) -> Iterator[Span]:
        # from one @ to the next: the longest local part before it that no earlier match holds, and the domain after it
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL_PART:
                start -= 1
            found = domain.match(text, at + 1) if start < at else None
            if found:
                done = found.end()
                yield start, 0, done
            at = text.find("@", max(at + 1, done))

    def find(text: str) -> list[Span]:
        spans = list(emails(text)) if "@" in text else []
        if digit.search(text):
            for m in ip.finditer(text):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                    spans.append((m.start(), 1, m.end()))
            for m in card.finditer(text):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
            if "+" in text:
                for m in phone.finditer(text):
                    if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        spans.append((m.start(), 3, m.end()))
        return sorted(spans)

    return find


SHAPES = ("bias", "at sign", "digits 1-3", "digits 4-6", "digits 7-8", "digits 9-11", "digits 12-19", "digits 20+", "plus", "bracket",
          "letters", "dash", "one dot", "three dots", "valid email", "valid ip", "valid card", "valid phone")
FIRST_VALID = SHAPES.index("valid email")


DIGITS = re.compile("[0-9]+")
JOINT = re.compile(r"[\x20\u00a0().\-/]+")  # what may stand between a number's digit groups
JOINTS = ("", " ", ".", "-", "/")
WORD_BETWEEN = re.compile(r"\s\S+\s")
AROUND_AT = re.compile(r"([A-Za-z0-9._%+-]*)@([A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*)")

Place = tuple[int, int]
Key = tuple[str, str]


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def tails_of(text: str) -> set[Key]:
    digits = digits_of(text)
    return {("number", digits[-TAIL:])} if len(digits) >= TAIL else set()


def address_keys(text: str) -> set[Key]:
    """The local parts and domains around a text's @."""
    return {(part, found.lower()) for m in AROUND_AT.finditer(text) for part, found in (("local", m[1]), ("domain", m[2])) if found}


def shape(word: str, valid: set[int]) -> list[float]:
    """One row, by SHAPES."""
    digits = digits_of(word)
    size = next((i for i, top in enumerate((3, 6, 8, 11, 19)) if len(digits) <= top), 5)
    return [1, "@" in word, *[len(digits) > 0 and size == i for i in range(6)], "+" in word, "(" in word, any(map(str.isalpha, word)),
            "-" in word, word.count(".") == 1, word.count(".") == 3, *[i in valid for i in range(len(KINDS))]]


def number_place(text: str, start: int, end: int) -> Place:
    """With a plus, or a bracket that is closed inside, before the first digit."""
    if start and (text[start - 1] == "+" or text[start - 1] == "(" and ")" in text[start:end]):
        return start - 1, end
    return start, end


def stretches(text: str, taken: list[Place]) -> Iterator[list[Place]]:
    """The digit groups outside the taken places, those of one number or of several side by side together."""
    found: list[Place] = []
    k = 0
    for m in DIGITS.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        if found and not JOINT.fullmatch(text, found[-1][1], start):
            yield found
            found = []
        found.append((start, end))
    if found:
        yield found


def readings(word: str, kind: int) -> set[str]:
    """The digits of an observed number: all, and without what follows a space where the rest is a number by itself.

    The patterns take in a number that stands behind: '+1 (702) 555-0742 12'. An address's parts are read without zeros in front.
    """
    if kind == 1:
        return {"".join(p.lstrip("0") or "0" for p in word.split("."))}
    out, whole = set(), ""
    for piece in word.split(" "):
        own = digits_of(piece)
        whole += own
        if len(own) >= TAIL or (9 <= len(whole) if kind == 3 else 12 <= len(whole) and luhn(whole)):
            out.add(whole)
    return out | {whole}


def mentions(text: str, taken: list[Place], numbers: set[str]) -> Iterator[tuple[Place, set[Key]]]:
    """Places outside the taken ones that end like one of the numbers, with their keys."""
    tails = {n[-TAIL:] for n in numbers if len(n) >= TAIL}
    ends = {n[-k:] for n in numbers for k in range(TAIL, len(n) + 1)}
    if not tails:
        return
    for groups in stretches(text, taken):
        hits: list[tuple[int, int, set[Key]]] = []  # first and last group
        for last in range(len(groups)):
            first, digits = last, text[slice(*groups[last])]
            while len(digits) < TAIL and first:
                first -= 1
                digits = text[slice(*groups[first])] + digits
            if digits[-TAIL:] not in tails or len(digits) < TAIL:
                continue
            keys = {("number", digits[-TAIL:])}
            if digits.lstrip("0") in ends or digits in ends:
                while first:
                    more = text[slice(*groups[first - 1])] + digits
                    if more not in ends and more.lstrip("0") not in ends:
                        break
                    first, digits = first - 1, more
            while hits and hits[-1][1] >= first:
                before = hits.pop()
                first, keys = min(first, before[0]), keys | before[2]
            hits.append((first, last, keys))
        for first, last, keys in hits:
            yield number_place(text, groups[first][0], groups[last][1]), keys


def tokens_of(text: str, spans: list[Span], find: Callable[[str], list[Span]]) \
        -> tuple[list[Place], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, shapes, observed, chain, groups) of a text's candidates, by place.

    places: without punctuation around them; shapes: one row each, by SHAPES; observed: the label of a base span, else -1; chain: pairs
    of neighbours; groups: for each candidate a number, the same for those that resemble each other.
    """
    units: list[tuple[Place, int, set[Key]]] = []
    numbers: set[str] = set()
    for start, kind, end in spans:
        word = text[start:end]
        if kind == 0:
            keys = address_keys(word)
        else:
            read = readings(word, kind)
            keys = {key for n in read for key in tails_of(n)}
            numbers |= read
        if units and units[-1][0][1] > start:  # overlapping spans are one candidate, of the first one's kind
            place, label, more = units[-1]
            units[-1] = (place[0], max(place[1], end)), label, more | keys
        else:
            units.append(((start, end), 1 + kind, keys))
    base = [place for place, _, _ in units]
    units += [(place, -1, keys) for place, keys in mentions(text, base, numbers)]
    units.sort(key=lambda u: u[0])
    taken = [place for place, _, _ in units]
    k = 0
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if "@" not in word and not DIGITS.search(word):
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        core = word.strip(".,;:!?\"'()[]{}<>|#$%&*")
        start = m.start() + word.find(core)
        units.append(((start, start + len(core)), -1, address_keys(core) | {("token", core.lower())} if "@" in core else tails_of(core)))
    units.sort(key=lambda u: u[0])

    parent = list(range(len(units)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[Key, int] = {}
    for i, (_, _, keys) in enumerate(units):
        for key in keys:
            a, b = sorted((root(first.setdefault(key, i)), root(i)))
            parent[b] = a
    places = [place for place, _, _ in units]
    shapes = []
    for start, end in places:
        core = text[start:end]
        shapes.append(shape(core, {kind for _, kind, _ in find(core)}))
    chain = [(i - 1, i) for i in range(1, len(places)) if not WORD_BETWEEN.search(text, places[i - 1][1], places[i][0])]
    return (places, np.array(shapes, float).reshape(-1, len(SHAPES)), np.array([label for _, label, _ in units], int),
            np.array(chain, int).reshape(-1, 2), np.array([root(i) for i in range(len(units))], int))


def group_labels(observed: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(group x labels): how many of its candidates have a label, none for those that aren't observed."""
    counts = np.zeros((len(groups), N_LABELS))
    np.add.at(counts, (groups, np.maximum(observed, 0)), 1)
    return counts


def hub_labels(counts: np.ndarray) -> np.ndarray:
    """The labels that a group's hub speaks for: each kind in the group, none if there is no kind."""
    hubs = counts > 0
    hubs[:, 0] &= ~hubs[:, 1:].any(axis=1)
    return hubs


def number_ends(text: str, start: int, end: int) -> Iterator[str]:
    """How a number may be mentioned: its last digit groups as they are, and written with another joint or zeros in front."""
    groups = [m.span() for m in DIGITS.finditer(text, start, end)]
    for k in range(len(groups)):
        parts = [text[a:b] for a, b in groups[k:]]
        digits = "".join(parts)
        if len(digits) < TAIL:
            break
        if k:
            a, b = number_place(text, groups[k][0], end)
            yield text[a:b]
        # the number itself says which, so that all ways are met evenly
        choice, joint = divmod(int(digits) // 10, len(JOINTS))
        zeros = "" if choice % 2 else "0" if k else "00"
        yield zeros + JOINTS[joint].join(parts)


def examples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """(shape, chain, skip, label): candidate tokens with the summed one-hot labels of their neighbours by either kind of edge."""
    candidates = texts(docs).where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).withColumn("body", F.xxhash64("text"))
    chosen = candidates.groupBy("doc_id").agg(F.min("body").alias("body")).orderBy(
        F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                places, shapes, observed, pairs, groups = tokens_of(text, find(text), find)
                label = np.maximum(observed, 0)
                chain, own = np.zeros((len(label), N_LABELS)), np.eye(N_LABELS)[label]
                np.add.at(chain, pairs[:, 0], own[pairs[:, 1]])
                np.add.at(chain, pairs[:, 1], own[pairs[:, 0]])
                skip = hub_labels(group_labels(observed, groups)[groups] - own).astype(float)  # the hubs by all others
                # linked and labelled tokens first: they are the rare ones
                order = np.lexsort((np.arange(len(label)), -1.0 * (label > 0) - skip.sum(axis=1)))[:sample_tokens]
                rows = []
                for i in order.tolist():
                    rows.append((shapes[i].tolist(), chain[i].tolist(), skip[i].tolist(), int(label[i])))
                    if label[i] > 2:
                        rows += [(shape(end, {kind for _, kind, _ in find(end)}), [0.0] * N_LABELS, own[i].tolist(), int(label[i]))
                                 for end in number_ends(text, *places[i])]
                out += [{"shape": list(map(float, a)), "chain": b, "skip": c, "label": d} for a, b, c, d in rows[:sample_tokens]]
            yield pa.RecordBatch.from_pylist(out, schema=EXAMPLE)

    # at most ``sample_docs`` ids; equal rows are one
    sample = candidates.join(F.broadcast(chosen), ["doc_id", "body"], "left_semi").groupBy("doc_id", "body").agg(F.first("text").alias("text"))
    return sample.mapInArrow(
        run, "shape array<double>, chain array<double>, skip array<double>, label int")


EXAMPLE = pa.schema([("shape", pa.list_(pa.float64())), ("chain", pa.list_(pa.float64())), ("skip", pa.list_(pa.float64())),
                     ("label", pa.int32())])

Model = dict[str, np.ndarray]  # unary (SHAPES x labels), chain and skip (labels x labels)


def fit(rows: pa.Table, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Model | None:
    """Weights of least pseudo-likelihood loss, by gradient steps with one rate per weight."""
    if not rows.num_rows:
        return None
    shape, chain, skip = (np.array(rows.column(c).to_pylist()) for c in ("shape", "chain", "skip"))
    label = rows.column("label").to_numpy()
    hidden = shape.copy()
    hidden[:, FIRST_VALID:] = 0
    linked = skip.sum(axis=1) > 0
    x = np.vstack([np.hstack([shape, chain, skip]), np.hstack([hidden, chain, skip])[linked]])
    y = np.eye(N_LABELS)[np.concatenate([label, label[linked]])]
    w, squares = np.zeros((x.shape[1], N_LABELS)), np.full((x.shape[1], N_LABELS), 1e-8)
    n = len(SHAPES)
    same = np.eye(N_LABELS)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - y) / len(x) + ridge * w
        slope[n + N_LABELS:] = same * np.trace(slope[n + N_LABELS:])  # one weight for linked tokens that agree, whatever the kind
        squares += slope * slope
        w -= rate * slope / np.sqrt(squares)
    chain_w, skip_w = w[n:n + N_LABELS], w[n + N_LABELS:]
    # an edge has one potential for both of its ends
    return {"unary": w[:n], "chain": (chain_w + chain_w.T) / 2, "skip": (skip_w + skip_w.T) / 2}


def marginals(model: Model, shapes: np.ndarray, observed: np.ndarray, edges: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Each variable's probability of each label, by loopy message passing; exact where the edges between unobserved ones make no loop.

    edges: (first, second, 0 neighbours or 1 skip); allowed: the labels that a variable may have, all if not given.
    """
    unary = shapes @ model["unary"]
    if allowed is not None:
        unary[~allowed] = -np.inf
    seen = observed >= 0
    unary[seen] = np.where(np.arange(N_LABELS) == observed[seen][:, None], 0.0, -np.inf)
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        kind = np.tile(edges[:, 2], 2)
        pair = np.stack([model["chain"], model["skip"]])
        # an observed token says the same in every round
        known = seen[source] & ~seen[target]
        np.add.at(unary, target[known], pair[kind[known], observed[source[known]]])
        free = ~seen[source] & ~seen[target]
        source, target, pair = source[free], target[free], pair[kind[free]]
        half = len(source) // 2
        back = np.concatenate([np.arange(half) + half, np.arange(half)])
        message = np.zeros((len(source), N_LABELS))
        belief = unary
        step, calm = 1.0, np.inf
        for turn in count():
            sent = belief[source] - message[back]
            new = np.logaddexp.reduce(sent[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            moved = np.abs(new - message).max(initial=0)
            message = message + step * (new - message)
            belief = unary.copy()
            np.add.at(belief, target, message)
            if moved < SETTLED or step < LEAST_STEP:
                break
            if turn > half and turn % CALM_ROUNDS == 0:  # without loops no path is longer, and all have settled by then
                if moved > calm / 2:
                    step *= 0.7
                calm = min(calm, moved)
        unary = belief
    unary = np.exp(unary - unary.max(axis=1, keepdims=True))
    return unary / unary.sum(axis=1, keepdims=True)


def with_hubs(shapes: np.ndarray, observed: np.ndarray, chain: np.ndarray, groups: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shapes, observed, edges, allowed) of the candidates and, behind them, the hub of each group of two or more."""
    counts, n = group_labels(observed, groups), len(observed)
    shared = np.flatnonzero(counts.sum(axis=1) > 1)
    number = np.full(n, -1)
    number[shared] = n + np.arange(len(shared))
    kinds = hub_labels(counts[shared])
    may = kinds | kinds[:, :1]  # no kind: any label
    label = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1)
    members = np.flatnonzero(number[groups] >= 0)
    skips = np.stack([number[groups[members]], members, np.ones(len(members), int)], axis=1)
    edges = np.concatenate([np.hstack([chain, np.zeros((len(chain), 1), int)]), skips])
    return (np.concatenate([shapes, np.zeros((len(shared), len(SHAPES)))]), np.concatenate([observed, label]), edges,
            np.concatenate([np.ones((n, N_LABELS), bool), may]))


def added_spans(text: str, base: list[Span], find: Callable[[str], list[Span]], model: Model | None, sure: float = SURE) -> list[Span]:
    """Spans of candidates that the field is sure of. None overlaps a base span."""
    if model is None or not base:  # what isn't linked to an observed token has the label of its shape alone: none, by the patterns
        return []
    places, shapes, observed, chain, groups = tokens_of(text, base, find)
    linked = group_labels(observed, groups)[groups, 1:].any(axis=1)
    if not (linked & (observed < 0)).any():
        return []
    chance = marginals(model, *with_hubs(shapes, observed, chain, groups))[:len(places)]
    label = np.where((observed < 0) & linked & (chance.max(axis=1) >= sure), chance.argmax(axis=1), 0)
    return [(places[i][0], int(label[i]) - 1, places[i][1]) for i in np.flatnonzero(label).tolist() if places[i][0] < places[i][1]]


def trained(docs: DataFrame) -> Model | None:
    return fit(examples(docs).toArrow())  # bounded by SAMPLE_DOCS * SAMPLE_TOKENS rows


def span_list(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in small(batches):
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            digests, found = [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                base = find(text)
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests.append(hashlib.sha256(span_list(base).encode()).hexdigest())
                found.append(span_list(sorted(base + added_spans(text, base, find, model))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(found, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", " + ", ".join(
        f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, columns as they are, with every span in the text replaced by its kind in brackets; a column n_chars is kept right.

    A text without a span, and a null one, stay as they are. Spans that overlap are replaced as one, by the first one's kind.
    """
    names = docs.columns
    sized = "n_chars" in names

    def clean(text: str, find: Callable[[str], list[Span]]) -> str:
        base = find(text)
        spans = sorted(base + added_spans(text, base, find, model))
        while spans:  # what a replaced span stood beside may match now; every round leaves fewer digits and @
            out, done = [], 0
            for start, kind, end in spans:
                if start >= done:
                    out += [text[done:start], f"[{KINDS[kind].upper()}]"]
                done = max(done, end)
            text = "".join(out) + text[done:]
            spans = find(text)
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in small(batches):
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            before = columns["text"].to_pylist()
            after = [t if t is None else clean(t, find) for t in before]
            if sized:
                sizes = columns["n_chars"].to_pylist()
                sizes = [n if a == b else len(a) for n, a, b in zip(sizes, after, before)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            columns["text"] = pa.array(after, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)
