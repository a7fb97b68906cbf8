"""Secrets in texts: fixed patterns, and candidate strings with a window of high entropy.

Everything is column expressions. Positions come from one expression per pattern, which takes the text apart into the gaps and
the matches between them, so offsets are running sums of lengths in code points.

Candidate strings are runs of base64-like characters of at least ``WINDOW``, from the end of a string of a fixed kind to the beginning of the next. A candidate belongs to the narrowest class
that holds all its characters: hexadecimal, letters and digits, or base64. A window of ``WINDOW`` characters slides over it; going
on by one takes one from a count and adds one to another, and with the sum of c * log2(c) over the counts, kept up to date
from these two changes alone, the entropy is log2(WINDOW) - sum / WINDOW. A candidate becomes a span where the largest
entropy of its windows reaches its class's threshold, unless the allow-list knows it: identifiers with a fixed form (UUIDs), dotted or
sloped paths of plain words, and placeholder words and plain alphabets, which take their own part of the run with them. Digits alone and letters of one case alone are no candidates.

Defined results: a null text counts as the empty one; rows with a null doc_id keep it; repeated rows are scanned each;
an empty table gives no rows. A very long text costs time in proportion to its length and matches, whose positions are prefix sums built in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import prefix_sums
from .common import let, texts

# Fixed values of the contract: patterns, in this order, and the least length of what they must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
HEX = r"[0-9a-f]+"
HEX_LEAST = 32

KINDS = ("assign", "access", "hex")
WINDOW = 20
# Bits of entropy that some window must reach. Random strings of a class reach nearly their alphabet's share of log2(20) = 4.3.
THRESHOLDS = {"hexa": 2.9, "alnum": 3.6, "base64": 3.7}
# Strings that look random and are public: forms of whole runs, and words. A word that is glued to what stands before it makes its run known;
# otherwise only its own part of the run, from one / or = to the next, is.
KNOWN_FORMS = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]++(?:[/_=-]++[A-Za-z]++)*+[0-9]{0,4}$",
]
KNOWN_WORDS = r"(?i)(?:example|placeholder|changeme|your[_-]?(?:token|key|secret)|xxxxxx|dummy|abcdefghij|0123456789|1234567890)"
GLUED = KNOWN_WORDS.replace("(?i)", "(?i)[0-9a-z]")


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """Leftmost non-overlapping matches: structs of (start, stop, value), in code points.

    ``groups``: groups in the pattern; with one or more, value is its first group, else the whole match.
    """
    cut = rf"(?s)(.*?)(?:({pattern})|\z)"  # after the last match the gap runs to the end, so each character is passed once

    def place(gaps: Column, found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(cut), F.lit(3)) if groups else found
        pieces = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")), lambda p: p["hit"] != "")

        def spans(hits: Column) -> Column:
            lengths = F.transform(hits, lambda p: (F.char_length(p["gap"]) + F.char_length(p["hit"])).cast("long"))
            return let(prefix_sums(lengths), lambda ends: F.transform(hits, lambda p, i: F.struct(
                (F.get(ends, i) - F.char_length(p["hit"])).alias("start"), F.get(ends, i).alias("stop"), p["value"].alias("value"))))

        return let(pieces, spans)

    gaps, found = (F.regexp_extract_all(text, F.lit(cut), F.lit(g)) for g in (1, 2))
    none = F.array().cast(SPANS)
    return F.when(F.regexp_like(text, F.lit(pattern)), let(gaps, lambda g: let(found, lambda f: place(g, f)))).otherwise(none)


SPANS = "array<struct<start:bigint,stop:bigint,value:string>>"


def base_spans(text: Column) -> dict[str, Column]:
    """The three fixed kinds, each an array of (start, stop, value)."""
    # a maximal run of hexadecimal digits is one match, so asking for 32 or more at once drops the same runs; likewise AKIA
    return {
        "assign": F.filter(matches(text, ASSIGN, 1), lambda m: F.char_length(m["value"]) >= ASSIGN_LEAST),
        "access": matches(text, ACCESS[:-1] + "{" + str(ACCESS_LEAST - 4) + ",}"),
        "hex": matches(text, HEX[:-1] + "{" + str(HEX_LEAST) + ",}"),
    }


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of the windows of an ASCII string; null if it is shorter."""
    weight = F.lit([0.0] + [c * math.log2(c) for c in range(1, window + 1)])  # c * log2(c) by c

    def change(state: Column, code: Column, by: int) -> Column:
        """One count goes up or down; the sum changes by that count's two terms."""
        now = F.element_at(state["counts"], code + 1)
        counts = F.transform(state["counts"], lambda n, i: F.when(i == code, n + by).otherwise(n))
        return F.struct(
            counts.alias("counts"),
            (state["sum"] + F.element_at(weight, now + by + 1) - F.element_at(weight, now + 1)).alias("sum"),
            state["least"].alias("least"))

    def step(codes: Column):
        def go(state: Column, i: Column) -> Column:
            added = change(state, F.element_at(codes, i), 1)
            return let(added, lambda a: F.when(i < window, a).otherwise(let(
                F.struct(a["counts"].alias("counts"), a["sum"].alias("sum"), F.least(a["least"], a["sum"]).alias("least")),
                lambda full: F.when(i == F.size(codes), full).otherwise(
                    change(full, F.element_at(codes, i - window + 1), -1)))))
        return go

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(float("inf")).alias("least"))
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    least = let(codes, lambda cs: F.aggregate(F.sequence(F.lit(1), F.size(cs)), start, step(cs), lambda s: s["least"]))
    return F.when(F.char_length(value) >= window, F.lit(math.log2(window)) - least / window)


def string_class(value: Column) -> Column:
    """The narrowest class of a candidate; null for digits alone or letters of one case alone."""
    return (
        F.when(value.rlike("^[0-9+/_=-]+$") | value.rlike("^[a-z+/_=-]+$") | value.rlike("^[A-Z+/_=-]+$"), F.lit(None))
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hexa"))
        .when(value.rlike("[0-9]") & value.rlike("^[A-Za-z0-9]+$"), F.lit("alnum"))
        .when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.lit("base64")))


def entropy_spans(text: Column, fixed_kinds: Column) -> Column:
    """Candidates with a window of high entropy that the allow-list doesn't know: (start, stop, value).

    A candidate ends where a string of a fixed kind begins, and begins after it; ``fixed_kinds`` tells whether the text has any, as
    without them the plain runs are the candidates.
    """
    limit = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    fixed = "|".join((ASSIGN[:-2] + f"{{{ASSIGN_LEAST},}})", ACCESS[:-1] + f"{{{ACCESS_LEAST - 4},}}", HEX[:-1] + f"{{{HEX_LEAST},}}"))
    fixed = fixed.replace("([A-Za-z0-9+/_.=-]", "(?:[A-Za-z0-9+/_.=-]")
    run = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
    between = rf"(?:{fixed})|((?:(?!{fixed})[A-Za-z0-9+/_=-]){{{WINDOW},}})"
    found = F.when(~F.regexp_like(text, F.lit(run)), F.array().cast(SPANS)).when(
        fixed_kinds, matches(text, between, 1)).otherwise(matches(text, run))

    def random(part: Column) -> Column:
        kind = string_class(part)
        known = part.rlike("|".join(f"(?:{p})" for p in KNOWN_FORMS))
        return F.coalesce(F.when(kind.isNotNull() & ~known, window_entropy(part) >= F.element_at(limit, kind)), F.lit(False))

    def suspicious(m: Column) -> Column:
        value = m["value"]
        parts = F.transform(F.split(value, "[/=]"), lambda p: F.when(p.rlike(KNOWN_WORDS), F.lit(" ")).otherwise(p))
        left = F.when(value.rlike(KNOWN_WORDS), F.split(F.array_join(parts, "/"), " ")).otherwise(F.array(value))
        forms = value.rlike("|".join(f"(?:{p})" for p in KNOWN_FORMS)) | value.rlike(GLUED)
        return (value != "") & ~forms & F.exists(left, random)

    return F.filter(found, suspicious)


def apart(spans: Column, others: Column) -> Column:
    """The spans, ordered and disjoint, that overlap none of the others. All ends are sorted once and counted from left to right."""
    # at the same place: an other's end, a span's start, a span's end, an other's start
    def events(of: Column, field: str, kind: int) -> Column:
        return F.transform(of, lambda s: F.struct(s[field].cast("long").alias("at"), F.lit(kind).alias("kind")))

    line = F.array_sort(F.concat(events(others, "stop", 0), events(spans, "start", 1), events(spans, "stop", 2), events(others, "start", 3)))

    def counted(kind: int, of: Column) -> Column:
        return prefix_sums(F.transform(of, lambda e: (e["kind"] == kind).cast("long")))

    def at(kind: int, of: Column, counts: Column) -> Column:
        both = F.arrays_zip(of.alias("event"), counts.alias("count"))
        return F.transform(F.filter(both, lambda x: x["event"]["kind"] == kind), lambda x: x["count"])

    def free(of: Column) -> Column:
        begun, ended = at(2, of, counted(3, of)), at(1, of, counted(0, of))
        return let(begun, lambda b: let(ended, lambda e: F.filter(spans, lambda s, i: F.get(b, i) == F.get(e, i))))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(line, free)).otherwise(spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans are (kind, start, stop, base), in code points, the end exclusive, by start and kind.

    An entropy span that overlaps a span of the fixed kinds adds nothing and is left out.
    """
    own = texts(docs)
    found = own.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    found = found.select("doc_id", *KINDS, entropy_spans(F.col("text"), some).alias("entropy"))

    def labelled(kind: str, order: int) -> Column:
        return F.transform(kind, lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))

    base = F.array_sort(F.concat(*[labelled(k, i) for i, k in enumerate(KINDS)]))
    found = found.withColumn("base", base).withColumn("more", labelled("entropy", len(KINDS)))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", apart(F.col("more"), F.col("base")))).alias("spans"))


def span_list(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the fixed kinds' spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(k) for k in KINDS],
                          F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))
