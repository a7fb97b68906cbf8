"""Text columns: tokens, answer normalisation and stable draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What Python counts as whitespace, which is Unicode's set and four control characters.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The words dropped from answers before they are compared.
ARTICLES = ("a", "an", "the")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once per row. An expression named inside a lambda of another
    array function would be worked out again for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Whitespace tokens; an empty or blank text has none."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def first_tokens(text: Column, n: int | None, tokeniser=None) -> Column:
    """The first ``n`` tokens as text, or the text itself when ``n`` is None; words between white space, unless a tokeniser is given."""
    if n is None:
        return text
    return F.array_join(F.slice(tokens(text), 1, n), " ") if tokeniser is None else tokeniser.head(text, n)


def normalize_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    articles = r"(?U)\b(" + "|".join(ARTICLES) + r")\b"
    return F.array_join(tokens(F.regexp_replace(bare, articles, " ")), " ")


def stable_hash(value: Column) -> Column:
    """60-bit number from the MD5 of a string: equal in every engine, task and partitioning."""
    return F.conv(F.left(F.md5(value), F.lit(15)), 16, 10).cast("long")


def runs(items: Column) -> Column:
    """Distinct elements with how often each occurs, as (item, n) in ascending order; one sort, then one pass."""
    def counted(sorted_items: Column) -> Column:
        n = F.size(sorted_items)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (F.get(sorted_items, i) != F.get(sorted_items, i - 1)))
        return let(first, lambda starts: F.transform(starts, lambda at, k: F.struct(
            F.get(sorted_items, at).alias("item"), (F.coalesce(F.get(starts, k + 1), n) - at).cast("long").alias("n"))))

    return let(F.array_sort(items), counted)


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Running sums of an array of longs, the element itself included.

    An array that grows by an element per step is copied per step, so sums are built in blocks and the blocks are put together: an element
    is copied ``block`` / 2 times at most, a block once per later block.
    """
    def inside(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(part, start, lambda state, x: F.struct(
            (state["total"] + x).alias("total"), F.concat(state["sums"], F.array(state["total"] + x)).alias("sums")))

    def whole(items: Column) -> Column:
        starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(block))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<bigint>>").alias("blocks"))

        def step(state: Column, at: Column) -> Column:
            return let(inside(F.slice(items, at, F.lit(block)), state["total"]), lambda done: F.struct(
                done["total"].alias("total"), F.concat(state["blocks"], F.array(done["sums"])).alias("blocks")))

        return F.aggregate(starts, start, step, lambda state: F.flatten(state["blocks"]))

    return let(values, whole)


def stable_draw(key: Column, seed: int, n: Column | int) -> Column:
    """Reproducible draw in [0, n) for one key; does not depend on partitions or retries."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(stable_hash(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), n.cast("long"))
