"""Document text, prompts, id sequences, padding, masks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_tokens, let, stable_draw, tokens
from .lookup import skew_join
from .ordering import hashed_ranks, positions

# Instruction and prefix texts by name.
INSTRUCTIONS = {
    "base": "Write a high-quality answer for the given question using only the provided search results"
            "(some of which might be irrelevant).\n\n",
    "short": "Answer the Question based on the given text. Only give me the answer and do not output any other words.\nText:",
    "repeat": "Restate the aforementioned Text.",
    "ft_prefix": "Search results:",
    "rs_prefix": "Text:",
    "pwc": "Answer the Question based on the given Text. \nText:",
    "empty": "",
}

# Longest answer in tokens by data set.
MAX_NEW_TOKENS = {
    "NQ": 100, "HQA": 32, "TQA": 32, "MQA": 100, "NARRA": 128, "GOV": 512,
    "NEWS": 512, "QSUM": 512, "NYC": 32, "CA": 32, "TKY": 32,
}

# Batch size by data set.
BATCH_SIZES = {"NQ": 1, "HQA": 1, "MQA": 1, "NARRA": 1, "NEWS": 1, "NYC": 1, "CA": 1, "TKY": 1}

IGNORED = -100


def lookup(values: dict, key: Column, strict: bool = False, what: str = "name") -> Column:
    """Value of a small fixed dictionary; an unknown key is null, or an error when ``strict``."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null")))))


def document_text(ctx: Column, max_tokens: int | None = None) -> Column:
    """Title and text with a space between; only the text when there is no title."""
    whole = F.when(ctx["title"].isNull(), ctx["text"]).otherwise(F.concat(ctx["title"], F.lit(" "), ctx["text"]))
    return first_tokens(whole, max_tokens)


def documents(ctxs: Column, max_tokens: int | None = None) -> Column:
    return F.transform(ctxs, lambda c: document_text(c, max_tokens))


def joined_documents(docs: Column, num_documents: int | Column | None = None, max_doc_tokens: int | None = None) -> Column:
    """The first ``num_documents`` documents on lines of their own, cut to ``max_doc_tokens`` tokens."""
    if num_documents is not None:
        docs = F.slice(docs, F.lit(1), num_documents if isinstance(num_documents, Column) else F.lit(num_documents))
    return first_tokens(F.array_join(docs, "\n"), max_doc_tokens)


def drawn_cap(batch_id: Column, low: int, high: int, seed: int) -> Column:
    """One number of documents in [low, high] per batch."""
    return F.lit(low) + stable_draw(batch_id, seed, high - low + 1)


def drawn_choice(key: Column, choices: str | list[int], seed: int) -> Column:
    """One of the numbers of a list, or of a comma-separated text."""
    numbers = [int(x) for x in choices.split(",")] if isinstance(choices, str) else list(choices)
    return F.array(*[F.lit(n) for n in numbers])[stable_draw(key, seed, len(numbers)).cast("int")]


def drawn_ratio(key: Column, seed: int) -> Column:
    """A ratio in (0, 1]: the same for every worker that sees the key."""
    return F.lit(1.0) - stable_draw(key, seed, 1 << 24) / F.lit(float(1 << 24))


def question_prompt(question: Column, training: bool = False) -> Column:
    return F.concat(F.lit("\nQuestion:" if training else "Question:"), question, F.lit("\nAnswer:"))


def restatement_pairs(df: DataFrame, docs: str, num_documents: int, max_doc_tokens: int) -> DataFrame:
    """Context, the instruction to restate it, and the same context as target."""
    context = joined_documents(F.col(docs), num_documents, max_doc_tokens)
    return df.withColumns({"context": context, "instruction": F.lit(INSTRUCTIONS["repeat"]), "target": context})


def pad_ids(ids: Column, width: Column, pad: int = 0, side: str = "right") -> tuple[Column, Column]:
    """Ids padded to ``width`` and their 0/1 mask."""
    gap = F.greatest(width - F.size(ids), F.lit(0)).cast("int")
    ones, zeros = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)
    pads = F.array_repeat(F.lit(pad).cast("long"), gap)
    wide = ids.cast("array<long>")
    if side == "left":
        return F.concat(pads, wide), F.concat(zeros, ones)
    return F.concat(wide, pads), F.concat(ones, zeros)


def pad_batches(df: DataFrame, ids: str, batch: str, side: str, pad: int = 0, length: Column | None = None) -> DataFrame:
    """Pads to the longest sequence of the batch. The maximum combines on the map side and is joined back,
    so that no batch has to fit into one task. ``length`` gives the length where it is known without the ids."""
    widths = df.groupBy(batch).agg(F.max(F.size(ids) if length is None else length).alias("_width"))
    padded, mask = pad_ids(F.col(ids), F.col("_width"), pad, side)
    return df.join(widths, batch).withColumns({"padded": padded, "mask": mask}).drop("_width")


def pad_global(df: DataFrame, ids: str, pad: int = 0) -> DataFrame:
    """Pads to the longest sequence of all. The one-row maximum is joined by a constant key."""
    width = df.agg(F.max(F.size(ids)).alias("_width")).withColumn("_one", F.lit(1))
    padded, mask = pad_ids(F.col(ids), F.col("_width"), pad)
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(width), "_one").withColumns(
        {"padded": padded, "mask": mask}).drop("_width", "_one")


def pad_memories(df: DataFrame, memories: str, batch: str, dim: int) -> DataFrame:
    """Pads lists of vectors with zero vectors; mask 0 on the pads and on a row whose vectors are all zero."""
    widths = df.groupBy(batch).agg(F.max(F.size(memories)).alias("_width"))
    gap = F.col("_width") - F.size(memories)
    zero = F.array_repeat(F.lit(0.0), dim)
    live = F.exists(F.col(memories), lambda v: F.exists(v, lambda x: x != 0)).cast("int")
    return df.join(widths, batch).withColumns({
        "padded": F.concat(F.col(memories), F.array_repeat(zero, gap)),
        "mask": F.concat(F.array_repeat(live, F.size(memories)), F.array_repeat(F.lit(0), gap)),
    }).drop("_width")


def assemble_ids(*parts: Column) -> Column:
    """Instruction, memory, question and answer ids one after the other; a missing part counts as empty."""
    empty = F.array().cast("array<long>")
    return F.concat(*[F.coalesce(p.cast("array<long>"), empty) for p in parts])


def label_ids(total: Column, target: Column, target_mask: Column) -> Column:
    """-100 on all positions but the real target tokens at the end."""
    shown = F.zip_with(target.cast("array<long>"), target_mask,
                       lambda t, m: F.when(m == 1, t).otherwise(F.lit(IGNORED).cast("long")))
    return F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), (total - F.size(target)).cast("int")), shown)


def next_token_pairs(ids: Column, labels: Column) -> Column:
    """(pos, id, label) with position t paired with label t + 1; the last position has none."""
    def pairs(side: Column) -> Column:
        n = F.size(side["ids"]) - 1
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda t: F.struct(
            t.alias("pos"), F.get(side["ids"], t).alias("id"), F.get(side["labels"], t + 1).alias("label")))

    return let(F.struct(ids.alias("ids"), labels.alias("labels")), pairs)


def gather(items: Column, wanted: Column) -> Column:
    """The elements at 0-based positions, in the order asked for."""
    return let(items, lambda all_items: F.transform(wanted, lambda i: F.get(all_items, i)))


def replace_nested(value: Column, target: int, by: int, depth: int = 1) -> Column:
    """Replaces a value at the leaves of arrays nested ``depth`` deep."""
    if depth == 0:
        return F.when(value == target, F.lit(by)).otherwise(value)
    return F.transform(value, lambda x: replace_nested(x, target, by, depth - 1))


def assign_batches(df: DataFrame, dataset: str, order: str, size: Column) -> DataFrame:
    """Consecutive batches per data set, without shuffling the order."""
    return positions(df, [dataset], order, "_at").withColumn(
        "batch_id", F.floor(F.col("_at") / size).cast("long")).drop("_at")


def generation_cap(tokens_col: Column, dataset: Column) -> Column:
    """The predicted tokens up to the data set's limit."""
    return F.slice(tokens_col, F.lit(1), lookup(MAX_NEW_TOKENS, dataset, True, "data set"))


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """Distinct tokens with dense ids and how often each occurs."""
    words = texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return hashed_ranks(words, "token", "token_id")


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Token rows with ids; a word seen everywhere is not shuffled. A word outside the vocabulary gets the id ``unknown``, so
    that no position goes missing. Reads ``vocab`` (token, token_id, n) twice."""
    rows = df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    found = skew_join(rows, vocab.select("token", "token_id"), "token", vocab.select("token", "n"), how="left")
    return found.withColumn("token_id", F.coalesce("token_id", F.lit(unknown).cast("long")))
