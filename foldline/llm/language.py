"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes, with frozen counts. A byte is coded in the longest context
that the language has seen: with probability count / (total + kinds), or an escape of kinds / (total + kinds) and then in the
context one byte shorter, where the bytes that the longer one knows are excluded; after the empty context, the bytes never seen
share what is left evenly. So every context gives a distribution over all 256 values (255 ends a text), and a text's code
length is exact. The language whose tree gives the shortest code is the prediction; the score is its share when each language's
code length is read as a probability.

The trees are fitted on a bounded sample, for each language the documents of least hash: ``SAMPLE_DOCS`` and ``SAMPLE_BYTES`` at
most, and an even share of ``ALL_DOCS`` and ``ALL_BYTES``, the bounds over all languages. ``MOST_LANGUAGES`` are learned, those with the most
ids, then by name. So what the driver and each worker hold doesn't grow with the number of languages. A document of more than an eighth of its
language's bytes counts there with its beginning alone, so that none fills the sample. Every text is scored whole, in lower case; code lengths
are worked out once per distinct gram of a task as long as ``KEPT_VALUES`` hold them, and one language after the other beyond that.
A worker reads its texts in pieces of ``PIECE`` bytes, and holds what it works out about one piece besides the kept values.

Defined results: of equal code lengths the first language by name is predicted; a null text or one without a letter, or a corpus without a labelled row, gives ``und`` and score 0; rows with a
null doc_id are predicted, not learned from, and not held out; repeated rows are predicted each, and of a language's rows that share an id
one is learned from, by least hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .bytegrams import END, pieces
from .common import id_remainder, small

ORDER = 3
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 1 << 22
ALL_DOCS = 1 << 18
ALL_BYTES = 1 << 25
MOST_LANGUAGES = 4096
KEPT_VALUES = 1 << 22  # code lengths of grams that a task keeps, for all languages together
PIECE = 1 << 18  # bytes of text, of about 100 bytes each while they are worked on
UNKNOWN = "und"


def sample(learn: DataFrame, docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, all_docs: int = ALL_DOCS, all_bytes: int = ALL_BYTES,
           most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """(lang, text): for each language its documents of least hash, within all bounds."""
    learn = learn.withColumn("mix", F.xxhash64("doc_id", F.lit(7)))
    sizes = stored(learn.groupBy("lang").agg(F.approx_count_distinct("mix").alias("ids")).orderBy(
        F.col("ids").desc(), "lang").limit(most_languages), "languages")
    languages = max(1, sizes.count())
    docs, most_bytes = max(1, min(docs, all_docs // languages)), max(64, min(most_bytes, all_bytes // languages))
    slice_bytes = most_bytes // 8
    # a character has four bytes at most
    learn = learn.withColumn("text", F.when(F.octet_length("text") > slice_bytes, F.substring("text", 1, slice_bytes // 4)).otherwise(
        F.col("text")))
    learn = learn.withColumn("body", F.xxhash64("text"))
    keyed = learn.select("doc_id", "lang", "body", F.octet_length("text").cast("long").alias("size"), "mix")
    # a language may hold most rows: those of small hash are told by its number of ids, about four times as many as are wanted,
    # before they are shuffled; ``most_languages`` rows are sent
    share = F.pmod("mix", F.lit(1 << 30)) / (1 << 30)
    candidates = keyed.join(F.broadcast(sizes), "lang").withColumn("share", share).where(F.col("share") * F.col("ids") < 4 * docs).groupBy(
        "lang", "doc_id", "mix", "share").agg(F.min_by("size", "body").alias("size"), F.min("body").alias("body"))
    first = Window.partitionBy("lang").orderBy("share", "mix", "doc_id")
    chosen = candidates.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= docs).withColumn(
        "upto", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(
        (F.col("upto") <= most_bytes) | (F.col("rank") == 1)).select("lang", "doc_id", "body")
    # ``all_docs`` ids at most; equal rows are one
    return learn.join(F.broadcast(chosen), ["lang", "doc_id", "body"], "left_semi").groupBy("lang", "doc_id", "body").agg(
        F.first("text").alias("text")).select("lang", "text")


def gram_counts(learn: DataFrame, depth: int = ORDER) -> DataFrame:
    """(lang, code, n) of all grams of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text.lower().encode("utf-8", "replace"))
            for lang, data in by_lang.items():
                for codes, _ in pieces(data, depth, PIECE):
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code.view("i8")), pa.array(n.astype("i8"))],
                        ["lang", "code", "n"])

    return learn.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


# Contexts of one length: their grams and counts, and for each context its total, its kinds and what it excludes below.
Level = dict[str, np.ndarray]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key, zero where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def tree(codes: np.ndarray, counts: np.ndarray, depth: int = ORDER) -> list[Level]:
    """Levels by context length, from the counts of the longest grams."""
    levels: list[Level] = []
    for k in range(depth + 1):
        grams, inverse = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(inverse, counts).astype(np.int64)
        contexts, owner = np.unique(grams >> np.uint64(8), return_inverse=True)
        below = np.zeros(len(grams))
        if k:
            below = _look_up(levels[-1]["grams"], levels[-1]["counts"], grams & np.uint64((1 << 8 * k) - 1))
        levels.append({
            "grams": grams, "counts": n, "contexts": contexts, "totals": np.bincount(owner, n),
            "kinds": np.bincount(owner).astype(float), "excluded": np.bincount(owner, below)})
    return levels


def code_lengths(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Bits for the last byte of each gram after the others, in one language."""
    bits = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    less_total, less_kinds = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        gram = codes & np.uint64((1 << 8 * (k + 1)) - 1)
        context = gram >> np.uint64(8)
        total, kinds, excluded = (_look_up(level["contexts"], level[v], context) for v in ("totals", "kinds", "excluded"))
        count = _look_up(level["grams"], level["counts"], gram)
        seen = open_ & (total > 0)
        here, new = total - less_total, kinds - less_kinds
        coded, escaped = seen & (count > 0), seen & (count == 0) & (here + new > 0)
        bits[coded] -= np.log2(count[coded] / (here + new)[coded])
        bits[escaped] -= np.log2(new[escaped] / (here + new)[escaped])
        open_ &= ~coded
        less_total, less_kinds = np.where(seen, excluded, 0), np.where(seen, kinds, 0)
    never = np.log2(np.maximum(1, END + 1 - less_kinds))
    return bits + np.where(open_, never, 0)


class KnownLengths:
    """Code lengths of the grams seen so far, a row of all languages for each gram, ``most`` grams at most.

    Rows are added behind the others and never moved; only their grams are held in order.
    """

    def __init__(self, trees: list[list[Level]], most: int) -> None:
        self.trees, self.most = trees, most
        self.rows = np.empty((most, len(trees)))  # memory is taken as rows are written
        self.grams, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, distinct: np.ndarray) -> Iterator[np.ndarray]:
        """One array for each language: bits of the grams, which are ascending and different."""
        if len(distinct) > self.most:
            return (code_lengths(t, distinct) for t in self.trees)
        at = np.searchsorted(self.grams, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.grams):
            new = self.grams[np.minimum(at, len(self.grams) - 1)] != distinct
        if len(self.grams) + np.count_nonzero(new) > self.most:
            self.grams, self.places = self.grams[:0], self.places[:0]
            at, new = np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        if new.any():
            held, added = len(self.grams), distinct[new]
            for k, t in enumerate(self.trees):
                self.rows[held:held + len(added), k] = code_lengths(t, added)
            self.grams = np.insert(self.grams, at[new], added)
            self.places = np.insert(self.places, at[new], np.arange(held, held + len(added)))
        places = self.places[np.searchsorted(self.grams, distinct)]
        return (self.rows[places, k] for k in range(len(self.trees)))


def identify(docs: DataFrame, counts: DataFrame, depth: int = ORDER) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to ``docs`` (with ``text``), from the gram counts of a bounded sample."""
    found = counts.toArrow().to_pandas()  # as many rows as the sample has distinct grams, ``ALL_BYTES`` at most
    names = sorted(found["lang"].unique())
    trees = [tree(g["code"].to_numpy().astype("u8"), g["n"].to_numpy(), depth)
             for g in (found[found["lang"] == n].sort_values("code") for n in names)]
    model = docs.sparkSession.sparkContext.broadcast((names, trees))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = model.value
        known = KnownLengths(trees, KEPT_VALUES // max(1, len(names)))
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
            bits = np.zeros((len(data), len(names)))
            for codes, owner in pieces(data, depth, PIECE) if names else ():
                distinct, inverse = np.unique(codes, return_inverse=True)
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                for k, column in enumerate(known.of(distinct)):
                    bits[owner[first], k] += np.add.reduceat(column[inverse], first)
            best = bits.argmin(axis=1) if names else np.zeros(len(data), int)
            least = bits[np.arange(len(data)), best] if names else np.zeros(len(data))
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1) if names else np.zeros(len(data))
            lettered = [bool(names) and any(map(str.isalpha, t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [
                    pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], pa.string()),
                    pa.array(np.where(lettered, share, 0.0)),
                    pa.array(least / np.array([len(d) + 1 for d in data], float))],
                [*columns, "lang_pred", "score", "bits_per_byte"])

    shape = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema
    return docs.mapInArrow(run, shape)


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) that may be learned from: the id's remainder modulo 4 is not 2, label and text are there."""
    return docs.where((id_remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", "text")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row."""
    asked = docs.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(asked, gram_counts(sample(labelled(docs)))).drop("text")


def known_language(docs: DataFrame, least_score: float = 0.5, most_bits: float = 7.0) -> DataFrame:
    """The rows, columns as they are, whose language is known: a letter, one language clearly ahead, and a text that its tree
    codes better than ``most_bits`` a byte (evenly spread bytes take 8, running text 2 to 4)."""
    spare = {c: f"_{i}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score", "bits_per_byte")}
    judged = identify(docs.withColumnsRenamed(spare), gram_counts(sample(labelled(docs))))
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score) & (F.col("bits_per_byte") <= most_bits))
    return kept.drop("lang_pred", "score", "bits_per_byte").withColumnsRenamed({v: k for k, v in spare.items()})
