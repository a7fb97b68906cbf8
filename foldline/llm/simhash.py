"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Bit position i gets a non-zero vector m(i) of r + 1 bits; table v (each non-zero vector
of r + 1 bits) keeps the positions whose m(i) has an odd inner product with v. Two fingerprints that differ in at most r
positions differ in positions whose vectors span at most r dimensions, so some v is orthogonal to all of them: in that
table both have the same masked value. With r = 3 these are 15 tables, and no pair within the radius is missed.

Equal fingerprints are one node. A bucket (table, masked value) is searched as an implicit graph, without a list of
pairs: a node leaves the rest of its bucket when it is reached, so a bucket of near copies costs about one pass. A
bucket beyond ``CELL`` fingerprints is dealt out as pairs of its parts, each pair to a task of its own.

Defined results: a null text counts as the empty one, whose fingerprint is zero; rows with a null doc_id take no part;
rows that share a doc_id count as one document and are each returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .common import texts
from .graph import components

RADIUS = 3
CELL = 1 << 13
HEAVY_BROADCAST = 100_000  # rows of (bucket, size): a few MB


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits for each table; position i has the vector 1 + i mod (2^(radius+1) - 1)."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % tables) & v).bit_count() % 2) for v in range(1, tables + 1)]


def fingerprint_of(text: str, width: int = 3) -> int:
    """The 64 bits of a text: of its word shingles' hashes, each bit that is set in over half of them."""
    import xxhash

    # bytes.lower() and bytes.split() know ASCII alone: A to Z, and the six white space bytes
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(first.tolist(), last.tolist())), "<u8", len(last))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column("text")), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    own = texts(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, fp long")


def _search(fp: np.ndarray, node: np.ndarray, radius: int, links: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Appends, for each connected group of a bucket, the links of its members to the member that was reached first."""
    rest_fp, rest_node = fp, node
    while len(rest_fp) > 1:
        root, queue = rest_node[0], [rest_fp[0]]
        rest_fp, rest_node = rest_fp[1:], rest_node[1:]
        while queue and len(rest_fp):
            near = np.bitwise_count(rest_fp ^ queue.pop()) <= radius
            if near.any():
                links.append((rest_node[near], np.full(int(near.sum()), root)))
                queue.extend(rest_fp[near])
                rest_fp, rest_node = rest_fp[~near], rest_node[~near]


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): links between representatives that join the same fingerprints as all pairs within the radius would.

    ``prints``: (node, fp), each fp once.
    """
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("mask")) for v, m in enumerate(masks(radius))])
    keyed = prints.select("node", "fp", F.explode(tables).alias("t")).select(
        "node", "fp", F.xxhash64("t.v", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("bucket"))
    heavy = stored(
        keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cell), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= HEAVY_BROADCAST else heavy
    parts = F.ceil(F.coalesce("size", F.lit(1)) / cell).cast("int")
    own = F.pmod(F.hash("fp"), F.col("parts"))
    # part p of a bucket meets parts p, p + 1, ... of it: a cell is a pair (low, high) of parts
    cells = keyed.join(heavy, "bucket", "left").withColumn("parts", parts).withColumn("own", own).select(
        "node", "fp", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "own").select(
        "node", "fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, "i8")] * 3

        def search(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, node, fp = columns
            fp, found = fp.view("u8"), []
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(key)))
            pair = starts[sizes == 2]
            pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius]
            found.append((node[pair], node[pair + 1]))
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                _search(fp[at:at + n], node[at:at + n], radius, found)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[i] for x in found]).astype("i8")) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [np.concatenate((x, batch.column(n).to_numpy())) for x, n in zip(left, ("cell", "node", "fp"))]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            left = [x[cut:] for x in columns]
            if cut:
                yield search([x[:cut] for x in columns])
        yield search(left)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the component is the least doc_id that links can reach."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes, radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # a class of thousands of copies is a hot fp: the join splits it
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id; rows without a doc_id stay."""
    classes = near_duplicates(docs, radius)
    # one row per id, the least fingerprint's, for ids that several texts share
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    one = docs.join(kept, docs.doc_id == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
