"""Vector code compression: product codes whose codebooks are trained over a trie of distinct parts.

A vector is scaled and floored to integers and cut into equal parts. For each part position the
distinct parts of the whole table, with their counts, are stored once in lexicographic order. Every
round walks the trie that this order spells: a node is a prefix of dimensions and holds the squared
distances of that prefix to all codebook entries, so parts with a common prefix share that work;
a leaf (a whole part) takes the nearest entry and adds its count and its weighted components to that
entry's sums. The walk is depth first, in blocks of leaves: only the block's nodes and the path to
the last leaf are held.

What reaches the driver is one row per (part position, entry): the codebooks, of a fixed size.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. The
length of the vector with the smallest id counts; vectors of another length, and all vectors if that
length can't be cut into equal parts, can't be coded and are dropped as well. Rows with equal vectors
are coded alike, repeated ids stay repeated, null ids come last. With fewer rows than entries a
codebook has as many entries as there are rows. Ties go to the lower entry. An empty table gives no
rows. Distances are exact 64-bit integers; a scaled component beyond ``LARGEST`` raises, as the
error of such a vector has no 64-bit value in general.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096

#: Scaled components up to this keep squared distances and their sums inside 64 bits.
LARGEST = 1 << 27

#: Leaves handled at a time; a block's largest array has this many rows and one column per entry.
BLOCK = 8192


@dataclass
class Codebooks:
    """Entries by part position: arrays of shape (entries, components)."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
        flat = ",".join(str(x) for book in self.entries for x in book.ravel().tolist())
        return hashlib.sha256(flat.encode()).hexdigest()


class TrieWalk:
    """Depth-first walk over lexicographically sorted parts, sharing distances along prefixes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.last: np.ndarray | None = None  # the last leaf, and the distances on the path to it
        self.path: list[np.ndarray] = []

    def distances(self, leaves: np.ndarray) -> np.ndarray:
        """Squared distances (leaf, entry) of the next leaves in order."""
        n, size = leaves.shape
        before = np.vstack([leaves[:1] if self.last is None else self.last[None], leaves[:-1]])
        differs = leaves != before
        fork = np.where(differs.any(axis=1), differs.argmax(axis=1), size) if size else np.zeros(n, np.int64)
        if self.last is None:
            fork[0] = 0  # the first leaf has no path to share
        node, sums = np.zeros(n, np.int64), np.zeros((1, len(self.entries)), np.int64)
        path = []
        for depth in range(size):
            made = fork <= depth  # leaves whose prefix of this depth is a new node
            grown = sums[node[made]] + (leaves[made, depth][:, None] - self.entries[:, depth]) ** 2
            if not made[0]:  # the block begins below a node of the path
                grown = np.vstack([self.path[depth], grown])
            node = np.cumsum(made) - int(made[0])
            sums = grown
            path.append(sums[-1])
        self.last, self.path = leaves[-1], path
        return sums[node]


def blocks(parts: np.ndarray) -> Iterator[slice]:
    for at in range(0, len(parts), BLOCK):
        yield slice(at, at + BLOCK)


def as_matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A list column without nulls whose lists all have ``size`` items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def usable(vector: Column) -> Column:
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite))


def scaled(vectors: DataFrame, vector: str, keep: dict[str, str], scale: int) -> DataFrame:
    """``keep`` (new name -> column) and ``cells``, the floored scaled components of usable vectors."""
    double = F.col(vector).cast("array<double>")
    cell = lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(
        F.raise_error(F.concat(F.lit("component too large to code: "), v.cast("string"))).cast("bigint"))
    return vectors.where(usable(double)).select(*[F.col(c).alias(name) for name, c in keep.items()], F.transform(double, cell).alias("cells"))


def distinct_parts(cells: DataFrame, parts: int, size: int) -> DataFrame:
    """``(position, part, n)``: distinct parts with counts, each stored partition a sorted range.

    Equal parts are combined map-side, so a vector that a third of the rows have is one row per task.
    """
    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("cells", p * size + 1, size).alias("part")) for p in range(parts)])
    rows = cells.select(F.inline(cut)).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    return stored(rows.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def entry_sums(distinct: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """``(position, entry, n, s0...)``: how many parts each entry got and their componentwise sums."""
    entries = books.entries
    names = [f"s{i}" for i in range(size)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [TrieWalk(book) for book in entries]
        counts = [np.zeros(len(book), np.int64) for book in entries]
        sums = [np.zeros(book.shape, np.int64) for book in entries]
        for batch in batches:
            position = batch.column(0).to_numpy(zero_copy_only=False)
            part, n = as_matrix(batch.column(1), size), batch.column(2).to_numpy(zero_copy_only=False)
            for p in np.unique(position):
                mine = position == p
                leaves, times = part[mine], n[mine]
                for some in blocks(leaves):
                    nearest = walks[p].distances(leaves[some]).argmin(axis=1)
                    np.add.at(counts[p], nearest, times[some])
                    np.add.at(sums[p], nearest, leaves[some] * times[some, None])
        for p in range(len(entries)):
            used = np.flatnonzero(counts[p])
            if len(used):
                columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used])]
                columns += [pa.array(sums[p][used, i]) for i in range(size)]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", *names])

    schema = ", ".join(["position int", "entry int", "n bigint", *[f"{name} bigint" for name in names]])
    partial = distinct.select("position", "part", "n").mapInArrow(walk, schema)
    return partial.groupBy("position", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def train(cells: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all rows of ``(id, cells)``; None if there is no vector that can be cut."""
    first = cells.orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries)  # a fixed number of rows
    seeds = [r["cells"] for r in first.select("id", "cells").collect()]
    if not seeds or len(seeds[0]) % parts:
        return None
    width, size = len(seeds[0]), len(seeds[0]) // parts
    cells = cells.where(F.size("cells") == width)
    if any(len(s) != width for s in seeds):
        seeds = [r["cells"] for r in cells.orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries).collect()]
    seeds = np.array(seeds, np.int64).reshape(len(seeds), parts, size)
    books = Codebooks([seeds[:, p].copy() for p in range(parts)])
    if size:
        distinct = distinct_parts(cells, parts, size)
        for _ in range(rounds):
            moved = [book.copy() for book in books.entries]
            for position, entry, n, *sums in map(tuple, entry_sums(distinct, books, size).collect()):
                moved[position][entry] = [s // n for s in sums]
            books = Codebooks(moved)
    return books


def assign(cells: DataFrame, books: Codebooks) -> DataFrame:
    """All columns but ``cells``, with ``code`` (two hex digits per part) and ``error``: no shuffle.

    Each batch's parts are sorted by themselves and walked as a trie of that batch.
    """
    entries = books.entries
    parts, size = len(entries), entries[0].shape[1]
    kept = [f for f in cells.schema.fields if f.name != "cells"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch.column("cells"), parts * size)
            error, digits = np.zeros(len(rows), np.int64), np.zeros((len(rows), parts), np.uint8)
            for p in range(parts):
                part = rows[:, p * size : (p + 1) * size]
                order = np.lexsort(part.T[::-1]) if size else np.arange(len(rows))
                walk = TrieWalk(entries[p])
                for some in blocks(order):
                    distance = walk.distances(part[order[some]])
                    nearest = distance.argmin(axis=1)
                    digits[order[some], p] = nearest
                    error[order[some]] += distance[np.arange(len(nearest)), nearest]
            text = digits.tobytes().hex()
            codes = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(codes, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "code", "error"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "code string", "error bigint"])
    return cells.where(F.size("cells") == parts * size).mapInArrow(code, schema)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(<id>, code, error, label_error, codebooks_sha256)`` of every vector that can be coded.

    ``label_error`` is the error summed over equal labels, nulls together. Errors are summed map-side
    per label; the rows meet their label's sum in a join whose larger side adaptive execution splits.
    At most 256 entries, as a code has two hex digits per part.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    cells = scaled(vectors, vector, {"id": id, "label": label}, scale)
    books = train(cells.select("id", "cells"), parts, entries, rounds)
    if books is None:
        none = vectors.where(F.lit(False)).select(F.col(id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(assign(cells, books), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
