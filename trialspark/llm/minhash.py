"""MinHash near-duplicate detection with tensored banding, and exact verification.

A set's table keys are all pairs of one element of a first and one element of a
second small collection of band hashes: ``COLLECTION ** 2`` tables from
``2 * COLLECTION * BAND`` minhashes, about the square root of what independent
tables would take. Two sets with similarity s share a key with probability
``(1 - (1 - s**BAND) ** COLLECTION) ** 2``; at 0.85 that misses 3 pairs in a
million, and fewer above.

Documents with equal sets are one class from the start. An element that one
class alone has can't be part of a shared key, so only elements that occur
twice are paired. In each table bucket the members are verified against the
smallest (a star) and links merge into components. What ``STARS`` turns leave
apart within a bucket is compared in blocks, across components only. So no pair
of a bucket in two components stays unverified, and a large group of near
copies costs a star rather than all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import limit_batches, stored, text_of
from trialspark.llm.components import components

#: Band hashes in each of the two collections, and minhashes in a band hash.
COLLECTION = 14
BAND = 3

#: Words whose hash a task remembers before it starts anew.
CACHED_WORDS = 500_000

#: Turns of star verification before what is still apart is compared block by block.
STARS = 2

#: Nodes and bytes of text in a block, and hashes in a column block of a comparison.
BLOCK_NODES = 500
BLOCK_BYTES = 4 << 20
COLUMNS = 4096


class WordHashes(dict):
    """64-bit hash of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than ``width``
    words make one shingle, none make no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, np.uint64(span))
    for at in range(span):
        out = _mixed(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[at : len(hashes) - span + 1 + at])
    return np.unique(out)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607).integers(0, 2**64, (2, n), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signatures(sets: list[np.ndarray], collection: int, band: int) -> np.ndarray:
    """Band hashes of each non-empty set: ``2 * collection`` columns."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), 2 * collection), np.uint64)
    for k, (a, b) in enumerate(zip(*_functions(2 * collection * band))):
        low = np.minimum.reduceat(_mixed(flat * a + b), starts)
        slot = k // band
        out[:, slot] = _mixed(out[:, slot] * np.uint64(0xFF51AFD7ED558CCD) + low + np.uint64(slot))
    return out


def sketch(docs: DataFrame, width: int, collection: int = COLLECTION, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes; null if empty) and elements of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(x, width, known) for x in batch["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            elements: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full], collection, band).view(np.int64)):
                    elements[i] = row
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_id": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "elements": elements,
                }
            )

    limit_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_shingles long, set_id binary, elements array<long>")


def similar(left: Column, right: Column, width: int, percent: int) -> Column:
    """Whether ``100 * shared >= percent * union`` holds for the shingle sets of two texts."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = WordHashes()
        for lefts, rights in batches:
            out, last, last_set = [], None, None
            for a, b in zip(lefts, rights):
                if b != last:  # a bucket's smallest member comes many times in a row
                    last, last_set = b, shingles(b, width, known)
                own = shingles(a, width, known)
                shared = len(own) + len(last_set) - len(np.unique(np.concatenate([own, last_set])))
                out.append(100 * shared >= percent * (len(own) + len(last_set) - shared) > 0)
            yield pd.Series(out)

    return check(left, right)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts' sets are similar. Both joins may be split on hot keys."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text"))
    both = pairs.join(left, "u").join(right, "v")
    return both.where(similar(F.col("u_text"), F.col("v_text"), width, percent)).select("u", "v").distinct()


def _members(candidates: DataFrame) -> DataFrame:
    """(key, node): a row for each table bucket of each candidate."""
    key = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    return candidates.select("node", F.explode(key).alias("key"))


def links(classes: DataFrame, docs: DataFrame, width: int, percent: int, collection: int = COLLECTION) -> DataFrame:
    """(node, component) of classes linked to another; ``classes`` has node and elements."""
    spread = classes.select("node", F.posexplode("elements").alias("slot", "value"))
    shared = spread.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    kept = spread.join(shared, "value").groupBy("node").agg(
        F.collect_list(F.when(F.col("slot") < collection, F.col("value"))).alias("first"),
        F.collect_list(F.when(F.col("slot") >= collection, F.col("value"))).alias("second"),
    )
    candidates = stored(kept.where("size(first) > 0 and size(second) > 0"), "candidates")
    counts = _members(candidates).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stored(_members(candidates).join(counts, "key").distinct(), "members")
    texts = stored(
        docs.select("doc_id", text_of().alias("text")).join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"),
        "texts",
    )
    found = None  # verified links so far
    labels = members.select("node", F.col("node").alias("component")).distinct()
    for turn in range(STARS + 1):
        here = members.join(labels, "node")
        hubs = here.groupBy("key").agg(F.min(F.struct("node", "component")).alias("hub"), F.max("component").alias("most"), F.min("component").alias("least"))
        here = stored(here.join(hubs.where("least <> most").select("key", "hub"), "key"), "open")
        if here.isEmpty():
            break
        if turn < STARS:
            pairs = here.where(F.col("component") != F.col("hub.component")).select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()
            new = _verified(pairs, texts, width, percent)
            # a bucket's hub has met all the others and need not be asked again
            members = here.where(F.col("node") != F.col("hub.node")).select("key", "node")
        else:
            new = _across(here.select("key", "node", "component"), texts, width, percent)
        new = stored(new, "links")
        found = new if found is None else found.unionByName(new)
        labels = labels.select("node").join(components(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        labels = stored(labels, "labels")
    return labels


def _across(here: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All links between nodes of different components that buckets connect.

    ``here`` has the rows (key, node, component) of buckets with several
    components. Components that buckets connect are a family; its nodes are dealt
    into blocks of bounded size, a component of its own block or blocks if it
    is large, and every two blocks meet in a task of their own unless they are
    of one component. Sets are compared inside the task; only links leave it.
    """
    # which buckets a component has, not which of its nodes: a large group of near copies is one row a bucket
    met = here.select("key", F.col("component").alias("u")).distinct()
    chain = met.join(met.groupBy("key").agg(F.min("u").alias("v")), "key").where("u <> v").select("u", "v").distinct()
    families = components(chain).select(F.col("node").alias("component"), F.col("component").alias("family"))
    nodes = here.select("node", "component").distinct().join(families, "component")
    nodes = nodes.join(texts.groupBy(F.col("doc_id").alias("node")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "node")
    size = nodes.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    own = size.select("family", "component", F.when(F.col("n") * 2 > BLOCK_NODES, F.col("component")).alias("part"))
    nodes = stored(nodes.join(own, ["family", "component"]), "families")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("bytes") / BLOCK_BYTES)).cast("long")
    parts = nodes.groupBy(F.col("family").alias("f"), F.col("part").alias("p")).agg(n_blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = nodes.join(parts, (F.col("family") == F.col("f")) & F.col("p").eqNullSafe(F.col("part")))
    dealt = stored(dealt.select("family", "part", block.alias("block"), "node", "component"), "blocks")
    each = dealt.select("family", F.struct("part", "block").alias("b")).distinct()
    meet = each.select("family", F.col("b").alias("one")).join(each.select("family", F.col("b").alias("two")), "family")
    apart = F.col("one.part").isNull() | ~F.col("one.part").eqNullSafe(F.col("two.part"))
    meet = meet.where((F.col("one") <= F.col("two")) & apart)
    sides = F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))
    places = meet.select("family", F.struct("one", "two").alias("pair"), F.posexplode(sides).alias("side", "b"))
    full = dealt.select("family", F.struct("part", "block").alias("b"), "node", "component").join(texts.withColumnRenamed("doc_id", "node"), "node")
    rows = places.join(full, ["family", "b"]).select("family", "pair", "side", "node", "component", "text")
    kind = dict(here.dtypes)["node"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        known = WordHashes()
        sets = [shingles(x, width, known) for x in group["text"]]
        node, component, side = (group[c].to_numpy() for c in ("node", "component", "side"))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        a, b = _similar_pairs([sets[i] for i in left], [sets[i] for i in right], percent)
        u, v = left[a], right[b]
        linked = component[u] != component[v]
        return pd.DataFrame({"u": np.maximum(node[u], node[v])[linked], "v": np.minimum(node[u], node[v])[linked]})

    return rows.groupBy("family", "pair").applyInPandas(compare, f"u {kind}, v {kind}").where("u <> v").distinct()


def _similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the pairs of sets with ``100 * shared >= percent * union``.

    Shared counts come from products of indicator matrices, over the hashes
    that occur on both sides, ``COLUMNS`` at a time.
    """
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right)) if left and right else np.zeros(0, np.uint64)

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        there = vocabulary[at] == values
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[there], at[there]

    shared = np.zeros((len(left), len(right)))
    if len(vocabulary):
        (row_a, col_a), (row_b, col_b) = flat(left), flat(right)
        for at in range(0, len(vocabulary), COLUMNS):
            tables = []
            for row, col, n in ((row_a, col_a, len(left)), (row_b, col_b, len(right))):
                inside = (col >= at) & (col < at + COLUMNS)
                table = np.zeros((n, COLUMNS), np.float32)
                table[row[inside], col[inside] - at] = 1
                tables.append(table)
            shared += tables[0] @ tables[1].T
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return np.nonzero((shared > 0) & (100 * shared >= percent * (sizes - shared)))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of ``width``-word shingles have
    ``100 * shared >= percent * union``. Needs columns doc_id and text. Null,
    empty and white-space texts have the empty set and are linked with nothing.
    Rows with one doc_id are one document; a row without doc_id is linked only
    to rows with the very same set. An empty table gives an empty result.
    """
    rows = stored(sketch(docs, width), "sketch")
    full = rows.where("n_shingles > 0")
    classes = full.where("doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "elements")).alias("least"))
    classes = stored(classes.select("set_id", F.col("least.doc_id").alias("node"), F.col("least.elements").alias("elements")), "classes")
    labels = links(classes, docs, width, percent)
    of_set = classes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all columns."""
    kept = near_groups(docs, width, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
