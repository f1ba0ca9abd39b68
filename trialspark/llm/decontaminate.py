"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared lower-cased, with one space for each white-space
run, as UTF-8 bytes ("characters" here). An item of m characters leaks into a
document if

* some part of the document is within its edit budget: ``EDITS`` * m edits, or
  ``WORD`` edits (about one replaced word; at most m / 6) where that is more, or
* a region of it leaks: ``REGION`` * m characters in a row, for m of ``LEAST_REGION``
  or more, within ``EDITS`` of that length, or
* it is shorter than 2 * q and stands in the document verbatim between word
  bounds. Items of one word or under ``LEAST_ITEM`` characters identify nothing.

e scattered edits leave at least ``m - q + 1 - q * e`` shared q-grams, a replaced
run of w characters at least ``m - q + 1 - (q + w - 1)``, on diagonals that lie at
most e (or w) apart, hence within one of overlapping bands of twice as many
diagonals. Three steps, each of which loses nothing:

* places of the document whose q-gram occurs in the benchmark, kept where a
  window that could hold an item (of some class of sizes) has enough of them;
* per item and diagonal band, the shared q-grams are counted against the bound
  of the item, and in windows of its text against that of a region;
* what remains is verified by banded alignment.

A region of ``REGION`` * m is sought in windows of ``SOUGHT`` * m that start every
``REGION - SOUGHT`` of the item, so each such region holds a whole window.

The benchmark is a stated query set. It meets the documents in blocks of
``BLOCK_CHARS`` characters, each an index of bounded size that is broadcast;
documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import limit_batches, slices, text_of

#: Length of a q-gram, and the share of an item's characters that may be edited.
Q = 12
EDITS = 0.05

#: Edits that an item always has (about one word replaced), unless that is over a sixth of it.
WORD = 10

#: Share of an item that leaks by itself, what is sought of it, and the least item this holds for.
REGION, SOUGHT = 0.75, 0.7
LEAST_REGION = 64

#: Items with fewer characters, or of one word, are not sought.
LEAST_ITEM = 8

#: Characters of benchmark text in one index.
BLOCK_CHARS = 4_000_000

#: Largest over smallest size of the items that share a window.
CLASS = 1.3

#: Bits of the screen that says whether a q-gram may occur in the benchmark.
SCREEN_BITS = 20


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def _grams(raw: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each place, mixed into one integer from two that overlap."""
    n = max(0, len(raw) - Q + 1)
    if not n:
        return np.zeros(0, "<u8")
    eights = np.ndarray((n + Q - 8,), "<u8", raw, strides=(1,))
    return (eights[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eights[Q - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F))


def distance(item: np.ndarray, part: np.ndarray, budget: int, slack: int) -> int:
    """Least edits that turn ``item`` into a run of ``part``; over ``budget`` if more are needed.

    Only cells at most ``slack`` off the main diagonal are filled: ``part``
    begins where the item may begin, give or take that many places.
    """
    width = 2 * slack + 1
    far = budget + 1
    # column j of a row is the cell at place row + j - slack of the part
    places = np.arange(width) - slack
    row = np.where((places >= 0) & (places <= len(part)), 0, far)
    steps = np.arange(width)
    for i, c in enumerate(item, 1):
        place = i + places
        inside = (place >= 1) & (place <= len(part))
        same = np.zeros(width, bool)
        same[inside] = part[place[inside] - 1] == c
        new = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        new[~inside] = np.where(place[~inside] == 0, i, far)
        new = np.minimum.accumulate(new - steps) + steps
        row = np.where((place >= 0) & (place <= len(part)), np.minimum(new, far), far)
        if row.min() > budget:
            return far
    return int(row.min())


class Index:
    """q-grams of a block of benchmark items, with their places."""

    def __init__(self, items: list[tuple[int, str]]):
        clean = [(i, normal(t or "")) for i, t in items]
        self.short = ahocorasick.Automaton()
        for i, t in clean:
            if LEAST_ITEM <= len(t) < 2 * Q and b" " in t:
                key = t.decode("utf-8", "surrogatepass")
                self.short.add_word(key, (len(key), [*(self.short.get(key, (0, []))[1]), i]))
        if len(self.short):
            self.short.make_automaton()
        clean = [(i, t) for i, t in clean if len(t) >= 2 * Q]
        self.ids = [i for i, _ in clean]
        self.texts = [t for _, t in clean]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.sizes = sizes
        # the bounds must stay positive for the filter to lose nothing
        self.edits = np.minimum((sizes * EDITS).astype(np.int64), np.maximum(0, (sizes - Q) // Q))
        run = np.clip(np.minimum(sizes // 6, sizes - 2 * Q + 1), 0, WORD)
        self.budget = np.maximum(self.edits, run)
        self.bound = np.minimum(sizes - Q + 1 - Q * self.edits, np.where(run > 0, sizes - Q + 1 - (Q + run - 1), sizes))
        self.part = np.where(sizes >= LEAST_REGION, (sizes * SOUGHT).astype(np.int64), 0)
        self.part_edits = np.minimum((self.part * EDITS).astype(np.int64), np.maximum(0, (self.part - Q) // Q))
        self.part_bound = np.where(self.part > 0, self.part - Q + 1 - Q * self.part_edits, self.bound)
        least = np.minimum(self.bound, self.part_bound)
        grams = [_grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, "<u8")
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.item, self.place = flat[order], item[order], place[order]
        self.distinct, self.first = np.unique(self.gram, return_index=True)
        self.last = np.append(self.first[1:], len(self.gram))
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[self._slot(self.distinct)] = True
        # classes of sizes: a leak of any item of a class lies in one window, with the class's least bound
        self.windows: list[tuple[int, int]] = []
        left = np.sort(sizes)
        while len(left):
            some = sizes[(sizes >= left[0]) & (sizes <= left[0] * CLASS)]
            in_class = np.isin(sizes, some)
            self.windows.append((int((sizes + self.budget)[in_class].max()), int(least[in_class].min())))
            left = left[left > left[0] * CLASS]

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SCREEN_BITS)

    def _places(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with enough benchmark q-grams about them, and each one's number among the distinct."""
        grams = _grams(flat)
        hit = self.screen[self._slot(grams)]
        before = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        near = np.zeros(len(hit), bool)
        for window, least in self.windows:
            ends = np.append(before[window:], np.full(min(window, len(hit) + 1), before[-1]))[: len(hit)]
            dense = np.flatnonzero((ends - before[:-1] >= least) & hit)
            if len(dense):
                step = np.zeros(len(hit) + window + 1, np.int8)
                step[dense] += 1
                step[dense + window] -= 1
                near |= np.cumsum(step, dtype=np.int32)[: len(hit)] > 0
        at = np.flatnonzero(hit & near)
        if not len(at):
            return at, at
        found = np.searchsorted(self.distinct, grams[at])
        there = self.distinct[np.minimum(found, len(self.distinct) - 1)] == grams[at]
        return at[there], found[there]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its leaks (item id, edits, place in the normalised text, characters of the item), by item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        clean = [normal(t) for t in texts]
        if len(self.short):
            for found, text in zip(out, clean):
                found += self._verbatim(text.decode("utf-8", "surrogatepass"))
        if not self.ids:
            return out
        flat = np.frombuffer(b"".join(t + b"\0" * Q for t in clean), np.uint8)
        starts = np.cumsum([0] + [len(t) + Q for t in clean])
        at, number = self._places(flat)
        if not len(at):
            return out
        copies = self.last[number] - self.first[number]
        shift = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        entry = np.repeat(self.first[number], copies) + shift
        at = np.repeat(at, copies)
        item, place = self.item[entry], self.place[entry]
        half = self.budget[item] + 1
        # offset keeps diagonals positive; the place is in the joined texts, so a diagonal is of one text
        band = (at - place + int(self.sizes.max())) // half
        # each shared q-gram counts in its own band and in the one that starts a half earlier
        key = np.concatenate([item.astype(np.int64) << 40 | band, item.astype(np.int64) << 40 | np.maximum(band - 1, 0)])
        gram = np.concatenate([place, place])
        pairs = np.unique(np.stack([key, gram], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        keys, first, counts = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}  # characters left out, edits, place
        for k, low, n in zip(keys.tolist(), first.tolist(), counts.tolist()):
            i, b = k >> 40, k & ((1 << 40) - 1)
            if n < min(self.bound[i], self.part_bound[i]):
                continue
            begin = b * (int(self.budget[i]) + 1) - int(self.sizes.max())
            doc = int(np.searchsorted(starts, min(max(begin + self.sizes[i] // 2, 0), starts[-1] - 1), side="right") - 1)
            known = best.get((doc, i))
            if known is not None and known[:2] == (0, 0):
                continue
            size = int(self.sizes[i])
            found = self._verify(clean[doc], begin - int(starts[doc]), i, 0, size, int(self.budget[i])) if n >= self.bound[i] else None
            if found is None and self.part[i] and (known is None or known[0]):
                found = self._region(clean[doc], begin - int(starts[doc]), i, pairs[low : low + n, 1])
            if found is not None and (known is None or found < known):
                best[doc, i] = found
        for (doc, i), (left, edits, place) in sorted(best.items()):
            out[doc].append((self.ids[i], edits, place, int(self.sizes[i]) - left))
        return out

    def _verbatim(self, text: str) -> list[tuple[int, int, int, int]]:
        """Short items between word bounds: the first place of each."""
        found: dict[int, tuple[int, int, int, int]] = {}
        for end, (size, ids) in self.short.iter(text):
            start = end - size + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            for i in ids:
                if i not in found:
                    found[i] = (i, 0, len(text[:start].encode("utf-8", "surrogatepass")), len(text[start : end + 1].encode("utf-8", "surrogatepass")))
        return list(found.values())

    def _verify(self, text: bytes, begin: int, i: int, start: int, size: int, budget: int) -> tuple[int, int, int] | None:
        """(characters left out, edits, place) if the item's part at ``start`` is in ``text`` near diagonal ``begin``."""
        wanted = self.texts[i][start : start + size]
        slack = int(self.budget[i])
        low = max(begin + start, 0)
        part = text[low : max(0, begin + start + 2 * (slack + 1) + size + budget)]
        exact = part.find(wanted)
        if exact >= 0:
            return len(self.texts[i]) - size, 0, low + exact
        edits = distance(np.frombuffer(wanted, np.uint8), np.frombuffer(part, np.uint8), budget, 3 * (slack + 1))
        return (len(self.texts[i]) - size, edits, low) if edits <= budget else None

    def _region(self, text: bytes, begin: int, i: int, grams: np.ndarray) -> tuple[int, int, int] | None:
        """The first window of the item that leaks; ``grams`` are the places of its shared q-grams, ascending."""
        size, part = int(self.sizes[i]), int(self.part[i])
        step = max(1, int(size * (REGION - SOUGHT)))
        for start in [*range(0, size - part, step), size - part]:
            n = np.searchsorted(grams, start + part - Q, side="right") - np.searchsorted(grams, start)
            if n >= self.part_bound[i]:
                found = self._verify(text, begin, i, start, part, int(self.part_edits[i]))
                if found is not None:
                    return found
        return None


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over ``benchmark`` (item_id, text), each over about ``block_chars`` characters."""
    items = benchmark.select("item_id", text_of().alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = slices(total, block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Index([tuple(r) for r in items.where(block == k).distinct().orderBy("item_id").collect()])


def leaks(text: Column | str, index: Index, spark) -> Column:
    """Array of struct (item_id, edits, place, covered) for each text: the items that leak into it."""
    shared = spark.sparkContext.broadcast(index)
    limit_batches(spark)

    @F.pandas_udf("array<struct<item_id:bigint,edits:int,place:bigint,covered:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = shared.value.find(batch.tolist())
            yield pd.Series([[{"item_id": i, "edits": e, "place": p, "covered": c} for i, e, p, c in x] for x in found], dtype=object)

    return run(text_of(text))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, place, covered): a row for each leak of an item into a row of ``docs``.

    ``covered`` counts the item's characters in the part found: all, or those of a region.
    Null and empty texts and items leak nothing. Repeated rows of ``docs`` are reported each; repeated items
    once each row and id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    out = None
    for index in blocks(benchmark):
        found = docs.select("doc_id", F.explode(leaks("text", index, spark)).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all columns."""
    names = docs.columns
    for index in blocks(benchmark):
        docs = docs.where(F.size(leaks(docs["text"], index, docs.sparkSession)) == 0)
    return docs.select(*[F.col(f"`{c}`") for c in names])
