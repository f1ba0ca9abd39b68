"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; all equal ones have one name. The names of one length come
from the pairs of names of half that length. Where a factor occurs again within a window of twice
its length, its occurrences form an arithmetic progression whose difference is a period: consecutive
places whose next occurrence lies equally far ahead are one proposal. Proposals are extended as long
as the period holds, and equal ones of several lengths count once.

Why no run is lost and none is wrong: let a run have smallest period q and at least 3q words, and m be
the smallest power of two with m >= q, so m < 2q. Each factor of m words whose copy q words on still
lies in the run occurs there again, and no sooner, as q is the smallest period: the run is one proposal of
length m. Conversely a proposal's smallest period is its distance, as a smaller one would have given a
nearer occurrence.

All documents of a batch are handled as one array of words, in which words of different documents
differ, so a factor across a border never occurs twice. A place stays in the dictionary only while
its factor occurs again near enough for a run of its document; ordinary prose leaves after a few lengths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A run has at least this many words and this many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3


@dataclass
class Runs:
    """Maximal runs by start, then period; ``start`` counts from the beginning of the whole array."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def extend(word: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
    """Moves starts down and ends up while the neighbouring word keeps the period."""
    for edge, step in ((start, -1), (end, 1)):
        open_ = np.arange(len(edge))
        while len(open_):
            inner = edge[open_] + (0 if step < 0 else -1)  # the outermost word of the run on this side
            at = inner + step
            inside = (at >= 0) & (at < len(word))
            same = np.zeros(len(open_), bool)
            back = at[inside] - step * period[open_][inside]
            same[inside] = word[at[inside]] == word[back]
            open_ = open_[same]
            edge[open_] += step


def find_runs(word: np.ndarray, document: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """Runs of ``word`` codes; ``document`` gives each word's document, in ascending order."""
    if least_periods < 3:
        raise ValueError("a period is proposed with certainty only for three periods or more")
    n = len(word)
    sizes = np.bincount(document) if n else np.zeros(0, np.int64)
    reach = (sizes // least_periods)[document] if n else sizes  # the longest period a run at this place can have
    word = word + document.astype(np.int64) * (int(word.max()) + 1 if n else 1)
    place, name, m = np.arange(n), word, 1
    found: list[np.ndarray] = []
    while len(place):
        order = np.argsort(name, kind="stable")
        at, named = place[order], name[order]
        again = named[1:] == named[:-1]
        ahead = at[1:] - at[:-1]
        # occurrences inside a window of 2m words propose periods
        near = again & (ahead <= m)
        first, period = at[:-1][near], ahead[near]
        by_place = np.argsort(first)
        first, period = first[by_place], period[by_place]
        if len(first):
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1] + 1) | (period[1:] != period[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(first)) - 1
            start, end, gap = first[begin], first[last] + period[begin] + m, period[begin]
            whole = end - start >= np.maximum(least_words, least_periods * gap)
            if whole.any():
                start, end, gap = start[whole], end[whole], gap[whole]
                extend(word, start, end, gap)
                found.append(np.stack([start, gap, end - start], axis=1))
        # the next length: both halves must occur again within reach
        stays = again & (ahead <= reach[at[:-1]])
        recurs = np.zeros(len(at), bool)
        recurs[:-1] |= stays
        recurs[1:] |= stays
        number = np.concatenate([[0], np.cumsum(~again)]) if len(at) else np.zeros(0, np.int64)
        lookup = np.full(n, -1, np.int64)
        lookup[at[recurs]] = number[recurs]
        place = np.sort(at[recurs])
        place = place[(place + m < n) & (m < 2 * reach[place])]
        place = place[lookup[place + m] >= 0]
        name = lookup[place] * (n + 1) + lookup[place + m]
        m *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    start, period, length = np.unique(np.concatenate(found), axis=0).T  # by start, then period
    return Runs(start, length, period)


def collapsed(size: int, runs: Runs) -> np.ndarray:
    """Which words stay: not those that some run holds after its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) == 0


def batch_runs(texts: list[list[str]], least_words: int, least_periods: int) -> tuple[pa.Array, list[str]]:
    """Per document: its runs, and its text without repeated periods."""
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = [w for words in texts for w in words]
    code = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(texts)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    runs = find_runs(code, document, least_words, least_periods)
    stays = collapsed(len(flat), runs)
    owner = document[runs.start]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    fields = [runs.start - begin[owner], runs.length, runs.period]
    spans = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"])
    kept = []
    for d, words in enumerate(texts):
        some = stays[begin[d] : begin[d + 1]]
        kept.append(" ".join(words if some.all() else [words[i] for i in np.flatnonzero(some)]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), kept


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
                  least_periods: int = LEAST_PERIODS, rewrite: Callable[[list[str], object], list[str]] | None = None) -> DataFrame:
    """``(<id>, n_words, runs, collapsed)`` per row: no shuffle, a batch of whole texts at a time.

    ``runs`` holds (start, length, period) of every maximal run with its smallest period, by start, then
    period; ``collapsed`` is the text's words, joined by a space, without those that a run holds after
    its first period. ``rewrite(words, id)`` may replace a text's words beforehand.

    A null or empty text, or one of white space, has no words, no runs and an empty ``collapsed``.
    Repeated rows and ids, null ids, and an empty table need no special case; other columns are not read.
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [WORD.findall(t) if t else [] for t in batch.column(1).to_pylist()]
            if rewrite is not None:
                words = [rewrite(w, i) for w, i in zip(words, batch.column(0).to_pylist())]
            runs, kept = batch_runs(words, least_words, least_periods)
            sizes = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, runs, pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return source.mapInArrow(work, schema).withColumnRenamed("id", id)


def steepest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""

    def compare(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, compare), F.lit(0))


def digest(runs: Column) -> Column:
    """SHA-256 of every run's ``start,length,period`` and a line feed."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)
