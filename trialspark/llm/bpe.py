"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct pre-tokens ("words") it has not met yet into one
sequence of byte tokens. An inverted index from the ranks of pairs to their
positions in that sequence then replays the merges in rank order; each merge
touches its two neighbours only. A word's ids are the same wherever it stands, so texts are
put together from the words' ids.

Needs no shuffle: documents are split by the scan, and every task replays its
own words. The word table of a task is bounded (``CACHED_WORDS``): it has two
generations, and when the younger is full the older is dropped, so words in use
stay; a word met again later is replayed again, which changes no result. A word
beyond ``LONG_WORD`` bytes has an index of its own, a heap of its pairs by rank
and place, so the cost of one huge word grows with its length times its logarithm.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.llm.common import text_of

#: Chunks and words kept by a task in each generation of its tables (under 100 MB together).
CACHED_WORDS = 150_000

#: Longer words, in bytes, are replayed one by one.
LONG_WORD = 512

#: Bands of ranks in the index of a replay; ranks are below 2**20.
BANDS = 48

#: Stands for "these two don't merge".
NONE = 1 << 30

#: Characters of Unicode's White_Space property, which ``\s`` of the pre-token pattern means.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@functools.lru_cache
def _members(major: str) -> str:
    """The body of a character class with all characters of one major category (L or N)."""
    body, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            body.append(re.escape(chr(start)) + ("-" + re.escape(chr(code - 1)) if code - 1 > start else ""))
            start = None
    return "".join(body)


@functools.lru_cache
def splitter(pattern: str) -> re.Pattern:
    """The pre-token pattern for the standard library: categories and white space spelled out."""
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.S):
        inside = True if part == "[" else False if part == "]" else inside
        body = WHITE_SPACE if part in (r"\s", r"\S") else _members(part[3]) if part.startswith(r"\p") else None
        out.append(part if body is None else body if inside else f"[{'^' * (part == r'\S')}{body}]")
    return re.compile("".join(out))


class Merges:
    """Which rank two adjacent tokens merge into, for all pairs that merge at all."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = []
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        found.sort()
        keys, merged = zip(*found) if found else ((), ())
        self.keys = np.array([*keys, 1 << 62], np.int64)
        self.merged = np.array([*merged, NONE], np.int32)

    def rank(self, left, right):
        """Ranks of the pairs, ``NONE`` where they don't merge."""
        key = (np.asarray(left, np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(NONE))


    def of(self, left: int, right: int) -> int:
        """Rank of one pair."""
        key = left << 32 | right
        at = self.keys.searchsorted(key)
        return int(self.merged[at]) if self.keys[at] == key else NONE


@functools.lru_cache
def merges_of(path: str) -> Merges:
    return Merges(ranks_of(path))


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words, end to end, and the number of ids of each word.

    The index holds, for each ascending band of ranks, the places where a pair
    of such a rank starts. A band is replayed until it has no place left: each
    word in it merges its lowest-ranked pair, the leftmost of equals, and the
    pairs with the two neighbours enter the index under their ranks (this band
    again, if they come no later). Words don't affect each other, so this is
    the order of ranks within every word.
    """
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tokens = merges.byte[raw]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    before[new] = -1
    after[new[1:] - 1] = -1
    after[n - 1] = -1
    pair = np.full(n, NONE, np.int32)  # rank of the pair that starts at each place
    start = np.flatnonzero(after >= 0)
    pair[start] = merges.rank(tokens[start], tokens[start + 1])
    start = start[pair[start] != NONE]

    tops = np.unique(np.append(np.quantile(pair[start], np.linspace(0, 1, BANDS), method="lower"), merges.merged[:-1].max())) if len(start) else []
    index: list[list[np.ndarray]] = [[] for _ in tops]

    def enter(places: np.ndarray) -> None:
        band = np.searchsorted(tops, pair[places])
        order = np.argsort(band, kind="stable")
        places, band = places[order], band[order]
        cuts = np.flatnonzero(np.diff(band)) + 1
        for group, at in zip(np.split(places, cuts), band[np.append(0, cuts)] if len(band) else ()):
            index[at].append(group)

    enter(start)
    for at, top in enumerate(tops):
        todo = np.concatenate(index[at]) if index[at] else new[:0]
        index[at] = []
        while len(todo):
            todo.sort()
            fresh = np.ones(len(todo), bool)
            fresh[1:] = todo[1:] != todo[:-1]
            fresh &= pair[todo] <= top  # an earlier merge may have taken one side, or changed it
            todo = todo[fresh]
            if not len(todo):
                break
            of = word[todo]  # ascending, as the places are
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(pair[todo].astype(np.int64) << 32 | np.arange(len(todo)), starts) & 0xFFFFFFFF
            places, todo = todo[best], np.delete(todo, best)
            gone, r = after[places], pair[places]
            right, left = after[gone], before[places]
            tokens[places], tokens[gone], pair[gone] = r, -1, NONE
            after[places] = right
            has = right >= 0
            before[right[has]] = places[has]
            pair[places] = NONE
            pair[places[has]] = merges.rank(r[has], tokens[right[has]])
            has = left >= 0
            left = left[has]
            pair[left] = merges.rank(tokens[left], r[has])
            touched = np.concatenate([places, left])
            todo = np.concatenate([todo, touched[pair[touched] <= top]])
            enter(touched[(pair[touched] > top) & (pair[touched] != NONE)])
    live = tokens >= 0
    return tokens[live], np.bincount(word[live], minlength=len(words))


def replay_long(word: bytes, merges: Merges) -> np.ndarray:
    """Ids of one word: a heap holds its pairs by rank, then place; a merge enters the two new pairs."""
    raw = np.frombuffer(word, np.uint8)
    tokens = merges.byte[raw].astype(np.int64)
    first = merges.rank(tokens[:-1], tokens[1:])
    heap = [(int(first[i]) << 32) | i for i in np.flatnonzero(first != NONE).tolist()]
    heapq.heapify(heap)
    tokens, pair = tokens.tolist(), [*first.tolist(), NONE]
    after, before = [*range(1, len(raw)), -1], list(range(-1, len(raw) - 1))
    known: dict[tuple[int, int], int] = {}

    def ranked(left: int, right: int) -> int:
        found = known.get((left, right))
        if found is None:
            found = known[left, right] = merges.of(left, right)
        return found

    while heap:
        entry = heapq.heappop(heap)
        at, rank = entry & 0xFFFFFFFF, entry >> 32
        if pair[at] != rank:
            continue  # an earlier merge took one side, or changed it
        gone = after[at]
        right, left = after[gone], before[at]
        tokens[at], tokens[gone], pair[gone] = rank, -1, NONE
        after[at], pair[at] = right, NONE
        if right >= 0:
            before[right] = at
            pair[at] = ranked(rank, tokens[right])
            if pair[at] != NONE:
                heapq.heappush(heap, (pair[at] << 32) | at)
        if left >= 0:
            pair[left] = ranked(tokens[left], rank)
            if pair[left] != NONE:
                heapq.heappush(heap, (pair[left] << 32) | left)
    return np.array([t for t in tokens if t >= 0], np.int64)


#: A space after white space: the run may be split elsewhere than at the space.
RUN = re.compile(f"[{WHITE_SPACE}] ")
START = re.compile(f"(?<=[^{WHITE_SPACE}]) ")


class Encoder:
    """Encodes batches of texts; remembers the ids of chunks it has met.

    A chunk is what stands between two spaces, with the space before it. The
    pattern never matches across the first character of a white-space run, so
    where a run starts with a space the text may be cut there.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, splitter(pattern).findall
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def unknown(self, needed: set[str], young: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
        """What neither generation knows; what only the older knows moves to the younger."""
        fresh = needed.difference(young)
        met = fresh.intersection(old)
        young.update({x: old[x] for x in met})
        return fresh - met

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) + len(self.words) > CACHED_WORDS:
            self.old_chunks, self.old_words, self.chunks, self.words = self.chunks, self.words, {}, {}
        split = [START.split(x) if RUN.search(x) else x.split(" ") for x in texts]
        fresh = self.unknown(set().union(*[x[1:] for x in split]), self.chunks, self.old_chunks)
        parts = {x: self.find(" " + x) for x in fresh}
        starts = {x: self.find(x) for x in {x[0] for x in split}}
        new = list(self.unknown({w for d in (parts, starts) for ws in d.values() for w in ws}, self.words, self.old_words))
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        ids, sizes = replay([raw[i] for i in short], self.merges)
        packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        self.words.update(zip([new[i] for i in short], [packed[a:b] for a, b in zip([0, *ends], ends)]))
        self.words.update({new[i]: replay_long(w, self.merges).astype("<u4").tobytes() for i, w in enumerate(raw) if len(w) > LONG_WORD})
        word = self.words.__getitem__
        self.chunks.update({x: word(ws[0]) if len(ws) == 1 else b"".join(map(word, ws)) for x, ws in parts.items()})
        chunk = self.chunks.__getitem__
        return [b"".join([*map(word, starts[x[0]]), *map(chunk, x[1:])]) for x in split]


def text_bytes(ids: bytes, merges: Merges) -> bytes:
    """The bytes behind packed ids; an unknown id raises."""
    return b"".join(map(merges.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(text: Column | str, ranks_path: str, pattern: str) -> Column:
    """The ids of each text as little-endian unsigned 32-bit integers, in one binary value.

    Null and empty texts give an empty value. No special tokens.
    """

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(merges_of(ranks_path), pattern)
        for batch in batches:
            yield pd.Series(encoder.encode(batch.tolist()), dtype=object)

    return ids(text_of(text))


def decode(ids: Column | str, ranks_path: str) -> Column:
    """The bytes behind packed ids (null for null); an unknown id raises."""

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = merges_of(ranks_path)
        for batch in batches:
            yield pd.Series([None if x is None else text_bytes(x, merges) for x in batch], dtype=object)

    return joined(ids)


def round_trip(text: Column | str, ranks_path: str, pattern: str) -> Column:
    """``(ids, decoded)`` as :func:`encode` and :func:`decode` give them, by one Python worker a task."""

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        merges = merges_of(ranks_path)
        encoder = Encoder(merges, pattern)
        for batch in batches:
            ids = encoder.encode(batch.tolist())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([text_bytes(x, merges) for x in ids], dtype=object)})

    return both(text_of(text))
