"""Removal of byte strings that repeat across documents, by interval expansion on a BWT.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller id is removed. The strings of that length are the
windows of the texts. A window's anchor is the least hash of the 25-byte
strings in it, so equal windows have equal anchors; windows that follow each
other mostly share one, and form a run.

1. Anchors are sent to hashed buckets, once for each group of documents, and
   those that two documents share are sent back. Windows of other anchors
   occur once and are done.
2. Runs of shared anchors are sent, once for each group and text, to the bucket
   of their anchor. A bucket indexes its distinct runs that have a window whose
   hash another window has: from their Burrows-Wheeler transform, breadth-first backward extension of all
   intervals derives the common prefixes of neighbouring suffixes by
   increasing value, and stops at ``length``. Suffixes that no shorter value
   parts are equal windows; the least document of each class is found, and one
   bit a window goes back: does a smaller document have it.
3. Each group of documents puts the bits together into removed spans.

Groups of documents are dealt by their place in the table, so repeated rows don't
gather in one, and buckets by the anchor's hash, both of bounded mean size at any
input. What a group has found out about its runs passes the buckets' step beside
the texts it asks about, and isn't worked out again. A repeated passage reaches a bucket once a
group, however many documents hold it. An anchor found in ``HEAVY`` groups or
more has its windows sent one by one, dealt by their own hash, so that the
texts around a very common passage don't gather in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import limit_batches, slices, stored, text_of
from trialspark.llm.exact_dedup import file_backed, locator

#: Bytes of text in a group of documents, and for each bucket.
GROUP_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20

#: Groups that share an anchor from which its windows are dealt one by one.
HEAVY = 256

#: Length of an anchor's string; windows of a run; bytes of text worked at once, and packed by a task at once.
GRAM = 25
RUN = 32
CHUNK = 1 << 17
PACKED = 32 << 20

#: Texts, or places, whose hashes and bits are worked at once.
SOME = 1 << 16

#: Suffixes up to which the ranks of three stretches fit one integer.
TRIPLED = (1 << 21) - 1

#: Bits by which an anchor is looked for before its place is.
SIEVE = 22

#: Low bits of an anchor that are kept beside its bucket (five bytes).
LOW = 40

NO_ID = np.iinfo(np.int64).max
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


#: A different odd factor for each eight bytes of a string.
FACTORS = np.cumprod(np.full(64, ODD[1]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    return (x ^ (x >> np.uint64(29))) * ODD[0]


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


def _places(size: int) -> list[int]:
    """Where eights begin that cover ``size`` bytes (8 or more)."""
    return [*range(0, size - 7, 8), size - 8]


def _sums(raw: np.ndarray, size: int) -> np.ndarray:
    """A sum of products for the ``size`` bytes from each place; what collides is at worst looked at in vain."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights, out = _eights(raw), np.empty(n, np.uint64)
    part = np.empty(min(n, SOME), np.uint64)
    for first in range(0, n, SOME):  # what is not kept stays in a core's cache
        here = out[first : first + SOME]
        np.multiply(eights[first : first + len(here)], FACTORS[0], out=here)
        for k, at in enumerate(_places(size)[1:], 1):
            here += np.multiply(eights[first + at : first + at + len(here)], FACTORS[k], out=part[: len(here)])
    return out


def _sums_at(raw: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """As :func:`_sums`, for some places."""
    eights, out = _eights(raw), np.zeros(len(places), np.uint64)
    for k, at in enumerate(_places(size)):
        out += eights[places + at] * FACTORS[k]
    return out


def _distinct(raw: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each text of ``windows`` windows from ``begin``, equal texts having one; the first text of each number.

    Numbers ascend with the first texts. Texts of equal hashes are compared, and all are looked up if two differ.
    """
    hashes = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), SOME):
        here = slice(at, at + SOME)
        ends = _sums_at(raw, begin[here] + windows[here] - 1, length)  # the first and the last window cover a text
        hashes[here] = _mix(_sums_at(raw, begin[here], length) + ends * ODD[2] + windows[here].astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
    first = order[new]
    del hashes
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    number = np.empty(len(begin), np.int32)
    number[order] = rank[np.cumsum(new, dtype=np.int32) - 1]
    del order, new, rank
    first = np.sort(first)
    others = np.ones(len(begin), bool)
    others[first] = False
    again = np.flatnonzero(others)
    eights, equal = _eights(raw), True
    for at in range(0, len(again), SOME):
        one = again[at : at + SOME]
        other = first[number[one]]
        equal = equal and (windows[one] == windows[other]).all()
        last = np.minimum(windows[one], windows[other]) - 1
        for k in _places(length):
            equal = equal and (eights[begin[one] + k] == eights[begin[other] + k]).all()
            equal = equal and (eights[begin[one] + last + k] == eights[begin[other] + last + k]).all()
    if not equal:
        known: dict[bytes, int] = {}
        whole = raw.tobytes()
        number = np.array([known.setdefault(whole[b : b + w + length - 1], len(known)) for b, w in zip(begin.tolist(), windows.tolist())], np.int32)
        first = np.unique(number, return_index=True)[1]
    return number, first


def _anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Anchor of the window from each place, not mixed; ``NONE`` where the text ends before the window does."""
    if len(raw) < length:
        return np.full(len(raw), NONE)
    least = _sums(raw, GRAM)
    grams, width = length - GRAM + 1, 1
    while width * 2 <= grams:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    out = np.full(len(raw), NONE)
    np.minimum(least, NONE - np.uint64(1), out=out[: len(least)])
    for end in ends.tolist():
        out[max(0, end - length + 1) : end] = NONE
    return out


class Docs:
    """Documents of a group: ids (``NO_ID`` for null) and texts as bytes."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts = ids, texts

    def packed(self) -> bytes:
        sizes = np.array([len(x) for x in self.texts], np.int64)
        head = np.array([len(sizes), *self.ids], np.int64).tobytes() + sizes.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(self.texts))

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Docs:
        ids, texts = [], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids += np.frombuffer(raw, np.int64, n, 8).tolist()
            ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 8 * n)) + 8 + 16 * n
            texts += [raw[a:b] for a, b in zip([8 + 16 * n, *ends.tolist()], ends.tolist())]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        return cls([ids[i] for i in order], [texts[i] for i in order])

    def runs(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By chunks of texts: (first document, bytes, ends of texts, then of each run document, start, windows) and anchors."""
        at = 0
        while at < len(self.texts):
            last, size = at, 0
            while last < len(self.texts) and (last == at or size + len(self.texts[last]) <= CHUNK):
                size += len(self.texts[last])
                last += 1
            raw = np.frombuffer(b"".join(self.texts[at:last]), np.uint8)
            ends = np.cumsum([len(x) for x in self.texts[at:last]])
            anchor = _anchors(raw, ends, length)
            edges = np.append(np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), len(anchor))
            edges = edges[: len(edges) if len(anchor) else 1]
            held = anchor[edges[:-1]] != NONE
            start, stop = edges[:-1][held], edges[1:][held]
            parts = -(-(stop - start) // RUN)
            n = np.repeat(start, parts)
            shift = (np.arange(len(n)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
            begin = n + shift
            windows = np.minimum(np.repeat(stop, parts) - begin, RUN)
            yield at, raw, ends, begin, windows, _mix(anchor[begin]) if len(begin) else np.zeros(0, np.uint64)
            at = last


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _key(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low bits of each anchor, by which it is known."""
    return (_bucket(anchors, buckets).astype(np.uint64) << np.uint64(LOW)) | (anchors & np.uint64((1 << LOW) - 1))


def _low(hashes: np.ndarray) -> bytes:
    """The low five bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_low(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _split(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, positions) of each distinct key, positions in their order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[x[0]]), x) for x in np.split(order, cuts) if len(x)]


# --- 1: anchors that documents share


def _offered(docs: Docs, length: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each bucket the group's anchors, in order, and whether two of its documents share each."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for first, _, ends, begin, _, anchor in docs.runs(length):
        keys.append(_key(anchor, buckets))
        owners.append((np.searchsorted(ends, begin, side="right") + first).astype(np.int32))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    del keys, owners
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    del order
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(heads):
        return
    many = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
    key = key[heads]
    bucket = key >> np.uint64(LOW)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=NONE)), len(key)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), _low(key[a:b]), np.packbits(many[a:b]).tobytes()


def _shared(bucket: pd.DataFrame, heavy: int) -> pd.DataFrame:
    """For each offer the anchors (as positions in it) that two documents share, and of these the heavy ones."""
    offers = [_from_low(x) for x in bucket["anchors"]]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)).astype(bool) for x, o in zip(bucket["many"], offers)]
    anchor, inverse, count = np.unique(np.concatenate(offers), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inverse[np.concatenate(many)]] = True
    of = np.split(inverse, np.cumsum([len(o) for o in offers])[:-1])
    return pd.DataFrame(
        {
            "g": bucket["g"],
            "bucket": bucket["bucket"],
            "anchors": [_low(anchor[i][shared[i]]) for i in of],
            "heavy": [np.packbits((count[i] >= heavy)[shared[i]]).tobytes() for i in of],
        }
    )


# --- 2: runs of shared anchors


class Shared:
    """The anchors of a group that documents share, from the buckets' replies."""

    def __init__(self, replies: pd.DataFrame, buckets: int):
        self.buckets = buckets
        keys, heavy = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for bucket, anchors, bits in zip(replies["bucket"], replies["anchors"], replies["heavy"]):
            low = _from_low(anchors)
            keys.append(low | (np.uint64(bucket) << np.uint64(LOW)))
            heavy.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(low)).astype(bool))
        keys, heavy = np.concatenate(keys), np.concatenate(heavy)
        order = np.argsort(keys)
        self.keys, self.heavy = keys[order], heavy[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.keys & np.uint64((1 << SIEVE) - 1)).astype(np.int64)] = True

    def find(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor is shared, and whether it is heavy."""
        there, heavy = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        maybe = np.flatnonzero(self.sieve[(anchors & np.uint64((1 << SIEVE) - 1)).astype(np.int64)])
        if len(maybe):
            keys = _key(anchors[maybe], self.buckets)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there[maybe] = self.keys[at] == keys
            heavy[maybe] = there[maybe] & self.heavy[at]
        return there, heavy


class Pieces:
    """The distinct runs of a group that buckets must judge, in a fixed order.

    ``where`` has, for every run of a shared anchor, its document, start,
    windows and number among the distinct; documents come in order of id.
    """

    def __init__(self, docs: Docs, shared: Shared, length: int, buckets: int):
        self.whole = b"".join(docs.texts)
        view, ends = memoryview(self.whole), np.cumsum([len(x) for x in docs.texts], dtype=np.int64).tolist()
        docs.texts = [view[a:b] for a, b in zip([0, *ends], ends)]  # the texts are held once
        runs = []
        at = 0  # bytes of the texts before the chunk
        for first, raw, ends, begin, windows, anchor in docs.runs(length):
            there, heavy = shared.find(anchor)
            begin, windows, anchor, heavy = begin[there], windows[there], anchor[there], heavy[there]
            if heavy.any():  # one window each, dealt by its own hash
                n = np.where(heavy, windows, 1)
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin, single = np.repeat(begin, n) + shift, np.repeat(heavy, n)
                windows, anchor = np.where(single, 1, np.repeat(windows, n)), np.repeat(anchor, n)
                anchor[single] = _mix(_sums_at(raw, begin[single], length))
            owner = np.searchsorted(ends, begin, side="right")
            start = begin - np.append(0, ends)[owner]
            small = ((owner + first).astype(np.int32), start.astype(np.int32), windows.astype(np.int32), _bucket(anchor, buckets).astype(np.int32))
            runs.append((*small, begin + at))
            at += len(raw)
        owner, start, windows, bucket, begin = (np.concatenate(x) for x in zip(*runs)) if runs else np.zeros((5, 0), np.int32)
        del runs
        number, first = _distinct(np.frombuffer(self.whole, np.uint8), begin, windows, length)
        self.bucket, self.first = bucket[first], owner[first]  # least document that has it
        self.begin, self.end = begin[first], begin[first] + windows[first] + length - 1
        self.where = [owner, start, windows, number]

    def by_bucket(self) -> list[tuple[int, np.ndarray]]:
        return _split(self.bucket)

    def texts(self, some: np.ndarray) -> list[bytes]:
        return [self.whole[a:b] for a, b in zip(self.begin[some].tolist(), self.end[some].tolist())]

    def found(self) -> Found:
        return Found(self.bucket, self.first, self.where)


@dataclass
class Found:
    """What a group keeps of its pieces: bucket and least document of each, and where the runs are."""

    bucket: np.ndarray
    first: np.ndarray
    where: list[np.ndarray]  # of each run document, start, windows, number of its piece

    def by_bucket(self) -> list[tuple[int, np.ndarray]]:
        return _split(self.bucket)

    def packed(self) -> bytes:
        """Columns of differences, which are small, compressed."""
        owner, start, windows, number = self.where
        head = np.array([len(self.bucket), len(owner)], np.int64).tobytes()
        steps = [np.diff(x, prepend=0).astype(np.int32).tobytes() for x in (self.first, owner, start, number)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, self.bucket.astype(np.int32).tobytes(), *steps, windows.astype(np.uint8).tobytes()]))

    @classmethod
    def unpacked(cls, blob: bytes) -> Found:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, runs = np.frombuffer(raw, np.int64, 2).tolist()
        parts, at = [], 16
        for size in (n, n, runs, runs, runs):
            parts.append(np.frombuffer(raw, np.int32, size, at).astype(np.int64))
            at += 4 * size
        bucket, first, owner, start, number = parts
        windows = np.frombuffer(raw, np.uint8, runs, at).astype(np.int64)
        return cls(bucket, np.cumsum(first), [np.cumsum(owner), np.cumsum(start), windows, np.cumsum(number)])


def _asked(docs: Docs, pieces: Pieces) -> Iterator[tuple[int, bytes]]:
    first = np.array(docs.ids, np.int64)[pieces.first]
    for bucket, at in pieces.by_bucket():
        sizes = (pieces.end[at] - pieces.begin[at]).astype(np.int32)
        head = np.array([len(at)], np.int64).tobytes() + first[at].tobytes() + sizes.tobytes()
        yield bucket, zstandard.ZstdCompressor(level=2).compress(head + b"".join(pieces.texts(at)))


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of the suffixes in the order of at least their first ``depth`` symbols; their first symbols in one integer, and how many these are (fewer than ``depth``).

    Suffixes that are told apart already keep their place; the others are
    ordered by the ranks of what follows, two or three times as deep a round.
    """
    n = len(text)
    dense = (np.cumsum(np.bincount(text) > 0) - 1).astype(np.int16)[text]  # symbols that occur, numbered in order
    bits = max(1, int(dense.max()).bit_length())
    step = known = min(63 // bits, n, depth)
    key = np.zeros(n, np.int64)
    for k in range(known):
        key <<= bits
        key[: n - k] |= dense[k:]
    del dense
    order = np.argsort(key)
    first = key[order]
    del key
    new = np.append(np.diff(first, prepend=-1) != 0, True)
    rank = np.empty(n, np.int64)  # place of the first suffix that is equal so far, from 1
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(1, n + 1), 0))
    open_ = np.flatnonzero(~(new[:-1] & new[1:]))
    times, width = (3, 21) if n < TRIPLED else (2, 31)
    del new
    while step < depth and len(open_):
        sub = order[open_]
        key = rank[sub]
        for k in range(1, times):
            after = sub + k * step
            key = (key << width) | np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[open_] = sub
        new = np.append(np.diff(key, prepend=-1) != 0, True)
        rank[sub] = np.maximum.accumulate(np.where(new[:-1], open_ + 1, 0))
        open_ = open_[~(new[:-1] & new[1:])]
        step *= times
    if known == depth:  # one symbol more than the windows have, which must not part them
        first, known = first >> bits, known - 1
    return order.astype(np.int32), first, known


def _rows_before(back: np.ndarray, steps: dict[int, np.ndarray], step: int) -> np.ndarray:
    """The row ``step`` symbols on, from those of powers of two, which ``steps`` keeps."""
    rows, power = None, 1
    while power <= step:
        if power not in steps:
            steps[power] = steps[power // 2][steps[power // 2]] if power > 1 else back
        if step & power:
            rows = steps[power] if rows is None else steps[power][rows]
        power *= 2
    return rows


def equal_windows(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, class): suffixes in order, and a class that those with the same first ``length`` symbols share.

    ``text`` ends with its least symbol. The transform is that of the order by
    at least ``length`` symbols; among suffixes equal that far any order will
    do. All open intervals of suffixes with a common prefix are extended
    backwards together, breadth first, by at most as many symbols a level as are known: the rows
    that a row stems from follow from the transform, and an interval ends
    between two rows if their new symbols differ or one ended between the rows
    they stem from. So the common prefixes come out by increasing value, up to
    ``length``; rows already parted are not looked at again.
    """
    starts, first, known = _suffixes(text, length + 1)
    transform = text[starts - 1]  # the symbol before each suffix
    back = np.argsort(transform, kind="stable").astype(np.int32)  # the row without the first symbol
    known = min(known, length)
    parted = np.diff(first, prepend=-1) != 0  # common prefixes below what one integer holds
    open_ = np.flatnonzero(~parted)
    steps: dict[int, np.ndarray] = {}
    while known < length and len(open_):
        step = min(known, length - known)
        interval = np.cumsum(parted, dtype=np.int32)
        rows = _rows_before(back, steps, step)
        split = interval[rows[open_]] != interval[rows[open_ - 1]]
        parted[open_[split]] = True
        open_ = open_[~split]
        known += step
    return starts, np.cumsum(parted, dtype=np.int64)


def judge_pieces(texts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of each distinct piece, end to end, the least document that has it; and the pieces' first windows."""
    sizes = np.array([len(x) for x in texts], np.int64)
    n_windows = sizes - length + 1
    first = np.cumsum(n_windows) - n_windows
    out = np.repeat(least, n_windows)
    # each piece is closed by a symbol below all bytes
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined[begin + sizes] = 0
    starts, same = equal_windows(joined, length)
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    window = np.arange(len(joined)) - begin[piece] <= (sizes - length)[piece]
    number = np.cumsum(window) - 1  # windows are numbered by place
    here = window[starts]
    starts, same = starts[here], same[here]
    if len(same):
        heads = np.flatnonzero(np.diff(same, prepend=-1) != 0)
        low = np.minimum.reduceat(least[piece[starts]], heads)
        out[number[starts]] = np.repeat(low, np.diff(np.append(heads, len(same))))
    return out, first


def _piece_anchors(texts: list[bytes]) -> np.ndarray:
    """The anchor that all windows of each piece have."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    hashes = np.append(_sums(np.frombuffer(b"".join(texts), np.uint8), GRAM), NONE)
    return np.minimum.reduceat(hashes, np.stack([begin, begin + sizes - GRAM + 1], axis=1).ravel())[::2]


def _with_company(texts: list[bytes], length: int) -> np.ndarray:
    """Whether another window has the hash of one of the text's windows: a text without has no window that another has."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begin, n = np.cumsum(sizes) - sizes, sizes - length + 1
    first = np.cumsum(n) - n
    sums = _sums(np.frombuffer(b"".join(texts), np.uint8), length)[np.arange(n.sum()) + np.repeat(begin - first, n)]
    order = np.argsort(sums)
    same = np.flatnonzero(sums[order[1:]] == sums[order[:-1]])
    found = np.zeros(len(sums), bool)
    found[order[same]] = found[order[same + 1]] = True
    return np.logical_or.reduceat(found, first)


def _judged(bucket: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each group a mask for each of its pieces: windows that a smaller document has."""
    asks, parts = [], []
    for blob in bucket["pieces"]:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        asks.append((np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64)))
        parts.append(raw[8 + 12 * n :])
    whole = b"".join(parts)
    del parts
    docs, sizes = (np.concatenate(x) for x in zip(*asks))
    begin = np.cumsum(sizes) - sizes
    number, first = _distinct(np.frombuffer(whole, np.uint8), begin, sizes - length + 1, length)
    order = np.argsort(number, kind="stable")
    least = np.minimum.reduceat(docs[order], np.searchsorted(number[order], np.arange(len(first))))
    n_windows = sizes[first] - length + 1
    texts = [whole[a:b] for a, b in zip(begin[first].tolist(), (begin + sizes)[first].tolist())]
    # equal windows have equal anchors: a text with an anchor of its own shares none
    _, inverse, count = np.unique(_piece_anchors(texts), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[inverse] > 1)
    if len(several):
        several = several[_with_company([texts[i] for i in several.tolist()], length)]
    bits = np.zeros(len(texts), np.uint32)  # windows of each piece that a smaller document has than the piece's least one
    if len(several):
        found, first = judge_pieces([texts[i] for i in several.tolist()], least[several], length)
        n = n_windows[several]
        lower = (found < np.repeat(least[several], n)).astype(np.uint32)
        bits[several] = np.bitwise_or.reduceat(lower << (np.arange(len(found)) - np.repeat(first, n)).astype(np.uint32), first)
    every = ((np.uint64(1) << n_windows.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    masks = []
    for (docs, _), at in zip(asks, np.split(number, np.cumsum([len(x) for x, _ in asks])[:-1])):  # all windows of a piece are in its least document
        mask = np.where(least[at] < docs, every[at], bits[at])
        masks.append(zstandard.ZstdCompressor(level=1).compress(mask.astype("<u4").tobytes()))
    return pd.DataFrame({"g": bucket["g"], "bucket": bucket["bucket"], "masks": masks})


# --- 3: spans


def _spans(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """(begin, end) of the maximal runs of bytes that the windows from ``starts`` (sorted) cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + length)
    begin = starts[new]
    end = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + length
    return np.stack([begin, end], axis=1)


def _removed(docs: Docs, pieces: Found, masks: dict[int, np.ndarray], length: int) -> Iterator[np.ndarray]:
    """The removed spans of each document."""
    owner, start, windows, number = pieces.where
    mask = np.zeros(len(pieces.bucket), np.uint32)
    for bucket, at in pieces.by_bucket():
        mask[at] = masks[bucket]
    ids = np.array(docs.ids, np.int64)
    first = ids[pieces.first] if len(pieces.first) else ids[:0]
    # a later document of the group has all its windows in the first one
    mine = np.where(ids[owner] > first[number], np.uint32(0xFFFFFFFF), mask[number]) if len(owner) else mask[:0]
    hits_owner, hits = [owner[:0]], [start[:0]]
    for at in range(0, len(mine), SOME):  # the runs are in the order of documents and starts, so their windows are too
        here = slice(at, at + SOME)
        each = np.unpackbits(mine[here].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        run, k = np.nonzero(each & (np.arange(RUN) < windows[here, None]))
        hits_owner.append(owner[here][run])
        hits.append(start[here][run] + k)
    owner, start = np.concatenate(hits_owner), np.concatenate(hits)
    bounds = np.searchsorted(owner, np.arange(len(docs.ids) + 1))
    for i, text in enumerate(docs.texts):
        yield _spans(len(text), start[bounds[i] : bounds[i + 1]], length)


def repeated_spans(docs: DataFrame, length: int = 50, with_text: bool = False, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256 (and kept, the bytes left).

    ``docs`` has an integer doc_id and text; other columns are ignored. Null
    text counts as empty; a null id counts as larger than any. Rows with one id
    don't remove from each other, nor do rows without one. Matches never cross
    documents. ``spans`` lists begin and end of each removed run of bytes in
    turn. An empty table gives an empty result.
    """
    if not 32 <= length <= 256:
        raise ValueError("length must be from 32 to 256 bytes")
    spark = docs.sparkSession
    limit_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, buckets = slices(total, group_bytes), slices(total, bucket_bytes)
    docs = file_backed(docs.select("doc_id", "text"))
    place = F.pmod(F.xxhash64(locator(docs)), F.lit(groups)).cast("long")
    dealt = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"), place.alias("g"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        size = 0
        for batch in batches:
            missing = batch["doc_id"].isna().to_numpy()
            ids = [NO_ID if m else int(i) for i, m in zip(batch["doc_id"], missing)]
            for i, t, g in zip(ids, batch["text"], batch["g"]):
                t = t.encode("utf-8", "surrogatepass")
                ids_of, texts_of = held.setdefault(g, ([], []))
                ids_of.append(i)
                texts_of.append(t)
                size += len(t)
            if size >= PACKED:
                yield pd.DataFrame([(g, Docs(*x).packed()) for g, x in held.items()], columns=["g", "docs"])
                held, size = {}, 0
        if held:
            yield pd.DataFrame([(g, Docs(*x).packed()) for g, x in held.items()], columns=["g", "docs"])

    packed = dealt.mapInPandas(pack, "g long, docs binary")

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, blob in zip(batch["g"], batch["docs"]):
                rows = list(_offered(Docs.unpacked([blob]), length, buckets))
                out = pd.DataFrame(rows, columns=["bucket", "anchors", "many"])
                out.insert(0, "g", g)
                yield out

    offers = packed.mapInPandas(offer, "g long, bucket long, anchors binary, many binary")
    replies = stored(offers.groupBy("bucket").applyInPandas(lambda x: _shared(x, heavy), "g long, bucket long, anchors binary, heavy binary"), "shared")

    def ask(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        docs = Docs.unpacked(group["docs"].tolist())
        pieces = Pieces(docs, Shared(answers, buckets), length, buckets)
        number = int(group["g"].iloc[0]) if len(group) else 0
        # the group's own findings go by a bucket of their own, below 0
        out = pd.DataFrame([*_asked(docs, pieces), (-1 - number, pieces.found().packed())], columns=["bucket", "pieces"])
        out.insert(0, "g", number)
        return out

    def judge(bucket: pd.DataFrame) -> pd.DataFrame:
        if bucket["bucket"].iloc[0] < 0:
            return bucket.rename(columns={"pieces": "masks"})
        return _judged(bucket, length)

    asks = packed.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(ask, "g long, bucket long, pieces binary")
    masks = stored(asks.groupBy("bucket").applyInPandas(judge, "g long, bucket long, masks binary"), "masks")

    def finish(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        docs = Docs.unpacked(group["docs"].tolist())
        own = answers["bucket"] < 0
        pieces = Found.unpacked(answers.loc[own, "masks"].iloc[0])
        answers = answers[~own]
        found = {b: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4") for b, x in zip(answers["bucket"], answers["masks"])}
        rows = []
        for i, text, spans in zip(docs.ids, docs.texts, _removed(docs, pieces, found, length)):
            edges = [0, *spans.ravel().tolist(), len(text)]
            kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]) if len(spans) else text
            rows.append((None if i == NO_ID else i, len(text), len(text) - len(kept), len(spans), spans.ravel(), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string, kept binary"
    out = packed.groupBy("g").cogroup(masks.groupBy("g")).applyInPandas(finish, schema)
    return out if with_text else out.drop("kept")
