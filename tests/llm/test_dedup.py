import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts, prose
from trialspark.llm import exact_dedup, minhash, suffix_dedup
from trialspark.llm.components import components

SPACES = " \t\n\x0b\x0c\r"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def exact_expected(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups["".join(c for c in t or "" if c not in SPACES)].append((-len(t or ""), i is None, i, t))
    out = {}
    for members in groups.values():
        first = min(members, key=lambda m: m[:3] if m[2] is not None else (m[0], True, 0))
        for m in members:
            out[m[2]] = (first[2], len(members))
    return out


@pytest.mark.parametrize("files", [None, 1])
def test_exact_groups_match_brute_force(spark, files):
    texts = odd_texts() + [prose(k % 5, 30).replace(" ", " " * (1 + k % 3)) for k in range(30)]
    docs = documents(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, files_per_trigger=files).collect()}
    want = exact_expected(list(enumerate(texts)))
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items())
    assert all(r["digest"] == hashlib.sha256("".join(c for c in texts[i] or "" if c not in SPACES).encode()).hexdigest() for i, r in got.items())


def test_exact_full_bytes_split_a_shared_digest(spark):
    texts = ["a b", "ab", "c", "c ", "d", None]
    weak = lambda content: F.substring(F.sha2(content.cast("binary"), 256), 1, 0)  # noqa: E731  one digest for all
    got = exact_dedup.exact_groups(documents(spark, texts), digest=weak)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == exact_expected(list(enumerate(texts)))


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    docs = documents(spark, ["x y", "x y", "x y", "z", "z"], [7, 7, None, None, None])
    got = exact_dedup.exact_groups(docs)
    assert got.where("kept").count() == 2
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["x y", "z"]
    assert rows_of(got, "keep_id", "group_size") == sorted([(7, 3)] * 3 + [(None, 2)] * 2, key=repr)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_expected(pairs, width, percent):
    sets = {i: shingle_set(t, width) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, seed, n):
    rnd = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force(spark, width, percent):
    base = [prose(100 + k, 120) for k in range(4)]
    texts = odd_texts() + [edited(base[k % 4], k, k % 6) for k in range(60)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(docs, width, percent).collect()}
    assert got == near_expected(list(enumerate(texts)), width, percent)


def test_near_blocks_find_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 7)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    texts = [edited(prose(9, 100), k, k % 5) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(documents(spark, texts), 3, 85).collect()}
    assert got == near_expected(list(enumerate(texts)), 3, 85)


def test_near_null_ids_repeated_rows_and_empty_table(spark):
    text = prose(5, 60)
    docs = documents(spark, [text, text, text, "", None], [4, 4, None, None, 9])
    got = minhash.near_groups(docs)
    assert rows_of(got, "doc_id", "component_id", "kept") == sorted(
        [(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (9, 9, True)], key=repr
    )
    assert minhash.keep_one(docs).columns == docs.columns
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}}


def repeats_expected(pairs, length):
    """Removed positions of each document, by the definition."""
    out, seen = [], set()
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0))
    pending, last = set(), object()
    found = {}
    for k in order:
        i, t = pairs[k]
        if i != last:
            seen |= pending
            pending, last = set(), i
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            pending.add(window)
        found[k] = gone
    for k, (i, t) in enumerate(pairs):
        raw, gone = (t or "").encode(), found[k]
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for at, g in enumerate(gone) if g and (at == 0 or not gone[at - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,bucket,heavy", [(1 << 24, 1 << 22, 256), (2000, 1000, 256), (2000, 1000, 2)])
def test_repeated_spans_match_brute_force(spark, group, bucket, heavy):
    passage, line = prose(50, 20), prose(51, 9)
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "ab" * 300, "ab" * 200 + "c", "\0" * 120, "\0" * 60 + "é" * 40]
    texts += [f"{prose(k, 25)} {passage} {prose(200 + k, 15)}" for k in range(25)] + [prose(3, 25)] * 3
    texts += [f"{prose(400 + k, 12)}\n{line}\n{line[:50]}" for k in range(8)] + ["é" * 30, "aé" * 40]
    pairs = list(enumerate(texts)) + [(None, passage), (None, passage + "!"), (3, passage)]
    docs = documents(spark, [t for _, t in pairs], [i for i, _ in pairs]).repartition(4)
    got = suffix_dedup.repeated_spans(docs, group_bytes=group, bucket_bytes=bucket, heavy=heavy, with_text=True)
    rows = got.collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows], key=repr) == repeats_expected(pairs, 50)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == 2 * r["n_spans"] for r in rows)


def test_repeated_spans_of_long_texts_and_an_empty_table(spark):
    long = prose(1, 20_000)
    docs = documents(spark, [long, long[1000:] + "tail", "x"])
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_spans(docs, group_bytes=10_000).collect()}
    assert got == {0: 0, 1: len(long) - 1000, 2: 0}
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_equal_windows_are_the_classes_of_prefixes():
    import numpy as np

    rnd = random.Random(4)
    text = np.array([rnd.randrange(1, 3) for _ in range(400)] + [0], np.int16)
    starts, same = suffix_dedup.equal_windows(text, 33)
    groups = collections.defaultdict(set)
    for s, c in zip(starts.tolist(), same.tolist()):
        groups[c].add(s)
    want = collections.defaultdict(set)
    for s in range(len(text)):
        want[tuple(text[s : s + 33].tolist())].add(s)
    full = {frozenset(v) for k, v in want.items() if len(k) == 33}
    assert full <= {frozenset(v) for v in groups.values()}


def _pieces(rnd, n, letters):
    base = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(50, 82))) for _ in range(n)]
    return list(dict.fromkeys(base + [x[rnd.randrange(0, 9):] + y[:20] for x, y in zip(base, base[1:])]))


@pytest.mark.parametrize("tripled", [suffix_dedup.TRIPLED, 0])
@pytest.mark.parametrize("letters", [b"ab", bytes(range(256)), b"\x00\xff", b"z"])
def test_least_documents_of_windows_equal_brute_force(monkeypatch, tripled, letters):
    """Few and many symbols, ranks of two and of three stretches at a time."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "TRIPLED", tripled)
    rnd = random.Random(len(letters))
    texts = [x for x in _pieces(rnd, 40, letters) if 50 <= len(x) <= 81]
    least = np.array([rnd.randrange(100) for _ in texts])
    got, first = suffix_dedup.judge_pieces(texts, least, 50)
    want = collections.defaultdict(lambda: 100)
    for text, d in zip(texts, least.tolist()):
        for i in range(len(text) - 49):
            want[text[i : i + 50]] = min(want[text[i : i + 50]], d)
    assert got.tolist() == [want[t[i : i + 50]] for t in texts for i in range(len(t) - 49)]
    assert first.tolist() == np.cumsum([0] + [len(t) - 49 for t in texts])[:-1].tolist()


def test_suffixes_told_apart_are_not_sorted_again(monkeypatch):
    """One sort of all suffixes, one of the transform, and then only what is still equal."""
    import numpy as np

    rnd = random.Random(9)
    text = np.frombuffer(b"\0".join(_pieces(rnd, 300, b"etaoinshrdlu ")) + b"\0", np.uint8).astype(np.int16)
    sorted_, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *args, **kwargs: (sorted_.append(len(x)), real(x, *args, **kwargs))[1])
    suffix_dedup.equal_windows(text, 50)
    assert sum(sorted_) <= 4 * len(text)  # it was five times, whatever the text


def test_families_are_chained_by_component(spark, monkeypatch):
    """Many nodes of one component in many buckets make one edge for each other component, not one a node."""
    words = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([(i, words) for i in range(30)] + [(30, words), (31, "a b c d e f g")], "doc_id long, text string")
    rows = [(key, node, 0) for key in range(5) for node in range(30)] + [(0, 30, 30), (1, 31, 31)]
    seen = []
    monkeypatch.setattr(minhash, "components", lambda edges: seen.append(edges.count()) or components(edges))
    links = minhash._across(spark.createDataFrame(rows, "key long, node long, component long"), texts, 5, 80)
    found = {(r.u, r.v) for r in links.collect()}
    assert seen == [2]
    assert found == {(30, i) for i in range(30)}  # every link across components, and none to the other text


def test_windows_of_one_repeated_byte_are_not_parted_by_what_follows():
    """A bucket whose pieces have one byte only: more symbols than a window's fit one integer."""
    import numpy as np

    got, _ = suffix_dedup.judge_pieces([b"x" * 50, b"x" * 51], np.array([4, 5]), 50)
    assert got.tolist() == [4, 4, 4]  # the last was 5


def test_only_pieces_with_an_equal_window_are_sorted(monkeypatch):
    """Pieces of one anchor without an equal window don't reach the transform, and masks stay those of brute force."""
    import numpy as np
    import pandas as pd
    import zstandard

    rnd = random.Random(3)
    stem = bytes(rnd.randrange(256) for _ in range(25))
    some = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    monkeypatch.setattr(suffix_dedup, "_piece_anchors", lambda texts: np.zeros(len(texts), np.uint64))
    shared = some(13) + stem + some(13)
    asked = [[some(20) + stem + some(12) for _ in range(40)] + [shared + some(4)], [some(20) + stem + some(12) for _ in range(40)] + [some(3) + shared]]
    blobs = []
    for k, texts in enumerate(asked):
        head = np.array([len(texts)], np.int64).tobytes() + np.full(len(texts), k, np.int64).tobytes() + np.array([len(x) for x in texts], np.int32).tobytes()
        blobs.append(zstandard.ZstdCompressor().compress(head + b"".join(texts)))
    sorted_, real = [], suffix_dedup.judge_pieces
    monkeypatch.setattr(suffix_dedup, "judge_pieces", lambda texts, *rest: (sorted_.append(len(texts)), real(texts, *rest))[1])
    masks = suffix_dedup._judged(pd.DataFrame({"g": [0, 1], "bucket": [0, 0], "pieces": blobs}), 50)["masks"]
    first, second = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4") for x in masks)
    assert not first.any() and not second[:40].any() and second[40] == 0b11000  # windows 3 and 4 are in document 0
    assert sorted_ == [2]  # it was all 82


def test_equal_hashes_of_different_texts_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "_mix", lambda x: x & np.uint64(3))
    texts = [prose(k, 20).encode()[:60] for k in (1, 2, 3, 1, 2, 4, 5, 1)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    number, first = suffix_dedup._distinct(raw, np.arange(8) * 60, np.full(8, 11), 50)
    assert number.tolist() == [0, 1, 2, 0, 1, 3, 4, 0] and first.tolist() == [0, 1, 2, 5, 6]
