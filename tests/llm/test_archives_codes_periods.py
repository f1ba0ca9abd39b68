"""Archives (op11), vector codes (op12) and periodic runs (op13) against plain definitions."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts, prose
from trialspark.llm import periods, queries, vector_codes, warc
from trialspark.llm.common import stored

CLASHING = ("id", "key", "hot", "own", "met", "n", "first", "payload", "sha1", "n_bytes", "label_error", "code", "error", "cells", "position", "part", "runs", "start")


def clash(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


# --- archives


def page_rows():
    rnd = random.Random(4)
    pages = [(i, f"https://h{i % 7}.example/{i}", f"<html><p>{prose(i, 40)}</p></html>") for i in range(300)]
    pages += [(300 + i, "https://copy.example/", pages[rnd.randrange(300)][2]) for i in range(120)]
    pages += [(500 + i, None, "") for i in range(5)] + [(510, "u", None), (511, "a b\r\nX: y", "q"), (-3, "u", "q"), (None, "u", "q")]
    pages += [(600, "u", prose(9, 120_000)), (7, pages[7][1], pages[7][2])]  # a very long payload, a repeated row
    return pages


def plain_records(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        start = first.get(html or "", i)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "response" if i == start else "revisit", None if i == start else start))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "least"), [(0.001, 0), (2.0, 0), (0.02, 100)])
def test_archive_round_trip(spark, monkeypatch, hot, least):
    monkeypatch.setattr(warc, "HOT", hot)
    pages = page_rows()
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string")).repartition(3)
    got = warc.round_trip(df, min_bytes=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_records(pages, least)


def test_archive_of_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []


def test_archives_hold_a_dictionary_and_a_frame_per_record(spark, tmp_path):
    """Read with the library alone: sizes of frames, the skippable frame, whole payloads and URLs."""
    pages = page_rows()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    manifest = warc.archive(df, folder=str(tmp_path / "w"), archive_bytes=20_000)
    files = manifest.collect()
    assert len(files) > 2 and sum(f.n_records for f in files) == len(pages)
    seen, dictionaries = [], 0
    for f in files:
        data = open(f.path, "rb").read()
        assert len(data) == f.n_bytes
        decoder = zstandard.ZstdDecompressor()
        if data[:4] == bytes.fromhex("5d2a4d18"):
            size = int.from_bytes(data[4:8], "little")
            trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
            data, dictionaries = data[8 + size :], dictionaries + 1
        while data:
            one = decoder.decompressobj()
            text = one.decompress(data)
            data = one.unused_data
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Type: ") >= 1
            seen.append(text)
    assert dictionaries >= 2
    assert len(seen) == len(pages) + len(files)  # and a warcinfo record an archive
    back = warc.read_archives(spark, manifest).collect()
    assert sum(r.record_type == "response" for r in back) == sum(b"WARC-Type: response" in t[:80] for t in seen)
    payloads = {r.record_id: bytes(r.payload).decode() for r in back if r.record_type == "response"}
    for i, _, html in pages:
        if f"urn:x-row:{i}" in payloads:
            assert payloads[f"urn:x-row:{i}"] == (html or "")
    assert {r.target_uri for r in back if r.record_id in ("urn:x-row:511", "urn:x-row:500")} == {"a%20b%0D%0AX:%20y", "about:blank"}


def one_archive(tmp_path, records, dictionary=None):
    path = tmp_path / "a.warc.zst"
    cctx = zstandard.ZstdCompressor(dict_data=dictionary)
    head = b""
    if dictionary is not None:
        raw = dictionary.as_bytes()
        head = (0x184D2A5D).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw  # not compressed
    path.write_bytes(head + b"".join(cctx.compress(r) for r in records))
    return str(path)


def good(i, payload=b"text"):
    return warc.row_record({"id": i, "url": "u", "payload": payload, "n_bytes": len(payload), "sha1": hashlib.sha1(payload).hexdigest(), "refers_to": None}, "2020-01-01T00:00:00Z")


def test_reader_takes_an_uncompressed_dictionary_and_other_skippable_frames(tmp_path):
    records = [good(i, prose(i, 50).encode()) for i in range(400)]
    path = one_archive(tmp_path, records, warc.trained(records))
    with open(path, "ab") as f:
        f.write((0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc")
    rows = list(warc.read_archive(path))
    assert [bytes(r["payload"]) for r in rows] == [prose(i, 50).encode() for i in range(400)]


BROKEN = {
    "version": good(1).replace(b"WARC/1.1", b"WARC/9.9"),
    "length": good(1).replace(b"Content-Length: 82\r\n\r\nHTTP", b"Content-Length: 83\r\n\r\nHTTP"),
    "http length": good(1).replace(b"Content-Length: 4", b"Content-Length: 5"),
    "digest": good(1).replace(b"\r\n\r\ntext", b"\r\n\r\ntexT"),
    "header": good(1).replace(b"WARC-Date: ", b"WARC-Date "),
    "missing": good(1).replace(b"WARC-Date:", b"X-Date:"),
    "not a number": good(1).replace(b"Content-Length: 82", b"Content-Length: 8x"),
    "two records": good(1) + good(2),
    "no record": b"abc",
}


@pytest.mark.parametrize("case", BROKEN)
def test_reader_reports_a_broken_record_and_goes_on(tmp_path, case):
    assert BROKEN[case] != good(1)
    path = one_archive(tmp_path, [good(0), BROKEN[case], good(3)])
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(path))
    rows = list(warc.read_archive(path, strict=False))
    assert [r.get("record_id") for r in rows] == ["urn:x-row:0", None, "urn:x-row:3"]
    assert rows[1]["error"] and rows[1]["frame"] == 1


@pytest.mark.parametrize("cut", [1, 3, 20])
def test_reader_reports_a_cut_archive(tmp_path, cut):
    path = one_archive(tmp_path, [good(0), good(1, b"x" * 5000)])
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-cut])
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(path))
    assert [bool(r.get("error")) for r in warc.read_archive(path, strict=False)] == [False, True]
    open(path, "wb").write(data + b"junk")
    assert [bool(r.get("error")) for r in warc.read_archive(path, strict=False)] == [False, False, True]


def test_archives_of_unfinished_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame(page_rows()[:50], "page_id long, url string, html string").coalesce(1)
    manifest = warc.archive(df, folder=str(tmp_path / "w"))
    (tmp_path / "w" / "part-000000-999-0000.warc.zst").write_bytes(b"half a file")
    assert warc.read_archives(spark, manifest).count() == 50


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract step by step, in Python integers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[c[p * size : (p + 1) * size] for p in range(parts)] for _, c, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(pick(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    out, total = [], {}
    for (i, _, label), c in zip(kept, cut):
        best = [pick(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        total[label] = total.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, code, error, total[label], digest) for i, code, error, label in out], key=repr)


def vector_rows(n, size, seed, coarse):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        v = [x + rnd.gauss(0, 0.2) for x in c]
        if coarse:  # ties and shared prefixes
            v = [round(x * 2) / 4096 for x in v]
        rows.append((i * 3 - 20, [float(np.float32(x)) for x in v], rnd.choice([None, 0, 1, 2])))
    rows += [(900, None, 1), (901, [None] * size, 1), (902, [float("nan")] * size, 1), (903, [float("inf")] + [0.0] * (size - 1), 1),
             (904, [-float("inf")] * size, 2), (None, rows[3][1], 2), (rows[5][0], rows[6][1], 0), (905, rows[0][1], None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "size", "coarse"), [(120, 16, False), (200, 24, True), (7, 8, False), (60, 40, True)])
def test_codes_match_the_definition(spark, monkeypatch, n, size, coarse):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)  # walks go on over many blocks
    rows = vector_rows(n, size, n, coarse)
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(3)
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


def test_trie_walk_equals_all_distances():
    rng = np.random.default_rng(3)
    leaves = np.unique(rng.integers(-3, 4, (500, 5)), axis=0)
    entries = rng.integers(-9, 9, (16, 5))
    walk = vector_codes.TrieWalk(entries)
    got = np.vstack([walk.distances(part) for part in np.array_split(leaves, 13)])
    assert (got == ((leaves[:, None] - entries[None]) ** 2).sum(axis=2)).all()


def test_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kinds)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], kinds)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 2)], kinds)).collect() == []  # not in 8 equal parts
    mixed = [(1, [1.0] * 8, 2), (2, [2.0] * 16, 2), (3, [0.5] * 8, None)]
    assert sorted(r.vec_id for r in vector_codes.compress(spark.createDataFrame(mixed, kinds)).collect()) == [1, 3]
    empty = vector_codes.compress(spark.createDataFrame([(1, [], 2)], kinds)).collect()
    assert [(r.vec_id, r.code, r.error) for r in empty] == [(1, "00" * 8, 0)]
    with pytest.raises(Exception, match="component too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 2)], kinds)).collect()


# --- periodic runs


def plain_runs(words):
    """All maximal runs by comparing words q apart, for every q."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            if length >= max(24, 3 * q) and not any(part[p:] == part[: length - p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    words = queries.planted_period(periods.WORD.findall(text or ""), doc_id)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept)


def periodic_text(rnd):
    words = []
    for _ in range(rnd.randint(0, 5)):
        unit = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 14))]
        words += (unit * rnd.randint(1, 12))[: rnd.randint(1, 90)]
    return rnd.choice([" ", "\n", "\t \x0b"]).join(words)


def test_runs_match_the_definition(spark, tmp_path):
    rnd = random.Random(6)
    texts = [t for t in odd_texts() if t is None or len(t) < 50_000] + [periodic_text(rnd) for _ in range(300)] + [prose(k, 120) for k in range(120)]
    texts += ["a b " * 40, " ".join("xy" * 100), "é " * 30]
    docs = documents(spark, texts)
    docs.unionByName(docs.where("doc_id < 4")).write.parquet(f"{tmp_path}/documents.parquet")  # repeated rows
    got = sorted(map(tuple, queries.op13_periods(spark, str(tmp_path)).collect()), key=repr)
    want = [plain_result(i, t) for i, t in enumerate(texts)]
    assert got == sorted(want + want[:4], key=repr)
    assert sum(w[1] > 0 for w in want) > 100


def test_runs_of_null_ids_long_texts_and_no_rows(spark):
    unit = prose(5, 9_000)
    docs = clash(spark.createDataFrame([(None, f"{prose(1, 500)} {unit} {unit} {unit}"), (None, None)], "doc_id long, text string"))
    rows = periods.periodic_runs(docs).collect()
    long = next(r for r in rows if r.n_words)
    assert [(r.length // 9000, r.period) for r in long.runs if r.period == 9000] == [(3, 9000)]
    assert next(r for r in rows if not r.n_words).collapsed == ""
    assert queries.planted_period(["a"] * 30, None) == ["a"] * 30
    assert periods.periodic_runs(docs.where("doc_id = 3")).collect() == []


def test_planted_tail():
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [f"w{k}" for k in range(57)]
    g = zlib.crc32(str(hit).encode()) // 10
    a, p = g % 57, 1 + (57 - g % 57) // (3 + g % 8)
    assert queries.planted_period(words, hit) == [words[i] if i < a else words[a + (i - a) % p] for i in range(57)]


def test_registered_queries_equal_plain_definitions(spark):
    """Whole tables at sf0.001."""
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op11_warc(spark, sf).collect()), key=repr) == plain_records(pages)
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op12_vector_codes(spark, sf).collect()), key=repr) == plain_codes(vectors)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in docs if len((t or "").split()) < 700}
    got = {r.doc_id: tuple(r) for r in stored(queries.op13_periods(spark, sf), "runs").collect()}
    assert len(got) == len(docs) and len(short) > 100
    for i, t in docs:
        if i in short:  # the definition takes the square of the words; longer ones are planted above
            assert got[i] == plain_result(i, t)
