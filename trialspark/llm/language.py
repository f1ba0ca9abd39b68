"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of a bounded sample of its labelled text
accepts every substring of that sample. A text is parsed from left to right
into longest matches against each automaton; the language that needs the
fewest phrases for the text's bytes wins. Samples have one common size; a
language with fewer letters than that pays as much a phrase, and a byte it lacks
is a phrase, so a small sample is never cheap. The phrase count times the
logarithm of the common size, by byte, estimates the cross entropy, which gives
the score.

The automata hold at most ``SAMPLE_BYTES`` bytes of each language, and the ``LANGUAGES`` languages with the most labelled
text are learnt (a label on a few stray rows is none of them where there are more), so their tables have a fixed bound
and are broadcast. Texts are parsed whole: a task lays them out in rows of ``ROW_BYTES`` bytes, so that one numpy
step moves every row of a batch by one byte, and a phrase that crosses rows is carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import limit_batches, text_of

#: Bytes of a language's sample, the same for all, and characters of a slice of text.
SAMPLE_BYTES = 32_000
SLICE_CHARS = 1000
LANGUAGES = 200

#: Bytes that are parsed as one row.
ROW_BYTES = 256

UNDETERMINED = "und"


class Automaton:
    """Suffix automaton of some bytes, as a dense table: state and symbol to next state."""

    def __init__(self, sample: bytes):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sample:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        used = sorted(set(sample))
        self.symbols = len(used) + 1  # symbol 0: no byte of the sample
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, self.symbols)
        table = np.zeros((len(nexts), self.symbols), np.int32)  # 0: no longer match
        for state, edges in enumerate(nexts):
            for c, to in edges.items():
                table[state, self.symbol[c]] = to
        self.table = table.ravel() * self.symbols  # states as offsets into the table

    def phrases(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that start in each row; ``columns`` holds the rows' bytes by position, 0 padding at the end.

        ``follows`` says which rows go on with the text of the row before. All rows are first parsed from
        their own beginning. A row that follows is then entered with the match its predecessor ended in,
        until a phrase starts where one started before: from there on both parses are the same. A row
        without such a place hands its match on to the next one. So the phrases are those of whole texts.
        """
        state = np.zeros(columns.shape[1], np.int32)
        starts = np.zeros(columns.shape, bool)
        for new, column in zip(starts, columns):
            new[:], state = self._step(state, self.symbol[column])
        alone = starts.sum(axis=0)
        count, own_end, end = alone.copy(), state, state.copy()
        todo = np.flatnonzero(follows)
        while len(todo):
            state = end[todo - 1]
            change = np.zeros(len(todo), np.int64)
            open_ = np.arange(len(todo))
            for began, column in zip(starts, columns):
                rows = todo[open_]
                new, state[open_] = self._step(state[open_], self.symbol[column[rows]])
                old = began[rows]
                met = new & old
                change[open_] += new.astype(np.int64) - old
                open_ = open_[~met]
                if not len(open_):
                    break
            count[todo] = alone[todo] + change
            last = own_end[todo]  # rows that met end as by themselves
            last[open_] = state[open_]
            moved = todo[last != end[todo]]
            end[todo] = last
            todo = moved[moved + 1 < len(follows)] + 1
            todo = todo[follows[todo]]
        return count

    def _step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase starts with the symbol, and the state after it."""
        to = self.table[state + c]
        stuck = to == 0
        new = stuck | (state == 0)
        to[stuck] = self.table[c[stuck]]
        return new, to


def normal(text: str) -> bytes:
    """Lower-cased letters with single spaces for all else, as UTF-8; empty if there is no letter."""
    kept = "".join([c if c.isalpha() else " " for c in text.lower()])
    return " ".join(kept.split()).encode("utf-8", "surrogatepass")


def sample(docs: DataFrame, size: int = SAMPLE_BYTES, slice_chars: int = SLICE_CHARS) -> dict[str, list[str]]:
    """Per language ``size`` bytes of letters, or all its distinct letters if there are fewer: slices of texts by hash order.

    Texts are cut into slices, and each language has so many buckets of hashes
    that the least slices of them hold several times ``size``; a language of
    fewer slices has each by itself. Equal slices are one. Of more than ``LANGUAGES`` languages those with the
    most labelled letters are taken. One aggregation with
    map-side combine; what reaches the driver is bounded by ``LANGUAGES * size``
    bytes and a slice a language.
    """
    letters = F.regexp_replace("text", r"[^\p{L}]+", " ")
    parts = docs.where("lang is not null and text is not null").select("lang", F.explode(F.regexp_extract_all(letters, F.lit(f"(?s).{{1,{slice_chars}}}"), F.lit(0))).alias("piece"))
    parts = parts.select("lang", F.trim("piece").alias("piece")).where("piece <> ''")
    stock = parts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece").cast("long")).alias("bytes"))
    known = stock.orderBy(F.desc("bytes"), "lang").limit(LANGUAGES).collect()  # one pass, a row a language
    stock = docs.sparkSession.createDataFrame(known, stock.schema)
    stock = stock.select("lang", "n", F.ceil(8 * size * F.col("n") / F.col("bytes")).alias("buckets"))
    hashed = F.xxhash64("piece")
    bucket = F.when(F.col("n") <= F.col("buckets"), hashed).otherwise(F.pmod(hashed, F.col("buckets")))
    picked = parts.join(F.broadcast(stock), "lang").select("lang", bucket.alias("bucket"), F.struct(hashed.alias("h"), "piece").alias("piece"))
    picked = picked.groupBy("lang", "bucket").agg(F.min("piece").alias("piece")).select("lang", "piece.h", "piece.piece")
    before = Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1)
    summed = picked.withColumn("before", F.coalesce(F.sum(F.octet_length("piece") + 1).over(before), F.lit(0)))
    out: dict[str, list[str]] = {}
    for lang, _, piece in sorted(map(tuple, summed.where(F.col("before") < size).select("lang", "before", "piece").collect())):
        out.setdefault(lang, []).append(piece)
    return out


class Model:
    """Automata by language; scores batches of texts."""

    def __init__(self, samples: dict[str, list[str]]):
        joined = {lang: b" ".join(map(normal, parts))[:SAMPLE_BYTES] for lang, parts in samples.items()}
        self.langs = sorted(lang for lang, text in joined.items() if text.strip())
        self.automata = [Automaton(joined[lang]) for lang in self.langs]
        self.phrase_bits = np.log2(SAMPLE_BYTES)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        clean = [normal(x) for x in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        sizes = np.array([len(x) for x in clean])
        rows = -(-sizes // ROW_BYTES)
        owner = np.repeat(np.arange(len(clean)), rows)
        laid = np.frombuffer(b"".join(x.ljust(n * ROW_BYTES, b"\0") for x, n in zip(clean, rows.tolist())), np.uint8)
        columns = np.ascontiguousarray(laid.reshape(-1, ROW_BYTES).T)
        ends = np.minimum(sizes[owner] - (np.arange(len(owner)) - (np.cumsum(rows) - rows)[owner]) * ROW_BYTES, ROW_BYTES)
        follows = np.diff(owner, prepend=-1) == 0
        bits = np.zeros((len(clean), len(self.automata)))
        for k, automaton in enumerate(self.automata):
            # every padding byte is a phrase of its own
            count = automaton.phrases(columns, follows) - (ROW_BYTES - ends)
            phrases = np.bincount(owner, count, len(clean))
            bits[:, k] = phrases * self.phrase_bits / np.maximum(1, sizes)
        best = bits.argmin(axis=1)
        share = 2.0 ** -(bits - bits.min(axis=1, keepdims=True))
        score = 1 / share.sum(axis=1)
        none = sizes == 0
        return (
            [UNDETERMINED if n else self.langs[b] for n, b in zip(none, best)],
            np.where(none, 0.0, score).tolist(),
        )


def predict(text: Column | str, model: Model, spark) -> Column:
    """Struct (lang, score) of each text; ``und`` and 0 for texts without a letter, also null ones."""
    shared = spark.sparkContext.broadcast(model)
    limit_batches(spark)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            langs, scores = model.predict(batch.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    return run(text_of(text))
