"""Bootstrap replicates from one array of multiplicities a patient.

A patient is one row: ``mults``, the Poisson(1) multiplicities of all replicates, and the patient's
panel rows as a list (at most intervals x outcomes of them). Rows are read once for all replicates: a
task adds them up per outcome, arm and time into arrays as long as the replicates, by matrix products where a
row's weight is the same in all of them. Refitted weights are (row x replicate) arrays, a chunk at a time; they
change while a patient is at risk only, so the later rows are a list of their own and share one weight.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators import irls
from trialspark.operators import survival as S
from trialspark.operators import weights as W

col = F.col

#: Bits of a weight settled per pass of the exact quantile, highest first (63 bits of a positive double).
DIGITS = (12, 8, 11, 16, 16)
#: Rows under the searched prefixes that are counted by all their remaining bits at once.
FEW = 1 << 22
#: New codes that are counted by themselves before they are merged.
MERGED = 1 << 20
#: Panel rows whose patients are sorted by length together, and tasks a core for passes that take long.
SEQUENCE_ROWS = 1 << 16
WAVES = 3
#: Panel rows whose sums are one matrix product.
PRODUCT_ROWS = 1 << 15


def one_row_a_patient(df: DataFrame, key: str, lists: dict[str, tuple[Column, dict[str, Column]]], mults: Column) -> DataFrame:
    """``mults`` and lists of rows per patient, each in the order of its fields. One exchange by ``key``.

    ``lists`` says for each list which rows it takes, and their fields.
    """
    rows = {name: F.when(which, F.struct(*[c.alias(n) for n, c in fields.items()])) for name, (which, fields) in lists.items()}
    return df.groupBy(key).agg(*[F.sort_array(F.collect_list(row)).alias(n) for n, row in rows.items()]).select(mults.alias("mults"), *rows)


def whole_patients(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive patients with at most ``most`` rows together, one patient at least."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(at, i)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))


@dataclasses.dataclass
class Chunk:
    """Some whole patients: panel rows, the patient (from 0) of each, the patients' multiplicities, and the late rows."""

    rows: pa.StructArray
    owner: np.ndarray
    mults: np.ndarray  # (patient, replicate)
    late: pa.StructArray | None
    late_owner: np.ndarray

    def times(self) -> np.ndarray:
        """Multiplicities of each row (row x replicate)."""
        return self.mults[self.owner]


def chunks(batches: Iterator[pa.RecordBatch], most: int = irls.CHUNK) -> Iterator[Chunk]:
    """Whole patients with about ``most`` panel rows together."""
    for batch in batches:
        rows = batch.column("rows")
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        mults = batch.column("mults").flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        late = batch.column("late") if "late" in batch.schema.names else None
        late_sizes = late.value_lengths().to_numpy(zero_copy_only=False) if late is not None else np.zeros_like(sizes)
        flat, starts = rows.flatten(), np.concatenate([[0], np.cumsum(sizes)])
        flat_late, late_starts = None if late is None else late.flatten(), np.concatenate([[0], np.cumsum(late_sizes)])
        for some in whole_patients(sizes, most):
            owner, late_owner = (np.repeat(np.arange(some.stop - some.start), n[some]) for n in (sizes, late_sizes))
            if len(owner):
                mine = None if late is None else flat_late.slice(late_starts[some.start], len(late_owner))
                yield Chunk(flat.slice(starts[some.start], len(owner)), owner, mults[some].astype(float), mine, late_owner)


def patient_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray]]:
    """Panel rows of some whole patients, the patient each belongs to, and weights (row x replicate)."""
    for some in chunks(batches):
        yield some.rows, some.owner, some.times()


def numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    """A field as doubles, null as NaN (also where the field's list or row is sliced)."""
    return pc.cast(pc.struct_field(rows, name), pa.float64()).to_numpy(zero_copy_only=False)


def summed(patients: DataFrame, keys: dict[str, str], work: Callable) -> DataFrame:
    """Arrays that tasks emit per key, summed element-wise: ``(keys..., v)``."""
    schema = ", ".join([*[f"{k} {t}" for k, t in keys.items()], "v array<double>"])
    return irls.sum_arrays(irls.parallel(patients).mapInArrow(work, schema), list(keys))


def add_up(groups: np.ndarray, values: np.ndarray, totals: dict) -> None:
    """Adds rows of ``values`` to the totals of their group (a row of ``groups`` each)."""
    kinds, code = np.unique(groups, axis=0, return_inverse=True)
    order = np.argsort(code.ravel(), kind="stable")
    starts = np.searchsorted(code.ravel()[order], np.arange(len(kinds)))
    for kind, part in zip(map(tuple, kinds.tolist()), np.add.reduceat(values[order], starts, axis=0)):
        totals[kind] = totals[kind] + part if kind in totals else part


def step_codes(*keys: np.ndarray) -> np.ndarray:
    """(outcome, arm, time) or (outcome, time) of rows as one number each."""
    outcome, *arm, time = keys
    return (outcome << 21) + ((arm[0] << 20) if arm else 0) + time


def add_products(code: np.ndarray, owner: np.ndarray, values: list[np.ndarray], times: np.ndarray, totals: dict, names: Callable) -> None:
    """Adds each value times its owner's ``times`` (owner x replicate) to the totals of the rows' codes.

    One matrix product a value, (code x owner) by (owner x replicate): no row is repeated per replicate.
    """
    kinds, place = np.unique(code, return_inverse=True)
    cell, shape = owner * len(kinds) + place, (len(times), len(kinds))
    parts = np.hstack([np.bincount(cell, v, shape[0] * shape[1]).reshape(shape).T @ times for v in values])
    for kind, part in zip(map(names, kinds.tolist()), parts):
        totals[kind] = totals[kind] + part if kind in totals else part


def step_names(code: int) -> tuple[int, int, int]:
    return code >> 21, code >> 20 & 1, code & ((1 << 20) - 1)


def emitted(totals: dict, keys: dict[str, str]) -> Iterator[pa.RecordBatch]:
    if totals:
        kinds = {"int": pa.int32(), "bigint": pa.int64()}
        columns = [pa.array([k[i] for k in totals], kinds[t]) for i, t in enumerate(keys.values())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(totals.values()), pa.list_(pa.float64()))], names=[*keys, "v"])


# ---------------------------------------------------------------- survival of all replicates
STEP_KEYS = {"outcome_id": "int", "arm": "int", "cal_time": "int"}


def replicate_steps(sums: DataFrame, replicates: int) -> DataFrame:
    """Risk sets and events per (outcome, arm, replicate, time) from arrays [risk..., events...]."""
    out = sums.select(*STEP_KEYS, F.posexplode(F.arrays_zip(F.slice("v", 1, replicates).alias("n_risk"),
                                                            F.slice("v", replicates + 1, replicates).alias("n_event"))).alias("rep", "z"))
    return out.select(*STEP_KEYS, (col("rep") + 1).alias("rep"), "z.n_risk", "z.n_event").where(col("n_risk") > 0)


def replicate_effects(sums: DataFrame, replicates: int) -> DataFrame:
    """Effect measures per (outcome, replicate)."""
    group = ["outcome_id", "arm", "rep"]
    curve = S.product_limit(replicate_steps(sums, replicates), group)
    return S.effect_measures(S.final_survival(curve, group), ["outcome_id", "rep"])


def fixed_weight_sums(clones: DataFrame, replicates: int, seed: int, weight: str = "sw_trunc") -> DataFrame:
    """O53 (a): arrays [risk per replicate, events per replicate] by outcome, arm and time."""
    known = clones.where(col("outcome").isNotNull() & col(weight).isNotNull())
    fields = {"outcome_id": col("outcome_id").cast("int"), "arm": col("arm").cast("int"), "cal_time": col("cal_time").cast("int"),
              "w": col(weight).cast("double"), "e": col("outcome").cast("double")}
    patients = one_row_a_patient(known, "alf", {"rows": (F.lit(True), fields)}, S.multiplicities(col("alf"), replicates, seed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for some in chunks(batches, PRODUCT_ROWS):
            code = step_codes(*[numbers(some.rows, k).astype(np.int64) for k in STEP_KEYS])
            w = numbers(some.rows, "w")
            add_products(code, some.owner, [w, w * numbers(some.rows, "e")], some.mults, totals, step_names)
        yield from emitted(totals, STEP_KEYS)

    return summed(patients, STEP_KEYS, work)


# ---------------------------------------------------------------- refitted weights
def time_columns() -> dict[int, int]:
    """Columns of the study's design that are powers of time."""
    terms = ["(intercept)", *W.NUMERIC, *[f"{c}_sq" for c in W.SQUARED], *W.TIME]
    return {terms.index(t): k for k, t in enumerate(W.TIME, 1)}


class Weights:
    """Stabilised weights of panel rows under every replicate's models (as ``weights.stabilised_weight``)."""

    def __init__(self, den: np.ndarray, num: np.ndarray, varying: dict[int, int] | None = None):
        self.den, self.num = den, num  # (outcome, replicate, term); the numerator's terms are 1, t, t^2
        self.varying = time_columns() if varying is None else varying

    def blocks(self, rows: pa.StructArray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """Patients of one outcome at a time: outcome index, the patients, and by their first rows, second rows, ... (rows, weights).

        Every row comes once, for the first of the block's patients; the weights (row x replicate) are NaN from a
        missing probability on, and their array is used again by the next step.
        """
        outcome, time = numbers(rows, "o").astype(np.int64), numbers(rows, "t").astype(np.int64)
        facts = numbers(rows, "y") == 1, numbers(rows, "risk") == 1, *design_of(rows, self.den.shape[2])
        first = np.ones(len(outcome), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (outcome[1:] != outcome[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(outcome)))
        span = int(time.max(initial=0)) + 1
        t = np.arange(span, dtype=float)
        for o in np.unique(outcome).tolist():
            mine = np.flatnonzero(outcome[start] == o)
            odds = irls.Odds(self.den[o].T, self.varying, span)
            begun = irls.inverse_logit(np.stack([np.ones_like(t), t, t * t], axis=1) @ self.num[o].T)
            for block, steps in irls.layers(start[mine], size[mine]):
                yield o, owner[start[mine[block]]], self.running(steps, time, facts, odds, begun)

    def running(self, steps: list[np.ndarray], time: np.ndarray, facts: tuple, odds: irls.Odds, begun: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Running products of numerator over denominator, in time order inside a patient's outcome."""
        treated, risk, fit, run, design = facts
        waits = 1.0 - begun
        sw, held = np.ones((len(steps[0]), begun.shape[1])), None
        for rows in steps:
            n = len(rows)
            at_risk, has = risk[rows], fit[rows]
            if at_risk.any():
                when = time[rows]
                same = (when == when[0]).all()
                wanted = run[rows]
                if held is None or (wanted[has] != held[:n][has]).any():  # the covariates' part is made once a patient
                    held = wanted
                    odds.begin(design[np.maximum(wanted, 0)] if len(design) else np.zeros((n, odds.beta.shape[0])))
                odd = odds.at(when)
                starts = np.flatnonzero(treated[rows])
                begins = (1.0 / odd[starts] + 1.0) * begun[when[starts]]
                odd += 1.0
                odd *= waits[when[0]] if same else waits[when]
                odd[starts] = begins
                if not (at_risk & has).all():
                    odd[at_risk & ~has] = np.nan
                    odd[~at_risk] = 1.0
                sw[:n] *= odd
            yield rows, sw[:n]

    def of(self, rows: pa.StructArray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outcome index and time of each row, and weights (row x replicate)."""
        found = np.empty((len(owner), self.den.shape[1]))
        for _, _, steps in self.blocks(rows, owner):
            for at, sw in steps:
                found[at] = sw
        return numbers(rows, "o").astype(np.int64), numbers(rows, "t").astype(np.int64), found


def design_of(rows: pa.StructArray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have covariates (at risk and complete), the number of each one's, and the covariates.

    ``x`` is given where it is not that of the row before.
    """
    x = pc.struct_field(rows, "x")
    fit = pc.struct_field(rows, "fit").to_numpy(zero_copy_only=False).astype(bool)
    run = np.cumsum(x.is_valid().to_numpy(zero_copy_only=False)) - 1
    return fit, run, x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, terms)


def fit_sequences(terms: int) -> Callable:
    """Reader of the denominator's rows for :func:`irls.sequence_sums`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[irls.Sequences]:
        for some in chunks(batches, SEQUENCE_ROWS):
            fit, run, design = design_of(some.rows, terms)
            if fit.any():
                outcome, label, time = (numbers(some.rows, c)[fit] for c in ("o", "y", "t"))
                yield irls.Sequences(outcome.astype(np.int64), label, time.astype(np.int64), run[fit], some.owner[fit], design, some.mults)

    return read


TALLY_KEYS = {"o": "int", "t": "int"}


def tally(patients: DataFrame) -> DataFrame:
    """Per (outcome index, time): at-risk rows and starts of every replicate, [n..., starts...]."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for some in chunks(batches, PRODUCT_ROWS):
            risk = numbers(some.rows, "risk") == 1
            if risk.any():
                code = step_codes(*[numbers(some.rows, k)[risk].astype(np.int64) for k in TALLY_KEYS])
                add_products(code, some.owner[risk], [np.ones(risk.sum()), numbers(some.rows, "y")[risk]], some.mults, totals,
                             lambda c: (c >> 21, c & ((1 << 20) - 1)))
        yield from emitted(totals, TALLY_KEYS)

    return summed(patients, TALLY_KEYS, work)


def last_rows(some: Chunk) -> np.ndarray:
    """For each late row the position of its patient's and outcome's last panel row, whose weight it keeps."""
    code = some.owner * (1 << 32) + numbers(some.rows, "o").astype(np.int64)
    return np.searchsorted(code, some.late_owner * (1 << 32) + numbers(some.late, "o").astype(np.int64), side="right") - 1


class Counts:
    """Counts by code, merged whenever as many new ones have come as are held."""

    def __init__(self):
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.new.append((code, n))
        self.waiting += len(code)
        if self.waiting > max(MERGED, len(self.code)):
            self.merge()

    def merge(self) -> None:
        code, n = (np.concatenate(x) for x in zip((self.code, self.n), *self.new))
        self.code, place = np.unique(code, return_inverse=True)
        self.n = np.bincount(place, n, len(self.code))
        self.new, self.waiting = [], 0


def digit_counts(patients: DataFrame, weights: Weights, prefixes: np.ndarray, shift: int, width: int) -> DataFrame:
    """How often each next digit occurs among cloned rows' weights that begin with a searched prefix.

    ``prefixes`` is (rank, outcome, replicate): ``(rank, o, b, digit, n)``, counted by multiplicity; a prefix that an
    earlier rank searches too is counted there. Late rows have the weight of their outcome's last panel row, whose ``keep`` counts them.
    """
    ranks, outcomes, reps = prefixes.shape
    first = shift + width >= sum(DIGITS)  # nothing is known yet: all weights are counted
    bound = (prefixes[0] << (shift + width)).view(np.float64)  # no weight below it is searched, as the ranks ascend
    searched = [k == 0 or prefixes[k] != prefixes[k - 1] for k in range(ranks)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Counts(), {}
        for some in chunks(batches, SEQUENCE_ROWS):
            keep = numbers(some.rows, "keep")
            for o, who, steps in weights.blocks(some.rows, some.owner):
                mults = some.mults[who]
                for rows, sw in steps:
                    if first:
                        known = ~np.isnan(sw.sum(axis=1))
                        whole = known.all()
                        digit = (sw if whole else sw[known]).view(np.int64) >> shift
                        count = (mults[: len(rows)] if whole else mults[: len(rows)][known]) * keep[rows if whole else rows[known], None]
                        if len(digit):
                            low, high = int(digit.min()), int(digit.max()) + 1
                            begin, total = held.get(o, (low, np.zeros((reps, 0))))
                            if low < begin or high > begin + total.shape[1]:
                                total = np.pad(total, ((0, 0), (max(0, begin - low), max(0, high - begin - total.shape[1]))))
                                begin = min(begin, low)
                                held[o] = begin, total
                            digit += np.arange(reps) * (high - low) - low
                            total[:, low - begin : high - begin] += np.bincount(digit.ravel(), count.ravel(), reps * (high - low)).reshape(reps, -1)
                        continue
                    row, rep = np.divmod(np.flatnonzero(sw >= bound[o]), reps)
                    count = mults[row, rep] * keep[rows[row]]
                    row, rep, count = row[count > 0], rep[count > 0], count[count > 0]
                    bits = sw[row, rep].view(np.int64)
                    for k in range(ranks):
                        hit = bits >> (shift + width) == prefixes[k, o, rep]
                        if k:
                            hit &= searched[k][o, rep]
                        if hit.any():
                            digit = (bits[hit] >> shift) & ((1 << width) - 1)
                            found.add((((k * outcomes + o) * reps + rep[hit]) << width) + digit, count[hit])
        for o, (begin, total) in held.items():
            rep, digit = np.nonzero(total)
            found.add(((o * reps + rep) << width) + digit + begin, total[rep, digit])
        if found.waiting:
            found.merge()
        if len(found.code):
            group = found.code >> width
            columns = [(group // (outcomes * reps)).astype(np.int32), (group // reps % outcomes).astype(np.int32),
                       (group % reps).astype(np.int32), found.code & ((1 << width) - 1), found.n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rank", "o", "b", "digit", "n"])

    counts = irls.parallel(patients, WAVES).mapInArrow(work, "rank int, o int, b int, digit bigint, n double")
    return counts.groupBy("rank", "o", "b", "digit").agg(F.sum("n").alias("n"))


def weight_quantiles(patients: DataFrame, weights: Weights, q: float) -> np.ndarray:
    """Exact type-7 quantile of the cloned rows' weights per (outcome, replicate), NaN where there is none.

    The two order statistics are found digit by digit on the weights' bits: a pass counts the next digit's
    values below the prefix found so far, and the digit in which the rank falls is appended. Five passes give
    the exact doubles whatever their distribution; where no more than ``FEW`` rows are left under the prefixes,
    one pass takes all the remaining bits. The driver gets one row per rank and model.
    """
    outcomes, reps = weights.den.shape[:2]
    spark = patients.sparkSession
    prefix = np.zeros((1, outcomes, reps), np.int64)  # nothing is known of the first digit, for either rank
    total, shift = None, sum(DIGITS)
    rest = np.zeros((2, outcomes, reps))
    left = np.inf  # rows under the prefixes
    digits = list(DIGITS)
    widest = 63 - (2 * outcomes * reps).bit_length()  # a rank's model and its digit are one integer
    while digits:
        width = digits.pop(0)
        if left <= FEW and shift <= widest:
            width, digits = shift, []
        shift -= width
        counts = digit_counts(patients, weights, prefix, shift, width)
        w = Window.partitionBy("rank", "o", "b").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(w)).withColumnRenamed("rank", "counted")
        if total is None:
            counts = counts.persist()
            total = np.zeros((outcomes, reps))
            for o, b, n in map(tuple, counts.groupBy("o", "b").agg(F.sum("n")).collect()):
                total[o, b] = n
            h = (total - 1.0) * q
            rest = np.stack([np.floor(h), np.ceil(h)])  # rank inside the prefix, from 0
            first = counts
        own = np.broadcast_to(prefix, rest.shape)
        wanted = spark.createDataFrame([(int(k), int(k and own[k, o, b] != own[0, o, b]), int(o), int(b), float(rest[k, o, b])) for k, o, b in np.ndindex(rest.shape)
                                        if total[o, b] > 0], "rank int, counted int, o int, b int, r double")
        # two rows a model: a fixed number
        picked = counts.join(F.broadcast(wanted), ["counted", "o", "b"]).where((col("upto") > col("r")) & (col("upto") - col("n") <= col("r")))
        nxt = np.left_shift(own, width)
        left = 0.0
        for k, o, b, digit, below, n in picked.select("rank", "o", "b", "digit", col("upto") - col("n"), "n").collect():
            nxt[k, o, b] += digit
            rest[k, o, b] -= below
            left += n
        if len(prefix) == 1:
            first.unpersist()
        prefix = nxt
    low, high = prefix[0].view(np.float64), prefix[1].view(np.float64)
    part = h - np.floor(h)
    with np.errstate(invalid="ignore"):
        found = np.where(low == high, low, low + part * (high - low))
    return np.where(total > 0, found, np.nan)


def refitted_sums(patients: DataFrame, weights: Weights, caps: np.ndarray, outcome_ids: list[int]) -> DataFrame:
    """Arrays [risk per replicate, events per replicate] by outcome, arm and time, with capped weights."""
    ids, cap = np.array(outcome_ids), np.where(np.isnan(caps), np.inf, caps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for some in chunks(batches, SEQUENCE_ROWS):
            time, outcome = numbers(some.rows, "t").astype(np.int64), numbers(some.rows, "o").astype(np.int64)
            events = [numbers(some.rows, f"e{arm}") for arm in (0, 1)]
            shares = np.stack([x for e in events for x in (~np.isnan(e), np.nan_to_num(e))]).astype(float)  # what of a row's risk counts where
            last = last_rows(some)
            held = np.unique(last)
            place = np.full(len(time), -1)
            place[held] = np.arange(len(held))
            late_risk = np.full((len(held), weights.den.shape[1]), np.nan)  # NaN: a weight is missing
            for o, who, steps in weights.blocks(some.rows, some.owner):
                mults = some.mults[who]
                for rows, sw in steps:
                    risk = np.minimum(sw, cap[o])
                    risk *= mults[: len(rows)]
                    ends = place[rows]
                    known = ~np.isnan(risk.sum(axis=1))
                    if (ends >= 0).any():
                        late_risk[ends[(ends >= 0) & known]] = risk[(ends >= 0) & known]
                    when = time[rows]
                    for t in np.unique(when).tolist():
                        mine = known & (when == t)
                        if not mine.any():
                            continue
                        whole = mine.all()
                        share = shares[:, rows if whole else rows[mine]]
                        parts = share @ (risk if whole else risk[mine])
                        for arm in (0, 1):
                            if share[2 * arm].any():
                                key, part = (int(ids[o]), arm, t), parts[2 * arm : 2 * arm + 2].ravel()
                                totals[key] = totals[key] + part if key in totals else part
            there = ~np.isnan(late_risk.sum(axis=1))[place[last]] if len(held) else np.zeros(0, bool)
            for arm in (0, 1):
                event = numbers(some.late, f"e{arm}")
                known = ~np.isnan(event) & there
                if known.any():
                    code = step_codes(ids[outcome[last[known]]], np.full(known.sum(), arm), numbers(some.late, "t").astype(np.int64)[known])
                    add_products(code, place[last[known]], [np.ones(known.sum()), event[known]], np.nan_to_num(late_risk), totals, step_names)
        yield from emitted(totals, STEP_KEYS)

    return irls.sum_arrays(irls.parallel(patients, WAVES).mapInArrow(work, ", ".join([*[f"{k} {t}" for k, t in STEP_KEYS.items()], "v array<double>"])), list(STEP_KEYS))


__all__ = ["one_row_a_patient", "fixed_weight_sums", "replicate_effects", "Weights", "tally", "weight_quantiles", "refitted_sums"]
