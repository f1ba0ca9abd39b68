"""Logistic fits of many models at once (O45, O46, O53): one aggregation a Newton step.

A model is an (outcome, replicate) pair. Every step reads the rows once: each task adds up, for all
models still moving, the weighted Gram matrix and the score of its rows as one array (matrix products
over Arrow batches), the arrays are summed element-wise, and the driver solves one small system per
model. What reaches the driver is models x (terms^2 / 2 + terms), whatever the number of rows.

Terms that are linear combinations of earlier ones (aliased, as R calls them) are found on the first
step's Gram matrices by elimination in term order: a term whose remaining pivot is below ``ALIAS_TOL``
of its own size is dropped and has no coefficient.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ALIAS_TOL = 1e-9
STEP_TOL = 1e-13
#: R stops at 25, where a perfectly separated fit has not settled yet; the predictor's clamp lets it settle here.
MAX_ITER = 50
#: R's ``glm`` stops when the deviance changes by less than this share.
DEVIANCE_TOL = 1e-8
#: Rows handled at a time; bounds the (row x replicate) and (row x term pair) arrays.
CHUNK = 2048

#: outcome index, label (0, 1 or a share), design matrix, weights (row x replicate) of some rows
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


#: Bound of the linear predictor, as R's ``linkinv`` has it.
MOST_ETA = 30.0


def inverse_logit(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -MOST_ETA, MOST_ETA)))


# ---------------------------------------------------------------- sums of arrays
def sum_arrays(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Element-wise sums of equally long ``array<double>`` values per key; groups hold one row a task."""
    names = [*keys, value]

    def add(table: pa.Table) -> pa.Table:
        arrays = table.column(value).combine_chunks()
        total = arrays.flatten().to_numpy().reshape(len(arrays), -1).sum(axis=0)
        return table.slice(0, 1).select(keys).append_column(value, pa.array([total], pa.list_(pa.float64())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names).groupBy(*keys).applyInArrow(add, schema)


def parallel(df: DataFrame, waves: int = 1) -> DataFrame:
    """No more partitions than ``waves`` a core: a task sends one set of sums, however many rows it read."""
    return df.coalesce(max(1, waves * df.sparkSession.sparkContext.defaultParallelism))


# ---------------------------------------------------------------- one step
def tri(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def chunk_sums(chunks: Iterator[Chunk], beta: np.ndarray, moving: np.ndarray) -> dict[int, np.ndarray]:
    """Per outcome index, rows (moving replicate) of [Gram triangle, score, deviance] at ``beta``."""
    outcomes, _, p = beta.shape
    upper = tri(p)
    sums: dict[int, np.ndarray] = {}
    for outcome, label, design, weight in chunks:
        for o in np.unique(outcome):
            reps = np.flatnonzero(moving[o])
            if not len(reps):
                continue
            mine = outcome == o
            x, y, m = design[mine], label[mine][:, None], weight[mine][:, reps]
            mu = inverse_logit(x @ beta[o, reps].T)
            spread = m * mu * (1.0 - mu)
            if len(reps) == 1:  # one model: the whole matrix is a single product
                gram = ((x * spread).T @ x)[upper][:, None]
            else:
                gram = (x[:, upper[0]] * x[:, upper[1]]).T @ spread
            score = x.T @ (m * (y - mu))
            deviance = -2.0 * (m * (y * np.log(mu) + (1.0 - y) * np.log1p(-mu))).sum(axis=0)
            part = np.vstack([gram, score, deviance[None]]).T
            sums[o] = sums[o] + part if o in sums else part
    return sums


#: Models of an outcome whose sums are one array.
TOGETHER = 25
#: Sequences worked at a time: their (sequence x replicate) arrays stay in a core's cache.
SEQUENCES = 256
#: Factors 1 + e^30 whose product is a double.
FACTORS = 20
#: Predictors whose exponentials can be multiplied with each other.
FAR = 300.0


def layers(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Blocks of sequences of consecutive rows, longest first: their numbers, and their first rows, their second rows, ...

    The sequences that have a k-th row are the first of the block, so what is held for each is read as a slice.
    """
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), SEQUENCES):
        block = order[at : at + SEQUENCES]
        many = len(block) - np.searchsorted(size[block][::-1], np.arange(size[block[0]]), side="right")
        yield block, [start[block[:n]] + k for k, n in enumerate(many.tolist())]


class Odds:
    """Odds of some sequences under all replicates: e^(covariates) once a sequence, times e^(powers of time) once a time."""

    def __init__(self, beta: np.ndarray, varying: dict[int, int], span: int):
        self.beta = beta  # (term, replicate)
        t = np.arange(span, dtype=float)
        self.by_time = sum((np.outer(t**power, beta[column]) for column, power in varying.items()), np.zeros((span, beta.shape[1])))
        self.most = np.abs(self.by_time).max(initial=0.0)
        self.factor = np.exp(np.clip(self.by_time, -FAR, FAR))

    def begin(self, design: np.ndarray) -> None:
        """``design`` has a row a sequence, 0 for the powers of time."""
        self.eta = design @ self.beta
        far = np.abs(self.eta).max(initial=0.0)
        self.clipped, self.apart = far + self.most > MOST_ETA, max(far, self.most) > FAR
        self.shared = None if self.apart else np.exp(self.eta)
        self.held = np.empty(self.eta.shape)

    def at(self, time: np.ndarray) -> np.ndarray:
        """Odds of the first sequences at their ``time``; the array is used again."""
        n = len(time)
        one = (time == time[0]).all()
        if self.apart:
            return np.exp(np.clip(self.eta[:n] + self.by_time[time], -MOST_ETA, MOST_ETA))
        odds = np.multiply(self.shared[:n], self.factor[time[0]] if one else self.factor[time], out=self.held[:n])
        return np.clip(odds, np.exp(-MOST_ETA), np.exp(MOST_ETA), out=odds) if self.clipped else odds


@dataclasses.dataclass
class Sequences:
    """Rows of some patients, in order of time inside a patient's outcome; rows of one ``run`` share their covariates."""

    outcome: np.ndarray
    label: np.ndarray
    time: np.ndarray
    run: np.ndarray
    owner: np.ndarray
    design: np.ndarray  # of each run, 0 for the powers of time
    weight: np.ndarray  # (owner, replicate)


def sequence_sums(varying: dict[int, int]) -> Callable:
    """As :func:`chunk_sums`, for rows that share covariates and weights with those before them.

    ``varying`` has the columns that are powers of time. Sums over a sequence's rows are taken first, so that the
    products with its covariates are made once a sequence, and not once a row.
    """
    columns, powers = list(varying), [varying[c] for c in varying]

    def add(chunks: Iterator[Sequences], beta: np.ndarray, moving: np.ndarray) -> dict[int, np.ndarray]:
        p = beta.shape[2]
        upper = tri(p)
        where = np.empty((p, p), np.int64)
        where[upper] = where.T[upper] = np.arange(len(upper[0]))
        fixed = np.array([c for c in range(p) if c not in varying])
        left, right = (fixed[x] for x in tri(len(fixed)))
        size, crossed = len(upper[0]) + p + 1, list(zip(*tri(len(powers))))
        sums: dict[int, np.ndarray] = {}
        for some in chunks:
            if not len(some.time):
                continue
            new = np.ones(len(some.time), bool)
            new[1:] = (np.diff(some.owner) != 0) | (np.diff(some.outcome) != 0) | (np.diff(some.run) != 0) | (np.diff(some.time) <= 0)
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(new)))
            turned = np.ascontiguousarray(some.design.T)
            pairs = np.ascontiguousarray((turned[left] * turned[right]).T)  # made once for all outcomes
            for o in np.unique(some.outcome):
                reps = np.flatnonzero(moving[o])
                mine = np.flatnonzero(some.outcome[start] == o)
                if not len(reps):
                    continue
                mine = mine[np.argsort(-length[mine], kind="stable")]
                every = some.owner[start[mine]]
                design, m_all = some.design[some.run[start[mine]]], some.weight[every] if len(reps) == beta.shape[1] else some.weight[np.ix_(every, reps)]
                mean, spread, log_sum, *moments = np.zeros((3 + len(powers), *m_all.shape))
                starts, clipped = np.zeros(len(mine)), np.zeros(len(mine), bool)
                by_time, squares = np.zeros((len(powers), len(reps))), np.zeros((len(crossed), len(reps)))
                part = np.zeros((size, len(reps)))
                odds = Odds(beta[o, reps].T, varying, int(some.time.max()) + 1)
                for block, steps in layers(start[mine], length[mine]):
                    here = slice(block[0], block[0] + len(block))  # the order is that of the lengths already
                    m = m_all[here]
                    odds.begin(design[here])
                    clipped[here] = odds.clipped
                    inverse, mu, product = np.empty((3, *m.shape))
                    product[:] = 1.0
                    for k, rows in enumerate(steps):
                        n, time, label = len(rows), some.time[rows], some.label[rows]
                        first = slice(here.start, here.start + n)
                        odd = odds.at(time)
                        q, u = inverse[:n], mu[:n]
                        np.add(odd, 1.0, out=q)
                        product[:n] *= q
                        if k % FACTORS == FACTORS - 1:
                            log_sum[here] += np.log(product)
                            product[:] = 1.0
                        np.divide(1.0, q, out=q)
                        np.multiply(odd, q, out=u)
                        mean[first] += u
                        np.multiply(u, q, out=q)  # mu (1 - mu)
                        spread[first] += q
                        one = (time == time[0]).all()
                        t = float(time[0]) if one else time[:, None].astype(float)
                        events = np.flatnonzero(label)
                        if len(events):
                            starts[first] += label
                            begun = m[events] * label[events, None]
                            if odds.clipped:
                                part[-1] += (begun * np.log(odd[events])).sum(axis=0)
                            for i, a in enumerate(powers):
                                got = time[events].astype(float) ** a @ begun
                                by_time[i] += got
                                if not odds.clipped:  # the log of the odds is the predictor, a sum over its terms
                                    part[-1] += got * odds.beta[columns[i]]
                        if one and not t:
                            continue
                        whole = [np.einsum("nr,nr->r", m[:n], x) for x in (u, q)] if one else []
                        over = lambda k, a: whole[k] * t**a if one else np.einsum("nr,nr->r", m[:n], (u, q)[k] * t**a)  # noqa: E731, B023
                        for i, a in enumerate(powers):
                            by_time[i] -= over(0, a)
                        for x, (i, j) in zip(squares, crossed):
                            x += over(1, powers[i] + powers[j])
                        for moment, a in zip(moments, powers):
                            moment[first] += np.multiply(q, t**a, out=u)
                    log_sum[here] += np.log(product, out=product)
                part[-1] -= np.einsum("nr,nr->r", m_all, log_sum)
                plain = design[:, fixed]
                begun = plain.T @ np.multiply(m_all, starts[:, None], out=log_sum)
                if clipped.any():
                    part[-1] += np.einsum("nr,nr->r", log_sum[~clipped], plain[~clipped] @ odds.beta[fixed])
                else:
                    part[-1] += (begun * odds.beta[fixed]).sum(axis=0)
                part[len(upper[0]) + fixed] = begun - plain.T @ np.multiply(m_all, mean, out=mean)
                part[len(upper[0]) + np.array(columns, int)] = by_time
                part[where[left, right]] = pairs[some.run[start[mine]]].T @ np.multiply(m_all, spread, out=spread)
                for c, x in zip(columns, moments):
                    part[where[fixed, c]] = plain.T @ np.multiply(m_all, x, out=x)
                for x, (i, j) in zip(squares, crossed):
                    part[where[columns[i], columns[j]]] = x
                part[-1] *= -2.0
                sums[o] = sums[o] + part.T if o in sums else part.T
        return sums

    return add


def newton_sums(rows: DataFrame, reader: Callable[[Iterator[pa.RecordBatch]], Iterator], add: Callable = chunk_sums, waves: int = 1) -> Callable:
    """The step's sums over ``rows`` as a function of (coefficients, moving models); ``add`` sums what ``reader`` reads."""

    def sums(beta: np.ndarray, moving: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for o, values in add(reader(batches), beta, moving).items():
                parts = [values[at : at + TOGETHER].ravel() for at in range(0, len(values), TOGETHER)]
                columns = [pa.array(np.full(len(parts), o, np.int32)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["o", "part", "v"])

        found = sum_arrays(parallel(rows, waves).mapInArrow(work, "o int, part int, v array<double>"), ["o", "part"]).toArrow()
        p = beta.shape[2]
        out = np.zeros((*moving.shape, p * (p + 1) // 2 + p + 1))
        for o, part, v in zip(found["o"].to_pylist(), found["part"].to_pylist(), found["v"]):  # a fixed number a model
            out[o, np.flatnonzero(moving[o])[part * TOGETHER : (part + 1) * TOGETHER]] = v.values.to_numpy().reshape(-1, out.shape[2])
        return out

    return sums


def flat_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Reader of rows ``(o, y, w, x)``: one model an outcome, ``w`` the row's weight."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            plain = [part.column(c).to_numpy(zero_copy_only=False) for c in ("o", "y", "w")]
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield plain[0], plain[1], x, plain[2][:, None]


def patient_chunks(outcome_ids: list[int], varying: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Chunk]]:
    """Reader of patients ``(x, rows)``: the design row that their panel rows share, and per panel row (outcome id, t, y).

    Rows of other outcomes than ``outcome_ids`` are passed over. ``varying`` has the columns of the design that are powers of the time ``t``, which ``x`` leaves empty.
    """

    def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        for batch in batches:
            lists = batch.column("rows")
            if not batch.num_rows:
                continue
            shared = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            outcome, time, label = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            parts = [(k, np.flatnonzero(outcome == i)) for k, i in enumerate(outcome_ids)]
            for k, part in [(k, rows[at : at + CHUNK]) for k, rows in parts for at in range(0, len(rows), CHUNK)]:
                design, t = shared[owner[part]], time[part].astype(float)
                for column, power in varying.items():
                    design[:, column] = t**power
                yield np.full(len(part), k), label[part].astype(float), design, np.ones((len(part), 1))

    return reader


# ---------------------------------------------------------------- the driver's part: small systems
def solve(gram: np.ndarray, score: np.ndarray, allowed: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many scaled normal equations and which terms they use, by elimination in term order."""
    n, p = score.shape
    size = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0.0))
    used = allowed & (size > 0)
    size = np.where(size > 0, size, 1.0)
    a, r = gram / (size[:, :, None] * size[:, None, :]), score / size
    for j in range(p):
        pivot = a[:, j, j].copy()
        used[:, j] &= pivot > tol
        share = np.where(used[:, j, None], a[:, :, j] / np.where(used[:, j], pivot, 1.0)[:, None], 0.0)
        share[:, j] = 0.0
        a -= share[:, :, None] * a[:, j, None, :]
        r -= share * r[:, j, None]
    pivots = np.where(used, np.diagonal(a, axis1=1, axis2=2), 1.0)
    return np.where(used, r / pivots, 0.0) / size, used


@dataclasses.dataclass
class Fits:
    """Coefficients by (outcome index, replicate, term); which terms they use; how the fits ended."""

    beta: np.ndarray
    used: np.ndarray
    converged: np.ndarray
    iterations: np.ndarray


def newton(sums: Callable[[np.ndarray, np.ndarray], np.ndarray], allowed: np.ndarray, max_iter: int = MAX_ITER) -> Fits:
    """Newton steps for all models until their deviance settles; ``allowed`` is (outcome, replicate, term).

    A step that makes a model's deviance worse is halved. A model that has not settled after
    ``max_iter`` passes keeps its last coefficients and is not ``converged``.
    """
    shape = allowed.shape[:2]
    p = allowed.shape[2]
    beta, before, step = np.zeros(allowed.shape), np.full(shape, np.inf), np.zeros(allowed.shape)
    used, moving = allowed.copy(), np.ones(shape, bool)
    converged, iterations = np.zeros(shape, bool), np.zeros(shape, np.int64)
    upper = tri(p)
    for turn in range(max_iter + 1):
        found = sums(beta, moving)[moving]
        gram = np.zeros((len(found), p, p))
        gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = found[:, : len(upper[0])]
        score, deviance = found[:, len(upper[0]) : -1], found[:, -1]
        delta, kept = solve(gram, score, used[moving], STEP_TOL if turn else ALIAS_TOL)
        if not turn:
            used[moving] = kept
        last = before[moving]
        worse = deviance > last + 1e-9 * (np.abs(last) + 0.1)
        settled = ~worse & (np.abs(deviance - last) < DEVIANCE_TOL * (np.abs(deviance) + 0.1))
        half = step[moving] / 2.0
        beta[moving] += np.where(worse[:, None], -half, delta)
        step[moving] = np.where(worse[:, None], half, delta)
        before[moving] = np.where(worse, last, deviance)
        iterations[moving] += 1
        converged[moving] = settled
        moving[moving] = ~settled
        if not moving.any():
            break
    return Fits(beta, used, converged, iterations)


def tally_sums(design: np.ndarray, trials: np.ndarray, successes: np.ndarray) -> Callable:
    """A step's sums for grouped data held as (outcome, group, replicate) arrays; ``design`` is (group, term)."""
    upper = tri(design.shape[1])

    def sums(beta: np.ndarray, moving: np.ndarray) -> np.ndarray:
        mu = inverse_logit(np.einsum("gp,obp->ogb", design, beta))
        gram = np.einsum("gk,ogb->obk", design[:, upper[0]] * design[:, upper[1]], trials * mu * (1.0 - mu))
        score = np.einsum("gp,ogb->obp", design, successes - trials * mu)
        deviance = -2.0 * (successes * np.log(mu) + (trials - successes) * np.log1p(-mu)).sum(axis=1)
        return np.concatenate([gram, score, deviance[..., None]], axis=2)

    return sums
