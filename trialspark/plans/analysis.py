"""The analysis stage: weights on the outcome table, clones, censoring, survival, effects.

All outcomes are analysed together: every window is partitioned by
``(alf, outcome_id[, arm])`` and every model is fitted per outcome.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators import emulate as M
from trialspark.operators import irls
from trialspark.operators import panel as P
from trialspark.operators import replicates as R
from trialspark.operators import survival as S
from trialspark.operators import weights as W
from trialspark.params import StudyParams

col = F.col


# columns of the outcome table the analysis reads (the rest stays in the outcome table)
ANALYSIS_COLUMNS = ["alf", "outcome_id", "cal_time", "pabx_start", "outcome"] + \
    [c for c in W.NUMERIC] + list(W.FACTORS)


def prepared(table: DataFrame, params: StudyParams, narrow: bool = True, rows: int | None = None) -> DataFrame:
    """O44 features + the at-risk indicator (D17); ``narrow`` keeps only the analysis columns.

    With the number of ``rows`` the table is dealt by patient into partitions of bounded size, which
    serve all the windows that follow.
    """
    if narrow:
        table = table.select(*ANALYSIS_COLUMNS)
    if rows is not None:
        table = P.spread(table, "alf", rows)
    return W.model_features(table, params).withColumn("at_risk", W.at_risk(params))


def denominator_terms() -> tuple[list[str], list[str]]:
    numeric = W.NUMERIC + [f"{c}_sq" for c in W.SQUARED] + W.TIME
    factors = [f"{f}_lvl" for f in W.FACTORS]
    return numeric, factors


@dataclasses.dataclass
class Design:
    """The denominator's terms for all outcomes: columns of one design matrix, and which outcome has which.

    Every level of a factor is a column; an outcome's first level is its reference and not allowed there.
    """

    outcome_ids: list[int]
    terms: list[str]
    allowed: np.ndarray  # (outcome, term)

    def index(self) -> Column:
        """Position of a row's outcome."""
        return (F.array_position(F.array(*[F.lit(i) for i in self.outcome_ids]), col("outcome_id").cast("int")) - 1).cast("int")

    def varying(self) -> dict[int, int]:
        """Columns that are powers of time."""
        return {k: W.TIME.index(t) + 1 for k, t in enumerate(self.terms) if t in W.TIME}

    def row(self, without=()) -> Column:
        """The design row; 0 for the terms ``without``."""
        cells = [F.lit(1.0)]
        for term in self.terms[1:]:
            name, eq, level = term.partition("=")
            if term in without:
                cells.append(F.lit(0.0))
                continue
            cells.append(F.when(col(name) == level, 1.0).otherwise(0.0) if eq else col(name).cast("double"))
        return F.array(*cells)


def design(prep: DataFrame, outcome_ids, terms: tuple[list[str], list[str]] | None = None) -> Design:
    """Terms from the levels that complete rows at risk have (one small job).

    ``terms`` are the numeric columns and factors of the denominator model (default: the study's).
    """
    numeric, factors = terms or denominator_terms()
    levels = W.factor_levels(prep.where((col("at_risk") == 1) & col("complete")), factors)
    ids = list(outcome_ids)
    empty = [i for i in ids if i not in levels]
    if empty:
        raise ValueError(f"no row at risk for outcomes {empty}: their weight models can't be fitted")
    known = [(f, level) for f in factors for level in sorted({x for i in ids for x in levels[i][f]})]
    allowed = [[True] * (1 + len(numeric)) + [level in levels[i][f][1:] for f, level in known] for i in ids]
    return Design(ids, ["(intercept)", *numeric, *[f"{f}={level}" for f, level in known]], np.array(allowed))


def patients_at_risk(df: DataFrame, denominator: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """The rows that the models are fitted on: a row a patient and set of covariates, with the panel rows as a list.

    The covariates hardly differ between a patient's rows, so they are kept (and read by every Newton step)
    once; rows that do differ are groups of their own. Grouped where the patient's rows are.
    """
    numeric, factors = denominator or denominator_terms()
    shared = [c for c in dict.fromkeys([*numeric, *factors]) if c not in W.TIME]
    row = F.struct(col("outcome_id").cast("int").alias("outcome_id"), col("cal_time").cast("int").alias("cal_time"), col("pabx_start").cast("int").alias("pabx_start"))
    return df.where(col("at_risk") == 1).groupBy("alf", "complete", *shared).agg(F.collect_list(row).alias("rows"))


def fit_models(df: DataFrame, outcome_ids, denominator: tuple[list[str], list[str]] | None = None,
               materialise=None) -> dict[int, tuple[W.LogitFit, W.LogitFit]]:
    """O45 + O46 for all outcomes, on the at-risk rows of the uncloned table.

    ``materialise`` stores these rows by patient: levels, counts and every Newton step read them again.

    Each Newton step of all outcomes is one aggregation over the rows. The numerator model (time,
    time^2) is fitted on starts and rows at risk per (outcome, time), which is the same binomial
    likelihood. A fit that does not settle fails the job.
    """
    patients = patients_at_risk(df, denominator)
    if materialise is not None:
        patients = materialise(patients)
    held = F.explode(F.array_distinct(col("rows.outcome_id"))).alias("outcome_id")
    terms = design(patients.select("*", held, F.lit(1).alias("at_risk")), outcome_ids, denominator)

    flat = patients.where("complete").select(terms.row(W.TIME).alias("x"), "rows")
    den = irls.newton(irls.newton_sums(flat, irls.patient_chunks(terms.outcome_ids, terms.varying())), terms.allowed[:, None])
    weeks = patients.select(F.inline("rows")).groupBy("outcome_id", "cal_time").agg(F.count(F.lit(1)).alias("n"), F.sum("pabx_start").alias("y")).collect()
    span = max(r["cal_time"] for r in weeks) + 1
    trials, starts = np.zeros((2, len(terms.outcome_ids), span, 1))
    for r in weeks:
        if r["outcome_id"] in terms.outcome_ids:
            at = terms.outcome_ids.index(r["outcome_id"]), r["cal_time"], 0
            trials[at], starts[at] = r["n"], r["y"]
    num = fit_numerator(trials, starts)
    if not (den.converged.all() and num.converged.all()):
        bad = [i for k, i in enumerate(terms.outcome_ids) if not (den.converged[k, 0] and num.converged[k, 0])]
        raise RuntimeError(f"the weight models of outcomes {bad} did not converge")

    def model(fits: irls.Fits, names: list[str], k: int) -> W.LogitFit:
        used = {n: float(b) for n, b, u in zip(names, fits.beta[k, 0], fits.used[k, 0]) if u}
        return W.LogitFit(used.pop("(intercept)"), used, int(fits.iterations[k, 0]), bool(fits.converged[k, 0]))

    return {i: (model(den, terms.terms, k), model(num, ["(intercept)", *W.TIME], k)) for k, i in enumerate(terms.outcome_ids)}


def fit_numerator(trials: np.ndarray, starts: np.ndarray) -> irls.Fits:
    """O46 on (outcome, time, replicate) counts: at most 53 times, so the driver fits it."""
    t = np.arange(trials.shape[1], dtype=float)
    time = np.stack([np.ones_like(t), t, t * t], axis=1)
    return irls.newton(irls.tally_sums(time, trials, starts), np.ones((len(trials), trials.shape[2], 3), bool))


def coefficient_table(spark, fits: dict, pick: int, prefix: str) -> tuple[DataFrame, Column]:
    """One row per outcome with the model's coefficients as columns, and the linear predictor over them.

    Joined by broadcast (one row per outcome), so the scoring expression has one term per model
    term instead of one per (outcome, term).
    """
    terms = sorted({t for pair in fits.values() for t in pair[pick].coefficients})
    rows = [(int(oid), float(pair[pick].intercept), *[float(pair[pick].coefficients.get(t, 0.0)) for t in terms])
            for oid, pair in fits.items()]
    names = [f"{prefix}{i}" for i in range(len(terms))]
    schema = ", ".join(["outcome_id int", f"{prefix}b0 double"] + [f"{n} double" for n in names])
    table = spark.createDataFrame(rows, schema)
    eta = col(f"{prefix}b0")
    for t, n in zip(terms, names):
        if "=" in t:
            factor, level = t.split("=", 1)
            x = F.when(col(factor) == level, F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            x = col(t).cast("double")
        eta = eta + col(n) * x
    return table, eta


def with_fitted(df: DataFrame, fits: dict) -> DataFrame:
    """O47 + O48 from fitted models: coefficients joined per outcome, linear predictors, probabilities."""
    spark = df.sparkSession
    den, eta_den = coefficient_table(spark, fits, 0, "_d")
    num, eta_num = coefficient_table(spark, fits, 1, "_n")
    coefs = den.join(num, "outcome_id")
    df = df.join(F.broadcast(coefs), "outcome_id", "left")
    df = df.withColumns({"_eta_den": eta_den, "_eta_num": eta_num}).drop(*[c for c in coefs.columns
                                                                          if c != "outcome_id"])
    return with_probabilities(df, F.when(col("complete"), W.logistic(col("_eta_den"))), W.logistic(col("_eta_num"))).drop("_eta_den",
                                                                                                  "_eta_num")


def with_probabilities(df: DataFrame, p_den: Column, p_num: Column) -> DataFrame:
    """O47 + O48: probabilities of the treatment received and the stabilised weight ``sw_a``."""
    df = df.withColumns({"p_den": p_den, "p_num": p_num})
    df = df.withColumns({"p_den_t": W.prob_of_received(col("p_den")), "p_num_t": W.prob_of_received(col("p_num"))})
    return df.withColumn("sw_a", W.stabilised_weight())


#: What survival, effects and bootstrap read of a clone.
CLONE_COLUMNS = ["alf", "outcome_id", "arm", "cal_time", "outcome", "sw_a"]


def weighted_clones(df: DataFrame, params: StudyParams, materialise=None, narrow: bool = False) -> DataFrame:
    """O39-O43 on the weighted table (O49: weights are computed before cloning), then O50.

    The truncation reads the clones three times (quantile sketch, band, cap);
    ``materialise`` cuts them once before that; ``narrow`` keeps only what the analysis goes on with.
    """
    clones = M.censor_clones(df, params)
    if narrow:
        clones = clones.select(*CLONE_COLUMNS)
    if materialise is not None:
        clones = materialise(clones)
    return W.truncate_weights(clones, params, "sw_a", "sw_trunc", ["outcome_id"])


def effects(clones: DataFrame) -> DataFrame:
    """O51 + O52 per outcome."""
    curve = S.weighted_km(clones, ["outcome_id", "arm"])
    return S.effect_measures(S.final_survival(curve, ["outcome_id", "arm"]), ["outcome_id"])


def effects_modelled(table: DataFrame, params: StudyParams, outcome_ids, materialise=None,
                     denominator: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Fit the weight models per outcome, weight, clone, censor, truncate, estimate."""
    prep = prepared(table, params)
    if materialise is not None:
        prep = materialise(prep)
    return effects_fitted(prep, params, outcome_ids, materialise, denominator)


def effects_fitted(prep: DataFrame, params: StudyParams, outcome_ids, materialise=None,
                   denominator: tuple[list[str], list[str]] | None = None, dealt: bool = False) -> DataFrame:
    """O45-O52 on the prepared rows; ``dealt``: they lie by patient in partitions of bounded size."""
    fits = fit_models(prep, outcome_ids, denominator, materialise)
    if materialise is not None and not dealt:
        prep = P.spread(prep, "alf", prep.count())
    return effects(weighted_clones(with_fitted(prep, fits), params, materialise, narrow=True))


def formula_probabilities() -> tuple[Column, Column]:
    """Fixed logistic formulas standing in for fitted models (used to check O47-O52 against SQL)."""
    den = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(-2.0) + F.lit(0.01) * col("ruti_age")
                                             - F.lit(0.1) * col("cal_time") + F.lit(0.3) * col("diab"))))
    num = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(-2.0) - F.lit(0.1) * col("cal_time"))))
    return den, num


def refit_patients(prep: DataFrame, params: StudyParams, terms: Design, replicates: int, seed: int, n_rows: int | None = None) -> DataFrame:
    """A row a patient for the refits: multiplicities, and per panel row what models, weights and curves need.

    ``fit`` says where the denominator model has a probability to give; ``x`` is the design row without the powers of
    time, given where it is not that of the outcome's row before (a patient's covariates hardly differ). ``keep`` counts the arms that
    hold the row (and its late rows), ``e0`` and ``e1`` are the arms' known outcomes. Rows after the last one at risk keep its
    weight: they are ``late``, without models or weights of their own. One exchange by patient serves
    the windows and the grouping.
    """
    rows = prep.where(col("outcome_id").isin(terms.outcome_ids))
    rows = rows.repartition("alf") if n_rows is None else P.spread(rows, "alf", n_rows)
    w = Window.partitionBy(*M.PATIENT)
    covariates = F.struct(*[col(c) for c in dict.fromkeys(t.partition("=")[0] for t in terms.terms[1:]) if c not in W.TIME])
    before = Window.partitionBy(*M.PATIENT).orderBy("cal_time")
    rows = rows.withColumn("_fit", F.coalesce((col("at_risk") == 1) & col("complete"), F.lit(False)))
    rows = rows.withColumn("_same", F.lag(col("_fit"), 1, False).over(before) & F.lag(covariates).over(before).eqNullSafe(covariates))
    last = F.max(F.when(col("at_risk") == 1, col("cal_time"))).over(w)
    rows = rows.withColumn("_last", last).withColumn("_late", F.coalesce(col("cal_time") > col("_last"), F.lit(False)))
    rows = rows.withColumns({"_c0": M.censor_no_treat(params), "_c1": M.censor_no_start(params)})
    held = [col(c).isNull() | (M.position() <= col(c)) for c in ("_c0", "_c1")]
    event = [F.when(col(c).isNull() | (M.position() < col(c)), col("outcome")) for c in ("_c0", "_c1")]
    rows = rows.withColumn("_keep", held[0].cast("int") + held[1].cast("int"))
    after = F.sum(F.when(col("_late"), col("_keep"))).over(w)
    keep = col("_keep") + F.when(col("cal_time") == col("_last"), F.coalesce(after, F.lit(0))).otherwise(0)
    rows = rows.withColumn("_keep_all", keep)
    late = {"o": terms.index(), "t": col("cal_time").cast("int"), "e0": event[0], "e1": event[1]}
    fields = {"o": late["o"], "t": late["t"], "y": col("pabx_start").cast("int"), "risk": col("at_risk"), "keep": col("_keep_all"),
              "e0": event[0], "e1": event[1], "fit": col("_fit"), "x": F.when(col("_fit") & ~col("_same"), terms.row(W.TIME))}
    lists = {"rows": (~col("_late"), fields), "late": (col("_late"), late)}
    return R.one_row_a_patient(rows, "alf", lists, S.multiplicities(col("alf"), replicates, seed))


def refit_effects(prep: DataFrame, params: StudyParams, outcome_ids, replicates: int = 200, seed: int = 1,
                  materialise=None) -> tuple[DataFrame, dict[int, int]]:
    """O53 (b): effect measures per (outcome, replicate), both weight models refitted in each.

    A replicate gives each patient a Poisson(1) multiplicity (seeded md5, as in the fixed-weight
    bootstrap). All replicates of all outcomes are fitted together: a Newton step is one aggregation
    of arrays over one stored row a patient, the exact truncation quantile up to five more, the curves one.
    Also returns how many replicates of an outcome did not settle (kept, as R keeps them).
    """
    terms = design(prep, outcome_ids)
    patients = refit_patients(prep, params, terms, replicates, seed, prep.count() if materialise is not None else None)
    if materialise is not None:
        patients = materialise(patients)
    models = np.repeat(terms.allowed[:, None], replicates, axis=1)
    varying = terms.varying()
    den = irls.newton(irls.newton_sums(patients, R.fit_sequences(len(terms.terms)), irls.sequence_sums(varying), R.WAVES), models)
    counts = R.tally(patients).collect()  # outcomes x intervals inside the grace period
    span = max(r["t"] for r in counts) + 1
    trials, starts = np.zeros((2, len(terms.outcome_ids), span, replicates))
    for o, t, v in map(tuple, counts):
        trials[o, t], starts[o, t] = v[:replicates], v[replicates:]
    num = fit_numerator(trials, starts)
    weights = R.Weights(den.beta, num.beta, varying)
    caps = R.weight_quantiles(patients, weights, params.weight_q)
    reps = R.replicate_effects(R.refitted_sums(patients, weights, caps, terms.outcome_ids), replicates)
    stuck = (~(den.converged & num.converged)).sum(axis=1)
    return reps, dict(zip(terms.outcome_ids, stuck.tolist()))


def bootstrap_refit(prep: DataFrame, params: StudyParams, outcome_ids, replicates: int = 200, seed: int = 1,
                    level: float = 0.95, materialise=None) -> DataFrame:
    """O53 (b): percentile intervals over :func:`refit_effects`; ``unconverged`` counts fits that did not settle."""
    reps, stuck = refit_effects(prep, params, outcome_ids, replicates, seed, materialise)
    unsettled = F.create_map(*[F.lit(x) for pair in stuck.items() for x in pair])
    return S.bootstrap_ci(reps, ["outcome_id"], level).withColumn("unconverged", unsettled[col("outcome_id")])


def bootstrap_fixed(clones: DataFrame, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """O53 (a): percentile intervals with the weights held fixed."""
    reps = R.replicate_effects(R.fixed_weight_sums(clones, replicates, seed), replicates)
    return S.bootstrap_ci(reps, ["outcome_id"], level)
