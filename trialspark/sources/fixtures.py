"""Bind the sixteen logical sources to the driver's synthetic tables.

The driver ships TPC-H-like tables (``orders``, ``lineitem``, ``customer``,
``supplier``). Each study source is a plain projection of them (FIXTURES.md C):
customer ``c`` is the patient, order ``k`` on date ``dt`` is a dated event. The
same expressions are written in SQL for the DuckDB oracle (``oracle/roles.py``).

Every source is a lazy DataFrame over the parquet scan; only the columns used
are read and the study window is pushed into the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions import codes
from trialspark.params import FIXTURE_PARAMS, StudyParams
from trialspark.sources.catalog import SourceCatalog

# --- fixed values of the fixture rules (FIXTURES.md C) ---
WOB_BASE = dt.date(1930, 1, 1)
# 17 baseline condition flags: flag = (c % prime == 0), primes in order
CONDITION_FLAGS = (
    ("diabetes", 3), ("cancer", 5), ("renal_disease", 7), ("hypertension", 11), ("cvd", 13),
    ("cerebrov", 17), ("heartfail", 19), ("ms", 23), ("mnd", 29), ("dementia", 31),
    ("parkinsons", 37), ("smh", 41), ("asthma", 43), ("copd", 47), ("immun_supp", 53),
    ("renal_stone", 59), ("abn_renal", 61),
)
ABX_TYPES = ("Trimethoprim", "Nitrofurantoin", "Cefalexin")  # by k % 3
DIAG_CODE_BY_PART = ("U820", "N390", "U899", "N10X")  # by l_partkey % 10, others Z000
# extra resistance columns from l_suppkey % prime
SUPPLIER_RESISTANCE = (
    ("cephalexin", 7), ("pivmecillinam", 11), ("fosfomycin", 13), ("ciprofloxacin", 17),
    ("amoxicillin_clavulanate", 19), ("gentamicin", 23),
)
EXPOSURE_PRIORITIES = ("1-URGENT", "2-HIGH")
# second registrations: day of the change (days after the window's start, modulo), overlap and gap in days
SPLIT_DAYS = 1200
REJOIN_DAYS = 30
GAP_DAYS = 200


def _res(cond: Column) -> Column:
    return F.when(cond, F.lit(codes.RESISTANT)).otherwise(F.lit("Sensitive"))


def _days(n: Column) -> Column:
    return n.cast("int")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with the patient they belong to. Nine sources are made of them, so they may be stored by patient."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("alf_pe"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines in the columns that tests, episodes and diagnoses are made of, so they may be stored by order."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_discount", "l_tax")


#: Lines that one task joins with their orders, counts or groups.
LINE_ROWS = 1 << 19


def line_partitions(lineitem: DataFrame) -> int:
    """As many partitions as the number of lines needs, one a core at least (footers tell it)."""
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // LINE_ROWS))


def by_order(lineitem: DataFrame) -> DataFrame:
    """The lines by order, in as many partitions as their number needs.

    Tests, episodes and diagnoses are grouped and joined by order where they are. Left to the size of the
    exchange, a task would take the more lines the fewer columns they have.
    """
    return lineitem.repartition(line_partitions(lineitem), "l_orderkey")


def _orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "alf_pe",
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.to_date("o_orderdate").alias("dt"),
    )


def fixture_catalog(spark: SparkSession, sf_dir: str, params: StudyParams = FIXTURE_PARAMS,
                    orders_by_patient: DataFrame | None = None, lines_by_order: DataFrame | None = None) -> SourceCatalog:
    """``orders_by_patient``: ``raw_orders`` stored in buckets by ``alf_pe``, so that the sources by patient need no exchange;
    ``lines_by_order``: ``raw_lines`` stored in buckets by ``l_orderkey``, for tests, episodes and diagnoses."""
    orders = _orders(raw_orders(spark, sf_dir) if orders_by_patient is None else orders_by_patient)
    alf = F.col("alf_pe")
    k = F.col("k")
    c = F.col("c")

    # exposure episodes: urgent / high priority orders
    expo = orders.where(F.col("priority").isin(*EXPOSURE_PRIORITIES))
    exposure_starts = expo.select(
        alf,
        F.col("dt").alias("pabx_str"),
        F.date_sub("dt", _days(k % 5)).alias("alt_str_dt"),
        # one type a patient and day, as the study requires
        F.element_at(F.array(*[F.lit(t) for t in ABX_TYPES]), _days((c + F.unix_date("dt")) % 3) + 1).alias("alt_abx_type"),
    )
    exposure_ends = expo.select(
        alf, F.col("dt").alias("pabx_str"), F.date_add("dt", _days(k % 120 + 30)).alias("alt_end_dt_comb"))

    # cohort 1: first order inside the study window is the index date
    first = (orders.where(F.col("dt").between(params.study_start, params.study_end))
             .groupBy("alf_pe", "c").agg(F.min("dt").alias("diag_date")))
    first_expo = (first.join(expo.select("alf_pe", F.col("dt").alias("pabx_str")), "alf_pe")
                  .where((F.col("pabx_str") >= F.col("diag_date"))
                         & (F.col("pabx_str") < F.add_months("diag_date", params.followup_months)))
                  .groupBy("alf_pe").agg(F.min("pabx_str").alias("pabx_after_ruti")))
    wob = F.date_add(F.lit(WOB_BASE), _days(c * 7919 % 22000))
    cohort = first.join(first_expo, "alf_pe", "left").select(
        alf,
        "diag_date",
        wob.alias("wob"),
        F.floor(F.datediff("diag_date", wob) / 365.25).cast("int").alias("agediag"),
        F.when(c % 11 != 0, F.date_add("diag_date", _days(c * 17 % 2000))).alias("gp_end_date"),
        F.when(c % 29 != 0, (c % 5 + 1).cast("int")).alias("wimd_2019_quintile"),
        F.when(c % 4 != 0, (c % 6 + 1).cast("int")).alias("ethnic"),
        (c % 20 + 18).cast("int").alias("bmi_val"),
        (c % 3).cast("int").alias("smok"),
        F.element_at(F.array(F.lit("Never"), F.lit("Ex"), F.lit("Current")), _days(c % 3) + 1)
        .alias("smoking_status_description"),
        (c % 2).cast("int").alias("alcohol_flg"),
        F.when(c % 2 == 1, "Yes").otherwise("No").alias("alcohol"),
        (c % 4 + 1).cast("int").alias("efi"),
        *[F.when(c % p == 0, 1).otherwise(0).alias(name) for name, p in CONDITION_FLAGS],
        F.when(c % 13 == 0, 1).otherwise(0).alias("pabx"),
        "pabx_after_ruti",
    )
    deaths = first.where(c % 5 == 0).select(
        alf, F.date_add("diag_date", _days(c * 31 % 700)).alias("death_dt"))

    # prescriptions: every exposure order, a second category for k % 5 == 0
    presc_base = expo.select(
        alf, k, F.col("dt").alias("event_dt"), (k % 3 + 1).cast("int").alias("event_in_grp"),
        F.when(k % 2 == 0, "Prophylactic").otherwise("Treatment").alias("dose"),
        F.when(k % 7 == 0, "Inconsistent").otherwise("Consistent").alias("dose_consistency"))
    category = lambda n: ((k + n) % 4).cast("string")
    prescriptions = presc_base.withColumn(
        "antibx_category", F.explode(F.when(k % 5 == 0, F.array(category(0), category(1))).otherwise(F.array(category(0))))).drop("k")

    gp_events = orders.select(
        alf, F.col("dt").alias("event_dt"),
        F.when(k % 3 == 0, F.lower(F.substring("priority", 3, 100))).otherwise(F.col("priority")).alias("event_cd"))

    gp_uti = orders.where(F.col("status") == "O").select(
        alf, F.col("dt").alias("event_str_dt"), F.col("dt").alias("event_end_dt"), F.lit(codes.GP_SOURCE).alias("data_source"))
    hosp_uti = orders.where(F.col("status") == "P").select(
        alf, F.col("dt").alias("event_str_dt"), F.date_add("dt", _days(k % 10)).alias("event_end_dt"),
        F.lit(codes.HOSPITAL_SOURCE).alias("data_source"))
    all_uti = gp_uti.select("alf_pe", "event_str_dt").unionByName(hosp_uti.select("alf_pe", "event_str_dt"))

    spell = orders.select(
        alf, F.lit(1).alias("alf_sts_cd"), (k % 7).cast("string").alias("prov_unit_cd"),
        k.alias("spell_num_pe"), F.lit(2).alias("gndr_cd"), F.col("dt").alias("admis_dt"),
        F.date_add("dt", _days(k % 12)).alias("disch_dt"), (k % 12).cast("int").alias("spell_dur"))

    lineitem = by_order(raw_lines(spark, sf_dir)) if lines_by_order is None else lines_by_order
    line_keys = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("epi_num")).distinct()
    # an order is met by its lines unsorted: the smaller side is hashed, a partition at a time
    episode = (line_keys.join(orders.select("k", "dt").hint("shuffle_hash"), "k")
               .select((k % 7).cast("string").alias("prov_unit_cd"), k.alias("spell_num_pe"), "epi_num",
                       F.date_add("dt", F.col("epi_num") - 1).alias("epi_str_dt"),
                       F.date_add("dt", F.greatest(F.col("epi_num") - 1, _days(k % 12))).alias("epi_end_dt"))
               .withColumn("epi_dur", F.datediff("epi_end_dt", "epi_str_dt")))
    part_mod = (F.col("l_partkey") % 10).cast("int")
    diagnosis = (lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("epi_num"),
                                 part_mod.alias("pm")).distinct()
                 .select((k % 7).cast("string").alias("prov_unit_cd"), k.alias("spell_num_pe"), "epi_num",
                         F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in DIAG_CODE_BY_PART]),
                                                     F.col("pm") + 1),
                                    F.lit("Z000")).alias("diag_cd_1234")))

    sk = F.col("l_suppkey")
    urine_tests = (lineitem.join(orders.select(F.col("k").alias("l_orderkey"), "c").hint("shuffle_hash"), "l_orderkey")
                   .select(
                       F.col("c").cast("string").alias("alf_pe"), F.to_date("l_shipdate").alias("spcm_collected_dt"),
                       F.col("l_orderkey").alias("report_seq"), F.col("l_linenumber").alias("request_seq"),
                       _res(F.col("l_returnflag") == "R").alias("trimethoprim"),
                       _res((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("nitrofurantoin"),
                       _res(F.col("l_discount") >= 0.08).alias("amoxicillin"),
                       _res(F.col("l_tax") >= 0.07).alias("coamoxiclav"),
                       *[_res(sk % p == 0).alias(name) for name, p in SUPPLIER_RESISTANCE],
                       F.element_at(F.array(*[F.lit(x) for x in codes.UTI_OUTCOME_RANK]),
                                    (F.col("l_partkey") % 6).cast("int") + 1).alias("uti_outcome")))

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # one registration; or two: the same practice from REJOIN days before the first one ends (c % 8 = 0),
    # or another practice after a gap of GAP days (c % 8 = 4)
    r = F.col("c_custkey")
    split = F.date_add(F.lit(params.study_start), _days(r * 13 % SPLIT_DAYS))
    stay = F.struct(F.col("c_nationkey").alias("p"), F.lit(params.study_start).alias("s"),
                    F.when(r % 4 == 0, split).otherwise(F.lit(params.study_end)).alias("e"))
    later = F.struct(F.when(r % 8 == 0, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 1) % 25).cast("int").alias("p"),
                     F.date_add(split, F.when(r % 8 == 0, -REJOIN_DAYS).otherwise(GAP_DAYS)).alias("s"), F.lit(params.study_end).alias("e"))
    both = F.when(r % 4 == 0, F.array(stay, later)).otherwise(F.array(stay))
    registration = customer.select("c_custkey", F.inline(both)).select(
        F.col("c_custkey").cast("string").alias("alf_pe"), F.col("p").cast("string").alias("prac_cd_pe"),
        F.col("s").alias("start_date"), F.col("e").alias("end_date"))
    ethnicity = customer.where(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").cast("string").alias("alf_pe"),
        (F.col("c_nationkey") % 6 + 1).cast("int").alias("ethn_ec_ons_date_latest_code"))
    practice_rate = (spark.read.parquet(f"{sf_dir}/supplier.parquet")
                     .groupBy(F.col("s_nationkey").cast("string").alias("prac_cd_pe"))
                     .agg(F.round(F.avg("s_acctbal") / 1000, 3).alias("abx_presc_rt")))

    return SourceCatalog(
        cohort=cohort, deaths=deaths, exposure_ends=exposure_ends, exposure_starts=exposure_starts,
        prescriptions=prescriptions, gp_events=gp_events, ethnicity=ethnicity, registration=registration,
        practice_rate=practice_rate, urine_tests=urine_tests, gp_uti=gp_uti, hosp_uti=hosp_uti, all_uti=all_uti,
        spell=spell, episode=episode, diagnosis=diagnosis,
    ).validate()
