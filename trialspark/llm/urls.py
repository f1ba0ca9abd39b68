"""URL filter: rules by host and path, and boosted trees on lexical features for the rest.

Rules are a short list given as a parameter; the longest one that fits a URL
decides. URLs that a rule decides are the labelled URLs from which
gradient-boosted trees learn; the trees judge the others from their lexical
features: length, depth, digit ratio, entropy, parameter counts and suffix
statistics (how often, and how often blocked, labelled URLs have the suffix).

Features are column expressions and the trees are Spark's own, so scoring stays
in the JVM. The fit takes at most ``FIT_ROWS`` labelled URLs, those with the
least hash; suffix statistics are over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import stored, text_of

#: Bound of the fit in rows, and of the rule list.
FIT_ROWS = 10_000
MAX_RULES = 1000

#: Weight of the overall share in a suffix's share of blocked URLs.
SMOOTHING = 20.0

FEATURES = ["length", "host_length", "depth", "digits", "entropy", "params", "query_length", "labels", "dashes", "suffix_count", "suffix_blocked"]


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and a path prefix, written ``host/path``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (size, host_size, verdict, rule) of the longest rule that fits, else null.

    Of equally long ones the longer host wins, then ``block``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kind = "struct<size:int,host_size:int,verdict:string,rule:string>"
    fits = [
        F.when(
            ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path),
            F.struct(F.lit(len(rule.pattern)), F.lit(len(rule.host)), F.lit(rule.verdict), F.lit(rule.pattern)).cast(kind),
        )
        for rule in rules
    ]
    return F.array_max(F.array(F.lit(None).cast(kind), *fits))


def lexical(rows: DataFrame) -> DataFrame:
    """Lexical features of columns url, host and path, next to the columns of ``rows``."""
    url = text_of("url")
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    characters = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(
        F.transform(F.filter(characters, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b
    )
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return rows.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        count(F.rtrim(F.col("path"), F.lit("/")), "/").cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / size).alias("digits"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("params"),
        F.length(query).cast("double").alias("query_length"),
        count(F.col("host"), ".").cast("double").alias("labels"),
        count(F.col("host"), "-").cast("double").alias("dashes"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, overall: float) -> DataFrame:
    # the statistics have one row a suffix; AQE may split a suffix that most URLs share
    return rows.join(suffixes, "suffix", "left").select(
        *[c for c in rows.columns],
        F.log1p(F.coalesce("suffix_n", F.lit(0)).cast("double")).alias("suffix_count"),
        ((F.coalesce("suffix_bad", F.lit(0)) + SMOOTHING * overall) / (F.coalesce("suffix_n", F.lit(0)) + SMOOTHING)).alias("suffix_blocked"),
    )


@dataclass
class Model:
    """Boosted trees with the suffix statistics they were fitted on; None where one verdict is all there is."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    overall: float


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on lexical features and ``bad`` (0 or 1) of labelled URLs."""
    suffixes = stored(labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("suffix_n"), F.sum("bad").alias("suffix_bad")), "suffixes")
    n, bad = suffixes.agg(F.sum("suffix_n"), F.sum("suffix_bad")).first()
    overall = float(bad or 0) / float(n or 1)
    if not 0 < overall < 1:
        return Model(None, suffixes, overall)
    picked = stored(labelled.orderBy(F.xxhash64("url"), "url").limit(rows), "labelled")
    shaped = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(_with_suffixes(picked, suffixes, overall))
    trees = GBTClassifier(featuresCol="x", labelCol="bad", maxIter=10, maxDepth=4, seed=11).fit(shaped.select("x", "bad"))
    return Model(trees, suffixes, overall)


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score (chance to be blocked) of each row.

    Null and malformed URLs have empty host and path and fit no rule, so the
    trees judge them. Where the rules give no verdict, or only one, to learn
    from, the others get ``allow`` or that one. Repeated rows are judged each;
    an empty table gives an empty result.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = lexical(rows.select("*", matched(F.col("host"), F.col("path"), rules).alias("match")))
    labelled = rows.where("match is not null").select("*", (F.col("match.verdict") == "block").cast("double").alias("bad"))
    model = fit(labelled)
    rows = _with_suffixes(rows, model.suffixes, model.overall)
    if model.trees is None:
        scored = rows.select("*", F.lit(model.overall).alias("score"))
    else:
        from pyspark.ml.functions import vector_to_array

        shaped = VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(rows)
        scored = model.trees.transform(shaped).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("match.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "score")
