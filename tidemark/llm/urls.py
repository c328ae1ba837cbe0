"""URL filters: rules first, and gradient-boosted trees on lexical features for the rest. DataFrame functions only.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest rule wins. URLs
that a rule judges are the labelled ones, from which the trees learn; they judge what no rule fits by its shape: lengths,
depth, share of digits, entropy, number of parameters, host labels and hyphens, and how often URLs with the same host
suffix are blocked.

Trees are fitted on at most about ``TRAIN_ROWS`` labelled URLs, half of them of each verdict, chosen by a hash and weighted by what they
stand for. Suffix statistics are a table of all suffixes of labelled URLs, joined to the URLs.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; without labelled URLs of both kinds
the method's verdict is that of the only kind, or ``allow``; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.sampling import per_class
from tidemark.operators.joins import skew_join
from tidemark.sources.tables import pin, table

# The rules, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Bounds of the fit.
TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 4

_FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_share", "entropy",
             "parameters", "has_fragment", "suffix_rate", "suffix_share")


@dataclass(frozen=True)
class UrlModel:
    trees: Model | None           # none where only one verdict was seen
    only: str
    rate: float                   # of blocked URLs among the labelled
    suffixes: DataFrame | None    # (suffix, suffix_rate, suffix_share): smoothed block rate and share of the labelled


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the next ``/``, ``?``, ``#`` or end, in lower case; and the path behind it."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of columns host and path; both null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled) of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(rules)
    return rows.withColumns({"rule": rule, "ruled": verdict}).withColumn("suffix", F.substring_index("host", ".", -2))


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))).cast("double")


def with_features(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Lexical features of parsed URLs, one column each."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    question = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    # Each distinct character's share p adds -p log2 p.
    entropy = F.aggregate(letters, F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(
        (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length
        * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length)))
    return skew_join(rows, model.suffixes, "suffix", "left").withColumns({
        "length": length, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "query_length": F.length(question).cast("double"), "depth": _count(F.col("path"), "/"), "labels": _count(F.col("host"), "."),
        "hyphens": _count(F.col("host"), "-"), "digit_share": F.length(F.regexp_replace(url, "[^0-9]", "")) / length,
        "entropy": entropy, "parameters": F.when(question == "", 0.0).otherwise(_count(question, "&") + 1),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix_rate": F.coalesce("suffix_rate", F.lit(model.rate)), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))})


def train(rows: DataFrame) -> UrlModel:
    """Trees and suffix statistics from the parsed URLs that a rule judges."""
    labelled = rows.filter("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not total or blocked in (0, total):
        return UrlModel(None, "block" if total and blocked else "allow", float(bool(total and blocked)), None)
    rate = blocked / total
    suffixes = pin(labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
                   .select("suffix", ((F.col("bad") + 10 * rate) / (F.col("n") + 10)).alias("suffix_rate"),
                           (F.col("n") / total).alias("suffix_share")))
    model = UrlModel(None, "", rate, suffixes)
    most = TRAIN_ROWS // 2
    stands_for = F.when(F.col("label") == 1, max(1.0, blocked / most)).otherwise(max(1.0, (total - blocked) / most))
    sample = per_class(labelled, "label", most, "page_id", "url").withColumn("weight", stands_for)
    vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features")
    # The sample is small: few partitions keep the many short passes of boosting short.
    seen = vectors.transform(with_features(sample, model)).select("features", "label", "weight").coalesce(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32, weightCol="weight").fit(seen)
    return UrlModel(trees, "", rate, suffixes)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the trees' probability of ``block``."""
    rows = parsed(pages, rules)
    model = train(rows)
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(1.0 if model.only == "block" else 0.0))
    else:
        vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features")
        found = model.trees.transform(vectors.transform(with_features(rows, model)))
        scored = found.withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


@query("op9_urls")
def urls(spark: SparkSession, directory: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judged(table(spark, directory, "pages"))
