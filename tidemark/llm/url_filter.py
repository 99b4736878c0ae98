"""URL filters: host and path rules first, gradient-boosted trees on lexical features for what no rule fits.

DataFrame functions and MLlib's trees only. The trees are trained from labelled URLs: those given, and those that the rules fit.
Suffix statistics, of the host's last label and of its last two, and those of the path's first part, alone and with the last label, are kept for
a fixed number of hash buckets, so their table has a size of its own, not the corpus's. A labelled URL gets them from the other
folds, so that its own label isn't among its features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, cut, table

#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Of suffixes; and the folds of the labelled URLs.
BUCKETS, FOLDS = 1024, 5
#: Labelled URLs that the trees are fitted on, at most; taken in the order of their hash.
TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "has_query", "has_fragment", "suffix_rate", "domain_rate", "section_rate", "suffix_section_rate")
#: Statistics: the feature, its bucket, and what is hashed of host and path.
_LAST, _SECTION = r"regexp_extract(host, '([^.]*)$', 1)", r"regexp_extract(path, '^/?([^/]*)', 1)"
SUFFIXES = (
    ("suffix_rate", "suffix", _LAST),
    ("domain_rate", "domain", r"regexp_extract(host, '([^.]*[.]?[^.]*)$', 1)"),
    ("section_rate", "section", _SECTION),
    ("suffix_section_rate", "suffix_section", f"concat({_LAST}, '/', {_SECTION})"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty for null and where there is no `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    own = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(own, parts, 1), UPPER, LOWER), F.regexp_extract(own, parts, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones the last in the order of (action, host, path). For lists of some hundred rules: they are part of the expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def with_buckets(urls: DataFrame) -> DataFrame:
    return urls.withColumns({name: F.pmod(F.xxhash64(F.expr(key)), F.lit(BUCKETS)).cast("int") for _, name, key in SUFFIXES})


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with url, host, path) and the features but the suffix statistics, and the suffixes' buckets."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double") / n)
    entropy = F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(counts, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0)))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return with_buckets(urls).withColumns({
        "length": n.cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(n == 0, F.lit(0.0)).otherwise(digits / n),
        "entropy": entropy,
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "n_labels": F.size(F.split("host", r"\.")).cast("double"),
        "n_hyphens": F.length(F.regexp_replace(url, "[^-]", "")).cast("double"),
        "has_query": url.contains("?").cast("double"),
        "has_fragment": url.contains("#").cast("double"),
    })


@dataclass
class UrlModel:
    """only: the verdict where all labels are the same; else trees, the rate of "block" and the suffix statistics (BUCKETS rows at most, each)."""

    only: str | None = None
    trees: object = None
    rate: float = 0.0
    rates: dict[str, DataFrame] = field(default_factory=dict)

    def features(self, urls: DataFrame, fold: bool) -> DataFrame:
        """urls with lexical features as a vector; with `fold`, suffix statistics are those of the other folds."""
        out = lexical(urls)
        for feature, name, _ in SUFFIXES:
            known = self.rates[feature]
            known = known.select(name, "fold", F.col("others").alias(feature)) if fold else known.select(name, F.col("all").alias(feature)).distinct()
            out = out.join(F.broadcast(known), [name, "fold"] if fold else [name], "left")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out.fillna(self.rate, [f for f, _, _ in SUFFIXES]))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 8, depth: int = 3) -> UrlModel:
    """Fits on labelled URLs: url, host, path and label (1.0: block), each different row once.

    Suffix statistics count all rows. The trees take at most train_rows rows, in hash order, of each verdict as many as it has or half
    of them, weighted back to all rows: the only place where rows are left out. Null urls are empty; labels are 0 or 1.
    """
    labelled = cut(with_buckets(labelled.select(F.coalesce("url", F.lit("")).alias("url"), "host", "path", "label").distinct()).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    seen = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(seen) < 2:
        return UrlModel("block" if 1.0 in seen else "allow")
    model = UrlModel(rate=seen[1.0] / sum(seen.values()))
    smooth = lambda blocked, n: (blocked + 4 * model.rate) / (n + 4)
    for feature, name, _ in SUFFIXES:
        own = Window.partitionBy(name)
        counts = labelled.groupBy(name, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        counts = counts.withColumns({"all_s": F.sum("s").over(own), "all_n": F.sum("n").over(own)})
        model.rates[feature] = cut(counts.select(name, "fold", smooth(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("others"), smooth(F.col("all_s"), F.col("all_n")).alias("all")))
    n_block = int(min(seen[1.0], max(train_rows // 2, train_rows - seen[0.0])))
    n_allow = int(min(seen[0.0], train_rows - n_block))
    drawn = [labelled.filter(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(n).withColumn("weight", F.lit(seen[label] / n)) for label, n in ((1.0, n_block), (0.0, n_allow))]
    fitted_on = model.features(drawn[0].unionByName(drawn[1]).drop(*(name for _, name, _ in SUFFIXES)), True).select("features", "label", "weight").coalesce(8).cache()
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, minInstancesPerNode=5, seed=7, cacheNodeIds=False, weightCol="weight").fit(fitted_on)
    fitted_on.unpersist()
    return model


def probability(urls: DataFrame, model: UrlModel) -> DataFrame:
    """urls (with url, host, path) and p_block, the trees' probability; null where all labels were the same."""
    if model.only:
        return urls.withColumn("p_block", F.lit(None).cast("double"))
    return model.trees.transform(model.features(urls, False)).select(*urls.columns, F.element_at(_array(F.col("probability")), 2).alias("p_block"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) for each row.

    labels: (url, label), 1 to block, trained from beside the URLs that the rules fit. p_block is the trees' probability of "block", null
    where a rule decides; 0.5 and more blocks. If the labelled URLs have one verdict only, or there are none, that verdict (else "allow")
    holds for the rest. Null and odd URLs have an empty host and path and are judged by the trees like any other. Ids may repeat and be
    null; equal URLs get equal verdicts. A very long URL is one row. Other columns are left out, so that no name clashes; an empty table
    gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    labelled = ruled.filter("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    if labels is not None:
        given = labels.filter(F.col("label").isNotNull()).select("url", "label")
        labelled = labelled.unionByName(given.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    model = train(labelled, train_rows)
    if model.only:
        rest = F.coalesce("verdict", F.lit(model.only))
        return ruled.select("id", "host", "path", "rule", rest.alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    rest = probability(ruled.filter("verdict is null"), model).withColumn("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    known = ruled.filter("verdict is not null").withColumn("p_block", F.lit(None).cast("double"))
    columns = ["id", "host", "path", "rule", "verdict", "p_block"]
    return known.select(columns).unionByName(rest.select(columns))


def _array(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the rules decide; SQL doesn't express the trees."""
    host, path = host_and_path(F.col("url"))
    parsed = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    return parsed.withColumns({"rule": rule, "verdict": verdict})


RULES_ORACLE = f"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from pages),
r(verdict, host_rule, under) as (values {", ".join(str(r) for r in RULES)}),
f as (select page_id, arg_max(host_rule || under, length(host_rule || under)) as rule, arg_max(verdict, length(host_rule || under)) as verdict from p join r on (host = host_rule or ends_with(host, '.' || host_rule)) and starts_with(path, under) group by page_id)
select page_id, host, path, rule, verdict from p left join f using (page_id)
"""
