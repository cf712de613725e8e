"""URL filter: host and path rules, and gradient-boosted trees on lexical features.

Everything is DataFrame functions and MLlib. URLs that a rule decides are the labelled ones the
trees learn from; the trees judge the rest.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreel.llm import storage

# About how many distinct labelled URLs the trees are fitted on, chosen by their hash, and how many of
# each label at least.
FIT_ROWS = 20_000
LEAST_OF_LABEL = 1_000
TREES = 20
DEPTH = 4
# Labelled URLs that a suffix needs before its own share counts more than the overall one.
SUFFIX_PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "length",
    "host_length",
    "path_length",
    "depth",
    "labels",
    "digit_ratio",
    "hyphens",
    "entropy",
    "parameters",
    "fragment",
    "first_segment_length",
    "last_segment_digits",
    "secure",
    "suffix_share",
    "suffix_count",
]


class Rule(NamedTuple):
    """``host/path``: holds for the host and its subdomains, for paths that start so."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules of the registered query.
RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def host_and_path(urls: DataFrame, url_column: str = "url") -> DataFrame:
    """The rows with columns host and path (empty for a null URL or one without ``://``)."""
    url = F.coalesce(F.col(f"`{url_column}`"), F.lit(""))
    start = F.instr(url, "://")
    after = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.char_length(host) + 1, F.char_length(after))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    return urls.select("*", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits columns host and path, as struct (rule, verdict), else null.

    Of equally long rules the alphabetically first counts.
    """
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        host = F.col("host")
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _count(text: Column, wanted: str) -> Column:
    """How many characters of a class a text has."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, wanted, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.char_length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(letters, lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def lexical(urls: DataFrame, url_column: str = "url") -> DataFrame:
    """The rows (with host and path) and the features that hang on the URL alone."""
    url = F.coalesce(F.col(f"`{url_column}`"), F.lit(""))
    n = F.char_length(url).cast("double")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    return urls.select(
        "*",
        n.alias("length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        F.size(segments).cast("double").alias("depth"),
        _count(F.col("host"), r"\.").alias("dots"),
        F.when(n > 0, _count(url, "[0-9]") / n).otherwise(0.0).alias("digit_ratio"),
        _count(url, "-").alias("hyphens"),
        F.when(n > 0, _entropy(url)).otherwise(0.0).alias("entropy"),
        _count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.char_length(F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))).cast("double").alias(
            "first_segment_length"
        ),
        _count(last, "[0-9]").alias("last_segment_digits"),
        F.startswith(url, F.lit("https")).cast("double").alias("secure"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
    ).withColumnRenamed("dots", "labels")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per host suffix, the number of all its labelled URLs and of the blocked ones.

    Settled, so that joins with it can be split at a suffix that very many URLs have.
    """
    counts = labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    return storage.settle(counts, "suffixes")


def with_suffixes(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """Add the statistics of each URL's suffix; its share leans to the overall one where URLs are few."""
    overall = statistics.select(F.coalesce(F.sum("blocked") / F.sum("n"), F.lit(0.5))).scalar()
    joined = urls.join(statistics, "suffix", "left")
    n, blocked = F.coalesce("n", F.lit(0)), F.coalesce("blocked", F.lit(0.0))
    return joined.select(
        *urls.columns,
        ((blocked + SUFFIX_PRIOR * overall) / (n + SUFFIX_PRIOR)).alias("suffix_share"),
        F.log1p(n.cast("double")).alias("suffix_count"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> GBTClassificationModel | str:
    """Boosted trees on labelled feature rows (label 1: block); ``fit_rows`` bounds the sample.

    It is drawn from the distinct URLs of each label; a URL's number of rows is its weight. Without both labels there is nothing to learn; the one label there is, or allow,
    is the answer.
    """
    distinct = labelled.select("url", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in distinct.collect()}
    if len(counts) < 2:
        return "block" if 1.0 in counts else "allow"
    parts, n = 1 << 20, sum(counts.values())
    shares = {label: min(1.0, max(fit_rows / n, LEAST_OF_LABEL / own)) for label, own in counts.items()}
    below = F.when(F.col("label") == 1.0, int(parts * shares[1.0]) + 1).otherwise(int(parts * shares[0.0]) + 1)
    chosen = F.pmod(F.xxhash64("url"), F.lit(parts)) < below
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, labelCol="label", weightCol="weight"
    )
    with storage.scratch(labelled.sparkSession) as settle:
        own = [F.first(c).alias(c) for c in FEATURES]
        weighted = labelled.filter(chosen).groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"), *own)
        sample = settle(weighted.select(*FEATURES, "label", "weight"), "labelled-urls")
        return trees.fit(_vectors(sample.repartition(6)).select("features", "label", "weight"))


def judge(urls: DataFrame, rules: Sequence[Rule], url_column: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Add host, path, rule, verdict (allow or block) and score (probability of block) to each row.

    A rule's verdict stands; other rows get the trees'. Input columns of these names are
    replaced. Repeated URLs get equal answers; an empty table an empty one.
    """
    made = {"host", "path", "rule", "verdict", "score"}
    kept = [c for c in urls.columns if c.lower() not in made]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("boolean")
    rows = urls.select(F.col(f"`{url_column}`").alias("url"), rest.alias("rest"))
    rows = lexical(host_and_path(rows)).withColumn("decided", rule_of(rules))
    block = (F.col("decided.verdict") == "block").cast("double")
    labelled = rows.filter("decided IS NOT NULL").withColumn("label", block)
    statistics = suffix_statistics(labelled)
    model = fit(with_suffixes(labelled, statistics), fit_rows)
    scored = with_suffixes(rows, statistics)
    if isinstance(model, str):
        scored = scored.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(_vectors(scored)).withColumn("score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *[F.col(f"rest.`{c}`").alias(c) for c in kept],
        "host",
        "path",
        F.col("decided.rule").alias("rule"),
        F.coalesce("decided.verdict", by_trees).alias("verdict"),
        "score",
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Per page: its URL's host and path, the rule that fits, and the verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).drop("url")
