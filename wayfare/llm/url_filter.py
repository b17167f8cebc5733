"""URL filter: rules first, then gradient-boosted trees on lexical features.

Everything runs as DataFrame functions and JVM-side trees. Features of a URL:
lengths of host and path, depth, digit and hyphen counts, entropy of the host,
parameter counts, labels in the host, and statistics of its suffix over the
whole table. The trees learn from labelled URLs: the rows' own label column (1:
block) where there is one, else labelled_urls(), invented addresses of two kinds.
The rules' own rows don't serve as labels: they would only teach the trees which
top level domain a rule names. At most `train_rows` labelled rows are used, the
ones of least hash. The trees decide the rows without a rule.

Defined results: a null URL or one without "://" has an empty host and path,
fits no rule, and is allowed; where the labels have one class only, there are no
trees and rows without a rule are allowed. Rows are kept one to one; other
columns pass by.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict): a host with its subdomains, and the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("host_length", "path_length", "depth", "digit_ratio", "hyphens", "entropy", "labels", "parameters", "label_length", "suffix_share")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    chars = F.array_distinct(F.split(text, ""))
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.greatest(F.length(text), F.lit(1)))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def with_features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host, path and the feature columns."""
    url = F.col(url_col)
    rows = urls.withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumns({"_suffix": F.substring_index("host", ".", -1)})
    total = rows.count()
    share = rows.groupBy("_suffix").agg((F.count("*") / F.lit(float(max(1, total)))).alias("suffix_share"))
    if share.count() <= 10_000:  # else the join decides for itself
        share = F.broadcast(share)
    rows = rows.join(share, "_suffix", "left")
    longest = F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    return rows.withColumns({
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(F.coalesce(url, F.lit("")), "[^0-9]", "")) / F.greatest(F.length(F.coalesce(url, F.lit(""))), F.lit(1)),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")).cast("double"),
        "entropy": _entropy(host),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "label_length": longest.cast("double"),
        "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
    })


def labelled_urls(spark: SparkSession, n: int = 6000) -> DataFrame:
    """url, label: invented addresses by a fixed rule. Half are plain; half (label 1) are dressed up: words chained by hyphens, digits, long
    query strings. A tenth of each kind carries one trait of the other, so that no single feature decides. Suffixes are dealt alike to both."""
    syllables = F.array(*map(F.lit, "ba ce di fo gu la me ni po ru sta tre vin wol dex kan mil ors pel quo".split()))
    suffixes = F.array(*map(F.lit, "com org net info de co.uk example.com example.net example.org".split()))
    draw = lambda salt, of: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(of))
    word = lambda salt: F.concat(*[F.element_at(syllables, (draw(f"{salt}{k}", 20) + 1).cast("int")) for k in range(2)], F.when(draw(f"{salt}m", 2) == 0, F.element_at(syllables, (draw(f"{salt}l", 20) + 1).cast("int"))).otherwise(""))
    dressed = F.col("label") == 1
    odd = draw("odd", 10) == 0
    chained = F.concat(word("h"), F.lit("-"), word("i"), F.when(draw("three", 3) == 0, F.concat(F.lit("-"), word("j"))).otherwise(""), F.when(draw("digits", 3) == 0, draw("d", 1000).cast("string")).otherwise(""))
    plain = F.concat(F.element_at(F.array(F.lit(""), F.lit("www."), F.lit("blog."), F.lit("m.")), (draw("sub", 4) + 1).cast("int")), word("h"))
    host = F.when(dressed != odd, chained).otherwise(plain)
    query = F.when(draw("query", 4) < F.when(dressed, 2).otherwise(1), F.concat(F.lit("?id="), draw("q", 100000).cast("string"), F.lit("&ref="), word("r"))).otherwise("")
    url = F.concat(F.lit("http://"), host, F.lit("."), F.element_at(suffixes, (draw("suffix", 9) + 1).cast("int")), F.lit("/"), F.substring(word("p"), 1, 2), F.lit("/"), draw("page", 10000).cast("string"), query)
    return spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).select(url.alias("url"), "label")


def train(rows: DataFrame, label_col: str, train_rows: int = 20_000) -> GBTClassificationModel | None:
    """Boosted trees from at most train_rows labelled rows with features; None if one class is missing."""
    sample = rows.filter(F.col(label_col).isNotNull()).orderBy(F.xxhash64("host", "path"), *FEATURES).limit(train_rows)
    sample = sample.select(*FEATURES, F.col(label_col).cast("double").alias("label"))
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label").persist()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        return GBTClassifier(maxIter=8, maxDepth=3, seed=7, checkpointInterval=-1).fit(sample)
    finally:
        sample.unpersist()


def url_filter(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules=RULES, train_rows: int = 20_000) -> DataFrame:
    """Per URL: id, host, path, rule, verdict, score (of the trees; null where the URL has no host)."""
    keep = [F.col(id_col).alias("_id"), F.col(url_col).alias("_url")] + ([F.col(label_col).alias("_label")] if label_col else [])
    rows = with_features(urls.select(*keep), "_url")
    model = train(rows, "_label", train_rows) if label_col else train(with_features(labelled_urls(urls.sparkSession)), "label", train_rows)
    if model is None:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array

        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(assembled)
        rows = scored.withColumn("score", F.when(F.col("host") != "", vector_to_array("probability")[1]))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select(F.col("_id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
