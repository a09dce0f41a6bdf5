"""URL filters: a rule list, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The policy: (verdict, host and path). A rule fits its host and all subdomains, if the path starts with the rule's; longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Labelled urls that the trees are fitted on at most: those with the least hash of their url. Suffix statistics use all.
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 11
#: Weight of the overall share of blocked urls in a suffix's own.
PRIOR = 20.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep..., url, host, path``: the host follows the first ``://`` up to ``/ ? #``, the path goes on up to ``? #``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    full = pages.select(*keep, F.coalesce("url", F.lit("")).alias("url")).withColumn("rest", rest)
    return full.withColumns({"host": host, "path": path}).drop("rest")


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``verdict``, null where no rule fits. The list is a policy of a few rules and becomes one expression."""
    found = ruling = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found, ruling = F.when(fits, rule).otherwise(found), F.when(fits, verdict).otherwise(ruling)
    return urls.withColumns({"rule": found, "verdict": ruling})


def _entropy(column: str):
    """Bits per character over a url's distinct characters."""
    n = F.length(column)
    counts = F.transform(F.array_distinct(F.split(column, "")), lambda c: n - F.length(F.replace(F.col(column), c, F.lit(""))))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))).otherwise(0.0)


LEXICAL = ("url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "has_fragment", "is_https")


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of ``LEXICAL``, and the suffixes whose statistics are features: the top level, the registered name, the
    path's first folder and its file ending."""
    n = F.greatest(F.length("url"), F.lit(1))
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length("url"), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_labels": F.size(F.split("host", r"\.")), "path_depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace("url", r"[^0-9]", "")) / n, "host_digits": F.length(F.regexp_replace("host", r"[^0-9]", "")),
        "hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))), "entropy": _entropy("url"),
        "parameters": F.when(query == "", 0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1),
        "has_fragment": F.col("url").contains("#").cast("int"), "is_https": F.col("url").startswith("https").cast("int"),
        "top_level": F.substring_index("host", ".", -1), "registered": F.substring_index("host", ".", -2),
        "folder": F.concat_ws(" ", F.substring_index("host", ".", -1), F.regexp_extract("path", r"(?s)^/([^/]*)/", 1)),
        "ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8})$", 1),
    })


SUFFIXES = ("top_level", "registered", "folder", "ending")


def suffix_statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """For each kind of suffix, ``suffix, n, blocked`` over all labelled urls."""
    return {kind: labelled.groupBy(F.col(kind).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked")) for kind in SUFFIXES}


def with_suffix_shares(urls: DataFrame, statistics: dict[str, DataFrame], share: float, own: bool) -> DataFrame:
    """Adds ``<kind>_share``: the smoothed share of blocked urls with that suffix. ``own``: the url's own label is left out.

    A suffix may be that of most urls: the statistics are one row each, and Spark broadcasts them or splits the large side.
    """
    for kind, rows in statistics.items():
        named = rows.select(F.col("suffix").alias(f"_{kind}"), F.col("n").alias("_n"), F.col("blocked").alias("_b"))
        n, b = F.coalesce("_n", F.lit(0)), F.coalesce("_b", F.lit(0.0))
        if own:
            n, b = n - 1, b - F.col("label")
        value = (b + share * PRIOR) / (n + PRIOR)
        urls = urls.join(named, F.col(kind) == F.col(f"_{kind}"), "left").withColumn(f"{kind}_share", value).drop(f"_{kind}", "_n", "_b")
    return urls


FEATURES = (*LEXICAL, *(f"{kind}_share" for kind in SUFFIXES))


class UrlModel:
    """Trees and the statistics they need."""

    def __init__(self, trees: GBTClassificationModel | None, statistics: dict[str, DataFrame], share: float) -> None:
        self.trees, self.statistics, self.share = trees, statistics, share

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``score``, the trees' probability of block; ``urls`` come from :func:`lexical`. Unfitted: the share of blocked urls."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(self.share))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffix_shares(urls, self.statistics, self.share, False))
        scored = self.trees.transform(ready)
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *(f"{k}_share" for k in SUFFIXES))


def fit(labelled: DataFrame) -> UrlModel:
    """Trees on ``labelled(url, host, path, label)``, label 1.0 for block. With one class or none, only its share is learnt."""
    from .common import stored

    known = stored(lexical(labelled))
    n, share = known.agg(F.count("*"), F.avg("label")).first()
    statistics = {kind: stored(rows) for kind, rows in suffix_statistics(known).items()}
    if not n or share in (0.0, 1.0):
        return UrlModel(None, statistics, share or 0.0)
    few = known.orderBy(F.xxhash64(F.lit(SEED), "url"), "url").limit(FIT_ROWS)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffix_shares(few, statistics, share, True))
    ready = stored(ready.select("features", "label")).coalesce(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, stepSize=0.2).fit(ready)
    return UrlModel(trees, statistics, share)


def labels_of(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``url, host, path, label`` of every labelled url: those a rule decides, and those whose document the labels mark as toxic or not.

    A url names its document by the last number of its path.
    """
    marked = ruled(parsed(pages), rules).withColumn("doc", F.expr(r"try_cast(regexp_extract(path, r'(\d{1,18})[^/]*/?$', 1) AS long)"))
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    joined = marked.join(toxic, marked.doc == toxic.doc_id, "left")
    label = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("double")).otherwise(F.col("toxic").cast("double"))
    return joined.withColumn("label", label).where("label IS NOT NULL").select("url", "host", "path", "label")


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages(page_id, url)``.

    A rule's verdict stands; else the trees', block from a score of one half. Null urls, and urls without ``://``, have an empty
    host and path, fit no rule and are scored like others. Ids may be null or repeat; each row is answered. Other columns are
    not looked at. ``labels(doc_id, toxic)`` may be empty, as may ``pages``.
    """
    model = fit(labels_of(pages, labels, rules))
    scored = model.score(lexical(ruled(parsed(pages, "page_id"), rules)))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
