"""URL filter: given host and path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.session import materialize

from .decontam import ascii_lower

#: Given rules (fixed by the contract): host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MIN_SUPPORT = 0.005
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
#: Up to so many mined rules, and hosts or token sets with what fits them, are sent to every executor; more are joined by shuffle.
MAX_BROADCAST_RULES = 50_000
MAX_BROADCAST_HOSTS = 100_000
BLOCK, ALLOW = "=block", "=allow"


def parse(url: Column) -> Column:
    """``host`` (A-Z lower-cased), ``path`` and ``query`` as they stand; all empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.struct(
        ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def tokens(host: Column, path: Column, query: Column) -> Column:
    """What the miner sees of a URL: all of its parts, as typed tokens, each once.

    Top label, second label, every label before, every hyphenated word of a label, the first path segment, every one after,
    the file ending and every query name; numbers in segments count as ``0``. However many there are, only those that
    ``min_support`` of the labelled URLs have enter a rule.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    segments = F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.regexp_replace(s, r"[0-9]+", "0"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    hyphened = F.filter(labels, lambda x: F.contains(x, F.lit("-")))
    typed = {
        "tld": F.slice(labels, F.greatest(n, F.lit(1)), 1),
        "name": F.when(n > 1, F.slice(labels, n - 1, 1)),
        "sub": F.slice(labels, 1, F.greatest(n - 2, F.lit(0))),
        "word": F.flatten(F.transform(hyphened, lambda x: F.array_remove(F.split(x, "-"), ""))),
        "dir": F.slice(segments, 1, 1),
        "segment": F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))),
        "ending": F.when(ending != "", F.array(ending)),
        "query": F.array_remove(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), ""),
    }
    none = F.array().cast("array<string>")

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, none), lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_sort(F.array_distinct(F.concat(*(named(k, c) for k, c in typed.items()))))


def _send(df: DataFrame, limit: int) -> DataFrame:
    """``df`` broadcast if it has no more rows than ``limit``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("rule_host", "rule_path", "rule_verdict")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def given_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host, path``) and ``given``: the longest fitting rule as ``(len, rule, verdict)``, or null.

    Every distinct host meets the rules of its own suffixes; its URLs then only compare paths.
    """
    hosts = urls.select("host").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    rule = F.concat("rule_host", "rule_path")
    fits = fits.groupBy("host").agg(
        F.collect_set(
            F.struct(F.char_length(rule).alias("len"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"), F.col("rule_path").alias("start"))
        ).alias("fits")
    )
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])))
    return urls.join(_send(fits, MAX_BROADCAST_HOSTS), "host", "left").withColumn("given", best).drop("fits")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules from ``url, bad`` (boolean; null rows are left out): ``antecedent, verdict, lift, confidence, support``.

    FP-growth runs over the tokens and the label; kept are rules whose consequent is a label, that hold in
    at least ``min_confidence`` of their matches, in ``min_count`` URLs and a share of ``min_support``, and that
    are no worse than the label's own share. No labelled URL: no rule.
    """
    at = parse(F.col("url"))
    items = labelled.filter(F.col("bad").isNotNull() & F.col("url").isNotNull()).select(
        F.array_append(tokens(at["host"], at["path"], at["query"]), F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("items")
    )
    n = items.count()
    none = labelled.sparkSession.range(0).select(
        F.array().cast("array<string>").alias("antecedent"), F.lit("").alias("verdict"), F.lit(0.0).alias("lift"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("support")
    )
    if n == 0:
        return none
    least = max(min_support, min_count / n)
    if least > 1:
        return none
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    label = F.element_at("consequent", 1)
    lift = F.round("lift", 9)
    return model.associationRules.filter(label.isin(BLOCK, ALLOW) & (lift >= 1)).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.when(label == BLOCK, "block").otherwise("allow").alias("verdict"),
        lift.alias("lift"),
        "confidence",
        F.round(F.col("support") * n).cast("long").alias("support"),
    )


def match(distinct: DataFrame, mined: DataFrame) -> DataFrame:
    """Per row of ``distinct`` (``tokens``, each once): ``mined``, the best rule it holds all tokens of.

    Inverted index: a rule is looked up by the one of its tokens that the fewest rules have. The rule that raises its
    label's share most wins (so a rare label is not outvoted), then the most confident, the best supported, the
    longest and the last in order.
    """
    small = mined.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    each = mined.select("*", F.explode("antecedent").alias("token"))
    usual = each.groupBy("token").agg(F.count(F.lit(1)).alias("rules_with"))
    index = (
        each.join(usual, "token")
        .groupBy("antecedent", "verdict", "lift", "confidence", "support")
        .agg(F.min_by("token", F.struct("rules_with", "token")).alias("token"))
    )
    pairs = distinct.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if small else index, "token")
    pairs = pairs.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("lift", "confidence", "support", F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("mined_rule"), "verdict")
    return pairs.groupBy("tokens").agg(F.max(rank).alias("mined"))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Verdict for every row of ``pages`` (``page_id, url``): the longest given rule's, else the best mined rule's, else ``allow``.

    ``labelled`` has ``url, bad``. A null URL or one without ``://`` has no host, path or token and is allowed
    (``rule`` null). Repeated rows and ids are judged row by row; a hot host or URL is looked up once. Very long URLs
    have as many tokens as parts. Other columns are not read.
    """
    at = parse(F.col("url"))
    urls = pages.select("page_id", "url", at["host"].alias("host"), at["path"].alias("path"), at["query"].alias("query"))
    urls = given_rules(urls, rule_table(pages.sparkSession, rules)).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("query")))
    mined = materialize(mine(labelled, min_support, min_confidence), "url-rules")
    best = materialize(match(urls.filter("given is null").select("tokens").distinct(), mined), "url-matches")
    return urls.join(_send(best, MAX_BROADCAST_HOSTS), "tokens", "left").select(
        "page_id", "host", "path", F.col("given")["rule"].alias("rule"),
        F.coalesce(F.col("given")["verdict"], F.col("mined")["verdict"], F.lit("allow")).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("mined")["mined_rule"]).alias("mined_rule"),
    )
