"""URL filter: rules by host and path, then the ratio of two character language models; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, same, stored, without

ALLOW, BLOCK = "allow", "block"
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)
#: Some 50 MB: rows of the gram tables are short.
BROADCAST_ROWS = 500_000
ORDER = 4
DISCOUNT = 0.75
OWN = ("host", "path", "rule", "verdict", "score", "_url", "_rule")
# Stands before the first and after the last character of a URL.
EDGE = "\u0002"
END = "\u0003"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or where null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does.

    A rule is a host and a path; it fits that host and its subdomains where the path starts with the rule's. Of rules
    of one length that fit, the first in the order of their texts counts.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _letters(url: Column) -> Column:
    """A URL as the models see it: A-Z lower-cased, digits as 0, between edge signs."""
    text = F.translate(lower_ascii(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    return F.concat(F.lit(EDGE * ORDER), text, F.lit(END))


def _grams(texts: DataFrame) -> DataFrame:
    """One row per character of a text: the character after the ORDER characters before it."""
    places = F.sequence(F.lit(1), F.length("_url") - ORDER)
    return texts.select("*", F.explode(places).alias("at")).withColumn(
        "gram", F.substring(F.col("_url"), F.col("at"), F.lit(ORDER + 1))
    )


def _way(table: DataFrame) -> str:
    """How a join takes a stored table of short rows: broadcast up to BROADCAST_ROWS of them, else by sorting both sides."""
    return "broadcast" if table.count() <= BROADCAST_ROWS else "merge"


def _ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio: log-likelihood of its last character after the others, accepted less rejected.

    Per model and order k, the probability of a character after the k before it is discounted and interpolated with
    that of order k-1, down to equal odds for all characters. A context that a model has not seen passes the shorter
    one's value on, so each character is scored by as long a context as the counts hold.
    """
    kinds = [ALLOW, BLOCK]
    per_order = (
        counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
        .groupBy("k", F.expr("right(gram, k + 1)").alias("tail"))
        .agg(*[F.sum(v).alias(v) for v in kinds])
        .withColumn("context", F.expr("left(tail, k)"))
    )
    contexts = per_order.groupBy("k", "context").agg(
        *[F.sum(v).alias(f"{v}_all") for v in kinds],
        *[F.count(F.when(F.col(v) > 0, 1)).alias(f"{v}_kinds") for v in kinds],
    )
    stats = stored(per_order.join(contexts, ["k", "context"]).drop("context"), "url-model")
    signs = stats.where("k = 0").count()
    way = _way(stats)
    model = counts.select("gram", *[F.lit(1.0 / (signs + 1)).alias(f"{v}_p") for v in kinds])
    for k in range(ORDER + 1):
        level = stats.where(F.col("k") == k).select(
            F.col("tail").alias(f"_tail{k}"),
            *[F.col(f"{v}{x}").alias(f"{v}{x}{k}") for v in kinds for x in ("", "_all", "_kinds")],
        )
        model = model.join(level.hint(way), F.expr(f"right(gram, {k + 1})") == F.col(f"_tail{k}"))
        for v in kinds:
            seen, whole, sorts = (F.col(f"{v}{x}{k}") for x in ("", "_all", "_kinds"))
            shorter = F.col(f"{v}_p")
            own = (F.greatest(seen - DISCOUNT, F.lit(0.0)) + DISCOUNT * sorts * shorter) / whole
            model = model.withColumn(f"{v}_p", F.when(whole > 0, own).otherwise(shorter))
        model = model.select("gram", *[f"{v}_p" for v in kinds])
    return model.select("gram", (F.log(f"{ALLOW}_p") - F.log(f"{BLOCK}_p")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """All rows of `pages` with host, path, rule, score and verdict.

    URLs that a rule decides are the accepted and the rejected ones; each kind trains a smoothed character model of
    variable order (up to ORDER) over all of them. score: a URL's log-likelihood difference, accepted less rejected,
    for each character. The threshold is calibrated on the same URLs: between the mean scores of both kinds, as many
    standard deviations from the one as from the other. Where no rule fits, a score at or above the threshold allows.
    If the rules leave either kind without URLs there is nothing to tell them by, and what no rule decides is allowed.

    Null urls count as empty. Models count every row; equal urls get equal scores, computed once. An empty table gives
    an empty one. Input columns named like a result column are replaced by it.
    """
    kept = without(pages, OWN)
    rows = kept.select(
        "*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _letters(F.col("url")).alias("_url")
    ).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.col("_rule.verdict")
    texts = stored(
        rows.groupBy("_url").agg(*[F.count(F.when(label == v, 1)).alias(v) for v in (ALLOW, BLOCK)]), "url-texts"
    )
    counts = stored(
        _grams(texts).groupBy("gram").agg(*[F.sum(v).alias(v) for v in (ALLOW, BLOCK)]), "url-grams"
    )
    scores = stored(
        _grams(texts)
        .join(_ratios(counts).hint(_way(counts)), "gram")
        .groupBy("_url", ALLOW, BLOCK)
        .agg(F.avg("ratio").alias("score")),
        "url-scores",
    )
    threshold = _threshold(scores)
    told = F.when(F.col("score") >= threshold, F.lit(ALLOW)).otherwise(F.lit(BLOCK))
    return rows.join(scores.select("_url", "score").hint("merge"), "_url").select(
        *same(kept), "host", "path", F.col("_rule.rule").alias("rule"), "score",
        F.coalesce(label, told).alias("verdict"),
    )


def _threshold(scores: DataFrame) -> float:
    """Where both kinds' scores are equally many standard deviations away; minus infinity if a kind has no URL."""
    sums = [F.sum(F.col(v) * x).alias(f"{v}{i}") for v in (ALLOW, BLOCK) for i, x in enumerate((F.lit(1), F.col("score")))]
    first = scores.agg(*sums).first()
    if not first[f"{ALLOW}0"] or not first[f"{BLOCK}0"]:
        return float("-inf")
    mean = {v: first[f"{v}1"] / first[f"{v}0"] for v in (ALLOW, BLOCK)}
    off = scores.agg(*[F.sum(F.col(v) * F.pow(F.col("score") - mean[v], 2)).alias(v) for v in (ALLOW, BLOCK)]).first()
    spread = {v: (off[v] / first[f"{v}0"]) ** 0.5 for v in (ALLOW, BLOCK)}
    if not spread[ALLOW] + spread[BLOCK]:
        return (mean[ALLOW] + mean[BLOCK]) / 2
    return (mean[ALLOW] * spread[BLOCK] + mean[BLOCK] * spread[ALLOW]) / (spread[ALLOW] + spread[BLOCK])
