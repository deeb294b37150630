"""URL verdicts: host rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on the URLs that the rules label (a bounded sample of them) and use only the
form of a URL: lengths, depth, digit ratio, character entropy, parameter counts and statistics of
the host's suffix, which are counted by hosts and out of fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.arrow import lower_ascii, pick
from tandem.llm.tables import written

#: (rule, verdict): fixed by the task.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ["url_chars", "host_chars", "path_chars", "query_chars", "depth", "labels", "digit_ratio", "entropy",
            "params", "hyphens", "suffix_size", "suffix_block"]
#: Folds of hosts for the suffix statistics of training rows, and the weight (in hosts) of the base share.
FOLDS, PRIOR = 5, 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host or a parent domain, path prefix) and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        domain, _, rest = r.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical columns to ``df(url, host, path)``."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url)
    chars = F.split(url, "")
    share = lambda c: F.size(F.filter("_chars", lambda x: x == c)) / F.size("_chars")
    entropy = F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    df = df.withColumn("_chars", chars)
    return df.withColumns({
        "url_chars": n, "host_chars": F.length("host"), "path_chars": F.length("path"), "query_chars": F.length(query),
        "depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "labels": F.length("host") - F.length(F.translate("host", ".", "")),
        "digit_ratio": (n - F.length(F.translate(url, "0123456789", ""))) / F.greatest(n, F.lit(1)),
        "entropy": entropy,
        "params": F.when(F.length(query) > 0, F.length(query) - F.length(F.translate(query, "&", "")) + 1).otherwise(0),
        "hyphens": n - F.length(F.translate(url, "-", "")),
        "suffix": host_suffix()}).drop("_chars")


def host_suffix() -> Column:
    return F.substring_index("host", ".", -1)


def fold_of_host() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def suffix_counts(rows: DataFrame) -> DataFrame:
    """``(suffix, fold, hosts, blocked, allowed, rules)`` of all ``rows(host, rule, ruled)``: distinct hosts, those
    with a blocked or an allowed URL, and the rules that label them. A host is in one fold."""
    by_host = rows.groupBy("host").agg(F.max(F.expr("int(ruled = 'block')")).alias("b"), F.max(F.expr("int(ruled = 'allow')")).alias("a"),
                                       F.collect_set("rule").alias("rules"))       # at most the number of rules
    return (by_host.groupBy(host_suffix().alias("suffix"), fold_of_host().alias("fold"))
            .agg(F.count("*").alias("hosts"), F.coalesce(F.sum("b"), F.lit(0)).alias("blocked"), F.coalesce(F.sum("a"), F.lit(0)).alias("allowed"),
                 F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules")))


def suffix_statistics(counts: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """What the trees see of a suffix: ``(suffix, fold, suffix_size, suffix_block)`` for training rows, counted
    without the row's own fold of hosts; ``(suffix, suffix_size, suffix_block)`` for the others; and the base."""
    whole = counts.groupBy("suffix").agg(*(F.sum(c).alias(c) for c in ("hosts", "blocked", "allowed")),
                                         F.size(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("n_rules"))
    total = whole.agg(*(F.sum(c).alias(c) for c in ("hosts", "blocked", "allowed"))).first()
    base = total.blocked / max(1, total.blocked + total.allowed)
    size = F.floor(F.log10(F.col("hosts") / F.lit(total.hosts))).cast("double").alias("suffix_size")

    def block(blocked: Column, allowed: Column) -> Column:
        known = (F.col("n_rules") > 1) & (blocked + allowed > 1)
        return F.when(known, (blocked + PRIOR * base) / (blocked + allowed + PRIOR)).otherwise(base).alias("suffix_block")

    own = counts.select("suffix", "fold", F.col("blocked").alias("own_blocked"), F.col("allowed").alias("own_allowed"))
    fold = whole.join(own, "suffix").select("suffix", "fold", size, block(F.col("blocked") - F.col("own_blocked"),
                                                                         F.col("allowed") - F.col("own_allowed")))
    return fold, whole.select("suffix", size, block(F.col("blocked"), F.col("allowed"))), base


def judge_urls(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES,  # noqa: A002
               sample_rows: int = 10_000, trees: int = 12, depth: int = 3) -> DataFrame:
    """``(page_id, host, path, rule, verdict, p_block)`` for every row.

    ``rule`` is the longest rule that fits and ``verdict`` its ``allow`` or ``block``; without one
    ``rule`` is null and the verdict is ``block`` where the trees give it a probability over 0.5.
    Training rows: the ``sample_rows`` labelled URLs with the smallest hash, repeats once. The suffix
    statistics count the distinct hosts of the whole table, so that a large host weighs no more than a
    small one: the order of magnitude of the suffix's share of them, and the blocked share of
    its labelled hosts, drawn to that of all with a weight of ``PRIOR`` hosts. A training row sees the hosts of other
    folds only, and a suffix that fewer than two rules or two hosts label has the share of all: a single
    rule on a suffix says nothing of the rest of it, so the trees judge the form of the URL. Where
    fewer than two verdicts are labelled there is nothing to learn and the only one (or ``allow``)
    is given. A null url, or one without ``://``, has an empty host and path and is judged by the
    trees like any other; repeated rows give repeated results; an empty table none.
    """
    rows = pick(pages, page_id=id, url=url)
    host, path = url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    few = written(lexical(rows.where("ruled is not null").select("url", "host", "path", "ruled").distinct()
                              .orderBy(F.xxhash64("url"), "url").limit(sample_rows)))
    n = {r.ruled: r.n for r in few.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(n) < 2:
        only = next(iter(n), "allow")
        return rows.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"),
                           F.when(F.col("rule").isNull(), F.lit(float(only == "block"))).alias("p_block"))
    counts = written(suffix_counts(rows))
    by_fold, whole, base = suffix_statistics(counts)

    def features(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
        df = df.join(stats, on, "left").fillna({"suffix_block": base})        # not bounded: no hint
        return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(df)

    train = (features(few.withColumn("fold", fold_of_host()), by_fold, ["suffix", "fold"])
             .withColumn("_label", (F.col("ruled") == "block").cast("double")).repartition(2, "url"))
    model = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, maxBins=64,
                          seed=1).fit(train)
    scored = model.transform(features(lexical(rows), whole, ["suffix"]))
    p = vector_to_array(F.col("probability"))[1]
    return scored.select(*out, F.coalesce("ruled", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("rule").isNull(), p).alias("p_block"))
