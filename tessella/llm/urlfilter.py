"""URL filters: domain rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Production parameters: buckets of hashed n-grams, their sizes, most labelled rows used for the fit, and the fit itself.
BUCKETS, SIZES, MAX_LABELLED, STEPS, RATE, RIDGE = 4096, (3, 4), 5_000, 300, 0.1, 1e-5

#: Words of unwanted hosts and of ordinary ones; the labelled table joins them two by two.
UNWANTED = "casino poker betting bets slots jackpot lottery gambling viagra cialis pills pharma adult porn xxx cams escort dating spam phishing malware adserver ads tracker popup clicks warez crack keygen torrent replica payday loans bonus freebies cheap winner prize".split()
ORDINARY = "news library museum garden weather kitchen history physics school travel music science forum recipes sports village theatre atlas harbour archive whether another nation edition winter render order report teacher health theory street forest winding tradition station national question mother weather center within thinking other river thread hearing reading".split()
#: Consonants and vowels of invented names, which are ordinary.
CONSONANTS, VOWELS = "b c d f g h l m n p r s t th sh wh st nd tr bl".split(), "a e i o u ea ou er on in".split()
INVENTED = 160
SUBDOMAINS, DOMAINS = ("", "www.", "blog.", "m."), ("com", "net", "org")
#: Paths, of which every host, unwanted or not, has the same ones.
PATHS = ("/en/12", "/de/7.html", "/fr/431?page=2", "/es/88/", "/index", "/")


def hosts() -> list[tuple[str, int]]:
    """The table's hosts without subdomain: (name and domain, 1 for unwanted)."""
    found = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            mates = [words[(k + step) % len(words)] for step in (5, 11)]
            found += [(name, label) for name in (word, word + mates[0], f"{word}-{mates[1]}")]
    for k in range(INVENTED):
        parts = [(CONSONANTS if j % 2 == 0 else VOWELS)[(7 * k + 3 * j * j + k // (j + 2)) % (20 if j % 2 == 0 else 10)] for j in range(4 + k % 3)]
        found.append(("".join(parts), 0))
    return [(f"{name}.{DOMAINS[k % len(DOMAINS)]}", label) for k, (name, label) in enumerate(dict(found).items())]


def labelled_rows(only: list[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """The small labelled URL table: (url, 1 for unwanted), each host with a subdomain and each path in turn."""
    return [(f"https://{SUBDOMAINS[(k + j) % len(SUBDOMAINS)]}{host}{PATHS[j]}", label) for k, (host, label) in enumerate(hosts() if only is None else only) for j in (k % 3, k % 3 + 3)]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): ASCII letters of the host in lower case; both empty if null or without `://`."""
    has = F.instr(url, "://") > 0
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of host and path; digits count as one character."""
    text = F.concat(F.lit("^"), host, F.lit(" "), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))

    def sized(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.lit(n - 1)))
        # One parameter: with a second one transform() would hand in the index.
        return F.transform(starts, lambda at: F.pmod(F.xxhash64(F.substring(text, at, F.lit(n))), F.lit(buckets)).cast("int"))

    parts = [sized(n) for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def fit(labelled: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_LABELLED) -> tuple[list[float], float]:
    """(weights, bias) from a table of (url, label), at most `max_rows` rows of it by hash order.

    The features are the very expressions that score later. Fit on the driver by gradient steps
    over the whole small sample; features of a url are scaled to length one. An empty table, or
    one with a single class, gives zero weights and the bias of that class (0 if empty).
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url").limit(max_rows)
    rows = rows.select(grams(host, path, buckets).alias("g"), F.col("label").cast("int").alias("y")).collect()
    weights, bias = np.zeros(buckets), 0.0
    y = np.asarray([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return weights.tolist(), float(0 if not len(y) else 4 * (2 * y[0] - 1))
    x = np.zeros((len(rows), buckets))
    for k, r in enumerate(rows):
        x[k, r["g"]] = len(r["g"]) ** -0.5
    m, v = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for t in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-(x @ weights + bias))) - y
        grad = np.append(x.T @ error / len(y) + RIDGE * weights, error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights.tolist(), float(bias)


def probability(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The chance that a url is unwanted."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(grams(host, path, len(weights)), F.lit(0.0), lambda a, g: a + F.get(table, g))
    score = total / F.sqrt(F.size(grams(host, path, len(weights)))) + F.lit(bias)
    return 1 / (1 + F.exp(-score))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability), a row per page, in one pass without a shuffle.

    Rules win; otherwise a page is blocked if the model's chance reaches `threshold`. A null url,
    or one without `://`, has empty host and path, fits no rule, and is judged like any other text.
    A url of any length is read whole, its cost growing with its length. Repeated rows are judged
    each, an empty table gives no rows, and columns of `pages` other than page_id and url are not
    read, whatever their names.
    """
    weights, bias = fit(labelled)
    host, path = split_url(F.col("url").cast("string"))
    base = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), probability(F.col("host"), F.col("path"), weights, bias).alias("probability"))
    told = F.coalesce(F.col("ruled"), F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return base.select("page_id", "host", "path", "rule", told.alias("verdict"), "probability")


def query(pages: DataFrame) -> DataFrame:
    """The op5 digest over every page."""
    spark = pages.sparkSession
    return judge(pages, labelled_table(spark)).select("page_id", "host", "path", "rule", "verdict", F.round("probability", 6).alias("probability"))


def labelled_table(spark: SparkSession, only: list[tuple[str, int]] | None = None) -> DataFrame:
    """The labelled table, or its rows for some of the hosts, as a relation of literal values."""
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_rows(only))
    return spark.sql(f"select * from values {rows} as t(url, label)")
