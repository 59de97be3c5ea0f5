"""Operator 12: URL filter by host and path rules and by gradient-boosted trees on lexical features.

1. Rules (DataFrame functions): host and path are cut from the URL; a rule fits its host and every subdomain if the path
   starts with the rule's path; the longest fitting rule (code points of host and path, then of the host; block before allow)
   decides. The rules are a literal list, so the test is one expression per rule and no join.
2. The method judges the URLs that no rule fits. Its features look at the spelling of a URL only: lengths, depth, shares of
   digits, of upper case and of other marks, entropy of the characters, numbers of parameters, hyphens and labels, and for
   the last one, two and three labels of the host the smoothed share of blocked URLs among the labelled ones with that suffix
   and their number (log).
3. Suffix statistics are aggregates over all labelled URLs (partial aggregation takes the weight of a hot host). The trees are
   Spark ML's ``GBTClassifier``, fitted to at most ``PER_CLASS`` labelled URLs of either class, those with the least hashes. A
   training URL takes its suffix shares from the other ``FOLDS`` - 1 folds of URLs, so its own label is not among its features.

Labels are any (url, blocked) rows; ``judge`` takes the URLs that the rules decide.

Defined results: null or schemeless URLs have empty host and path, fit no rule and are allowed, as there is nothing to judge;
without labelled URLs the method allows, with labels of one class it gives that class; contradicting labels of a URL
count as they come; repeated rows get equal verdicts; an empty table gives an empty result; other columns are passed on,
columns called host, path, rule, verdict or block_score are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .decontam import let

ALLOW, BLOCK = "allow", "block"
# The rules of the contract, (verdict, host, path).
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]
PER_CLASS, FOLDS, PRIOR, ROUNDS, DEPTH, SEED = 10_000, 5, 10.0, 20, 4, 12
SUFFIXES = (1, 2, 3)
ADDED = ("host", "path", "rule", "verdict", "block_score")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AUTHORITY = r"(?s)^.*?://([^/?#]*)"


def _after_scheme(url: Column, group: int, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_after_scheme(url, 1, _AUTHORITY), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _after_scheme(url, 1, _AUTHORITY[:-9] + r"[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null if none fits."""
    at_best = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != BLOCK))
    fit = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    named = lambda v, h, p: F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*[F.when(fit(h, p), named(v, h, p)) for v, h, p in at_best])


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: sorted characters fall into runs, folded in one pass."""
    chars = F.concat(F.array_sort(F.split(text, "")), F.array(F.lit(None).cast("string")))
    start = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))

    def step(acc: Column, c: Column) -> Column:
        same = c.eqNullSafe(acc["c"])
        gain = F.when(acc["k"] > 0, acc["k"] * F.log2(F.greatest(acc["k"], F.lit(1.0)))).otherwise(0.0)
        return F.struct(c.alias("c"), F.when(same, acc["k"] + 1).otherwise(1.0).alias("k"), F.when(same, acc["s"]).otherwise(acc["s"] + gain).alias("s"))

    n = F.length(text).cast("double")
    folded = F.aggregate(chars, start, step)["s"]
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - folded / n).otherwise(0.0)


def _suffix(host: Column, k: int) -> Column:
    return F.substring_index(host, ".", -k)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Name -> feature, of the spelling of a URL alone."""
    rest = F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": count(path, "/+[^/]"), "labels": count(host, r"[^.]+"), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "digits": _share(url, "[0-9]"), "host_digits": _share(host, "[0-9]"), "path_digits": _share(path, "[0-9]"),
        "capitals": _share(url, "[A-Z]"), "marks": _share(rest, "[^A-Za-z0-9/]"), "hyphens": count(host, "-"), "escapes": count(rest, "%[0-9A-Fa-f]{2}"),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0), "fragment": rest.contains("#").cast("int"),
        "last_length": F.length(last), "extension": last.contains(".").cast("int"), "secure": url.startswith("https:").cast("int"),
        "url_entropy": entropy(url), "host_entropy": entropy(host), "path_entropy": entropy(path),
    }


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), url), F.lit(FOLDS))


class Filter:
    """Suffix statistics and trees learned from labelled URLs."""

    def __init__(self, suffixes: list[DataFrame], share: float, model: Model | None, names: list[str]):
        self.suffixes, self.share, self.model, self.names = suffixes, share, model, names

    def score(self, urls: DataFrame, held: bool = False) -> DataFrame:
        """``urls`` with block_score, the probability that the URL is to be blocked."""
        if self.model is None:
            return urls.withColumn("block_score", F.lit(self.share))
        keep = [c for c in urls.columns if c != "block_score"]
        rows = urls.select(F.struct(*keep).alias("_row"), F.col("url"), F.col("host"), F.col("path"))
        rows = vectors(rows, self.suffixes, self.share, held)
        out = self.model.transform(rows.select("_row", "features"))
        return out.select("_row.*", vector_to_array("probability")[1].alias("block_score"))


def suffix_tables(labelled: DataFrame) -> list[DataFrame]:
    """For each k: (suffix, blocked, seen: per fold) over all labelled rows."""
    out = []
    for k in SUFFIXES:
        sums = [F.sum(F.when(_fold(F.col("url")) == f, c).otherwise(0)).alias(f"{n}{f}") for n, c in (("b", F.col("blocked").cast("int")), ("s", F.lit(1))) for f in range(FOLDS)]
        table = labelled.groupBy(_suffix(F.col("host"), k).alias(f"_suffix{k}")).agg(*sums)
        blocked, seen = (F.array(*[F.col(f"{n}{f}") for f in range(FOLDS)]).alias(f"_{n}{k}") for n in "bs")
        out.append(cut(table.select(f"_suffix{k}", blocked, seen)))
    return out


def vectors(rows: DataFrame, suffixes: list[DataFrame], share: float, held: bool) -> DataFrame:
    """``rows`` (url, host, path, ...) with the assembled ``features``. ``held``: without the counts of the URL's own fold."""
    for k, table in zip(SUFFIXES, suffixes, strict=True):
        rows = rows.withColumn(f"_suffix{k}", _suffix(F.col("host"), k)).join(small(table, 100_000), f"_suffix{k}", "left")
    names = lexical(F.col("url"), F.col("host"), F.col("path"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    for k in SUFFIXES:
        own = lambda c: F.when(F.lit(held), F.get(c, _fold(F.col("url")).cast("int"))).otherwise(0)
        blocked, seen = (F.coalesce(total(F.col(f"_{n}{k}")) - own(F.col(f"_{n}{k}")), F.lit(0)) for n in "bs")
        names |= {f"suffix{k}_blocked": (blocked + PRIOR * share) / (seen + PRIOR), f"suffix{k}_seen": F.log1p(seen)}
    kept = [c for c in rows.columns if not c.startswith(("_suffix", "_b", "_s"))]
    rows = rows.select(*kept, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_f_{n}") for n, c in names.items()])
    return VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol="features").transform(rows)


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> Filter:
    """The filter learned from ``labelled`` (url, host, path, blocked)."""
    labelled = labelled.select("url", "host", "path", F.col("blocked").cast("boolean").alias("blocked"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b")).first()
    share = (seen["b"] / seen["n"]) if seen["n"] else 0.0
    if share in (0.0, 1.0):
        return Filter([], share, None, [])
    tables = suffix_tables(labelled)
    least = [labelled.where(F.col("blocked") == c).orderBy(F.xxhash64(F.lit(3), "url"), "url").limit(per_class) for c in (True, False)]
    chosen = cut(reduce(DataFrame.unionByName, least))
    rows = vectors(chosen, tables, share, held=True).select("url", F.col("blocked").cast("double").alias("label"), "features")
    # a bounded sample in one sorted partition: every run finds the same split points and sums in the same order
    rows = cut(rows.coalesce(1).sortWithinPartitions("url", "label")).coalesce(1)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=SEED).fit(rows)
    return Filter(tables, share, model, [])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """``pages`` (with url) and host, path, rule, verdict and block_score (null where a rule decides)."""
    pages = pages.drop(*ADDED)
    parsed = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = let(F.struct("host", "path"), lambda x: rule_of(x["host"], x["path"], rules))
    parsed = parsed.withColumn("_rule", ruled)
    learned = train(parsed.where("_rule is not null").select("url", "host", "path", (F.col("_rule.verdict") == BLOCK).alias("blocked")), per_class)
    out = learned.score(parsed)
    score = F.when(F.col("_rule").isNull() & (F.col("host") != ""), F.col("block_score"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(score >= threshold, F.lit(BLOCK)), F.lit(ALLOW))
    names = [F.col(c) for c in pages.columns]
    return out.select(*names, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("block_score"))
