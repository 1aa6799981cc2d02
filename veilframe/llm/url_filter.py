"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features.

The trees are Spark ML's. They learn from labelled URLs; without other labels, the rules' own verdicts are labels: what a
site's keepers have ruled on teaches what to do with the rest. Statistics of host suffixes and of path endings are
block rates over all labelled URLs in a table of hashed buckets, whose size does not grow with the data.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import uniform
from .common import fresh, materialize, q

TRAIN_ROWS = 20_000     # labelled URLs used to grow trees, about, half of each verdict (a documented bound; statistics and verdicts cover all URLs)
BUCKETS = 4096          # rows of the suffix statistics
PRIOR = 20.0            # labelled URLs that the overall rate counts for in a bucket
TREES, DEPTH = 12, 4
FIT_TASKS = 4

# The rules of the production query, (host, path start, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_=&?%:#+~"


class UrlModel(NamedTuple):
    trees: object | None    # fitted model, or None: `fallback` for all
    suffixes: DataFrame | None
    rate: float
    fallback: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null one or one without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    tail = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host (or a domain above it) and path: struct ``rule, verdict``; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bucket(kind: str, value: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), value), F.lit(BUCKETS))


def lexical(urls: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``urls`` with ``__lexical`` (array of doubles) and the buckets of its suffixes."""
    text = F.lower(F.coalesce(q(url).cast("string"), F.lit("")))
    size = F.length(text).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in _SIGNS]),
                         lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    held = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    spread = F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    other = size - held
    entropy = F.when(size > 0, F.log2(size) - (spread + F.when(other > 0, other * F.log2(other)).otherwise(0.0)) / size).otherwise(0.0)

    def many(pattern: str, of: Column) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    def share(pattern: str, of: Column) -> Column:
        return F.when(F.length(of) > 0, many(pattern, of) / F.length(of)).otherwise(0.0)

    query = F.when(F.instr(text, "?") > 0, F.regexp_extract(text, r"(?s)\?([^#]*)", 1)).otherwise(F.lit(""))
    first = F.regexp_extract(q(path), r"^/([^/]*)/", 1)
    features = F.array(size, F.length(q(host)).cast("double"), F.length(q(path)).cast("double"), many(r"/[^/]", q(path)),
                       many(r"\.", q(host)), share(r"[0-9]", text), share(r"[0-9]", q(path)), many(r"-", q(host)), entropy,
                       F.when(query != "", 1.0 + many("&", query)).otherwise(0.0), F.length(query).cast("double"),
                       text.startswith("https:").cast("double"), F.instr(text, "#").cast("boolean").cast("double"), many(r"%[0-9a-f]{2}", text))
    return urls.withColumns({
        "__lexical": features,
        "__s1": _bucket("top", F.substring_index(q(host), ".", -1)),
        "__s2": _bucket("domain", F.substring_index(q(host), ".", -2)),
        "__s3": _bucket("directory", first),
        "__s4": _bucket("ending", F.regexp_extract(q(path), r"(\.[A-Za-z0-9]{1,5}|/)$", 1))})


def _with_suffixes(urls: DataFrame, table: DataFrame, rate: float) -> DataFrame:
    """Add ``features``: lexical ones and the block rates of the four suffixes."""
    out = urls
    for k in range(1, 5):
        side = table.select(F.col("bucket").alias(f"__b{k}"), F.col("rate").alias(f"__r{k}"))
        out = out.join(F.broadcast(side), F.col(f"__s{k}") == F.col(f"__b{k}"), "left")  # at most BUCKETS rows
    rates = F.array(*[F.coalesce(F.col(f"__r{k}"), F.lit(rate)) for k in range(1, 5)])
    return out.withColumn("features", array_to_vector(F.concat("__lexical", rates)))


def _sampled(rows: DataFrame, blocked: float, allowed: float, bound: int) -> DataFrame:
    """About ``bound / 2`` rows of each verdict, folded by URL, with the ``weight`` that makes them stand for all.

    Whether a URL is taken depends on the URL alone, with a chance that grows with its rows up to certainty; so a frequent URL is
    always there, and a verdict of which there are few keeps all of its rows.
    """
    folded = rows.groupBy("url", "host", "path", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of_kind = F.when(F.col("label") == 1.0, F.lit(blocked)).otherwise(F.lit(allowed))
    chance = F.least(F.lit(1.0), F.col("n") * F.lit(bound / 2) / of_kind)
    drawn = folded.withColumn("__chance", chance).where(uniform("url-sample", F.col("url"), F.col("label")) < F.col("__chance"))
    return drawn.select("url", "host", "path", "label", (F.col("n") / F.col("__chance")).alias("weight"))


def fit(labelled: DataFrame, bound: int = TRAIN_ROWS, seed: int = 5) -> UrlModel:
    """Learn from rows with ``url, host, path, blocked`` (0 or 1).

    Without any row all other URLs are allowed; with rows of one kind only, they get that verdict. The model does not depend on how
    the rows are partitioned.
    """
    rows = materialize(lexical(labelled, "url", "host", "path").select("url", "host", "path", "__lexical", *[f"__s{k}" for k in range(1, 5)],
                                                                      F.col("blocked").cast("double").alias("label")), "labelled-urls")
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return UrlModel(None, None, 0.0, "block" if n and blocked else "allow")
    rate = blocked / n
    # rates of all labelled URLs, each counted for its four suffixes before the shuffle
    table = (rows.select(F.explode(F.array(*[f"__s{k}" for k in range(1, 5)])).alias("bucket"), "label")
             .groupBy("bucket").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
             .select("bucket", ((F.col("b") + PRIOR * rate) / (F.col("n") + PRIOR)).alias("rate")))
    table = materialize(table, "suffixes")
    sample = materialize(_with_suffixes(lexical(_sampled(rows, blocked, n - blocked, bound), "url", "host", "path"), table, rate)
                         .select("url", "features", "label", "weight").repartition(FIT_TASKS, "url").sortWithinPartitions("url", "label"), "url-sample")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=64, weightCol="weight").fit(sample)
    return UrlModel(trees, table, rate, "allow")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None,
               bound: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and ``score``, the trees' probability of "block".

    The longest fitting rule decides, else the trees (``labelled``: rows ``url, blocked``; by default the pages that rules
    decide). A null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the trees. Null and
    repeated ids are rows like others; an empty table gives an empty result; other columns are not read.
    """
    base = pages.select(q(id_col).alias("page_id"), q(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    ruled = base.withColumns({"host": host, "path": path}).withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.where(F.col("__rule").isNotNull()).select("url", "host", "path", (F.col("__rule.verdict") == "block").cast("double").alias("blocked"))
    else:
        host, path = host_and_path(F.col("url"))
        known = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("double").alias("blocked")) \
            .where(F.col("blocked").isin(0.0, 1.0)).withColumns({"host": host, "path": path})
    model = fit(known, bound)
    if model.trees is None:
        scored = ruled.withColumn("score", F.lit(1.0 if model.fallback == "block" else 0.0))
    else:
        seen = _with_suffixes(lexical(ruled, "url", "host", "path"), model.suffixes, model.rate)
        scored = model.trees.transform(seen).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", verdict).alias("verdict"), "score")


def allowed_pages(pages: DataFrame, rules=RULES, url_col: str = "url", **options) -> DataFrame:
    """The pages whose URL is allowed, with all their columns. Rules as in ``judge_urls``."""
    name = fresh(pages, "page")[0]
    whole = pages.select(F.struct(*[q(c) for c in pages.columns]).alias(name), q(url_col).alias("url"))
    return judge_urls(whole, rules, name, "url", **options).where(F.col("verdict") == "allow").select("page_id.*")
