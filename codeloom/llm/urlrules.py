"""URL filters: given rules by host and path, and rules mined from labels by FP-growth.

``parts`` cuts a url into host and path.  A given rule fits its host and all subdomains where the path starts with the
rule's; the longest fitting rule decides.  All other urls are judged by association rules: Spark's FP-growth finds the
combinations of url tokens that go with a bad label; those with enough confidence and support, and none whose part
is a rule already, are kept.  Tokens that the same urls hold (``host:`` and ``word:`` of a name, or the fixed parts of a
site's urls) are one item, the first of them by name: every combination of them has the same counts, so mining them one
by one finds nothing more.  Tokens of any length and frequency take part.  A url is matched through an inverted index: its tokens are looked up among the rarest
tokens of the rules, and only the rules found so are tested in full.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens, no rule, and is allowed.
Without labels, or where no combination is confident enough, no rule is mined and what no given rule blocks is
allowed.  Repeated rows are judged alike; one row per input row, null ids included.  Long urls are taken whole.  Equal
rules are one rule; of several that fit, the first by its items is reported.  A page's label is the one of the same id:
the tables share their ids.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, slim

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SUPPORT = 0.005
CONFIDENCE = 0.8
#: Urls that a rule must at least rest on, however few labels there are.
LEAST_URLS = 20
#: Labelled urls that rules are mined from, on average (a bounded sample by the hash of the id).
TRAIN_URLS = 200_000
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def tokens(url: Column) -> Column:
    """Distinct url tokens: scheme, host labels and their words, path parts with digits as #, names in the query, the anchor."""
    url = F.coalesce(url, F.lit(""))
    host, path = parts(url)
    named = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    words = F.split(host, r"[.\-]")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    every = F.concat(
        named("scheme:", F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), named("host:", F.split(host, r"\.")), named("word:", words),
        named("path:", F.split(F.regexp_replace(path, r"\d+", "#"), "/")),
        named("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))),
        named("anchor:", F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))))
    held = F.filter(F.array_distinct(every), lambda x: ~x.endswith(":"))
    return F.when(F.contains(url, F.lit("://")), held).otherwise(F.array().cast("array<string>"))


def given(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule of ``rules``, a short list, as text and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest becomes the outermost test
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, items, rarest): combinations of url tokens whose pages are labelled bad with the given confidence.

    A page's label is that of the id: bad where the quality is 0 or toxic is 1.  The number of items is bounded by the
    support and does not grow with the table.
    """
    bad = F.coalesce((F.max("toxic") == 1) | (F.min("quality") == 0), F.lit(False))
    marks = labels.groupBy("doc_id").agg(bad.alias("bad"))
    known = slim(pages, "page_id", "url").join(marks, F.col("page_id") == F.col("doc_id")).select("page_id", tokens(F.col("url")).alias("items"), "bad")
    known = cut(known)
    n = known.count()
    million = 1_000_000
    sample = known.where(F.pmod(F.xxhash64("page_id"), F.lit(million)) < min(million, -(-TRAIN_URLS * million // max(1, n))))
    n = sample.count()
    support = min(1.0, max(support, LEAST_URLS / max(1, n)))
    page = F.xxhash64("page_id", "items")
    counts = sample.select(F.explode("items").alias("item"), page.alias("page")).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("page").alias("x"), F.sum(F.pmod("page", F.lit((1 << 31) - 1))).alias("y"))
    # at most 1 / support tokens for each place of a url; of tokens with the same urls the first stands for all
    alike = counts.where(F.col("n") >= support * n).groupBy("n", "x", "y").agg(F.min("item").alias("item"))
    frequent = {r["item"]: r["n"] for r in alike.collect()}
    useful = F.array(*[F.lit(x) for x in sorted(frequent)]).cast("array<string>")
    baskets = sample.select(F.concat(F.array_intersect("items", useful), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = cut(
        model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
        .select(F.array_sort("antecedent").alias("items")))
    # a rule with another rule inside it adds nothing
    a, b = found.alias("a"), found.select(F.col("items").alias("less")).alias("b")
    inside = (F.size("less") < F.size("items")) & F.array_contains("items", F.element_at("less", 1)) & (F.size(F.array_except("less", "items")) == 0)
    first = b.withColumn("first", F.element_at("less", 1))
    more = a.withColumn("first", F.explode("items")).join(first, "first").where(inside).select("items").distinct()
    rules = a.join(more, "items", "left_anti").select("items")
    order = F.create_map(*[x for k, v in frequent.items() for x in (F.lit(k), F.lit(int(v)))]) if frequent else F.create_map(F.lit(""), F.lit(0))
    rarest = F.array_min(F.transform("items", lambda x: F.struct(F.element_at(order, x).alias("n"), x.alias("item"))))["item"]
    return cut(rules.select("items", rarest.alias("rarest")))


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a mined rule fits, each with the first such rule by its items."""
    held = urls.select("url", "items")
    # ``rules`` is a written table: Spark broadcasts it only where its bytes are few
    hits = held.select("url", "items", F.explode("items").alias("token")).join(rules.withColumnRenamed("items", "needed"), F.col("token") == F.col("rarest"))
    return hits.where(F.size(F.array_except("needed", "items")) == 0).groupBy("url").agg(F.min("needed").alias("mined"))


def judge(pages: DataFrame, mined: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every row."""
    rows = slim(pages, "page_id", "url")
    host, path = parts(F.col("url"))
    cutup = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    ruled = cutup.select("*", rule.alias("rule"), verdict.alias("given"))
    # only urls without a given rule, each once, go through the index
    open_ = ruled.where(F.col("rule").isNull() & F.col("url").isNotNull()).select("url").distinct().withColumn("items", tokens(F.col("url")))
    bad = blocked(open_, mined).select(F.col("url").alias("_url"), "mined")
    joined = ruled.join(bad, F.col("rule").isNull() & (F.col("url") == F.col("_url")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def op7(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, mine(pages, labels)).select("page_id", "host", "path", "rule", "verdict")
