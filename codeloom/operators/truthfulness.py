"""Do the names a documentation mentions exist?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import last_seg, owner_id
from codeloom.operators.skew import first_containing

# --- fixed values -----------------------------------------------------------
TAGGED_LIST = r"(?s)<python_list>(.*?)</python_list>"
BARE_LIST = r"(?s)\[.*?\]"
BACK_TICKED = r"`([^`]+)`"
QUOTED = r'"([^"]*)"'
STRING_LITERAL = r'"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'"
# ----------------------------------------------------------------------------


def _shape(text: Column) -> Column:
    """The list with every string literal written as Q and repeated items removed."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, STRING_LITERAL, "Q"), r"\s", ""), F.lit(",Q"), F.lit(""))


def _items(text: Column) -> Column:
    """Contents of a list of string literals; of a malformed one its double-quoted parts."""
    literals = F.regexp_extract_all(text, F.lit(f"({STRING_LITERAL})"), 1)
    clean = F.transform(literals, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    return F.when(_shape(text).isin("[]", "[Q]", "[Q,]"), clean).otherwise(
        F.regexp_extract_all(text, F.lit(QUOTED), 1))


def mention_list(response: Column | str, document: Column | str) -> Column:
    """Names mentioned: tagged list, else first bracketed list, else the document's back-ticked words.

    The response is parsed, never evaluated.  A tag around something that is no
    list at all (one string, several strings without brackets) does not count.
    """
    r = F.col(response) if isinstance(response, str) else response
    d = F.col(document) if isinstance(document, str) else document
    inner = F.regexp_extract(r, TAGGED_LIST, 1)
    tagged = F.coalesce(F.regexp_like(r, F.lit(TAGGED_LIST)), F.lit(False)) & ~_shape(inner).isin("Q", "Q,")
    bare = F.regexp_extract(r, BARE_LIST, 0)
    ticked = F.filter(F.regexp_extract_all(d, F.lit(BACK_TICKED), 1),
                      lambda w: ~w.startswith("(") & ~w.endswith(")"))
    return F.when(tagged, _items(inner)).when(bare != "", _items(bare)).otherwise(ticked)


def extract_mentions(responses: DataFrame) -> DataFrame:
    """``responses(repo_id, component_id, response, document)`` -> one row per mention."""
    return (
        responses.select("repo_id", "component_id", F.posexplode(mention_list("response", "document")).alias("pos", "mention"))
        .withColumn("check_name", last_seg("mention"))
    )


def mention_in_corpus(mentions: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (repo_id, check_name) that occur inside some component's last segment."""
    names = components.select("repo_id", last_seg("id").alias("segment"))
    return first_containing(mentions, names, ["repo_id"], "check_name", "segment").select("repo_id", "check_name")


def mention_in_local(mentions: DataFrame, texts: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (repo_id, component_id, check_name) backed by the component's own code.

    ``texts(repo_id, component_id, mode, text)``: mode ``equals`` for parameter
    names, ``attribute`` for class attributes, ``contains`` for annotations,
    defaults, raised expressions and warning arguments.  A method may also
    mention an attribute of its class.
    """
    key = ["repo_id", "component_id", "check_name"]
    wanted = mentions.select(*key).distinct()
    exact = texts.where(F.col("mode").isin("equals", "attribute")).select(
        "repo_id", "component_id", F.col("text").alias("check_name"))
    attributes = texts.where(F.col("mode") == "attribute").select(
        "repo_id", F.col("component_id").alias("_class"), F.col("text").alias("check_name")).distinct()
    methods = components.where(F.col("component_type") == "method").select(
        "repo_id", F.col("id").alias("component_id"), owner_id("id").alias("_class")).distinct()
    own = wanted.join(exact.distinct(), key, "left_semi")
    of_class = (
        wanted.join(methods, ["repo_id", "component_id"])
        .join(attributes, ["repo_id", "_class", "check_name"], "left_semi").select(*key))
    inside = first_containing(
        wanted, texts.where(F.col("mode") == "contains"), ["repo_id", "component_id"], "check_name", "text").select(*key)
    return own.unionByName(of_class).unionByName(inside).distinct()


def mention_exists(mentions: DataFrame, components: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Mentions with their ``exist`` flag."""
    found = mention_in_corpus(mentions, components).withColumn("_corpus", F.lit(True))
    out = mentions.join(found, ["repo_id", "check_name"], "left")
    flag = F.coalesce(F.col("_corpus"), F.lit(False))
    if texts is not None:
        local = mention_in_local(mentions, texts, components).withColumn("_local", F.lit(True))
        out = out.join(local, ["repo_id", "component_id", "check_name"], "left")
        flag = flag | F.coalesce(F.col("_local"), F.lit(False))
    return out.withColumn("exist", flag).select(*mentions.columns, "exist")


def truthfulness(mentions: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Mentions and existing mentions per component; components without mentions have zeros."""
    counted = mentions.groupBy("repo_id", "component_id").agg(
        F.count(F.lit(1)).alias("total_mentions"), F.count_if(F.col("exist")).alias("total_exist"))
    if components is None:
        return counted
    return components.select("repo_id", F.col("id").alias("component_id")).join(
        counted, ["repo_id", "component_id"], "left").na.fill(0, ["total_mentions", "total_exist"])


def truthfulness_summary(per_component: DataFrame) -> DataFrame:
    """Per repository; the score is null when nothing is mentioned."""
    return per_component.groupBy("repo_id").agg(
        F.sum("total_mentions").alias("total_mentions"), F.sum("total_exist").alias("total_exist"),
        F.try_divide(F.sum("total_exist").cast("double") * 100, F.sum("total_mentions").cast("double")).alias("score"))


def reuse_cached(components: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split components into (those to ask about, cached mentions still valid).

    ``cached(repo_id, component_id, pos, mention)`` from an earlier run.
    """
    key = ["repo_id", "component_id"]
    ids = components.select("repo_id", F.col("id").alias("component_id"))
    ask = ids.join(cached.select(*key).distinct(), key, "left_anti")
    kept = cached.join(ids, key, "left_semi").withColumn("check_name", last_seg("mention"))
    return ask, kept
