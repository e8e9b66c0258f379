"""Token usage and cost.  ``usage(repo_id, component_id, agent, call_count, input_tokens, output_tokens, total_tokens)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.exprs import AGENTS
from codeloom.operators.skew import lookup_join

# --- fixed values: price in USD per million tokens, rate in IDR per USD ------
PRICES = {"flash": (0.30, 2.50), "pro": (1.25, 10.00)}
AGENT_MODELS = {"reader": "flash", "writer": "flash", "verifier": "flash", "searcher": "pro"}
EXCHANGE_RATE = 16739
# lines of the report
AGENT_LINE = "| %-12s | %,15d | %,15d | %,15d | %,12d |"
COST_LINE = "| %-22s | $%,17.5f | Rp %,22.2f |"
TOTAL_COST = "GRAND TOTAL COST"
AVERAGE_LINES = ("  Average Total Tokens : %,.2f", "  Average Input Tokens : %,.2f", "  Average Output Tokens: %,.2f", "  Average Cost (IDR)   : Rp %,.2f")
COMPONENT_LINE = "%-60s | %-22s | %-22s | %-22s | %-22s | %-15s | %-15s"
# ----------------------------------------------------------------------------

COUNTERS = ["call_count", "input_tokens", "output_tokens", "total_tokens"]


def default_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, m, *PRICES[m]) for a, m in AGENT_MODELS.items()],
        "agent string, model string, input_price double, output_price double")


OTHER = "other"


def _named(usage: DataFrame) -> DataFrame:
    """Agents by their lower-case name; all that are none of the known ones (or null) count as ``other``."""
    name = F.lower(F.trim("agent"))
    return usage.withColumn("agent", F.when(name.isin(*AGENTS), name).otherwise(OTHER))


def usage_by_agent(usage: DataFrame) -> DataFrame:
    """Sums per agent; a known agent without calls has zeros.  ``other`` is there where such calls are."""
    every = usage.select("repo_id").distinct().select(
        "repo_id", F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent"))
    sums = _named(usage).groupBy("repo_id", "agent").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return every.join(sums, ["repo_id", "agent"], "full").na.fill(0, COUNTERS)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Per agent, with the repository's total as agent ``total``."""
    rolled = usage_by_agent(usage).rollup("repo_id", "agent").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.grouping_id().alias("_g"))
    return rolled.where("_g < 2").withColumn("agent", F.when(F.col("_g") == 1, "total").otherwise(F.col("agent"))).drop("_g")


def usage_by_component(usage: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row per component with a ``calls x (tokens)`` cell per known agent; the totals count all agents."""
    key = ["repo_id", "component_id"]
    agents = [*AGENTS, OTHER]
    wide = _named(usage).groupBy(*key).pivot("agent", agents).agg(
        F.sum("call_count").alias("calls"), F.sum("total_tokens").alias("tokens"))
    if components is not None:
        wide = components.select("repo_id", F.col("id").alias("component_id")).join(wide, key, "left")

    def n(agent: str, what: str) -> Column:
        return F.coalesce(F.col(f"{agent}_{what}"), F.lit(0))

    def total(what: str) -> Column:
        out = n(agents[0], what)
        for a in agents[1:]:
            out = out + n(a, what)
        return out

    return wide.select(
        *key, *[F.format_string("%d x (%d)", n(a, "calls"), n(a, "tokens")).alias(a) for a in AGENTS],
        total("calls").alias("total_call"), total("tokens").alias("total_token"))


def usage_cost(usage: DataFrame, prices: DataFrame, rate: float = EXCHANGE_RATE) -> DataFrame:
    """Cost per agent by its model's prices, in both currencies, with a ``total`` row.  Agents without a price cost 0."""
    priced = lookup_join(usage_by_agent(usage), prices, ["agent"], "left")
    usd = (F.col("input_tokens") / 1_000_000) * F.col("input_price") + (
        F.col("output_tokens") / 1_000_000) * F.col("output_price")
    per_agent = priced.withColumn("cost_usd", F.coalesce(usd, F.lit(0.0)))
    rolled = per_agent.rollup("repo_id", "agent").agg(
        F.max("model").alias("model"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.grouping_id().alias("_g"))
    is_total = F.col("_g") == 1
    return rolled.where("_g < 2").select(
        "repo_id", F.when(is_total, "total").otherwise(F.col("agent")).alias("agent"),
        F.when(~is_total, F.col("model")).alias("model"), "input_tokens", "output_tokens", "cost_usd",
        (F.col("cost_usd") * rate).alias("cost_local"))


def usage_averages(usage: DataFrame, components: DataFrame, prices: DataFrame, rate: float = EXCHANGE_RATE) -> DataFrame:
    """Consumption per component of the repository (divided by 1 when it has none)."""
    totals = usage_rollup(usage).where("agent = 'total'")
    cost = usage_cost(usage, prices, rate).where("agent = 'total'").select("repo_id", "cost_local")
    sizes = components.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    joined = totals.join(cost, "repo_id").join(sizes, "repo_id", "left")
    div = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return joined.select(
        "repo_id", F.coalesce("n", F.lit(0)).alias("components"),
        (F.col("total_tokens") / div).alias("avg_total"), (F.col("input_tokens") / div).alias("avg_input"),
        (F.col("output_tokens") / div).alias("avg_output"), (F.col("cost_local") / div).alias("avg_cost"))


def usage_report(usage: DataFrame, components: DataFrame, prices: DataFrame, rate: float = EXCHANGE_RATE) -> DataFrame:
    """The report as lines: (repo_id, section, line_no, id, line), ordered by (section, line_no, id).

    Sections: 1 tokens per agent, 2 cost, 3 averages, 4 one line per component.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in AGENTS]), F.col("agent")).cast("int"), F.lit(0))
    line_no = F.when(F.col("agent") == OTHER, len(AGENTS)).when(rank == 0, len(AGENTS) + 1).otherwise(rank)
    behind = F.when(F.col("agent") == OTHER, OTHER).otherwise("")  # the line behind the last known agent's
    none = F.lit("")

    def put(df: DataFrame, section: int, no: Column, line: Column, id_: Column = none) -> DataFrame:
        return df.select("repo_id", F.lit(section).cast("long").alias("section"), no.cast("long").alias("line_no"),
                         id_.alias("id"), line.alias("line"))

    repos = usage.select("repo_id").distinct()
    heads = {
        1: F.lit(f"| {'AGENT':<12} | {'INPUT TOKENS':>15} | {'OUTPUT TOKENS':>15} | {'TOTAL TOKENS':>15} | {'CALLS':>12} |"),
        2: F.lit(f"| {'AGENT (MODEL)':<22} | {'COST (USD)':>18} | {'COST (IDR)':>25} |"),
        4: F.lit(f"{'COMPONENT ID':<60} | {'READER':<22} | {'SEARCHER':<22} | {'WRITER':<22} | {'VERIFIER':<22} | "
                 f"{'TOT CALL':<15} | {'TOT TOK':<15}"),
    }
    tokens = put(usage_rollup(usage), 1, line_no, F.format_string(
        AGENT_LINE, F.upper("agent"), "input_tokens", "output_tokens", "total_tokens", "call_count"), behind)
    name = F.when(F.col("agent") == "total", TOTAL_COST).otherwise(
        F.concat(F.initcap("agent"), F.lit(" ("), F.coalesce(F.initcap("model"), F.lit("-")), F.lit(")")))
    cost = put(usage_cost(usage, prices, rate), 2, line_no, F.format_string(
        COST_LINE, name, "cost_usd", "cost_local"), behind)
    averages = usage_averages(usage, components, prices, rate).select("repo_id", F.posexplode(F.array(
        *[F.format_string(line, value) for line, value in zip(AVERAGE_LINES, ("avg_total", "avg_input", "avg_output", "avg_cost"), strict=True)])).alias("pos", "text"))
    details = put(usage_by_component(usage, components), 4, F.lit(1), F.format_string(
        COMPONENT_LINE, "component_id", *AGENTS,
        F.col("total_call").cast("string"), F.col("total_token").cast("string")), F.col("component_id"))
    out = tokens.unionByName(cost).unionByName(put(averages, 3, F.col("pos") + 1, F.col("text"))).unionByName(details)
    for section, head in heads.items():
        out = out.unionByName(put(repos, section, F.lit(0), head))
    return out
