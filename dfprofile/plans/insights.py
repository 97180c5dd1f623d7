"""Insight preparation (I1) and response parsing (I2, I3) as Spark jobs.

The LLM call itself is not built (external network service); this module
prepares the bounded context it would receive and parses a table of responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference): item defaults and the fallback record.
ITEM_DEFAULTS = {"category": "general", "title": "", "description": "", "severity": "info"}
FALLBACK_SUMMARY = "Analysis completed with limited insight generation."
FALLBACK_FINDINGS = ["Statistical analysis completed successfully"]
FALLBACK_QUALITY = "Data quality metrics have been calculated."
FALLBACK_TITLE = "Analysis Complete"
FALLBACK_EMPTY_DESCRIPTION = "See detailed statistics for more information."
FALLBACK_RECOMMENDATIONS = ["Review the statistical analysis results",
                            "Examine visualizations for patterns"]
FALLBACK_DESCRIPTION_CHARS = 500

RESPONSE_SCHEMA = (
    "executive_summary string, key_findings array<string>, data_quality_assessment string, "
    "insights array<struct<category: string, title: string, description: string, "
    "severity: string, affected_columns: array<string>>>, recommendations array<string>")


def _strip(c: Column) -> Column:
    """Whitespace trim like Python's ``str.strip`` (Spark's ``trim`` only
    removes spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_insights(responses: DataFrame, column: str = "response") -> DataFrame:
    """One parsed record per response row (other columns are kept).

    Columns added: executive_summary, key_findings, data_quality_assessment,
    insights (items with defaults filled), recommendations, parsed (false when
    the fallback record was used)."""
    s0 = _strip(F.col(column))
    df = responses.withColumn("__s", s0)
    df = df.withColumn("__s", F.when(F.col("__s").startswith("```json"),
                                     F.expr("substring(__s, 8)")).otherwise(F.col("__s")))
    df = df.withColumn("__s", F.when(F.col("__s").startswith("```"),
                                     F.expr("substring(__s, 4)")).otherwise(F.col("__s")))
    df = df.withColumn("__s", _strip(F.when(F.col("__s").endswith("```"),
                                            F.expr("substring(__s, 1, length(__s) - 3)"))
                                     .otherwise(F.col("__s"))))
    opts = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
            "allowNumericLeadingZeros": "false", "allowNonNumericNumbers": "false"}
    df = df.withColumn("__p", F.from_json(F.col("__s"), RESPONSE_SCHEMA, opts))
    # A record is a whole JSON object; from_json alone also fills structs from broken text.
    ok = (F.col("__p").isNotNull() & F.col("__s").startswith("{")
          & F.try_parse_json(F.col("__s")).isNotNull())
    items = F.transform(
        F.coalesce(F.col("__p.insights"), F.array()),
        lambda it: F.struct(
            F.coalesce(it["category"], F.lit(ITEM_DEFAULTS["category"])).alias("category"),
            F.coalesce(it["title"], F.lit(ITEM_DEFAULTS["title"])).alias("title"),
            F.coalesce(it["description"], F.lit(ITEM_DEFAULTS["description"])).alias("description"),
            F.coalesce(it["severity"], F.lit(ITEM_DEFAULTS["severity"])).alias("severity"),
            F.coalesce(it["affected_columns"], F.array().cast("array<string>")).alias("affected_columns")))
    raw = F.col(column)
    fb_desc = F.when(F.coalesce(F.length(raw), F.lit(0)) > 0,
                     F.substring(raw, 1, FALLBACK_DESCRIPTION_CHARS)).otherwise(
        F.lit(FALLBACK_EMPTY_DESCRIPTION))
    fb_item = F.array(F.struct(F.lit("general").alias("category"), F.lit(FALLBACK_TITLE).alias("title"),
                               fb_desc.alias("description"), F.lit("info").alias("severity"),
                               F.array().cast("array<string>").alias("affected_columns")))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    empty = F.array().cast("array<string>")
    return df.select(
        *[c for c in responses.columns],
        F.when(ok, F.coalesce(F.col("__p.executive_summary"), F.lit(""))).otherwise(
            F.lit(FALLBACK_SUMMARY)).alias("executive_summary"),
        F.when(ok, F.coalesce(F.col("__p.key_findings"), empty)).otherwise(
            arr(FALLBACK_FINDINGS)).alias("key_findings"),
        F.when(ok, F.coalesce(F.col("__p.data_quality_assessment"), F.lit(""))).otherwise(
            F.lit(FALLBACK_QUALITY)).alias("data_quality_assessment"),
        F.when(ok, items).otherwise(fb_item).alias("insights"),
        F.when(ok, F.coalesce(F.col("__p.recommendations"), empty)).otherwise(
            arr(FALLBACK_RECOMMENDATIONS)).alias("recommendations"),
        ok.alias("parsed"))


def insight_context(report) -> DataFrame:
    """The bounded context (one row, ``context`` JSON) built from a
    ``Profile``: overview, first 10 column summaries, 10 strong pairs, the
    outliers among the first 10 outlier entries with a positive count, 10 distributions."""
    spark = report.spark
    key = F.lit(1).alias("_k")
    ov = report.summary().select(key, F.struct(F.col("row_count").alias("rows"),
                                               F.col("column_count").alias("columns"),
                                               "total_missing").alias("dataset_overview"))
    cols = report.column_summaries().where(F.col("ord") < 10)
    cs = cols.groupBy().agg(F.sort_array(F.collect_list(F.struct("ord", "name", "type", "stats")))
                            .alias("_cs")).select(key, F.transform("_cs", lambda x: x.dropFields("ord"))
                                                  .alias("column_summaries"))
    parts = [ov, cs]
    strong = report.strong_correlations()
    if strong is not None:
        st = strong.withColumn("_o", F.monotonically_increasing_id()).limit(10)
        parts.append(st.groupBy().agg(F.sort_array(F.collect_list(F.struct(
            "_o", "column1", "column2", "correlation", "strength", "direction"))).alias("_c"))
            .select(key, F.transform("_c", lambda x: x.dropFields("_o")).alias("correlations")))
    out = report.outliers()
    if out is not None:
        o = out.orderBy("ord").limit(10).where(F.col("outlier_count") > 0)  # the context's own bound
        parts.append(o.groupBy().agg(F.sort_array(F.collect_list(F.struct(
            "ord", F.col("column_name").alias("column"), F.col("outlier_count").alias("count"),
            F.col("outlier_percentage").alias("percentage")))).alias("_o"))
            .select(key, F.transform("_o", lambda x: x.dropFields("ord")).alias("outliers")))
    dist = report.distributions()
    if dist is not None:
        d = dist.orderBy("ord").limit(10)
        parts.append(d.groupBy().agg(F.sort_array(F.collect_list(F.struct(
            "ord", F.col("column_name").alias("column"), F.col("distribution_type").alias("type"),
            "is_normal"))).alias("_d"))
            .select(key, F.transform("_d", lambda x: x.dropFields("ord")).alias("distributions")))
    j = parts[0]
    for p in parts[1:]:
        j = j.join(F.broadcast(p), "_k")
    fields = [c for c in j.columns if c != "_k"]
    return j.select(F.to_json(F.struct(*fields)).alias("context"))
