"""V8: which charts a profile draws, in order, from the semantic types only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, ProfileConfig


def chart_plan_rows(types: dict[str, str], config: ProfileConfig = DEFAULT) -> list[tuple]:
    """Numeric columns (first 10): histogram then box plot each; a heatmap over
    all numeric columns if there are two; bar charts for the first 5 categorical
    columns; a pair plot over the first 4 numeric columns; ``max_plots`` in all."""
    numeric = [c for c, t in types.items() if t == "numeric"]
    categorical = [c for c, t in types.items() if t == "categorical"]
    plan: list[tuple[str, str, str]] = []
    for c in numeric[:config.hist_columns]:
        plan.append(("histogram", f"Distribution of {c}", c))
        plan.append(("boxplot", f"Box Plot of {c}", c))
    if len(numeric) >= 2:
        plan.append(("heatmap", "Correlation Heatmap", ",".join(numeric)))
    for c in categorical[:config.bar_columns]:
        plan.append(("bar_chart", f"Distribution of {c}", c))
    if len(numeric) >= 2:
        plan.append(("pairplot", "Pairwise Relationships", ",".join(numeric[:config.pair_columns])))
    return [(i + 1, *row) for i, row in enumerate(plan[:config.max_plots])]


def chart_plan(df: DataFrame, config: ProfileConfig = DEFAULT, facts=None) -> DataFrame:
    """``plot_index, viz_type, title, columns_used`` (no data scan beyond S6)."""
    from ..operators.schema import SchemaFacts

    f = facts or SchemaFacts(df, config)
    rows = chart_plan_rows(f.type_map(), config)
    return df.sparkSession.createDataFrame(
        rows, "plot_index int, viz_type string, title string, columns_used string")
