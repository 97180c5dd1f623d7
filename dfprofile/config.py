"""Profile configuration: one frozen dataclass replaces the env-driven settings."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ProfileConfig:
    # Fixed values that must equal the reference's defaults for identical results.
    outlier_method: str = "iqr"
    outlier_threshold: float = 1.5
    zscore_threshold: float = 3.0
    correlation_threshold: float = 0.7
    correlation_method: str = "pearson"
    missing_value_threshold: float = 0.3
    numeric_precision: int = 4
    max_rows: int | None = None  # D13: applied whenever it is set
    max_columns: int = 1000
    min_rows: int = 10
    top_categories: int = 20
    bar_chart_top_n: int = 15
    max_outlier_keys: int = 100
    sweep_columns: int | None = None  # a named limit; None sweeps every numeric column
    max_plots: int = 20
    hist_columns: int = 10
    bar_columns: int = 5
    pair_columns: int = 4
    pair_sample: int = 1000
    sample_values: int = 5
    seed: int = 42
    normality_alpha: float = 0.05
    shapiro_max_n: int = 5000
    min_distribution_n: int = 20
    skew_symmetric_limit: float = 0.5
    categorical_ratio: float = 0.5
    text_mean_length: float = 50.0
    kde_points: int = 100
    kde_min_n: int = 10
    iforest_trees: int = 100
    iforest_samples: int = 256
    iforest_contamination: float = 0.1

    # Scale knobs (ours).
    rank_bucket_rows: int = 2_000_000  # target raw rows per rank bucket
    max_rank_buckets: int = 65_536
    rank_relative_error: float = 1e-4
    group_cells: int = 40_000_000  # rows x columns counted in one shuffle of a frequency table
    sorted_cells: int = 2_000_000  # rows of a frequency table a partition of the rank windows
    broadcast_row_limit: int = 200_000  # largest side we broadcast, proven by a count we know

    def with_(self, **kw) -> "ProfileConfig":
        return replace(self, **kw)


DEFAULT = ProfileConfig()
