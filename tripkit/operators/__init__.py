"""Operators: DataFrame in, DataFrame out, lazy unless they say otherwise."""

from tripkit.operators.encoding import CategoryCodes, by_size, category_codes, join_dictionary, learn_index, with_index
from tripkit.operators.explore import (
    avg_by_hour,
    avg_by_key,
    category_index,
    count_by_hour,
    demand_table,
    demand_table_filled,
    distribution,
    peak_avg_hour,
    peak_hour,
    revenue_vs_volume,
    topk_by_count,
    topk_by_sum,
    weekend_split,
)
from tripkit.operators.features import (
    FEATURES,
    with_day_name,
    with_duration,
    with_features,
    with_hour,
    with_ratio,
    with_speed,
    with_weekend,
)
from tripkit.operators.layout import (
    cached,
    checkpointed,
    ensure_checkpoint_dir,
    held,
    partition_count,
    partition_profile,
    relayout,
    release_with,
    with_position,
)
from tripkit.operators.models import (
    DEMAND_FEATURES,
    FARE_FEATURES,
    BoostSpec,
    DemandModel,
    ForestSpec,
    compare_models,
    feature_importances,
    fit_demand,
    fit_forest,
    fit_gbt,
    hash_split,
    index_stage,
    random_split,
    regression_metrics,
    residual_anomalies,
    score,
    split_by_id,
    training_frame,
    vector_stage,
)
from tripkit.operators.moments import (
    avg_by_key_state,
    merge_moments,
    moments,
    month_moments,
    month_of,
    outlier_groups_state,
    summarize_state,
)
from tripkit.operators.panel import cell_means, demand_panel, time_split
from tripkit.operators.parity import assert_same, differences, parity
from tripkit.operators.profile import mean_std, profile, range_stats, row_count, sample_rows, summarize
from tripkit.operators.quality import (
    Rule,
    clean,
    drop_nulls,
    filter_duration,
    quality_report,
    removal_report,
    trip_rules,
)
from tripkit.operators.skew import hot_keys, relayout_skewed
from tripkit.operators.split import exact_split
from tripkit.operators.sqlapi import (
    having_avg_gt,
    outlier_groups,
    sql_avg_by_hour,
    sql_avgs_by_key,
    sql_count_by_hour,
    sql_topk_by_count,
    sql_topk_by_sum,
)
from tripkit.operators.trees import predict_from_table, tree_table

__all__ = [name for name in dir() if not name.startswith("_")]
