"""Operators: each takes DataFrames and returns a DataFrame."""

from .compare import compare_by, having_mixed_groups, relative_difference, share_by, sum_pair_by_group
from .crosstab import crosstab_long, crosstab_wide
from .density import density_grid, density_levels, iso_proportions, joint_distribution, marginal_histogram
from .intervals import interval_join, range_bucket_from_table
from .joins import (
    FanoutError,
    enrich_detail,
    fanout_audit,
    first_row_per_key,
    join_inner,
    join_left,
    left_join_default,
    unique_side,
)
from .kernel import contours, kernel_density, mass_lines
from .mixture import (
    MixtureFit,
    fit_mixture,
    k_sweep,
    load_mixture,
    mixture_sizes,
    mixture_summary,
    save_mixture,
    standard_scale,
)
from .mixture_sweep import fit_together, sweep_summary
from .profile import row_counts, schema_differences, schema_profile, sketch_profile
from .rollup import CELLS, ROWS, Folds, fold, whole_as_long
from .sample import bernoulli_sample, hash_sample, sample_projection
from .tally import (
    conditional_sum_by_key,
    distinct_list,
    label_mask,
    late_flag,
    late_flag_from_table,
    mask_labels,
    row_pick,
    sum_by_category,
    tally_columns,
    tally_ratios,
    wide_tally,
    winner_flags,
)
from .topn import top_n

__all__ = [n for n in dir() if not n.startswith("_")]
