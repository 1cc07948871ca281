from evenkeel.functions.draws import normal, uniform
from evenkeel.functions.scalars import (
    clamp,
    date_parts,
    day_diff,
    fallback,
    interpolate,
    normal_cdf,
    onehot,
    onehot_to_label,
    parse_date,
    sample_category,
    softmax,
)

__all__ = [
    "clamp", "date_parts", "day_diff", "fallback", "interpolate", "normal", "normal_cdf", "onehot",
    "onehot_to_label", "parse_date", "sample_category", "softmax", "uniform",
]
