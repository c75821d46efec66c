"""Column functions."""

from .extremes import (
    date_of_max,
    date_of_max_count,
    date_of_min,
    date_of_min_count,
    ordered_bits,
)
from .measures import (
    display_date,
    display_number,
    money_flow_multiplier,
    percent_change,
    rsi_zone,
    sharpe_band,
    sign_class,
    stability_class,
    volume_signal,
)
from .periods import (
    Period,
    add_period,
    label_of_key,
    lookback_text,
    parse_date,
    period_key,
    period_label,
)

__all__ = [
    "Period",
    "add_period",
    "date_of_max",
    "date_of_max_count",
    "date_of_min",
    "date_of_min_count",
    "display_date",
    "display_number",
    "label_of_key",
    "lookback_text",
    "money_flow_multiplier",
    "ordered_bits",
    "parse_date",
    "percent_change",
    "period_key",
    "period_label",
    "rsi_zone",
    "sharpe_band",
    "sign_class",
    "stability_class",
    "volume_signal",
]
