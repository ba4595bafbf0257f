"""Scalar column functions (Column -> Column), all JVM-side built-ins."""

from nimbus.functions.calendar import (
    calendar_columns,
    format_day,
    format_month,
    month_label,
    season,
)
from nimbus.functions.categories import rain_category, temp_category, temp_range
from nimbus.functions.display import (
    display_text,
    finite_or_null,
    null_to_zero,
    round_display,
)

__all__ = [
    "calendar_columns",
    "display_text",
    "finite_or_null",
    "format_day",
    "format_month",
    "month_label",
    "null_to_zero",
    "rain_category",
    "round_display",
    "season",
    "temp_category",
    "temp_range",
]
