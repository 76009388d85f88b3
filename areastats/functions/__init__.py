"""Column expressions: every function takes columns and returns a column."""
from areastats.functions.columns import (  # noqa: F401
    as_column,
    code_prefix_fill,
    correlation_p_value,
    decimal_comma,
    differs,
    gap_percent,
    in_range,
    incomplete_beta,
    log_cell,
    log_gamma,
    map_values,
    mercator_x,
    mercator_y,
    not_in,
    pad_code,
    percent,
    replace_text,
    round_to,
    row_sum,
    to_number,
)
