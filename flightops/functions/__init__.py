from flightops.functions.columns import (  # noqa: F401
    as_flag, clip, hhmm_to_minutes, one_row, ratio, round_to,
)
