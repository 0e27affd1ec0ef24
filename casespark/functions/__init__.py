from casespark.functions.columns import (  # noqa: F401
    md5_draw, render_list, ordered_by, safe_ratio, numeric_text, floor_bucket,
    null_safe_ne, round6, set_size,
)
