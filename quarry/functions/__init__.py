"""Column-level functions: all built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen."""

from quarry.functions.scalars import (  # noqa: F401
    ceil_div, lcg, normalize_channels, round_robin, stable_round, strict_bool,
    timestamp_seconds_component, trip_duration,
)
