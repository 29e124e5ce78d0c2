"""Column expressions: time parts, rounding, unit and severity scales."""
