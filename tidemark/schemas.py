"""Column contracts of the feeds and of the serving tables (fixed values)."""

from __future__ import annotations

MAG_COLS = ["bz_gsm", "bx_gsm", "by_gsm", "bt"]
PLASMA_COLS = ["proton_speed", "proton_temperature", "proton_density"]

# The feeds' names for served columns, and the step of the minute grid.
MAG_NAMES = {"bz_gsm": "bz", "bx_gsm": "bx", "by_gsm": "by"}
PLASMA_NAMES = {"proton_speed": "speed", "proton_temperature": "temperature", "proton_density": "density"}
STEP = "1 minute"

REQUIRED = {
    "mag": ["time_tag", "active", "source", *MAG_COLS],
    "plasma": ["time_tag", "active", "source", *PLASMA_COLS],
    "dst": ["time_tag", "dst"],
    "kp": ["time_tag", "Kp"],
    "ssn": ["Obsdate", "swpc_ssn"],
    "smoothed_ssn": ["time-tag", "predicted_ssn"],
}

RAW_KEYS = {
    "mag": ["time_tag", "source"],
    "plasma": ["time_tag", "source"],
    "dst": ["time_tag"],
    "kp": ["time_tag"],
    "ssn": ["Obsdate"],
    "smoothed_ssn": ["time-tag"],
}
MONTH_PARTITIONED = {"mag", "plasma", "dst", "kp"}

SERVING = {
    "solar": ["density", "speed", "temperature", "bz", "bx", "by", "bt", "pressure"],
    "dst": ["dst"],
    "dst_predictions": ["dst_predictions"],
    "kp": ["Kp"],
    "ssn": ["swpc_ssn"],
}

FEATURES = ["speed", "temperature", "density", "bz", "bx", "by", "pressure", "predicted_ssn"]
