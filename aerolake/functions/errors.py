"""What error codes mean: families by their first digits, names and hints, and error texts of rows as structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = {"E1": "log_file", "E2": "parse", "E3": "insufficient_data", "E4": "invalid_parameter", "E5": "analysis"}
#: code: (name, hint); fixed values.
CODES = {
    "E1001": ("unsafe_path", "Keep logs under an allowed folder, with a known extension and without links out of it."),
    "E1002": ("too_large", "Raise the limit, or read the log in pieces."),
    "E1003": ("not_readable", "The file is damaged or was cut while it was written; rows before the damage are kept."),
    "E1004": ("unknown_format", "No adapter recognises the file; name its platform or register an adapter."),
    "E1005": ("no_data", "The file has no message of its format."),
    "E3001": ("insufficient_imu", "Log the raw IMU."), "E3002": ("insufficient_pid", "Log the PID terms or rates."), "E3003": ("insufficient_parameters", "Record the parameters at the beginning of the log."),
    "E3004": ("insufficient_compass", "Log the magnetometer."), "E3005": ("insufficient_attitude", "Log attitudes."),
    "E4001": ("invalid_axis", "Axes are roll, pitch and yaw."), "E4010": ("unsupported_platform", "Name one of the registered platforms."),
    "E5010": ("pid_failed", "See the message."), "E5020": ("fft_failed", "See the message."), "E5030": ("magfit_failed", "A calibration needs magnetometer, attitudes and, better, a position."), "E5040": ("sysid_failed", "See the message."),
    "E5051": ("filter_failed", "See the message."), "E5060": ("hardware_failed", "See the message."), "E5070": ("quality_failed", "See the message."), "E5098": ("nothing_ran", "The tables that these modules need are missing."), "E5099": ("all_failed", "See the messages of the modules."),
}
#: What a module lacks when the table that it reads is missing; fixed values.
MISSING = {"pid": "E3002", "quality": "E3002", "sysid": "E3002", "step_response": "E3002", "model_step": "E3002", "fft": "E3001", "filter": "E3003", "hardware": "E3003", "magfit": "E3004", "coverage": "E3005"}


def explained(text: Column) -> Column:
    """An error text 'code: message' as struct (code, family, name, message, hint); null for null. A text without a code is its message."""
    pairs = lambda k: F.create_map(*(F.lit(x) for code, own in CODES.items() for x in (code, own[k])))
    code = F.nullif(F.regexp_extract(text, r"^(E[0-9]{4})", 1), F.lit(""))
    families = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    message = F.regexp_replace(text, r"^E[0-9]{4}:?\s*", "")
    return F.when(text.isNotNull(), F.struct(code.alias("code"), F.try_element_at(families, F.substring(code, 1, 2)).alias("family"), F.try_element_at(pairs(0), code).alias("name"), message.alias("message"), F.try_element_at(pairs(1), code).alias("hint")))


def with_errors(rows: DataFrame, column: str = "error") -> DataFrame:
    """``rows`` with their error text replaced by its struct."""
    return rows.withColumn(column, explained(F.col(column)))


def table(spark: SparkSession) -> DataFrame:
    """code, family, name, hint of all codes."""
    return spark.createDataFrame([(c, FAMILIES[c[:2]], *own) for c, own in CODES.items()], "code string, family string, name string, hint string")
