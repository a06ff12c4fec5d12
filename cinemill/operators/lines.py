"""Operators on the lines of tool output: progress removed inside a JSON column, warnings with their line
numbers, and how many lines are errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.operators.probe import text

BREAKS = "\r\n|\r|\n"
PROGRESS = r"^\s*frame=\s*[0-9]+\s+fps="
# Parts of lines that hardware decoders print although nothing is wrong with the file.
HARDWARE_NOISE = (
    "Failed setup for format", "hwaccel initialisation returned error", "No device available for decoder", "Cannot load nvcuvid", "Cannot load libcuda", "Cannot allocate memory in static TLS block",
    "Could not dynamically load CUDA", "vaapi_hwaccel: Failed to initialise", "qsv_hwaccel: Failed to initialise", "Hardware does not support accelerated",
)


def without_progress(output: Column) -> Column:
    """Output without progress lines; where there were some, lines end in \n and empty ones at both ends go."""
    lines = F.split(output, BREAKS, -1)
    # no line holds a line end, so trimming \n takes the empty lines at both ends
    kept = F.btrim(F.array_join(F.filter(lines, lambda x: ~x.rlike(PROGRESS)), "\n"), F.lit("\n"))
    return F.when(F.exists(lines, lambda x: x.rlike(PROGRESS)), kept).otherwise(output)


def _named(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def progress_removed(result: Column) -> Column:
    """A JSON text with detail.stderr_tail rid of progress lines, its keys sorted; what has none, or is no such object, stays as it is."""

    def put(v: Column, new: Column) -> Column:
        whole = F.try_variant_get(v, "$", "map<string,variant>")
        detail = F.transform_values(F.try_variant_get(v, "$.detail", "map<string,variant>"), lambda k, x: F.when(k == "stderr_tail", new.cast("variant")).otherwise(x))
        return F.to_json(F.transform_values(whole, lambda k, x: F.when(k == "detail", F.parse_json(F.to_json(detail))).otherwise(x)))

    def cleaned(r: Column, v: Column) -> Column:
        old = text(v, "$.detail.stderr_tail")
        return _named(F.struct(old.alias("old"), without_progress(old).alias("new")), lambda t: F.when(t["new"] != t["old"], put(v, t["new"])).otherwise(r))

    return _named(result, lambda r: _named(F.try_parse_json(r), lambda v: cleaned(r, v)))


def numbered(logs: DataFrame, log: str = "log", content: str = "text") -> DataFrame:
    """(log, line, text): every line with its number from 1; the empty rest after a last line end is none."""
    lines = F.split(F.col(content), BREAKS, -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    out = logs.select(F.col(log).alias("log"), F.posexplode(lines).alias("_at", "text"))
    return out.select("log", (F.col("_at") + 1).cast("long").alias("line"), "text")


def warnings(logs: DataFrame, log: str = "log", content: str = "text") -> DataFrame:
    """The numbered lines that begin as a warning does."""
    return numbered(logs, log, content).where(F.startswith("text", F.lit("warning:")))


def noise(line: Column) -> Column:
    found = F.trim(line) == ""
    for part in HARDWARE_NOISE:
        found = found | F.contains(line, F.lit(part))
    return found


def error_lines(output: Column, hardware: Column) -> Column:
    """Lines of a full decode's output that are errors: all that are not blank and, where hardware decoded, no noise of it."""
    return F.size(F.filter(F.split(F.coalesce(output, F.lit("")), "\r?\n"), lambda x: ~x.rlike(r"^\s*$") & ~(hardware & noise(x)))).cast("long")


def quick_check(ok: Column, output: Column) -> Column:
    """struct<outcome, errors, warnings> of a quick check from its success and its output."""
    lines = F.split(output, "\r?\n", -1)
    n = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    outcome = F.when(~ok, "error").when(F.coalesce(output, F.lit("")).rlike(r"^\s*$"), "ok").otherwise("warning")
    return F.struct(outcome.alias("outcome"), F.when(~ok, 1).otherwise(0).alias("errors"), F.when(outcome == "warning", n).otherwise(0).alias("warnings"))
