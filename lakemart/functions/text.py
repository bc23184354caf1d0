"""Text expressions of the run log and its reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakemart.functions.clean import as_column, blank_if_null

# How a job id is put together, the quoting marker taken out of
# messages.
JOB_SEPARATOR = "::"
QUOTE_MARKER = "$$"


def job_id(run: str | Column, node: str | Column) -> Column:
    return F.concat(as_column(run), F.lit(JOB_SEPARATOR), as_column(node))


def run_of(job: str | Column) -> Column:
    """The run a job id belongs to; NULL for an id without a node part."""
    c = as_column(job)
    return F.when(F.contains(c, F.lit(JOB_SEPARATOR)), F.substring_index(c, JOB_SEPARATOR, 1))


def belongs_to_run(job: str | Column, run: str) -> Column:
    """Literal prefix match, so ``%`` and ``_`` in a run id have no meaning."""
    return F.startswith(as_column(job), F.lit(run + JOB_SEPARATOR))


def log_status(status: str | Column) -> Column:
    c = as_column(status)
    return (
        F.when(c.isin("error", "fail"), "FAILED")
        .when(c.isin("success", "pass"), "SUCCESS")
        .when(c == "skipped", "SKIPPED")
        .otherwise(F.upper(c))
    )


def log_message(message: str | Column) -> Column:
    return F.replace(blank_if_null(message), F.lit(QUOTE_MARKER), F.lit(""))


def escape_html(c: str | Column) -> Column:
    """The ampersand goes first, or the other escapes would be escaped again."""
    escaped = as_column(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(entity))
    return escaped


def clip(c: str | Column, length: int) -> Column:
    return F.left(as_column(c), F.lit(length))


def split_name(qualified: str | Column) -> dict[str, Column]:
    """``DATABASE.SCHEMA.NAME`` in parts; a short name leaves the schema blank."""
    parts = F.split(as_column(qualified), r"\.", -1)
    return {
        "sp_database": F.get(parts, F.lit(0)),
        "sp_schema": F.coalesce(F.get(parts, F.lit(1)), F.lit("")),
        "sp_name": F.element_at(parts, -1),
    }


def two_decimals(c: str | Column) -> Column:
    return as_column(c).cast("decimal(18,2)")
