"""Reports of a run as ordered lines. Nothing is mailed: the rows are the result.

Line 0 is the subject, heading lines come from the run's summary, and every node
listed has a line of its own. The shape is the same for a run of any size, no
text grows with a run, and nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.clean import blank_if_null, zero_if_null
from lakemart.functions.text import clip, escape_html, run_of, two_decimals
from lakemart.operators.ordered import OrderedRows, ordered_rows, with_counts, with_position
from lakemart.operators.runlog import run_summary

# What stands in for a missing field.
NO_NAME = "?"
NO_MESSAGE = "No error message recorded."
NO_VALUE = "n/a"
#: What entries show of a node besides its message.
CELLS = ["sp_name", "sp_database", "sp_schema", "status", "rows_processed", "duration_seconds"]


def _target() -> Column:
    return F.concat(blank_if_null("sp_database"), F.lit("."), blank_if_null("sp_schema"))


def _seconds(c: str) -> Column:
    return two_decimals(zero_if_null(F.col(c))).cast("string")


def _success_entry() -> Column:
    cells = [
        F.coalesce("sp_name", F.lit(NO_NAME)),
        _target(),
        blank_if_null("status"),
        zero_if_null(F.col("rows_processed")).cast("string"),
        _seconds("duration_seconds"),
    ]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _failure_entry(message_length: int | None = None) -> Column:
    message = F.coalesce("message", F.lit(NO_MESSAGE))
    if message_length is None:
        message = escape_html(message)
    else:  # escaping shortens nothing, so what is behind that length need not be escaped
        message = clip(escape_html(clip(message, message_length)), message_length)
    return F.concat(
        F.lit("<div><b>"), F.coalesce("sp_name", F.lit(NO_NAME)), F.lit("</b> "), _target(), F.lit(" "),
        _seconds("duration_seconds"), F.lit("s<pre>"), message, F.lit("</pre></div>"),
    )


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"<p>{label}: "), value, F.lit("</p>"))


def _started() -> Column:
    return F.coalesce(F.date_format("started", "yyyy-MM-dd HH:mm:ss"), F.lit(NO_VALUE))


def _success_heading() -> list[Column]:
    return [
        F.concat(F.lit("Run succeeded ("), F.col("total").cast("string"), F.lit(" models)")),
        F.lit("<h2>Run succeeded</h2>"),
        _labelled("Run ID", F.col("run_id")),
        _labelled("Started", _started()),
        _labelled("Models", F.col("total").cast("string")),
        _labelled("Total rows", F.col("rows_processed").cast("string")),
        _labelled("Total seconds", two_decimals("duration_seconds").cast("string")),
        F.lit("<table><tr><th>Model</th><th>Target</th><th>Status</th><th>Rows</th><th>Seconds</th></tr>"),
    ]


def _failure_heading() -> list[Column]:
    share = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" models"))
    return [
        F.concat(F.lit("Run failed ("), share, F.lit(")")),
        F.lit("<h2>Run failed</h2>"),
        _labelled("Run ID", F.col("run_id")),
        _labelled("Started", _started()),
        _labelled("Failed", share),
    ]


def _numbered(lines: list[Column], *last: tuple[Column, Column]) -> Column:
    """An array of (line, text): ``lines`` from 0, then lines whose number is given."""
    pairs = [*((F.lit(n), text) for n, text in enumerate(lines)), *last]
    return F.array(*[F.struct(n.cast("long").alias("line"), text.alias("text")) for n, text in pairs])


def _success_frame() -> Column:
    heading = _success_heading()
    return _numbered(heading, (F.col("total") + len(heading), F.lit("</table>")))


def _failure_frame() -> Column:
    return _numbered(_failure_heading())


def _rows_of_runs(log: DataFrame) -> DataFrame:
    return log.withColumn("run_id", run_of("job_id")).where("run_id IS NOT NULL")


def _ordered(log: DataFrame, listed: DataFrame, slices: int | None) -> OrderedRows:
    """Nodes (run_id, job_id, start_time, others) in order of start, then job; the log itself is sampled for the cuts."""
    return ordered_rows(listed, "run_id", "start_time", ("job_id",), slices, probe=log.select("run_id", "start_time", "job_id"))


def _nodes(log: DataFrame, skipped: int, text: Column, slices: int | None) -> DataFrame:
    """The log's rows as lines after the ``skipped`` heading lines."""
    listed = log.select("run_id", "job_id", "start_time", text.alias("text"))
    numbered = with_position(_ordered(log, listed, slices), "_position").result()
    return numbered.select("run_id", (F.col("_position") - 1 + skipped).alias("line"), "text")


def success_report(log: DataFrame, slices: int | None = None) -> DataFrame:
    """run_id, line, text: one line per node. A run without rows has no report."""
    rows = _rows_of_runs(log)
    nodes = _nodes(rows, len(_success_heading()), _success_entry(), slices)
    frame = run_summary(log).select("run_id", F.inline(_success_frame()))
    return frame.unionByName(nodes)


def failure_report(log: DataFrame, message_length: int | None = None, slices: int | None = None) -> DataFrame:
    """run_id, line, text: one line per failed node. No failure, no report.

    Messages are whole unless a ``message_length`` is given; it counts the
    characters after escaping.
    """
    rows = _rows_of_runs(log).where("status = 'FAILED'")
    nodes = _nodes(rows, len(_failure_heading()), _failure_entry(message_length), slices)
    frame = run_summary(log).where("failed > 0").select("run_id", F.inline(_failure_frame()))
    return frame.unionByName(nodes)


def run_report(log: DataFrame, slices: int | None = None) -> DataFrame:
    """One report per run: the failure report where a node failed, else the success report.

    run_id, line, text and the kind of ``report``.
    """
    bad = F.col("failed") > 0
    kind = F.when(bad, "FAILURE").otherwise("SUCCESS").alias("report")
    runs = run_summary(log)
    rows = _rows_of_runs(log)
    # a failed node stands in its run's failure report, any other in a success report or in none
    failed = F.col("status").eqNullSafe("FAILED")
    message = F.when(failed, F.col("message")).alias("message")  # of others none is shown
    listed = rows.select("run_id", "job_id", "start_time", *CELLS, message, failed.alias("bad"))
    counted = with_counts(_ordered(rows, listed, slices), failed=F.col("bad"), other=~F.col("bad")).result()
    node_kind = F.when(F.col("bad"), "FAILURE").otherwise("SUCCESS").alias("report")
    above = F.when(F.col("bad"), F.col("failed.upto") + len(_failure_heading())).otherwise(F.col("other.upto") + len(_success_heading()))
    entry = F.when(F.col("bad"), _failure_entry()).otherwise(_success_entry())
    shown = counted.where(F.col("bad") | (F.col("failed.total") == 0))
    nodes = shown.select("run_id", (above - 1).alias("line"), entry.alias("text"), node_kind)
    frame = runs.select("run_id", kind, F.inline(F.when(bad, _failure_frame()).otherwise(_success_frame())))
    return frame.unionByName(nodes)
