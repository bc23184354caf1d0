"""Quality rules whose cutoffs follow the data: fences from mergeable quantile sketches per language and source.

DataFrame functions only. A text becomes a few whole numbers, the numbers of a group
become a sketch, the sketch becomes fences, and rows are joined with the fences of
their group. A sketch is a log-linear histogram: values below 64 keep a bucket each,
above that every doubling has 32 buckets, so a quantile is exact to 1/32 of its value.
Buckets are counted, so sketches merge by adding, in any order, with one result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import stored

BLANK = r"[\x20\x09-\x0D]"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
SUB_BUCKETS = 32
#: Groups of fewer rows take the fences of their language, and small languages those of all rows.
LEAST_ROWS = 100
REACH = 3

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A measure (whole numbers, 0 or more) in SQL over the statistics, fenced above and, with ``low``, below.

    ``spread`` is the least quartile distance, so that a group whose rows are nearly all
    alike does not lose every row that differs a little.
    """

    name: str
    measure: str
    spread: int
    low: bool = False


#: Thousandths of a character, word or line.
RULES = (
    Rule("word_length", "1000 * word_chars / n_words", 500, low=True),
    Rule("symbols", "1000 * n_symbols / word_chars", 10),
    Rule("capitals", "1000 * n_capitals / word_chars", 20),
    Rule("repeated_lines", "1000 * n_dup_lines / n_lines", 100),
    Rule("repeated_words", "1000 * n_repeat_words / n_words", 70),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, "")).cast("long")


def _repeated(words: Column, window: int) -> Column:
    """Words covered by windows that come twice or more; windows are told apart by 64-bit hashes."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == 0, window).otherwise(F.least(F.lit(window), p - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def twice(ordered: Column) -> Column:
        def beside(entry: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1)["k"], F.get(ordered, i + 1)["k"]
            return before.eqNullSafe(entry["k"]) | after.eqNullSafe(entry["k"])

        return _let(F.sort_array(F.transform(F.filter(ordered, beside), lambda entry: entry["i"])), covered)

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        keys = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return F.when(F.size(hashes) >= window, keys).otherwise(F.array().cast("array<bigint>"))

    def counted(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(_let(ordered, twice))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted)


def text_statistics(text: Column, window: int = WINDOW) -> Column:
    """A struct of ``STATISTICS`` (longs) of a whole text; a null text counts as empty.

    ``n_lines`` are the lines with a word, ``n_dup_lines`` those equal to an earlier one.
    """
    whole = F.coalesce(text, F.lit(""))
    length = F.char_length(whole).cast("long")
    words = F.regexp_extract_all(whole, F.lit(rf"[^{BLANK[1:]}+"), F.lit(0))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.char_length(F.translate(line, BLANK_CHARACTERS, "")) > 0)
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w, window).alias("n_repeat_words")))
    by_lines = _let(
        lines,
        lambda l: F.struct(
            F.size(l).cast("long").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines")
        ),
    )
    both = F.array(F.struct(by_words.alias("w"), by_lines.alias("l")))
    return F.get(
        F.transform(
            both,
            lambda s: F.struct(
                s["w"]["n_words"].alias("n_words"),
                _without(whole, BLANK_CHARACTERS).alias("word_chars"),
                (length - _without(whole, SYMBOLS)).alias("n_symbols"),
                s["l"]["n_dup_lines"].alias("n_dup_lines"),
                s["w"]["n_repeat_words"].alias("n_repeat_words"),
                s["l"]["n_lines"].alias("n_lines"),
                (length - _without(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
            ),
        ),
        F.lit(0),
    )


def base_failed(stats: str = "stats") -> Column:
    """Too short, or too many of its words repeat."""
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def _measures(rules: tuple[Rule, ...], stats: str) -> list[Column]:
    """Whole numbers; 0 where a text has no word."""
    found = []
    for rule in rules:
        above, _, below = rule.measure.partition(" / ")
        for name in STATISTICS:
            above, below = (part.replace(f" {name}", f" {stats}.{name}") for part in (f" {above}", f" {below}"))
        found.append(F.expr(f"CASE WHEN{below} = 0 THEN 0L ELSE{above} div{below} END"))
    return found


def bucket(value: Column) -> Column:
    """The log-linear bucket of a whole number, 0 or more."""
    return _let(
        F.greatest(F.length(F.bin(value)) - 6, F.lit(0)),
        lambda s: F.call_function("shiftright", value, s) + SUB_BUCKETS * s,
    ).cast("int")


def least_in_bucket(number: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.floor(number / SUB_BUCKETS).cast("int") - 1
    return F.when(number < 2 * SUB_BUCKETS, number.cast("long")).otherwise(
        F.call_function("shiftleft", (number - SUB_BUCKETS * shift).cast("long"), shift)
    )


def quantile_sketches(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``lang``, ``source``, ``rule``, ``bucket``, ``n`` over rows (``lang``, ``source``, ``stats``).

    Counted in each task before the shuffle, so a hot source sends a row per bucket and
    task. Rows that fail the base rules don't count.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("rule"), bucket(m).alias("bucket")) for i, m in enumerate(_measures(rules, "stats"))])
    return (
        rows.where(~base_failed())
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "rule", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _levels() -> Column:
    """A group's own place, its language's and that of all rows."""
    none = F.lit(None).cast("string")
    return F.inline(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang").alias("in_lang"), F.col("source").alias("in_source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("in_lang"), none.alias("in_source")),
            F.struct(F.lit(2).alias("level"), none.alias("in_lang"), none.alias("in_source")),
        )
    )


def fences(
    sketches: DataFrame, groups: DataFrame, rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS, reach: int = REACH
) -> DataFrame:
    """``lang``, ``source``, ``fences``: (low, high) per rule for each of the ``groups``.

    A fence lies ``reach`` quartile distances beyond the quartiles of the group's merged
    sketch: its own, or with fewer than ``least_rows`` rows that of its language, or of all rows.
    Without any row there is no fence. One row per group, whatever the rows.
    """
    from pyspark.sql import Window

    place = ["level", "in_lang", "in_source", "rule"]
    merged = sketches.select(_levels(), "rule", "bucket", "n").groupBy(*place, "bucket").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*place).orderBy("bucket")
    summed = merged.withColumn("upto", F.sum("n").over(along)).withColumn("rows", F.sum("n").over(Window.partitionBy(*place)))
    quartile = [F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bucket"))).alias(f"b{k}") for k in (1, 3)]
    q1, q3 = least_in_bucket(F.col("b1")), least_in_bucket(F.col("b3"))
    spread = F.greatest(q3 - q1, F.element_at(F.lit([r.spread for r in rules]), F.col("rule") + 1).cast("long"))
    low = F.when(F.element_at(F.lit([r.low for r in rules]), F.col("rule") + 1), q1 - reach * spread)
    cut = (
        summed.groupBy(*place, "rows")
        .agg(*quartile)
        .select(*place, "rows", F.struct("rule", low.alias("low"), (q3 + reach * spread).alias("high")).alias("fence"))
        .groupBy("level", "in_lang", "in_source", "rows")
        .agg(F.sort_array(F.collect_list("fence")).alias("fences"))  # one for each rule
    )
    wanted = groups.select("lang", "source").distinct().select("lang", "source", _levels())
    same = F.lit(True)
    for name in ("level", "in_lang", "in_source"):
        same = same & F.col(f"w.{name}").eqNullSafe(F.col(f"c.{name}"))
    found = wanted.alias("w").join(cut.alias("c"), same).where(f"c.rows >= {int(least_rows)} OR c.level = 2")
    return found.groupBy("w.lang", "w.source").agg(F.min_by("c.fences", "c.level").alias("fences"))


def _judged(rows: DataFrame, cut: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept``. Rows meet the one row of their group."""
    same = F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source"))
    joined = rows.alias("r").join(cut.alias("f"), same, "left").select("r.*", "f.fences")
    checks = []
    for i, (rule, measure) in enumerate(zip(rules, _measures(rules, "stats"))):
        fence = F.get("fences", F.lit(i))
        beyond = (measure > fence["high"]) | F.coalesce(measure < fence["low"], F.lit(False))
        checks.append(F.when(beyond, F.lit(rule.name)))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.array_compact(F.array(*checks)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("fences")
    )


def _measured(docs: DataFrame, text_column: str, lang_column: str, source_column: str, row: Column) -> DataFrame:
    return docs.select(
        row.alias("row"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"),
        text_statistics(F.col(text_column)).alias("stats"),
    )


def rule_report(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least_rows: int = LEAST_ROWS,
    reach: int = REACH,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """Per row: id, the statistics, ``base_failed``, ``failed_rules`` (names of fences passed), ``kept``.

    Null texts count as empty and fail the base rules. Null languages and sources are
    groups of their own. Repeated rows and null ids are judged and counted like any
    other row; other columns are not read. An empty table gives no rows.

    The statistics are written once, without texts; fences come from them, one row per
    group, and Spark broadcasts that table only if its files are small.
    """
    rows = stored(_measured(docs, text_column, lang_column, source_column, F.col(id_column)), "text-statistics")
    cut = stored(fences(quantile_sketches(rows, rules), rows, rules, least_rows, reach), "fences")
    judged = _judged(rows, cut, rules)
    return judged.select(F.col("row").alias(id_column), "stats.*", "base_failed", "failed_rules", "kept")


def rows_within_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least_rows: int = LEAST_ROWS,
    reach: int = REACH,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that ``rule_report`` keeps, with all their columns, whatever these are called.

    Texts are measured twice, once for the fences and once where they are filtered, so
    that no text is shuffled or written. Nulls, repeats and empty tables as there.
    """
    rows = stored(_measured(docs, text_column, lang_column, source_column, F.lit(0)), "text-statistics")
    cut = stored(fences(quantile_sketches(rows, rules), rows, rules, least_rows, reach), "fences")
    whole = _measured(docs, text_column, lang_column, source_column, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return _judged(whole, cut, rules).where("kept").select("row.*")


def report_sql(rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS, reach: int = REACH) -> str:
    """DuckDB SQL for ``rule_report`` over ``documents``, without ``failed_rules``."""
    word = f"[^{BLANK[1:]}+"
    split = [rule.measure.split(" / ") for rule in rules]
    measures = [f"(CASE WHEN {b} = 0 THEN 0 ELSE {a} // {b} END)" for a, b in split]
    listed = ", ".join(f"{{'rule': {i}, 'x': {m}}}" for i, m in enumerate(measures))
    shift = "greatest(length(bin(x)) - 6, 0)"

    def value(b: str) -> str:
        return f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1) END)"

    spread = f"greatest(q3 - q1, [{', '.join(str(r.spread) for r in rules)}][rule + 1])"
    low = f"CASE WHEN [{', '.join(str(r.low).lower() for r in rules)}][rule + 1] THEN q1 - {reach} * {spread} END"
    beyond = " OR ".join(
        f"coalesce({m} > f[{i + 1}].high, false) OR coalesce({m} < f[{i + 1}].low, false)" for i, m in enumerate(measures)
    )
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{word}') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls
           FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
            FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
steps AS (SELECT r, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW})) AS step FROM twice),
repeated AS (SELECT r, sum(step)::BIGINT AS n FROM steps GROUP BY r),
stats AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
                 length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                 len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
          FROM d LEFT JOIN repeated ON d.r = repeated.r),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM stats),
measured AS (SELECT lang, source, unnest([{listed}]) AS m FROM judged WHERE NOT base_failed),
placed AS (SELECT lang, source, rule, ((x >> {shift}) + 32 * {shift})::BIGINT AS b FROM (SELECT lang, source, m.rule, m.x FROM measured)),
levels AS (SELECT 0 AS level, lang, source, rule, b FROM placed UNION ALL SELECT 1, lang, NULL, rule, b FROM placed
           UNION ALL SELECT 2, NULL, NULL, rule, b FROM placed),
sketch AS (SELECT level, lang, source, rule, b, count(*) AS n FROM levels GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY b) AS upto,
                  sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM sketch),
quartiles AS (SELECT level, lang, source, rule, total, min(b) FILTER (4 * upto >= total) AS b1, min(b) FILTER (4 * upto >= 3 * total) AS b3
              FROM summed GROUP BY ALL),
valued AS (SELECT level, lang, source, rule, total, {value('b1')} AS q1, {value('b3')} AS q3 FROM quartiles),
cut AS (SELECT level, lang, source, total, list({{'low': {low}, 'high': q3 + {reach} * {spread}}} ORDER BY rule) AS f
        FROM valued GROUP BY level, lang, source, total),
chosen AS (SELECT j.r, arg_min(f, level) AS f FROM judged j
           JOIN cut c ON (c.level = 2 OR (j.lang IS NOT DISTINCT FROM c.lang AND (c.level = 1 OR j.source IS NOT DISTINCT FROM c.source)))
           WHERE c.total >= {least_rows} OR c.level = 2 GROUP BY j.r)
SELECT {names}, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
FROM judged LEFT JOIN chosen USING (r)
"""
