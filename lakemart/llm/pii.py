"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds with their patterns in the order in which spans of one start are listed.
#: Quantifiers are possessive and starts are tied to the edges of a run, so that long runs neither
#: recurse nor rescan; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The countries of each length of account number.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An account number of its country's length, so that it ends before words that follow; of a country not listed, any run of groups."""
    group = r"(?:\x20?[A-Z0-9]{4})"
    lengths = [
        rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}{group}{{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9])"
        for n, countries in IBAN_COUNTRIES.items()
    ]
    listed = " ".join(IBAN_COUNTRIES.values()).replace(" ", "|")
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}{group}{{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*lengths, other])})"


ADDED = {
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: The score of a confirmed span, and the words that raise it when near.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
CONTEXT_RAISE = 0.3
#: Characters before and after a span that are searched for context words, and the least score of a span.
CONTEXT_REACH = 40
LEAST_SCORE = 0.5

KINDS = [*BASE, *ADDED]
#: A character without which a kind can't occur, so that most texts are not searched.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}


def digits(text: Column) -> Column:
    return F.translate(text, " ().-+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: _luhn_digit(d.cast("int"), i))
    return F.aggregate(places, F.lit(0), lambda total, d: total + d) % 10 == 0


def _luhn_digit(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)


def mod97(account: Column) -> Column:
    """Whether an international account number leaves 1 when divided by 97."""
    plain = F.replace(account, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.split(match, r"\.")
        # longer than three digits only counts with leading zeros
        return F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            parts, lambda p: F.right(p, F.lit(3)).cast("int") <= 255
        )
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(match, F.lit(" "))).between(15, 34), mod97(match)).otherwise(False)
    return F.lit(True)


def proposed(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their places: array of (start, rank, end, kind, match) in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["between"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("match"))
        kept = F.when(confirmed(kind, pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("between"), matches.alias("match"))
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def with_score(text: Column, span: Column, kinds: list[str]) -> Column:
    """The span with its score: the kind's own, raised if a context word stands near."""
    before = F.substr(text, F.greatest(span["start"] - CONTEXT_REACH, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT_REACH)))
    after = F.substr(text, span["end"] + 1, F.lit(CONTEXT_REACH))
    near = F.lower(F.concat(before, F.lit("\n"), after))
    score, raised = F.lit(None).cast("double"), F.lit(False)
    for kind in kinds:
        score = F.when(span["kind"] == kind, F.lit(SCORE[kind])).otherwise(score)
        raised = F.when(span["kind"] == kind, near.rlike(CONTEXT[kind])).otherwise(raised)
    total = F.least(F.lit(1.0), score + F.when(raised, CONTEXT_RAISE).otherwise(0.0))
    return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), span["kind"].alias("kind"), span["match"].alias("match"), F.round(total, 2).alias("score"))


def find_personal_data(docs: DataFrame, text_column: str = "text", spans_column: str = "pii") -> DataFrame:
    """The rows with one more column: array of (start, rank, end, kind, match, score), by start, then kind.

    Base kinds (email, ip, card, phone) are all leftmost non-overlapping matches of their
    pattern that pass their check. Added kinds (iban by mod 97, ssn) must also reach the
    least score, to which near context words add. A null text has an empty array; spans
    of different kinds may overlap. Rows are handled one by one: repeats, null ids and
    other columns pass through.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>")
    found = []
    for kind, pattern in {**BASE, **ADDED}.items():
        spans = proposed(text, kind, pattern)
        if NEEDED[kind]:
            possible = F.contains(text, F.lit(NEEDED[kind]))
        else:
            possible = text.rlike(r"[0-9][\x20-]?[0-9]")
        if kind == "ip":
            possible = text.rlike(r"[0-9]\.[0-9]")
        elif kind == "iban":
            possible = text.rlike(r"[A-Z]{2}[0-9]{2}")
        elif kind == "ssn":
            possible = text.rlike(r"[0-9]{3}-[0-9]{2}-")
        found.append(F.when(possible, spans).otherwise(empty))
    raw = docs.withColumn(spans_column, F.array_sort(F.concat(*found)))
    spans = F.transform(F.col(spans_column), lambda s: with_score(text, s, KINDS))
    spans = F.filter(spans, lambda s: s["kind"].isin(*BASE) | (s["score"] >= LEAST_SCORE))
    return raw.withColumn(spans_column, F.when(F.size(spans_column) > 0, spans).otherwise(F.array()))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def personal_data_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, a count for each base kind, the hash of the base spans, all spans and their scores."""
    found = find_personal_data(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        F.col("id").alias(id_column),
        *counts,
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
