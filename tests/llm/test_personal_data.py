from __future__ import annotations

import hashlib
import random
import re

from lakemart.llm.pii import find_personal_data, personal_data_report

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def expected(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(kind, m[0]):
                spans.append((m.start(), rank, m.end(), kind))
    return sorted(spans)


def fuzz(n):
    rng = random.Random(5)
    pieces = ["a@b.c", ".", "..", "@", "1", "255", "256", ".0.0", "00", "4111 1111 1111 1111", "-", " ", "  ", "+1", "(", ")", "x", "é", "😀", "\n", "_%+", "49 30 1234567", "a.b", "-c.d", "1.2.3.4", "378282246310005", "b@c.d@e.f"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


CASES = [
    None, "", "mail a.b@c.de and 10.0.0.1, card 4111-1111-1111-1111 call +49 (30) 1234567",
    "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "0256.1.1.1 0255.01.1.1 999.1.1.1.1", "4111111111111112", "+1 " + "2" * 14, "+1 " + "2" * 15, "+12345678", "12" * 40_000,
    "a" * 60_000 + "@" + "b.c" * 20_000, "1." * 30_000, "+1" + "(" * 50_000, "😀😀 x@y.z", "ip 1.1.1.1\n2.2.2.2",
]


def test_base_spans_are_those_of_the_plain_patterns(docs, documents):
    texts = CASES + fuzz(400) + [d[1] for d in documents]
    got = {r["doc_id"]: r for r in personal_data_report(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = expected(text)
        row = got[i]
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in want) for k in PLAIN], text and text[:80]
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text and text[:80]
        base = [s for s in row["spans"].split(",") if s and s.split(":")[0] in PLAIN]
        assert ",".join(base) == listed


def test_checksums_and_context(docs):
    texts = ["iban DE89 3704 0044 0532 0130 00", "iban DE89 3704 0044 0532 0130 01", "GB82WEST12345698765432", "SSN 123-45-6789", "part 123-45-6789", "call +49 30 1234567", "x +49 30 1234567"]
    rows = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["pii"]] for r in find_personal_data(docs(list(enumerate(texts)))).collect()}
    kinds = {i: [k for k, _ in v if k in ("iban", "ssn")] for i, v in rows.items()}
    assert kinds == {0: ["iban"], 1: [], 2: ["iban"], 3: ["ssn"], 4: [], 5: [], 6: []}
    assert dict(rows[5])["phone"] > dict(rows[6])["phone"]


def test_rows_pass_through(docs):
    df = find_personal_data(docs([(1, "a@b.c"), (1, "a@b.c"), (None, None)]))
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(len(r["pii"]) for r in df.collect()) == [0, 1, 1]
    assert personal_data_report(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = personal_data_report(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
