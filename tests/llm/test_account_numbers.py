"""International account numbers end at their country's length."""

from __future__ import annotations

import pytest

from lakemart.llm.pii import IBAN_COUNTRIES, find_personal_data

ES, DE, BE = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034"
NAMES = {15: "NO93 8601 1117 947", 24: ES, 22: DE, 16: BE, 28: "PL61 1090 1014 0000 0712 1981 2874", 27: "FR14 2004 1010 0505 0001 3M02 606", 31: "MT84 MALT 0110 0001 2345 MTLC AST0 01S"}
CASES = [
    *[(f"iban {a}{b}", [a]) for a in NAMES.values() for b in ("", ".", " DANKE", " DAN", " 2024 OK", " THANKS 12")],
    (f"iban {ES} {DE} {BE} {ES}", [ES, DE, BE, ES]),
    (f"iban {ES.replace(' ', '')} DANKE {DE.replace(' ', '')}", [ES.replace(" ", ""), DE.replace(" ", "")]),
    (f"iban {ES[:-1]}3 DANKE", []), (f"iban {ES}X", []), (f"iban x{ES}", []), (None, []),
]


def test_account_numbers(docs):
    rows = find_personal_data(docs([(k, text) for k, (text, _) in enumerate(CASES)])).collect()
    got = {r["doc_id"]: [(s["match"], s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"] for r in rows}
    for k, (text, want) in enumerate(CASES):
        assert [m for m, _, _ in got[k]] == want, text
        assert all(text[a:b] == m for m, a, b in got[k])


@pytest.mark.parametrize("length, countries", IBAN_COUNTRIES.items())
def test_lengths(length, countries):
    assert all(len(c) == 2 and c.isupper() for c in countries.split())
    assert len(NAMES.get(length, "x" * length).replace(" ", "")) == length
