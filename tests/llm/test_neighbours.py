"""Personal data beside other text."""

import pytest
from conftest import DATA  # noqa: F401

from furrow.llm import pii

IBANS = ["BE68539007547034", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "AT611904300234573201", "SE4550000000058398257466", "PL61109010140000071219812874"]
PHONES = ["+1 555 123 4567", "+1-555-123-4567", "+1 (415) 555-7713", "555.123.4567", "555-123-4567", "+44 20 7946 0958", "+49 30 123456", "+33 612 345 678"]
AFTER = ["", " EUR", " BIC: X", " 2024", " 2024-01-05", " 05/01/2024", " 12 times", ", and more", "."]


def treated(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.kinds) for r in pii.pseudonymise(frame, "k").orderBy("row.doc_id").collect()]


@pytest.mark.parametrize("kind, values", [("iban", IBANS), ("phone", PHONES)])
def test_what_follows_is_not_taken_in(spark, kind, values):
    cases = [(v, a) for v in values for a in AFTER if not (v.startswith("+49") and a[:2].strip().isdigit() and "-" not in a and "/" not in a)]
    found = treated(spark, [f"see {v}{a}" for v, a in cases])
    alone = dict(zip(values, (t for t, _ in treated(spark, [f"see {v}" for v in values])), strict=True))
    for (value, after), (text, kinds) in zip(cases, found, strict=True):
        dated = after in (" 2024-01-05", " 05/01/2024")
        assert (value, after, kinds) == (value, after, [kind, "date"] if dated else [kind])
        assert text.startswith(alone[value]) and alone[value] != f"see {value}"
        assert dated or text == alone[value] + after
