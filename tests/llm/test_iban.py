"""Account numbers with other capitals and digits behind them."""

import pytest

from tidegate.llm import pii

IBAN = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("behind", ["", " BIC DEUTDEFF", " 2024", " EUR 50", " X", ", BIC DEUTDEFF", " and on", " 4111 1111 1111 1111"])
@pytest.mark.parametrize("iban", [IBAN, IBAN.replace(" ", ""), "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
def test_what_follows(iban, behind):
    text = f"pay to {iban}{behind}"
    assert [text[s:e] for s, e, k in pii.confirmed(text) if k == 4] == [iban]


def test_several_and_none():
    two = f"AB12 {IBAN} GB82 WEST 1234 5698 7654 32 X"
    assert [two[s:e] for s, e in pii.ibans(two)] == [IBAN, "GB82 WEST 1234 5698 7654 32"]
    unknown = "ZZ63 1234 5678 9012 345"
    assert pii.mod97(unknown) == bool(list(pii.ibans(unknown + " EUR")))
    for wrong in ("DE88 3704 0044 0532 0130 00 BIC DEUTDEFF", IBAN + "X", "x" + IBAN, "DE89", "DE89 3704", ""):
        assert not list(pii.ibans(wrong)), wrong


def test_unknown_country_before_a_year():
    body = "ZZ{} 1234 5678 9012 345"
    whole = next(body.format(f"{n:02}") for n in range(2, 99) if pii.mod97(body.format(f"{n:02}")))
    assert [whole] == [(whole + " 2024")[s:e] for s, e in pii.ibans(whole + " 2024")]
