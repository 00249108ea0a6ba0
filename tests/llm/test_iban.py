from __future__ import annotations

import pytest

from tessera.llm import pii


def found(t):
    return [t[a:b] for k, a, b, _ in pii.find(t) if pii.KINDS[k] == "iban"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("IBAN DE89370400440532013000 Please pay", ["DE89370400440532013000"]),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("to GB82 WEST 1234 5698 7654 32 2 DAYS LATER", ["GB82 WEST 1234 5698 7654 32"]),
        ("REF AB12 DE89 3704 0044 0532 0130 00 THANKS", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 GB82WEST12345698765432 NO9386011117947", ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"]),
        ("MT84MALT011000012345MTLCAST001S 7", ["MT84MALT011000012345MTLCAST001S"]),
        ("DE89370400440532013000please and (DE89370400440532013000)", ["DE89370400440532013000"] * 2),
        ("DE89370400440532013000X XDE89370400440532013000 DE88370400440532013000 Please", []),
    ],
)
def test_iban_ends_at_its_length(text, want):
    assert found(text) == want


def test_other_codes_end_where_they_pass():
    body = "1234567890123456"
    check = next(c for c in range(2, 99) if pii.mod97(f"ZZ{c:02d}{body}"))
    assert found(f"ZZ{check:02d}{body} Q") == [f"ZZ{check:02d}{body}"]


def test_long_runs_are_linear():
    assert found("AB12" * 100_000 + " " + "AB12 " * 100_000) is not None
