"""Pieces of the DuckDB twins."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text: each byte enters, then eight shifts of the fixed polynomial."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    steps = f"flatten(list_transform({codes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295)"
