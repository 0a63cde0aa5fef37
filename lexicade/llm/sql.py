"""CRC-32 in DuckDB's SQL, which has no function for it."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# what one byte does to the checksum
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc_steps)"""


def crc32_sql(text: str) -> str:
    """Unsigned checksum of a string's UTF-8 bytes; needs ``crc_table`` beside the rows."""
    codes = f"""list_transform(range(octet_length(encode({text}))),
      lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, {codes}),
      lambda c, b: xor(c >> 8, crc_steps[(xor(c, b) & 255) + 1])))"""
