"""CRC-32 (the one of zlib) of a short ASCII text as DuckDB SQL, for the checks whose contracts use it."""

from __future__ import annotations

#: A common table expression, crc(steps): the checksum's table of 256 entries, from its polynomial.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY n) AS steps
  FROM range(256) r(n))"""


def crc32_sql(text: str) -> str:
    """The unsigned checksum of a VARCHAR expression; crc must be among the tables read."""
    byte_list = f"list_transform(string_split({text}, ''), lambda x: ord(x))::UBIGINT[]"
    each = "lambda a, b: xor(a >> 8, crc.steps[(xor(a, b) & 255)::BIGINT + 1])"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {byte_list}), {each}))"
