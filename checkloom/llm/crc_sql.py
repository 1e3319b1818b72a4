"""CRC-32 in DuckDB SQL, which has no function for it.

CRC-32 is linear: that of a string is the exclusive or of what each byte gives by its distance from the end, and of what a
string of so many zero bytes gives. `crc` has the first by (distance, byte), `zero` the second by length.
"""

_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def hashed(texts: str) -> str:
    """CTEs, for a query that is WITH RECURSIVE, that end in hashed(f, h): the CRC h of each text f of the query `texts`."""
    return f"""bits AS (SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) r(b) UNION ALL SELECT b, k + 1, {_STEP} FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
form AS MATERIALIZED (SELECT f, row_number() OVER () AS id, hex(f) AS x FROM ({texts})),
crc AS (SELECT 0 AS d, b, c FROM tab UNION ALL SELECT d + 1, crc.b, xor(t.c, crc.c >> 8) FROM crc JOIN tab t ON t.b = crc.c & 255 WHERE d < (SELECT max(len(x)) // 2 FROM form)),
zero AS (SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS c UNION ALL SELECT n + 1, xor(t.c, zero.c >> 8) FROM zero JOIN tab t ON t.b = zero.c & 255 WHERE n < (SELECT max(len(x)) // 2 FROM form)),
bytes AS (SELECT id, len(x) // 2 - i AS d, CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER) AS b FROM (SELECT id, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM form)),
part AS (SELECT id, bit_xor(crc.c) AS c FROM bytes JOIN crc ON crc.d = bytes.d AND crc.b = bytes.b GROUP BY id),
hashed AS (SELECT form.f, xor(xor(part.c, zero.c), 4294967295) AS h FROM form JOIN part ON part.id = form.id JOIN zero ON zero.n = len(form.x) // 2)"""
