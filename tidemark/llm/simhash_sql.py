"""SQL for SimHash classes: XXH64 of shingles in numbers of 128 bits cut to 64, bit majorities, links between all fingerprints, reachability.

Written for an independent engine that has no such hash. It compares all pairs, so it is for small tables only.
"""

from __future__ import annotations

from tidemark.llm.simhash import RADIUS, SEED, SHINGLE

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261

_WHOLE = 1 << 64
_MASK = f"{_WHOLE - 1}::UHUGEINT"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _u(n: int) -> str:
    return f"{n % _WHOLE}::UHUGEINT"


def _times(x: str, n: int) -> str:
    return f"((({x}) * {_u(n)}) & {_MASK})"


def _plus(x: str, y: str) -> str:
    return f"(({x} + {y}) & {_MASK})"


def _turned(x: str, bits: int) -> str:
    return f"({_times(x, 1 << bits)} + (({x}) >> {64 - bits}))"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_plus(acc, _times(lane, P2)), 31), P1)


def _folded(first: str, items: str, step: str) -> str:
    return f"list_reduce(list_concat([{first}], {items}), lambda a, x: {step})"


def _little_endian(first: str, width: int) -> str:
    """The number in so many bytes of the hex text x, from byte first on."""
    return "('0x' || " + " || ".join(f"substring(x, 2 * ({first}) + {2 * k + 1}, 2)" for k in reversed(range(width))) + ")::UBIGINT::UHUGEINT"


def _majority(first_bit: int) -> str:
    return " + ".join(f"CASE WHEN 2 * sum((h >> {first_bit + k}) & 1) > count(*) THEN {1 << k} ELSE 0 END" for k in range(32))


def sql() -> str:
    """doc_id, fingerprint, component_id of the table documents."""
    starts = (SEED + P1 + P2, SEED + P2, SEED, SEED - P1)
    stripes = lambda k: f"list_transform(range({k}, 4 * (len // 32), 4), lambda i: lane[i + 1])"
    merged = lambda h, v: _plus(_times(f"xor({h}, {_round(_u(0), v)})", P1), _u(P4))
    by_eight = _plus(_times(_turned(f"xor(a, {_round(_u(0), 'x')})", 27), P1), _u(P4))
    by_one = _times(_turned(f"xor(a, {_times('x', P5)})", 11), P1)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS words, any_value(w) AS w FROM d GROUP BY 1),
s AS (SELECT words, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT words, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM t WHERE len(w) > 0)),
b AS (SELECT DISTINCT shingle, strlen(shingle) AS len, hex(encode(shingle)) AS x FROM s),
l AS (SELECT *, list_transform(range(len // 8), lambda i: {_little_endian('8 * i', 8)}) AS lane FROM b),
v AS (SELECT *, {", ".join(f"{_folded(_u(n), stripes(k), _round('a', 'x'))} AS v{k}" for k, n in enumerate(starts))} FROM l),
m AS (SELECT *, ({" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))}) & {_MASK} AS m FROM v),
m0 AS (SELECT *, {merged("m", "v0")} AS m0 FROM m), m1 AS (SELECT *, {merged("m0", "v1")} AS m1 FROM m0), m2 AS (SELECT *, {merged("m1", "v2")} AS m2 FROM m1), m3 AS (SELECT *, {merged("m2", "v3")} AS m3 FROM m2),
h0 AS (SELECT *, {_plus(f"CASE WHEN len >= 32 THEN m3 ELSE {_u(SEED + P5)} END", "len::UHUGEINT")} AS h0 FROM m3),
h1 AS (SELECT *, {_folded("h0", "list_transform(range(4 * (len // 32), len // 8), lambda i: lane[i + 1])", by_eight)} AS h1 FROM h0),
h2 AS (SELECT *, CASE WHEN len % 8 >= 4 THEN xor(h1, {_times(_little_endian("8 * (len // 8)", 4), P1)}) END AS y FROM h1),
h3 AS (SELECT *, coalesce({_plus(_times(_turned("y", 23), P2), _u(P3))}, h1) AS h3 FROM h2),
h4 AS (SELECT *, {_folded("h3", f"list_transform(range(len - len % 4, len), lambda i: {_little_endian('i', 1)})", by_one)} AS h4 FROM h3),
h5 AS (SELECT shingle, {_times("xor(h4, h4 >> 33)", P2)} AS h5 FROM h4), h6 AS (SELECT shingle, {_times("xor(h5, h5 >> 29)", P3)} AS h6 FROM h5),
hash AS (SELECT shingle, xor(h6, h6 >> 32)::UBIGINT AS h FROM h6),
prints AS (SELECT words, {_majority(32)} AS hi, {_majority(0)} AS lo FROM s JOIN hash USING (shingle) GROUP BY words),
f AS (SELECT doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM d LEFT JOIN prints ON words = array_to_string(w, ' ')),
nodes AS (SELECT hi, lo, min(doc_id) AS least FROM f GROUP BY hi, lo),
links AS (SELECT a.least AS x, b.least AS y FROM nodes a JOIN nodes b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {RADIUS}),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, format('{{:08x}}{{:08x}}', hi::BIGINT, lo::BIGINT) AS fingerprint, component_id FROM f JOIN nodes USING (hi, lo) JOIN roots ON x = least
"""
