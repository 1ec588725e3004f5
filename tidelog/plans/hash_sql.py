"""SQL text of the 32-bit hashes for DuckDB, over ASCII strings."""

from __future__ import annotations

from tidelog.functions import hashing as H

M = "4294967295::UBIGINT"
BYTES = "list_transform(range(1, length({c}) + 1), lambda i: ord(substring({c}, i::INT, 1))::UBIGINT)"


def u(x: int) -> str:
    return f"{x & 0xFFFFFFFF}::UBIGINT"


def rot(x: str, r: int) -> str:
    return f"((({x} << {r}) | ({x} >> {32 - r})) & {M})"


def fnv(column: str, name: str) -> str:
    """A select item."""
    return f"list_reduce(list_prepend({u(H.FNV_BASIS)}, {BYTES.format(c=column)}), lambda h, b: (xor(h, b) * {u(H.FNV_PRIME)}) & {M})::BIGINT AS {name}"


def _word(at: str) -> str:
    return f"(_b[{at}] | (_b[{at} + 1] << 8) | (_b[{at} + 2] << 16) | (_b[{at} + 3] << 24))"


def _steps(source: str, steps: list[str], columns: list[str]) -> str:
    """Each step adds columns that the next ones use; the helper columns then go."""
    for s in steps:
        source = f"SELECT *, {s} FROM ({source})"
    return f"SELECT * EXCLUDE ({', '.join(columns)}) FROM ({source})"


def murmur(source: str, column: str, name: str) -> str:
    """A query: the source's columns and the hash."""
    mix = lambda k: f"(({rot(f'(({k} * {u(H.MURMUR_C1)}) & {M})', 15)} * {u(H.MURMUR_C2)}) & {M})"
    x = "xor(h, k)"
    steps = [
        f"{BYTES.format(c=column)} AS _b, length({column}) AS _n",
        f"list_transform(range(0, _n // 4), lambda i: {_word('(4 * i + 1)')}) AS _w, coalesce(_b[4 * (_n // 4) + 1], 0) | (coalesce(_b[4 * (_n // 4) + 2], 0) << 8) | (coalesce(_b[4 * (_n // 4) + 3], 0) << 16) AS _t",
        f"list_reduce(list_prepend({u(H.MURMUR_SEED)}, list_transform(_w, lambda k: {mix('k')})), lambda h, k: ({rot(x, 13)} * 5 + {u(H.MURMUR_ADD)}) & {M}) AS _h0",
        f"xor(xor(_h0, {mix('_t')}), _n::UBIGINT) AS _h1",
        f"(xor(_h1, _h1 >> 16) * {u(H.MURMUR_F1)}) & {M} AS _h2",
        f"(xor(_h2, _h2 >> 13) * {u(H.MURMUR_F2)}) & {M} AS _h3",
        f"xor(_h3, _h3 >> 16)::BIGINT AS {name}",
    ]
    return _steps(source, steps, ["_b", "_n", "_w", "_t", "_h0", "_h1", "_h2", "_h3"])


def xx(source: str, column: str, name: str) -> str:
    """A query: the source's columns and xxHash32 with seed 0."""
    lane = lambda v, k: f"list_reduce(list_prepend({u(v)}, list_transform(range(0, _n // 16), lambda i: {_word(f'(16 * i + {4 * k + 1})')})), lambda v, w: ({rot(f'((v + ((w * {u(H.XX2)}) & {M})) & {M})', 13)} * {u(H.XX1)}) & {M})"
    rest = "16 * (_n // 16)"
    steps = [
        f"{BYTES.format(c=column)} AS _b, length({column}) AS _n",
        ", ".join(f"{lane(v, k)} AS _v{k}" for k, v in enumerate((H.XX1 + H.XX2, H.XX2, 0, -H.XX1))),
        f"(CASE WHEN _n >= 16 THEN {rot('_v0', 1)} + {rot('_v1', 7)} + {rot('_v2', 12)} + {rot('_v3', 18)} ELSE {u(H.XX5)} END + _n::UBIGINT) & {M} AS _h0",
        f"list_reduce(list_prepend(_h0, list_transform(range(0, (_n % 16) // 4), lambda i: {_word(f'({rest} + 4 * i + 1)')})), lambda h, w: ({rot(f'((h + ((w * {u(H.XX3)}) & {M})) & {M})', 17)} * {u(H.XX4)}) & {M}) AS _h1",
        f"list_reduce(list_prepend(_h1, list_transform(range(0, _n % 4), lambda i: _b[_n - _n % 4 + i + 1])), lambda h, b: ({rot(f'((h + ((b * {u(H.XX5)}) & {M})) & {M})', 11)} * {u(H.XX1)}) & {M}) AS _h2",
        f"(xor(_h2, _h2 >> 15) * {u(H.XX2)}) & {M} AS _h3",
        f"(xor(_h3, _h3 >> 13) * {u(H.XX3)}) & {M} AS _h4",
        f"xor(_h4, _h4 >> 16)::BIGINT AS {name}",
    ]
    return _steps(source, steps, ["_b", "_n", "_v0", "_v1", "_v2", "_v3", "_h0", "_h1", "_h2", "_h3", "_h4"])
