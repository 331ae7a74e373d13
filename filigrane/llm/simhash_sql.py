"""DuckDB SQL of near_duplicates, for unique ids: XXH64 over 128-bit integers, all pairs of distinct fingerprints, and a recursive closure."""

from __future__ import annotations

from filigrane.llm.simhash import MAX_BITS, SEED, SHINGLE

_WIDE = 1 << 64
#: The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _number(x: int) -> str:
    return f"{x % _WIDE}::UHUGEINT"


_P1, _P2, _P3, _P4, _P5 = map(_number, _PRIMES)


def _mod(x: str) -> str:
    return f"(({x}) % {_WIDE}::UHUGEINT)"


def _turned(x: str, bits: int) -> str:
    """x rotated left; a fold over a list of one stands for a name of x."""
    return f"list_reduce([{x}, 0::UHUGEINT], lambda p, q: p * {1 << bits}::UHUGEINT % {_WIDE}::UHUGEINT + p // {1 << (64 - bits)}::UHUGEINT)"


def _round(x: str) -> str:
    return _mod(f"{_turned(_mod(f'{x} * {_P2}'), 31)} * {_P1}")


def _lane(at: str, size: int) -> str:
    """The little-endian number of size bytes at a byte of the hex text hx."""
    return "('0x' || " + " || ".join(f"substr(hx, ({at}) * 2 + {2 * (size - 1 - i) + 1}, 2)" for i in range(size)) + ")::UBIGINT::UHUGEINT"


def _hash_steps() -> list[str]:
    """From inputs (hx, n) to hashes (hx, h): stripes of 32 bytes, lanes of 8 and 4, single bytes, and the final mixing."""
    starts = (SEED + _PRIMES[0] + _PRIMES[1], SEED + _PRIMES[1], SEED, SEED - _PRIMES[0])
    stripe = lambda k: f"list_transform(range(n // 32), lambda j: {_lane(f'32 * j + {8 * k}', 8)})"
    sums = ", ".join(f"CASE WHEN n >= 32 THEN list_reduce(list_prepend({_number(s)}, {stripe(k)}), lambda a, x: {_mod(f'{_turned(_mod(f"a + x * {_P2} % {_WIDE}::UHUGEINT"), 31)} * {_P1}')}) END AS v{k}" for k, s in enumerate(starts))
    whole = " + ".join(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18)))
    steps = [f"CASE WHEN n >= 32 THEN {_mod(f'{_mod(f"xor(h, {_round(f'v{k}')}) * {_P1}")} + {_P4}')} ELSE h END" for k in range(4)]
    eights = f"list_transform(range(n % 32 // 8), lambda j: {_lane('n // 32 * 32 + 8 * j', 8)})"
    steps.append(f"list_reduce(list_prepend({_mod('h + n::UHUGEINT')}, {eights}), lambda a, x: {_mod(f'{_mod(f"{_turned(f'xor(a, {_round('x')})', 27)} * {_P1}")} + {_P4}')})")
    steps.append(f"CASE WHEN n % 8 >= 4 THEN {_mod(f'{_mod(f"{_turned(f'xor(h, {_mod(f"{_lane('n // 8 * 8', 4)} * {_P1}")})', 23)} * {_P2}")} + {_P3}')} ELSE h END")
    steps.append(f"list_reduce(list_prepend(h, list_transform(range(n % 4), lambda j: {_lane('n // 4 * 4 + j', 1)})), lambda a, x: {_mod(f'{_turned(f"xor(a, {_mod(f'x * {_P5}')})", 11)} * {_P1}')})")
    steps += [_mod(f"xor(h, h // {1 << bits}::UHUGEINT) * {p}") for bits, p in ((33, _P2), (29, _P3))]
    out = [f"s0 AS (SELECT hx, n, v0, v1, v2, v3, CASE WHEN n >= 32 THEN {_mod(whole)} ELSE {_number(SEED + _PRIMES[4])} END AS h FROM (SELECT hx, n, {sums} FROM inputs))"]
    out += [f"s{i + 1} AS (SELECT * EXCLUDE (h), {step} AS h FROM s{i})" for i, step in enumerate(steps)]
    return [*out, f"hashes AS (SELECT hx, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM s{len(steps)})"]


def oracle() -> str:
    bits = " + ".join(f"CASE WHEN 2 * sum((h // {1 << b}::UBIGINT) % 2) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    parts = [
        "texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)",
        r"split AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM texts)",
        f"shingles AS (SELECT doc_id, hex(encode(array_to_string(CASE WHEN len(ws) <= {SHINGLE} THEN ws ELSE ws[i:i + {SHINGLE - 1}] END, ' '))) AS hx FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM split WHERE len(ws) > 0))",
        "inputs AS (SELECT DISTINCT hx, length(hx) // 2 AS n FROM shingles)",
        *_hash_steps(),
        f"made AS (SELECT doc_id, ({bits})::UBIGINT AS fp FROM shingles JOIN hashes USING (hx) GROUP BY doc_id)",
        "prints AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN made USING (doc_id))",
        "fps AS (SELECT fp, min(doc_id) AS low FROM prints GROUP BY fp)",
        f"links AS (SELECT a.fp AS u, b.fp AS v FROM fps a JOIN fps b ON a.fp <> b.fp AND bit_count(xor(a.fp::HUGEINT, b.fp::HUGEINT)) <= {MAX_BITS})",
        "reach(u, v) AS (SELECT fp, fp FROM fps UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)",
        "roots AS (SELECT u AS fp, min(low) AS component_id FROM reach JOIN fps ON fps.fp = v GROUP BY u)",
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN roots USING (fp)"
