"""DuckDB expressions over lists that mirror `operators.arma`: folds whose state is a struct."""

from __future__ import annotations


def upto(first: str, last: str) -> str:
    return f"range({first}, {last} + 1)"


def solve(m: str) -> str:
    top = "a.m[x.p + 1][x.p + 1]"
    row = f"CASE WHEN i = x.p + 1 THEN list_transform(r, lambda v: v / CASE WHEN abs({top}) > 1e-12 THEN {top} END) ELSE list_transform(r, lambda v, j: v - r[x.p + 1] * (a.m[x.p + 1][j] / CASE WHEN abs({top}) > 1e-12 THEN {top} END)) END"
    done = f"list_reduce(list_transform(range(0, len({m})), lambda p: {{'m': NULL::DOUBLE[][], 'p': p}}), lambda a, x: {{'m': list_transform(a.m, lambda r, i: {row}), 'p': x.p}}, {{'m': {m}, 'p': -1::BIGINT}}).m"
    return f"list_transform({done}, lambda r: r[-1])"


def normal_equations(rows: str, width: str) -> str:
    return f"list_transform(range(0, {width} - 1), lambda i: list_transform(range(0, {width}), lambda j: list_sum(list_transform({rows}, lambda r: r[i + 1] * r[j + 1]))))"


def lags(xs: str, t: str, k: str) -> str:
    """t counts from 0."""
    return f"list_transform(range(1, {k} + 1), lambda j: {xs}[{t} - j + 1])"


def dot(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({a}, lambda z, zi: z * ({b})[zi])), 0.0)"


def known(xs: str, t: str, k: str) -> str:
    return f"list_transform(range(1, {k} + 1), lambda j: CASE WHEN {t} >= j THEN {xs}[{t} - j + 1] ELSE 0.0 END)"


def arma_tables(source: str, orders: list[tuple[int, int]], most: int, tag: str, keys: str = "series_id") -> str:
    """Tables {tag}_fit: the columns of source (keys, xs), and p, q, a, e, sse, aicc, nn for each order."""
    lead = max(max(o) for o in orders)
    k = [x.strip() for x in keys.split(",")]
    menu = ", ".join(f"({p}::BIGINT, {q}::BIGINT)" for p, q in orders)
    return f"""{tag}_l AS (SELECT *, least({most}, len(xs) // 4) AS lg FROM {source}),
{tag}_lr AS (SELECT *, list_transform(range(lg, len(xs)), lambda t: list_append({lags('xs', 't', 'lg')}, xs[t + 1])) AS rws FROM {tag}_l),
{tag}_le AS (SELECT *, {normal_equations('rws', '(lg + 1)')} AS eq FROM {tag}_lr), {tag}_la AS (SELECT *, {solve('eq')} AS la FROM {tag}_le),
{tag}_s AS (SELECT {', '.join(k)}, xs, lg, lg + {lead} AS fst, list_transform(xs, lambda x, i: CASE WHEN i - 1 >= lg THEN x - {dot('la', lags('xs', '(i - 1)', 'lg'))} ELSE 0.0 END) AS sh FROM {tag}_la),
{tag}_o AS (SELECT s.*, o.p, o.q, list_transform(range(fst, len(xs)), lambda t: list_concat(list_concat({lags('xs', 't', 'o.p')}, {lags('sh', 't', 'o.q')}), [xs[t + 1]])) AS rws FROM {tag}_s s, (VALUES {menu}) o(p, q)),
{tag}_q AS (SELECT *, {normal_equations('rws', '(p + q + 1)')} AS eq FROM {tag}_o),
{tag}_a AS (SELECT *, CASE WHEN p + q = 0 THEN []::DOUBLE[] WHEN len(rws) > p + q THEN {solve('eq')} END AS a0 FROM {tag}_q), {tag}_b AS (SELECT * EXCLUDE (a0), CASE WHEN len(list_filter(a0, lambda v: v IS NULL)) = 0 THEN a0 END AS a FROM {tag}_a),
{tag}_e AS (SELECT *, CASE WHEN a IS NOT NULL THEN list_reduce(list_transform(range(0, len(xs)), lambda t: {{'e': NULL::DOUBLE[], 't': t}}), lambda s, x: {{'e': list_append(s.e, xs[x.t + 1] - {dot('list_slice(a, 1, p)', known('xs', 'x.t', 'p'))} - {dot('list_slice(a, p + 1, p + q)', known('s.e', 'x.t', 'q'))}), 't': x.t}}, {{'e': []::DOUBLE[], 't': -1::BIGINT}}).e END AS e FROM {tag}_b),
{tag}_z AS (SELECT *, list_sum(list_transform(list_slice(e, fst + 1, len(e)), lambda v: v * v)) AS sse, len(xs) - fst AS nn FROM {tag}_e),
{tag}_fit AS (SELECT {', '.join(k)}, xs, p, q, a, e, sse, nn, CASE WHEN nn > p + q + 2 THEN nn * ln(sse / nn) + 2 * (p + q + 1) + 2.0 * (p + q + 1) * (p + q + 2) / (nn - p - q - 2) END AS aicc FROM {tag}_z)"""


def ahead(h: int) -> str:
    """Forecasts of a row of a fit, as a list."""
    n = "len(s.x)"
    step = f"{{'x': list_append(s.x, {dot('list_slice(a, 1, p)', known('s.x', n, 'p'))} + {dot('list_slice(a, p + 1, p + q)', known('s.e', n, 'q'))}), 'e': list_append(s.e, 0.0)}}"
    return f"CASE WHEN a IS NOT NULL THEN list_slice(list_reduce(list_transform(range(0, {h}), lambda t: {{'x': NULL::DOUBLE[], 'e': NULL::DOUBLE[]}}), lambda s, u: {step}, {{'x': xs, 'e': e}}).x, len(xs) + 1, len(xs) + {h}) END"


def stationary(ar: str) -> str:
    """Whether all partial autocorrelations are within one."""
    r = "s.a[-1]"
    rest = "list_slice(s.a, 1, len(s.a) - 1)"
    step = f"{{'a': list_transform({rest}, lambda v, i: (v + {r} * ({rest})[len(s.a) - i]) / CASE WHEN abs({r}) < 1 THEN 1 - {r} * {r} END), 'ok': s.ok AND abs({r}) < 1}}"
    return f"coalesce(list_reduce(list_transform({ar}, lambda v: {{'a': NULL::DOUBLE[], 'ok': true}}), lambda s, x: {step}, {{'a': {ar}, 'ok': true}}).ok, false)"
