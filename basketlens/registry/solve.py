"""Generated SQL that solves small linear systems, so regressions can be checked in a second engine."""

from __future__ import annotations

from collections.abc import Sequence


def moments_cte(name: str, source: str, names: Sequence[str], keys: Sequence[str] = (), targets: Sequence[str] = ()) -> str:
    """Count, means m_i, covariances a_i_j of the predictors and b_i_t with the targets, per key."""
    p = range(len(names))
    cells = [f"count(*) AS n"]
    cells += [f"avg({names[i]}) AS m_{i}" for i in p]
    cells += [f"covar_samp({names[i]}, {names[j]}) AS a_{i}_{j}" for i in p for j in p]
    for t, target in enumerate(targets):
        cells += [f"covar_samp({names[i]}, {target}) AS b_{i}_{t}" for i in p]
        cells += [f"covar_samp({names[i]}, {target}) AS c_{i}_{t}" for i in p]
        cells += [f"avg({target}) AS y_{t}", f"var_samp({target}) AS yy_{t}"]
    head = "".join(f"{k}, " for k in keys)
    tail = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"{name} AS (SELECT {head}{', '.join(cells)} FROM {source}{tail})"


def eliminate(name: str, source: str, p: int, rhs: Sequence[str], keep: Sequence[str], guard: str = "") -> str:
    """Gauss-Jordan steps on a_i_j with right-hand sides ``r_i`` for each r in ``rhs``; solutions keep the names.

    ``guard`` names a format with ``{k}`` that says whether column k takes part; one that does
    not is skipped and remembered as ``u_k``.
    """
    steps, before = [], source
    for k in range(p):
        cells = list(keep)
        skip = (lambda new, old: f"CASE WHEN {guard.format(k=k)} THEN {new} ELSE {old} END") if guard else (lambda new, old: new)
        if guard:
            cells += [f"u_{i}" for i in range(k)] + [f"{guard.format(k=k)} AS u_{k}"]
        for i in range(p):
            factor = f"a_{i}_{k} / a_{k}_{k}"
            for j in range(k + 1, p):
                new = f"a_{k}_{j} / a_{k}_{k}" if i == k else f"a_{i}_{j} - {factor} * a_{k}_{j}"
                cells.append(f"{skip(new, f'a_{i}_{j}')} AS a_{i}_{j}")
            for r in rhs:
                stem, _, suffix = r.partition("@")
                mine, pivot = f"{stem}_{i}{suffix}", f"{stem}_{k}{suffix}"
                new = f"{pivot} / a_{k}_{k}" if i == k else f"{mine} - {factor} * {pivot}"
                cells.append(f"{skip(new, mine)} AS {mine}")
        after = name if k == p - 1 else f"{name}_{k}"
        steps.append(f"{after} AS (SELECT {', '.join(cells)} FROM {before})")
        before = after
    return ",\n".join(steps)


def identity_columns(p: int) -> str:
    """Columns e_i__j of the identity matrix, whose solution is the inverse."""
    return ", ".join(f"CAST({1 if i == j else 0} AS DOUBLE) AS e_{i}__{j}" for i in range(p) for j in range(p))


def identity_rhs(p: int) -> list[str]:
    return [f"e@__{j}" for j in range(p)]


def t_two_sided_sql(t: str, v: str) -> str:
    """Two-sided tail of Student's t for integer degrees of freedom, by its finite series."""
    theta = f"atan(abs({t}) / sqrt({v}))"
    log_cos2 = f"(-ln(1 + ({t}) * ({t}) / ({v})))"
    even = (f"list_sum(list_transform(range(0, CAST({v} // 2 AS BIGINT)), lambda j: "
            f"exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5) + j * {log_cos2})))")
    odd = (f"coalesce(list_sum(list_transform(range(0, CAST(({v} - 1) // 2 AS BIGINT)), lambda j: "
           f"exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + j * {log_cos2}))), 0)")
    return (f"CASE WHEN ({v}) % 2 = 0 THEN 1 - sin({theta}) * {even} "
            f"ELSE 1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd}) END")


def f_upper_even_sql(f: str, d1: int, d2: str) -> str:
    """Upper tail of F for an even numerator df, by its finite series."""
    x = f"(({d2}) / (({d2}) + {d1} * ({f})))"
    a = f"(({d2}) / 2.0)"
    terms = [f"exp(lgamma({a} + {j}) - lgamma({a}) - lgamma({j} + 1.0) + {a} * ln{x}) * pow(1 - {x}, {j})" for j in range(d1 // 2)]
    return " + ".join(terms)


def ols_ctes(name: str, source: str, names: Sequence[str], target: str, keys: Sequence[str] = ()) -> str:
    """CTE ``name``: solutions b_i_0, inverse covariance e_i__j, moments, n, rss, sigma2, intercept, per key."""
    p = len(names)
    keep = [*keys, "n", "y_0", "yy_0", *[f"m_{i}" for i in range(p)], *[f"c_{i}_0" for i in range(p)]]
    explained = " + ".join(f"b_{i}_0 * c_{i}_0" for i in range(p))
    intercept = " - ".join(["y_0", *[f"b_{i}_0 * m_{i}" for i in range(p)]])
    return ",\n".join([
        moments_cte(f"{name}_m", source, names, keys, [target]),
        f"{name}_i AS (SELECT *, {identity_columns(p)} FROM {name}_m)",
        eliminate(f"{name}_s", f"{name}_i", p, ["b@_0", *identity_rhs(p)], keep),
        f"{name} AS (SELECT *, (n - 1) * (yy_0 - ({explained})) AS rss, "
        f"(n - 1) * (yy_0 - ({explained})) / (n - {p + 1}) AS sigma2, {intercept} AS intercept FROM {name}_s)",
    ])


def coefficient_rows(name: str, names: Sequence[str]) -> str:
    """term, estimate, std_error, statistic, p_value rows from an ``ols_ctes`` result."""
    p = len(names)
    mean_inv = " + ".join(f"m_{i} * e_{i}__{j} * m_{j}" for i in range(p) for j in range(p))
    rows = [f"SELECT '(Intercept)' AS term, intercept AS estimate, sqrt(sigma2 * (1.0 / n + ({mean_inv}) / (n - 1))) AS std_error, "
            f"n - {p + 1} AS v FROM {name}"]
    rows += [f"SELECT '{t}' AS term, b_{i}_0 AS estimate, sqrt(sigma2 * e_{i}__{i} / (n - 1)) AS std_error, n - {p + 1} AS v "
             f"FROM {name}" for i, t in enumerate(names)]
    return (f"SELECT term, estimate, std_error, estimate / std_error AS statistic, "
            f"{t_two_sided_sql('(estimate / std_error)', 'v')} AS p_value FROM ({' UNION ALL '.join(rows)})")


def correlation_cte(name: str, source: str, names: Sequence[str]) -> str:
    """Long correlation matrix (i, j, v) of named columns."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS v FROM {source}"
        for i, a in enumerate(names) for j, b in enumerate(names))
    return f"{name} AS MATERIALIZED ({cells})"


def principal_components(name: str, matrix: str, k: int, squarings: int = 22, metric: str = "") -> str:
    """CTE ``name`` (pc, i, loading, eigenvalue) of a long matrix with real, distinct eigenvalues.

    Repeated squaring turns the matrix into the projector on its first component, which is
    then taken out before the next one. Vectors have length one in ``metric`` (the identity if
    none is given) and a positive largest entry.
    """
    ctes, current = [], matrix
    for c in range(k):
        s = current
        for t in range(squarings):
            step = f"{name}_{c}_{t}"
            ctes.append(
                f"{step} AS MATERIALIZED (SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM "
                f"(SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {s} a JOIN {s} b ON a.j = b.i GROUP BY 1, 2))")
            s = step
        raw, vec, nxt = f"{name}_{c}_raw", f"{name}_{c}_vec", f"{name}_{c}_rest"
        ctes.append(f"{raw} AS MATERIALIZED (SELECT i, v AS x FROM {s} WHERE j = (SELECT i FROM {s} WHERE i = j ORDER BY v DESC, i LIMIT 1))")
        length = (f"(SELECT sqrt(sum(a.x * m.v * b.x)) FROM {metric} m JOIN {raw} a ON a.i = m.i JOIN {raw} b ON b.i = m.j)"
                  if metric else f"(SELECT sqrt(sum(x * x)) FROM {raw})")
        ctes.append(
            f"{vec} AS MATERIALIZED (SELECT i, x / {length} * (SELECT sign(x) FROM {raw} ORDER BY abs(x) - 1e-9 * i DESC LIMIT 1) AS x, "
            f"(SELECT sum(m.v * p.v) FROM {matrix} m JOIN {s} p ON p.i = m.j AND p.j = m.i) AS e FROM {raw})")
        ctes.append(
            f"{nxt} AS MATERIALIZED (SELECT m.i, m.j, m.v - (SELECT max(e) FROM {vec}) * p.v AS v FROM {current} m "
            f"JOIN {s} p ON p.i = m.i AND p.j = m.j)")
        current = nxt
    union = " UNION ALL ".join(f"SELECT {c + 1} AS pc, i, x AS loading, e AS eigenvalue FROM {name}_{c}_vec" for c in range(k))
    ctes.append(f"{name} AS MATERIALIZED ({union})")
    return ",\n".join(ctes)
