"""DuckDB SQL for the queries of the catalog, on the same tables.

``_BASE`` holds the stand-in inputs as named subqueries; each query takes the
ones it needs. Orders, sums and quantiles are spelled out the plain way here
(one global window, range joins), not the way the operators compute them.
"""

from __future__ import annotations

from heirflow.operators.forest import EXACT_COUNT, poisson_limits
from heirflow.operators.ordered import RANK_LABELS, RANK_PROBS
from heirflow.plans import standins as s
from heirflow.sources.schemas import TAX_UNITS

_TWO52 = "4503599627370496e0"


def _u(key: str, seed: int, draw: str) -> str:
    """Keyed uniform."""
    text = f"concat_ws(':', {key}, '{seed}', '{draw}')"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {_TWO52})"


def _d(number: float) -> str:
    """Double literal."""
    return f"{float(number)!r}::DOUBLE"


def _list(numbers: list[float]) -> str:
    return "[" + ", ".join(_d(x) for x in numbers) + "]"


def _dependant(every: int, span: int, n: int) -> str:
    return (
        f"CASE WHEN c_custkey % {every} = 0 THEN CAST(c_custkey % {span} AS INTEGER) END AS dep_age{n}"
    )


def _order_sum(status: str, name: str) -> str:
    return f"round(sum(CASE WHEN o_orderstatus = '{status}' THEN o_totalprice END), 2) AS {name}"


_Z = (
    f"(sqrt(-2e0 * ln(1e0 - {_u('id', s.FIT_SEED, 'z1')}))"
    f" * cos(2e0 * pi() * {_u('id', s.FIT_SEED, 'z2')}))"
)


def _timing(wave: str, year: str) -> str:
    cases = " ".join(f"WHEN {wave} = {w} AND {year} = {y} THEN {_d(p)}" for w, y, p in s.TIMING)
    return f"(CASE {cases} ELSE 0e0 END)"


def _drawn(n: int) -> str:
    key = "concat_ws(':', survey_year, yy1, y1, dup_id)"
    p = _timing("survey_year", f"year_{n}")
    return (
        f"CASE WHEN value_{n} > 0 AND type_{n} <> 3 AND {p} > 0 THEN "
        f"CASE WHEN {_u(key, s.SEED, f'event{n}')} < {p} THEN value_{n} ELSE 0e0 END END"
    )


_WAVE = "CASE " + " ".join(
    f"WHEN year(o_orderdate) >= {w} THEN {w}" for w in reversed(s.WAVES[1:])
) + f" ELSE {s.WAVES[0]} END"
_FIRST, _LAST = s.YEARS

_BASE = {
    "units": f"""
        SELECT c_custkey AS id, CAST(1 + c_custkey % 7 AS DOUBLE) AS weight,
               CAST(18 + c_custkey % 75 AS INTEGER) AS age1,
               CAST(1 + c_nationkey % 4 AS INTEGER) AS filing_status,
               {_dependant(3, 30, 1)}, {_dependant(5, 25, 2)}, {_dependant(7, 20, 3)},
               round(100e0 * c_acctbal, 2) AS kg_lt,
               coalesce(wages, 0e0) AS wages, coalesce(sole_prop, 0e0) AS sole_prop,
               coalesce(rent_loss, 0e0) AS rent_loss
        FROM customer LEFT JOIN (
            SELECT o_custkey, {_order_sum('F', 'wages')}, {_order_sum('O', 'sole_prop')},
                   {_order_sum('P', 'rent_loss')}
            FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "imputed": f"""
        SELECT id, weight, age1, filing_status, (20e0 + age1 % 50) / 1024e0 AS p_inheritance,
               round(exp((10e0 + 0.01e0 * age1) + 1.2e0 * {_Z}), 2) AS inheritance
        FROM units""",
    "summary": f"""
        SELECT CAST({_WAVE} AS INTEGER) AS survey_year, o_orderkey // 5 AS yy1,
               o_orderkey AS y1, CAST(1 + o_orderkey % 9 AS DOUBLE) AS weight,
               CAST(18 + o_custkey % 63 AS INTEGER) AS age, CAST(o_orderkey % 2 AS INTEGER) AS married,
               CAST(o_custkey % 3 = 0 AS INTEGER) AS has_kids,
               round(o_totalprice - 20000e0, 2) AS income
        FROM orders""",
    "lines": """
        SELECT l_orderkey AS y1, 1 + (l_linenumber - 1) % 3 AS n,
               CAST(max(1 + l_linenumber % 3) AS INTEGER) AS type,
               round(sum(l_extendedprice), 2) AS value, CAST(max(year(l_shipdate)) AS INTEGER) AS year
        FROM lineitem GROUP BY ALL""",
    "surveys": """
        SELECT summary.*, d.* EXCLUDE (y1) FROM summary LEFT JOIN (
            SELECT y1, """
    + ", ".join(
        f"max({m}) FILTER (WHERE n = {n}) AS {m}_{n}" for n in (1, 2, 3) for m in ("type", "value", "year")
    )
    + """ FROM lines GROUP BY y1) d ON summary.y1 = d.y1""",
    "copies": """
        SELECT surveys.* EXCLUDE (weight), weight / 5e0 AS weight, CAST(k AS INTEGER) AS dup_id
        FROM surveys, range(1, 6) AS numbers(k)""",
    "training": f"""
        SELECT survey_year, yy1, y1, dup_id, weight, age, married, has_kids, income,
               coalesce(drawn, 0e0) AS inheritance, CAST(coalesce(drawn, 0e0) > 0 AS INTEGER) AS has_inheritance
        FROM (SELECT *, greatest({_drawn(1)}, {_drawn(2)}, {_drawn(3)}) AS drawn FROM copies)""",
    "events": """
        SELECT survey_year, yy1, y1, n, type, value, year FROM ("""
    + " UNION ALL ".join(
        f"SELECT survey_year, yy1, y1, {n} AS n, type_{n} AS type, value_{n} AS value, year_{n} AS year FROM surveys"
        for n in (1, 2, 3)
    )
    + ")",
    "economic": f"""
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS gdp,
               (100e0 + 2.5e0 * (year(o_orderdate) - {_FIRST})) + 1e0 AS cpiu,
               100e0 + 2.5e0 * (year(o_orderdate) - {_FIRST}) AS ccpiu_irs
        FROM orders GROUP BY year(o_orderdate)""",
    "demographic": f"""
        SELECT y.year, m.married, a.age, 100e0 + coalesce(c.n, 0) AS population
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) y,
             (SELECT CAST(k AS INTEGER) AS married FROM range(0, 2) AS numbers(k)) m,
             (SELECT CAST(k AS INTEGER) AS age FROM range({s.AGES.start}, {s.AGES.stop}) AS numbers(k)) a
        LEFT JOIN (SELECT year(o_orderdate) AS year, o_orderkey % 2 AS married,
                          18 + o_custkey % 63 AS age, count(*) AS n FROM orders GROUP BY ALL) c
        ON y.year = c.year AND m.married = c.married AND a.age = c.age""",
    "population": "SELECT year, sum(population) AS population FROM demographic GROUP BY year",
    "quarterly": """
        SELECT date, CASE WHEN date = '1997-Q3' THEN 'ND' ELSE CAST(value AS VARCHAR) END AS net_worth
        FROM (SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS date,
                     round(sum(l_extendedprice) / 1e3, 2) AS value FROM lineitem GROUP BY ALL)""",
    "net_worth": f"""
        SELECT p.year, (CASE WHEN p.year > {s.LAST_KNOWN} THEN b.net_worth * (e.gdp / b.gdp)
                        ELSE k.net_worth END) * 1e6 / p.population AS net_worth_pc
        FROM population p JOIN economic e USING (year)
        LEFT JOIN (SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year,
                          TRY_CAST(net_worth AS DOUBLE) AS net_worth
                   FROM quarterly WHERE substr(date, 6, 2) = 'Q3') k ON p.year = k.year,
             (SELECT TRY_CAST(net_worth AS DOUBLE) AS net_worth, gdp FROM quarterly, economic
              WHERE date = '{s.LAST_KNOWN}-Q3' AND year = {s.LAST_KNOWN}) b
        WHERE p.year BETWEEN {_FIRST} AND {_LAST}""",
    "demographic_factor": f"""
        SELECT d.year AS survey_year, d.age, d.married, a.population / d.population AS demographic_factor
        FROM demographic d JOIN demographic a
        ON a.year = {s.ANCHOR} AND a.age = d.age AND a.married = d.married""",
    "asset_factor": f"""
        SELECT n.year AS survey_year, a.net_worth_pc / n.net_worth_pc AS asset_factor
        FROM net_worth n, net_worth a WHERE a.year = {s.ANCHOR}""",
    "indexes": f"""
        SELECT e.year, e.ccpiu_irs / a.ccpiu_irs AS inflation_index,
               (e.gdp / p.population) / (a.gdp / pa.population) AS gdp_pc_index
        FROM economic e JOIN population p ON e.year = p.year,
             economic a JOIN population pa ON a.year = pa.year
        WHERE a.year = {s.ANCHOR} AND e.year BETWEEN {_FIRST} AND {_LAST}""",
    "incomes": "SELECT *, wages + sole_prop + kg_lt - rent_loss AS income FROM units",
    "targets": f"""
        SELECT married, CAST(age // 5 * 5 AS INTEGER) AS age_group,
               sum(CAST(inheritance > 0 AS INTEGER) * weight / {len(s.WAVES)}e0) AS actual
        FROM training GROUP BY ALL""",
}

_NEEDS = {
    "imputed": ["units"], "surveys": ["summary", "lines"], "copies": ["surveys"],
    "training": ["copies"], "events": ["surveys"], "population": ["demographic"],
    "net_worth": ["population", "economic", "quarterly"], "demographic_factor": ["demographic"],
    "asset_factor": ["net_worth"], "indexes": ["economic", "population"], "incomes": ["units"],
    "targets": ["training"],
}


def _with(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named subqueries, everything they need, and ``extra`` ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_BASE[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _quantiles(source: str, value: str, weight: str, probs: str, by: str = "") -> dict[str, str]:
    """Subqueries q_dist, q_pos, q_out: weighted quantiles of ``source`` at every probability."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    same = f"d.{by} = p.{by} AND " if by else ""
    return {
        "q_dist": f"""
            SELECT {group}v, sum(w) OVER ({part}ORDER BY v) AS cum FROM (
                SELECT {group}{value} AS v, sum({weight}) AS w FROM {source} GROUP BY ALL)""",
        "q_pos": f"""
            SELECT *, 1e0 + (n - 1e0) * p AS pos FROM (
                SELECT {group}max(cum) AS n FROM q_dist {'GROUP BY ' + by if by else ''}),
                (SELECT unnest({probs}) AS p, generate_subscripts({probs}, 1) - 1 AS i)""",
        "q_out": f"""
            SELECT {'p.' + by + ', ' if by else ''}p.i, p.p,
                   (1e0 - (any_value(pos) - floor(any_value(pos))))
                     * min(d.v) FILTER (WHERE d.cum >= least(greatest(floor(pos), 1e0), n))
                   + (any_value(pos) - floor(any_value(pos)))
                     * min(d.v) FILTER (WHERE d.cum >= least(greatest(floor(pos), 1e0) + 1e0, n)) AS q
            FROM q_pos p JOIN q_dist d ON {same}d.cum >= least(greatest(floor(pos), 1e0), n)
            GROUP BY ALL""",
    }


def _renamed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    out = {}
    for name, query in ctes.items():
        for old in ("q_dist", "q_pos", "q_out"):
            query = query.replace(old, prefix + old)
        out[prefix + name] = query
    return out


def _bins(source: str, value: str, floor: float, by: str = "") -> str:
    """Expression for the income rank given a joined array ``breaks``."""
    below = f"len(list_filter(breaks, lambda b: b < {value}))"
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN {below} BETWEEN 1 AND {len(RANK_LABELS)} "
        f"THEN {_list(RANK_LABELS)}[{below}] WHEN {value} < {_d(floor)} THEN 0e0 ELSE 1e0 END"
    )


def _breaks(by: str = "") -> str:
    key = f"concat_ws(':', {by}, i)" if by else "i"
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group}list(q + {_u(key, s.SEED, 'break')} ORDER BY q + {_u(key, s.SEED, 'break')}) AS breaks "
        f"FROM q_out {'GROUP BY ' + by if by else ''}"
    )


def _feature_ctes() -> dict[str, str]:
    children = " OR ".join(f"(dep_age{n} IS NOT NULL AND dep_age{n} <= 17)" for n in (1, 2, 3))
    return {
        "positive": "SELECT * FROM incomes WHERE income > 0",
        **_quantiles("positive", "income", "weight", _list(RANK_PROBS)),
        "all_breaks": _breaks(),
        "features": f"""
            SELECT id, weight, age1 AS age, CAST(filing_status = 2 AS INTEGER) AS married,
                   CAST({children} AS INTEGER) AS has_kids,
                   {_bins('incomes', 'income', 100.0)} AS income_pctile
            FROM incomes, all_breaks""",
    }


def _moments() -> str:
    a, r = "((age - 50e0) / 32e0)", "((income_pctile - 0.5e0) * 2e0)"
    terms = [
        "1e0", "CAST(married AS DOUBLE)", a, f"({a} * {a})", r, f"({r} * {r})", f"{a} * {r}",
        f"({a} * {a}) * {r}", f"{a} * ({r} * {r})", f"({a} * {a}) * ({r} * {r})", "ln(inheritance)",
    ]
    columns = ", ".join(f"{t} AS t{i}" for i, t in enumerate(terms))
    k = len(terms)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round(sum(t{i} * t{j}), 6) AS moment FROM terms"
        for i in range(k)
        for j in range(i, k)
    )
    ctes = {**_feature_ctes(), "terms": f"SELECT {columns} FROM features JOIN imputed USING (id)"}
    return _with(rows, "incomes", "imputed", extra=ctes)


_SIZE = f"((SELECT count(*) FROM imputed) / {_d(s.BRACKET_UNITS)})"


def _promotion(state: str, out: str, n: int, low: str, average: str, deficit: str) -> dict[str, str]:
    """Subqueries that lift the top rows below ``low``; nothing happens where ``deficit`` is null."""
    lift = f"{average} * pow(1e0 - {_u('id', s.FIT_SEED, f'promote{n}')}, {_d(-1 / 1.5)})"
    return {
        f"top{n}": f"""
            SELECT id, p, w, {lift} AS lifted FROM {state}
            WHERE v < {low} AND v >= (SELECT quantile_cont(v, 0.95) FROM {state})
              AND {deficit} IS NOT NULL
            ORDER BY v DESC, id LIMIT 100""",
        f"share{n}": f"""
            SELECT CASE WHEN sum((1e0 - p) * w) > 0
                        THEN least(1e0, {deficit} / sum((1e0 - p) * w)) ELSE 0e0 END AS share FROM top{n}""",
        out: f"""
            SELECT {state}.id, {state}.w, coalesce(top{n}.lifted, {state}.v) AS v,
                   CASE WHEN top{n}.id IS NULL THEN {state}.p
                        ELSE {state}.p + share * (1e0 - {state}.p) END AS p
            FROM {state} LEFT JOIN top{n} ON {state}.id = top{n}.id, share{n}""",
    }


def _calibration_ctes(scale: float = 1.0) -> dict[str, str]:
    """``s0`` to the last bracket's state, from ``imputed``; brackets divided by ``scale``."""
    h = _d(s.HEIRS)
    ctes = {
        "s0": f"""
            SELECT id, weight AS w, inheritance AS v,
                   p_inheritance * CASE WHEN inheritance * {h} > 1e6 THEN 0.75e0 ELSE 1e0 END AS p
            FROM imputed"""
    }
    for n, b in enumerate(s.BRACKETS, start=1):
        low, average = f"({_d(b.low / scale)} / {h})", f"({_d(b.average / scale)} / {h})"
        high = "" if b.high is None else f" AND v < ({_d(b.high / scale)} / {h})"
        target = f"({_d(b.count)} * {_SIZE} * {h})"
        before = f"s{n - 1}"
        inside = f"(v >= {low}{high})"
        ctes[f"now{n}"] = f"SELECT sum(p * w) AS c FROM {before} WHERE {inside}"
        ctes[f"raised{n}"] = f"""
            SELECT id, w, v, {inside} AS inside,
                   CASE WHEN {inside} AND c > 0 AND c < {target}
                        THEN least(1e0, p * ({target} / c)) ELSE p END AS p
            FROM {before}, now{n}"""
        ctes[f"after{n}"] = f"""
            SELECT count(*) AS k, sum(p * w) AS c, sum(p * w * v) AS wealth
            FROM raised{n} WHERE inside"""
        ctes[f"scaled{n}"] = f"""
            SELECT id, w, p, CASE WHEN inside AND c > 0 AND wealth / c < {average}
                                  THEN v * ({average} / (wealth / c)) ELSE v END AS v
            FROM raised{n}, after{n}"""
        deficit = (
            f"(SELECT CASE WHEN k > 0 AND {target} - c > 1e-9 * {target} THEN {target} - c END FROM after{n})"
        )
        ctes.update(_promotion(f"scaled{n}", f"s{n}", n, low, average, deficit))
    return ctes


def _calibration() -> str:
    return _with(
        "SELECT id, w AS weight, round(p, 8) AS p_inheritance, round(v, 2) AS inheritance "
        f"FROM s{len(s.BRACKETS)}",
        "imputed",
        extra=_calibration_ctes(),
    )


def _top_k() -> str:
    h, b = _d(s.HEIRS), s.BRACKETS[1]
    low, high = f"({_d(b.low)} / {h})", f"({_d(b.high)} / {h})"
    deficit = (
        f"(SELECT {_d(b.count)} * {_SIZE} * {h} - coalesce(sum(p * w), 0e0) "
        f"FROM state WHERE v >= {low} AND v < {high})"
    )
    ctes = {
        "state": "SELECT id, weight AS w, inheritance AS v, p_inheritance AS p FROM imputed",
        **_promotion("state", "lifted", 2, low, f"({_d(b.average)} / {h})", deficit),
    }
    return _with(
        "SELECT id, w AS weight, round(p, 8) AS p_inheritance, round(v, 2) AS inheritance FROM lifted",
        "imputed",
        extra=ctes,
    )


def _tax(value: str, exemption: str) -> str:
    h = _d(s.HEIRS)
    return f"(greatest(0e0, {value} * {h} - {exemption}) * 0.4e0 / {h})"


def _report_body(source: str = "imputed", scale: float = 1.0, digits: int = 6) -> str:
    gross = f"inheritance * {_d(s.HEIRS)}"
    groups = " ".join(f"WHEN {gross} < {_d(e / scale)} THEN {i}" for i, e in enumerate(s.EDGES, start=1))
    mass = "p_inheritance * weight"
    measures = [
        f"round(sum({mass}), {digits}) AS n_inheritances",
        f"round(sum(inheritance * ({mass})) / 1e9, {digits + 3}) AS inheritances",
    ]
    for name, exemption in s.EXEMPTIONS.items():
        tax = _tax("inheritance", _d(exemption / scale))
        payers = f"sum(CASE WHEN {tax} > 0 THEN {mass} ELSE 0e0 END)"
        measures += [
            f"round(sum({tax} * ({mass})) / 1e9, {digits + 3}) AS amount_{name}",
            f"round({payers}, {digits}) AS count_heirs_{name}",
            f"round({payers} / {_d(s.HEIRS)}, {digits}) AS count_estates_{name}",
        ]
    return (
        f"SELECT CASE {groups} ELSE {len(s.EDGES) + 1} END AS gross_estate_group, {', '.join(measures)} "
        f"FROM {source} GROUP BY 1"
    )


def _report() -> str:
    return _with(_report_body(), "imputed")


def _calibrated_summary(scale: float = 20.0) -> str:
    """The report on the whole chain: forest, raking, amounts, matched quantiles, brackets."""
    scored = _impute_ctes(_forest())
    scored["scored_units"] = scored.pop("imputed")
    ctes = {
        **scored,
        "imputed_": "SELECT id, weight, p_inheritance, inheritance FROM scored_units",
        **_match_ctes("sampled", "imputed_"),
        "ranked": _RANKED.replace("FROM imputed", "FROM imputed_"),
        "matched": """
            SELECT x.id, x.weight, x.p_inheritance, x.inheritance * f.factor AS inheritance
            FROM imputed_ x JOIN ranked r ON x.id = r.id LEFT JOIN factors f ON r.rank = f.rank""",
        **{n: q.replace("FROM imputed", "FROM matched") for n, q in _calibration_ctes(scale).items()},
        "final": f"SELECT w AS weight, p AS p_inheritance, v AS inheritance FROM s{len(s.BRACKETS)}",
    }
    sql = _with(
        _report_body("final", scale, 4),
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra=ctes,
    )
    return _recursive(sql)


def _projection(factor: str = "1e0") -> str:
    scenarios = " UNION ALL ".join(
        f"SELECT '{name}' AS scenario, {_d(e)} AS exemption" for name, e in s.EXEMPTIONS.items()
    )
    grown = "(inheritance * gdp_pc_index)"
    return _with(
        f"""SELECT scenario, year, id, p_inheritance, round({grown} * {factor}, 2) AS inheritance,
                   round({_tax(grown, '(exemption * inflation_index)')}, 2) AS estate_tax_liability
            FROM imputed, indexes, ({scenarios})""",
        "imputed",
        "indexes",
    )


def _delta() -> str:
    before, after = (
        _tax("(inheritance * gdp_pc_index)", f"({_d(s.EXEMPTIONS[name])} * inflation_index)")
        for name in ("baseline", "reform")
    )
    return _with(
        f"SELECT id, year, round({before} - {after}, 2) AS estate_tax_change FROM imputed, indexes",
        "imputed", "indexes",
    )


def _aged_ctes() -> dict[str, str]:
    """Subqueries of the training table; ``trained`` is the table before rounding."""
    return {
        "aged": """
            SELECT t.* EXCLUDE (weight, inheritance), weight * demographic_factor AS weight,
                   inheritance * asset_factor AS inheritance
            FROM training t LEFT JOIN demographic_factor USING (survey_year, age, married)
            LEFT JOIN asset_factor USING (survey_year)""",
        "positive": "SELECT * FROM aged WHERE income > 0",
        **_quantiles("positive", "income", "weight", _list(RANK_PROBS), "survey_year"),
        "survey_breaks": _breaks("survey_year"),
        "trained": f"""
            SELECT survey_year, yy1, y1, dup_id, weight, least(age, 80) AS age, married, has_kids,
                   inheritance, has_inheritance, {_bins('aged', 'income', 1000.0)} AS income_pctile
            FROM aged JOIN survey_breaks USING (survey_year)""",
    }


def _training_table() -> str:
    return _with(
        """SELECT * REPLACE (round(weight, 8) AS weight, round(inheritance, 4) AS inheritance) FROM trained""",
        "training", "demographic_factor", "asset_factor",
        extra=_aged_ctes(),
    )


_TERMS = (
    "1e0", "CAST(married AS DOUBLE)", "{a}", "({a} * {a})", "{r}", "({r} * {r})", "{a} * {r}",
    "({a} * {a}) * {r}", "{a} * ({r} * {r})", "({a} * {a}) * ({r} * {r})",
)


def _design(age: str = "age") -> list[str]:
    a, r = f"(({age} - 50e0) / 32e0)", "((income_pctile - 0.5e0) * 2e0)"
    return [t.format(a=a, r=r) for t in _TERMS]


def _fit(rows: str, prefix: str) -> dict[str, str]:
    """Least squares of ``y`` on t0..t9 of ``rows``: normal equations, solved column by column.

    ``<prefix>_fit`` has one row with the list ``c`` of coefficients.
    """
    k = len(_TERMS)
    names = [f"t{i}" for i in range(k)] + ["y"]
    matrix = ", ".join(
        "[" + ", ".join(f"sum({names[i]} * {names[j]})" for j in range(k + 1)) + "]" for i in range(k)
    )
    return {
        f"{prefix}_steps": f"""
            SELECT 0 AS k, [{matrix}] AS m FROM {rows}
            UNION ALL
            SELECT k + 1, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = k + 1
                THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
                ELSE list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1])
                END)
            FROM {prefix}_steps WHERE k < {k}""",
        f"{prefix}_fit": f"SELECT list_transform(m, lambda row: row[{k + 1}]) AS c FROM {prefix}_steps WHERE k = {k}",
    }


def _predicted(fit: str) -> str:
    return " + ".join(f"{fit}.c[{i + 1}] * t{i}" for i in range(len(_TERMS)))


def _gini(n: str, pos: str) -> str:
    return f"(1e0 - pow({pos} / {n}, 2) - pow(({n} - {pos}) / {n}, 2))"


def _tree(depth: int = 3, least: int = 50, carried: str = "") -> dict[str, str]:
    """One classification tree on ``sampled``; ``scored_p`` has the share of 1s of each unit's leaf.

    Splits lie half way between neighbouring values of all rows; of equal gains the first one in the
    order of feature and value counts. Node k has the children 2k and 2k + 1.
    """
    features = ("CAST(age AS DOUBLE)", "CAST(married AS DOUBLE)", "income_pctile")
    pick = "CASE b.f " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features)) + " END"
    ctes = {
        "level0": f"SELECT age, married, income_pctile, has_inheritance AS y, {carried} 1 AS node FROM sampled",
        "walk0": "SELECT *, 1 AS node FROM features",
        "places": "SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM ("
        + " UNION ".join(f"SELECT {i} AS f, {f} AS v FROM level0" for i, f in enumerate(features)) + ")",
    }
    for d in range(depth):
        cells = " UNION ALL ".join(
            f"SELECT node, {i} AS f, {f} AS v, count(*) AS n, sum(y) AS pos FROM level{d} GROUP BY ALL"
            for i, f in enumerate(features)
        )
        ctes[f"cells{d}"] = cells
        ctes[f"tried{d}"] = f"""
            SELECT c.node, p.f, p.cut, sum(c.n) FILTER (c.v <= p.v) AS nl, coalesce(sum(c.pos) FILTER (c.v <= p.v), 0) AS pl,
                   sum(c.n) AS n, sum(c.pos) AS pos
            FROM cells{d} c JOIN places p ON c.f = p.f WHERE p.cut IS NOT NULL GROUP BY c.node, p.f, p.v, p.cut"""
        gain = (
            f"{_gini('n', 'pos')} - (nl / n) * {_gini('nl', 'pl')} - ((n - nl) / n) * {_gini('(n - nl)', '(pos - pl)')}"
        )
        ctes[f"best{d}"] = f"""
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 14) DESC, f, cut) AS k FROM (
                SELECT *, {gain} AS gain FROM tried{d} WHERE nl >= {least} AND n - nl >= {least}))
            WHERE k = 1 AND gain > 1e-15"""
        for kind in ("level", "walk"):
            ctes[f"{kind}{d + 1}"] = f"""
                SELECT x.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN x.node
                       WHEN {pick} <= b.cut THEN 2 * x.node ELSE 2 * x.node + 1 END AS node
                FROM {kind}{d} x LEFT JOIN best{d} b ON x.node = b.node"""
    ctes["leaves"] = f"SELECT node, sum(y) / count(*) AS p FROM level{depth} GROUP BY node"
    ctes["scored_p"] = f"SELECT w.*, p FROM walk{depth} w JOIN leaves USING (node)"
    return ctes


def _poisson(key: str, seed: int, n: str = "n") -> str:
    """Keyed Poisson number with mean ``n``: from its distribution up to a bound, by the normal beyond."""
    u, z = _u(key, seed, "bootstrap"), (
        f"(sqrt(-2e0 * ln(1e0 - {_u(key, seed, 'bootstrap1')})) * cos(2e0 * pi() * {_u(key, seed, 'bootstrap2')}))"
    )
    limits = "[" + ", ".join(_list(poisson_limits(k)) for k in range(1, EXACT_COUNT + 1)) + "]"
    return (
        f"CASE WHEN {n} <= {EXACT_COUNT} THEN len(list_filter(list_transform(({limits})[{n}], lambda x: x - {u}), lambda x: x <= 0))"
        f" ELSE greatest(floor({n} + sqrt({n}) * {z} + ({z} * {z} - 1e0) / 6e0 + 0.5e0), 0) END"
    )


def _forest(trees: int = 100, depth: int = 30, least: int = 50) -> dict[str, str]:
    """``scored_p``: mean over keyed trees of the share of 1s in each unit's leaf.

    The cells of all trees go down together, a level a step; cells of units weigh nothing and only follow the splits.
    """
    where = "CASE b.f WHEN 0 THEN x.f0 WHEN 1 THEN x.f1 ELSE x.f2 END"
    columns = " UNION ALL ".join(f"SELECT tree, node, {i} AS f, f{i} AS v, w, s FROM forest_walk" for i in range(3))

    def impurity(n: str, s: str) -> str:
        return f"({s} / {n} - ({s} / {n}) * ({s} / {n}))"

    gain = (
        f"{impurity('n', 's')} - nl / n * {impurity('nl', 'sl')} - (n - nl) / n * {impurity('(n - nl)', '(s - sl)')}"
    )
    cells = "CAST(age AS DOUBLE) AS f0, CAST(married AS DOUBLE) AS f1, income_pctile AS f2"
    return {
        "atoms": f"SELECT {cells}, CAST(has_inheritance AS DOUBLE) AS y, count(*) AS n FROM sampled GROUP BY ALL",
        "forest_cells": f"""
            SELECT tree, f0, f1, f2, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(w * y) AS DOUBLE) AS s FROM (
                SELECT tree, f0, f1, f2, y, {_poisson("f0, f1, f2, y, tree", s.SEED)} AS w
                FROM atoms, (SELECT CAST(range AS INTEGER) AS tree FROM range({trees}))
                UNION ALL SELECT DISTINCT tree, {cells}, 0e0, 0e0 FROM features, (SELECT CAST(range AS INTEGER) AS tree FROM range({trees})))
            GROUP BY ALL""",
        "forest_places": "SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM ("
        + " UNION ".join(f"SELECT {i} AS f, f{i} AS v FROM atoms" for i in range(3)) + ")",
        "forest_walk": f"""
            SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS d, f0, f1, f2, w, s FROM forest_cells
            UNION ALL
            SELECT x.tree, 2 * x.node + CASE WHEN {where} <= b.cut THEN 0 ELSE 1 END, x.d + 1, x.f0, x.f1, x.f2, x.w, x.s
            FROM forest_walk x JOIN (
                SELECT tree, node, f, cut FROM (
                    SELECT *, round({gain}, 14) AS gain FROM (
                        SELECT h.*, p.cut, sum(hn) OVER upto AS nl, sum(hs) OVER upto AS sl, sum(hn) OVER whole AS n, sum(hs) OVER whole AS s
                        FROM (SELECT tree, node, f, v, sum(w) AS hn, sum(s) AS hs FROM ({columns}) GROUP BY ALL) h
                        LEFT JOIN forest_places p ON h.f = p.f AND h.v = p.v
                        WINDOW upto AS (PARTITION BY tree, node, h.f ORDER BY h.v), whole AS (PARTITION BY tree, node, h.f))
                    WHERE cut IS NOT NULL AND nl >= {least} AND n - nl >= {least})
                WHERE gain > 1e-15
                QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, cut) = 1
            ) b ON x.tree = b.tree AND x.node = b.node WHERE x.d < {depth}""",
        "forest_nodes": "SELECT tree, node, sum(s) / sum(w) AS p FROM forest_walk GROUP BY ALL",
        "forest_leaves": "SELECT tree, f0, f1, f2, arg_max(node, d) AS node FROM forest_walk GROUP BY ALL",
        "forest_mean": """
            SELECT f0, f1, f2, avg(p) AS p FROM forest_leaves l JOIN forest_nodes n ON l.tree = n.tree AND l.node = n.node
            GROUP BY ALL""",
        "scored_p": """
            SELECT x.*, p FROM features x JOIN forest_mean m ON x.age = m.f0 AND x.married = m.f1 AND x.income_pctile = m.f2""",
    }


def _forest_probability() -> str:
    sql = _with(
        "SELECT id, round(p, 8) AS p_inheritance FROM scored_p",
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra={**_model_ctes(), **_forest()},
    )
    return _recursive(sql)


def _tree_distribution(bound: float, probs: tuple[float, ...], depth: int = 3) -> str:
    """Mean, quantiles and share above a bound of the amounts in each unit's leaf."""
    quantiles = ", ".join(f"round(min(amount) FILTER (cum >= {p!r}::DOUBLE - 1e-12), 4) AS q{i}" for i, p in enumerate(probs))
    ctes = {
        **_model_ctes(), **_tree(depth, carried="inheritance AS amount,"),
        "shares": f"SELECT node, amount, count(*) / sum(count(*)) OVER (PARTITION BY node) AS share FROM level{depth} GROUP BY node, amount",
        "reached": "SELECT *, sum(share) OVER (PARTITION BY node ORDER BY amount) AS cum FROM shares",
        "answers": f"""
            SELECT node, round(sum(amount * share), 4) AS mean, {quantiles},
                   round(coalesce(sum(share) FILTER (amount > {_d(bound)}), 0), 8) AS above0
            FROM reached GROUP BY node""",
    }
    sql = _with(
        f"SELECT w.id, a.* EXCLUDE (node) FROM walk{depth} w JOIN answers a USING (node)",
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra=ctes,
    )
    return _recursive(sql)


def _tree_probability() -> str:
    sql = _with(
        "SELECT id, round(p, 8) AS p_inheritance FROM scored_p",
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra={**_model_ctes(), **_tree()},
    )
    return _recursive(sql)


def _impute_ctes(scoring: dict[str, str]) -> dict[str, str]:
    """Chances of ``scoring`` raked to the sample, and lognormal amounts: ``imputed``."""
    z = (
        f"(sqrt(-2e0 * ln(1e0 - {_u('id', s.FIT_SEED, 'z1')})) * cos(2e0 * pi() * {_u('id', s.FIT_SEED, 'z2')}))"
    )
    return {
        **_model_ctes(), **scoring,
        "wanted": f"""
            SELECT married, age // 5 * 5 AS age_group, sum(has_inheritance * weight) / {len(s.WAVES)}e0 AS actual
            FROM drawn GROUP BY ALL""",
        "masses": "SELECT married, age // 5 * 5 AS age_group, sum(weight * p) AS mass FROM scored_p GROUP BY ALL",
        "amounts": f"""
            SELECT scored.id, {_predicted('mu_fit')} AS mu, sqrt(exp({_predicted('sigma_fit')})) AS sigma
            FROM scored, mu_fit, sigma_fit""",
        "imputed": f"""
            SELECT x.*, p * coalesce(actual / mass, 1e0) AS p_inheritance, mu, sigma, exp(mu + sigma * {z.replace('id', 'x.id')}) AS inheritance
            FROM scored_p x JOIN amounts a ON x.id = a.id
            LEFT JOIN masses m ON x.married = m.married AND x.age // 5 * 5 = m.age_group
            LEFT JOIN wanted w ON x.married = w.married AND x.age // 5 * 5 = w.age_group""",
    }


def _impute(scoring: dict[str, str]) -> str:
    sql = _with(
        """SELECT id, round(p_inheritance, 8) AS p_inheritance, round(mu, 6) AS mu_pred, round(sigma, 6) AS sigma_pred,
                  round(inheritance, 2) AS inheritance
           FROM imputed""",
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra=_impute_ctes(scoring),
    )
    return _recursive(sql)


def _recursive(sql: str) -> str:
    """Allow the two solvers to refer to themselves."""
    sql = sql.replace("WITH ", "WITH RECURSIVE ", 1)
    for name in ("mu_steps", "sigma_steps", "forest_walk"):
        sql = sql.replace(f"{name} AS MATERIALIZED", f"{name} AS")
    return sql


def _model_ctes() -> dict[str, str]:
    """Subqueries up to the drawn sample, both regressions and the units to score."""
    key = "concat_ws(':', survey_year, yy1, y1, dup_id)"
    terms = ", ".join(f"{t} AS t{i}" for i, t in enumerate(_design()))
    scored = ", ".join(f"{t} AS t{i}" for i, t in enumerate(_design()))
    features = {("unit_" + n if n == "positive" else n): q for n, q in _feature_ctes().items()}
    features = {n: q.replace("FROM positive", "FROM unit_positive") for n, q in features.items()}
    survey = _aged_ctes()
    quantiles = {f"s_{n}": q for n, q in survey.items() if n.startswith("q_")}
    survey = {n: q for n, q in survey.items() if not n.startswith("q_")}
    for old in ("q_dist", "q_pos", "q_out"):
        quantiles = {n: q.replace(old, f"s_{old}") for n, q in quantiles.items()}
        survey = {n: q.replace(old, f"s_{old}") for n, q in survey.items()}
    ctes = {
        "aged": survey.pop("aged"), "positive": survey.pop("positive"), **quantiles, **survey,
        "placed": f"""
            SELECT *, cum - weight AS start FROM (
                SELECT *, sum(weight) OVER (ORDER BY {_u(key, 0, 'tie')}, survey_year, yy1, y1, dup_id
                                            ROWS UNBOUNDED PRECEDING) AS cum FROM trained WHERE weight > 0)""",
        "points": f"""
            SELECT {_u('k', s.SEED, 'resample')} * (SELECT max(cum) FROM placed) AS t
            FROM range(0, 5 * (SELECT count(*) FROM summary)) AS numbers(k)""",
        "sampled": "SELECT placed.* FROM points ASOF JOIN placed ON t >= start",
        "drawn": """
            SELECT * EXCLUDE (weight), (SELECT max(cum) FROM placed) / (SELECT count(*) FROM points) AS weight
            FROM sampled""",
        "rows_mu": f"SELECT {terms}, ln(inheritance) AS y FROM sampled WHERE inheritance > 0",
        **_fit("rows_mu", "mu"),
        "rows_sigma": f"""
            SELECT * REPLACE (ln(e * e) AS y) FROM (
                SELECT r.*, y - ({_predicted('mu_fit')}) AS e FROM rows_mu r, mu_fit) WHERE e <> 0""",
        **_fit("rows_sigma", "sigma"),
        **{n: q for n, q in features.items() if n != "features"},
        "features": features["features"].replace("age1 AS age", "least(age1, 80) AS age"),
        "scored": f"SELECT id, {scored} FROM features",
    }
    return ctes


def _value_model() -> str:
    sql = _with(
        f"""SELECT id, round({_predicted('mu_fit')}, 6) AS mu_pred,
                   round(sqrt(exp({_predicted('sigma_fit')})), 6) AS sigma_pred
            FROM scored, mu_fit, sigma_fit""",
        "summary", "training", "demographic_factor", "asset_factor", "incomes",
        extra=_model_ctes(),
    )
    return _recursive(sql)


def _match_ctes(actual: str = "training", predicted: str = "imputed") -> dict[str, str]:
    grid = "list_transform(range(0, 1001), lambda x: x / 1000e0)"
    return {
        "actual_rows": f"SELECT inheritance, 1e0 AS w FROM {actual} WHERE inheritance > 0",
        **_renamed(_quantiles("actual_rows", "inheritance", "w", grid), "a_"),
        "predicted_rows": f"SELECT inheritance, weight * p_inheritance AS w FROM {predicted} WHERE inheritance > 0",
        **_renamed(_quantiles("predicted_rows", "inheritance", "w", grid), "p_"),
        "factors": """
            SELECT CAST(a.i AS INTEGER) AS rank, a.q AS actual, p.q AS predicted, a.q / p.q AS factor
            FROM a_q_out a LEFT JOIN p_q_out p ON a.i = p.i""",
    }


_RANKED = f"""
    SELECT id, inheritance, CAST(floor((2000e0 * cum + total) / (2e0 * total)) AS INTEGER) AS rank FROM (
        SELECT id, inheritance, sum(weight) OVER () AS total,
               sum(weight) OVER (ORDER BY inheritance, {_u('id', 0, 'tie')}, id
                                 ROWS UNBOUNDED PRECEDING) AS cum
        FROM imputed)"""


def all_sql() -> dict[str, str]:
    """Query name to SQL."""
    possible = "value > 0 AND type <> 3 AND p > 0"
    wide = ", ".join(
        f"max({m}) FILTER (WHERE n = {n}) AS {m}_{n}" for n in (1, 2, 3) for m in ("value", "p")
    )
    timed = f"SELECT *, {_timing('survey_year', 'year')} AS p FROM events"
    taxes = {name: _tax("inheritance", _d(e)) for name, e in s.EXEMPTIONS.items()}
    return {
        "scan_csv_roundtrip": _with("SELECT * FROM units", "units"),
        "scenario_sink_roundtrip": _projection(),
        "scenario_sink_rerun": _projection(f"CASE WHEN year = {s.RERUN_YEAR} THEN 2e0 ELSE 1e0 END"),
        "multi_source_union": _with(
            "SELECT year, gdp, CASE WHEN year >= 1999 THEN cpiu END AS cpiu, ccpiu_irs FROM economic",
            "economic",
        ),
        "macro_files_read": _with(
            "SELECT * FROM economic JOIN population USING (year)", "economic", "population"
        ),
        "survey_files_read": _with("SELECT * FROM surveys", "surveys"),
        "survey_table_read": _with("SELECT * FROM surveys", "surveys"),
        "cast_failures": _with(
            " UNION ALL ".join(
                f"SELECT '{f.name}' AS \"column\", count(*) FILTER (id % {every} = 0) AS failed FROM units" if every else
                f"SELECT '{f.name}', 0 FROM (SELECT 1)"
                for f in TAX_UNITS.fields for every in [{"age1": 17, "wages": 11, "dep_age1": 13}.get(f.name)]
            ).replace("SELECT 'id', 0", "SELECT 'id' AS \"column\", 0 AS failed", 1),
            "units",
        ),
        "net_worth_file_read": _with("SELECT * FROM quarterly", "quarterly"),
        "tax_unit_file_read": _with(
            "SELECT id, weight, age1, filing_status, dep_age1, dep_age2, dep_age3, income FROM incomes", "incomes"
        ),
        "projection_delta": _delta(),
        "population_by_year": _with("SELECT * FROM population", "population"),
        "demographic_long": _with("SELECT * FROM demographic", "demographic"),
        "demographic_factor": _with(
            "SELECT survey_year, age, married, round(demographic_factor, 10) AS demographic_factor "
            "FROM demographic_factor",
            "demographic_factor",
        ),
        "networth_per_capita": _with(
            "SELECT year, round(net_worth_pc, 4) AS net_worth_pc FROM net_worth", "net_worth"
        ),
        "projection_indexes": _with(
            "SELECT year, round(inflation_index, 10) AS inflation_index, "
            "round(gdp_pc_index, 10) AS gdp_pc_index FROM indexes",
            "indexes",
        ),
        "indexed_exemptions": _with(
            "SELECT year, "
            + ", ".join(
                f"round({_d(e)} * inflation_index, 4) AS {name}_exemption" for name, e in s.EXEMPTIONS.items()
            )
            + " FROM indexes",
            "indexes",
        ),
        "survey_waves": _with("SELECT * FROM surveys", "surveys"),
        "duplicate_reweight": _with(
            "SELECT summary.* EXCLUDE (weight), weight / 5e0 AS weight, CAST(k AS INTEGER) AS dup_id "
            "FROM summary, range(1, 6) AS numbers(k)",
            "summary",
        ),
        "inheritance_events": _with("SELECT * FROM events", "events"),
        "timing_probability": _with(timed, "events"),
        "inheritance_wide": _with(
            f"SELECT survey_year, yy1, y1, {wide} FROM ({timed}) WHERE {possible} GROUP BY ALL", "events"
        ),
        "inheritance_realise": _with(
            "SELECT survey_year, yy1, y1, dup_id, "
            f"greatest({_drawn(1)}, {_drawn(2)}, {_drawn(3)}) AS inheritance FROM copies "
            f"WHERE coalesce({_drawn(1)}, {_drawn(2)}, {_drawn(3)}) IS NOT NULL",
            "copies",
        ),
        "training_frame": _with("SELECT * FROM training", "training"),
        "age_weights_forward": _with(
            "SELECT survey_year, yy1, y1, age, married, round(weight * demographic_factor, 8) AS weight "
            "FROM summary LEFT JOIN demographic_factor USING (survey_year, age, married)",
            "summary", "demographic_factor",
        ),
        "age_values_forward": _with(
            "SELECT survey_year, yy1, y1, dup_id, round(inheritance * asset_factor, 4) AS inheritance "
            "FROM training LEFT JOIN asset_factor USING (survey_year)",
            "training", "asset_factor",
        ),
        "training_table": _training_table(),
        "unit_features": _with("SELECT * FROM features", "incomes", extra=_feature_ctes()),
        "income_rank_bins": _with(
            f"SELECT survey_year, y1, income, {_bins('summary', 'income', 1000.0)} AS income_pctile "
            "FROM summary JOIN all_breaks USING (survey_year)",
            "summary",
            extra={
                "positive": "SELECT * FROM summary WHERE income > 0",
                **_quantiles("positive", "income", "weight", _list(RANK_PROBS), "survey_year"),
                "all_breaks": _breaks("survey_year"),
            },
        ),
        "weighted_quantiles": _with(
            "SELECT filing_status, CAST(i AS INTEGER) AS prob_index, p AS prob, round(q, 6) AS quantile FROM q_out",
            "incomes",
            extra=_quantiles("incomes", "income", "weight", _list(RANK_PROBS), "filing_status"),
        ),
        "quantile_grid": _with(
            "SELECT CAST(i AS INTEGER) AS prob_index, p AS prob, round(q, 6) AS quantile FROM q_out",
            "imputed",
            extra=_quantiles(
                "imputed", "inheritance", "weight", "list_transform(range(0, 1001), lambda x: x / 1000e0)"
            ),
        ),
        "weighted_rank": _with(_RANKED, "imputed"),
        "weighted_resample": _with(
            f"""SELECT k AS draw_id, id, age1, round(total / n, 8) AS weight FROM (
                    SELECT k, {_u('k', s.SEED, 'resample')} * total AS t, total, n
                    FROM axis, range(0, (SELECT count(*) FROM units)) AS numbers(k))
                JOIN rows ON t >= cum - weight AND t < cum""",
            "units",
            extra={
                "rows": f"""SELECT id, age1, weight, sum(weight) OVER (
                        ORDER BY {_u('id', 0, 'tie')}, id ROWS UNBOUNDED PRECEDING) AS cum FROM units""",
                "axis": "SELECT sum(weight) AS total, count(*) AS n FROM units",
            },
        ),
        "hurdle_value_model": _value_model(),
        "tree_probability": _tree_probability(),
        "reloaded_tree": _tree_probability(),
        "tree_distribution": _tree_distribution(s.DISTRIBUTION_BOUND, s.DISTRIBUTION_PROBS),
        "tree_impute": _impute(_tree()),
        "forest_probability": _forest_probability(),
        "hurdle_impute": _impute(_forest()),
        "calibrated_summary": _calibrated_summary(),
        "impute_amounts": _with("SELECT id, p_inheritance, inheritance FROM imputed", "imputed"),
        "rake_targets": _with(
            "SELECT married, age_group, round(actual, 6) AS actual FROM targets", "targets"
        ),
        "rake_to_targets": _with(
            """SELECT id, u.married, u.age_group, round(p * (actual / mass), 9) AS p_inheritance
               FROM cells_of u JOIN (SELECT married, age_group, sum(p * weight) AS mass
                                     FROM cells_of GROUP BY ALL) c USING (married, age_group)
               LEFT JOIN targets USING (married, age_group)""",
            "imputed", "targets",
            extra={
                "cells_of": """SELECT id, weight, p_inheritance AS p,
                    CAST(filing_status = 2 AS INTEGER) AS married,
                    CAST(age1 // 5 * 5 AS INTEGER) AS age_group FROM imputed"""
            },
        ),
        "quantile_match_factors": _with(
            "SELECT rank, round(actual, 6) AS actual, round(predicted, 4) AS predicted, "
            "round(factor, 8) AS factor FROM factors",
            "training", "imputed",
            extra=_match_ctes(),
        ),
        "quantile_match_apply": _with(
            "SELECT id, round(inheritance * factor, 2) AS inheritance FROM ranked LEFT JOIN factors USING (rank)",
            "training", "imputed",
            extra={**_match_ctes(), "ranked": _RANKED},
        ),
        "bracket_calibrate": _calibration(),
        "top_k_promotion": _top_k(),
        "bracket_summary": _report(),
        "scenario_liability": _with(
            "SELECT id, inheritance, "
            + ", ".join(f"round({tax}, 4) AS {name}_tax" for name, tax in taxes.items())
            + " FROM imputed",
            "imputed",
        ),
        "scenario_delta": _with(
            f"SELECT id, round({taxes['baseline']} - {taxes['reform']}, 4) AS estate_tax_change FROM imputed",
            "imputed",
        ),
        "scenario_projection": _projection(),
        "ols_moments": _moments(),
    }
