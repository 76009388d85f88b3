"""SQL of regression trees, level by level: each level is a set of common table expressions."""


def grow_sql(p: str, rows: str, depth: int, width: int, reg_lambda: float = 0.0, gamma: float | None = None) -> list[str]:
    """Levels of trees over `rows` (t, r, w, s, x, node); the last, {p}{depth}, has the leaves as nodes."""
    ctes = [f"{p}0 AS (SELECT * FROM {rows})"]
    square = lambda s, n: f"CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / ({n} + {float(reg_lambda)})"
    for d in range(depth):
        keep = "least < most" if gamma is None else f"won > {float(gamma)}"
        ctes += [
            f"""{p}v{d} AS (SELECT t, node, f, v, sum(w) AS n, sum(w * s) AS s FROM (
                  SELECT t, node, w, s, unnest(x) AS v, unnest(range({width})) AS f FROM {p}{d} WHERE w > 0) GROUP BY ALL)""",
            f"{p}q{d} AS (SELECT t, node, min(s) AS least, max(s) AS most, sum(w) AS n0, sum(w * s) AS s0 FROM {p}{d} WHERE w > 0 GROUP BY ALL)",
            f"""{p}g{d} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, lead(v) OVER w AS nv FROM {p}v{d}
                  WINDOW w AS (PARTITION BY t, node, f ORDER BY v))""",
            f"""{p}b{d} AS MATERIALIZED (SELECT t, node, b.f AS f, (b.v + b.nv) / 2 AS cut, won FROM (
                  SELECT t, node, least, most, min({{'loss': -gain, 'f': f, 'v': v, 'nv': nv}}) AS b,
                    -min({{'loss': -gain, 'f': f, 'v': v, 'nv': nv}}).loss - ({square('any_value(s0)', 'any_value(n0)')}) AS won
                  FROM (SELECT g.*, least, most, n0, s0, {square('sl', 'nl')} + {square('(s0 - sl)', '(n0 - nl)')} AS gain
                        FROM {p}g{d} g JOIN {p}q{d} q USING (t, node) WHERE nv IS NOT NULL)
                  GROUP BY t, node, least, most) WHERE {keep})""",
            f"""{p}{d + 1} AS MATERIALIZED (SELECT a.t, r, w, s, x,
                  a.node || CASE WHEN f IS NULL THEN '' WHEN x[f + 1] > cut THEN '1' ELSE '0' END AS node
                FROM {p}{d} a LEFT JOIN {p}b{d} b ON a.t = b.t AND a.node = b.node)""",
        ]
    return ctes


def leaves_sql(p: str, depth: int, unit: str = "1e-6", reg_lambda: float = 0.0) -> str:
    """(t, r, value): the leaf value of each row."""
    return f"""SELECT t, r, value FROM {p}{depth} JOIN (SELECT t, node, CAST(sum(w * s) AS DOUBLE) * {unit} / (sum(w) + {float(reg_lambda)}) AS value
      FROM {p}{depth} GROUP BY ALL HAVING sum(w) > 0) USING (t, node)"""


def splits_sql(p: str, depth: int) -> str:
    """(t, f, won): every split."""
    return " UNION ALL ".join(f"SELECT t, f, won FROM {p}b{d}" for d in range(depth))


def poisson_sql(key: str, tree: str) -> str:
    """Bootstrap weight of a row in a tree."""
    from areastats.operators.trees import POISSON

    draw = f"(CAST('0x' || substr(md5({key} || '|' || {tree}), 1, 8) AS BIGINT) / 4294967296.0)"
    return " + ".join(f"CAST({draw} >= {p!r} AS BIGINT)" for p in POISSON)
