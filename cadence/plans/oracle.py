"""DuckDB SQL fragments used by the oracle queries (``oracle_sql``).

They restate in plain SQL what the Spark operators compute, over the same
driver tables; they never run on Spark.
"""

# Events as a cycle table, with the time split and the strict next-cycle gap
# (global order: cycle number, whole seconds, stream id; cap 300 s).
EVENTS_BASE = "SELECT user_id AS A, event_id AS B, ts AS C, event_type AS D, value FROM events WHERE ts IS NOT NULL"

# The time as the six-layout text parses back: minutes for two layouts,
# seconds for the others, nothing for the 'error' rows (unparsable text).
TEXT_TIME = ("CASE WHEN event_id % 6 < 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END")
EVENTS_TEXT_BASE = (f"SELECT user_id AS A, event_id AS B, {TEXT_TIME} AS C, event_type AS D, value "
                    "FROM events WHERE event_type <> 'error'")

_EVENTS_CT_TEMPLATE = """
e AS (__BASE__),
q AS (SELECT quantile_disc(C, 0.70) AS q1, quantile_disc(C, 0.85) AS q2 FROM e),
s AS (SELECT e.*, CASE WHEN C <= q1 THEN 'train' WHEN C <= q2 THEN 'val' ELSE 'test' END AS split
      FROM e CROSS JOIN q),
l AS (SELECT *, lead(C) OVER w AS next_ts, lead(B) OVER w AS next_b FROM s
      WINDOW w AS (ORDER BY coalesce(B, CAST(floor(epoch(C)) AS BIGINT)), floor(epoch(C)), A)),
g AS (SELECT *, CASE WHEN B IS NOT NULL AND next_b IS NOT NULL AND next_b - B = 1
                THEN CAST(floor(epoch(next_ts)) - floor(epoch(C)) AS DOUBLE) END AS gap FROM l),
ct AS (SELECT A, B, C, D, value, split, next_ts,
              CASE WHEN gap > 0 AND gap <= 300 THEN gap END AS CycleTime_sec FROM g),
feat AS (SELECT * FROM ct WHERE CycleTime_sec IS NOT NULL)
"""


def events_ct(base: str = EVENTS_BASE) -> str:
    return _EVENTS_CT_TEMPLATE.replace("__BASE__", base)


EVENTS_CT = events_ct()


def with_ctes(*fragments: str) -> str:
    return "WITH " + ",\n".join(f.strip().rstrip(",") for f in fragments) + "\n"


def rounded(sql: str, doubles: list[str], digits: int = 8) -> str:
    """Round the named double columns exactly as the Spark side does (8
    significant digits, same IEEE operations; -0.0 -> 0.0)."""
    if not doubles:
        return sql
    reps = []
    for c in doubles:
        x = f"CAST({c} AS DOUBLE)"
        scale = f"pow(CAST(10.0 AS DOUBLE), {digits - 1} - floor(log10(abs({x}))))"
        reps.append(f"CASE WHEN {c} IS NULL THEN NULL WHEN isnan({x}) OR isinf({x}) THEN {x} "
                    f"WHEN {x} = 0 THEN CAST(0.0 AS DOUBLE) "
                    f"ELSE floor({x} * {scale} + CAST(0.5 AS DOUBLE)) / {scale} + CAST(0.0 AS DOUBLE) END AS {c}")
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM ({sql}) AS _o"



def ts_text(col: str) -> str:
    """Timestamp as text, as ``cadence.plans.registry.ts_text`` writes it."""
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


# The events cycle table with its split, before any target (all parsed rows).
EVENTS_SPLIT = """
e AS (SELECT user_id AS A, event_id AS B, ts AS C, event_type AS D, value FROM events WHERE ts IS NOT NULL),
q AS (SELECT quantile_disc(C, 0.70) AS q1, quantile_disc(C, 0.85) AS q2 FROM e),
s AS (SELECT e.*, CASE WHEN C <= q1 THEN 'train' WHEN C <= q2 THEN 'val' ELSE 'test' END AS split
      FROM e CROSS JOIN q)
"""

ORDER_KEY = "coalesce(B, CAST(floor(epoch(C)) AS BIGINT))"
GAP = "CAST(floor(epoch(next_ts)) - floor(epoch(C)) AS DOUBLE)"


def md5_unit(expr: str, seed: int = 42) -> str:
    """The seeded unit number of ``cadence.operators.splits.seeded_unit``."""
    return (f"(CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) "
            f"/ 4294967296.0)")


REG_LINES = f"""
rl0 AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, l_quantity,
               l_discount, l_tax, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS tax_ratio,
               l_extendedprice AS y FROM lineitem),
rl AS (SELECT *, CASE WHEN {md5_unit('row_key')} < 0.7 THEN 'train'
                      WHEN {md5_unit('row_key')} < 0.85 THEN 'val' ELSE 'test' END AS split FROM rl0)
"""


#: ``cadence.plans.views.reg_signal``.
REG_SIGNAL = REG_LINES.replace("rl AS (SELECT *,", "rl AS (SELECT * REPLACE ("
    "CASE WHEN l_quantity > 25 THEN 1000.0 ELSE 0.0 END + l_quantity * l_discount * 400.0 + "
    f"({md5_unit('row_key', 7)} - 0.5) * 100.0 AS y),")


# --- linear systems of any width, for ridge and logistic regression on windows ----------------

def _sums(names: list[str], weight: str, response: str, alpha: float = 0.0, free: int = 0) -> str:
    """Columns a{i}_{j} (weighted products of ``names``, with ``alpha`` on the diagonal behind the
    first ``free`` ones) and r{i} (products with ``response``), i and j from 1."""
    cols = []
    for i, x in enumerate(names, 1):
        for j, z in enumerate(names, 1):
            ridge = f" + {alpha}" if alpha and i == j and i > free else ""
            cols.append(f"sum({weight} * {x} * {z}){ridge} AS a{i}_{j}")
        cols.append(f"sum({response} * {x}) AS r{i}")
    return ", ".join(cols)


def solved(src: str, n: int) -> str:
    """Query with the solution x1 .. xn of the one row (a{i}_{j}, r{i}) of ``src``, by elimination
    without pivoting (the matrices are symmetric and positive definite)."""
    q = f"SELECT * FROM {src}"
    every = range(1, n + 1)
    for k in every:
        cols = [f"a{i}_{i}" for i in range(1, k + 1)]
        for i in every:
            less = f"- a{i}_{k} / a{k}_{k} * " if i != k else None
            cols += [f"a{i}_{j} {less}a{k}_{j} AS a{i}_{j}" if less else f"a{i}_{j}"
                     for j in range(k + 1, n + 1)]
            cols.append(f"r{i} {less}r{k} AS r{i}" if less else f"r{i}")
        q = f"SELECT {', '.join(cols)} FROM ({q})"
    return f"SELECT {', '.join(f'r{i} / a{i}_{i} AS x{i}' for i in every)} FROM ({q})"


def wide_ridge(src: str, names: list[str], alpha: float = 1.0) -> str:
    """Ridge of y on ``names`` over the train rows of ``src``: ``b`` holds b0, w1 .. and the train
    means a1 ..; ``p`` the rows of ``src`` with them and ``pred``."""
    n = len(names)
    every = range(1, n + 1)
    centred = [f"({x} - a{i})" for i, x in enumerate(names, 1)]
    line = " + ".join(f"w{i} * {x}" for i, x in enumerate(names, 1))
    return f"""
m AS (SELECT {', '.join(f'avg({x}) AS a{i}' for i, x in enumerate(names, 1))}, avg(y) AS ay FROM {src}
      WHERE split = 'train'),
c AS MATERIALIZED (SELECT {_sums(centred, '1', '(y - ay)', alpha)} FROM {src} CROSS JOIN m WHERE split = 'train'),
w AS ({solved('c', n)}),
b AS MATERIALIZED (SELECT ay - {' - '.join(f'x{i} * a{i}' for i in every)} AS b0,
     {', '.join(f'x{i} AS w{i}, a{i}' for i in every)} FROM w CROSS JOIN m),
p AS (SELECT {src}.*, b0 + {line} AS pred, {', '.join(f'w{i}, a{i}' for i in every)} FROM {src} CROSS JOIN b)"""


def logit_newton(src: str, names: list[str], steps: int = 9) -> str:
    """Newton steps of the weighted logistic regression of is_long (weights wt) on ``names`` over the
    train rows of ``src``, from zero: ``lt`` holds t0 (intercept), t1 ..."""
    n = len(names) + 1
    xs = ["1.0", *names]
    line = " + ".join(f"t{i} * {x}" for i, x in enumerate(xs))
    out = [f"l0 AS MATERIALIZED (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS t{i}' for i in range(n))})"]
    for s in range(steps):
        out.append(f"g{s} AS MATERIALIZED (SELECT {_sums(xs, 'wt * q * (1 - q)', 'wt * (is_long - q)')} FROM ("
                   f"SELECT {src}.*, 1 / (1 + exp(-({line}))) AS q FROM {src} CROSS JOIN l{s} WHERE split = 'train'))")
        out.append(f"l{s + 1} AS MATERIALIZED (SELECT {', '.join(f't{i} + x{i + 1} AS t{i}' for i in range(n))} "
                   f"FROM ({solved(f'g{s}', n)}) CROSS JOIN l{s})")
    out.append(f"lt AS (SELECT * FROM l{steps})")
    return ",\n".join(out)
