"""SQL with the results of the registered queries, written for the test tables in one chain of CTEs."""

from __future__ import annotations

from checks.outputs import sql_output

START, TRAIN, VALIDATION, RECENT, END, AS_OF = (
    f"DATE '{d}'" for d in ("1995-01-01", "1998-12-31", "2000-06-30", "2001-01-01", "2001-12-31", "2002-01-01")
)
BY_STOCK = "PARTITION BY permno ORDER BY date"
ROW_ORDER = "permno, gvkey NULLS FIRST, lpermno NULLS FIRST, datadate NULLS FIRST"
CORE = ("momentum_12", "log_size", "value")
FULL = (
    "momentum_12", "momentum_count", "momentum_6", "momentum_36", "reversal", "beta_lag", "beta_shrink_lag",
    "beta_lag_square", "beta_shrink_lag_square", "size", "log_size", "revt", "be", "value", "dvol", "turn", "ep", "sp",
    "at_growth", "ni_growth", "revt_growth", "current_ratio",
)
CARRIED = ("ret", "permno", "date", "year", "month", "size", "total_mktcap", "weight_mktcap")


def back(far: int, near: int) -> str:
    return f"OVER ({BY_STOCK} ROWS BETWEEN {far} PRECEDING AND {near or 'CURRENT'} {'PRECEDING' if near else 'ROW'})"


def present(columns) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def samples(date: str = "date") -> str:
    """Sub-query naming each sample and its bounds."""
    return f"""(VALUES ('train', DATE '0001-01-01', {TRAIN}), ('validation', {TRAIN}, {VALIDATION}),
        ('out', {VALIDATION}, DATE '9999-12-31'), ('recent', {RECENT}, DATE '9999-12-31')) AS b(sample, after, until)"""


def starts(names: str) -> str:
    """Sub-query naming each reporting period and the day before it starts."""
    known = {"full": "DATE '0001-01-01'", "out": VALIDATION, "recent": RECENT}
    return f"(VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {known[n]})' for n in names.split())}) AS b(sample, after)"


def ranked(signal: str, source: str = "research", extra: str = "", where: str = "true") -> str:
    return f"""SELECT *, ntile(10) OVER (PARTITION BY {extra} date ORDER BY round({signal}, 9) NULLS FIRST, {ROW_ORDER}) AS grp
        FROM {source} WHERE {where}"""


def returns(grouped: str, ret: str, extra: str = "") -> str:
    return f"""SELECT {extra} grp, year, month, avg({ret}) AS equal_ret,
        sum(ret * weight_mktcap) / nullif(sum(size) / nullif(avg(total_mktcap), 0), 0) AS value_ret
        FROM ({grouped}) GROUP BY {extra} grp, year, month"""


def wealth(source: str, ret: str, by: str, order: str = "year, month") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, CASE WHEN {ret} IS NOT NULL THEN product(1 + {ret}) OVER ({part} ORDER BY {order}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS wealth FROM ({source})"""


def matrix(source: str, index: str, value: str) -> str:
    cells = ", ".join(f"avg(CASE WHEN grp = {g} THEN {value} END) AS g{g}" for g in range(1, 11))
    return f"SELECT {index}, {cells} FROM ({source}) GROUP BY {index}"


def both_weightings(source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra} '{w}' AS weighting, grp, year, month, {w}_ret AS ret FROM ({source})" for w in ("equal", "value")
    )


MONTH_END = "last_day(make_date(CAST(year AS INT), CAST(month AS INT), 1))"

# Inputs as files would hold them.
VIEWS = {
    "fx_month": """SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS date,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) / sum(l_quantity) AS prc, sum(l_quantity) AS vol
        FROM lineitem GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))""",
    "fx_panel": """SELECT m.permno, m.permno - m.permno % 2 AS permco, m.date, m.vol,
        CASE WHEN (m.permno + month(m.date)) % 5 = 0 THEN -m.prc ELSE m.prc END AS prc,
        CASE WHEN m.permno % 11 = 0 THEN 12 ELSE 10 + m.permno % 2 END AS shrcd,
        1 + m.permno % 4 AS exchcd,
        CASE WHEN m.permno % 13 = 0 THEN NULL ELSE 100 + (m.permno * 97) % 9900 END AS siccd,
        s.s_acctbal + 2000 AS shrout,
        CASE WHEN (m.permno * 7 + year(m.date) * 12 + month(m.date)) % 41 = 0 THEN 'B'
             WHEN (m.permno * 7 + year(m.date) * 12 + month(m.date)) % 43 = 0 THEN '-99'
             ELSE CAST(CAST(m.prc / lag(m.prc) OVER (PARTITION BY m.permno ORDER BY m.date) - 1
                  AS DECIMAL(18, 6)) AS VARCHAR) END AS ret
        FROM fx_month m JOIN supplier s ON m.permno = s.s_suppkey""",
    "fx_factor": f"""SELECT make_date(y, m, 1) AS date, y AS year, m AS month, pct * 0.01 AS mkt_rf, CAST(0.2 + 0.01 * m AS DOUBLE) * 0.01 AS rf,
        pct * 0.01 + CAST(0.2 + 0.01 * m AS DOUBLE) * 0.01 AS mkt
        FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
                (CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) / count(o_totalprice) / 150000 - 1) * 10 AS pct
              FROM orders GROUP BY ALL)
        WHERE make_date(y, m, 1) BETWEEN {START} AND {END}""",
    "fx_fund": """SELECT l_suppkey AS gvkey, CAST(year(l_shipdate) AS INT) AS fyear,
        make_date(CAST(year(l_shipdate) AS INT), 12, 31) AS datadate,
        CASE WHEN l_suppkey % 17 = 0 THEN 'SUMM_STD' ELSE 'STD' END AS datafmt,
        sum(l_extendedprice) AS "at", sum(l_extendedprice) * 0.55 AS lt,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE sum(l_extendedprice) * 0.45 END AS seq,
        CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE sum(l_extendedprice) * 0.40 END AS ceq,
        sum(l_quantity) AS pstk,
        CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE sum(l_quantity) * 2 END AS pstkrv,
        CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE sum(l_quantity) * 3 END AS pstkl,
        CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE sum(l_tax * l_extendedprice) END AS txditc,
        CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE sum(l_tax) END AS itcb,
        sum(l_tax) * 2 AS txdb,
        sum(l_extendedprice * (1 - l_discount)) AS revt,
        sum(l_extendedprice * (0.05 - l_discount)) AS ni,
        sum(l_quantity) * 10 AS act, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE sum(l_quantity) * 4 END AS lct,
        sum(l_discount) AS xrd
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "fx_link": """SELECT s_suppkey AS gvkey, s_suppkey AS lpermno, s_suppkey - s_suppkey % 2 AS lpermco,
        'LU' AS linktype, 'P' AS linkprim, '19950101' AS linkdt, '19981231' AS linkenddt FROM supplier
        UNION ALL SELECT s_suppkey, s_suppkey, s_suppkey - s_suppkey % 2, 'LC', 'C', '19990101', 'E' FROM supplier
        UNION ALL SELECT s_suppkey, s_suppkey, s_suppkey - s_suppkey % 2, 'NR', 'N', '19950101', 'E' FROM supplier""",
    "fx_extra": """SELECT gvkey, datadate, CASE WHEN gvkey % 7 = 0 THEN 'SUMM_STD' ELSE 'STD' END AS datafmt,
        lct * 0.1 AS prba FROM fx_fund""",
    "fx_coded": """SELECT l_orderkey AS line_key, l_linenumber AS line, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN l_orderkey || '.0'
        WHEN (l_orderkey + l_linenumber) % 7 = 1 THEN ' ' || l_orderkey || ' ' WHEN (l_orderkey + l_linenumber) % 7 = 2 THEN l_orderkey || '.5'
        WHEN (l_orderkey + l_linenumber) % 7 = 3 THEN 'Z' || l_orderkey WHEN (l_orderkey + l_linenumber) % 7 = 4 THEN ' '
        ELSE CAST(l_orderkey AS VARCHAR) END AS code,
        CASE l_linenumber % 3 WHEN 0 THEN '10.0' WHEN 1 THEN '11' END AS share,
        CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS price FROM lineitem""",
    "coerced": """SELECT line_key, CAST(line AS BIGINT) AS line,
        CASE WHEN TRY_CAST(trim(code) AS DECIMAL(30, 8)) % 1 = 0 THEN CAST(TRY_CAST(trim(code) AS DECIMAL(30, 8)) AS BIGINT) END AS permno,
        CAST(TRY_CAST(share AS DOUBLE) AS INT) AS shrcd, TRY_CAST(price AS DOUBLE) AS prc, code, share, price FROM fx_coded""",
    "fx_daily": """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
        CASE WHEN day(CAST(o_orderdate AS DATE)) % 7 <> 0 THEN CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) END AS value
        FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "fx_macro": """SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INT) AS year,
        CAST(month(o_orderdate) AS INT) AS month,
        CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) / count(o_totalprice) AS value
        FROM orders WHERE o_orderpriority LIKE '1%' OR month(o_orderdate) IN (3, 6, 9, 12)
        GROUP BY o_orderpriority, year(o_orderdate), month(o_orderdate)""",
    # Cleaning
    "clean": f"""SELECT permno, permco, date, shrcd, exchcd, siccd, vol, shrout, abs(prc) AS prc,
        CASE WHEN ret NOT IN ('-99', '-88', '-77', '-66', '-55', '-44', 'B', 'C') THEN TRY_CAST(ret AS DOUBLE) END AS ret,
        lag(abs(prc)) OVER ({BY_STOCK}) AS prc_lag, abs(prc) * shrout AS me, year(date) AS year, month(date) AS month,
        CAST(date - INTERVAL 18 MONTH AS DATE) AS fdate, year(date - INTERVAL 18 MONTH) AS fyear FROM fx_panel""",
    "months": f"""SELECT *, CASE WHEN siccd > 9000 THEN 'Public_Admin' WHEN siccd >= 7000 THEN 'Services'
        WHEN siccd >= 6000 THEN 'Finance' WHEN siccd >= 5200 THEN 'Retail' WHEN siccd >= 5000 THEN 'Wholesale'
        WHEN siccd >= 4000 THEN 'Transportation' WHEN siccd >= 2000 THEN 'Manufacturing'
        WHEN siccd >= 1500 THEN 'Construction' WHEN siccd >= 1000 THEN 'Mining' ELSE 'Argriculture' END AS industry
        FROM clean WHERE date BETWEEN {START} AND {END} AND shrcd IN (10, 11) AND exchcd IN (1, 2, 3)""",
    "counted": f"""SELECT permno, date, round(ret, 6) AS ret,
        sum(CASE WHEN ret >= 0 THEN 1 ELSE 0 END) {back(12, 2)} AS momentum_count FROM months""",
    "stump_rows": f"SELECT * FROM counted WHERE ret IS NOT NULL AND momentum_count IS NOT NULL AND date <= {TRAIN}",
    # Signals
    "priced": f"""SELECT m.*, f.mkt_rf, f.rf, m.ret - f.rf AS ex_ret,
        CASE WHEN 1 + m.ret > 0 THEN ln(1 + m.ret) END AS log_growth,
        CASE WHEN m.prc * m.vol > 0 THEN ln(m.prc * m.vol) END AS log_dvol,
        CASE WHEN m.shrout <> 0 AND m.vol / m.shrout > 0 THEN ln(m.vol / m.shrout) END AS log_turn,
        CASE WHEN f.mkt_rf IS NOT NULL THEN m.ret - f.rf END AS pair_x,
        CASE WHEN m.ret - f.rf IS NOT NULL THEN f.mkt_rf END AS pair_y
        FROM months m LEFT JOIN fx_factor f ON m.year = f.year AND m.month = f.month""",
    "framed": f"""SELECT *, exp(sum(log_growth) {back(12, 2)}) - 1 AS momentum_12, exp(sum(log_growth) {back(7, 2)}) - 1 AS momentum_6,
        exp(sum(log_growth) {back(36, 2)}) - 1 AS momentum_36, lag(ret) OVER ({BY_STOCK}) AS reversal,
        sum(CASE WHEN ret >= 0 THEN 1 ELSE 0 END) {back(12, 2)} AS momentum_count,
        lag(log_dvol) OVER ({BY_STOCK}) AS dvol, lag(log_turn) OVER ({BY_STOCK}) AS turn,
        stddev_samp(ex_ret) {back(11, 0)} AS stock_sd, stddev_samp(mkt_rf) {back(11, 0)} AS mkt_sd,
        covar_samp(pair_x, pair_y) {back(59, 0)} / nullif(stddev_samp(pair_x) {back(59, 0)}
            * stddev_samp(pair_y) {back(59, 0)}, 0) AS corr,
        lag(me) OVER ({BY_STOCK}) AS size FROM priced""",
    "betas": "SELECT *, corr * stock_sd / nullif(mkt_sd, 0) AS beta FROM framed",
    "signals": f"""SELECT *, 0.6 * beta + 0.4 AS beta_shrink, lag(beta) OVER ({BY_STOCK}) AS beta_lag,
        0.6 * lag(beta) OVER ({BY_STOCK}) + 0.4 AS beta_shrink_lag,
        pow(lag(beta) OVER ({BY_STOCK}), 2) AS beta_lag_square,
        pow(0.6 * lag(beta) OVER ({BY_STOCK}) + 0.4, 2) AS beta_shrink_lag_square,
        CASE WHEN size > 0 THEN ln(size) END AS log_size FROM betas""",
    "totals": "SELECT date, sum(size) AS total_mktcap FROM signals GROUP BY date",
    "weighted": """SELECT s.*, t.total_mktcap, s.size / nullif(t.total_mktcap, 0) AS weight_mktcap
        FROM signals s LEFT JOIN totals t ON s.date = t.date""",
    # Accounts
    "booked": """SELECT *, coalesce(seq, ceq + pstk, "at" - lt) AS she, coalesce(txditc, itcb + txdb, itcb, txdb) AS dt,
        coalesce(pstkrv, pstkl, pstk) AS ps, coalesce(seq, ceq + pstk, "at" - lt) - coalesce(pstkrv, pstkl, pstk)
        + coalesce(txditc, itcb + txdb, itcb, txdb) AS be, act / nullif(lct, 0) AS current_ratio FROM fx_fund""",
    "dated": f"""SELECT gvkey, lpermno, lpermco, linktype, linkprim, CAST(strptime(linkdt, '%Y%m%d') AS DATE) AS linkdt,
        coalesce(CAST(try_strptime(linkenddt, '%Y%m%d') AS DATE), {AS_OF}) AS linkenddt
        FROM fx_link WHERE linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')""",
    "linked": """SELECT b.*, d.lpermno, d.lpermco, d.linktype, d.linkprim, d.linkdt, d.linkenddt FROM booked b JOIN dated d
        ON b.gvkey = d.gvkey AND b.datadate BETWEEN d.linkdt AND d.linkenddt WHERE b.datafmt = 'STD'""",
    "grown": "SELECT *, "
    + ", ".join(
        f"""("{c}" - lag("{c}") OVER (PARTITION BY gvkey ORDER BY datadate, lpermno))
        / nullif(lag("{c}") OVER (PARTITION BY gvkey ORDER BY datadate, lpermno), 0) AS {c}_growth"""
        for c in ("at", "revt", "ni", "xrd")
    )
    + " FROM linked",
    "accounts": """SELECT *, lag(xrd_growth) OVER (PARTITION BY gvkey ORDER BY datadate, lpermno) AS xrd_growth_lag1,
        lag(xrd_growth, 2) OVER (PARTITION BY gvkey ORDER BY datadate, lpermno) AS xrd_growth_lag2 FROM grown""",
    "research": """SELECT w.*, a.gvkey, a.lpermno, a.datadate, a.she, a.be, a.revt, a.ni, a.at_growth, a.ni_growth,
        a.revt_growth, a.current_ratio, a.be / nullif(w.size, 0) AS value, a.ni / nullif(w.prc_lag, 0) AS ep,
        a.revt / nullif(w.prc_lag, 0) AS sp
        FROM weighted w LEFT JOIN accounts a ON w.permco = a.lpermco AND w.fyear = a.fyear WHERE w.ret IS NOT NULL""",
    # Model rows and closed-form least squares
    "core_rows": f"SELECT * FROM research WHERE {present((*CORE, *CARRIED))}",
    "full_rows": f"SELECT * FROM research WHERE {present((*FULL, *CARRIED))}",
    "moments": f"""SELECT count(*) AS n, avg(ret) AS my, var_pop(ret) AS vy, avg(momentum_12) AS m1, avg(log_size) AS m2,
        avg(value) AS m3, var_pop(momentum_12) AS v1, var_pop(log_size) AS v2, var_pop(value) AS v3,
        covar_pop(momentum_12, log_size) AS c12, covar_pop(momentum_12, value) AS c13, covar_pop(log_size, value) AS c23,
        covar_pop(momentum_12, ret) AS c1, covar_pop(log_size, ret) AS c2, covar_pop(value, ret) AS c3
        FROM core_rows WHERE date <= {TRAIN}""",
    # The penalty applies to standardised columns, so it scales with each variance.
    "normal": """SELECT setting, m.*, v1 * (1 + reg / sqrt(vy)) AS a1, v2 * (1 + reg / sqrt(vy)) AS a2, v3 * (1 + reg / sqrt(vy)) AS a3
        FROM moments m, (VALUES ('ols', 0.0), ('0.0001', 0.0001), ('0.01', 0.01), ('1', 1.0), ('10', 10.0),
            ('0.3', 0.3), ('gaussian', 0.5)) AS g(setting, reg)""",
    "cofactors": """SELECT *, a2 * a3 - c23 * c23 AS k11, c13 * c23 - c12 * a3 AS k12, c12 * c23 - a2 * c13 AS k13,
        a1 * a3 - c13 * c13 AS k22, c12 * c13 - a1 * c23 AS k23, a1 * a2 - c12 * c12 AS k33,
        a1 * (a2 * a3 - c23 * c23) - c12 * (c12 * a3 - c13 * c23) + c13 * (c12 * c23 - a2 * c13) AS det FROM normal""",
    "slopes": """SELECT *, (k11 * c1 + k12 * c2 + k13 * c3) / det AS b1, (k12 * c1 + k22 * c2 + k23 * c3) / det AS b2,
        (k13 * c1 + k23 * c2 + k33 * c3) / det AS b3 FROM cofactors""",
    "fitted": "SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM slopes",
    "predicted": f"""SELECT c.*, f.setting, f.b0 + f.b1 * momentum_12 + f.b2 * log_size + f.b3 * value AS prediction, b.sample
        FROM core_rows c, fitted f, {samples()} WHERE c.date > b.after AND c.date <= b.until""",
    "ols_rows": "SELECT * FROM predicted WHERE setting = 'ols' AND sample <> 'train'",
    "ols_returns": returns(ranked("prediction", "ols_rows", "sample,"), "ret", "sample,"),
    "legs": f"""SELECT * FROM (
        SELECT 'momentum' AS strategy, year, month, value_ret AS ret FROM ({returns(ranked('momentum_12'), 'ex_ret')}) WHERE grp = 10
        UNION ALL SELECT 'size', year, month, value_ret FROM ({returns(ranked('size'), 'ex_ret')}) WHERE grp = 1
        UNION ALL SELECT 'value', year, month, value_ret FROM ({returns(ranked('value'), 'ex_ret')}) WHERE grp = 1
        UNION ALL SELECT 'ols', year, month, value_ret FROM ols_returns WHERE sample = 'out' AND grp = 10)
        WHERE {MONTH_END} > {VALIDATION}""",
    "industries": """SELECT industry, row_number() OVER (ORDER BY count(*) DESC, industry) - 1 AS industry_index
        FROM months GROUP BY industry""",
}

MOMENTUM = returns(ranked("momentum_12"), "ex_ret")
BETA = returns(ranked("beta_lag"), "ex_ret")
MARKET = {
    "equal": "SELECT year, month, avg(ret) AS ret FROM research GROUP BY year, month",
    "value": "SELECT year, month, sum(ret * weight_mktcap) AS ret FROM research GROUP BY year, month",
}
FIT = "SELECT count(ret) AS n, 1 - sum((ret - prediction) ** 2) / (var_pop(ret) * count(ret)) AS r2, sqrt(avg((ret - prediction) ** 2)) AS rmse"
TERMS = ("intercept", *CORE)


def annualised(source: str, ret: str, by: str) -> str:
    return f"""SELECT {by}, avg({ret}) * 12 AS annual_return, stddev_samp({ret}) * sqrt(12) AS annual_volatility,
        avg({ret}) * 12 / nullif(stddev_samp({ret}) * sqrt(12), 0) AS sharpe FROM ({source}) GROUP BY {by}"""


def legs_wide(source: str, value: str) -> str:
    cells = ", ".join(f"max(CASE WHEN strategy = '{s}' THEN {value} END) AS {s}" for s in ("momentum", "size", "value", "ols"))
    return f"SELECT year, month, {cells} FROM ({source}) GROUP BY year, month"


def coefficient_rows(setting: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, b{i} AS estimate FROM fitted WHERE setting = '{setting}'" for i, t in enumerate(TERMS)
    )


def in_samples(source: str, names: str) -> str:
    return f"SELECT t.*, b.sample FROM ({source}) t, {starts(names)} WHERE {MONTH_END} > b.after"


def carried(series: str, name: str) -> str:
    """Latest value of one series up to the month of the row."""
    return f"""(SELECT max_by(value, x.year * 12 + x.month) FROM fx_macro x
        WHERE x.series = '{series}' AND x.year * 12 + x.month <= m.year * 12 + m.month) AS {name}"""


def carried_daily(series: str, name: str) -> str:
    """Value of the latest day of one series in or before the month of the row."""
    return f"""(SELECT arg_max(value, x.date) FROM fx_daily x WHERE x.series = '{series}' AND x.value IS NOT NULL
        AND x.date <= last_day(make_date(CAST(m.year AS INT), CAST(m.month AS INT), 1))) AS {name}"""


SERIES = (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low"))


def stump(source: str) -> str:
    """``momentum_count, fit``: the halves' means of ``ret`` at the split that explains most; of equal ones the first."""
    return f"""SELECT momentum_count, CASE WHEN momentum_count <= cut THEN t1 / n1 ELSE (t0 - t1) / (n0 - n1) END AS fit
        FROM (SELECT DISTINCT momentum_count FROM {source}) AS v, (
            SELECT * FROM (SELECT momentum_count AS cut, sum(n) OVER w AS n1, sum(total) OVER w AS t1, sum(n) OVER () AS n0, sum(total) OVER () AS t0
                FROM (SELECT momentum_count, count(*) AS n, sum(ret) AS total FROM {source} GROUP BY momentum_count) AS g
                WINDOW w AS (ORDER BY momentum_count)) AS c
            WHERE n1 < n0 ORDER BY t1 * t1 / n1 + (t0 - t1) * (t0 - t1) / (n0 - n1) DESC, cut LIMIT 1) AS best"""


# The second boosted stump is fitted on twice the first one's errors and weighs a tenth.
VIEWS |= {
    "first_stump": stump("stump_rows"),
    "stump_errors": """SELECT s.momentum_count, 2 * (s.ret - f.fit) AS ret FROM stump_rows s JOIN first_stump f
        ON s.momentum_count = f.momentum_count""",
    "second_stump": stump("stump_errors"),
    "both_stumps": """SELECT a.momentum_count, a.fit + 0.1 * b.fit AS fit FROM first_stump a JOIN second_stump b
        ON a.momentum_count = b.momentum_count""",
}


def best_split(rows: str) -> str:
    """``node, signal, cut, n1, t1, n0, t0``: per node of ``rows`` (node, signal, bin, ret) the split that explains most; of equal ones the first."""
    return f"""SELECT * FROM (SELECT *, sum(n) OVER w AS n1, sum(total) OVER w AS t1, sum(n) OVER (PARTITION BY node, signal) AS n0,
            sum(total) OVER (PARTITION BY node, signal) AS t0, bin AS cut
        FROM (SELECT node, signal, bin, count(*) AS n, sum(ret) AS total FROM {rows} GROUP BY ALL) AS g
        WINDOW w AS (PARTITION BY node, signal ORDER BY bin)) AS c WHERE n1 < n0
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(t1 * t1 / n1 + (t0 - t1) * (t0 - t1) / (n0 - n1), 12) DESC, signal, cut) = 1"""


# A tree of two levels on 32 exact bins of three signals: a value's bin is the share of training rows below it.
VIEWS |= {
    "tree_rows": f"""SELECT row_number() OVER () AS r, permno, gvkey, date, round(ret, 6) AS ret, b.sample, unnest([1, 2, 3]) AS signal,
        unnest([round(momentum_12, 9), round(log_size, 9), round(value, 9)]) AS x
        FROM core_rows c, {samples()} WHERE c.date > b.after AND c.date <= b.until AND b.sample IN ('train', 'validation')""",
    "tree_bins": """SELECT signal, bin, min(x) AS low FROM (SELECT signal, x,
            CAST(floor((rank() OVER (PARTITION BY signal ORDER BY x) - 1) * 32 / count(*) OVER (PARTITION BY signal)) AS INT) AS bin
        FROM tree_rows WHERE sample = 'train') AS g GROUP BY signal, bin""",
    "tree_cells": """SELECT t.r, t.permno, t.gvkey, t.date, t.ret, t.sample, t.signal, max(b.bin) AS bin FROM tree_rows t
        JOIN tree_bins b ON t.signal = b.signal AND (b.low <= t.x OR b.bin = 0) GROUP BY ALL""",
    "tree_root": best_split("(SELECT 0 AS node, signal, bin, ret FROM tree_cells WHERE sample = 'train')"),
    "tree_sides": """SELECT t.r, CASE WHEN t.bin <= s.cut THEN 1 ELSE 2 END AS node FROM tree_cells t JOIN tree_root s ON t.signal = s.signal""",
    "tree_children": best_split("""(SELECT s.node, t.signal, t.bin, t.ret FROM tree_cells t JOIN tree_sides s ON t.r = s.r WHERE t.sample = 'train')"""),
}


def with_r2(fits: str) -> str:
    return f"""SELECT momentum_count, fit AS prediction, (SELECT 1 - sum((s.ret - f.fit) ** 2) / (var_pop(s.ret) * count(s.ret))
        FROM stump_rows s JOIN {fits} f ON s.momentum_count = f.momentum_count) AS r2 FROM {fits}"""


def grid(settings: str) -> str:
    return f"{FIT}, setting FROM predicted WHERE sample = 'validation' AND setting IN ({settings}) GROUP BY setting"


INFERENCE = f"""
    SELECT *, sse / (n - 4) AS s2 FROM (SELECT f.*, (SELECT sum((ret - prediction) ** 2) FROM predicted
    WHERE setting = 'ols' AND sample = 'train') AS sse FROM fitted f WHERE setting = 'ols')"""
STD_ERRORS = {
    "intercept": """sqrt(s2 * (1.0 / n + (m1 * m1 * k11 + m2 * m2 * k22 + m3 * m3 * k33
        + 2 * (m1 * m2 * k12 + m1 * m3 * k13 + m2 * m3 * k23)) / (n * det)))""",
    **{t: f"sqrt(s2 * k{i}{i} / (n * det))" for i, t in enumerate(CORE, 1)},
}

# One SELECT per query; every name it reads is a test table or one of the views above.
BODIES = {
    "scan_panel": "fx_panel",
    "factor_series": "fx_factor",
    "macro_join_daily": "SELECT m.permno, m.date, u.* EXCLUDE (year, month) FROM months m JOIN (SELECT m.year, m.month, "
    + ", ".join(carried_daily(*names) for names in SERIES)
    + " FROM (SELECT DISTINCT year, month FROM months) m) u ON m.year = u.year AND m.month = u.month",
    "code_coercion": "coerced",
    "account_asof": """SELECT m.permno, m.date, a.datadate AS account_date, a.gvkey, a.be FROM months m
        ASOF LEFT JOIN accounts a ON m.permno = a.lpermno AND m.date >= a.datadate""",
    "any_period": f"""SELECT (e1.y || '-' || e2.y) AS period, grp, count(equal_ret) AS n, product(1 + equal_ret) AS wealth,
        avg(equal_ret) * 12 AS annual_return, stddev_samp(equal_ret) * sqrt(12) AS annual_volatility
        FROM ({MOMENTUM}) r, range(1994, 2002) e1(y), range(1994, 2002) e2(y) WHERE e1.y < e2.y AND r.year > e1.y AND r.year <= e2.y
        GROUP BY e1.y, e2.y, grp""",
    "panel_append": f"SELECT * FROM weighted WHERE ret IS NOT NULL AND date > {TRAIN}",
    "panel_store": "SELECT permno, date, year, CASE WHEN year = 1998 THEN 2 * prc ELSE prc END AS prc, momentum_12 FROM signals",
    "rejects": """SELECT 'permno' AS "column", count(*) AS rows, count(*) FILTER (permno IS NULL) AS nulls, count(*) FILTER (permno IS NULL) AS rejected FROM coerced
        UNION ALL SELECT 'shrcd', count(*), count(*) FILTER (shrcd IS NULL), count(*) FILTER (trim(coalesce(share, '')) <> '' AND shrcd IS NULL) FROM coerced
        UNION ALL SELECT 'prc', count(*), count(*) FILTER (prc IS NULL), count(*) FILTER (trim(coalesce(price, '')) <> '' AND prc IS NULL) FROM coerced""",
    "dt_stump": with_r2("first_stump"),
    "rf_stump": with_r2("first_stump"),
    "gbt_stump": with_r2("both_stumps"),
    "dt_depth2": """SELECT t.sample, t.permno, t.gvkey, t.date, CASE WHEN t.bin <= c.cut THEN c.t1 / c.n1 ELSE (c.t0 - c.t1) / (c.n0 - c.n1) END AS prediction
        FROM tree_cells t JOIN tree_sides s ON t.r = s.r JOIN tree_children c ON c.node = s.node AND c.signal = t.signal WHERE t.sample = 'validation'""",
    "macro_join": "SELECT m.permno, m.date, u.* EXCLUDE (year, month) FROM months m JOIN (SELECT m.year, m.month, "
    + ", ".join(
        carried(s, n)
        for s, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"),
                     ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low"))
    )
    + " FROM (SELECT DISTINCT year, month FROM months) m) u ON m.year = u.year AND m.month = u.month",
    "fund_extra_join": """SELECT f.*, e.prba FROM fx_fund f LEFT JOIN (SELECT * FROM fx_extra WHERE datafmt = 'STD') e
        ON f.gvkey = e.gvkey AND f.datadate = e.datadate""",
    "clean_returns": "clean",
    "market_equity": "clean",
    "calendar_cols": "clean",
    "universe_filter": "SELECT * FROM months WHERE ret IS NOT NULL",
    "link_filter": "SELECT * FROM fx_link WHERE linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')",
    "penny_filter": "SELECT * FROM months WHERE prc >= 2400",
    "security_lookup": "SELECT * FROM clean WHERE permno IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)",
    "industry_map": "months",
    "liquidity": "signals",
    "excess_return": "priced",
    "book_equity": "booked",
    "current_ratio": "booked",
    "value_factor": "research",
    "price_ratios": "research",
    "complete_cases": "core_rows",
    "factor_join": "priced",
    "link_join": "linked",
    "fundamental_join": "research",
    "fundamental_join_latest": """SELECT m.*, a.* EXCLUDE (fyear) FROM months m LEFT JOIN (
        SELECT * FROM accounts QUALIFY row_number() OVER (PARTITION BY lpermco, fyear
            ORDER BY datadate DESC, gvkey, lpermno) = 1) a
        ON m.permco = a.lpermco AND m.fyear = a.fyear WHERE m.ret IS NOT NULL""",
    "lagged_cols": f"""SELECT permno, date, prc_lag, lag(ret) OVER ({BY_STOCK}) AS ret_lag,
        lag(me) OVER ({BY_STOCK}) AS me_lag FROM clean""",
    "momentum": "signals",
    "reversal": "signals",
    "momentum_count": "signals",
    "rolling_vol": "signals",
    "rolling_corr": "signals",
    "beta": "signals",
    "size_factor": "signals",
    "growth_rates": "accounts",
    "rd_growth_lags": "accounts",
    "total_mktcap": "totals",
    "value_weights": "weighted",
    "decile_momentum": ranked("momentum_12"),
    "decile_size": ranked("size"),
    "decile_value": ranked("value"),
    "decile_value_present": ranked("value", where="value IS NOT NULL"),
    "portfolio_momentum": MOMENTUM,
    "portfolio_size": returns(ranked("size"), "ex_ret"),
    "portfolio_value": returns(ranked("value"), "ex_ret"),
    "portfolio_beta": BETA,
    "decile_matrix": matrix(MOMENTUM, "year, month", "equal_ret"),
    "cumulative_return": f"SELECT *, equal_ret AS ret FROM ({wealth(MOMENTUM, 'equal_ret', 'grp')})",
    "subsample_cum": wealth(in_samples(both_weightings(MOMENTUM), "full out recent"), "ret", "sample, weighting, grp"),
    "subperiod_terminal": f"""SELECT p.period, grp, product(1 + equal_ret) AS wealth FROM ({BETA}),
        (VALUES ('1995-1996', DATE '1994-12-31', DATE '1996-12-31'), ('1997-1998', DATE '1996-12-31', DATE '1998-12-31'),
        ('1999-2000', DATE '1998-12-31', DATE '2000-12-31'), ('2001', DATE '2000-12-31', DATE '2001-12-31'))
        AS p(period, after, until) WHERE {MONTH_END} > p.after AND {MONTH_END} <= p.until GROUP BY p.period, grp""",
    "market_equal": wealth(in_samples(MARKET["equal"], "full recent"), "ret", "sample"),
    "market_value": wealth(in_samples(MARKET["value"], "full recent"), "ret", "sample"),
    "factor_benchmark": wealth(in_samples("SELECT year, month, mkt FROM fx_factor", "full recent"), "mkt", "sample"),
    "performance_stats": annualised(in_samples(MOMENTUM, "out"), "value_ret", "grp"),
    "strategy_compare": legs_wide("SELECT * FROM legs", "ret"),
    "strategy_wealth": legs_wide(wealth("SELECT * FROM legs", "ret", "strategy"), "wealth"),
    "strategy_stats": annualised("SELECT * FROM legs", "ret", "strategy"),
    "profile_nulls": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM research"
        for c in ("be", "me", "value", "permno", "she")
    ),
    "profile_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS stddev,
        min({c}) AS min, max({c}) AS max FROM research"""
        for c in ("prc", "ret", "ex_ret")
    ),
    "industry_distinct": "industries",
    "industry_index": "SELECT * FROM months JOIN industries USING (industry)",
    "industry_onehot": """SELECT permno, date, array_to_string([CASE WHEN i = industry_index THEN '1' ELSE '0' END
        FOR i IN range(0, n - 1)], '') AS onehot
        FROM months JOIN industries USING (industry), (SELECT count(*) AS n FROM industries)""",
    "top_returns": "SELECT * FROM months WHERE ret IS NOT NULL ORDER BY ret DESC, permno, date LIMIT 50",
    "time_split": f"SELECT r.*, b.sample FROM research r, {samples()} WHERE r.date > b.after AND r.date <= b.until",
    "feature_matrix": f"SELECT r.*, b.sample FROM full_rows r, {samples()} WHERE r.date > b.after AND r.date <= b.until",
    "ols_coefficients": coefficient_rows("ols"),
    "ridge_coefficients": coefficient_rows("0.3"),
    "glm_coefficients": coefficient_rows("0.3"),
    "ols_train_metrics": f"{FIT} FROM predicted WHERE setting = 'ols' AND sample = 'train'",
    "ols_predict": "ols_rows",
    "ridge_predict": "SELECT * FROM predicted WHERE setting = '0.3' AND sample = 'validation'",
    "ols_inference": " UNION ALL ".join(
        f"""SELECT '{t}' AS term, b{i} AS estimate, {STD_ERRORS[t]} AS std_error, b{i} / {STD_ERRORS[t]} AS t_value
        FROM ({INFERENCE})"""
        for i, t in enumerate(TERMS)
    ),
    "linear_by_month": """SELECT d.date, count(*) AS n, regr_intercept(ret, momentum_12) AS intercept, regr_slope(ret, momentum_12) AS slope,
        regr_r2(ret, momentum_12) AS r2 FROM (SELECT DISTINCT date FROM core_rows) d JOIN core_rows c ON c.date <= d.date
        GROUP BY d.date HAVING count(*) >= 3""",
    "evaluate_ols": f"{FIT}, sample FROM ols_rows GROUP BY sample",
    "ridge_grid": grid("'0.0001', '0.01', '1', '10'"),
    "glm_grid": grid("'gaussian'"),
    "decile_prediction": ranked("prediction", "ols_rows", where="sample <> 'recent'"),
    "prediction_matrix": matrix(
        f"SELECT sample, date, grp, avg(round(prediction, 9)) AS p FROM ({ranked('prediction', 'ols_rows', 'sample,')}) GROUP BY ALL",
        "sample, date", "p",
    ),
    "backtest_lr": wealth(both_weightings("SELECT * FROM ols_returns", "sample,"), "ret", "sample, weighting, grp"),
}


def _needed(text: str) -> list[str]:
    """Views that ``text`` reads, directly or through others, in order of definition."""
    words, found = text, set()
    for name in reversed(VIEWS):
        if name in words:
            found.add(name)
            words += " " + VIEWS[name]
    return [name for name in VIEWS if name in found]


def statement(key: str) -> str:
    body = BODIES[key]
    source = body if body in VIEWS else f"({body}) AS result"
    chain = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in _needed(body))
    return f"WITH {chain}\nSELECT {sql_output(key)} FROM {source}" if chain else f"SELECT {sql_output(key)} FROM {source}"


def statements() -> dict[str, str]:
    return {key: statement(key) for key in BODIES}
