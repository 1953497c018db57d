"""SQL fragments that the queries' SQL shares."""

EVENTS_PANEL = """panel AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS asset, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, sum(value) AS volume, count(*)::DOUBLE AS amount
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"""

SUPPLIER_PANEL = """panel AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS asset,
         arg_min(price, tick) AS open, max(price) AS high, min(price) AS low, arg_max(price, tick) AS close, sum(l_quantity) AS volume, count(*)::DOUBLE AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS tick FROM lineitem)
  GROUP BY 1, 2)"""

#: Factor values of momentum over 5 rows, forward returns, and both joined.
MOMENTUM = """factor AS (
  SELECT * FROM (SELECT date, asset, close / lag(close, 5) OVER (PARTITION BY asset ORDER BY date) - 1 AS factor_value FROM panel) WHERE factor_value IS NOT NULL),
returns AS (
  SELECT * FROM (SELECT date, asset, lead(close) OVER (PARTITION BY asset ORDER BY date) / close - 1 AS forward_return FROM panel) WHERE forward_return IS NOT NULL),
joined AS (SELECT * FROM factor JOIN returns USING (date, asset))"""

GROUPED = """grouped AS (
  SELECT date, asset, factor_value, rank, CAST(floor(rank::DOUBLE / (max(rank) OVER (PARTITION BY date) + 1) * 5) AS INTEGER) AS grp
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor_value, asset)::INTEGER AS rank FROM factor)),
by_group AS (SELECT date, grp, avg(forward_return) AS daily_return FROM grouped JOIN returns USING (date, asset) GROUP BY 1, 2)"""

LEGS = """legs AS (
  SELECT date, max(daily_return) FILTER (grp = 4) AS long_ret, max(daily_return) FILTER (grp = 0) AS short_ret FROM by_group GROUP BY date
  HAVING max(daily_return) FILTER (grp = 4) IS NOT NULL AND max(daily_return) FILTER (grp = 0) IS NOT NULL),
weights AS (
  SELECT date, asset, CASE WHEN grp = 4 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / count(*) OVER (PARTITION BY date, grp) AS weight FROM grouped WHERE grp IN (0, 4)),
days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM weights)),
was AS (SELECT d.date, w.asset, w.weight AS prev_weight FROM weights w JOIN days d ON w.date = d.prev),
traded AS (
  SELECT date, sum(abs(coalesce(weight, 0) - coalesce(prev_weight, 0))) / 2 AS turnover
  FROM weights FULL JOIN was USING (date, asset) GROUP BY date),
net AS (
  SELECT date, long_ret, short_ret, long_ret - short_ret AS ls_return_raw, coalesce(turnover, 0) AS turnover,
         long_ret - short_ret - coalesce(turnover, 0) * 0.001::DOUBLE AS ls_return
  FROM legs LEFT JOIN traded USING (date)),
curve AS (SELECT *, product(1 + ls_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM net)"""


def spearman(table: str, x: str, y: str, *by: str) -> str:
    """SELECT of ``by, ic`` with defined rank correlations."""
    keys = ", ".join(by)

    def ranked(c: str) -> str:
        return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"

    return f"""SELECT * FROM (
  SELECT {keys}, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic
  FROM (SELECT {keys}, {ranked(x)} AS rx, {ranked(y)} AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}) WHERE ic IS NOT NULL"""


ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def normal_cdf(z: str) -> str:
    """The normal distribution function by the same public approximation."""
    poly = "0::DOUBLE"
    for c in ERFC:
        poly = f"({poly} * t + {c}::DOUBLE)"
    return f"(SELECT CASE WHEN z > 0 THEN 1 - t * exp(-z * z / 2 + {poly}) / 2 ELSE t * exp(-z * z / 2 + {poly}) / 2 END FROM (SELECT z, 1 / (1 + abs(z) / sqrt(2.0::DOUBLE) / 2) AS t FROM (SELECT {z} AS z)))"


def drawn(*parts: str) -> str:
    """A number from 0 to below 2^32 that the parts alone decide."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"
