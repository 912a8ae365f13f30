"""Pieces of the checking SQL. Dates are spelled out and nothing is taken from the operators."""

from __future__ import annotations

OS = """os AS (
  SELECT o.*, c_mktsegment, n_name, r_name FROM orders o
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

LS = """ls AS (
  SELECT l.*, p_brand, p_type,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey)"""

ORDER_COLUMNS = {
    "priority": "o_orderpriority", "status": "o_orderstatus", "segment": "c_mktsegment",
    "nation": "n_name", "region": "r_name",
}
LINE_COLUMNS = {
    "brand": "p_brand", "part_type": "p_type", "return_flag": "l_returnflag", "line_status": "l_linestatus",
}

APRIL = ("1998-04-01", "1998-05-01")
MARCH = ("1998-03-01", "1998-04-01")  # April moved back a month ends on 30 March
MARCH_30 = ("1998-03-01", "1998-03-31")
FEBRUARY_28 = ("1998-02-01", "1998-03-01")
APRIL_97 = ("1997-04-01", "1997-05-01")
WEEK = ("1998-04-06", "1998-04-13")
WEEK_BEFORE = ("1998-03-30", "1998-04-06")


def win(column: str, span: tuple[str, str]) -> str:
    """Half-open window test."""
    return f"({column} >= DATE '{span[0]}' AND {column} < DATE '{span[1]}')"


def od(span: tuple[str, str]) -> str:
    return win("o_orderdate", span)


def ld(span: tuple[str, str]) -> str:
    return win("l_shipdate", span)


def total(expr: str, cond: str = "TRUE", scale: int = 2) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN CAST({expr} AS DECIMAL(18,{scale})) END) AS DOUBLE)"


def rows(cond: str = "TRUE") -> str:
    return f"CAST(nullif(count(CASE WHEN {cond} THEN 1 END), 0) AS DOUBLE)"


def ratio(top: str, bottom: str) -> str:
    return f"(coalesce({top}, 0.0::DOUBLE) / nullif({bottom}, 0))"


def order_kpi(kpi: str, cond: str = "TRUE") -> str:
    value, count = total("o_totalprice", cond), rows(cond)
    return {
        "order_value": value,
        "order_count": count,
        "avg_order_value": ratio(value, count),
        "finished_rate": ratio(rows(f"{cond} AND o_orderstatus = 'F'"), count),
        "customers": f"CAST(nullif(count(DISTINCT CASE WHEN {cond} THEN o_custkey END), 0) AS DOUBLE)",
    }[kpi]


def line_kpi(kpi: str, cond: str = "TRUE") -> str:
    count = rows(cond)
    return {
        "revenue": total("rev", cond, 4),
        "quantity": total("l_quantity", cond),
        "line_count": count,
        "avg_discount": ratio(total("l_discount", cond), count),
        "return_rate": ratio(rows(f"{cond} AND l_returnflag = 'R'"), count),
    }[kpi]


def by_each(base: str, columns: dict[str, str], select: str, where: str = "TRUE", self_total: bool = False) -> str:
    """One grouped query per dimension, put together."""
    parts = [
        f"SELECT '{d}' AS dimension, CAST({c} AS VARCHAR) AS dimension_value, {select} FROM {base} "
        f"WHERE {where} GROUP BY {c}"
        for d, c in columns.items()
    ]
    if self_total:
        parts.append(f"SELECT 'SELF' AS dimension, 'ALL' AS dimension_value, {select} FROM {base} WHERE {where}")
    return "\nUNION ALL\n".join(parts)


def pick(columns: dict[str, str], *names: str) -> dict[str, str]:
    return {n: columns[n] for n in names}


def scale100(x: str) -> str:
    return f"(CASE WHEN abs({x}) <= 1.0000001 THEN {x} * 100 ELSE {x} END)"


def r2(x: str) -> str:
    """Two decimals with ties away from zero, for means of amounts, which often end in a five."""
    return f"CAST(round(CAST({x} AS DECIMAL(30,6)), 2) AS DOUBLE)"


def pct_abs(cur: str, prior: str) -> str:
    return f"(({cur} - {prior}) / nullif(abs({prior}), 0) * 100)"


def pct(cur: str, prior: str) -> str:
    return f"(({cur} - {prior}) / nullif({prior}, 0) * 100)"


def trimmed(x: str) -> str:
    return f"regexp_replace(CAST(round(CAST({x} AS DECIMAL(30,6)), 2) AS VARCHAR), '\\.?0+$', '')"
