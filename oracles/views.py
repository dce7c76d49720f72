"""Survey-shaped views of the order tables as SQL, and helpers to write statements."""

from __future__ import annotations

import re

DIMENSIONS = ["strata", "age_group", "ethnicity", "education", "workertype_group"]
OPTIONS = [f"m__{i}" for i in range(1, 6)]
CONCERNS = [f"a1_{i}" for i in range(1, 4)]
ADDRESS = ["ed", "building_number", "dwelling_number", "household_number"]


def _concern(i: int) -> str:
    return (
        f"CASE (o_custkey + {i} * o_orderkey) % 5 WHEN 1 THEN 'Very concerned' WHEN 2 THEN 'Concerned' "
        f"WHEN 3 THEN 'Neutral' WHEN 4 THEN 'Not concerned' ELSE 'Not stated' END AS a1_{i}"
    )


def _option(i: int) -> str:
    return (
        f"CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN (o_custkey + {i} * o_orderkey) % 3 = 0 THEN 1 ELSE 0 END AS m__{i}"
    )


# Codes, ranges and labels below are fixed values of the survey, stated apart from the library on purpose.
VIEWS = {
    "interviews": f"""
SELECT o_orderkey AS interview_key, 'iv-' || o_orderkey AS interview_id, o_custkey AS address_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END
    AS result_code,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Completed'
    WHEN o_orderstatus = 'P' THEN 'Partial' ELSE 'Refused' END AS result,
  'interviewer' || (o_orderkey % 7) AS responsible, o_orderpriority AS round,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS q1,
  CASE WHEN (o_orderkey + o_custkey) % 7 <= 2 THEN 'Yes' WHEN (o_orderkey + o_custkey) % 7 = 5 THEN 'DK'
    WHEN (o_orderkey + o_custkey) % 7 = 6 THEN NULL ELSE 'No' END AS q2,
  {", ".join(_concern(i) for i in range(1, 4))},
  {", ".join(_option(i) for i in range(1, 6))}
FROM orders""",
    "places": """
SELECT c_custkey AS address_id, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE n_name END AS community,
  r_name AS district, c_nationkey AS ed, CASE WHEN n_nationkey IN (1, 2) THEN 'A' ELSE 'B' END AS strata,
  c_mktsegment AS segment, CAST(c_custkey // 100 AS INTEGER) AS building_number,
  CAST((c_custkey // 5) % 10 AS INTEGER) AS dwelling_number,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INTEGER) END AS household_number,
  c_name AS head_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "households": "SELECT i.*, p.* EXCLUDE (address_id) FROM interviews i LEFT JOIN places p USING (address_id)",
    "roster": """
SELECT l_orderkey AS interview_key, l_linenumber AS rel,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS sex,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_partkey % 83 END AS age,
  CASE l_suppkey % 5 WHEN 0 THEN 'Mestizo/Hispanic/Latino' WHEN 1 THEN 'Creole' WHEN 2 THEN 'Mennonite'
    WHEN 3 THEN 'Garifuna' ELSE 'Maya' END AS ethnicity,
  CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS ed_attending,
  CASE WHEN l_suppkey % 29 = 0 THEN 999999 ELSE CAST(l_quantity AS INTEGER) % 21 END AS ed_clevel,
  CASE WHEN l_partkey % 37 = 0 THEN 999999 ELSE l_partkey % 22 END AS ed_llevel,
  1 + l_partkey % 2 AS employed,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 9 = 7 THEN 888888 WHEN l_partkey % 9 = 8 THEN 999999
    ELSE l_partkey % 9 END AS workertype
FROM lineitem""",
    "members": """
SELECT *,
  CASE WHEN age >= 50 THEN '50+' WHEN age >= 35 THEN '35-49' WHEN age >= 18 THEN '18-34' WHEN age >= 5 THEN '5-17'
    WHEN age >= 0 THEN '0-4' END AS age_group,
  CASE WHEN ethnicity IN ('Mestizo/Hispanic/Latino', 'Creole', 'Mennonite') THEN ethnicity ELSE 'Other' END
    AS ethnicity_group,
  CASE WHEN attained = 'Other' THEN NULL ELSE attained END AS ed_attainment,
  CASE WHEN workertype IN (1, 2) THEN 'Self Employed' WHEN workertype IN (3, 4) THEN 'Employee'
    WHEN workertype BETWEEN 5 AND 888888 THEN 'Other' WHEN workertype = 999999 THEN 'Not Stated'
    WHEN employed = 2 THEN 'Not Employed' END AS workertype_group
FROM (SELECT *,
  CASE WHEN ed_attending = 1 AND ed_clevel BETWEEN 0 AND 8 THEN 'None/Some Primary'
    WHEN ed_attending = 1 AND ed_clevel BETWEEN 9 AND 12 THEN 'Primary'
    WHEN ed_attending = 1 AND ed_clevel = 17 THEN 'Secondary'
    WHEN ed_attending = 1 AND ed_clevel IN (18, 19) THEN 'Tertiary'
    WHEN ed_attending = 2 AND ed_llevel BETWEEN 0 AND 7 THEN 'None/Some Primary'
    WHEN ed_attending = 2 AND ed_llevel BETWEEN 8 AND 11 THEN 'Primary'
    WHEN ed_attending = 2 AND ed_llevel = 12 THEN 'Secondary'
    WHEN ed_attending = 2 AND ed_llevel BETWEEN 17 AND 19 THEN 'Tertiary'
    WHEN ed_llevel = 21 THEN 'Never Attended' WHEN ed_llevel = 20 THEN 'None/Some Primary'
    WHEN ed_llevel = 999999 OR ed_clevel = 999999 THEN 'Not Stated'
    WHEN ed_attending IS NOT NULL THEN 'Other' END AS attained
  FROM roster)""",
    "heads": """
SELECT interview_key, sex, age_group, ethnicity_group, ed_attainment, employed, workertype_group
FROM members WHERE rel = 1""",
    "ratings": """
SELECT l_orderkey AS interview_key, l_linenumber AS rated,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INTEGER) % 5 + 1 END AS rate
FROM lineitem""",
    "weights": """
SELECT o_orderkey AS interview_key,
  CAST((o_orderkey % 8) * 2.0625 AS DECIMAL(18, 8)) AS hh_weight,
  CAST((o_orderkey % 17) * 1.25 AS DECIMAL(18, 8)) AS ind_weight
FROM orders WHERE o_orderstatus <> 'P'""",
    "frame": """
SELECT c_custkey AS frame_id, n_name AS frame_community, c_nationkey AS ed, c_name AS frame_head,
  CAST(c_custkey // 100 AS INTEGER) AS building_number, CAST((c_custkey // 5) % 10 AS INTEGER) AS dwelling_number,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 9 ELSE CAST(c_custkey % 5 AS INTEGER) END
    AS household_number,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE -88 - (c_custkey % 100) / 1000.0::DOUBLE END AS lon,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 17 + (c_custkey % 37) / 1000.0::DOUBLE END AS lat
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "base": """
SELECT i.*, h.* EXCLUDE (interview_key), w.hh_weight, w.ind_weight, p.* EXCLUDE (address_id),
  CASE WHEN ed_attainment = 'Primary' THEN 'Primary' WHEN ed_attainment IN ('Secondary', 'Tertiary')
    THEN 'Secondary or Higher' ELSE 'Other' END AS education,
  CASE WHEN ethnicity_group IN ('Creole', 'Mestizo/Hispanic/Latino') THEN ethnicity_group ELSE 'Other' END AS ethnicity,
  CASE WHEN w.ind_weight > 0 THEN CAST(round_even(w.ind_weight, 0) AS BIGINT) ELSE 0 END AS copies
FROM interviews i LEFT JOIN heads h USING (interview_key) LEFT JOIN weights w USING (interview_key)
  LEFT JOIN places p USING (address_id)
WHERE i.result_code = 1""",
    "rated_base": "SELECT r.rated, r.rate, b.* FROM ratings r JOIN base b USING (interview_key)",
    "weighted_heads": """
SELECT h.*, w.ind_weight, p.community FROM heads h JOIN interviews i USING (interview_key)
  LEFT JOIN weights w USING (interview_key) LEFT JOIN places p USING (address_id)
WHERE i.result_code = 1""",
    "joined": """
SELECT f.frame_id, f.frame_community, f.frame_head, v.interview_key, v.interview_id, v.result, v.community
FROM frame f LEFT JOIN households v ON f.ed IS NOT DISTINCT FROM v.ed
  AND f.building_number IS NOT DISTINCT FROM v.building_number
  AND f.dwelling_number IS NOT DISTINCT FROM v.dwelling_number
  AND f.household_number IS NOT DISTINCT FROM v.household_number""",
    "first_done": """
SELECT user_id AS interview_key, ts, event_id, value FROM events WHERE event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "diagnostics": """
SELECT event_id AS interview_key, 'interviewer' || (event_id % 7) AS responsible,
  CASE WHEN event_id % 97 = 0 THEN NULL
    ELSE (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 END AS seconds_of_day,
  event_id % 3 AS days
FROM events""",
    "corners": """
SELECT * FROM (VALUES (0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 1, 1), (0, 4, 0, 1),
  (1, 10, 0, 0), (1, 20, 3, 0), (1, 30, 3, 1), (1, 50, 1, 1), (1, 60, 1, 3), (1, 9000, 0, 3),
  (2, 1, 0, 0), (2, 2, 0, 2), (2, 4, 3, 0),
  (3, 7, 0, 0), (3, 8, 0, 3), (3, 9, 1, 3), (3, 10, 1, 1), (3, 11, 3, 1), (3, 5000, 3, 0),
  (4, 3, 2, 2), (5, 1, 0, 0), (5, 2, 4, 2)) AS c(shape, seq, x, y)""",
    # Shoelace sums over the edges from each vertex to the next, the last to the first; closing vertices are left out above.
    "lots": """
SELECT polygon_id, CASE WHEN a = 0 THEN mean_x ELSE mx / (3 * a) END * sx + ox AS lon,
  CASE WHEN a = 0 THEN mean_y ELSE my / (3 * a) END * sy + oy AS lat
FROM (SELECT shape, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS mx, avg(x) AS mean_x,
    sum((y + ny) * (x * ny - nx * y)) AS my, avg(y) AS mean_y
  FROM (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny
    FROM corners WINDOW w AS (PARTITION BY shape ORDER BY seq))
  GROUP BY shape)
JOIN (SELECT c_custkey AS polygon_id, c_custkey % 6 AS shape, -88 - (c_custkey % 100) / 1000.0::DOUBLE AS ox,
    17 + (c_custkey % 37) / 1000.0::DOUBLE AS oy, (1 + c_custkey % 7) * 0.001::DOUBLE AS sx,
    (1 + c_custkey % 5) * 0.001::DOUBLE AS sy FROM customer) USING (shape)""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, and those they name in turn."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                order.append(name)

    visit(body)
    if not order:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def pct(share: str, digits: int = 1, keep_zero: bool = False) -> str:
    text = f"CAST(CAST(round_even(({share}) * 100, {digits}) AS DECIMAL(18, {digits})) AS VARCHAR)"
    if digits and not keep_zero:
        text = f"regexp_replace({text}, '\\.0$', '')"
    return f"{text} || '%'"


def cell(share: str, n: str, digits: int = 1, keep_zero: bool = False) -> str:
    return f"{pct(share, digits, keep_zero)} || ' (' || CAST(CAST(ceil({n}) AS BIGINT) AS VARCHAR) || ')'"


def stacked(template: str, dims: list[str], total: bool = True) -> str:
    """One SELECT per dimension, and the Total; ``{d}`` / ``{item}`` / ``{g}`` are filled in."""
    parts = [template.format(d=f"'{d}'", item=f"CAST({d} AS VARCHAR)", g=f"{d}, ") for d in dims]
    if total:
        parts.append(template.format(d="'Total'", item="'Total'", g=""))
    return "\nUNION ALL\n".join(parts)
