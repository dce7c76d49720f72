"""One statement per ready-made query."""

from __future__ import annotations

from oracles.stopwords import ENGLISH
from oracles.views import CONCERNS, DIMENSIONS, OPTIONS, cell, pct, stacked, with_views

# Fixed values, written out here so that a wrong list elsewhere shows.
REVIEW_URL = "https://survey.example.org/interview/review"
EXTRA_STOP_WORDS = [
    "to", "the", "a", "an", "nope", "for", "in", "none", "nome",
]
FILLER_WORDS = [
    "nope", "to", "the", "none", "nothing", "nome", "a", "in", "for", "it", "of", "do", "they", "them", "is",
    "with", "so", "i", "and", "also", "on", "because", "or", "has", "im", "we", "that", "need", "who", "are",
    "about",
]

WEIGHT = "coalesce(sum(ind_weight), 0)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _banner(question: str, n: str, where: str, dims: list[str] = DIMENSIONS, label: str = "") -> str:
    template = (
        f"SELECT {label}{{d}} AS dimension, {{item}} AS item, {question} AS answer, {n} AS n "
        f"FROM base WHERE {where} GROUP BY {{g}}{question}"
    )
    return stacked(template, dims)


def _with_prop(inner: str, by: str = "dimension, item", cols: str = "dimension, item, answer", kind: str = "DOUBLE") -> str:
    return f"""
SELECT {cols}, CAST(n AS {kind}) AS n, CAST(total AS {kind}) AS total,
  round_even(CAST(n AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 6) AS prop
FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total FROM ({inner}))"""


def _option_rows(source: str, dims: list[str], w: str, total: bool = True, extra: str = "") -> str:
    """Selected, answered and everyone per dimension and option, one SELECT each."""
    parts = []
    for o in OPTIONS:
        template = (
            f"SELECT {{d}} AS dimension, {{item}} AS item, '{o}' AS option, "
            f"coalesce(sum({o} * {w}), 0) AS selected, "
            f"coalesce(sum(CASE WHEN {o} IS NOT NULL THEN {w} END), 0) AS answered, "
            f"coalesce(sum({w}), 0) AS everyone FROM {source} {extra} GROUP BY {{g}}option"
        )
        parts.append(stacked(template, dims, total))
    return "\nUNION ALL\n".join(parts)


def _preparation() -> dict[str, str]:
    return {
        "scan_survey": "SELECT interview_key, interview_id, result_code, result, q1, q2 FROM interviews",
        "scan_weights": "SELECT interview_key, CAST(hh_weight AS DOUBLE) AS hh_weight, "
        "CAST(ind_weight AS DOUBLE) AS ind_weight FROM weights",
        "assignment_list": "SELECT ed, building_number, dwelling_number, household_number, head_name, responsible, "
        "interview_key FROM households",
        "sample_frame": "SELECT frame_id, ed, frame_head, frame_community, household_number, lat, lon FROM frame",
        "cover_vars": "SELECT interview_key, community AS ctv, strata, ed, building_number, household_number, "
        "dwelling_number, result FROM households",
        "exclude_keys": """
SELECT interview_key, community, responsible FROM households
WHERE (community IS NULL OR community NOT IN ('NATION_3', 'NATION_7'))
  AND responsible NOT IN ('interviewer3', 'interviewer5')""",
        "eligible_respondents": """
SELECT r.interview_key, r.rel, CAST(r.age AS INTEGER) AS age, h.district, h.community
FROM roster r JOIN households h USING (interview_key)
WHERE r.age >= 14 AND (h.result = 'Completed' OR h.q2 IS NOT NULL) AND h.district IS NOT NULL
  AND h.community <> 'NATION_0'""",
        "complete_cases": "SELECT interview_key, a1_1, a1_2, a1_3 FROM interviews WHERE q1 IS NOT NULL AND "
        + " AND ".join(f"{c} <> 'Not stated'" for c in CONCERNS),
        "age_bands": """
SELECT age, CASE WHEN age >= 50 THEN '50+' WHEN age >= 35 THEN '35-49' WHEN age >= 18 THEN '18-34'
    WHEN age >= 5 THEN '5-17' WHEN age >= 0 THEN '0-4' END AS household_band,
  CASE WHEN age >= 50 THEN '50+' WHEN age >= 36 THEN '36-49' WHEN age >= 18 THEN '18-35' WHEN age >= 5 THEN '5-17'
    WHEN age >= 0 THEN '0-4' END AS draft_band,
  CASE WHEN age >= 26 THEN '26-29' WHEN age >= 22 THEN '22-25' WHEN age >= 18 THEN '18-21' WHEN age >= 14 THEN '14-17'
    ELSE 'Missing' END AS youth_band,
  count(*) AS n
FROM (SELECT CASE WHEN age = 33 THEN 29 ELSE age END AS age FROM roster) GROUP BY ALL""",
        "derive_education": """
SELECT CAST(ed_attending AS BIGINT) AS ed_attending, CAST(ed_clevel AS BIGINT) AS ed_clevel, ed_llevel, attained,
  CASE WHEN ed_clevel BETWEEN 0 AND 8 THEN 'None/Some Primary' WHEN ed_clevel BETWEEN 9 AND 12 THEN 'Primary'
    WHEN ed_clevel = 17 THEN 'Secondary' WHEN ed_clevel IN (18, 19) THEN 'Tertiary'
    WHEN ed_llevel BETWEEN 0 AND 7 THEN 'None/Some Primary' WHEN ed_llevel BETWEEN 8 AND 11 THEN 'Primary'
    WHEN ed_llevel = 12 THEN 'Secondary' WHEN ed_llevel BETWEEN 17 AND 19 THEN 'Tertiary'
    WHEN ed_llevel = 21 THEN 'Never Attended' WHEN ed_llevel = 20 THEN 'None/Some Primary'
    WHEN ed_llevel = 999999 OR ed_clevel = 999999 OR ed_attending IS NOT NULL THEN 'Not Stated' END AS attained_head,
  count(*) AS n
FROM members GROUP BY ALL""",
        "derive_worker": """
SELECT workertype, employed, workertype_group AS worker, coalesce(CASE WHEN workertype IN (1, 2) THEN 'Self Employed'
    WHEN workertype IN (3, 4) THEN 'Employee' WHEN workertype = 999999 THEN 'Not Stated'
    WHEN workertype >= 5 THEN 'Other' END, 'Not Employed') AS worker_head, count(*) AS n
FROM members GROUP BY ALL""",
        "lump_other": """
SELECT CASE WHEN community IN ('NATION_1', 'NATION_2', 'NATION_5') THEN community ELSE 'Other' END AS community_group,
  CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN segment ELSE 'Other' END AS segment_group, count(*) AS n
FROM households GROUP BY ALL""",
        "standardise_names": """
SELECT CASE frame_community WHEN 'NATION_4' THEN 'Lower/New/East' WHEN 'NATION_9' THEN 'Progress/Upper'
  ELSE frame_community END AS community, ed, count(*) AS n FROM frame GROUP BY ALL""",
        "decode_labels": """
SELECT h.interview_key, h.result AS result_code_label, CAST(h.result_code AS BIGINT) AS result_code_order,
  n_name AS ed_label, CAST(n_nationkey + 1 AS BIGINT) AS ed_order
FROM households h LEFT JOIN nation ON h.ed = n_nationkey""",
        "recode_levels": """
SELECT q1, CASE q1 WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low'
  WHEN '4-NOT SPECIFIED' THEN 'Unspecified' ELSE q1 END AS q1_group, count(*) AS n FROM interviews GROUP BY ALL""",
        "ordered_levels": """
SELECT level, CAST(CASE level WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3
  WHEN '1-URGENT' THEN 4 END AS BIGINT) AS level_order, n
FROM (SELECT CASE WHEN q1 <> '5-LOW' THEN q1 END AS level, count(*) AS n FROM interviews GROUP BY 1)""",
        "observed_levels": """
SELECT DISTINCT 'result_code' AS variable, CAST(result_code AS BIGINT) AS code, result AS label,
  CAST(result_code AS BIGINT) AS level_order FROM interviews WHERE result_code IS NOT NULL
UNION ALL SELECT DISTINCT 'round_code', CAST(left(round, 1) AS BIGINT), round, CAST(left(round, 1) AS BIGINT)
  FROM interviews
UNION ALL SELECT DISTINCT 'ticked', CAST(m__1 AS BIGINT), CASE m__1 WHEN 1 THEN 'Yes' ELSE 'No' END,
  CAST(m__1 + 1 AS BIGINT) FROM interviews WHERE m__1 IS NOT NULL""",
        "anonymised_export": f"""
SELECT interview_key, community AS ctv, strata, CAST(sex AS BIGINT) AS sex, age_group, ethnicity_group, ed_attainment,
  CAST(employed AS BIGINT) AS employed, workertype_group, education, ethnicity, q1, q2,
  {", ".join(f"CAST({o} AS BIGINT) AS {o}" for o in OPTIONS)}, CAST(ind_weight AS DOUBLE) AS weight
FROM base WHERE ind_weight IS NOT NULL""",
        "anonymised_ratings": """
SELECT CAST(rated AS BIGINT) AS rated_item, CAST(rate AS BIGINT) AS rate, interview_key, community AS ctv, strata,
  CAST(sex AS BIGINT) AS sex, age_group, ethnicity, ethnicity_group, education, ed_attainment,
  CAST(employed AS BIGINT) AS employed, workertype_group, CAST(ind_weight AS DOUBLE) AS weight FROM rated_base""",
        "replaced_table": "SELECT interview_key, result FROM interviews",
        "replaced_together": """
SELECT result, count(DISTINCT interview_key) AS interviews, count(rel) AS members
FROM interviews LEFT JOIN roster USING (interview_key) GROUP BY result""",
        "audit_log": """
SELECT strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CAST(user_id AS VARCHAR) AS user,
  CASE event_type WHEN 'purchase' THEN 'Completed' ELSE event_type END AS action FROM events""",
        "first_columns": "SELECT interview_key, interview_id, address_id, result_code, result, round FROM interviews",
        "not_listed_answers": """
SELECT result, count(*) FILTER (WHERE q2 IS NULL OR q2 NOT IN ('Yes', 'DK')) AS not_listed,
  count(*) FILTER (WHERE q2 <> 'Yes') AS other_than_yes, count(*) AS n FROM interviews GROUP BY result""",
        "place_of_interview": "SELECT interview_key, address_id, community, district FROM households",
    }


def _links() -> dict[str, str]:
    return {
        "attach_weights": """
SELECT i.interview_key, i.result, CAST(w.hh_weight AS DOUBLE) AS hh_weight, CAST(w.ind_weight AS DOUBLE) AS ind_weight
FROM interviews i LEFT JOIN weights w USING (interview_key)""",
        "cover_to_roster": """
SELECT i.interview_key, i.result, CAST(r.rel AS BIGINT) AS rel, r.age
FROM interviews i LEFT JOIN roster r USING (interview_key)""",
        "full_roster": """
SELECT interview_key, i.result, CAST(r.rel AS BIGINT) AS rel
FROM interviews i FULL JOIN roster r USING (interview_key)""",
        "head_attributes": """
SELECT i.interview_key, i.result, CAST(h.sex AS BIGINT) AS sex, h.age_group, h.ethnicity_group, h.ed_attainment,
  CAST(h.employed AS BIGINT) AS employed, h.workertype_group
FROM interviews i LEFT JOIN heads h USING (interview_key)""",
        "frame_join": "SELECT frame_id, frame_community, interview_key, interview_id, result FROM joined",
        "frame_semi": """
SELECT frame_id, frame_community, frame_head FROM frame
WHERE EXISTS (SELECT 1 FROM households h WHERE frame.ed IS NOT DISTINCT FROM h.ed
  AND frame.building_number IS NOT DISTINCT FROM h.building_number AND frame.dwelling_number IS NOT DISTINCT FROM h.dwelling_number
  AND frame.household_number IS NOT DISTINCT FROM h.household_number)""",
        "refreshed_frame": """
SELECT frame_id, frame_community, round_even(l.lon, 6) AS lon, round_even(l.lat, 6) AS lat
FROM frame JOIN lots l ON frame_id = polygon_id""",
        "first_completed": """
SELECT interview_key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS date, event_id AS action_id, value AS amount
FROM first_done""",
        "paradata_link": """
SELECT i.interview_key, i.result, d.responsible, d.seconds_of_day + 86400 * d.days AS seconds,
  strftime(f.ts, '%Y-%m-%d %H:%M:%S.%f') AS date
FROM interviews i LEFT JOIN diagnostics d USING (interview_key) LEFT JOIN first_done f USING (interview_key)""",
        "duplicate_keys": """
SELECT frame_id, dupe_count FROM (SELECT frame_id, count(*) OVER
  (PARTITION BY ed, building_number, dwelling_number, household_number) AS dupe_count FROM frame) WHERE dupe_count > 1""",
        "numeric_ids": """
SELECT frame_id, frame_id AS head_number, CAST(NULL AS BIGINT) AS not_a_number, lat FROM frame""",
    }


MEMBER_VARIABLES = {
    "sex": "Sex",
    "age_group": "Age",
    "ethnicity_group": "Ethnicity",
    "ed_attainment": "Education",
    "employed": "Employment",
    "workertype_group": "Worker type",
}


def _described(source: str, variables: dict[str, str], n: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{label}' AS dimension, CAST({c} AS VARCHAR) AS item, {n} AS n FROM {source} GROUP BY {c}"
        for c, label in variables.items()
    )


def _margins(source: str, row: str, col: str, where: str = "true", rows: bool = True, cols: bool = True) -> str:
    r, c = f"CAST({row} AS VARCHAR)", f"CAST({col} AS VARCHAR)"
    src = f"FROM {source} WHERE {where}"
    parts = [
        f"SELECT {r} AS row, {c} AS col, false AS is_total, false AS is_total_col, count(*) AS n {src} GROUP BY {row}, {col}"
    ]
    if cols:
        parts.append(f"SELECT {r}, 'Total', false, true, count(*) {src} GROUP BY {row}")
    if rows:
        parts.append(f"SELECT 'Total', {c}, true, false, count(*) {src} GROUP BY {col}")
    if rows and cols:
        parts.append(f"SELECT 'Total', 'Total', true, true, count(*) {src}")
    double = 2 if cols else 1
    return f"""
SELECT *, n / CAST(row_total AS DOUBLE) AS prop FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY row, is_total) AS BIGINT) // {double} AS row_total
  FROM ({" UNION ALL ".join(parts)}))"""


def _tables() -> dict[str, str]:
    weighted = _described("weighted_heads", {**MEMBER_VARIABLES, "community": "Community"}, WEIGHT)
    charts = [
        ("by community", "community", "NULL"),
        ("by result", "result", "NULL"),
        ("by answer", "q2", "NULL"),
        ("by interviewer and result", "responsible", "result"),
        ("by district and answer", "district", "q2"),
    ]
    wide_bands = ["0-4", "5-17", "18-34", "35-49", "50+"]
    spread = ", ".join(
        f"max(CASE WHEN col = '{p}' THEN cell END) AS \"{p}\"" for p in [*PRIORITIES, "Total"]
    )
    return {
        "freq_counts": "SELECT community, CAST(ed AS BIGINT) AS ed, count(*) AS n FROM households GROUP BY community, ed",
        "weighted_freq": f"""
SELECT dimension, item, CAST(round_even(n, 0) AS BIGINT) AS count, CAST(n AS DOUBLE) AS n,
  {pct("CAST(n AS DOUBLE) / CAST(total AS DOUBLE)")} AS percent,
  round_even(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 6) AS prop
FROM (SELECT *, sum(n) OVER (PARTITION BY dimension) AS total FROM ({weighted}))""",
        "oneway_table": """
SELECT age_group AS item, n, CAST(sum(n) OVER () AS BIGINT) AS total, round_even(n / sum(n) OVER (), 6) AS prop
FROM (SELECT age_group, count(*) AS n FROM members GROUP BY 1)""",
        "descriptives": f"""
SELECT dimension, item, n, CAST(total AS BIGINT) AS total, {pct("CAST(n AS DOUBLE) / CAST(total AS DOUBLE)")} AS percent
FROM (SELECT *, sum(n) OVER (PARTITION BY dimension) AS total
  FROM ({_described("members", MEMBER_VARIABLES, "count(*)")}))""",
        "crosstab": """
SELECT community, count(*) FILTER (WHERE result = 'Completed') AS "Completed",
  count(*) FILTER (WHERE result = 'Partial') AS "Partial", count(*) FILTER (WHERE result = 'Refused') AS "Refused"
FROM households WHERE community IS NOT NULL AND result IS NOT NULL GROUP BY community""",
        "crosstab_margins": f"""
SELECT row, col, is_total, is_total_col, n, round_even(prop, 6) AS prop, {cell("prop", "n", keep_zero=True)} AS cell
FROM ({_margins("households", "community", "q1")})""",
        "cell_share": """
SELECT community AS row, age_group AS col, CAST(n AS DOUBLE) AS n,
  round_even(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS prop
FROM (SELECT community, age_group, coalesce(sum(ind_weight), 0) AS n FROM weighted_heads GROUP BY 1, 2)""",
        "wide_counts": "SELECT result, "
        + ", ".join(f"nullif(count(*) FILTER (WHERE age_group = '{b}'), 0) AS \"{b}\"" for b in wide_bands)
        + " FROM members LEFT JOIN interviews USING (interview_key) GROUP BY result",
        "crosstab_region": f"""
SELECT r.district, t.row, t.col, t.is_total, t.is_total_col, t.n, round_even(t.prop, 6) AS prop, {cell("t.prop", "t.n", keep_zero=True)} AS cell
FROM ({_margins("households", "community", "q1", "q1 <> '4-NOT SPECIFIED'")}) t
LEFT JOIN (SELECT DISTINCT community, district FROM places) r ON r.community = t.row""",
        "crosstab_district": f"""
SELECT row AS district, is_total, {spread} FROM (SELECT row, col, is_total, {cell("prop", "n", keep_zero=True)} AS cell
  FROM ({_margins("households", "district", "q1", "q1 IS NOT NULL")})) GROUP BY row, is_total""",
        "crosstab_constituency": f"""
SELECT p.district, c.* FROM (
  SELECT row AS community, is_total, max(CASE WHEN col = '1-URGENT' THEN cell END) AS "1-URGENT",
    max(CASE WHEN col = '2-HIGH' THEN cell END) AS "2-HIGH", max(CASE WHEN is_total_col THEN cell END) AS "Total"
  FROM (SELECT *, {cell("prop", "n", keep_zero=True)} AS cell
    FROM ({_margins("households", "community", "q1", "q1 IS NOT NULL")})) GROUP BY row, is_total) c
LEFT JOIN (SELECT DISTINCT community, district FROM places) p ON p.community = c.community""",
        "chart_counts": "\nUNION ALL\n".join(
            f"SELECT '{name}' AS chart, CAST({x} AS VARCHAR) AS x, CAST({fill} AS VARCHAR) AS fill, count(*) AS n "
            f"FROM households GROUP BY ALL"
            for name, x, fill in charts
        ),
        "chart_shares": f"""
SELECT district AS x, q1 AS fill, n, round_even(p, 6) AS prop,
  CASE WHEN (district = 'AFRICA' AND q1 IN ('1-URGENT', '2-HIGH')) OR (district = 'ASIA' AND q1 = '1-URGENT')
    OR district = 'EUROPE'
  THEN regexp_replace(CAST(CAST(round_even(p, 3) * 100 AS DECIMAL(9, 1)) AS VARCHAR), '\\.0$', '') || '%'
  ELSE '' END AS label
FROM (SELECT *, n / CAST(sum(n) OVER (PARTITION BY district) AS DOUBLE) AS p
  FROM (SELECT district, q1, count(*) AS n FROM households WHERE q1 IS NOT NULL GROUP BY 1, 2))""",
        "conditional_counts": """
SELECT community, count(*) FILTER (WHERE result = 'Completed') AS completed,
  count(*) FILTER (WHERE result IS NULL) AS no_result, count(q2) AS answered,
  count(*) FILTER (WHERE q2 = 'Yes') AS yes FROM households GROUP BY community""",
        "age_by_sex": "SELECT age, CAST(sex AS BIGINT) AS sex, count(*) AS n FROM roster GROUP BY ALL",
    }


def _printed(option: str) -> str:
    percent = f"CAST(CAST(round_even(coalesce(sum({option}), 0) / CAST(count(*) AS DOUBLE), 3) * 100 AS DECIMAL(9, 1)) AS VARCHAR)"
    return f"regexp_replace({percent}, '\\.0$', '') || '% (' || CAST(coalesce(sum({option}), 0) AS VARCHAR) || ')'"


def _banners() -> dict[str, str]:
    single = _banner("q1", WEIGHT, "q1 IS NOT NULL")
    report = "\nUNION ALL\n".join(
        _banner(q, WEIGHT, f"{q} IS NOT NULL", label=f"'{q}' AS question, ") for q in ["q1", "q2", *CONCERNS]
    )
    answers = ", ".join(f"coalesce(max(CASE WHEN answer = '{p}' THEN c END), '0% (0)') AS \"{p}\"" for p in PRIORITIES)
    p = "CAST(n AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0)"
    rated = stacked(
        "SELECT CAST(rated AS BIGINT) AS rated, {d} AS dimension, {item} AS item, CAST(rate AS BIGINT) AS answer, "
        "ceil(coalesce(sum(ind_weight), 0)) AS n FROM rated_base GROUP BY {g}rated, rate",
        DIMENSIONS,
    )
    points = ", ".join(f"coalesce(max(CASE WHEN answer = {i} THEN c END), '0% (0)') AS rate_{i}" for i in range(1, 6))
    means = stacked(
        "SELECT CAST(rated AS BIGINT) AS rated, {d} AS dimension, {item} AS item, "
        "round_even(CAST(sum(ind_weight * rate) AS DOUBLE) / "
        "nullif(CAST(sum(ind_weight) FILTER (WHERE rate IS NOT NULL) AS DOUBLE), 0), 6) AS mean "
        "FROM rated_base WHERE ind_weight IS NOT NULL GROUP BY {g}rated",
        DIMENSIONS,
    )
    labels = dict(zip(OPTIONS, ["Report", "Scare", "Hunt", "No action", "Other"], strict=True))
    shares = []
    for o, label in labels.items():
        for value, test in (("Yes", f"{o} = 1"), ("No", f"{o} IS DISTINCT FROM 1")):
            shares.append(
                f"SELECT '{label}' AS item, '{value}' AS value, CAST(sum(copies) FILTER (WHERE {test}) AS BIGINT) AS n, "
                f"round_even(sum(copies) FILTER (WHERE {test}) / sum(copies), 6) AS prop "
                "FROM base WHERE ind_weight IS NOT NULL AND m__1 IS NOT NULL"
            )
    heard = stacked(
        "SELECT {d} AS dimension, {item} AS item, CASE WHEN q2 = 'Yes' THEN 'Yes' ELSE 'No or DK' END AS answer, "
        "CAST(sum(copies) AS BIGINT) AS n FROM base GROUP BY {g}answer",
        ["strata"],
    )
    options = ", ".join(f"max(CASE WHEN option = 'm__{i}' THEN c END) AS option_{i}" for i in range(1, 6))
    complete = " AND ".join(f"{c} <> 'Not stated'" for c in CONCERNS)
    concern_levels = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS rated, {c} AS level, CAST(sum(copies) AS BIGINT) AS n FROM base WHERE {complete} GROUP BY {c}"
        for c in CONCERNS
    )
    names = ["One", "Two", "Three", "Four", "Five"]
    counts = ", ".join(f"count(*) FILTER (WHERE rate = {i}) AS \"{n}\"" for i, n in enumerate(names, 1))
    all_five = "CAST((" + " + ".join(f'"{n}"' for n in names) + ") AS DOUBLE)"
    return {
        "banner_single": _with_prop(single),
        "banner_missing": _with_prop(_banner("q2", WEIGHT, "true")),
        "banner_report": _with_prop(report, "question, dimension, item", "question, dimension, item, answer"),
        "banner_unweighted": f"""
SELECT dimension, item, answer, n, CAST(total AS BIGINT) AS total, round_even({p}, 6) AS prop,
  {cell(p, "n", keep_zero=True)} AS cell
FROM (SELECT *, sum(n) OVER (PARTITION BY dimension, item) AS total
  FROM ({_banner("q1", "count(*)", "q1 IS NOT NULL")}))
WHERE item IS NOT NULL""",
        "banner_printed": f"""
SELECT dimension, item, {answers} FROM (
  SELECT dimension, item, answer, CASE WHEN dimension = 'Total' THEN {cell(p, "n")} ELSE {pct(p)} END AS c
  FROM (SELECT *, sum(n) OVER (PARTITION BY dimension, item) AS total FROM ({single})))
GROUP BY dimension, item""",
        "banner_multi": f"""
SELECT dimension, item, option, CAST(s AS DOUBLE) AS selected, CAST(a AS DOUBLE) AS total,
  round_even(CAST(s AS DOUBLE) / nullif(CAST(a AS DOUBLE), 0), 6) AS prop
FROM (SELECT dimension, item, option, ceil(selected) AS s, ceil(answered) AS a
  FROM ({_option_rows("base", DIMENSIONS, "ind_weight")}))""",
        "multi_printed": f"""
SELECT dimension, item, {options} FROM (SELECT dimension, item, option,
    {pct("CAST(s AS DOUBLE) / nullif(CAST(a AS DOUBLE), 0)")} || '(' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ')' AS c
  FROM (SELECT dimension, item, option, ceil(selected) AS s, ceil(answered) AS a
    FROM ({_option_rows("base", DIMENSIONS, "ind_weight")})))
GROUP BY dimension, item""",
        "multi_unweighted": f"""
SELECT dimension, item, option, CAST(selected AS DOUBLE) AS selected, CAST(answered AS DOUBLE) AS total,
  round_even(selected / nullif(CAST(answered AS DOUBLE), 0), 6) AS prop
FROM ({_option_rows("base", DIMENSIONS, "1")})""",
        "multi_mention_share": f"""
SELECT dimension, item, option, CAST(selected AS DOUBLE) AS selected, CAST(t AS DOUBLE) AS total,
  round_even(selected / nullif(CAST(t AS DOUBLE), 0), 6) AS prop
FROM (SELECT *, sum(selected) OVER (PARTITION BY dimension, item) AS t
  FROM ({_option_rows("households", ["district"], "1")}))""",
        "multi_mentions": "SELECT strata, option, is_total, n FROM (\n"
        + "\nUNION ALL\n".join(
            f"SELECT strata, '{o}' AS option, false AS is_total, CAST(sum({o}) AS BIGINT) AS n FROM households GROUP BY strata"
            for o in OPTIONS
        )
        + "\nUNION ALL\nSELECT strata, 'Total', true, CAST(sum("
        + " + ".join(f"coalesce({o}, 0)" for o in OPTIONS)
        + ") AS BIGINT) FROM households GROUP BY strata) WHERE n > 0",
        "multiselect_region": "\nUNION ALL\n".join(
            f"SELECT {d} AS district, '{o}' AS option, CAST(coalesce(sum({o}), 0) AS BIGINT) AS n, count(*) AS total, "
            f"round_even(coalesce(sum({o}), 0) / CAST(count(*) AS DOUBLE), 6) AS prop FROM households {g}"
            for o in OPTIONS
            for d, g in (("district", "GROUP BY district"), ("'National'", ""))
        ),
        "multiselect_constituency": "\nUNION ALL\n".join(
            f"SELECT district, community, '{o}' AS option, CAST(coalesce(sum({o}), 0) AS BIGINT) AS n, "
            f"count(*) AS total, round_even(coalesce(sum({o}), 0) / CAST(count(*) AS DOUBLE), 6) AS prop "
            "FROM households GROUP BY district, community"
            for o in OPTIONS
        ),
        "region_printed": "SELECT district, is_overall, "
        + ", ".join(f"max(CASE WHEN option = '{o}' THEN c END) AS {o}" for o in OPTIONS)
        + " FROM ("
        + "\nUNION ALL\n".join(
            f"SELECT {d} AS district, {whole} AS is_overall, '{o}' AS option, {_printed(o)} AS c FROM households {g}"
            for o in OPTIONS
            for d, whole, g in (("district", "false", "GROUP BY district"), ("'National'", "true", ""))
        )
        + ") GROUP BY district, is_overall",
        "constituency_printed": "SELECT district, community, "
        + ", ".join(f"{_printed(o)} AS {o}" for o in OPTIONS)
        + " FROM households GROUP BY district, community",
        "multi_item_share": "\nUNION ALL\n".join(shares),
        "yes_share": _with_prop(heard, kind="BIGINT"),
        "rating_distribution": _with_prop(rated, "rated, dimension, item", "rated, dimension, item, answer"),
        "rating_wide": f"""
SELECT rated, dimension, item, {points} FROM (SELECT rated, dimension, item, answer, {cell(p, "n")} AS c
  FROM (SELECT *, sum(n) OVER (PARTITION BY rated, dimension, item) AS total FROM ({rated})))
GROUP BY rated, dimension, item""",
        "rating_means": means,
        "rating_means_wide": f"""
SELECT dimension, item,
  {", ".join(f"coalesce(max(CASE WHEN rated = {i} THEN printf('%.2f', m) END), '0% (0)') AS item_{i}" for i in range(1, 8))}
FROM ({means.replace(", 6) AS mean", ", 2) AS m")}) GROUP BY dimension, item""",
        "weighted_mean": """
SELECT CAST(rated AS BIGINT) AS rated_item, round_even(CAST(sum(ind_weight * rate) AS DOUBLE) /
  CAST(sum(ind_weight) FILTER (WHERE rate IS NOT NULL) AS DOUBLE), 2) AS mean
FROM rated_base WHERE ind_weight IS NOT NULL GROUP BY rated""",
        "likert_summary": """
SELECT "group", rated, level, n, CAST(total AS BIGINT) AS total, round_even(n / CAST(total AS DOUBLE), 6) AS prop
FROM (SELECT *, sum(n) OVER (PARTITION BY "group", rated) AS total FROM (
  SELECT strata AS "group", CAST(rated AS BIGINT) AS rated, CAST(rate AS BIGINT) AS level,
    CAST(sum(copies) AS BIGINT) AS n
  FROM rated_base WHERE rate IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(copies) > 0))""",
        "likert_overall": f"""
SELECT rated, level, n, CAST(total AS BIGINT) AS total, round_even(n / CAST(total AS DOUBLE), 6) AS prop
FROM (SELECT *, sum(n) OVER (PARTITION BY rated) AS total FROM ({concern_levels}) WHERE n > 0)""",
        "likert_items": "SELECT rated, "
        + ", ".join(f'"{n}", round_even("{n}" / {all_five}, 6) AS {n.lower()}_share' for n in names)
        + f', round_even(("Four" + "Five") / {all_five}, 6) AS positive_share FROM '
        + f"(SELECT CAST(rated AS BIGINT) AS rated, {counts} FROM ratings GROUP BY 1)",
    }


def _progress_rows(extra: str) -> str:
    return f"""
SELECT frame_community AS community, false AS is_total, count(frame_id) AS sampled, count(interview_key) AS visited,
  count(*) FILTER (WHERE result = 'Completed') AS completed FROM joined GROUP BY frame_community
UNION ALL SELECT 'Total', true, count(frame_id), count(interview_key), count(*) FILTER (WHERE result = 'Completed')
FROM joined {extra}"""


def _cleaned(text: str) -> str:
    """Delete fillers: words are put between marks first, so a mark on both sides means a whole word."""
    marked = f"regexp_replace({text}, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
    fillers = "|".join(FILLER_WORDS)
    # The empty mark reads ##<N>/<A>## once its letters are marked.
    gone = f"(?i)\\x01(?:{fillers})\\x02|\\x01no\\x02(?:$)|##\\x01N\\x02/\\x01A\\x02##"
    return f"regexp_replace(regexp_replace({marked}, '{gone}', '', 'g'), '[\\x01\\x02]', '', 'g')"


def _fieldwork() -> dict[str, str]:
    inner = "[\\p{L}\\p{M}\\p{N}_]"
    tokens = f"regexp_extract_all(lower({_cleaned('text')}), '[\\p{{L}}\\p{{N}}]{inner}*(?:[''’]{inner}+)*')"
    vocabulary = (
        f"SELECT word, count(*) AS n FROM (SELECT unnest({tokens}) AS word FROM documents) "
        f"WHERE word NOT IN ({_quoted([*ENGLISH, *EXTRA_STOP_WORDS])}) GROUP BY word"
    )
    link = f"'{REVIEW_URL}/' || interview_id"
    needed = "({nrr} * 1.96 * 1.96 * 0.25) / (0.0064::DOUBLE + 1.96::DOUBLE * 1.96 * 0.25 / n)"
    return {
        "kpis": """
SELECT count(*) AS submitted, count(*) FILTER (WHERE result = 'Completed') AS completed,
  count(*) FILTER (WHERE result = 'Partial') AS partial,
  round_even(count(*) FILTER (WHERE result IN ('Completed', 'Partial')) / CAST(count(*) AS DOUBLE), 2) AS response_rate,
  count(DISTINCT coalesce(community, '?')) AS communities_started,
  (SELECT count(*) FROM (SELECT frame_community FROM joined GROUP BY 1
    HAVING count(*) FILTER (WHERE community IS NULL) = 0)) AS communities_completed
FROM households""",
        "pending_by_community": """
SELECT frame_community, count(*) FILTER (WHERE community IS NULL) AS pending FROM joined GROUP BY 1""",
        "communities": "SELECT frame_community, count(interview_key) > 0 AS started FROM joined GROUP BY 1",
        "progress_table": f"""
SELECT *, {pct("visited / CAST(sampled AS DOUBLE)")} AS visited_pct,
  {pct("completed / CAST(sampled AS DOUBLE)")} AS completed_pct FROM ({_progress_rows("")})""",
        "submission_table": f"""
WITH s AS (SELECT frame_community AS community, ed, count(*) AS sampled FROM frame GROUP BY 1, 2),
g AS (SELECT community, ed, count(*) AS submitted, nullif(count(*) FILTER (WHERE result = 'Completed'), 0) AS completed
  FROM households GROUP BY 1, 2),
t AS (SELECT s.community, CAST(s.ed AS VARCHAR) AS ed, sampled, submitted, completed FROM s LEFT JOIN g
  ON s.community IS NOT DISTINCT FROM g.community AND s.ed = g.ed)
SELECT *, {pct("completed / CAST(sampled AS DOUBLE)")} AS completed_pct FROM t
UNION ALL SELECT 'All', 'All', CAST(sum(sampled) AS BIGINT), CAST(sum(submitted) AS BIGINT),
  CAST(sum(completed) AS BIGINT), {pct("sum(completed) / CAST(sum(sampled) AS DOUBLE)", 0)} FROM t""",
        "response_table": f"""
SELECT row, col, is_total, n, row_total, {cell("prop", "n", 0)} AS cell
FROM ({_margins("households", "community", "result", cols=False)})""",
        "map_status": f"""
SELECT frame_id, interview_key, frame_community,
  CASE WHEN result = 'Completed' THEN 'green' WHEN result IS NOT NULL THEN 'orange' ELSE 'white' END AS colour,
  frame_head AS head, result, CASE WHEN interview_key IS NOT NULL THEN {link} END AS link FROM joined""",
        "nonrespondents": f"""
SELECT interview_key, head_name, community, result, responsible, {link} AS link FROM households
WHERE result <> 'Completed'""",
        "missing_result": f"""
SELECT interview_key, head_name, community, responsible, {link} AS link FROM households WHERE result IS NULL""",
        "missing_info": """
SELECT interview_key, CAST(rel AS BIGINT) AS rel, CAST(sex AS BIGINT) AS sex FROM roster WHERE age IS NULL""",
        "interviews_by_interviewer": """
SELECT CASE responsible WHEN 'interviewer0' THEN 'North' WHEN 'interviewer1' THEN 'South' WHEN 'interviewer2' THEN 'West'
  WHEN 'interviewer4' THEN 'Coast' END AS interviewer, count(*) AS n FROM interviews GROUP BY 1""",
        "duration_seconds": """
SELECT interview_key, seconds_of_day + 86400 * days AS seconds, seconds_of_day FROM diagnostics""",
        "sample_size": f"""
SELECT frame_community, n AS households, round_even({needed.format(nrr="1::DOUBLE")}, 6) AS needed,
  round_even({needed.format(nrr="1.1::DOUBLE")}, 6) AS needed_adjusted
FROM (SELECT frame_community, count(*) AS n FROM frame GROUP BY 1)""",
        "design_weights": """
WITH adults AS (SELECT interview_key, count(*) FILTER (WHERE age >= 18) AS adults FROM roster GROUP BY 1),
done AS (SELECT interview_key, community FROM households WHERE result = 'Completed'),
f AS (SELECT frame_community, count(*) AS big FROM frame GROUP BY 1),
s AS (SELECT community, count(*) AS small FROM done GROUP BY 1)
SELECT d.interview_key, d.community, round_even(f.big / CAST(s.small AS DOUBLE), 6) AS hh_weight, a.adults,
  round_even(f.big / CAST(s.small AS DOUBLE) * a.adults, 6) AS ind_weight
FROM done d LEFT JOIN s ON d.community IS NOT DISTINCT FROM s.community
LEFT JOIN f ON d.community IS NOT DISTINCT FROM f.frame_community LEFT JOIN adults a USING (interview_key)""",
        "systematic_sample": """
SELECT frame_id, frame_community, position, stratum_n FROM (
  SELECT frame_id, frame_community, least(20, count(*) OVER (PARTITION BY frame_community)) AS k,
    count(*) OVER (PARTITION BY frame_community) AS stratum_n,
    row_number() OVER (PARTITION BY frame_community ORDER BY md5('frame' || frame_id), frame_id) AS position
  FROM frame)
WHERE (position * k) // stratum_n > ((position - 1) * k) // stratum_n""",
        "expand_by_weight": """
SELECT interview_key, CAST(ind_weight AS DOUBLE) AS ind_weight FROM (SELECT interview_key, ind_weight,
  unnest(range(CAST(round_even(ind_weight, 0) AS BIGINT))) AS i FROM weights)""",
        "polygon_centroids": "SELECT polygon_id, round_even(lon, 6) AS lon, round_even(lat, 6) AS lat FROM lots",
        "open_text_clean": f"SELECT doc_id AS answer_id, {_cleaned('text')} AS cleaned FROM documents",
        "open_text_words": f"SELECT word, n FROM ({vocabulary}) ORDER BY n DESC, word LIMIT 100",
        "open_text_vocabulary": vocabulary,
        "open_text_trigrams": f"""
SELECT t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS words, count(*) AS n
FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {tokens} AS t FROM documents))
GROUP BY 1 ORDER BY n DESC, words LIMIT 30""",
        "open_text_top_triples": f"""
SELECT t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS words, count(*) AS n
FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {tokens} AS t FROM documents))
GROUP BY 1 ORDER BY n DESC, words LIMIT 30""",
        "refresh_latest": """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "present_status_counts": """
SELECT p.community, status, count(*) AS n FROM (SELECT user_id, event_type AS status FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) LEFT JOIN places p ON user_id = p.address_id
GROUP BY 1, 2""",
        "stream_status_counts": """
SELECT p.community, event_type AS status, count(*) AS n FROM events LEFT JOIN places p ON user_id = p.address_id
GROUP BY 1, 2""",
    }


def oracle_sql() -> dict[str, str]:
    statements = {**_preparation(), **_links(), **_tables(), **_banners(), **_fieldwork()}
    return {name: with_views(sql) for name, sql in statements.items()}
