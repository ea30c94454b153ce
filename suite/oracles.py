"""The same results in SQL, for comparison on the same tables."""

from __future__ import annotations

CATEGORIES = ("economy", "large", "medium", "promo", "small", "standard", "<na>")

# Named subqueries; each may use those above it.
PARTS: dict[str, str] = {
    "codes": "SELECT DISTINCT o_orderpriority AS dx_code FROM orders",
    "dx": """
        SELECT o_custkey AS client_id, o_orderdate::DATE AS date, o_orderstatus AS phase,
          CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS ax_1_1,
          CASE WHEN o_totalprice > 400000 THEN o_orderpriority END AS ax_1_2,
          NULL::VARCHAR AS ax_1_3, NULL::VARCHAR AS ax_1_4,
          CASE WHEN o_totalprice > 300000 THEN o_orderstatus END AS ax_2_1,
          NULL::VARCHAR AS ax_2_2, NULL::VARCHAR AS ax_3,
          CASE WHEN o_totalprice > 200000 THEN 'yes' END AS ax_4,
          CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS gaf1,
          NULL::DOUBLE AS gaf2, o_orderkey
        FROM orders""",
    "clients": """
        SELECT c_custkey AS client_id,
          CASE WHEN c_acctbal >= 0
            THEN DATE '1995-01-01' + ((c_custkey * 37) % 900)::INT END AS date,
          c_mktsegment AS gender, (1940 + c_custkey % 60)::INT AS year_of_birth,
          c_nationkey AS zip
        FROM customer""",
    "dbc": """
        SELECT o_custkey AS client_id,
          CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS date_stop,
          CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS claimed
        FROM orders""",
    "interventions": """
        SELECT l_shipdate::DATE AS date,
          CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 END::BIGINT AS dbc_id,
          CASE WHEN NOT (l_quantity = 50 AND l_discount < 0.005) THEN l_quantity END
            AS mins_direct_staff,
          l_linenumber::DOUBLE AS mins_indirect_staff, l_partkey AS intervention_type_id,
          CASE WHEN l_tax > 0 THEN l_suppkey END AS team_id, o_custkey AS client_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "types": """
        SELECT p_partkey AS intervention_type_id,
          CASE WHEN p_brand <> 'Brand#1' THEN p_type END AS description_cat
        FROM part""",
    "teams": """
        SELECT s_suppkey AS team_id, s_name AS team, n_name AS subdepartment,
          'dept ' || n_regionkey AS department, r_name AS organisation
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey""",
    "first_dx": """
        SELECT client_id, ax_1_1 AS dx, date AS dx_date FROM (
          SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY date, o_orderkey) AS rn
          FROM dx WHERE phase IN ('O', 'F') AND year(date) >= 1996)
        WHERE rn = 1""",
    "idx": """
        SELECT * FROM first_dx WHERE dx IN (
          SELECT dx_code FROM codes WHERE regexp_matches(dx_code, '1-URGENT|2-HIGH'))""",
    "cohort": """
        SELECT i.client_id, gender, year_of_birth, c.date AS enroll_date, dx, dx_date, zip
        FROM idx i LEFT JOIN clients c USING (client_id)
        WHERE DATE '2001-08-01' - dx_date >= 1825 AND c.date IS NOT NULL AND dx_date >= c.date""",
    "costs": """
        SELECT client_id, coalesce(sum(claimed), 0) AS costs
        FROM dbc JOIN cohort USING (client_id) WHERE date_stop > dx_date GROUP BY client_id""",
    "tl": """
        SELECT client_id, year(date)::INT AS year, month(date)::INT AS month,
          CASE WHEN day < -730 THEN 'history' WHEN day < 0 THEN 'look_back'
            ELSE 'follow_up' END AS period,
          coalesce(lower(description_cat), '<na>') AS category, team_id, day AS day_first,
          day AS day_last, 1::BIGINT AS n, nb, (total IS NULL)::BIGINT AS unknown,
          coalesce(total, 0) AS mins, coalesce(total, 0) * nb AS minsb,
          coalesce(total, 0) * (1 - nb) AS minss, listed
        FROM (
          SELECT e.*, description_cat, (date - dx_date)::INT AS day,
            coalesce(dbc_id < 0, false)::BIGINT AS nb,
            mins_direct_staff + mins_indirect_staff AS total,
            coalesce(mins_direct_staff, 0) + coalesce(mins_indirect_staff, 0) AS listed
          FROM interventions e JOIN cohort USING (client_id)
            LEFT JOIN types USING (intervention_type_id))
        WHERE day <= 1825""",
    "prior": """
        SELECT client_id, (-min(day_first))::INT AS days_prev, sum(n)::BIGINT AS n_prev,
          CASE WHEN sum(unknown) = 0 THEN round_even(sum(mins), 0) ELSE 0 END AS mins_prev
        FROM tl WHERE period <> 'follow_up' GROUP BY client_id""",
}


def _care(keys: str, periods: str) -> str:
    minutes = ", ".join(
        f"CASE WHEN sum(unknown) = 0 THEN round_even(sum({c}), 0) END AS {c}"
        for c in ("mins", "minsb", "minss")
    )
    return f"""
        SELECT {keys}, max(day_last) AS "days", sum(n)::BIGINT AS n, sum(nb)::BIGINT AS nb,
          (sum(n) - sum(nb))::BIGINT AS ns, {minutes}
        FROM tl WHERE period IN ({periods}) GROUP BY {keys}"""


def _counts() -> str:
    return ", ".join(
        f"sum(CASE WHEN category = '{c}' THEN n ELSE 0 END)::BIGINT AS \"n_{c}\"" for c in CATEGORIES
    )


def _minutes() -> str:
    return ", ".join(
        f"round_even(sum(CASE WHEN category = '{c}' THEN listed ELSE 0 END), 0) AS \"mins_{c}\""
        for c in CATEGORIES
    )


MONTHS = "'look_back', 'follow_up'"
PARTS["post"] = _care("client_id", "'follow_up'")
PARTS["month_care"] = _care("client_id, year, month", MONTHS)
PARTS["mins_wide"] = (
    f"SELECT client_id, {_minutes()} FROM tl WHERE period = 'follow_up' GROUP BY client_id"
)
PARTS["n_wide"] = (
    f"SELECT client_id, {_counts()} FROM tl WHERE period = 'follow_up' GROUP BY client_id"
)
PARTS["month_features"] = f"""
    SELECT client_id, year, month, {_counts()}, {_minutes()}
    FROM tl WHERE period IN ({MONTHS}) GROUP BY client_id, year, month"""
PARTS["team_mins"] = """
    SELECT client_id, team_id, sum(n)::BIGINT AS n, round_even(sum(listed), 0) AS mins
    FROM tl WHERE period = 'follow_up' AND team_id IS NOT NULL GROUP BY client_id, team_id"""
PARTS["best_team"] = """
    SELECT client_id, team_id, mins AS team_mins, team, subdepartment, department, organisation
    FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY mins DESC, team_id) AS rn
          FROM team_mins)
      LEFT JOIN teams USING (team_id)
    WHERE rn = 1"""
PARTS["patients"] = """
    SELECT * REPLACE (round(costs, 2) AS costs)
    FROM cohort JOIN costs USING (client_id) LEFT JOIN prior USING (client_id)
      JOIN post USING (client_id) LEFT JOIN best_team USING (client_id)
      JOIN n_wide USING (client_id) JOIN mins_wide USING (client_id)
    WHERE "days" >= 5 AND n >= 5 AND mins >= 60"""


def sql(select: str) -> str:
    """``select`` preceded by the named subqueries it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        import re

        for word in set(re.findall(r"[a-z_0-9]+", text)):
            if word in PARTS and word not in needed:
                needed.add(word)
                visit(PARTS[word])

    visit(select)
    parts = ", ".join(f"{name} AS ({body})" for name, body in PARTS.items() if name in needed)
    return f"WITH {parts} {select}" if parts else select


ORACLES: dict[str, str] = {
    "target_codes": "SELECT dx_code FROM codes WHERE regexp_matches(dx_code, '1-URGENT|2-HIGH')",
    "target_codes_of_group": """
        SELECT dx_code FROM codes
        WHERE regexp_matches(dx_code, '1-URGENT|2-HIGH') AND substr(dx_code, 1, 1) = '1'""",
    "episode_costs_of_type": """
        SELECT client_id, round(sum(claimed), 2) AS costs FROM dbc JOIN cohort USING (client_id)
        WHERE date_stop > dx_date AND claimed > 100000 GROUP BY client_id""",
    "first_diagnosis": "SELECT * FROM first_dx",
    "index_event": "SELECT * FROM idx",
    "index_cohort": "SELECT * FROM cohort",
    "episode_costs": "SELECT client_id, round(costs, 2) AS costs FROM costs",
    "event_timeline": "SELECT * FROM tl",
    "compact_timeline": """
        SELECT client_id, year, month, period, category, team_id, min(day_first) AS day_first,
          max(day_last) AS day_last, sum(n)::BIGINT AS n, sum(nb)::BIGINT AS nb,
          sum(unknown)::BIGINT AS unknown, sum(mins) AS mins, sum(minsb) AS minsb,
          sum(minss) AS minss, sum(listed) AS listed
        FROM tl GROUP BY client_id, year, month, period, category, team_id""",
    "prior_care_summary": "SELECT * FROM prior",
    "post_index_summary": "SELECT * FROM post",
    "activity_long": """
        SELECT client_id, category, sum(n)::BIGINT AS n, round_even(sum(listed), 0) AS mins
        FROM tl WHERE period = 'follow_up' GROUP BY client_id, category""",
    "activity_mins_wide": "SELECT * FROM mins_wide",
    "activity_n_wide": "SELECT * FROM n_wide",
    "activity_totals": f"""
        SELECT category, sum(mins) AS total FROM (
          SELECT category, round_even(sum(listed), 0) AS mins FROM tl
          WHERE period IN ({MONTHS}) GROUP BY client_id, year, month, category)
        GROUP BY category""",
    "client_month_summary": "SELECT * FROM month_care",
    "client_month_features": """
        SELECT * FROM month_care JOIN month_features USING (client_id, year, month)""",
    "team_minutes": "SELECT * FROM team_mins",
    "dominant_team": "SELECT * FROM best_team",
    "patients": "SELECT * FROM patients",
    "demo_extract": """
        SELECT * FROM dx WHERE client_id IN (
          SELECT client_id FROM (SELECT DISTINCT client_id FROM cohort)
          ORDER BY md5('0/' || client_id::VARCHAR) LIMIT 10)""",
    "activity_maps": """
        SELECT client_id, count(*) AS categories,
          string_agg(category || '=' || n, ';' ORDER BY category) AS events
        FROM (SELECT client_id, category, sum(n)::BIGINT AS n FROM tl
              WHERE period = 'follow_up' GROUP BY client_id, category)
        GROUP BY client_id""",
    "activity_from_maps": "SELECT * FROM n_wide",
    "category_catalogue": """
        SELECT DISTINCT category, 'n_' || category AS n_column, 'mins_' || category AS mins_column
        FROM (SELECT coalesce(lower(description_cat), '<na>') AS category FROM types
              UNION ALL SELECT '<na>')""",
    "case_bundle_dx": "SELECT * FROM dx WHERE client_id IN (SELECT client_id FROM cohort)",
    "case_bundle_clients": "SELECT * FROM clients WHERE client_id IN (SELECT client_id FROM cohort)",
    "case_bundle_dbc": "SELECT * FROM dbc WHERE client_id IN (SELECT client_id FROM cohort)",
    "case_bundle_interventions": """
        SELECT * FROM interventions WHERE client_id IN (SELECT client_id FROM cohort)""",
    "attrition": """
        SELECT 1 AS step, 'in_phase' AS name, count(*) AS remaining FROM dx WHERE phase IN ('O', 'F')
        UNION ALL SELECT 2, 'in_years', count(*) FROM dx
          WHERE phase IN ('O', 'F') AND year(date) >= 1996
        UNION ALL SELECT 3, 'first_diagnosis', count(*) FROM first_dx
        UNION ALL SELECT 4, 'target_code', count(*) FROM idx
        UNION ALL SELECT 5, 'followed_up', count(*) FROM idx
          WHERE DATE '2001-08-01' - dx_date >= 1825
        UNION ALL SELECT 6, 'enrolled', count(*) FROM cohort
        UNION ALL SELECT 7, 'closed_episode', count(*) FROM cohort SEMI JOIN costs USING (client_id)
        UNION ALL SELECT 8, 'care_after_index', count(*) FROM cohort
          SEMI JOIN costs USING (client_id) SEMI JOIN post USING (client_id)
        UNION ALL SELECT 9, 'enough_care', count(*) FROM patients""",
}

# --- scores, slots and diagnoses ----------------------------------------------

PARTS["scores"] = """
    SELECT user_id AS client_id, year(ts)::INT AS year, month(ts)::INT AS month, ts::DATE AS date,
      value AS score, event_type AS rom, ts, event_id
    FROM events"""
PARTS["month_sizes"] = """
    SELECT client_id, year, month, count(*) AS held FROM scores GROUP BY client_id, year, month"""
PARTS["content"] = """
    SELECT *, year(date)::INT AS year, month(date)::INT AS month FROM dx
    WHERE gaf1 IS NOT NULL OR gaf2 IS NOT NULL OR ax_1_1 IS NOT NULL OR ax_1_2 IS NOT NULL
      OR ax_1_3 IS NOT NULL OR ax_1_4 IS NOT NULL OR ax_2_1 IS NOT NULL OR ax_2_2 IS NOT NULL
      OR ax_3 IS NOT NULL OR ax_4 IS NOT NULL"""


def _slots(
    source: str, keys: str, order: str, values: list[str], slots: int, name: str, width: int
) -> str:
    columns = ", ".join(
        f"max(CASE WHEN rn = {i} THEN {v} END) AS {v}_{i:0{width}d}"
        for i in range(1, slots + 1)
        for v in values
    )
    return f"""
        SELECT {keys}, count(*) AS {name}, greatest(count(*) - {slots}, 0) AS overflow_count,
          {columns}
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
              FROM {source})
        GROUP BY {keys}"""


SCORE_FIELDS = ["date", "rom", "score"]
DX_FIELDS = ["date", "gaf1", "gaf2", "ax_1_1", "ax_1_2", "ax_1_3", "ax_1_4", "ax_2_1", "ax_2_2"]
DX_FIELDS += ["ax_3", "ax_4"]
PARTS["score_wide"] = _slots(
    "scores", "client_id, year, month", "rom, date, ts, event_id", SCORE_FIELDS, 12, "nrom", 2
)
PARTS["dx_wide"] = _slots(
    "content", "client_id, year, month", "date, o_orderkey", DX_FIELDS, 9, "ndiag", 1
)


def _values(rows: list[tuple], types: list[str]) -> str:
    def cell(value, kind: str) -> str:
        return f"'{value}'" if kind == "VARCHAR" else f"{value}::{kind}"

    return ", ".join(
        "(" + ", ".join(cell(v, t) for v, t in zip(row, types)) + ")" for row in rows
    )


def _scoring() -> None:
    from suite.bindings import NORMS, RULES

    rules = _values(RULES, ["VARCHAR", "INT", "DOUBLE", "BOOLEAN", "DOUBLE"])
    norms = _values(NORMS, ["VARCHAR", "DOUBLE", "DOUBLE", "INT"])
    PARTS["answers"] = """
        SELECT user_id AS client_id, ts::DATE AS date, event_type AS rom,
          regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 10 AS item, value AS answer
        FROM events"""
    PARTS["raw_table"] = f"""
        SELECT client_id, date, rom, count(answer) AS answered,
          sum(weight * CASE WHEN reverse THEN top - answer ELSE answer END) AS raw
        FROM answers
          JOIN (VALUES {rules}) AS r(rom, item, weight, reverse, top) USING (rom, item)
        GROUP BY client_id, date, rom"""
    PARTS["scored"] = f"""
        SELECT client_id, year(date)::INT AS year, month(date)::INT AS month, date,
          round(CASE WHEN answered >= least_answers THEN (raw - mean) / sd * 10 + 50 END, 4)
            AS score, rom
        FROM raw_table
          LEFT JOIN (VALUES {norms}) AS m(rom, mean, sd, least_answers) USING (rom)"""


_scoring()

ORACLES |= {
    "score_union": "SELECT client_id, date, score, rom, year, month FROM scores",
    "slot_occupancy": """
        SELECT idx, count(*) AS n
        FROM month_sizes, unnest(generate_series(1, held)) AS s(idx) GROUP BY idx""",
    "score_months_wide": "SELECT * FROM score_wide",
    "score_days_wide": _slots(
        "scores", "client_id, date", "rom, date, ts, event_id", SCORE_FIELDS, 6, "nrom", 2
    ),
    "any_non_null": "SELECT * EXCLUDE (year, month) FROM content",
    "diagnosis_months_wide": "SELECT * FROM dx_wide",
    "raw_scores": "SELECT * REPLACE (round(raw, 4) AS raw) FROM raw_table",
    "score_instruments": "SELECT * FROM scored",
    "score_instrument": "SELECT * FROM scored",
    "score_bundle": "SELECT * FROM scored",
}

# --- postcodes, keys, text and files --------------------------------------------


def _postcodes() -> None:
    from suite.bindings import SEGMENT_COLUMNS

    tests = {c.lower(): f"c_mktsegment = '{v}'" for c, v in SEGMENT_COLUMNS.items()}
    tests |= {"p_link_hh": "c_acctbal < 0", "p_hink_hh": "c_acctbal > 5000"}
    shares = ", ".join(
        f"floor(count(*) FILTER ({test}) * 100 / count(*))::DOUBLE AS {c}"
        for c, test in tests.items()
    )
    kept = ", ".join(f"CASE WHEN {c} >= 19 THEN {c} END AS {c}" for c in tests)
    PARTS["postcodes"] = f"""
        SELECT zip, {kept}, m_inkhh, oad, sted, lbrmtr
        FROM (SELECT c_nationkey AS zip, {shares}, (count(*) % 4)::VARCHAR AS m_inkhh,
                count(*)::DOUBLE AS oad, (count(*) FILTER (c_acctbal > 9000))::DOUBLE AS sted
              FROM customer GROUP BY c_nationkey)
          LEFT JOIN (SELECT s_nationkey AS zip, (count(*) + 2012) / 10.0::DOUBLE AS lbrmtr
                     FROM supplier GROUP BY s_nationkey) USING (zip)"""


_postcodes()
PARTS["client_keys"] = """
    SELECT c_custkey AS client_id,
      CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN md5(c_custkey::VARCHAR) END AS key
    FROM customer"""


def _keyed(source: str) -> str:
    return f"""SELECT * EXCLUDE (client_id, key), key AS client_id
        FROM {source} LEFT JOIN client_keys USING (client_id)"""


MINIMA = (
    "zip p_nl_achtg p_we_mig_a p_nw_mig_a p_huurwon p_koopwon p_link_hh p_hink_hh oad sted lbrmtr"
).split()

ORACLES |= {
    "postcode_dimension": "SELECT * FROM postcodes",
    "numeric_min_check": f"SELECT {', '.join(f'min({c}) AS {c}' for c in MINIMA)} FROM postcodes",
    "enrich_by_postcode": """
        SELECT * EXCLUDE (zip, date), date AS enroll_date
        FROM clients LEFT JOIN postcodes USING (zip)""",
    "decimal_comma_csv": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "clean_descriptions": r"""
        SELECT doc_id, replace(
          regexp_replace(regexp_replace(regexp_replace(text,
            '[\x{0080}-\x{07FF}]', '  ', 'g'), '[\x{0800}-\x{FFFF}]', '   ', 'g'),
            '[\x{10000}-\x{10FFFF}]', '    ', 'g'), '  ', ' ') AS text
        FROM documents""",
    "pseudonymise_patients": _keyed("patients"),
    "pseudonymise_months": _keyed("month_care"),
    "pseudonymise_scores": _keyed("score_wide"),
    "pseudonymise_diagnoses": _keyed("dx_wide") + " WHERE key IS NOT NULL",
    "null_sentinel_csv": """
        SELECT c_custkey, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS c_mktsegment,
          c_acctbal
        FROM customer""",
    "saved_patients": "SELECT * FROM patients",
}

# --- the extract ------------------------------------------------------------------

PARTS["kept_scores"] = "SELECT * FROM scores WHERE client_id IN (SELECT client_id FROM patients)"
PARTS["kept_content"] = "SELECT * FROM content WHERE client_id IN (SELECT client_id FROM patients)"
PARTS["kept_score_wide"] = _slots(
    "kept_scores", "client_id, year, month", "rom, date, score NULLS FIRST", SCORE_FIELDS, 12, "nrom", 2
)
PARTS["kept_dx_wide"] = _slots(
    "kept_content", "client_id, year, month", "date, o_orderkey", DX_FIELDS, 9, "ndiag", 1
)
ORACLES |= {
    "extract_months": _keyed(
        "(SELECT * FROM month_care JOIN month_features USING (client_id, year, month))"
    ),
    "extract_diagnoses": _keyed("kept_dx_wide"),
    "extract_scores": _keyed("kept_score_wide"),
}

# --- profiles and distances -----------------------------------------------------

PARTS["hours"] = " UNION ALL ".join(
    f"SELECT client_id, '{c}' AS dim, \"mins_{c}\" / 60 AS hours FROM patients" for c in CATEGORIES
)
PARTS["varying"] = """
    SELECT dim, min(log10(hours + 1)) AS low, max(log10(hours + 1)) AS high,
      stddev_samp(hours) AS sd
    FROM hours GROUP BY dim"""
PARTS["log_scaled"] = """
    SELECT client_id, dim,
      CASE WHEN high > low THEN (log10(hours + 1) - low) / (high - low) ELSE 0.5 END AS value
    FROM hours JOIN varying USING (dim)"""
PARTS["minutes"] = " UNION ALL ".join(
    f"SELECT client_id, '{c}' AS dim, \"mins_{c}\" AS held FROM patients" for c in CATEGORIES
)
PARTS["all_pairs"] = """
    SELECT a.client_id AS client_id, b.client_id AS anchor_id,
      CASE WHEN sum(greatest(a.held, b.held)) = 0 THEN 0 ELSE
        1 - sum(least(a.held, b.held)) / sum(greatest(a.held, b.held)) END AS dist
    FROM minutes a JOIN minutes b USING (dim) GROUP BY a.client_id, b.client_id"""
PARTS["profile_lists"] = """
    SELECT client_id, list(held ORDER BY dim) AS held FROM minutes GROUP BY client_id"""
PARTS["classes"] = """
    SELECT min(client_id) AS id, count(*) AS rows FROM profile_lists GROUP BY held"""
PARTS["to_genders"] = """
    SELECT client_id, anchor_id,
      CASE WHEN sum(greatest(a.held, b.held)) = 0 THEN 0 ELSE
        1 - sum(least(a.held, b.held)) / sum(greatest(a.held, b.held)) END AS dist
    FROM minutes a JOIN (
      SELECT gender::VARCHAR AS anchor_id, dim, round(avg(held)) AS held
      FROM minutes JOIN patients USING (client_id) WHERE gender IS NOT NULL GROUP BY 1, 2) b USING (dim)
    GROUP BY client_id, anchor_id"""
ABOVE = " + ".join(f"(value > {i * 0.1!r}::DOUBLE)::DOUBLE" for i in range(11))

ORACLES |= {
    "profile_long": "SELECT * FROM hours",
    "zero_variance_filter": """
        SELECT client_id, dim, hours FROM hours JOIN varying USING (dim) WHERE sd > 0""",
    "rescale_log_minmax": "SELECT client_id, dim, round(value, 9) AS value FROM log_scaled",
    "rescale_bins": f"SELECT client_id, dim, {ABOVE} + 1 AS value FROM log_scaled",
    "rescale_max": """
        SELECT client_id, dim, hours / (SELECT max(hours) FROM hours) AS value FROM hours""",
    "rescale_over_one": "SELECT client_id, dim, (hours > 1)::DOUBLE AS value FROM hours",
    "rescale_minus_one": "SELECT client_id, dim, hours - 1 AS value FROM hours",
    "anchor_distances": "SELECT client_id, anchor_id, round(dist, 9) AS dist FROM to_genders",
    "anchor_histogram": """
        SELECT anchor_id, bin, bin / 20.0::DOUBLE AS low, (bin + 1) / 20.0::DOUBLE AS high, rows FROM (
          SELECT anchor_id, least(floor(round(dist, 12) * 20), 19)::INT AS bin, count(*) AS rows
          FROM to_genders GROUP BY 1, 2)""",
    "profile_classes": """
        SELECT client_id, min(client_id) OVER (PARTITION BY held) AS class_id FROM profile_lists""",
    "similar_profiles": """
        SELECT client_id AS a, anchor_id AS b, p.rows AS rows_a, q.rows AS rows_b, round(dist, 9) AS dist
        FROM all_pairs JOIN classes p ON client_id = p.id JOIN classes q ON anchor_id = q.id
        WHERE client_id < anchor_id AND dist <= 0.25 + 1e-12""",
    "distance_histogram": """
        SELECT bin::INT AS bin, bin / 20.0::DOUBLE AS low, (bin + 1) / 20.0::DOUBLE AS high,
          coalesce(pairs, 0) AS pairs
        FROM (SELECT unnest(range(20)) AS bin) LEFT JOIN (
          SELECT least(floor(round(dist, 12) * 20), 19)::BIGINT AS bin, count(*) AS pairs
          FROM all_pairs WHERE client_id < anchor_id GROUP BY 1) USING (bin)""",
}

# --- clusters that are given ------------------------------------------------------


def _silhouette(power: int, source: str = "embeddings") -> str:
    return f"""
        SELECT vec_id, label, neighbour,
          CASE WHEN held < 2 THEN 0 ELSE (b - a) / greatest(a, b) END AS width
        FROM (
          SELECT vec_id, label, max(CASE WHEN label = other THEN total / (held - 1) END) AS a,
            max(CASE WHEN label = other THEN held END) AS held,
            min(CASE WHEN label <> other THEN total / held END) AS b,
            arg_min(other, CASE WHEN label <> other THEN total / held END) AS neighbour
          FROM (
            SELECT p.vec_id, p.label, q.label AS other, count(*) AS held,
              sum(list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** {power}) AS total
            FROM {source} p, {source} q GROUP BY p.vec_id, p.label, q.label)
          GROUP BY vec_id, label)"""


PARTS["widths_squared"] = _silhouette(2)
PARTS["nested_widths"] = " UNION ".join(
    "SELECT count(DISTINCT label)::INT AS k, round(avg(width), 6) AS mean_silhouette FROM ("
    + _silhouette(2, f"(SELECT vec_id, label // {width} AS label, embedding FROM embeddings)")
    + ")"
    for width in (1, 2, 4)
)
PARTS["people"] = """
    SELECT c_custkey AS client_id, c_mktsegment AS coarse, c_mktsegment || '.' || n_regionkey AS fine,
      c_acctbal AS measure
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
PARTS["people_names"] = """
    SELECT coarse, fine, coarse_rank, fine_rank, coarse_rank || '.' || fine_rank AS cluster
    FROM (SELECT coarse, fine,
            row_number() OVER (PARTITION BY coarse ORDER BY median(measure), fine)::INT AS fine_rank
          FROM people GROUP BY coarse, fine)
      JOIN (SELECT coarse, row_number() OVER (ORDER BY median(measure), coarse)::INT AS coarse_rank
            FROM people GROUP BY coarse) USING (coarse)"""
PARTS["extents"] = """
    SELECT row_number() OVER (ORDER BY fine)::INT AS position, fine, n,
      (sum(n) OVER (ORDER BY fine) - n + 1)::BIGINT AS first,
      (sum(n) OVER (ORDER BY fine))::BIGINT AS last
    FROM (SELECT fine, count(*) AS n FROM people GROUP BY fine)"""


def _trimmed(source: str, group: str) -> str:
    return f"""
        SELECT {group}, dim, avg(score) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY {group}, dim ORDER BY score) AS rn,
            floor(0.3::DOUBLE * count(*) OVER (PARTITION BY {group}, dim)) AS cut,
            count(*) OVER (PARTITION BY {group}, dim) AS total
          FROM ({source}))
        WHERE rn > cut AND rn <= total - cut GROUP BY {group}, dim"""


PARTS["line_values"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS dim, {c} AS score FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)
PARTS["shares"] = " UNION ALL ".join(
    ["SELECT gender, 'mins' AS dim, mins AS score FROM patients"]
    + [
        f"SELECT gender, 'mins_{c}' AS dim, \"mins_{c}\" / mins * 100 AS score FROM patients"
        for c in CATEGORIES
    ]
)
PARTS["share_means"] = _trimmed("SELECT * FROM shares", "gender")


def _quantiles(value: str) -> str:
    points = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    columns = ", ".join(f"round(quantile_cont(v, {p}), 8) AS {c}" for c, p in points.items())
    return f"""SELECT gender, count(*) AS n, {columns}
        FROM (SELECT gender, {value} AS v FROM patients) WHERE v > 0 GROUP BY gender"""


ORACLES |= {
    "silhouette_squared": """
        SELECT vec_id, label, neighbour, round(width, 6) AS width FROM widths_squared""",
    "silhouette_euclidean": f"""
        SELECT vec_id, label, neighbour, round(width, 6) AS width FROM ({_silhouette(1)})""",
    "silhouette_by_label": """
        SELECT label, count(*) AS n, round(avg(width), 6) AS mean_width
        FROM widths_squared GROUP BY label""",
    "attached_clusters": """
        SELECT client_id, concat_ws('.', gender::VARCHAR, floor(year_of_birth / 10)::BIGINT::VARCHAR) AS cluster, n, mins
        FROM patients""",
    "extract_order": """
        SELECT row_number() OVER (ORDER BY client_id, year, month) AS position, client_id, year, month, n
        FROM month_care""",
    "column_labels": """
        SELECT 'n' AS "column", 'Number of Interventions' AS label, count(n) AS rows FROM month_care
        UNION ALL SELECT 'nb', 'Number of BGGZ Interventions', count(nb) FROM month_care
        UNION ALL SELECT 'ns', 'Number of SGGZ Interventions', count(ns) FROM month_care
        UNION ALL SELECT 'mins', 'Minutes of Interventions', count(mins) FROM month_care
        UNION ALL SELECT 'minsb', 'Minutes of BGGZ Interventions', count(minsb) FROM month_care
        UNION ALL SELECT 'minss', 'Minutes of SGGZ Interventions', count(minss) FROM month_care""",
    "nested_silhouettes": "SELECT * FROM nested_widths",
    "best_nested_cut": "SELECT * FROM nested_widths ORDER BY mean_silhouette DESC, k LIMIT 1",
    "canonical_labels": """
        SELECT client_id, cluster FROM people JOIN people_names USING (fine)""",
    "cluster_names": "SELECT * FROM people_names",
    "cluster_sizes": "SELECT fine, count(*) AS n FROM people GROUP BY fine",
    "cluster_extents": "SELECT * FROM extents",
    "cluster_members": """
        SELECT * FROM people WHERE fine IN (SELECT fine FROM extents WHERE position IN (1, 4))""",
    "median_by_group": """
        SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS median
        FROM lineitem GROUP BY l_returnflag""",
    "trimmed_mean_by_group": f"""
        SELECT l_returnflag, dim, round(score, 6) AS score
        FROM ({_trimmed("SELECT * FROM line_values", "l_returnflag")})""",
    "cluster_profile": """
        SELECT gender, dense_rank() OVER (ORDER BY mins, gender)::INT AS cluster_rank,
          substr(dim, 6) AS dim, round(score, 6) AS score, round(mins, 6) AS mins,
          round_even(mins / 60, 0) AS hours
        FROM share_means JOIN (SELECT gender, score AS mins FROM share_means WHERE dim = 'mins')
          USING (gender)
        WHERE dim <> 'mins' AND score > 1""",
    "hours_quantiles": _quantiles("mins / 60"),
    "cost_quantiles": _quantiles("costs / 1000"),
}
