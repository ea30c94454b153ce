"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from cohortline.llm.licenses import COPYRIGHT_LINE, LICENSES, LOWER, NOT_WORD, SPELLINGS, UPPER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _line_form(line: str) -> str:
    form = line
    for found, written in SPELLINGS:
        form = f"replace({form}, {_text(found)}, {_text(written)})"
    form = f"trim(regexp_replace({form}, {_text(NOT_WORD)}, ' ', 'g'))"
    return f"CASE WHEN regexp_matches({line}, {_text(COPYRIGHT_LINE)}) THEN '' ELSE {form} END"


def _forms(text: str) -> str:
    lines = f"string_split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(10))"
    return f"list_filter(list_transform({lines}, lambda l: {_line_form('l')}), lambda f: f <> '')"


def _license_sql() -> str:
    values = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in LICENSES)
    return f"""
WITH known AS (
    SELECT sha256(array_to_string({_forms("text")}, ' ')) AS digest, min(license_id) AS license_id
    FROM (VALUES {values}) AS v(license_id, text) GROUP BY 1
),
read AS (SELECT doc_id, text, {_forms("text")} AS forms FROM documents),
lines AS (SELECT doc_id, sha256(unnest(forms)) AS digest FROM read),
found AS (
    SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
    FROM lines JOIN known USING (digest) GROUP BY doc_id
)
SELECT r.doc_id, sha256(array_to_string(r.forms, ' ')) AS digest, k.license_id,
       coalesce(f.line_licenses, '') AS line_licenses
FROM read r
LEFT JOIN known k ON k.digest = sha256(array_to_string(r.forms, ' '))
LEFT JOIN found f USING (doc_id)
"""


def _even_crc32(number: str) -> str:
    """Whether the CRC-32 of a number's decimal digits is even, bit by bit."""
    steps = f"flatten(list_transform(string_split({number}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT] || repeat([-1::BIGINT], 8)))"
    step = (
        "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    )
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda a, x: {step}), 4294967295) % 2 = 0"


def _manifest_sql() -> str:
    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    rest = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    return f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, sha256({rest} || {field("text")}) AS leaf,
           sha256({rest} || {field("claimed")}) AS claimed,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
    FROM (SELECT *, CASE WHEN {_even_crc32("doc_id")} THEN replace(text, chr(10), '') ELSE text END AS claimed
          FROM documents)
),
inner_nodes AS (
    SELECT source, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS held FROM docs
    UNION ALL
    SELECT source, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((held + 2) // 3)
    FROM inner_nodes WHERE held > 1 GROUP BY source, level, pos // 3
),
subroots AS (
    SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
    FROM inner_nodes WHERE held = 1
),
outer_nodes AS (
    SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS held FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((held + 2) // 3)
    FROM outer_nodes WHERE held > 1 GROUP BY level, pos // 3
),
places AS (
    SELECT d.doc_id, n.level, n.pos AS other, d.pos // (3 ** n.level)::BIGINT AS own, n.node
    FROM docs d JOIN inner_nodes n ON n.source IS NOT DISTINCT FROM d.source AND n.held > 1
     AND n.pos // 3 = d.pos // (3 ** (n.level + 1))::BIGINT
    UNION ALL
    SELECT d.doc_id, 1000 + n.level, n.pos, s.pos // (3 ** n.level)::BIGINT, n.node
    FROM docs d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
    JOIN outer_nodes n ON n.held > 1 AND n.pos // 3 = s.pos // (3 ** (n.level + 1))::BIGINT
),
sides AS (
    SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step,
           coalesce(string_agg(node, '' ORDER BY other) FILTER (other < own), '') AS low,
           coalesce(string_agg(node, '' ORDER BY other) FILTER (other > own), '') AS high
    FROM places GROUP BY doc_id, level
),
folding AS (
    SELECT doc_id, 0 AS step, claimed AS node FROM docs
    UNION ALL
    SELECT f.doc_id, s.step, sha256(s.low || f.node || s.high)
    FROM folding f JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step + 1
),
folded AS (SELECT doc_id, arg_max(node, step) AS folded_root FROM folding GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(low || high, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY doc_id),
roots AS (SELECT node AS root FROM outer_nodes WHERE held = 1)
SELECT d.doc_id, d.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.folded_root, f.folded_root = r.root AS verified
FROM docs d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN roots r
JOIN folded f USING (doc_id) LEFT JOIN proofs p USING (doc_id)
"""


EXACT_SQL = """
WITH read AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM read WINDOW same AS (PARTITION BY text)
"""


ORACLES: dict[str, str] = {
    "op7_license_scan": _license_sql(),
    "op12_merkle_manifest": _manifest_sql(),
    "op13_exact_dedup": EXACT_SQL,
}
