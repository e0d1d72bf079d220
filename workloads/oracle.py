"""The queries once more in plain SQL.

The SQL forms every pair and knows nothing of light and heavy links, so it
checks the operators independently.  Common parts are named subqueries; a
query takes those it needs.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}

FIXED = "CAST(round(({}) * 1e12) AS BIGINT)"


def fixed(expression: str) -> str:
    return FIXED.format(expression)


def unfixed(total: str) -> str:
    return f"(CAST((({total}) + 500) // 1000 * 1000 AS DOUBLE) / 1e12)"


def quality(counts: str, extra: str = "") -> str:
    """Add precision, recall and f1 to a subquery with tp, fp, fn."""
    return f"""SELECT {extra} tp, fp, fn, "precision", recall,
        2.0 * "precision" * recall / nullif("precision" + recall, 0) AS f1
      FROM (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS "precision",
                   CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall FROM ({counts}))"""


# ---- documents ----------------------------------------------------------

PARTS["docs"] = """SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -(doc_id + 1) END AS entity_id, text
  FROM documents"""
PARTS["docs_members"] = """SELECT DISTINCT entity_id, block_id
  FROM (SELECT entity_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+')) AS block_id FROM docs)
  WHERE block_id <> ''"""
PARTS["docs_truth"] = """SELECT b.entity_id AS d2_id, min(a.entity_id) AS d1_id
  FROM docs a JOIN docs b ON a.text = b.text AND a.entity_id >= 0 AND b.entity_id < 0
  GROUP BY b.entity_id HAVING count(*) = 1"""


def blocking_parts(p: str) -> None:
    """Filtering and all four weightings for the members table ``{p}_members``."""
    PARTS[f"{p}_utility"] = f"""SELECT m.entity_id, m.block_id, greatest(s.n1, s.n2) AS utility
      FROM {p}_members m JOIN (
        SELECT block_id, count(*) FILTER (entity_id >= 0) AS n1, count(*) FILTER (entity_id < 0) AS n2
        FROM {p}_members GROUP BY block_id) s USING (block_id)
      WHERE s.n1 > 0 AND s.n2 > 0"""
    PARTS[f"{p}_index"] = f"""SELECT entity_id, block_id, pos FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY utility, block_id) AS INT) AS pos,
               count(*) OVER (PARTITION BY entity_id) AS n FROM {p}_utility)
      WHERE pos <= round(0.8 * n)"""
    PARTS[f"{p}_sizes"] = f"""SELECT * FROM (
        SELECT block_id, count(*) FILTER (entity_id >= 0) AS n1, count(*) FILTER (entity_id < 0) AS n2
        FROM {p}_index GROUP BY block_id) WHERE n1 > 0 AND n2 > 0"""
    PARTS[f"{p}_sized"] = f"SELECT block_id, entity_id, n1, n2 FROM {p}_index JOIN {p}_sizes USING (block_id)"
    PARTS[f"{p}_k"] = f"""SELECT greatest(1, CAST(floor(count(*) / count(DISTINCT entity_id)) AS BIGINT)) AS k
      FROM {p}_index"""
    PARTS[f"{p}_totals"] = f"""SELECT CAST(count(DISTINCT entity_id) FILTER (entity_id >= 0) AS DOUBLE) AS t1,
        CAST(count(DISTINCT entity_id) FILTER (entity_id < 0) AS DOUBLE) AS t2 FROM {p}_index"""
    PARTS[f"{p}_weights"] = f"""SELECT block_id, n1, n2, 1000000000000 AS cbs,
        {fixed("1.0 / log2(1.0 + CAST(n1 AS DOUBLE) * n2)")} AS arcs,
        {fixed("log10(t1 / n1)")} AS idf1, {fixed("log10(t2 / n2)")} AS idf2
      FROM {p}_sizes, {p}_totals"""
    PARTS[f"{p}_norm"] = f"""SELECT e.entity_id, coalesce(sum(CASE WHEN e.entity_id >= 0 THEN w.idf1 ELSE w.idf2 END), 0) AS norm
      FROM {p}_index e LEFT JOIN {p}_weights w USING (block_id) GROUP BY e.entity_id"""
    PARTS[f"{p}_pairs"] = f"""SELECT b.entity_id AS d2, a.entity_id AS d1, sum(w.cbs) AS cbs, sum(w.arcs) AS arcs,
        sum(w.idf1 + w.idf2) AS idf
      FROM {p}_index a JOIN {p}_index b ON a.block_id = b.block_id AND a.entity_id >= 0 AND b.entity_id < 0
      JOIN {p}_weights w ON w.block_id = a.block_id GROUP BY b.entity_id, a.entity_id"""
    PARTS[f"{p}_edges"] = f"""SELECT d2 AS entity_id, d1 AS cand_id, cbs, arcs, idf FROM {p}_pairs
      UNION ALL SELECT d1, d2, cbs, arcs, idf FROM {p}_pairs"""
    for scheme in ("cbs", "arcs", "idf"):
        PARTS[f"{p}_{scheme}_all"] = f"SELECT entity_id, cand_id, {unfixed(scheme)} AS score FROM {p}_edges"
    PARTS[f"{p}_wjs_all"] = f"""SELECT e.entity_id, e.cand_id,
        coalesce(CAST(e.idf AS DOUBLE) / nullif(CAST(a.norm + b.norm AS DOUBLE), 0), 0) AS score
      FROM {p}_edges e JOIN {p}_norm a ON a.entity_id = e.entity_id JOIN {p}_norm b ON b.entity_id = e.cand_id"""
    for scheme in ("cbs", "arcs", "idf", "wjs"):
        PARTS[f"{p}_{scheme}"] = top(f"{p}_{scheme}_all", f"(SELECT k FROM {p}_k)")


def top(source: str, k: str) -> str:
    return f"""SELECT * FROM (SELECT entity_id, cand_id, score, CAST(row_number() OVER (
        PARTITION BY entity_id ORDER BY score DESC, cand_id) AS INT) AS "rank" FROM {source}) WHERE "rank" <= {k}"""


def symmetric(source: str) -> str:
    return f"""SELECT DISTINCT least(entity_id, cand_id) AS d2_id, greatest(entity_id, cand_id) AS d1_id FROM {source}"""


def candidate_quality(candidates: str, truth: str, extra: str = "") -> str:
    return quality(
        f"""SELECT {extra} coalesce(sum(hit), 0)::BIGINT AS tp, coalesce(sum(listed - hit), 0)::BIGINT AS fp,
              count(*) FILTER (known AND hit = 0) AS fn
          FROM (SELECT d2_id, count(c.d1_id) AS listed, bool_or(t.d1_id IS NOT NULL) AS known,
                       count(*) FILTER (c.d1_id = t.d1_id) AS hit
                FROM ({candidates}) c FULL JOIN {truth} t USING (d2_id) GROUP BY d2_id)""",
        "side," if extra else "",
    )


def match_quality(matches: str, truth: str, truth_only: bool = False, extra: str = "") -> str:
    return quality(
        f"""SELECT {extra} count(*) FILTER (m.d1_id = t.d1_id) AS tp,
              count(*) FILTER (m.d1_id IS NOT NULL AND m.d1_id IS DISTINCT FROM t.d1_id) AS fp,
              count(*) FILTER (t.d1_id IS NOT NULL AND m.d1_id IS DISTINCT FROM t.d1_id) AS fn
          FROM ({matches}) m {"RIGHT" if truth_only else "FULL"} JOIN {truth} t USING (d2_id)""",
        "side," if extra else "",
    )


blocking_parts("docs")

# ---- star schema --------------------------------------------------------

KINDS = [
    ("nation", "nation", "n_nationkey", 0),
    ("customer", "customer", "c_custkey", 1),
    ("supplier", "supplier", "s_suppkey", 2),
    ("order", "orders", "o_orderkey", 3),
    ("part", "part", "p_partkey", 4),
]
TERMS = {
    1: ("name", "nation", "segment", "customer", "status"),
    2: ("label", "locatedIn", "market", "placedBy", "state"),
}

for kb, (name, nation, segment, customer, status) in TERMS.items():
    def subject(kind: str, key: str, kb: int = kb) -> str:
        return f"'<http://KB{kb}/{kind}/' || {key} || '>'"

    def line(kind: str, key: str, predicate: str, value: str, kb: int = kb) -> str:
        return f"{subject(kind, key)} || ' <http://kb{kb}/{predicate}> ' || {value} || ' .' AS value"

    def quoted(column: str) -> str:
        return f"""'"' || {column} || '"'"""

    PARTS[f"lines{kb}"] = " UNION ALL ".join(
        [
            f"SELECT {line('nation', 'n_nationkey', name, quoted('n_name'))} FROM nation",
            f"SELECT {line('customer', 'c_custkey', name, quoted('c_name'))} FROM customer",
            f"SELECT {line('customer', 'c_custkey', nation, subject('nation', 'c_nationkey'))} FROM customer",
            f"SELECT {line('customer', 'c_custkey', segment, quoted('c_mktsegment'))} FROM customer",
            f"SELECT {line('supplier', 's_suppkey', name, quoted('s_name'))} FROM supplier",
            f"SELECT {line('supplier', 's_suppkey', nation, subject('nation', 's_nationkey'))} FROM supplier",
            f"SELECT {line('order', 'o_orderkey', customer, subject('customer', 'o_custkey'))} FROM orders",
            f"SELECT {line('order', 'o_orderkey', status, quoted('o_orderstatus'))} FROM orders",
            f"SELECT {line('part', 'p_partkey', name, quoted('p_name'))} FROM part",
        ]
    )
    tokens = f"SELECT string_split(regexp_replace(lower(value), ' \\.$', ''), ' ') AS t FROM lines{kb}"
    PARTS[f"rel{kb}"] = f"SELECT t[1] AS s, t[2] AS p, t[3] AS o FROM ({tokens}) WHERE len(t) = 3"
    PARTS[f"lab{kb}"] = f"SELECT t[1] AS s, t[2] AS p, array_to_string(t[3:], ' ') AS o FROM ({tokens}) WHERE len(t) >= 3"
    PARTS[f"ids{kb}"] = " UNION ALL ".join(
        f"SELECT lower({subject(kind, key)}) AS uri, "
        + (f"{key} * 5 + {n}" if kb == 1 else f"-({key} * 5 + {n} + 1)")
        + f" AS entity_id FROM {tab}"
        for kind, tab, key, n in KINDS
    )
    for view in ("rel", "lab"):
        PARTS[f"{view}_resolved{kb}"] = f"""SELECT p, a.entity_id AS s_id, o, b.entity_id AS o_id
          FROM {view}{kb} JOIN ids{kb} a ON a.uri = s LEFT JOIN ids{kb} b ON b.uri = o"""
    PARTS[f"relidx{kb}"] = f"""SELECT p, s_id, o_id FROM rel_resolved{kb}
      WHERE o_id IS NOT NULL AND p IN (SELECT p FROM rel_resolved{kb} GROUP BY p HAVING count(o_id) > count(*) - count(o_id))"""
    PARTS[f"relstats{kb}"] = f"""SELECT p, support, discriminability,
        2.0 * support * discriminability / (support + discriminability) AS score
      FROM (SELECT p, CAST(count(*) AS DOUBLE) / max(count(*)) OVER () AS support,
                   CAST(count(DISTINCT o_id) AS DOUBLE) / count(*) AS discriminability
            FROM relidx{kb} GROUP BY p)"""
    PARTS[f"relrank{kb}"] = f"""SELECT *, CAST(row_number() OVER (ORDER BY score DESC, p) AS INT) AS "rank"
      FROM relstats{kb} WHERE support > 0.01"""
    for n in (2, 3):
        PARTS[f"out{kb}_{n}"] = f"""SELECT entity_id, out_id FROM (
            SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY r) AS dr FROM (
              SELECT s_id AS entity_id, o_id AS out_id, min("rank") AS r
              FROM relidx{kb} JOIN relrank{kb} USING (p) GROUP BY s_id, o_id)) WHERE dr <= {n}"""
    owner = f"SELECT label, min(entity_id) AS entity_id FROM labels{kb} GROUP BY label HAVING count(*) = 1"
    PARTS[f"labels{kb}"] = f"""SELECT DISTINCT trim(regexp_replace(lower(o), '[^a-z0-9 ]', '', 'g')) AS label, entity_id
      FROM lab{kb} JOIN ids{kb} ON uri = s WHERE p = '<http://kb{kb}/{name}>'"""

PARTS["star_members"] = """
  SELECT c_custkey * 5 + 1 AS entity_id, unnest(['nation:' || c_nationkey, 'segment:' || c_mktsegment,
      'balance:' || CAST(floor(c_acctbal / 10) AS BIGINT), 'name:' || c_name]) AS block_id FROM customer
  UNION ALL SELECT -(c_custkey * 5 + 2), unnest(['nation:' || c_nationkey, 'segment:' || c_mktsegment,
      'balance:' || CAST(floor(c_acctbal / 10) AS BIGINT)]) FROM customer
  UNION ALL SELECT s_suppkey * 5 + 2, unnest(['nation:' || s_nationkey,
      'balance:' || CAST(floor(s_acctbal / 10) AS BIGINT), 'name:' || s_name]) FROM supplier
  UNION ALL SELECT -(s_suppkey * 5 + 3), unnest(['nation:' || s_nationkey,
      'balance:' || CAST(floor(s_acctbal / 10) AS BIGINT)]) FROM supplier
  UNION ALL SELECT n_nationkey * 5, unnest(['name:' || n_name, 'region:' || n_regionkey]) FROM nation
  UNION ALL SELECT -(n_nationkey * 5 + 1), unnest(['name:' || n_name, 'region:' || n_regionkey]) FROM nation
  UNION ALL SELECT o_orderkey * 5 + 3, unnest(['date:' || CAST(o_orderdate AS DATE),
      'price:' || CAST(floor(o_totalprice / 1000) AS BIGINT), 'status:' || o_orderstatus]) FROM orders
  UNION ALL SELECT -(o_orderkey * 5 + 4), unnest(['date:' || CAST(o_orderdate AS DATE),
      'price:' || CAST(floor(o_totalprice / 1000) AS BIGINT), 'status:' || o_orderstatus]) FROM orders"""
blocking_parts("star")

PARTS["star_truth"] = """SELECT d2_id, min(d1_id) AS d1_id FROM (
    SELECT -(o_orderkey * 5 + 4) AS d2_id, o_orderkey * 5 + 3 AS d1_id FROM orders
    UNION ALL SELECT -(o_orderkey * 5 + 4), o_custkey * 5 + 1 FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT -(c_custkey * 5 + 2), c_custkey * 5 + 1 FROM customer
    UNION ALL SELECT -(s_suppkey * 5 + 3), s_suppkey * 5 + 2 FROM supplier
    UNION ALL SELECT -(n_nationkey * 5 + 1), n_nationkey * 5 FROM nation
    UNION ALL SELECT -(p_partkey * 5 + 5), p_partkey * 5 + 4 FROM part)
  GROUP BY d2_id HAVING count(DISTINCT d1_id) = 1"""
PARTS["inn"] = """SELECT DISTINCT out_id AS entity_id, entity_id AS in_id FROM out1_3
  UNION SELECT DISTINCT out_id, entity_id FROM out2_3"""

for scheme, combine in (("arcs", "sum"), ("arcs", "max"), ("idf", "sum"), ("wjs", "max")):
    PARTS[f"nb_{scheme}_{combine}_all"] = f"""SELECT entity_id, cand_id, {unfixed(f"{combine}(w)")} AS score FROM (
        SELECT x.in_id AS entity_id, y.in_id AS cand_id, {fixed("v.score")} AS w
        FROM star_{scheme} v JOIN inn x ON x.entity_id = v.entity_id JOIN inn y ON y.entity_id = v.cand_id
        UNION ALL
        SELECT y.in_id, x.in_id, {fixed("v.score")}
        FROM star_{scheme} v JOIN inn x ON x.entity_id = v.entity_id JOIN inn y ON y.entity_id = v.cand_id)
      GROUP BY entity_id, cand_id"""
    PARTS[f"nb_{scheme}_{combine}"] = top(f"nb_{scheme}_{combine}_all", "(SELECT k FROM star_k)")

PARTS["label_pairs"] = """SELECT d2_id, min(d1_id) AS d1_id FROM (
    SELECT min(b.entity_id) AS d2_id, min(a.entity_id) AS d1_id
    FROM labels1 a JOIN labels2 b USING (label) GROUP BY label HAVING count(*) = 1)
  GROUP BY d2_id HAVING count(DISTINCT d1_id) = 1"""
PARTS["sure"] = """SELECT entity_id AS d2_id, cand_id AS d1_id FROM star_arcs
  WHERE "rank" = 1 AND score >= 1 AND entity_id < 0"""
PARTS["ranked"] = f"""SELECT entity_id, cand_id, sum(w) AS weight FROM (
    SELECT entity_id, cand_id, {fixed('0.6::DOUBLE * (max("rank") OVER (PARTITION BY entity_id) - "rank" + 1) / max("rank") OVER (PARTITION BY entity_id)')} AS w
    FROM star_arcs WHERE entity_id NOT IN (SELECT d2_id FROM sure)
    UNION ALL
    SELECT entity_id, cand_id, {fixed('(1 - 0.6::DOUBLE) * (max("rank") OVER (PARTITION BY entity_id) - "rank" + 1) / max("rank") OVER (PARTITION BY entity_id)')}
    FROM nb_arcs_sum) GROUP BY entity_id, cand_id"""
PARTS["edges1"] = "SELECT cand_id AS d2_id, entity_id AS d1_id, weight FROM ranked WHERE entity_id >= 0"
PARTS["edges2"] = "SELECT entity_id AS d2_id, cand_id AS d1_id, weight FROM ranked WHERE entity_id < 0"
PARTS["recip"] = """SELECT d2_id, d1_id, a.weight + b.weight AS weight FROM edges1 a JOIN edges2 b USING (d2_id, d1_id)"""
PARTS["best"] = """SELECT d2_id, d1_id, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY d2_id ORDER BY weight DESC, d1_id) AS r FROM (
      SELECT d2_id, d1_id, coalesce(a.weight, 0) + coalesce(b.weight, 0) AS weight
      FROM edges1 a FULL JOIN edges2 b USING (d2_id, d1_id))
    WHERE d2_id NOT IN (SELECT d2_id FROM sure)) WHERE r = 1"""
PARTS["recip_matches"] = """SELECT d2_id, d1_id FROM best WHERE (d2_id, d1_id) IN (SELECT (d2_id, d1_id) FROM recip)
  UNION ALL SELECT d2_id, d1_id FROM sure"""
PARTS["full_matches"] = """SELECT d2_id, d1_id FROM recip_matches WHERE d2_id NOT IN (SELECT d2_id FROM label_pairs)
  UNION ALL SELECT d2_id, d1_id FROM label_pairs"""

for scheme, combine in (("arcs", "sum"), ("wjs", "max")):
    s = f"{scheme}_{combine}"
    PARTS[f"lists_{s}"] = f"""SELECT entity_id, cand_id, v."rank" AS vr, n."rank" AS nr,
        coalesce(max(v."rank") OVER (PARTITION BY entity_id), 0) AS vs,
        coalesce(max(n."rank") OVER (PARTITION BY entity_id), 0) AS ns
      FROM star_{scheme} v FULL JOIN nb_{s} n USING (entity_id, cand_id)"""
    PARTS[f"top1_{s}"] = f"""SELECT entity_id, cand_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC,
            CASE WHEN vr = 1 AND score = greatest(vs, ns) THEN 0 ELSE 1 END,
            CASE WHEN vs >= ns THEN vr ELSE nr END NULLS LAST, cand_id) AS r FROM (
          SELECT *, coalesce(greatest(vs, ns) - vr + 1, 0) + coalesce(greatest(vs, ns) - nr + 1, 0) AS score
          FROM lists_{s})) WHERE r = 1"""
    PARTS[f"mutual_{s}"] = f"""SELECT a.entity_id AS d2_id, a.cand_id AS d1_id
      FROM top1_{s} a JOIN top1_{s} b ON a.entity_id = b.cand_id AND a.cand_id = b.entity_id
      WHERE a.entity_id < 0"""
PARTS["borda"] = """SELECT entity_id, cand_id, score, "rank", source, has_common FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, cand_id) AS INT) AS "rank" FROM (
      SELECT *, bool_or(vr IS NOT NULL AND nr IS NOT NULL) OVER (PARTITION BY entity_id) AS has_common,
        CASE WHEN ns = 0 THEN 'VALUES_WITH_EMPTY_NEIGHBORS' WHEN vs = 0 THEN 'NEIGHBORS_WITH_EMPTY_VALUES'
             WHEN vr IS NOT NULL AND nr IS NOT NULL THEN 'BOTH' WHEN vr IS NOT NULL THEN 'VALUES'
             ELSE 'NEIGHBORS' END AS source,
        CASE WHEN ns = 0 THEN 6 - vr WHEN vs = 0 THEN 6 - nr
             WHEN vr IS NOT NULL AND nr IS NOT NULL THEN greatest(vs, ns) - vr + 1 + vs - nr + 1
             WHEN vr IS NOT NULL THEN greatest(vs, ns) - vr + 1 ELSE greatest(vs, ns) - nr + 1 END AS score
      FROM lists_arcs_sum)) WHERE "rank" <= 5"""

# ---- queries ------------------------------------------------------------

ORACLE["parse_blocks"] = """SELECT DISTINCT l_orderkey AS block_id, l_partkey AS entity_id FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, -(l_suppkey + 1) FROM lineitem"""
ORACLE["entity_ids"] = "SELECT uri, entity_id FROM ids1 UNION ALL SELECT uri, entity_id FROM ids2"
ORACLE["parse_triples"] = " UNION ALL ".join(
    f"SELECT s, p, o, '{name}' AS \"view\" FROM {view}{kb}"
    for view, name in (("rel", "relations"), ("lab", "labels"))
    for kb in (1, 2)
)
ORACLE["ground_truth"] = "SELECT d2_id, d1_id FROM star_truth"
ORACLE["ground_truth_ids"] = "SELECT -(o_orderkey * 5 + 4) AS d2_id, o_custkey * 5 + 1 AS d1_id FROM orders"
ORACLE["assign_entity_ids"] = """SELECT '<http://kb1/customer/' || o_custkey || '>' AS uri,
    row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS entity_id FROM orders GROUP BY o_custkey"""
for kb, sign in ((1, "-"), (2, "")):
    # Customers by the file and line in which an order first names them.
    PARTS[f"placed{kb}"] = f"""SELECT o_custkey, row_number() OVER (ORDER BY place) - 1 AS number FROM (
      SELECT o_custkey, min((length(bin(o_orderkey)), {sign}o_orderkey)) AS place FROM orders GROUP BY o_custkey)"""
ORACLE["assign_entity_ids_files"] = """SELECT '<http://kb1/customer/' || o_custkey || '>' AS uri, number AS entity_id
  FROM placed1"""
ORACLE["ground_truth_from_triples"] = """SELECT coalesce(-b.number, -1) AS d2_id, coalesce(a.number, -1) AS d1_id
  FROM customer LEFT JOIN placed1 a ON a.o_custkey = c_custkey LEFT JOIN placed2 b ON b.o_custkey = c_custkey"""
ORACLE["ground_truth_roundtrip"] = ORACLE["ground_truth"]
ORACLE["block_roundtrip"] = """SELECT DISTINCT l_suppkey AS block_id, l_partkey AS entity_id FROM lineitem
  UNION ALL SELECT DISTINCT l_suppkey, -(l_orderkey + 1) FROM lineitem"""
_encoded = "replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"
_name = "replace(url, '/', '(')"
ORACLE["uri_encode"] = f"""SELECT page_id,
    '<http://dbpedia.org/resource/' || CASE WHEN contains(url, '%') THEN {_name} ELSE {_encoded.format(x=_name)} END || '>' AS resource,
    '<' || url || '>' AS other FROM pages"""
ORACLE["normalize_label"] = """SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS label
  FROM documents"""
ORACLE["match_roundtrip"] = "SELECT d2_id, d1_id FROM docs_truth"
ORACLE["candidate_roundtrip"] = "SELECT * FROM star_arcs"
ORACLE["candidate_text"] = """SELECT entity_id || chr(9) ||
    string_agg(cand_id || ':' || CAST(score AS BIGINT), ',' ORDER BY "rank") AS value FROM star_cbs GROUP BY entity_id"""

ORACLE["token_blocking"] = "SELECT block_id, entity_id FROM docs_utility"
ORACLE["block_utility"] = "SELECT entity_id, block_id, utility FROM docs_utility"
ORACLE["block_filtering"] = "SELECT entity_id, block_id, pos FROM docs_index"
ORACLE["rebuild_blocks"] = "SELECT block_id, entity_id, n1, n2 FROM docs_sized"
ORACLE["blocking_stats"] = """SELECT (SELECT count(*) FROM docs_index) AS assignments,
    (SELECT count(DISTINCT entity_id) FROM docs_index) AS entities, count(*) AS clean_blocks,
    CAST(sum(n1 * n2) AS BIGINT) AS comparisons,
    (SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT entity_id) FROM docs_index) AS bcin,
    (SELECT k FROM docs_k) AS k FROM docs_sizes"""
ORACLE["blocks_per_entity"] = "SELECT entity_id, count(*) AS n_blocks FROM docs_index GROUP BY entity_id"
ORACLE["block_weights"] = f"""SELECT block_id, n1, n2, {unfixed("arcs")} AS arcs, {unfixed("idf1")} AS idf1,
    {unfixed("idf2")} AS idf2 FROM docs_weights"""
ORACLE["candidate_pairs"] = """SELECT a.entity_id, b.entity_id AS cand_id, block_id,
    CASE WHEN a.entity_id >= 0 THEN a.n1 ELSE a.n2 END AS n_same,
    CASE WHEN a.entity_id >= 0 THEN a.n2 ELSE a.n1 END AS n_candidates
  FROM docs_sized a JOIN docs_sized b USING (block_id)
  WHERE (a.entity_id >= 0) <> (b.entity_id >= 0)"""
ORACLE["expanded_block_pairs"] = """SELECT a.entity_id, b.entity_id AS cand_id, block_id,
    CASE WHEN a.entity_id >= 0 THEN a.n1 ELSE a.n2 END AS n_same,
    CASE WHEN a.entity_id >= 0 THEN a.n2 ELSE a.n1 END AS n_candidates
  FROM docs_sized a JOIN docs_sized b USING (block_id)
  WHERE a.entity_id % 100 = 0 AND (a.entity_id >= 0) <> (b.entity_id >= 0)"""
ORACLE["wjs_entity_weights"] = f"SELECT entity_id, {unfixed('norm')} AS weight FROM docs_norm"
for _scheme in ("cbs", "wjs", "idf", "arcs"):
    ORACLE[f"cnp_{_scheme}"] = f"SELECT * FROM docs_{_scheme}"
ORACLE["cnp_arcs_top1"] = top("docs_arcs_all", "1")
ORACLE["cnp_arcs_heavy"] = ORACLE["cnp_arcs"]
ORACLE["cnp_wjs_heavy"] = "SELECT * FROM star_wjs"

ORACLE["relation_index"] = "SELECT * FROM relidx1 UNION ALL SELECT * FROM relidx2"


def of_both(sql: str) -> str:
    """``sql`` about collection {c}, for either, told apart by ``collection``."""
    return " UNION ALL ".join(f"SELECT *, {c} AS collection FROM ({sql.replace('{c}', str(c))})" for c in (1, 2))


ORACLE["relation_support"] = of_both("SELECT p, support FROM relstats{c}")
ORACLE["relation_discriminability"] = of_both("SELECT p, discriminability FROM relstats{c}")
ORACLE["relation_rank"] = of_both("SELECT * FROM relrank{c}")
ORACLE["top_out_neighbors"] = of_both("SELECT entity_id, out_id FROM out{c}_2")
ORACLE["in_neighbors"] = "SELECT entity_id, in_id FROM inn"
ORACLE["label_attributes"] = of_both("""SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, p) AS INT) AS "rank" FROM (
    SELECT p, support, discriminability, 2.0 * support * discriminability / (support + discriminability) AS score FROM (
      SELECT p, CAST(n AS DOUBLE) / max(n) OVER () AS support, CAST(d AS DOUBLE) / n AS discriminability FROM (
        SELECT p, count(*) AS n, count(DISTINCT o) AS d FROM lab_resolved{c} GROUP BY p
        HAVING count(o_id) <= count(*) - count(o_id))))) WHERE "rank" <= 3""")
ORACLE["neighbor_pairs"] = f"""SELECT d2_id, d1_id, sim, n1, n2 FROM (
    SELECT least(entity_id, cand_id) AS d2_id, greatest(entity_id, cand_id) AS d1_id, {unfixed(f"sum({fixed('score')})")} AS sim
    FROM star_arcs GROUP BY 1, 2)
  JOIN (SELECT entity_id AS d1_id, count(*) AS n1 FROM inn GROUP BY 1) USING (d1_id)
  JOIN (SELECT entity_id AS d2_id, count(*) AS n2 FROM inn GROUP BY 1) USING (d2_id)"""
PARTS["nb_links"] = ORACLE["neighbor_pairs"]
_row_key = "(CASE WHEN {x} >= 0 THEN {x} ELSE -{x} - 1 END // 5)"
ORACLE["expanded_neighbor_pairs"] = " UNION ALL ".join(
    f"""SELECT {mine}.in_id AS entity_id, {other}.in_id AS cand_id, d2_id, d1_id, sim
    FROM nb_links JOIN inn x ON x.entity_id = d2_id JOIN inn y ON y.entity_id = d1_id
    WHERE {_row_key.format(x=f"{mine}.in_id")} % 100 = 0"""
    for mine, other in (("x", "y"), ("y", "x"))
)
ORACLE["neighbor_sum"] = "SELECT * FROM nb_arcs_sum"
ORACLE["neighbor_max"] = "SELECT * FROM nb_arcs_max"
ORACLE["neighbor_sum_heavy"] = ORACLE["neighbor_sum"]

ORACLE["label_blocks"] = "SELECT * FROM labels1 UNION ALL SELECT * FROM labels2"
ORACLE["label_matches"] = "SELECT * FROM label_pairs"
ORACLE["top1_value_matches"] = "SELECT * FROM sure"
ORACLE["rank_scores"] = f"SELECT entity_id, cand_id, {unfixed('weight')} AS score FROM ranked"
ORACLE["candidate_edges"] = f"""SELECT d2_id, d1_id, 1 AS side, {unfixed('weight')} AS score FROM edges1
  UNION ALL SELECT d2_id, d1_id, 2, {unfixed('weight')} FROM edges2"""
ORACLE["reciprocal_edges"] = f"SELECT d2_id, d1_id, {unfixed('weight')} AS score FROM recip"
ORACLE["best_candidate"] = f"""SELECT d2_id, d1_id, {unfixed('weight')} AS score,
    (d2_id, d1_id) IN (SELECT (d2_id, d1_id) FROM recip) AS reciprocal FROM best"""
ORACLE["reciprocal_matches"] = "SELECT * FROM recip_matches"
ORACLE["mutual_top1"] = """SELECT a.entity_id AS d2_id, a.cand_id AS d1_id
  FROM star_arcs a JOIN star_arcs b ON a.entity_id = b.cand_id AND a.cand_id = b.entity_id
  WHERE a.entity_id < 0 AND a."rank" = 1 AND b."rank" = 1"""
ORACLE["borda_top1"] = "SELECT * FROM top1_arcs_sum"
ORACLE["borda_topk"] = 'SELECT entity_id, cand_id, score, "rank" FROM borda'
ORACLE["borda_provenance"] = "SELECT * FROM borda"
ORACLE["borda_counts"] = """SELECT source, count(*) AS results FROM borda GROUP BY source
  UNION ALL SELECT 'lists', count(DISTINCT entity_id) FROM borda
  UNION ALL SELECT 'lists with a common candidate', count(DISTINCT entity_id) FROM borda WHERE has_common"""

ORACLE["full_workflow"] = "SELECT * FROM full_matches"
ORACLE["resolve_files"] = "SELECT * FROM full_matches"
# The data has at most three relations per collection, so N = 5 and N = 3 agree.
ORACLE["workflow_arcs_reciprocal"] = "SELECT * FROM recip_matches"
ORACLE["workflow_arcs_borda"] = "SELECT * FROM mutual_arcs_sum"
ORACLE["workflow_wjs_borda"] = "SELECT * FROM mutual_wjs_max"

_docs_top1 = "SELECT entity_id AS d2_id, cand_id AS d1_id FROM docs_arcs WHERE entity_id < 0 AND \"rank\" = 1"
ORACLE["eval_matches"] = match_quality(_docs_top1, "docs_truth")
ORACLE["eval_matches_gt"] = match_quality(_docs_top1, "docs_truth", truth_only=True)
ORACLE["eval_candidates"] = candidate_quality(symmetric("docs_arcs"), "docs_truth")
ORACLE["eval_candidates_cbs"] = candidate_quality(symmetric("docs_cbs"), "docs_truth")
ORACLE["eval_candidates_idf"] = candidate_quality(symmetric("docs_idf"), "docs_truth")
ORACLE["eval_candidates_neighbors"] = candidate_quality(symmetric("nb_arcs_sum"), "star_truth")
ORACLE["eval_candidates_neighbors_idf"] = candidate_quality(symmetric("nb_idf_sum"), "star_truth")
ORACLE["eval_missed"] = f"""SELECT d2_id, t.d1_id AS correct, count(c.d1_id) AS n_candidates
  FROM ({symmetric("nb_arcs_sum")}) c RIGHT JOIN star_truth t USING (d2_id)
  GROUP BY d2_id, t.d1_id HAVING count(*) FILTER (c.d1_id = t.d1_id) = 0"""
ORACLE["symmetric_candidates"] = symmetric("docs_arcs")
ORACLE["true_positive_ids"] = f"SELECT DISTINCT d2_id FROM ({symmetric('docs_arcs')}) JOIN docs_truth USING (d2_id, d1_id)"


def raw_pairs(p: str) -> str:
    return f"""SELECT DISTINCT b.entity_id AS d2_id, a.entity_id AS d1_id
      FROM {p}_members a JOIN {p}_members b ON a.block_id = b.block_id AND a.entity_id >= 0 AND b.entity_id < 0"""


ORACLE["eval_input_blocks"] = candidate_quality(raw_pairs("docs"), "docs_truth")
ORACLE["eval_input_blocks_star"] = candidate_quality(raw_pairs("star"), "star_truth")
ORACLE["eval_provenance"] = """SELECT source, count(*) AS tp FROM borda b
  JOIN star_truth t ON t.d2_id = b.entity_id AND t.d1_id = b.cand_id GROUP BY source"""
_second_borda = "SELECT entity_id AS d2_id, cand_id AS d1_id FROM borda WHERE entity_id < 0"
ORACLE["eval_by_source"] = f"""SELECT source, (
      SELECT count(*) FROM borda b JOIN star_truth t ON t.d2_id = b.entity_id AND t.d1_id = b.cand_id
      WHERE b.source = s.source) AS source_tp, q.*
  FROM (VALUES ('VALUES'), ('NEIGHBORS'), ('BOTH'), ('VALUES_WITH_EMPTY_NEIGHBORS'),
      ('NEIGHBORS_WITH_EMPTY_VALUES')) s(source), ({candidate_quality(_second_borda, 'star_truth')}) q"""


def sides(source: str, condition: str = "true", label: str = "") -> str:
    second = f"SELECT entity_id AS d2_id, cand_id AS d1_id FROM {source} WHERE entity_id < 0 AND {condition}"
    first = f"SELECT cand_id AS d2_id, entity_id AS d1_id FROM {source} WHERE entity_id >= 0 AND {condition}"
    return (
        f"SELECT *{label} FROM ({match_quality(second, 'star_truth', extra='2 AS side,')})"
        f" UNION ALL SELECT *{label} FROM ({candidate_quality(first, 'star_truth', extra='1 AS side,')})"
    )


ORACLE["eval_top1_sides"] = (
    sides("star_arcs", '"rank" = 1', ", 'values' AS list")
    + " UNION ALL "
    + sides("nb_arcs_sum", '"rank" = 1', ", 'neighbors' AS list")
)


def found_by(values: str, nearby: str) -> str:
    hits = "SELECT DISTINCT d2_id FROM ({}) JOIN star_truth USING (d2_id, d1_id)"
    return f"""SELECT count(v.d2_id) AS from_values, count(n.d2_id) AS from_neighbors, count(*) AS "either",
        count(*) FILTER (v.d2_id IS NOT NULL AND n.d2_id IS NOT NULL) AS "both",
        CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM star_truth) AS max_recall
      FROM ({hits.format(symmetric(values))}) v FULL JOIN ({hits.format(symmetric(nearby))}) n ON v.d2_id = n.d2_id"""


ORACLE["contributions"] = found_by("star_arcs", "nb_arcs_sum")
ORACLE["contributions_wjs"] = found_by("star_wjs", "nb_wjs_max")
ORACLE["eval_labels"] = match_quality("SELECT * FROM label_pairs", "star_truth", truth_only=True)
ORACLE["eval_full"] = match_quality("SELECT * FROM full_matches", "star_truth", truth_only=True)
ORACLE["eval_resolved_files"] = ORACLE["eval_full"]
ORACLE["eval_full_without_labels"] = match_quality("SELECT * FROM recip_matches", "star_truth", truth_only=True)
ORACLE["eval_borda"] = (
    sides("top1_arcs_sum")
    + f""" UNION ALL SELECT * FROM ({candidate_quality(symmetric("borda"), "star_truth", extra="0 AS side,")})"""
)
ORACLE["eval_borda_wjs"] = sides("top1_wjs_max")


def _needed(sql: str, order: list[str]) -> None:
    for word in re.findall(r"[a-z_0-9]+", sql):
        if word in PARTS and word not in order:
            _needed(PARTS[word], order)
            order.append(word)


def statement(sql: str) -> str:
    """``sql`` preceded by the named subqueries it uses."""
    order: list[str] = []
    _needed(sql, order)
    if not order:
        return sql
    parts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in order)
    return f"WITH {parts}\n{sql}"


def statements() -> dict[str, str]:
    return {name: statement(sql) for name, sql in ORACLE.items()}
