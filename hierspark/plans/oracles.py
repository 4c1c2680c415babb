"""The same queries as plain SQL for an independent engine.

Written from the definitions, level by level with windows and joins, not from the way the
operators work.  Doubles are rounded to six digits at the end.
"""

import re

from hierspark.plans.queries import THRESHOLDS

T0, T1, T2 = (f"{t:e}" for t in THRESHOLDS)

# Quantities per customer and supplier, totals, long scores, edges.
SHARES = """
supp AS MATERIALIZED (SELECT o_custkey AS id, CAST(l_suppkey AS BIGINT) AS supplier, CAST(n_nationkey AS BIGINT) AS nation,
                CAST(n_regionkey AS BIGINT) AS region, sum(l_quantity) AS qty
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
tot AS (SELECT id, sum(qty) AS total FROM supp GROUP BY id),
sums AS (SELECT id, 0 AS lvl, region AS label, sum(qty) AS qty FROM supp GROUP BY id, region
         UNION ALL SELECT id, 1, nation, sum(qty) FROM supp GROUP BY id, nation
         UNION ALL SELECT id, 2, supplier, sum(qty) FROM supp GROUP BY id, supplier),
sc AS MATERIALIZED (SELECT s.id, CAST(lvl AS INTEGER) AS lvl, label, qty / total AS prob FROM sums s JOIN tot t ON s.id = t.id),
edges AS (SELECT CAST(0 AS INTEGER) AS lvl, CAST(n_regionkey AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS child FROM nation
          UNION ALL SELECT 1, s_nationkey, s_suppkey FROM supplier)"""

# Every id with every label of every level.
CELLS = """
cells AS (SELECT *, CAST(row_number() OVER (PARTITION BY lvl ORDER BY label) - 1 AS INTEGER) AS ord,
            row_number() OVER (ORDER BY lvl, label) - 1 AS pos
          FROM (SELECT CAST(0 AS INTEGER) AS lvl, CAST(r_regionkey AS BIGINT) AS label FROM region
                UNION ALL SELECT 1, n_nationkey FROM nation UNION ALL SELECT 2, s_suppkey FROM supplier)),
dense AS (SELECT t.id, c.lvl, c.label, c.ord, c.pos, coalesce(s.prob, 0e0) AS prob
          FROM tot t CROSS JOIN cells c LEFT JOIN sc s ON s.id = t.id AND s.lvl = c.lvl AND s.label = c.label)"""

# Best label per level and best child per parent.
TREE = """
par AS MATERIALIZED (SELECT s.id, s.lvl, s.label, s.prob, e.parent FROM sc s LEFT JOIN edges e ON e.lvl = s.lvl - 1 AND e.child = s.label),
tops AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lvl ORDER BY prob DESC, label) AS rn FROM par) WHERE rn = 1),
kids AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lvl, parent ORDER BY prob DESC, label) AS rn
                        FROM par WHERE parent IS NOT NULL) WHERE rn = 1)"""

CANDIDATES = """
cand AS MATERIALIZED (
  SELECT a.id, 0 AS start_lvl, a.label AS l0, a.prob AS p0, b.label AS l1, b.prob AS p1, c.label AS l2, c.prob AS p2
  FROM tops a JOIN kids b ON b.id = a.id AND b.lvl = 1 AND b.parent = a.label
              JOIN kids c ON c.id = a.id AND c.lvl = 2 AND c.parent = b.label WHERE a.lvl = 0
  UNION ALL
  SELECT b.id, 1, a.label, a.prob, b.label, b.prob, c.label, c.prob
  FROM tops b JOIN par a ON a.id = b.id AND a.lvl = 0 AND a.label = b.parent
              JOIN kids c ON c.id = b.id AND c.lvl = 2 AND c.parent = b.label WHERE b.lvl = 1
  UNION ALL
  SELECT c.id, 2, a.label, a.prob, b.label, b.prob, c.label, c.prob
  FROM tops c JOIN par b ON b.id = c.id AND b.lvl = 1 AND b.label = c.parent
              JOIN par a ON a.id = c.id AND a.lvl = 0 AND a.label = b.parent WHERE c.lvl = 2),
scored AS (SELECT *, p0 * p1 * p2 AS product, pow(p0 * p1 * p2, 1e0 / 3e0) AS conf FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, start_lvl) AS rn
                        FROM scored WHERE conf > 0) WHERE rn = 1)"""

# Per-level thresholds and the re-scored confidence of the best path.
CUT = f"""
passed AS (SELECT *, p0 > {T0} AS ok0, p1 > {T1} AS ok1, p2 > {T2} AS ok2 FROM best),
cut AS (SELECT *, CASE WHEN ok2 THEN 2 WHEN ok1 THEN 1 WHEN ok0 THEN 0 END AS rank_lvl,
               (CASE WHEN ok0 AND p0 > 2e-1 THEN 1 ELSE 0 END) + (CASE WHEN ok1 AND p1 > 2e-1 THEN 1 ELSE 0 END)
               + (CASE WHEN ok2 AND p2 > 2e-1 THEN 1 ELSE 0 END) AS n_strong,
               (CASE WHEN ok0 AND p0 > 2e-1 THEN p0 ELSE 1e0 END) * (CASE WHEN ok1 AND p1 > 2e-1 THEN p1 ELSE 1e0 END)
               * (CASE WHEN ok2 AND p2 > 2e-1 THEN p2 ELSE 1e0 END) AS strong FROM passed),
ranked AS (SELECT id, start_lvl, CAST(rank_lvl AS INTEGER) AS rank_lvl, l0,
                  CASE WHEN rank_lvl IS NULL OR rank_lvl >= 1 THEN l1 END AS l1,
                  CASE WHEN rank_lvl IS NULL OR rank_lvl >= 2 THEN l2 END AS l2,
                  CASE WHEN rank_lvl IS NULL THEN 0e0 WHEN n_strong > 0 THEN pow(strong, 1e0 / n_strong) END AS confidence
           FROM cut)"""

GATED = f"""
g1 AS (SELECT a.id, a.label AS l0, a.prob AS p0, b.label AS l1, b.prob AS p1
       FROM tops a LEFT JOIN kids b ON b.id = a.id AND b.lvl = 1 AND b.parent = a.label AND b.prob >= {T1} WHERE a.lvl = 0),
g2 AS (SELECT g1.*, c.label AS l2, c.prob AS p2
       FROM g1 LEFT JOIN kids c ON c.id = g1.id AND c.lvl = 2 AND c.parent = g1.l1 AND c.prob >= {T2}),
gated AS (SELECT id, CASE WHEN p0 >= {T0} THEN l0 END AS l0, CASE WHEN p0 >= {T0} THEN p0 END AS p0, l1, p1, l2, p2,
                 (CASE WHEN p0 >= {T0} THEN p0 ELSE 1e0 END) * coalesce(p1, 1e0) * coalesce(p2, 1e0) AS score FROM g2),
filled AS (SELECT g.id, coalesce(g.l0, e.parent) AS l0, p0, l1, p1, l2, p2, score
           FROM gated g LEFT JOIN edges e ON e.lvl = 0 AND e.child = g.l1)"""

NAMED = """
sname AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name FROM supplier),
nname AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation),
rname AS (SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name, 'PHYLUM_' || CAST(r_regionkey % 2 AS VARCHAR) AS phylum FROM region)"""

STRONG = """
strong AS (SELECT * FROM sc WHERE prob >= CASE lvl WHEN 0 THEN 3e-1 WHEN 1 THEN 15e-2 ELSE 8e-2 END),
lvls AS (SELECT id, CAST(count(DISTINCT lvl) AS INTEGER) AS n_lvls FROM strong GROUP BY id)"""

TRUTH = """
truth AS MATERIALIZED (SELECT c_custkey AS id, CAST(0 AS INTEGER) AS lvl, CAST(n_regionkey AS BIGINT) AS true_label FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION ALL SELECT c_custkey, 1, c_nationkey FROM customer),
top2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lvl ORDER BY prob DESC, label) AS rn FROM sc WHERE lvl < 2) WHERE rn = 1),
pred AS (SELECT t.id, t.lvl, u.true_label, t.label AS pred_label FROM top2 t JOIN truth u ON t.id = u.id AND t.lvl = u.lvl)"""

BRANDS = """
bs AS (SELECT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS parent, CAST(p_size AS BIGINT) AS child, min(p_partkey) AS first_at
       FROM part GROUP BY ALL)"""

TILES = """
items AS (SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS id, CAST(o_custkey AS VARCHAR) AS orig_id,
                 CAST(n_regionkey AS BIGINT) AS label, l_quantity AS qty
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
tiles AS (SELECT a.id, a.orig_id, a.label, a.qty / b.total AS prob
          FROM (SELECT id, orig_id, label, sum(qty) AS qty FROM items GROUP BY ALL) a
          JOIN (SELECT id, sum(qty) AS total FROM items GROUP BY id) b ON a.id = b.id)"""

LOGITS = """
lg AS (SELECT vec_id AS id, label AS truth, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
mx AS (SELECT id, max(x) AS m FROM lg GROUP BY id),
ex AS (SELECT lg.id, truth, CAST(pos AS INTEGER) AS pos, x, x - m AS d, exp(x - m) AS e FROM lg JOIN mx ON lg.id = mx.id),
sm AS (SELECT id, truth, pos, e / sum(e) OVER (PARTITION BY id) AS prob, d - ln(sum(e) OVER (PARTITION BY id)) AS logp FROM ex)"""

STEPS = """
steps AS (SELECT 'events' AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
                 CASE WHEN event_type IN ('click', 'view') THEN 'train' ELSE 'val' END AS phase,
                 floor(value * 1e2 + 5e-1) AS loss, CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END AS ok FROM events),
hist AS (SELECT run, epoch, phase, count(*) AS n_rows, avg(loss) AS loss, avg(ok) AS acc FROM steps GROUP BY ALL)"""

_MODEL_LEVELS = ((0, 1, 8), (1, 9, 16), (2, 25, 40))
MODELS = (
    "raw AS ("
    + " UNION ALL ".join(
        f"SELECT vec_id AS id, CAST({k} AS INTEGER) AS lvl, unnest(range({n})) AS label, "
        f"CAST(unnest(embedding[{first}:{first + n - 1}]) AS DOUBLE) * 8e0 AS x, 1e0 / {n} AS bar FROM embeddings"
        for k, first, n in _MODEL_LEVELS
    )
    + """),
ex AS (SELECT id, lvl, CAST(label AS BIGINT) AS label, bar, exp(x - max(x) OVER (PARTITION BY id, lvl)) AS e FROM raw),
dense AS (SELECT id, lvl, label, bar, e / sum(e) OVER (PARTITION BY id, lvl) AS prob FROM ex),
sc AS (SELECT id, lvl, label, prob FROM dense WHERE prob >= bar),
edges AS (SELECT CAST(0 AS INTEGER) AS lvl, CAST(c // 2 AS BIGINT) AS parent, CAST(c AS BIGINT) AS child FROM range(16) r(c)
          UNION ALL SELECT 1, c * 2 // 5, c FROM range(40) r(c))"""
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_PATH = "l0, round(p0, 6) AS p0, l1, round(p1, 6) AS p1, l2, round(p2, 6) AS p2"
_BEST_PATH = f"SELECT id, CAST(start_lvl AS INTEGER) AS start_lvl, {_PATH}, round(conf, 6) AS conf FROM best"
_NAMES = """JOIN rname r ON r.k = b.l0 LEFT JOIN nname n ON n.k = b.l1 LEFT JOIN sname s ON s.k = b.l2"""
_SHORT = """'Plantae' AS kingdom, r.phylum AS phyla, '' AS "class", '' AS "order", coalesce(r.name, '') AS family,
    coalesce(n.name, '') AS genus, coalesce(s.name, '') AS species_epithet"""

_QUERIES: dict[str, str] = {
    "best_path": _with(SHARES, TREE, CANDIDATES) + _BEST_PATH,
    "best_path_by_joins": _with(SHARES, TREE, CANDIDATES) + _BEST_PATH,
    "decode_model_scores": _with(MODELS, TREE, CANDIDATES) + _BEST_PATH,
    "decode_score_arrays": _with(MODELS, TREE, CANDIDATES) + _BEST_PATH,
    "descend": _with(SHARES, TREE, CANDIDATES) + f"SELECT id, {_PATH} FROM cand WHERE start_lvl = 0",
    "backfill": _with(SHARES, TREE, CANDIDATES) + f"SELECT id, {_PATH} FROM cand WHERE start_lvl = 2",
    "path_score": _with(SHARES, TREE, CANDIDATES)
    + "SELECT id, CAST(start_lvl AS INTEGER) AS start_lvl, round(product, 6) AS product, round(conf, 6) AS conf FROM scored",
    "threshold_rank": _with(SHARES, TREE, CANDIDATES, CUT) + "SELECT id, rank_lvl, l0, l1, l2 FROM ranked",
    "threshold_confidence": _with(SHARES, TREE, CANDIDATES, CUT)
    + "SELECT id, rank_lvl, round(confidence, 6) AS confidence FROM ranked",
    "gated_descent": _with(SHARES, TREE, GATED) + f"SELECT id, {_PATH}, round(score, 6) AS score FROM gated",
    "gated_backfill": _with(SHARES, TREE, GATED) + f"SELECT id, {_PATH}, round(score, 6) AS score FROM filled",
    "top1": _with(SHARES, TREE) + "SELECT id, lvl, label, round(prob, 6) AS prob FROM tops",
    "topk": _with(SHARES)
    + """SELECT id, lvl, CAST(rn AS INTEGER) AS rank, label, round(prob, 6) AS prob
         FROM (SELECT *, row_number() OVER (PARTITION BY id, lvl ORDER BY prob DESC, label) AS rn FROM sc) WHERE rn <= 3""",
    "hier_edges": """
        WITH f AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT CAST(0 AS INTEGER) AS lvl, CAST(n_regionkey AS BIGINT) AS parent, CAST(s_nationkey AS BIGINT) AS child,
               min(s_suppkey) AS ord, count(*) AS n_rows FROM f GROUP BY ALL
        UNION ALL SELECT 1, s_nationkey, s_suppkey, min(s_suppkey), count(*) FROM f GROUP BY ALL""",
    "hier_collect": _with(BRANDS)
    + """SELECT CAST(0 AS INTEGER) AS lvl, parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY first_at) AS children
         FROM bs GROUP BY parent""",
    "hier_explode": _with(BRANDS)
    + """SELECT CAST(0 AS INTEGER) AS lvl, parent, child,
                row_number() OVER (PARTITION BY parent ORDER BY first_at) - 1 AS ord FROM bs""",
    "hier_integrity": _with(BRANDS)
    + """SELECT CAST(lvl AS INTEGER) AS lvl, child, count(*) AS n_parents FROM (
           SELECT 0 AS lvl, CAST(n_regionkey AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS child FROM nation
           UNION SELECT 1, s_nationkey, s_suppkey FROM supplier UNION SELECT 2, parent, child FROM bs)
         GROUP BY lvl, child HAVING count(*) > 1""",
    "duplicate_keys": "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1",
    "hier_from_backbone": """
        SELECT CAST(0 AS INTEGER) AS lvl, CAST(n_regionkey AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS child,
               CAST(n_nationkey + 100 AS BIGINT) AS ord FROM nation
        UNION ALL SELECT 1, s_nationkey, s_suppkey, s_suppkey + 1000 FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 10 <> 0""",
    "names_from_backbone": """
        SELECT CAST(0 AS INTEGER) AS lvl, r_name AS name, CAST(r_regionkey AS BIGINT) AS label FROM region
        UNION ALL SELECT 1, n_name, n_nationkey FROM nation
        UNION ALL SELECT 2, s_name, s_suppkey FROM supplier WHERE s_acctbal >= 0""",
    "children_trained": """
        SELECT CAST(0 AS INTEGER) AS lvl, CAST(n_regionkey AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS child FROM nation
        UNION ALL SELECT 1, s_nationkey, s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""",
    "dead_ends": """
        SELECT CAST(0 AS INTEGER) AS lvl, CAST(r_regionkey AS BIGINT) AS label FROM region
        WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)
        UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
    "row_count_parity": _with(SHARES, STRONG)
    + """, c AS (SELECT lvl, count(DISTINCT id) AS n_ids FROM strong GROUP BY lvl)
         SELECT lvl, n_ids, (SELECT count(DISTINCT n_ids) FROM c) = 1 AS parity FROM c""",
    "completeness": _with(SHARES, STRONG) + "SELECT n_lvls, count(*) AS n_ids FROM lvls GROUP BY n_lvls",
    "incomplete_ids": _with(SHARES, STRONG) + "SELECT id, n_lvls FROM lvls WHERE n_lvls <> 3",
    "combine_levels": _with(SHARES, STRONG)
    + "SELECT id, lvl, label, round(prob, 6) AS prob FROM strong WHERE id IN (SELECT id FROM lvls WHERE n_lvls = 3)",
    "combine_wide": _with(SHARES, CELLS)
    + "SELECT id, "
    + ", ".join(f"'0' AS dum{i}" for i in range(1, 6))
    + """, CAST(count(*) AS INTEGER) AS n_columns, CAST(count(*) FILTER (prob > 0) AS INTEGER) AS n_scored,
         arg_min(pos, (-prob, pos)) AS best_pos, round(max(prob), 6) AS best_prob FROM dense GROUP BY id""",
    "melt_wide": _with(SHARES, CELLS) + "SELECT id, lvl, label, ord, round(prob, 6) AS prob FROM dense",
    "read_combined": _with(SHARES, CELLS) + "SELECT CAST(id AS VARCHAR) AS id, lvl, label, ord, round(prob, 6) AS prob FROM dense",
    "read_combined_labels": _with(SHARES)
    + """SELECT CAST(t.id AS VARCHAR) AS id, u.name, CAST(CASE u.name WHEN 'region' THEN n_regionkey ELSE n_nationkey END AS VARCHAR) AS value
         FROM tot t LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = t.id, (VALUES ('region'), ('nation')) u(name)""",
    "prob_floor_fixed": _with(SHARES)
    + "SELECT id, lvl, label, round(CASE WHEN prob < 1e-1 THEN 0e0 ELSE prob END, 6) AS prob FROM sc",
    "prob_floor_uniform": _with(SHARES)
    + """, n AS (SELECT 0 AS lvl, count(*) AS n FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM supplier)
         SELECT id, sc.lvl, label, round(CASE WHEN prob < 1e0 / n THEN 0e0 ELSE prob END, 6) AS prob FROM sc JOIN n ON n.lvl = sc.lvl""",
    "truth_join": _with(TILES)
    + """SELECT t.id, orig_id, CAST(0 AS INTEGER) AS lvl, label, round(prob, 6) AS prob, CAST(n_regionkey AS BIGINT) AS true_label
         FROM tiles t JOIN customer ON CAST(c_custkey AS VARCHAR) = orig_id JOIN nation ON c_nationkey = n_nationkey""",
    "truth_unmatched": _with(TILES)
    + """SELECT DISTINCT id, orig_id FROM tiles WHERE orig_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0)""",
    "split_train_valid": """
        SELECT d.doc_id AS id, CASE WHEN d.doc_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, quality, n_chars, lang
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "union_logs": "SELECT event_id, user_id, event_type, value FROM events",
    "dedupe_first": """SELECT user_id, event_type, event_id, value FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
    "dedupe_last": """SELECT user_id, event_type, event_id, value FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "class_index": """SELECT p_type AS class_label, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS class_idx
        FROM (SELECT DISTINCT p_type FROM part)""",
    "label_list_explode": """
        SELECT n_regionkey AS lvl, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY CAST(n_nationkey AS VARCHAR)) - 1 AS INTEGER) AS pos,
               CAST(n_nationkey AS BIGINT) AS label, 'list' AS sorted_by FROM nation
        UNION ALL SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER), n_nationkey, 'number' FROM nation""",
    "label_decode": _with(LOGITS)
    + """, tr AS (SELECT CAST(row_number() OVER (ORDER BY CAST(code AS VARCHAR)) - 1 AS INTEGER) AS pos, CAST(code AS BIGINT) AS label
                  FROM (SELECT DISTINCT unnest(range(len(embedding))) * 3 + 1 AS code FROM embeddings)),
           best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, pos) AS rn FROM sm) WHERE rn = 1)
         SELECT id, b.pos, t.label, t.label + 47000 AS taxon_id, round(prob, 6) AS conf FROM best b JOIN tr t ON t.pos = b.pos""",
    "label_encode": """SELECT c_custkey AS id, CAST(c_nationkey * 7 + 50000 AS BIGINT) AS taxon_id, CAST(c_nationkey AS BIGINT) AS label FROM customer""",
    "id_extract": """
        WITH f AS (SELECT page_id, CAST(page_id AS VARCHAR) ||
                     CASE page_id % 4 WHEN 0 THEN '_original' WHEN 1 THEN '-aug7' WHEN 2 THEN '_001-002' ELSE '' END AS photo FROM pages)
        SELECT page_id, photo AS photo_id, split_part(photo, '-', 1) AS tile_of, split_part(photo, '_', 1) AS original,
               CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) ELSE photo END AS stripped FROM f""",
    "file_catalog": """
        WITH f AS (SELECT split_part(url, '/', 3) AS folder, CAST(page_id AS VARCHAR) AS base,
                     CASE page_id % 4 WHEN 0 THEN '_original' WHEN 1 THEN '-aug7' WHEN 2 THEN '_001-002' END AS mid,
                     CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'png' END AS ext FROM pages)
        SELECT '/images/' || folder || '/' || base || mid || '.' || ext AS path, folder, base || mid || '.' || ext AS file_name,
               lower(ext) AS suffix, base || mid AS photo_id FROM f WHERE ext IS NOT NULL""",
    "name_lookup": _with(SHARES, TREE, CANDIDATES, NAMED)
    + f"SELECT b.id, l0, l1, l2, r.name AS name0, n.name AS name1, s.name AS name2 FROM best b {_NAMES}",
    "submission_rows": _with(SHARES, TREE, CANDIDATES, CUT, NAMED)
    + f"""SELECT 'E1' AS sampling_event_id, 'images/E1/' || CAST(b.id AS VARCHAR) AS clip_file_path, 'plant_image' AS team,
            'NA' AS inat_code, 'image_segmentation' AS preparations, 'MachineObservation' AS collection_method,
            'ML_plant_ensemble' AS identification_method, 'ML_plant_ensemble' AS aiml_name, 'Plantae' AS kingdom, r.phylum AS phylum,
            '' AS "class", '' AS "order", coalesce(r.name, '') AS family, coalesce(n.name, '') AS genus, coalesce(s.name, '') AS species,
            coalesce(n.name, '') || ' ' || coalesce(s.name, '') AS scientific_name,
            CASE rank_lvl WHEN 0 THEN 'family' WHEN 1 THEN 'genus' WHEN 2 THEN 'species' ELSE '' END AS taxon_rank,
            printf('%.2f', confidence * 100) AS confidence_percent, 'NA' AS verification_method, 'NA' AS verification_name,
            'NA' AS occurrence_remarks, 'NA' AS individual_count, 'NA' AS organism_quantity, 'NA' AS organism_quantity_type,
            'NA' AS "references", 'NA' AS notes FROM ranked b {_NAMES}""",
    "submission_short": _with(SHARES, TREE, CANDIDATES, NAMED)
    + f"""SELECT CAST(b.id AS VARCHAR) AS photoid, {_SHORT}, 'species' AS taxon_rank, 'ML_plant_ensemble' AS identification_method,
            printf('%.2f', conf * 100) AS confidence_percent FROM best b {_NAMES}""",
    "gated_report": _with(SHARES, TREE, GATED, NAMED)
    + f"""SELECT CAST(b.id AS VARCHAR) AS photoid, {_SHORT.replace("r.phylum AS", "coalesce(r.phylum, '') AS")},
            CASE WHEN l2 IS NOT NULL THEN 'species' WHEN l1 IS NOT NULL THEN 'genus' WHEN l0 IS NOT NULL THEN 'family' ELSE '' END AS taxon_rank,
            'ML_plant_ensemble' AS identification_method, printf('%.2f', score * 100) AS confidence_percent
          FROM filled b {_NAMES.replace("JOIN rname", "LEFT JOIN rname", 1)}""",
    "softmax": _with(LOGITS) + "SELECT id, CAST(pos AS BIGINT) AS label, round(prob, 6) AS prob FROM sm",
    "smoothed_loss": _with(LOGITS)
    + """, l AS (SELECT id, 9e-1 * -max(CASE WHEN pos = truth THEN logp END) + 1e-1 * -avg(logp) AS loss FROM sm GROUP BY id)
         SELECT count(*) AS n_rows, round(avg(loss), 6) AS mean_loss FROM l""",
    "focal_loss": _with(LOGITS)
    + """SELECT count(*) AS n_rows, round(avg(-pow(1e0 - exp(logp), 2e0) * logp), 6) AS mean_loss FROM sm WHERE pos = truth""",
    "per_class_accuracy": _with(SHARES, TRUTH)
    + """SELECT lvl, true_label, CAST(sum(CASE WHEN true_label = pred_label THEN 1 ELSE 0 END) AS BIGINT) AS num_tp, count(*) AS num_total,
                round(1e2 * sum(CASE WHEN true_label = pred_label THEN 1 ELSE 0 END) / count(*), 6) AS accuracy_percent FROM pred GROUP BY lvl, true_label""",
    "overall_accuracy": _with(SHARES, TRUTH)
    + """, c AS (SELECT lvl, CAST(sum(CASE WHEN true_label = pred_label THEN 1 ELSE 0 END) AS BIGINT) AS num_tp, count(*) AS num_total FROM pred GROUP BY lvl)
         SELECT lvl, num_tp, num_total, round(CAST(num_tp AS DOUBLE) / num_total, 6) AS accuracy,
                CAST(floor(1e2 * num_tp / num_total) AS BIGINT) AS percent FROM c""",
    "true_vs_pred": _with(SHARES, TRUTH)
    + """SELECT t.id, t.lvl, u.true_label, round(s.prob, 6) AS true_prob, t.label AS pred_label, round(t.prob, 6) AS pred_prob
         FROM top2 t JOIN truth u ON u.id = t.id AND u.lvl = t.lvl
         LEFT JOIN sc s ON s.id = t.id AND s.lvl = t.lvl AND s.label = u.true_label""",
    "confusion_at_thresholds": _with(SHARES, TRUTH)
    + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, lvl, label) AS rn FROM sc WHERE lvl < 2) WHERE rn = 1),
           j AS (SELECT t.lvl, t.label, t.prob, t.label = u.true_label AS hit FROM top t JOIN truth u ON u.id = t.id AND u.lvl = t.lvl)
         SELECT lvl, label, """
    + ", ".join(
        f"CAST(sum(CASE WHEN {case.format(t=t)} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_p0_{t}"
        for name, case in (("tp", "prob > {t}e-1 AND hit"), ("fp", "prob > {t}e-1 AND NOT hit"), ("fn", "prob <= {t}e-1"))
        for t in range(2, 10)
    )
    + " FROM j GROUP BY lvl, label",
    "fpr_threshold": _with(SHARES, TRUTH)
    + """, neg AS (SELECT sc.lvl, prob, row_number() OVER (PARTITION BY sc.lvl ORDER BY prob DESC) - 1 AS rn, count(*) OVER (PARTITION BY sc.lvl) AS n
                   FROM sc JOIN truth u ON u.id = sc.id AND u.lvl = sc.lvl WHERE sc.lvl < 2 AND label <> true_label)
         SELECT lvl, n AS n_negatives, round(prob, 6) AS threshold FROM neg WHERE rn = CAST(floor(5e-3 * n) AS BIGINT)""",
    "prefix_counts": """
        WITH f AS (SELECT n_regionkey AS region, c_nationkey AS nation, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT CAST(0 AS INTEGER) AS lvl, region, CAST(NULL AS INTEGER) AS nation, CAST(NULL AS VARCHAR) AS segment, count(*) AS n_rows FROM f GROUP BY region
        UNION ALL SELECT 1, region, nation, NULL, count(*) FROM f GROUP BY region, nation
        UNION ALL SELECT 2, region, nation, segment, count(*) FROM f GROUP BY region, nation, segment""",
    "epoch_history": _with(STEPS) + "SELECT run, epoch, phase, n_rows, round(loss, 6) AS loss, round(acc, 6) AS acc FROM hist",
    "best_epoch": _with(STEPS)
    + """, v AS (SELECT run, epoch, acc, coalesce(max(acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS bb
                 FROM hist WHERE phase = 'val')
         SELECT run, epoch, round(acc, 6) AS acc, round(bb, 6) AS best_before, acc > bb AS saved FROM v""",
    "best_epoch_kept": _with(STEPS)
    + """SELECT run, epoch, round(acc, 6) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY acc DESC, epoch) AS rn
           FROM hist WHERE phase = 'val' AND acc > 0) WHERE rn = 1""",
    "read_score_log": _with(SHARES, CELLS) + "SELECT CAST(id AS VARCHAR) || '.jpg' AS id, lvl, label, ord, round(prob, 6) AS prob FROM dense",
    "read_mixed_logs": _with(SHARES, CELLS) + "SELECT CAST(id AS VARCHAR) || '.jpg' AS id, lvl, label, round(prob, 6) AS prob FROM dense",
    "parse_train_log": _with(STEPS)
    + """SELECT 'month_' || CAST(epoch // 31 AS VARCHAR) AS run, epoch, phase, round(loss, 4) AS loss, round(acc, 4) AS acc FROM hist""",
    "zscore": """
        WITH x AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
        s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY pos)
        SELECT id, CAST(x.pos AS INTEGER) AS pos, round(CASE WHEN sd = 0 THEN 0e0 ELSE (v - m) / sd END, 6) AS z FROM x JOIN s ON s.pos = x.pos""",
    "pca_gram": """SELECT CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS second, CASE WHEN a = b THEN 1e0 ELSE 0e0 END AS dot FROM range(8) x(a) CROSS JOIN range(8) y(b)""",
    "pca_means": """SELECT CAST(a AS INTEGER) AS component, (SELECT count(*) FROM embeddings) AS n_rows, 0e0 AS mean, true AS falls FROM range(8) x(a)""",
    "pca_wide": """SELECT CAST(a AS INTEGER) AS component, (SELECT count(*) FROM embeddings) AS n_rows, true AS is_eigenvector, true AS equals_covariance_fit FROM range(8) x(a)""",
    "logreg_check": """SELECT vec_id AS id, CAST((SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS n_classes, 1e0 AS total, true AS likeliest FROM embeddings""",
    "logreg_certificate": """SELECT label, (SELECT count(*) FROM embeddings) AS n_rows, true AS is_optimal FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings)""",
    "split_tables": """
        WITH r AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS id, n_chars, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS rn FROM documents)
        SELECT r.id, CASE WHEN l.doc_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, quality, n_chars
        FROM r JOIN labels l ON CAST(l.doc_id AS VARCHAR) = r.id WHERE rn = 1""",
    "stratified_folds": """
        WITH c AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label)
        SELECT label, CAST(f AS INTEGER) AS fold, (n + 4 - f) // 5 AS n_rows FROM c CROSS JOIN range(5) r(f) WHERE (n + 4 - f) // 5 > 0""",
}


def _half_up(sql: str) -> str:
    """``round(x, d)`` spelled out, so that exact ties round the same way in every engine."""
    return re.sub(
        r"round\(((?:(?!, [46]\)).)*), ([46])\)", r"(floor((\1) * 1e\2 + 5e-1) / 1e\2)", sql, flags=re.DOTALL
    )


ORACLES: dict[str, str] = {name: _half_up(sql) for name, sql in _QUERIES.items()}
