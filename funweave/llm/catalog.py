"""The registered queries of the problems tagged llm, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.llm import frequencies as fr, packing as pk, residue as rs, similar_sets as ss, tokens as tk, top_items as ti


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _scores(s: SparkSession, d: str) -> DataFrame:
    a = ti.scored(_t(s, d, "prediction"), "prediction", "protein_id", "goterm", "score")
    return a.unionByName(ti.scored(_t(s, d, "foldseek_hit"), "hit", "query_id", "target_id", "bits"))


def _names(s: SparkSession, d: str) -> DataFrame:
    """The words of each annotation's name of its protein."""
    return _t(s, d, "goa").select("db_object_id", F.filter(F.split(F.lower("db_object_name"), " "), lambda x: x != "").alias("words"))


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return tk.token_counts(_t(s, d, "documents"))


QUERIES = {
    "p4_found": lambda s, d: ti.top_items(_scores(s, d)),
    "p5_found": lambda s, d: fr.marked_values(_t(s, d, "goa")).filter("mark is not null").select("field_name", "val_text", "mark"),
    "p5_counts": lambda s, d: fr.marked_values(_t(s, d, "goa")),
    "p5_ngrams": lambda s, d: fr.gram_counts(fr.array_sequences(_names(s, d), "words", "db_object_id"), 3).select("n", "v1", "v2", "v3", "n_rows", "n_members"),
    "p6_found": lambda s, d: ss.similar_pairs(_t(s, d, "seed"), "protein", "go_id"),
    "p6_links": lambda s, d: ss.similar_links(_t(s, d, "seed"), "protein", "go_id").select("record", "n_links"),
    "p6_members": lambda s, d: ss.members(_t(s, d, "seed"), "protein", "go_id"),
    "p6_class_pairs": lambda s, d: ss.class_pairs(_t(s, d, "seed"), "protein", "go_id"),
    "p8_ids": lambda s, d: tk.token_ids(_t(s, d, "documents")),
    "p9_containers": lambda s, d: pk.pack(_lengths(s, d), "doc_id", "n_tokens"),
    "p10_found": lambda s, d: rs.residue(_t(s, d, "documents")),
    "p10_validation": lambda s, d: rs.validate(_t(s, d, "documents")),
    "p9_fill": lambda s, d: pk.fills(_lengths(s, d), "doc_id", "n_tokens"),
}

_BL = "' ' || chr(9) || chr(10) || chr(13)"
_PAIRS = f"""
v AS (SELECT DISTINCT protein, upper(trim(go_id, {_BL})) AS g FROM seed WHERE protein IS NOT NULL AND go_id IS NOT NULL),
k AS (SELECT protein, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 4),
w AS (SELECT v.protein, g, n FROM v JOIN k USING (protein)),
c AS (SELECT a.protein AS protein_a, b.protein AS protein_b, a.n AS na, b.n AS nb, count(*) AS c
  FROM w a JOIN w b ON a.g = b.g AND a.protein < b.protein AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL),
pairs AS (SELECT protein_a, protein_b FROM c WHERE c >= 0.75 * (na + nb - c))"""
_CLASSES = f"""st AS (SELECT protein, list_sort(list(DISTINCT upper(trim(go_id, {_BL})))) AS terms FROM seed WHERE protein IS NOT NULL AND go_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT upper(trim(go_id, {_BL}))) >= 4),
cl AS (SELECT protein, min(protein) OVER (PARTITION BY terms) AS rep FROM st)"""
_COUNTS = f"""
SELECT field_name, val_text, count(*) AS n_rows, count(DISTINCT db_object_id) AS n_members,
  CASE WHEN count(DISTINCT db_object_id) < 3 THEN 'rare'
       WHEN count(DISTINCT db_object_id) > 0.05 * (SELECT count(DISTINCT db_object_id) FROM goa) THEN 'common' END AS mark
FROM (SELECT 'go_id' AS field_name, upper(trim(go_id, {_BL})) AS val_text, db_object_id FROM goa
      UNION ALL SELECT 'evidence_code', upper(trim(evidence_code, {_BL})), db_object_id FROM goa)
WHERE val_text IS NOT NULL GROUP BY ALL"""

_WORDS = """w AS (SELECT goa_id, db_object_id, list_filter(string_split(lower(db_object_name), ' '), lambda x: x <> '') AS ws FROM goa WHERE db_object_name IS NOT NULL),
g AS (SELECT db_object_id, n, ws[i] AS v1, CASE WHEN n > 1 THEN ws[i + 1] END AS v2, CASE WHEN n > 2 THEN ws[i + 2] END AS v3
  FROM (SELECT db_object_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS n) WHERE i + n - 1 <= len(ws))"""

SQL = {
    "p5_ngrams": f"WITH {_WORDS} SELECT n, v1, v2, v3, count(*) AS n_rows, count(DISTINCT db_object_id) AS n_members FROM g GROUP BY ALL",
    "p4_found": """
WITH r AS (
  SELECT 'prediction' AS list_name, protein_id AS group_id, goterm AS item_id, score FROM prediction
  UNION ALL SELECT 'hit', query_id, target_id, bits FROM foldseek_hit),
m AS (SELECT list_name, group_id, item_id, max(score) AS score FROM r
  WHERE group_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT list_name, group_id, item_id, CAST(row_number() OVER (PARTITION BY list_name, group_id ORDER BY score DESC, item_id) AS INTEGER) AS rank_no
FROM m QUALIFY rank_no <= 5""",
    "p5_counts": _COUNTS,
    "p5_found": f"SELECT field_name, val_text, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p6_found": f"WITH {_PAIRS} SELECT protein_a, protein_b FROM pairs",
    "p6_members": f"WITH {_CLASSES} SELECT protein AS record, rep FROM cl",
    "p6_class_pairs": f"""WITH {_CLASSES}, {_PAIRS} SELECT DISTINCT least(a.rep, b.rep) AS rep_a, greatest(a.rep, b.rep) AS rep_b
FROM pairs JOIN cl a ON a.protein = protein_a JOIN cl b ON b.protein = protein_b WHERE a.rep <> b.rep""",
    "p6_links": f"""
WITH {_PAIRS} SELECT protein AS record, count(protein_a) AS n_links FROM k LEFT JOIN pairs ON protein IN (protein_a, protein_b) GROUP BY 1""",
}
