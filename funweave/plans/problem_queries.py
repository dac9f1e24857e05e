"""Queries of the general problems 1, 2, 3 and 7, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.operators import heavy_keys as hk, hierarchy as hi, multivalue as mv, strict_load as sl


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _occ(s: SparkSession, d: str) -> DataFrame:
    return hi.occurrences(read(s, d, "goterm"), read(s, d, "goterm_relation"))


QUERIES = {
    "p1_found": lambda s, d: hi.loop_terms(read(s, d, "goterm"), read(s, d, "goterm_relation")),
    "p1_paths": lambda s, d: _occ(s, d).select("root", "go_id", "depth", F.array_join("path", ">").alias("path")),
    "p1_terms": lambda s, d: hi.term_summary(_occ(s, d)),
    "p1_descendants": lambda s, d: hi.descendants(hi.cut(_occ(s, d), "occ")),
    "p2_found": lambda s, d: mv.split_fields(read(s, d, "goa")),
    "p3_found": lambda s, d: hk.heavy_keys(read(s, d, "goa")),
    "p3_key_stats": lambda s, d: hk.key_stats(read(s, d, "goa")),
    "p7_found": lambda s, d: sl.rejected(read(s, d, "raw_line")),
    "p7_gaf_rows": lambda s, d: sl.load_gaf(read(s, d, "raw_line")),
    "p7_tblout_rows": lambda s, d: sl.load_tblout(read(s, d, "raw_line")),
}

_LINKS = """
names AS (
  SELECT go_id AS name, go_id AS term FROM goterm
  UNION ALL SELECT a, min(go_id) FROM (SELECT unnest(alt_id) AS a, go_id FROM goterm) GROUP BY a HAVING a NOT IN (SELECT go_id FROM goterm)),
links AS (
  SELECT DISTINCT c.term AS child, p.term AS parent FROM goterm_relation r
  JOIN names c ON c.name = regexp_extract(upper(r.go_id), '^\\s*([^\\s!{]+)', 1)
  JOIN names p ON p.name = regexp_extract(upper(r.related_id), '^\\s*([^\\s!{]+)', 1)
  WHERE r.relation IN ('is_a', 'part_of')),
reach AS (
  SELECT child, parent FROM links UNION SELECT reach.child, links.parent FROM reach JOIN links ON links.child = reach.parent)"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT child AS go_id FROM reach WHERE child = parent",
    "p3_key_stats": """
WITH t AS (
  SELECT DISTINCT goa_id, db_object_id, unnest(regexp_extract_all(taxon, '([0-9]+)', 1)) AS key_text FROM goa),
r AS (
  SELECT 'taxon' AS field_name, key_text, db_object_id FROM t
  UNION ALL SELECT 'go_id', upper(trim(go_id, ' ' || chr(9) || chr(10) || chr(13))), db_object_id FROM goa WHERE go_id IS NOT NULL)
SELECT field_name, key_text, count(*) AS n_rows, count(DISTINCT db_object_id) AS n_members FROM r WHERE key_text <> '' GROUP BY ALL""",
}
SQL["p1_descendants"] = f"""WITH RECURSIVE {_LINKS},
good AS (SELECT l.* FROM links l LEFT JOIN reach r ON r.child = l.parent AND r.parent = l.child WHERE l.child <> l.parent AND r.child IS NULL),
up AS (SELECT child, parent FROM good UNION SELECT u.child, g.parent FROM up u JOIN good g ON g.child = u.parent)
SELECT parent AS go_id, child AS descendant FROM up"""
_PATHS = f"""WITH RECURSIVE {_LINKS},
good AS (SELECT l.* FROM links l LEFT JOIN reach r ON r.child = l.parent AND r.parent = l.child WHERE l.child <> l.parent AND r.child IS NULL),
pth AS (
  SELECT go_id AS root, go_id, 0 AS depth, go_id AS path FROM goterm WHERE go_id IS NOT NULL AND go_id NOT IN (SELECT child FROM good)
  UNION ALL SELECT root, g.child, depth + 1, path || '>' || g.child FROM pth JOIN good g ON g.parent = pth.go_id)"""
SQL["p1_paths"] = f"{_PATHS} SELECT root, go_id, depth, path FROM pth"
SQL["p1_terms"] = f"{_PATHS} SELECT go_id, count(*) AS n_paths, min(depth) AS min_depth, max(depth) AS max_depth, count(DISTINCT root) AS n_roots FROM pth GROUP BY 1"
SQL["p3_found"] = f"""
SELECT field_name, key_text FROM ({SQL["p3_key_stats"]}) WHERE n_rows >= 0.02 * (SELECT count(*) FROM goa)"""
_GAF_QUOTED = "list_bool_or(list_transform(f, lambda x: starts_with(x, '\"') AND NOT regexp_full_match(x, '\"([^\"]|\"\")*\"')))"
_NUM = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_CODES = ", ".join(f"'{c}'" for c in sl.EVIDENCE_CODES)
_BL = "' ' || chr(9) || chr(13) || chr(10)"
SQL["p7_found"] = f"""
WITH b AS (SELECT line_id, file_kind, regexp_replace(line_text, '\\r$', '') AS body FROM raw_line),
c AS (
  SELECT line_id, file_kind, body, CASE WHEN file_kind = 'gaf' THEN string_split(body, chr(9)) ELSE regexp_split_to_array(trim(body, {_BL}), '[ \\t]+') END AS f
  FROM b WHERE trim(body, {_BL}) <> '' AND NOT (file_kind = 'gaf' AND starts_with(body, '!')) AND NOT (file_kind = 'tblout' AND starts_with(body, '#'))),
r AS (
  SELECT line_id, CASE
    WHEN file_kind = 'gaf' AND len(f) <> 17 THEN 'columns'
    WHEN file_kind = 'tblout' AND len(f) < 19 THEN 'columns'
    WHEN file_kind = 'gaf' AND {_GAF_QUOTED} THEN 'quoting'
    WHEN file_kind = 'gaf' AND NOT (regexp_full_match(f[5], 'GO:[0-9]{{7}}') AND f[7] IN ({_CODES}) AND f[9] IN ('P', 'F', 'C')
      AND regexp_full_match(f[14], '[0-9]{{8}}') AND try_strptime(f[14], '%Y%m%d') IS NOT NULL) THEN 'invalid'
    WHEN file_kind = 'tblout' AND (starts_with(f[5], '-')
      OR NOT list_bool_and(list_transform(f[5:18], lambda x: regexp_full_match(x, '{_NUM}')))) THEN 'invalid' END AS reason FROM c)
SELECT line_id, reason FROM r WHERE reason IS NOT NULL"""


def _pieces(field: str) -> str:
    """The values of a cell as a list: the longest pieces of quoted spans, escaped characters and other characters that are no separator."""
    seps, cell = ("|;,", field) if field == "synonyms" else ("|;,\\s", field)
    if field == "synonyms":  # a comma between digits is hidden behind a character of its own
        for _ in range(2):
            cell = f"regexp_replace({cell}, '([0-9]),([0-9])', '\\1' || chr(57346) || '\\2', 'g')"
    found = f"""regexp_extract_all({cell}, '(?:"(?:[^"]|"")*"|\\\\[\\s\\S]|[^{seps}])+')"""
    whole = f"list_transform({found}, lambda x: trim(x, {_BL}))"
    clean = f"""CASE WHEN regexp_full_match(x, '"(?:[^"]|"")*"') THEN trim(replace(substring(x, 2, length(x) - 2), '""', '"'), {_BL})
      ELSE regexp_replace(x, '\\\\([\\s\\S])', '\\1', 'g') END"""
    return f"list_filter(list_transform({whole}, lambda x: replace({clean}, chr(57346), ',')), lambda x: x <> '')"


SQL["p2_found"] = f"""
WITH v AS (""" + " UNION ALL ".join(f"SELECT goa_id, '{f}' AS field_name, {_pieces(f)} AS items FROM goa" for f in mv.FIELDS) + """)
SELECT goa_id, field_name, CAST(unnest(range(1, len(items) + 1)) AS INTEGER) AS pos, unnest(items) AS item FROM v WHERE len(items) >= 2"""
_CONTENT = SQL["p7_found"][: SQL["p7_found"].rindex("SELECT line_id, reason")].replace("SELECT line_id, CASE", "SELECT line_id, file_kind, body, f, CASE")
_UNQUOTED = "CASE WHEN starts_with(f[{0}], '\"') THEN replace(substring(f[{0}], 2, length(f[{0}]) - 2), '\"\"', '\"') ELSE f[{0}] END"
SQL["p7_gaf_rows"] = f"""{_CONTENT} SELECT line_id, {", ".join(
    (f"CAST(strptime(f[{i}], '%Y%m%d') AS DATE)" if c == "annot_date" else _UNQUOTED.format(i)) + f" AS {c}" for i, c in enumerate(sl.GAF_COLUMNS, 1)
)} FROM r WHERE reason IS NULL AND file_kind = 'gaf'"""
SQL["p7_tblout_rows"] = f"""{_CONTENT} SELECT line_id, {", ".join(
    (f"CAST(f[{i}] AS DOUBLE)" if 5 <= i <= 18 else f"regexp_extract(trim(body, {_BL}), '^(?:[^ \\t]+[ \\t]+){{{{18}}}}(.*)$', 1)".replace("{{", "{").replace("}}", "}") if i == 19 else f"f[{i}]") + f" AS {c}"
    for i, c in enumerate(sl.TBLOUT_COLUMNS, 1)
)} FROM r WHERE reason IS NULL AND file_kind = 'tblout'"""
