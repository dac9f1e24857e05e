"""Explicit schemas of the text formats; nothing is inferred."""

from __future__ import annotations

GAF = (
    "db string, db_object_id string, db_object_symbol string, qualifier string, go_id string, db_reference string, evidence_code string, "
    "with_from string, aspect string, db_object_name string, synonyms string, db_object_type string, taxon string, annot_date string, "
    "assigned_by string, annotation_extension string, gene_product_form_id string"
)
BLAST = (
    "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, "
    "evalue double, bitscore double, qlen int"
)
SCORES = "protein_id string, term_id string, score double"
GRAPH = "p1 string, p2 string, score double"
IC = "term_id string, ic double"
FOLDSEEK = "query target evalue bits fident alnlen qstart qend tstart tend qlen tlen qtmscore ttmscore alntmscore lddt".split()
