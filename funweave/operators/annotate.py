"""Annotation gates and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from funweave.functions.ids import piped_accession
from funweave.functions.text import norm_id
from funweave.operators import ontology as on

# Experimental evidence codes.
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")


def gaf_gate(
    goa: DataFrame, terms: DataFrame, codes: tuple[str, ...] = EXPERIMENTAL, blacklist: tuple[str, ...] = (), domain: str | None = None
) -> DataFrame:
    """protein_id, term_id, score 1 of the accepted annotations.

    Rejected: other evidence codes, a first qualifier NOT, unknown and obsolete terms, any blacklisted taxon, another
    namespace. Only the first qualifier counts; null flags count as not obsolete.
    """
    ok = goa.filter(norm_id(F.col("evidence_code")).isin(*codes) & (F.coalesce(F.split("qualifier", r"\|")[0], F.lit("")) != "NOT"))
    if blacklist:
        taxa = F.regexp_extract_all("taxon", F.lit("([0-9]+)"), 1)
        ok = ok.filter(~F.coalesce(F.arrays_overlap(taxa, F.array(*map(F.lit, blacklist))), F.lit(False)))
    known = terms.filter("not coalesce(is_obsolete, false)")
    known = (known.filter(F.col("go_namespace") == domain) if domain else known).select(F.col("go_id").alias("term_id"))
    rows = on.resolve(ok.select(F.col("db_object_id").alias("protein_id"), F.col("go_id").alias("term_id")), terms)
    return rows.join(known, "term_id", "left_semi").select("protein_id", "term_id").distinct().withColumn("score", F.lit(1.0))


def gate_counts(goa: DataFrame, terms: DataFrame, codes: tuple[str, ...] = EXPERIMENTAL, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """One row: read, blacklisted, other_code, negated, unknown_term, obsolete, kept; each row is counted under the first that holds."""
    names = on.resolve(terms.select(F.col("go_id").alias("term_id")).union(terms.select(F.explode("alt_id"))).distinct().withColumn("listed", F.col("term_id")), terms)
    flags = names.join(terms.select(F.col("go_id").alias("term_id"), F.coalesce("is_obsolete", F.lit(False)).alias("obsolete")), "term_id")
    flags = flags.groupBy(norm_id(F.col("listed")).alias("key")).agg(F.max("obsolete").alias("obsolete"))
    rows = goa.withColumn("key", norm_id(F.col("go_id"))).join(flags, "key", "left")
    taxa = F.regexp_extract_all("taxon", F.lit("([0-9]+)"), 1)
    listed = F.coalesce(F.arrays_overlap(taxa, F.array(*map(F.lit, blacklist))), F.lit(False)) if blacklist else F.lit(False)
    negated = F.coalesce(F.split("qualifier", r"\|")[0], F.lit("")) == "NOT"
    why = (
        F.when(listed, "blacklisted").when(~F.coalesce(norm_id(F.col("evidence_code")).isin(*codes), F.lit(False)), "other_code").when(negated, "negated")
        .when(F.col("obsolete").isNull(), "unknown_term").when(F.col("obsolete"), "obsolete").otherwise("kept")
    )
    kinds = ("blacklisted", "other_code", "negated", "unknown_term", "obsolete", "kept")
    return rows.select(why.alias("why")).agg(F.count("*").alias("read"), *(F.count_if(F.col("why") == k).alias(k) for k in kinds))


def code_filter(goa: DataFrame, pattern: str) -> DataFrame:
    """The rows whose evidence code matches a pattern anywhere, as a line filter on that column does."""
    return goa.filter(F.col("evidence_code").rlike(pattern))


def last_scores(rows: DataFrame, order: str) -> DataFrame:
    """protein_id, term_id, score: of several rows of a pair the last in the given order."""
    return rows.groupBy("protein_id", "term_id").agg(F.max_by("score", order).alias("score"))


def hit_files_seed(hits: DataFrame, annotations: DataFrame, terms: DataFrame, links: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """The binary seed of a profile search: hits (target_name as the query protein's hit, query_name, e_value) meet the
    annotations (protein_id, term_id) of their target, pass the e-value, and go up the ontology."""
    near = hits.select(F.col("query_name").alias("protein_id"), piped_accession(F.col("target_name")).alias("target"), F.col("e_value").alias("evalue"))
    rows = on.resolve(hit_transfer(near, annotations, threshold), terms)
    return on.up_propagate(rows.distinct(), on.ancestors(terms, links))


def organism_profile(annotations: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """organism_id, n_annotations, domain, n_proteins, n_terms, n_popular of annotations (organism_id, protein_id, term_id)."""
    rows = annotations.join(terms.select(F.col("go_id").alias("term_id"), F.col("go_namespace").alias("domain")), "term_id")
    per = rows.groupBy("organism_id", "domain", "term_id").agg(F.countDistinct("protein_id").alias("n"))
    by_term = per.groupBy("organism_id", "domain").agg(F.count("*").alias("n_terms"), F.count_if(F.col("n") >= least).alias("n_popular"))
    by_protein = rows.groupBy("organism_id", "domain").agg(F.countDistinct("protein_id").alias("n_proteins"), F.count("*").alias("n_annotations"))
    return by_protein.join(by_term, ["organism_id", "domain"])


def selected_organisms(profile: DataFrame, taxonomy: DataFrame | None = None, least_annotations: int = 10, least_popular: int = 8, domains: int = 3, kingdom: str | None = None) -> DataFrame:
    """organism_id of the organisms with enough annotations and enough popular terms in each of the domains; with a
    taxonomy (organism_id, lineage), of one kingdom, the first name of the lineage."""
    per = profile.groupBy("organism_id").agg(F.sum("n_annotations").alias("n"), F.count_if(F.col("n_popular") >= least_popular).alias("good"))
    out = per.filter((F.col("n") >= least_annotations) & (F.col("good") >= domains)).select("organism_id")
    if taxonomy is not None:
        own = taxonomy.filter(F.trim(F.split_part("lineage", F.lit(","), F.lit(1))) == kingdom) if kingdom else taxonomy
        out = out.join(own.select("organism_id").distinct(), "organism_id", "left_semi")
    return out


def taxon_rows(goa: DataFrame, taxon: str) -> DataFrame:
    """The rows of one taxon, alone or in a list."""
    return goa.filter(F.array_contains(F.regexp_extract_all("taxon", F.lit("([0-9]+)"), 1), taxon))


def date_gate(goa: DataFrame, year: int, after: bool = True) -> DataFrame:
    """Annotations of the year and later (or earlier), without negated ones; days that do not parse are dropped."""
    y = F.year(F.expr("try_to_date(annot_date, 'yyyyMMdd')"))
    return goa.filter(((y >= year) if after else (y < year)) & (F.coalesce(F.split("qualifier", r"\|")[0], F.lit("")) != "NOT"))


def hit_transfer(hits: DataFrame, annotations: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """protein_id, term_id, score 1: the terms of all targets with a low enough e-value."""
    near = hits.filter(F.col("evalue") <= threshold).select("protein_id", "target").distinct()
    return near.join(annotations.select(F.col("protein_id").alias("target"), "term_id"), "target").select("protein_id", "term_id").distinct().withColumn("score", F.lit(1.0))


def method_terms(rows: DataFrame, skip: tuple[str, ...] = ("seg", "coil")) -> DataFrame:
    """protein_id, method, term_id of domain-search rows (protein_id, method, go)."""
    named = rows.filter(~F.lower("method").isin(*skip) & F.col("go").isNotNull() & ~F.col("go").isin("-", ""))
    return named.select("protein_id", "method", F.explode(F.split("go", r"\|")).alias("t")).select("protein_id", "method", F.trim(F.split_part("t", F.lit("("), F.lit(1))).alias("term_id")).distinct()


def method_vote(rows: DataFrame) -> DataFrame:
    """protein_id, term_id, score: the share of all methods that assert the pair."""
    total = rows.agg(F.countDistinct("method").alias("m"))  # one row
    return rows.groupBy("protein_id", "term_id").agg(F.countDistinct("method").alias("n")).crossJoin(F.broadcast(total)).select("protein_id", "term_id", (F.col("n") / F.col("m")).alias("score"))
