"""Sources: each takes a session and a path and returns a DataFrame with a fixed schema. gz files just work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from funweave import schemas
from funweave.functions.ids import first_word, piped_accession
from funweave.operators import strict_load as sl
from funweave.operators.strict_load import TBLOUT_COLUMNS
from funweave.scratch import cut


def _lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    rows = spark.read.text(path).filter("trim(value) <> ''")
    return rows.filter(~F.col("value").startswith(comment)) if comment else rows


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


# The letters of the 20 amino acids.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, seq (amino acids only, upper case), name. Records are split at line starts, so files stay splittable."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("r")).filter("trim(r) <> ''")
    header = F.split_part("r", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.upper(F.substr("r", F.length(header) + 1)), f"[^{AMINO_ACIDS}]", "")
    return rows.select(header.alias("header"), body.alias("seq"), first_word(header).alias("name"))


def obo_tags(spark: SparkSession, path: str) -> DataFrame:
    """stanza_no, stanza, tag, value: the tag lines of every stanza, the last included; comments and modifiers cut off."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\\\n", "").alias("t"))
    parts = text.select(F.posexplode(F.split(F.concat(F.lit("\n"), "t"), r"\n\[")).alias("stanza_no", "s")).filter("stanza_no > 0")
    lines = parts.select("stanza_no", F.split_part("s", F.lit("]"), F.lit(1)).alias("stanza"), F.explode(F.split("s", r"\r?\n")).alias("line"))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[\w-]+:\s*(.*)$", 1), r"\s*(?:\{[^}]*\}\s*)?(?:!.*)?$", ""))
    return lines.select("stanza_no", "stanza", F.regexp_extract("line", r"^([\w-]+):", 1).alias("tag"), value.alias("value")).filter("tag <> ''")


def obo_terms(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (go_id, term_name, go_namespace, alt_id, is_obsolete) and links (go_id, relation, related_id) of [Term] stanzas."""
    own = tags.filter("stanza = 'Term'")
    one = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    terms = own.groupBy("stanza_no").agg(
        one("id").alias("go_id"), one("name").alias("term_name"), one("namespace").alias("go_namespace"),
        F.collect_list(F.when(F.col("tag") == "alt_id", F.col("value"))).alias("alt_id"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
    )
    part = F.regexp_extract("value", r"^(\S+)\s+(\S+)$", 1), F.regexp_extract("value", r"^(\S+)\s+(\S+)$", 2)
    up = own.filter("tag = 'is_a'").select("stanza_no", F.lit("is_a").alias("relation"), F.col("value").alias("related_id")).union(
        own.filter("tag = 'relationship'").select("stanza_no", part[0], part[1])
    )
    return terms.drop("stanza_no"), up.join(terms.select("stanza_no", "go_id"), "stanza_no").select("go_id", "relation", "related_id")


def raw_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The lines of a file in the form that strict_load reads: line_id (in file order), file_kind, file_name, line_text."""
    rows = spark.read.text(path)
    return rows.select(F.monotonically_increasing_id().alias("line_id"), F.lit(kind).alias("file_kind"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line_text"))


def strict_gaf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The typed rows of the conforming lines of an annotation file, and line_id, reason of the others."""
    lines = cut(raw_lines(spark, path, "gaf"), "lines")
    return sl.load_gaf(lines), sl.rejected(lines)


def strict_tblout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The typed rows of the conforming lines of a profile search, and line_id, reason of the others."""
    lines = cut(raw_lines(spark, path, "tblout"), "lines")
    return sl.load_tblout(lines), sl.rejected(lines)


def gaf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="!", quote="", schema=schemas.GAF)


def tblout(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path, "#").select(F.split(F.trim("value"), r"\s+", 19).alias("f"))
    return rows.select(*((_field(i).try_cast("double") if 4 <= i <= 17 else _field(i)).alias(n) for i, n in enumerate(TBLOUT_COLUMNS)))


def interproscan(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, method, go (the raw list, null if the row has no such field)."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    return rows.select(_field(0).alias("protein_id"), _field(3).alias("method"), _field(13).alias("go"))


def evalue_file(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, target, evalue, term_id: ragged rows of three fields and one or more terms."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 4)
    return rows.select(_field(0).alias("protein_id"), _field(1).alias("target"), _field(2).try_cast("double").alias("evalue"), F.explode(F.slice("f", F.lit(4), F.size("f"))).alias("term_id"))


def blast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.BLAST)


def string_links(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header, endpoints as strings and channels as ints, with organism_id, the text before the first dot."""
    rows = spark.read.csv(path, sep=" ", header=True)
    ends = rows.columns[:2]
    return rows.select(F.split_part(ends[0], F.lit("."), F.lit(1)).alias("organism_id"), *ends, *(F.col(c).try_cast("int").alias(c) for c in rows.columns[2:]))


def string_species(spark: SparkSession, path: str, core_only: bool = True) -> DataFrame:
    rows = _lines(spark, path, "#").select(F.split("value", "\t").alias("f")).select(_field(0).alias("tax_id"), _field(1).alias("kind"))
    return rows.filter("kind = 'core'") if core_only else rows


def graph(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schemas.GRAPH)


def scores(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Labelling, seed and prediction files: protein_id, term_id, score."""
    return spark.read.csv(path, sep=sep, schema=schemas.SCORES)


def collection(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """p1, p2 (the first two columns, whatever their names) and a double for each channel."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.select(F.col(rows.columns[0]).alias("p1"), F.col(rows.columns[1]).alias("p2"), *(F.col(c).try_cast("double").alias(c) for c in rows.columns[2:]))


def homology(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame | None:
    """The homology graph of a parquet folder or a text file; None without a path."""
    if not path:
        return None
    return spark.read.parquet(path) if path.endswith(".parquet") else graph(spark, path, sep)


def is_structural(spark: SparkSession, path: str) -> bool:
    """Whether the first line of a file is a header with Protein and GO ID."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and {"Protein", "GO ID"} <= set(first[0][0].split("\t"))


def structural_assignments(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, term_id, score of a file with a header of Protein and GO ID; a bad score is 0, a missing column 1."""
    rows = spark.read.csv(path, sep="\t", header=True)
    lacking = {"Protein", "GO ID"} - set(rows.columns)
    if lacking:
        raise ValueError(f"columns missing: {sorted(lacking)}")
    score = F.coalesce(F.col("Score").try_cast("double"), F.lit(0.0)) if "Score" in rows.columns else F.lit(1.0)
    return rows.select(F.col("Protein").alias("protein_id"), F.col("GO ID").alias("term_id"), score.alias("score"))


def clamp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="protein_id string, term_id string")


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("tax_id"))


def interpro2go(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path, "!").select(F.regexp_extract("value", "(IPR[0-9]+)", 1).alias("interpro"), F.explode(F.regexp_extract_all("value", F.lit("(GO:[0-9]{7})"), 1)).alias("term_id"))
    return rows.filter("interpro <> ''").distinct()


def protein2ipr(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """accession, interpro; only accessions of `wanted` (accession) if it is given."""
    rows = _lines(spark, path, "#").select(F.split(F.trim("value"), r"\s+").alias("f"), "value")
    rows = rows.select(_field(0).alias("accession"), F.explode(F.regexp_extract_all("value", F.lit("(IPR[0-9]+)"), 1)).alias("interpro")).distinct()
    return rows.join(wanted.select("accession").distinct(), "accession", "left_semi") if wanted is not None else rows


def swissprot_ipr(spark: SparkSession, path: str, fasta_path: str) -> DataFrame:
    """accession, interpro of the accessions in a FASTA file of piped names."""
    names = fasta(spark, fasta_path).select(piped_accession(F.col("name")).alias("accession"))
    return protein2ipr(spark, path, names)


def proteomes(spark: SparkSession, path: str) -> DataFrame:
    """A proteome table with its header; column names in lower case with underscores."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.toDF(*("_".join(c.lower().split()) for c in rows.columns))


def foldseek(spark: SparkSession, path: str) -> DataFrame:
    """Hits of 12 or 16 columns with row_no in file order; numbers that do not parse are null."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("row_no")).filter(F.size("f") >= 12)
    whole = {"alnlen", "qstart", "qend", "tstart", "tend", "qlen", "tlen"}
    cell = lambda i, n: _field(i) if i < 2 else _field(i).try_cast("double").cast("int") if n in whole else _field(i).try_cast("double")
    return rows.select(*(cell(i, n).alias(n) for i, n in enumerate(schemas.FOLDSEEK)), "row_no")


def information_content(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f")).select(_field(0).alias("term_id"), _field(1).try_cast("double").alias("ic"))


def structure_files(spark: SparkSession, folder: str, pattern: str = "*.{pdb,cif}") -> DataFrame:
    """Paths of structure files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """Sorted ids with a dense number from 0. For dimension tables: ids are numbered within sampled ranges, then offset."""
    ranged = ids.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id())
    rows = cut(ranged, "ranged")  # both uses below must see the same ranges
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(column)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(start.select("part", "start")), "part").select(column, (F.col("start") + F.col("at") - 1).cast("int").alias("idx"))
