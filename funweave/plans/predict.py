"""The whole prediction: seeds and channels from their files, combined graph, diffusion, blend; stages resume from parquet."""

from __future__ import annotations

import configparser
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.functions import ids
from funweave.operators import annotate as an, combine as co, diffusion as di, graphs as gr, hierarchy as hi, ontology as on, orthology as ot
from funweave.sources import readers as rd
from funweave.sources.sinks import stage


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; their values name the stages."""

    method: str = "laplacian"
    tolerance: float = 1e-9
    tau: float = 0.2
    seed_weights: tuple[float, float] = (0.9, 0.1)


def predict(
    spark: SparkSession, folder: str, channels: DataFrame, names: list[str], seed_a: DataFrame, seed_b: DataFrame, proteins: DataFrame,
    truth: DataFrame | None = None, settings: Settings = Settings(), alias: str = "run",
) -> DataFrame:
    """protein_id, term_id, score. channels: p1 < p2 and one column for each name; proteins: the index, protein_id; truth clamps before and after."""
    config = asdict(settings) | {"alias": alias, "names": names, "target": "all pairs of the index"}

    def graph() -> DataFrame:
        scaled = gr.channel_norm(gr.within(channels, proteins), names)
        coef = gr.seed_coefficients(scaled, seed_a, names, proteins, settings.tau)
        return gr.combined(scaled, names, coef).filter("score <> 0")

    w = stage(spark, folder, "graph", config, graph)
    tied = lambda s: co.clamp(s, truth) if truth is not None else s
    spread = lambda s: di.METHODS[settings.method](w, tied(s), tolerance=settings.tolerance)
    a = stage(spark, folder, "spread-a", config, lambda: spread(seed_a))
    b = stage(spark, folder, "spread-b", config, lambda: spread(seed_b))
    return co.weighted_sum([tied(a), tied(b)], list(settings.seed_weights))


@dataclass(frozen=True)
class Inputs:
    """Paths of a run; empty ones are left out. domains is a domain search or structural assignments, told by the header;
    channels is a ready collection, or made from links, orthologs and the transfer blacklist."""

    fasta: str
    obo: str
    domains: str = ""
    hmmer: str = ""
    gaf: str = ""
    channels: str = ""
    links: str = ""
    orthologs: str = ""
    transfer_blacklist: str = ""
    hmmer_blacklist: str = ""
    homology: str = ""
    blast: str = ""
    clamp: str = ""
    alias: str = "run"
    id_form: str = "whole"  # or accession: the second field of names with pipes

    def configured(self, path: str, section: str = "run") -> Inputs:
        """The inputs with those of a section of an INI file in their place; unknown names are an error."""
        if not path:
            return self
        found = configparser.ConfigParser()
        if not found.read(path) or not found.has_section(section):
            raise ValueError(f"{path} has no section {section}")
        given = dict(found[section])
        unknown = set(given) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **given)


def index_of(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """protein_id of the FASTA file."""
    name = F.col("name") if inputs.id_form == "whole" else ids.piped_accession(F.col("name"))
    return rd.fasta(spark, inputs.fasta).select(name.alias("protein_id")).distinct()


def domain_seed(spark: SparkSession, path: str, terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Structural assignments as they are, or the vote of the methods of a domain search after propagation within each."""
    if rd.is_structural(spark, path):
        return on.resolve(rd.structural_assignments(spark, path), terms).groupBy("protein_id", "term_id").agg(F.sum("score").alias("score"))
    rows = on.resolve(an.method_terms(rd.interproscan(spark, path)), terms)
    up = rows.join(closure, "term_id").select("protein_id", "method", F.col("ancestor").alias("term_id"))
    return an.method_vote(rows.select("protein_id", "method", "term_id").union(up).distinct())


def transferred(spark: SparkSession, links: str, orthologs: str, blacklist: str = "", max_evalue: float = 1e-6, perc: float = 80.0, positives: float = 60.0) -> DataFrame:
    """p1, p2 and the summed channels of the links of all organisms. orthologs: a parquet table of ortholog_table with organism_id."""
    rows = rd.string_links(spark, links)
    ends, names = rows.columns[1:3], rows.columns[3:]
    banned = rd.blacklist(spark, blacklist) if blacklist else None
    validity = {"max_evalue": max_evalue, "perc": perc, "positives": positives}
    got = ot.transfer_edges(rows.withColumnsRenamed(dict(zip(ends, "ab"))), spark.read.parquet(orthologs), names, blacklist=banned, validity=validity)
    return got.drop("max_evalue")


def from_files(spark: SparkSession, folder: str, inputs: Inputs, settings: Settings = Settings()) -> DataFrame:
    """protein_id, term_id, score from the files of a run."""
    terms, relations = rd.obo_terms(rd.obo_tags(spark, inputs.obo))
    links = on.same_domain(hi.resolved_links(terms, relations), terms)
    config = asdict(inputs)
    closure = stage(spark, folder, "closure", config, lambda: on.ancestors(terms, links))
    proteins = stage(spark, folder, "index", config, lambda: index_of(spark, inputs))
    own = lambda df: df.join(proteins, "protein_id", "left_semi").join(terms.select(F.col("go_id").alias("term_id")), "term_id", "left_semi").select("protein_id", "term_id", "score")
    none = spark.createDataFrame([], "protein_id string, term_id string, score double")

    def profile_seed() -> DataFrame:
        if not (inputs.hmmer and inputs.gaf):
            return none
        banned = tuple(r[0] for r in rd.blacklist(spark, inputs.hmmer_blacklist).collect()) if inputs.hmmer_blacklist else ()  # a short list given by hand
        truths = an.gaf_gate(rd.strict_gaf(spark, inputs.gaf)[0], terms, blacklist=banned)
        return own(an.hit_files_seed(rd.strict_tblout(spark, inputs.hmmer)[0], truths, terms, links))

    def collection() -> DataFrame:
        found = rd.collection(spark, inputs.channels) if inputs.channels else transferred(spark, inputs.links, inputs.orthologs, inputs.transfer_blacklist)
        names = found.columns[2:]
        ends = [F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")]
        edges = found.filter("p1 <> p2").groupBy(*ends).agg(*(F.sum(n).alias(n) for n in names))
        near = rd.homology(spark, inputs.homology) if inputs.homology else gr.homology(rd.blast(spark, inputs.blast))[0] if inputs.blast else None
        if near is not None:
            edges = edges.join(gr.canonical(near).withColumnRenamed("score", "homology"), ["p1", "p2"], "full").na.fill(0.0, [*names, "homology"])
        return gr.within(edges, proteins)

    seed_a = stage(spark, folder, "seed-domains", config, lambda: own(domain_seed(spark, inputs.domains, terms, closure)) if inputs.domains else none)
    seed_b = stage(spark, folder, "seed-profiles", config, profile_seed)
    channels = stage(spark, folder, "channels", config, collection)
    truth = None
    if inputs.clamp:
        known = on.resolve(rd.clamp(spark, inputs.clamp), terms).withColumn("score", F.lit(1.0))
        truth = stage(spark, folder, "clamp", config, lambda: own(on.up_propagate(known, closure)))
    return predict(spark, folder, channels, channels.columns[2:], seed_a, seed_b, proteins, truth, settings, inputs.alias)
