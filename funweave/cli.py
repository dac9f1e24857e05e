"""python -m funweave.cli COMMAND ...: the pipeline's steps from file to file."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession, functions as F

from funweave.operators import annotate as an, combine as co, diffusion as di, graphs as gr, hierarchy as hi, ontology as on
from funweave.functions import ids
from funweave.plans import predict as pr
from funweave.sources import readers as rd, sinks as sk


def _ontology(spark: SparkSession, path: str):  # noqa: ANN202
    terms, relations = rd.obo_terms(rd.obo_tags(spark, path))
    return terms, on.same_domain(hi.resolved_links(terms, relations), terms)


def diffuse(spark: SparkSession, a: argparse.Namespace) -> None:
    sk.write_tsv(di.METHODS[a.method](gr.canonical(rd.graph(spark, a.graph)), rd.scores(spark, a.labelling), tolerance=a.tolerance), a.output)


def combine(spark: SparkSession, a: argparse.Namespace) -> None:
    edges = rd.collection(spark, a.collection)
    names = a.selection.split(",") if a.selection else edges.columns[2:]
    edges = edges.groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(*(F.sum(n).alias(n) for n in names)).filter("p1 <> p2")
    known = rd.fasta(spark, a.fasta).select(F.col("name").alias("protein_id"))
    edges = gr.within(edges, known)
    scaled = gr.channel_norm(edges, names)
    coef = gr.seed_coefficients(scaled, rd.scores(spark, a.seed), names, known, a.threshold)
    sk.write_tsv(gr.combined(scaled, names, coef), a.output)


def hmmer_seed(spark: SparkSession, a: argparse.Namespace) -> None:
    terms, links = _ontology(spark, a.obo)
    rows = rd.evalue_file(spark, a.evalue_file).filter(F.col("evalue") <= a.threshold).select("protein_id", "term_id").distinct().withColumn("score", F.lit(1.0))
    sk.write_tsv(on.up_propagate(on.resolve(rows, terms), on.ancestors(terms, links)), a.output)


def interpro_seed(spark: SparkSession, a: argparse.Namespace) -> None:
    terms, links = _ontology(spark, a.obo)
    rows = on.resolve(an.method_terms(rd.interproscan(spark, a.interpro_file)), terms)
    up = rows.join(on.ancestors(terms, links), "term_id").select("protein_id", "method", F.col("ancestor").alias("term_id"))
    sk.write_tsv(an.method_vote(rows.select("protein_id", "method", "term_id").union(up).distinct()), a.output)


def combine_seeds(spark: SparkSession, a: argparse.Namespace) -> None:
    sk.write_tsv(co.weighted_sum([rd.scores(spark, f) for f in a.seed_files], a.coefficients), a.output)


def build_clamp(spark: SparkSession, a: argparse.Namespace) -> None:
    terms, _ = _ontology(spark, a.obo)
    known = rd.fasta(spark, a.fasta).select(F.col("name").alias("protein_id"))
    sk.write_clamp(an.gaf_gate(rd.gaf(spark, a.gaf), terms, tuple(a.evidence_codes)).join(known, "protein_id", "left_semi"), a.output)


def rescore(spark: SparkSession, a: argparse.Namespace) -> None:
    _, links = _ontology(spark, a.obo)
    sk.write_tsv(co.rescore(rd.scores(spark, a.prediction), links, a.th_start), a.output)


def top_predictions(spark: SparkSession, a: argparse.Namespace) -> None:
    sk.write_tsv(co.top_n(rd.scores(spark, a.prediction_file), a.N).drop("rank_no"), a.output)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    given = {f.name: getattr(a, f.name) for f in fields(pr.Inputs)}
    inputs = pr.Inputs(**given).configured(a.run_config)
    lacking = [n for n in ("fasta", "obo") if not getattr(inputs, n)]
    if lacking or not (inputs.channels or (inputs.links and inputs.orthologs)):
        raise SystemExit(f"missing: {', '.join(lacking) or 'channels, or links and orthologs'}")
    sk.write_tsv(pr.from_files(spark, a.folder, inputs, pr.Settings(method=a.method)), a.output)


def transfer(spark: SparkSession, a: argparse.Namespace) -> None:
    sk.write_tsv(pr.transferred(spark, a.links, a.orthologs, a.blacklist, a.max_evalue, a.perc, a.positives), a.output, header=True)


def homology(spark: SparkSession, a: argparse.Namespace) -> None:
    sk.write_tsv(gr.within(gr.homology(rd.blast(spark, a.blast))[0], rd.fasta(spark, a.fasta).select(F.col("name").alias("protein_id"))), a.output)


def extract_seeds(spark: SparkSession, a: argparse.Namespace) -> None:
    """The seed stages of a prediction folder as text, each in a folder of its own."""
    for name in ("seed-domains", "seed-profiles"):
        sk.write_tsv(spark.read.parquet(f"{a.folder}/{name}-*.parquet"), f"{a.output}/{name}")


def filter_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """Annotations with the evidence codes, and the sequences they name; lines that fail go to a folder with their reason."""
    rows, bad = rd.strict_gaf(spark, a.gaf)
    kept = rows.filter(F.col("evidence_code").isin(*a.evidence_codes.split(",")))
    kept = kept.withColumn("annot_date", F.date_format("annot_date", "yyyyMMdd"))
    sk.write_gaf(kept, f"{a.output}/gaf")
    own = rd.fasta(spark, a.fasta).withColumn("protein_id", ids.piped_accession(F.col("name")))
    sk.write_fasta(own.join(kept.select(F.col("db_object_id").alias("protein_id")).distinct(), "protein_id", "left_semi"), f"{a.output}/fasta")
    sk.write_tsv(bad, f"{a.output}/rejected")


COMMANDS = {
    "predict": (predict, ["folder"], {"run_config": "", "method": "laplacian"} | {f.name: "" if f.default is MISSING else f.default for f in fields(pr.Inputs)}),
    "transfer": (transfer, ["links", "orthologs"], {"blacklist": "", "max_evalue": 1e-6, "perc": 80.0, "positives": 60.0}),
    "homology": (homology, ["blast", "fasta"], {}),
    "extract-seeds": (extract_seeds, ["folder"], {}),
    "filter": (filter_files, ["gaf", "fasta"], {"evidence_codes": ",".join(an.EXPERIMENTAL)}),
    "diffuse": (diffuse, ["graph", "labelling"], {"method": "laplacian", "tolerance": 1e-9}),
    "combine": (combine, ["collection", "seed", "fasta"], {"selection": "", "threshold": 0.2}),
    "hmmer-seed": (hmmer_seed, ["evalue_file", "obo"], {"threshold": 1e-4}),
    "interpro-seed": (interpro_seed, ["interpro_file", "obo"], {}),
    "rescore-continuous": (rescore, ["prediction", "obo"], {"th_start": 0.0}),
    "top-predictions": (top_predictions, ["prediction_file"], {"N": 10}),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="funweave")
    subs = parser.add_subparsers(required=True)
    for name, (run, paths, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for p in [*paths, "output"]:
            sub.add_argument(f"--{p.replace('_', '-')}", dest=p, required=True)
        for o, v in options.items():
            sub.add_argument(f"--{o.replace('_', '-')}", dest=o, type=type(v), default=v)
        sub.set_defaults(run=run)
    sub = subs.add_parser("combine-seeds")
    sub.add_argument("--seed-files", nargs="+", required=True)
    sub.add_argument("--coefficients", nargs="+", type=float)
    sub.add_argument("--output", required=True)
    sub.set_defaults(run=combine_seeds)
    sub = subs.add_parser("build-clamp")
    for p in ("gaf", "obo", "fasta", "output"):
        sub.add_argument(f"--{p}", required=True)
    sub.add_argument("--evidence-codes", nargs="+", default=list(an.EXPERIMENTAL))
    sub.set_defaults(run=build_clamp)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("funweave").getOrCreate(), args)


if __name__ == "__main__":
    main()
