"""Queries of the prediction pipeline's operators over the protein tables, with the SQL they are held against.

Proteins that annotations name in their with-column form the graph; seed holds the labels, prediction the scores, and
annotations with experimental evidence the truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.functions import ids
from funweave.functions.text import norm_id
from funweave.operators import annotate as an, combine as co, diffusion as di, evaluate as ev, graphs as gr, hierarchy as hi, ontology as on, orthology as ot
from funweave.operators import structural as st
from funweave.operators.multivalue import split_cell
from funweave.plans.problem_queries import _LINKS, _pieces
from funweave.scratch import cut
from funweave.sources.readers import numbered


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:  # noqa: ANN001
    """Rounded to six digits in a way that does not depend on the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1_000_000 + 0.5) / 1_000_000


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def seed(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "seed").select(F.col("protein").alias("protein_id"), norm_id(F.col("go_id")).alias("term_id"), "score")
    return rows.filter("protein_id is not null and term_id is not null and score > 0 and not isnan(score)").groupBy("protein_id", "term_id").agg(F.max("score").alias("score"))


def prediction(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "prediction").select("protein_id", F.col("goterm").alias("term_id"), "score")
    return rows.filter("protein_id is not null and term_id is not null and score > 0 and not isnan(score)").groupBy("protein_id", "term_id").agg(F.max("score").alias("score"))


def truth(s: SparkSession, d: str) -> DataFrame:
    return an.gaf_gate(read(s, d, "goa"), read(s, d, "goterm"))


def raw_edges(s: SparkSession, d: str) -> DataFrame:
    """One row p1, p2, score 1 for each protein that an annotation names, both of them in the protein index."""
    known = read(s, d, "proteins").select("protein_id")
    # the values of the with-column, without the name of their database
    named = F.transform(split_cell(F.col("with_from"), "with_from"), lambda x: F.regexp_extract(x, "([^:]+)$", 1))
    rows = read(s, d, "goa").select(F.col("db_object_id").alias("p1"), F.explode(named).alias("p2"), "evidence_code")
    rows = rows.join(known.toDF("p1"), "p1", "left_semi").join(known.toDF("p2"), "p2", "left_semi")
    return rows.select("p1", "p2", F.lit(1.0).alias("score"), (norm_id(F.col("evidence_code")) == "IPI").cast("double").alias("ipi"))


def edges(s: SparkSession, d: str) -> DataFrame:
    return gr.canonical(raw_edges(s, d))


def channels(s: SparkSession, d: str) -> DataFrame:
    e = raw_edges(s, d).filter("p1 <> p2")
    return e.groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(F.sum("score").alias("c1"), F.sum(F.coalesce("ipi", F.lit(0.0))).alias("c2"))


def links(s: SparkSession, d: str) -> DataFrame:
    return hi.resolved_links(read(s, d, "goterm"), read(s, d, "goterm_relation"))


def closure(s: SparkSession, d: str, cross: bool) -> DataFrame:
    t = read(s, d, "goterm")
    return on.ancestors(t, links(s, d) if cross else on.same_domain(links(s, d), t))


def directed_hits(s: SparkSession, d: str) -> DataFrame:
    n = raw_edges(s, d).groupBy(F.col("p1").alias("query"), F.col("p2").alias("subject")).agg(F.count("*").alias("n"))
    return n.select("query", "subject", F.pow(F.lit(10.0), -F.col("n").cast("double")).alias("evalue"))


def hits(s: SparkSession, d: str) -> DataFrame:
    h = read(s, d, "foldseek_hit").filter("query_id is not null and target_id is not null and evalue is not null and not isnan(evalue)")
    return h.withColumnsRenamed({"query_id": "query", "target_id": "target"}).withColumn("row_no", F.unix_micros(F.col("loaded_at").cast("timestamp")))


def _best(h: DataFrame) -> DataFrame:
    return ot.best_hits(h.select("query", "target", "evalue", "row_no", F.col("fident").alias("pident")))


def q_reciprocal(s: SparkSession, d: str) -> DataFrame:
    h = hits(s, d).filter("fident is not null and not isnan(fident)")
    back = h.select(F.col("target").alias("query"), F.col("query").alias("target"), "evalue", "row_no", "fident")
    return rounded(ot.reciprocal(_best(h), _best(back)).select("query", "target", "pos"), "pos")


def q_transfer(s: SparkSession, d: str) -> DataFrame:
    """Links within four groups of taxa as organisms, and in each of them its proteins as orthologs of shorter ids."""
    p = read(s, d, "proteins").filter("taxon_id is not null and seq_len is not null").withColumn("organism_id", F.pmod("taxon_id", F.lit(4)))
    n = F.col("seq_len")
    orth = p.select(
        "organism_id", F.substring("protein_id", 1, 5).alias("query"), F.col("protein_id").alias("target"), F.pow(F.lit(10.0), -(n % 20).cast("double")).alias("query_evalue"),
        (70 + n % 31).cast("double").alias("query_perc"), (60 + n % 41).cast("double").alias("target_perc"), (50 + n % 51).cast("double").alias("pos"),
    )
    org = p.select(F.col("protein_id").alias("a"), "organism_id")
    ln = raw_edges(s, d).select(F.col("p1").alias("a"), F.col("p2").alias("b"), "score").join(org, "a")
    banned = s.createDataFrame([("3",)], "tax_id string")
    got = ot.transfer_edges(ln, orth, ["score"], blacklist=banned, validity={"max_evalue": 1e-6, "perc": 80.0, "positives": 60.0})
    return got.withColumn("max_evalue", F.round(F.log10("max_evalue")).cast("int"))


def q_coefficients(s: SparkSession, d: str) -> DataFrame:
    e = cut(channels(s, d), "channels")
    scaled = gr.channel_norm(e, ["c1", "c2"])
    c = gr.seed_coefficients(scaled, seed(s, d), ["c1", "c2"], read(s, d, "proteins"))
    rows = s.createDataFrame([("c1", float(c[0])), ("c2", float(c[1])), ("intercept", float(c[2]))], "name string, coef double")
    return rounded(rows, "coef")


def q_combined(s: SparkSession, d: str) -> DataFrame:
    e = cut(channels(s, d), "channels")
    scaled = gr.channel_norm(e, ["c1", "c2"])
    return rounded(gr.combined(scaled, ["c1", "c2"], gr.seed_coefficients(scaled, seed(s, d), ["c1", "c2"], read(s, d, "proteins"))), "score")


def diffused(method: str, rounds: int | None = None, top: int | None = None):  # noqa: ANN201
    """Eight rounds, or the solution to four digits; with top, pairs that are not among so many best of their protein may be missing."""
    if rounds:
        return lambda s, d: di.METHODS[method](edges(s, d), seed(s, d), rounds=rounds, digits=6)
    best = (top, 4) if top else None
    return lambda s, d: di.METHODS[method](edges(s, d), seed(s, d), tolerance=1e-12, top=best, digits=4)


def q_metrics(entity: str | None):  # noqa: ANN201
    def run(s: SparkSession, d: str) -> DataFrame:
        t = truth(s, d)
        c = ev.cells(prediction(s, d), t, on.information_content(t), entity)
        return rounded(ev.metrics(ev.curve(c)), "auc", "aupr", "f_max", "jaccard", "p_at_20", "s_min")

    return run


def q_curve(s: SparkSession, d: str) -> DataFrame:
    t = truth(s, d)
    c = ev.curve(ev.cells(prediction(s, d), t, on.information_content(t)))
    two = {x: F.floor(F.col(x) * 100 + 0.5) / 100 for x in ("ru", "mi")}  # sums of millions of doubles
    return rounded(c.select("score", "tp", "fp", "fn", "tn", "ru", "mi"), "score").withColumns(two)


def q_ndcg(k: int | None):  # noqa: ANN201
    def run(s: SparkSession, d: str) -> DataFrame:
        got = rounded(ev.ranked_gain(ev.grid_ranks(prediction(s, d), truth(s, d)), k), "dcg", "ndcg", "p_at_k", "ap_at_k")
        return got if k else got.drop("p_at_k")  # without a cut-off it is the base rate of the grid

    return run


def methods(s: SparkSession, d: str) -> DataFrame:
    g = read(s, d, "goa").select(F.col("db_object_id").alias("protein_id"), F.lower("assigned_by").alias("method"), norm_id(F.col("go_id")).alias("term_id"))
    return g.filter("method is not null and term_id is not null").distinct()


def target_hits(s: SparkSession, d: str) -> DataFrame:
    """Hits turned round: the seeds name the proteins that search, which here stand for the targets."""
    turned = {"query": "target", "target": "query", "qstart": "tstart", "tstart": "qstart", "qend": "tend", "tend": "qend", "qlen": "tlen", "tlen": "qlen", "qtmscore": "ttmscore", "ttmscore": "qtmscore"}
    return hits(s, d).withColumnsRenamed({k: f"_{k}" for k in turned}).withColumnsRenamed({f"_{k}": v for k, v in turned.items()})


def domains(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """target, interpro and interpro, term_id of the seeds."""
    rows = read(s, d, "seed").filter("interpro is not null")
    own = rows.filter("protein is not null").select(F.col("protein").alias("target"), "interpro").distinct()
    return own, rows.filter("go_id is not null").select("interpro", norm_id(F.col("go_id")).alias("term_id")).distinct()


def assignments(s: SparkSession, d: str) -> DataFrame:
    own, go = domains(s, d)
    return st.assignments(own.withColumnRenamed("target", "query"), go)


def organisms(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "proteins").filter("taxon_id is not null").select("protein_id", F.col("taxon_id").alias("organism_id"))
    return an.organism_profile(truth(s, d).join(p, "protein_id").select("organism_id", "protein_id", "term_id"), read(s, d, "goterm").filter("go_namespace is not null"))


def runs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three runs on the proteins of the index."""
    a, b = seed(s, d), prediction(s, d)
    return {"I": a, "P": b, "I+P": co.weighted_sum([a, b], [0.9, 0.1])}


def q_method_means(s: SparkSession, d: str) -> DataFrame:
    t = truth(s, d)
    ic = cut(on.information_content(t), "ic")
    per = {m: ev.metrics(ev.curve(ev.cells(x, t, ic, "protein_id"))) for m, x in runs(s, d).items() if m != "I+P"}
    return ev.labelled(rounded(ev.flattened(per), "value"), {"I": "domains", "P": "prediction"})


PIVOT = ["molecular_function", "biological_process", "cellular_component"]


def q_pivot(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "goterm").select(F.col("go_id").alias("term_id"), F.col("go_namespace").alias("ns"))
    rows = seed(s, d).join(t, "term_id").select("protein_id", F.col("ns").alias("term_id"), "score")
    return rounded(co.score_pivot(rows, PIVOT), *PIVOT)


QUERIES = {
    "diffuse_top_n": lambda s, d: co.top_n(diffused("laplacian", top=5)(s, d), 5),
    "id_index": lambda s, d: numbered(read(s, d, "proteins"), "protein_id"),
    "top_n_predictions": lambda s, d: co.top_n(prediction(s, d), 10).select("protein_id", "term_id", "rank_no"),
    "ancestor_closure": lambda s, d: closure(s, d, True),
    "up_propagate": lambda s, d: on.up_propagate(seed(s, d), closure(s, d, False)),
    "up_propagate_cross_domain": lambda s, d: on.up_propagate(seed(s, d), closure(s, d, True)),
    "information_content": lambda s, d: rounded(on.information_content(truth(s, d)), "ic"),
    "term_popularity": lambda s, d: on.popularity(truth(s, d), read(s, d, "goterm")),
    "gaf_gate": lambda s, d: truth(s, d).select("protein_id", "term_id"),
    "blacklist_anti": lambda s, d: an.gaf_gate(read(s, d, "goa"), read(s, d, "goterm"), blacklist=("8180843", "8110656")).select("protein_id", "term_id"),
    "build_clamp": lambda s, d: truth(s, d).join(read(s, d, "proteins"), "protein_id", "left_semi").select("protein_id", "term_id"),
    "taxon_filter": lambda s, d: an.taxon_rows(read(s, d, "goa"), "8180843").select("goa_id"),
    "date_gate": lambda s, d: an.date_gate(read(s, d, "goa"), 2015).select("goa_id"),
    "method_vote": lambda s, d: rounded(an.method_vote(methods(s, d)), "score"),
    "hit_transfer": lambda s, d: an.hit_transfer(hits(s, d).select(F.col("target").alias("protein_id"), F.col("query").alias("target"), "evalue"), truth(s, d), 1e-20).select("protein_id", "term_id"),
    "best_hit": lambda s, d: _best(hits(s, d)).select("query", "target", "evalue", "row_no"),
    "reciprocal_best_hit": q_reciprocal,
    "edge_transfer": q_transfer,
    "canonical_edges": edges,
    "symmetrise": lambda s, d: gr.symmetric(edges(s, d)),
    "homology_weights": lambda s, d: rounded(gr.homology(directed_hits(s, d))[0], "score"),
    "channel_norm": lambda s, d: rounded(gr.channel_norm(channels(s, d), ["c1", "c2"]), "c1", "c2"),
    "seed_jaccard": lambda s, d: rounded(gr.seed_jaccard(edges(s, d), gr.binarised(seed(s, d))), "y"),
    "combine_coefficients": q_coefficients,
    "combined_graph": q_combined,
    "masked_jaccard": lambda s, d: rounded(di.masked_jaccard(edges(s, d)), "score"),
    "laplacian_edges": lambda s, d: rounded(di.laplacian_edges(edges(s, d)), "score"),
    "diffuse_s2_k8": diffused("laplacian", 8),
    "diffuse_s2": diffused("laplacian"),
    "diffuse_cm_k8": diffused("consistency-method", 8),
    "diffuse_cm": diffused("consistency-method"),
    "diffuse_lwp_k8": diffused("label-weighted", 8),
    "diffuse_lwp": diffused("label-weighted"),
    "blend": lambda s, d: rounded(co.weighted_sum([seed(s, d), prediction(s, d)], [0.9, 0.1]), "score"),
    "combine_seeds": lambda s, d: rounded(co.weighted_sum([seed(s, d), prediction(s, d), truth(s, d)]), "score"),
    "clamp": lambda s, d: co.clamp(seed(s, d), truth(s, d)),
    "confusion_curve": q_curve,
    "metrics_overall": q_metrics(None),
    "metrics_per_gene": q_metrics("protein_id"),
    "metrics_per_term": q_metrics("term_id"),
    "ndcg_at_10": q_ndcg(10),
    "ndcg_full": q_ndcg(None),
    "eval_masks": lambda s, d: ev.masks(truth(s, d)).select("protein_id", "term_id"),
    "run_summary": lambda s, d: rounded(co.run_summary(prediction(s, d)), "min_score", "median_score", "mean_score", "max_score"),
    "pairwise_delta": lambda s, d: rounded(co.pairwise_delta(seed(s, d), prediction(s, d)), "delta"),
    "top_n_overlap": lambda s, d: rounded(co.overlap(co.top_n(seed(s, d), 10), co.top_n(prediction(s, d), 10)), "jaccard"),
    "score_pivot": q_pivot,
    "structural_select": lambda s, d: st.select_hits(hits(s, d)).select("query", "target", "row_no", "at"),
    "structural_transfer": lambda s, d: st.transfer(target_hits(s, d), *domains(s, d), closure(s, d, False)).select("protein_id", "term_id", "interpro"),
    "structural_fallback": lambda s, d: st.with_fallback(hits(s, d).filter("qtmscore is not null").select("query", "target").distinct(), hits(s, d).select("query", "target").distinct()),
    "gate_counts": lambda s, d: an.gate_counts(read(s, d, "goa"), read(s, d, "goterm"), blacklist=("8180843",)),
    "code_filter": lambda s, d: an.code_filter(read(s, d, "goa"), "IPI|ISS").select("goa_id"),
    "last_scores": lambda s, d: an.last_scores(read(s, d, "seed").filter("protein is not null and go_id is not null and score is not null and not isnan(score)").select(F.col("protein").alias("protein_id"), F.col("go_id").alias("term_id"), "score", F.struct("loaded_at", "score").alias("o")), "o"),
    "organism_profile": organisms,
    "organism_selection": lambda s, d: an.selected_organisms(organisms(s, d), least_popular=2, domains=2),
    "gains_losses": lambda s, d: co.extremes(rounded(co.pairwise_delta(seed(s, d), prediction(s, d)), "delta"), 20).select("protein_id", "term_id", "delta", "side", "rank_no"),
    "method_table": lambda s, d: rounded(co.method_table(runs(s, d)), "score"),
    "method_means": q_method_means,
    "structural_assign": lambda s, d: assignments(s, d).select("protein_id", "term_id", "interpro"),
    "ipr_support": lambda s, d: st.support(st.select_hits(target_hits(s, d)).select("query", "target"), domains(s, d)[0]),
    "rescore_children": lambda s, d: co.rescore(prediction(s, d), links(s, d), 0.05).select("protein_id", "term_id"),
    "accession_extract": lambda s, d: read(s, d, "proteins").select("protein_id", ids.piped_accession(ids.first_word(F.col("header"))).alias("accession")),
}

_NORM = "upper(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
_R = "floor(({}) * 1000000 + 0.5) / 1000000"
_GOOD = f"""{_LINKS},
good AS (SELECT l.* FROM links l LEFT JOIN reach r ON r.child = l.parent AND r.parent = l.child WHERE l.child <> l.parent AND r.child IS NULL),
dom AS (SELECT g.* FROM good g JOIN goterm a ON a.go_id = g.child JOIN goterm b ON b.go_id = g.parent WHERE a.go_namespace = b.go_namespace),
domall AS (SELECT g.* FROM links g JOIN goterm a ON a.go_id = g.child JOIN goterm b ON b.go_id = g.parent WHERE a.go_namespace = b.go_namespace),
domreach AS (SELECT child, parent FROM domall UNION SELECT r.child, l.parent FROM domreach r JOIN domall l ON l.child = r.parent),
domgood AS (SELECT l.* FROM domall l LEFT JOIN domreach r ON r.child = l.parent AND r.parent = l.child WHERE l.child <> l.parent AND r.child IS NULL),
upall AS (SELECT child AS term_id, parent AS ancestor FROM good UNION SELECT u.term_id, g.parent FROM upall u JOIN good g ON g.child = u.ancestor),
updom AS (SELECT child AS term_id, parent AS ancestor FROM domgood UNION SELECT u.term_id, g.parent FROM updom u JOIN domgood g ON g.child = u.ancestor)"""
_SEED = f"""s AS (SELECT protein AS protein_id, {_NORM.format("go_id")} AS term_id, max(score) AS score FROM seed
  WHERE protein IS NOT NULL AND go_id IS NOT NULL AND score > 0 AND NOT isnan(score) GROUP BY ALL)"""
_PRED = """pr AS (SELECT protein_id, goterm AS term_id, max(score) AS score FROM prediction
  WHERE protein_id IS NOT NULL AND goterm IS NOT NULL AND score > 0 AND NOT isnan(score) GROUP BY ALL)"""
_NAMES = """nm AS (SELECT go_id AS name, go_id AS term FROM goterm
  UNION ALL SELECT a, min(go_id) FROM (SELECT unnest(alt_id) AS a, go_id FROM goterm) GROUP BY a HAVING a NOT IN (SELECT go_id FROM goterm))"""
_GATE = f"""SELECT DISTINCT g.db_object_id AS protein_id, nm.term AS term_id FROM goa g JOIN nm ON nm.name = {_NORM.format("g.go_id")}
  JOIN goterm t ON t.go_id = nm.term WHERE NOT coalesce(t.is_obsolete, false) AND {_NORM.format("g.evidence_code")} IN ('EXP', 'IDA', 'IPI', 'IMP', 'IGI', 'IEP')
  AND coalesce(string_split(qualifier, '|')[1], '') <> 'NOT'"""
_TRUTH = f"{_NAMES}, tr AS ({_GATE})"
_RAW = f"""raw AS (SELECT p1, p2, CASE WHEN {_NORM.format("ev")} = 'IPI' THEN 1.0 ELSE 0.0 END AS ipi FROM (
  SELECT db_object_id AS p1, regexp_extract(unnest({_pieces("with_from")}), '([^:]+)$', 1) AS p2, evidence_code AS ev FROM goa)
  WHERE p1 IN (SELECT protein_id FROM proteins) AND p2 IN (SELECT protein_id FROM proteins))"""
_EDGES = f"""{_RAW}, e AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, CAST(count(*) AS DOUBLE) AS score FROM raw WHERE p1 <> p2 GROUP BY ALL),
b AS (SELECT p1 AS i, p2 AS j, score AS w FROM e UNION ALL SELECT p2, p1, score FROM e)"""
_MASKED = f"""{_EDGES}, r AS (SELECT i, 1 + sum(w) AS r FROM b GROUP BY 1),
c AS (SELECT e.p1, e.p2, sum(x.w * y.w) AS c FROM e JOIN b x ON x.i = e.p1 JOIN b y ON y.i = e.p2 AND y.j = x.j GROUP BY ALL),
jw AS (SELECT e.p1, e.p2, e.score * (2 * e.score + coalesce(c, 0)) / (a.r + z.r - (2 * e.score + coalesce(c, 0)) + 1) AS score
  FROM e LEFT JOIN c USING (p1, p2) JOIN r a ON a.i = e.p1 JOIN r z ON z.i = e.p2)"""
_LAP = f"""{_MASKED}, dg AS (SELECT i, sum(w) AS d FROM (SELECT p1 AS i, score AS w FROM jw UNION ALL SELECT p2, score FROM jw) GROUP BY 1),
le AS (SELECT p1, p2, score / a.d / 2 + score / z.d / 2 AS score FROM jw JOIN dg a ON a.i = p1 JOIN dg z ON z.i = p2),
ls AS (SELECT p1 AS i, p2 AS j, score AS w FROM le UNION ALL SELECT p2, p1, score FROM le)"""
_CHAN = f"""{_RAW}, ch AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, CAST(count(*) AS DOUBLE) AS c1, CAST(sum(ipi) AS DOUBLE) AS c2 FROM raw WHERE p1 <> p2 GROUP BY ALL),
cn AS (SELECT p1, p2, c1 / (max(c1) OVER () + 2.220446049250313e-16) AS c1, c2 / (max(c2) OVER () + 2.220446049250313e-16) AS c2 FROM ch)"""
_JAC = f"""bin AS (SELECT DISTINCT protein_id, term_id FROM s WHERE score / (SELECT max(score) FROM s) > 0.2),
sz AS (SELECT protein_id, count(*) AS n FROM bin GROUP BY 1)"""


def _jac(pairs: str) -> str:
    return f"""{_JAC}, cc AS (SELECT p1, p2, count(*) AS co FROM {pairs} JOIN bin x ON x.protein_id = p1 JOIN bin y ON y.protein_id = p2 AND y.term_id = x.term_id GROUP BY ALL),
yy AS (SELECT p1, p2, co / (a.n + z.n - co + 1) AS y FROM cc JOIN sz a ON a.protein_id = p1 JOIN sz z ON z.protein_id = p2)"""


# the target runs over all pairs of the protein index, pair by pair
_COEF = f"""{_SEED}, si AS (SELECT * FROM s WHERE protein_id IN (SELECT protein_id FROM proteins)), {_CHAN},
bin AS (SELECT DISTINCT protein_id, term_id FROM si WHERE score / (SELECT max(score) FROM si) > 0.2),
sz AS (SELECT protein_id, count(*) AS n FROM bin GROUP BY 1),
cc AS (SELECT x.protein_id AS p1, y.protein_id AS p2, count(*) AS co FROM bin x JOIN bin y ON y.term_id = x.term_id AND x.protein_id < y.protein_id GROUP BY ALL),
yy AS (SELECT p1, p2, co / (a.n + z.n - co + 1) AS y FROM cc JOIN sz a ON a.protein_id = p1 JOIN sz z ON z.protein_id = p2),
f AS (SELECT coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(y, 0.0) AS y FROM cn FULL JOIN yy ON yy.p1 = cn.p1 AND yy.p2 = cn.p2),
m AS (SELECT sum(c1*c1) AS a, sum(c1*c2) AS b, sum(c1) AS c, sum(c2*c2) AS d, sum(c2) AS e, sum(c1*y) AS u, sum(c2*y) AS v, sum(y) AS w,
  (SELECT count(*) * (count(*) - 1) / 2 FROM (SELECT DISTINCT protein_id FROM proteins)) AS f FROM f),
det AS (SELECT *, a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c) AS det FROM m),
k AS (SELECT (u*(d*f-e*e) - b*(v*f-e*w) + c*(v*e-d*w)) / det AS k1, (a*(v*f-e*w) - u*(b*f-e*c) + c*(b*w-v*c)) / det AS k2,
  (a*(d*w-v*e) - b*(b*w-v*c) + u*(b*e-d*c)) / det AS k3 FROM det)"""


def _jacobi(base: str, links: str, label: str, diagonal: str, rounds: int) -> str:
    """So many rounds of x = (b + S x) / k."""
    out = [f"{base}, lk AS ({links}), b0 AS ({label}), dk AS ({diagonal})", "x0 AS (SELECT protein_id, term_id, score / coalesce(k, 1) AS score FROM b0 LEFT JOIN dk USING (protein_id))"]
    for n in range(rounds):
        out.append(f"""x{n + 1} AS (SELECT protein_id, term_id, sum(score) / coalesce(any_value(k), 1) AS score FROM (
  SELECT * FROM b0 UNION ALL SELECT lk.i, term_id, w * score FROM lk JOIN x{n} ON x{n}.protein_id = lk.j) LEFT JOIN dk USING (protein_id) GROUP BY ALL)""".replace(" GROUP BY ALL)", " GROUP BY protein_id, term_id)"))  # fmt: skip
    return ",\n".join(out)


_S2 = (f"{_SEED}, {_LAP}", "SELECT i, j, 0.1 * w AS w FROM ls", "SELECT * FROM s", "SELECT i AS protein_id, 1 + 0.1 * sum(w) AS k FROM ls GROUP BY 1")
_LWP = (
    f"{_SEED}, {_LAP}, mx AS (SELECT protein_id, max(score) AS m FROM s GROUP BY 1)", "SELECT * FROM ls", "SELECT protein_id, term_id, (m + 0.1) * score AS score FROM s JOIN mx USING (protein_id)",
    "SELECT coalesce(mx.protein_id, q.i) AS protein_id, coalesce(m, 0) + 0.1 + coalesce(d, 0) AS k FROM (SELECT i, sum(w) AS d FROM ls GROUP BY 1) q FULL JOIN mx ON mx.protein_id = q.i",
)
_CM = (
    f"{_SEED}, {_EDGES}, dd AS (SELECT i, sum(abs(w)) AS d FROM b GROUP BY 1)", "SELECT b.i, b.j, 0.5 * abs(w) / sqrt(x.d * y.d) AS w FROM b JOIN dd x ON x.i = b.i JOIN dd y ON y.i = b.j",
    "SELECT protein_id, term_id, 0.5 * score AS score FROM s", "SELECT CAST(NULL AS VARCHAR) AS protein_id, 1.0 AS k WHERE false",
)
_K8 = {n: _jacobi(*x, 8) for n, x in (("s2", _S2), ("lwp", _LWP), ("cm", _CM))}
# rounds after which nothing moves within the digits that are kept
_FULL = {"s2": _jacobi(*_S2, 40), "lwp": _jacobi(*_LWP, 100), "cm": _jacobi(*_CM, 50)}
_LAST = {"s2": "x40", "lwp": "x100", "cm": "x50"}
_R4 = "floor(score * 10000 + 0.5) / 10000"
_PAIRS = f"""{_PRED}, {_TRUTH}, ns AS (SELECT count(DISTINCT score) AS ns FROM pr), icx AS (SELECT term_id, -log2(count(*) / (SELECT count(*) FROM tr)) AS ic FROM tr GROUP BY 1),
pp AS (SELECT coalesce(pr.protein_id, tr.protein_id) AS protein_id, coalesce(pr.term_id, tr.term_id) AS term_id, coalesce(CASE WHEN ns > 10000 THEN round_even(score * 10000, 0) / 10000 ELSE score END, 0.0) AS score, CASE WHEN tr.term_id IS NULL THEN 0 ELSE 1 END AS y
  FROM pr FULL JOIN tr ON tr.protein_id = pr.protein_id AND tr.term_id = pr.term_id CROSS JOIN ns),
grid AS (SELECT p.protein_id, t.term_id FROM (SELECT DISTINCT protein_id FROM pp) p CROSS JOIN (SELECT DISTINCT term_id FROM pp) t)"""


def _cells(entity: str, src: str = "pr") -> str:
    """The whole grid, built: the plain form that the engine's zero rows are held against."""
    n0 = "term_id" if entity == "protein_id" else "protein_id"
    pairs = _PAIRS if src == "pr" else f"{_SEED}, {_PAIRS}".replace("FROM pr),", f"FROM {src}),").replace("FROM pr FULL JOIN tr ON tr.protein_id = pr.protein_id AND tr.term_id = pr.term_id", f"FROM {src} pr FULL JOIN tr ON tr.protein_id = pr.protein_id AND tr.term_id = pr.term_id")
    return f"""{pairs},
cl AS (SELECT {entity} AS entity, coalesce(score, 0.0) AS score, count(*) AS n, sum(coalesce(y, 0)) AS pos, sum(coalesce(ic, 0) * coalesce(y, 0)) AS ic_pos, sum(coalesce(ic, 0) * (1 - coalesce(y, 0))) AS ic_neg
  FROM grid LEFT JOIN pp USING (protein_id, term_id) LEFT JOIN icx USING (term_id) GROUP BY 1, 2),
cv AS (SELECT entity, score, sum(pos) OVER d AS tp, sum(n - pos) OVER d AS fp, sum(pos) OVER a AS p, sum(n) OVER a AS t, sum(ic_pos) OVER a - sum(ic_pos) OVER d AS ru, sum(ic_neg) OVER d AS mi, count(*) OVER a AS k
  FROM cl WINDOW d AS (PARTITION BY entity ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY entity)),
ct AS (SELECT *, tp / (tp + fp) AS pc, CASE WHEN p > 0 THEN tp / p END AS rc, CASE WHEN t > p THEN fp / (t - p) END AS fr FROM cv),
ar AS (SELECT *, (fr - lag(fr) OVER w) * (rc + lag(rc) OVER w) / 2 AS a1, (rc - lag(rc) OVER w) * (pc + lag(pc) OVER w) / 2 AS a2 FROM ct WINDOW w AS (PARTITION BY entity ORDER BY score DESC)),
mt AS (SELECT entity, sum(a1) AS auc, sum(a2) AS aupr, max(2 * pc * rc / (pc + rc + 2.2250738585072014e-308)) AS f_max, max(tp / (tp + p - tp + fp)) AS jaccard,
  arg_max(pc, CASE WHEN rc >= 0.2 THEN score END) AS p20, min(sqrt(ru * ru + mi * mi)) / (SELECT count(DISTINCT {n0}) FROM pp) AS s_min, max(p) AS p, max(t) AS t, max(k) AS k, (max(p) = 0 OR max(p) = max(t) OR max(k) = 1) AS flat FROM ar GROUP BY 1)"""


def _metrics(entity: str) -> str:
    pick = lambda c, v, n: f"{_R.format(f'CASE WHEN flat THEN {v} ELSE {c} END')} AS {n}"
    cols = [pick("auc", "0.5", "auc"), pick("aupr", "p / t", "aupr"), pick("f_max", "0", "f_max"), pick("jaccard", "p / t", "jaccard"), pick("p20", "0", "p_at_20"), f"{_R.format('s_min')} AS s_min"]
    return f"WITH {_cells(entity)} SELECT entity, {', '.join(cols)} FROM mt"


def _ndcg(k: int | None) -> str:
    """The whole grid of proteins and terms, built and ranked."""
    few = lambda c: f"FILTER ({c} <= {k})" if k else ""
    return f"""WITH {_PRED}, {_TRUTH}, pp AS (SELECT protein_id, term_id FROM pr UNION SELECT protein_id, term_id FROM tr),
grid AS (SELECT p.protein_id, t.term_id FROM (SELECT DISTINCT protein_id FROM pp) p CROSS JOIN (SELECT DISTINCT term_id FROM pp) t),
x AS (SELECT g.protein_id, g.term_id, coalesce(score, 0.0) AS score, CASE WHEN tr.term_id IS NULL THEN 0 ELSE 1 END AS y FROM grid g
  LEFT JOIN pr ON pr.protein_id = g.protein_id AND pr.term_id = g.term_id LEFT JOIN tr ON tr.protein_id = g.protein_id AND tr.term_id = g.term_id),
r AS (SELECT *, row_number() OVER o AS rn, row_number() OVER (PARTITION BY protein_id ORDER BY y DESC, term_id DESC) AS bn, sum(y) OVER (PARTITION BY protein_id ORDER BY score DESC, term_id DESC ROWS UNBOUNDED PRECEDING) AS h FROM x WINDOW o AS (PARTITION BY protein_id ORDER BY score DESC, term_id DESC)),
g AS (SELECT protein_id AS entity, sum((pow(2, y) - 1) / log2(rn + 1)) {few("rn")} AS dcg, sum((pow(2, y) - 1) / log2(bn + 1)) {few("bn")} AS idcg, sum(y) {few("rn")} AS f, coalesce(sum(h / rn) FILTER (y > 0 {f"AND rn <= {k}" if k else ""}), 0) AS ap, sum(y) AS a FROM r GROUP BY 1)
SELECT entity, {_R.format("dcg")} AS dcg, {_R.format("CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END")} AS ndcg{f", {_R.format(f'f / {k}')} AS p_at_k" if k else ""}, {_R.format(f"CASE WHEN a > 0 THEN ap / {f'least(a, {k})' if k else 'a'} ELSE 0 END")} AS ap_at_k FROM g"""


_HITS = """h AS (SELECT query_id AS query, target_id AS target, *, epoch_us(loaded_at) AS row_no FROM foldseek_hit
  WHERE query_id IS NOT NULL AND target_id IS NOT NULL AND evalue IS NOT NULL AND NOT isnan(evalue))"""
_TURNED = f"""{_HITS}, h2 AS (SELECT target AS query, query AS target, evalue, row_no, tstart AS qstart, tend AS qend, tlen AS qlen, qstart AS tstart, qend AS tend, qlen AS tlen, qtmscore, ttmscore FROM h)"""
_DOMAINS = f"""i AS (SELECT DISTINCT protein, interpro FROM seed WHERE interpro IS NOT NULL AND protein IS NOT NULL),
g AS (SELECT DISTINCT interpro, {_NORM.format('go_id')} AS term_id FROM seed WHERE interpro IS NOT NULL AND go_id IS NOT NULL)"""
_ORGANISMS = f"""{_TRUTH}, oa AS (SELECT taxon_id AS organism_id, go_namespace AS domain, tr.protein_id, tr.term_id FROM tr JOIN proteins p ON p.protein_id = tr.protein_id JOIN goterm ON go_id = tr.term_id WHERE taxon_id IS NOT NULL AND go_namespace IS NOT NULL),
ot AS (SELECT organism_id, domain, term_id, count(DISTINCT protein_id) AS n FROM oa GROUP BY ALL),
profile AS (SELECT organism_id, domain, count(DISTINCT protein_id) AS n_proteins, count(*) AS n_annotations, (SELECT count(*) FROM ot WHERE ot.organism_id = oa.organism_id AND ot.domain = oa.domain) AS n_terms,
  (SELECT count(*) FROM ot WHERE ot.organism_id = oa.organism_id AND ot.domain = oa.domain AND n >= 3) AS n_popular FROM oa GROUP BY ALL)"""


def _select(rows: str) -> str:
    """The gated targets of each query in file order, the first fifty."""
    return f"""ht AS (SELECT *, (qtmscore + ttmscore) / 2 AS tm FROM {rows}), hv AS (SELECT query, bool_or(tm IS NOT NULL) AS has_tm FROM ht GROUP BY 1),
hg AS (SELECT ht.query, target, min(row_no) AS row_no FROM ht JOIN hv ON hv.query = ht.query WHERE evalue <= 1e-5 AND CASE WHEN qlen = 0 THEN 0 ELSE greatest(qend - qstart + 1, 0) / qlen END >= 0.7
  AND CASE WHEN tlen = 0 THEN 0 ELSE greatest(tend - tstart + 1, 0) / tlen END >= 0.7 AND (NOT has_tm OR coalesce(tm, 0) >= 0.5) GROUP BY ALL),
sel AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY row_no, target) AS place FROM hg QUALIFY place <= 50)"""


_TOP = "row_number() OVER (PARTITION BY protein_id ORDER BY score DESC, term_id)"

SQL = {
    "diffuse_top_n": f"WITH {_FULL['s2']}, q AS (SELECT protein_id, term_id, {_R4} AS score FROM {_LAST['s2']}) SELECT *, {_TOP} AS rank_no FROM q QUALIFY rank_no <= 5",
    "id_index": "SELECT protein_id, CAST(row_number() OVER (ORDER BY protein_id) - 1 AS INTEGER) AS idx FROM proteins",
    "top_n_predictions": f"WITH {_PRED} SELECT protein_id, term_id, {_TOP} AS rank_no FROM pr QUALIFY rank_no <= 10",
    "ancestor_closure": f"WITH RECURSIVE {_GOOD} SELECT * FROM upall",
    "up_propagate": f"WITH RECURSIVE {_GOOD}, {_SEED} SELECT protein_id, term_id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT protein_id, ancestor, score FROM s JOIN updom USING (term_id)) GROUP BY ALL",
    "up_propagate_cross_domain": f"WITH RECURSIVE {_GOOD}, {_SEED} SELECT protein_id, term_id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT protein_id, ancestor, score FROM s JOIN upall USING (term_id)) GROUP BY ALL",
    "information_content": f"WITH {_TRUTH} SELECT term_id, {_R.format('-log2(count(*) / (SELECT count(*) FROM tr))')} AS ic FROM tr GROUP BY 1",
    "term_popularity": f"""WITH {_TRUTH}, x AS (SELECT go_namespace AS domain, term_id, count(DISTINCT protein_id) AS n FROM tr JOIN goterm ON go_id = term_id GROUP BY ALL)
SELECT domain, (SELECT count(DISTINCT protein_id) FROM tr JOIN goterm ON go_id = term_id WHERE go_namespace = domain) AS n_proteins, count(*) AS n_terms, count(*) FILTER (n >= 3) AS n_popular FROM x WHERE domain IS NOT NULL GROUP BY domain""",
    "gaf_gate": f"WITH {_TRUTH} SELECT * FROM tr",
    "blacklist_anti": f"WITH {_NAMES} {_GATE} AND NOT coalesce(list_has_any(regexp_extract_all(taxon, '([0-9]+)', 1), ['8180843', '8110656']), false)",
    "build_clamp": f"WITH {_TRUTH} SELECT * FROM tr WHERE protein_id IN (SELECT protein_id FROM proteins)",
    "taxon_filter": "SELECT goa_id FROM goa WHERE list_contains(regexp_extract_all(taxon, '([0-9]+)', 1), '8180843')",
    "date_gate": "SELECT goa_id FROM goa WHERE regexp_full_match(annot_date, '[0-9]{8}') AND year(try_strptime(annot_date, '%Y%m%d')) >= 2015 AND coalesce(string_split(qualifier, '|')[1], '') <> 'NOT'",
    "method_vote": f"""WITH m AS (SELECT DISTINCT db_object_id AS protein_id, lower(assigned_by) AS method, {_NORM.format("go_id")} AS term_id FROM goa WHERE assigned_by IS NOT NULL AND go_id IS NOT NULL)
SELECT protein_id, term_id, {_R.format("count(DISTINCT method) / (SELECT count(DISTINCT method) FROM m)")} AS score FROM m GROUP BY ALL""",
    "hit_transfer": f"WITH {_HITS}, {_TRUTH} SELECT DISTINCT h.target AS protein_id, term_id FROM h JOIN tr ON tr.protein_id = h.query WHERE evalue <= 1e-20",
    "best_hit": f"WITH {_HITS} SELECT query, target, evalue, row_no FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY evalue, row_no DESC, target) = 1",
    "reciprocal_best_hit": f"""WITH {_HITS}, g AS (SELECT query, target, evalue, row_no, fident FROM h WHERE fident IS NOT NULL AND NOT isnan(fident)),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY evalue, row_no DESC, target) = 1), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY evalue, row_no DESC, query) = 1)
SELECT f.query, f.target, {_R.format("sqrt(f.fident * k.fident)")} AS pos FROM f JOIN k ON k.query = f.query AND k.target = f.target""",
    "edge_transfer": f"""WITH {_RAW}, o AS (SELECT protein_id, taxon_id % 4 AS org, substring(protein_id, 1, 5) AS q, seq_len % 20 AS e, 70 + seq_len % 31 AS qp, 60 + seq_len % 41 AS tp, 50 + seq_len % 51 AS pos
  FROM proteins WHERE taxon_id IS NOT NULL AND seq_len IS NOT NULL),
v AS (SELECT * FROM o WHERE org <> 3 AND e > 6 AND qp >= 80 AND tp >= 80 AND pos >= 60 AND org IN (SELECT org FROM o GROUP BY 1 HAVING count(*) > 2))
SELECT least(a.q, b.q) AS p1, greatest(a.q, b.q) AS p2, CAST(count(*) AS DOUBLE) AS score, CAST(-min(least(a.e, b.e)) AS INTEGER) AS max_evalue
FROM raw JOIN v a ON a.protein_id = p1 JOIN v b ON b.protein_id = p2 AND b.org = a.org WHERE a.q <> b.q GROUP BY ALL""",
    "canonical_edges": f"WITH {_EDGES} SELECT * FROM e",
    "symmetrise": f"WITH {_EDGES} SELECT * FROM b",
    "homology_weights": f"""WITH {_RAW}, n AS (SELECT p1, p2, pow(10.0, -count(*)) AS e FROM raw WHERE p1 <> p2 GROUP BY ALL),
g AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, CASE WHEN count(*) = 2 THEN max(e) ELSE greatest(max(e), 10.0) END AS e FROM n GROUP BY 1, 2),
w AS (SELECT p1, p2, CASE WHEN e = 0 THEN 1.0 WHEN e < 11 THEN -ln(e / 11) ELSE 0 END AS w FROM g)
SELECT p1, p2, {_R.format("CASE WHEN w = 1 THEN 1.0 ELSE w / (SELECT max(w) FROM w WHERE w <> 1) END")} AS score FROM w""",
    "channel_norm": f"WITH {_CHAN} SELECT p1, p2, {_R.format('c1')} AS c1, {_R.format('c2')} AS c2 FROM cn",
    "seed_jaccard": f"WITH {_SEED}, {_EDGES}, {_jac('e')} SELECT p1, p2, {_R.format('y')} AS y FROM yy",
    "combine_coefficients": f"WITH {_COEF} SELECT unnest(['c1', 'c2', 'intercept']) AS name, unnest([{_R.format('k1')}, {_R.format('k2')}, {_R.format('k3')}]) AS coef FROM k",
    "combined_graph": f"WITH {_COEF} SELECT p1, p2, {_R.format('k1 * c1 + k2 * c2')} AS score FROM cn CROSS JOIN k",
    "masked_jaccard": f"WITH {_MASKED} SELECT p1, p2, {_R.format('score')} AS score FROM jw",
    "laplacian_edges": f"WITH {_LAP} SELECT p1, p2, {_R.format('score')} AS score FROM le",
    **{f"diffuse_{m}_k8": f"WITH {q} SELECT protein_id, term_id, {_R.format('score')} AS score FROM x8" for m, q in _K8.items()},
    **{f"diffuse_{m}": f"WITH {q} SELECT protein_id, term_id, {_R4} AS score FROM {_LAST[m]}" for m, q in _FULL.items()},
    "blend": f"WITH {_SEED}, {_PRED} SELECT protein_id, term_id, {_R.format('sum(x)')} AS score FROM (SELECT protein_id, term_id, 0.9 * score AS x FROM s UNION ALL SELECT protein_id, term_id, 0.1 * score FROM pr) GROUP BY 1, 2",
    "combine_seeds": f"WITH {_SEED}, {_PRED}, {_TRUTH} SELECT protein_id, term_id, {_R.format('sum(x)')} AS score FROM (SELECT protein_id, term_id, score / 3 AS x FROM s UNION ALL SELECT protein_id, term_id, score / 3 FROM pr UNION ALL SELECT protein_id, term_id, CAST(1 AS DOUBLE) / 3 FROM tr) GROUP BY 1, 2",
    "clamp": f"WITH {_SEED}, {_TRUTH} SELECT protein_id, term_id, max(x) AS score FROM (SELECT protein_id, term_id, score AS x FROM s UNION ALL SELECT protein_id, term_id, 1.0 FROM tr) GROUP BY 1, 2",
    "confusion_curve": f"WITH {_cells(chr(39) + 'all' + chr(39))} SELECT {_R.format('score')} AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(t - p - fp AS BIGINT) AS tn, floor(ru * 100 + 0.5) / 100 AS ru, floor(mi * 100 + 0.5) / 100 AS mi FROM cv",
    "metrics_overall": _metrics("'all'"),
    "metrics_per_gene": _metrics("protein_id"),
    "metrics_per_term": _metrics("term_id"),
    "ndcg_at_10": _ndcg(10),
    "ndcg_full": _ndcg(None),
    "eval_masks": f"WITH {_TRUTH} SELECT * FROM tr WHERE protein_id IN (SELECT protein_id FROM tr GROUP BY 1 HAVING count(*) >= 4) AND term_id IN (SELECT term_id FROM tr GROUP BY 1 HAVING count(*) BETWEEN 3 AND 300)",
    "run_summary": f"WITH {_PRED} SELECT count(DISTINCT protein_id) AS n_proteins, count(DISTINCT term_id) AS n_terms, count(*) AS n_rows, {_R.format('min(score)')} AS min_score, {_R.format('median(score)')} AS median_score, {_R.format('avg(score)')} AS mean_score, {_R.format('max(score)')} AS max_score FROM pr",
    "pairwise_delta": f"WITH {_SEED}, {_PRED} SELECT coalesce(s.protein_id, pr.protein_id) AS protein_id, coalesce(s.term_id, pr.term_id) AS term_id, coalesce(s.score, 0) AS score_a, coalesce(pr.score, 0) AS score_b, {_R.format('coalesce(pr.score, 0) - coalesce(s.score, 0)')} AS delta FROM s FULL JOIN pr ON pr.protein_id = s.protein_id AND pr.term_id = s.term_id",
    "top_n_overlap": f"""WITH {_SEED}, {_PRED}, a AS (SELECT protein_id, term_id FROM s QUALIFY {_TOP} <= 10), b AS (SELECT protein_id, term_id FROM pr QUALIFY {_TOP} <= 10),
u AS (SELECT protein_id, term_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT protein_id, count(*) FILTER (n = 2) AS n_common, count(*) AS n_union, {_R.format("count(*) FILTER (n = 2) / count(*)")} AS jaccard FROM u GROUP BY 1""",
    "score_pivot": f"WITH {_SEED} SELECT protein_id, " + ", ".join(_R.format(f"coalesce(sum(score) FILTER (go_namespace = '{n}'), 0)") + f" AS {n}" for n in PIVOT) + " FROM s JOIN goterm ON go_id = term_id GROUP BY 1",
    "structural_select": f"WITH {_HITS}, {_select('h')} SELECT query, target, row_no, CAST(place AS INTEGER) AS \"at\" FROM sel",
    "structural_transfer": f"""WITH RECURSIVE {_GOOD}, {_TURNED}, {_select('h2')}, {_DOMAINS},
a AS (SELECT DISTINCT sel.query AS protein_id, g.term_id, i.interpro FROM sel JOIN i ON i.protein = sel.target JOIN g USING (interpro)),
t AS (SELECT protein_id, term_id FROM a UNION SELECT protein_id, ancestor FROM a JOIN updom USING (term_id))
SELECT t.protein_id, t.term_id, coalesce(a.interpro, '') AS interpro FROM t LEFT JOIN a USING (protein_id, term_id)""",
    "structural_fallback": f"""WITH {_HITS}, a AS (SELECT DISTINCT query, target FROM h WHERE qtmscore IS NOT NULL)
SELECT query, target, 'structure' AS source FROM a UNION ALL SELECT DISTINCT query, target, 'sequence' FROM h WHERE query NOT IN (SELECT query FROM a)""",
    "gate_counts": f"""WITH {_NAMES}, o AS (SELECT upper(trim(name, ' ')) AS key, bool_or(coalesce(t.is_obsolete, false)) AS obs FROM nm JOIN goterm t ON t.go_id = nm.term GROUP BY 1),
w AS (SELECT CASE WHEN coalesce(list_contains(regexp_extract_all(taxon, '([0-9]+)', 1), '8180843'), false) THEN 'b'
  WHEN NOT coalesce({_NORM.format("evidence_code")} IN ('EXP', 'IDA', 'IPI', 'IMP', 'IGI', 'IEP'), false) THEN 'c' WHEN coalesce(string_split(qualifier, '|')[1], '') = 'NOT' THEN 'n'
  WHEN key IS NULL THEN 'u' WHEN obs THEN 'o' ELSE 'k' END AS w FROM goa LEFT JOIN o ON key = {_NORM.format("goa.go_id")})
SELECT count(*) AS read, count(*) FILTER (w = 'b') AS blacklisted, count(*) FILTER (w = 'c') AS other_code, count(*) FILTER (w = 'n') AS negated, count(*) FILTER (w = 'u') AS unknown_term, count(*) FILTER (w = 'o') AS obsolete, count(*) FILTER (w = 'k') AS kept FROM w""",
    "code_filter": "SELECT goa_id FROM goa WHERE regexp_matches(evidence_code, 'IPI|ISS')",
    "last_scores": "SELECT protein AS protein_id, go_id AS term_id, score FROM seed WHERE protein IS NOT NULL AND go_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY protein, go_id ORDER BY loaded_at DESC, score DESC) = 1",
    "organism_profile": f"WITH {_ORGANISMS} SELECT * FROM profile",
    "organism_selection": f"WITH {_ORGANISMS} SELECT organism_id FROM profile GROUP BY 1 HAVING sum(n_annotations) >= 10 AND count(*) FILTER (n_popular >= 2) >= 2",
    "gains_losses": f"""WITH {_SEED}, {_PRED}, x AS (SELECT coalesce(s.protein_id, pr.protein_id) AS protein_id, coalesce(s.term_id, pr.term_id) AS term_id, {_R.format('coalesce(pr.score, 0) - coalesce(s.score, 0)')} AS delta
  FROM s FULL JOIN pr ON pr.protein_id = s.protein_id AND pr.term_id = s.term_id)
(SELECT *, 'gain' AS side, CAST(row_number() OVER (ORDER BY delta DESC, protein_id, term_id) AS INTEGER) AS rank_no FROM x QUALIFY rank_no <= 20)
UNION ALL (SELECT *, 'loss', CAST(row_number() OVER (ORDER BY delta, protein_id, term_id) AS INTEGER) AS rank_no FROM x QUALIFY rank_no <= 20)""",
    "method_table": f"""WITH {_SEED}, {_PRED} SELECT protein_id, term_id, method, {_R.format('score')} AS score FROM (SELECT *, 'I' AS method FROM s UNION ALL SELECT *, 'P' FROM pr
  UNION ALL SELECT protein_id, term_id, sum(x), 'I+P' FROM (SELECT protein_id, term_id, 0.9 * score AS x FROM s UNION ALL SELECT protein_id, term_id, 0.1 * score FROM pr) GROUP BY 1, 2)""",
    "method_means": " UNION ALL ".join(
        f"""SELECT '{label}' AS method, metric, {_R.format('avg(value)')} AS value FROM (UNPIVOT (WITH {_cells('protein_id', src)}
  SELECT CASE WHEN flat THEN 0.5 ELSE auc END AS auc, CASE WHEN flat THEN p / t ELSE aupr END AS aupr, CASE WHEN flat THEN 0 ELSE f_max END AS f_max, s_min FROM mt)
  ON auc, aupr, f_max, s_min INTO NAME metric VALUE value) GROUP BY metric"""
        for label, src in (("domains", "s"), ("prediction", "pr"))
    ),
    "structural_assign": f"WITH a AS (SELECT DISTINCT protein, interpro FROM seed WHERE interpro IS NOT NULL AND protein IS NOT NULL), g AS (SELECT DISTINCT interpro, {_NORM.format('go_id')} AS term_id FROM seed WHERE interpro IS NOT NULL AND go_id IS NOT NULL) SELECT protein AS protein_id, term_id, interpro FROM a JOIN g USING (interpro)",
    "ipr_support": f"WITH {_TURNED}, {_select('h2')}, {_DOMAINS} SELECT query, interpro, count(*) AS n FROM sel JOIN i ON i.protein = sel.target GROUP BY ALL",
    "rescore_children": f"WITH RECURSIVE {_LINKS}, {_PRED} SELECT protein_id, term_id FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr c JOIN links ON links.child = c.term_id WHERE c.protein_id = pr.protein_id AND links.parent = pr.term_id AND c.score <= pr.score + 0.05)",
    "accession_extract": r"SELECT protein_id, CASE WHEN contains(w, '|') THEN string_split(w, '|')[2] ELSE w END AS accession FROM (SELECT protein_id, regexp_extract(header, '^>?\s*(\S+)', 1) AS w FROM proteins)",
}
