"""Small hand-checked cases of the pipeline's operators, and files read and written."""

import math

import numpy as np
import pyarrow as pa
import pytest

from funweave import cli
from funweave.operators import annotate as an, blocks, combine as co, diffusion as di, evaluate as ev, graphs as gr, hierarchy as hi, ontology as on, orthology as ot, structural as st
from funweave.sources import readers as rd, sinks as sk

S = "protein_id string, term_id string, score double"
G = "p1 string, p2 string, score double"


def table(df):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}


EDGES = [("b", "a", 0.8), ("b", "c", 0.5), ("a", "c", 0.2), ("d", "d", 9.0)]
LABELS = [("a", "t1", 1.0), ("c", "t2", 1.0), ("d", "t1", 0.5), ("d", "t2", 0.5)]
WANT = {
    "laplacian": {("a", "t1"): 0.917188654, ("b", "t1"): 0.066132464, ("c", "t1"): 0.016678881, ("d", "t1"): 0.5, ("a", "t2"): 0.016678881, ("b", "t2"): 0.045499965, ("c", "t2"): 0.937821153, ("d", "t2"): 0.5},
    "label-weighted": {("a", "t1"): 0.742587186, ("b", "t1"): 0.494419204, ("c", "t1"): 0.212465614, ("d", "t1"): 0.5, ("a", "t2"): 0.212465614, ("b", "t2"): 0.397765404, ("c", "t2"): 0.751373895, ("d", "t2"): 0.5},
    "consistency-method": {("a", "t1"): 0.603202847, ("b", "t1"): 0.247511391, ("c", "t1"): 0.136962140, ("d", "t1"): 0.25, ("a", "t2"): 0.136962140, ("b", "t2"): 0.196898483, ("c", "t2"): 0.567971530, ("d", "t2"): 0.25},
}


@pytest.mark.parametrize("method", list(WANT))
def test_diffusion(spark, method):
    edges = gr.canonical(spark.createDataFrame(EDGES, G))
    got = table(di.METHODS[method](edges, spark.createDataFrame(LABELS, S), tolerance=1e-11))
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in WANT[method].items()}


def test_diffusion_converges_or_is_solved_directly(spark, monkeypatch):
    b, none = spark.createDataFrame([("a", "t", 1.0)], S), spark.createDataFrame([], "protein_id string, k double")
    links = lambda w: spark.createDataFrame([("a", "b", w), ("b", "a", w)], "i string, j string, w double")
    got = table(di.propagate(links(0.5), b, none, tolerance=1e-8))
    assert got == {("a", "t"): pytest.approx(4 / 3, abs=1e-7), ("b", "t"): pytest.approx(2 / 3, abs=1e-7)}
    assert di.radius(links(0.5)) == pytest.approx(0.5)
    # rounds diverge, elimination does not
    assert table(di.propagate(links(4.0), b, none)) == {("a", "t"): pytest.approx(-1 / 15), ("b", "t"): pytest.approx(-4 / 15)}
    monkeypatch.setattr(di.direct, "__defaults__", (1,))
    with pytest.raises(ArithmeticError):
        di.propagate(links(4.0), b, none)


LONG = [(f"n{x:02}", f"n{x + 1:02}", 1.0 + x % 3) for x in range(39)] + [("x", "y", 2.0), ("n00", "n02", 0.5)]
MARKS = [("n00", "t1", 1.0), ("n20", "t1", 0.4), ("n39", "t2", 0.7), ("y", "t2", 0.3), ("z", "t1", 0.9)]


def spread_by(spark, monkeypatch, method, rounds=None, top=None):
    """Scores of a method on a long path, a pair and a lone protein, beside the links, labels and diagonal that were given to the rounds; no round may be written."""
    given, cut, propagate = {}, di.cut, di.propagate

    def whole(df, name="stage"):
        assert name != "round"
        return cut(df, name)

    def seen(links, b, diagonal, *a, **k):
        given.update(links=links.collect(), b=b.collect(), k=dict(map(tuple, diagonal.collect())))
        return propagate(links, b, diagonal, *a, **k)

    monkeypatch.setattr(di, "cut", whole)
    monkeypatch.setattr(di, "propagate", seen)
    got = table(di.METHODS[method](gr.canonical(spark.createDataFrame(LONG, G)), spark.createDataFrame(MARKS, S), rounds=rounds, tolerance=1e-12, top=top))
    names = sorted({x for e in LONG for x in e[:2]} | {"z"})
    at, want = {x: n for n, x in enumerate(names)}, {}
    m, k = np.zeros((len(names),) * 2), np.array([given["k"].get(x, 1.0) for x in names])
    for i, j, w in given["links"]:
        m[at[i], at[j]] += w / k[at[i]]
    for term in ("t1", "t2"):
        b = np.zeros(len(names))
        for protein, t, score in given["b"]:
            b[at[protein]] += score / k[at[protein]] if t == term else 0
        x, near = b, b != 0
        for _ in range(rounds or len(names)):
            x, near = b + m @ x, near | (m != 0) @ near
        if not rounds:
            x = np.linalg.solve(np.eye(len(names)) - m, b)
        want |= {(names[n], term): pytest.approx(x[n], abs=1e-11) for n in np.flatnonzero(near)}
    return got, want


def test_consistency_method_runs_in_blocks(spark, monkeypatch):
    got, want = spread_by(spark, monkeypatch, "consistency-method")
    assert got == want and len(got) == 83


def test_label_weighted_runs_in_blocks(spark, monkeypatch):
    got, want = spread_by(spark, monkeypatch, "label-weighted")
    assert got == want and len(got) == 83


def test_laplacian_runs_in_blocks(spark, monkeypatch):
    got, want = spread_by(spark, monkeypatch, "laplacian")
    assert got == want and len(got) == 83


def test_best_terms_are_found_in_the_blocks(spark, monkeypatch):
    """One term of each protein leaves its task, the same that a ranking of all gives; equal rounded scores go by the term."""
    got, want = spread_by(spark, monkeypatch, "laplacian", top=(1, 4))
    digits = lambda x: math.floor(x * 1e4 + 0.5) / 1e4
    best = lambda rows: {p: min((-digits(v), t) for (q, t), v in rows.items() if q == p) for p, _ in rows}
    assert best(got) == best({k: v.expected for k, v in want.items()}) and all(got[k] == pytest.approx(want[k].expected, abs=5.1e-5) for k in got)


def test_eight_rounds_of_the_consistency_method(spark, monkeypatch):
    """Only pairs within eight links of a label come out."""
    got, want = spread_by(spark, monkeypatch, "consistency-method", rounds=8)
    assert got == want and len(got) < 60


def test_eight_rounds_of_label_weighted(spark, monkeypatch):
    got, want = spread_by(spark, monkeypatch, "label-weighted", rounds=8)
    assert got == want and len(got) < 60


def test_eight_rounds_of_laplacian(spark, monkeypatch):
    got, want = spread_by(spark, monkeypatch, "laplacian", rounds=8)
    assert got == want and len(got) < 60


def test_blocks_of_terms(spark, monkeypatch):
    """Parts and terms that are solved apart give what one block gives."""
    pairs = [(*x, 0.1) for e in LONG for x in (e[:2], e[1::-1])]
    rows = lambda a: {(r["protein_id"], r["term_id"]): r["score"] for r in a}

    def run(rounds=None, top=None):
        g = blocks.graph(spark.createDataFrame(pairs, "i string, j string, w double"))
        assert 0.2 * (1 - 1e-9) <= g.radius < 0.3
        place = {r["protein_id"]: (r["part"], r["n"]) for r in g.places.to_pylist()}
        labels = [(*place[x], f"t{n}", 1.0) for n in range(11) for x in (["n00", "n39", "x"], ["n05"], ["y"])[n % 3]]
        batch = pa.RecordBatch.from_pylist([dict(zip(("part", "n", "term_id", "y"), x)) for x in labels])
        parts = type("Sent", (), {"value": g.parts})
        return len(g.parts), [r for x in blocks.solve(iter([batch]), parts, g.radius, rounds, 1e-12, top) for r in x.to_pylist()]

    one = [run(), run(8), run(8, (2, 4))]
    for name, value in {"SMALL": 1, "CELLS": 1, "WIDTH": 2, "GATHERED": 8, "ROWS": 1}.items():
        monkeypatch.setattr(blocks, name, value)
    many = [run(), run(8), run(8, (2, 4))]
    assert {x[0] for x in one} == {1} and {x[0] for x in many} == {2}
    assert all(len(a) == len(b) == len(rows(a)) and rows(b) == pytest.approx(rows(a), abs=1e-11) for (_, a), (_, b) in zip(one, many))
    best = {}
    for (protein, term), score in sorted(rows(one[1][1]).items(), key=lambda x: (-math.floor(x[1] * 1e4 + 0.5), x[0][1])):
        best.setdefault(protein, []).append((term, math.floor(score * 1e4 + 0.5) / 1e4))
    assert rows(one[2][1]) == {(p, t): v for p, x in best.items() for t, v in x[:2]}


@pytest.mark.parametrize("rounds", [8, None])
def test_scores_are_sent_by_blocks(spark, monkeypatch, rounds):
    """A row that leaves a task holds many pairs and each name once; taken apart, rows are the pairs reached."""
    pairs = [(*x, 0.1) for e in LONG for x in (e[:2], e[1::-1])]
    g = blocks.graph(spark.createDataFrame(pairs, "i string, j string, w double"))
    place = {r["protein_id"]: (r["part"], r["n"]) for r in g.places.to_pylist()}
    labels = [(*place[x], f"t{n:02}", 1.0) for n in range(11) for x in (["n00", "n39", "x"], ["n05"], ["y"])[n % 3]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("part", "n", "term_id", "y"), x)) for x in labels])
    parts = type("Sent", (), {"value": g.parts})
    run = lambda packed: [r for x in blocks.solve(iter([batch]), parts, g.radius, rounds, 1e-12, None, packed) for r in x.to_pylist()]
    for rows, width in ((131072, 256), (30, 4)):
        monkeypatch.setattr(blocks, "ROWS", rows)
        monkeypatch.setattr(blocks, "WIDTH", width)
        want = {(r["protein_id"], r["term_id"]): r["score"] for r in run(False)}
        sent = run(True)
        assert len(sent) < len(want) / 8 and all(len(r["scores"]) == len(r["proteins"]) * len(r["terms"]) for r in sent)
        got = blocks.unpacked(spark.createDataFrame(sent, ", ".join(f"{c} array<{t}>" for c, t in blocks.PACKED.items()))).collect()
        assert {(r.protein_id, r.term_id): r.score for r in got} == want and len(got) == len(want)


def unpacks(spark, method, rounds=None):
    """Whether the scores of a method come from its tasks as arrays."""
    df = di.METHODS[method](gr.canonical(spark.createDataFrame(LONG, G)), spark.createDataFrame(MARKS, S), rounds=rounds, tolerance=1e-12)
    sent = [x for x in df._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in x]
    return [all(f"{c}#" in x for c in blocks.PACKED) for x in sent]


def test_laplacian_sends_arrays(spark):
    assert unpacks(spark, "laplacian") == [True]


def test_label_weighted_k8_sends_arrays(spark):
    assert unpacks(spark, "label-weighted", 8) == [True]


def test_laplacian_k8_sends_arrays(spark):
    assert unpacks(spark, "laplacian", 8) == [True]


def test_rounds_are_single_and_refined(spark, monkeypatch):
    """Rounds move singles, the residual is double; each part has its own radius, and a small margin takes doubles."""
    pairs = lambda w: [(*x, w) for a, b, _ in LONG[:-2] for x in ((a, b), (b, a))] + [("x", "y", 0.9), ("y", "x", 0.9)]
    monkeypatch.setattr(blocks, "SMALL", 1)
    kinds, product = [], blocks.product
    monkeypatch.setattr(blocks, "product", lambda p, x, *a: (kinds.append(x.dtype.name), product(p, x, *a)))

    def run(w):
        kinds.clear()
        g = blocks.graph(spark.createDataFrame(pairs(w), "i string, j string, w double"))
        p = max(g.parts, key=lambda p: len(p.ids))
        m, b = np.zeros((40, 40)), np.zeros((40, 2))
        m[np.repeat(np.arange(40), np.diff(p.at)), p.ends] = p.weights
        b[3, 0], b[7, 1] = 1.0, 0.3
        assert np.abs(blocks.converged(p, b, g.radius, 1e-12) - np.linalg.solve(np.eye(40) - m, b)).max() < 1e-11
        return g.radius, p.radius, kinds.count("float32"), kinds.count("float64")

    whole, own, single, double = run(0.4)
    assert whole == pytest.approx(0.9) and own < 0.81 and single > 20 and 1 < double < 6
    assert run(0.499)[2] == 0


@pytest.mark.parametrize(("rounds", "digits"), [(8, 6), (None, 4)])
def test_scores_are_rounded_in_the_tasks(spark, monkeypatch, rounds, digits):
    """Arrays leave a task rounded, and the plan rounds the lone protein alone; a join rounds to the same."""
    even, edges, labels = lambda x: math.floor(x * 10.0**digits + 0.5) / 10.0**digits, gr.canonical(spark.createDataFrame(LONG, G)), spark.createDataFrame(MARKS, S)
    run = lambda **k: di.laplacian(edges, labels, rounds=rounds, tolerance=1e-12, **k)
    want, df = {k: even(v) for k, v in table(run()).items()}, run(digits=digits)
    assert table(df) == want and df._jdf.queryExecution().analyzed().toString().upper().count("FLOOR(") == 1
    monkeypatch.setattr(di, "SHIPPED", 0)
    assert {k: v for k, v in table(run(digits=digits)).items() if v} == {k: v for k, v in want.items() if v}


def path(monkeypatch):
    """A path of forty proteins, labels of two terms near its start, and the rows of each product."""
    m = np.zeros((40, 40))
    m[range(39), range(1, 40)] = m[range(1, 40), range(39)] = 0.2
    order = np.argsort((m > 0).sum(1), kind="stable")
    m = m[np.ix_(order, order)]
    i, j = np.nonzero(m)
    part = blocks.Part(pa.array([f"n{x}" for x in order]), np.zeros(40, np.int64), np.searchsorted(i, np.arange(41)), j, m[i, j], 0.4)
    b, sizes, product = np.zeros((40, 2)), [], blocks.product
    b[order == 3, 0], b[order == 5, 1] = 1.0, 0.3
    monkeypatch.setattr(blocks, "product", lambda p, x, out, then: (sizes.append(len(out)), product(p, x, out, then)))
    return part, m, b, sizes


def test_first_weighted_rounds_go_over_few_links(monkeypatch):
    part, m, b, sizes = path(monkeypatch)
    got, left = blocks.chebyshev(part, b, 0.4, 1e-13, 100)
    assert np.abs(got - np.linalg.solve(np.eye(40) - m, b)).max() < 1e-12 and left <= 1e-13
    assert sizes[:2] == [3, 7] and sizes[-1] == 40


def test_first_plain_rounds_go_over_few_links(monkeypatch):
    part, m, b, sizes = path(monkeypatch)
    want = b
    for r in range(9):
        assert np.abs(blocks.counted(part, b, r) - want).max() < 1e-15
        want = b + m @ want
    assert sizes[-8:-6] == [3, 7] and sizes[-1] == 40


def test_reached_pairs_end_when_all_are(monkeypatch):
    """Words of 64 terms go their rounds apart, none after all its pairs are reached."""
    part, m, _, _ = path(monkeypatch)
    n, t = np.array([3, 20, 39, *range(40)]), np.array([0, 70, 70, *[1] * 40])
    near = np.zeros((40, 71))
    near[n, t] = 1
    passes, reduce = [], np.bitwise_or
    monkeypatch.setattr(blocks.np, "bitwise_or", type("Or", (), {"reduceat": staticmethod(lambda x, at: (passes.append(x.ndim), reduce.reduceat(x, at))[1])}))
    for r in range(60):
        assert (blocks.reached(part, n, t, 71, r) == (near.T > 0)).all()
        near = near + (m > 0) @ near > 0
    passes.clear()
    blocks.reached(part, np.arange(40), np.zeros(40, np.int64), 1, 8)
    assert passes == []


def test_masked_jaccard(spark):
    got = table(di.masked_jaccard(gr.canonical(spark.createDataFrame(EDGES, G))))
    assert got == {("a", "b"): pytest.approx(0.8 * 0.472222222), ("b", "c"): pytest.approx(0.5 * 0.302083333), ("a", "c"): pytest.approx(0.2 * 0.205128205)}


OBO = """format-version: 1.2 ! x

[Term]
id: GO:0000001
name: root
namespace: biological_process

[Term]
id: GO:0000002
namespace: biological_process
alt_id: GO:0000009
is_a: GO:0000001 {source="x"} ! root

[Term]
id: GO:0000003
namespace: biological_process
is_a: GO:0000002
relationship: part_of GO:0000004 ! other

[Term]
id: GO:0000004
namespace: molecular_function

[Term]
id: GO:0000005
namespace: biological_process
is_a: GO:0000001
is_obsolete: true
"""


@pytest.mark.parametrize("tail", ["", "\n[Typedef]\nid: part_of\n"])
def test_ontology(spark, tmp_path, tail):
    (tmp_path / "o.obo").write_text(OBO + tail)
    terms, rels = rd.obo_terms(rd.obo_tags(spark, str(tmp_path / "o.obo")))
    assert terms.count() == 5 and rels.count() == 4
    links = hi.resolved_links(terms, rels)
    rows = on.resolve(spark.createDataFrame([("P1", "GO:0000003", 0.7), ("P2", "go:0000009", 0.4), ("P1", "GO:0000001", 0.2), ("P1", "GO:7777777", 1.0)], S), terms)
    same = on.up_propagate(rows, on.ancestors(terms, on.same_domain(links, terms)))
    want = {("P1", "GO:0000003"): 0.7, ("P1", "GO:0000002"): 0.7, ("P1", "GO:0000001"): 0.7, ("P2", "GO:0000002"): 0.4, ("P2", "GO:0000001"): 0.4}
    assert table(same) == want
    assert table(on.up_propagate(rows, on.ancestors(terms, links))) == want | {("P1", "GO:0000004"): 0.7}
    assert table(on.information_content(same)) == {("GO:0000003",): pytest.approx(2.321928095), ("GO:0000002",): pytest.approx(1.321928095), ("GO:0000001",): pytest.approx(1.321928095)}


def test_gate(spark):
    terms = spark.createDataFrame([("GO:1", "d", ["GO:9"], None), ("GO:2", "d", [], True)], "go_id string, go_namespace string, alt_id array<string>, is_obsolete boolean")
    rows = [("a", "EXP", None, "GO:1", "taxon:1"), ("b", "IEA", None, "GO:1", "taxon:1"), ("c", "IDA", "NOT", "GO:1", None), ("d", "IDA ", "enables|NOT", "go:9", ""), ("e", "IDA", None, "GO:5", None), ("f", "IDA", None, "GO:2", None), ("g", "IDA", None, "GO:1", "taxon:83333|taxon:1392")]
    goa = spark.createDataFrame(rows, "db_object_id string, evidence_code string, qualifier string, go_id string, taxon string")
    assert {r.protein_id for r in an.gaf_gate(goa, terms, blacklist=("1392",)).collect()} == {"a", "d"}


def test_homology(spark):
    rows = [("a", "b", 1e-20), ("b", "a", 1e-10), ("a", "c", 0.0), ("c", "a", 0.0), ("b", "c", 1e-5), ("c", "b", 1e-3), ("a", "a", 0.0)]
    edges, none = gr.homology(spark.createDataFrame(rows, "query string, subject string, evalue double"), default=True)
    assert table(edges) == {("a", "b"): pytest.approx(1.0), ("a", "c"): 1.0, ("b", "c"): pytest.approx(0.366022005)}
    assert none == pytest.approx(0.003748865, abs=1e-9)


def test_combination(spark):
    seed = [("a", "t1", 1.0), ("a", "t2", 0.5), ("b", "t1", 0.6), ("b", "t2", 0.3), ("b", "t3", 0.2), ("c", "t1", 0.1), ("c", "t2", 0.9), ("c", "t3", 0.7), ("d", "t3", 0.15)]
    binary = gr.binarised(spark.createDataFrame(seed, S))
    edges = spark.createDataFrame([("a", "b", 900.0, 400.0), ("b", "c", 300.0, 0.0), ("a", "c", 150.0, 0.0), ("c", "d", 0.0, 800.0)], "p1 string, p2 string, c1 double, c2 double")
    target = gr.seed_jaccard(gr.shared_pairs(binary), binary)
    # sets of two and two terms with one or two in common, with the one more in the denominator
    assert table(target) == {("a", "b"): pytest.approx(2 / 3), ("a", "c"): pytest.approx(0.25), ("b", "c"): pytest.approx(0.25)}
    scaled = gr.channel_norm(edges, ["c1", "c2"])
    coef = gr.coefficients(scaled, target, ["c1", "c2"], 4)
    assert list(coef) == [pytest.approx(x, abs=1e-7) for x in (0.66223404, -0.04698582, 0.04063239)]
    assert table(gr.combined(scaled, ["c1", "c2"], coef))["c", "d"] == pytest.approx(-0.046985816)


def test_combination_counts_pairs_without_edge(spark):
    # a and c share both terms and e and f their one, but only a-b and c-d have an edge
    seed = [("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t1"), ("c", "t2"), ("d", "t4"), ("e", "t3"), ("f", "t3")]
    binary = spark.createDataFrame(seed, "protein_id string, term_id string")
    every = gr.seed_jaccard(gr.shared_pairs(binary), binary)
    assert gr.jaccard_total(binary) == pytest.approx(2 / 3 + 2 * (1 / 3) + 1 / 2)
    assert gr.jaccard_total(binary) == pytest.approx(sum(table(every).values()))
    assert gr.jaccard_total(binary.limit(0)) == 0.0
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 0.5)], "p1 string, p2 string, c1 double")
    got = gr.coefficients(edges, gr.seed_jaccard(edges, binary), ["c1"], 6, gr.jaccard_total(binary))
    assert list(got) == [pytest.approx(x) for x in gr.coefficients(edges, every, ["c1"], 6)]
    assert abs(got[1] - gr.coefficients(edges, gr.seed_jaccard(edges, binary), ["c1"], 6)[1]) > 0.05


def test_combine_command_counts_the_index(spark, tmp_path):
    (tmp_path / "p.fa").write_text("".join(f">{x}\nMK\n" for x in "abcdefgh"))
    (tmp_path / "s.tsv").write_text("".join(f"{p}\t{t}\t1.0\n" for p, t in ("a1", "b1", "c1", "c2", "e2", "z1")))
    (tmp_path / "c.tsv").write_text("protein1\tprotein2\tx\na\tb\t2.0\nc\td\t1.0\na\tz\t9.0\n")
    args = ["combine", "--collection", str(tmp_path / "c.tsv"), "--seed", str(tmp_path / "s.tsv"), "--fasta", str(tmp_path / "p.fa")]
    cli.main([*args, "--output", str(tmp_path / "o")])
    # x = 1 and 0.5, y = 1/2 for a-b; 28 pairs with y = 1/2 + 3 * (1/3) - the z outside of the index has no pair
    y = 1 / 2 + 3 * (1 / 3)
    c = (0.5 - 1.5 * y / 28) / (1.25 - 1.5 * 1.5 / 28)
    assert {tuple(r)[:2]: r[2] for r in rd.graph(spark, str(tmp_path / "o")).collect()} == {("a", "b"): pytest.approx(c), ("c", "d"): pytest.approx(c / 2)}


def test_metrics(spark):
    pred = [("p", f"t{i}", s) for i, s in enumerate([0.9, 0.8, 0.8, 0.3, 0.0, 0.0])]
    truth = spark.createDataFrame([("p", "t0"), ("p", "t2"), ("p", "t5")], "protein_id string, term_id string")
    ic = spark.createDataFrame([(f"t{i}", float(x)) for i, x in enumerate([1, 2, 3, 1, 2, 1])], "term_id string, ic double")
    for rows in (pred, pred[:4] + [("p", "t4", 0.0)]):
        df = spark.createDataFrame(rows, S)
        m = ev.metrics(ev.curve(ev.cells(df, truth, ic, "protein_id"))).collect()[0]
        assert [m.auc, m.aupr, m.f_max, m.jaccard, m.p_at_20, m.s_min] == [pytest.approx(x, abs=1e-6) for x in (2 / 3, 4 / 9, 2 / 3, 0.5, 1.0, 0.372678)]


def test_ranked_gain_properties(spark):
    rows = [("perfect", f"i{k}", 1.0 - k / 10, int(k < 2)) for k in range(5)] + [("worst", f"i{k}", k / 10, int(k < 2)) for k in range(5)] + [("none", "i", 0.5, 0)]
    got = {r.entity: r for r in ev.ranked_gain(ev.listed_ranks(spark.createDataFrame(rows, "entity string, item string, score double, y int")), 3).collect()}
    assert got["perfect"].ndcg == 1.0 and got["perfect"].ap_at_k == 1.0 and got["worst"].ndcg < 1 and got["none"].ndcg == 0.0
    assert got["perfect"].p_at_k == pytest.approx(2 / 3)


def test_grid_ranks_and_rounding(spark):
    pred = spark.createDataFrame([("p", "t1", 0.9), ("p", "t4", 0.2), ("q", "t1", 0.12344)], S)
    truth = spark.createDataFrame([("p", "t2"), ("p", "t4"), ("q", "t3")], "protein_id string, term_id string")
    got = {(r.entity, r.item): (r.rn, r.best) for r in ev.grid_ranks(pred, truth).filter("y = 1").collect()}
    # p: t1 t4 | t3 t2; q: t1 | t4 t3 t2
    assert got == {("p", "t4"): (2, 1), ("p", "t2"): (4, 2), ("q", "t3"): (3, 1)}
    assert {r.score for r in ev.reduced(pred, 3).collect()} == {0.9, 0.2, 0.12344}
    assert {r.score for r in ev.reduced(pred, 2).collect()} == {0.9, 0.2, 0.1234}
    m = ev.metrics(ev.curve(ev.cells(pred, truth, truth.select("term_id").distinct().selectExpr("term_id", "1.0D AS ic"))))
    assert {r.method for r in ev.labelled(ev.flattened({"I": m, "H": m}), {"I": "domains"}).collect()} == {"domains", "H"}


def test_best_hits(spark):
    h = "query string, target string, evalue double, row_no long, pident double"
    f = spark.createDataFrame([("x", "A", 1e-30, 1, 90.0), ("x", "B", 1e-10, 2, 50.0), ("y", "B", 1e-5, 3, 50.0), ("y", "C", 1e-5, 4, 40.0)], h)
    b = spark.createDataFrame([("A", "x", 1e-28, 1, 90.0), ("B", "x", 1e-9, 2, 50.0), ("C", "y", 1e-4, 3, 40.0)], h)
    assert {(r.query, r.target) for r in ot.reciprocal(ot.best_hits(f), ot.best_hits(b)).collect()} == {("x", "A"), ("y", "C")}
    assert {r.target for r in ot.best_hits(f, as_text=True).filter("query = 'x'").collect()} == {"B"}


def test_seeds(spark):
    a, b = spark.createDataFrame([("p", "t1", 1.0), ("p", "t2", 0.5)], S), spark.createDataFrame([("p", "t2", 1.0), ("q", "t1", 0.2)], S)
    blend = co.weighted_sum([a, b], [0.9, 0.1])
    assert table(blend) == {("p", "t1"): pytest.approx(0.9), ("p", "t2"): pytest.approx(0.55), ("q", "t1"): pytest.approx(0.02)}
    tied = co.clamp(blend, spark.createDataFrame([("p", "t2", 1.0), ("q", "t3", 1.0)], S))
    assert {(r.protein_id, r.term_id) for r in co.top_n(tied, 1).collect()} == {("p", "t2"), ("q", "t3")}


def test_structural(spark):
    row = lambda t, n, q=80: ("Q", t, 1e-9, 1, q, 1, 80, 100, 100, 0.6, 0.6, n)
    rows = [row("T1", 1), row("T1", 2), row("T2", 3, 60), row("T3", 4), row("T4", 5), ("R", "T1", 1e-9, 1, 80, 1, 80, 100, 100, None, None, 6)]
    hits = spark.createDataFrame(rows, "query string, target string, evalue double, qstart int, qend int, tstart int, tend int, qlen int, tlen int, qtmscore double, ttmscore double, row_no long")
    assert {(r.query, r.target) for r in st.select_hits(hits, top_k=2).collect()} == {("Q", "T1"), ("Q", "T3"), ("R", "T1")}


def test_files(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">sp|P12345|X y\nmk-l\nV1\n>b\nAA\n")
    assert {(r.name, r.seq) for r in rd.fasta(spark, str(tmp_path / "s.fa")).collect()} == {("sp|P12345|X", "MKLV"), ("b", "AA")}
    (tmp_path / "i.tsv").write_text("P1\tm\t1\tPfam" + "\t-" * 9 + "\tGO:0000003(x)|GO:0000002\nP1\tm\t1\tSEG" + "\t-" * 9 + "\tGO:1\nP2\tm\t1\tPfam\n")
    votes = an.method_vote(an.method_terms(rd.interproscan(spark, str(tmp_path / "i.tsv"))))
    assert table(votes) == {("P1", "GO:0000003"): 1.0, ("P1", "GO:0000002"): 1.0}
    (tmp_path / "l.txt").write_text("protein1 protein2 experiments\n9.a 9.b 700\n9.b 9.a x\n")
    assert {(r.organism_id, r.experiments) for r in rd.string_links(spark, str(tmp_path / "l.txt")).collect()} == {("9", 700), ("9", None)}
    (tmp_path / "e.tsv").write_text("q\tt\t1e-9\tGO:1\tGO:2\nq\tt\t1\n")
    rows = rd.evalue_file(spark, str(tmp_path / "e.tsv"))
    assert rows.count() == 2
    sk.write_evalues(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0].split("\t")[3:] == ["GO:1", "GO:2"]
    made = []
    for _ in range(2):
        assert sk.stage(spark, str(tmp_path), "x", {"a": 1}, lambda: made.append(1) or rows).count() == 2
    assert made == [1]


def test_top_predictions_command(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("p\tt1\t0.5\np\tt2\t0.9\np\tt0\t0.9\nq\tt1\t0.1\n")
    cli.main(["top-predictions", "--prediction-file", str(tmp_path / "p.tsv"), "--N", "1", "--output", str(tmp_path / "o")])
    assert {tuple(r)[:2] for r in rd.scores(spark, str(tmp_path / "o")).collect()} == {("p", "t0"), ("q", "t1")}


def test_numbered(spark):
    got = rd.numbered(spark.createDataFrame([(x,) for x in "dbacb"], "id string"), "id").collect()
    assert {r.id: r.idx for r in got} == {"a": 0, "b": 1, "c": 2, "d": 3}


GAF_LINE = "DB\t{0}\tS\t\t{1}\tR\tIDA\t\tP\tn\t\tprotein\ttaxon:1\t20200101\tX\t\t"


def test_predict_command(spark, tmp_path):
    (tmp_path / "p.fa").write_text("".join(f">{x}\nMK\n" for x in "abcd"))
    (tmp_path / "o.obo").write_text(OBO)
    (tmp_path / "i.tsv").write_text("a\tm\t1\tPfam" + "\t-" * 9 + "\tGO:0000003\nb\tm\t1\tPfam" + "\t-" * 9 + "\tGO:0000002\n")
    (tmp_path / "t.tbl").write_text("# c\nsp|T1|x - c - 1e-9 2 3 .5 1. 1 1 1 1 1 1 1 1 1 words\nsp|T1|x - d - 1 2 3 .5 1. 1 1 1 1 1 1 1 1 1 words\n")
    (tmp_path / "g.gaf").write_text("!v\n" + GAF_LINE.format("T1", "GO:0000002") + "\nbroken\n")
    (tmp_path / "l.txt").write_text("protein1 protein2 x y\n9.A 9.B 700 1\n9.B 9.A 700 0\n9.B 9.C 300 5\n8.A 8.B 900 9\n")
    orth = [("9", q, f"9.{q.upper()}", 1e-9, 90.0, 90.0, 70.0) for q in "abc"] + [("8", q, f"8.{q.upper()}", 1e-9, 90.0, 90.0, 70.0) for q in "abc"]
    spark.createDataFrame(orth, "organism_id string, query string, target string, query_evalue double, query_perc double, target_perc double, pos double").write.parquet(str(tmp_path / "orth"))
    (tmp_path / "bl").write_text("8\n")
    f = lambda n: str(tmp_path / n)
    cli.main(["transfer", "--links", f("l.txt"), "--orthologs", f("orth"), "--blacklist", f("bl"), "--output", f("edges")])
    assert {tuple(r) for r in spark.read.csv(f("edges"), sep="\t", header=True).collect()} == {("a", "b", "1400", "1"), ("b", "c", "300", "5")}
    (tmp_path / "run.ini").write_text(f"[run]\nfasta = {f('p.fa')}\nobo = {f('o.obo')}\nlinks = {f('l.txt')}\northologs = {f('orth')}\ntransfer_blacklist = {f('bl')}\n")
    cli.main(["predict", "--folder", f("run"), "--run-config", f("run.ini"), "--domains", f("i.tsv"), "--hmmer", f("t.tbl"), "--gaf", f("g.gaf"), "--output", f("out")])
    got = table(rd.scores(spark, f("out")))
    # the domain search votes for terms below and above; c has its seed from the profile search, d has none
    assert got["a", "GO:0000003"] > got["b", "GO:0000003"] > 0 and got["b", "GO:0000001"] > 0 and 0 < got["c", "GO:0000002"]
    assert not any(p == "d" for p, _ in got)
    cli.main(["extract-seeds", "--folder", f("run"), "--output", f("seeds")])
    assert {(r.protein_id, r.term_id) for r in rd.scores(spark, f("seeds/seed-profiles")).collect()} == {("c", "GO:0000002"), ("c", "GO:0000001")}
    cli.main(["filter", "--gaf", f("g.gaf"), "--fasta", f("p.fa"), "--output", f("few")])
    assert spark.read.text(f("few/gaf")).collect()[0][0].rstrip() == GAF_LINE.format("T1", "GO:0000002").rstrip() and spark.read.text(f("few/rejected")).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["predict", "--folder", f("run"), "--output", f("out")])


def test_long_evalue_lines(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("q\tt\t1e-9\t" + "\t".join(f"GO:{i}" for i in range(150_000)) + "\n")
    assert rd.evalue_file(spark, str(tmp_path / "e.tsv")).count() == 150_000


def test_small_helpers(spark):
    from pyspark.sql import functions as F

    from funweave.functions import ids

    df = spark.createDataFrame([("Xus yus (strain 1) ATCC 7", 0.000123, "a")], "n string, v double, k string")
    got = df.select(ids.before_marks(F.col("n"), ("(", "ATCC")), ids.number_text(F.col("v"), "%.2e"), ids.looked_up(F.create_map(F.lit("a"), F.lit("b")), F.col("k")), ids.looked_up(F.create_map(F.lit("z"), F.lit("b")), F.col("k"), "-")).collect()[0]
    assert tuple(got) == ("Xus yus", "1.23e-04", "b", "-")
    rows = spark.createDataFrame([(f"AF-{'P12345'}-F1.pdb",), ("sp|Q9XYZ1|N",), ("x P0A7B8 y",), ("none",)], "t string")
    assert [r[0] for r in rows.select(ids.any_accession(F.col("t"))).collect()] == ["P12345", "Q9XYZ1", "P0A7B8", None]


def circle(spark, monkeypatch, run, weight, k, y):
    """Scores over 1,000,800 links of 125,100 proteins in a circle, each with the four on either side at these distances, and one labelled;
    the same by shifts of an array; the names of what was written."""
    from pyspark.sql import functions as F

    n, far, names, cut = 125_100, (1, 7, 50, 301), [], di.cut
    monkeypatch.setattr(di, "cut", lambda df, name="stage": (names.append(name), cut(df, name))[1])
    name = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 6, "0"))
    rows = spark.range(n).select("id", F.explode(F.array(*map(F.lit, far))).alias("d"))
    edges = gr.canonical(rows.select(name(F.col("id")).alias("p1"), name((F.col("id") + F.col("d")) % n).alias("p2"), F.lit(1.0).alias("score")))
    got = run(edges, spark.createDataFrame([("p000000", "t", 1.0)], S)).toArrow()
    x, b, at = np.zeros(n), np.zeros(n), np.array([int(v[1:]) for v in got["protein_id"].to_pylist()])
    b[0], k = y, np.r_[k[0], np.full(n - 1, k[1])]
    x = b / k
    for _ in range(60 if len(got) == n else 8):
        x = (b + weight * sum(np.roll(x, s * d) for d in far for s in (1, -1))) / k
    return dict(zip(at, got["score"].to_pylist())), x, names


def test_consistency_method_of_a_million_links_writes_no_round(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.consistency(e, s, digits=4), 0.5 / 8, (1, 1), 0.5)
    assert len(got) == 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-4 and "round" not in names


def test_laplacian_of_a_million_links_writes_no_round(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.laplacian(e, s, digits=4), 0.1 / 8, (1.1, 1.1), 1.0)
    assert len(got) == 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-4 and "round" not in names


def test_best_terms_of_a_million_links_write_no_round(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.laplacian(e, s, top=(5, 4), digits=4), 0.1 / 8, (1.1, 1.1), 1.0)
    assert len(got) == 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-4 and "round" not in names


def test_eight_rounds_of_consistency_method_over_a_million_links_write_none(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.consistency(e, s, rounds=8, digits=6), 0.5 / 8, (1, 1), 0.5)
    assert 1000 < len(got) < 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-6 and "round" not in names


def test_eight_rounds_of_label_weighted_over_a_million_links_write_none(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.label_weighted(e, s, rounds=8, digits=6), 1 / 8, (2.1, 1.1), 1.1)
    assert 1000 < len(got) < 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-6 and "round" not in names


def test_eight_rounds_of_laplacian_over_a_million_links_write_none(spark, monkeypatch):
    got, want, names = circle(spark, monkeypatch, lambda e, s: di.laplacian(e, s, rounds=8, digits=6), 0.1 / 8, (1.1, 1.1), 1.0)
    assert 1000 < len(got) < 125_100 and max(abs(want[i] - v) for i, v in got.items()) < 0.51e-6 and "round" not in names
