"""Problems 1, 2, 3 and 7 against brute force on small fixtures, with nulls, ties, repeats, empty and clashing input."""

import random
import re

import pytest

from funweave.operators import heavy_keys, hierarchy as hi, multivalue as mv, strict_load as sl

TERMS = "go_id string, term_name string, go_namespace string, alt_id array<string>, is_obsolete boolean"
RELS = "go_id string, relation string, related_id string"


def graph(spark, n, pairs):
    terms = spark.createDataFrame([(f"GO:{i:07d}", None, None, [f"GO:9{i:06d}"], None) for i in range(n)], TERMS)
    rels = [(f"GO:{a:07d}", "is_a", f" go:{b:07d} ! x") for a, b in pairs] + [("GO:0000001", "regulates", "GO:0000001"), ("GO:0000001", "is_a", None), (None, None, None), ("GO:0000001", "is_a", "GO:8888888")]
    return terms, spark.createDataFrame(rels * 2, RELS)


def brute_reach(n, pairs):
    up = {i: {b for a, b in pairs if a == i} for i in range(n)}
    out = {}
    for i in range(n):
        seen, todo = set(), list(up[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        out[i] = seen
    return out


@pytest.mark.parametrize("tail", [2_000_000, 0])
def test_loops_and_descendants(spark, tail):
    rng = random.Random(5)
    n = 14
    pairs = {(rng.randrange(1, n), rng.randrange(n)) for _ in range(15)} | {(3, 3), (7, 8), (8, 9), (9, 7)}
    terms, rels = graph(spark, n, pairs)
    reach = brute_reach(n, pairs)
    got = {int(r[0][3:]) for r in hi.loop_terms(terms, rels, tail).collect()}
    assert got == {i for i in range(n) if i in reach[i]}
    good = {(a, b) for a, b in pairs if a not in reach[b] and a != b}
    occ = hi.occurrences(terms, rels, tail).cache()
    below = {(int(r.go_id[3:]), int(r.descendant[3:])) for r in hi.descendants(occ, block=2).collect()}
    assert below == {(b, a) for a in range(n) for b in brute_reach(n, good)[a]}
    assert all(r.path[-1] == r.go_id and r.path[0] == r.root and len(r.path) == r.depth + 1 for r in occ.collect())
    assert {r.go_id for r in occ.collect()} == {f"GO:{i:07d}" for i in range(n)}


def test_sizes_are_exact_until_they_are_full(spark):
    """A ladder of diamonds has 2^n paths: 56 are counted exactly, 70 raise on unfolding but still show their loops."""
    def ladder(n):
        return [p for k in range(n) for p in ((3 * k + 1, 3 * k), (3 * k + 2, 3 * k), (3 * k + 3, 3 * k + 1), (3 * k + 3, 3 * k + 2))]

    terms, rels = graph(spark, 169, set(ladder(56)))
    nodes, links = terms.selectExpr("go_id AS term"), hi.resolved_links(terms, rels)
    for bulk in (True, False):
        sizes, rest = hi.subtree_sizes(nodes, links, bulk=bulk)
        assert sizes.filter("term = 'GO:0000000'").collect()[0]["size"] == 4 * 2**56 - 3 and rest.count() == 0
    terms, rels = graph(spark, 212, set(ladder(70)) | {(211, 211)})
    with pytest.raises(OverflowError):
        hi.occurrences(terms, rels)
    assert {r.go_id for r in hi.loop_terms(terms, rels).collect()} == {"GO:0000211"}
    assert hi.closure(hi.acyclic(terms.selectExpr("go_id AS term"), hi.resolved_links(terms, rels))).count() == sum(len(x) for x in brute_reach(212, set(ladder(70))).values())


def test_alternate_ids_and_empty(spark):
    terms, rels = graph(spark, 2, set())
    extra = spark.createDataFrame([("GO:0000000", "is_a", "go:9000001"), ("GO:0000001", "part_of", "GO:9000000 {x=\"y\"}")], RELS)
    assert hi.loop_terms(terms, rels.union(extra)).count() == 2
    assert hi.loop_terms(terms.limit(0), rels.limit(0)).count() == 0
    assert hi.occurrences(terms.limit(0), rels.limit(0)).count() == 0


def brute_split(cell, field):
    """Values of a cell, read character by character."""
    seps = "|;," if field == "synonyms" else "|;, \t\n\r"
    out, cur, i = [], "", 0
    while i < len(cell):
        c = cell[i]
        q = re.match(r'"(?:[^"]|"")*"', cell[i:]) if c == '"' else None
        if q:
            cur += q[0]
            i += len(q[0])
            continue
        if c == "\\" and i + 1 < len(cell):
            cur += cell[i : i + 2]
            i += 2
            continue
        if c in seps and not (field == "synonyms" and c == "," and 0 < i < len(cell) - 1 and cell[i - 1] in "0123456789" and cell[i + 1] in "0123456789"):
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)
    items = []
    for x in out:
        x = x.strip(" \t\r\n")
        x = x[1:-1].replace('""', '"').strip(" \t\r\n") if re.fullmatch(r'"(?:[^"]|"")*"', x) else re.sub(r"\\(.)", r"\1", x, flags=re.S)
        items += [x] * bool(x)
    return items


CELLS = [None, "", "  ", "a", "a|b", '"a|b"', '"a|b"|c', 'a\\|b;c', "1,4-x, 2,3-y", 'x "q ""in"" z", y', "||a||", 'un"closed|b', "0|b", '"a""b";c', "a b", "x" * 5000 + "|y", "\\", '""|a']


def test_split(spark):
    rows = [(i, c, c, c, "clash") for i, c in enumerate(CELLS)]
    df = spark.createDataFrame(rows, "goa_id long, taxon string, with_from string, synonyms string, pos string")
    got = {}
    for r in mv.split_fields(df).collect():
        got.setdefault((r.goa_id, r.field_name), []).append((r.pos, r.item))
    for i, c in enumerate(CELLS):
        for f in mv.FIELDS:
            want = brute_split(c, f) if c is not None else []
            want = list(enumerate(want, 1)) if len(want) > 1 else []
            assert sorted(got.get((i, f), [])) == want, (c, f)


def test_split_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/goa.parquet")
    got = {(r.goa_id, r.field_name, r.pos, r.item) for r in mv.split_fields(df).collect()}
    want = set()
    for r in df.collect():
        for f in mv.FIELDS:
            items = brute_split(r[f], f) if r[f] else []
            want |= {(r.goa_id, f, i, x) for i, x in enumerate(items, 1)} if len(items) > 1 else set()
    assert got == want


def test_heavy_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["P1", "P2", "P3", None]), rng.choice([" go:1", "GO:1 ", "GO:1", "GO:2", None, ""]), rng.choice(["taxon:5|taxon:5", '"taxon:7"', "5 7", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "goa_id long, db_object_id string, go_id string, taxon string").repartition(7)
    want = {}
    for i, p, g, t in rows:
        for k in [("go_id", (g or "").strip().upper())] * bool(g) + [("taxon", x) for x in set(re.findall("[0-9]", t or ""))]:
            n, m = want.setdefault(k, [0, set()])
            want[k] = [n + 1, m | ({p} - {None})]
    got = {(r.field_name, r.key_text): (r.n_rows, r.n_members) for r in heavy_keys.key_stats(df).collect()}
    assert got == {k: (n, len(m)) for k, (n, m) in want.items()}
    assert heavy_keys.heavy_keys(df.limit(0)).count() == 0
    assert ("go_id", "GO:2") in {tuple(r) for r in heavy_keys.heavy_keys(df).collect()}


GAF = ["DB", "P1", "S", "", "GO:0000001", "R", "IDA", "", "P", "n", "", "protein", "taxon:1", "20200229", "X", "", ""]
TBL = "t - q - 1e-5 2 3 .5 1. 1 1 1 1 1 1 1 1 1 some words"


def swap(i, v):
    return "\t".join(v if k == i - 1 else x for k, x in enumerate(GAF))


LINES = [
    ("gaf", swap(1, "DB"), None), ("gaf", swap(1, "DB") + "\r", None), ("gaf", "\t".join(GAF[:16]), "columns"), ("gaf", "!c", "skip"), ("gaf", " ", "skip"), ("gaf", None, "skip"),
    ("gaf", swap(10, '"a'), "quoting"), ("gaf", swap(10, '"a ""b"" c"'), None), ("gaf", swap(10, '"a"b'), "quoting"), ("gaf", swap(10, 'a"b'), None), ("gaf", swap(10, '"'), "quoting"),
    ("gaf", swap(5, "GO:000001"), "invalid"), ("gaf", swap(7, "ida"), "invalid"), ("gaf", swap(9, "X"), "invalid"), ("gaf", swap(14, "20190229"), "invalid"), ("gaf", swap(14, "20201301"), "invalid"), ("gaf", swap(14, "2020010"), "invalid"),
    ("tblout", TBL, None), ("tblout", "  " + TBL.replace(" ", " \t "), None), ("tblout", "# c", "skip"), ("tblout", TBL.rsplit(" ", 2)[0].replace(" 1e-5", ""), "columns"), ("tblout", TBL.replace("1e-5", "-1e-5"), "invalid"),
    ("tblout", TBL.replace(" 2 ", " nan "), "invalid"), ("tblout", TBL.replace(" 2 ", " -2 "), None), ("tblout", TBL.replace(" 2 ", " 2,5 "), "invalid"), ("tblout", "a b", "columns"), ("tblout", TBL.replace(" 2 ", " ٣ "), "invalid"),
    ("other", "x", "kind"),
]


def test_strict_load(spark):
    df = spark.createDataFrame([(i, k, "f", i, t, "clash") for i, (k, t, _) in enumerate(LINES)], "line_id long, file_kind string, file_name string, line_no int, line_text string, reason string")
    got = {r.line_id: r.reason for r in sl.rejected(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(LINES) if w not in (None, "skip")}
    loaded = sl.load_gaf(df).count() + sl.load_tblout(df).count()
    assert loaded == sum(w is None for *_, w in LINES)
    assert sl.rejected(df.limit(0)).count() == 0
