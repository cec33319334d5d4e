"""Each operator on small inputs: nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names; and against brute force."""

import math
import random
from collections import Counter
from datetime import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.test_queries import check_pieces
from weft.llm import chunking, cooccur, distinctive, docpairs, handwritten, leakage, neighbors, packing, tokens


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ---- items that appear together

def test_cooccurrence(spark):
    data = [("b1", "x/a", 1), ("b1", "x/a", 1), ("b1", "x/b", 1), ("b2", "x/a", 1), ("b2", "x/b", 1), ("b3", "x/a", 1), ("b3", "y/c", 1), (None, "x/a", 1), ("b4", None, 1), ("b5", "x/b", 1)] + [("wide", f"x/{i}", 1) for i in range(30)] + [("wide", "x/a", 1), ("wide", "x/b", 1)]
    df = spark.createDataFrame(data, "sha string, path string, item int")
    pairs = cooccur.baskets(df, F.col("sha"), F.col("path"), 25)
    out = cooccur.co_occurrence(pairs, F.substring_index("item", "/", 1)).collect()
    assert [(r.item_a, r.item_b, r.together, r.n_a, r.n_b, r.n_baskets) for r in out] == [("x/a", "x/b", 2, 3, 3, 4)]
    assert math.isclose(out[0].lift, 2 * 4 / 9) and math.isclose(out[0].pmi, math.log2(8 / 9))
    assert {(r.item_a, r.item_b) for r in cooccur.co_occurrence(pairs).collect()} == {("x/a", "x/b"), ("x/a", "y/c")}
    assert cooccur.co_occurrence(cooccur.baskets(df, F.col("sha"), F.col("path"), None)).count() == 2 + 32 * 31 // 2 - 1
    assert cooccur.co_occurrence(cooccur.baskets(df.limit(0), F.col("sha"), F.col("path"), 25)).count() == 0


def test_cooccurrence_brute_force(spark):
    rng = random.Random(1)
    data = [(f"s{rng.randint(0, 60)}", rng.choice("abcdefgh")) for _ in range(400)]
    out = cooccur.co_occurrence(cooccur.baskets(spark.createDataFrame(data, "s string, i string"), F.col("s"), F.col("i"), 25))
    sets = {}
    for s, i in data:
        sets.setdefault(s, set()).add(i)
    want = Counter((a, b) for x in sets.values() for a in x for b in x if a < b)
    assert {(r.item_a, r.item_b): r.together for r in out.collect()} == dict(want)


def test_large_baskets(spark, monkeypatch):
    """Baskets dealt out into several arrays give the same pairs as one array."""
    rng = random.Random(7)
    data = [(f"s{k}", f"i{rng.randint(0, 60):02d}") for k, n in enumerate((2, 5, 40, 90, 1)) for _ in range(n)]
    df = spark.createDataFrame(data, "s string, i string")
    run = lambda: rows(cooccur.co_occurrence(cooccur.baskets(df, F.col("s"), F.col("i"), None)), "item_a", "item_b", "together", "n_a", "n_b")
    whole = run()
    monkeypatch.setattr(cooccur, "ARRAY_ITEMS", 4)
    assert run() == whole and len(whole) > 500 and all(r[0] < r[1] for r in whole)


def test_paths(spark):
    df = spark.createDataFrame([("a\\b//c",), ("./a",), (".//a",), ("../a",), (None,), (".git/x",)], "p string")
    assert [r[0] for r in df.select(cooccur.tidy_path(F.col("p"))).collect()] == ["a/b/c", "a", "a", "../a", None, ".git/x"]


# ---- distinctive terms

def test_terms(spark):
    df = spark.createDataFrame([("parseHTTPCode2Fast été_x ÉcoleÉlan 123 a1b no ok_Yes",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(distinctive.terms(F.coalesce("t", F.lit("")))).collect()]
    assert got[0] == ["parse", "httpcode2", "fast", "été", "école", "élan", "a1b", "yes"] and got[1] == got[2] == []


def test_latest(spark):
    df = spark.createDataFrame([("a", None, "old"), ("a", dt(2025, 1, 1), "new"), ("b", None, None), (None, dt(2025, 1, 1), "x"), ("c", dt(2025, 1, 1), "t1"), ("c", dt(2025, 1, 1), "t2"), ("c", dt(2025, 1, 1), "t2")], "id string, at timestamp, name string")
    assert rows(distinctive.latest(df, "id", "at", ["name"]), "id", "name") == [("a", "new"), ("b", None), ("c", "t2")]


def test_log_odds(spark):
    data = [("n1", "alpha alpha beta common", "x", 1), ("n2", "alpha gamma common common", None, 2), ("n3", None, "", 3), (None, "alpha", "alpha", 4), ("n4", "delta common " + "long " * 30000, None, 5)]
    df = spark.createDataFrame(data, "id string, name string, summary string, term int")
    out = {(r.id, r.term): r for r in distinctive.log_odds(df, "id", ["name", "summary"]).collect()}
    assert out["n1", "alpha"].tf == 2 and out["n1", "alpha"].df == 2 and out["n4", "long"].tf == 30000
    counts = {k: Counter((a or "").split() + (b or "").split()) for k, a, b, _ in data if k}
    total = Counter()
    for c in counts.values():
        for t, n in c.items():
            if len(t) > 2:
                total[t] += n
    big = sum(total.values())

    def z(k, t):
        c = {w: n for w, n in counts[k].items() if len(w) > 2}
        y, n, alpha, prior = c[t], sum(c.values()), 1000.0 * total[t] / big, 1000.0
        rest, n_rest = total[t] - y, big - n
        d = math.log((y + alpha) / (n + prior - y - alpha)) - math.log((rest + alpha) / (n_rest + prior - rest - alpha))
        return d / math.sqrt(1 / (y + alpha) + 1 / (rest + alpha))

    assert all(math.isclose(r.z, z(*k), rel_tol=1e-9) for k, r in out.items())
    assert out["n1", "alpha"].z > out["n1", "common"].z
    assert rows(distinctive.log_odds(df, "id", ["name", "summary"], min_tf=2, min_df=2, max_df=2), "id", "term") == [("n1", "alpha")]
    assert distinctive.log_odds(df.limit(0), "id", ["name"]).count() == 0


# ---- source files not written by hand

BODY = "\n\n".join(f"def function_{i}(value, other):\n    result_{i} = value * {i} + other\n    return result_{i} - value" for i in range(6))
HAND = "\n\n".join(f"def own_{i}(thing):\n    made = build_{i}(thing)\n    return made or thing" for i in range(3))


def test_handwritten(spark):
    patched = BODY.replace("value * 3", "value * 3000")
    minified = "!function(){" + "var a=b(c);if(a){d(a)};" * 60 + "}();"
    table = "T = [\n" + "\n".join("    " + ", ".join(f"{i}.{j}5" for j in range(8)) + "," for i in range(40)) + "\n]\n"
    data = [("p/lib/a.py", BODY), ("q/util/b.py", "# MIT\n\n" + patched.replace("\n", "\r\n")), ("r/x/c.py", BODY.replace("def", "  def")), ("p/src/own.py", HAND), ("p/src/own.py", HAND), ("p/src/other.py", HAND),
            ("p/a/gen.py", "# Code generated by tool. DO NOT EDIT.\n" + HAND.replace("own", "g1")), ("p/a/not.py", "# Not generated: please edit this file directly.\n" + HAND.replace("own", "g2")), ("p/a/emit.py", HAND.replace("own", "g3") + '\nBANNER = "# Code generated by this tool. DO NOT EDIT."\n'),
            ("p/a/tail.js", HAND.replace("own", "g4") + "\n// end of generated code; rebuild with `x`\n"), ("p/web/m.js", minified), ("p/web/one.js", "let a = 1;\n" + HAND.replace("own", "g5") + "\nlet b = " + " + ".join(f"part{i}" for i in range(110)) + ";\n"), ("p/d/t.py", table),
            ("p/vendor/lib/v.py", None), ("p/vendor/own.py", "# Part of p. Internal code, see NOTICE.\n" + HAND.replace("own", "g6")), ("p/node_modules/k/i.js", ""), ("p/empty.py", ""), ("p/null.py", None), (None, BODY), ("p/foreign.py", "# (c) the zed contributors\n# Licensed MIT.\n" + HAND.replace("own", "g7")), ("p/gen/null.py", None)]
    df = spark.createDataFrame([(p, t, "z", 1) for p, t in data], "path string, text string, project string, h int")
    got = {r.path: tuple(n for n in ("generated", "minified", "vendored", "data") if r[n]) for r in handwritten.not_handwritten(df).collect()}
    assert got == {"p/lib/a.py": ("vendored",), "q/util/b.py": ("vendored",), "r/x/c.py": ("vendored",), "p/src/own.py": (), "p/src/other.py": (), "p/a/gen.py": ("generated",), "p/a/not.py": (), "p/a/emit.py": (), "p/a/tail.js": ("generated",), "p/web/m.js": ("minified",), "p/web/one.js": (),
                   "p/d/t.py": ("data",), "p/vendor/lib/v.py": ("vendored",), "p/vendor/own.py": (), "p/node_modules/k/i.js": ("vendored",), "p/empty.py": (), "p/null.py": (), "p/foreign.py": ("vendored",), "p/gen/null.py": ("generated",)}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_mark_below_a_long_licence(spark):
    licence = "".join(f"# Line {i} of a long text about terms.\n" for i in range(30))
    data = [("p/a/late.py", licence + "# Code generated by tool. DO NOT EDIT.\n" + HAND), ("p/a/none.py", licence + HAND.replace("own", "g1")), ("p/a/body.py", licence + HAND.replace("own", "g2") + "# Code generated by tool. DO NOT EDIT.\nx = 1\n" + HAND.replace("own", "g3"))]
    got = {r.path: r.generated for r in handwritten.not_handwritten(spark.createDataFrame(data, "path string, text string")).collect()}
    assert got == {"p/a/late.py": True, "p/a/none.py": False, "p/a/body.py": False}


def test_directory_hashes(spark):
    """Equal trees have equal hashes, whatever they are called; a changed leaf changes all above it."""
    leaf = lambda proj, path, h: (proj, f"{proj}/{path}", h, 400)
    data = [leaf("p", "lib/a/x", 1), leaf("p", "lib/a/y", 2), leaf("p", "lib/z", 3), leaf("q", "vend/zed/a/x", 1), leaf("q", "vend/zed/a/y", 2), leaf("q", "vend/zed/z", 3), leaf("r", "lib/a/x", 1), leaf("r", "lib/a/y", 9), leaf("r", "lib/z", 3)]
    nodes = handwritten.directory_nodes(spark.createDataFrame(data, "project string, path string, h long, n int"))
    d = {r.dir: (r.h1, r.h2, r.n) for r in handwritten.directory_hashes(nodes).collect()}
    assert d["p/lib"] == d["q/vend/zed"] != d["r/lib"] and d["p/lib/a"] == d["q/vend/zed/a"] != d["r/lib/a"] and d["p/lib"][2] == 1200


def test_copies_are_found_by_hashes_alone(spark):
    """Copies without a notice and outside vendor folders: identical however short, patched, without empty lines, and
    empty files below a shared directory. Without the hashes none of these rows would be there."""
    long = "\n".join(f"    step_{i} = prepare(step_{i - 1}, {i * 7919 % 1000}) + offset_{i * 31 % 97}" for i in range(400))
    patched = long.replace("step_200 = prepare(", "step_200 = prepare_better(")
    data = [("p/src/tiny.py", "x = f(1)"), ("q/lib/deep/small.py", "\n# another comment\nx = f(1)\n"), ("p/src/long.py", long), ("q/a/b/c/other.py", patched), ("p/core/one.py", BODY), ("r/x/y/two.py", BODY.replace("value * 3", "value // 3")),
            ("p/m/kit/__init__.py", ""), ("p/m/kit/k.py", "k = 1"), ("q/n/tool/__init__.py", ""), ("q/n/tool/k.py", "k = 1"), ("q/n/__init__.py", ""), ("s/only.py", HAND), ("s/again.py", HAND), ("p/note.txt", "# a comment only"), ("q/note.txt", "# a comment only"), ("s/more.py", HAND.replace("own", "mine"))]
    got = {r.path: r for r in handwritten.not_handwritten(spark.createDataFrame(data, "path string, text string")).collect()}
    hand = {"q/n/__init__.py", "s/only.py", "s/again.py", "s/more.py"}
    assert {p for p, r in got.items() if r.copied} == {p for p, _ in data} - hand
    assert not any(r.generated or r.minified or r.data for r in got.values())
    marks = handwritten._marked(spark.createDataFrame(data, "path string, text string"), "path", "text")
    assert marks.where("generated OR minified OR data OR foreign").count() == 0


def test_header_sentences(spark):
    says = ["This module was produced by weaver from api.yaml.", "Never edit; regenerate and do not change it.", "Edits made here will be lost.", "AUTO-GENERATED", "machine-generated bindings", "output automatically created by x"]
    denies = ["This file is not generated.", "It was created once, and is maintained by hand.", "Wraps the generated client.", 'It writes the banner "Code generated by this. DO NOT EDIT." to files.', "Generates code for the API."]
    data = [(f"p/a/y{i}.go", f"// {x}\npackage a{i}\nfunc F{i}() {{}}") for i, x in enumerate(says)] + [(f"p/a/n{i}.go", f"// {x}\npackage b{i}\nfunc G{i}() {{}}") for i, x in enumerate(denies)]
    got = {r.path for r in handwritten.not_handwritten(spark.createDataFrame(data, "path string, text string")).collect() if r.generated}
    assert got == {f"p/a/y{i}.go" for i in range(len(says))}


def test_copies_plan_is_small(spark):
    df = spark.createDataFrame([("p/a/b.py", HAND)], "path string, text string")
    assert handwritten.not_handwritten(df)._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 30


def test_long_sources(spark):
    text = "// Generated by hand, one might say\n" + "x = '" + "\\n\\\"" * 50000 + "'\n" + "# c\n" * 20000 + "if (a) {\n" * 20000
    df = spark.createDataFrame([("p/a.js", text), ("p/b.js", "a<" * 3000 + "\n/* " + "* " * 50000)], "path string, text string")
    assert handwritten.not_handwritten(df).count() == 2
    assert docpairs.function_docs(df).count() == 0


# ---- most similar vectors

def brute_nearest(vectors, k, least):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(m @ m.T, 6)
    out = {}
    for a, i in enumerate(ids):
        best = sorted(((-sims[a, b], j) for b, j in enumerate(ids) if b != a))[:k]
        out[i] = [(j, -s) for s, j in best if -s >= least]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    vectors = {f"n{i:04d}": (centres[i % 40] + rng.normal(size=64) * 0.25 * rng.random()).astype(np.float32).tolist() for i in range(600)}
    for i in range(30):
        vectors[f"same{i:02d}"] = vectors["n0000"]
    data = [(i, v, 1) for i, v in vectors.items()] + [("n0001", vectors["n0001"], 2), ("zero", [0.0] * 64, 1), ("null", None, 1), ("short", [1.0] * 63, 1), ("hole", [None] + [1.0] * 63, 1), ("nan", [float("nan")] * 64, 1), ("inf", [float("inf")] * 64, 1), (None, [1.0] * 64, 1)]
    df = spark.createDataFrame(data, "node_id string, vector array<float>, bucket int")
    want = brute_nearest(vectors, 5, 0.9)
    got = {}
    for r in neighbors.nearest(df, "node_id", "vector", 64).collect():
        got.setdefault(r.id, []).append((r.other, r.sim))
    hits = total = 0
    for i, w in want.items():
        g = sorted(got.get(i, []), key=lambda x: (-x[1], x[0]))
        hits, total = hits + len({x for x, _ in w} & {x for x, _ in g}), total + len(w)
        assert all(s >= 0.9 for _, s in g) and len(g) <= 5 and i not in {x for x, _ in g}
    assert hits / total >= 0.99
    assert [x for x, _ in sorted(got["same29"], key=lambda x: (-x[1], x[0]))] == ["n0000", "same00", "same01", "same02", "same03"]
    assert neighbors.nearest(df.limit(0), "node_id", "vector", 64).count() == 0


def test_full_buckets(spark, monkeypatch):
    """Buckets split by further levels, and parts of few rows, give the same as one bucket."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    vectors = {f"n{i:03d}": (base + rng.normal(size=64) * 0.1).astype(np.float32).tolist() for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "i string, v array<float>")
    whole = rows(neighbors.nearest(df, "i", "v", 64), "id", "other", "sim")
    monkeypatch.setattr(neighbors, "BUCKET", 100)
    assert rows(neighbors.nearest(df, "i", "v", 64), "id", "other", "sim") == whole
    want = brute_nearest(vectors, 5, 0.9)
    assert sum(len(w) for w in want.values()) == len(whole) and {(i, j) for i, w in want.items() for j, _ in w} == {(a, b) for a, b, _ in whole}


def test_one_direction(spark, monkeypatch):
    """Many lengths of one direction: ties go to the smallest ids, without comparing all with all."""
    base = np.random.default_rng(3).normal(size=64)
    df = spark.createDataFrame([(f"n{i:04d}", (base * (1 + i)).astype(np.float32).tolist()) for i in range(300)], "i string, v array<float>")
    monkeypatch.setattr(neighbors, "BUCKET", 10)
    got = {}
    for r in neighbors.nearest(df, "i", "v", 64).collect():
        got.setdefault(r.id, []).append((r.other, r.sim))
    assert all(sorted(got[f"n{i:04d}"]) == [(f"n{j:04d}", 1.0) for j in [x for x in range(6) if x != i][:5]] for i in range(300))


def test_parts():
    """Quantiles that begin a level where they can; a code that fills several parts is dealt out."""
    codes = np.concatenate([np.arange(1000) * 7, np.full(3000, 7000), 7001 + np.arange(1000)])
    bounds = neighbors._bounds(codes, 10, [8, 4])
    assert len(bounds) == 9 and (np.diff(bounds) >= 0).all() and (bounds == 7000).sum() >= 4
    part = neighbors._part_of(bounds, codes, np.arange(len(codes)))
    assert part.min() >= 0 and part.max() <= 9 and np.bincount(part).max() < 1500 and (np.diff(part[:1000]) >= 0).all()


def test_recall_on_many_vectors(spark, tmp_path):
    """100,000 vectors in loose groups: at least nine tenths of what brute force finds for every fiftieth vector."""
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(25_000, 64)), 4, axis=0)
    m = (m + rng.normal(size=m.shape) * rng.uniform(0.02, 0.33, (len(m), 1))).astype(np.float32)
    pq.write_table(pa.table({"i": [f"n{i:06d}" for i in range(len(m))], "v": pa.ListArray.from_arrays(pa.array(range(0, m.size + 1, 64), pa.int32()), pa.array(m.ravel()))}), tmp_path / "v.parquet", row_group_size=10_000)
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)
    got = {(r.id, r.other) for r in neighbors.nearest(df, "i", "v", 64).where("id LIKE '%00' OR id LIKE '%50'").collect()}
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in range(0, len(u), 50):
        sims = np.round(u @ u[i], 6)
        sims[i] = -1
        want |= {(f"n{i:06d}", f"n{j:06d}") for j in np.argsort(-sims, kind="stable")[:5] if sims[j] >= 0.9}
    assert len(want) > 2000 and len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


# ---- functions with their documentation

def test_function_docs(spark):
    text = 'def good(a):\n    """Counts everything that the caller has given."""\n\ndef short():\n    """Too short."""\n\n# TODO: describe what this does and when it fails\ndef todo(): pass\n\n# noqa: C901 E501 D103 ANN001 ANN201\ndef tool(): pass\n\n# Separated by an empty line from what follows here.\n\ndef apart(): pass\n\ndef tags(x):\n    """\n    :param x: the thing that is to be done\n    :returns: the result of doing it\n    """\n'
    df = spark.createDataFrame([("p/a.py", text, 1), ("p/a.py", text, 1), ("p/b.py", None, 1), ("p/c.py", "", 1), (None, text, 1), ("p/d.xyz", text, 1), ("noext", text, 1)], "path string, text string, id int")
    assert rows(docpairs.function_docs(df), "id", "name", "line") == [("p/a.py::good", "good", 1)]
    assert docpairs.function_docs(df.limit(0)).count() == 0


def test_templates_are_dropped(spark):
    data = [(f"p{i % 7}/f{i}.py", f'def name_{i}():\n    """Automatically written by our favourite editor plugin."""\n\ndef own_{i}():\n    """Counts number {"abcdefghijklmnopqrstuvwxyz"[i % 26] * (i // 26 + 2)} of all the things there."""\n') for i in range(60)]
    data += [(f"p{i % 7}/copy{i}.py", 'def copied():\n    """Does one and the same thing in many places."""\n') for i in range(60)]
    found = [r.name for r in docpairs.function_docs(spark.createDataFrame(data, "path string, text string")).collect()]
    assert found.count("copied") == 60 and sum(n.startswith("own_") for n in found) == 60 and not any(n.startswith("name_") for n in found)


def test_templates_count_names_and_projects_exactly(spark):
    """What stands on many names in each of many projects is a template, as is what stands on as many names over all."""
    say = "Handles the request in the way that is usual."
    each = [(f"p{p}/f{n}.py", f'def each_{n}():\n    """{say}"""\n') for p in range(8) for n in range(30)]
    few = [(f"p{n % 4}/g{n}.py", f'def few_{n}():\n    """Does something else that only four projects do."""\n') for n in range(30)]
    found = {r.name for r in docpairs.function_docs(spark.createDataFrame(each + few, "path string, text string")).collect()}
    assert found == {f"few_{n}" for n in range(30)}


CASES = {
    "a/x.ts": ("""
/** Adds one number to another and gives the sum back. */
export function add(a, b) {
  if (a) {
    return a;

// Takes one number from another and gives the rest back.
export const sub = async (a: number, b): Promise<Map<string, number>> => a - b;

class Box<T extends Base> extends Other<T> {
  static count = 0;
  /**
   * Puts one thing into the box and closes it.
   * @param x thing
   */
  @logged({ deep: true })
  async put(x, { y = 1 } = {}) { return /[{"]/.test(x); }
  // Takes the thing out of the box and returns it.
  take = (n) => { return n; };
}
""", {"add": 10, "sub": 10, "Box.put": 9, "Box.take": 10}),
    "a/x.rs": ("""
/// Reads the whole file and returns what is in it.
#[inline]
pub fn read<'a, T: Fn(u8) -> u8>(p: &'a str, c: char) -> Result<String, Box<dyn Error>> where T: Copy { let x = '{'; x }
impl<T> fmt::Display for Wrapper<T> {
    /// Writes the value in the way that people want.
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{}", self.0) }
}
""", {"read": 10, "Wrapper.fmt": 9}),
    "a/x.go": ("package x\n// Sum adds all of the numbers in the list together.\nfunc Sum[T any](xs ...T) (int, error) { return 0, nil }\n// Get returns the value that is stored for the key.\nfunc (s *Store[K, V]) Get(k K) (v V, ok bool) { return s.m[k], true }\n", {"Sum": 10, "Store.Get": 10}),
    "a/X.java": ("/** Javadoc of class that nobody asked for. */\n@Entity(name = \"x\")\npublic class Foo<T extends Comparable<T>> extends Bar<T> {\n    /** Builds a new foo from the given integer value. */\n    public Foo(int x) { this.x = x; }\n    /** Returns the list of all names that were given. */\n    @Override @SuppressWarnings({\"a\", \"b\"})\n    public <R> Map<String, List<R>> names(final T t, int... xs) throws IOException, Other { return null; }\n}\n", {"Foo.Foo": 9, "Foo.names": 9}),
    "a/x.py": ("class A:\n    @property\n    def x(self): \"Gives the x that was set by the caller.\"\n    def broken(self, a,\n        return a\n    # Counts all things that the caller has put in.\n    @decorated(\n        1)\n    async def count(self) -> dict[str, int]:\n        def inner():\n            '''This one is nested and so it is no function.'''\n        return 1\n", {"A.x": 9, "A.count": 9}),
}


CASES |= {
    "a/x.c": ("#include <a.h>\n/* Adds one number to another and gives the sum. */\nstatic inline int add(int a, int b) {\n  if (a) { return a; }\n  return a + b;\n}\n\n// Reads the whole of the file into memory.\nstruct buf *read_all(const char *p, size_t n);\n#define X(a) a {\nint none(void) { return 0; }\n", {"add": 9, "read_all": 8, "none": 0}),
    "a/x.cpp": ("namespace a::b {\n/// Holds one thing at a time.\ntemplate <typename T> class Box : public Base<T> {\n public:\n  /// Puts one thing into the box and closes it.\n  void put(T x) noexcept override { x_ = x; }\n  /** Builds a box that is empty at first. */\n  Box() : x_(0), y_{1} {}\n  /// Frees everything the box has held so far.\n  virtual ~Box() = default;\n};\n// Compares two boxes by what is in them.\nbool operator==(const Box& a, const Box& b) { return true; }\n/// Takes the thing out of the box again.\nstd::vector<int> Box::take(int n) const { return {}; }\n}\n", {"Box.put": 9, "Box.Box": 8, "Box.~Box": 8, "operator==": 8, "Box.take": 8}),
    "a/X.cs": ("namespace A.B {\n  /// <summary>Class docs nobody asked for.</summary>\n  [Serializable]\n  public sealed class Foo<T> : Bar where T : class, new() {\n    /// <summary>\n    /// Returns the list of all names given.\n    /// </summary>\n    /// <param name=\"x\">thing</param>\n    [HttpGet(\"a\")]\n    public async Task<List<string>> Names<R>(int x, string[] y = null) where R : IFoo { return null; }\n    // Adds two numbers and gives the sum back.\n    public int Add(int a, int b) => a + b;\n    public int Size { get; set; }\n    /// <summary>Builds a new foo from the base value.</summary>\n    public Foo(int x) : base(x) { }\n  }\n}\n", {"Foo.Names": 7, "Foo.Add": 8, "Foo.Foo": 8}),
    "a/x.php": ("<?php\nnamespace A\\B;\n# Adds one number to another and gives the sum.\nfunction add(int $a, $b = []): int { return $a + $b; }\nfinal class Box extends Other implements I {\n    private $x = 1;\n    /**\n     * Puts one thing into the box and closes it.\n     * @param mixed $x thing\n     */\n    #[Pure]\n    public static function put($x): ?self { return $x ? 'a}' : \"{b\"; }\n    abstract protected function none();\n}\n", {"add": 9, "Box.put": 9, "Box.none": 0}),
    "a/x.R": ("#' Adds one number to another and gives the sum.\n#' @param a one\nadd <- function(a, b = c(1, 2)) {\n  x <- function(y) y\n  a + b\n}\n# Squares every number of the vector given here.\nsq.all = function(v) v^2\n", {"add": 9, "sq.all": 8}),
    "a/y.rs": ("/// Reads all of the values in the given order.\npub fn many<T>(x: T) where " + ", ".join(f"A{i}: Clone + Into<Vec<B{i}>>" for i in range(3000)) + " { }\n", {"many": 9}),
    "a/d.py": ("".join("    " * i + f"class C{i}:\n" for i in range(60)) + "    " * 60 + "def f(self):\n" + "    " * 61 + "'Says how deep it is in the classes.'\n", {".".join(f"C{i}" for i in range(60)) + ".f": 8}),
    "a/D.java": ("".join(f"class C{i} {{ " for i in range(60)) + "\n/** Says how deep it is in the classes. */\nvoid f() { }\n" + "}" * 60, {".".join(f"C{i}" for i in range(60)) + ".f": 8}),
    "a/n.ts": ("/** Does what all of the notes say about it. */\n" + "".join(f"@note{i}({{ a: [{i}] }})\n" for i in range(3000)) + "export class A { }\n" + "@note()\n" * 3000 + "let x = 1;\nclass B {\n  // Gives back the value that is held in it.\n" + "  @n\n" * 2000 + "  get() { return 1; }\n}\n", {"B.get": 9}),
    "a/b.js": ("function broken(a) {\n  if (a) {\n    call(b;\n\n// Adds one number to another and gives the sum.\nfunction add(a, b) { return [a, b); }\n", {"broken": 0, "add": 9}),
}


def test_parsers():
    for path, (text, want) in CASES.items():
        assert {r[0].split("::")[1]: docpairs.words(r[4]) for r in docpairs.extract(path, text)} == want, path


def test_descriptions():
    d = docpairs.description
    assert d("// if (a) { b = c(d); }\n// if (e) { f = g(h); }") == "" and d("# job = register(x) if x else None") == ""
    assert d("/* Copyright 2020 by us, all rights reserved, do what you like */") == "" and d("// eslint-disable-next-line no-unused-vars, max-len") == ""
    assert d("/**\n * Sums up all things.\n * @param a one\n * Not this.\n */") == "Sums up all things." and d('"""Sums up.\n\nArgs:\n  a: x\n') == "Sums up."
    assert d("// =====\n// Between two rulers.\n// =====") == "Between two rulers." and d("// Good text first.\n// TODO: and then\n// a mark that goes on") == "Good text first."


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abf(){}[]<>=:;,.\"'`/*#\n \\@&|-+_1~?", "def ", "class ", "function ", "fn ", "func ", "async ", "impl ", "namespace ", "where "]), max_size=200).map("".join), st.sampled_from(["py", "ts", "go", "java", "rs", "c", "cpp", "cs", "php", "r"]))
def test_parser_never_breaks(text, ext):
    assert all(r[0].startswith("p/f.") for r in docpairs.extract(f"p/f.{ext}", text))


# ---- containers

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80))
def test_best_fit(sizes):
    """The tree finds the tightest open container, as a plain search does."""
    bins, left = packing.OpenBins(40), []
    for n in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= n]
        at = bins.put(n)
        if fits:
            assert at < len(left) and left[at] == min(fits)
            left[at] -= n
        else:
            assert at == len(left)
            left.append(40 - n)


def test_pack(spark):
    data = [("a", 5), ("b", None), ("c", 0), ("d", 25), ("e", 10), ("e", 10), ("f", -3), ("g", 5), (None, 5)]
    out = packing.pack(spark.createDataFrame([(k, n, "x") for k, n in data], "k string, n long, container string"), "k", "n", 10, len(data))
    used = Counter()
    for r in out.collect():
        if r.container is not None:
            used[r.container] += r["size"]
    assert sum(used.values()) == 60 and max(used.values()) == 10 and len(used) == 6
    assert rows(out.where("k = 'd'"), "piece", "start", "size") == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert rows(out.where("k = 'b'"), "container") == [(None,)] and out.count() == 11
    assert packing.pack(out.limit(0).selectExpr("k", "size AS n"), "k", "n", 10, 0).count() == 0


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    df = spark.range(1000).selectExpr("id AS k", "id % 37 AS n")
    out = packing.pack(df, "k", "n", 100, 1000)
    used = out.groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("c")).collect()
    assert max(r.s for r in used) <= 100 and sum(r.c for r in used) == 1000 and len(used) <= sum(i % 37 for i in range(1000)) / 100 * 1.12
    # Each group leaves one container with a tenth in it; these are put together.
    tenth = packing.pack(spark.range(1000).selectExpr("id AS k", "if(id % 50 = 0, 10, 0) AS n"), "k", "n", 100, 1000).groupBy("container").agg(F.sum("size").alias("s")).collect()
    assert sum(r.s for r in tenth) == 200 and len([r for r in tenth if 0 < r.s <= 50]) <= 1 and max(r.s for r in tenth) <= 100


# ---- leakage

def test_leakage(spark):
    item = "One two THREE four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x " + item + " y"), (2, "two three four five six seven eight nine ten eleven twelve thir\u00adteen!"), (3, "one-two_three.four,FIVE;six:seven|eight/nine(ten)eleven[twelve]"), (4, "one two three four five six seven eight nine ten eleven"), (5, None), (6, ""), (7, "\uff4f\uff4e\uff45 two three four five six seven eight nine ten eleven twelve"), (8, "short phrase"), (8, "short phrase"),
            (9, "one two three four five six x seven eight nine ten eleven twelve"), (10, "word " * 100000 + item), (None, item), (11, "short"), (12, "phrase short phrases")]
    items = [(100, item), (101, "Short PHRASE!"), (102, ""), (103, None), (104, "..."), (None, item), (105, item), (100, item)]
    d = spark.createDataFrame([(k, t, "e") for k, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = leakage.search(leakage.build_index(d, "doc_id", "text"), i, "item_id", "text")
    assert rows(out, "item_id", "doc_id") == sorted([(k, n) for k in (100, 105) for n in (1, 2, 3, 7, 10)] + [(101, 8)], key=str)
    near = leakage.search(leakage.build_index(d, "doc_id", "text"), i, "item_id", "text", near=13).where("kind = 'near'")
    assert (100, 9) in rows(near, "item_id", "doc_id") and (100, 4) not in rows(near, "item_id", "doc_id")
    assert leakage.search(leakage.build_index(d, "doc_id", "text"), i.limit(0), "item_id", "text").count() == 0
    assert leakage.search(leakage.build_index(d.limit(0), "doc_id", "text"), i, "item_id", "text").count() == 0


def test_stored_index(spark, tmp_path):
    """An index that was saved is searched again, for other items, without the texts; a version is never overwritten."""
    import pytest

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c d e"), (3, None)], "d long, t string")
    path = leakage.save_index(leakage.build_index(docs, "d", "t"), str(tmp_path), "1")
    items = spark.createDataFrame([(7, "c d e"), (8, "e d")], "i long, t string")
    assert rows(leakage.search(spark.read.parquet(path), items, "i", "t", length=3), "item_id", "doc_id") == [(7, 1), (7, 2)]
    with pytest.raises(Exception, match="(?i)exist"):
        leakage.save_index(leakage.build_index(docs, "d", "t"), str(tmp_path), "1")


def test_segments(spark, monkeypatch):
    """Many small segments and blocks find the same as one."""
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(60))) for k in range(200)]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(8))) for k in range(40)]
    d, i = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    want = sorted((k, n) for k, p in items for n, t in docs if any(t[2 * j:2 * j + 7] == p[2 * a:2 * a + 7] for a in range(5) for j in range(57)))
    monkeypatch.setattr(leakage, "SEGMENT_WORDS", 500)
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 7)
    out = leakage.search(leakage.build_index(d, "d", "t"), i, "i", "t", length=4)
    assert sorted((r.item_id, r.doc_id) for r in out.collect()) == want and want


# ---- pieces

def test_pieces(spark):
    path = tokens.default_path()
    prose = "The quick brown fox jumps over it. " * 40 + "\n\n" + "- a line of its own\n" * 60 + "\n\n"
    docs = {1: prose * 3, 2: None, 3: "", 4: "few words", 5: "x" * 5000, 6: "漢字かな" * 600, 7: "ab\u00e9\u00f1 " * 900, 8: " " * 3000, 9: "\n" * 3000, 10: "a b\r\n\r\n" * 700, 11: "0123456789abcdef" * 400, 12: "\U0001f600" * 700, 13: prose * 200}
    df = spark.createDataFrame([(k, t, "p") for k, t in docs.items()], "doc_id long, text string, piece string")
    got = {}
    for r in chunking.split_texts(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {k for k, t in docs.items() if t and len(tokens.encode(t, path)) > 512}
    for k, p in got.items():
        check_pieces(docs[k], sorted(p, key=lambda r: r.piece), path, 512, 64)
    assert all(p.text[-1] in ".n" or p.text.endswith("own") for p in got[1][:-1])
    assert chunking.split_texts(df.limit(0), "doc_id", "text").count() == 0


def test_very_long_text(spark):
    """Eight times the text takes about eight times as long; the pieces give it back."""
    import time

    path = tokens.default_path()
    prose = "The quick brown fox jumps over it; é. " * 40 + "\n\n" + "- a line of its own\n" * 60 + "\n\n"
    took = []
    for n in (500, 4000):
        df = spark.createDataFrame([(1, prose * n)], "doc_id long, text string")
        began = time.time()
        pieces = chunking.split_texts(df, "doc_id", "text").collect()
        took.append(time.time() - began)
        at, text = 0, prose * n
        for r in sorted(pieces, key=lambda r: r.piece):
            assert text[r.start_char:r.end_char] == r.text and r.start_char <= at < r.end_char
            at = r.end_char
        assert at == len(text) and all(len(tokens.encode(r.text, path)) <= 512 for r in pieces[::50])
    assert took[1] < 20 * took[0] + 5


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r\u00e9漢\U0001f600'", min_size=1, max_size=200))
def test_boundaries(text):
    """Natural cuts leave the tokens of both sides as they were."""
    path = tokens.default_path()
    letters, ends, byte_ends = chunking.boundaries(text, path)
    assert [len(text[:e].encode()) for e in ends] == byte_ends.tolist()
    whole = tokens.encode(text, path)
    assert len(letters) == len(whole) == len(ends) and ends[-1] == len(text)
    for k, (c, e) in enumerate(zip(letters[:-1], ends[:-1]), 1):
        if c in "PLSW":
            assert tokens.encode(text[:e], path) == whole[:k] and tokens.encode(text[e:], path) == whole[k:]


def test_reading_grows_with_the_text():
    """Twice the text takes about twice the time, whatever is broken in it."""
    import time

    def seconds(text, path):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            list(docpairs.extract(path, text))
            best = min(best, time.process_time() - began)
        return best

    hard = {"a.js": "({" + "[" * 40 + ")" * 40, "b.ts": "@a.b.c\n", "c.rs": "fn a<T where b: c\n", "d.java": "class A { int a(", "e.py": "@a\n", "f.cpp": "a::b<c> d\n", "g.go": "func (", "h.js": "class A extends b c\n", "i.ts": "x = (a, ", "j.ts": "class A {\n" + "get(a): b\n" * 5, "k.java": "a<b\n", "l.cpp": "struct a\n", "m.cs": "[a] b<\n", "n.php": "function a() : b\n"}
    for path, text in hard.items():
        assert seconds(text * 2000, path) < 5 * seconds(text * 1000, path) + 0.05, path
