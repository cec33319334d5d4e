"""The registered queries beside their SQL, and where there is none beside brute force, on whole tables."""

import os
from collections import Counter, defaultdict

import pytest

from tests.compare import differs
from weft.llm import leakage, queries as q, tokens
from weft.session import table

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(spark, name):
    why, _ = differs(spark, DATA, q.QUERIES[name], q.ORACLE[name])
    assert why is None, why


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}


def test_p3(spark):
    """Over all sources: each path once, and the hashes against brute force over whole texts of different projects."""
    found = {r.path: r for r in q.p3_evidence(spark, DATA).collect()}
    assert sorted(r.path for r in q.p3_found(spark, DATA).collect()) == sorted(found) and found
    owners = defaultdict(set)
    sources = table(spark, DATA, "sources").where("path IS NOT NULL AND text IS NOT NULL").collect()
    for r in sources:
        owners["\n".join(x.strip() for x in r.text.splitlines())].add(r.path.split("/")[0])
    same = {r.path for r in sources if r.text.strip() and len(owners["\n".join(x.strip() for x in r.text.splitlines())]) > 1}
    assert same <= {p for p, r in found.items() if r.copied}


def test_p4(spark):
    """Over all nodes: a score for each term of each node that has any, and the scores of p4_scores among them."""
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in q.p4_terms(spark, DATA).collect()]
    every, some = set(rows), {tuple(r) for r in q.p4_scores(spark, DATA).collect()}
    assert len(rows) == len(every) and some < every and all(r[4] is not None for r in rows)
    assert min(r[2] for r in rows) == min(r[3] for r in rows) == 1 and max(r[3] for r in rows) > 8
    now = table(spark, DATA, "nodes").where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("updated_at", "name", "summary", "signature")).alias("r"))
    named = {r.id for r in now.where("r.name RLIKE '[a-z]{3}'").collect()}
    assert named and named <= {r[0] for r in rows}


def test_p4_ties_and_one_term(spark, tmp_path):
    """A null is an empty text where two rows of a node have one time; one term alone gives what SQL gives."""
    from datetime import datetime as dt

    schema, t = "id string, updated_at timestamp, name string, summary string, signature string", dt(2025, 1, 1)
    cases = {
        "ties": [("a", t, None, "xray xray", None), ("a", t, "", "alpha alpha", None), ("b", t, "xray alpha", "", "")],
        "one": [("a", t, "alpha alpha", None, None), ("b", t, "alpha", "alpha" + " alpha" * 46, None)],
        "none": [("a", t, None, "", "a 12")],
    }
    for case, data in cases.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{case}/nodes.parquet")
        why, n = differs(spark, f"{tmp_path}/{case}", q.p4_terms, q.ORACLE["p4_terms"])
        assert why is None and n == {"ties": 3, "one": 2, "none": 0}[case], (case, why)
    for name in ("p4_found", "p4_scores"):
        assert differs(spark, f"{tmp_path}/one", q.QUERIES[name], q.ORACLE[name]) == (None, 2)


def test_p7(spark):
    """Over all sources: each id once, and each found as well by the plain readers of the core, which are made otherwise."""
    from weft.operators import extract
    from weft.sources.files import language

    from pyspark.sql import functions as F

    found = [r.id for r in q.p7_found(spark, DATA).collect()]
    assert len(found) == len(set(found)) > 0
    src = table(spark, DATA, "sources").where("path IS NOT NULL").select("path", "text", language(F.col("path")).alias("lang")).distinct()
    known = {r.id for r in extract.facts(src).where("kind = 'node'").select("id").collect()}
    broken = {i.partition("::")[0] for i in found if i not in known}
    assert len([i for i in found if i not in known]) <= 0.05 * len(found), broken


def test_p8(spark, docs):
    rows = q.p8_containers(spark, DATA).collect()
    path = tokens.default_path()
    sizes = {k: None if t is None else len(tokens.encode(t, path)) for k, t in docs.items()}
    used, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        if r.container is not None:
            used[r.container] += r["size"]
    assert max(used.values()) <= q.CONTAINER and set(parts) == set(docs)
    for k, p in parts.items():
        p.sort(key=lambda r: r.piece)
        if sizes[k] is None:
            assert [r.container for r in p] == [None]
            continue
        assert sum(r["size"] for r in p) == sizes[k] and (len(p) == 1 or sizes[k] > q.CONTAINER)
        assert all(r["size"] == q.CONTAINER for r in p[:-1]) and [r.start for r in p] == [i * q.CONTAINER for i in range(len(p))]
    total = sum(s for s in sizes.values() if s)
    assert len(used) <= -(-total // q.CONTAINER) * 1.05 + 1


def test_p9(spark, docs):
    items = {r.item_id: leakage.words(r.text) for r in table(spark, DATA, "eval_items").collect()}
    grams = defaultdict(set)
    for i, w in items.items():
        for j in range(max(1, len(w) - 11) if w else 0):
            grams[tuple(w[j:j + 12])].add(i)
    sizes, want = {len(g) for g in grams}, set()
    for k, t in docs.items():
        w = leakage.words(t)
        want |= {(i, k) for n in sizes for j in range(len(w) - n + 1) for i in grams.get(tuple(w[j:j + n]), ())}
    rows = [tuple(r) for r in q.p9_found(spark, DATA).select("item_id", "doc_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_p9_near(spark, docs):
    """Against brute force over all documents: the rarest word of a window in a segment is the rarest in the document set."""
    items = {r.item_id: leakage.words(r.text) for r in table(spark, DATA, "eval_items").collect()}
    found = {(r.item_id, r.doc_id) for r in q.p9_near(spark, DATA).collect()}
    phrases = {tuple(r) for r in q.p9_found(spark, DATA).select("item_id", "doc_id").collect()}
    assert phrases <= found
    for item, doc in found:
        have, w = defaultdict(list), items[item]
        for at, word in enumerate(leakage.words(docs[doc])):
            have[word].append(at)
        size = min(12, len(w))
        assert any(any(all(any(abs(a - b) <= q.NEAR for b in have[x]) for x in w[i:i + size]) for y in set(w[i:i + size]) for a in have[y]) for i in range(len(w) - size + 1))


def test_p10(spark, docs):
    pieces, path = defaultdict(list), tokens.default_path()
    for r in q.p10_pieces(spark, DATA).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == {k for k, t in docs.items() if t and len(tokens.encode(t, path)) > q.PIECE}
    for k, p in pieces.items():
        p.sort(key=lambda r: r.piece)
        check_pieces(docs[k], p, path, q.PIECE, q.OVERLAP)


def check_pieces(text, pieces, path, limit, overlap):
    """An exact round trip: what the overlaps repeat aside, the pieces are the text."""
    at = 0
    for i, r in enumerate(pieces):
        assert text[r.start_char:r.end_char] == r.text and r.start_char <= at < r.end_char and r.overlap_tokens <= overlap
        assert (r.overlap_tokens == 0) if i == 0 else (r.start_char < at or not overlap or r.overlap_tokens == 0)
        assert len(tokens.encode(r.text, path)) <= limit
        at = r.end_char
    assert at == len(text)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_cross_joins(spark, name):
    import re

    text = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), text[:3000]
