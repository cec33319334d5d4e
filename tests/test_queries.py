"""Every query beside its SQL on the smallest tables."""

import os

import pytest

from tests.compare import differs
from weft.plans import catalogue, problems
from weft.session import table

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = catalogue.QUERIES | problems.QUERIES
ORACLE = catalogue.ORACLE | problems.ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    why, _ = differs(spark, DATA, QUERIES[name], ORACLE[name])
    assert why is None, why


@pytest.fixture(scope="module")
def texts(spark):
    """The lines of every source, by path."""
    return {r.path: r.text.replace("\r\n", "\n").split("\n") for r in table(spark, DATA, "sources").where("path IS NOT NULL AND text IS NOT NULL").collect()}


@pytest.mark.parametrize("name", ["extract_patterns", "extract_python"])
def test_symbols_stand_where_they_are_said_to(spark, texts, name):
    """Over all sources: each symbol once, within its file, and on its line."""
    found = QUERIES[name](spark, DATA).where("contains(id, '::')").collect()
    assert len(found) > 20 and len({r.id for r in found}) == len(found)
    for r in found:
        path, _, own = r.id.partition("::")
        assert 1 <= r.line <= r.end_line <= len(texts[path]) + 1 and own.rpartition(".")[2] in texts[path][r.line - 1], r


def test_python_symbols_against_a_plain_walk(spark, texts):
    """Over all Python sources that parse: top-level functions and classes, and the methods of these."""
    import ast

    want = set()
    for path, lines in texts.items():
        if path.endswith(".py"):
            try:
                tree = ast.parse("\n".join(lines).lstrip("\ufeff"))
            except (SyntaxError, ValueError):
                continue
            for x in tree.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    want.add((f"{path}::{x.name}", x.name))
                    want |= {(f"{path}::{x.name}.{m.name}", f"{x.name}.{m.name}") for m in x.body if isinstance(x, ast.ClassDef) and isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
    got = {(r.id, r.name) for r in QUERIES["extract_python"](spark, DATA).where("contains(id, '::')").collect()}
    assert want <= got and all(n.isupper() for _, n in got - want) and len(want) > 20


def test_import_edges_over_all_sources(spark, texts):
    found = QUERIES["import_edges"](spark, DATA).collect()
    assert found and len({(r.source, r.target) for r in found}) == len(found)
    for r in found:
        assert r.source in texts
        if r.type == "imports":
            assert r.target in texts and r.target.split("/")[0] == r.source.split("/")[0] and r.confidence == (1.0 if r.source.endswith(".py") else 0.9)
        else:
            package = r.target.removeprefix("external:")
            assert r.type == "depends_on" and package and not set(package) & set("./") and any(package in line for line in texts[r.source])


@pytest.mark.parametrize("name", ["calls", "python_calls"])
def test_call_edges_over_all_sources(spark, texts, name):
    """Each edge leads from a file or symbol to a symbol, and its short name is called in the source of the caller."""
    for r in QUERIES[name](spark, DATA).collect():
        short = r.target.rpartition("::")[2].rpartition(".")[2]
        assert r.target.partition("::")[0] in texts and any(short in line for line in texts[r.source.partition("::")[0]]) and r.source != r.target


def test_log_digest_over_all_documents(spark):
    """Ranks without gaps up to eight, and nothing that the text does not say."""
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").where("text IS NOT NULL").collect()}
    ranks = {}
    for r in QUERIES["log_digest"](spark, DATA).collect():
        ranks.setdefault(r.doc_id, []).append(r["rank"])
        assert (r.path is None or r.path in docs[r.doc_id]) and (r.line is None or str(r.line) in docs[r.doc_id])
    assert ranks and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 8 for x in ranks.values())


def test_summaries_over_all_nodes(spark):
    rows = QUERIES["summaries"](spark, DATA).collect()
    assert rows and len({r[0] for r in rows}) == len(rows) and all(v is not None for r in rows for v in r)


def test_nothing_is_left_unchecked():
    assert set(QUERIES) - set(ORACLE) == {"extract_patterns", "extract_python", "import_edges", "calls", "python_calls", "log_digest", "summaries"}


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
