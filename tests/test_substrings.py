"""Words in texts beside a plain search, and what of it is shuffled."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import deep, substrings
from weft.plans import catalogue

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")


def test_automaton_finds_what_in_finds():
    rand = random.Random(3)
    words = sorted({"".join(rand.choices("abñ😀 ", k=rand.randint(1, 6))) for _ in range(150)})
    index = substrings.Automaton(words)
    for _ in range(2000):
        text = "".join(rand.choices("abcñ😀 ", k=rand.randint(0, 30)))
        assert {words[k] for k in index.found(text)} == {w for w in words if w in text}, text
    assert substrings.Automaton([]).found("abc") == set()


def plain(nodes, aliases):
    """(entity, n) by testing every alias in every node."""
    texts, own = {}, {}
    for i, kind, name, path in nodes:
        if kind in ("symbol", "file"):
            texts.setdefault(i, []).append(f"{name or ''} {path or ''}".lower())
    for entity, names in aliases:
        own.setdefault(entity, set()).update(a.lower() for a in names or () if a)
    n = {e: sum(any(a in t for a in s for t in own_texts) for own_texts in texts.values()) for e, s in own.items()}
    return sorted((e, k) for e, k in n.items() if k)


def test_alias_matches_beside_a_plain_search(spark):
    """Aliases inside others, shared ones, in several rows, across name and path, many of an entity; ids in several rows."""
    rand = random.Random(5)
    parts = ["order", "orders", "der", "Item", "item", "x", "ñu", "cart_", "/"]
    nodes = [(f"n{k % 250}", rand.choice(["symbol", "file", "doc"]), rand.choice([None, "", "".join(rand.choices(parts, k=2))]), rand.choice([None, "".join(rand.choices(parts, k=3))])) for k in range(300)]
    nodes += [("a", "symbol", "getOrder", "p/f.py"), ("b", "file", "other", None), ("c", "symbol", None, "ORDER ITEM/x")]
    aliases = [("Order", ["order", "orderItem"]), ("Item", ["Item", "", None]), ("Item", ["ñu"]), ("Gone", ["nowhere"]), ("None", []), ("Null", None), ("Same", ["ITEM", "ñU"]), ("Wide", ["r p", "order item"])]
    aliases += [("Many", [f"{rand.choice(parts)}{k}" for k in range(80)] + ["xx", "ñuñu", "xxx"]), *((f"E{k}", rand.sample(parts, 2)) for k in range(40))]
    n = spark.createDataFrame(nodes, "id string, type string, name string, path string")
    got = deep.alias_matches(n, spark.createDataFrame(aliases, "entity string, aliases array<string>"))
    assert got.columns == ["entity", "n"] and sorted(tuple(r) for r in got.collect()) == plain(nodes, aliases)
    assert deep.alias_matches(n, spark.createDataFrame([("None", [])], "entity string, aliases array<string>")).collect() == []


def test_parts_count_as_one_automaton_does(spark):
    texts = spark.createDataFrame([(["abc", "xyz"],), (["bcd"],), ([],), (["c"],)], "t array<string>")
    sets = spark.createDataFrame([(["ab", "x"],), (["bc"],), (["bc", "c"],), (["zz"],)], "w array<string>")
    for chars in (1, 3, 500):
        found = substrings.count_containing(texts, "t", sets, "w", chars)
        assert {tuple(r.w): r.n for r in found.collect()} == {("ab", "x"): 1, ("bc",): 2, ("bc", "c"): 3}


def test_least_words(spark):
    many = [f"w{k}" for k in range(100, 180)]
    df = spark.createDataFrame([(["a", "ab", "b", "cd", "xcdx"],), (["w"] + many,), (["ab"],)], "w array<string>")
    assert [r[0] for r in df.select(substrings.least_words(F.col("w"))).collect()] == [["a", "b", "cd"], ["w"] + many, ["ab"]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_no_pieces_of_names_are_shuffled(spark):
    """Every piece of every name and path, as long as some alias, was a row of a shuffle: 1.9 GB of 0.03 when it was stopped."""
    plan = catalogue.QUERIES["alias_matches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan, plan[:3000]
