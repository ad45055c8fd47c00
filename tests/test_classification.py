"""Classification answers against a plain fold in the order of the items."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factspark.functions import vocab
from factspark.operators import claims

KIND = next(k for k, v in vocab.FACETS_FOR_TYPE.items() if len(v) > 1)
FACET, OTHER = vocab.FACETS_FOR_TYPE[KIND][:2]
NODES = [(FACET, "a", "active", "active"), (FACET, "b", "retired", "active"), (OTHER, "a.b", "active", "active"), ("unasked", "a", "active", "active")]
ITEMS = "entity_id string, pos long, facet string, path string, weight double, is_primary boolean, label string"


def judge(spark, items, entities):
    entity = spark.createDataFrame(entities, "entity_id string, entity_type string")
    node = spark.createDataFrame(NODES, "facet string, path string, status string, facet_status string")
    rows = spark.createDataFrame([(*i, 0.5, True, "high") for i in items], ITEMS)
    return claims.classification_items(rows, entity, node)


def fold(items, kinds):
    """(entity, pos, facet, path, stored, new) of every item, one answer after the other."""
    active = {(f, p) for f, p, s, _ in NODES if s == "active"}
    there, facets = {(f, p) for f, p, *_ in NODES}, {f for f, *_ in NODES}
    taken, out = set(), []
    for e, pos, f, p in sorted(items, key=lambda i: (i[0], i[2], i[1], i[3] or "")):
        above = p.rpartition(".")[0] if p else None
        shaped = bool(p) and re.fullmatch(r"[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*", p) is not None and f in facets
        near = above == "" or (f, above) in active or (e, f, above) in taken
        stored = f in vocab.FACETS_FOR_TYPE.get(kinds[e], []) and ((f, p) in active or (shaped and near))
        if stored:
            taken.add((e, f, p))
        out.append((e, pos, f, p, stored, stored and (f, p) not in there))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_answers(spark, seed):
    dice = random.Random(seed)
    kinds = {"e0": KIND, "e1": KIND, "e2": "no such type"}
    words = ["a", "b", "c", "B", ""]
    items = [
        (dice.choice(list(kinds)), pos, dice.choice([FACET, FACET, OTHER, "unasked", "unknown"]),
         dice.choice([None, *[".".join(dice.choices(words[: 3 if dice.random() < 0.9 else 5], k=dice.randint(1, 4))) for _ in range(9)]]))
        for pos in range(400)
    ]
    got = judge(spark, items, list(kinds.items())).select("entity_id", "pos", "facet", "path", "stored", "is_new_node").collect()
    assert sorted(map(tuple, got), key=str) == fold(items, kinds)


def test_one_entity_holds_nearly_all_items(spark):
    """A chain of 12 levels, its last 20,000 items under one parent, given before and after it."""
    chain = ["c" + ".d" * i for i in range(12)]
    items = [("hot", 10_000 + i, FACET, p) for i, p in enumerate(chain)] + [("cold", 1, FACET, "c.d")]
    items += [("hot", pos if pos < 10_000 else pos + 20, FACET, f"{chain[-1]}.x{pos % 7}") for pos in range(20_000)]
    judged = judge(spark, items, [("hot", KIND), ("cold", KIND)])
    counts = {r.entity_id: (r.created, r.skipped) for r in claims.classification_counts(judged).collect()}
    assert counts == {"hot": (12 + 10_000, 10_000), "cold": (0, 1)}
    assert judged.filter("stored AND entity_id = 'hot'").select("path").distinct().count() == 12 + 7


def test_ties_repeats_and_nothing(spark):
    items = [("e", 1, FACET, "c"), ("e", 1, FACET, "c.d"), ("e", 1, FACET, "c.d"), ("e", None, FACET, "c.d"), ("e", None, FACET, "x"), ("e", 2, FACET, "x.y")]
    got = judge(spark, items, [("e", KIND)]).groupBy("pos", "path").agg(F.count_if("stored").alias("n")).collect()
    assert {(r.pos, r.path): r.n for r in got} == {(1, "c"): 1, (1, "c.d"): 2, (None, "c.d"): 0, (None, "x"): 1, (2, "x.y"): 0}
    assert judge(spark, [], [("e", KIND)]).count() == 0
