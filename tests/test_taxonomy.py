"""Taxonomy proposals against a plain loop."""

from difflib import SequenceMatcher

from factspark.operators import taxonomy
from factspark.plans.lifecycle import node_proposals


def test_evolve_apply(tables):
    nodes = {(r.facet, r.path): [r.label, r.definition, r.status] for r in tables.x_node.collect()}
    facets = {r.facet for r in tables.x_node.filter("facet_status = 'active'").collect()}
    texts = {k: f"{v[0]} {v[1]}".lower() for k, v in nodes.items() if v[2] in ("active", "proposed")}
    want = {}
    for p in sorted(node_proposals(tables).collect(), key=lambda p: p.pos):
        op, path = p.op.strip().lower(), p.path.strip().lower().replace(" ", "_")
        if not p.label or p.facet not in facets:
            want[p.pos] = "skipped"
        elif op == "alter":
            want[p.pos] = "altered" if (p.facet, path) in nodes and nodes[(p.facet, path)][2] == "active" else "skipped"
        elif (p.facet, path) in nodes or any(
            f == p.facet and SequenceMatcher(None, f"{p.label} {p.definition}".lower(), text).ratio() >= 0.72 for (f, _), text in texts.items()
        ):
            want[p.pos] = "duplicate"
        else:
            want[p.pos] = "added"
            nodes[(p.facet, path)] = [p.label, p.definition, "active"]
            texts[(p.facet, path)] = f"{p.label} {p.definition}".lower()
    got = {r.pos: r.outcome for r in taxonomy.evolve_apply(node_proposals(tables), tables.x_node).collect()}
    assert got == want and {"added", "duplicate", "skipped"} <= set(want.values())
