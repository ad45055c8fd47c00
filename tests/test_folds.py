"""Order-dependent operators against plain loops."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from factspark.operators import folds
from factspark.plans.lifecycle import docs, incoming_relations, new_claims, stored_relations


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


CLAIM = "assertion_id long, entity_id string, attribute_key string, value_text string, value_num decimal(30,10), value_bool boolean, value_date date, confidence int, status string, method string, observed_at timestamp, document_id long, is_new boolean"


def in_order(claims, documents, volatility):
    """The claims of one entity and attribute judged one by one: {id: (outcome, status, review, confidence, confirmations, rival)}."""
    from math import floor

    odds = lambda t: t / max(1, 100 - t)
    force = {c["assertion_id"]: c for c in claims if c["status"] == "accepted"}
    now = {c["assertion_id"]: [None, c["status"], None, c["confidence"], 0, None] for c in claims}
    for c in sorted((c for c in claims if c["is_new"]), key=lambda c: c["assertion_id"]):
        own = now[c["assertion_id"]]
        rivals = [i for i in force if i != c["assertion_id"]]
        if not rivals:
            own[0] = "accepted" if own[1] == "candidate" and own[3] >= 50 else "kept"
            if own[0] == "accepted":
                own[1] = "accepted"
                force[c["assertion_id"]] = c
            continue
        best = min(rivals, key=lambda i: (-now[i][3], i))
        b, cd, bd = force[best], documents.get(c["document_id"]), documents.get(force[best]["document_id"])
        own[5] = best
        days = (cd[0] - bd[0]).days if cd and bd and cd[0] and bd[0] else (c["observed_at"] - b["observed_at"]).days
        ratio = float(c["value_num"]) / float(b["value_num"]) if b["value_num"] else 1
        if c["value_num"] == b["value_num"]:
            own[0] = "same_document" if c["document_id"] == b["document_id"] else "corroborates" if cd and bd and cd[1] != bd[1] and cd[2] != bd[2] else "echo"
            if own[0] == "corroborates":
                p = odds(now[best][3]) * max(1, odds(cd[3]))
                now[best][3], now[best][4] = max(1, min(99, round(100 * (p / (1 + p))))), now[best][4] + 1
            own[1] = "rejected"
            force.pop(c["assertion_id"], None)
        elif volatility is not None and days > 30:
            own[0], own[1], now[best][1] = "supersedes", "accepted", "superseded"
            del force[best]
            force[c["assertion_id"]] = c
        elif ratio > 5 or ratio < 0.2:
            own[0], own[1], own[2] = "out_of_range", "candidate", "pending"
            force.pop(c["assertion_id"], None)
        else:
            own[0] = "synthesis"
    old = {c["assertion_id"]: c for c in claims}
    return {i: ("changed" if n[0] is None else n[0], *n[1:]) for i, n in now.items() if old[i]["is_new"] or n[4] or n[1] != old[i]["status"]}


def outcome(r):
    return r.outcome, r.status, r.review_state, r.confidence, r.corroboration_count, r.other_id


def many_claims(rng, n, stored, amounts, accepted=0.15):
    day = datetime.datetime(2020, 1, 1)
    return [dict(assertion_id=i, entity_id="E1" if i % 5 else "E2", attribute_key="size", value_text=None, value_num=rng.choice(amounts), value_bool=None, value_date=None,
                 confidence=rng.randint(40, 95), status="accepted" if i <= stored or rng.random() < accepted else "candidate", method="extracted",
                 observed_at=day + datetime.timedelta(days=i * 400 // n), document_id=i % 9, is_new=i > stored) for i in range(1, n + 1)]


DOCUMENTS = {i: (datetime.datetime(2020, 1 + i, 1) if i % 3 else None, f"h{i}", f"d{i % 4}", 30 + 8 * i) for i in range(9)}
WIDE = "12345678901234567890.0000000001", "12345678901234567890.0000000002"


def document_table(spark):
    return spark.createDataFrame([(i, *d) for i, d in DOCUMENTS.items()], "document_id long, published_at timestamp, content_sha256 string, domain string, trust int")


@pytest.mark.parametrize("amounts", [["1", "2", "3", "20"], WIDE])
def test_adjudication_in_order(spark, amounts):
    """Both amounts of 30 digits are one double; they are not one value."""
    claims = many_claims(random.Random(7), 36, 4, [decimal.Decimal(a) for a in amounts])
    df = spark.createDataFrame([tuple(c.values()) for c in claims], CLAIM).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    defs = spark.createDataFrame([("size", "single", 30)], "attribute_key string, cardinality string, volatility_days int")
    got = folds.adjudicate(df.filter("is_new"), df.filter("NOT is_new"), document_table(spark), defs)
    want = {k: v for e in ("E1", "E2") for k, v in in_order([c for c in claims if c["entity_id"] == e], DOCUMENTS, 30).items()}
    assert {r.assertion_id: outcome(r) for r in got.collect()} == want
    confirmed = folds.adjudicate_documents(got, df)
    assert {tuple(r) for r in confirmed.collect()} == {(v[5], claims[k - 1]["document_id"]) for k, v in want.items() if v[0] == "corroborates"}


def test_stream_adjudicates_batch_by_batch(spark, tmp_path):
    """Three batches with late ids and days; a key with 20,000 claims in force."""
    from factspark.streaming import streams

    rng = random.Random(3)
    amounts = [decimal.Decimal(a) for a in (*WIDE, "1", "2", "20")]
    claims = many_claims(rng, 60, 3, amounts)
    new = [c for c in claims if c["is_new"]]
    rng.shuffle(new)
    crowd = [dict(c, assertion_id=1000 + i, entity_id="E3", is_new=False, status="accepted", value_num=decimal.Decimal(i + 1), confidence=40 + i % 50) for i, c in enumerate([claims[0]] * 20_000)]
    asked = [dict(c, assertion_id=100_000 + i, entity_id="E3") for i, c in enumerate(new[:20])]
    batches = [claims[:3] + crowd + new[:20], new[20:40] + asked[10:], new[40:] + asked[:10]]
    docs = document_table(spark)
    state, want = {}, []
    for batch in batches:
        found = {}
        for e in ("E1", "E2", "E3"):
            mine = [c for c in batch if c["entity_id"] == e]
            found |= in_order([c for c in state.values() if c["entity_id"] == e] + mine, DOCUMENTS, 30)
        want.append(found)
        for c in batch:
            state[c["assertion_id"]] = dict(c, is_new=False)
        for i, o in found.items():
            state[i] = dict(state[i], status=o[1], confidence=o[3])
        state = {i: c for i, c in state.items() if c["status"] == "accepted"}
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        rows = spark.createDataFrame([tuple(c.values()) for c in batch], CLAIM).join(docs, "document_id", "left").withColumns({"cardinality": F.lit("single"), "volatility_days": F.lit(30)})
        rows.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(rows.schema).parquet(folder)
        streams.batch_writer(streams.stream_adjudicate(source), lambda b, i: streams.append_once(b, out, i), str(tmp_path / "state")).start().awaitTermination()
    for at, found in enumerate(want):
        assert {r.assertion_id: outcome(r) for r in spark.read.parquet(out).filter(f"batch = {at}").collect()} == found


def test_adjudicate_rules(spark):
    def run(new, old, multi=False, window=30):
        schema = "assertion_id long, entity_id string, attribute_key string, value_text string, value_num double, value_bool boolean, value_date date, confidence int, status string, method string, observed_at timestamp, document_id long, superseded_at timestamp"
        mk = lambda i, v, c, s, doc, day, m="extracted": (i, "E", "a", None, v, None, None, c, s, m, __import__("datetime").datetime(2020, 1, day), doc, None)
        documents = spark.createDataFrame([(1, None, "h1", "one.com", 80), (2, None, "h2", "two.com", 80), (3, None, "h3", "one.com", 80)], "document_id long, published_at timestamp, content_sha256 string, domain string, trust int")
        defs = spark.createDataFrame([("a", "multi" if multi else "single", window)], "attribute_key string, cardinality string, volatility_days int")
        n = spark.createDataFrame([mk(*x) for x in new], schema)
        o = spark.createDataFrame([mk(*x) for x in old], schema)
        return {r.assertion_id: (r.outcome, r.status, r.confidence, r.corroboration_count) for r in folds.adjudicate(n, o, documents, defs).collect()}

    old = [(1, 10.0, 80, "accepted", 1, 1)]
    assert run([(2, 10.0, 60, "candidate", 2, 2)], old) == {2: ("corroborates", "rejected", 60, 0), 1: ("changed", "accepted", 94, 1)}
    assert run([(2, 10.0, 60, "candidate", 3, 2)], old) == {2: ("echo", "rejected", 60, 0)}
    assert run([(2, 10.0, 60, "candidate", 1, 2)], old) == {2: ("same_document", "rejected", 60, 0)}
    assert run([(2, 51.0, 60, "candidate", 2, 2)], old) == {2: ("out_of_range", "candidate", 60, 0)}
    assert run([(2, 12.0, 60, "candidate", 2, 2)], old) == {2: ("synthesis", "candidate", 60, 0)}
    assert run([(2, 12.0, 60, "candidate", 2, 2), (3, 12.0, 40, "candidate", 2, 2)], []) == {2: ("accepted", "accepted", 60, 0), 3: ("same_document", "rejected", 40, 0)}
    assert run([(2, 12.0, 60, "candidate", 2, 2), (3, 9.0, 40, "candidate", 2, 2)], old, multi=True) == {2: ("accepted", "accepted", 60, 0), 3: ("kept", "candidate", 40, 0)}
    assert run([(2, 99.0, 60, "candidate", 2, 2, "derived")], old) == {2: ("derived", "candidate", 60, 0)}


def test_funding_totals(tables):
    rounds = folds.funding_rounds(tables.x_event, tables.x_entity).collect()
    by_entity = {}
    for r in sorted(rounds, key=lambda r: (r.entity_id, r.day, r.event_id)):
        kept = by_entity.setdefault(r.entity_id, [])
        for i, k in enumerate(kept):
            if k.year is not None and k.year == r.year and k.amount and r.amount and abs(k.amount - r.amount) <= 0.15 * max(k.amount, r.amount):
                if r.confidence > k.confidence:
                    kept[i] = r
                break
        else:
            kept.append(r)
    want = {e: (round(sum(k.amount for k in kept), 2), min(k.confidence for k in kept), len(kept)) for e, kept in by_entity.items()}
    got = folds.derive_funding_totals(tables.x_event, tables.x_entity, tables.x_assertion)["totals"].collect()
    assert {r.entity_id: (r.total_usd, r.confidence, r.n_rounds) for r in got} == want


def test_store_relations_loop(tables):
    known = tables.x_relation.select("predicate").distinct()
    incoming = folds.clean_relations(incoming_relations(tables), known)
    state = {}
    for r in stored_relations(tables).collect():
        state[(r.subject_id, r.predicate, r.object_id)] = [r.document_id, r.confidence, r.status]
    touched = set()
    for r in sorted(incoming.collect(), key=lambda r: r.in_id):
        key = (r.subject_id, r.predicate, r.object_id)
        touched.add(key)
        s = state.get(key)
        if s is None or s[0] == r.document_id:
            state[key] = [r.document_id, r.trust, "accepted" if r.trust >= 65 else "candidate"]
        else:
            s[1] = min(99, s[1] + max(3, int((100 - s[1]) * r.trust / 300)))
            s[2] = "accepted" if s[1] >= 65 else s[2]
    got = folds.store_relations(incoming, stored_relations(tables)).collect()
    assert {(r.subject_id, r.predicate, r.object_id): [r.document_id, r.confidence, r.status] for r in got} == {k: state[k] for k in touched}


def test_stream_adjudicate_equals_batch(spark, tables, tmp_path):
    from factspark.streaming import streams

    d = docs(tables)
    batch = folds.adjudicate(new_claims(tables), tables.x_assertion, d, tables.x_attribute_def)
    claims = folds.adjudication_input(new_claims(tables), tables.x_assertion, d, tables.x_attribute_def)
    new = claims.filter("is_new")
    cut = new.approxQuantile("assertion_id", [0.3, 0.7], 0)
    folder = str(tmp_path / "in")
    parts = [claims.filter("NOT is_new"), new.filter(f"assertion_id < {cut[0]}"), new.filter(f"assertion_id >= {cut[0]} AND assertion_id < {cut[1]}"), new.filter(f"assertion_id >= {cut[1]}")]
    out = str(tmp_path / "out")
    for part in parts:  # each run of the stream sees one more part
        part.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(claims.schema).parquet(folder)
        run = streams.batch_writer(streams.stream_adjudicate(source), lambda b, i: streams.append_once(b, out, i), str(tmp_path / "state")).start()
        run.awaitTermination()
    last = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
        last.setdefault(r.assertion_id, []).append(r)
    want = {r.assertion_id: r for r in batch.collect()}
    assert set(last) == set(want)
    for key, seen in last.items():
        assert seen[-1].status == want[key].status
        assert seen[-1].confidence == want[key].confidence
        assert sum(r.corroboration_count for r in seen) == want[key].corroboration_count


def test_rounds_read_open_groups_only(spark, monkeypatch):
    """Of 300 groups one needs several rounds; the rounds after the first write its rows alone.  Long runs of lifts equal short ones."""
    rng = random.Random(11)
    day = datetime.datetime(2020, 1, 1)
    claims = many_claims(rng, 60, 6, [decimal.Decimal(a) for a in ("1", "2", "3")], accepted=0.2)
    for i in range(1, 300):
        quiet = dict(claims[0], entity_id=f"Q{i}", value_num=decimal.Decimal(7), confidence=60, observed_at=day, method="extracted")
        claims += [dict(quiet, assertion_id=1000 + 4 * i, status="accepted", is_new=False, document_id=1)]
        claims += [dict(quiet, assertion_id=1000 + 4 * i + k, status="candidate", is_new=True, document_id=k + 1) for k in (1, 2)]
    df = spark.createDataFrame([tuple(c.values()) for c in claims], CLAIM).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    defs = spark.createDataFrame([("size", "single", 30)], "attribute_key string, cardinality string, volatility_days int")
    want = {}
    for e in {c["entity_id"] for c in claims}:
        want |= in_order([c for c in claims if c["entity_id"] == e], DOCUMENTS, 30)
    written, checkpointed = [], folds.checkpointed

    def counted(frame):
        kept = checkpointed(frame)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(folds, "checkpointed", counted)
    judged = lambda: {r.assertion_id: outcome(r) for r in folds.adjudicate(df.filter("is_new"), df.filter("NOT is_new"), document_table(spark), defs).collect()}
    assert judged() == want
    assert len(written) > 6 and max(written[3:]) <= 60, written
    monkeypatch.setattr(folds, "checkpointed", checkpointed)
    monkeypatch.setattr(folds, "SHORT_RUN", 1)
    monkeypatch.setattr(folds, "BLOCK_BITS", 2)
    monkeypatch.setattr(folds, "LEVEL_BITS", 2)
    assert judged() == want


def test_ends_of_relations_are_hashed(spark, tables):
    """Relations are not sorted for their ends, so they cannot spill there."""
    from factspark.operators import gaps

    relation = tables.x_relation.select("relation_id", "subject_id", "object_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(relation.limit(50).collect(), relation.schema)
        plan = gaps.relation_endpoints(rows, tables.x_entity)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


EVENT = "event_id long, entity_id string, event_type string, title string, date date, description string, confidence int, call_url string, call_status string, amount_usd decimal(20,2)"
ANSWER = "in_id long, entity_id string, mention string, title string, description string, event_type string, date_text string, significance string, amount_text string, call_url string, call_status string, trust int, participants array<string>"


def test_store_events_in_order(spark):
    """Stored rows and answers of one key; of two stored rows only the first counts."""
    day = datetime.date(2020, 1, 2)
    stored = [
        (7, "E1", "ipo", "A", day, "six ch", 99, "late", "closed", decimal.Decimal("9.00")),
        (5, "E1", "ipo", "A", day, "stored", 40, "old", None, None),
        (6, "E2", "ipo", "A", day, None, 90, None, "open", decimal.Decimal("3.50")),
        (8, "E3", "ipo", "A", None, "untouched", 50, None, None, None),
    ]
    answer = lambda i, entity, text, trust, url, status, amount, date="2020-01-02": (i, entity, "m", "A", text, "ipo", date, "high", amount, url, status, trust, [])
    incoming = [
        answer(3, "E1", "equal!", 60, "", "open", "1"), answer(9, "E1", "short", 50, "new", "maybe", "2"),
        answer(2, "E2", "x", 10, "u", "closed", "n/a"),
        answer(4, "E4", "first", 20, "a", None, "n/a", None), answer(1, "E4", "tied!", 30, None, "open", "1e3", "soon"),
    ]
    events = spark.createDataFrame(stored, EVENT)
    got = folds.store_events(spark.createDataFrame(incoming, ANSWER), events)
    fields = ["entity_id", "date", "event_id", "first_in", "description", "confidence", "call_url", "call_status", "amount_usd", "date_precision", "significance", "is_new"]
    assert sorted(tuple(r) for r in got.select(*fields).collect()) == [
        ("E1", day, 5, -1, "stored", 60, "new", "open", None, None, None, False),
        ("E2", day, 6, -1, "x", 90, "u", "closed", 3.5, None, None, False),
        ("E4", None, None, 1, "tied!", 30, "a", "open", 1000.0, "year", "high", True),
    ]


def test_store_events_shuffles_once(spark):
    """Stored events and answers meet in one shuffle and one aggregation, without a window."""
    from factspark.plans import registry

    plan = registry.queries()["store_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
