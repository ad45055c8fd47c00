"""Secrets in text: fixed patterns, and strings that read as random to a pair of Markov models."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "random"]
BASE_KINDS = KINDS[:3]
#: Runs that can hold a key; every access and hex span lies inside one.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Model states: the characters of RUN, and one for the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Letters and digits; the other characters join parts that are read one by one.
SOLID = len(ALPHABET) - len("+/_=-")


@dataclass(frozen=True)
class RandomModel:
    """``ratio[previous][next]``: log of P(next | previous) among random strings over that among
    ordinary ones; a run is reported from ``least`` nats per character."""

    ratio: list[list[float]]
    least: float


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; matches that are too short are found and dropped."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    for lo, hi in runs:
        found += [("access", m.start(), m.end()) for m in re.compile(ACCESS).finditer(text, lo, hi) if m.end() - m.start() >= 16]
        if hi - lo >= 32:
            found += [("hex", m.start(), m.end()) for m in re.compile(HEX).finditer(text, lo, hi) if m.end() - m.start() >= 32]
    return found


def long_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(RUN, text)]


def mixed(run: str) -> bool:
    """Letters and digits both: numbers and plain words are never reported as random."""
    return any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run)


def pairs_of(run: str):
    """Places (previous, next) of the letters and digits of a run; one after a joint begins anew."""
    previous = len(ALPHABET)
    for place in map(ALPHABET.find, run):
        if 0 <= place < SOLID:
            yield previous, place
            previous = place
        else:
            previous = len(ALPHABET)


def log_ratio(run: str, ratio) -> float:
    """Mean log likelihood ratio per character; joints count as neither."""
    return sum(ratio[p][q] for p, q in pairs_of(run)) / len(run)


def all_spans(text: str, model: RandomModel) -> list[tuple[str, int, int]]:
    """Base spans and the random runs that touch none of them, by start and kind."""
    runs = long_runs(text)
    found = base_spans(text, runs)
    taken = [(s, e) for _, s, e in found]
    for lo, hi in runs:
        if mixed(text[lo:hi]) and not any(s < hi and lo < e for s, e in taken) and log_ratio(text[lo:hi], model.ratio) >= model.least:
            found.append(("random", lo, hi))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def labelled_samples(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", rows: int = 20_000) -> DataFrame:
    """Samples (value, random) for training, from about ``rows`` documents chosen by a hash of their key.

    The values of the fixed patterns are the random strings.  Ordinary ones are the other
    runs of four and more characters of the alphabet that are never reported: words, names,
    numbers and short identifiers.  Long mixed runs may be secrets and have no label.
    """
    chosen = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.col(text_col).isNotNull())
    n = max(1, docs.count())
    chosen = chosen.where(F.pmod(F.xxhash64("key", F.lit("secrets")), F.lit(1 << 20)) < int(min(1.0, rows / n) * (1 << 20)))

    def label(batches):
        import pyarrow as pa

        for batch in batches:
            values: dict[tuple[str, bool], int] = {}
            for text in batch.column(0).to_pylist():
                spans = sorted((s, e) for _, s, e in base_spans(text, long_runs(text)))
                at, plain = 0, []
                for s, e in spans:
                    plain.append(text[at:s])
                    at = max(at, e)
                    for value in re.findall(RUN, text[s:e]):
                        values[value, True] = 1
                plain.append(text[at:])
                for word in re.findall(r"[A-Za-z0-9+/_=-]{4,}", " ".join(plain)):
                    if len(word) >= 16 and mixed(word):
                        continue
                    values[word, False] = values.get((word, False), 0) + 1
            if values:
                yield pa.RecordBatch.from_pydict({"value": [v for v, _ in values], "random": [r for _, r in values], "n": pa.array(values.values(), pa.int64())})

    return chosen.select("text").mapInArrow(label, "value string, random boolean, n bigint")


def drawn(n: int = 1000, length: int = 40) -> list[str]:
    """Uniform strings of letters and digits, always the same ones."""
    import random

    dice = random.Random(7)
    return ["".join(dice.choices(ALPHABET[:SOLID], k=length)) for _ in range(n)]


def moments(values: list[str], ratio) -> tuple[float, ...]:
    """Number, and sums of s, l, s * s, s * l and l * l over strings of l characters and log ratio s in all."""
    import numpy as np

    length = np.array([len(v) for v in values], float)
    score = np.array([log_ratio(v, ratio) for v in values], float) * length
    return len(values), *(float(x.sum()) for x in (score, length, score * score, score * length, length * length))


def spread(sums) -> tuple[float, float]:
    """Mean log ratio per character, and its deviation times the root of a string's length."""
    n, s, l, ss, sl, ll = sums
    mean = s / l
    return mean, max((ss - 2 * mean * sl + mean * mean * ll) / l, 1e-9) ** 0.5


def crossing(ordinary, random) -> float:
    """The ratio as many deviations above the ordinary mean as below the random one, at any length."""
    (low, a), (high, b) = spread(ordinary), spread(random)
    return (low * b + high * a) / (a + b)


def fit(samples: DataFrame, prior_random: float = 40.0, prior_ordinary: float = 0.5) -> RandomModel:
    """Models from samples (value, random, n): counts of character pairs, added up before the shuffle.

    The random model leans to the uniform distribution by ``prior_random`` counts per
    state, so it also covers kinds of keys the samples lack; a repeated random value counts
    once.  A fifth of the values is held out; the limit lies where the ratios of held-out
    ordinary and random values cross, or those of ordinary ones and uniform strings where
    that is lower, and never below one nat a character.  Unlabelled runs have no say in it.
    """
    states = len(ALPHABET) + 1

    def count(batches):
        import numpy as np
        import pyarrow as pa

        pairs = np.zeros((2, states, states), np.int64)
        for batch in batches:
            for value, random, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for p, q in pairs_of(value):
                    pairs[int(random), p, q] += 1 if random else n
        r, p, q = np.nonzero(pairs)
        yield pa.RecordBatch.from_pydict({"random": r.astype(bool), "p": p.astype(np.int32), "q": q.astype(np.int32), "n": pairs[r, p, q]})

    known = samples.where("value IS NOT NULL AND random IS NOT NULL")
    distinct = known.groupBy("value", "random").agg(F.sum("n").alias("n"))
    out = F.pmod(F.xxhash64("value", F.lit("held out")), F.lit(5)) == 0
    cells = distinct.where(~out).mapInArrow(count, "random boolean, p int, q int, n bigint").groupBy("random", "p", "q").agg(F.sum("n").alias("n")).collect()

    import math

    seen = [[[0] * states for _ in range(states)] for _ in range(2)]
    for c in cells:
        seen[int(c["random"])][c["p"]][c["q"]] = c["n"]

    def logs(table, prior):
        uniform = prior / SOLID
        return [[math.log((n + uniform) / (sum(row) + prior)) for n in row] for row in table]

    random, ordinary = logs(seen[1], prior_random), logs(seen[0], prior_ordinary * SOLID)
    ratio = [[a - b for a, b in zip(x, y)] for x, y in zip(random, ordinary)]
    sums = ["count", "s", "l", "ss", "sl", "ll"]

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            values, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kinds = [[v for v, r in zip(values, labels) if r and mixed(v)], [v for v, r in zip(values, labels) if not r]]
            lines = [(r, *moments(k, ratio)) for r, k in zip((True, False), kinds) if k]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), (pa.bool_(), *[pa.float64()] * 6))], names=["random", *sums])

    lines = distinct.where(out).select("value", "random").mapInArrow(judge, "random boolean, " + ", ".join(f"{c} double" for c in sums))
    held = {r["random"]: tuple(r)[1:] for r in lines.groupBy("random").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    if False not in held:
        return RandomModel(ratio, 1.0)
    kinds = [moments(drawn(), ratio), *(x for label, x in held.items() if label and x[0] >= 20)]
    return RandomModel(ratio, max(1.0, round(min(crossing(held[False], k) for k in kinds), 6)))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, model: RandomModel, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``spans`` (kind, start, end in code points).

    Null texts are empty and have none.  An older column ``spans`` is replaced.
    """
    names = [c for c in docs.columns if c not in ("spans", text_col)]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("document"), F.col(text_col).cast("string").alias("text"))

    def find(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t or "", model)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["document", "spans"])

    schema = rows.select("document").schema.add("spans", rows.sparkSession.createDataFrame([], f"s {SPANS}").schema["s"].dataType)
    return rows.mapInArrow(find, schema).select("document.*", "spans").drop("_")


def redact(docs: DataFrame, model: RandomModel, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by ``mark``; null texts stay null."""
    rows = docs.select(F.struct(*docs.columns).alias("document"))

    def replace(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.RecordBatch.from_struct_array(batch.column(0))
            out = []
            for text in table.column(text_col).to_pylist():
                at, parts = 0, []
                for _, start, end in all_spans(text, model) if text else []:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            arrays = [pa.array(out, pa.string()) if c == text_col else table.column(c) for c in table.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=table.schema.names)

    return rows.mapInArrow(replace, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))
