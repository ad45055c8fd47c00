"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20250101
#: Characters and distinct n-grams handled at once in a task.
PART_CHARS = 2_000_000
PART_GRAMS = 8192


@dataclass(frozen=True)
class Profiles:
    """One unit prototype per language, rows in the order of ``langs``."""

    langs: list[str]
    prototypes: list[list[float]]


def letter_vectors(points):
    """A random vector of +-1 for each code point, the same in every task."""
    import numpy as np

    bits = np.empty((len(points), DIMENSIONS), np.float32)
    for row, point in enumerate(points):
        words = np.random.Generator(np.random.Philox(key=SEED, counter=int(point))).integers(0, 256, DIMENSIONS // 8, np.uint8)
        bits[row] = np.unpackbits(words)
    return bits * 2 - 1


def trigrams(text: str):
    """Distinct letter trigrams of a text and their counts, as packed code points.

    Text is lower-cased; everything that is no letter counts as a space, and a trigram with
    more than one space is left out.  Long texts are counted in slices that overlap by two.
    """
    import numpy as np

    found, counts = [], []
    for lo in range(0, max(1, len(text) - 2), PART_CHARS):
        points = np.frombuffer(text[lo : lo + PART_CHARS + 2].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = np.where(letters()[np.minimum(points, 0x30000)], points, 32)
        a, b, c = points[:-2], points[1:-1], points[2:]
        use = (a == 32).astype(np.int8) + (b == 32) + (c == 32) <= 1
        grams, n = np.unique((a[use] << 42) | (b[use] << 21) | c[use], return_counts=True)
        found.append(grams)
        counts.append(n)
    if len(found) == 1:
        return found[0], counts[0]
    grams, at = np.unique(np.concatenate(found), return_inverse=True)
    return grams, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def letters():
    """A table of which code points are letters (the last entry stands for all rare planes)."""
    import sys

    import numpy as np

    kept = sys.modules["numpy"].__dict__
    if "_letter_table" not in kept:
        kept["_letter_table"] = np.array([chr(p).isalpha() for p in range(0x30000)] + [True])
    return kept["_letter_table"]


def bundles(texts: list[str]) -> Iterator:
    """The document vectors of ``texts`` in order, a block of rows at a time.

    A trigram's vector binds the vectors of its letters, the first permuted (rotated) twice
    and the second once; a document bundles (adds) those of all its trigrams.
    """
    import numpy as np

    at = 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and upto < at + 1000 and (upto == at or chars + len(texts[upto]) <= PART_CHARS):
            chars += len(texts[upto])
            upto += 1
        each = [trigrams(t) for t in texts[at:upto]]
        grams, place = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        owner = np.repeat(np.arange(len(each)), [len(g) for g, _ in each])
        counts = np.concatenate([n for _, n in each])
        out = np.zeros((len(each), DIMENSIONS), np.float32)
        parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
        points, index = np.unique(np.concatenate(parts), return_inverse=True)
        one = letter_vectors(points)
        turned = [np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one]
        index = index.reshape(3, -1)
        for lo in range(0, len(grams), PART_GRAMS):
            cut = slice(lo, lo + PART_GRAMS)
            bound = turned[0][index[0, cut]] * turned[1][index[1, cut]] * turned[2][index[2, cut]]
            dense = np.zeros((len(each), bound.shape[0]), np.float32)
            inside = (place >= lo) & (place < lo + PART_GRAMS)
            dense[owner[inside], place[inside] - lo] = counts[inside]
            out += dense @ bound
        yield out
        at = upto


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", rows_per_lang: int = 4000) -> Profiles:
    """Prototypes from labelled rows: the sum of each language's unit document vectors.

    Rows without text or label are left out.  At most about ``rows_per_lang`` rows of a
    language are used, chosen by a hash of their key; beyond that a prototype no longer
    changes.  Tasks add vectors per language before the shuffle.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a line per label
    if not counts:
        return Profiles([], [])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_lang / n)))])
    uniform = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(uniform < F.element_at(share, F.col("lang"))).select("lang", "text")

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[str, object] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for block in bundles(texts):
                norms = np.linalg.norm(block, axis=1, keepdims=True)
                block = block / np.maximum(norms, 1e-9)
                for row in block:
                    sums[langs[at]] = sums.get(langs[at], 0) + row.astype(np.float64)
                    at += 1
        if sums:
            names = list(sums)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([x for x in names for _ in range(DIMENSIONS)]),
                "d": pa.array(list(range(DIMENSIONS)) * len(names), pa.int32()), "v": pa.array(np.concatenate([sums[x] for x in names])),
            })

    parts = chosen.mapInArrow(add, "lang string, d int, v double")
    total = parts.groupBy("lang", "d").agg(F.sum(F.round("v", 6)).alias("v"))
    vectors = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "v")))["v"].alias("vector")).collect()
    langs, prototypes = [], []
    for r in sorted(vectors, key=lambda r: r["lang"]):
        size = sum(x * x for x in r["vector"]) ** 0.5
        if size > 0:
            langs.append(r["lang"])
            prototypes.append([x / size for x in r["vector"]])
    return Profiles(langs, prototypes)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``lang_pred`` and ``score`` (cosine with the nearest prototype).

    The nearest prototype wins, ties by name; a negative cosine counts as 0.  Null texts and
    texts without a letter are ``und`` with score 0, as is every text if nothing was learnt.
    Texts are framed by spaces, so a single letter has a trigram.  Older columns of the two
    names are replaced; the text does not travel back from the tasks.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("document"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("document").schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        import numpy as np
        import pyarrow as pa

        prototypes = np.array(profiles.prototypes, np.float32).reshape(len(profiles.langs), DIMENSIONS)
        for batch in batches:
            texts = [t if t is not None else "" for t in batch.column(1).to_pylist()]
            langs, scores = [], []
            if profiles.langs:
                for block in bundles([f" {t} " for t in texts]):
                    cosine = block @ prototypes.T / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
                    best = cosine.argmax(axis=1)
                    langs += [profiles.langs[b] for b in best]
                    scores += cosine[np.arange(len(best)), best].astype(float).tolist()
            else:
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, t in enumerate(texts):
                if not any(map(str.isalpha, t)):
                    langs[i], scores[i] = "und", 0.0
            scores = np.clip(scores, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["document", "lang_pred", "score"])

    return rows.mapInArrow(score, schema).select("document.*", "lang_pred", "score").drop("_")


def held_out(key: Column) -> Column:
    """The rows kept from training: crc32 of the key as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2
