"""Every operator against a brute-force version, on the smallest tables and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspark.llm import language, mixing, neighbours, packing, partenum, quality, queries, secrets, sharding, tokenfiles, tokenindex, tokenscan
from factspark.llm.common import documents, numbered, saved
from factspark.llm.components import components, stars

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["op1_power_of_two_packing", "op2_token_store", "op3_rendezvous_shards", "op4_separator_counts", "op5_language_profiles",
         "op6_systematic_mix", "op7_markov_secrets", "op8_rule_ledger", "op9_partenum_join"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two three", "en", "b"), (5, "one two three", "en", "b"), (5, "one two three", "en", "b"),
    (None, "one TWO three", "en", None), (6, "word " * 30_000, "de", "b"), (7, "x", "", "c"), (8, "12 34 !! <|endoftext|>", "en", "c"),
    (9, "\x1ca b c é \U0001F600 İK", "fr", "a"), (None, None, None, None), (10, "token: secret=abcdefgh1 password: token: abcdefgh123", "en", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder whose documents hold nulls, blanks, repeats, a long text and columns with clashing names."""
    rows = [(*r, 1, "n", 2.0, i, "c", 3) for i, r in enumerate(AWKWARD)]
    schema = "doc_id long, text string, lang string, source string, size int, rank string, score double, row long, spans string, shard int"
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def run(spark, name, folder=SMALL):
    return getattr(queries, name)(spark, folder).collect()


@pytest.mark.parametrize("name", [*NAMES, "op10_kmeans_tree"])
def test_empty_table(spark, nothing, name):
    assert run(spark, name, nothing) == []


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_all_return(spark, awkward, name):
    rows = run(spark, name, awkward)
    assert {r.doc_id for r in rows} == {r[0] for r in AWKWARD}
    if name != "op1_power_of_two_packing":
        assert len(rows) == len(AWKWARD)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("where", ["small", "awkward"])
def test_packing(spark, docs, awkward, tokenizer, where):
    folder = SMALL if where == "small" else awkward
    pieces, seen, buckets = collections.defaultdict(list), set(), collections.defaultdict(list)
    for r in run(spark, "op1_power_of_two_packing", folder):
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert r.sequence_id not in seen
        seen.add(r.sequence_id)
        buckets[r.sequence_id >> packing.BUCKET_AT, r.sequence_id >> packing.TASK_AT].append((r.sequence_id % (1 << packing.TASK_AT), r.length))
        pieces[r.doc_id].append(r)
    want = collections.defaultdict(list)
    for r in documents(spark, folder).select("doc_id", "text").collect():
        want[r.doc_id].append(ids_of(tokenizer, r.text))
    for doc, found in pieces.items():
        expected = []
        for ids in want[doc]:
            at = 0
            for n in packing.cut(len(ids), 2048):
                expected.append((at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
                at += n
            assert at == len(ids)
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(expected)
    for (bucket, _), held in buckets.items():
        assert [place for place, _ in sorted(held)] == list(range(len(held))) and {n for _, n in held} == {1 << bucket}


def test_buckets_are_ranges_of_ids(spark, docs, tokenizer, tmp_path):
    """Written folders, the report and the ranges of ids name the same sequences."""
    packed = saved(packing.pack(docs.repartition(5), queries.word_tokenizer(), 1, longest=64), "packed")
    packing.write_buckets(packed, f"{tmp_path}/buckets")
    report = {r.length: (r.n_sequences, r.n_tokens) for r in packing.bucket_report(packed).collect()}
    assert set(report) <= {1 << b for b in range(7)} and sum(n for _, n in report.values()) == sum(len(ids_of(tokenizer, r.text)) for r in docs.select("text").collect())
    for length, (n, tokens) in report.items():
        bucket = length.bit_length() - 1
        held = spark.read.parquet(f"{tmp_path}/buckets/length={length}")
        assert held.where(packing.bucket_of(F.col("sequence_id")) == bucket).count() == n == tokens // length
        assert held.where(F.octet_length("ids") != 4 * length).count() == 0
        tasks = held.groupBy(F.shiftright("sequence_id", packing.TASK_AT)).agg(F.count("*").alias("n"), F.max(packing.place_of(F.col("sequence_id"))).alias("last")).collect()
        assert all(t.last == t.n - 1 for t in tasks)


@pytest.mark.parametrize("where", ["small", "awkward"])
def test_token_store(spark, awkward, tokenizer, where):
    folder = SMALL if where == "small" else awkward
    rows = sorted(run(spark, "op2_token_store", folder), key=lambda r: r.start)
    want = collections.Counter()
    for r in documents(spark, folder).select("doc_id", "text").collect():
        ids = ids_of(tokenizer, r.text)
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_token_store_lacks_other_keys(spark, docs, tmp_path):
    kept = tokenindex.write_store(docs.where("doc_id < 50"), str(tmp_path), queries.word_tokenizer(), 1, keys_per_bucket=7)
    found = tokenindex.lookup(kept, docs.where("doc_id >= 40")).select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == list(range(40, 50))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 1 << 63, (2, 5000), np.uint64)
    sizes, bits = tokenindex.build_mph(h1, h2)
    assert sorted(tokenindex.find_mph(sizes, bits, h1, h2)) == list(range(5000))


def test_shards(spark, texts):
    rows = run(spark, "op3_rendezvous_shards")
    slots = collections.defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(8)) and any(r.grown_shard == 8 for r in rows)


def test_weights_and_repeats_of_shards(spark):
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("k"))
    placed = sharding.shard_rows(rows, "k", [1, 3, 0], joining=2.0).collect()
    count = collections.Counter(r.shard for r in placed)
    assert set(count) == {0, 1} and abs(count[1] / len(placed) - 0.75) < 0.02
    assert abs(sum(r.grown_shard == 3 for r in placed) / len(placed) - 1 / 3) < 0.02
    assert len({(r.shard, r.slot) for r in placed}) == 40_000


def test_numbering_in_blocks(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("o"), (F.col("id") % 600).alias("x"))
    got = numbered(rows, ["g"], [("o", True)], rows_per_block=7).collect()
    for g in range(3):
        line = sorted((r.rank, r.copies, r.o) for r in got if r.g == g)
        at, last = 0, 9
        for rank, copies, o in line:
            assert rank == at and o <= last
            at, last = at + copies, o
        assert at == 1000


@pytest.mark.parametrize("block", [16, 97, 1 << 20])
def test_separator_scan(spark, docs, tokenizer, block, tmp_path):
    tokenizer.encode_special_tokens = True
    folder = str(tmp_path)
    names = saved(tokenfiles.write_flat(docs.limit(40), folder, queries.word_tokenizer(), 49407, 2, "doc_id", "text", False, True), "names")
    counts = tokenscan.token_counts(spark, folder, 49407, block=block).join(names.select("file", "ordinal", "doc_id"), ["file", "ordinal"]).collect()
    tokenizer.encode_special_tokens = False
    want = {r.doc_id: len(ids_of(tokenizer, r.text)) for r in docs.collect()}
    assert len(counts) == 40 and all(r.closed and r.n_tokens == want[r.doc_id] for r in counts)


def test_separator_scan_of_an_open_end(spark, tmp_path):
    np.array([5, 9, 5, 5, 9, 9, 5], "<u2").tofile(tmp_path / "a.ids")
    np.array([5, 5, 5, 5, 5], "<u2").tofile(tmp_path / "b.ids")
    np.array([], "<u2").tofile(tmp_path / "c.ids")
    rows = tokenscan.token_counts(spark, str(tmp_path), 9, block=2).collect()
    got = sorted((r.file, r.ordinal, r.start, r.n_tokens, r.closed) for r in rows)
    assert got == [("a.ids", 0, 0, 2, True), ("a.ids", 1, 2, 3, True), ("a.ids", 2, 5, 1, True), ("a.ids", 3, 6, 1, False), ("b.ids", 0, 0, 5, False)]


def test_languages(spark, awkward):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, folder).collect()}
    rows = [r for r in run(spark, "op5_language_profiles", folder) if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    odd = {r.doc_id: r for r in run(spark, "op5_language_profiles", awkward)}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3)) and odd[7].lang_pred != "und"


def test_bundles_add_bound_trigrams():
    text = "ab ab"
    letters = dict(zip("ab ", language.letter_vectors([97, 98, 32])))
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in ["ab ", "b a", " ab"])
    assert np.array_equal(next(language.bundles([text]))[0], want)


def brute_mix(rows, weights):
    sizes = collections.Counter()
    for _, source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        free -= full
    return sizes, target


@pytest.mark.parametrize("where", ["small", "awkward"])
def test_mixture(spark, awkward, where):
    folder = SMALL if where == "small" else awkward
    rows = run(spark, "op6_systematic_mix", folder)
    base = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in documents(spark, folder).collect()]
    assert collections.Counter(base) == collections.Counter((r.doc_id, r.source, r["size"]) for r in rows)
    sizes, target = brute_mix(base, queries.MIX_WEIGHTS)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, "op6_systematic_mix", folder)))


def brute_base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


@pytest.mark.parametrize("where", ["/root/testdata/sf0.01", "awkward"])
def test_secrets(spark, awkward, where):
    folder = awkward if where == "awkward" else where
    want = collections.Counter()
    for r in documents(spark, folder).collect():
        base = brute_base(r.text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        want[r.doc_id, *(sum(k == kind for k, _, _ in base) for kind in secrets.BASE_KINDS), digest] += 1
    got = run(spark, "op7_markov_secrets", folder)
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_random_strings_are_told_from_words(spark, docs):
    model = secrets.fit(secrets.labelled_samples(documents(spark, "/root/testdata/sf0.01")))
    rng = np.random.default_rng(1)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(alphabet, 40)) for _ in range(200)]
    caught = sum(any(k == "random" for k, _, _ in secrets.all_spans(f"the value {key} is", model)) for key in keys)
    assert caught >= 190
    found = secrets.scan(docs, model).select(F.explode("spans").alias("s")).where("s.kind = 'random'").count()
    assert found == 0
    hidden = docs.sparkSession.createDataFrame([(1, f"a {keys[0]} b token = \"{'0f' * 20}\" c", 3), (2, None, 0)], "doc_id long, text string, n_chars long")
    rows = secrets.redact(hidden, model).orderBy("doc_id").collect()
    assert rows[0].text == "a [secret] b [secret]\" c" and rows[1].text is None


def test_bare_keys_of_the_fitted_documents_are_found(spark, tmp_path):
    """Keys without a keyword, some in many copies, in the very rows the model is fitted on; identifiers stay."""
    rng = np.random.default_rng(5)
    keys = ["".join(rng.choice(list(secrets.ALPHABET[: secrets.SOLID]), 40)) for _ in range(60)]
    keys = [k for k in keys if secrets.mixed(k)]
    rows = [(r.doc_id, r.text or "") for r in documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    words = sorted({w for _, t in rows for w in re.findall(r"[a-z]{6,12}", t)})
    names = ["_".join(rng.choice(words, 3)) + f"_{i}" for i in range(60)]
    planted = [(10**9 + i, f"{rows[i][1][:500]} \n{keys[i % len(keys)]}\n {names[i % 60]}") for i in range(300)]
    folder = str(tmp_path)
    spark.createDataFrame(rows + planted, "doc_id long, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    text = dict(planted)
    found = collections.Counter()
    for r in run(spark, "op7_markov_secrets", folder):
        for kind, start, end in (s.split(":") for s in r.spans.split(",") if s):
            if kind == "random":
                found[r.doc_id, text.get(r.doc_id, "")[int(start) : int(end)]] += 1
    assert found == collections.Counter((10**9 + i, keys[i % len(keys)]) for i in range(300))


def brute_repeats(words):
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


@pytest.mark.parametrize("where", ["/root/testdata/sf0.01", "awkward"])
def test_quality(spark, awkward, where):
    folder = awkward if where == "awkward" else where
    want = collections.Counter()
    for r in documents(spark, folder).collect():
        text = r.text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = brute_repeats(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        want[r.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, failed] += 1
    rows = run(spark, "op8_rule_ledger", folder)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_keep_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.ledger(documents(spark, folder)).select("document.doc_id", "n_words", quality.kept(queries.POLICY).alias("kept"), quality.kept("base-1").alias("base"))
    judged = rows.join(good, "doc_id").where("base").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in judged}
    assert share[1] > 0.999 and share[0] < 0.2


def test_ablations(spark, docs):
    book = quality.ledger(docs).cache()
    masks = [r.failures for r in book.collect()]
    for r in quality.ablations(book).collect():
        policy, bit = quality.policy_mask(r.policy), quality.BIT[r.rule]
        assert r.n_failing == sum(bool(m & bit) for m in masks)
        assert r.n_rejected == sum(bool(m & policy) for m in masks)
        assert r.n_only_here == sum(m & policy == bit for m in masks)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                top[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    least = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return collections.Counter((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("where", [SMALL, "awkward"])
def test_jaccard_join(spark, awkward, where):
    folder = awkward if where == "awkward" else where
    rows = [(r.doc_id, r.text) for r in documents(spark, folder).collect()]
    got = run(spark, "op9_partenum_join", folder)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def near_copies(seed, groups, copies, words, edits):
    """Groups of texts with a shared passage, each group a chain of edited copies, and pairs at the threshold."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for g in range(groups):
        n = int(rng.integers(3, words))
        base = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
        if g % 2:
            base[n // 2 : n // 2] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, max(1, int(edits * len(base)))))):
                text[int(rng.integers(len(text)))] = f"e{rng.integers(1 << 40)}"
            rows.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("seed,groups,copies,words,edits", [(1, 60, 6, 150, 0.06), (2, 3, 150, 90, 0.05), (3, 80, 5, 25, 0.1)])
def test_jaccard_join_of_near_copies(spark, tmp_path, seed, groups, copies, words, edits):
    rows = near_copies(seed, groups, copies, words, edits)
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    got = partenum.near_groups(spark.read.parquet(path)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("edges, want", [
    ([], True), ([(1, 2), (1, 3), (4, 5)], True), ([(1, 2), (2, 3)], False), ([(1, 3), (2, 3)], False), ([(1, 4), (1, 5), (2, 3), (2, 5)], False),
])
def test_stars(spark, edges, want):
    table = spark.createDataFrame(edges, "a long, b long")
    assert stars(table) == want
    assert all(r.component <= r.node for r in components(table).collect())


def exact_neighbours(rows, k):
    kept = {i: np.array(v, np.float64) for i, v in rows}
    names = np.array(sorted(kept))
    table = np.stack([kept[i] for i in names])
    out = {}
    for q in names[names % 20 == 0]:
        score = table @ kept[q]
        order = [j for j in np.lexsort((names, -score)) if names[j] != q][:k]
        out[int(q)] = [(int(names[j]), score[j]) for j in order]
    return out


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, hits, total = exact_neighbours(rows, 20), 0, 0
    got = collections.defaultdict(list)
    kept = dict(rows)
    for r in run(spark, "op10_kmeans_tree", folder):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert math.isclose(r.score, float(np.dot(np.array(kept[r.query_id], float), np.array(kept[r.vec_id], float))), rel_tol=1e-9, abs_tol=1e-12)
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len({i for i, _ in best} & {i for _, i, _ in found})
        total += 20
    assert hits / total >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(40, [2.0, -1.0]), (40, [2.0, -1.0]), (60, None), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [1.0, float("nan")]), (None, [1.0, 1.0]), (41, [0.5, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    lists = collections.defaultdict(list)
    for r in got:
        lists[r.query_id].append(r.vec_id)
    assert set(lists) == {0, 20, 40}
    assert lists[0] == list(range(1, 21)) and lists[20] == [i for i in range(21) if i != 20]
    assert lists[40] == [41, *range(19)]


def test_compared_pairs_are_left_out_by_one_join(spark):
    from factspark.llm import partenum

    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    tables = [spark.createDataFrame(rows, "a long, b long") for rows in ([(0, 1), (4, 5)], [(4, 5), (7, 9)], [(8, 9)])]
    left = partenum.without(pairs, tables)
    assert sorted(r.a for r in left.collect()) == [1, 2, 3, 5, 6, 7]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1
    assert partenum.without(pairs, []) is pairs
