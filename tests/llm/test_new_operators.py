"""Prefix trie, site text and tokenizer alignment against brute-force versions."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest

from factspark.llm import alignment, queries, sitetext, trie

from ..conftest import SMALL


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- 11

def plain_trie(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        paths[c] = [t[2:] for t in sorted(convs.get(base, []))[:h]] + [t[2:] for t in sorted(convs[c])[h:]]
    members = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children, leaves, spared = collections.defaultdict(list), {}, {}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        spared[p] = sum(spared[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return by_value(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], spared[p],
         hashlib.sha256(",".join(str(c) for c in members[p] if len(paths[c]) == len(p)).encode()).hexdigest())
        for p in members)


TURNS = "conv_id long, turn long, role string, text string, path string, shard int"


@pytest.mark.parametrize("shards", [1, 6, 40])
def test_trie_of_copies_and_forks(spark, shards):
    """A third of all conversations are copies, others fork; shards of a few conversations each."""
    random_ = random.Random(shards)
    rows = []
    for i in range(240):
        conv = i if i % 3 else 10**12 + i
        turns = [("u", "é")] * 5 if i % 3 == 0 else [(random_.choice(["u", None]), random_.choice(["a", "b", None]) or None) for _ in range(random_.randrange(12))]
        rows += [(conv, t, role, text, "x", 1) for t, (role, text) in enumerate(turns)]
    rows += [(None, 0, "u", "lost", "x", 1), (7, None, "u", "first", "x", 1), (-4, 3, "u", "below zero", "x", 1)]
    found = trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS).repartition(3)), shards)
    assert by_value(found.collect()) == plain_trie([r[:4] for r in rows])


def test_trie_of_nothing_and_of_long_conversations(spark):
    assert trie.prefix_trie(trie.rebuilt(spark.createDataFrame([], TURNS))).collect() == []
    rows = [(c, t, "u", "same" if t < 1500 else str(c), None, None) for c in (5, 6, 11) for t in range(1502)]
    rows += [(6, 0, "u", "same", None, None)] * 2  # ties are turns of their own
    assert by_value(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS)), 4).collect()) == plain_trie([r[:4] for r in rows])


def test_splitters_stay_within_their_bound():
    keys = [(bytes([i]) * trie.SYMBOL * 3, i) for i in range(5)]
    step = trie.skeleton(keys)
    assert len(step) == 15 and sorted(step.values()) == list(range(1, 16))
    assert trie.shared_turns(b"a" * 60, b"a" * 40 + b"b" * 20) == 2 and trie.shared_turns(b"", b"a" * 20) == 0


# ---- 12

def plain_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split()) for line in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(line for line in lines if line)


def test_site_text_of_the_pages(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = queries.op12_site_text(spark, SMALL).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in found) == sorted((i, u, plain_text(h), len(plain_text(h))) for i, (u, h) in pages.items())


def texts(spark, rows, **settings):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int, row string, host int")
    return {r.page_id: r for r in sitetext.main_text(df, **settings).collect()}


def one(spark, page):
    return texts(spark, [(1, "http://a.b/c", page, 0, "r", 0)])[1].text


@pytest.mark.parametrize("page, want", [
    ("<body class='has-sidebar'><header><h1>Site</h1></header><div id=c><article class=post><header><h1>T &amp; U</h1></header><p>One <b>two</b>&nbsp;three<p>four<br>five</article></div>", "T & U\nOne two three\nfour\nfive"),
    ("<article><p>text</p><div class='newsletter-box'>Join</div><form><p>mail</p></form><section class=comments><article><p>nice</p></article></section></article>", "text"),
    ("<main><h1>t</h1><p>a</p><aside><article class=teaser><p>other</p></article></aside></main>", "t\na"),
    ("<p>only<script>if (a<b) '</p>'</script> this</p><nav><a>n</a></nav><aside><p>z</p></aside><footer>f</footer>", "only this"),
    ("one<nav>menu<p>two<p>three", "one\ntwo\nthree"),
    ("<nav>menu<article><p>kept</article>", "kept"),
    ("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>", "a\nb\nx y\nz"),
    ("<p>a<!-- no --> b</p></div></p>c<p title='>'>d &lt;e&gt; &#233; &amp;amp;", "a b\nc\nd <e> é &amp;"),
    ("<head><title>t</title><body><p>x", "x"), ("", ""), ("<<>><p", "<<>>"), ("<div>" * 3000 + "deep", "deep"),
])
def test_shapes_of_pages(spark, page, want):
    assert one(spark, page) == want


@pytest.mark.parametrize("known", [0, 1000])
def test_recurring_subtrees_go_and_prose_of_articles_stays(spark, known):
    rows = []
    for i in range(12):
        body = f"<div><p>Free shipping</p></div><p>story {i}</p><p>same line</p>"
        inside = f"<article><p>story {i}</p><p>same line</p><div>Read it in our paper</div></article><div>beside</div>"
        rows += [(i, "http://One.example/x", body, 0, "", 0), (100 + i, "https://u@two.example:80/x", inside, 0, "", 0), (200 + i, None, body, 0, "", 0)]
        rows.append((300 + i, "http://copies.example/", "<article><div><p>a</p></div><div>b</div></article>", 0, "", 0))
    found = texts(spark, rows * 2 + [(1000, "http://one.example", None, None, None, None)], known_templates=known)
    assert len(found) == 49
    for i in range(12):
        assert found[i].text == f"story {i}" and found[i].n_cut == 2  # without an article all recurring subtrees are template
        assert found[100 + i].text == f"story {i}\nsame line"
        assert found[200 + i].text == f"Free shipping\nstory {i}\nsame line"
        assert found[300 + i].text == "a\nb"
    assert (found[1000].text, found[1000].n_chars) == ("", 0)


def test_repeated_pages_each_give_a_row_and_none_gives_none(spark):
    schema = "page_id long, url string, html string"
    assert sitetext.main_text(spark.createDataFrame([(None, None, "<p>a")] * 3, schema)).count() == 3
    assert sitetext.main_text(spark.createDataFrame([], schema)).collect() == []


# ---- 13

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names, alphabet = {i: t for t, i in a.get_vocab().items()}, alignment.byte_alphabet()

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        return ids_a, bytes_a, ids_b, bytes_b

    return tokens


def plain_alignment(rows, tokens):
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, bytes_a, ids_b, bytes_b = tokens(text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = list(np.cumsum([len(x) for x in bytes_a])), list(np.cumsum([len(x) for x in bytes_b]))
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append((ids_a[i:k], ids_b[j:m]))
                    i, j = k, m
        links = [(x, y) for a, b in groups for x in a for y in b]
        held.update(set(links))
        found.append((doc_id, groups, links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return by_value(
        (doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else "")
        for doc_id, groups, links in found)


def test_alignment_of_the_documents(spark, plain_tokens):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert by_value(queries.op13_galloping_alignment(spark, SMALL).collect()) == plain_alignment(docs, plain_tokens)


AWKWARD = [None, "", " ", "a", "  two  blanks ", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "日本語のテキスト😀😀👩‍👩‍👧", "é́İ \x1c\x85\xa0﻿x",
           "a" * 3000, "😀é" * 900, " " * 1200 + "x", "same", "same", "same", "\x00nul"]


def test_alignment_of_awkward_texts(spark, plain_tokens, monkeypatch):
    """Small blocks, a low limit for listed groups, repeated rows and clashing columns."""
    rows = [(i if i % 4 else None, t, "x", i, "b") for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a int, pairs string").repartition(2)
    monkeypatch.setattr(alignment, "LISTED", 8)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 200)
    assert by_value(alignment.align(docs, A, B).collect()) == plain_alignment([r[:2] for r in rows], plain_tokens)
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_groups_are_real_outputs(spark, plain_tokens):
    docs = spark.createDataFrame([(1, "Überraschung 😀!"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in alignment.token_groups(docs, A, B).collect()}
    ids_a, _, ids_b, _ = plain_tokens("Überraschung 😀!")
    assert (found[1].a_ids, found[1].b_ids) == (ids_a, ids_b)
    assert sum(found[1].a_sizes) == len(ids_a) and sum(found[1].b_sizes) == len(ids_b) and len(found[1].a_sizes) == len(found[1].b_sizes)
    assert found[2].a_ids == found[2].a_sizes == []


def test_fast_engine_gives_the_same_ids():
    from tokenizers import Tokenizer

    encode, _ = alignment.byte_level(A)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    random_ = random.Random(3)
    signs = list("abcXYZ0123 '.,!?-\n\t  \xa0é\xadßĀɏ€“…İ²½ª\x0b\x1c 　汉😀") + ["'s", "'LL", " the", "<|endoftext|>"]
    many = ["".join(random_.choice(signs) for _ in range(random_.randrange(40))) for _ in range(20_000)]
    assert encode(many) == [e.ids for e in whole.encode_batch_fast(many, add_special_tokens=False)]


def test_gallop_finds_the_first_end_not_smaller():
    random_ = np.random.default_rng(0)
    for _ in range(50):
        ends = np.cumsum(random_.integers(1, 4, random_.integers(1, 200)))
        x = np.sort(random_.integers(0, ends[-1] + 2, 40))
        low = np.minimum(np.searchsorted(ends, x), random_.integers(0, len(ends), 40))
        assert (alignment.gallop(x, ends, low, np.full(40, len(ends))) == np.searchsorted(ends, x)).all()


# ---- ids of texts, the ledger under filters, stages with awkward columns

@pytest.mark.parametrize("specials", [False, True])
def test_ids_of_random_texts(specials):
    """Marks, letters whose small form grows, stops, blanks of all kinds and special strings in every case."""
    from tokenizers import Tokenizer

    from factspark.llm import tokens

    whole = Tokenizer.from_file(queries.word_tokenizer())
    whole.encode_special_tokens = specials
    random_ = random.Random(1)
    signs = list("abcXYZIJKéÀßİıǰ.,;:!?'\"-()0129 \t\n\x0b\f\r\x1c\x85\xa0　汉字😀́̌̇K#@_") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "'s", "word", "Word.", "İ!", "J̌"]
    many = ["".join(random_.choice(signs) for _ in range(random_.randrange(30))) for _ in range(20_000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(many, add_special_tokens=False)]
    assert tokens.encoder(queries.word_tokenizer(), 4, specials)(many) == want


def test_ledger_stands_any_filter(spark):
    from factspark.llm import quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    book = quality.ledger(docs).where("failures = 0 AND n_words > 5").select("document.doc_id", "n_symbols")
    plan = book._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") < 10 and len(plan) < 20_000
    assert book.count() == sum(r.failures == 0 and r.n_words > 5 for r in quality.ledger(docs).collect())


def test_near_duplicates_of_awkward_rows(spark):
    """An id with two texts, null ids, and columns that bear the names the stage uses."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x", 1000), (1, b, "x", 1001), (5, a, "y", 1002), (6, b, "y", 1003), (None, c, "x", 1004), (None, c, "z", 1005), (None, c + " end", "z", 1006), (9, None, "x", 1007), (9, None, "x", 1008)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, r, "c", "i", 7) for d, t, s, r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, component string, _i string, copies int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = sorted(r.row for r in kept.collect())
    assert found[:2] == [1000, 1001] and len(found) == 5 and found[3:] == [1007, 1008] and found[2] in (1004, 1005, 1006)
    mixed = corpus_pipeline.source_mixture(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    assert {(r.row, r.text, r.copies) for r in mixed.collect()} <= {(r[3], r[1], 7) for r in rows}


def test_set_names_follow_content():
    """Equal sets have one name in every batch; a renamed set gets the same other name everywhere."""
    from factspark.llm import partenum

    texts = ["a b c d e f", None, "A B\tc d e  f", "x y", "", "q " * 40]
    n, name = partenum.named_sets(texts, 5)[1:3]
    assert n.tolist() == [2, 0, 2, 1, 0, 1] and name[0] == name[2] and len({name[0], name[3], name[5]}) == 3
    first = partenum.named_sets(texts, 5, (int(name[0]),))[2]
    again = partenum.named_sets(texts[2:], 5, (int(name[0]),))[2]
    assert first[0] == first[2] == again[0] != name[0] and first[3] == name[3] and first[5] == name[5]


def test_links_of_a_leader_in_many_pairs(spark, monkeypatch):
    """A row in many pairs is dealt in copies; links equal those of plain sets; scratch tables go."""
    import os

    from factspark.llm import partenum
    from factspark.llm.common import bucketed, discard

    monkeypatch.setattr(partenum, "PAIRS_PER_COPY", 3)
    held = {0: set(range(40)), **{i: set(range(i % 15, 40 + i % 4)) for i in range(1, 60)}}
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)]
    sets = bucketed(spark.createDataFrame([(r, sorted(x)) for r, x in held.items()], "row long, items array<long>"), "held", "row")
    links = partenum.linked(spark.createDataFrame(pairs, "a long, b long"), sets, 75)
    wanted = {(a, b) for a, b in pairs if 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])}
    assert {tuple(r) for r in links.collect()} == wanted and 0 < len(wanted) < len(pairs) and links.count() == len(wanted)
    discard(sets, links)
    assert not spark.catalog.tableExists(sets.scratch_entry)
    assert not os.path.exists(sets.scratch_folder.removeprefix("file:")) and not os.path.exists(links.scratch_folder.removeprefix("file:"))


def test_hashing_needs_little_memory():
    """A worker hashes a batch of texts in parts of a few MB, whatever their number."""
    import tracemalloc

    import pyarrow as pa

    from factspark.llm import partenum

    dice = random.Random(3)
    texts = [" ".join(dice.choices(["alpha", "be", "gamma", "delta5", "x"], k=400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    for part in partenum.text_parts(batch):
        h, n, _, _ = partenum.named_sets(part.column("text").to_pylist(), 5)
        partenum.signatures(h, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_common_features_without_a_row_per_feature(spark, monkeypatch):
    """Rows with three quarters of their features in other rows; no join on features."""
    from factspark.llm import partenum

    dice = random.Random(5)
    held = {i: set(range(i % 7 * 30, i % 7 * 30 + 20)) | {dice.randrange(1000, 1400) for _ in range(i % 12)} for i in range(90)}
    held |= {100 + i: set(range(5000 + 9 * i, 5000 + 9 * i + 12)) for i in range(4)}
    want = dict(held)
    for _ in range(3):
        count = collections.Counter(x for s in want.values() for x in s)
        common = {r: sum(count[x] > 1 for x in s) for r, s in want.items()}
        want = {r: s for r, s in want.items() if 4 * common[r] >= 3 * len(s)}
    plans, saved = [], partenum.saved
    monkeypatch.setattr(partenum, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name))
    sets = spark.createDataFrame([(r, sorted(x)) for r, x in held.items()], "row long, items array<long>")
    got = partenum.common_features(sets.select("row"), sets).collect()
    assert {(r.row, r.n, r.common) for r in got} == {(r, len(s), common[r]) for r, s in want.items()} and 0 < len(want) < len(held)
    assert plans and not any("Join" in line and "item#" in line for p in plans for line in p.splitlines())
