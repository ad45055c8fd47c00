"""Alignment of two tokenizers over the same texts by galloping through their token ends.

Byte offsets where a token of both tokenizers ends cut a text into groups; tokens of a group
belong together.  Documents of a block are laid end to end, so each step works on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Characters of text in one block: what a task holds at once (a longer text is a block alone).
BLOCK_CHARS = 4_000_000
#: Rows in a block, where texts are short.
BLOCK_ROWS = 20_000
#: Every so-manieth token looks for its place from the document's start, the rest from there.
ANCHOR = 32
#: Links of a group up to which they are listed one by one; a larger group is multiplied out by distinct ids.
LISTED = 4096


def gallop(x, ends, low, high):
    """For each x the first index in [low, high) whose end is not smaller, arrays throughout.

    Exponential steps from ``low`` bracket the place, halving finds it; an x larger than
    all ends of its range gives ``high``.
    """
    import numpy as np

    low, top = low.copy(), high.copy()
    open_rows, step = np.flatnonzero(low < top), 1
    while len(open_rows):
        probe = np.minimum(low[open_rows] + step - 1, high[open_rows] - 1)
        less = ends[probe] < x[open_rows]
        top[open_rows[~less]] = probe[~less]
        low[open_rows[less]] = probe[less] + 1
        open_rows = open_rows[less]
        open_rows = open_rows[low[open_rows] < high[open_rows]]
        step *= 2
    open_rows = np.flatnonzero(low < top)
    while len(open_rows):
        middle = (low[open_rows] + top[open_rows]) >> 1
        less = ends[middle] < x[open_rows]
        low[open_rows[less]] = middle[less] + 1
        top[open_rows[~less]] = middle[~less]
        open_rows = open_rows[low[open_rows] < top[open_rows]]
    return low


def common_ends(short, starts, long, long_starts, documents):
    """Index pairs (in ``short``, in ``long``) of equal ends, for the numbered documents.

    ``starts`` and ``long_starts`` give where each document's ends begin (one more for the
    last one's end); ends of a later document are larger.  First every ANCHOR-th end gallops
    from the start of its document, then those between two of them from the place of the first.
    """
    import numpy as np

    sizes = np.diff(starts)[documents]
    first = starts[documents]
    owner = np.repeat(np.arange(len(documents)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = at + first[owner]
    low, high = long_starts[documents][owner], long_starts[documents + 1][owner]
    anchors = at % ANCHOR == 0
    place = np.empty(len(index), np.int64)
    place[anchors] = gallop(short[index[anchors]], long, low[anchors], high[anchors])
    seen = np.cumsum(anchors) - 1
    others = ~anchors
    place[others] = gallop(short[index[others]], long, place[anchors][seen[others]], high[others])
    hit = np.flatnonzero(place < high)
    hit = hit[long[place[hit]] == short[index[hit]]]
    return index[hit], place[hit]


def groups_of(a_ends, a_starts, b_ends, b_starts):
    """Last token of each group in both lists, in text order; the shorter list of a document drives."""
    import numpy as np

    fewer = np.diff(a_starts) <= np.diff(b_starts)
    a1, b1 = common_ends(a_ends, a_starts, b_ends, b_starts, np.flatnonzero(fewer))
    b2, a2 = common_ends(b_ends, b_starts, a_ends, a_starts, np.flatnonzero(~fewer))
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


# ---- tokenizers: functions from texts to lists of ids, and the bytes of each id

#: Texts of Latin letters, signs and plain spaces, on which both engines of the byte-level tokenizer split alike (tested).
PLAIN = re.compile(r"[\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€\n\t]*")
#: Long runs of one class go to the original engine.
RUN = re.compile(r"\s{500}|[^\s]{2000}")
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """A byte-level BPE file of the tokenizers library.

    Strings of special tokens are ordinary text.  Plain texts are encoded by the same merges
    in a faster engine where the file's ids are in merge order.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet, vocabulary = byte_alphabet(), tokenizer.get_vocab()
    own = json.loads(tokenizer.to_str())
    special = {t["content"] for t in own["added_tokens"]}
    table = [b""] * tokenizer.get_vocab_size()
    for token, i in vocabulary.items():
        table[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)

    def whole(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    merges = [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
    numbers = [vocabulary["".join(m)] for m in merges]
    steps = own["pre_tokenizer"]
    known = steps["type"] == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"] and own["normalizer"] is None
    if not known or numbers != sorted(numbers):
        return whole, table
    ranks = {table[i]: i for token, i in vocabulary.items() if token not in special}
    engine = tiktoken.Encoding("aligned", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def split(texts):
        plain = [bool(PLAIN.fullmatch(t)) and not RUN.search(t) for t in texts]
        rest = iter(whole([t for t, p in zip(texts, plain) if not p]))
        return [engine.encode_ordinary(t) if p else next(rest) for t, p in zip(texts, plain)]

    return split, table


def pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """A sentencepiece model; a text gets the space before it from the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), table


def _chunks(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


class Aligned:
    """The groups of a block of texts, as arrays over all its documents."""

    def __init__(self, texts: list[str | None], a, b):
        import numpy as np

        (encode_a, bytes_a), (encode_b, bytes_b) = a, b
        size_a, size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (bytes_a, bytes_b))
        lists_a, lists_b = [], []
        for part in _chunks(texts, 1_000_000):
            given = [t for t in part if t]
            ids = iter(zip(encode_a([" " + t for t in given]), encode_b(given), given))
            for text in part:
                pair = next(ids) if text else None
                if pair:
                    plain = (" " + text).encode()
                    if b"".join(map(bytes_a.__getitem__, pair[0])) != plain or b"".join(map(bytes_b.__getitem__, pair[1])) != plain:
                        pair = None
                lists_a.append(pair[0] if pair else [])
                lists_b.append(pair[1] if pair else [])
        self.a_starts, self.b_starts = (np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64) for lists in (lists_a, lists_b))
        self.a, self.b = (np.fromiter((i for x in lists for i in x), np.int64, starts[-1]) for lists, starts in ((lists_a, self.a_starts), (lists_b, self.b_starts)))
        a_last, b_last = groups_of(np.cumsum(size_a[self.a]), self.a_starts, np.cumsum(size_b[self.b]), self.b_starts)
        self.a_stops, self.b_stops = a_last + 1, b_last + 1
        self.a_from, self.b_from = (np.concatenate([[0], s[:-1]]).astype(np.int64) if len(s) else s for s in (self.a_stops, self.b_stops))
        self.owner = np.searchsorted(self.a_starts, a_last, "right") - 1
        self.n_links = (self.a_stops - self.a_from) * (self.b_stops - self.b_from)

    def per_document(self, values):
        import numpy as np

        return np.bincount(self.owner, values, len(self.a_starts) - 1).astype(np.int64) if len(self.owner) else np.zeros(len(self.a_starts) - 1, np.int64)

    def digests(self, names: list[bytes], n_a: int) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` per document; '' without tokens."""
        import hashlib

        import numpy as np

        codes = np.empty(len(self.a) + len(self.b), np.int64)
        n_b = (len(names) - 2 * n_a) // 2
        a_of, b_of = (np.repeat(np.arange(len(stops)), stops - begin) for stops, begin in ((self.a_stops, self.a_from), (self.b_stops, self.b_from)))
        a_names, b_names = self.a.copy(), self.b + 2 * n_a
        a_names[self.a_stops - 1] += n_a
        b_names[self.b_stops - 1] += n_b
        codes[np.arange(len(self.a)) + self.b_from[a_of]] = a_names
        codes[np.arange(len(self.b)) + self.a_stops[b_of]] = b_names
        cuts = (self.a_starts + self.b_starts).tolist()
        listed = codes.tolist()
        return [hashlib.sha256(b"".join(map(names.__getitem__, listed[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]

    def links(self, n_b: int):
        """Distinct (document, id pair) of the block with their numbers of links; a pair is a * n_b + b."""
        import numpy as np

        small = np.flatnonzero(self.n_links <= LISTED)
        n = self.n_links[small]
        group = np.repeat(small, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (self.b_stops - self.b_from)[group]
        pair = self.a[self.a_from[group] + within // width] * n_b + self.b[self.b_from[group] + within % width]
        owners, pairs, counts = [self.owner[group]], [pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(self.n_links > LISTED):
            ids_a, times_a = np.unique(self.a[self.a_from[g] : self.a_stops[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.b_from[g] : self.b_stops[g]], return_counts=True)
            pairs.append((ids_a[:, None] * n_b + ids_b).ravel())
            counts.append((times_a[:, None] * times_b).ravel())
            owners.append(np.full(len(pairs[-1]), self.owner[g]))
        owners, pairs, counts = map(np.concatenate, (owners, pairs, counts))
        order = np.lexsort((pairs, owners))
        owners, pairs, counts = owners[order], pairs[order], counts[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (pairs[1:] != pairs[:-1])
        first = np.flatnonzero(new)
        return owners[first], pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ids of both tokenizers and how many of each a group holds.

    Rows: doc_id, a_ids, b_ids, a_sizes, b_sizes (arrays; one size per group, in text order).
    Texts that are null or empty, or that a tokenizer does not keep byte for byte, have empty lists.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a, b = byte_level(byte_path), pieces(piece_path)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in _chunks(texts, BLOCK_CHARS):
                found = Aligned(part, a, b)
                stops = np.searchsorted(found.owner, np.arange(len(part) + 1))
                lists = [[x[i:j] for i, j in zip(cuts, cuts[1:])] for x, cuts in (
                    (found.a, found.a_starts), (found.b, found.b_starts), (found.a_stops - found.a_from, stops), (found.b_stops - found.b_from, stops))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])
                at += len(part)

    lists = ", ".join(f"{c} array<bigint>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, {lists}")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of every document and how usual its links are in the whole corpus.

    Rows: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.  A link
    is a pair of token occurrences in one group; an id pair counts the rows that hold it, and a
    link is best if no pair of its first id counts more.  Repeated rows count each, other
    columns are left out, an empty table gives no rows.

    Tasks cut their documents into blocks of BLOCK_CHARS characters.  A block sends each of its
    distinct pairs once to be counted and gets the counts back, so an id pair that every text
    holds is one row per block, whatever the number of documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        a, b = byte_level(byte_path), pieces(piece_path)
        n_a, n_b = len(a[1]), len(b[1])
        names = [b"%d%s" % (i, c) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for c in marks for i in range(n)]
        block = TaskContext.get().partitionId() << 33
        fields = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "holders"]

        def packed(x, kinds):
            small = next(k for k in kinds if not len(x) or x.max() < 1 << 8 * int(k[2:]))
            return x.astype(small).tobytes()

        def made(ids, texts, block):
            found = Aligned(texts, a, b)
            owners, pairs, counts = found.links(n_b)
            distinct, places, holders = np.unique(pairs, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(owners, np.arange(len(texts) + 1)).tolist()
            rows = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
            numbers = (np.diff(found.a_starts), np.diff(found.b_starts), found.per_document(np.ones(len(found.owner))), found.per_document(found.n_links))
            lines = [
                pa.array([block] * len(texts), pa.int64()), ids, *[pa.array(x, pa.int64()) for x in numbers], pa.array(found.digests(names, n_a)),
                pa.array([packed(places[r], ["<u4"]) for r in rows], pa.binary()), pa.array([packed(counts[r], ["<u1", "<u4", "<u8"]) for r in rows], pa.binary()),
                *[pa.nulls(len(texts), pa.list_(pa.int64()))] * 2,
            ]
            yield pa.RecordBatch.from_arrays(lines, names=fields)
            line = [
                pa.array([block], pa.int64()), pa.nulls(1, ids.type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2,
                pa.array([distinct], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(line, names=fields)

        ids, texts, size = [], [], 0
        for batch in batches:
            at = 0
            for part in _chunks(batch.column(1).to_pylist(), BLOCK_CHARS // 4):
                length = sum(len(t or "") for t in part)
                if texts and (size + length > BLOCK_CHARS or len(texts) > BLOCK_ROWS):
                    yield from made(pa.concat_arrays(ids), texts, block)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(batch.column(0).slice(at, len(part)))
                texts += part
                size += length
                at += len(part)
        if texts:
            yield from made(pa.concat_arrays(ids), texts, block)

    schema = (f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "places binary, times binary, pairs array<bigint>, holders array<bigint>")
    cut_rows = saved(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema), "blocks")

    # every block's distinct pairs, counted over all blocks and sent back to it
    listed = cut_rows.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "held"))
    listed = listed.select("block", "place", F.col("held.pairs").alias("pair"), F.col("held.holders").alias("holders"))
    counts = listed.groupBy("pair").agg(F.sum("holders").alias("count"))
    n_b = piece_count(piece_path)
    first = F.expr(f"pair div {n_b}")
    # one row per id of the first tokenizer's vocabulary
    best = counts.groupBy(first.alias("first")).agg(F.max("count").alias("most"))
    counts = counts.withColumn("first", first).join(F.broadcast(best), "first").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = listed.join(counts, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")

    def weigh(documents, known):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(known.column("place").to_numpy())
        count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
        sums, bests = [], []
        for places, times in zip(documents.column("places").to_pylist(), documents.column("times").to_pylist()):
            at = np.frombuffer(places, "<u4")
            n = np.frombuffer(times, f"<u{len(times) // len(at)}").astype(np.int64) if len(at) else np.zeros(0, np.int64)
            sums.append(int((n * count[at]).sum()))
            bests.append(int(n[best[at]].sum()))
        kept = [documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), documents.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = cut_rows.where(F.col("pairs").isNull()).drop("pairs", "holders")
    out = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(weigh, out)


def piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).piece_size()
