"""Token files in key order with a minimal perfect hash index for keyed access."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .tokenfiles import store, write_flat

#: Bits per key and level of the hash.
GAMMA = 2
FINGERPRINT = (1 << 32) - 1


@dataclass(frozen=True)
class TokenStore:
    """Where the files are and how wide an id is; ``runs`` has one row per key and file."""

    folder: str
    width: int
    runs: DataFrame
    index: DataFrame
    buckets: int


def key_hashes(key: Column) -> list[Column]:
    """128 bits of a key; null is a key of its own."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("second")).alias("h2")]


def slots(h1, h2, level: int, size: int):
    """Position of each key in the bit array of a level."""
    import numpy as np

    x = h1 ^ (h2 + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_mph(h1, h2) -> tuple[list[int], bytes]:
    """Minimal perfect hash of distinct keys: level sizes and their bits.

    At each level a key that has its position to itself sets the bit and is done; the others
    go on to the next.  A key's number is the count of set bits before its own.
    """
    import numpy as np

    sizes, bits = [], []
    left = np.arange(len(h1))
    while len(left):
        if len(sizes) > 60:
            raise ValueError("two keys share all 128 hash bits")
        size = -(-GAMMA * len(left) // 64) * 64
        at = slots(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def find_mph(sizes, bits: bytes, h1, h2):
    """The number of each key; some number or -1 for a key that was not built in."""
    import numpy as np

    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    before = np.concatenate([[0], np.cumsum(flags)])
    found = np.full(len(h1), -1, np.int64)
    left, base = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + slots(h1[left], h2[left], level, size)
        hit = flags[at]
        found[left[hit]] = before[at[hit]]
        left, base = left[~hit], base + size
    return found


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id",
                text_col: str = "text", keys_per_bucket: int = 20_000) -> TokenStore:
    """Write ``docs`` in ascending key order and index the keys.

    Files hold, per document, its number of ids (4 bytes) and the ids (``width`` bytes
    each, end id last), so a run of documents with one key reads itself.  Null keys come
    first.  Rows of a hot key are dealt over files by row number.  The index has one line per
    hash bucket of about ``keys_per_bucket`` distinct keys: the hash levels, and by slot a
    32-bit fingerprint and the runs (file, offset, documents, ids) of the key.
    Tokenizing happens once; only texts (to order them) and one small row per key are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(F.col("doc_id"), F.col("row")).sortWithinPartitions("doc_id", "row")
    entries = saved(write_flat(ordered, f"{folder}/files", tokenizer, end_id, width, "doc_id", "text", headers=True), "entries")
    first = F.struct("ordinal", "offset", "before")
    runs = entries.groupBy("doc_id", "shard", "file").agg(F.min(first).alias("first"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    shards = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shards = shards.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs = runs.join(shards, F.col("file") == F.col("_file")).select(
        "doc_id", "shard", "file", F.col("first.offset").alias("offset"), (F.col("base") + F.col("first.before")).alias("start"), "n_docs", "n_tokens")
    runs = saved(runs, "runs")
    per_key = runs.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "file", "offset", "start", "n_docs", "n_tokens")).alias("runs"))
    per_key = saved(per_key.select(*key_hashes(F.col("doc_id")), "runs"), "keys")  # a key has one run per file at most
    buckets = max(1, -(-per_key.count() // keys_per_bucket))
    index = saved(build_index(per_key, buckets), "index")
    return TokenStore(f"{folder}/files", width, runs, index, buckets)


RUN = "struct<shard:int,file:string,offset:bigint,start:bigint,n_docs:bigint,n_tokens:bigint>"


def build_index(per_key: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of about equal numbers of distinct keys."""

    def build(table):
        import numpy as np
        import pyarrow as pa

        h1, h2 = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        sizes, bits = build_mph(h1, h2)
        order = np.argsort(find_mph(sizes, bits, h1, h2))
        prints = (h2[order] & np.uint64(FINGERPRINT)).astype("<u4").tobytes()
        runs = table.column("runs").combine_chunks().take(pa.array(order))
        offsets = pa.array([0, len(order)], pa.int32())
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()),
            "fingerprints": pa.array([prints], pa.binary()), "slots": pa.ListArray.from_arrays(offsets, runs),
        })

    keyed = per_key.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    schema = f"bucket bigint, sizes array<bigint>, bits binary, fingerprints binary, slots array<array<{RUN}>>"
    return keyed.groupBy("bucket").applyInArrow(build, schema)


def locate(tokens: TokenStore, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The runs of each distinct key of ``keys`` by the index: one hash and one comparison a key.

    Keys that the store lacks give no row, but for one in 2^32 whose fingerprint agrees.
    """
    kind = keys.schema[key].dataType.simpleString()
    asked = keys.select(F.col(key).alias("doc_id")).distinct()
    asked = asked.select("doc_id", *key_hashes(F.col("doc_id"))).withColumn("bucket", F.pmod("h1", F.lit(tokens.buckets)))

    def find(wanted, lines):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "shard", "file", "offset", "start", "n_docs", "n_tokens"]
        kinds = [wanted.schema.field("doc_id").type, pa.int32(), pa.string(), *[pa.int64()] * 4]
        if not wanted.num_rows or not lines.num_rows:
            return pa.schema(list(zip(names, kinds))).empty_table()
        line = {c: lines.column(c)[0].as_py() for c in ("sizes", "bits", "fingerprints")}
        h1, h2 = (wanted.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        slot = find_mph(line["sizes"], line["bits"], h1, h2)
        prints = np.frombuffer(line["fingerprints"], "<u4")
        known = (slot >= 0) & (prints[np.maximum(slot, 0)] == (h2 & np.uint64(FINGERPRINT)).astype("<u4"))
        per_slot = lines.column("slots").combine_chunks().flatten()
        taken = per_slot.take(pa.array(slot[known]))
        owner = taken.value_parent_indices()
        ids = wanted.column("doc_id").combine_chunks().take(pa.array(np.flatnonzero(known))).take(owner)
        flat = taken.flatten()
        return pa.Table.from_arrays([ids, *[flat.field(n) for n in names[1:]]], names=names)

    schema = f"doc_id {kind}, shard int, file string, offset bigint, start bigint, n_docs bigint, n_tokens bigint"
    return asked.groupBy("bucket").cogroup(tokens.index.groupBy("bucket")).applyInArrow(find, schema)


def fetch(tokens: TokenStore, runs: DataFrame) -> DataFrame:
    """The documents of located runs, read from the files by range.

    Rows: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), one per stored document.
    A task takes the runs of some files in file order, so neighbours are read forward.
    """
    kind = runs.schema["doc_id"].dataType.simpleString()
    folder, width = tokens.folder, tokens.width

    def read(batches):
        import numpy as np
        import pyarrow as pa

        system, path = store(folder)
        name, file = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                out = []
                for r in batch.slice(lo, 2000).to_pylist():
                    if r["file"] != name:
                        name, file = r["file"], system.open_input_file(f"{path}/{r['file']}")
                    data = file.read_at(r["n_docs"] * 4 + r["n_tokens"] * width, r["offset"])
                    at, start = 0, r["start"]
                    for _ in range(r["n_docs"]):
                        n = int.from_bytes(data[at : at + 4], "little")
                        ids = np.frombuffer(data, f"<u{width}", n, at + 4)
                        out.append((r["doc_id"], start, n, ids.astype("<u4").tobytes()))
                        at += 4 + n * width
                        start += n
                        if len(out) == 2000:
                            yield packed(pa, out, batch)
                            out = []
                if out:
                    yield packed(pa, out, batch)

    def packed(pa, rows, batch):
        ids, start, n, body = zip(*rows)
        arrays = [pa.array(ids, batch.schema.field("doc_id").type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])

    ordered = runs.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.select("doc_id", "file", "offset", "start", "n_docs", "n_tokens").mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def lookup(tokens: TokenStore, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every stored document whose key is in ``keys``."""
    return fetch(tokens, locate(tokens, keys, key))
