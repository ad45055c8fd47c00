"""Prefix trie of conversations: range shards finished alone, a skeleton of splitter paths by reduction.

A conversation is a path of turns, each turn 20 bytes: 16 of a hash of role and text, 4 of the
text's UTF-8 length.  Paths in byte order keep every subtree together, so range shards of
(path, conv_id) cut only the nodes that are prefixes of a splitter's path.  These nodes are the
skeleton: small, known to every task, and summed over the shards.  All others lie in one shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SYMBOL = 20
#: Conversations looked at for each shard to place the splitters; balance only depends on it.
SAMPLED = 16
#: Shards at most, and bytes of a sampled path: both bound what the driver and each task hold.
SHARDS = 1000
SAMPLED_BYTES = 400 * SYMBOL
#: Bytes of splitter paths that tasks may be given; beyond it every second splitter is left out.
SKELETON_BYTES = 8_000_000
#: Ids in one piece of a skeleton node's list of ends.
ENDS = 50_000
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

PARTS = ("shard int, seq bigint, kind int, node int, parent_node int, conv_id bigint, depth bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends binary, parent_conv_id bigint")
COLUMNS = [c.split()[0] for c in PARTS.split(", ")]
NODE, PARTIAL, PIECE = 0, 1, 2


def turn_symbol(role: Column, text: Column) -> Column:
    """One turn as 40 hexadecimal digits; null is the empty string."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.upper(F.substring(named, 1, 32)), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def kept_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its base: 0 to 8 by the CRC-32 of its id."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Rows conv_id, path: the first turns of the family's base, then the own turns after as many.

    ``turns`` has conv_id, turn, role, text (other columns are ignored).  Turns are ordered by
    turn (null first), ties by role and then by a hash of the text; equal rows are turns of their
    own.  Rows without conv_id are in no conversation.  The base of c is c - c mod family; if
    it is absent nothing is taken over.  A conversation's turns (60 bytes each) meet in one row.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        turn_symbol(F.col("role"), F.col("text")).alias("symbol"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "symbol")))
    convs = rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["symbol"]).alias("own"))
    bases = convs.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("first"))
    convs = convs.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).join(bases, "base", "left")
    h = kept_turns(F.col("conv_id"))
    start = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), h)).otherwise(F.array().cast("array<string>"))
    rest = F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))
    return convs.select("conv_id", F.unhex(F.array_join(F.concat(start, rest), "")).alias("path"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * SYMBOL : middle * SYMBOL] == b[low * SYMBOL : middle * SYMBOL]:
            low = middle
        else:
            high = middle - 1
    return low


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Keys (path, conv_id) that cut the conversations into about equal shards.

    Between neighbours of unlike paths the shortest path that separates them is enough;
    inside a run of equal paths the id cuts.
    """
    wanted = paths.select(F.substring("path", 1, SAMPLED_BYTES).alias("path"), "conv_id")
    sample = sorted((bytes(r.path), r.conv_id) for r in wanted.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED * shards).collect())
    keys = set()
    for k in range(1, shards):
        at = k * len(sample) // shards
        if 0 < at < len(sample):
            before, here = sample[at - 1], sample[at]
            equal = before[0] == here[0]
            keys.add(here if equal else (here[0][: (shared_turns(before[0], here[0]) + 1) * SYMBOL], -(1 << 63)))
    found = sorted(keys)
    while sum(len(path) for path, _ in found) > SKELETON_BYTES:
        found = found[1::2]
    return found


def skeleton(keys: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """The trie of the splitter paths: (node, turn) to node; the root is 0."""
    step: dict[tuple[int, bytes], int] = {}
    for path, _ in keys:
        node = 0
        for at in range(0, len(path), SYMBOL):
            node = step.setdefault((node, path[at : at + SYMBOL]), len(step) + 1)
    return step


class _Rows:
    """Rows gathered for the next Arrow batch."""

    def __init__(self, schema):
        self.schema, self.rows = schema, []

    def add(self, **values):
        self.rows.append(tuple(map(values.get, COLUMNS)))

    def batch(self):
        import pyarrow as pa

        columns = zip(*self.rows) if self.rows else [[]] * len(COLUMNS)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return made


def _arrow_schema():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PARTS.split(", ")])


def _finish_shards(step: dict[tuple[int, bytes], int]):
    """Sorted rows (shard, path, conv_id) to finished nodes, children first, and partial sums of skeleton nodes."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        out, seq = _Rows(_arrow_schema()), 0
        stack: list[list] = []  # per depth: skeleton node or None, smallest id, convs, children, leaves, saved, ends
        shard, last = None, b""

        def flush(node, ends):
            nonlocal seq
            out.add(shard=shard, seq=seq, kind=PIECE, node=node, ends=",".join(map(str, ends)).encode())
            seq += 1

        def close():
            nonlocal seq
            depth = len(stack) - 1
            node, least, convs, children, leaves, saved_bytes, ends = stack.pop()
            if node is not None:
                if ends:
                    flush(node, ends)
                out.add(shard=shard, seq=seq, kind=PARTIAL, node=node, conv_id=least, n_convs=convs, n_children=children, n_leaves=leaves, saved_tokens=saved_bytes)
            else:
                leaves = leaves if children else 1
                saved_bytes += (convs - 1) * int.from_bytes(last[depth * SYMBOL - 4 : depth * SYMBOL], "big")
                out.add(shard=shard, seq=seq, kind=NODE, parent_node=stack[-1][0], conv_id=least, depth=depth, n_convs=convs, n_children=children,
                        n_leaves=leaves, saved_tokens=saved_bytes, ends_sha256=ends.hexdigest() if ends else EMPTY)
            seq += 1
            if stack:
                up = stack[-1]
                up[1], up[2] = min(up[1], least), up[2] + convs
                if node is None:
                    up[3], up[4], up[5] = up[3] + 1, up[4] + leaves, up[5] + saved_bytes

        def open_node(conv):
            depth = len(stack)
            node = 0
            if depth:
                above = stack[-1][0]
                node = None if above is None else step.get((above, path[(depth - 1) * SYMBOL : depth * SYMBOL]))
            stack.append([node, conv, 0, 0, 0, 0, None if node is None else []])

        for batch in batches:
            for number, path, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != shard:
                    while stack:
                        close()
                    shard, last = number, b""
                else:
                    same = shared_turns(last, path)
                    while len(stack) > same + 1:
                        close()
                while len(stack) < len(path) // SYMBOL + 1:
                    open_node(conv)
                last = path
                top = stack[-1]
                top[1], top[2] = min(top[1], conv), top[2] + 1
                if top[0] is not None:
                    top[6].append(conv)
                    if len(top[6]) >= ENDS:
                        flush(top[0], top[6])
                        top[6] = []
                elif top[6] is None:
                    top[6] = hashlib.sha256(str(conv).encode())
                else:
                    top[6].update(b",%d" % conv)
                if len(out.rows) >= 5000:
                    yield out.batch()
        while stack:
            close()
        yield out.batch()

    return run


def _name_parents(batches: Iterator) -> Iterator:
    """Nodes of a shard, parents first, get the parent's smallest member."""
    import pyarrow as pa

    least: list[int] = []
    for batch in batches:
        parents = []
        for kind, depth, conv, above in zip(*(batch.column(COLUMNS.index(c)).to_pylist() for c in ("kind", "depth", "conv_id", "parent_node"))):
            if kind != NODE:
                parents.append(None)
                continue
            least += [0] * (depth + 1 - len(least))
            parents.append(least[depth - 1] if above is None else None)
            least[depth] = conv
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parents, pa.int64())], schema=batch.schema)


def _digest_pieces(batches: Iterator) -> Iterator:
    """Sorted pieces of id lists (node, ..., ends) to one digest per node, piece by piece."""
    import hashlib

    import pyarrow as pa

    node, digest = None, None

    def line():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node:
                if digest:
                    yield line()
                node, digest = name, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
    if digest:
        yield line()


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id long, path binary, see ``rebuilt``).

    Columns: conv_id (the node's smallest member, with depth its name), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens (UTF-8 bytes that a shared
    prefix saves, over the subtree), ends_sha256 (of the ascending ids that end here, joined by
    commas).  No rows, no nodes.  A run of equal paths is cut by id, so a task holds about an
    equal share of the rows, and per open node a few numbers.
    """
    spark = paths.sparkSession
    shards = shards or min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = saved(paths, "paths")
    keys = splitters(paths, shards)
    step = skeleton(keys)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            convs, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers = [bisect_right(keys, (p, c)) for p, c in zip(found, convs)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), batch.column(1), batch.column(0)], names=["shard", "path", "conv_id"])

    dealt = paths.select("conv_id", "path").mapInArrow(deal, "shard int, path binary, conv_id bigint")
    ordered = dealt.repartitionById(len(keys) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = ordered.mapInArrow(_finish_shards(step), PARTS).sortWithinPartitions("shard", F.desc("seq")).mapInArrow(_name_parents, PARTS)
    nodes = saved(nodes, "nodes")

    pieces = nodes.where(F.col("kind") == PIECE).repartition("node").sortWithinPartitions("node", "shard", "seq").select("node", "ends")
    ends = {r.node: r.ends_sha256 for r in pieces.mapInArrow(_digest_pieces, "node int, ends_sha256 string").collect()}
    sums = nodes.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    top = _finish_skeleton(step, {r.node: r.asDict() for r in sums.collect()}, ends)
    schema = "node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    top = spark.createDataFrame(top, schema)

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = top.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_above"))
    local = nodes.where(F.col("kind") == NODE).join(above, "parent_node", "left")
    return local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(*columns).unionAll(top.select(*columns))


def _finish_skeleton(step: dict, sums: dict[int, dict], ends: dict[int, str]) -> list[tuple]:
    """Skeleton nodes from their sums over all shards, children before parents (a child has the larger number)."""
    above = {node: (parent, turn) for (parent, turn), node in step.items()}
    depths = {0: 0}
    for node in sorted(above):
        depths[node] = depths[above[node][0]] + 1
    for node in sorted(sums, reverse=True):
        s = sums[node]
        s["n_leaves"] = s["n_leaves"] if s["n_children"] else 1
        if node:
            parent, turn = above[node]
            s["saved_tokens"] += (s["n_convs"] - 1) * int.from_bytes(turn[-4:], "big")
            up = sums[parent]
            up["n_children"] += 1
            up["n_leaves"] += s["n_leaves"]
            up["saved_tokens"] += s["saved_tokens"]
    return [
        (node, s["conv_id"], depths[node], sums[above[node][0]]["conv_id"] if node else None, s["n_convs"], s["n_children"], s["n_leaves"], s["saved_tokens"], ends.get(node, EMPTY))
        for node, s in sums.items()
    ]
