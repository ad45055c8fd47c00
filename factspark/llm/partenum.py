"""Jaccard join of word shingle sets by PartEnum signatures.

Sets are put into size bands; within a band the feature domain (64-bit shingle hashes) is
cut into partitions, and a set's signatures are its projections on single partitions.  Two
sets with Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) of their summed
sizes, so many partitions hold none of the differences, and the sets agree there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, saved, shuffles_removed
from .components import components

#: Band edges grow by this factor, so half of the sets fall into the reach of two bands.
BAND_GROWTH = 16 / 9
#: Bands up to this size take every single feature as a partition.
SINGLE_UPTO = 20
#: Fewest partitions of a band, features per partition at its upper edge, signatures kept.
LEAST_PARTITIONS, PARTITION_SIZE, SIGNATURES = 128, 4, 128
#: Standard deviations by which the differences of a linked pair may spread over more
#: partitions than expected; the chance of more is below 1e-9 for a pair at the threshold.
SPREAD = 6
#: Rows of a signature group that are paired directly; rows of larger groups are paired with
#: the group's leaders, and with each other only where they may have no other meeting.
SMALL_GROUP = 64
#: Pairs that share one copy of the set of a row that is in many of them.
PAIRS_PER_COPY = 5_000
#: Most set names that may be taken twice by unlike sets (none are expected below 10^9 sets).
MOST_RENAMED = 10_000
#: Characters hashed at once (a worker needs some 60 bytes for each), signatures combined at once in a task.
PART_CHARS, PART_SIGNATURES = 250_000, 2_000_000


def bands(largest: int = 1 << 40) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band."""
    found, low = [], 1
    while low <= largest:
        high = max(low, math.floor(low * BAND_GROWTH))
        found.append((low, high))
        low = high + 1
    return found


def partitions(high: int) -> int:
    """Number of partitions of a band by its upper edge; 0 for one per feature."""
    return 0 if high <= SINGLE_UPTO else max(LEAST_PARTITIONS, -(-high // PARTITION_SIZE))


def mix(x):
    """A bijective scrambling of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int):
    """Powers of an odd base modulo 2^64 and of its inverse, kept between calls."""
    import sys

    import numpy as np

    base = 0x9E3779B97F4A7C15
    kept = sys.modules["numpy"].__dict__.setdefault("_shingle_powers", {})
    if kept.get("n", 0) < n:
        size = max(n, PART_CHARS * 2)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            kept[name] = np.cumprod(steps, dtype=np.uint64)
        kept["n"] = size
    return kept["up"], kept["down"]


def shingle_sets(texts: list[str | None], words: int):
    """Distinct shingle hashes of each text: flat hashes, sorted within a text, and set sizes.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a text of fewer
    than ``words`` words is one shingle, one without words has none.
    """
    import numpy as np

    data = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    lower = flat + ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(d) + 1 for d in data])
    owner = np.searchsorted(limits, starts, side="right")
    per = np.bincount(owner, minlength=len(data))
    first = np.cumsum(per) - per
    odd = [np.uint64((2 * i + 3) * 0xD6E8FEB86659FD93 % (1 << 64) | 1) for i in range(words)]
    at = np.flatnonzero(np.arange(len(word)) - first[owner] + words <= per[owner])
    shingle = np.zeros(len(at), np.uint64)
    for i in range(words):
        shingle += word[at + i] * odd[i]
    short = np.flatnonzero((per > 0) & (per < words))
    alone = np.zeros(len(short), np.uint64)
    for i in range(words - 1):
        has = per[short] > i
        alone[has] += word[first[short[has]] + i] * odd[i] + np.uint64(i + 1)
    h = np.concatenate([mix(shingle), mix(mix(alone))])
    doc = np.concatenate([owner[at], short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(data))


def class_hashes(h, sizes):
    """Two 64-bit sums that name a set; empty sets are 0."""
    import numpy as np

    ends = np.cumsum(sizes)
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(total[ends] - total[ends - sizes])
    return out


def named_sets(texts: list[str | None], words: int, renamed: tuple[int, ...] = ()):
    """Shingle hashes, set sizes, and for each text the 64-bit name of its set and a check of the name.

    The name depends on the set only, so every job that reads the texts gives the same; a
    name in ``renamed``, which unlike sets share, is replaced by one that depends on the check too.
    """
    import numpy as np

    h, n = shingle_sets(texts, words)
    name, check = class_hashes(h, n)
    twice = np.isin(name, np.array(renamed, np.int64).view(np.uint64))
    name[twice] = mix(name[twice] ^ mix(check[twice] + np.uint64(len(renamed))))
    return h, n, name.view(np.int64), check.view(np.int64)


def signatures(h, sizes):
    """(set, signature, near) of all sets; ``near`` is 0 for the set's own band and 1 for the next."""
    import numpy as np

    table = bands()
    low, high = (np.array(x) for x in zip(*table))
    own = np.searchsorted(low, sizes, side="right") - 1
    sets, found, side = [], [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in (0, 1):
        band = own + step
        takes = (sizes > 0) & ((step == 0) | (4 * sizes >= 3 * low[band]))
        n = np.array([partitions(int(x)) for x in high[band]], np.uint64)
        use = takes[owner]
        x, doc = h[use], owner[use]
        if not len(x):
            continue
        count = n[doc]
        part = np.where(count == 0, np.arange(len(x), dtype=np.uint64), ((x >> np.uint64(32)) * count) >> np.uint64(32))
        keep = (count == 0) | (part < SIGNATURES)
        x, doc, part, count = x[keep], doc[keep], part[keep], count[keep]
        new = np.ones(len(x), bool)  # hashes are sorted, so a partition's features stand together
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(mix(x), at)
        place = np.where(count[at] == 0, np.uint64(0), part[at] + np.uint64(1))
        sets.append(doc[at])
        found.append(mix(total + place * np.uint64(0x8CB92BA72F3D8DD7) + band[doc[at]].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        side.append(np.full(len(at), step, np.int8))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return np.concatenate(sets), np.concatenate(found), np.concatenate(side)


def agreements(sizes, counts, near):
    """On how many of its ``counts`` partitions a set agrees at least with a linked one.

    A linked set differs from a set of n features in n / 3 of them at most (the larger one of
    two has n / 0.75).  Each difference spoils one partition, and so many of them spoil no
    more than the mean and SPREAD deviations of that many balls thrown into the partitions.
    """
    import numpy as np

    low, high = (np.array(x) for x in zip(*bands()))
    band = np.searchsorted(low, sizes, side="right") - 1 + near
    n = np.array([partitions(int(x)) for x in high[band]], float)
    balls = np.floor(sizes / 3.0)
    cut = np.maximum(n, 1)
    kept = np.minimum(cut, SIGNATURES)
    free = np.exp(-balls / cut)
    spread = (kept / cut) ** 2 * cut * free * (1 - (1 + balls / cut) * free) + kept * (1 - kept / cut) * free * (1 - free)
    spoilt = np.minimum(balls, kept * (1 - free) + SPREAD * np.sqrt(np.maximum(spread, 0)))
    least = np.where(n == 0, np.ceil(0.75 * sizes), np.ceil(counts - spoilt))
    return np.maximum(least, 1).astype(np.int32)


def text_parts(batch, rows: int = 1000):
    """Slices of a batch with a column ``text`` of at most PART_CHARS characters, or of one text."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    at = 0
    while at < len(lengths):
        upto, chars = at + 1, lengths[at]
        while upto < len(lengths) and upto - at < rows and chars + lengths[upto] <= PART_CHARS:
            chars += lengths[upto]
            upto += 1
        yield batch.slice(at, upto - at)
        at = upto


def set_table(docs: DataFrame, words: int, renamed: tuple[int, ...] = ()) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n, row and check: size, name and check of the shingle set."""
    keys = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keys).schema.add("n", "long").add("row", "long").add("check", "long")

    def sizes_of(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_parts(batch):
                _, n, name, check = named_sets(part.column("text").to_pylist(), words, renamed)
                arrays = [*[part.column(k) for k in keys], pa.array(n), pa.array(name), pa.array(check)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "row", "check"])

    return docs.mapInArrow(sizes_of, schema)


def named_rows(docs: DataFrame, words: int) -> tuple[DataFrame, tuple[int, ...]]:
    """The stored ``set_table``, in which unlike sets have unlike names, and the renamed ones."""
    renamed: tuple[int, ...] = ()
    while True:
        table = saved(set_table(docs, words, renamed), "sizes")
        twice = table.where("n > 0").groupBy("row").agg((F.min("check") != F.max("check")).alias("twice")).where("twice")
        found = [r.row for r in twice.select("row").limit(MOST_RENAMED + 1).collect()]
        if not found:
            return table, renamed
        renamed = (*renamed, *found)
        if len(renamed) > MOST_RENAMED:
            raise RuntimeError("too many unlike sets of one name")
        discard(table)


def shared_signatures(texts: DataFrame, words: int, renamed: tuple[int, ...] = ()) -> DataFrame:
    """(sig, row, near, least): every signature held by several sets, with the names of these sets.

    ``least`` is the number of partitions on which the row agrees with a linked one.

    A set that a task meets again is left out.  A task combines what it has
    seen: signatures it holds several times are known to be shared, and only one of
    their rows is compared with other tasks, so a signature of any frequency meets at most one row per
    task and slice in a shuffle partition.
    """

    def combine(batches):
        import numpy as np
        import pyarrow as pa

        held, size, seen = [], 0, set()

        def flush():
            sig, row, near, least = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((row, sig))
            sig, row, near, least = sig[order], row[order], near[order], least[order]
            once = np.ones(len(sig), bool)  # a set seen again after ``seen`` was emptied
            once[1:] = (sig[1:] != sig[:-1]) | (row[1:] != row[:-1])
            sig, row, near, least = sig[once], row[once], near[once], least[once]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            again = ~new | np.append(~new[1:], False)
            for mask, local in ((new, False), (again, True)):
                for lo in range(0, int(mask.sum()), 500_000):
                    at = np.flatnonzero(mask)[lo : lo + 500_000]
                    yield pa.RecordBatch.from_pydict({
                        "sig": pa.array(sig[at].view(np.int64)), "row": pa.array(row[at]), "near": pa.array(near[at]), "least": pa.array(least[at]), "local": pa.array(np.full(len(at), local)),
                    })

        for batch in batches:
            for part in text_parts(batch):
                h, sizes, ids, _ = named_sets(part.column("text").to_pylist(), words, renamed)
                fresh = np.zeros(len(sizes), bool)
                for i, name in enumerate(ids.tolist()):
                    if name not in seen:
                        fresh[i] = True
                        seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()  # later repeats are then met again, with the same outcome
                n = np.where(fresh, sizes, 0)
                sets, sig, near = signatures(h[np.repeat(fresh, sizes)], n)
                least = [agreements(n, np.bincount(sets[near == s], minlength=len(n)), s) for s in (0, 1)]
                held.append((sig, ids[sets], near, np.where(near == 0, least[0][sets], least[1][sets])))
                size += len(sig)
                if size > PART_SIGNATURES:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    found = texts.mapInArrow(combine, "sig bigint, row bigint, near tinyint, least int, local boolean")
    # rows of locally shared signatures need no meeting and are dealt by row
    keyed = found.withColumn("meet", F.when(F.col("local"), F.xxhash64("sig", "row")).otherwise(F.col("sig")))
    at = Window.partitionBy("meet").orderBy("local", "sig", "row")
    other = [(f("sig").over(at) == F.col("sig")) & (f("row").over(at) != F.col("row")) for f in (F.lag, F.lead)]
    met = other[0] | other[1]
    return keyed.withColumn("met", F.coalesce(met, F.lit(False))).where("local OR met").select("sig", "row", "near", "least").distinct()


def able(shared: DataFrame) -> DataFrame:
    """Without the rows that share too few of their signatures with anyone to be linked."""
    held = shared.groupBy("row", "near").agg(F.count("*").alias("held"), F.max("least").alias("_least")).where("held >= _least")
    kept = shared.join(held.select("row", "near", "held"), ["row", "near"])
    # a group counts in the band of its larger sets, so one of them must be there
    groups = kept.groupBy("sig").agg(F.count("*").alias("size"), F.min("near").alias("first")).where("size > 1 AND first = 0")
    return kept.join(groups.select("sig"), "sig", "left_semi")


def feature_sets(rows: DataFrame, texts: DataFrame, words: int, renamed: tuple[int, ...] = ()) -> DataFrame:
    """(row, items), the whole shingle sets of the given rows, each set once.

    A task gives a set once (or once per million sets), so a set comes as often as there
    are tasks that hold it, however many texts have it.
    """

    def sets_of(batches):
        import numpy as np
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for part in text_parts(batch):
                h, n, ids, _ = named_sets(part.column("text").to_pylist(), words, renamed)
                fresh = np.zeros(len(n), bool)
                for i, name in enumerate(ids.tolist()):
                    if n[i] and name not in seen:
                        fresh[i] = True
                        seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()
                offsets = pa.array(np.concatenate([[0], np.cumsum(n[fresh])]).astype(np.int32))
                items = pa.array(h[np.repeat(fresh, n)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.ListArray.from_arrays(offsets, items)], names=["row", "items"])

    found = texts.mapInArrow(sets_of, "row bigint, items array<bigint>")
    return found.join(rows.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union, computed on whole sets.

    ``sets`` lies in buckets by row and is not shuffled.  Of a pair, the set of the row that
    is in more pairs travels to the other one; one copy of it serves PAIRS_PER_COPY pairs, so the
    pairs of a leader of any number of rows are spread over tasks.
    """
    ends = pairs.select(F.col("a").alias("row")).unionAll(pairs.select(F.col("b").alias("row")))
    degree = ends.groupBy("row").agg(F.count("*").alias("pairs"))
    for c in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("row").alias(c), F.col("pairs").alias(f"pairs_{c}")), c)
    first = F.col("pairs_a") >= F.col("pairs_b")
    ordered = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("many"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("few"),
        F.greatest("pairs_a", "pairs_b").alias("pairs"),
    )
    ordered = saved(ordered.select("many", "few", F.pmod(F.xxhash64("few"), F.ceil(F.col("pairs") / PAIRS_PER_COPY)).alias("copy")), "ordered")
    copies = ordered.select("many", "copy").distinct().join(sets.select(F.col("row").alias("many"), F.col("items").alias("items_many")), "many")
    both = F.size(F.array_intersect("items_many", "items"))
    size = F.size("items_many") + F.size("items")
    met = ordered.join(copies, ["many", "copy"]).join(sets.withColumnRenamed("row", "few"), "few")
    found = met.where(100 * both >= percent * (size - both)).select(F.least("many", "few").alias("a"), F.greatest("many", "few").alias("b"))
    links = saved(found, "links")
    discard(ordered)
    return links


def leaders(shared: DataFrame, comps: DataFrame | None, orders: int, salt: int) -> DataFrame:
    """Pairs of rows with the leaders of their groups in other components: the first row in each of several orders.

    A pair is worth comparing if it meets in an eighth of the groups that a linked pair
    shares, as other rows may lead the rest.
    """
    rows = with_components(shared, comps)
    firsts = [F.xxhash64("row", F.lit(salt + i)) for i in range(orders)]
    lead = rows.where("near = 0").groupBy("sig").agg(F.array_distinct(F.array(*[F.min_by(F.struct("row", "component"), o) for o in firsts])).alias("lead"))
    pairs = rows.select("sig", "row", "least", "component").join(lead, "sig").select("row", "least", "component", F.explode("lead").alias("lead"))
    pairs = pairs.where("component <> lead.component").select(F.least("row", "lead.row").alias("a"), F.greatest("row", "lead.row").alias("b"), "least")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("8 * n >= least").select("a", "b")


def without(pairs: DataFrame, compared: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that no earlier table has: one join, however many tables there are."""
    for old in compared[:1]:
        for more in compared[1:]:
            old = old.unionAll(more)
        pairs = pairs.join(old, ["a", "b"], "left_anti")
    return pairs


def with_components(shared: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return shared.withColumn("component", F.col("row"))
    return shared.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))


def joined(links: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The components after more links."""
    if comps is not None:
        links = links.union(comps.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    found = saved(components(links), "components")
    discard(comps)
    return found


def common_features(rows: DataFrame, sets: DataFrame, rounds: int = 3) -> DataFrame:
    """(row, n, common) of rows with enough features in other rows of the same table to be linked there.

    A linked pair has three quarters of each set in common, so a row with fewer features that
    occur again is left out, which may leave fewer to others.
    """
    kept, before = rows.select("row").distinct(), None
    for _ in range(rounds):
        features = sets.join(kept, "row", "left_semi").select("row", F.explode("items").alias("item"))
        # a set holds an item once, so an item that occurs once is counted off its only row: no row per repeated item
        alone = features.groupBy("item").agg(F.count("*").alias("held"), F.min("row").alias("row")).where("held = 1")
        alone = alone.groupBy("row").agg(F.count("*").alias("alone"))
        sizes = sets.join(kept, "row", "left_semi").select("row", F.size("items").alias("n"))
        counts = sizes.join(alone, "row", "left").select("row", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        kept = saved(counts.where("4 * common >= 3 * n"), "common")
        discard(before)
        before = kept
    return kept


def rivals(shared: DataFrame, comps: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of rows of different components that may still be linked, and the stored tables they come from.

    A linked pair agrees on ``least`` partitions.  Groups of up to SMALL_GROUP rows give their
    pairs across components, at most that many per row; a pair must meet there as often as
    the larger groups of either row leave open.  Only rows with ``least`` larger groups
    can have all their meetings in those; they are paired by their rarest features.
    """
    rows = with_components(shared, comps)
    groups = rows.groupBy("sig").agg(F.count("*").alias("size"), (F.min("component") != F.max("component")).alias("open"))
    rows = rows.join(groups.where("open").drop("open"), "sig")
    hot = rows.groupBy("row", "near").agg(F.count_if(F.col("size") > SMALL_GROUP).cast("int").alias("hot"))
    rows = saved(rows.join(hot, ["row", "near"]), "open")
    small = rows.where(F.col("size") <= SMALL_GROUP)
    a, b = (small.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "near", "least", "hot", "component")]) for x in ("a", "b"))
    met = a.join(b, "sig").where("row_a < row_b AND component_a <> component_b AND near_a + near_b < 2")
    need = F.max(F.greatest("least_a", "least_b")) - F.max(F.least("hot_a", "hot_b"))
    met = met.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b")).agg(F.count("*").alias("n"), need.alias("need"))
    needy = rows.where((F.col("size") > SMALL_GROUP) & (F.col("hot") >= F.col("least"))).select("row", "component").distinct()
    rare, used = rare_meetings(needy, sets)
    return met.where("n >= need").select("a", "b").union(rare).distinct(), [rows, *used]


def rare_meetings(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of rows (row, component) of different components that may be linked, by an exact prefix test.

    The stored tables they come from are returned as well.

    With each row's features ordered from the rarest on, a linked pair must meet in the first
    quarter of both, and at its first common feature what is left of either must suffice for
    the overlap.  So texts that share a passage or a base but have enough features apart
    are never paired.  A feature's most frequent component is not paired with itself.
    """
    common = common_features(rows, sets)
    kept = rows.join(common, "row")
    features = sets.join(kept, "row").select("row", "component", "n", F.explode("items").alias("item"))
    held = features.groupBy("item").agg(F.count("*").alias("held"))
    order = Window.partitionBy("row").orderBy("held", "item")
    first = features.join(held, "item").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 0.75) + 1)
    first = prefixes = saved(first, "first")
    heads = first.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("head"))
    by_component = first.groupBy("item", "component").agg(F.count("*").alias("k"))
    main = by_component.groupBy("item").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("components"))
    first = first.join(main.where("components > 1"), "item").join(heads, "row")
    a, b = (first.select(*[F.col(c).alias(f"{c}_{x}") for c in ("item", "row", "component", "n", "at", "main", "head")]) for x in ("a", "b"))
    enough = 7 * F.least(F.col("n_a") - F.col("at_a") + 1, F.col("n_b") - F.col("at_b") + 1) >= 3 * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("component_a") != F.col("main_a")) & (F.col("component_a") != F.col("component_b"))
    once = (F.col("component_b") == F.col("main_b")) | (F.col("row_a") < F.col("row_b"))
    begins = F.element_at(F.array_intersect("head_a", "head_b"), 1) == F.col("item_a")
    met = a.join(b, [F.col("item_a") == F.col("item_b"), apart, once, enough, begins])
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct(), [common, prefixes]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, orders: int = 3, rounds: int = 3, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, component) of every row of ``docs``, after ``row`` if a column is given for it.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets (percent
    of 75 and more); component_id is the smallest doc_id of the connected rows and ``component``
    a number of their own.  Texts without words have no shingles, are linked with
    nothing and have no ``component``; rows with equal sets are linked always.  Null ids count as
    larger than all others.

    Sets are named by their content, so every job that reads the texts names them alike, equal
    sets are one row of every table from the start, and no copy of the texts is written.  Only
    signatures, names and, once, the sets of candidates are shuffled; these stay in buckets.  Leaders of
    signature groups are compared with their groups first, in a few rounds, which joins most copies; then the
    pairs across components that share signatures are compared, so a group of copies is not
    expanded into all its pairs.  A table is deleted when those made from it are written.
    """
    if percent < 75:
        raise ValueError("bands and partitions are laid out for 75 percent and more")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    keys = [F.col(row_col).alias("given_row")] if row_col else []
    texts = docs.select(columns[1])
    with shuffles_removed(docs.sparkSession):
        table, renamed = named_rows(docs.select(*keys, *columns), words)
        held = saved(shared_signatures(texts, words, renamed), "signatures")
        shared = saved(able(held), "shared")
        discard(held)
        sets = bucketed(feature_sets(shared, texts, words, renamed), "sets", "row")
        known, compared = None, []
        for step in range(rounds):
            pairs = leaders(shared, known, orders if step else 1, step * orders)
            pairs = without(pairs, compared)
            compared.append(saved(pairs, "leaders"))
            links = linked(compared[-1], sets, percent)
            known = joined(links, known)
            discard(links)
        rest, used = rivals(shared, known, sets)
        rest = saved(without(rest, compared), "rivals")
        discard(shared, *compared, *used)
        links = linked(rest, sets, percent)
        known = joined(links, known)
        discard(links, rest, sets)
    names = known.select(F.col("node").alias("row"), F.col("component").alias("group"))
    found = table.join(names, "row", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("group", "row")))
    least = found.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = found.select(*[F.col("given_row").alias("row") for _ in keys], "doc_id", F.col("n").alias("n_shingles"), "component")
    return result.join(least, "component", "left").select(
        *["row" for _ in keys], "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component"
    )
