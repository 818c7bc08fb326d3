"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every distinct shingle set gets TREES signature orders of DEPTH values. In each order, sets that agree on the first
FIRST values are neighbours. A region of more than REGION sets is not paired: it is opened one value deeper, and again,
so the depth adapts to how crowded the region is; at every depth its members are compared with the member of longest
common prefix that leads the region. Two sets of similarity 0.8 miss each other in all 24 orders with probability
3e-6. All links are confirmed on the full sets.

Comparing goes by two rounds, since only reachability counts: first each set with the leader it meets most often, then
what still joins different components: the other leaders, further leaders chosen by hash, and all pairs within regions
of at most REGION members. Members that one component has swallowed are not compared again, so a crowd of thousands of
near copies costs one comparison a member.

Crowded regions that still hold several components then go an exact way, a prefix-filter join on shingles. Two sets that
are linked share a shingle among the rarest of each; sets that have such a shingle in common and lie in different
components are compared, in two rounds again: with the member whose shingles are most common among the crowd, which is
the hub if there is one, and then all that still lie in different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import attach, saved
from codeloom.llm.components import components
from codeloom.llm.exact_dedup import drop_keys, key_filter, maybe_repeated, with_groups

TREES, FIRST, DEPTH = 24, 4, 6
REGION = 40
#: Further leaders of each region in the second round.
TURNS = 2
SALT_ROWS = 256
#: Counters by which shingles of crowds are ordered; shingles that share a counter only make the order less apt.
COUNTERS = 2**20
#: Counters that travel in one row.
COUNTER_BLOCK = 1 << 12

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of the words seen so far; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text in UTF-8; empty without words.

    A-Z is lower-cased and words are split at ASCII white space; a text of fewer words than `width` is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < width:
            whole = np.uint64(len(words))
            for x in h:
                whole = whole * _BASE + x
            return _mixed(np.array([whole], np.uint64))
        n = len(words) - width + 1
        rolled = h[:n].copy()
        for i in range(1, width):
            rolled = rolled * _BASE + h[i:i + n]
        return np.unique(_mixed(rolled))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 32 bits."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at:at + 2048] ^ _XOR[:, None]
        part *= _ODD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, fp, sig) of docs (id, text): size and fingerprint of the shingle set, and its signature."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at:at + 500]
                sets = [shingle_set(t, width, hashes) for t in part["text"]]
                yield pd.DataFrame({
                    "id": part["id"].values, "n": [len(s) for s in sets],
                    "fp": [hashlib.md5(s.tobytes()).digest() for s in sets], "sig": [signature(s) if len(s) else None for s in sets],
                })

    packed = docs.select(F.col("id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    return packed.mapInPandas(sketch, "id string, n long, fp binary, sig array<int>").withColumn("id", F.col("id").cast("long"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of docs (id, text)."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at:at + 500]
                yield pd.DataFrame({"id": part["id"].values, "shingles": [shingle_set(t, width, hashes).view(np.int64) for t in part["text"]]})

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInPandas(build, "id long, shingles array<long>")


def _keys(sets: DataFrame, trees, depths) -> DataFrame:
    """(key, id, n, tree): the key hashes an order and the first values of the set in it, as many as the depth says."""
    rows = sets.select("id", "n", "sig", trees.alias("tree")).withColumn("depth", depths)
    return rows.select(F.xxhash64("tree", "depth", F.slice("sig", F.col("tree") * DEPTH + 1, F.col("depth"))).alias("key"), "id", "n", "tree")


def _shared(rows: DataFrame, total: int) -> DataFrame:
    """rows whose key several have, with the number of members and the leader, the member of smallest id.

    Only rows that pass the filter of shared keys are shuffled a second time.
    """
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("leader")).filter("members > 1")
    shared = saved(shared, "regions")
    bits, blocks = key_filter(shared.select("key"), "key", shared.count())
    some = maybe_repeated(rows, "key", saved(bits, "region-filter"), blocks).filter("_maybe").drop("_maybe")
    return saved(attach(some, shared, "key", "members", total * TREES, "inner"), "members")


def regions(sets: DataFrame, total: int) -> DataFrame:
    """(key, id, n, members, leader): the regions of two or more sets; crowded ones are also cut at all greater depths."""
    first = _shared(_keys(sets, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))), F.lit(FIRST)), total)
    crowded = first.filter(F.col("members") > REGION).groupBy("id").agg(F.collect_set("tree").alias("_trees"))  # TREES at most
    if FIRST == DEPTH or crowded.isEmpty():
        return first.drop("tree")
    deeper = F.explode(F.sequence(F.lit(FIRST + 1), F.lit(DEPTH)))
    return first.unionByName(_shared(_keys(sets.join(crowded, "id"), F.explode("_trees"), deeper), total)).drop("tree")


def _some(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of ids (and a few others): what passes the filter of these ids, without a shuffle."""
    bits, blocks = key_filter(ids, "id", ids.count())
    return maybe_repeated(sets, "id", saved(bits, "id-filter"), blocks).filter("_maybe").drop("_maybe")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of at least `percent` similarity on the full sets; pairs must be cheap to read again.

    A set that stands in many pairs as `a` is copied once for each SALT_ROWS of them.
    """
    fan = saved(pairs.groupBy("a").count().withColumn("_salts", F.ceil(F.col("count") / SALT_ROWS)), "fan")
    left = _some(sets, fan.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("shingles").alias("_a")).join(fan, "a")
    left = left.select("a", "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"))
    salted = attach(pairs, fan, "a", "count", pairs.count(), "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_salts")).alias("_salt"))
    right = _some(sets, saved(pairs.select(F.col("b").alias("id")).distinct(), "partners")).select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    both = salted.join(right, "b").join(left, ["a", "_salt"])
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(100 * common >= percent * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components (column label) within regions that still hold several.

    Every member is paired with the leader of its region and with TURNS others, chosen by a hash of member and region,
    so that a member of many crowded regions meets many. Members of a region of at most REGION are all paired.
    """
    one = F.struct("id", "n", "label")
    heads = [F.min(one)] + [F.max_by(one, F.xxhash64("id", "key", F.lit(turn))) for turn in range(TURNS)]
    open_ = members.groupBy("key").agg(F.array(*heads).alias("heads"), F.max("members").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    rows = saved(attach(members.drop("members", "leader"), saved(open_.select("key", "heads", "size"), "open-regions"), "key", "size", members.count(), "inner"), "open-members")
    led = rows.select("n", "label", F.col("id").alias("b"), F.explode("heads").alias("h")).select("n", "label", "b", F.col("h.id").alias("a"), F.col("h.n").alias("_n"), F.col("h.label").alias("_label"))
    near = saved(rows.filter(F.col("size") <= REGION).select("key", "id", "n", "label"), "small-regions")
    other = near.select("key", F.col("id").alias("b"), F.col("n").alias("_n"), F.col("label").alias("_label"))
    every = near.select("key", "n", "label", F.col("id").alias("a")).join(other, "key").filter("a < b").drop("key")
    fits = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    both = led.unionByName(every).filter(fits & (F.col("label") != F.col("_label")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of all members that confirmed links join."""
    ids = saved(members.select("id").distinct(), "candidates")
    sets = saved(shingle_sets(_some(docs, ids), width), "shingle-sets")

    fits = 100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")
    led = members.filter(F.col("id") != F.col("leader.id")).filter(fits)
    first = saved(led.groupBy(F.col("id").alias("b")).agg(F.mode("leader.id", True).alias("a")), "pairs")
    joined = components(confirmed(first, sets, percent))

    label = F.coalesce("component", "id").alias("label")
    labelled = saved(members.join(joined, "id", "left").select("key", "id", "n", "members", "leader", label), "labelled")
    of = saved(labelled.select("id", "label").distinct(), "labels")
    second = saved(_across(labelled, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    of = _merged(of, second, sets, percent)
    crowd = saved(_still_crowded(labelled.filter(F.col("members") > REGION), of), "crowd")
    if not crowd.isEmpty():
        prefixes = saved(_prefixes(_some(sets, crowd).join(crowd, "id", "left_semi"), percent), "prefixes")
        of = _merged(of, saved(_hub_pairs(prefixes, of, percent), "pairs"), sets, percent)
        of = _merged(of, saved(_prefix_pairs(prefixes, of, percent), "pairs"), sets, percent)
    return of.select("id", F.col("label").alias("component"))


def _merged(of: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """of (id, label) after the confirmed ones of pairs (a, b) have joined whole components."""
    if pairs.isEmpty():
        return of
    found = confirmed(pairs, sets, percent).join(of.select(F.col("id").alias("a"), F.col("label").alias("_a")), "a").join(of.select(F.col("id").alias("b"), F.col("label").alias("_b")), "b")
    merged = components(found.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("id").alias("label"), F.col("component").alias("merged"))
    return saved(of.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("label")), "labels")


def _still_crowded(members: DataFrame, of: DataFrame) -> DataFrame:
    """(id): the members of crowded regions that still hold several components."""
    packed = members.groupBy("id").agg(F.collect_list(F.struct("key", "members")).alias("_regions"))  # one for each tree and depth at most
    now = saved(packed.join(of, "id").select("id", "label", F.inline("_regions")), "crowded")
    open_ = now.groupBy("key").agg(F.max("members").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key", "size")
    return attach(now.drop("members"), saved(open_, "open-regions"), "key", "size", now.count(), "inner").select("id").distinct()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, central, keys): the rarest shingles of each set, the rarest first, so many that linked sets share one.

    central: how common the set's shingles are on the average.
    """
    slot = F.col("s").bitwiseAND(F.lit(COUNTERS - 1))
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(slot.alias("slot")).count()

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(COUNTER_BLOCK, np.int32)
        block[part["slot"].to_numpy() % COUNTER_BLOCK] = np.minimum(part["count"].to_numpy(), np.iinfo(np.int32).max)
        return pd.DataFrame({"block": part["block"].iloc[:1], "counts": [block.tobytes()]})

    blocks = counts.withColumn("block", F.floor(F.col("slot") / COUNTER_BLOCK)).groupBy("block").applyInPandas(pack, "block long, counts binary")
    often = np.zeros(COUNTERS, np.int32)
    for row in blocks.collect():  # four bytes a counter
        often[row["block"] * COUNTER_BLOCK:(row["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(row["counts"], np.int32)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for id_, shingles in zip(frame["id"], frame["shingles"]):
                s = np.asarray(shingles, np.int64)
                n, times = len(s), often[s & (COUNTERS - 1)]
                keep = n - -(-percent * n // 100) + 1
                yield pd.DataFrame({"id": [id_], "n": [n], "central": [int(1000 * times.mean())], "keys": [s[np.lexsort((s, times))[:keep]]]})

    return sets.select("id", "shingles").mapInPandas(build, "id long, n long, central long, keys array<long>")


def _may_link(percent: int):
    """Whether sets of n and _n shingles whose first common one is at place and _place can have enough in common."""
    need = F.ceil(percent * (F.col("n") + F.col("_n")) / (100 + percent) - 1e-9)
    return (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")) & (F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) >= need)


def _open_prefixes(prefixes: DataFrame, of: DataFrame) -> DataFrame:
    """The rows whose shingle sets of different components share, with the commonest component of such a shingle, the
    number of rows outside it (others), and the most central set."""
    rows = saved(prefixes.join(of, "id").select("id", "n", "central", "label", F.posexplode("keys").alias("place", "key")), "labelled-prefixes")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("k"), F.max(F.struct("central", "id", "n", "place", "label")).alias("hub"))
    facts = by_label.groupBy("key").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top"), F.max("hub").alias("hub"), F.count("*").alias("labels")).filter("labels > 1")
    facts = saved(facts.select("key", "size", F.col("top.label").alias("most"), (F.col("size") - F.col("top.k")).alias("others"), "hub"), "open-shingles")
    return saved(attach(rows, facts, "key", "size", rows.count(), "inner"), "open-prefixes")


def _hub_pairs(prefixes: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets and the most central one that shares a shingle of the prefix."""
    rows = _open_prefixes(prefixes, of).filter("label <> hub.label").withColumn("_n", F.col("hub.n")).withColumn("_place", F.col("hub.place"))
    return rows.filter(_may_link(percent)).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _prefix_pairs(prefixes: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share a shingle of the prefix.

    One of a pair lies outside the commonest component of the shingle. Those are dealt over one part for each SALT_ROWS
    of them; all sets that have the shingle are copied to each part.
    """
    rows = _open_prefixes(prefixes, of).withColumn("salts", F.ceil(F.col("others") / SALT_ROWS))
    left = rows.filter("label <> most").select("key", "id", "n", "place", "label", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("place").alias("_place"), F.col("label").alias("_label"))
    both = left.join(right, (left["key"] == right["key"]) & (left["salt"] == right["salt"]) & (F.col("label") != F.col("_label")) & _may_link(percent))
    return both.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id it reaches by links), kept.

    Sets of 100 * intersection >= percent * union are linked. Null and empty texts, and texts of white space, have no
    shingles and are linked with nothing. Equal sets are one node of the search, so copies cost nothing. A row without
    id takes the component of an equal set, if one has an id, else none, and is kept only in the latter case. Rows that
    repeat an id are one document: a link of any of them counts for the id. Other columns are ignored. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = saved(sketches(rows, width), "sketches")
    total = drawn.count()
    # with_groups looks for the largest value, so ids are negated; sets without shingles are never grouped
    keyed = drawn.withColumn("_key", F.when(F.col("n") > 0, F.col("fp")).otherwise(F.encode(F.concat(F.lit("id:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8"))).withColumn("_minus", -F.col("id"))
    keys = saved(keyed.select("_key", "_minus"), "set-keys")
    grouped = with_groups(keyed, keys, "_key", "_minus", total).withColumn("rep", F.when(F.col("n") > 0, -F.col("_best")).otherwise(F.col("id")))
    sets = grouped.filter("n > 0 AND id = rep").select("id", "n", "sig")
    joined = links(rows, regions(sets, total), width, percent)
    nodes = saved(grouped.select("id", "n", "rep", "_size"), "nodes")
    weight = nodes.filter("id = rep").select("rep", "_size").distinct()
    facts = saved(weight.join(joined.withColumnRenamed("id", "rep"), "rep"), "components")
    out = attach(nodes.drop("_size"), facts, "rep", "_size", total)
    component = F.coalesce("component", "rep")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a smaller id."""
    marked = near_duplicates(docs, width, percent, id_col, text_col)
    gone = saved(marked.filter("NOT kept AND id IS NOT NULL").select(F.col("id").alias("_id")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("_id"))
    return drop_keys(rows, gone, "_id").select("row.*")


def op5_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=4).withColumnRenamed("id", "doc_id")
