"""Prefix tree of conversations over padded matrices of turn ids.

Turns become 128-bit hashes with word counts, so texts never travel. Equal sequences of up to WIDTH turns are grouped, then
dealt by ranges of their order: the sequences below a node lie in neighbouring shards. A shard is one matrix of turn ids,
a row for each distinct sequence, padded by zero: numpy sorts the rows, column changes OR-accumulated from left to right
mark where the nodes of each depth start, and `reduceat` sums each depth. Nodes that hold a shard's first or last row may
reach into other shards: they leave the shard as two rows with partial sums for each depth, and these rows are folded by
the same function, in fewer shards, until one shard is left.

Conversations longer than WIDTH go on from the node reached, one round for each WIDTH turns that are shared; what no
other conversation shares is a chain, written straight from the turns. So no row is longer than WIDTH turns, and one
conversation may hold any share of all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import WORD, attach, saved

#: Turns of a matrix row, and distinct sequences of a shard.
WIDTH = 64
SHARD = 20_000
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
CELLS = ("n", "rep", "kids", "leaves", "saved", "ends")
EMPTY = {"n": 0, "rep": LAST, "kids": 0, "leaves": 0, "saved": 0, "ends": NONE}
NODE = "prefix long, depth long, rep long, parent long, parent_key string, key string, n long, kids long, leaves long, saved long, ends long"
PATH = "a array<long>, b array<long>, w array<long>, " + ", ".join(f"{c}_at array<long>" for c in CELLS)


def _fill(flat: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Lists of the given sizes as the rows of a padded matrix."""
    out = np.full((len(size), width), pad, np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].combine_chunks().flatten(), np.int64)


def _turn_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 1 for pairs of hashes, in the order of the pairs."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    ids = np.empty(len(a), np.int64)
    ids[order] = np.cumsum(new)
    return ids


def _keys(prefix: int, a: np.ndarray, b: np.ndarray) -> list[str]:
    """The name of the node of each depth on a path, the same in every shard."""
    h = hashlib.blake2b(int(prefix).to_bytes(8, "big", signed=True), digest_size=16)
    out = [h.hexdigest()]
    for x, y in zip(a.tolist(), b.tolist()):
        h.update(x.to_bytes(8, "big", signed=True) + y.to_bytes(8, "big", signed=True))
        out.append(h.copy().hexdigest())
    return out


def fold(table: pa.Table, closed: bool) -> tuple[dict[str, list], dict[str, list]]:
    """The nodes of a shard, and the paths of its first and last row where it is not closed.

    table: prefix, lists a, b (hashes), w (words) of a row's turns, and either c, n, kids, leaves, saved (the row's
    smallest conversation, conversations, and what hangs below its last turn) or lists `*_at` of partial sums by depth.
    """
    size = np.diff(np.asarray(table["a"].combine_chunks().offsets, np.int64))
    longest, many = int(size.max(initial=0)), len(size)
    a, b = _flat(table, "a"), _flat(table, "b")
    ids = _fill(_turn_ids(a, b), size, longest, 0)
    a, b, words = (_fill(v, size, longest, 0) for v in (a, b, _flat(table, "w")))
    prefix = np.asarray(table["prefix"], np.int64)
    if partial := "n_at" in table.column_names:
        cell = {c: _fill(_flat(table, f"{c}_at"), size + 1, longest + 1, EMPTY[c]) for c in CELLS}
    else:
        cell = {c: np.full((many, longest + 1), EMPTY[c], np.int64) for c in CELLS}
        on_path, end = np.arange(longest + 1) <= size[:, None], (np.arange(many), size)
        for c, source in (("n", "n"), ("rep", "c")):
            cell[c] = np.where(on_path, np.asarray(table[source], np.int64)[:, None], cell[c])
        for c, source in (("kids", "kids"), ("leaves", "leaves"), ("saved", "saved"), ("ends", "c")):
            cell[c][end] = np.asarray(table[source], np.int64)
    order = np.lexsort((*(ids[:, j] for j in range(longest - 1, -1, -1)), prefix))
    ids, a, b, words, prefix, size = ids[order], a[order], b[order], words[order], prefix[order], size[order]
    cell = {c: v[order] for c, v in cell.items()}

    change = np.ones((many, longest + 1), bool)
    change[1:, 0] = np.diff(prefix) != 0
    change[1:, 1:] = np.diff(ids, axis=0) != 0
    starts = np.logical_or.accumulate(change, axis=1)
    names = [_keys(prefix[i], a[i, :size[i]], b[i, :size[i]]) for i in (range(many) if partial else sorted({0, many - 1}))]
    first_names, last_names = names[0], names[-1]

    nodes: dict[str, list] = {x.split()[0]: [] for x in NODE.split(", ")}
    ends_of_shard = [] if closed else sorted({0, many - 1})
    paths = {i: {c: [] for c in CELLS} for i in ends_of_shard}
    child_at = np.zeros(0, np.int64)  # first rows of the settled nodes one deeper, with their sums
    child_leaves = child_saved = child_at
    for d in range(longest, -1, -1):
        at = np.flatnonzero(starts[:, d])
        node_of = np.cumsum(starts[:, d]) - 1
        got = {c: (np.minimum if c == "rep" else np.maximum if c == "ends" else np.add).reduceat(cell[c][:, d], at) for c in CELLS}
        up = node_of[child_at]
        np.add.at(got["kids"], up, 1)
        np.add.at(got["leaves"], up, child_leaves)
        np.add.at(got["saved"], up, child_saved)
        real = size[at] >= d
        settled = real.copy()
        for i in ends_of_shard:
            settled[node_of[i]] = False
            if size[i] >= d:
                mine = i == 0 or node_of[i] != 0 or not real[0]
                for c in CELLS:
                    paths[i][c].append(int(got[c][node_of[i]]) if mine else EMPTY[c])
        if d:
            got["leaves"] += got["kids"] == 0
            got["saved"] += (got["n"] - 1) * words[at, d - 1]
        child_at, child_leaves, child_saved = at[settled], got["leaves"][settled], got["saved"][settled]
        nodes["prefix"].append(prefix[child_at])
        nodes["depth"].append(np.full(len(child_at), d))
        for c in CELLS:
            nodes[c].append(got[c][settled])
        nodes["key"].append(np.array([names[i][d] for i in child_at] if partial else [None] * len(child_at), object))
        parent, parent_key = prefix[child_at].copy(), np.full(len(child_at), None, object)
        if d > 1:
            above = np.flatnonzero(starts[:, d - 1])
            above_of = (np.cumsum(starts[:, d - 1]) - 1)[child_at]
            parent = np.minimum.reduceat(cell["rep"][:, d - 1], above)[above_of]
            if not closed:
                parent_key[above_of == 0] = first_names[d - 1] if d - 1 < len(first_names) else None
                in_last = (above_of == len(above) - 1) & (above_of != 0)
                parent_key[in_last] = last_names[d - 1] if d - 1 < len(last_names) else None
        nodes["parent"].append(parent)
        nodes["parent_key"].append(parent_key)
    out = {c: np.concatenate(v) for c, v in nodes.items()}
    path = {"prefix": [int(prefix[i]) for i in paths]}
    path |= {n: [m[i, :size[i]].tolist() for i in paths] for n, m in (("a", a), ("b", b), ("w", words))}
    return out, path | {f"{c}_at": [p[c][::-1] for p in paths.values()] for c in CELLS}


def _fold_shards(closed: bool):
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in f"{NODE}, {PATH}".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # SHARD rows or so of at most WIDTH turns
        if not sum(x.num_rows for x in held):
            return
        nodes, paths = fold(pa.Table.from_batches(held), closed)
        for part in (nodes, paths):
            rows = len(part["prefix"])
            columns = [pa.array(part[f.name], f.type, from_pandas=True) if f.name in part else pa.nulls(rows, f.type) for f in schema]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)

    return run


def _nodes(sequences: DataFrame, many: int, shard: int) -> DataFrame:
    """All nodes of distinct sequences (prefix, a, b, w and their sums); depth counts from the prefix."""
    levels = []
    while True:
        shards = -(-many // shard)
        order = F.arrays_zip("a", "b")
        dealt = sequences.withColumn("_order", order).repartitionByRange(shards, "prefix", "_order").drop("_order") if shards > 1 else sequences.coalesce(1)
        done = saved(dealt.mapInArrow(_fold_shards(shards == 1), f"{NODE}, {PATH}"), "trie-nodes")
        levels.append(done.filter("depth IS NOT NULL").select(*[x.split()[0] for x in NODE.split(", ")]))
        if shards == 1:
            break
        sequences = done.filter("depth IS NULL").select("prefix", *[x.split()[0] for x in PATH.split(", ")])
        many = min(sequences.count(), many - 1)  # two rows a shard: falls for shards of three rows or more
    nodes = reduce(DataFrame.unionByName, levels)
    if len(levels) == 1:
        return nodes.drop("key", "parent_key")
    facts = reduce(DataFrame.unionByName, levels[1:]).select(F.col("key").alias("parent_key"), F.col("rep").alias("_rep"), F.col("kids").alias("_kids"))
    open_ = nodes.filter("parent_key IS NOT NULL")
    found = attach(open_, facts, "parent_key", "_kids", open_.count(), "inner").withColumn("parent", F.col("_rep")).select(nodes.columns)
    return nodes.filter("parent_key IS NULL").unionByName(found).drop("key", "parent_key")


def positions(turns: DataFrame) -> DataFrame:
    """Rows (c, turn, role, a, b, w) with pos, the place in the conversation from 1; no conversation is one group.

    Rows are sorted by ranges and numbered where they stand; a conversation that goes on in the next range adds what
    came before, at most one such offset for each range.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for batch in batches:
            c = np.asarray(batch["c"], np.int64)
            if not len(c):
                continue
            new = np.ones(len(c), bool)
            new[1:] = np.diff(c) != 0
            new[0] = before is None or c[0] != before
            place = np.arange(len(c))
            start = np.maximum.accumulate(np.where(new, place, -1))
            pos = np.where(start < 0, place + seen + 1, place - start + 1)
            before, seen = c[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([batch["c"], pa.array(pos, pa.int64()), batch["a"], batch["b"], batch["w"], batch["range"]], ["c", "pos", "a", "b", "w", "range"])

    dealt = turns.repartitionByRange("c", "turn", "role", "a", "b").sortWithinPartitions("c", "turn", "role", "a", "b").withColumn("range", F.spark_partition_id())
    rows = saved(dealt.mapInArrow(number, "c long, pos long, a long, b long, w long, range int"), "turn-places")
    counts = rows.groupBy("c", "range").agg(F.max("pos").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", before).filter("_before > 0").drop("_n")  # fewer than there are ranges
    return rows.join(F.broadcast(offsets), ["c", "range"], "left").withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("range", "_before")


def rows_of_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, role, a, b, w) of each row: hashes a, b of role and text, w words. Rows without a conversation are left out."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), half(1).alias("a"), half(17).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    return rows.filter("c IS NOT NULL")


def rebuilt(turns: DataFrame, group: int, mix: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, depth, a, b, w) and conversations (c, length).

    The first h turns are those of the conversation c - c % group, h = crc32(c) % mix; then come c's own turns after its
    first h.
    """
    placed = saved(positions(turns), "placed-turns")
    convs = placed.groupBy("c").agg(F.max("pos").alias("own"))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % mix
    bases = convs.select(F.col("c").alias("base"), F.col("own").alias("_base_own"))
    convs = convs.withColumn("h", head).withColumn("base", F.col("c") - F.col("c") % group).join(bases, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("_base_own", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = saved(convs.select("c", "base", "h", "k", "length"), "conversations")
    own = placed.join(convs.select("c", "h", "k"), "c").filter("pos > h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "w")
    firsts = placed.filter((F.col("pos") < mix) & (F.col("c") % group == 0)).withColumnRenamed("c", "base")
    lent = convs.select("c", "base", "h").join(firsts, "base").filter("pos <= h").select("c", F.col("pos").alias("depth"), "a", "b", "w")
    return saved(own.unionByName(lent), "rebuilt-turns"), convs.select("c", "length")


def _hash_ends(ends: DataFrame) -> DataFrame:
    """(g, sha): SHA-256 of the ids c of each group g, ascending and comma-joined, streamed in bounded memory.

    A digest takes its ids one after the other, so the ids of one group, and nothing else, pass through one task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, h = None, None
        for batch in batches:
            g, c = np.asarray(batch["g"], np.int64), np.asarray(batch["c"], np.int64)
            if not len(g):
                continue
            done: list[tuple[int, str]] = []
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for i, j in zip(cuts, cuts[1:]):
                ids = ",".join(map(str, c[i:j].tolist())).encode()
                if h is not None and g[i] == group:
                    h.update(b"," + ids)
                    continue
                if h is not None:
                    done.append((group, h.hexdigest()))
                group, h = int(g[i]), hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([y for _, y in done], pa.string())], ["g", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["g", "sha"])

    return ends.repartition("g").sortWithinPartitions("g", "c").mapInArrow(digest, "g long, sha string")


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (c, depth, a, b, w); convs: (c, length), turnless ones with length 0. A node is named by its smallest
    conversation and its depth; the root's parent is null. No conversations give no rows. shard: three or more.
    """
    spark = turns.sparkSession
    root = convs.agg(F.min("c")).first()[0]
    if root is None:
        return _shape(spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"))
    live, rounds, ended, tails = convs.withColumn("prefix", F.lit(root)), [], [], []
    while True:
        low, high = len(rounds) * width, (len(rounds) + 1) * width
        own = turns.filter((F.col("depth") > low) & (F.col("depth") <= high))
        here = live.join(own, "c", "left").groupBy("c", "prefix", "length").agg(F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("depth", "a", "b", "w")))).alias("t"))  # width turns at most
        here = here.select("c", "prefix", "length", *[F.col(f"t.{x}").alias(x) for x in ("a", "b", "w")])
        here = saved(here.withColumn("skey", F.md5(F.concat_ws(",", F.array(F.col("prefix").cast("string")), F.col("a").cast("array<string>"), F.col("b").cast("array<string>")))), "turn-blocks")
        groups = saved(here.groupBy("skey", "prefix", "a", "b", "w").agg(F.min("c").alias("g"), F.count("*").alias("n"), F.max("length").alias("longest")), "turn-sequences")
        facts = groups.select("skey", "g", "n", "longest")
        members = saved(attach(here.select("c", "length", "skey"), facts, "skey", "n", here.count(), "inner").drop("skey"), "members")
        ended.append(members.filter(F.col("length") <= high).select("g", "c", "n"))
        rounds.append(groups)
        on = members.filter(F.col("length") > high)
        tails.append(turns.filter(F.col("depth") > high).join(on.filter("n = 1").select("c", "length"), "c"))
        live = on.filter("n > 1").select("c", "length", F.col("g").alias("prefix"))
        if live.isEmpty():
            break
    nodes, below = [], None
    for k in range(len(rounds) - 1, -1, -1):
        alone = (F.col("n") == 1) & (F.col("longest") > (k + 1) * width)
        rows = rounds[k].select("prefix", "a", "b", "w", F.col("g").alias("c"), "n", alone.cast("long").alias("kids"), alone.cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            rows = rows.join(below, "c", "left").select("prefix", "a", "b", "w", "c", "n", *[(F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in ("kids", "leaves", "saved")])
        found = saved(_nodes(rows, rounds[k].count(), shard), "trie-round")
        stops = ended[k]
        many, one = stops.filter("n > 1").select("g", "c"), stops.filter("n = 1").select("g", F.sha2(F.col("c").cast("string").cast("binary"), 256).alias("sha"))
        hashes = _hash_ends(many).unionByName(one).withColumnRenamed("g", "ends")
        below = found.filter("depth = 0").select(F.col("prefix").alias("c"), *[F.col(x).alias(f"_{x}") for x in ("kids", "leaves", "saved")])
        found = found.withColumn("ends", F.when(F.col("ends") != F.lit(int(NONE)), F.col("ends"))).join(hashes, "ends", "left").drop("ends")
        if k == 0:
            top = found.filter("depth = 0")
            nodes.append(top.withColumn("parent", F.lit(None).cast("long")).withColumn("leaves", F.col("leaves") + (F.col("kids") == 0).cast("long")))
        nodes.append(found.filter("depth > 0").withColumn("depth", F.col("depth") + k * width))
    every = reduce(DataFrame.unionByName, nodes)
    empty = hashlib.sha256(b"").hexdigest()
    out = every.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))
    last = F.col("depth") == F.col("length")
    chain = reduce(DataFrame.unionByName, tails).select(
        F.col("c").alias("conv_id"), "depth", F.col("c").alias("parent_conv_id"), F.lit(1).alias("n_convs"), F.when(last, 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"),
        F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"))
    return _shape(out).unionByName(_shape(chain))


def _shape(nodes: DataFrame) -> DataFrame:
    longs: list[Column] = [F.col(x).cast("long").alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select(*longs, "ends_sha256")


def conversation_trie(conversations: DataFrame, group: int = 20, mix: int = 4, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """The prefix tree of rebuilt conversations (see `rebuilt` and `trie`).

    Turns go by turn, null first; equal turns by role, then by the hash of role and text. Null roles and texts count as
    empty, texts of any length as their hash and words; rows that repeat are turns of their own. Rows without a
    conversation are left out, other columns are ignored, and an empty table gives no nodes.
    """
    return trie(*rebuilt(rows_of_turns(conversations), group, mix), width=width, shard=shard)


def op12_query(conversations: DataFrame) -> DataFrame:
    return conversation_trie(conversations)


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 20 AS base, max(pos) AS own FROM t GROUP BY c),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 4 AS h FROM v),
k AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.own, 0)) AS k FROM h LEFT JOIN v b ON b.c = h.base),
r AS (SELECT k.c, t.pos AS depth, t.x, t.w FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL SELECT k.c, k.k + t.pos - k.h, t.x, t.w FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
s AS (SELECT k.c, coalesce(list(r.x ORDER BY depth) FILTER (r.x IS NOT NULL), []) AS xs, coalesce(list(r.w ORDER BY depth) FILTER (r.x IS NOT NULL), []) AS ws FROM k LEFT JOIN r USING (c) GROUP BY k.c),
p AS (SELECT c, d, array_to_string(xs[1:d], ',') AS path, array_to_string(xs[1:d - 1], ',') AS up, ws[d] AS w, len(xs) = d AS ends, xs FROM s, unnest(range(0, len(xs) + 1)) AS u(d)),
n AS (SELECT d, path, min(up) AS up, min(c) AS rep, count(*) AS n, coalesce(max(w), 0) AS w, any_value(xs) AS xs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS sha FROM p GROUP BY d, path),
q AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.up = n.path) AS kids FROM n),
a AS (SELECT e.d, array_to_string(q.xs[1:e.d], ',') AS path, (q.kids = 0)::BIGINT AS leaf, (q.n - 1) * q.w AS saved FROM q, unnest(range(0, q.d + 1)) AS e(d)),
z AS (SELECT d, path, sum(leaf) AS leaves, sum(saved) AS saved FROM a GROUP BY d, path)
SELECT q.rep AS conv_id, q.d AS depth, o.rep AS parent_conv_id, q.n AS n_convs, q.kids AS n_children, z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, q.sha AS ends_sha256
FROM q JOIN z ON z.d = q.d AND z.path = q.path LEFT JOIN n o ON o.d = q.d - 1 AND o.path = q.up AND q.d > 0
"""
