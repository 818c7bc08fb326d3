"""Exact deduplication by a two-pass Bloom filter; DataFrame functions only.

First pass: the 64-bit hash of each text sets SLOTS counters of a blocked Bloom filter (one block of 32,768 counters
for each hash). The counters are summed as rows (slot, count), combined in the map tasks, since a dense filter of every
task would have to grow with the corpus. Slots counted twice or more become the bits of the second filter, one 4 KB
bitmap a block, of `MAX_BLOCKS` blocks at most: its broadcast has a fixed bound. Second pass: a row whose slots are not
all set can't have a copy and passes straight through. Only the other rows are shuffled, by their SHA-256, so false
positives of the filter cost a shuffle and never change a result. Beyond about 16 rows a block bit the filter lets more
rows through to the shuffle, but stays right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import HOT_SHARE, saved

SLOTS = 2
BLOCK_BITS = 32_768
BITS_A_ROW = 16
#: 16,384 blocks of 4 KB: the second filter takes 64 MB at most.
MAX_BLOCKS = 16_384


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _position(key: Column, i: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key, F.lit("slot")), 15 * i), F.lit(BLOCK_BITS).cast("long"))


def _blocks(total: int) -> int:
    return max(1, min(MAX_BLOCKS, 1 << max(0, total * BITS_A_ROW // BLOCK_BITS).bit_length()))


def _slots(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    slots = F.array_distinct(F.array(*[_position(F.col(key), i) for i in range(SLOTS)]))
    return keys.select(_block(F.col(key), blocks).alias("_block"), F.explode(slots).alias("_slot"))


def key_filter(keys: DataFrame, key: str, total: int) -> tuple[DataFrame, int]:
    """A plain Bloom filter of the given keys, in the form of `repeat_filter`."""
    return _slots(keys, key, _blocks(total)).groupBy("_block").agg(F.bitmap_construct_agg("_slot").alias("_bits")), _blocks(total)


def repeat_filter(keys: DataFrame, key: str, total: int) -> tuple[DataFrame, int]:
    """The second filter, a bitmap for each block that has repeated slots, and the number of blocks."""
    blocks = _blocks(total)
    counted = _slots(keys, key, blocks).groupBy("_block", "_slot").count()
    bits = counted.filter("count > 1").groupBy("_block").agg(F.bitmap_construct_agg("_slot").alias("_bits"))
    return bits, blocks


def maybe_repeated(rows: DataFrame, key: str, bits: DataFrame, blocks: int) -> DataFrame:
    """rows with a column `_maybe`: false only where no other row can have the same key."""
    k = F.col(key)

    def is_set(i: int) -> Column:
        at = _position(k, i).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, at % 8) == 1

    found = rows.withColumn("_block", _block(k, blocks)).join(F.broadcast(bits), "_block", "left")
    maybe = F.lit(True)
    for i in range(SLOTS):
        maybe = maybe & is_set(i)
    return found.withColumn("_maybe", F.col("_bits").isNotNull() & maybe).drop("_block", "_bits")


def drop_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in keys (a table with the one column `key`); only rows that pass its filter are shuffled."""
    bits, blocks = key_filter(keys, key, keys.count())
    marked = maybe_repeated(rows, key, saved(bits, "drop-filter"), blocks)
    rest = marked.filter("_maybe").join(keys, key, "left_anti")
    return marked.filter("NOT _maybe").unionByName(rest).drop("_maybe")


def with_groups(rows: DataFrame, keys: DataFrame, key: str, best: str, total: int) -> DataFrame:
    """rows with `_best` (the largest value of `best` among the rows of equal key) and `_size` (their number).

    keys: the key and best columns of all rows, cheap to read again. Groups with over a thousandth of all rows are
    broadcast (at most 1000), the other possibly repeated rows are shuffled, all others pass.
    """
    bits, blocks = repeat_filter(keys, key, total)
    bits = saved(bits, "repeat-filter")
    groups = maybe_repeated(keys, key, bits, blocks).filter("_maybe").groupBy(key).agg(F.max(best).alias("_best"), F.count("*").alias("_size"))
    groups = saved(groups.filter("_size > 1"), "groups")
    hot = F.broadcast(groups.filter(F.col("_size") * HOT_SHARE > F.lit(total)))
    cold = groups.filter(F.col("_size") * HOT_SHARE <= F.lit(total))
    marked = maybe_repeated(rows, key, bits, blocks).join(hot, key, "left")
    here = ~F.col("_maybe") | F.col("_size").isNotNull()
    spread = marked.filter(~here).drop("_best", "_size").join(cold, key, "left")
    out = marked.filter(here).unionByName(spread).drop("_maybe")
    return out.withColumn("_best", F.when(F.col("_size").isNull(), F.col(best)).otherwise(F.col("_best"))).withColumn("_size", F.coalesce("_size", F.lit(1).cast("long")))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), id, digest, keep_id, group_size, kept.

    A null text counts as empty. The row with the largest id of each group stays; a null id is smaller than any other
    and a group without ids has keep_id null and keeps all its rows here (`drop_copies` keeps one). Rows that repeat
    id and text are counted each, and those with the largest id are all marked as kept. Clashing names do no harm: the
    input's columns stay inside `row`. An empty table gives no rows.
    """
    rows = _packed(docs, id_col, text_col)
    keys = saved(rows.select("digest", "id"), "digests")
    out = with_groups(rows, keys, "digest", "id", docs.count())
    return out.select("row", "id", "digest", F.col("_best").alias("keep_id"), F.col("_size").alias("group_size"), F.col("id").eqNullSafe(F.col("_best")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs; exactly one of each group of equal texts."""
    kept = mark_copies(docs, id_col, text_col).filter("kept")
    single = kept.filter("group_size = 1").select("row.*")
    return single.unionByName(kept.filter("group_size > 1").dropDuplicates(["digest"]).select("row.*"))


def op9_query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    marked = mark_copies(docs)
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
