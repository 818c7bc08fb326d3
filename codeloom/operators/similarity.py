"""Set overlap without comparing all pairs, and set operations on names, topics and pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.operators.classify import top_per_group
from codeloom.session import cut_lineage


def set_groups(members: DataFrame, key: str, element: str) -> tuple[DataFrame, DataFrame]:
    """Split keyed sets into distinct sets and their owners.

    Returns (owners[key, set_id], sets[set_id, element, size]).  Copies of one set share an id, the smallest of their
    keys, so a group of equal sets costs one set, however many keys own it.
    """
    held = _held(members, key, element)
    first = held.groupBy("print").agg(F.min(key).alias("set_id"))
    return held.select(key, "print").join(first, "print").select(key, "set_id"), _distinct_sets(held, key)


def _held(members: DataFrame, key: str, element: str) -> DataFrame:
    """The set of each key, [key, elements, size, print], with a fingerprint: the size and two 64-bit hashes in order of elements.

    A null element counts for the size, but is equal to no other.
    """
    none = F.max(F.col(element).isNull()).alias("none")
    rows = members.groupBy(key).agg(F.array_sort(F.collect_set(element)).alias("elements"), none)
    size = (F.size("elements") + F.col("none").cast("int")).cast("bigint")
    prints = F.struct(size.alias("size"), F.xxhash64("elements").alias("h1"), F.xxhash64(F.lit("\u0001"), "elements").alias("h2"), "none")
    return cut_lineage(rows.select(key, "elements", size.alias("size"), prints.alias("print")))


def _distinct_sets(held: DataFrame, key: str) -> DataFrame:
    # of null and other keys the others
    first = held.groupBy("print").agg(F.min(key).alias("set_id"), F.min_by("elements", key).alias("elements")).filter("set_id IS NOT NULL")
    return first.select("set_id", F.explode("elements").alias("element"), F.col("print.size").alias("size"))


#: Sets of at most this size are matched by pairs of elements, larger ones by single elements.
PAIRED = 8
#: Where the smaller set has at most this many elements, prefixes travel with the join; larger sets meet in blocks.
AT_HAND = 64
#: Meetings of two sets in one element that a task looks at, about.
MEETINGS = 2_000_000
#: Elements of the larger sets that one side of a block holds, about.
BLOCK = 8_000_000
#: Meetings that a block holds at a time, about.
AT_ONCE = 4_000_000


def jaccard_sets(sets: DataFrame, threshold: float, strict: bool = False, matches: int = 4) -> DataFrame:
    """Pairs of distinct sets with a Jaccard of at least the threshold (above it, when strict).

    Prefix filter: elements are ordered from rare to frequent.  Where the smaller set has at most PAIRED elements, see
    `_by_pairs`, to AT_HAND `_by_elements`, beyond `_by_blocks`; what they find is counted exactly.
    """
    vectors = _vectors(sets)
    # below a half, one common element may do for two distinct sets
    paired = PAIRED if threshold > 0.5 or (strict and threshold == 0.5) else 0
    candidates = _by_elements(vectors.filter(F.col("size") > paired), threshold, matches)
    if paired:
        placed = vectors.filter(F.col("size") <= paired / threshold + 1e-9).select("set_id", "size", F.posexplode("tokens").alias("pos", "element")).withColumn("pos", F.col("pos") + 1)
        candidates = candidates.unionByName(_by_pairs(placed, threshold, strict, paired))
    mine = candidates.join(vectors.select(F.col("set_id").alias("a"), F.col("tokens").alias("xs")), "a")
    counted = mine.join(vectors.select(F.col("set_id").alias("b"), F.col("tokens").alias("ys")), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("xs", "ys")).cast("bigint").alias("shared"))
    shared = counted.unionByName(_by_blocks(vectors, threshold, matches))
    score = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    kept = score > threshold if strict else score >= threshold - 1e-12
    return shared.withColumn("jaccard", score).filter(kept).select("a", "b", "shared", "jaccard")


def _vectors(sets: DataFrame) -> DataFrame:
    """[set_id, size, tokens]: the places of a set's elements among all elements, from rare to frequent."""
    freq = sets.groupBy("element").agg(F.count("*").alias("df")).filter("element IS NOT NULL")
    numbered = cut_lineage(freq.orderBy("df", "element").select("element", F.monotonically_increasing_id().alias("id")))
    # one row for each partition
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    begins, before = {}, 0
    for row in sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        begins[row["part"]], before = before, before + row["n"]
    begin = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in begins.items() for x in pair]), part) if begins else F.lit(0)
    tokens = numbered.select("element", (begin + at).cast("int" if before < 1 << 31 else "bigint").alias("token"))
    placed = sets.join(tokens, "element").groupBy("set_id", "size").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return cut_lineage(placed)


def _least(size: Column, matches: int) -> Column:
    """Elements of their prefixes that sets of at least this size must share, or all they have to."""
    return F.least(F.lit(matches), 1 + F.floor(size / 4))


def _band(size: Column, threshold: float) -> Column:
    """Sizes that differ by no more than the threshold allows lie in the same or in neighbouring bands."""
    return F.floor(F.log(size) / math.log(1 / threshold) + 1e-9).cast("int") if 0 < threshold < 1 else F.lit(0)


def _by_elements(vectors: DataFrame, threshold: float, matches: int) -> DataFrame:
    """Candidates [a, b, na, nb] by single elements, where the smaller set has at most AT_HAND.

    Two matching sets share k elements (or as many as they must share, when that is less) among the first
    |x| - ceil(2t / (1 + t) * |x|) + k of the smaller and the first |y| - ceil(t * |y|) + k of
    the larger, where k grows with the size of a set up to `matches`.  Only those are joined, so frequent elements
    hardly ever meet.  The join also asks for sizes of one band.
    """
    def first(share: float, name: str, size: str, own: str) -> DataFrame:
        length = F.col("size") - F.ceil(share * F.col("size") - 1e-9) + _least(F.col("size"), matches)
        return vectors.select(F.col("set_id").alias(name), F.col("size").alias(size), F.slice("tokens", F.lit(1), F.greatest(length, F.lit(0)).cast("int")).alias(own))
    small = first(2 * threshold / (1 + threshold), "a", "na", "xs").withColumn("band", _band(F.col("na"), threshold))
    nb = _band(F.col("nb"), threshold)
    large = first(threshold, "b", "nb", "ys").withColumn("band", F.explode(F.array(nb, nb - 1) if 0 < threshold < 1 else F.array(F.lit(0))))
    needed = F.least(_least(F.col("na"), matches), F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9))
    return _at_hand(small.filter(F.col("na") <= AT_HAND), large.filter(F.col("nb") <= AT_HAND / threshold if threshold > 0 else F.lit(True)), needed, threshold)


def _at_hand(small: DataFrame, large: DataFrame, needed: Column, threshold: float) -> DataFrame:
    """Candidates [a, b, na, nb] that share `needed` prefix elements at least, each pair at the first it shares.

    A pair that shares too few is dropped where it meets, so that pairs are never grouped.  Elements that many sets
    share are dealt over as many tasks as their meetings ask for.
    """
    left, right = small.withColumn("e", F.explode("xs")), large.withColumn("e", F.explode("ys"))
    count = lambda df, name: df.groupBy("e", "band").agg(F.count("*").alias(name))
    meetings = cut_lineage(count(left, "m").join(count(right, "n"), ["e", "band"]).select("e", "band", (F.col("m") * F.col("n")).alias("met")))
    total = meetings.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
    tasks = int(total // MEETINGS) + 1
    # at most total / MEETINGS keys
    crowded = meetings.filter(F.col("met") > MEETINGS).select("e", "band", F.ceil(F.col("met") / MEETINGS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(crowded, ["e", "band"], "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    right = right.join(crowded, ["e", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    key = ["e", "band", "part"]
    both = F.array_intersect("xs", "ys")
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key)
    return met.filter(_may_match(threshold) & (F.size(both) >= needed) & (F.element_at(both, 1) == F.col("e"))).select("a", "b", "na", "nb")


def _by_pairs(placed: DataFrame, threshold: float, strict: bool, most: int) -> DataFrame:
    """Candidates [a, b, na, nb] by two common elements, where the smaller set has at most `most`.

    Above a half, distinct sets that match share two elements, o = ceil(t * |x|) at least, so the two rarest stand among
    the first |x| - o + 2 of either.  Two elements together are rare even where each of them is frequent.
    """
    least = F.floor(threshold * F.col("size") + 1e-9) + 1 if strict else F.ceil(threshold * F.col("size") - 1e-9)
    first = placed.filter((F.col("size") >= 2) & (F.col("size") <= most / threshold + 1e-9) & (F.col("pos") <= F.col("size") - least + 2))
    # at most `most` * (1 / t - 1) + 2 elements each
    prefix = first.groupBy("set_id", "size").agg(F.array_sort(F.collect_list(F.xxhash64("element"))).alias("es"))
    both = F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda y: F.xxhash64(x, y))))
    keyed = prefix.select("set_id", "size", F.explode(both).alias("two"))
    small = keyed.select(F.col("set_id").alias("a"), F.col("size").alias("na"), "two")
    large = keyed.select(F.col("set_id").alias("b"), F.col("size").alias("nb"), "two")
    return small.join(large, "two").filter(_may_match(threshold) & (F.col("na") <= most)).select("a", "b", "na", "nb").distinct()


def _by_blocks(vectors: DataFrame, threshold: float, matches: int) -> DataFrame:
    """Pairs [a, b, na, nb, shared] of sets of more than AT_HAND elements, counted exactly.

    Sets of a band are dealt over parts of about BLOCK elements; each two parts of one or of neighbouring bands meet in one
    task.  So a set is written once for each part it meets, and pairs that share too little are never written.
    """
    large = vectors.filter(F.col("size") > AT_HAND).withColumn("band", _band(F.col("size"), threshold))
    # a few bands: their number grows with the logarithm of the largest set
    weights = {r["band"]: r["n"] for r in large.groupBy("band").agg(F.sum("size").alias("n")).collect()}
    parts = {band: -(-n // BLOCK) for band, n in weights.items()}
    kind = vectors.schema["set_id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, na bigint, nb bigint, shared bigint"
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    n_parts = lambda band: F.coalesce(F.try_element_at(table, band), F.lit(0)).cast("int")
    cell = lambda band, i, other, j, side: F.struct(band.alias("band"), i.alias("i"), other.alias("other"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    band, mine = F.col("band"), F.col("part")
    own = F.transform(upto(n_parts(band)), lambda j: F.when(mine <= j, cell(band, mine, band, j, 0)).otherwise(cell(band, j, band, mine, 1)))
    after = F.transform(upto(n_parts(band + 1)), lambda j: cell(band, mine, band + 1, j, 0))
    before = F.transform(upto(n_parts(band - 1)), lambda i: cell(band - 1, i, band, mine, 1))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("set_id"), n_parts(band)).cast("int")).select("set_id", "size", "tokens", F.inline(F.concat(own, after, before)))
    tasks = sum(n * (n + 1) // 2 + n * parts.get(band + 1, 0) for band, n in parts.items())
    keys = ["band", "i", "other", "j"]

    meetings = _meetings(threshold, matches)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        alone = first["band"] == first["other"] and first["i"] == first["j"]
        rows = rows.sort_values(["size", "set_id"], ignore_index=True)
        ids, sizes, side = rows["set_id"].to_numpy(), rows["size"].to_numpy(), rows["side"].to_numpy()
        found = [*meetings(rows["tokens"].tolist(), sizes, None if alone else side)]
        a, b, shared = (np.array([f[k] for f in found], dtype="int64") for k in range(3))
        return pd.DataFrame({"a": ids[a], "b": ids[b], "na": sizes[a], "nb": sizes[b], "shared": shared})

    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInPandas(meet, schema)


def _meetings(threshold: float, matches: int) -> Callable[[list, np.ndarray, np.ndarray | None], Iterator[tuple[int, int, int]]]:
    """A search in the sets of a block: places of two sets, the smaller first, and the number of elements they share.

    Sets come by size, as sorted tokens. With sides, only sets of different sides meet. Prefixes are those of `_by_elements`;
    what two sets may still share behind the shorter of them must do for the threshold. The functions stand inside, so that
    tasks get them without this package.
    """
    def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers from each begin on, as many as its length."""
        ends = np.cumsum(lengths)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)

    def meetings(tokens: list, sizes: np.ndarray, side: np.ndarray | None, at_once: int = AT_ONCE) -> Iterator[tuple[int, int, int]]:
        n, lengths = len(sizes), np.array([len(x) for x in tokens])
        flat = np.concatenate(tokens).astype("int64")
        starts = np.concatenate([[0], np.cumsum(lengths)])
        least = np.minimum(matches, 1 + sizes // 4)

        def prefix(share: float) -> tuple[np.ndarray, np.ndarray]:
            """Its length, and its last token."""
            length = np.clip(sizes - np.ceil(share * sizes - 1e-9).astype("int64") + least, 0, lengths)
            return length, np.where(length > 0, flat[np.clip(starts[:-1] + length - 1, 0, len(flat) - 1)], -1)

        (as_a, last_a), (as_b, last_b) = prefix(2 * threshold / (1 + threshold)), prefix(threshold)
        # sets from there on are too large
        high = np.searchsorted(sizes, sizes / threshold + 1e-9, side="right") if threshold > 0 else np.full(n, n)

        def judged(a: np.ndarray, b: np.ndarray, met: np.ndarray) -> Iterator[tuple[int, int, int]]:
            needed = np.ceil(threshold / (1 + threshold) * (sizes[a] + sizes[b]) - 1e-9).astype("int64")
            rest = np.where(last_a[a] <= last_b[b], sizes[a] - as_a[a], sizes[b] - as_b[b])
            kept = (met >= np.minimum(least[a], needed)) & (met + rest >= needed)
            for x, y in zip(a[kept], b[kept]):
                xs, ys = tokens[x], tokens[y]
                at = np.searchsorted(ys, xs)
                yield x, y, int(np.count_nonzero(ys[np.minimum(at, len(ys) - 1)] == xs))

        for asked, held in ((None, None),) if side is None else ((0, 1), (1, 0)):
            mine, queries = (np.arange(n) if s is None else np.flatnonzero(side == s) for s in (held, asked))
            # tokens with the places of their sets, so that those after a set and not too large are one span
            index = np.sort(flat[spans(starts[mine], as_b[mine])] * n + np.repeat(mine, as_b[mine]))
            of = np.repeat(queries, as_a[queries])
            token = flat[spans(starts[queries], as_a[queries])] * n
            begin = np.searchsorted(index, token + of + 1)
            many = np.maximum(np.searchsorted(index, token + high[of]) - begin, 0)
            total = np.concatenate([[0], np.cumsum(many)])
            edges = np.concatenate([[0], np.cumsum(as_a[queries])])  # of each query among the tokens
            k = 0
            while k < len(queries):
                to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + at_once, side="right")) - 1)
                if to == k + 1:  # one set, its tokens a few at a time
                    met, t = np.zeros(n, dtype="int64"), edges[k]
                    while t < edges[to]:
                        u = max(t + 1, min(edges[to], int(np.searchsorted(total, total[t] + at_once, side="right")) - 1))
                        met += np.bincount(index[spans(begin[t:u], many[t:u])] % n, minlength=n)
                        t = u
                    b = np.flatnonzero(met)
                    yield from judged(np.full(len(b), queries[k]), b, met[b])
                else:
                    part = slice(edges[k], edges[to])
                    pair, met = np.unique(np.repeat(of[part], many[part]) * n + index[spans(begin[part], many[part])] % n, return_counts=True)
                    yield from judged(pair // n, pair % n, met)
                k = to

    return meetings


def _may_match(threshold: float) -> Column:
    """Each pair once, the smaller set first, with sizes that allow the threshold."""
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return ordered & (F.col("na") >= threshold * F.col("nb") - 1e-9)


def overlaps(members: DataFrame, key: str, element: str, threshold: float, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Overlapping sets in compact form: (owners[key, set_id], pairs[a, b, shared, jaccard] of distinct sets).

    Every two owners of one set_id overlap fully; every owner of `a` overlaps every owner of `b`.
    """
    owners, sets = set_groups(members, key, element)
    return owners, jaccard_sets(sets, threshold, strict)


def overlap_groups(members: DataFrame, key: str, element: str, threshold: float, strict: bool = False) -> DataFrame:
    """One row per pair of distinct overlapping sets, and one per set with copies: first owners and owner counts."""
    held = _held(members, key, element)
    pairs = jaccard_sets(_distinct_sets(held, key), threshold, strict)
    sized = held.groupBy("print").agg(F.min(key).alias("first"), F.count("*").alias("owners"))
    a = sized.select(F.col("first").alias("a"), F.col("first").alias("first_a"), F.col("owners").alias("owners_a"))
    b = sized.select(F.col("first").alias("b"), F.col("first").alias("first_b"), F.col("owners").alias("owners_b"))
    crossed = pairs.join(a, "a").join(b, "b")
    swap = F.col("first_a") > F.col("first_b")
    crossed = crossed.select(
        F.when(swap, F.col("first_b")).otherwise(F.col("first_a")).alias("first_a"), F.when(swap, F.col("first_a")).otherwise(F.col("first_b")).alias("first_b"),
        F.when(swap, F.col("owners_b")).otherwise(F.col("owners_a")).alias("owners_a"), F.when(swap, F.col("owners_a")).otherwise(F.col("owners_b")).alias("owners_b"),
        F.round("jaccard", 6).alias("jaccard"))
    copies = sized.filter("owners > 1").select(F.col("first").alias("first_a"), F.col("first").alias("first_b"), F.col("owners").alias("owners_a"), F.col("owners").alias("owners_b"), F.lit(1.0).alias("jaccard"))
    return crossed.unionByName(copies)


def jaccard(pairs: DataFrame, members: DataFrame, key: str, element: str) -> DataFrame:
    """Jaccard of given pairs [a, b] of keys; 0 when either set is empty."""
    sets = members.select(key, element).distinct()
    sizes = sets.groupBy(key).agg(F.count("*").alias("n"))
    wanted = pairs.select("a", "b").distinct()
    left = wanted.join(sets.select(F.col(key).alias("a"), F.col(element).alias("e")), "a")
    shared = left.join(sets.select(F.col(key).alias("b"), F.col(element).alias("e")), ["b", "e"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = wanted.join(shared, ["a", "b"], "left").join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b", "left")
    n = F.coalesce("shared", F.lit(0))
    score = F.when(n == 0, 0.0).otherwise(n / (F.col("na") + F.col("nb") - n))
    return out.select("a", "b", n.alias("shared"), F.round(score, 6).alias("jaccard"))


def table_overlap(first_columns: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best first-column Jaccard between tables of equal header, for given page pairs; flagged from the threshold."""
    cells = first_columns.select("page", "table_line", "header", "value").distinct()
    sizes = cells.groupBy("page", "table_line", "header").agg(F.count("*").alias("n"))
    l = pairs.select("a", "b").distinct().join(cells.select(F.col("page").alias("a"), F.col("table_line").alias("ta"), "header", "value"), "a")
    hit = l.join(cells.select(F.col("page").alias("b"), F.col("table_line").alias("tb"), "header", "value"), ["b", "header", "value"])
    shared = hit.groupBy("a", "ta", "b", "tb").agg(F.count("*").alias("shared"))
    na = sizes.select(F.col("page").alias("a"), F.col("table_line").alias("ta"), F.col("n").alias("na"))
    nb = sizes.select(F.col("page").alias("b"), F.col("table_line").alias("tb"), F.col("n").alias("nb"))
    scored = shared.join(na, ["a", "ta"]).join(nb, ["b", "tb"]).withColumn("j", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    best = scored.groupBy("a", "b").agg(F.round(F.max("j"), 6).alias("overlap"))
    return best.withColumn("duplicated", F.col("overlap") >= threshold)


def containment(parts: DataFrame, base: DataFrame, group: list[str], element: str, threshold: float = 0.7) -> DataFrame:
    """Share of each group's elements that the base holds; folded from the threshold."""
    own = parts.select(*group, element).distinct()
    known = base.select(element, F.lit(1).alias("hit")).distinct()
    out = own.join(known, element, "left").groupBy(*group).agg(F.count("*").alias("size"), F.count("hit").alias("covered"))
    return out.withColumn("fold", F.col("covered") / F.col("size") >= threshold)


def affinity(page_files: DataFrame, page_terms: DataFrame, pages: DataFrame) -> DataFrame:
    """Shared files and shared terms of the given page pairs [a, b]."""
    def shared(df: DataFrame, column: str, name: str) -> DataFrame:
        mine = pages.join(df.select(F.col("page").alias("a"), F.col(column).alias("e")).distinct(), "a")
        return mine.join(df.select(F.col("page").alias("b"), F.col(column).alias("e")).distinct(), ["b", "e"]).groupBy("a", "b").agg(F.count("*").alias(name))
    both = shared(page_files, "file", "shared_files").join(shared(page_terms, "term", "shared_terms"), ["a", "b"], "full_outer")
    return both.na.fill(0, ["shared_files", "shared_terms"])


COMPLEMENT_REASON = "互补职责"


def related_links(affinities: DataFrame, complements: DataFrame, planned: DataFrame, top: int = 3) -> DataFrame:
    """Complement pages first, then the closest planned pages of other directories, with the reason.

    `affinities` have a, b, shared_files and shared_terms; `complements` a and b; `planned` page and dir.
    """
    known = planned.select("page", "dir")
    both = complements.select("a", "b").union(complements.select("b", "a")).distinct()
    comp = both.join(known.select(F.col("page").alias("b")), "b", "left_semi").select("a", "b", F.lit(0).alias("tier"), F.lit(COMPLEMENT_REASON).alias("reason"), F.lit(0).alias("rank"))
    rest = affinities.join(both, ["a", "b"], "left_anti").join(known.select(F.col("page").alias("a"), F.col("dir").alias("dir_a")), "a").join(known.select(F.col("page").alias("b"), F.col("dir").alias("dir_b")), "b").filter("dir_a <> dir_b")
    total = (F.col("shared_files") + F.col("shared_terms")).desc()
    best = top_per_group(rest, ["a"], [total, F.col("b")], top)
    bits = F.concat_ws("、", F.when(F.col("shared_files") > 0, F.concat(F.lit("共享 "), "shared_files", F.lit(" 个源文件"))), F.when(F.col("shared_terms") > 0, F.concat(F.lit("共享 "), "shared_terms", F.lit(" 个符号"))))
    return comp.unionByName(best.select("a", "b", F.lit(1).alias("tier"), bits.alias("reason"), "rank"))


def same_numbers(sequences: DataFrame) -> DataFrame:
    """Number sequences shown under more than one header: header count, page count and one owner per header."""
    counts = sequences.groupBy("sequence").agg(F.countDistinct("header").alias("headers"), F.countDistinct("page").alias("pages"), F.max("n").alias("n")).filter("headers >= 2")
    owner = sequences.groupBy("sequence", "header").agg(F.min("page").alias("first_page"), F.countDistinct("page").alias("header_pages"))
    return counts.join(owner, "sequence")


def test_only(names: DataFrame) -> DataFrame:
    """Names seen in tests but not in production; `names` have name and is_test."""
    return names.filter("is_test").select("name").distinct().join(names.filter("NOT is_test").select("name"), "name", "left_anti")


def merge_pinned(discovered: DataFrame, locked: DataFrame, files: DataFrame) -> DataFrame:
    """Discovered topics and the pinned ones with new ids, their files cut to the existing; one row per topic file."""
    pinned = locked.filter("pinned").join(discovered.select("id").distinct(), "id", "left_anti")
    kept = pinned.join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return discovered.select("id", "title", "file", F.lit(False).alias("pinned")).unionByName(kept.select("id", "title", "file", F.lit(True).alias("pinned")))


def merge_stack(production: DataFrame, tests: DataFrame) -> DataFrame:
    """Distinct production stack, and the test stack without it."""
    prod = production.select("package").distinct()
    only = tests.select("package").distinct().join(prod, "package", "left_anti")
    return prod.withColumn("scope", F.lit("production")).unionByName(only.withColumn("scope", F.lit("test")))
