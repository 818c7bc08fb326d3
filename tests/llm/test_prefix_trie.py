import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from codeloom.llm import prefix_trie as pt
from tests.llm.helpers import rows

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(table, group=20, mix=4):
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % mix
        whole[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if whole[c] == node).encode()).hexdigest()
    return sorted([(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in members.items()], key=repr)


def random_table(seed, convs, longest, words=3):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            out.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", " ".join(["w"] * rng.randint(0, words) if rng.random() < 0.8 else ["x", str(c)])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width,shard", [(64, 7), (3, 5)])
def test_against_brute_force(spark, width, shard):
    table = random_table(width * shard, 90, 9)
    got = pt.conversation_trie(spark.createDataFrame(table, SCHEMA).repartition(5), width=width, shard=shard)
    assert rows(got, *OUT) == brute(table)


def test_copies_and_one_long_conversation(spark):
    # a third of the conversations are equal, one holds a third of all turns, two share a long beginning
    table = [(c, t, "user", f"same {t}") for c in range(0, 60, 2) for t in range(4)]
    table += [(c, t, "user", f"own {c}" if t == 0 else f"t {t}") for c in (101, 103) for t in range(150 + 50 * (c == 103))]
    table += [(c, 0, None, None) for c in range(200, 230)]
    got = pt.conversation_trie(spark.createDataFrame(table, SCHEMA).repartition(7), width=4, shard=5)
    assert rows(got, *OUT) == brute(table)


def test_nulls_ties_and_clashing_columns(spark):
    table = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (-7, 0, "u", "neg"), (-7, 1, "u", "b " * 50_000), (None, 0, "u", "none"), (21, None, "", ""), (21, 5, "u", "ü x\ty")]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS c", "2 AS g", "'z' AS prefix", "4 AS depth")
    assert rows(pt.conversation_trie(df, mix=1), *OUT) == brute(table, mix=1)
    assert rows(pt.conversation_trie(df), *OUT) == brute(table)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(empty).columns == list(OUT) and pt.conversation_trie(empty).count() == 0


def test_places_across_ranges(spark):
    table = [(c, t, "user", str(t)) for c, n in ((1, 500), (2, 3), (3, 40)) for t in range(n)]
    placed = pt.positions(pt.rows_of_turns(spark.createDataFrame(table, SCHEMA).repartition(6)))
    assert rows(placed, "c", "pos") == rows(spark.createDataFrame([(c, t + 1) for c, t, _, _ in table], "c long, pos long"), "c", "pos")
