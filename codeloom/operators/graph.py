"""Bounded traversal of call edges, data-flow stages and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab
from codeloom.operators.classify import top_per_group
from codeloom.session import cut_lineage


def call_chain(edges: DataFrame, roots: DataFrame, depth: int = 3, fanout: int | None = None, by_file: bool = False) -> DataFrame:
    """Edges reached from each root, level by level.

    `edges` are trusted, distinct calls with caller/callee name and file; `roots` have root, name and
    file.  The frontier is keyed by name and file; visited callees by name (or name and file).  At most
    `fanout` edges are taken per root and level, if it is given.
    """
    steps = edges.select("caller_name", "caller_file", "callee_name", "callee_file", "callee_line").filter("caller_name <> callee_name").distinct()
    steps = cut_lineage(steps)  # read once per level
    seen_key = ["root", "name", "file"] if by_file else ["root", "name"]
    frontier = roots.select("root", "name", "file")
    visited = frontier.select(*seen_key).distinct()
    out = None
    for level in range(depth):
        near = frontier.select("root", F.col("name").alias("caller_name"), F.col("file").alias("caller_file")).distinct()
        hit = near.join(steps, ["caller_name", "caller_file"])
        if fanout is not None:
            hit = top_per_group(hit, ["root"], [F.col("caller_name"), F.col("caller_file"), F.col("callee_name"), F.col("callee_file"), F.col("callee_line")], fanout, "_rn").drop("_rn")
        hit = hit.withColumn("depth", F.lit(level))
        out = hit if out is None else out.unionByName(hit)
        if level + 1 < depth:
            reached = hit.select("root", F.col("callee_name").alias("name"), F.col("callee_file").alias("file"))
            fresh = reached.distinct().join(visited, seen_key, "left_anti")
            # one file per name when names alone are visited
            frontier = fresh if by_file else fresh.groupBy("root", "name").agg(F.min("file").alias("file"))
            visited = visited.unionByName(frontier.select(*seen_key))
    return out.select("root", "depth", "caller_name", "caller_file", "callee_name", "callee_file", "callee_line")


def call_groups(edges: DataFrame, entries: DataFrame, anchors: DataFrame, n_entries: int | None = None, least: int = 6, depth: int = 3, fanout: int | None = None) -> DataFrame:
    """Edge groups of all entries (or the first n), filled up to `least` groups with anchors in files no group has yet.

    `entries` and `anchors` have name, file and ord.  The fill takes the first anchor, in order, whose file and name no
    group has, and repeats: fewer than `least` rounds of one top-1 each.
    """
    def grouped(found: DataFrame, kind: str) -> DataFrame:
        once = F.row_number().over(W.partitionBy("root", "caller_name", "callee_name").orderBy("depth", "caller_file", "callee_file", "callee_line"))
        return found.withColumn("_rn", once).filter("_rn = 1").drop("_rn").withColumn("kind", F.lit(kind))
    rooted = lambda df: df.withColumn("root", F.concat_ws("@", "name", "file"))
    first = rooted(entries if n_entries is None else entries.orderBy("ord", "name", "file").limit(n_entries))
    groups = cut_lineage(grouped(call_chain(edges, first, depth, fanout, by_file=True), "entry"))
    have = groups.select("root").distinct()
    n = have.limit(least).count()
    if n >= least:
        return groups
    taken_files = first.join(have, "root", "left_semi").select("file")
    callers = edges.select(F.col("caller_name").alias("name"), F.col("caller_file").alias("file")).filter("name IS NOT NULL").distinct()
    left = rooted(anchors).join(callers, ["name", "file"], "left_semi").join(have, "root", "left_anti").join(taken_files, "file", "left_anti")
    covered = groups.select(F.explode(F.array("caller_name", "callee_name")).alias("name"))
    while n < least:
        left = left.join(covered, "name", "left_anti")
        pick = left.orderBy("ord", "name", "file").limit(1)
        more = cut_lineage(grouped(call_chain(edges, pick, depth, fanout, by_file=True), "hotspot"))
        if pick.isEmpty():
            break
        n += 0 if more.isEmpty() else 1
        groups = groups.unionByName(more)
        covered = more.select(F.explode(F.array("caller_name", "callee_name")).alias("name"))
        left = cut_lineage(left.join(pick.select("file"), "file", "left_anti"))
    return groups


def hop_table(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """Symbols reachable forwards and backwards from start ids, with the fewest hops.

    `edges` have src and dst; every level keeps only ids not reached before.
    """
    pairs = edges.select("src", "dst").distinct()
    links = pairs.select(F.lit("callee").alias("direction"), "src", "dst").unionByName(pairs.select(F.lit("caller").alias("direction"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = start.select(F.explode(F.array(F.lit("callee"), F.lit("caller"))).alias("direction"), "id").withColumn("hops", F.lit(0))
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.select("direction", F.col("id").alias("src")).join(links, ["direction", "src"]).select("direction", F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(step.join(reached, ["direction", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached.filter("hops > 0")


def _uncovered(walked: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots, in order of `ord`, whose name no kept earlier root has met; a root without calls is none.

    Roots of one name cover each other, so only the first of a name can stay. Each round keeps the roots that no open
    root could cover and drops those they cover: rounds grow with the longest chain of coverings, not with the roots.
    """
    firsts = roots.join(walked.select("root").distinct(), "root", "left_semi").groupBy("name").agg(F.min(F.struct("ord", "root", "file")).alias("f")).select("name", "f.*")
    met = walked.select("root", F.explode(F.array("caller_name", "callee_name")).alias("name")).distinct()
    by = met.join(firsts.select("root", F.col("ord").alias("by_ord")), "root").withColumnRenamed("root", "by")
    links = cut_lineage(by.join(firsts, "name").filter("by_ord < ord").select("by", "root").distinct())
    dropped = None
    while not links.isEmpty():
        free = links.select("by").distinct().join(links.select(F.col("root").alias("by")).distinct(), "by", "left_anti")
        now = cut_lineage(links.join(free, "by", "left_semi").select("root").distinct())
        dropped = now if dropped is None else dropped.unionByName(now)
        links = cut_lineage(links.join(now, "root", "left_anti").join(now.select(F.col("root").alias("by")), "by", "left_anti"))
    return firsts if dropped is None else firsts.join(dropped, "root", "left_anti")


def flow_sequences(edges: DataFrame, entries: DataFrame, anchors: DataFrame, n_entries: int | None = None, least: int = 3, depth: int = 3) -> DataFrame:
    """Calls of the execution sequences: root, sequence, depth and the call's names, files and callee line.

    `edges` are trusted calls; `entries` and `anchors` have name, file and ord, one place each. All entries (or the
    first n) are walked at once; in their order, one whose name an earlier sequence has met starts none. Fewer than
    `least` sequences are filled up from the anchors by the same rule. `sequence` is the place of the root: anchors
    come after the entries. Without entries, anchors or calls there are no rows.
    """
    def walk(points: DataFrame) -> tuple[DataFrame, DataFrame]:
        roots = points.select(F.concat_ws("@", "name", "file").alias("root"), "name", "file", F.col("ord").cast("bigint").alias("ord"))
        return cut_lineage(call_chain(edges, roots, depth)), roots

    def numbered(walked: DataFrame, kept: DataFrame) -> DataFrame:
        return walked.join(kept.select("root", F.col("ord").alias("sequence")), "root")

    walked, roots = walk(entries if n_entries is None else entries.orderBy("ord", "name", "file").limit(n_entries))
    kept = cut_lineage(_uncovered(walked, roots))
    out = numbered(walked, kept)
    have = kept.limit(least).count()
    if have >= least:
        return out
    covered = out.select(F.explode(F.array("caller_name", "callee_name")).alias("name")).distinct()
    last = roots.agg(F.max("ord").alias("last"))
    after = anchors.join(covered, "name", "left_anti").withColumn("ord", F.col("ord") + F.coalesce(last.select(F.col("last") + 1).scalar(), F.lit(0)))
    more, points = walk(after)
    fill = _uncovered(more, points).orderBy("ord").limit(least - have)
    return out.unionByName(numbered(more, fill))


def flow_facts(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row for each call that a sequence holds, however many do: smallest sequence and depth, order of discovery
    (`ord`, sortable text) and whether an entry makes it.

    `edges` are trusted calls with src and dst; parallel calls of a pair stay rows of their own.
    """
    key = ["caller_name", "caller_file", "callee_name", "callee_file", "callee_line"]
    pad = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    step = F.concat_ws(".", pad("sequence"), F.col("depth").cast("string"))
    first = sequences.groupBy(*key).agg(F.min("sequence").alias("sequence"), F.min("depth").alias("depth"), F.min(step).alias("step"), F.bool_or(F.col("depth") == 0).alias("is_entry"))
    return edges.join(first, key).withColumn("ord", F.concat_ws(".", "step", pad("src"), pad("dst"))).drop("step")


def stage_keys(edges: DataFrame) -> DataFrame:
    """Order keys of every symbol (name and file) in the chains: smallest sequence, depth, call line and place.

    `edges` have caller/callee name and file, sequence, depth, call_line, ord and is_entry.
    """
    sides = edges.select("sequence", "depth", "ord", F.inline(F.array(
        F.struct(F.col("caller_name").alias("name"), F.col("caller_file").alias("file"), F.when(F.col("call_line") > 0, F.col("call_line")).alias("call_line"), F.col("is_entry"), F.lit(1).alias("as_caller"), F.lit(0).alias("as_callee")),
        F.struct(F.col("callee_name").alias("name"), F.col("callee_file").alias("file"), F.lit(None).cast("int").alias("call_line"), F.lit(False).alias("is_entry"), F.lit(0).alias("as_caller"), F.lit(1).alias("as_callee")))))
    out = sides.groupBy("name", "file").agg(
        F.min("sequence").alias("sequence"), F.min("depth").alias("depth"), F.coalesce(F.min("call_line"), F.lit(0)).alias("call_line"),
        F.min("ord").alias("first_seen"), F.bool_or("is_entry").alias("is_entry"), F.max("as_caller").alias("c"), F.max("as_callee").alias("d"))
    return out.withColumn("is_terminal", (F.col("c") == 0) | (F.col("d") == 0)).drop("c", "d")


INPUT_KINDS = ("fs-read", "directory-read", "config", "env", "http", "ipc", "db")
OUTPUT_KINDS = ("fs-write", "directory-write", "remove", "stdout")
VOID = r"^(?::\s*)?(?:Promise\s*<\s*void\s*>|void)$"


def build_stages(keys: DataFrame, symbols: DataFrame, params: DataFrame, args: DataFrame, io: DataFrame) -> DataFrame:
    """Data stages with role, input and output source and whether their shape is known.

    `symbols` have id, name, file, start_line and return_type; `params` id and type; `args` the callee's id;
    `io` id and kind.  Inputs come from arguments, else typed parameters, else I/O; outputs from the return
    type, else I/O.  A symbol without any evidence is no stage.
    """
    facts = keys.join(symbols.select("id", "name", "file", "start_line", "return_type", "signature"), ["name", "file"], "left")
    typed = params.filter("type IS NOT NULL").groupBy("id").agg(F.count("*").alias("typed_params"))
    given = args.groupBy("id").agg(F.count("*").alias("n_args"))
    kind = F.col("kind")
    kinds = io.groupBy("id").agg(
        F.count("*").alias("n_io"), F.bool_or(kind.isin(*INPUT_KINDS)).alias("reads"), F.bool_or(kind == "process").alias("runs"), F.bool_or(kind.isin(*OUTPUT_KINDS)).alias("writes"))
    rows = facts.join(typed, "id", "left").join(given, "id", "left").join(kinds, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    returns = F.coalesce(F.trim("return_type"), F.lit("")) != ""
    useful = returns & ~F.coalesce(F.col("return_type").rlike(VOID), F.lit(False))
    evidence = (n("typed_params") > 0) | useful | (n("n_args") > 0) | (n("n_io") > 0) | F.col("is_entry") | F.col("is_terminal")
    role = F.when(F.col("is_entry"), "entry").when(b("reads"), "io-boundary").when(b("runs"), "external-process").when(b("writes"), "output").otherwise("transform")
    inputs = F.when(n("n_args") > 0, "args").when(n("typed_params") > 0, "params").when(b("reads"), "io").otherwise("none")
    outputs = F.when(returns, "return").when(b("writes") | b("runs"), "io").otherwise("none")
    out = rows.filter(evidence).select("name", "file", "id", "sequence", "depth", "call_line", F.coalesce("start_line", F.lit(0)).alias("start_line"), "is_entry", role.alias("role"), inputs.alias("input"), outputs.alias("output"))
    return out.withColumn("known", (F.col("input") != "none") & (F.col("output") != "none"))


def stage_order(stages: DataFrame, n: int | None = 24) -> DataFrame:
    """Entry first, then sequence, depth, call line (else start line), name and file."""
    line = F.when(F.col("call_line") > 0, F.col("call_line")).otherwise(F.col("start_line"))
    order = [F.col("is_entry").desc(), F.col("sequence"), F.col("depth"), line, F.col("name"), F.col("file"), F.col("id")]
    return stages.orderBy(*order) if n is None else stages.orderBy(*order).limit(n)


def transitions(edges: DataFrame, stages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges that carry data and touch a stage; `carries` is false for the control-only rest.

    `evidence` has name and file of symbols with typed parameters, a business return or I/O, and `io`.
    """
    once = F.row_number().over(W.partitionBy("caller_name", "caller_file", "callee_name", "callee_file", "call_line").orderBy("ord"))
    rows = edges.withColumn("_rn", once).filter("_rn = 1").drop("_rn")
    side = lambda p, cols: evidence.select(F.col("name").alias(f"{p}_name"), F.col("file").alias(f"{p}_file"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = rows.join(side("caller", ["io"]), ["caller_name", "caller_file"], "left").join(side("callee", ["io", "shaped"]), ["callee_name", "callee_file"], "left")
    staged = stages.select("name", "file").distinct()
    mark = lambda p: staged.select(F.col("name").alias(f"{p}_name"), F.col("file").alias(f"{p}_file"), F.lit(True).alias(f"{p}_staged"))
    rows = rows.join(mark("caller"), ["caller_name", "caller_file"], "left").join(mark("callee"), ["callee_name", "callee_file"], "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    data = (F.col("n_args") > 0) | f("callee_shaped") | f("caller_io") | f("callee_io")
    return rows.withColumn("carries", data & (f("caller_staged") | f("callee_staged"))).select("caller_name", "caller_file", "callee_name", "callee_file", "call_line", "ord", "n_args", "carries")


def dataflow_coverage(stages: DataFrame, moves: DataFrame, keys: DataFrame, io: DataFrame, types: DataFrame, bodies: DataFrame) -> DataFrame:
    """Coverage numbers of the data-flow facts, one row per counter."""
    def one(df: DataFrame, **counts: Column) -> DataFrame:
        row = df.agg(*[c.alias(k) for k, c in counts.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).cast("bigint").alias("n")) for k in counts])))
    return (
        one(keys, symbols_considered=F.count("*"))
        .unionByName(one(stages, stages=F.count("*"), typed_stages=F.count_if((F.col("input") == "params") | (F.col("output") == "return")), unknown_stages=F.count_if(~F.col("known"))))
        .unionByName(one(moves, transitions=F.count_if("carries"), data_bearing_transitions=F.count_if("carries"), control_only_transitions=F.count_if(~F.col("carries"))))
        .unionByName(one(io.join(stages.select("id").distinct(), "id", "left_semi"), io_events=F.count("*")))
        .unionByName(one(types, type_definitions=F.count("*")))
        .unionByName(one(bodies.join(stages.select("id").distinct(), "id", "left_semi"), approximated_bodies=F.count_if("approximated"))))


def subgraph_symbols(symbols: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """Documented or complex symbols of each topic's files; `members` have topic and file."""
    usable = symbols.filter("NOT is_test AND (docstring IS NOT NULL OR complexity > 5)").filter(F.col("label").isin("Class", "Method", "Function"))
    inside = members.join(usable, "file")
    return top_per_group(inside, ["topic"], [F.col("complexity").desc(), F.col("id")], n).select("topic", "rank", "id", "name", "file", "complexity")


def subgraph_edges(edges: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """Trusted calls between files of the same topic."""
    a = members.select("topic", F.col("file").alias("caller_file"))
    b = members.select("topic", F.col("file").alias("callee_file"))
    calls = edges.select("caller_name", "caller_file", "callee_name", "callee_file", "callee_line").distinct()
    inside = calls.join(a, "caller_file").join(b, ["topic", "callee_file"])
    order = [F.col("caller_name"), F.col("caller_file"), F.col("callee_name"), F.col("callee_file"), F.col("callee_line")]
    return top_per_group(inside, ["topic"], order, n)


def subgraph_boundaries(boundaries: DataFrame, topic_modules: DataFrame, n: int | None = None) -> DataFrame:
    """Busiest module boundaries that touch a topic's modules."""
    ends = boundaries.select("*", F.explode(F.array("from_module", "to_module")).alias("module"))
    hit = ends.join(topic_modules.select("topic", "module").distinct(), "module").select("topic", "from_module", "to_module", "call_count").distinct()
    return top_per_group(hit, ["topic"], [F.col("call_count").desc(), F.col("from_module"), F.col("to_module")], n)


def topic_files(clusters: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Production files of the symbols each cluster names; `clusters` have id and node (one row per top node)."""
    known = files.filter(~X.is_test_path(F.col("path"))).select(F.col("path").alias("file"))
    named = symbols.filter("NOT is_test").select("name", "file", "module")
    return clusters.select("id", F.col("node").alias("name")).join(named, "name").join(known, "file", "left_semi").select("id", "file", "module").distinct()


def topic_candidates(sizes: DataFrame, cluster_files: DataFrame, shells: DataFrame, members: int = 5, least_files: int = 3, least_modules: int = 2) -> DataFrame:
    """Clusters large and wide enough to be a topic, with at least one file of substance."""
    solid = cluster_files.join(shells.select(F.col("path").alias("file"), F.lit(True).alias("shell")), "file", "left")
    wide = solid.groupBy("id").agg(
        F.countDistinct("file").alias("files"), F.countDistinct("module").alias("modules"), F.bool_or(F.col("shell").isNull()).alias("solid"))
    kept = sizes.filter((F.col("members") >= members) & (F.col("top_nodes") >= 3)).join(wide, "id")
    kept = kept.filter((F.col("files") >= least_files) & (F.col("modules") >= least_modules) & F.col("solid"))
    return kept.select("id", "members", "cohesion", F.round(F.col("members") * F.col("cohesion"), 6).alias("weight"), "files", "modules")


def select_topics(candidates: DataFrame, cluster_files: DataFrame, n: int = 4, overlap: float = 0.5) -> DataFrame:
    """Greedy choice by weight: a candidate stands unless it overlaps an accepted topic.

    At most n topics are accepted, so the search takes the best candidate, drops all that overlap it, and
    repeats: n rounds of one small top-1 and one join.
    """
    left = cut_lineage(candidates.select("id", "weight"))
    sets = cut_lineage(cluster_files.select("id", "file").distinct().join(left.select("id"), "id", "left_semi"))
    sizes = sets.groupBy("id").agg(F.count("*").alias("size"))
    chosen = []
    for _ in range(n):
        best = left.orderBy(F.col("weight").desc(), "id").limit(1).collect()
        if not best:
            break
        pick = best[0]["id"]
        chosen.append((pick, len(chosen) + 1))
        mine = sets.filter(F.col("id") == pick).select("file")
        size = mine.count()
        shared = sets.join(mine, "file", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
        near = shared.join(sizes, "id").filter(F.col("shared") / (F.col("size") + size - F.col("shared")) > overlap).select("id")
        left = cut_lineage(left.join(near, "id", "left_anti"))
    spark = candidates.sparkSession
    picked = spark.createDataFrame(chosen, "id BIGINT, place INT")
    return candidates.join(F.broadcast(picked), "id").select("place", "id", "weight")


def boundary_topic(boundaries: DataFrame, files: DataFrame, shells: DataFrame, least_files: int = 3) -> DataFrame:
    """The topic that stands in where no cluster qualifies: production files of both ends of the busiest module boundary.

    None if these are fewer than `least_files` or nothing but shells. `files` have path and module.
    """
    top = boundaries.filter("call_count > 0").orderBy(F.col("call_count").desc(), "from_module", "to_module").limit(1)
    ends = top.select(
        F.concat_ws("-", F.lit("topic"), "from_module", "to_module").alias("id"), F.concat("from_module", F.lit(" ↔ "), "to_module", F.lit(" 协作")).alias("title"),
        F.explode(F.array_distinct(F.array("from_module", "to_module"))).alias("module"))
    members = files.filter(~X.is_test_path(F.col("path"))).select(F.col("path").alias("file"), "module").join(ends, "module")
    marked = members.join(shells.select(F.col("path").alias("file"), F.lit(True).alias("shell")), "file", "left")
    fit = marked.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(F.col("shell").isNull()).alias("solid")).filter((F.col("n") >= least_files) & F.col("solid"))
    return members.join(fit.select("id"), "id", "left_semi").select("id", "title", "file")


def name_topics(topics: DataFrame, cluster_files: DataFrame, labels: DataFrame, top_nodes: DataFrame, source_dirs: DataFrame) -> DataFrame:
    """Title and slug of every topic: own label, else two type names, else directory tokens, else module pair.

    `topics` have place and id; `labels` id and label; `top_nodes` id, pos and node; `source_dirs` dir.  Equal slugs get -2, -3 ...
    """
    dirs = cluster_files.join(topics.select("id"), "id", "left_semi").select("id", "file", F.explode(F.expr("slice(split(file, '/'), 1, greatest(size(split(file, '/')) - 1, 0))")).alias("seg"))
    folded = dirs.select("id", F.lower("seg").alias("word")).distinct()
    own = labels.join(topics.select("id"), "id", "left_semi").filter("label <> '' AND NOT contains(label, '/')")
    own = own.withColumn("word", F.lower("label")).join(folded, ["id", "word"], "left_anti").join(source_dirs.select(F.col("dir").alias("label")), "label", "left_anti").select("id", "label")
    types = top_nodes.join(topics.select("id"), "id", "left_semi").filter(F.col("node").rlike(r"^[A-Z][A-Za-z0-9_]{3,}$"))
    types = top_per_group(types, ["id"], [F.col("pos"), F.col("node")], 2, "r")
    pair = types.groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("node"))).alias("t1"), F.max(F.when(F.col("r") == 2, F.col("node"))).alias("t2")).filter("t2 IS NOT NULL")
    usable = dirs.filter(~F.lower("seg").isin(*vocab.GENERIC_SEGMENTS) & ~F.col("seg").rlike(r"^\d"))
    generic = source_dirs.select(F.lower("dir").alias("low")).distinct()
    usable = usable.withColumn("low", F.lower("seg")).join(generic, "low", "left_anti")
    freq = usable.select("id", "file", "seg").distinct().groupBy("id", "seg").agg(F.count("*").alias("n"))
    # keep the best tokens that share no file with a better one
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("n").desc(), "seg"))
    ranked = freq.withColumn("r", rank)
    spread = usable.select("id", "file", "seg").distinct()
    worse = spread.join(ranked.select("id", "seg", "r"), ["id", "seg"])
    best_in_file = worse.withColumn("lead", F.min("r").over(W.partitionBy("id", "file")))
    token = best_in_file.groupBy("id", "seg", "r").agg(F.bool_and(F.col("r") == F.col("lead")).alias("free")).filter("free")
    token = top_per_group(token, ["id"], [F.col("r")], 3, "place_no")
    tokens = token.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place_no", "seg"))).alias("ts")).filter(F.size("ts") >= 2).select("id", F.transform("ts", lambda t: t["seg"]).alias("tokens"))
    mods = cluster_files.join(topics.select("id"), "id", "left_semi").select("id", "module").distinct()
    mods = top_per_group(mods, ["id"], [F.col("module")], 2, "m").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "module"))).alias("ms")).filter(F.size("ms") >= 2)
    mods = mods.select("id", F.transform("ms", lambda t: t["module"]).alias("mods"))
    rows = topics.select("place", "id").join(own, "id", "left").join(pair, "id", "left").join(tokens, "id", "left").join(mods, "id", "left")
    title = F.coalesce(
        F.col("label"), F.concat("t1", F.lit(" · "), "t2", F.lit(" 协作")), F.concat(F.array_join("tokens", " · "), F.lit(" 跨模块协作")), F.concat(F.array_join("mods", " ↔ "), F.lit(" 协作")))
    kebab = lambda c: F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-")), "^-+|-+$", ""), F.lit(""))
    base = F.coalesce(kebab(F.array_join("tokens", "-")), kebab(F.concat_ws("-", F.when(F.col("t2").isNotNull(), F.concat_ws("-", "t1", "t2")))), kebab(F.array_join("mods", "-")), kebab(title), F.concat(F.lit("topic-"), F.col("id").cast("string")))
    named = rows.select("place", "id", title.alias("title"), base.alias("slug"))
    again = F.row_number().over(W.partitionBy("slug").orderBy("place"))
    return named.withColumn("k", again).select("place", "id", "title", F.when(F.col("k") > 1, F.concat_ws("-", "slug", "k")).otherwise(F.col("slug")).alias("slug"))
