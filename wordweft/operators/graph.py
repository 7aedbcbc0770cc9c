"""Vertices, typed edges and exact graph queries for many words at once.

Queries are rows (query_id, start, target, lemmatized, field_mask, pos_mask): one edge table serves all settings, which
are a residual predicate of the join on the source vertex. Level loops write each level to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import ALL_FIELDS, ALL_POS, has_bit, key_table, pos_id
from ..sources.shared import discard, settle
from .ranks import counted_quantiles, join_by


def assign_node_ids(words: DataFrame) -> DataFrame:
    """node_id, word: dense ids in word order, without a one-task window.

    Words are range-partitioned and numbered within their partition; the only numbers that meet on the driver are
    the partitions' counts.
    """
    spread = words.select("word").where("word is not null").distinct().repartitionByRange("word").sortWithinPartitions("word")
    placed = settle(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "words")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).orderBy("part").collect()
    offset, rows = 0, []
    for r in sizes:
        rows.append((r["part"], offset - r["low"]))
        offset += r["n"]
    shifts = placed.sparkSession.createDataFrame(rows, "part int, shift long")
    return placed.join(F.broadcast(shifts), "part").select((F.col("at") + F.col("shift")).alias("node_id"), "word")


def build_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Link rows with both ends among the nodes and a known key; parallel edges stay."""
    # Nodes are few beside links, which needn't be sorted to meet them.
    source = nodes.select(F.col("node_id").alias("source_id"), "word").hint("shuffle_hash")
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("word").alias("low")).hint("shuffle_hash")
    return (
        links.join(F.broadcast(key_table(links.sparkSession)), "lexical_key")
        .withColumn("low", F.lower("target"))
        .join(source, "word")
        .join(target, "low")
        .select("source_id", "target_id", "edge_type", (F.col("link_field") == "l").cast("int").alias("lemmatized"), F.col("pos").alias("target_pos"))
    )


def filter_edges(edges: DataFrame, lemmatized: bool, fields: int = ALL_FIELDS, tags: int = ALL_POS) -> DataFrame:
    """Legal edges; an empty field or tag set leaves none."""
    return edges.where(
        (F.col("lemmatized") == int(lemmatized)) & has_bit(F.lit(fields), F.col("edge_type")) & has_bit(F.lit(tags), pos_id(F.col("target_pos")))
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "edge_type", "lemmatized").distinct()


def compact_edges(edges: DataFrame) -> DataFrame:
    """Edges for traversal: one row for each pair, mode, key and tag. What is compact already is left as it is."""
    if "pos_id" in edges.columns:
        return edges
    return edges.select("source_id", "target_id", "lemmatized", "edge_type", pos_id(F.col("target_pos")).alias("pos_id")).distinct()


def links_for(words: DataFrame, links: DataFrame, link_field: str, fields: list[str], tags: list[str]) -> DataFrame:
    """word, targets: sorted lower-case legal targets; known words without any get an empty array, others no row."""
    asked = words.select(F.lower("word").alias("word")).distinct()
    known = asked.join(links.select("word").distinct(), "word", "left_semi")
    legal = links.where((F.col("link_field") == link_field) & F.col("lexical_key").isin(fields) & F.col("pos").isin(tags))
    found = legal.select("word", F.lower("target").alias("target")).distinct().groupBy("word").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    return known.join(found, "word", "left").select("word", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def out_neighbors(words: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """word, neighbor, with a row for every parallel edge."""
    start = words.select(F.lower("word").alias("word")).distinct().join(nodes, "word")
    ends = nodes.select(F.col("node_id").alias("target_id"), F.col("word").alias("neighbor"))
    return start.join(edges, start["node_id"] == edges["source_id"]).join(ends, "target_id").select("word", "neighbor")


def out_degree_stats(edges: DataFrame, by: str = "lemmatized") -> DataFrame:
    """by, sources, and mean, least, largest, median, 90th and 99th percentile of edge records a source.

    Everything after the sources' own counts comes from how often each count occurs.
    """
    degree = edges.groupBy(by, "source_id").agg(F.count("*").alias("value"))
    counted = settle(degree.groupBy(by, "value").agg(F.count("*").alias("times")), "degrees")
    n, times = F.col("value"), F.col("times")
    stats = counted.groupBy(by).agg(F.sum(times).alias("sources"), (F.sum(n * times) / F.sum(times)).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
    spread = counted_quantiles(counted, [by], [0.5, 0.9, 0.99]).select(by, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "p90", "p99"))])
    return join_by(stats, spread, [by])


def profile_degrees(edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """out_degree_stats of the edges that each profile allows; parallel edges count, sources without any legal edge do not."""
    legal = edges.withColumn("pos_id", pos_id(F.col("target_pos"))).alias("e").join(profiles.alias("q"), _legal())
    return out_degree_stats(legal.select("q.profile", "e.source_id"), "profile")


def _legal(edges: DataFrame | None = None) -> Column:
    """Whether a query's setting allows an edge, by the numbers of ``legal_pairs`` or by its masks."""
    if edges is not None and "allowed" in edges.columns:
        return F.expr("getbit(e.allowed, q.number) = 1")
    return (
        (F.col("q.lemmatized") == F.col("e.lemmatized"))
        & has_bit(F.col("q.field_mask"), F.col("e.edge_type"))
        & has_bit(F.col("q.pos_mask"), F.col("e.pos_id"))
    )


#: Traversals that share a row of the search state, a bit each.
BLOCK = 62


SETTING = ["lemmatized", "field_mask", "pos_mask"]


def _settings(roots: DataFrame) -> list[tuple]:
    """The settings of roots in order, one more than BLOCK of them at most."""
    return [tuple(r) for r in roots.select(*SETTING).distinct().orderBy(*SETTING).limit(BLOCK + 1).collect()]


def legal_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """source_id, target_id and allowed, a bit for each setting of roots that has a legal edge between the two.

    Keys and tags of parallel edges are read once for all levels. Over BLOCK settings don't fit a row: then ``compact_edges``.
    """
    settings = _settings(roots)
    if len(settings) > BLOCK:
        return settle(compact_edges(edges), "flat_edges")
    pos = F.col("pos_id") if "pos_id" in edges.columns else pos_id(F.col("target_pos"))
    bits = F.lit(0).cast("long")
    for number, (lemmatized, fields, tags) in enumerate(settings):
        legal = (F.col("lemmatized") == lemmatized) & has_bit(F.lit(fields), F.col("edge_type")) & has_bit(F.lit(tags), pos)
        bits = bits.bitwiseOR(F.when(legal, F.lit(1 << number).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = edges.select("source_id", "target_id", bits.alias("bits")).where("bits <> 0")
    return settle(rows.groupBy("source_id", "target_id").agg(F.bit_or("bits").alias("allowed")), "pairs")


def _numbered(rows: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (with SETTING) and the number of their setting in ``legal_pairs`` of roots."""
    if "allowed" not in edges.columns:
        return rows
    number = F.lit(None).cast("int")
    for k, values in enumerate(_settings(roots)):
        same = [F.col(c) == v for c, v in zip(SETTING, values)]
        number = F.when(same[0] & same[1] & same[2], k).otherwise(number)
    return rows.withColumn("number", number)


def _blocks(roots: DataFrame) -> DataFrame:
    """roots with block and bit: traversals of one setting, at most BLOCK a block."""
    shares = roots.count() // BLOCK + 1
    dealt = roots.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)))
    place = F.row_number().over(Window.partitionBy(*SETTING, "share").orderBy("query_id")) - 1
    block = F.xxhash64(*SETTING, "share", F.floor(F.col("place") / BLOCK))
    return dealt.withColumn("place", place).withColumn("block", block).withColumn("bit", F.col("place") % BLOCK).drop("share", "place")


#: Levels after which what traversals have met is merged into one table.
MERGE = 8


def _still_wanted(wanted: DataFrame, fresh: DataFrame) -> DataFrame:
    """block, vertex, bits of the goals that a level hasn't met."""
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("fresh", F.lit(0).cast("long"))))
    return wanted.join(fresh, ["block", "vertex"], "left").select("block", "vertex", left.alias("bits")).where("bits <> 0")


def bfs(roots: DataFrame, edges: DataFrame, max_depth: int | None = None, goals: DataFrame | None = None, only_goals: bool = False) -> DataFrame:
    """query_id, vertex, dist from rows (query_id, vertex, lemmatized, field_mask, pos_mask), one a query.

    edges are a snapshot's, or ``legal_pairs`` of the roots. Traversals go in blocks: a row (block, vertex) holds a bit for each traversal of the
    block that has met the vertex, so many roots cost little more than one. A level stores its new bits alone; what was met
    before goes through the same aggregation as what the level leads to. Ends when no traversal finds a new vertex.
    goals (query_id, vertex): a traversal also ends when it has met all its goals, and does not start without any; with
    only_goals their rows are all that is returned.
    """
    members = settle(_blocks(roots), "members")
    if "allowed" not in edges.columns:
        edges = legal_pairs(edges, members)
    settings = _numbered(members.select("block", *SETTING).distinct(), members, edges)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    none = F.lit(0).cast("long")
    fresh = settle(members.groupBy("block", "vertex").agg(F.bit_or(bit).alias("fresh")), "level")
    asked = None
    if goals is not None:
        asked = settle(goals.join(members.select("query_id", "block", "bit"), "query_id").groupBy("block", "vertex").agg(F.bit_or(bit).alias("bits")), "goals")
    levels, seen, wanted = [fresh], [fresh], asked
    while max_depth is None or len(levels) <= max_depth:
        here = fresh
        if goals is not None:
            left = settle(_still_wanted(wanted, fresh), "wanted")
            if wanted is not asked:
                discard(wanted)
            wanted = left
            active = wanted.groupBy("block").agg(F.bit_or("bits").alias("active"))
            here = fresh.join(active, "block").select("block", "vertex", F.col("fresh").bitwiseAND(F.col("active")).alias("fresh")).where("fresh <> 0")
        # Reached vertices are few beside edges, which needn't be sorted to meet them.
        step = here.join(settings, "block").hint("shuffle_hash").alias("q").join(edges.alias("e"), (F.col("q.vertex") == F.col("e.source_id")) & _legal(edges))
        met = step.select("q.block", F.col("e.target_id").alias("vertex"), F.col("q.fresh").alias("met"), none.alias("held"))
        before = reduce(DataFrame.unionByName, seen).select("block", "vertex", none.alias("met"), F.col("fresh").alias("held"))
        both = met.unionByName(before).groupBy("block", "vertex").agg(F.bit_or("met").alias("met"), F.bit_or("held").alias("held"))
        new = both.select("block", "vertex", F.col("met").bitwiseAND(F.bitwise_not("held")).alias("fresh")).where("fresh <> 0")
        fresh = settle(new, "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen.append(fresh)
        if len(seen) == MERGE:
            seen = [settle(reduce(DataFrame.unionByName, seen).groupBy("block", "vertex").agg(F.bit_or("fresh").alias("fresh")), "seen")]
    if only_goals:
        shown = [x.join(asked, ["block", "vertex"]).select("block", "vertex", F.col("fresh").bitwiseAND(F.col("bits")).alias("fresh")).where("fresh <> 0") for x in levels]
    else:
        shown = levels
    bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda b: F.getbit("fresh", b) == 1)
    each = [x.select("block", "vertex", F.lit(d).alias("dist"), F.explode(bits).alias("bit")) for d, x in enumerate(shown)]
    return reduce(DataFrame.unionByName, each).join(members.select("block", "bit", "query_id"), ["block", "bit"]).select("query_id", "vertex", "dist")


def _roots(queries: DataFrame, nodes: DataFrame, word: str) -> DataFrame:
    """One traversal for each distinct root and setting: root_id, vertex and the setting."""
    wanted = queries.where("field_mask <> 0 and pos_mask <> 0").select(F.lower(word).alias("word"), "lemmatized", "field_mask", "pos_mask").distinct()
    return wanted.join(nodes, "word").select(
        F.xxhash64("word", "lemmatized", "field_mask", "pos_mask").alias("query_id"), F.col("node_id").alias("vertex"), "lemmatized", "field_mask", "pos_mask"
    )


def _root_id(word: str) -> Column:
    return F.xxhash64(F.lower(word), "lemmatized", "field_mask", "pos_mask")


def _rebuild(ends: DataFrame, tree: DataFrame, roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, path (words, root first) from rows (key, root_id, vertex), walking up level by level.

    A vertex's parent is the least id among those one level nearer to the root that have a legal edge to it.
    """
    names = nodes.select(F.col("node_id").alias("vertex"), F.col("word").alias("name"))
    settings = _numbered(roots.select(F.col("query_id").alias("root_id"), *SETTING), roots, edges)
    dist = tree.select(F.col("query_id").alias("root_id"), "vertex", "dist")
    walk = settle(ends.join(dist, ["root_id", "vertex"]).select("key", "root_id", "vertex", "dist", F.array().cast("array<string>").alias("path")), "walk")
    done = []
    while not walk.isEmpty():
        named = settle(walk.join(names, "vertex").select("key", "root_id", "vertex", "dist", F.concat(F.array("name"), "path").alias("path")), "named")
        discard(walk)
        done.append(named.where("dist = 0").select("key", "path"))
        above = named.where("dist > 0").join(settings, "root_id").alias("q").join(edges.alias("e"), (F.col("q.vertex") == F.col("e.target_id")) & _legal(edges))
        above = above.select("key", "root_id", F.col("source_id").alias("vertex"), (F.col("dist") - 1).alias("dist"), "path").join(dist, ["root_id", "vertex", "dist"])
        near = above.groupBy("key").agg(F.min("vertex").alias("vertex"), *[F.first(c).alias(c) for c in ("root_id", "dist", "path")])
        walk = settle(near, "walk")
    return reduce(DataFrame.unionByName, done) if done else walk.select("key", "path")


def shortest_paths(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, path (null without a route), links; equal words give a path of one word, known or not."""
    roots = settle(_roots(queries, nodes, "start"), "roots")
    flat = legal_pairs(edges, roots)
    goal = nodes.select(F.col("node_id").alias("vertex"), F.col("word").alias("low"))
    asked = queries.withColumn("root_id", _root_id("start")).withColumn("low", F.lower("target"))
    known = asked.where(F.lower("start") != F.lower("target")).join(goal, "low")
    tree = settle(bfs(roots, flat, goals=known.select(F.col("root_id").alias("query_id"), "vertex")), "tree")
    ends = known.join(tree.select(F.col("query_id").alias("root_id"), "vertex"), ["root_id", "vertex"])
    paths = _rebuild(ends.select(F.col("query_id").alias("key"), "root_id", "vertex"), tree, roots, nodes, flat)
    out = asked.join(paths.withColumnRenamed("key", "query_id"), "query_id", "left")
    path = F.when(F.lower("start") == F.lower("target"), F.array(F.lower("start"))).otherwise(F.col("path"))
    return out.select("query_id", path.alias("path")).withColumn("links", F.size("path") - 1).withColumn("links", F.when(F.col("path").isNotNull(), F.col("links")))


def collide_paths(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, meeting word, both paths and links: the vertex of least summed distance, least id among equals."""
    sides = queries.select(F.col("start").alias("w"), "lemmatized", "field_mask", "pos_mask").unionByName(
        queries.select(F.col("target").alias("w"), "lemmatized", "field_mask", "pos_mask")
    )
    roots = settle(_roots(sides, nodes, "w"), "roots")
    flat = legal_pairs(edges, roots)
    tree = settle(bfs(roots, flat), "tree")
    asked = queries.withColumn("a_id", _root_id("start")).withColumn("b_id", _root_id("target"))
    left = tree.select(F.col("query_id").alias("a_id"), "vertex", F.col("dist").alias("a"))
    right = tree.select(F.col("query_id").alias("b_id"), "vertex", F.col("dist").alias("b"))
    met = asked.where(F.lower("start") != F.lower("target")).join(left, "a_id").join(right, ["b_id", "vertex"])
    best = met.groupBy("query_id", "a_id", "b_id").agg(F.min(F.struct((F.col("a") + F.col("b")).alias("links"), "vertex")).alias("m"))
    best = settle(best.select("query_id", "a_id", "b_id", "m.links", "m.vertex"), "met")
    ends = best.select(F.concat(F.lit("a"), F.col("query_id").cast("string")).alias("key"), F.col("a_id").alias("root_id"), "vertex").unionByName(
        best.select(F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("key"), F.col("b_id").alias("root_id"), "vertex")
    )
    paths = settle(_rebuild(ends, tree, roots, nodes, flat), "paths")
    mark = F.col("query_id").cast("string")
    out = asked.join(best.select("query_id", "links"), "query_id", "left")
    out = out.join(paths.select(F.col("key").alias("ka"), F.col("path").alias("pa")), F.concat(F.lit("a"), mark) == F.col("ka"), "left")
    out = out.join(paths.select(F.col("key").alias("kb"), F.col("path").alias("pb")), F.concat(F.lit("b"), mark) == F.col("kb"), "left")
    same = F.lower("start") == F.lower("target")
    return out.select(
        "query_id",
        F.when(same, F.array(F.lower("start"))).otherwise(F.col("pa")).alias("start_path"),
        F.when(same, F.array(F.lower("target"))).otherwise(F.col("pb")).alias("target_path"),
        F.when(same, 0).otherwise(F.col("links")).alias("links"),
    )


def distance_table(starts: DataFrame, targets: DataFrame, nodes: DataFrame, edges: DataFrame, lemmatized: int, fields: int = ALL_FIELDS, tags: int = ALL_POS) -> DataFrame:
    """start, target, links for all pairs of the two word lists; infinite when unknown or unreachable.

    Equal unknown words are infinitely far while a graph is there, and at 0 when the constraints leave none.
    """
    pairs = starts.select(F.lower("word").alias("start")).distinct().crossJoin(targets.select(F.lower("word").alias("target")).distinct())
    if not fields or not tags:
        return pairs.withColumn("links", F.when(F.col("start") == F.col("target"), 0.0).otherwise(float("inf")))
    roots = starts.select(F.lower("word").alias("word")).distinct().join(nodes, "word").select(
        F.col("node_id").alias("query_id"), F.col("node_id").alias("vertex"), F.lit(lemmatized).alias("lemmatized"), F.lit(fields).alias("field_mask"), F.lit(tags).alias("pos_mask")
    )
    ids = [nodes.select(F.col("node_id").alias(i), F.col("word").alias(c)) for i, c in (("s", "start"), ("t", "target"))]
    known = settle(pairs.join(ids[0], "start").join(ids[1], "target"), "known")
    goals = known.select(F.col("s").alias("query_id"), F.col("t").alias("vertex"))
    tree = bfs(roots, edges, goals=goals, only_goals=True).select(F.col("query_id").alias("s"), F.col("vertex").alias("t"), "dist")
    met = known.join(tree, ["s", "t"]).select("start", "target", "dist")
    return pairs.join(met, ["start", "target"], "left").select(
        "start", "target", F.coalesce(F.col("dist").cast("double"), F.lit(float("inf"))).alias("links")
    )


def neighborhood(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 2, lemmatized: int = 0) -> DataFrame:
    """node_id of the vertices within k outgoing links of the seed words."""
    roots = seeds.select(F.lower("word").alias("word")).distinct().join(nodes, "word").select(
        F.lit(0).cast("long").alias("query_id"), F.col("node_id").alias("vertex"), F.lit(lemmatized).alias("lemmatized"), F.lit(ALL_FIELDS).alias("field_mask"), F.lit(ALL_POS).alias("pos_mask")
    )
    settings = roots.limit(1)
    # All seeds are one query: its roots differ, its setting is one.
    seen = settle(roots.select("vertex").distinct(), "near")
    out, frontier = [seen], seen
    flat = compact_edges(edges).where(F.col("lemmatized") == lemmatized).select("source_id", "target_id").distinct()
    for _ in range(k if not settings.isEmpty() else 0):
        step = frontier.join(flat, frontier["vertex"] == flat["source_id"]).select(F.col("target_id").alias("vertex")).distinct()
        frontier = settle(step.join(reduce(DataFrame.unionByName, out), "vertex", "left_anti"), "near")
        out.append(frontier)
    return reduce(DataFrame.unionByName, out).select(F.col("vertex").alias("node_id"))


def induced_subgraph(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges whose two ends are kept."""
    kept = vertices.select("node_id").distinct()
    return edges.join(kept, edges["source_id"] == kept["node_id"], "left_semi").join(kept, edges["target_id"] == kept["node_id"], "left_semi")


def graph_parity(links: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """side, source, target of word pairs that only the link index or only the snapshot has."""
    index = links.select(F.col("word").alias("source"), F.lower("target").alias("target")).distinct()
    s, t = nodes.select(F.col("node_id").alias("source_id"), F.col("word").alias("source")), nodes.select(F.col("node_id").alias("target_id"), F.col("word").alias("target"))
    snapshot = edges.select("source_id", "target_id").distinct().join(s, "source_id").join(t, "target_id").select("source", "target")
    return index.exceptAll(snapshot).withColumn("side", F.lit("index")).unionByName(snapshot.exceptAll(index).withColumn("side", F.lit("snapshot")))
