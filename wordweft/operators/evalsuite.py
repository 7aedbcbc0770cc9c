"""Search evaluations: profiles, cases, result rows, summaries, finalists, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ALL_FIELDS, ALL_POS, COLLIDE_POS, LEXICAL_KEYS, POS_TAGS, field_mask
from ..functions.scalars import optimality, path_links
from ..sources.shared import settle
from .graph import collide_paths, compact_edges, distance_table, shortest_paths
from .ranks import join_by, quantiles
from .search import SETTING, Algorithm, run_searches

CELL = ["stage", "mode", "profile", "algorithm", "max_cost"]
CASE = ["mode", "profile", "start_word", "target_word"]


def profile_grid(spark: SparkSession) -> DataFrame:
    """profile, lemmatized, field_mask, pos_mask: link mode x glosses or all fields x all or collide tags."""
    rows = [
        (f"{m}__{f}__{p}", lem, fm, pm)
        for m, lem in (("lemma", 1), ("raw", 0))
        for f, fm in (("glosses", field_mask(["glosses"])), ("all-fields", ALL_FIELDS))
        for p, pm in (("all-pos", ALL_POS), ("collide-pos", COLLIDE_POS))
    ]
    return spark.createDataFrame(rows, "profile string, lemmatized int, field_mask int, pos_mask int")


def final_profiles(spark: SparkSession, mode: str) -> DataFrame:
    tags = "all-pos" if mode == "regular" else "collide-pos"
    return profile_grid(spark).where(F.col("profile").isin(f"lemma__glosses__{tags}", f"raw__glosses__{tags}"))


def case_matrix(cases: DataFrame, algorithms: DataFrame, profiles: DataFrame) -> DataFrame:
    """All (case, algorithm, profile) of an evaluation; the three are lists a user writes."""
    return cases.crossJoin(F.broadcast(algorithms)).crossJoin(F.broadcast(profiles))


def incomplete_cells(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """mode, profile cells whose results are not as many as their cases times algorithms."""
    wanted = matrix.groupBy("mode", "profile").agg(F.count("*").alias("wanted"))
    have = results.groupBy("mode", "profile").agg(F.count("*").alias("have"))
    return wanted.join(have, ["mode", "profile"], "left").where(F.coalesce("have", F.lit(0)) != F.col("wanted")).select("mode", "profile")


def _mean(value: Column, condition: Column) -> Column:
    return F.coalesce(F.avg(F.when(condition, value.cast("double"))), F.lit(0.0))


def summarize_results(results: DataFrame, effort: str = "duration_ms") -> DataFrame:
    """One row a cell: counts, rates, effort over rows without error, links and optimality over reachable successes.

    effort: the column behind mean_ms, p50_ms and p95_ms; searches that run in step have words expanded instead of times.
    """
    reachable = F.col("exact_cost").isNotNull()
    success = reachable & (F.col("status") == "success")
    fine = F.col("status") != "error"
    spread = quantiles(results.where(fine), CELL, effort, [0.5, 0.95])
    counts = results.groupBy(*CELL).agg(
        F.count("*").alias("total"),
        F.count_if(reachable).alias("reachable"),
        F.count_if(success).alias("successes"),
        F.coalesce(F.count_if(success) / F.nullif(F.count_if(reachable), F.lit(0)), F.lit(0.0)).alias("success_rate"),
        _mean(F.col(effort), fine).alias("mean_ms"),
        _mean(F.col("combined_links"), success).alias("mean_links"),
        _mean(F.col("optimality"), success).alias("mean_optimality"),
        F.count_if(~fine).alias("errors"),
    )
    told = {n: F.coalesce(F.get("q", F.lit(i)), F.lit(0.0)) for i, n in enumerate(("p50_ms", "p95_ms"))}
    kept = [*counts.columns[: counts.columns.index("mean_ms") + 1], *told, *counts.columns[counts.columns.index("mean_ms") + 1 :]]
    return join_by(counts, spread, CELL, "left").select(*[told[c].alias(c) if c in told else F.col(c) for c in kept])


def rank_finalists(results: DataFrame, mode: str, n: int = 3, effort: str = "duration_ms") -> DataFrame:
    """The n best algorithms of a mode's screening, without any that ever failed with an error."""
    rows = results.where((F.col("stage") == "screening") & (F.col("mode") == mode))
    reachable = F.col("exact_cost").isNotNull()
    success = reachable & (F.col("status") == "success")
    scored = rows.groupBy("algorithm").agg(
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.count_if(success) / F.nullif(F.count_if(reachable), F.lit(0)), F.lit(0.0)).alias("success_rate"),
        _mean(F.col("optimality"), success).alias("mean_optimality"),
    )
    slow = quantiles(rows, ["algorithm"], effort, [0.95])
    scored = join_by(scored, slow, ["algorithm"], "left").withColumn("p95_ms", F.coalesce(F.get("q", F.lit(0)), F.lit(0.0))).drop("q")
    best = scored.where("errors = 0").drop("errors").orderBy(F.desc("success_rate"), F.desc("mean_optimality"), "p95_ms", "algorithm").limit(n)
    if best.count() < n:
        raise ValueError(f"fewer than {n} algorithms without errors")
    return best


def success_by_exact_cost(results: DataFrame) -> DataFrame:
    reached = results.where("exact_cost is not null")
    return reached.groupBy("exact_cost").agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "success").alias("successes"))


def compare_algorithms(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: status changes each way, equal lengths on other paths, longer and shorter results of b."""
    kept = [*CASE, "stage", "max_cost"]
    left = results.where(F.col("algorithm") == a).select(*kept, *[F.col(c).alias(f"a_{c}") for c in ("status", "combined_links", "start_path")])
    right = results.where(F.col("algorithm") == b).select(*kept, *[F.col(c).alias(f"b_{c}") for c in ("status", "combined_links", "start_path")])
    joined = left.join(right, kept)
    both = (F.col("a_status") == "success") & (F.col("b_status") == "success")
    return joined.agg(
        F.count("*").alias("cases"),
        F.count_if((F.col("a_status") == "success") & (F.col("b_status") != "success")).alias("lost"),
        F.count_if((F.col("a_status") != "success") & (F.col("b_status") == "success")).alias("gained"),
        F.count_if(both & (F.col("a_combined_links") == F.col("b_combined_links")) & (F.col("a_start_path") != F.col("b_start_path"))).alias("other_path"),
        F.count_if(both & (F.col("b_combined_links") > F.col("a_combined_links"))).alias("longer"),
        F.count_if(both & (F.col("b_combined_links") < F.col("a_combined_links"))).alias("shorter"),
    )


def sample_n(df: DataFrame, n: int, seed: int, key: str, exact: bool = False) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows however the table is partitioned."""
    chosen = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    if exact and chosen.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return chosen


def suite_cases(curated: DataFrame, generated: DataFrame, n: int) -> DataFrame:
    cases = curated.select("start_word", "target_word").unionByName(generated.select("start_word", "target_word")).distinct()
    if (have := cases.count()) != n:
        raise ValueError(f"{have} cases, not {n}")
    return cases


def generate_regular_cases(nodes: DataFrame, edges: DataFrame, n: int, seed: int, lemmatized: int = 0, least: int = 2, max_cost: int = 8, attempts: int = 8) -> DataFrame:
    """start_word, target_word, exact_cost of n pairs of sampled words with least <= distance < max_cost."""
    words = nodes.where(F.col("word").rlike("^[a-z]{4,12}$")).select("word")
    found = None
    for attempt in range(attempts):
        pool = sample_n(words, max(4 * n, 64), seed + attempt, "word")
        pairs = distance_table(pool, pool, nodes, edges, lemmatized).where((F.col("links") >= least) & (F.col("links") < max_cost))
        pairs = pairs.select(F.col("start").alias("start_word"), F.col("target").alias("target_word"), F.col("links").cast("int").alias("exact_cost"))
        found = pairs if found is None else found.unionByName(pairs).dropDuplicates(["start_word", "target_word"])
        chosen = found.orderBy(F.xxhash64("start_word", "target_word", F.lit(seed)), "start_word", "target_word").limit(n)
        if chosen.count() == n:
            return chosen
    raise ValueError(f"fewer than {n} cases after {attempts} attempts")


def generate_collide_cases(nodes: DataFrame, edges: DataFrame, n: int, seed: int, lemmatized: int = 0, least: int = 2, most: int = 8, attempts: int = 8) -> DataFrame:
    """start_word, target_word, exact_cost of n ordered pairs of distinct sampled words whose exact collide moves both lanes
    and totals least to most links; an error if they aren't found in so many draws of 8 n pairs each."""
    words = nodes.where(F.col("word").rlike("^[a-z]{4,12}$")).select("word")
    found = None
    for attempt in range(attempts):
        pool = sample_n(words, max(4 * n, 16), seed + attempt, "word")
        pairs = pool.select(F.col("word").alias("start")).crossJoin(pool.select(F.col("word").alias("target"))).where("start <> target")
        drawn = pairs.orderBy(F.xxhash64("start", "target", F.lit(seed + attempt)), "start", "target").limit(8 * n)
        setting = [F.lit(v).alias(c) for c, v in zip(SETTING, (lemmatized, ALL_FIELDS, ALL_POS))]
        queries = settle(drawn.select(F.monotonically_increasing_id().alias("query_id"), "start", "target", *setting), "drawn")
        met = collide_paths(queries, nodes, edges).where((F.size("start_path") > 1) & (F.size("target_path") > 1) & F.col("links").between(least, most))
        good = met.join(queries, "query_id").select(F.col("start").alias("start_word"), F.col("target").alias("target_word"), F.col("links").cast("int").alias("exact_cost"))
        found = settle(good if found is None else found.unionByName(good).dropDuplicates(["start_word", "target_word"]), "cases")
        chosen = found.orderBy(F.xxhash64("start_word", "target_word", F.lit(seed)), "start_word", "target_word").limit(n)
        if chosen.count() == n:
            return chosen
    raise ValueError(f"fewer than {n} cases after {attempts} attempts")


def exact_costs(queries: DataFrame, mode: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, exact_cost: links of the exact route, of both lanes in collide mode."""
    found = shortest_paths(queries, nodes, edges) if mode == "regular" else collide_paths(queries, nodes, edges)
    return found.select("query_id", F.col("links").cast("int").alias("exact_cost"))


def search_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of searches by word: source, target, cost 1 and what a setting's masks are held against."""
    ends = [nodes.select(F.col("node_id").alias(f"{x}_id"), F.col("word").alias(x)).hint("shuffle_hash") for x in ("source", "target")]
    return compact_edges(edges).join(ends[0], "source_id").join(ends[1], "target_id").select("source", "target", F.lit(1.0).alias("cost"), "lemmatized", "edge_type", "pos_id")


def _mask_names(mask: str, names: list[str]) -> Column:
    """Sorted names of a mask's bits, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.getbit(F.col(mask).cast("long"), F.lit(names.index(n))) == 1, n) for n in sorted(names)])), ",")


def result_rows(found: DataFrame) -> DataFrame:
    """found (case, setting, mode, paths, exact_cost, error) with links, status and optimality."""
    links = path_links(F.col("mode"), F.col("start_path"), F.col("target_path"), F.col("target_word"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("valid"), "success").otherwise("no_route")
    named = found.select("*", *links, _mask_names("field_mask", LEXICAL_KEYS).alias("lexical_fields"), _mask_names("pos_mask", POS_TAGS).alias("available_pos"))
    return named.select(*[F.col(c) for c in RESULT_COLUMNS if c in named.columns], status.alias("status"), optimality(F.col("exact_cost"), F.col("combined_links")).alias("optimality"), F.lit(None).cast("double").alias("duration_ms"))


RESULT_COLUMNS = [
    *CELL, "lemmatized", "lexical_fields", "available_pos", "start_word", "target_word", "start_path", "target_path", "start_links", "target_links",
    "combined_links", "exact_cost", "error", "expansions", "rounds",
]


def _without_vectors(asked: DataFrame, algorithms: list[Algorithm]) -> DataFrame:
    """query_id of searches whose heuristic has no vector for a target."""
    out = asked.select("query_id").where(F.lit(False))
    ends = asked.select("query_id", "algorithm", F.explode(F.when(F.col("collide"), F.array(F.lower("start"), F.lower("target"))).otherwise(F.array(F.lower("target")))).alias("word"))
    for a in algorithms:
        if hasattr(a.heuristic, "vectors"):
            mine = ends.where((F.col("algorithm") == a.name))
            out = out.unionByName(mine.join(a.heuristic.vectors.select("word"), "word", "left_anti").select("query_id"))
    return out.distinct()


def evaluate_searches(stage: str, mode: str, cases: DataFrame, algorithms: list[Algorithm], profiles: DataFrame, nodes: DataFrame, edges: DataFrame, done: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """A result row for every case x algorithm x profile, all searches run in step, compared with the exact cost.

    cases: start_word, target_word. A target without a vector that its heuristic needs gives an error row, no failed job.
    done: rows of an earlier run; profiles that have all their rows there are kept, others run again. Times are null: what a
    search cost is in expansions and rounds. links: ``search_links`` of the graph, if they are stored already.
    """
    spark = nodes.sparkSession
    names = spark.createDataFrame([(a.name, float(a.max_cost)) for a in algorithms], "algorithm string, max_cost double")
    pairs = cases.select("start_word", "target_word").distinct()
    matrix = settle(case_matrix(pairs, names, profiles.select("profile", *SETTING)).select(F.monotonically_increasing_id().alias("query_id"), F.lit(stage).alias("stage"), F.lit(mode).alias("mode"), "*"), "matrix")
    kept = None
    if done is not None:
        mine = done.where((F.col("stage") == stage) & (F.col("mode") == mode))
        todo = incomplete_cells(matrix, mine)
        kept = mine.join(todo, ["mode", "profile"], "left_anti")
        matrix = settle(matrix.join(todo, ["mode", "profile"], "left_semi"), "matrix")
    asked = matrix.select("query_id", F.col("start_word").alias("start"), F.col("target_word").alias("target"), F.lit(mode == "collide").alias("collide"), "algorithm", *SETTING)
    failed = settle(_without_vectors(asked, algorithms), "failed")
    links = settle(search_links(nodes, edges), "search_links") if links is None else links
    found = settle(run_searches(asked.join(failed, "query_id", "left_anti"), links, algorithms), "found")
    exact = matrix.groupBy("start_word", "target_word", "profile", *SETTING).agg(F.min("query_id").alias("query_id"))
    exact = settle(exact.select("query_id", "profile", F.col("start_word").alias("start"), F.col("target_word").alias("target"), *SETTING), "exact")
    costs = exact_costs(exact, mode, nodes, edges).join(exact.select("query_id", "profile", F.col("start").alias("start_word"), F.col("target").alias("target_word")), "query_id").drop("query_id")
    error = failed.withColumn("error", F.lit("ValueError: a target has no vector"))
    rows = matrix.join(found, "query_id", "left").join(error, "query_id", "left").join(costs, ["start_word", "target_word", "profile"], "left")
    out = result_rows(rows.withColumn("expansions", F.coalesce("spent", F.lit(0))).withColumn("rounds", F.coalesce("rounds", F.lit(0))).withColumn("lemmatized", F.col("lemmatized") == 1))
    return out if kept is None else kept.select(*out.columns).unionByName(out)
