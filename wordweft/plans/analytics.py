"""Queries on races, search results, training rows and vectors, from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ALL_FIELDS, ALL_POS, POS_TAGS, pos_name
from ..functions.scalars import cosine_similarity, cost_features, learned_score, neg_euclidean, optimality
from ..operators import embed, evalsuite, races, training
from ..sources import adapters, io
from ..sources.adapters import SQL_GRAPH, SQL_STEPS
from ..sources.shared import settle, shared_dir
from ..streaming import races as live
from .lexical import _games, _graph


def race_stats(spark, sf_dir):
    return races.race_aggregates(adapters.race_steps(spark, sf_dir))


SQL_RACES = f"""with {SQL_STEPS}, ends as (select game, player, arg_max(case when side = 'start' then word end, case when side = 'start' then ts_ms * 1000000 + event_id end) as a,
  arg_max(case when side = 'target' then word end, case when side = 'target' then ts_ms * 1000000 + event_id end) as b, count(*) - 2 as link_count,
  greatest(max(case when side = 'start' then ts_ms end) - min(case when side = 'start' then ts_ms end), max(case when side = 'target' then ts_ms end) - min(case when side = 'target' then ts_ms end)) as duration_ms
  from steps group by game, player)
select game, player, a = b as found, link_count, duration_ms from ends"""


def race_lanes(spark, sf_dir):
    """The same figures from ordered step arrays, with whole seconds and the outcome's name."""
    steps = adapters.race_steps(spark, sf_dir)
    found = races.race_table(steps)
    named = races.summaries(found, _games(spark, sf_dir).select("game", "mode"))
    return found.join(named, ["game", "player"])


SQL_LANES = f"""with r as ({SQL_RACES}) select game, player, found, link_count, duration_ms, duration_ms // 1000 as seconds, link_count as links, case when game % 2 = 0 then 'reached' else 'collided' end as outcome from r"""


def step_times(spark, sf_dir):
    return races.step_times(adapters.race_steps(spark, sf_dir)).select("event_id", "game", "player", "side", "ms", "label")


SQL_TIMES = f"""with {SQL_STEPS}, t as (select *, ts_ms - lag(ts_ms) over (partition by game, player, side order by ts_ms, event_id) as ms from steps)
select event_id, game, player, side, ms, case when ms is null then 'Start' when ms < 60000 then (ms // 1000) || '.' || (ms % 1000) // 100 || 's' else (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' end as label from t"""


def games_with_players(spark, sf_dir):
    steps = adapters.race_steps(spark, sf_dir)
    links = steps.groupBy("game", "player").agg(F.min("ts_ms").alias("joined_ms"))
    players = steps.groupBy("player").agg(F.count("*").alias("steps"))
    return races.games_with_players(_games(spark, sf_dir).select("game", "mode"), links, players)


SQL_JOINED = f"""with {SQL_STEPS} select l.game, case when l.game % 2 = 0 then 'normal' else 'collide' end as mode, l.player, joined_ms, steps
from (select game, player, min(ts_ms) as joined_ms from steps group by game, player) l join (select player, count(*) as steps from steps group by player) p on p.player = l.player"""


def _event_files(spark: SparkSession, sf_dir: str, base: str) -> str:
    """A folder of event files; a file stream watches folders, and the table may be one file."""
    adapters.table(spark, sf_dir, "events").repartition(4).write.parquet(f"{base}/in")
    return f"{base}/in"


def live_race_state(spark, sf_dir):
    """Race figures by a stream over the event files, run to their end; each batch writes the rows that it changed."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    steps = live.step_stream(spark, _event_files(spark, sf_dir, base), adapters.table(spark, sf_dir, "events").schema, files_per_trigger=2)
    live.upsert(live.live_race_state(steps), f"{base}/out", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return live.latest(spark, f"{base}/out", ["game", "player"])


def validated_steps(spark, sf_dir):
    """Steps judged by a stream over the event files, some of them there twice: both sinks read back."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = adapters.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = f"{base}/in"
    events.unionByName(events.where("event_id % 10 = 0")).repartition(4).write.parquet(source)
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    steps = read.select(
        (F.col("user_id") % 27).alias("game"), F.col("user_id").alias("player"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("target").alias("side"),
        F.upper("event_type").alias("w"), F.col("event_type").alias("l"), pos_name(F.col("event_id") % len(POS_TAGS)).alias("pos"), "ts", "event_id",
    )
    games = _games(spark, sf_dir)
    words = events.select(F.col("event_type").alias("word")).distinct()
    playable = games.select("game").crossJoin(words).where((F.col("game") + F.length("word")) % 3 != 0)
    judged = live.validate_step_stream(steps, games, playable, "5000 days")
    live.step_sinks(judged, f"{base}/out", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "game", "player", "side", "word", F.col("accepted").cast("boolean").alias("accepted"), "reason")


SQL_JUDGED = f"""with s as (select distinct event_id, user_id % 27 as game, user_id as player, case when event_id % 2 = 0 then 'start' else 'target' end as side, event_type, ({adapters.SQL_TAGS})[event_id % 18 + 1] as pos from events),
r as (select *, case when game >= 25 or game not in (select user_id % 25 from events) then 'no game' when game % 2 = 1 and pos in ('ADP','AUX','CCONJ','DET','PART','PRON','SCONJ') then 'tag not allowed' when (game + length(event_type)) % 3 = 0 then 'not playable' end as reason from s)
select event_id, game, player, side, case when game >= 25 or game % 3 <> 0 then upper(event_type) else event_type end as word, reason is null as accepted, reason from r"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search results: one row for each customer (case) and algorithm."""
    one = adapters.table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 4).alias("alg")).agg(F.min("o_orderkey").alias("k"))
    exact = F.when(F.col("o_custkey") % 7 != 0, 1 + F.col("o_custkey") % 6).cast("int")
    status = F.when(F.col("k") % 11 == 0, "error").when(F.col("k") % 5 == 0, "no_route").otherwise("success")
    rows = one.select(
        F.lit("screening").alias("stage"), F.when(F.col("o_custkey") % 2 == 0, "regular").otherwise("collide").alias("mode"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string")).alias("profile"), F.concat(F.lit("alg"), F.col("alg").cast("string")).alias("algorithm"),
        F.lit(8.0).alias("max_cost"), F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("start_word"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("target_word"),
        status.alias("status"), exact.alias("exact_cost"), (F.col("k") * 37 % 1000 / 4.0).alias("duration_ms"), "k",
    )
    links = F.when(F.col("status") == "success", F.coalesce("exact_cost", F.lit(1)) + F.col("k") % 3).cast("int")
    rows = rows.withColumn("combined_links", links).withColumn("optimality", optimality(F.col("exact_cost"), F.col("combined_links")))
    return rows.withColumn("start_path", F.array("start_word", (F.col("k") % 2).cast("string")))


SQL_RESULTS = """results as (select *, case when status = 'success' then coalesce(exact_cost, 1) + k % 3 end as combined_links from (
  select 'screening' as stage, case when o_custkey % 2 = 0 then 'regular' else 'collide' end as mode, 'p' || o_custkey % 4 as profile, 'alg' || alg as algorithm, 8.0::double as max_cost,
    o_custkey, case when k % 11 = 0 then 'error' when k % 5 = 0 then 'no_route' else 'success' end as status, case when o_custkey % 7 <> 0 then 1 + o_custkey % 6 end as exact_cost, (k * 37 % 1000) / 4.0 as duration_ms, k
  from (select o_custkey, o_orderkey % 4 as alg, min(o_orderkey) as k from orders group by o_custkey, o_orderkey % 4))),
scored as (select *, case when exact_cost is not null and combined_links > 0 then exact_cost::double / combined_links end as optimality from results)"""


def summaries(spark, sf_dir):
    out = evalsuite.summarize_results(_results(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c in ("success_rate", "mean_ms", "p50_ms", "p95_ms", "mean_links", "mean_optimality") else F.col(c) for c in out.columns])


SQL_SUMMARY = f"""with {SQL_RESULTS} select stage, mode, profile, algorithm, max_cost, count(*) as total, count(exact_cost) as reachable, count(*) filter (where exact_cost is not null and status = 'success') as successes,
  round(coalesce(count(*) filter (where exact_cost is not null and status = 'success')::double / nullif(count(exact_cost), 0), 0), 6) as success_rate,
  round(coalesce(avg(duration_ms) filter (where status <> 'error'), 0)::double, 6) as mean_ms, round(coalesce(quantile_cont(duration_ms::double, 0.5) filter (where status <> 'error'), 0), 6) as p50_ms,
  round(coalesce(quantile_cont(duration_ms::double, 0.95) filter (where status <> 'error'), 0), 6) as p95_ms, round(coalesce(avg(combined_links) filter (where exact_cost is not null and status = 'success'), 0), 6) as mean_links,
  round(coalesce(avg(optimality) filter (where exact_cost is not null and status = 'success'), 0), 6) as mean_optimality, count(*) filter (where status = 'error') as errors
from scored group by stage, mode, profile, algorithm, max_cost"""


def success_by_cost(spark, sf_dir):
    return evalsuite.success_by_exact_cost(_results(spark, sf_dir))


SQL_BY_COST = f"with {SQL_RESULTS} select cast(exact_cost as integer) as exact_cost, count(*) as cases, count(*) filter (where status = 'success') as successes from results where exact_cost is not null group by exact_cost"


def head_to_head(spark, sf_dir):
    return evalsuite.compare_algorithms(_results(spark, sf_dir), "alg0", "alg1")


SQL_HEAD = f"""with {SQL_RESULTS} select count(*) as cases, count(*) filter (where a.status = 'success' and b.status <> 'success') as lost, count(*) filter (where a.status <> 'success' and b.status = 'success') as gained,
  count(*) filter (where a.status = 'success' and b.status = 'success' and a.combined_links = b.combined_links and a.k % 2 <> b.k % 2) as other_path,
  count(*) filter (where a.status = 'success' and b.status = 'success' and b.combined_links > a.combined_links) as longer, count(*) filter (where a.status = 'success' and b.status = 'success' and b.combined_links < a.combined_links) as shorter
from results a join results b on a.o_custkey = b.o_custkey where a.algorithm = 'alg0' and b.algorithm = 'alg1'"""


def finalists(spark, sf_dir):
    """The best of a screening in which one algorithm failed with errors and the others only found no route."""
    results = _results(spark, sf_dir)
    told = F.when((F.col("status") == "error") & (F.col("algorithm") != "alg3"), "no_route").otherwise(F.col("status"))
    out = evalsuite.rank_finalists(results.withColumn("status", told), "regular", 3)
    return out.select("algorithm", *[F.round(c, 6).alias(c) for c in ("success_rate", "mean_optimality", "p95_ms")])


SQL_FINAL = f"""with {SQL_RESULTS}, r as (select *, case when status = 'error' and algorithm <> 'alg3' then 'no_route' else status end as told from scored where mode = 'regular'),
s as (select algorithm, round(count(*) filter (where exact_cost is not null and told = 'success')::double / count(exact_cost), 6) as success_rate,
  round(avg(optimality) filter (where exact_cost is not null and told = 'success'), 6) as mean_optimality, round(quantile_cont(duration_ms::double, 0.95), 6) as p95_ms
  from r group by algorithm having count(*) filter (where told = 'error') = 0)
select * from s order by success_rate desc, mean_optimality desc, p95_ms, algorithm limit 3"""


def incomplete_cells(spark, sf_dir):
    """Cells that lack results when every customer's case is to be run by all four algorithms."""
    results = _results(spark, sf_dir)
    matrix = evalsuite.case_matrix(results.select("mode", "profile", "start_word").distinct(), results.select("algorithm").distinct(), spark.range(1).select(F.lit(0).alias("run")))
    return evalsuite.incomplete_cells(matrix, results)


SQL_CELLS = f"with {SQL_RESULTS} select mode, profile from results group by mode, profile having count(*) <> count(distinct o_custkey) * (select count(distinct algorithm) from results)"


def results_csv(spark, sf_dir):
    """Result rows by status and algorithm after writing and reading the CSV form."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/results"
    rows = _results(spark, sf_dir)
    blank = {"lemmatized": "boolean", "lexical_fields": "string", "available_pos": "string", "target_path": "array<string>", "start_links": "int", "target_links": "int", "error": "string"}
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    order = [x.strip().split(" ")[0] for x in io.RESULTS.split(",")]
    io.write_results_csv(rows.select(*order), path)
    back = io.read_results_csv(spark, path)
    return back.groupBy("algorithm", "status").agg(F.count("*").alias("n"), F.count("exact_cost").alias("exact"), F.sum(F.size("start_path")).cast("long").alias("words"))


SQL_CSV = f"with {SQL_RESULTS} select algorithm, status, count(*) as n, count(exact_cost) as exact, cast(2 * count(*) as bigint) as words from results group by algorithm, status"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions: label (-1: unreachable), cost, reachable_logit, batch."""
    return adapters.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 5 == 0, -1.0).otherwise((F.col("l_partkey") % 7).cast("double")).alias("label"),
        (F.col("l_suppkey") % 9).cast("double").alias("cost"), (F.col("l_orderkey") % 7 - 3).cast("double").alias("reachable_logit"), (F.col("l_orderkey") % 10).cast("int").alias("batch"),
    )


SQL_PREDS = "p as (select case when l_partkey % 5 = 0 then -1.0 else l_partkey % 7 end::double as label, (l_suppkey % 9)::double as cost, (l_orderkey % 7 - 3)::double as logit, cast(l_orderkey % 10 as integer) as batch from lineitem)"
_METRICS = """avg(abs(cost - label)) filter (where label >= 0) as mae, sqrt(avg((cost - label) * (cost - label)) filter (where label >= 0) - power(avg(cost - label) filter (where label >= 0), 2)) as residual_std,
  1 - sum((cost - label) * (cost - label)) filter (where label >= 0) / (sum(label * label) filter (where label >= 0) - count(*) filter (where label >= 0) * power(avg(label) filter (where label >= 0), 2)) as r2,
  count(*) filter (where label >= 0 and logit >= 0)::double / count(*) filter (where logit >= 0) as precision, count(*) filter (where label >= 0 and logit >= 0)::double / count(*) filter (where label >= 0) as recall,
  count(*) filter (where label < 0 and logit < 0)::double / count(*) filter (where label < 0) as specificity"""
_NAMES = ["mae", "residual_std", "r2", "precision", "recall", "specificity"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def evaluate_cost(spark, sf_dir):
    return _rounded(training.evaluate_cost(_predictions(spark, sf_dir)))


def evaluate_batches(spark, sf_dir):
    return _rounded(training.evaluate_cost_batched(_predictions(spark, sf_dir), "batch"))


SQL_EVAL = f"with {SQL_PREDS}, m as (select {_METRICS} from p) select {', '.join(f'round({n}, 6) as {n}' for n in _NAMES)} from m"
SQL_BATCHES = f"with {SQL_PREDS}, m as (select batch, {_METRICS} from p group by batch) select {', '.join(f'round(avg({n}), 6) as {n}' for n in _NAMES)} from m"


def cost_loss(spark, sf_dir):
    return _rounded(training.cost_loss(_predictions(spark, sf_dir)))


SQL_LOSS = f"""with {SQL_PREDS}, c as (select greatest(count(*) filter (where label < 0)::double / count(*) filter (where label >= 0), 1) as w from p),
t as (select avg(case when abs(cost - label) < 1 then 0.5 * power(cost - label, 2) else abs(cost - label) - 0.5 end) filter (where label >= 0) as a,
  avg(case when label >= 0 then w * ln(1 + exp(-logit)) else ln(1 + exp(logit)) end) as b from p, c)
select round(a, 6) as cost_loss, round(b, 6) as reach_loss, round(a + 0.5 * b, 6) as loss from t"""


def describe_labels(spark, sf_dir):
    return _rounded(training.describe_labels(_predictions(spark, sf_dir)))


_QUANTILES = ", ".join(f"round(quantile_cont(label, {q}), 6) as q{round(100 * q)}" for q in training.QUANTILES)
_DESCRIBE = f"count(*) as total, count(*) as finite, cast(0 as bigint) as non_finite, min(label) as min, max(label) as max, round(avg(label), 6) as mean, round(stddev_samp(label), 6) as std, {_QUANTILES}"
SQL_LABELS = f"""with {SQL_PREDS}, s as (select count(*) filter (where label = -1) as sentinels, round(count(*) filter (where label = -1)::double / count(*), 6) as sentinel_share from p)
select * from (select {_DESCRIBE}, 'all' as "rows" from p union all select {_DESCRIBE}, 'reachable' from p where label <> -1) d, s"""


def label_histogram(spark, sf_dir):
    return _rounded(training.label_histogram(_predictions(spark, sf_dir)))


SQL_HISTOGRAM = f"""with {SQL_PREDS}, e as (select min(label) as lo, (max(label) - min(label)) / 40 as w from p where label <> -1),
b as (select cast(least(floor((label - lo) / w), 39) as integer) as bin, lo, w from p, e where label <> -1)
select bin, round(min(lo) + bin * min(w), 6) as low, round(min(lo) + (bin + 1) * min(w), 6) as high, count(*) as n from b group by bin
union all select -1, -1.0, -1.0, count(*) from p where label = -1"""


def feature_health(spark, sf_dir):
    return training.describe_features(adapters.table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("features")))


def vector_spread(spark, sf_dir):
    return _rounded(embed.vector_variance(adapters.table(spark, sf_dir, "embeddings")))


def mean_vector(spark, sf_dir):
    return _rounded(embed.global_mean(adapters.table(spark, sf_dir, "embeddings"), None))


def similarities(spark, sf_dir):
    """Each vector's likeness to the first vector of its label."""
    vectors = adapters.table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("goal"))
    both = vectors.join(first, "label")
    return _rounded(both.select("vec_id", cosine_similarity(F.col("embedding"), F.col("goal")).alias("cosine"), neg_euclidean(F.col("embedding"), F.col("goal")).alias("euclid")))


_PAIRS = "g as (select label, arg_min(embedding, vec_id) as goal from embeddings group by label), f as (select vec_id, unnest(embedding)::double as a, unnest(goal)::double as b from embeddings join g on g.label = embeddings.label)"
SQL_SIMILAR = f"with {_PAIRS} select vec_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12), 6) as cosine, round(-sqrt(sum((a - b) * (a - b))), 6) as euclid from f group by vec_id"


def pair_features(spark, sf_dir):
    """Width and total of each vector's features against the first of its label."""
    vectors = adapters.table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("goal"))
    made = cost_features(F.col("embedding"), F.col("goal"), F.lit(1), F.lit(ALL_FIELDS), F.lit(ALL_POS))
    out = vectors.join(first, "label").select("vec_id", made.alias("f"))
    return out.select("vec_id", F.size("f").cast("long").alias("width"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


SQL_FEATURES = f"""with {_PAIRS} select vec_id, cast(4 * count(*) + 34 as bigint) as width,
  round(sum(a) + sum(b) + sum(b - a) + sum(a * b) + sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12) + sqrt(sum((a - b) * (a - b))) + sum(a * b) + 31, 4) as total from f group by vec_id"""


def learned_scores(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return rows.groupBy("cost", "reachable_logit").agg(F.count("*").alias("n")).select("cost", "reachable_logit", "n", F.round(learned_score(F.col("cost"), F.col("reachable_logit"), 3.0), 6).alias("score"))


SQL_LEARNED = f"with {SQL_PREDS} select cost, logit as reachable_logit, count(*) as n, round(greatest(cost, 0) + 3 / (1 + exp(logit)), 6) as score from p group by cost, logit"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, features: each vector against the first of its label, under a setting by its number."""
    vectors = adapters.table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("goal"))
    made = cost_features(F.col("embedding"), F.col("goal"), F.col("vec_id") % 2, F.col("vec_id") % 4093 + 1, F.col("vec_id") * 7 % 262139 + 1)
    return vectors.join(first, "label").select("vec_id", made.alias("features"))


def feature_places(spark, sf_dir):
    """Every place of every feature vector."""
    return _rounded(_features(spark, sf_dir).select("vec_id", F.posexplode("features").alias("place", "x")))


SQL_PLACES = f"""with g as (select label, arg_min(embedding, vec_id) as goal from embeddings group by label),
f as (select vec_id, unnest(embedding)::double as a, unnest(goal)::double as b, generate_subscripts(embedding, 1) - 1 as k, len(embedding) as d from embeddings join g on g.label = embeddings.label),
t as (select vec_id, d, sum(a * b) as dot, sqrt(sum(a * a)) as na, sqrt(sum(b * b)) as nb, sqrt(sum((a - b) * (a - b))) as apart from f group by vec_id, d),
x as (select vec_id, k as place, a as x from f union all select vec_id, d + k, b from f union all select vec_id, 2 * d + k, b - a from f union all select vec_id, 3 * d + k, a * b from f
  union all select vec_id, 4 * d, dot / (na * nb + 1e-12) from t union all select vec_id, 4 * d + 1, apart from t union all select vec_id, 4 * d + 2, dot from t union all select vec_id, 4 * d + 3, (vec_id % 2)::double from t
  union all select vec_id, 4 * d + 4 + k, ((vec_id % 4093 + 1) >> k & 1)::double from t, (select unnest(range(12)) as k) union all select vec_id, 4 * d + 16 + k, ((vec_id * 7 % 262139 + 1) >> k & 1)::double from t, (select unnest(range(18)) as k))"""


def vectors_text(spark, sf_dir):
    """Every number of the vectors' text form, after writing it and reading it back."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/vectors"
    vectors = adapters.table(spark, sf_dir, "embeddings")
    io.write_vectors_text(vectors.select(F.concat(F.lit('v"'), F.col("vec_id").cast("string")).alias("word"), "embedding"), path)
    back = spark.read.schema("word string, vector string").option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    numbers = F.split(F.regexp_replace("vector", r"[\[\]]", ""), ",").cast("array<float>")
    return _rounded(back.select("word", F.posexplode(numbers).alias("place", "x")).withColumn("x", F.col("x").cast("double")))


SQL_TEXT = """select 'v"' || vec_id as word, cast(k - 1 as integer) as place, round(x::double, 6) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as k from embeddings)"""


def training_rows(spark, sf_dir):
    """Labelled pairs by setting and distance: random settings, sampled sources and targets, one traversal a source."""
    _, nodes, edges = _graph(spark, sf_dir)
    settings = settle(training.sample_settings(spark, 3, 42), "settings")
    pairs = settle(training.sample_pairs(nodes.select(F.col("node_id").alias("vertex")), settings, 4, 256, 42), "pairs")
    rows = training.label_pairs(pairs, settings, edges)
    return training.split(rows, ["setting_id", "source", "target"], 42).groupBy("setting_id", "label", "part").agg(F.count("*").alias("n"))


#: Settings, sources and targets a setting, rows with a route and without one.
ROWS = {"settings": 3, "sources": 4, "targets": 256, "quota": 120, "share": 0.9}


def cost_rows(spark, sf_dir):
    """Every place of a quota of labelled feature rows: random settings, sources drawn from their anchors' neighbours, targets."""
    _, nodes, edges = _graph(spark, sf_dir)
    settings = settle(training.sample_settings(spark, ROWS["settings"], 42), "settings")
    pool = nodes.select(F.col("node_id").alias("vertex"))
    drawn = settle(training.sample_pairs(pool, settings, ROWS["sources"], ROWS["targets"], 42), "drawn")
    near = training.sample_neighbor_sources(drawn.select(F.col("source").alias("vertex")).distinct(), edges, pool, 42)
    pairs = drawn.join(near.select(F.col("anchor").alias("source"), F.col("source").alias("near")), "source").select("setting_id", F.col("near").alias("source"), "target").distinct()
    rows = settle(training.label_pairs(settle(pairs, "pairs"), settings, edges), "labelled")
    keys = ["setting_id", "source", "target"]
    chosen = settle(training.balance_reachable(rows, ROWS["quota"], ROWS["share"], 42, keys), "chosen")
    table = adapters.table(spark, sf_dir, "embeddings")
    vectors = nodes.withColumn("vec_id", F.col("node_id") % table.count()).join(table, "vec_id").select(F.col("node_id").alias("vertex"), "embedding")
    made = training.split(training.with_features(chosen, settings, vectors), keys, 42)
    return _rounded(made.select(*keys, "label", "part", F.posexplode("features").alias("place", "x")))


def _sql_cost_rows() -> str:
    d = training.draw_sql
    mask = lambda size, salt: f"(select coalesce(nullif(sum(case when {d(42, 'i', f'{salt} + k')} < 0.8 * {training.PRIME} then 1 << k else 0 end), 0), 1 << ({d(42, 'i', salt + 99)} % {size})::int) from (select unnest(range({size})) as k))"
    part = d(42, "setting_id", "source", "target")
    return f"""with recursive {SQL_GRAPH}, settings as (select i as setting_id, case when {d(42, 'i', 7)} < 0.5 * {training.PRIME} then 1 else 0 end as lem, {mask(12, 100)} as fm, {mask(18, 300)} as pm from (select unnest(range({ROWS['settings']})) as i)),
placed as (select setting_id, node_id, row_number() over (partition by setting_id order by {d(42, 'setting_id', 'node_id')}, node_id) as k from nodes, settings),
near as (select anchor, arg_min(target_id, struct_pack(h := {d(42, 'anchor', 'target_id')}, t := target_id)) as near from (select distinct source_id as anchor, target_id from edges) group by anchor),
drawn as (select distinct a.setting_id, coalesce(near, a.node_id) as source, b.node_id as target from placed a join placed b on a.setting_id = b.setting_id left join near on anchor = a.node_id where a.k <= {ROWS['sources']} and b.k > {ROWS['sources']} and b.k <= {ROWS['sources'] + ROWS['targets']}),
legal as (select distinct setting_id, source_id, target_id from edges join settings on lemmatized = lem and (fm::bigint >> edge_type::int) & 1 = 1 and (pm::bigint >> (list_position({adapters.SQL_TAGS}, target_pos) - 1)::int) & 1 = 1),
reach(setting_id, source, v, d) as (select distinct setting_id, source, source, 0 from drawn union select r.setting_id, r.source, target_id, d + 1 from reach r join legal l on l.setting_id = r.setting_id and l.source_id = v where d < 12),
dist as (select setting_id, source, v, min(d) as d from reach group by all),
lab as (select w.setting_id, w.source, w.target, coalesce(d, -1)::double as label from drawn w left join dist t on t.setting_id = w.setting_id and t.source = w.source and t.v = w.target),
q as (select *, row_number() over (partition by label >= 0 order by {part}, setting_id, source, target) as k from lab),
c as (select setting_id, source, target, label, {part} / {float(training.PRIME)}::double as u from q where k <= case when label >= 0 then {int(ROWS['quota'] * ROWS['share'])} else {ROWS['quota'] - int(ROWS['quota'] * ROWS['share'])} end),
z as (select c.*, lem, fm::bigint as fm, pm::bigint as pm, a.embedding as ea, b.embedding as eb from c join settings s on s.setting_id = c.setting_id join embeddings a on a.vec_id = source % (select count(*) from embeddings) join embeddings b on b.vec_id = target % (select count(*) from embeddings)),
f as (select setting_id, source, target, unnest(ea)::double as a, unnest(eb)::double as b, generate_subscripts(ea, 1) - 1 as k from z),
t as (select setting_id, source, target, count(*) as d, sum(a * b) as dot, sqrt(sum(a * a)) as na, sqrt(sum(b * b)) as nb, sqrt(sum((a - b) * (a - b))) as apart from f group by all),
x as (select f.setting_id, f.source, f.target, k as place, a as x from f union all select f.setting_id, f.source, f.target, d + k, b from f join t using (setting_id, source, target) union all select f.setting_id, f.source, f.target, 2 * d + k, b - a from f join t using (setting_id, source, target)
  union all select f.setting_id, f.source, f.target, 3 * d + k, a * b from f join t using (setting_id, source, target) union all select setting_id, source, target, 4 * d, dot / (na * nb + 1e-12) from t union all select setting_id, source, target, 4 * d + 1, apart from t
  union all select setting_id, source, target, 4 * d + 2, dot from t union all select setting_id, source, target, 4 * d + 3, lem::double from t join z using (setting_id, source, target)
  union all select setting_id, source, target, 4 * d + 4 + k, (fm >> k::int & 1)::double from t join z using (setting_id, source, target), (select unnest(range(12)) as k) union all select setting_id, source, target, 4 * d + 16 + k, (pm >> k::int & 1)::double from t join z using (setting_id, source, target), (select unnest(range(18)) as k))
select x.setting_id, x.source, x.target, label, cast(case when u < 0.8 then 0 when u < 0.9 then 1 else 2 end as integer) as part, cast(place as integer) as place, round(x, 6) as x from x join c using (setting_id, source, target)"""


def _network(rows: DataFrame) -> tuple[dict, dict]:
    """Fixed weights and feature groups of a table of features."""
    width = rows.select(F.size("features")).first()[0]
    return training.fixed_weights(width), training.feature_groups((width - 34) // 4)


def scored_features(spark, sf_dir):
    """Two-head model scores of every vector against the first of its label, with fixed weights."""
    rows = _features(spark, sf_dir)
    return _rounded(training.score_cost(rows, _network(rows)[0]))


def _sql_heads(inputs: str, keys: str) -> str:
    """The forward pass over a table (keys, place, x): two layers of sixteenths by place."""
    weight = "((({i} * 31 + {j} * 17 + {salt}) % 13 - 6) / 16.0)::double"
    layer = lambda salt: weight.format(i="place", j="j", salt=salt)
    bias = lambda salt: weight.format(i="0", j="j", salt=salt)
    hidden = f"h as (select {keys}, j as place, greatest(sum(x * {layer(1)}) + any_value({bias(2)}), 0) as x from {inputs}, (select unnest(range(4)) as j) group by {keys}, j)"
    heads = [f"{n}0 as (select {keys}, j as place, greatest(sum(x * {layer(3 + k)}) + any_value({bias(5 + k)}), 0) as x from h, (select unnest(range(3)) as j) group by {keys}, j)" for k, n in enumerate(("cost", "reach"))]
    ends = [f"{n} as (select {keys}, sum(x * {layer(7 + k)}) + any_value({bias(9 + k)}) as y from {n}0, (select 0 as j) group by {keys})" for k, n in enumerate(("cost", "reach"))]
    return ", ".join([hidden, *heads, *ends])


SQL_SCORED = f"{SQL_PLACES}, {_sql_heads('x', 'vec_id')} select cost.vec_id, round(cost.y, 6) as cost, round(reach.y, 6) as reachable_logit from cost join reach on reach.vec_id = cost.vec_id"


def ablation(spark, sf_dir):
    """Absolute output change a feature group and head over all vectors."""
    rows = _features(spark, sf_dir)
    return _rounded(training.ablate(rows, *_network(rows)))


def attributions(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return _rounded(training.group_scores(training.ablate(rows, *_network(rows))))


_SQL_GROUP = """case when place < d then 'current' when place < 2 * d then 'target' when place < 3 * d then 'difference' when place < 4 * d then 'product' when place = 4 * d then 'cosine' when place = 4 * d + 1 then 'distance'
  when place = 4 * d + 2 then 'dot' when place = 4 * d + 3 then 'mode' when place < 4 * d + 16 then 'fields' else 'tags' end"""
_SQL_CHANGES = f"""{SQL_PLACES}, g0 as (select x.vec_id, place, x, {_SQL_GROUP} as own from x join t on t.vec_id = x.vec_id), names as (select distinct own as group_name from g0 union all select 'none'),
z as (select vec_id, group_name, place, case when own = group_name then 0.0::double else x end as x from g0, names), {_sql_heads('z', 'vec_id, group_name')},
both_ as (select vec_id, group_name, 'cost' as head, y from cost union all select vec_id, group_name, 'reach', y from reach),
a as (select b.group_name, b.head, abs(b.y - w.y) as c from both_ b join both_ w on w.vec_id = b.vec_id and w.head = b.head and w.group_name = 'none' where b.group_name <> 'none')"""
SQL_ABLATION = f"with {_SQL_CHANGES.removeprefix('with ')} select group_name, head, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as std from a group by group_name, head"
SQL_ATTRIBUTIONS = f"""with {_SQL_CHANGES.removeprefix('with ')}, m as (select group_name, avg(c) filter (where head = 'cost') as cost, avg(c) filter (where head = 'reach') as reach from a group by group_name),
e as (select min(cost) as lc, max(cost) as hc, min(reach) as lr, max(reach) as hr from m)
select group_name, round(cost, 6) as cost, round(reach, 6) as reach, round((cost - lc) / (hc - lc) + (reach - lr) / (hr - lr), 6) as score from m, e"""


QUERIES = {
    "f3_race_stats": race_stats, "w7_race_lanes": race_lanes, "w2_step_times": step_times, "j7_games_with_players": games_with_players, "r1_live_race_state": live_race_state,
    "a7_summaries": summaries, "a15_success_by_cost": success_by_cost, "a16_head_to_head": head_to_head, "t1_finalists": finalists, "j11_incomplete_cells": incomplete_cells, "io6_results_csv": results_csv,
    "a12_evaluate_cost": evaluate_cost, "a13_evaluate_batches": evaluate_batches, "a14_cost_loss": cost_loss, "a9_describe_labels": describe_labels, "a11_label_histogram": label_histogram,
    "a10_feature_health": feature_health, "a18_vector_spread": vector_spread, "a6_mean_vector": mean_vector, "f7_similarities": similarities, "f9_pair_features": pair_features,
    "f18_learned_scores": learned_scores, "io9_vectors_text": vectors_text, "d3_training_rows": training_rows, "d6_scored_features": scored_features, "d7_ablation": ablation,
    "r2_validated_steps": validated_steps, "d3_cost_rows": cost_rows, "a19_attributions": attributions, "f9_feature_places": feature_places,
}
ORACLES = {
    "f3_race_stats": SQL_RACES, "w7_race_lanes": SQL_LANES, "w2_step_times": SQL_TIMES, "j7_games_with_players": SQL_JOINED, "r1_live_race_state": SQL_RACES,
    "a7_summaries": SQL_SUMMARY, "a15_success_by_cost": SQL_BY_COST, "a16_head_to_head": SQL_HEAD, "t1_finalists": SQL_FINAL, "j11_incomplete_cells": SQL_CELLS, "io6_results_csv": SQL_CSV,
    "a12_evaluate_cost": SQL_EVAL, "a13_evaluate_batches": SQL_BATCHES, "a14_cost_loss": SQL_LOSS, "a9_describe_labels": SQL_LABELS, "a11_label_histogram": SQL_HISTOGRAM,
    "a10_feature_health": "select count(*) as \"rows\", cast(max(len(embedding)) as integer) as width, cast(sum(len(embedding)) as bigint) as finite, cast(0 as bigint) as non_finite from embeddings",
    "a18_vector_spread": "select round(var_pop(x::double), 6) as variance from (select unnest(embedding) as x from embeddings)",
    "a6_mean_vector": "select cast(place - 1 as integer) as place, round(avg(x::double), 6) as mean from (select unnest(embedding) as x, generate_subscripts(embedding, 1) as place from embeddings) group by place",
    "f7_similarities": SQL_SIMILAR, "f9_pair_features": SQL_FEATURES, "f18_learned_scores": SQL_LEARNED, "io9_vectors_text": SQL_TEXT,
    "r2_validated_steps": SQL_JUDGED, "d3_cost_rows": _sql_cost_rows(), "d6_scored_features": SQL_SCORED, "d7_ablation": SQL_ABLATION, "a19_attributions": SQL_ATTRIBUTIONS, "f9_feature_places": f"{SQL_PLACES} select vec_id, cast(place as integer) as place, round(x, 6) as x from x",
}
