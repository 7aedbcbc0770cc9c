"""Training sets for route-cost models: settings, pairs, labels, features, quota, split, descriptions, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import LEXICAL_KEYS, POS_TAGS
from ..functions.scalars import cost_features
from ..sources.shared import settle
from .graph import bfs
from .ranks import quantiles

UNREACHABLE = -1.0
QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


#: Seeded draws are numbers below this prime, by arithmetic that any SQL engine has.
PRIME, STEP, SCRAMBLE = (1 << 31) - 1, 48271, 1103515245


def draw(seed: int, *parts: Column | str | int) -> Column:
    """A long in [0, PRIME) that depends on the seed and its whole-number parts alone."""
    h: Column | int = F.lit(seed % PRIME).cast("long")
    for part in parts:
        value = F.lit(part) if isinstance(part, int) else F.col(part) if isinstance(part, str) else part
        x = (h * STEP + F.pmod(value.cast("long"), F.lit(PRIME))) % PRIME
        h = (x.bitwiseXOR(F.shiftright(x, 15)) * SCRAMBLE) % PRIME
    return h


def draw_sql(seed: int, *parts: str | int) -> str:
    """``draw`` as SQL text."""
    h = str(seed % PRIME)
    for part in parts:
        x = f"(({h})::bigint * {STEP} + ({part})::bigint % {PRIME}) % {PRIME}"
        h = f"xor({x}, ({x}) >> 15) * {SCRAMBLE} % {PRIME}"
    return f"({h})"


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on its whole-number parts alone; the last one is the seed."""
    *rest, seed = parts
    return draw(seed, *rest) / float(PRIME)


def sample_settings(spark: SparkSession, n: int, seed: int, share: float = 0.8) -> DataFrame:
    """setting_id, lemmatized, field_mask, pos_mask: each bit on with probability share, at least one of each kind."""
    base = spark.range(n).withColumnRenamed("id", "setting_id")

    def mask(size: int, salt: int) -> Column:
        on = [F.when(unit_hash("setting_id", salt + k, seed) < share, F.lit(1 << k)).otherwise(0) for k in range(size)]
        total = on[0]
        for x in on[1:]:
            total = total + x
        forced = F.call_function("shiftleft", F.lit(1), (draw(seed, "setting_id", salt + 99) % size).cast("int"))
        return F.when(total == 0, forced).otherwise(total).cast("int")

    return base.select(
        "setting_id", (unit_hash("setting_id", 7, seed) < 0.5).cast("int").alias("lemmatized"),
        mask(len(LEXICAL_KEYS), 100).alias("field_mask"), mask(len(POS_TAGS), 300).alias("pos_mask"),
    )


def sample_pairs(pool: DataFrame, settings: DataFrame, sources: int, targets: int, seed: int) -> DataFrame:
    """setting_id, source, target: disjoint samples without replacement for each setting, all their pairs.

    A setting draws the vertices of least hash; all but about as many as it needs are left out before they are ranked.
    """
    wanted, size = sources + targets, pool.count()
    share = (wanted + 8 * wanted**0.5 + 32) / max(size, 1)
    # As many ids as settings were asked for.
    ids = settings.agg(F.collect_list("setting_id").alias("ids"))
    while True:
        near = F.filter("ids", lambda s: draw(seed, s, "vertex") <= F.lit(int(min(share, 1) * PRIME)))
        drawn = pool.select("vertex").join(F.broadcast(ids)).select("vertex", F.explode(near).alias("setting_id"))
        drawn = settle(drawn, "drawn")
        least = drawn.groupBy("setting_id").count().agg(F.min("count"), F.count("*")).first()
        if share >= 1 or ((least[0] or 0) >= min(wanted, size) and least[1] == settings.count()):
            break
        share *= 2
    place = F.row_number().over(Window.partitionBy("setting_id").orderBy(draw(seed, "setting_id", "vertex"), "vertex"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= wanted)
    left = drawn.where(F.col("place") <= sources).select("setting_id", F.col("vertex").alias("source"))
    return left.join(drawn.where(F.col("place") > sources).select("setting_id", F.col("vertex").alias("target")), "setting_id")


def sample_neighbor_sources(anchors: DataFrame, edges: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """anchor, source: one random out-neighbour that is in the pool, or the anchor itself."""
    near = anchors.join(edges, anchors["vertex"] == edges["source_id"]).select(F.col("vertex").alias("anchor"), F.col("target_id").alias("source"))
    near = near.distinct().join(pool.select(F.col("vertex").alias("source")), "source", "left_semi")
    pick = near.groupBy("anchor").agg(F.min(F.struct(draw(seed, "anchor", "source").alias("h"), "source")).alias("m"))
    return anchors.select(F.col("vertex").alias("anchor")).join(pick, "anchor", "left").select("anchor", F.coalesce("m.source", "anchor").alias("source"))


def label_pairs(pairs: DataFrame, settings: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with label: links under the setting, UNREACHABLE without a route. One traversal a (setting, source)."""
    roots = pairs.select("setting_id", "source").distinct().join(settings, "setting_id")
    roots = roots.select(F.xxhash64("setting_id", "source").alias("query_id"), F.col("source").alias("vertex"), "lemmatized", "field_mask", "pos_mask")
    asked = pairs.withColumn("query_id", F.xxhash64("setting_id", "source"))
    goals = asked.select("query_id", F.col("target").alias("vertex"))
    found = bfs(roots, edges, goals=goals, only_goals=True).select("query_id", F.col("vertex").alias("target"), "dist")
    return asked.join(found, ["query_id", "target"], "left").select("setting_id", "source", "target", F.coalesce(F.col("dist").cast("double"), F.lit(UNREACHABLE)).alias("label"))


def with_features(rows: DataFrame, settings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labelled rows whose ends have vectors, with features, made last and from narrow rows."""
    a = vectors.select(F.col("vertex").alias("source"), F.col("embedding").alias("current"))
    b = vectors.select(F.col("vertex").alias("target"), F.col("embedding").alias("goal"))
    joined = rows.join(settings, "setting_id").join(a, "source").join(b, "target")
    features = cost_features(F.col("current"), F.col("goal"), F.col("lemmatized"), F.col("field_mask"), F.col("pos_mask"))
    return joined.select("setting_id", "source", "target", features.alias("features"), "label")


def build_cost_dataset(pool: DataFrame, edges: DataFrame, vectors: DataFrame, settings: DataFrame, sources: int, targets: int, seed: int) -> DataFrame:
    pairs = sample_pairs(pool, settings, sources, targets, seed)
    return with_features(label_pairs(pairs, settings, edges), settings, vectors)


def take_exact(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly n rows of least draw by whole-number keys, which name a row; nothing is sorted but the last few rows.

    Two rounds of counts (4,096 numbers each) find the draw up to which all rows belong to the sample.
    """
    h, low, width, left = draw(seed, *keys), 0, 1 << 19, n
    while width >= 1 << 7:
        bucket = F.floor((h - low) / width).cast("int")
        counts = dict(df.where(h >= low).where(h < low + 4096 * width).groupBy(bucket.alias("b")).count().collect())
        for b in range(4096):
            if counts.get(b, 0) >= left:
                break
            left -= counts.get(b, 0)
        else:
            raise ValueError(f"fewer than {n} rows")
        low, width = low + b * width, width >> 12
    return df.where(h < low).unionByName(df.where((h >= low) & (h < low + (1 << 7))).orderBy(h, *keys).limit(left))


def balance_reachable(df: DataFrame, n: int, share: float, seed: int, keys: list[str]) -> DataFrame:
    """floor(n x share) reachable rows and the rest unreachable, each class by a seeded hash."""
    wanted = int(n * share)
    good, bad = df.where(F.col("label") >= 0), df.where(F.col("label") < 0)
    return take_exact(good, wanted, seed, keys).unionByName(take_exact(bad, n - wanted, seed, keys))


def split(df: DataFrame, keys: list[str], seed: int, weights: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """df with part (0, 1, ...): disjoint, exhaustive and the same for a row wherever it is."""
    part, edge = F.lit(len(weights) - 1), sum(weights)
    for k in range(len(weights) - 2, -1, -1):
        edge -= weights[k + 1]
        part = F.when(unit_hash(*keys, seed) * sum(weights) < edge, k).otherwise(part)
    return df.withColumn("part", part)


def concat_datasets(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """One row: totals, range, mean, sample deviation (0 for one value) and quantiles of the finite values."""
    x = F.col(column).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = F.when(finite, x)
    row = df.agg(
        F.count("*").alias("total"), F.count(kept).alias("finite"), F.min(kept).alias("min"), F.max(kept).alias("max"), F.avg(kept).alias("mean"),
        F.when(F.count(kept) == 1, 0.0).otherwise(F.stddev_samp(kept)).alias("std"),
    )
    # A row each.
    row = row.join(quantiles(df.select(kept.alias("x")), [], "x", list(QUANTILES)), how="left")
    names = [f"q{round(100 * p)}" for p in QUANTILES]
    return row.select("total", "finite", (F.col("total") - F.col("finite")).alias("non_finite"), "min", "max", "mean", "std", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def describe_labels(df: DataFrame, sentinel: float = UNREACHABLE, column: str = "label") -> DataFrame:
    """Two rows (all, reachable) of describe_numeric with the sentinel's count and share."""
    mark = df.agg(F.count_if(F.col(column) == sentinel).alias("sentinels"), (F.count_if(F.col(column) == sentinel) / F.nullif(F.count("*"), F.lit(0))).alias("sentinel_share"))
    both = describe_numeric(df, column).withColumn("rows", F.lit("all")).unionByName(describe_numeric(df.where(F.col(column) != sentinel), column).withColumn("rows", F.lit("reachable")))
    return both.join(F.broadcast(mark))


def describe_features(df: DataFrame) -> DataFrame:
    finite = F.size(F.filter("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return df.agg(
        F.count("*").alias("rows"), F.max(F.size("features")).alias("width"), F.sum(finite).cast("long").alias("finite"), F.sum(F.size("features") - finite).cast("long").alias("non_finite")
    )


def label_histogram(df: DataFrame, bins: int = 40, sentinel: float = UNREACHABLE, column: str = "label") -> DataFrame:
    """bin (-1: the sentinel), low, high, n: equal bins over the other labels, the last one closed."""
    rest = df.where(F.col(column) != sentinel)
    ends = rest.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    placed = rest.join(F.broadcast(ends)).select("lo", width.alias("w"), F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg((F.min("lo") + F.col("bin") * F.min("w")).alias("low"), (F.min("lo") + (F.col("bin") + 1) * F.min("w")).alias("high"), F.count("*").alias("n"))
    marked = df.where(F.col(column) == sentinel).agg(F.lit(-1).alias("bin"), F.lit(sentinel).alias("low"), F.lit(sentinel).alias("high"), F.count("*").alias("n"))
    return counts.unionByName(marked)


def _evaluation(label: Column, cost: Column, logit: Column) -> list[Column]:
    reach, said = label >= 0, logit >= 0
    error, n = F.when(reach, cost - label), F.greatest(F.count_if(reach), F.lit(1))

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0.0))

    bias = total(error) / n
    mean = total(F.when(reach, label)) / n
    residual = total(error * error)
    around = total(F.when(reach, label * label)) - n * mean * mean
    hit = F.count_if(reach & said)
    return [
        (total(F.abs(error)) / n).alias("mae"),
        F.sqrt(F.greatest(residual / n - bias * bias, F.lit(0.0))).alias("residual_std"),
        (1 - residual / F.greatest(around, F.lit(1e-6))).alias("r2"),
        (hit / F.greatest(F.count_if(said), F.lit(1))).alias("precision"),
        (hit / n).alias("recall"),
        (F.count_if(~reach & ~said) / F.greatest(F.count_if(~reach), F.lit(1))).alias("specificity"),
    ]


def evaluate_cost(preds: DataFrame) -> DataFrame:
    """One row of metrics over label, cost, reachable_logit."""
    return preds.agg(*_evaluation(F.col("label").cast("double"), F.col("cost").cast("double"), F.col("reachable_logit").cast("double")))


def evaluate_cost_batched(preds: DataFrame, batch: str) -> DataFrame:
    """The plain mean over batches of each batch's metrics."""
    names = ["mae", "residual_std", "r2", "precision", "recall", "specificity"]
    each = preds.groupBy(batch).agg(*_evaluation(F.col("label").cast("double"), F.col("cost").cast("double"), F.col("reachable_logit").cast("double")))
    return each.agg(*[F.avg(n).alias(n) for n in names])


def cost_loss(preds: DataFrame, weight: float = 0.5, balance: bool = True) -> DataFrame:
    """cost_loss, reach_loss and their weighted sum; rare reachable rows weigh more if balance."""
    reach = F.col("label") >= 0
    counts = preds.agg(F.count_if(reach).alias("good"), F.count_if(~reach).alias("bad"))
    positive = F.greatest(F.col("bad") / F.greatest("good", F.lit(1)), F.lit(1.0)) if balance else F.lit(1.0)
    apart = F.abs(F.col("cost") - F.col("label"))
    smooth = F.when(apart < 1, 0.5 * apart * apart).otherwise(apart - 0.5)
    x = F.col("reachable_logit").cast("double")
    log_yes = F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    entropy = F.when(reach, -positive * log_yes).otherwise(-(log_yes - x))
    rows = preds.join(F.broadcast(counts))
    out = rows.agg((F.coalesce(F.sum(F.when(reach, smooth)), F.lit(0.0)) / F.greatest(F.count_if(reach), F.lit(1))).alias("cost_loss"), F.avg(entropy).alias("reach_loss"))
    return out.withColumn("loss", F.col("cost_loss") + weight * F.col("reach_loss"))


def layer_widths(width: int) -> tuple[list[int], int]:
    """Trunk widths, halving down to 256 at most, and the heads' width."""
    out = [width]
    while out[-1] > 256:
        out.append(out[-1] // 2)
    if len(out) == 1:
        out.append(max(1, width // 2))
    return out, min(64, out[-1])


def init_weights(width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    trunk, head = layer_widths(width)
    out = {}
    for k, (a, b) in enumerate(zip(trunk, trunk[1:])):
        out[f"w{k}"], out[f"b{k}"] = rng.normal(0, a**-0.5, (a, b)).astype(np.float32), np.zeros(b, np.float32)
    for name in ("cost", "reach"):
        out[f"{name}_w0"], out[f"{name}_b0"] = rng.normal(0, trunk[-1] ** -0.5, (trunk[-1], head)).astype(np.float32), np.zeros(head, np.float32)
        out[f"{name}_w1"], out[f"{name}_b1"] = rng.normal(0, head**-0.5, (head, 1)).astype(np.float32), np.zeros(1, np.float32)
    return out


def fixed_weights(width: int, hidden: int = 4, head: int = 3) -> dict[str, np.ndarray]:
    """Weights by a rule of thumb, for checks: sixteenths from -6/16 to 6/16 by place, one trunk layer."""
    def made(rows: int, columns: int, salt: int) -> np.ndarray:
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        return (((i * 31 + j * 17 + salt) % 13 - 6) / 16).astype(np.float32)

    out = {"w0": made(width, hidden, 1), "b0": made(1, hidden, 2)[0]}
    for k, name in enumerate(("cost", "reach")):
        out |= {f"{name}_w0": made(hidden, head, 3 + k), f"{name}_b0": made(1, head, 5 + k)[0], f"{name}_w1": made(head, 1, 7 + k), f"{name}_b1": made(1, 1, 9 + k)[0]}
    return out


def feature_groups(dimension: int) -> dict[str, list[int]]:
    """The ten groups of ``cost_features`` and their places."""
    d, sizes = dimension, {"cosine": 1, "distance": 1, "dot": 1, "mode": 1, "fields": len(LEXICAL_KEYS), "tags": len(POS_TAGS)}
    sizes = {"current": d, "target": d, "difference": d, "product": d} | sizes
    ends = np.cumsum(list(sizes.values())).tolist()
    return {name: list(range(end - sizes[name], end)) for name, end in zip(sizes, ends)}


def forward(x: np.ndarray, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """cost and reachable_logit of a batch of feature rows."""
    k = 0
    while f"w{k}" in weights:
        x = np.maximum(x @ weights[f"w{k}"] + weights[f"b{k}"], 0)
        k += 1
    heads = [np.maximum(x @ weights[f"{n}_w0"] + weights[f"{n}_b0"], 0) @ weights[f"{n}_w1"] + weights[f"{n}_b1"] for n in ("cost", "reach")]
    return heads[0][:, 0], heads[1][:, 0]


def score_cost(df: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """df without features, with cost and reachable_logit: matrix products over Arrow batches, weights broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(features: pd.Series) -> pd.DataFrame:
        if not len(features):
            return pd.DataFrame({"cost": np.zeros(0), "reachable_logit": np.zeros(0)})
        cost, logit = forward(np.stack(features.to_numpy()), shared.value)
        return pd.DataFrame({"cost": cost.astype(float), "reachable_logit": logit.astype(float)})

    scored = df.withColumn("p", F.pandas_udf(run, "cost double, reachable_logit double")("features"))
    return scored.select(*[c for c in df.columns if c != "features"], "p.cost", "p.reachable_logit")


def ablate(df: DataFrame, weights: dict[str, np.ndarray], groups: dict[str, list[int]]) -> DataFrame:
    """group_name, head, mean, std: absolute output change when a feature group is zero, over all rows."""
    shared = df.sparkSession.sparkContext.broadcast((weights, groups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, parts = shared.value
        for batch in batches:
            x = np.stack(batch["features"].to_numpy())
            whole = forward(x, own)
            for name, columns in parts.items():
                part = x.copy()
                part[:, columns] = 0
                for head, before, after in zip(("cost", "reach"), whole, forward(part, own)):
                    d = np.abs(before - after).astype(float)
                    yield pd.DataFrame({"group_name": [name], "head": [head], "n": [len(d)], "s": [d.sum()], "q": [(d * d).sum()]})

    sums = df.select("features").mapInPandas(run, "group_name string, head string, n long, s double, q double")
    total = sums.groupBy("group_name", "head").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select("group_name", "head", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def group_scores(ablated: DataFrame) -> DataFrame:
    """group_name, cost, reach (mean change a head) and score: both heads' means, each scaled by its own range over the groups, summed.

    All features of a group change together, so a head's range over features is its range over groups. The table has a row a
    group and head.
    """
    heads = ablated.groupBy("group_name").agg(*[F.max(F.when(F.col("head") == h, F.col("mean"))).alias(h) for h in ("cost", "reach")])
    ends = heads.agg(*[f(h).alias(f"{n}_{h}") for h in ("cost", "reach") for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(head: str) -> Column:
        return F.coalesce((F.col(head) - F.col(f"lo_{head}")) / F.nullif(F.col(f"hi_{head}") - F.col(f"lo_{head}"), F.lit(0.0)), F.lit(0.0))

    return heads.join(F.broadcast(ends)).select("group_name", "cost", "reach", (scaled("cost") + scaled("reach")).alias("score"))


def attribution_summary(attributions: DataFrame, groups: DataFrame) -> DataFrame:
    """group_name, score: mean absolute attribution a feature and head, scaled to 0..1, summed over heads, averaged.

    attributions: head, values (one a feature); groups: place, group_name.
    """
    each = attributions.select("head", F.posexplode("values").alias("place", "v")).groupBy("head", "place").agg(F.avg(F.abs("v")).alias("m"))
    ends = each.groupBy("head").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    scaled = each.join(F.broadcast(ends), "head").select("place", F.coalesce((F.col("m") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("x"))
    summed = scaled.groupBy("place").agg(F.sum("x").alias("x"))
    return summed.join(F.broadcast(groups), "place").groupBy("group_name").agg(F.avg("x").alias("score"))

