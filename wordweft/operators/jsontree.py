"""Tokens out of JSON of unknown shape and depth, as variants, a level of the tree a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

TOKEN = ("w", "l", "p")


def find_tokens(documents: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """The other columns of documents with lexical_key, p, w, l: every object with members w, l and p (p not null) at any depth
    at or below a key of ``keys``, each once for a row and a key.

    A round opens one level of all documents at once and goes on with the objects and arrays that it found; how deep the trees
    are needn't be known. Null JSON holds nothing, malformed JSON fails the job.
    """
    own = [c for c in documents.columns if c != column]
    spark, found = documents.sparkSession, []
    level = settle(documents.where(F.col(column).isNotNull()).select(*own, F.array().cast("array<string>").alias("above"), F.parse_json(column).alias("v")), "json")
    while not level.isEmpty():
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*own, "above", "key", "value")
        wanted = F.when(F.col("key").isin(keys) & ~F.array_contains("above", F.col("key")), F.array("key")).otherwise(F.array())
        kind = F.schema_of_variant("value")
        nested = opened.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        level = settle(nested.select(*own, F.concat("above", wanted.cast("array<string>")).alias("above"), F.col("value").alias("v")), "json")
        # Only an object has members, null ones too.
        members = [F.variant_get("v", f"$.{m}", "variant").isNotNull() for m in TOKEN]
        held = level.where((F.size("above") > 0) & reduce(lambda a, b: a & b, members))
        values = [F.try_variant_get("v", f"$.{m}", "string").alias(m) for m in ("p", "w", "l")]
        found.append(held.select(*own, F.explode("above").alias("lexical_key"), *values).where("p is not null"))
    if not found:
        return level.select(*own, F.lit(None).cast("string").alias("lexical_key"), *[F.lit(None).cast("string").alias(m) for m in ("p", "w", "l")])
    return reduce(DataFrame.unionByName, found).distinct()
