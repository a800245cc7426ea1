"""Model registry and layered model settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_ENTRY = (
    "struct<model_file:string,needs_cuda:boolean,plot:boolean,"
    "params_filepath:string,args:map<string,string>>"
)

# Settings every model starts from.
DEFAULT_SETTINGS = {
    "overwrite": "true",
    "accelerator": "cpu",
    "num_workers": "8",
    "compile": "false",
    "batch_to_predict": "8",
}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per model in a registry file ``{"models": {name: {...}}}``."""
    schema = f"models map<string,{REGISTRY_ENTRY}>"
    return registry_rows(spark.read.schema(schema).option("multiLine", True).json(path), "models")


def registry_rows(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(col).alias("model", "_e")).select("model", "_e.*")


def layered(*layers: Column) -> Column:
    """Merge setting maps; a later layer wins. NULL layers are empty."""
    empty = F.create_map().cast("map<string,string>")
    pairs = [F.map_entries(F.coalesce(m, empty)) for m in layers]
    out = pairs[0]
    for later in pairs[1:]:
        out = F.concat(_without_keys(out, F.transform(later, lambda e: e["key"])), later)
    return F.map_from_entries(out)


def _without_keys(entries: Column, keys: Column) -> Column:
    return F.filter(entries, lambda e: ~F.array_contains(keys, e["key"]))


def model_settings(registry: DataFrame, dataset: dict[str, str], params: DataFrame) -> DataFrame:
    """Settings per model: the registry's own, or the defaults, then dataset and model.

    A model with its own ``args`` starts from those instead of the defaults.
    """
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    base = F.coalesce(F.col("args"), as_map(DEFAULT_SETTINGS))
    joined = registry.join(params, "model", "left")
    return joined.select("model", layered(base, as_map(dataset), F.col("params")).alias("settings"))
