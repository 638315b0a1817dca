"""Tenant configuration: required files, layered profiles, asset fallback.

Files are rows of an inventory ``(tenant_id, folder, file)`` with folder '' for the tenant's own
directory; profiles are leaf paths ``(tenant_id, key_path, value)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CATALOG_FILE, REQUIRED_PATTERNS, REQUIRED_PROMPTS
from ..session import materialized

PROFILE_KEYS = ["id", "name", "locale"]
# A path that more options name is looked up apart.
HOT_PATH = 10_000


def missing_tenant_assets(
    tenants: DataFrame, inventory: DataFrame, profile_keys: DataFrame | None = None
) -> DataFrame:
    """Files each tenant should have and has not: ``(tenant_id, folder, file)``.

    A missing prompts folder counts once, without its files. Pattern files are optional, but a
    patterns folder must be complete. Recommended profile keys are reported as folder 'profile'.
    """
    item = lambda folder, file: F.struct(F.lit(folder).alias("folder"), F.lit(file).alias("file"))
    folders = inventory.select("tenant_id", "folder").distinct()
    has = folders.groupBy("tenant_id").agg(
        F.bool_or(F.col("folder") == "prompts").alias("has_prompts"),
        F.bool_or(F.col("folder") == "patterns").alias("has_patterns"),
    )
    state = tenants.select("tenant_id").join(has.hint("merge"), "tenant_id", "left")
    none = F.array().cast("array<struct<folder:string,file:string>>")
    prompts = F.when(
        F.col("has_prompts"), F.array(*[item("prompts", f) for f in REQUIRED_PROMPTS])
    ).otherwise(F.array(item("prompts", "")))
    patterns = F.when(
        F.col("has_patterns"), F.array(*[item("patterns", f) for f in REQUIRED_PATTERNS])
    ).otherwise(none)
    required = state.select(
        "tenant_id",
        F.explode(F.concat(F.array(item("", CATALOG_FILE)), prompts, patterns)).alias("item"),
    ).select("tenant_id", "item.*")
    # Both sides grow with the tenants, however small their files are: no side is held whole.
    missing = required.join(inventory.hint("merge"), ["tenant_id", "folder", "file"], "left_anti")
    if profile_keys is None:
        return missing
    keys = tenants.select(
        "tenant_id",
        F.lit("profile").alias("folder"),
        F.explode(F.array(*map(F.lit, PROFILE_KEYS))).alias("file"),
    )
    held = profile_keys.select("tenant_id", F.col("key").alias("file"))
    return missing.unionByName(keys.join(held.hint("merge"), ["tenant_id", "file"], "left_anti"))


def _prefixes(path: Column, proper: bool) -> Column:
    """The dotted prefixes of a path, with or without the path itself."""
    parts = F.split(path, r"\.")
    last = F.size(parts) - (1 if proper else 0)
    prefix = lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), prefix)).otherwise(
        F.array().cast("array<string>")
    )


def layered_override_resolve(
    tenants: DataFrame, defaults: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Deep merge of each tenant's overrides into the defaults it extends.

    ``tenants``: tenant_id, base. ``defaults``: base, key_path, value. ``overrides``: tenant_id,
    key_path, value. An override leaf replaces the default leaf at its path, the whole subtree
    below it, or a scalar above it.
    """
    inherited = tenants.join(defaults, "base").select("tenant_id", "key_path", "value")
    # A default falls when it, or anything above it, is overridden ...
    above = inherited.withColumn("hit", F.explode(_prefixes(F.col("key_path"), proper=False)))
    at = overrides.select("tenant_id", F.col("key_path").alias("hit"))
    by_above = above.join(at.hint("merge"), ["tenant_id", "hit"], "left_semi").select("tenant_id", "key_path")
    # ... or when an override lies below it.
    by_below = overrides.select(
        "tenant_id", F.explode(_prefixes(F.col("key_path"), proper=True)).alias("key_path")
    )
    fallen = by_above.unionByName(by_below).distinct()
    kept = inherited.join(fallen.hint("merge"), ["tenant_id", "key_path"], "left_anti")
    return kept.withColumn("layer", F.lit("base")).unionByName(
        overrides.select("tenant_id", "key_path", "value").withColumn("layer", F.lit("override"))
    )


def tenant_settings(tenants: DataFrame, leaves: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    """One row per tenant with a column per setting: ``settings`` names the key path of each column.

    ``leaves`` are the rows of ``layered_override_resolve``. A setting nobody gives is null.
    """
    value = lambda path: F.first(F.when(F.col("key_path") == path, F.col("value")), ignorenulls=True)
    asked = leaves.where(F.col("key_path").isin(*settings.values()))
    wide = asked.groupBy("tenant_id").agg(*[value(path).alias(name) for name, path in settings.items()])
    return tenants.select("tenant_id").distinct().join(wide, "tenant_id", "left")


def asset_fallback_resolve(wanted: DataFrame, files: DataFrame, hot: int = HOT_PATH) -> DataFrame:
    """The file each asset is read from.

    ``wanted``: tenant_id, key, kind ('prompt', 'pattern' or 'catalog'), tenant_path, override_path
    (nullable) and global_path (null for catalogs). ``files``: path. The tenant's own pattern file
    beats a profile override; for prompts and catalogs the override replaces the tenant's path. The
    last resort is taken unseen, except that a catalog must exist.
    """
    chosen = F.coalesce("override_path", "tenant_path")
    pattern = F.col("kind") == "pattern"
    options = F.when(
        pattern,
        F.array(F.col("tenant_path"), F.coalesce("override_path", "global_path"), F.col("global_path")),
    ).otherwise(F.array(chosen, F.col("global_path")))
    options = wanted.select("tenant_id", "key", "kind", F.posexplode(options).alias("priority", "path"))
    options = options.where("path IS NOT NULL")
    # Paths grow with the tenants, however small their files are: they are not held whole.
    known = files.select("path").distinct().withColumn("exists", F.lit(True)).hint("merge")
    # Shared paths that many tenants ask for are looked up once each: one row per so many options at most.
    asked = options.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("path")
    found = asked.join(known, "path", "left").select("path", F.col("exists").isNotNull().alias("hot_exists"))
    seen = options.join(F.broadcast(materialized(found, "hot-paths")), "path", "left")
    # A path that is settled asks for nothing, spread by tenant.
    sought = F.when(F.col("hot_exists").isNull(), F.col("path")).otherwise(F.concat(F.lit("\0"), "tenant_id"))
    seen = seen.withColumn("sought", sought).join(known.withColumnRenamed("path", "sought"), "sought", "left")
    usable = F.coalesce("hot_exists", F.col("exists").isNotNull())
    best = F.min_by("path", F.when(usable, F.col("priority")))
    last = F.max_by("path", "priority")
    return (
        seen.groupBy("tenant_id", "key", "kind")
        .agg(best.alias("best"), last.alias("last"), F.bool_or(usable).alias("exists"))
        .select(
            "tenant_id",
            "key",
            F.coalesce("best", F.when(F.col("kind") != "catalog", F.col("last"))).alias("path"),
            F.when(~F.col("exists") & (F.col("kind") == "catalog"), "catalog not found").alias("error"),
        )
    )
