from shelfwise.operators import tenancy as ten


def test_deep_merge(spark):
    tenants = spark.createDataFrame([("t", "base"), ("plain", "base")], "tenant_id string, base string")
    defaults = spark.createDataFrame(
        [("base", p, v) for p, v in {"a.x": "1", "a.y": "2", "b": "3", "c.d.e": "4", "k": "5", "ab": "6"}.items()],
        "base string, key_path string, value string",
    )
    overrides = spark.createDataFrame(
        [("t", "a.y", "20"), ("t", "b.z", "30"), ("t", "c", "40"), ("t", "k", None), ("t", "new.leaf", "9")],
        "tenant_id string, key_path string, value string",
    )
    out = ten.layered_override_resolve(tenants, defaults, overrides)
    got = {(r["tenant_id"], r["key_path"]): r["value"] for r in out.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "t"} == {
        "a.x": "1", "a.y": "20", "b.z": "30", "c": "40", "k": None, "new.leaf": "9", "ab": "6",
    }
    assert len([k for k in got if k[0] == "plain"]) == 6 and out.count() == 13


def test_fallback_order(spark):
    rows = [
        ("t", "p1", "prompt", "t/p1", None, "g/p1"), ("t", "p2", "prompt", "t/p2", "o/p2", "g/p2"),
        ("t", "p3", "prompt", "t/p3", "o/p3", "g/p3"), ("t", "m1", "pattern", "t/m1", "o/m1", "g/m1"),
        ("t", "m2", "pattern", "t/m2", "o/m2", "g/m2"), ("t", "m3", "pattern", "t/m3", None, "g/m3"),
        ("t", "csv", "catalog", "t/csv", "o/csv", None), ("u", "csv", "catalog", "u/csv", None, None),
    ]
    wanted = spark.createDataFrame(rows, "tenant_id string, key string, kind string, tenant_path string, override_path string, global_path string")
    files = spark.createDataFrame([(p,) for p in ["t/p1", "t/p2", "o/p2", "t/p3", "t/m1", "o/m1", "o/m2", "t/csv", "u/csv"]], "path string")
    got = {(r["tenant_id"], r["key"]): (r["path"], r["error"]) for r in ten.asset_fallback_resolve(wanted, files).collect()}
    assert got == {
        ("t", "p1"): ("t/p1", None), ("t", "p2"): ("o/p2", None), ("t", "p3"): ("g/p3", None),
        ("t", "m1"): ("t/m1", None), ("t", "m2"): ("o/m2", None), ("t", "m3"): ("g/m3", None),
        ("t", "csv"): (None, "catalog not found"), ("u", "csv"): ("u/csv", None),
    }


def test_missing_files(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    held = [("a", "prompts", f) for f in ten.REQUIRED_PROMPTS[:-1]] + [("a", "patterns", "schema_map.yaml"), ("b", "", ten.CATALOG_FILE)]
    inventory = spark.createDataFrame(held, "tenant_id string, folder string, file string")
    got = sorted(tuple(r) for r in ten.missing_tenant_assets(tenants, inventory).collect())
    assert got == [
        ("a", "", "products_catalog.csv"), ("a", "patterns", "category_patterns.yaml"), ("a", "patterns", "price_patterns.yaml"),
        ("a", "prompts", "system_prompt.txt"), ("b", "prompts", ""),
    ]


def test_paths_and_inventories_are_not_held_whole(spark):
    """Small files unfold into many rows, so their size says nothing: no side that grows with the tenants is broadcast."""
    from shelfwise.plans import quality

    for query in (quality.asset_fallback_resolve, quality.missing_tenant_assets):
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Only paths that very many ask for are, one row per so many options at most.
        assert plan.count("BroadcastHashJoin") == ("hot-paths" in plan or "hot_exists" in plan)
        # Customers are dealt out before they are multiplied.
        assert "REPARTITION_BY_NUM" in plan


def test_shared_paths_are_settled_apart(spark):
    """The same files, whether a path that many tenants ask for is looked up apart or not."""
    from shelfwise.operators import tenancy

    wanted = spark.createDataFrame(
        [(f"u{i}", k, kind, f"u{i}/{k}", f"shared/{i % 2}/{k}" if i % 3 == 0 else None, None if kind == "catalog" else f"global/{k}")
         for i in range(12) for k, kind in (("a", "prompt"), ("b", "pattern"), ("c", "catalog"))],
        "tenant_id string, key string, kind string, tenant_path string, override_path string, global_path string",
    )
    paths = [f"u{i}/{k}" for i in range(0, 12, 2) for k in "abc"] + ["shared/0/a", "shared/1/b", "shared/1/c", "global/b"]
    files = spark.createDataFrame([(x,) for x in paths], "path string")
    rows = lambda hot: sorted(map(repr, tenancy.asset_fallback_resolve(wanted, files, hot).collect()))
    assert rows(3) == rows(0) == rows(1000)
    assert len(rows(3)) == 36
