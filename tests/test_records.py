"""CSV records cut by many tasks against Spark's own multi-line reader."""

import itertools
import random

import pytest

from shelfwise.sources import catalog as src
from shelfwise.sources.records import BETWEEN, INSIDE, Cutter, Transition, read_records, state_after

TEXT = (
    'Product,Price (€),Features\n"A ""big"" one",49.90,"- first\n- second, ""third""\n\n- last"\nplain,1,x\n\n'
    '5" pipe,2,"é"\r\n"",,""""\n"\n",3,"a,b"\n"""start","4","end"""\nlast,"",z'
)


def whole(text):
    cutter = Cutter(BETWEEN, 0)
    out = [r for line in text.split("\n") for r in cutter.read(line)]
    return [(n, t) for n, t, _ in [*out, *cutter.close()]]


def in_ranges(ranges):
    """As the job does: transitions of all ranges, starts by composition, cutting, pieces put together."""
    state, number, pieces, out = BETWEEN, 0, {}, []
    for lines in ranges:
        transition, cutter = Transition(), Cutter(state, number)
        found = []
        for line in lines:
            transition.read(line)
            found += cutter.read(line)
        for n, text, complete in [*found, *cutter.close()]:
            if complete:
                out.append((n, text))
            else:
                pieces.setdefault(n, []).append(text)
        number += transition.records[state]
        state = transition.ends[state]
    return sorted(out + [(n, "\n".join(p)) for n, p in pieces.items()])


def test_states():
    assert [state_after(x, BETWEEN) for x in ("a,b", '"a', 'a,"b', '"a",b', '5" pipe', 'a"b,"c', '"a""', '"a"""', '"",""')] == [
        BETWEEN, INSIDE, INSIDE, BETWEEN, BETWEEN, INSIDE, INSIDE, BETWEEN, BETWEEN]
    assert [state_after(x, INSIDE) for x in ("a,b", 'a"', 'a"",b', 'a",b', 'a","b', '"', '""', '"""', 'a"x,"y"')] == [
        INSIDE, BETWEEN, INSIDE, BETWEEN, INSIDE, BETWEEN, INSIDE, BETWEEN, BETWEEN]


def test_cut_at_every_place():
    lines = TEXT.split("\n")
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(lines)), r) for r in (1, 2, 3)):
        ranges = [lines[a:b] for a, b in zip((0, *cuts), (*cuts, len(lines)))]
        assert in_ranges(ranges) == whole(TEXT)
    assert in_ranges([[x] for x in lines]) == whole(TEXT)


@pytest.fixture
def split_size(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [16, 1000])
def test_equals_the_reader(spark, tmp_path, split_size, size):
    (tmp_path / "c.csv").write_bytes(TEXT.encode())
    truth = src.missing_as_null(spark.read.options(**src.CSV_OPTIONS).csv(str(tmp_path / "c.csv")))
    split_size(size)
    got = src.read_catalog_csv(spark, str(tmp_path / "c.csv"))
    assert got.columns == truth.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, truth.collect()), key=repr)
    numbers = [r["number"] for r in read_records(spark, str(tmp_path / "c.csv")).orderBy("number").collect()]
    assert numbers == list(range(len(numbers)))


def test_one_file_is_many_tasks(spark, tmp_path, split_size):
    rng = random.Random(3)
    cell = lambda: '"' + "".join(rng.choices(["a", "\n", '""', ",", " b"], k=rng.randint(0, 30))) + '"'
    rows = [f"{i},{cell()},{cell()}" for i in range(3000)]
    for tenant, some in {"big": rows, "small": rows[:3]}.items():
        (tmp_path / tenant).mkdir()
        (tmp_path / tenant / "products.csv").write_bytes("\n".join(["id,Product,Brand", *some]).encode())
    truth = spark.read.options(**src.CSV_OPTIONS).csv(str(tmp_path / "big" / "products.csv"))
    truth = {int(r["id"]): (r["Product"], r["Brand"]) for r in truth.collect()}
    split_size(20_000)
    records = read_records(spark, str(tmp_path / "big"))
    assert records.where("number > 0").count() == 3000
    whole = src.read_all_tenants(spark, str(tmp_path)).where("tenant_id = 'big'").collect()
    assert len(whole) == 3000
    assert all(r["row_id"] == int(r["id"]) for r in whole)
    missing = lambda v: None if v in src.NA_TOKENS else v
    assert {int(r["id"]): (r["product_name"], r["brand"] if "brand" in r else r["Brand"]) for r in whole} == {
        i: tuple(map(missing, v)) for i, v in truth.items()}


def test_headers_only(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "c.csv").write_text("Product,Price (€)\n", encoding="utf-8")
    assert src.read_all_tenants(spark, str(tmp_path)).count() == 0
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        src.read_all_tenants(spark, str(tmp_path / "none"))
