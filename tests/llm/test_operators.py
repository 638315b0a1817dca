"""Operators and queries on small tables with every odd case, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_arrays import BASE, label, library_ids, reference_shingles

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import components as union
from shelfwise.llm import jaccard, langid, merkle, nn_descent, packing, quality, secrets, token_files, warc
from shelfwise.llm.common import ordered_parts, tuned
from shelfwise.llm.components import components
from shelfwise.llm.pieces import tokenizer_path
from shelfwise.session import materialized, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, start string, label string"
SF_DIR = entry.SMOKE_DIR
LARGER = SF_DIR.replace("sf0.001", "sf0.01")
DOC_QUERIES = ["op1_token_files", "op4_langid", "op5_packing", "op6_jaccard", "op7_bpe", "op8_quality", "op9_secrets", "op10_merkle"]


def odd_rows() -> list[tuple]:
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    long = " ".join(rng.choices(words, k=30_000))
    text = " ".join(rng.choices(words, k=120))
    near = text.replace(text.split()[60], "changed", 1)
    texts = [None, "", " \n\t", "One", "one two", long, long + " more", text, text, near, text.upper(), 'the token = "abcdef123" and', "«naïve» 漢字 🙂"]
    rows = [(i, t, "en" if i % 3 else None, None, None, "x", "y", None) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, text, None, None, None, None, None, None), (7, "other text of the same id", "fr", "s", 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return tuned(spark).createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(rows, nulls_first: bool = True):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    return sorted(rows, key=key)


def test_ordered_parts(spark):
    df = spark.createDataFrame([(i % 50 if i % 7 else None,) for i in range(300)], "k long")
    for down in (False, True):
        rows = ordered_parts(df, "k", 6, descending=down).groupBy("part").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*"))
        rows = sorted((r for r in rows.collect() if r["a"] is not None), key=lambda r: r["part"], reverse=down)
        assert all(x["b"] < y["a"] for x, y in zip(rows, rows[1:]))
        assert len(rows) >= 5


def test_token_files(spark, docs, none):
    folder = shared_dir(spark, "t")
    path = tokenizer_path("word_bpe_49k.json")
    files = token_files.write_token_files(docs, folder, path, "word", 1)
    got = token_files.read_token_files(spark, folder, files).orderBy("start").collect()
    rows = in_order([(r[0], r[1] or "") for r in odd_rows()])
    ids = [i + (1).to_bytes(4, "little") for i in library_ids("word_bpe_49k.json", [t for _, t in rows])]
    starts = np.cumsum([0, *(len(i) // 4 for i in ids)])[:-1]
    want = [(d, int(s), len(i) // 4, zlib.crc32(i)) for (d, _), s, i in zip(rows, starts, ids)]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    empty = shared_dir(spark, "t")
    files = token_files.write_token_files(none, empty, path, "word", 1)
    assert files.count() == 0


def test_packing(spark, docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    limits = packing.Limits(tokens=64, segments=3, loss=50)
    rows = packing.pack_examples(docs.withColumn("ask", F.lit("what is this")), path, "byte", 0, limits, context="ask").collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= 64 and len(pieces) <= 3 and sum(r["loss_tokens"] for r in pieces) <= 50
    assert packing.pack_examples(none, path, "byte", 0).count() == 0


def test_packed_pieces_hold_every_id(spark, docs):
    rows = packing.pack_examples(docs, tokenizer_path("byte_bpe_50k.json"), "byte", 0).collect()
    texts = [t or "" for _, t, *_ in odd_rows()]
    want = {}
    for d, ids in zip((r[0] for r in odd_rows()), library_ids("byte_bpe_50k.json", texts)):
        want.setdefault(d, []).append(len(ids) // 4 + 1)
    for d, sizes in want.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == sum(sizes)
    ids = library_ids("byte_bpe_50k.json", [texts[5]])[0] + bytes(4)
    for r in rows:
        if r["doc_id"] == 5:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])


def components_by_force(rows, percent=85):
    sets = [reference_shingles(t) for _, t in rows]
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    top = label(len(rows), links)
    least = {}
    for (d, _), t in zip(rows, top):
        if d is not None:
            least[t] = min(d, least.get(t, d))
    return [(d, len(s), least.get(t)) for (d, _), s, t in zip(rows, sets, top)]


def test_jaccard(spark, docs, none):
    got = jaccard.jaccard_components(docs).collect()
    want = components_by_force([(r[0], r[1]) for r in odd_rows()])
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_in_many_units(spark, monkeypatch):
    """Groups that must be cut into bands and blocks give the components of one tree."""
    monkeypatch.setattr(jaccard, "UNIT_SETS", 5)
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(30 + 40 * g)]
        for k in range(25):
            extra = [f"x{g}_{k}_{i}" for i in range(rng.randint(0, 2 + g))]
            rows.append((len(rows), " ".join(words[: len(words) - rng.randint(0, 3)] + extra)))
    got = jaccard.jaccard_components(tuned(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(components_by_force(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_jaccard_over_the_whole_ratio_of_sizes(spark, monkeypatch, percent):
    """Linked sets whose sizes differ by nearly 100 / percent meet in a unit, wherever the bands fall."""
    monkeypatch.setattr(jaccard, "UNIT_SETS", 1)
    rows = []
    for g, n in enumerate(range(60, 400, 9)):
        words = [f"g{g}w{i}" for i in range(n + 3)]
        less = -(-n * percent // 100) + g % 3  # shingles of the smaller one, which the larger one holds
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: less + 3]))]
    df = tuned(spark).createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, percent=percent).collect()
    want = components_by_force(rows, percent)
    assert all(c == d - d % 2 for d, _, c in want)
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_of_each_group(spark, docs, none):
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for known, i, _ in ids if known] == [0, 1, 2, 3, 4, 5, 7, 7, 11, 12]
    assert jaccard.one_of_each_group(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (1, 2), (2, 1)]
    links += [(500, i) for i in range(501, 700)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    top = label(701, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_one_task_take_no_rounds(spark, monkeypatch):
    """Edges are written once and a time per round; a path inside a task is contracted there."""
    written = []
    monkeypatch.setattr(union, "materialized", lambda df, purpose: written.append(purpose) or materialized(df, purpose))
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert dict(components(path.coalesce(1)).collect()) == {i: 0 for i in range(301)}
    assert written == ["edges"]
    monkeypatch.setattr(union, "HELD_NODES", 2)  # what a task holds may end anywhere
    assert dict(components(path.coalesce(1)).collect()) == {i: 0 for i in range(301)}


def python_steps(df) -> int:
    """The most Python steps that one task of ``df`` runs, each in a worker of its own."""
    most, above = 0, []  # depth, steps of the task so far, whether what is below belongs to other tasks
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        while above and above[-1][0] >= depth:
            above.pop()
        steps = (above[-1][1] if above and not above[-1][2] else 0) + name.startswith("MapInArrow")
        above.append((depth, steps, "Exchange" in name.split(" ")[0]))
        most = max(most, steps)
    return most


def test_near_duplicates_take_one_python_worker_a_task(spark, docs, monkeypatch):
    """Workers stay, so a task that needs two of them doubles what Python holds on an executor."""
    steps = {}

    def recorded(df, purpose):
        steps[purpose] = max(steps.get(purpose, 0), python_steps(df))
        return materialized(df, purpose)

    monkeypatch.setattr(jaccard, "materialized", recorded)
    monkeypatch.setattr(union, "materialized", recorded)
    kept = jaccard.one_of_each_group(docs, 5, 80)
    assert python_steps(kept) == 1
    assert steps["shingle-classes"] == steps["key-groups"] == 1
    assert steps["edges"] == 1 and max(steps.values()) == 1


def test_nn_descent(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lab in (1, 2, None):
        base = rng.standard_normal((60, 16))
        dense = rng.standard_normal(16) + 0.02 * rng.standard_normal((700, 16))
        for v in [*base, *(base[:25] + 0.1 * rng.standard_normal((25, 16))), *dense]:
            rows.append((len(rows), v.tolist(), lab))
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [1.0, 2.0], 1)]
    rows += [(9007, [2.0, 4.0], 1), (None, rows[0][1], 1), rows[0], (9009, [1e200] * 16, 2), (9010, [2e200] * 16, 2), (9011, [float("inf")] * 16, 2)]
    got = nn_descent.near_duplicates(tuned(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, i in enumerate(ok):
        for j in ok[:a]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    top = label(len(rows), links)
    least: dict[int, int] = {}
    for i, t in enumerate(top):
        if rows[i][0] is not None:
            least[t] = min(rows[i][0], least.get(t, rows[i][0]))
    want = [(rows[i][0], degree[i], least.get(top[i])) for i in range(len(rows))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nn_descent_finds_what_its_search_misses(spark, monkeypatch):
    """A search that finds the links of a dense group only: the audit is not swamped by them, and all other links are found."""
    rng = np.random.default_rng(8)
    dense = rng.standard_normal(16) + 0.02 * rng.standard_normal((400, 16))
    base = rng.standard_normal((150, 16))
    pairs = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape)])
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*dense, *pairs])]
    df = tuned(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    real = nn_descent.search

    def poor(classes, *rest):
        few = classes.where("vec_id < 400").select("node")
        return real(classes, *rest).join(few.withColumnRenamed("node", "a"), "a").join(few.withColumnRenamed("node", "b"), "b").select("a", "b")

    monkeypatch.setattr(nn_descent, "search", poor)
    monkeypatch.setattr(nn_descent, "AUDIT", 40)
    monkeypatch.setattr(nn_descent, "BLOCK", 8)  # many blocks: a search is cheaper
    got = {r["vec_id"]: r["component_id"] for r in nn_descent.near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = label(len(rows), list(zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))))
    least: dict[int, int] = {}
    for i, t in enumerate(top):
        least.setdefault(t, i)
    assert got == {i: least[t] for i, t in enumerate(top)}


def pages_of() -> list[tuple]:
    inner = warc.record(99, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None).decode()
    big = "y" * 1500
    one = [(1, "http://a", inner * 3), (2, None, None), (3, "b", "é" + inner), (4, "c", big), (5, "c", big), (5, "c", big), (None, "c", big)]
    return [*one, (6, "x\r\ny", "WARC/1.1\r\nContent-Length: 30\r\n\r\n" + "z" * 3000), (7, "", ""), (8, "q", "WARC/1.1\r\n"), (9, "q", "k" * 40_000),
            (10, "long/" + "u" * 100_000, "p"), (11, "colons:" * 30_000, inner), (12, "c", "WARC/1.1\r\n" + "a: b\r\n" * 20_000)] * 2


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_warc(spark, split):
    folder = shared_dir(tuned(spark), "w")
    pages = spark.createDataFrame([(*p, "extra") for p in pages_of()], "page_id long, url string, html string, digest string")
    files = warc.write_warc(pages.coalesce(2), folder, 30_000)
    got = warc.read_warc(spark, files, folder, split).collect()
    want = []
    for page, _, html in pages_of():
        data = (html or "").encode()
        refers = 5 if (html or "").startswith("yyy") and page != 5 else 9 if len(data) == 40_000 and page != 9 else None
        refers = refers if refers != page else None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    key = lambda r: tuple((x is not None, x or "") if isinstance(x, str) else (x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_warc_of_nothing(spark):
    folder = shared_dir(tuned(spark), "w")
    files = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_warc(spark, files, folder).count() == 0


def test_language_and_quality_carry_columns(spark, docs, none):
    model = langid.learn(docs)
    rows = langid.predict_language(docs, model)
    assert set(rows.columns) == {*docs.columns, "lang_pred", "phrase_symbols"} and rows.count() == docs.count()
    assert {r["lang_pred"] for r in rows.where("text is null or trim(text) = ''").collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(13)] + [(1, None, 0, "x"), (None, 1, 0, "x"), (1, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    scored = quality.score_quality(docs, quality.learn(docs, labels))
    assert scored.where("score between 0 and 1").count() == docs.count()
    assert quality.score_quality(docs, quality.learn(docs, labels.limit(0))).where("score = 0.5").count() == docs.count()
    assert langid.predict_language(none, langid.learn(none)).count() == 0
    assert quality.score_quality(none, quality.learn(none, labels)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    """Changing the label or language of held-out rows changes no result."""
    rows = [(i, f"{'the cat and dog' if i % 2 else 'le chat et chien'} {i} " * 4, "en" if i % 2 else "fr") for i in range(120)]
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    changed = [(i, t, "zz" if out(i) else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    results = []
    for data in (rows, changed):
        df = tuned(spark).createDataFrame(data, schema)
        labels = spark.createDataFrame([(i, (i % 2) if not out(i) or data is rows else 1 - i % 2) for i, _, _ in rows], "doc_id long, quality int")
        langs = langid.predict_language(df, langid.learn(df)).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
        scores = quality.score_quality(df, quality.learn(df, labels)).select("doc_id", "score").orderBy("doc_id").collect()
        results.append((langs, scores))
    assert results[0] == results[1]
    assert {r["lang_pred"] for r in results[0][0]} == {"en", "fr"}


def test_secret_scan(spark, docs, none):
    for r in secrets.scan_secrets(docs).collect():
        spans = [(m.start(), 0, m.end()) for m in BASE.finditer(r["text"] or "") if len(m[1]) >= 6]
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()
        assert r["n_assign"] == len(spans)
    assert secrets.scan_secrets(none).count() == 0
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs).where("doc_id in (0, 1, 11)").collect()}
    assert masked == {0: None, 1: "", 11: 'the <assign>" and'}


def test_merkle(spark, docs, none):
    rows = in_order([(r[0], r[1] or "") for r in odd_rows()])[::-1]
    want = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((doc_id is not None, doc_id or 0, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = merkle.fingerprint_documents(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert merkle.fingerprint_documents(none).count() == 0
    assert merkle.fingerprint_documents(docs.where("doc_id = 5")).head()["near_next"] == 1


def test_pipeline_stages(spark, docs, none):
    for table in (docs, none):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            before = rows
            rows = stage(spark, rows, SF_DIR)
            rows.count()
            if name != "packing":
                assert rows.columns == before.columns


def test_pipeline_drops_copies_at_four_fifths(spark):
    """Copies with a block of words replaced: one stays if five-word shingles are alike to 0.8, both if they are not."""
    rows = []
    for g, changed in enumerate((8, 14, 17, 20, 24, 40)):
        words = [f"g{g}w{i}" for i in range(200)]
        new = [f"new{g}w{i}" for i in range(changed)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:90] + new + words[90 + changed :]))]
    alike = {}
    for (d, a), (_, b) in zip(rows[::2], rows[1::2]):
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        alike[d] = len(s & t) / len(s | t)
    assert [d for d in alike if alike[d] >= 0.8] == [0, 2, 4]
    docs = tuned(spark).createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0 or alike[d - 1] < 0.8}


def test_pipeline_at_work(spark):
    """Every stage acts, and clean documents stay."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    extra = [(90001, "12345 !!", "en", "s", 8), (90002, 'Of the and in thand token = "zzzzzz99" ' * 3, "en", "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, LARGER)
        seen[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert 90001 not in seen["language_id"]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(good - seen["quality"].keys()) <= 0.05 * len(good)
    assert len(bad & seen["quality"].keys()) <= 0.2 * len(bad)
    assert len(seen["near_duplicates"]) < len(seen["quality"])
    assert "zzzzzz99" not in seen["secrets"].get(90002, "")


def test_quality_learns_from_whole_texts(spark):
    """Documents that differ from good ones only far beyond the length of a stretch teach that, and are told apart."""
    rng = random.Random(3)
    usual, good, bad = ([f"{p}{rng.randrange(10**6)}" for _ in range(300)] for p in "ugb")
    rows, marks = [], []
    for i in range(240):
        text = " ".join(rng.choices(usual, k=500)) + " " + " ".join(rng.choices(good if i % 2 else bad, k=1500))
        rows.append((i, text))
        marks.append((i, i % 2))
    docs = tuned(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.learn(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert model.fitted
    held = [(i, text) for i, text in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((model.score(text) >= 0.5) == bool(i % 2) for i, text in held)
    assert right >= 0.95 * len(held) > 0
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score_quality(docs, model).collect()}
    assert got == {i: (model.score(t), int(model.score(t) >= quality.THRESHOLD)) for i, t in rows}
    again = quality.learn(docs.repartition(7), spark.createDataFrame(marks[::-1], "doc_id long, quality int"))
    assert [again.score(t) for _, t in held] == [model.score(t) for _, t in held]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op4_langid"](spark, LARGER).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 0
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
    found = entry.queries()["op8_quality"](spark, LARGER).where("held_out").join(labels, "doc_id")
    assert found.where("quality = predicted").count() >= 0.95 * found.count() > 0


@pytest.mark.parametrize("name", [*DOC_QUERIES, "op2_nn_descent", "op3_warc", "pipeline"])
def test_query_covers_its_table(spark, name):
    found = entry.queries()[name](spark, SF_DIR)
    table, key = {"op2_nn_descent": ("embeddings", "vec_id"), "op3_warc": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    if name == "pipeline":
        assert found.count() > 0
        return
    ids = {r[0] for r in found.select(key).distinct().collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
