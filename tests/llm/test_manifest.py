"""Merkle manifests against a tree built level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import manifest
from shelfwise.llm.common import tuned

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, n long, digest string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root, and per leaf its siblings with the side they are on, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            other = i ^ 1
            path.append(None if other >= len(nodes) else (nodes[other], other < i))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def expected(rows):
    langs: dict = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        told = n_chars + 1 if n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, told, text)))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: (sorted(langs[v]), *climb([r[2] for r in sorted(langs[v])])) for v in order}
    root, tops = climb([trees[v][1] for v in order])
    out = []
    for v, top in zip(order, tops):
        leaves, subroot, paths = trees[v]
        for (known, doc_id, own, told), path in zip(leaves, paths):
            path = path + top
            found = told
            for step in path:
                found = digest(found) if step is None else digest(step[0], found) if step[1] else digest(found, step[0])
            proof = digest(*(s[0] for s in path if s))
            out.append((doc_id if known else None, own, subroot, root, proof, found, found == root))
    return out


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            text = rng.choice([None, "", "é漢🙂", f"text {i}", "same", "long " * 2000])
            rows.append((rng.choice([i, i, i, 5, None]), text, lang, rng.choice([None, "", "web"]), rng.choice([None, 0, i]), "t", 1, 2, "d", "r"))
    return [*rows, *rows[:3]]


CASES = [{"en": 1}, {None: 3}, {"en": 40, None: 1, "": 5, "é": 7, "z": 16, "de": 17}, {f"l{i}": i % 4 + 1 for i in range(13)}]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_manifest(spark, case):
    rows = rows_of(CASES[case])
    df = tuned(spark).createDataFrame(rows, SCHEMA).repartition(3)
    truth = sorted(expected(rows), key=repr)
    for band in (2, manifest.BAND) if case == 2 else (2,):
        found = manifest.manifest(df, manifest.every_seventh(F.col("doc_id")), band).collect()
        assert sorted(map(tuple, found), key=repr) == truth


def test_tampering_is_seen_and_only_that(spark):
    rows = [(i, "t", "en", "s", 1 if i % 2 else None, "t", 1, 2, "d", "r") for i in range(50)]
    found = manifest.manifest(tuned(spark).createDataFrame(rows, SCHEMA), F.col("doc_id") < 10).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {1, 3, 5, 7, 9}
    assert all(r["verified"] for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def test_no_rows(spark):
    assert manifest.manifest(tuned(spark).createDataFrame([], SCHEMA)).collect() == []


def test_sweeps():
    """Any block: up and down agree with the tree built level by level, and the queue holds a message per level at most."""
    for n in range(1, 70):
        leaves = [digest(str(i)) for i in range(n)]
        root, paths = climb(leaves)
        nodes = manifest.sweep_up(leaves, manifest.height_of(n))
        assert next(reversed(nodes.values())) == root
        assert list(nodes) == sorted(nodes)
        for own, path, steps in zip(leaves, manifest.sweep_down(nodes, ""), paths):
            assert manifest.folded(own, path) == root
            assert manifest.proof_of(path) == digest(*(s[0] for s in steps if s))
