"""Operator 11 against a plain Merkle tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from churnlake.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, tree string, n int, r int, item string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def build(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at - at % arity
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + arity])))
        at //= arity
    return out


def expected(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in order:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[k] = build([leaf(r) for r in trees[k]], arity)
    top = build([built[k][-1][0] for k in order], arity)
    out = []
    for t, k in enumerate(order):
        for i, row in enumerate(trees[k]):
            steps = path(built[k], i, arity) + path(top, t, arity)
            h = leaf(row, 1 if row[0] is not None and row[0] % 3 == 0 else 0)
            for before, after in steps:
                h = digest(before + h + after)
            out.append((row[0], leaf(row), built[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


def made(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "Ünï 文", "x" * 50_000, None, "a:b"]), rng.choice(["en", "en", "en", "de", "Zz", "é", None, ""]), rng.choice([None, "s", "-"]), rng.choice([None, 5, 2**63 - 1])) for i in range(n)]
    return rows + [(None, "t", "en", None, 1)] * 3 + [rows[0]] * 4 + [(7, "other", "en", "s", 1)] if n else rows


@pytest.mark.parametrize(("n", "arity", "levels"), [(150, 2, 8), (150, 2, 2), (90, 3, 1), (40, 4, 2), (1, 2, 8)])
def test_manifest_matches_a_plain_tree(spark, n, arity, levels):
    rows = made(n)
    docs = spark.createDataFrame([(*r, "own", "own", "own", 1, 1, "own") for r in rows], SCHEMA).repartition(5)
    out = manifest.manifest(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), arity, levels)
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), "folded_root", "verified")
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows, arity)


def test_untampered_rows_verify_and_one_leaf_is_the_root(spark):
    docs = spark.createDataFrame([(5, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = manifest.manifest(docs).first()
    assert row.verified and row.leaf == row.subroot == row.root and row.path == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest.manifest(docs).collect() == []
