"""Operator 13 against brute force."""

import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from churnlake.llm import runs

WORD = r"[^\x20\x09-\x0D]+"


def brute(w, shortest=6, power=4):
    found = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(shortest, power * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n ", "one", "a " * 6, "a " * 5, "a b " * 4, "a b a b a b a", "b " + "a " * 9 + "b", "é文 " * 30, "x " * 20_000]
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    out += [fibonacci[-1], " ".join("ab"[bin(i).count("1") % 2] for i in range(512))]
    for _ in range(120):  # few words: runs of many periods, nested and overlapping
        out.append("\t".join(rng.choice("abc"[:rng.choice((1, 2, 2, 3))]) for _ in range(rng.randrange(1, 120))))
    for _ in range(60):
        p, prose = rng.randrange(1, 12), [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 80))]
        unit = [rng.choice("abcd") for _ in range(p)] * rng.randrange(2, 7)
        at = rng.randrange(len(prose) + 1)
        out.append(" ".join(prose[:at] + unit + unit[:rng.randrange(len(unit) + 1)] + prose[at:]))
    return out


@pytest.mark.parametrize(("shortest", "power"), [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(spark, texts, shortest, power):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in runs.find(docs, shortest=shortest, power=power).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        w = re.findall(WORD, t or "")
        want = brute(w, shortest, power) if len(w) < 5_000 else [(0, len(w), 1)]
        assert (got[i].n_words, [tuple(r) for r in got[i].runs]) == (len(w), want), (i, t)
        assert got[i].collapsed == kept(w, want), i


def test_long_text_with_a_periodic_tail(spark):
    rng = random.Random(8)
    head, unit = [f"h{i}" for i in range(40_000)], [f"u{rng.randrange(99)}" for _ in range(9_000)]
    text = " ".join(head + unit * 5 + unit[:17])
    row = runs.find(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(r) for r in row.runs] == [(40_000, 45_017, 9_000)] and row.collapsed == " ".join(head + unit)


def test_repeated_tail_follows_its_formula(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 90)) if i % 17 else None) for i in range(400)] + [(None, "a b")], "doc_id long, text string")
    n_made = 0
    for r in docs.withColumn("out", runs.repeated_tail(F.col("doc_id"), F.col("text"))).collect():
        w = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, n_made = g % n, n_made + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert (r.out or "").split() == w
    assert n_made > 10


def test_strongest_is_exact_and_takes_the_first_of_equals(spark):
    lists = [[], [(0, 9, 2), (3, 9, 2)], [(0, 8, 2), (1, 4, 1), (1, 13, 3)], [(0, 3 * 10**9 + 1, 10**9), (5, 3 * 10**9 + 2, 10**9)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, runs array<{runs.RUN}>")
    for r in rows.select("i", runs.strongest(F.col("runs")).alias("b")).collect():
        want = max(lists[r.i], key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r.b) if r.b else None) == want


def test_clashing_and_extra_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a " * 8, "x", [2], "y")], "doc_id long, text string, runs string, more array<int>, collapsed string")
    out = runs.find(rows)
    assert out.columns == ["doc_id", "more", "n_words", "runs", "collapsed"] and out.first().collapsed == "a" and out.first().more == [2]
    assert runs.find(rows.limit(0)).collect() == []
