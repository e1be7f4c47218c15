"""Replacement in one pass and numbering by sorts give what replacing and numbering in turn give."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskflow.functions import spans, substitute
from maskflow.operators import mask


def in_turn(text, pairs):
    for a, z in pairs:
        text = text.replace(a, z)
    return text


short = st.text("ab1[]_X", min_size=1, max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.text("ab1[]_X ", max_size=60), st.lists(st.tuples(short, st.one_of(short, st.sampled_from(["[X_1]", "[X_11]", "", "zz"]))), max_size=25))
def test_replaced_equals_replacing_in_turn(text, pairs):
    ordered, few = substitute.in_turn(pairs), substitute.FEW
    substitute.FEW = 0
    try:
        assert substitute.replaced(text, ordered) == in_turn(text, ordered)
    finally:
        substitute.FEW = few


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_replaced_among_plain_texts(data):
    """Placeholders that no text touches, so that the one pass is what is tested."""
    texts = data.draw(st.lists(st.text("abcd", min_size=1, max_size=4), min_size=20, max_size=40, unique=True))
    ordered = substitute.in_turn([(t, f"[N_{i:03d}]") for i, t in enumerate(texts)])
    text = data.draw(st.text("abcd ", max_size=200))
    assert substitute.replaced(text, ordered) == in_turn(text, ordered)


def merged(base, findings):
    """Numbering one finding after the other."""
    import re

    acc, order = list(base), sorted(range(len(findings)), key=lambda i: (-findings[i][3], findings[i][1] - findings[i][2], i))
    for i in order:
        label, _, _, _, _, text = findings[i]
        if any(o == text for o, _ in acc):
            continue
        most = max((int(m[2]) for _, p in acc if (m := re.match(r"^\[([A-Z_]+)_([0-9]+)\]$", p)) and m[1] == label), default=0)
        acc.append((text, f"[{label}_{most + 1:03d}]"))
    return acc


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_numbered(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(30):
        n = rng.choice([0, 1, 5, 40, 300])
        found = [(rng.choice(["A", "B_C", "EMAIL"]), s := rng.randrange(2000), s + rng.randrange(1, 9), rng.choice([0.5, 0.9, 1.0]), i, f"t{rng.randrange(max(1, n // 2))}") for i in range(n)]
        base = [(f"t{rng.randrange(9)}x", rng.choice(["[A_007]", "[B_C_012]", "[other]", "[EMAIL_99999999999]"])), ("t1", "[A_002]")][: rng.randrange(3)]
        rows.append((k, base, found))
    df = spark.createDataFrame(rows, f"k int, base {mask.PAIRS}, found {spans.FINDING}")
    got = {r.k: [tuple(p) for p in r.p] for r in df.select("k", mask.merged_pairs(F.col("base"), F.col("found")).alias("p")).collect()}
    assert got == {k: merged([b for b in base], found) for k, base, found in rows}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_of_many_findings(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(20):
        n, wide = rng.choice([0, 1, 64, 65, 500]), rng.choice([50, 5000])
        rows.append((k, [("L", s := rng.randrange(wide), s + rng.randrange(1, 12), rng.choice([0.5, 1.0]), i % 4, "x") for i in range(n)]))
    df = spark.createDataFrame(rows, f"k int, found {spans.FINDING}")
    for r in df.select("k", "found", spans.without_overlaps(F.col("found")).alias("kept")).collect():
        kept = []
        for f in sorted(r.found, key=lambda f: (-f.score, f.start - f.stop, f.start, f.ord)):
            if all(f.stop <= g.start or g.stop <= f.start for g in kept):
                kept.append(f)
        assert [(f.start, f.stop, f.score) for f in r.kept] == sorted((f.start, f.stop, f.score) for f in kept)


def test_dense_and_sparse_rows_and_nulls(spark):
    many = [(f"name{i}", f"[N_{i:03d}]") for i in range(200)]
    text = " ".join(a for a, _ in many) * 3
    rows = [(0, text, many), (1, text, many[:3]), (2, None, many), (3, text, None), (4, "", []), (5, "name1 name19 name199", many)]
    df = spark.createDataFrame(rows, f"k int, text string, pairs {mask.PAIRS}")
    df = df.withColumn("masked", mask.applied(F.col("text"), F.col("pairs")))
    for r in df.withColumn("back", mask.reversed_(F.col("masked"), F.col("pairs"))).collect():
        text, pairs = rows[r.k][1:]
        want = None if text is None or pairs is None else in_turn(text, substitute.in_turn(pairs))
        assert r.masked == want and r.back == (text if want is not None else None)
