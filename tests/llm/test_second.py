"""Embedding dedup, toxicity, LM scores and repeated strings against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskflow.llm import common, embeddings, lm, suffixes, toxicity

# ------------------------------------------------------------------ repeated strings


def plain_suffix_array(s):
    s = list(s)
    return sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(12))
def test_induced_sorting(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    body = rng.integers(1, [2, 3, 5, 200][seed % 4], 300) if seed else np.zeros(0, np.int64)
    if seed > 6:
        body = np.concatenate([body, body[:150], np.full(40, 1), body])
    s = np.append(body, 0).astype(np.int16)
    for small in (300, 0):  # a whole bucket at a time, and entry by entry
        monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
        sa = suffixes.suffix_array(s, 258)
        assert sa.tolist() == plain_suffix_array(s.tolist())
    plcp = suffixes.permuted_lcp(s, sa)
    t = s.tolist()
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert plcp[b] == n


def test_induced_sorting_recurses():
    """Fibonacci words and long periods, whose names repeat level after level."""
    a, b = [1, 2], [1]
    while len(a) < 900:
        a, b = a + b, a
    for body in (a, [1, 2, 3] * 200, [2, 1] * 250, [5] * 300, (list(range(1, 40)) * 9)[:-3]):
        assert suffixes.suffix_array(np.array([*body, 0], np.int16), 258).tolist() == plain_suffix_array([*body, 0])


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(docs, length=400, **kw):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i if i is not None else -9, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], length))))
    got = sorted((r[0] if r[0] is not None else -9, *r[1:]) for r in suffixes.remove_repeats(docs, length=length, **kw).collect())
    assert got == want


def test_repeats_of_tables(odd, documents):
    check_repeats(odd.select("doc_id", "text").union(documents.select("doc_id", "text")), shard_bytes=200_000)


def test_repeats_of_made_up_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9)))
    passages = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 100)
            parts += [p[a : a + rng.randrange(380, 600)], word()]
        texts.append(" ".join(parts))
    texts += ["ab" * 400, "x" * 399, "x" * 400, "x" * 401, passages[0], passages[0], passages[0] + "!", "y" * 350, "z" * 2000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("t", F.lit(1))
    check_repeats(docs, shard_bytes=20_000)


def test_repeats_of_nothing(empty):
    assert suffixes.remove_repeats(empty).count() == 0


# ------------------------------------------------------------------ LM scores


def plain_lm(texts, order=3, backoff=0.4):
    docs = [[w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    total = Counter(g for w in docs for n in range(1, order + 1) for g in grams(w, n))
    words = sum(map(len, docs))
    out = []
    for w in docs:
        own = Counter(g for n in range(1, order + 1) for g in grams(w, n))
        c = lambda g: total[g] - own[g]
        s = 0.0
        for i in range(len(w)):
            x = 0.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    x += math.log(max(c(g), 0.5)) - math.log(max(words - len(w), 1))
                elif c(g) > 0:
                    x += math.log(c(g)) - math.log(max(c(g[:-1]), c(g)))
                    break
                else:
                    x += math.log(backoff)
            s += x
        out.append((len(w), s / len(w) if w else 0.0))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(odd, documents, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 5_000)
    monkeypatch.setattr(lm, "PART_GRAMS", 50_000)
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(((i, n, s) for (i, _), (n, s) in zip(rows, plain_lm([t for _, t in rows], order))), key=key)
    got = sorted(map(tuple, lm.score(docs, order=order).collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_lm_of_nothing(empty):
    assert lm.score(empty).count() == 0


# ------------------------------------------------------------------ embeddings


def vectors(spark, n=400, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:60].repeat(5, 0) + rng.normal(size=(300, dim)) * 0.08
    x = np.concatenate([base, near, base[:10], 3 * base[10:14]])
    rows = [(i, v.tolist(), i % 3 if i < 5 else 1, "e") for i, v in enumerate(x)]
    k = len(rows)
    rows += [(k, None, 1, "e"), (k + 1, [0.0] * dim, 1, "e"), (k + 2, [1.0, None] + [0.0] * (dim - 2), 1, "e"), (k + 3, [float("nan")] * dim, 1, "e"), (k + 4, base[0].tolist(), None, "e"), (k + 5, [], 1, "e"), (k + 6, [1.0, 2.0], 1, "e"), (k + 7, [2.0, 4.0], 1, "e"), (0, base[0].tolist(), 0, "e")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")


@pytest.mark.parametrize("most", [150, 4_000])
def test_embedding_links(spark, monkeypatch, most):
    rows, df = vectors(spark)
    monkeypatch.setattr(embeddings, "SHARD", 120)
    monkeypatch.setattr(embeddings, "SHARD_MOST", most)
    want, forest = Counter(), common.Forest()
    good = {i: (np.array(x), y) for i, x, y, _ in rows if x and y is not None and None not in x and np.isfinite(x).all() and np.any(x)}
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]):
                x, y = good[a][0], good[b][0]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    want[a] += 1
                    want[b] += 1
                    forest.link(a, b)
    got = embeddings.dedup(df).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: r.n_links for r in got}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and all(found[i] <= want[i] for i in found)
    right = sum(r.component_id == forest.find(r.vec_id) for r in got)
    if most > len(rows):  # one shard per label: nothing can be lost
        assert found == {i: want[i] for i in found} and right == len(got) and sum(want.values()) > 0
    else:
        assert sum(found.values()) >= 0.98 * sum(want.values()) and right >= 0.98 * len(got)


def test_a_search_that_finds_nothing_fails_the_audit(spark, monkeypatch):
    """What the search has lost is measured before it is mended; a task whose search fails compares all pairs."""
    x = groups(np.random.default_rng(7), 6, 20, 16)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nothing = np.zeros(0, np.int64)
    monkeypatch.setattr(embeddings, "range_search", lambda *a: (nothing, nothing))
    report = {}
    for r in embeddings.dedup(df, report=report).collect():
        assert (r.n_links, r.component_id) == (19, r.vec_id // 20 * 20)
    assert report["search_recall"] == 0 and report["links_seen"] > 500 and report["tasks_mended"] == 1
    # without the mending the audit of the whole sees it too
    monkeypatch.setattr(embeddings, "LEAST_RECALL", -9)
    n_links = embeddings.links(df)[1]
    assert embeddings.audit(df, n_links) < 0.8


def test_the_search_alone(spark, monkeypatch):
    """Recall of the graph search, with nothing mended, over shards of several labels."""
    monkeypatch.setattr(embeddings, "SHARD", 400)
    monkeypatch.setattr(embeddings, "SHARD_MOST", 600)
    x = groups(np.random.default_rng(8), 150, 20, 32)
    df = spark.createDataFrame([(i, v.tolist(), i // 20 % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    report = {}
    out = embeddings.dedup(df, report=report).collect()
    assert report["search_recall"] >= 0.98 and report["tasks_mended"] == 0 and report["links_seen"] > 5000
    assert sum(r.n_links for r in out) >= 0.98 * 3000 * 19


def test_joined():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 20), (300, 200), (300, 900)):
        p, q, root, forest = rng.integers(0, n, m), rng.integers(0, n, m), np.arange(n), common.Forest()
        for a in range(0, m, 70):
            embeddings.joined(root, p[a : a + 70], q[a : a + 70])
        for a, b in zip(p.tolist(), q.tolist()):
            forest.link(a, b)
        assert root.tolist() == [forest.find(i) for i in range(n)]


def test_large_shards_are_split_further(spark, monkeypatch):
    """With few centroids at first, further ones part the shards; links within groups are all found."""
    for name, value in (("SHARD", 60), ("SHARD_MOST", 100), ("SAMPLE", 80), ("CHILDREN", 4), ("DEALT", 70)):
        monkeypatch.setattr(embeddings, name, value)
    x = groups(np.random.default_rng(6), 120, 8, 24)
    df = spark.createDataFrame([(i, v.tolist(), i // 8 % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nodes = spark.createDataFrame([(str(i // 8 % 2), 24, v.tolist(), i, 1, [7]) for i, v in enumerate(x)], "label string, dim int, x array<double>, id long, copies long, shards array<long>")
    split = embeddings.split_further(nodes, 2)
    assert split.columns == nodes.columns and split.count() == len(x) and split.where("array_contains(shards, 7L)").count() == 0
    sizes = [r["count"] for r in split.select("label", F.explode("shards").alias("s")).groupBy("label", "s").count().collect()]
    assert max(sizes) < 480 and len(sizes) > 16
    for r in embeddings.dedup(df).collect():
        assert (r.n_links, r.component_id) == (7, r.vec_id // 8 * 8)


def test_labels_outside_the_sample(spark, monkeypatch):
    """Labels that the sample has not met keep their links, however large they are together."""
    monkeypatch.setattr(embeddings, "SAMPLE", 5)
    monkeypatch.setattr(embeddings, "SHARD_MOST", 20)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    rows = [(3 * i + k, (b + rng.normal(size=8) * 0.01).tolist(), i) for i, b in enumerate(base) for k in range(3)]
    rows += [(1000 + i, (base[0] + rng.normal(size=8) * 0.01).tolist(), 500) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for r in embeddings.dedup(df).collect():
        assert (r.n_links, r.component_id) == ((2, r.vec_id // 3 * 3) if r.vec_id < 1000 else (49, 1000))


def groups(rng, n, size, dim=64):
    return np.concatenate([b + rng.normal(size=(size, dim)) * 0.02 for b in rng.normal(size=(n, dim))])


@pytest.mark.parametrize("n, size", [(10, 100), (2, 60)])
def test_near_copies_beyond_the_candidates(spark, n, size):
    """Groups with more near copies than a vector has candidates are islands of the graph, and still found whole."""
    x = groups(np.random.default_rng(4), n, size)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    _, n_links, _ = embeddings.links(df)
    assert {(r.id, r.n_links) for r in n_links.collect()} == {(i, size - 1) for i in range(n * size)}
    for r in embeddings.dedup(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (size - 1, r.vec_id // size * size, r.vec_id % size == 0)


def test_embedding_audit_sees_lost_links(spark):
    _, df = vectors(spark)
    _, n, _ = embeddings.links(df)
    assert embeddings.audit(df, n) >= 0.95
    assert embeddings.audit(df, n.withColumn("n_links", F.lit(0))) < 0.5


def test_audit_leaves_exact_copies_out(spark):
    """Many copies of one vector do not hide that all links between different vectors are lost."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((300, 16)), groups(rng, 75, 8, 16)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    only_copies = spark.createDataFrame([(i, 299 if i < 300 else 0) for i in range(len(x))], "id long, n_links long")
    assert embeddings.audit(df, only_copies) == 0
    whole = spark.createDataFrame([(i, 299 if i < 300 else 7) for i in range(len(x))], "id long, n_links long")
    assert embeddings.audit(df, whole) == 1


def test_failed_audits_end_in_an_exact_search(spark, monkeypatch):
    x = groups(np.random.default_rng(3), 8, 15, 16)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nothing = np.zeros(0, np.int64)
    monkeypatch.setattr(embeddings, "SHARD_MOST", 50)
    told = iter([0.0, 0.0, 0.0, 1.0])
    monkeypatch.setattr(embeddings, "audit", lambda *a: next(told))
    monkeypatch.setattr(embeddings, "range_search", lambda *a: (nothing, nothing))
    for r in embeddings.dedup(df).collect():
        assert (r.n_links, r.component_id) == (14, r.vec_id // 15 * 15)
    monkeypatch.setattr(embeddings, "audit", lambda *a: 0.0)
    with pytest.raises(RuntimeError):
        embeddings.dedup(df)


def test_embeddings_of_nothing(spark):
    _, df = vectors(spark)
    assert embeddings.dedup(df.where("false")).count() == 0
    assert [r.kept for r in embeddings.dedup(df.where("label is null")).collect()] == [True]


# ------------------------------------------------------------------ toxicity


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def plain_scores(docs, labelled, queries, k=15):
    """Scores straight from the definitions: all cosines, in plain Python."""
    rate = sum(y for _, _, y in labelled) / len(labelled)
    df, held, bad = Counter(), Counter(), Counter()
    for t in docs:
        df.update(set(plain_words(t)))
    for _, t, y in labelled:
        held.update(set(plain_words(t)))
        bad.update(set(plain_words(t)) if y else ())

    def unit(text):
        v = {}
        for w, n in Counter(plain_words(text)).items():
            if w in held:
                p = (bad[w] + 2 * rate) / (held[w] + 2)
                v[w] = (1 + math.log(n)) * (1 + math.log((len(docs) + 1) / (df[w] + 1))) * (math.log(p / (1 - p)) - math.log(rate / (1 - rate))) ** 2
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    known, out = [(unit(t), y) for _, t, y in labelled], []
    for text in queries:
        q = unit(text)
        near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), y) for v, y in known), key=lambda c: -c[0])[:k]
        votes = [(c / (0.2 + math.sqrt(max(0, 2 - 2 * c))), y) for c, y in near if c > 1e-15]
        out.append((sum(w * y for w, y in votes) + toxicity.PRIOR_WEIGHT * rate) / (sum(w for w, _ in votes) + toxicity.PRIOR_WEIGHT))
    return out


def test_scores_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out())
    rows, by = docs.collect(), {}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    for r in rows:
        if r.doc_id in y and r.text is not None:
            i, label = by.get(r.text, (r.doc_id, 0))
            by[r.text] = min(i, r.doc_id), max(label, y[r.doc_id])
    want = plain_scores([r.text for r in rows], [(i, t, k) for t, (i, k) in by.items()], [r.text for r in rows[:300]])
    got = {r.doc_id: r._score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert np.allclose([got[r.doc_id] for r in rows[:300]], want, atol=1e-6)


@pytest.mark.parametrize("vocabulary", [12, 60, 3000])
def test_nearest_is_exact(vocabulary):
    rng = random.Random(vocabulary)
    terms = [f"t{i}" for i in range(vocabulary)]
    text = lambda: " ".join(rng.choices(terms, k=rng.randrange(1, 30)))
    index = toxicity.Index([(i, rng.randrange(2), text()) for i in range(700)], {t: 1 + rng.random() * 3 for t in terms})
    dense = np.zeros((len(index.ids), len(terms)))
    for t in range(len(terms)):
        dense[index.posted[index.at[t] : index.at[t + 1]], t] = index.impact[index.at[t] : index.at[t + 1]]
        if index.row[t] >= 0:
            dense[:, t] = index.full[: len(dense), index.row[t]]
    for x in toxicity.numbers_of([text() for _ in range(60)], index.number):
        at, w = index.vector(x)
        score = dense[:, at] @ w
        order = [e for e in np.lexsort((np.arange(len(score)), -np.round(score, 12)))[:15].tolist() if score[e] > 1e-15]
        assert [e for _, e in index.nearest((at, w), 15)] == order


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    s = toxicity.op6_toxicity(spark, sf)
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    rows = s.where("held_out").join(lab, "doc_id").select("toxic", "predicted", "score").collect()
    tp = sum(r.toxic and r.predicted for r in rows)
    assert tp / sum(r.toxic for r in rows) > 0.8 and tp / sum(r.predicted for r in rows) > 0.85
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) > 500


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    index = toxicity.fit(odd, labels)
    rows = toxicity.scored(odd, index, evidence=True).collect()
    assert len(rows) == odd.count() and all(0 <= r._score <= 1 for r in rows)
    none = toxicity.fit(empty, labels)
    assert {r._score for r in toxicity.scored(odd, none).collect()} == {0.0}
    assert toxicity.scored(empty, index).count() == 0
    clash = toxicity.scored(odd.withColumn("_SCORE", F.lit("own")), index)
    assert clash.columns == [*odd.columns, "_score"] and clash.count() == odd.count()


def test_evidence(spark):
    docs = spark.createDataFrame([(i, f"awful w{i}" if i % 2 else f"fine w{i}") for i in range(200)], "doc_id long, text string")
    index = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    r = toxicity.scored(spark.createDataFrame([(1, "so awful")], "doc_id long, text string"), index, evidence=True).first()
    assert r._score > 0.9 and len(r._evidence) == 15 and all(e.label == 1 and e.cosine > 0.9 for e in r._evidence)
