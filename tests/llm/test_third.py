"""Shards along a curve, importance resampling and collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskflow.llm import catalog, common, importance, phrases, sharding

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ shards


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2)])
def test_the_curve_steps_to_a_neighbour(n, bits):
    points = np.array(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij")).reshape(n, -1)
    at = sharding.hilbert(list(points), bits)
    assert sorted(at.tolist()) == list(range(2 ** (n * bits)))
    walk = points[:, np.argsort(at)].astype(int)
    assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all() and (walk[:, 0] == 0).all()


def laid_out(rows, shards, law):
    """Checks the law and the slots; the bytes of each shard."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    counts = [len(by[k]) for k in range(shards)]
    sizes = [sum(len((r.text or "").encode()) + 8 for r in by[k]) for k in range(shards)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    return sizes


def written(spark, docs, tmp_path, **kw):
    path = f"{tmp_path}/shards"
    dims = kw.pop("dims", {"key": None, "bytes": F.octet_length("text")})
    borders = sharding.write_shards(docs, path, dims, **kw)
    return path, borders, spark.read.parquet(path)


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_of_odd_rows(spark, odd, tmp_path, law, shards):
    odd = odd.withColumnsRenamed({"component": "Shard", "n": "slot"})
    _, _, out = written(spark, odd, tmp_path, law=law, shards=shards, file_bytes=60_000)
    rows = out.collect()
    laid_out(rows, shards, law)
    assert Counter((r.doc_id, r.text, r.key) for r in rows) == Counter((r.doc_id, r.text, r.key) for r in odd.collect())


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_keep_their_law_with_hot_rows(spark, tmp_path, law):
    rng = random.Random(5)
    rows = [(i if i % 3 else 7, "same text" if i % 3 else "equal row", "a" if i % 3 < 2 else None) for i in range(900)]
    rows += [(1000 + i, "x" * rng.randrange(400), rng.choice(["a", "b", "c"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    _, borders, out = written(spark, docs, tmp_path, law=law, shards=7, file_bytes=3000)
    sizes = laid_out(out.collect(), 7, law)
    if law == "bytes":
        assert max(sizes) - min(sizes) <= 2 * 408
    assert len(borders) == 2 and borders[0] and out.count() == 1200
    # equal texts of one cell, told apart by their ids, lie in one run
    at = sorted((r.shard, r.slot) for r in out.where("text = 'same text' and key = 'a'").collect())
    order = {x: i for i, x in enumerate(sorted((r.shard, r.slot) for r in out.collect()))}
    assert order[at[-1]] - order[at[0]] == len(at) - 1


def test_shards_of_an_empty_table(spark, empty, tmp_path):
    _, borders, out = written(spark, empty, tmp_path)
    assert out.count() == 0 and borders == [[], []]


def test_files_are_pruned(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path, borders, out = written(spark, docs, tmp_path, dims={"lang": None, "source": None, "n_chars": None}, file_bytes=8000, shards=24)
    files = sharding.manifest(spark, path, ["lang", "source", "n_chars"]).cache()
    assert files.count() > 40 and files.agg(F.sum("rows")).first()[0] == 200
    assert all(r.first.shard == r.last.shard for r in files.collect())
    for where in ({"lang": ("de", "de")}, {"n_chars": (None, 300)}, {"lang": ("en", "fr"), "source": ("src1", "src12"), "n_chars": (500, None)}, {"lang": ("zz", None)}):
        want = docs
        for c, (lo, hi) in where.items():
            want = want.where((F.col(c) >= lo) if lo is not None else F.lit(True)).where((F.col(c) <= hi) if hi is not None else F.lit(True))
        got = sharding.pruned(spark, path, files, where)
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    opened = set(sharding.pruned(spark, path, files, {"lang": ("de", "de")}).inputFiles())
    assert len(opened) < files.count() / 2
    # the same grid gives the same places
    _, again, more = written(spark, docs, f"{tmp_path}/more", dims={"lang": None, "source": None, "n_chars": None}, borders=borders, shards=24)
    assert again == borders and {(r.doc_id, r.curve, r.shard, r.slot) for r in more.collect()} == {(r.doc_id, r.curve, r.shard, r.slot) for r in out.collect()}


def test_op11(spark):
    out = catalog.QUERIES["op11_hilbert_shards"](spark, SF)
    assert [f.simpleString() for f in out.schema][:7] == ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"]
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()} and len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN_ROWS", 50)
    rows = common.written(spark.range(1000).select((F.col("id") % 7).alias("a"), "id"), "t")
    got = {r.id: r.row for r in common.numbered(rows, [F.col("a").desc(), F.col("id")], "row").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)))}


# ------------------------------------------------------------------ importance resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def plain_features(text):
    w = WORD.findall(lowered(text))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampled(docs, bench, percent, least):
    raw, aim, own = Counter(), Counter(), []
    for i, t in docs:
        n, f = plain_features(t)
        b = [zlib.crc32(x) % 10000 for x in f]
        raw.update(b)
        own.append((i, n, b))
    for t in bench:
        aim.update(zlib.crc32(x) % 10000 for x in plain_features(t)[1])
    S, T = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (S + 10000) / ((raw[b] + 1) * (T + 10000)))) for b in raw}
    out = []
    for i, n, b in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append([i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return out


def known(rows):
    return sorted(tuple(-9 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_resampling_of_tables(spark, odd, monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").union(spark.createDataFrame([(None,), ("",)], "text string"))
    want = plain_resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], 40, 5)
    got = importance.resampled(docs, bench, percent=40, least_words=5).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    # repeated rows share a score, so which of them has the lower rank is open
    assert known(tuple(r) for r in got.collect()) == known(want)


def test_resampling_of_empty_tables_and_clashing_names(spark, odd, empty):
    bench = spark.createDataFrame([("one two",)], "text string")
    assert importance.resampled(empty, bench).count() == 0
    clash = odd.withColumnsRenamed({"key": "weight", "component": "Rank", "n": "stream"})
    got = importance.resampled(clash, bench.where("false"), percent=100, least_words=0)
    assert sorted(r.rank for r in got.collect()) == list(range(1, 13))
    assert importance.drawn(clash, got).columns == clash.columns


def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = catalog.QUERIES["op12_importance_resampling"](spark, SF)
    assert got.dtypes[:5] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = [(i, f, w, s, k) for i, _, f, w, s, k in plain_resampled(docs, bench, 5, 20)]
    assert known(tuple(r)[:5] for r in got.collect()) == known(want) and sum(x[4] is not None for x in want) > 5


# ------------------------------------------------------------------ collocations


def plain_collocations(docs, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        for g, a in cand.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) and 100 * b >= covered * a for h, b in cand.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return out


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("stretch", "block", "held", "fan"), [(1000, 500_000, 200_000, 1024), (7, 500, 3, 3)])
def test_collocations_of_made_up_texts(spark, monkeypatch, stretch, block, held, fan):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "FAN", fan)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 50_000 // fan)
    monkeypatch.setattr(phrases, "HELD_PIECES", held)
    cut = phrases.stretches
    monkeypatch.setattr(phrases, "stretches", lambda text, longest: cut(text, longest, stretch))
    rng = random.Random(11)
    words = "a B b c New York City É 'x' \x1cz \x85 的".split(" ")
    docs = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    docs += [("en", None), ("en", ""), (None, " . "), ("fr", "one two " * 1500), ("fr", "one two " * 1500)]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"gram": F.lit("x"), "n": F.lit(1)})
    for least, covered, top in ((3, 50, 10), (10, 80, None)):
        assert collected(phrases.collocations(df, least=least, covered=covered, top=top)) == sorted(plain_collocations(docs, least, covered, top))


def test_collocations_of_odd_rows(odd, empty):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = [(None, r.text) for r in docs.collect()]
    assert collected(phrases.collocations(docs, least=2)) == sorted(plain_collocations(rows, 2, 50, 2000))
    assert phrases.collocations(empty.withColumn("lang", F.lit("x"))).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts whose products no long holds."""
    many = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "", 9 * many), ("en", "a", 3 * many + 1), ("en", "b", 2 * many), ("en", "a b", many)], "lang string, gram string, n long")
    monkeypatch.setattr(phrases, "grams", lambda *_: counts)
    docs = spark.createDataFrame([("en", "x")], "lang string, text string")
    assert collected(phrases.collocations(docs)) == [("en", 1, "a b", many, 3 * many + 1, 2 * many, 9 * many, 1000000 * many * many // ((3 * many + 1) * 2 * many))]
