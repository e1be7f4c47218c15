"""Documents drawn by the importance of their hashed n-grams for a target."""

from __future__ import annotations

import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_CRC, SQL_CRC_TABLES, numbered, table, text_batches, written
from .decontam import words

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
#: Features of one block of a bucket stream, or those of one document.
BLOCK = 2_000_000


def buckets(found: list[bytes], n: int = BUCKETS) -> np.ndarray:
    """uint16 bucket of every run of one to three words: the CRC-32 of its bytes modulo ``n``. A longer run's checksum
    goes on from that of the run it begins with."""
    one = list(map(crc32, found))
    more = [b" " + w for w in found[1:]]
    two = list(map(crc32, more, one))
    three = list(map(crc32, more[1:], two))
    return (np.fromiter(chain(one, two, three), np.uint32, len(one) + len(two) + len(three)) % np.uint32(n)).astype("<u2")


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BUCKETS) -> DataFrame:
    """Blocks of documents, written: ids, n_words, ends (where each document's features end) and stream, their buckets
    as packed unsigned 16-bit integers. A block ends after BLOCK features; a longer document is one of its own."""
    kind = dict(docs.dtypes)[id_col]
    text_batches(docs.sparkSession)

    def run(batches):
        ids, n_words, ends, parts, size = [], [], [], [], 0
        id_type = pa.null()

        def flush():
            nonlocal ids, n_words, ends, parts, size
            cols = [pa.array([ids], pa.list_(id_type)), pa.array([n_words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())]
            ids, n_words, ends, parts, size = [], [], [], [], 0
            return pa.RecordBatch.from_arrays(cols, names=["ids", "n_words", "ends", "stream"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = words(text.as_py())
                got = buckets(own, n)
                if ids and size + len(got) > BLOCK:
                    yield flush()
                size += len(got)
                ids.append(i)
                n_words.append(len(own))
                ends.append(size)
                parts.append(got.tobytes())
        if ids:
            yield flush()

    return written(docs.select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, n_words array<long>, ends array<long>, stream binary"), "buckets")


def counted(blocks: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in the streams. A task sorts its blocks one by one and run-length encodes them; its
    sums, at most ``n`` rows, go on to a sum by bucket."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            for stream in b.column(0):
                s = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")
                at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
                total[s[at]] += np.diff(np.append(at, len(s)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(n, np.int64)
    for r in blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's share in the target over its share in the documents), each count raised by one."""
    n = len(raw)
    S, T = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * S / ((s + 1.0) * T))) for s, t in zip(raw.tolist(), target.tolist())], np.int32)


def weights(blocks: DataFrame, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_features, weight: the sum of the gains of each document's features, 0 without any."""
    kind = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]

    def run(batches):
        for b in batches:
            for ids, n_words, ends, stream in zip(*(b.column(k) for k in range(4))):
                s, end = np.frombuffer(stream.as_buffer(), "<u2"), ends.values.to_numpy()
                start = np.append(0, end[:-1])
                weight, some = np.zeros(len(end), np.int64), np.flatnonzero(end > start)
                if len(s) > BLOCK:  # one long document
                    weight[some] = sum(int(gain[s[i : i + BLOCK]].sum(dtype=np.int64)) for i in range(0, len(s), BLOCK))
                elif len(some):  # where two starts are equal, reduceat gives an element and no empty sum
                    weight[some] = np.add.reduceat(gain[s], start[some], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(end - start), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])

    return blocks.select("ids", "n_words", "ends", "stream").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel variable that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", seed: int = SEED, n: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document: rank is 1, 2, .. by score, ties to the smaller
    id, for the ``percent`` of the documents with ``least_words`` words or more that are drawn without replacement,
    and null for all others.

    Texts are read once: each task writes its documents' buckets as packed streams. Counts come from sorting the
    streams block by block, weights from gathering gains along them. The driver gets ``n`` counts of each side.
    Ranks come from a sort in ranges (``numbered``); no task sees more than a range.

    Null and empty texts have no features and weight 0; a null id counts as the empty string where noise is drawn and
    comes first among equals; repeated rows are documents of their own; an empty table gives an empty result, an empty
    target gains of its own smoothing."""
    if not 0 < n <= 1 << 16:
        raise ValueError("buckets are unsigned 16-bit integers")
    blocks = streams(docs, id_col, text_col, n)
    aim = streams(target.withColumn("_no", F.lit(0)), "_no", target_text, n)
    gain = gains(counted(blocks, n), counted(aim, n))
    scored = written(weights(blocks, gain, id_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "weights")
    fit = F.col("n_words") >= least_words
    draw = percent * scored.where(fit).count() // 100
    rank = F.when(fit & (F.col("_row") < draw), F.col("_row") + 1)
    return numbered(scored, [fit.desc(), F.col("score").desc(), F.col(id_col)], "_row", "ranks").withColumn("rank", rank).drop("_row")


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, that ``resampled`` drew."""
    return docs.join(ranks.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


OP12_SQL = rf"""
WITH RECURSIVE {SQL_CRC_TABLES},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
a AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_concat([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]))) AS g FROM (SELECT r, w FROM d UNION ALL SELECT -1, w FROM a)),
u AS (SELECT g, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM f GROUP BY g),
b AS (SELECT g, s, u.t AS t, {SQL_CRC} % 10000 AS k FROM (SELECT *, hex(encode(g)) AS h FROM u) u, tab),
k AS (SELECT k, sum(s) AS s, sum(t) AS t FROM b GROUP BY k),
n AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM k),
w AS (SELECT k, floor(1000 * ln((k.t + 1)::DOUBLE * (n.all_s + 10000)::DOUBLE / ((k.s + 1)::DOUBLE * (n.all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM k, n),
x AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (g) JOIN w USING (k) WHERE r > 0 GROUP BY r),
y AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || doc_id)[1:8])::UBIGINT::DOUBLE AS h FROM d LEFT JOIN x ON d.r = x.r),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_words >= 20 AS fit FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS i, 5 * count(*) OVER (PARTITION BY fit) // 100 AS most FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND i <= most THEN i END AS rank, n_words FROM o"""
