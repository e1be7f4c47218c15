"""Stupid-backoff language-model scores of all documents, each by the n-grams of all others."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_batches, written

ORDER = 3
BACKOFF = 0.4
#: A block of documents holds so many words, or one document.
BLOCK_WORDS = 400_000
#: Distinct n-grams that one part of the count tables is to hold.
PART_GRAMS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


#: Bits of a hash that the first round leaves out.
_SHORT = np.uint64(24)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words. (A table of known words would cost more than it saves: most are rare.)"""
    words = _words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each word; where there are fewer it holds anything."""
    h = words * _MIX[0] + _MIX[n]
    for k in range(1, n):
        h[k:] = (h[k:] ^ (h[k:] >> np.uint64(29))) * _MIX[3] + words[: len(words) - k] * _MIX[k % 3]
    h ^= h >> np.uint64(32)
    h *= _MIX[4]
    return h ^ (h >> np.uint64(29))


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte plane, compressed."""
    d = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze_counts(c: np.ndarray) -> bytes:
    wide = c.astype(np.uint8 if not len(c) or c.max() < 256 else np.uint32 if c.max() < 2**32 else np.uint64)
    return bytes([wide.itemsize]) + zstandard.ZstdCompressor(level=1).compress(wide.tobytes())


def unsqueeze_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class Block:
    """The words of some documents, with the distinct n-grams of each order in hash order and their counts; with
    ``places``, also where they stand."""

    def __init__(self, docs: list[np.ndarray], order: int, places: bool = False):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        words = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.place = np.arange(len(words)) - first[self.doc] if len(words) else np.zeros(0, np.int64)
        self.grams, self.counts, self.at, self.own = [], [], [], []
        for n in range(1, order + 1):
            ends = np.flatnonzero(self.place >= n - 1)
            g = grams(words, n)[ends]
            if not places:
                u, count = np.unique(g, return_counts=True)
            else:
                # one stable sort: equal n-grams meet, in the order of their documents
                o = np.argsort(g, kind="stable")
                g, doc = g[o], self.doc[ends[o]]
                new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
                u, count = g[new], np.diff(np.append(np.flatnonzero(new), len(g)))
                at = np.full(len(words), -1, np.int64)
                at[ends[o]] = np.cumsum(new) - 1
                self.at.append(at)
                # how often the n-gram that ends here stands in this document
                pair = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(g)]
                times = np.diff(np.append(np.flatnonzero(pair), len(g)))
                own = np.zeros(len(words), np.int64)
                own[ends[o]] = np.repeat(times, times)
                self.own.append(own)
            self.grams.append(u)
            self.counts.append(count)

    def scores(self, totals: list[np.ndarray], n_words: int, backoff: float) -> np.ndarray:
        """Mean natural log of the scores of a document's words; 0 for one without words."""
        order = len(totals)
        here = [np.where(at >= 0, t[at] - own, 0) if len(t) else np.zeros(len(at), np.int64) for t, at, own in zip(totals, self.at, self.own)]
        rest = np.maximum(n_words - self.sizes[self.doc], 1).astype(np.float64)
        value = (order - 1) * math.log(backoff) + np.log(np.maximum(here[0], 0.5)) - np.log(rest)
        # a word early in its document has fewer words before it and so backs off less often
        value -= np.maximum(order - 1 - self.place, 0) * math.log(backoff)
        for n in range(2, order + 1):
            hit = np.flatnonzero(here[n - 1] > 0)
            context = here[n - 2][hit - 1] + 0.0
            # the context's count without this document: the n-1 words before this one, wherever they end
            steps = np.minimum(order - n, np.maximum(self.place[hit] - (n - 1), 0))
            value[hit] = steps * math.log(backoff) + np.log(here[n - 1][hit]) - np.log(np.maximum(context, here[n - 1][hit]))
        sums = np.bincount(self.doc, value, len(self.sizes)) if len(value) else np.zeros(len(self.sizes))
        return np.where(self.sizes > 0, sums / np.maximum(self.sizes, 1), 0.0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """id, n_words long, score double: the mean log stupid-backoff score of a document's words under the n-gram
    counts of all other documents; 0 for null or empty texts.

    For word c after a, b: c(abc) / c(ab) if abc stands in another document, else ``backoff`` times c(bc) / c(b),
    else ``backoff`` squared times c(c) / N, where a word of no other document counts half. All counts leave out
    the document itself. Repeated rows are documents of their own, a null id is kept, other columns are dropped, and an
    empty table gives an empty result.

    The documents become blocks. A block sends its distinct n-grams, exploded and counted, to the parts of the
    count tables, which are split by hash. It first sends the upper 40 bits of their hashes: a part answers which
    stand in another block too, and the counts of all others are complete as they are. The block then sends those
    that may be shared, whole and with counts; the parts add them up, join the sums to each block's n-grams, and
    send them back; and the block sums its documents. So a frequent n-gram is one entry per block, no part or block
    holds more than its share, and words travel as hashes of 64 bits."""
    spark = docs.sparkSession
    text_batches(spark)
    kind = dict(docs.dtypes)[id_col]

    def blocks(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, texts, n, id_type = [], [], 0, pa.null()
        squeezed = zstandard.ZstdCompressor(level=3)

        def flush():
            nonlocal held, texts, n, seq
            out = pa.RecordBatch.from_arrays([pa.array([f"{part}-{seq}"]), pa.array([n], pa.int64()), pa.array([held], pa.list_(id_type)), pa.array([squeezed.compress(_pack(texts))], pa.binary())], names=["block", "words", "ids", "texts"])
            held, texts, n, seq = [], [], 0, seq + 1
            lean()
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n += len(_words(t))
                held.append(i)  # ids as objects, so that the batch they came in can go
                texts.append(t or "")
                if n >= BLOCK_WORDS:
                    yield flush()
        if texts:
            yield flush()

    table_ = written(docs.select(id_col, text_col).mapInArrow(blocks, f"block string, words long, ids array<{kind}>, texts binary"), "lm-blocks")
    n_words = int(table_.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    n_parts = max(1, -(-n_words * order // PART_GRAMS))

    def block_of(data: bytes, places: bool = False) -> Block:
        return Block([word_hashes(t) for t in _unpack(zstandard.ZstdDecompressor().decompress(data))], order, places)

    def sent(name: str, n: int, values: np.ndarray, edges: np.ndarray, counts: np.ndarray | None):
        for p in range(n_parts):
            a, z = edges[p], edges[p + 1]
            if a < z:
                yield p, name, n, squeeze(values[a:z]), squeeze_counts(counts[a:z]) if counts is not None else b""

    def rows(found) -> pa.Table:
        cols = list(zip(*found)) or [[]] * 5
        return pa.table({"part": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.string()), "n": pa.array(cols[2], pa.int32()), "grams": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})

    grams_schema = "part int, block string, n int, grams binary, counts binary"

    def exploded(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                lean()
                block = block_of(data.as_py())
                for n in range(order):
                    u = block.grams[n]
                    yield from rows(sent(name, n, u >> _SHORT, np.searchsorted(u, _edges(n_parts)), None)).to_batches()

    def gathered(t: pa.Table, n: int) -> tuple[list, np.ndarray, list]:
        own = [(b, unsqueeze(g), c) for b, m, g, c in zip(*(t.column(k).to_pylist() for k in ("block", "n", "grams", "counts"))) if m == n]
        return [(b, len(g)) for b, g, _ in own], np.concatenate([g for _, g, _ in own]) if own else np.zeros(0, np.uint64), [c for _, _, c in own]

    def met_twice(t: pa.Table) -> pa.Table:
        lean()
        out, p = [], t.column("part")[0].as_py()
        for n in range(order):
            names, values, _ = gathered(t, n)
            order_ = np.argsort(values, kind="stable")
            v = values[order_]
            same = np.append(v[1:] == v[:-1], False)
            shared = np.empty(len(v), bool)
            shared[order_] = same | np.concatenate([[False], same[:-1]])[: len(v)]
            at = 0
            for b, size in names:
                out.append((p, b, n, np.packbits(shared[at : at + size]).tobytes(), size.to_bytes(8, "little")))
                at += size
        return rows(out)

    masks = written(table_.select("block", "texts").mapInArrow(exploded, grams_schema).groupBy("part").applyInArrow(met_twice, grams_schema), "lm-masks")

    def mask_of(right: pa.Table) -> list[np.ndarray]:
        got: list[list] = [[] for _ in range(order)]
        for _, n, bits, size in sorted(zip(*(right.column(k).to_pylist() for k in ("part", "n", "grams", "counts")))):
            got[n].append(np.unpackbits(np.frombuffer(bits, np.uint8))[: int.from_bytes(size, "little")].astype(bool))
        return [np.concatenate(x) if x else np.zeros(0, bool) for x in got]

    def shared_only(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        found = []
        for name, data in zip(left.column("block").to_pylist(), left.column("texts")):
            block = block_of(data.as_py())
            for n, mask in enumerate(mask_of(right)):
                u = block.grams[n][mask]
                found += sent(name, n, u, np.searchsorted(u, _edges(n_parts)), block.counts[n][mask])
        return rows(found)

    keyed = table_.select("block", "texts").groupBy("block")

    def counted(t: pa.Table) -> pa.Table:
        lean()
        out, p = [], t.column("part")[0].as_py()
        for n in range(order):
            names, values, counts = gathered(t, n)
            if not names:
                continue
            _, inverse = np.unique(values, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([unsqueeze_counts(c) for c in counts])).astype(np.int64)[inverse]
            at = 0
            for b, size in names:
                out.append((p, b, n, b"", squeeze_counts(total[at : at + size])))
                at += size
        return rows(out)

    totals = written(keyed.cogroup(masks.groupBy("block")).applyInArrow(shared_only, grams_schema).groupBy("part").applyInArrow(counted, grams_schema), "lm-counts")
    answers = masks.withColumn("kind", F.lit(0)).union(totals.withColumn("kind", F.lit(1)))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        rows = []
        kinds = np.array(right.column("kind").to_pylist(), np.int64)
        masks, sums = (right.filter(pa.array(kinds == k)) for k in (0, 1))
        for ids, data in zip(left.column("ids"), left.column("texts")):
            block = block_of(data.as_py(), places=True)
            got: list[list] = [[] for _ in range(order)]
            for _, n, c in sorted(zip(*(sums.column(k).to_pylist() for k in ("part", "n", "counts")))):
                got[n].append(unsqueeze_counts(c))
            totals = []
            for n, mask in enumerate(mask_of(masks)):
                total = block.counts[n].astype(np.int64)
                if got[n]:
                    total[mask] = np.concatenate(got[n])
                totals.append(total)
            rows.append(pa.table({id_col: ids.values, "n_words": pa.array(block.sizes), "score": pa.array(block.scores(totals, n_words, backoff))}))
        return pa.concat_tables(rows)

    return table_.select("block", "ids", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, f"`{id_col}` {kind}, n_words long, score double")


def _edges(parts: int) -> np.ndarray:
    """First hash of each part, and a last one."""
    return np.append(np.array([(p << 64) // parts for p in range(parts)], np.uint64), np.uint64(2**64 - 1))


def _pack(texts: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    t = pa.record_batch([pa.array(texts, pa.large_string())], names=["t"])
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> list[str]:
    return pa.ipc.open_stream(data).read_all().column(0).to_pylist()


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT c, count(*) AS k FROM t GROUP BY 1), uo AS (SELECT r, c, count(*) AS k FROM t GROUP BY 1, 2),
bi AS (SELECT b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY 1, 2), bo AS (SELECT r, b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY 1, 2, 3),
tr AS (SELECT a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3), tro AS (SELECT r, a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3, 4),
j AS (SELECT t.r, t.i, u.k - uo.k AS c1, coalesce(bi.k - bo.k, 0) AS c2, coalesce(tr.k - tro.k, 0) AS c3, coalesce(ub.k - uob.k, 0) AS x1, coalesce(bx.k - box.k, 0) AS x2
      FROM t JOIN u ON t.c = u.c JOIN uo ON t.c = uo.c AND t.r = uo.r
      LEFT JOIN bi ON t.b = bi.b AND t.c = bi.c LEFT JOIN bo ON t.r = bo.r AND t.b = bo.b AND t.c = bo.c
      LEFT JOIN tr ON t.a = tr.a AND t.b = tr.b AND t.c = tr.c LEFT JOIN tro ON t.r = tro.r AND t.a = tro.a AND t.b = tro.b AND t.c = tro.c
      LEFT JOIN u ub ON t.b = ub.c LEFT JOIN uo uob ON t.b = uob.c AND t.r = uob.r
      LEFT JOIN bi bx ON t.a = bx.b AND t.b = bx.c LEFT JOIN bo box ON t.r = box.r AND t.a = box.b AND t.b = box.c),
s AS (SELECT j.r, sum(CASE WHEN c3 > 0 THEN ln(c3) - ln(greatest(x2, c3))
      WHEN c2 > 0 THEN CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + ln(c2) - ln(greatest(x1, c2))
      ELSE least(i - 1, 2) * ln(0.4) + ln(greatest(c1, 0.5)) - ln(greatest(n.n - len(d.w), 1)) END) / any_value(len(d.w)) AS score
      FROM j JOIN d ON j.r = d.r, n GROUP BY j.r)
SELECT d.doc_id, len(d.w) AS n_words, round(coalesce(s.score, 0.0), 6) AS score FROM d LEFT JOIN s ON d.r = s.r"""
