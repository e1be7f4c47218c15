"""Benchmark decontamination by an FM-index of each training shard."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, text_batches, written
from .fmindex import FMIndex

#: A shard is indexed once it holds so many words that can be part of a test phrase.
SHARD_WORDS = 1_000_000
#: ... or so many documents, or bytes of them, which bounds what a worker holds.
SHARD_DOCS, SHARD_BYTES = 20_000, 128 << 20
#: Test items are searched in blocks of at most so many bytes of text; a block is what is broadcast.
BLOCK_BYTES = 8_000_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z are lower-cased, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Phrases:
    """Windows of a block of test items: distinct sequences of word numbers (1 up), and the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
            for j in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[j : j + width]), set()).add(k)
        self.vocab = vocab
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), width), np.int64)
        for r, w in enumerate(windows):
            self.patterns[r, width - len(w) :] = w
        counts = [len(x) for x in windows.values()]
        self.item_start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.item_of = np.array([k for x in windows.values() for k in sorted(x)], np.int64)
        self.shortest = int(self.lengths.min()) if len(windows) else 0

    def find(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[str]]]:
        """docs: word numbers of each document, 0 for words of no item. Returns each document's removal spans
        (start, end in words, merged) and the items with a window in it."""
        spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(docs)
        items: list[list[str]] = [[]] * len(docs)
        runs, where_doc, where_word = [], [], []
        for d, ids in enumerate(docs):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= self.shortest:
                    runs.append(np.append(ids[a:b], 0))
                    where_doc.append(np.full(b - a + 1, d, np.int64))
                    where_word.append(np.arange(a, b + 1))
        if not runs:
            return spans, items
        s, at_doc, at_word = np.concatenate(runs), np.concatenate(where_doc), np.concatenate(where_word)
        index = FMIndex(s, len(self.vocab) + 1)
        lo, hi = index.search(self.patterns, self.lengths)
        n = hi - lo
        if not n.sum():
            return spans, items
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        pos = index.locate(rows)
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + self.lengths[phrase], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        both = np.stack([at_word[a], at_word[b - 1] + 1], 1)
        cut = np.flatnonzero(np.diff(at_doc[a])) + 1
        for d, own in zip(at_doc[a[np.r_[0, cut]]].tolist(), np.split(both, cut)):
            spans[d] = own
        pairs = np.unique(at_doc[pos] * len(n) + phrase)
        for key in pairs.tolist():
            d, p = divmod(key, len(n))
            items[d] = items[d] + [self.items[k] for k in self.item_of[self.item_start[p] : self.item_start[p + 1]]]
        return spans, [sorted(set(x)) for x in items]


def blocks(bench: DataFrame, id_col: str, text_col: str, most: int):
    """Items as lists of at most ``most`` bytes of text each, read from the executors part by part."""
    part: list[tuple[str, str]] = []
    held = 0
    for i, t in bench.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if t is None:
            continue
        size = len(t.encode("utf-8", "surrogatepass"))
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append((i or "", t))
        held += size
    if part:
        yield part


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus _n_words long, _spans array<struct<start,stop>> (merged removal spans, in
    words) and _items array<string> (items with a window in the document, sorted as strings).

    A window is ``width`` consecutive words of an item, or all of a shorter one. Each task indexes its documents
    in shards of bounded size; only maximal runs of words that items have are indexed, as no phrase can occur
    elsewhere. The documents are not shuffled. Items are taken in blocks of bounded size, each searched in all
    documents; there is one broadcast at a time, as the result of all blocks but the last is written before the next
    one is read. Null and empty texts have no words; items with null text are ignored and a null item id counts as
    the empty string; repeated rows are judged one by one; empty tables give no spans. Columns of ``docs`` that are
    named like the added ones give way to them."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = plain(docs, "_n_words", "_spans", "_items")
    keep = docs.columns
    kinds = dict(docs.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", _n_words long, _spans array<struct<start:long,stop:long>>, _items array<string>"
    df = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<struct<start:long,stop:long>>"), "_items": F.array().cast("array<string>")})
    items = blocks(bench, item_col, item_text, block_bytes)
    paths: list[str] = []
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    at = keep.index(text_col)

    part = next(items, [])
    while part is not None:
        one = spark.sparkContext.broadcast(Phrases(part, width))

        def search(batches, one=one):
            phrases: Phrases = one.value
            get = phrases.vocab.get
            held, ids, n_words, full, size = [], [], [], 0, 0

            def flush():
                spans, items = phrases.find(ids)
                k = 0
                for b in held:
                    m = b.num_rows
                    old_spans, old_items = b.column(len(keep) + 1).to_pylist(), b.column(len(keep) + 2).to_pylist()
                    merged = [merge([(x["start"], x["stop"]) for x in o] + s.tolist()) for o, s in zip(old_spans, spans[k : k + m])]
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[: len(keep)], pa.array(n_words[k : k + m], pa.int64()), pa.array([[{"start": x, "stop": y} for x, y in r] for r in merged], span_type), pa.array([sorted({*o, *x}) for o, x in zip(old_items, items[k : k + m])], pa.list_(pa.string()))],
                        names=[*keep, "_n_words", "_spans", "_items"],
                    )
                    k += m

            for b in batches:
                for text in b.column(at).to_pylist():
                    found = words(text)
                    n_words.append(len(found))
                    x = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
                    full += np.count_nonzero(x)
                    ids.append(x if x.any() else x[:0])
                held.append(b)
                size += b.nbytes
                if full >= SHARD_WORDS or len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield from flush()
                    held, ids, n_words, full, size = [], [], [], 0, 0
            if held:
                yield from flush()

        df = df.mapInArrow(search, out)
        part = next(items, None)
        if part is not None:
            df = written(df, "decontaminated", paths)
            one.destroy()
    return df


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def n_hit() -> F.Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> F.Column:
    """More than none, and at least a twentieth, of the words are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("_n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP3_SQL = r"""
WITH lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.k, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r"""
