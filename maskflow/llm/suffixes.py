"""Repeated byte strings by suffix arrays of content-routed shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, lean, table, text_batches, written

LENGTH = 400
#: Bytes of the windows whose least hash routes a string; a power of two below LENGTH.
GRAM = 64
#: Bytes of text that a shard aims at.
SHARD_BYTES = 500_000

#: Alphabets up to this size have buckets worth moving as a whole.
SMALL_ALPHABET = 300

# ------------------------------------------------------------------ suffix sorting


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one, a sentinel, is."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    nxt = np.searchsorted(change, np.arange(n - 1))
    up = np.concatenate([s[change] < s[change + 1], [True]])
    return np.append(up[nxt], True)


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of s from its leftmost-smaller (LMS) positions in order: two linear scans over the buckets, in
    which all entries of a bucket that are known at once move together."""
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    count_l = np.bincount(s[~is_s], minlength=sigma)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    head, l_end, tail = begin.copy(), begin + count_l, begin + count
    sa = np.full(n, -1, np.int64)
    order = np.argsort(s[lms], kind="stable")
    by_char = np.searchsorted(s[lms][order], np.arange(sigma + 1))
    symbols = np.flatnonzero(count).tolist()

    def move(e, want_s):
        p = e[e > 0] - 1
        p = p[is_s[p] == want_s]
        if not p.size:
            return
        t = s[p]
        o = np.argsort(t, kind="stable")
        p, t = p[o], t[o]
        cut = np.flatnonzero(np.diff(t)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(p)]):
            c = t[a]
            if want_s:
                sa[tail[c] - (b - a) : tail[c]] = p[a:b][::-1]
                tail[c] -= b - a
            else:
                sa[head[c] : head[c] + b - a] = p[a:b]
                head[c] += b - a

    for c in symbols:
        at = begin[c]
        while at < head[c]:
            at, e = head[c], sa[at : head[c]].copy()
            move(e, False)
        move(lms[order[by_char[c] : by_char[c + 1]]], False)
    sa[tail[s[n - 1]] - 1] = n - 1  # the sentinel
    for c in reversed(symbols):
        at = begin[c] + count[c]
        if c == s[n - 1]:
            tail[c] -= 1
        while at > tail[c]:
            at, e = tail[c], sa[tail[c] : at][::-1].copy()
            move(e, True)
        move(sa[begin[c] : l_end[c]][::-1].copy(), True)
    return sa


def _induce_singly(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same for a large alphabet, whose buckets are too small to move entries together: entry by entry."""
    n = len(s)
    begin = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
    # the symbol before each place if it is of the wanted type, else -1; place n stands for an empty entry
    before = np.concatenate([[-1], s[:-1], [-1]])
    to_l = np.where(np.concatenate([[False], ~is_s[:-1], [False]]), before, -1).tolist()
    to_s = np.where(np.concatenate([[False], is_s[:-1], [False]]), before, -1).tolist()
    sa = np.full(n, n, np.int64)
    order = np.argsort(s[lms], kind="stable")
    put = s[lms][order]
    last = np.searchsorted(put, put, side="right")
    sa[begin[put + 1] - last + np.arange(len(put))] = lms[order]
    sa, head, tail = sa.tolist(), begin[:-1].tolist(), begin[1:].tolist()
    for i in sa:
        if (c := to_l[i]) >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    for i in reversed(sa):
        if (c := to_s[i]) >= 0:
            at = tail[c] - 1
            sa[at] = i - 1
            tail[c] = at
    return np.array(sa, np.int64)


def _names_induced(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Names of the LMS substrings, in their order: sorted by one induction, neighbours compared."""
    n = len(s)
    sa = _induce(s, is_s, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = sa[is_lms[sa]]
    end = np.full(n, n - 1, np.int64)
    end[lms[:-1]] = lms[1:]
    a, b = sorted_lms[:-1], sorted_lms[1:]
    la, lb = end[a] - a, end[b] - b
    same = la == lb
    live, j = np.flatnonzero(same), 0
    while live.size:
        live = live[j <= la[live]]
        ok = s[a[live] + j] == s[b[live] + j]
        same[live[~ok]] = False
        live, j = live[ok], j + 1
    name = np.empty(n, np.int64)
    name[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _names_by_symbols(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same where the alphabet is large and so the substrings are short: ties are sorted symbol by symbol, of
    equal symbols the one of a larger suffix type later. Tied substrings have the same types, so they end at once."""
    symbol = 2 * s.astype(np.int64) + is_s
    rest = np.append(np.diff(lms), 0)
    name, live, j = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while live.size:
        key, group = symbol[lms[live] + j], name[live]
        o = np.lexsort((key, group))
        live, key, group = live[o], key[o], group[o]
        top = np.r_[True, group[1:] != group[:-1]]
        new = top | np.r_[True, key[1:] != key[:-1]]
        pos = np.arange(len(live))
        name[live] = group + np.maximum.accumulate(np.where(new, pos, 0)) - np.maximum.accumulate(np.where(top, pos, 0))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(live)))
        live = live[(np.repeat(size, size) > 1) & (rest[live] > j)]
        j += 1
    return np.unique(name, return_inverse=True)[1]


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array by induced sorting. s ends with 0, which stands nowhere else.

    Suffixes are classified; LMS substrings are sorted and named; the string of names, of at most half the length, is
    sorted in the same way unless all names differ; then the whole array is induced."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = sigma <= SMALL_ALPHABET
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order = np.arange(len(lms))
    if len(lms) > 1:
        reduced = _names_induced(s, is_s, lms, sigma) if small else _names_by_symbols(s, is_s, lms)
        names = int(reduced.max()) + 1
        if names == len(lms):
            order[reduced] = np.arange(len(lms))
        else:
            order = suffix_array(reduced, names)
    return (_induce if small else _induce_singly)(s, is_s, lms[order], sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in sa, by text position. A value is one less than
    that of the position before where the symbols before both suffixes agree; only the others are compared, four
    symbols at a time."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    own = (phi <= 0) | (pos == 0)
    own |= s[pos - 1] != s[np.maximum(phi, 1) - 1]
    padded = np.concatenate([s.astype(np.uint16), np.zeros(8, np.uint16)])
    four = np.zeros(n + 4, np.uint64)
    for k in range(4):
        four |= padded[k : k + n + 4].astype(np.uint64) << np.uint64(16 * k)
    lcp = np.zeros(n, np.int64)
    p = np.flatnonzero(own & (phi >= 0))
    q, k = phi[p], 0
    live = np.arange(len(p))
    while live.size:
        live = live[(p[live] + k < n) & (q[live] + k < n)]
        x = four[p[live] + k] ^ four[q[live] + k]
        done = x != 0
        low = x[done] & (~x[done] + np.uint64(1))
        lcp[p[live[done]]] = k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 16
        live, k = live[~done], k + 4
    last = np.maximum.accumulate(np.where(own, pos, 0))
    return np.where(phi < 0, 0, np.maximum(lcp[last] - (pos - last), 0))


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its places start a ``length``-byte string that starts anywhere else in the strings
    too."""
    # one number above each byte, with 1 between strings and 0 at the end; comparisons of 400 bytes that pass a
    # border have no place that counts
    parts = []
    for x in strings:
        parts += [np.frombuffer(x, np.uint8).astype(np.int16) + 2, np.ones(1, np.int16)]
    s = np.concatenate([*parts, np.zeros(1, np.int16)])
    sa = suffix_array(s, 258)
    plcp = permuted_lcp(s, sa)
    at = plcp[sa]
    hit = np.zeros(len(s), bool)
    far = np.flatnonzero(at >= length)
    hit[sa[far]] = True
    hit[sa[far - 1]] = True
    out, k = [], 0
    for x in strings:
        out.append(hit[k : k + max(0, len(x) - length + 1)])
        k += len(x) + 1
    return out


# ------------------------------------------------------------------ routing


def routes(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places whose ``length``-byte strings have one least gram hash: (hash, first place, places, how often
    that hash stands in the run). Equal strings have equal hashes, so they meet where their hash goes."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    h = byte_hashes(x, gram)
    w, step, low = length - gram + 1, 1, h
    while step * 2 <= w:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    n = len(x) - length + 1
    low = np.minimum(low[:n], low[w - step : w - step + n])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[first, n])
    value = low[first]
    # a gram is selected if it is the least of some window: then the largest least hash about it is its own
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    step, high = 1, padded
    while step * 2 <= w:
        high = np.maximum(high[: len(high) - step], high[step:])
        step *= 2
    high = np.maximum(high[: len(h)], high[w - step : w - step + len(h)])
    chosen = np.flatnonzero(high == h)
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, first + size - 1 + w)
    run = np.repeat(np.arange(len(first)), b - a)
    at = np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    places = np.bincount(run, h[chosen[at]] == value[run], len(first)).astype(np.int64)
    return value, first, size, places


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 per document: bytes covered by a ``length``-byte string that
    starts anywhere else (in any document, the same one included) are removed; matches never cross documents.

    Null text counts as empty. Texts shorter than ``length`` stay whole. Repeated rows are documents of their own
    and so repeat each other. Other columns are dropped; an empty table gives an empty result.

    Equal texts become one with its number of copies; one of several copies that is long enough is removed whole,
    but still stands for the others. Each text is split into runs of places whose strings share their least gram
    hash; only hashes that stand in two places can repeat. Their runs (with the bytes that the strings need) go to
    shards by hash, equal runs as one; a shard sorts its suffixes and reads repeats off the permuted common
    prefixes. Spans come back by text. Texts travel only by id, to the runs that need them, never by hash alone, so
    a text with many copies is no hot key there."""
    spark = docs.sparkSession
    text_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["id"]
    keyed = d.select("id", F.unhex(F.md5("text")).alias("t"), "text")

    def sketched(batches):
        for b in batches:
            lean()
            n_bytes, shas, runs = [], [], []
            for text in b.column(2).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                n_bytes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
                runs.append(routes(data, length))
            ends = np.cumsum([0, *(len(r[0]) for r in runs)]).astype(np.int32)
            parts = [np.concatenate([r[k] for r in runs]) for k in range(4)] if runs else [np.zeros(0, np.int64)] * 4
            kinds = [np.int64, np.int32, np.int32, np.int32]
            fields = pa.StructArray.from_arrays([pa.array(x.view(np.int64).astype(y)) for x, y in zip(parts, kinds)], names=["m", "at", "n", "k"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_bytes, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends), fields)], names=["id", "t", "n_bytes", "sha", "runs"])

    sketch = written(keyed.mapInArrow(sketched, f"id {kind}, t binary, n_bytes long, sha string, runs array<struct<m:long,at:int,n:int,k:int>>"), "sketch")
    # one document stands for each text; a null id only where there is no other
    texts = written(sketch.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")), "texts")
    stands = texts.where(F.col("n_bytes") >= length).select(F.col("t").alias("t2"), F.col("id").alias("id2"), "copies")
    on = (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("id2"))
    runs = sketch.select("id", "t", "runs").join(stands, on).dropDuplicates(["t"]).select("t", "id", "copies", F.explode("runs").alias("r")).select("t", "id", "copies", "r.*")
    runs = written(runs, "runs")
    twice = runs.groupBy("m").agg(F.sum("k").alias("k")).where("k > 1").select("m")
    needed = runs.join(twice, "m", "left_semi")
    by_text = needed.groupBy("t", "id").agg(F.collect_list(F.struct("m", "at", "n")).alias("want")).select(F.col("t").alias("t2"), F.col("id").alias("id2"), "want")
    by_text = written(by_text, "wanted")
    bytes_there = by_text.select(F.coalesce(F.sum(F.aggregate("want", F.lit(0).cast("long"), lambda a, w: a + w["n"] + length)), F.lit(0))).first()[0]
    shards = max(1, -(-int(bytes_there) // shard_bytes))

    def cut(batches):
        for b in batches:
            lean()
            m_, sh, t_, at_, sub = [], [], [], [], []
            for t, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for w in want:
                    m_.append(w["m"])
                    sh.append(((w["m"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * shards) >> 64)  # least hashes are small
                    t_.append(t)
                    at_.append(w["at"])
                    sub.append(data[w["at"] : w["at"] + w["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(sh, pa.int32()), pa.array(t_, pa.binary()), pa.array(at_, pa.int32()), pa.array(sub, pa.binary())], names=["shard", "t", "at", "bytes"])

    pieces = keyed.join(by_text, on).select("t", "text", "want")
    pieces = pieces.mapInArrow(cut, "shard int, t binary, at int, bytes binary")

    def sorted_shard(t: pa.Table) -> pa.Table:
        lean()
        groups: dict[bytes, list[tuple[bytes, int]]] = {}
        for k, at, x in zip(t.column("t").to_pylist(), t.column("at").to_pylist(), t.column("bytes").to_pylist()):
            groups.setdefault(x, []).append((k, at))
        strings = sorted(groups)
        rows = []
        for x, flags in zip(strings, repeated(strings, length)):
            if len(set(groups[x])) > 1:
                spans = [(0, len(x))]
            else:
                a, b = _runs_of(flags)
                spans = [(p, q - 1 + length) for p, q in zip(a.tolist(), b.tolist())]
            rows += [(k, at + p, at + q) for k, at in set(groups[x]) for p, q in spans]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table({"t": pa.array(cols[0], pa.binary()), "a": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.int64())})

    spans = pieces.groupBy("shard").applyInArrow(sorted_shard, "t binary, a long, b long")
    found = written(spans.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    some = found.join(texts.where("copies = 1").select("t", "id"), "t").select(F.col("t").alias("t2"), F.col("id").alias("id2"), "spans")

    def kept(batches):
        for b in batches:
            lean()
            removed, n_spans, shas = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                merged = cover([(x["a"], x["b"]) for x in spans])
                h, at = hashlib.sha256(), 0
                for p, q in merged:
                    h.update(data[at:p])
                    at = q
                h.update(data[at:])
                removed.append(sum(q - p for p, q in merged))
                n_spans.append(len(merged))
                shas.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas)], names=["t", "removed", "n", "kept"])

    part = keyed.join(some, on).select("t", "text", "spans").mapInArrow(kept, "t binary, removed long, n long, kept string")
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("t", F.col("n_bytes").alias("removed"), F.lit(1).cast("long").alias("n"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    result = part.union(whole)
    out = sketch.select("id", "t", "n_bytes", "sha").join(result, "t", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("n", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
