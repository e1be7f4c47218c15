"""Toxicity by the nearest labelled examples under TF-IDF cosine, found in a block-max inverted index."""

from __future__ import annotations

import hashlib
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, plain, table, text_batches

#: At most so many labelled examples, of so many characters in all, are indexed: those with the least hash of the
#: text; copies count once. Both bound what the driver gathers and broadcasts.
EXAMPLES, EXAMPLE_CHARS = 4_000, 24_000_000
NEIGHBOURS = 15
#: Weight of the base rate among the votes.
PRIOR_WEIGHT = 0.25

_BREAK = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of lower-cased texts, parted by all ASCII characters but letters and digits: the distinct ones, and for
    each word its place among those; words of text k are at [ends[k], ends[k + 1]). A text without words has one
    empty word."""
    clean = [(x or "").lower().encode("utf-8", "replace").translate(_BREAK).strip() for x in texts]
    split = pc.ascii_split_whitespace(pa.array(clean, pa.large_binary()).cast(pa.large_string()))
    flat = split.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy(), ends


def numbers_of(texts: list[str | None], number: dict[str, int]) -> list[np.ndarray]:
    """Ascending numbers of the known words of each text, one for each time that it stands there."""
    distinct, words, ends = words_of(texts)
    known = np.fromiter(map(number.get, distinct, repeat(-1)), np.int64, len(distinct))[words] if len(words) else np.zeros(0, np.int64)
    out = [np.sort(known[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return [x[np.searchsorted(x, 0) :] for x in out]


def telling(df: float, toxic: float, rate: float) -> float:
    """How far a term's presence moves the odds of the label: the square of the shrunk log odds of the ``df``
    examples that hold it, ``toxic`` of them, against the base rate. Near 0 for terms that say nothing, whatever the
    number of examples."""
    if not 0 < rate < 1:
        return 1.0
    p = (toxic + 2 * rate) / (df + 2)
    return (math.log(p / (1 - p)) - math.log(rate / (1 - rate))) ** 2


class Index:
    """Examples as unit vectors of (1 + log tf) x idf x ``telling``, over all their terms.

    Terms of few examples have postings; terms of many have a row of weights over all examples and their largest
    weight per block of examples. A search adds up the postings, which gives each example's share by rare terms,
    bounds the rest by the blocks' largest weights, takes blocks from the largest bound down, scores their examples
    that can still reach the k-th score, and stops when no block can: the k nearest are exact."""

    BLOCK, WAVE = 64, 8
    #: A term of more than this share of the examples is frequent.
    FREQUENT = 1 / 24

    def __init__(self, examples: list[tuple[object, int, str]], idf: dict[str, float]):
        self.rate = float(np.mean([label for _, label, _ in examples])) if examples else 0.0
        self.number = {t: i for i, t in enumerate(idf)}
        own = numbers_of([text for _, _, text in examples], self.number)
        df, toxic = np.zeros(len(idf)), np.zeros(len(idf))
        for (_, label, _), x in zip(examples, own):
            df[np.unique(x)] += 1
            toxic[np.unique(x)] += label > 0
        self.weight = np.array([w * telling(n, k, self.rate) for w, n, k in zip(idf.values(), df.tolist(), toxic.tolist())])
        vectors = [(self.vector(x), ident, label) for (ident, label, _), x in zip(examples, own)]
        # examples with alike heaviest terms share blocks, so that bounds are tight
        vectors = [v for v in vectors if len(v[0][0])]
        vectors.sort(key=lambda v: (v[0][0][np.argsort(-v[0][1], kind="stable")[:8]].tolist(), str(v[1])))
        self.ids = [v[1] for v in vectors]
        self.labels = np.array([v[2] for v in vectors], np.float64)
        n = len(vectors)
        ends = np.cumsum([0, *(len(v[0][0]) for v in vectors)])
        term = np.concatenate([v[0][0] for v in vectors]) if n else np.zeros(0, np.int64)
        value = np.concatenate([v[0][1] for v in vectors]) if n else np.zeros(0)
        example = np.repeat(np.arange(n), np.diff(ends))
        count = np.bincount(term, minlength=len(self.number))
        often = count > max(1, n * self.FREQUENT)
        # rare terms: postings by term
        rare = ~often[term]
        order = np.argsort(term[rare], kind="stable")
        self.at = np.concatenate([[0], np.cumsum(np.where(often, 0, count))])
        self.posted, self.impact = example[rare][order].astype(np.int32), value[rare][order]
        # frequent ones: weights by term and example, and the largest of each block
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        blocks = -(-n // self.BLOCK)
        self.full = np.zeros((blocks * self.BLOCK, int(often.sum())))
        self.full[example[~rare], self.row[term[~rare]]] = value[~rare]
        self.most = self.full.reshape(blocks, self.BLOCK, self.full.shape[1]).max(1)

    def vector(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of a text's known words (as from ``numbers_of``) and their weights, of length one."""
        first = np.flatnonzero(np.diff(met, prepend=-1))
        at = met[first]
        w = (1 + np.log(np.diff(first, append=len(met)))) * self.weight[at]
        norm = math.sqrt(float(w @ w))
        return (at[w > 0], w[w > 0] / norm) if norm else (at[:0], w[:0])

    def nearest(self, q: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above zero; ties go to the first example."""
        at, w = q
        n = len(self.ids)
        if not len(at) or not n:
            return []
        size = self.at[at + 1] - self.at[at]
        where = np.arange(size.sum()) + np.repeat(self.at[at] - (np.cumsum(size) - size), size)
        share = np.bincount(self.posted[where], np.repeat(w, size) * self.impact[where], len(self.full))
        rows = self.row[at]
        often = np.zeros(self.full.shape[1])
        often[rows[rows >= 0]] = w[rows >= 0]
        rest = self.most @ often
        blocks = share.reshape(-1, self.BLOCK)
        bound = blocks.max(1) + rest
        # the k-th share is never above the k-th score
        some = share[share > 0]
        least = float(np.partition(some, -k)[-k]) if len(some) >= k else 0.0
        order = np.argsort(-bound, kind="stable")
        best_score, best = np.zeros(0), np.zeros(0, np.int64)
        for a in range(0, len(order), self.WAVE):
            wave = order[a : a + self.WAVE]
            wave = wave[(bound[wave] > 0) & (bound[wave] >= least - 1e-9)]
            if not len(wave):
                break
            b, e = np.nonzero(blocks[wave] + rest[wave, None] >= least - 1e-9)
            e = wave[b] * self.BLOCK + e
            score = share[e] + self.full[e] @ often
            e, score = e[score > 1e-15], score[score > 1e-15]
            best, best_score = np.concatenate([best, e]), np.concatenate([best_score, score])
            top = np.lexsort((best, -np.round(best_score, 12)))[:k]
            best, best_score = best[top], best_score[top]
            if len(best) == k:
                least = max(least, float(best_score[-1]))
        return list(zip(best_score.tolist(), best.tolist()))

    def score(self, found: list[tuple[float, int]]) -> float:
        """Votes weighted by the inverse of the angle's chord, shrunk to the base rate."""
        weights = [c / (0.2 + math.sqrt(max(0.0, 2 - 2 * c))) for c, _ in found]
        vote = sum(w * self.labels[e] for w, (_, e) in zip(weights, found))
        return min(1.0, max(0.0, (vote + PRIOR_WEIGHT * self.rate) / (sum(weights) + PRIOR_WEIGHT)))


def chosen_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, examples: int, chars: int) -> list:
    """(id, text, label) of the examples. Only ids, hashes and lengths are shuffled; texts are fetched by a broadcast
    of the chosen ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    d = d.select("_id", "_text", F.xxhash64("_text").alias("_h"))
    t = d.select("_id", "_h", F.length("_text").cast("long").alias("_n")).join(known, "_id")
    rows = t.groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_label").alias("_label"), F.max("_n").alias("_n")).orderBy("_h").limit(examples).collect()
    total, few = 0, []
    for r in rows:
        total += r["_n"]
        if few and total > chars:
            break
        few.append(r)
    if not few:
        return []
    kind = dict(d.dtypes)["_id"]
    picked = docs.sparkSession.createDataFrame([(r["_h"], r["_id"], r["_label"]) for r in few], f"_h long, _id2 {kind}, _label int")
    found = d.join(F.broadcast(picked), "_h").where("_id = _id2").groupBy("_h").agg(F.min("_id").alias("_id"), F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    return [(r["_id"], r["_text"], r["_label"]) for r in sorted(found.collect(), key=lambda r: r["_h"])]


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and for each term of a bounded vocabulary the number of them that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        number = {t: i for i, t in enumerate(sent.value)}
        n, df = 0, np.zeros(len(number), np.int64)
        for b in batches:
            lean()
            n += b.num_rows
            for met in numbers_of(b.column(0).to_pylist(), number):
                df[met[np.flatnonzero(np.diff(met, prepend=-1))]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], names=["term", "n"])

    out, n = np.zeros(len(vocabulary), np.int64), 0
    got = docs.select(F.col(text_col)).mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, total = got.column("term").to_numpy(), got.column("n").to_numpy()
    out[at[at >= 0]] = total[at >= 0]
    n = int(total[at < 0].sum())
    sent.destroy()
    return n, out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Index:
    """An index of at most ``examples`` labelled texts of at most ``chars`` characters in all (or one text), over all
    of their terms; inverse document frequencies count all ``docs``. Of labels that disagree on a document, or on
    copies of a text, the larger counts; null labels and documents without a text are left out. Without any example
    the index is empty and its base rate 0."""
    text_batches(docs.sparkSession)
    rows = [(i, label, text) for i, text, label in chosen_examples(docs, labels, id_col, text_col, label_col, examples, chars)]
    vocabulary = sorted(set(words_of([text for _, _, text in rows])[0]) - {""})
    if not vocabulary:
        return Index(rows, {})
    n, df = document_frequencies(docs, text_col, vocabulary)
    index = Index(rows, {t: 1 + math.log((n + 1) / (k + 1)) for t, k in zip(vocabulary, df.tolist())})
    del rows, vocabulary, df
    lean()
    return index


def scored(docs: DataFrame, index: Index, text_col: str = "text", k: int = NEIGHBOURS, evidence: bool = False) -> DataFrame:
    """``docs`` plus _score double, and with ``evidence`` _evidence array<struct<example,cosine,label>>. Whole
    texts are scored; a null or empty text, or one without a known term, has no neighbour and gets the base rate of
    the examples (0 if there are none). Rows are scored one by one and repeated rows alike; other columns pass
    through, but one that is named like an added column gives way to it. An empty table gives an empty result."""
    text_batches(docs.sparkSession)
    docs = plain(docs, "_score", *(["_evidence"] * evidence))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        index, known = sent.value, {}
        for b in batches:
            lean()
            scores, shown = [], []
            texts = b.column(at).to_pylist()
            for text, met in zip(texts, numbers_of(texts, index.number)):
                key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    found = index.nearest(index.vector(met), k)
                    known[key] = index.score(found), [{"example": str(index.ids[e]), "cosine": c, "label": int(index.labels[e])} for c, e in found] if evidence else None
                scores.append(known[key][0])
                shown.append(known[key][1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), *([pa.array(shown, kind)] if evidence else [])], names=[*b.schema.names, "_score", *(["_evidence"] if evidence else [])])

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", _score double" + ", _evidence array<struct<example:string,cosine:double,label:int>>" * evidence
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_training_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Index:
    return fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and as evidence the neighbours that voted, nearest first, as example:cosine:label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(docs, fit_on_training_rows(spark, docs, sf_dir), evidence=True)
    shown = F.array_join(F.transform("_evidence", lambda e: F.concat_ws(":", e["example"], F.format_number(e["cosine"], 4), e["label"].cast("string"))), ",")
    return s.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), shown.alias("evidence"))
