"""Collocations of two and three words, per language."""

from __future__ import annotations

import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_batches, written

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Words of one stretch of a piece, before it is cut into overlapping ones, so that no row grows with a text.
STRETCH = 1000
#: Words whose n-grams are counted at once, distinct pieces that a task adds up at once, and memory of an engine.
BLOCK_WORDS, HELD_PIECES, ENGINE_MB = 500_000, 200_000, 256
#: Bytes of text whose n-grams one bucket is to hold, parts that a block is cut into at most, n-grams cut again at once.
BUCKET_BYTES, FAN, BLOCK_GRAMS = 16 << 20, 1024, 3_000_000
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))


def stretches(text: str | None, longest: int = LONGEST, size: int = STRETCH):
    """(words joined by one space, how many of them begin phrases) of each piece of a text: a piece of more than
    ``size`` words comes in stretches, each with the words that phrases beginning in it reach."""
    for piece in (text or "").encode("utf-8", "surrogatepass").translate(_PIECES).split(b"\n"):
        found = piece.split(b" ")
        found = [w for w in found if w]
        n = len(found)
        if n <= size:
            if n:
                yield b" ".join(found), n
        else:
            for at in range(0, n, size):
                yield b" ".join(found[at : at + size + longest - 1]), min(size, n - at)


def _batch(lang: list, piece: list, more: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(piece, pa.binary()).cast(pa.string()), *[pa.array(v, k) for _, v, k in more]], names=["lang", "piece", *[n for n, _, _ in more]])


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """lang, piece, starts int, n long: each distinct stretch of each language once, with its multiplicity. Tasks add
    up what they hold before the shuffle, so a passage that many documents share is one row per task."""
    text_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = list(held.items())
            held.clear()
            for i in range(0, len(out), 50_000):
                part = out[i : i + 50_000]
                yield _batch([k[0] for k, _ in part], [k[1] for k, _ in part], [("starts", [k[2] for k, _ in part], pa.int32()), ("n", [n for _, n in part], pa.int64())])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for own, starts in stretches(text.as_py(), longest):
                    held[lang, own, starts] += 1
                if len(held) >= HELD_PIECES:
                    yield from flush()
        yield from flush()

    found = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_col).mapInArrow(run, "lang string, piece string, starts int, n long")
    return found.groupBy("lang", "piece", "starts").agg(F.sum("n").alias("n"))


class Engine:
    """An embedded engine of one thread and bounded memory, which spills to a folder of its own that goes with it.
    The folder holds no data that another task reads."""

    def __enter__(self):
        import duckdb

        self.folder = tempfile.TemporaryDirectory(prefix="phrases-")
        self.run = duckdb.connect(config={"threads": 1, "memory_limit": f"{ENGINE_MB}MB", "temp_directory": self.folder.name, "preserve_insertion_order": False})
        return self.run

    def __exit__(self, *_):
        self.run.close()
        self.folder.cleanup()


def _grams_sql(longest: int) -> str:
    parts = ["[w[i] for i in range(1, starts + 1)]"]
    for n in range(2, longest + 1):
        words = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
        parts.append(f"[{words} for i in range(1, least(starts, len(w) - {n - 1}) + 1)]")
    grams = parts[0]
    for p in parts[1:]:
        grams = f"list_concat({grams}, {p})"
    return f"""WITH p AS (SELECT lang, string_split(piece, ' ') AS w, starts, n FROM block)
SELECT lang, gram, sum(n)::BIGINT AS n FROM (SELECT lang, unnest({grams}) AS gram, n FROM p) GROUP BY ALL
UNION ALL SELECT lang, '', sum(starts * n)::BIGINT FROM p GROUP BY lang"""


def _packed(db, sql: str, buckets: int, step: int):
    """A row (bucket, lang, grams, counts) for each bucket and language of the counts that ``sql`` gives: the n-grams in
    order, a line each, which compresses them well. Of the ``buckets`` each ``step`` that follow each other are one."""
    t = db.sql(f"SELECT (hash(lang, gram) % {buckets} // {step})::INTEGER AS bucket, * FROM ({sql}) ORDER BY bucket, lang, gram").to_arrow_table().combine_chunks()
    bucket, lang = t.column("bucket").to_numpy(), t.column("lang").combine_chunks().dictionary_encode()
    code = lang.indices.to_numpy()
    new = (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])
    at = np.append(np.flatnonzero(np.concatenate([[True], new])[: len(bucket)]), len(bucket)).tolist()
    grams, n, press = t.column("gram").combine_chunks(), t.column("n").to_numpy(), zstandard.ZstdCompressor(level=1)
    for a, b in zip(at[:-1], at[1:]):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), grams.slice(a, b - a)), "\n")[0].as_buffer()
        row = [[bucket[a]], [lang.dictionary[int(code[a])].as_py()], [press.compress(joined)], [press.compress(n[a:b].tobytes())]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["bucket", "lang", "grams", "counts"])


def _unpacked(batches):
    press = zstandard.ZstdDecompressor()
    for b in batches:
        for lang, joined, counts in zip(*(b.column(k).to_pylist() for k in ("lang", "grams", "counts"))):
            text = pa.array([press.decompress(joined)], pa.binary()).cast(pa.string())
            own, n = pc.split_pattern(text, "\n").values, np.frombuffer(press.decompress(counts), np.int64)
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(n), np.int32), [lang]).cast(pa.string()), own, pa.array(n)], names=["lang", "gram", "n"])


def grams(found: DataFrame, longest: int = LONGEST, least: int = LEAST, buckets: int = 1) -> DataFrame:
    """lang, gram, n: how often each run of 1 to ``longest`` words stands in its language, of those that do so
    ``least`` times, and under the empty gram the number of all words. Written.

    Tasks count the weighted n-grams of a block of pieces, so a frequent one is an entry per block, and send them on
    by hash, sorted and compressed; each bucket is counted in an engine that spills what exceeds its memory. Beyond
    FAN buckets the exchange has two steps, so that no block is cut into more than FAN parts."""
    sql, step = _grams_sql(longest), -(-buckets // FAN)
    schema = "bucket int, lang string, grams binary, counts binary"
    kinds = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    added = "SELECT lang, gram, sum(n)::BIGINT AS n FROM block GROUP BY ALL"

    def blocks(batches, size, most):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += size(b)
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def exploded(batches):
        with Engine() as db:
            for t in blocks(batches, lambda b: sum(b.column("starts").to_pylist()), BLOCK_WORDS):
                db.register("block", t)
                yield from _packed(db, sql, buckets, step)

    def dealt(batches):
        with Engine() as db:
            for t in blocks(_unpacked(batches), lambda b: b.num_rows, BLOCK_GRAMS):
                db.register("block", t)
                yield from _packed(db, added, buckets, 1)

    def counted(batches):
        with Engine() as db:
            db.register("block", pa.RecordBatchReader.from_batches(kinds, (b.cast(kinds) for b in _unpacked(batches))))
            yield from db.sql(f"{added} HAVING sum(n) >= {int(least)} OR gram = ''").to_arrow_reader(50_000)

    sent = found.mapInArrow(exploded, schema)
    if step > 1:
        sent = sent.repartitionById(-(-buckets // step), F.col("bucket")).mapInArrow(dealt, schema)
    return written(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(counted, "lang string, gram string, n long"), "grams")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank long, phrase, a, l, r, n, score: the ``top`` phrases (all, if None) of 2 to ``longest`` words that
    stand ``least`` times or more, by floor(1000000 a a / (l r)) at the cut where that is lowest.

    Both parts of a cut stand at least as often as the phrase, so all that is looked up is among the n-grams kept.
    Each candidate sends a request for either part of each cut to where that part's count lies: an equi-join on
    (language, part), whose large keys adaptive execution splits; the answers meet again under the candidate.
    A candidate goes if a longer one that holds it stands ``covered`` percent as often or more. The first ``top`` of a
    language are taken in each task before they meet.

    Words are parted by space and tab, pieces by ``.,;:!?`` and U+000A to U+000D; A-Z are lower-cased. Counts are
    exact: products are decimals of 38 digits. Null texts are empty, a null language is ``und``; repeated rows count
    again; columns of other names are dropped; an empty table gives an empty result."""
    docs = docs.select(F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    n_bytes = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // BUCKET_BYTES))
    counts = grams(pieces(docs, "_lang", "_text", longest), longest, least, buckets)
    length = F.size(F.split("gram", " "))
    phrases = counts.where((F.col("gram") != "") & (length > 1)).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.split("gram", " ").alias("w"))
    asked = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    requests = asked.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("gram")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("gram")))).alias("q"))
    answers = requests.select("lang", "phrase", "a", "k", "q.side", "q.gram").join(counts, ["lang", "gram"])
    cuts = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    square = (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.call_function("div", square.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = phrases.select("lang", F.col("a").alias("over"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w")), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(n.alias("size"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))))).alias("p"), F.size("w").alias("whole")).where("p.size < whole")
    over = inner.groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("over").alias("over"))
    kept = best.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.lit(100).cast("decimal(10,0)") * wide("over") < F.lit(covered).cast("decimal(10,0)") * wide("a")))
    totals = counts.where("gram = ''").select("lang", F.col("n").alias("words"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")).withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS gram FROM w
      UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w
      UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM w),
f AS (SELECT lang, size, gram, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, gram, f AS a, string_split(gram, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.gram, k.size, a, k, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score FROM k
      JOIN f x ON x.lang = k.lang AND x.gram = array_to_string(w[1:k], ' ') AND x.size = k
      JOIN f y ON y.lang = k.lang AND y.gram = array_to_string(w[k + 1:], ' ') AND y.size = k.size - k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(a) AS over FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE size = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.gram = o.part AND b.size = 2 WHERE over IS NULL OR 100 * over < 50 * a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n ON z.lang = n.lang QUALIFY rank <= 2000"""
