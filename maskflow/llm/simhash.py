"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, plain, table, text_batches, written

#: White space that parts words: space and U+0009 to U+000D.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes whose bits are counted at once; bounds memory on very long texts.
_AT_ONCE = 50_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 (seed 42) of all word shingles, repeats included; a bit is 1 if it is set
    in over half of them. Fewer words than ``width`` make one shingle; none give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = [words] if len(words) < width else zip(*(words[i:] for i in range(width)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(s), 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _AT_ONCE):
        ones += np.unpackbits(h[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, name: str = "_fp") -> DataFrame:
    """``docs`` plus the fingerprint of each whole text, row by row; null and empty texts give 0, repeated rows the
    same one, an empty table an empty result. Other columns pass through; one called ``name`` gives way."""
    text_batches(docs.sparkSession)
    docs = plain(docs, name)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t, width) for t in b.column(at).to_pylist()], pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + f", `{name}` long")


def linked_fingerprints(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (column _fp; others are ignored) -> pairs (a, b), a < b, at ``radius`` or fewer
    differing bits. Nulls link with nothing, an empty table gives no pair, and a repeated fingerprint repeated pairs.

    The 64 bits are two segments of 32. Two fingerprints within 3 bits agree in one segment up to one bit, so each
    is stored in a table under both of its segments and probes each table with the 33 values of the ball of
    radius 1 about its own; matches are kept after the whole distance is counted. Generally the ball's radius is
    radius // 2, of which 0 and 1 are supported. The keys have 32 bits, which spreads what is not alike; the join
    is an equi-join whose large keys adaptive execution splits."""
    if radius > 3:
        raise ValueError("a radius of 3 bits at most")
    segment = lambda k: F.shiftrightunsigned("_fp", 32) if k else F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF))
    tables = fps.select("_fp", F.posexplode(F.array(segment(0), segment(1))).alias("part", "key")).withColumnRenamed("_fp", "b")
    ball = lambda s: F.concat(F.array(s), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))) if radius > 1 else F.array(s)
    probes = fps.select(F.col("_fp").alias("a"), F.posexplode(F.array(ball(segment(0)), ball(segment(1)))).alias("part", "keys")).select("a", "part", F.explode("keys").alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.join(tables, (probes.part == tables.part) & (probes.key == tables.key) & near).select("a", "b")


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """Rows with an id and a _fp -> (_fp, component): the smallest id of the documents reachable by links.

    Documents with one fingerprint are first merged into it, so groups of copies cost one probe set. Null ids are
    never a component's id unless it has no other. Empty texts have fingerprint 0 and link like any other; an
    empty table gives an empty result."""
    fps = written(rows.groupBy("_fp").agg(F.min(id_col).alias("_least")), "fps")
    roots = connected_components(linked_fingerprints(fps.select("_fp"), radius))
    by_root = written(fps.join(roots, fps["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_root")), "roots")
    least = by_root.groupBy("_root").agg(F.min("_least").alias("component"))
    return by_root.join(least, "_root").select("_fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "simhash")
    out = docs.join(near_duplicates(docs), "_fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
