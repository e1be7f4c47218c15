"""Documents in shards along a Hilbert curve through their metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SQL_CRC, SQL_CRC_TABLES, fresh_path, in_runs, plain, table, unused, written

#: Bits that each dimension is quantised to, and bytes of documents in one file.
BITS, FILE_BYTES = 6, 512 << 20
#: Quantiles are exact up to so many rows, and then off by one in so many of the rows.
ACCURACY = 10_000
#: Leading bytes of a string that its place on an axis is taken from; six fit a double.
PREFIX = 6
ADDED = ("shard", "slot", "curve")


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points whose coordinates have ``bits`` bits each. From the highest bit down
    every cube's corner is turned so that the curve enters it at the origin; the Gray code's place follows."""
    x = [np.asarray(a, np.uint64).copy() for a in axes]
    one, n = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        low, bit = np.uint64((1 << b) - 1), np.uint64(b)
        for a in range(n):
            far = (x[a] >> bit & one).astype(bool)
            swap = np.where(far, np.uint64(0), (x[0] ^ x[a]) & low)
            x[0] = x[0] ^ np.where(far, low, swap)
            if a:
                x[a] = x[a] ^ swap
    for a in range(1, n):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(b) & one, np.uint64((1 << b) - 1), np.uint64(0))
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = out << one | ((a ^ turn) >> np.uint64(b) & one)
    return out


def axis(c: Column, kind: str) -> Column:
    """A value as a double that keeps its order: numbers and times as they are, of strings the first bytes. Null and
    NaN give null."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("boolean", "timestamp", "timestamp_ntz") or kind.startswith(("decimal", "tinyint", "smallint", "int", "bigint")):
        return (F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c).cast("double")
    if kind in ("float", "double"):
        return F.when(~F.isnan(c), c.cast("double"))
    raise TypeError(f"no order for a dimension of type {kind}")


def grid(axes: DataFrame, bits: int = BITS) -> list[list[float]]:
    """For each column (doubles) the borders between at most 2**bits - 2 bins of about equally many rows, over all
    rows; a row of so many numbers comes to the driver."""
    cuts = [i / (2**bits - 2) for i in range(1, 2**bits - 2)]
    got = axes.agg(*[F.percentile_approx(c, cuts, ACCURACY).alias(c) for c in axes.columns]).first()
    return [sorted(set(x or [])) for x in got]


def curve(axes: list[Column], borders: list[list[float]], bits: int = BITS) -> Column:
    """Place along the curve of a row's bins. A dimension's bins are spread over its whole axis, as one with few
    values would else count only where all others are equal; null is a bin of its own before the others."""

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        bins = []
        for values, own in zip(columns, borders):
            v = values.to_numpy(np.float64, na_value=np.nan)
            i = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(own, np.float64), np.nan_to_num(v), "left"))
            bins.append(i * 2**bits // (len(own) + 2))
        return pd.Series(hilbert(bins, bits).astype(np.int64))

    return place(*axes)


def _bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def write_shards(docs: DataFrame, path: str, dims: dict[str, Column | None], shards: int = 24, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, file_bytes: int = FILE_BYTES, borders: list[list[float]] | None = None) -> list[list[float]]:
    """Write ``docs`` to Parquet files at ``path`` in curve order, cut into ``shards`` runs, with the columns shard
    (int), slot (long, the place in the shard from 0) and curve (long); those of ``docs`` with such names give way.
    ``dims`` names the dimensions: a column, or an expression. Returns the grid's borders, which ``borders`` takes,
    so that a table that has grown is put on the same grid.

    Under the law ``rows`` shards differ by a row at most; under ``bytes`` a shard ends at the row whose middle is
    nearest to its share of all bytes (UTF-8 of the text plus 8), so shards differ by about a row's bytes.

    The order is (curve, checksum of the text, checksum of the id), packed into 62 bits, so rows of one cell, be they a third
    of all, are told apart and equal texts of one cell lie side by side. The keys alone are put in order first: each
    file's last key, and how many rows come before it, are read from them. Then texts are dealt to files by key, in
    one shuffle, each file by one task that sorts its rows with spilling. A file ends where a shard ends, but
    for rows of equal keys, which stay together; the shard is told by the slot, so the laws hold exactly all the same.
    The driver gets a row per file and one per run of keys.

    Null and empty texts count 8 bytes; nulls in a dimension have a bin of their own; repeated rows are rows; fewer
    rows than shards leave shards empty; an empty table gives files without rows."""
    if law not in ("rows", "bytes"):
        raise ValueError("the law is rows or bytes")
    if len(dims) * bits > 36:
        raise ValueError("the curve takes 36 bits at most")
    spark = docs.sparkSession
    docs = plain(docs, *ADDED)
    axes = docs.select(*[(F.col(f"`{n}`") if c is None else c).alias(n) for n, c in dims.items()])
    codes = [axis(F.col(f"`{n}`") if dims[n] is None else dims[n], kind) for n, kind in axes.dtypes]
    if borders is None:
        borders = grid(docs.select(*[c.alias(f"axis{i}") for i, c in enumerate(codes)]), bits)
    at_curve, at_key, at_like, at_to = unused(docs, "curve_at", "curve_key", "curve_like", "curve_to")
    rest = 62 - len(dims) * bits
    half = rest // 2
    checksum = lambda c: F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"))
    high = lambda h, n: F.shiftright(h, 32 - n)
    like = checksum(F.col(f"`{text_col}`"))
    key = F.shiftleft(at_curve, rest).bitwiseOR(F.shiftleft(high(F.col(at_like), rest - half), half)).bitwiseOR(high(checksum(F.col(f"`{id_col}`")), half))
    keyed = docs.withColumn(at_curve, curve(codes, borders, bits)).withColumn(at_like, like).withColumn(at_key, key)

    thin = written(keyed.select(F.col(at_key).alias("_key"), _bytes(F.col(f"`{text_col}`")).alias("_size")), "curve-keys")
    n_rows, n_bytes = (int(x or 0) for x in thin.agg(F.count("*"), F.sum("_size")).first())
    firsts, ends = _cuts(thin, n_rows, n_bytes, shards, law, file_bytes)
    last_key, base = np.array([k for k, _ in ends], np.int64), np.array([0, *(r + 1 for _, r in ends)], np.int64)

    @F.pandas_udf("to int, base long")
    def dealt(keys: pd.Series) -> pd.DataFrame:
        to = np.searchsorted(last_key, keys.to_numpy(np.int64), "left")
        return pd.DataFrame({"to": to.astype(np.int32), "base": base[to]})

    there = F.col(f"{at_to}.base") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = keyed.withColumn(at_to, dealt(at_key)).repartitionById(len(base), F.col(f"{at_to}.to")).sortWithinPartitions(at_key, f"`{id_col}`", at_like)
    rows = rows.withColumn(at_like, there)
    starts = F.array(*[F.lit(int(f)).cast("long") for f in firsts])
    shard = F.size(F.filter(starts, lambda f: f <= F.col(at_like))) - 1
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col(at_like) - F.get(starts, F.col("shard")))
    rows.select(*[f"`{c}`" for c in docs.columns], "shard", "slot", F.col(at_curve).alias("curve")).write.parquet(path)
    return borders


def _cuts(thin: DataFrame, n_rows: int, n_bytes: int, shards: int, law: str, file_bytes: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The first row of each shard, and of each file but the last its last key and the number of its last row."""
    placed = in_runs(thin, [F.col("_key")], "curve-runs", n_rows=n_rows)
    by_run = {r._run: (r.n, r.b) for r in placed.groupBy("_run").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()}
    firsts_of, rows, size = {}, 0, 0
    for run in sorted(by_run):
        firsts_of[run] = (rows, size)
        rows, size = rows + by_run[run][0], size + by_run[run][1]
    spark = thin.sparkSession
    runs = F.broadcast(spark.createDataFrame([(r, *x) for r, x in firsts_of.items()], "_run int, _row0 long, _byte0 long"))
    # bytes before a row within its run: the window's groups are the runs
    before = Window.partitionBy("_run").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).join(runs, "_run")
    at = at.select("_key", "_size", (F.col("_row0") + F.col("_nth")).alias("_row"), (F.col("_byte0") + F.col("_before")).alias("_byte"))
    firsts = [k * n_rows // shards for k in range(shards)]
    if law == "bytes" and n_bytes:
        own = F.least(F.lit(shards - 1), F.floor((F.col("_byte") + F.col("_size") / 2) / F.lit(float(n_bytes)) * shards)).cast("int")
        got = {r.shard: r.first for r in at.groupBy(own.alias("shard")).agg(F.min("_row").alias("first")).collect()}
        firsts, nxt = [0] * shards, n_rows
        for k in range(shards - 1, -1, -1):
            nxt = firsts[k] = got.get(k, nxt)
    ends = (F.floor((F.col("_byte") + F.col("_size")) / file_bytes) > F.floor(F.col("_byte") / file_bytes)) | (F.col("_row") + 1).isin(sorted({f for f in firsts if f}))
    last = at.where(ends).select("_key").distinct()
    out = at.join(F.broadcast(last), "_key").groupBy("_key").agg(F.max("_row").alias("row")).collect()
    return firsts, sorted((r._key, r.row) for r in out if r.row + 1 < n_rows)


def manifest(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """A row per file: file, rows, the shards and slots in it, and for each dimension (a column of the files) its
    least and greatest value, lo_* and hi_*, null where it has none."""
    files = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    bounds = [x for d in dims for x in (F.min(f"`{d}`").alias(f"lo_{d}"), F.max(f"`{d}`").alias(f"hi_{d}"))]
    first, last = F.min(F.struct("shard", "slot")), F.max(F.struct("shard", "slot"))
    return files.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("rows"), first.alias("first"), last.alias("last"), *bounds)


def pruned(spark: SparkSession, path: str, files: DataFrame, where: dict[str, tuple]) -> DataFrame:
    """The rows of the files whose values lie within (least, greatest) in all of ``where``; only files that can hold
    such a row are opened. ``files`` is the manifest; null bounds are open, null values match nothing."""
    here, keep = F.lit(True), F.lit(True)
    for d, (lo, hi) in where.items():
        if lo is not None:
            here, keep = here & (F.col(f"`hi_{d}`") >= F.lit(lo)), keep & (F.col(f"`{d}`") >= F.lit(lo))
        if hi is not None:
            here, keep = here & (F.col(f"`lo_{d}`") <= F.lit(hi)), keep & (F.col(f"`{d}`") <= F.lit(hi))
    names = [r.file for r in files.where(here).select("file").collect()]
    whole = spark.read.parquet(path)
    return (spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)).where(keep)


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, out, {"lang": None, "source": None, "bytes": _bytes(F.col("text"))})
    rows = spark.read.parquet(out)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", _bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql(rows: str, n: int, bits: int) -> str:
    """The turns of ``hilbert`` on columns x0, x1, .. of ``rows``, a step each, and then its place as curve."""
    xs = [f"x{a}" for a in range(n)]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for a in range(n):
            far = f"(x{a} >> {b}) & 1 = 1"
            swap = f"(xor(x0, x{a}) & {low})"
            own = f", xor(x{a}, CASE WHEN {far} THEN 0 ELSE {swap} END) AS x{a}" if a else ""
            rows = f"SELECT * REPLACE (xor(x0, CASE WHEN {far} THEN {low} ELSE {swap} END) AS x0{own}) FROM ({rows})"
    for a in range(1, n):
        rows = f"SELECT * REPLACE (xor(x{a}, x{a - 1}) AS x{a}) FROM ({rows})"
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN ({xs[-1]} >> {b}) & 1 = 1 THEN {(1 << b) - 1} ELSE 0 END)"
    place = " + ".join(f"(((xor({x}, turn) >> {b}) & 1) << {n * b + n - 1 - a})" for b in range(bits) for a, x in enumerate(xs))
    return f"SELECT *, {place} AS curve FROM (SELECT *, {turn} AS turn FROM ({rows}))"


_AXES = ("('0x' || rpad(hex(encode(lang))[1:12], 12, '0'))::BIGINT", "('0x' || rpad(hex(encode(source))[1:12], 12, '0'))::BIGINT", "size")
_BINS = ", ".join(f"(SELECT CASE WHEN c{a} IS NULL THEN 0 ELSE 1 + len(list_filter(v, lambda x: x < c{a})) END * {2**BITS} // (len(v) + 2) FROM b{a}) AS x{a}" for a in range(3))
_BORDERS = ", ".join(f"b{a} AS (SELECT coalesce(list(DISTINCT c{a}), []) AS v FROM (SELECT c{a}, row_number() OVER (ORDER BY c{a}) AS k, count(*) OVER () AS n FROM s WHERE c{a} IS NOT NULL) WHERE k IN (SELECT ceil((i / {2**BITS - 2}.0::DOUBLE) * n)::BIGINT FROM (SELECT unnest(range(1, {2**BITS - 2})) AS i)))" for a in range(3))
#: Borders are exact quantiles here, as they are in Spark up to ACCURACY / 2 rows.
OP11_SQL = f"""
WITH RECURSIVE {SQL_CRC_TABLES},
s AS (SELECT doc_id, size, {SQL_CRC} AS text_crc32, {", ".join(f"{x} AS c{a}" for a, x in enumerate(_AXES))} FROM (SELECT *, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents), tab),
i AS (SELECT doc_id, {SQL_CRC} AS id_crc FROM (SELECT DISTINCT doc_id, hex(encode(doc_id::VARCHAR)) AS h FROM documents), tab),
{_BORDERS},
c AS ({_curve_sql(f"SELECT doc_id, size, text_crc32, {_BINS} FROM s", 3, BITS)}),
o AS (SELECT c.*, row_number() OVER (ORDER BY curve, text_crc32 >> 10, id_crc >> 10, c.doc_id, text_crc32) - 1 AS g, count(*) OVER () AS n FROM c JOIN i ON c.doc_id = i.doc_id),
p AS (SELECT *, (((g + 1) * 24 - 1) // n)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard, (g - shard * n // 24)::BIGINT AS slot, NULL::INT AS grown_shard, curve::BIGINT AS curve FROM p"""
