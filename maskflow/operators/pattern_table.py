"""Literal patterns of a table (rules, canaries) looked for in texts, by team."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Patterns of up to so many characters in all go to every task as one automaton per team.
BROADCAST_CHARS = 8_000_000
#: Longest piece of a pattern that it is looked up by, and bits of the filter that goes to every task, at least; it
#: has 32 bits for each pattern, up to the most.
ANCHOR, FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 24, 1 << 29
#: A pattern of many numbers is dealt to a task for each so many of them, up to the most.
HOT, MOST_PARTS = 64, 64
#: Of every so many texts one tells which patterns texts hold often: those that so many of them hold.
LOOK, OFTEN = 8, 4
#: Texts of up to so many characters in all are looked through at once.
BLOCK_CHARS = 1 << 17
#: So many pieces found, or of so many characters in all, or few more, go on at once.
BATCH_ROWS, BATCH_CHARS = 1 << 18, 1 << 25
#: Of a piece at most so many texts make a row, and meet so many numbers at once; of such rows so many go on at once.
RUN_KEYS, RUN, SENT_ROWS = 1 << 5, 1 << 9, 1 << 12
#: Of what is met at once a task makes about so many rows.
TASK_ROWS = 1 << 24
#: Shifts of a hash that give its places in the filter: for a whole pattern, and for a pattern's first piece.
WHOLE, FIRST = (0, 17, 34), (34,)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hits(texts: DataFrame, patterns: DataFrame, key: str, team: str = "team_id", text: str = "text", pattern_no: str = "pattern_no", pattern: str = "pattern", most: int | None = None) -> DataFrame:
    """key, pattern_no of every pattern of its team that a text holds, once. A null or empty text or pattern, or a
    null team, holds or is nothing.

    Patterns of up to BROADCAST_CHARS characters, counted first, become an automaton per team on every task; texts
    stay where they are. More are met by keys: where a text's pieces of ANCHOR characters (all of a shorter pattern), of
    twice as many and so on pass a filter of the patterns' first pieces, its pieces of every length that a pattern has
    are put to a filter of whole patterns, and those that pass travel, once for each text, to an equi-join on (team, piece). Texts don't travel,
    and what is found is not shuffled unless a key or a number stands twice. The filters only save work: when they are
    full, more pieces travel, and none is lost. Nor do pieces travel that many texts hold: their patterns, the most
    held of up to BROADCAST_CHARS characters, go to every task and are met there. Some texts tell which those are; all
    texts are looked through for all patterns, by one way or the other.

    A pattern of n numbers that m texts hold makes n * m rows. Where it is met at once they come as runs of RUN
    numbers, dealt to tasks by run, each for one text after the other: so the runs repeat within a page of a file, and a
    row takes a small part of a byte there."""
    p = patterns.select(F.col(f"`{team}`").alias("_team"), F.col(f"`{pattern_no}`").alias("_no"), F.col(f"`{pattern}`").alias("_pattern")).where("_team is not null and _pattern <> ''")
    t = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{team}`").alias("_team"), F.col(f"`{text}`").alias("_text")).where("_team is not null and _text <> ''")
    size = p.agg(F.sum(F.length("_pattern") + 8)).first()[0] or 0
    found = _by_automaton(t, p) if size <= (BROADCAST_CHARS if most is None else most) else _by_pieces(t, p)
    return found.select(F.col("_key").alias(key), F.col("_no").alias(pattern_no))


def _by_automaton(t: DataFrame, p: DataFrame) -> DataFrame:
    kinds, spark = dict(t.dtypes) | dict(p.dtypes), t.sparkSession
    sent = spark.sparkContext.broadcast([tuple(r) for r in p.collect()])

    def run(batches):
        import ahocorasick

        by_team: dict = {}
        for team, no, pattern in sent.value:
            by_team.setdefault(team, {}).setdefault(pattern, []).append(no)
        automata = {}
        for b in batches:
            keys, numbers = [], []
            for i, (team, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if team not in by_team:
                    continue
                if team not in automata:
                    automata[team] = a = ahocorasick.Automaton()
                    for pattern, own in by_team[team].items():
                        a.add_word(pattern, own)
                    a.make_automaton()
                there = {no for _, own in automata[team].iter(text) for no in own}
                keys += [i] * len(there)
                numbers += there
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int32())), pa.array(numbers, no_type)], names=["_key", "_no"])

    no_type = pa.string() if kinds["_no"] == "string" else pa.int32() if kinds["_no"] == "int" else pa.int64()
    return t.select("_key", "_team", "_text").mapInArrow(run, f"_key {kinds['_key']}, _no {kinds['_no']}")


class Windows:
    """64-bit hashes of pieces of a text, each from two sums over the text, whatever the piece's length. Equal pieces
    have equal hashes; unequal ones may."""

    def __init__(self):
        self._grow(1 << 12)

    def _grow(self, n: int):
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(base))]))
        self.up, self.down = powers(int(_BASE)), powers(pow(int(_BASE), -1, 1 << 64))

    def sums(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        if len(c) >= len(self.up):
            self._grow(2 * len(c))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * c * self.up[: len(c)], dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, at: np.ndarray, n) -> np.ndarray:
        """Of the pieces of ``n`` characters, one number or one for each place."""
        h = (sums[at + n] - sums[at]) * self.down[at] + np.asarray(n).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _BASE
        return h ^ (h >> np.uint64(32))


def _place(hashes: np.ndarray, bits: int, shift: int) -> np.ndarray:
    return ((hashes >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def firsts(n: int) -> list[int]:
    """Lengths of the first pieces that lead to a pattern of ``n`` characters, each twice as long as the one before."""
    return [min(ANCHOR, n)] + [ANCHOR << k for k in range(1, 32) if ANCHOR << k <= n]


def _filter(p: DataFrame, patterns: int, lengths: list[int]) -> tuple[int, np.ndarray]:
    """Bits, a power of two, and the filter's words."""
    bits = FILTER_BITS
    while bits < min(32 * patterns, MOST_FILTER_BITS):
        bits *= 2
    levels = sorted({f for n in lengths for f in firsts(n)})

    def places(batches):
        w = Windows()
        for b in batches:
            texts = b.column(0).to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            sums, at = w.sums("".join(texts)), np.cumsum(sizes) - sizes
            out = [_place(w.hashes(sums, at, sizes), bits, k) for k in WHOLE]
            for f in levels:
                led = (sizes >= f) if f >= ANCHOR else (sizes == f)
                out += [_place(w.hashes(sums, at[led], f), bits, k) for k in FIRST]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["_bit"])

    at = p.select("_pattern").mapInArrow(places, "_bit long")
    words = at.groupBy(F.floor(F.col("_bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int"))).alias("b")).toArrow()
    table = np.zeros(max(bits // 64, 1), np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    return bits, table.view(np.uint64)


def _held(t: DataFrame, p: DataFrame, runs: dict[str, int] | None = None) -> DataFrame:
    """_keys, _team, _pattern, _run of the texts' pieces that pass the filters of the patterns, each once for a text and
    each of the runs that the pattern's numbers are in (one, unless ``runs`` says more)."""
    spark, kinds = t.sparkSession, dict(t.dtypes)
    told = p.agg(F.count("*").alias("n"), F.collect_set(F.length("_pattern")).alias("lengths")).first()
    lengths = sorted(told.lengths)
    sent = spark.sparkContext.broadcast((lengths, *_filter(p, told.n, lengths), runs or {}))

    def pieces(batches):
        lengths, bits, table, runs = sent.value
        w = Windows()

        def passing(sums, at, n, shifts):
            h = w.hashes(sums, at, n)
            for k in shifts:
                place = _place(h, bits, k)
                there = (table[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                at, h = at[there], h[there]
            return at

        def found(texts):
            """(number of a text, piece) of those that pass, each once."""
            joined, sizes = "".join(texts), np.array([len(x) for x in texts], np.int64)
            stops, sums, begins, out = np.cumsum(sizes), w.sums(joined), {}, set()
            left = np.repeat(stops, sizes) - np.arange(len(joined))
            everywhere = np.arange(len(joined))
            for n in lengths:
                at = everywhere
                for f in firsts(n):
                    if f not in begins:
                        begins[f] = passing(sums, at[left[at] >= f], f, FIRST)
                    at = begins[f]
                at = passing(sums, at[left[at] >= n], n, WHOLE)
                out.update((i, joined[a : a + n]) for i, a in zip(np.searchsorted(stops, at, "right").tolist(), at.tolist()))
            return out

        def together(held):
            """Texts of a piece as one row, or a row for each RUN_KEYS of them, and all those once for each run."""
            keys, teams, found = (x.combine_chunks() for x in pa.Table.from_batches(held).columns)
            codes = [x.dictionary_encode().indices.to_numpy().astype(np.int64) for x in (found, teams)]
            _, piece, sizes = np.unique(codes[0] * (codes[1].max() + 1) + codes[1], return_inverse=True, return_counts=True)
            order = np.argsort(piece, kind="stable")
            piece = piece[order]
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            starts = np.flatnonzero((np.arange(len(piece)) - np.repeat(first, sizes[piece[first]])) % RUN_KEYS == 0)
            of = pa.array(order[starts])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(piece)), pa.int32()), keys.take(pa.array(order)))
            teams, found = teams.take(of), found.take(of)
            times = np.array([runs.get(x, 1) for x in found.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(starts)), times)
            run = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(row), SENT_ROWS):
                of = pa.array(row[a : a + SENT_ROWS])
                yield pa.RecordBatch.from_arrays([lists.take(of), teams.take(of), found.take(of), pa.array(run[a : a + SENT_ROWS], pa.int32())], names=["_keys", "_team", "_pattern", "_run"])

        held, n, chars = [], 0, 0
        for b in batches:
            texts, a = b.column(2).to_pylist(), 0
            while a < len(texts):
                z, size = a + 1, len(texts[a])
                while z < len(texts) and size + len(texts[z]) <= BLOCK_CHARS:
                    size += len(texts[z])
                    z += 1
                if out := found(texts[a:z]):
                    rows = pa.array([a + i for i, _ in out], pa.int32())
                    held.append(pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([x for _, x in out], pa.string())], names=["_key", "_team", "_pattern"]))
                    n, chars = n + len(out), chars + sum(len(x) for _, x in out)
                a = z
                if n >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield from together(held)
                    held, n, chars = [], 0, 0
        if held:
            yield from together(held)

    return t.select("_key", "_team", "_text").mapInArrow(pieces, f"_keys array<{kinds['_key']}>, _team {kinds['_team']}, _pattern string, _run int")


def _often(t: DataFrame, p: DataFrame) -> DataFrame:
    """_team, _pattern of the pieces that most texts hold, as one of LOOK texts tell, and _texts of those that do; their
    patterns are of up to BROADCAST_CHARS characters."""
    seen = _held(t.where(F.pmod(F.xxhash64("_key"), F.lit(LOOK)) == 0), p).groupBy("_team", "_pattern").agg(F.sum(F.size("_keys")).alias("_texts")).where(F.col("_texts") >= OFTEN)
    own = p.groupBy("_team", "_pattern").agg(F.count("*").alias("_n"))
    # a piece that only other teams look for has no pattern here, and need not travel either
    seen = written(seen.join(own, ["_team", "_pattern"], "left").select("_team", "_pattern", "_texts", ((F.length("_pattern") + 8) * F.greatest(F.lit(1), F.coalesce("_n", F.lit(0)))).alias("_size")), "often")
    left, least, step = BROADCAST_CHARS, 1 << 62, F.floor(F.log2("_texts") * 4)
    for r in seen.groupBy(step.alias("step")).agg(F.sum("_size").alias("size")).orderBy(F.desc("step")).collect():
        left -= r.size
        if left < 0:
            break
        least = r.step
    return seen.where(step >= least).select("_team", "_pattern", "_texts")


def _by_pieces(t: DataFrame, p: DataFrame) -> DataFrame:
    p = written(p.distinct(), "patterns")
    often = F.broadcast(_often(t, p))
    there, rest = (p.join(often, ["_team", "_pattern"], how) for how in ("left_semi", "left_anti"))
    cut = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(RUN)), lambda a: F.slice("_all", a, F.lit(RUN)))
    numbers = there.groupBy("_team", "_pattern").agg(F.sort_array(F.collect_list(F.struct("_no"))).alias("_all")).select("_team", "_pattern", F.posexplode(cut).alias("_run", "_numbers"))
    # a task makes all rows of a row and its match at once, so texts meet a pattern's numbers run by run
    many = there.groupBy("_team", "_pattern").count().where(F.col("count") > RUN).groupBy("_pattern").agg(F.max("count").alias("n")).collect()
    tasks = -(-(there.join(often, ["_team", "_pattern"]).agg(F.sum("_texts")).first()[0] or 0) * LOOK // TASK_ROWS)
    run, tasks = ["_team", "_pattern", "_run"], max(tasks, t.sparkSession.sparkContext.defaultParallelism)
    at_once = _held(t, there, {r["_pattern"]: -(-r["n"] // RUN) for r in many}).repartition(tasks, *run).sortWithinPartitions(*run)
    at_once = at_once.join(F.broadcast(numbers), run).select(F.explode("_keys").alias("_key"), "_numbers").select("_key", F.inline("_numbers"))
    # a pattern of many numbers goes to many tasks, each with some of the texts
    hot = rest.groupBy("_team", "_pattern").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * HOT).select("_team", "_pattern", F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / HOT)).cast("int").alias("_parts"))
    parts = lambda d: d.join(F.broadcast(hot), ["_team", "_pattern"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    held = _held(t, rest).join(often, ["_team", "_pattern"], "left_anti").select(F.explode("_keys").alias("_key"), "_team", "_pattern")
    held = parts(held).withColumn("_part", F.pmod(F.xxhash64("_key"), "_parts").cast("int"))
    travelled = held.join(parts(rest).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), ["_team", "_pattern", "_part"]).select("_key", "_no")
    once = t.groupBy("_key").count().where("count > 1").isEmpty() and p.groupBy("_no").count().where("count > 1").isEmpty()
    met = at_once.unionByName(travelled)
    return met if once else met.distinct()
