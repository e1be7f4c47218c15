"""Tokenization by public vocabularies, best-fit packing, and an id file with Elias-Fano boundaries."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, plain, table, text_batches, unused, written

#: Bytes of words and their ids that a worker remembers, twice; what an entry takes besides; and the longest word.
CACHED_BYTES, ENTRY_BYTES, CACHED_CHARS = 64 << 20, 200, 64
#: Characters of text that are split into words at once.
AT_ONCE = 4_000_000
CAPACITY = 4096
#: Ids of one file.
SHARD_IDS = 4_000_000
#: Documents of a file that are read at once.
READ_DOCS = 4_096


#: Byte-level vocabularies write a byte as the character of its code if that is visible, else as the next one from
#: U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


_SPACE = chr(_ALPHABET[32])
_MARKS = ".,;:!?|#$%&*"


class Encoder:
    """batch(texts): the ids of each text as little-endian uint32 bytes, equal to the library's for the whole text
    with ``add_special_tokens=False``: strings of special tokens in a text give their special ids, unless
    ``special_as_text``.

    Both vocabularies split texts into words before they merge bytes, so the ids of a text are those of its words
    in order; the distinct words of a batch are found by a dictionary, each is encoded once by the library and
    remembered. ``spaced`` vocabularies drop white space, others keep it with the word that follows. Texts with
    characters that Python and the library do not both hold for white space, with a string of a special token, or
    with U+0000, which here marks words without a space before them, are encoded whole."""

    _CHUNK, _ODD = re.compile(r" ?\S+|\s+(?!\S)|\s+"), re.compile("[\x00\x1c-\x1f\x85\u180e]")
    #: White space other than space and line end.
    _OTHER = re.compile("[\t\r\x0b\x0c\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _of: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = {re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(sorted(special)), re.IGNORECASE) if special and not special_as_text else None
        self.spaced = self.tokenizer.normalizer is not None
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the words that get there are new
        self.known, self.old, self.after, self.held = {}, {}, {}, 0

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> "Encoder":
        """The worker's own one, which later tasks use again."""
        if (path, special_as_text) not in cls._of:
            cls._of[path, special_as_text] = cls(path, special_as_text)
        return cls._of[path, special_as_text]

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it, or without one if it is marked. Words of Latin letters are one
        piece for both vocabularies, so they can go straight to the library's model: in its alphabet for bytes and,
        where it drops white space, in lower case."""
        before, word = ("", word.removeprefix("\0")) if self.spaced or word[:1] == "\0" else (" ", word)
        if not word.isalpha():
            return self.whole(before + word)
        low = word.lower() if self.spaced else word
        if low.isascii():
            written = _SPACE + low if before else low
        elif max(low) < "\u0250" and low.isalpha():
            written = (before + low).encode().decode("latin-1").translate(_ALPHABET)
        else:
            return self.whole(before + word)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def alone(self, text: str) -> bytes:
        """Ids of one text."""
        if self._ODD.search(text) or self.special and self.special.search(text):
            return self.whole(text)
        return b"".join(self.units(text.split() if self.spaced else [x[1:] if x[:1] == " " and not x.isspace() else "\0" + x for x in self._CHUNK.findall(text)]))

    def plain(self, text: str) -> str | None:
        """The text as words that single spaces part, if that is all that parts them; words without a space before
        them are marked, and a line end is a word. None for a text that has to be encoded alone."""
        if "<|" in text or self._ODD.search(text) or self._OTHER.search(text):
            return None
        if self.spaced:
            flat = text.replace("\n", " ")
            return " ".join(flat.split(" ")) if "  " not in flat and flat[:1] != " " and flat[-1:] != " " else " ".join(flat.split())
        flat = text.replace("\n", " ")
        if "  " in flat or flat[:1] == " " or flat[-1:] == " ":
            return None
        return "\0" + text.replace("\n", " \0\n \0")

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of words. Words with marks at their end are put together from the word and the marks, which both
        vocabularies keep apart. What was met since the last clearing, and before it, is remembered."""
        known, old = self.known, self.old
        out = list(map(known.get, units))
        for k in [k for k, x in enumerate(out) if x is None]:
            unit = units[k]
            if (ids := old.get(unit)) is None:
                core = unit.rstrip(_MARKS)
                if len(core) < len(unit) and core[-1:].isalnum():
                    if (ids := known.get(core) or old.get(core)) is None:
                        ids = self.word(core)
                        if len(core) <= CACHED_CHARS:
                            known[core] = ids
                            self.held += len(core) + len(ids) + ENTRY_BYTES
                    ids += self.marks(unit[len(core) :])
                else:
                    ids = self.word(unit)
            out[k] = ids
            if len(unit) <= CACHED_CHARS:
                known[unit] = ids
                self.held += len(unit) + len(ids) + ENTRY_BYTES
        if self.held > CACHED_BYTES:
            self.known, self.old, self.held = {}, known, 0
        return out

    def marks(self, marks: str) -> bytes:
        if (ids := self.after.get(marks)) is None:
            ids = self.whole(marks)
            if len(marks) < 3:
                self.after[marks] = ids
        return ids

    def batch(self, texts: list[str | None]):
        """The ids of each text, in order; at most AT_ONCE characters (or one text) are taken at once."""
        a, held = 0, 0
        for z, text in enumerate(texts):
            if held and held + len(text or "") > AT_ONCE:
                yield from self.some(texts[a:z])
                a, held = z, 0
            held += len(text or "")
        yield from self.some(texts[a:])

    def some(self, texts: list[str | None]) -> list[bytes]:
        flat = [self.plain(t) if t else None for t in texts]
        joined = [x for x in flat if x]
        if not joined:
            return [self.alone(t) if t else b"" for t in texts]
        split = pc.split_pattern(pa.array(joined, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        coded = self.units(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, start, at = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(size) - size, words.indices.to_numpy()
        n, first = size[at], np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(start[at] - ends[:-1], n)
        where += np.arange(len(where))
        data, cut = memoryview(ids[where].tobytes()), iter((4 * ends[first]).tolist())
        out, a = [], next(cut)
        for t, x in zip(texts, flat):
            if x:
                z = next(cut)
                out.append(bytes(data[a:z]))
                a = z
            else:
                out.append(self.alone(t) if t else b"")
        return out


def gathered(batches, text_at: int = 1, rows: int = 8192):
    """Batches put together to AT_ONCE characters of text or so many rows, as a batch of few short texts costs as
    much to look up as one of many."""
    held, chars, n = [], 0, 0
    for b in batches:
        own = pc.sum(pc.utf8_length(b.column(text_at))).as_py() or 0
        if held and (chars + own > AT_ONCE or n + b.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks()
            held, chars, n = [], 0, 0
        held, chars, n = [*held, b], chars + own, n + b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ------------------------------------------------------------------ packing


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32 for each piece: a document's ids and ``end_id``, cut only where longer
    than ``capacity``. Null text counts as empty and gives the end id alone; repeated rows and null ids are kept,
    other columns are dropped, and an empty table gives no piece."""
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encoder, end = Encoder.of(path), np.array([end_id], "<u4").tobytes()
        for b in gathered(batches):
            rows: list[list] = [[], [], [], [], []]
            for k, own in enumerate(encoder.batch(b.column(1).to_pylist())):
                ids = own + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, x in zip(rows, (k, p, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).combine_chunks().take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:]]], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Bins for items of which only the number of each length is known, by large-item matching.

    Items above a third of the capacity are matched, at most two to a bin: those above a half open a bin each, the
    others go from the largest down to the tightest such bin, and what is left pairs up. Smaller items then go, from the
    largest down, to the tightest gap, or open a bin. Items of one length are alike, and so are bins of one room, so
    each step places as many as there are at once: the plan has a row for a run of items and bins and not for each."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.n = capacity, 0
        self.rows: list[tuple[int, int, int, int]] = []  # length, number of the first item of it, first bin, offset
        self.done = [0] * (capacity + 1)
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first bin, bins)
        self.mask = 0
        sizes = [(int(s), int(counts[s])) for s in np.flatnonzero(counts)[::-1].tolist()]
        for size, c in (x for x in sizes if 2 * x[0] > capacity):
            self._open(size, c, 1)
        self._matched([x for x in sizes if 2 * x[0] <= capacity < 3 * x[0]])
        for size, c in (x for x in sizes if 3 * x[0] <= capacity):
            self._filled(size, c)

    def _place(self, size: int, bins: int, first: int, offset: int) -> None:
        """One item more in each of some bins that follow each other."""
        self.rows.append((size, self.done[size], first, offset))
        self.done[size] += bins

    def _free(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.gaps[room].append((first, bins))
            self.mask |= 1 << room

    def _tightest(self, need: int) -> tuple[int, int, int] | None:
        """Room, first bin and number of some bins with the least room that is enough, which are then taken."""
        above = self.mask >> need
        if not above:
            return None
        room = need + (above & -above).bit_length() - 1
        first, bins = self.gaps[room].pop()
        if not self.gaps[room]:
            self.mask &= ~(1 << room)
        return room, first, bins

    def _into(self, size: int, c: int, each: int, room: int, first: int, bins: int) -> int:
        """Puts up to ``each`` items into each bin; the number of items that are left."""
        full, rest = min(bins, c // each), 0
        for j in range(each if full else 0):
            self._place(size, full, first, self.capacity - room + j * size)
        self._free(room - each * size, first, full)
        c -= full * each
        if c and full < bins:
            rest, c = c, 0
            for j in range(rest):
                self._place(size, 1, first + full, self.capacity - room + j * size)
            self._free(room - rest * size, first + full, 1)
            full += 1
        self._free(room, first + full, bins - full)
        return c

    def _open(self, size: int, c: int, each: int) -> None:
        bins = -(-c // each)
        first, self.n = self.n, self.n + bins
        if bins:
            self._into(size, c, each, self.capacity, first, bins)

    def _matched(self, sizes: list[tuple[int, int]]) -> None:
        met: list[tuple[int, int, int]] = []  # bins with two items: they stay out until all large items are placed
        alone = None  # the bin of an item that waits for a second one, and its room
        for size, c in sizes:
            while c and (hit := self._tightest(size)):
                room, first, bins = hit
                m = min(c, bins)
                self._place(size, m, first, self.capacity - room)
                met.append((room - size, first, m))
                self._free(room, first + m, bins - m)
                c -= m
            if c and alone:
                which, room = alone
                self._place(size, 1, which, self.capacity - room)
                met.append((room - size, which, 1))
                alone, c = None, c - 1
            pairs = c // 2
            if pairs:
                self._place(size, pairs, self.n, 0)
                self._place(size, pairs, self.n, size)
                met.append((self.capacity - 2 * size, self.n, pairs))
                self.n += pairs
            if c % 2:
                self._place(size, 1, self.n, 0)
                alone, self.n = (self.n, self.capacity - size), self.n + 1
        for room, first, bins in met + ([(alone[1], alone[0], 1)] if alone else []):
            self._free(room, first, bins)

    def _filled(self, size: int, c: int) -> None:
        while c and (hit := self._tightest(size)):
            c = self._into(size, c, hit[0] // size, *hit)
        if c:
            self._open(size, c, self.capacity // size)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Length, first number, first bin and offset of the runs, by length and number."""
        t = np.array(self.rows, np.int64).reshape(-1, 4)
        return tuple(t[np.lexsort((t[:, 1], t[:, 0]))].T)


class Places:
    """Where the k-th item of a length goes."""

    def __init__(self, table: tuple[np.ndarray, ...]):
        self.length, self.number, self.bin, self.offset = table
        self.starts = np.searchsorted(self.length, np.arange(int(self.length[-1]) + 2 if len(self.length) else 1))

    def of(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            a, z = self.starts[size], self.starts[size + 1]
            at[own] = a + np.searchsorted(self.number[a:z], k[own], "right") - 1
        return self.bin[at] + k - self.number[at], self.offset[at]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    order = np.argsort(lengths, kind="stable")
    s = lengths[order]
    k = np.empty(len(s), np.int64)
    k[order] = np.arange(len(s)) - np.searchsorted(s, s)
    return Places(Plan(np.bincount(lengths, minlength=capacity + 1), capacity).table()).of(lengths, k)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces; all are packed together, however many there are.

    Pieces of one length are alike, so the bins of all are planned from the number of pieces of each length, of which
    there are at most ``capacity``. Which of a length a piece is, is its number in its task plus those of the tasks
    before it: tasks write their numbers down, counts by task and length are added up along the tasks, and an equi-join
    brings the sums back. So no piece has to meet another one; the driver gets the counts and the plan's runs, a few
    for each pair of lengths at most. Other columns pass through, but those named like the added ones give way; an
    empty table gives an empty result."""
    parts = plain(parts, "sequence_id", "offset")
    columns, kinds = parts.columns, dict(parts.dtypes)
    task, nth, before, n = unused(parts, "_task", "_nth", "_before", "_n")
    at = columns.index("length")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def numbered(batches):
        met, own = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            length = b.column(at).to_numpy()
            order = np.argsort(length, kind="stable")
            s = length[order]
            k = np.empty(len(s), np.int64)
            k[order] = met[s] + np.arange(len(s)) - np.searchsorted(s, s)
            met += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), own, np.int32)), pa.array(k)], names=[*columns, task, nth])

    rows = written(parts.mapInArrow(numbered, f"{schema}, `{task}` int, `{nth}` long"), "numbered")
    counts = rows.groupBy(task, "length").agg(F.count("*").alias(n))
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum(n).alias("n")).collect():
        total[r.length] = r.n
    sent = parts.sparkSession.sparkContext.broadcast(Plan(total, capacity).table())
    earlier = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(task, "length", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    out = rows.join(sums, [task, "length"]).select(*[F.col(f"`{c}`") for c in columns], (F.col(nth) + F.col(before)).alias(nth))

    def placed(batches):
        places = Places(sent.value)
        for b in batches:
            which, offset = places.of(b.column(at).to_numpy(), b.column(len(columns)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(which), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return out.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def op4_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(written(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces"))


# ------------------------------------------------------------------ id files

_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _r] = _p


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**63. The low bits are packed side by side, the
    rest is written in unary. For each block of 512 bits of the unary part the number of ones before it is stored in
    32 bits; ``select`` finds an element's block there and counts on in the block alone."""

    BLOCK = 64  # bytes

    def __init__(self, n: int, low: int, before: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.before, self.lows, self.highs = n, low, before, lows, highs

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        if n >= 2**32:
            raise ValueError("a sequence of at most 2**32 - 1 elements")
        most = int(values[-1]) if n else 0
        low = max(0, (most // n).bit_length() - 1) if n else 0
        at = (values >> low) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // (8 * cls.BLOCK)) * 8 * cls.BLOCK, np.uint8)
        bits[at] = 1
        highs = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(highs).reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)
        planes = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        return cls(n, low, (np.cumsum(ones) - ones).astype("<u4"), np.packbits(planes, bitorder="little"), highs)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Elements i: the i-th one bit of the unary part gives the high bits."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        rest = i - self.before[block]
        ones = np.bitwise_count(self.highs.reshape(-1, self.BLOCK)[block]).cumsum(1, dtype=np.int16)
        byte = (ones <= rest[:, None]).sum(1)
        rest -= np.where(byte > 0, np.take_along_axis(ones, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        byte += block * self.BLOCK
        value = (byte * 8 + _SELECT[self.highs[byte], rest] - i) << self.low
        for k in range(self.low):
            p = i * self.low + k
            value |= ((self.lows[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return value

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low, len(self.lows), len(self.highs)) + self.before.tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple["EliasFano", int]:
        n, low, a, b = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        blocks = b // cls.BLOCK
        before = np.frombuffer(data, "<u4", blocks, at)
        at += 4 * blocks
        view = np.frombuffer(data, np.uint8)
        return cls(n, low, before, view[at : at + a], view[at + a : at + a + b]), at + a + b


MAGIC = b"MFIDS002"


class IdFile:
    """One shard: magic; bytes of an id (2 or 4), documents, documents with a null id, ids, the least document id;
    Elias-Fano sequences of document ids (less the least one) and of id boundaries (documents + 1 of them); ids."""

    @staticmethod
    def dump(doc_ids: list, ends: list[int], ids: bytes, width: int) -> bytes:
        nulls = sum(x is None for x in doc_ids)
        own = np.array([x for x in doc_ids if x is not None], np.int64)
        least = int(own[0]) if len(own) else 0
        body = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
        return MAGIC + struct.pack("<BQQQq", width, len(doc_ids), nulls, len(ids) // 4, least) + EliasFano.of(own - least).dump() + EliasFano.of(np.array([0, *ends], np.int64)).dump() + body

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an id file")
        self.width, self.docs, self.nulls, self.n_ids, self.least = struct.unpack_from("<BQQQq", data, 8)
        self.own, at = EliasFano.load(data, 8 + struct.calcsize("<BQQQq"))
        self.bounds, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def doc_ids(self, first: int, last: int) -> list:
        """Ids of documents first to last - 1; those with a null id come first."""
        some = np.arange(max(0, first - self.nulls), max(0, last - self.nulls))
        return [None] * max(0, min(last, self.nulls) - first) + (self.own.select(some) + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(np.array([i, i + 1]))
        return self.ids[a:b]


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode texts, in ascending order of an integer id (nulls first, ties by text), into files of at most about
    ``shard_ids`` ids (or one document) in the folder ``out``, a URI that pyarrow's filesystems and Spark both
    read. Returns the manifest, already written: shard, seq, docs, ids, start (ids of all files before it).

    Ids are range-partitioned, so files follow each other in order; ties are spread by a hash of the text. A file
    appears under its name only when whole, and a task that runs again writes the same file again."""
    spark = docs.sparkSession
    text_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("_h"))
    d = d.repartitionByRange("id", "_h").sortWithinPartitions("id", "_h", "text")

    def run(batches):
        encoder, end = Encoder.of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(out)
        part, seq = TaskContext.get().partitionId(), 0
        ids, parts, ends, n = [], [], [], 0

        def flush():
            nonlocal ids, parts, ends, n, seq
            data = IdFile.dump(ids, ends, b"".join(parts), 4 if encoder.wide else 2)
            tmp, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/shard-{part:06d}-{seq:06d}.bin"
            with store.open_output_stream(tmp) as f:
                f.write(data)
            store.move(tmp, name)
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, seq, len(ids), n)], names=["shard", "seq", "docs", "ids"])
            ids, parts, ends, n, seq = [], [], [], 0, seq + 1
            return row

        store.create_dir(root, recursive=True)
        for b in gathered(batches):
            for i, own in zip(b.column(0).to_pylist(), encoder.batch(b.column(1).to_pylist())):
                got = own + end
                if ids and n + len(got) // 4 > shard_ids:
                    yield flush()
                n += len(got) // 4
                ids.append(i)
                parts.append(got)
                ends.append(n)
        if ids:
            yield flush()

    files = written(d.mapInArrow(run, "shard long, seq long, docs long, ids long"), "manifest")
    # sums along the files of a task, and along the tasks: what one task sorts has a row for each of them
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tasks = files.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", before(Window.orderBy("shard")).alias("_first"))
    placed = files.withColumn("_within", before(Window.partitionBy("shard").orderBy("seq"))).join(F.broadcast(tasks), "shard")
    return placed.select(*files.columns, (F.col("_first") + F.col("_within")).alias("start"))


def read_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, read back by Spark. No file: no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path) if manifest.limit(1).count() else None
    schema = "shard long, seq long, doc_id long, _from long, n_tokens long, ids_crc32 long"
    if files is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                shard, seq = map(int, re.search(r"shard-(\d+)-(\d+)\.bin$", path).groups())
                f = IdFile(content.as_py())
                for first in range(0, f.docs, READ_DOCS):
                    last = min(first + READ_DOCS, f.docs)
                    bounds = f.bounds.select(np.arange(first, last + 1))
                    ids = memoryview(f.ids[bounds[0] : bounds[-1]].astype("<u4").tobytes())
                    at = (4 * (bounds - bounds[0])).tolist()
                    crc = [zlib.crc32(ids[a:z]) for a, z in zip(at[:-1], at[1:])]
                    n = last - first
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, seq)), pa.array(f.doc_ids(first, last), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["shard", "seq", "doc_id", "_from", "n_tokens", "ids_crc32"])

    rows = files.select("path", "content").mapInArrow(run, schema)
    return rows.join(manifest.select("shard", "seq", "start"), ["shard", "seq"]).select("doc_id", (F.col("start") + F.col("_from")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = fresh_path(spark, "ids")
    out = out if "://" in out else "file://" + out.removeprefix("file:")
    return read_ids(spark, out, write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out))
