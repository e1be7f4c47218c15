"""The mapping of a conversation as keyed state with a sliding time to live."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mask import FAMILY

TTL_MS = 3_600_000


class MappingStore(StatefulProcessor):
    """Rows with a placeholder store a pair; rows without one ask for it. An answer writes the pair again, which
    re-arms its time to live, as reads alone would not."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getMapState("pairs", "original string", "placeholder string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")
        for r in batch.itertuples(index=False):
            if r.placeholder is not None:
                self.pairs.updateValue((r.original,), (r.placeholder,))
            else:
                found = self.pairs.getValue((r.original,))[0] if self.pairs.containsKey((r.original,)) else None
                if found is not None:
                    self.pairs.updateValue((r.original,), (found,))
                out.append((key[0], r.seq, r.original, found))
        if out:
            yield pd.DataFrame(out, columns=["conversation_id", "seq", "original", "placeholder"])

    def close(self) -> None:
        pass


def stored(rows: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """rows (conversation_id, seq, original, placeholder or null) -> the answers to rows without a placeholder."""
    return rows.groupBy("conversation_id").transformWithStateInPandas(MappingStore(ttl_ms), "conversation_id string, seq long, original string, placeholder string", "append", "processingTime")


class AllocatingStore(StatefulProcessor):
    """Placeholders of a conversation, one to one, allocated as rows come and kept in both directions.

    A row (original, wanted, literals) forbids its literals and is answered with the original's placeholder: the one
    it has, else the wanted one, else, where that is taken or forbidden, the family's lowest free number. A row
    without an original asks which original its placeholder stands for. Every use re-arms a pair's time to live; what
    has expired is free again, in both directions."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of = handle.getMapState("of", "original string", "placeholder string", self.ttl_ms)
        self.back = handle.getMapState("back", "placeholder string", "original string", self.ttl_ms)
        self.barred = handle.getMapState("barred", "literal string", "there boolean", self.ttl_ms)
        self.next = handle.getMapState("next", "family string", "n long", self.ttl_ms)

    @staticmethod
    def _value(state, key):
        return state.getValue((key,))[0] if state.containsKey((key,)) else None

    def _put(self, original: str, placeholder: str) -> None:
        self.of.updateValue((original,), (placeholder,))
        self.back.updateValue((placeholder,), (original,))

    def _free(self, placeholder: str) -> bool:
        return not self.back.containsKey((placeholder,)) and not self.barred.containsKey((placeholder,))

    def _allocated(self, wanted: str) -> str:
        if self._free(wanted):
            return wanted
        m = re.match(FAMILY, wanted)
        family = m[1] if m else "REDACTED"
        n = self._value(self.next, family) or 1
        while not self._free(f"[{family}_{n:03d}]"):
            n += 1
        self.next.updateValue((family,), (n + 1,))
        return f"[{family}_{n:03d}]"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in batch.itertuples(index=False):
            for x in r.literals if r.literals is not None else ():
                self.barred.updateValue((x,), (True,))
            if r.original is None:
                original, placeholder = self._value(self.back, r.wanted), r.wanted
            else:
                original, placeholder = r.original, self._value(self.of, r.original) or self._allocated(r.wanted)
            if original is not None:
                self._put(original, placeholder)
            out.append((key[0], r.seq, original, placeholder))
        yield pd.DataFrame(out, columns=["conversation_id", "seq", "original", "placeholder"])

    def close(self) -> None:
        pass


def allocated(rows: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """rows (conversation_id, seq, original or null, wanted, literals array<string> or null) of a stream -> a row each:
    conversation_id, seq, original, placeholder. Rows of a conversation come in the order of seq, over any
    micro-batches; the pairs are then those of ``mask.allocate`` over the whole, if literals come before what they
    bar. A placeholder that stands for nothing is answered with a null original."""
    d = rows.select("conversation_id", "seq", "original", "wanted", "literals")
    return d.groupBy("conversation_id").transformWithStateInPandas(AllocatingStore(ttl_ms), "conversation_id string, seq long, original string, placeholder string", "append", "processingTime")
