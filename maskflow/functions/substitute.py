"""Many replacements in one text, as if made one after the other, longest first."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Replacements that are made one by one, natively; more go through an automaton.
FEW = 16


def in_turn(pairs: Iterable[tuple[str, str]], by_text: bool = False) -> list[tuple[str, str]]:
    """(what, by) in the order of replacement: longest first, then as given or, ``by_text``, by text."""
    return sorted((p for p in pairs if p[0]), key=lambda p: (-len(p[0]), p[0] if by_text else ""))


def _starts(ordered: list[str], what: str) -> bool:
    at = bisect_left(ordered, what)
    return at < len(ordered) and ordered[at].startswith(what)


def touching(pairs: list[tuple[str, str]], automaton) -> bool:
    """Whether some text to be replaced could stand in what another one is replaced by, or across its border: a
    replacement made later would then change what an earlier one put in."""
    into = {z for _, z in pairs}
    if "" in into or any(True for _ in automaton.iter("\0".join(into))):
        return True
    sizes = sorted({len(z) for z in into})
    for turned in (False, True):  # across the left border, and, read from behind, across the right one
        ends = sorted(z[::-1] for z in into) if turned else sorted(into)
        there, heads = set(ends), {z[0] for z in ends}
        for a, _ in pairs:
            a = a[::-1] if turned else a
            for at, c in enumerate(a):
                if c in heads and (_starts(ends, a[at:]) or any(a[at : at + n] in there for n in sizes if at + n <= len(a))):
                    return True
    return False


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    """``text`` after text.replace(what, by) for all pairs in turn.

    One automaton finds every place of every text; places are taken in the order of the pairs, then from the left,
    unless one taken before overlaps them, and the text is spliced once. Time is linear in the text and in the
    places. Only where ``touching`` says that order could show, replacements are made one by one."""
    if len(pairs) <= FEW:
        for a, z in pairs:
            text = text.replace(a, z)
        return text
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for rank, (a, _) in enumerate(pairs):
        if a not in automaton:
            automaton.add_word(a, rank)
    automaton.make_automaton()
    places = sorted((rank, end + 1 - len(pairs[rank][0])) for end, rank in automaton.iter(text))
    if not places:
        return text
    used = [pairs[r] for r in sorted({r for r, _ in places})]
    if touching(used, automaton):
        for a, z in pairs:
            text = text.replace(a, z)
        return text
    taken, cuts = bytearray(len(text)), []
    for rank, a in places:
        z = a + len(pairs[rank][0])
        if not taken[a] and not taken[z - 1]:  # what was taken before is as long or longer, so it covers an end
            taken[a:z] = b"\1" * (z - a)
            cuts.append((a, z, pairs[rank][1]))
    out, at = [], 0
    for a, z, by in sorted(cuts):
        out += (text[at:a], by)
        at = z
    return "".join([*out, text[at:]])


def dense(what: str, by: str) -> Callable[[Column, Column], Column]:
    """replaced() on columns: a text and its pairs, structs with the fields ``what`` and ``by``."""
    by_text = what == "placeholder"

    @F.arrow_udf("string")
    def run(texts: pa.Array, pairs: pa.Array) -> pa.Array:
        out = []
        for t, ps in zip(texts.to_pylist(), pairs.to_pylist()):
            out.append(None if t is None or ps is None else replaced(t, in_turn(((p[what], p[by]) for p in ps), by_text)))
        return pa.array(out, pa.string())

    return run
