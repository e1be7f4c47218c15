"""Named entities by models that the caller brings, and the union of several."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, spans

# Labels of the two usual model families, and the score of a finding
RUSSIAN = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORG"}
ENGLISH = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION"}
SCORE = 0.8
UNAVAILABLE = "E_NER_UNAVAILABLE"

Entities = list[tuple[str, int, int]]


def entities(df: DataFrame, load: Callable[[], Callable[[list[str]], list[Entities]]], labels: dict[str, str], text: str = "text", out: str = "entities", order: int = 0) -> DataFrame:
    """``df`` plus findings of a model: ``load`` runs once per task and gives a function from texts to their entities
    (label, start, stop in code points). Labels that ``labels`` lacks are left out, blank texts are not asked about,
    null counts as blank. Where the model is not there (RuntimeError at loading or use) the findings are null.
    ``order`` breaks ties between models. A column named like ``out`` gives way to it."""
    names = [c for c in df.columns if c.lower() != out.lower()]
    kinds = dict(df.dtypes)
    at = names.index(text)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("ord", pa.int32()), ("text", pa.string())]))

    def run(batches):
        model, there = None, True
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            asked = [k for k, t in enumerate(texts) if t.strip()]
            found: list = [[] for _ in texts]
            if asked and there:
                try:
                    model = model or load()
                    for k, own in zip(asked, model([texts[k] for k in asked])):
                        found[k] = [{"label": labels[label], "start": a, "stop": z, "score": SCORE, "ord": len(patterns.RULES) + 10 + order, "text": texts[k][a:z]} for label, a, z in own if label in labels]
                except RuntimeError:
                    there = False
            if not there:
                for k in asked:
                    found[k] = None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, out])

    return df.select(*names).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{out}` {spans.FINDING}")


def united(*engines: Column, required: bool = False) -> Column:
    """Findings of all engines without overlaps. An engine that is not there (null) is passed over, or, if engines
    are required, makes the union null: the caller then refuses the text with UNAVAILABLE."""
    none = F.array().cast(spans.FINDING)
    all_ = spans.without_overlaps(F.concat(*[F.coalesce(e, none) for e in engines]))
    if not required:
        return all_
    missing = F.lit(False)
    for e in engines:
        missing = missing | e.isNull()
    return F.when(~missing, all_)
