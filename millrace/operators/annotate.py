"""Pluggable scorers: a prompt expression, a vectorised scorer and a parse expression make one annotation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Annotator:
    """``load`` runs once a task and gives a function from a list of texts to as many values."""

    name: str
    prompt: Column
    load: Callable[[], Callable[[list], Iterable]]
    kind: str = "double"
    parse: Callable[[Column], Column] = lambda c: c

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the annotation; a scorer that fails leaves its message in ``<name>_error`` and null for the batch."""
        keep, name, kind, load = rows.columns, self.name, self.kind, self.load
        held = rows.withColumn("__prompt", self.prompt.cast("string"))

        def run(batches):
            import pyarrow as pa

            scorer = load()
            value = {"double": pa.float64(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[kind]
            for batch in batches:
                try:
                    out, errors = list(scorer(batch.column(len(keep)).to_pylist())), [None] * len(batch)
                except Exception as e:  # noqa: BLE001  isolates one batch
                    out, errors = [None] * len(batch), [repr(e)] * len(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, value), pa.array(errors, pa.string())], names=[*keep, name, f"{name}_error"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        out = held.mapInArrow(run, f"{kinds + ', ' if kinds else ''}`{name}` {kind}, `{name}_error` string")
        return out.withColumn(name, self.parse(F.col(name)))


def language_of(profiles: dict[str, set[str]]) -> Callable[[], Callable]:
    """A small stand-in for a language model: the language whose function words are most frequent, with its share of them."""

    def load():
        def score(texts):
            out = []
            for t in texts:
                words = (t or "").lower().split()
                best = max(((sum(w in ws for w in words), lang) for lang, ws in sorted(profiles.items())), default=(0, ""))
                out.append(best[1] if best[0] else None)
            return out

        return score

    return load
