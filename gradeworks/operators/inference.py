"""The boundary where models run on executors: encoders, recognisers and fine-tuned heads plug in here."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def applied(df: DataFrame, ident: str, column: str, load: Callable[[], Callable[[list], list]], schema: str = "vec array<float>", batch: int = 32) -> DataFrame:
    """``ident`` and the outputs of a model for each value of ``column``.

    ``load`` runs once a task, on the executor, and returns a function from a
    list of inputs to a list of outputs. Values come in batches of bounded size
    and nulls stay null without being given to the model.
    """
    kind = dict(df.dtypes)[ident]
    rows = df.select(ident, column)
    target = f"{ident} {kind}, {schema}"
    name, arrow = schema.split()[0], to_arrow_schema(StructType.fromDDL(schema)).field(0).type

    def work(batches):
        model = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                given = [(i, v) for i, v in enumerate(part.column(1).to_pylist()) if v is not None]
                out = [None] * part.num_rows
                if given:
                    model = model or load()
                    for (i, _), y in zip(given, model([v for _, v in given]), strict=True):
                        out[i] = y
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, arrow)], names=[ident, name])

    return rows.mapInArrow(work, target)
