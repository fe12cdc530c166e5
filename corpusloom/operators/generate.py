"""The hook for models that write text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


#: Texts that a model gets at a time, whatever Arrow batch they come in.
ASKED = 256


def generate(prompts: DataFrame, write: Callable[[list[str]], list[str]], text: str = "prompt", out: str = "answer") -> DataFrame:
    """prompts with what `write` gives for their texts. It is called with up to ASKED non-null texts at a time and
    returns one text for each; null texts get null. What is held is those and their answers. The model itself comes
    with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ASKED):
                batch = whole.slice(start, ASKED)
                texts = batch[text].to_pylist()
                asked = [t for t in texts if t is not None]
                said = iter(write(asked) if asked else [])
                answers = pa.array([None if t is None else next(said) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, answers], [*batch.schema.names, out])

    fields = [f for f in prompts.schema if f.name != out]
    return prompts.select(*[f.name for f in fields]).mapInArrow(run, StructType([*fields, StructField(out, StringType())]))
