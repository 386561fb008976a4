"""Text encoders: ``encode(text column) -> array<float> column``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packfold.functions.hashing import md5_number
from packfold.functions.tokenizers import WORD_PATTERN, array_function

VECTOR = "array<float>"


class Encoder:
    def encode(self, text: Column | str) -> Column:
        raise NotImplementedError


class HashEncoder(Encoder):
    """Counts of word hashes modulo ``dimensions``. Words are cut and hashed in the JVM; the
    counts of a whole batch are one numpy call."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def slots(self, text: Column | str) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
        return F.transform(words, lambda w: F.pmod(md5_number(w), F.lit(self.dimensions)).cast("int"))

    def encode(self, text: Column | str) -> Column:
        dimensions = self.dimensions

        def count(slots):
            import numpy as np
            import pyarrow as pa

            rows, offsets = len(slots), slots.offsets.to_numpy()
            found = slots.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(rows), np.diff(offsets))
            counts = np.bincount(row * dimensions + found, minlength=rows * dimensions).astype(np.float32)
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * dimensions)
            return pa.ListArray.from_arrays(ends, pa.array(counts), mask=slots.is_null())

        return array_function(count, VECTOR)(self.slots(text))


class ModelEncoder(Encoder):
    """Any model: ``load()`` runs once per Python worker and returns ``list[str] -> 2-d array``.

    Workers keep what they loaded under ``name``, by default one of this encoder's own."""

    def __init__(self, load: Callable, batch_size: int = 128, name: str | None = None):
        self.load, self.batch_size = load, batch_size
        self.name = name or f"encoder-{uuid.uuid4().hex}"

    def encode(self, text: Column | str) -> Column:
        load, batch_size, name = self.load, self.batch_size, self.name

        def run(texts):
            import numpy as np
            import pyarrow as pa

            from packfold.functions.worker import kept

            model = kept(name, load)
            whole = [t if t is not None else "" for t in texts.to_pylist()]
            parts = [
                np.asarray(model(whole[i : i + batch_size]), np.float32) for i in range(0, len(whole), batch_size)
            ]
            if not parts:
                return pa.array([], pa.list_(pa.float32()))
            vectors = np.concatenate(parts)
            ends = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * vectors.shape[1])
            return pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()), mask=texts.is_null())

        return array_function(run, VECTOR)(text)
