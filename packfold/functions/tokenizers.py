"""Tokenizers as column functions: ``encode(text column) -> array<int> column``.

A tokenizer supplies functions between Arrow arrays; Spark runs them batch by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for counting and for n-grams are runs of letters, marks, digits and
# underscores, joined by an apostrophe or a full stop between two such runs.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"

IDS = "array<int>"


class Tokenizer:
    """What the operators need from a tokenizer. Subclasses supply ``_encode_array``."""

    bos_id: int = 1
    eos_id: int = 2
    bos_token: str = "<s>"
    _pad_id: int | None = None

    @property
    def pad_id(self) -> int:
        """Padding id; the end-of-sequence id when the tokenizer defines none."""
        return self.eos_id if self._pad_id is None else self._pad_id

    def _encoder(self, add_special_tokens: bool):
        """A function from an Arrow string array to an Arrow list<int32> array."""
        raise NotImplementedError

    def _decoder(self):
        """A function from an Arrow list<int32> array to an Arrow string array."""
        raise NotImplementedError

    def encode(self, text: Column | str, add_special_tokens: bool = False) -> Column:
        return array_function(self._encoder(add_special_tokens), IDS)(text)

    def array_encoder(self, add_special_tokens: bool = False):
        """The function from an Arrow string array to token arrays, for work inside tasks."""
        return self._encoder(add_special_tokens)

    def encode_each(self, texts: Column | str) -> Column:
        """Token ids of every string of an ``array<string>`` column, without exploding it."""
        encode = self._encoder(False)

        def encode_lists(lists):
            import pyarrow as pa

            offsets = lists.offsets
            first, last = offsets[0].as_py(), offsets[len(lists)].as_py()
            inner = encode(lists.values.slice(first, last - first))
            shifted = pa.array(offsets.to_numpy() - first, pa.int32())
            return pa.ListArray.from_arrays(shifted, inner, mask=lists.is_null())

        return array_function(encode_lists, f"array<{IDS}>")(texts)

    def decode(self, ids: Column | str) -> Column:
        """Text of a token array, special tokens left out."""
        return array_function(self._decoder(), "string")(ids)


def array_function(fn, returns: str):
    """A vectorized UDF from ``fn(array) -> array``, both Arrow arrays."""
    import pyarrow as pa

    (parameter,) = fn.__code__.co_varnames[: fn.__code__.co_argcount]
    fn.__annotations__ = {parameter: pa.Array, "return": pa.Array}
    return F.arrow_udf(fn, returns)


class ByteTokenizer(Tokenizer):
    """UTF-8 bytes shifted past the special ids; lossless."""

    _pad_id = 0
    shift = 3

    def _encoder(self, add_special_tokens: bool):
        shift, bos = self.shift, self.bos_id

        def encode(texts):
            import numpy as np
            import pyarrow as pa

            raw = texts.cast(pa.binary())
            count = len(raw)
            if count == 0:
                return pa.array([], pa.list_(pa.int32()))
            _, offset_buffer, data = raw.buffers()
            offsets = np.frombuffer(offset_buffer, np.int32, count + 1, raw.offset * 4)
            start, stop = int(offsets[0]), int(offsets[-1])
            ids = np.zeros(0, np.int32)
            if stop > start:
                ids = np.frombuffer(data, np.uint8, stop - start, start).astype(np.int32) + shift
            starts = offsets - start
            if add_special_tokens:
                ids = np.insert(ids, starts[:-1], bos)
                starts = starts + np.arange(count + 1, dtype=np.int32)
            return pa.ListArray.from_arrays(
                pa.array(starts, pa.int32()), pa.array(ids, pa.int32()), mask=raw.is_null()
            )

        return encode

    def _decoder(self):
        shift = self.shift

        def decode(lists):
            import numpy as np
            import pyarrow as pa

            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            kept = ids >= shift
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            data = (ids[kept] - shift).astype(np.uint8).tobytes()
            # shares the validity of the lists, so null ids decode to null text
            valid = np.packbits(np.array(lists.is_valid()), bitorder="little").tobytes()
            return pa.StringArray.from_buffers(
                len(lists),
                pa.py_buffer(ends[offsets - offsets[0]].tobytes()),
                pa.py_buffer(data),
                pa.py_buffer(valid),
            )

        return decode


class WordTokenizer(Tokenizer):
    """Ids of words in a vocabulary ordered by frequency; other words share one unknown id.

    The vocabulary has a size limit by construction (``learn``), so it travels with the task.
    """

    _pad_id = 0
    unknown_id = 3
    shift = 4

    def __init__(self, vocabulary: Sequence[str], pattern: str = WORD_PATTERN):
        self.vocabulary = list(vocabulary)
        self.pattern = pattern

    @classmethod
    def learn(cls, df: DataFrame, column: str, size: int = 32_000, pattern: str = WORD_PATTERN) -> WordTokenizer:
        """The ``size`` most frequent words, ties in word order.

        Counting is a map-side combined aggregate; only the ``size`` winners reach the driver.
        """
        word = F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("word")
        counted = df.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
        return cls([row.word for row in top], pattern)

    def words(self, text: Column | str) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def encode(self, text: Column | str, add_special_tokens: bool = False) -> Column:
        """Words are cut in the JVM; Python only looks up ids, a whole batch at a time."""
        vocabulary, unknown, shift = self.vocabulary, self.unknown_id, self.shift

        def look_up(lists):
            import pyarrow as pa
            import pyarrow.compute as pc

            known = pa.array(vocabulary, pa.string())
            at = pc.fill_null(pc.index_in(lists.values.cast(pa.string()), value_set=known), unknown - shift)
            ids = pc.add(at, pa.scalar(shift, pa.int32()))
            return pa.ListArray.from_arrays(lists.offsets, ids, mask=lists.is_null())

        ids = array_function(look_up, IDS)(self.words(text))
        return F.concat(F.array(F.lit(self.bos_id)), ids) if add_special_tokens else ids

    def _encoder(self, add_special_tokens: bool):
        vocabulary, unknown, shift, pattern = self.vocabulary, self.unknown_id, self.shift, self.pattern

        def encode(texts):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc
            import regex

            found = [regex.findall(pattern, t) if t is not None else [] for t in texts.to_pylist()]
            ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            flat = pa.array([w for f in found for w in f], pa.string())
            known = pa.array(vocabulary, pa.string())
            at = pc.fill_null(pc.index_in(flat, value_set=known), unknown - shift)
            ids = pc.add(at, pa.scalar(shift, pa.int32()))
            return pa.ListArray.from_arrays(pa.array(ends), ids, mask=texts.is_null())

        return encode

    def _decoder(self):
        vocabulary, shift = self.vocabulary, self.shift

        def decode(lists):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            kept = ids >= shift
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            words = pa.array(vocabulary, pa.string()).take(pa.array(ids[kept] - shift))
            cut = pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]]), words, mask=lists.is_null())
            return pc.binary_join(cut, " ")

        return decode


class FileTokenizer(Tokenizer):
    """A tokenizer read from a ``tokenizer.json`` that every executor can open.

    Loaded once per Python worker; a batch of rows is one call into the native library.
    """

    def __init__(self, path: str, bos_token: str = "<s>", eos_token: str = "</s>", pad_token: str | None = None):
        from tokenizers import Tokenizer as Native

        native = Native.from_file(path)
        self.path = path
        self.bos_token = bos_token
        self.bos_id = native.token_to_id(bos_token)
        self.eos_id = native.token_to_id(eos_token)
        self._pad_id = native.token_to_id(pad_token) if pad_token else None

    def _encoder(self, add_special_tokens: bool):
        load = _worker_loader(self.path)

        def encode(texts):
            import numpy as np
            import pyarrow as pa

            encoded = load().encode_batch(
                [t if t is not None else "" for t in texts.to_pylist()], add_special_tokens=add_special_tokens
            )
            ids = [np.asarray(e.ids, np.int32) for e in encoded]
            ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=texts.is_null())

        return encode

    def _decoder(self):
        load = _worker_loader(self.path)

        def decode(lists):
            import pyarrow as pa

            ids = lists.to_pylist()
            texts = load().decode_batch([i or [] for i in ids], skip_special_tokens=True)
            return pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())

        return decode


def _worker_loader(path: str):
    def read():
        from tokenizers import Tokenizer as Native

        return Native.from_file(path)

    def load():
        from packfold.functions.worker import kept

        return kept(f"tokenizer-{path}", read)

    return load
