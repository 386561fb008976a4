"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what BPE merging
gives exactly if each is what its own bytes merge to and every two neighbours are compatible:
merging their joined bytes never joins something across the border. Compatibility is tested for
all distinct neighbours of a block at once, by undoing the later of the two last merges again
and again and looking for a merge across the border that would have come earlier. Only words
with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from packfold.llm import texts

# How byte-level BPE splits text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters whose class differs between Unicode versions, or may: texts with one of them are
# split by the tokenizers library's own splitter.
UNSETTLED = regex.compile(
    "[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭"
    "\U00010000-\U0001efff\U0001fb00-\U0010ffff]"
)
# Words kept with their tokens, at most, and the longest word that is kept.
KEPT_WORDS, KEPT_LENGTH = 120_000, 64
# Characters of text handled at a time.
BLOCK_CHARACTERS = 1 << 19
# Words of up to so many bytes are worked on together; longer ones singly.
TOGETHER = 48
NONE = np.int64(1 << 40)


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: itself where
    it is printable and no space, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary(NamedTuple):
    """Ids are merge ranks: what is merged first has the smaller id, single bytes the least."""

    token: list[bytes]
    id_of: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    merge_keys: np.ndarray
    merged: np.ndarray
    longest: int
    sound: np.ndarray
    trie_keys: np.ndarray
    trie_next: np.ndarray
    trie_token: np.ndarray
    specials: dict[str, int]
    special_pattern: regex.Pattern | None


def _merged(v_keys: np.ndarray, v_merged: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a << 32) | b
    at = np.minimum(np.searchsorted(v_keys, key), len(v_keys) - 1)
    return np.where(v_keys[at] == key, v_merged[at], NONE)


def _never_crossed(keys, merged, left, right, a, b, limit) -> np.ndarray:
    """Whether no merge across the border of neighbours a and b comes before ``limit``.

    The younger of a and b is taken apart at its inner merge; a merge across the border that
    precedes it would have changed the result. Of equal merges the one further left is first.
    """
    a, b, limit = a.astype(np.int64), b.astype(np.int64), limit.astype(np.int64)
    fine = np.zeros(len(a), np.bool_)
    open_ = np.arange(len(a))
    while len(open_):
        crossed = _merged(keys, merged, a, b) < limit
        whole = np.maximum(a, b) < 256
        fine[open_[whole & ~crossed]] = True
        go = ~crossed & ~whole
        open_, a, b = open_[go], a[go], b[go]
        from_left = a > b
        limit = np.where(from_left, a, b + 1)
        a, b = np.where(from_left, right[a], a), np.where(from_left, b, left[b])
    return fine


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _never_crossed(v.merge_keys, v.merged, v.left, v.right, a, b, np.full(len(a), NONE))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file; kept by the worker process for later tasks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind, splitter = spec["model"], spec["pre_tokenizer"]
    if kind["type"] != "BPE" or splitter["type"] != "ByteLevel" or spec["normalizer"] or splitter["add_prefix_space"]:
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    as_byte = _byte_characters()
    raw = lambda s: bytes(as_byte[c] for c in s)
    names = sorted(kind["vocab"], key=kind["vocab"].get)
    if [kind["vocab"][n] for n in names] != list(range(len(names))):
        raise ValueError("ids must be 0, 1, 2, ...")
    token = [raw(n) for n in names]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
    first = len(token) - len(pairs)
    left, right = np.arange(len(token)), np.arange(len(token))
    for i, (x, y) in enumerate(pairs):
        if kind["vocab"][x + y] != first + i:
            raise ValueError("ids must follow the order of the merges")
        left[first + i], right[first + i] = kind["vocab"][x], kind["vocab"][y]
    if first != 256 or any(len(t) != 1 for t in token[:256]):
        raise ValueError("the first 256 ids must be the bytes")
    ids = np.arange(first, len(token))
    keys = (left[ids] << 32) | right[ids]
    order = np.argsort(keys)
    keys, merged = keys[order], ids[order]
    # a token is sound if its parts are and nothing crosses between them before they are joined
    sound = np.ones(len(token), np.bool_)
    sound[ids] = _never_crossed(keys, merged, left, right, left[ids], right[ids], ids)
    for i in ids:
        sound[i] &= sound[left[i]] & sound[right[i]]
    specials = {}
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError("added tokens must match plainly")
        specials[t["content"]] = t["id"]
        token += [b""] * (t["id"] + 1 - len(token))
        token[t["id"]] = t["content"].encode()
    pattern = "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))
    id_of = {t: i for i, t in enumerate(token[: len(names)]) if sound[i]}
    return Vocabulary(
        token, id_of, left, right, keys, merged, max(map(len, id_of)), sound, *_trie(id_of), specials,
        regex.compile(f"({pattern})") if pattern else None,
    )


def _trie(id_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys 256 * node + byte, the node each leads to, and the token that ends at a node."""
    nodes: dict[bytes, int] = {b"": 0}
    edges: list[tuple[int, int]] = []
    for token in id_of:
        for n in range(1, len(token) + 1):
            if token[:n] not in nodes:
                nodes[token[:n]] = len(nodes)
                edges.append((nodes[token[: n - 1]] * 256 + token[n - 1], nodes[token[:n]]))
    edges.sort()
    ends = np.full(len(nodes), -1, np.int64)
    for token, i in id_of.items():
        ends[nodes[token]] = i
    return np.array([k for k, _ in edges]), np.array([n for _, n in edges]), ends


def proposals(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest match after longest match for many words in step; ids and the word of each."""
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    word = np.arange(len(words))
    at = end - [len(w) for w in words]
    node, best, best_end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), at.copy()
    made: list[tuple[np.ndarray, np.ndarray]] = []
    while len(word):
        more = at < end[word]
        key = node * 256 + data[np.minimum(at, len(data) - 1)]
        edge = np.minimum(np.searchsorted(v.trie_keys, key), len(v.trie_keys) - 1)
        go = more & (v.trie_keys[edge] == key)
        node = np.where(go, v.trie_next[edge], 0)
        at = at + go
        ends = v.trie_token[node]
        hit = go & (ends >= 0)
        best, best_end = np.where(hit, ends, best), np.where(hit, at, best_end)
        stop = ~go
        made.append((word[stop], best[stop]))
        at = np.where(stop, best_end, at)
        left = ~stop | (at < end[word])
        word, at, node, best, best_end = word[left], at[left], node[left], best[left], best_end[left]
    owner, ids = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(owner, kind="stable")
    return ids[order], owner[order]


def merge_together(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact merging of many words in step: each round joins the first pair of least rank of
    every word that still has one. Gives ids and the word of each."""
    single = np.array([v.id_of[bytes([b])] for b in range(256)])
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    rank = np.full(len(ids), NONE)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner] = _merged(v.merge_keys, v.merged, ids[inner], ids[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(starts, len(ids)))
        least = np.repeat(np.minimum.reduceat(rank, starts), size)
        over = least == NONE
        if over.any():
            done.append((ids[over], owner[over]))
            ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
            if not len(ids):
                break
        at = np.flatnonzero(rank == least)
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
        ids[at] = rank[at]
        keep = np.ones(len(ids), np.bool_)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        ids, owner, rank = ids[keep], owner[keep], rank[keep]
        for pair in (moved, moved[moved > 0] - 1):
            after = np.minimum(pair + 1, len(ids) - 1)
            same = (after > pair) & (owner[after] == owner[pair])
            rank[pair] = np.where(same, _merged(v.merge_keys, v.merged, ids[pair], ids[after]), NONE)
    ids, owner = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(owner, kind="stable")
    return ids[order], owner[order]


def proposal(v: Vocabulary, word: bytes) -> list[int]:
    """Longest match after longest match; every byte is a token, so there always is one."""
    out, at, id_of, longest = [], 0, v.id_of, v.longest
    while at < len(word):
        end = min(len(word), at + longest)
        while (found := id_of.get(word[at:end])) is None:
            end -= 1
        out.append(found)
        at = end
    return out


def merge_exactly(v: Vocabulary, word: bytes) -> list[int]:
    """Merge the bytes in order of rank, of equal ranks from the left; n log n steps."""
    ids = [v.id_of[word[i : i + 1]] for i in range(len(word))]
    before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
    waiting: list[tuple[int, int, int, int]] = []
    merges = _merge_table(v)

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (new := merges.get((ids[i], ids[j]))) is not None:
            heapq.heappush(waiting, (new, i, ids[i], ids[j]))

    for i in range(len(ids)):
        offer(i)
    while waiting:
        new, i, x, y = heapq.heappop(waiting)
        j = after[i] if ids[i] == x else len(ids)
        if j >= len(ids) or ids[j] != y:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


_merge_tables: dict[int, dict[tuple[int, int], int]] = {}


def _merge_table(v: Vocabulary) -> dict[tuple[int, int], int]:
    if id(v) not in _merge_tables:
        made = zip(v.merge_keys.tolist(), v.merged.tolist())
        _merge_tables[id(v)] = {(k >> 32, k & 0xFFFFFFFF): m for k, m in made}
    return _merge_tables[id(v)]


def _packed(ids: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    data = ids.astype("<u4").tobytes()
    edge = (4 * np.searchsorted(owner, np.arange(n + 1))).tolist()
    return [data[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _incompatible(v: Vocabulary, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words with a pair of neighbours that merging would not have left."""
    border = np.flatnonzero(owner[1:] == owner[:-1])
    keys, back = np.unique((ids[border] << 32) | ids[border + 1], return_inverse=True)
    fits = compatible(v, keys >> 32, keys & 0xFFFFFFFF)[back]
    return np.unique(owner[border[~fits]])


def word_tokens(v: Vocabulary, words: Iterable[str]) -> dict[str, bytes]:
    """Ids of distinct words, as little-endian 32-bit integers."""
    made: dict[str, bytes] = {}
    raw = {w: w.encode() for w in words}
    names = [w for w, x in raw.items() if len(x) <= TOGETHER]
    if names:
        ids, owner = proposals(v, [raw[w] for w in names])
        made |= zip(names, _packed(ids, owner, len(names)))
        wrong = [names[i] for i in _incompatible(v, ids, owner).tolist()]
        if wrong:
            made |= zip(wrong, _packed(*merge_together(v, [raw[w] for w in wrong]), len(wrong)))
    for w, x in raw.items():
        if len(x) > TOGETHER:
            ids = np.array(proposal(v, x), np.int64)
            if len(_incompatible(v, ids, np.zeros(len(ids), np.int64))):
                ids = np.array(merge_exactly(v, x), np.int64)
            made[w] = ids.astype("<u4").tobytes()
    return made


_kept: dict[str, dict[str, bytes]] = {}


def split_words(text: str) -> list[str]:
    if UNSETTLED.search(text):
        library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
    return WORDS.findall(text)


def encode_texts(path: str, batch: list[str | None]) -> list[bytes]:
    """Ids of each text, packed; a null text has none."""
    v, kept = vocabulary(path), _kept.setdefault(path, {})
    out: list[bytes] = []
    at = 0
    while at < len(batch):
        parts: list[list[str]] = []
        size = 0
        while at < len(batch) and size < BLOCK_CHARACTERS:
            text = batch[at] or ""
            pieces = v.special_pattern.split(text) if v.special_pattern else [text]
            parts.append([w for p in pieces for w in ([p] if p in v.specials else split_words(p))] if len(pieces) > 1 else split_words(text))
            size += len(text) + 100
            at += 1
        missing = set().union(*parts).difference(kept)
        fresh = word_tokens(v, missing.difference(v.specials))
        fresh |= {s: np.array([i], "<u4").tobytes() for s, i in v.specials.items()}
        if len(kept) + len(fresh) > KEPT_WORDS:
            fresh = {w: kept.get(w) or fresh[w] for words in parts for w in words}
            kept.clear()
        long = {w: x for w, x in fresh.items() if len(w) > KEPT_LENGTH}
        kept.update((w, x) for w, x in fresh.items() if len(w) <= KEPT_LENGTH)
        for words in parts:
            if long:
                out.append(b"".join([kept.get(w) or long[w] for w in words]))
            else:
                out.append(b"".join(map(kept.__getitem__, words)))
    return out


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", output: str = "ids") -> DataFrame:
    """``keep`` columns and ``output``: the ids as packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids. A special token's string in a text becomes its id, as
    with the tokenizers library. Rows stay rows, repeated ones too; other columns are left out.
    """

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {output: pa.array(encode_texts(path, batch.column(batch.num_columns - 1).to_pylist()), pa.binary())}

    return texts.map_texts(df, keep, text, [(output, T.BinaryType())], work)


def decode_ids(v: Vocabulary, ids: bytes | None) -> str:
    if not ids:
        return ""
    return b"".join(map(v.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``keep`` columns and the text of packed ids; special tokens appear as their strings."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        v = vocabulary(path)
        return {output: pa.array([decode_ids(v, x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())}

    return texts.map_texts(df, keep, ids, [(output, T.StringType())], work)


def round_trip(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ids as of ``encode`` and decoded as of ``decode``, in one pass."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        v = vocabulary(path)
        ids = encode_texts(path, batch.column(batch.num_columns - 1).to_pylist())
        return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([decode_ids(v, x) for x in ids], pa.string())}

    return texts.map_texts(df, keep, text, [("ids", T.BinaryType()), ("decoded", T.StringType())], work)


def checked(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ids as of ``encode`` and decodes_back: whether ``decode`` gives the text again (null: empty).

    Texts are compared where they are decoded, one by one, and do not come back from Python."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        v, whole = vocabulary(path), batch.column(batch.num_columns - 1).to_pylist()
        ids = encode_texts(path, whole)
        back = [decode_ids(v, x) == (t or "") for x, t in zip(ids, whole)]
        return {"ids": pa.array(ids, pa.binary()), "decodes_back": pa.array(back, pa.bool_())}

    return texts.map_texts(df, keep, text, [("ids", T.BinaryType()), ("decodes_back", T.BooleanType())], work)
