"""Encoding of a whole corpus with a public tokenizer; long texts by tree concatenation.

A text up to ``chunk`` characters is encoded where it lies. A longer one is cut into chunks that spread over the cluster and
are encoded in parallel. Their ids are then joined pairwise, level by level: a window around each join is encoded again and
grows until its first ids are those of the left part and its last ids those of the right part. From such ids outwards a
byte-pair encoding depends on nothing beyond the window, so the joined ids are those of the whole text.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
CHUNK = 8192  # characters
AGREE = 6  # ids that must agree on either side of a join
IDS = "ids array<int>"


@cache
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary name or file path, made once per process; strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(f"{vocabulary}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(f"tessera-{vocabulary}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    return encoder(vocabulary).encode_ordinary(text) if text else []


def join_encoded(left: list[int], right: list[int], enc, window: int = 16) -> list[int]:
    """Ids of two neighbouring texts, given the ids of each."""
    if not left or not right:
        return left or right
    size = window
    while True:
        i, j = max(0, len(left) - size), min(len(right), size)
        head, tail = b"".join(map(enc.decode_single_token_bytes, left[i:])), b"".join(map(enc.decode_single_token_bytes, right[:j]))
        raw = head + tail
        whole = i == 0 and j == len(right)
        try:
            middle = enc.encode_ordinary(raw.decode("utf-8"))
        except UnicodeDecodeError:  # the window cuts a character
            middle = None
        if middle is not None:
            lefts = i == 0 or (middle[:AGREE] == left[i : i + AGREE] and len(left) - i >= AGREE)
            rights = j == len(right) or (middle[-AGREE:] == right[:j][-AGREE:] and j >= AGREE)
            if lefts and rights:
                return left[:i] + middle + right[j:]
        if whole:
            raise AssertionError("the ids of a text do not decode to it")
        size *= 2


def join_tree(parts: list[list[int]], enc) -> list[int]:
    while len(parts) > 1:
        parts = [join_encoded(parts[k], parts[k + 1], enc) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


def _encode_batches(vocabulary: str, keys: list[str], count: bool):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column("__text").to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if count else _lists(ids)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], out], [*keys, "n_tokens" if count else "ids"])

    return run


def _cut(chunk: int, keys: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            at = [(r, k) for r, t in enumerate(texts) for k in range(-(-len(t) // chunk))]
            rows = pa.array([r for r, _ in at], pa.int64())
            columns = [batch.column(k).take(rows) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in at], pa.int32()), pa.array([texts[r][k * chunk : (k + 1) * chunk] for r, k in at], pa.string())], [*keys, "__part", "__text"])

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, chunk: int = CHUNK, count: bool = False, carry: str | None = None) -> DataFrame:
    """(key, ids) or, with ``count``, (key, n_tokens): one row per input row, whole texts, no special tokens.

    A column ``carry`` comes out beside the key, so that it need not be joined back.

    Null and empty texts give an empty list (0). Blanks are encoded as they are. Rows that repeat come out as often as they
    stand in the input. Other columns are left out, so they can clash with nothing.
    """
    result = "n_tokens long" if count else IDS
    kind = docs.schema[key].dataType.simpleString()
    along = [] if carry is None else ["__carry"]
    keys = ["__key", *along]
    named = f"__key {kind}" + (f", __carry {docs.schema[carry].dataType.simpleString()}" if along else "")
    narrow = docs.select(F.col(key).alias("__key"), *[F.col(carry).alias(c) for c in along], F.col(text).alias("__text"))
    long = F.length("__text") > chunk
    short_rows = narrow.filter(~F.coalesce(long, F.lit(False)))
    out = short_rows.mapInArrow(_encode_batches(vocabulary, keys, count), f"{named}, {result}")
    tall = narrow.filter(long).withColumn("__hash", F.xxhash64("__text", *along))
    pieces = tall.mapInArrow(_cut(chunk, [*keys, "__hash"]), f"{named}, __hash long, __part int, __text string")
    spread = pieces.repartition("__key", "__hash", "__part")
    coded = spread.mapInArrow(_encode_batches(vocabulary, [*keys, "__hash", "__part"], False), f"{named}, __hash long, __part int, ids array<int>")

    def join(pdf):
        enc = encoder(vocabulary)
        first = pdf.drop_duplicates("__part").sort_values("__part")
        ids = join_tree([list(map(int, x)) for x in first["ids"]], enc)
        times = int((pdf["__part"] == 0).sum())  # equal rows with one key and text
        one = first[keys].iloc[[0] * times]
        return one.assign(**({"n_tokens": len(ids)} if count else {"ids": [np.asarray(ids, dtype=np.int32)] * times}))

    joined = coded.groupBy("__key", "__hash").applyInPandas(join, f"{named}, {result}")
    return out.union(joined).withColumnsRenamed({"__key": key} | ({"__carry": carry} if along else {}))
