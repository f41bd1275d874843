"""Token ids of whole texts by a public byte-level BPE vocabulary, with forced boundaries.

A byte pair that occurs inside no vocabulary token marks a certain cut: no token can span it. Texts are
cut at every such pair of a visible character and a following white-space byte (where the tokenizer's
pattern, which only looks ahead from white space, always starts a new piece too); the fragments of a batch
are encoded once for each distinct one and concatenated by Arrow kernels. Long fragments are split by the
pattern and, inside a piece, at every forced pair, so the work grows in proportion to the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: The pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Last bytes of white-space characters beyond ASCII: no cut is made after them.
_TAILS = [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]
LONG = 2048


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pairs_inside(ranks: dict[bytes, int]) -> np.ndarray:
    """seen[a, b]: some token has byte b right after byte a."""
    seen = np.zeros((256, 256), bool)
    for token in ranks:
        x = np.frombuffer(token, np.uint8)
        seen[x[:-1], x[1:]] = True
    return seen


class Encoder:
    """Encodes Arrow string arrays to lists of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.seen = pairs_inside(ranks)
        byte = np.arange(256)
        space = np.isin(byte, [9, 10, 11, 12, 13, 32])
        visible = ~space & (byte > 32) & ~np.isin(byte, _TAILS) & (byte != 127)
        self.cut = ~self.seen & visible[:, None] & space[None, :]

    def one(self, fragment: str) -> list[int]:
        if len(fragment) < LONG:
            return self.bpe.encode_ordinary(fragment)
        ids: list[int] = []
        for piece in self.pieces(fragment):
            raw = piece.encode()
            x = np.frombuffer(raw, np.uint8)
            at = [0, *(np.flatnonzero(~self.seen[x[:-1], x[1:]]) + 1).tolist(), len(raw)]
            for a, b in zip(at, at[1:]):
                ids += self.bpe._encode_single_piece(raw[a:b])
        return ids

    def many(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; none for null and empty texts."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        # contiguous bytes of this batch only
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        if high == low:
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        x = np.frombuffer(data, np.uint8, high - low, low)
        starts = offsets - low
        cuts = np.flatnonzero(self.cut[x[:-1], x[1:]]) + 1
        edges = np.unique(np.concatenate([cuts, starts]))
        fragments = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(x))
        coded = fragments.dictionary_encode()
        lists = [self.one(f) for f in coded.dictionary.to_pylist()]
        size = np.array([len(v) for v in lists], np.int64)
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate([np.asarray(v, np.int32) for v in lists])))
        codes = coded.indices
        flat = values.take(codes).flatten()
        ends = np.r_[0, np.cumsum(size[np.asarray(codes)])]
        of_text = ends[np.searchsorted(edges, starts)]
        return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), flat)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids array<int>) of every row, special tokens left out, without a shuffle.

    Null and empty texts have an empty list; repeated rows stay; an empty table gives no rows. The
    vocabulary file is read by the driver and broadcast: its size is that of the file, whatever the corpus.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = documents.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.many(part.column(1))], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
