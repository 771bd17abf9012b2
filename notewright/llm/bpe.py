"""Byte-level BPE by a local rank file: encoding, decoding, and the query op7_byte_bpe.

The merges are the tiktoken library's. Long texts are cut first at places where no match
of the pattern can span, so that neither its regular expression nor its merges ever see
more than one piece; the ids are those of the whole text."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from notewright.llm.common import map_text, table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 16_384
# No match of the pattern holds a non-space before a space, or a letter beside a digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; read once a Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cuts ``text`` at the first safe boundary after every ``size`` characters. A text
    without one is a single piece, however long: a match must not be cut."""
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut or cut.start() == len(text):
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(text: str, path: str, size: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += encoding(path).encode_ordinary(piece)
    return ids


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids`` array<int>. Null and empty texts have no ids. Rows are encoded
    one by one: repeated rows give repeated results. Bytes that are not UTF-8 count as
    U+FFFD. A column ``ids`` of ``df`` gives way to the result."""

    def make():
        encoding(path)
        return lambda items: [[np.array(encode(x.decode("utf-8", "replace"), path), np.int32) for x in items]]

    return map_text(df, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], text, keep)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded`` binary: the bytes of the ids, joined. Bytes, as ids cut at
    any place need not be whole characters. Null or empty ids give no bytes; an id that
    the file lacks is an error."""
    import pyarrow as pa

    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("decoded",)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = encoding(path)
        for batch in batches:
            out = [own.decode_bytes(x or []) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.binary())], names=schema.names)

    return df.select(*(df[c] for c in kept), df[ids]).mapInArrow(run, schema)


def encode_checked(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` as ``encode_texts`` gives them and ``decoded_sha256``, the
    digest of the bytes that they decode to. One pass: a task has one Python worker, where encoding and
    decoding one after the other have two, each with an encoding of its own, which stay for later stages."""

    def make():
        own = encoding(path)

        def work(items):
            found = [np.array(encode(x.decode("utf-8", "replace"), path), np.int32) for x in items]
            return [len(x) for x in found], found, [hashlib.sha256(own.decode_bytes(x.tolist())).hexdigest() for x in found]

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_text(df, make, fields, text, keep)


def digest(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes in one pass and returns n_tokens and the digests of the ids and
    of the decoded bytes, so that no ids cross back to the JVM."""

    def make():
        own = encoding(path)
        names = [str(i) for i in range(own.n_vocab)]

        def work(items):
            counts, ids_sha, text_sha = [], [], []
            for item in items:
                ids = encode(item.decode("utf-8", "replace"), path)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            return counts, ids_sha, text_sha

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_text(df, make, fields, text, list(keep))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
