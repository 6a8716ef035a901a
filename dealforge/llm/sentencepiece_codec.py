"""SentencePiece encoding and decoding by a table of distinct chunks.

In the vocabulary used here no piece has a whitespace marker after another
character, so no merge crosses the place where a marker follows a
non-marker. The text is cut there, each distinct marked word of a batch is
segmented once, and the ids go back to the words' positions.

Nulls and empty texts give the end id alone and decode to the empty text.
Very long texts are encoded whole: the table grows with distinct words only
and is started anew when it holds ``TABLE_WORDS`` of them. Extra columns of
the input are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_before, as_text, text_schema

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words that a worker keeps segmented. Reaching it only means segmenting again.
TABLE_WORDS = 100_000


class ChunkCodec:
    """Encodes and decodes with one sentencepiece model.

    >>> codec.encode("a b")   # the ids of the library, and the end id
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        self.end = self.sp.eos_id()
        self.mark_id = self.sp.piece_to_id(MARK)
        self.table: dict[str, list[int]] = {}

    def _segment(self, words: set[str]) -> None:
        """Add words to the table; every word begins with the marker."""
        if len(self.table) + len(words) > TABLE_WORDS:
            self.table.clear()
        new = [w for w in words if w not in self.table and w != MARK]
        # The library puts the first marker itself, so it is taken off here.
        self.table.update(zip(new, self.sp.encode([w[1:] for w in new], num_threads=1), strict=True))
        self.table[MARK] = [self.mark_id]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        held: list[list[str]] = []
        distinct: set[str] = set()
        for text in texts:
            # The library's normalised form: a leading marker, and markers for spaces.
            held.append(_CHUNKS.findall(self.sp.normalize(text)) if text else [])
            distinct.update(held[-1])
            if len(distinct) >= TABLE_WORDS // 4:
                yield from self._place(held, distinct)
                held, distinct = [], set()
        yield from self._place(held, distinct)

    def _place(self, held: list[list[str]], distinct: set[str]) -> Iterator[list[int]]:
        self._segment(distinct)
        for chunks in held:
            ids: list[int] = []
            for c in chunks:
                ids += self.table[c]
            ids.append(self.end)
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encode(docs: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``keep`` columns, and the ids of ``text`` with the end id last.

    ``model_path`` is read on the driver and sent along; a model file has a
    fixed size of about half a megabyte.
    """
    model = Path(model_path).read_bytes()
    kept = docs.select(*keep).schema
    schema = text_schema(kept).add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(model)
        for b in batches:
            for part in (b[i : i + 256] for i in range(0, len(b), 256)):
                out = part[list(keep)].copy()
                out[ids] = list(codec.encode_batch(part["__text"].tolist()))
                yield out

    rows = as_text(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")))
    return as_before(rows.mapInPandas(run, schema), kept)


def decode(encoded: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``keep`` columns, and ``ids`` decoded into ``text``."""
    model = Path(model_path).read_bytes()
    kept = encoded.select(*keep).schema
    schema = text_schema(kept).add(text, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(model)
        for b in batches:
            out = b[list(keep)].copy()
            out[text] = [codec.decode([] if x is None else list(map(int, x))) for x in b["__ids"]]
            yield out

    return as_before(as_text(encoded.select(*keep, F.col(ids).alias("__ids"))).mapInPandas(run, schema), kept)


def roundtrip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken beside the codec, so the ids need not travel
    through Spark only to be hashed.
    """
    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = [(len(ids), sha(" ".join(map(str, ids))), sha(codec.decode(ids))) for ids in codec.encode_batch(b["text"].tolist())]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_and_decode(docs: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, token_ids (end id last) and text, which is decoded from the ids; one worker does both."""
    model = Path(model_path).read_bytes()
    kept = docs.select(*keep).schema
    schema = text_schema(kept).add("n_tokens", T.LongType()).add("token_ids", T.ArrayType(T.IntegerType())).add("text", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(model)
        for b in batches:
            for part in (b[i : i + 64] for i in range(0, len(b), 64)):
                out = part[list(keep)].copy()
                ids = list(codec.encode_batch(part["__text"].tolist()))
                out["n_tokens"] = list(map(len, ids))
                out["text"] = list(map(codec.decode, ids))
                out["token_ids"] = [np.array(x, np.int32) for x in ids]
                yield out

    return as_before(as_text(docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))).mapInPandas(run, schema), kept)
