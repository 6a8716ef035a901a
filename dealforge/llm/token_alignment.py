"""Alignment of two tokenizers over the same texts, on Arrow tables.

A is a byte-level BPE (``tokenizers`` file), B a sentencepiece model. A gets a
space before each text, B puts one itself, so the bytes of both are
space + text, and a token is a range of bytes. The ends of both tokenizers'
tokens are met by an Acero hash join on (text, end): where both end, a *group*
ends; each range between neighbouring ends lies in one token of A and one of B
and is a *link*, and every pair of overlapping tokens has exactly one such
range. Lists are flattened, their parent indices kept, ends are sums of token
lengths that start anew with each text, and links are counted with
``Table.group_by``.

What a batch of texts counts is merged by Spark, and the merged counts of the
batch's own pairs come back to it: a batch knows each of its pairs once, and
no task or driver holds all of them.

Texts that are null, empty, or whose tokens' bytes of A or B aren't
space + text (U+2581 in the text, for one) have no tokens: all numbers are 0
and groups are empty. Very long texts are cut where both tokenizers end a
token, before a single space between two other characters, and put together
again. Repeated rows count each. Rows with a null doc_id are kept. Extra
columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir
from .sentencepiece_codec import MARK, ChunkCodec

#: Characters from which a text is cut where it can be, texts aligned together, and texts whose counts are merged by a worker.
PIECE_CHARS, SLICE_CHARS, BATCH_CHARS = 1 << 18, 1 << 19, 8 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts whose characters all libraries class alike, and runs that are long for a merge that looks at all places each time.
_PLAIN, _LONG_RUN = re.compile("[\x00-ɏ]*"), re.compile(r"\S{500}|\s{500}")


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """space + text, cut before single spaces between other characters, where both tokenizers end a token."""
    s, out, a = " " + text, [], 0
    while len(s) - a > size and (m := _SAFE.search(s, a + size)):
        out.append(s[a : m.start()])
        a = m.start()
    return [*out, s[a:]]


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.a, self.codec = Tokenizer.from_str(a_json), ChunkCodec(b_model)
        self.a.encode_special_tokens = True
        byte, sp = _byte_level(), self.codec.sp
        entry = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entry]
        b_bytes = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.pair_kind = np.int32 if self.n_a * self.n_b < 1 << 31 else np.int64
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        # ids as text with what may follow them: A's, then B's
        self.ends = pa.array([f"{i}{s}" for n, ss in ((self.n_a, ",|"), (self.n_b, [",", ";", ""])) for s in ss for i in range(n)])

        # the same merges for plain texts: a token's id is its rank if ids follow the merges
        model = json.loads(a_json)["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        self.quick = None
        if self.a.normalizer is None and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged))):
            ranks = {x: i for i, x in enumerate(a_bytes[: 256 + len(merged)])}
            self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        out = [self.quick.encode_ordinary(t) if self.quick and _PLAIN.fullmatch(t) and not _LONG_RUN.search(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str]):
        """List arrays of the ids of A and of B; each text begins with the space."""
        import pyarrow as pa

        return pa.array(self._encode_a(texts), pa.list_(pa.int32())), pa.array(self.codec.sp.encode([t[1:] for t in texts], num_threads=1), pa.list_(pa.int32()))


def _lists(arrays: list[np.ndarray]):
    """A list array of the arrays."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if len(arrays) else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _faithful(lists, of_token, texts) -> np.ndarray:
    """Whether the tokens' bytes are the texts'."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of_token.take(lists.values)), b"")
    return pc.equal(joined, texts).to_numpy(zero_copy_only=False)


class Aligned:
    """Links and groups of some texts (or pieces), by Arrow tables.

    n_a, n_b, n_groups, n_links: a number a text; pairs: a list array of the
    links' pairs (A's id * vocabulary of B + B's id) in order; groups: their
    texts, ``a1,a2|b1;a3|b2``.
    """

    def __init__(self, a_lists, b_lists, t: Tokenizers) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(a_lists)
        sides = {}
        for name, lists, size in (("a", a_lists, t.a_size), ("b", b_lists, t.b_size)):
            doc = pc.list_parent_indices(lists)
            total = np.cumsum(size[lists.values.to_numpy()])
            first = lists.offsets.to_numpy()[:-1]
            before = np.concatenate([[0], total])[first]
            end = total - before[doc.to_numpy()]
            sides[name] = pa.table({"doc": doc, "end": end, name: np.arange(len(end), dtype=np.int32)})
        ends = sides["a"].join(sides["b"], ["doc", "end"], join_type="full outer", use_threads=False)
        ends = ends.take(pc.sort_indices(ends, [("doc", "ascending"), ("end", "ascending")]))
        # a link's tokens are those that end next, at its own end or later
        in_a, in_b = (pc.is_valid(ends[c]).to_numpy(zero_copy_only=False) for c in "ab")
        at_a, at_b = (pc.fill_null_backward(ends[c].combine_chunks()).to_numpy() for c in "ab")
        doc, both = ends["doc"].to_numpy(), in_a & in_b
        a_ids, b_ids = a_lists.values.to_numpy(), b_lists.values.to_numpy()
        pair = (a_ids[at_a].astype(np.int64) * t.n_b + b_ids[at_b]).astype(t.pair_kind)
        self.n_a, self.n_b = np.diff(a_lists.offsets.to_numpy()), np.diff(b_lists.offsets.to_numpy())
        self.n_links, self.n_groups = np.bincount(doc, minlength=n), np.bincount(doc[both], minlength=n)
        starts = np.concatenate([[0], np.cumsum(self.n_links)]).astype(np.int32)
        self.pairs = pa.ListArray.from_arrays(pa.array(starts), pa.array(pair))
        # groups as text: all of a group's tokens of A, then those of B
        group = np.cumsum(both) - both
        group_a, group_b = group[in_a], group[in_b]
        of_a, of_b = (np.bincount(g, minlength=int(both.sum())) for g in (group_a, group_b))
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        last = np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
        order[np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[group_a]] = a_ids + t.n_a * both[in_a]
        order[np.arange(len(b_ids)) + np.cumsum(of_a)[group_b]] = 2 * t.n_a + b_ids + t.n_b * (both[in_b] + 1 * last[in_b])
        words = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).astype(np.int32)
        self.groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(words), t.ends.take(pa.array(order))), "")

    def counts(self):
        """pair, n: how many links each pair has."""
        import pyarrow as pa

        return pa.table({"pair": self.pairs.values, "n": np.ones(len(self.pairs.values), np.int64)}).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


class _Worker:
    """Aligns documents and keeps the counts of a batch until it is full."""

    def __init__(self, t: Tokenizers, keep_groups: bool, size: int, piece: int) -> None:
        self.t, self.keep_groups, self.size, self.piece = t, keep_groups, size, piece
        self.told, self.chars = [], 0

    def _sliced(self, cut: list[list[str]]) -> Iterator[list[tuple[int, str]]]:
        held, n = [], 0
        for doc, some in enumerate(cut):
            for x in some:
                if held and n + len(x) > SLICE_CHARS:
                    yield held
                    held, n = [], 0
                held.append((doc, x))
                n += len(x)
        if held:
            yield held

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """A column's values for each text."""
        import pyarrow as pa

        t, n = self.t, len(texts)
        cut = [pieces(x, self.piece) if x else [] for x in texts]
        good, found = np.array([bool(x) for x in texts]), []
        for some in self._sliced(cut):
            docs, strings = np.array([d for d, _ in some]), [x for _, x in some]
            a, b = t.encode(strings)
            want = pa.array(strings, pa.string()).cast(pa.binary())
            good[docs[~(_faithful(a, t.a_bytes, want) & _faithful(b, t.b_bytes, want))]] = False
            found.append((docs, a, b))
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        groups, pairs = [[] for _ in range(n)], [[] for _ in range(n)]
        for docs, a, b in found:
            use = np.flatnonzero(good[docs])
            if not len(use):
                continue
            x, docs = Aligned(a.take(pa.array(use)), b.take(pa.array(use)), t), docs[use]
            for c in out:
                np.add.at(out[c], docs, getattr(x, c))
            for d, g, lo, hi in zip(docs.tolist(), x.groups.to_pylist(), x.pairs.offsets.to_numpy()[:-1], x.pairs.offsets.to_numpy()[1:], strict=True):
                groups[d].append(g)
                pairs[d].append(x.pairs.values[lo:hi].to_numpy())
            self.told.append(x.counts())
        joined = [";".join(g) for g in groups]
        out["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in joined]
        out["groups"] = joined if self.keep_groups else [None] * n
        out["pairs"] = _lists([np.concatenate(p) if p else np.empty(0, t.pair_kind) for p in pairs])
        self.chars += sum(len(x or "") for x in texts)
        return out

    def counted(self):
        """The batch's pairs and counts; a new batch begins."""
        import pyarrow as pa

        whole = pa.concat_tables(self.told).group_by("pair", use_threads=False).aggregate([("n", "sum")]) if self.told else None
        self.told, self.chars = [], 0
        return whole


_STAGE = "doc_id long, batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<{pair}>, counted array<struct<pair: {pair}, n: long>>"


def align(docs: DataFrame, a_path: str, b_path: str, *, keep_groups: bool = False, batch_chars: int = BATCH_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """A stored table: a row a document (counted is null), and a row a batch (counted: its pairs and how many links hold each).

    ``keep_groups``: also the groups' text. The tokenizers' files are read on
    the driver and sent along; they have a fixed size of some megabytes.
    """
    spark = docs.sparkSession
    a_json, b_model = Path(a_path).read_text(), Path(b_path).read_bytes()
    wide = Tokenizers(a_json, b_model).pair_kind is np.int64

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        worker, number = _Worker(Tokenizers(a_json, b_model), keep_groups, batch_chars, piece_chars), TaskContext.get().partitionId() << 32
        pair = pa.int64() if wide else pa.int32()
        kinds = pa.schema([("doc_id", pa.int64()), ("batch", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pair)), ("counted", pa.list_(pa.struct([("pair", pair), ("n", pa.int64())])))])

        def close() -> Iterator:
            nonlocal number
            whole = worker.counted()
            if whole is not None:
                some = pa.StructArray.from_arrays([whole["pair"].combine_chunks(), whole["n_sum"].combine_chunks()], ["pair", "n"])
                counted = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([pa.array([number]) if f.name == "batch" else counted if f.name == "counted" else pa.nulls(1, f.type) for f in kinds], schema=kinds)
            number += 1

        for b in batches:
            texts, at = b.column("text"), 0
            while at < len(b):
                size, to = 0, at
                while to < len(b) and (to == at or size < min(SLICE_CHARS, batch_chars)):
                    size += len(texts[to].as_py() or "")
                    to += 1
                got = worker.align(texts[at:to].to_pylist())
                got |= {"doc_id": b.column("doc_id")[at:to], "batch": [number] * (to - at), "counted": [None] * (to - at)}
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in kinds], schema=kinds)
                at = to
                if worker.chars >= worker.size:
                    yield from close()
        yield from close()

    at = fresh_dir(spark, "aligned")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _STAGE.format(pair="long" if wide else "int")).write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """a_id, b_id, pair, n (links of all texts that hold the pair), best (whether no pair of the same b_id has more)."""
    pairs = aligned.filter("counted IS NOT NULL").select(F.explode("counted").alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("n"))
    ids = pairs.select(F.floor(F.col("pair") / n_b).alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "pair", "n")
    # a group holds A's vocabulary at most
    return ids.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b_id")))


def scored(aligned: DataFrame, n_b: int) -> DataFrame:
    """Documents of ``align``: n_best and count_sum beside the other columns."""
    counts = pair_counts(aligned, n_b).select("pair", "n", "best")
    asked = aligned.filter("counted IS NOT NULL").select("batch", F.explode("counted.pair").alias("pair"))
    told = asked.join(counts.hint("merge"), "pair").select(F.col("batch").alias("to"), "pair", "n", "best")
    docs = aligned.filter("counted IS NULL").drop("counted")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    def look_up(mine, known):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = mine["pairs"].combine_chunks()
        n_best, count_sum = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        for chunk_at in range(0, len(mine), 4096):
            some = lists[chunk_at : chunk_at + 4096]
            links = pa.table({"doc": pc.list_parent_indices(some), "pair": pc.list_flatten(some)})
            sums = links.join(known.select(["pair", "n", "best"]), "pair", join_type="inner", use_threads=False)
            sums = sums.set_column(sums.schema.get_field_index("best"), "best", pc.cast(sums["best"], pa.int64())).group_by("doc", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
            doc = sums["doc"].to_numpy() + chunk_at
            n_best[doc], count_sum[doc] = sums["best_sum"].to_numpy(), sums["n_sum"].to_numpy()
        cols = {c: mine[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table(cols | {c: mine[c] for c in ("groups_sha256", "groups")})

    return docs.groupBy("batch").cogroup(told.groupBy("to")).applyInArrow(look_up, out)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    return scored(align(docs, a_path, b_path), n_b).drop("groups")
