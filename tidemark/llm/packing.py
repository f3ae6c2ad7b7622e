"""Packing of tokenized documents into sequences, first-fit decreasing over a tournament tree.

Documents are dealt at random (by a hash) into groups of about ``GROUP`` documents and at most about ``GROUP_BYTES`` of
text. In a group each document is
tokenized, ended by the end id, and cut at multiples of the sequence length; the pieces, longest first, go to the first
sequence with room, which a tournament tree over the sequences' free space finds in O(log n). Groups are independent:
one task holds one group, and a lost one is redone alone. Sequences of different groups never mix.

The tokenizer lower-cases and never joins characters across white space, so a chunk between white space always gives
the same ids; each worker keeps a bounded cache of them and of the words in them. Texts with U+001C to U+001F, which
Python but not the tokenizer counts as white space, go through the tokenizer whole.

Defined results: null and empty texts are one piece that holds the end id; a text of any length is cut into whole
sequences and a rest; repeated rows are packed once each; equal lengths go in order of doc_id and start; an empty table
gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held

#: Documents and bytes of text of a group, on average: what a task holds at a time.
LENGTH, END, GROUP, GROUP_BYTES = 2048, 1, 400, 8 << 20
#: Entries of a worker's cache, of about 150 bytes each.
CACHE = 500_000
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tree:
    """Tournament tree of free space: the first sequence with room for n."""

    def __init__(self, slots: int, room: int) -> None:
        self.size = 1 << max(slots - 1, 0).bit_length()
        self.best = [room] * (2 * self.size)

    def take(self, n: int) -> int:
        best, k = self.best, 1
        while k < self.size:
            k *= 2
            if best[k] < n:
                k += 1
        slot = k - self.size
        best[k] -= n
        while k > 1:
            k //= 2
            most = max(best[2 * k], best[2 * k + 1])
            if best[k] == most:
                break
            best[k] = most
        return slot


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; pieces of equal size in the given order."""
    tree, filled, out = Tree(len(sizes), room), [0] * (len(sizes) + 1), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        slot = tree.take(sizes[i])
        out[i] = (slot, filled[slot])
        filled[slot] += sizes[i]
    return out


class Chunks:
    """Ids of texts as little-endian bytes, through one cache of white-space-separated chunks and of the words in them."""

    ODD = re.compile("[\x1c-\x1f]")
    ASCII = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # chunks and words: the same string has the same ids as either

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks and words. Plain words, one pre-token each, go through the tokenizer as one text, which is cut
        where ids end a word; if their number doesn't agree, each goes by itself."""
        plain = [w for w in words if w.isalnum() and (w.isalpha() or len(w) == 1)]
        out: dict[str, bytes] = {}
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(plain) and ends[-1] == len(ids):
                raw = ids.tobytes()
                out = {w: raw[4 * a : 4 * b] for w, a, b in zip(plain, [0, *ends], ends)}
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._raw(rest)))
        return [out[w] for w in words]

    def _parts(self, chunk: str) -> list[str]:
        """Parts that the tokenizer certainly handles apart; a chunk that may be special stays whole."""
        if chunk.isascii() and "'" not in chunk and "<" not in chunk:
            return self.ASCII.findall(chunk.lower())
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk]

    def _learn(self, new: set[str]) -> None:
        cut = {c: self._parts(c) for c in new}
        todo = [w for w in {p for parts in cut.values() for p in parts} if w not in self.known]
        self.known.update(zip(todo, self._words(todo)))
        get = self.known.__getitem__
        for c, parts in cut.items():
            if c not in self.known:
                self.known[c] = b"".join(map(get, parts))

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._raw([text])[0]
        parts = text.split()
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            pass
        if len(self.known) > CACHE:  # frequent chunks are met, and so learned, before rare ones
            self.known = dict(islice(self.known.items(), CACHE // 2))
        self._learn({p for p in parts if p not in self.known})
        return b"".join(map(self.known.__getitem__, parts))


def chunks(path: str) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("chunks", path), lambda: Chunks(path))


def pieces(documents: list[tuple[int, bytes]], length: int) -> list[tuple[int, int, bytes, int]]:
    """(doc_id, start, ids, doc_tokens) of documents that are given as (doc_id, ids)."""
    out = []
    for doc, ids in documents:
        n = len(ids) // 4
        out += [(doc, at, ids[4 * at : 4 * (at + length)], n) for at in range(0, n, length)]
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file that every executor can open."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size.n // group), -(-size.bytes // GROUP_BYTES))
    tail = int(end).to_bytes(4, "little")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        coder = chunks(tokenizer)
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = pieces([(doc, coder.encode(text) + tail) for doc, text in rows], length)
        placed = first_fit_decreasing([len(p[2]) // 4 for p in cut], length)
        first = key[0].as_py() << 32
        return pa.table({
            "doc_id": pa.array([p[0] for p in cut], pa.int64()),
            "start": pa.array([p[1] for p in cut], pa.int64()),
            "ids": pa.array([p[2] for p in cut], pa.binary()),
            "doc_tokens": pa.array([p[3] for p in cut], pa.int64()),
            "sequence_id": pa.array([first + s for s, _ in placed], pa.int64()),
            "offset": pa.array([o for _, o in placed], pa.int64()),
        })

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # the text and the row's number count too, so that rows that share an id, or repeat fully, do not share a group
    dealt = own.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
