"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

Pieces come from a public SentencePiece model file, whose path is a parameter. The box has no unigram model: the pieces'
log scores are then a Zipf law over their rank in the file (``zipf``); a model that is unigram keeps its own scores.

A text becomes ``▁`` (dummy prefix) plus the text with spaces as ``▁``. No piece goes on with ``▁`` after another
character, nor holds a line feed, so the best path splits at those places and is found once per distinct segment: all
new segments of a batch step through the double array together in numpy. A character that no piece starts with takes
its UTF-8 bytes as byte pieces, at a score 10 below the lowest. A ``▁`` in the text itself is taken by bytes, so that
decoding gives every text back exactly.

Defined results: null and empty texts encode to no ids and decode to the empty text; ties go to the piece that starts
first. Extra columns are not read. Equal texts get equal ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE = 200_000
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c + 1 if check holds s there."""

    def __init__(self, words: list[tuple[bytes, int]]) -> None:
        size = 4096 + 4 * sum(len(w) for w, _ in words)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        words = sorted(words)
        keys = [w for w, _ in words]
        used = bytearray(size)
        used[0] = 1
        free = 1
        todo = [(0, 0, len(words), 0)]  # state, first and last word below it, depth
        top = 0
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[lo]) == depth:
                self.value[state] = words[lo][1]
                lo += 1
            kids = []
            while lo < hi:
                c, first = keys[lo][depth], lo
                while lo < hi and keys[lo][depth] == c:
                    lo += 1
                kids.append((c + 1, first, lo))
            if not kids:
                continue
            while used[free]:
                free += 1
            at = free
            while True:
                b = at - kids[0][0]
                if b >= 0 and not any(used[b + c] for c, _, _ in kids):
                    break
                at = used.find(0, at + 1)
            self.base[state] = b
            for c, first, last in kids:
                used[b + c] = 1
                self.check[b + c] = state
                top = max(top, b + c)
                todo.append((b + c, first, last, depth + 1))
        self.base, self.check, self.value = (x[: top + 258].copy() for x in (self.base, self.check, self.value))


def load(path: str) -> dict:
    """Pieces of a model file: (bytes, id, score) of the normal ones, ids of the byte pieces, text of each id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte_ids, normal = [0] * 256, []
    out = [b""] * n
    for i in range(n):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out[i] = bytes([int(piece[3:5], 16)])
        elif not (m.is_control(i) or m.is_unknown(i)):
            normal.append((piece.encode(), i, m.get_score(i)))
            out[i] = piece.replace(MARK, " ").encode()
    return {"normal": normal, "bytes": byte_ids, "out": out}


def zipf(vocabulary: dict) -> dict:
    """The vocabulary with log scores by a Zipf law over the order of the normal pieces."""
    rows = sorted(vocabulary["normal"], key=lambda x: x[1])
    total = float(np.log(np.sum(1 / (np.arange(len(rows)) + 1.0))))
    return vocabulary | {"normal": [(p, i, float(np.float32(-np.log(r + 1.0) - total))) for r, (p, i, _) in enumerate(rows)]}


class Unigram:
    def __init__(self, vocabulary: dict) -> None:
        normal = vocabulary["normal"]
        self.trie = DoubleArray([(p, i) for p, i, _ in normal])
        self.scores = np.zeros(len(vocabulary["out"]), np.float32)
        for _, i, s in normal:
            self.scores[i] = s
        self.unk = np.float32(min(s for _, _, s in normal) - 10)
        self.bytes = np.array(vocabulary["bytes"], np.int32)
        self.out = vocabulary["out"]
        self.mark = b"".join(int(self.bytes[b]).to_bytes(4, "little") for b in MARK.encode())
        self.cache: dict[str, bytes] = {}

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """The best path of each non-empty word, as little-endian ids of 4 bytes."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        words = [words[i] for i in order]
        size = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        buf = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        best = np.full(len(buf) + 1, -np.inf, np.float32)
        piece, back = np.zeros(len(buf) + 1, np.int32), np.zeros(len(buf) + 1, np.int32)
        best[start] = 0
        lead = (buf & 0xC0) != 0x80
        width = np.ones(len(buf), np.int64) + (buf >= 0xC0) + (buf >= 0xE0) + (buf >= 0xF0)
        active = len(words) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        for i in range(int(size[0])):
            n = active[i]
            at = start[:n] + i
            at = at[lead[at]]
            if not len(at):
                continue
            own = best[at]
            single = np.zeros(len(at), bool)
            who, pos, state = np.arange(len(at)), at, np.zeros(len(at), np.int32)
            while len(who):
                nxt = base[state] + buf[pos] + 1  # the byte 0 between words leads nowhere that a piece goes
                ok = (check[nxt] == state) & (buf[pos] != 0)
                who, pos, state = who[ok], pos[ok] + 1, nxt[ok]
                got = value[state]
                hit = got >= 0
                if hit.any():
                    w, p, g = who[hit], pos[hit], got[hit]
                    cand = own[w] + scores[g]
                    single[w] |= p == at[w] + width[at[w]]
                    up = cand > best[p]
                    best[p[up]], piece[p[up]], back[p[up]] = cand[up], g[up], at[w[up]]
            rest = at[~single]
            if len(rest):
                end = rest + width[rest]
                cand = own[~single] + self.unk
                up = cand > best[end]
                rest, end, cand = rest[up], end[up], cand[up]
                best[end] = cand
                for k in range(4):
                    more = rest + k < end
                    rest, end = rest[more], end[more]
                    piece[rest + k + 1], back[rest + k + 1] = self.bytes[buf[rest + k]], rest + k
        steps, at, who = [], start + size, np.arange(len(words))
        while len(who):
            steps.append((who, piece[at]))
            at = back[at]
            more = at > start[who]
            who, at = who[more], at[more]
        count = np.zeros(len(words), np.int64)
        for w, _ in steps:
            count[w] += 1
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]), "<i4")
        for k, (w, p) in enumerate(steps, 1):
            flat[ends[w] - k] = p
        raw, out = flat.tobytes(), [b""] * len(words)
        ends, count = (4 * ends).tolist(), (4 * count).tolist()
        for j, i in enumerate(order):
            out[i] = raw[ends[j] - count[j] : ends[j]]
        return out

    def learn(self, segments: set[str]) -> None:
        """Put segments into the cache, which is emptied when full; a NUL takes its byte piece by itself."""
        if len(self.cache) + len(segments) > CACHE:
            self.cache = {}
        parts = {p for s in segments for p in s.split("\0")} - {""} if any("\0" in s for s in segments) else segments
        todo = sorted(parts, key=len)
        got: dict[str, bytes] = {}
        first = 0
        while first < len(todo):
            last, total = first, 0
            while last < len(todo) and total < 4 << 20:
                total += len(todo[last]) + 1
                last += 1
            got.update(zip(todo[first:last], self.viterbi([w.encode() for w in todo[first:last]])))
            first = last
        nul = int(self.bytes[0]).to_bytes(4, "little")
        for s in segments:
            self.cache[s] = nul.join(got.get(p, b"") for p in s.split("\0"))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            if not text:
                cut.append([])
                continue
            runs = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    runs.append(None)
                runs += _SEGMENT.findall((MARK if not k else "") + part.replace(" ", MARK))
            cut.append(runs)
        new = {s for runs in cut for s in runs if s not in self.cache} - {None}
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache = {}
                new = {s for runs in cut for s in runs if s is not None}
            self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, runs)) if None not in runs else b"".join(self.mark if s is None else get(s) for s in runs) for runs in cut]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, without the dummy prefix; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_MODELS: dict[int, Unigram] = {}


def _model(shipped) -> Unigram:
    if shipped.id not in _MODELS:
        _MODELS.clear()
        _MODELS[shipped.id] = Unigram(shipped.value)
    return _MODELS[shipped.id]


class _Shipped:
    """A vocabulary on its way to the executors (some 32,000 pieces: its size doesn't depend on the data)."""

    def __init__(self, spark, vocabulary: dict) -> None:
        self.cast = spark.sparkContext.broadcast(vocabulary)
        self.id = hash((len(vocabulary["normal"]), vocabulary["normal"][-1]))

    @property
    def value(self) -> dict:
        return self.cast.value


def ship(spark, vocabulary: dict) -> _Shipped:
    return _Shipped(spark, vocabulary)


def encode(df: DataFrame, shipped: _Shipped, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped)
        for batch in batches:
            raw = m.encode(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def lists(ids: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row, null as none, through numpy: Arrow makes an object of its own of every id."""
    ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    return (flat[a:b].tolist() for a, b in zip(ends, ends[1:]))


def decode(df: DataFrame, shipped: _Shipped) -> DataFrame:
    """doc_id, ids and text: the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped)
        for batch in batches:
            ids = batch.column("ids")
            texts = [m.decode(x) for x in lists(ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def brute(word: bytes, vocabulary: dict) -> float:
    """The best score of a word by plain dynamic programming, for tests."""
    pieces = {p: s for p, _, s in vocabulary["normal"]}
    unk = min(pieces.values()) - 10
    text = word.decode()
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            s = pieces.get(text[i:j].encode(), unk if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]
