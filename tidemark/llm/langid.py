"""Language ID by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is cut greedily into phrases, each the longest match
that occurs in that language's sample; the language that needs the fewest phrases a character wins, phrases being
normalised by the logarithm of the sample's size. Each language keeps its whole sample, whatever the others' sizes are.

All letters of the samples have a symbol of their own. Parsing runs over all characters of all texts at once: an automaton is
a dense table (state x symbol of its sample), or with more than ``DENSE`` symbols a sorted list of its transitions; texts are cut
into blocks of ``BLOCK`` symbols (a phrase ends at a block's end), and one numpy step moves every block of a batch by a
symbol in every language. Memory is bounded by the batch and the tables.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and if nothing could be learned; ties go
to the language that sorts first; score = 1 - fewest / second fewest phrases (1 if only one language is known). Labels
that are null are not learned from. Equal texts get equal results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import held

#: Bounds of the labelled sample: languages (those with most labelled documents), documents a language, and characters a
#: language that its automaton holds.
SAMPLE_LANGS, SAMPLE_DOCS, SAMPLE_CHARS = 256, 200, 24_000
#: Symbols up to which an automaton is a dense table; symbols of a block.
DENSE, BLOCK = 128, 2048


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, langs: int = SAMPLE_LANGS) -> dict[str, str]:
    """Per language at most ``chars`` characters of at most ``docs`` labelled documents that are not held out, chosen by the
    hash of their id, for the ``langs`` languages with most of them: narrow rows are ranked first, then only the chosen texts
    are read. The sample's size does not depend on the data."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    common = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).select("lang")
    narrow = known.select("lang", "doc_id", F.xxhash64("text").alias("th"), F.xxhash64("doc_id", F.lit("langid")).alias("o"))
    by = W.partitionBy("lang").orderBy("o", "doc_id", "th")
    chosen = narrow.join(F.broadcast(common), "lang").withColumn("r", F.row_number().over(by)).where(f"r <= {docs}").select("lang", "doc_id", "th", "o").distinct()
    texts = known.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "th"])  # langs x docs rows at most
    out: dict[str, str] = {}
    for r in texts.select("lang", "o", "doc_id", F.substring("text", 1, chars).alias("text")).distinct().orderBy("lang", "o", "doc_id", "text").collect():
        out[r[0]] = out.get(r[0], "") + ("\n" + r[3] if len(out.get(r[0], "")) < chars else "")
    return {k: v[:chars] for k, v in out.items()}


class Group:
    """Automata of one form: languages, per language symbol -> own symbol and -> state of a new phrase, rows' places in all."""

    def __init__(self) -> None:
        self.langs, self.local, self.start, self.base = [], [], [], 0

    def add(self, lang: int, local: np.ndarray, start: np.ndarray, places: int) -> None:
        self.langs.append(lang)
        self.local.append(local)
        self.start.append(start)
        self.base += places


class Parser:
    """Automata of all languages; states are places of their rows, so that those of different languages differ.

    Dense automata share one table of next states, in which a negative entry also ends a phrase; the others share sorted
    arrays of transitions (place of row and symbol) and next states."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        texts = {k: samples[k].lower() for k in self.langs}
        self.norm = np.array([np.log(max(len(texts[k]), 2)) for k in self.langs])
        letters = sorted({c for v in texts.values() for c in v if c.isalpha()})
        # 0: anything that is not a letter; 1: a letter that no sample holds
        self.code = np.array([chr(at).isalpha() for at in range(0x110000)]).astype(np.min_scalar_type(len(letters) + 1))
        for i, c in enumerate(letters, 2):
            for x in {c, *(y for y in (c.upper(),) if len(y) == 1 and y.lower() == c)}:
                self.code[ord(x)] = i
        tables, keys, nexts = [], [], []
        self.dense, self.sparse = Group(), Group()
        for k, lang in enumerate(self.langs):
            codes = self.codes(texts[lang])
            own = np.unique(codes)
            # 0: a symbol that this sample lacks
            local = np.zeros(len(letters) + 2, np.int32)
            local[own] = np.arange(1, len(own) + 1)
            go, width = automaton(local[codes].tolist()), len(own) + 1
            group = self.dense if width <= DENSE else self.sparse
            count = np.array([len(g) for g in go])
            state = np.repeat(np.arange(len(go)), count)
            symbol = np.fromiter((c for g in go for c in g), np.int64, count.sum())
            after = np.fromiter((t for g in go for t in g.values()), np.int64, count.sum()) * width + group.base
            # the state that a new phrase starts in, by symbol; the last state is that after a symbol that the sample lacks
            restart = np.full(width, len(go) * width + group.base)
            restart[symbol[: count[0]]] = after[: count[0]]
            if group is self.dense:
                t = np.tile(~restart, (len(go) + 1, 1))
                t[state, symbol] = after
                tables.append(t.astype(np.int32).ravel())
            else:
                order = np.argsort(at := state * width + symbol + group.base)
                keys.append(at[order])
                nexts.append(after[order])
            group.add(k, local, restart[local], (len(go) + 1) * width)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.keys, self.nexts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nexts))

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(text, language) -> number of phrases."""
        if not self.langs:
            return np.zeros((len(texts), 0))
        parts, owner = [], []
        for i, text in enumerate(texts):
            codes = self.codes(text)
            for at in range(0, len(codes), BLOCK):
                parts.append(codes[at : at + BLOCK])
                owner.append(i)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        width = max(1, (8 << 20) // BLOCK)
        for first in range(0, len(order), width):
            some = order[first : first + width]
            counts = self._walk([parts[i] for i in some])
            np.add.at(out, [owner[i] for i in some], counts)
        return out

    def _walk(self, parts: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(p) for p in parts])
        m, n = int(sizes[0]), len(parts)
        grid = np.zeros((n, m), self.code.dtype)
        for i, p in enumerate(parts):
            grid[i, : len(p)] = p
        grid = np.ascontiguousarray(grid.T)
        active = n - np.searchsorted(sizes[::-1], np.arange(1, m + 1))  # blocks longer than t, at t = 0, 1, ...
        ended = np.zeros((len(self.langs), n), np.int64)
        if self.dense.langs:
            local, state = np.stack(self.dense.local), np.stack(self.dense.start).astype(np.int32)[:, grid[0]]
            some, table = np.zeros(state.shape, np.int64), self.table
            for t in range(1, m):
                a = active[t]
                now = table[state[:, :a] + local[:, grid[t, :a]]]
                sign = now >> 31
                some[:, :a] -= sign
                state[:, :a] = now ^ sign
            ended[self.dense.langs] = some
        if self.sparse.langs:
            local, start = np.stack(self.sparse.local), np.stack(self.sparse.start)
            state = start[:, grid[0]]
            some = np.zeros(state.shape, np.int64)
            for t in range(1, m):
                a = active[t]
                key = state[:, :a] + local[:, grid[t, :a]]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                goes = self.keys[at] == key
                some[:, :a] += ~goes
                state[:, :a] = np.where(goes, self.nexts[at], start[:, grid[t, :a]])
            ended[self.sparse.langs] = some
        return (ended + 1).T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sound = [t is not None and any(c.isalpha() for c in t) for t in texts] if self.langs else [False] * len(texts)
        got = [t for t, ok in zip(texts, sound) if ok]
        cost = self.phrases(got) * self.norm if got else None
        out, j = [], 0
        for ok in sound:
            if not ok:
                out.append(("und", 0.0))
                continue
            row = cost[j]
            j += 1
            best = int(row.argmin())
            rest = np.delete(row, best)
            out.append((self.langs[best], float(round(1 - row[best] / rest.min(), 6)) if len(rest) else 1.0))
        return out


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: by state, symbol -> state; state 0 is the root."""
    link, length, go = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def parser(samples: dict[str, str]) -> Parser:
    return held(("parser", *sorted(samples.items())), lambda: Parser(samples))


def identify(df: DataFrame, samples: dict[str, str], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` with the prediction; columns of the same names are replaced. Only the text is read for it."""
    kept = [c for c in df.columns if c not in (pred_col, score_col)]
    at = kept.index(text_col)
    shipped = df.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_CHARS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shipped.value)
        for batch in batches:
            got = p.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*batch.schema.names, pred_col, score_col])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(pred_col, F.lit("")).withColumn(score_col, F.lit(0.0)).schema
    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def brute(text: str, samples: dict[str, str], p: Parser) -> list[int]:
    """Phrase counts by substring search, for tests."""
    out = []
    for k in p.langs:
        body = "".join(map(chr, p.codes(samples[k].lower())))
        codes, n = "".join(map(chr, p.codes(text))), 0
        for first in range(0, len(codes), BLOCK):
            block, at = codes[first : first + BLOCK], 0
            while at < len(block):
                size = 1
                while at + size < len(block) and block[at : at + size + 1] in body:
                    size += 1
                at += size
                n += 1
        out.append(n)
    return out
