"""Secret scans: base patterns and multipart credential linking, with DataFrame functions only.

Base spans (always reported): ``assign`` (a named secret and its value), ``access`` (AKIA identifiers), ``hex`` (long
runs of hexadecimal digits). Weak candidates say little alone: ``id`` (a named access or account identifier), ``key``
(a bare mixed run of 32 or more characters), ``endpoint`` (a service URL). An interval join within a text puts every
weak candidate beside the parts whose spans lie at most ``SCOPE`` code points away, outside of it: an ``id`` is reported
only if a secret (assign, hex, key) is in scope, a ``key`` only if an identifier (access, id) is, an ``endpoint`` only if
both are. Candidates that a base span covers wholly are no parts of their own; such as overlap one in part are.

Texts are scanned once, into a table without them where they aren't asked for. Only rows with weak candidates enter the
join, on the row's number in that table and position bucket; since parts have a least length and don't overlap within a
kind, a bucket holds a bounded number of them. Lists within a row are built in blocks of the root of their length, so a
text of n matches takes n times that root steps.

Defined results: null counts as empty and has no spans; a text of any length is scanned whole; equal texts get equal
results; repeated rows get a row each; ``redact`` keeps all other columns, whatever their names, ``scan`` too but for
columns named base or spans, which its own replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, numbered

SCOPE = 240
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
MASK = "[SECRET]"

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ID = r"""(?i)(access|client|account|user)[_-]?(?:key[_-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
KEY = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""(?i)(https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>|]+"""
#: A text without this has no match that stays: a cheap first test.
FIRST = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "id": r"""(?i)(?:id|name)["']?\x20*[:=]""",
    "key": r"[A-Za-z0-9+/_-]{32}",
    "endpoint": r"://",
}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All that ``step`` (state, item -> next state, list of outputs) puts out over ``items``: an array of type ``kind``.

    The items go in blocks of the root of their number, so that no item costs a copy of the whole list."""
    none = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        after, found = step(acc["at"], x)
        return F.struct(after.alias("at"), F.concat(acc["out"], found).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(block, zero, inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        count = F.greatest(F.ceil(F.size(all_) / width).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(all_, (k - 1) * width + 1, width))
        zero = F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(blocks, zero, outer, lambda acc: acc["out"]))

    return F.transform(F.array(items), whole)[0]  # bound to a name, so made once


def _spans(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: what lies between matches gives their places.

    ``keep``: a condition on the text of ``group``."""
    between, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(between, match, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match, keep or (lambda v: v.isNotNull()))
    parts = F.zip_with(sizes, good, lambda x, ok: F.struct(x["b"].alias("b"), F.coalesce(x["m"], F.lit(0)).alias("m"), F.coalesce(ok, F.lit(False)).alias("ok")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["b"], at + x["b"] + x["m"]
        return end, F.when(x["ok"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(F.array().cast(_SPAN))

    return _running(parts, F.lit(0), _SPAN, step)


def _found(text: Column, kind: str) -> Column:
    none = F.array().cast(_SPAN)
    n = KINDS.index(kind)
    if kind == "assign":
        spans = _spans(text, n, ASSIGN, lambda v: F.length(v) >= 12, 2)
    elif kind == "access":
        spans = _spans(text, n, ACCESS, lambda v: F.length(v) >= 18)
    elif kind == "hex":  # maximal runs: those of 16 or more are the matches of this pattern too
        spans = _spans(text, n, HEX[:-1] + "{16,}")
    elif kind == "id":
        spans = _spans(text, n, ID)
    elif kind == "key":
        spans = _spans(text, n, KEY, lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    else:
        spans = _spans(text, n, ENDPOINT)
    return F.when(text.rlike(FIRST[kind]), spans).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _parts(df: DataFrame, text: Column) -> DataFrame:
    """df with ``base``: sorted base spans, and ``weak``: the weak candidates that no base span covers."""
    df = df.withColumn("base", F.sort_array(F.concat(*[_found(text, k) for k in KINDS[:3]]))).withColumn("weak", F.concat(*[_found(text, k) for k in KINDS[3:]]))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        none = F.array().cast(_SPAN)
        return F.when(x["kind"] < 3, F.greatest(at, x["end"])).otherwise(at), F.when((x["kind"] < 3) | (x["end"] <= at), none).otherwise(F.array(x))

    # in order of start, base spans first: the furthest end of the base spans so far tells
    outside = _running(F.sort_array(F.concat("base", "weak")), F.lit(0), _SPAN, step)
    return df.withColumn("weak", F.when(F.size("weak") > 0, outside).otherwise(F.col("weak")))


def _links(rows: DataFrame, scope: int) -> DataFrame:
    """``row`` and ``linked``: the weak candidates of a row that have their complementary parts in scope."""
    parts = rows.select("row", F.inline(F.concat("base", "weak")))
    role = lambda *kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = parts.where(F.col("kind") >= 3).select("row", "start", "kind", "end", bucket(F.col("start") - scope, F.col("end") + scope).alias("at"))
    near = parts.select("row", F.col("start").alias("s"), F.col("end").alias("e"), role("access", "id").alias("names"), role("assign", "hex", "key").alias("secret"), bucket(F.col("start"), F.col("end")).alias("at"))
    apart = (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start")))
    pairs = weak.join(near, ["row", "at"]).where(apart)
    seen = pairs.groupBy("row", "start", "kind", "end").agg(F.bool_or("names").alias("names"), F.bool_or("secret").alias("secret"))
    rule = (role("id") & F.col("secret")) | (role("key") & F.col("names")) | (role("endpoint") & F.col("names") & F.col("secret"))
    return seen.where(rule).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def _scanned(df: DataFrame, text: Column, own: list[str], scope: int) -> DataFrame:
    """Columns ``own`` of ``df`` (c0, c1, ...) with ``base`` and ``spans``, from one pass over the texts."""
    table = cut(_parts(df, F.coalesce(text, F.lit(""))).select(*own, "base", "weak", F.monotonically_increasing_id().alias("row")), "spans")
    some = table.where(F.size("weak") > 0)
    joined = some.join(_links(some.select("row", "base", "weak"), scope), "row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    alone = table.where(F.size("weak") == 0).select(*own, "base", F.col("base").alias("spans"))
    return alone.unionByName(joined.select(*own, "base", spans.alias("spans")))


def scan(df: DataFrame, text_col: str = "text", scope: int = SCOPE, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (default: all) and ``base`` and ``spans``: sorted arrays of (start, kind, end), kind by place
    in ``KINDS``."""
    plain, names = numbered(df)
    kept = [c for c in (names if columns is None else columns) if c not in ("base", "spans")]
    ids = [f"c{names.index(c)}" for c in kept]
    found = _scanned(plain, F.col(f"c{names.index(text_col)}").cast("string"), ids, scope)
    return found.select(*[F.col(i).alias(c) for i, c in zip(ids, kept)], "base", "spans")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


#: Code points of the pieces in which ``redact`` looks places up.
_PIECE = 4096


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with spans masked: what lies between them, cut from pieces of bounded length."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = (s["start"] > at) | ((at == 0) & (s["start"] == 0))
        return F.greatest(at, s["end"]), F.when(fresh, F.array(F.struct(at.alias("lo"), s["start"].alias("hi")))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))

    def between(x: Column, g: Column) -> Column:
        first, last = F.floor(g["lo"] / _PIECE).cast("int"), F.floor((g["hi"] - 1) / _PIECE).cast("int")
        head = F.substring(x["p"][first], g["lo"] - first * _PIECE + 1, F.least(g["hi"] - g["lo"], F.lit(_PIECE)))
        inner = F.array_join(F.slice(x["p"], first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(last > first, F.substring(x["p"][last], F.lit(1), g["hi"] - last * _PIECE)).otherwise("")
        return F.when(g["hi"] > g["lo"], F.concat(head, inner, tail)).otherwise("")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    gaps = _running(spans, F.lit(0), "array<struct<lo:int,hi:int>>", step)
    rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("lo"), F.length(text).alias("hi"))
    told = F.struct(pieces.alias("p"), F.concat(gaps, F.array(rest)).alias("g"))
    return F.transform(F.array(told), lambda x: F.array_join(F.transform(x["g"], lambda g: between(x, g)), MASK))[0]


def redact(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with every reported span masked; spans that touch become one mask. Null texts stay null."""
    plain, names = numbered(df)
    at = names.index(text_col)
    scanned = _scanned(plain, F.col(f"c{at}").cast("string"), plain.columns, scope)
    new = F.when(F.size("spans") > 0, _masked(F.col(f"c{at}").cast("string"), F.col("spans"))).otherwise(F.col(f"c{at}"))
    return scanned.select(*[(new if i == at else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
