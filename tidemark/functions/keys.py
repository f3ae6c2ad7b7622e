"""Key encoders, byte-order helpers and small codecs."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def be64_key(number: Column, width: int = 20) -> Column:
    """Eight big-endian bytes padded with ``0`` characters: byte order is the order of non-negative numbers."""
    return F.concat(F.unhex(F.lpad(F.hex(number), 16, "0")), F.encode(F.lit("0" * (width - 8)), "UTF-8"))


def dec_key(number: Column, width: int = 20) -> Column:
    """Decimal digits padded with zeros: string order is the order of non-negative numbers."""
    return F.lpad(number.cast("string"), width, "0")


def bracketed_number(key: Column) -> Column:
    """Comparator normaliser for keys like ``[10]`` and ``[0xa]``: equal numbers get equal bytes."""
    body = F.regexp_extract(key.cast("string"), r"^\[(0x)?([0-9a-fA-F]+)\]$", 2)
    number = F.when(key.cast("string").startswith("[0x"), F.conv(body, 16, 10)).otherwise(body).cast("long")
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def short_successor(key: bytes) -> bytes:
    """A short key that is not less than ``key``: its first byte that can grow, grown."""
    for i, b in enumerate(key):
        if b != 255:
            return key[:i] + bytes([b + 1])
    return key


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none. Turns a prefix into [prefix, end)."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def shortest_separator(low: bytes, high: bytes) -> bytes:
    """A short key s with low <= s < high where low < high, else low."""
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    if n >= min(len(low), len(high)) or low[n] >= high[n]:
        return low
    if low[n] + 1 < high[n]:
        return low[:n] + bytes([low[n] + 1])
    return low


def dec_prefix_range(prefix: str, width: int = 20) -> tuple[int, int]:
    """The numbers [lo, hi) whose ``dec_key`` begins with a prefix of digits: a filter that reaches the scan."""
    lo = int(prefix.ljust(width, "0") or 0)
    return lo, lo + 10 ** (width - len(prefix))


def varint_length(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def _bytes(raw: Column) -> Column:
    """The bytes of a binary column as an array of numbers 0 to 255."""
    letters = F.split(F.decode(raw, "ISO-8859-1"), "")
    return F.transform(F.when(F.octet_length(raw) > 0, letters).otherwise(F.array().cast("array<string>")), lambda c: F.ascii(c).cast("long"))


def _words(raw: Column, size: int) -> Column:
    """The numbers that each ``size`` little-endian bytes of a binary column make up (seven at most); a rest is left out."""
    back = F.encode(F.reverse(F.decode(raw, "ISO-8859-1")), "ISO-8859-1")

    def of(b: Column) -> Column:
        n = F.floor(F.octet_length(b) / size).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.conv(F.hex(F.substring(b, F.octet_length(b) + 1 - i * size, F.lit(size))), 16, 10).cast("long"))

    # an array of one binds the reversed bytes, which would otherwise be made anew for each word
    return F.element_at(F.transform(F.array(back), of), 1)


def _binary(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def fixed(number: Column, size: int) -> Column:
    """``size`` little-endian bytes of a number (as unsigned)."""
    return _binary(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftrightunsigned", number.cast("long"), i * 8).bitwiseAND(F.lit(255))))


def fixed_value(raw: Column) -> Column:
    """The number in at most eight little-endian bytes; eight with the top bit set are negative."""
    return F.aggregate(F.reverse(_bytes(raw)), F.lit(0).cast("long"), lambda a, b: F.call_function("shiftleft", a, F.lit(8)).bitwiseOR(b))


def varint(number: Column) -> Column:
    """Groups of seven bits, low ones first; all but the last byte have the top bit set. Negative numbers are unsigned."""
    n = number.cast("long")
    size = F.greatest(F.lit(1), F.ceil(F.length(F.ltrim(F.bin(n), F.lit("0"))) / 7).cast("int"))
    return _binary(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.call_function("shiftrightunsigned", n, i * 7).bitwiseAND(F.lit(127)) + F.when(i < size - 1, 128).otherwise(0)))


def varint_value(raw: Column) -> Column:
    """The number at the start of a binary column; null if it does not end there or is longer than 64 bits."""
    every = _bytes(raw)
    size = F.array_position(F.transform(every, lambda b: b < 128), True).cast("int")
    value = F.aggregate(F.reverse(F.slice(every, F.lit(1), size)), F.lit(0).cast("long"), lambda a, b: F.call_function("shiftleft", a, F.lit(7)).bitwiseOR(b.bitwiseAND(F.lit(127))))
    return F.when((size > 0) & (size <= 10), value)


def prefixed(raw: Column) -> Column:
    """Bytes behind their length as a varint."""
    return F.concat(varint(F.octet_length(raw)), raw)


def prefixed_value(raw: Column) -> Column:
    """The bytes of a length-prefixed field; null if it is cut short."""
    n = varint_value(raw)
    at = F.octet_length(varint(n))
    return F.when(at + n <= F.octet_length(raw), F.substring(raw, at + 1, n.cast("int")))


def escaped(raw: Column) -> Column:
    """Printable form of bytes: printable ASCII as it is, all else as a backslash, ``x`` and two digits."""
    one = lambda b: F.when((b >= 32) & (b <= 126), F.char(b)).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(b), 2, "0"))))
    return F.array_join(F.transform(_bytes(raw), one), "")


def leading_number(text: Column) -> Column:
    """The decimal number at the start of a text, as decimal(20, 0); null if there is none or it exceeds 64 bits."""
    digits = F.regexp_extract(text, r"^0*(\d+)", 1)
    value = F.when((digits != "") & (F.length(digits) <= 20), F.when(F.length(digits) <= 20, digits).cast("decimal(20,0)"))
    return F.when(value <= F.lit(Decimal(2**64 - 1)), value)


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


_TABLE = _crc_table()
_LOW = 0xFFFFFFFF


def crc32c(data: bytes, start: int = 0) -> int:
    """CRC-32C (Castagnoli) of ``data``, extending ``start``."""
    c = start ^ _LOW
    for b in data:
        c = c >> 8 ^ _TABLE[(c ^ b) & 255]
    return c ^ _LOW


def _zeros(size: int) -> list[list[int]]:
    """By k, what each byte becomes once it and k zeros behind it are read."""
    out = [_TABLE]
    while len(out) < size:
        out.append([c >> 8 ^ _TABLE[c & 255] for c in out[-1]])
    return out


def _starts(size: int) -> list[int]:
    """By k, the state from which k zeros lead to that at the start."""
    at, out = {c >> 24: i for i, c in enumerate(_TABLE)}, [_LOW]
    while len(out) < size:
        i = at[out[-1] >> 24]
        out.append((out[-1] ^ _TABLE[i]) << 8 & _LOW | i)
    return out


#: Bytes that the checksum takes at a time: as many as fit a long.
_TAKEN = 7
_AHEAD, _START = _zeros(_TAKEN), _starts(_TAKEN)


def _longs(numbers: list[int]) -> Column:
    """An array made of one literal: one for each number takes seconds to plan."""
    return F.split(F.lit(" ".join(map(str, numbers))), " ").cast("array<long>")


def crc32c_of(raw: Column) -> Column:
    """CRC-32C of a binary column, as a long; null counts as empty. Zeros before the first byte fill up the first word."""
    raw = F.coalesce(raw, F.lit(b""))
    n = F.octet_length(raw)
    fill = F.pmod(-n, F.lit(_TAKEN))
    tables = [_longs(t) for t in reversed(_AHEAD)]

    def step(c: Column, word: Column) -> Column:
        read = [F.element_at(t, (F.shiftright(c.bitwiseXOR(word), 8 * k).bitwiseAND(F.lit(255)) + 1).cast("int")) for k, t in enumerate(tables)]
        return reduce(Column.bitwiseXOR, read)

    words = _words(F.lpad(raw, n + fill, F.lit(b"\0")), _TAKEN)
    return F.aggregate(words, F.element_at(_longs(_START), fill + 1), step, lambda c: c.bitwiseXOR(F.lit(_LOW)))


#: Added to a checksum that is stored beside what it covers.
MASK = 0xA282EAD8


def crc_masked(crc: Column) -> Column:
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(_LOW))
    return (turned + MASK).bitwiseAND(F.lit(_LOW))


def crc_unmasked(masked: Column) -> Column:
    turned = (masked - MASK).bitwiseAND(F.lit(_LOW))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(_LOW))


#: Multiplier of the 32-bit hash, a fixed value of the format.
MULTIPLIER = 0xC6A4A793


def hash32(raw: Column, seed: int = 0) -> Column:
    """The 32-bit multiplicative hash of a binary column (as a long): little-endian words are added and mixed; of the rest
    each byte counts as signed."""
    low = lambda x: x.bitwiseAND(F.lit(_LOW))
    # less 2^32 the multiplier is under 30 bits, so that no product exceeds 63 bits
    times = lambda x: low(x * (MULTIPLIER - 2**32))
    mixed = lambda x, by: x.bitwiseXOR(F.shiftright(x, by))
    size = F.octet_length(raw)
    start = low(F.lit(seed).cast("long").bitwiseXOR(times(size.cast("long"))))
    body = F.aggregate(_words(raw, 4), start, lambda h, w: mixed(times(h + w), 16))
    rest = _words(F.rpad(F.substring(raw, size - size % 4 + 1, F.lit(3)), F.lit(4), F.lit(b"\0")), 4)
    signed = lambda r: r - r.bitwiseAND(F.lit(0x808080)) * 2
    return F.aggregate(rest, body, lambda h, r: h + signed(r), lambda h: F.when(size % 4 == 0, h).otherwise(mixed(times(low(h)), 24)))
