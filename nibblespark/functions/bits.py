"""Bit packing as column expressions.

Packed: element i starts at bit i * bits of little-endian 64-bit words and may lie over two of them.
Word-aligned: a word holds 64 div bits whole elements and leaves its upper bits unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import check_bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 & 1 else x


def _range(n: Column) -> Column:
    """0 .. n-1; an empty array for n = 0, where sequence() would count down."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once; inside a lambda an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _shift_left(x: Column, k: Column) -> Column:
    return F.call_function("shiftleft", x, k.cast("int"))


def _shift_right(x: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, k.cast("int"))


def word_count(n: Column, bits: int, aligned: bool) -> Column:
    per = 64 // bits
    return F.floor((n + (per - 1)) / per) if aligned else F.floor((n * bits + 63) / 64)


def pack(vals: Column, bits: int, aligned: bool = False) -> Column:
    """An array of values as an array of words."""
    check_bits(bits)
    return let(vals, lambda v: _pack(v, bits, aligned))


def _pack(vals: Column, bits: int, aligned: bool) -> Column:
    n = F.size(vals).cast("long")
    zero = F.lit(0).cast("long")

    def word(w: Column) -> Column:
        if aligned:
            per = 64 // bits
            part = F.slice(vals, (w * per + 1).cast("int"), F.lit(per))
            indexed = F.transform(part, lambda v, i: _shift_left(v.cast("long"), i * bits))
            return F.aggregate(indexed, zero, lambda acc, x: acc.bitwiseOR(x))
        first = F.floor(w * 64 / bits)
        last = F.least(n - 1, F.floor((w * 64 + 63) / bits))
        inside = F.sequence(first, last)

        def place(i: Column) -> Column:
            v, at = F.get(vals, i.cast("int")).cast("long"), i * bits - w * 64
            return F.when(at >= 0, _shift_left(v, at)).otherwise(_shift_right(v, -at))

        return F.aggregate(inside, zero, lambda acc, i: acc.bitwiseOR(place(i)))

    return F.transform(_range(word_count(n, bits, aligned)), word)


def element(words: Column, i: Column, bits: int, aligned: bool = False) -> Column:
    """One element of an array of words, by its place from 0."""
    mask = F.lit((1 << bits) - 1).cast("long")
    if aligned:
        per = 64 // bits
        w = F.get(words, F.floor(i / per).cast("int"))
        return _shift_right(w, (i % per) * bits).bitwiseAND(mask)
    k, s = F.floor(i * bits / 64).cast("int"), (i * bits) % 64
    low = _shift_right(F.get(words, k), s)
    # shifts count modulo 64, so the second word is read only where the element really reaches it
    high = F.when(s + bits > 64, _shift_left(F.get(words, k + 1), 64 - s)).otherwise(F.lit(0).cast("long"))
    return low.bitwiseOR(high).bitwiseAND(mask)


def unpack(words: Column, n: Column, bits: int, aligned: bool = False, start: Column | int = 0) -> Column:
    """n values from place ``start`` on."""
    begin = F.lit(start) if isinstance(start, int) else start
    return let(words, lambda w: F.transform(_range(n), lambda i: element(w, i + begin, bits, aligned).cast("smallint")))


def pack_rows(df: DataFrame, bits: int, aligned: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long form (keys, pos, v) to (keys, word_id, word): partial OR per word, so no array is ever gathered."""
    at, v = F.col("pos") * bits, F.col("v").cast("long")
    if aligned:
        per = 64 // bits
        parts = df.select(*keys, F.floor(F.col("pos") / per).alias("word_id"), _shift_left(v, (F.col("pos") % per) * bits).alias("x"))
    else:
        w, s = F.floor(at / 64), at % 64
        low = F.struct(w.alias("word_id"), _shift_left(v, s).alias("x"))
        high = F.struct((w + 1).alias("word_id"), _shift_right(v, 64 - s).alias("x"))
        both = F.when(s + bits > 64, F.array(low, high)).otherwise(F.array(low))
        parts = df.select(*keys, F.explode(both).alias("p")).select(*keys, "p.word_id", "p.x")
    return parts.groupBy(*keys, "word_id").agg(F.bit_or("x").alias("word"))


def count_in_word(word: Column, value: int, bits: int) -> Column:
    """How many whole lanes of an aligned word hold ``value``, without unpacking.

    Lanes are compared by XOR; a lane is zero where neither it nor its lower bits plus a full carry reach
    the lane's top bit. Halves of 32 bits are used where a lane ends at bit 63, which addition would overflow.
    """
    check_bits(bits)
    if not 0 <= value < 1 << bits:
        return F.lit(0).cast("long")
    halves = [(0, 64 // bits)] if bits in (3, 5, 6, 7) else [(0, 32 // bits), (32, 32 // bits)]
    total = F.lit(0).cast("long")
    for shift, lanes in halves:
        ones = sum(1 << (i * bits) for i in range(lanes))
        full = _signed((1 << (lanes * bits)) - 1)
        x = F.call_function("shiftrightunsigned", word, F.lit(shift)).bitwiseAND(F.lit(full)).bitwiseXOR(F.lit(_signed(ones * value)))
        low = F.lit(_signed(ones * ((1 << (bits - 1)) - 1)))
        high = F.lit(_signed(ones << (bits - 1)))
        some = (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high)
        total = total + (lanes - F.bit_count(some))
    return total


def count_packed(words: Column, n: Column, value: int, bits: int) -> Column:
    """Count of ``value`` in an aligned array; unused lanes of the last word hold 0 and are taken off."""
    per = 64 // bits
    hits = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + count_in_word(w, value, bits))
    return hits - (F.size(words) * per - n) if value == 0 else hits


def wire_bytes(words: Column) -> Column:
    """Big-endian bytes of the words."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def from_wire(raw: Column, n_words: Column) -> Column:
    word = lambda digits, w: F.conv(F.substr(digits, (w * 16 + 1).cast("int"), F.lit(16)), 16, -10).cast("long")
    return let(F.hex(raw), lambda digits: F.transform(_range(n_words), lambda w: word(digits, w)))


def wire_padding(words: Column, n: Column, bits: int) -> Column:
    """The bits of each word that hold no element."""
    per = 64 // bits

    def unused(w: Column, i: Column) -> Column:
        lanes = F.greatest(F.lit(0).cast("long"), F.least(F.lit(per).cast("long"), n - i * per))
        used = F.when(lanes == 0, F.lit(0).cast("long")).otherwise(_shift_right(F.lit(-1).cast("long"), 64 - lanes * bits))
        return w.bitwiseAND(F.bitwise_not(used))

    return F.transform(words, unused)


def packed_bytes(words: Column) -> Column:
    """Little-endian bytes of the words."""
    swap = lambda w: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.hex(_shift_right(w, i * 8).bitwiseAND(F.lit(255).cast("long"))), 2, "0")), "")
    return F.unhex(F.array_join(F.transform(words, swap), ""))


def from_packed_bytes(raw: Column, n: Column, bits: int) -> Column:
    """Words from little-endian bytes; bits after the last element become 0."""
    digits = F.hex(raw)

    def word(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substr(digits, (w * 16 + i * 2 + 1).cast("int"), F.lit(2)))
        x = F.conv(F.array_join(at, ""), 16, -10).cast("long")
        used = n * bits - w * 64
        return F.when(used >= 64, x).otherwise(x.bitwiseAND(_shift_right(F.lit(-1).cast("long"), 64 - used)))

    return F.transform(_range(word_count(n, bits, False)), word)


def value_bytes(vals: Column) -> Column:
    """One byte per value."""
    return F.unhex(F.array_join(F.transform(vals, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def nbytes(n: Column, bits: int, aligned: bool = False) -> Column:
    """Bytes kept for n values: whole words, at least one."""
    return 8 * F.greatest(word_count(n, bits, aligned), F.lit(1).cast("long"))


def store(words: Column, i: Column, value: Column, bits: int) -> Column:
    """Packed words with element i replaced."""
    mask = (1 << bits) - 1
    at = i * bits
    k, s = F.floor(at / 64), at % 64

    def rewrite(w: Column, j: Column) -> Column:
        low = w.bitwiseAND(F.bitwise_not(_shift_left(F.lit(mask).cast("long"), s))).bitwiseOR(_shift_left(value.cast("long"), s))
        high = w.bitwiseAND(F.bitwise_not(_shift_right(F.lit(mask).cast("long"), 64 - s))).bitwiseOR(_shift_right(value.cast("long"), 64 - s))
        return F.when(j == k, low).when((j == k + 1) & (s + bits > 64), high).otherwise(w)

    return F.transform(words, rewrite)
