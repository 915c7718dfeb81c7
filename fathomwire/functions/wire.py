"""Wire primitives as Catalyst expressions.

They stay in the JVM; those that use ``let`` (varints, fixed numbers, floats) are evaluated outside of generated code, as Spark does with all
functions over arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_63 = 1 << 63
TWO_64 = 1 << 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, which keeps expression trees small."""
    return F.transform(F.array(value), use)[0]


def raw(data: bytes) -> Column:
    """A binary literal."""
    return F.lit(bytearray(data))


def byte(value: Column) -> Column:
    """One byte: the low eight bits of a number."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(255).cast("long"))), 2, "0"))


def zigzag(value: Column) -> Column:
    """Signed long to the unsigned long (as its bits) whose small values are near zero."""
    v = value.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(bits: Column) -> Column:
    u = bits.cast("long")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def unsigned_bits(value: Column) -> Column:
    """decimal(20,0) in 0 .. 2**64-1 to the long with the same bits."""
    d = value.cast("decimal(21,0)")
    return F.when(d >= F.lit(str(TWO_63)).cast("decimal(21,0)"), (d - F.lit(str(TWO_64)).cast("decimal(21,0)")).cast("long")).otherwise(d.cast("long"))


def from_bits(bits: Column) -> Column:
    """A long's bits read as unsigned, as decimal(20,0)."""
    d = bits.cast("long").cast("decimal(21,0)")
    return F.when(bits < 0, d + F.lit(str(TWO_64)).cast("decimal(21,0)")).otherwise(d).cast("decimal(20,0)")


def uvarint_size(bits: Column) -> Column:
    """Bytes of a LEB128 number, 1 to 10; a negative long counts as unsigned."""
    v = bits.cast("long")
    # a sum without branches: generated code works ``v`` out once
    return reduce(lambda n, k: n + (v >= (1 << 7 * k)).cast("int"), range(1, 9), F.lit(1)) + (v < 0).cast("int") * 9


def svarint_size(value: Column) -> Column:
    return uvarint_size(zigzag(value))


def _two_digits(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def _uvarint_hex(bits: Column) -> Column:
    low, more = F.lit(127).cast("long"), F.lit(128).cast("long")

    def packed(v: Column, n: int) -> Column:
        """The n bytes as one number, the first byte highest."""
        total = None
        for i in range(n):
            group = F.shiftrightunsigned(v, 7 * i).bitwiseAND(low)
            group = F.shiftleft(group.bitwiseOR(more) if i < n - 1 else group, 8 * (n - 1 - i))
            total = group if total is None else total.bitwiseOR(group)
        return F.lpad(F.hex(total), 2 * n, "0")

    def long_form(v: Column, n: int) -> Column:
        last = [_two_digits(F.shiftrightunsigned(v, 7 * i).bitwiseAND(low).bitwiseOR(more if i < n - 1 else F.lit(0).cast("long"))) for i in range(8, n)]
        head = None
        for i in range(8):
            group = F.shiftleft(F.shiftrightunsigned(v, 7 * i).bitwiseAND(low).bitwiseOR(more), 8 * (7 - i))
            head = group if head is None else head.bitwiseOR(group)
        return F.concat(F.lpad(F.hex(head), 16, "0"), *last)

    def spell(v: Column) -> Column:
        out = long_form(v, 9)
        for n in range(8, 0, -1):
            out = F.when(v < (1 << 7 * n), packed(v, n)).otherwise(out)
        return F.when(v < 0, long_form(v, 10)).otherwise(out)

    return let(bits.cast("long"), spell)


def uvarint(bits: Column) -> Column:
    """LEB128 bytes of an unsigned number given as a long's bits."""
    return F.unhex(_uvarint_hex(bits))


def svarint(value: Column) -> Column:
    """Zigzag, then LEB128."""
    return uvarint(zigzag(value))


def fixed_le(bits: Column, size: int) -> Column:
    """``size`` little-endian bytes of a number."""
    low = F.lit(255).cast("long")

    def turned(v: Column) -> Column:
        total = None
        for i in range(size):
            part = F.shiftleft(F.shiftrightunsigned(v, 8 * i).bitwiseAND(low), 8 * (size - 1 - i))
            total = part if total is None else total.bitwiseOR(part)
        return F.lpad(F.hex(total), 2 * size, "0")

    return F.unhex(let(bits.cast("long"), turned))


def canonical_float(value: Column) -> Column:
    """One NaN, and no negative zero."""
    return F.when(F.isnan(value), F.lit(float("nan")).cast("double")).when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))


def is_negative_zero(value: Column) -> Column:
    """Whether a floating number is zero with a sign, which no comparison tells."""
    return (value == 0) & value.cast("double").cast("string").startswith("-")


def _ieee(value: Column, exponent_bits: int, fraction_bits: int) -> Column:
    """IEEE 754 bits by exact scaling: powers of two multiply without rounding."""
    bias = (1 << (exponent_bits - 1)) - 1
    one = F.lit(1 << fraction_bits).cast("long")
    top = F.lit(((1 << exponent_bits) - 1) << fraction_bits).cast("long")
    shift = bias - 1 + fraction_bits

    def scaled(size: Column, e: Column) -> Column:
        return size * F.pow(F.lit(2.0), (F.lit(fraction_bits) - e).cast("double"))

    def assemble(size: Column, e: Column, less: int) -> Column:
        return (e + (bias - less)).cast("long") * one + (scaled(size, e).cast("long") - one)

    def normal(size: Column, less: int) -> Column:
        def settle(e: Column) -> Column:  # the logarithm may miss by one
            return let(scaled(size, e), lambda m: e + F.when(m >= 2.0 ** (fraction_bits + 1), 1).when(m < 2.0**fraction_bits, -1).otherwise(0))

        return let(let(F.floor(F.log2(size)).cast("int"), settle), lambda e: assemble(size, e, less))

    def of_size(size: Column) -> Column:
        return (
            F.when(size == float("inf"), top)
            .when(size == 0, F.lit(0).cast("long"))
            .when(size < 2.0 ** (1 - bias), (size * 2.0 ** (shift // 2) * 2.0 ** (shift - shift // 2)).cast("long"))
            .when(size < 2.0**-500, let(size * 2.0**600, lambda s: normal(s, 600)))  # out of reach of one power of two
            .otherwise(normal(size, 0))
        )

    sign = F.lit(-(1 << 63) if exponent_bits == 11 else 1 << 31).cast("long")

    def signed(x: Column) -> Column:
        bits = let(F.abs(x), of_size)
        return F.when(F.isnan(x), top + F.lit(1 << (fraction_bits - 1)).cast("long")).when(x < 0, bits.bitwiseOR(sign)).otherwise(bits)

    return let(value.cast("double"), signed)


def double_bits(value: Column) -> Column:
    """The canonical bits of a double, as a long."""
    return _ieee(value, 11, 52)


def float_bits(value: Column) -> Column:
    """The canonical bits of a float, as a long below 2**32."""
    return _ieee(value.cast("float"), 8, 23)


def compact_tag(number: int, wire_type: int) -> bytes:
    """A field's tag: one byte up to field 15, else a marker and the number."""
    if number <= 0:
        raise ValueError(f"field number {number} must be positive")
    if number <= 15:
        return bytes([number << 4 | wire_type << 1])
    return bytes([wire_type << 1 | 1]) + uvarint_bytes(number)


def uvarint_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def legacy_tag(number: Column, wire_type: int) -> Column:
    """The older tag: number * 8 + wire type, as a varint."""
    return uvarint(number.cast("long") * 8 + wire_type)


def framed(payload: Column) -> Column:
    """The payload behind its length."""
    return F.concat(uvarint(F.octet_length(payload)), payload)


def joined(parts: Column) -> Column:
    """An array of binaries one after another, in linear time."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def leading_uvarint(data: Column) -> Column:
    """The varint at the head of a binary, as a long's bits; null if it is cut short or longer than ten bytes."""

    def at(i: int) -> Column:
        return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")

    bytes_ = [at(i) for i in range(10)]
    total = F.lit(0).cast("long")
    ends = []
    for i, b in enumerate(bytes_):
        total = total.bitwiseOR(F.shiftleft(b.bitwiseAND(F.lit(127).cast("long")), 7 * i))
        ends.append((b < 128, total))
    return reduce(lambda acc, e: F.when(e[0], e[1]).otherwise(acc), reversed(ends), F.lit(None).cast("long"))


def type_id_class(type_id: Column) -> Column:
    """Who may use a type id: nil, builtin (below 64), stdlib (below 128) or user."""
    return F.when(type_id == 0, "nil").when(type_id < 64, "builtin").when(type_id < 128, "stdlib").otherwise("user")
