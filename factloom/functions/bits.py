"""Bit-vector operations on longs of up to 63 bits, masked to their width."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(c: Column, width: int) -> Column:
    return c.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def signed(c: Column, width: int) -> Column:
    """Two's complement value of a masked vector."""
    return F.when(c >= (1 << (width - 1)), c - F.lit(1 << width).cast("decimal(20,0)").cast("long") if width < 63 else c - F.lit(2**62) - F.lit(2**62)).otherwise(c)


def binary(op: str, a: Column, b: Column, width: int, signs: bool = False) -> Column:
    """The named two-sided operation; comparisons are signed only if both sides are."""
    if signs and op in ("lt", "le", "gt", "ge"):
        a, b = signed(a, width), signed(b, width)
    small = F.when(b < width, b).otherwise(F.lit(width)).cast("int")
    return {
        "add": lambda: mask(a + b, width),
        "subtract": lambda: mask(a - b, width),
        "multiply": lambda: mask((a.cast("decimal(20,0)") * b.cast("decimal(20,0)") % F.lit(1 << width).cast("decimal(20,0)")).cast("long"), width),
        "and": lambda: a.bitwiseAND(b),
        "or": lambda: a.bitwiseOR(b),
        "xor": lambda: a.bitwiseXOR(b),
        "xnor": lambda: mask(F.bitwise_not(a.bitwiseXOR(b)), width),
        "eq": lambda: (a == b).cast("long"),
        "ne": lambda: (a != b).cast("long"),
        "lt": lambda: (a < b).cast("long"),
        "le": lambda: (a <= b).cast("long"),
        "gt": lambda: (a > b).cast("long"),
        "ge": lambda: (a >= b).cast("long"),
        "logical_and": lambda: ((a != 0) & (b != 0)).cast("long"),
        "logical_or": lambda: ((a != 0) | (b != 0)).cast("long"),
        "shl": lambda: F.when(b < width, mask(F.call_function("shiftleft", a, small), width)).otherwise(F.lit(0)),
        "shr": lambda: F.when(b < width, F.call_function("shiftrightunsigned", a, small)).otherwise(F.lit(0)),
        "ashr": lambda: mask(F.call_function("shiftright", signed(a, width), F.when(b < width, b).otherwise(F.lit(width - 1)).cast("int")), width),
    }[op]()


def unary(op: str, a: Column, width: int) -> Column:
    full = F.lit((1 << width) - 1).cast("long")
    parity = F.bit_count(a) % 2
    return {
        "plus": lambda: a,
        "minus": lambda: mask(-a, width),
        "not": lambda: mask(F.bitwise_not(a), width),
        "logical_not": lambda: (a == 0).cast("long"),
        "reduce_and": lambda: (a == full).cast("long"),
        "reduce_nand": lambda: (a != full).cast("long"),
        "reduce_or": lambda: (a != 0).cast("long"),
        "reduce_nor": lambda: (a == 0).cast("long"),
        "reduce_xor": lambda: parity.cast("long"),
        "reduce_xnor": lambda: (1 - parity).cast("long"),
    }[op]()


def cut(a: Column, high: int, low: int) -> Column:
    """Bits high down to low."""
    return mask(F.shiftrightunsigned(a, low), high - low + 1)


def joined(parts: list[tuple[Column, int]]) -> Column:
    """Concatenation, most significant part first."""
    return reduce(lambda acc, p: F.shiftleft(acc, p[1]).bitwiseOR(p[0]), parts[1:], parts[0][0])


def mux(select: Column, yes: Column, no: Column) -> Column:
    return F.when(select != 0, yes).otherwise(no)
