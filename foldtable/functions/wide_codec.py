"""Sequences of 32 to 62 bases as two integers, with the functions of `codec` for them.

A wide code is a struct of two BIGINTs: `lo` holds the last 31 sites, `hi` those before, both as
`codec` holds a sequence. Structs compare as the sequences do, so wide codes are keys, labels and
minima as plain ones are. Operators that take `codes` work on either kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codec

#: Sites of one half.
HALF = 31
LONGEST = 2 * HALF


def seq_to_code(seq: Column) -> Column:
    """T counts as U; null, empty, foreign bases or more than 62 of them give null."""
    digits = F.translate(F.upper(seq), "ACUTG", "01223")
    number = lambda s: F.when(F.length(s) > 0, F.conv(s, 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    before = F.greatest(F.length(digits) - HALF, F.lit(0))
    both = F.struct(number(F.substring(digits, F.lit(1), before)).alias("hi"), number(F.substring(digits, before + 1, F.lit(HALF))).alias("lo"))
    return F.when(digits.rlike(f"^[0-3]{{1,{LONGEST}}}$"), both)


def code_to_seq(code: Column, length: int) -> Column:
    last = min(length, HALF)
    digits = F.lpad(F.conv(code["lo"].cast("string"), 10, 4), last, "0")
    if length > last:
        digits = F.concat(F.lpad(F.conv(code["hi"].cast("string"), 10, 4), length - last, "0"), digits)
    return F.translate(digits, "0123", codec.BASES)


def _place(pos: Column, length: int) -> tuple[Column, Column, Column]:
    """Whether a site lies in `lo`, and the shifts to its bits in `lo` and in `hi`."""
    after = F.lit(length - 1) - pos
    return after < HALF, (2 * after).cast("int"), (2 * (after - HALF)).cast("int")


def base_at(code: Column, pos: Column, length: int) -> Column:
    """The base number at a site."""
    low, in_lo, in_hi = _place(pos, length)
    bits = F.when(low, F.call_function("shiftright", code["lo"], in_lo)).otherwise(F.call_function("shiftright", code["hi"], in_hi))
    return bits.bitwiseAND(F.lit(3)).cast("int")


def with_base(code: Column, pos: Column, base: Column, length: int) -> Column:
    """The code with another base at a site."""
    low, in_lo, in_hi = _place(pos, length)
    change = base_at(code, pos, length).bitwiseXOR(base.cast("int")).cast("long")
    put = lambda part, shift: code[part].bitwiseXOR(F.call_function("shiftleft", change, shift))
    return F.struct(F.when(low, code["hi"]).otherwise(put("hi", in_hi)).alias("hi"), F.when(low, put("lo", in_lo)).otherwise(code["lo"]).alias("lo"))


def masked(code: Column, pos: Column, length: int) -> Column:
    """The code with a site set to base 0: equal for just the sequences that differ there alone."""
    return with_base(code, pos, F.lit(0), length)


def hamming(a: Column, b: Column) -> Column:
    """Sites at which two codes of equal length differ."""
    return codec.hamming(a["hi"], b["hi"]) + codec.hamming(a["lo"], b["lo"])
