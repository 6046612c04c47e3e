"""Sequences and structures as integers, by column expressions.

A sequence of up to 31 bases is a BIGINT code, two bits a base (A0 C1 U2 G3), site 0 in the
highest bits. A dot-bracket structure is a BIGINT: a leading 1, then `.`=00 `(`=10 `)`=01.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
BASES = "ACUG"
SYMBOLS = {".": "00", "(": "10", ")": "01"}
PAIRS = ("AU", "UA", "GC", "CG", "GU", "UG")
#: Both bits of every base from its lower bit, and the lower bits alone.
LOW_BITS = 0x5555555555555555


def seq_to_code(seq: Column) -> Column:
    """T counts as U; null, empty or foreign bases give null."""
    digits = F.translate(F.upper(seq), "ACUTG", "01223")
    return F.when(digits.rlike("^[0-3]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def code_to_seq(code: Column, length: int) -> Column:
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), length, "0")
    return F.translate(digits, "0123", BASES)


def base_at(code: Column, pos: Column, length: int) -> Column:
    """The base number at a site."""
    return F.call_function("shiftright", code, (2 * (F.lit(length - 1) - pos)).cast("int")).bitwiseAND(F.lit(3)).cast("int")


def with_base(code: Column, pos: Column, base: Column, length: int) -> Column:
    """The code with another base at a site."""
    return code.bitwiseXOR(F.call_function("shiftleft", base_at(code, pos, length).bitwiseXOR(base.cast("int")).cast("long"), (2 * (F.lit(length - 1) - pos)).cast("int")))


def masked(code: Column, pos: Column, length: int) -> Column:
    """The code with a site set to base 0: equal for just the sequences that differ there alone."""
    return code.bitwiseXOR(F.call_function("shiftleft", base_at(code, pos, length).cast("long"), (2 * (F.lit(length - 1) - pos)).cast("int")))


def hamming(a: Column, b: Column) -> Column:
    """Sites at which two codes of equal length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS)))


def structure_to_code(structure: Column) -> Column:
    """`_ [ ]` count as `. ( )`; other characters give null. Good to 31 sites."""
    plain = F.translate(structure, "_[]", ".()")
    bits = plain
    for symbol, two in SYMBOLS.items():
        bits = F.replace(bits, F.lit(symbol), F.lit(two))
    return F.when(plain.rlike(r"^[.()]{0,31}$"), F.conv(F.concat(F.lit("1"), bits), 2, 10).cast("long"))


def code_to_structure(code: Column) -> Column:
    """The structure of an integer, null of null; an even number of bits, or the pair 11, is an error."""
    bits = F.conv(code.cast("string"), 10, 2)
    tail = F.substring(bits, F.lit(2), F.length(bits))
    n = (F.length(tail) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    symbol = lambda k: F.element_at(F.create_map(*[F.lit(x) for s, two in SYMBOLS.items() for x in (two, s)]), F.substring(tail, 2 * k + 1, F.lit(2)))
    joined = F.array_join(F.transform(steps, symbol), "")
    odd = (F.length(tail) % 2 == 1) | (F.length(joined) < n)
    return F.when(odd, F.raise_error(F.concat(F.lit("no structure: "), code.cast("string")))).when(code.isNotNull(), joined)


def is_unfolded(code: Column) -> Column:
    """No bit after the leading one: 0, 1 and all powers of two."""
    return code.bitwiseAND(code - 1) == 0


def fits(seq: Column, pairs: Column) -> Column:
    """Whether every pair (array of structs i, j counted from 0) joins bases that can pair."""
    both = lambda p: F.concat(F.substring(seq, p["i"] + 1, F.lit(1)), F.substring(seq, p["j"] + 1, F.lit(1)))
    return F.forall(pairs, lambda p: both(p).isin(*PAIRS))
