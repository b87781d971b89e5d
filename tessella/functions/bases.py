"""Nucleotide strings as Columns: packing, complements, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_to_bases(text: Column) -> Column:
    """Letters of a text, upper-cased and folded onto ACGT (letters that are bases stay)."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]", ""))
    return F.translate(letters, "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")


def base_digits(seq: Column) -> Column:
    """Digits 0-3 of the forward strand; whatever is not C, G or T counts as A."""
    return F.translate(F.regexp_replace(seq, "[^CGT]", "A"), "ACGT", "0123")


def complement_digits(seq: Column) -> Column:
    """Digits of the complement, in the same order; whatever is not A, C or G counts as T."""
    return F.translate(F.regexp_replace(seq, "[^ACG]", "T"), "ACGT", "3210")


def from_base4(digits: Column) -> Column:
    """Number of up to 31 base-4 digits; 0 for the empty string."""
    return F.coalesce(F.conv(digits, 4, 10).cast("long"), F.lit(0))


def strand_number(seq: Column) -> Column:
    """Packed number of a short sequence, either case; any other character makes it 0."""
    return F.when(seq.rlike("^[ACGTacgt]*$"), from_base4(F.translate(F.upper(seq), "ACGT", "0123"))).otherwise(F.lit(0))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; small c and g stay small, anything else becomes T."""
    plain = F.regexp_replace(seq, "[^CGTcgt]", "A")
    return F.reverse(F.translate(plain, "ACGTcgt", "TGCAgcA"))


def canonical_number(seq: Column) -> Column:
    """The smaller of the packed numbers of a sequence and its reverse complement."""
    return F.least(strand_number(seq), strand_number(reverse_complement(seq)))


def unpack(number: Column, k: int) -> Column:
    """The k bases of a packed number."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement_number(number: Column, k: int) -> Column:
    """Packed number of the reverse complement of a packed k-mer."""
    return from_base4(F.translate(F.reverse(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0")), "0123", "3210"))


def clean(seq: Column) -> Column:
    """Upper-cased sequence, or the empty string if any character is not a base."""
    return F.when(seq.rlike("^[ACGTacgt]*$"), F.upper(seq)).otherwise(F.lit(""))


def canonical_string(seq: Column) -> Column:
    """The lexicographically smaller of a sequence and its upper-case reverse complement (others become A)."""
    flipped = F.reverse(F.translate(F.regexp_replace(seq, "[^ACG]", "T"), "ACGT", "TGCA"))
    return F.least(seq, flipped)


def hamming(a: Column, b: Column) -> Column:
    """Places of `a` at which `b` differs or has ended."""
    other = F.rpad(b, F.length(a), "\u0000")
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(other, "").alias("y"))
    return F.when(F.length(a) == 0, 0).otherwise(F.size(F.filter(pairs, lambda p: p["x"] != p["y"])))


def line_number(name: Column) -> Column:
    """The number after the first "ln" of a name, in single precision; 0 without one there."""
    rest = F.when(F.instr(name, "ln") > 0, F.substring(name, F.instr(name, "ln") + 2, F.length(name)))
    digits = F.regexp_extract(rest, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("float").cast("double"), F.lit(0.0))


def before_line_number(name: Column) -> Column:
    """A name up to its first "ln"."""
    return F.substring_index(name, "ln", 1)


def in_pieces(seq: Column, size: int) -> Column:
    """The sequence as an array of consecutive pieces of `size` characters, the last one shorter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def binary_digits(number: Column) -> Column:
    """The 64 bits of a long."""
    return F.lpad(F.bin(number), 64, "0")


def random_bases(length: int, seed: int) -> Column:
    """A random sequence, for test data only."""
    letters = F.array(*map(F.lit, "ACGT"))
    return F.concat(F.lit(""), *[F.element_at(letters, (F.floor(F.rand(seed + i) * 4) + 1).cast("int")) for i in range(length)])
