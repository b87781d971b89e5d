"""Parameters of a sketch index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SketchParams:
    """k-mer size, log2 of the buckets, mantissa bits, log2 of the Bloom bits, least intersection.

    Fingerprints have 5 exponent bits and `mantissa` more. 3 (one byte) is the working width; 11 is
    accepted and keeps the low byte only, as a fingerprint is one byte in either width.
    """

    k: int = 31
    log2_buckets: int = 17
    mantissa: int = 3
    log2_bloom: int = 33
    threshold: float = 200

    def __post_init__(self) -> None:
        object.__setattr__(self, "threshold", int(self.threshold))
        if not 2 <= self.k <= 31:
            raise ValueError("k must lie within 2 and 31")
        if not 1 <= self.log2_buckets <= 30:
            raise ValueError("log2_buckets must lie within 1 and 30")
        if self.mantissa not in (3, 11):
            raise ValueError("mantissa must be 3 or 11")
        if not 32 <= self.log2_bloom <= 58:
            raise ValueError("log2_bloom must lie within 32 and 58")
        if self.threshold < 0:
            raise ValueError("threshold must not be negative")

    @property
    def value_bits(self) -> int:
        """Bits of a hash below its bucket."""
        return 64 - self.log2_buckets
