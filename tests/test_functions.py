import random

import plain
import pytest
from pyspark.sql import functions as F

from tessella.functions import bases, hashing
from tessella.operators.kmers import _fingerprints
from tessella.params import SketchParams

#: number, hash, inverse hash, first probe
HASHES = [
    (0, 0, 0, 0),
    (1, 4717996019076358352, 13002426248018735194, 13002426248018735210),
    (2, 2060787363917578834, 14135594693812874181, 14135594693812874207),
    (3, 8131803788478518982, 9776231714529249137, 9776231714529249999),
    (27, 5074310123473803685, 15709651626590215895, 15709651626590216272),
    (12345678901234567, 4304343024556186680, 13844367911633138866, 13844367911633139658),
    (4611686018427387903, 1051108441634324878, 5035767303624950221, 5035767303624951059),
]

#: value, log2 of buckets, fingerprint
FINGERPRINTS = [
    (0, 17, 255), (1, 17, 0), (7, 17, 3), (32767, 17, 7), (32768, 17, 0), (65536, 17, 8), (10**12, 17, 198),
    (131941395333119, 17, 254), (131941395333120, 17, 255), (10**15, 8, 206), (10**17, 4, 227),
]


def test_hashes_are_the_known_ones_and_invert(spark):
    df = spark.createDataFrame([(x,) for x, *_ in HASHES], "x long")
    df = hashing.with_probes(hashing.with_unhash64(hashing.with_hash64(df, "x", "h"), "x", "u"), "x", "p")
    df = hashing.with_unhash64(df, "h", "again")
    for r in df.collect():
        _, h, u, p = next(t for t in HASHES if t[0] == r["x"])
        assert (r["h"], r["u"], r["p"][1], r["again"]) == (plain.signed(h), plain.signed(u), plain.signed(p), r["x"])
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_32_bit_hashes_invert(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 77, 2**31, 2**32 - 1)], "x long")
    df = hashing.with_unhash32(hashing.with_hash32(df, "x", "h"), "h", "again")
    assert all(r["again"] == r["x"] and 0 <= r["h"] < 2**32 for r in df.collect())


def test_fingerprints(spark):
    for value, h, fp in FINGERPRINTS:
        assert plain.fingerprint(value, h) == fp
        df = hashing.with_fingerprint(spark.createDataFrame([(plain.signed(value | 1 << (64 - h)),)], "h long"), "h", h, 3)
        assert df.first()["fp"] == fp and df.first()["bucket"] == 1
        import numpy as np

        assert _fingerprints(np.array([value], np.uint64), SketchParams(log2_buckets=h))[0] == fp


def test_packing_and_complements(spark):
    rows = [("ACGT", 27, "ACGT", 27), ("AAAA", 0, "TTTT", 0), ("TTTT", 255, "AAAA", 0), ("ACGN", 0, "TCGT", 0), ("GATTACA", 9156, "TGTAATC", 9156), ("", 0, "", 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = {
        r["s"]: r
        for r in df.select(
            "s", bases.strand_number(F.col("s")).alias("n"), bases.reverse_complement(F.col("s")).alias("rc"), bases.canonical_number(F.col("s")).alias("c"),
            bases.clean(F.col("s")).alias("clean"), bases.canonical_string(F.col("s")).alias("cs"),
        ).collect()
    }
    for s, n, rc, c in rows:
        assert (got[s]["n"], got[s]["rc"], got[s]["c"]) == (n, rc, c)
    assert got["ACGN"]["clean"] == "" and got["ACGT"]["clean"] == "ACGT" and got["ACGN"]["cs"] == "ACGN"
    small = spark.createDataFrame([("acgt",)], "s string").select(bases.strand_number(F.col("s")).alias("n"), bases.reverse_complement(F.col("s")).alias("rc")).first()
    assert small["n"] == 27 and small["rc"] == "AcgT"


def test_small_functions(spark):
    one = spark.createDataFrame([("ACCT", "ACG", "genomeln12.5", 1234567, 228)], "a string, b string, name string, n long, x long")
    r = one.select(
        bases.hamming(F.col("a"), F.col("b")).alias("d"), bases.line_number(F.col("name")).alias("ln"), bases.before_line_number(F.col("name")).alias("rest"),
        bases.thousands(F.col("n")).alias("shown"), bases.unpack(F.col("x"), 5).alias("u"), bases.binary_digits(F.col("x")).alias("bits"),
        bases.reverse_complement_number(F.col("x"), 5).alias("rc"), bases.line_number(F.lit("none")).alias("no"), F.length(bases.random_bases(9, 1)).alias("len"),
    ).first()
    assert (r["d"], r["ln"], r["rest"], r["shown"], r["u"], r["no"], r["len"]) == (2, 12.5, "genome", "1,234,567", "ATGCA", 0.0, 9)
    assert r["bits"] == format(228, "064b") and r["rc"] == int("".join(str("ACGT".index(c)) for c in "TGCAT"), 4)
    product = hashing.with_string_product(spark.createDataFrame([("ab",), ("",)], "s string"), "s", "p").collect()
    assert [x["p"] for x in product] == [97 * 98, 1]


def test_parameters_are_validated():
    assert SketchParams(threshold=1.9).threshold == 1
    for bad in ({"k": 32}, {"log2_buckets": 0}, {"mantissa": 5}, {"log2_bloom": 31}):
        with pytest.raises(ValueError):
            SketchParams(**bad)


def test_floor_log2(spark):
    rng = random.Random(0)
    values = [rng.getrandbits(rng.randint(1, 63)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", hashing.floor_log2(F.col("v")).alias("p"))
    assert all(r["p"] == max(r["v"].bit_length() - 1, 0) for r in df.collect())
