"""Plain Python forms of the sketch formulas, written for the tests alone."""

M64 = (1 << 64) - 1
CODE = {"C": 1, "G": 2, "T": 3}
BACK = {"A": 3, "C": 2, "G": 1}


def hash64(x, factor=0xD6E8FEB86659FD93):
    for _ in range(2):
        x = ((x >> 32) ^ x) * factor & M64
    return (x >> 32) ^ x


def unhash64(x):
    return hash64(x, 0xCFEE444D8B59A89B)


def probe(x, i):
    return (unhash64(x) + (i * 69 * hash64(x)) % 1024) & M64


def fingerprint(v, h, f=3):
    if v == 0:
        return 255
    p = v.bit_length() - 1
    return (((v - (1 << p)) >> max(p - f, 0)) + (max(p - 32 + h, 0) << f)) & 255


def strands(seq, k):
    lead = seq[: k - 1]
    lead = lead.upper() if all(c in "ACGTacgt" for c in lead) else "A" * (k - 1)
    return lead + seq[k - 1 :]


def kmers(seq, k):
    s = strands(seq, k)
    forward = [CODE.get(c, 0) for c in s]
    back = [BACK.get(c, 0) for c in s]
    out = []
    for i in range(len(s) - k):
        a = b = 0
        for j in range(k):
            a = a * 4 + forward[i + j]
            b += back[i + j] << (2 * j)
        out.append(min(a, b))
    return out


def sketch(seq, k, h):
    best = {}
    for x in kmers(seq, k):
        y = hash64(x)
        bucket, fp = y >> (64 - h), fingerprint(y & ((1 << (64 - h)) - 1), h)
        if fp < 255 and (bucket not in best or fp < best[bucket][0]):
            best[bucket] = (fp, y)
    return best


def signed(x):
    return x - (1 << 64) if x >> 63 else x
