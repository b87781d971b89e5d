"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from tessella.functions.hashing import BLOOM_HASHES, MIX32, MIX64, UNMIX32, UNMIX64
from tessella.operators.index import ALPHA
from tessella.operators import search
from tessella.params import SketchParams

WRAP = "18446744073709551616::UHUGEINT"


def bases(text: str) -> str:
    return f"translate(upper(regexp_replace(coalesce({text}, ''), '[^a-zA-Z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')"


def two_bits(seq: str) -> str:
    return f"replace(replace(replace(replace({seq}, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11')"


def signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE ({x})::BIGINT END)"


SEQS = {
    "docs": f"SELECT doc_id AS id, 'doc' || doc_id AS name, {bases('text')} AS seq FROM documents",
    "pagesq": f"SELECT page_id AS id, url AS name, {bases('html')} AS seq FROM pages",
    "noisy": "SELECT doc_id AS id, translate(regexp_replace(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g'), "
    "'BDEFHIJKLMOPQRSUVWXYZbdefhijklmopqrsuvwxyz', 'ACNTACGTACTACGTCGTACacNtacgtactacgtcgtac') AS seq FROM documents",
    "items": f"SELECT item_id AS id, '>item' || item_id AS name, {bases('text')} AS seq FROM benchmark",
}


def kmers(source: str, out: str, k: int, last: bool = False) -> str:
    """CTE out(id, pos, canon); `last`: also the last k-mer of each sequence. Sequences hold bases only."""
    n = f"length(seq) - {k}" + (" + 1" if last else "")
    # Pieces of 64 positions first, so that no long string stands on every row.
    return f"""
{out}_s AS (SELECT id, length(seq) AS n, {n} AS m, {two_bits("seq")} AS f, {two_bits("reverse(translate(seq, 'ACGT', 'TGCA'))")} AS r FROM {source} WHERE {n} > 0),
{out}_u AS (SELECT *, unnest(range(0, m, 64)) AS a FROM {out}_s),
{out}_c AS (SELECT id, n, m, a, greatest(n - {k} - a - 63, 0) AS ra, substr(f, 2 * a + 1, {2 * (63 + k)}) AS f,
    substr(r, 2 * greatest(n - {k} - a - 63, 0) + 1, {2 * (63 + k)}) AS r FROM {out}_u),
{out}_p AS (SELECT *, unnest(range(a, least(a + 64, m))) AS p FROM {out}_c),
{out} AS (SELECT id, p AS pos,
    least(('0b' || substr(f, 2 * (p - a) + 1, {2 * k}))::UBIGINT, ('0b' || substr(r, 2 * (n - {k} - p - ra) + 1, {2 * k}))::UBIGINT) AS canon FROM {out}_p)"""


def noisy_kmers(source: str, out: str, k: int) -> str:
    """CTE out(id, pos, canon) as a sketch sees any characters: the first k - 1 in either case, and as A if one is no base; then capitals only."""
    return f"""
{out}_l AS (SELECT id, length(seq) AS n, substr(seq, 1, {k - 1}) AS lead, substr(seq, {k}) AS rest FROM {source} WHERE length(seq) > {k}),
{out}_s AS (SELECT id, n, (CASE WHEN regexp_full_match(lead, '[ACGTacgt]*') THEN upper(lead) ELSE repeat('A', {k - 1}) END) || rest AS s FROM {out}_l),
{out}_d AS (SELECT id, n, translate(regexp_replace(s, '[^CGT]', 'A', 'g'), 'ACGT', '0123') AS f, translate(regexp_replace(s, '[^ACG]', 'T', 'g'), 'ACGT', '3210') AS r FROM {out}_s),
{out}_p AS (SELECT *, unnest(range(1, n - {k} + 1)) AS p FROM {out}_d),
{out} AS (SELECT id, p - 1 AS pos, least({digits("substr(f, p, " + str(k) + ")", k)}, {digits("reverse(substr(r, p, " + str(k) + "))", k)})::UBIGINT AS canon FROM {out}_p)"""


def noisy_exact(source: str, out: str, k: int) -> str:
    """CTE out(id, canon): distinct canonical k-mers, either case, the last included; 0 for those with another character."""
    part = f"upper(substr(seq, p, {k}))"
    return f"""
{out}_p AS (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {source} WHERE length(seq) >= {k}),
{out}_u AS (SELECT id, {part} AS u FROM {out}_p WHERE regexp_full_match(substr(seq, p, {k}), '[ACGTacgt]*')),
{out} AS (SELECT DISTINCT id, least({digits("translate(u, 'ACGT', '0123')", k)}, {digits("translate(reverse(u), 'ACGT', '3210')", k)})::BIGINT AS canon FROM {out}_u
    UNION SELECT DISTINCT id, 0::BIGINT FROM {out}_p WHERE NOT regexp_full_match(substr(seq, p, {k}), '[ACGTacgt]*'))"""


def digits(text: str, k: int) -> str:
    """Number of k base-4 digits."""
    return "(" + " + ".join(f"ascii(substr({text}, {i + 1}, 1)) % 4 * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def mixed(source: str, column: str, out: str, name: str, factor: int) -> str:
    """CTE out: source with a 64-bit hash of an unsigned column."""
    step = lambda x: f"((xor({x} >> 32, {x}))::UHUGEINT * {factor}::UHUGEINT % {WRAP})::UBIGINT"
    return f"""
{out}_1 AS (SELECT *, {step(column)} AS _1 FROM {source}),
{out}_2 AS (SELECT * EXCLUDE (_1), {step("_1")} AS _2 FROM {out}_1),
{out} AS (SELECT * EXCLUDE (_2), xor(_2 >> 32, _2) AS {name} FROM {out}_2)"""


def fingerprints(source: str, out: str, p: SketchParams) -> str:
    """CTE out: source with bucket and fp of the hash h."""
    bits, f, h = p.value_bits, p.mantissa, p.log2_buckets
    return f"""
{out}_1 AS (SELECT *, (h >> {bits})::BIGINT AS bucket, (h & {(1 << bits) - 1}::UBIGINT)::BIGINT AS v FROM {source}),
{out}_2 AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) - 1 END AS p2 FROM {out}_1),
{out} AS (SELECT * EXCLUDE (v, p2), (CASE WHEN v = 0 THEN 255 ELSE (((v - (1::BIGINT << p2)) >> greatest(p2 - {f}, 0))
    + (greatest(p2 - 32 + {h}, 0)::BIGINT << {f})) & 255 END)::INT AS fp FROM {out}_2)"""


def sketches(source: str, out: str, p: SketchParams) -> str:
    """CTE out(id, bucket, fp, h)."""
    return ",".join([
        kmers(f"(SELECT * FROM {source} WHERE length(seq) >= {p.k})", f"{out}_k", p.k),
        mixed(f"{out}_k", "canon", f"{out}_h", "h", MIX64),
        fingerprints(f"{out}_h", f"{out}_f", p),
        f"\n{out} AS (SELECT id, bucket, min(fp) AS fp, arg_min(h, fp::BIGINT * 4294967296 + pos) AS h FROM {out}_f GROUP BY id, bucket HAVING min(fp) < 255)",
    ])


def probes(source: str, out: str) -> str:
    """CTE out: source with the unsigned probes q0.. of the hash h."""
    each = ", ".join(f"((u::UHUGEINT + (({69 * i}::UHUGEINT * hh::UHUGEINT) % 1024)) % {WRAP})::UBIGINT AS q{i}" for i in range(BLOOM_HASHES))
    return ",".join([mixed(source, "h", f"{out}_a", "hh", MIX64), mixed(f"{out}_a", "h", f"{out}_b", "u", UNMIX64), f"\n{out} AS (SELECT *, {each} FROM {out}_b)"])


def cells(source: str, out: str, p: SketchParams) -> str:
    """CTE out: source with `cells`."""
    each = ", ".join(f"(q{i} >> {p.log2_bloom + 3})::BIGINT" for i in range(BLOOM_HASHES))
    return ",".join([probes(source, f"{out}_p"), f"\n{out} AS (SELECT *, list_distinct([{each}]) AS cells FROM {out}_p)"])


def genome_meta(source: str, sketch: str, out: str, p: SketchParams) -> str:
    """CTE out(id, name, n_chars, sketch_size, genome_size)."""
    return f"""
{out}_f AS (SELECT id, count(*) AS m, sum(pow(2.0, -(fp >> {p.mantissa})::DOUBLE)) AS s FROM {sketch} GROUP BY id),
{out} AS (SELECT id, name, length(seq)::BIGINT AS n_chars, coalesce(m, 0)::BIGINT AS sketch_size,
    (CASE WHEN s IS NULL THEN 0 WHEN {ALPHA} * (m::DOUBLE * m::DOUBLE) / s > length(seq) THEN length(seq)
     ELSE floor({ALPHA} * (m::DOUBLE * m::DOUBLE) / s) END)::BIGINT AS genome_size
    FROM (SELECT * FROM {source} WHERE length(seq) >= {p.k}) LEFT JOIN {out}_f USING (id))"""


def matching(p: SketchParams) -> str:
    """CTEs d, q (filtered), counts(query_id, genome_id, matches)."""
    return ",".join([
        sketches("docs", "d", p), sketches("items", "q0", p),
        cells("(SELECT DISTINCT h FROM d)", "dc", p), "\nbloom AS (SELECT DISTINCT unnest(cells) AS cell FROM dc)",
        cells("q0", "qc", p),
        "\nq AS (SELECT id, bucket, fp, h FROM qc WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(qc.cells) AS c) WHERE c NOT IN (SELECT cell FROM bloom)))",
        "\ncounts AS (SELECT q.id AS query_id, d.id AS genome_id, count(*) AS matches FROM q JOIN d ON q.bucket = d.bucket AND q.fp = d.fp GROUP BY 1, 2)",
    ])


def hits(p: SketchParams, top: int, min_score: int, share: float) -> str:
    return ",".join([
        matching(p), genome_meta("docs", "d", "meta", p),
        f"""
scored AS (SELECT query_id, genome_id, matches, matches::DOUBLE / sketch_size AS jaccard, matches::DOUBLE / sketch_size * genome_size AS intersection
    FROM counts JOIN meta ON genome_id = id WHERE matches >= {min_score}),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY intersection DESC, genome_id DESC)::INT AS rank FROM scored
    WHERE intersection >= {share * p.threshold} QUALIFY rank <= {top})""",
    ])


def exact_hits(p: SketchParams, segments: str = "docs") -> str:
    """CTEs hits and exact; `segments` has the sequences of genomes for exact k-mers."""
    return ",".join([
        hits(p, **search.RECORDS_EXACT),
        kmers("(SELECT * FROM items WHERE id IN (SELECT query_id FROM hits))", "xa_k", p.k, last=True), "\nxa AS (SELECT DISTINCT id, canon FROM xa_k)",
        kmers(f"(SELECT * FROM {segments} WHERE id IN (SELECT genome_id FROM hits))", "xb_k", p.k, last=True), "\nxb AS (SELECT DISTINCT id, canon FROM xb_k)",
        """
inters AS (SELECT query_id, genome_id, count(*) AS inter FROM hits JOIN xa ON xa.id = query_id JOIN xb ON xb.id = genome_id AND xb.canon = xa.canon GROUP BY 1, 2),
na AS (SELECT id AS query_id, count(*) AS n_query FROM xa GROUP BY 1), nb AS (SELECT id AS genome_id, count(*) AS n_genome FROM xb GROUP BY 1),
exact AS (SELECT *, n_query + n_genome - inter AS union_size, inter::DOUBLE / (n_query + n_genome - inter) AS real_jaccard
    FROM hits JOIN inters USING (query_id, genome_id) JOIN na USING (query_id) JOIN nb USING (genome_id))""",
    ])


LINE = "coalesce(string_agg(genome_id || chr(9) || matches || chr(9) || floor(intersection)::BIGINT || chr(9) || printf('%.6f', jaccard) || ';', '' ORDER BY rank), '')"


def queries(p: SketchParams, b: SketchParams, z: SketchParams, file_documents: int) -> dict[str, str]:
    seqs = ", ".join(f"{name} AS ({q})" for name, q in SEQS.items())
    with_ = lambda *parts: "WITH " + ", ".join([seqs, *parts])
    # Genomes of several documents each, numbered by their files.
    of_file = f"SELECT dense_rank() OVER (ORDER BY doc_id // {file_documents}) - 1 AS id, doc_id, {bases('text')} AS seq FROM documents"
    files = SEQS | {"each_doc": of_file, "docs": "SELECT id, 'file' || id AS name, string_agg(seq, '' ORDER BY doc_id) AS seq FROM each_doc GROUP BY id"}
    with_files = lambda *parts: "WITH RECURSIVE " + ", ".join([*(f"{n} AS ({files[n]})" for n in ("each_doc", "docs", "items")), *parts])
    # A sequence that is shorter than k at the next header runs on.
    runs = f"""
numbered AS (SELECT id, seq, length(seq) AS n, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS i FROM each_doc),
run(id, i, size, s) AS (SELECT id, i, n, 0 FROM numbered WHERE i = 1 UNION ALL
    SELECT x.id, x.i, CASE WHEN r.size >= {p.k} THEN x.n ELSE r.size + x.n END, CASE WHEN r.size >= {p.k} THEN r.s + 1 ELSE r.s END FROM run r JOIN numbered x ON x.id = r.id AND x.i = r.i + 1),
segments AS (SELECT id, string_agg(seq, '' ORDER BY i) AS seq FROM numbered JOIN run USING (id, i) GROUP BY id, s)"""
    item_hash = [kmers("items", "k", p.k), mixed("k", "canon", "hashed", "h", MIX64)]
    cut = "(x::UBIGINT & 4294967295)"

    def mix32(source: str, out: str, factors: tuple[int, int]) -> str:
        step = lambda x, m: f"((xor({x} >> 16, {x})::UHUGEINT * {m}) % 4294967296)::UBIGINT"
        return f"""{out}_1 AS (SELECT *, {step("x", factors[0])} AS _1 FROM {source}), {out}_2 AS (SELECT * EXCLUDE (_1), {step("_1", factors[1])} AS _2 FROM {out}_1),
{out} AS (SELECT * EXCLUDE (_2), xor(_2 >> 16, _2)::BIGINT AS {out}x FROM {out}_2)"""

    flip = "reverse(translate(s, 'ACGT', 'TGCA'))"
    number = lambda x: f"(CASE WHEN length({x}) = 0 THEN 0 ELSE ('0b' || {two_bits(x)})::BIGINT END)"
    one_cell = SketchParams(k=21, log2_buckets=1)
    return {
        "canonical_kmers": with_(kmers("items", "k", p.k)) + " SELECT id AS query_id, pos, canon::BIGINT AS canon FROM k",
        "exact_kmer_counts": with_(kmers("docs", "k", p.k, last=True))
        + " SELECT id AS genome_id, count(DISTINCT canon) AS n_kmers, min(canon)::BIGINT AS least, max(canon)::BIGINT AS largest FROM k GROUP BY id",
        "kmer_hash": with_(*item_hash, mixed("hashed", "h", "h2", "hh", MIX64), mixed("h2", "h", "h3", "back", UNMIX64))
        + f" SELECT id AS query_id, pos, canon::BIGINT AS canon, {signed('h')} AS h, {signed('hh')} AS hh, {signed('back')} AS back FROM h3",
        "bloom_probes": with_(*item_hash, probes("hashed", "pr"))
        + f" SELECT id AS query_id, pos, {', '.join(f'{signed(f"q{i}")} AS probe{i}' for i in range(BLOOM_HASHES))} FROM pr",
        "hash32": f"WITH src AS (SELECT o_orderkey, (o_orderkey::UBIGINT & 4294967295) AS x FROM orders), {mix32('src', 'a', MIX32)}, {mix32('a', 'c', UNMIX32)}"
        + " SELECT o_orderkey, ax AS h, cx AS u FROM c",
        "fingerprint": with_(*item_hash, fingerprints("hashed", "fps", p)) + " SELECT id AS query_id, pos, bucket, fp FROM fps",
        "sketch": with_(sketches("docs", "d", p)) + f" SELECT id AS genome_id, bucket, fp, {signed('h')} AS khash FROM d",
        "genomes": with_(sketches("docs", "d", p), genome_meta("docs", "d", "meta", p)) + " SELECT id AS genome_id, name, n_chars, sketch_size, genome_size FROM meta",
        "genome_size_estimate": with_(sketches("docs", "d", one_cell), genome_meta("docs", "d", "meta", one_cell))
        + " SELECT id AS genome_id, name, n_chars, sketch_size, genome_size FROM meta",
        "bloom_cells": with_(sketches("docs", "d", b), cells("(SELECT DISTINCT h FROM d)", "dc", b)) + " SELECT DISTINCT unnest(cells) AS cell FROM dc",
        "bloom_filtered_sketch": with_(matching(b)) + f" SELECT id AS query_id, bucket, fp, {signed('h')} AS khash FROM q",
        "match_counts": with_(matching(p)) + " SELECT * FROM counts",
        "search_topn": with_(hits(p, **search.RECORDS)) + " SELECT query_id, genome_id, matches, jaccard, intersection, rank FROM hits",
        "saved_index_search": with_(hits(p, **search.RECORDS)) + " SELECT query_id, genome_id, matches, jaccard, intersection, rank FROM hits",
        "noisy_sketch": with_(
            noisy_kmers("noisy", "k", z.k), mixed("k", "canon", "hashed", "h", MIX64), fingerprints("hashed", "fps", z),
            "\nd AS (SELECT id, bucket, min(fp) AS fp, arg_min(h, fp::BIGINT * 4294967296 + pos) AS h FROM fps GROUP BY id, bucket HAVING min(fp) < 255)",
        ) + f" SELECT id AS genome_id, bucket, fp, {signed('h')} AS khash FROM d",
        "noisy_kmer_counts": with_(noisy_exact("noisy", "k", z.k)) + " SELECT id AS genome_id, count(*) AS n_kmers, min(canon) AS least, max(canon) AS largest FROM k GROUP BY id",
        "command_line_search": with_files(hits(p, **search.RECORDS))
        + f" SELECT i.name || ':' || {LINE} AS line FROM (SELECT * FROM items WHERE length(seq) >= {p.k}) i LEFT JOIN hits ON query_id = i.id GROUP BY i.id, i.name",
        "command_line_exact": with_files(runs, exact_hits(p, "segments"))
        + " SELECT format('{:g}', real_jaccard) AS real_jaccard, format('{:g}', jaccard) AS jaccard, format('{:g}', inter::DOUBLE) AS inter,"
        " format('{:g}', intersection) AS intersection, i.name AS header FROM exact JOIN items i ON i.id = query_id",
        "search_exact": with_(exact_hits(p))
        + " SELECT query_id, genome_id, matches, inter, union_size, n_query, n_genome, real_jaccard, jaccard, intersection FROM exact",
        "accuracy_regression": with_(exact_hits(p), "\nxy AS (SELECT 'jaccard' AS metric, real_jaccard AS x, jaccard AS y FROM exact UNION ALL SELECT 'intersection', inter::DOUBLE, intersection FROM exact)")
        + " SELECT metric, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM xy GROUP BY metric",
        "index_merge": with_(
            sketches("docs", "d", p), genome_meta("docs", "d", "md", p), sketches("pagesq", "g", p), genome_meta("pagesq", "g", "mg", p),
            "\noffs AS (SELECT max(id) + 1 AS o FROM md)",
            "\njoint AS (SELECT * FROM md UNION ALL SELECT * REPLACE (id + (SELECT o FROM offs) AS id) FROM mg)",
            "\nsk AS (SELECT id, bucket, fp FROM d UNION ALL SELECT id + (SELECT o FROM offs), bucket, fp FROM g)",
            "\nsums AS (SELECT id, sum(bucket)::BIGINT AS buckets, sum(fp)::BIGINT AS fps FROM sk GROUP BY id)",
        ) + " SELECT id AS genome_id, name, n_chars, sketch_size, genome_size, buckets, fps FROM joint JOIN sums USING (id)",
        "multiset_collisions": with_(kmers("docs", "dk", p.k), kmers("items", "ik", p.k)) + " SELECT count(*) AS collisions FROM dk WHERE canon IN (SELECT canon FROM ik)",
        "set_intersection": with_(kmers("docs", "dk", p.k), kmers("items", "ik", p.k))
        + " SELECT count(*) AS collisions FROM (SELECT canon FROM ik INTERSECT SELECT canon FROM dk)",
        "sequence_functions": with_(
            "\np AS (SELECT id AS doc_id, regexp_extract_all(seq, '.{1,24}') AS ps FROM docs)",
            "\nt AS (SELECT doc_id, unnest(range(0, len(ps)))::INT AS piece, unnest(ps) AS s FROM p)",
            f"\nn AS (SELECT *, {flip} AS r, {number('s')} AS x, {number(flip)} AS y FROM t)",
            "\nu AS (SELECT *, lpad(bin(x), 48, '0') AS b48 FROM n)",
            "\nw AS (SELECT *, array_to_string(list_transform(range(0, 24), lambda i: CASE substr(b48, (2 * i + 1)::BIGINT, 2) WHEN '00' THEN 'A' WHEN '01' THEN 'C' WHEN '10' THEN 'G' ELSE 'T' END), '') AS unpacked FROM u)",
        ) + f""" SELECT doc_id, piece, x AS number, least(x, y) AS canonical, r AS flipped, unpacked,
            {number("reverse(translate(unpacked, 'ACGT', 'TGCA'))")} AS flipped_number,
            lpad(bin(x), 64, '0') AS bits, CASE WHEN x = 0 THEN 0 ELSE length(bin(x)) - 1 END::BIGINT AS log2, format('{{:,}}', x) AS shown FROM w""",
        "string_functions": with_(f"\nt AS (SELECT doc_id, seq AS s, text AS raw FROM documents JOIN docs ON id = doc_id)", f"\nn AS (SELECT *, {flip} AS r FROM t)")
        + " SELECT doc_id, CASE WHEN regexp_full_match(raw, '[ACGTacgt]*') THEN upper(raw) ELSE '' END AS cleaned, s AS cleaned_bases, r AS flipped, least(s, r) AS canonical_string FROM n",
        "hamming": with_("\nt AS (SELECT id, seq AS s FROM docs)", "\no AS (SELECT a.id, a.s, coalesce(b.s, '') AS o FROM t a LEFT JOIN t b ON a.id = b.id + 1)")
        + " SELECT id AS genome_id, CASE WHEN s = '' THEN 0 ELSE len(list_filter(list_zip(string_split(s, ''), string_split(o, '')),"
        " lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2])) END::BIGINT AS differences FROM o",
        "string_product": f"SELECT c_custkey, {signed('product')} AS product FROM (SELECT c_custkey, list_reduce(list_prepend(1::UHUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::UHUGEINT)), lambda a, c: a * c % {WRAP})::UBIGINT AS product FROM customer)",
        "line_numbers": """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'genome' || o_custkey || 'ln' || o_orderkey WHEN 1 THEN 'genome' || o_custkey
            WHEN 2 THEN 'g ln -' || o_orderkey || '.25 ln7 tail' WHEN 3 THEN 'xln ab ln' || o_orderkey WHEN 4 THEN 'gln+' || o_custkey || 'e1x'
            ELSE 'ln ' || chr(9) || '.5' || o_custkey END AS name FROM orders),
        d AS (SELECT *, strpos(name, 'ln') AS place, regexp_extract(CASE WHEN place > 0 THEN substr(name, place + 2) ELSE '' END, '^\\s*([-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?)', 1) AS t FROM n)
        SELECT o_orderkey, CASE WHEN t = '' THEN 0 ELSE t::FLOAT::DOUBLE END AS number, CASE WHEN place > 0 THEN substr(name, 1, place - 1) ELSE name END AS rest FROM d""",
        "render_hits": with_(hits(p, **search.RECORDS))
        + f" SELECT i.id AS query_id, i.name || ':' || {LINE} AS line FROM (SELECT * FROM items WHERE length(seq) >= {p.k}) i LEFT JOIN hits ON query_id = i.id GROUP BY i.id, i.name",
        "render_file_hits": with_(hits(p, **search.FILES)) + f" SELECT i.id AS query_id, i.name || ':' || {LINE} AS line FROM items i JOIN hits ON query_id = i.id GROUP BY i.id, i.name",
        "render_exact": with_(exact_hits(p))
        + " SELECT concat_ws(chr(9), format('{:g}', real_jaccard), format('{:g}', jaccard), format('{:g}', inter::DOUBLE), format('{:g}', intersection), i.name, g.name) AS line"
        " FROM exact JOIN items i ON i.id = query_id JOIN docs g ON g.id = genome_id",
    }
