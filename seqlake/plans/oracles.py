"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from seqlake.functions.hashing import FINGERPRINT, PARTITION, RECOVERY
from seqlake.functions.sequences import FILE_SUFFIXES, TEXT_BASES, TEXT_LETTERS

from .queries import MASK

_LETTERS = TEXT_LETTERS.rstrip("\n")
_M64 = 1 << 64


def _dna(text: str = "text") -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z\\n]', '', 'g')), '{_LETTERS}' || chr(10), '{TEXT_BASES}')"


def _homopolymer(seq: str) -> str:
    for base in "ACGT":
        seq = f"regexp_replace({seq}, '{base}+', '{base}', 'g')"
    return seq


def _rc(w: str) -> str:
    return f"reverse(translate({w}, 'ACGT', 'TGCA'))"


def _masked(w: str, mask: str) -> str:
    return " || ".join(f"substr({w}, {i + 1}, 1)" for i, c in enumerate(mask) if c == "#")


def _windows(name: str, table: str, ident: str, k: int, seq: str, mask: str | None = None, least: int | None = None) -> str:
    """CTE name(id, run, pos, key): canonical windows of k bases, of runs of ``least`` at least."""
    key = _masked("w", mask) if mask else "w"
    return f"""
{name}_runs AS (SELECT id, unnest(runs) AS run_seq, unnest(range(len(runs))) AS run FROM
  (SELECT {ident} AS id, string_split({seq}, 'N') AS runs FROM {table} WHERE text IS NOT NULL)),
{name}_w AS (SELECT id, run, unnest(range(len(run_seq) - {k - 1})) AS pos,
  unnest(list_transform(range(1, len(run_seq) - {k - 2}), lambda i: substr(run_seq, i, {k}))) AS w FROM {name}_runs WHERE len(run_seq) >= {max(k, least or 0)}),
{name}_k AS (SELECT id, run, pos, {key} AS s FROM {name}_w),
{name} AS (SELECT id, run, pos, least(s, {_rc('s')}) AS key FROM {name}_k)"""


_NUMBER = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT)"


def _search(k: int, ident: str = "doc_id", seq: str | None = None, query_seq: str | None = None, mask: str | None = None) -> str:
    """CTEs found(query_id, dataset_id, matches) and totals(query_id, queried_seeds)."""
    seq = seq or _dna()
    return _joined(_windows("d", "documents", ident, k, seq, mask), _windows("q", "benchmark", "item_id", k, query_seq or seq, mask))


def _joined(d: str, q: str) -> str:
    return f"""WITH {d}, {q},
weighted AS (SELECT id, key, count(*) AS n FROM q GROUP BY ALL),
hits AS (SELECT DISTINCT id, key FROM d WHERE key IN (SELECT key FROM weighted)),
totals AS (SELECT item_id AS query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS queried_seeds FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN weighted ON id = item_id GROUP BY 1),
found AS (SELECT w.id AS query_id, h.id AS dataset_id, CAST(sum(n) AS BIGINT) AS matches FROM weighted w JOIN hits h USING (key) GROUP BY ALL)
"""


_KEPT = "SELECT query_id, dataset_id, matches, queried_seeds, matches::DOUBLE / queried_seeds AS ratio FROM found JOIN totals USING (query_id) WHERE queried_seeds > 0 AND matches::DOUBLE / queried_seeds >= {ratio}"


def _records(k: int, ratio: float = 0.8, **options) -> str:
    return _search(k, **options) + _KEPT.format(ratio=ratio)


def _code(key: str, k: int) -> str:
    """Two-bit code of a k-mer, as UBIGINT."""
    return f"CAST(list_sum(list_transform(range(1, {k + 1}), lambda i: (strpos('ACGT', substr({key}, i, 1)) - 1)::HUGEINT << (2 * ({k} - i))::INT)) AS UBIGINT)"


def _split(x: str) -> str:
    """splitmix64 of an UBIGINT expression, as a chain of scalar subexpressions."""
    m = f"{_M64}::UHUGEINT"
    a = f"(({x})::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {m}"
    step = lambda z, s, c: f"((xor({z}, ({z}) >> {s})) * {c}::UHUGEINT) % {m}"
    return f"list_transform(list_transform(list_transform([{a}], lambda z: {step('z', 30, 0xBF58476D1CE4E5B9)}), lambda z: {step('z', 27, 0x94D049BB133111EB)}), lambda z: xor(z, z >> 31))[1]"


def _keys(k: int) -> str:
    return f"""WITH {_windows('d', 'documents', _NUMBER, k, _dna())},
post AS (SELECT id, key, count(*) AS n FROM d GROUP BY ALL),
codes AS (SELECT key, {_code('key', k)} AS code FROM (SELECT DISTINCT key FROM post))"""




def _findere(k: int, z: int, ident: str) -> str:
    s = k - z
    return f"""WITH {_windows('d', 'documents', ident, s, _dna(), least=k)}, {_windows('q', 'benchmark', 'item_id', s, _dna(), least=k)},
hits AS (SELECT DISTINCT id, key FROM d WHERE key IN (SELECT key FROM q)),
held AS (SELECT q.id AS query_id, h.id AS dataset_id, count(*) OVER (PARTITION BY q.id, q.run, h.id ORDER BY q.pos RANGE BETWEEN {z} PRECEDING AND CURRENT ROW) AS n FROM q JOIN hits h USING (key)),
found AS (SELECT query_id, dataset_id, count(*) AS matches FROM held WHERE n = {z + 1} GROUP BY ALL),
totals AS (SELECT item_id AS query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS queried_seeds FROM (SELECT DISTINCT item_id FROM benchmark)
  LEFT JOIN (SELECT id, len(run_seq) - {k - 1} AS n FROM q_runs WHERE len(run_seq) >= {k}) ON id = item_id GROUP BY 1)
"""


def _minimizers(name: str, table: str, ident: str, k: int, m: int, part: int) -> str:
    """CTE name(id, run, pos, key): the chosen windows of m bases, where windows of ``part`` bases are ranked by their hash alone.

    For k = 39 and m = 31 the open-closed rule ranks windows of four bases,
    which are their own middle: part is 4.  Plain minimizers have part = m.
    """
    w, place = k - m + 1, 1 << 20
    last = f"WINDOW w AS (PARTITION BY id, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - part} FOLLOWING)"
    return f"""{_windows(name + '_f', table, ident, part, _dna())},
{name}_h AS (SELECT key, {_split(f'(code::UHUGEINT + 69::UHUGEINT) % {_M64}::UHUGEINT')} AS h FROM (SELECT key, {_code('key', part)} AS code FROM (SELECT DISTINCT key FROM {name}_f))),
{name}_p AS (SELECT id, run, pos, min(h * {place}::UHUGEINT + pos::UHUGEINT) OVER w AS low, min(h * {place}::UHUGEINT + ({place - 1} - pos)::UHUGEINT) OVER w AS high FROM {name}_f JOIN {name}_h USING (key) {last}),
{name}_c AS (SELECT id, run, pos AS start, run_seq, CASE WHEN len(translate(substr(run_seq, pos + 1, {k}), 'AC', '')) > {k // 2} THEN {place - 1} - (high % {place})::BIGINT ELSE (low % {place})::BIGINT END - pos AS anchor
  FROM {name}_p JOIN {name}_f_runs USING (id, run) WHERE pos + {k} <= len(run_seq)),
{name}_s AS (SELECT id, run, start, run_seq, start + anchor % {w} AS pos FROM {name}_c),
{name}_n AS (SELECT id, run, pos, substr(run_seq, pos + 1, {m}) AS s FROM {name}_s QUALIFY pos IS DISTINCT FROM lag(pos) OVER (PARTITION BY id, run ORDER BY start)),
{name} AS (SELECT id, run, pos, least(s, {_rc('s')}) AS key FROM {name}_n)"""


def _xxh64(x: str) -> str:
    """XXH64 with seed 0 of the eight bytes of an UBIGINT expression, as a chain of scalar subexpressions."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    m, u = f"{_M64}::UHUGEINT", lambda n: f"{n}::UHUGEINT"
    turn = lambda v, by: f"((({v}) << {by}) % {m} | (({v}) >> {64 - by}))"
    steps = [
        f"(z * {u(p2)}) % {m}",
        f"({turn('z', 31)} * {u(p1)}) % {m}",
        f"xor({u((p5 + 8) % _M64)}, z)",
        f"({turn('z', 27)} * {u(p1)} + {u(p4)}) % {m}",
        f"(xor(z, z >> 33) * {u(p2)}) % {m}",
        f"(xor(z, z >> 29) * {u(p3)}) % {m}",
        "xor(z, z >> 32)",
    ]
    made = f"[({x})::UHUGEINT]"
    for step in steps:
        made = f"list_transform({made}, lambda z: {step})"
    return f"{made}[1]"


def _strobes(name: str, seeds: str, k: int, least: int, most: int, codes: str) -> str:
    """CTE name(id, key): each seed linked with the one of the ``least`` to ``most`` next places of its run whose hash differs in the fewest low bits."""
    return f"""{name}_x AS (SELECT id, run, pos, x FROM {seeds} JOIN {codes} USING (key)),
{name}_l AS (SELECT id, x, list(x) OVER (PARTITION BY id, run ORDER BY pos RANGE BETWEEN {least} FOLLOWING AND {most} FOLLOWING) AS near FROM {name}_x),
{name}_b AS (SELECT id, x, near, list_min(list_transform(near, lambda y, i: bit_count((xor(x, y) & 255)::BIGINT) * 1000 + i)) % 1000 AS best FROM {name}_l),
{name} AS (SELECT id, (x // 2) + (coalesce(near[best], x) // 2) AS key FROM {name}_b)"""


def _randstrobes(k: int, ratio: float) -> str:
    return f"""WITH {_windows('dk', 'documents', 'doc_id', k, _dna())}, {_windows('qk', 'benchmark', 'item_id', k, _dna())}, {_windows('rk', 'benchmark', 'item_id', k, _rc(_dna()))},
hashed AS (SELECT key, CAST({_xxh64('code')} AS UBIGINT) AS x FROM (SELECT key, {_code('key', k)} AS code FROM (SELECT key FROM dk UNION SELECT key FROM qk))),
{_strobes('d', 'dk', k, k, 3 * k, 'hashed')}, {_strobes('q', 'qk', k, k, 3 * k, 'hashed')}, {_strobes('r', 'rk', k, k, 3 * k, 'hashed')},
weighted AS (SELECT id, strand, key, count(*) AS n FROM (SELECT id, 0 AS strand, key FROM q UNION ALL SELECT id, 1, key FROM r) GROUP BY ALL),
hits AS (SELECT DISTINCT id, key FROM d WHERE key IN (SELECT key FROM weighted)),
by_strand AS (SELECT w.id AS query_id, strand, h.id AS dataset_id, CAST(sum(n) AS BIGINT) AS matches FROM weighted w JOIN hits h USING (key) GROUP BY ALL),
found AS (SELECT query_id, dataset_id, max(matches) AS matches FROM by_strand GROUP BY ALL),
totals AS (SELECT item_id AS query_id, CAST(coalesce(n, 0) AS BIGINT) AS queried_seeds FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN (SELECT id, count(*) AS n FROM q GROUP BY 1) ON id = item_id)
""" + _KEPT.format(ratio=ratio)


def _filtered(k: int, slots: int, bits: int, ratio: float) -> str:
    cell = lambda domain, size: f"CAST(({_split(f'xor(code::UHUGEINT, {69 ^ domain}::UHUGEINT)')}) % {size} AS BIGINT)"
    return f"""WITH {_windows('d', 'documents', 'doc_id', k, _dna())}, {_windows('q', 'benchmark', 'item_id', k, _dna())},
cells AS (SELECT key, {cell(PARTITION, slots)} * {1 << bits} + {cell(FINGERPRINT, 1 << bits)} AS cell FROM (SELECT key, {_code('key', k)} AS code FROM (SELECT key FROM d UNION SELECT key FROM q))),
weighted AS (SELECT id, cell, count(*) AS n FROM q JOIN cells USING (key) GROUP BY ALL),
hits AS (SELECT DISTINCT id, cell FROM d JOIN cells USING (key) WHERE cell IN (SELECT cell FROM weighted)),
totals AS (SELECT id AS query_id, CAST(sum(n) AS BIGINT) AS queried_seeds FROM weighted GROUP BY 1),
found AS (SELECT w.id AS query_id, h.id AS dataset_id, CAST(sum(n) AS BIGINT) AS matches FROM weighted w JOIN hits h USING (cell) GROUP BY ALL)
""" + _KEPT.format(ratio=ratio)


_DENSITY = " SELECT id AS dataset_id, count(*) AS selected, count(DISTINCT key) AS distinct_seeds FROM d GROUP BY 1"


_name = "regexp_extract(regexp_replace(url, '[?#].*$', '') || '.fna.gz', '[^/]*$')"
for _suffix in FILE_SUFFIXES:
    _name = f"regexp_replace({_name}, '{_suffix.replace('.', chr(92) + '.')}$', '')"

_mod = lambda d: f"({_split('(code::UHUGEINT + 69::UHUGEINT) % ' + str(_M64) + '::UHUGEINT')}) % {d} = 0"

ORACLE_SQL: dict[str, str] = {
    "kmer_records_min_ratio": _records(31),
    "kmer_records_all_zero_policy": _search(31, _NUMBER)
    + "SELECT query_id, dataset_id, coalesce(matches, 0) AS matches, queried_seeds, CASE WHEN queried_seeds > 0 THEN coalesce(matches, 0)::DOUBLE / queried_seeds ELSE 0 END AS ratio FROM totals "
    + f"CROSS JOIN (SELECT DISTINCT {_NUMBER} AS dataset_id FROM documents) LEFT JOIN found USING (query_id, dataset_id)",
    "kmer_records_tsv_no_hit": _search(31)
    + f", kept AS ({_KEPT.format(ratio=0.8)}) SELECT t.query_id, dataset_id, coalesce(matches, 0) AS matches, t.queried_seeds, coalesce(ratio, 0.0) AS ratio FROM totals t LEFT JOIN kept USING (query_id)",
    "kmer_records_compact": _search(31)
    + f", kept AS ({_KEPT.format(ratio=0.8)}) SELECT t.query_id, t.queried_seeds AS valid_kmers, coalesce(string_agg(dataset_id || ':' || matches, ',' ORDER BY dataset_id), '') AS hits FROM totals t LEFT JOIN kept USING (query_id) GROUP BY ALL",
    "kmer_aggregate_by_source": _search(31, _NUMBER)
    + ", stats AS (SELECT id AS dataset_id, count(DISTINCT key) AS unique_kmers FROM d GROUP BY 1) SELECT 'src' || dataset_id AS color, CAST(coalesce(m, 0) AS BIGINT) AS matches, coalesce(m, 0)::DOUBLE / (SELECT sum(queried_seeds) FROM totals) AS ratio, unique_kmers "
    + "FROM stats LEFT JOIN (SELECT dataset_id, sum(matches) AS m FROM found GROUP BY 1) USING (dataset_id)",
    "dataset_stats": f"WITH {_windows('d', 'documents', 'doc_id', 31, _dna())} SELECT id AS dataset_id, count(*) AS occurrences, count(DISTINCT key) AS unique_kmers FROM d GROUP BY 1",
    "revcomp_invariance": _records(31, query_seq=_rc(_dna())),
    "homopolymer_kmers": _records(31, seq=_homopolymer(_dna())),
    "spaced_seed_records": _records(31, mask=MASK),
    "spaced_seed_short_records": _records(8, 0.99, mask="##_##_##"),
    "modimizer_sample": _keys(21) + f" SELECT id AS dataset_id, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS unique_kmers FROM post JOIN codes USING (key) WHERE {_mod(16)} GROUP BY 1",
    "modimizer_records": _search(21).replace("FROM q GROUP BY ALL)", f"FROM q WHERE key IN (SELECT key FROM (SELECT key, {_code('key', 21)} AS code FROM (SELECT DISTINCT key FROM q)) WHERE {_mod(4)}) GROUP BY ALL)") + _KEPT.format(ratio=0.8),
    "long_kmer_records": _records(49),
    "findere_records": _findere(31, 10, "doc_id") + _KEPT.format(ratio=0.8),
    "findere_aggregate": _findere(31, 10, _NUMBER)
    + f"SELECT color, CAST(coalesce(m, 0) AS BIGINT) AS matches, coalesce(m, 0)::DOUBLE / (SELECT sum(queried_seeds) FROM totals) AS ratio FROM (SELECT DISTINCT source AS color, {_NUMBER} AS dataset_id FROM documents) LEFT JOIN (SELECT dataset_id, sum(matches) AS m FROM found GROUP BY 1) USING (dataset_id)",
    "minimizer_ocm_positions": f"WITH {_minimizers('d', 'documents', 'doc_id', 39, 31, 4)}" + _DENSITY,
    "minimizer_ocm_records": _joined(_minimizers("d", "documents", "doc_id", 39, 31, 4), _minimizers("q", "benchmark", "item_id", 39, 31, 4)) + _KEPT.format(ratio=0.8),
    "minimizer_hashed_density": f"WITH {_minimizers('d', 'documents', 'doc_id', 39, 31, 31)}" + _DENSITY,
    "union_origin_masks": f"WITH {_windows('d', 'documents', _NUMBER, 31, _dna())}, masks AS (SELECT key, bit_or(1::BIGINT << id) AS mask FROM d GROUP BY 1) SELECT mask, count(*) AS keys FROM masks GROUP BY 1",
    "sketch_jaccard_pairs": _keys(15)
    + f""", hashed AS (SELECT key, {_split('(code::UHUGEINT + 69::UHUGEINT) % ' + str(_M64) + '::UHUGEINT')} AS h FROM codes),
sk AS (SELECT id, h % 128 AS bucket, min(h >> 32) AS low FROM post JOIN hashed USING (key) GROUP BY ALL),
filled AS (SELECT id, count(*) AS f FROM sk GROUP BY 1), sizes AS (SELECT id, count(*) AS c FROM post GROUP BY 1),
same AS (SELECT x.id AS a, y.id AS b, count(*) AS same FROM sk x JOIN sk y USING (bucket, low) WHERE x.id < y.id GROUP BY ALL),
j AS (SELECT a, b, same::DOUBLE / greatest(fa.f, fb.f) AS jaccard, ca.c AS na, cb.c AS nb FROM same JOIN filled fa ON fa.id = a JOIN filled fb ON fb.id = b JOIN sizes ca ON ca.id = a JOIN sizes cb ON cb.id = b)
SELECT a, b, jaccard, CAST(round(greatest(greatest(na, nb)::DOUBLE, least((na + nb)::DOUBLE, (na + nb) / (1 + jaccard)))) AS BIGINT) AS union_estimate FROM j""",
    "hash_partition_counts": _keys(15)
    + f", placed AS (SELECT key, CAST(({_split(f'xor(code::UHUGEINT, {69 ^ PARTITION}::UHUGEINT)')}) % 64 AS BIGINT) AS partition FROM codes) SELECT partition, count(*) AS postings, count(DISTINCT key) AS keys FROM post JOIN placed USING (key) GROUP BY 1",
    "fused_index_query": _search(31, _NUMBER)
    + f"SELECT query_id, 'src' || dataset_id AS name, matches, queried_seeds, ratio FROM ({_KEPT.format(ratio=0.8)})",
    "recovery_postings": _keys(15)
    + f", hashed AS (SELECT key, ({_split(f'xor(code::UHUGEINT, {69 ^ RECOVERY}::UHUGEINT)')}) >> 32 AS hash FROM codes), g AS (SELECT hash, count(DISTINCT id) AS datasets, min(id) AS first FROM post JOIN hashed USING (key) GROUP BY 1) SELECT datasets, count(*) AS hashes, CAST(sum(first) AS BIGINT) AS first_ids FROM g GROUP BY 1",
    "fof_name_derivation": f"SELECT page_id, coalesce(nullif({_name}, ''), 'color') AS name FROM pages",
    "lineage_sort": "SELECT lang, source, n, row_number() OVER (ORDER BY lang IS NULL, lang, source) AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)",
    "best_match": _search(31)
    + f", kept AS ({_KEPT.format(ratio=0.0)}) SELECT query_id, dataset_id, matches, ratio FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, dataset_id) = 1",
    "randstrobe_records": _randstrobes(15, 0.8),
    "filter_mode_records": _filtered(31, 1 << 24, 8, 0.8),
    "union_origin_words": f"WITH {_windows('d', 'documents', 'doc_id', 31, _dna())}, p AS (SELECT DISTINCT id, key FROM d) SELECT CAST(floor(id / 63) AS BIGINT) AS word, count(DISTINCT key) AS keys, count(*) AS postings FROM p GROUP BY 1",
    "minimizer_ocm_places": f"WITH {_minimizers('d', 'documents', 'doc_id', 39, 31, 4)}, begins AS (SELECT id, run, CAST(coalesce(sum(len(run_seq) + 1) OVER (PARTITION BY id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM d_f_runs) "
    + "SELECT id AS dataset_id, pos + begin AS pos FROM d JOIN begins USING (id, run)",
    "kmer_records_named": _search(31, _NUMBER)
    + f", kept AS ({_KEPT.format(ratio=0.8)}) SELECT t.query_id, 'src' || dataset_id AS dataset_name, coalesce(matches, 0) AS matches, t.queried_seeds, coalesce(ratio, 0.0) AS ratio FROM totals t LEFT JOIN kept USING (query_id)",
    "lineage_of_sources": f"SELECT name, rank, row_number() OVER (ORDER BY NOT known, rank NULLS FIRST, name) AS place FROM (SELECT source AS name, {_NUMBER} % 2 = 1 AS known, CASE WHEN {_NUMBER} % 2 = 1 THEN min(lang) END AS rank FROM documents GROUP BY source)",
    "fused_index_gaps": _search(31, _NUMBER) + f"SELECT query_id, 'src' || dataset_id AS name, matches, queried_seeds, ratio FROM ({_KEPT.format(ratio=0.8)})",
    "recovery_probe_records": f"""WITH {_windows('d', 'documents', _NUMBER, 15, _dna())}, {_windows('q', 'benchmark', 'item_id', 15, _dna())},
hashed AS (SELECT key, ({_split(f'xor(code::UHUGEINT, {69 ^ RECOVERY}::UHUGEINT)')}) >> 32 AS hash FROM (SELECT key, {_code('key', 15)} AS code FROM (SELECT key FROM d UNION SELECT key FROM q))),
weighted AS (SELECT id, hash, count(*) AS n FROM q JOIN hashed USING (key) GROUP BY ALL), held AS (SELECT DISTINCT id, hash FROM d JOIN hashed USING (key))
SELECT w.id AS query_id, h.id AS dataset_id, CAST(sum(w.n) AS BIGINT) AS matches, max(t.n) AS queried_seeds FROM weighted w JOIN held h USING (hash) JOIN (SELECT id, count(*) AS n FROM q GROUP BY 1) t ON t.id = w.id GROUP BY 1, 2""",
    "index_round_trip": _search(31, _NUMBER)
    + f", stats AS (SELECT id AS dataset_id, count(DISTINCT key) AS unique_kmers FROM d GROUP BY 1) SELECT query_id, 'src' || dataset_id AS name, matches, queried_seeds, ratio, unique_kmers FROM ({_KEPT.format(ratio=0.8)}) JOIN stats USING (dataset_id)",
    "long_kmer_records_65": _records(65),
}
