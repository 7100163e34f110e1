"""SQL of hashed term features, random projections and everything that builds on them.

Terms are hashed as the feature pipeline does it (MurmurHash3, 32 bits, seed 42). The
projections are drawn from the same generator: a linear congruential one of 48 bits, whose
states are reached by jumps, and the polar method, whose rejected draws are left out before
the accepted ones are numbered. Projections are made in SQL, so nothing of Spark's side
enters the comparison.
"""

from __future__ import annotations

from verification.oracle import ASKED, CATALOG, ORACLE, RESUMES, SEED, SILVER, dense, grams, words

UNIGRAMS, NGRAMS = 262_144, 524_288
WORD = "4294967295::UBIGINT"
STATES = 1 << 48
# Fixed values of the generator.
FACTOR, ADDEND = 0x5DEECE66D, 0xB


def _u(number: int) -> str:
    return f"{number}::UBIGINT"


def _turned(x: str, bits: int) -> str:
    return f"((({x} << {bits}) | ({x} >> {32 - bits})) & {WORD})"


def _times(x: str, factor: int) -> str:
    return f"(({x} * {_u(factor)}) & {WORD})"


def murmur(source: str) -> str:
    """``hashed(term, h)`` of the distinct terms of ``source``."""
    block = "('0x' || substr(d, 8 * i + 7, 2) || substr(d, 8 * i + 5, 2) || substr(d, 8 * i + 3, 2) || substr(d, 8 * i + 1, 2))::UBIGINT"
    rest = " || ".join(f"CASE WHEN n % 4 > {k} THEN substr(d, 8 * (n // 4) + {2 * k + 1}, 2) ELSE '' END" for k in (2, 1, 0))
    return f"""hb AS (SELECT DISTINCT term, hex(encode(term)) AS d, strlen(term) AS n FROM {source}),
hk AS (SELECT term, n, list_transform(range(0, n // 4), lambda i: {_times(block, 0xCC9E2D51)}) AS b,
  {_times(f"('0x0' || {rest})::UBIGINT", 0xCC9E2D51)} AS t FROM hb),
h1 AS (SELECT term, n, list_reduce(list_prepend({_u(42)}, list_transform(b, lambda k: {_times(_turned('k', 15), 0x1B873593)})),
  lambda s, k: ({_turned('xor(s, k)', 13)} * 5 + {_u(0xE6546B64)}) & {WORD}) AS h, {_times(_turned('t', 15), 0x1B873593)} AS t FROM hk),
h2 AS (SELECT term, xor(xor(h, t), n::UBIGINT) AS h FROM h1),
h3 AS (SELECT term, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM h2),
h4 AS (SELECT term, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM h3),
hashed AS (SELECT term, xor(h, h >> 16) AS h FROM h4)"""


def features(catalog: str, *sides: str, ngrams: bool = False) -> str:
    """Unit vectors ``{side}_v(source_id, idx, w)`` of the catalog and other sides, which have
    ``(source_id, combined_text)``; zero weights are entries too, as a hashed count had them."""
    size, names = (NGRAMS if ngrams else UNIGRAMS), (catalog, *sides)
    terms = grams("list") if ngrams else "list"
    parts = [f"{n}_t AS (SELECT source_id, unnest({terms}) AS term FROM (SELECT source_id, {words('combined_text')} AS list FROM {n}))" for n in names]
    parts.append(f"hash_terms AS ({' UNION '.join(f'SELECT term FROM {n}_t' for n in names)})")
    parts.append(murmur("hash_terms"))
    parts += [f"{n}_f AS (SELECT source_id, (h & {_u(size - 1)})::BIGINT AS idx, count(*) AS tf FROM {n}_t JOIN hashed USING (term) GROUP BY ALL)" for n in names]
    parts.append(f"""weights AS (SELECT idx, CASE WHEN count(*) >= 2 THEN ln(((SELECT count(*) FROM {catalog}) + 1) / (count(*) + 1)) ELSE 0 END AS idf
  FROM {catalog}_f GROUP BY idx)""")
    for n in names:
        # A query's term that the catalog lacks has document frequency 0, and so weight 0.
        parts.append(f"""{n}_w AS (SELECT source_id, idx, tf * coalesce(idf, 0) AS w FROM {n}_f LEFT JOIN weights USING (idx)),
{n}_n AS (SELECT source_id, sqrt(sum(w * w)) AS n FROM {n}_w GROUP BY source_id),
{n}_v AS (SELECT source_id, idx, CASE WHEN n > 0 THEN w / n ELSE w END AS w FROM {n}_w JOIN {n}_n USING (source_id))""")
    return ",\n".join(parts)


def top(catalog: str = "catalog", asked: str = "asked", name: str = "top", k: int = 10) -> str:
    """Exact top K by cosine, ties by id; what shares nothing is left out."""
    return f"""{name}_s AS (SELECT q.source_id AS query_id, c.source_id AS document_id, round(sum(q.w * c.w), 12) AS score
  FROM {asked}_v q JOIN {catalog}_v c USING (idx) GROUP BY 1, 2 HAVING round(sum(q.w * c.w), 12) <> 0),
{name} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, document_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _jump(steps: int) -> tuple[int, int]:
    factor, addend = 1, 0
    for _ in range(steps):
        factor, addend = factor * FACTOR % STATES, (addend * FACTOR + ADDEND) % STATES
    return factor, addend


def directions(tables: int, size: int = UNIGRAMS, seed: int = SEED, stride: int = 2048) -> str:
    """``directions(t, idx, g)``, unit vectors once divided by ``lengths(t, n)``.

    A try of the polar method takes four numbers and is accepted with probability pi/4; so
    many tries are made that enough of them are. Needs WITH RECURSIVE.
    """
    tries = int(tables * size / 2 / 0.785398 * 1.01) + 4000
    (far, far_add), (near, near_add) = _jump(4 * stride), _jump(4)
    strides = -(-tries // stride)

    def after(state: str) -> str:
        return f"(({state}::HUGEINT * {FACTOR} + {ADDEND}) % {STATES})::BIGINT"

    def unit(high: str, low: str) -> str:
        return f"((({high} >> 22) * 134217728 + ({low} >> 21)) / 9007199254740992.0)"

    return f"""far AS (SELECT 0 AS i, {(seed ^ FACTOR) % STATES}::BIGINT AS s
  UNION ALL SELECT i + 1, ((s::HUGEINT * {far} + {far_add}) % {STATES})::BIGINT FROM far WHERE i < {strides - 1}),
steps AS (SELECT 0 AS j, 1::BIGINT AS f, 0::BIGINT AS a
  UNION ALL SELECT j + 1, ((f::HUGEINT * {near}) % {STATES})::BIGINT, ((a::HUGEINT * {near} + {near_add}) % {STATES})::BIGINT FROM steps WHERE j < {stride - 1}),
g1 AS (SELECT i * {stride} + j AS k, {after(f'((s::HUGEINT * f + a) % {STATES})')} AS a FROM far, steps),
g2 AS (SELECT *, {after('a')} AS b FROM g1), g3 AS (SELECT *, {after('b')} AS c FROM g2), g4 AS (SELECT *, {after('c')} AS d FROM g3),
polar AS (SELECT k, 2 * {unit('a', 'b')} - 1 AS x, 2 * {unit('c', 'd')} - 1 AS y FROM g4),
kept AS (SELECT row_number() OVER (ORDER BY k) - 1 AS j, x, y, x * x + y * y AS s FROM polar WHERE x * x + y * y < 1 AND x * x + y * y > 0),
drawn AS (SELECT 2 * j AS place, x * sqrt(-2 * ln(s) / s) AS g FROM kept UNION ALL SELECT 2 * j + 1, y * sqrt(-2 * ln(s) / s) FROM kept),
directions AS (SELECT CAST(place // {size} AS INTEGER) AS t, place % {size} AS idx, g FROM drawn WHERE place < {tables * size}),
lengths AS (SELECT t, sqrt(sum(g * g)) AS n FROM directions GROUP BY t)"""


def pairs(tables: int, catalog: str = "catalog", asked: str = "asked") -> str:
    """``near(query_id, document_id, distance)`` of all pairs, and ``{side}_h(source_id, t, x)``,
    the projections."""
    hashes = [
        f"""{n}_h AS (SELECT source_id, t, sum(w * g) / any_value(n) AS x FROM {n}_v JOIN directions USING (idx) JOIN lengths USING (t) GROUP BY source_id, t),
{n}_q AS (SELECT source_id, sum(w * w) AS n FROM {n}_v GROUP BY source_id)"""
        for n in (catalog, asked)
    ]
    return f"""{directions(tables)}, {', '.join(hashes)},
dots AS (SELECT q.source_id AS query_id, c.source_id AS document_id, sum(q.w * c.w) AS dot FROM {asked}_v q JOIN {catalog}_v c USING (idx) GROUP BY 1, 2),
near AS (SELECT q.source_id AS query_id, c.source_id AS document_id, round(sqrt(greatest(q.n + c.n - 2 * coalesce(dot, 0), 0)), 12) AS distance
  FROM {asked}_q q CROSS JOIN {catalog}_q c LEFT JOIN dots d ON d.query_id = q.source_id AND d.document_id = c.source_id)"""


def met(width: str, name: str = "met", catalog: str = "catalog", asked: str = "asked", extra: str = "") -> str:
    """``{name}(query_id, document_id, first)``: pairs with an equal bucket, and the first such table."""
    return f"""{name} AS (SELECT q.source_id AS query_id, c.source_id AS document_id, min(q.t) AS first{extra and ', ' + extra}
  FROM {asked}_h q JOIN {catalog}_h c ON q.t = c.t AND floor(q.x / {width}) = floor(c.x / {width}) GROUP BY ALL)"""


def listed(threshold: float, k: int = 10) -> str:
    """``found(query_id, document_id, distance)`` and ``lists`` with rank and score."""
    return f"""found AS (SELECT query_id, document_id, distance FROM near JOIN met USING (query_id, document_id) WHERE distance < {threshold}),
lists AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, document_id, round(greatest(-1, least(1, 1 - distance * distance / 2)), 6) AS score, round(distance, 6) AS distance
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS rank FROM found) WHERE rank <= {k})"""


NARROW = f"{1 / UNIGRAMS ** 0.5}::DOUBLE"
BOTH = f"{CATALOG}, {ASKED}"
SIDES = f"{BOTH}, {features('catalog', 'asked')}"
INDEXED = f"WITH RECURSIVE {SIDES}, {pairs(12)}, {met(NARROW)}"

HASHED: dict[str, str] = {}
HASHED["tfidf_ml_features"] = f"""WITH {CATALOG}, {features('catalog')}
SELECT c.source_id, CAST(count(idx) AS INTEGER) AS terms, round(sqrt(coalesce(sum(w * w), 0)), 9) AS norm
FROM catalog c LEFT JOIN catalog_v v USING (source_id) GROUP BY c.source_id"""
HASHED["tfidf_ml_topk"] = f"WITH {SIDES}, {top()} SELECT query_id, rank, document_id, round(score, 6) AS score FROM top"
HASHED["ngram_ml_topk"] = f"""WITH {BOTH}, {features('catalog', 'asked', ngrams=True)}, {top()}
SELECT query_id, rank, document_id, round(score, 6) AS score FROM top"""
HASHED["ngram_comparison"] = f"""SELECT count(g.query_id) / count(*) AS mean_overlap
FROM (WITH {SIDES}, {top()} SELECT query_id, document_id FROM top) t
LEFT JOIN (WITH {BOTH}, {features('catalog', 'asked', ngrams=True)}, {top()} SELECT query_id, document_id FROM top) g USING (query_id, document_id)"""
HASHED["dense_comparison"] = f"""WITH {SIDES}, {top()}, {dense('e')}
SELECT (SELECT count(*) FROM ecc) AS job_documents, (SELECT count(*) FROM eqc) AS resume_queries, 64 AS embedding_dimension,
  (SELECT CAST(sum(chunks) AS BIGINT) FROM ecc) AS job_chunks, (SELECT CAST(sum(chunks) AS BIGINT) FROM eqc) AS resume_chunks,
  round(count(t.query_id) / count(*), 6) AS mean_overlap
FROM etop e LEFT JOIN top t USING (query_id, document_id)"""
HASHED["lsh_candidates"] = f"{INDEXED}, {listed(1.3)} SELECT query_id, document_id, round(distance, 6) AS distance FROM found"
HASHED["lsh_topk"] = f"{INDEXED}, {listed(1.3)} SELECT * FROM lists"
HASHED["lsh_with_fallback"] = f"""{INDEXED}, {listed(1.2)}, {top()}
SELECT query_id, rank, document_id, score, 'lsh' AS found_by FROM lists
UNION ALL SELECT query_id, rank, document_id, round(score, 6), 'exact' FROM top WHERE query_id NOT IN (SELECT query_id FROM lists)"""
HASHED["lsh_probes"] = f"""WITH RECURSIVE {SIDES}, {pairs(4)}, {top()},
borders AS (SELECT source_id, t, floor(x / {NARROW}) AS b, greatest(0, least(31, floor(x / ({NARROW} / 32)) - 32 * floor(x / {NARROW}))) AS place FROM asked_h),
ways AS (SELECT source_id, b - 1 AS b, t, place AS way, 1 AS flag FROM borders UNION ALL SELECT source_id, b + 1, t, 31 - place, 2 FROM borders),
probes AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY way, t, flag) AS place FROM ways),
counts AS (SELECT * FROM (VALUES (0), (1), (2), (4), (8)) v(probes)),
wanted AS (SELECT probes, source_id, t, b FROM counts, borders UNION ALL SELECT c.probes, source_id, t, b FROM counts c JOIN probes p ON p.place <= c.probes),
met AS (SELECT DISTINCT probes, w.source_id AS query_id, c.source_id AS document_id FROM wanted w JOIN catalog_h c ON c.t = w.t AND floor(c.x / {NARROW}) = w.b),
found AS (SELECT probes, query_id, document_id FROM met JOIN near USING (query_id, document_id) WHERE distance < 1.3)
SELECT c.probes, count(DISTINCT f.query_id) AS queries_covered, count(f.query_id) AS candidate_pairs,
  round(count(t.query_id) / (SELECT count(*) FROM top), 6) AS candidate_recall
FROM counts c LEFT JOIN found f USING (probes) LEFT JOIN top t USING (query_id, document_id) GROUP BY c.probes"""
HASHED["lsh_recall"] = f"""WITH RECURSIVE {SIDES}, {pairs(3)}, {met('0.8::DOUBLE')}, {listed(1.4)}, {top()}
SELECT (SELECT count(*) FROM catalog) AS job_documents, (SELECT count(*) FROM asked) AS resume_queries,
  (SELECT count(*) FROM catalog) * (SELECT count(*) FROM asked) AS exhaustive_pairs, (SELECT count(*) FROM found) AS candidate_pairs,
  (SELECT count(DISTINCT query_id) FROM lists) AS matched_resumes,
  round(count(f.query_id) / count(*), 6) AS candidate_recall, round(count(l.query_id) / count(*), 6) AS final_recall
FROM top t LEFT JOIN found f USING (query_id, document_id) LEFT JOIN lists l USING (query_id, document_id)"""
HASHED["lsh_grid"] = f"""WITH RECURSIVE {SIDES}, {pairs(12)}, {top()},
settings AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)) w(bucket_length),
  (VALUES (3), (5), (8), (12)) n(num_hash_tables), (VALUES (1.2::DOUBLE), (1.3::DOUBLE), (1.4::DOUBLE)) d(distance_threshold)),
widths AS (SELECT DISTINCT bucket_length FROM settings),
met AS (SELECT bucket_length, q.source_id AS query_id, c.source_id AS document_id, min(q.t) AS first
  FROM widths, asked_h q JOIN catalog_h c ON q.t = c.t WHERE floor(q.x / bucket_length) = floor(c.x / bucket_length) GROUP BY ALL),
found AS (SELECT s.*, query_id, document_id, distance FROM settings s JOIN met USING (bucket_length) JOIN near USING (query_id, document_id)
  WHERE first < num_hash_tables AND distance < distance_threshold),
places AS (SELECT *, row_number() OVER (PARTITION BY bucket_length, num_hash_tables, distance_threshold, query_id ORDER BY distance, document_id) AS place FROM found),
per AS (SELECT bucket_length, num_hash_tables, distance_threshold, count(*) AS candidate_pairs, count(DISTINCT p.query_id) AS queries_covered,
    count(t.query_id) AS hits, count(t.query_id) FILTER (place <= 10) AS final
  FROM places p LEFT JOIN top t USING (query_id, document_id) GROUP BY ALL)
SELECT s.bucket_length, s.num_hash_tables, s.distance_threshold, coalesce(candidate_pairs, 0) AS candidate_pairs, coalesce(queries_covered, 0) AS queries_covered,
  round(coalesce(hits, 0) / (SELECT count(*) FROM top), 6) AS candidate_recall, round(coalesce(final, 0) / (SELECT count(*) FROM top), 6) AS final_recall
FROM settings s LEFT JOIN per USING (bucket_length, num_hash_tables, distance_threshold)"""

_ROLE = "trim(concat_ws(' ', nullif(trim(role_normalized), ''), nullif(trim(resume_normalized), '')))"
_JOB = """array_to_string(list_filter([nullif(trim(job_title_normalized), ''), nullif(trim(job_summary_normalized), ''),
  nullif(trim(array_to_string(list, ' ')), '')], lambda x: x IS NOT NULL), ' ')"""
HASHED["labeled_pairs_ml"] = f"""WITH {RESUMES}, {CATALOG},
pairs AS (SELECT sha256(resume_id || ':' || job_description_id) AS document_id, resume_id, label, split, row_number() OVER () AS r,
  job_description_normalized AS combined_text FROM silver_resumes WHERE length(job_description_normalized) > 0),
described AS (SELECT CAST(r AS VARCHAR) AS source_id, combined_text FROM pairs),
asked AS (SELECT DISTINCT resume_id AS source_id, {_ROLE} AS combined_text FROM silver_resumes WHERE length({_ROLE}) > 0),
{features('catalog', 'asked', 'described')},
dots AS (SELECT r, sum(a.w * d.w) AS dot FROM pairs p JOIN asked_v a ON a.source_id = p.resume_id JOIN described_v d ON d.source_id = CAST(p.r AS VARCHAR) AND d.idx = a.idx GROUP BY r)
SELECT document_id, resume_id, label, split, round(coalesce(dot, 0), 6) AS similarity_score
FROM pairs p LEFT JOIN dots USING (r) WHERE resume_id IN (SELECT source_id FROM asked)"""
HASHED["match_end_to_end"] = f"""WITH RECURSIVE {SILVER}, {RESUMES},
jobs AS (SELECT * FROM (SELECT job_link AS source_id, {_JOB} AS combined_text FROM silver) WHERE length(combined_text) > 0),
chosen AS (SELECT resume_id, coalesce(role_normalized, '') AS role, {_ROLE} AS text FROM silver_resumes WHERE split = 'validation'),
firsts AS (SELECT resume_id, min(role) AS first_role FROM chosen GROUP BY resume_id),
owned AS (SELECT DISTINCT resume_id, CASE WHEN role = first_role THEN resume_id ELSE sha256(resume_id || ':' || role) END AS source_id, text AS combined_text
  FROM chosen JOIN firsts USING (resume_id) WHERE length(text) > 0),
questions AS (SELECT source_id, combined_text FROM owned),
{features('jobs', 'questions')}, {pairs(3, 'jobs', 'questions')}, {met('0.8::DOUBLE', catalog='jobs', asked='questions')}, {listed(1.4)},
merged AS (SELECT o.resume_id AS query_id, document_id, min(f.distance) AS distance FROM found f JOIN owned o ON o.source_id = f.query_id GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, document_id, round(greatest(-1, least(1, 1 - distance * distance / 2)), 6) AS score, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS rank FROM merged) WHERE rank <= 10"""

ORACLE.update(HASHED)
