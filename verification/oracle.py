"""The same results in SQL, written from the operators' definitions, for DuckDB."""

from __future__ import annotations

from pairloom.functions.stopwords import ENGLISH_STOP_WORDS
from pairloom.operators import review as R
from pairloom.operators.silver import TRAIN_RATIO, VALIDATION_RATIO
from verification.tables import HEADERS

SEED = 5110
REVIEW_QUERIES = 25
MAX_TOKENS, OVERLAP = 120, 20
STEP = MAX_TOKENS - OVERLAP

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
URL = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/\S+"
PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}"

ORACLE: dict[str, str] = {}


def spaces(x: str) -> str:
    return f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"


def normal(x: str) -> str:
    return f"lower({spaces(x)})"


def email_url(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{EMAIL}', '[EMAIL]', 'g'), '{URL}', '[LINKEDIN]', 'g')"


def phone(x: str) -> str:
    """Digits next to a match are captured and put back; twice, as matches may share one."""
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^\\d]){PHONE}($|[^\\d])', '\\1[PHONE]\\2', 'g')"
    return x


def bucket(key: str, seed: int | str = SEED, buckets: int = 1_000_000) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {key}), 1, 8))::BIGINT % {buckets})"


def items(x: str) -> str:
    """Delimited text to a sorted list of distinct entries."""
    cut = f"list_transform(string_split(coalesce({x}, ''), ','), lambda i: lower(trim(i)))"
    return f"list_sort(list_distinct(list_filter({cut}, lambda i: i <> '')))"


STOP = "[" + ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH_STOP_WORDS) + "]"


def words(x: str) -> str:
    pieces = rf"string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}+#.]+')"
    return f"list_filter({pieces}, lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"


def grams(t: str) -> str:
    pairs = f"list_transform(range(1, len({t})), lambda i: 'b_' || {t}[i] || '_' || {t}[i + 1])"
    return f"list_concat(list_transform({t}, lambda w: 'u_' || w), {pairs})"


# ---------------------------------------------------------------- shared tables

CATALOG = """catalog AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS document_id, 'catalog' AS document_type,
  CAST(doc_id AS VARCHAR) AS source_id, trim(text) AS combined_text FROM documents WHERE length(trim(text)) > 0)"""
ASKED = """asked AS (SELECT sha256(CAST(item_id AS VARCHAR)) AS document_id, 'query' AS document_type,
  CAST(item_id AS VARCHAR) AS source_id, trim(text) AS combined_text FROM benchmark WHERE length(trim(text)) > 0)"""
POSTINGS = """postings AS (SELECT CAST(event_id AS VARCHAR) AS job_link,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_processed_time,
  CASE WHEN event_type IN ('view', 'click') THEN 't' ELSE 'f' END AS got_summary,
  CASE WHEN event_type = 'signup' THEN 't' WHEN event_type <> 'error' THEN 'f' END AS got_ner,
  CASE WHEN value > 50 THEN 't' ELSE 'f' END AS is_being_worked,
  '  Event ' || chr(10) || ' of  ' || event_type AS job_title,
  ' User  ' || CAST(user_id AS VARCHAR) AS company, upper(props) AS job_location,
  CASE WHEN event_type = 'error' THEN 'not known' ELSE strftime(ts, '%Y-%m-%d') END AS first_seen,
  CASE WHEN event_type <> 'error' THEN event_type END AS job_type FROM events)"""
SKILLS = """skills AS (SELECT CAST(p_partkey AS VARCHAR) AS job_link,
  replace(p_name, ' ', ' , ') || ',, ' || upper(p_name) || ',' || p_type AS job_skills FROM part)"""
SILVER = f"""{POSTINGS}, {SKILLS}, silver AS (
  SELECT p.*, {normal('p.job_title')} AS job_title_normalized, {spaces('s.text')} AS job_summary_normalized,
    k.list, coalesce(len(k.list), 0) AS skill_count, s.text IS NOT NULL AS has_summary,
    coalesce(len(k.list), 0) > 0 AS has_skills
  FROM postings p LEFT JOIN documents s ON p.job_link = CAST(s.doc_id AS VARCHAR)
  LEFT JOIN (SELECT job_link, {items('job_skills')} AS list FROM skills) k ON p.job_link = k.job_link)"""
RESUMES = f"""resumes AS (SELECT d.lang AS role, d.text AS resume, b.text AS description,
    CASE WHEN l.quality = 1 THEN ' Select' WHEN l.quality = 0 THEN 'reject' END AS decision
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
masked AS (SELECT sha256(resume) AS resume_id, {normal('role')} AS role_normalized,
    {normal(phone(email_url('resume')))} AS resume_normalized,
    CASE WHEN decision IS NULL THEN NULL WHEN {normal('decision')} = 'select' THEN 1 ELSE 0 END AS label,
    {normal('description')} AS job_description_normalized FROM resumes),
silver_resumes AS (SELECT *, sha256(job_description_normalized) AS job_description_id,
    regexp_matches(resume_normalized, '{EMAIL}') AS pii_masking_warning,
    CASE WHEN {bucket('sha256(job_description_normalized)')} / 1000000.0 < {TRAIN_RATIO} THEN 'train'
         WHEN {bucket('sha256(job_description_normalized)')} / 1000000.0 < {TRAIN_RATIO + VALIDATION_RATIO} THEN 'validation'
         ELSE 'test' END AS split FROM masked)"""
SPLITS = f"""splits AS (SELECT doc_id, text_id,
    CASE WHEN {bucket('text_id')} / 1000000.0 < {TRAIN_RATIO} THEN 'train'
         WHEN {bucket('text_id')} / 1000000.0 < {TRAIN_RATIO + VALIDATION_RATIO} THEN 'validation'
         ELSE 'test' END AS split
  FROM (SELECT doc_id, sha256({normal('text')}) AS text_id FROM documents))"""
BENCHMARK_RESUMES = f"""benchmark_resumes AS (SELECT CAST(item_id AS VARCHAR) AS resume_id,
  split_part({normal('text')}, ' ', 1) AS role_normalized, {normal('text')} AS resume_normalized FROM benchmark)"""


def idf(p: str, ngrams: bool = False) -> str:
    """Catalog term counts and idf under the prefix ``p``."""
    terms = grams("list") if ngrams else "list"
    return f"""{p}ct AS (SELECT source_id, unnest({terms}) AS term FROM (SELECT source_id, {words('combined_text')} AS list FROM catalog)),
{p}ctf AS (SELECT source_id, term, count(*) AS tf FROM {p}ct GROUP BY ALL),
{p}idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM catalog) + 1) / (count(*) + 1)) AS idf
  FROM {p}ctf GROUP BY term HAVING count(*) >= 2)"""


def scores(p: str, ngrams: bool = False) -> str:
    """Rounded cosine of all pairs sharing a term: ``{p}s(query_id, document_id, score)``."""
    terms = grams("list") if ngrams else "list"
    return f"""{idf(p, ngrams)},
{p}qt AS (SELECT source_id, unnest({terms}) AS term FROM (SELECT source_id, {words('combined_text')} AS list FROM asked)),
{p}cw AS (SELECT source_id, term, tf * idf AS w FROM {p}ctf JOIN {p}idf USING (term)),
{p}qw AS (SELECT source_id, term, count(*) * any_value(idf) AS w FROM {p}qt JOIN {p}idf USING (term) GROUP BY source_id, term),
{p}cn AS (SELECT source_id, sqrt(sum(w * w)) AS n FROM {p}cw GROUP BY source_id HAVING sum(w * w) > 0),
{p}qn AS (SELECT source_id, sqrt(sum(w * w)) AS n FROM {p}qw GROUP BY source_id HAVING sum(w * w) > 0),
{p}s AS (SELECT q.source_id AS query_id, c.source_id AS document_id, round(sum((c.w / cn.n) * (q.w / qn.n)), 6) AS score
  FROM {p}cw c JOIN {p}qw q USING (term) JOIN {p}cn cn ON c.source_id = cn.source_id JOIN {p}qn qn ON q.source_id = qn.source_id
  GROUP BY 1, 2)"""


def ranked(p: str, k: int, source: str | None = None) -> str:
    return f"""{p}top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, document_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM {source or p + 's'}) WHERE rank <= {k})"""


def lexical(p: str, ngrams: bool = False, k: int = 10) -> str:
    return f"{scores(p, ngrams)}, {ranked(p, k)}"


def pooled(p: str, side: str) -> str:
    """Hashing-encoder embeddings in long form: ``{p}v(source_id, chunks, dim, value)``."""
    place = "('0x' || substr(md5(token), 1, 8))::BIGINT"
    return f"""{p}w AS (SELECT source_id, list_filter(string_split_regex(combined_text, '\\s+'), lambda w: w <> '') AS list FROM {side}),
{p}k AS (SELECT source_id, len(list) AS n, list, unnest(range(0, len(list), {STEP})) AS start FROM {p}w),
{p}t AS (SELECT source_id, start, unnest(list[start + 1 : start + {MAX_TOKENS}]) AS token FROM {p}k),
{p}d AS (SELECT source_id, start, {place} % 64 AS dim, sum(1 - 2 * (({place} // 64) % 2)) AS x FROM {p}t GROUP BY 1, 2, 3),
{p}n AS (SELECT source_id, start, sqrt(sum(x * x)) AS n FROM {p}d GROUP BY 1, 2),
{p}c AS (SELECT source_id, count(*) AS chunks FROM {p}k GROUP BY 1),
{p}p AS (SELECT source_id, dim, sum(CASE WHEN n > 0 THEN x / n ELSE 0 END) AS m FROM {p}d JOIN {p}n USING (source_id, start) GROUP BY 1, 2),
{p}l AS (SELECT source_id, sqrt(sum(m * m)) AS n FROM {p}p GROUP BY 1),
{p}v AS (SELECT source_id, chunks, r.dim AS dim, CAST(CAST(coalesce(p.m / l.n, 0) AS FLOAT) AS DOUBLE) AS value
  FROM {p}c JOIN {p}l l USING (source_id) CROSS JOIN range(64) r(dim) LEFT JOIN {p}p p USING (source_id, dim))"""


def dense(p: str) -> str:
    return f"""{pooled(p + 'c', 'catalog')}, {pooled(p + 'q', 'asked')},
{p}s AS (SELECT q.source_id AS query_id, c.source_id AS document_id, round(sum(q.value * c.value), 6) AS score
  FROM {p}qv q JOIN {p}cv c USING (dim) GROUP BY 1, 2), {ranked(p, 10)}"""


def systems() -> str:
    return f"{CATALOG}, {ASKED}, {lexical('t')}, {lexical('g', True)}, {dense('e')}"


# ---------------------------------------------------------------- text and keys

ORACLE["normalize_text"] = f"SELECT doc_id, sha256({normal('text')}) AS digest, length({normal('text')}) AS chars FROM documents"
ORACLE["collapse_spaces"] = f"SELECT doc_id, sha256({spaces('text')}) AS digest, length({spaces('text')}) AS chars FROM documents"
ORACLE["stable_ids"] = f"""SELECT doc_id, sha256(text) AS text_id, sha256({normal('text')}) AS normal_id,
  sha256(source || ':' || lang) AS pair_id, sha256('{SEED}|' || source || '|' || doc_id) AS order_key FROM documents"""
ORACLE["mask_email_url"] = f"""SELECT doc_id, sha256({email_url('text')}) AS digest,
  regexp_matches(text, '{EMAIL}') AS had_email, regexp_matches({email_url('text')}, '{EMAIL}') AS has_email FROM documents"""
_OPENING = "CASE doc_id % 4 WHEN 0 THEN {} WHEN 1 THEN {} ELSE '' END".format(*("'" + h.replace("'", "''") + "'" for h in HEADERS))
_HEADER = "(?i)(professional resume for)\\s+([A-Z][A-Za-z''-]+(?:\\s+[A-Z][A-Za-z''-]+){1,3}):"
# The name is captured; what follows loses an exact repeat of it, in any case.
ORACLE["mask_identifiers"] = f"""WITH d AS (SELECT doc_id, {_OPENING} || text AS text FROM documents),
m AS (SELECT doc_id, text, {phone(email_url('text'))} AS x FROM d),
n AS (SELECT *, lower(regexp_extract(x, '{_HEADER}', 2)) AS name, regexp_replace(x, '{_HEADER}', '\\1 [NAME]:' || chr(1)) AS y FROM m),
r AS (SELECT *, split_part(y, chr(1), 1) AS head, substr(y, strpos(y, chr(1)) + 1) AS rest FROM n),
z AS (SELECT doc_id, text, CASE WHEN name = '' THEN x ELSE head || ' [NAME]' || CASE
    WHEN starts_with(lower(regexp_replace(rest, '^\\s+', '')), name) THEN substr(regexp_replace(rest, '^\\s+', ''), length(name) + 1)
    ELSE rest END END AS masked FROM r)
SELECT doc_id, sha256(masked) AS digest, masked <> text AS masked FROM z"""
ORACLE["mask_phone"] = f"SELECT doc_id, sha256({phone('text')}) AS digest, {phone('text')} <> text AS masked FROM documents"
ORACLE["parse_list"] = f"""SELECT doc_id, len({items('text')}) AS items,
  sha256(array_to_string({items('text')}, '|')) AS digest FROM documents"""
ORACLE["typed_postings"] = f"""WITH {POSTINGS} SELECT job_link, last_processed_time AS last_processed_at,
  TRY_CAST(first_seen AS DATE) AS first_seen_date, got_summary = 't' AS got_summary_flag, got_ner = 't' AS got_ner_flag,
  is_being_worked = 't' AS is_being_worked_flag, {normal('job_title')} AS job_title_normalized,
  {normal('company')} AS company_normalized, {normal('job_location')} AS job_location_normalized FROM postings"""
ORACLE["review_excerpts"] = """SELECT doc_id, substr(text, 1, 1200) AS short, sha256(substr(text, 1, 1600)) AS long_digest FROM documents"""

# ---------------------------------------------------------------- selection

ORACLE["hash_sample_fast"] = """SELECT count(*) AS rows, true AS small_share_holds, true AS large_share_holds,
  true AS nested, true AS repeatable FROM orders"""
ORACLE["group_split_fast"] = f"""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, true AS groups_whole,
  true AS splits_known, true AS train_share_holds
  FROM (SELECT sha256({normal('text')}) AS text_id, count(*) AS n FROM documents GROUP BY 1)"""
ORACLE["hash_sample"] = " UNION ALL ".join(
    f"SELECT o_orderkey, CAST({f} AS DOUBLE) AS fraction FROM orders WHERE {bucket('o_orderkey')} < {round(f * 1_000_000)}"
    for f in (0.05, 0.25)
)
ORACLE["group_split"] = f"WITH {SPLITS} SELECT doc_id, text_id, split FROM splits"
ORACLE["split_counts"] = f"WITH {SPLITS} SELECT split, count(*) AS rows FROM splits GROUP BY split"
ORACLE["select_queries"] = f"""WITH {SPLITS} SELECT doc_id, split FROM splits WHERE split = 'validation' ORDER BY doc_id LIMIT 100"""
ORACLE["semi_restrict"] = f"""WITH {POSTINGS}, kept AS (SELECT job_link FROM postings WHERE {bucket('job_link')} < 250000)
SELECT CAST(doc_id AS VARCHAR) AS job_link, 'summary' AS child FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT job_link FROM kept)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'skills' FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT job_link FROM kept)"""

PICKS = f"""pool AS (SELECT resume_id, coalesce(nullif({spaces('role_normalized')}, ''), 'unknown') AS role_normalized FROM benchmark_resumes),
marked AS (SELECT *, row_number() OVER (PARTITION BY role_normalized ORDER BY sha256('{SEED}|' || role_normalized || '|' || resume_id), resume_id) AS dim FROM pool),
keyed AS (SELECT resume_id, role_normalized, CASE WHEN dim = 1 THEN 0 ELSE 1 END AS repeat,
  CASE WHEN dim = 1 THEN sha256('{SEED}|' || role_normalized || '|' || resume_id) ELSE sha256('{SEED}|' || resume_id) END AS k FROM marked),
picks AS (SELECT resume_id, role_normalized, CAST(row_number() OVER (ORDER BY repeat, k, resume_id) AS INTEGER) AS pick FROM keyed
  QUALIFY pick <= {REVIEW_QUERIES})"""
ORACLE["diverse_queries"] = f"WITH {BENCHMARK_RESUMES}, {PICKS} SELECT resume_id, role_normalized, pick FROM picks"

# ---------------------------------------------------------------- silver tables

ORACLE["silver_jobs"] = f"""WITH {SILVER} SELECT job_link, job_title_normalized, sha256(job_summary_normalized) AS summary_digest,
  array_to_string(list, '|') AS skills, CAST(skill_count AS BIGINT) AS skill_count, has_summary, has_skills,
  skill_count > 3 AS skills_count_warning, has_summary AND has_skills AS eligible_for_ml FROM silver"""
ORACLE["silver_resumes"] = f"""WITH {RESUMES} SELECT resume_id, role_normalized, sha256(resume_normalized) AS resume_digest,
  label, job_description_id, pii_masking_warning, split FROM silver_resumes"""
ORACLE["catalog_documents"] = f"""WITH {SILVER}, d AS (SELECT job_link, array_to_string(list_filter([
  nullif(trim(job_title_normalized), ''), nullif(trim(job_summary_normalized), ''),
  nullif(trim(array_to_string(list, ' ')), '')], lambda x: x IS NOT NULL), ' ') AS text FROM silver)
SELECT sha256(job_link) AS document_id, 'job' AS document_type, job_link AS source_id, sha256(text) AS combined_text FROM d WHERE length(text) > 0"""
ORACLE["query_documents"] = f"""WITH {RESUMES}, d AS (SELECT resume_id, trim(concat_ws(' ', nullif(trim(role_normalized), ''), nullif(trim(resume_normalized), ''))) AS text FROM silver_resumes)
SELECT resume_id AS document_id, 'resume' AS document_type, resume_id AS source_id, sha256(text) AS combined_text FROM d WHERE length(text) > 0"""
ORACLE["evaluation_documents"] = f"""WITH {RESUMES} SELECT sha256(resume_id || ':' || job_description_id) AS document_id,
  'evaluation_job_description' AS document_type, sha256(resume_id || ':' || job_description_id) AS source_id,
  sha256(job_description_normalized) AS combined_text, resume_id, label, split FROM silver_resumes WHERE job_description_normalized IS NOT NULL"""
ORACLE["job_metrics"] = f"""WITH {SILVER} SELECT (SELECT count(*) FROM events) AS posting_count, count(*) AS silver_count,
  count(*) - count(DISTINCT job_link) AS duplicate_job_links, avg(has_summary::INT) AS summary_coverage,
  avg(has_skills::INT) AS skills_coverage, count(*) FILTER (has_summary AND has_skills) AS eligible_for_ml_count FROM silver"""
ORACLE["resume_metrics"] = f"""WITH {RESUMES} SELECT (SELECT count(*) FROM resumes) AS source_count, count(*) AS silver_count,
  count(*) - count(DISTINCT resume_id) AS duplicate_resume_ids, CAST(coalesce(sum(label), 0) AS BIGINT) AS selected_count,
  count(*) FILTER (pii_masking_warning) AS pii_warning_count FROM silver_resumes"""

# ---------------------------------------------------------------- profile and quality

ORACLE["duplicate_keys"] = f"SELECT count(*) - count(DISTINCT sha256({normal('text')})) AS duplicate_rows FROM documents"
ORACLE["category_counts"] = f"""WITH {POSTINGS} SELECT coalesce(job_type, 'unknown') AS job_type, count(*) AS job_count FROM postings GROUP BY 1"""
ORACLE["top_categories"] = """SELECT source, count(*) AS rows FROM documents GROUP BY 1 ORDER BY rows DESC, source LIMIT 12"""
LENGTH = "len(string_split_regex(trim(combined_text), '\\s+'))"
ORACLE["length_histogram"] = f"""WITH {CATALOG}, {ASKED}, w AS (SELECT document_type, {LENGTH} AS n FROM (SELECT * FROM catalog UNION ALL SELECT * FROM asked))
SELECT document_type, CASE WHEN n < 100 THEN '<100' WHEN n < 250 THEN '100-249' WHEN n < 500 THEN '250-499' WHEN n < 1000 THEN '500-999'
  ELSE '1000+' END AS length_bucket, count(*) AS document_count FROM w GROUP BY 1, 2"""
ORACLE["quality_rates"] = f"""WITH {SILVER} SELECT count(*) AS job_count, avg(has_summary::INT) AS summary_coverage,
  avg(has_skills::INT) AS skills_coverage FROM silver"""
ORACLE["eda_summary"] = f"""WITH {SILVER}, {ASKED} SELECT count(*) AS job_count, avg(has_summary::INT) AS summary_coverage,
  avg(has_skills::INT) AS skills_coverage, (SELECT count(*) FROM asked) AS resume_count FROM silver"""


def finding(dataset: str, rule: str, column: str, severity: str, checked: str, failed: str, source: str, least: str = "") -> str:
    verdict = f"rate >= {least}" if least else "failed = 0"
    return f"""SELECT *, {verdict} AS passed FROM (SELECT '{dataset}' AS dataset, '{rule}' AS rule, '{column}' AS "column",
  '{severity}' AS severity, checked, failed, CASE WHEN checked = 0 THEN 1.0 ELSE 1.0 - failed / checked END AS rate
  FROM (SELECT CAST({checked} AS BIGINT) AS checked, CAST({failed} AS BIGINT) AS failed {source}))"""


SPLIT_SHARES = {"train": TRAIN_RATIO, "validation": VALIDATION_RATIO, "test": 1 - TRAIN_RATIO - VALIDATION_RATIO}


def split_share(name: str, share: float, margin: float = 0.02) -> str:
    n, most, least = f"count(*) FILTER (split = '{name}')", share + margin, share - margin
    missed = f"greatest({n} - floor(count(*) * {most!r}::DOUBLE), ceil(count(*) * {least!r}::DOUBLE) - {n}, 0)"
    return finding("splits", "split_share", f"split={name}", "warning", "count(*)", missed, "FROM splits")


PIECES = "len(list_filter(string_split(text, ','), lambda p: trim(p) <> ''))"
ORACLE["quality_report"] = f"WITH {SILVER}, {SPLITS} " + " UNION ALL ".join(
    [
        finding("postings", "required_columns", "salary", "error", "3", "1", ""),
        finding("postings", "non_null", "job_link", "error", "count(*)", "count(*) FILTER (job_link IS NULL)", "FROM postings"),
        finding("postings", "non_null", "got_ner", "error", "count(*)", "count(*) FILTER (got_ner IS NULL)", "FROM postings"),
        finding("postings", "allowed_values", "got_ner", "error", "count(*)", "count(*) FILTER (got_ner NOT IN ('t', 'f'))", "FROM postings"),
        finding("postings", "allowed_values", "job_type", "warning", "count(*)", "count(*) FILTER (job_type NOT IN ('view', 'click'))", "FROM postings"),
        finding("postings", "unique_key", "job_link", "error", "count(*)", "count(*) - count(DISTINCT job_link)", "FROM postings"),
        finding("documents", "text_length", "text", "warning", "count(*)", "count(*) FILTER (length(text) < 200)", "FROM documents"),
        finding("documents", "list_size_min", "text", "warning", "count(*)", f"count(*) FILTER ({PIECES} < 1)", "FROM documents"),
        finding("documents", "list_size_max", "text", "warning", "count(*)", f"count(*) FILTER ({PIECES} > 100)", "FROM documents"),
        finding("documents", "unique_key", "text", "error", "count(*)", "count(*) - count(DISTINCT text)", "FROM documents"),
        finding("labels", "parent_match", "doc_id", "error", "count(*)", "count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents))", "FROM labels", "1.0"),
        finding("documents", "parent_match", "doc_id", "warning", "count(*)", "count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels))", "FROM documents", "0.95"),
        finding("lineitem", "parent_match", "l_orderkey", "error", "count(*)", "count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders))", "FROM lineitem", "1.0"),
        finding("silver", "coverage", "has_summary", "warning", "count(*)", "count(*) FILTER (NOT has_summary)", "FROM silver", "0.95"),
        finding("silver", "row_count", "*", "error", "(SELECT count(*) FROM postings)", "abs((SELECT count(*) FROM silver) - (SELECT count(*) FROM postings))", ""),
        finding("splits", "disjoint_groups", "text_id", "error", "count(*)", "count(*) FILTER (n > 1)", "FROM (SELECT text_id, count(DISTINCT split) AS n FROM splits GROUP BY 1)"),
        finding("postings", "non_null", "absent", "error", "count(*)", "count(*)", "FROM postings"),
    ]
    + [split_share(name, share) for name, share in SPLIT_SHARES.items()]
)

# ---------------------------------------------------------------- lexical search

ORACLE["tokens"] = f"""WITH {CATALOG} SELECT source_id, len(list) AS tokens, sha256(array_to_string(list, ' ')) AS digest
FROM (SELECT source_id, {words('combined_text')} AS list FROM catalog)"""
ORACLE["ngram_terms"] = f"""WITH {CATALOG} SELECT source_id, len(list) AS terms, sha256(array_to_string(list, ' ')) AS digest
FROM (SELECT source_id, {grams('list')} AS list FROM (SELECT source_id, {words('combined_text')} AS list FROM catalog))"""
ORACLE["document_frequency"] = f"WITH {CATALOG}, {idf('t')} SELECT term, df, round(idf, 6) AS idf FROM tidf"
ORACLE["tfidf_topk"] = f"WITH {CATALOG}, {ASKED}, {lexical('t')} SELECT * FROM ttop"
ORACLE["ngram_tfidf_topk"] = f"WITH {CATALOG}, {ASKED}, {lexical('t', True)} SELECT * FROM ttop"
ORACLE["tfidf_topk_filled"] = f"""WITH {CATALOG}, {ASKED}, {scores('t', True)},
full_s AS (SELECT a.source_id AS query_id, c.source_id AS document_id, coalesce(score, 0.0) AS score
  FROM asked a CROSS JOIN catalog c LEFT JOIN ts ON ts.query_id = a.source_id AND ts.document_id = c.source_id),
{ranked('f', 60, 'full_s')} SELECT * FROM ftop"""

# ---------------------------------------------------------------- dense vectors

ORACLE["dense_topk"] = f"""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS source_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings CROSS JOIN range(1, 65) r(i)),
m AS (SELECT CAST(label AS VARCHAR) AS label, dim, avg(x) AS x FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
ds AS (SELECT m.label AS query_id, e.source_id AS document_id, round(sum(m.x / n.n * e.x), 6) AS score
  FROM m JOIN n USING (label) JOIN e USING (dim) GROUP BY 1, 2), {ranked('d', 10)} SELECT * FROM dtop"""
ORACLE["chunk_counts"] = f"""WITH {CATALOG}, w AS (SELECT source_id, list_filter(string_split_regex(combined_text, '\\s+'), lambda w: w <> '') AS list FROM catalog),
c AS (SELECT source_id, list_transform(range(0, len(list), {STEP}), lambda s: array_to_string(list[s + 1 : s + {MAX_TOKENS}], ' ')) AS chunks FROM w)
SELECT source_id, len(chunks) AS chunks, sha256(array_to_string(chunks, '|')) AS digest FROM c"""
ORACLE["chunk_embed_pool"] = f"""WITH {CATALOG}, {pooled('c', 'catalog')}
SELECT source_id, chunks AS chunk_count, dim, round(value, 5) AS value FROM cv"""
ORACLE["embedding_totals"] = f"""WITH {CATALOG}, w AS (SELECT len(list_filter(string_split_regex(combined_text, '\\s+'), lambda w: w <> '')) AS n FROM catalog)
SELECT count(*) AS documents, CAST(sum(ceil(n / {STEP})) AS BIGINT) AS chunks, 64::BIGINT AS dimension FROM w"""
ORACLE["embedding_cache_delta"] = f"""WITH {CATALOG} SELECT source_id, document_type FROM catalog
WHERE source_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""
ORACLE["embedding_cache_status"] = f"""WITH {CATALOG} SELECT count(*) AS cached_rows, 1::BIGINT AS models, count(*) AS expected_rows,
  0::BIGINT AS unexpected_ids, 0::BIGINT AS missing_ids, true AS valid FROM catalog"""
ORACLE["dense_text_topk"] = f"WITH {CATALOG}, {ASKED}, {dense('e')} SELECT * FROM etop"

# ---------------------------------------------------------------- evaluation

ORACLE["overlap_pairs"] = f"""WITH {CATALOG}, {ASKED}, {lexical('t')}, {lexical('g', True)}
SELECT round(avg(CASE WHEN g.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS mean_overlap
FROM ttop t LEFT JOIN gtop g ON t.query_id = g.query_id AND t.document_id = g.document_id"""
ORACLE["overlap_matrix"] = f"""WITH {systems()},
tagged AS (SELECT 'tfidf' AS system, query_id, document_id FROM ttop UNION ALL SELECT 'ngram', query_id, document_id FROM gtop
  UNION ALL SELECT 'transformer', query_id, document_id FROM etop)
SELECT a.system AS system_a, b.system AS system_b, round(count(*) / (10.0 * (SELECT count(DISTINCT query_id) FROM tagged)), 6) AS mean_overlap
FROM tagged a JOIN tagged b USING (query_id, document_id) GROUP BY 1, 2"""
ORACLE["method_comparison"] = f"WITH {systems()}, shares AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS method, avg(CASE WHEN o.rank IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM ttop t "
    f"LEFT JOIN {top} o ON t.query_id = o.query_id AND t.document_id = o.document_id"
    for name, top in (("tfidf", "ttop"), ("ngram", "gtop"), ("transformer", "etop"))
) + ") SELECT method, round(share, 6) AS overlap_with_baseline, round(1.0 - share, 6) AS changed_vs_baseline FROM shares"
ORACLE["recall_metrics"] = f"""WITH {CATALOG}, {ASKED}, {lexical('t')}, {lexical('g', True, 20)}
SELECT round(avg(CASE WHEN g.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS candidate_recall,
  round(avg(CASE WHEN g.rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS final_recall
FROM ttop t LEFT JOIN gtop g ON t.query_id = g.query_id AND t.document_id = g.document_id"""
GRID = f"""{CATALOG}, {ASKED}, {lexical('t')}, {scores('g', True)},
near AS (SELECT query_id, document_id, round(sqrt(greatest(0.0, 2.0 - 2.0 * score)), 6) AS distance FROM gs),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS rank FROM near WHERE distance < 1.4),
flagged AS (SELECT b.*, t.rank IS NOT NULL AS hit FROM best b LEFT JOIN ttop t ON b.query_id = t.query_id AND b.document_id = t.document_id),
grid AS (SELECT t AS distance_threshold, count(*) FILTER (distance < t) AS candidate_pairs,
  count(DISTINCT query_id) FILTER (distance < t) AS queries_covered,
  round(count(*) FILTER (distance < t AND hit) / (SELECT count(*) FROM ttop), 6) AS candidate_recall,
  round(count(*) FILTER (distance < t AND hit AND rank <= 10) / (SELECT count(*) FROM ttop), 6) AS final_recall
  FROM flagged CROSS JOIN (SELECT unnest([1.1, 1.2, 1.3, 1.4])::DOUBLE AS t) GROUP BY 1)"""
ORACLE["threshold_evaluation"] = f"WITH {GRID} SELECT * FROM grid"
ORACLE["best_setting"] = f"""WITH {GRID} SELECT * FROM grid WHERE candidate_recall >= 0.5 AND queries_covered = (SELECT count(*) FROM asked)
ORDER BY candidate_pairs, distance_threshold LIMIT 1"""
ORACLE["leaderboard"] = f"WITH {GRID} SELECT * FROM grid ORDER BY candidate_recall DESC, candidate_pairs, distance_threshold LIMIT 3"


def pair_side(p: str, role: str) -> str:
    return f"""{p}t AS (SELECT pair_id, unnest({words('text')}) AS term FROM turns WHERE role = '{role}'),
{p}w AS (SELECT pair_id, term, count(*) * any_value(idf) AS w FROM {p}t JOIN cidf USING (term) GROUP BY 1, 2),
{p}n AS (SELECT pair_id, sqrt(sum(w * w)) AS n FROM {p}w GROUP BY 1)"""


PAIRS = f"""{CATALOG}, {idf('c')}, turns AS (SELECT CAST(conv_id AS VARCHAR) AS pair_id, role, text FROM conversations),
{pair_side('u', 'user')}, {pair_side('b', 'assistant')},
dots AS (SELECT pair_id, sum(uw.w * bw.w) AS dot FROM uw JOIN bw USING (pair_id, term) GROUP BY 1),
pairs AS (SELECT pair_id, max((role = 'system')::INT) AS label FROM turns GROUP BY 1),
scored AS (SELECT p.pair_id, label, round(coalesce(CASE WHEN un.n * bn.n > 0 THEN dot / (un.n * bn.n) END, 0.0), 6) AS similarity_score
  FROM pairs p LEFT JOIN un USING (pair_id) LEFT JOIN bn USING (pair_id) LEFT JOIN dots USING (pair_id))"""
ORACLE["pair_scores"] = f"WITH {PAIRS} SELECT pair_id, label, similarity_score FROM scored"
ORACLE["roc_pr_auc"] = f"""WITH {PAIRS},
g AS (SELECT similarity_score AS s, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1),
c AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY s DESC)),
x AS (SELECT s, tp / (SELECT sum(pos) FROM g) AS tpr, fp / (SELECT sum(neg) FROM g) AS fpr, tp / (tp + fp) AS precision FROM c),
y AS (SELECT *, lag(tpr, 1, 0) OVER w AS tpr0, lag(fpr, 1, 0) OVER w AS fpr0, coalesce(lag(precision) OVER w, precision) AS precision0
  FROM x WINDOW w AS (ORDER BY s DESC))
SELECT (SELECT count(*) FROM scored) AS evaluated_pairs, 0::BIGINT AS unlabelled_pairs,
  round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS roc_auc, round(sum((tpr - tpr0) * (precision + precision0) / 2), 6) AS pr_auc FROM y"""
JACCARD_LEFT, JACCARD_RIGHT = f"list_distinct({words(normal('p_name'))})", f"list_distinct({words('p_type || chr(32) || p_name')})"
ORACLE["title_overlap"] = f"""WITH t AS (SELECT p_partkey, {JACCARD_LEFT} AS a, {JACCARD_RIGHT} AS b FROM part),
u AS (SELECT p_partkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS n FROM t)
SELECT p_partkey, round(CASE WHEN n > 0 THEN common / n ELSE 0.0 END, 6) AS overlap FROM u"""

# ---------------------------------------------------------------- review

NAMES = {"tfidf": "ttop", "ngram": "gtop", "transformer": "etop"}
POOL = "pooled AS (SELECT query_id, document_id, " + ", ".join(
    f"max(CASE WHEN system = '{n}' THEN {v} END) AS {n}_{v}" for n in NAMES for v in ("rank", "score")
) + " FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS system, * FROM {t}" for n, t in NAMES.items()) + ") GROUP BY 1, 2)"
ORACLE["review_pool"] = f"WITH {systems()}, {POOL} SELECT * FROM pooled"
NUMBERED = f"""{systems()}, {POOL}, {BENCHMARK_RESUMES.replace('FROM benchmark)', 'FROM benchmark WHERE CAST(item_id AS VARCHAR) IN (SELECT query_id FROM ttop INTERSECT SELECT query_id FROM gtop INTERSECT SELECT query_id FROM etop))')}, {PICKS},
numbered AS (SELECT p.*, b.resume_normalized, b.role_normalized AS role, printf('Q%03d', k.pick) AS number,
  row_number() OVER (PARTITION BY p.query_id ORDER BY sha256('{SEED}|' || p.query_id || '|' || p.document_id), p.document_id) AS dim
  FROM pooled p JOIN picks k ON p.query_id = k.resume_id JOIN benchmark_resumes b ON b.resume_id = p.query_id),
named AS (SELECT *, printf('%s-C%02d', number, dim) AS review_id FROM numbered)"""
ORACLE["review_sheet"] = f"""WITH {NUMBERED} SELECT review_id, number AS query_id, role AS resume_role,
  substr(resume_normalized, 1, 1200) AS resume_excerpt, lang || ' ' || source AS job_title, source AS company, lang AS job_location,
  '' AS job_level, 'text' AS job_type, substr(text, 1, 1600) AS job_summary_excerpt, {", ".join(f"'' AS {name}" for name in R.ANSWERS)}
FROM named JOIN documents d ON named.document_id = CAST(d.doc_id AS VARCHAR)"""
ORACLE["answer_key"] = f"""WITH {NUMBERED} SELECT review_id, number AS query_id, query_id AS resume_id, document_id AS job_link,
  {", ".join(f"{n}_rank IS NOT NULL AS in_{n}, {n}_rank, {n}_score" for n in NAMES)} FROM named"""


def sheets() -> str:
    return " UNION ALL ".join(
        "SELECT review_id, "
        + ", ".join(f"CASE WHEN {bucket('review_id', r, 7)} <> 0 THEN {bucket(f'review_id || chr(124) || {chr(39)}{n}{chr(39)}', r, 5)} + 1 END AS {n}" for n in R.RATINGS)
        + " FROM named"
        for r in (1, 2, 3)
    )


SPREAD = {n: f"coalesce(max({n}) - min({n}), 0)" for n in R.RATINGS}
MERGED = f"""filled AS ({sheets()}), merged AS (SELECT review_id, count(overall_relevance_1_to_5) AS judgements,
  {", ".join(f"avg({n}) AS mean_{n}" for n in R.RATINGS)}, {", ".join(f"CAST(max({n}) - min({n}) AS INTEGER) AS spread_{n}" for n in R.RATINGS)},
  greatest({", ".join(SPREAD.values())}) > 1 AS disagreement FROM filled GROUP BY 1)"""
ORACLE["reviewer_merge"] = f"""WITH {NUMBERED}, {MERGED} SELECT review_id, judgements, {", ".join(f"round(mean_{n}, 6) AS mean_{n}" for n in R.RATINGS)},
  {", ".join(f"spread_{n}" for n in R.RATINGS)}, disagreement FROM merged"""
FIRST = R.RATINGS[0]
ORACLE["sheet_check"] = f"""WITH {NUMBERED}, b AS (SELECT review_id, {bucket('review_id', 9, 5)} AS b, {bucket('review_id', 1, 7)} = 0 AS skipped FROM named)
SELECT review_id, '{FIRST} missing' AS problem FROM b WHERE b = 0 AND NOT skipped
UNION ALL SELECT review_id, '{FIRST} not in 1-5' FROM b WHERE b = 1
UNION ALL SELECT review_id, 'row missing' FROM b WHERE b = 2
UNION ALL SELECT review_id || '-x', 'row not issued' FROM b WHERE b = 2"""
ORACLE["relevance_at_k"] = f"""WITH {NUMBERED}, {MERGED},
judged AS (SELECT n.number AS query_id, m.mean_overall_relevance_1_to_5 AS rating, n.tfidf_rank, n.ngram_rank, n.transformer_rank
  FROM named n JOIN merged m USING (review_id) WHERE m.mean_overall_relevance_1_to_5 IS NOT NULL),
long AS ({" UNION ALL ".join(f"SELECT query_id, rating, '{n}' AS system FROM judged WHERE {n}_rank <= 10" for n in NAMES)}),
per_query AS (SELECT query_id, system, avg(rating) AS relevance FROM long GROUP BY 1, 2),
placed AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC) AS place FROM per_query)
SELECT system, count(*) AS queries, round(avg(relevance), 6) AS relevance_at_k, count(*) FILTER (place = 1) AS wins FROM placed GROUP BY 1"""
