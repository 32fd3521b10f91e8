"""Queries over skills: what loads, copies, descriptions, routing, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import drift as D
from larkspur.operators import findings as FN
from larkspur.operators import resolution as R
from larkspur.operators import routing as RT
from larkspur.operators import similarity as S

from . import adapters as A
from .registry import flat, query

M = "WITH " + A.MARKED
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9](?:[a-z0-9''-]*[a-z0-9])?')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
GENERIC = "[" + ", ".join(f"'{w}'" for w in T.GENERIC_VOCAB) + "]"


def content(col: str) -> str:
    return f"list_filter({TOKENS.format(col)}, lambda t: NOT list_contains({STOP}, t))"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return R.mark_shadows(A.loads(spark, d), A.harnesses(spark))


@query(M + "SELECT harness, id, ord, path, shadowed_by FROM marked")
def resolve_shadows(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("harness", "id", "ord", "path", "shadowed_by")


EFFECTIVE = M + ", eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY harness, id ORDER BY ord, path) AS n FROM marked WHERE shadowed_by IS NULL) WHERE n = 1)"


@query(EFFECTIVE + "SELECT harness, id, name, ord FROM eff")
def resolve_effective(spark: SparkSession, d: str) -> DataFrame:
    return R.effective(_marked(spark, d)).select("harness", "id", "name", "ord")


@query("WITH " + A.LOADS + "SELECT id, CASE WHEN bool_or(scope = 'project') THEN 'project' ELSE 'user' END AS scope, false AS system FROM loads GROUP BY 1")
def resolve_scope(spark: SparkSession, d: str) -> DataFrame:
    return R.promote_scope(A.loads(spark, d))


@query(M + "SELECT 'name-shadow' AS check_id, 'warning' AS severity, least(id, shadowed_by) || ',' || greatest(id, shadowed_by) AS contributors, name || ',' || name AS contributor_names, harness AS harnesses, name || ' ' || path AS detail FROM marked WHERE shadowed_by IS NOT NULL")
def check_name_shadow(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.name_shadow(_marked(spark, d)))


@query(M + """SELECT 'double-load' AS check_id, 'error' AS severity, string_agg(id, ',' ORDER BY id) AS contributors, string_agg(name, ',' ORDER BY name) AS contributor_names, harness AS harnesses, CAST(count(*) AS VARCHAR) || ' copies' AS detail
FROM (SELECT DISTINCT harness, content_hash, id, name FROM marked WHERE kind = 'skill' AND shadowed_by IS NULL) GROUP BY harness, content_hash HAVING count(*) > 1""")
def check_double_load(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.double_load(_marked(spark, d)))


@query(M + """, own AS (SELECT DISTINCT id, content_hash, harness FROM marked WHERE shadowed_by IS NULL),
apart AS (SELECT DISTINCT a.content_hash FROM contributors a JOIN contributors b ON a.content_hash = b.content_hash AND a.id < b.id AND a.kind = 'skill' AND b.kind = 'skill'
  WHERE NOT EXISTS (SELECT 1 FROM own x JOIN own y ON x.harness = y.harness WHERE x.id = a.id AND y.id = b.id))
SELECT 'exact-duplicate' AS check_id, 'warning' AS severity, string_agg(id, ',' ORDER BY id) AS contributors, string_agg(name, ',' ORDER BY name) AS contributor_names, '' AS harnesses, CAST(count(*) AS VARCHAR) || ' copies' AS detail
FROM contributors WHERE kind = 'skill' AND content_hash IN (SELECT content_hash FROM apart) GROUP BY content_hash""")
def check_exact_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.exact_duplicate(A.contributors(spark, d), _marked(spark, d).where("kind = 'skill'")))


@query(M + """, g AS (SELECT name, count(DISTINCT content_hash) AS n, count(DISTINCT routing_text) AS r, string_agg(id, ',' ORDER BY id) AS ids, string_agg(name, ',') AS names FROM contributors WHERE is_skill_md GROUP BY name HAVING count(DISTINCT content_hash) > 1),
together AS (SELECT name FROM (SELECT DISTINCT harness, name, id FROM marked m WHERE id IN (SELECT id FROM contributors WHERE is_skill_md) AND NOT (harness = 'claude-code' AND plugin)) GROUP BY harness, name HAVING count(*) > 1)
SELECT 'diverged-copies' AS check_id, 'warning' AS severity, ids AS contributors, names AS contributor_names, '' AS harnesses, CAST(n AS VARCHAR) || ' contents, ' || CASE WHEN r = 1 THEN 'descriptions identical' ELSE 'descriptions differ' END AS detail FROM g WHERE name NOT IN (SELECT name FROM together)""")
def check_diverged_copies(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.diverged_copies(A.contributors(spark, d), _marked(spark, d)))


@query(EFFECTIVE + "SELECT 'budget-catalog-tokens' AS check_id, 'warning' AS severity, '' AS contributors, '' AS contributor_names, harness AS harnesses, CAST(CAST(sum(catalog_tokens) AS BIGINT) AS VARCHAR) AS detail FROM eff WHERE kind = 'skill' GROUP BY harness HAVING sum(catalog_tokens) > 600")
def check_budget_catalog(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.budget_catalog(R.effective(_marked(spark, d)), 600))


@query("WITH " + A.CONTRIBUTORS + "SELECT 'budget-body-tokens' AS check_id, 'warning' AS severity, id AS contributors, name AS contributor_names, '' AS harnesses, CAST(body_tokens AS VARCHAR) AS detail FROM contributors WHERE kind = 'skill' AND body_tokens > 1500")
def check_budget_body(spark: SparkSession, d: str) -> DataFrame:
    return flat(R.budget_body(A.contributors(spark, d), 1500))


@query(EFFECTIVE + "SELECT harness, count(*) AS contributors, CAST(sum(catalog_tokens) AS BIGINT) AS catalog_tokens FROM eff GROUP BY 1")
def list_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.list_totals(_marked(spark, d))


@query(EFFECTIVE + """SELECT harness, CAST(sum(CASE WHEN kind = 'skill' THEN catalog_tokens ELSE 0 END) AS BIGINT) AS skill_tokens, CAST(sum(CASE WHEN kind <> 'skill' THEN catalog_tokens ELSE 0 END) AS BIGINT) AS tool_tokens
FROM eff GROUP BY 1 HAVING tool_tokens > 0 ORDER BY skill_tokens + tool_tokens DESC, harness LIMIT 1""")
def list_context_bill(spark: SparkSession, d: str) -> DataFrame:
    marked = _marked(spark, d).withColumn("kind", F.when(F.col("kind") == "command", "mcp_tool").otherwise(F.col("kind")))
    return R.context_bill(marked)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


BYTES = "list_transform(range(1, 2 * strlen(s), 2), lambda i: CAST('0x' || substr(hex(encode(s)), i, 2) AS BIGINT))"
CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}), lambda c, b: xor(c >> 8, CAST({_crc_table()} AS BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


@query("WITH " + A.CONTRIBUTORS + f""", w AS (SELECT seq, list_filter(regexp_split_to_array(routing_text || chr(10) || body, '[\\s]+'), lambda x: x <> '') AS ws FROM contributors WHERE kind = 'skill'),
g AS (SELECT DISTINCT seq, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS s FROM w),
k AS (SELECT s, {CRC} AS code FROM (SELECT DISTINCT s FROM g)), sk AS (SELECT seq, list_sort(list_distinct(list(code)))[1:128] AS codes FROM g JOIN k USING (s) GROUP BY seq),
near AS (SELECT DISTINCT a.seq AS sa, b.seq AS sb FROM (SELECT seq, unnest(codes) AS c FROM sk) a JOIN (SELECT seq, unnest(codes) AS c FROM sk) b ON a.c = b.c AND a.seq < b.seq),
est AS (SELECT sa, sb, list_sort(list_distinct(list_concat(a.codes, b.codes)))[1:128] AS u, a.codes AS x, b.codes AS y FROM near JOIN sk a ON a.seq = sa JOIN sk b ON b.seq = sb),
e AS (SELECT sa, sb, len(list_intersect(list_intersect(u, x), y)) / len(u) AS estimate FROM est)
SELECT 'near-duplicate' AS check_id, 'warning' AS severity, p.id || ',' || q.id AS contributors, least(p.name, q.name) || ',' || greatest(p.name, q.name) AS contributor_names, '' AS harnesses, CAST(round(estimate, 6) AS VARCHAR) AS detail
FROM e JOIN contributors p ON p.seq = sa JOIN contributors q ON q.seq = sb WHERE estimate >= 0.85 AND p.content_hash <> q.content_hash""")
def check_near_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.near_duplicate(A.contributors(spark, d)))


@query()
def check_description_overlap(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.description_overlap(A.contributors(spark, d).where("kind = 'skill' and is_skill_md")))


@query("WITH " + A.CONTRIBUTORS + f""", t AS (SELECT id, {content('routing_text')} AS ts FROM contributors), g AS (SELECT id, unnest(CASE WHEN len(ts) >= 2 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE ts END) AS gram FROM t WHERE len(ts) > 0),
v AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM v GROUP BY 1)
SELECT a.id AS id_a, b.id AS id_b, round(least(sum((a.tf / na.norm) * (b.tf / nb.norm)), 1.0), 6) AS cosine FROM v a JOIN v b ON a.gram = b.gram AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY 1, 2 HAVING cosine >= 0.6""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_pairs(A.contributors(spark, d).select("id", "routing_text"), 0.6)


ACTIVE = " OR ".join([f"contains(lower(routing_text), '{p}')" for p in T.ACTIVATION_PATTERNS] + [f"len(list_intersect({TOKENS.format('routing_text')}, [{', '.join(repr(w) for w in T.ACTIVATION_TOKENS)}])) > 0"])


@query("WITH " + A.CONTRIBUTORS + f"SELECT 'missing-activation' AS check_id, 'warning' AS severity, string_agg(id, ',' ORDER BY id) AS contributors, string_agg(name, ',' ORDER BY name) AS contributor_names, '' AS harnesses, CAST(count(*) AS VARCHAR) AS detail FROM contributors WHERE kind = 'skill' AND trim(routing_text) <> '' AND NOT ({ACTIVE}) HAVING count(*) > 0")
def check_missing_activation(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.missing_activation(A.contributors(spark, d).where("kind = 'skill'")))


@query("WITH " + A.CONTRIBUTORS + f"SELECT 'generic-description' AS check_id, 'warning' AS severity, string_agg(id, ',' ORDER BY id) AS contributors, string_agg(name, ',' ORDER BY name) AS contributor_names, '' AS harnesses, CAST(count(*) AS VARCHAR) AS detail FROM contributors WHERE kind = 'skill' AND trim(routing_text) <> '' AND len(list_distinct(list_filter({content('routing_text')}, lambda t: NOT list_contains({GENERIC}, t)))) < 2 HAVING count(*) > 0")
def check_generic_description(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.generic_description(A.contributors(spark, d).where("kind = 'skill'")))


ORDER_ROWS = [(1, "a1", "one", "Always use tabs here.\nNever push code to main."), (2, "b2", "two", "never use the tabs anywhere"), (3, "c3", "three", "Always push code to remotes."), (4, "d4", "four", "always run")]


@query("SELECT * FROM " + A.sql_values([("opposing-imperatives", "warning", "a1,b2", "one,two", "", "use tabs"), ("opposing-imperatives", "warning", "a1,c3", "one,three", "", "push code")], "check_id, severity, contributors, contributor_names, harnesses, detail"))
def check_opposing_imperatives(spark: SparkSession, d: str) -> DataFrame:
    """The documents (which give no such orders) and a few skills that do."""
    seeds = A.values(spark, ORDER_ROWS, "seq bigint, id string, name string, body string")
    return flat(S.opposing_imperatives(A.contributors(spark, d).select((F.col("seq") + 10).alias("seq"), "id", "name", "body").unionByName(seeds)))


def _spec(spark: SparkSession, d: str) -> DataFrame:
    c = A.contributors(spark, d)
    return c.select("id", "name", F.when(F.col("seq") % 4 == 0, F.col("name")).otherwise("other").alias("folder"), (F.col("seq") % 10 != 0).alias("frontmatter_valid"), F.when(F.col("seq") % 6 == 0, " ").otherwise(F.col("text")).alias("description"), F.when(F.col("seq") % 16 == 0, '{"a": "x <b>"}').when(F.col("seq") % 8 == 0, '{"tags": ["ok", {"deep": ["y > z"]}]}').otherwise('{"a": "plain", "n": 1, "<key>": ["v", null]}').alias("frontmatter"), "content_hash")


SPEC = A.CONTRIBUTORS + ", s AS (SELECT id, name, CASE WHEN seq % 4 = 0 THEN name ELSE 'other' END AS folder, seq % 10 <> 0 AS ok, CASE WHEN seq % 6 = 0 THEN ' ' ELSE text END AS description, seq % 8 = 0 AS angle FROM contributors)"


@query("WITH " + SPEC + """, f AS (
  SELECT 'spec-invalid-frontmatter' AS check_id, 'error' AS severity, id, name, 'invalid' AS detail FROM s WHERE NOT ok
  UNION ALL SELECT 'spec-name-mismatch', 'error', id, name, folder FROM s WHERE ok AND name <> folder UNION ALL SELECT 'spec-missing-description', 'error', id, name, 'missing' FROM s WHERE ok AND trim(description, ' ') = ''
  UNION ALL SELECT 'spec-description-too-long', 'error', id, name, CAST(length(description) AS VARCHAR) FROM s WHERE ok AND length(description) > 1024 UNION ALL SELECT 'frontmatter-angle-brackets', 'warning', id, name, 'angle bracket' FROM s WHERE ok AND angle)
SELECT check_id, severity, id AS contributors, name AS contributor_names, '' AS harnesses, detail FROM f""")
def check_spec(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.front_matter_checks(_spec(spark, d)))


RANK = EFFECTIVE + ", " + A.QUERIES + f""", qt AS (SELECT query_id, {content('query')} AS ts FROM queries), ct AS (SELECT id, {content('routing_text')} AS ts FROM contributors WHERE kind <> 'command'),
grams AS (SELECT 1 AS k, 'q' AS side, CAST(query_id AS VARCHAR) AS id, unnest(ts) AS gram FROM qt UNION ALL SELECT 1, 't', id, unnest(ts) FROM ct
  UNION ALL SELECT 2, 'q', CAST(query_id AS VARCHAR), unnest(CASE WHEN len(ts) >= 2 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE ts END) FROM qt
  UNION ALL SELECT 2, 't', id, unnest(CASE WHEN len(ts) >= 2 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE ts END) FROM ct),
v AS (SELECT k, side, id, gram, count(*) AS tf FROM grams GROUP BY ALL), n AS (SELECT k, side, id, sqrt(sum(tf * tf)) AS norm FROM v GROUP BY ALL),
c AS (SELECT a.k, a.id AS q, b.id AS t, least(sum((a.tf / na.norm) * (b.tf / nb.norm)), 1.0) AS c FROM v a JOIN v b ON a.k = b.k AND a.gram = b.gram AND a.side = 'q' AND b.side = 't' JOIN n na ON na.k = a.k AND na.side = 'q' AND na.id = a.id JOIN n nb ON nb.k = b.k AND nb.side = 't' AND nb.id = b.id GROUP BY 1, 2, 3),
sc AS (SELECT CAST(q AS BIGINT) AS query_id, t AS id, round(sum(c * CASE k WHEN 1 THEN 0.7 ELSE 0.3 END), 6) AS score FROM c GROUP BY 1, 2),
rk AS (SELECT harness, query_id, eff.id, eff.name, score, row_number() OVER w AS place, lead(score) OVER w AS second FROM sc JOIN eff USING (id) WHERE score > 0 WINDOW w AS (PARTITION BY harness, query_id ORDER BY score DESC, eff.name, eff.id)),
ranked AS (SELECT r.harness, r.query_id, r.place, r.id, r.name, r.score, CASE WHEN b.score - b.second < 0.1 THEN 'contested' ELSE 'routes' END AS verdict FROM rk r JOIN rk b ON b.place = 1 AND b.harness = r.harness AND b.query_id = r.query_id WHERE r.place <= 5 AND b.score >= 0.1)
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return RT.rank(A.queries_view(spark, d), R.effective(_marked(spark, d)), A.contributors(spark, d))


@query(RANK + "SELECT * FROM ranked")
def route_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(RANK + """, h AS (SELECT query_id, verdict, harness, string_agg(CAST(place AS VARCHAR) || '|' || name || '|' || CAST(score AS VARCHAR), ';' ORDER BY place) AS r FROM ranked GROUP BY 1, 2, 3)
SELECT query_id, verdict, string_agg(harness, ',' ORDER BY harness) AS harnesses FROM h GROUP BY query_id, verdict, r""")
def route_groups(spark: SparkSession, d: str) -> DataFrame:
    return RT.group_rankings(_ranked(spark, d)).select("query_id", "verdict", F.array_join("harnesses", ",").alias("harnesses"))


@query(RANK + """, j AS (SELECT q.query_id, q.query, h.id AS harness, CASE WHEN r.verdict IS NULL THEN 'no match' WHEN q.expect IS NOT NULL AND r.name <> q.expect THEN 'wrong target' WHEN r.verdict = 'contested' THEN 'contested' END AS problem, coalesce(r.name, '') AS top
  FROM queries q CROSS JOIN harnesses h LEFT JOIN ranked r ON r.place = 1 AND r.harness = h.id AND r.query_id = q.query_id)
SELECT 'query-routing' AS check_id, 'warning' AS severity, '' AS contributors, top AS contributor_names, string_agg(harness, ',' ORDER BY harness) AS harnesses, problem AS detail FROM j WHERE problem IS NOT NULL GROUP BY query_id, query, problem, top""")
def check_query_routing(spark: SparkSession, d: str) -> DataFrame:
    return flat(RT.query_routing(A.queries_view(spark, d), _ranked(spark, d), A.harnesses(spark)))


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return A.contributors(spark, d).where("kind = 'skill'").select("seq", "id", "name", "content_hash", F.col("content_hash").alias("tree_hash"))


LOCK = A.CONTRIBUTORS + ", sk AS (SELECT * FROM contributors WHERE kind = 'skill'), last AS (SELECT name, arg_max(id, seq) AS id, arg_max(content_hash, seq) AS tree_hash FROM sk GROUP BY 1), lock AS (SELECT name, CASE WHEN min(seq) % 3 = 0 THEN NULL WHEN min(seq) % 3 = 1 THEN max_by(content_hash, seq) ELSE 'sha256:0' END AS expected FROM sk GROUP BY 1 UNION ALL SELECT 'gone', 'sha256:1')"


@query("WITH " + LOCK + """SELECT 'lockfile-drift' AS check_id, 'warning' AS severity, coalesce(id, '') AS contributors, lock.name AS contributor_names, '' AS harnesses, CASE WHEN id IS NULL THEN 'missing' ELSE 'changed' END AS detail
FROM lock LEFT JOIN last USING (name) WHERE id IS NULL OR (expected IS NOT NULL AND expected <> tree_hash)""")
def check_lockfile_drift(spark: SparkSession, d: str) -> DataFrame:
    s = _skills(spark, d)
    lock = s.groupBy("name").agg(F.min("seq").alias("k"), F.max_by("content_hash", "seq").alias("h")).select("name", F.when(F.col("k") % 3 == 0, None).when(F.col("k") % 3 == 1, F.col("h")).otherwise("sha256:0").alias("expected"))
    return flat(D.lockfile_drift(lock.unionByName(A.values(spark, [("gone", "sha256:1")], "name string, expected string")), s))


@query("SELECT 'lockfile-drift' AS check_id, 'warning' AS severity, '' AS contributors, '' AS contributor_names, '' AS harnesses, 'unverifiable' AS detail")
def check_lockfile_unverifiable(spark: SparkSession, d: str) -> DataFrame:
    s = _skills(spark, d)
    return flat(D.lockfile_drift(s.select("name").distinct().withColumn("expected", F.lit("sha256:0")), s))


@query("WITH " + A.CONTRIBUTORS + """, sk AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS n FROM contributors WHERE kind = 'skill'),
e AS (SELECT n AS name, 's-' || n AS selector, CASE WHEN min(seq) % 2 = 0 THEN min(content_hash) ELSE 'sha256:0' END AS h FROM sk GROUP BY n UNION ALL SELECT 'nobody', 's-nobody', 'x'),
c AS (SELECT selector, h, e.name, sk.id, sk.content_hash, row_number() OVER (PARTITION BY selector ORDER BY content_hash <> h, seq) AS r, count(sk.id) OVER (PARTITION BY selector) AS m FROM e LEFT JOIN sk ON sk.n = e.name)
SELECT selector, id, CASE WHEN id IS NULL THEN 'missing' WHEN content_hash = h THEN 'matches' ELSE 'changed' END AS state, CASE WHEN m > 1 AND content_hash <> h THEN 'several local skills share this name' END AS note FROM c WHERE r = 1""")
def drift_entries(spark: SparkSession, d: str) -> DataFrame:
    s = _skills(spark, d).withColumn("n", T.slug("name"))
    entries = s.groupBy(F.col("n").alias("name")).agg(F.min("seq").alias("k"), F.min("content_hash").alias("h")).select("name", F.concat(F.lit("s-"), "name").alias("selector"), F.when(F.col("k") % 2 == 0, F.col("h")).otherwise("sha256:0").alias("content_hash"))
    entries = entries.unionByName(A.values(spark, [("nobody", "s-nobody", "x")], "name string, selector string, content_hash string"))
    return D.classify_entries(entries, s, A.values(spark, [], "path string, loadout string, selector string"), "me/it")


@query("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS h FROM documents),
b AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved/' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS h FROM documents)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def drift_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents against all of them again, some moved and some changed."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    new = docs.select(F.concat(F.when(F.col("k") % 4 == 0, "moved/").otherwise(""), "path").alias("path"), F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return D.diff_files(docs, new)


@query("""WITH f AS (SELECT source, string_agg(sha256(coalesce(text, '')) || '  ' || CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR)) AS l FROM documents GROUP BY 1) SELECT source, 'sha256:' || sha256(l) AS manifest FROM f""")
def manifest_hashes(spark: SparkSession, d: str) -> DataFrame:
    file = F.struct(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return A.table(spark, d, "documents").groupBy("source").agg(T.manifest_hash(F.collect_list(file)).alias("manifest"))


@query("WITH " + A.CONTRIBUTORS + """, s AS (SELECT seq, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS selector FROM contributors), n AS (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY seq) AS k FROM s)
SELECT seq, selector, CASE WHEN k = 1 THEN selector ELSE selector || '-' || CAST(k AS VARCHAR) END AS "unique" FROM n""")
def unique_selectors(spark: SparkSession, d: str) -> DataFrame:
    """No name here ends in two numbers, so no suffixed one is ever taken."""
    return R.unique_selectors(A.contributors(spark, d).select("seq", T.slug("name").alias("selector")))


FOUND = EFFECTIVE + ", ack AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id FROM labels WHERE toxic = 1), f AS (SELECT id, content_hash FROM contributors WHERE kind = 'skill' AND body_tokens > 300)"


@query(FOUND + "SELECT id, content_hash IN (SELECT content_hash FROM f WHERE id IN (SELECT id FROM ack)) AS acknowledged FROM f")
def findings_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    found = R.budget_body(A.contributors(spark, d), 300).withColumn("id", F.col("contributors")[0])
    toxic = A.table(spark, d, "labels").where("toxic = 1").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id")).distinct()
    acks = found.join(toxic, "id", "left_semi").select("fingerprint")
    return FN.active(found, acks).select("id", F.lit(False).alias("acknowledged")).unionByName(FN.acknowledged(found, acks).select("id", F.lit(True).alias("acknowledged")))


@query(FOUND + "SELECT 'warning' AS severity, count(*) AS total, count(*) FILTER (content_hash NOT IN (SELECT content_hash FROM f WHERE id IN (SELECT id FROM ack))) AS unseen FROM f")
def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    found = R.budget_body(A.contributors(spark, d), 300).withColumn("id", F.col("contributors")[0])
    toxic = A.table(spark, d, "labels").where("toxic = 1").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id")).distinct()
    return FN.summary(found, found.join(toxic, "id", "left_semi").select("fingerprint"))
