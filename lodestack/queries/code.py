"""What the parser finds in the rendered corpus, static scores, payloads, and query ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embed, features, graph, ingest, parse
from ..operators.tables import cut
from ..plans import corpus, payload
from .graphs import B, edges_of, parsed, ranks
from .texts import INFORMATIVE, expanded_sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


CLASS = "'C' || replace(substr(path, 2), '.py', '')"


@query(f"""WITH {B},
cl AS (SELECT path, min(b0) FILTER (WHERE sect = 3) AS start_byte, max(b0 + strlen(txt)) FILTER (WHERE sect IN (3, 4)) - 1 AS end_byte, min(l0) FILTER (WHERE sect = 3) AS lineno, max(l0 + 1) FILTER (WHERE sect IN (3, 4)) AS end_lineno FROM pl GROUP BY path)
SELECT path, kind, name, qname, start_byte, end_byte, lineno, end_lineno FROM fn WHERE stays
UNION ALL SELECT path, 'class', {CLASS}, path || '::' || {CLASS}, start_byte, end_byte, lineno, end_lineno FROM cl""")
def symbols(spark, sf_dir):
    one = parse.symbols(parsed(spark, sf_dir))
    return one.select("path", "kind", "name", "qname", *(F.col(c).cast("bigint").alias(c) for c in ("start_byte", "end_byte", "lineno", "end_lineno")))


@query(f"WITH {B} SELECT path, name, path || '::' || name AS qname, l0 AS lineno FROM pl WHERE kind = 'def' UNION ALL SELECT path, {CLASS}, path || '::' || {CLASS}, l0 FROM pl WHERE kind = 'class'")
def top_level_symbols(spark, sf_dir):
    return parse.top_level(parsed(spark, sf_dir)).select("path", "name", "qname", F.col("lineno").cast("bigint").alias("lineno"))


@query(f"WITH {B} SELECT caller, callee_symbol, cnt FROM cs")
def calls_count(spark, sf_dir):
    return parse.call_sites(parsed(spark, sf_dir))


@query(f"WITH {B} SELECT DISTINCT path, name FROM pl WHERE kind = 'export'")
def exports(spark, sf_dir):
    return parse.exports(parsed(spark, sf_dir)).select("path", "name")


@query(f"WITH {B} SELECT path, name FROM pl WHERE kind = 'main'")
def main_calls(spark, sf_dir):
    return parse.main_calls(parsed(spark, sf_dir)).select("path", "name")


@query(f"WITH {B} SELECT qname, CAST(cc AS BIGINT) AS cc, CAST(end_lineno - lineno + 1 AS BIGINT) AS loc FROM fn WHERE stays")
def cc_loc(spark, sf_dir):
    return parse.symbols(parsed(spark, sf_dir), "function").select("qname", F.col("cc").cast("bigint").alias("cc"), F.col("loc").cast("bigint").alias("loc"))


_API = f"""{B}, ap AS (
  SELECT qname, least(0.5::DOUBLE, 0.2 * (CASE WHEN depth = 0 THEN 1 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM pl e WHERE e.kind = 'export' AND e.path = fn.path AND e.name = fn.name) THEN 1 ELSE 0 END
    + CASE WHEN EXISTS (SELECT 1 FROM pl e WHERE e.kind = 'main' AND e.path = fn.path AND e.name = fn.name) THEN 1 ELSE 0 END)) AS api FROM fn WHERE stays)"""


@query(f"WITH {_API} SELECT qname, floor(api * 1e6 + 0.5) / 1e6 AS api FROM ap")
def api_boost(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return features.api_boost(parse.symbols(p, "function"), parse.exports(p), parse.main_calls(p)).withColumn("api", T.rounded(F.col("api")))


@query(f"WITH {B} SELECT qname, CASE WHEN depth = 0 THEN name || '(a: ' || {CLASS} || ', b=1)' ELSE name || '(self, a: ' || {CLASS} || ')' END AS signature FROM fn WHERE stays")
def signatures(spark, sf_dir):
    return parse.symbols(parsed(spark, sf_dir), "function").select("qname", "signature")


@query(f"WITH {B} SELECT fn.qname, CASE WHEN fn.depth = 0 THEN s.s_name || '.' END AS docstring FROM fn JOIN supplier s ON s.s_suppkey = fn.k WHERE fn.stays")
def docstrings(spark, sf_dir):
    return parse.symbols(parsed(spark, sf_dir), "function").select("qname", "docstring")


@query(f"WITH {B} SELECT qname, CASE WHEN depth = 0 AND k % 2 = 1 THEN ['wrap'] ELSE [] END AS decorators FROM fn WHERE stays")
def decorators(spark, sf_dir):
    return parse.symbols(parsed(spark, sf_dir), "function").select("qname", "decorators")


@query(f"WITH {B} SELECT qname, depth = 1 AS is_wrapper, CASE WHEN depth = 1 THEN ['f_' || CAST(k % 17 AS VARCHAR)] ELSE [] END AS wrapper_targets FROM fn WHERE stays")
def wrappers(spark, sf_dir):
    # a function of the corpus has two statements at least, a method one call
    return parse.symbols(parsed(spark, sf_dir), "function").select("qname", "is_wrapper", "wrapper_targets")


@query("SELECT 'm' || CAST(n_nationkey AS VARCHAR) || '.py' AS path, l AS local, f AS full_name, TRUE AS top_level FROM nation, (VALUES ('os', 'os'), ('od', 'collections.OrderedDict')) v(l, f)")
def imports(spark, sf_dir):
    return parse.imports(parsed(spark, sf_dir)).select("path", "local", F.col("full").alias("full_name"), "top_level")


@query("SELECT 'm' || CAST(n_nationkey AS VARCHAR) || '.py' AS path, '__all__' AS name FROM nation")
def module_variables(spark, sf_dir):
    return parse.variables(parsed(spark, sf_dir)).select("path", "name")


@query(f"WITH {B} SELECT path || '::' || {CLASS} AS qname, 'Base' AS bases FROM pl WHERE kind = 'class'")
def class_bases(spark, sf_dir):
    return parse.symbols(parsed(spark, sf_dir), "class").select("qname", "bases")


@query(f"WITH {B} SELECT path, lineno, end_lineno, {CLASS} AS type_name FROM fd")
def ann_types(spark, sf_dir):
    return parse.annotations(parsed(spark, sf_dir)).select("path", F.col("lineno").cast("bigint").alias("lineno"), F.col("end_lineno").cast("bigint").alias("end_lineno"), "type_name")


# each definition's parameter annotation, each within the class (methods) and within its own definition
@query(f"""WITH {B}, cl AS (SELECT path, min(l0) FILTER (WHERE sect = 3) AS lo, max(l0 + 1) FILTER (WHERE sect IN (3, 4)) AS hi FROM pl GROUP BY path)
SELECT fn.qname, count(*) AS n FROM fn JOIN fd ON fd.path = fn.path AND fd.lineno >= fn.lineno AND fd.end_lineno <= fn.end_lineno WHERE fn.stays GROUP BY fn.qname
UNION ALL SELECT cl.path || '::' || {CLASS.replace('path', 'cl.path')}, count(*) FROM cl JOIN fd ON fd.path = cl.path AND fd.lineno >= lo AND fd.end_lineno <= hi GROUP BY cl.path""")
def range_containment(spark, sf_dir):
    p = parsed(spark, sf_dir)
    notes = parse.annotations(p).select("path", F.col("lineno").alias("a"), F.col("end_lineno").alias("b"))
    return parse.symbols(p).select("path", "qname", "lineno", "end_lineno").join(notes, "path").filter("a >= lineno AND b <= end_lineno").groupBy("qname").agg(F.count("*").alias("n"))


TK = f"""tk AS (
  SELECT qname, name AS token, 1 AS n FROM fn WHERE stays
  UNION ALL SELECT qname, 'a', 1 FROM fn WHERE stays
  UNION ALL SELECT qname, {CLASS}, 1 FROM fn WHERE stays
  UNION ALL SELECT qname, CASE WHEN depth = 0 THEN 'b' ELSE 'self' END, 1 FROM fn WHERE stays
  UNION ALL SELECT fn.qname, 'f_' || CAST(k % 17 AS VARCHAR), 1 FROM fn WHERE stays AND depth = 1
  UNION ALL SELECT fn.qname, 'a', 1 FROM fn WHERE stays AND depth = 1
  UNION ALL SELECT fn.qname, 'x', 1 FROM fn WHERE stays AND depth = 0
  UNION ALL SELECT fn.qname, unnest(['x', pl.name, 'a']), 1 FROM fn JOIN pl ON pl.path = fn.path AND pl.k = fn.k AND pl.kind = 'call' WHERE stays AND depth = 0
  UNION ALL SELECT qname, unnest(['a', 'b']), 1 FROM fn WHERE stays AND depth = 0 AND k % 3 = 1
  UNION ALL SELECT qname, unnest(['a', 'b', 'b', 'b']), 1 FROM fn WHERE stays AND depth = 0 AND k % 3 = 2)"""


@query(f"WITH {B}, {TK} SELECT qname, token, count(*) AS n FROM tk GROUP BY qname, token")
def identifiers(spark, sf_dir):
    return parse.identifier_rows(parsed(spark, sf_dir)).groupBy("qname", "token").agg(F.count("*").alias("n"))


@query(f"""WITH {B} SELECT path || '::' || name AS query_id, path || '::' || {CLASS} AS qname, CAST(1 AS INT) AS hop FROM fn WHERE stays AND depth = 0""")
def class_refs(spark, sf_dir):
    p = parsed(spark, sf_dir)
    functions = parse.symbols(p, "function").filter("depth = 0")
    return payload.class_closure(p, functions.select(F.col("qname").alias("query_id"), "qname")).select("query_id", "qname", "hop")


@query(f"""WITH {B}, h AS (SELECT path, '  class ' || {CLASS} || '(Base)' || coalesce(string_agg(chr(10) || '    def ' || pl.name || '(self, a: ' || {CLASS} || ')', '' ORDER BY k) FILTER (WHERE kind = 'method'), '') AS c,
  string_agg(chr(10) || '  def ' || pl.name || '(a: ' || {CLASS} || ', b=1)', '' ORDER BY k) FILTER (WHERE kind = 'def') AS f FROM pl GROUP BY path)
SELECT path, 'Docstring: Módulo of ' || n_name || '.' || chr(10) || 'Imports:' || chr(10) || '  import os' || chr(10) || '  from collections import OrderedDict as od' || chr(10) || 'Classes:' || chr(10) || c || coalesce(chr(10) || 'Functions:' || f, '') AS outline
FROM h JOIN nation ON 'm' || CAST(n_nationkey AS VARCHAR) || '.py' = path""")
def outline(spark, sf_dir):
    return parse.outlines(parsed(spark, sf_dir))


#: fe: a row a function with its features; ba: with its base score. Shapes are those of the corpus' few kinds of bodies.
BASE = f"""{_API}, {TK}, {ranks(10)},
inf AS (SELECT qname, token, count(*) AS n FROM tk WHERE {INFORMATIVE} GROUP BY qname, token),
idf AS (SELECT token, ln(((SELECT count(*) FROM fn WHERE stays) + 1.0) / (count(*) + 1)) + 1 AS idf FROM inf GROUP BY token),
tf AS (SELECT qname, sum(n * idf) / sum(n) AS tfidf FROM inf JOIN idf USING (token) GROUP BY qname),
nc AS (SELECT path, k, count(*) AS c FROM pl WHERE kind = 'call' GROUP BY path, k),
sh AS (
  SELECT qname, CASE WHEN depth = 1 THEN 7 ELSE [10, 15, 19][k % 3 + 1] + CASE WHEN c > 0 THEN 3 ELSE 0 END END AS pairs,
    CASE WHEN depth = 1 THEN 12 ELSE [12, 20, 27][k % 3 + 1] + 8 * coalesce(c, 0) END AS size FROM fn LEFT JOIN nc USING (path, k) WHERE stays),
fe AS (
  SELECT fn.qname, CAST(end_lineno - lineno + 1 AS BIGINT) AS loc, CAST(cc AS BIGINT) AS cc, pr.rank / max(pr.rank) OVER () AS pr, coalesce(tfidf, 0.0::DOUBLE) AS tfidf, least(1.0::DOUBLE, pairs / (log2(size + 1) + 5)) AS struct, api
  FROM fn JOIN sh USING (qname) JOIN ap USING (qname) JOIN pr ON pr.qname = fn.qname AND pr.it = 10 LEFT JOIN tf ON tf.qname = fn.qname WHERE stays),
ba AS (SELECT *, floor((0.25::DOUBLE * least(1, cc / 20.0::DOUBLE) + 0.15::DOUBLE * least(1, loc / 200.0::DOUBLE) + 0.25::DOUBLE * pr + 0.15::DOUBLE * least(1, tfidf / 2.0::DOUBLE) + 0.15::DOUBLE * struct + 0.05::DOUBLE * (2 * api)) * 1e4 + 0.5) / 1e4 AS base FROM fe)"""


@query(f"WITH RECURSIVE {BASE} SELECT qname, loc, cc, {', '.join(f'floor({c} * 1e9 + 0.5) / 1e9 AS {c}' for c in ('pr', 'tfidf', 'struct', 'api'))}, base FROM ba")
def base_score(spark, sf_dir):
    found = payload.static_scores(parsed(spark, sf_dir), fixed=10)
    return found.select("qname", *(F.col(c).cast("bigint").alias(c) for c in ("loc", "cc")), *(T.rounded(F.col(c), 9).alias(c) for c in ("pr", "tfidf", "struct", "api")), "base")


#: A query a nation; every fifth is empty.
ASKED = "CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE 'f_' || CAST(n_nationkey % 17 AS VARCHAR) || ' C' || CAST(n_nationkey AS VARCHAR) || ' m_10 train' END"


def asked(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 5 == 4, "").otherwise(F.concat(F.lit("f_"), (F.col("n_nationkey") % 17).cast("string"), F.lit(" C"), key, F.lit(" m_10 train")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("query"))


def bm25_sql(name: str, queries: str, docs: str) -> str:
    """name: query_id, key, raw BM25 of queries (query_id, t) against docs (key, t), t lists of tokens."""
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(t) AS term FROM ({queries})) GROUP BY ALL),
{name}_d AS (SELECT key, greatest(len(t), 1) AS dl, t FROM ({docs})),
{name}_p AS (SELECT key, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT key, dl, unnest(t) AS term FROM {name}_d) GROUP BY key, term),
{name}_c AS (SELECT count(*) AS nd, avg(dl) AS av FROM {name}_d), {name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT query_id, key, sum(times * ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS raw FROM {name}_p JOIN {name}_f USING (term) JOIN {name}_q USING (term), {name}_c GROUP BY query_id, key)"""


_IDENT_OF = "regexp_extract_all(lower({0}), '[A-Za-z_][A-Za-z0-9_]*')"
#: cd: the code of functions and classes as the parser cuts it.
CODE = f"""cd AS (
  SELECT fn.qname, fn.path, 1 AS sort, fn.start_byte, rtrim(coalesce(fx.code, substr(m.txt, 5)), chr(10)) AS code FROM fn LEFT JOIN fx ON fn.depth = 0 AND fx.path = fn.path AND fx.k = fn.k LEFT JOIN pl m ON fn.depth = 1 AND m.kind = 'method' AND m.path = fn.path AND m.k = fn.k WHERE fn.stays
  UNION ALL SELECT path || '::' || {CLASS}, path, 0, min(b0), rtrim(string_agg(txt, '' ORDER BY sect, k, sub), chr(10)) FROM pl WHERE sect IN (3, 4) GROUP BY path)"""


@query(f"""WITH RECURSIVE {BASE}, {CODE}, qs AS (SELECT n_nationkey AS query_id, {ASKED} AS query FROM nation),
{bm25_sql('bm', f"SELECT query_id, {_IDENT_OF.format('query')} AS t FROM qs", f"SELECT qname AS key, {_IDENT_OF.format("name || ' ' || qname || ' ' || path")} AS t FROM fn WHERE stays")},
sc AS (SELECT qs.query_id, ba.qname, CASE WHEN query = '' THEN base ELSE 0.5 * base + 0.5 * coalesce(raw / max(raw) OVER (PARTITION BY qs.query_id), 0) END AS score FROM qs CROSS JOIN ba LEFT JOIN bm ON bm.query_id = qs.query_id AND bm.key = ba.qname),
tp AS (SELECT query_id, qname, floor(score * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, qname) AS pos FROM sc QUALIFY pos <= 5),
cl AS (SELECT DISTINCT query_id, fn.path, fn.path || '::' || {CLASS.replace('path', 'fn.path')} AS cls FROM tp JOIN fn ON fn.qname = tp.qname AND stays),
co AS (
  SELECT query_id, string_agg('import os' || chr(10) || 'from collections import OrderedDict as od' || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY path) AS code
  FROM (SELECT query_id, path, string_agg(code, chr(10) || chr(10) ORDER BY sort, start_byte) AS t FROM (SELECT query_id, qname FROM tp UNION SELECT query_id, cls FROM cl) JOIN cd USING (qname) GROUP BY query_id, path) GROUP BY query_id),
cn AS (SELECT query_id, list(cls ORDER BY string_split(cls, '::')[-1], cls) AS classes FROM cl GROUP BY query_id)
SELECT tp.query_id, CAST(pos AS INT) AS pos, tp.qname, fn.name, fn.path, fn.lineno, fn.end_lineno, tp.score, CAST(count(*) OVER (PARTITION BY tp.query_id) AS BIGINT) AS total_functions, CAST(len(classes) AS BIGINT) AS total_classes, classes, code
FROM tp JOIN fn ON fn.qname = tp.qname AND fn.stays JOIN co ON co.query_id = tp.query_id JOIN cn ON cn.query_id = tp.query_id""")
def repo_payload(spark, sf_dir):
    """The payloads' JSON, read again: a row a node."""
    p = parsed(spark, sf_dir)
    found = payload.from_repo(p, asked(spark, sf_dir), top_k=5, depth=1, include_code=True, base=cut(payload.static_scores(p, fixed=10)))
    node = "struct<name:string,qname:string,path:string,lineno:bigint,end_lineno:bigint,score:double>"
    whole = found.select("query_id", F.from_json("payload", f"summary struct<total_functions:bigint,total_classes:bigint>, nodes array<{node}>, classes array<struct<qname:string>>, code string").alias("p"))
    return whole.select("query_id", F.posexplode("p.nodes").alias("i", "n"), "p.summary.*", F.transform("p.classes", lambda c: c["qname"]).alias("classes"), "p.code").select("query_id", (F.col("i") + 1).alias("pos"), "n.*", "total_functions", "total_classes", "classes", "code")


@query()
def file_payload(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return payload.from_files(cut(parse.parsed(files)), files, asked(spark, sf_dir))


@query()
def file_payload_semantic(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return payload.from_files(cut(parse.parsed(files)), files, asked(spark, sf_dir), encode=embed.ENCODERS["hash-64"], variables=True)


_SIGNATURE = f"CASE WHEN depth = 0 THEN name || '(a: ' || {CLASS} || ', b=1)' ELSE name || '(self, a: ' || {CLASS} || ')' END"


@query(f"""WITH RECURSIVE {BASE}, {CODE}, bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), qs AS (SELECT n_nationkey AS query_id, {ASKED} AS text FROM nation),
{expanded_sql("query_id", "qs")},
sg AS (SELECT fn.qname, fn.path, fn.name, fn.lineno, fn.end_lineno, {_SIGNATURE.replace('path', 'fn.path').replace('name ||', 'fn.name ||')} AS signature, CASE WHEN fn.depth = 0 THEN s_name || '.' END AS docstring FROM fn LEFT JOIN supplier ON s_suppkey = fn.k WHERE stays),
il AS (SELECT qname, list(lower(token)) AS ids FROM tk GROUP BY qname),
rd AS (SELECT sg.qname AS key, list_concat({_IDENT_OF.format("sg.name || ' ' || signature")}, ids, {_IDENT_OF.format('code')}[1:120]) AS t FROM sg JOIN il USING (qname) JOIN cd USING (qname)),
{bm25_sql('bm', "SELECT query_id, list(t) AS t FROM ex GROUP BY query_id", "SELECT key, t FROM rd")},
cs2 AS (SELECT qs.query_id, ba.qname, base, coalesce(floor(raw / max(raw) OVER (PARTITION BY qs.query_id) * 1e6 + 0.5) / 1e6, 0) AS score FROM qs CROSS JOIN ba LEFT JOIN bm ON bm.query_id = qs.query_id AND bm.key = ba.qname),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qname) - 1 AS lex FROM cs2),
wa AS (SELECT query_id, list_distinct(flatten(list(regexp_extract_all(t, '[a-z0-9_]+')))) AS want FROM ex GROUP BY query_id),
ca2 AS (
  SELECT lr.query_id, lr.qname, 0.5::DOUBLE * base + 0.5::DOUBLE * (1.0::DOUBLE / (61 + lex)) AS final, lex,
    coalesce(len(want), 0) = 0 OR len(list_filter(want, lambda t: contains(lower(lr.qname || ' ' || signature || coalesce(' ' || docstring, '')), t))) / len(want) >= 0.2 AS passes
  FROM lr JOIN sg USING (qname) LEFT JOIN wa ON wa.query_id = lr.query_id),
ps AS (SELECT *, row_number() OVER (PARTITION BY query_id, passes ORDER BY lex, qname) = 1 AND passes AS first, bool_or(passes) OVER (PARTITION BY query_id) AS any_pass FROM ca2),
sd AS (SELECT query_id, qname, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, final DESC, qname) AS pos FROM ps WHERE passes OR NOT any_pass QUALIFY pos <= 6),
nb AS (SELECT query_id, src, list(dst ORDER BY final DESC, dst) AS near FROM bo JOIN ca2 ON ca2.qname = dst GROUP BY query_id, src),
wk AS (
  SELECT query_id, list(qname ORDER BY pos) AS al, 1 AS p FROM sd GROUP BY query_id
  UNION ALL
  SELECT wk.query_id, list_concat(al, list_filter(coalesce(near, []), lambda x: NOT list_contains(al, x))[1:6 - len(al)]), p + 1 FROM wk LEFT JOIN nb ON nb.query_id = wk.query_id AND nb.src = al[p] WHERE p <= len(al)
),
pi AS (SELECT query_id, unnest(al) AS qname FROM wk WHERE p = len(al) + 1),
rk AS (SELECT pi.query_id, pi.qname, final, row_number() OVER (PARTITION BY pi.query_id ORDER BY final DESC, pi.qname) AS pos FROM pi JOIN ca2 ON ca2.query_id = pi.query_id AND ca2.qname = pi.qname),
cz AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS i FROM (SELECT DISTINCT query_id, path FROM rk JOIN sg USING (qname)) QUALIFY i <= 10),
cn AS (SELECT query_id, list({CLASS} ORDER BY {CLASS}) AS classes FROM cz GROUP BY query_id),
co AS (SELECT query_id, string_agg(code, chr(10) || chr(10) ORDER BY pos) AS code FROM (SELECT query_id, pos, code, sum(length(code)) OVER (PARTITION BY query_id ORDER BY pos) AS used FROM rk JOIN cd USING (qname)) WHERE used <= 1600 GROUP BY query_id)
SELECT rk.query_id, CAST(pos AS INT) AS pos, rk.qname, floor(final * 1e9 + 0.5) / 1e9 AS score, lineno, signature, docstring, classes, coalesce(code, '') AS code FROM rk JOIN sg USING (qname) JOIN cn ON cn.query_id = rk.query_id LEFT JOIN co ON co.query_id = rk.query_id""")
def hybrid_payload(spark, sf_dir):
    """The payloads' JSON, read again: a row a node."""
    p = parsed(spark, sf_dir)
    found = payload.from_hybrid(p, cut(payload.static_scores(p, fixed=10)), asked(spark, sf_dir), top_k=6, least=0.2, max_tokens=400)
    whole = found.select("query_id", F.from_json("payload", "nodes array<struct<qname:string,score:double,lineno:bigint,signature:string,docstring:string>>, classes array<struct<name:string>>, code string").alias("p"))
    one = whole.select("query_id", F.posexplode("p.nodes").alias("i", "n"), F.transform("p.classes", lambda c: c["name"]).alias("classes"), "p.code")
    return one.select("query_id", (F.col("i") + 1).alias("pos"), "n.qname", T.rounded(F.col("n.score"), 9).alias("score"), "n.lineno", "n.signature", "n.docstring", "classes", "code")


@query()
def hybrid_payload_semantic(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return payload.from_hybrid(p, cut(payload.static_scores(p, fixed=10)), asked(spark, sf_dir), top_k=6, least=0.2, max_tokens=400, encode=embed.ENCODERS["hash-64"])


_FINAL = "(((end_lineno - lineno + 1) * 7 + length(qname) + query_id) % 13) / 13.0"


@query(f"""WITH {B}, {CODE}, bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
qs AS (SELECT n_nationkey AS query_id, regexp_extract_all(lower({ASKED}), '\\w+') AS w FROM nation),
sc AS (SELECT query_id, qname, {_FINAL} AS final FROM fn, qs WHERE stays),
se AS (
  SELECT sc.query_id, sc.qname, final FROM sc JOIN cd USING (qname) JOIN qs USING (query_id) WHERE len(w) = 0 OR len(list_filter(w, lambda t: contains(lower(code), t))) / len(w) >= 0.5
  QUALIFY row_number() OVER (PARTITION BY sc.query_id ORDER BY final DESC, sc.qname) <= 6),
wi AS (SELECT query_id, qname FROM se UNION SELECT query_id, dst FROM se JOIN bo ON src = qname)
SELECT query_id, qname, floor(final * 1e9 + 0.5) / 1e9 AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, qname) AS INT) AS pos FROM wi JOIN sc USING (query_id, qname) QUALIFY pos <= 6""")
def seeds_expanded(spark, sf_dir):
    p = parsed(spark, sf_dir)
    functions, edges = edges_of(p)
    queries = asked(spark, sf_dir)
    final = F.pmod(F.col("loc") * 7 + F.length("qname") + F.col("query_id"), F.lit(13)) / 13.0
    scores = functions.select("qname", "loc").crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", "qname", final.alias("final"))
    _, wide = payload.seeds_and_expanded(scores, functions, queries, graph.both_ways(edges), 6, 1, 0.5)
    return wide.select("query_id", "qname", T.rounded(F.col("final"), 9).alias("final"), "pos")


# a trace, a diff line and a sentence made of each event
@query("""WITH e AS (SELECT event_id, event_type AS t, event_type || '_' || CAST(user_id AS VARCHAR) AS f, user_id FROM events)
SELECT event_id, [f || '.py', 'a/' || t || '.py'] AS diffs_and_frames, [t] AS func, CAST(user_id AS INT) AS line, ['Error', 'File'] AS classes, ['+++', 'File', 'raise'] AS nodeids,
  list_sort(list_distinct(['+++', 'File', 'raise', 'a/' || t || '.py', f || '.py'])) AS files, list_sort(list_distinct(['a', 'b', 'in', 'line', 'py', 'raise', t, f])) AS functions FROM e""")
def ingest_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.format_string('File "%s_%s.py", line %s, in %s\n+++ b/a/%s.py\nraise Error', "event_type", "user_id", "user_id", "event_type", "event_type")
    raw = F.to_json(F.struct(text.alias("trace"), F.col("event_id").alias("other")))
    s = ingest.signals(e.select(F.col("event_id").alias("query_id"), raw.alias("raw")))
    hit = F.col("stack_hits")[0]
    return s.select(F.col("query_id").alias("event_id"), F.array(hit["file"], F.col("diffs")[0]).alias("diffs_and_frames"), F.array(hit["func"]).alias("func"), hit["line"].alias("line"), "classes", "nodeids", "files", "functions")
