"""The engine's queries over the driver's tables, each with the SQL that says the same.

Three kinds: operators on data they are made for (texts), operators on relational data of the same shape, and, in `code_queries`,
code metrics on sources made from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge import code_queries
from codegauge.functions import curves, text
from codegauge.operators import duplication, graph, secrets, security, smells
from codegauge.plans import advice, gates, score, sinks
from codegauge.sources import dependencies as deps_
from codegauge.sources import files

#: Frequent words of the texts, in the place of frequent names of code.
WORDS = ["de", "on", "la", "en"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("codebase"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"))


def duplication_across(spark, sf):
    d = duplication.across_files(_texts(spark, sf), WORDS)
    return d.select("codebase", "n_files", F.col("n_blocks").cast("long"), F.col("n_duplicated").cast("long"), _r("raw").alias("raw"), _r(curves.normalise("Code Duplication", F.col("raw"))).alias("score"))


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_CURVE_DUP = (
    "CASE WHEN raw >= 50 THEN 0 WHEN raw <= 0 THEN 1 WHEN raw <= 5 THEN 1 - raw / 50 WHEN raw <= 15 THEN 0.9 - (raw - 5) / 10 * 0.4 "
    "WHEN raw <= 30 THEN 0.5 - (raw - 15) / 15 * 0.4 ELSE greatest(0, 0.1 - (raw - 30) / 20 * 0.1) END"
)

DUPLICATION_SQL = rf"""
WITH l AS (
  SELECT lang, doc_id, i, regexp_replace(regexp_replace(regexp_replace({_TRIM.format('x')}, '\s+', '', 'g'),
         '\b(calculate|compute|get|set|find)\w*\b', 'FUNC', 'g'), '\b({"|".join(WORDS)})\b', 'VAR', 'g') AS n
  FROM (SELECT lang, doc_id, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM documents)
  WHERE {_TRIM.format('x')} <> '' AND NOT starts_with({_TRIM.format('x')}, '//')),
w AS (
  SELECT lang, doc_id, n AS a, lead(n, 1) OVER o AS b, lead(n, 2) OVER o AS c, lead(n, 3) OVER o AS d, lead(n, 4) OVER o AS e
  FROM l WHERE n <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (
  SELECT lang, doc_id, a || chr(10) || b || chr(10) || c AS t FROM w WHERE c IS NOT NULL
  UNION ALL SELECT lang, doc_id, a || chr(10) || b || chr(10) || c || chr(10) || d FROM w WHERE d IS NOT NULL
  UNION ALL SELECT lang, doc_id, a || chr(10) || b || chr(10) || c || chr(10) || d || chr(10) || e FROM w WHERE e IS NOT NULL),
h AS (SELECT lang, sha256(t) AS h, count(DISTINCT doc_id) > 1 AS dup FROM b WHERE length(t) > 20 GROUP BY ALL),
s AS (SELECT lang, count(*) AS n_blocks, count(*) FILTER (dup) AS n_duplicated FROM h GROUP BY lang),
f AS (SELECT lang, count(*) AS n_files FROM documents GROUP BY lang),
r AS (
  SELECT f.lang AS codebase, n_files, coalesce(n_blocks, 0)::BIGINT AS n_blocks, coalesce(n_duplicated, 0)::BIGINT AS n_duplicated,
         CASE WHEN n_files >= 2 THEN least(50.0, coalesce(n_duplicated / n_blocks, 0) * 100 * CASE WHEN n_files > 10 THEN 1.5 ELSE 1 END) ELSE 0 END::DOUBLE AS raw
  FROM f LEFT JOIN s USING (lang))
SELECT codebase, n_files, n_blocks, n_duplicated, round(raw, 6) AS raw, round({_CURVE_DUP}, 6)::DOUBLE AS score FROM r
"""


def duplication_within(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("source"))
    return duplication.within_files(d, "doc_id").select("doc_id", "n_lines", _r("raw").alias("raw"))


WITHIN_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, regexp_replace(regexp_replace({_TRIM.format('x')}, '\b[a-zA-Z_][a-zA-Z0-9_]*\.(age|name|email)\b', 'VAR.ATTR', 'g'), '\b[a-zA-Z_][a-zA-Z0-9_]*\s*=', 'VAR =', 'g') AS n
  FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM documents)
  WHERE {_TRIM.format('x')} <> ''),
w AS (
  SELECT doc_id, n AS a, lead(n, 1) OVER o AS b, lead(n, 2) OVER o AS c, lead(n, 3) OVER o AS d, lead(n, 4) OVER o AS e, count(*) OVER (PARTITION BY doc_id) AS m
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT doc_id, m, 3 AS k, a || chr(10) || b || chr(10) || c AS t FROM w WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, m, 4, a || chr(10) || b || chr(10) || c || chr(10) || d FROM w WHERE d IS NOT NULL
  UNION ALL SELECT doc_id, m, 5, a || chr(10) || b || chr(10) || c || chr(10) || d || chr(10) || e FROM w WHERE e IS NOT NULL),
g AS (SELECT doc_id, k, count(*) AS c FROM k WHERE m >= 10 AND k < least(6, m // 2) GROUP BY doc_id, m, k, t),
s AS (SELECT doc_id, sum(k * c * (c - 1)) AS dup FROM g GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, round(CASE WHEN n >= 10 THEN least(n, coalesce(dup, 0)) / n * 100 ELSE 0 END, 6)::DOUBLE AS raw
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def line_counts(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.source_lines(c).cast("long").alias("source_lines"), text.code_lines(c).cast("long").alias("code_lines"), text.statement_lines(c).cast("long").alias("statement_lines"))


LINES_SQL = rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS source_lines, len(list_filter(l, lambda x: NOT starts_with(x, '//')))::BIGINT AS code_lines,
       len(list_filter(l, lambda x: NOT starts_with(x, '//') AND NOT starts_with(x, '*')))::BIGINT AS statement_lines FROM l
"""


def secrets_exposure(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("codebase"), F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("lang"), F.col("text").alias("source"))
    e = secrets.exposure(d)
    return e.select("codebase", F.col("raw").cast("long").alias("n_secrets"), _r(curves.normalise("Secrets Exposure", F.col("raw"))).alias("score"))


SECRETS_SQL = """
WITH f AS (
  SELECT source, unnest(
    regexp_extract_all(text, '(AKIA[0-9A-Z]{16})', 1) || regexp_extract_all(text, '(gh[pousr]_[A-Za-z0-9]{36,})', 1)
    || regexp_extract_all(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1) || regexp_extract_all(text, '(eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,})', 1)
    || list_filter(regexp_extract_all(text, '(?i:key|token|secret|passw(?:or)?d)[A-Za-z0-9_]*["'']?[ \\t]*[:=][ \\t]*["'']([^"''\\s]{12,})["'']', 1), lambda v: list_aggr(string_split(v, ''), 'entropy') >= 3)) AS s
  FROM documents),
n AS (SELECT source, count(*) FILTER (NOT regexp_matches(lower(s), 'abcdefghijkl|0123456789')) AS n FROM f GROUP BY source)
SELECT d.source AS codebase, coalesce(n, 0)::BIGINT AS n_secrets, round(exp(-coalesce(n, 0) / 5.0), 6) AS score FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN n USING (source)
"""


def path_predicates(spark, sf):
    p = F.regexp_replace("url", r"\?.*$", "")
    return table(spark, sf, "pages").select("page_id", files.is_excluded(p).alias("excluded"), files.is_excluded(p, "kotlin").alias("excluded_kotlin"), files.is_test(p).alias("test"), files.in_test_folder(p).alias("test_folder"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _excluded_sql(lang: str) -> str:
    return f"len(list_filter(p, lambda x: NOT list_contains(['', '.', '..'], x) AND (list_contains({_list(files.EXCLUDED[lang])}, x) OR starts_with(x, '.')))) > 0"


PATHS_SQL = rf"""
WITH u AS (SELECT page_id, regexp_replace(url, '\?.*$', '') AS u FROM pages), q AS (SELECT *, string_split(u, '/') AS p FROM u)
SELECT page_id, {_excluded_sql('java')} AS excluded, {_excluded_sql('kotlin')} AS excluded_kotlin,
       contains(lower(regexp_replace(p[-1], '(.)\.[^.]*$', '\1')), 'test') OR contains(regexp_replace(u, '[^/]*$', ''), 'tests') AS test,
       len(list_filter(p[1:len(p) - 1], lambda x: starts_with(x, 'test'))) > 0 AS test_folder FROM q
"""

#: The curves once more, in SQL over a column v.
_SQL_CURVES = {
    "Cyclomatic Complexity": "CASE WHEN v <= 1 THEN 1 WHEN v >= 25 THEN 0 ELSE exp(-0.1 * (v - 1)) END",
    "Cognitive Complexity": "CASE WHEN v <= 5 THEN 1 - v / 50 WHEN v <= 10 THEN 0.9 - (v - 5) / 25 WHEN v <= 15 THEN 0.7 - (v - 10) / 16.67 WHEN v <= 25 THEN 0.4 - (v - 15) / 50 ELSE greatest(0, 0.2 - (v - 25) / 125) END",
    "Halstead Volume": "CASE WHEN v <= 0 THEN 1 WHEN v >= 25000 THEN 0 ELSE 1 - tanh(v / 12500) END",
    "Maintainability Index": "CASE WHEN v <= 0 THEN 0 WHEN v >= 70 THEN 0.85 + 0.15 * least(1, (v - 70) / 30) WHEN v >= 50 THEN 0.70 + 0.15 * (v - 50) / 20 WHEN v >= 30 THEN 0.50 + 0.20 * (v - 30) / 20 WHEN v >= 20 THEN 0.25 + 0.25 * (v - 20) / 10 ELSE 0.25 * v / 20 END",
    "Code Duplication": _CURVE_DUP.replace("raw", "v"),
    "Documentation Coverage": "CASE WHEN v <= 0 THEN 0 WHEN v >= 100 THEN 1 ELSE v / 100 END",
    "security": "exp(-v / 0.03)",
    "Code Smell Density": "CASE WHEN v <= 0 THEN 1 WHEN v >= 50 THEN 0 WHEN v <= 5 THEN 1 - v / 5 * 0.2 WHEN v <= 10 THEN 0.8 - (v - 5) / 5 * 0.2 WHEN v <= 20 THEN 0.6 - (v - 10) / 10 * 0.3 ELSE greatest(0, 0.3 - (v - 20) / 30 * 0.3) END",
    "rfc": "CASE WHEN v <= 15 THEN 1 WHEN v <= 50 THEN 1 - 0.25 * (v - 15) / 35 WHEN v <= 100 THEN 0.75 - 0.40 * (v - 50) / 50 WHEN v <= 120 THEN 0.35 - 0.35 * (v - 100) / 20 ELSE 0 END",
    "dit": "CASE WHEN v <= 3 THEN 1 WHEN v <= 6 THEN 1 - 0.30 * (v - 3) / 3 WHEN v <= 10 THEN 0.70 - 0.30 * (v - 6) / 4 ELSE greatest(0, 0.40 - 0.40 * (v - 10) / 5) END",
    "mhf": "v",
    "Coupling Between Objects": "CASE WHEN v <= 0 THEN 1 WHEN v <= 9 THEN 1 - v / 9 * 0.3 WHEN v <= 20 THEN 0.7 - (v - 9) / 11 * 0.3 ELSE greatest(0, 0.4 - (v - 20) / 20 * 0.4) END",
    "Lack of Cohesion of Methods": "CASE WHEN v <= 1 THEN 1 WHEN v <= 3 THEN 1 - (v - 1) / 2 * 0.3 WHEN v <= 6 THEN 0.7 - (v - 3) / 3 * 0.3 ELSE greatest(0, 0.4 - (v - 6) / 6 * 0.4) END",
    "Dependency Security": "exp(-v / 5)",
    "Secrets Exposure": "exp(-v / 5)",
}


def normalisation_curves(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", F.explode(F.array((F.col("p_size") / 10).alias("v"), F.col("p_size").cast("double"), F.col("p_retailprice") * 10)).alias("v"))
    return v.select("p_partkey", "v", *(_r(curves.normalise(m, F.col("v")), 9).alias(m.lower().replace(" ", "_")) for m in curves.CURVES))


CURVES_SQL = "WITH t AS (SELECT p_partkey, unnest([p_size / 10.0, p_size::DOUBLE, p_retailprice * 10])::DOUBLE AS v FROM part) SELECT p_partkey, v, " + ", ".join(f"round(greatest(0, least(1, {c})), 9)::DOUBLE AS {m.lower().replace(' ', '_')}" for m, c in _SQL_CURVES.items()) + " FROM t"


def _line_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("codebase"), F.col("l_returnflag").alias("metric"), (F.col("l_discount") * 10 - F.col("l_tax")).alias("score"))


def geometric_mean_score(spark, sf):
    d = score.geometric_mean(_line_scores(spark, sf), "codebase")
    s = F.col(score.SCORE)
    return d.select("codebase", _r(s).alias("quality_score"), score.rating(s).alias("rating"), score.level(s).alias("level"), score.color(s).alias("color"), score.marker(s).alias("marker"), score.importance(s).alias("importance"))


_LADDERS = """CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Needs Work' ELSE 'Poor' END AS rating,
  CASE WHEN s >= 0.8 THEN 'none' WHEN s >= 0.6 THEN 'note' WHEN s >= 0.4 THEN 'warning' ELSE 'error' END AS level,
  CASE WHEN s >= 0.8 THEN 'brightgreen' WHEN s >= 0.6 THEN 'green' WHEN s >= 0.4 THEN 'yellow' ELSE 'red' END AS color,
  CASE WHEN s >= 0.9 THEN '[trophy]' WHEN s >= 0.8 THEN '[star]' WHEN s >= 0.7 THEN '[ok]' WHEN s >= 0.6 THEN '[warn]' ELSE '[fail]' END AS marker,
  CASE WHEN s <= 0.3 THEN 'CRITICAL' WHEN s <= 0.6 THEN 'WARNING' WHEN s >= 0.8 THEN 'GOOD' ELSE 'FAIR' END AS importance"""
_MEAN = "least(1, greatest(0, exp(avg(ln(greatest(l_discount * 10 - l_tax, 0.1))))))"
GEOMEAN_SQL = f"WITH t AS (SELECT l_suppkey::VARCHAR AS codebase, {_MEAN} AS s FROM lineitem GROUP BY 1) SELECT codebase, round(s, 6) AS quality_score, {_LADDERS} FROM t"


def mixed_scores(spark, sf):
    """Two 'languages' (line statuses) of each supplier's metrics (return flags), averaged."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("score"))
    rows = li.select(F.col("l_suppkey").cast("string").alias("codebase"), F.lit(0).alias("ordinal"), F.col("l_returnflag").alias("metric"), F.lit(0.0).alias("raw"), "score", F.lit(0.0).alias("weighted"), F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("error"))
    return score.mixed(rows).select("codebase", "metric", _r("score").alias("score"))


MIXED_SQL = "WITH t AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS s FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus) SELECT l_suppkey::VARCHAR AS codebase, l_returnflag AS metric, round(avg(s), 6) AS score FROM t GROUP BY ALL"
_GATES = {"overall": {score.SCORE: 0.3, "other": 0.9}, "metrics": {"A": 0.5, "N": 0.4, "missing": 1.0}}


def quality_gates(spark, sf):
    """Means are those of decimals, so that one that just meets its threshold doesn't fail by roundings in the order of its rows."""
    rows = _line_scores(spark, sf)
    exact = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("codebase"), F.col("l_returnflag").alias("metric"), *(F.col(c).try_cast("decimal(28,18)").alias(c) for c in ("l_discount", "l_tax")), (F.col("l_discount") * 10 - F.col("l_tax")).alias("score"))
    exact = exact.withColumn("exact", F.col("l_discount") * 10 - F.col("l_tax"))
    mean = F.when(F.count("exact") == F.count("score"), (F.try_sum("exact") / F.nullif(F.count("exact"), F.lit(0))).cast("double"))  # null where a score isn't finite
    per = exact.groupBy("codebase", "metric").agg(F.coalesce(mean, F.avg("score")).alias("score"))
    v = gates.verdicts(gates.evaluate(per, score.geometric_mean(rows, "codebase"), _GATES))
    return v.select("codebase", "passed", F.col("n_passed").cast("long"), F.col("n_failed").cast("long"))


GATES_SQL = f"""
WITH o AS (SELECT l_suppkey::VARCHAR AS codebase, {_MEAN} >= 0.3 AS passed FROM lineitem GROUP BY 1),
m AS (SELECT l_suppkey::VARCHAR AS codebase, avg(l_discount * 10 - l_tax) >= CASE l_returnflag WHEN 'A' THEN 0.5 ELSE 0.4 END AS passed FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, l_returnflag),
e AS (SELECT * FROM o UNION ALL SELECT * FROM m)
SELECT codebase, bool_and(passed) AS passed, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed FROM e GROUP BY codebase
"""


def hierarchy_depth(spark, sf):
    """Depth of regions, nations, customers and suppliers, whose region's parent isn't known."""
    r, n, c, s = (table(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))

    def link(df, name, parent):
        return df.select(F.lit("all").alias("codebase"), name.alias("name"), parent.alias("parent"))

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = link(r, key("r", "r_regionkey"), F.lit("world")).unionByName(link(n, key("n", "n_nationkey"), key("r", "n_regionkey")))
    links = links.unionByName(link(c, key("c", "c_custkey"), key("n", "c_nationkey"))).unionByName(link(s, key("s", "s_suppkey"), key("n", "s_nationkey")))
    return graph.depths(links).select("name", F.col("depth").cast("long"))


DEPTH_SQL = """
WITH RECURSIVE l AS (
  SELECT 'r' || r_regionkey AS name, 'world' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
t AS (SELECT name, parent AS cur, 0 AS d FROM l UNION ALL SELECT t.name, l.parent, d + 1 FROM t LEFT JOIN l ON l.name = t.cur WHERE t.cur IS NOT NULL)
SELECT name, max(d)::BIGINT AS depth FROM t GROUP BY name
"""


def cohesion_of_orders(spark, sf):
    """Components of an order's lines that share a quantity, or a status and flag with a discount."""
    li = table(spark, sf, "lineitem")
    field = F.explode(F.array(F.concat(F.lit("q"), F.col("l_quantity").cast("int")), F.concat("l_returnflag", "l_linestatus", F.round(F.col("l_discount") * 100).cast("int").cast("string"))))
    return graph.cohesion(li.select("l_orderkey", F.col("l_linenumber").alias("method"), field.alias("field")), "l_orderkey")


COHESION_SQL = """
WITH RECURSIVE f AS (
  SELECT l_orderkey AS o, l_linenumber AS m, unnest(['q' || l_quantity::INT, l_returnflag || l_linestatus || round(l_discount * 100)::INT]) AS f FROM lineitem),
e AS (SELECT DISTINCT a.o, a.m, b.m AS n FROM f a JOIN f b ON a.o = b.o AND a.f = b.f),
t AS (SELECT o, m, n FROM e UNION SELECT t.o, t.m, e.n FROM t JOIN e ON t.o = e.o AND t.n = e.m),
c AS (SELECT o, m, min(n) AS c FROM t GROUP BY o, m),
s AS (SELECT o, count(*) FILTER (m <> n) AS links FROM e GROUP BY o)
SELECT o AS l_orderkey, CASE WHEN count(*) <= 1 THEN 0 WHEN max(links) = 0 THEN 1 ELSE count(DISTINCT c) END::BIGINT AS lcom FROM c JOIN s USING (o) GROUP BY o
"""


def finding_density(spark, sf):
    """Events as findings: scores by kind of event, for each thousand events of a user."""
    e = table(spark, sf, "events")
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type").isin("signup", "purchase"), "MEDIUM").otherwise("LOW")
    confidence = F.when(F.col("value") > 20, "HIGH").when(F.col("value") > 5, "MEDIUM").otherwise("LOW")
    cwe = F.when(F.col("event_id") % 3 == 0, "CWE-89").otherwise("CWE-330")
    return e.groupBy("user_id").agg(_r(F.sum(security.score(severity, confidence, cwe)) / F.count(F.lit(1))).alias("raw"))


FINDINGS_SQL = """
WITH e AS (
  SELECT user_id, event_id % 3 = 0 AS boost, CASE WHEN value > 20 THEN 1.0 WHEN value > 5 THEN 0.85 ELSE 0.6 END::DOUBLE AS f,
         CASE WHEN event_type = 'error' THEN [8.0, 4.0, 8.9] WHEN event_type IN ('signup', 'purchase') THEN [5.5, 2.0, 6.9] ELSE [2.0, 0.1, 3.9] END::DOUBLE[] AS b FROM events),
s AS (SELECT user_id, boost, greatest(b[2], least(b[3], b[1] * f)) AS s FROM e)
SELECT user_id, round(sum(CASE WHEN boost THEN least(10, s * 1.2) ELSE s END) / count(*), 6) AS raw FROM s GROUP BY user_id
"""


def smell_counts(spark, sf):
    """Order lines as smells: of each (flag, order) the most severe, then counts and weights by category."""
    li = table(spark, sf, "lineitem")
    severity = F.when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 20, "MEDIUM").otherwise("LOW")
    category = F.when(F.col("l_linestatus") == "F", "DESIGN").otherwise("TEST")
    rows = li.select(
        F.lit("all").alias("codebase"), F.col("l_returnflag").alias("id"), F.lit("").alias("name"), category.alias("category"), severity.alias("severity"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_linestatus").alias("location"), F.format_string("t%d", "l_linenumber").alias("tool"), F.lit("").alias("description"),
    )
    return smells.by_category(smells.dedupe(rows)).select("category", "n", "weighted")


SMELLS_SQL = """
WITH s AS (SELECT l_returnflag, l_orderkey, l_linestatus, max(CASE WHEN l_quantity > 40 THEN 3.0 WHEN l_quantity > 20 THEN 2.0 ELSE 1.0 END) AS w FROM lineitem GROUP BY 1, 2, 3)
SELECT CASE WHEN l_linestatus = 'F' THEN 'DESIGN' ELSE 'TEST' END AS category, count(*) AS n, sum(w)::DOUBLE AS weighted FROM s GROUP BY 1
"""


def severity_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("severity", F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "HIGH").when(F.col("event_type") == "view", "Medium").otherwise("info"))
    return security.severity_counts(e, "user_id")


SEVERITY_SQL = "SELECT user_id, count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'signup') AS high, count(*) FILTER (event_type = 'view') AS medium, count(*) FILTER (event_type IN ('click', 'purchase')) AS low FROM events GROUP BY 1"


def top_issues(spark, sf):
    """The ten most severe events of each user: the report's limit."""
    e = table(spark, sf, "events")
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "signup", "HIGH").when(F.col("event_type") == "view", "MEDIUM").otherwise("LOW")
    rows = e.select(F.col("user_id").alias("codebase"), F.lit("p").alias("path"), F.col("event_id").alias("line"), F.col("event_type").alias("test_id"), severity.alias("severity"))
    return advice.top_issues(rows).select("codebase", "line", "severity", F.col("rank").cast("long"))


TOP_SQL = """
WITH e AS (SELECT user_id AS codebase, event_id AS line, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY codebase ORDER BY k, line) AS rank FROM e)
SELECT codebase, line, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][k + 1] AS severity, rank FROM r WHERE rank <= 10
"""


def _manifests(spark, sf):
    p = table(spark, sf, "part")
    gradle = F.format_string("dependencies {\n  implementation(\"org.b%d:part-%d:1.%d\")\n  testImplementation 'org.t:tool:%d'\n}", F.col("p_size"), F.col("p_partkey"), "p_size", "p_size")
    pom = F.format_string(
        "<project xmlns=\"http://maven.apache.org/POM/4.0.0\"><dependencies><dependency><groupId>org.b%d</groupId><artifactId>part-%d</artifactId><version>1.%d</version></dependency>"
        "<dependency><groupId>org.x</groupId><artifactId>y</artifactId><version>${v}</version></dependency></dependencies></project>", F.col("p_size"), F.col("p_partkey"), "p_size",
    )
    is_pom = F.col("p_partkey") % 2 == 0
    return p.select(F.col("p_brand").alias("codebase"), F.col("p_partkey").cast("string").alias("path"), F.when(is_pom, "pom").otherwise("gradle").alias("kind"), F.when(is_pom, pom).otherwise(gradle).alias("content"))


def manifest_dependencies(spark, sf):
    return deps_.dependencies(_manifests(spark, sf))


_DEPS = """SELECT p_brand AS codebase, p_partkey::VARCHAR AS manifest, 'Maven' AS ecosystem, 'org.b' || p_size || ':part-' || p_partkey AS package, '1.' || p_size AS version FROM part
  UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'Maven', 'org.t:tool', p_size::VARCHAR FROM part WHERE p_partkey % 2 = 1"""


def vulnerability_exposure(spark, sf):
    """A snapshot of vulnerabilities: two for each size that seven divides, one for the tool's versions below ten."""
    p = table(spark, sf, "part")
    ids = F.explode(F.array(F.concat(F.lit("V-a"), "p_size"), F.concat(F.lit("V-b"), "p_size")))
    known = p.where("p_size % 7 = 0").select(F.lit("Maven").alias("ecosystem"), F.format_string("org.b%d:part-%d", F.col("p_size"), F.col("p_partkey")).alias("package"), F.format_string("1.%d", "p_size").alias("version"), ids.alias("id"), F.lit("").alias("summary"))
    tool = spark.range(1, 10).select(F.lit("Maven").alias("ecosystem"), F.lit("org.t:tool").alias("package"), F.col("id").cast("string").alias("version"), F.concat(F.lit("T-"), F.col("id").cast("string")).alias("vid"), F.lit("").alias("summary")).withColumnRenamed("vid", "id")
    e = deps_.exposure(deps_.dependencies(_manifests(spark, sf)), known.unionByName(tool))
    return e.select("codebase", "raw", _r(curves.normalise("Dependency Security", F.col("raw")), 9).alias("score"))


EXPOSURE_SQL = """
WITH n AS (SELECT p_brand AS codebase, CASE WHEN p_size % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 2 = 1 AND p_size BETWEEN 1 AND 9 THEN 1 ELSE 0 END AS n FROM part),
s AS (SELECT codebase, 2.0 * sum(n) AS raw FROM n GROUP BY 1 HAVING sum(n) > 0)
SELECT codebase, raw::DOUBLE AS raw, round(exp(-raw / 5), 9)::DOUBLE AS score FROM s
"""


def lookup_answers(spark, sf):
    """Answers of a vulnerability service, made of events: empty, malformed, and with one or two entries."""
    one = F.format_string('{"id": "E-%d", "summary": "%s"}', "event_id", "event_type")
    body = F.when(F.col("event_id") % 5 == 0, "{}").when(F.col("event_id") % 5 == 1, "not json").when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"vulns": ['), one, F.lit("]}")))
    body = body.when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"vulns": ['), one, F.lit(', {"id": ""}]}'))).otherwise(F.concat(F.lit('{"vulns": ['), one, F.lit(', {"id": "X"}]}')))
    return deps_.parse_response(table(spark, sf, "events").select("event_id", body.alias("response")), "event_id")


ANSWERS_SQL = "SELECT event_id, 'E-' || event_id AS id, event_type AS summary FROM events WHERE event_id % 5 >= 2 UNION ALL SELECT event_id, 'X', '' FROM events WHERE event_id % 5 = 4"


def parsed_recommendations(spark, sf):
    p = table(spark, sf, "part")
    answer = F.concat(
        F.lit("Intro\n## [high] Fix "), F.col("p_name"), F.lit("\n\n**Description:** The part is broken. Mend it.\n**Solution:** x\n\n## [low] No text\n\n**Evidence:** none\n## [medium] Long "),
        F.col("p_brand"), F.lit("\n**Description:** "), F.expr("repeat('word ', 50)"), F.lit("\n## [low] Last\n**Description:** End"),
    )
    recs = F.posexplode(advice.recommendations(answer, 3))
    return p.select("p_partkey", recs.alias("n", "recommendation")).select("p_partkey", F.col("n").cast("long"), "recommendation")


RECS_SQL = """
WITH r AS (SELECT p_partkey, unnest(['[HIGH] Fix ' || p_name || ': The part is broken.', '[MEDIUM] Long ' || p_brand || ': ' || repeat('word ', 40) || '...', '[LOW] Last: End']) AS recommendation,
           unnest([0, 1, 2])::BIGINT AS n FROM part)
SELECT p_partkey, n, recommendation FROM r
"""


def status_changes(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return advice.changes(e, "user_id", "event_id", "event_type")


CHANGES_SQL = "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type"


def supplier_badges(spark, sf):
    d = score.geometric_mean(_line_scores(spark, sf), "codebase")
    s = F.col(score.SCORE)
    return d.select("codebase", sinks.badge_url(s, "flat-square").alias("url"), sinks.badge_markdown(s).alias("markdown"), sinks.badge_json(s).alias("endpoint"))


BADGES_SQL = f"""
WITH t AS (SELECT l_suppkey::VARCHAR AS codebase, {_MEAN} AS s FROM lineitem GROUP BY 1),
b AS (SELECT *, printf('%.2f', s) AS f, CASE WHEN s >= 0.8 THEN 'brightgreen' WHEN s >= 0.6 THEN 'green' WHEN s >= 0.4 THEN 'yellow' ELSE 'red' END AS c,
      CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'good' WHEN s >= 0.4 THEN 'fair' ELSE 'poor' END AS l FROM t)
SELECT codebase, 'https://img.shields.io/badge/quality-' || f || '-' || c || '.svg?style=flat-square' AS url,
       '![quality score](https://img.shields.io/badge/quality-' || f || '-' || c || '.svg?style=flat)' AS markdown,
       '{{' || chr(10) || '  "schemaVersion": 1,' || chr(10) || '  "label": "quality",' || chr(10) || '  "message": "' || f || ' (' || l || ')",' || chr(10) || '  "color": "' || c || '",' || chr(10) || '  "cacheSeconds": 3600' || chr(10) || '}}' AS endpoint FROM b
"""


QUERIES = {
    f.__name__: f
    for f in (
        duplication_across, duplication_within, line_counts, secrets_exposure, path_predicates, normalisation_curves, geometric_mean_score, mixed_scores, quality_gates, hierarchy_depth,
        cohesion_of_orders, finding_density, smell_counts, severity_counts, top_issues, manifest_dependencies, vulnerability_exposure,
        lookup_answers, parsed_recommendations, status_changes, supplier_badges,
    )
} | code_queries.QUERIES

ORACLE = {
    "duplication_across": DUPLICATION_SQL,
    "duplication_within": WITHIN_SQL,
    "line_counts": LINES_SQL,
    "secrets_exposure": SECRETS_SQL,
    "path_predicates": PATHS_SQL,
    "normalisation_curves": CURVES_SQL,
    "geometric_mean_score": GEOMEAN_SQL,
    "mixed_scores": MIXED_SQL,
    "quality_gates": GATES_SQL,
    "hierarchy_depth": DEPTH_SQL,
    "cohesion_of_orders": COHESION_SQL,
    "finding_density": FINDINGS_SQL,
    "smell_counts": SMELLS_SQL,
    "severity_counts": SEVERITY_SQL,
    "top_issues": TOP_SQL,
    "manifest_dependencies": _DEPS,
    "vulnerability_exposure": EXPOSURE_SQL,
    "lookup_answers": ANSWERS_SQL,
    "parsed_recommendations": RECS_SQL,
    "status_changes": CHANGES_SQL,
    "supplier_badges": BADGES_SQL,
} | code_queries.oracle(_SQL_CURVES)
