"""The queries: each applies an operator to the standard tables, and has its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bindings as B
from .catalog import register
from .functions import text as X
from .operators import components, evidence, metrics
from .plans.graph import encode

G1 = B.COMMERCE_SQL


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


# --- metrics over the commerce graph ---------------------------------------------------

@register("method_metrics", G1 + "select order_key, sloc::bigint as mloc, (dp + 1)::bigint as cyclo, calls::bigint as calls, nbd::bigint as nbd, params::bigint as params from methods")
def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.method_metrics(B.commerce(spark, sf_dir).methods)
    return rows.select(F.col("method_id").cast("bigint").alias("order_key"), "mloc", "cyclo", "calls", "nbd", "params")


@register("type_size_metrics", G1 + "select * from sizes")
def type_size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_sizes(B.commerce(spark, sf_dir))


COUPLING = """
, coupling as (
    select t.type_id, t.full_name, (select count(distinct target) from depends d where d.full_name = t.full_name)::bigint as dep,
        (select count(distinct dst) from edges e where e.src = t.full_name and e.dst <> e.src)::bigint as i_dep,
        (select count(distinct src) from edges e where e.dst = t.full_name and e.dst <> e.src)::bigint as fan_in
    from types t)
"""


@register("type_dep_idep", G1 + COUPLING + "select type_id, dep, i_dep from coupling")
def type_dep_idep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_coupling(B.commerce(spark, sf_dir)).select("type_id", "dep", "i_dep")


@register("type_fan", G1 + COUPLING + "select type_id, fan_in, i_dep as fan_out from coupling")
def type_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_coupling(B.commerce(spark, sf_dir)).select("type_id", "fan_in", "fan_out")


@register("type_coupling", G1 + COUPLING + "select type_id, dep, i_dep, fan_in, i_dep as fan_out from coupling")
def type_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_coupling(B.commerce(spark, sf_dir))


@register("type_noa_lcom3", G1 + """
, n as (select type_id, count(*) as n from fields group by 1), m as (select type_id, count(*) as m from methods group by 1),
h as (select type_id, count(*) as hits from accessed group by 1)
select t.type_id, coalesce(n, 0)::bigint as noa,
    round(case when coalesce(m, 0) <= 1 or coalesce(n, 0) <= 1 then 0.0 else least(1.0, greatest(0.0, 1 - hits / (m * n)::double)) end, 6)::double as lcom3
from types t left join n using (type_id) left join m using (type_id) left join h using (type_id)""")
def type_noa_lcom3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cohesion(B.commerce(spark, sf_dir)), "lcom3")


@register("namespace_counts", G1 + """
select n_name as namespace, count(t.type_id)::bigint as noc, coalesce(sum(case when is_abstract and kind in ('Class', 'Record') then 1 else 0 end), 0)::bigint as nac
from nation left join types t using (n_name) group by 1""")
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.namespace_counts(B.commerce(spark, sf_dir)).select("namespace", "noc", "nac")


@register("namespace_coupling", G1 + """
, k as (select n_name, count(*) as types, sum(case when is_abstract or kind = 'Interface' then 1 else 0 end) as open_types from types group by 1),
r as (select n_name as namespace, (select count(*) from ns_edges where dst_ns = n_name)::bigint as ca, (select count(*) from ns_edges where src_ns = n_name)::bigint as ce,
    coalesce(open_types / types::double, 0.0) as a from nation left join k using (n_name)),
s as (select *, case when ca + ce = 0 then 0.0 else ce / (ca + ce)::double end as i from r)
select namespace, ca, ce, round(i, 6)::double as i, round(a, 6)::double as a, round(abs(a + i - 1), 6)::double as d from s""")
def namespace_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.namespace_coupling(B.commerce(spark, sf_dir)).select("namespace", "ca", "ce", "i", "a", "d"), "i", "a", "d")


@register("namespace_quotient", G1 + "select src_ns, dst_ns from ns_edges")
def namespace_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.commerce(spark, sf_dir).namespace_edges()


@register("dependency_totals", G1 + "select (select count(*) from (select distinct full_name, target from depends where trim(target) <> ''))::bigint as total_deps, (select count(*) from edges where src <> dst)::bigint as internal_deps")
def dependency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dependency_totals(B.commerce(spark, sf_dir))


@register("internal_targets", G1 + "select t.type_id, d.target from depends d join types t using (full_name) where d.target <> full_name and d.target in (select full_name from types)")
def internal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.targets(B.commerce(spark, sf_dir), internal=True)


@register("external_targets", G1 + "select t.type_id, d.target from depends d join types t using (full_name) where d.target not in (select full_name from types)")
def external_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.targets(B.commerce(spark, sf_dir), internal=False)


def _four(c: str, name: str) -> str:
    return f"sum({c})::bigint as total_{name}, round(avg({c}), 6)::double as avg_{name}, round(median({c}), 6)::double as median_{name}, round(stddev_pop({c}), 6)::double as stddev_{name}"


@register("summary", G1 + f""", x as (select count(*)::bigint as total_types, {_four('sloc', 'sloc')}, {_four('nom', 'methods')}, {_four('wmc', 'complexity')} from sizes)
select (select count(*) from nation)::bigint as total_namespaces, round(total_types / (select count(*) from nation)::double, 6)::double as mean_types_per_namespace,
    x.* exclude (total_methods), (select count(*) from methods)::bigint as total_methods from x""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.summary(B.commerce(spark, sf_dir))
    return rounded(rows, *(c for c, t in rows.dtypes if t == "double"))


@register("project_counts", G1 + """
select r_name as project, (select count(*) from nation where n_regionkey = r_regionkey)::bigint as namespaces,
    (select count(*) from types where n_regionkey = r_regionkey)::bigint as types,
    (select count(*) from methods m join types t using (type_id) where n_regionkey = r_regionkey)::bigint as methods from region""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.project_counts(B.commerce(spark, sf_dir)).select("project", "namespaces", "types", "methods")


@register("report_counts", G1 + """
select 'Namespaces' as name, count(*)::bigint as count from nation union all select 'Types', count(*) from types union all select 'Methods', count(*) from methods
union all select 'Projects', count(*) from region union all select 'NamespaceCoupling', count(*) from nation union all select 'TypeCoupling', count(*) from types""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report_counts(B.commerce(spark, sf_dir))


@register("graph_attr_roundtrip", G1 + "select * from sizes")
def graph_attr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_sizes(encode(B.commerce(spark, sf_dir)).model())


# --- graph operators -----------------------------------------------------------------------

@register("type_cycles", B.SESSIONS_SQL + B.CYCLES_SQL + "select root, count(*)::bigint as size, string_agg(node, ',' order by node) as members from mutual group by root")
def type_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.cycles(B.sessions(spark, sf_dir), "Type").select("root", "size", "members")


@register("namespace_cycles", B.ORDER_FLOW_SQL + B.CYCLES_SQL + "select 'Namespace' as scope, root, count(*)::bigint as size, string_agg(node, ',' order by node) as members from mutual group by root")
def namespace_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.cycles(B.order_flow(spark, sf_dir), "Namespace")


@register("edge_dedup_sort", """
select l_orderkey as from_id, l_suppkey as to_id, case l_linestatus when 'O' then 2 else 3 end::int as kind_ord,
    row_number() over (partition by l_orderkey order by case l_linestatus when 'O' then 2 else 3 end, l_suppkey)::int as position
from (select distinct l_orderkey, l_suppkey, l_linestatus from lineitem)""")
def edge_dedup_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without repeats, in the order (from, kind number, to) within each source node."""
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.when(F.col("l_linestatus") == "O", 2).otherwise(3).alias("kind_ord")).distinct()
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("from_id").orderBy("kind_ord", "to_id")))


@register("metric_rank_pairing", """
with a as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey::varchar) as rn from part),
b as (select p_name, p_size, row_number() over (partition by p_name order by p_size, p_partkey) as rn from part)
select p_partkey as part_id, p_size as paired_value from a join b using (p_name, rn)""")
def metric_rank_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th id of a name (ordinal order) with the i-th value of that name."""
    part = B.table(spark, sf_dir, "part")
    ids = part.select("p_name", F.col("p_partkey").alias("part_id")).withColumn("rn", F.row_number().over(Window.partitionBy("p_name").orderBy(F.col("part_id").cast("string"))))
    values = part.select("p_name", F.col("p_size").alias("paired_value"), F.row_number().over(Window.partitionBy("p_name").orderBy("p_size", "p_partkey")).alias("rn"))
    return ids.join(values, ["p_name", "rn"]).select("part_id", "paired_value")


@register("usage_rollup", """
with m as (select distinct o_orderkey::varchar as o, 'c:' || o_custkey as c, n_name as n, r_name as r, 'ext:' || lower(p_brand) as k
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on p_partkey = l_partkey),
u as (select 'method' as level, o as node_id, k from m union select 'type', c, k from m union select 'namespace', n, k from m union select 'project', r, k from m)
select level, node_id, count(*)::bigint as n, string_agg(k, ',' order by k) as candidates from u group by 1, 2""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sets of methods, united level by level up the containment."""
    from .operators.usage import rolled_up

    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = B.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ext:"), F.lower("p_brand")).alias("candidate_id"))
    use = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("node_id"), "candidate_id").distinct()
    customer, nation = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "nation")
    up = [orders.select(F.col("o_orderkey").cast("string").alias("child"), F.concat(F.lit("c:"), "o_custkey").alias("parent")),
          customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c:"), "c_custkey").alias("child"), F.col("n_name").alias("parent")),
          nation.join(B.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))]
    rows = rolled_up(use, up)
    return rows.select("level", "node_id", F.size("candidates").cast("bigint").alias("n"), F.array_join("candidates", ",").alias("candidates"))


# --- evidence ---------------------------------------------------------------------------------

WEIGHT = "case event_type when 'error' then -0.3D when 'purchase' then 0.6D when 'signup' then 0.2D else 0.05D end"


@register("confidence_fold", """
with w as (select user_id, list(case event_type when 'error' then -0.3 when 'purchase' then 0.6 when 'signup' then 0.2 else 0.05 end::double order by ts, event_id) as ws from events group by 1),
c as (select user_id, list_reduce(ws, lambda a, w: least(1.0, greatest(0.0, a + w)), 0.0::double) as confidence from w)
select user_id, round(confidence, 6)::double as confidence from c where confidence > 0""")
def confidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(WEIGHT).alias("w"))
    return rounded(evidence.confidence(events, "user_id", ["ts", "event_id"], "w", F.to_date("ts")), "confidence")


@register("evidence_dedup", """
with e as (select user_id, event_type, floor(value)::int as line, props from events)
select user_id, count(*)::bigint as n_raw, count(distinct event_type || '|' || coalesce(line::varchar, '') || '|' || coalesce(props, ''))::bigint as n_distinct from e group by 1""")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("file_path"), F.floor("value").cast("int").alias("line"), F.col("props").alias("details"))
    kept = evidence.distinct_evidence(rows, "user_id").groupBy("user_id").agg(F.max("position").cast("bigint").alias("n_distinct"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_raw")).join(kept, "user_id").select("user_id", "n_raw", "n_distinct")


# A small rule table for the substring join.
PART_RULES = ((1, "green", "SqlServer"), (2, "red", "Redis"), (3, "blue", "PostgreSQL"), (4, "steel", "AzureBlob"), (5, "large", "Oracle"), (6, "a", "HttpClient"), (7, "e", "Kafka"))


@register("rule_first_match", "with r(priority, pattern, technology) as (values " + ", ".join(f"({p}, '{t}', '{k}')" for p, t, k in PART_RULES) + """)
select p_partkey as part_id, arg_min(technology, priority) as technology from part join r on contains(lower(p_name), pattern) group by 1""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PART_RULES, "priority int, pattern string, technology string")
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_name")
    return evidence.first_match(part, "p_name", rules, ["part_id"])


@register("profile_filter", "with r(priority, pattern, technology) as (values " + ", ".join(f"({p}, '{t}', '{k}')" for p, t, k in PART_RULES) + """),
f as (select p_partkey, arg_min(technology, priority) as technology from part join r on contains(lower(p_name), pattern) group by 1)
select technology, count(*)::bigint as n from f where technology in ('SqlServer', 'Oracle', 'CosmosDb', 'Redis', 'AzureServiceBus', 'AzureEventGrid', 'AzureKeyVault', 'MassTransit', 'HttpClient', 'AzureApiManagement', 'AzureBlob', 'Storage', 'OpenTelemetry') group by 1""")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.integrations import WORK_TECHNOLOGIES

    found = rule_first_match(spark, sf_dir)
    return found.where(F.lower("technology").isin(*(t.lower() for t in WORK_TECHNOLOGIES))).groupBy("technology").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions over tables -------------------------------------------------------

@register("url_endpoint", r"""
select page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]*)', 1)) || '://' || lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]*)', 2)) as endpoint from pages""")
def url_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", X.http_endpoint(F.col("url")).alias("endpoint"))


# Hosts with their expected scopes in the tests.
HOSTS = ("localhost", "127.0.0.1", "10.1.2.3", "192.168.0.9", "172.16.0.1", "172.32.0.1", "db.local", "a.svc", "x.cluster.local", "b.internal", "c.localdomain", "intranet", "example.com", "users-api.local", "payments.example")


@register("host_scope", "with h as (select page_id as id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from pages union all select * from (values " + ", ".join(f"({-k}, '{h}')" for k, h in enumerate(HOSTS, 1)) + r""") v(id, host))
select id, case when host = 'localhost' or regexp_matches(host, '^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') or regexp_matches(host, '\.(local|svc|internal|localdomain)$') or not contains(host, '.') then 'internal' else 'external' end as scope from h""")
def host_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    more = spark.createDataFrame([(-k, f"http://{h}/x") for k, h in enumerate(HOSTS, 1)], "id bigint, url string")
    return pages.unionByName(more).select("id", X.http_scope(F.lit(""), F.col("url")).alias("scope"))


# Paths of the scan rules.
PATHS = ("src/Program.cs", "src/bin/Debug/file.txt", "src\\obj\\Debug\\file.txt", ".git/config", ".vs/slnFile", "web/node_modules/pkg/index.js", "bin/x", "a/binary/y.cs")


@register("path_glob_filter", r"with p as (select page_id as id, regexp_extract(url, '://[^/]*/(.*)$', 1) as path from pages union all select * from (values " + ", ".join(f"({-k}, '{h}')" for k, h in enumerate(PATHS, 1)) + r""") v(id, path))
select id, not regexp_matches('/' || replace(path, '\', '/'), '(?i)/(bin|obj|\.git|\.vs|\.idea|node_modules)/') as included from p""")
def path_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "://[^/]*/(.*)$", 1).alias("path"))
    more = spark.createDataFrame([(-k, p) for k, p in enumerate(PATHS, 1)], "id bigint, path string")
    return pages.unionByName(more).select("id", X.path_included(F.col("path")).alias("included"))


@register("language_detect", """
with f as (select doc_id % 400 as root, case lang when 'en' then 'csharp' when 'fr' then 'python' when 'de' then 'go' else 'ruby' end as l from documents)
select root, case when count(distinct l) = 1 then min(l) end as language from f group by 1""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import detected_language

    ext = F.expr("case lang when 'en' then '.cs' when 'fr' then '.PY' when 'de' then '.go' else '.rb' end")
    files = B.table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("root"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ext).alias("path"))
    return detected_language(files, "root")


# Sources as users write them.
SOURCES = ("https://github.com/a/b", "http://github.com/a/b.git", "git@host.org:a/b.git", "ssh://git@host/a/b", "owner/repo", "src/App/App.csproj", "All.sln", "  /tmp/x ", "", "C:\\src\\A.sln")


@register("source_normalize", "with s as (select url as input from pages union all select * from (values " + ", ".join(f"('{h}')" for h in SOURCES) + r""") v(input)), t as (select input, trim(input) as t from s),
k as (select *, case when t = '' then 'none' when regexp_matches(t, '(?i)^(https?|git|ssh)://|^git@[\w.-]+:.*?[/:]\S+\.git$') then 'url' when regexp_matches(t, '(?i)\.(sln|csproj)$') then 'file'
    when regexp_matches(t, '^[\w-]+/[\w.-]+$') then 'shorthand' else 'path' end as kind from t)
select input, kind, case when kind = 'shorthand' then 'https://github.com/' || t || '.git' when regexp_matches(t, '(?i)^https?://github\.com/') and not lower(t) like '%.git' then t || '.git'
    when kind = 'file' then coalesce(nullif(regexp_extract(replace(t, '\', '/'), '^(.*)/[^/]*$', 1), ''), '.') when kind = 'none' then null else t end as normalized from k""")
def source_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select(F.col("url").alias("input"))
    rows = pages.unionByName(spark.createDataFrame([(s,) for s in SOURCES], "input string"))
    return rows.select("input", X.source_kind(F.col("input")).alias("kind"), X.source_normalized(F.col("input")).alias("normalized"))


# Connection strings and their kinds.
CONNECTIONS = (
    ("Endpoint=sb://x/;SharedAccessKey=k", "ServiceBus"), ("AccountEndpoint=https://x.documents.azure.com:443/", "CosmosDb"), ("DefaultEndpointsProtocol=https;AccountKey=k", "Storage"),
    ("mongodb://localhost:27017", "MongoDB"), ("Host=localhost;Database=d", "PostgreSQL"), ("Server=db;Port=3306;Uid=root", "PostgreSQL"), ("Data Source=(DESCRIPTION=(ADDRESS=(HOST=h)(PORT=1521)))", "PostgreSQL"),
    ("User Id=s;Data Source=orcl;SID=x", "Oracle"), ("Server=localhost;Database=d", "SqlServer"), ("Data Source=app.sqlite", "SqlServer"), ("Uid=root;Pwd=x", "MySql"), ("file.sqlite", "Sqlite"), ("hello", "Unknown"), ("", "Unknown"))


@register("conn_string_classify", "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in CONNECTIONS) + ") v(value, kind)")
def conn_string_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in CONNECTIONS], "value string").select("value", X.connection_kind(F.col("value")).alias("kind"))


@register("redact_secrets", r"""
select doc_id, length(r)::bigint as n, md5(r) as digest from (select doc_id, regexp_replace(regexp_replace(text,
    '(?i)(^|[;,&?\s"''])(Password|Pwd|SharedAccessKey|AccountKey|Key|Secret|Token|SharedAccessSignature)(\s*=\s*)("[^"]*"|''[^'']*''|[^=;,&\s][^;,&\s]*)', '\1\2\3***', 'g'),
    '(?i)([a-z][a-z0-9+.-]*://[^:/@\s]+):[^@/\s]+@', '\1:***@', 'g') as r from documents)""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text")).alias("r"))
    return rows.select("doc_id", F.length("r").cast("bigint").alias("n"), F.md5(F.encode("r", "UTF-8")).alias("digest"))


@register("normalize_logical_name", """
with n as (select s_name as name from supplier union all select * from (values ('  Main Db!'), ('--x--'), (''), ('Ünï 9')) v(name)),
m as (select name, trim(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{Nd}]', '-', 'g'), '-') as t from n)
select name, 'ext:database:' || case when t = '' then 'default' else t end as candidate_id from m""")
def normalize_logical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(spark.createDataFrame([("  Main Db!",), ("--x--",), ("",), ("Ünï 9",)], "name string"))
    return rows.select("name", X.candidate_id(F.lit("Database"), F.col("name")).alias("candidate_id"))


@register("sloc_lines", r"select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: not regexp_full_match(x, '[\s}]*')))::bigint as sloc from documents")
def sloc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", X.sloc(F.col("text")).alias("sloc"))


@register("stats_library", """
with g as (select * from (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('none')) v(grp))
select grp, round(coalesce(avg(o_totalprice), 0), 6)::double as mean, round(coalesce(median(o_totalprice), 0), 6)::double as median,
    round(coalesce(stddev_pop(o_totalprice), 0), 4)::double as sd_pop, round(coalesce(stddev_samp(o_totalprice), 0), 4)::double as sd_samp
from g left join orders on o_orderpriority = grp group by 1""")
def stats_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",), ("5-LOW",), ("none",)], "grp string")
    mean, median, pop, samp = metrics.statistics("o_totalprice")
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice")
    # averaged before the join, so one priority's orders are not gathered in a task
    rows = orders.groupBy("grp").agg(mean.alias("mean"), median.alias("median"), pop.alias("sd_pop"), samp.alias("sd_samp"))
    rows = groups.join(rows, "grp", "left").select("grp", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "sd_pop", "sd_samp")))
    return rows.select("grp", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("sd_pop", 4).alias("sd_pop"), F.round("sd_samp", 4).alias("sd_samp"))


# Formats as users write them, and what they mean.
FORMATS = (("", "json"), ("  ", "json"), ("JSON", "json"), ("serif", "sarif"), ("Sarif", "sarif"), (" md ", "md"), ("csv", "csv"))


@register("report_format", "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in FORMATS) + ") v(input, format)")
def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in FORMATS], "input string").select("input", X.report_format(F.col("input")).alias("format"))


# --- sources ------------------------------------------------------------------------------

@register("config_flatten", """
select event_id::varchar as file_path, 'k' as key_path, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null
union all select * from (values ('x', 'A:B', '1'), ('x', 'A:C:0', 'True'), ('x', 'A:C:1', ''), ('x', 'D', 'e')) v(file_path, key_path, value)""")
def config_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import settings

    rows = B.table(spark, sf_dir, "events").select(F.concat("event_id", F.lit("/appsettings.json")).alias("path"), F.encode("props", "UTF-8").alias("content"))
    more = spark.createDataFrame([("x/appsettings.json", '﻿{"A":{"B":1,"C":[true,null]},"D":"e"}'), ("y/appsettings.json", "{broken")], "path string, t string")
    found = settings.json_entries(rows.unionByName(more.select("path", F.encode("t", "UTF-8").alias("content"))))
    return found.select(F.substring_index("file_path", "/", 1).alias("file_path"), "key_path", "value")


@register("env_parse", "select * from (values (1, 'A', '1'), (4, 'B', 'x=y'), (6, 'C', '')) v(line, key_path, value)")
def env_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import settings

    return settings.env_lines(spark.createDataFrame([("A=1\r\n# note\n\n B = x=y \n=none\nC=\nplain",)], "text string")).select("line", "key_path", "value")


@register("package_scan", "select * from (values ('a/App.csproj', 'Npgsql', 3), ('a/App.csproj', 'Dapper', 4), ('Directory.Packages.props', 'MassTransit', 1)) v(file_path, name, line)")
def package_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import settings

    rows = [("a/App.csproj", '<Project>\n<ItemGroup>\n<PackageReference Include=" Npgsql " />\n<packagereference Update="Dapper"/>\n</ItemGroup></Project>'),
            ("Directory.Packages.props", '<Project xmlns="urn:x"><PackageVersion Include="MassTransit"/></Project>'), ("b/Bad.csproj", "<Project><PackageReference"), ("c/readme.md", "<PackageReference Include='No'/>")]
    return settings.packages(spark.createDataFrame(rows, "path string, t string").select("path", F.encode("t", "UTF-8").alias("content"))).select("file_path", "name", "line")


# Snippets with their counts.
SNIPPETS = (
    ("conditions", "if (A && B || Cc) { }", 1, 4, 1, 0),
    ("nested", "if (a) {\n while (b) {\n for (;;) {\n if (c) { }\n}\n}\n}", 4, 5, 4, 0),
    ("else_if", "if (a) { } else if (b) { if (c) { } else { if (d) { } } } else { }", 1, 5, 3, 0),
    ("called", 'Foo(); this.Bar(); Console.WriteLine("x"); "a".Ex().Ex(); new C();', 1, 1, 0, 5),
    ("comments", "// nothing\n/* at\n all */\n#region x\n\n", 0, 1, 0, 0),
    ("arms", "return x switch { 1 => 2, 2 => 3, _ => 4 };", 1, 4, 0, 0),
    ("cases", "switch (x) {\n case 1: break;\n case 2: break;\n default: break;\n}", 4, 3, 1, 0),
    ("loops", "do { x++; } while (x < 3);\nvar y = s ?? x > 0 ? 1 : 2;", 2, 4, 1, 0))


@register("csharp_lexer_metrics", "select * from (values " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, _, a, b, c, d in SNIPPETS) + ") v(snippet, sloc, cyclo, nbd, calls)")
def csharp_lexer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.csharp import count_snippets

    return count_snippets(spark.createDataFrame([(n, t) for n, t, *_ in SNIPPETS], "snippet string, text string"))


# --- integrations --------------------------------------------------------------------------

# Signals of four small repositories (snapshot, phase, text, value), and what they make.
SAMPLE_SIGNALS = (
    ("http", "config", "HttpClients:Payments:BaseUrl", "https://payments.example"), ("http", "package", "Microsoft.Extensions.Http", None), ("http", "invocation", "X.AddHttpClient(string)", None), ("http", "type", "System.Net.Http.HttpClient", None),
    ("ef", "config", "ConnectionStrings:MainDb", "Server=localhost;Database=d;Password=hidden"), ("ef", "package", "Microsoft.EntityFrameworkCore.SqlServer", None), ("ef", "invocation", "X.UseSqlServer(string)", None), ("ef", "type", "X.DbContext", None),
    ("redis", "config", "Redis:Configuration", "localhost:6379"), ("redis", "package", "StackExchange.Redis", None), ("redis", "invocation", "X.AddStackExchangeRedisCache()", None), ("redis", "type", "StackExchange.Redis.ConnectionMultiplexer", None),
    ("bus", "config", "ServiceBus:ConnectionString", "Endpoint=sb://x/;SharedAccessKey=hidden="), ("bus", "package", "Azure.Messaging.ServiceBus", None), ("bus", "type", "Azure.Messaging.ServiceBus.ServiceBusClient", None),
    ("pg", "config", "ConnectionStrings:Pg", "Host=h;Port=5432"), ("pg", "package", "Npgsql", None))
SAMPLE_CANDIDATES = (
    ("http", "ext:httpapi:payments", "HttpClient", "Payments", "https://payments.example", 1.0), ("ef", "ext:database:maindb", "SqlServer", "MainDb", "Server=localhost;Database=d;Password=***", 1.0),
    ("redis", "ext:cache:redis", "Redis", "redis", "localhost:6379", 1.0), ("bus", "ext:messagebus:servicebus", "AzureServiceBus", "servicebus", "Endpoint=sb://x/;SharedAccessKey=***", 1.0))


def _signals(rows: DataFrame) -> DataFrame:
    """Signals from (snapshot_id, phase, text, value, position)."""
    none = F.lit(None)
    return rows.select("snapshot_id", "phase", F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.col("position").cast("int").alias("c")).alias("position"),
                       F.when(F.col("phase").isin("config", "package"), none).otherwise(F.concat(F.lit("n"), "position")).cast("string").alias("node_id"), "text", "value", none.cast("int").alias("argument_index"),
                       none.cast("boolean").alias("is_resolved"), F.lit("f").alias("file_path"), none.cast("int").alias("line"))


@register("integration_samples", "select snapshot_id, id, technology, logical_name, endpoint, confidence::double as confidence from (values " + ", ".join(str(c) for c in SAMPLE_CANDIDATES) + ") v(snapshot_id, id, technology, logical_name, endpoint, confidence)")
def integration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import integrations

    rows = spark.createDataFrame([(*s, k) for k, s in enumerate(SAMPLE_SIGNALS)], "snapshot_id string, phase string, text string, value string, position int")
    found = integrations.in_profile(integrations.detect(_signals(rows)))
    return found.select("snapshot_id", "id", "technology", "logical_name", "endpoint", F.round("confidence", 6).alias("confidence"))


# The call that stands for an order's priority, and the candidate it makes with its technology.
PRIORITY_CALLS = (
    ("1-URGENT", "X.UseSqlServer", "ext:database:default", "SqlServer"), ("2-HIGH", "X.AddHttpClient", "ext:httpapi:default", "HttpClient"), ("3-MEDIUM", "X.CreateSender", "ext:messagebus:default", "AzureServiceBus"),
    ("4-NOT SPECIFIED", "X.AddStackExchangeRedisCache", "ext:cache:default", "Redis"), ("5-LOW", "X.GetBlobContainerClient", "ext:storage:default", "AzureBlob"))


@register("integration_detection", "select o_custkey::varchar as snapshot_id, id, technology, least(1.0, round(0.3 * count(*), 6))::double as confidence, 1::int as n_evidence, count(distinct o_orderkey)::int as n_nodes "
          "from orders join (values " + ", ".join(f"('{p}', '{i}', '{t}')" for p, _, i, t in PRIORITY_CALLS) + ") v(priority, id, technology) on o_orderpriority = priority where o_custkey is not null group by 1, 2, 3")
def integration_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a customer: its orders are calls, so that detection runs over many small repositories."""
    from .operators import integrations

    calls = {p: call for p, call, *_ in PRIORITY_CALLS}
    text = F.try_element_at(F.create_map(*[F.lit(x) for kv in calls.items() for x in kv]), F.col("o_orderpriority"))
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("snapshot_id"), F.lit("invocation").alias("phase"), text.alias("text"), F.lit(None).cast("string").alias("value"), F.col("o_orderkey").cast("int").alias("position"))
    found = integrations.in_profile(integrations.detect(_signals(orders)))
    return found.select("snapshot_id", "id", "technology", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n_evidence"), F.size("used_by").alias("n_nodes"))
