"""AI asset inventory from collected configuration files and directory listings.

Inputs are tables: ``config_files(device, path, text)`` and
``file_inventory(device, dir, name, is_dir)``.  Names and counts come out, never
values of environment variables or file contents.  Each config file is read in
its row; only counts per device or fleet are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.operators.scan import literal_array
from glasswatch.plans.skew import newest_per_key, salted_join

_SERVER = "struct<command:string,args:array<string>,url:string,type:string,transport:string,env:map<string,string>>"
_CLAUDE = (f"struct<mcpServers:map<string,{_SERVER}>,projects:map<string,struct<mcpServers:map<string,{_SERVER}>>>,"
           "oauthAccount:struct<emailAddress:string,organizationName:string>>")
_CURSOR = f"struct<mcpServers:map<string,{_SERVER}>>"

# File locations, key words and scores are fixed values.
CLAUDE_JSON = "/.claude.json"
CLAUDE_SETTINGS = "/.claude/settings.json"
CURSOR_JSON = "/.cursor/mcp.json"
CODEX_TOML = "/.codex/config.toml"
CODEX_AUTH = "/.codex/auth.json"
AIDER_YML = "/.aider.conf.yml"
GH_HOSTS = "/.config/gh/hosts.yml"
OLLAMA_DIR = "/.ollama/models/manifests/registry.ollama.ai/library"
LMSTUDIO_DIRS = ("/.lmstudio/models", "/.cache/lm-studio/models")
NET_WORDS = ("fetch", "brave-search", "puppeteer", "playwright", "firecrawl", "http")
FS_WORDS = ("filesystem", "server-files", " files ")
CRED_WORDS = ("github", "gitlab", "slack", "aws", "gdrive", "google-drive", "notion", "stripe", "jira")
CRED_KEYS = ("TOKEN", "KEY", "SECRET", "PASSWORD", "CREDENTIAL")
SENSITIVE_NAMES = (".env", "id_rsa", "id_ed25519", "id_dsa", "id_ecdsa", "credentials", "credentials.json", ".netrc",
                   ".npmrc", ".pypirc", "service-account.json", ".git-credentials", "secrets.yaml", "secrets.yml")
SENSITIVE_ENDINGS = (".pem", ".key", ".pfx", ".p12", "-key.json")
BROAD_PERMISSIONS = ("<all_urls>", "*://*/*", "http://*/*", "https://*/*", "tabs", "webRequest", "webRequestBlocking",
                     "cookies", "clipboardRead", "history", "debugger")
# Install locations of AI applications and command line tools, tool name first.
AI_APPS = (
    ("ChatGPT", "/Applications/ChatGPT.app"), ("Claude", "/Applications/Claude.app"),
    ("Copilot", "/Applications/Copilot.app"), ("ChatGPT Atlas", "/Applications/ChatGPT Atlas.app"),
    ("Cursor", "/Applications/Cursor.app"), ("Perplexity", "/Applications/Perplexity.app"),
    ("Ollama", "/Applications/Ollama.app"), ("LM Studio", "/Applications/LM Studio.app"),
    ("Msty", "/Applications/Msty.app"), ("Jan", "/Applications/Jan.app"),
    ("Raycast", "/Applications/Raycast.app"), ("Windsurf", "/Applications/Windsurf.app"),
    ("ChatGPT", "/Programs/ChatGPT/ChatGPT.exe"), ("Claude", "/AnthropicClaude/claude.exe"),
    ("Copilot", "/Programs/Copilot/Copilot.exe"), ("Cursor", "/Programs/cursor/Cursor.exe"),
    ("Perplexity", "/Programs/Perplexity/Perplexity.exe"), ("Ollama", "/Programs/Ollama/ollama app.exe"),
    ("LM Studio", "/Programs/lm-studio/LM Studio.exe"), ("Jan", "/Programs/jan/Jan.exe"),
    ("Windsurf", "/Programs/Windsurf/Windsurf.exe"),
    ("ollama CLI", "/.ollama"), ("ollama CLI", "/opt/homebrew/bin/ollama"), ("ollama CLI", "/usr/local/bin/ollama"),
    ("aider", "/.local/bin/aider"), ("aider", "/opt/homebrew/bin/aider"), ("aider", "/usr/local/bin/aider"),
    ("claude CLI", "/bin/claude"), ("codex CLI", "/bin/codex"), ("copilot CLI", "/bin/copilot"),
)


# -- MCP servers -------------------------------------------------------------------

def _set(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def mcp_remote(server: Column) -> Column:
    sse = F.lit("sse")
    return (_set(server["url"]) | F.coalesce(server["type"] == sse, F.lit(False))
            | F.coalesce(server["transport"] == sse, F.lit(False)))


def mcp_transport(server: Column) -> Column:
    return F.when(mcp_remote(server), F.lit("remote")).otherwise(F.lit("stdio"))


def launch_line(server: Column) -> Column:
    words = F.concat(F.array(F.coalesce(server["command"], F.lit(""))),
                     F.coalesce(server["args"], F.array().cast("array<string>")))
    return F.lower(F.array_join(words, " "))


def _has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def mcp_caps(server: Column) -> Column:
    """STRUCT<net, fs, cred> from the launch line and the NAMES of environment variables."""
    line = launch_line(server)
    keys = F.coalesce(F.map_keys(server["env"]), F.array().cast("array<string>"))
    return F.struct((mcp_remote(server) | _has_any(line, NET_WORDS)).alias("net"), _has_any(line, FS_WORDS).alias("fs"),
                    (_has_any(line, CRED_WORDS) | F.exists(keys, lambda k: _has_any(F.upper(k), CRED_KEYS))).alias("cred"))


def mcp_score(caps: Column) -> Column:
    part = lambda on, points: F.when(on, F.lit(points)).otherwise(F.lit(0))
    return (part(caps["net"], 25) + part(caps["fs"], 25) + part(caps["cred"], 35) + part(caps["net"] & caps["cred"], 15))


def mcp_level(caps: Column) -> Column:
    s = mcp_score(caps)
    return F.when(s >= 60, F.lit("high")).when(s >= 30, F.lit("med")).otherwise(F.lit("low"))


def mcp_risk(server: Column) -> Column:
    """Launch commands that fetch and run a script, or run an inline shell; else null."""
    line = F.concat(launch_line(server), F.lit(" "))
    piped = _has_any(line, ("curl", "wget")) & _has_any(line, ("| sh", "|sh", "| bash", "|bash"))
    return F.when(piped, F.lit("fetches and pipes a remote script to a shell")).when(
        _has_any(line, ("bash -c", "sh -c", "eval ")), F.lit("runs an inline shell"))


def mcp_servers(config_files: DataFrame) -> DataFrame:
    """(device, scope, name, transport, caps, level, risk): global servers before
    per-project ones, then the editor's; first of a name within its scope wins."""
    path, text = F.col("path"), F.col("text")
    empty = F.array().cast(f"array<struct<key:string,value:{_SERVER}>>")
    work = config_files.where(path.endswith(CLAUDE_JSON) | path.endswith(CURSOR_JSON)).withColumn(
        "scope", F.when(path.endswith(CURSOR_JSON), F.lit("cursor")).otherwise(F.lit("claude")))
    work = work.withColumn("__j", F.from_json(text, _CLAUDE))
    entries = F.concat(
        F.coalesce(F.map_entries("__j.mcpServers"), empty),
        F.when(F.col("scope") == "claude", F.flatten(F.transform(
            F.coalesce(F.map_values("__j.projects"), F.array().cast(f"array<struct<mcpServers:map<string,{_SERVER}>>>")),
            lambda p: F.coalesce(F.map_entries(p["mcpServers"]), empty)))).otherwise(empty))
    work = work.select("device", "scope", F.posexplode(entries).alias("pos", "e")) \
        .where(F.coalesce(F.col("e.key"), F.lit("")) != "")
    # What is kept of a server is worked out before rows are dealt by device: its map and launch line stay in the task that
    # read them.  They are dealt first and reduced then, so no task sorts the entries of a whole split.
    srv = F.col("e.value")
    kept = F.struct("pos", mcp_transport(srv).alias("transport"), mcp_caps(srv).alias("caps"), mcp_risk(srv).alias("risk"))
    rows = work.select("device", "scope", F.col("e.key").alias("name"), kept.alias("x")).repartition("device", "scope", "name")
    first = rows.groupBy("device", "scope", "name").agg(F.min("x").alias("x"))
    return first.select("device", "scope", "name", "x.transport", "x.caps", "x.risk") \
        .withColumn("level", mcp_level(F.col("caps")))


# -- providers, models, accounts ------------------------------------------------------

def config_value(text: Column, key: str, sep: str) -> Column:
    """First non-empty ``key <sep> value`` of a line-based file, quotes stripped."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda l: F.trim(F.regexp_replace(l, r"^\s+|\s+$", "")))
    rest = F.transform(F.filter(lines, lambda l: l.startswith(key)),
                       lambda l: F.ltrim(F.regexp_replace(F.substr(l, F.lit(len(key) + 1)), r"^\s+", "")))
    values = F.transform(F.filter(rest, lambda r: r.startswith(sep)),
                         lambda r: F.trim(F.regexp_replace(F.trim(F.substr(r, F.lit(2))), r"^[\"']|[\"']$", "")))
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def providers(config_files: DataFrame) -> DataFrame:
    """(device, provider, agent, model, source) configured on each device."""
    path, text = F.col("path"), F.col("text")
    parsed = F.try_parse_json(text)
    entry = lambda provider, agent, model, source: F.struct(
        provider.alias("provider"), F.lit(agent).alias("agent"), model.alias("model"), F.lit(source).alias("source"))
    row = (F.when(path.endswith(CLAUDE_SETTINGS) & parsed.isNotNull(),
                  entry(F.lit("Anthropic"), "claude", F.nullif(F.get_json_object(text, "$.model"), F.lit("")), "settings.json"))
           .when(path.endswith(CODEX_TOML),
                 entry(F.coalesce(config_value(text, "model_provider", "="), F.lit("OpenAI")), "codex",
                       config_value(text, "model", "="), "config.toml"))
           .when(path.endswith(AIDER_YML), entry(F.lit("Aider"), "aider", config_value(text, "model", ":"), "aider.conf.yml")))
    # A settings file that is empty or holds no JSON says nothing; other files count by presence.
    return config_files.select("device", row.alias("p")).where(F.col("p").isNotNull()).select("device", "p.*")


def local_models(file_inventory: DataFrame) -> DataFrame:
    d = F.col("dir")
    lm = F.lit(False)
    for x in LMSTUDIO_DIRS:
        lm = lm | d.endswith(x)
    runtime = F.when(d.endswith(OLLAMA_DIR), F.lit("ollama")).when(lm & F.col("is_dir"), F.lit("lmstudio"))
    return file_inventory.select("device", runtime.alias("runtime"), "name").where(F.col("runtime").isNotNull())


def accounts_in_use(config_files: DataFrame) -> DataFrame:
    """(device, agent, account, org): names only, codex by presence."""
    path, text = F.col("path"), F.col("text")
    user = config_value(text, "user", ":")
    email = F.get_json_object(text, "$.oauthAccount.emailAddress")
    entry = lambda agent, account, org: F.struct(F.lit(agent).alias("agent"), account.alias("account"), org.alias("org"))
    none = F.lit(None).cast("string")
    row = (F.when(path.endswith(CLAUDE_JSON) & (email != ""),
                  entry("claude", email, F.get_json_object(text, "$.oauthAccount.organizationName")))
           .when(path.endswith(GH_HOSTS) & user.isNotNull(), entry("copilot", user, none))
           .when(path.endswith(CODEX_AUTH), entry("codex", none, none)))
    return config_files.select("device", row.alias("a")).where(F.col("a").isNotNull()).select("device", "a.*")


# -- bill of materials -----------------------------------------------------------------

def components(config_files: DataFrame, file_inventory: DataFrame) -> DataFrame:
    """Models (configured and local), agents and MCP servers as one component table."""
    prov, local, mcp = providers(config_files), local_models(file_inventory), mcp_servers(config_files)
    models = prov.where(F.col("model").isNotNull()).select(
        "device", F.lit("model").alias("type"), F.col("model").alias("name"), "provider", F.lit(False).alias("local"))
    locals_ = local.select("device", F.lit("model").alias("type"), "name", F.col("runtime").alias("provider"),
                           F.lit(True).alias("local"))
    agents = prov.select("device", F.lit("agent").alias("type"), F.col("agent").alias("name")).distinct()
    servers = mcp.select("device", F.lit("mcp-server").alias("type"), "name", F.col("level").alias("risk_level"),
                         "caps", "transport")
    return (models.unionByName(locals_).unionByName(agents, allowMissingColumns=True)
            .unionByName(servers, allowMissingColumns=True))


def component_rows(parts: DataFrame) -> DataFrame:
    """The ``type,name,detail`` report rows."""
    caps = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"caps.{c}"), F.lit(c)) for c in ("net", "fs", "cred")])), "|")
    detail = (F.when(F.col("type") == "model", F.concat(
        F.coalesce("provider", F.lit("")), F.when(F.col("local"), F.lit(" (local)")).otherwise(F.lit(""))))
        .when(F.col("type") == "mcp-server", F.concat(
            F.lit("risk="), F.col("risk_level"), F.lit("; caps="), F.coalesce(F.nullif(caps, F.lit("")), F.lit("none"))))
        .otherwise(F.lit("")))
    return parts.select("device", "type", "name", detail.alias("detail"))


def summary(config_files: DataFrame, file_inventory: DataFrame, per_device: bool = True) -> DataFrame:
    """The six counts, per device or for the fleet, from one pass over small typed rows."""
    none = F.lit(None).cast("string")
    prov = providers(config_files).select(
        "device", F.lit("provider").alias("what"), "provider", "agent", "model", none.alias("level"))
    local = local_models(file_inventory).select(
        "device", F.lit("local").alias("what"), none.alias("provider"), none.alias("agent"),
        F.col("name").alias("model"), none.alias("level"))
    mcp = mcp_servers(config_files).select(
        "device", F.lit("mcp").alias("what"), none.alias("provider"), none.alias("agent"), none.alias("model"), "level")
    rows = prov.unionByName(local).unionByName(mcp)
    group = rows.groupBy("device") if per_device else rows.groupBy()
    return group.agg(
        F.countDistinct("provider").alias("providers"), F.count("model").alias("models"),
        F.count_if(F.col("what") == "local").alias("local_models"), F.countDistinct("agent").alias("agents"),
        F.count_if(F.col("what") == "mcp").alias("mcp_servers"), F.count_if(F.col("level") == "high").alias("mcp_high_risk"))


# -- files, extensions, applications -------------------------------------------------------

def is_sensitive(name: Column) -> Column:
    n = F.lower(name)
    out = n.isin(*SENSITIVE_NAMES) | n.startswith(".env.")
    for end in SENSITIVE_ENDINGS:
        out = out | n.endswith(end)
    return out


def sensitive_files(file_inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """Sensitive names per directory; with a ``limit`` the first so many by name, with their ``position``."""
    hits = file_inventory.where(is_sensitive(F.col("name"))).select("device", "dir", "name")
    return hits if limit is None else newest_per_key(hits, ["device", "dir"], [F.col("name").asc()], limit)


def extension_broad(host_permissions: Column, permissions: Column) -> Column:
    wide = literal_array(BROAD_PERMISSIONS, "string")
    has = lambda a: F.coalesce(F.arrays_overlap(F.array_compact(a), wide), F.lit(False))
    return has(host_permissions) | has(permissions)


def resolve_extension_names(ext: DataFrame, messages: DataFrame) -> DataFrame:
    """``__MSG_key__`` names through ``messages(device, ext_id, locale, key, message)``:
    default locale, then en, then en_US; keys compare without case; else the id."""
    key = F.lower(F.regexp_extract("name", r"^(?:__MSG_)+(.*?)(?:__)*$", 1))
    work = ext.withColumn("__key", F.when(F.col("name").startswith("__MSG_"), key))
    m = messages.select("device", "ext_id", F.lower("key").alias("__key"), "locale", "message")
    joined = work.join(m, ["device", "ext_id", "__key"], "left")
    order = F.when(F.col("locale") == F.coalesce("default_locale", F.lit("en")), 0).when(
        F.col("locale") == "en", 1).when(F.col("locale") == "en_US", 2)
    keys = ext.columns
    best = joined.groupBy(*keys, "__key").agg(F.min_by("message", order).alias("__m"))
    return best.withColumn("name", F.when(F.col("__key").isNull(), F.coalesce("name", "ext_id"))
                           .otherwise(F.coalesce("__m", "ext_id"))).select(*keys)


def extension_inventory(ext: DataFrame, messages: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct extensions per device and browser; with a ``limit`` the first so many by id.

    ``ext``: device, browser, ext_id, name, default_locale, host_permissions,
    permissions, kind, location.  Firefox counts profile extensions only and
    reports no permissions; Temp and dot entries are skipped."""
    fox = F.col("browser") == "Firefox"
    kept = ext.where(F.when(fox, (F.col("kind") == "extension") & (F.col("location") == "app-profile"))
                     .otherwise(~F.col("ext_id").startswith(".") & (F.col("ext_id") != "Temp")))
    kept = kept.withColumn("broad", ~fox & extension_broad(F.col("host_permissions"), F.col("permissions")))
    one = kept.groupBy("device", "browser", "ext_id").agg(
        F.min(F.struct("name", "default_locale", "broad")).alias("x")).select("device", "browser", "ext_id", "x.*")
    if limit is not None:
        one = newest_per_key(one, ["device", "browser"], [F.col("ext_id").asc()], limit)
    named = resolve_extension_names(one, messages) if messages is not None else one
    return named.select("device", "browser", "ext_id", "name", "broad")


def ai_tools(file_inventory: DataFrame, apps=AI_APPS) -> DataFrame:
    """(device, tool): known AI applications present on a device, names only.

    The install table is fixed and tiny, so it is a literal next to the row."""
    full = F.concat_ws("/", F.rtrim(F.col("dir"), F.lit("/")), F.col("name"))
    table = F.array(*[F.struct(F.lit(tool).alias("tool"), F.lit(path).alias("path")) for tool, path in apps])
    rows = file_inventory.select("device", F.explode(F.transform(
        F.filter(table, lambda a: full.endswith(a["path"])), lambda a: a["tool"])).alias("tool"))
    return rows.distinct()


def unapproved_tools(tools: DataFrame, approved: DataFrame) -> DataFrame:
    return salted_join(tools, approved.select("tool").distinct(), ["tool"], "left_anti")
