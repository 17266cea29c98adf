"""Column functions: identities, parsing, classification. All of them are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_namespace(name: Column) -> Column:
    """The text before the last dot, empty if that is none."""
    return F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)


def parse_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def json_list(text: Column) -> Column:
    """A JSON array of strings; whatever is malformed is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def normalize_path(path: Column) -> Column:
    return F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def trim_global_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^global::", "")


def solution_id(name: Column) -> Column:
    return F.concat(F.lit("solution:"), F.trim(name))


def project_id(path: Column) -> Column:
    return F.concat(F.lit("project:"), normalize_path(path))


def namespace_id(project: Column, namespace: Column) -> Column:
    text = F.trim(F.coalesce(namespace, F.lit("")))
    return F.concat(F.lit("ns:"), project, F.lit(":"), F.when(text == "", "(global)").otherwise(text))


def type_id(project: Column, name: Column) -> Column:
    return F.concat(F.lit("type:"), project, F.lit(":"), name)


def method_id(type_: Column, signature: Column) -> Column:
    return F.concat(F.lit("method:"), type_, F.lit(":"), signature)


def normalize_logical_name(name: Column, default: str = "default") -> Column:
    """Lower case, runs of letters and digits joined by hyphens one for one, blank: the default."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{Nd}]", "-")
    text = F.regexp_replace(text, "^-+|-+$", "")
    return F.when(text == "", F.lit(default)).otherwise(text)


def candidate_id(kind: Column, logical_name: Column, default: str = "default") -> Column:
    return F.concat(F.lit("ext:"), F.lower(kind), F.lit(":"), normalize_logical_name(logical_name, default))


def glob_regex(pattern: str) -> str:
    """An anchored, case-insensitive regular expression of a path glob (``**/``, ``**``, ``*``, ``?``)."""
    out, at = [], 0
    pattern = pattern.replace("\\", "/").strip()
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif pattern.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            c = pattern[at]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
            at += 1
    return "(?i)^" + "".join(out) + "$"


# What is left out of every scan.
DEFAULT_EXCLUDES = ("**/bin/**", "**/obj/**", "**/.git/**", "**/.vs/**", "**/.idea/**", "**/node_modules/**")


def path_included(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = DEFAULT_EXCLUDES) -> Column:
    """Whether globs admit a relative path: exclusion wins, no inclusion admits all, null is out."""
    p = normalize_path(path)

    def matches(globs: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for g in globs:
            found = found | p.rlike(glob_regex(g))
        return found

    admitted = matches(include) if include else F.lit(True)
    return path.isNotNull() & admitted & ~matches(exclude)


# The ordered rules of the connection-string classifier. Each rule is a list
# of alternatives; an alternative's texts must all occur; "^" asks for the start.
CONNECTION_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("ServiceBus", (("endpoint=sb://",), ("sharedaccesskey=",))),
    ("CosmosDb", (("accountendpoint=",), ("documents.azure.com",))),
    ("Storage", (("defaultendpointsprotocol=", "accountkey="),)),
    ("MongoDB", (("^mongodb://",), ("mongodb+srv://",))),
    ("PostgreSQL", (("host=",), ("port=",))),
    ("Oracle", (("service name=",), ("sid=",), ("oracle",))),
    ("SqlServer", (("server=",), ("data source=",))),
    ("MySql", (("uid=",), ("user id=",))),
    ("Sqlite", (("sqlite",),)),
)


def connection_kind(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.lit("Unknown")
    for kind, alternatives in reversed(CONNECTION_RULES):
        any_ = F.lit(False)
        for texts in alternatives:
            all_ = F.lit(True)
            for t in texts:
                all_ = all_ & (text.startswith(t[1:]) if t[0] == "^" else text.contains(t))
            any_ = any_ | all_
        out = F.when(any_, kind).otherwise(out)
    return out


def absolute_endpoint(value: Column) -> Column:
    """scheme://host[:port] of an absolute URI, without a default port; null where it is none."""
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(value, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(value, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | ((scheme == "ftp") & (port == "21"))
    tail = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(scheme.isNotNull() & host.isNotNull() & (host != ""), F.concat(scheme, F.lit("://"), host, tail))


def http_endpoint(value: Column) -> Column:
    """The endpoint of a URL, trying ``http://`` before a text without a scheme; else the text."""
    return F.coalesce(absolute_endpoint(value), absolute_endpoint(F.concat(F.lit("http://"), value)), value)


def endpoint_host(value: Column) -> Column:
    return F.coalesce(F.try_parse_url(http_endpoint(value), F.lit("HOST")), F.lit(""))


# Lower-case hosts that are internal, beside those without a dot.
INTERNAL_HOST = r"^(localhost$|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|\.(local|svc|cluster\.local|internal|localdomain)$"


def internal_host(host: Column) -> Column:
    """Loopback, private ranges, cluster suffixes, or a name without a dot; no name is none."""
    h = F.lower(host)
    return (h != "") & (h.rlike(INTERNAL_HOST) | ~h.contains("."))


def http_scope(key: Column, endpoint: Column) -> Column:
    """internal or external: a word of the key decides first, then the host; null without either."""
    k, host = F.lower(F.coalesce(key, F.lit(""))), endpoint_host(endpoint)
    return (F.when(k.contains("internal"), "internal").when(k.contains("external"), "external")
            .when(host == "", F.lit(None).cast("string")).when(internal_host(host), "internal").otherwise("external"))


# Settings whose values are secret, and passwords before a host.
SECRET_SETTING = r"(?i)(^|[;,&?\s\"'])(Password|Pwd|SharedAccessKey|AccountKey|Key|Secret|Token|SharedAccessSignature)(\s*=\s*)(?!=)(\"[^\"]*\"|'[^']*'|[^;,&\s]+)"
HOST_PASSWORD = r"(?i)([a-z][a-z0-9+.-]*://[^:/@\s]+):[^@/\s]+@"


def redact(value: Column) -> Column:
    """Values of secret settings, and passwords before a host, become ``***``; texts without ``=`` or ``://`` are not searched."""
    out = F.when(F.contains(value, F.lit("=")), F.regexp_replace(value, SECRET_SETTING, "$1$2$3***")).otherwise(value)
    return F.when(F.contains(value, F.lit("://")), F.regexp_replace(out, HOST_PASSWORD, "$1:***@")).otherwise(out)


# Languages by file extension.
LANGUAGES = {".cs": "csharp", ".ts": "typescript", ".js": "javascript", ".java": "java", ".py": "python", ".go": "go", ".rb": "ruby"}


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension)


def source_kind(text: Column) -> Column:
    """url, file (a solution or project, which means its folder), shorthand (owner/repo), path, or none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.when(t == "", "none")
            .when(t.rlike(r"(?i)^(https?|git|ssh)://|^git@[\w.-]+:.*?[/:]\S+\.git$"), "url")
            .when(t.rlike(r"(?i)\.(sln|csproj)$"), "file")
            .when(t.rlike(r"^[\w-]+/[\w.-]+$"), "shorthand")
            .otherwise("path"))


def source_normalized(text: Column) -> Column:
    """What a source means: hosted repositories get their ``.git`` ending, files their folder."""
    t, kind = F.trim(text), source_kind(text)
    hosted = t.rlike(r"(?i)^https?://github\.com/") & ~F.lower(t).endswith(".git")
    return (F.when(kind == "shorthand", F.concat(F.lit("https://github.com/"), t, F.lit(".git")))
            .when(hosted, F.concat(t, F.lit(".git")))
            .when(kind == "file", F.coalesce(F.nullif(F.regexp_extract(normalize_path(t), r"^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))
            .when(kind == "none", F.lit(None).cast("string"))
            .otherwise(t))


def report_format(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t == "", "json").when(t == "serif", "sarif").otherwise(t)


def sloc(text: Column) -> Column:
    """Lines that hold more than white space and closing braces."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.size(F.filter(lines, lambda x: ~x.rlike(r"^[\s}]*$"))).cast("bigint")
