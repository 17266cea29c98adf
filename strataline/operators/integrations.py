"""Discovery of external integrations from configuration, package and code signals.

Signals are matched to rules as DataFrame expressions; what matches goes, together by
snapshot and detector, through ``route``: evidence moves a candidate's technology and so
where later evidence goes, which no built-in operator expresses. A group is the matching
signals of one repository for one detector.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONNECTION_RULES, HOST_PASSWORD, INTERNAL_HOST, SECRET_SETTING
from ..schema import EVIDENCE_KINDS

Rules = tuple[tuple[str, tuple[str, ...]], ...]
#: A configuration rule: (key path, value) -> (logical name, technology, endpoint) or None.
ConfigRule = Callable[[str, "str | None"], "tuple[str, str, str | None] | None"]


def connection_kind(value: str | None) -> str:
    text = (value or "").strip().lower()
    for kind, alternatives in CONNECTION_RULES:
        for texts in alternatives:
            if all(text.startswith(t[1:]) if t[0] == "^" else t in text for t in texts):
                return kind
    return "Unknown"


def redacted(value: str | None) -> str | None:
    """Values of secret settings, and passwords before a host, become ``***``."""
    if value is None:
        return None
    return re.sub(HOST_PASSWORD, r"\1:***@", re.sub(SECRET_SETTING, r"\1\2\3***", value))


def logical_id(name: str | None) -> str:
    text = re.sub(r"[^\w]|_", "-", (name or "").strip().lower()).strip("-")
    return text or "default"


def _has(text: str, *words: str) -> bool:
    low = text.lower()
    return any(w.lower() in low for w in words)


def _segments(key: str) -> list[str]:
    return [p for p in key.split(":") if p]


def _after(parts: list[str], names: tuple[str, ...]) -> tuple[int, str | None]:
    """Where one of the names stands, and the segment behind it."""
    at = next((k for k, p in enumerate(parts) if p.lower() in names), -1)
    return at, parts[at + 1] if 0 <= at < len(parts) - 1 else None


def absolute(value: str) -> str | None:
    """scheme://host[:port] of an absolute URI, without a default port."""
    try:
        parts = urlsplit(value.strip())
        port = parts.port
    except ValueError:
        return None
    if not parts.scheme or not parts.hostname or "://" not in value:
        return None
    usual = {"http": 80, "https": 443, "ftp": 21}.get(parts.scheme.lower())
    return f"{parts.scheme.lower()}://{parts.hostname}" + ("" if port in (None, usual) else f":{port}")


def http_endpoint(value: str) -> str:
    return absolute(value) or absolute("http://" + value) or value


def internal_host(host: str) -> bool:
    h = host.lower()
    return h != "" and (bool(re.search(INTERNAL_HOST, h)) or "." not in h)


# --- configuration rules -------------------------------------------------------------------

def _database_config(key: str, value: str | None):
    parts = _segments(key)
    if not parts:
        return None
    head, second = parts[0].lower(), parts[1] if len(parts) > 1 else None
    if head in ("mongo", "mongodb"):
        return second or "default", "MongoDB", value
    if head in ("cosmos", "cosmosdb"):
        name = "cosmos" if second is None or second.lower() in ("endpoint", "key", "connectionstring") else second
        return name, "CosmosDb", value if _has(key, "Endpoint", "ConnectionString") else None
    if _has(key, "Oracle"):
        return "oracle", "Oracle", value
    at, name = _after(parts, ("connectionstrings", "connectionstring"))
    kind = connection_kind(value)
    if at < 0 or kind in ("ServiceBus", "Storage"):
        return None
    return name or "default", "Database" if kind == "Unknown" else kind, value


def _cache_config(key: str, value: str | None):
    if _has(key, "Redis"):
        return "redis", "Redis", value
    at, name = _after(_segments(key), ("cache", "caches"))
    return (name or "default", "Cache", value) if at >= 0 else None


def _bus_config(key: str, value: str | None):
    for word, technology, name in (("ServiceBus", "AzureServiceBus", "servicebus"), ("RabbitMq", "RabbitMQ", "rabbitmq"), ("EventGrid", "AzureEventGrid", "eventgrid"),
                                   ("MassTransit", "MassTransit", "masstransit"), ("Kafka", "Kafka", "kafka"), ("EventHubs", "EventHubs", "eventhubs")):
        if _has(key, word):
            return name, technology, value if word == "ServiceBus" or word == "EventGrid" and _has(key, "Endpoint") else None
    if _has(key, "ConnectionStrings") and connection_kind(value) == "ServiceBus":
        return "servicebus", "AzureServiceBus", value
    return None


def _http_config(key: str, value: str | None):
    parts = _segments(key)
    if len(parts) < 2:
        return None
    last, gateway = parts[-1].lower(), _has(key, "Apim", "ApiManagement")
    technology = "AzureApiManagement" if gateway else "HttpClient"
    at, name = _after(parts, ("httpclients", "httpclient"))
    if name is not None and last in ("baseurl", "baseaddress"):
        return name, technology, value
    at, name = _after(parts, ("grpc", "grpcclients"))
    if at >= 0 and last in ("address", "baseurl"):
        return name or "default", "Grpc", value
    at, name = _after(parts, ("api", "apis", "services"))
    if at >= 0 and last in ("baseurl", "baseaddress", "url"):
        return name or "default", technology, value
    return ("apim", "AzureApiManagement", value) if gateway else None


def _storage_config(key: str, value: str | None):
    if not _has(key, "Storage", "Blob", "S3"):
        return None
    return "default", "S3" if _has(key, "S3") else "AzureBlob" if _has(key, "Blob") else "Storage", value


def _vault_config(key: str, value: str | None):
    if not _has(key, "KeyVault", "VaultUri", "VaultUrl"):
        return None
    return "keyvault", "AzureKeyVault", value if _has(key, "Uri", "Url") else None


def _telemetry_config(key: str, value: str | None):
    if not (_has(key, "OpenTelemetry") or key.upper().startswith("OTEL_")):
        return None
    return "opentelemetry", "OpenTelemetry", value if _has(key, "Endpoint") else None


# --- detectors ---------------------------------------------------------------------------------

USUAL = {"config": 0.6, "invocation": 0.3, "type": 0.2, "package": 0.2, "env": 0.2, "secret": 0.2, "literal": 0.15, "unresolved": -0.1, "key": 0.3}


@dataclass(frozen=True)
class Detector:
    """The fixed rules of one kind of integration.

    Rules are ordered; a technology's patterns are alternatives, ``a&b`` asks for both;
    case is ignored. An argument rule adds what the argument at an index means.
    ``routing``: by technology, to the only candidate or the default one, or to all there are.
    """

    kind: str
    generic: str
    config: ConfigRule
    packages: Rules
    invocations: Rules
    types: Rules
    arguments: tuple[tuple[str, tuple[str, ...], dict[int, str]], ...] = ()
    keys: tuple[str, ...] = ()
    routing: str = "technology"
    default: str = "default"
    weights: dict[str, float] = field(default_factory=lambda: USUAL)
    connection_keys: bool = False
    key_start: str = ""


# The rules of every detector, in their order.
DETECTORS: tuple[Detector, ...] = (
    Detector(
        "Database", "Database", _database_config,
        packages=(("SqlServer", ("Microsoft.EntityFrameworkCore.SqlServer", "Microsoft.Data.SqlClient")), ("PostgreSQL", ("Npgsql",)), ("MySql", ("Pomelo.EntityFrameworkCore.MySql", "MySql.Data", "MySqlConnector")),
                  ("Sqlite", ("Microsoft.EntityFrameworkCore.Sqlite",)), ("MongoDB", ("MongoDB.Driver",)), ("CosmosDb", ("Microsoft.Azure.Cosmos",)), ("Oracle", ("Oracle.ManagedDataAccess",)),
                  ("Dapper", ("Dapper",)), ("EntityFramework", ("Microsoft.EntityFrameworkCore",))),
        invocations=(("SqlServer", ("UseSqlServer",)), ("PostgreSQL", ("UseNpgsql",)), ("MySql", ("UseMySql",)), ("Sqlite", ("UseSqlite",)), ("EntityFramework", ("AddDbContext",)),
                     ("MongoDB", ("MongoClient.GetDatabase",)), ("Dapper", ("Dapper&Query", "Dapper&Execute"))),
        types=(("EntityFramework", ("DbContext",)), ("SqlServer", ("SqlConnection",)), ("Sqlite", ("SqliteConnection",)),
               ("MongoDB", ("MongoDB.Driver.MongoClient", "MongoDB.Driver.IMongoClient", "MongoDB.Driver.IMongoDatabase")), ("CosmosDb", ("Microsoft.Azure.Cosmos.CosmosClient",)), ("Oracle", ("OracleConnection",))),
        arguments=(("SqlServer", ("SqlConnection",), {0: "endpoint"}), ("Oracle", ("OracleConnection",), {0: "endpoint"}), ("MongoDB", ("MongoClient",), {0: "endpoint"}),
                   ("CosmosDb", ("CosmosClient",), {0: "endpoint", 1: "secret"})),
        keys=("ConnectionStrings", "Db", "Database", "Sql", "Postgres", "Npgsql", "Mongo", "Cosmos", "Oracle"), connection_keys=True),
    Detector(
        "Cache", "Cache", _cache_config,
        packages=(("Redis", ("StackExchange.Redis", "Microsoft.Extensions.Caching.StackExchangeRedis", "Microsoft.Extensions.Caching.Redis")),),
        invocations=(("Redis", ("AddStackExchangeRedisCache", "AddDistributedRedisCache")),),
        types=(("DistributedCache", ("IDistributedCache",)), ("Redis", ("ConnectionMultiplexer",))),
        arguments=(("Redis", ("ConnectionMultiplexer",), {0: "endpoint"}),), keys=("Redis", "Cache"), routing="single"),
    Detector(
        "MessageBus", "MessageBus", _bus_config,
        packages=(("AzureServiceBus", ("Azure.Messaging.ServiceBus",)), ("AzureEventGrid", ("Azure.Messaging.EventGrid",)), ("MassTransit", ("MassTransit",)), ("RabbitMQ", ("RabbitMQ.Client",)), ("Kafka", ("Confluent.Kafka",))),
        invocations=(("RabbitMQ", ("RabbitMQ.Client", "BasicPublish", "BasicConsume")), ("AzureServiceBus", ("CreateSender", "CreateProcessor", "CreateReceiver", "ServiceBusClient")),
                     ("AzureEventGrid", ("EventGridPublisherClient",)), ("MassTransit", ("AddMassTransit",)), ("MessageBus", ("Publish", "Consume", "Send"))),
        types=(("AzureServiceBus", ("ServiceBusClient",)), ("AzureEventGrid", ("EventGridPublisherClient",)), ("RabbitMQ", ("RabbitMQ.Client",)), ("MassTransit", ("IPublishEndpoint", "IBus", "IConsumer")),
               ("RabbitMQ", ("RabbitMQ",)), ("Kafka", ("Kafka",))),
        arguments=(("AzureServiceBus", ("ServiceBusClient",), {0: "endpoint"}), ("AzureEventGrid", ("EventGridPublisherClient",), {0: "endpoint"}),
                   ("AzureServiceBus", ("CreateSender", "CreateProcessor", "CreateReceiver"), {0: "entity"}), ("RabbitMQ", ("BasicPublish", "BasicConsume"), {0: "entity"})),
        keys=("ServiceBus", "Rabbit", "MassTransit", "Queue", "Topic", "EventGrid", "Kafka")),
    Detector(
        "HttpApi", "HttpClient", _http_config,
        packages=(("Grpc", ("Grpc.Net.Client", "Microsoft.Extensions.Http&Grpc", "System.Net.Http&Grpc")), ("HttpClient", ("Microsoft.Extensions.Http", "System.Net.Http"))),
        invocations=(("HttpClient", ("HttpClient",)), ("Grpc", ("GrpcChannel.ForAddress",))),
        types=(("HttpClient", ("System.Net.Http.HttpClient",)), ("Grpc", ("Grpc.Net.Client.GrpcChannel",))),
        arguments=(("HttpClient", ("AddHttpClient",), {0: "name"}), ("Grpc", ("GrpcChannel.ForAddress",), {0: "endpoint"}), ("HttpClient", ("System.Uri",), {0: "endpoint"})),
        keys=("Http", "Api")),
    Detector(
        "Storage", "Storage", _storage_config,
        packages=(("AzureBlob", ("Azure.Storage.Blobs",)), ("S3", ("AWSSDK.S3",)), ("Minio", ("Minio",))),
        invocations=(("AzureBlob", ("GetBlobContainerClient", "BlobServiceClient")), ("S3", ("AmazonS3Client",)), ("Minio", ("MinioClient",))),
        types=(("AzureBlob", ("BlobServiceClient", "BlobContainerClient")), ("S3", ("AmazonS3Client",)), ("Minio", ("MinioClient",))),
        arguments=(("AzureBlob", ("BlobServiceClient",), {0: "endpoint"}), ("AzureBlob", ("GetBlobContainerClient",), {0: "container"})),
        keys=("Storage", "Blob", "S3"), routing="single"),
    Detector(
        "Secrets", "AzureKeyVault", _vault_config,
        packages=(("AzureKeyVault", ("Azure.Security.KeyVault.Secrets", "Azure.Extensions.AspNetCore.Configuration.Secrets")),),
        invocations=(("AzureKeyVault", ("SecretClient", "GetSecret", "SetSecret")),), types=(("AzureKeyVault", ("SecretClient",)),),
        arguments=(("AzureKeyVault", ("SecretClient",), {-1: "vault"}), ("AzureKeyVault", ("GetSecret", "SetSecret", "ISecretProvider"), {-1: "secret_name"})), routing="single", default="keyvault"),
    Detector(
        "Observability", "OpenTelemetry", _telemetry_config,
        packages=(("OpenTelemetry", ("OpenTelemetry",)),), invocations=(("OpenTelemetry", ("AddOpenTelemetry", "AddOtlpExporter", "AddConsoleExporter", "AddAzureMonitor")),),
        types=(("OpenTelemetry", ("OpenTelemetry", "TracerProviderBuilder", "MeterProviderBuilder")),), keys=("OpenTelemetry",), key_start="OTEL_", routing="existing", default="opentelemetry",
        weights=USUAL | {"config": 0.2, "invocation": 0.4, "type": 0.1, "package": 0.3, "key": 0.2}),
)

# What the profile ``work`` lets through.
WORK_TECHNOLOGIES = ("SqlServer", "Oracle", "CosmosDb", "Redis", "AzureServiceBus", "AzureEventGrid", "AzureKeyVault", "MassTransit", "HttpClient", "AzureApiManagement", "AzureBlob", "Storage", "OpenTelemetry")
PROFILES = {"work": (tuple(d.kind for d in DETECTORS), WORK_TECHNOLOGIES)}


def register_detector(detector: Detector, config_words: tuple[str, ...], profiles: tuple[str, ...] = ("work",), technologies: tuple[str, ...] = ()) -> None:
    """Adds a detector: its rules, the words that its configuration keys hold, and what of it profiles let through."""
    global DETECTORS
    DETECTORS = (*(d for d in DETECTORS if d.kind != detector.kind), detector)
    CONFIG_WORDS[detector.kind] = config_words
    for name in profiles:
        kinds, known = PROFILES.get(name, ((), ()))
        PROFILES[name] = (tuple(dict.fromkeys((*kinds, detector.kind))), tuple(dict.fromkeys((*known, *technologies))))


def profile(name: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Kinds and technologies of a profile; blank means ``work``."""
    key = (name or "").strip().lower() or "work"
    if key not in PROFILES:
        raise ValueError(f"unknown integration profile {name!r}")
    return PROFILES[key]


def matched(text: str, rules: Iterable[tuple[str, tuple[str, ...]]]) -> str | None:
    low = text.lower()
    for technology, patterns in rules:
        if any(all(part.lower() in low for part in p.split("&")) for p in patterns):
            return technology
    return None


# --- routing and folding -----------------------------------------------------------------------

class Candidate:
    def __init__(self, kind: str, technology: str, name: str):
        self.id = f"ext:{kind.lower()}:{logical_id(name)}"
        self.kind, self.technology, self.name = kind, technology, name
        self.endpoint: str | None = None
        self.source: str | None = None
        self.confidence = 0.0
        self.evidence: dict[tuple, tuple] = {}
        self.attributes: dict[str, str] = {}
        self.used_by: set[str] = set()

    def add(self, kind: str, details: str, weight: float, node: str | None = None, path: str | None = None, line: int | None = None) -> None:
        self.evidence.setdefault((EVIDENCE_KINDS.index(kind), path or "", -1 if line is None else line, details or ""), (kind, path, line, details))
        self.confidence = min(1.0, max(0.0, self.confidence + weight))
        if node:
            self.used_by.add(node)

    def offer(self, endpoint: str | None, source: str) -> None:
        if not (self.endpoint or "").strip() and (endpoint or "").strip():
            self.endpoint = endpoint
            self.source = self.source or source

    def set(self, key: str, value: str | None) -> None:
        if not (value or "").strip():
            return
        old = self.attributes.get(key)
        if old is None:
            self.attributes[key] = value
        elif old != value:
            self.attributes[key] = old if old.lower() == value.lower() else f"{old},{value}"

    def row(self) -> dict:
        return {"id": self.id, "kind": self.kind, "technology": self.technology, "logical_name": self.name, "endpoint": redacted(self.endpoint), "endpoint_source": self.source,
                "confidence": self.confidence, "evidence": [dict(zip(("kind", "file_path", "line", "details"), e)) for _, e in sorted(self.evidence.items())],
                "attributes": sorted(self.attributes.items()), "used_by": sorted(self.used_by)}


_NOISE = frozenset("http https api base url uri endpoint client".split())


class Router:
    """The candidates of one detector over one repository's signals, in their order."""

    def __init__(self, detector: Detector):
        self.d, self.found = detector, {}
        self.by_node: dict[str, list[tuple[str, str]]] = {}
        self.named: set[str] = set()  # candidates whose entity a call names

    # which candidates a signal reaches

    def get(self, name: str, technology: str) -> Candidate:
        new = Candidate(self.d.kind, technology, name)
        return self.found.setdefault(new.id, new)

    def reached(self, technology: str) -> list[Candidate]:
        d, every = self.d, list(self.found.values())
        if d.routing == "existing":
            return every
        if len(every) == 1 and (d.routing == "single" or every[0].technology.lower() != technology.lower()):
            self.upgrade(every[0], technology)
            return every
        if d.routing == "single":
            one = self.get(d.default, technology)
            self.upgrade(one, technology)
            return [one]
        if not every:
            return [self.get(d.default, technology)]
        same = [c for c in every if c.technology.lower() == technology.lower()]
        if same and d.kind == "HttpApi" and technology == "HttpClient":
            same += [c for c in every if c.technology == "AzureApiManagement"]
        return same or every

    def upgrade(self, c: Candidate, technology: str) -> None:
        if self.d.kind == "HttpApi":
            if c.technology == "HttpClient" and technology == "Grpc":
                c.technology = technology
        elif c.technology == self.d.generic and technology != self.d.generic:
            c.technology = technology

    # what is known about keys that a node reads

    def learn(self, node: str, target: str, value: str | None, resolved: bool) -> None:
        if not resolved or not (value or "").strip():
            return
        if _has(target, "GetEnvironmentVariable"):
            kind = "EnvVarKey"
        elif self.d.connection_keys and _has(target, "GetConnectionString"):
            kind, value = "ConfigKey", f"ConnectionStrings:{value}"
        elif _has(target, "IConfiguration"):
            kind = "ConfigKey"
        elif _has(target, "GetSecret", "ISecretProvider") and self.d.kind != "Observability":
            kind = "SecretName"
        else:
            return
        if _has(value, *self.d.keys) or self.d.key_start and value.upper().startswith(self.d.key_start):
            held = self.by_node.setdefault(node, [])
            if (kind, value) not in held:
                held.append((kind, value))

    def tell(self, c: Candidate, node: str) -> None:
        """Adds what is known of the node's keys."""
        w = self.d.weights
        for kind, details in self.by_node.get(node, ()):
            if self.d.kind == "HttpApi" and not self.about(c, kind, details):
                continue
            c.add(kind, details, {"EnvVarKey": w["env"], "SecretName": w["secret"]}.get(kind, w["key"]), node)
            if self.d.kind == "HttpApi" and c.technology == "HttpClient" and _has(details, "Apim", "ApiManagement"):
                c.technology = "AzureApiManagement"

    @staticmethod
    def about(c: Candidate, kind: str, details: str) -> bool:
        """Whether a key speaks of this HTTP candidate."""
        mine = logical_id(c.name).replace("-", "")
        if mine == "default":
            return True
        key = None
        if kind == "ConfigKey":
            parts = _segments(details)
            key = _after(parts, ("httpclients", "httpclient"))[1] or _after(parts, ("api", "apis", "services"))[1] or ("apim" if _has(details, "Apim", "ApiManagement") else None)
        else:
            rest = [p for p in re.split(r"[_:-]", details) if p and p.lower() not in _NOISE]
            key = "".join(rest) if rest else None
        if key is not None:
            return logical_id(key).replace("-", "") == mine
        return c.name.lower() in details.lower()

    # HTTP endpoints and gateways

    def http(self, c: Candidate, endpoint: str | None, source: str, key: str | None) -> None:
        if not (endpoint or "").strip():
            return
        text = http_endpoint(endpoint)
        c.offer(text, source)
        host = urlsplit(text).hostname if "://" in text else None
        if key and _has(key, "Internal"):
            c.set("scope", "internal")
        elif key and _has(key, "External"):
            c.set("scope", "external")
        elif host:
            c.set("scope", "internal" if internal_host(host) else "external")

    @staticmethod
    def gateway(c: Candidate, endpoint: str | None, name: str | None) -> None:
        if c.technology == "HttpClient" and endpoint and _has(endpoint, "azure-api.net", "apim") or name and _has(name, "apim", "api-management"):
            c.technology = "AzureApiManagement"

    # the five phases

    def config(self, key: str, value: str | None, path: str | None, line: int | None) -> None:
        hit = self.d.config(key, value)
        if not hit:
            return
        name, technology, endpoint = hit
        c = self.get(name, technology)
        if self.d.kind == "HttpApi":
            self.http(c, endpoint, "Config", key)
            self.gateway(c, c.endpoint or endpoint, c.name)
        else:
            if self.d.kind != "Cache":
                self.upgrade(c, technology)
            c.offer(absolute(endpoint or "") or endpoint if self.d.kind == "Storage" else endpoint, "Config")
        c.add("ConfigKey", key, self.d.weights["config"], path=path, line=line)

    def package(self, name: str, path: str | None, line: int | None) -> None:
        technology = matched(name, self.d.packages)
        if technology:
            for c in [self.get(self.d.default, technology)] if self.d.routing == "existing" else self.reached(technology):
                c.add("PackageReference", name, self.d.weights["package"], path=path, line=line)

    def argument(self, node: str, target: str, index: int, value: str | None, resolved: bool) -> None:
        w, given = self.d.weights, resolved and bool((value or "").strip())
        if self.d.kind == "HttpApi" and given and index == 0 and _has(target, "Headers.Add") and value.lower() == "ocp-apim-subscription-key":
            named = [c for c in self.found.values() if _has(c.name, "apim", "api-management")] + [c for c in self.found.values() if c.technology == "AzureApiManagement"]
            c = named[0] if named else self.get("apim", "AzureApiManagement")
            c.technology = "AzureApiManagement"
            c.add("Invocation", value, w["invocation"], node)
            self.tell(c, node)
        rule = next((r for r in self.d.arguments if _has(target, *r[1])), None)
        if rule is None or not (role := rule[2].get(index, rule[2].get(-1))):
            return
        technology = rule[0]
        if self.d.kind == "HttpApi":
            name = value if role == "name" and given else "default"
            targets = [self.get(name, technology)]
        else:
            targets = self.reached(technology)
        for c in targets:
            if self.d.kind == "HttpApi":
                if role == "endpoint" and given:
                    self.http(c, value, "Literal", None)
                self.gateway(c, c.endpoint, c.name if role == "name" else None)
            elif role in ("endpoint", "vault") and given:
                c.offer(absolute(value) or value if self.d.kind == "Storage" else value, "Literal")
            elif role == "entity":
                self.named.add(c.id)
                if given:
                    c.set("EntityName", value)
            elif role == "container":
                c.set("container", value if (value or "").strip() else None if "container" in c.attributes else "unknown")
            if role == "vault":
                continue
            if role == "secret_name":
                c.add("SecretName" if resolved else "UnresolvedName", value if given else target, w["secret"] if resolved else w["unresolved"], node)
                if given:
                    c.set("SecretName", value)
                continue
            c.add("Invocation" if resolved else "UnresolvedName", target, w["literal"] if resolved else w["unresolved"], node)
            self.tell(c, node)

    def invocation(self, node: str, name: str) -> None:
        technology = matched(name, self.d.invocations)
        if self.d.kind == "MessageBus" and (entity := matched(name, (("AzureServiceBus", ("CreateSender", "CreateProcessor", "CreateReceiver")), ("RabbitMQ", ("BasicPublish", "BasicConsume"))))):
            technology = entity
        else:
            entity = None
        if not technology:
            return
        for c in self.reached(technology):
            c.add("Invocation", name, self.d.weights["invocation"], node)
            self.tell(c, node)
            if entity:
                self.named.add(c.id)
            if self.d.kind == "Storage" and _has(name, "GetBlobContainerClient") and "container" not in c.attributes:
                c.set("container", "unknown")

    def type(self, node: str, name: str) -> None:
        technology = matched(name, self.d.types)
        if technology:
            for c in self.reached(technology):
                c.add("RoslynSymbol", name, self.d.weights["type"], node)
                self.tell(c, node)

    def done(self) -> list[Candidate]:
        for c in self.found.values():
            if c.id in self.named and "EntityName" not in c.attributes:
                c.set("EntityName", "unresolved")
        return [c for _, c in sorted(self.found.items()) if c.confidence > 0]


PHASES = ("config", "package", "argument", "invocation", "type")


def route(detector: Detector, signals: Iterable[dict]) -> list[Candidate]:
    """Runs ordered signals (phase, node_id, text, value, argument_index, is_resolved, file_path, line) through a detector."""
    router, rows = Router(detector), list(signals)
    if detector.kind != "Secrets":
        for s in rows:
            if s["phase"] == "argument":
                router.learn(s["node_id"], s["text"], s["value"], bool(s["is_resolved"]))
    for s in rows:
        if s["phase"] == "config":
            router.config(s["text"], s["value"], s["file_path"], s["line"])
        elif s["phase"] == "package":
            router.package(s["text"], s["file_path"], s["line"])
        elif s["phase"] == "argument":
            router.argument(s["node_id"], s["text"], s["argument_index"], s["value"], bool(s["is_resolved"]))
        elif s["phase"] == "invocation":
            router.invocation(s["node_id"], s["text"])
        else:
            router.type(s["node_id"], s["text"])
    return router.done()


# --- signals as tables ---------------------------------------------------------------------------

SIGNAL_COLUMNS = ("snapshot_id", "phase", "position", "node_id", "text", "value", "argument_index", "is_resolved", "file_path", "line")
_ARGUMENTS = "array<struct<Target:string,ArgumentIndex:int,Value:string,IsResolved:boolean>>"


def graph_signals(nodes: DataFrame) -> DataFrame:
    """Signals of nodes (snapshot_id, id, kind, attributes): calls, type usages and call arguments, in id and list order."""
    a = F.col("attributes")

    def shaped(rows: DataFrame, phase: str, text: Column, value=None, index=None, resolved=None) -> DataFrame:
        none = F.lit(None)
        return rows.select(
            "snapshot_id", F.lit(phase).alias("phase"), F.struct(F.col("id").alias("a"), F.lit("").alias("b"), F.col("pos").alias("c")).alias("position"), F.col("id").alias("node_id"), text.alias("text"),
            (none if value is None else value).cast("string").alias("value"), (none if index is None else index).cast("int").alias("argument_index"),
            (none if resolved is None else resolved).cast("boolean").alias("is_resolved"), none.cast("string").alias("file_path"), none.cast("int").alias("line"))

    methods, types = nodes.where("kind = 'Method'"), nodes.where("kind = 'Type'")
    calls = methods.select("snapshot_id", "id", F.posexplode(F.from_json(a["externalCalls"], "array<string>")).alias("pos", "x"))
    uses = types.select("snapshot_id", "id", F.posexplode(F.from_json(a["dependsOnTypes"], "array<string>")).alias("pos", "x"))
    args = methods.select("snapshot_id", "id", F.posexplode(F.from_json(a["invocationArguments"], _ARGUMENTS)).alias("pos", "x")).where("x.Target is not null and trim(x.Target) <> ''")
    x = F.col("x")
    return (shaped(calls.where("trim(x) <> ''"), "invocation", x).unionByName(shaped(uses.where("trim(x) <> ''"), "type", x))
            .unionByName(shaped(args, "argument", x["Target"], x["Value"], F.coalesce(x["ArgumentIndex"], F.lit(0)), F.coalesce(x["IsResolved"], F.lit(False)))))


def config_signals(entries: DataFrame) -> DataFrame:
    """Signals of configuration entries (snapshot_id, key_path, value, file_path, line), in key and file order."""
    position = F.struct(F.lower("key_path").alias("a"), F.lower("file_path").alias("b"), F.coalesce("line", F.lit(0)).alias("c"))
    return _file_signals(entries, "config", "key_path", position, F.col("value"))


def package_signals(packages: DataFrame) -> DataFrame:
    """Signals of package references (snapshot_id, name, file_path, line), in name, file and line order."""
    position = F.struct(F.lower("name").alias("a"), F.lower("file_path").alias("b"), F.coalesce("line", F.lit(0)).alias("c"))
    return _file_signals(packages, "package", "name", position, F.lit(None).cast("string"))


def _file_signals(rows: DataFrame, phase: str, text: str, position: Column, value: Column) -> DataFrame:
    return rows.select("snapshot_id", F.lit(phase).alias("phase"), position.alias("position"), F.lit(None).cast("string").alias("node_id"), F.col(text).alias("text"), value.alias("value"),
                       F.lit(None).cast("int").alias("argument_index"), F.lit(None).cast("boolean").alias("is_resolved"), "file_path", "line")


# Targets whose arguments name the keys that a method reads.
KEY_TARGETS = ("GetEnvironmentVariable", "GetConnectionString", "IConfiguration", "GetSecret", "ISecretProvider")
CONFIG_WORDS = {
    "Database": ("Mongo", "Cosmos", "Oracle", "ConnectionString"), "Cache": ("Redis", "Cache"), "MessageBus": ("ServiceBus", "RabbitMq", "EventGrid", "MassTransit", "Kafka", "EventHubs", "ConnectionStrings"),
    "HttpApi": ("HttpClient", "Grpc", "Api", "Services", "Apim"), "Storage": ("Storage", "Blob", "S3"), "Secrets": ("KeyVault", "VaultUri", "VaultUrl"), "Observability": ("OpenTelemetry", "OTEL_")}


def _any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns stands in the (lower-case) text."""
    tests = [reduce(lambda a, b: a & b, (text.contains(p.lower()) for p in pattern.split("&"))) for pattern in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def relevant(detector: Detector) -> Column:
    """Signals that a detector could use; the rest never reaches Python."""
    low, phase = F.lower("text"), F.col("phase")
    words = {"config": CONFIG_WORDS[detector.kind], "package": [p for _, ps in detector.packages for p in ps], "invocation": [p for _, ps in detector.invocations for p in ps],
             "type": [p for _, ps in detector.types for p in ps], "argument": [*(p for _, ps, _ in detector.arguments for p in ps), *KEY_TARGETS, *(["Headers.Add"] if detector.kind == "HttpApi" else [])]}
    return reduce(lambda a, b: a | b, ((phase == p) & _any(low, w) for p, w in words.items()))


_EVIDENCE = pa.struct([("kind", pa.string()), ("file_path", pa.string()), ("line", pa.int32()), ("details", pa.string())])
_ROW = pa.schema([("snapshot_id", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("technology", pa.string()), ("logical_name", pa.string()), ("endpoint", pa.string()), ("endpoint_source", pa.string()),
                  ("confidence", pa.float64()), ("evidence", pa.list_(_EVIDENCE)), ("attributes", pa.map_(pa.string(), pa.string())), ("used_by", pa.list_(pa.string()))])
CANDIDATE_SCHEMA = ("snapshot_id string, id string, kind string, technology string, logical_name string, endpoint string, endpoint_source string, confidence double, "
                    "evidence array<struct<kind:string,file_path:string,line:int,details:string>>, attributes map<string,string>, used_by array<string>")


def detect(signals: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Candidates of every snapshot, one row each, with the nodes that use them."""
    chosen = {d.kind: d for d in DETECTORS if kinds is None or d.kind in set(kinds)}
    tagged = F.filter(F.array(*(F.when(relevant(d), F.lit(k)) for k, d in chosen.items())), lambda x: x.isNotNull())
    rows = signals.select(*SIGNAL_COLUMNS).withColumn("detector", F.explode(tagged)).withColumn("order", F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")))

    def solved(found: list[dict]) -> list[dict]:
        found.sort(key=lambda s: (s["order"], *(v if v is not None else "" for v in (s["position"]["a"], s["position"]["b"])), s["position"]["c"] or 0))
        return [{"snapshot_id": found[0]["snapshot_id"]} | c.row() for c in route(chosen[found[0]["detector"]], found)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the signals of one repository and detector
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and (row["snapshot_id"], row["detector"]) != (held[0]["snapshot_id"], held[0]["detector"]):
                    out += solved(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_ROW)
        if held:
            yield pa.RecordBatch.from_pylist(solved(held), schema=_ROW)

    # groups are small and many: sorted runs of a partition cost less than a call for each group
    grouped = rows.repartition("snapshot_id", "detector").sortWithinPartitions("snapshot_id", "detector")
    return grouped.mapInArrow(solve, CANDIDATE_SCHEMA)


def in_profile(candidates: DataFrame, name: str | None = "work") -> DataFrame:
    kinds, technologies = profile(name)
    return candidates.where(F.col("kind").isin(*kinds) & F.lower("technology").isin(*(t.lower() for t in technologies)))


def usage(candidates: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, candidate_id) of the candidates that are left."""
    return candidates.select("snapshot_id", F.explode("used_by").alias("node_id"), F.col("id").alias("candidate_id"))
