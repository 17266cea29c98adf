"""Rules, routing and roll-up of the integration detectors."""

import pytest

from strataline.operators import integrations as I

DETECTOR = {d.kind: d for d in I.DETECTORS}


def signal(phase, text, value=None, node="n", index=0, resolved=True):
    return {"phase": phase, "text": text, "value": value, "node_id": node, "argument_index": index, "is_resolved": resolved, "file_path": "f", "line": 1}


def run(kind, *signals):
    return {c.id: c for c in I.route(DETECTOR[kind], signals)}


def test_generic_technology_is_upgraded_once():
    found = run("Database", signal("config", "ConnectionStrings:Main", "whatever"), signal("package", "Npgsql"), signal("invocation", "UseSqlServer"))
    c = found["ext:database:main"]
    assert (c.technology, round(c.confidence, 2)) == ("PostgreSQL", 1.0)


def test_evidence_of_another_technology_goes_to_all():
    found = run("Database", signal("config", "ConnectionStrings:A", "Server=x"), signal("config", "Mongo:B", "mongodb://x"), signal("invocation", "UseNpgsql"))
    assert {k: round(c.confidence, 2) for k, c in found.items()} == {"ext:database:a": 0.9, "ext:database:b": 0.9}
    found = run("Database", signal("config", "ConnectionStrings:A", "Server=x"), signal("config", "Mongo:B", "mongodb://x"), signal("invocation", "UseSqlServer"))
    assert {k: round(c.confidence, 2) for k, c in found.items()} == {"ext:database:a": 0.9, "ext:database:b": 0.6}


def test_bus_strings_are_no_databases():
    assert not run("Database", signal("config", "ConnectionStrings:Bus", "Endpoint=sb://x"))
    assert "ext:messagebus:servicebus" in run("MessageBus", signal("config", "ConnectionStrings:Bus", "Endpoint=sb://x"))


def test_unresolved_arguments_lower_confidence_but_not_below_zero():
    assert not run("Database", signal("argument", "SqlConnection", None, resolved=False))
    found = run("Database", signal("argument", "SqlConnection", "Server=y"))
    assert found["ext:database:default"].endpoint == "Server=y" and found["ext:database:default"].confidence == 0.15


def test_keys_of_a_node_add_evidence():
    found = run("Database", signal("argument", "GetConnectionString", "Main", node="m"), signal("invocation", "UseSqlServer", node="m"))
    c = found["ext:database:default"]
    assert round(c.confidence, 2) == 0.6 and ("ConfigKey", None, None, "ConnectionStrings:Main") in c.evidence.values() and c.used_by == {"m"}


def test_entity_names():
    found = run("MessageBus", signal("config", "ServiceBus:ConnectionString", "Endpoint=sb://x"), signal("argument", "CreateSender", "orders"))
    assert found["ext:messagebus:servicebus"].attributes == {"EntityName": "orders"}
    found = run("MessageBus", signal("config", "ServiceBus:ConnectionString", "Endpoint=sb://x"), signal("invocation", "c.CreateSender"))
    assert found["ext:messagebus:servicebus"].attributes == {"EntityName": "unresolved"}


def test_gateway_header_and_name():
    found = run("HttpApi", signal("config", "Apim:BaseUrl", "https://contoso.azure-api.net"), signal("argument", "client.DefaultRequestHeaders.Add", "Ocp-Apim-Subscription-Key"))
    c = found["ext:httpapi:apim"]
    assert (c.technology, c.attributes["scope"], round(c.confidence, 2)) == ("AzureApiManagement", "external", 0.9)
    assert run("HttpApi", signal("argument", "AddHttpClient", "Users"))["ext:httpapi:users"].technology == "HttpClient"


def test_storage_and_telemetry():
    found = run("Storage", signal("config", "Storage:ConnectionString", "AccountName=a"), signal("package", "Azure.Storage.Blobs"), signal("argument", "GetBlobContainerClient", None, resolved=False))
    c = found["ext:storage:default"]
    assert (c.technology, c.attributes["container"]) == ("AzureBlob", "unknown")
    assert not run("Observability", signal("invocation", "AddOpenTelemetry"))
    assert round(run("Observability", signal("package", "OpenTelemetry.Api"), signal("invocation", "AddOpenTelemetry"))["ext:observability:opentelemetry"].confidence, 2) == 0.7


def test_vault_secrets():
    found = run("Secrets", signal("argument", "SecretClient", "https://v.vault"), signal("argument", "client.GetSecret", "db-pass"))
    c = found["ext:secrets:keyvault"]
    assert (c.endpoint, c.attributes["SecretName"], round(c.confidence, 2)) == ("https://v.vault", "db-pass", 0.2)


def test_profiles():
    assert "SqlServer" in I.profile(None)[1] and I.profile(" Work ") == I.profile("work")
    with pytest.raises(ValueError):
        I.profile("home")


@pytest.mark.parametrize(("value", "kind"), [("Endpoint=sb://x/;SharedAccessKey=k", "ServiceBus"), ("Server=db;Port=3306;Uid=root", "PostgreSQL"), ("User Id=s;Data Source=orcl;SID=x", "Oracle"), ("Data Source=app.sqlite", "SqlServer"), ("", "Unknown"), (None, "Unknown")])
def test_connection_kinds(value, kind):
    assert I.connection_kind(value) == kind


def test_registered_detector(spark):
    from strataline import queries

    before = I.DETECTORS, dict(I.CONFIG_WORDS), dict(I.PROFILES)
    mine = I.Detector("Search", "Search", lambda key, value: ("main", "Elastic", value) if "elastic" in key.lower() else None, packages=(("Elastic", ("NEST",)),), invocations=(("Elastic", ("IndexDocument",)),), types=(("Elastic", ("ElasticClient",)),))
    try:
        I.register_detector(mine, ("Elastic",), technologies=("Elastic",))
        rows = [("s", "config", "Elastic:Url", "http://e", 0), ("s", "package", "NEST", None, 1), ("s", "type", "Nest.ElasticClient", None, 2)]
        found = I.in_profile(I.detect(queries._signals(spark.createDataFrame(rows, "snapshot_id string, phase string, text string, value string, position int")))).collect()
        assert [(r.id, r.technology, round(r.confidence, 2)) for r in found] == [("ext:search:main", "Elastic", 1.0)]
    finally:
        I.DETECTORS = before[0]
        I.CONFIG_WORDS.pop("Search", None)
        I.PROFILES.clear()
        I.PROFILES.update(before[2])
