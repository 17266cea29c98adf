"""Trees, archives, settings, C# text, reports and the whole analysis."""

import io
import json
import zipfile

import pytest

from strataline import analysis
from strataline.operators import metrics
from strataline.sinks import reports
from strataline.sources import csharp, files, settings
from strataline.streaming import incremental

APP = """using Microsoft.Data.SqlClient;
namespace App.Infra;
public interface IRepo { void Save(int x); }
public class Repo : IRepo {
  private readonly string _cs;
  private Helper _h;
  public Repo(IConfiguration c) { _cs = c.GetConnectionString("MainDb"); }
  public void Save(int x) {
    if (x > 0 && _cs != null) { var con = new SqlConnection(_cs); con.Open(); }
    _h.Work();
  }
}
public class Helper { private Repo _r; public void Work() { services.AddHttpClient("UsersApi"); } }
"""


@pytest.fixture(scope="module")
def app(tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    (root / "Infra").mkdir()
    (root / "bin").mkdir()
    (root / "App.csproj").write_text('<Project>\n<PackageReference Include="Microsoft.Data.SqlClient"/>\n<PackageReference Include="Microsoft.Extensions.Http"/>\n</Project>')
    (root / "appsettings.json").write_bytes(b'\xef\xbb\xbf{"ConnectionStrings":{"MainDb":"Server=localhost;Password=TopSecret!;"},"HttpClients":{"UsersApi":{"BaseUrl":"http://users-api.local/v1"}}}')
    (root / "Infra" / "Repo.cs").write_text(APP)
    (root / "bin" / "Gen.cs").write_text("class Left { }")
    return root


@pytest.fixture(scope="module")
def snapshot(spark, app):
    return analysis.analyze(spark, str(app))


def test_tree_leaves_built_files_out(spark, app):
    assert sorted(r["path"] for r in files.tree(spark, str(app)).collect()) == ["App.csproj", "Infra/Repo.cs", "appsettings.json"]


def test_analysis(snapshot):
    d = reports.document(snapshot)
    assert d["Metrics"]["Summary"]["TotalTypes"] == 3 and d["Metrics"]["Summary"]["TotalMethods"] == 4
    assert d["Metrics"]["Dependencies"]["Cycles"] == [{"Nodes": ["App.Infra.Helper", "App.Infra.Repo"], "Scope": "Type"}]
    found = {c["Id"]: c for c in d["Integrations"]["Candidates"]}
    assert set(found) == {"ext:database:maindb", "ext:httpapi:usersapi"}
    assert found["ext:database:maindb"]["Confidence"] >= 0.85 and found["ext:httpapi:usersapi"]["Attributes"] == {"scope": "internal"}
    assert "TopSecret" not in json.dumps(d) and "Server=localhost" in found["ext:database:maindb"]["Endpoint"]
    assert d["Integrations"]["UsageByProjectId"] == {"project:App.csproj": ["ext:database:maindb", "ext:httpapi:usersapi"]}
    assert d["Integrations"]["UsageByTypeId"]["type:project:App.csproj:App.Infra.Helper"] == ["ext:httpapi:usersapi"]
    repo = d["Graph"]["Nodes"]["type:project:App.csproj:App.Infra.Repo"]
    assert json.loads(repo["Attributes"]["dependsOnTypes"])[:2] == ["App.Infra.Helper", "App.Infra.IRepo"]
    assert {e["Kind"] for e in d["Graph"]["Edges"]} == {0, 2, 3, 5}


def test_exported_graph_reads_back(spark, snapshot, tmp_path):
    path = tmp_path / "snapshot.json"
    path.write_text(reports.to_json(snapshot))
    again = analysis.analyze(spark, str(path))
    assert reports.csv(again) == reports.csv(snapshot) == "Name,Count\nNamespaces,1\nTypes,3\nMethods,4\nProjects,1\nNamespaceCoupling,1\nTypeCoupling,3\n"


def test_other_reports(snapshot):
    assert "- **TotalTypes**: 3" in reports.markdown(snapshot)
    s = json.loads(reports.sarif(snapshot))
    assert s["version"] == "2.1.0" and s["runs"][0]["properties"]["Methods"] == 4 and s["runs"][0]["results"] == []
    assert reports.resolve("JSON") is reports.to_json
    with pytest.raises(ValueError):
        reports.resolve(" ")
    with pytest.raises(NotImplementedError, match="csv, json, md, sarif"):
        reports.resolve("pdf")


def test_requests(spark, tmp_path):
    for pair in ((None, None), ("a", "b"), (" ", "")):
        with pytest.raises(ValueError):
            analysis.analyze(spark, *pair)
    (tmp_path / "a.py").write_text("x")
    with pytest.raises(NotImplementedError):
        analysis.analyze(spark, str(tmp_path))
    (tmp_path / "a.cs").write_text("class A { }")
    with pytest.raises(NotImplementedError):
        analysis.analyze(spark, str(tmp_path))


def test_clone_arguments():
    assert files.git_arguments("u", "t", "main") == ["clone", "--depth", "1", "-b", "main", "--single-branch", "u", "t"]


def test_archives_cannot_leave_their_folder(tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/b.cs", "x")
        z.writestr("../evil.cs", "x")
    assert files.unzip(held.getvalue(), str(tmp_path / "in")) == ["a/b.cs"] and not (tmp_path / "evil.cs").exists()


def test_settings():
    assert settings.package_references("<a><PackageReference Include=''/></a>") == [] == settings.package_references("<a")
    assert settings.flattened('{"A":{"B":[1.50,null,false]}}') == [("A:B:0", "1.50"), ("A:B:1", ""), ("A:B:2", "False")]


def test_languages(spark):
    rows = spark.createDataFrame([(1, "a.CS"), (1, "b.txt"), (2, "a.cs"), (2, "b.py"), (3, "x")], "k int, path string")
    assert {r["k"]: r["language"] for r in files.detected_language(rows, "k").collect()} == {1: "csharp", 2: None, 3: None}


def test_walkers():
    everything = """for(;;){} foreach(var a in s){} while(x){} do{}while(x); try{}catch(A){}catch(B){} var y = s ?? z; var w = x ? 1 : 2;
        switch(x){ case 1: break; case 2: break; default: break; } var q = x switch { 1 => 2, 2 => 3, _ => 4 };"""
    assert csharp.metrics(everything)["cyclo"] == 14
    assert csharp.metrics("// only\n/* a\n comment */")["sloc"] == 0
    assert csharp.metrics('var s = @"a\nb\nc";')["sloc"] == 3
    assert csharp.metrics("int? x = null; string? y = a;")["cyclo"] == 1


def test_parsing():
    found = {t.name: t for t in csharp.parse("namespace N { public abstract class A<T> : B where T : new() { int f = 1, g; public int P { get; set; } = 2; public string this[int i] => \"\"; event E Ev; void M<U>(List<U> a, int b = 2) { } class Inner { } } record R(int X); }")}
    assert set(found) == {"A", "A.Inner", "R"} and found["A"].is_abstract and found["A"].bases == ["B"]
    assert {"get_P", "set_P", "M"} <= {m["name"] for m in found["A"].methods}
    assert next(m for m in found["A"].methods if m["name"] == "M")["parameters"] == ["List<U>", "int"]


def test_watched_folder(spark, snapshot, tmp_path):
    text = reports.to_json(snapshot)
    (tmp_path / "in").mkdir()

    def run():
        incremental.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
        return {(r.snapshot, r.type_id): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    for name in ("one.json", "two.json"):
        (tmp_path / "in" / name).write_text(text)
    found = run()
    assert len(found) == 6 and sum(r.nom for r in found.values()) == 8
    (tmp_path / "in" / "three.json").write_text(text)
    assert len(run()) == 9
    mine = {r.type_id: r for r in metrics.type_metrics(snapshot.model).collect()}
    for (_, type_id), r in run().items():
        assert all(r[c] == mine[type_id][c] for c in ("sloc", "wmc", "dep", "i_dep", "fan_in", "fan_out", "noa", "lcom3"))


def test_failures_count_only_where_nothing_loaded():
    files.check_loaded(1, ["x"], "r")
    files.check_loaded(0, [], "r")
    with pytest.raises(RuntimeError, match="- x"):
        files.check_loaded(0, ["x"], "r")


def test_receivers_get_their_types():
    found = csharp.parse("""using Microsoft.Azure.Cosmos;
class Repo { private readonly ISecretProvider _secrets; IConfiguration config;
  Repo(CosmosClient client, string name = "x") { var key = _secrets.Get("COSMOS_KEY"); client.CreateDatabase(name); var b = new SqlConnection("Server=x"); b.Open(); this.config.GetSection("Db"); } }""")[0]
    m = found.methods[0]
    assert m["called"] == ["ISecretProvider.Get", "CosmosClient.CreateDatabase", "SqlConnection.Open", "IConfiguration.GetSection"]
    assert [(a["Target"], a["Value"]) for a in m["arguments"]] == [("ISecretProvider.Get", "COSMOS_KEY"), ("CosmosClient.CreateDatabase", None), ("SqlConnection", "Server=x"), ("IConfiguration.GetSection", "Db")]
    assert csharp.qualified("CosmosClient", found.usings) == "Microsoft.Azure.Cosmos.CosmosClient" and csharp.qualified("Widget", found.usings) == "Widget"


SAMPLES = [
    ("Cosmos", "Microsoft.Azure.Cosmos", '{"Cosmos":{"Endpoint":"https://e.documents.azure.com"}}', "using Microsoft.Azure.Cosmos; class R { R(ISecretProvider s) { var c = new CosmosClient(\"https://e\", s.Get(\"COSMOS_KEY\")); } }", ("ext:database:cosmos", "CosmosDb")),
    ("Redis", "StackExchange.Redis", '{"Redis":{"Configuration":"h:6379,password=Hidden1"}}', "class R { void M(S services) { services.AddStackExchangeRedisCache(o => {}); } }", ("ext:cache:redis", "Redis")),
    ("Bus", "Azure.Messaging.ServiceBus", '{"ServiceBus":{"ConnectionString":"Endpoint=sb://x;SharedAccessKey=Hidden2"}}', "class R { void M(ServiceBusClient c) { var s = c.CreateSender(\"orders\"); } }", ("ext:messagebus:servicebus", "AzureServiceBus")),
    ("Blob", "Azure.Storage.Blobs", '{"Storage":{"ConnectionString":"AccountName=a;AccountKey=Hidden3"}}', "class R { void M() { var c = new BlobServiceClient(\"u\"); c.GetBlobContainerClient(\"pics\"); } }", ("ext:storage:default", "AzureBlob")),
    ("Vault", "Azure.Security.KeyVault.Secrets", '{"KeyVault":{"VaultUri":"https://v"}}', "class R { void M(SecretClient c) { c.GetSecret(\"ApiKey\"); } }", ("ext:secrets:keyvault", "AzureKeyVault")),
    ("Otel", "OpenTelemetry.Api", '{"OpenTelemetry":{"OtlpEndpoint":"https://o"}}', "class R { void M(S s) { s.AddOpenTelemetry(); } }", ("ext:observability:opentelemetry", "OpenTelemetry")),
]


def test_samples_are_told_with_confidence(spark, tmp_path):
    for name, package, settings_, code, _ in SAMPLES:
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csproj").write_text(f'<Project><PackageReference Include="{package}"/></Project>')
        (tmp_path / name / "appsettings.json").write_text(settings_)
        (tmp_path / name / "R.cs").write_text(code)
        found = {r.id: r for r in analysis.analyze(spark, str(tmp_path / name)).candidates.collect()}
        want, technology = next(w for n, *_, w in SAMPLES if n == name)
        assert found[want].technology == technology and found[want].confidence >= 0.85, name
        assert "Hidden" not in str(found) and {"PackageReference", "ConfigKey"} <= {e.kind for e in found[want].evidence} and found[want].used_by


def test_what_sources_mean(spark, tmp_path):
    from strataline.sources import files

    (tmp_path / "owner" / "repo").mkdir(parents=True)
    assert files.meant(spark, "owner/repo", None) == (None, "https://github.com/owner/repo.git")
    assert files.meant(spark, None, " https://github.com/o/r ") == (None, "https://github.com/o/r.git")
    assert files.meant(spark, str(tmp_path / "owner" / "repo"), None) == (str(tmp_path / "owner" / "repo"), None)
    assert files.meant(spark, f"{tmp_path}/x/App.sln", None) == (f"{tmp_path}/x", None) and files.meant(spark, "App.csproj", None) == (".", None)


def test_command_line_reads_solutions_and_archives(spark, tmp_path, capsys):
    import zipfile

    from strataline.__main__ import main

    app = tmp_path / "app"
    app.mkdir()
    (app / "App.sln").write_text("")
    (app / "App.csproj").write_text("<Project/>")
    (app / "A.cs").write_text("namespace N { class A { void M() { } } }")
    with zipfile.ZipFile(tmp_path / "app.zip", "w") as z:
        for f in app.iterdir():
            z.write(f, f"app/{f.name}")
    assert main(["analyze", "-s", str(app / "App.sln"), "-f", "csv"]) == 0 and capsys.readouterr().out == ""
    assert main(["analyze", "-s", str(app / "App.sln"), "-f", "csv", "--output", str(tmp_path / "r.csv"), "-t", "true"]) == 0
    printed = capsys.readouterr().out
    assert printed == (tmp_path / "r.csv").read_text() and "Types" in printed
    assert main(["analyze", "-p", str(tmp_path / "app.zip"), "-f", "csv", "-t"]) == 0
    assert capsys.readouterr().out == printed


def test_a_command_beyond_its_time_ends_with_its_children():
    import subprocess
    import time

    from strataline.sources import files

    began = time.time()
    with pytest.raises(subprocess.TimeoutExpired):
        files.run(["sh", "-c", "sleep 30 & sleep 30"], 0.5)
    assert time.time() - began < 10 and files.run(["sh", "-c", "echo no >&2; exit 3"], 5) == (3, "no\n")


def test_long_conditionals_and_type_arguments():
    from strataline.sources import csharp

    far = "x = a ? f(" + "1, " * 500 + "2) : 3;"
    assert csharp.metrics(far)["cyclo"] == 2
    assert csharp.metrics("F<" + ", ".join(["A<B>"] * 20) + ">(1); if (a < b) G(2);")["calls"] == 2
