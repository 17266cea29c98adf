"""C# source text without a compiler: tokens, counts, and a best-effort graph.

Without symbol binding, types, methods, fields and calls are found by their syntax, and a
name refers to a type of the same project that is the only one of that simple name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.graph import Graph
from ..store import materialize

_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*\#[^\n]*))"""
    r"""|(?P<str>\$?@?\$?\"\"\"(?:.*?)\"\"\"|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+')"""
    r"""|(?P<num>\d[\w.]*)|(?P<name>@?[A-Za-z_]\w*)"""
    r"""|(?P<op>\?\?=|\?\?|\?\.|&&|\|\||=>|==|!=|<=|>=|\+\+|--|->|::|[-+*/%&|^]=|.)""", re.DOTALL)

# Words of the language.
TYPE_WORDS = {"class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Enum", "record": "Class"}
MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override partial readonly async extern unsafe new const volatile required file ref event implicit explicit operator fixed".split())
STATEMENTS = frozenset("if while for foreach do switch catch using lock fixed checked unchecked try finally else return throw await new typeof nameof sizeof default is as in out ref case when goto yield base this stackalloc var get set add remove init where from select and or not".split())
NESTING = frozenset("if while for foreach do switch using lock fixed checked try catch finally".split())
BUILT_IN = {"string": "System.String", "int": "System.Int32", "bool": "System.Boolean", "object": "System.Object", "double": "System.Double", "long": "System.Int64", "decimal": "System.Decimal", "void": "void"}
CAPTURED = """CreateSender CreateProcessor CreateReceiver BasicPublish BasicConsume ServiceBusClient EventGridPublisherClient CosmosClient OracleConnection
    SqlConnection NpgsqlConnection MongoClient BlobServiceClient GetBlobContainerClient ConnectionFactory AddHttpClient GrpcChannel.ForAddress HttpHeaders.Add
    HttpRequestHeaders.Add GetEnvironmentVariable GetConnectionString IConfiguration ISecretProvider SecretClient GetSecret SetSecret System.Uri""".split()
#: Headers by the property that code names, where no compiler tells their type.
CAPTURED_BY_SYNTAX = ("RequestHeaders.Add", "Headers.Add")


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    last: int


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _LEX.finditer(text):
        n = m[0].count("\n")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, line + n))
        line += n
    return out


def sloc(ts: list[Token]) -> int:
    """Lines that bear a token, without those of closing braces alone."""
    bearing: dict[int, bool] = {}
    for t in ts:
        for k in range(t.line, t.last + 1):
            bearing[k] = bearing.get(k, False) or t.text != "}"
    return sum(bearing.values())


def _match(ts: list[Token], at: int, a: str = "{", b: str = "}") -> int:
    """The place of the bracket that closes the one at ``at``, or the end."""
    depth = 0
    for k in range(at, len(ts)):
        depth += (ts[k].text == a) - (ts[k].text == b)
        if depth == 0:
            return k
    return len(ts) - 1


def decisions(ts: list[Token]) -> int:
    """Branches, loops, catches, case labels, switch arms, conditionals and short circuits."""
    n = sum(t.kind == "name" and t.text in ("if", "while", "for", "foreach", "do", "catch", "case") or t.text in ("&&", "||", "??", "??=") for t in ts)
    n -= sum(a.text == "}" and b.text == "while" and _closes_do(ts, k) for k, (a, b) in enumerate(zip(ts, ts[1:])))
    for k, t in enumerate(ts):
        if t.text == "?" and _conditional(ts, k):
            n += 1
        elif t.text == "switch" and k + 1 < len(ts) and ts[k + 1].text == "{":  # an expression: each arm
            end, depth = _match(ts, k + 1), 0
            for x in ts[k + 1 : end]:
                depth += (x.text in "({[") - (x.text in ")}]") if len(x.text) == 1 else 0
                n += x.text == "=>" and depth == 1
    return n


def _closes_do(ts: list[Token], brace: int) -> bool:
    depth = 0
    for k in range(brace, -1, -1):
        depth += (ts[k].text == "}") - (ts[k].text == "{")
        if depth == 0:
            return k > 0 and ts[k - 1].text == "do"
    return False


def _conditional(ts: list[Token], at: int) -> bool:
    """Whether a question mark asks, rather than marks a nullable type."""
    depth = 0
    for k in range(at + 1, len(ts)):
        x = ts[k].text
        if x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return False
        elif x == ";" and depth == 0:
            return False
        elif x == ":" and depth == 0:
            return True
        elif x in ("=", ",") and depth == 0:
            return False
    return False


def nesting(ts: list[Token]) -> int:
    """The greatest depth of control statements; an else-if is no deeper than its if."""
    most, depth, k = 0, 0, 0
    ends: list[int] = []  # where each open statement ends
    while k < len(ts):
        while ends and k > ends[-1]:
            ends.pop()
        t = ts[k]
        if t.kind == "name" and (t.text in NESTING or t.text == "else" and not (k + 1 < len(ts) and ts[k + 1].text == "if")) and _statement(ts, k):
            ends.append(_end(ts, k))
            most = max(most, len(ends))
        k += 1
    return most


def _statement(ts: list[Token], k: int) -> bool:
    if ts[k].text == "using" and (k + 1 >= len(ts) or ts[k + 1].text != "("):
        return False
    if ts[k].text == "switch":
        return k + 1 < len(ts) and ts[k + 1].text == "("
    if ts[k].text == "while" and k and ts[k - 1].text == "}" and _closes_do(ts, k - 1):
        return False
    return True


def _end(ts: list[Token], k: int) -> int:
    """The last token of the statement that begins at ``k``, without its else or catch."""
    at = k + 1
    if at < len(ts) and ts[at].text == "(":
        at = _match(ts, at, "(", ")") + 1
    if at < len(ts) and ts[at].text == "{":
        return _match(ts, at)
    depth = 0
    while at < len(ts):
        x = ts[at].text
        if x in ("if", "for", "foreach", "while", "using", "lock", "switch", "try", "do") and ts[at].kind == "name" and depth == 0:
            return _end(ts, at)
        depth += (x in ("(", "{", "[")) - (x in (")", "}", "]"))
        if x == ";" and depth <= 0 or depth < 0:
            return at
        at += 1
    return len(ts) - 1


def calls(ts: list[Token]) -> list[int]:
    """Places of the names that are called; object creation is none."""
    out = []
    for k, t in enumerate(ts[:-1]):
        if t.kind != "name" or t.text in STATEMENTS and t.text != "nameof":
            continue
        at = k + 1
        if ts[at].text == "<":
            depth = 0
            for at in range(at, len(ts)):  # type arguments, which none of these can stand in
                depth += (ts[at].text == "<") - (ts[at].text == ">")
                if depth == 0 or ts[at].text in ("(", ";", "{", "&&", "||"):
                    break
            if depth:
                continue
            at += 1
        if at < len(ts) and ts[at].text == "(":
            first = k
            while first >= 2 and ts[first - 1].text in (".", "?.", "::") and ts[first - 2].kind == "name":
                first -= 2
            before = ts[first - 1] if first else None
            declared = before is not None and before.kind == "name" and before.text not in STATEMENTS
            if not declared and not (before is not None and before.text == "new"):
                out.append(k)
    return out


def metrics(text: str) -> dict[str, int]:
    """sloc, cyclo, nbd and calls of a snippet."""
    ts = tokens(text)
    return {"sloc": sloc(ts), "cyclo": 1 + decisions(ts), "nbd": nesting(ts), "calls": len(calls(ts))}


# --- the graph of a file ---------------------------------------------------------------------

class TypeFound(NamedTuple):
    namespace: str
    name: str  # with outer types
    kind: str
    is_abstract: bool
    fields: list[tuple[str, str, bool]]
    methods: list[dict]
    names: list[str]  # names of types that its text uses
    bases: list[str]
    usings: list[str]


def _dotted(ts: list[Token], k: int) -> tuple[str, int]:
    parts = []
    while k < len(ts) and ts[k].kind == "name":
        parts.append(ts[k].text.lstrip("@"))
        k += 1
        if k < len(ts) and ts[k].text in (".", "::"):
            k += 1
            continue
        break
    return ".".join(parts), k


def parse(text: str) -> list[TypeFound]:
    """The types of a file, in order, nested ones after their outer type."""
    ts, out, usings = tokens(text), [], []

    def types_in(lo: int, hi: int, namespace: str, outer: str) -> None:
        k = start = lo
        while k < hi:
            t = ts[k]
            if t.text == "namespace" and t.kind == "name":
                name, at = _dotted(ts, k + 1)
                full = f"{namespace}.{name}" if namespace else name
                if at < hi and ts[at].text == "{":
                    end = _match(ts, at)
                    types_in(at + 1, end, full, "")
                    k = start = end + 1
                    continue
                namespace, k = full, at
            elif t.text == "using" and not outer:
                name, at = _dotted(ts, k + 1)
                usings.append(name)
                k = at
            elif t.text in TYPE_WORDS and t.kind == "name" and k + 1 < hi and ts[k + 1].kind == "name":
                k = start = declared(k, start, hi, namespace, outer)
                continue
            elif t.text == "{":
                k = start = _match(ts, k) + 1
                continue
            if t.text in (";", "}"):
                start = k + 1
            k += 1

    def declared(k: int, start: int, hi: int, namespace: str, outer: str) -> int:
        at = k + 1
        if ts[at].text in TYPE_WORDS and ts[at + 1].kind == "name":
            at += 1
        kind, name = TYPE_WORDS[ts[at - 1].text if at > k + 1 else ts[k].text], ts[at].text
        head = at + 1
        primary: int | None = None
        while head < hi and ts[head].text not in ("{", ";"):
            if ts[head].text == "(":
                close = _match(ts, head, "(", ")")
                primary = close if primary is None and not any(x.text == ":" for x in ts[at:head]) else primary
                head = close
            head += 1
        colon = next((x for x in range(primary or at, head) if ts[x].text == ":"), head)
        bases, depth = [], 0
        for x in range(colon + 1, head):
            if ts[x].text == "where" and depth == 0:
                break
            if ts[x].kind == "name" and depth == 0 and ts[x - 1].text in (":", ","):
                bases.append(_dotted(ts, x)[0])
            depth += (ts[x].text in ("<", "(")) - (ts[x].text in (">", ")"))
        full = f"{outer}.{name}" if outer else name
        end = _match(ts, head) if head < hi and ts[head].text == "{" else head
        body: tuple[list, list, list] = members(head + 1, end) if ts[min(head, len(ts) - 1)].text == "{" and kind != "Enum" else ([], [], [])
        own = {f: k for f, k, _ in body[0]}
        for m in body[1]:
            if m["name"] == name:
                m["name"] = ".ctor"
            m["is_public"] = m["is_public"] or kind == "Interface"
            scope = own | m.pop("scope")
            m["called"] = [typed(c, scope) for c in m["called"]]
            m["arguments"] = [a | {"Target": typed(a["Target"], scope)} for a in m["arguments"] if captured(typed(a["Target"], scope))]
        words = [t.text for t in ts[start:k]]
        used = sorted({t.text for t in ts[k:end] if t.kind == "name" and t.text not in STATEMENTS and t.text not in MODIFIERS and t.text not in TYPE_WORDS} - {name})
        out.append(TypeFound(namespace, full, kind, "abstract" in words or kind == "Interface", body[0], body[1], used, bases, usings))
        for lo, stop in body[2]:
            types_in(lo, stop, namespace, full)
        return end + 1

    def members(lo: int, hi: int) -> tuple[list, list, list]:
        fields, methods, nested = [], [], []
        k = start = lo
        while k < hi:
            t = ts[k]
            if t.text == "[" and k == start:  # an attribute
                k = start = _match(ts, k, "[", "]") + 1
                continue
            if t.text in TYPE_WORDS and t.kind == "name" and k + 1 < hi and ts[k + 1].kind == "name" and ts[k + 1].text not in ("(", "="):
                at = k
                while at < hi and ts[at].text not in ("{", ";"):
                    at = _match(ts, at, "(", ")") + 1 if ts[at].text == "(" else at + 1
                end = _match(ts, at) if at < hi and ts[at].text == "{" else at
                nested.append((start, end + 1))
                k = start = end + 1
            elif t.text == "(" and k > start and ts[k - 1].kind == "name" or t.text == "(" and k > start and ts[k - 1].text == ">":
                close = _match(ts, k, "(", ")")
                at = close + 1
                while at < hi and ts[at].text not in ("{", ";", "=>"):
                    at = _match(ts, at, "(", ")") + 1 if ts[at].text == "(" else at + 1
                if at < hi and ts[at].text == "{":
                    end = _match(ts, at)
                else:
                    end = next((x for x in range(at, hi) if ts[x].text == ";"), hi - 1)
                methods.append(method(start, k, close, at, end))
                k = start = end + 1
            elif t.text in ("{", "=>") and k > start:  # a property
                end = _match(ts, k) if t.text == "{" else next((x for x in range(k, hi) if ts[x].text == ";"), hi - 1)
                name = ts[k - 1].text
                public = any(x.text == "public" for x in ts[start:k])
                for word in ("get", "set", "init", "add", "remove") if t.text == "{" else ("get",):
                    at = next((x for x in range(k, end) if ts[x].text == word and ts[x + 1].text in (";", "{", "=>")), None) if t.text == "{" else k
                    if at is not None:
                        stop = _match(ts, at + 1) if t.text == "{" and ts[at + 1].text == "{" else (end if t.text == "=>" else next((x for x in range(at, end) if ts[x].text == ";"), at))
                        methods.append(described(f"{'set' if word == 'init' else word}_{name}", [], public, ts[at : stop + 1]))
                k = start = end + 1
                if k < hi and ts[k].text == "=":
                    k = start = next((x for x in range(k, hi) if ts[x].text == ";"), hi - 1) + 1
            elif t.text == "=" or t.text == ";":
                end = k
                depth = 0
                while end < hi and not (ts[end].text == ";" and depth == 0):
                    depth += (ts[end].text in ("(", "{", "[")) - (ts[end].text in (")", "}", "]"))
                    end += 1
                if k - start >= 2 and ts[k - 1].kind == "name":
                    words, depth = [x.text for x in ts[start:k]], 0
                    names = [words[-1]]
                    while len(words) > 3 and words[-2] == "," and words.count("<") == words.count(">"):  # int a, b;
                        words = words[:-2]
                        names.insert(0, words[-1])
                    for x in range(k, end):
                        depth += (ts[x].text in ("(", "{", "[", "<")) - (ts[x].text in (")", "}", "]", ">"))
                        if ts[x].text == "," and depth == 0 and ts[x + 1].kind == "name":
                            names.append(ts[x + 1].text)
                    kind = "".join(w for w in words[:-1] if w not in MODIFIERS)
                    fields += [(n, kind, "public" in words) for n in names]
                k = start = end + 1
            else:
                k += 1
        return fields, methods, nested

    def method(start: int, paren: int, close: int, body: int, end: int) -> dict:
        at = paren - 1
        if ts[at].text == ">":
            depth = 0
            while at > start:
                depth += (ts[at].text == ">") - (ts[at].text == "<")
                at -= 1
                if depth == 0:
                    break
        words = [t.text for t in ts[start:at]]
        parts, depth, held = [], 0, []
        for t in ts[paren + 1 : close]:
            depth += (t.text in ("(", "<", "[")) - (t.text in (")", ">", "]"))
            if t.text == "," and depth == 0:
                parts.append(held)
                held = []
            else:
                held.append(t.text)
        if held:
            parts.append(held)
        parts = [p[: p.index("=")] if "=" in p else p for p in parts]
        kinds = ["".join(w for w in p[:-1] if w not in ("this", "ref", "out", "in", "params")) for p in parts]
        return described(ts[at].text, kinds, "public" in words, ts[start : end + 1], ts[body : end + 1], {p[-1]: k for p, k in zip(parts, kinds) if p})

    def described(name: str, kinds: list[str], public: bool, whole: list[Token], body: list[Token] | None = None, scope: dict[str, str] | None = None) -> dict:
        inner = body if body is not None else whole
        return {"scope": (scope or {}) | locals_(inner), "name": name, "parameters": kinds, "is_public": public, "sloc": sloc(whole), "decisions": decisions(inner), "nesting": nesting(inner), "called": called(inner), "names": sorted({t.text for t in inner if t.kind == "name"}), "arguments": arguments(inner), "created": created(inner)}

    types_in(0, len(ts), "", "")
    return out


def locals_(ts: list[Token]) -> dict[str, str]:
    """Types of variables that are declared with a creation: ``var x = new T`` and ``T x = new``."""
    out = {}
    for k in range(len(ts) - 3):
        if ts[k].kind == ts[k + 1].kind == "name" and ts[k + 2].text == "=" and ts[k + 3].text == "new":
            made = _dotted(ts, k + 4)[0]
            out[ts[k + 1].text] = made or ts[k].text
    return out


def typed(target: str, scope: dict[str, str]) -> str:
    """A call's dotted text with the type of its receiver, where that is known, for its name."""
    parts = target.split(".")
    if parts[0] == "this" and len(parts) > 1:
        parts = parts[1:]
    if len(parts) > 1 and parts[0] in scope:
        parts[0] = re.sub(r"[<?\[].*$", "", scope[parts[0]]) or parts[0]
    return ".".join(parts)


def captured(target: str) -> bool:
    low = target.lower()
    return any(c.lower() in low for c in (*CAPTURED, *CAPTURED_BY_SYNTAX))


def qualified(name: str, usings: list[str]) -> str:
    """A foreign type's name with the imported namespace that shares a word with it, if one does."""
    words = [w.lower() for w in re.findall(r"[A-Z][a-z0-9]{3,}|[A-Z]{3,}", name)]
    space = next((u for u in usings if any(w in u.lower() for w in words)), None)
    return f"{space}.{name}" if space and "." not in name else name


def called(ts: list[Token]) -> list[str]:
    """The dotted text of every call."""
    out = []
    for k in calls(ts):
        first = k
        while first >= 2 and ts[first - 1].text in (".", "?.") and ts[first - 2].kind == "name":
            first -= 2
        out.append(".".join(t.text for t in ts[first : k + 1] if t.kind == "name"))
    return out


def created(ts: list[Token]) -> list[str]:
    return [_dotted(ts, k + 1)[0] for k, t in enumerate(ts[:-1]) if t.text == "new" and ts[k + 1].kind == "name"]


def _literal(t: Token) -> str | None:
    if t.kind != "str" or t.text.startswith("'") or t.text.startswith("$"):
        return None
    if t.text.startswith("@"):
        return t.text[2:-1].replace('""', '"')
    if t.text.startswith('"""'):
        return t.text.strip('"')
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), t.text[1:-1])


def arguments(ts: list[Token]) -> list[dict]:
    """Arguments of calls and creations whose target is one that rules know: literal where it is one."""
    out = []
    for k, t in enumerate(ts[:-1]):
        if t.kind != "name" or ts[k + 1].text != "(":
            continue
        first = k
        while first >= 2 and ts[first - 1].text in (".", "?.") and ts[first - 2].kind == "name":
            first -= 2
        target = ".".join(x.text for x in ts[first : k + 1] if x.kind == "name")
        if target == "Uri":
            target = "System.Uri"
        close, depth, index, held = _match(ts, k + 1, "(", ")"), 0, 0, []
        for x in [*ts[k + 2 : close], Token("op", ",", 0, 0)]:
            if x.text == "," and depth == 0:
                if held:
                    inner = [y for y in held if y.kind == "str"]
                    value = _literal(held[0]) if len(held) == 1 else _literal(inner[0]) if held[0].text == "new" and any(y.text == "Uri" for y in held[:4]) and len(inner) == 1 else None
                    if len(held) == 1 and held[0].kind in ("str", "name") or value is not None or held[0].text == "new":
                        out.append({"Target": target, "ArgumentIndex": index, "Value": value, "IsResolved": value is not None})
                index, held = index + 1, []
                continue
            depth += (x.text in ("(", "{", "[")) - (x.text in (")", "}", "]"))
            held.append(x)
    return out


def file_rows(path: str, text: str) -> Iterator[dict]:
    for order, t in enumerate(parse(text)):
        signatures = [k for _, k, _ in t.fields] + [k for m in t.methods for k in m["parameters"]] + [c for m in t.methods for c in m["created"]] + t.bases
        foreign = sorted({n for k in signatures for n in re.findall(r"[A-Za-z_][\w.]*", k) if n not in BUILT_IN and n not in MODIFIERS and n not in STATEMENTS and len(n) > 1})
        yield {"foreign": [[n.rpartition(".")[2], qualified(n, t.usings)] for n in foreign], "path": path, "position": order, "namespace": t.namespace, "name": f"{t.namespace}.{t.name}" if t.namespace else t.name, "kind": t.kind, "is_abstract": t.is_abstract,
               "fields": json.dumps(t.fields), "methods": json.dumps(t.methods), "names": t.names, "bases": t.bases}


FILE_ROWS = "path string, position int, namespace string, name string, kind string, is_abstract boolean, fields string, methods string, names array<string>, bases array<string>, foreign array<array<string>>"


def types(files: DataFrame) -> DataFrame:
    """Declared types of the ``.cs`` files among ``files`` (path, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FILE_ROWS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"]) for r in file_rows(p, t or "")], columns=columns)

    return files.where(F.lower("path").endswith(".cs")).select("path", "text").mapInPandas(run, FILE_ROWS)


# --- the graph of a tree -----------------------------------------------------------------------

def assigned(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``files`` (path) with project: the file of ``projects`` (project) whose folder is the nearest above it, else ``(none)``."""
    spots = projects.select("project", F.regexp_extract("project", r"^(.*?)[^/]*$", 1).alias("folder"))
    # every folder above a file: its path cut after each slash, and the root
    folders = F.expr("concat(array(''), transform(sequence(1, size(split(path, '/'))), n -> concat(array_join(slice(split(path, '/'), 1, n), '/'), '/')))")
    above = files.withColumn("folder", F.explode(folders))
    near = above.join(spots, "folder").groupBy("path").agg(F.max_by("project", F.struct(F.length("folder"), "project")).alias("project"))
    return files.join(near, "path", "left").withColumn("project", F.coalesce("project", F.lit("(none)")))


def tree_graph(files: DataFrame, projects: DataFrame, solution: str, legacy_zero_decisions: bool = False) -> Graph:
    """The graph of the ``.cs`` files among ``files`` (path, text); the first declaration of a full name in a project wins."""
    found = types(files)
    found = found.join(assigned(found.select("path").distinct(), projects), "path")
    first = Window.partitionBy("project", "name").orderBy("path", "position")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    project_key = X.project_id(F.col("project"))
    found = found.withColumn("project_id", project_key).withColumn("ns_id", X.namespace_id(project_key, F.col("namespace"))).withColumn("type_id", X.type_id(project_key, F.col("name")))
    found = materialize(found.withColumn("simple", F.regexp_extract("name", r"([^.]+)$", 1)), "csharp")

    # a simple name means the only type of that name in the project
    known = found.groupBy("project_id", "simple").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("target"), F.min("type_id").alias("target_id"), F.min("kind").alias("target_kind")).where("n = 1").drop("n")
    used = found.select("project_id", "type_id", "name", F.explode("names").alias("simple")).join(known, ["project_id", "simple"]).where("target <> name")
    based = found.select("project_id", "type_id", "name", F.explode("bases").alias("base")).withColumn("simple", F.regexp_extract("base", r"([^.]+)$", 1))
    based = based.join(known, ["project_id", "simple"], "left")
    created_type = "array<struct<name:string,parameters:array<string>,is_public:boolean,sloc:int,decisions:int,nesting:int,called:array<string>,names:array<string>,arguments:array<struct<Target:string,ArgumentIndex:int,Value:string,IsResolved:boolean>>,created:array<string>>>"
    methods = found.select("project_id", "type_id", "name", F.from_json("fields", "array<array<string>>").alias("fields"), F.posexplode(F.from_json("methods", created_type)).alias("at", "m"))
    foreign = found.select("project_id", "type_id", F.explode("foreign").alias("x")).select("project_id", "type_id", F.col("x")[0].alias("simple"), F.col("x")[1].alias("target"))
    outside = foreign.join(known.select("project_id", "simple"), ["project_id", "simple"], "left_anti").select("type_id", "target")
    depends = used.select("type_id", "target").unionByName(outside).where("trim(target) <> ''").groupBy("type_id").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))

    own = F.transform("fields", lambda f: F.get(f, 0))
    signature = F.concat("m.name", F.lit("("), F.array_join("m.parameters", ","), F.lit(")"))
    methods = methods.select("project_id", "type_id", "name", "m", F.array_intersect("m.names", own).alias("accessed"), signature.alias("signature"))
    methods = methods.withColumn("method_id", X.method_id(F.col("type_id"), F.col("signature"))).dropDuplicates(["method_id"])
    by_name = methods.groupBy("project_id", F.col("m.name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("method_id").alias("callee_id")).where("n = 1")
    made = methods.select("project_id", "method_id", F.explode("m.called").alias("call")).withColumn("callee", F.regexp_extract("call", r"([^.]+)$", 1)).join(by_name, ["project_id", "callee"], "left")
    outer_calls = made.where("callee_id is null").select("method_id", F.col("call").alias("x")).unionByName(methods.select("method_id", F.explode("m.created").alias("x")))
    outer_calls = outer_calls.groupBy("method_id").agg(F.array_sort(F.collect_set("x")).alias("external"))

    none, null = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")

    def text(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    def flag(c):
        return F.when(c, "True").otherwise("False")

    def listed(c):
        return F.to_json(F.coalesce(c, F.array().cast("array<string>")))

    def node(df, id_, kind, name, attributes=none):
        return df.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), attributes.alias("attributes"), null.alias("evidence"))

    def edge(df, a, b, kind):
        return df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind"), null.alias("label"), none.alias("attributes"), null.alias("evidence"), F.lit(1.0).alias("confidence"))

    field_lists = F.from_json("fields", "array<array<string>>")
    typed = found.join(depends, "type_id", "left").withColumn("f", field_lists)
    type_nodes = node(typed, "type_id", "Type", F.col("name"), F.create_map(
        F.lit("typeKind"), F.col("kind"), F.lit("isAbstract"), flag(F.col("is_abstract")), F.lit("fieldNames"), listed(F.transform("f", lambda f: F.get(f, 0))), F.lit("fieldTypes"), listed(F.transform("f", lambda f: F.get(f, 1))),
        F.lit("fieldIsPublic"), F.to_json(F.transform("f", lambda f: F.get(f, 2) == "true")), F.lit("dependsOnTypes"), listed(F.col("depends_on")), F.lit("filePath"), F.col("path")))
    full = methods.join(outer_calls, "method_id", "left")
    decided = F.lit(0) if legacy_zero_decisions else F.col("m.decisions")
    method_nodes = node(full, "method_id", "Method", F.concat("name", F.lit("."), "signature"), F.create_map(
        F.lit("parameters"), text(F.size("m.parameters")), F.lit("sloc"), text(F.col("m.sloc")), F.lit("decisionPoints"), text(decided), F.lit("maxNestingDepth"), text(F.col("m.nesting")), F.lit("calls"), text(F.size("m.called")),
        F.lit("isPublic"), flag(F.col("m.is_public")), F.lit("accessedFields"), listed(F.col("accessed")), F.lit("externalCalls"), listed(F.col("external")), F.lit("invocationArguments"), F.to_json("m.arguments", {"ignoreNullFields": "false"})))
    solution_id = X.solution_id(F.lit(solution))
    projects_ = found.select("project_id", "project").distinct().withColumn("solution_id", solution_id)
    spaces = found.select("project_id", "ns_id", "namespace").distinct()
    nodes = (node(projects_.select("solution_id").distinct(), "solution_id", "Solution", F.lit(solution)).unionByName(node(projects_, "project_id", "Project", F.regexp_replace(F.regexp_extract("project", r"([^/]+)$", 1), r"\.csproj$", "")))
             .unionByName(node(spaces, "ns_id", "Namespace", F.col("namespace"))).unionByName(type_nodes).unionByName(method_nodes))
    inherited = based.where("target is not null and target <> name")
    edges = (edge(projects_, "solution_id", "project_id", "Contains").unionByName(edge(spaces, "project_id", "ns_id", "Contains")).unionByName(edge(found, "ns_id", "type_id", "Contains"))
             .unionByName(edge(methods, "type_id", "method_id", "Contains")).unionByName(edge(used, "type_id", "target_id", "ReferencesType"))
             .unionByName(edge(inherited.where("target_kind <> 'Interface'"), "type_id", "target_id", "Inherits")).unionByName(edge(inherited.where("target_kind = 'Interface'"), "type_id", "target_id", "Implements"))
             .unionByName(edge(made.where("callee_id is not null"), "method_id", "callee_id", "Calls")))
    return Graph(nodes, edges.dropDuplicates(["from_id", "to_id", "kind"]))


def count_snippets(snippets: DataFrame) -> DataFrame:
    """snippet, sloc, cyclo, nbd, calls of (snippet, text) rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"snippet": n, **metrics(t or "")} for n, t in zip(pdf["snippet"], pdf["text"])], columns=["snippet", "sloc", "cyclo", "nbd", "calls"])

    return snippets.select("snippet", "text").mapInPandas(run, "snippet string, sloc int, cyclo int, nbd int, calls int")
