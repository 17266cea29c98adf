"""Secret scanning: fixed patterns, and assignment-aware lexing of source and configuration text.

The base patterns find ``assign``, ``access`` and ``hex`` spans (see ``base_spans``). The
lexer then reads the text as name-literal pairs: ``name = "literal"``, ``"name": "literal"``,
``name := a + "b"``, ``export NAME=bare``, ``name: type = "literal"``, ``at["name"] = "literal"``,
``f("name", "literal")``, ``<name>literal</name>``, ``<add key="name" value="literal"/>``, and
indented blocks after ``name: |``; literals may stand in triple quotes. Literals are joined over
``+``, names that were assigned before stand for their values (constant propagation, the last
assignment before the use), what is not known adds nothing, and each resulting value is scored by
how sensitive its target's name is and how secret-like the first ``SCORED`` characters of the value
look. Values that score enough give ``lexed`` spans: all the literals that make them up, wherever
they stand. Names may have any number of parts, values any number of terms; time and memory grow
with the text's length alone.

Spans are in code points, the end exclusive. Null texts have no spans. Empty tables give
empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# a run of the class that is long enough is the whole leftmost match, so the length stands in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[Span]:
    """The spans of the three fixed patterns, leftmost and non-overlapping by kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += (("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6)
    if "AKIA" in text:
        found += (("access", *m.span()) for m in _ACCESS.finditer(text))
    found += (("hex", *m.span()) for m in _HEX.finditer(text))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+"
_QUOTED = r"""\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"""
# a type annotation, before "=" only: str, string?, &'static str, Optional[str], string | null, String[]
_KIND = r"(?:&(?:'\w+[ \t]+)?)?[A-Za-z_][\w.]*+(?:\[[^\]=\n]{0,60}\]|<[^>=\n]{0,60}>){0,2}[?!]?"
_TYPED = rf"(?::[ \t]*{_KIND}(?:[ \t]*\|[ \t]*{_KIND}){{0,4}}[ \t]*(?==(?![=~>])))?"
_PAIR = re.compile(
    # an entry of configuration: <add key="name" value="literal"/>
    rf"""(?<![\w.-])(?:key|name)[ \t]*=[ \t]*(?P<r>["'])(?P<entry>{_NAME})(?P=r)[ \t]+value[ \t]*=[ \t]*(?=["'])"""
    rf"""|(?:(?P<name>(?<![\w$.-]){_NAME})|(?P<q>["'])(?P<quoted>{_NAME})(?P=q)(?:[ \t]*\])?)[ \t]*{_TYPED}(?P<op>:=|=>|=(?![=~])|:(?![:/]))[ \t]*(?=(?P<value>["'`|>]|[\w$]))"""
    # arguments of a call: setProperty("name", "literal")
    rf"""|\([ \t]*(?P<p>["'])(?P<argument>{_NAME})(?P=p)[ \t]*(?P<comma>,)[ \t]*(?=["'`]|[A-Za-z_$])"""
    # an element: <name>literal</name>
    rf"""|<(?P<tag>[A-Za-z_][\w.:-]*+)(?:[ \t][^<>\n]*+)?>(?P<content>[^<>]++)</(?P=tag)[ \t]*>""")
# a literal, a name, or a call or subscript whose value is unknown
_TERM = re.compile(rf"(?P<literal>{_QUOTED})|(?P<ref>{_NAME})(?P<unknown>[ \t]*(?:\([^()\n]*\)|\[[^\[\]\n]*\]))*+(?![\w$(\[])", re.DOTALL)
_BARE = re.compile(r"[^\s\"'`,;#]+")
_BLOCK = re.compile(r"[|>][-+]?[ \t]*\r?\n(?P<lines>(?:[ \t]+\S[^\n]*(?:\n|\Z))+)")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'`A-Za-z_$])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# What the parts of a name say about its value.
STRONG = frozenset("password passwd pwd passphrase secret secrets apikey credential credentials privatekey accesskey secretkey authtoken".split())
WEAK = frozenset("token key auth signature salt cert pass access private signing encryption bearer session".split())
HARMLESS = frozenset("name id count length size type hint label field path file url public policy min max input format version max_length expiry ttl".split())


def sensitivity(name: str) -> float:
    """How much a name says that its value is secret, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    if STRONG & (joined | set(parts)):
        return 1.0
    weak = len(WEAK & set(parts))
    return min(1.0, 0.75 * weak)


def secrecy(value: str) -> float:
    """How much a value looks like a secret, 0 to 1: bits by character, length, and mixed classes."""
    if len(value) < 8 or value.isspace() or re.fullmatch(r"\*+|x+|X+|\.+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}", value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    spaced = value.count(" ") / n
    return max(0.0, min(1.0, bits / 4 * 0.5 + min(n, 32) / 32 * 0.25 + (classes - 1) / 3 * 0.25 - 2 * spaced))


#: Characters of a value, from its beginning, that are looked at when it is scored.
SCORED = 256


class Value:
    """What a name stands for: the beginning of its text, and the literals that make it up.

    Literals of other names are kept by reference, so a value takes no more room than its own
    expression, however often names are joined to themselves.
    """

    __slots__ = ("head", "spans", "parts", "told")

    def __init__(self) -> None:
        self.head = ""
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Value] = []
        self.told = False

    def add(self, text: str) -> None:
        if len(self.head) < SCORED:
            self.head += text[: SCORED - len(self.head)]

    def tell(self, out: set[tuple[int, int]]) -> None:
        """All literals under this value, each value once however many names lead to it."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.told:
                value.told = True
                out.update(value.spans)
                todo += value.parts


def _literal(t: re.Match[str]) -> tuple[int, int]:
    """Where the text inside the quotes stands."""
    a, b = t.span("literal")
    n = 3 if b - a >= 6 and t["literal"][:3] in ('"""', "'''") else 1
    return a + n, b - n


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value, int]:
    """The value of literals and names joined from ``at`` on, and where it ends. Terms that nothing is known of add nothing."""
    value = Value()
    end = at
    while t := _TERM.match(text, at):
        if t["literal"]:
            a, b = _literal(t)
            value.spans.append((a, b))
            value.add(text[a : min(b, a + SCORED)])
        elif t["ref"] in known and not t["unknown"]:
            value.parts.append(known[t["ref"]])
            value.add(known[t["ref"]].head)
        at = end = t.end()
        if not (plus := _PLUS.match(text, at)):
            break
        at = plus.end()
    return value, end


def lexed_spans(text: str, least: float = 0.45) -> list[Span]:
    """Literals whose target names and values together score ``least`` or more."""
    if not ("=" in text or ":" in text or "</" in text or "(" in text and "," in text):
        return []
    known: dict[str, Value] = {}
    out: set[tuple[int, int]] = set()
    at = 0
    while m := _PAIR.search(text, at):
        name = m["name"] or m["quoted"] or m["argument"] or m["tag"] or m["entry"]
        at = m.end()
        if m["tag"]:
            a, b = m.span("content")
            value = Value()
            value.spans.append((a + len(m["content"]) - len(m["content"].lstrip()), b - len(m["content"]) + len(m["content"].rstrip())))
            value.add(m["content"].strip()[:SCORED])
        elif m["value"] in ("|", ">"):
            value = Value()
            if m["op"] == ":" and (b := _BLOCK.match(text, at)):
                for line in re.finditer(r"\S+(?:[ \t]+\S+)*", b["lines"]):
                    a = b.start("lines") + line.start()
                    value.spans.append((a, a + len(line[0])))
                    value.add(line[0])
                at = b.end()
        else:
            value, end = _expression(text, at, known)
            if value.spans or value.parts:
                at = end
            elif m["op"] in ("=", ":") and (b := _BARE.match(text, m.end())):
                at = b.end()
                # an unquoted value is a literal only where digits or mixed case tell it from prose
                if re.search(r"\d", b[0]) and re.search(r"[A-Za-z]", b[0]):
                    value.spans.append(b.span())
                    value.add(b[0][:SCORED])
        if value.head:
            known[name] = value
            if (s := sensitivity(name)) and s * secrecy(value.head) >= least:
                value.tell(out)
    return [("lexed", a, b) for a, b in sorted(out) if b > a]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and then kind."""
    base = base_spans(text)
    return base, sorted(base + lexed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by base kind, digest of the base spans, all spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "")
                n = Counter(k for k, _, _ in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


MASK = "[secret]"


def masked(text: str) -> str:
    """The text with every found secret replaced by a mark; overlapping spans become one."""
    out, at = [], 0
    for _, a, b in sorted(all_spans(text)[1], key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, secrets in ``text`` masked and ``n_chars`` (if there) of masked texts in keeping."""
    names = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("text").to_pylist()
            texts = [None if t is None else masked(t) for t in before]
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                kind = batch.schema.field("n_chars").type
                held = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if t == b else len(t) for n, t, b in zip(held, texts, before)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(replace, docs.schema)
