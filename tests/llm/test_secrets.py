import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.llm import secrets as S


def base(text):
    """The contract's patterns, word for word."""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PARTS = st.sampled_from(["password", "TOKEN", "api_key", "apikey", "secret", "passwd", '"', "'", " ", ":", "=", "abcdef", "abc", "é", "ſecret", "toKen", "AKIA", "A" * 16, "Z9", "0123456789abcdef", "ff", "\n", "漢", "x.y-z", "token=", ": token: abcdefgh"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_are_the_contract(text):
    assert S.base_spans(text) == base(text)
    first, every = S.all_spans(text)
    assert [s for s in every if s[0] != "lexed"] == first
    assert all(0 <= a < b <= len(text) for _, a, b in every)


@pytest.mark.parametrize(("text", "found"), [
    ('db_pwd = "hunter2Secret!"', ["hunter2Secret!"]),
    ('PREFIX = "sk_live_"\nclient_credential = PREFIX + "9aF3kLm02Xq"', ["sk_live_", "9aF3kLm02Xq"]),
    ('{"privateKey": "MIIEvQIBADANBgkqhkiG9w0"}', ["MIIEvQIBADANBgkqhkiG9w0"]),
    ("export AWS_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", ["wJalrXUtnFEMI/K7MDENG"]),
    ('name = "John Smith"\ncolour: "blueGreen1"', []),
    ("The key: to success is work2day", []),
    ('password_hint = "my First Pet 123"', []),
    ('pwd = "${DB_PASSWORD}"', [])])
def test_lexed(text, found):
    assert [text[a:b] for k, a, b in S.all_spans(text)[1] if k == "lexed"] == found


def test_scan_and_mask(spark):
    hexed = "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    rows = [(1, "é " + hexed + " end"), (2, None), (3, ""), (4, "plain words"), (4, "plain words"), (None, "AKIA" + "B" * 16)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(9)).withColumn("spans", F.lit("clash"))
    got = S.scan(df).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 0, 1)
    assert one.base_sha256 == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest() and one.spans.startswith("assign:2:51,hex:11:51")
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.base_sha256 for r in got if r.doc_id in (2, 3, 4)] == [empty] * 4 and next(r for r in got if r.doc_id is None).n_access == 1
    out = {(r.doc_id, r.text, r.n_chars) for r in S.mask(df).collect()}
    assert out == {(1, 'é [secret]" end', 15), (2, None, 9), (3, "", 9), (4, "plain words", 9), (None, "[secret]", 8)}
    assert S.mask(df).columns == df.columns and S.scan(df.limit(0)).count() == 0 == S.mask(df.limit(0)).count()


@pytest.mark.parametrize("text", [
    'db_password: str = "Xk29fj3kd02"', 'let dbPassword: string = "Xk29fj3kd02";', 'val dbPassword: String? = "Xk29fj3kd02"', "let db_password: &'static str = \"Xk29fj3kd02\";", 'db_password: Optional[str] = "Xk29fj3kd02"',
    'dbPassword: string | null = "Xk29fj3kd02"', 'password: string = "Xk29fj3kd02"', 'config["db_password"] = "Xk29fj3kd02"', "os.environ['DB_PASSWORD' ] = 'Xk29fj3kd02'", 'config["a"]["db_password"]="Xk29fj3kd02"'])
def test_typed_and_subscript_targets(text):
    assert [text[a:b] for k, a, b in S.all_spans(text)[1] if k == "lexed"] == ["Xk29fj3kd02"]
    assert "Xk29fj3kd02" not in S.masked(text)


@pytest.mark.parametrize(("text", "found"), [
    ('api_key = base + "Zx91kd82jd0Qmz"', ["Zx91kd82jd0Qmz"]),
    ('key = os.getenv("X") + "Zx91kd82jd0Qmz"', ["Zx91kd82jd0Qmz"]),
    ('conf["password"] = "q8Zx91kd82"', ["q8Zx91kd82"]),
    ('password = """q8Zx91\nkd82"""', ["q8Zx91\nkd82"]),
    ("pwd = '''q8'Zx91kd82'''", ["q8'Zx91kd82"]),
    ("<db.password>\n q8Zx91kd82 </db.password>", ["q8Zx91kd82"]),
    ('<add key="db.password" value="q8Zx91kd82"/>', ["q8Zx91kd82"]),
    ('os.environ.setdefault("API_KEY", "Zx91kd82jd0Qmz")', ["Zx91kd82jd0Qmz"]),
    ("client_secret: |\n  Zx91kd82jd0Qmz\n  abcDEF0192837\nother: 3", ["Zx91kd82jd0Qmz", "abcDEF0192837"]),
    ("client_secret: Zx91kd82jd0Qmz", ["Zx91kd82jd0Qmz"]),
    ('base = "Zx91kd82jd0Qmz"\ntoken_value = base', ["Zx91kd82jd0Qmz"]),
    ('db_pass: str = "Xk29fj3kd02"', ["Xk29fj3kd02"]),
    ('a.b.c.d.e.f.g.h.i.j.k.l.password = "q8Zx91kd82"', ["q8Zx91kd82"]),
    ('pwd = "q8Zx91" + \n    "kd82jd0Q"', ["q8Zx91", "kd82jd0Q"]),
    ('x = "Zx91kd82jd0Qmz"\nx = "other"\npwd = x', []),
    ('<p class="key">the 2nd door</p>', []),
    ('title: |\n  Zx91kd82jd0Qmz\n', [])])
def test_syntax_of_source_and_configuration(text, found):
    assert [text[a:b] for k, a, b in S.all_spans(text)[1] if k == "lexed"] == found


def test_names_joined_to_themselves_take_no_room():
    doubled = 'a0 = "xY9zK2qq"\n' + "".join(f"a{k} = a{k - 1} + a{k - 1}\n" for k in range(1, 200)) + "password = a199"
    assert [doubled[a:b] for _, a, b in S.lexed_spans(doubled)] == ["xY9zK2qq"]


@pytest.mark.parametrize(("piece", "times", "end"), [
    ('"abC1zQ9x" + ', 200000, '"x"'), ('x = "abc" + ', 80000, ""), ("a.", 300000, 'b = "q"'), ('a="', 100001, ""), ("a: b | c | d ", 60000, ""), ('a="""', 100001, ""), ("k: |\n a\n", 60000, ""),
    ("<a>x", 200000, ""), ('("a', 200000, ""), ("x = f(", 100000, ""), ("(a)[b]", 100000, ""), ("a:", 200000, ""), ("a =\t", 200000, ""), ("\\", 500000, '"'), (" + a", 200000, ""), ('key="a" ', 60000, "")])
def test_time_grows_with_the_length(piece, times, end):
    text = "password = " + piece * times + end
    began = time.perf_counter()
    spans = S.lexed_spans(text)
    assert time.perf_counter() - began < 5 and all(0 <= a < b <= len(text) for _, a, b in spans)
    assert len(spans) == times + 1 or "abC1" not in piece


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["pwd", "a", "b.c", "=", ":", "+", " ", "\n", '"q8Zx91kd82"', "'x'", '"""', "[", "]", "(", ")", "<", ">", "</a>", "|", ",", "\\", "é", "$", "key=", "value="]), max_size=30).map("".join))
def test_any_text_gives_spans_inside_it(text):
    spans = S.lexed_spans(text)
    assert spans == sorted(set(spans)) and all(0 <= a < b <= len(text) for _, a, b in spans)
    assert S.masked(text) == text or spans
