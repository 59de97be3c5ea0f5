"""The lexer of operator 9 on labelled statements: what it must find, what it must leave alone, and its time on hostile texts."""

import time

import pytest

from churnlake.llm import secrets

A, B = "hV7!kq2Lz9zz", "q8W!e7R#t6Yp"
#: (text, the literals that are secrets)
FOUND = [
    (f'os.environ["API_TOKEN"] = "{A}"', [A]), (f"<password>{A}</password>", [A]), (f'conn.setPassword("{A}")', [A]), (f'pwd = """{A}"""', [A]),
    (f'db_pwd = (\n    "{A}"\n)', [A]), (f'db_pwd = (\n    "{A}"\n    "{B}"\n)', [f'{A}"\n    "{B}']), (f'prefix = "ab12"\nauth_key = prefix + "{A}"', [A]),
    (f'pw = os.getenv("DB_PASSWORD", "{A}")', [A]), (f'pw = os.environ.get("DB_PASSWORD") or "{A}"\nmy_pwd = pw', [A]), (f'x = "{A}"\nclient_secret_value = x', [A]),
    (f'{{"name": "API_TOKEN", "value": "{A}"}}', [A]), (f"- name: DB_SECRET\n  value: {A}\n", [A]), (f'<add key="DbPassword" value="{A}"/>', [A]),
    (f'String passphrase =\n    "{A}";', [A]), (f'auth_tokens = ["{A}", "{B}"]', [A, B]), (f'connect(host="h", db_credential="{A}")', [A]),
    (f'config.put("private_key", "{A}")', [A]), (f"$cfg['auth_key'] = '{A}';", [A]), (f"export AUTH_KEY={A}", [A]), (f"let bearerKey = `{A}`", [A]),
    (f'signing: {{\n  secretKey: "{A}",\n}}', [A]), (f'if user_pwd == "{A}":', [A]), (f'$this->passphrase = "{A}";', [A]), (f'pwd_a := "{A}"', [A]),
    (f'"credentials" => "{A}"', [A]), (f"auth-key: {A}", [A]), (f'a = "ab1"\nb = a\nc = b + "{A}"\nauth_secret_x = c', [A]), (f'(unclosed\n\nauth_key = "{A}"', [A]),
    (f'say "don\'t\npassphrase: "{A}"', [A]), (f'builder().host("h").withToken("{A}").build()', [A]), (f'auth_key = r"{A}"', [A]),
]
CLEAN = [
    'name = "just a plain name"', "the key: to good bread is time", "tokenize: nothing", 'get_secret("prod/db/main-1")', 'pwd = os.getenv("DB_PASSWORD")',
    'password = input("Enter it 1: ")', 'keys = {"color": "blue-ish"}', "if token == None:", "see key (figure 12) for access", "# don't log tokens, it's 12 bad",
    "<title>Secret gardens of 1920</title>", 'auth_url = "http"', "secret: <your-secret>", 'pwd = "${DB_PWD}"', 'key = "value"', "access: 2024-01-01",
    'password_field = "password"', f'checksum = "{A}"', f'get("color", "{A}")', "private road, no access 24h: keep out", f'auth_key = unknown\nx = "{A}"',
    "Signature: the undersigned agrees to 12 things", f'{{"name": "color", "value": "{A}"}}', 'secret = changeme', 'raise ValueError("token 12 missing")',
]


@pytest.mark.parametrize("text,want", FOUND)
def test_forms_found(text, want):
    assert [text[a:b] for a, b in secrets.lexed(text)] == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean_statements(text):
    assert secrets.lexed(text) == []


def test_statements_one_after_another():
    """Parted by empty lines, all statements of the fixture give what each gives alone."""
    text, want = "", []
    for t, _ in FOUND:
        spans = secrets.lexed(t)
        want += [(len(text) + a, len(text) + b) for a, b in spans]
        text += t + "\n\n"
    assert secrets.lexed(text) == want


@pytest.mark.parametrize("piece", ["(", 'a = "', "x = y + ", '"""', "<a>", "it's 1 ", "[secret", "\n\n", 'f("a1b2c3d4",', "<a b", "''", "a b ", "aB", "key=1 ", "AKIA" + "B" * 20 + "=", "a:", "a1:", "x=y z="])
def test_linear_in_hostile_texts(piece):
    times = []
    for n in (100_000, 400_000):
        text = (piece * (n // len(piece) + 1))[:n] + " secret"
        start = time.process_time()
        secrets.scan_text(text)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 0.3


def test_spans_inside_pattern_spans_are_not_repeated(spark):
    text = f'password = "abcdefgh12345"\nauth_key = "{A}"\n' * 3
    row = secrets.scan(spark.createDataFrame([(1, text, "extra")], "doc_id long, text string, kinds string")).head()
    assert row.kinds == ["assign", "lexed"] * 3
    assert [text[a:b] for k, a, b in zip(row.kinds, row.starts, row.ends) if k == "lexed"] == [A] * 3
