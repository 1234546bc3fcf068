"""The secret scan's lexer: a table of assignment forms, a tokenizer that steps by characters beside it, locality and time."""

import random
import re
import time

import pytest

from weftgraph.llm import secret_scan

SECRET = "Zx9kLmn42QpRtYuI"

BOUND = [
    'to_ken = "S"', 'to_ken = "S" # key', 'db_pwd: str = "S"', 'const apiSecret: string = "S"', 'os.environ["SECRET_KEY"] = "S"', 'db_pwd = ("S")', 'db_pwd = """S"""',
    'db_pwd = os.getenv("X", "S")', "<password>S</password>", 'cfg.D = "S"\ndb_pwd = cfg.D', 'db_pwd = D\nD = "S"', "db_pwd = `S`", '{"db_pwd": "S"}', '{"a": 1,\n "db_pwd":\n "S"}',
    "$config['db_pwd'] = 'S';", "define('DB_PWD', 'S');", "export DB_PWD=S", "DB_PWD=$D\nD=S", 'DB_PWD=${D}\nD="S"', 'connect(host="x", db_pwd="S")', 'setPwd("S")', "- name: DB_PWD\n  value: S",
    '<entry key="db.pwd">S</entry>', '<add key="DbPwd" value="S"/>', 'db_pwd = x or "S"', 'const p: Map<string, string> = y; let dbPwd = a ? "q" : "S"', 'db_pwd := "S"', '"db_pwd" => "S"',
    'a = db_pwd = "S"', 'A = B\nC = A\nB = "S"\ndb_pwd = C', 'this.D = "S"; this.dbPwd = this.D;', "db_pwd: S", 'db_pwd = "Bearer S"', "x-pwd: S", "let dbPwd: Option<&'static str> = Some(\"S\")",
    'db_pwds = ["q", "S"]', 'db_pwd = ["S"]', 'db_pwd = ("q", "S")', 'cfg["D"] = "S"\ndb_pwd = cfg["D"]', '# db_pwd = "S"', 'she said "no" to it: db_pwd = "S"', "don't do db_pwd = 'S'",
    'f(a, (b, db_pwd = "S"))', 'db_pwd = f("x") + "S"', 'DbPassword: "S"', 'db_pwd = r"S"', 'db_pwd = "q"\nD = "S"\nE = D\nmy_token = E', "user.passwords = 'S'",
]
FREE = [
    'keyboard = "Model-X1200-rev2-de"', 'author: "J0hn-Smith-1984x"', 'monkey: "S"', 'if db_pwd == "S": x', 'db_pwd = os.environ["S"]', 'db_pwd = getenv("S")', "max_tokens = 4096", 'db_pwd_file = "S"', 'other = "S"',
    'db_pwd = "please enter it"', 'db_pwd = load()\nx = "S"', "db_pwd:\n  x: S", "A = B\nB = A\ndb_pwd = A", '# D = "S"\ndb_pwd = D', 'a db_pwd (\n\nx = "S"', 'db_pwd = "https://example.org/S"', "db_pwd = changeme",
]


def filled(form):
    return re.sub(r"(?<![A-Za-z_])S(?![A-Za-z_])", SECRET, form)


def found(text):
    return [text[s:e] for s, e in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize("form", BOUND)
def test_bound_literals(form):
    (literal,) = found(filled(form))
    assert literal in (SECRET, f"Bearer {SECRET}")


@pytest.mark.parametrize("form", FREE)
def test_other_literals(form):
    assert found(filled(form)) == []


def test_pieces_of_a_literal():
    for sign in (" + ", " ", " . ", " +\n ", " & "):
        text = f'db_pwd = ("Zx9kLmn4"{sign}"2QpRtYuI")'
        assert found(text) == ["Zx9kLmn4", "2QpRtYuI"], sign
    assert found('db_pwd = "Zx9k"') == []  # a piece alone is too short


def test_sensitive_names():
    for name in ("password", "dbPassword", "DB_PASSWORD", "pass_word", "x.api-key", "APIKey", "tokens", "aws_access_key_id", "mypwd", "PWD2"):
        assert secret_scan.sensitivity(name) >= 0.9, name
    for name in ("keyboard", "monkey", "author", "tokenizer", "secretary", "passage", "compass", "", "é", "token_count", "password_file"):
        assert secret_scan.sensitivity(name) < 0.5, name
    assert secret_scan.sensitivity("sort_key") == 0.5 and secret_scan.sensitivity("auth") == 0.7


def test_a_paragraph_is_read_alike_wherever_it_stands():
    rng = random.Random(4)
    forms = [filled(f) for f in BOUND + FREE if not f.endswith("(") and re.search(r"\b[ABDaxy]\b", f) is None]  # no constants shared between paragraphs
    odd = ["an open ( bracket", "it's a \" quote and {", "`", "key:", "don't (see [", "<password>", "z = (", "' '", "\\", "token ="]
    for _ in range(200):
        parts = [rng.choice(forms + odd) for _ in range(8)]
        text, expected, at = "\n\n".join(parts), [], 0
        for p in parts:
            expected += [(at + s, at + e) for s, e in secret_scan.lexed_spans(p)]
            at += len(p) + 2
        assert secret_scan.lexed_spans(text) == expected, text


def test_time_grows_with_the_text():
    def seconds(text):
        start = time.process_time()
        spans = secret_scan.lexed_spans(text)
        return time.process_time() - start, len(spans)

    line = f'a paragraph of prose, then my_token = "{SECRET}" and (more\n'
    (small, few), (large, many) = seconds(line * (1_000_000 // len(line))), seconds(line * (10_000_000 // len(line)))
    assert few == 1_000_000 // len(line) and many == 10_000_000 // len(line) and large < 25 * small + 1
    for unit in ("(", "a=(", "\\'", "\"'", "<a ", "key[", "a+", "`", "a=b;b=a;key=a;", "key=x or ", "key=a="):
        assert seconds("token " + unit * (400_000 // len(unit)))[0] < 25 * seconds("token " + unit * (40_000 // len(unit)))[0] + 1, unit


def tokens_brute(text):
    """(kind, start, end) of all tokens but spaces and others, by stepping through the characters."""
    word = lambda i: i < len(text) and bool(re.match(r"\w", text[i]))
    space = lambda i: i < len(text) and text[i].isspace() and text[i] != "\n"

    def literal(i):
        """Where the literal that opens at i ends, or None."""
        q = text[i : i + 3] if text[i] in "\"'" and text[i : i + 3] == text[i] * 3 else text[i]
        for q in dict.fromkeys((q, text[i])):
            j = i + len(q)
            while j < len(text) and not text.startswith(q, j):
                if text[j] == "\n" and len(q) == 1:
                    break
                j += 2 if text[j] == "\\" else 1
            if j < len(text) and text.startswith(q, j):
                return j + len(q)
        return None

    out, i = [], 0
    while i < len(text):
        c, before = text[i], text[i - 1] if i else " "
        inner = re.match(r"\w", before)
        if c == "\n":
            j = i + 1
            while space(j):
                j += 1
            if j < len(text) and text[j] == "\n":
                while j < len(text) and text[j].isspace():
                    j += 1
                out.append(("blank", i, j))
            else:
                out.append(("line", i, j := i + 1))
        elif space(i):
            j = i + 1
        elif (m := re.match(r"[rbfuRBFU]{1,2}(?=[\"'])", text[i : i + 3])) and not inner and (j := literal(i + m.end())):
            out.append(("str", i, j))
        elif c in "\"'`" and (c == '"' or not inner) and (j := literal(i)):
            out.append(("str", i, j))
        elif (not i or before.isspace()) and (m := re.match(r"#|//|--|/\*|<!--", text[i : i + 4])):
            out.append(("comment", i, j := i + m.end()))
        elif word(i) or (c == "@"):
            j = i + 1
            while True:
                while word(j):
                    j += 1
                step = next((s for s in (".", "-", "->", "::", "?.") if text.startswith(s, j) and word(j + len(s))), None)
                if step is None:
                    break
                j += len(step)
            out.append(("name", i, j))
        else:
            signs = {"compare": ("===", "==", "!==", "!=", "<=", ">=", "~="), "set": (":=", "=>", "?=", "+=", ".=", "=", ":"), "cat": ("+", "..", ".", "&"), "alt": ("||", "|", "??", "?", "&&"), "open": "([{", "close": ")]}", "stop": ",;"}
            kind, sign = next(((k, s) for k, all_ in signs.items() for s in all_ if text.startswith(s, i) and not (s == "&" and text.startswith("&&", i))), (None, None))
            if c == "<" and kind is None and re.match(r"[A-Za-z_]", text[i + 1 : i + 2]):
                kind, sign = "tag", "<"
            j = i + len(sign or c) + (c == "\\" and i + 1 < len(text))
            if kind:
                out.append((kind, i, j))
        i = j
    return out


def test_tokens_equal_stepping_through_the_text():
    rng = random.Random(11)
    bits = ['"', "'", "`", '"""', "'''", "\\", "\n", "\n \n", " ", "\t", "a", "key", "pw_1", ".", "-", "->", "::", "?.", "=", "==", "=>", ":=", ":", "+", "+=", "|", "||", "??", "?", "(", ")", "[", "]", "{", "}", ",", ";", "#", "//", "--", "<", ">", "<b", "é", "中", "@", "r", "f'", "9", "/", "!=", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.choice((2, 6, 15, 40))))
        if re.search(r"&'|\$", text):
            continue
        at, got = 0, []
        while at < len(text):
            m = secret_scan.STEP.match(text, at)
            assert m and m.end() > at
            if m.lastgroup not in (None, "other"):
                got.append((m.lastgroup, at, m.end()))
            at = m.end()
        assert got == tokens_brute(text), text
