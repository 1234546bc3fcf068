"""Secret scans: three base patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax token by token (names, literals, operators, brackets, comments, tags) into
names and the literals bound to them: assignments and their chains (``a = b = "x"``), key-value pairs (``{"name": "x"}``,
``name: x``, ``"name" => "x"``), annotations (``name: str = "x"``), subscripts (``cfg["name"] = "x"``), arguments
(``f(name="x")``, ``put("name", "x")``, ``set_name("x")``), default values of calls (``name = getenv("N", "x")``), lists,
elements (``<name>x</name>``, ``<entry key="name">x</entry>``) and entries of ``name`` and ``value``. Literals joined by
``+``, ``.``, ``&`` or by standing side by side are one literal, and each of its pieces a span. A name in a value's place is a
constant: the binding read last before it, or else the first after it, is judged by the target's name as well, through as many
names as there are (``self.``, ``this.`` and ``$`` aside, dotted names are whole). A literal's score is its target's
sensitivity times how much it looks like a secret; from ``threshold`` on it is reported as kind ``lexed``, unless it overlaps
a span of a base pattern. What a comment holds is judged, but binds no constants.

Statements end at a line's end outside of ``(`` and ``[``, and an empty line ends all that are open, so that no bracket far
away changes how a line is read.

Not read: values in the lines after their name (block scalars, here-documents), types between a name and its ``=`` without a
colon, bindings by scope.

Defined results: a null text is empty; an empty table gives no rows; every row is scanned by itself, so
repeated rows and ids give repeated rows; other columns are dropped, whatever their names; texts, names and literals of any length are read whole;
of equal spans each kind is told. Base spans are the whole matches, in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "lexed")
#: Words that make a name sensitive wherever a part of the name ends with them, and those that must be parts of their own.
ENDINGS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0}
PARTS = {"pass": 0.9, "auth": 0.7, "key": 0.5}
#: Last parts of names that tell about a secret instead of holding one, and what they leave of the sensitivity.
ABOUT = {"count", "length", "len", "size", "limit", "url", "uri", "path", "file", "name", "type", "field", "label", "ttl", "timeout", "header", "prompt", "hint", "policy", "pattern", "format"}
ABOUT_SHARE = 0.4
#: Calls whose first argument names what is looked up, and calls that store their argument under their own name.
LOOKUP = re.compile(r"(?i)(?:get|env|lookup|fetch|read|load|find|prop|param|config)")
SETTER = re.compile(r"(?:set|with)_?(?=[A-Z_a-z])")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|change_me|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\$\w+|%\w+%|test|dummy)$")
#: Open brackets beyond this depth are forgotten, outermost ones too: what follows is read as at the top.
DEPTH = 1000

NAME = r"[\w@]\w*+(?:(?:\.|-|->|::|\?\.)\w++)*+"
#: One token. Quantifiers never give back and a quote opens a literal only if it is closed (on its line, unless tripled), so that the time is linear.
TOKENS = rf"""
  (?P<blank>\n[^\S\n]*+\n\s*+) | (?P<line>\n) | [^\S\n]++
| (?P<str>(?:(?<!\w)[rbfuRBFU]{{1,2}}(?=["']))?(?:\"\"\"(?P<tdq>(?:[^"\\]|\\.|"(?!""))*+)\"\"\" | "(?P<dq>(?:[^"\\\n]++|\\.)*+)")
  | (?:(?<!\w)[rbfuRBFU]{{1,2}}(?=')|(?<!\w))(?:'''(?P<tsq>(?:[^'\\]|\\.|'(?!''))*+)''' | '(?P<sq>(?:[^'\\\n]++|\\.)*+)') | (?<!\w)`(?P<bq>(?:[^`\\\n]++|\\.)*+)`)
| &'\w++(?!')
| \$\{{?(?P<var>\w++(?:(?:->|::)\w++)*+)\}}?+
| (?P<comment>(?<!\S)(?:\#|//|--|/\*|<!--))
| (?P<name>{NAME})
| (?P<compare>===?|!==?|<=|>=|~=) | (?P<set>:=|=>|[?+.]=|=|:) | (?P<cat>\+|\.\.?|&(?!&)) | (?P<alt>\|\|?|\?\??|&&)
| (?P<tag><(?=[A-Za-z_])) | (?P<open>[(\[{{]) | (?P<close>[)\]}}]) | (?P<stop>[,;]) | \\.
| (?P<other>.)"""
STEP = re.compile(TOKENS, re.X | re.S)
#: The same, running words of prose being one token.
SCAN = re.compile(rf"(?P<prose>(?:[\w.\-]++[\x20\t\r,;!?]++(?=\w))++)|{TOKENS}", re.X | re.S)
#: An unquoted value, and a name in its place: one that is called, subscripted or assigned to in turn.
BARE = re.compile(r"""[^\S\n]*+(?![rbfuRBFU]{1,2}["'])(?P<bare>[^\s"'`#;,(){}\[\]<>|$]++)""")
TARGET = re.compile(rf"[^\S\n]*+(?P<bare>{NAME})(?=[(\[<]|[^\S\n]*+(?::=|=(?!=)[^\S\n]*+[\w\"'`(\[{{$]))")
IDENT = re.compile(rf"{NAME}\Z")
GENERIC = re.compile(r"<(?:[\w\s,.|&?\[\]]|'\w++(?!'))*+>")
ELEMENT = re.compile(r"""<(?P<tag>[A-Za-z_][\w:.\-]*+)(?P<attributes>[^<>]*+)>\s*+(?P<body>[^<>]*+)</""")
NAMED = re.compile(r"""\b(?:name|key|id)\s*=\s*["']([^"'<>]*)["']""")
OWN = re.compile(r"^(?:self|this|cls)(?:\.|->)|^[@$]")
OTHERS = bytes(b for b in range(256) if not 97 <= b <= 122)
CLOSES = {")": "(", "]": "[", "}": "{"}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache(4096)
def sensitivity(name: str) -> float:
    """How sensitive a name is, by its parts: cut at case changes and at all that is no letter (``apiKey``, ``API_KEY``)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    flat = "".join(parts)
    if not any(w in flat for w in (*ENDINGS, *PARTS)):
        return 0.0
    cuts = set(accumulate(map(len, parts), initial=0))
    most = 0.0
    for words, whole in ((ENDINGS, False), (PARTS, True)):
        for word, how in words.items():
            if how > most and any((m.end() in cuts or (flat[m.end() : m.end() + 1] == "s" and m.end() + 1 in cuts)) and (not whole or m.start() in cuts) for m in re.finditer(word, flat)):
                most = how
    return most * (ABOUT_SHARE if parts[-1] in ABOUT else 1.0)


def literal_score(text: str, quoted: bool) -> float:
    """0 to 1: length, entropy and mixed classes. A literal of several words is as secret as its best word; placeholders,
    addresses, plain words and unquoted literals without a digit, which are names, score 0."""
    if quoted and len(words := text.split()) > 1:
        return max(literal_score(w, True) for w in words)
    text = text.strip()
    if not text or PLACEHOLDER.match(text) or "://" in text:
        return 0.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    classes = bool(re.search(r"[a-z]", text)) + bool(re.search(r"[A-Z]", text)) + 2 * bool(re.search(r"[0-9]", text)) + bool(re.search(r"[^A-Za-z0-9]", text))
    if classes < 2 or (not quoted and not re.search(r"[0-9]", text)):
        return 0.0
    return min(1.0, n / 16) * min(1.0, entropy / 3.0)


class Operand(NamedTuple):
    """What a value is made of: a literal (quoted, or bare with no name) or the name of a constant."""

    start: int
    end: int
    quoted: bool
    name: str | None = None


class Value(NamedTuple):
    """Alternatives of operands, joined within each, and how sensitive the names are that they are bound to."""

    how: float
    groups: list[list[Operand]]


class Frame:
    """The statement that is being read inside a pair of brackets, or outside of all."""

    __slots__ = ("kind", "callee", "above", "names", "how", "groups", "last", "link", "ternary", "full", "first", "key")

    def __init__(self, kind: str = "", callee: str | None = None, above: float = 0.0):
        self.kind, self.callee, self.above, self.first, self.key = kind, callee, above, True, 0.0
        self.clear()

    def clear(self) -> None:
        self.names, self.how, self.groups, self.last, self.link, self.ternary, self.full = [], 0.0, [], None, None, False, False

    def add(self, x: Operand) -> None:
        if self.groups and self.link != "alt":
            self.groups[-1].append(x)
        else:
            self.groups.append([x])
        self.last, self.link, self.full = x, None, True

    def forget(self) -> None:
        """The last operand is no value: it is called or subscripted."""
        self.groups[-1].pop()
        self.link = "cat"
        if not self.groups[-1]:
            self.groups.pop()
            self.link = "alt" if self.groups else None
        self.last, self.full = None, bool(self.groups)

    def only(self) -> Operand | None:
        return self.groups[0][0] if len(self.groups) == 1 and len(self.groups[0]) == 1 else None


class Lexer:
    """Reads a text's tokens once; brackets are a stack of statements, so that nothing is read twice."""

    def __init__(self, text: str):
        self.text, self.values, self.bound = text, [], {}
        self.stack, self.comment, self.entry = [("", Frame())], False, 0.0
        self.read()

    def label(self, x: Operand) -> str:
        return x.name if x.name is not None else self.text[x.start : x.end]

    def flush(self, f: Frame) -> None:
        """Ends a statement: its operands are the value of its names, or of the names around a call or list."""
        if f.names and f.groups:
            last, one = f.names[-1].lower(), f.only()
            if not self.comment:
                for name in f.names:
                    self.bound.setdefault(OWN.sub("", name), []).append(len(self.values))
            self.values.append(Value(max(f.how, self.entry) if last == "value" else f.how, f.groups))
            self.entry = sensitivity(self.label(one)) if one and last in ("name", "key") else 0.0
        elif f.groups and f.kind == "(":
            call = re.split(r"\W+", f.callee)[-1]
            how = max(0.0 if f.first and LOOKUP.match(call) else f.above, f.key, sensitivity(call) if SETTER.match(call) or call.lower() in ENDINGS else 0.0)
            if how:
                self.values.append(Value(how, f.groups))
            one = f.only()
            f.key = sensitivity(self.label(one)) if one and one.quoted else 0.0
        elif f.groups and f.above:
            self.values.append(Value(f.above, f.groups))
        f.clear()

    def operand(self, x: Operand) -> None:
        f = self.stack[-1][1]
        if f.full and f.link is None and not (x.quoted and f.last is not None and f.last.quoted):
            self.flush(f)  # nothing joins them, so a new statement begins; but two literals side by side are one
        f.add(x)

    def opened(self, kind: str, at: int) -> None:
        f = self.stack[-1][1]
        called = kind != "{" and f.last is not None and not f.last.quoted and not self.text[at - 1].isspace()
        if len(self.stack) > DEPTH:
            self.stack = [("", Frame())]
        if kind == "(" and not called:  # only groups what belongs to the statement around it
            self.stack.append((kind, f))
            return
        callee, above = (self.label(f.last), f.how or f.above) if called else (None, f.how or f.above)
        if called:
            f.forget()
        self.stack.append((kind, Frame(kind, callee, 0.0 if kind == "{" or (kind == "[" and called) else above)))

    def closed(self, kind: str) -> None:
        opening, f = self.stack[-1]
        if opening != CLOSES[kind]:
            return
        self.stack.pop()
        around = self.stack[-1][1]
        if f is around:
            f.last = None
            return
        key = f.only() if opening == "[" and f.callee is not None and not f.names else None
        if key is not None:  # cfg["name"] is the name cfg.name
            self.operand(Operand(key.end, key.end, False, f"{f.callee}.{self.label(key)}"))  # no literal of its own
            return
        self.flush(f)
        around.last, around.link, around.full = None, None, True
        if opening == "{":
            self.flush(around)

    def stop(self, sign: str) -> None:
        kind, f = self.stack[-1]
        if sign == "," and kind == "(" and f.kind != "(":
            f.last, f.link = None, "alt"  # a tuple's parts are alternatives
            return
        self.flush(f)
        f.first = False

    def assigned(self, sign: str) -> None:
        f = self.stack[-1][1]
        if sign == ":" and f.ternary:
            f.last, f.link = None, "alt"
        elif f.last is None and not f.names:
            f.clear()
        else:
            if f.last is not None and f.groups and f.groups[-1]:
                name = self.label(f.last)
                f.names.append(name)
                f.how = max(f.how, sensitivity(name))
            f.groups, f.last, f.link, f.full = [], None, None, False

    def line(self) -> None:
        """A line's end; in brackets, and before the value of an entry in braces, the statement goes on."""
        kind, f = self.stack[-1]
        if kind in ("", "{") and not (kind == "{" and f.names and not f.full):
            self.flush(f)
        self.comment = False

    def element(self, at: int) -> None:
        m = ELEMENT.match(self.text, at)
        if m and m["body"]:
            how = max(map(sensitivity, (m["tag"], *NAMED.findall(m["attributes"]))))
            if how:
                self.values.append(Value(how, [[Operand(*m.span("body"), True)]]))

    def read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            f = self.stack[-1][1]
            m = (STEP if f.names or f.link else SCAN).match(text, at)
            kind, start, at = m.lastgroup, at, m.end()
            if kind is None:
                continue
            if kind == "name":
                if (word := m["name"]) in ("or", "and", "if", "else") and f.full:
                    f.last, f.link = None, "alt"
                else:
                    self.operand(Operand(start, at, False, word))
                    if g := GENERIC.match(text, at):
                        at = g.end()
            elif kind == "var":
                self.operand(Operand(start, at, False, m["var"]))
            elif kind == "str":
                group = next(g for g in ("tdq", "dq", "tsq", "sq", "bq") if m[g] is not None)
                self.operand(Operand(*m.span(group), True))
            elif kind == "set":
                self.assigned(m["set"])
                if self.stack[-1][1].names and not self.stack[-1][1].full and (b := TARGET.match(text, at) or BARE.match(text, at)):
                    at = self.bare(b)
                    if g := GENERIC.match(text, at):
                        at = g.end()
            elif kind == "open":
                self.opened(m["open"], start)
            elif kind == "close":
                self.closed(m["close"])
            elif kind == "stop":
                self.stop(m["stop"])
            elif kind in ("cat", "alt"):
                f.last, f.link = None, kind if f.full else None
                f.ternary |= m[0] == "?"
            elif kind == "line":
                self.line()
            elif kind == "blank":
                for f in {id(f): f for _, f in self.stack}.values():
                    self.flush(f)
                self.stack, self.entry, self.comment = [("", Frame())], 0.0, False
            elif kind == "comment":
                self.line()
                self.comment = True
            elif kind == "tag":
                self.element(start)
                self.flush(f)
            elif kind == "compare":
                f.clear()
            elif kind == "prose":
                self.flush(f)
            else:
                f.last = None
        for f in {id(f): f for _, f in self.stack}.values():
            self.flush(f)

    def bare(self, m: re.Match) -> int:
        """Takes an unquoted value; how far the text is read then."""
        start, end = m.span("bare")
        stop = end
        while stop > start and self.text[stop - 1] in ".!?:":
            stop -= 1
        if stop > start:
            word = self.text[start:stop]
            self.operand(Operand(start, stop, False, word if IDENT.match(word) else None))
        return end

    def root(self, k: int | None, known: dict[int, int | None]) -> int | None:
        """The value that ends the chain of constants from value k on; one that leads back to itself has none."""
        way = []
        while k is not None and k not in known:
            known[k] = None
            way.append(k)
            x = self.values[k].groups[0][0]
            follow = None if any(y.name is None for g in self.values[k].groups for y in g) else self.constant(x.name, k)
            if follow is None:
                known[k] = k
                break
            k = follow
        found = None if k is None else known[k]
        for x in way:
            known[x] = found
        return found

    def constant(self, name: str, k: int) -> int | None:
        """The value bound to name last before value k, or else first after it."""
        at = self.bound.get(OWN.sub("", name))
        if not at:
            return None
        i = bisect_left(at, k)
        return at[i - 1] if i else next((x for x in at if x > k), None)

    def secrets(self, threshold: float) -> set[tuple[int, int]]:
        found, known, scores, done = set(), {}, {}, set()

        def scored(k: int) -> list[tuple[float, list[Operand]]]:
            if k not in scores:
                scores[k] = []
                for g in self.values[k].groups:
                    literals = [x for x in g if x.name is None]
                    if literals:
                        scores[k].append((literal_score("".join(self.text[x.start : x.end] for x in literals), literals[0].quoted), literals))
                    scores[k] += [(literal_score(self.text[x.start : x.end], False), [x]) for x in g if x.name is not None and self.constant(x.name, k) is None]
            return scores[k]

        for k, (how, groups) in enumerate(self.values):
            if how < threshold:
                continue
            for j in {k, *(self.root(self.constant(x.name, k), known) for g in groups for x in g if x.name is not None)}:
                if j is not None and (j, how) not in done:
                    done.add((j, how))
                    found |= {(x.start, x.end) for score, operands in scored(j) if how * score >= threshold for x in operands if x.end > x.start}
        return found


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of literals that their target names make secrets."""
    letters = re.sub(r"[^a-z]+", "", text.lower()) if not text.isascii() else text.lower().encode().translate(None, OTHERS).decode()
    if not any(w in letters for w in (*ENDINGS, *PARTS)):  # then no name in it is sensitive
        return []
    return sorted(Lexer(text).secrets(threshold))


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    starts, stops, most = [s for s, _, _ in base], [], 0
    for _, _, e in base:  # how far the spans up to each one reach
        stops.append(most := max(most, e))
    added = [(s, 3, e) for s, e in lexed_spans(text) if not (k := bisect_left(starts, e)) or stops[k - 1] <= s]
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""

    def scan(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(scan), SCHEMA)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """text with each span that holds a secret replaced; overlapping spans are one."""
    out, at = [], 0
    for s, _, e in all_spans(text)[1]:
        if e > at:
            out += [text[at : max(s, at)], mark] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE: dict[str, str] = {}
