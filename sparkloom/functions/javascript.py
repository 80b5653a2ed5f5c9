"""A compact reader of JavaScript: one file in, its symbols, calls, imports, exports and scopes out.

It works on tokens and matched brackets, not on a full grammar.  A file whose brackets do not match, or that ends
inside a string or comment, has ``has_errors`` set, which switches call resolution off for that file.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<ws>[\s﻿]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$\u0080-\U0010ffff#][\w$\u0080-\U0010ffff]*)|(?P<num>\d[\w.]*)
    |(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<op>=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|\*\*=|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S | re.X,
)
OPEN = {"(": ")", "[": "]", "{": "}"}
#: After these, a slash begins a regular expression.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
WORDS = BEFORE_REGEX | {"if", "for", "while", "switch", "catch", "function", "class", "const", "let", "var", "import", "export", "try", "finally", "super", "with", "break", "continue", "default", "async", "static", "get", "set", "extends"}
BRANCHES = {"if", "switch", "try", "for", "while", "do", "throw", "await", "yield", "return", "break", "continue"}
CALLABLE = ("function", "arrow_function", "method", "test", "module")
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="}
#: The scope around all others, and the name under which a write to a computed member is noted.
MODULE, COMPUTED = "<module>", "<computed-write>"


@dataclass
class Tok:
    kind: str
    text: str
    at: int
    end: int
    line: int


@dataclass
class File:
    path: str
    source: str
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: dict[str, dict] = field(default_factory=dict)
    exports: dict[str, str | None] = field(default_factory=dict)
    bindings: dict[str, dict[str, str]] = field(default_factory=dict)
    shadowed: dict[str, set] = field(default_factory=dict)
    reassigned: dict[str, set] = field(default_factory=dict)
    has_errors: bool = False


def tokens(text: str) -> tuple[list[Tok], bool, list[Tok]]:
    """(tokens without white space and comments, whether something could not be read, comments)."""
    out: list[Tok] = []
    comments: list[Tok] = []
    at, line, bad = 0, 1, False
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            bad |= end < 0
            end = len(text) if end < 0 else end
            out.append(Tok("str", text[at:end], at, end, line))
            line += text.count("\n", at, end)
            at = end
            continue
        last = out[-1] if out else None
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (last is None or (last.kind == "op" and last.text not in (")", "]", "}")) or last.text in BEFORE_REGEX):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, at)
            if m:
                out.append(Tok("regex", m[0], at, m.end(), line))
                at = m.end()
                continue
        if text[at] == "'" and last is not None and last.kind == "name" and last.end == at and last.text not in WORDS:
            at += 1  # an apostrophe of a word in markup
            continue
        m = TOKEN.match(text, at)
        if not m:
            bad, at = True, at + 1
            continue
        kind = m.lastgroup
        if kind != "ws":
            (comments if kind == "comment" else out).append(Tok(kind, m[0], at, m.end(), line))
        line += m[0].count("\n")
        at = m.end()
    return out, bad, comments


def _template_end(text: str, at: int) -> int:
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    if at < 0:
                        return -1
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return -1


class Reader:
    """Walks the tokens of one file once, with a stack of scopes."""

    def __init__(self, path: str, source: str):
        self.file = File(path, source)
        self.t, bad, self.comments = tokens(source)
        self.match = {}
        stack = []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in OPEN.values():
                if stack and OPEN[self.t[stack[-1]].text] == t.text:
                    self.match[stack[-1]] = i
                    self.match[i] = stack.pop()
                else:
                    bad = True
        self.file.has_errors = bad or bool(stack)
        self.is_test = bool(re.search(r"(?:^|/)__tests__/|\.(?:test|spec)\.[cm]?jsx?$", path))
        self.writes: list[tuple[str, str, str]] = []
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
        prefix = [0]
        for c in source:
            prefix.append(prefix[-1] + len(c.encode("utf-8", "surrogatepass")))
        self.byte = prefix

    def run(self) -> File:
        if self.file.has_errors:
            self.file.calls = []
        self.body(0, len(self.t), None)
        self._finish()
        self._modules()
        if not any(s["kind"] in CALLABLE for s in self.file.symbols) and self.file.source.strip():
            self._chunks()
        return self.file

    # helpers ------------------------------------------------------------------------------------------------

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def span(self, begin: int, end: int) -> dict:
        """Place, text and hash of the characters from begin to end."""
        text = self.file.source[begin:end]
        line = lambda at: bisect.bisect_right(self.line_starts, at)
        return {
            "start_line": line(begin), "end_line": line(max(begin, end - 1)), "start_byte": self.byte[begin], "end_byte": self.byte[end],
            "source_text": text, "content_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        }

    def create(self, first: int, end: int, name: str, kind: str, parent: dict | None, params: list[str], method_kind: str = "normal") -> dict:
        """Notes a symbol under a number; names that say where it is come when all are known.

        It remembers the class whose ``this`` it sees (a plain function has one of its own) and the scope of its variables.
        """
        key = f"#{len(self.file.symbols)}"
        around, outer = (parent["_class"], parent["_scope"]) if parent else (None, MODULE)
        s = self.span(self.t[first].at, self.t[min(end, len(self.t)) - 1].end) | {
            "symbol_id": key, "name": name, "kind": kind, "parent_symbol_id": parent and parent["symbol_id"], "parameters": params, "method_kind": method_kind, "comments": self.comments_before(first),
            "_class": key if kind == "class" else None if kind == "function" else around, "_scope": outer if kind == "class" else key,
        }
        self.file.symbols.append(s)
        self.file.shadowed[key] = set(params)
        return s

    def comments_before(self, first: int, near: int = 3) -> list[str]:
        """The comments right before the statement of token ``first`` that end at most ``near`` lines above it."""
        line, i = self.t[first].line, first
        while i and self.text(i - 1) in ("export", "default", "const", "let", "var", "async"):
            i -= 1
        begin, end = self.t[i - 1].end if i else 0, self.t[i].at
        out: list[str] = []
        at = [c.at for c in self.comments]
        for c in reversed(self.comments[bisect.bisect_left(at, begin) : bisect.bisect_left(at, end)]):
            if line - (c.line + c.text.count("\n")) >= near:
                break
            out.insert(0, c.text)
        return out

    def _finish(self) -> None:
        """Turns numbers into ids: path and qualified name, with the place of all but the first of an equal name."""
        ids: dict[str | None, str] = {None: None, MODULE: MODULE}
        qualified: dict[str | None, str] = {None: ""}
        taken: set[str] = set()
        for s in self.file.symbols:
            plain = qualified[s["parent_symbol_id"]] + s["name"]
            full = f"{plain}@{s['start_byte']}" if plain in taken else plain
            taken.add(plain)
            qualified[s["symbol_id"]], ids[s["symbol_id"]] = full + ".", f"{self.file.path}::{full}"
            s |= {"qualified_name": full, "file_path": self.file.path, "is_test": self.is_test}
            for k in ("_class", "_scope"):
                del s[k]
        for row, fields in [(s, ("symbol_id", "parent_symbol_id")) for s in self.file.symbols] + [(c, ("source", "class")) for c in self.file.calls]:
            for k in fields:
                row[k] = ids[row[k]]
        self.file.shadowed = {ids[k]: v for k, v in self.file.shadowed.items()}
        self.file.reassigned = {ids[k]: v for k, v in self.file.reassigned.items()}
        times = Counter((scope, name) for scope, name, _ in self.writes)
        for scope, name, made in self.writes:  # a name that is written twice is bound to nothing sure
            self.file.bindings.setdefault(ids[scope], {})[name] = made if times[scope, name] == 1 else ""

    def parameters(self, a: int, b: int) -> list[str]:
        """Names bound by a parameter list or pattern: identifiers that are not keys or default values."""
        out, i = [], a
        while i < b:
            t = self.t[i]
            if t.kind == "name" and t.text not in WORDS and self.text(i + 1) != ":" and self.text(i - 1) != ".":
                out.append(t.text)
            if t.text == "=":  # skip the default value
                i += 1
                while i < b and self.text(i) != ",":
                    i = self.match.get(i, i) + 1 if self.text(i) in OPEN else i + 1
                continue
            i += 1
        return out

    def expression_end(self, i: int, end: int) -> int:
        """Where an expression that begins at i ends."""
        while i < end:
            x = self.text(i)
            if x in (",", ";", ")", "]", "}"):
                return i
            if i and x not in OPEN and self.t[i].line > self.t[i - 1].line and self.t[i].kind in ("name", "str") and self.t[i - 1].kind in ("name", "num", "str") or (i and self.text(i - 1) in (")", "]", "}") and self.t[i].line > self.t[i - 1].line and self.t[i].kind == "name"):
                return i
            i = self.match.get(i, i) + 1 if x in OPEN else i + 1
        return end

    # the walk -----------------------------------------------------------------------------------------------

    def function(self, i: int, end: int, parent: dict | None, name: str, kind: str, first: int, method_kind: str = "normal") -> int | None:
        """A function whose parameters begin at i; the token behind it, or None if there is none."""
        if self.text(i) == "(" and i in self.match:
            close = self.match[i]
            params, j = self.parameters(i + 1, close), close + 1
        elif self.t[i].kind == "name":
            params, j = [self.t[i].text], i + 1
        else:
            return None
        if self.text(j) == "=>":
            j += 1
            stop = self.match[j] + 1 if self.text(j) == "{" and j in self.match else self.expression_end(j, end)
        elif self.text(j) == "{" and j in self.match:
            stop = self.match[j] + 1
        else:
            return None
        s = self.create(first, stop, name, kind, parent, params, method_kind)
        block = self.text(j) == "{" and stop == self.match.get(j, -2) + 1
        self.body(j + 1 if block else j, stop - 1 if block else stop, s, block)
        return stop

    def klass(self, i: int, parent: dict | None, first: int, name: str | None = None) -> int | None:
        j = i + 1
        if self.t[j].kind == "name" and self.text(j) != "extends":
            name = self.text(j)
            j += 1
        while j < len(self.t) and self.text(j) != "{":
            j = self.match.get(j, j) + 1 if self.text(j) in ("(", "[") else j + 1
        if j not in self.match:
            return None
        stop = self.match[j]
        c = self.create(first, stop + 1, name or "default", "class", parent, [])
        j += 1
        while j < stop:
            begin, method_kind = j, "normal"
            while self.text(j) in ("static", "async", "get", "set", "*") and self.text(j + 1) not in ("(", "=", ";"):
                if self.text(j) != "async":
                    method_kind = self.text(j) if method_kind == "normal" else method_kind
                j += 1
            name = self.text(j)
            if self.text(j) == "[" and j in self.match:
                j = self.match[j]
            if self.text(j + 1) == "(" and self.t[j].kind in ("name", "str", "num"):
                after = self.function(j + 1, stop, c, name.strip("\"'"), "method", begin, method_kind)
                j = after if after is not None else j + 1
            elif self.t[j].kind == "name" and self.text(j + 1) in ("=", ";"):
                self.writes.append((c["symbol_id"], f"this.{name}", ""))
                if self.text(j + 1) == "=":
                    k = j + 2
                    if self.text(k) == "async":
                        k += 1
                    if (self.text(k) == "(" and self.text(self.match.get(k, k) + 1) == "=>") or (self.t[k].kind == "name" and self.text(k + 1) == "=>"):
                        after = self.function(k, stop, c, name, "method", begin, "field")
                        j = after if after is not None else k
                    else:
                        k2 = self.expression_end(k, stop)
                        self.body(k, k2, c)
                        j = k2
                else:
                    j += 1
            else:
                j += 1
        return stop + 1

    def body(self, i: int, end: int, current: dict | None, block: bool = False) -> None:
        """Reads tokens i to end in the scope of a symbol."""
        direct_ok = block and not self._branches(i, end)
        statement, depth_at = i, i
        while i < end:
            t, x = self.t[i], self.t[i].text
            at_start = i == depth_at
            if x == ";" or (x == "}" and self.text(self.match.get(i, i)) == "{"):
                statement = depth_at = i + 1
            elif i > statement and self.t[i].line > self.t[i - 1].line and self.text(i - 1) in (")", "]", "}") and t.kind == "name":
                statement = depth_at = i
            if x == "import" and current is None and at_start:
                i = self._import(i, end)
                statement = depth_at = i
                continue
            if x == "function" and self.text(i - 1) != ".":
                j = i + 1 + (self.text(i + 1) == "*")
                own = self.t[j].text if j < end and self.t[j].kind == "name" else ""
                name, kind, first = self._name(i, own, "function")
                after = self.function(j + bool(own), end, current, name, kind, first)
                if after is not None:
                    i = after
                    continue
            if x == "class" and self.text(i - 1) != "." and self.text(i + 1) not in (":", "=", ")"):
                name, _, first = self._name(i, "", "class")
                after = self.klass(i, current, i, None if "@" in name else name)
                if after is not None:
                    i = after
                    continue
            arrow = (x == "(" and self.text(self.match.get(i, -5) + 1) == "=>") or (t.kind == "name" and x not in WORDS and self.text(i + 1) == "=>")
            if arrow:
                start = i - 1 if self.text(i - 1) == "async" else i
                name, kind, first = self._name(start, "", "arrow_function")
                after = self.function(i, end, current, name, kind, first)
                if after is not None:
                    i = after
                    continue
            if x in ("const", "let", "var"):
                self._declarators(i + 1, end, current)
            elif x == "catch" and self.text(i + 1) == "(":
                self.file.shadowed.setdefault(_scope(current), set()).update(self.parameters(i + 2, self.match.get(i + 1, i + 2)))
            elif (t.kind == "op" and (x in ASSIGN or x in ("++", "--"))) or (x == "delete" and self.text(i - 1) != "."):
                self._assignment(i, current, statement, direct_ok)
            elif x == "(" and i and not self.file.has_errors:
                self._call(i, current, statement, depth_at, direct_ok)
            i += 1

    def _branches(self, i: int, end: int) -> bool:
        """Whether a body can leave its order: any branch, loop, exit or suspension but a last return."""
        j, depth = i, 0
        while j < end:
            x = self.text(j)
            depth += (x in OPEN) - (x in OPEN.values())
            if self.t[j].kind == "name" and x in BRANCHES and self.text(j - 1) != ".":
                if x == "return" and depth == 0 and all(self.text(k) != ";" or k >= end - 1 for k in range(j, end)):
                    j += 1
                    continue
                return True
            if x == "?" or (x in ("&&", "||", "??") and self.text(j - 1) != "="):
                return True
            j += 1
        return False

    def _name(self, i: int, own: str, kind: str) -> tuple[str, str, int]:
        """(name, kind, first token) of a function by what stands around it."""
        line, column = self.t[i].line, self.t[i].at - (self.file.source.rfind("\n", 0, self.t[i].at) + 1)
        before = self.text(i - 1)
        if own:
            return own, kind, i
        if before == "=" and i >= 2:
            j = i - 2
            if self.t[j].kind == "name" and self.text(j - 1) in ("const", "let", "var", ","):
                return self.text(j), kind, j
            if self.t[j].kind == "name" and self.text(j - 1) == ".":
                if self.text(j) == "exports" and self.text(j - 2) == "module":
                    k = j - 4
                    return (self.text(k), kind, i) if self.text(k + 1) == "=" and self.text(k - 1) in ("const", "let", "var") else (f"anonymous@{line}:{column}", kind, i)
                return self.text(j), kind, i
        if before == "default" or (before == "async" and self.text(i - 2) == "default"):
            return "default", kind, i
        if before in ("(", ","):
            j = i - 1
            while j > 0 and self.text(j) != "(":
                j = self.match[j] - 1 if self.text(j) in OPEN.values() and j in self.match else j - 1
            if self.t[j - 1].kind == "name" and self.text(j - 1) not in WORDS or self.text(j - 1) in (")", "]"):
                callee = self._chain(j - 1)[1]
                if self.is_test and callee in ("test", "it", "test.only", "it.only") and self.t[j + 1].kind == "str":
                    return "test:" + self.text(j + 1).strip("\"'`"), "test", i
                return f"callback@{line}:{column}", kind, i
        return f"anonymous@{line}:{column}", kind, i

    def _chain(self, i: int) -> tuple[int, str]:
        """(first token, text) of the member chain that ends at token i; text is empty for anything else."""
        j = i
        while j >= 2 and self.text(j - 1) in (".", "?.") and self.t[j - 2].kind == "name":
            j -= 2
        if self.text(j - 1) in (".", "?."):
            return j, ""
        return j, "".join(self.text(k) for k in range(j, i + 1))

    def _declarators(self, i: int, end: int, current: dict | None) -> None:
        scope = _scope(current)
        while i < end:
            first = i
            if self.text(i) in ("{", "[") and i in self.match:
                names = self.parameters(i + 1, self.match[i])
                i = self.match[i] + 1
            elif self.t[i].kind == "name":
                names, i = [self.text(i)], i + 1
            else:
                return
            self.file.shadowed.setdefault(scope, set()).update(names)
            if self.text(i) in ("of", "in"):
                return
            value = ""
            if self.text(i) == "=":
                if self.text(i + 1) == "new" and self.t[i + 2].kind == "name":
                    value = self.text(i + 2)
                stop = self.expression_end(i + 1, end)
            else:
                stop = i
            if self.t[first].kind == "name":
                self.writes.append((scope, names[0], value))
            if self.text(stop) != ",":
                return
            i = stop + 1

    def _assignment(self, i: int, current: dict | None, statement: int, direct: bool) -> None:
        """A write by the operator at i (or a delete): the name is no longer what it was declared to be."""
        j = i + 1 if self.text(i) == "delete" else i - 1 if self.text(i) not in ("++", "--") or self.t[i - 1].kind == "name" else i + 1
        if self.text(i) == "delete":  # to the end of the member chain
            while self.text(j + 1) in (".", "?.") or (self.text(j + 1) == "[" and j + 1 in self.match):
                j = self.match[j + 1] if self.text(j + 1) == "[" else j + 2
        if j >= len(self.t) or j < 0:
            return
        cls, scope = current and current["_class"], _scope(current)
        if self.text(j) == "]" and j in self.match and self.text(self.match[j] - 1) == "this" and cls:
            self.writes.append((cls, COMPUTED, ""))
            return
        if self.t[j].kind != "name" or (self.text(i) == "=" and self._declared(j)):
            return
        first, name = self._chain(j)
        if not name:
            return
        self.file.reassigned.setdefault(scope, set()).add(name)
        in_constructor = current is not None and current["name"] == "constructor" and self.text(i) == "=" and first == statement
        value = self.text(i + 2) if in_constructor and self.text(i + 1) == "new" and self.t[i + 2].kind == "name" else ""
        self.writes.append((cls if cls and name.startswith("this.") else scope, name, value))

    def _declared(self, j: int) -> bool:
        if self.text(j - 1) in ("const", "let", "var"):
            return True
        k = j - 1
        if self.text(k) != ",":
            return False
        while k > 0 and self.text(k) not in (";", "{", "("):
            if self.text(k) in ("const", "let", "var"):
                return True
            k = self.match[k] - 1 if self.text(k) in OPEN.values() and k in self.match else k - 1
        return False

    def _call(self, i: int, current: dict | None, statement: int, first_in: int, direct_ok: bool) -> None:
        before = self.t[i - 1]
        if current is None or current["kind"] == "class" or not (before.kind == "name" and before.text not in WORDS or before.text in (")", "]") or before.text == "super"):
            return
        j, callee = self._chain(i - 1) if before.kind == "name" else (i - 1, "")
        if before.text in (")", "]"):
            j = self.match.get(i - 1, i - 1)
            if before.text == ")" and self.text(j - 1) in ("if", "for", "while", "switch", "catch", "with"):
                return
        if self.text(j - 1) in ("new", "function", "class") or i not in self.match:
            return
        lead = [self.text(k) for k in range(statement, j)]
        plain = all(x in ("const", "let", "var", "=", "return", "await") or self.t[statement + k].kind == "name" for k, x in enumerate(lead)) and not any(x in OPEN for x in lead)
        close = self.match[i]
        direct = direct_ok and plain and "await" not in lead and self.text(close + 1) not in (".", "?.", "(", "[")
        self.file.calls.append({
            "source": current["symbol_id"], "callee": callee or self.file.source[self.t[j].at : before.end], "callee_type": "identifier" if callee and "." not in callee else "member_expression" if callee else "other",
            "class": current["_class"], "line": self.t[j].line, "end_line": self.t[close].line, "start_byte": self.byte[self.t[j].at], "end_byte": self.byte[self.t[close].end],
            "expression": self.file.source[self.t[j].at : self.t[close].end], "statement_byte": self.byte[self.t[statement].at] if direct else None, "sequence_eligible": direct,
        })

    # modules ------------------------------------------------------------------------------------------------

    def _import(self, i: int, end: int) -> int:
        j = i + 1
        while j < end and self.t[j].kind != "str":
            if self.text(j) == ";" or self.text(j) == "(":
                return j
            j += 1
        module = self.text(j).strip("\"'") if j < end else ""
        k = i + 1
        while k < j:
            x = self.text(k)
            if x == "{":
                stop, k = self.match.get(k, j), k + 1
                while k < stop:
                    if self.t[k].kind == "name":
                        alias = self.text(k + 2) if self.text(k + 1) == "as" else self.text(k)
                        self.file.imports[alias] = {"module": module, "name": self.text(k), "supported": alias == self.text(k) and module.startswith("."), "cjs": False}
                        k += 3 if self.text(k + 1) == "as" else 1
                    else:
                        k += 1
            elif x == "*":
                self.file.imports[self.text(k + 2)] = {"module": module, "name": "*", "supported": False, "cjs": False}
                k += 2
            elif self.t[k].kind == "name" and x not in ("from", "as"):
                self.file.imports[x] = {"module": module, "name": "default", "supported": False, "cjs": False}
            k += 1
        return j + 1

    def _required(self, i: int) -> str | None:
        """The relative module of a require() at token i."""
        if self.text(i) == "require" and self.text(i + 1) == "(" and self.match.get(i + 1) == i + 3 and self.t[i + 2].kind == "str":
            module = self.text(i + 2).strip("\"'")
            return module if module.startswith(".") else None
        return None

    def _modules(self) -> None:
        """Exports, and CommonJS imports and exports at the top level."""
        f = self.file
        top: dict[str, str] = {}
        for s in f.symbols:
            if s["parent_symbol_id"] is None:
                top[s["name"]] = s["symbol_id"]
        depth, i, seen = 0, 0, {}
        aliases = {"module.exports", "exports"}

        def export(key: str, symbol: str | None) -> None:
            if symbol is not None:
                seen[key] = symbol if seen.get(key, symbol) == symbol else None

        def value(k: int) -> str | None:
            if self.text(k) in top and self.text(k + 1) not in (".", "("):
                return top[self.text(k)]
            at = self.byte[self.t[k].at] if k < len(self.t) else -1
            return next((s["symbol_id"] for s in f.symbols if s["parent_symbol_id"] is None and s["start_byte"] == at), None)

        while i < len(self.t):
            x = self.text(i)
            if depth == 0 and x == "export":
                j = i + 1
                if self.text(j) == "default":
                    named = value(j + 1) or next((s["symbol_id"] for s in f.symbols if s["parent_symbol_id"] is None and self.byte[self.t[j].at] < s["start_byte"] <= self.byte[self.t[min(j + 2, len(self.t) - 1)].at]), None)
                    if named:
                        f.exports["default"] = named
                elif self.text(j) == "{" and j in self.match:
                    if self.text(self.match[j] + 1) != "from":
                        k = j + 1
                        while k < self.match[j]:
                            if self.t[k].kind == "name":
                                alias = self.text(k + 2) if self.text(k + 1) == "as" else self.text(k)
                                if self.text(k) in top:
                                    f.exports[alias] = top[self.text(k)]
                                k += 2 if self.text(k + 1) == "as" else 0
                            k += 1
                else:
                    stop = self.expression_end(j + 3, len(self.t))
                    for s in f.symbols:
                        if s["parent_symbol_id"] is None and self.byte[self.t[j].at] <= s["start_byte"] < self.byte[self.t[min(stop, len(self.t) - 1)].end]:
                            f.exports.setdefault(s["name"], s["symbol_id"])
            elif depth == 0 and x in ("const", "let", "var"):
                eq = i + 2 if self.t[i + 1].kind == "name" else self.match.get(i + 1, i) + 1 if i + 1 < len(self.t) else i
                if self.text(eq) == "=":
                    module = self._required(eq + 1)
                    if module and self.t[i + 1].kind == "name":
                        member = self.text(eq + 6) if self.text(eq + 5) == "." else "*"
                        f.imports[self.text(i + 1)] = {"module": module, "name": member, "supported": True, "cjs": True}
                    elif module:
                        k = i + 2
                        while k < eq - 1:
                            if self.t[k].kind == "name":
                                alias = self.text(k + 2) if self.text(k + 1) == ":" else self.text(k)
                                f.imports[alias] = {"module": module, "name": self.text(k), "supported": True, "cjs": True}
                                k += 2 if self.text(k + 1) == ":" else 0
                            k += 1
                    if self._chain(eq + 3)[1] == "module.exports" and self.text(eq + 4) == "=":
                        aliases.add(self.text(i + 1))
            elif depth == 0 and x == "=":
                left = self._chain(i - 1)[1] if self.t[i - 1].kind == "name" else ""
                k = i + 1
                while self.t[min(k, len(self.t) - 1)].kind == "name" and "=" in (self.text(k + 1), self.text(k + 3)):  # a = b = value
                    k += 2 if self.text(k + 1) == "=" else 4
                if left == "module.exports" and self.text(k) == "{" and k in self.match:
                    m = k + 1
                    while m < self.match[k]:
                        key = self.text(m).strip("\"'")
                        if self.text(m + 1) == ":":
                            export(key, value(m + 2))
                            m = self.expression_end(m + 2, self.match[k])
                        elif self.t[m].kind == "name" and self.text(m + 1) in (",", "}"):
                            export(key, top.get(key))
                        m += 1
                elif left == "module.exports":
                    export("*", value(k))
                    if self.t[min(k, len(self.t) - 1)].kind == "name" and self.text(k) not in top:
                        aliases.add(self.text(k))
                elif "." in left and left.rpartition(".")[0] in aliases:
                    export(left.rpartition(".")[2], value(k))
            if x in OPEN:
                i = self.match.get(i, i)
            i += 1
        for key, symbol in seen.items():
            if symbol and key not in f.exports:
                f.exports[key] = symbol

    def _chunks(self, size: int = 80) -> None:
        """Parts of ``size`` lines stand in for the callables that a file lacks."""
        edges = [at for at in self.line_starts[::size] if at < len(self.file.source)]
        for n, (begin, end) in enumerate(zip(edges, [*edges[1:], len(self.file.source)], strict=True), 1):
            name = f"<module:{n}>"
            place = {"symbol_id": f"{self.file.path}::{name}", "qualified_name": name, "name": name, "kind": "module", "file_path": self.file.path, "parent_symbol_id": None, "parameters": [], "comments": [], "is_test": self.is_test, "method_kind": "normal"}
            self.file.symbols.append(place | self.span(begin, end))


def _scope(s: dict | None) -> str:
    return s["_scope"] if s else MODULE


def read(path: str, source: str) -> File:
    """Everything that resolution and search need of one file."""
    return Reader(path, source).run()
