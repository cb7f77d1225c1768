"""Functions, classes and methods of code files: a fold over each file's tokens with a stack of open brackets.

A file is one row and stays where it is read; nothing is shuffled.  The fold keeps
offsets into the text, so every symbol is one slice of it and the work is linear.
Scripts end blocks by braces, Python ends them by indentation.  What a damaged part
leaves open is closed by the next declaration (Python) or, in a script whose
brackets do not match, by the next declaration that stands no deeper than the line
with the open bracket; so damage costs only its own symbols.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "array<struct<symbol_name: string, symbol_type: string, start_line: int, end_line: int, content: string, twin: int>>"
_ARROW = pa.list_(pa.struct([
    ("symbol_name", pa.string()), ("symbol_type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("content", pa.string()), ("twin", pa.int32())]))
#: Rows turned into Python objects at a time.
_SLICE = 64

Found = tuple[str, str, int, int]   # name, kind, start, end


def _with_symbols(files: DataFrame, find: Callable[[str], list[Found]]) -> DataFrame:
    """``files(repo_id, path, content)`` with ``symbols``: inner ones before their class, those that start on one line numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = [None if text is None else _described(text, find) for text in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _ARROW)], ["repo_id", "path", "content", "symbols"])

    return files.select("repo_id", "path", "content").mapInArrow(run, f"repo_id string, path string, content string, symbols {SYMBOLS}")


def _described(text: str, find: Callable[[str], list[Found]]) -> list[dict]:
    breaks = [m.start() for m in re.finditer("\n", text)]
    twins: dict[int, int] = {}
    rows = []
    for name, kind, start, end in sorted(find(text), key=lambda s: (s[3], -s[2])):
        line = bisect_right(breaks, start - 1) + 1
        twin = twins[line] = twins.get(line, -1) + 1
        rows.append({"symbol_name": name, "symbol_type": kind, "start_line": line, "end_line": bisect_right(breaks, end - 1) + 1,
                     "content": text[start:end], "twin": twin})
    return rows


# -- Python --------------------------------------------------------------------------------------
_PYTHON = re.compile(
    r'(?P<line>\n)|(?P<comment>#[^\n]*+)|(?P<string>"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
    r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')"
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\r?\n)|(?P<code>[^\n"'#()\[\]{}\\]++)|.""", re.S)
_DECLARED = re.compile(r"([ \t\f]*+)((?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*+))")


@dataclass
class _Block:
    indent: int
    kind: str
    name: str
    start: int
    inside: str | None      # "function" or "class": the closest of them that encloses it, functions first


def python_found(text: str) -> list[Found]:
    found: list[Found] = []
    blocks: list[_Block] = []
    depth, end, heading = 0, 0, False       # open brackets; end of the last code; whether a header is being read
    fresh, joined = True, False             # at the start of a line; that goes on the line before
    held: tuple[int, int] | None = None     # end and depth before decorators that stand in open brackets

    def close(indent: int) -> None:
        while blocks and blocks[-1].indent >= indent:
            b = blocks.pop()
            if b.inside != "function":
                found.append((b.name, "method" if b.kind == "function" and b.inside else b.kind, b.start, end))

    for m in _PYTHON.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            fresh, joined = True, False
            heading = heading and depth > 0
            continue
        if kind == "joined":
            fresh = joined = True
            continue
        code = m[0].rstrip(" \t\r\f") if kind == "code" else m[0]
        if kind == "comment" or not code:
            if kind == "code" and not fresh:
                continue
            if kind == "code":
                # Blanks before a string, bracket or comment at the start of a line.
                indent = _width(m[0])
                ahead = text[m.end():m.end() + 1]
                if depth <= 0 and not joined and ahead not in ("#", "\n", "\r", ""):
                    close(indent)
                    fresh = False
            continue
        if fresh:
            fresh = False
            declared = _DECLARED.match(m[0]) if kind == "code" else None
            decorates = kind == "code" and m[0].lstrip().startswith("@")
            if depth <= 0 or not (decorates or declared or (held and depth > held[1])):
                held = None
            if decorates and depth > 0:
                held = held or (end, depth)
            if declared and depth > 0 and not joined:
                # No bracket reaches over a declaration: what is open before it, or its decorators, is damaged.
                depth, end = 0, held[0] if held else end
                if heading:
                    blocks.pop()
                heading = False
            if depth <= 0 and not joined:
                indent = _width(m[0][:len(m[0]) - len(m[0].lstrip(" \t\f"))]) if kind == "code" else 0
                close(indent)
                depth = 0
                if declared:
                    outer = blocks[-1] if blocks else None
                    inside = outer and ("function" if "function" in (outer.kind, outer.inside) else "class")
                    blocks.append(_Block(indent, "class" if declared[3] == "class" else "function", declared[4], m.start() + declared.start(2), inside))
                    heading = True
        depth += (kind == "open") - (kind == "close")
        end = m.start() + len(code)
    if heading and depth > 0:
        blocks.pop()
    close(0)
    return found


def _width(blank: str) -> int:
    return len(blank) + 7 * blank.count("\t")


def python_symbols(files: DataFrame) -> DataFrame:
    """``files(repo_id, path, content)`` to ``(repo_id, path, content, symbols)``; blocks end by indentation."""
    return _with_symbols(files, python_found)


# -- scripts -------------------------------------------------------------------------------------
_STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_COMMENT = r"/\*[^*]*+(?:\*++[^/*][^*]*+)*+(?:\*++/|\*?\Z)|//[^\n]*+"
_SCRIPT = re.compile(
    rf"(?P<blank>\s++)|(?P<comment>{_COMMENT})|(?P<string>{_STRING})|(?P<word>#?(?:[^\W\d]|\$)[\w$]*+)|(?P<number>\d[\w.]*+)"
    r"|(?P<sign>=>|\?\.|\.\.\.|\+\+|--|[=!]==?|[<>]=|&&|\|\||\?\?|[\s\S])")
#: Inside a function nothing but brackets counts.
_PASSED = re.compile(rf"(?P<blank>[^\"'`/(){{}}\[\]]++)|(?P<comment>{_COMMENT})|(?P<string>{_STRING})|(?P<sign>[\s\S])")
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_VARIABLES = ("const", "let", "var")
_MODIFIERS = ("public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "accessor", "*")
_NO_METHODS = ("if", "for", "while", "switch", "catch", "with", "function", "return", "await", "super", "import", "new", "typeof")
# A value is due after these; a slash then opens a regular expression, and a function is no declaration.
_VALUE_WORDS = ("return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "yield", "await", "instanceof", "extends")
_VALUE_SIGNS = ("=", "(", "[", ",", ":", "?", "!", "&", "|", "&&", "||", "??", "=>", "+", "-", "*", "/", "%", "<", ">", "==", "===", "!=", "!==", "...", "~", "^", ".")
_TYPE_SIGNS = (":", "<", "|", "&", ",", "=", "=>", "(", "[", "?")
_GOES_ON = (".", "?.", "?", ":", "&", "&&", "|", "||", "??", "+", "*", "/", "-", "=", "==", "===", "!=", "!==", "=>", ",", "(", "[", "`", "<", ">", "%", "^", ")", "]", "}")
_GOES_ON_WORDS = ("instanceof", "in", "as", "satisfies", "of")
_DECLARERS = ("function", "class", "export", "const", "let", "var", "import", "interface", "async", "abstract", "type", "enum", "namespace", "declare")
_ARROW_VALUE = re.compile(r"a?(?:n|(?:<.*>)?p(?::.*)?)\Z")


@dataclass(slots=True)
class _Pending:
    """A declaration whose body may come."""

    kind: str
    start: int
    name: str | None = None
    ready: bool = False     # its parameters are read
    symbol: bool = True
    angle: int = 0


@dataclass(slots=True)
class _Variables:
    """A ``const``, ``let`` or ``var`` statement; ``shape`` is the value so far, a sign per token."""

    start: int
    mark: int
    name: str | None = None
    current: tuple[int, int] | None = None
    in_value: bool = False
    shape: str | None = ""
    angle: int = 0


@dataclass(slots=True)
class _Frame:
    sign: str
    start: int = 0
    indent: int = 0
    role: tuple | None = None               # of parentheses: what they are the parameters of
    owner: tuple[str, str, int] | None = None
    in_class: bool = False
    body: bool = False                      # of a class
    passed: bool = False                    # inside a function
    prev: str = ""                          # the last token here, and where it is
    prev_start: int = 0
    end: int = 0
    named: bool = False                     # whether that token can name a method
    head: int = 0                           # where a method that it names would start
    pending: _Pending | None = None
    variables: _Variables | None = None
    generic: list | None = None             # a name before type parameters: its place, its head, their depth and end


class _ScriptFold:
    def __init__(self, text: str, recover: bool):
        self.text, self.recover = text, recover
        self.found: list[Found] = []
        self.stack = [_Frame("")]
        self.balanced = True
        self.closed = (-1, -1)              # the last pair of parentheses

    def run(self) -> list[Found]:
        text, at, line = self.text, 0, True
        while at < len(text):
            top = self.stack[-1]
            if top.sign == "`":
                at = self._template(at)
                continue
            m = (_PASSED if top.passed and not self.recover else _SCRIPT).match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind in ("blank", "comment"):
                line = line or "\n" in m[0]
                continue
            if top.passed and not self.recover and kind == "string":
                continue
            if kind == "sign" and m[0] == "/" and self._value_due(m.start()) and (literal := _REGEX.match(text, m.start())):
                kind, m, at = "string", literal, literal.end()
            if self.recover and line and kind == "word" and m[0] in _DECLARERS:
                self._drop_open(m.start())
            self._token(kind, m[0], m.start(), at, line)
            line = False
        self.balanced = self.balanced and len(self.stack) == 1
        self._end_variables(self.stack[0])
        return self.found

    # -- tokens ------------------------------------------------------------------
    def _token(self, kind: str, token: str, start: int, end: int, line: bool) -> None:
        top = self.stack[-1]
        if kind == "sign" and token in ")]}":
            self._close(token, end)
            return
        if not top.passed:
            if line and top.variables and self._ended(top, kind, token):
                self._end_variables(top)
            if top.pending and top.pending.ready and top.prev == ")" and (
                token not in ("{", ":") or (line and token == "{" and top.pending.kind == "method" and not top.body)
            ):
                top.pending = None
            self._shape(top, kind, token, start, end)
        if kind == "sign" and token in "([{`":
            self._open(top, token, start)
            return
        if not top.passed:
            if kind == "word" and top.prev not in (".", "?."):
                self._word(top, token, start)
            elif kind == "sign":
                self._sign(top, token, start, end)
            if not (top.prev in _MODIFIERS and top.named):
                top.head = start
            top.named = kind in ("word", "string", "number") or token == "*"
        top.prev, top.prev_start, top.end = token if kind != "string" else '"', start, end

    def _word(self, top: _Frame, word: str, start: int) -> None:
        pending = top.pending
        if top.variables and top.variables.name is not None:
            return
        if word in _VARIABLES and top.prev not in (":", ",") and not (top.body and top.prev != "static"):
            self._end_variables(top)
            top.variables = _Variables(start, len(self.found))
        elif word == "enum" and top.variables:
            top.variables = None
        elif word == "function":
            declared = top.prev_start if top.prev == "async" else start
            before = self._before_async(top) if top.prev == "async" else top.prev
            value = before in _VALUE_SIGNS or before in _VALUE_WORDS or (not before and top.sign in ("(", "["))
            top.pending = _Pending("function", declared, symbol=not value)
        elif word == "class":
            top.pending = _Pending("class", start, symbol=top.prev != "abstract")
        elif pending and pending.name is None and not pending.ready and pending.angle == 0 and word not in ("extends", "implements"):
            if pending.kind == "function" or top.prev == "class":
                pending.name = word

    def _before_async(self, top: _Frame) -> str:
        """The sign or word before ``async``."""
        text, at = self.text, top.prev_start - 1
        while at >= top.start and text[at].isspace():
            if text[at] == "\n":
                return ";"
            at -= 1
        if at < 0 or at < top.start:
            return ""
        word = _WORD_BEFORE.search(text, max(0, at - 20), at + 1)
        return word[0] if word else ("" if at == top.start and top.sign == "{" else text[at])

    def _sign(self, top: _Frame, sign: str, start: int, end: int) -> None:
        pending = top.pending
        if sign == ";":
            if top.variables:
                top.end = end
                self._end_variables(top)
            top.pending = None
        elif pending and sign in "<>":
            pending.angle = max(0, pending.angle + (1 if sign == "<" else -1))
        elif pending and pending.ready and pending.angle == 0 and sign in (",", "=>", "="):
            top.pending = None
        self._generic(top, sign, end)

    def _generic(self, top: _Frame, sign: str, end: int) -> None:
        """Follow the type parameters of a name, so that the name is known at their end."""
        g = top.generic
        if sign == "<":
            if g and g[3] > 0:
                g[3] += 1
            else:
                top.generic = [top.prev_start, top.end, top.head, 1, 0] if top.named else None
        elif sign == ">" and g and g[3] > 0:
            g[3], g[4] = g[3] - 1, end
        elif sign == ";":
            top.generic = None

    def _open(self, top: _Frame, sign: str, start: int) -> None:
        if top.passed and not self.recover:
            self.stack.append(_Frame(sign, start, passed=True))
            return
        inner = _Frame(sign, start, self._indent(start), in_class=top.in_class, passed=top.passed)
        if not top.passed:
            variables, pending = top.variables, top.pending
            inner.passed = bool(variables and variables.name is not None)
            if sign == "(" and not inner.passed:
                if pending and pending.kind == "function" and not pending.ready and pending.angle == 0:
                    inner.role = ("parameters",)
                elif not pending or (pending.kind == "method" and not pending.ready):
                    inner.role = self._method_role(top)
            elif sign == "{" and pending and not inner.passed and pending.angle == 0 and top.prev not in _TYPE_SIGNS:
                if pending.kind == "class":
                    if pending.symbol:
                        inner.owner = ("class", pending.name or "AnonymousClass", pending.start)
                        inner.in_class = True
                    inner.body = True
                    top.pending = None
                elif pending.ready:
                    if pending.symbol and pending.name:
                        kind = "method" if pending.kind == "method" or top.in_class else "function"
                        inner.owner = (kind, pending.name, pending.start)
                        inner.passed = True
                    top.pending = None
        self.stack.append(inner)

    def _method_role(self, top: _Frame) -> tuple | None:
        """The name before parentheses and where the method would start."""
        text = self.text
        if top.prev == ">":
            g = top.generic
            name, head = (text[g[0]:g[1]], g[2]) if g and g[3] == 0 and g[4] == top.end else (None, 0)
        else:
            name, head = (text[top.prev_start:top.end], top.head) if top.named and top.prev != "*" else (None, 0)
        return None if name is None or name in _NO_METHODS else ("method", name, head)

    def _close(self, sign: str, end: int) -> None:
        place = len(self.stack) - 1
        while place and self.stack[place].sign != _PAIRS[sign]:
            place -= 1
        self.balanced = self.balanced and place == len(self.stack) - 1
        if not place:
            return
        frame = self.stack[place]
        if place == len(self.stack) - 1:
            self._end_variables(frame)
        del self.stack[place:]
        top = self.stack[-1]
        if frame.owner:
            kind, name, start = frame.owner
            self.found.append((name, kind, start, end))
        if sign == ")":
            self.closed = (frame.start, end)
        if frame.sign == "{" and top.sign == "`":
            return  # the end of a template's expression
        if not top.passed:
            if frame.role and frame.role[0] == "parameters" and top.pending:
                top.pending.ready = True
            elif frame.role and frame.role[0] == "method":
                top.pending = _Pending("method", frame.role[2], frame.role[1], ready=True)
            self._shape_closed(top, frame, end)
            keeps_head = top.prev in _MODIFIERS and top.named
            top.named = sign == "]"
            if not keeps_head:
                top.head = frame.start
        top.prev, top.prev_start, top.end = sign, frame.start, end

    def _template(self, at: int) -> int:
        """The rest of a template's text; its end, or an expression in it."""
        m = _TEMPLATE.match(self.text, at)
        frame, end = self.stack[-1], m.end() + 1
        if self.text.startswith("${", m.end()):
            self.stack.append(_Frame("{", m.end() + 1, frame.indent, in_class=frame.in_class, passed=frame.passed))
            return end + 1
        if end > len(self.text):
            return end
        self.stack.pop()
        top = self.stack[-1]
        top.prev, top.prev_start, top.end, top.named = '"', frame.start, end, False
        return end

    # -- variables ---------------------------------------------------------------
    def _shape(self, top: _Frame, kind: str, token: str, start: int, end: int) -> None:
        v = top.variables
        if not v or v.name is not None:
            return
        if not v.in_value:
            if token == "<" or token == ">":
                v.angle += 1 if token == "<" else -1
            elif v.current is None and (kind == "word" or token in "{["):
                v.current = (start, end)
            elif token == "=" and v.angle <= 0:
                v.in_value, v.shape = True, ""
            elif token == "," and v.angle <= 0:
                v.current = None
            return
        if token == "," and (v.shape is None or v.shape.count("<") <= v.shape.count(">")):
            v.current, v.in_value, v.shape, v.angle = None, False, "", 0
        elif v.shape is None or token in "([{":
            return
        elif v.shape.endswith("f"):
            self._valued(v, token != "*")
        elif token == "=>":
            self._valued(v, bool(_ARROW_VALUE.match(v.shape)))
        elif kind == "word" and token == "function" and v.shape in ("", "a"):
            v.shape += "f"
        else:
            v.shape += "a" if token == "async" and not v.shape else "n" if kind == "word" else token if token in "<>:" else "o"

    def _shape_closed(self, top: _Frame, frame: _Frame, end: int) -> None:
        v = top.variables
        if not v or v.name is not None:
            return
        if not v.in_value:
            if v.current and v.current[0] == frame.start:
                v.current = (frame.start, end)
        elif v.shape is not None:
            if v.shape.endswith("f"):
                self._valued(v, True)
            else:
                v.shape += {"(": "p", "[": "b"}.get(frame.sign, "c")

    def _valued(self, v: _Variables, function: bool) -> None:
        """The value is a function, which makes the whole statement one symbol, or it is none."""
        if function and v.current:
            v.name = self.text[slice(*v.current)]
            del self.found[v.mark:]
        else:
            v.shape = None

    def _ended(self, top: _Frame, kind: str, token: str) -> bool:
        """Whether a statement is over when ``token`` begins a line: it is whole, and the token does not go on with it."""
        if top.prev in _VALUE_SIGNS or top.prev in _VALUE_WORDS or top.prev in _VARIABLES:
            return False
        if kind == "word":
            return token not in _GOES_ON_WORDS
        return token not in _GOES_ON or (top.prev == "}" and token in ("(", "[", "`"))

    def _end_variables(self, top: _Frame) -> None:
        v, top.variables = top.variables, None
        if v and v.name is not None:
            self.found.append((v.name, "method" if top.in_class else "function", v.start, top.end))

    # -- helpers -----------------------------------------------------------------
    def _value_due(self, at: int) -> bool:
        """Whether a slash opens a regular expression, by what stands before it."""
        text, at = self.text, at - 1
        while at >= 0 and text[at].isspace():
            at -= 1
        if at < 0:
            return True
        if text[at] == ")":
            word = self.closed[1] == at + 1 and _WORD_BEFORE.search(text[max(0, self.closed[0] - 12):self.closed[0]].rstrip())
            return bool(word) and word[0] in ("if", "while", "for", "with")
        word = _WORD_BEFORE.search(text, max(0, at - 20), at + 1)
        return word[0] in _VALUE_WORDS if word else text[at] not in "]}\"'`"

    def _indent(self, at: int) -> int:
        if not self.recover:
            return 0
        line = self.text.rfind("\n", 0, at) + 1
        return len(self.text[line:at]) - len(self.text[line:at].lstrip())

    def _drop_open(self, at: int) -> None:
        """A declaration begins a line: brackets that opened in lines no less indented are damaged."""
        line = self.text.rfind("\n", 0, at) + 1
        while len(self.stack) > 1 and self.stack[-1].indent >= at - line:
            self.stack.pop()
            top = self.stack[-1]
            top.pending = top.variables = None
            top.prev, top.named = ";", False


def script_found(text: str) -> list[Found]:
    fold = _ScriptFold(text, recover=False)
    found = fold.run()
    return found if fold.balanced else _ScriptFold(text, recover=True).run()


def script_symbols(files: DataFrame) -> DataFrame:
    """``files(repo_id, path, content)`` to ``(repo_id, path, content, symbols)``; blocks end by their braces."""
    return _with_symbols(files, script_found)
