"""Symbols, imports and exports of one ECMAScript or TypeScript source, from its tokens and matched brackets.

A helper of ``extract``: one file in, rows out. What it can't make sense of is skipped, so a broken file still yields
the rest; brackets or texts left open make its status ``syntax_error``.
"""

from __future__ import annotations

import bisect
import re

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
_TEXT = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d[\w.]*")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "declare", "abstract", "accessor", "*"}
_STARTS = {"const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "while", "do", "switch", "try", "throw", "interface", "type", "enum", "async", "abstract", "declare"}
_OPERAND_ENDS = {")", "]", "}"}
_TYPED = ("typescript", "tsx", "jsx")


class _Source:
    """Tokens (kind, text, start, end) and, by the place of each opening bracket, the place of the closing one."""

    def __init__(self, source: str) -> None:
        self.source, self.broken = source, False
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.tokens: list[tuple[str, str, int, int]] = []
        self.match: dict[int, int] = {}
        self._read()

    def at(self, offset: int) -> tuple[int, int]:
        """Line and column, from 1."""
        line = bisect.bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def _template(self, at: int) -> int:
        """The end of the template text that begins at ``at``; what stands in its braces is left unread."""
        at, deep = at + 1, 0
        while at < len(self.source):
            c = self.source[at]
            if c == "\\":
                at += 1
            elif c == "`" and not deep:
                return at + 1
            elif self.source.startswith("${", at):
                deep, at = deep + 1, at + 1
            elif c == "}" and deep:
                deep -= 1
            elif c == "`":
                at = self._template(at) - 1
            at += 1
        self.broken = True
        return at

    def _read(self) -> None:
        at, source, open_ = 0, self.source, []
        while at < len(source):
            if m := _SPACE.match(source, at):
                at = m.end()
                continue
            c = source[at]
            last = self.tokens[-1] if self.tokens else ("mark", "", 0, 0)
            after_operand = last[0] in ("name", "number", "text") and last[1] not in ("return", "typeof", "case", "in", "of") or last[1] in _OPERAND_ENDS
            if m := _TEXT.match(source, at):
                kind, end = "text", m.end()
            elif c == "`":
                kind, end = "text", self._template(at)
            elif c == "/" and not after_operand and last[1] != "<" and (m := _PATTERN.match(source, at)):
                kind, end = "text", m.end()
            elif m := _NAME.match(source, at):
                kind, end = "name", m.end()
            elif m := _NUMBER.match(source, at):
                kind, end = "number", m.end()
            else:
                kind, end = "mark", at + (3 if source.startswith("...", at) else 2 if source.startswith("=>", at) else 1)
            if kind == "mark" and c in _CLOSES:
                open_.append((c, len(self.tokens)))
            elif kind == "mark" and c in ")]}":
                if open_ and _CLOSES[open_[-1][0]] == c:
                    self.match[open_.pop()[1]] = len(self.tokens)
                else:
                    self.broken = True
            self.tokens.append((kind, source[at:end], at, end))
            at = end
        self.broken |= bool(open_)


class _Reader:
    def __init__(self, source: str, language: str, module: str) -> None:
        self.s, self.module, self.typed = _Source(source), module, language in _TYPED
        self.t = self.s.tokens
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []

    # helpers over places of tokens; hi is where the part that is read ends
    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def skip(self, i: int) -> int:
        """The place after token ``i``, or after its closing bracket."""
        return self.s.match.get(i, i) + 1

    def line(self, i: int) -> int:
        return self.s.at(self.t[i][2])[0]

    def add(self, first: int, last: int, name: str, kind: str, parent: int | None, chain: str, exported: bool, signature: str | None) -> int:
        (line, column), (end_line, end_column) = self.s.at(self.t[first][2]), self.s.at(self.t[last][3])
        own = f"{chain}.{name}" if chain else name
        qualified = own if kind == "IMPORT" or not self.module else f"{self.module}.{own}"
        bases, implements = self._bases(line) if kind == "CLASS" else ([], [])
        self.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "line_start": line, "line_end": end_line, "start_column": column, "end_column": end_column, "signature": signature, "parent_index": parent, "bases": bases, "implements": implements, "exported": exported})
        return len(self.symbols) - 1

    def _bases(self, line: int) -> tuple[list[str], list[str]]:
        """Names after ``extends`` and ``implements`` on the line of the class; type arguments are cut off."""
        row = self.s.source.split("\n")[line - 1]
        names = lambda part: [n for x in part.split(",") if (n := x.split("<")[0].strip().strip(";"))]
        head, _, implemented = row.partition(" implements ")
        extended = re.sub(r"^.*?\bextends\b", "", head).split("{")[0] if re.search(r"\bextends\b", head) else ""
        return names(extended), names(implemented.split("{")[0])

    def span(self, a: int, b: int) -> str:
        return self.s.source[self.t[a][2] : self.t[b][3]] if a <= b < len(self.t) else ""

    def statement_end(self, i: int, hi: int, commas: bool = False) -> int:
        """Where the expression or statement from ``i`` ends: a semicolon, a comma if asked, or a line on which another begins."""
        first = i
        while i < hi:
            text = self.text(i)
            if text == ";" or (commas and text == ","):
                return i
            if i > first and self.line(i) > self.s.at(self.t[i - 1][3])[0]:
                before = self.t[i - 1]
                ended = before[0] in ("name", "number", "text") or before[1] in (")", "]", "}", ">")
                if ended and before[1] not in ("extends", "implements", "of", "in", "new", "typeof", "await") and (self.kind(i) == "name" and text not in ("instanceof", "in", "as", "of", "extends", "implements", "from") or text in ("@", "}")):
                    return i
            i = self.skip(i)
        return hi

    def arrow(self, i: int, hi: int) -> tuple[int, int] | None:
        """(place of the arrow, first token of the parameters) if an arrow function begins at ``i``."""
        at = i + (self.text(i) == "async" and self.text(i + 1) != "=>")
        if self.text(at) == "<":  # type parameters
            deep, k = 0, at
            while k < hi:
                deep += {"<": 1, ">": -1}.get(self.text(k), 0)
                k += 1
                if not deep:
                    break
            at = k
        if self.kind(at) == "name" and self.text(at + 1) == "=>":
            return at + 1, at
        if self.text(at) != "(" or at not in self.s.match:
            return None
        k = self.s.match[at] + 1
        if self.text(k) == ":":  # the type of what it returns
            while k < hi and self.text(k) not in ("=>", ";", ",", "="):
                k = self.skip(k)
        return (k, at) if self.text(k) == "=>" and k < hi else None

    def push_arrow(self, i: int, hi: int, found: tuple[int, int], name: str, parent: int | None, chain: str, exported: bool) -> int:
        """Adds the arrow function at ``i`` and reads its body; where it ends."""
        arrow, params = found
        body = arrow + 1
        end = self.skip(body) if self.text(body) == "{" else self.statement_end(body, hi, commas=True)
        signature = name + self.span(params, self.s.match[params]) if self.text(params) == "(" else f"{name} = {self.span(i, arrow)}"
        own = self.add(i, max(end - 1, arrow), name, "ARROW_FUNCTION", parent, chain, exported, signature)
        self.read(body, end, own, f"{chain}.{name}" if chain else name)
        return end

    def read(self, i: int, hi: int, parent: int | None, chain: str) -> None:
        while i < hi:
            i = self.one(i, hi, parent, chain, False)

    def one(self, i: int, hi: int, parent: int | None, chain: str, exported: bool) -> int:
        """Reads what begins at ``i``; where to go on."""
        text, kind, before = self.text(i), self.kind(i), self.text(i - 1)
        if kind != "name" or before == "." or self.text(i + 1) == ":":
            return i + 1
        inner = f"{chain}." if chain else ""
        if text == "import" and self.text(i + 1) not in ("(", "."):
            return self.read_import(i, hi)
        if text == "export":
            return self.read_export(i, hi, parent, chain)
        if text in ("const", "let", "var") and not (text == "const" and self.text(i + 1) == "enum"):
            return self.declarators(i, hi, parent, chain, exported)
        if text == "function" or (text == "async" and self.text(i + 1) == "function"):
            at = i + 1 + (text == "async")
            star = self.text(at) == "*"
            at += star
            if self.kind(at) == "name" and before in ("", ";", "{", "}", ")", "export", "default") or (self.kind(at) == "name" and i and self.line(i) > self.line(i - 1)):
                name, params = self.text(at), at + 1
                while params < hi and self.text(params) not in ("(", "{"):
                    params += 1
                body = self.s.match.get(params, params) + 1
                while body < hi and self.text(body) not in ("{", ";") and params in self.s.match:
                    body = self.skip(body) if self.text(body) != "{" else body
                closed = params in self.s.match and self.text(body) == "{" and body in self.s.match
                end = self.s.match[body] + 1 if closed else min(hi, len(self.t))
                signature = name + self.span(params, self.s.match[params]) if params in self.s.match else name
                own = self.add(i, end - 1, name, "ASYNC_FUNCTION" if text == "async" else "FUNCTION", parent, chain, exported, signature)
                if params in self.s.match:
                    self.read(body, end, own, inner + name)
                return end if closed else at + 1
        if text == "class" and self.kind(i + 1) == "name" and self.text(i + 1) not in ("extends", "implements") and before not in ("=", "(", ",", "return", "=>"):
            body = i + 2
            while body < hi and self.text(body) != "{":
                body += 1
            end = self.skip(body) if body in self.s.match else hi
            own = self.add(i, min(end, len(self.t)) - 1, self.text(i + 1), "CLASS", parent, chain, exported, self.text(i + 1))
            self.members(body + 1, end - 1, own, inner + self.text(i + 1))
            return end
        if text == "class":
            body = i + 1
            while body < hi and self.text(body) != "{":
                body += 1
            self.members(body + 1, self.s.match.get(body, hi), parent, chain)
            return self.skip(body) if body in self.s.match else hi
        if self.typed and self.kind(i + 1) == "name" and (text in ("interface", "enum") or (text == "type" and self.text(i + 2) in ("=", "<")) or (text == "const" and self.text(i + 1) == "enum")):
            at = i + (text == "const")
            name = self.text(at + 1)
            if text == "type":
                end = self.statement_end(i + 2, hi)
            else:
                end = at + 2
                while end < hi and self.text(end) != "{":
                    end += 1
                end = self.skip(end) if end < hi else hi
            self.add(i, end - 1, name, {"interface": "INTERFACE", "type": "TYPE_ALIAS"}.get(text, "ENUM"), parent, chain, exported, name)
            return end
        return i + 1

    def declarators(self, i: int, hi: int, parent: int | None, chain: str, exported: bool) -> int:
        """const, let and var. A ``var`` is no symbol and no export, but may require a module."""
        lexical, at = self.text(i) != "var", i + 1
        while at < hi:
            value, first, name = at, at, self.span(at, self.s.match.get(at, at))
            at = self.skip(at)
            value = at
            while value < hi and self.text(value) not in ("=", ",", ";", "of", "in") and not (self.line(value) > self.line(value - 1) and self.text(value) in _STARTS):
                value = self.skip(value)
            if self.text(value) != "=" or value >= hi:
                end = value
                if lexical and exported and name:
                    self.add(first, end - 1, name, "VARIABLE", parent, chain, exported, name)
            else:
                found = self.arrow(value + 1, hi)
                if found and lexical and name:
                    end = self.push_arrow(value + 1, hi, found, name, parent, chain, exported)
                else:
                    end = self.statement_end(value + 1, hi, commas=True)
                    if lexical and exported and name:
                        self.add(first, end - 1, name, "VARIABLE", parent, chain, exported, name)
                    self.read(value + 1, end, parent, chain)
                module = next((self.text(k + 2) for k in range(value + 1, end - 2) if self.text(k) == "require" and self.text(k + 1) == "(" and self.kind(k + 2) == "text"), None)
                if module:
                    self.imports.append({"source": module[1:-1], "imported_name": name or None, "alias": None, "kind": "commonjs", "start_line": self.line(first), "end_line": self.s.at(self.t[end - 1][3])[0]})
            if self.text(end) != "," or end >= hi:
                return end
            at = end + 1
        return hi

    def members(self, i: int, hi: int, parent: int | None, chain: str) -> None:
        """The methods and fields of a class."""
        while i < hi:
            first = i
            while i < hi and self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":", "?", "<"):
                i += 1
            name = self.span(i, self.s.match.get(i, i))
            if self.kind(i) not in ("name", "text", "number") and self.text(i) != "[":
                i = self.skip(i)
                continue
            k = self.skip(i)
            while k < hi and self.text(k) in ("?", "!"):
                k += 1
            if self.text(k) == "<":
                while k < hi and self.text(k) != "(":
                    k += 1
            if self.text(k) == "(" and k in self.s.match:
                body = self.s.match[k] + 1
                while body < hi and self.text(body) not in ("{", ";") and not (self.line(body) > self.line(body - 1) and self.text(body - 1) != ":"):
                    body = self.skip(body)
                if self.text(body) == "{" and body < hi:
                    end = self.skip(body)
                    own = self.add(first, end - 1, name, "METHOD", parent, chain, False, name + self.span(k, self.s.match[k]))
                    self.read(body, end, own, f"{chain}.{name}" if chain else name)
                    i = end
                else:  # a declaration without a body
                    i = body + 1 if self.text(body) == ";" else body
                continue
            while k < hi and self.text(k) not in ("=", ";") and not (k > i + 1 and self.line(k) > self.line(k - 1) and self.text(k - 1) not in (":", "|", "&")):
                k = self.skip(k)
            if self.text(k) == "=" and k < hi:
                found = self.arrow(k + 1, hi)
                if found:
                    i = self.push_arrow(k + 1, hi, found, name, parent, chain, False)
                else:
                    end = self.statement_end(k + 1, hi)
                    self.read(k + 1, end, parent, chain)
                    i = max(end, k + 1)
            else:
                i = max(k, i + 1)
            i += self.text(i) == ";"

    def specifiers(self, i: int) -> list[tuple[int, int]]:
        """(place of the name, place of its alias or -1) of each part of a braced list."""
        out, k, end = [], i + 1, self.s.match.get(i, i)
        while k < end:
            k += self.text(k) == "type" and self.kind(k + 1) == "name" and self.text(k + 1) not in ("as",)
            if self.kind(k) in ("name", "text"):
                alias = k + 2 if self.text(k + 1) == "as" else -1
                out.append((k, alias))
                k = max(k, alias)
            k += 1
        return out

    def read_import(self, i: int, hi: int) -> int:
        rows: list[tuple[str | None, str | None, int]] = []  # imported name, alias, place of the bound name
        k, bare = i + 1, self.kind(i + 1) == "text"
        k += self.text(k) == "type" and (self.kind(k + 1) == "name" and self.text(k + 1) != "from" or self.text(k + 1) in ("{", "*"))
        while k < hi and not bare and self.text(k) != "from" and self.text(k) != ";":
            if self.text(k) == "{":
                rows += [(self.text(n), self.text(a) if a >= 0 else None, a if a >= 0 else n) for n, a in self.specifiers(k)]
            elif self.text(k) == "*" and self.text(k + 1) == "as":
                rows.append((None, self.text(k + 2), k + 2))
                k += 2
            elif self.kind(k) == "name":
                rows.append((None, self.text(k), k))
            k = self.skip(k)
        k += not bare
        if self.kind(k) != "text":
            return i + 1
        for _, _, place in rows:
            self.add(place, place, self.text(place), "IMPORT", None, "", False, None)
        for name, alias, _ in rows or [(None, None, 0)]:
            self.imports.append({"source": self.text(k)[1:-1], "imported_name": name, "alias": alias, "kind": "es_module", "start_line": self.line(i), "end_line": self.line(k)})
        return k + 1

    def read_export(self, i: int, hi: int, parent: int | None, chain: str) -> int:
        k, is_default = i + 1, self.text(i + 1) == "default"
        k += is_default
        names: list[tuple[str, str]] = []
        kind = "default" if is_default else "named"
        at = k + (self.text(k) in ("async", "declare", "abstract") and self.text(k + 1) in ("function", "class", "enum", "const"))
        if self.text(k) == "*":
            names.append(("*", "star"))
            end = self.statement_end(k, hi)
        elif self.text(k) == "{" and not is_default:
            names += [(self.text(a if a >= 0 else n), "named") for n, a in self.specifiers(k)]
            end = self.skip(k)
            end += 2 * (self.text(end) == "from")
        elif self.text(at) in ("function", "class") or (self.typed and self.text(at) in ("interface", "type", "enum") and self.kind(at + 1) == "name"):
            name = at + 1 + (self.text(at + 1) == "*")
            named = self.kind(name) == "name" and self.text(name) not in ("extends", "implements")
            names.append((self.text(name) if named else "default", kind))
            end = max(self.one(at if self.text(k) != "async" else k, hi, parent, chain, True), name)
        elif self.text(k) in ("const", "let") and not is_default:
            made = len(self.symbols)
            end = self.one(k, hi, parent, chain, True)
            own = [s["name"] for s in self.symbols[made:] if s["parent_index"] == parent and s["exported"]]
            names += [(n, "named") for n in own]
        elif is_default:
            names.append(("default", "default"))
            found = self.arrow(k, hi)
            body = found[0] + 1 if found else k
            end = self.skip(body) if found and self.text(body) == "{" else self.statement_end(k, hi)
            self.read(k, end, parent, chain)
        else:
            end = k
        last = min(max(end, k) - 1, len(self.t) - 1)
        end_line = self.s.at(self.t[last][3])[0]
        self.exports += [{"name": n, "kind": x, "start_line": self.line(i), "end_line": end_line} for n, x in names]
        return max(end, i + 1)


def read(source: str, language: str, module: str) -> tuple[str, list[dict], list[dict], list[dict]]:
    """Status, symbols, imports and exports. ``language``: javascript, jsx, typescript or tsx."""
    reader = _Reader(source, language, module)
    reader.read(0, len(reader.t), None, "")
    return "syntax_error" if reader.s.broken else "parsed", reader.symbols, reader.imports, reader.exports
