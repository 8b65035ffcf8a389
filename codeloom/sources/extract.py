"""Symbols, imports, calls and fields of source files, one Arrow batch of files at a time.

Parsing is the one step that is not relational: :func:`parse_files` runs it where the files are
read and yields a row a file with nested results, which :func:`relations` explodes into the
canonical tables. A file that cannot be parsed gives no rows, not an error.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.lexer import Source

_SYM = "struct<ordinal:int,name:string,symbol_type:string,signature:string,docstring:string,line_start:int,line_end:int,parent_ordinal:int,is_exported:boolean>"
SCHEMA = f"path string, symbols array<{_SYM}>, imports array<struct<ordinal:int,import_name:string,from_module:string>>, calls array<struct<ordinal:int,call_name:string,line:int,context:string>>, fields array<struct<symbol_ordinal:int,ordinal:int,name:string,type:string,optional:boolean,default_value:string>>"


class Found:
    """What one file holds; symbols are given in the order of each language's rules."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.symbols: list[dict] = []
        self.imports: list[tuple[str, str | None]] = []
        self.called: dict[tuple[str, int], str] = {}
        self.fields: list[dict] = []

    def add(self, name, kind, sig, doc, start, end, exported, parent=None) -> int:
        self.symbols.append({"ordinal": len(self.symbols), "name": name, "symbol_type": kind, "signature": sig, "docstring": doc, "line_start": start, "line_end": end, "parent_ordinal": parent, "is_exported": exported})
        return len(self.symbols) - 1

    def call(self, name: str, line: int) -> None:
        self.called.setdefault((name, line), self.lines[line - 1].rstrip("\r") if line <= len(self.lines) else "")

    def field(self, owner: int, name: str, kind: str, optional: bool, default: str | None = None) -> None:
        n = sum(f["symbol_ordinal"] == owner for f in self.fields)
        self.fields.append({"symbol_ordinal": owner, "ordinal": n, "name": name, "type": kind, "optional": optional, "default_value": default})

    def parents(self) -> None:
        """Methods belong to the first class of the file that holds their line."""
        classes = [s for s in self.symbols if s["symbol_type"] == "class"]
        for s in self.symbols:
            if s["symbol_type"] == "method" and s["parent_ordinal"] is None:
                s["parent_ordinal"] = next((c["ordinal"] for c in classes if c["line_start"] < s["line_start"] <= c["line_end"]), None)


def parse(text: str, language: str) -> Found:
    out = Found(text)
    try:
        {"python": _python, "rust": _rust, "go": _go, "c": _c, "java": _java, "javascript": _script, "typescript": _script, "markdown": _markdown}[language](text, language, out)
    except (KeyError, SyntaxError, ValueError, RecursionError, IndexError):
        return Found(text)
    return out


# ---------------------------------------------------------------- Python


def _python(text: str, _: str, out: Found) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _python_lines(text, out)
    inside: dict[ast.AST, list[ast.AST]] = {tree: []}
    for node in ast.walk(tree):
        for kid in ast.iter_child_nodes(node):
            inside[kid] = [*inside[node], node]
    order = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    at_line: dict[int, int] = {}

    def parent(node):
        for a in reversed(inside[node]):
            if isinstance(a, ast.ClassDef) and a.lineno in at_line:
                return at_line[a.lineno]
        return None

    doc = lambda n: next((ast.get_source_segment(text, s.value) for s in n.body if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)), None)
    for n in order:
        if isinstance(n, ast.ClassDef):
            nested = any(isinstance(a, ast.ClassDef) for a in inside[n])
            i = at_line[n.lineno] = out.add(n.name, "class", None, doc(n), n.lineno, n.end_lineno, not nested, parent(n))
            for s in n.body:
                if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                    kind, default = ast.unparse(s.annotation), ast.get_source_segment(text, s.value) if s.value else None
                    out.field(i, s.target.id, kind, "Optional" in kind or default is not None, default)
            if not any(f["symbol_ordinal"] == i for f in out.fields):
                for line in out.lines[n.lineno - 1 : n.end_lineno]:
                    m = re.match(r"\s*([^\W\d]\w*)\s*:\s*([^=\n]+)(?:=\s*(.+))?$", line)
                    if m and not line.strip().startswith(("def ", "class ", "if ", "else", "elif", "for ", "while ", "try", "except", "finally", "with ", "return")):
                        out.field(i, m[1], m[2].strip(), "Optional" in m[2] or m[3] is not None, m[3])
    last = max((s.end_lineno for s in tree.body), default=1)
    for s in tree.body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and re.fullmatch(r"[A-Z_0-9]{2,}", s.targets[0].id) and re.search("[A-Z]", s.targets[0].id):
            out.add(s.targets[0].id, "static", ast.get_source_segment(text, s.value), None, tree.body[0].lineno, last, True)
    for n in order:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            method = any(isinstance(a, ast.ClassDef) for a in inside[n])
            m = re.search(rf"def\s+{n.name}\s*(?:\[[^\]]*\])?\s*\(", "\n".join(out.lines[n.lineno - 1 : n.end_lineno]))
            sig = _balanced("\n".join(out.lines[n.lineno - 1 : n.end_lineno])[m.end() - 1 :]) if m else "()"
            out.add(n.name, "method" if method else "function", sig, doc(n), n.lineno, n.end_lineno, not method, parent(n) if method else None)
    for n in order:
        if isinstance(n, ast.Import):
            out.imports += [(a.name, None) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            names = [a.name for a in n.names]
            if n.level:  # the relative part is no module name: the first name takes its place
                module, names = names[0], names[1:]
            else:
                module = n.module
            out.imports += [(x, module) for x in names]
    for n in order:
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.call(n.func.id, n.func.lineno)
            elif isinstance(n.func, ast.Attribute):
                out.call(n.func.attr, n.func.end_lineno)


def _balanced(s: str) -> str:
    depth = 0
    for i, c in enumerate(s):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return s[: i + 1]
    return s


def _python_lines(text: str, out: Found) -> None:
    """By indentation, for files that don't compile."""
    rows = [(i + 1, len(x) - len(x.lstrip()), x) for i, x in enumerate(out.lines) if x.strip()]
    end = lambda k: next((rows[j - 1][0] for j in range(k + 1, len(rows)) if rows[j][1] <= rows[k][1]), rows[-1][0])
    classes = []
    for k, (line, indent, x) in enumerate(rows):
        if m := re.match(r"\s*class\s+(\w+)", x):
            nested = any(a < line <= b for a, b, _ in classes)
            classes.append((line, end(k), out.add(m[1], "class", None, None, line, end(k), not nested)))
    for k, (line, indent, x) in enumerate(rows):
        if m := re.match(r"\s*(?:async\s+)?def\s+(\w+)\s*(\(.*)?", x):
            owner = [i for a, b, i in classes if a < line <= b and indent > 0]
            out.add(m[1], "method" if owner else "function", _balanced(m[2] or "()"), None, line, end(k), not owner, owner[-1] if owner else None)
    for line, _, x in rows:
        if m := re.match(r"\s*import\s+(.+)", x):
            out.imports += [(p.split(" as ")[0].strip(), None) for p in m[1].split(",")]
        elif m := re.match(r"\s*from\s+([\w.]+)\s+import\s+(.+)", x):
            out.imports += [(p.split(" as ")[0].strip(" ()"), m[1]) for p in m[2].split(",")]
        elif not re.match(r"\s*(?:async\s+)?(?:def|class)\b", x):
            for m in re.finditer(r"([^\W\d]\w*)\s*\(", re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", x)):
                if m[1] not in ("if", "elif", "while", "for", "return", "and", "or", "not", "in", "lambda", "with", "assert", "del", "yield"):
                    out.call(m[1], line)


# ---------------------------------------------------------------- Markdown


def _markdown(text: str, _: str, out: Found) -> None:
    fence, start, info, blocks, before = None, 0, "", [], None
    for i, x in enumerate(out.lines, 1):
        m = re.match(r" {0,3}(`{3,}|~{3,})\s*(\S*)", x)
        if fence is None and m:
            fence, start, info = m[1], i, m[2]
        elif fence is not None:
            if m and m[1].startswith(fence) and not m[2]:
                blocks.append((info, start, i))
                fence = None
        elif (m := re.match(r" {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$", x)) and m[2]:
            level = len(m[1])
            before = out.add(m[2], "heading", f"h{level} ({m[1]})", None, i, i, True, before if level > 1 else None)
    if fence is not None:
        blocks.append((info, start, len(out.lines)))
    for info, a, b in blocks:
        body = out.lines[a : b - 1]
        out.add(f"[code: {info or 'unknown'}]", "code_block", info or "unknown", "\n".join(body[:3]) + ("..." if len(body) > 3 else ""), a, b, True)


# ---------------------------------------------------------------- languages with braces

_NOT_CALLS = {
    "rust": {"if", "while", "match", "for", "return", "fn", "in", "let", "mut", "as", "loop", "move", "pub", "where", "impl", "dyn", "use", "mod", "crate", "super"},
    "go": {"if", "for", "switch", "select", "return", "func", "go", "defer", "range", "case", "type", "struct", "interface", "map", "chan", "var", "const", "import", "package", "else"},
    "c": {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "typedef", "struct", "union", "enum", "defined"},
    "java": {"if", "for", "while", "switch", "return", "catch", "new", "synchronized", "super", "this", "throw", "else", "do", "try", "case", "assert", "instanceof"},
    "javascript": {"if", "for", "while", "switch", "return", "catch", "function", "new", "super", "typeof", "await", "async", "else", "do", "case", "throw", "in", "of", "import", "delete", "void", "yield", "constructor"},
}
_NOT_CALLS["typescript"] = _NOT_CALLS["javascript"]


def _body(s: Source, i: int) -> int:
    """The last token of a declaration from i: its closing brace, or the semicolon before one."""
    k = s.find(i, ("{", ";"))
    return len(s.tokens) - 1 if k < 0 else s.match[k] if s.at(k) == "{" else k


def _go(text: str, lang: str, out: Found) -> None:
    s = Source(text, lang)
    n = len(s.tokens)
    upper = lambda x: x[:1].isupper()
    decl, funcs, consts, specs = [], [], [], set()
    for i in range(n):
        if s.tokens[i].kind != "word" or s.at(i - 1) == ".":
            continue
        t = s.at(i)
        if t == "type" and s.depth[i] == 0:
            group = s.at(i + 1) == "("
            last = s.match[i + 1] if group else None
            k = i + 2 if group else i + 1
            while k < n and s.is_word(k) and (last is None or k < last):
                e = _line_end(s, k)
                decl.append((k, i, last if group else e))
                k = e + 1
                if not group:
                    break
        elif t == "interface" and s.at(i + 1) == "{":
            specs.update(range(i + 1, s.match[i + 1] + 1))
        elif t == "func" and s.depth[i] == 0:
            k = i + 1
            method = s.at(k) == "("
            if method:
                k = s.match[k] + 1
            if s.is_word(k):
                funcs.append((i, k, method))
        elif t == "const" and s.depth[i] == 0:
            group = s.at(i + 1) == "("
            last = s.match[i + 1] if group else _line_end(s, i)
            k = i + 2 if group else i + 1
            while k < last and s.is_word(k):
                consts.append((k, i, last))
                k = _line_end(s, k) + 1
    for k, i, last in decl:
        whole = s.span(i, last)
        kind = "struct" if "struct" in whole else "interface" if "interface" in whole else "type"
        ordinal = out.add(s.at(k), "class", kind, s.doc_before(i), s.tokens[i].line, s.end_line(last), upper(s.at(k)))
        if s.at(k + 1) == "struct" and s.at(k + 2) == "{":
            j = k + 3
            while j < s.match[k + 2]:
                e = min(_line_end(s, j), s.match[k + 2] - 1)
                names, m = [s.at(j)], j + 1
                while s.at(m) == "," and m < e:
                    names.append(s.at(m + 1))
                    m += 2
                stop = e if s.tokens[e].kind != "str" else e - 1
                if m <= stop and s.tokens[m].line == s.tokens[j].line:
                    kind = s.span(m, stop)
                    for x in names:
                        out.field(ordinal, x, kind, kind.startswith("*"))
                j = e + 1
    for method in (False, True):
        for i, k, m in funcs:
            if m == method:
                p = s.find(k, ("(",))
                if p < 0:
                    continue
                r = s.match[p] + 1
                sig = s.span(r, s.match[r]) if s.at(r) == "(" else s.span(p, s.match[p])
                b = s.find(r, ("{",))
                last = s.match[b] if b >= 0 and s.tokens[b].line <= s.tokens[s.match[p]].line + 3 else s.match[p]
                out.add(s.at(k), "method" if method else "function", sig, s.doc_before(i), s.tokens[i].line, s.end_line(last), upper(s.at(k)))
    for k, i, last in consts:
        kind = s.at(k + 1) if s.is_word(k + 1) and s.tokens[k + 1].line == s.tokens[k].line else None
        out.add(s.at(k), "static", kind, s.doc_before(i), s.tokens[i].line, s.end_line(last), upper(s.at(k)))
    for i in range(n):
        if s.at(i) == "import" and s.depth[i] == 0 and s.tokens[i].kind == "word":
            last = s.match[i + 1] if s.at(i + 1) == "(" else _line_end(s, i)
            out.imports += [(s.at(j).strip('"`'), None) for j in range(i, last + 1) if s.tokens[j].kind == "str"]
    skip = {k for _, k, _ in funcs} | specs
    _calls(s, out, lambda i: i in skip)


def _line_end(s: Source, i: int) -> int:
    """The last token of the logical line of token i, brackets passed over."""
    while i + 1 < len(s.tokens):
        j = s.match[i] if s.tokens[i].kind == "op" and s.at(i) in ("(", "[", "{") and s.match[i] > i else i
        if j + 1 >= len(s.tokens) or s.tokens[j + 1].line > s.end_line(j) or s.at(j + 1) in (")", "}") or s.at(j) == ";":
            return j
        i = j + 1
    return i


def _calls(s: Source, out: Found, skip) -> None:
    """Names before an opening parenthesis, but for keywords, definitions and constructors."""
    lang = s.language
    for i in range(len(s.tokens) - 1):
        if not s.is_word(i) or s.at(i) in _NOT_CALLS[lang] or s.tokens[i + 1].kind != "op":
            continue
        j = i + 1
        if lang == "rust" and s.at(j) == "!" and s.at(j + 1) in ("(", "[", "{"):
            if not skip(i):
                out.call(s.at(i), s.tokens[i].line)
            continue
        if lang == "rust" and s.at(j) == "::" and s.at(j + 1) == "<":
            j = _angle(s, j + 1) + 1
        elif lang in ("typescript", "java") and s.at(j) == "<" and s.at(i - 1) == ".":
            j = _angle(s, j) + 1
        if s.at(j) == "(" and s.tokens[min(j, len(s.tokens) - 1)].kind == "op" and not skip(i) and s.at(i - 1) != "new":
            out.call(s.at(i), s.tokens[i].line)


def _angle(s: Source, i: int) -> int:
    depth = 0
    for j in range(i, min(len(s.tokens), i + 200)):
        depth += (s.at(j) == "<") - (s.at(j) == ">")
        if depth == 0:
            return j
    return i


def _c(text: str, lang: str, out: Found) -> None:
    s = Source(text, lang)
    for word in ("struct", "union"):
        for i in range(len(s.tokens)):
            if s.at(i) == word and s.is_word(i + 1):
                last = s.match[i + 2] if s.at(i + 2) == "{" else i + 1
                k = out.add(s.at(i + 1), "class", word, s.doc_before(s.statement_start(i)), s.tokens[i].line, s.end_line(last), False)
                out.symbols[k]["docstring"] = s.doc_before(i)
    defined = set()
    for i in range(1, len(s.tokens) - 1):
        if s.is_word(i) and s.depth[i] == 0 and s.at(i + 1) == "(" and s.at(i) not in _NOT_CALLS["c"]:
            defined.add(i)
            if s.at(s.match[i + 1] + 1) == "{" and s.at(i - 1) != "*" and s.is_word(i - 1):
                a = s.statement_start(i)
                out.add(s.at(i), "function", s.span(i + 1, s.match[i + 1]), s.doc_before(a), s.tokens[a].line, s.end_line(s.match[s.match[i + 1] + 1]), False)
    for t in s.tokens:
        if t.kind == "pre" and (m := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", t.text)):
            out.imports.append((m[1], None))
    _calls(s, out, lambda i: i in defined)


_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp"}


def _java(text: str, lang: str, out: Found) -> None:
    s = Source(text, lang)
    kinds = {"class": [], "interface": [], "enum": []}
    for i in range(len(s.tokens) - 1):
        if s.at(i) in kinds and s.tokens[i].kind == "word" and s.is_word(i + 1) and s.at(i - 1) != ".":
            b = s.find(i, ("{",))
            if b >= 0:
                kinds[s.at(i)].append((s.statement_start(i), i + 1, b))
    bodies = [(b, s.match[b], kind) for kind, rows in kinds.items() for _, _, b in rows]

    def doc(a: int) -> str | None:
        """The first '/**' comment in the surrounding body before the declaration."""
        lo = max((s.tokens[b].end for b, e, _ in bodies if b < a < e), default=0)
        return next((d.text for d in s.docs if d.text.startswith("/**") and lo <= d.start < s.tokens[a].start), None)

    public = lambda a, k: "public" in [s.at(j) for j in range(a, k)]
    at_line: dict[int, int] = {}
    for kind, label in (("class", "class"), ("interface", "class"), ("enum", "enum")):
        for a, k, b in kinds[kind]:
            n = out.add(s.at(k), label, None, doc(a), s.tokens[a].line, s.end_line(s.match[b]), public(a, k))
            if label == "class":
                at_line[b] = n
    home = lambda i: max((b for b, e, _ in bodies if b < i < e), default=None)
    parent = lambda i: next((at_line[b] for b in sorted((b for b, e, _ in bodies if b < i < e), reverse=True) if b in at_line), None)
    statics, methods, makers, defined = [], [], [], set()
    for i in range(1, len(s.tokens) - 1):
        h = home(i)
        if h is None or s.depth[i] != s.depth[h] + 1 or not s.is_word(i):
            continue
        a = s.statement_start(i)
        if s.at(i + 1) == "(" and s.at(i - 1) not in (".", "@", "=", "new"):
            after = s.match[i + 1] + 1
            head = [s.at(j) for j in range(a, i)]
            if "=" in head or s.at(after) not in ("{", ";", "throws"):
                continue
            defined.add(i)
            name = next((s.at(k) for rows in kinds.values() for _, k, b in rows if b == h), "")
            row = (a, i, after)
            (makers if s.at(i) == name and (not head or head[-1] in _MODIFIERS or head[-1] == ")") else methods).append(row)
        elif s.at(i + 1) in ("=", ";") and (s.is_word(i - 1) or s.at(i - 1) in (">", "]")) and s.find(a, ("=",), i) < 0:
            mods = [j for j in range(a, i) if s.at(j) in _MODIFIERS]
            k = (mods[-1] + 1) if mods else a
            while s.at(k) == "@":
                k = s.match[k + 2] + 1 if s.at(k + 2) == "(" else k + 2
            if k < i:
                kind = s.span(k, i - 1)
                if "static" in [s.at(j) for j in mods]:
                    statics.append((a, i, kind))
                if h in at_line:
                    end = s.find(i, (";",))
                    out.field(at_line[h], s.at(i), kind, "Optional" in kind, s.span(i + 2, end - 1) if s.at(i + 1) == "=" and end > i + 2 else None)
    for a, i, kind in statics:
        out.add(s.at(i), "static", kind, doc(a), s.tokens[a].line, s.end_line(s.find(i, (";",))), public(a, i), parent(i))
    for rows in (methods, makers):
        for a, i, after in rows:
            out.add(s.at(i), "method", s.span(i + 1, s.match[i + 1]), doc(a), s.tokens[a].line, s.end_line(_body(s, after)), public(a, i), parent(i))
    for i in range(len(s.tokens)):
        if s.at(i) == "import" and s.depth[i] == 0:
            e = s.find(i, (";",))
            if e > i:
                out.imports.append((re.sub(r"^static\s+|\s|\.\*$", "", s.span(i + 1, e - 1)), None))
    _calls(s, out, lambda i: i in defined or s.at(i - 1) == "@" or s.at(i) in kinds)


def _rust(text: str, lang: str, out: Found) -> None:
    s = Source(text, lang)
    n = len(s.tokens)

    def start(i: int) -> tuple[int, bool]:
        """The first token with the visibility, and whether there is one."""
        k = i
        while k > 0 and s.at(k - 1) in ("async", "unsafe", "const", "extern") and s.tokens[k - 1].kind == "word":
            k -= 1
        if s.at(k - 1) == ")" and s.match[k - 1] > 0 and s.at(s.match[k - 1] - 1) == "pub":
            return s.match[k - 1] - 1, True
        return (k - 1, True) if s.at(k - 1) == "pub" else (k, False)

    structs, enums, consts, impls, fns, skip = [], [], [], [], [], set()
    for i in range(n - 1):
        if s.tokens[i].kind == "op" and s.at(i) == "#" and (s.at(i + 1) == "[" or s.at(i + 1) == "!" and s.at(i + 2) == "["):
            b = i + 1 if s.at(i + 1) == "[" else i + 2
            skip.update(range(b, s.match[b] + 1))
        if s.tokens[i].kind != "word" or i in skip:
            continue
        t = s.at(i)
        if t == "struct" and s.is_word(i + 1):
            structs.append(i)
            skip.add(i + 1)
        elif t == "enum" and s.is_word(i + 1):
            enums.append(i)
        elif t in ("const", "static") and s.is_word(i + 1) and s.at(i + 1) != "fn":
            k = i + 2 if s.at(i + 1) == "mut" else i + 1
            if s.at(k + 1) == ":":
                consts.append((i, k))
        elif t == "impl" and (i == 0 or s.at(i - 1) in ("}", ";", "]", "unsafe", "{")):
            b = s.find(i, ("{",))
            if b >= 0:
                impls.append((i, b))
        elif t == "fn" and s.is_word(i + 1):
            fns.append(i)
            skip.add(i + 1)
    by_line: dict[int, int] = {}
    named: dict[str, int] = {}
    for i in structs:
        a, pub = start(i)
        last = _body(s, i + 1)
        k = out.add(s.at(i + 1), "class", None, None, s.tokens[a].line, s.end_line(last), pub)
        by_line[s.tokens[a].line] = named[s.at(i + 1)] = k
        b = s.find(i, ("{", ";", "("))
        if s.at(b) == "{":
            j = b + 1
            while j < s.match[b]:
                e = s.find(j, (",",), s.match[b])
                e = s.match[b] if e < 0 else e
                c = s.find(j, (":",), e)
                if c > 0 and s.is_word(c - 1):
                    kind = s.span(c + 1, e - 1)
                    # a comma inside angle brackets doesn't end the field
                    while kind.count("<") > kind.count(">") - kind.count("->") and e < s.match[b]:
                        e = s.find(e + 1, (",",), s.match[b])
                        e = s.match[b] if e < 0 else e
                        kind = s.span(c + 1, e - 1)
                    out.field(k, s.at(c - 1), kind, kind.startswith("Option<"))
                j = e + 1
    for i in enums:
        a, pub = start(i)
        out.add(s.at(i + 1), "enum", None, None, s.tokens[a].line, s.end_line(_body(s, i)), pub)
    for i in enums:
        b = s.find(i, ("{",))
        j = b + 1
        while 0 <= b and j < s.match[b]:
            while s.at(j) == "#":
                j = s.match[j + 1] + 1
            e = s.find(j, (",",), s.match[b])
            e = s.match[b] if e < 0 else e
            if s.is_word(j):
                skip.add(j)
                out.add(f"{s.at(i + 1)}::{s.at(j)}", "enum", f"variant of {s.at(i + 1)}", None, s.tokens[j].line, s.end_line(e - 1), True)
            j = e + 1
    for i, k in consts:
        a, pub = start(i) if s.at(i) == "static" else ((i - 1, True) if s.at(i - 1) == "pub" else (i, False))
        e = s.find(k, ("=", ";"))
        out.add(s.at(k), "static", s.span(k + 2, e - 1) if e > k + 2 else None, None, s.tokens[a].line, s.end_line(max(e, s.find(k, (";",)))), pub)
    for i, b in impls:
        k = _angle(s, i + 1) + 1 if s.at(i + 1) == "<" else i + 1
        f = s.find(k, ("for",), b)
        j = f + 1 if f > 0 else k
        # only a bare name: generics and paths are not extracted
        if s.is_word(j) and s.at(j + 1) in ("{", "where"):
            n_ = out.add(f"impl {s.at(j)}", "class", None, None, s.tokens[i].line, s.end_line(s.match[b]), False)
            by_line[s.tokens[i].line] = n_
            for fld in [x for x in out.fields if x["symbol_ordinal"] in named.values()]:
                out.field(n_, fld["name"], fld["type"], fld["optional"])
    for i in fns:
        a, pub = start(i)
        p = s.find(i, ("(",))
        if p < 0:
            continue
        home = [x for x, b in impls if b < i < s.match[b]]
        parent = by_line.get(s.tokens[home[-1]].line) if home else None
        out.add(s.at(i + 1), "method" if home else "function", s.span(p, s.match[p]), None, s.tokens[a].line, s.end_line(_body(s, s.match[p] + 1)), pub, parent)
    for i in range(n):
        if s.at(i) == "use" and s.tokens[i].kind == "word" and (i == 0 or s.at(i - 1) in (";", "}", "{", "pub", "]", ")")):
            e = s.find(i, (";",))
            if e > i + 1:
                out.imports.append((s.span(i + 1, e - 1), None))
    _calls(s, out, lambda i: i in skip)


def _script(text: str, lang: str, out: Found) -> None:
    s = Source(text, lang)
    n = len(s.tokens)

    def exported(i: int) -> bool:
        """An export at most three tokens before, in the same statement."""
        for j in range(i - 1, max(-1, i - 4), -1):
            if s.at(j) in (";", "}", "{"):
                return False
            if s.at(j) == "export":
                return True
        return False

    classes, funcs, methods, defined = [], [], [], set()
    for i in range(n - 1):
        if s.at(i) == "class" and s.tokens[i].kind == "word" and s.is_word(i + 1) and s.at(i - 1) != ".":
            b = s.find(i + 1, ("{",))
            if b >= 0:
                classes.append((i, b))
    for i, b in classes:
        out.add(s.at(i + 1), "class", None, None, s.tokens[i].line, s.end_line(s.match[b]), exported(i))

    def label(i: int) -> str:
        """The name of a function expression: of the test call that it is given to, or anonymous."""
        for k in range(i - 1, max(-1, i - 12), -1):
            if s.at(k) == "(" and s.match[k] > i and s.is_word(k - 1):
                call = s.at(k - 1)
                first = s.tokens[k + 1]
                if call == "describe" and first.kind == "str":
                    return "describe:" + first.text.strip("'\"`")
                if call in ("it", "test") and first.kind == "str":
                    return "test:" + first.text.strip("'\"`")
                if call in ("beforeEach", "afterEach", "beforeAll", "afterAll"):
                    return call.lower()
                break
        return "anonymous"

    for i in range(n):
        t = s.at(i)
        if t == "function" and s.tokens[i].kind == "word":
            k = i + 2 if s.at(i + 1) == "*" else i + 1
            named = s.is_word(k)
            p = s.find(k, ("(",))
            if p < 0:
                continue
            defined.add(k)
            a = i - 1 if s.at(i - 1) == "async" else i
            bound = s.at(a - 1) == "=" and s.is_word(a - 2)
            statement = named and s.at(a - 1) not in ("=", "(", ",", ":", "return", "=>")
            end = s.end_line(_body(s, s.match[p] + 1))
            sig = s.span(p, s.match[p])
            bind = bound and s.at(a - 3) in ("const", "let", "var")
            funcs.append((s.tokens[a].start, s.at(k) if statement else label(a), sig, s.tokens[a].line, end, exported(a) or bind and exported(a - 3)))
            if bind:
                funcs.append((s.tokens[a - 2].start, s.at(a - 2), sig, s.tokens[a].line, end, exported(a - 3)))
        elif t == "=>" and s.tokens[i].kind == "op":
            k = i - 1
            if s.at(k) != ")":  # a return type may stand between
                back = k
                while back > 0 and s.at(back) not in (")", ";", "{", "}", "=", ","):
                    back -= 1
                k = back if s.at(back) == ")" and s.at(back + 1) == ":" else k
            p = s.match[k] if s.at(k) == ")" else k
            sig = s.span(p, k) if s.at(k) == ")" else "()"
            a = p - 1 if s.at(p - 1) == "async" else p
            e = s.match[i + 1] if s.at(i + 1) in ("{", "(") and s.match[i + 1] > 0 else _line_end(s, i + 1)
            end = s.end_line(min(e, n - 1))
            eq = a - 1
            if s.at(eq) != "=" and lang == "typescript":
                back = eq
                while back > 0 and s.at(back) not in (";", "{", "}", "=", "("):
                    back -= 1
                eq = back if s.at(back) == "=" else eq
            bind = False
            if s.at(eq) == "=":
                v = eq - 1
                while v > 0 and s.at(v - 1) not in ("const", "let", "var", ";", "{", "}"):
                    v -= 1
                if bind := s.at(v - 1) in ("const", "let", "var") and s.is_word(v):
                    funcs.append((s.tokens[v].start, s.at(v), sig, s.tokens[a].line, end, exported(v - 1)))
            funcs.append((s.tokens[a].start, label(a), sig, s.tokens[a].line, end, exported(a) or bind and exported(v - 1)))
    for _, name, sig, a, e, ex in sorted(funcs, key=lambda r: r[0]):
        out.add(name, "function", sig, None, a, e, ex)
    for i, b in classes:
        for k in range(b + 1, s.match[b]):
            if s.is_word(k) and s.depth[k] == s.depth[b] + 1 and s.at(k + 1) in ("(", "<") and s.at(k - 1) not in (".", "=", "new", "@", "return", "(", ","):
                p = s.find(k, ("(",)) if s.at(k + 1) == "<" else k + 1
                o = s.find(s.match[p] + 1, ("{", ";", "="))
                if o < 0 or s.at(o) != "{" or s.at(k) in ("if", "for", "while", "switch", "catch"):
                    continue
                defined.add(k)
                a = k
                while s.at(a - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "*"):
                    a -= 1
                methods.append((k, s.at(k), s.span(p, s.match[p]), s.tokens[a].line, s.end_line(s.match[o])))
    for _, name, sig, a, e in sorted(methods):
        out.add(name, "method", sig, None, a, e, False)
    if lang == "typescript":
        for word, kind in (("interface", "interface"), ("type", "type"), ("enum", "enum")):
            for i in range(n - 1):
                if s.at(i) == word and s.tokens[i].kind == "word" and s.is_word(i + 1) and s.at(i - 1) not in (".", ":", "(", ",", "="):
                    if word == "type":
                        if s.find(i, ("=",)) < 0:
                            continue
                        e = s.find(i, (";",))
                        e = _line_end(s, s.find(i, ("=",))) if e < 0 or s.tokens[e].line > s.tokens[_line_end(s, s.find(i, ("=",)))].line + 50 else e
                    else:
                        b = s.find(i, ("{",))
                        if b < 0:
                            continue
                        e = s.match[b]
                    out.add(s.at(i + 1), kind, None, None, s.tokens[i].line, s.end_line(e), exported(i))
    for sym, (i, b) in zip([x for x in out.symbols if x["symbol_type"] == "class"], classes, strict=True):
        for k in range(b + 1, s.match[b]):
            if s.is_word(k) and s.depth[k] == s.depth[b] + 1 and (s.at(k + 1) == ":" or s.at(k + 1) == "?" and s.at(k + 2) == ":") and s.at(k - 1) in ("{", ";", "}", "private", "public", "protected", "readonly", "static") and lang == "typescript":
                c = k + 1 if s.at(k + 1) == ":" else k + 2
                e = s.find(c, (";", "="), s.match[b])
                if e > c:
                    d = s.find(e, (";",), s.match[b]) if s.at(e) == "=" else -1
                    out.field(sym["ordinal"], s.at(k), s.span(c + 1, e - 1), c == k + 2, s.span(e + 1, d - 1) if d > e + 1 else None)
    for i in range(n):
        if s.at(i) == "import" and s.tokens[i].kind == "word" and s.at(i + 1) != "(":
            k = next((j for j in range(i + 1, min(n, i + 60)) if s.tokens[j].kind == "str"), None)
            if k is not None and ";" not in [s.at(j) for j in range(i, k)]:
                out.imports.append((s.at(k).strip("'\"`"), None))
    for i in range(n - 3):
        if s.is_word(i) and s.at(i - 1) != "." and s.at(i + 1) == "(" and s.tokens[i + 2].kind == "str" and s.at(i + 3) == ")":
            out.imports.append((s.at(i + 2).strip("'\"`"), None))
    _calls(s, out, lambda i: i in defined or s.at(i - 1) == "function")
    out.parents()


# ---------------------------------------------------------------- relations


def parse_files(files: DataFrame) -> DataFrame:
    """A row a file with nested symbols, imports, calls and fields."""

    def run(batches):
        kinds = None
        for batch in batches:
            rows = {"path": [], "symbols": [], "imports": [], "calls": [], "fields": []}
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = parse(content, language)
                rows["path"].append(path)
                rows["symbols"].append(f.symbols)
                rows["imports"].append([{"ordinal": i, "import_name": a, "from_module": b} for i, (a, b) in enumerate(f.imports)])
                rows["calls"].append([{"ordinal": i, "call_name": n, "line": line, "context": c} for i, ((n, line), c) in enumerate(f.called.items())])
                rows["fields"].append(f.fields)
            kinds = kinds or _arrow_schema()
            yield pa.RecordBatch.from_pydict(rows, schema=kinds)

    known = files.filter(F.col("language").isin("python", "javascript", "typescript", "rust", "java", "go", "c", "markdown") & F.col("content").isNotNull())
    return known.select("path", "language", "content").mapInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    s, i, b = pa.string(), pa.int32(), pa.bool_()
    struct = lambda *f: pa.list_(pa.struct(list(f)))
    return pa.schema([
        ("path", s),
        ("symbols", struct(("ordinal", i), ("name", s), ("symbol_type", s), ("signature", s), ("docstring", s), ("line_start", i), ("line_end", i), ("parent_ordinal", i), ("is_exported", b))),
        ("imports", struct(("ordinal", i), ("import_name", s), ("from_module", s))),
        ("calls", struct(("ordinal", i), ("call_name", s), ("line", i), ("context", s))),
        ("fields", struct(("symbol_ordinal", i), ("ordinal", i), ("name", s), ("type", s), ("optional", b), ("default_value", s))),
    ])


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, calls and fields of parsed files; write or cache ``parsed`` first."""
    return {k: parsed.select("path", F.inline(k)) for k in ("symbols", "imports", "calls", "fields")}
