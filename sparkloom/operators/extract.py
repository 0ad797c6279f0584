"""From file contents to facts: dispatch by name, header and first line, then one parser per language.

A parser returns rows of one schema (``FACTS``), told apart by ``fact``: symbol, ref, import, implementation or error. Python uses
the standard parser, Markdown a line scanner, brace languages one scanner with a table of declarations per language. A file
that does not parse gives a single error row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = (
    "blob_sha string, parser_id string, fact string, name string, qualified string, kind string, signature string, visibility string, doc string, scope string, "
    "parent string, enclosing string, target string, target_qualified string, role string, alias string, byte_start long, byte_end long, line_start long, line_end long"
)
COLUMNS = [c.strip().split(" ")[0] for c in FACTS.split(",")]
MAX_DOC = 1024
#: File extensions by parser.
EXTENSIONS = {
    "python": "py pyi", "rust": "rs", "go": "go", "java": "java", "php": "php", "ruby": "rb rake gemspec", "c": "c", "cpp": "cc cpp cxx hpp hh hxx", "objc": "m mm",
    "csharp": "cs", "kotlin": "kt kts", "swift": "swift", "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "markdown": "md markdown",
}
BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}


def dispatch(path: str, head: bytes) -> str | None:
    """The parser of a file: by extension, headers by what they hold, scripts by their first line."""
    ext = path.rpartition("/")[2].rpartition(".")
    if ext[1] and ext[2] == "h":
        return header_language(head)
    if ext[1] and ext[2] in BY_EXTENSION:
        return BY_EXTENSION[ext[2]]
    first = head[:256].split(b"\n", 1)[0]
    if first.startswith(b"#!"):
        return next((lang for word, lang in ((b"python", "python"), (b"ruby", "ruby"), (b"php", "php"), (b"node", "javascript")) if word in first), None)
    return None


# What tells headers apart.
OBJC_WORDS = b"interface implementation protocol class end".split()
CPP_WORDS = b"namespace template typename concept requires constexpr nullptr noexcept operator".split()
CPP_HEADERS = b"iostream string vector memory optional variant span unordered_map unordered_set map set array tuple type_traits utility".split()
OBJC = re.compile(rb"^[ \t\r\f\v]*@(" + b"|".join(OBJC_WORDS) + rb")(?!\w)", re.M)
OBJC_IMPORT = re.compile(rb"^[ \t\r\f\v]*#[ \t\r\f\v]*import[ \t\r\f\v]*[\"<]", re.M)
CPP = re.compile(rb"::|(?<!\w)(?:(?:" + b"|".join(CPP_WORDS) + rb")(?!\w)|(?<!@)class(?!\w)|(?:public|private|protected)\s*:)")
CPP_INCLUDE = re.compile(rb"^[ \t\r\f\v]*#[ \t\r\f\v]*include[ \t\r\f\v]*<(?:" + b"|".join(CPP_HEADERS) + rb")>", re.M)


def header_language(head: bytes) -> str:
    """C, C++ or Objective-C of a header, from its first 64 KiB without comments and literals."""
    raw = head[: 64 * 1024]
    code = re.sub(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", b" ", raw, flags=re.S)
    if OBJC.search(code) or OBJC_IMPORT.search(re.sub(rb"//[^\n]*", b"", raw)):
        return "objc"
    return "cpp" if CPP.search(code) or CPP_INCLUDE.search(code) else "c"


@dataclass
class Rows:
    data: bytes
    rows: list[dict] = field(default_factory=list)

    def add(self, fact: str, **values) -> None:
        self.rows.append({"fact": fact, **values})


# ---- Python


def _offsets(data: bytes) -> list[int]:
    out = [0]
    for line in data.split(b"\n"):
        out.append(out[-1] + len(line) + 1)
    return out


def python_facts(data: bytes) -> list[dict]:
    tree = ast.parse(data)
    out, at = Rows(data), _offsets(data)

    def span(n: ast.AST) -> dict:
        return {"byte_start": at[n.lineno - 1] + n.col_offset, "byte_end": at[n.end_lineno - 1] + n.end_col_offset, "line_start": n.lineno, "line_end": n.end_lineno}

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        return f"{base}.{n.attr}" if isinstance(n, ast.Attribute) and (base := dotted(n.value)) else None

    def visibility(name: str) -> str:
        if name.startswith("__") and name.endswith("__"):
            return "public"
        return "private" if name.startswith("__") else "crate" if name.startswith("_") else "public"

    def annotation(n: ast.AST | None, role: str, enclosing: str | None) -> None:
        for x in ast.walk(n) if n is not None else ():
            if isinstance(x, ast.Name):
                out.add("ref", kind="type", target=x.id, role=role if x is n else "generic_arg", enclosing=enclosing, **span(x))

    def visit(n: ast.AST, holder: tuple[str, ...], in_class: bool, enclosing: str | None, nested: bool) -> None:
        if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class = isinstance(n, ast.ClassDef)
            kind = "class" if is_class else "test" if n.name.startswith("test_") else "method" if in_class else "function"
            qualified = ".".join([*holder, n.name])
            body = n.body[0]
            head = data[span(n)["byte_start"] : at[body.lineno - 1] + body.col_offset].decode(errors="replace")
            doc = ast.get_docstring(n)
            out.add("symbol", name=n.name, qualified=qualified, kind=kind, visibility=visibility(n.name), parent=".".join(holder) or None, scope="nested" if nested else "top_level",
                    signature=re.sub(r"\s+", " ", head.split('"""')[0]).strip().rstrip(":").strip(), doc=doc.encode()[:MAX_DOC].decode(errors="ignore") if doc else None, **span(n))
            for d in n.decorator_list:
                visit(d, holder, in_class, enclosing, nested)
            if is_class:
                for b in n.bases:
                    if name := dotted(b):
                        out.add("implementation", qualified=qualified, target=name.rpartition(".")[2], target_qualified=name, kind="inherit", **span(b))
                for child in n.body:
                    visit(child, (*holder, n.name), True, qualified, nested)
            else:
                args = n.args
                for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
                    annotation(a.annotation, "param", qualified)
                annotation(n.returns, "return", qualified)
                for child in n.body:
                    visit(child, holder, False, qualified, True)
            return
        if isinstance(n, ast.Call):
            target = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
            if target:
                out.add("ref", kind="call", target=target, target_qualified=None, role=dotted(n.func), enclosing=enclosing, **span(n.func))
        elif isinstance(n, ast.AnnAssign):
            annotation(n.annotation, "field" if in_class else "local", enclosing)
        elif isinstance(n, ast.Import):
            for a in n.names:
                out.add("import", target=a.name, alias=a.asname, **span(a))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                out.add("import", target="." * n.level + (n.module or ""), name=a.name, alias=a.asname, **span(a))
        for child in ast.iter_child_nodes(n):
            visit(child, holder, in_class and isinstance(n, ast.If | ast.Try), enclosing, nested)

    for child in tree.body:
        visit(child, (), False, None, False)
    return out.rows


# ---- Markdown


def markdown_facts(data: bytes) -> list[dict]:
    out, stack, at, fence, before = Rows(data), [], 0, "", None
    for number, raw in enumerate(data.split(b"\n"), 1):
        line = raw.decode(errors="replace").rstrip("\r")
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        level, title, start = 0, "", at
        if fence:
            fence = "" if mark and mark[1].startswith(fence) and not line.strip("`~ ") else fence
            before = None
        elif mark:
            fence, before = mark[1], None
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            level, title, before = len(m[1]), (m[2] or "").strip(), None
        elif (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)) and before:
            level, title, start, before = (1 if m[1][0] == "=" else 2), before[0], before[1], None
        else:
            before = (line.strip(), at) if line.strip() and not re.match(r" {4}|\s*([-*+>|]|\d+[.)])", line) else None
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1] if stack else None
            qualified = f"{parent} > {title}" if parent else title
            stack.append((level, qualified))
            out.add("symbol", name=title, qualified=qualified, kind="section", parent=parent, scope="top_level", byte_start=start, byte_end=at + len(raw), line_start=number, line_end=number)
        at += len(raw) + 1
    return out.rows


# ---- brace languages: declarations as (kind, expression with a group n for the name), separator, import expression

ID = r"(?P<n>[A-Za-z_$][\w$]*)"
TYPE = r"(?:public|private|protected|internal|abstract|final|sealed|static|open|partial|data|export|default|readonly|pub(?:\([^)]*\))?|unsafe|inner|enum(?= class))\s+"
BRACES: dict[str, tuple[str, list[tuple[str, str]], str]] = {
    "rust": ("::", [("function", rf"(?:{TYPE}|async\s+|const\s+|extern\s+\"[^\"]*\"\s+)*fn\s+{ID}"), ("struct", rf"(?:{TYPE})*struct\s+{ID}"), ("enum", rf"(?:{TYPE})*enum\s+{ID}"), ("trait", rf"(?:{TYPE})*trait\s+{ID}"), ("module", rf"(?:{TYPE})*mod\s+{ID}"), ("impl", rf"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?{ID}"), ("macro", rf"macro_rules!\s*{ID}"), ("type_alias", rf"(?:{TYPE})*type\s+{ID}"), ("constant", rf"(?:{TYPE})*const\s+{ID}\s*:"), ("variable", rf"(?:{TYPE})*static\s+(?:mut\s+)?{ID}\s*:")], r"use\s+(?P<n>[\w:]+)"),
    "go": (".", [("method", rf"func\s+\([^)]*?\*?(?P<r>\w+)\)\s*{ID}"), ("function", rf"func\s+{ID}"), ("struct", rf"type\s+{ID}\s+struct"), ("interface", rf"type\s+{ID}\s+interface"), ("type_alias", rf"type\s+{ID}\s+=?\s*(?!struct\b|interface\b)[\w\[*]"), ("constant", rf"const\s+{ID}\b"), ("variable", rf"var\s+{ID}\b")], r'(?:import\s+)?(?:\w+\s+)?"(?P<n>[\w./-]+)"\s*$'),
    "java": (".", [("class", rf"(?:{TYPE})*class\s+{ID}"), ("interface", rf"(?:{TYPE})*@?interface\s+{ID}"), ("enum", rf"(?:{TYPE})*enum\s+{ID}"), ("struct", rf"(?:{TYPE})*record\s+{ID}"), ("method", rf"(?:{TYPE}|synchronized\s+|native\s+|<[^>]*>\s*)*[\w<>\[\],.?]+\s+{ID}\s*\([^;{{]*\)\s*(?:throws [\w, .]+)?(?=[{{;])"), ("field", rf"(?:{TYPE}|volatile\s+|transient\s+)*(?!(?:return|throw|new|package|import|else|case|goto|assert)\b)[A-Za-z_][\w<>\[\],.?]*\s+{ID}\s*(?==|;)")], r"import\s+(?:static\s+)?(?P<n>[\w.*]+)"),
    "csharp": (".", [("module", rf"namespace\s+(?P<n>[\w.]+)"), ("class", rf"(?:{TYPE})*class\s+{ID}"), ("interface", rf"(?:{TYPE})*interface\s+{ID}"), ("struct", rf"(?:{TYPE})*(?:struct|record)\s+{ID}"), ("enum", rf"(?:{TYPE})*enum\s+{ID}"), ("method", rf"(?:{TYPE}|async\s+|override\s+|virtual\s+)*(?!(?:return|new|throw|await|else)\b)[\w<>\[\],.?]+\s+{ID}\s*\([^;{{]*\)\s*(?=[{{;=]|$)")], r"using\s+(?:static\s+)?(?P<n>[\w.]+)\s*;"),
    "kotlin": (".", [("class", rf"(?:{TYPE})*(?:class|object)\s+{ID}"), ("interface", rf"(?:{TYPE})*interface\s+{ID}"), ("function", rf"(?:{TYPE}|override\s+|suspend\s+|inline\s+|operator\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{ID}"), ("type_alias", rf"typealias\s+{ID}")], r"import\s+(?P<n>[\w.*]+)"),
    "swift": (".", [("class", rf"(?:{TYPE})*class\s+{ID}"), ("struct", rf"(?:{TYPE})*struct\s+{ID}"), ("enum", rf"(?:{TYPE})*enum\s+{ID}"), ("interface", rf"(?:{TYPE})*protocol\s+{ID}"), ("impl", rf"(?:{TYPE})*extension\s+{ID}"), ("function", rf"(?:{TYPE}|override\s+|mutating\s+|@\w+\s+)*func\s+{ID}")], r"import\s+(?P<n>\w+)"),
    "php": ("::", [("module", r"namespace\s+(?P<n>[\w\\]+)"), ("class", rf"(?:{TYPE})*class\s+{ID}"), ("interface", rf"interface\s+{ID}"), ("trait", rf"trait\s+{ID}"), ("enum", rf"enum\s+{ID}"), ("function", rf"(?:{TYPE})*function\s+&?{ID}")], r"use\s+(?P<n>[\w\\]+)"),
    "typescript": (".", [("class", rf"(?:{TYPE})*class\s+{ID}"), ("interface", rf"(?:{TYPE})*interface\s+{ID}"), ("enum", rf"(?:{TYPE}|const\s+)*enum\s+{ID}"), ("type_alias", rf"(?:{TYPE})*type\s+{ID}\s*[=<]"), ("function", rf"(?:{TYPE}|async\s+)*function\*?\s+{ID}"), ("method", rf"(?:{TYPE}|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function|constructor)\b){ID}\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?(?={{)"), ("function", rf"(?:{TYPE})*(?:const|let|var)\s+{ID}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")], r"""(?:import|export)\s.*?from\s*['"](?P<n>[^'"]+)['"]|(?:import|.*\brequire\()\s*['"](?P<m>[^'"]+)['"]"""),
    "c": ("::", [("struct", rf"(?:typedef\s+)?(?:struct|union)\s+{ID}(?=[^;()]*{{)"), ("enum", rf"(?:typedef\s+)?enum\s+{ID}"), ("macro", rf"#\s*define\s+{ID}"), ("function", rf"(?!(?:return|else|typedef|if|for|while|switch)\b)(?:[\w*]+\s+)+\**{ID}\s*\([^;{{]*\)\s*(?={{|$)")], r"#\s*include\s*[<\"](?P<n>[^>\"]+)[>\"]"),
}
BRACES["tsx"] = BRACES["javascript"] = BRACES["typescript"]
BRACES["cpp"] = ("::", [("module", rf"(?:inline\s+)?namespace\s+{ID}"), ("class", rf"(?:template\s*<[^>]*>\s*)?class\s+(?:final\s+)?{ID}(?=[^;]*$)"), *BRACES["c"][1]], BRACES["c"][2])
BRACES["objc"] = ("::", [("class", rf"@(?:interface|implementation)\s+{ID}"), ("interface", rf"@protocol\s+{ID}"), ("method", rf"[-+]\s*\([^)]*\)\s*{ID}"), *BRACES["c"][1]], r"#\s*(?:import|include)\s*[<\"](?P<n>[^>\"]+)[>\"]")
BASES = re.compile(r"\bextends\s+(?P<extends>[\w.\\<>, ]+?)(?=\s+implements\b|\s*\{|$)|\bimplements\s+(?P<implements>[\w.\\<>, ]+?)(?=\s*\{|$)|(?<!:):(?!:)\s*(?P<colon>(?:(?:public|private|protected)\s+)?[A-Za-z_][\w.:<>(), ]*?)(?=\s*(?:\{|where\b|$))")
ACCESS = re.compile(r"^(?:virtual\s+)?(public|private|protected)\s+")


def role_of(language: str, shape: str, kind: str, base: str) -> str:
    """The grammar's shape of a base: C++ names its access (a class' default is private, a struct's public)."""
    if shape == "colon" and language == "cpp":
        access = ACCESS.match(base)
        return f"{access[1] if access else 'public' if kind == 'struct' else 'private'}_base"
    if shape == "colon" and language == "objc":
        return "interface_colon"
    return "extension" if language == "swift" and kind == "impl" else shape


FOR = re.compile(r"impl(?:<[^>]*>)?\s+(?P<t>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<n>\w+)")
CALL = re.compile(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*(?:\.|::|->|\\))*)([A-Za-z_$][\w$]*)\s*\(")
NO_CALL = frozenset("if for while switch catch return function fn func fun sizeof match new super this throw typeof await yield elif and or not in is def class struct".split())
HOLDERS = frozenset("class interface trait struct enum impl module".split())


def brace_facts(data: bytes, language: str) -> list[dict]:
    """Declarations line by line, nested by braces; heritage, imports and calls beside them."""
    separator, kinds, imports = BRACES[language]
    text = data.decode("latin-1")
    plain = re.sub(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"', lambda m: re.sub(r"[^\n\"]", " ", m[0]) if m[0][0] == "/" or "{" in m[0] or "}" in m[0] or "(" in m[0] else m[0], text, flags=re.S)
    wanted = [(kind, re.compile(rf"\s*(?:@\w+(?:\([^)]*\))?\s+)*{e}")) for kind, e in kinds]
    importing = re.compile(rf"\s*(?:{imports})")
    out, depth, at = Rows(data), 0, 0
    stack: list[tuple[int, str, str, dict]] = []  # depth, kind, qualified, row
    last: tuple[str, str, dict] | None = None
    for number, line in enumerate(plain.split("\n"), 1):
        raw = text[at : at + len(line)]
        span = {"byte_start": at + len(line) - len(line.lstrip()), "byte_end": at + len(line.rstrip()), "line_start": number, "line_end": number}
        in_function = any(k not in HOLDERS for _, k, _, _ in stack)
        inside = stack[-1][1] if stack else None
        if language == "php" and inside in ("class", "trait", "enum") and (m := re.match(r"\s*use\s+([\w\\, ]+)[;{]", line)):
            for used in re.split(r",\s*", m[1].strip()):
                out.add("implementation", qualified=stack[-1][2], target=used.rpartition("\\")[2], target_qualified=used, kind="mixin", role="trait_use", **span)
        elif language in ("java", "csharp") and inside in ("class", "enum", "struct") and (m := re.match(rf"\s*(?:{TYPE})*{re.escape(stack[-1][2].rpartition('.')[2])}\s*\([^;{{]*\)[^;{{]*(?={{)", line)):
            name = stack[-1][2].rpartition(".")[2]
            seen = re.match(r"\s*(public|private|protected)\b", line)
            out.add("symbol", name=name, qualified=f"{stack[-1][2]}.{name}", kind="constructor", parent=stack[-1][2], scope="top_level", visibility={"public": "public", "private": "private"}.get(seen[1] if seen else "", "crate"), signature=re.sub(r"\s+", " ", raw.split("{")[0]).strip(), **span)
            last = ("constructor", f"{stack[-1][2]}.{name}", out.rows[-1])
        elif (m := importing.match(raw)) and not in_function and (name := next((g for g in m.groups() if g), None)):
            out.add("import", target=name, **span)
        else:
            for kind, e in wanted:
                m = e.match(line)
                if m and m["n"] not in NO_CALL:
                    holder = next((q for _, k, q, _ in reversed(stack) if k in HOLDERS), None)
                    own = f"{m['r']}{separator}{m['n']}" if "r" in m.groupdict() and m["r"] else m["n"]
                    qualified = f"{holder}{separator}{own}" if holder else own
                    if kind == "function" and holder and stack and stack[-1][1] in HOLDERS - {"module"}:
                        kind = "method"
                    word = re.match(r"\s*(?:export\s+)?(pub|public|private|protected|internal|open)\b", line)
                    seen = {"pub": "public", "public": "public", "open": "public", "private": "private", "protected": "crate", "internal": "crate"}.get(word[1] if word else "")
                    out.add("symbol", name=m["n"], qualified=qualified, kind=kind, parent=holder, scope="nested" if in_function else "top_level", visibility=seen, signature=re.sub(r"\s+", " ", raw.split("{")[0]).strip(), **span)
                    last = (kind, qualified, out.rows[-1])
                    if kind in HOLDERS and (f := FOR.match(line.strip())):
                        out.add("implementation", qualified=f["n"], target=f["t"].rpartition("::")[2], target_qualified=f["t"], kind="trait", role="impl_for", **span)
                    elif kind in HOLDERS - {"module", "impl"} or language == "swift":
                        for b in BASES.finditer(line, m.end("n")):
                            shape = b.lastgroup
                            for base in re.split(r",\s*(?![^<(]*[>)])", b[shape]):
                                role = role_of(language, shape, kind, base.strip())
                                base = re.sub(r"<.*|\(.*|^(?:public|private|protected)\s+", "", base.strip()).strip()
                                if base:
                                    out.add("implementation", qualified=qualified, target=re.split(r"[.:\\]", base)[-1], target_qualified=base, kind="implement" if shape == "implements" else "inherit", role=role, **span)
                    break
            holder = stack[-1][2] if stack else None
            start = m.end() if m else 0
            for c in CALL.finditer(line, start):
                if c[2] not in NO_CALL:
                    enclosing = last[1] if m and last and last[0] not in HOLDERS else next((q for _, k, q, _ in reversed(stack) if k not in HOLDERS), holder)
                    new = re.search(r"\bnew\s+$", line[: c.start()])
                    out.add("ref", kind="instantiate" if new else "call", target=c[2], role=(c[1] + c[2]) if c[1] else None, enclosing=enclosing, byte_start=at + c.start(2), byte_end=at + c.end(2), line_start=number, line_end=number)
        for i, ch in enumerate(line):
            if ch == "{":
                if last:
                    stack.append((depth, *last))
                    last = None
                depth += 1
            elif ch == "}":
                depth -= 1
                while stack and stack[-1][0] >= depth:
                    row = stack.pop()[3]
                    row["byte_end"], row["line_end"] = at + i + 1, number
            elif ch == ";":
                last = None
        at += len(line) + 1
    return out.rows


def ruby_facts(data: bytes) -> list[dict]:
    """Modules, classes and methods nested by their ``end``; mixins and requires."""
    out, at = Rows(data), 0
    stack: list[tuple[str, str | None, dict | None, int]] = []
    for number, raw in enumerate(data.decode("latin-1").split("\n"), 1):
        line = re.sub(r"#(?!\{).*", "", raw)
        indent = len(line) - len(line.lstrip())
        span = {"byte_start": at + indent, "byte_end": at + len(line.rstrip()), "line_start": number, "line_end": number}
        names = [s[1] for s in stack if s[0] in ("class", "module")]
        holder = "::".join(n for n in names if n) or None
        if m := re.match(r"\s*(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", line):
            qualified = f"{holder}::{m[2]}" if holder else m[2]
            out.add("symbol", name=m[2].rpartition("::")[2], qualified=qualified, kind=m[1], parent=holder, scope="top_level", visibility="public", signature=line.strip(), **span)
            stack.append((m[1], m[2], out.rows[-1], indent))
            if m[3]:
                out.add("implementation", qualified=qualified, target=m[3].rpartition("::")[2], target_qualified=m[3], kind="inherit", role="less_than", **span)
        elif m := re.match(r"\s*def\s+(self\.)?([\w?!=]+)", line):
            out.add("symbol", name=m[2], qualified=f"{holder}::{m[2]}" if holder else m[2], kind="method" if holder else "function", parent=holder, scope="top_level", visibility="public", signature=line.strip(), **span)
            stack.append(("def", m[2], out.rows[-1], indent))
        elif m := re.match(r"\s*(include|extend|prepend)\s+([A-Z][\w:]*)", line):
            out.add("implementation", qualified=holder, target=m[2].rpartition("::")[2], target_qualified=m[2], kind=m[1], role=m[1], **span)
        elif m := re.match(r"\s*(?:require|require_relative|load)\s+['\"]([^'\"]+)", line):
            out.add("import", target=m[1], **span)
        elif re.match(r"\s*end\b", line) and stack and stack[-1][3] >= indent:
            row = stack.pop()[2]
            row["byte_end"], row["line_end"] = span["byte_end"], number
        at += len(raw) + 1
    return out.rows


def facts_of(language: str, data: bytes) -> list[dict]:
    """All facts of a file; a file that does not parse gives one error row."""
    try:
        if language == "python":
            return python_facts(data)
        if language == "markdown":
            return markdown_facts(data)
        return ruby_facts(data) if language == "ruby" else brace_facts(data, language)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [{"fact": "error", "name": type(error).__name__, "doc": str(error)[:MAX_DOC]}]


@F.pandas_udf(T.StringType())
def by_head(paths: pd.Series, heads: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else dispatch(p, bytes(h)) for p, h in zip(paths, heads, strict=True)], dtype=object)


def head_of(path: Column, content: Column) -> tuple[Column, Column]:
    """The language that a file's extension tells, and what else must be read of it: 64 KiB of headers, a first line where no extension is known."""
    extension = F.regexp_extract(path, r"\.([^./]*)\z", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair]), extension)
    return known, F.when(extension == "h", F.substring(content, 1, 64 * 1024)).when(known.isNull(), F.substring(content, 1, 256))


def dispatched(path: Column, content: Column) -> Column:
    """The language of each file as ``dispatch`` tells it. Python gets no more of a content than it needs."""
    known, head = head_of(path, content)
    return F.coalesce(known, by_head(path, head))


def parser_id(language: Column) -> Column:
    return F.when(language == "markdown", language).otherwise(F.concat(F.lit("tree-sitter-"), language))


def extract(files: DataFrame) -> DataFrame:
    """Facts of files (path, blob_sha, content): each distinct unit of content and parser is parsed once."""
    units = files.withColumn("language", dispatched(F.col("path"), F.col("content"))).filter("language IS NOT NULL")
    return extract_units(units.select("blob_sha", parser_id(F.col("language")).alias("parser_id"), "content").dropDuplicates(["blob_sha", "parser_id"]))


def extract_units(units: DataFrame) -> DataFrame:
    """Facts of units (blob_sha, parser_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, parser, content in zip(b["blob_sha"], b["parser_id"], b["content"], strict=True):
                rows += [{"blob_sha": sha, "parser_id": parser, **r} for r in facts_of(parser.removeprefix("tree-sitter-"), bytes(content))]
                if len(rows) >= 5000:
                    yield framed(rows)
                    rows = []
            if rows:
                yield framed(rows)

    return units.select("blob_sha", "parser_id", "content").mapInPandas(run, FACTS)


def framed(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=COLUMNS)
    return out.astype({c: "Int64" for c in COLUMNS[-4:]}).astype({c: object for c in COLUMNS[:-4]}).where(out.notna(), None)


def with_enclosing_ids(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with the id of their enclosing symbol: of the first one with that qualified name in the unit."""
    first = symbols.groupBy("blob_sha", "parser_id", F.col("qualified").alias("enclosing")).agg(F.min("id").alias("enclosing_id"))
    return refs.join(first, ["blob_sha", "parser_id", "enclosing"], "left")


def with_doc_overrides(symbols: DataFrame, overrides: DataFrame) -> DataFrame:
    """Symbols with docs replaced where (blob_sha, parser_id, qualified, kind) has one, so that a type's doc does not reach its impl rows."""
    keys = ["blob_sha", "parser_id", "qualified", "kind"]
    new = overrides.groupBy(*keys).agg(F.min("doc").alias("_doc"))
    return symbols.join(new, keys, "left").withColumn("doc", F.coalesce("_doc", "doc")).drop("_doc")
