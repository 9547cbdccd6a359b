"""Symbols, imports, bases and calls of one file.

Python is read by its own parser, Ruby by its ``end``s, and the languages with braces by
``declarations``.  Ids are built from relative paths, so they are the same on every machine.
"""

from __future__ import annotations

import ast
import re
import warnings

from .declarations import NOT_CALLED, Declarations
from .found import Found, file_stem, make_id  # noqa: F401


def extract_python(path: str, text: str) -> Found:
    out = Found(path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.removeprefix("﻿"))

    def calls(owner: str, node: ast.AST) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.stubs.append((owner, name, x.lineno))

    def visit(body: list[ast.stmt], owner: str | None, container: str | None) -> None:
        for x in body:
            if isinstance(x, ast.Import):
                out.edges += [(out.file_id, make_id(a.name), "imports", x.lineno) for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                out.edges.append((out.file_id, make_id(x.module or "."), "imports_from", x.lineno))
            elif isinstance(x, ast.ClassDef):
                sid = out.symbol(x.name, x.lineno, owner, container, call=False)
                for b in x.bases:
                    base = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                    if base:
                        out.edges.append((sid, make_id(base), "inherits", x.lineno))
                visit(x.body, sid, x.name)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                calls(out.symbol(x.name, x.lineno, owner, container), x)
            elif isinstance(x, (ast.If, ast.Try, ast.With)):
                visit([*x.body, *getattr(x, "orelse", []), *getattr(x, "finalbody", [])], owner, container)

    visit(tree.body, None, None)
    return out


_RUBY_BLANK = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_RUBY_REQUIRE = re.compile(r"(?m)^\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']")


def extract_ruby(path: str, text: str) -> Found:
    out = Found(path)
    for m in _RUBY_REQUIRE.finditer(text):
        out.edges.append((out.file_id, make_id(m[1]), "imports", text.count("\n", 0, m.start()) + 1))
    bare = _RUBY_BLANK.sub(lambda m: " " * len(m[0]), text)
    scopes: list[tuple[str, str, str]] = []
    for number, line in enumerate(bare.split("\n"), 1):
        if m := re.match(r"\s*(?:class|module)\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?", line):
            sid = out.symbol(m[1], number, call=False)
            if m[2]:
                out.edges.append((sid, make_id(m[2].split("::")[-1]), "inherits", number))
            scopes.append(("class", m[1], sid))
        elif m := re.match(r"\s*def\s+(?:self\.)?([\w?!]+)", line):
            c = next((s for s in reversed(scopes) if s[0] == "class"), None)
            scopes.append(("function", m[1], out.symbol(m[1], number, c[2] if c else None, c[1] if c else None)))
        elif re.match(r"\s*(if|unless|case|while|until|begin|for)\b", line) or re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$", line):
            scopes.append(("block", "", ""))
        elif re.match(r"\s*end\b", line):
            if scopes:
                scopes.pop()
            continue
        owner = next((s[2] for s in reversed(scopes) if s[0] == "function"), None)
        if owner and not re.match(r"\s*def\b", line):
            out.stubs += [(owner, m[1], number) for m in re.finditer(r"([a-z_]\w*[?!]?)\s*\(", line) if m[1] not in NOT_CALLED]
    return out


EXTRACTORS = {
    "py": "py", "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "go": "go", "rs": "rs", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "rb", "cs": "cs",
}


def extract_text(path: str, text: str | None) -> Found | None:
    """What a file declares; None for languages without an extractor.  A file that can't be read keeps its own node and says why."""
    kind = EXTRACTORS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if kind is None:
        return None
    try:
        return extract_python(path, text or "") if kind == "py" else extract_ruby(path, text or "") if kind == "rb" else Declarations(Found(path), text or "", kind).read()
    except (SyntaxError, ValueError, RecursionError) as e:
        found = Found(path)
        found.error = f"{type(e).__name__}: {str(e)[:200]}"
        return found
