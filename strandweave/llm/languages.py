"""Tokens of the scanned languages, and whether a file parses.

A file's tokens come from one regular expression per language.  Every distinct
lexeme is classified once per worker; the classes then drive the grammar of
``grammars`` through its memoised derivatives.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from . import grammars as G
from .derivative import Grammar

#: Distinct lexemes remembered per language and worker; the memo is emptied beyond it.
MAX_LEXEMES = 400_000

_KEYWORDS = {
    "js": (G._JS_WORDS + " " + G._JS_SOFT).split(),
    "go": """break case chan const continue default defer else fallthrough for func go goto if import interface map package range
return select struct switch type var""".split(),
    "rs": G.RUST_WORDS.split(),
    "java": """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally
float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp
super switch synchronized this throw throws transient try void volatile while true false null _ record sealed permits var yield when non
module open to with transitive""".split(),
    "c": """alignas alignof auto bool break case char const constexpr continue default do double else enum extern false float for goto if
inline int long nullptr register restrict return short signed sizeof static static_assert struct switch thread_local true typedef typeof
typeof_unqual union unsigned void volatile while _Atomic _BitInt _Complex _Generic _Noreturn asm __attribute__""".split(),
    "py": (G.PY_WORDS + " " + G._PY_SOFT).split(),
}
_ALIASES = {
    "c": {"_Alignas": "alignas", "_Alignof": "alignof", "_Bool": "bool", "_Static_assert": "static_assert", "_Thread_local": "thread_local",
          "__asm__": "asm", "__asm": "asm", "__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__volatile__": "volatile",
          "__const": "const", "__typeof__": "typeof", "__extension__": None},
}

_STR, _CHR = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\.)+'"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/|/\*"
_WORD = r"[^\W\d]\w*"
_NUMBERS = {"rs": r"\d[\d_]*(?:\.\d[\d_]*)?[eE][+-]?[\d_]+\w*|\d\w*(?:\.\d\w*|\.(?![.\w]))?"}
_NUMBER = r"\.?\d(?:[eEpP][+-]?\w|[\w.])*"

#: Longest first; '>' stays single where it may close type arguments.
_OPS = {
    "js": r"\?\?=|\?\?|\?\.(?!\d)|\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<<|>=|<=|&&=|&&|\|\|=|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!?:;,.(){}\[\]<>=@]",
    "go": r":=|\.\.\.|<-|<<=|>>=|&\^=|&\^|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!:;,.(){}\[\]<>=]",
    "rs": r"\.\.\.|\.\.=|\.\.|::|->|=>|<<=|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!?:;,.(){}\[\]<>=@#$]",
    "java": r"\.\.\.|::|->|<<=|<<|<=|>=|==|!=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!?:;,.(){}\[\]<>=@]",
    "c": r"\.\.\.|->|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!?:;,.(){}\[\]<>=]",
    "py": r"\.\.\.|->|:=|\*\*=|\*\*|//=|//|<<=|>>=|<<|>>|<=|>=|==|!=|[-+*/%&|^@]=|[-+*/%&|^~:;,.(){}\[\]<>=@]",
}

_FULL_NUMBER = {
    "js": r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*)n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?",
    "go": r"(?:0[xX][\da-fA-F_]+|0[oO]?[0-7_]*|0[bB][01_]+|[1-9][\d_]*)i?|0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?",
    "rs": r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:f32|f64)?|\d[\d_]*\.",
    "java": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*)[lL]?|0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+[fFdD]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[fFdD]?",
    "c": r"(?:0[xX][\da-fA-F']+|0[bB][01']+|\d[\d']*)(?:[uU](?:l|L|ll|LL|wb|WB|z|Z)?|(?:l|L|ll|LL|wb|WB)[uU]?|[zZ][uU]?)?|0[xX][\da-fA-F']*\.?[\da-fA-F']*[pP][+-]?\d+[fFlL]?|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?(?:[fFlL]|[fF]\d+|[dD][dDfFlL])?",
    "py": r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|[1-9](?:_?\d)*|0(?:_?0)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?",
}
_GO_ENDS = frozenset("IDENT NUM STR CHAR break continue fallthrough return ++ -- ) ] }".split())
#: After these a slash in JavaScript divides; after anything else it opens a pattern.
_VALUE_ENDS = frozenset("IDENT NUM STR TMPL REGEX PRIVATE ) ] } this super null true false".split()) | set(G._JS_SOFT.split())
_DIRECTIVES = frozenset("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma embed ident".split())


class Verdict(NamedTuple):
    ok: bool
    truncated: bool
    line: int | None
    token: str | None


OK = Verdict(True, False, None, None)


class _Classes(dict):
    """lexeme -> token class, '' for what is skipped."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, lexeme):
        if len(self) > MAX_LEXEMES:
            self.clear()
        c = self[lexeme] = self.of(lexeme)
        return c


class Language:
    """Tokens and grammar of one language."""

    def __init__(self, name: str, grammar: str, start: str, extra: str, keywords: str, skip: frozenset = frozenset()):
        self.name, self.kind = name, keywords
        self.grammar = Grammar(grammar, start, skip)
        self.words = frozenset(_KEYWORDS[keywords])
        self.aliases = _ALIASES.get(keywords, {})
        self.number = re.compile(_FULL_NUMBER[keywords])
        self.ops = re.compile(_OPS[keywords])
        #: [^\S\n] is blank space within a line
        self.pattern = re.compile(r"[^\S\n]*(" + extra + "|" + _WORD + "|" + _NUMBERS.get(keywords, _NUMBER) + "|" + _OPS[keywords] + r"|\n\s*|[\s\S]|$)")
        self.classes = _Classes(self.classify)

    def classify(self, x: str) -> str:
        if not x:
            return ""
        c = x[0]
        if c == "\n":
            return "\n"
        if (c.isalpha() or c == "_") and x.isidentifier():
            x = self.aliases.get(x, x)
            return "" if x is None else x if x in self.words else "IDENT"
        if c.isdecimal() or c == "." and x[1:2].isdecimal():
            return "NUM" if self.number.fullmatch(x) else "ERR"
        special = self.special(x, c)
        if special is not None:
            return special
        return x if self.ops.fullmatch(x) else "ERR"

    def special(self, x: str, c: str) -> str | None:
        if c == '"':
            return "STR" if len(x) > 1 else "ERR"
        if c == "'":
            return "CHAR" if len(x) > 2 else "ERR"
        if x.startswith("//"):
            return ""
        if x.startswith("/*"):
            return "ERR" if len(x) < 4 else "\n" if "\n" in x else ""
        return None

    def lexemes(self, body: str) -> list[str]:
        return self.pattern.findall(body)

    def tokens(self, body: str) -> tuple[list[str], list[str] | None]:
        """Token classes, and the lexemes they come from (None if tokens were inserted)."""
        return [c for c in map(self.classes.__getitem__, self.lexemes(body)) if c and c != "\n"], None

    def verdict(self, body: str) -> Verdict:
        body = body.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        tokens, _ = self.tokens(body)
        u = self.grammar.initial()
        for t in tokens:
            u = u[t]
        if u.nullable and self.balanced(body):
            return OK
        at = self.grammar.failure(tokens)
        if at is None or at == len(tokens):
            return Verdict(False, True, body.count("\n") + 1, None)
        return Verdict(False, False, *self.place(body, tokens, at))

    def balanced(self, body: str) -> bool:
        return True

    def place(self, body: str, tokens: list[str], at: int) -> tuple[int, str]:
        """Line and class of a failing token: inserted tokens are passed over by counting real ones."""
        line, seen, want = 1, 0, sum(t not in self.inserted for t in tokens[: at + 1])
        for x in self.lexemes(body):
            c = self.classes[x]
            if c and c not in ("\n", "SKIP"):
                seen += 1
                if seen >= want:
                    break
            line += x.count("\n")
        return line, tokens[at]

    inserted: frozenset = frozenset()


class Braces(Language):
    """C-like languages in which line ends play no part."""


class CLang(Language):
    def special(self, x, c):
        if c == "#":
            m = re.match(r"#[ \t]*(\w*)", x)
            return "SKIP" if m[1] in _DIRECTIVES or not x[1:].strip() or m[1].isdecimal() else "ERR"
        if x.startswith(("u8", "L", "u", "U")):
            x = x.lstrip("u8LU")
            c = x[:1]
        if c == '"' and ("\n" in x.replace("\\\n", "")):
            return "ERR"
        return super().special(x, c)

    def classify(self, x):
        if x[:1] in "uUL" and x[-1:] in "\"'" and len(x) > 2:
            return self.special(x, x[0])
        return super().classify(x)

    def tokens(self, body):
        return [c for c in map(self.classes.__getitem__, self.lexemes(body)) if c and c != "\n" and c != "SKIP"], None

    def balanced(self, body):
        if "#" not in body:
            return True
        depth = 0
        for x in self.lexemes(body):
            if x[:1] == "#" and (m := re.match(r"#[ \t]*(if|ifdef|ifndef|endif|elif|else|elifdef|elifndef)\b", x)):
                depth += m[1].startswith("if")
                if not depth:
                    return False
                depth -= m[1] == "endif"
        return depth == 0


class Go(Language):
    inserted = frozenset({";"})

    def special(self, x, c):
        if c == "`":
            return "STR" if len(x) > 1 else "ERR"
        if c == '"' and "\n" in x:
            return "ERR"
        return super().special(x, c)

    def tokens(self, body):
        out, last = [], ""
        for c in map(self.classes.__getitem__, self.lexemes(body)):
            if c == "\n":
                if last in _GO_ENDS:
                    out.append(";")
                    last = ";"
            elif c:
                out.append(c)
                last = c
        if last in _GO_ENDS:
            out.append(";")
        return out, None

    def place(self, body, tokens, at):
        line, name = super().place(body, [t for t in tokens[: at + 1] if t != ";"] or tokens[at : at + 1], max(0, sum(t != ";" for t in tokens[: at + 1]) - 1))
        return line, tokens[at]


class Rust(Language):
    def special(self, x, c):
        if c == "'":
            return "CHAR" if len(x) > 2 and x[-1] == "'" else "LIFE" if len(x) > 1 else "ERR"
        if c in "rbc" and x[-1] in "#\"'":
            return "CHAR" if x[-1] == "'" else "STR"
        if x.startswith("r#"):
            return "IDENT"
        return super().special(x, c)

    def classify(self, x):
        if x[:1] in "rbc" and len(x) > 1 and (x[-1] in "#\"'" or x.startswith("r#")):
            return self.special(x, x[0])
        return super().classify(x)

    def lexemes(self, body):
        if body.startswith("#!") and not body.startswith("#!["):
            body = body[body.find("\n") :] if "\n" in body else ""
        if "/*" in body and re.search(r"/\*(?:(?!\*/)[\s\S])*/\*", body):
            body = _without_nested(body)
        return self.pattern.findall(body)


class Java(Language):
    def special(self, x, c):
        if x.startswith('"""'):
            return "STR" if len(x) >= 6 else "ERR"
        if c == '"' and "\n" in x:
            return "ERR"
        return super().special(x, c)


class Script(Language):
    """JavaScript and TypeScript: line ends may end statements, slashes may open patterns, templates nest."""

    inserted = frozenset({"NL"})

    def special(self, x, c):
        if c == "'":
            return "STR" if len(x) > 1 else "ERR"
        if c in "\"'" and "\n" in x.replace("\\\n", ""):
            return "ERR"
        if c == "`":
            return self.template(x)
        if c == "#":
            return "PRIVATE" if x[1:].isidentifier() else "ERR"
        if c == "$" or "$" in x and re.fullmatch(r"[\w$]+", x):
            return "IDENT"
        return super().special(x, c)

    def classify(self, x):
        if "$" in x and re.fullmatch(r"[\w$]+", x) and not x[0].isdecimal():
            return "IDENT"
        return super().classify(x)

    def template(self, x: str) -> str:
        parts, end = template_parts(x, 0)
        if end != len(x):
            return "ERR"
        for p in parts:
            tokens, _ = self.tokens(p)
            if not self.grammar.accepts([t for t in tokens if t != "NL"], "expr"):
                return "ERR"
        return "TMPL"

    def lexemes(self, body):
        if body.startswith("#!"):
            body = body[body.find("\n") :] if "\n" in body else ""
        if "/" not in body.replace("//", "").replace("/*", "").replace("*/", "") and "`" not in body:
            return self.pattern.findall(body)
        return self._modal(body)

    def _modal(self, body):
        out, i, last, classes, match = [], 0, "", self.classes, self.pattern.match
        while m := match(body, i):
            x = m[1]
            i = m.end()
            if not x:
                break
            if x[0] == "/" and last not in _VALUE_ENDS and x[:2] not in ("//", "/*"):
                if r := _REGEX.match(body, m.start(1)):
                    out.append(r[0])
                    classes[r[0]] = "REGEX" if _closed(r[0]) else "ERR"
                    i, last = r.end(), "REGEX"
                    continue
            elif x[0] == "`":
                _, end = template_parts(body, m.start(1))
                x, i = body[m.start(1) : end], end
            out.append(x)
            c = classes[x]
            if c and c != "\n":
                last = c
        return out

    def tokens(self, body):
        out = []
        for c in map(self.classes.__getitem__, self.lexemes(body)):
            if c == "\n":
                out.append("NL")
            elif c == "}":
                out += ("NL", "}")
            elif c:
                out.append(c)
        out.append("NL")
        return out, None


class Python(Language):
    inserted = frozenset({"NEWLINE", "INDENT", "DEDENT"})

    def special(self, x, c):
        if c == "#":
            return ""
        if c == "\\":
            return "" if len(x) > 1 else "ERR"
        if c in "\"'":
            quote = x[:3] if x[:3] in ('"""', "'''") else c
            return "STR" if len(x) >= 2 * len(quote) and x.endswith(quote) else "ERR"
        return super().special(x, c)

    def classify(self, x):
        if x[-1:] in ("'", '"') and (m := re.match(r"[A-Za-z]{1,2}(?=['\"])", x)):
            prefix = m[0].lower()
            if prefix not in ("r", "b", "u", "f", "br", "rb", "fr", "rf", "t", "tr", "rt"):
                return "ERR"
            c = self.special(x[m.end() :], x[m.end()])
            return c if c == "ERR" or not set(prefix) & {"f", "t"} or self.fstring(x[m.end() :]) else "ERR"
        return super().classify(x)

    def fstring(self, x: str) -> bool:
        quote = x[:3] if x[:3] in ('"""', "'''") else x[0]
        text = x[len(quote) : -len(quote)]
        fields = fstring_fields(text)
        if fields is None:
            return False
        return all(self.grammar.accepts([c for c in map(self.classes.__getitem__, self.nested_lexemes(f)) if c and c != "\n"], "fstring") for f in fields)

    def verdict(self, body):
        v = super().verdict(body)
        if not v.ok and _FORMATTED.search(body):
            # read again with formatted strings whose fields hold the same quotes
            self.lexemes = self.nested_lexemes
            try:
                v = super().verdict(body)
            finally:
                del self.lexemes
        return v

    def nested_lexemes(self, body: str) -> list[str]:
        """``lexemes`` with formatted strings read field by field."""
        if not _FORMATTED.search(body):
            return self.pattern.findall(body)
        out, i = [], 0
        while i <= len(body):
            m = self.pattern.match(body, i)
            begin, end = m.span(1)
            if _FORMATTED.match(body, begin) and not body[begin].isdigit():
                end = string_end(body, begin) or end
            out.append(body[begin:end])
            i = max(end, i + 1)
        return out

    def tokens(self, body):
        out, depth, indents, line_has = [], 0, [(0, 0)], False
        raw = self.lexemes("\n" + body if body[:1] in " \t\f" else body)
        classes = self.classes
        column = (0, 0)
        for x in raw:
            c = classes[x]
            if not c:
                continue
            if c == "\n":
                if depth:
                    continue
                if line_has:
                    out.append("NEWLINE")
                    line_has = False
                column = _columns(x)
                continue
            if not line_has:
                line_has = True
                if column != indents[-1]:
                    top = indents[-1]
                    if column[0] > top[0] and column[1] > top[1]:
                        indents.append(column)
                        out.append("INDENT")
                    elif column[0] < top[0]:
                        while column[0] < indents[-1][0]:
                            indents.pop()
                            out.append("DEDENT")
                        if column != indents[-1]:
                            out.append("ERR")
                    else:
                        out.append("ERR")
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            out.append(c)
        if line_has:
            out.append("NEWLINE")
        out += ["DEDENT"] * (len(indents) - 1)
        return out, None


def _columns(x: str) -> tuple[int, int]:
    """Width of a line's indentation with tabs to multiples of eight, and with tabs as single columns."""
    tail = x[x.rfind("\n") + 1 :]
    if "\t" not in tail and "\f" not in tail:
        return len(tail), len(tail)
    a = b = 0
    for ch in tail:
        if ch == "\t":
            a, b = a // 8 * 8 + 8, b + 1
        elif ch == "\f":
            a = b = 0
        else:
            a, b = a + 1, b + 1
    return a, b


_REGEX = re.compile(r"/(?![/*])(?:[^\[/\\\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")


def _closed(pattern: str) -> bool:
    """Whether a pattern's groups are balanced outside classes and escapes."""
    bare = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "", pattern)
    depth = 0
    for ch in bare:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            return False
    return depth == 0


def template_parts(text: str, at: int) -> tuple[list[str], int]:
    """Interpolated expressions of the template that opens at ``at``, and where it ends (or where the text does)."""
    parts, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return parts, i + 1
        elif c == "$" and text.startswith("${", i):
            begin, depth, i = i + 2, 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    _, i = template_parts(text, i)
                    continue
                if c in "\"'":
                    m = re.compile(c + r"(?:[^\\\n" + c + r"]|\\.)*" + c).match(text, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            if depth:
                return parts, n + 1
            parts.append(text[begin : i - 1])
        else:
            i += 1
    return parts, n + 1


_FORMATTED = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(?=['\"])")
_PLAIN = re.compile(r"\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")
_WORDS_BEFORE = re.compile(r"\w")


def string_end(text: str, at: int) -> int | None:
    """Where the string, formatted or not, that begins at ``at`` ends; None if it doesn't."""
    f = _FORMATTED.match(text, at)
    if f is None:
        m = _PLAIN.match(text, at)
        return m.end() if m else None
    i = f.end()
    quote = text[i] * 3 if text.startswith(text[i] * 3, i) else text[i]
    i += len(quote)
    while i < len(text):
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote)
        if c == "\\":
            i += 2
        elif c == "{" and not text.startswith("{{", i):
            end = _field_end(text, i + 1)
            if end is None:
                return None
            i = end + 1
        elif c == "\n" and len(quote) == 1:
            return None
        else:
            i += 2 if text.startswith("{{", i) else 1
    return None


def _expression_end(text: str, i: int, stops: str) -> int:
    """The first of ``stops`` outside brackets and strings from ``i`` on, len(text) if there is none."""
    depth = 0
    while i < len(text):
        c = text[i]
        if c in "\"'" or c in "fFtTrR" and _FORMATTED.match(text, i) and not _WORDS_BEFORE.match(text[i - 1 : i]):
            i = string_end(text, i) or i + 1
            continue
        if not depth and c in stops and not (c == "!" and text[i + 1 : i + 2] == "="):
            return i
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i if c == "}" else len(text)
        i += 1
    return i


def _field_end(text: str, i: int) -> int | None:
    """Where the replacement field that opens before ``i`` closes."""
    i = _expression_end(text, i, ":!}")
    if text[i : i + 1] == "!":
        i = _expression_end(text, i + 1, ":}")
    if text[i : i + 1] == ":":
        i += 1
        while i < len(text) and text[i] != "}":
            if text[i] == "{":
                end = _field_end(text, i + 1)
                if end is None:
                    return None
                i = end
            i += 1
    return i if text[i : i + 1] == "}" else None


def fstring_fields(text: str) -> list[str] | None:
    """Replacement fields of a formatted string's text, without conversions and formats, inner ones too; None if braces don't match."""
    fields, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "{}" and text.startswith(c * 2, i):
            i += 2
        elif c == "}":
            return None
        elif c == "{":
            close, end = _field_end(text, i + 1), _expression_end(text, i + 1, ":!}")
            if close is None or not text[i + 1 : end].strip():
                return None
            fields.append(text[i + 1 : end])
            if text[end] == "!":
                begin, end = end + 1, _expression_end(text, end + 1, ":}")
                if text[begin:end].rstrip() not in ("s", "r", "a"):
                    return None
            if text[end] == ":":
                # a format may hold fields of its own; its braces don't double
                inner = fstring_fields(text[end + 1 : close])
                if inner is None:
                    return None
                fields += inner
            i = close + 1
        else:
            i += 1
    return fields


def _without_nested(body: str) -> str:
    """Rust's block comments nest; each is replaced by its line ends."""
    out, i, depth, begin = [], 0, 0, 0
    for m in re.finditer(r"//[^\n]*|" + _STR + r"|/\*|\*/", body):
        x = m[0]
        if x == "/*":
            if not depth:
                out.append(body[i : m.start()])
                begin = m.start()
            depth += 1
        elif x == "*/" and depth:
            depth -= 1
            if not depth:
                out.append(" " + "\n" * body.count("\n", begin, m.end()))
                i = m.end()
        elif depth and x not in ("*/",) and "*/" in x:
            depth = max(0, depth - x.count("*/"))
            if not depth:
                i = m.start() + x.rindex("*/") + 2
    return "".join(out) + (body[i:] if not depth else body[begin:])


_TICK = r"`"
_LANGUAGES: dict[str, Language] = {}


def language(extension: str) -> Language | None:
    """The language of a lower-case extension, built when first asked for; None for others."""
    if extension in _LANGUAGES:
        return _LANGUAGES[extension]
    build = _BUILD.get(extension)
    if build is None:
        return None
    made = _LANGUAGES[extension] = build()
    return made


_SCRIPT_TOKENS = _COMMENT + r"|" + _STR + r"|'(?:[^'\\\n]|\\[\s\S])*'|#[\w$]+|`|[A-Za-z_$][\w$]*|[^\W\d][\w$]*"
_PY_TOKENS = (
    r"#[^\n]*|\\\n|(?:[A-Za-z]{1,2})?(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\")"
)
_BUILD = {
    "js": lambda: Script("js", G.JAVASCRIPT, "program", _SCRIPT_TOKENS, "js", frozenset({"NL"})),
    "ts": lambda: Script("ts", G.TYPESCRIPT, "program", _SCRIPT_TOKENS, "js", frozenset({"NL"})),
    "go": lambda: Go("go", G.GO, "file", _COMMENT + "|" + _STR + "|" + _CHR + r"|`[^`]*`", "go"),
    "rs": lambda: Rust("rs", G.RUST, "file", _COMMENT + "|" + "|".join(rf'[bc]?r{h}"[\s\S]*?"{h}' for h in ("", "#", "##", "###", "####")) + r'|r#\w+|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?' + r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'|'[^\W\d]\w*", "rs"),
    "java": lambda: Java("java", G.JAVA, "file", _COMMENT + r'|"""[\s\S]*?(?<!\\)"""|' + _STR + "|" + _CHR, "java"),
    "c": lambda: CLang("c", G.C, "file", _COMMENT + r"|#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*|(?:u8|[uUL])?" + _STR + "|(?:u8|[uUL])?" + _CHR, "c"),
    "py": lambda: Python("py", G.PYTHON, "file", _PY_TOKENS, "py"),
}


def verdict(extension: str, body: str | None) -> Verdict:
    """Whether ``body`` is syntactically valid in the language of ``extension``; null bodies and other languages are."""
    lang = language(extension)
    if lang is None or not body:
        return OK
    return lang.verdict(body)
