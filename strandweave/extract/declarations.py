"""Declarations and calls of languages with braces, from their tokens.

A file's tokens are read once, without comments.  What stands between the last end of a
statement and an opening brace (or a semicolon) is a head; the language's rules tell what
it declares.  Braces give the scopes, and a name before a parenthesis within a function is
a call.
"""

from __future__ import annotations

import re

from .found import Found, make_id

#: Words before a parenthesis that call nothing, in any language and in single ones.
NOT_CALLED = frozenset("""if for while switch match return catch function sizeof typeof alignof decltype new await yield else do in of super this throw assert
synchronized using lock foreach elif unless until case static_assert _Static_assert""".split())
_NOT_CALLED = {
    "js": frozenset("import async var let const".split()), "go": frozenset("func defer go select type".split()), "rs": frozenset("fn let loop unsafe async move where".split()), "java": frozenset("record when".split()),
    "c": frozenset("__attribute__ defined".split()), "cpp": frozenset("noexcept operator typeid throw requires __attribute__ defined".split()), "cs": frozenset("nameof default checked unchecked fixed when where is as not and or base".split()),
}
#: Words that an expression may follow.
_BEFORE_CALLS = frozenset("return else await yield throw throws case in of do go defer typeof delete not and or if while match let assert move ref range".split())
_WORD = r"[^\W\d][\w$]*|\$[\w$]*"
_STRINGS = {
    "js": r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`",
    "go": r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "rs": r"b?r(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n']+|\\')'|'\w+",
    "java": r"\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "c": r"R\"(?P<hash>[^\s()\\]{0,16})\([\s\S]*?\)(?P=hash)\"|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.)+'",
    "cs": r"\$*\"{3}[\s\S]*?\"{3}|(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
}
_STRINGS["cpp"] = _STRINGS["c"]
_PATTERN = r"(?P<before>[=(,:!&|?;{}\[]|\breturn)\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"


def _scanner(kind: str) -> re.Pattern:
    parts = [r"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\s+)"]
    if kind in ("c", "cpp", "cs"):
        parts.append(r"(?P<directive>(?m:^[ \t]*)\#(?:[^\n\\]|\\[\s\S])*)")
    if kind == "js":
        parts.append(_PATTERN)
    parts += [f"(?P<text>{_STRINGS[kind]})", f"(?P<word>{_WORD})", r"(?P<number>\d[\w.]*)", r"(?P<sign>=>|::|->|\.\.\.|[\s\S])"]
    return re.compile("|".join(parts))


_SCANNERS: dict[str, re.Pattern] = {}


class Declarations:
    """Reads one file; ``read`` gives what was found."""

    def __init__(self, found: Found, text: str, kind: str):
        self.found, self.text, self.kind = found, text.removeprefix("\ufeff"), kind
        self.words_apart = NOT_CALLED | _NOT_CALLED[kind]
        #: enclosing scopes: (what, name, id); what is class, function, module or block
        self.scopes: list[tuple[str, str, str]] = []
        self.head: list[tuple[str, str, int]] = []
        self.depth = 0

    # -- reading

    def tokens(self):
        """(kind of token, text, line); directives of C are reported where they stand."""
        scan = _SCANNERS.get(self.kind)
        if scan is None:
            scan = _SCANNERS[self.kind] = _scanner(self.kind)
        line, at = 1, 0
        for m in scan.finditer(self.text):
            what = m.lastgroup if m.lastgroup != "hash" else "text"
            line += self.text.count("\n", at, m.start())
            at = m.start()
            if what == "before":
                yield ("word" if m["before"] == "return" else "sign"), m["before"], line
            elif what != "skip":
                yield what, m[0], line

    def read(self) -> Found:
        frames: list[tuple[list, int]] = []
        arrows: list[int] = []  # frames around arrow functions whose bodies go on
        lists = 0  # braces of a list of imports
        last_line = 0
        for what, x, line in self.tokens():
            if what == "directive":
                if m := re.match(r"[ \t]*\#\s*include\s*[<\"]([^>\"]+)[>\"]", x):
                    self.found.edges.append((self.found.file_id, make_id(m[1]), "imports", line))
                continue
            fresh = line > last_line and self.depth == 0 and self._ended(x)
            while arrows and len(frames) <= arrows[-1] and self.depth == 0 and (x in ";}" or fresh or not self.head):
                arrows.pop()
                self.scopes.pop()
                if not (arrows and len(frames) <= arrows[-1]):
                    self._statement()
            last_line = line
            if fresh and self.head and self.kind in ("go", "js"):
                self._statement()
            if what != "sign":
                self.head.append((what, x, line))
            elif x == "{" and self.kind == "rs" and "use" in (w for _, w, _ in self.head[:6]):
                lists += 1
                self.head.append((what, x, line))
            elif x == "}" and lists:
                lists -= 1
                self.head.append((what, x, line))
            elif x == "{":
                frames.append((self.head, self.depth))
                self.scopes.append(self._opened() if self.depth == 0 else ("block", "", ""))
                self.head, self.depth = [], 0
            elif x == "}":
                if self.head:
                    self._statement()
                if frames:
                    head, self.depth = frames.pop()
                    self.scopes.pop()
                    # within parentheses, or in an expression, the statement goes on
                    self.head = [*head, (what, "{}", line)] if self.depth or self._goes_on(head) else []
                else:
                    self.head, self.depth = [], 0
            elif x == ";" and self.depth == 0:
                self._statement()
            elif x == "(" and self.kind == "go" and [w for _, w, _ in self.head] == ["type"]:
                self.head = []  # a list of types, each of which is a statement
            else:
                if x in "([":
                    if x == "(":
                        self._call(line)
                    self.depth += 1
                elif x in ")]":
                    self.depth = max(0, self.depth - 1)
                self.head.append((what, x, line))
                if x == "=>" and self.kind == "js" and self.depth == 0 and (name := self._assigned()):
                    self.scopes.append(("function", name[0], self._symbol(name[0], name[1], True)))
                    arrows.append(len(frames))
        if self.head:
            self._statement()
        return self.found

    def _ended(self, x: str) -> bool:
        """Whether a statement can end at a line's end, given the next token."""
        what, before, _ = self.head[-1] if self.head else ("sign", ";", 0)
        closed = what in ("text", "number") or what == "word" and before not in ("return", "new", "else", "func", "type", "extends", "implements", "export", "default", "async") or before in (")", "]", "{}")
        return closed and x not in (".", ",", "?", ":", "+", "-", "*", "/", "=", "=>", "&", "|", ")", "]", "{", "<", ">", "extends", "implements", "instanceof", "in", "of", "as", "from")

    def _goes_on(self, head: list) -> bool:
        words = [x for _, x, _ in head]
        return self.kind == "js" and ("=" in words or "return" in words) and not ("class" in words or "function" in words or "=>" in words) or self.kind in ("c", "cpp", "cs") and ("=" in words or "typedef" in words)

    # -- scopes

    def _inside(self) -> tuple[str, str, str] | None:
        """The innermost scope that isn't a plain block."""
        return next((s for s in reversed(self.scopes) if s[0] != "block"), None)

    def _function(self) -> str | None:
        return next((s[2] for s in reversed(self.scopes) if s[0] == "function"), None)

    def _symbol(self, name: str, line: int, call: bool) -> str:
        top = self.scopes[-1] if self.scopes else None
        if call and top and top[0] == "class":
            return self.found.symbol(name, line, top[2], top[1])
        return self.found.symbol(name, line, call=call)

    def _call(self, line: int) -> None:
        owner = self._function()
        if owner is None or not self.head or self.head[-1][0] != "word":
            return
        name, before = self.head[-1][1], self.head[-2][1] if len(self.head) > 1 else ""
        if name in self.words_apart or before in ("new", "function", "fn", "func", "class", "@") or self.kind in ("c", "cpp") and before in (".", "->", "::"):
            return
        if len(self.head) > 1 and self.head[-2][0] == "word" and before not in _BEFORE_CALLS or before == "*" and len(self.head) > 2 and self.head[-3][1] == "function":
            return  # a declaration
        self.found.stubs.append((owner, name, line))

    def _bases(self, sid: str, words: list[str], relation: str, line: int) -> None:
        """Names of a list of types, without arguments, qualifiers and access words."""
        depth, name = 0, ""
        for x in [*words, ","]:
            if x in "<([":
                depth += 1
            elif x in ">)]":
                depth -= 1
            elif depth == 0 and x == ",":
                if name:
                    self.found.edges.append((sid, make_id(name), relation, line))
                name = ""
            elif depth == 0 and (x[0].isalpha() or x[0] in "_$") and x not in ("public", "private", "protected", "virtual"):
                name = x

    # -- heads

    def _words(self) -> list[str]:
        return ['"' if what == "text" else x for what, x, _ in self.head]

    @staticmethod
    def _outer(words: list[str]) -> list[str]:
        """The words with those in parentheses blanked."""
        out, depth = [], 0
        for x in words:
            depth -= x in ")]"
            out.append("" if depth > 0 else x)
            depth += x in "(["
        return out

    def _after(self, words: list[str], *keys: str) -> int | None:
        """Place of the last of ``keys`` outside parentheses that a name follows."""
        depth, at = 0, None
        for i, x in enumerate(words[:-1]):
            depth += (x in "([") - (x in ")]")
            if depth == 0 and x in keys and re.match(_WORD, words[i + 1]):
                at = i
        return at

    def _named_call(self, words: list[str]) -> int | None:
        """Place of the first name before a parenthesis outside others, annotations apart."""
        depth = 0
        for i, x in enumerate(words[:-1]):
            if depth == 0 and words[i + 1] == "(" and re.match(_WORD, x) and x not in self.words_apart:
                k = i
                while k > 1 and words[k - 1] == ".":
                    k -= 2
                if not (k and words[k - 1] == "@"):
                    return i
            depth += (x in "([") - (x in ")]")
        return None

    def _assigned(self) -> tuple[str, int] | None:
        """The name that a function is assigned to by const, let or var, or in a class by itself."""
        words = self._words()
        at = self._after(words, "const", "let", "var")
        if at is None or "=" not in words[at:]:
            return None
        tail = words[at + 2 + words[at + 2 :].index("=") + 1 :] if "=" in words[at + 2 :] else []
        tail = tail[1:] if tail[:1] == ["async"] else tail
        if tail[:1] == ["function"] or tail[-1:] == ["=>"] and (tail[0] == "(" or len(tail) == 2 or tail[0] == "<"):
            return words[at + 1], self.head[at + 1][2]
        return None

    def _opened(self) -> tuple[str, str, str]:
        """The scope that a brace after the head opens, its symbol added."""
        if not self.head:
            return ("block", "", "")
        return getattr(self, "_open_" + {"cpp": "c"}.get(self.kind, self.kind))(self._words(), self.head[-1][2])

    def _type(self, words: list[str], at: int) -> tuple[str, str, str]:
        name, line = words[at + 1], self.head[at + 1][2]
        return ("class", name, self._symbol(name, line, False))

    def _callable(self, name: str, line: int) -> tuple[str, str, str]:
        return ("function", name, self._symbol(name, line, True))

    def _open_js(self, words, line):
        at = self._after(words, "class")
        if at is not None:
            scope = self._type(words, at)
            if "extends" in words[at:]:
                tail = words[at + words[at:].index("extends") + 1 :]
                self._bases(scope[2], tail[: tail.index("implements")] if "implements" in tail else tail, "inherits", self.head[at][2])
            return scope
        f = self._after([x for x in words], "function")
        star = next((i for i in range(len(words) - 2) if words[i] == "function" and words[i + 1] == "*" and re.match(_WORD, words[i + 2])), None)
        if star is not None:
            return self._callable(words[star + 2], self.head[star + 2][2])
        if f is not None and words[f + 2 : f + 3] in (["("], ["<"]) and "=" not in self._outer(words[:f]):
            return self._callable(words[f + 1], self.head[f + 1][2])
        if "function" in words and (name := self._assigned()):
            return self._callable(*name)
        top = self.scopes[-1] if self.scopes else None
        if words[-1] == "=>":
            return ("block", "", "")
        if top and top[0] == "class" and (i := self._named_call(words)) is not None and "=" not in self._outer(words[:i]):
            return self._callable(words[i], self.head[i][2])
        return ("block", "", "")

    def _open_go(self, words, line):
        if self._function():
            return ("block", "", "")
        if "func" in words:
            at = len(words) - 1 - words[::-1].index("func") if words.count("func") == 1 else words.index("func")
            tail = words[at + 1 :]
            if tail[:1] == ["("]:
                close = tail.index(")") if ")" in tail else 0
                receiver = [x for x in tail[1:close] if re.match(_WORD, x)]
                if "[" in tail[1:close]:
                    receiver = [x for x in tail[1 : tail.index("[")] if re.match(_WORD, x)]
                if receiver and tail[close + 1 : close + 2] and re.match(_WORD, tail[close + 1]):
                    owner, name = receiver[-1], tail[close + 1]
                    return ("function", name, self.found.symbol(name, self.head[at][2], make_id(self.found.stem, owner), owner))
                return ("block", "", "")
            if tail and re.match(_WORD, tail[0]):
                return self._callable(tail[0], self.head[at][2])
            return ("block", "", "")
        if words[-1] in ("struct", "interface"):
            names = words[words.index("type") + 1 :] if "type" in words else words
            names = [x for x in names if x not in "()"]
            if names and re.match(_WORD, names[0]) and "=" not in words and names[0] not in ("var", "const", "func"):
                return ("class", names[0], self.found.symbol(names[0], self.head[0][2], call=False))
        return ("block", "", "")

    def _open_rs(self, words, line):
        if "impl" in words and "fn" not in words:
            tail, depth, plain = words[words.index("impl") + 1 :], 0, []
            for x in tail:
                depth += (x == "<") - (x == ">")
                if depth == 0 and x != ">":
                    plain.append(x)
            if "where" in plain:
                plain = plain[: plain.index("where")]
            names = lambda xs: [x for x in xs if re.match(_WORD, x) and x not in ("dyn", "mut", "const")]
            if "for" in plain:
                trait, kind = names(plain[: plain.index("for")]), names(plain[plain.index("for") + 1 :])
                if trait and kind:
                    self.found.edges.append((make_id(self.found.stem, kind[-1]), make_id(trait[-1]), "implements", self.head[0][2]))
            else:
                kind = names(plain)
            return ("class", kind[-1], make_id(self.found.stem, kind[-1])) if kind else ("block", "", "")
        at = self._after(words, "fn")
        if at is not None:
            return self._callable(words[at + 1], self.head[at + 1][2])
        at = self._after(words, "struct", "enum", "trait", "union")
        if at is not None and "=" not in self._outer(words[:at]):
            return self._type(words, at)
        at = self._after(words, "mod")
        if at is not None:
            return ("module", words[at + 1], self._symbol(words[at + 1], self.head[at + 1][2], False))
        return ("block", "", "")

    def _open_java(self, words, line):
        at = self._after(words, "class", "interface", "enum", "record")
        if at is not None and "=" not in self._outer(words[:at]) and (words[at] != "record" or "(" in words[at:]) and (not at or words[at - 1] != "."):
            scope = self._type(words, at)
            tail = words[at + 2 :]
            for key, relation in (("extends", "inherits"), ("implements", "implements")):
                if key in tail:
                    rest = tail[tail.index(key) + 1 :]
                    stop = min([rest.index(k) for k in ("implements", "permits", "extends") if k in rest], default=len(rest))
                    self._bases(scope[2], rest[:stop], relation, self.head[at][2])
            return scope
        return self._member(words) or ("block", "", "")

    def _member(self, words: list[str]) -> tuple[str, str, str] | None:
        """A method or constructor of the class that directly encloses."""
        top = self.scopes[-1] if self.scopes else None
        i = self._named_call(words)
        if top is None or top[0] != "class" or i is None or "=" in self._outer(words[:i]):
            return None
        if i == 0 and words[0] != top[1] or i and words[i] != top[1] and not (re.match(_WORD, words[i - 1]) or words[i - 1] in (">", "]", "*", "&", "?", ")")):
            return None
        return self._callable(words[i], self.head[i][2])

    def _open_c(self, words, line):
        inside = self._inside()
        if inside and inside[0] == "function":
            return ("block", "", "")
        if self.kind == "cpp":
            if "namespace" in words or words[:1] == ["extern"] and words[-1] == '"':
                return ("module", "", "")
            at = self._after(words, "class", "struct")
            if at is not None and "(" not in words and "=" not in words and "enum" not in words:
                k = at + 1
                scope = self._type(words, at)
                if ":" in words[k:]:
                    self._bases(scope[2], words[k + words[k:].index(":") + 1 :], "inherits", self.head[at][2])
                return scope
            if inside and inside[0] == "class" and (m := self._member(words)):
                return m
        elif words[:1] == ["extern"] and words[-1] == '"':
            return ("module", "", "")
        elif len(words) > 1 and words[-2] == "struct" and re.match(_WORD, words[-1]):
            return self._type(words, len(words) - 2)
        i = self._named_call(words)
        if i and "=" not in self._outer(words[:i]) and "operator" not in words and (inside is None or inside[0] == "module") and (re.match(_WORD, words[i - 1]) or words[i - 1] in ("*", "&", "::", ">")) and ")" in words:
            return ("function", words[i], self.found.symbol(words[i], self.head[i][2]))
        return ("block", "", "")

    def _open_cs(self, words, line):
        at = self._after(words, "namespace")
        if at is not None:
            name = ".".join(x for x in words[at + 1 :] if x != ".")
            return ("module", name, self.found.symbol(name, self.head[at][2], call=False))
        at = self._after(words, "class", "interface", "struct", "record")
        if at is not None and "=" not in self._outer(words[:at]) and (words[at] != "record" or words[at + 1] != "("):
            if words[at] == "record" and words[at + 1] in ("class", "struct"):
                at += 1
            scope = self._type(words, at)
            if ":" in words[at:]:
                tail = words[at + words[at:].index(":") + 1 :]
                self._bases(scope[2], tail[: tail.index("where")] if "where" in tail else tail, "inherits", self.head[at][2])
            return scope
        return self._member(words) or ("block", "", "")

    def _statement(self) -> None:
        """What a head declares that no brace follows."""
        words, line = self._words(), self.head[0][2] if self.head else 0
        found, top = self.found, self.scopes[-1] if self.scopes else None
        raw = [x[1:-1] if what == "text" else x for what, x, _ in self.head]
        add = lambda name, relation, at: found.edges.append((found.file_id, make_id(name), relation, at))
        if self.kind == "js":
            for i, (what, x, at) in enumerate(self.head):
                if what == "text" and i and (words[i - 1] in ("from", "import") or words[i - 1] == "(" and i > 1 and words[i - 2] == "require"):
                    add(x[1:-1], "imports_from", at)
        elif self.kind == "go" and words[:1] == ["import"]:
            for what, x, at in self.head:
                if what == "text":
                    add(x[1:-1], "imports", at)
        elif self.kind == "go" and words[:1] == ["type"] and len(words) > 2 and words[2] != "=" and not self._function():
            found.symbol(words[1], line, call=False)
        elif self.kind == "rs":
            if "use" in words and words[0] in ("use", "pub"):
                add("".join(raw[words.index("use") + 1 :]), "imports", line)
            elif (at := self._after(words, "fn")) is not None and top and top[0] == "class":
                self._symbol(words[at + 1], self.head[at + 1][2], True)
            elif (at := self._after(words, "struct")) is not None and "=" not in words:
                self._symbol(words[at + 1], self.head[at + 1][2], False)
        elif self.kind == "java":
            if words[:1] == ["import"]:
                add("".join(x for x in raw[1:] if x != "static"), "imports", line)
            elif top and top[0] == "class" and words[-1:] == [")"]:
                self._member(words)
        elif self.kind == "cs":
            if words[:1] == ["using"] and "=" not in words and "(" not in words and not self._function():
                add("".join(x for x in raw[1:] if x != "static"), "imports", line)
            elif words[:1] == ["namespace"]:
                found.symbol("".join(raw[1:]), line, call=False)
            elif top and top[0] == "class" and words[-1:] == [")"]:
                self._member(words)
        self.head = []
