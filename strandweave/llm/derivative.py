"""Memoised parsing with derivatives for context-free grammars.

The language still to be read is a finite union of concatenations of grammar
symbols.  Alternatives that begin with the same symbol share it: a cell is a
symbol and the union of all that may follow it, so nested alternatives make a
graph of shared continuations and never a list of all their combinations.  The
derivative by a token is again such a union; every union is interned and keeps its
derivatives in a dictionary, so reading a token that was seen before in the same
situation is one look-up.  An empty union marks the token at which the text stops
being a prefix of any sentence; a union that is not nullable at the end means the
text was cut off.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:#[^\n]*\n\s*)*('[^']*'|\"[^\"]*\"|[A-Za-z_]\w*|[=|;(){}\[\]!])")

#: Interned unions kept per grammar before the memo is emptied, within a file too (it is only a cache).
MAX_STATES = 60_000
#: Symbols down to which two continuations are compared when they meet.
MAX_SHARED = 100


class _Not:
    """Zero-width: the next token is none of these."""

    __slots__ = ("tokens",)

    def __init__(self, tokens: frozenset):
        self.tokens = tokens


class Union(dict):
    """A union of cells, one per first symbol; as a dictionary it maps a token to the derivative.

    ``cells`` are (symbol, rest) with ``rest`` a union of its own; ``empty`` tells whether the empty word is
    a member beside them, ``nullable`` whether nothing need follow.
    """

    __slots__ = ("grammar", "cells", "empty", "nullable", "serial")

    def __missing__(self, token):
        self[token] = d = self.grammar.derive(self, token)
        return d

    def __hash__(self):
        return self.serial

    def __eq__(self, other):
        return self is other


class Grammar:
    """EBNF: ``name = a 'x' | [optional] {repeated} (group) ;``, ``!('x' | 'y')`` forbids a next token.

    A name that has a rule is a nonterminal, any other name a token class.  Left
    recursion isn't allowed.  Tokens in ``skip`` may also be left out of the reading.
    """

    def __init__(self, text: str, start: str, skip: frozenset = frozenset()):
        self.rules: dict[str, list[tuple]] = {}
        self.skip = skip
        self.skippable = skip
        self._helpers = 0
        self._read(text)
        self._null: dict[str, bool] = {}
        self._nullables()
        self._derived: dict[tuple, tuple] = {}
        self._unions: dict[frozenset, Union] = {}
        self._joins: dict[frozenset, Union] = {}
        self._starts: dict[str, Union] = {}
        self.start = start
        self._serial = 0
        self.end = self._new((), True)

    # -- reading the grammar

    def _read(self, text: str) -> None:
        toks, i = [], 0
        text = text + "\n"
        while m := _TOKEN.match(text, i):
            toks.append(m[1])
            i = m.end()
        if text[i:].strip():
            raise ValueError("grammar: " + text[i : i + 60])
        self._t, self._i = toks, 0
        while self._i < len(toks):
            name = toks[self._i]
            assert toks[self._i + 1] == "=", (name, toks[self._i - 3 : self._i + 4])
            self._i += 2
            self.rules[name] = self.rules.get(name, []) + self._alternatives()
            assert toks[self._i] == ";", (name, toks[self._i])
            self._i += 1
        del self._t, self._i
        # nonterminals are written <name> from here on, apart from tokens of the same spelling
        plain = lambda x: x if isinstance(x, _Not) else f"<{x[1]}>" if isinstance(x, tuple) and x[1] in self.rules else x[1] if isinstance(x, tuple) else x
        self.rules = {f"<{a}>": [tuple(map(plain, seq)) for seq in alts] for a, alts in self.rules.items()}

    def _helper(self, alternatives: list[tuple]) -> str:
        self._helpers += 1
        name = f"#{self._helpers}"
        self.rules[name] = alternatives
        return ("rule", name)

    def _alternatives(self) -> list[tuple]:
        out, seq = [], []
        while True:
            t = self._t[self._i]
            if t in ";)]}":
                out.append(tuple(seq))
                return out
            self._i += 1
            if t == "|":
                out.append(tuple(seq))
                seq = []
            elif t in "([{":
                inner = self._alternatives()
                assert self._t[self._i] == {"(": ")", "[": "]", "{": "}"}[t]
                self._i += 1
                if t == "(":
                    seq.append(self._helper(inner))
                elif t == "[":
                    seq.append(self._helper([*inner, ()]))
                else:
                    ref = self._helper([])
                    self.rules[ref[1]] = [a + (ref,) for a in inner] + [()]
                    seq.append(ref)
            elif t == "!":
                assert self._t[self._i] == "("
                self._i += 1
                inner = self._alternatives()
                self._i += 1
                seq.append(_Not(frozenset(a[0] for a in inner)))
            else:
                seq.append(t[1:-1] if t[0] in "'\"" else ("rule", t))

    def _nullables(self) -> None:
        null: dict = {a: False for a in self.rules}
        changed = True
        while changed:
            changed = False
            for a, alts in self.rules.items():
                if not null[a] and any(all(isinstance(x, _Not) or null.get(x, False) for x in s) for s in alts):
                    null[a] = changed = True
        self._null = null

    # -- derivatives

    def _of_symbol(self, a: str, t: str) -> tuple:
        """All w with a =>* t w, by leftmost derivation."""
        key = (a, t)
        if (known := self._derived.get(key)) is None:
            found: dict = {}
            self._derived[key] = ()  # only left recursion would see this
            for seq in self.rules[a]:
                for i, x in enumerate(seq):
                    if isinstance(x, _Not):
                        if t in x.tokens:
                            break
                        continue
                    if x in self.rules:
                        for w in self._of_symbol(x, t):
                            found[w + seq[i + 1 :]] = None
                        if not self._null[x]:
                            break
                    else:
                        if x == t:
                            found[seq[i + 1 :]] = None
                        break
            known = self._derived[key] = tuple(found)
        return known

    def _new(self, cells: tuple, end: bool) -> Union:
        u = Union()
        self._serial += 1
        u.grammar, u.cells, u.empty, u.serial = self, cells, end, self._serial
        u.nullable = end or any((isinstance(x, _Not) or self._null.get(x, False)) and rest.nullable for x, rest in cells)
        return u

    def _union(self, cells: set, end: bool) -> Union:
        """The interned union of these cells, and of the empty word with ``end``."""
        if not cells and end:
            return self.end
        key = frozenset(cells) if not end else frozenset((*cells, None))
        u = self._unions.get(key)
        if u is None:
            if len(self._unions) > MAX_STATES:
                # serials are never used twice, so what is still held stays right
                self._unions.clear(), self._joins.clear(), self._starts.clear()
            u = self._unions[key] = self._new(tuple(cells), end)
        return u

    def _shared(self, cells: set, end: bool, depth: int = 0) -> Union:
        """``_union`` with one cell for each symbol, whose rest is the shared union of what follows it."""
        by_symbol: dict = {}
        for x, rest in cells:
            by_symbol.setdefault(x, []).append(rest)
        if len(by_symbol) < len(cells):
            cells = {(x, rests[0] if len(rests) == 1 else self._joined(rests, depth + 1)) for x, rests in by_symbol.items()}
        return self._union(cells, end)

    def _joined(self, rests: list, depth: int) -> Union:
        """The union of unions; what lies more than ``MAX_SHARED`` symbols deep is shared when it is reached."""
        key = frozenset(rests)
        u = self._joins.get(key)
        if u is None:
            cells, end = {c for r in rests for c in r.cells}, any(r.empty for r in rests)
            u = self._joins[key] = self._shared(cells, end, depth) if depth < MAX_SHARED else self._union(cells, end)
        return u

    def _push(self, word: tuple, rest: Union) -> Union:
        for x in reversed(word):
            rest = self._union({(x, rest)}, False)
        return rest

    def derive(self, union: Union, t: str) -> Union:
        out: set = set()
        end = False
        if t in self.skip:
            out.update(union.cells)
            end = union.empty
        seen, todo = set(union.cells), list(union.cells)
        while todo:
            x, rest = todo.pop()
            through = False
            if isinstance(x, _Not):
                through = t not in x.tokens
            elif x in self.rules:
                for w in self._of_symbol(x, t):
                    if w:
                        out.add((w[0], self._push(w[1:], rest)))
                    else:
                        out.update(rest.cells)
                        end |= rest.empty
                through = self._null[x]
            elif x == t:
                out.update(rest.cells)
                end |= rest.empty
            if through:
                new = [c for c in rest.cells if c not in seen]
                seen.update(new)
                todo += new
        return self._shared(out, end)

    def initial(self, start: str | None = None) -> Union:
        start = start or self.start
        u = self._starts.get(start)
        if u is None:
            u = self._starts[start] = self._push((f"<{start}>",), self.end)
        return u

    def accepts(self, tokens, start: str | None = None) -> bool:
        u = self.initial(start)
        for t in tokens:
            u = u[t]
        return u.nullable

    def failure(self, tokens, start: str | None = None) -> int | None:
        """None for a sentence, the index of the failing token, or len(tokens) if the text was cut off."""
        u = self.initial(start)
        for t in tokens:
            u = u[t]
        if u.nullable:
            return None
        if u.cells or u.empty:
            return len(tokens)
        u = self.initial(start)
        for i, t in enumerate(tokens):
            u = u[t]
            if not (u.cells or u.empty):
                return i
        raise AssertionError("unreachable")
