"""Outline of a Rust source file: declarations, containment, imports, calls, references.

A lexer gives tokens with byte places; a recursive reader of items keeps a stack of scopes.
Bodies of macros are opaque but for their identifiers. Rules are data (``ITEMS``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from tessera.functions import vocab as V
from tessera.functions.exprs import fnv1a64

TOKEN = re.compile(
    rb"""(?P<ws>\s+)|(?P<doc>///[^\n]*|//![^\n]*)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)")|(?P<str>b?"(?:\\.|[^"\\])*")
    |(?P<life>'[A-Za-z_][A-Za-z0-9_]*(?!'))|(?P<char>b?'(?:\\[^\n]*?'|[^'\\\n]{1,8}'))|(?P<num>\d[0-9A-Za-z_]*(?:\.\d[0-9A-Za-z_]*)?)
    |(?P<id>(?:r\#)?[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|[^\s])""", re.X | re.S)
# Reserved words of the language.
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while macro_rules".split())
#: keyword of an item -> kind of the entity that it declares
ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "mod": "module", "type": "type_alias", "const": "constant", "static": "static"}
TYPES = frozenset(("struct", "enum", "union", "trait", "impl"))
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(source: bytes) -> tuple[list[Token], list[Token], list[int]]:
    """(tokens, doc comments, places of what can't be read)."""
    out, docs, bad = [], [], []
    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        kind, end = m.lastgroup, m.end()
        if m["block"]:
            depth, end, kind = 1, at + 2, "ws"
            while depth and end < len(source):
                if source.startswith(b"/*", end):
                    depth, end = depth + 1, end + 2
                elif source.startswith(b"*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            if depth:
                bad.append(at)
        elif m["raw"]:
            close = source.find(b'"' + m["hash"], end)
            kind = "str"
            if close < 0:
                bad.append(at)
                end = len(source)
            else:
                end = close + 1 + len(m["hash"])
        elif kind == "op" and m["op"] in (b'"',):
            bad.append(at)
        if kind not in ("ws", "line"):
            t = Token("str" if kind in ("char", "hash") else kind, source[at:end].decode("utf-8", "replace"), at, end)
            (docs if kind == "doc" else out).append(t)
        at = max(end, at + 1)
    return out, docs, bad


@dataclass
class Scope:
    kind: str  # file, module, impl, type, function, block
    name: str  # dotted qualified name of what it declares names under
    entity: tuple | None
    locals: set = field(default_factory=set)


class Outline:
    def __init__(self, path: str, source: str):
        self.path, self.source = path, source.encode("utf-8")
        self.tokens, self.docs, self.bad = lex(self.source)
        self.lines = [0] + [m.end() for m in re.finditer(rb"\r\n|\n|\r", self.source)]
        self.entities: list[dict] = []
        self.relations: list[dict] = []
        self.ordinals: dict[tuple, int] = {}
        self.match = self._pairs()
        name = path.rsplit("/", 1)[-1]
        self.file = (path, "file", name, 0)
        self.entities.append(self._entity("file", name, name, None, None, None, None, False))
        self.scopes = [Scope("file", "", self.file)]
        self.tests = 0

    # -- places

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(k)
            elif t.kind == "op" and t.text in CLOSE:
                if stack and OPEN[self.tokens[stack[-1]].text] == t.text:
                    out[stack.pop()] = k
                else:
                    self.bad.append(t.start)
        for k in stack:
            self.bad.append(self.tokens[k].start)
            out[k] = len(self.tokens) - 1
        return out

    def place(self, byte: int) -> tuple[int, int]:
        line = bisect_right(self.lines, byte)
        return line, len(self.source[self.lines[line - 1] : byte].decode("utf-8", "replace")) + 1

    def span(self, start: int, end: int) -> dict:
        (l0, c0), (l1, c1) = self.place(start), self.place(end)
        return {"start_byte": start, "end_byte": end, "start_line": l0, "start_column": c0, "end_line": l1, "end_column": c1}

    # -- rows

    def _entity(self, kind, qualified, name, start, end, signature, doc, test) -> dict:
        n = self.ordinals.get((kind, qualified), 0)
        self.ordinals[kind, qualified] = n + 1
        at = self.span(start, end) if start is not None else dict.fromkeys(("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"))
        text = self.source[start:end].decode("utf-8", "replace") if start is not None else self.source.decode("utf-8", "replace")
        return {"path": self.path, "kind": kind, "kind_ord": V.KIND_ORD[kind], "qualified_name": qualified, "entity_ordinal": n, "name": name, "signature": signature, "doc": doc, **at,
                "language": "rust", "is_test": test, "structural_fingerprint": fnv1a64(" ".join(text.split()))}

    def relate(self, kind: str, source: tuple, name: str, token: Token, end: Token | None = None, target: tuple | None = None, state: str = "pending", **more) -> None:
        row = dict.fromkeys(("target_path", "target_kind", "target_qualified_name", "target_ordinal", "ev_class", "ev_module", "ev_alias", "ev_receiver", "ev_scope", "ev_binder", "basis", "reason"))
        if target:
            row |= dict(zip(("target_path", "target_kind", "target_qualified_name", "target_ordinal"), target))
        row |= {"kind": kind, "source_path": source[0], "source_kind": source[1], "source_qualified_name": source[2], "source_ordinal": source[3], "target_name": name,
                **self.span(token.start, (end or token).end), "resolution_state": state} | more
        self.relations.append(row)

    def declare(self, kind: str, name: str, head: int, stop: int, end: int, doc: str | None = None, test: bool = False) -> tuple:
        """An entity for an item (tokens head..end, signature up to ``stop``) in the scope."""
        scope = self.scopes[-1]
        if kind == "function" and any(s.kind in ("impl", "type") for s in self.scopes[-1:]):
            kind = "method"
        qualified = f"{scope.name}.{name}" if scope.name else name
        a, b = self.tokens[head].start, self.tokens[end].end
        signature = " ".join(self.source[a : self.tokens[stop].start if head < stop < len(self.tokens) else b].decode("utf-8", "replace").split()) or None
        e = self._entity(kind, qualified, name, a, b, signature, doc, test or self.tests > 0)
        self.entities.append(e)
        key = (self.path, kind, qualified, e["entity_ordinal"])
        parent = next(s.entity for s in reversed(self.scopes) if s.entity)
        definer = next((s.entity for s in reversed(self.scopes) if s.kind == "module" and s.entity), self.file)
        self.relate("contains", parent, qualified, self.tokens[head], self.tokens[end], key, "resolved", ev_class="containment")
        self.relate("defines", definer, qualified, self.tokens[head], self.tokens[end], key, "resolved", ev_class="containment")
        return key

    def doc_before(self, byte: int) -> str | None:
        got = []
        for d in reversed([d for d in self.docs if d.end <= byte and d.text.startswith("///")]):
            if self.source[d.end : byte].strip() == b"" or (got and not self.source[d.end : byte].strip()):
                got.append(d.text[3:].strip())
                byte = d.start
            else:
                break
        return "\n".join(reversed(got)) or None

    @property
    def owner(self) -> tuple:
        return next(s.entity for s in reversed(self.scopes) if s.entity)

    # -- items

    def run(self) -> "Outline":
        self.items(0, len(self.tokens))
        return self

    def items(self, at: int, end: int) -> None:
        while at < end:
            at = max(self.item(at, end), at + 1)

    def _skip_to(self, at: int, end: int, stops) -> int:
        while at < end and not (self.tokens[at].kind == "op" and self.tokens[at].text in stops):
            at = self.match[at] + 1 if at in self.match else at + 1
        return at

    def item(self, at: int, end: int) -> int:
        t = self.tokens
        head, test = at, False
        first = t[at].start
        while at < end and t[at].text == "#":  # attributes
            k = at + (2 if at + 1 < end and t[at + 1].text == "!" else 1)
            if k >= end or k not in self.match:
                return at + 1
            text = self.source[t[k].start : t[self.match[k]].end].decode("utf-8", "replace")
            test = test or "test" in text or "bench" in text
            at = self.match[k] + 1
        doc = self.doc_before(first)
        head = at
        public = False
        while at < end and t[at].text in ("pub", "unsafe", "async", "extern", "default", "const") and not (t[at].text == "const" and at + 1 < end and t[at + 1].text not in ("fn", "unsafe", "async", "extern")):
            public = public or t[at].text == "pub"
            at += 1
            if at < end and t[at].text == "(" and t[at - 1].text == "pub":
                at = self.match[at] + 1
            elif at < end and t[at].kind == "str":
                at += 1
        if at >= end:
            return at
        word = t[at].text
        if word == "use":
            stop = self._skip_to(at, end, ";")
            self.imports(at + 1, stop, public)
            return stop + 1
        if word == "impl":
            return self.impl(head, at, end, doc, test)
        if word == "macro_rules" and at + 2 < end and t[at + 1].text == "!":
            k = self._skip_brackets(at + 3, end)
            self.declare("macro", t[at + 2].text, head, at + 3, min(k, end) - 1, doc, test)
            return k
        if word in ITEMS and at + 1 < end and t[at + 1].kind == "id":
            return self.named(word, head, at, end, doc, test)
        return self.expression(at, end)

    def _skip_brackets(self, at: int, end: int) -> int:
        if at < end and at in self.match:
            at = self.match[at] + 1
            return at + 1 if at < end and self.tokens[at].text == ";" else at
        return at + 1

    def _generics(self, at: int, end: int) -> int:
        """Past ``<...>``."""
        if at < end and self.tokens[at].text == "<":
            depth = 0
            while at < end:
                x = self.tokens[at].text
                if x in OPEN and at in self.match:
                    at = self.match[at]
                depth += (x == "<") - (x == ">")
                at += 1
                if not depth:
                    break
        return at

    def named(self, word: str, head: int, at: int, end: int, doc, test) -> int:
        t = self.tokens
        name = t[at + 1]
        stop = self._skip_to(at + 2, end, ("{", ";"))
        if word in ("const", "static", "type"):
            stop = self._skip_to(at + 2, end, (";",))
        last = min(self.match.get(stop, stop), end - 1) if stop < end else end - 1
        tuple_like = word == "struct" and stop < end and t[stop].text == ";"
        body = stop if stop < end and t[stop].text == "{" else None
        key = self.declare(ITEMS[word], name.text, head, stop, last, doc, test)
        kind = {"fn": "function", "mod": "module", "struct": "type", "enum": "type", "union": "type", "trait": "impl"}.get(word, "block")
        scope = Scope(kind, key[2], key)
        self.tests += test
        self.scopes.append(scope)
        self._type_parameters(at + 2, stop)
        if word == "fn":
            opens = next((k for k in range(at + 2, stop) if t[k].text == "("), None)
            if opens is not None:
                self.parameters(opens, key)
                self.references(self.match[opens] + 1, stop)
            if body is not None:
                self.block(body + 1, last)
        elif word in ("mod", "trait"):
            if word == "trait":
                self.bounds(at + 2, stop, key)
            if body is not None:
                self.items(body + 1, last)
        elif word == "enum" and body is not None:
            self.variants(body + 1, last)
        elif body is not None:
            self.fields(body + 1, last)
        elif tuple_like or word in ("const", "static", "type"):
            self.block(at + 2, last)
        self.scopes.pop()
        self.tests -= test
        return last + 1

    def bounds(self, at: int, stop: int, key: tuple) -> None:
        t = self.tokens
        at = self._generics(at, stop)
        if at < stop and t[at].text == ":":
            for k in range(at + 1, stop):
                if t[k].text == "where":
                    break
                if t[k].kind == "id" and t[k].text not in KEYWORDS and (k + 1 >= stop or t[k + 1].text != "::"):
                    self.relate("inherits", key, t[k].text, t[k])
                    self.relate("references", key, t[k].text, t[k])

    def impl(self, head: int, at: int, end: int, doc, test) -> int:
        t = self.tokens
        stop = self._skip_to(at + 1, end, ("{", ";"))
        k = self._generics(at + 1, stop)
        names: list[list[Token]] = [[]]
        while k < stop and t[k].text != "where":
            if t[k].text == "for":
                names.append([])
            elif t[k].text == "<":
                k = self._generics(k, stop)
                continue
            elif t[k].kind == "id" and t[k].text not in ("dyn", "mut", "const"):
                names[-1].append(t[k])
            k += 1
        subject = names[-1][-1] if names[-1] else t[at]
        last = min(self.match.get(stop, stop), end - 1) if stop < end else end - 1
        key = self.declare("module", subject.text, head, stop, last, doc, test)
        if len(names) > 1 and names[0]:
            self.relate("implements", key, names[0][-1].text, names[0][-1])
        self.scopes.append(Scope("impl", key[2], key))
        self.tests += test
        self.references(at + 1, stop)
        if stop < end and t[stop].text == "{":
            self.items(stop + 1, last)
        self.tests -= test
        self.scopes.pop()
        return last + 1

    def _type_parameters(self, at: int, stop: int) -> None:
        t = self.tokens
        if at < stop and t[at].text == "<":
            end, fresh, k = self._generics(at, stop), True, at + 1
            while k < end - 1:
                if t[k].kind == "id" and fresh and t[k].text not in KEYWORDS:
                    self.declare("type_parameter", t[k].text, k, k + 1, k)
                    fresh = False
                elif t[k].text == "const" and fresh and k + 1 < end:
                    self.declare("parameter", t[k + 1].text, k + 1, k + 2, k + 1)
                    fresh, k = False, k + 1
                elif t[k].text == ",":
                    fresh = True
                elif t[k].kind == "id" and t[k].text not in KEYWORDS:
                    self.relate("references", self.owner, t[k].text, t[k])
                k += 1

    def parameters(self, opens: int, key: tuple) -> None:
        t, close = self.tokens, self.match[opens]
        k = opens + 1
        while k < close:
            stop = self._skip_to(k, close, (",",))
            colon = next((j for j in range(k, stop) if t[j].text == ":" ), None)
            if colon is not None:
                for j in range(k, colon):
                    if t[j].kind == "id" and t[j].text not in KEYWORDS and t[j].text[:1].islower() | t[j].text.startswith("_"):
                        self.declare("parameter", t[j].text, j, j + 1, j)
                        self.scopes[-1].locals.add(t[j].text)
                self.references(colon + 1, stop)
            k = stop + 1

    def fields(self, at: int, end: int) -> None:
        t = self.tokens
        while at < end:
            stop = self._skip_to(at, end, (",",))
            colon = next((j for j in range(at, stop) if t[j].text == ":"), None)
            if colon is not None and colon > at and t[colon - 1].kind == "id":
                self.declare("field", t[colon - 1].text, colon - 1, stop, max(colon - 1, stop - 1), self.doc_before(t[at].start))
                self.references(colon + 1, stop)
            at = stop + 1

    def variants(self, at: int, end: int) -> None:
        t = self.tokens
        while at < end:
            stop = self._skip_to(at, end, (",",))
            k = at
            while k < stop and t[k].text == "#" and k + 1 in self.match:
                k = self.match[k + 1] + 1
            if k < stop and t[k].kind == "id":
                key = self.declare("constant", t[k].text, k, stop, stop - 1, self.doc_before(t[at].start))
                if k + 1 < stop and t[k + 1].text == "{":
                    self.scopes.append(Scope("type", key[2], key))
                    self.fields(k + 2, self.match[k + 1])
                    self.scopes.pop()
                else:
                    self.references(k + 1, stop)
            at = stop + 1

    def imports(self, at: int, stop: int, public: bool) -> None:
        """Flat bindings of a use tree: aliases, nested groups, globs."""
        t = self.tokens

        def tree(k: int, end: int, prefix: list[str]) -> None:
            while k < end:
                part = self._skip_to(k, end, (",",))
                path, j, alias = list(prefix), k, None
                while j < part:
                    x = t[j]
                    if x.text == "{":
                        tree(j + 1, self.match[j], path)
                        path = []
                        break
                    if x.text == "as" and j + 1 < part:
                        alias, j = t[j + 1], j + 1
                    elif x.text == "*" or (x.kind == "id" and alias is None):
                        path.append(x.text)
                    j += 1
                if path and j >= part and part > k:
                    item = path[-1]
                    if item == "self" and len(path) > 1:
                        path.pop()
                        item = path[-1]
                    local = alias.text if alias else item
                    self.relate("imports", self.owner, local, t[k], t[part - 1], ev_class="import_binding", ev_module="::".join(path[:-1]), ev_alias=item if local != item else None,
                                basis="re-export" if public else None)
                k = part + 1

        tree(at, stop, [])

    # -- bodies

    def block(self, at: int, end: int) -> None:
        while at < end:
            x = self.tokens[at]
            if x.text in ("fn", "struct", "enum", "trait", "impl", "use", "mod", "static", "macro_rules", "union", "type", "const") or x.text == "#":
                at = max(self.item(at, end), at + 1)
            else:
                at = max(self.expression(at, end), at + 1)

    def _local(self, name: str) -> bool:
        for s in reversed(self.scopes):
            if name in s.locals:
                return True
            if s.kind in ("file", "module", "impl", "type"):
                return False
        return False

    def expression(self, at: int, end: int) -> int:
        t, x = self.tokens, self.tokens[at]
        if x.text in ("let", "for"):
            stop = at + 1
            close = ("=", ";", "in", ":") if x.text == "let" else ("in", "{")
            names = []
            while stop < end and t[stop].text not in close:
                if t[stop].kind == "id" and t[stop].text not in KEYWORDS and t[stop].text[:1].islower() | t[stop].text.startswith("_") and (stop + 1 >= end or t[stop + 1].text not in ("::", "(", "{")):
                    names.append(t[stop].text)
                elif t[stop].kind == "id" and t[stop].text not in KEYWORDS:
                    self.relate("references", self.owner, t[stop].text, t[stop])
                stop += 1
            # the names are in force behind the statement's end; for a loop, in its body
            if x.text == "let":
                fin = self._skip_to(stop, end, (";",))
                self.block(stop, fin)
                self.scopes[-1].locals.update(names)
                return fin + 1
            self.scopes[-1].locals.update(names)
            return stop
        if x.text == "|" and (at == 0 or t[at - 1].text in ("(", ",", "=", "move", "=>", "{", ";")):
            k = at + 1
            while k < end and t[k].text != "|":
                if t[k].kind == "id" and t[k].text not in KEYWORDS and t[k].text[:1].islower():
                    self.scopes[-1].locals.add(t[k].text)
                k += 1
            return k + 1
        if x.text == "{" and at in self.match:
            self.scopes.append(Scope("block", self.scopes[-1].name, None))
            self.block(at + 1, min(self.match[at], end))
            self.scopes.pop()
            return self.match[at] + 1
        if x.kind == "id" and (x.text not in KEYWORDS or x.text in ("self", "Self", "crate", "super")):
            return self.path_expression(at, end)
        return at + 1

    def path_expression(self, at: int, end: int) -> int:
        """``a::b::c``, a call of it, a macro, or a plain reference."""
        t = self.tokens
        path, k = [t[at]], at + 1
        while k + 1 < end and t[k].text == "::":
            if t[k + 1].text == "<":
                k = self._generics(k + 1, end)
            elif t[k + 1].kind == "id":
                path.append(t[k + 1])
                k += 2
            else:
                break
        last, dotted = path[-1], at > 0 and t[at - 1].text == "."
        if k < end and t[k].text == "!" and k + 1 < end and k + 1 in self.match:  # a macro: its words only
            self.relate("references", self.owner, last.text, last)
            self.references(k + 2, self.match[k + 1])
            return self.match[k + 1] + 1
        if k < end and t[k].text == "(" and last.text not in KEYWORDS:
            if dotted:
                before = t[at - 2] if at >= 2 else None
                simple = before is not None and before.kind == "id" and (at < 3 or t[at - 3].text not in (".", "::"))
                if simple:
                    self.relate("calls", self.owner, last.text, last, ev_class="receiver_type", ev_receiver=before.text)
                else:
                    self.relate("calls", self.owner, last.text, last, state="unresolved", reason="ambiguous")
            elif len(path) > 1:
                self.relate("calls", self.owner, last.text, path[0], last, ev_class="qualified_name_in_scope", ev_scope="::".join(p.text for p in path[:-1]))
            elif self._local(last.text):
                self.relate("calls", self.owner, last.text, last, ev_class="local_binding", reason="local_binding")
            else:
                self.relate("calls", self.owner, last.text, last)
        for n, p in enumerate(path):
            if p.text in KEYWORDS:
                continue
            if n == 0 and len(path) == 1 and self._local(p.text):
                self.relate("references", self.owner, p.text, p, ev_class="local_binding", reason="local_binding", ev_binder=p.text)
            elif n == 0 or len(path) == 1:
                if not dotted:
                    self.relate("references", self.owner, p.text, p)
            else:
                self.relate("references", self.owner, p.text, p, ev_class="qualified_name_in_scope", ev_scope="::".join(q.text for q in path[:n]))
        return k

    def references(self, at: int, stop: int) -> None:
        for k in range(at, min(stop, len(self.tokens))):
            x = self.tokens[k]
            if x.kind == "id" and x.text not in KEYWORDS and not (k and self.tokens[k - 1].text == "."):
                self.relate("references", self.owner, x.text, x, **({"ev_class": "local_binding", "reason": "local_binding"} if self._local(x.text) else {}))


def outline(path: str, source: str) -> tuple[list[dict], list[dict], dict]:
    """(entities, relations, quality) of one file."""
    o = Outline(path, source).run()
    seen, relations = set(), []
    for r in o.relations:
        key = tuple(r[c] for c in V.RELATION_KEY)
        if key not in seen:
            seen.add(key)
            relations.append(r)
    return o.entities, relations, {"path": path, "defects": len(o.bad), "first_defect": min(o.bad) if o.bad else None}


def validate_rules() -> list[str]:
    """What is wrong with the rule table: kinds must exist, with a suggestion when close."""
    import difflib

    return [f"{word}: unknown kind {kind!r}" + (f", perhaps {m[0]!r}" if (m := difflib.get_close_matches(kind, V.ENTITY_KINDS, 1)) else "") for word, kind in ITEMS.items() if kind not in V.KIND_ORD]
