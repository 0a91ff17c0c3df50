"""Chunks of C# sources along types and members: a linear lexer and a stack of scopes.

The lexer skips comments, directives, characters and every form of string, so braces in them are text. The scan then reads a
scope's members one after another; it looks into namespaces and types and passes over the bodies of all else."""

from __future__ import annotations

import re

_INTERPOLATED = re.compile(r'\$+@?(?="{3,})|(?:\$@|@\$|\$)(?=")')
_TOKEN = re.compile(r"""
    (?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#[^\n]*)
  | (?P<text>@"(?:[^"]|"")*(?:"|\Z)|(?P<raw>"{3,}).*?(?:(?P=raw)(?!")|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.[^'\n]*|[^'\\\n])(?:'|$))
  | (?P<name>@?[^\W\d]\w*) | (?P<number>\d\w*(?:\.\d\w*)?) | (?P<mark>=>|==|!=|<=|>=|.)
""", re.X | re.S | re.M)  # fmt: skip
_REST_OF_LINE = re.compile(r"(?:[ \t]+|//[^\n]*|/\*[^\n]*?\*/)*\r?\n?")
_OPEN, _CLOSE = {"{", "(", "["}, {"}", ")", "]"}
# fixed values: words of the language
_TYPES = ("class", "struct", "interface", "record", "enum")
_MODIFIERS = frozenset("public private protected internal static abstract sealed partial readonly ref unsafe new file required async override virtual extern const volatile fixed scoped".split())


def _interpolated(source: str, at: int) -> int:
    """The end of the interpolated string at ``at``. Holes hold code, with strings of its own."""
    i = source.index('"', at)
    marks, verbatim = source[at:i].count("$"), "@" in source[at:i]
    quotes = len(re.compile('"+').match(source, i)[0])
    raw = quotes >= 3
    close = '"' * quotes if raw else '"'
    if not raw and quotes == 2 and not verbatim:
        return i + 2
    i += quotes if raw else 1
    hole = marks if raw else 1
    while i < len(source):
        c = source[i]
        if c == "\\" and not raw and not verbatim:
            i += 2
        elif c == '"':
            if source.startswith(close, i):
                if verbatim and not raw and source.startswith('""', i):
                    i += 2
                    continue
                return i + len(close)
            i += 1
        elif c == "{":
            run = len(re.compile(r"\{+").match(source, i)[0])
            if run < hole or (not raw and run % 2 == 0):
                i += run
                continue
            i = _hole(source, i + run, hole)
        elif c == "\n" and not raw and not verbatim:
            return i
        else:
            i += 1
    return len(source)


def _hole(source: str, at: int, marks: int) -> int:
    depth = 0
    for kind, text, a, z in tokens(source, at):
        if kind == "mark":
            if text in _OPEN:
                depth += 1
            elif text == "}" and depth == 0:
                return a + marks
            elif text in _CLOSE:
                depth -= 1
    return len(source)


def tokens(source: str, at: int = 0):
    """(kind, text, start, end) of names, numbers, strings and marks."""
    while at < len(source):
        if source[at] in "$@" and _INTERPOLATED.match(source, at):
            end = _interpolated(source, at)
            yield "text", "", at, end
            at = end
            continue
        m = _TOKEN.match(source, at)
        if m.lastgroup != "skip" and m["skip"] is None:
            kind = "text" if m["text"] is not None else m.lastgroup
            yield kind, m[0], m.start(), m.end()
        at = m.end()


class _Scope:
    def __init__(self, kind: str, label: str, start: int):
        self.kind, self.label, self.start = kind, label, start


def _declared(head: list[tuple[str, str]]) -> tuple[str, str] | None:
    """(kind, label) of a member by what stands before its body: namespace, type, method or None. ``head`` has no attributes;
    what stands in brackets is one mark."""
    words = [t for _, t in head]
    i = 0
    while i < len(words) and words[i] in _MODIFIERS:
        i += 1
    if i < len(words) and words[i] == "namespace":
        return "namespace", "".join(words[i + 1 :])
    if i < len(words) and words[i] in _TYPES and i + 1 < len(words) and head[i + 1][0] == "name":
        named, keyword = i + 1, words[i]
        if keyword == "record" and words[named] in ("class", "struct") and named + 1 < len(words):
            keyword, named = f"record {words[named]}", named + 1
        return "type", " ".join([*words[:i], keyword, words[named]])
    if "delegate" in words[i : i + 1] or "event" in words[i : i + 1]:
        return None
    if "operator" in words and "()" in words:
        return "method", ""
    for j, t in enumerate(words):
        if t == "()" and j:
            k = j - 1
            if words[k] == ">":  # a generic name
                depth = 0
                while k >= 0:
                    depth += (words[k] == ">") - (words[k] == "<")
                    if not depth:
                        break
                    k -= 1
                k -= 1
            if k >= 0 and head[k][0] == "name" and words[k] not in _MODIFIERS:
                return "method", ""
    return None


def members(source: str) -> tuple[list[str], list[tuple[int, int, str, list[str]]]]:
    """(using directives, members): each type, method, constructor and operator as (start, end, namespace, enclosing types), by
    start. Spans take the comments before a member and the rest of its last line."""
    after = lambda z: _REST_OF_LINE.match(source, z).end()
    usings: list[str] = []
    found: list[tuple[int, int, str, list[str]]] = []
    scopes, space = [_Scope("file", "", 0)], ""
    stream = list(tokens(source))
    i, start = 0, 0

    def passed(i: int) -> int:
        """The place after the bracket that closes the one at ``i``."""
        depth = 0
        while i < len(stream):
            kind, text, _, _ = stream[i]
            if kind == "mark":
                depth += (text in _OPEN) - (text in _CLOSE)
                if not depth:
                    return i + 1
            i += 1
        return i

    def spaces() -> str:
        return next((s.label for s in reversed(scopes) if s.kind == "namespace"), space)

    def close() -> None:
        nonlocal start
        scope = scopes.pop()
        start = after(stream[i - 1][3]) if i else 0
        if scope.kind == "type":
            found.append((scope.start, start, spaces(), [s.label for s in scopes if s.kind == "type"]))

    def ended(a: int, z: int, kind: str | None) -> None:
        nonlocal start
        start = after(z)
        if kind in ("type", "method"):
            found.append((a, start, spaces(), [s.label for s in scopes if s.kind == "type"]))

    while i < len(stream):
        kind, text, a, z = stream[i]
        if kind == "mark" and text == "}":
            i += 1
            if len(scopes) > 1:
                close()
            else:
                start = after(z)
            continue
        if kind == "mark" and text == ";":
            i, start = i + 1, after(z)
            continue
        # a member: what stands before its body, in which brackets are passed over
        begin, head, first, what = start, [], i, ""
        while i < len(stream):
            kind, text, a, z = stream[i]
            if kind == "mark" and text in ("{", ";", "}", "=>", "="):
                what = text
                if text == "=" and any(t == "operator" for _, t in head) and not any(t == "()" for _, t in head):
                    what, i = "", i + 1
                    continue
                break
            if kind == "mark" and text in ("(", "["):
                i = passed(i)
                if text == "(":
                    head.append(("mark", "()"))
                elif head:
                    head.append(("mark", "[]"))
                continue
            head.append((kind, text))
            i += 1
        said = _declared(head) if what != "=" else None
        inside = scopes[-1].kind == "type"
        if head and head[0][1] == "using" or len(head) > 1 and [t for _, t in head[:2]] == ["global", "using"]:
            while i < len(stream) and stream[i][1] != ";":
                i += 1
            if not inside and i < len(stream) and not any(t == "()" for _, t in head):
                usings.append(source[stream[first][2] : stream[i][3]])
                i += 1
                ended(begin, stream[i - 1][3], None)
            continue
        if said and said[0] == "method" and not inside:
            said = None
        if what == "{" and said and said[0] in ("namespace", "type") and "enum" not in said[1].split()[:-1]:
            scopes.append(_Scope(said[0], said[1], begin))
            i += 1
            start = after(stream[i - 1][3])
            continue
        if what == ";" and said and said[0] == "namespace":
            space = said[1]
            i += 1
            ended(begin, stream[i - 1][3], None)
            continue
        if what == "{":
            i = passed(i)
            if i < len(stream) and stream[i][1] == "=" and not said:  # a property's first value
                what = "="
        if what in ("=", "=>"):
            while i < len(stream) and stream[i][1] not in (";", "}"):
                i = passed(i) if stream[i][1] in _OPEN else i + 1
        if what != "{" and i < len(stream) and stream[i][1] == ";":
            i += 1
        ended(begin, stream[i - 1][3] if i else 0, said and said[0])
    while len(scopes) > 1:
        close()
    return usings, sorted(found, key=lambda m: (m[0], -m[1]))


def spans(source: str, between: str = "\n\n") -> list[tuple[int, int, str]]:
    """(start, end, chunk): each member under the file's using directives, its namespace and its enclosing types, ``between``
    these and its own text, which is trimmed. A file without members is one chunk, a blank one none."""
    if not source.strip():
        return []
    usings, found = members(source)
    out = []
    for a, z, space, types in found:
        context = "\n".join([*usings, *([f"namespace {space};"] if space else []), *types])
        body = source[a:z].strip()
        out.append((a, z, f"{context}{between}{body}" if context else body))
    return out or [(0, len(source), source)]
