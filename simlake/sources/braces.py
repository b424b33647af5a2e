"""Units of languages with braces (and Ruby's ``end``) from their text: headers, blocks and tokens, no grammar."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

_BLANKED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])'""", re.S)
_SHELL_BLANKED = re.compile(r"""(?:^|(?<=\s))#[^\n]*|"(?:\\.|[^"\\])*"?|'[^']*'?""", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_TOKEN = re.compile(r"""\w+|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\s\w]""")
_SCOPE = re.compile(r"\b(class|struct|impl|trait|interface|enum|namespace|module|mod|object|union)\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)[^()]*$")
_FUNCTION = re.compile(r"(?<![.\w])(?!(?:func|function|fn)\b)([A-Za-z_~]\w*)\s*(?:<[^<>{}]*>)?\s*\((?:[^(){}]|\([^(){}]*\))*\)\s*([^(){};=]|=>|->|\([^(){}]*\))*$")
_RECEIVER = re.compile(r"\bfunc\s*\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*\w+")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^{}]*\)|\w+)\s*(?::[^={}]*)?=>\s*$")
# fixed values: words that open a block but name no function
_CONTROL = set("if for while switch catch with match else do try loop unless until return synchronized using lock select case foreach elif finally unsafe new defer go sizeof".split())


#: Characters before a brace that are looked at.
HEADER = 2000


def _blank(source: str, pattern: re.Pattern) -> str:
    """Comments and strings as blanks, so that positions stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _unit(source: str, ends: tuple[int, int], inner: str, name: str, scope: list[str], method: bool, bytes_at, lines: list[int]) -> dict:
    tokens = _TOKEN.findall(_COMMENT.sub(" ", inner))
    body = " ".join(tokens)
    return {
        "kind": "method" if method else "function", "name": name, "scope": ".".join(scope) or None, "start_byte": bytes_at(ends[0]), "end_byte": bytes_at(ends[1]), "start_line": bisect_right(lines, ends[0]),
        "end_line": bisect_right(lines, ends[1] - 1), "body_node_count": len(tokens), "body_hash": hashlib.sha256(body.encode()).hexdigest(), "display_source": source[ends[0] : ends[1]], "implementation": body,
    }


def _places(source: str):
    lines = [0, *(m.end() for m in re.finditer("\n", source))]
    if source.isascii():
        return (lambda at: at), lines
    # bytes before each line, so that a position costs its line only
    before = [0]
    for a, b in zip(lines, lines[1:], strict=False):
        before.append(before[-1] + len(source[a:b].encode()))
    return (lambda at: before[(i := bisect_right(lines, at) - 1)] + len(source[lines[i] : at].encode())), lines


def brace_units(source: str, least: int, most: int, shell: bool = False) -> Iterator[dict]:
    """Functions and methods with braces; their size is the number of tokens of the body."""
    plain = _blank(source, _SHELL_BLANKED if shell else _BLANKED)
    bytes_at, lines = _places(source)
    open_: list[tuple[int, int, str | None, str | None, int, int]] = []  # header, brace, function, scope, and parentheses and header to go on with
    start = depth = 0
    for m in re.finditer(r"[{};()]", plain):
        at = m.start()
        if m[0] in "()":
            depth = max(0, depth + (1 if m[0] == "(" else -1))
        elif m[0] == "{":
            # what a header's own parameters hold in braces is part of it
            header = re.sub("[{}]", " ", plain[max(start, at - HEADER) : at])
            function = scope = None
            if not depth and (found := _SCOPE.search(header)):
                scope = found[2]
            elif not depth and (found := _ARROW.search(header) or _FUNCTION.search(header)):
                opens = re.match(r"\W*(\w+)", header)
                function = found[1] if found[1] not in _CONTROL and not (opens and opens[1] in _CONTROL) else None
                if function and (owner := _RECEIVER.search(header)):
                    scope = owner[1]
            # the unit begins with the line of its name, as lines need no mark at their end
            line = header.rfind("\n", 0, found.start()) + 1 if function else 0
            open_.append((at - len(header[line:].lstrip()), at, function, scope, depth, start if depth else -1))
            start, depth = at + 1, 0
        elif m[0] == "}":
            if open_:
                first, brace, function, own, depth, start = open_.pop()
                if function:
                    around = [s for _, _, f, s, _, _ in open_ if s and not f]
                    unit = _unit(source, (first, at + 1), source[brace + 1 : at], function, around + ([own] if own else []), bool(around or own), bytes_at, lines)
                    if unit["body_node_count"] >= least and len(unit["display_source"]) <= most:
                        yield unit
                start = at + 1 if start < 0 else start
        elif not depth:
            start = at + 1


def ruby_units(source: str, least: int, most: int) -> Iterator[dict]:
    """Methods from ``def`` to the ``end`` of the same indentation, within classes and modules."""
    bytes_at, lines = _places(source)
    scopes: list[tuple[int, str]] = []
    for m in re.finditer(r"^([ \t]*)(def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", source, re.M):
        indent = len(m[1])
        scopes = [s for s in scopes if s[0] < indent]
        if m[2] != "def":
            scopes.append((indent, m[3]))
            continue
        close = re.compile(rf"^{re.escape(m[1])}end\b", re.M).search(source, m.end())
        head = source.find("\n", m.end())
        if close and 0 <= head < close.start():
            unit = _unit(source, (m.start(2), close.end()), re.sub(r"(?m)#.*$", "", source[head : close.start()]), m[3], [s for _, s in scopes], bool(scopes), bytes_at, lines)
            if unit["body_node_count"] >= least and len(unit["display_source"]) <= most:
                yield unit
