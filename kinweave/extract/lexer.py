"""Source texts cut into tokens, with a stack of modes instead of nested patterns.

A scanner goes through a text once. It knows what it is in: code, a template, a
tag, or the text between tags; an opening sign pushes a mode and its closing
sign pops it, so nesting has no limit. Code inside a template or between tags is
read like any other; it appears between parentheses, its parts apart by ``;``,
and the text around it only moves the line on.

Type arguments and attributes are found by running depth: in one pass over a
stretch of brackets each opener is paired with the first closer at its depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

UNCLOSED = ""  # a token that stands where a template or a tag does not close
Token = tuple[str, int, int]  # text, line, last line

_BLANK = " \t\n\x0b\f\r"
_SPACE = re.compile(r"[ \t\n\x0b\f\r]*")
_STRING = r'"(?:[^"\\\n]++|\\(?s:.))*+"' + "|" + r"'(?:[^'\\\n]++|\\(?s:.))*+'"


class Tokens:
    """The tokens of a text in order; knows the line and the last token that is no comment."""

    def __init__(self) -> None:
        self.out: list[Token] = []
        self.line, self.last = 1, ""

    def skip(self, text: str) -> None:
        self.line += text.count("\n")

    def add(self, token: str) -> None:
        ends = self.line + token.count("\n")
        self.out.append((token, self.line, ends))
        self.line, self.last = ends, token


class Closers:
    """Closing angle brackets of type arguments, by the place of the opening one."""

    _SIGN = re.compile(r"[<>(){};]|=>|=")

    def __init__(self, text: str) -> None:
        self.text, self.read_to, self.found = text, 0, {}

    def after(self, opening: int) -> int | None:
        """The end of the type arguments that start at ``opening``; None if they do not close."""
        if opening >= self.read_to:
            self._read(opening)
        return self.found.get(opening)

    def _read(self, start: int) -> None:
        waiting: list[int] = []
        for m in self._SIGN.finditer(self.text, start):
            sign = m[0]
            if sign == "<":
                waiting.append(m.start())
            elif sign == ">":
                if waiting:
                    self.found[waiting.pop()] = m.end()
                if not waiting:
                    self.read_to = m.end()
                    return
            elif sign != "=":  # nothing of a type: what waits never closes
                self.read_to = m.start()
                return
        self.read_to = len(self.text)


# After these tokens an operand may start.
_BEFORE_OPERAND = frozenset(
    "=> ?? && || ( [ , = : ; ! & | ? { } + - * ~ % ^ <".split()
    + ["", "return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "await", "yield", "default"]
)
_LITERAL = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_USED = re.compile(r"[ \t\n\x0b\f\r]*\.[ \t\n\x0b\f\r]*(?:test|exec|source)\b")
_COMMENT = re.compile(r"/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*")
_CODE = re.compile(
    "|".join(
        [
            r"#?(?:[^\W\d]|\$)[\w$]*+",
            _STRING,
            r"\[[\w$.]+\](?=[ \t\n\x0b\f\r]*[(<])",  # computed member name
            r"[0-9][\w.]*+",
            r"=>|\?\.(?![0-9])|\.\.\.|\?\?|&&|\|\||(?s:.)",
        ]
    )
)
_MODAL = "/`<{}"  # what can begin other than a plain token of code, or counts for its mode
_TEXT = re.compile(r"[^<{]*+")
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{)|\\\Z)*+")
_TAG_STARTS = re.compile(r"<(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*\s*(?:,|extends\s))")
_TAG_NAME = re.compile(r"[\w$.:-]*+")
_IN_TAG = re.compile(r"[^{<>/\"']++|\"[^\"]*\"|'[^']*'|/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*|/(?!>)")


def typescript_tokens(text: str, tags: bool = False) -> list[Token]:
    """The tokens of TypeScript code without comments; ``tags`` for sources that hold tags (TSX)."""
    tokens, closers = Tokens(), Closers(text)
    # of each open mode its name, and for code the number of its open braces
    modes: list[list] = [["code", 0]]
    at = 0

    def enclose() -> None:
        for token in ("(", '""', ";"):
            tokens.add(token)

    def leave() -> None:
        """Back in the mode around a finished template or element."""
        modes.pop()
        if modes[-1][0] == "code":
            tokens.add(")")

    while at < len(text):
        mode = modes[-1]
        start = at
        if mode[0] == "template":
            at = _TEMPLATE_TEXT.match(text, at).end()
            tokens.skip(text[start:at])
            if text.startswith("${", at):
                tokens.add(";")
                tokens.last = "{"
                modes.append(["code", 0])
                at += 2
            elif at < len(text):  # the closing backtick
                leave()
                at += 1
        elif mode[0] == "text":
            found = _TEXT.match(text, at).end()
            tokens.skip(text[at:found])
            at = found
            if text.startswith("{", at):
                tokens.add(";")
                tokens.last = "{"
                modes.append(["code", 0])
                at += 1
            elif text.startswith("</", at):
                closing = text.find(">", at)
                closing = len(text) if closing < 0 else closing + 1
                tokens.skip(text[at:closing])
                at = closing
                leave()
            elif at < len(text):
                at = _TAG_NAME.match(text, at + 1).end()
                modes.append(["tag", 0])
        elif mode[0] == "tag":
            if (m := _IN_TAG.match(text, at)) is not None:
                tokens.skip(m[0])
                at = m.end()
            elif text[at] == "{":
                tokens.add(";")
                tokens.last = "{"
                modes.append(["code", 0])
                at += 1
            elif text[at] == ">":
                mode[0] = "text"
                at += 1
            elif text.startswith("/>", at):
                at += 2
                leave()
            elif text[at] == "<" and text[at - 1] != "=" and (end := closers.after(at)) is not None:
                tokens.skip(text[at:end])  # type arguments of the element
                at = end
            elif text[at] == "<":  # an element as a value
                at = _TAG_NAME.match(text, at + 1).end()
                modes.append(["tag", 0])
            else:
                at += 1
        else:
            sign = text[at]
            if sign in _BLANK:
                at = _SPACE.match(text, at).end()
                tokens.skip(text[start:at])
                if at == len(text):
                    break
                sign = text[at]
            if sign not in _MODAL:
                m = _CODE.match(text, at)
                tokens.add(m[0])
                at = m.end()
                continue
            operand = tokens.last in _BEFORE_OPERAND
            if sign == "/" and (m := _COMMENT.match(text, at)) is not None:
                tokens.skip(m[0])
                at = m.end()
            elif sign == "`":
                enclose()
                modes.append(["template", 0])
                at += 1
            elif sign == "/" and (m := _LITERAL.match(text, at)) is not None and (
                operand or (tokens.last == ")" and _USED.match(text, m.end()) is not None)
            ):
                tokens.add(m[0])
                at = m.end()
            elif sign == "<" and tags and operand and (m := _TAG_STARTS.match(text, at)) is not None:
                enclose()
                modes.append(["tag", 0])
                at = _TAG_NAME.match(text, at + 1).end()
            elif sign == "<" and at and (text[at - 1].isalnum() or text[at - 1] in "_$") and (end := closers.after(at)) is not None:
                tokens.add(text[at:end])
                at = end
            elif sign == "}" and mode[1] == 0 and len(modes) > 1:
                modes.pop()
                tokens.add(";")
                at += 1
            else:
                mode[1] += (sign == "{") - (sign == "}")
                m = _CODE.match(text, at)
                tokens.add(m[0])
                at = m.end()
    for _ in modes[1:]:
        tokens.add(UNCLOSED)
    return tokens.out


_NAME = r"(?:[^\W\d])\w*+"
_PHP_TEXT = re.compile(r"(?s:.*?)(?:<\?(?:php\b|=)|\Z)")
_PHP_COMMENT = re.compile(r"/\*(?s:.*?)(?:\*/|\Z)|//(?:(?!\?>)[^\n])*+|#(?!\[)(?:(?!\?>)[^\n])*+")
_PHP_STRING = r'"(?:[^"\\]++|\\(?s:.))*+"' + "|" + r"'(?:[^'\\]++|\\(?s:.))*+'"
_PHP_CODE = re.compile(
    "|".join(
        [
            r"""<<<[ \t]*(['"]?)(\w+)\1\n(?s:.*?)\n?[ \t]*\2\b""",  # heredoc, nowdoc
            _PHP_STRING,
            r"`(?:[^`\\]++|\\(?s:.))*+`",
            r"\$" + _NAME,
            rf"\\?{_NAME}(?:\\{_NAME})*+",
            r"[0-9][\w.]*+",
            r"\?->|->|::|=>|(?s:.)",
        ]
    )
)
_PHP_BRACKETS = re.compile(rf"{_PHP_STRING}|/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*|#(?!\[)[^\n]*|[\[\]]")


def _attribute_end(text: str, at: int) -> int:
    """The end of the attribute at ``at``, the rest of the text if it does not close."""
    depth = 0
    for m in _PHP_BRACKETS.finditer(text, at + 1):
        depth += (m[0] == "[") - (m[0] == "]")
        if not depth:
            return m.end()
    return len(text)


def php_tokens(text: str) -> list[Token]:
    """The tokens of PHP code without comments; text outside of it is one ``;``."""
    tokens = Tokens()
    at = _PHP_TEXT.match(text).end()
    if at:
        ends = 1 + text.count("\n", 0, at)
        tokens.out.append((";", 1, ends))
        tokens.line = ends
    while at < len(text):
        if text[at] in _BLANK:
            start = at
            at = _SPACE.match(text, at).end()
            tokens.skip(text[start:at])
            if at == len(text):
                break
        if text[at] not in "?/#":
            m = _PHP_CODE.match(text, at)
            end = m.end()
            tokens.add(m[0])
        elif text.startswith("?>", at):
            end = _PHP_TEXT.match(text, at + 2).end()
            line = tokens.line
            tokens.skip(text[at:end])
            tokens.out.append((";", line, tokens.line))
        elif (m := _PHP_COMMENT.match(text, at)) is not None:
            end = m.end()
            tokens.skip(m[0])
        elif text.startswith("#[", at):
            end = _attribute_end(text, at)
            tokens.add(text[at:end])
        else:
            m = _PHP_CODE.match(text, at)
            end = m.end()
            tokens.add(m[0])
        at = end
    return tokens.out


_MOVES = {"{": (1, 0), "}": (-1, 0), "(": (0, 1), "[": (0, 1), ")": (0, -1), "]": (0, -1)}


def with_depths(tokens: list[Token]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """Tokens with the braces and the parentheses or brackets open before each, and whether it starts a line."""
    depth = parens = 0
    ended = 0
    for token, line, ends in tokens:
        yield token, line, ends, depth, parens, ended < line
        if token in _MOVES:
            braces, others = _MOVES[token]
            depth += braces
            parens += others
        ended = ends
