"""Declarations of brace languages: a tokeniser with modes, brackets matched with recovery, and descent through the groups.

Nothing raises and every file is read to its end: a closing bracket without its own is
left aside, one that closes an outer group ends the inner ones, and what is no
declaration is skipped to the end of its statement or member.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Token:
    """kind: name, number, text (strings, templates, regular expressions, text of markup) or a mark, which is its own kind."""

    kind: str
    text: str
    at: int
    end: int


_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_LINE_COMMENT = re.compile(r"//[^\n]*")
_STRING = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*{q}?") for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_MARKUP = re.compile(r"<(?:>|[A-Za-z_][\w.:-]*)")
_MARKUP_TEXT = re.compile(r"[^<{]+")
_RUST_TEXT = re.compile(r"""b?r(#*)"[\s\S]*?"\1|b?"(?:\\[\s\S]|[^"\\])*"?|b?'(?:\\[^\n']*|[^\\'\n])'""")
_LIFETIME = re.compile(r"'[^\W\d]\w*")
#: Names after which an expression begins, so that a slash opens a regular expression and "<" markup.
_BEFORE_VALUE = frozenset("return typeof case in of new delete void throw await yield default else do instanceof".split())


def _comment_end(source: str, at: int, nested: bool) -> int:
    """Where the block comment that starts at ``at`` ends; Rust's may hold others."""
    depth, at = 1, at + 2
    while depth:
        end = source.find("*/", at)
        if end < 0:
            return len(source)
        inner = source.find("/*", at, end) if nested else -1
        depth, at = (depth + 1, inner + 2) if inner >= 0 else (depth - 1, end + 2)
    return at


def rust_tokens(source: str) -> Iterator[Token]:
    at = 0
    while at < len(source):
        if m := _SPACE.match(source, at) or _LINE_COMMENT.match(source, at):
            at = m.end()
            continue
        if source.startswith("/*", at):
            at = _comment_end(source, at, True)
            continue
        for kind, pattern in (("text", _RUST_TEXT), ("lifetime", _LIFETIME), ("name", _NAME), ("number", _NUMBER)):
            if m := pattern.match(source, at):
                break
        else:
            kind, m = source[at], None
        end = m.end() if m else at + 1
        yield Token(kind, source[at:end], at, end)
        at = end


def script_tokens(source: str) -> Iterator[Token]:
    """Tokens of JavaScript and TypeScript with markup. The modes on the stack say what a closing brace or the end of a tag goes back to."""
    at, last = 0, None
    modes: list[str] = []  # brace, template, tag (inside a start tag), markup (between tags)

    def value_next() -> bool:
        return last is None or (last.text in _BEFORE_VALUE if last.kind == "name" else last.kind not in ("number", "text", ")", "]"))

    while at < len(source):
        mode = modes[-1] if modes else ""
        if mode == "markup":
            if m := _MARKUP_TEXT.match(source, at):
                at = m.end()
                continue
            if source.startswith("</", at):
                end = source.find(">", at)
                at = end + 1 if end >= 0 else len(source)
                modes.pop()
                last = Token("text", "", at, at)
                continue
            if source[at] == "<":
                m = _MARKUP.match(source, at)
                at = m.end() if m else at + 1
                if m:
                    modes.append("markup" if m[0] == "<>" else "tag")
                continue
        elif mode == "template":
            at = _TEMPLATE.match(source, at).end()
            if source.startswith("${", at):
                modes.append("brace")
                last = Token("{", "{", at + 1, at + 2)
                yield last
                at += 2
            else:
                modes.pop()
                last = Token("text", "", at, at + 1)
                at += 1
            continue
        if m := _SPACE.match(source, at):
            at = m.end()
            continue
        if mode == "tag":
            if source.startswith("/>", at):
                modes.pop()
                at += 2
                last = Token("text", "", at, at)
                continue
            if source[at] == ">":
                modes[-1] = "markup"
                at += 1
                continue
        if m := _LINE_COMMENT.match(source, at):
            at = m.end()
            continue
        if source.startswith("/*", at):
            at = _comment_end(source, at, False)
            continue
        mark = source[at]
        if mark == "`":
            modes.append("template")
            at += 1
            continue
        if mark == "<" and mode != "tag" and value_next() and (last is None or last.kind != "name" or last.text in _BEFORE_VALUE) and (m := _MARKUP.match(source, at)) and not re.compile(r"<\w+(?:\s+extends\b|\s*,|\s*>\s*\()").match(source, at):
            modes.append("markup" if m[0] == "<>" else "tag")
            at = m.end()
            continue
        if mark in "\"'":
            # a tag's values have no escapes and may go on over lines
            end = (source.find(mark, at + 1) + 1 or len(source)) if mode == "tag" else _STRING[mark].match(source, at).end()
            kind = "text"
        elif mark == "/" and value_next() and (m := _REGEX.match(source, at)):
            kind, end = "text", m.end()
        elif m := _NAME.match(source, at):
            kind, end = "name", m.end()
        elif m := _NUMBER.match(source, at):
            kind, end = "number", m.end()
        elif source.startswith("=>", at):
            kind, end = "=>", at + 2
        else:
            kind, end = mark, at + 1
            if mark == "{":
                modes.append("brace")
            elif mark == "}" and "brace" in modes:
                while modes.pop() != "brace":
                    pass
        last = Token(kind, source[at:end], at, end)
        yield last
        at = end


_OPENS = {"(": ")", "[": "]", "{": "}"}


def matched(tokens: list[Token], indents: list[int] | None = None) -> tuple[dict[int, int], dict[int, int], bool]:
    """The closing bracket of each opening one, by place; where the groups end that have none of their own but lie in one that ends; and whether all have their own.

    With ``indents`` (of the line of each token; -1 - indent for a token that begins its line), a closing brace that begins a
    line ends all groups of lines that are indented more than it.
    """
    out: dict[int, int] = {}
    ended: dict[int, int] = {}
    stack: list[int] = []
    waiting = dict.fromkeys(_OPENS.values(), 0)
    clean = True
    for k, t in enumerate(tokens):
        if t.kind in _OPENS:
            stack.append(k)
            waiting[_OPENS[t.kind]] += 1
        elif t.kind in waiting:
            if indents and t.kind == "}" and indents[k] < 0:
                while stack and abs(indents[stack[-1]] + (indents[stack[-1]] < 0)) > -1 - indents[k]:
                    ended[stack[-1]] = k
                    waiting[_OPENS[tokens[stack.pop()].kind]] -= 1
            clean &= bool(stack) and _OPENS[tokens[stack[-1]].kind] == t.kind
            while waiting[t.kind]:
                opened = stack.pop()
                closer = _OPENS[tokens[opened].kind]
                waiting[closer] -= 1
                if closer == t.kind:
                    out[opened] = k
                    break
                ended[opened] = k
    return out, ended, clean and not stack


class Parser:
    """Declarations of one file. ``found`` has (kind, name, first token, last token)."""

    def __init__(self, source: str, tokens: list[Token]) -> None:
        self.tokens = tokens
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.close, ended, clean = matched(tokens)
        if not clean:
            self.close, ended, _ = matched(tokens, self.indents())
        self.ends = ended | self.close
        self.found: list[tuple[str, str | None, int, int]] = []

    def indents(self) -> list[int]:
        out, before, indent = [], -1, 0
        for t in self.tokens:
            line = self.line(t.at)
            indent = t.at - self.starts[line] if line != before else indent
            out.append(-1 - indent if line != before else indent)
            before = line
        return out

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def word(self, k: int) -> str:
        return self.tokens[k].text if self.kind(k) == "name" else ""

    def new_line(self, k: int) -> bool:
        return k > 0 and self.line(self.tokens[k - 1].at) < self.line(self.tokens[k].at)

    def past(self, k: int) -> int:
        """The place after token k, or after the group that it opens."""
        return self.close.get(k, k) + 1

    def past_generics(self, k: int) -> int:
        """The place after <...>, if it begins at k; k if it isn't closed before the statement ends."""
        if self.kind(k) != "<":
            return k
        depth, n = 0, k
        while n < min(len(self.tokens), k + MOST_GENERIC) and self.kind(n) not in (";", "}"):
            if self.kind(n) == "<":
                depth += 1
            elif self.kind(n) == ">" and self.kind(n - 1) not in ("=", "-"):
                depth -= 1
                if not depth:
                    return n + 1
            n = self.past(n)
        return k

    def until(self, k: int, stops: tuple[str, ...]) -> int:
        """The first token at this depth, from k on, that is one of ``stops`` or ends the group."""
        while k < len(self.tokens) and self.kind(k) not in stops and self.kind(k) not in (")", "]", "}"):
            k = self.past(k)
        return k


_RUST_KINDS = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "impl": "impl_item", "trait": "trait_item", "mod": "mod_item"}
_RUST_LEADS = frozenset("pub default const async unsafe extern".split())


class RustParser(Parser):
    def parse(self) -> list[tuple[str, str | None, int, int]]:
        k, first = 0, -1  # first: where the qualifiers of an item begin
        while k < len(self.tokens):
            word = self.word(k)
            if self.kind(k + 1) == "!" and word and self.kind(j := k + 2 + (self.kind(k + 2) == "name")) in _OPENS:
                k, first = self.past(j), -1  # what a macro is given is no item
            elif word in _RUST_LEADS or (first >= 0 and self.kind(k) == "text"):
                first = k if first < 0 else first
                k = self.past(k + 1) if word == "pub" and self.kind(k + 1) == "(" else k + 1
            elif word in _RUST_KINDS and (word == "impl" or self.kind(k + 1) == "name") and self.kind(k - 1) not in (".", ":", "&", ">", ",", "(", "="):
                k = self.item(word, first if first >= 0 else k, k)
                first = -1
            else:
                k, first = k + 1, -1
        return self.found

    def item(self, word: str, first: int, k: int) -> int:
        name = self.word(k + 1) if word != "impl" else self.implemented(k + 1)
        n = k + 1
        while n < len(self.tokens) and self.kind(n) not in ("{", ";", "}", ")"):
            n = max(self.past_generics(n), self.past(n))
        body = self.kind(n) == "{"
        if (body and n in self.close) or (self.kind(n) == ";" and word in ("struct", "mod")):
            self.found.append((_RUST_KINDS[word], name, first, self.close[n] if body else n))
        return n + 1

    def implemented(self, k: int) -> str | None:
        """The first plain type of an impl: one without path, generics or reference."""
        k = self.past_generics(k)
        while k < len(self.tokens) and self.kind(k) not in ("{", ";", "}") and self.word(k) != "where":
            if self.kind(k) == "name" and self.word(k) not in ("for", "dyn", "const", "mut", "unsafe"):
                end, plain = k + 1, True
                while True:
                    if self.kind(end) == ":" == self.kind(end + 1):
                        plain, end = False, end + 3
                    elif (after := self.past_generics(end)) > end:
                        plain, end = False, after
                    else:
                        break
                if plain and self.kind(k - 1) not in ("&", "lifetime") and self.word(k - 1) not in ("dyn", "mut"):
                    return self.word(k)
                k = end
            else:
                k = self.past(k)
        return None


_MODIFIERS = frozenset("public private protected static async readonly get set override abstract accessor declare".split())
_STATEMENTS = frozenset("if for while switch catch function return with".split())
#: Names that begin a declaration and stand in no type.
_DECLARES = frozenset("type interface class function const let var export import".split())
#: Tokens of a list of type parameters, at most.
MOST_GENERIC = 200
#: Marks after which a statement goes on.
_GOES_ON = frozenset("= ( , : [ ? & | + - * / % ! ~ < > ^ . => @".split())


class ScriptParser(Parser):
    def parse(self) -> list[tuple[str, str | None, int, int]]:
        k, ends = 0, []  # ends: closing places of class bodies and object literals around k
        while k < len(self.tokens):
            while ends and ends[-1] <= k:
                ends.pop()
            if ends and self.member_begins(k, ends[-1]):
                k = self.member(k)
            elif (declared := self.declaration(k)) is not None:
                k, body = declared
                if body is not None:
                    ends.append(self.ends.get(body, len(self.tokens)))
            else:
                if self.kind(k) == "{" and self.is_object(k):
                    ends.append(self.ends.get(k, len(self.tokens)))
                k += 1
        return self.found

    def __init__(self, source: str, tokens: list[Token]) -> None:
        super().__init__(source, tokens)
        self.inner: dict[int, int] = {}  # the innermost open brace of each token
        stack: list[int] = []
        for k, t in enumerate(tokens):
            while stack and self.ends.get(stack[-1], len(tokens)) <= k:
                stack.pop()
            self.inner[k] = stack[-1] if stack else -1
            if t.kind in _OPENS:
                stack.append(k)

    def is_object(self, k: int) -> bool:
        before = self.kind(k - 1)
        return before in ("=", "(", ",", ":", "[", "?", "&", "|") or self.word(k - 1) in ("return", "default")

    def member_begins(self, k: int, end: int) -> bool:
        """Right inside a class body or object, where a member may begin: after its brace, a separator, a member's body, or on a new line."""
        around = self.inner[k]
        if around < 0 or self.ends.get(around, len(self.tokens)) != end:
            return False
        return self.kind(k - 1) in ("{", ";", ",", "}") or (self.new_line(k) and self.kind(k - 1) not in _GOES_ON)

    def member(self, first: int) -> int:
        """Read one member; a method has a list of parameters and a body. Returns where to go on: inside its body, or after what was read."""
        k = first
        while self.kind(k) == "@":  # decorators stand before the method
            k += 2
            while self.kind(k) == ".":
                k += 2
            k = self.past(k) if self.kind(k) == "(" else k
            first = k
        while self.word(k) in _MODIFIERS and self.kind(k + 1) in ("name", "[", "#", "*", "text", "number"):
            k += 1
        while self.kind(k) in ("*", "#"):
            k += 1
        if self.kind(k) == "[":
            k = self.past(k)
        elif self.kind(k) in ("name", "text", "number") and self.word(k) not in _STATEMENTS - {"catch", "with", "return", "for", "if"}:
            k += 1
        else:
            return first + 1
        k += self.kind(k) == "?"
        k = self.past_generics(k)
        if self.kind(k) != "(" or k not in self.close:
            return max(first + 1, k)
        k = self.past(k)
        if self.kind(k) == ":":
            k = self.past_type(k + 1)
        if self.kind(k) == "{" and k in self.close and self.kind(k - 1) != "=>":
            self.found.append(("method_definition", None, first, self.close[k]))
            return k + 1
        return max(first + 1, k)

    def past_type(self, k: int) -> int:
        """The place after a type: what ends it is a body, a separator or the end of the group."""
        fresh = True  # a type is due, so a brace belongs to it
        while k < len(self.tokens) and self.kind(k) not in (";", ",", ")", "]", "}", "="):
            if self.kind(k) == "{" and not fresh:
                break
            after = self.past_generics(k)
            fresh = after == k and (self.kind(k) in ("|", "&", "=>", ":", "?") or self.word(k) in ("is", "extends", "keyof", "typeof", "infer", "asserts"))
            k = after if after > k else self.past(k)
        return k

    def starts_statement(self, k: int) -> bool:
        before = k - 1
        if self.word(before) in ("export", "default", "declare", "abstract", "else"):
            return True
        return self.kind(before) in ("", ";", "{", "}", ")") or (self.new_line(k) and self.kind(before) not in _GOES_ON and self.word(before) not in ("return", "new"))

    def declaration(self, k: int) -> tuple[int, int | None] | None:
        """The declaration that begins at k: where to go on, and the brace of its members if it has such."""
        word = self.word(k)
        if word not in ("function", "async", "class", "interface", "type") or not self.starts_statement(k):
            return None
        at = k + (word == "async")
        name = self.word(at + 1)
        if self.word(at) == "function" and name:
            n = self.past_generics(at + 2)
            if self.kind(n) != "(":
                return None
            n = self.past(n)
            n = self.past_type(n + 1) if self.kind(n) == ":" else n
            if self.kind(n) == "{" and n in self.close:
                self.found.append(("function_declaration", name, k, self.close[n]))
                return n + 1, None
        elif word in ("class", "interface") and name and name not in ("extends", "implements"):
            n = self.past_generics(k + 2)
            while n < len(self.tokens) and self.kind(n) not in ("{", ";", "}", "="):
                n = max(self.past_generics(n), self.past(n))
            if self.kind(n) == "{":
                if self.word(k - 1) != "abstract" and n in self.close:
                    self.found.append((f"{word}_declaration", name, k, self.close[n]))
                return n + 1, n if word == "class" else None
        elif word == "type" and name:
            n = self.past_generics(k + 2)
            if self.kind(n) == "=":
                end = self.alias_end(n + 1)
                self.found.append(("type_alias_declaration", name, k, end))
                return n + 1, None
        return None

    def alias_end(self, k: int) -> int:
        """The last token of a type alias: before its semicolon, or where a line ends that nothing goes on from."""
        last = k
        while k < len(self.tokens) and self.kind(k) not in (";", ")", "]", "}"):
            joins = self.kind(k) in ("|", "&", "=>", "?", ":", ".", "[", "<")
            if k > last and self.word(k) in _DECLARES and self.kind(k - 1) != ".":
                break
            if k > last and self.new_line(k) and not joins and self.kind(k - 1) not in _GOES_ON and self.word(k - 1) not in ("extends", "keyof", "typeof"):
                break
            after = max(self.past_generics(k), self.past(k))
            last, k = after - 1, after
        return k if self.kind(k) == ";" else min(last, len(self.tokens) - 1)


def declarations(source: str, rust: bool) -> list[tuple[str, str | None, int, int]]:
    """(kind, name, first line, last line) of the declarations of a file, lines from 0, outer ones first."""
    tokens = list((rust_tokens if rust else script_tokens)(source))
    parser = (RustParser if rust else ScriptParser)(source, tokens)
    rows = [(kind, name, parser.line(tokens[a].at), parser.line(tokens[b].at)) for kind, name, a, b in parser.parse()]
    return sorted(rows, key=lambda r: (r[2], -r[3], r[0]))
