"""Reading source of languages with braces as tokens: declarations with their spans, imports, bases and calls.

A file is one pass over its tokens. What has been read since the last boundary is a statement; a brace turns it into a
scope, whose kind (type, function, name space or plain block) a small rule of the language tells from its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODIFIERS = frozenset("export default async public private protected internal static final abstract sealed synchronized native override virtual readonly declare pub unsafe extern inline constexpr partial strictfp transient volatile explicit friend".split())
TYPES = {"class": "class", "interface": "type", "enum": "type", "record": "class", "struct": "type", "trait": "type", "union": "type", "type": "type"}
#: Words before a parenthesis that call nothing and declare nothing.
_CONTROL = "if for while switch catch return new else do try throw case super this"
_CONTROL_OF = {
    "javascript": "function with await typeof in yield delete void instanceof async import of", "go": "func defer go select range", "rust": "fn match loop where as in let Some Ok Err", "java": "synchronized instanceof assert", "csharp": "foreach using lock typeof nameof await where when is as base sizeof",
    "c": "sizeof", "cpp": "sizeof delete using decltype noexcept", "php": "function foreach echo print and or fn match array list isset unset empty", "r": "function repeat",
}
_CONTROL_OF["typescript"] = _CONTROL_OF["javascript"]
CONTROL = {lang: frozenset((_CONTROL + " " + words).split()) - ({"new"} if lang == "rust" else set()) for lang, words in _CONTROL_OF.items()}
LINE_ENDS = frozenset(("javascript", "typescript", "go", "r"))
#: Languages whose functions are named right before their parameters, behind a type.
TYPED = frozenset(("java", "csharp", "c", "cpp"))
SCRIPTS = frozenset(("javascript", "typescript", "php", "r"))

_LINE_COMMENT = {"php": r"//[^\n]*|\#(?!\[)[^\n]*", "r": r"\#[^\n]*"}
_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_TEXTS = {"rust": r"\"(?:[^\"\\]|\\.)*\"|'(?:\\[^\n]{1,9}?|[^'\\\n])'", "go": _TEXT + r"|`[^`]*`", "javascript": _TEXT + r"|`(?:[^`\\]|\\.)*`", "typescript": _TEXT + r"|`(?:[^`\\]|\\.)*`", "java": r"\"\"\".*?\"\"\"|" + _TEXT}
_PATTERNS: dict[str, re.Pattern] = {}


def _pattern(lang: str) -> re.Pattern:
    if lang not in _PATTERNS:
        comment = _LINE_COMMENT.get(lang, r"//[^\n]*") + ("" if lang == "r" else r"|/\*.*?(?:\*/|\Z)")
        word = r"[\w.]+" if lang == "r" else r"[@\\$]?[\w$\\]+" if lang == "php" else r"[@\w$]+"
        pre = r"(?P<pre>\#(?:[^\n\\]|\\\n|\\)*)|" if lang in ("c", "cpp") else ""
        _PATTERNS[lang] = re.compile(rf"(?P<skip>[ \t\r\f\v﻿]+|{comment})|(?P<nl>\n)|{pre}(?P<text>{_TEXTS.get(lang, _TEXT)})|(?P<word>{word})|(?P<sign>=>|->|::|<-|\?\.|.)", re.S)
    return _PATTERNS[lang]


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int


@dataclass
class Scope:
    kind: str
    id: str
    owner: str
    base: int
    symbol: dict | None = None


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str, str, str | None]] = field(default_factory=list)
    bases: list[tuple[str, str]] = field(default_factory=list)


class Reader:
    def __init__(self, path: str, lang: str, text: str):
        self.path, self.lang, self.text, self.control = path, lang, text, CONTROL[lang]
        self.found = Found()
        self.scopes = [Scope("file", path, "", 0)]
        self.statement: list[Token] = []
        self.depth = self.listed = 0

    def read(self) -> Found:
        line, last = 1, None
        for m in _pattern(self.lang).finditer(self.text):
            kind, s = m.lastgroup, m.group()
            if kind == "nl":
                self._newline()
            elif kind == "pre":
                parts = s.split('"')
                if parts[0].replace(" ", "").startswith("#include") and len(parts) > 2:
                    self.found.imports.append((parts[1], line))
            elif kind != "skip":
                token = Token(kind, s, m.start(), line)
                if s == "(" and last is not None and last.kind == "word":
                    self._call()
                self._take(token)
                last = token
            line += s.count("\n") if kind != "word" and kind != "sign" else 0
        while len(self.scopes) > 1:
            self._close(line)
        self._finish()
        return self.found

    def _take(self, token: Token) -> None:
        s = token.text if token.kind == "sign" else ""
        if s == "{" and not self._lists():
            self._open(token)
            return
        if s in ("{", "}") and (s == "{" or self.listed):
            # The braces of a list of imported names are no scope.
            self.listed += 1 if s == "{" else -1
            self.depth = max(self.scopes[-1].base, self.depth + (1 if s == "{" else -1))
            self.statement.append(token)
            return
        if s == "}":
            self._finish()
            if len(self.scopes) > 1:
                self._close(token.line)
            return
        if s == ";" and self.depth == self.scopes[-1].base:
            self._finish()
            return
        if s in ("(", "["):
            self.depth += 1
        elif s in (")", "]"):
            self.depth = max(self.scopes[-1].base, self.depth - 1)
        self.statement.append(token)

    def _lists(self) -> bool:
        words = [t.text for t in self.statement[:3]]
        head = words[1:2] if words[:1] == ["pub"] else words[:1]
        return head in (["import"], ["use"]) or words in (["export"], ["export", "type"])

    def _newline(self) -> None:
        if self.lang in LINE_ENDS and self.statement and self.depth == self.scopes[-1].base:
            words = [t.text for t in self._plain(self.statement[:50])]
            waits = words and words[0] in ("class", "interface", "function", "func", "type", "enum") or self.statement[-1].text in ("=", "=>", ",", ".", "+", "(", "<-", "function") or words[:1] == [""]
            if not waits or words[0] == "type" and len(words) > 2 and self.lang == "go":
                self._finish()

    def _open(self, token: Token) -> None:
        scope = self._declared(self.statement, True) if self.depth == self.scopes[-1].base or self.statement and self.statement[-1].text == "=>" else None
        if scope is None:
            here = self.scopes[-1]
            scope = Scope("block", here.id, here.owner, 0)
        scope.base = self.depth
        self.scopes.append(scope)
        self.statement = []

    def _close(self, line: int) -> None:
        scope = self.scopes.pop()
        self.depth = scope.base
        if scope.symbol is not None:
            scope.symbol["end_line"] = line
        self.statement = []

    def _finish(self) -> None:
        """A statement that ends without a body."""
        if self.statement:
            if not self._imported(self.statement):
                self._declared(self.statement, False)
            self.statement = []

    @staticmethod
    def _plain(tokens: list[Token]) -> list[Token]:
        """A statement without its leading annotations and modifiers."""
        i = 0
        while i < len(tokens):
            s = tokens[i].text
            if s in MODIFIERS:
                i += 1
            elif s.startswith("@") and tokens[i].kind == "word" or s == "#" or s == "[" and tokens[i].kind == "sign":
                i += s != "["
                if i < len(tokens) and tokens[i].text in ("(", "["):
                    depth = 0
                    while i < len(tokens):
                        depth += (tokens[i].text in ("(", "[")) - (tokens[i].text in (")", "]"))
                        i += 1
                        if not depth:
                            break
            elif s == "(" and i and tokens[i - 1].text == "pub":
                while i < len(tokens) and tokens[i].text != ")":
                    i += 1
                i += 1
            else:
                break
        return tokens[i:]

    def _declared(self, statement: list[Token], body: bool) -> Scope | None:
        tokens = self._plain(statement)
        if not tokens:
            return None
        words, scope = [t.text for t in tokens], self.scopes[-1]
        head = words[0]
        if head == "const" and self.lang == "rust" and "fn" in words[:4]:
            tokens, words = tokens[1:], words[1:]
            head = words[0]
        if head in ("namespace", "mod", "module") and body:
            return Scope("space", scope.id, scope.owner, 0)
        if head == "impl" and body:
            return Scope("type", scope.id, self._impl(words), 0)
        if head in TYPES and len(words) > 1 and tokens[1].kind == "word" and scope.kind in ("file", "space", "type"):
            at = 2 if words[1] in ("class", "struct") and len(words) > 2 else 1
            if self.lang in ("c", "cpp") and not body or head == "type" and self.lang not in ("go", "typescript", "rust"):
                return None
            tag = "class" if self.lang in ("java", "csharp", "php") and head in ("interface", "enum", "record", "struct", "trait") else TYPES[head]
            symbol = self._symbol(tokens[at], scope.owner, tag, "")
            self._heritage(symbol["id"], tokens[at + 1:])
            return Scope("type", symbol["id"], symbol["name"], 0, symbol)
        name = self._function(tokens, words, scope, body)
        if name is not None:
            token, owner = name
            symbol = self._symbol(token, owner, "method" if owner else "func", self._parameters(token))
            return Scope("func", symbol["id"], symbol["name"], 0, symbol)
        if head in ("const", "let", "var") and self.lang in ("javascript", "typescript") and statement[0].text == "export" and len(tokens) > 1 and tokens[1].kind == "word" and scope.kind == "file":
            symbol = self._symbol(tokens[1], "", "var", "")
            return Scope("block", symbol["id"], "", 0, symbol)
        return None

    def _function(self, tokens: list[Token], words: list[str], scope: Scope, body: bool) -> tuple[Token, str] | None:
        head, at, owner, lang = words[0], -1, scope.owner if scope.kind == "type" else "", self.lang
        if scope.kind not in ("file", "space", "type"):
            return None
        if lang == "go" and head == "func":
            at = 1
            if len(words) > 1 and words[1] == "(":
                end = words.index(")") if ")" in words else len(words)
                named = [t.text for t in tokens[2:end] if t.kind == "word"] if "[" not in words[2:end] else [t.text for t in tokens[2:2 + words[2:].index("[")] if t.kind == "word"]
                owner, at = named[-1] if named else "", end + 1
        elif lang == "rust" and head == "fn":
            at = 1
        elif head == "function" and lang in ("javascript", "typescript", "php"):
            at = 2 if len(words) > 1 and words[1] in ("*", "&") else 1
        elif lang == "r":
            at = 0 if len(words) > 2 and words[1] in ("<-", "=") and words[2] == "function" else -1
        elif lang in ("javascript", "typescript"):
            if head in ("const", "let", "var") and "=" in words and ("=>" in words or "function" in words):
                right = words[words.index("=") + 1:]
                at = 1 if right[:1] in (["function"], ["async"], ["("], ["<"]) or right[1:2] == ["=>"] else -1
            elif scope.kind == "type" and "=>" in words and "=" in words and words.index("=") < words.index("=>"):
                at = 0
            elif scope.kind == "type" and body:
                at = 1 if head in ("get", "set", "*") and len(words) > 1 and words[1] != "(" else 0
                at = at if words[at + 1:at + 2] in (["("], ["<"]) else -1
        elif lang in TYPED and (body or scope.kind == "type" and lang in ("java", "csharp")) and "(" in words:
            at = words.index("(") - 1
            if "=" in words[:at + 1] or at < 0 or at == 0 and scope.kind != "type" or any(w in self.control for w in words[:at + 1]):
                return None
            if at > 0 and words[at] == ">" and "<" in words[:at]:
                at = words.index("<") - 1
            before = [t.text for t in tokens[:at] if t.kind == "word"]
            if lang == "cpp" and at > 1 and words[at - 1] == "::":
                owner = before[-1]
        if at < 0 or at >= len(tokens) or tokens[at].kind != "word" or words[at] in self.control or words[at][0].isdigit():
            return None
        return tokens[at], owner

    def _symbol(self, token: Token, owner: str, tag: str, parameters: str) -> dict:
        name = f"{owner}.{token.text}" if owner else token.text
        scope = self.scopes[-1]
        symbol = {"id": f"{self.path}::{name}", "name": name, "line": token.line, "end_line": token.line, "tag": tag, "signature": token.text + parameters, "parent": scope.id if scope.kind == "type" else self.path}
        self.found.symbols.append(symbol)
        return symbol

    def _parameters(self, token: Token) -> str:
        rest = [t for t in self.statement if t.at > token.at]
        open_ = next((t.at for t in rest if t.text == "("), -1)
        depth = 0
        for t in rest:
            if t.at >= open_ >= 0:
                depth += (t.text == "(") - (t.text == ")")
                if not depth:
                    return "(" + " ".join(self.text[open_ + 1:t.at].split()) + ")"
        return ""

    @staticmethod
    def _impl(words: list[str]) -> str:
        """The type of an implementation: behind ``for`` if there is one, without its parameters."""
        if "for" in words:
            words = words[words.index("for"):]
        depth, name = 0, ""
        for w in words[1:]:
            depth += (w == "<") - (w == ">")
            if not depth and w == "where":
                break
            if not depth and (w[0].isalpha() or w[0] == "_"):
                name = w
        return name

    def _heritage(self, id_: str, rest: list[Token]) -> None:
        depth, behind = 0, self.lang in ("cpp", "csharp")
        for t in rest:
            if t.text in ("extends", "implements", ":"):
                behind = True
            elif t.text in ("<", "("):
                depth += 1
            elif t.text in (">", ")"):
                depth -= 1
            elif behind and not depth and t.kind == "word" and t.text not in MODIFIERS and t.text != "where":
                self.found.bases.append((id_, t.text))
            elif t.text == "=":
                break

    def _imported(self, statement: list[Token]) -> bool:
        words = [t.text for t in statement]
        texts = [t.text[1:-1] for t in statement if t.kind == "text"]
        head, line = words[0], statement[0].line
        raws: list[str] = []
        if self.lang in ("javascript", "typescript") and (head == "import" or head == "export" and "from" in words):
            raws = texts[-1:]
        elif self.lang == "go" and head == "import":
            raws = texts
        elif self.lang in ("java", "csharp") and head in ("import", "using") and "(" not in words and "=" not in words:
            raws = ["".join(w for w in words[1:] if w != "static").removesuffix(".*").removesuffix(".")]
        elif self.lang == "rust" and "mod" in words[:5] and words[-2:-1] == ["mod"]:
            raws = words[-1:]
        elif self.lang == "php" and head == "use" and self.scopes[-1].kind in ("file", "space"):
            raws = [w.lstrip("\\") for w in words[1:2]]
        self.found.imports += [(r, line) for r in raws if r]
        return bool(raws) or head == "import"

    def _call(self) -> None:
        """The word before a parenthesis, with what it is called on."""
        tokens = self.statement
        name = tokens[-1].text if tokens else ""
        if not tokens or tokens[-1].kind != "word" or name in self.control or name.startswith("@") or name[0].isdigit():
            return
        scope = self.scopes[-1]
        caller = next((s for s in reversed(self.scopes) if s.kind == "func"), None)
        if caller is None and (self.lang not in SCRIPTS or scope.kind == "type"):
            return
        before = tokens[-2].text if len(tokens) > 1 else ""
        if before in ("function", "func", "fn", "class") or before == "new" and self.lang != "rust" or (before == ")" and self.lang == "go" and tokens[0].text == "func"):
            return
        via = tokens[-3].text if before in (".", "::", "->", "?.") and len(tokens) > 2 and tokens[-3].kind == "word" else None
        self.found.calls.append((caller.id if caller else self.path, name, via or ("?" if before in (".", "::", "->", "?.") else None)))


_BASIC_MODIFIERS = frozenset("public private protected friend shared overrides overridable mustoverride notoverridable partial async static default readonly".split())
_BASIC_TYPES = {"class": "class", "module": "class", "structure": "class", "interface": "class", "enum": "class"}


def read_basic(path: str, text: str) -> Found:
    """Visual Basic, line by line: a block lasts until the line that ends it."""
    found, open_ = Found(), []
    for n, line in enumerate(text.split("\n"), 1):
        words = line.partition("'")[0].replace("(", " ( ").split()
        while words and words[0].lower() in _BASIC_MODIFIERS:
            words.pop(0)
        head = words[0].lower() if words else ""
        if head == "end" and len(words) > 1 and open_ and open_[-1][0] == words[1].lower():
            open_.pop()[1]["end_line"] = n
        elif head == "imports" and len(words) > 1:
            found.imports.append((words[1], n))
        elif (head in _BASIC_TYPES or head in ("sub", "function")) and len(words) > 1:
            owner = next((s["name"] for k, s in reversed(open_) if k in _BASIC_TYPES), "")
            name = f"{owner}.{words[1]}" if owner else words[1]
            symbol = {"id": f"{path}::{name}", "name": name, "line": n, "end_line": n, "tag": _BASIC_TYPES.get(head) or ("method" if owner else "func"), "signature": words[1], "parent": open_[-1][1]["id"] if open_ else path}
            found.symbols.append(symbol)
            open_.append((head, symbol))
        else:
            caller = next((s["id"] for k, s in reversed(open_) if k in ("sub", "function")), None)
            for word, after in zip(words, words[1:]):
                via, _, name = word.rpartition(".")
                if caller and after == "(" and name.isidentifier():
                    found.calls.append((caller, name, via or None))
    return found


def read_assembly(path: str, text: str) -> Found:
    """Assembly: its labels."""
    found = Found()
    for n, line in enumerate(text.split("\n"), 1):
        name, colon, _ = line.partition(":")
        if colon and name and not name[0].isdigit() and all(c.isalnum() or c in "_.$" for c in name):
            found.symbols.append({"id": f"{path}::{name}", "name": name, "line": n, "end_line": n, "tag": "label", "signature": name, "parent": path})
    return found


#: The languages that are read here.
LANGUAGES = (*CONTROL, "vb", "asm")


def read(path: str, lang: str, text: str) -> Found:
    """What one file declares, imports and calls; ``require`` and ``source`` with a text import as well."""
    if lang in ("vb", "asm"):
        return read_basic(path, text) if lang == "vb" else read_assembly(path, text)
    reader = Reader(path, lang, text)
    found = reader.read()
    name = {"javascript": "require", "typescript": "require", "r": "source"}.get(lang)
    if name:
        for m in re.finditer(rf"(?<![\w.]){name}\(\s*(['\"])([^'\"\n]+)\1", text):
            found.imports.append((m.group(2), text.count("\n", 0, m.start()) + 1))
    return found
