"""Functions paired with their documentation, from source files that may be broken.

A text is outlined by its brackets, strings and comments; only stretches that can hold declarations become tokens, and
these are parsed by a generalised LL grammar of the language. The grammars recover from errors themselves: a body that is
never closed is a symbol of its own (``{?``), ended by indentation. Whatever does not parse is stepped over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.gll import Ends, Grammar, Parser, State
from weft.session import cut

#: A description on at least so many differently named functions of at least so many projects is a template.
TEMPLATE_NAMES, TEMPLATE_PROJECTS, TEMPLATE_SHARE = 25, 5, 0.002
LEAST_WORDS = 5

LANGUAGES = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "mts": "js", "go": "go", "java": "java", "rs": "rs",
             "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hh": "c", "hpp": "c", "hxx": "c", "cs": "cs", "php": "php", "r": "r"}


@dataclass
class Function:
    name: str
    owner: str
    line: int
    doc: str


@dataclass
class Tokens:
    kinds: list[str]
    texts: list[str]
    offsets: list[int]
    lines: list[int]
    columns: list[int]
    match: dict[int, int]


_KEYWORDS = {
    "js": {"function", "class", "const", "let", "var", "export", "default", "async", "static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "get", "set", "if", "for", "while", "switch", "catch", "return", "new", "extends", "implements", "else", "do", "with", "await", "typeof", "throw", "case", "in", "of", "instanceof", "delete", "void", "yield", "super", "import", "from"},
    "go": {"func", "type", "struct", "interface", "if", "for", "switch", "return", "var", "const", "package", "import", "go", "defer", "select", "else"},
    "java": {"class", "interface", "enum", "record", "public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed", "throws", "extends", "implements", "permits", "if", "for", "while", "switch", "catch", "return", "new", "else", "do", "throw", "import", "package", "try", "assert", "case"},
    "rs": {"fn", "impl", "trait", "mod", "struct", "enum", "union", "pub", "const", "async", "unsafe", "extern", "default", "for", "where", "dyn", "use", "let", "if", "while", "loop", "match", "return", "type", "static", "mut"},
    "py": {"def", "class", "async", "if", "for", "while", "return", "import", "from", "with", "try", "lambda"},
    "c": {"namespace", "class", "struct", "union", "enum", "template", "extern", "static", "inline", "virtual", "explicit", "friend", "const", "constexpr", "noexcept", "override", "final", "operator", "typedef", "using", "return", "if", "for", "while", "switch", "else", "do", "case", "new", "delete", "throw", "goto", "try", "catch", "default"},
    "cs": {"namespace", "class", "interface", "struct", "enum", "record", "public", "private", "protected", "internal", "static", "virtual", "override", "async", "sealed", "abstract", "partial", "readonly", "extern", "unsafe", "new", "where", "using", "return", "if", "for", "foreach", "while", "switch", "else", "do", "throw", "lock", "try", "catch", "await", "case", "base", "this", "event", "delegate", "operator"},
    "php": {"namespace", "class", "interface", "trait", "enum", "public", "private", "protected", "static", "final", "abstract", "readonly", "function", "extends", "implements", "return", "if", "for", "foreach", "while", "switch", "else", "new", "use", "echo", "catch", "try", "throw", "const"},
    "r": {"function", "if", "for", "while", "return", "else", "repeat"},
}
_LEX = {
    lang: re.compile(f"(?:{parts[0][1]})?(?:" + "|".join(f"(?P<{n}>{p})" for n, p in parts[1:]) + "|$)", re.S)
    for lang, parts in {
        "js": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), ("str", r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*(?:`|\Z)"), ("id", r"[A-Za-z_$#À-￿][\w$]*"), ("num", r"\d[\w.]*"), ("op", r"=>|\.\.\.|[=!<>]=+|&&|\|\||\?\?|\?\.|.")],
        "go": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), ("str", r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*(?:`|\Z)"), ("id", r"[A-Za-z_À-￿]\w*"), ("num", r"\d[\w.]*"), ("op", r":=|[=!<>]=|&&|\|\||<-|\.\.\.|.")],
        "java": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), ("str", r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"), ("id", r"[A-Za-z_$À-￿][\w$]*"), ("num", r"\d[\w.]*"), ("op", r"->|::|[=!<>]=|&&|\|\||.")],
        "rs": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), ("str", r"b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:[^\"\\]|\\.)*(?:\"|\Z)|b?'(?:\\[^\n]{1,9}?|[^'\\\n])'"), ("life", r"'\w+"), ("id", r"(?:r#)?[A-Za-z_À-￿]\w*"), ("num", r"\d[\w.]*"), ("op", r"->|=>|::|[=!<>]=|&&|\|\||.")],
        "c": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^)\#(?:[^\n\\]|\\\n|\\)*"), ("str", r"R\"(\w*)\(.*?(?:\)\1\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"), ("id", r"[A-Za-z_À-￿]\w*"), ("num", r"\d(?:[\w.]|'\w)*"), ("op", r"->|::|[=!<>]=|&&|\|\||.")],
        "cs": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^)\#[^\n]*"), ("str", r"\"\"\".*?(?:\"\"\"|\Z)|\$?@\$?\"(?:[^\"]|\"\")*(?:\"|\Z)|\$?\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"), ("id", r"@?[A-Za-z_À-￿]\w*"), ("num", r"\d[\w.]*"), ("op", r"=>|::|[=!<>]=|&&|\|\||\?\?|\?\.|.")],
        "php": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)"), ("str", r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)"), ("id", r"[\\$]?[A-Za-z_À-￿][\w\\]*"), ("num", r"\d[\w.]*"), ("op", r"<\?(?:php|=)?|\?>|->|=>|::|[=!<>]=+|&&|\|\||\?\?|\.\.\.|.")],
        "r": [("ws", r"[ \t\r\f\v﻿]+"), ("nl", r"\n"), ("cm", r"\#[^\n]*"), ("str", r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|`[^`\n]*`?"), ("id", r"[A-Za-z.À-￿][\w.]*"), ("num", r"\d[\w.]*"), ("op", r"<<?-|->|[=!<>]=|&&|\|\||.")],
        "py": [("ws", r"(?:[ \t\f\v﻿]|\\\r?\n|\r(?=\n))+"), ("nl", r"\n|\r"), ("cm", r"#[^\n\r]*"), ("str", r"(?:[rRbBuUfF]{0,3})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)"), ("id", r"[A-Za-z_À-￿]\w*"), ("num", r"\d[\w.]*"), ("op", r"->|:=|[=!<>]=|\*\*|//|.")],
    }.items()
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_OPENS = {b: a for a, b in _PAIRS.items()}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "=>", "??", ""}


# The strings, comments and brackets of a text, with what lies between them skipped in one go.
_COARSE = {
    lang: re.compile(rf"[^(){{}}\[\]{skip}]*(?:{cm}|(?P<str>{st})|(?P<op>[(){{}}\[\]])|(?P<nl>\n|\r\n?)|(?P<any>\\\r?\n|.)|\Z)", re.S)
    for lang, skip, cm, st in (
        ("js", "\"'`/", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))", r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*(?:`|\Z)"),
        ("go", "\"'`/", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))", r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*(?:`|\Z)"),
        ("java", "\"'/", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))", r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"),
        ("rs", "\"'/#", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))", r"(?<=r)(?P<h>#*)\".*?(?:\"(?P=h)|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:\\[^\n]{1,9}?|[^'\\\n])'"),
        ("c", "\"'/#", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pp>\#(?:[^\n\\]|\\\n|\\)*)", r"(?<=R)\"(?P<h>\w*)\(.*?(?:\)(?P=h)\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|(?<!\d)'(?:[^'\\\n]|\\.)*'?"),
        ("cs", "\"'/#", r"(?P<cm>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pp>\#[^\n]*)", r"\"\"\".*?(?:\"\"\"|\Z)|(?:(?<=@)|(?<=@\$))\"(?:[^\"]|\"\")*(?:\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"),
        ("php", "\"'/#", r"(?P<cm>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z))", r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)"),
        ("r", "\"'`#", r"(?P<cm>\#[^\n]*)", r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|`[^`\n]*`?"),
        ("py", "\"'#\\\n\r", r"(?P<cm>\#[^\n\r]*)", r"\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"),
    )
}
_INDENT = re.compile(r"[ \t\f\v﻿]*")
_PY_HEAD = re.compile(r"@(?=[^\W\d])|(?:def|class|async)\b")


def _regex_may_follow(text: str, at: int) -> bool:
    at -= 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return at < 0 or text[at] in "(,=:[!&|?{};" or text[at] == ">" and text[at - 1:at] == "=" or text[max(0, at - 5):at + 1] == "return"


class Outline:
    """The brackets, comments and lines of a text, without its other tokens.

    ``close`` tells where a bracket is closed: one that is closed from outside stays open, and a round or square one does
    not reach out of a brace; what stays open is ended by the grammar. ``comments`` maps the last line of each
    comment that has its lines to itself to its first line and text. ``logical`` has offset and column of Python's lines."""

    def __init__(self, text: str, lang: str):
        self.text, py, js = text, lang == "py", lang == "js"
        self.close: dict[int, int] = {}
        self.logical: list[tuple[int, int]] = []
        breaks = [i for i, c in enumerate(text) if c == "\n"] if len(text) < 64 else np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 10).tolist()
        self.breaks = breaks
        found: list[tuple[int, int, str, bool]] = []
        opened: list[int] = []
        inside, outside = dict.fromkeys(_PAIRS, 0), []
        at, size, find = 0, len(text), _COARSE[lang].match
        if py:
            self._logical(0, False)
        while at < size:
            m = find(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "op":
                at = end - 1
                s = text[at]
                own = _OPENS.get(s)
                if own is None:
                    opened.append(at)
                    inside[s] += 1
                    if s == "{" and not py:
                        outside.append(inside)
                        inside = dict.fromkeys(_PAIRS, 0)
                elif inside[own] or (own == "{" and outside):
                    while text[o := opened.pop()] != own:
                        inside[text[o]] -= 1
                    if own == "{" and not py:
                        inside = outside.pop()
                    inside[own] -= 1
                    self.close[o] = at
            elif kind == "cm":
                begin = m.start(kind)
                s = text[begin:end]
                line = bisect_right(breaks, begin - 1)
                found.append((line + 1, line + 1 + s.count("\n"), s, not text[breaks[line - 1] + 1 if line else 0:begin].strip(" \t\r\f\v﻿")))
            elif kind == "nl":
                if py and self._logical(end, bool(opened)):
                    opened, inside = [], dict.fromkeys(_PAIRS, 0)
            elif js and kind == "any" and text[end - 1] == "/" and _regex_may_follow(text, end - 1) and (r := _REGEX.match(text, end - 1)):
                end = r.end()
            elif kind is None:
                break
            at = end
        self.comments = _comment_runs(found)

    def _logical(self, at: int, inside: bool) -> bool:
        """Takes down the line that begins here, unless it is inside brackets; a declaration ends what is open."""
        i = _INDENT.match(self.text, at).end()
        if self.text[i:i + 1] in ("", "\n", "\r", "#") or inside and not _PY_HEAD.match(self.text, i):
            return False
        self.logical.append((i, i - at))
        return inside

    def tokens(self, lang: str, lo: int, hi: int) -> Tokens:
        """The tokens of a stretch, and one more for the end. What is inside closed brackets is left out."""
        text, words, js, py, close, find = self.text, _KEYWORDS[lang], lang == "js", lang == "py", self.close, _LEX[lang].match
        kinds, texts, offsets, match = [], [], [], {}
        at = lo
        while at < hi:
            m = find(text, at, hi)
            kind, end = m.lastgroup, m.end()
            if kind is None:
                break
            if kind == "nl":
                if py and kinds and kinds[-1] != "nl":
                    kinds.append("nl"), texts.append("\n"), offsets.append(m.start(kind))
            elif kind != "cm":
                at = m.start(kind)
                s = text[at:end]
                if js and s == "/" and (kinds[-1] if kinds else "") in _BEFORE_REGEX and (r := _REGEX.match(text, at, hi)):
                    kind, s, end = "str", r.group(), r.end()
                kinds.append(s if kind == "op" or (kind == "id" and s in words) else kind)
                texts.append(s), offsets.append(at)
                if kind == "op" and s in _PAIRS and (c := close.get(at, hi)) < hi:
                    match[len(kinds) - 1] = len(kinds)
                    kinds.append(text[c]), texts.append(text[c]), offsets.append(c)
                    end = c + 1
            at = end
        if py and kinds and kinds[-1] != "nl":
            kinds.append("nl"), texts.append(""), offsets.append(hi)
        lines = [bisect_right(self.breaks, o - 1) for o in offsets] if len(offsets) < 32 else np.searchsorted(self.breaks, offsets, "left").tolist()
        columns = [o - (self.breaks[k - 1] + 1 if k else 0) for o, k in zip(offsets, lines)]
        kinds.append("")
        return Tokens(kinds, texts, offsets, [k + 1 for k in lines], columns, match)


def _comment_runs(found: list[tuple[int, int, str, bool]]) -> dict[int, tuple[int, str]]:
    """Line comments on neighbouring lines are one comment."""
    runs: dict[int, tuple[int, str]] = {}
    for first, last, s, clean in found:
        if not clean:
            continue
        before = runs.get(first - 1)
        if not s.startswith("/*") and before and not before[1].startswith("/*"):
            runs[last] = (before[0], before[1] + "\n" + s)
            del runs[first - 1]
        else:
            runs[last] = (first, s)
    return runs


_JS: Grammar = {
    "Item": [("Class",), ("Fn",), ("Arrow",)],
    "Member": [("Method",), ("Arrow",), ("Field",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [(k,) for k in ("export", "default", "async", "static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "get", "set")] + [("Note",)],
    "Note": [("@", "Dotted"), ("@", "Dotted", "()")],
    "Dotted": [("name",), ("Dotted", ".", "name")],
    "Class": [("Mods", "class", "Name", "Heritage", "Body")],
    "Heritage": [(), ("Heritage", "any"), ("Heritage", "<", "Inside", ">"), ("Heritage", "()")],
    "Fn": [("Mods", "function", "Sig", "Returns", "Body"), ("Mods", "function", "*", "Sig", "Returns", "Body")],
    "Sig": [("Name", "Generics", "()")],
    "Generics": [(), ("<", "Inside", ">")],
    "Inside": [(), ("Inside", "any"), ("Inside", "<", "Inside", ">"), ("Inside", "{}"), ("Inside", "()"), ("Inside", "="), ("Inside", ":")],
    "Returns": [(), (":", "Type")],
    "Type": [("Piece",), ("Type", "Piece")],
    "Piece": [("any",), ("{}",), ("()",), ("<", "Inside", ">"), ("=>",), ("?", "Type", ":")],
    "Arrow": [("Mods", "Var", "Name", "Returns", "=", "Async", "Params", "Returns", "=>", "Rest"), ("Mods", "Var", "Name", "Returns", "=", "Async", "function", "MaybeName", "()", "Returns", "Body")],
    "Var": [(), ("const",), ("let",), ("var",)],
    "Async": [(), ("async",)],
    "MaybeName": [(), ("name",), ("*",)],
    "Params": [("name",), ("Generics", "()")],
    "Rest": [("Body",), ("rest",)],
    "Method": [("Mods", "Sig", "Returns", "Body"), ("Mods", "*", "Sig", "Returns", "Body")],
    "Field": [("Mods", "name", "rest")],
    "Name": [("name",)],
    "Body": [("{}",), ("{?",)],
}
_GO: Grammar = {
    "Item": [("Method",), ("Fn",)],
    "Fn": [("func", "Sig", "Returns", "Body")],
    "Method": [("func", "Receiver", "Sig", "Returns", "Body")],
    "Receiver": [("()",)],
    "Sig": [("Name", "Generics", "()")],
    "Generics": [(), ("[]",)],
    "Returns": [(), ("Returns", "any"), ("Returns", "()"), ("Returns", "interface", "{}"), ("Returns", "struct", "{}")],
    "Name": [("name",)],
    "Body": [("{}",), ("{?",)],
}
_JAVA: Grammar = {
    "Item": [("Class",), ("Method",)],
    "Member": [("Class",), ("Method",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [(k,) for k in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed")] + [("Note",)],
    "Note": [("@", "Dotted"), ("@", "Dotted", "()")],
    "Dotted": [("name",), ("Dotted", ".", "name")],
    "Class": [("Mods", "ClassWord", "Name", "Heritage", "Body"), ("Mods", "record", "Name", "Generics", "()", "Heritage", "Body")],
    "ClassWord": [("class",), ("interface",), ("enum",), ("@", "interface")],
    "Heritage": [(), ("Heritage", "any"), ("Heritage", "<", "Inside", ">"), ("Heritage", "()")],
    "Method": [("Mods", "Generics", "Type", "Sig", "Dims", "Throws", "End"), ("Mods", "Generics", "Sig", "Throws", "Body")],
    "Generics": [(), ("<", "Inside", ">")],
    "Inside": [(), ("Inside", "any"), ("Inside", "<", "Inside", ">")],
    "Type": [("Dotted", "Generics", "Dims")],
    "Dims": [(), ("Dims", "[]")],
    "Throws": [(), ("throws", "Heritage")],
    "Sig": [("Name", "()")],
    "Name": [("name",)],
    "End": [("Body",), (";",), ("default", "rest")],
    "Body": [("{}",), ("{?",)],
}
_RS: Grammar = {
    "Item": [("Impl",), ("Trait",), ("Module",), ("Fn",)],
    "Member": [("Fn",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [("pub",), ("pub", "()"), ("const",), ("async",), ("unsafe",), ("default",), ("extern",), ("extern", "str"), ("Note",)],
    "Note": [("#", "[]")],
    "Fn": [("Mods", "fn", "Sig", "Returns", "Where", "End")],
    "Sig": [("Name", "Generics", "()")],
    "Generics": [(), ("<", "Inside", ">")],
    "Inside": [(), ("Inside", "any"), ("Inside", "<", "Inside", ">"), ("Inside", "()"), ("Inside", "[]"), ("Inside", "->"), ("Inside", "="), ("Inside", "fn", "()")],
    "Returns": [(), ("->", "Type")],
    "Type": [("Piece",), ("Type", "Piece")],
    "Piece": [("any",), ("()",), ("[]",), ("<", "Inside", ">"), ("->",), ("fn", "()"), ("impl",)],
    "Where": [(), ("where", "Type")],
    "End": [("Body",), (";",)],
    "Impl": [("Mods", "impl", "Generics", "Owner", "Where", "Body"), ("Mods", "impl", "Generics", "Type", "for", "Owner", "Where", "Body")],
    "Owner": [("Type",)],
    "Trait": [("Mods", "trait", "Name", "Heritage", "Body")],
    "Heritage": [(), ("Heritage", "Piece"), ("Heritage", "where")],
    "Module": [("Mods", "mod", "Name", "Body")],
    "Name": [("name",)],
    "Body": [("{}",), ("{?",)],
}
_PY: Grammar = {
    "Item": [("Notes", "Def"), ("Notes", "Class")],
    "Notes": [(), ("Notes", "Note")],
    "Note": [("@", "line")],
    "Def": [("Async", "def", "Sig", "Returns", ":")],
    "Async": [(), ("async",)],
    "Sig": [("Name", "Generics", "()")],
    "Generics": [(), ("[]",)],
    "Returns": [(), ("->", "Type")],
    "Type": [("Piece",), ("Type", "Piece")],
    "Piece": [("any",), ("[]",), ("()",), ("str",)],
    "Class": [("class", "Name", "Generics", ":"), ("class", "Name", "Generics", "()", ":")],
    "Name": [("name",)],
}
_C: Grammar = {
    "Item": [("Class",), ("Module",), ("Fn",)],
    "Member": [("Class",), ("Fn",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [(k,) for k in ("static", "inline", "virtual", "explicit", "friend", "constexpr", "extern")] + [("extern", "str"), ("template", "<", "Inside", ">"), ("[]",)],
    "Module": [("Mods", "namespace", "Body"), ("Mods", "namespace", "Path", "Body"), ("extern", "str", "Body")],
    "Class": [("Mods", "ClassWord", "Name", "Heritage", "Body"), ("Mods", "enum", "class", "Name", "Heritage", "Body"), ("typedef", "ClassWord", "Body"), ("typedef", "ClassWord", "Name", "Body")],
    "ClassWord": [("class",), ("struct",), ("union",), ("enum",)],
    "Heritage": [(), ("Heritage", "any"), ("Heritage", "::"), ("Heritage", "<", "Inside", ">"), ("Heritage", "final")],
    "Fn": [("Mods", "Type", "Sig", "Quals", "End"), ("Mods", "Sig", "Quals", "Body"), ("Mods", "Sig", "Quals", "=", "default", ";"), ("Mods", "Sig", "Quals", "=", "delete", ";")],
    "Type": [("Before", "Path"), ("Before", "ClassWord", "Path"), ("Type", "Piece")],
    "Before": [(), ("Before", "const"), ("Before", "static"), ("Before", "inline")],
    "Piece": [("Path",), ("const",), ("*",), ("&",), ("&&",), ("<", "Inside", ">")],
    "Path": [("name",), ("Path", "::", "name"), ("Path", "<", "Inside", ">", "::", "name")],
    "Inside": [(), ("Inside", "any"), ("Inside", "::"), ("Inside", "const"), ("Inside", "class"), ("Inside", "<", "Inside", ">"), ("Inside", "()"), ("Inside", "[]"), ("Inside", "=")],
    "Sig": [("Name", "()"), ("Owner", "::", "Name", "()")],
    "Owner": [("Path",), ("Path", "<", "Inside", ">")],
    "Name": [("name",), ("~", "name"), ("operator", "Sign")],
    "Sign": [("any",), ("Sign", "any"), ("[]",), ("()",), ("=",), ("<",), (">",)],
    "Quals": [(), ("Quals", "Qual")],
    "Qual": [("const",), ("noexcept",), ("noexcept", "()"), ("override",), ("final",), ("&",), ("&&",), ("->", "Type"), (":", "Inits"), ("name",), ("name", "()")],
    "Inits": [("Init",), ("Inits", ",", "Init")],
    "Init": [("Path", "()"), ("Path", "{}"), ("Path", "<", "Inside", ">", "()")],
    "End": [("Body",), (";",), ("=", "any", ";"), ("=", "default", ";"), ("=", "delete", ";")],
    "Body": [("{}",), ("{?",)],
}
_CS: Grammar = {
    "Item": [("Class",), ("Module",), ("Method",)],
    "Member": [("Class",), ("Method",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [(k,) for k in ("public", "private", "protected", "internal", "static", "virtual", "override", "async", "sealed", "abstract", "partial", "readonly", "extern", "unsafe", "new")] + [("Note",)],
    "Note": [("[]",)],
    "Module": [("namespace", "Dotted", "Body")],
    "Class": [("Mods", "ClassWord", "Name", "Heritage", "Body")],
    "ClassWord": [("class",), ("interface",), ("struct",), ("enum",), ("record",), ("record", "class"), ("record", "struct")],
    "Heritage": [(), ("Heritage", "any"), ("Heritage", "<", "Inside", ">"), ("Heritage", "()"), ("Heritage", "where"), ("Heritage", "class"), ("Heritage", "new", "()")],
    "Method": [("Mods", "Type", "Sig", "Where", "End"), ("Mods", "Sig", "Chain", "End")],
    "Chain": [(), (":", "base", "()"), (":", "this", "()")],
    "Type": [("Dotted", "Generics", "Dims"), ("()", "Dims")],
    "Dotted": [("name",), ("Dotted", ".", "name")],
    "Dims": [(), ("Dims", "[]"), ("Dims", "?"), ("Dims", "*")],
    "Generics": [(), ("<", "Inside", ">")],
    "Inside": [(), ("Inside", "any"), ("Inside", "<", "Inside", ">"), ("Inside", "()"), ("Inside", "[]")],
    "Sig": [("Name", "Generics", "()")],
    "Where": [(), ("where", "Heritage")],
    "Name": [("name",), ("~", "name")],
    "End": [("Body",), (";",), ("=>", "rest")],
    "Body": [("{}",), ("{?",)],
}
_PHP: Grammar = {
    "Item": [("Class",), ("Module",), ("Fn",)],
    "Member": [("Fn",)],
    "Mods": [(), ("Mods", "Mod")],
    "Mod": [(k,) for k in ("public", "private", "protected", "static", "final", "abstract", "readonly")] + [("Note",)],
    "Note": [("#", "[]")],
    "Module": [("namespace", "name", "Body")],
    "Class": [("Mods", "ClassWord", "Name", "Heritage", "Body")],
    "ClassWord": [("class",), ("interface",), ("trait",), ("enum",)],
    "Heritage": [(), ("Heritage", "any"), ("Heritage", "extends"), ("Heritage", "implements")],
    "Fn": [("Mods", "function", "Sig", "Returns", "End"), ("Mods", "function", "&", "Sig", "Returns", "End")],
    "Sig": [("Name", "()")],
    "Returns": [(), (":", "Type")],
    "Type": [("Piece",), ("Type", "Piece")],
    "Piece": [("any",), ("static",), ("()",)],
    "Name": [("name",)],
    "End": [("Body",), (";",)],
    "Body": [("{}",), ("{?",)],
}
_R: Grammar = {
    "Item": [("Fn",)],
    "Fn": [("Name", "Assign", "function", "()", "Rest")],
    "Assign": [("<-",), ("<<-",), ("=",)],
    "Rest": [("Body",), ("rest",)],
    "Name": [("name",), ("str",)],
    "Body": [("{}",), ("{?",)],
}
_GRAMMARS = {"js": _JS, "go": _GO, "java": _JAVA, "rs": _RS, "py": _PY, "c": _C, "cs": _CS, "php": _PHP, "r": _R}
#: Words that are names as well, where a name is due.
_SOFT = {"js": {"get", "set", "of", "from", "async", "static", "default", "delete", "declare", "with", "in", "import", "return", "catch", "override", "readonly", "abstract"}, "java": {"record", "sealed", "permits"}, "rs": {"default", "union"}, "go": set(), "py": set(),
         "c": {"override", "final"}, "cs": {"partial", "record", "where", "async"}, "php": {"new", "use", "echo", "throw", "readonly", "enum"}, "r": set()}
_NOT_ANY = {
    "js": {"{", "}", "(", ")", ";", "=", "=>", "<", ">", ":", "class", "function", "const", "let", "var", "export", "return"}, "go": {"{", "}", "(", ")", ";", "=", ":=", "interface", "struct", "func", "return"},
    "java": {"{", "}", "(", ")", ";", "=", "<", ">", "class", "interface", "enum", "return", "new"}, "rs": {"{", "}", "(", ")", "[", "]", ";", "=", "<", ">", "->", "where", "for", "fn", "impl", "trait", "mod", "pub", "let", "return"}, "py": {":", "nl", "(", ")", "[", "]", "str", "def", "class"},
    "c": {"{", "}", "(", ")", "[", "]", ";", "=", "<", ">", "::", "class", "struct", "union", "enum", "namespace", "return", "const", "operator", "typedef", "using", "template", "final", "if", "for", "while"}, "cs": {"{", "}", "(", ")", ";", "=", "=>", "<", ">", "class", "interface", "struct", "namespace", "return", "where", "new", "using"},
    "php": {"{", "}", "(", ")", ";", "=", "=>", "class", "function", "return", "static", "extends", "implements"}, "r": {"{", "}", "(", ")"},
}


def _fits(lang: str):
    soft, not_any = _SOFT[lang], _NOT_ANY[lang]

    def fits(symbol: str, kind: str) -> bool:
        if symbol == "name":
            return kind == "id" or kind in soft
        if symbol == "any":
            return kind not in not_any and kind != ""
        if symbol in ("()", "{}", "[]", "{?"):
            return kind == symbol[0]
        return symbol in ("rest", "line") or kind == symbol

    return fits


@lru_cache(maxsize=None)
def _parser(lang: str) -> Parser:
    return Parser(_GRAMMARS[lang], _fits(lang))


class Stretch:
    """The tokens of a file or of the body of a class, as the grammar reads them."""

    def __init__(self, outline: Outline, lang: str, lo: int, hi: int):
        self.outline, self.lang, self.parser = outline, lang, _parser(lang)
        self.t = outline.tokens(lang, lo, hi)
        self.size = len(self.t.kinds) - 1
        self.soft, self.not_any = _SOFT[lang], _NOT_ANY[lang]
        self.mended: dict[int, int] = {}
        self.state = State()

    @cached_property
    def starts(self) -> list[int]:
        return [j for j in range(self.size) if not j or self.t.lines[j] != self.t.lines[j - 1]]

    def parse(self, what: str, i: int) -> Ends:
        return self.parser.parse(what, i, self.t.kinds, self.step, self.state)

    def step(self, symbol: str, i: int) -> int:
        t = self.t
        kind = t.kinds[i]
        if symbol == "name":
            return i + 1 if kind == "id" or kind in self.soft else -1
        if symbol == "any":
            return i + 1 if kind and kind not in self.not_any else -1
        if symbol in ("()", "{}", "[]"):
            return t.match.get(i, -2) + 1 if kind == symbol[0] else -1
        if symbol == "{?":
            return self._unclosed(i) + 1 if kind == "{" and i not in t.match else -1
        if symbol == "rest":
            return self._rest(i)
        if symbol == "line":
            while i < self.size and t.kinds[i] != "nl":
                i += 1
            return i + 1 if i < self.size else -1
        return i + 1 if kind == symbol and i < self.size else -1

    def _unclosed(self, i: int) -> int:
        """Where a brace that is never closed ends: before the next line that begins no deeper than its own."""
        if i not in self.mended:
            t = self.t
            k = bisect_right(self.starts, i) - 1
            own, end = t.columns[self.starts[k]], self.size - 1
            for j in self.starts[k + 1:]:
                if t.columns[j] <= own:
                    end = j - 1 if t.kinds[j] != "}" else j
                    break
            self.mended[i] = end
        return self.mended[i]

    def _rest(self, i: int) -> int:
        """Past an expression: to the end of its line or its semicolon, over brackets."""
        t = self.t
        line = t.lines[min(i, self.size - 1)]
        while i < self.size:
            if t.kinds[i] == ";":
                return i + 1
            if t.kinds[i] in (")", "}", "]") or t.lines[i] > line:
                return i
            if i in t.match:
                i = t.match[i]
                line = t.lines[i]
            i += 1
        return i

    @staticmethod
    def last(done: Ends, what: str, lo: int, hi: int) -> int:
        found = done.get(what, {})
        return next((i for i in range(hi, lo - 1, -1) if i in found and min(found[i]) <= hi), -1)

    @staticmethod
    def first_name(done: Ends, lo: int, hi: int) -> int:
        found = done.get("Name", {})
        return next((i for i in range(lo, hi) if i in found), -1)

    def _notes(self, done: Ends, lo: int, core: int) -> set[int]:
        """The lines that annotations before a declaration take."""
        lines: set[int] = set()
        found = done.get("Note", {})
        for i in range(lo, core):
            if i in found:
                end = max((e for e in found[i] if e <= core), default=i + 1)
                lines.update(range(self.t.lines[i], self.t.lines[end - 1] + 1))
        return lines

    def doc(self, done: Ends, lo: int, name: int) -> str:
        """The comment that ends right above, annotations aside."""
        t = self.t
        core = name
        notes = self._notes(done, lo, name)
        while core > lo and (t.lines[core - 1] == t.lines[name] or t.lines[core - 1] not in notes):
            core -= 1
        if core and t.lines[core - 1] == t.lines[core]:
            return ""
        line = t.lines[core] - 1
        while line > 0:
            if line in self.outline.comments:
                return self.outline.comments[line][1]
            if line not in notes:
                return ""
            line -= 1
        return ""

    def function(self, done: Ends, is_: set[str], i: int, end: int, owner: str) -> Iterator[Function]:
        t = self.t
        if self.lang == "r" or self.lang == "js" and "Arrow" in is_:
            name = self.first_name(done, i, end)
        else:
            name = self.last(done, "Sig", i, end)
        if name < 0:
            return
        text, at = t.texts[name], name
        if self.lang == "go" and "Method" in is_:
            owner = self._receiver(i + 1)
        elif self.lang == "c":
            at = next((k for k in range(end - 1, name - 1, -1) if any(t.kinds[e] == "(" for e in done["Name"].get(k, ()))), name)
            last = max((e for e in done["Name"].get(at, ()) if t.kinds[e] == "("), default=at + 1)
            text = "".join(t.texts[at:last])
            if at > name:
                words = [t.texts[j] for j in range(name, at) if t.kinds[j] == "id" and t.kinds[j + 1] in ("::", "<")]
                depth, words = 0, []
                for j in range(name, at):
                    depth += (t.kinds[j] == "<") - (t.kinds[j] == ">")
                    if not depth and t.kinds[j] == "id":
                        words.append(t.texts[j])
                owner = ".".join(([owner] if owner else []) + words)
        elif self.lang == "cs":
            text = "".join(t.texts[name:name + 2]) if t.kinds[name] == "~" else text
        elif self.lang == "r":
            text = text.strip("`\"'")
        yield Function(text, owner, t.lines[at], self.doc(done, i, at))

    def skip(self, i: int, begin: set[str], what: str) -> int:
        """Inside a class, what does not parse is skipped with its brackets; elsewhere up to where a statement or a
        declaration may begin."""
        t = self.t
        if i >= self.size:
            return i
        line = t.lines[i]
        if what == "Member":
            while i < self.size and t.lines[i] == line and t.kinds[i] != ";":
                if i in t.match:
                    i = t.match[i]
                    line = t.lines[i]
                i += 1
            return i + (i < self.size and t.kinds[i] == ";")
        i += 1
        while i < self.size and t.lines[i] == line and t.kinds[i - 1] not in (";", "{", "}") and t.kinds[i] not in begin:
            i += 1
        return i

    def owner(self, done: Ends, i: int, body: int, end: int) -> str:
        t = self.t
        if self.lang == "rs" and end in done.get("Impl", {}).get(i, ()):
            at = self.last(done, "Owner", i, body)
            words = []
            for j in range(max(at, i), body):
                if t.kinds[j] == "<" or t.kinds[j] == "where":
                    break
                if t.kinds[j] == "id":
                    words.append(t.texts[j])
            return words[-1] if words else ""
        name = self.first_name(done, i, body)
        if name < 0 and self.lang == "c" and end < self.size and t.kinds[end] == "id":
            name = end
        return t.texts[name] if name >= 0 else ""

    def _receiver(self, i: int) -> str:
        t, words = self.t, []
        inner = self.outline.tokens(self.lang, t.offsets[i] + 1, t.offsets[t.match[i]])
        for kind, text in zip(inner.kinds, inner.texts):
            if kind == "[":
                break
            if kind == "id":
                words.append(text)
        return words[-1] if words else ""


def _walk(outline: Outline, lang: str) -> Iterator[Function]:
    """The functions of a file, inside classes as deep as these go: the bodies that are still to be read lie on a stack."""
    todo = [(0, len(outline.text), "Item", "")]
    parser = _parser(lang)
    begins = {w: parser.starts((w,)) for w in ("Item", "Member") if w in _GRAMMARS[lang]}
    while todo:
        lo, hi, what, owner = todo.pop()
        if what not in begins:
            continue
        st = Stretch(outline, lang, lo, hi)
        t, begin, i = st.t, begins[what], 0
        while i < st.size:
            if not parser.open(what, t.kinds[i]) or (i and t.kinds[i - 1] in (".", "new", "return")):
                i += 1
                continue
            done = st.parse(what, i)
            end = max(done.get(what, {}).get(i, ()), default=-1)
            if end < 0:
                # What only precedes a declaration is stepped over at once, and so is what C takes for its type: a declaration
                # that began inside would have been found from here.
                before = max(done.get("Mods", {}).get(i, ()), default=i)
                i = st.skip(max(done["Type"].get(before, ()), default=before) if lang == "c" and "Type" in done else before, begin, what)
                continue
            is_ = {c for c in ("Class", "Impl", "Trait", "Module", "Field", "Method", "Arrow", "Fn") if end in done.get(c, {}).get(i, ())}
            if is_ & {"Class", "Impl", "Trait", "Module"}:
                body = st.last(done, "Body", i, end)
                inner = st.owner(done, i, body, end)
                stop = t.offsets[end - 1] if body in t.match else t.offsets[end] if end < st.size else hi
                todo.append((t.offsets[body] + 1, stop, "Item", owner) if "Module" in is_ else (t.offsets[body] + 1, stop, "Member", f"{owner}.{inner}" if owner else inner))
            elif "Field" not in is_ or is_ & {"Method", "Arrow"}:
                yield from st.function(done, is_, i, end, owner)
            i = max(end, i + 1)


def _python(outline: Outline) -> Iterator[Function]:
    """The functions of a Python file: only lines that begin a declaration are read in full."""
    lines, text, k = outline.logical, outline.text, 0
    scopes: list[tuple[int, str, str]] = []
    in_def = 0
    while k < len(lines):
        at, column = lines[k]
        while scopes and column <= scopes[-1][0]:
            in_def -= scopes.pop()[1] == "def"
        if not _PY_HEAD.match(text, at):
            k += 1
            continue
        j = k
        while text[lines[j][0]] == "@" and j + 1 < len(lines):
            j += 1
        hi = lines[j + 1][0] if j + 1 < len(lines) else len(text)
        st = Stretch(outline, "py", at, hi)
        t, done = st.t, st.parse("Item", 0)
        end = max(done.get("Item", {}).get(0, ()), default=-1)
        if end < 0:
            k = max(j, k + 1)
            continue
        core = max(i for nt in ("Def", "Class") for i, e in done.get(nt, {}).items() if end in e)
        name, is_class = max(done["Name"]), t.kinds[core] == "class"
        if not is_class and not in_def:
            yield Function(t.texts[name], ".".join(s[2] for s in scopes), t.lines[name], _docstring(outline, t.offsets[end - 1] + 1) or st.doc(done, 0, core))
        scopes.append((t.columns[core], "class" if is_class else "def", t.texts[name]))
        in_def += not is_class
        k = j + 1


def _docstring(outline: Outline, at: int) -> str:
    """The string that opens a body, marked so that an empty one is not taken for none."""
    find, text, first = _LEX["py"].match, outline.text, None
    while at < len(text):
        m = find(text, at)
        kind, at = m.lastgroup, m.end()
        if kind is None:
            break
        if first is not None:
            if kind == "cm":
                continue
            if kind != "nl" and m.group(kind) != ";":
                return ""
            break
        if kind == "str":
            first = m.group(kind)
        elif kind not in ("nl", "cm"):
            return ""
    if first is None or re.match(r"[rRuU]*[bBfF]", first):
        return ""
    s = re.sub(r"^[rRuU]*", "", first)
    q = s[:3] if s[:3] in ('"""', "'''") else s[:1]
    return '"""' + (s[len(q):-len(q)] if len(s) >= 2 * len(q) and s.endswith(q) else s[len(q):])


def functions(text: str, lang: str) -> Iterator[Function]:
    outline = Outline(text, lang)
    return _python(outline) if lang == "py" else _walk(outline, lang)


_TAG = re.compile(r"^\s*(?:[@\\](?:param|params|arg|args|argument|return|returns|retval|throws?|exception|raises?|yields?|type|typedef|template|see|since|deprecated|author|version|example|property|prop|this|override|inheritdoc|public|private|protected|internal|todo)\b|:(?:param|parameter|arg|argument|key|keyword|return|returns|rtype|raises?|type|yields?)\b[^:]*:|(?:args?|arguments?|parameters?|params?|returns?|raises?|throws?|yields?|examples?|errors?|panics?|safety)\s*:\s*$|#+\s*(?:arguments?|parameters?|returns?|errors?|examples?|panics?|safety)\s*$|(?:parameters?|returns?|raises|yields)\s*$)", re.I)
_INLINE_TAG = re.compile(r"\s(?:@(?:param|return|returns|throws|raises)\b|:(?:param|return|returns|rtype|raises)\b).*$", re.I | re.S)
_TODO = re.compile(r"^\W*(?:to-?do|fixme|xxx|hack|tbd|wip)\b", re.I)
_TOOL = re.compile(r"^\W*(?:eslint|tslint|jshint|jslint|prettier|biome|deno-lint|istanbul|c8 ignore|v8 ignore|noqa|nolint|nosec|nosonar|sonar|golangci|revive|lint[:-]|go:|\+build|checkstyle|pmd|spotbugs|findbugs|noinspection|suppress|clippy|rustfmt|cbindgen|pylint|flake8|mypy|pyright|type:\s*ignore|pragma|fmt:|yapf|isort|ruff|black:|coverage|ts-(?:ignore|expect|nocheck|check)|@ts-|@flow|jscpd|cspell|spell-?checker|webpack|region\b|endregion\b|sourcemappingurl|vim:|-\*-|editorconfig)", re.I)
_LICENCE = re.compile(r"\(c\)\s|©|\bcopyright\b|\blicen[cs]ed? (?:under|by|to)\b|\b(?:MIT|BSD|Apache|GPL|MPL|ISC)\b.*\blicen[cs]e|\blicensed (?:MIT|BSD|Apache|GPL)|\ball rights reserved\b|\bas is, without warranty\b|\bspdx-", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[}{)\]]|^\s*(?:if|elif|for|while|switch|match|with)\b.*[:{]\s*$|^\s*(?:return|const|let|var|func|fn|class|raise|throw|await|package|public|private)\b[^.]*[;={]"
    r"|^\s*(?:from\s+\S+\s+)?import\s+[\w.{}*, ]+;?\s*$|^\s*(?:async\s+)?def\s+\w+\s*\(|^\s*[\w.$\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S|^\s*[\w.$]+\([^()]*\)\s*;?\s*$|=>|&&|\|\|")
_XML, _XML_TAG = re.compile(r"</?[A-Za-z][^<>]*>"), re.compile(r"^\s*<(?:param|typeparam|returns?|exception|value|example|seealso)\b", re.I)
_RULER = re.compile(r"^[\W_]*$")


def description(doc: str, name: str = "") -> str:
    """What a comment or docstring says of its function, before any tags: without marks of the comment, rulers, to-do
    marks, disabled code, directives to tools and licence texts. Empty if nothing is left."""
    if doc.startswith('"""'):
        lines = doc[3:].splitlines()
    elif doc.startswith("/*"):
        body = re.sub(r"\*+/\s*$", "", doc[2:])
        lines = [re.sub(r"^\s*[*!]+", "", s) for s in body.splitlines()]
    else:
        lines = [re.sub(r"^\s*(?://+[!/]?|#+['!]?)", "", s) for s in doc.splitlines()]
    if doc.startswith("///"):
        lines = [s if _XML_TAG.match(s) else _XML.sub(" ", s) for s in lines]
    if _LICENCE.search("\n".join(lines)):
        return ""
    out, todo = [], False
    for s in lines:
        if _RULER.match(s):
            todo = todo and bool(s.strip())
            continue
        if _TAG.match(s) or _XML_TAG.match(s):
            break
        if _TODO.match(s):
            todo = True
        if todo or _TOOL.match(s) or _CODE.search(s):
            continue
        tagged = _INLINE_TAG.search(s)
        out.append(s[:tagged.start()] if tagged else s)
        if tagged:
            break
    return " ".join(" ".join(out).split())


_WORD = re.compile(r"[^\W_](?:[\w'’`().-]*\w)?")


def words(text: str) -> int:
    return len(_WORD.findall(text))


def extract(path: str, text: str) -> Iterator[tuple[str, str, str, int, str]]:
    """(id, name, language, line, description) of each function or method of a file; a language that is not known or a
    file without any gives nothing."""
    lang = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if not lang or not text:
        return
    for f in functions(text.replace("\r\n", "\n"), lang):
        own = f"{f.owner}.{f.name}" if f.owner else f.name
        yield f"{path}::{own}", f.name, lang, f.line, description(f.doc, f.name)


def function_docs(sources: DataFrame, path: str = "path", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, name, line, description): functions with a description of at least ``least_words`` words.

    Descriptions are then counted over the whole collection by hash; one that stands on many differently named
    functions of several projects says nothing of any of them and is dropped as a template (``TEMPLATE_NAMES`` names,
    ``TEMPLATE_PROJECTS`` projects, ``TEMPLATE_SHARE`` of all documented functions). Copies of one function do not
    make a template, since they share its name.

    Null paths and null or empty texts give nothing. Repeated rows are one; of several declarations with one id the
    first that is documented is taken. Files that are broken give the functions that can be read. Files of any
    length are read whole, once: what is found goes to the shared folder. Extra columns are ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(i, n, line, d) for i, n, _, line, d in extract(p, s) if words(d) >= least_words]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["id", "name", "line", "description"])

    given = sources.select(F.col(path).cast("string"), F.col(text).cast("string")).where(F.col(path).isNotNull() & F.col(text).isNotNull())
    found = given.mapInArrow(read, "id string, name string, line int, description string")
    found = found.groupBy("id").agg(F.min(F.struct("line", "name", "description")).alias("f")).select("id", "f.name", "f.line", "f.description")
    plain = F.lower(F.trim(F.regexp_replace("description", r"[^\p{L}]+", " ")))
    found = cut(found.withColumn("h", F.xxhash64(plain)))
    stats = found.groupBy("h").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.substring_index("id", "/", 1)).alias("projects"))
    total = found.agg(F.count("*").alias("n")).scalar()
    templates = stats.where((F.col("names") >= TEMPLATE_NAMES) & (F.col("projects") >= TEMPLATE_PROJECTS)).withColumn("all", total).where(F.col("names") >= TEMPLATE_SHARE * F.col("all")).select("h")
    return found.join(templates, "h", "left_anti").select("id", "name", "line", "description")
