"""Operator 3: secrets by assignment-aware lexing.

Beside the base patterns, each text is lexed as source code or configuration: names and the literals assigned to them are
paired, a name that is assigned another name takes over that one's literal (constants are propagated, through any number of
steps, through joined literals and the braces of formatted ones), and each literal is scored by what its target name says and how random it looks.
Literals at or above the threshold become spans of kind ``literal``. What stands in comments is lexed like all else.

One pass over the texts without a shuffle; a text is lexed only if it holds a sensitive stem at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clusterloom.llm.common import map_texts, sha256, spans_digest

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Parts of names whose literals are secret, with the weight that each gives.
STEMS = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "secret": 0.6, "token": 0.5, "apikey": 0.6, "api_key": 0.6,
    "access_key": 0.6, "private_key": 0.6, "credential": 0.5, "auth": 0.4, "signing": 0.4,
}
#: Fixed value: the same for a whole word of a name (``encryption_key``, not ``keyword``).
WORDS = {"key": 0.36}

_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "signing")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
_LEX = re.compile(rf"""(?P<quote>["'])|(?P<name>{_NAME})|(?P<op>:=|=>|==|!=|<=|>=|\|\||\?\?|[=:+,;(){{}}\[\]])|(?P<bare>[A-Za-z0-9+/_.=-]{{8,}}+)|(?P<line>\n)""", re.ASCII)
#: The rest of a string on its line, behind the opening quote.
_REST = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"}
#: What may stand before a quote that opens a string; letters such as those of r"" and b"" may come between.
_OPENERS = frozenset("=:,([{+>|?\n")
#: So do these words.
_BEFORE = re.compile(r"(?<![A-Za-z0-9_$])(?:or|else)$")
_PREFIXES = frozenset({"r", "b", "f", "u", "rb", "br", "fr", "rf"})
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|<.*>|\$\{.*\}|changeme|example|none|null|true|false|your[-_ ].*)$", re.IGNORECASE)


@dataclass(frozen=True)
class Scoring:
    min_length: int = 8
    threshold: float = 0.75


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in the order of the kinds."""
    low = text.lower()
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in _WORDS) else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _opens(text: str, start: int) -> bool:
    """Whether a quote at ``start`` opens a string: behind an operator, a bracket, a comma or a line's start."""
    k = start - 1
    while k >= 0 and text[k] in " \t":
        k -= 1
    return k < 0 or text[k] in _OPENERS or (text[k] in "re" and bool(_BEFORE.search(text, max(0, k - 5), k + 1)))


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of names, strings, bare words, operators and line ends.

    Three quotes open a string that goes over lines; an apostrophe inside a sentence is just a mark.
    """
    out: list[tuple[str, str, int, int]] = []
    unclosed: dict[str, int] = {}  # up to here no string of this quote ends
    at = 0
    while m := _LEX.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind != "quote":
            out.append((kind, m[0], start, at))
            continue
        quote, prefix = m[0], out[-1] if out else None
        if prefix and prefix[0] == "name" and prefix[3] == start and prefix[1].lower() in _PREFIXES and _opens(text, prefix[2]):
            out.pop()
        elif not _opens(text, start):
            continue
        if text.startswith(quote * 3, start) and quote * 3 not in unclosed:
            end = text.find(quote * 3, start + 3)
            if end >= 0:
                out.append(("string", text[start + 3 : end], start + 3, end))
                at = end + 3
                continue
            unclosed[quote * 3] = len(text)
        if unclosed.get(quote, -1) <= start:
            rest = _REST[quote].match(text, at)
            if rest:
                out.append(("string", text[at : rest.end() - 1], at, rest.end() - 1))
                at = rest.end()
            else:
                end = text.find("\n", at)
                unclosed[quote] = end if end >= 0 else len(text)
    return out


class Literal:
    """A literal as far as its score needs it: how often each character occurs, its beginning and its last character; and
    where it was made of. Joining literals costs the same however long they are."""

    __slots__ = ("head", "last", "size", "counts", "places", "parts", "told")
    HEAD = 64

    def __init__(self, head: str, last: str, size: int, counts: Counter, places: tuple = (), parts: tuple = ()):
        self.head, self.last, self.size, self.counts, self.places, self.parts, self.told = head, last, size, counts, places, parts, False

    @classmethod
    def at(cls, value: str, start: int, end: int) -> Literal:
        return cls(value[: cls.HEAD], value[-1:], len(value), Counter(value), ((start, end),))

    @classmethod
    def joined(cls, parts: list[Literal]) -> Literal:
        if len(parts) == 1:
            return parts[0]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p.counts)
        head = "".join([p.head for p in parts])[: cls.HEAD]
        return cls(head, next((p.last for p in reversed(parts) if p.last), ""), sum([p.size for p in parts]), counts, (), tuple(parts))

    def tell(self) -> list[tuple[int, int]]:
        """The places that no earlier call told."""
        out, waiting = [], [self]
        while waiting:
            one = waiting.pop()
            if not one.told:
                one.told = True
                out += one.places
                waiting += one.parts
        return out


#: What assigns: a mapping's colon and arrow among them.
_ASSIGNS = frozenset({"=", ":", ":=", "=>"})
#: Words between the values of an alternative: either may be the one assigned.
_ALTERNATIVES = frozenset({"or", "||", "??"})
_FIELD = re.compile(r"\{([A-Za-z_$][A-Za-z0-9_$.-]*)\}", re.ASCII)

def _ways(tokens: list) -> dict[int, int]:
    """From each bracket to the place behind the one that closes it, and from each ``if`` to its line's next ``else``."""
    out, open_, last = {}, [], None
    for i, (kind, value, _, _) in enumerate(tokens):
        if kind == "op" and value in ("(", "[", "{"):
            open_.append(i)
        elif kind == "op" and value in (")", "]", "}") and open_:
            out[open_.pop()] = i + 1
    for i in range(len(tokens) - 1, -1, -1):
        kind, value = tokens[i][:2]
        if kind == "line":
            last = None
        elif kind == "name" and value == "else":
            last = i
        elif kind == "name" and value == "if" and last is not None:
            out[i] = last
    return out


def _target(tokens: list, ways: dict[int, int], i: int) -> tuple[str | None, str | None, int]:
    """(target's name, the constant that it sets, place of the value) of an assignment that starts at ``i``.

    A target is a name or a quoted key (``a = ``, ``"a": ``), a subscript by a literal key (``x["a"] = ``), or an annotated
    name (``a: str = ``, ``a: dict[str, int] = ``), whose annotation isn't the value.
    """
    kind, value = tokens[i][:2]
    if kind not in ("name", "string") or i + 2 >= len(tokens):
        return None, None, i
    at, name, constant = i + 1, value, value if kind == "name" else None
    if tokens[at][1] == "[" and tokens[at + 1][0] in ("string", "name") and kind == "name" and at + 3 < len(tokens) and tokens[at + 2][1] == "]":
        name, constant, at = tokens[at + 1][1], f"{value}[{tokens[at + 1][1]}]", at + 3
    if at >= len(tokens) or tokens[at][0] != "op" or tokens[at][1] not in _ASSIGNS:
        return None, None, i
    if tokens[at][1] == ":" and kind == "name" and at + 2 < len(tokens) and tokens[at + 1][0] == "name" and not _told_by_digits(tokens[at + 1][1]):
        end = at + 2
        if tokens[end][:2] == ("op", "["):
            end = ways.get(end, end)
        if end < len(tokens) and tokens[end][:2] == ("op", "="):
            at = end
    return name, constant, at + 1


def _told_by_digits(name: str) -> bool:
    """Whether a bare word that could be a name is taken for a literal."""
    return len(name) >= 8 and any(c.isdigit() for c in name)


def _value(tokens: list, ways: dict[int, int], j: int, constants: dict[str, Literal]) -> tuple[list[list[Literal]], bool, int]:
    """(alternatives, each the parts that it joins; whether there is one alone, wholly understood; place behind) of the value at ``j``.

    Brackets around a value are looked through; what is called or looked up is unknown, unless it is a known subscript; of
    ``a or b`` and ``a if c else b`` either ``a`` or ``b`` may be the value.
    """
    found, parts, known, depth = [], [], True, 0
    while j < len(tokens):
        k, v, a, b = tokens[j]
        if k == "op" and v == "(" or k == "line" and depth:
            depth, j = depth + (k == "op"), j + 1
            continue
        behind = ways.get(j + 1) if k == "name" and j + 1 < len(tokens) and tokens[j + 1][:2] in (("op", "("), ("op", "[")) else None
        if behind is not None:
            subscript = f"{v}[{tokens[j + 2][1]}]"
            if behind == j + 4 and tokens[j + 1][1] == "[" and subscript in constants:
                parts.append(constants[subscript])
            else:
                known = False
            j = behind
        else:
            if k == "string":
                parts.append(_formatted(v, a, b, constants))
            elif k == "bare" or k == "name" and v not in constants and not parts and _told_by_digits(v):
                parts.append(Literal.at(v, a, b))
            elif k == "name" and v in constants:
                parts.append(constants[v])
            else:
                known = False
            j += 1
        while depth and j < len(tokens) and (tokens[j][0] == "line" or tokens[j][:2] == ("op", ")")):
            depth, j = depth - (tokens[j][0] == "op"), j + 1
        if j >= len(tokens):
            break
        if tokens[j][:2] == ("op", "+"):
            j += 1
            continue
        if depth and tokens[j][0] == "string":  # strings side by side in brackets are one
            continue
        other = j if tokens[j][0] in ("name", "op") and tokens[j][1] in _ALTERNATIVES else ways.get(j) if tokens[j][:2] == ("name", "if") else None
        if other is None:
            break
        if known and parts:
            found.append(parts)
        parts, known, j = [], True, other + 1
    if known and parts:
        found.append(parts)
    return found, known and len(found) == 1, j


def _formatted(value: str, start: int, end: int, constants: dict[str, Literal]) -> Literal:
    """A string with the constants that its braces name put in; their places are its places too."""
    parts, at = [], 0
    if "{" not in value:
        return Literal.at(value, start, end)
    for m in _FIELD.finditer(value):
        if m[1] in constants:
            if m.start() > at:
                parts.append(Literal.at(value[at : m.start()], start + at, start + m.start()))
            parts.append(constants[m[1]])
            at = m.end()
    if not parts:
        return Literal.at(value, start, end)
    if at < len(value):
        parts.append(Literal.at(value[at:], start + at, end))
    return Literal.joined(parts)


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(target name, literal) of every assignment, constants propagated.

    Beside assignments, a call whose first argument is a quoted name gives that name its second argument if that is a
    literal: ``set("a", "b")``.
    """
    tokens = lex(text)
    ways = _ways(tokens)
    constants: dict[str, Literal] = {}
    out = []
    i = 0
    while i + 2 < len(tokens):
        kind, value = tokens[i][:2]
        if kind == "string" and tokens[i - 1][:2] == ("op", "(") and i > 1 and tokens[i - 2][0] == "name" and tokens[i + 1][:2] == ("op", ",") and tokens[i + 2][0] in ("string", "name"):
            k, v, a, b = tokens[i + 2]
            if k == "string":
                out.append((value, _formatted(v, a, b, constants)))
            elif v in constants:
                out.append((value, constants[v]))
            i += 3
            continue
        name, constant, j = _target(tokens, ways, i)
        if name is None:
            i += 1
            continue
        found, whole, j = _value(tokens, ways, j, constants)
        literals = [Literal.joined(parts) for parts in found]
        out += [(name, literal) for literal in literals]
        if constant is not None and whole:
            constants[constant] = literals[0]
        # What an annotation seems to be may be a target of its own: "ticket: signing_key = ...".
        i = j if whole and tokens[i + 1][1] != ":" else i + 1
    return out


def entropy(counts: Counter, size: int) -> float:
    return -sum(c / size * math.log2(c / size) for c in counts.values()) if size else 0.0


def _is_placeholder(literal: Literal) -> bool:
    if literal.size <= Literal.HEAD:
        return bool(_PLACEHOLDER.match(literal.head))
    # Of a longer one the characters, the beginning and the end tell.
    return set(literal.counts) <= {"x", "X"} or set(literal.counts) == {"*"} or bool(_PLACEHOLDER.match(literal.head + literal.last)) and literal.head[0] in "<$yY"


def score(name: str, literal: Literal) -> float:
    """0 to 1: by the target name's stems, and the literal's randomness a character."""
    if literal.counts[" "] or _is_placeholder(literal):
        return 0.0
    spread = re.sub(r"([a-z])([A-Z])", r"\1_\2", name).replace("-", "_").replace(".", "_").lower()
    spread = re.sub("author(?!i)", "", spread)
    of_name = max((w for stem, w in STEMS.items() if stem in spread), default=0.0)
    of_name = max((WORDS[w] for w in WORDS.keys() & set(spread.split("_"))), default=of_name) if not of_name else of_name
    mixed = any(c.isdigit() for c in literal.counts) and any(c.isalpha() for c in literal.counts)
    random = min(1.0, entropy(literal.counts, literal.size) / 4) * (0.7 + 0.3 * mixed)
    return min(1.0, of_name + 0.4 * random) if of_name else 0.0


def literal_spans(text: str, how: Scoring = Scoring()) -> list[tuple[int, str, int]]:
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    found = set()
    for name, literal in pairs(text):
        if literal.size >= how.min_length and score(name, literal) >= how.threshold:
            found |= {(a, "literal", b) for a, b in literal.tell() if b > a}
    return sorted(found)


FIELDS = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string", "n_literal": "bigint"}


def find_secrets(documents: DataFrame, how: Scoring = Scoring()) -> DataFrame:
    """Counts and spans of secrets in each row's whole text.

    Offsets count code points, ends are exclusive; a literal's span leaves out its quotes. Where an added span overlaps or
    equals a base one, both are told, the base one first. A null or empty text has none;
    repeated rows each get their row; an empty table gives no rows.
    """

    def make():
        def of_texts(texts):
            out = [[] for _ in FIELDS]
            for text in texts:
                base = base_spans(text)
                more = literal_spans(text, how)
                n = {k: sum(s[1] == k for s in base) for k in KINDS}
                for column, value in zip(out, (n["assign"], n["access"], n["hex"], sha256(spans_digest(base)), spans_digest(base + more), len(more)), strict=True):
                    column.append(value)
            return out

        return of_texts

    return map_texts(documents, make, FIELDS)
