"""Objects in loosely written text: JSON with slips, Python literals, and flow and block YAML mappings, read in one pass."""

from __future__ import annotations

import html
import json
import re

#: Nesting up to which a text is read; deeper ones have no object.
DEEPEST = 200

_SPACE = re.compile(r"\s*")
_CLOSES = re.compile(r"\s*(?:[:,}\]]|\Z)")
_RUN = re.compile(r'[^"\\]*')
_BARE = re.compile(r"[^,\[\]{}\n]*")
_KEY = re.compile(r"[^:,\[\]{}\n]*")
_INT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)\Z")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9_]+|[0-9][0-9_]*(?=[eE]))(?:[eE][-+]?[0-9]+)?\Z")
_PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Plain words with a meaning of their own, in lower case.
_WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "none": None, "~": None, "": None}


def scalar(text: str):
    """A plain (unquoted) scalar: word, number or text."""
    text = text.strip()
    if text.lower() in _WORDS and (text.islower() or text.istitle() or text.isupper() or text in ("~", "")):
        return _WORDS[text.lower()]
    if _INT.match(text):
        return int(text.replace("_", ""))
    if _FLOAT.match(text):
        found = float(text.replace("_", ""))
        return found if abs(found) != float("inf") else text
    if text[0] in "&*!%@`|>":
        raise ValueError("a mark of another language")
    return text


class Reader:
    """Reads one value from a place in a text.

    Whether a double quote closes its string is told by what follows: a colon, comma, closing bracket or the end does, unless an
    inner quotation is open, which the next quote ends. So strings hold unescaped quotations.
    """

    def __init__(self, text: str, at: int = 0) -> None:
        self.text, self.at = text, at

    def skip(self) -> str:
        """The next character that isn't white space; empty at the end."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0):
        if depth > DEEPEST:
            raise ValueError("too deep")
        c = self.skip()
        if c == "{":
            return self.mapping(depth)
        if c == "[":
            return self.sequence(depth)
        if c in ('"', "'") and c:
            return self.quoted()
        found = _BARE.match(self.text, self.at)
        self.at = found.end()
        return scalar(found[0])

    def quoted(self) -> str:
        return self._double() if self.text[self.at] == '"' else _folded(self._single())

    def _double(self) -> str:
        out, text, inner = [], self.text, False
        self.at += 1
        while True:
            run = _RUN.match(text, self.at)
            out.append(_folded(run[0]))  # escaped line breaks stay
            self.at = run.end() + 1
            if run.end() >= len(text):
                raise ValueError("a string without end")
            if text[run.end()] == "\\":
                self._escape(out)
            elif inner or not _CLOSES.match(text, self.at):
                out.append('"')
                inner = not inner
            else:
                return _PAIR.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))

    def _escape(self, out: list[str]) -> None:
        c = self.text[self.at : self.at + 1]
        self.at += 1
        if c == "u":
            digits = self.text[self.at : self.at + 4]
            self.at += 4
            code = int(digits, 16) if re.fullmatch("[0-9a-fA-F]{4}", digits) else -1
            if code < 0:
                raise ValueError("an escape without its digits")
            out.append(chr(code))
        else:
            out.append(_ESCAPES.get(c, c))

    def _single(self) -> str:
        out, text = [], self.text
        while True:
            end = text.find("'", self.at + 1)
            if end < 0:
                raise ValueError("a string without end")
            out.append(text[self.at + 1 : end])
            self.at = end + 1
            if text[self.at : self.at + 1] != "'":
                return "'".join(out)

    def sequence(self, depth: int) -> list:
        out = []
        self.at += 1
        while (c := self.skip()) != "]":
            out.append(self.value(depth + 1))
            self._next("]")
        self.at += 1
        return out

    def mapping(self, depth: int) -> dict:
        out = {}
        self.at += 1
        while (c := self.skip()) != "}":
            if c in ('"', "'") and c:
                key = self.quoted()
            else:
                found = _KEY.match(self.text, self.at)
                self.at, key = found.end(), found[0].strip()
                if not key:
                    raise ValueError("no key")
            if self.skip() == ":":
                self.at += 1
                out[key] = None if self.skip() in (",", "}") else self.value(depth + 1)
            else:
                out[key] = None
            self._next("}")
        self.at += 1
        return out

    def _next(self, close: str) -> None:
        c = self.skip()
        if c == ",":
            self.at += 1
        elif c != close:
            raise ValueError("neither a comma nor an end")


def _folded(text: str) -> str:
    """Line breaks in a quoted string: one is a space, of more one is left out."""
    return text if "\n" not in text else re.sub(r"[ \t]*\n((?:[ \t]*\n)*)[ \t]*", lambda m: "\n" * m[1].count("\n") or " ", text)


def whole(text: str):
    """The value that a text is, with nothing after it."""
    reader = Reader(text)
    found = reader.value()
    if reader.skip():
        raise ValueError("more than a value")
    return found


_ITEM = re.compile(r"-(?:\s+|\Z)")
_PLAIN_KEY = re.compile(r"((?:[^:#]|:(?=\S)|(?<!\s)#)*?)\s*:(?:\s+|\Z)")
_COMMENT = re.compile(r"(?:\A|\s+)#.*")


class Block:
    """A block YAML document: mappings and sequences by indentation."""

    def __init__(self, text: str) -> None:
        lines = [x.expandtabs() for x in text.split("\n") if x.strip() not in ("---", "...")]
        self.lines = [(len(x) - len(x.lstrip()), x.strip()) for x in lines]
        self.raw, self.at = lines, 0

    def _peek(self) -> tuple[int, str]:
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1].startswith("#")):
            self.at += 1
        return self.lines[self.at] if self.at < len(self.lines) else (-1, "")

    def read(self):
        found = self.node(self._peek()[0], 0)
        if self._peek()[0] >= 0:
            raise ValueError("a line that belongs to nothing")
        return found

    def node(self, indent: int, depth: int):
        if depth > DEEPEST:
            raise ValueError("too deep")
        return self.sequence(indent, depth) if _ITEM.match(self._peek()[1]) else self.mapping(indent, depth)

    def sequence(self, indent: int, depth: int) -> list:
        out = []
        while (now := self._peek())[0] == indent and (mark := _ITEM.match(now[1])):
            rest, inner = now[1][mark.end() :], indent + mark.end()
            if rest and (_ITEM.match(rest) or self._key(rest)):
                self.lines[self.at] = (inner, rest)  # the item's first line stands where it stands
                out.append(self.node(inner, depth + 1))
            else:
                out.append(self.after(rest, indent, depth))
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out = {}
        while (now := self._peek())[0] == indent and not _ITEM.match(now[1]):
            found = self._key(now[1])
            if not found:
                raise ValueError("a line without a key")
            out[found[0]] = self.after(found[1], indent, depth, True)
        if not out or self._peek()[0] > indent:
            raise ValueError("a line further in than its place")
        return out

    @staticmethod
    def _key(line: str) -> tuple[str, str] | None:
        if line[:1] in ('"', "'"):
            reader = Reader(line)
            try:
                key = reader.quoted()
            except ValueError:
                return None
            rest = re.match(r"\s*:(?:\s+|\Z)", line[reader.at :])
            return (key, line[reader.at + rest.end() :]) if rest else None
        found = _PLAIN_KEY.match(line)
        return (found[1], line[found.end() :]) if found and found[1] and line[0] not in "[{&*!%@`|>" else None

    def after(self, rest: str, indent: int, depth: int, key: bool = False):
        """The value whose first line, after its key or mark, is `rest`."""
        self.at += 1
        if re.match(r"[|>][-+0-9]*\s*\Z", rest):
            return self._text(rest, indent)
        quoted = rest[:1] in ("'", '"', "[", "{") and rest[:1] != ""
        rest = rest if quoted else _COMMENT.sub("", rest)
        if not rest:
            now = self._peek()
            deeper = now[0] > indent or key and now[0] == indent and _ITEM.match(now[1])
            return self.node(now[0], depth + 1) if deeper else None
        parts = [rest]
        while self.at < len(self.lines) and (self.lines[self.at][0] > indent or not self.lines[self.at][1]):
            line = self.lines[self.at][1]
            parts.append(line if quoted else _COMMENT.sub("", line))
            self.at += 1
        if quoted:
            return whole(_COMMENT.sub("", "\n".join(parts)) if rest[0] in "[{" and "#" in rest else "\n".join(parts).strip())
        plain = _folded("\n".join(parts).strip())
        if re.search(r":(?:\s|\Z)", plain):
            raise ValueError("a key within a scalar")
        return scalar(plain)

    def _text(self, mark: str, indent: int) -> str:
        lines = []
        while self.at < len(self.lines) and (self.lines[self.at][0] > indent or not self.lines[self.at][1]):
            lines.append(self.raw[self.at] if self.lines[self.at][1] else "")
            self.at += 1
        margin = min((len(x) - len(x.lstrip()) for x in lines if x), default=0)
        body = "\n".join(x[margin:] for x in lines).rstrip("\n")
        body = _folded(body) if mark[0] == ">" else body
        return body if "-" in mark else body + "\n" * bool(body)


_TAGGED = re.compile(r"(?s)<([a-z_]*(?:json|result)[a-z_]*)>(.*?)</\1>")
_FENCE = re.compile(r"```(?:[a-zA-Z]*\n)?")


def read_object(text: str | None) -> dict | None:
    """The object in a loosely written text: strict JSON, then the span from the first to the last brace read loosely, then a block YAML mapping, then the first strict object anywhere; None if there is none."""
    if not text:
        return None
    body = html.unescape(text.replace("\\_", "_"))
    tagged = _TAGGED.search(body)
    body = _FENCE.sub("", tagged[2] if tagged else body).strip()
    if not body:
        return None
    lo, hi = body.find("{"), body.rfind("}")
    braced = 0 <= lo < hi
    block = body[lo : hi + 1] if braced else body
    for read in (lambda: json.loads(body), lambda: whole(block) if braced else None, lambda: Block(block).read()):
        try:
            found = read()
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    strict = json.JSONDecoder()
    for m in re.finditer(r"\{", body):
        try:
            return strict.raw_decode(body, m.start())[0]
        except (ValueError, RecursionError):
            continue
    return None


def repaired(text: str | None) -> str | None:
    """That object as canonical JSON."""
    found = read_object(text)
    try:
        return None if found is None else json.dumps(found, sort_keys=True, allow_nan=False)
    except (ValueError, RecursionError):
        return None
