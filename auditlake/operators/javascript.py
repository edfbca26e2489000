"""Findings in JavaScript and TypeScript sources, by their tokens.

There is no parser for these languages here, so calls are recognised from tokens: a name or a member chain
before a parenthesis, ``new`` before a name, and ``process.env``. Comments and the insides of strings,
regular expressions are no code; the expressions inside templates are. An object that is not one name (a chain, a call, an index) has
the name "?".
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import constants as C

_SECRET, _SENSITIVE = re.compile(C.SECRET_NAME), re.compile(C.SENSITIVE_JS_NAME)
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9.\-_]+)")
_KEYWORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield"}
#: What is a name to the scanner but no identifier, and what joins two operands.
_CONSTANTS = {"this", "true", "false", "null", "undefined", "super"}
_OPERATORS = set("+-*/%<>&|^")
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "with", "super", "import"}
COLUMNS = ["kind", "line", "detail", "host", "fqn", "env_name", "confidence"]
SCHEMA = "kind string, line int, detail string, host string, fqn string, env_name string, confidence string"


class Token:
    __slots__ = ("kind", "text", "at", "end", "inner")

    def __init__(self, kind: str, text: str, at: int, inner: bool = False):
        self.kind, self.text, self.at, self.end, self.inner = kind, text, at, at + len(text), inner


def _template(text: str, at: int) -> tuple[int, list[Token]]:
    """End of the template that begins at ``at``, and the tokens of the code inside it, each marked as inner."""
    inner, k = [], at + 1
    while k < len(text) and text[k] != "`":
        if text[k] == "\\":
            k += 2
        elif text.startswith("${", k):
            own = tokens(text, k + 2, True)
            inner += own
            k = (own[-1].end if own else k + 2)
            while k < len(text) and text[k] != "}":
                k += 1
            k += 1
        else:
            k += 1
    for t in inner:
        t.inner = True
    return min(k + 1, len(text)), inner


def tokens(text: str, at: int = 0, within: bool = False) -> list[Token]:
    """Tokens without white space and comments; a slash where an operand is due begins a regular expression.

    The code inside a template follows it. ``within`` ends at a closing brace that nothing here has opened.
    """
    out, open_ = [], 0
    while at < len(text):
        last = out[-1] if out else None
        if text[at] == "`":
            end, inner = _template(text, at)
            out += [Token("template", text[at:end], at), *inner]
            at = end
            continue
        if within and text[at] in "{}":
            open_ += 1 if text[at] == "{" else -1
            if open_ < 0:
                return out
        if text[at] == "/" and (last is None or (last.kind == "sign" and last.text not in ")]}") or last.text in _KEYWORDS):
            if m := _REGEX.match(text, at):
                out.append(Token("regex", m[0], at))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        if m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def _closing(ts: list[Token], i: int) -> int:
    """Place of the bracket that closes the one at ``i``, or the last place."""
    depth = 0
    for k in range(i, len(ts)):
        if ts[k].kind == "sign":
            depth += (ts[k].text in "([{") - (ts[k].text in ")]}")
            if depth == 0:
                return k
    return len(ts) - 1


def aliases(ts: list[Token]) -> dict[str, str]:
    """Names that ``const x = require('m')`` and the like bind; neither import statements nor destructuring bind any."""
    out = {}
    for i in range(len(ts) - 5):
        if ts[i].kind == "name" and ts[i + 1].text == "=" and ts[i + 2].text == "require" and ts[i + 3].text == "(" and ts[i + 4].kind == "string":
            out[ts[i].text] = ts[i + 4].text[1:-1]
    return out


def _chain(ts: list[Token], i: int) -> tuple[int, list[str]]:
    """Member chain that ends at token ``i``: where it begins, and its names; "?" for an object that isn't a name."""
    names = [ts[i].text]
    while i >= 2 and ts[i - 1].text in (".", "?."):
        i -= 2
        if ts[i].kind == "name":
            names.insert(0, ts[i].text)
            continue
        names.insert(0, "?")
        # a call or an index: its begin is that of what is called
        while i and ts[i].text in (")", "]"):
            i = max(0, _opening(ts, i))
            if i and (ts[i - 1].kind == "name" and ts[i - 1].text not in _KEYWORDS or ts[i - 1].text in (")", "]")):
                i -= 1
        if ts[i].kind != "name":
            break
    return i, names


def _opening(ts: list[Token], i: int) -> int:
    """Place of the bracket that opens the one closed at ``i``, or the first place."""
    depth = 0
    for k in range(i, -1, -1):
        if ts[k].kind == "sign":
            depth += (ts[k].text in ")]}") - (ts[k].text in "([{")
            if depth == 0:
                return k
    return 0


def member_kind(module: str, method: str) -> str | None:
    """What a method of a module does."""
    for modules, methods, kind in (
        (C.JS_SUBPROCESS_MODULES, C.JS_SUBPROCESS_METHODS, "subprocess"),
        (C.JS_NETWORK_MODULES, C.JS_NETWORK_METHODS, "outbound"),
        (C.JS_FS_MODULES, C.JS_FS_METHODS, "fs_write"),
        (C.JS_SERVER_MODULES, C.JS_SERVER_METHODS, "listening_port"),
    ):
        if module in modules and method in methods:
            return kind
    return None


def detail(text: str) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= 200 else flat[:200] + "..."


def _split(inside: list[Token]) -> list[list[Token]]:
    """The arguments between two parentheses, each with its tokens."""
    out, depth = [[]], 0
    for t in inside:
        if t.kind == "sign":
            depth += (t.text in "([{") - (t.text in ")]}")
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [a for a in out if a]


def _listens(inside: list[Token]) -> bool:
    """Whether an argument is a number, a name, a template or an operation of two operands; not a function, an object or a member."""
    for argument in _split(inside):
        plain = [t for t in argument if not t.inner]
        if len(plain) == 1 and (plain[0].kind in ("number", "template") or (plain[0].kind == "name" and plain[0].text not in _CONSTANTS)):
            return True
        depth, operator = 0, False
        for i, t in enumerate(plain):
            if t.kind == "sign":
                depth += (t.text in "([{") - (t.text in ")]}")
                if depth == 0 and t.text in ("=>", "?", "="):
                    operator = False
                    break
                operator |= depth == 0 and i > 0 and t.text in _OPERATORS and (plain[i - 1].kind != "sign" or plain[i - 1].text in ")]")
        if operator:
            return True
    return False


def _egress(arguments: list[Token], fqn: str) -> dict:
    m = _HOST.match(arguments[0].text[1:-1]) if arguments and arguments[0].kind == "string" else None
    return {"kind": "outbound_network" if m else "outbound_dynamic", "fqn": fqn, "host": m[1].lower() if m else None}


def audit(text: str | None) -> list[dict]:
    """Findings in the order of the text."""
    text = text or ""
    ts = tokens(text)
    breaks = [m.end() for m in re.finditer("\n", text)]
    names, found = aliases(ts), []

    def add(begin: int, end: int, **finding) -> None:
        found.append({"line": bisect.bisect_right(breaks, begin) + 1, "detail": detail(text[begin:end]), "confidence": "literal"} | finding)

    for i, t in enumerate(ts):
        if t.kind != "name":
            continue
        before = ts[i - 1].text if i else ""
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.text == "env" and _chain(ts, i)[1] == ["process", "env"] and i + 2 < len(ts):
            nxt = ts[i + 2]
            name = nxt.text if after in (".", "?.") and nxt.kind == "name" else nxt.text[1:-1] if after == "[" and nxt.kind == "string" else None
            if name and _SECRET.search(name):
                begin = ts[_chain(ts, i)[0]].at
                add(begin, nxt.end + (after == "["), kind="env_secret_read", env_name=name)
        if after != "(" or t.text in _NO_CALL or before == "function":
            continue
        close = _closing(ts, i + 1)
        inside = ts[i + 2 : close]
        begin, chain = _chain(ts, i)
        start, end = ts[begin].at, ts[close].end
        made = begin and ts[begin - 1].text == "new"
        if made and len(chain) == 1:
            if t.text in C.JS_NETWORK_CONSTRUCTORS:
                add(ts[begin - 1].at, end, kind="outbound_network", fqn=t.text)
            elif t.text == "Function":
                add(ts[begin - 1].at, end, kind="obfuscation", fqn="Function")
            continue
        said = None
        if len(chain) == 1:
            if t.text in C.JS_NETWORK_CALLS:
                said = _egress(inside, t.text)
            elif t.text in C.JS_EVALUATORS:
                said = {"kind": "obfuscation", "fqn": t.text}
        elif t.text == "listen" and _listens(inside):
            # an object that isn't one name has none
            said = {"kind": "listening_port", "fqn": f"{chain[0] if len(chain) == 2 else '?'}.listen"}
        elif t.text in ("apply", "call") and len(chain) >= 3 and chain[-2] == "listen":
            said = {"kind": "listening_port", "fqn": text[start : t.at].rstrip(". \n\t?") + "." + t.text}
        elif len(chain) == 2 and chain[0] in names:
            kind, fqn = member_kind(names[chain[0]], t.text), f"{names[chain[0]]}.{t.text}"
            said = _egress(inside, fqn) if kind == "outbound" else {"kind": kind, "fqn": fqn} if kind else None
        if said:
            add(start, end, **said)
            words = (x.text for x in inside if x.kind in ("name", "string", "template"))
            if said["kind"].startswith("outbound") and any(_SENSITIVE.search(w) for w in words):
                add(start, end, kind="data_exfil_hint", confidence="local-var-traced")
    return found


def detect(files: DataFrame, keys: tuple = ("package_id", "rel")) -> DataFrame:
    """(*keys, seq, findings' columns) of the JavaScript files of ``files`` (*keys, language, text)."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*row[:-1], seq, *(f.get(c) for c in COLUMNS)) for row in pdf.itertuples(index=False) for seq, f in enumerate(audit(row[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "seq", *COLUMNS])

    return files.where("language = 'javascript'").select(*keys, "text").mapInPandas(run, f"{kinds}, seq int, {SCHEMA}")
