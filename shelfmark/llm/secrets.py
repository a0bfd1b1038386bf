"""Secret scan: three base patterns, and an assignment-aware lexer for source and configuration syntax.

The lexer cuts a text into tokens (strings with any quotes, triple ones too, names, numbers and marks) and reads from
them name-literal pairs: assignments with or without a type, chains of targets, subscripts, keyword arguments, keys of
JSON, YAML and hashes, pairs of call arguments, definitions, elements and block scalars. Strings that are joined by
marks or stand side by side are one literal. A name bound to a literal is a constant from there on: where another name
is bound to it later (``password = DEFAULT``), the literal that it has at that place also counts for that target. A
text is one scope. A literal is a secret when a target's name is sensitive and the literal looks like no plain word.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import lean, pick, slices
from shelfmark.session import read_table

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of at least 24 is the same as a whole run that is long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

#: Weights of the words a target name may have; a pair is reported from REPORT points on.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "access": 1.0, "key": 1.0, "api": 1.0, "signing": 1.5,
    "bearer": 2.0, "client": 0.5, "salt": 1.5, "dsn": 1.5,
}
REPORT = 3.0
LEAST_LITERAL = 6

_TOKEN = re.compile(
    r"""(?P<triple>(?P<tq>["\']{3})(?P<long>(?:[^\\]|\\.)*?)(?P=tq))"""
    r"""|"(?P<dq>(?:[^"\\\n]|\\.)*)"|\'(?P<sq>(?:[^\'\\\n]|\\.)*)\'|`(?P<bq>[^`\n]*)`"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<op>:=|=>|->|===?|!==?|[<>]=|\+=|::)"""
    r"""|(?P<line>\n)|(?P<other>[^\s\w])|(?P<number>[0-9][\w.]*)""".replace("\\'", "'"),
    re.DOTALL,
)
_BARE = re.compile(r"""[^\s"'`;,(){}\[\]<>|]+""")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]{0,127})(?:\s[^<>]*)?>(?P<value>[^<>]+)</(?P=name)\s*>")
_DEFINE = re.compile(r"""^[ \t]*#[ \t]*define[ \t]+(?P<name>\w+)[ \t]+["']?(?P<value>[^\s"']+)""", re.MULTILINE)
_BLOCK = re.compile(r"""^(?P<indent>[ \t]*)(?:-[ \t]+)?["']?(?P<name>[A-Za-z_][\w.\-]{0,127})["']?[ \t]*:[ \t]*[|>][-+0-9]*[ \t]*\n(?P<value>(?:(?P=indent)[ \t]+\S[^\n]*(?:\n|\Z))+)""", re.MULTILINE)
_STEMS = re.compile("pass|pwd|secret|token|key|cred|private|auth|access|api|signing|bearer|client|salt|dsn", re.IGNORECASE)
#: Tokens of a type between a colon and the assignment.
_TYPE_TOKENS = 24
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\).*|none|null|true|false|changeme|example|placeholder|todo)\Z", re.IGNORECASE)


def name_score(name: str) -> float:
    """How sensitive the words of a name are."""
    return sum(NAME_WEIGHTS.get(w.lower(), 0.0) for w in set(_WORDS.findall(name)))


def literal_score(text: str) -> float:
    """How little a literal looks like a plain word: mixed character classes and entropy."""
    if len(text) < LEAST_LITERAL or _PLACEHOLDER.match(text) or " " in text:
        return -10.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.5 * (classes - 1) + (0.5 if entropy >= 3 else 0.0) + (0.5 if n >= 16 else 0.0)


class _Lexer:
    """Tokens as (kind, text, start, end): kinds are str, name, op, line, other, number."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str, int, int]] = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind in ("triple", "dq", "sq", "bq"):
                part = "long" if kind == "triple" else kind
                self.tokens.append(("str", m[part], *m.span(part)))
            else:
                self.tokens.append((kind, m[0], *m.span()))

    def at(self, k: int) -> tuple[str, str, int, int]:
        return self.tokens[k] if 0 <= k < len(self.tokens) else ("end", "", len(self.text), len(self.text))

    def same_line(self, a: int, b: int) -> bool:
        return all(t[0] != "line" for t in self.tokens[a:b])

    def target(self, k: int) -> str | None:
        """The name that the token before an assignment stands for."""
        kind, text, _, _ = self.at(k)
        if kind == "name" or kind == "str" and 0 < len(text) <= 128 and " " not in text:
            return text
        if text == "]" and self.at(k - 1)[0] in ("str", "name") and self.at(k - 2)[1] == "[":
            return self.at(k - 1)[1]
        return None

    def literal(self, k: int) -> tuple[str, int, int, bool, int] | None:
        """A literal from token k on: text, start, end, is it quoted, the token behind. Joined strings are one literal."""
        while self.at(k)[1] == "(" or self.at(k)[0] == "name" and len(self.at(k)[1]) <= 2 and self.at(k + 1)[0] == "str" and self.at(k + 1)[2] - self.at(k)[3] <= 3:
            k += 1  # a bracket, or the letters before a string
        kind, text, start, end = self.at(k)
        if kind == "str":
            parts, inside = [text], self.at(k - 1)[1] == "("
            k += 1
            while True:
                j = k
                while self.at(j)[0] == "line" and (inside or self.at(k)[1] in ("+", ".", "\\")):
                    j += 1
                if self.at(j)[1] in ("+", ".", "\\", "&"):
                    j += 1
                    while self.at(j)[0] == "line":
                        j += 1
                elif j == k and self.at(j)[0] != "str":
                    break
                if self.at(j)[0] != "str" or self.at(j + 1)[1] in (":", "=>"):
                    break
                parts.append(self.at(j)[1])
                end, k = self.at(j)[3], j + 1
            if len(parts) == 1 and "\n" in text:  # a long string: what stands in it, without the space around
                inner = text.strip()
                start += text.index(inner) if inner else 0
                return inner, start, start + len(inner), True, k
            return "".join(parts), start, end, True, k
        if kind in ("end", "line") or not (m := _BARE.match(self.text, start)):
            return None
        while k < len(self.tokens) and self.tokens[k][2] < m.end():
            k += 1
        value = m[0].rstrip(".")
        return value, start, start + len(value), False, k


def _typed_value(lexer: _Lexer, k: int) -> int:
    """Behind a colon: the token behind a type and its assignment, or the same token where no type stands there."""
    depth = 0
    for j in range(k, min(k + _TYPE_TOKENS, len(lexer.tokens))):
        kind, text, start, end = lexer.at(j)
        if kind == "op" and text in ("=", ":=") or kind == "other" and text == "=":
            spaced = lexer.text[start - 1 : start] in " \t" and lexer.text[end : end + 1] in (" ", "\t")
            return j + 1 if j > k and depth == 0 and (spaced or lexer.at(j + 1)[0] == "str") else k
        depth += (text in "[<({") - (text in "]>)}") if kind == "other" else 0
        if kind in ("line", "number") or kind == "str" or text in (",", ";", "{", "}") and depth <= 0:
            break
    return k


def lexed_pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of every assignment, in order; offsets are code points of the literal."""
    lexer = _Lexer(text)
    found = []
    pending: list[str] = []  # targets of a chain
    for k, (kind, mark, _, end) in enumerate(lexer.tokens):
        if not (kind in ("op", "other") and mark in ("=", ":", ":=", "=>", "==", "===", "(", ",")):
            continue
        if mark in "(,":
            # Two arguments of a call: a name and its value.
            key, comma, value = (lexer.at(k + j) for j in (1, 2, 3))
            if mark == "(" and key[0] == "str" and comma[1] == "," and value[0] == "str" and " " not in key[1] and (lit := lexer.literal(k + 3)):
                found.append((key[1], *lit[:4]))
            continue
        name = lexer.target(k - 1)
        if name is None:
            pending = []
            continue
        j = _typed_value(lexer, k + 1) if mark == ":" else k + 1
        if mark == "=" and lexer.at(j)[0] == "name" and lexer.at(j + 1)[1] == "=" and lexer.same_line(j, j + 2):
            after = lexer.text[lexer.at(j)[3] : lexer.at(j)[3] + 1]
            if after in " \t" or lexer.at(j + 2)[0] == "str":  # a chain, not a literal that has an equals sign
                pending.append(name)
                continue
        while mark == "=" and lexer.at(j)[1] == "\\":
            j += 2
        if lit := lexer.literal(j):
            value, start, stop, quoted, _ = lit
            if not quoted and (call := lexer.text[stop : stop + 1]) and call in "([" and _IDENTIFIER.match(value):
                pending = []
                continue  # a call or a subscript is no literal
            found += [(n, value, start, stop, quoted) for n in [*pending, name]]
        pending = []
    for pattern in (_ELEMENT, _DEFINE):
        found += [(m["name"], m["value"].strip(), m.start("value") + len(m["value"]) - len(m["value"].lstrip()), m.start("value") + len(m["value"].rstrip()), True) for m in pattern.finditer(text)]
    for m in _BLOCK.finditer(text):
        value = m["value"].strip()
        start = m.start("value") + m["value"].index(value)
        found.append((m["name"], value, start, start + len(value), True))
    return sorted(found, key=lambda x: x[2])


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that score as secrets by the names they reach, directly or through constants as they stand at that place."""
    if not _STEMS.search(text):
        return []
    constant: dict[str, tuple[str, int, int, bool] | None] = {}
    spans = set()
    for name, value, start, end, quoted in lexed_pairs(text):
        bound = (value, start, end, quoted)
        if not quoted and _IDENTIFIER.match(value):
            bound = constant.get(value) or bound
            bare = bound[1] == start  # a word that is no constant of this text is its own literal
        else:
            bare = False
        constant[name] = None if bare else bound
        literal, a, b, told = bound
        sensitive = name_score(name)
        if bare:
            if literal_score(literal) >= 1.0 and sensitive + literal_score(literal) >= REPORT + 1:
                spans.add((a, b))
        # A name of one point (a key) needs a literal of two: mixed classes, length and entropy.
        elif sensitive >= 1.0 and (sensitive + literal_score(literal) >= REPORT or "passphrase" in name.lower() and told and literal.count(" ") >= 2):
            spans.add((a, b))
    return sorted(spans)


def scan(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: start and end in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    found["lexed"] = lexed_spans(text)
    return found


def _listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    order = sorted((a, KINDS.index(k), b) for k in kinds for a, b in found[k])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in order)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed.

    A span is a whole match of its kind. A null text counts as empty and has no spans (the digest is then that of the
    empty string). Repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")}
            for text in batch.column(1).to_pylist():
                found = scan(text or "")
                for k in ("assign", "access", "hex", "lexed"):
                    out[f"n_{k}"].append(len(found[k]))
                out["base_sha256"].append(hashlib.sha256(_listed(found, KINDS[:3]).encode()).hexdigest())
                out["spans"].append(_listed(found, KINDS))
            columns = {"doc_id": batch.column(0)} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"
    return pick(docs, id_col, text_col).mapInArrow(run, schema)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))
