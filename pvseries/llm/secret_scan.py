"""Secrets in whole texts: fixed forms, and literals that reach names of a sensitive kind.

Fixed forms are key assignments, access keys and hexadecimal runs. Beyond them, a lexer reads
assignments in source and configuration syntax (``a = "x"``, ``a: x``, ``"a": "x"``, ``A=x``,
``a := x``, ``a => "x"``, joined by ``+``) as name-literal pairs. A literal given to a constant
goes on to every later name that is set to that constant. Each literal has the score of the most
telling name it reaches, times how little it looks like a word or a placeholder; literals over
the threshold are reported as kind ``literal``, unless a fixed form covers them already.

Defined cases: a null text counts as empty and has no spans, and the checksum of no text;
repeated rows and null keys give one row each; an empty table gives no rows; other columns are
not read. Lengths are not bounded: names, literals and the blanks around a sign may be of any length, and
a literal may hold blanks and escaped quotes. A plain quote ends at its line's end; over several lines go triple quotes,
backticks, ends of lines after a backslash, and PEM blocks. Spans count code points, end exclusive. Work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pvseries.llm.common import id_text, map_arrow, rows, strings

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A maximal run that is too short leaves only shorter ones, so the lengths can stand in the patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)

# No length is bounded. Possessive runs and closing quotes keep the work linear: a quote that nothing closes is the last
# of its kind on its line (of three, or a backtick: in the text).
_PEM = r"-----BEGIN [^\n-]*+-----(?:(?!-----BEGIN )[\s\S])*?-----END [^\n-]*+-----"
_STRING = r""""(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+'"""
_PAIR = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*+)["'\]]{0,2}[ \t]*+(?::=|=>|=(?!=)|:(?!:))[ \t]*+"""
                   r"""((?:["'`]|[|>][+-]?[ \t]*+\n\s*+)?""" + _PEM + r"""["'`]?"""
                   r"""|\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|""" + _STRING
                   + r"""|`(?:[^`\\]|\\[\s\S])*+`|\$?\{?[^\s"'`,;#(){}\[\]]++)""", re.ASCII)
_JOINED = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+(" + _STRING + ")", re.ASCII)
_QUOTED = re.compile(r"""(\"{3}|'{3}|["'`])([\s\S]*)\1""")
_BLOCK = re.compile(r"""(?:["'`]|[|>][+-]?[ \t]*\n\s*)?(""" + _PEM + ")")
_NAME = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How telling a part of a name is.
NAME_SCORES = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
               "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "auth": 0.7, "signature": 0.5}
KEY_OWNERS = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "service", "ssh"}
# The same inside names that run together: long words anywhere, short ones only at the end.
_INSIDE = re.compile(r"password|passwd|passphrase|credential|apikey|secret(?!ar|i|e)|token(?!i)", re.ASCII)
_AT_END = re.compile(r"(?:pwd|bearer|auth|signature)$", re.ASCII)
_OWNED = re.compile(rf"(?:{'|'.join(sorted(KEY_OWNERS))})key$", re.ASCII)
PLACEHOLDERS = {"none", "null", "true", "false", "example", "changeme", "placeholder", "redacted", "password", "todo"}


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((NAME_SCORES.get(p, 0.0) for p in parts), default=0.0)
    for p in parts:
        best = max([best, *(NAME_SCORES[m] for m in _INSIDE.findall(p) + _AT_END.findall(p))])
    owned = any(b == "key" and a in KEY_OWNERS for a, b in zip(parts, parts[1:])) or any(_OWNED.search(p) for p in parts)
    return max(best, 1.0 if owned else 0.0)


def literal_score(value: str) -> float:
    """From 0 for short words and placeholders to 1 for long mixed literals; one of several words counts by its letters' entropy."""
    low, body = value.lower().strip(), "".join(value.split())
    if len(body) < 8 or low in PLACEHOLDERS or low[0] in "<{$%" or low[:4] == "your":
        return 0.0
    counts = Counter(body)
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value),
                   any(not c.isalnum() for c in value)))
    return min(1.0, entropy / 3.0) * (0.5 if classes == 1 else 1.0)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end): assignments with constants replaced by the literal they hold."""
    constants: dict[str, tuple[str, int, int]] = {}
    at = 0
    while m := _PAIR.search(text, at):
        at = m.end()
        name, token = m[1], m[2]
        if block := _BLOCK.match(token):
            value, start, end = block[1], m.start(2) + block.start(1), m.start(2) + block.end(1)
        elif quoted := _QUOTED.fullmatch(token):
            value, start, end = quoted[2], m.start(2) + quoted.start(2), m.start(2) + quoted.end(2)
            while more := _JOINED.match(text, at):
                value, end, at = value + more[1][1:-1], more.end(1) - 1, more.end()
        elif (known := _NAME.fullmatch(token)) and known[1] in constants:
            value, start, end = constants[known[1]]
        else:
            value, start, end = token, m.start(2), m.end(2)
        constants[name] = (value, start, end)
        yield name, value, start, end


def literal_spans(text: str, base: list[Span], threshold: float = 0.6) -> list[Span]:
    """Literals whose best target name and form pass the threshold, outside the fixed forms."""
    scores: dict[tuple[int, int], float] = {}
    for name, value, start, end in pairs(text):
        if (told := name_score(name)) > 0:
            scores[start, end] = max(scores.get((start, end), 0.0), told * literal_score(value))
    found = sorted(k for k, s in scores.items() if s >= threshold)
    return [("literal", s, e) for s, e in found if not any(b[1] <= s and e <= b[2] for b in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) per row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            sums, spans = [], []
            for body in strings(batch):
                base = base_spans(body)
                extra = literal_spans(body, base, threshold) if "=" in body or ":" in body else []
                tally = Counter(s[0] for s in base + extra)
                for k in KINDS:
                    counts[k].append(tally[k])
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
            yield rows({"doc_id": batch.column("doc_id"), **{f"n_{k}": v for k, v in counts.items()},
                        "base_sha256": sums, "spans": spans}, **{f"n_{k}": pa.int64() for k in KINDS},
                       base_sha256=pa.string(), spans=pa.string())

    return map_arrow(id_text(df, key, text), scan, "doc_id long, n_assign long, n_access long, n_hex long, "
                                                   "n_literal long, base_sha256 string, spans string")
