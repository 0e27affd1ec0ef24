"""Secrets in texts: fixed patterns, and an assignment-aware lexer for source and configuration syntax.

The lexer reads name-literal pairs (``name = "..."``, ``"name": "..."``, ``name: value``, ``name := '...'``,
``f(name="...")``, ``put("name", "...")``, ``setName("...")``, ``<name>...</name>``, type annotations, lists, joined
literals) and the names that a value refers to.  Constants are propagated: a literal counts for every name that it
reaches through other names, ``+`` or ``${name}``, whatever the order of the lines.  A pair's score is the sensitivity
of the words of its name times how much the literal looks like a secret.

Every text is handled by itself, in time that grows with its length; there is no shuffle.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds (a keyword's letters in either case, ASCII only).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "literal", "constant")

#: words of a name: what they alone say about its value, and pairs of words
WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "passcode": 0.9, "pin": 0.5, "secret": 1.0,
         "secrets": 1.0, "token": 0.9, "tokens": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8,
         "auth": 0.6, "authorization": 0.8, "authtoken": 1.0, "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "jwt": 0.8,
         "salt": 0.7, "otp": 0.6, "dsn": 0.6}
PAIRS = {(a, "key"): s for a, s in (("api", 1.0), ("access", 1.0), ("private", 1.0), ("secret", 1.0), ("signing", 1.0),
                                    ("encryption", 1.0), ("master", 0.9), ("session", 0.8), ("account", 0.8), ("auth", 0.9),
                                    ("service", 0.7), ("license", 0.6), ("ssh", 0.8))} | {("connection", "string"): 0.7}
#: a name that ends so tells something about a secret, but does not hold it
HARMLESS = {"count", "length", "len", "size", "limit", "max", "min", "hint", "label", "name", "field", "type", "id", "ids", "url",
            "uri", "path", "file", "filename", "policy", "expiry", "expires", "ttl", "timeout", "regex", "pattern", "placeholder",
            "prompt", "strength", "index", "column", "header", "param", "env", "var", "version", "enabled", "required", "error"}
PLACEHOLDER = re.compile(r"""[xX*._\-#0?]*|[<{$%\[(].*|your.*|.*(?:change|replace).?me.*|.*example.*|.*placeholder.*|.*redacted.*"""
                         r"""|none|null|nil|true|false|undefined|todo|password|passwd|secret|token|string|str|test|dummy|default""",
                         re.I | re.S)

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX.replace("+", "{24,}"))                   # whole runs either way
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")

_NAME = r"""(?:[^\W\d]|\$)[\w$]*+(?:(?:\.|->|-)[\w$]++|\[\s*+["']?[\w$.\-]++["']?\s*+\])*+"""
_ANNOTATION = r"""(?::\x20*+[A-Za-z_][\w.\[\], |<>]{0,60}?=(?![=>]))"""
_PAIR = re.compile(r"""(?<![\w$.\-])(?:(?P<q>["'`])(?P<quoted>[\w$. \-]++)(?P=q)|(?P<bare>""" + _NAME + r"""))["'\])]?[ \t]*+"""
                   r"""(?:""" + _ANNOTATION + r"""|=>|:=|[=:](?![=:]))[ \t]*+""")
_CALL = re.compile(r"""\(\s*+(?P<q>["'])(?P<quoted>[\w$.\-]++)(?P=q)\s*+,\s*+(?=["'`])""")
_SETTER = re.compile(r"""(?<![^\W_])set_?(?P<bare>[A-Z_a-z]\w*+)\(\s*+(?=["'`])""")
_ELEMENT = re.compile(r"""<(?P<bare>[A-Za-z_][\w.\-]*+)>\s*+(?P<value>[^<>\s][^<>]*+)</(?P=bare)>""")
_TRIGGER = re.compile(r"""[=:]|\(\s*["']|</""")
_STRING = re.compile(r'''[rRbBuUfF]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*+)"'''
                     r'''|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`]*+)`)''', re.S)
_REF = re.compile(_NAME)
_BARE = re.compile(r"""[^\s"'`,;#<>(){}\[\]]++""")
_PLUS = re.compile(r"""\s*+(?:\+|\x20\.\x20|\\\n)\s*+|\s++(?=["'])""")
_COMMA = re.compile(r"\s*+,\s*+")
_INSIDE = re.compile(r"""\$?\{([\w.]+)\}""")


class Finding(NamedTuple):
    """``start`` to ``end`` in code points, end exclusive; the base kinds have no name and a score of 1."""
    kind: str
    start: int
    end: int
    name: str | None = None
    score: float = 1.0


class _Value(NamedTuple):
    name: str
    at: int
    literals: list[tuple[int, int, bool]]                      # start, end, bare word
    refs: list[tuple[str, int]]


def base_spans(text: str) -> list[Finding]:
    """Matches of the fixed patterns: leftmost, not overlapping in a kind; those that are too short are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [Finding("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [Finding("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Finding("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How surely a target of this name holds a secret, from 0 to 1."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return 0.0
    best = max([WORDS.get(w, 0.0) for w in words] + [PAIRS.get(p, 0.0) for p in zip(words, words[1:])])
    if "public" in words or words[-1] in HARMLESS:
        best *= 0.3
    return best


def literal_score(text: str, bare: bool = False) -> float:
    """How much a literal looks like a secret, from 0 to 1; ``bare``: an unquoted word."""
    if len(text) < 6 or PLACEHOLDER.fullmatch(text):
        return 0.0
    share = [c / len(text) for c in Counter(text).values()]
    entropy = -sum(p * math.log2(p) for p in share)
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    score = 0.35 + 0.35 * min(1.0, entropy / 3.5) + 0.15 * min(classes - 1, 2)
    if bare and not re.search("[0-9]", text):
        score *= 0.5                                           # may be a word of prose
    return score * (0.4 if re.search(r"\s", text) else 1.0)


def _canonical(name: str) -> str:
    return re.sub(r"""["'\s]""", "", name)


def _read_value(text: str, at: int) -> tuple[list[tuple[int, int, bool]], list[tuple[str, int]]]:
    """Literals and names of the value that begins at ``at``."""
    literals, refs = [], []
    closing = text[at:at + 1] in ("[", "(")                    # a list of literals
    if closing:
        at += 1
        while at < len(text) and text[at].isspace():
            at += 1
    while True:
        if m := _STRING.match(text, at):
            lo, hi = m.span(m.lastgroup)
            literals.append((lo, hi, False))
            refs += [(x[1], lo) for x in _INSIDE.finditer(text, lo, hi)]
        elif (m := _REF.match(text, at)) and not _BARE.match(text, m.end()):
            if text[m.end():m.end() + 1] == "(":               # a call: its value is not known
                break
            refs.append((_canonical(m[0]), at))
            if not literals and len(refs) == 1:
                literals.append((at, m.end(), True))           # or a bare word, where no such name is assigned
        elif not literals and not refs and (m := _BARE.match(text, at)):
            return [(at, m.end(), True)], [(x[1], at) for x in _INSIDE.finditer(text, at, m.end())]
        else:
            break
        at = m.end()
        step = _PLUS.match(text, at) or (_COMMA.match(text, at) if closing else None)
        if not step:
            break
        at = step.end()
    return literals, refs


def _values(text: str) -> list[_Value]:
    out = []
    for pattern in (_PAIR, _CALL, _SETTER):
        for m in pattern.finditer(text):
            groups = m.groupdict()
            literals, refs = _read_value(text, m.end())
            if literals or refs:
                out.append(_Value(_canonical(groups.get("quoted") or groups.get("bare")), m.start(), literals, refs))
    out += [_Value(m["bare"], m.start(), [(*m.span("value"), False)], []) for m in _ELEMENT.finditer(text)]
    return sorted(out, key=lambda v: v.at)


def assigned_secrets(text: str, threshold: float = 0.5) -> list[Finding]:
    """Literals that reach a target of a sensitive name, directly (``literal``) or through names (``constant``).

    A name means its last assignment before the use, or else the first after it.  Where a literal reaches several
    targets, the most sensitive one counts, then the first.
    """
    if not _TRIGGER.search(text):
        return []
    values = _values(text)
    scored = sorted(((-s, i) for i, v in enumerate(values) if (s := name_score(v.name)) > 0))
    if not scored:
        return []
    places: dict[str, list[int]] = defaultdict(list)
    for i, v in enumerate(values):
        places[v.name].append(i)
    starts = {name: [values[i].at for i in where] for name, where in places.items()}

    def meant(name: str, at: int, but: int) -> int | None:
        where = places.get(name, [])
        k = bisect.bisect_left(starts[name], at) - 1 if where else -1
        near = [where[j] for j in (k, k - 1, k + 1, k + 2) if 0 <= j < len(where) and where[j] != but]
        return near[0] if near else None

    out, seen = [], set()
    for low, target in scored:
        stack, taken = [(target, False)], []
        while stack:
            i, through = stack.pop()
            if (i, through) in seen or (i, False) in seen:
                continue
            seen.add((i, through))
            v = values[i]
            known = [(name, j) for name, at in v.refs if (j := meant(name, at, i)) is not None]
            names = {name for name, _ in known}
            taken += [(lo, hi, bare, through) for lo, hi, bare in v.literals
                      if not (bare and _canonical(text[lo:hi]) in names)]
            stack += [(j, True) for _, j in known]
        whole = "".join(text[lo:hi] for lo, hi, _, _ in taken)
        score = -low * literal_score(whole, all(bare for _, _, bare, _ in taken))
        if taken and score >= threshold:
            out += [Finding("constant" if through else "literal", lo, hi, values[target].name, score)
                    for lo, hi, _, through in taken if hi > lo]
    return out


def findings(text: str | None, threshold: float = 0.5) -> list[Finding]:
    """Base spans, and what the lexer adds outside them, by start and then kind (in the order of ``KINDS``)."""
    base = base_spans(text or "")
    covered = sorted((f.start, f.end) for f in base)
    reach, ends = [], 0
    for _, end in covered:
        reach.append(ends := max(ends, end))
    out = {(f.kind, f.start, f.end): f for f in base}
    for f in assigned_secrets(text or "", threshold):
        k = bisect.bisect_right(covered, (f.start, math.inf)) - 1
        if k < 0 or reach[k] < f.end:
            out.setdefault((f.kind, f.start, f.end), f)
    return sorted(out.values(), key=lambda f: (f.start, KINDS.index(f.kind), f.end))


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()),
                      ("score", pa.float64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """``id_col, findings`` for every row; ``findings`` is an array of ``kind, start, end, name, score``.

    Places are code points of the whole text, end exclusive.  A null or empty text has no findings.  Repeated rows and
    ids, and null ids, are kept one by one; equal starts are ordered by kind; an empty table gives an empty result;
    other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f._asdict() for f in findings(t, threshold)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(_FINDING))], [id_col, "findings"])

    return (docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
            .mapInArrow(run, f"`{id_col}` long, findings array<struct<kind:string,start:bigint,`end`:bigint,name:string,score:double>>"))


def mask_secrets(docs: DataFrame, text_col: str = "text", *, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """The input with every found span of ``text_col`` replaced by ``mask`` (overlapping spans by one); null stays null."""
    names, types = docs.columns, dict(docs.dtypes)
    at = names.index(text_col)

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for f in findings(text, threshold):
            if f.start >= done:
                out += [text[done:f.start], mask]
            done = max(done, f.end)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))
