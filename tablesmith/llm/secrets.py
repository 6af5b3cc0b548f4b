"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base spans. Beyond these, the text is lexed into assignments: a name, an operator and an
expression of literals and names joined by ``+``. Constants propagate: a name that was bound to literals earlier in the text
stands for them where it is used. An assignment to a sensitive name whose value scores high enough adds a span for each
literal in it that no base span covers (``lexed`` where the literal stands in the assignment, ``const`` where it was bound to
another name before).

Edge cases: null and empty texts have no spans; spans of one start come in the order of the kinds, a literal that several assignments reach
is one span (of the first); repeated rows are scanned one by one; names and texts of any length are
lexed whole, in time that grows with their length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import id_and_text, small_batches, steps, texts

KINDS = ("assign", "access", "hex", "lexed", "const")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The fixed patterns are AKIA[A-Z0-9]+ of 20 characters and more, [0-9a-f]+ of 24 and more; runs are greedy, so this is the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
OPERATOR = re.compile(r":=|=>|[:=]")
PART = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_$.+/-]+(?:={1,2}(?![A-Za-z0-9_$.+/="'-]))?))""")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*(?=[\"'A-Za-z_$])")
NAME_END = re.compile(r"[A-Za-z0-9_$.-]")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*")
WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive a name is by the words in it.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.9, "auth": 0.7, "signature": 0.6, "key": 0.6, "salt": 0.6, "cert": 0.6, "dsn": 0.6}
PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("client", "secret"): 1.0, ("account", "key"): 0.9, ("encryption", "key"): 1.0}
PLACEHOLDER = re.compile(r"(?is)^(?:change_?me|example|placeholder|none|null|true|false|undefined|password|secret|token|your[_-].*|<.*>|\$\{.*|\{\{.*|%\(.*|(.)\1*|\*+|x+)$")
THRESHOLD = 0.55
#: Characters that tell a placeholder from the beginning of a longer value.
HEAD = 32

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
SPAN_SQL = "array<struct<kind:string,start:int,end:int,at:int,name:string,score:double>>"


def sensitivity(name: str) -> float:
    """0 to 1: how likely the name's value is a secret."""
    words = [w.lower() for w in WORDS_OF_NAME.findall(name)]
    return max([0.0, *(WEIGHTS.get(w, 0.0) for w in words), *(PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


class Value:
    """What a name is bound to: literals and earlier values, in order, with the characters of the text that they spell out together.

    The text itself is never built: a constant used many times, or built on others that repeat, stays as small as it stands in the source.
    """

    def __init__(self, items: list):
        self.items, self.counts, self.n, self.head, self.tail, self.spread = items, Counter(), 0, "", "", False
        for item in items:
            if isinstance(item, Value):
                for c, n in item.counts.items():
                    self.counts[c] += n
                n, head, tail = item.n, item.head, item.tail
            else:
                self.counts.update(item[0])
                n, head, tail = len(item[0]), item[0][:HEAD], item[0][-1:]
            self.n, self.head, self.tail = self.n + n, (self.head + head)[:HEAD] if self.n == len(self.head) else self.head, tail or self.tail

    def literals(self) -> Iterator[tuple[str, int, int, bool]]:
        """The literals, but for those of values whose literals were taken before."""
        stack = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                yield item
            elif not item.spread:
                item.spread = True
                stack += reversed(item.items)

    def shape(self) -> float:
        """0 to 1: how much the text looks like a secret, by its length, its entropy and its characters."""
        n, short = self.n, self.n <= HEAD
        if n < 6 or PLACEHOLDER.match(self.head if short else self.head + "\n" + self.tail) or len(self.counts) == 1:
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        digits, letters, spaces = (any(f(c) for c in self.counts) for f in (str.isdigit, str.isalpha, str.isspace))
        if n >= 16 and entropy >= 3 and digits and letters and not spaces:
            return 1.0
        mixed = digits + any(not c.isalnum() for c in self.counts)
        return min(1.0, 0.3 * min(1, n / 16) + 0.4 * min(1, entropy / 3) + 0.15 * mixed)


def _name_before(text: str, end: int) -> str:
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and NAME_END.match(text[start - 1]):
        start -= 1
    return text[start:end]


def lex(text: str) -> Iterator[tuple[str, list[tuple[str, int, int, bool]]]]:
    """Each assignment's name and the parts of its value: (text, start, end, is a quoted literal)."""
    stop = 0
    for op in OPERATOR.finditer(text):
        if op.start() < stop:
            continue
        name = _name_before(text, op.start())
        if not name:
            continue
        parts, at = [], op.end()
        while m := PART.match(text, at):
            g = m.lastindex
            parts.append((m[g], m.start(g), m.end(g), g < 3))
            at = m.end()
            plus = PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if parts:
            stop = at if parts[-1][3] else stop
            yield name, parts


def scan(text: str) -> list[dict]:
    """All spans by start, then kind. ``at``: where the secret itself begins within the span."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end(), m.start(2), m[1].lower(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m.start(), "", 1.0) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), m.start(), "", 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        bound: dict[str, Value] = {}
        starts = [s[1] for s in sorted(spans, key=lambda s: s[1])]
        reach = list(accumulate((s[2] for s in sorted(spans, key=lambda s: s[1])), max))  # how far the base spans up to each start go
        seen = set()
        for name, parts in lex(text):
            own: list = []
            for value, start, end, quoted in parts:
                if not quoted and IDENTIFIER.fullmatch(value) and value in bound:
                    own += [bound[value]] if bound[value].items else []
                elif quoted or (any(c.isdigit() for c in value) and len(value) >= 8):
                    own.append((value, start, end, quoted))
            weight = sensitivity(name)
            made = bound[name] = Value(own)
            score = weight * made.shape() if weight and own else 0.0
            if score < THRESHOLD:
                continue
            here = {p for p in own if isinstance(p, tuple)}
            for literal in made.literals():
                _, start, end, _ = literal
                before = bisect_right(starts, start)
                if end > start and (start, end) not in seen and not (before and end <= reach[before - 1]):
                    seen.add((start, end))
                    spans.append(("lexed" if literal in here else "const", start, end, start, name, score))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [dict(zip(("kind", "start", "end", "at", "name", "score"), s, strict=True)) for s in spans]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of kind, start, end, at, name, score; code points, end exclusive) of every row."""
    src = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([scan(t) for t in texts(batch)], pa.list_(SPAN))], names=[id_col, "spans"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, spans {SPAN_SQL}")


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with each secret (not the name it is assigned to) replaced by ``mark``."""
    out, done = [], 0
    for at, end in sorted((s["at"], s["end"]) for s in scan(text)):
        if at >= done:
            out += [text[done:at], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with the secrets of ``text_col`` replaced; null stays null, all other columns and rows stay as they are."""
    small_batches(df)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column=at):
            new = pa.array([None if t is None else redact(t, mark) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def join_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
