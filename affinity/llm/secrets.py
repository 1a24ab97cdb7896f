"""Secret scan with structural confirmation.

Plain patterns give the base spans (assignments, access-key ids, hex strings).
Beyond them, candidates that only look encoded are decoded and must parse before
they are reported: private-key blocks, DER key structures with exact nested
lengths (in base64 or hex), signed tokens whose header and payload are JSON
objects, and base64 or hex wrappers around any of these.

A null text is an empty text; it has no spans. Rows are independent, so repeated
rows give repeated results and the whole scan is one pass without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from affinity.llm.common import text_slices

#: Span kinds in report order.
KINDS = ("assign", "access", "hex", "pem", "token", "der", "wrapped")
_ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The marks around a key and what may stand between them.
MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Where a candidate may begin: after a line end that is written as an escape, else not inside a word.
_BEGIN = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_\\-])|(?<=\\)(?![nrt]))"
ENCODED = re.compile(_BEGIN + r"[A-Za-z0-9+/_-]{24,}={0,2}")
_LINE_END = r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
#: Adjacent lines of base64 or hex.
LINES = re.compile(_BEGIN + rf"[A-Za-z0-9+/_-]{{24,}}(?:{_LINE_END}[A-Za-z0-9+/_-]+={{0,2}})+")
_LINE = re.compile(rf"([A-Za-z0-9+/_-]+={{0,2}})(?:{_LINE_END})?")
ANY_HEX = re.compile(r"(?:0[xX])?(?:[0-9a-fA-F]{2})+")


def _from_base64(text: str) -> bytes | None:
    body = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the DER values that fill data[start:end] exactly, else None."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_private_key(data: bytes) -> bool:
    """Whether bytes are exactly one DER private key: plain RSA/DSA, EC, or algorithm-tagged, encrypted or not."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, outer[0][1], outer[0][2])
    if not items:
        return False
    tags = [t for t, _, _ in items]
    inner = [der_items(data, a, b) if t == 0x30 else None for t, a, b in items]
    if len(tags) >= 6 and all(t == 0x02 for t in tags[:6]) and items[0][2] - items[0][1] == 1:
        return True
    if tags[:2] == [0x02, 0x04] and data[items[0][1]:items[0][2]] == b"\x01":
        return True
    algorithm = lambda i: bool(inner[i]) and inner[i][0][0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04] and algorithm(1):
        return True
    return tags == [0x30, 0x04] and algorithm(0)


def _is_tagged_container(data: bytes) -> bool:
    """The length-prefixed container of newer key files: magic, then strings with nested 32-bit lengths."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data)


def _is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    for part, key in ((head, "alg"), (body, None)):
        raw = _from_base64(part)
        try:
            got = json.loads(raw) if raw is not None else None
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
        if not isinstance(got, dict) or key and not isinstance(got.get(key), str):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind; matches that fail their length test are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _plain_lines(body: str) -> str:
    """Line ends and slashes that are written as escapes as such, carriage returns left out."""
    return re.sub(r"\\+/", "/", re.sub(r"\\+n", "\n", re.sub(r"\\+r|\r", "", body)))


def _kind_of(candidate: str) -> str | None:
    """What an encoded text is proven to be; wrappers are opened until nothing decodes, as each layer is shorter."""
    readings = [_from_base64(candidate)]
    if ANY_HEX.fullmatch(candidate):
        readings.append(bytes.fromhex(candidate[2:] if candidate[1] in "xX" else candidate))
    for data in readings:
        if not data:
            continue
        if is_private_key(data) or _is_tagged_container(data):
            return "der"
        if data.isascii() and all(c >= 32 or c in (9, 10, 13) for c in data):
            inner = data.decode("ascii")
            if base_spans(inner) or confirmed_spans(inner):
                return "wrapped"
    return None


def _wrapped_lines(text: str):
    """(from, to, joined) of lines of one width and the shorter one after them, with and without it; where a key may
    begin inside, also from there."""
    for m in LINES.finditer(text):
        lines = [(x.start(1), x.end(1), x[1]) for x in _LINE.finditer(text, *m.span())]
        i = 0
        while i < len(lines):
            width, j = len(lines[i][2]), i + 1
            while j < len(lines) and len(lines[j][2]) == width:
                j += 1
            ends = [j + 1] if j < len(lines) and len(lines[j][2]) < width else []
            for k in range(i, j):
                start = _from_base64(lines[k][2][:24]) or b""
                if k == i or start[:1] == b"0" or start.startswith(b"openssh-key-v1") or lines[k][2][:2] in ("30", "0x", "0X"):
                    for e in [*ends, j]:
                        if e - k > 1:
                            yield lines[k][0], lines[e - 1][1], "".join(x for _, _, x in lines[k:e])
            i = j


def _key_blocks(text: str):
    """(from, to, body) of each end mark and the begin mark right before it, if both name the same kind of key."""
    begin = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and BODY.fullmatch(text, begin.end(), m.start()):
                yield begin.start(), m.end(), text[begin.end():m.start()]
            begin = None


class _Taken:
    """Disjoint spans in order; whether a span is free of them is a search by bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Take a span that is free."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure proves them: keys, signed tokens, wrappers around secrets."""
    out = []
    if "-----BEGIN " in text:
        for a, b, inside in _key_blocks(text):
            body = _plain_lines(inside)
            if "\n\n" in body and ":" in body:  # header lines of an encrypted block
                body = body.split("\n\n", 1)[1]
            data = _from_base64(body)
            if data and (is_private_key(data) or _is_tagged_container(data) or "DEK-Info" in inside):
                out.append(("pem", a, b))
    if "eyJ" in text:
        out += [("token", *m.span()) for m in TOKEN.finditer(text) if _is_signed_token(m[0])]
    taken = _Taken((a, b) for _, a, b in out)
    for a, b, joined in _wrapped_lines(text):
        if taken.free(a, b) and (kind := _kind_of(joined)):
            out.append((kind, a, b))
            taken.add(a, b)
    for m in ENCODED.finditer(text):
        a, b = m.span()
        if not taken.free(a, b):
            continue
        # what follows an escape may also be meant with the escape's letter
        for start in (a, a - 1) if a > 1 and text[a - 2] == "\\" and text[a - 1] in "nrt" else (a,):
            if kind := _kind_of(text[start:b]):
                out.append((kind, start, b))
                break
    return out


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2])))


def scan_text(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    text = text or ""
    base = base_spans(text)
    return base, base + confirmed_spans(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts per base kind, ``base`` and ``spans`` as kind:start:end lists.

    Offsets are code points, ends exclusive; lists are ordered by start, then
    kind. Null or empty texts give zero counts and empty lists.
    """
    id_type = dict(docs.dtypes)[id_col]

    def scan(batches):
        for part in text_slices(batches, "_text"):
            rows = [scan_text(t) for t in part.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), count("assign"), count("access"), count("hex"),
                 pa.array([_join(b) for b, _ in rows], pa.string()), pa.array([_join(s) for _, s in rows], pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS _text").mapInArrow(
        scan, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, base string, spans string")


def digest(text: str) -> str:
    """Lower-case hex SHA-256 of a UTF-8 text."""
    return hashlib.sha256(text.encode()).hexdigest()
