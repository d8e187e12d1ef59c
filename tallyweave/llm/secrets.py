"""Secret scans with structural confirmation.

Three base kinds are patterns (assign, access, hex). The other kinds are reported only when a
decoded candidate has the structure of a key: signed tokens whose header decodes to JSON with an
algorithm, DER whose nested lengths close exactly around a private key's fields (in base64 or hex,
armoured or bare), OpenSSH key files with their length-prefixed fields, and base64 or hex text that
decodes to text with a secret of any kind, itself encoded up to ``DEPTH`` times. Bare runs are tried
alone and joined over line ends.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds, in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der_key", "openssh_key", "wrapped")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# JSON begins with a brace or white space: C, D, I or e in base64
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([CDIe][A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
# a body has no armour line in it; line ends may be written out as in JSON strings
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,.]|\\[rn]|-(?!----))*+)-----END \1-----")
# the shortest base secret, such as token=abcdef, has 12 bytes
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
# a run and those of the next lines; line ends may be written out, the first run does not begin in an escape
_LINE_END = r"(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*"
_BASE64_LINES = re.compile(r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]{16,}(?:" + _LINE_END + r"[A-Za-z0-9+/_-]+)+={0,2}")
_HEX_LINES = re.compile(r"(?:(?<=\\[nrt])|(?<![0-9A-Za-z\\]))[0-9A-Fa-f]{16,}(?:" + _LINE_END + r"[0-9A-Fa-f]+(?![0-9A-Za-z]))+")
_LINE_ENDS = re.compile(_LINE_END)
_HEADERS = re.compile(r"\s*((?:[A-Za-z0-9-]+:[^\n]*\n)+)")
_CIPHER = re.compile(r"^DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]+)\s*$", re.M)
_PRINTED = bytes(range(32, 127)) + b"\t\r\n"
#: Encodings around a secret's text that are taken off, one in the other.
DEPTH = 3
Span = tuple[int, int, int]  # start, end, index in KINDS


def _decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, white space and padding optional."""
    text = "".join(text.split()).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that fill ``data[at:end]`` exactly, else None."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_private_key(data: bytes) -> bool:
    """An RSA, DSA, EC, PKCS#8 or encrypted PKCS#8 private key whose lengths nest exactly."""
    top = _der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    body = _der_items(data, top[0][1], top[0][2])
    if not body or len(body) < 2:
        return False
    tags = [t for t, _, _ in body]
    version = data[body[0][1] : body[0][2]]
    if tags[:9] == [2] * 9 and version in (b"\0", b"\1"):  # RSA: version and eight integers
        return body[1][2] - body[1][1] >= 32
    if tags == [2] * 6 and version == b"\0":  # DSA: version, p, q, g, public and private number
        return body[1][2] - body[1][1] >= 32
    if tags[:2] == [2, 4] and version == b"\1":  # EC: version 1, the key's octets, tagged parameters
        return body[1][2] - body[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [2, 0x30, 4] and version in (b"\0", b"\1"):  # PKCS#8: version, algorithm, octets
        algorithm = _der_items(data, body[1][1], body[1][2])
        return bool(algorithm) and algorithm[0][0] == 6 and body[2][2] - body[2][1] >= 16
    if tags == [0x30, 4]:  # encrypted PKCS#8: algorithm, octets
        algorithm = _der_items(data, body[0][1], body[0][2])
        return bool(algorithm) and algorithm[0][0] == 6 and len(algorithm) == 2 and body[1][2] - body[1][1] >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """``openssh-key-v1``: cipher, kdf, options, key count, then each public key, within the data."""
    head = b"openssh-key-v1\0"
    if not data.startswith(head):
        return False
    at = len(head)
    for step in range(5):
        if len(data) - at < 4:
            return False
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if step == 3:
            if not 1 <= n <= 16:
                return False
            continue
        if n > len(data) - at:
            return False
        at += n
    return True


def is_signed_token(header: str, payload: str) -> bool:
    """The header decodes to a JSON object with an algorithm, the payload to a JSON object."""
    for part, key in ((header, "alg"), (payload, None)):
        raw = _decoded(part)
        try:
            value = json.loads(raw.decode("utf-8")) if raw is not None else None
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (key and not isinstance(value.get(key), str)):
            return False
    return True


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return out


def _key_kind(data: bytes) -> int | None:
    if is_openssh_key(data):
        return 5
    return 4 if is_der_private_key(data) else None


def _decoded_kind(data: bytes | None, depth: int) -> int | None:
    """Of a key, or of text that holds a secret; ``depth`` encodings within it may be taken off."""
    if not data:
        return None
    if (kind := _key_kind(data)) is not None:
        return kind
    if not data.isascii() or data.translate(None, _PRINTED):
        return None
    text = data.decode("ascii")
    return 6 if base_spans(text) or (depth > 1 and confirmed_spans(text, depth - 1)) else None


def armoured_kind(text: str) -> int | None:
    """Of the body between armour lines: a key, or one under a cipher whose headers and blocks fit each other."""
    lines = text.replace("\\r", "").replace("\\n", "\n")
    headers = _HEADERS.match(lines)
    body = _decoded(lines[headers.end() :] if headers else lines) or b""
    if (kind := _key_kind(body)) is not None or not headers:
        return kind
    cipher = _CIPHER.search(headers[1].replace("\r", ""))
    if not cipher or not re.search(r"^Proc-Type:\s*4,ENCRYPTED\s*$", headers[1], re.M):
        return None
    block = len(cipher[1]) / 2  # the initial value is one block: 8 bytes of DES, 16 of AES
    return 4 if block in (8, 16) and len(body) >= 64 and len(body) % block == 0 else None


class _Covered:
    """Whether a range lies within one of some ranges."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end


def _unhexed(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def _joined_spans(text: str, lines: re.Match, decoded: Callable[[str], bytes | None], size: int, depth: int) -> list[Span]:
    """Secrets over two or more lines of ``lines``; ``size`` characters encode up to three bytes.

    DER states its length, so it is looked for at every run and ends where that many characters do.
    Otherwise runs of one length, with or without a shorter last one, are taken as a whole.
    """
    runs, at = [], lines.start()
    for m in _LINE_ENDS.finditer(text, lines.start(), lines.end()):
        runs.append((at, m.start()))
        at = m.end()
    runs.append((at, at + len(text[at : lines.end()].rstrip("="))))
    ends = list(accumulate(e - s for s, e in runs))  # characters up to and with each run
    joined = "".join(text[s:e] for s, e in runs)
    out: list[Span] = []

    def found(first: int, last: int) -> bool:
        before = ends[first] - (runs[first][1] - runs[first][0])
        kind = _decoded_kind(decoded(joined[before : ends[last]]), depth)
        if kind is not None:
            out.append((runs[first][0], lines.end() if last + 1 == len(runs) else runs[last][1], kind))
        return kind is not None

    i = tried = 0  # runs before ``tried`` were part of a group
    while i < len(runs):
        before = ends[i] - (runs[i][1] - runs[i][0])
        head = decoded(joined[before : before + 4 * size]) or b""
        if head[:1] == b"\x30" and len(head) >= 6:
            n = head[1] & 0x7F if head[1] & 0x80 else 0
            whole = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) if n <= 4 else 0
            last = bisect_left(ends, before - (-whole * size // 3))
            if i < last < len(runs) and ends[last] - before == -(-whole * size // 3) and found(i, last):
                i = tried = last + 1
                continue
        if i >= tried or head.startswith(b"openssh-key"):
            width, last = runs[i][1] - runs[i][0], i
            while last + 1 < len(runs) and runs[last + 1][1] - runs[last + 1][0] == width:
                last += 1
            short = last + 1 < len(runs) and runs[last + 1][1] - runs[last + 1][0] < width
            if width >= 16 and short and found(i, last + 1):
                i = tried = last + 2
                continue
            if width >= 16 and last > i and found(i, last):
                i = tried = last + 1
                continue
            tried = max(tried, last + 1)
        i += 1
    return out


def confirmed_spans(text: str, depth: int = DEPTH) -> list[Span]:
    """Spans of candidates whose decoded structure is a secret's."""
    out: list[Span] = []
    if "." in text:
        out += [(m.start(), m.end(), 3) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if (kind := armoured_kind(m[2])) is not None:
                out.append((m.start(), m.end(), kind))
    for pattern, decoded, size in ((_BASE64_LINES, _decoded, 4), (_HEX_LINES, _unhexed, 6)):
        covered = _Covered(out)
        for m in pattern.finditer(text):
            out += [x for x in _joined_spans(text, m, decoded, size, depth) if not covered(x[0], x[1])]
    covered = _Covered(out)
    for m in _BASE64.finditer(text):
        if covered(m.start(), m.end()):
            continue
        found = m[0]
        if found.isalpha() and (found.islower() or found[1:].islower()):
            data = None  # a long word; key encodings and wrapped text hold digits or capitals
        else:
            data = _decoded(found)
        if (kind := _decoded_kind(data, depth)) is not None:
            out.append((m.start(), m.end(), kind))
    for m in _LONG_HEX.finditer(text):
        if not covered(m.start(), m.end()) and len(m[0]) % 2 == 0 and (kind := _decoded_kind(bytes.fromhex(m[0]), depth)) is not None:
            out.append((m.start(), m.end(), kind))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``[KIND]`` of the first."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", redact: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Offsets are code points, ends exclusive. With ``redact``, a column of that name has the text
    without its secrets (null stays null). Null and empty texts have no spans. Rows are independent:
    no exchange, repeated rows stay, an empty table gives an empty result; a clash of ``keep`` with
    a result column raises ``ValueError``.
    """
    made = T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long").fields
    made = [*made, *([T.StructField(redact, T.StringType())] if redact else [])]
    if clash := {c.lower() for c in keep} & {f.name.lower() for f in made}:
        raise ValueError(f"columns in use: {sorted(clash)}")
    schema = T.StructType([*docs.select(*keep).schema.fields, *made])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            cols: list[list] = [[] for _ in made]
            for value in batch.column(at):
                t = value.as_py()
                base = base_spans(t or "")
                spans = base + confirmed_spans(t or "")
                kinds = [k for _, _, k in base]
                row = [kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)]
                if redact:
                    row.append(redacted(t, spans) if spans else t)
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(cols, made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(rows, schema)
