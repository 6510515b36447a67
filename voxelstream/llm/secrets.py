"""Secret scan: base patterns, and candidates that are confirmed by their structure.

A candidate is a run of base64, base64url or hex characters; base64 and hex may go over lines, indented or with
escaped ends. Its headers state how long it is; it must end with a line there, which is looked up, and is
reported only with the inner structure of a secret:

* ``der``: an ASN.1 SEQUENCE whose fields fill it exactly and are those of a PKCS#1, PKCS#8 or SEC1 key;
* ``ssh``: a key blob of as many length-prefixed fields as the algorithm has that its first one names;
* ``openssh``: the ``openssh-key-v1`` container, or as much of it as there is;
* ``jwt``: two or three base64url parts, the first a JSON object with a string ``alg``, the second a JSON object.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive, in whole texts;
spans of different kinds may overlap; repeated rows each get their row; a null doc_id stays null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "der", "ssh", "openssh", "jwt")
#: Fields of a key blob by its first one.
SSH_FIELDS = {
    b"ssh-rsa": 3,
    b"ssh-dss": 5,
    b"ssh-ed25519": 2,
    b"ecdsa-sha2-nistp256": 3,
    b"ecdsa-sha2-nistp384": 3,
    b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3,
    b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
OPENSSH = b"openssh-key-v1\x00"
MOST_KEYS = 16  # of an OpenSSH container
#: Object identifiers of encryption schemes, as far as PKCS#5 and PKCS#12.
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))

HEX_LINES = re.compile(r"[0-9A-Fa-f]{16,}(?:[ \t]*(?:\r\n?|\n|(?:\\{1,2}r)?\\{1,2}n)[ \t]*[0-9A-Fa-f]{2,}(?![0-9A-Za-z]))*")
OPENSSH_HEX = re.compile(OPENSSH.hex(), re.IGNORECASE).search
#: A header begins with a brace, then a quote ("eyJ") or, at the start of a run, white space.
JWT = re.compile(r"(?:eyJ|(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{2})[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
#: Where base64 of a SEQUENCE (0x30), of a four-byte length below 256, or of "openssh-key-v1" can begin; the "n" of an escaped newline is none of it.
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+])|(?<=\\[nrt]))(?:M[A-P]|AAAA|b3BlbnNza)")
BASE64URL = re.compile(r"(?<![A-Za-z0-9_-])(?:M[A-P]|AAAA|b3BlbnNza)[A-Za-z0-9_-]{28,}={0,2}")
#: Lines of base64 may be indented, and their ends escaped.
LINE_END = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\{1,2}r)?\\{1,2}n)[ \t]*")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/]+(?:[ \t]*(?:\r\n?|\n|(?:\\{1,2}r)?\\{1,2}n)[ \t]*[A-Za-z0-9+/]+)*")
PADDING = re.compile(r"={0,2}")
SHORTEST = 32  # characters of a candidate

BASE64_LEADS = ("AAAA", "b3Bl", *(f"M{c}" for c in "ABCDEFGHIJKLMNOP"))


Read = Callable[[int, int], bytes]  # (offset, length) -> bytes of what a candidate decodes to, fewer at its end


def _der_field(read: Read, at: int) -> tuple[int, int, int] | None:
    """(tag, where the value begins, where it ends) of the field at ``at``."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if head[1] == 0x80 or n > 4 or len(head) < 2 + n:
        return None
    size = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
    return head[0], at + 2 + n, at + 2 + n + size


def _is_key_layout(read: Read, at: int, end: int) -> bool:
    """Whether the fields of a SEQUENCE fill it exactly and are those of a key.

    PKCS#1 and its like: INTEGERs alone, then perhaps a SEQUENCE of more primes. PKCS#8: a version, an algorithm and
    an OCTET STRING; encrypted, an algorithm of PKCS#5 or PKCS#12 and an OCTET STRING. SEC1: version 1 and an OCTET
    STRING. Certificates, requests and public keys with an algorithm have others.
    """
    fields = []
    while at < end:
        field = _der_field(read, at)
        if field is None or field[2] > end or len(fields) > 12:
            return False
        fields.append(field)
        at = field[2]
    tags = [f[0] for f in fields]
    small = tags[:1] == [0x02] and read(fields[0][1], 2)[: fields[0][2] - fields[0][1]]
    if set(tags) == {0x02} or (len(tags) == 10 and set(tags[:9]) == {0x02} and tags[9] == 0x30):
        return any(f[2] > f[1] for f in fields)
    if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        return small in (b"\0", b"\1") and read(fields[1][1], 1) == b"\x06"
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:
        return small == b"\1"
    return tags == [0x30, 0x04] and read(fields[0][1], 10)[2:] in ENCRYPTED


def _fields_end(read: Read, at: int, n: int) -> int | None:
    """Where ``n`` length-prefixed fields end."""
    for _ in range(n):
        size = read(at, 4)
        if len(size) < 4:
            return None
        at += 4 + int.from_bytes(size, "big")
    return at


def _stated(read: Read) -> tuple[str, int | None] | None:
    """(kind, length by its own headers) of what a candidate begins with; reads headers alone, a bounded number."""
    head = read(0, 48)
    if head.startswith(OPENSSH):
        # Cipher, key derivation and its options, the number of public keys, these, the private part.
        at = _fields_end(read, len(OPENSSH), 3)
        n = b"" if at is None else read(at, 4)
        many = int.from_bytes(n, "big") if len(n) == 4 else MOST_KEYS + 1
        return "openssh", _fields_end(read, at + 4, many + 1) if many <= MOST_KEYS else None
    if head[:1] == b"\x30":
        field = _der_field(read, 0)
        return field and ("der", field[2])
    size = int.from_bytes(head[:4], "big")
    n = SSH_FIELDS.get(head[4 : 4 + size]) if len(head) > 4 else None
    return n and ("ssh", _fields_end(read, 0, n))


def _confirmed(kind: str, read: Read, length: int) -> bool:
    """Structure that the stated length alone doesn't show."""
    if kind != "der":
        return True
    field = _der_field(read, 0)
    return length >= 16 and _is_key_layout(read, field[1], length)


def _bytes_kind(data: bytes) -> str | None:
    """The kind of a candidate that is one run."""
    read = lambda at, n: data[at : at + n]
    stated = _stated(read)
    if stated and stated[0] == "openssh":
        return "openssh"
    return stated[0] if stated and stated[1] == len(data) and _confirmed(stated[0], read, len(data)) else None


def is_der_key(data: bytes) -> bool:
    return _bytes_kind(data) == "der"


class Lines:
    """A run of lines of a code, put together; where lines end in it and in the text."""

    def __init__(self, text: str, start: int, end: int):
        breaks = list(LINE_END.finditer(text, start, end))
        self.begins = [start, *(x.end() for x in breaks)]
        stops = [*(x.start() for x in breaks), end]
        self.chars = "".join([text[a:b] for a, b in zip(self.begins, stops, strict=True)])
        self._before = [0, *accumulate(b - a for a, b in zip(self.begins, stops, strict=True))]
        self.ends = dict(zip(self._before[1:], stops, strict=True))
        self.end = end

    def place(self, at: int) -> int:
        """Where a character of the text is in ``chars``."""
        line = bisect_right(self.begins, at) - 1
        return self._before[line] + at - self.begins[line]

    def base64(self, first: int) -> Read:
        def read(at: int, n: int) -> bytes:
            group = at // 3
            raw = self.chars[first + 4 * group : first + 4 * -(-(at + n) // 3)]
            raw = raw[: len(raw) - (len(raw) % 4 == 1)]
            return base64.b64decode(raw + "=" * (-len(raw) % 4))[at - 3 * group :][:n]

        return read

    def hex(self, first: int) -> Read:
        def read(at: int, n: int) -> bytes:
            raw = self.chars[first + 2 * at : first + 2 * (at + n)]
            return bytes.fromhex(raw[: len(raw) // 2 * 2])

        return read


def _base64_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys that end where a line of their run ends, as long as their headers state: one look-up for each candidate."""
    found, done, run = [], 0, None
    for m in BASE64.finditer(text):
        start = m.start()
        if start < done:
            continue
        if run is None or start >= run.end:
            run = Lines(text, *BASE64_RUN.match(text, start).span())
        first = run.place(start)
        if len(run.chars) - first < SHORTEST or (stated := _stated(read := run.base64(first))) is None:
            continue
        kind, length = stated
        n = 0 if length is None else (4 * length + 2) // 3
        end = run.ends.get(first + n)
        if n >= SHORTEST and end is not None and _confirmed(kind, read, length):
            done = PADDING.match(text, end).end()
        elif kind == "openssh":  # cut short: all there is
            done = PADDING.match(text, run.end).end()
        else:
            continue
        found.append((start, done, kind))
    return found


def _base64url_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys of one run that has a character of base64url alone."""
    found = []
    for m in BASE64URL.finditer(text):
        run = m.group().rstrip("=")
        if ("-" in run or "_" in run) and len(run) % 4 != 1 and (kind := _bytes_kind(base64.urlsafe_b64decode(run + "=" * (-len(run) % 4)))):
            found.append((m.start(), m.end(), kind))
    return found


def _hex_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in hex, over one line or several, from the start of a line to the end of one."""
    found = []
    for m in HEX_LINES.finditer(text):
        run, done = Lines(text, *m.span()), 0
        for begin in run.begins:
            if begin < done:
                continue
            first = run.place(begin)
            if len(run.chars) - first < SHORTEST or (stated := _stated(read := run.hex(first))) is None:
                continue
            kind, length = stated
            end = None if length is None else run.ends.get(first + 2 * length)
            if end is None and kind == "openssh":
                end = run.end
            if end is not None and (length is None or 2 * length >= SHORTEST) and _confirmed(kind, read, length or 0):
                found.append((begin, end, kind))
                done = end
    return found


def is_signed_token(token: str) -> bool:
    parts = token.split(".")
    try:
        header, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that decode to a key or signed token."""
    found = []
    if "ey" in text or "ew" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m.group())]
    if any(x in text for x in BASE64_LEADS):
        url = _base64url_spans(text) if "-" in text or "_" in text else []
        whole = {a for a, _, _ in url}
        found += url + [x for x in _base64_spans(text) if x[0] not in whole]
    if "30" in text or "00000" in text or OPENSSH_HEX(text):
        found += _hex_spans(text)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    folded, found = text.lower(), []
    if any(w in folded for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its spans."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = _in_order(base_spans(text))
                more = confirmed_spans(text)
                every = _in_order(base + more) if more else base
                n = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(more)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("text", text_or_empty()).mapInArrow(spans, SCHEMA)
