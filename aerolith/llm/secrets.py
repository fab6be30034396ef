"""Secret scan with structural confirmation.

Base kinds, by pattern, leftmost and non-overlapping for each kind, over the whole
text: `assign` (a name, a sign, a value of 6 or more characters), `access`
(``AKIA...``, 20 or more), `hex` (24 or more). These are always reported.

The structural kinds are reported only if what a candidate decodes to holds
together:

* `pem`: a ``-----BEGIN x PRIVATE KEY-----`` block whose base64 body, after header
  lines if it has any, decodes to a private key; under ``Proc-Type: 4,ENCRYPTED`` and
  a DEK-Info with a vector of 8 or 16 bytes, to whole cipher blocks of that size;
* `jwt`: three base64url parts of which the first decodes to a JSON object with a
  string `alg` and the second to a JSON object;
* `der`: a base64 or hex run that decodes to a private key;
* `encoded`: a base64 or hex run that decodes to UTF-8 text, printable but for white
  space, in which a base pattern finds an assignment or an access key, or in which
  a structural kind is found by the same rules, `DEPTH` encodings deep in all.

A private key is DER, all of whose nested lengths fit exactly, of one of the shapes of
`private_shape` (RSA, DSA, elliptic curve, or the general wrapping with an algorithm,
plain or encrypted), or an OpenSSH key walked field by field to its last byte of
padding. Certificates, public keys and other sequences are none.

Runs wrapped over lines (equal lengths of `LINE` or more, the first and the last may be
shorter) are also tried as one; the joined span is reported beside those of its
lines, unless each line holds together by itself.

A span is (kind, start, end) in code points, end exclusive, sorted by start and
then by kind in the order above. Defined results: null and empty texts have no
spans; runs of any length are parsed whole, in linear time; each row stands for itself,
repeated ones too; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import rows_udf

# The kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "encoded")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:(?:\\[nr]|\s)*+[A-Za-z][A-Za-z0-9-]{0,40}:[^\r\n]{0,200}?(?=\\[nr]|[\r\n])){0,20})([A-Za-z0-9+/=\s\\]*?)-----END \1-----")
DEK = re.compile(r"DEK-Info:\x20*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])")
LINE = 16
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++={0,2})++")
RUN = re.compile(r"(?:(?<=\n)|(?<=\\n)|^)[ \t>]*+([A-Za-z0-9+/_-]++={0,2})")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
DEPTH = 3  # encodings in each other that are undone
HEX_ANY = re.compile(r"[0-9A-Fa-f]{32,}")
SPAN = "array<struct<kind:string,start:long,end:long>>"
_ORDER = {k: i for i, k in enumerate(KINDS)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def from_base64(run: str) -> bytes | None:
    """Decoded bytes of standard or URL-safe base64, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: A DER element: its tag and either the elements in it or its bytes.
Element = tuple[int, "list[Element] | bytes"]


def der_elements(data: bytes) -> list[Element] | None:
    """The elements of DER whose nested lengths all fit exactly; None if one does not."""
    top: list[Element] = []
    todo: list[tuple[int, int, list[Element]]] = [(0, len(data), top)]
    while todo:
        at, end, into = todo.pop()
        while at < end:
            if end - at < 2:
                return None
            tag, first, at = data[at], data[at + 1], at + 2
            size = first
            if first >= 0x80:
                n = first & 0x7F
                if not 1 <= n <= 4 or end - at < n:
                    return None
                size, at = int.from_bytes(data[at : at + n], "big"), at + n
                if size < 0x80 or size >> 8 * (n - 1) == 0:  # DER takes the shortest form
                    return None
            if at + size > end or tag & 0x1F == 0x1F or tag == 0:
                return None
            if tag & 0x20:
                inner: list[Element] = []
                into.append((tag, inner))
                todo.append((at, at + size, inner))
            else:
                into.append((tag, data[at : at + size]))
            at += size
    return top


INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30
# Object identifiers, in DER.
RSA = bytes.fromhex("2a864886f70d010101")
DSA = bytes.fromhex("2a8648ce380401")
EC = bytes.fromhex("2a8648ce3d0201")
CURVES_25519_448 = tuple(bytes.fromhex(f"2b65{k:02x}") for k in (0x6E, 0x6F, 0x70, 0x71))
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _tags(of: list[Element]) -> list[int]:
    return [t for t, _ in of]


def _positive(value: bytes) -> bool:
    return len(value) > 0 and value[0] < 0x80 and any(value)


def _sequence(data: bytes) -> list[Element] | None:
    found = der_elements(data)
    return found[0][1] if found and len(found) == 1 and found[0][0] == SEQUENCE else None


def private_shape(of: list[Element]) -> str | None:
    """Which private key the elements of a SEQUENCE make up, if any."""
    tags = _tags(of)
    if not of:
        return None
    version = of[0][1] if tags[0] == INTEGER else None
    if version in (b"\0", b"\1"):
        rest = of[1:]
        if len(rest) >= 8 and set(tags[1:9]) == {INTEGER} and all(_positive(v) for _, v in rest[:8]):
            more = rest[8:]
            if (version == b"\0" and not more) or (version == b"\1" and _tags(more) == [SEQUENCE]):
                return "rsa"
        if version == b"\0" and tags == [INTEGER] * 6 and all(_positive(v) for _, v in rest):
            return "dsa"
        if version == b"\1" and tags[1:2] == [OCTETS] and 14 <= len(of[1][1]) <= 72 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
            inner = {t: v for t, v in of[2:]}
            if all(_tags(inner[t]) == [k] for t, k in ((0xA1, BITS),) if t in inner) and all(_tags(inner[t]) in ([OID], [SEQUENCE]) for t in (0xA0,) if t in inner):
                return "ec"
        if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and len(tags) <= 5:
            algorithm, body = of[1][1], of[2][1]
            if _tags(algorithm)[:1] == [OID] and len(algorithm) <= 2:
                return "wrapped" if _body_fits(algorithm[0][1], body) else None
    if tags == [SEQUENCE, OCTETS]:
        scheme, body = of[0][1], of[1][1]
        if _tags(scheme) == [OID, SEQUENCE] and scheme[0][1].startswith(PASSWORD_SCHEMES) and scheme[1][1] and len(body) >= 16:
            return "encrypted"
    return None


def _body_fits(algorithm: bytes, body: bytes) -> bool:
    """Whether the octets of a wrapped key hold a key of the algorithm; of an algorithm not known here, whole DER."""
    inner = der_elements(body)
    if not inner or len(inner) != 1:
        return False
    tag, value = inner[0]
    if algorithm == RSA:
        return tag == SEQUENCE and private_shape(value) == "rsa"
    if algorithm == EC:
        return tag == SEQUENCE and private_shape(value) == "ec"
    if algorithm == DSA:
        return tag == INTEGER and _positive(value)
    if algorithm in CURVES_25519_448:
        return tag == OCTETS and len(value) in (32, 56, 57)
    return len(body) >= 16


def der_fits(data: bytes) -> bool:
    """Whether data is one private key in DER, to its last byte."""
    if len(data) < 16 or data[0] != SEQUENCE:
        return False
    of = _sequence(data)
    return of is not None and private_shape(of) is not None


class _Fields:
    """Reads the length-prefixed fields of an OpenSSH key; `fits` turns false where one does not."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.fits = data, at, True

    def number(self) -> int:
        if self.at + 4 > len(self.data):
            self.fits = False
            return 0
        self.at += 4
        return int.from_bytes(self.data[self.at - 4 : self.at], "big")

    def string(self) -> bytes:
        size = self.number()
        if self.at + size > len(self.data):
            self.fits = False
            return b""
        self.at += size
        return self.data[self.at - size : self.at]


# Key types, how many fields their public and private parts have after the name.
OPENSSH_TYPES = {b"ssh-rsa": (2, 6), b"ssh-dss": (4, 5), b"ssh-ed25519": (1, 2), b"ecdsa-sha2-nistp256": (2, 3), b"ecdsa-sha2-nistp384": (2, 3), b"ecdsa-sha2-nistp521": (2, 3), b"sk-ssh-ed25519@openssh.com": (2, None), b"sk-ecdsa-sha2-nistp256@openssh.com": (3, None)}


def openssh_fits(data: bytes) -> bool:
    """Whether data is an OpenSSH private key, to its last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    f = _Fields(data, len(magic))
    cipher, derivation, options, count = f.string(), f.string(), f.string(), f.number()
    if not f.fits or not 1 <= count <= 64 or not (cipher.isascii() and cipher.decode().isprintable() and cipher):
        return False
    types = []
    for _ in range(count):
        public = _Fields(f.string())
        types.append(public.string())
        known = OPENSSH_TYPES.get(types[-1])
        fields = 0
        while public.fits and public.at < len(public.data):
            public.string()
            fields += 1
        if not (f.fits and public.fits and known and fields == known[0]):
            return False
    private = f.string()
    if not f.fits or f.at != len(data) or not private or len(private) % 8:
        return False
    if cipher != b"none":
        return bool(derivation) and derivation != b"none" and len(options) > 0
    p = _Fields(private)
    if derivation != b"none" or options or p.number() != p.number():
        return False
    for of in types:
        if p.string() != of:
            return False
        fields = OPENSSH_TYPES[of][1]
        if fields is None:
            return p.fits  # keys held by a device: their fields vary
        for _ in range(fields + 1):  # and the comment
            p.string()
    rest = private[p.at :]
    return p.fits and rest == bytes(range(1, len(rest) + 1)) and len(rest) < 256


def key_fits(data: bytes | None) -> bool:
    return data is not None and (der_fits(data) or openssh_fits(data))


def _json_object(part: str) -> dict | None:
    data = from_base64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _hides_secret(data: bytes | None, depth: int) -> bool:
    """Whether data is text that holds a secret: an assignment or access key, a key file, a token, or something encoded once more."""
    if not data or len(data) < 12:
        return False
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    if not "".join(text.split()).isprintable():
        return False
    return any(k != "hex" for k, _, _ in base_spans(text)) or (depth > 1 and bool(structural_spans(text, depth - 1)))


def _encrypted_fits(head: str, data: bytes | None) -> bool:
    """Whether a key under encryption headers is whole blocks of the cipher that its vector is for."""
    dek = DEK.search(head) if "4,ENCRYPTED" in head else None
    return dek is not None and data is not None and len(data) >= 32 and len(data) % (len(dek[1]) // 2) == 0


def from_hex(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run[: len(run) // 2 * 2])
    except ValueError:
        return None


def _kind(data: bytes | None, depth: int) -> str | None:
    return "der" if key_fits(data) else "encoded" if _hides_secret(data, depth) else None


def wrapped_runs(text: str) -> list[list[tuple[int, int]]]:
    """Lines (start, end) of runs that may be one run wrapped: lines of one length, with and without a shorter one before and after."""
    out = []
    for m in WRAPPED.finditer(text):
        lines = [x.span(1) for x in RUN.finditer(m[0])]
        size = [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and size[j] == size[i]:
                j += 1
            if size[i] >= LINE:
                for a in (i - 1, i) if i and size[i - 1] < size[i] else (i,):
                    for b in (j + 1, j) if j < len(lines) and size[j] < size[i] else (j,):
                        if b - a > 1:
                            out.append([(x + m.start(), y + m.start()) for x, y in lines[a:b]])
            i = j
    return out


class _Covered:
    """Whether a span meets any of some disjoint spans, by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.ends = list(itertools.accumulate((b for _, b in self.spans), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)  # those before b
        return k > 0 and self.ends[k - 1] > a


def structural_spans(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Spans that decoding confirms; what is decoded is searched in the same way, `depth` encodings deep in all."""
    out = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = from_base64(re.sub(r"\\n|\\r|\s", "", m[3])) if m[1].endswith("PRIVATE KEY") else None
            if key_fits(data) or _encrypted_fits(m[2], data):
                out.append(("pem", *m.span()))
    if "eyJ" in text:
        for m in JWT.finditer(text):
            header = _json_object(m[1])
            if header and isinstance(header.get("alg"), str) and _json_object(m[2]) is not None:
                out.append(("jwt", *m.span()))
    covered = _Covered([(a, b) for _, a, b in out])
    alone = []
    for pattern, decode in ((BASE64, from_base64), (HEX_ANY, from_hex)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if covered.meets(a, b):
                continue
            if kind := _kind(decode(m[0]), depth):
                alone.append((kind, a, b))
    whole: list[tuple[str, int, int]] = []
    single = {(a, b) for _, a, b in alone}
    for lines in wrapped_runs(text):
        a, b = lines[0][0], lines[-1][1]
        if covered.meets(a, b) or (whole and whole[-1][1] <= a and b <= whole[-1][2]) or all(s in single for s in lines):
            continue
        run = "".join(text[x:y] for x, y in lines)
        if kind := _kind(from_base64(run), depth) or _kind(from_hex(run), depth):
            whole.append((kind, a, b))
    return out + alone + whole


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    spans = base_spans(text or "") + structural_spans(text or "")
    return sorted(set(spans), key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def secret_column(text: Column) -> Column:
    """A column of spans."""

    def start():
        return lambda t: ([{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)],)

    return rows_udf(start, f"spans {SPAN}")(text)["spans"]


def scan_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and `spans`."""
    return docs.select(F.col(id), secret_column(F.col(text)).alias("spans"))


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined; of some kinds only if given."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
