"""Secret scans with structural confirmation.

Base kinds (assignments, access ids, hex runs) are patterns alone. The method adds spans of candidates that
decode to something with the structure of a secret: base64 or hex whose bytes are a DER key (nested tags and
lengths that add up, with the versions and integers that a key has), an OpenSSH private key, a PEM block around
one of these or around an encrypted one, or a signed token whose header decodes to JSON with a named algorithm.
A key may start and end anywhere in a run of digits, which may go on over line ends, real or escaped; its own
lengths say where it ends.

Defined results: a null text is empty and has no secrets; repeated rows each get a row; an empty table gives no
rows; spans that start together come in the order of their kinds; extra columns are ignored by ``scan`` and kept by ``redact``; offsets are code points, ends exclusive. Texts are scanned whole;
time and memory are linear in the text, whatever starts in it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import id_and_text, per_batch

#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "token")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What may stand between two digits: a line end, real or escaped, with blanks; the backslash of an escaped slash.
GAP = r"(?>(?:[\x20\t]*(?:\r\n|\r|\n|\\+r\\+n|\\+n|\\+r))+[\x20\t]*|\\+(?=/))?"
BASE64, HEXES = r"[A-Za-z0-9+/_-]", r"[0-9A-Fa-f]"
#: For base64 and hex: how a DER sequence starts, its first nine bytes, digits without gaps.
STARTS = {
    digits: (re.compile(start), re.compile(rf"(?:{digits}{GAP}){{{n}}}"), re.compile(rf"{digits}+"))
    for digits, start, n in ((BASE64, "M[A-P]", 12), (HEXES, "30", 18))
}
GAPS = re.compile(GAP)
SSH_START = "b3BlbnNzaC1rZXkt"
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*){2,}")
JSON_START, QUOTES, DECODER = re.compile(r"\{\s*\""), re.compile(r"(?<!\\)(?:\\\\)*\""), json.JSONDecoder()
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"[A-Za-z0-9-]+:.*")
#: Object ids of password-based encryption: PKCS #5 and PKCS #12.
ENCRYPTION = tuple(bytes.fromhex("2a864886f70d01" + x) for x in ("05", "0c01"))
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG_WORD = 20
SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06
#: Parts of the key form that has most, an RSA key.
MOST_PARTS = 9
#: Characters of the longest thing that an error's place may lie before: an escape or a word of JSON.
LONGEST_ATOM = 16
MAGIC = b"openssh-key-v1\0"


def decode(text: str) -> bytes | None:
    """Bytes of a base64 or URL-safe base64 string, padded or not; None if it isn't one."""
    body = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _spans(read: Callable[[int, int], bytes], at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values of the DER items that fill the bytes from ``at`` to ``end`` exactly.

    None if a length doesn't add up or there are more items than any key has. Only the heads of items are read.
    """
    items = []
    while at < end:
        head = read(at, 6)[: end - at]
        if len(head) < 2 or len(items) == MOST_PARTS:
            return None
        tag, n, at = head[0], head[1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or len(head) < 2 + width:
                return None
            n, at = int.from_bytes(head[2 : 2 + width]), at + width
            if n < 0x80:
                return None
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def _is_key(read: Callable[[int, int], bytes], size: int) -> bool:
    """Whether the first ``size`` bytes are one DER sequence with the parts of a private or public key."""
    top = _spans(read, 0, size)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE or not (parts := _spans(read, *top[0][1:])):
        return False
    tags, sizes = [tag for tag, _, _ in parts], [end - start for _, start, end in parts]
    named = lambda k: bool(inner := _spans(read, *parts[k][1:])) and inner[0][0] == OID
    if tags[0] == INTEGER and sizes[0] == 1 and read(parts[0][1], 1)[0] <= 1:
        if tags[1:3] == [SEQUENCE, OCTETS]:  # algorithm, then the key in octets
            return named(1)
        if tags[1:2] == [OCTETS]:  # an elliptic-curve scalar
            return 16 <= sizes[1] <= 72
        return len(tags) >= 6 and set(tags) == {INTEGER}  # the integers of RSA or DSA
    if tags == [SEQUENCE, OCTETS]:  # a private key under a password
        return named(0) and read(_spans(read, *parts[0][1:])[0][1], 8).startswith(ENCRYPTION)
    if tags == [SEQUENCE, BITS]:
        return named(0)
    return tags == [INTEGER, INTEGER] and sizes[0] >= 64


def is_key(data: bytes) -> bool:
    return _is_key(lambda at, n: data[at : at + n], len(data))


def _ssh_size(read: Callable[[int, int], bytes], size: int) -> int:
    """Bytes of the OpenSSH private key at the start of ``size`` bytes (its magic, then strings whose lengths fit), else 0.

    It has three strings, the number of keys, which OpenSSH wants to be one, a public and a private part.
    """
    if read(0, len(MAGIC)) != MAGIC:
        return 0
    at = len(MAGIC)
    for k in range(6):
        n = int.from_bytes(read(at, 4)) if at + 4 <= size else None
        if n is None and k < 4 or k == 3 and n != 1:
            return 0
        at += 4 + (n or 0) * (k != 3) if n is not None else 0
    return min(at, size)


def ssh_size(data: bytes) -> int:
    return _ssh_size(lambda at, n: data[at : at + n], len(data))


def _read_object(shown: str, at: int) -> tuple[dict | None, int]:
    """(the JSON object at a place, or None, how far it was read), in time that goes with how far that is.

    An error counts the lines before it, so pieces are read, twice as long each time that one ends too early.
    One nested deeper than Python reads is none.
    """
    size = 512
    while True:
        try:
            header, end = DECODER.raw_decode(shown[at : at + size])
            return header, at + end
        except json.JSONDecodeError as error:
            over = error.msg.startswith("Unterminated")
            if at + size >= len(shown) or not over and error.pos < size - LONGEST_ATOM:
                return None, len(shown) if over else at + error.pos
        except (ValueError, RecursionError):
            return None, len(shown)
        size *= 2


def token_start(head: str) -> int | None:
    """Where a token's header starts in the digits before a dot: JSON to their end that names an algorithm."""
    for shift in range(4):
        part = head[shift:]
        data = decode(part)
        if data is None:
            continue
        shown = data.decode("latin-1")
        lead, tail = len(shown) - len(shown.lstrip()), len(shown.rstrip())
        # What was read from a place on tells of all places in it that stand as it does to quotes: each is read once.
        reach, quotes, at = [0, 0], 0, 0
        for m in JSON_START.finditer(shown):
            quotes, at = quotes + sum(1 for _ in QUOTES.finditer(shown, at, m.start())), m.start()
            start = 0 if m.start() == lead else m.start()
            if start % 3 or m.start() < reach[quotes % 2]:
                continue
            header, reach[quotes % 2] = _read_object(shown, m.start())
            if header is not None and reach[quotes % 2] >= tail and isinstance(header.get("alg"), str):
                return shift + start // 3 * 4
    return None


def is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(decode(text) or b""), dict)
    except (ValueError, RecursionError):
        return False


class Run:
    """The digits from a place on to where their run ends, over gaps; bytes anywhere in it are decoded when asked for."""

    def __init__(self, text: str, at: int, piece: re.Pattern, bare: bool):
        self.bare, self.starts, self.before, pieces, n = bare, [], [], [], 0
        while m := piece.match(text, at):
            self.starts.append(at)
            self.before.append(n)
            pieces.append(m[0])
            n, self.end = n + len(m[0]), m.end()
            at = GAPS.match(text, self.end).end()
        self.digits, self.aligned = "".join(pieces), {}

    def place(self, position: int) -> int:
        """The number of the digit at a position of the text."""
        k = bisect_right(self.starts, position) - 1
        return self.before[k] + position - self.starts[k]

    def after(self, place: int) -> int:
        """The position just behind the digits before a place."""
        k = bisect_left(self.before, place) - 1
        return self.starts[k] + place - self.before[k]

    def size(self, place: int) -> int:
        """Bytes from a place on."""
        left = len(self.digits) - place
        return left * 3 // 4 if self.bare else left // 2

    def reader(self, place: int) -> Callable[[int, int], bytes]:
        """Reads some bytes at a distance from a place. The digits are decoded once for each alignment."""
        width, size = (4, 3) if self.bare else (2, 1)
        shift = place % width
        if shift not in self.aligned:
            digits = self.digits[shift:]
            digits = digits[: len(digits) - (len(digits) % 4 == 1 if self.bare else len(digits) % 2)]
            self.aligned[shift] = (decode(digits) or b"") if self.bare else bytes.fromhex(digits)
        data, base = self.aligned[shift], place // width * size
        return lambda at, n: data[base + at : base + at + n]


def _der_size(head: bytes) -> int:
    """Bytes of the DER sequence that starts with these nine; 0 if no key starts so."""
    n, at = head[1], 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4:
            return 0
        n, at = int.from_bytes(head[2 : 2 + width]), 2 + width
    return at + n if head[0] == SEQUENCE and head[at] in (INTEGER, SEQUENCE) else 0


def _padded(text: str, end: int, pad: int) -> int:
    while pad and text[end : end + 1] == "=":
        end, pad = end + 1, pad - 1
    return end


def _keys(text: str) -> list[tuple[int, int, str]]:
    """Spans of DER and OpenSSH keys in base64 or hex, wherever they start.

    A run of digits is read once; for each start in it the heads of a key's few parts are looked at.
    """
    found = []
    for digits, (start, first, piece) in STARTS.items():
        done, bare, run = 0, digits == BASE64, None
        for m in start.finditer(text):
            at = m.start()
            if at < done:
                continue
            if run is None or at >= run.end:
                if not first.match(text, at):
                    continue
                run = Run(text, at, piece, bare)
            place = run.place(at)
            if run.size(place) < 9:
                continue
            read = run.reader(place)
            size = _der_size(read(0, 9))
            if size and size <= run.size(place) and _is_key(read, size):
                n = -(-size * 4 // 3) if bare else 2 * size
                done = _padded(text, run.after(place + n), -n % 4 if bare else 0)
                found.append((at, done, "der"))
    at, run = text.find(SSH_START), None
    while at >= 0:
        if run is None or at >= run.end:
            run = Run(text, at, STARTS[BASE64][2], True)
        place, end = run.place(at), at + 1
        if size := _ssh_size(run.reader(place), run.size(place)):
            end = _padded(text, run.after(place + -(-size * 4 // 3)), -size % 3)
            found.append((at, end, "ssh"))
        at = text.find(SSH_START, end)
    return found


def _pem(text: str) -> list[tuple[int, int, str]]:
    """Spans of PEM blocks around a private key, one under a password among them."""
    found, begun = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if begun[2] == m[2]:
                lines = re.sub(r"\\+r\\+n|\\+[nr]|\r\n?", "\n", text[begun.end() : m.start()]).replace("\\", "").split("\n")
                lines = [x.strip() for x in lines]
                headers = [x for x in lines if PEM_HEADER.fullmatch(x)]
                data = decode("".join("".join(x.split()) for x in lines if not PEM_HEADER.fullmatch(x)))
                locked = any(x.startswith("DEK-Info:") for x in headers) and data and len(data) % 8 == 0
                if data and (locked or is_key(data) or ssh_size(data)):
                    found.append((begun.start(), m.end(), "pem"))
            begun = None
    return found


def _base(text: str) -> list[tuple[int, int, str, str]]:
    found = []
    folded = text.lower()
    if any(word in folded for word in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans), each (start, end, kind) in order."""
    base, more = _base(text), []
    for m in WORD.finditer(text) if max(map(len, text.split()), default=0) >= LONG_WORD else ():
        if m.end() - m.start() < LONG_WORD:
            continue
        word, at = m[0], m.start()
        for h in LONG_HEX.finditer(word):
            base.append((at + h.start(), at + h.end(), "hex", h[0]))
        for t in DOTTED.finditer(word):
            parts, here = t[0].split("."), at + t.start()
            for k in range(len(parts) - 2):
                start = token_start(parts[k]) if len(parts[k]) >= 12 and is_object(parts[k + 1]) else None
                if start is not None:
                    more.append((here + start, here + sum(map(len, parts[k : k + 3])) + 2, "token"))
                here += len(parts[k]) + 1
    more += _keys(text)
    if "-----BEGIN " in text:
        more += _pem(text)
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted((x[:3] for x in base), key=order), sorted(set(more), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column(1):
            base, more = find(value.as_py() or "")
            kinds = [kind for _, _, kind in base]
            spans = sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(list(x), type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return id_and_text(df, id_col, text_col).mapInArrow(per_batch(run), schema)


def redacted(text: str) -> str:
    """The text with each secret, base or added, replaced by its kind; overlapping ones by the first's."""
    base, more = find(text)
    out, at = [], 0
    for start, end, kind in sorted([*base, *more], key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of ``text_col`` replaced; other columns as they were, nulls stay null."""

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda x: x if x is None else redacted(x))

    return df.withColumn(text_col, clean(F.col(text_col)))
