"""Keys and tokens in the forms in which they lie in texts."""

from __future__ import annotations

import base64
import json
import time

import pytest

from storyloom.llm import secrets


def _der(tag, value):
    n = len(value)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + value


def _string(x):
    return len(x).to_bytes(4) + x


RSA = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([k + 1] * 70)) for k in range(8)))
OWN = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, bytes.fromhex("2a864886f70d010101")) + _der(5, b"")) + _der(4, RSA))
LOCKED = _der(0x30, _der(0x30, _der(6, bytes.fromhex("2a864886f70d01050d")) + _der(0x30, b"")) + _der(4, bytes(range(200))))
SSH = b"openssh-key-v1\0" + _string(b"none") * 2 + _string(b"") + (1).to_bytes(4) + _string(bytes(51)) + _string(bytes(range(140)))
B64 = base64.b64encode(OWN).decode()
LINES = [B64[i : i + 64] for i in range(0, len(B64), 64)]
MARKS = "-----BEGIN PRIVATE KEY-----{}-----END PRIVATE KEY-----"
URL = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
CLAIMS = URL(json.dumps({"sub": "1"})) + ".c2lnbmF0dXJl"
FORMS = {
    "service account": ("pem", '{"private_key": "' + MARKS.format("\\n" + "\\n".join(LINES) + "\\n") + '\\n", "x": 1}'),
    "escaped twice": ("pem", MARKS.format("\\\\n" + "\\\\n".join(LINES) + "\\\\n")),
    "header lines": ("pem", MARKS.format("\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n" + base64.b64encode(bytes(range(160))).decode() + "\n")),
    "header lines, not locked": ("pem", MARKS.format("\nComment: mine\n\n" + "\n".join(LINES) + "\n")),
    "encrypted": ("pem", MARKS.replace("PRIVATE", "ENCRYPTED PRIVATE").format("\n" + base64.b64encode(LOCKED).decode() + "\n")),
    "encrypted, bare": ("der", base64.b64encode(LOCKED).decode()),
    "escaped line end": ("der", "x\\n" + B64),
    "address": ("der", "https://host.org/" + B64),
    "after a line": ("der", "key_" + B64),
    "after a dash": ("der", "key-" + B64 + "/more"),
    "escaped slashes": ("der", B64.replace("/", "\\/")),
    "upper-case hex": ("der", RSA.hex().upper()),
    "hex with 0x": ("der", "0x" + RSA.hex()),
    "wrapped": ("der", "key:\n" + "\n".join(LINES) + "\nend"),
    "wrapped and indented": ("der", "key:\r\n  " + "\r\n  ".join(LINES) + "\r\nend"),
    "wrapped hex": ("der", "\n".join(RSA.hex().upper()[i : i + 60] for i in range(0, 2 * len(RSA), 60))),
    "ssh, wrapped": ("ssh", "id_" + base64.b64encode(SSH[:60]).decode() + "\n" + base64.b64encode(SSH[60:]).decode()),
    "token, blank in header": ("token", URL('{ "alg": "HS256"}') + "." + CLAIMS),
    "token, line end in header": ("token", URL('{\r\n "alg": "HS256"}') + "." + CLAIMS),
    "token, blank first": ("token", URL(' {"alg": "HS256"}') + "." + CLAIMS),
    "token after a line": ("token", "id_" + URL('{"alg": "HS256"}') + "." + CLAIMS),
    "token after names": ("token", "host.name." + URL('{"alg": "HS256"}') + "." + CLAIMS),
}


@pytest.mark.parametrize("form", FORMS)
def test_each_form_is_found_and_redacted(form):
    kind, text = FORMS[form]
    assert kind in [k for _, _, k in secrets.find(f"before {text} after")[1]]
    clean = secrets.redacted(f"before {text} after")
    assert clean.startswith("before ") and clean.endswith(" after") and len(clean) < 90
    assert not any(x in clean for x in (B64[40:60], RSA.hex()[40:60], RSA.hex()[40:60].upper(), CLAIMS))


def test_what_is_no_key_is_left():
    digest = _der(0x30, _der(0x30, _der(6, bytes.fromhex("608648016503040201")) + _der(5, b"")) + _der(4, bytes(32)))
    for text in (base64.b64encode(digest).decode(), "\n".join(LINES)[:-9], "MIIE" + "A" * 900, MARKS.format("\nProc-Type: 4\n\nabcd\n")):
        assert secrets.find(text)[1] == []


def test_long_odd_texts_take_little_time():
    began = time.process_time()
    for odd in ("MIIE", "MA\r\n \\r\\n ", "30", "eyJh", "a.", "A\n", "\\n", "-----BEGIN PRIVATE KEY-----\n", "MIGfMA0G"):
        secrets.find(odd * 20_000)
    assert time.process_time() - began < 20


def _b64(data):
    return base64.b64encode(data).decode()


#: Pieces that, repeated, make each start claim much of what follows, or read far before it fails.
HOSTILE = {
    "der, 64 KB": _b64(bytes([0x30, 0x82, 0xFF, 0xFF, 2, 1, 0, 0x30, 0x82])),
    "der, 1 MB": _b64(bytes([0x30, 0x83, 0x0F, 0x42, 0x40, 2, 1, 0, 0x30])),
    "der, 16 MB": _b64(bytes([0x30, 0x83, 0xFF, 0xFF, 0xFF, 2, 1, 0, 0x30])),
    "der, hex": bytes([0x30, 0x83, 0x0F, 0x42, 0x40, 2, 1, 0, 0x30]).hex(),
    "der, lines": _b64(bytes([0x30, 0x83, 0x0F, 0x42, 0x40, 2, 1, 0, 0x30])) + "\n",
    "der, items of one chain": _b64(bytes([0x30, 0x82, 0x40, 0, 2, 1, 0, 2, 1, 0, 2, 0x0A])),
    "ssh": _b64(b"openssh-key-v1\0" + bytes(3)),
    "ssh, many keys": _b64(b"openssh-key-v1\0" + bytes(12) + (0x7FFFFFFF).to_bytes(4) + bytes(2)),
}
HEADS = ('{"', '{"a":', '{"' + "a" * 300 + '":', '{"a":1}', '{"k":"{",', '{"\\\\', '{"k":1},')


def test_hostile_starts_are_linear():
    """A megabyte of each takes about a second; with the square of the text it would be minutes."""
    for name, piece in HOSTILE.items():
        began = time.process_time()
        secrets.find(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 6, name
    for piece in HEADS:
        began = time.process_time()
        secrets.find(URL(piece * (700_000 // len(piece))) + "." + CLAIMS)
        assert time.process_time() - began < 6, piece


def test_keys_among_hostile_starts_are_found():
    for piece in HOSTILE.values():
        kinds = [kind for _, _, kind in secrets.find(piece * 50 + "\n\n " + B64 + " " + piece * 50)[1]]
        assert "der" in kinds
    for piece in HEADS:
        head = piece * 3
        assert "token" in [k for _, _, k in secrets.find("x " + URL('{"alg": "HS256", "x": {"y": "{"}}') + "." + CLAIMS + " " + URL(head) + "." + CLAIMS)[1]]
