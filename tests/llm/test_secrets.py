import base64
import hashlib
import time

import pytest
from voxelstream.llm import secrets


def field(data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + data


def material(n: int) -> bytes:
    return b"".join(hashlib.sha256(bytes([i]) if i < 256 else str(i).encode()).digest() for i in range(n // 32 + 1))[:n]


@pytest.mark.parametrize(("curve", "size"), [(b"nistp256", 65), (b"nistp384", 97), (b"nistp521", 133)])
def test_ecdsa_blobs(curve, size):
    coded = base64.b64encode(field(b"ecdsa-sha2-" + curve) + field(curve) + field(b"\x04" + material(size - 1))).decode()
    text = f"key: {coded} user@host"
    assert [(text[a:b], kind) for a, b, kind in secrets.confirmed_spans(text)] == [(coded, "ssh")]


def der(tag: int, data: bytes) -> bytes:
    n = len(data)
    return bytes([tag, n]) + data if n < 128 else bytes([tag, 0x82]) + n.to_bytes(2, "big") + data


ED25519 = field(b"ssh-ed25519") + field(material(32))
OPENSSH = b"openssh-key-v1\x00" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(ED25519) + field(material(136))


def whole(text: str) -> list[tuple[str, str]]:
    return [(text[a:b], kind) for a, b, kind in secrets.confirmed_spans(text)]


def test_unpadded_blob_before_a_line_of_letters():
    for data, kind in ((ED25519, "ssh"), (der(0x30, der(2, material(31))), "der"), (OPENSSH, "openssh")):
        for more in ("\nuser\nagain", "\r\n  nextword here", "\\nabcd", " abcd", ""):
            coded = base64.b64encode(data).decode().rstrip("=")
            assert whole(f"x: {coded}{more}") == [(coded, kind)], (kind, more)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\n\t", "\\n", "\\r\\n", "\\\\n"])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_keys(end, width):
    for size in range(180, 330):
        data = der(0x30, der(2, b"\x00") + der(2, material(size)))
        coded = base64.b64encode(data).decode()
        lines = end.join(coded[i : i + width] for i in range(0, len(coded), width))
        text = f"{{'key': '-----BEGIN PRIVATE KEY-----{end}{lines}{end}-----END PRIVATE KEY-----{end}'}}"
        assert whole(text) == [(lines, "der")]


def test_keys_one_after_the_other_and_no_keys():
    key = base64.b64encode(der(0x30, der(2, material(31)) + der(2, material(31)))).decode().rstrip("=")
    assert whole(f"{key}\n{key}\nwords") == [(key, "der")] * 2
    assert whole(f"{key}x") == whole(f"x{key}") == whole(f"{key[:-4]}\n") == whole("\n".join(["AAAA" * 16] * 3000)) == []
    cut = base64.b64encode(OPENSSH).decode()[:120]
    assert whole(f"a {cut} b") == [(cut, "openssh")]


OID_RSA = bytes.fromhex("06092a864886f70d010101") + b"\x05\x00"
RSA = der(0x30, der(2, b"\x00") + b"".join(der(2, b"\x01" + material(n)) for n in (128, 2, 127, 64, 63, 64, 62, 64)))
PKCS8 = der(0x30, der(2, b"\x00") + der(0x30, OID_RSA) + der(4, RSA))
SEC1 = der(0x30, der(2, b"\x01") + der(4, material(32)) + der(0xA0, bytes.fromhex("06082a8648ce3d030107")) + der(0xA1, der(3, b"\0\4" + material(64))))
ENCRYPTED = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d01050d") + der(0x30, material(40))) + der(4, material(160)))
CERTIFICATE = der(0x30, der(0x30, der(0xA0, der(2, b"\x02")) + der(2, material(9)) + der(0x30, OID_RSA) + material(0) + der(0x30, der(0x31, der(0x30, OID_RSA)))) + der(0x30, OID_RSA) + der(3, b"\0" + material(128)))
PUBLIC = der(0x30, der(0x30, OID_RSA) + der(3, b"\0" + material(140)))


def wrapped(data: bytes, width: int = 64, end: str = "\n") -> str:
    coded = base64.b64encode(data).decode()
    return end.join(coded[i : i + width] for i in range(0, len(coded), width))


def test_layouts_of_keys():
    for data in (RSA, PKCS8, SEC1, ENCRYPTED):
        coded = wrapped(data)
        assert whole(f"-----BEGIN-----\n{coded}\n-----END-----\n") == [(coded, "der")]
    for data in (CERTIFICATE, PUBLIC, der(0x30, der(4, material(60))), der(0x30, der(2, b"\1") + der(5, b"") * 20)):
        assert whole(f"-----BEGIN-----\n{wrapped(data)}\n-----END-----\n") == whole(data.hex()) == []


def test_base64url_keys():
    for data, kind in ((SEC1, "der"), (PKCS8, "der"), (ED25519, "ssh"), (OPENSSH, "openssh")):
        coded = base64.urlsafe_b64encode(data).decode()
        assert "-" in coded or "_" in coded or kind != "der"
        assert whole(f"k={coded}.") == [(coded, kind)]
        assert whole(f"k={coded.rstrip('=')} and-more_words") == [(coded.rstrip("="), kind)]


def test_security_keys_and_keys_after_a_slash():
    for fields in ([b"sk-ssh-ed25519@openssh.com", material(32), b"ssh:"], [b"sk-ecdsa-sha2-nistp256@openssh.com", b"nistp256", b"\4" + material(64), b"ssh:"]):
        coded = base64.b64encode(b"".join(map(field, fields))).decode()
        assert whole(f"{coded} me") == whole(f"a/{coded} me") == [(coded, "ssh")]
        fewer = base64.b64encode(b"".join(map(field, fields[:-1]))).decode()
        assert whole(f"{fewer} me") == []


@pytest.mark.parametrize("end", ["\n", "\r\n  ", "\\n"])
def test_hex_over_lines(end):
    coded = SEC1.hex()
    lines = end.join(coded[i : i + 32] for i in range(0, len(coded), 32))
    assert whole(f"key {coded} x") == [(coded, "der")]
    assert whole(f"{lines}\nwords and 00") == [(lines, "der")]
    assert whole(f"0123456789abcdef0123{end}{lines}{end}beef{end}x") == [(lines, "der")]
    assert whole(lines[:-2]) == []


def test_long_texts_take_linear_time():
    """Megabytes of base64 lines, of lines that could each begin a key, of zeros and of hex."""
    keys = "\n".join([wrapped(PKCS8)] * 300)
    texts = [base64.b64encode(material(3_700_000)).decode(), "MIIC" * 1_200_000, "AAAA" * 1_200_000, "MIIE" + "A" * 60, "30820400" * 600_000, "/MIIBOgIBAAJB" * 400_000]
    for text in texts:
        lines = "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) if len(text) > 64 else "\n".join([text] * 70_000)
        began = time.time()
        secrets.confirmed_spans(lines)
        assert time.time() - began < 8
    assert len(whole(keys)) == 300
