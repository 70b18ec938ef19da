import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib

import zstandard

from freqforge.llm import secrets

S = 'token = "abcdef0123456789"'
VALUE = "token = \"abcdef0123456789"


def kinds(text):
    return [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.scan(text)[1]]


def test_base():
    assert kinds("PassWord: hunter22 x") == [("assign", "PassWord: hunter22")]
    assert kinds("api_key='abc'") == []
    assert kinds("id AKIA" + "A" * 16) == [("access", "AKIA" + "A" * 16)] and not kinds("AKIA" + "A" * 15)
    assert kinds("f" * 24 + " " + "f" * 23) == [("hex", "f" * 24)]
    assert kinds("ſecret=abcdefgh") == [] and secrets.scan(None) == ([], []) and secrets.scan("") == ([], [])


def wraps():
    b = lambda raw: base64.b64encode(raw).decode()
    yield lambda t: b(t.encode())
    yield lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    yield urllib.parse.quote
    yield lambda t: "".join(f"%{x:02x}" for x in t.encode())
    yield lambda t: "".join(f"\\u{ord(c):04x}" for c in t)
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        yield lambda t, pack=pack: b(pack(t.encode()))


def test_each_layer_and_two_layers():
    for one in wraps():
        text = "é before " + one(S) + " after"
        base, all_ = secrets.scan(text)
        inner = [(s, e) for s, k, e in all_ if k == 0]
        assert inner and text[inner[0][0] : inner[0][1]] in one(S)
        for two in wraps():
            text = "x " + two(one("é " + S)) + " y"
            assert any(k == 0 and s >= 2 and e <= len(text) - 2 for s, k, e in secrets.scan(text)[1]), (one, two)
            assert "0123456789" not in secrets.redact(text, secrets.scan(text)[1])


def test_cycles_and_bombs_end():
    blob = base64.b64encode(gzip.compress(b"a" * 40_000_000)).decode()
    assert secrets.scan(blob)[0] == []
    t = S
    for _ in range(12):
        t = base64.b64encode(t.encode()).decode()
    assert secrets.scan(t)[1]


def test_base_spans_stay():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice([S, "%41%42", "word", base64.b64encode(S.encode()).decode(), "\\u0041", "f" * 30, "é"]) for _ in range(8))
        base, all_ = secrets.scan(text)
        assert set(base) <= set(all_) and all_ == sorted(all_)


def test_operator(odd, none):
    assert not secrets.with_spans(none).collect()
    got = secrets.with_spans(odd)
    assert got.count() == odd.count() and "shard" in got.columns
    kept = secrets.redacted(odd)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))
    assert secrets.redact("a " + S + " b", secrets.scan("a " + S + " b")[1]) == "a [assign]\" b"


def test_compressed_layers_are_scanned_to_their_end():
    b = lambda raw: base64.b64encode(raw).decode()
    for fill in ("é ", "x "):
        blob = b(gzip.compress((fill * (9 << 20) + S).encode(), 1))
        assert kinds("a " + blob + " b") == [("assign", blob)]
    inner = b(S.encode() + b" word" * 4_000_000)  # base64 longer than a piece
    blob = b(gzip.compress(("a " + inner).encode(), 1))
    assert kinds(blob) == [("assign", blob)]
    inner = b(random.Random(3).randbytes(1 << 20) * 14 + b" " + S.encode())
    blob = b(gzip.compress(("a: " + inner + " b").encode(), 1))
    assert kinds(blob) == [("assign", blob)]
    raw = S.encode()
    for _ in range(60):
        raw = zlib.compress(raw)
    assert kinds(b(raw)) == [("assign", b(raw))]


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    monkeypatch.setattr(secrets, "STEP", 100)
    for n in [*range(3950, 4150, 7), 9000]:
        for s in (S, "token" + " " * 9000 + "= abcdef0123456789", base64.b64encode(b"z" * 3000 + b" " + S.encode()).decode()):
            blob = base64.b64encode(gzip.compress(("é " * (n // 2) + "_ "[: n % 2] + s).encode())).decode()
            assert ("assign", blob) in kinds(blob), (n, s[:10])


def test_ordinary_encoded_layers():
    rng = random.Random(2)
    words = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    for raw in (f"{words} {S} {words}".encode(), gzip.compress(f"{words} {S}".encode()), zlib.compress(f"{words} {S}".encode())):
        for shift in range(0, 60, 7):
            blob = base64.encodebytes(b" " * shift + raw if raw[:1] == b"w" else raw).decode()
            for t in (blob, blob.replace("\n", "\r\n"), blob.replace("\n", "\n  "), blob.replace("\n", "\\n"), blob.replace("=", "")):
                got = secrets.scan("a\n" + t + "\nb")[1]
                assert any(k == 0 for _, k, _ in got), t
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert kinds(base64.b64encode(pack(b"first") + pack(S.encode())).decode())
    for odd in (b"\xe9t\xe9 ", bytes(range(128, 256)), b"\x00\xff"):
        assert kinds(base64.b64encode(odd + S.encode() + odd).decode())
    for one in (base64.b64encode(S.encode()).decode(), base64.b64encode(gzip.compress(S.encode())).decode(), base64.b64encode(zlib.compress(S.encode())).decode()):
        for before in ("/", "a", "v1/key/", "x-", "https://host/path_", "data-"):
            text = before + one
            assert any(k == 0 for _, k, _ in secrets.scan(text)[1]), text
            assert S[9:25] not in secrets.redact(text, secrets.scan(text)[1])


def test_equal_layers_at_several_places():
    """What a layer holds counts wherever it stands, also where one token gives the same layer as another that begins with it."""
    one = base64.b64encode(S.encode()).decode()
    text = f"{one} x {one}"
    got = {(s, e) for s, k, e in secrets.scan(text)[1] if k == 0}
    assert len(got) == 2 and min(got)[1] <= len(one) and max(got)[0] >= len(one) + 3
    assert S[9:25] not in secrets.redact(text, secrets.scan(text)[1])
