"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned for three kinds: `assign` (a password, token or key with a
value), `access` (an access key id) and `hex` (a long hexadecimal run). A layer's URL escapes, Unicode
escapes, base64 tokens and compressed contents make further layers, which are scanned and
unwrapped in turn until there are no new ones; a layer whose text has been seen before at the same place is not gone
through again, so cycles end. Each character of a layer knows the span of the original
text it came from, and so does each finding.

Compressed contents (gzip, zlib, bzip2, xz, zstandard; inside base64) map to the whole token and
are unwrapped to their end, through all members and levels. Contents of more than PIECE bytes are
never held whole: they are scanned as a stream in pieces that overlap by OVERLAP characters, and
base64 that is longer than the overlap is decoded as a stream of its own.

Cases: null and empty texts have no spans; texts are scanned whole, however long; equal rows get
equal results; an empty table gives no rows; other columns go along, ones named like an output
column give way.
"""
from __future__ import annotations

import binascii
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..functions.ship import ship
from .common import read
from .zdict import add_columns

PIECE = 16 << 20
OVERLAP = 1 << 20
STEP = 1 << 18
MIN_TOKEN = 16

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

_ASSIGN = re.compile(f"(?ai:{ASSIGN})")
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])  # runs are maximal, so shorter ones can be passed over
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_IN_RUN = re.compile(r"[A-Za-z0-9+/_\r\n-]*")
_SPACES = re.compile(r"\x20{65,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
_BREAK = r"(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*)"
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:%s[A-Za-z0-9+/_-]++)++={0,2}" % (MIN_TOKEN, _BREAK))
_BREAKS = re.compile(_BREAK)
_ROOM = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")
#: how gzip, zlib, bzip2, xz and zstandard data begin in base64
_BEGINS = re.compile(r"H4sI|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])|QlpoO|QlpoM|QlpoN|/Td6WFoA|KLUv/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one layer."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text; spans[i] is where its character i came from, None for the original itself; a tuple is
    where all of it came from."""

    __slots__ = ("text", "spans")

    def __init__(self, text: str, spans: list[tuple[int, int]] | tuple[int, int] | None) -> None:
        self.text, self.spans = text, spans

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.spans is None:
            return start, end
        if isinstance(self.spans, tuple):
            return self.spans
        part = self.spans[start:end]
        return min(s for s, _ in part), max(e for _, e in part)


def _from_bytes(raw: bytes, at, whole: tuple[int, int] | None = None) -> Layer | None:
    """at(first byte, last byte + 1): where these bytes came from, or all of them from whole. Secrets and
    escapes are ASCII, so only parts with room for one are kept, whatever is between them; None without any."""
    if whole is not None:
        text = _ascii(raw)
        return Layer(text, whole) if text else None
    text, spans = [], []
    for m in _ROOM.finditer(raw):
        text.append(m[0].decode())
        spans.extend(at(k, k + 1) for k in range(m.start(), m.end()))
        text.append("\0")
        spans.append(spans[-1])
    return Layer("".join(text), spans) if text else None


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by decode(match): [(character, start, end)] or None."""
    text, spans, done, changed = [], [], 0, False

    def keep(a: int, b: int) -> None:
        text.append(layer.text[a:b])
        if not isinstance(layer.spans, tuple):
            spans.extend(layer.spans[a:b] if layer.spans is not None else ((i, i + 1) for i in range(a, b)))

    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        keep(done, m.start())
        for c, a, b in got:
            text.append(c)
            spans.append(layer.origin(a, b))
        done, changed = m.end(), True
    if not changed:
        return None
    keep(done, len(layer.text))
    return Layer("".join(text), layer.spans if isinstance(layer.spans, tuple) else spans)


def _url(m: re.Match):
    raw = binascii.unhexlify(m[0].replace("%", ""))
    out, k = [], 0
    for c in raw.decode("utf-8", "replace"):
        n = len(c.encode()) if c != "�" else 1
        out.append((c, m.start() + 3 * k, min(m.end(), m.start() + 3 * (k + n))))
        k = min(k + n, len(raw) - 1)
    return out


def _unicode(m: re.Match):
    code = int(next(g for g in m.groups() if g), 10 if m[6] else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), m.start(), m.end())]


class _Chunks(io.RawIOBase):
    """Pieces of bytes as a file."""

    def __init__(self, chunks) -> None:
        self.chunks, self.rest = iter(chunks), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            self.rest = next(self.chunks, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def _packed(raw: bytes) -> bool:
    zlib_head = raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0
    return zlib_head or raw.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"))


def _inflate(chunks):
    """Contents of compressed bytes in pieces of about STEP, all members and frames of them; what
    comes before a damaged part."""
    file = io.BufferedReader(_Chunks(chunks), STEP)
    head = file.peek(8)[:8]
    try:
        if head[:1] == b"\x78":
            d, raw = zlib.decompressobj(), file.read(STEP)
            while raw:
                yield d.decompress(raw, STEP)
                while d.unconsumed_tail:
                    yield d.decompress(d.unconsumed_tail, STEP)
                raw = d.unused_data or file.read(STEP)
                if d.eof:
                    d = zlib.decompressobj()
            return
        if head[:2] == b"\x1f\x8b":
            f = gzip.GzipFile(fileobj=file)
        elif head[:3] == b"BZh":
            f = bz2.BZ2File(file)
        elif head[:4] == b"\x28\xb5\x2f\xfd":
            f = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
        else:
            f = lzma.LZMAFile(file)
        with f:
            while got := f.read1(STEP) if hasattr(f, "read1") else f.read(STEP):
                yield got
    except _BROKEN:
        return


def _head(make, n: int) -> bytes:
    """The first n bytes of a stream."""
    out = b""
    for c in make():
        out += c
        if len(out) >= n:
            break
    return out[:n]


def _upto(make, n: int) -> bytes | None:
    """All bytes of a stream; None if there are more than n."""
    out, size = [], 0
    for c in make():
        out.append(c)
        size += len(c)
        if size > n:
            return None
    return b"".join(out)


def _contents(make, whole: tuple[int, int]):
    """Layers of what make() gives, unwrapped as long as it is compressed."""
    seen = set()
    while _packed(_head(make, 8)):
        inner = lambda make=make: _inflate(make())
        if not _head(inner, 1):
            break
        make, small = inner, _upto(inner, PIECE)
        if small is not None:
            mark = hashlib.blake2b(small, digest_size=16).digest()
            if mark in seen:
                return
            seen.add(mark)
            make = lambda small=small: iter([small])
    yield from _stream(make, whole)


def _texts(make):
    """A stream's bytes as characters: what is looked for is ASCII, so none can be cut."""
    for c in make():
        yield c.decode("latin-1")


def _ascii(raw: bytes) -> str:
    """The parts of a text that have room for a secret; without long gaps, which an assignment may
    have and which must not use up an overlap."""
    return _SPACES.sub(" " * 64, b"\0".join(_ROOM.findall(raw)).decode())


def _run(make, start: int, off: int):
    """Bytes of the base64 that starts off characters after the character start of a stream."""
    at, rest, skip = 0, "", off
    for t in _texts(make):
        at += len(t)
        if at <= start:
            continue
        t = t[max(0, len(t) - (at - start)) :]
        m = _IN_RUN.match(t)
        got = m[0].replace("\r", "").replace("\n", "").replace("-", "+").replace("_", "/")
        rest += got[skip:]
        skip = max(0, skip - len(got))
        n = len(rest) // 4 * 4
        yield binascii.a2b_base64(rest[:n])
        rest = rest[n:]
        if m.end() < len(t):
            break
    if len(rest) > 1:
        yield binascii.a2b_base64(rest + "=" * (-len(rest) % 4))


def _stream(make, whole: tuple[int, int]):
    """Layers of a stream's text in overlapping pieces, and of base64 longer than the overlap."""
    held, size, at, runs, within = [], 0, 0, [], False
    for t in _texts(make):
        held.append(t)
        size += len(t)
        if size < PIECE:
            continue
        text = "".join(held)
        yield Layer(_ascii(text.encode("latin-1")), whole)
        start = len(text.rstrip(_BASE64 + "\r\n"))
        long = size - start > OVERLAP // 2
        if long and (start or not within):
            runs.append(at + start)
        within = long
        tail = max(0, size - OVERLAP)
        gap = len(text.rstrip(" "))
        held = [text[tail:]] if gap > tail else [text[max(0, gap - OVERLAP) : gap], " " * 64]
        end, size = at + size, sum(map(len, held))
        at = end - size
    if size:
        yield Layer(_ascii("".join(held).encode("latin-1")), whole)
    for start in runs:
        for off in range(4):
            yield from _contents(lambda start=start, off=off: _run(make, start, off), whole)


def _base64(layer: Layer):
    """Layers of base64 tokens, and of the lines of wrapped base64 together."""
    for m in _TOKEN.finditer(layer.text):
        yield from _token(layer, m[0], range(m.start(), m.end()))
    for m in _WRAPPED.finditer(layer.text):
        places, done = [], m.start()
        for gap in _BREAKS.finditer(layer.text, m.start(), m.end()):
            places.extend(range(done, gap.start()))
            done = gap.end()
        places.extend(range(done, m.end()))
        yield from _token(layer, _BREAKS.sub("", m[0]), places)


def _token(layer: Layer, token: str, places):
    """Layers of a token whose character i is at places[i]. What it touches may look like a part of it, so
    it is decoded from each of its first four characters, and from wherever compressed data begins."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    n = len(body)
    last = len(token) - 1
    constant = layer.spans if isinstance(layer.spans, tuple) else None
    for m in _BEGINS.finditer(body):
        probe = _raw(body[m.start() : m.start() + 1024])
        if _packed(probe) and _opens(probe):
            raw = _raw(body[m.start() :])
            yield from _contents(lambda raw=raw: iter([raw]), layer.origin(places[m.start()], places[last] + 1))
    for off in range(min(4, n - MIN_TOKEN + 1)):
        def at(a: int, b: int, off=off) -> tuple[int, int]:
            return layer.origin(places[off + a * 8 // 6], places[min(last, off - (-b * 8 // 6) - 1)] + 1)

        got = _from_bytes(_raw(body[off:]), at, constant)
        if got is not None:
            yield got


def _raw(body: str) -> bytes:
    """Bytes of base64; a single character over is none."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _opens(probe: bytes) -> bool:
    """Whether these bytes may begin compressed data; zlib's short mark is also found by chance."""
    if probe[:1] == b"\x78":
        try:
            zlib.decompressobj().decompress(probe)
        except zlib.error:
            return False
    return True


def _inner(layer: Layer):
    """The layers in a layer, one by one."""
    if "%" in layer.text:
        yield _substituted(layer, _URL, _url)
    if "\\" in layer.text or "&#" in layer.text:
        yield _substituted(layer, _UNICODE, _unicode)
    yield from _base64(layer)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end): the text's own spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    found, seen = set(base), set()
    work = [iter([Layer(text, None)])]
    while work:
        layer = next(work[-1], work)
        if layer is work:
            work.pop()
            continue
        if layer is None:
            continue
        if layer.spans is not None:
            mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hash(tuple(layer.spans))
            if mark in seen or not layer.text:
                continue
            seen.add(mark)
            for s, kind, e in base_spans(layer.text):
                a, b = layer.origin(s, e)
                found.add((a, kind, b))
        work.append(_inner(layer))
    return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one mark, named for the first."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _report(text: str | None):
    base, spans = scan(text)
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return add_columns(docs, text, schema, [pa.int64()] * 3 + [pa.string()] * 2, lambda: _report)


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced by the name of their kind in brackets, and n_chars to match;
    the columns stay as they are."""
    ship(docs.sparkSession)
    columns = docs.columns
    at = columns.index(text)
    count = columns.index(n_chars) if n_chars in columns else None

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            new = [redact(t, s) if t and (s := scan(t)[1]) else t for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if count is not None:
                old = b.column(count).to_pylist()
                kept = [o if n is t else len(n) for o, n, t in zip(old, new, texts)]
                cols[count] = pa.array(kept, b.column(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
