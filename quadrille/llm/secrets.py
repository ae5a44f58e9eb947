"""Secret scans with a recursive decoding worklist.

A text is scanned as it is, then every encoded stretch in it is unwrapped (URL
escapes, Unicode and character-reference escapes, base64 at each of its four
phases and over line breaks, compressed bytes under base64 or byte escapes) and
the readable stretches of the result (UTF-8 or UTF-16) join a worklist as new
layers, scanned and unwrapped in turn until nothing new appears. Layers already
seen over the same stretch are not taken again, so escapes that decode to each
other end. Every layer carries the stretch of the original text behind each of
its characters; findings are reported in code points of the original.

Compressed bytes are read as a stream, in pieces of ``PIECE`` bytes that overlap
by ``OVERLAP``, so memory is bounded and nothing is cut off; only a secret or a
nested run longer than the overlap within a layer longer than a piece can
escape. Such layers are counted in ``oversized``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
# Fixed patterns. ASCII flag: only A-Z has cases here.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24+; shorter runs fail anyway
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# The shortest secret has 12 characters, which are 16 in base64.
LEAST = 12
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")
NO_SPACE = re.compile(r"[^\s\"'<>]+")
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}" % LEAST)
WIDE = ((re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}" % LEAST), "utf-16-le"), (re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){%d,}" % LEAST), "utf-16-be"))
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
PIECE, OVERLAP, MAX_WRAPS = 16 << 20, 4 << 20, 64
OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, oversized long"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings in a text."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and, per character, where in the original it begins and ends (None: in place)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], max(self.ends[start:end]))


def readable(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, bytes a character) of the stretches that read as text; 0 bytes: as UTF-8 has it."""
    for m in READABLE.finditer(raw):
        yield m[0].decode("utf-8", "replace"), m.start(), 0
    if b"\x00" in raw:
        for pattern, name in WIDE:
            for m in pattern.finditer(raw):
                yield m[0].decode(name), m.start(), 2


def _unpacker(raw: bytes | memoryview):
    """What makes a decompressor for the format that ``raw`` begins with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _inflate(chunks: Iterable[bytes], make, left: list[int] | None = None) -> Iterator[bytes]:
    """The bytes of all members that stand one after another, a bounded piece at a time; what cannot be read ends it.

    The number of bytes behind the last member goes into ``left``, if it came to its end.
    """
    chunks, tool, data = iter(chunks), make(), b""
    while True:
        if tool.eof:
            data = tool.unused_data or next(chunks, b"")
            while data and len(data) < 6 and (more := next(chunks, b"")):
                data += more
            make = _unpacker(data)
            if not make:
                if left is not None:
                    left.append(len(data))
                return
            tool = make()
        elif not data and getattr(tool, "needs_input", True):
            data = next(chunks, b"")
            if not data:
                return
        try:
            out = tool.decompress(data, PIECE)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        data = getattr(tool, "unconsumed_tail", b"")
        if out:
            yield out


def expand(raw: bytes | memoryview, left: list[int] | None = None) -> Iterator[bytes]:
    """The bytes inside all compressed wrappings, in overlapping pieces; nothing if there is no wrapping. ``left`` as of the outermost."""
    make, chunks, wraps = _unpacker(raw), iter([raw]), 0
    if not make:
        return
    while make and wraps < MAX_WRAPS:
        wraps += 1
        chunks = _inflate(chunks, make, left if wraps == 1 else None)
        first = next(chunks, b"")
        while first and len(first) < 6 and (more := next(chunks, b"")):
            first += more
        make, chunks = _unpacker(first), itertools.chain([first] if first else [], chunks)
    held = b""
    for chunk in chunks:
        held += chunk
        while len(held) > PIECE:
            yield held[:PIECE]
            held = held[PIECE - OVERLAP :]
    if held:
        yield held


def _from_packed(layer: Layer, start: int, end: int, raw: bytes | memoryview, left: list[int] | None = None) -> tuple[list[Layer], bool]:
    """Layers of compressed bytes that stand behind a stretch of a layer, and whether they came in several pieces."""
    out, pieces = [], 0
    a, b = layer.origin(start, end)
    for piece in expand(raw, left):
        pieces += 1
        out += [Layer(t, array("q", [a]) * len(t), array("q", [b]) * len(t)) for t, _, _ in readable(piece)]
    return out, pieces > 1


def _streams(layer: Layer, at: Callable[[int], int], end: int, raw: bytes) -> tuple[list[Layer], int]:
    """Layers of all compressed streams in the bytes, wherever they begin; ``at`` gives the place of a byte in the layer.

    The search goes on behind a stream that came to its end, and behind the first byte of what did not.
    """
    out, large, behind = [], 0, 0
    while m := PACKED.search(raw, behind):
        behind, left = m.start() + 1, []
        if _unpacker(raw[m.start() : m.start() + 6]):
            inside, big = _from_packed(layer, at(m.start()), end, memoryview(raw)[m.start() :], left)
            out, large = out + inside, large + big
            if left:
                behind = max(behind, len(raw) - left[0])
    return out, large


def _unescaped(layer: Layer, start: int, end: int) -> Layer:
    """The stretch with every escape in it decoded once."""
    text, starts, ends, at = [], array("q"), array("q"), start

    def put(piece: str, a: int, b: int, whole: bool) -> None:
        for i, c in enumerate(piece):
            o = layer.origin(a, b) if whole else layer.origin(a + i, a + i + 1)
            text.append(c)
            starts.append(o[0])
            ends.append(o[1])

    for m in ESCAPE.finditer(layer.text, start, end):
        put(layer.text[at : m.start()], at, m.start(), False)
        if m[1]:
            raw = bytes.fromhex(m[1].replace("%", ""))
            try:
                pos = m.start()
                for c in raw.decode("utf-8"):
                    n = 3 * len(c.encode("utf-8"))
                    put(c, pos, pos + n, True)
                    pos += n
            except UnicodeDecodeError:
                for i, byte in enumerate(raw):
                    put(chr(byte), m.start() + 3 * i, m.start() + 3 * i + 3, True)
        else:
            code = int(m[7]) if m[7] else int(next(g for g in m.groups()[1:6] if g), 16)
            ok = code < 0x110000 and not 0xD800 <= code < 0xE000
            put(chr(code) if ok else m[0], m.start(), m.end(), ok)
        at = m.end()
    put(layer.text[at:end], at, end, False)
    return Layer("".join(text), starts, ends)


def _from_base64(layer: Layer, start: int, end: int) -> tuple[list[Layer], int]:
    """The readable layers in a base64 run, in plain or compressed bytes, at any phase: what stands before may shift it."""
    run = layer.text[start:end].rstrip("=").replace("-", "+").replace("_", "/")
    places = None
    if "\n" in run:  # where each digit stands, as line breaks do not count
        places = [start + i for i, c in enumerate(run) if c not in "\r\n"]
        run = run.replace("\r", "").replace("\n", "")
    at = (lambda i: places[i]) if places else (lambda i: start + i)
    out, large = [], 0
    for phase in range(4):
        digits = run[phase:]
        if len(digits) % 4 == 1:
            digits = digits[:-1]
        try:
            raw = base64.b64decode(digits + "=" * (-len(digits) % 4))
        except (binascii.Error, ValueError):
            continue
        # The bytes of a shifted run begin with some that belong to what stands before.
        inside, big = _streams(layer, lambda i, phase=phase: at(phase + i * 4 // 3), end, raw)
        out, large = out + inside, large + big
        for text, first, width in readable(raw):
            starts, ends, place = array("q"), array("q"), first
            for c in text:
                n = width or len(c.encode("utf-8"))
                last = min(len(run) - 1, phase + -(-(place + n) * 4 // 3) - 1)
                a, b = layer.origin(at(phase + place * 4 // 3), at(last) + 1)
                starts.append(a)
                ends.append(b)
                place += n
            out.append(Layer(text, starts, ends))
    return out, large


def unwrap(layer: Layer) -> tuple[list[Layer], int]:
    """The layers one step inside: lines that hold escapes, compressed bytes under escapes, and base64 runs."""
    out, large, text, at = [], 0, layer.text, 0
    while m := ESCAPE.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        out.append(_unescaped(layer, start, end))
        at = end
    stretches = [(m.start(), m.end(), bytes.fromhex(m[0].replace("\\x", ""))) for m in HEX_BYTES.finditer(text)]
    if "%" in text:
        stretches += [(m.start(), m.end(), unquote_to_bytes(m[0])) for m in NO_SPACE.finditer(text) if "%" in m[0]]
    for start, end, raw in stretches:
        inside, big = _streams(layer, lambda _, start=start: start, end, raw)
        out, large = out + inside, large + big
    for m in BASE64.finditer(text):
        inside, big = _from_base64(layer, m.start(), m.end())
        out, large = out + inside, large + big
    return out, large


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base findings, all findings, layers opened, layers read in pieces), findings sorted by start, then kind."""
    text = text or ""
    base = sorted(scan(text))
    every, seen, work, opened, large = set(base), set(), [Layer(text)], 0, 0
    while work:
        layer = work.pop()
        inner, big = unwrap(layer)
        large += big
        for x in inner:
            if not x.text:
                continue
            mark = (hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), x.starts[0], x.ends[-1])
            if mark in seen or x.text == layer.text:
                continue
            seen.add(mark)
            opened += 1
            for a, kind, b in scan(x.text):
                start, end = x.origin(a, b)
                every.add((start, kind, end))
            work.append(x)
    return base, sorted(every), opened, large


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def findings(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        base, every, opened, large = find_secrets(t)
        kinds = [k for _, k, _ in base]
        rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(base).encode()).hexdigest(), told(every), opened, large))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers, oversized) of every row.

    Null text counts as empty and gives no spans and the digest of nothing;
    repeated rows stay; other columns are not read; no rows give no rows.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(findings, OUT)(F.col(text_col)).alias("s")).select("doc_id", "s.*")
