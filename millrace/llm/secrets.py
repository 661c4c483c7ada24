"""Secret scans (operator 3): a worklist of decoded layers.

Each text is scanned as it is; then every URL escape, Unicode escape, base64 run and compressed stream in it is
unwrapped into a further layer, which is scanned and unwrapped in turn, until nothing new appears. A layer that has
been seen over the same region is not taken again, so cycles end. Each character of a layer knows the region of the
original text that it came from, and findings are reported there. Base64 may be wrapped over lines. Bytes that are no
UTF-8 part what stands before them from what follows, and all members of a compressed stream are read.

A base64 run is decoded at each of the four places where its first sign may stand, once each, so that signs joined
before it hide nothing; what can be read of it, and each compressed stream in it, is a layer. Streams are read and
scanned in pieces that overlap, whatever they expand to.

Defined results: a null text is the empty text; one row out for each row in, repeats included; ties of a span in
several layers are reported once. `incomplete` says that a stream expands beyond one piece and holds, over the border
of two pieces, a coded run longer than their overlap: its layers are read from each piece by itself.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table

KINDS = ("assign", "access", "hex")
#: Bytes of an expanded stream that are scanned at once, and those that the next piece begins with again.
PIECE = 8 << 20
OVERLAP = 1 << 20

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Base64 of 14 bytes, the shortest that a finding or a further layer can be, has 19 signs.
LEAST = 19
_SIGNS = "[A-Za-z0-9+/_-]"
#: Line breaks within a run, also escaped ones, and indentation.
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
#: Each start is tried once, since no run begins behind another sign and none gives back what it has taken.
_BASE64 = re.compile(rf"(?<!{_SIGNS}){_SIGNS}{{4,}}+(?:(?:{_BREAK.pattern}){_SIGNS}++)*+={{0,2}}")
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
_WIDE = re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){14,}|(?:[\t\n\r\x20-\x7e]\x00){14,}")
#: How compressed streams begin (fixed values): gzip, zlib, bzip2, xz, zstd.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base spans of one layer, in its own offsets."""
    found = []
    low = text.lower()
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text; region() gives the place in the original of a stretch of it."""

    __slots__ = ("chain", "region", "text")

    def __init__(self, text, region=None, chain=()):
        self.text, self.region, self.chain = text, region or (lambda a, b: (a, b)), chain


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with every match that decodes replaced; decode gives (characters, [their start and end in the match])."""
    out, starts, ends, at, changed = [], array("i"), array("i"), 0, False

    def copy(a, b):
        out.append(layer.text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))

    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        copy(at, m.start())
        changed, at = True, m.end()
        for c, a, b in got:
            out.append(c)
            starts.append(m.start() + a)
            ends.append(m.start() + b)
    if not changed:
        return None
    copy(at, len(layer.text))
    return Layer("".join(out), lambda a, b: layer.region(starts[a], ends[b - 1]), (*layer.chain, name))


def _url(m: re.Match):
    got, at = [], 0
    for c in _chars(bytes.fromhex(m[0].replace("%", ""))):
        n = _width(c)
        got.append((_latin(c), 3 * at, 3 * (at + n)))
        at += n
    return got


def _chars(raw: bytes) -> str:
    """The text of raw, with a surrogate for each byte that is not UTF-8."""
    return raw.decode("utf-8", "surrogateescape")


def _width(c: str) -> int:
    return 1 if "\udc80" <= c <= "\udcff" else len(c.encode())


def _latin(text: str) -> str:
    """The text with each such surrogate as its Latin-1 sign."""
    return re.sub("[\udc80-\udcff]", lambda m: chr(ord(m[0]) - 0xDC00), text)


def _unicode(m: re.Match):
    hexes = next((g for g in m.groups()[:5] if g), None)
    n = int(hexes, 16) if hexes else int(m[6])
    if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000:
        return None
    return [(chr(n), 0, m.end() - m.start())]


_PAIR = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})")


def _pair(m: re.Match):
    return [(chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), 0, 12)]


def _opened(raw: bytes):
    """A decompressor for the stream that raw begins with, if it is compressed."""
    if raw[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def _members(parts, piece: int, used: list[int]):
    """The bytes of the stream that the parts begin with, and of all that follow it, in parts of at most `piece` or so; used[0]: how much they took."""
    import zstandard

    parts, held, at, before = iter(parts), b"", 0, 0  # at: what is read of held; before: bytes ahead of it

    def have(n):
        nonlocal held, at, before
        while len(held) - at < n and (x := next(parts, None)) is not None:
            held, before, at = held[at:] + x, before + at, 0
        return len(held) > at

    while have(16) and (d := _opened(held[at : at + 16])) is not None:
        limited = "Zstd" not in type(d).__name__
        step = 1 << 16 if limited else 1 << 10  # what it expands to has no other bound
        ended = False
        try:
            while not ended:
                if limited and getattr(d, "unconsumed_tail", b""):
                    data = d.unconsumed_tail
                elif limited and not getattr(d, "needs_input", True):
                    data = b""
                elif have(1):
                    data = held[at : at + step]
                    at += len(data)
                else:
                    break  # cut off: what it holds counts still
                got = d.decompress(data, piece) if limited else d.decompress(data)
                if got:
                    yield got
                ended = d.eof
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError):
            break
        if not ended:
            break
        at -= len(d.unused_data)
        used[0] = before + at
        # Members may be padded with zeros.
        while have(1) and held[at] == 0:
            at += 1


def _pieces(parts, piece: int, overlap: int):
    """The parts joined to pieces, each with the end of the one before it; whether it is the last."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= piece:
            whole = b"".join(held)
            yield whole, False
            held, n = [whole[-overlap:]], min(n, overlap)
    if n:
        yield b"".join(held), True


def _texts(raw: bytes):
    """(text, where it begins, bytes of each sign) of each stretch of raw in which something may be found: ASCII, or such signs in UTF-16."""
    for m in _PLAIN.finditer(raw):
        yield m[0].decode(), m.start(), 1
    for m in _WIDE.finditer(raw):
        yield m[0].replace(b"\x00", b"").decode(), m.start(), 2


def _streams(raw: bytes):
    """Where compressed streams may begin in raw, in order."""
    return (m.start() for m in _MAGIC.finditer(raw))


class _Work:
    """The layers still to be scanned."""

    def __init__(self, text: str, piece: int, overlap: int):
        self.todo, self.flags, self.piece, self.overlap = [Layer(text)], set(), piece, overlap

    def unpack(self, raw: bytes, region, chain) -> int:
        """Adds a layer for what can be read in the stream that raw begins with, and in those inside it; how much of raw it took, 0 if it is none."""
        used, got = [0], False
        chain, within, parts = (*chain, "compressed"), set(), _members([raw], self.piece, used)
        while (first := next(parts, None)) is not None:
            got = True
            parts = itertools.chain([first], parts)
            # A stream in the stream is read as it comes; one that holds itself ends where that shows.
            if (key := hashlib.sha1(first).digest()) in within or next(_members([first], self.piece, [0]), None) is None:
                break
            within.add(key)
            chain, parts = (*chain, "compressed"), _members(parts, self.piece, [0])
        return (used[0] or len(raw)) if self.read(parts, region, chain) or got else 0

    def read(self, parts, region, chain) -> bool:
        """Adds the texts of a stream, each for the whole run."""
        got = False
        for data, last in _pieces(parts, self.piece, self.overlap):
            got = True
            for text, _, _ in _texts(data):
                self.todo.append(Layer(text, region, chain))
                if not last and len(text) > self.overlap and (m := re.search(rf"{_SIGNS}+\Z", text[-self.overlap - 1 :])) and len(m[0]) > self.overlap:
                    self.flags.add("incomplete")
        return got

    def packed(self, layer: Layer) -> None:
        """Adds a layer for each stretch of text, and each compressed stream, in the base64 runs of a layer."""
        for m in _BASE64.finditer(layer.text):
            if m.end() - m.start() < LEAST:
                continue
            run, places = m[0], None
            if "\n" in run or "\\" in run:
                run, places, at = [], array("i"), m.start()
                for x in [*_BREAK.finditer(layer.text, m.start(), m.end()), None]:
                    end = x.start() if x else m.end()
                    run.append(layer.text[at:end])
                    places.extend(range(at, end))
                    at = x.end() if x else end
                run = "".join(run)
                if len(run) < LEAST:
                    continue
            self.decoded(layer, run.rstrip("=").translate(_STANDARD), len(run), places, m.start())

    def decoded(self, layer: Layer, run: str, padded: int, places, start: int) -> None:
        chain = (*layer.chain, "base64")

        def place(i):
            return start + i if places is None else places[i]

        for shift in range(4):
            n = len(run) - shift
            n -= n % 4 == 1  # a sign more is not of the run
            if n < 8:
                continue
            raw = binascii.a2b_base64(run[shift : shift + n] + "=" * (-n % 4))

            def region(a, b, shift=shift):
                """Of the bytes a to b."""
                return layer.region(place(shift + a // 3 * 4), place(min(padded, shift + (b + 2) // 3 * 4) - 1) + 1)

            behind = 0
            for at in _streams(raw):
                if at >= behind and at % 3 == 0:
                    body = raw[at:]
                    # The region is known when the end of the stream is: it is asked for when its layers are scanned.
                    took = [len(body)]
                    used = self.unpack(body, lambda a, b, at=at, took=took, region=region: region(at, at + took[0]), chain)
                    if used:
                        took[0] = used
                        behind = at + used
            for text, at, width in _texts(raw):
                self.todo.append(Layer(text, lambda a, b, at=at, width=width, region=region: region(at + a * width, at + b * width), chain))


_STANDARD = str.maketrans("-_", "+/")


def find(text: str, piece: int = PIECE, overlap: int = OVERLAP) -> tuple[list[tuple[str, int, int]], dict[tuple[str, int, int], str], bool]:
    """Base spans; those of the decoded layers with the layers that they lay under; whether a stream was read in pieces that may hide a layer."""
    base = scan(text)
    added: dict[tuple[str, int, int], str] = {}
    work, seen, known = _Work(text, piece, overlap), set(), set(base)
    while work.todo:
        layer = work.todo.pop()
        t = layer.text
        if layer.chain:
            key = hashlib.sha1(f"{layer.region(0, len(t))}:".encode() + t.encode("utf-8", "surrogatepass")).digest()
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in scan(t):
                span = (kind, *layer.region(a, b))
                if span not in known:
                    known.add(span)
                    added[span] = ">".join(layer.chain)
        if "%" in t and (x := _replaced(layer, _URL, _url, "url")):
            work.todo.append(x)
        if "\\" in t or "&#" in t:
            paired = _replaced(layer, _PAIR, _pair, "unicode") if "\\u" in t else None
            if (x := _replaced(paired or layer, _UNICODE, _unicode, "unicode") or paired):
                work.todo.append(x)
        work.packed(layer)
    return base, added, bool(work.flags)


def _order(span):
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order))


def redacted(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]"] if a >= at else []
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,layers:string>>"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, base array of spans, added array of spans, incomplete boolean[, redacted string]); layers is empty for base spans."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, added, flag, texts = [], [], [], []
                for t in part.column(1).to_pylist():
                    b, a, i = find(t or "")
                    base.append([{"kind": k, "start": x, "end": y, "layers": ""} for k, x, y in sorted(b, key=_order)])
                    added.append([{"kind": s[0], "start": s[1], "end": s[2], "layers": a[s]} for s in sorted(a, key=_order)])
                    flag.append(i)
                    if redact:
                        texts.append(t if t is None else redacted(t, [*b, *a]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, span), pa.array(added, span), pa.array(flag, pa.bool_()), *([pa.array(texts, pa.string())] if redact else [])],
                    ["id", "base", "added", "incomplete", *(["redacted"] if redact else [])],
                )

    modest_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id long, base {SPANS}, added {SPANS}, incomplete boolean" + ", redacted string" * redact).withColumnRenamed("id", id_col)


def redacted_rows(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with every span found replaced by a mark, and the number of characters with it."""
    names = df.columns

    def run(batches):
        import pyarrow as pa

        at = names.index(text_col)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                cols = list(part.columns)
                new, changed = [], {}
                for i, t in enumerate(cols[at].to_pylist()):
                    base, added, _ = find(t) if t else ((), (), False)
                    if base or added:
                        t = redacted(t, [*base, *added])
                        changed[i] = len(t)
                    new.append(t)
                cols[at] = pa.array(new, cols[at].type)
                if changed and chars_col in names:
                    k = names.index(chars_col)
                    cols[k] = pa.array([changed.get(i, n) for i, n in enumerate(cols[k].to_pylist())], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    modest_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def spans_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    place = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["end"], s["kind"].alias("kind"))
    everything = F.transform(F.array_sort(F.transform(F.concat("base", "added"), place)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return got.select("doc_id", *map(count, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(everything).alias("spans"), F.size("added").cast("long").alias("n_added"), "incomplete")
