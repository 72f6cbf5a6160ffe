"""Secret scans with a recursive decoding worklist.

Every text is a first layer. Encoded stretches of a layer (``%XX`` and
``%uXXXX``, ``\\uXXXX``, ``\\u{X}``, ``\\UXXXXXXXX`` and ``\\xXX`` escapes, base64, and gzip, zlib, bzip2, xz, Zstandard or
raw deflate data inside decoded layers) are decoded into new layers, which are
scanned and searched for encoded stretches in turn until no layer gives a new
one, at any depth. A layer whose content was seen before in the same text at the
same place is not taken up again, which ends cycles. Each layer keeps where its
characters come from, so a hit in any depth is reported as a span of the
original text.

Spans of the text itself have the kinds ``assign``, ``access`` and ``hex``;
those of decoded layers have the path of decodings before the kind, as in
``base64>gzip>assign``. Offsets are code points, ends are exclusive.

Runs of the base64 alphabet may be glued to path segments or words and wrapped
over lines, so each is joined over its line breaks and decoded at all four
offsets. Compressed data may begin at any byte of a decoded layer and be
followed by more; raw deflate data, which has no mark of its own, must fill a
base64 run. Cut or damaged data give what they hold before the cut or the damage, as
far as their codec gives it out, a wrong checksum costs nothing. Decoded bytes are taken
as Latin-1, a character each: the rules are ASCII, so bytes that are no UTF-8
hide nothing, and each character maps to its place. An escape sign that is
itself escaped four times or more is peeled in one step.

Edge cases: a null text is empty; an empty one has no spans. All layers of a
text together may have ``most`` characters and ``PER_CHARACTER`` for each of the
text's own; what would go beyond is not decoded but reported as a span of kind
``...>oversize``. Where base64 runs on into a word without padding, a span can
end with the characters of that word. Not decoded are UTF-16 in base64, and base64
wrapped by a backslash and a letter.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")

#: Rough tests on whole columns, in linear time: a text without a match has no span and no layer.
MAYBE_SECRET = r"(?i:password|passwd|secret|token|apikey|api_key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
#: A run of base64 has 15 characters at least: 11 bytes of zlib data can inflate to 32 hex digits, the plain secrets have 14 bytes or more.
MAYBE_CODED = r"%u?[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|(?:[A-Za-z0-9+/_-](?:[ \t]*[\r\n][ \t\r\n]*)?){15}"
WORTH = re.compile(f"{MAYBE_SECRET}|{MAYBE_CODED}")

#: An escape sign that is escaped four times or more, by either kind of escapes, is peeled in one step.
PERCENT_ONE = re.compile(r"%(?:(?:25|5[cC](?:u005[cC]|x5[cC])*(?:u0025|x25)){4,})?(?:u([0-9A-Fa-f]{4})|([0-9A-Fa-f]{2}))")
PERCENT = re.compile(f"(?:{PERCENT_ONE.pattern})+")
ESCAPE = re.compile(r"\\(?:(?:u005[cC]|x5[cC]|(?:u0025|x25)(?:25)*5[cC]){4,})?(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|u\{0*([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8}))")
ESCAPES = re.compile(f"(?:{ESCAPE.pattern})+")
SURROGATES = re.compile("[\ud800-\udfff]")
LEAST = 15
BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=(?:[A-Za-z0-9+/_-](?:[ \t]*+[\r\n][ \t\r\n]*+)?){15})"
    r"[A-Za-z0-9+/_-]++(?:[ \t]*+[\r\n][ \t\r\n]*+[A-Za-z0-9+/_-]++)*+={0,2}"
)
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")
#: The second bytes of zlib data by their first: the two are a multiple of 31.
_ZLIB = b"|".join(
    b"(?<=" + re.escape(bytes([a])) + b")(?=[" + b"".join(re.escape(bytes([b])) for b in range(256) if (a << 8 | b) % 31 == 0) + b"])"
    for a in range(0x08, 0x80, 0x10)
)
#: Where compressed data can begin: gzip, bzip2, xz, Zstandard, zlib.
HEADS = re.compile(
    rb"[\x08\x18\x1f\x28\x38\x48\x58\x68\x78B\xfd](?:(?<=\x1f)(?=(\x8b))|(?<=B)(?=(Zh[1-9]1AY&SY))|(?<=\xfd)(?=(7zXZ\x00))|(?<=\x28)(?=(\xb5\x2f\xfd))|"
    + _ZLIB
    + b")"
)

CODECS = {1: "gzip", 2: "bzip2", 3: "xz", 4: "zstd", None: "zlib"}

#: Damaged data that gave less hold no secret: the shortest has 14 characters.
LEAST_LEFT = 14

#: Characters that all layers of a text may have together, and how many more for each character of the text.
MOST, PER_CHARACTER = 32_000_000, 64


class Budget:
    """How much may still be decoded for one text."""

    def __init__(self, most: int):
        self.left = most

    def spend(self, n: int) -> None:
        if n > self.left:
            self.left //= 2  # the next stretches get a share of what is left
            raise OverflowError
        self.left -= n


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain rules, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


class Layer:
    """Decoded text with the pieces it is made of.

    A piece (at, start, end, width) begins at ``at`` and comes from start..end
    of the parent; width 0: the whole piece maps to the whole stretch, else each
    of its characters maps to ``width`` parent characters.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]], parent: Layer | None, path: tuple[str, ...]):
        self.text, self.pieces, self.parent, self.path = text, pieces, parent, path
        self.at = [p[0] for p in pieces]

    def _from(self, i: int, end: bool) -> int:
        at, start, stop, width = self.pieces[bisect.bisect_right(self.at, i) - 1]
        if not width:
            return stop if end else start
        return min(stop, start + (i - at + end) * width)

    def to_text(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that start..end of this layer comes from."""
        layer = self
        while layer.parent is not None:
            start, end = layer._from(start, False), layer._from(end - 1, True)
            layer = layer.parent
        return start, end


class Run(Layer):
    """The bytes of a base64 run from its character ``offset`` on; ``lines`` are the (start, end) of its parts in the parent."""

    def __init__(self, text: str, lines: list[tuple[int, int]], offset: int, parent: Layer, path: tuple[str, ...]):
        super().__init__(text, [], parent, path)
        self.offset, self.lines, n = offset, lines, 0
        for start, end in lines:
            self.at.append(n)
            n += end - start

    def place(self, k: int) -> int:
        """Where the run's k-th character is in the parent."""
        line = bisect.bisect_right(self.at, k) - 1
        return self.lines[line][0] + k - self.at[line]

    def _from(self, i: int, end: bool) -> int:
        k = self.offset + i // 3 * 4 + i % 3  # three bytes come from four characters
        return self.place(k + 1) + 1 if end else self.place(k)


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with every stretch of ``pattern`` decoded in place."""
    text, parts, pieces, last, at = layer.text, [], [], 0, 0
    for m in pattern.finditer(text):
        if (got := decode(m)) is None:
            continue
        if m.start() > last:
            parts.append(text[last : m.start()])
            pieces.append((at, last, m.start(), 1))
            at += m.start() - last
        new, spots = got
        parts.append(new)
        pieces += [(at + i, s, e, 0) for i, s, e in spots]
        at, last = at + len(new), m.end()
    if not parts or (last == 0):
        return None
    if last < len(text):
        parts.append(text[last:])
        pieces.append((at, last, len(text), 1))
    return Layer("".join(parts), pieces, layer, (*layer.path, name))


def _percent(m: re.Match):
    found = list(PERCENT_ONE.finditer(m[0]))
    text = "".join([chr(int(x[1] or x[2], 16)) for x in found])
    text = SURROGATES.sub("�", text)
    return text, [(i, m.start() + x.start(), m.start() + x.end()) for i, x in enumerate(found)]


def _escapes(m: re.Match):
    units, spots = [], []
    for x in ESCAPE.finditer(m[0]):
        units.append(min(int(x[1] or x[2] or x[3] or x[4], 16), 0x10FFFF))
        spots.append((m.start() + x.start(), m.start() + x.end()))
    text, where, i = [], [], 0
    while i < len(units):
        u, n = units[i], 1
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            u, n = 0x10000 + ((u - 0xD800) << 10) + (units[i + 1] - 0xDC00), 2
        text.append(chr(u) if not 0xD800 <= u < 0xE000 else "�")
        where.append((len(where), spots[i][0], spots[i + n - 1][1]))
        i += n
    return "".join(text), where


def _decompressor(codec: str):
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    new = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "deflate": lambda: zlib.decompressobj(-15), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
    return new[codec]()


def _before_damage(codec: str, raw: bytes, begin: int, last: int, end: int, budget: Budget) -> bytes:
    """What zlib gives out of ``raw[last:end]``, the part it failed in, before it fails."""
    d, out = _decompressor(codec), []
    d.decompress(raw[begin:last])
    try:
        for at in range(last, end):
            if data := d.decompress(raw[at : at + 1]):
                budget.spend(len(data))
                out.append(data)
    except zlib.error:
        pass
    return b"".join(out)


def _inflate(codec: str, raw: bytes, at: int, budget: Budget) -> tuple[bytes, int, bool] | None:
    """Data that begin at ``at``, unpacked, where they end, and whether they are whole; None if there are none. OverflowError beyond the budget.

    Data are fed in small parts, so that a false start costs little. Data that
    are cut or damaged, or whose checksum is wrong, give what they hold before.
    """
    zstd, begin = codec == "zstd", at
    d, out, size, last = _decompressor(codec), [], 64, at
    try:
        while at < len(raw) and not d.eof:
            last, part = at, raw[at : at + size]
            at, size = at + len(part), min(2 * size, 256 if zstd else 1 << 16)
            budget.spend(len(part))
            data = d.decompress(part) if zstd else d.decompress(part, budget.left + 1)
            if not data:
                continue
            budget.spend(len(data))
            out.append(data)
    except zlib.error as e:
        # a wrong checksum comes after good data; other damage may be a false start, which the first parts tell
        if "header" not in str(e) and (out or " check" in str(e)):
            out.append(_before_damage(codec, raw, begin, last, at, budget))
        kept = b"".join(out)
        return (kept, at, False) if len(kept) >= LEAST_LEFT else None
    except (lzma.LZMAError, OSError, EOFError, ValueError):
        kept = b"".join(out)
        return (kept, at, False) if len(kept) >= LEAST_LEFT else None
    except Exception as e:  # zstandard's own error class has no other base
        if not zstd or isinstance(e, OverflowError):
            raise
        kept = b"".join(out)
        return (kept, at, False) if len(kept) >= LEAST_LEFT else None
    return (b"".join(out), at - len(d.unused_data), d.eof) if out else None


def _streams(raw: bytes, budget: Budget, whole: bool) -> Iterator[tuple[str, bytes | None, int, int]]:
    """(codec, unpacked bytes, start, end) of compressed data in ``raw``; None for what is beyond the budget.

    ``whole``: raw deflate data that fill ``raw`` are tried too.
    """
    done = 0
    for head in HEADS.finditer(raw):
        at, codec = head.start(), CODECS[head.lastindex]
        if at < done:
            continue
        try:
            if (got := _inflate(codec, raw, at, budget)) is None:
                continue
        except OverflowError:
            yield codec, None, at, len(raw)
            return
        data, end, complete = got
        if complete:
            done = end  # else it may be a false start, and others follow within it
        yield codec, data, at, end
    if whole and not done and raw:
        try:
            got = _inflate("deflate", raw, 0, budget)
        except OverflowError:
            yield "deflate", None, 0, len(raw)
            return
        if got and got[1] == len(raw):
            yield "deflate", got[0], 0, len(raw)


Found = Layer | tuple[int, int, str]


def _over(layer: Layer, start: int, end: int, path: tuple[str, ...]) -> tuple[int, int, str]:
    return (*layer.to_text(start, end), ">".join((*path, "oversize")))


def _base64_layers(layer: Layer, budget: Budget, known: set) -> Iterator[Found]:
    """Layers for each stretch of base64, from each offset, and for the compressed data in it; a span where they would be too large."""
    for m in BASE64.finditer(layer.text):
        lines = [x.span() for x in LINE.finditer(layer.text, m.start(), m.end())]
        run = "".join(layer.text[a:b] for a, b in lines).translate(URL_SAFE)
        mark = (_digest(run), *layer.to_text(m.start(), m.end()))
        if mark in known:
            continue  # an escaped form of this layer holds it too
        known.add(mark)
        for offset in range(4):
            part = run[offset : len(run) - ((len(run) - offset) % 4 == 1)]
            if len(part) < LEAST:
                break
            try:
                budget.spend(len(part))
            except OverflowError:
                yield _over(layer, m.start(), m.end(), (*layer.path, "base64"))
                break
            raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            decoded = Run(raw.decode("latin-1"), lines, offset, layer, (*layer.path, "base64"))
            for codec, data, at, end in _streams(raw, budget, True):
                start, stop = decoded._from(at, False), m.end() if end == len(raw) else decoded._from(end - 1, True)
                if data is None:
                    yield _over(layer, start, stop, decoded.path)
                else:
                    yield Layer(data.decode("latin-1"), [(0, start, stop, 0)], layer, (*decoded.path, codec))
            yield decoded


def _plain_layers(layer: Layer, budget: Budget) -> Iterator[Found]:
    """Layers for the escapes of a layer, and for the compressed data in a decoded one."""
    for sign, pattern, decode, name in (("%", PERCENT, _percent, "url"), ("\\", ESCAPES, _escapes, "unicode")):
        if sign in layer.text:
            try:
                budget.spend(len(layer.text))
            except OverflowError:
                yield _over(layer, 0, len(layer.text), (*layer.path, name))
                continue
            if (got := _replaced(layer, pattern, decode, name)) is not None:
                yield got
    if layer.parent is not None and not isinstance(layer, Run):
        for codec, data, at, end in _streams(layer.text.encode("latin-1", "replace"), budget, False):
            if data is None:
                yield _over(layer, at, end, layer.path)
            else:
                yield Layer(data.decode("latin-1"), [(0, at, end, 0)], layer, (*layer.path, codec))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _worth(layer: Layer) -> bool:
    """Whether a decoded layer can hold a secret or another layer."""
    return bool(WORTH.search(layer.text)) or (not isinstance(layer, Run) and bool(HEADS.search(layer.text.encode("latin-1", "replace"))))


def scan(text: str, most: int = MOST) -> tuple[list, list]:
    """Spans of the plain rules, and those that decoding adds."""
    base = base_spans(text)
    first = Layer(text, [(0, 0, len(text), 1)], None, ())
    work, seen, known, added = [first], {(_digest(text), 0, len(text))}, set(), {}
    budget = Budget(most + PER_CHARACTER * len(text))
    while work:
        layer = work.pop()
        for x in (*_plain_layers(layer, budget), *_base64_layers(layer, budget, known)):
            if isinstance(x, tuple):
                added.setdefault((x[0], x[1], x[2].rpartition(">")[2]), x[2])
                continue
            if not _worth(x):
                continue
            mark = (_digest(x.text), *x.to_text(0, len(x.text)))
            if mark in seen:
                continue
            seen.add(mark)
            work.append(x)
            for start, end, kind in base_spans(x.text):
                s, e = x.to_text(start, end)
                added.setdefault((s, e, kind), ">".join((*x.path, kind)))
    have = {(s, e, k) for s, e, k in base}
    more = sorted((s, e, path) for (s, e, k), path in added.items() if (s, e, k) not in have)
    return base, more


def merged(base: list, more: list) -> list:
    """All spans by start, then kind as listed, the plain ones first."""
    rank = lambda k: (KINDS.index(k.rpartition(">")[2]) if k.rpartition(">")[2] in KINDS else len(KINDS), ">" in k, k)
    return sorted([*base, *more], key=lambda x: (x[0], rank(x[2]), x[1]))


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _maybe(column):
    """Which texts can hold a secret or an encoded stretch at all."""
    import pyarrow.compute as pc

    return pc.or_(pc.match_substring_regex(column, MAYBE_SECRET), pc.match_substring_regex(column, MAYBE_CODED))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``key, base, spans`` for every row: the plain spans, and all spans."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_spans = lambda found: [{"kind": k, "start": s, "end": e} for s, e, k in found]
        for batch in batches:
            column, base, spans = batch.column("text"), [], []
            for t, go in zip(column, _maybe(column).to_pylist(), strict=True):
                plain, more = scan(t.as_py(), most) if go else ([], [])
                base.append(as_spans(plain))
                spans.append(as_spans(merged(plain, more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(base, spans_type), pa.array(spans, spans_type)], ["key", "base", "spans"]
            )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(
        rows, f"key {kind}, base {SPAN}, spans {SPAN}"
    )
    return found.withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", most: int = MOST) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; a null text stays null.

    Spans that overlap become one mask.
    """

    def hidden(t: str) -> str:
        at, parts = 0, []
        for s, e, _ in sorted(merged(*scan(t, most))):
            if s >= at:
                parts += [t[at:s], mask]
            at = max(at, e)
        return "".join(parts) + t[at:] if parts else t

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index(text)
            column = batch.column(i)
            out = [hidden(t.as_py()) if go else t.as_py() for t, go in zip(column, _maybe(column).to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, column.type))

    return docs.mapInArrow(rows, docs.schema)
