import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from marketframe.llm import secret_scan as ss

SECRET = "password = hunter2hunter2"


def brute(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


PIECES = ["password", "Token", "api_key", "apikey", ":", " = ", '"', "'", "AKIA", "ABCDEF12345678", "0123456789abcdef", "ü", " ", "\n", "secret", "x", "hunter2.x", "ſecret=abcdefghi"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base(text):
    assert ss.base_spans(text) == brute(text)
    assert ss.scan(text)[0] == brute(text)


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def only(text, start, end):
    """The added spans lie within start..end of the text."""
    base, more = ss.scan(text)
    assert more and all(start <= s < e <= end for s, e, _ in more), more
    return more


def test_layers():
    inner = SECRET + " and more words here"
    for coded, path in (
        (b64(inner), "base64>assign"),
        (b64(gzip.compress(inner.encode())), "base64>gzip>assign"),
        (b64(zlib.compress(inner.encode())), "base64>zlib>assign"),
        (b64(b64(inner)), "base64>base64>assign"),
        ("".join(f"\\u{ord(c):04x}" for c in inner), "unicode>assign"),
        (urllib.parse.quote(b64(inner), safe=""), None),
        (b64(urllib.parse.quote("püss password=hunter2hunter2")), None),
        (b64(b64(gzip.compress(b64(inner).encode()))), "base64>base64>gzip>base64>assign"),
    ):
        text = f"Été before {coded} after"
        more = only(text, 11, 11 + len(coded))
        assert path is None or path in {k for _, _, k in more}


def test_spans_map_back():
    text = "x %70assword%20=%20hunter2hunter2 y"
    assert ss.scan(text)[1] == [(2, len(text) - 2, "url>assign")]
    padding = "some words come first, then "
    coded = b64(padding + SECRET)
    (s, e, _), = ss.scan(f"é{coded}")[1]
    raw = base64.b64decode(coded)
    at = raw.index(b"password")
    assert 1 + at // 3 * 4 <= s <= 1 + at // 3 * 4 + 3 and e <= 1 + len(coded)


def test_cycles_and_fixpoint_end():
    deep = SECRET
    for _ in range(12):
        deep = b64(deep)
    assert any(k.endswith("assign") for _, _, k in ss.scan(deep)[1])
    for text in ("%25" * 50, "%2525252541", "\\u005cu0041" * 20, "%", "\\u12", "=" * 99, "A" * 5000, b64(b"\xff" * 100)):
        ss.scan(text)


def test_bomb_is_reported():
    bomb = b64(gzip.compress(b"a" * 1_000_000))
    assert ss.scan(f"- {bomb}", most=1000)[1] == [(2, 2 + len(bomb), "base64>oversize")]


def test_prefilter_loses_nothing():
    import pyarrow as pa

    rng = random.Random(0)
    texts = ["".join(rng.choice(PIECES) for _ in range(12)) for _ in range(500)]
    maybe = ss._maybe(pa.array(texts)).to_pylist()
    assert all(go for t, go in zip(texts, maybe, strict=True) if any(ss.scan(t)))


def test_table(docs, corpus, spark, empty):
    got = {r.doc_id: r for r in ss.scan_secrets(docs).collect()}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        assert [(s.start, s.end, s.kind) for s in got[i].base] == brute(text or "")
    assert ss.scan_secrets(empty).count() == 0
    df = spark.createDataFrame([(1, f"a {SECRET} b {b64(SECRET)} c", None), (None, None, 5), (1, "clean", None)], "doc_id bigint, text string, n bigint")
    out = ss.redact(df)
    assert out.schema == df.schema
    assert [r.text for r in out.collect()] == ["a [SECRET] b [SECRET]== c", None, "clean"]


def hidden(text):
    """The parts of the text that decoding adds."""
    return [text[s:e] for s, e, _ in ss.scan(text)[1]]


def goes(text):
    import pyarrow as pa

    return ss._maybe(pa.array([text]))[0].as_py()


def test_shortest_secrets():
    assert ss.scan("dG9rZW49YWJjZGVmZ2g=")[1] == [(0, 19, "base64>assign")]
    for secret in ("token=abcdefgh", "token:abcdefgh", "AKIAABCDEFGHIJKL"):
        for coded in (b64(secret), b64(secret).rstrip("="), b64(zlib.compress(secret.encode()))):
            assert goes(f"x {coded} y") and hidden(f"x {coded} y")[0].rstrip("=") == coded.rstrip("=")
    least = b64(zlib.compress(b"a" * 32, 9))
    assert len(least.rstrip("=")) == ss.LEAST and goes(least) and hidden(least) == [least]


def test_glued_base64():
    url_safe = base64.urlsafe_b64encode(b"~~~???" + SECRET.encode()).decode()
    for data, path in ((b64(SECRET), "base64>assign"), (url_safe, "base64>assign"), (b64(gzip.compress(SECRET.encode())), "base64>gzip>assign"), (b64(b64(SECRET)), "base64>base64>assign")):
        for before in ("v1/", "key_", "a-", "ab", "abc", "api/v2/x_y-", "Z"):
            for after in ("", "/more", "_x", "-tail/of/path"):
                text = f"see {before}{data.rstrip('=')}{after} end"
                assert goes(text)
                s, e, kind = next(x for x in ss.scan(text)[1] if x[2] == path)
                assert 4 + len(before) <= s <= 4 + len(before) + 8 and e >= 4 + len(before + data.rstrip("=")) - 4  # inner padding isn't part of a span


def test_wrapped_base64():
    words = "some words come first and then some more words and "
    for data in (gzip.compress((words * 9 + SECRET).encode()), zlib.compress((words * 9 + SECRET).encode()), (words + SECRET).encode(), SECRET.encode()):
        whole = b64(data)
        for width in (5, 16, 30, 76):
            for end in ("\n", "\r\n", "\n    ", " \n\n\t"):
                text = "head: " + end.join(whole[i : i + width] for i in range(0, len(whole), width)) + " tail"
                assert goes(text)
                (s, e, kind), = ss.scan(text)[1]
                assert kind.endswith("assign") and 6 <= s < e <= len(text) - 5
    coded = b64(SECRET)
    assert ss.scan(f"{coded[:20]}\n{coded[20:]}")[1] == [(0, 35, "base64>assign")]


def test_bytes_that_are_no_utf8():
    assert ss.scan("x %FF%70assword%3Dhunter2hunter2 y")[1] == [(5, 32, "url>assign")]
    text = "".join(f"%{b:02X}" for b in b"\xfc " + SECRET.encode() + b"\xe9")
    assert ss.scan(text)[1] == [(6, 6 + 3 * len(SECRET), "url>assign")]
    coded = b64(b"\xff\x00\x01" + SECRET.encode())
    assert hidden(coded) == [coded[4:].rstrip("=")]
    coded = b64(gzip.compress(b"\xff\x00\x01" + SECRET.encode()))
    assert hidden(coded) == [coded]


def test_stream_of_a_stream_too_large():
    bomb = b64(gzip.compress(gzip.compress(b"a" * 1_000_000)))
    assert ss.scan(bomb, most=5000)[1] == [(0, len(bomb), "base64>gzip>oversize")]
    assert hidden("v1/" + b64(gzip.compress(SECRET.encode())))[0] == b64(gzip.compress(SECRET.encode()))


def deflated(data):
    d = zlib.compressobj(wbits=-15)
    return d.compress(data) + d.flush()


def zstd(data):
    import zstandard

    return zstandard.compress(data)


def test_every_codec_and_its_members():
    words = b"some words come first, then some more and "
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstd, deflated):
        for before in ("", "x/", "v1-", "ab"):
            text = f"head {before}{b64(pack(words + SECRET.encode()))} tail"
            assert any(k.endswith("assign") for *_, k in ss.scan(text)[1]), (pack, before)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for n in range(4):  # a second member, and data after a stretch of other bytes
            for data in (pack(words[n:]) + pack(SECRET.encode()), b"\xff" * n + pack(SECRET.encode()), pack(words) + b"?" * n + pack(SECRET.encode())):
                assert any(k.endswith("assign") for *_, k in ss.scan(b64(data))[1]), (pack, n)
    cut = gzip.compress(("".join(chr(97 + i * 7 % 26) for i in range(300)) + " " + SECRET + " " + words.decode() * 30).encode())
    assert any(k.endswith("assign") for *_, k in ss.scan(b64(cut[:-9]))[1])
    escaped = "".join(f"%{x:02x}" for x in gzip.compress(SECRET.encode()))
    assert ss.scan(f"a {escaped} b")[1] == [(2, 2 + len(escaped), "url>gzip>assign")]


def test_deep_chains_end_soon():
    data = SECRET.encode()
    for _ in range(100):
        data = gzip.compress(data)
    began = time.time()
    assert ss.scan(b64(data))[1][0][2] == "base64>" + "gzip>" * 100 + "assign"
    for text in ("%" + "25" * 50_000 + "70assword=hunter2hunter2", "\\" + "u005c" * 20_000 + "u0070assword=hunter2hunter2", "%5Cu0025" + "5Cu0025" * 10_000 + "70assword=hunter2hunter2"):
        assert [(s, e) for s, e, k in ss.scan(text)[1] if k.endswith("assign")] == [(0, len(text))]
    ss.scan("%" + "25" * 50_000)
    ss.scan(b64(b"\x1f\x8b\x08\x08" * 100_000))
    assert time.time() - began < 10
    level = lambda t: t.replace("%", "%25")
    text = "%70assword%3Dhunter2hunter2"
    for _ in range(9):
        assert [(s, e) for s, e, k in ss.scan(text)[1] if k.endswith("assign")] == [(0, len(text))]
        text = level(text)


def test_random_chains():
    """Secrets under random layers after random prefixes are found where they are."""
    rng = random.Random(5)
    percent = lambda t: "".join(f"%{b:02X}" if rng.random() < 0.5 or not chr(b).isalnum() else chr(b) for b in t.encode())
    escapes = lambda t: "".join(f"\\u{ord(c):04x}" for c in t)
    packed = [lambda t, f=f: b64(f(t.encode())) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)]
    layers = [percent, escapes, b64, lambda t: base64.urlsafe_b64encode(t.encode()).decode(), *packed]
    for _ in range(150):
        kind = rng.choice(["password=" + "".join(rng.choice("abcXYZ019") for _ in range(12)), "AKIA" + "".join(rng.choice("ABC019") for _ in range(14)), "".join(rng.choice("0123456789abcdef") for _ in range(40))])
        coded = f"some text, {kind}, and so on"
        for _ in range(rng.randrange(1, 6)):
            coded = rng.choice(layers)(coded)
        before = "é" * rng.randrange(3) + " " + rng.choice(["", "x/", "id: ", "k_"])
        text = f"{before}{coded} after"
        assert any(len(before) <= s < e <= len(before) + len(coded) and not k.endswith("oversize") for s, e, k in ss.scan(text)[1]), (kind, text[:80])


def test_nothing_is_lost_silently():
    """Beyond the budget, cut, damaged or with a wrong checksum: a span, or what was held."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ghijklmnopq") for _ in range(6))
    plain = " ".join([*(word() for _ in range(300)), SECRET, *(word() for _ in range(900))])
    bomb = ("z" * 3_000_000 + SECRET).encode()
    for pack, name in ((deflated, "deflate"), (gzip.compress, "gzip"), (zlib.compress, "zlib")):
        assert [k for *_, k in ss.scan(b64(pack(bomb)), most=100_000)[1]] == ["base64>oversize"]
        assert [k for *_, k in ss.scan(b64(pack(bomb)))[1]] == [f"base64>{name}>assign"]
        packed = pack(plain.encode())
        half = packed[: len(packed) * 3 // 4]
        assert f"base64>{name}>assign" in [k for *_, k in ss.scan(b64(half))[1]], name
    for pack, name, tail in ((gzip.compress, "gzip", 8), (zlib.compress, "zlib", 4)):
        packed = bytearray(pack(SECRET.encode()))
        packed[-tail] ^= 255
        assert [k for *_, k in ss.scan(b64(bytes(packed)))[1]] == [f"base64>{name}>assign"]
        packed = bytearray(pack(plain.encode()))
        packed[-len(packed) // 4] ^= 255
        assert f"base64>{name}>assign" in [k for *_, k in ss.scan(b64(bytes(packed)))[1]], name


def test_more_escapes():
    for coded in ("".join(f"\\u{{{ord(c):x}}}" for c in SECRET), "".join(f"\\U{ord(c):08x}" for c in SECRET), "".join(f"%u{ord(c):04x}" for c in SECRET), "%u0070assword=hunter2hunter2", "\\u{70}assword=hunter2hunter2 \\u{110000}\\UFFFFFFFF%uD800"):
        assert re.search(ss.MAYBE_CODED, coded)
        assert [k.rpartition(">")[2] for *_, k in only(coded, 0, len(coded))] == ["assign"]
    assert only("x %u0070assword=hunter2hunter2", 2, 30)[0][:2] == (2, 30)
