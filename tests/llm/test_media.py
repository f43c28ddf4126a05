import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from rastrel.llm import media
from tests.conftest import DATA
from tests.llm.cases import empty, odd


def slow_decode(data):
    """Coefficients by component, one bit at a time: a second reader of the format."""
    at, tables, frame, restart = 2, {}, {}, 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                code, k, found = 0, 17, {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        found[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = found
                body = body[k:]
        elif marker == 0xC0:
            high, wide, count = struct.unpack_from(">HHB", body, 1)
            for i in range(count):
                c = body[6 + 3 * i : 9 + 3 * i]
                frame[c[0]] = (c[1] >> 4, c[1] & 15)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            parts = [(*frame[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    h, v = (1, 1) if len(parts) == 1 else (max(p[0] for p in parts), max(p[1] for p in parts))
    mcus = -(-wide // (8 * h)) * -(-high // (8 * v))
    bits, out = iter(()), []

    def reader():
        nonlocal at
        while True:
            byte = data[at]
            at += 1 if byte != 0xFF else 2
            yield from (byte >> k & 1 for k in range(7, -1, -1))

    def take(n):
        x = 0
        for _ in range(n):
            x = 2 * x + next(bits)
        return x

    def symbol(table):
        code = 0
        for n in range(1, 17):
            code = 2 * code + next(bits)
            if (n, code) in table:
                return table[n, code]
        raise ValueError

    def value(n):
        x = take(n)
        return x if not n or x >> n - 1 else x - (1 << n) + 1

    for m in range(mcus):
        if not m or restart and m % restart == 0:
            if m:
                while data[at : at + 1] != b"\xff" or not 0xD0 <= data[at + 1] <= 0xD7:
                    at += 1
                at += 2
            bits, last = reader(), [0] * len(parts)
        for c, (ph, pv, dc, ac) in enumerate(parts):
            for _ in range(1 if len(parts) == 1 else ph * pv):
                block = [0] * 64
                last[c] += value(symbol(tables[dc]))
                block[0], k = last[c], 1
                while k < 64:
                    s = symbol(tables[16 + ac])
                    if not s:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = value(s & 15)
                    k += 1
                out.append(block)
    return out


def coded(blocks, components, width, height, restart):
    """A JPEG of given blocks (component, 64 coefficients, in scan order), with runs, ends of blocks and several components."""
    symbols = [r << 4 | s for r in range(16) for s in range(1, 9)] + [0xF0, 0]
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    code = {s: k for k, s in enumerate(symbols)}
    per = sum(h * v for _, h, v in components) if len(components) > 1 else 1
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\2" * 64)
    head += media._segment(0xC4, b"\0" + bytes([0] * 3 + [9] + [0] * 12) + bytes(range(9)) + b"\x10" + table)
    head += media._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    head += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in components))
    head += media._segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, 0]) for i, _, _ in components) + b"\0\x3f\0")
    scan, bits, last = b"", "", {}

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for b, (c, block) in enumerate(blocks):
        if restart and b and b % (restart * per) == 0:
            scan += flushed(bits) + bytes([0xFF, 0xD0 + (b // (restart * per) - 1) % 8])
            bits, last = "", {}
        n, tail = number(block[0] - last.get(c, 0))
        bits += format(n, "04b") + tail
        last[c] = block[0]
        run = 0
        for x in block[1:]:
            if not x:
                run += 1
                continue
            while run > 15:
                bits += format(code[0xF0], "08b")
                run -= 16
            n, tail = number(x)
            bits += format(code[run << 4 | n], "08b") + tail
            run = 0
        if run:
            bits += format(code[0], "08b")
    return head + scan + flushed(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("layout", [[(1, 1, 1)], [(1, 2, 2), (2, 1, 1), (3, 1, 1)]])
def test_general_scans(layout, restart):
    rng = random.Random(restart)
    wide, high = 75, 41
    h, v = max(c[1] for c in layout), max(c[2] for c in layout)
    mcus = -(-wide // (8 * h)) * -(-high // (8 * v))
    pattern = [0] if len(layout) == 1 else [c for c, (_, ph, pv) in enumerate(layout) for _ in range(ph * pv)]
    blocks = [(c, [rng.randint(-60, 60)] + [rng.choice([0, 0, 0, 0, 0, 1, -1, 77, -100]) if rng.random() < d else 0 for _ in range(63)]) for _ in range(mcus) for c in pattern for d in [rng.choice([0, 0.1, 1])]]
    data = coded(blocks, layout, wide, high, restart)
    picture = media.parse(data)
    (got,) = media.decode_many([picture])
    assert got.tolist() == [b for _, b in blocks] == slow_decode(data)
    thumb = media.thumbnail(picture, got)
    assert thumb.shape == ((-(-high // 8)), -(-wide // 8)) if len(layout) == 1 else thumb.shape == (-(-high // 16) * 2, -(-wide // 16) * 2)
    assert thumb[0, 0] == np.clip(round(blocks[0][1][0] * 2 / 8 + 128), 0, 255)


def test_round_trip_and_second_reader(monkeypatch):
    rng = random.Random(9)
    texts = [b"", b"a", bytes(range(256)) * 2, b"\0" * 64, b"\xff" * 70, rng.randbytes(1000), "über 日本 🙂".encode() * 40, b"x" * 64 * 5]
    for lanes in (1 << 15, 3):
        monkeypatch.setattr(media, "_LANES", lanes)
        files = media.encode_many([media.payload_of(t) for t in texts], [len(t) for t in texts])
        for t, f, fact in zip(texts, files, media.facts(files)):
            payload = t + bytes(-len(t) % 64 or 64 * (not t))
            assert fact[:6] == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest())
            slow = slow_decode(f)[: len(payload) // 64]
            assert bytes(v + 128 - (v > 0) for b in slow for v in b) == payload


def test_damage():
    (good,) = media.encode_many([media.payload_of(b"hello")], [5])
    for bad in (b"", b"\x89PNG", good[:20], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            media.facts([bad])


def test_tables(spark):
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), odd(spark)):
        got = sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in media.stored_and_read(df).collect()), key=str)
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), hashlib.sha256(media.payload_of((r["text"] or "").encode())).hexdigest()) for r in df.collect()), key=str)
        assert got == want
    assert media.stored_and_read(empty(spark)).count() == 0


def test_null_damaged_and_foreign_files_fail_nothing(spark):
    good = media.encode_many([media.payload_of(b"some text"), media.payload_of(b"")], [9, 0])
    foreign = good[0].replace(b"bytes=9", b"made by")
    files = [good[0], None, b"", b"junk", good[0][:200], good[1], b"\xff\xd8" + bytes(50), foreign, good[0][:-20] + b"\xff\xd9"]
    rows = spark.createDataFrame(list(enumerate(files)), "k long, media binary").selectExpr("*", "1 AS __media_", "'x' AS text")
    got = {r["k"]: r for r in media.examined(rows, ["k", "text"]).collect()}
    assert len(got) == len(files) and all(r["text"] == "x" for r in got.values())
    assert (got[0]["n_bytes"], got[5]["n_bytes"]) == (9, 0) and got[0]["feature"] and got[0]["payload_sha256"] == hashlib.sha256(media.payload_of(b"some text")).hexdigest()
    assert all(v is None for v in list(got[1].asDict().values())[2:])
    for k in (2, 3, 4, 6):
        assert got[k]["media_bytes"] == len(files[k]) and got[k]["feature"] is None and got[k]["n_bytes"] is None
    assert got[7]["n_bytes"] is None and got[7]["feature"] == got[0]["feature"]


def test_scans_of_single_components(monkeypatch):
    """A file with one scan for each component shows the luminance that the same blocks have in a file of their own."""
    own = media.encode_many([media.payload_of(bytes(range(200)))], [200])[0]
    at = own.index(b"\xff\xc0")
    size = struct.unpack(">H", own[at + 2 : at + 4])[0]
    high, wide = struct.unpack(">HH", own[at + 5 : at + 9])
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 14, 8, high, wide, 2) + b"\1\x11\0" + b"\2\x11\0"
    scan = own.index(b"\xff\xda")
    second = own[scan:-2].replace(b"\xff\xda\0\x08\1\1", b"\xff\xda\0\x08\1\2")
    assert second != own[scan:-2]
    for data in (own[:at] + frame + own[at + 2 + size : -2] + second + b"\xff\xd9", own[:at] + frame + own[at + 2 + size : scan] + second + own[scan:]):
        assert media.facts([data])[0][-1] == media.facts([own])[0][-1]
