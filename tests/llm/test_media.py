import hashlib
import random
import zlib

import pytest

from filigree.llm import media

TEXTS = [b"", b"a", b"\x80" * 64, bytes(range(256)) * 5, b"\x80" * 63 + b"a", b"\x80" * 30 + b"b" + b"\x80" * 100 + b"\xff", "é À 你好".encode() * 40, b"x" * 1_300_000]


def test_round_trip_of_bytes():
    rng = random.Random(7)
    texts = TEXTS + [bytes(rng.choice((0, 127, 128, 129, 255)) for _ in range(n)) for n in (63, 64, 65, 999, 5000)]
    for text, (payload, n, wide, high, thumb) in zip(texts, media.decode(media.encode(texts)), strict=True):
        assert n == len(text)
        assert payload == text + b"\0" * (-len(text) % 64 if text else 64)
        assert thumb.shape == (high // 8, wide // 8) and thumb.size >= len(payload) // 64
        assert thumb.ravel()[0] == round(min(255, max(0, (payload[0] - 128) / 8 + 128)))


def test_markers_are_those_of_baseline_jpeg():
    data = media.encode([b"hello" * 100])[0]
    head = media.parse(data)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    assert (head["width"], head["height"], head["restart"]) == (24, 24, media.RESTART)
    scan = data[head["scan"] : -2]
    assert all(scan[i + 1] == 0 or 0xD0 <= scan[i + 1] <= 0xD7 for i in range(len(scan) - 1) if scan[i] == 0xFF)


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8\x00\x00\x00\x00", media.encode([b"x"])[0].replace(b"\xff\xc0", b"\xff\xc2")])
def test_what_is_no_baseline_jpeg_is_refused(bad):
    with pytest.raises((ValueError, IndexError)):
        media.parse(bad)


def test_query_columns(spark):
    rows = [(1, "abc"), (2, "abc"), (None, None), (3, ""), (4, "é" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, media string")
    got = media.media_features(media.with_media(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = (dict(rows[:1] + rows[1:]).get(r.doc_id) or "").encode()
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.encode([text])[0]).hexdigest()
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert media.media_features(media.with_media(docs.limit(0))).count() == 0


def plain_decode(data):
    """Bit by bit, from the markers alone: coefficients of every block of a greyscale baseline JPEG, in zig-zag order."""
    at, tables, restart = 2, {}, 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if marker == 0xC4:
            code, k, tables[body[0]] = 0, 17, {}
            for n in range(1, 17):
                for _ in range(body[n]):
                    tables[body[0]][format(code, f"0{n}b")] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        if marker == 0xDD:
            restart = int.from_bytes(body, "big")
        if marker == 0xDA:
            break
    pieces, part, scan = [], bytearray(), data[at:-2]
    k = 0
    while k < len(scan):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            assert scan[k + 1] == 0xD0 + len(pieces) % 8
            pieces.append(part)
            part = bytearray()
            k += 2
        else:
            part.append(scan[k])
            k += 2 if scan[k] == 0xFF else 1
    pieces.append(part)
    blocks = []
    for piece in pieces:
        bits, p, light = "".join(format(b, "08b") for b in piece), 0, 0

        def symbol(table):
            nonlocal p
            n = next(n for n in range(1, 17) if bits[p : p + n] in table)
            p += n
            return table[bits[p - n : p]]

        def amplitude(n):
            nonlocal p
            p += n
            v = int(bits[p - n : p] or "0", 2)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        left = min(restart, wide * high // 64 - len(blocks))
        for _ in range(left):
            light += amplitude(symbol(tables[0x00]))
            block, j = [light] + [0] * 63, 1
            while j < 64:
                s = symbol(tables[0x10])
                if not s:
                    break
                j += s >> 4
                if s & 15:
                    block[j] = amplitude(s & 15)
                j += 1
            blocks.append(block)
        assert len(bits) - p < 8
    assert len(blocks) == wide * high // 64
    return blocks


def test_a_plain_decoder_finds_every_block():
    for text in [b"", b"a" * 320, bytes(range(256)) + b"\x80" * 192, b"z" * 64 * 47]:
        data = media.encode([text])[0]
        blocks = plain_decode(data)
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        assert bytes(v + 128 for b in blocks for v in b)[: len(payload)] == payload
        assert not any(v for b in blocks[len(payload) // 64 :] for v in b)
        assert media.decode([data])[0][4].ravel().tolist() == [min(255, max(0, round(b[0] / 8 + 128))) for b in blocks]
