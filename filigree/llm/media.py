"""Media columns: payloads stored losslessly as the coefficients of baseline JPEG images.

Every 64 payload bytes are the 64 coefficients (byte - 128, zig-zag order, quantiser 1) of one 8 x 8
block of a greyscale image, Huffman-coded as baseline JPEG with a restart marker after every `RESTART`
blocks. The image has as many columns as rows of blocks, or one more; places behind the payload are blocks without a
coefficient. Restart segments are independent, so they are coded and decoded in step, one numpy operation for
all segments of a slice. Reading back parses the markers, decodes the scan, and rebuilds the payload and
a thumbnail of luminance from the DC coefficients alone (one pixel a block).

Null text counts as empty; an empty text is one block of zeros. Repeated rows give equal values. Empty
table: empty result. The result is a function of the text only; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from filigree.llm.common import slices

RESTART = 4
SLICE = 1 << 19  # payload bytes coded in one go


def huffman(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Canonical code of symbols by code length: the 16 counts, the symbols in order, symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order), codes


@lru_cache(1)
def tables() -> tuple:
    """Our DC and AC codes: four bits for each size of a difference, and for a coefficient without a run; ten bits else."""
    dc = {size: 4 for size in range(12)}
    ac = {size: 4 for size in range(11)} | {(run << 4) | size: 10 for run in range(1, 16) for size in range(1, 11)} | {0xF0: 10}
    return huffman(dc), huffman(ac)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(blocks: int, n_bytes: int) -> tuple[bytes, int, int]:
    """Everything before the scan, and the image's width and height in blocks."""
    wide = next(w for w in range(max(1, -(-blocks // 8191)), blocks + 1) if w * w >= blocks)
    high = -(-blocks // wide)
    (dc_counts, dc_symbols, _), (ac_counts, ac_symbols, _) = tables()
    out = b"\xff\xd8" + segment(0xFE, b"payload %d %d" % (blocks * 64, n_bytes)) + segment(0xDB, b"\0" + b"\1" * 64)
    out += segment(0xC0, b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\1\1\x11\0")
    out += segment(0xC4, b"\x00" + dc_counts + dc_symbols) + segment(0xC4, b"\x10" + ac_counts + ac_symbols)
    out += segment(0xDD, RESTART.to_bytes(2, "big")) + segment(0xDA, b"\1\1\0\0\x3f\0")
    return out, wide, high


@lru_cache(1)
def value_codes() -> tuple:
    """By value + 256: (bits, length) of a DC difference, (bits, length) of an AC coefficient without a run, and by symbol the AC codes."""
    import numpy as np

    (_, _, dc), (_, _, ac) = tables()
    out = []
    for codes in (dc, ac):
        bits, lens = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for v in range(-255, 256):
            size = abs(v).bit_length()
            code, n = codes[size]
            bits[v + 256], lens[v + 256] = (code << size) | (v if v >= 0 else v + (1 << size) - 1), n + size
        out += [bits, lens]
    symbol, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in ac.items():
        symbol[s], length[s] = c, n
    return (*out, symbol, length)


def code_runs(rows):
    """(bits, lengths) of the AC coefficients of blocks (n, 64) that hold zeros; column 0 is not used.

    A zero has no code of its own, but the sixteenth of a run that goes on takes the run code, and the
    first zero after the last coefficient takes the end of block.
    """
    import numpy as np

    _, _, _, _, symbol, length = value_codes()
    rows = rows.astype(np.int64)
    rows[:, 0] = 1
    k = np.arange(64)
    seen = np.maximum.accumulate(np.where(rows != 0, k, 0), axis=1)
    prev = np.concatenate((np.zeros((len(rows), 1), np.int64), seen[:, :-1]), axis=1)
    last = seen[:, -1:]
    size = np.zeros_like(rows)
    for n in range(9):
        size += np.abs(rows) >> n > 0
    full_run = (rows == 0) & ((k - seen) % 16 == 0) & (k < last)
    which = np.where(rows != 0, (((k - prev - 1) & 15) << 4) | size, np.where(full_run, 0xF0, 0))
    coded = (rows != 0) | full_run | (k == last + 1)
    bits = (symbol[which] << size) | np.where(rows < 0, rows + (1 << size) - 1, rows)
    return np.where(coded, bits, 0), np.where(coded, length[which] + size, 0)


def code_scan(blocks, first):
    """Entropy-coded bytes of blocks (n, 64); first: number of a restart segment for each block that begins one, else -1.

    Returns the bytes and the offset of each segment in them. A segment of number 0 gets no restart marker.
    """
    import numpy as np

    dc_bits, dc_lens, ac_bits, ac_lens, _, _ = value_codes()
    n, begins = len(blocks), first >= 0
    at = blocks + np.int16(256)
    bits, lens = ac_bits[at], ac_lens[at]
    light = blocks[:, 0].astype(np.int64)
    change = light - np.where(begins, 0, np.concatenate(([0], light[:-1]))) + 256
    if len(rows := np.nonzero((blocks[:, 1:] == 0).any(axis=1))[0]):
        bits[rows], lens[rows] = code_runs(blocks[rows])
    bits[:, 0], lens[:, 0] = dc_bits[change], dc_lens[change]
    # Four neighbours make one word: at most 54 bits, as a code after a run follows a zero, which has none.
    for _ in range(2):
        bits = (bits[:, ::2] << lens[:, 1::2]) | bits[:, 1::2]
        lens = lens[:, ::2] + lens[:, 1::2]
    starts = np.nonzero(begins)[0]
    total = np.add.reduceat(lens.sum(axis=1), starts)
    marks = (first[starts] > 0).astype(np.int64) * 2
    offset = np.concatenate(([0], np.cumsum(-(-total // 8) + marks)))
    flat = lens.ravel()
    at = np.cumsum(flat) - flat
    shift = (offset[:-1] + marks) * 8 - np.concatenate(([0], np.cumsum(total)[:-1]))
    at += np.repeat(shift, np.diff(np.append(starts, n)) * 16)
    byte = at >> 3
    word = bits.ravel().view(np.uint64) << (64 - flat - (at & 7)).astype(np.uint64)
    word[flat == 0] = 0
    eight = word.byteswap().view(np.uint8).reshape(-1, 8)
    out = np.bincount((byte[:, None] + np.arange(8)).ravel(), weights=eight.ravel(), minlength=int(offset[-1]) + 8)
    out = out[: int(offset[-1])].astype(np.uint8)
    pad = -total % 8
    out[offset[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    marker = np.zeros(len(out), bool)
    has = offset[:-1][marks > 0]
    out[has], out[has + 1] = 0xFF, 0xD0 + (first[starts][marks > 0] - 1) % 8
    marker[has] = True
    stuffed = (out == 0xFF) & ~marker
    moved = np.concatenate(([0], np.cumsum(stuffed)))
    full = np.repeat(out, 1 + stuffed)
    full[np.nonzero(stuffed)[0] + 1 + moved[:-1][stuffed]] = 0
    return full, (offset + moved[offset])[:-1]


def encode(texts: list[bytes]) -> list[bytes]:
    """The JPEG file of each text. Work goes in slices of SLICE bytes, cut where a restart segment begins."""
    import numpy as np

    unit = 64 * RESTART
    heads = [header(max(1, -(-len(t) // 64)), len(t)) for t in texts]
    out = [[head] for head, _, _ in heads]
    waiting, size = [], 0

    def flush():
        nonlocal size
        if waiting:
            firsts = []
            for _, number, piece in waiting:
                mark = np.full(len(piece) // 64, -1, np.int64)
                mark[::RESTART] = number + np.arange(len(mark[::RESTART]))
                firsts.append(mark)
            blocks = np.frombuffer(b"".join(p for _, _, p in waiting), np.uint8).reshape(-1, 64).astype(np.int16) - 128
            data, offset = code_scan(blocks, np.concatenate(firsts))
            data, k = data.tobytes(), 0
            ends = [*offset.tolist(), len(data)]
            for i, _, piece in waiting:
                m = -(-len(piece) // unit)
                out[i].append(data[ends[k] : ends[k + m]])
                k += m
            waiting.clear()
            size = 0

    for i, text in enumerate(texts):
        text += b"\0" * (-len(text) % 64 if text else 64)
        _, wide, high = heads[i]
        text += b"\x80" * (64 * wide * high - len(text))  # the rest of the image: blocks without a coefficient
        for at in range(0, len(text), SLICE):
            piece = text[at : at + SLICE]
            waiting.append((i, at // unit, piece))
            size += len(piece)
            if size >= SLICE:
                flush()
    flush()
    return [b"".join(parts) + b"\xff\xd9" for parts in out]


def lookup(counts: bytes, symbols: bytes):
    """For each 16 bits that may follow: symbol and length of the code that they begin with (length 0: none)."""
    import numpy as np

    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            symbol[code << (16 - n) : (code + 1) << (16 - n)] = symbols[k]
            length[code << (16 - n) : (code + 1) << (16 - n)] = n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def parse(data: bytes) -> dict:
    """The markers of a greyscale baseline JPEG: size, tables, restart interval, comment, where the scan begins."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    found, at = {"huffman": {}, "restart": 0, "comment": b"", "quant": {}}, 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit greyscale is read")
            found["height"], found["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline is read")
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                found["huffman"][body[0]] = (body[1:17], body[17 : 17 + m])
                body = body[17 + m :]
        elif marker == 0xDB:
            found["quant"][body[0] & 15] = list(body[1:65])
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            found["comment"] = body
        elif marker == 0xDA:
            found["scan"] = at
            return found


def steps(counts: bytes, symbols: bytes, dc: bool):
    """For each 16 bits that may follow, packed: value (above bit 16), coefficients stepped over (bits 8 to 15), bits taken (bits 0 to 7).

    0: no such code. A code whose amplitude reaches beyond the 16 bits has 255 bits taken: it is read with symbol and length.
    """
    import numpy as np

    symbol, length = lookup(counts, symbols)
    size = symbol & 15
    taken = length + size
    amp = (np.arange(1 << 16) >> np.maximum(16 - taken, 0)) & ((1 << size) - 1)
    value = np.where((size > 0) & (amp < (1 << np.maximum(size - 1, 0))), amp - (1 << size) + 1, amp)
    step = np.ones(1 << 16, np.int64) if dc else np.where(symbol == 0, 64, (symbol >> 4) + 1)
    packed = np.where(taken <= 16, (value << 16) | (step << 8) | taken, (step << 8) | 255)
    return np.where(length > 0, packed, 0).astype(np.int32), symbol, length


def decode_scan(data, cuts, blocks_of, codes):
    """Coefficients (n, 64) of restart segments, decoded in step.

    data: entropy-coded bytes with stuffing and markers taken out; cuts: where each segment begins;
    blocks_of: its number of blocks; codes: (DC, AC) of steps().
    """
    import numpy as np

    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.int32)
    words = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    table = np.concatenate([c[0] for c in codes])
    first = np.concatenate(([0], np.cumsum(blocks_of)))
    out = np.zeros(int(first[-1]) * 64 + 64, np.int16)
    live = np.nonzero(blocks_of > 0)[0]
    bit, k = cuts[live] * 8, np.zeros(len(live), np.int64)
    base, end = first[:-1][live] * 64, first[1:][live] * 64
    while len(bit):
        at = (words[bit >> 3] >> (8 - (bit & 7))) & 0xFFFF
        inside = k > 0
        got = table[at + (inside << 16)]
        taken, step, value = got & 255, (got >> 8) & 255, got >> 16
        top = taken.max()
        if not taken.all():
            raise ValueError("no such code")
        if top == 255:
            for i in np.nonzero(taken == 255)[0]:
                _, symbol, length = codes[int(inside[i])]
                n, size = int(length[at[i]]), int(symbol[at[i]]) & 15
                word = int.from_bytes(wide[(bit[i] >> 3) : (bit[i] >> 3) + 6].astype(np.uint8).tobytes(), "big")
                amp = (word >> (48 - int(bit[i] & 7) - n - size)) & ((1 << size) - 1)
                value[i], taken[i] = amp if amp >> (size - 1) else amp - (1 << size) + 1, n + size
        k = k + step
        out[base + np.minimum(k, 64) - 1] += value.astype(np.int16)
        bit = bit + taken
        if (done := k >= 64).any():
            if ((k > 64) & (step < 64)).any():
                raise ValueError("run beyond a block")
            base, k = base + (done << 6), np.where(done, 0, k)
            on = base < end
            if not on.all():
                bit, k, base, end = bit[on], k[on], base[on], end[on]
    coefficients = out[: int(first[-1]) * 64].reshape(-1, 64)
    dc = np.cumsum(coefficients[:, 0], dtype=np.int64)
    before = np.concatenate(([0], dc))[first[:-1]]
    coefficients[:, 0] = dc - np.repeat(before, blocks_of)
    return coefficients


def decode(files: list[bytes]) -> list[tuple]:
    """(payload, unpadded bytes, width, height, thumbnail as an array) of each file written by encode()."""
    import numpy as np

    heads = [parse(f) for f in files]
    out: list = [None] * len(files)
    known: dict = {}
    waiting: list = []

    def finish(i, coefficients):
        head = heads[i]
        wide, high = -(-head["width"] // 8), -(-head["height"] // 8)
        n_payload, n_bytes = (int(x) for x in head["comment"].split()[1:3])
        light = coefficients[:, 0].astype(np.int64) * head["quant"][0][0] / 8 + 128
        thumb = np.clip(np.round(light), 0, 255).astype(np.uint8)
        payload = (coefficients[: n_payload // 64] + 128).astype(np.uint8).tobytes()
        out[i] = (payload, n_bytes, head["width"], head["height"], thumb.reshape(high, wide))

    def flush():
        if not waiting:
            return
        codes = waiting[0][4]
        cuts, counts, parts, at = [], [], [], 0
        for _, clean, begins, blocks_of, _ in waiting:
            cuts.append(begins + at)
            counts.append(blocks_of)
            parts.append(clean)
            at += len(clean)
        got = decode_scan(np.concatenate(parts), np.concatenate(cuts), np.concatenate(counts), codes)
        at = 0
        for i, _, _, blocks_of, _ in waiting:
            n = int(blocks_of.sum())
            pieces.setdefault(i, []).append(got[at : at + n])
            at += n
        waiting.clear()

    pieces: dict = {}
    size = 0
    for i, (f, head) in enumerate(zip(files, heads, strict=True)):
        key = (head["huffman"][0x00], head["huffman"][0x10])
        if key not in known:
            known[key] = tuple(steps(*x, dc=not k) for k, x in enumerate(key))
        blocks = -(-head["width"] // 8) * -(-head["height"] // 8)
        each = head["restart"] or blocks
        scan = np.frombuffer(f, np.uint8)[head["scan"] : -2]
        ff = np.nonzero(scan[:-1] == 0xFF)[0]
        after = scan[ff + 1]
        keep = np.ones(len(scan), bool)
        keep[ff[after == 0] + 1] = False
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep[marks] = keep[marks + 1] = False
        begins = np.concatenate(([0], np.cumsum(keep)[marks]))
        clean = scan[keep]
        blocks_of = np.full(len(begins), each, np.int64)
        blocks_of[-1] = blocks - each * (len(begins) - 1)
        most = max(1, SLICE // (64 * each))
        for s in range(0, len(begins), most):
            e = min(s + most, len(begins))
            stop = int(begins[e]) if e < len(begins) else len(clean)
            if waiting and (waiting[0][4] is not known[key] or size >= SLICE):
                flush()
                size = 0
            waiting.append((i, clean[int(begins[s]) : stop], begins[s:e] - begins[s], blocks_of[s:e], known[key]))
            size += int(blocks_of[s:e].sum()) * 64
    flush()
    for i, parts in pieces.items():
        finish(i, parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def average_hash(thumb) -> str:
    """64 bits: which of 8 x 8 samples of the thumbnail are above their mean."""
    import numpy as np

    high, wide = thumb.shape
    grid = thumb[np.arange(8) * high // 8][:, np.arange(8) * wide // 8].astype(np.int64)
    return np.packbits(grid * 64 > grid.sum()).tobytes().hex()


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the JPEG of each whole text."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text"):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode(texts), pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string, thumbnail_crc32 long"


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of column media back: sizes, digests, dimensions, thumbnail hashes."""

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        sha = lambda b: hashlib.sha256(b).hexdigest()
        names = ["doc_id", *(x.split()[0] for x in DIGESTS.split(", "))]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for part in slices(batches, "media"):
            files, rows = part.column("media").to_pylist(), []
            for f, (payload, n, wide, high, thumb) in zip(files, decode(files), strict=True):
                look, crc = average_hash(thumb), zlib.crc32(thumb.tobytes())
                rows.append((n, len(payload), sha(payload), zlib.crc32(payload[-64:]), len(f), sha(f), f"{wide}x{high}:{look}:{crc:08x}", wide, high, look, crc))
            columns = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), DIGESTS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")
