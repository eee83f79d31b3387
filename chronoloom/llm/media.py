"""Media columns (operator 1): signature sniffing.

An Aho-Corasick automaton finds magic bytes anywhere in a column of stored bytes; a validator for each format confirms
structure and lengths before a hit counts. The confirmed type replaces the declared one, and media that begin later or
lie inside another are carved with their offsets. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import rows

STEP = 192
#: Magic bytes of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"P5": "image/x-portable-graymap",
    b".snd": "audio/basic",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
}
#: Formats that hold 8-bit samples without loss, in the order in which stored texts rotate through them.
STORES = ("image/png", "audio/wav", "image/bmp", "image/x-portable-graymap", "audio/basic")


#: Samples beyond this are confirmed, but not returned (a header of a few bytes may promise terabytes).
MAX_SAMPLES = 1 << 28


@dataclass
class Found:
    kind: str
    begin: int
    end: int
    shape: tuple[int, int]  # width and height, or rate and frames
    read: Callable[[], bytes | None] | None = None  # None where the format's samples are not 8-bit grey or mono

    @property
    def samples(self) -> bytes | None:
        """Copied when asked for: a find by itself holds offsets only."""
        return self.read() if self.read else None


def _cut(data: bytes, begin: int, n: int) -> Callable[[], bytes | None]:
    return lambda: data[begin : begin + n] if n <= MAX_SAMPLES else None


def _inflate(data: bytes, spans: list[tuple[int, int]], size: int, keep: bool) -> tuple[int, bytes]:
    """Bytes that the spans hold when inflated piece by piece, counted up to size + 1; the bytes themselves on demand."""
    plain, total, kept = zlib.decompressobj(), 0, []
    for begin, n in spans:
        for i in range(begin, begin + n, 1 << 16):
            rest = data[i : min(i + (1 << 16), begin + n)]
            while rest and total <= size and not plain.eof:
                got = plain.decompress(rest, 1 << 20)
                total += len(got)
                if keep:
                    kept.append(got)
                rest = plain.unconsumed_tail
    while total <= size and not plain.eof and (got := plain.decompress(b"", 1 << 20)):
        total += len(got)
        if keep:
            kept.append(got)
    return total, b"".join(kept)


def _png(data: bytes, at: int, memo: dict) -> Found | None:
    """Chunks with lengths and checks from IHDR to IEND; of 8-bit grey ones, as many bytes as the header promises."""
    i, shape, packed, depth = at + 8, None, [], None
    while i + 12 <= len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        name = data[i + 4 : i + 8]
        if i + 12 + n > len(data) or not name.isalpha():
            return None
        body = data[i + 8 : i + 8 + n]
        if zlib.crc32(body, zlib.crc32(name)) != int.from_bytes(data[i + 8 + n : i + 12 + n], "big"):
            return None
        i += 12 + n
        if name == b"IHDR":
            if n != 13 or shape:
                return None
            shape, depth = struct.unpack(">II", body[:8]), tuple(body[8:13])
            if 0 in shape:
                return None
        elif shape is None:
            return None
        elif name == b"IDAT":
            packed.append((i - 4 - n, n))
        elif name == b"IEND":
            if not packed:
                return None
            if depth != (8, 0, 0, 0, 0):
                return Found("image/png", at, i, shape)
            size = shape[1] * (shape[0] + 1)
            if size > 1032 * sum(n for _, n in packed):  # more than deflate can hold
                return None
            try:
                if _inflate(data, packed, size, False)[0] != size:
                    return None
            except zlib.error:
                return None

            def read(shape=shape, size=size) -> bytes | None:
                if size > MAX_SAMPLES:
                    return None
                lines = np.frombuffer(_inflate(data, packed, size, True)[1], np.uint8).reshape(shape[1], shape[0] + 1)
                return lines[:, 1:].tobytes() if not lines[:, 0].any() else None

            return Found("image/png", at, i, shape, read)
    return None


def _wav(data: bytes, at: int, memo: dict) -> Found | None:
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    i, form = at + 12, None
    while i + 8 <= end:
        name, n = data[i : i + 4], int.from_bytes(data[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            form = struct.unpack("<HHIIHH", data[i + 8 : i + 24])
            if form[4] != form[1] * form[5] // 8 or form[3] != form[2] * form[4]:
                return None
        elif name == b"data":
            if not form or not form[4] or n % form[4]:
                return None
            return Found("audio/wav", at, end, (form[2], n // form[4]), _cut(data, i + 8, n) if form[:2] == (1, 1) and form[5] == 8 else None)
        i += 8 + n + n % 2
    return None


def _bmp(data: bytes, at: int, memo: dict) -> Found | None:
    """Headers of 40, 108 and 124 bytes; bytes may follow the rows up to the stated size."""
    if at + 54 > len(data):
        return None
    size, _, where, head, width, height, planes, bits, packing = struct.unpack("<IIIIiiHHI", data[at + 2 : at + 34])
    row = (width * bits + 31) // 32 * 4
    if head not in (40, 108, 124) or planes != 1 or packing not in ((0, 3) if bits in (16, 32) else (0,)) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    n = row * abs(height)
    if where < 14 + head or where + n > size or at + size > len(data):
        return None

    def read() -> bytes | None:
        if n > MAX_SAMPLES:
            return None
        lines = np.frombuffer(data, np.uint8, n, at + where).reshape(-1, row)
        return (lines[::-1] if height > 0 else lines)[:, :width].tobytes()

    return Found("image/bmp", at, at + size, (width, abs(height)), read if bits == 8 else None)


_PGM = re.compile(rb"P5((?:[ \t\r\n]|#[^\n]{0,200}\n){1,64}([0-9]{1,9}))(?:(?:[ \t\r\n]|#[^\n]{0,200}\n){1,64}([0-9]{1,9}))(?:(?:[ \t\r\n]|#[^\n]{0,200}\n){1,64}([0-9]{1,5}))[ \t\r\n]")


def _pgm(data: bytes, at: int, memo: dict) -> Found | None:
    """Width, height and largest value, with comment lines between them; samples of two bytes above 255."""
    head = _PGM.match(data, at)
    if not head:
        return None
    width, height, top = (int(head[i]) for i in (2, 3, 4))
    n = width * height * (1 if top < 256 else 2)
    if not n or not 0 < top < 65536 or head.end() + n > len(data):
        return None
    return Found("image/x-portable-graymap", at, head.end() + n, (width, height), _cut(data, head.end(), n) if top < 256 else None)


def _au(data: bytes, at: int, memo: dict) -> Found | None:
    if at + 24 > len(data):
        return None
    where, n, coding, rate, channels = struct.unpack(">IIIII", data[at + 4 : at + 24])
    if where < 24 or where % 4 or coding not in range(1, 28) or not channels or not rate or at + where + n > len(data):
        return None
    return Found("audio/basic", at, at + where + n, (rate, n), _cut(data, at + where, n) if (coding, channels) == (2, 1) else None)


def _gif(data: bytes, at: int, memo: dict) -> Found | None:
    if at + 13 > len(data):
        return None
    width, height = struct.unpack("<HH", data[at + 6 : at + 10])
    i, images = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0), 0
    while i < len(data):
        mark = data[i]
        if mark == 0x3B:
            return Found("image/gif", at, i + 1, (width, height)) if images and width and height else None
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 < len(data):
            i += 11 + (3 << (data[i + 9] & 7) + 1 if data[i + 9] & 128 else 0)
            images += 1
        else:
            return None
        while i < len(data) and data[i]:
            i += 1 + data[i]
        i += 1
    return None


def _jpeg(data: bytes, at: int, memo: dict) -> Found | None:
    i, shape = at + 2, None
    while i + 4 <= len(data) and data[i] == 0xFF:
        mark, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        if n < 2 or i + 2 + n > len(data):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if n < 8:
                return None
            height, width = struct.unpack(">HH", data[i + 5 : i + 9])
            shape = (width, height)
        i += 2 + n
        if mark == 0xDA:
            after, end = memo.get("jpeg", (0, -2))  # no end mark lies between these two; -1 means none to the end
            if end == -2 or not (after <= i and (end == -1 or i <= end)):
                end = data.find(b"\xff\xd9", i)
                memo["jpeg"] = (i, end)
            return Found("image/jpeg", at, end + 2, shape) if end >= 0 and shape and 0 not in shape else None
    return None


VALID = {"image/png": _png, "audio/wav": _wav, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "audio/basic": _au, "image/gif": _gif, "image/jpeg": _jpeg}
_AUTOMATON: list = []


def automaton():
    """One per worker. The library matches strings, so bytes are read as Latin-1, one character a byte."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (len(magic), kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def carve(data: bytes) -> list[Found]:
    """Every confirmed medium, by offset; one inside another follows it."""
    found, memo = [], {}
    for last, (n, kind) in automaton().iter(data.decode("latin-1")):
        hit = VALID[kind](data, last - n + 1, memo)
        if hit:
            found.append(hit)
    return sorted(found, key=lambda x: (x.begin, -x.end))


def sniff(df: DataFrame, *, media: str = "media", declared: str = "declared", key: str = "doc_id") -> DataFrame:
    """Columns: key, declared, media_type, corrected, media, offset, length, width, height, samples, embedded.

    media_type is the confirmed type of the first medium, else null; corrected tells that it differs from the declared
    one (null counts as different). embedded lists all further media as (type, offset, length): those inside the first
    as well as those behind it. samples are the 8-bit samples of a readable medium of MAX_SAMPLES bytes at most, else
    null. Null or unrecognised bytes give nulls, an empty table an empty result. Rows are independent, so null keys, ties and repeated rows need no rule; other columns of df are
    not carried.
    """
    kind = df.schema[key].dataType.simpleString()
    spots = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for batch in rows.slices(batches, media):
            out: dict[str, list] = {k: [] for k in ("media_type", "corrected", "offset", "length", "width", "height", "samples", "embedded")}
            for data, said in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = carve(data) if data else []
                top = found[0] if found else None
                out["media_type"].append(top and top.kind)
                out["corrected"].append(bool(top) and top.kind != said)
                out["offset"].append(top and top.begin)
                out["length"].append(top and top.end - top.begin)
                out["width"].append(top and top.shape[0])
                out["height"].append(top and top.shape[1])
                out["samples"].append(top and top.samples)
                out["embedded"].append([{"type": x.kind, "offset": x.begin, "length": x.end - x.begin} for x in found[1:]])
            types = {"media_type": pa.string(), "corrected": pa.bool_(), "samples": pa.binary(), "embedded": spots}
            cols = [pa.array(v, types.get(k, pa.int64())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=[key, "declared", "media", *out])

    schema = f"`{key}` {kind}, declared string, media binary, media_type string, corrected boolean, `offset` long, length long, width long, height long, samples binary, embedded array<struct<type:string,`offset`:long,length:long>>"
    narrow = df.selectExpr(f"`{key}`", f"`{declared}` AS declared", f"`{media}` AS `{media}`")
    return rows.arrow_map(narrow, run, schema)


def store(payload: bytes, kind: str) -> bytes:
    """The payload, a positive multiple of STEP bytes, as the 8-bit samples of a medium."""
    n = len(payload)
    height = n // STEP
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if kind == "image/bmp":
        palette = (np.arange(256, dtype="<u4") * 0x010101).tobytes()
        head = struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, STEP, height, 1, 8, 0, n, 2835, 2835, 256, 0)
        return b"BM" + head + palette + np.frombuffer(payload, np.uint8).reshape(height, STEP)[::-1].tobytes()
    if kind == "image/x-portable-graymap":
        return f"P5\n{STEP} {height}\n255\n".encode() + payload
    if kind == "audio/basic":
        return b".snd" + struct.pack(">IIIII", 24, n, 2, 8000, 1) + payload
    if kind == "image/png":
        lines = np.zeros((height, STEP + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, STEP)
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))
        head = struct.pack(">IIBBBBB", STEP, height, 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def padded(text: bytes) -> bytes:
    return text + b" " * (max(STEP, -(-len(text) // STEP) * STEP) - len(text))


def stored_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as a medium with a declared type that is right for one text in five: key, n_bytes, declared, media.

    Null texts count as empty and give a payload of STEP spaces. Rows are independent: null keys, ties and repeated
    rows need no rule, equal texts give equal media. Other columns of df are not carried; an empty table gives none.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in rows.slices(batches, text):
            n_bytes, declared, media = [], [], []
            for data in rows.utf8_column(batch, text).to_pylist():
                payload = padded(data)
                check = zlib.crc32(payload)
                n_bytes.append(len(data))
                declared.append(STORES[check // 5 % 5])
                media.append(store(payload, STORES[check % 5]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names=[key, "n_bytes", "declared", "media"])

    return rows.arrow_map(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, declared string, media binary")


def digests(df: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """From sniff(): the payload's and the medium's lengths and hashes, and a feature of the samples.

    Columns: key, n_bytes (carried), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    media_type, corrected. Without samples both are empty. Rows are independent; an empty table gives none.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")

    def run(batches):
        for batch in rows.slices(batches, "media"):
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: dict[str, list] = {n: [] for n in names[:6]}
            for i, (samples, media) in enumerate(zip(col["samples"], col["media"], strict=True)):
                part = media[col["offset"][i] : col["offset"][i] + col["length"][i]] if samples is not None else b""
                samples = samples or b""
                counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
                p = counts[counts > 0] / max(1, len(samples))
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-16:]))
                out["media_bytes"].append(len(part))
                out["media_sha256"].append(hashlib.sha256(part).hexdigest())
                mean = int(counts @ np.arange(256)) / max(1, len(samples))
                out["feature"].append(f"{col['media_type'][i]};{col['width'][i]}x{col['height'][i]};mean={mean:.4f};bits={abs(-(p * np.log2(p)).sum()):.4f};embedded={len(col['embedded'][i])}")
            cols = [pa.array(v, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, *(batch.column(batch.schema.get_field_index(n)) for n in names[6:])], names=[key, "n_bytes", *names])

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"
    return rows.arrow_map(df, run, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = stored_texts(rows.documents(spark, sf_dir))
    # The length of the unpadded text travels beside the key, so that sniff() sees stored bytes only.
    keyed = held.selectExpr("struct(doc_id, n_bytes) AS doc_id", "declared", "media")
    found = sniff(keyed).selectExpr("doc_id.doc_id AS doc_id", "doc_id.n_bytes AS n_bytes", "media", "media_type", "corrected", "`offset`", "length", "width", "height", "samples", "embedded")
    return digests(found)
