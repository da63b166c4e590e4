"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a payload; a validator for each format
walks its structure from there and gives the length, or nothing. A payload that validates from its first byte to its
last corrects the declared type; valid media further inside are carved out.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, small_batches

# Fixed values of the public formats: magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"P5\n": "image/x-portable-graymap",
    b"%PDF-": "application/pdf",
    b"OggS": "audio/ogg",
    b"PK\x03\x04": "application/zip",
}
UNKNOWN = "application/octet-stream"


class Payload:
    """Bytes with what validators of several hits share, so that a payload full of signatures is walked once."""

    def __init__(self, content: bytes):
        self.content, self.view = content, memoryview(content)
        self.found: dict[bytes, list[int]] = {}
        self.gif_ends: dict[int, int | None] = {}

    def places(self, token: bytes) -> list[int]:
        """Where a token stands, in order."""
        if token not in self.found:
            out, at = [], self.content.find(token)
            while at >= 0:
                out.append(at)
                at = self.content.find(token, at + 1)
            self.found[token] = out
        return self.found[token]

    def gif_blocks(self, i: int) -> int | None:
        """End of the data blocks that begin at i."""
        path, b = [], self.view
        while i < len(b) and i not in self.gif_ends:
            path.append(i)
            if b[i] == 0:
                self.gif_ends[i] = i + 1
                break
            i += 1 + b[i]
        end = self.gif_ends.get(i)
        self.gif_ends.update(dict.fromkeys(path, end))
        return end


def png_length(p: Payload, at: int) -> int | None:
    b, i, first = p.view, at + 8, True
    while i + 12 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), bytes(b[i + 4 : i + 8])
        if (first and (kind != b"IHDR" or n != 13)) or not kind.isalpha() or i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def jpeg_length(p: Payload, at: int) -> int | None:
    b, i = p.view, at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2 or i + 2 + n > len(b) or kind < 0xC0:
            return None
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next true marker
            j = p.content.find(b"\xff", i)
            while j >= 0 and j + 1 < len(b) and (b[j + 1] == 0 or 0xD0 <= b[j + 1] <= 0xD7):
                j = p.content.find(b"\xff", j + 2)
            if j < 0 or j + 1 >= len(b):
                return None
            i = j
    return i + 2 - at if i + 2 <= len(b) and bytes(b[i : i + 2]) == b"\xff\xd9" else None


def gif_length(p: Payload, at: int) -> int | None:
    b = p.view
    if at + 13 > len(b):
        return None
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while i is not None and i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = p.gif_blocks(i + 2)
        elif b[i] == 0x2C and i + 11 <= len(b):
            i = p.gif_blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def bmp_length(p: Payload, at: int) -> int | None:
    b = p.view
    if at + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    good = zero == 0 and header == 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and packed == 0 and start >= 54 and start + rows == size <= len(b) - at and rows > 0
    return size if good else None


def riff_length(p: Payload, at: int) -> int | None:
    b = p.view
    if at + 12 > len(b):
        return None
    end, need = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set()}.get(bytes(b[at + 8 : at + 12]))
    i, seen = at + 12, set()
    if need is None or end > len(b):
        return None
    while i + 8 <= end:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        seen.add(bytes(b[i : i + 4]))
        i += 8 + n + n % 2
    return end - at if i == end and need <= seen and seen else None


def pgm_length(p: Payload, at: int) -> int | None:
    parts = p.content[at : at + 64].split(b"\n", 3)
    size = parts[1].split(b" ") if len(parts) == 4 else []
    if len(size) != 2 or not (size[0].isdigit() and size[1].isdigit()) or parts[2] != b"255":
        return None
    n = sum(len(x) + 1 for x in parts[:3]) + int(size[0]) * int(size[1])
    return n if at + n <= len(p.content) else None


def pdf_length(p: Payload, at: int) -> int | None:
    ends, tables = p.places(b"%%EOF"), p.places(b"startxref")
    table = bisect.bisect_right(tables, at)
    if not ends or table == len(tables) or not tables[table] < ends[-1]:
        return None
    end = ends[-1] + 5
    return end + (p.content[end : end + 1] == b"\n") - at


def ogg_length(p: Payload, at: int) -> int | None:
    b, i, last = p.view, at, False
    while i + 27 <= len(b) and bytes(b[i : i + 5]) == b"OggS\0" and not last:
        n, last = b[i + 26], bool(b[i + 5] & 4)
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
    return i - at if last and i <= len(b) else None


def zip_length(p: Payload, at: int) -> int | None:
    ends = p.places(b"PK\x05\x06")
    if not ends or ends[-1] < at or ends[-1] + 22 > len(p.content):
        return None
    end = ends[-1]
    size, start, note = struct.unpack_from("<IIH", p.content, end + 12)
    return end + 22 + note - at if start + size == end - at and end + 22 + note <= len(p.content) else None


VALIDATORS = {"image/png": png_length, "image/jpeg": jpeg_length, "image/gif": gif_length, "image/bmp": bmp_length, "riff": riff_length, "image/x-portable-graymap": pgm_length, "application/pdf": pdf_length, "audio/ogg": ogg_length, "application/zip": zip_length}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def scan(content: bytes) -> list[tuple[str, int, int]]:
    """Valid media as (type, start, length), outermost first from the left; none inside one that came before."""
    payload, out, free = Payload(content), [], 0
    for end, (n, kind) in automaton().iter(content.decode("latin-1")):
        start = end + 1 - n
        if start >= free and (length := VALIDATORS[kind](payload, start)):
            if kind == "riff":
                kind = "audio/wav" if content[start + 8 : start + 12] == b"WAVE" else "image/webp"
            out.append((kind, start, length))
            free = start + length
    return out


def true_type(content: bytes, media: list[tuple[str, int, int]]) -> str:
    if media and media[0][1] == 0 and media[0][2] == len(content):
        return media[0][0]
    try:
        content.decode("utf-8")
        return "text/plain"
    except UnicodeDecodeError:
        return UNKNOWN


def sniff(df: DataFrame, content: str = "content", declared: str | None = "declared") -> DataFrame:
    """df with true_type, corrected (whether it differs from the declared type) and media: array of (type, start, length, data).

    Null content: all null, no media. A null declared type counts as wrong. Empty content is text/plain. Existing columns
    of these names are replaced. Rows are independent of each other."""
    made = ["true_type", "corrected", "media"]
    kept = df.drop(*made)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                content_, types, media = batch.column(content).to_pylist(), [], []
                for c in content_:
                    found = scan(c) if c is not None else []
                    types.append(None if c is None else true_type(c, found))
                    media.append([] if c is None else [{"type": k, "start": s, "length": n, "data": c[s : s + n]} for k, s, n in found])
                said = batch.column(declared).to_pylist() if declared else [None] * len(types)
                wrong = [None if c is None else t != s for c, t, s in zip(content_, types, said, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(media, kind)], names=[*batch.schema.names, *made])

    return kept.mapInArrow(run, ", ".join([*fields, "true_type string, corrected boolean, media array<struct<type:string,start:long,length:long,data:binary>>"]))


def pack_wav(payload: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


def pack_bmp(payload: bytes) -> bytes:
    start, height = 54 + 1024, len(payload) // 64
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, 64, height, 1, 8, 0, len(payload), 0, 0, 256, 0) + grey + payload


def pack_pgm(payload: bytes) -> bytes:
    return b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload


def pack_png(payload: bytes) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


PACK = {"audio/wav": pack_wav, "image/bmp": pack_bmp, "image/x-portable-graymap": pack_pgm, "image/png": pack_png}


def unpack(kind: str, media: bytes) -> bytes:
    """The 8-bit samples of a medium that one of PACK made."""
    if kind == "audio/wav":
        return media[44:]
    if kind == "image/bmp":
        return media[int.from_bytes(media[10:14], "little") :]
    if kind == "image/x-portable-graymap":
        return media.split(b"\n", 3)[3]
    i, data = 8, b""
    while i < len(media):
        n = int.from_bytes(media[i : i + 4], "big")
        data += media[i + 8 : i + 8 + n] if media[i + 4 : i + 8] == b"IDAT" else b""
        i += 12 + n
    rows = zlib.decompress(data)
    return b"".join(rows[i + 1 : i + 65] for i in range(0, len(rows), 65))


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text as 8-bit samples of a medium: columns n_bytes, declared ('text/plain'), content.

    The format goes by the CRC of the text, so equal texts are stored alike. Null text counts as empty (64 zero bytes).
    Existing columns of the new names are replaced, others stay; rows are independent, so ties and repeated rows give
    equal values; a text of any length is one payload. Empty table: empty result."""
    made = ["n_bytes", "declared", "content"]
    docs = docs.drop(*(c for c in made if c != text)) if text not in made else docs.withColumnRenamed(text, "_media_text").drop(*made)
    text = "_media_text" if text in made else text
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = list(PACK)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
                stored = [PACK[kinds[zlib.crc32(r) % len(kinds)]](r + b"\0" * (-len(r) % 64 if r else 64)) for r in raw]
                rest = batch.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([len(r) for r in raw], pa.int64()), pa.array(["text/plain"] * len(raw)), pa.array(stored, pa.binary())], names=[*rest.schema.names, *made])

    return small_batches(docs).mapInArrow(run, ", ".join([*fields, "n_bytes long, declared string, content binary"]))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features come from the stored bytes alone: the sniffed type, then the types and places of media inside the payload."""
    stored = text_media(documents(spark, sf_dir).select("doc_id", "text"))
    sniffed = sniff(stored)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, content, kind, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "content", "true_type", "media")), strict=True):
                if len(media) != 1 or kind not in PACK:
                    raise AssertionError(f"document {doc_id}: the stored medium is not found again")
                payload = unpack(kind, media[0]["data"])
                inner = [f"{k}@{s}+{m}" for k, s, m in scan(payload)]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(content), hashlib.sha256(content).hexdigest(), ";".join([kind, *inner])))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return sniffed.select("doc_id", "n_bytes", "content", "true_type", "media").mapInArrow(read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
