"""DICOM files: headers and pictures, one row a file, for readers.binary_files.

The elements of a file are read one after another in explicit or implicit form, of either byte order, deflated or not;
sequences of known or unknown length are passed over. Pixels are read where they are not compressed: shifted and scaled to
0..255 unless they are bytes already (a picture of one value is black), made smaller by area means, and written as PNG.

A file that is broken, or tells no patient, raises, which binary_files turns into a row with an error; pixels that are
missing, compressed or too few leave png null and say why in pixel_error. Of several frames the first is taken. Files without
a byte give no row, as Spark doesn't read them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.readers import binary_files

#: Tags of the standard by the names of our columns; all but the first may be missing, and are '' then.
TAGS = {
    "patient_id": (0x0010, 0x0020),
    "exam_date": (0x0008, 0x0020),
    "exam_time": (0x0008, 0x0030),
    "sex": (0x0010, 0x0040),
    "age": (0x0010, 0x1010),
    "institution_name": (0x0008, 0x0080),
    "station_name": (0x0008, 0x1010),
    "study_description": (0x0008, 0x1030),
    "modality": (0x0008, 0x0060),
    "body_part": (0x0018, 0x0015),
    "patient_position": (0x0018, 0x5100),
    "view_position": (0x0018, 0x5101),
}
#: Tags of pictures, forms with a long length, and transfer syntaxes that are not compressed.
SAMPLES, PLANAR, FRAMES = (0x0028, 0x0002), (0x0028, 0x0006), (0x0028, 0x0008)
ROWS, COLUMNS, BITS, SIGNED, PIXELS = (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0100), (0x0028, 0x0103), (0x7FE0, 0x0010)
CHARSET, SYNTAX, ITEM, END_OF_ITEM, END_OF_ITEMS = (0x0008, 0x0005), (0x0002, 0x0010), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
UNKNOWN = 0xFFFFFFFF

SCHEMA = ", ".join(f"{n} string" for n in TAGS) + ", exam_date_formatted string, height int, width int, png binary, pixel_error string"


class _Elements:
    """Elements of a file from a place on: (tag, value), or (tag, None) for sequences."""

    def __init__(self, content: bytes, at: int, order: str, explicit: bool):
        self.content, self.at, self.order, self.explicit = content, at, order, explicit

    def head(self) -> tuple[tuple[int, int], bytes, int]:
        group, element = self.take("HH")
        if group == 0xFFFE:
            return (group, element), b"", self.take("I")[0]
        if not self.explicit:
            return (group, element), b"", self.take("I")[0]
        form = self.bytes(2)
        if form in LONG:
            self.bytes(2)
            return (group, element), form, self.take("I")[0]
        return (group, element), form, self.take("H")[0]

    def take(self, form: str) -> tuple:
        return struct.unpack(self.order + form, self.bytes(struct.calcsize("=" + form)))

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.content):
            raise ValueError("file ends within an element")
        self.at += n
        return self.content[self.at - n : self.at]

    def next(self) -> tuple[tuple[int, int], bytes | None]:
        tag, form, length = self.head()
        if length != UNKNOWN:
            value = self.bytes(length)
            return tag, None if form == b"SQ" else value
        open_ends = [END_OF_ITEMS]  # what closes each part of unknown length that we are in
        while open_ends:
            inner, _, length = self.head()
            if inner == open_ends[-1]:
                open_ends.pop()
            elif length == UNKNOWN:
                open_ends.append(END_OF_ITEM if inner == ITEM else END_OF_ITEMS)
            else:
                self.bytes(length)
        return tag, None


def elements(content: bytes) -> tuple[dict, str]:
    """Values by tag, outside of sequences, and the transfer syntax."""
    if content[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    found, part = {}, _Elements(content, 132, "<", True)
    while part.content[part.at : part.at + 2] == b"\x02\x00":
        tag, value = part.next()
        found[tag] = value
    syntax = (found.get(SYNTAX) or EXPLICIT.encode()).decode("ascii").strip("\0 ")
    rest = zlib.decompress(content[part.at :], -15) if syntax == DEFLATED else content
    part = _Elements(rest, 0 if syntax == DEFLATED else part.at, ">" if syntax == BIG_ENDIAN else "<", syntax != IMPLICIT)
    while part.at < len(rest):
        tag, value = part.next()
        found[tag] = value
    return found, syntax


def picture(found: dict, syntax: str) -> np.ndarray:
    """height x width, or x 3, of the first frame."""
    if syntax not in (IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN):
        raise ValueError(f"compressed pixels: {syntax}")
    order = ">" if syntax == BIG_ENDIAN else "<"
    number = lambda tag, default: struct.unpack(order + "H", found[tag])[0] if found.get(tag) else default
    height, width, samples = number(ROWS, 0), number(COLUMNS, 0), number(SAMPLES, 1)
    bits = number(BITS, 16)
    if bits not in (8, 16, 32) or samples not in (1, 3) or not height or not width or not found.get(PIXELS):
        raise ValueError("no pixels that can be read")
    kind = np.dtype(f"{order}{'i' if number(SIGNED, 0) else 'u'}{bits // 8}")
    values = np.frombuffer(found[PIXELS], kind, height * width * samples)
    if samples == 1:
        return values.reshape(height, width)
    return values.reshape(3, height, width).transpose(1, 2, 0) if number(PLANAR, 0) else values.reshape(height, width, 3)


def normalised(pixels: np.ndarray) -> np.ndarray:
    """Bytes: from 0 for the least value to 255 for the largest, cut to whole numbers; bytes stay as they are."""
    if pixels.dtype == np.uint8:
        return pixels
    shifted = pixels.astype(np.float64) - float(pixels.min())
    return (shifted / shifted.max() * 255 if shifted.max() > 0 else shifted).astype(np.uint8)


def _means(n: int, out: int) -> np.ndarray:
    """Weights of n points in each of out equal stretches of them."""
    edges = np.arange(out + 1) * (n / out)
    lo, hi = edges[:-1, None], edges[1:, None]
    own = np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None)
    return own / own.sum(axis=1, keepdims=True)


def thumbnail(pixels: np.ndarray, most: int = 1024) -> np.ndarray:
    """Bytes made smaller by area means until no side is over most, in the same proportions; small ones stay."""
    height, width = pixels.shape[:2]
    if max(height, width) <= most:
        return pixels
    down, across = (_means(n, max(1, round(n * most / max(height, width)))) for n in (height, width))
    planes = pixels.reshape(height, width, -1).astype(np.float64)
    smaller = np.stack([down @ planes[:, :, k] @ across.T for k in range(planes.shape[2])], axis=2)
    return np.rint(smaller).clip(0, 255).astype(np.uint8).reshape(len(down), len(across), *pixels.shape[2:])


def png(pixels: np.ndarray) -> bytes:
    """PNG of bytes: height x width in grey, or x 3 in colours."""
    height, width = pixels.shape[:2]
    lines = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)])  # each line begins with its filter, 0
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def parse(content: bytes, most: int = 1024) -> list[dict]:
    """The row of a file, by the names of SCHEMA."""
    found, syntax = elements(content)
    names = "utf-8" if (found.get(CHARSET) or b"").strip(b"\0 ").endswith(b"ISO_IR 192") else "latin-1"
    row = {n: (found.get(tag) or b"").decode(names, "replace").strip("\0 ") for n, tag in TAGS.items()}
    if not row["patient_id"]:
        raise ValueError("no patient id")
    date = row["exam_date"]
    row["exam_date_formatted"] = f"{date[:4]}-{date[4:6]}-{date[6:]}" if len(date) == 8 else date
    row |= {"height": None, "width": None, "png": None, "pixel_error": None}
    try:
        pixels = picture(found, syntax)
        row |= {"height": pixels.shape[0], "width": pixels.shape[1], "png": png(thumbnail(normalised(pixels), most))}
    except ValueError as e:
        row["pixel_error"] = str(e)
    return [row]


def dicom_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, error and the columns of SCHEMA, one row for each file below path."""
    return binary_files(spark, path, parse, SCHEMA)
