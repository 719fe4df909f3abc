"""DICOM files written here in every form that is read, against NumPy; broken ones give an error row."""

import struct
import zlib

import numpy as np

from lodestrata.sources import dicom

LONG_FORMS = {"OW", "OB", "SQ", "UN"}


def element(tag, form, value, order="<", explicit=True, unknown=False):
    value = value.encode() if isinstance(value, str) else value
    value += b"\0" * (len(value) % 2)
    n = dicom.UNKNOWN if unknown else len(value)
    head = struct.pack(order + "HH", *tag)
    if not explicit:
        return head + struct.pack(order + "I", n) + value
    if form in LONG_FORMS:
        return head + form.encode() + b"\0\0" + struct.pack(order + "I", n) + value
    return head + form.encode() + struct.pack(order + "H", n) + value


def written(pixels, syntax=dicom.EXPLICIT, patient="P1", tags=(), bits=16, signed=0, samples=1, planar=0):
    order, explicit = (">" if syntax == dicom.BIG_ENDIAN else "<"), syntax != dicom.IMPLICIT
    e = lambda tag, form, value, **k: element(tag, form, value, order, explicit, **k)
    short = lambda n: struct.pack(order + "H", n)
    item = struct.pack(order + "HHI", *dicom.ITEM, dicom.UNKNOWN) + e((0x0010, 0x0020), "LO", "INNER") + struct.pack(order + "HHI", *dicom.END_OF_ITEM, 0)
    nested = struct.pack(order + "HHI", *dicom.ITEM, dicom.UNKNOWN) + e((0x0008, 0x1140), "SQ", item + struct.pack(order + "HHI", *dicom.END_OF_ITEMS, 0), unknown=True) + struct.pack(order + "HHI", *dicom.END_OF_ITEM, 0)
    body = e((0x0008, 0x0020), "DA", "20240131") + e((0x0008, 0x0060), "CS", "CR")
    body += b"".join(e(tag, form, value) for tag, form, value in tags)
    body += e((0x0008, 0x1111), "SQ", nested + struct.pack(order + "HHI", *dicom.END_OF_ITEMS, 0), unknown=True)
    body += e((0x0010, 0x0020), "LO", patient) if patient is not None else b""
    height, width = pixels.shape[1:] if planar else pixels.shape[:2]
    body += e(dicom.SAMPLES, "US", short(samples)) + e(dicom.PLANAR, "US", short(planar)) + e(dicom.ROWS, "US", short(height)) + e(dicom.COLUMNS, "US", short(width))
    body += e(dicom.BITS, "US", short(bits)) + e(dicom.SIGNED, "US", short(signed))
    body += e(dicom.PIXELS, "OW", pixels.astype(pixels.dtype.newbyteorder(order)).tobytes())
    if syntax == dicom.DEFLATED:
        deflate = zlib.compressobj(wbits=-15)
        body = deflate.compress(body) + deflate.flush()
    return b"\0" * 128 + b"DICM" + element((0x0002, 0x0001), "OB", b"\0\1") + element(dicom.SYNTAX, "UI", syntax) + body


def seen(png):
    """The pixels of a PNG whose lines have no filter."""
    at, parts = 8, {}
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        parts[kind] = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
        at += 12 + n
    width, height, _, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, -1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape((height, width, 3) if colour == 2 else (height, width))


def test_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 4000, (30, 41)).astype(np.uint16)
    minus = rng.integers(-900, 900, (17, 8)).astype(np.int16)
    colours = rng.integers(0, 256, (3, 9, 12)).astype(np.uint8)
    scaled = lambda x: ((x - x.min()) / (x - x.min()).max() * 255).astype(np.uint8)
    named = [((0x0008, 0x0080), "LO", "Hôpital".encode("latin-1")), ((0x0010, 0x0040), "CS", "F")]
    utf8 = [((0x0008, 0x0005), "CS", "ISO_IR 192"), ((0x0008, 0x0080), "LO", "Hôpital")]
    cases = {
        "explicit": (written(grey, tags=named), scaled(grey.astype(float))),
        "implicit": (written(grey, dicom.IMPLICIT, tags=utf8), scaled(grey.astype(float))),
        "big": (written(minus, dicom.BIG_ENDIAN, signed=1), scaled(minus.astype(float))),
        "deflated": (written(grey, dicom.DEFLATED), scaled(grey.astype(float))),
        "constant": (written(np.full((4, 4), 77, np.uint16)), np.zeros((4, 4), np.uint8)),
        "bytes": (written(colours[0], bits=8), colours[0]),
        "planes": (written(colours, bits=8, samples=3, planar=1), colours.transpose(1, 2, 0)),
        "packed": (written(grey, "1.2.840.10008.1.2.4.50"), None),
        "short": (written(grey[:2], tags=[]).replace(struct.pack("<H", 2) + b"\x28\x00\x11\x00", struct.pack("<H", 900) + b"\x28\x00\x11\x00"), None),
    }
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.dcm").write_bytes(content)
    for name, content in {"none": written(grey, patient=None), "cut": cases["explicit"][0][:-5], "empty": b"", "other": b"\x89PNG" * 90, "blank": written(grey, patient="  ")}.items():
        (tmp_path / f"bad-{name}.dcm").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in dicom.dicom_files(spark, str(tmp_path)).collect()}
    assert set(got) == {*cases, "bad-none", "bad-cut", "bad-other", "bad-blank"}  # Spark passes over files without a byte
    for name, (_, want) in cases.items():
        r = got[name]
        assert r.error is None and (r.patient_id, r.modality, r.exam_date, r.exam_date_formatted, r.view_position) == ("P1", "CR", "20240131", "2024-01-31", "")
        if want is None:
            assert r.png is None and r.pixel_error
        else:
            assert r.pixel_error is None and (r.height, r.width) == want.shape[:2] and (seen(bytes(r.png)) == want).all()
    assert got["explicit"].institution_name == got["implicit"].institution_name == "Hôpital" and got["explicit"].sex == "F"
    assert all(got[f"bad-{n}"].error and got[f"bad-{n}"].patient_id is None for n in ("none", "cut", "other", "blank"))
    assert "patient" in got["bad-none"].error


def test_thumbnails():
    wide = np.arange(3000 * 1500).reshape(1500, 3000) % 251
    small = dicom.thumbnail(wide.astype(np.uint8))
    assert small.shape == (512, 1024) and abs(small.mean() - wide.mean()) < 1
    assert (dicom.thumbnail(np.full((4096, 2048, 3), 9, np.uint8), 2048) == 9).all() and dicom.thumbnail(np.zeros((1, 5000), np.uint8)).shape == (1, 1024)
    blocks = np.kron(np.arange(16, dtype=np.uint8).reshape(4, 4) * 10, np.ones((5, 5), np.uint8))
    assert (dicom.thumbnail(blocks, 4) == np.arange(16).reshape(4, 4) * 10).all()
    assert dicom.thumbnail(blocks, 20) is blocks
