"""Image files as pages."""

import struct
import zlib

import numpy as np

from tonelake.functions.notation import grey_png
from tonelake.operators import omr
from tonelake.sources.images import on_white, read_images


def rgba_png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3) * 40
    (tmp_path / "a.png").write_bytes(grey_png(3, 2, grey.tobytes()))
    colour = np.array([[[200, 10, 30, 255], [200, 10, 30, 0]], [[0, 0, 0, 128], [255, 255, 255, 255]]], np.uint8)
    (tmp_path / "b.png").write_bytes(rgba_png(colour))
    (tmp_path / "c.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, str(tmp_path)).collect()}
    a = np.frombuffer(got["a.png"]["rgba"], np.uint8).reshape(2, 3, 4)
    assert (a[..., 0] == grey).all() and (a[..., 1] == grey).all() and (a[..., 3] == 255).all()
    b = np.frombuffer(got["b.png"]["rgba"], np.uint8).reshape(2, 2, 4)
    assert b[0].tolist() == [[200, 10, 30, 255], [255, 255, 255, 255]] and abs(int(b[1, 0, 0]) - 127) <= 1
    assert got["c.png"]["rgba"] is None and got["c.png"]["error"]


def test_on_white_then_grey():
    page = on_white(np.array([[[7], [250]]], np.uint8))
    assert omr.grey(page).tolist() == [[7, 250]]
