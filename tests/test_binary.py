"""Binary sources: round trips of written files, partitions, filters that leave blocks out, event streams in any splits."""

import struct

import numpy as np
import pytest

from lumenframe.sources.binary import BlockReader, Mib, read_binary, read_pts

RNG = np.random.default_rng(3)


def rows(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_mrc(spark, tmp_path):
    v = RNG.integers(-300, 300, (2, 40, 30)).astype("<i2")
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 30, 40, 2, 1)
    struct.pack_into("<i", head, 92, 16)
    path = tmp_path / "a.mrc"
    path.write_bytes(bytes(head) + bytes(16) + v.tobytes())
    df = read_binary(spark, str(path), "mrc", blockbytes=600)
    assert df.rdd.getNumPartitions() == 4
    assert rows(df, "y", "x", "v") == {(y + 1, x + 1): float(v[0, y, x]) for y in range(40) for x in range(30)}
    whole = read_binary(spark, str(path), "mrc", sections="all", blockbytes=600)
    assert whole.count() == 2400 and whole.where("y = 41 AND x = 1").first()["v"] == v[1, 0, 0]
    some = df.where("y > 10 AND y <= 20")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 300
    path.write_bytes(bytes(head)[:100])
    with pytest.raises(Exception, match="shorter"):
        read_binary(spark, str(path), "mrc").collect()


def test_raw(spark, tmp_path):
    v = RNG.integers(0, 60000, (5, 7)).astype(">u2")
    (tmp_path / "a.bin").write_bytes(b"head" + v.tobytes())
    df = read_binary(spark, str(tmp_path / "a.bin"), "rawraster", width=7, height=5, bits=16, order="big", header=4)
    assert rows(df, "y", "x", "v") == {(y + 1, x + 1): float(v[y, x]) for y in range(5) for x in range(7)}


@pytest.mark.parametrize("record", ["vector", "image"])
def test_rpl(spark, tmp_path, record):
    v = RNG.random((6, 5, 4)).astype("<f4")
    (tmp_path / "a.rpl").write_text(f"key\tvalue\n; note\nwidth\t5\nheight\t6\ndepth\t4\noffset\t8\ndata-length\t4\ndata-type\tfloat\nbyte-order\tlittle-endian\nrecord-by\t{record}\n")
    (tmp_path / "a.RAW").write_bytes(bytes(8) + (np.moveaxis(v, 2, 0) if record == "image" else v).tobytes())
    df = read_binary(spark, str(tmp_path / "a.rpl"), "rpl", blockbytes=160)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df, "y", "x", "ch", "v") == {(y + 1, x + 1, c): float(v[y, x, c]) for y in range(6) for x in range(5) for c in range(4)}


def series(what, dims, elements, wide):
    """A series file: header, dimensions, elements, then their places."""
    version = 0x0220 if wide else 0x0210
    size, code = (8, "<Q") if wide else (4, "<I")
    dim = b"".join(struct.pack("<IddI", d, 0.0, 1.0, 0) + struct.pack("<I", 3) + b"pos" + struct.pack("<I", 1) + b"m" for d in dims)
    first = 22 + size + 4 + len(dim)
    places, body = [], b""
    for e in elements:
        places.append(first + len(body))
        body += e
    head = struct.pack("<HHHIIII", 0x4949, 0x0197, version, what, 0, len(elements), len(elements))
    return head + struct.pack(code, first + len(body)) + struct.pack("<I", len(dims)) + dim + body + b"".join(struct.pack(code, p) for p in places)


@pytest.mark.parametrize("wide", [False, True])
def test_ser(spark, tmp_path, wide):
    v = RNG.integers(0, 1000, (3, 4, 6)).astype("<i4")
    element = lambda s: struct.pack("<ddiHI", 0.0, 0.1, 0, 6, 6) + s.tobytes()
    (tmp_path / "a.ser").write_bytes(series(0x4120, [3, 4], [element(v[y, x]) for y in range(3) for x in range(4)], wide))
    df = read_binary(spark, str(tmp_path / "a.ser"), "ser", blockbytes=96)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df, "y", "x", "ch", "v") == {(y + 1, x + 1, c): float(v[y, x, c]) for y in range(3) for x in range(4) for c in range(6)}
    img = RNG.random((4, 5)).astype("<f8")
    (tmp_path / "b.ser").write_bytes(series(0x4122, [1], [struct.pack("<ddiddiHII", 0, 1, 0, 0, 1, 0, 8, 5, 4) + img.tobytes()], wide))
    got = read_binary(spark, str(tmp_path / "b.ser"), "ser")
    assert rows(got, "y", "x", "ch", "v") == {(y + 1, x + 1, 0): img[y, x] for y in range(4) for x in range(5)}


@pytest.mark.parametrize("chips", [1, 4])
def test_mib(spark, tmp_path, chips):
    """Frames as they should come out, scrambled by hand into the file's order."""
    n = 6
    shown = RNG.integers(0, 256, (n, 8, 16) if chips == 4 else (n, 4, 16)).astype("u1")
    if chips == 4:
        top, low = shown[:, :4], shown[:, 4:]
        flat = np.concatenate([top[:, :, :8], top[:, :, 8:], np.rot90(low[:, :, :8], 2, (1, 2)), np.rot90(low[:, :, 8:], 2, (1, 2))], 2)
    else:
        flat = shown
    h, w = flat.shape[1:]
    head = f"MQ1,000001,00064,{chips:02d},{w:04d},{h:04d},R64,{'2x2' if chips == 4 else '1x1'},".encode().ljust(64, b"\0")
    raw = flat.reshape(n, h, w // 8, 8)[..., ::-1].reshape(n, h * w)
    (tmp_path / "a.mib").write_bytes(b"".join(head + f.tobytes() for f in raw))
    df = read_binary(spark, str(tmp_path / "a.mib"), "mib", rows=3, cols=2, blockbytes=1)
    assert df.rdd.getNumPartitions() == 3 and df.where("sy = 1").rdd.getNumPartitions() == 1
    want = {(k // 2, k % 2, a, b): float(shown[k, a, b]) for k in range(n) for a in range(shown.shape[1]) for b in range(16)}
    assert rows(df, "sy", "sx", "ky", "kx", "v") == want
    (tmp_path / "a.mib").write_bytes(b"XX")
    with pytest.raises(ValueError):
        BlockReader(Mib({"path": str(tmp_path / "a.mib")})).partitions()


def tag(name, body, kind, wide):
    return bytes([kind]) + struct.pack(">H", len(name)) + name.encode() + (struct.pack(">Q", len(body)) if wide else b"") + body


def group(entries, wide):
    return b"\x01\x00" + struct.pack(">Q" if wide else ">I", len(entries)) + b"".join(entries)


def leaf(name, info, data, wide):
    code = ">Q" if wide else ">I"
    return tag(name, b"%%%%" + struct.pack(code, len(info)) + b"".join(struct.pack(code, i) for i in info) + data, 21, wide)


def tagged(images, wide):
    """A file of nested tags with images (values, code of their kind, dimensions), names and structs around them."""
    number = lambda n, v: leaf(n, [3], struct.pack("<i", v), wide)
    one = []
    for values, code, dims in images:
        shape = tag("Dimensions", group([number("", d) for d in dims], wide), 20, wide)
        plain = {1: 2, 2: 6, 10: 4}[code]
        data = tag("ImageData", group([leaf("Data", [20, plain, values.size], values.tobytes(), wide), number("DataType", code), shape], wide), 20, wide)
        one.append(tag("", group([leaf("Name", [20, 4, 3], "abc".encode("utf-16-le"), wide), data], wide), 20, wide))
    rest = [leaf("Rect", [15, 0, 2, 0, 3, 0, 6], struct.pack("<if", 1, 2.0), wide), leaf("Text", [18, 4], "hi".encode("utf-16-le"), wide), leaf("Points", [20, 15, 0, 2, 0, 3, 0, 3, 2], bytes(16), wide)]
    root = group([*rest, tag("ImageList", group(one, wide), 20, wide)], wide)
    return struct.pack(">I", 4 if wide else 3) + struct.pack(">Q" if wide else ">I", len(root)) + struct.pack(">I", 1) + root + bytes(8)


@pytest.mark.parametrize("wide", [False, True])
def test_dm(spark, tmp_path, wide):
    small, img = RNG.integers(0, 9, (2, 3)).astype("<i2"), RNG.random((6, 5)).astype("<f4")
    (tmp_path / "a.dm").write_bytes(tagged([(small, 1, [3, 2]), (img, 2, [5, 6])], wide))
    df = read_binary(spark, str(tmp_path / "a.dm"), "dm", blockbytes=40)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df, "y", "x", "ch", "v") == {(y + 1, x + 1, 0): float(img[y, x]) for y in range(6) for x in range(5)}
    cube = RNG.integers(0, 99, (4, 3, 2)).astype("<u2")  # channel, y, x
    (tmp_path / "b.dm").write_bytes(tagged([(cube, 10, [2, 3, 4])], wide))
    got = read_binary(spark, str(tmp_path / "b.dm"), "dm", blockbytes=16)
    assert rows(got, "y", "x", "ch", "v") == {(y + 1, x + 1, c): float(cube[c, y, x]) for c in range(4) for y in range(3) for x in range(2)}
    assert got.where("y >= 3").count() == 8
    (tmp_path / "c.dm").write_bytes(tagged([(img, 2, [5, 6])], wide)[:200])
    with pytest.raises(Exception, match="ends within|no image"):
        read_binary(spark, str(tmp_path / "c.dm"), "dm").collect()


@pytest.mark.parametrize(("order", "kind", "samples", "per"), [("<", "u2", 1, 3), (">", "f4", 1, 10), ("<", "u1", 3, 4)])
def test_tif(spark, tmp_path, order, kind, samples, per):
    v = (RNG.random((10, 7, samples)) * 200).astype(order + kind)
    strips = [v[a : a + per].tobytes() for a in range(0, 10, per)]
    places, at = [], 8
    for s in strips:
        places.append(at)
        at += len(s)
    extra = np.array(places, order + "u4").tobytes()
    form = {"u": 1, "i": 2, "f": 3}[kind[0]]
    entry = lambda t, k, n, x: struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", x, 0) if k == 3 else struct.pack(order + "I", x))
    where = entry(273, 4, len(places), at if len(places) > 1 else places[0])
    fields = [entry(256, 3, 1, 7), entry(257, 3, 1, 10), entry(258, 3, 1, 8 * int(kind[1])), entry(259, 3, 1, 1), where, entry(277, 3, 1, samples), entry(278, 3, 1, per), entry(339, 3, 1, form)]
    ifd = struct.pack(order + "H", len(fields)) + b"".join(fields) + bytes(4)
    (tmp_path / "a.tif").write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(extra)) + b"".join(strips) + extra + ifd)
    df = read_binary(spark, str(tmp_path / "a.tif"), "tif", blockbytes=50)
    assert df.rdd.getNumPartitions() > 1
    want = {(y + 1, x + 1): pytest.approx(float(v[y, x].astype(float).mean())) for y in range(10) for x in range(7)}
    assert rows(df, "y", "x", "v") == want


def test_calibrations(spark):
    from datetime import datetime

    from lumenframe.sources import calibrations as C

    day = lambda d: datetime(2024, 1, d)
    t = C.upsert(spark.createDataFrame([], C.SCHEMA), spark.createDataFrame([("A|100", 1.0, "nm", "", day(1)), ("A|100", 2.0, "nm", "", day(3)), ("B|50", 5.0, "nm", "", day(1)), (None, 1.0, "nm", "", day(1)), ("C|1", -1.0, "nm", "", day(1))], C.SCHEMA))
    t = C.upsert(t, spark.createDataFrame([("A|100", 9.0, "um", "", day(3)), ("B|50", 7.0, "nm", "", day(1).replace(year=2020))], C.SCHEMA))
    assert {r["key"]: r["pixel_size"] for r in t.collect()} == {"A|100": 9.0, "B|50": 5.0}
    rows_ = spark.createDataFrame([(" A ", 100.2), ("A", 99.0), ("", 100.0), ("B", 50.0)], "instrument string, magnification double")
    got = {(r["instrument"], r["magnification"]): r["pixel_size"] for r in C.calibrated(rows_, C.without(t, t.where("key = 'B|50'"))).collect()}
    assert got == {(" A ", 100.2): 9.0, ("A", 99.0): None, ("", 100.0): None, ("B", 50.0): None}


def sequential(words, width, height, channels):
    out, y, x = {}, 0, 0
    for w in words:
        kind, load = w >> 12, w & 0xFFF
        if kind == 9:
            y = load >> 3
        elif kind == 8:
            x = load >> 3
        elif kind == 11 and y < height and x < width and load < channels:
            out[y + 1, x + 1, load] = out.get((y + 1, x + 1, load), 0) + 1
    return out


@pytest.mark.parametrize("block", [2, 6, 50, 1 << 20])
def test_pts(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    words = [0xB005]
    for y in range(12):
        words.append(0x9000 | y << 3)
        for x in range(0, 9, 2):
            words.append(0x8000 | x << 3 | 5)
            words += [int(k) << 12 | int(c) for k, c in zip(rng.choice([6, 7, 11, 11, 3], 4), rng.integers(0, 20, 4), strict=True)]
    (tmp_path / "a.pts").write_bytes(b"head" + np.array(words, "<u2").tobytes())
    got = read_pts(spark, str(tmp_path / "a.pts"), 8, 10, start=4, n_channels=15, blockbytes=block)
    assert rows(got, "y", "x", "ch", "v") == sequential(words, 8, 10, 15)
