"""Binary rasters, cubes and scans as Spark data sources: a partition for each block of rows, rows outside a filter aren't read.

Formats: mrc (the sections of a map), rpl (a text header beside .raw values), ser (series of images or spectra), mib (frames of
a pixel detector), dm (images and cubes within nested tags), tif, raw (plain values, the geometry as options) and pts (the events of an X-ray map). Tasks open the files
themselves, so paths must lie on a file system that all executors mount. register() makes the formats known to a session.

Rows: rasters ds_id, y, x, v; cubes ds_id, y, x, ch, v; scans ds_id, sy, sx, ky, kx, v. y and x count from 1, ch, sy, sx,
ky and kx from 0. ds_id is the file's name.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of values that one partition reads by default.
BLOCK = 32 << 20
#: Values of one batch of rows.
BATCH = 1 << 18
RASTER = "ds_id string, y int, x int, v double"
CUBE = "ds_id string, y int, x int, ch int, v double"
SCAN = "ds_id string, sy int, sx int, ky int, kx int, v double"


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int
    layout: dict = field(default_factory=dict)


class BlockReader(DataSourceReader):
    """Reads files by blocks of rows. A format says what a file's rows are and decodes some of them."""

    def __init__(self, source: BlockSource):
        self.source, self.bounds = source, (-(1 << 60), 1 << 60)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        lo, hi = self.bounds
        for f in filters:
            own = getattr(f, "attribute", None) == (self.source.row,)
            if own and isinstance(f, EqualTo):
                lo, hi = max(lo, f.value), min(hi, f.value)
            elif own and isinstance(f, GreaterThan):
                lo = max(lo, f.value + 1)
            elif own and isinstance(f, GreaterThanOrEqual):
                lo = max(lo, f.value)
            elif own and isinstance(f, LessThan):
                hi = min(hi, f.value - 1)
            elif own and isinstance(f, LessThanOrEqual):
                hi = min(hi, f.value)
            yield f  # bounds only leave out blocks and rows; Spark filters again
        self.bounds = (lo, hi)

    def partitions(self) -> list[Rows]:
        out, options = [], self.source.options
        for path in paths_of(options):
            layout = self.source.layout(path)
            base = self.source.base
            lo, hi = max(0, self.bounds[0] - base), min(layout["rows"] - 1, self.bounds[1] - base)
            step = max(1, int(options.get("blockbytes", BLOCK)) // max(1, layout["row_bytes"]))
            out += [Rows(path, a, min(hi, a + step - 1), layout) for a in range(lo, hi + 1, step)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        values = max(1, part.layout["row_values"])
        step = max(1, BATCH // values)
        for a in range(part.first, part.last + 1, step):
            yield self.source.decode(part.path, part.layout, a, min(part.last, a + step - 1))


class BlockSource(DataSource):
    row, base, columns = "y", 1, RASTER

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> BlockReader:
        return BlockReader(self)

    def layout(self, path: str) -> dict:
        """rows, row_values, row_bytes and what decode() needs."""
        raise NotImplementedError

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        """Rows first to last, counted from 0."""
        raise NotImplementedError


def paths_of(options: dict) -> list[str]:
    """Files of a path, which may be a folder or a pattern; a path without files raises."""
    path = (options.get("path") or "").removeprefix("file://")
    found = sorted(p for p in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p))
    if not found:
        raise FileNotFoundError(path)
    return found


def values_at(path: str, dtype: np.dtype, offset: int, n: int) -> np.ndarray:
    """n values of a file from a byte on; those beyond its end are 0."""
    with open(path, "rb") as f:
        f.seek(offset)
        got = np.frombuffer(f.read(n * dtype.itemsize)[: n * dtype.itemsize], np.uint8)
    whole = got[: len(got) // dtype.itemsize * dtype.itemsize].view(dtype)
    return np.concatenate([whole, np.zeros(n - len(whole), dtype)]) if len(whole) < n else whole


def batch(path: str, columns: dict[str, np.ndarray], v: np.ndarray) -> pa.RecordBatch:
    name = pa.array([os.path.basename(path)] * len(v), pa.string())
    return pa.RecordBatch.from_arrays([name, *[pa.array(c.astype(np.int32)) for c in columns.values()], pa.array(v.astype(np.float64))], names=["ds_id", *columns, "v"])


def raster_batch(path: str, v: np.ndarray, first: int) -> pa.RecordBatch:
    """Rows of a raster (rows x columns); first counts from 0."""
    y, x = np.indices(v.shape)
    return batch(path, {"y": y.ravel() + first + 1, "x": x.ravel() + 1}, v.ravel())


def cube_batch(path: str, v: np.ndarray, first: int) -> pa.RecordBatch:
    """Rows of a cube (rows x columns x channels)."""
    y, x, ch = np.indices(v.shape)
    return batch(path, {"y": y.ravel() + first + 1, "x": x.ravel() + 1, "ch": ch.ravel()}, v.ravel())


class Mrc(BlockSource):
    """Sections of a map, one below the other: row y of section s (from 0) is row s * height + y."""

    MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def layout(self, path: str) -> dict:
        with open(path, "rb") as f:
            head = f.read(1024)
        if len(head) < 1024:
            raise ValueError(f"{path} is shorter than its header")
        order = ">" if head[212:214] == b"\x11\x11" else "<"
        nx, ny, nz, mode = (int(v) for v in np.frombuffer(head, f"{order}i4", 4))
        extra = max(0, int(np.frombuffer(head, f"{order}i4", 1, 92)[0]))
        if nx <= 0 or ny <= 0 or mode not in self.MODES:
            raise ValueError(f"{path}: {nx} x {ny} values of mode {mode} can't be read")
        kind = order + self.MODES[mode]
        sections = max(1, nz) if self.options.get("sections", "first") == "all" else 1
        return {"rows": ny * sections, "row_values": nx, "row_bytes": nx * np.dtype(kind).itemsize, "kind": kind, "start": 1024 + extra}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        kind, w = np.dtype(layout["kind"]), layout["row_values"]
        v = values_at(path, kind, layout["start"] + first * layout["row_bytes"], (last - first + 1) * w)
        return raster_batch(path, v.reshape(-1, w), first)


class Raw(Mrc):
    """Plain values: options width, height, bits (8, 16 or 32), order (little or big), header (bytes before them)."""

    @classmethod
    def name(cls) -> str:
        return "rawraster"

    def layout(self, path: str) -> dict:
        o = self.options
        kind = np.dtype(("<" if o.get("order", "little") == "little" else ">") + {8: "u1", 16: "u2", 32: "f4"}[int(o.get("bits", 16))])
        w, h, start = int(o["width"]), int(o["height"]), int(o.get("header", 0))
        if w <= 0 or h <= 0 or os.path.getsize(path) < start + w * h * kind.itemsize:
            raise ValueError(f"{path} holds no {w} x {h} values of {kind}")
        return {"rows": h, "row_values": w, "row_bytes": w * kind.itemsize, "kind": kind.str, "start": start}


def rpl_header(path: str) -> dict[str, str]:
    """Keys and values of a text header; lines that begin with ; or # are comments."""
    out: dict[str, str] = {}
    with open(path, encoding="latin-1") as f:
        for line in f:
            words = line.split(None, 1)
            if words and words[0][0] not in ";#" and [w.strip().lower() for w in words] != ["key", "value"]:
                out[words[0].lower()] = words[1].strip() if len(words) > 1 else ""
    if not out:
        raise ValueError(f"{path} has no keys")
    return out


class Rpl(BlockSource):
    """A cube of height x width x depth; the values are beside the header, with the ending .raw in any case."""

    columns = CUBE
    KINDS = {"signed": "i", "unsigned": "u", "float": "f"}
    ORDERS = {"big-endian": ">", "big": ">", "little-endian": "<", "little": "<", "dont-care": "=", "dont care": "=", "": "="}

    @classmethod
    def name(cls) -> str:
        return "rpl"

    def layout(self, path: str) -> dict:
        h = rpl_header(path)
        number = lambda k, d: int(float(h[k])) if h.get(k) else d
        try:
            kind = np.dtype(self.ORDERS[h.get("byte-order", "dont-care").lower()] + self.KINDS[h.get("data-type", "signed").lower()] + str(number("data-length", 1)))
        except (KeyError, TypeError) as e:
            raise ValueError(f"{path}: values of this type can't be read") from e
        w, rows, depth = number("width", 1), number("height", 1), number("depth", 1)
        beside = [p for p in glob.glob(glob.escape(os.path.splitext(path)[0]) + ".*") if p.lower().endswith(".raw")]
        if min(w, rows, depth) <= 0 or not beside:
            raise ValueError(f"{path}: no values of {w} x {rows} x {depth}")
        data = min(beside)
        if os.path.getsize(data) < number("offset", 0) + w * rows * depth * kind.itemsize:
            raise ValueError(f"{data} is too short for {w} x {rows} x {depth}")
        return {"rows": rows, "row_values": w * depth, "row_bytes": w * depth * kind.itemsize, "kind": kind.str, "start": number("offset", 0), "width": w, "depth": depth, "data": data, "planes": h.get("record-by", "").lower() == "image"}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        kind, w, d, n = np.dtype(layout["kind"]), layout["width"], layout["depth"], last - first + 1
        if layout["planes"]:  # a plane for each channel
            plane = layout["rows"] * w * kind.itemsize
            v = np.stack([values_at(layout["data"], kind, layout["start"] + c * plane + first * w * kind.itemsize, n * w).reshape(n, w) for c in range(d)], 2)
        else:
            v = values_at(layout["data"], kind, layout["start"] + first * layout["row_bytes"], n * w * d).reshape(n, w, d)
        return cube_batch(path, v, first)


class Ser(BlockSource):
    """Series of spectra as a cube (by its scan, one row where the scan is unknown); of images the first, with channel 0."""

    columns = CUBE
    KINDS = {1: "u1", 2: "u2", 3: "u4", 4: "i1", 5: "i2", 6: "i4", 7: "f4", 8: "f8"}
    IMAGES, SPECTRA = 0x4122, 0x4120

    @classmethod
    def name(cls) -> str:
        return "ser"

    def layout(self, path: str) -> dict:
        with open(path, "rb") as f:
            def number(at: int, size: int) -> int:
                f.seek(at)
                return int.from_bytes(f.read(size), "little")

            if number(0, 2) != 0x4949 or number(2, 2) != 0x0197:
                raise ValueError(f"{path} is no such series")
            what, n, wide = number(6, 4), number(18, 4), 8 if number(4, 2) >= 0x0220 else 4
            array, dims, at = number(22, wide), [], 22 + wide + 4
            for _ in range(number(22 + wide, 4)):
                dims.append(number(at, 4))
                at += 24
                for _ in range(2):  # description and unit
                    at += 4 + number(at, 4)
            if n < 1 or what not in (self.IMAGES, self.SPECTRA):
                raise ValueError(f"{path} holds no images or spectra")
            places = [number(array + i * wide, wide) for i in range(n)]
            head = places[0] + (40 if what == self.IMAGES else 20)
            code = number(head, 2)
            if code not in self.KINDS:
                raise ValueError(f"{path}: values of type {code} can't be read")
            kind = np.dtype("<" + self.KINDS[code])
            if what == self.IMAGES:
                w, h = number(head + 2, 4), number(head + 6, 4)
                return {"rows": h, "row_values": w, "row_bytes": w * kind.itemsize, "kind": kind.str, "image": head + 10}
            length = number(head + 2, 4)
        dims = [d for d in dims if d > 0]
        rows, cols = (dims[0], dims[1]) if len(dims) >= 2 and dims[0] * dims[1] == n else (1, n)
        return {"rows": rows, "row_values": cols * length, "row_bytes": cols * length * kind.itemsize, "kind": kind.str, "places": [p + 26 for p in places], "cols": cols, "length": length}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        kind = np.dtype(layout["kind"])
        if "image" in layout:
            w = layout["row_values"]
            return cube_batch(path, values_at(path, kind, layout["image"] + first * layout["row_bytes"], (last - first + 1) * w).reshape(-1, w, 1), first)
        cols, length = layout["cols"], layout["length"]
        some = layout["places"][first * cols : (last + 1) * cols]
        v = np.stack([values_at(path, kind, p, length) for p in some]).reshape(-1, cols, length)
        return cube_batch(path, v, first)


class Mib(BlockSource):
    """Frames of a pixel detector in raw order (eight values to a word, back to front), of one chip or two by two.

    Options: rows, cols of the scan (one row of all frames by default). Chips of the lower row stand on their heads.
    """

    row, base, columns = "sy", 0, SCAN

    @classmethod
    def name(cls) -> str:
        return "mib"

    def layout(self, path: str) -> dict:
        with open(path, "rb") as f:
            words = f.read(256).decode("ascii", "replace").split(",")
        try:
            head, chips, w, h = (int(v) for v in words[2:6])
        except ValueError as e:
            raise ValueError(f"{path}: its header can't be read") from e
        if words[0] != "MQ1" or head <= 0 or w <= 0 or h <= 0 or len(words) < 8:
            raise ValueError(f"{path} is no file of frames")
        if words[6].strip() != "R64" or chips not in (1, 4) or chips == 4 and words[7].strip() != "2x2" or w % 8 or w % chips:
            raise ValueError(f"{path}: frames of {words[6]}, {chips} chips {words[7]} can't be read")
        frames = os.path.getsize(path) // (head + w * h)
        rows = int(self.options.get("rows", 1))
        cols = int(self.options.get("cols", frames // max(1, rows)))
        if rows * cols > frames or rows < 1 or cols < 1:
            raise ValueError(f"{path} holds {frames} frames, not {rows} x {cols}")
        return {"rows": rows, "row_values": cols * w * h, "row_bytes": cols * (head + w * h), "head": head, "cols": cols, "w": w, "h": h, "chips": chips}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        head, cols, w, h = (layout[k] for k in ("head", "cols", "w", "h"))
        n = (last - first + 1) * cols
        raw = values_at(path, np.dtype("u1"), first * cols * (head + w * h), n * (head + w * h)).reshape(n, head + w * h)[:, head:]
        f = raw.reshape(n, h, w // 8, 8)[..., ::-1].reshape(n, h, w)
        if layout["chips"] == 4:
            a, b, c, d = np.split(f, 4, axis=2)
            f = np.concatenate([np.concatenate([a, b], 2), np.concatenate([c[:, ::-1, ::-1], d[:, ::-1, ::-1]], 2)], 1)
        k, ky, kx = np.indices(f.shape)
        k = k.ravel() + first * cols
        return batch(path, {"sy": k // cols, "sx": k % cols, "ky": ky.ravel(), "kx": kx.ravel()}, f.ravel())


class Dm(BlockSource):
    """The largest image of a file of nested tags (versions 3 and 4): channels are planes of it, an image has channel 0."""

    columns = CUBE
    #: Bytes of the plain kinds of values by their codes, and the kinds of image data.
    SIZES = {2: 2, 3: 4, 4: 2, 5: 4, 6: 4, 7: 8, 8: 1, 9: 1, 10: 1, 11: 8, 12: 8}
    KINDS = {1: "i2", 2: "f4", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8"}
    PLAIN = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "u1", 9: "i1", 10: "u1", 11: "i8", 12: "u8"}

    @classmethod
    def name(cls) -> str:
        return "dm"

    def tags(self, path: str) -> tuple[dict[str, object], str]:
        """Values by path of names (unnamed tags by their number); arrays of numbers as (place, kind, length). And the byte order."""
        out: dict[str, object] = {}
        with open(path, "rb") as f:
            whole = os.fstat(f.fileno()).st_size

            def exactly(n: int) -> bytes:
                got = f.read(n)
                if len(got) < n:
                    raise ValueError(f"{path} ends within its tags")
                return got

            def big(n: int) -> int:
                return int.from_bytes(exactly(n), "big")

            version = big(4)
            if version not in (3, 4):
                raise ValueError(f"{path} is no file of version 3 or 4")
            wide = 8 if version == 4 else 4
            big(wide)
            order = "<" if big(4) == 1 else ">"

            def plain(code: int) -> object:
                return np.frombuffer(exactly(self.SIZES[code]), order + self.PLAIN[code])[0].item()

            def value(info: list[int]) -> object:
                if info[0] in self.SIZES:
                    return plain(info[0])
                if info[0] == 18:
                    return exactly(info[1]).decode("utf-16-le", "replace")
                if info[0] == 15:
                    return [plain(c) for c in info[4::2]]
                if info[0] == 20 and info[1] in self.SIZES:
                    place, size = f.tell(), info[2] * self.SIZES[info[1]]
                    f.seek(size, 1)
                    if f.tell() > whole:
                        raise ValueError(f"{path} ends within its values")
                    return place, order + self.PLAIN[info[1]], info[2]
                if info[0] == 20 and info[1] == 15:
                    f.seek(sum(self.SIZES[c] for c in info[5:-1:2]) * info[-1], 1)
                    return None
                raise ValueError(f"{path} has a tag of kind {info[0]}")

            def group(above: str) -> None:
                exactly(2)
                for i in range(big(wide)):
                    kind, name = big(1), exactly(big(2)).decode("latin-1")
                    here = f"{above}/{name or i}"
                    if version == 4:
                        big(8)
                    if kind == 20:
                        group(here)
                    elif kind == 21:
                        if exactly(4) != b"%%%%":
                            raise ValueError(f"{path}: tag {here} has no mark")
                        out[here] = value([big(wide) for _ in range(big(wide))])
                    else:
                        raise ValueError(f"{path}: tag {here} is of kind {kind}")

            group("")
        return out, order

    def layout(self, path: str) -> dict:
        tags, order = self.tags(path)
        best = None
        for at in [k for k in tags if k.startswith("/ImageList/") and k.endswith("/ImageData/Data")]:
            base = at.removesuffix("/Data")
            place, _, n = tags[at]
            dims = [int(tags[f"{base}/Dimensions/{i}"]) for i in range(9) if f"{base}/Dimensions/{i}" in tags]
            if int(tags.get(f"{base}/DataType", 0)) in self.KINDS and 1 <= len(dims) <= 3 and (best is None or n > best[1]):
                best = (place, n, dims, np.dtype(order + self.KINDS[int(tags[f"{base}/DataType"])]))
        if best is None:
            raise ValueError(f"{path} holds no image, spectrum or cube that can be read")
        place, _, dims, kind = best
        if len(dims) == 1:  # a spectrum: one pixel
            dims = [1, 1, dims[0]]
        w, h, d = [*dims, 1][:3] if len(dims) == 2 else dims
        return {"rows": h, "row_values": w * d, "row_bytes": w * d * kind.itemsize, "kind": kind.str, "start": place, "width": w, "depth": d}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        kind, w, d, n = np.dtype(layout["kind"]), layout["width"], layout["depth"], last - first + 1
        plane = layout["rows"] * w * kind.itemsize
        v = np.stack([values_at(path, kind, layout["start"] + c * plane + first * w * kind.itemsize, n * w).reshape(n, w) for c in range(d)], 2)
        return cube_batch(path, v, first)


class Tif(BlockSource):
    """The first image of a TIFF file without compression, in strips; samples of a pixel are averaged."""

    FIELD = {1: "u1", 3: "u2", 4: "u4", 16: "u8"}

    @classmethod
    def name(cls) -> str:
        return "tif"

    def layout(self, path: str) -> dict:
        with open(path, "rb") as f:
            head = f.read(8)
            order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if order is None or np.frombuffer(head, order + "u2", 1, 2)[0] != 42:
                raise ValueError(f"{path} is no TIFF file")
            f.seek(int(np.frombuffer(head, order + "u4", 1, 4)[0]))
            n = int(np.frombuffer(f.read(2), order + "u2")[0])
            fields: dict[int, list[int]] = {}
            for entry in np.frombuffer(f.read(12 * n), np.uint8).reshape(-1, 12):
                raw = entry.tobytes()
                tag, kind = (int(v) for v in np.frombuffer(raw, order + "u2", 2))
                count = int(np.frombuffer(raw, order + "u4", 1, 4)[0])
                if kind in self.FIELD:
                    dtype = np.dtype(order + self.FIELD[kind])
                    if count * dtype.itemsize > 4:
                        f.seek(int(np.frombuffer(raw, order + "u4", 1, 8)[0]))
                        data = f.read(count * dtype.itemsize)
                    else:
                        data = raw[8:]
                    fields[tag] = [int(v) for v in np.frombuffer(data, dtype, count)]
        one = lambda tag, d: fields.get(tag, [d])[0]
        w, h, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(339, 1))
        if w <= 0 or h <= 0 or one(259, 1) != 1 or kind is None or bits not in (8, 16, 32, 64) or one(284, 1) != 1 or 273 not in fields:
            raise ValueError(f"{path}: {w} x {h} pixels of {bits} bits in this form can't be read")
        dtype = np.dtype(f"{order}{kind}{bits // 8}")
        return {"rows": h, "row_values": w * samples, "row_bytes": w * samples * dtype.itemsize, "kind": dtype.str, "strips": fields[273], "per": min(h, one(278, h)), "samples": samples}

    def decode(self, path: str, layout: dict, first: int, last: int) -> pa.RecordBatch:
        kind, per, rows = np.dtype(layout["kind"]), layout["per"], []
        for s in range(first // per, last // per + 1):
            a, b = max(first, s * per), min(last, s * per + per - 1)
            rows.append(values_at(path, kind, layout["strips"][s] + (a - s * per) * layout["row_bytes"], (b - a + 1) * layout["row_values"]))
        v = np.concatenate(rows).reshape(last - first + 1, -1, layout["samples"])
        return raster_batch(path, v.astype(np.float64).mean(2), first)


class PtsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Rows]:
        out, step = [], max(2, int(self.options.get("blockbytes", BLOCK)) // 2 * 2)
        for path in paths_of(self.options):
            start, end = int(self.options.get("start", 0)), min(os.path.getsize(path), int(self.options.get("end", 1 << 62)))
            out += [Rows(path, a, min(end, a + step), {"part": i}) for i, a in enumerate(range(start, end - 1, step))]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        words = values_at(part.path, np.dtype("<u2"), part.first, (part.last - part.first) // 2)
        kind, load = words >> 12, words & 0x0FFF
        at = np.arange(len(words))
        last = lambda k: np.maximum.accumulate(np.where(kind == k, at, -1)) if len(words) else at
        value = lambda src: np.where(src >= 0, load[np.maximum(src, 0)].astype(np.int64) >> 3, -1) if len(words) else at
        y, x, hit = value(last(9)), value(last(8)), kind == 11
        code = ((y[hit] + 1) << 24) | ((x[hit] + 1) << 12) | load[hit]
        keys, n = np.unique(code, return_counts=True)
        ends = [int(y[-1]), int(x[-1])] if len(words) else [-1, -1]
        col = lambda v, end: pa.array(np.append(v, end).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(part.path)] * (len(keys) + 1)), col(np.full(len(keys), part.layout["part"]), part.layout["part"]), col((keys >> 24) - 1, ends[0]), col(((keys >> 12) & 0xFFF) - 1, ends[1]), col(keys & 0xFFF, -1), pa.array(np.append(n, 0).astype(np.int64))], names=["ds_id", "part", "y", "x", "ch", "n"])


class Pts(DataSource):
    """Events counted by place and channel within each split of a file, and a row (n = 0) of the place at its end; -1: not known yet."""

    @classmethod
    def name(cls) -> str:
        return "pts"

    def schema(self) -> str:
        return "ds_id string, part int, y int, x int, ch int, n long"

    def reader(self, schema) -> PtsReader:
        return PtsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, filters on rows included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Mrc, Raw, Rpl, Ser, Mib, Dm, Tif, Pts):
        spark.dataSource.register(source)


def read_binary(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Rows of all files of a path by one of the formats (mrc, rawraster, rpl, ser, mib, dm, tif); options as its class has them, and
    blockbytes, the bytes of a partition.
    """
    register(spark)
    return spark.read.format(kind).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_pts(spark: SparkSession, path: str, width: int, height: int, start: int = 0, end: int | None = None, n_channels: int = 4096, **options) -> DataFrame:
    """Counts of the events of maps: ds_id, y, x (from 1), ch, v. Events outside the map or beyond the channels don't count.

    A file is read in splits. An event before a split's first row or column mark belongs to the last mark of the splits
    before it (0 before any), which one window over a row for each split carries on.
    """
    register(spark)
    given = {"path": path, "start": start, **({"end": end} if end is not None else {}), **options}
    t = spark.read.format("pts").options(**{k: str(v) for k, v in given.items()}).load()
    before = W.partitionBy("ds_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    known = lambda c: F.coalesce(F.last(F.when(F.col(c) >= 0, F.col(c)), ignorenulls=True).over(before), F.lit(0))
    carried = t.where("n = 0").select("ds_id", "part", known("y").alias("y0"), known("x").alias("x0"))
    at = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col(f"{c}0"))
    hits = t.where("n > 0").join(carried, ["ds_id", "part"]).select("ds_id", at("y").alias("y"), at("x").alias("x"), "ch", "n")
    hits = hits.where((F.col("y") < height) & (F.col("x") < width) & (F.col("ch") < n_channels))
    return hits.groupBy("ds_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), "ch").agg(F.sum("n").cast("double").alias("v"))
