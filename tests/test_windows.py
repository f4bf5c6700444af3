"""Windows of raster files: only the blocks asked for are read; variable-width codes."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from thalweg.operators import grid as G
from thalweg.sources import geotiff as R
from thalweg.sources import windows as W


def pack_codes(data):
    """The straightforward coder, as other programs write blocks."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    n = 258
    put(256, 9)
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word], width)
        table[word + bytes([b])] = n
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
        word = bytes([b])
        if n == 4094:
            put(table[word], width)
            put(256, width)
            table, width, word, n = {bytes([k]): k for k in range(256)}, 9, b"", 258
    if word:
        put(table[word], width)
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
    put(257, min(width, 12))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaaaa", bytes(range(256)) * 3, random.Random(1).randbytes(30_000), bytes(random.Random(2).choices(b"ab", k=200_000))])
def test_codes_round_trip(data):
    assert R.unpack_codes(pack_codes(data)) == data


def test_broken_codes():
    with pytest.raises(ValueError, match="clear code"):
        R.unpack_codes(b"\x00\x00\x00")


def lzw_strips(cells, rows):
    """A striped file of 16-bit cells with differencing."""
    diff = cells.astype("<u2").copy()
    diff[:, 1:] -= cells[:, :-1].astype("<u2")
    strips = [pack_codes(diff[k : k + rows].tobytes()) for k in range(0, len(cells), rows)]
    starts = [8 + sum(map(len, strips[:k])) for k in range(len(strips))]
    tags = [(256, 4, [cells.shape[1]]), (257, 4, [cells.shape[0]]), (258, 3, [16]), (259, 3, [5]), (273, 4, starts), (277, 3, [1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [2])]
    at = 8 + sum(map(len, strips))
    at += at % 2
    after, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in tags:
        raw = struct.pack(f"<{len(values)}{'H' if code == 3 else 'I'}", *values)
        entries += struct.pack("<HHI", tag, code, len(values)) + (struct.pack("<I", after + len(extra)) if len(raw) > 4 else raw.ljust(4, b"\0"))
        extra += raw if len(raw) > 4 else b""
    return (struct.pack("<2sHI", b"II", 42, at) + b"".join(strips)).ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def test_strips_of_codes(spark, tmp_path):
    cells = np.random.default_rng(4).integers(0, 500, (23, 40))
    (tmp_path / "a.tif").write_bytes(lzw_strips(cells, 5))
    got = {(r["cell_row"], r["cell_col"]): r["value"] for r in R.read_raster(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(r, c): float(cells[r, c]) for r in range(23) for c in range(40)}


@pytest.fixture(scope="module")
def tiled(tmp_path_factory):
    cells = np.random.default_rng(5).integers(0, 90, (300, 500)).astype("i4")
    path = tmp_path_factory.mktemp("raster") / "b.tif"
    path.write_bytes(R.image(cells, 10.0, 50.0, 0.1, 0.1, 7.0, "low", 64))
    return str(path), cells


def test_blocks_are_pruned(tiled):
    path, _ = tiled
    blocks = lambda reader: sum(len(r.blocks) for r in reader.partitions())
    assert blocks(W.WindowReader({"path": path})) == 5 * 8
    reader = W.WindowReader({"path": path})
    filters = [GreaterThanOrEqual(("cell_row",), 64), LessThan(("cell_row",), 100), EqualTo(("cell_col",), 70), EqualTo(("value",), 1.0)]
    assert list(reader.pushFilters(filters)) == filters  # Spark filters the cells again
    assert [b[:2] for r in reader.partitions() for b in r.blocks] == [(64, 64)]
    reader = W.WindowReader({"path": path})
    list(reader.pushFilters([In(("cell_row",), (3, 70))]))
    assert blocks(reader) == 2 * 8
    assert len(W.WindowReader({"path": path, "runBytes": 1}).partitions()) == 40


def test_a_window_reads_only_the_blocks_it_touches(spark, tiled, tmp_path):
    path, cells = tiled
    data = bytearray(open(path, "rb").read())
    info = R.describe(bytes(data))
    for _, row, col, at, size in R.places(info):
        if (row, col) not in ((64, 128), (64, 192), (128, 128), (128, 192)):
            data[at : at + size] = b"\xff" * size  # nothing that could be decoded
    (tmp_path / "c.tif").write_bytes(data)
    grid = G.Grid(10.0, 50.0, 0.1, 0.1)
    box = (10 + 13.0, 50 - 15.0, 10 + 25.0, 50 - 7.0)
    got = {(r["cell_row"], r["cell_col"]): r["value"] for r in W.read_window(spark, str(tmp_path), grid, *box).collect()}
    want = {(r, c): None if cells[r, c] == 7 else float(cells[r, c]) for r in range(300) for c in range(500) if box[0] <= 10 + (c + 0.5) * 0.1 <= box[2] and box[1] <= 50 - (r + 0.5) * 0.1 <= box[3]}
    assert got == want and len(want) > 5000
    with pytest.raises(Exception, match="decompress"):
        spark.read.format("raster_blocks").option("path", str(tmp_path)).load().count()
    assert W.read_window(spark, path, grid, 100.0, 0.0, 101.0, 1.0).collect() == []


def test_images_are_rows_of_a_dataset(spark, tmp_path):
    grid = G.Grid(-180.0, 90.0, 0.1, 0.1)
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (130, 7, 6.0), (9, 260, -3.0)], "cell_row long, cell_col long, value double")
    kept = R.write_images(cells, str(tmp_path / "d"), grid, type="Int16", nodata=-1.0, size=128)
    assert sorted(r["cells"] for r in kept.collect()) == [1, 1, 1]
    assert sorted(map(tuple, R.read_raster(spark, kept, grid, keep_no_data=False).collect())) == [(0, 0, 5.0), (9, 260, -3.0), (130, 7, 6.0)]
    assert {r["NoData"] for r in R.report_no_data(spark, kept).collect()} == {-1.0}
