"""Workbooks of the old binary format, composed here record by record."""

import struct

import pytest

from millrace.sources import files, legacy


def record(kind, *parts):
    parts = parts or (b"",)
    return b"".join(struct.pack("<HH", kind if k == 0 else legacy.CONTINUE, len(p)) + p for k, p in enumerate(parts))


def text(value, size="<H", wide=None):
    wide = any(ord(c) > 255 for c in value) if wide is None else wide
    return struct.pack(size, len(value)) + bytes([int(wide)]) + value.encode("utf-16-le" if wide else "latin-1")


def rk(value):
    return (int(value) << 2 & 0xFFFFFFFF) | 2


def book(cells, strings, formats=(), styles=(0,), extra=b"", from_1904=False):
    """The stream of a workbook with the sheets Data and Empty; ``strings`` are the parts of the table of strings."""
    bof = record(legacy.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    head = bof + extra + record(legacy.EPOCH, struct.pack("<H", from_1904)) + b"".join(record(legacy.FORMAT, struct.pack("<H", k) + text(f)) for k, f in formats)
    head += b"".join(record(legacy.STYLE, struct.pack("<HH16x", 0, k)) for k in styles) + record(legacy.STRINGS, *strings)
    names = [text("Data", "<B"), text("Λeer", "<B")]
    size = len(head) + sum(len(record(legacy.SHEET, b"\0" * 6 + n)) for n in names) + 4
    first = bof + b"".join(cells) + record(legacy.EOF)
    places = [size, size + len(first)]
    sheets = b"".join(record(legacy.SHEET, struct.pack("<IBB", p, 0, 0) + n) for p, n in zip(places, names))
    return head + sheets + record(legacy.EOF) + first + bof + record(legacy.EOF)


def compound(stream, name="Workbook"):
    """A compound file with one stream, in small sectors if it is short."""
    small = len(stream) < 4096
    inner = stream + b"\0" * (-len(stream) % 64)
    body = inner + b"\0" * (-len(inner) % 512)
    n = len(body) // 512
    table = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(n)]
    table[-1] = 0xFFFFFFFE
    if small:
        table.append(0xFFFFFFFE)
    fats = -(-len(table) // 128)
    assert fats == 1 or not small
    shift = fats - 1  # further sectors of the table lie at the end
    table += [0xFFFFFFFD] * shift
    table += [0xFFFFFFFF] * (-len(table) % 128)
    entry = lambda label, kind, start, size: (label.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I36xII", 2 * len(label) + 2, kind, 1, *[0xFFFFFFFF] * 3, start, size)).ljust(128, b"\0")
    folder = entry("Root Entry", 5, 2 if small else 0xFFFFFFFE, len(inner) if small else 0) + entry(name, 2, 0 if small else 2, len(stream))
    sectors = [struct.pack("<128I", *table[:128]), folder.ljust(512, b"\0"), body]
    if small:
        m = len(inner) // 64
        sectors.append(struct.pack("<128I", *[*range(1, m), 0xFFFFFFFE], *[0xFFFFFFFF] * (128 - m)))
    sectors += [struct.pack("<128I", *table[128 * k : 128 * (k + 1)]) for k in range(1, fats)]
    listed = [0, *range(2 + n, 2 + n + shift)]
    head = legacy.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH6xII", 0x3E, 3, 0xFFFE, 9, 6, 0, fats) + struct.pack("<I4xIIIII", 1, 4096, 2 + n if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *listed, *[0xFFFFFFFF] * (109 - len(listed))) + b"".join(sectors)


def cell(kind, row, col, style, body):
    return record(kind, struct.pack("<HHH", row, col, style) + body)


def table_of(*values):
    return struct.pack("<II", len(values), len(values)) + b"".join(text(v) for v in values)


CELLS = [
    *[cell(legacy.LABELSST, 0, c, 0, struct.pack("<I", c)) for c in range(4)],
    cell(legacy.NUMBER, 1, 0, 1, struct.pack("<d", 45292.0)),
    cell(legacy.RK, 1, 1, 0, struct.pack("<I", rk(-7))),
    cell(legacy.RK, 1, 2, 0, struct.pack("<I", rk(1234) | 1)),
    cell(legacy.LABEL, 1, 3, 0, text("naïve Ω")),
    record(legacy.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 2, rk(45293), 0, struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32) + struct.pack("<H", 1)),
    cell(legacy.BOOLERR, 2, 2, 0, b"\x01\x00"),
    cell(legacy.BOOLERR, 2, 3, 0, b"\x07\x01"),
    cell(legacy.FORMULA, 3, 0, 0, struct.pack("<d", 2.25) + b"\0" * 8),
    cell(legacy.FORMULA, 3, 1, 0, b"\x00\0\0\0\0\0\xff\xff" + b"\0" * 8), record(legacy.STRING, text("made")),
    cell(legacy.FORMULA, 3, 2, 0, b"\x01\0\x01\0\0\0\xff\xff" + b"\0" * 8),
    cell(legacy.FORMULA, 3, 3, 0, b"\x03\0\0\0\0\0\xff\xff" + b"\0" * 8),
]
WANT = [["day", "n", "cents", "Ωtext"], ["2024-01-01", "-7", "12.34", "naïve Ω"], ["2024-01-02", "0.5", "TRUE", None], ["2.25", "made", "TRUE", None]]
FORMATS, STYLES = [(164, "0.00"), (165, "dd/mm/yyyy")], (0, 14, 165, 164)


def sheets(data):
    return list(legacy.sheets_of(data, files.dated_formats, files.serial_date))


@pytest.mark.parametrize("padding", [0, 5000, 90_000])
def test_cells_of_all_kinds(padding):
    extra = b"".join(record(0x99, b"\0" * 500) for _ in range(padding // 500))
    data = compound(book(CELLS, [table_of("day", "n", "cents", "Ωtext")], FORMATS, STYLES, extra))
    assert sheets(data) == [("Data", WANT), ("Λeer", [])]


def test_strings_that_go_on_in_the_next_record():
    rich = struct.pack("<H", 4) + bytes([8]) + struct.pack("<H", 1) + b"bold" + b"\0" * 4
    values = struct.pack("<II", 3, 3) + text("day") + rich
    cut = struct.pack("<H", 6) + b"\x00" + b"abc"  # three letters here, three wide ones in the next part
    cells = [cell(legacy.LABELSST, 0, c, 0, struct.pack("<I", c)) for c in range(3)]
    assert sheets(compound(book(cells, [values + cut, b"\x01" + "déf".encode("utf-16-le")])))[0] == ("Data", [["day", "bold", "abcdéf"]])


def test_workbooks_as_tables(spark, tmp_path):
    (tmp_path / "Old book.xls").write_bytes(compound(book(CELLS, [table_of("day", "n", "cents", "Ωtext")], FORMATS, STYLES)))
    (t,) = files.load_file(spark, str(tmp_path / "Old book.xls"))
    assert t.frame.columns == WANT[0] and sorted(map(tuple, t.frame.collect()), key=str) == sorted(map(tuple, WANT[1:]), key=str)
    locked = compound(book(CELLS, [table_of("a", "b", "c", "d")], extra=record(legacy.FILEPASS, b"\0" * 6)))
    for name, data in {"bad.xls": b"text", "cut.xls": compound(b"\x09\x08")[:700], "locked.xls": locked, "other.xls": compound(b"x" * 100, "Book")}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(files.LoadError):
            files.load_file(spark, str(tmp_path / name))


def test_days_from_1904():
    cells = [cell(legacy.NUMBER, 0, 0, 1, struct.pack("<d", 1.0))]
    assert sheets(compound(book(cells, [table_of()], styles=(0, 14), from_1904=True)))[0][1] == [["1904-01-02"]]
