"""Workbooks of the binary format before 2007 (.xls): a compound file whose stream holds records of cells."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

# Fixed values of the two formats.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, SMALL = 0xFFFFFFFA, 4096
BOF, EOF, CONTINUE, FILEPASS, SHEET, STRINGS, FORMAT, STYLE, EPOCH = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC, 0x41E, 0xE0, 0x22
NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA, STRING = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06, 0x207


class LegacyError(ValueError):
    """A workbook that cannot be read, and why."""


def stream_of(data: bytes, names: tuple[str, ...]) -> bytes | None:
    """The first of the named streams that a compound file has."""
    if data[:8] != SIGNATURE:
        raise LegacyError("Not a compound file.")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    tables, first_dir, cutoff, first_small, _, first_more, more = struct.unpack_from("<II4xIIIII", data, 44)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    listed = list(struct.unpack_from("<109I", data, 76))
    for _ in range(more):  # sectors that list further tables
        part = struct.unpack(f"<{size // 4}I", sector(first_more))
        listed += part[:-1]
        first_more = part[-1]
    table = [n for k in listed[:tables] for n in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(k: int, of: list[int]) -> Iterator[int]:
        for _ in range(len(of) + 1):
            if k >= FREE:
                return
            yield k
            k = of[k] if k < len(of) else FREE
        raise LegacyError("A chain of sectors does not end.")

    whole = lambda k: b"".join(map(sector, chain(k, table)))
    entries = {}
    folder = whole(first_dir)
    for at in range(0, len(folder) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        start, n = struct.unpack_from("<II", folder, at + 116)
        if kind in (2, 5):
            entries["/" if kind == 5 else folder[at : at + max(0, length - 2)].decode("utf-16-le")] = start, n
    found = next((entries[n] for n in names if n in entries), None)
    if found is None:
        return None
    start, n = found
    if n >= cutoff:
        return whole(start)[:n]
    inner = whole(entries["/"][0])
    small_table = [x for k in chain(first_small, table) for x in struct.unpack(f"<{size // 4}I", sector(k))]
    return b"".join(inner[k * small : (k + 1) * small] for k in chain(start, small_table))[:n]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of each record; what continues it are further parts."""
    kind, parts = -1, []
    while at + 4 <= len(stream):
        k, n = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if k == CONTINUE and kind >= 0:
            parts.append(body)
            continue
        if kind >= 0:
            yield kind, parts
        kind, parts = k, [body]
    if kind >= 0:
        yield kind, parts


class _Reader:
    """Reads texts that may break off in one part of a record and go on in the next."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                if self.k >= len(self.parts):
                    raise LegacyError("A record ends too early.")
            piece = self.parts[self.k][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def text(self, size: str = "<H") -> str:
        (count,) = struct.unpack(size, self.take(struct.calcsize(size)))
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while count:
            if self.at >= len(self.parts[self.k]):  # the next part says anew how wide its letters are
                self.k, self.at = self.k + 1, 0
                flags = self.take(1)[0]
            width = 2 if flags & 1 else 1
            n = min(count, (len(self.parts[self.k]) - self.at) // width)
            if n == 0:
                raise LegacyError("A letter is cut.")
            out.append(self.take(n * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            count -= n
        self.take(4 * runs + extra)
        return "".join(out)


def _packed(value: int) -> float:
    number = (value - (1 << 32) if value & 0x80000000 else value) >> 2 if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def sheets_of(data: bytes, dated: Callable[[dict[int, str]], set[int]], date: Callable[[float, bool], str | None]) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(name, rows of texts) of each sheet of cells.

    ``dated`` tells which number formats show dates, given those that the workbook defines, and ``date`` writes a day number.
    """
    stream = stream_of(data, ("Workbook",))
    if stream is None:
        raise LegacyError("No workbook of the 1997 format or later.")
    sheets, strings, formats, styles, from_1904 = [], [], {}, [], False
    for kind, parts in records(stream):
        body = parts[0]
        if kind == FILEPASS:
            raise LegacyError("The workbook is encrypted.")
        if kind == SHEET and body[5] == 0:
            sheets.append((struct.unpack_from("<I", body)[0], _Reader(parts, 6).text("<B")))
        elif kind == STRINGS:
            reader = _Reader(parts, 8)
            strings = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = _Reader(parts, 2).text()
        elif kind == STYLE:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == EPOCH:
            from_1904 = struct.unpack_from("<H", body)[0] == 1
        elif kind == EOF:
            break
    days = dated(formats)

    def number(value: float, style: int) -> str:
        if style < len(styles) and styles[style] in days and (text := date(value, from_1904)):
            return text
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(float(value))

    for start, name in sheets:
        cells: dict[int, dict[int, str | None]] = {}
        waiting = None
        for kind, parts in records(stream, start):
            body = parts[0]
            if kind == EOF:
                break
            if kind == STRING and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _Reader(parts).text()
                waiting = None
                continue
            if kind not in (NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA):
                continue
            row, col, style = struct.unpack_from("<HHH", body)
            own = cells.setdefault(row, {})
            if kind == NUMBER:
                own[col] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == RK:
                own[col] = number(_packed(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == MULRK:
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    own[col + k] = number(_packed(value), style)
            elif kind == LABELSST:
                own[col] = strings[struct.unpack_from("<I", body, 6)[0]]
            elif kind == LABEL:
                own[col] = _Reader(parts, 6).text()
            elif kind == BOOLERR:
                own[col] = None if body[7] else "TRUE" if body[6] else "FALSE"
            elif body[12:14] != b"\xff\xff":
                own[col] = number(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                waiting = row, col
            else:
                own[col] = ("TRUE" if body[8] else "FALSE") if body[6] == 1 else None
        last = max(cells, default=-1)
        yield name, [[cells[r].get(c) for c in range(max(cells[r], default=-1) + 1)] if r in cells else [] for r in range(last + 1)]
