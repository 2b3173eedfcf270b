"""Array layouts as index expressions: logical coordinates to a position, and back.

All operands are whole columns or numbers that are not negative; ``div`` and ``%`` then agree with floor
division.  Every map is a bijection onto 0..size-1 of the (padded) array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Index = Column | int


def _c(x: Index) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a: Index, b: Index) -> Column:
    return F.floor(_c(a) / _c(b)).cast("long") if not isinstance(b, int) else ((_c(a) - _c(a) % b) / b).cast("long")


def row_major(i: Index, j: Index, columns: int) -> Column:
    return _c(i) * columns + _c(j)


def col_major(i: Index, j: Index, rows: int) -> Column:
    return _c(j) * rows + _c(i)


def from_row_major(pos: Index, columns: int) -> tuple[Column, Column]:
    return div(pos, columns), _c(pos) % columns


def from_col_major(pos: Index, rows: int) -> tuple[Column, Column]:
    return _c(pos) % rows, div(pos, rows)


def padded(n: int, block: int) -> int:
    return -(-n // block) * block


def blocked(i: Index, j: Index, rows: int, columns: int, br: int, bc: int, order: str = "RR") -> Column:
    """Blocks of br x bc; ``order`` says how blocks and the elements inside them run (R rows first, C columns first)."""
    outer = row_major(div(i, br), div(j, bc), -(-columns // bc)) if order[0] == "R" else col_major(div(i, br), div(j, bc), -(-rows // br))
    inner = row_major(_c(i) % br, _c(j) % bc, bc) if order[1] == "R" else col_major(_c(i) % br, _c(j) % bc, br)
    return outer * (br * bc) + inner


def from_blocked(pos: Index, rows: int, columns: int, br: int, bc: int, order: str = "RR") -> tuple[Column, Column]:
    block, inner = div(pos, br * bc), _c(pos) % (br * bc)
    bi, bj = from_row_major(block, -(-columns // bc)) if order[0] == "R" else from_col_major(block, -(-rows // br))
    i, j = from_row_major(inner, bc) if order[1] == "R" else from_col_major(inner, br)
    return bi * br + i, bj * bc + j


def tensor4(i: Index, j: Index, columns: int, br: int, bc: int) -> tuple[Column, Column, Column, Column]:
    """(row block, column block, row, column) of a four-dimensional store."""
    return div(i, br), div(j, bc), _c(i) % br, _c(j) % bc


def from_tensor4(rb: Index, cb: Index, r: Index, c: Index, br: int, bc: int) -> tuple[Column, Column]:
    return _c(rb) * br + _c(r), _c(cb) * bc + _c(c)


def field(variant: int, je: Index, jk: Index, n: int, levels: int) -> Column:
    """Two-dimensional field: variants 1 and 2 run along edges, 3 and 4 along levels."""
    return _c(je) + _c(jk) * n if variant in (1, 2) else _c(jk) + _c(je) * levels


def from_field(variant: int, pos: Index, n: int, levels: int) -> tuple[Column, Column]:
    """(je, jk)."""
    return (_c(pos) % n, div(pos, n)) if variant in (1, 2) else (div(pos, levels), _c(pos) % levels)


def neighbour(variant: int, je: Index, k: Index, n: int, width: int = 2) -> Column:
    """Neighbour index: odd variants keep edges together, even ones an edge's neighbours."""
    return _c(je) + _c(k) * n if variant in (1, 3) else _c(je) * width + _c(k)


def from_neighbour(variant: int, pos: Index, n: int, width: int = 2) -> tuple[Column, Column]:
    """(je, k)."""
    return (_c(pos) % n, div(pos, n)) if variant in (1, 3) else (div(pos, width), _c(pos) % width)


def stencil_blocked(je: Index, jk: Index, block: int, levels: int) -> Column:
    return _c(je) % block + _c(jk) * block + div(je, block) * block * levels


def from_stencil_blocked(pos: Index, block: int, levels: int) -> tuple[Column, Column]:
    """(je, jk)."""
    inner = _c(pos) % (block * levels)
    return div(pos, block * levels) * block + inner % block, div(inner, block)


def tile_levels_first(je: Index, jk: Index, tile: int, levels: int) -> Column:
    return div(je, tile) * tile * levels + _c(je) % tile * levels + _c(jk)


def from_tile_levels_first(pos: Index, tile: int, levels: int) -> tuple[Column, Column]:
    """(je, jk)."""
    inner = _c(pos) % (tile * levels)
    return div(pos, tile * levels) * tile + div(inner, levels), inner % levels


def aosoa(f: Index, je: Index, jk: Index, n: int, fields: int, width: int) -> Column:
    """Groups of ``width`` edges with their fields side by side, level after level."""
    groups = -(-n // width)
    return _c(jk) * (groups * fields * width) + div(je, width) * (fields * width) + _c(f) * width + _c(je) % width


def from_aosoa(pos: Index, n: int, fields: int, width: int) -> tuple[Column, Column, Column]:
    """(field, je, jk)."""
    level = -(-n // width) * fields * width
    inner = _c(pos) % level
    group = inner % (fields * width)
    return div(group, width), div(inner, fields * width) * width + group % width, div(pos, level)


def aosoa_levels_first(f: Index, je: Index, jk: Index, levels: int, fields: int, width: int) -> Column:
    return div(je, width) * (fields * width * levels) + _c(jk) * (fields * width) + _c(f) * width + _c(je) % width


def from_aosoa_levels_first(pos: Index, levels: int, fields: int, width: int) -> tuple[Column, Column, Column]:
    """(field, je, jk)."""
    inner = _c(pos) % (fields * width * levels)
    group = inner % (fields * width)
    return div(group, width), div(pos, fields * width * levels) * width + group % width, div(inner, fields * width)


def vnni(i: Index, j: Index, columns: int, pack: int = 4) -> Column:
    """Groups of ``pack`` rows lie together under each column."""
    return div(i, pack) * (columns * pack) + _c(j) * pack + _c(i) % pack


def from_vnni(pos: Index, columns: int, pack: int = 4) -> tuple[Column, Column]:
    """(i, j)."""
    inner = _c(pos) % (columns * pack)
    return div(pos, columns * pack) * pack + inner % pack, div(inner, pack)


def swizzle(row: Index, column: Index) -> Column:
    """Column of a square power-of-two tile after the exclusive-or that spreads banks."""
    return _c(row).bitwiseXOR(_c(column))


def owner(schedule: str, i: Index, n: int, parts: int, chunk: int = 1) -> Column:
    """The part that owns element i: contiguous blocks, blocks moved on by one, or chunks in turn."""
    block = F.least(div(i, -(-n // parts)), F.lit(parts - 1))
    if schedule == "block":
        return block
    if schedule == "shift1":
        return (block + 1) % parts
    if schedule == "interleave":
        return div(i, max(chunk, 1)) % parts
    raise ValueError(f"no schedule {schedule}")


def linearised(index: Index, block: Index, width: int) -> Column:
    """Zero-based position of a one-based (index, block) pair; invalid pairs become 0."""
    return F.greatest((_c(block) - 1) * width + (_c(index) - 1), F.lit(0))
