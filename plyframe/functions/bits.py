"""SQL fragments over 64-square sets held in one BIGINT.

Bit 63 is a8, bit 56 h8, bit 7 a1 and bit 0 h1: the order in which FEN lists the squares, so a
placement converts to a set without being turned around.

A square set per piece type makes "which of these squares are attacked, blocked, pinned" a few
integer operations per position, which stay in generated code and need no join. Fragments are
plain SQL text so that they can be used inside lambdas as well as in projections.
"""

from __future__ import annotations

FULL = (1 << 64) - 1


def const(mask: int) -> str:
    """A 64-bit set as a signed SQL literal."""
    mask &= FULL
    return f"({mask - (1 << 64)}L)" if mask >> 63 else f"{mask}L"


FILE_H = sum(1 << (8 * r) for r in range(8))
FILE_A = FILE_H << 7
NOT_A = FULL ^ FILE_A
NOT_H = FULL ^ FILE_H

# direction -> (shift, squares a step may land on)
DIRECTIONS = {
    "n": (8, FULL), "s": (-8, FULL), "e": (-1, NOT_A), "w": (1, NOT_H),
    "ne": (7, NOT_A), "sw": (-7, NOT_H), "nw": (9, NOT_H), "se": (-9, NOT_A),
}
STRAIGHT = ("n", "s", "e", "w")
DIAGONAL = ("ne", "sw", "nw", "se")


def index(name: str) -> int:
    """Bit number of a square given as text."""
    return 8 * (int(name[1]) - 1) + (ord("h") - ord(name[0]))


def name(sq: int) -> str:
    return "hgfedcba"[sq % 8] + str(sq // 8 + 1)


def squares(*names: str) -> int:
    return sum(1 << index(n) for n in names)


def rank(n: int) -> int:
    return 0xFF << (8 * (n - 1))


def shift(x: str, n: int) -> str:
    return f"shiftleft({x}, {n})" if n > 0 else f"shiftrightunsigned({x}, {-n})"


def step(x: str, d: str) -> str:
    """All squares one step in direction `d` from the set `x`."""
    n, land = DIRECTIONS[d]
    moved = shift(x, n)
    return f"({moved})" if land == FULL else f"({moved} & {const(land)})"


def ray(start: str, empty: str, d: str) -> str:
    """Squares seen from `start` in direction `d`, up to and including the first piece met.

    Doubling fill: reach 1, 3, then 7 steps.
    """
    n, land = DIRECTIONS[d]
    open_ = empty if land == FULL else f"({empty} & {const(land)})"
    g1 = f"({start} | ({open_} & {shift(start, n)}))"
    o1 = f"({open_} & {shift(open_, n)})"
    g2 = f"({g1} | ({o1} & {shift(g1, 2 * n)}))"
    o2 = f"({o1} & {shift(o1, 2 * n)})"
    g3 = f"({g2} | ({o2} & {shift(g2, 4 * n)}))"
    return step(g3, d)


def union(parts: list[str]) -> str:
    return "(" + " | ".join(parts) + ")"


def rays(start: str, empty: str, directions: tuple[str, ...]) -> str:
    return union([ray(start, empty, d) for d in directions])


def knight_steps(x: str) -> str:
    two_e = const(FULL ^ FILE_A ^ (FILE_A >> 1))
    two_w = const(FULL ^ FILE_H ^ (FILE_H << 1))
    one_e, one_w = const(NOT_A), const(NOT_H)
    jumps = [(15, one_e), (17, one_w), (6, two_e), (10, two_w),
             (-17, one_e), (-15, one_w), (-10, two_e), (-6, two_w)]
    return union([f"({shift(x, n)} & {land})" for n, land in jumps])


def king_steps(x: str) -> str:
    return union([step(x, d) for d in DIRECTIONS])


def pawn_attacks_up(x: str) -> str:
    return union([step(x, "ne"), step(x, "nw")])


def pawn_attacks_down(x: str) -> str:
    return union([step(x, "se"), step(x, "sw")])


def bit(sq: str) -> str:
    return f"shiftleft(1L, CAST({sq} AS INT))"


def index_sql(square: str) -> str:
    """Bit number of a square given as a text column."""
    return f"(8 * (ascii(substr({square}, 2, 1)) - 49) + 104 - ascii({square}))"


def name_sql(sq: str) -> str:
    """Text of a square given by its bit number."""
    return f"concat(char(104 - {sq} % 8), char(49 + {sq} DIV 8))"


def pack_nibbles(x: str, digit: int) -> str:
    """Binary digit `digit` of each of the 16 hexadecimal digits of `x`, as a 16-bit number."""
    y = f"(shiftrightunsigned({x}, {digit}) & {const(0x1111111111111111)})"
    for n, land in ((3, 0x0303030303030303), (6, 0x000F000F000F000F), (12, 0x000000FF000000FF), (24, 0xFFFF)):
        y = f"(({y} | shiftrightunsigned({y}, {n})) & {const(land)})"
    return y


def index_of(x: str) -> str:
    """Square number of the lowest set bit; meaningless for the empty set.

    a8 is the sign bit, which cannot be negated under ANSI arithmetic.
    """
    return f"CASE WHEN {x} = {const(1 << 63)} THEN 63 ELSE CAST(bit_count(({x} & -({x})) - 1L) AS INT) END"


def has(x: str) -> str:
    return f"({x} <> 0L)"


def none(x: str) -> str:
    return f"({x} = 0L)"
