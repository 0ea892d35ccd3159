"""Linear barcodes as widths of bars and spaces: Code 39, EAN-13 and Code 128 (E14), to draw and to recognise.

A symbol is a list of element widths in modules, bars and spaces in turn, a bar first and last. Code 39 and the EAN digits are
built from their rules; of Code 128 the public table is stated below.
"""

from __future__ import annotations

from functools import lru_cache

FORMATS = ("CODE_39", "EAN_13", "CODE_128")

# The widths of Code 128's symbols 0 to 105, bar first, and of its stop; eleven modules each, the stop thirteen.
CODE_128 = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222
123122 123221 223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321
232121 111323 131123 131321 112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121
313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 314111 221411 431111 111224
111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113
114311 411113 411311 113141 114131 311141 411131 211412 211214 211232
""".split()
CODE_128_STOP = "2331112"
START_A, START_B, START_C = 103, 104, 105
#: Code 128's shift, its changes of set to C, B and A, and its function marks, by symbol.
SHIFT, TO_C, TO_B, TO_A = 98, 99, 100, 101
FNC_3, FNC_2, FNC_1 = 96, 97, 102

# Code 39's characters in four rows, by which space is wide; a row's places are the ten patterns of wide bars.
CODE_39_ROWS = {1: "1234567890", 2: "ABCDEFGHIJ", 3: "KLMNOPQRST", 0: "UVWXYZ-. *"}
CODE_39_BARS = ("10001", "01001", "11000", "00101", "10100", "01100", "00011", "10010", "01010", "00110")
# Those with three wide spaces and narrow bars alone, by the space that is narrow.
CODE_39_SPACED = {3: "$", 2: "/", 1: "+", 0: "%"}

# The left digits of EAN with an odd number of dark modules, and the sets (G: even) that the first digit picks.
EAN_ODD = ("0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011")
EAN_SETS = ("LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL")


def widths_of(modules: str) -> tuple[int, ...]:
    """The run lengths of a string of modules."""
    out: list[int] = []
    for i, m in enumerate(modules):
        if i and m == modules[i - 1]:
            out[-1] += 1
        else:
            out.append(1)
    return tuple(out)


@lru_cache(maxsize=1)
def code_39() -> dict[str, tuple[int, ...]]:
    """Of each character nine elements, 1 where wide: five bars, and four spaces between them."""
    out = {}
    for space, row in CODE_39_ROWS.items():
        for c, bars in zip(row, CODE_39_BARS):
            out[c] = tuple(int(bars[i // 2]) if i % 2 == 0 else int(i // 2 == space) for i in range(9))
    for narrow, c in CODE_39_SPACED.items():
        out[c] = tuple(0 if i % 2 == 0 else int(i // 2 != narrow) for i in range(9))
    return out


@lru_cache(maxsize=1)
def ean_digits() -> dict[str, dict[tuple[int, ...], int]]:
    """The widths of digits in sets L and G, which begin with a space, and R, which begins with a bar."""
    odd = {widths_of(x): i for i, x in enumerate(EAN_ODD)}
    return {"L": odd, "R": dict(odd), "G": {w[::-1]: i for w, i in odd.items()}}


def ean_check(digits: str) -> int:
    """The thirteenth digit for twelve."""
    return -sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10


def code_128_check(symbols: list[int]) -> int:
    """Of a start symbol and those after it."""
    return (symbols[0] + sum(i * s for i, s in enumerate(symbols[1:], 1))) % 103


def draw_code_39(text: str, wide: int = 3) -> list[int]:
    out: list[int] = []
    for c in f"*{text}*":
        out += [wide if x else 1 for x in code_39()[c]] + [1]
    return out[:-1]


def draw_ean_13(digits: str) -> list[int]:
    """Of twelve digits, or of thirteen with the check digit."""
    digits = digits[:12] + str(ean_check(digits[:12]))
    by = {kind: {i: w for w, i in table.items()} for kind, table in ean_digits().items()}
    out = [1, 1, 1]
    for d, kind in zip(digits[1:7], EAN_SETS[int(digits[0])]):
        out += by[kind][int(d)]
    out += [1] * 5
    for d in digits[7:]:
        out += by["R"][int(d)]
    return out + [1, 1, 1]


def code_128_symbols(text: str) -> list[int]:
    """Set B, and C for runs of four digits or more; characters below blank in set A."""
    out: list[int] = []
    mode, i = "", 0
    starts, changes = {"A": START_A, "B": START_B, "C": START_C}, {"A": TO_A, "B": TO_B, "C": TO_C}
    while i < len(text) or not out:
        run = 0
        while i + run < len(text) and text[i + run] in "0123456789":
            run += 1
        want = "C" if run >= 4 or (mode == "C" and run >= 2) else "A" if i < len(text) and text[i] < " " else "B" if mode != "A" or text[i] >= "`" else "A"
        if want != mode:
            out.append((changes if out else starts)[want])
            mode = want
        if i >= len(text):
            break
        if mode == "C":
            out.append(int(text[i : i + 2]))
            i += 2
        else:
            out.append(ord(text[i]) + 64 if text[i] < " " else ord(text[i]) - 32)
            i += 1
    return out


def draw_code_128(text: str) -> list[int]:
    symbols = code_128_symbols(text)
    symbols.append(code_128_check(symbols))
    return [int(w) for s in symbols for w in CODE_128[s]] + [int(w) for w in CODE_128_STOP]


DRAW = {"CODE_39": draw_code_39, "EAN_13": draw_ean_13, "CODE_128": draw_code_128}


def can_draw(text: str, form: str) -> bool:
    if form == "CODE_39":
        return bool(text) and all(c in code_39() and c != "*" for c in text)
    if form == "EAN_13":
        return len(text) == 13 and text.isascii() and text.isdigit() and int(text[-1]) == ean_check(text[:12])
    return bool(text) and all(ord(c) < 128 for c in text)
