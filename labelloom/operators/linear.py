"""A decoder that reads linear barcodes from pixels (E7, E14): run lengths along scan lines, matched by their ratios.

An image is parted into dark and light by the threshold of its histogram. Along some of its lines, across and, with
try_harder, down as well as backwards, the runs of dark and light are matched against a format's symbols: the widths of a
symbol in shares of its whole, against the table's, so neither scale nor slight blur matters. What a checksum, a start, a stop
or the light space about a symbol contradicts is no barcode. Several barcodes on one line are all read.

Rows of pixels are Spark's to deal out (decode.py); this is the step over one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from labelloom.functions import barcodes as C
from labelloom.operators.decode import Barcode, Block
from labelloom.operators.images import IMAGE, gray_bytes, gray_counts, otsu_threshold
from labelloom.plans.config import OcrConfig

#: How much a width may differ from the table's, in modules: on average over a symbol, and each.
MEAN_OFF, MOST_OFF = 0.35, 0.75
#: Modules of light that stand at least before and after a symbol.
QUIET = 5
#: Lines that are scanned in each direction.
LINES = 15
#: Bars and spaces of the shortest symbol: Code 128's start, a symbol, its check and its stop.
SHORTEST = 25
#: Symbols by their widths, and lines of pixels, whose reading is kept at most.
KEPT_SYMBOLS, KEPT_LINES = 20_000, 64

K, V = TypeVar("K"), TypeVar("V")
Found = tuple[str, str, int, int]  # text, format, first and last run


def runs_of(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the runs along a line, the first of them light (its width may be 0), and their starts."""
    edges = (dark[1:] != dark[:-1]).nonzero()[0]
    lead = 2 if len(dark) and dark[0] else 1
    bounds = np.zeros(lead + len(edges) + 1, np.int64)
    bounds[lead:-1] = edges + 1
    bounds[-1] = len(dark)
    return bounds[1:] - bounds[:-1], bounds[:-1]


@lru_cache(maxsize=4096)
def scanned(n: int) -> list[int]:
    """The places of the lines, of n, that are scanned."""
    return np.unique(np.linspace(0, n - 1, min(n, LINES + 2)).astype(int)[1:-1] if n > 2 else np.arange(n)).tolist()


def kept(met: dict[K, V], key: K, make: Callable[[K], V], most: int) -> V:
    """make(key), worked out once while met, which is begun anew when it is full, knows it."""
    if key not in met:
        if len(met) >= most:
            met.clear()
        met[key] = make(key)
    return met[key]


class Table:
    """Symbols of equally many elements and modules, looked up by the widths of a symbol."""

    def __init__(self, rows: Sequence[Sequence[int]], modules: int):
        self.rows, self.modules = np.array(rows), modules
        self.exact = {tuple(map(int, x)): i for i, x in reversed(list(enumerate(rows)))}
        self.met: dict[tuple[int, ...], int | None] = {}

    def nearest(self, widths: Sequence[int]) -> int | None:
        """The row that the widths are like in their ratios; None if none is."""
        return kept(self.met, tuple(widths), self.compared, KEPT_SYMBOLS)

    def compared(self, widths: Sequence[int]) -> int | None:
        scale = self.modules / sum(widths)
        like = [w * scale for w in widths]
        near = tuple(map(round, like))
        # Two rows differ by two modules at least: what is less than one from a row is nearer to it than to any other.
        if (found := self.exact.get(near)) is not None and sum(abs(x - y) for x, y in zip(like, near)) < 0.99:
            return found
        off = np.abs(np.array(like) - self.rows)
        best = int(off.sum(axis=1).argmin())
        return best if off[best].mean() <= MEAN_OFF and off[best].max() <= MOST_OFF else None


def quiet(widths: Sequence[int], first: int, last: int, module: float) -> bool:
    """Is there light enough about the runs first to last? An image may end at a symbol's light space."""
    return widths[first - 1] >= QUIET * module and (last + 1 >= len(widths) or widths[last + 1] >= QUIET * module)


class Code39:
    def __init__(self) -> None:
        self.known = {w: c for c, w in C.code_39().items()}
        self.met: dict[tuple[int, ...], str | None] = {}

    def character(self, widths: Sequence[int]) -> str | None:
        return kept(self.met, tuple(widths), self.compared, KEPT_SYMBOLS)

    def compared(self, widths: Sequence[int]) -> str | None:
        order = sorted(widths)
        if order[6] < 1.5 * order[5]:  # three of nine are wide
            return None
        limit = (order[5] + order[6]) / 2
        return self.known.get(tuple(int(w > limit) for w in widths))

    def read(self, widths: Sequence[int], first: int) -> Found | None:
        narrow = min(widths[first : first + 9])
        if widths[first - 1] < QUIET * narrow:  # as quiet() would say at the end
            return None
        text, at = "", first
        while at + 9 <= len(widths) and (c := self.character(widths[at : at + 9])) is not None:
            if (c == "*") != (at == first) and at == first:
                return None
            if c == "*" and at > first:
                return (text, "CODE_39", first, at + 8) if text and quiet(widths, first, at + 8, narrow) else None
            text += c if at > first else ""
            at += 10
        return None


class Ean13:
    def __init__(self) -> None:
        sets = C.ean_digits()
        self.right = Table(list(sets["R"]), 7), list(sets["R"].values())
        self.left = Table([*sets["L"], *sets["G"]], 7), [("L", d) for d in sets["L"].values()] + [("G", d) for d in sets["G"].values()]

    def read(self, widths: Sequence[int], first: int) -> Found | None:
        if first + 59 > len(widths):
            return None
        w = widths[first : first + 59]
        module = sum(w) / 95
        if not quiet(widths, first, first + 58, module) or any(abs(x / module - 1) > MOST_OFF for x in (*w[:3], *w[27:32], *w[56:])):
            return None
        digits, kinds = "", ""
        for k in range(6):
            found = self.left[0].nearest(w[3 + 4 * k : 7 + 4 * k])
            if found is None:
                return None
            kind, digit = self.left[1][found]
            digits, kinds = digits + str(digit), kinds + kind
        for k in range(6):
            found = self.right[0].nearest(w[32 + 4 * k : 36 + 4 * k])
            if found is None:
                return None
            digits += str(self.right[1][found])
        if kinds not in C.EAN_SETS:
            return None
        digits = str(C.EAN_SETS.index(kinds)) + digits
        return (digits, "EAN_13", first, first + 58) if C.ean_check(digits[:12]) == int(digits[12]) else None


class Code128:
    def __init__(self) -> None:
        self.table = Table([[int(w) for w in x] for x in C.CODE_128], 11)
        self.stop = [int(w) for w in C.CODE_128_STOP]
        self.met: dict[tuple[int, ...], bool] = {}

    def is_stop(self, widths: Sequence[int]) -> bool:
        return kept(self.met, tuple(widths), self.compared, KEPT_SYMBOLS)

    def compared(self, widths: Sequence[int]) -> bool:
        scale = 13 / sum(widths)
        off = [abs(w * scale - x) for w, x in zip(widths, self.stop)]
        return sum(off) / 7 <= MEAN_OFF and max(off) <= MOST_OFF

    def read(self, widths: Sequence[int], first: int) -> Found | None:
        symbols: list[int] = []
        at = first
        while at + 6 <= len(widths):
            if len(symbols) > 2 and at + 7 <= len(widths) and self.is_stop(widths[at : at + 7]):
                module = sum(widths[at : at + 7]) / 13
                if symbols[-1] != C.code_128_check(symbols[:-1]) or not quiet(widths, first, at + 6, module):
                    return None
                return self.text(symbols[:-1]), "CODE_128", first, at + 6
            symbol = self.table.nearest(widths[at : at + 6])
            if symbol is None or (symbol >= C.START_A) != (not symbols):
                return None
            symbols.append(symbol)
            at += 6
        return None

    @staticmethod
    def text(symbols: list[int]) -> str:
        mode, shifted, out = "ABC"[symbols[0] - C.START_A], False, ""
        for s in symbols[1:]:
            now, shifted = ({"A": "B", "B": "A"}[mode] if shifted else mode), False
            if now == "C":
                if s < 100:
                    out += f"{s:02d}"
                elif s in (C.TO_B, C.TO_A):
                    mode = "B" if s == C.TO_B else "A"
            elif s < 64:
                out += chr(s + 32)
            elif s < C.FNC_3:
                out += chr(s + 32 if now == "B" else s - 64)
            elif s == C.SHIFT:
                shifted = True
            elif s == C.TO_C:
                mode = "C"
            elif s == C.TO_B and mode == "A":
                mode = "B"
            elif s == C.TO_A and mode == "B":
                mode = "A"
        return out


class LinearDecoder:
    """A Decoder plug-in. formats: the hints; only these are looked for. It reads no text."""

    READERS = {"CODE_39": Code39, "EAN_13": Ean13, "CODE_128": Code128}

    def __init__(self, formats: Sequence[str] = C.FORMATS, try_harder: bool = True):
        unknown = set(formats) - set(self.READERS)
        if unknown:
            raise ValueError(f"no such formats: {', '.join(sorted(unknown))}")
        self.readers = [self.READERS[f]() for f in dict.fromkeys(formats)]
        self.try_harder = try_harder
        self.met: dict[bytes, list[tuple[str, str, int, int]]] = {}

    def read_text(self, image: np.ndarray, config: OcrConfig) -> list[Block]:
        return []

    def line(self, runs: np.ndarray) -> Iterator[Found]:
        """The barcodes along a line of runs, whose bars are the odd ones."""
        first = 1
        widths = tuple(runs.tolist()) if len(runs) > SHORTEST else ()
        while first + SHORTEST <= len(widths):
            # The widest first bar is two modules, after QUIET modules of light.
            if 2 * widths[first] > widths[first - 1]:
                first += 2
                continue
            for reader in self.readers:
                if found := reader.read(widths, first):
                    yield found
                    first = found[3]
                    break
            first += 2

    def along(self, dark: np.ndarray) -> Iterator[tuple[str, str, int, int]]:
        """text, format, from and to of a line's barcodes, also of those that stand backwards."""
        widths, starts = runs_of(dark)
        yield from ((t, f, int(starts[a]), int(starts[b] + widths[b])) for t, f, a, b in self.line(widths))
        if self.try_harder and len(widths) >= SHORTEST:
            n, (widths, starts) = len(dark), runs_of(dark[::-1])
            yield from ((t, f, n - int(starts[b] + widths[b]), n - int(starts[a])) for t, f, a, b in self.line(widths))

    def along_bytes(self, dark: bytes) -> list[tuple[str, str, int, int]]:
        return list(self.along(np.frombuffer(dark, bool)))

    def read_barcodes(self, image: np.ndarray) -> list[Barcode]:
        gray = gray_bytes(image)
        if max(gray.shape) < SHORTEST or not gray.size:
            return []
        counts = gray_counts(gray)
        if counts.max() == gray.size:  # all the same
            return []
        threshold = otsu_threshold(counts)  # the darker class's last bin
        found: dict[tuple[str, str], list[int]] = {}
        for across in (True, False) if self.try_harder else (True,):
            lines = gray if across else gray.T
            if lines.shape[1] < SHORTEST:
                continue
            equal: dict[bytes, list[int]] = {}
            for at in scanned(len(lines)):
                equal.setdefault(lines[at].tobytes(), []).append(at)
            for places in equal.values():
                dark = lines[places[0]] <= threshold
                for text, form, a, b in kept(self.met, dark.tobytes(), self.along_bytes, KEPT_LINES):
                    x0, y0, x1, y1 = (a, places[0], b, places[-1] + 1) if across else (places[0], a, places[-1] + 1, b)
                    box = found.setdefault((text, form), [x0, y0, x1, y1])
                    box[:] = min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)
        return [Barcode(text, form, (x0, y0, x1 - x0, y1 - y0)) for (text, form), (x0, y0, x1, y1) in sorted(found.items(), key=lambda x: (x[1][1], x[1][0]))]


def raster_of(widths: Sequence[int], module: int = 2, height: int = 20, margin: int = 10) -> np.ndarray:
    """A drawn symbol: black bars on white, with its light space, modules of so many pixels."""
    colours = np.full(len(widths) + 2, 255, np.uint8)
    colours[1:-1:2] = 0
    return np.tile(np.repeat(colours, np.array([margin, *widths, margin]) * module), (height, 1))


def drawn(rows: DataFrame) -> DataFrame:
    """Label images (IMAGE) of rows image_id, text, format, module (pixels), turned (a bar is a row), inverted (light on dark). A text
    that the format can't hold, or is null, gives a null image. Few bytes come in and much work follows, so the rows go to as
    many tasks as the shuffle has, however few files they are from."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.text is None or r.format not in C.DRAW or not C.can_draw(r.text, r.format):
                    out.append((r.image_id, None, None, None, None, None))
                    continue
                x = raster_of(C.DRAW[r.format](r.text), int(r.module))
                x = np.ascontiguousarray(x.T if r.turned else x)
                out.append((r.image_id, x.shape[1], x.shape[0], 1, 8, (255 - x if r.inverted else x).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "n_channels", "bits_per_sample", "data"]).astype({c: "Int32" for c in ("width", "height", "n_channels", "bits_per_sample")})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("image_id", "text", "format", "module", "turned", "inverted").repartition(parts).mapInPandas(draw, IMAGE)
