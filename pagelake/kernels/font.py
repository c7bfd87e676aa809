"""TrueType and OpenType fonts: metrics, character maps, advances, kerning, and the nearest face of a family."""

from __future__ import annotations

import hashlib
import math
import struct
from bisect import bisect_right
from functools import lru_cache

# What the generic families stand for, and families whose ascent grows by 15 % of the height.
GENERIC = {"serif": "Times", "sans-serif": "Helvetica", "monospace": "Menlo", "cursive": "Apple Chancery", "fantasy": "Papyrus", "system-ui": "System Font", "-apple-system": "System Font"}
TALLER = ("Times", "Helvetica", "Courier")
MOST_FACES, MOST_KERN_TABLES, MOST_NAME_BYTES = 256, 64, 1 << 20


class BadFont(ValueError):
    pass


class Data:
    """Big-endian numbers, with bounds."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def _at(self, fmt: str, at: int, size: int) -> int:
        if at < 0 or at + size > len(self.raw):
            raise BadFont("read beyond the end")
        return struct.unpack_from(fmt, self.raw, at)[0]

    def u16(self, at: int) -> int:
        return self._at(">H", at, 2)

    def i16(self, at: int) -> int:
        return self._at(">h", at, 2)

    def u32(self, at: int) -> int:
        return self._at(">I", at, 4)

    def u16s(self, at: int, n: int) -> tuple[int, ...]:
        if at < 0 or at + 2 * n > len(self.raw):
            raise BadFont("read beyond the end")
        return struct.unpack_from(f">{n}H", self.raw, at)

    def part(self, at: int, n: int) -> bytes:
        if at + n > len(self.raw):
            raise BadFont("read beyond the end")
        return self.raw[at : at + n]


def face_count(raw: bytes) -> int:
    if len(raw) < 4:
        raise BadFont("read beyond the end")
    return Data(raw).u32(8) if raw[:4] == b"ttcf" else 1


def tables(raw: bytes, index: int = 0) -> dict[bytes, Data]:
    d = Data(raw)
    if index >= face_count(raw):
        raise BadFont(f"no face {index}")
    at = d.u32(12 + 4 * index) if raw[:4] == b"ttcf" else 0
    if d.part(at, 4) not in (b"\0\1\0\0", b"true", b"OTTO", b"typ1"):
        raise BadFont("unknown signature")
    out: dict[bytes, Data] = {}
    for i in range(d.u16(at + 4)):
        rec = at + 12 + 16 * i
        tag, start, size = d.part(rec, 4), d.u32(rec + 8), d.u32(rec + 12)
        if tag not in out and start + size <= len(raw):
            out[tag] = Data(raw[start : start + size])
    return out


def name_text(d: Data, wanted: int) -> str | None:
    """A text of the table name: Unicode or English first, else what there is."""
    other = None
    try:
        strings = d.u16(4)
        for i in range(d.u16(2)):
            platform, encoding, language, ident, size, at = d.u16s(6 + 12 * i, 6)
            if ident != wanted:
                continue
            raw = d.part(strings + at, size)
            if platform == 0 or (platform == 3 and encoding in (0, 1, 10)):
                text = raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace")
                if platform == 0 or language == 0x0409:
                    return text
                other = text if other is None else other
            elif (platform, encoding) == (1, 0) and other is None:
                other = raw.decode("latin-1")
    except BadFont:
        return None
    return other


class CharMap:
    """Ranges (first, last, glyph of the first) and single characters."""

    def __init__(self, d: Data | None = None):
        self.ranges: list[tuple[int, int, int]] = []
        self.single: dict[int, int] = {}
        if d is None:
            return
        best = (0, 0)
        for i in range(d.u16(2)):
            platform, encoding = d.u16s(4 + 8 * i, 2)
            at = d.u32(8 + 8 * i)
            score = {12: 2, 4: 1}.get(d.u16(at), 0) if platform == 0 or (platform == 3 and encoding in (1, 10)) else 0
            if score > best[0]:
                best = (score, at)
        if not best[0]:
            raise BadFont("no Unicode character map")
        (self._long if best[0] == 2 else self._short)(Data(d.raw[best[1] :]))
        self.ranges.sort()
        self.firsts = [r[0] for r in self.ranges]

    def _long(self, d: Data) -> None:
        for g in range(d.u32(12)):
            a, z, glyph = (d.u32(16 + 12 * g + k) for k in (0, 4, 8))
            if a <= z:
                self.ranges.append((a, z, glyph))

    def _short(self, d: Data) -> None:
        n = d.u16(6) // 2
        ends, starts, deltas = d.u16s(14, n), d.u16s(16 + 2 * n, n), d.u16s(16 + 4 * n, n)
        for i, (a, z, delta) in enumerate(zip(starts, ends, deltas, strict=True)):
            if a > z or a == 0xFFFF:
                continue
            at = 16 + 6 * n + 2 * i
            skip = d.u16(at)
            first = (a + delta) & 0xFFFF
            if skip:
                for c in range(a, z + 1):
                    glyph = d.u16(at + skip + 2 * (c - a))
                    if glyph:
                        self.single[c] = (glyph + delta) & 0xFFFF
            elif first + z - a <= 0xFFFF:
                self.ranges.append((a, z, first))
            else:
                self.single |= {c: (c + delta) & 0xFFFF for c in range(a, z + 1)}

    def glyph(self, c: str) -> int:
        n = ord(c)
        if n in self.single:
            return self.single[n]
        i = bisect_right(self.firsts, n) if self.ranges else 0
        if i and n <= self.ranges[i - 1][1]:
            return min(self.ranges[i - 1][2] + n - self.ranges[i - 1][0], 0xFFFF)
        return 0


def kern_pairs(d: Data) -> dict[tuple[int, int], int]:
    """Pairs of the table kern, horizontal parts of format 0, in Microsoft's or Apple's form."""
    out: dict[tuple[int, int], int] = {}
    apple = d.u16(0) == 1
    count, at = (d.u32(4), 8) if apple else (d.u16(2), 4)
    for _ in range(min(count, MOST_KERN_TABLES)):
        cover = d.u16(at + 4)
        if apple:
            size, kind, flat, head = d.u32(at), cover & 0xFF, not cover & 0xE000, 8
        else:
            size, kind, flat, head = d.u16(at + 2), cover >> 8, bool(cover & 1 and not cover & 4), 6
        if kind == 0 and flat:
            for i in range(d.u16(at + head)):
                rec = at + head + 8 + 6 * i
                out.setdefault(d.u16s(rec, 2), d.i16(rec + 4))
        if not size:
            break
        at += size
    return out


class PairPositions:
    """Kerning of the table GPOS: the pair adjustments that its kern feature uses for Latin script, or else by default."""

    def __init__(self, d: Data):
        self.d = d
        self.parts: list[tuple[int, int]] = []  # (lookup, place)
        scripts, features, lookups = d.u16s(4, 3)
        wanted = self._features(scripts)
        used: set[int] = set()
        for f in range(d.u16(features)):
            rec = features + 2 + 6 * f
            if (wanted is None or f in wanted) and d.part(rec, 4) == b"kern":
                at = features + d.u16(rec + 4)
                used.update(d.u16s(at + 4, d.u16(at + 2)))
        for k in sorted(x for x in used if x < d.u16(lookups)):
            at = lookups + d.u16(lookups + 2 + 2 * k)
            kind = d.u16(at)
            for s in range(d.u16(at + 4)):
                sub = at + d.u16(at + 6 + 2 * s)
                real, sub = (d.u16(sub + 2), sub + d.u32(sub + 4)) if kind == 9 else (kind, sub)
                if real == 2:
                    self.parts.append((k, sub))

    def _features(self, scripts: int) -> set[int] | None:
        d, found = self.d, {}
        for i in range(d.u16(scripts)):
            rec = scripts + 2 + 6 * i
            found.setdefault(d.part(rec, 4), scripts + d.u16(rec + 4))
        script = found.get(b"latn") or found.get(b"DFLT")
        if script is None or not d.u16(script):
            return None
        lang = script + d.u16(script)
        return set(d.u16s(lang + 6, d.u16(lang + 4)))

    def pair(self, left: int, right: int) -> int:
        total, done = 0, -1
        for k, sub in self.parts:
            if k == done:
                continue
            try:
                got = self._adjust(sub, left, right)
            except BadFont:
                got = None
            if got is not None:
                total += got
                done = k
        return total

    def _spread(self, at: int, ranged: int, glyph: int) -> int | None:
        """Value for a glyph among the ranges (first, last, value) of a coverage or class table."""
        for i in range(self.d.u16(at + 2)):
            a, z, v = self.d.u16s(at + 4 + 6 * i, 3)
            if a <= glyph <= z:
                return v + (glyph - a) * ranged
        return None

    def _covered(self, at: int, glyph: int) -> int | None:
        if self.d.u16(at) == 1:
            all_ = self.d.u16s(at + 4, self.d.u16(at + 2))
            return all_.index(glyph) if glyph in all_ else None
        return self._spread(at, 1, glyph) if self.d.u16(at) == 2 else None

    def _class(self, at: int, glyph: int) -> int:
        if self.d.u16(at) == 1:
            first, n = self.d.u16s(at + 2, 2)
            return self.d.u16(at + 6 + 2 * (glyph - first)) if first <= glyph < first + n else 0
        return (self._spread(at, 0, glyph) or 0) if self.d.u16(at) == 2 else 0

    def _adjust(self, sub: int, left: int, right: int) -> int | None:
        d = self.d
        form, cover, first, second = d.u16s(sub, 4)
        index = self._covered(sub + cover, left)
        if index is None:
            return None
        size = 2 * ((first & 0xFF).bit_count() + (second & 0xFF).bit_count())
        before = 2 * (first & 3).bit_count()
        advance = lambda rec: d.i16(rec + before) if first & 4 else 0
        if form == 1:
            if index >= d.u16(sub + 8):
                return None
            at = sub + d.u16(sub + 10 + 2 * index)
            for i in range(d.u16(at)):
                rec = at + 2 + (size + 2) * i
                if d.u16(rec) == right:
                    return advance(rec + 2)
            return None
        if form == 2:
            c1, c2 = self._class(sub + d.u16(sub + 8), left), self._class(sub + d.u16(sub + 10), right)
            n1, n2 = d.u16s(sub + 12, 2)
            return advance(sub + 16 + (c1 * n2 + c2) * size) if c1 < n1 and c2 < n2 else None
        return None


def _half_up(x: float) -> float:
    """Rounded, halves away from zero."""
    return math.copysign(math.floor(abs(x) + 0.5), x)


class Font:
    def __init__(self):
        self.family = self.subfamily = ""
        self.weight, self.italic, self.units_per_em = 400, False, 1000
        self.ascender = self.descender = self.line_gap = 0
        self.typo = self.win = None
        self.advances: list[int] = []
        self.cmap = CharMap()
        self.pairs: dict[tuple[int, int], int] = {}
        self.positions: PairPositions | None = None

    @classmethod
    def parse(cls, raw: bytes, index: int = 0) -> Font:
        t, f = tables(raw, index), cls()
        for tag in (b"head", b"hhea", b"maxp", b"hmtx", b"cmap"):
            if tag not in t:
                raise BadFont(f"no table {tag.decode()}")
        f.units_per_em = t[b"head"].u16(18)
        if not f.units_per_em:
            raise BadFont("unitsPerEm is zero")
        f.ascender, f.descender, f.line_gap = (t[b"hhea"].i16(k) for k in (4, 6, 8))
        glyphs, full = t[b"maxp"].u16(4), t[b"hhea"].u16(34)
        f.advances = [t[b"hmtx"].u16(4 * g) for g in range(min(glyphs, full))]
        f.advances += [f.advances[-1] if f.advances else 0] * (glyphs - len(f.advances))
        f.weight, f.italic, f.typo, f.win = _face_style(t)
        if b"name" in t:
            text = lambda *ids: next((x for i in ids if (x := name_text(t[b"name"], i)) is not None), "")
            f.family, f.subfamily = text(16, 1), text(17, 2)
        f.cmap = CharMap(t[b"cmap"])
        try:
            f.positions = PairPositions(t[b"GPOS"]) if b"GPOS" in t else None
        except BadFont:
            f.positions = None
        if f.positions is not None and not f.positions.parts:
            f.positions = None
        if f.positions is None and b"kern" in t:
            try:
                f.pairs = kern_pairs(t[b"kern"])
            except BadFont:
                f.pairs = {}
        return f

    @classmethod
    def synthetic(cls, family: str, advances: dict[str, int], units_per_em: int = 1000, ascender: int = 800, descender: int = -200, line_gap: int = 0, weight: int = 400, italic: bool = False, pairs: dict[tuple[str, str], int] | None = None) -> Font:
        """A face from tables: the advance of each character and the kerning of pairs."""
        f = cls()
        f.family, f.weight, f.italic, f.units_per_em = family, weight, italic, units_per_em
        f.ascender, f.descender, f.line_gap = ascender, descender, line_gap
        chars = sorted(advances)
        f.cmap.single = {ord(c): i + 1 for i, c in enumerate(chars)}
        f.advances = [0, *(advances[c] for c in chars)]
        f.pairs = {(f.glyph(a), f.glyph(b)): v for (a, b), v in (pairs or {}).items()}
        return f

    def glyph(self, c: str) -> int:
        return self.cmap.glyph(c)

    def advance(self, glyph: int) -> int:
        return self.advances[glyph] if glyph < len(self.advances) else 0

    def kerning(self, left: int, right: int) -> int:
        if self.positions is None:
            return self.pairs.get((left, right), 0)
        return self._position(left, right)

    @lru_cache(maxsize=65536)  # noqa: B019
    def _position(self, left: int, right: int) -> int:
        return self.positions.pair(left, right)

    def text_width(self, text: str, size: float) -> float:
        return sum(self.advance(self.glyph(c)) for c in text) * size / self.units_per_em

    def kerned_advances(self, text: str) -> list[int]:
        """Advance of each character, with the kerning to the next."""
        g = [self.glyph(c) for c in text]
        return [self.advance(a) + (self.kerning(a, g[i + 1]) if i + 1 < len(g) else 0) for i, a in enumerate(g)]

    def kerned_width(self, text: str, size: float) -> float:
        return sum(self.kerned_advances(text)) * size / self.units_per_em

    def line_metrics(self, size: float) -> tuple[float, float, float]:
        """(ascent, descent, line gap) in whole px."""
        px = lambda u: _half_up(u * size / self.units_per_em)
        up, down = px(self.ascender), px(-self.descender)
        if self.family in TALLER:
            up += math.floor((up + down) * 0.15 + 0.5)
        return up, down, px(self.line_gap)


def _face_style(t: dict[bytes, Data]) -> tuple:
    """(weight, italic, typographic metrics, Windows metrics), from OS/2 if it is whole, else from head."""
    try:
        o = t[b"OS/2"]
        pick = o.u16(62)
        return o.u16(4), bool(pick & 0x201), tuple(o.i16(k) for k in (68, 70, 72)), (o.u16(74), o.u16(76))
    except (KeyError, BadFont):
        bits = t[b"head"].u16(44)
        return (700 if bits & 1 else 400), bool(bits & 2), None, None


EMPTY = Font()


def faces_of(raw: bytes) -> list[Font]:
    """All fonts of a file that can be read."""
    out = []
    try:
        for i in range(min(face_count(raw), MOST_FACES)):
            try:
                out.append(Font.parse(raw, i))
            except BadFont:
                continue
    except BadFont:
        pass
    return out


class FontFile:
    """A face of a font file by what its small tables say; load() reads the rest, once in each process that asks for it."""

    def __init__(self, raw: bytes, index: int = 0):
        t = tables(raw, index)
        self.raw, self.index, self.digest = raw, index, hashlib.sha256(raw).digest()
        self.weight, self.italic = _face_style(t)[:2]
        names = [x for i in (16, 1) if b"name" in t and (x := name_text(t[b"name"], i)) is not None]
        self.family = names[0] if names else ""

    def load(self) -> Font:
        key = (self.digest, self.index)
        if key not in _loaded:
            if len(_loaded) >= MOST_LOADED:
                _loaded.clear()
            _loaded[key] = Font.parse(self.raw, self.index)
        return _loaded[key]


#: Fonts that a process keeps.
MOST_LOADED = 256
_loaded: dict[tuple[bytes, int], Font] = {}


def described(raw: bytes) -> list[FontFile]:
    """All faces of a file whose tables can be found; what else is wrong with one shows when it is loaded."""
    out = []
    try:
        for i in range(min(face_count(raw), MOST_FACES)):
            try:
                out.append(FontFile(raw, i))
            except (BadFont, KeyError):
                continue
    except BadFont:
        pass
    return out


class Faces:
    """Fonts to choose from, whole ones or files of which only the chosen are loaded."""

    def __init__(self, fonts: list[Font | FontFile]):
        self.fonts = list(fonts)
        self.chosen: dict[tuple, Font | None] = {}

    def query(self, family: str, weight: int, italic: bool = False) -> Font | None:
        """The face of a family nearest in style, then in weight: lighter ones first up to 500, heavier ones first above. A file that can't be loaded is no face."""
        key = (family, weight, italic)
        if key not in self.chosen:
            name = GENERIC.get(family.lower(), family).lower()
            near = [f for f in self.fonts if f.family.lower() == name]

            def distance(f: Font | FontFile) -> tuple[bool, int]:
                d = f.weight - weight
                return f.italic != italic, abs(d) + (1000 if (d > 0 if weight <= 500 else d < 0) else 0)

            self.chosen[key] = next(filter(None, map(_whole, sorted(near, key=distance))), None)
        return self.chosen[key]


def _whole(f: Font | FontFile) -> Font | None:
    try:
        return f.load() if isinstance(f, FontFile) else f
    except BadFont:
        return None
