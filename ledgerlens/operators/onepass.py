"""The whole way from pages to fields in plain Python, one document at a time; ``lines`` and ``resolve`` run it over Arrow batches.

The patterns are those of ``lines``, ``resolve`` and ``words`` as the JVM reads them. A text of tame characters means the same to Python's
own classes; any other text is read with the JVM's classes spelled out. Amounts are integers of millionths. No pattern tells one of the
figures 0 to 9 from another, so what patterns find in a line is remembered by its shape: the line with 0 for every figure.
"""

from __future__ import annotations

import datetime
import functools
import gc
import re
import sys
import unicodedata
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation
from itertools import combinations

import pyarrow as pa

from ledgerlens.functions import amounts as A
from ledgerlens.functions import dates as D
from ledgerlens.functions import words as W

# White space as Unicode has it, the JVM's without (?U), and how many texts are remembered by each function.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_BLANKS, REMEMBERED = r" \t\n\x0b\x0c\r", 20_000
_ODD = "\u0130\u0131\u0138\u0149"
#: Texts in which Python's \w, \b, \s, the point and letters without regard to case are those of the JVM under (?iuU).
TAME = re.compile("[" + re.escape("".join(c for c in map(chr, [9, 10, *range(32, 127), 0xA0, 0xAA, 0xB0, 0xBA, *range(0xC0, 0x17F)]) if c not in _ODD) + "€£¥₹₩₺₽₪₫฿–—‘’“”\u202f\u2212") + "]*")
tame = TAME.fullmatch
remembered = functools.lru_cache(REMEMBERED)


@functools.lru_cache(None)
def _classes() -> dict[str, str]:
    """Bodies of the JVM's classes for ``[...]``."""

    def body(test) -> str:
        out, start = [], None
        for code in range(sys.maxunicode + 2):
            held = code <= sys.maxunicode and test(chr(code))
            if held and start is None:
                start = code
            elif not held and start is not None:
                out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        return "".join(out)

    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    letter = lambda c: kinds[ord(c)][0] in "LM" or kinds[ord(c)] in ("Nl", "Pc") or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ" or any(a <= ord(c) <= b for a, b in ((0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)))
    return {"w": body(lambda c: letter(c) or kinds[ord(c)] == "Nd"), "letter": body(lambda c: letter(c) and c != "_"), "L": body(lambda c: kinds[ord(c)][0] == "L"), "N": body(lambda c: kinds[ord(c)][0] == "N")}


_FLAGS = re.compile(r"\(\?([iuUs]+)\)")
_PIECE = re.compile(r"\\Q.*?\\E|\[\^\\W\\d_\]|\\p\{(\w)\}|\\.|\[\^?|\]|.", re.S)


class Pattern:
    """A pattern of the JVM for Python: ``of`` a text gives the compiled form that means the same for it."""

    def __init__(self, source: str):
        flags = "".join(_FLAGS.findall(source))
        self.source, self.wide = _FLAGS.sub("", source), "U" in flags
        self.flags = (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0)
        self.quick = re.compile(self._read(False), self.flags)

    @functools.cached_property
    def exact(self) -> re.Pattern:
        return re.compile(self._read(True), self.flags)

    def _read(self, exact: bool) -> str:
        out, inside = [], False
        for m in _PIECE.finditer(self.source):
            x = m[0]
            if x.startswith("\\Q"):
                x = re.escape(x[2:-2])
            elif m[1]:  # a letter or figure; tame texts have no other figures than 0 to 9
                x = (_classes()[m[1]] if exact else r"0-9" if m[1] == "N" else _TAME_LETTERS) if inside else f"[{_classes()[m[1]] if exact else '0-9' if m[1] == 'N' else _TAME_LETTERS}]"
            elif x in (r"\d", r"\s") and not self.wide:
                x = ("0-9" if x == r"\d" else _ASCII_BLANKS) if inside else f"[{'0-9' if x[1] == 'd' else _ASCII_BLANKS}]"
            elif x in ("[", "[^"):
                inside = True
            elif x == "]":
                inside = False
            elif exact:
                word = f"[{_classes()['w']}]" if x == r"\b" else ""
                if x == r"[^\W\d_]":
                    x = f"[{_classes()['letter']}]"
                elif x == r"\w":
                    x = _classes()["w"] if inside else f"[{_classes()['w']}]"
                elif x == r"\s":
                    x = BLANKS if inside else f"[{BLANKS}]"
                elif x == r"\b":
                    x = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
                elif x == "." and not inside and not self.flags & re.S:
                    x = r"[^\n\r\x85\u2028\u2029]"
                elif x == "$" and not inside:
                    x = r"(?:\Z|(?=(?:\r\n|[\r\x85\u2028\u2029])\Z)|(?<!\r)(?=\n\Z))"
            out.append(x)
        return "".join(out)

    def of(self, text: str) -> re.Pattern:
        return self.quick if tame(text) else self.exact

    def search(self, text: str) -> re.Match | None:
        return self.of(text).search(text)


_TAME_LETTERS = "A-Za-zªº" + "".join(chr(c) for c in range(0xC0, 0x17F) if chr(c).isalpha() and chr(c) not in _ODD)


def lower(x: str) -> str:
    return x.lower().replace("ß", "ss")


_FOLD = str.maketrans(W.ACCENTED, W.UNACCENTED)
_NO_WORD, _ODD_BLANKS, _BLANK_RUN = re.compile(r"[\W_]+"), re.compile("[\x1c-\x1f]"), re.compile(f"[{BLANKS}]+")


@remembered
def fold(x: str) -> str:
    x = lower(x)
    return x if x.isascii() else x.translate(_FOLD)


@remembered
def canon(x: str) -> str:
    return _NO_WORD.sub("", fold(x))


@remembered
def squash(x: str) -> str:
    x = lower(x)
    return " ".join(x.split()) if _ODD_BLANKS.search(x) is None else _BLANK_RUN.sub(" ", x).strip(" ")


def strip(x: str) -> str:
    return x.strip(BLANKS)


def normal_text(x: str | None) -> str | None:
    if x is None:
        return None
    one = x if x.isascii() and x.isprintable() and "  " not in x else _BLANK_RUN.sub(" ", x)
    return one.strip(" :;,") or None


def is_label(x: str) -> bool:
    return any(map(str.isalpha, x)) and not any(c.isnumeric() and not c.isalpha() for c in x)


# ---- amounts

_TOKEN = re.compile(A.TOKEN, re.A)
_LAST_POINT, _SEVERAL, _GROUPED, _THREE_FIGURES, _TWO_FIGURES, _EXACT = (re.compile(p, re.A) for p in (r"\.[^,]*\Z", r"\d*[.,]\d*[.,]", r"\d*(?:[.,]\d{3})+\Z", r"[.,]\d{3}\Z", r"[.,]\d{1,2}\Z", r"[.,]\d{2}\Z"))
_WIDE, _MOST = Context(prec=400), 10**38


def millionths(text: str) -> int | None:
    whole, _, part = text.partition(".")
    if len(part) <= 6 and (whole + part).isdigit():
        n = int(whole + part) * 10 ** (6 - len(part))
    else:
        try:
            n = int(_WIDE.multiply(Decimal(text), 10**6).to_integral_value(ROUND_HALF_UP)) if re.fullmatch(r"[\d.]+", text) else None
        except (InvalidOperation, ValueError):
            return None
    return n if n is not None and n < _MOST else None


def parse_amount(token: str, three: bool = False) -> tuple[int, bool] | None:
    """Value and whether it is ambiguous."""
    d = token.lstrip("-").translate(_NO_GROUPS)
    point, comma = "." in d, "," in d
    unsure = False
    if point and comma:
        text = d.replace(",", "") if _LAST_POINT.search(d) else d.replace(".", "").replace(",", ".")
    elif not point and not comma:
        text = d
    elif _SEVERAL.match(d):
        text = d.replace(".", "").replace(",", "") if _GROUPED.match(d) else None
    elif _THREE_FIGURES.search(d):
        text = d if point and three else d.replace(".", "").replace(",", "")
        unsure = d[:-4].isdecimal() if d[:-4] else True
        unsure = unsure and not (point and three)
    elif _TWO_FIGURES.search(d):
        text = d.replace(",", ".")
    else:
        text = None
    value = None if text is None else millionths(text)
    return None if value is None else (-value if token[:1] == "-" else value, unsure)


_NO_GROUPS = str.maketrans("", "", A.GROUPS)


def amount_spans(text: str, three: bool) -> tuple[tuple, ...]:
    """``(start, end, factor, negative, ambiguous, mark)`` of each amount of a shape; ``factor`` makes millionths of its figures, 0 if it
    is too long or too fine for that. ``mark`` is ( or - where a positive number would be negative."""
    text = text.replace("\u2212", "-")
    out = []
    for m in _TOKEN.finditer(text):
        i, j = m.span()
        before, after = text[i - 1 : i] if i else "", text[j : j + 2]
        if before.isalnum() or after[:1].isalpha() or after[:1] == "%":
            continue
        token = m[0]
        a = parse_amount(token.replace("0", "1"), three)  # not 0, so that the value has all of the figures
        if a is None and sum(map(str.isdigit, token)) <= 30:
            continue
        figures = token.translate(_ONLY_FIGURES)
        factor = 0
        if a is not None and len(figures) <= 30:
            factor, rest = divmod(abs(a[0]), int(figures.replace("0", "1")))
            factor = 0 if rest else factor
        mark = ""
        if _EXACT.search(token) and token[:1] != "-":
            mark = "(" if before == "(" and after[:1] == ")" else "-" if after[:1] == "-" and not ("0" <= after[1:] <= "9") else ""
        out.append((i, j, factor, token[:1] == "-", a is not None and a[1], mark))
    return tuple(out)


@remembered
def find_amounts(text: str, three: bool = False) -> tuple[tuple[int, bool, str], ...]:
    """Value, ambiguous and token of each amount."""
    s = shape(text)
    out = []
    for i, j, factor, negative, unsure, mark in s.three_amounts if three else s.amounts:
        token = text[i:j].replace("\u2212", "-")
        if factor:
            figures = token.replace(",", "").replace(".", "")
            value = int(figures if figures.isdecimal() else token.translate(_ONLY_FIGURES)) * factor
        else:
            a = parse_amount(token, three)
            if a is None:
                continue
            value, unsure = abs(a[0]), a[1]
        if negative:
            value = -value
        elif mark and value:
            value, token = -value, f"({token})" if mark == "(" else f"{token}-"
        out.append((value, unsure, token))
    return tuple(out)


def is_sum(value: int, amounts) -> bool:
    pool = [abs(a[0]) for a in amounts if a[0]][:10]
    return any(sum(c) == abs(value) for n in range(2, 7) for c in combinations(pool, n))


# ---- currencies and tax ids

_CODES, _SYMBOLS = Pattern(r"(?U)\b[A-Z]{3}\b"), re.compile("|".join(re.escape(s) for s, _, _ in W.SYMBOLS))
_ISO, _OF, _SHARED = frozenset(W.ISO_CURRENCIES), {s: c for s, c, _ in W.SYMBOLS}, {s for s, _, a in W.SYMBOLS if a}
_WORDS = [(Pattern(p), c, a) for p, c, a in W.CURRENCY_WORDS]
_ANY_WORD = re.compile(r"zł|zlot|Kč|Ft|forint|kr|Fr\.|franc|franken|euro|pound|dollar|rupee|yen", re.I)
_THREE_CODES = Pattern(rf"(?U)\b(?:{'|'.join(W.THREE_DECIMALS)})\b")
_US, _EU = Pattern(A._US_ADDRESS), Pattern(A._EU_VAT)
_VAT, _US_STEM = frozenset(W.VAT_PREFIXES), re.compile(r"[A-Z][A-Z]\s+\d{5}")
_COUNTRY, _NEXT_LABEL, _MARKS, _HEAD = Pattern(r"^\s*\([A-Z]{2}\)\s*"), Pattern(r"(?sU)\s+(?:NIF|CIF|VAT|TVA|IVA|UID|NIP|TIN|TRN|UST-?IDNR)\b.*$"), re.compile(f"[{BLANKS}.\\-]"), re.compile(r"[A-Z0-9]+")
_SPANISH = re.compile(r"(?:[A-Z][0-9]{7}[A-Z0-9]|[0-9]{8}[A-Z]|[0-9]{9})\Z")


@remembered
def find_currencies(text: str) -> tuple[tuple[str, bool], ...]:
    """Code and whether it is shared: codes, then symbols, then written names."""
    plain = tame(text)
    out = [(m, False) for m in (_CODES.quick if plain else _CODES.exact).findall(text) if m in _ISO]
    if not text.isascii() or "$" in text:
        out += [(_OF[m], m in _SHARED) for m in _SYMBOLS.findall(text)]
    if not plain or _ANY_WORD.search(text):
        out += [(c, a) for p, c, a in _WORDS for _ in (p.quick if plain else p.exact).finditer(text)]
    return tuple(out)


def normal_currency(raw: str | None) -> str | None:
    if raw is None:
        return None
    found = find_currencies(raw) or find_currencies(raw.upper())
    return found[0][0] if found else None


def normal_tax_id(raw: str) -> str | None:
    c = text = raw.upper()
    if not (c.isascii() and c.isalnum()):
        text = _COUNTRY.of(text).sub("", text)
        text = _NEXT_LABEL.of(text).sub("", text)
        m = _HEAD.match(_MARKS.sub("", text))
        c = m[0] if m else ""
    n = len(c)
    if (c[:2] in _VAT and 10 <= n <= 14) or _SPANISH.match(c) or (8 <= n <= 20 and sum(map(str.isdigit, c)) >= 5):
        return c
    return None


def same_tax_id(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return False
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return a == b or (longer[:2] in _VAT and longer[2:] == shorter)


# ---- dates

_YMD, _CJK, _NUMERIC, _DAY_MONTH, _MONTH_DAY = (Pattern(f[0]) for f in (D.YMD, D.CJK, D.NUMERIC, D.DAY_MONTH, D.MONTH_DAY))
_FORMS = tuple((p, f[1:], f is D.NUMERIC, f in (D.DAY_MONTH, D.MONTH_DAY)) for p, f in zip((_YMD, _CJK, _NUMERIC, _DAY_MONTH, _MONTH_DAY), (D.YMD, D.CJK, D.NUMERIC, D.DAY_MONTH, D.MONTH_DAY), strict=True))
_FIGURE, _MONTH = re.compile(r"\d"), re.compile("|".join(sorted({m[:3] for m in W.MONTHS})))
_TITLE_SPLIT, _CREDIT = re.compile("\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), Pattern(W.CREDIT_NOTE)


def real_date(y: int, m: int | None, d: int) -> datetime.date | None:
    try:
        return datetime.date(y, m, d) if m else None
    except ValueError:
        return None


def number(x: str) -> int:
    return int(x) if x.isascii() else 0


def date_spans(text: str) -> tuple[tuple, ...]:
    if not _FIGURE.search(text):
        return ()
    plain = tame(text)
    marks = "-" in text or "/" in text or "." in text
    named = not plain or _MONTH.search(fold(text))
    out = []
    for rank, (p, (y, m, d), both, by_name) in enumerate(_FORMS):
        if plain and not (named if by_name else marks and rank != 1):
            continue
        for x in (p.quick if plain else p.exact).finditer(text):
            month = W.MONTHS.get(fold(x[m])) if by_name else x.span(m)
            if month is None or not (x[y] + x[d] + ("" if by_name else x[m])).isascii() or (both and x[2] == "-" and len(x[y]) == 2):
                continue
            out.append((x.start(), rank, x.end(), both, x.span(y), month, x.span(d)))
    return tuple((start, *rest) for start, _, *rest in sorted(out, key=lambda x: x[:2]))


@remembered
def readings(text: str) -> list[tuple[str, tuple[datetime.date, ...]]]:
    """Each date as it is written, with its readings, in the order of the text."""
    out = []
    for start, end, both, y, m, d in shape(text).dates:
        year, day = int(text[y[0] : y[1]]), int(text[d[0] : d[1]])
        month = m if isinstance(m, int) else int(text[m[0] : m[1]])
        year += 2000 if year < 70 else 1900 if year < 100 else 0
        dates = [t for t in (real_date(year, month, day), real_date(year, day, month) if both and day != month else None) if t is not None]
        if dates:
            out.append((text[start:end], dates))
    return out


def pick_reading(dates, order: str | None) -> datetime.date:
    return dates[-1] if order == "MDY" else dates[0]


class Signs:
    """What the whole document says: order of dates, decimals, credit note, dollars; and its squashed text."""

    def __init__(self, text: str):
        self.text, plain = text, tame(text)
        form = lambda p: p.quick if plain else p.exact
        us = (not plain or _US_STEM.search(text) is not None) and form(_US).search(text) is not None
        eu = "€" in text or "£" in text or form(_EU).search(text) is not None
        pairs = [(number(m[1]), number(m[3])) for m in form(_NUMERIC).finditer(text)]
        day, month = any(a > 12 >= b for a, b in pairs), any(b > 12 >= a for a, b in pairs)
        self.order = None if day and month else "DMY" if day else "MDY" if month else "MDY" if us and not eu else "DMY" if eu and not us else None
        self.three = any(c in text for c in W.THREE_DECIMALS) and form(_THREE_CODES).search(text) is not None
        self.dollar = "USD" if us and not eu else None
        self.credit = False
        if not plain or _CREDIT.quick.search(text):
            head = "\n".join([x for x in _TITLE_SPLIT.split(text) if strip(x)][: W.TITLE_LINES])
            self.credit = _CREDIT.search(head) is not None

    @functools.cached_property
    def squashed(self) -> str:
        return squash(self.text)


# ---- lines


@functools.lru_cache(None)
def _line_patterns() -> tuple[Pattern, ...]:
    from ledgerlens.operators import lines as L

    return tuple(map(Pattern, (
        L.BILL_TO, L.SUPPLIER, L.I + L.LEGAL_SUFFIX, L.NUMBER, L.DATE_SPECIFIC, L.DATE_GENERIC, L.DUE, L.TOTAL, L.TOTAL_STRONG, L.NOT_TOTAL, L.TAX_LABEL, L.SUBTOTAL, L.TAX_AMOUNT,
        L.TAX_ID_LINE, L.VALUE_ONLY, L.WITHHOLDING, L.SECTION, L.VALUE_DATE, L.I + "^(.*?" + L.LEGAL_SUFFIX + ")",
    )))


(BILL_TO, SUPPLIER, LEGAL, NUMBER, DATE_SPECIFIC, DATE_GENERIC, DUE, TOTAL, TOTAL_STRONG, NOT_TOTAL, TAX_LABEL, SUBTOTAL, TAX_AMOUNT, TAX_ID_LINE, VALUE_ONLY, WITHHOLDING, SECTION, VALUE_DATE, NAMED) = _line_patterns()
# Stems without one of which a tame line can't match; all of it in lower case.
_NUMBER_STEM = re.compile("invoice|factu|fattura|faktu|fatura|rechnung")
_SUM_STEM = re.compile("tota|amount|importe|gesamt|rechnung|endbetrag|zahlen|payer|betalen|montant|valor|sub|net|tax|imponib|zwischen|vat|iva|igic|tva|mwst|ust|btw|gst|hst|moms")
_TAX_STEM = re.compile("vat|tax|nif|cif|ust")


class Shape:
    """What the patterns find in a line, as spans; each is looked for once, when it is first asked for."""

    def __init__(self, text: str):
        self.text, self.plain = text, tame(text) is not None

    def search(self, p: Pattern) -> re.Match | None:
        return (p.quick if self.plain else p.exact).search(self.text)

    def has(self, p: Pattern) -> bool:
        return self.search(p) is not None

    def stem(self, p: re.Pattern) -> bool:
        return not self.plain or p.search(self.text.lower()) is not None

    @functools.cached_property
    def opens(self) -> bool:
        return self.has(BILL_TO)

    @functools.cached_property
    def supplier(self) -> tuple[int, int] | None:
        """Where the rest after a supplier's label stands, blanks at its ends aside."""
        m = self.search(SUPPLIER)
        return m and (m.end(1) - len(m[1].lstrip(BLANKS)), m.start(1) + len(m[1].rstrip(BLANKS)))

    @functools.cached_property
    def ends(self) -> bool:
        return not self.opens and (self.text == "" or self.supplier is not None or self.has(SECTION))

    @functools.cached_property
    def is_label(self) -> bool:
        return is_label(self.text)

    @functools.cached_property
    def letter(self) -> str:
        return "L" if self.is_label else "V" if self.has(VALUE_ONLY) else "-"

    @functools.cached_property
    def sums(self) -> tuple[bool, bool, bool, bool]:
        """Whether a line has a total, a sure one, a subtotal and a tax."""
        if not self.stem(_SUM_STEM):
            return False, False, False, False
        total = self.has(TOTAL) and not self.has(NOT_TOTAL)
        return total, total and self.has(TOTAL_STRONG), self.has(SUBTOTAL), self.has(TAX_AMOUNT) and not self.has(WITHHOLDING) and not self.has(TAX_ID_LINE)

    @functools.cached_property
    def number(self) -> tuple[int, int] | None:
        m = self.search(NUMBER) if self.stem(_NUMBER_STEM) else None
        return m and m.span(1)

    @functools.cached_property
    def tax_label(self) -> tuple[int, int, bool] | None:
        """Where what follows a tax label stands, if it reads as a tax id; and whether that is one to the letter."""
        m = self.search(TAX_LABEL) if self.stem(_TAX_STEM) else None
        found = m and normal_tax_id(m[1])
        return (*m.span(1), found == m[1]) if found else None

    @functools.cached_property
    def suffixed(self) -> bool:
        return self.has(LEGAL)

    @functools.cached_property
    def tier(self) -> int:
        return 9 if self.has(DUE) else 0 if self.has(DATE_SPECIFIC) else 1 if self.has(DATE_GENERIC) else 2

    @functools.cached_property
    def is_date(self) -> bool:
        return self.has(VALUE_DATE)

    @functools.cached_property
    def named(self) -> tuple[int, int] | None:
        """Where the name with a legal form stands, without the label of the customer block."""
        m = (BILL_TO.quick if self.plain else BILL_TO.exact).search(self.text)
        rest = (self.text[m.end() :] if m else self.text).lstrip(" :")
        at = len(self.text) - len(rest)
        m = NAMED.search(rest) if rest else None
        return (at + len(m[1]) - len(m[1].lstrip(BLANKS)), at + len(m[1].rstrip(BLANKS))) if m and strip(m[1]) else None

    @functools.cached_property
    def is_customer(self) -> bool:
        return self.has(_roles()[0])

    @functools.cached_property
    def is_supplier(self) -> bool:
        return self.has(_roles()[8])

    @functools.cached_property
    def currencies(self) -> tuple[tuple[str, bool], ...]:
        return find_currencies(self.text)

    @functools.cached_property
    def dates(self) -> tuple[tuple, ...]:
        """``(start, end, both readings, year, month, day)`` of each date in order, the last three as spans or as the number of a month."""
        return date_spans(self.text)

    @functools.cached_property
    def amounts(self) -> tuple[tuple, ...] | None:
        return amount_spans(self.text, False)

    @functools.cached_property
    def three_amounts(self) -> tuple[tuple, ...] | None:
        return amount_spans(self.text, True)


_ZEROS, _ONLY_FIGURES = bytes.maketrans(b"123456789", b"000000000"), str.maketrans("", "", " \u00a0\u202f'\u2019.,-")


@remembered
def shape_of(zeros: str) -> Shape:
    return Shape(zeros)


def zeros_of(text: str) -> str:
    return text.encode().translate(_ZEROS).decode()  # many times as fast as translating characters


@remembered
def shape(text: str) -> Shape:
    return shape_of(zeros_of(text))


def first_of(found: list[tuple], unsure: bool = False) -> tuple | None:
    """The first of ``(raw, evidence, page)`` as a candidate."""
    if not found:
        return None
    several = len(found) > 1 and len({canon(x[0]) for x in found}) > 1
    return (*found[0], several or unsure)


def last_amount(rows: list[tuple], which: int, strong: int | None = None) -> tuple | None:
    found = []
    for page, text, evidence, s in rows:
        if s.sums[which] and (a := find_amounts(text)):
            found.append((a[-1][2], evidence, page, strong is None or s.sums[strong]))
    if not found:
        return None
    chosen = [x for x in found if x[3]] or found
    return (*chosen[-1][:3], len(chosen) > 1 and len({parse_amount(x[0]) for x in chosen}) > 1)


def tax_ids(lines: list[tuple]) -> tuple | None:
    found = []
    for page, t, s in lines:
        if s.tax_label:
            i, j, plain = s.tax_label
            found.append((t[i:j] if plain else normal_tax_id(t[i:j]), t, page))
    return first_of(found)


def supplier(lines: list[tuple], inside: list[bool]) -> tuple | None:
    for i, (page, t, s) in enumerate(lines):
        if s.supplier is not None and not inside[i]:
            if here := t[s.supplier[0] : s.supplier[1]]:
                return here, t, page, False
            after = next((x for x in lines[i + 1 :] if x[1]), None)
            if after:
                return after[1], after[1], after[0], False
    return first_of([(t, t, page) for i, (page, t, s) in enumerate(lines) if s.suffixed and not inside[i]])


def invoice_date(own: list[tuple]) -> tuple | None:
    dated, before = [], None
    for page, t, s in own:
        if not t:
            continue
        if s.dates and (found := readings(t)):
            alone = before is not None and before[2].is_label and s.is_date
            k = shape(f"{before[1]} {t}").tier if alone else s.tier
            if k < 9:
                dated += [(k, (raw, f"{before[1]}\n{t}" if alone else t, page)) for raw, _ in found]
        before = page, t, s
    if not dated:
        return None
    top = min(k for k, _ in dated)
    return first_of([x for k, x in dated if k == top], top == 2)


def currency(own: list[tuple], total: tuple | None) -> tuple | None:
    near = shape(total[1]).currencies if total else ()
    if near:
        return next((c for c, a in near if not a), near[0][0]), total[1], total[2], False
    named = [(c, t, page) for page, t, s in own for c, _ in s.currencies]
    if not named:
        return None
    counts: dict[str, int] = {}
    for c, _, _ in named:
        counts[c] = counts.get(c, 0) + 1
    code = max(counts, key=counts.get)  # the first of equals
    return (*next(x for x in named if x[0] == code), len(counts) > 1)


def customer_name(block: list[tuple]) -> tuple | None:
    return next(((t[s.named[0] : s.named[1]], t, page, False) for page, t, s in block if s.named), None)


_RUN = re.compile("(L+)(V+)")


def propose(pages: list[str | None] | None) -> list[tuple | None]:
    """Ten candidates ``(raw, evidence, page, ambiguous)`` or null."""
    pages = pages or []
    if any(p is None for p in pages):
        return [None] * len(W.FIELDS)
    lines = [(k, strip(x), shape_of(strip(z))) for k, p in enumerate(pages, 1) for x, z in zip(p.split("\n"), zeros_of(p).split("\n"), strict=True)]
    inside, left = [], 0
    for _, _, s in lines:
        left = 6 if s.opens else 0 if s.ends else left
        inside.append(left > 0)
        left -= left > 0
    own = [x for x, i in zip(lines, inside, strict=True) if not i]
    block = [x for x, i in zip(lines, inside, strict=True) if i]
    rows = [(page, t, t, s) for page, t, s in own]
    for m in _RUN.finditer("".join([s.letter for _, _, s in own])):
        n = len(m[2])
        if n <= len(m[1]):
            for k in range(n):
                (page, a, _), (_, b, _) = own[m.start(2) - n + k], own[m.start(2) + k]
                rows.append((page, f"{a} {b}", f"{a}\n{b}", shape(f"{a} {b}")))
    total = last_amount(rows, 0, 1)
    return [
        supplier(lines, inside), first_of([(t[s.number[0] : s.number[1]], t, page) for page, t, s in own if s.number]), invoice_date(own), total, currency(own, total), tax_ids(own),
        last_amount(rows, 2), last_amount(rows, 3), customer_name(block), tax_ids(block),
    ]


# ---- fields

HIGH, AMBIGUOUS, UNGROUNDED, MISSING = 1.0, 0.6, 0.3, 0.0
_ID_BEFORE, _ID_AFTER = re.compile(r"(?<![0-9A-Z/\-])(?<![0-9A-Za-z][/\-])"), re.compile(r"(?![0-9a-z])(?![A-Z](?![a-z]))(?![/\-][0-9A-Za-z])")
_PLAIN_ID = re.compile(r"[0-9A-Za-z \t\n\x0b\x0c\r.\-/]+")
_ID_MARKS, _NAME_ENDS = re.compile(rf"[{_ASCII_BLANKS}.\-/]*"), re.compile(r"\A[\W_]+|[\W_]+\Z")


@functools.lru_cache(1_000)
def _whole(body: str, before: str, after: str) -> re.Pattern:
    return re.compile(before + body + after)


def whole_match(is_id: bool, value: str, evidence: str) -> bool:
    """Whether the value stands in the evidence as a whole. Where it stands as it is, only its ends are looked at; else a pattern is made."""
    if not is_id:
        value, evidence = fold(value), fold(evidence)
    body = _NAME_ENDS.sub("", value)
    if not body:
        return False
    if not is_id or all(c.isalnum() or c in " \t\n\x0b\x0c\r.-/" for c in body):
        i = evidence.find(body)
        while i >= 0:
            j = i + len(body)
            if is_id:
                if _ID_BEFORE.match(evidence, i) and _ID_AFTER.match(evidence, j):
                    return True
            elif not (_is_plain(evidence[i - 1 : i]) if i else False) and not _is_plain(evidence[j : j + 1]):
                return True
            i = evidence.find(body, i + 1)
    chars = [c for c in value if c.isalnum()]
    if is_id:
        return _whole("(?i:" + _ID_MARKS.pattern.join(chars) + ")", _ID_BEFORE.pattern, _ID_AFTER.pattern).search(evidence) is not None
    return _whole("[^0-9a-z]*".join(chars), "(?<![0-9a-z])", "(?![0-9a-z])").search(evidence) is not None


def _is_plain(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def grounded(evidence: str, s: Signs) -> bool:
    if evidence in s.text and not evidence[0].isspace() and not evidence[-1].isspace() and "Σ" not in evidence:  # it stays in the text when both are squashed
        return True
    squashed = s.squashed
    if squash(evidence) in squashed:
        return True
    lines = [x for x in _TITLE_SPLIT.split(evidence) if strip(x)]
    return len(lines) > 1 and all(squash(x) in squashed for x in lines)


def support(field: str, value, evidence: str, s: Signs) -> tuple[bool, bool]:
    """Whether the evidence has the value, and whether it can be read otherwise too."""
    if field == "invoice_date":
        for _, dates in readings(evidence):
            if value in dates if s.order is None else pick_reading(dates, s.order) == value:
                return True, s.order is None and len(dates) > 1
        return False, False
    if field in W.AMOUNT_FIELDS:
        found = find_amounts(evidence, s.three)
        hits = [a[1] for a in found if a[0] == value or (s.credit and a[0] == -value)]
        if hits:
            return True, all(hits)
        summed = field == "tax_amount" and is_sum(value, found)
        return summed, summed
    if field == "currency":
        hits = [a for c, a in shape(evidence).currencies if c == value]
        return bool(hits), bool(hits) and all(hits) and s.dollar != value
    if evidence.isascii() and value[:1].isalnum() and value[-1:].isalnum() and (i := evidence.find(value)) >= 0:  # as it is; most often between other characters
        j = i + len(value)
        if not evidence[i - 1 : i].isalnum() and not evidence[j : j + 1].isalnum() and (field not in W.ID_FIELDS or (_PLAIN_ID.fullmatch(value) and (i == 0 or evidence[i - 1] == " ") and j == len(evidence))):
            return True, False
    inside = canon(value) != "" and canon(value) in canon(evidence)
    return inside, inside and not whole_match(field in W.ID_FIELDS, value, evidence)


@functools.lru_cache(None)
def _roles() -> dict[int, Pattern]:
    from ledgerlens.operators.resolve import CUSTOMER_LABEL, SUPPLIER_LABEL

    customer, supplier_ = Pattern(CUSTOMER_LABEL), Pattern(SUPPLIER_LABEL)
    return {0: customer, 5: customer, 8: supplier_, 9: supplier_}


def in_role(k: int, evidence: str) -> bool:
    return shape(evidence).is_customer if k < 8 else shape(evidence).is_supplier


def resolve(candidates: list[tuple | None], pages: list[str | None] | None) -> list[tuple]:
    """Ten fields ``(value, confidence, evidence, page)``; amounts in millionths."""
    s = Signs("\n".join([p for p in pages or [] if p is not None]))
    values, levels, kept = [], [], []
    for f, c in zip(W.FIELDS, candidates, strict=True):
        raw, evidence, _, ambiguous = c or (None, None, None, None)
        raw = raw or None
        value = None
        if raw is None:
            pass
        elif f == "invoice_date":
            value = pick_reading(r[0][1], s.order) if (r := readings(raw)) else None
        elif f in W.AMOUNT_FIELDS:
            value = r[-1][0] if (r := find_amounts(raw, s.three)) else None
            value = -value if value is not None and s.credit and value > 0 else value
        elif f == "currency":
            value = normal_currency(raw)
        elif f in ("tax_id", "customer_tax_id"):
            value = normal_tax_id(raw)
        else:
            value = normal_text(raw)
        if value is None:
            level = MISSING if raw is None else UNGROUNDED
        elif not evidence or not grounded(evidence, s):
            level = UNGROUNDED
        else:
            ok, unsure = support(f, value, evidence, s)
            level = UNGROUNDED if not ok else AMBIGUOUS if ambiguous or unsure else HIGH
        values.append(value)
        levels.append(level)
        kept.append(evidence if raw is not None else None)
    total, sub, tax = values[3], values[6], values[7]
    if levels[7] == AMBIGUOUS and levels[6] == levels[3] == HIGH and abs(sub + tax - total) <= 10_000:
        levels[7] = HIGH
    same = (values[0] is not None and values[8] is not None and canon(values[0]) == canon(values[8])) or same_tax_id(values[5], values[9])
    for k in (0, 5, 8, 9):
        if levels[k] == HIGH and (same or in_role(k, kept[k])):
            levels[k] = AMBIGUOUS
    squashed = None
    out = []
    for k, c in enumerate(candidates):
        page = c[2] if c else None
        if page is None and pages and kept[k] is not None and (needle := squash(kept[k])):
            squashed = squashed or [None if p is None else squash(p) for p in pages]
            page = next((n for n, p in enumerate(squashed, 1) if p is not None and needle in p), None)
        out.append((values[k], levels[k], kept[k], page))
    return out


# ---- Arrow


def _struct(columns: list[pa.Array], names: tuple[str, ...], absent: list[bool] | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays(columns, list(names), mask=None if absent is None else pa.array(absent, pa.bool_()))


def _decimals(values: list[int | None]) -> pa.Array:
    held = pa.array([v is not None for v in values], pa.bool_())
    data = b"".join([(v or 0).to_bytes(16, "little", signed=True) for v in values])
    return pa.Array.from_buffers(pa.decimal128(38, 6), len(values), [held.buffers()[1], pa.py_buffer(data)])


_KINDS = {f: _decimals if f in W.AMOUNT_FIELDS else functools.partial(pa.array, type=pa.date32() if f == "invoice_date" else pa.string()) for f in W.FIELDS}


def candidate_array(rows: list[list[tuple | None]]) -> pa.StructArray:
    columns, none = [], (None, None, None, None)
    for column in zip(*rows, strict=True) if rows else [()] * len(W.FIELDS):
        parts = list(zip(*[c or none for c in column], strict=True)) or [()] * 4
        columns.append(_struct([pa.array(x, t) for x, t in zip(parts, (pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)], ("raw", "evidence", "page", "ambiguous"), [c is None for c in column]))
    return _struct(columns, W.FIELDS)


def field_array(rows: list[list[tuple]]) -> pa.StructArray:
    columns = []
    for f, column in zip(W.FIELDS, zip(*rows, strict=True) if rows else [()] * len(W.FIELDS), strict=True):
        value, level, evidence, page = list(zip(*column, strict=True)) or [()] * 4
        columns.append(_struct([_KINDS[f](value), pa.array(level, pa.float64()), pa.array(evidence, pa.string()), pa.array(page, pa.int32())], ("value", "confidence", "evidence", "page")))
    return _struct(columns, W.FIELDS)


def _quietly(make):
    """``make`` without the garbage collector, which has nothing to find in a batch's tuples and looks for long."""

    @functools.wraps(make)
    def made(*arrays: pa.Array) -> pa.Array:
        on = gc.isenabled()
        gc.disable()
        try:
            return make(*arrays)
        finally:
            if on:
                gc.enable()

    return made


@_quietly
def proposed(pages: pa.Array) -> pa.Array:
    return candidate_array([propose(p) for p in pages.to_pylist()])


@_quietly
def resolved(candidates: pa.Array, pages: pa.Array) -> pa.Array:
    by_field = [list(zip(*[x.to_pylist() for x in c.flatten()], strict=True)) for c in candidates.flatten()]
    return field_array([resolve(list(c), p) for c, p in zip(zip(*by_field, strict=True), pages.to_pylist(), strict=True)])


@_quietly
def extracted_fields(pages: pa.Array) -> pa.Array:
    return field_array([resolve(propose(p), p) for p in pages.to_pylist()])


@_quietly
def extracted(pages: pa.Array) -> pa.Array:
    given = pages.to_pylist()
    found = [propose(p) for p in given]
    return _struct([candidate_array(found), field_array([resolve(c, p) for c, p in zip(found, given, strict=True)])], ("candidates", "fields"))
