"""Personal information inside free text: finding it, and replacing it with typed placeholders.

Validated numbers (phone numbers, identity numbers with their birth dates) and dates are permuted within
their format by a keyed Feistel network, so that equal values stay linked across documents and no digit of a
value but its country code is kept; other kinds carry a keyed digest of their normal form.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kvist.session import spread

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME, DATE = "email", "phone", "id_number", "address", "name", "date"

# Country codes of one and of two digits; all others have three.
_ONE_DIGIT = ["1", "7"]
_TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
HOME = "47"

# Ends of file names, which make a@b.png no address.
_FILE_ENDS = "png|jpe?g|gif|svg|webp|bmp|tiff?|pdf|docx?|xlsx?|pptx?|txt|csv|zip|html?|xml|json|dwg|ifc|css|js|py|md|log|bak|tmp|exe"
_BRACKETED = r"[(\[{<]\s?(?:at|krøllalfa|alfakrøll|snabel-?a|æt)\s?[)\]}>]"
_AT = rf"(?:@|\s?{_BRACKETED}\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punktum|prikk)\s?[)\]}]\s?|\s(?:dot|punkt|punktum)\s)"
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]{0,61}[\p{L}\d])?"
_LOCAL = rf"[\p{{L}}\d_+%](?:[\p{{L}}\d_+%.'-]{{0,62}}[\p{{L}}\d_+%-])?"
#: Most characters before the sign: two local parts of 64, a spoken dot between them, and the one that must not be there.
_MAIL_REACH = 2 * 64 + len(" punkt ") + 1
_SPOKEN_AT = r"\s(?:at|krøllalfa|alfakrøll|snabela)\s"
_SPOKEN_DOT = r"\s(?:dot|punkt|punktum)\s"
_END = rf"(?!(?:{_FILE_ENDS})\b)\p{{L}}{{2,24}}(?![\p{{L}}\d@])"
# Where an address may be: found first, as it is rare and cheap to look for.
_MAIL_SIGN = regex.compile(rf"{_AT}|{_SPOKEN_AT}(?=[\p{{L}}\d-]+{_SPOKEN_DOT})", regex.IGNORECASE)
# What each branch of the sign can't do without; cheaper to look for, as none begins with something optional.
_MAIL_HINTS = (regex.compile(_BRACKETED, regex.IGNORECASE), regex.compile(_SPOKEN_DOT, regex.IGNORECASE))
_MAIL_BEFORE = regex.compile(rf"(?<![\p{{L}}\d_+%.@/-])(?:{_LOCAL}\s(?:dot|punkt)\s)?{_LOCAL}\Z", regex.IGNORECASE)
_MAIL_AFTER = regex.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_END}", regex.IGNORECASE)

_S = r"[ \u00a0\u202f]"
_NATIONAL = rf"(?:[2-9]\d{_S}\d\d{_S}\d\d{_S}\d\d|[2-9]\d\.\d\d\.\d\d\.\d\d|[2-9]\d-\d\d-\d\d-\d\d|[2-9]\d\d{_S}\d\d{_S}\d\d\d|[2-9]\d{{7}})"
_PREFIX = rf"(?:\((?:\+|00)\d{{1,3}}\)|(?:\+|00)\d{{1,3}}){_S}?"
_PHONE = regex.compile(
    rf"(?<![\p{{L}}\d/.,+_=-])(?<!\d{_S})(?:(?P<home>\((?:\+|00)47\){_S}?|(?:\+|00)47{_S}?){_NATIONAL}"
    rf"|(?P<abroad>(?!\(?(?:\+|00)47){_PREFIX}\d(?:[ \u00a0\u202f-]?\d){{6,11}})|(?P<plain>{_NATIONAL}))(?![\d_/]|{_S}\d|[.,-]\d|\p{{L}})"
)
# Where a number long enough for a phone number may be; found first, as it is cheap to look for.
_DIGITS = re.compile(r"[+(\d][\d \u00a0\u202f.()+-]{6,}\d")
# Words before a bare number that make it a phone number, and those that make it something else.
_CALLS = regex.compile(r"(?:tlf|telefon(?:nummer|nr)?|tel|mobil(?:nummer|nr)?|mob|ring(?:e|er)?|ringes|phone|call|cell|kontakt|contact|reach(?:ed)?|nås(?: på)?|sms|faks|fax|på|at|on|eller|or|til|to|nummer|number)[\s.:(/–-]*$", regex.IGNORECASE)
_OTHERS = regex.compile(r"(?:sak(?:s?nr|snummer)?|case no|case|journal(?:post|nr)?|konto(?:nr|nummer)?|account(?: no)?|org\.? ?(?:nr|no)?|organi[sz]\w*|strekkode\w*|barcode|tegning\w*|drawing|prosjekt\w*|project\w*|ref|faktura\w*|invoice|artikkel\w*|article\w*|varenr|beløp\w*(?: er)?|amount(?: is)?|var|was|verdi\w*|value|id|nr|no|§|kr|nok|\$|€)[\s.:(#–-]*$", regex.IGNORECASE)
_UNITS = regex.compile(r"^\s?(?:kroner|kr\b|nok\b|lux\b|mm\b|cm\b|m[²³2-3]?\b|km\b|kg\b|kw\b|kn\b|pa\b|db\b|liter|prosent|%|°|stk|minutt|meter|euro|usd)", regex.IGNORECASE)

_ID = regex.compile(rf"(?<![\p{{L}}\d/.,+_-])(?<!\d{_S})(\d{{2}})(\d{{2}})(\d{{2}})[ \u00a0\u202f-]?(\d{{3}}){_S}?(\d{{2}})(?![\d_/]|[.,-]\d|\p{{L}})")

# Ends of Norwegian and English street names, words before a street name, roads that carry a number.
_STREET_ENDS = "veien|vegen|vei|veg|gaten|gata|gate|alléen|alleen|allé|alle|stien|sti|bakken|svingen|tunet|plassen|plass|torget|torg|kroken|terrassen|terrasse|ringveien|løkka|stredet|smauet|smuget|kaia|brygga|bryggen|parken|lia|kleiva|haugen"
_STREET_SHORT = r"(?<=\p{L}{4})(?:v|gt)\."
_BEFORE = "øvre|nedre|gamle|nye|store|lille|vesle|indre|ytre|nordre|søndre|søre|østre|vestre|midtre|sankt"
_ROADS = regex.compile(r"^(?:riks|fylkes|europa|kommune|kommunal|stam|motor|hoved|skogsbil|privat|gang|sykkel|adkomst|anleggs)(?:vei|veg)(?:en)?$", regex.IGNORECASE)
_HOUSE = regex.compile(r"(?<=[\p{L}.])[ \u00a0\u202f](\d{1,4}(?:[ \u00a0\u202f]?[A-HJ-Za-hj-z](?![\p{L}\d]))?)(?![\p{L}\d]|[.,]\d)")
_STREET = regex.compile(
    rf"(?<![\p{{L}}\d-])(?:(?i:(?:{_BEFORE}))[ \u00a0\u202f])?"
    rf"(?:(?P<word>\p{{Lu}}[\p{{L}}'-]*?(?:(?i:{_STREET_ENDS})|(?i:{_STREET_SHORT})))|\p{{Lu}}[\p{{L}}'-]+(?i:s)[ \u00a0\u202f](?i:{_STREET_ENDS})|\p{{Lu}}[\p{{L}}'-]{{2,}}[ \u00a0\u202f](?i:v|gt)\.)\Z"
)
_ENGLISH = regex.compile(
    r"(?<![\p{L}\d.,/-])\d{1,4}[A-Za-z]?[ \u00a0\u202f](?:\p{Lu}[\p{L}'-]+[ \u00a0\u202f]){1,3}(?i:close|road|street|lane|avenue|drive|way|court|place|gardens|terrace|crescent|row|square|hill|grove)(?![\p{L}\d])"
)

# The last four words before a place, read backwards; as far as a street's name or a number's label can reach.
_WORDS_BEFORE = regex.compile(r"(?r)[^ \u00a0\u202f]*(?:[ \u00a0\u202f][^ \u00a0\u202f]*){0,4}")
_DATE = regex.compile(r"(?<![\d./-])(?:(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d>\d{1,2})[./](?P<m>\d{1,2})[./](?P<y>\d{4}))(?![\d/-]|\.\d)")

_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-'’]\p{L}[\p{L}\p{M}]*)*")
_GAP = regex.compile(r"[ \u00a0\u202f\t]{1,2}\Z")
_COMMA = regex.compile(r",[ \u00a0\u202f\t]{1,2}\Z")
_INITIAL = regex.compile(r"\.[ \u00a0\u202f\t]{0,2}\Z")
_NOT_PERSONS = regex.compile(r"^[ \u00a0\u202f](?:kommune|municipality|fylke|method|metoden|gate|vei|as|asa)\b", regex.IGNORECASE)


def valid_id(d: str, m: str, y: str, i: str, k: str) -> bool:
    """Norwegian check digits, and a day and month that may carry the offsets of D-numbers and test persons."""
    x = list(map(int, d + m + y + i + k))
    one = 11 - sum(a * b for a, b in zip((3, 7, 6, 1, 8, 9, 4, 5, 2), x)) % 11
    two = 11 - sum(a * b for a, b in zip((5, 4, 3, 2, 7, 6, 5, 4, 3, 2), x)) % 11
    if one % 11 != x[9] or two % 11 != x[10] or one == 10 or two == 10:
        return False
    day, month = int(d), int(m)
    day -= 40 if day > 40 else 0
    month -= next((o for o in (80, 65, 40) if o < month <= o + 12), 0)
    return 1 <= month <= 12 and 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


#: Distinct words of which a worker remembers whether a name can begin with them.
KEPT_WORDS = 200_000


class Names:
    """A register of names; family names it lacks are told by the endings that its families share."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given = frozenset(n.lower() for n in given)
        self.family = frozenset(n.lower() for n in family)
        ends: dict[str, set[str]] = defaultdict(set)
        for n in self.family:
            for k in range(4, len(n) - 1):
                ends[n[-k:]].add(n[-k - 1])
        #: Endings that follow at least three different letters in the register: where a name is composed.
        self.ends = frozenset(e for e, before in ends.items() if len(before) >= 3)
        self.lengths = sorted({len(e) for e in self.ends})
        self.anchors: dict[str, bool] = {}

    def is_given(self, w: str) -> bool:
        return w in self.given or ("-" in w and all(p in self.given for p in w.split("-")))

    def is_composed(self, w: str) -> bool:
        """Does a word end like composed family names? Its own endings are looked up, whatever the register's size."""
        return len(w) > 5 and any(w[-k:] in self.ends for k in self.lengths if k < len(w))

    def is_family(self, w: str) -> bool:
        if w in self.family or ("-" not in w and self.is_composed(w)):
            return True
        return "-" in w and all(self.is_family(p) for p in w.split("-"))

    def anchor(self, w: str) -> bool:
        """Can a name begin with this word? Remembered for up to KEPT_WORDS words."""
        if w not in self.anchors:
            if len(self.anchors) >= KEPT_WORDS:
                self.anchors.clear()
            self.anchors[w] = w in self.given or w in self.family or len(w) == 1 or "-" in w or self.is_composed(w)
        return self.anchors[w]

    def find(self, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(start, end) of names of persons outside the stretches taken."""
        masked = text
        if taken:
            parts, at = [], 0
            for s, e in taken:
                parts += [text[at:s], "\0" * (e - s)]
                at = e
            masked = "".join(parts) + text[at:]
        tokens = list(_TOKEN.finditer(masked))
        words = [t[0].lower() for t in tokens]
        anchors = [k for k, w in enumerate(words) if self.anchor(w)]
        n, i = len(tokens), 0

        def gap(k: int) -> str:
            return masked[tokens[k].end() : tokens[k + 1].start()] if k + 1 < n else "\0"

        def family_after_given(k: int) -> bool:
            w = tokens[k][0]
            return self.is_family(words[k]) or (len(w) > 3 and w[0].isupper() and w[1:].islower() and not self.is_given(words[k]) and tokens[k - 1][0][0].isupper() and not tokens[k - 1][0].isupper())

        def initial(k: int) -> bool:
            return len(words[k]) == 1 and bool(_INITIAL.match(gap(k)))

        for anchor in anchors:
            if anchor < i:
                continue
            i = anchor
            if self.is_given(words[i]):
                j = i
                while _GAP.match(gap(j)) and self.is_given(words[j + 1]):
                    j += 1
                k = j
                while (_GAP.match(gap(k)) or (k > j and _INITIAL.match(gap(k)))) and k + 1 < n and initial(k + 1):
                    k += 1
                if (_GAP.match(gap(k)) or (k > j and _INITIAL.match(gap(k)))) and k + 1 < n and family_after_given(k + 1):
                    k += 1
                    while _GAP.match(gap(k)) and self.is_family(words[k + 1]):
                        k += 1
                    yield tokens[i].start(), tokens[k].end()
                    i = k + 1
                    continue
            elif initial(i) and (masked[tokens[i].start()].isupper() or text.islower()) and self._free(masked, tokens[i].start()):
                k = i
                while initial(k) and k + 1 < n and initial(k + 1):
                    k += 1
                if initial(k) and k + 1 < n and self.is_family(words[k + 1]):
                    k += 1
                    while _GAP.match(gap(k)) and self.is_family(words[k + 1]):
                        k += 1
                    if not _NOT_PERSONS.match(masked[tokens[k].end() : tokens[k].end() + 16]):
                        yield tokens[i].start(), tokens[k].end()
                        i = k + 1
                        continue
            elif self.is_family(words[i]):
                j = i
                while _GAP.match(gap(j)) and self.is_family(words[j + 1]):
                    j += 1
                if (_COMMA.match(gap(j)) or _GAP.match(gap(j))) and (self.is_given(words[j + 1]) or (_COMMA.match(gap(j)) and initial(j + 1) and masked[tokens[j + 1].start()].isupper())):
                    k = j + 1
                    while _GAP.match(gap(k)) and self.is_given(words[k + 1]):
                        k += 1
                    follows = k
                    while _GAP.match(gap(follows)) and initial(follows + 1):
                        follows += 1
                    if not ((_GAP.match(gap(follows)) or (follows > k and _INITIAL.match(gap(follows)))) and follows + 1 < n and self.is_family(words[follows + 1])):
                        yield tokens[i].start(), tokens[follows if follows > k and initial(follows) else k].end()
                        i = follows + 1
                        continue
                i = j + 1

    @staticmethod
    def _free(text: str, at: int) -> bool:
        """An initial doesn't belong to a number, a degree sign or a unit before it."""
        before = text[max(0, at - 3) : at]
        return not regex.search(r"(?:[\d°²³§][ \u00a0\u202f]?|[\p{L}\d.]-)\Z", before)


def _mails(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _MAIL_SIGN.finditer(text) if "@" in text or any(h.search(text) for h in _MAIL_HINTS) else ():
        low = max(0, m.start() - _MAIL_REACH)
        before, after = _MAIL_BEFORE.search(text[low : m.start()]), _MAIL_AFTER.match(text, m.end())
        if before and after:
            yield low + before.start(), after.end(), EMAIL


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order, without overlap."""
    found: list[tuple[int, int, str]] = list(_mails(text))
    for m in _ID.finditer(text):
        if valid_id(*m.groups()):
            found.append((*m.span(), ID_NUMBER))
    for m in (m for d in _DIGITS.finditer(text) for m in _PHONE.finditer(text, d.start(), min(len(text), d.end() + 3))):
        if m["plain"]:
            before = text[min(_WORDS_BEFORE.match(text, 0, m.start()).start(), max(0, m.start() - 28)) : m.start()]
            digits = m["plain"].isdigit()
            if _UNITS.match(text[m.end() : m.end() + 10]) or (_OTHERS.search(before) and not regex.search(r"(?i)(?:tlf|telefon\w*|mobil\w*|phone|call)[\s.:]*(?:nr|no|nummer)?[\s.:]*$", before)) or (digits and not _CALLS.search(before)):
                continue
        found.append((*m.span(), PHONE))
    for m in _HOUSE.finditer(text):
        low = _WORDS_BEFORE.match(text, 0, m.start()).start()
        street = _STREET.search(text[low : m.start()])
        if street and not (street["word"] and _ROADS.match(street["word"])):
            found.append((low + street.start(), m.end(), ADDRESS))
    found += [(*m.span(), ADDRESS) for m in _ENGLISH.finditer(text)]
    order = (EMAIL, ID_NUMBER, PHONE, ADDRESS)
    free: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda f: (order.index(f[2]), f[0] - f[1])):
        if all(f[1] <= s or e <= f[0] for s, e, _ in free):
            free.append(f)
    taken = sorted((s, e) for s, e, _ in free)
    return sorted(free + [(s, e, NAME) for s, e in names.find(text, taken)])


def dates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the valid dates in a text that are written in digits."""
    for m in _DATE.finditer(text):
        if _day(m) is not None:
            yield m.start(), m.end(), DATE


def _day(m: regex.Match) -> datetime.date | None:
    try:
        day = datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
    except ValueError:
        return None
    return day if Pseudonyms.FIRST <= day.toordinal() < Pseudonyms.FIRST + Pseudonyms.DAYS else None


def country(digits: str) -> str:
    """The country code that the digits after an international prefix begin with."""
    return digits[:1] if digits[:1] in _ONE_DIGIT else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]


def _mail_form(text: str) -> str:
    """local@domain of a mail address, however its signs are written."""
    at = regex.sub(rf"(?i){_AT}|{_SPOKEN_AT}", "@", text.lower(), count=1)
    return regex.sub(rf"(?i){_DOT}|{_SPOKEN_DOT}", ".", at)


# Forms of the same end of a street's name, the first one stands for all.
_SAME_ENDS = [["vei", "veien", "vegen", "veg", "v."], ["gate", "gaten", "gata", "gt."], ["allé", "alléen", "alleen", "alle"], ["plass", "plassen"], ["torg", "torget"], ["terrasse", "terrassen"], ["brygge", "brygga", "bryggen"]]
_END_FORMS = {form: forms[0] for forms in _SAME_ENDS for form in forms}
_STREET_END = regex.compile("(?:" + "|".join(regex.escape(f) for f in sorted(_END_FORMS, key=len, reverse=True)) + r")(?=\s\d)")


def _address_form(text: str) -> str:
    """Lower case, single blanks, one form of the street's end, no blank before the house's letter."""
    bare = " ".join(text.lower().split())
    bare = regex.sub(r"(?<=\d) (?=[a-z]$)", "", bare)
    return _STREET_END.sub(lambda m: _END_FORMS[m[0]], bare, count=1)


def _name_form(text: str, names: Names | None) -> str:
    """Lower-case words, given names first."""
    before, comma, after = text.lower().partition(",")
    words = _TOKEN.findall(f"{after} {before}" if comma else before)
    if names and not comma and len(words) > 1 and names.is_family(words[0]) and not names.is_given(words[0]) and names.is_given(words[-1]):
        k = next(i for i, w in enumerate(words) if names.is_given(w))
        words = words[k:] + words[:k]
    return " ".join(words)


class Pseudonyms:
    """Keyed pseudonyms: Feistel permutations of numbers and dates within their format, digests of normal forms for the rest.

    Who has the key can tell the numbers; it must not be published. names: tells family names from given ones.
    """

    #: The days that dates are permuted among: 1800 to 2199.
    FIRST = datetime.date(1800, 1, 1).toordinal()
    DAYS = datetime.date(2200, 1, 1).toordinal() - FIRST

    def __init__(self, key: bytes, names: Names | None = None) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key, self.names = key, names

    def _round(self, tweak: str, k: int, value: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{k}|{value}".encode(), "sha256")[:8], "big")

    def permute(self, value: int, size: int, tweak: str, ok: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """A keyed permutation of 0 .. size - 1 that maps the values that are ok onto each other.

        An alternating Feistel network over a x b >= size, walked on while it leads outside.
        """
        a = int(size**0.5)
        while a * a < size:
            a += 1
        while True:
            left, right = divmod(value, a)
            for k in range(8) if not back else range(7, -1, -1):
                step = -1 if back else 1
                if k % 2:
                    left = (left + step * self._round(tweak, k, right)) % a
                else:
                    right = (right + step * self._round(tweak, k, left)) % a
            value = left * a + right
            if value < size and ok(value):
                return value

    def id_number(self, text: str) -> str:
        """Another valid identity number of the same form: date, individual number and check digits; offsets stay."""
        x = [c for c in text if c.isdigit()]
        day, month, year, own = int(x[0] + x[1]), int(x[2] + x[3]), int(x[4] + x[5]), int("".join(x[6:9]))
        d_off = 40 if day > 40 else 0
        m_off = next((o for o in (80, 65, 40) if o < month <= o + 12), 0)
        start = datetime.date(2000, 1, 1).toordinal()
        try:
            date = datetime.date(2000 + year, month - m_off, day - d_off).toordinal() - start
        except ValueError:  # 29 February of a year that has none
            date = datetime.date(2000 + year, 3, 1).toordinal() - start

        def digits(v: int) -> str | None:
            on = datetime.date.fromordinal(start + v // 1000)
            y = [int(c) for c in f"{on.day + d_off:02d}{on.month + m_off:02d}{on.year % 100:02d}{v % 1000:03d}"]
            one = (11 - sum(a * b for a, b in zip((3, 7, 6, 1, 8, 9, 4, 5, 2), y)) % 11) % 11
            two = (11 - sum(a * b for a, b in zip((5, 4, 3, 2, 7, 6, 5, 4, 3, 2), [*y, one])) % 11) % 11
            return None if 10 in (one, two) else "".join(map(str, [*y, one, two]))

        new = digits(self.permute(date * 1000 + own, 36_525_000, f"id{d_off}{m_off}", lambda v: digits(v) is not None))
        it = iter(new or "")
        return "".join(next(it) if c.isdigit() else c for c in text)

    def phone(self, text: str) -> str:
        """Another number of the same country with the same grouping; all spellings of a number give the same digits."""
        at = [i for i, c in enumerate(text) if c.isdigit()]
        head = regex.match(r"\(?(\+|00)", text)
        code = HOME
        if head:
            at = at[2:] if head[1] == "00" else at
            code = country("".join(text[i] for i in at))
            at = at[len(code) :]
        digits = "".join(text[i] for i in at)
        low, size = (2 * 10**7, 8 * 10**7) if code == HOME and len(digits) == 8 and digits[0] >= "2" else (0, 10 ** len(digits))
        new = iter(f"{self.permute(int(digits or 0) - low, size, f'phone{code}|{len(digits)}|{low}') + low:0{len(digits)}d}")
        out = list(text)
        for i in at:
            out[i] = next(new)
        return "".join(out)

    def date(self, text: str) -> str:
        """Another date in the same form; 1 January 2020 and 2020-01-01 give the same day."""
        m = _DATE.fullmatch(text)
        day = datetime.date.fromordinal(self.FIRST + self.permute(_day(m).toordinal() - self.FIRST, self.DAYS, "date"))
        full = len(m["d"]) == len(m["m"]) == 2
        parts = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if full else str(day.month), "d": f"{day.day:02d}" if full else str(day.day)}
        out, last = "", 0
        for name in sorted(parts, key=m.start):
            out += text[last : m.start(name)] + parts[name]
            last = m.end(name)
        return out + text[last:]

    def normal(self, kind: str, text: str) -> str:
        """The form that all spellings of a value share."""
        return {EMAIL: _mail_form, ADDRESS: _address_form}.get(kind, lambda t: _name_form(t, self.names))(text)

    def placeholder(self, kind: str, text: str) -> str:
        """[KIND:pseudonym]; equal values give equal pseudonyms, digests have 128 bits."""
        number = {ID_NUMBER: self.id_number, PHONE: self.phone, DATE: self.date}.get(kind)
        if number:
            return f"[{kind.upper()}:{number(text)}]"
        return f"[{kind.upper()}:{hmac.new(self.key, f'{kind}|{self.normal(kind, text)}'.encode(), hashlib.sha256).hexdigest()[:32]}]"

    def replace(self, text: str, found: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for s, e, kind in found:
            out += [text[at:s], self.placeholder(kind, text[s:e])]
            at = e
        return "".join(out) + text[at:]


#: Rows of a name register that are broadcast; a larger one is refused rather than cut.
MOST_NAMES = 2_000_000


def _register(names: DataFrame):
    rows = names.select("name", "name_kind").filter("name IS NOT NULL").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a name register of more than {MOST_NAMES} rows isn't supported")
    return names.sparkSession.sparkContext.broadcast(Names([r[0] for r in rows if r[1] == "given"], [r[0] for r in rows if r[1] == "family"]))


def personal_information(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, found): one row per document, kind and different value, as it stands in the text.

    Null, empty and blank texts give nothing; repeated rows are each reported. Whole texts are searched,
    each alone, without shuffle; the name register is broadcast, its size is checked.
    """
    register = _register(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = register.value
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if text:
                    rows += dict.fromkeys((doc, kind, text[s:e]) for s, e, kind in find(text, known))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [batch.schema.field(0).type, pa.string(), pa.string()])], names=["doc_id", "kind", "found"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {kind}, kind string, found string")


def pseudonymised(documents: DataFrame, names: DataFrame, key: bytes, with_dates: bool = False) -> DataFrame:
    """(doc_id, text, replaced int): texts with typed placeholders, everything else unchanged; null stays null.

    key: of the pseudonyms, to be kept by whoever publishes the text. with_dates: replace valid dates, too, which
    are no personal information by themselves.
    """
    register = _register(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pseudonyms = register.value, Pseudonyms(key, register.value)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(1):
                text = value.as_py()
                found = find(text, known) if text else []
                if text and with_dates:
                    found = sorted(found + [d for d in dates(text) if all(d[1] <= s or e <= d[0] for s, e, _ in found)])
                texts.append(pseudonyms.replace(text, found) if found else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "replaced"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {kind}, text string, replaced int")
