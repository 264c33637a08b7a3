"""Candidate spans of personal information in one text, with the votes of simple labelers and features for a classifier.

Runs inside Python workers. A vote is 1 (is one), -1 (is none) or 0 (abstains). Each type has its own labelers, always in
the same order: patterns, gazetteer, and the words before and after.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate

TYPES = ("email", "phone", "identity", "address", "name")
#: Size of the classifier's feature space.
FEATURES = 4096

# What stands before and after personal information in clinical and office prose of several languages, as
# alternatives of a pattern. Only labels and set phrases, no words of particular sentences.
TITLES = r"Dr|Dra|Don|Doña|Mr|Mrs|Ms|Miss|Sr|Sra|Srta|Prof|Profa|Mme|Mlle|Herr|Frau"
NAME_BEFORE = (
    r"seen by|signed by|referred by|reviewed by|attended by|next of kin|contact|patient|talking to|copied to|valorad[oa] por|remitid[oa] por|firmado por|atendid[oa] por|"
    r"familiar(?: de contacto)?|paciente|según|hablar con|avisar a|llamar a|copia a|par le patient|patientin"
)
NAME_AFTER = r"al tfno|al tel|residing at|con domicilio|DNI|D\.N\.I|NIE|SSN|Soc\. Sec|NHS|NIR|passport|pasaporte|Reisepass|n° de|social security"
DISEASE_BEFORE = r"(?:signo|enfermedad|síndrome|sindrome|mal|maladie|signe|syndrome|morbus|prueba|reacción|método|escala) de(?: la| l')?|morbus"
DISEASE_AFTER = r"['’]s? (?:disease|sign|syndrome|test|phenomenon)|(?:sign|syndrome|disease|signe|zeichen|syndrom|assay|test|score|carcinoma|deficiency)\b"
PHONE_BEFORE = r"tel|tel[ée]fono|t[ée]l|tfno|tlf|phone|call|llame al|llamar al|móvil|mobile|fax|handy|or|at|/|al"
IDENTITY_BEFORE = (
    r"DNI|D\.N\.I\.?|NIE|N\.I\.E\.?|NIF|pasaporte|passport|reisepass|passeport|SSN|Soc\. Sec\.?|social security|sécurité sociale|seguridad social|NIR|NHS|"
    r"identified by|identifica con|copy of|copia de|documento"
)
OTHER_NUMBER_BEFORE = (
    r"PMID|batch|lote|trial|ensayo|accession|acceso|catalogue|catálogo|referencia|reference|ref|reads|lecturas|values|valores|protocol|"
    r"grant|n =|figure|fig|table|dose|dosis|version|admitted on|ingresó el|revisión del|follow-up"
)
ADDRESS_BEFORE = r"residing at|lives at|resides at|reside en|vive en|transferred from|trasladad[oa] desde|domicilio(?: en)?|address|dirección|demeurant|wohnhaft in"
EMAIL_BEFORE = r"mailed to|reply from|enviado a|copia a|contact|contacto|e-?mail|correo|copied to|y a|a|,|to"
# Words that begin sentences or stand before names but belong to none.
NO_NAMES = frozenset(
    "a al an and after ask avisar by call con contact contacto copied copia copy de del don doña dr dra el en enviado from frau he her herr his "
    "identified in informe is kin la las le les lives los llamar llame miss mme mr mrs ms muestra next no of on or para patient paciente per plan por "
    "prof referred remitido report reply reside results sample se seen según she sr sra srta tel the to tras un una valorado van was with y "
    "signo sign enfermedad disease síndrome sindrome syndrome box avda calle paseo plaza".split()
)
PARTICLES = frozenset("de la las los del van von der den du di da dos zu".split())

_NAME_PART = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?"
_PLACE = rf"{_NAME_PART}(?: {_NAME_PART}){{0,2}}"
_TOWN = rf"{_NAME_PART}(?: (?:de|del|la|am|an der|sur) {_NAME_PART})?"
_POST = r"(?:(?:[A-Z]{1,2}-)?\d{4,5} )"
_FR = "[Rr]ue|[Aa]venue|[Pp]lace|[Bb]oulevard|[Bb]d|[Aa]llée|[Cc]hemin|[Qq]uai|[Ii]mpasse"
_DE = "straße|strasse|str\\.|gasse|weg|platz|allee|ring|ufer|damm"
_DE_WORD = "Straße|Strasse|Platz|Allee|Weg|Ufer"
_IT = "Via|Viale|Piazza|Corso|Largo|Vicolo|Rua|Travessa|Praça|Strada"
ADDRESS = {
    "es": re.compile(
        rf"(?:C/|Calle|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Ctra\.?|Carretera)\s?\s*(?:de (?:la |los |las )?|del )?{_PLACE},?\s+"
        rf"(?:nº ?|n\.º ?|núm\.? ?)?\d+(?:,? (?:\d+[ºª] ?\w{{1,4}}\.?|bajo(?: \w{{2,4}}\.?)?|ático|entlo\.?))?(?:, | - )(?:\d{{5}} )?{_TOWN}"
    ),
    "fr": re.compile(rf"(?<![\w.,/-])\d+(?: bis| ter)?,? (?:{_FR}) (?:de la |de l['’]|du |des |de |d['’])?{_PLACE}, (?:\d{{5}} )?{_TOWN}"),
    "de": re.compile(
        rf"(?:{_NAME_PART}(?:{_DE})|(?<!\w)(?:{_DE_WORD}) (?:des|der|am|an der|von) (?:\d+\. )?{_PLACE}|(?<!\w){_NAME_PART} (?:{_DE_WORD})) \d+ ?[a-z]?, {_POST}?{_TOWN}"
    ),
    "it": re.compile(rf"(?<!\w)(?:{_IT}) (?:d(?:el|ella|ei|egli|elle|i|a|o|os|as|e) |dell['’])?{_PLACE},? (?:n\.? ?)?\d+ ?[a-zA-Z]?(?:, | - ){_POST}?{_TOWN}"),
    "en": re.compile(
        rf"(?<![\w.,/-])\d+[A-Z]? {_PLACE} (?:St|Street|Ave|Avenue|Road|Rd|Lane|Ln|Drive|Way|Court|Square|Blvd)\b\.?(?:, (?:Flat|Apt\.?|Apartment|Unit|Suite) \w+)?, {_TOWN}"
    ),
    "box": re.compile(rf"(?:P\. ?O\. ?Box|PO Box|Apartado(?: de Correos)?|Apdo\.?(?: de Correos)?|Postfach|Boîte postale) \d+, (?:\d{{5}} )?{_TOWN}"),
}
#: A text without any of these words, in lower case, or parts of words has no address of the form.
ADDRESS_WORDS = {
    "es": frozenset("c calle avda av avenida plaza pza paseo camino ronda ctra carretera".split()),
    "fr": frozenset("rue avenue place boulevard bd allée chemin quai impasse".split()),
    "de": frozenset("straße strasse platz allee weg ufer".split()),
    "it": frozenset(_IT.lower().split("|")),
    "en": frozenset("st street ave avenue road rd lane ln drive way court square blvd".split()),
    "box": frozenset("box apartado apdo postfach postale".split()),
}
ADDRESS_PARTS = {"de": ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ring ", "ufer ", "damm ")}
_AT = r"(?: ?@ ?| ?[(\[](?:at|arroba|a)[)\]] ?)"
_DOT = r"(?:\.| ?[(\[](?:dot|punto|point|punkt)[)\]] ?)"
EMAIL = re.compile(rf"(?<![\w.+@-])[^\W_][\w.+-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*", re.IGNORECASE)
PHONE = re.compile(r"(?<![\w@.+/-])(?:\(\+?\d{1,4}\)|\+?\d{1,12})(?:[ ./-]?(?:\(\d{1,4}\)|\d{1,12})){0,7}(?![\w@])")
IDENTITY = {
    "dni": re.compile(r"(?<![\w.-])\d{2}\.?\d{3}\.?\d{3}[- ]?[A-Z](?!\w)"),
    "nie": re.compile(r"(?<![\w.-])[XYZ][- ]?\d{7}[- ]?[A-Z](?!\w)"),
    "passport": re.compile(r"(?<![\w.-])[A-Z]{1,3} ?\d{6,9}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w.-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "nhs": re.compile(r"(?<![\w.+/-])\d{3}[ -]?\d{3}[ -]?\d{4}(?![\w-])"),
    "nir": re.compile(r"(?<![\w.-])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?(?![\w-])"),
}
#: Digits in a row, apart from single separators, that an identity number of any form needs at least.
_DIGITS = re.compile(r"\d(?:[ .-]?\d){5,}")
_WORDS = re.compile(r"([^\W\d_]+)")
_BEFORE_TITLE = re.compile(rf"(?<!\w)(?:{TITLES})\.? $")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NUMBER = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_THREE = re.compile(r"\d{3}")
_LABEL_BEFORE = re.compile(r"(?<!\w)[A-Z]{1,3}[ -]?$")
_LETTER_AFTER = re.compile(r"-?[A-Z](?!\w)")
_EXTENSION = re.compile(r",? ext")
_ABROAD = re.compile(r"\(?\+[1-9]")
_TOWN_AT = re.compile(r", (?:\d{5} )?[A-ZÀ-Þ]|\d - \d{5} ")
_ENDED = re.compile(r"[),.;]|$")
_WRITTEN_AT = re.compile(r"[(\[](?:at|arroba|a)[)\]]", re.IGNORECASE)
_AFTER_TITLE = re.compile(r"\.? (?=\S)")
_TITLES = frozenset(TITLES.split("|"))
_SPOKEN = re.compile(rf"(?:{NAME_BEFORE}) (?=[A-ZÀ-ÖØ-Þ][^\W\d_]+ [A-ZÀ-ÖØ-Þdv])", re.IGNORECASE)
_SPOKEN_FIRST = frozenset(re.match(r"\w+", p.replace("[oa]", "o"))[0] for p in NAME_BEFORE.split("|")) | {p.replace("[oa]", "a").split()[0] for p in NAME_BEFORE.split("|") if "[oa]" in p}


def _before(cues: str) -> re.Pattern[str]:
    """The cue, at most a label and punctuation, and then the span."""
    return re.compile(rf"(?:^|[^\w])(?:{cues})\.?[\s:(#]*(?:(?:nº|n°|no|nr|núm|number|ref|con)\.?[\s:#]*)?$", re.IGNORECASE)


CUES = {k: _before(v) for k, v in (("name", NAME_BEFORE), ("disease", DISEASE_BEFORE), ("phone", PHONE_BEFORE), ("identity", IDENTITY_BEFORE), ("address", ADDRESS_BEFORE), ("email", EMAIL_BEFORE))}
_OTHER = re.compile(rf"(?:^|[^\w])(?:{OTHER_NUMBER_BEFORE})\b\.?[^\n.;)]{{0,18}}$", re.IGNORECASE)
_COUNTRY_CODE = re.compile(r"(?:\+|00)\d{1,3}[ .-]?(?:\(\d\))?$")
_NAME_AFTER = re.compile(rf"^[\s,(]*(?:{NAME_AFTER})")
_DISEASE_AFTER = re.compile(rf"^ ?(?:{DISEASE_AFTER})", re.IGNORECASE)
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}")
_THOUSANDS = re.compile(r"[1-9]\d{0,2}(?: \d{3}){2,}|[1-9]\d{0,2}(?:\.\d{3}){2,}|[1-9]\d{0,2}(?:\.\d{3})+\.\d{2}")
_PHONE_PLAN = re.compile(r"(?:\+|\(\+|00\d{2}|\(0|0\d|\(?\d{3}\)? ?\d{3}-|\d[.-]\d{3}[.-]|\d{3}-\d{4}$).*|\d{7}")


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: list[int]
    features: list[int]


def _features(kind: str, text: str, start: int, end: int, votes: list[int], shape: str, known: Mapping[str, str]) -> list[int]:
    def named(words: list[str]) -> list[str]:
        low = [w.lower() for w in words]
        return ["<name>" if w in known else _NUMBER.sub("9", w) for w in low]

    left, right = named(_TOKEN.findall(text, max(0, start - 40), start)[-3:]), named(_TOKEN.findall(text, end, end + 40)[:3])
    names = [f"{kind}:bias", f"{kind}:shape:{shape}"]
    names += [f"{kind}:v{i}:{v}" for i, v in enumerate(votes)]
    names += [f"{kind}:l{i}:{w}" for i, w in enumerate(reversed(left))] + [f"{kind}:r{i}:{w}" for i, w in enumerate(right)]
    names += [f"{kind}:l:{' '.join(left[-2:])}", f"{kind}:r:{' '.join(right[:2])}"]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def _vote(yes: object, no: object = False) -> int:
    return 1 if yes else -1 if no else 0


def _emails(text: str) -> Iterator[tuple[int, int, list[int], str]]:
    if "@" not in text and not _WRITTEN_AT.search(text):
        return
    for m in EMAIL.finditer(text):
        s, e = m.span()
        host = re.split(_AT, m[0], maxsplit=1, flags=re.IGNORECASE)[1]
        labels = re.split(_DOT, host, flags=re.IGNORECASE)
        last = re.sub(r"[^\w].*", "", labels[-1])
        named = len(labels) > 1 and last.isalpha() and 2 <= len(last) <= 12
        word = re.search(r"[^\W\d_]{2}", m[0].split("@")[0])
        yield s, e, [_vote(named, not named), _vote(word, not word), _vote(CUES["email"].search(text[max(0, s - 30) : s])), _vote("." in host or len(labels) > 1, len(labels) < 2)], f"{len(labels)}{named}"


def _phones(text: str) -> Iterator[tuple[int, int, list[int], str]]:
    for m in PHONE.finditer(text):
        span = m[0]
        if len(span) < 7 or not 7 <= len(_DIGIT.findall(span)) <= 15:
            continue
        s, e = m.span()
        left = text[max(0, s - 34) : s]
        odd = _DATE.fullmatch(span) or _THOUSANDS.fullmatch(span)
        cue, label, other = CUES["phone"].search(left), CUES["identity"].search(left), _OTHER.search(left)
        other = other or _LABEL_BEFORE.search(left) or _LETTER_AFTER.match(text, e)
        plan = _PHONE_PLAN.fullmatch(span) and not odd
        votes = [_vote(plan, not plan), _vote((cue or _ABROAD.match(span)) and not label, label), _vote(False, other or label), _vote(_EXTENSION.match(text, e))]
        yield s, e, votes, _NUMBER.sub(lambda d: str(len(d[0])), span)


def _identities(text: str) -> Iterator[tuple[int, int, list[int], str]]:
    """The forms are only tried where enough digits are; what may stand before and after them is looked at, too."""
    done = dict.fromkeys(IDENTITY, -1)
    for run in _DIGITS.finditer(text):
        for form, pattern in IDENTITY.items():
            for m in pattern.finditer(text, max(0, run.start() - 4, done[form]), run.end() + 3):
                s, e = m.span()
                if not _whole(text, m):
                    continue
                done[form] = e
                left = text[max(0, s - 34) : s]
                label, other, phone = CUES["identity"].search(left), _OTHER.search(left), CUES["phone"].search(left)
                letters = form in ("dni", "nie")
                odd = _THOUSANDS.fullmatch(m[0]) or _DATE.fullmatch(m[0])
                yield s, e, [_vote(letters, odd), _vote(label, phone), _vote(False, other or _COUNTRY_CODE.search(left)), _vote(_ENDED.match(text, e))], form


def _whole(text: str, m: re.Match[str]) -> bool:
    """The match also holds against what comes after the part of the text that was searched."""
    return m.re.match(text, m.start()) is not None and m.re.match(text, m.start()).end() == m.end()


class Words:
    """The words of a text with their places, split once for all labelers."""

    def __init__(self, text: str) -> None:
        parts = _WORDS.split(text)
        ends = list(accumulate(map(len, parts)))
        self.words, self.gaps, self.starts, self.ends = parts[1::2], parts[2::2], ends[0:-1:2], ends[1::2]
        self.low = list(map(str.lower, self.words))
        self.distinct = set(self.low)


def _addresses(text: str, words: Words) -> Iterator[tuple[int, int, list[int], str]]:
    """The patterns are only tried in texts with a word that tells a street or a post box, and then on the whole text."""
    for form, pattern in ADDRESS.items():
        if words.distinct.isdisjoint(ADDRESS_WORDS[form]) and not any(x in text for x in ADDRESS_PARTS.get(form, ())):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            left = text[max(0, s - 30) : s]
            number = _NUMBER.search(m[0])
            yield s, e, [_vote(number, not number), _vote(_TOWN_AT.search(m[0])), _vote(CUES["address"].search(left) or left.endswith(", ")), _vote(_ENDED.match(text, e))], form


class _Names:
    """Full names: runs of given names, initials, particles and family names, or family name, comma, given name."""

    def __init__(self, text: str, known: Mapping[str, str], words: Words, taken: list[tuple[int, int]]) -> None:
        self.text, self.known = text, known
        self.words, self.low, self.gaps, self.starts, self.ends = words.words, words.low, words.gaps, words.starts, words.ends
        self.blocked = {i for a, b in taken for i in range(bisect_right(self.ends, a), bisect_left(self.starts, b))}

    def gap(self, i: int) -> str:
        """What is between token i and the next."""
        return self.gaps[i] if 0 <= i < len(self.words) - 1 else "\n"

    def free(self, i: int) -> bool:
        if not 0 <= i < len(self.words) or i in self.blocked:
            return False
        s, e = self.starts[i], self.ends[i]
        return not (s and self.text[s - 1] in "@_+-") and not self.text[e : e + 1] in ("@", "_", "+") and not self.text[e : e + 1].isdigit()

    def initial(self, i: int) -> bool:
        if not 0 <= i < len(self.words) or len(self.words[i]) != 1 or not self.words[i].isupper() or not self.free(i):
            return False
        s, e = self.starts[i], self.ends[i]
        return self.text[e : e + 2] == ". " and not (s > 1 and self.text[s - 1] in "./'’")

    def listed(self, i: int) -> str:
        return self.known.get(self.low[i], "") if self.free(i) else ""

    def capital(self, i: int) -> bool:
        return self.free(i) and len(self.words[i]) > 2 and self.words[i][0].isupper() and self.low[i] not in NO_NAMES

    def particle(self, i: int) -> bool:
        return self.free(i) and self.low[i] in PARTICLES

    def run(self, i: int, sure: bool) -> tuple[int, int] | None:
        """First and last token of the name that begins at token i. ``sure``: a title or phrase before it says it is one."""
        first, words = i, 0
        while self.initial(i) and self.gap(i) == ". ":
            i += 1
        if not (self.free(i) and (self.listed(i) or self.capital(i) or (sure and self.low[i] not in NO_NAMES and len(self.words[i]) > 3))):
            return None
        last, words = i, 1
        small = self.words[i].islower()
        if self.gap(i) == ", " and first == i and "given" in self.listed(i + 1) and "given" not in self.listed(i):
            last = i + 1
            return first, last + 1 if self.gap(last) == " " and self.initial(last + 1) and self.text[self.ends[last + 1]] == "." and not self.listed(last + 2) else last
        while self.gap(last) == " ":
            j = last + 1
            while self.initial(j) and self.gap(j) == ". ":
                j += 1
            k = j
            while self.particle(k) and self.gap(k) == " ":
                k += 1
            if not self.free(k) or (k > j and not (self.listed(k) or self.capital(k))):
                break
            unlisted = self.capital(k) or (small and words == 1 and self.words[k].islower() and len(self.words[k]) > 4 and "given" in self.listed(last) and self.words[k] not in NO_NAMES)
            if not (self.listed(k) or (unlisted and words == 1)):
                break
            last, words = k, words + 1
        return first, last

    def first_of(self, i: int) -> int:
        """The token at which the name around the listed token i begins."""
        while i > 0:
            p, gap = i - 1, self.gap(i - 1)
            if gap == " " and (self.listed(p) or self.capital(p)):
                i = p
            elif gap == " " and self.free(p) and self.words[p].islower() and self.words[i].islower() and len(self.words[p]) > 3 and self.words[p] not in NO_NAMES | PARTICLES and "family" in self.listed(i) and self.told(p):
                i = p
            elif gap == ". " and self.initial(p) and (p == 0 or self.gap(p - 1) in (" ", "\n") or not self.gap(p - 1).strip(" .,;:()\n")):
                i = p
            elif gap == ", " and "given" in self.listed(i) and (self.listed(p) == "family" or (not self.listed(p) and self.capital(p) and self.told(p))):
                return p
            elif gap == " " and self.free(p) and self.low[p] in PARTICLES:
                q = p
                while q > 0 and self.low[q] in PARTICLES and self.gap(q - 1) == " ":
                    q -= 1
                if self.low[q] in PARTICLES or not (self.listed(q) or (self.capital(q) and self.told(q)) or (self.told(q) and self.free(q) and self.low[q] not in NO_NAMES)):
                    return i
                i = q
            else:
                return i
        return i

    def told(self, i: int) -> bool:
        at = self.starts[i]
        left = self.text[max(0, at - 34) : at]
        return bool(_BEFORE_TITLE.search(left) or CUES["name"].search(left))

    def spans(self) -> Iterator[tuple[int, int, list[int], str]]:
        done = -1
        alone = lambda i: not (self.starts[i] and (self.text[self.starts[i] - 1].isdigit() or self.text[self.starts[i] - 1] == "_"))
        starts = {m.end() for i, w in enumerate(self.words) if w in _TITLES and alone(i) and (m := _AFTER_TITLE.match(self.text, self.ends[i]))}
        spoken = {m.end() for i, w in enumerate(self.low) if w in _SPOKEN_FIRST and alone(i) and (m := _SPOKEN.match(self.text, self.starts[i]))}
        told = starts | spoken
        for i in [i for i, (w, s) in enumerate(zip(self.low, self.starts, strict=True)) if w in self.known or s in told]:
            if i <= done or not self.free(i):
                continue
            w, s = self.words[i], self.starts[i]
            titled = s in starts and not (w in ("Dr", "Dra", "Don", "Sr", "Sra", "Mr", "Mrs", "Prof"))
            begin = i if titled else self.first_of(i) if self.low[i] in self.known else i if s in spoken and self.capital(i) else None
            if begin is None or begin <= done:
                continue
            got = self.run(begin, titled or self.told(begin))
            if got is None:
                continue
            a, b = got
            if a == b and not titled and self.low[i] not in self.known:
                continue
            done = b
            yield self.judged(a, b)

    def judged(self, a: int, b: int) -> tuple[int, int, list[int], str]:
        s, e = self.starts[a], self.ends[b]
        left, right = self.text[max(0, s - 34) : s], self.text[e : e + 34]
        parts = [i for i in range(a, b + 1) if self.low[i] not in PARTICLES]
        known = sum(bool(self.listed(i)) for i in parts)
        title = _BEFORE_TITLE.search(left)
        bare = left[: title.start()] if title else left
        disease = _DISEASE_AFTER.match(right) or (len(parts) == 1 and CUES["disease"].search(left))
        several = len(parts) > 1
        votes = [_vote(several and known, not several and not title), _vote(title), _vote(CUES["name"].search(bare)), _vote(_NAME_AFTER.match(right)), _vote(False, disease), _vote(several, not several and not title)]
        shape = "".join("I" if len(self.words[i]) == 1 else "L" if self.listed(i) else "O" for i in parts) + ("," if "," in self.text[s:e] else "")
        return s, e, votes, shape


def candidates(text: str, known: Mapping[str, str]) -> list[Candidate]:
    """All candidate spans of a text. ``known``: lower-case name to its kinds (``given``, ``family`` or both)."""
    out: list[Candidate] = []

    def add(kind: str, found: Iterator[tuple[int, int, list[int], str]]) -> list[tuple[int, int]]:
        spans = []
        for s, e, votes, shape in found:
            out.append(Candidate(kind, s, e, votes, _features(kind, text, s, e, votes, shape, known)))
            if votes[0] > 0:
                spans.append((s, e))
        return spans

    words = Words(text)
    taken = add("email", _emails(text))
    digits = len(_DIGIT.findall(text))
    if digits >= 7:  # the fewest of a phone number, in groups of any length
        add("phone", _phones(text))
    if _THREE.search(text):  # every form of identity has three in a row
        add("identity", _identities(text))
    if digits:
        taken += add("address", _addresses(text, words))
    add("name", _Names(text, known, words, taken).spans())
    return out
