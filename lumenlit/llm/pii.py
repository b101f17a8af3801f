"""Personal information in free text: found, scored and replaced by typed placeholders.

Patterns propose spans, checksums confirm or weaken them, and the words around a
span move its score; a span of at least ``THRESHOLD`` counts.  Kinds are sought
in a fixed order and each hides what it found from the next, so that a name
inside a mail address is no name and a health number is no phone number.

Given names come from a list and from the display names themselves: a word that
stands before (or after, with a comma) many different family names, and oftener so
than in their place, is a given name here, whether or not the list has it.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

THRESHOLD = 0.5
PARTNERS = 3  # different family names beside a learned given name
NAME_BITS = 1 << 24  # the filter of learned names (2 MB), whatever the input; what passes by chance still needs its context
KINDS = ("email", "id_number", "address", "phone", "name")

# Common given names of several languages.
GIVEN_NAMES = set(
    "aaron adam agnes ahmed aiko aisha akira alan alba albert alberto alejandro alex alexander alice alina amelie amir ana anders andrea andreas andré andrew angela anita anna anne antoine anton antonio arno arthur astrid "
    "barbara beatriz ben benjamin bernd bettina boris brian bruno callum camille carla carlos carmen caroline catherine charles charlotte chidi chloé christian claire claudia clara daniel dario david devika diego dmitri "
    "elena elin eleni elif elisabeth elizabeth emil emily emma eric erik esther eva farah fatima felix fiona francisco françois frank fritz gabriel george giulia goran greta hana hannah hans harold heidi helen helga henry hugo "
    "ian ibrahim igor ilse inés ingrid irina isabel ivan ivo jack jakob james jan jana javier jean jennifer joão johannes john jonas jorge josé julia jürgen karen karl katarina keiko kenji kwame lars laura lena leon linda louis lucas lucía luis lukas "
    "magda maria marie mark marta martin mary mateus matthew max mehmet michael michel miguel mila milan mohammed monika nadia natalia nicolas nina noor nora olga oliver omar oskar owen pablo patricia paul pavel pedro peter philipp pierre priya quentin "
    "rachel rafael ravi renée ricardo robert rosa ruth samuel sandra sarah sebastian sergei silvia simon sofia sophie stefan stella susan søren tamsin tanja teresa thomas tomas ulrika ursula valentina vera victor viktor vladimir wanda werner william yara yuki yusuf zoe zora".split()
)
_HONORIFICS = r"(?:(?:PD|Priv\.-Doz\.|Prof|Dr|Doctor|Professor|Mr|Mrs|Ms|Miss|Mx|Mme|Mlle|Monsieur|Madame|Herr|Frau|Herrn|Señora|Señor|Sra|Sr|Dra|Sir|Dame|Nurse|Schwester)\.?)"
# Words that make the words beside them an institution, a score or a role rather than a person.
_NOT_PERSON = set("team board group centre center clinic hospital university institute department ward unit society index score criteria criterion margin scale trial study cohort method test rule staging syndrome disease stain type criteria editor reader anonymous fellow nurse resident watcher desk support admin office pharmacy tumor tumour the a an our this".split())
# Words that begin a sentence or close a letter, and so are no part of the name before or after them.
_STARTERS = set("a an and are as ask at agree also best but by call cc contact dear die der das dose el for from follow great greetings hello her hi his how i if in is it kind la las le les lives los many merci my no not of on once order our please pmid post protocol reach regards send see she he signed sincerely since stage still survival text thank thanks that the their there they this to updated visit wall was we were what when why with write you your yours bitte doi nct mrn ssn nhs".split())
_DEGREES = r"(?:,?\s*(?:MD|PhD|MBBS|FRCR|MSc|BSc|RN|DO|DPhil|Jr|Sr)\b\.?)*"

_LOCAL = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+'-]*[A-Za-z0-9À-ÿ_+-])?"
_AT = r"(?:\s?[@＠]\s?|\s*[\[({<]\s*(?:at|AT|At|@)\s*[\])}>]\s*|\s+(?:at|AT)\s+)"
_DOT = r"(?:\s?[.．]\s?|\s*[\[({<]\s*(?:dot|DOT|Dot|\.)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"(?<![\w.+-])(?:mailto:)?<?(?P<local>{_LOCAL})(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})*?(?P<dot>{_DOT})(?P<tld>[A-Za-z]{{2,12}}))(?![\w@])>?")
_AT_SIGNS = ("@", "＠", " at ", " AT ", "(at", "(AT", "[at", "[AT", "{at", "<at", "( at", "[ at", "(At", "[At", "At ")

_ID_LABEL = r"(?P<label>NHS(?:\s+(?:no|number|nr))?|SSN|social\s+security(?:\s+(?:no|number|nr))?|(?:national\s+)?insurance\s+(?:no|number|nr)|NINO?|MRN|(?:hospital|patient|medical\s+record|record|case)\s+(?:no|number|nr|id)|passport(?:\s+(?:no|number|nr))?|(?:national\s+)?ID(?:\s+(?:card|number|no|nr))|identity\s+card|DNI|NIE|NIF|CPF|NIR|SIN|Personalausweis(?:nummer)?|Ausweis(?:nummer)?|Versicherten(?:nummer|nr)|Reisepass|personnummer|PESEL|BSN|AHV(?:-Nr)?|numéro\s+de\s+sécurité\s+sociale|Steuer-?ID|tax\s+id)"
_ID_LABELLED = re.compile(rf"(?<!\w){_ID_LABEL}[.:#]?\s*(?:is|:|#|no\.?|nr\.?)?\s*(?P<value>(?=[A-Z0-9/ .-]*\d)[A-Z0-9](?:[A-Z0-9]|[ ./-](?=[A-Z0-9/]*\d|[A-D](?![A-Za-z])|[A-Z]\d))*)(?![A-Za-z])", re.I)
# Lower-case words that the labels above begin with.
_ID_WORDS = set("nhs ssn social national insurance nin nino mrn hospital patient medical record case passport id identity dni nie nif cpf nir sin personalausweis personalausweisnummer ausweis ausweisnummer versicherten versichertennummer versichertennr reisepass personnummer pesel bsn ahv numéro steuer steuerid tax".split())
_ID_GATE = re.compile(r"(?<![\w.-])(?:\d{3}[- ]\d{2,3}[- ]\d{4}|\d{8}-?[A-Z]|[XYZ]\d{7}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}|\d{6}[-+]\d{4})")
_ID_BARE = [
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("dni", re.compile(r"(?<![\w-])(?:\d{8}|[XYZ]\d{7})-?[A-Z](?![\w-])")),
    ("nino", re.compile(r"(?<![\w-])[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w-])")),
    ("nhs", re.compile(r"(?<![\w.-])\d{3}[ -]\d{3}[ -]\d{4}(?![\w-])")),
    ("nir", re.compile(r"(?<![\w-])[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}(?![\w-])")),
    ("luhn", re.compile(r"(?<![\w-])\d{6}[-+]\d{4}(?![\w-])")),
]

_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Close|Court|Ct|Terrace|Row|Bank|Way|Place|Pl|Square|Sq|Crescent|Cres|Gardens|Grove|Hill|Mews|Parade|Walk|Boulevard|Blvd|Rise|Wharf|Yard|Quay|Highway|Hwy|Parkway)"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s+\w+,\s*)?(?<![\w.])\d{{1,5}}[A-Za-z]?,?\s+(?:[A-ZÀ-Þ][\w'’-]*\s+){{1,3}}{_STREET_EN}(?![\w'])\.?(?:,\s*[A-ZÀ-Þ][\w-]+(?:\s[A-ZÀ-Þ][\w-]+)?(?:\s+\d{{4,6}})?)?"
    rf"|(?<![\w.])\d{{1,5}}[a-z]?,?\s+(?:[a-z][\w'’-]*\s+){{1,3}}(?:street|road|avenue|lane|drive|close|court|terrace|row|bank|way|square|crescent|gardens|grove|hill|mews|walk|boulevard)(?=,)(?:,\s*[a-z][\w-]+)?"
    r"|(?<!\w)(?:P\.?\s?O\.?\s?Box|Post\s?Office\s+Box|Postfach|Apartado(?:\s+de\s+correos)?|Boîte\s+postale|B\.?P\.)\s*\d+(?:,\s*[A-ZÀ-Þ][\w-]+)?"
    r"|(?<![\w.])\d{1,4}(?:\s?(?:bis|ter|[A-Da-d]))?,?\s+(?:rue|avenue|boulevard|chemin|impasse|place|allée|quai)\s+(?:(?:de|du|des|d'|la|le|les|l')\s*)*[A-ZÀ-Þ][\w'’-]*(?:\s[A-ZÀ-Þ][\w'’-]*)?(?:,\s*\d{5}\s+[A-ZÀ-Þ][\w-]+)?"
    r"|(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Via|Viale|Piazza|Rua|Carrer)\s+(?:(?:de|del|la|las|los|el|da|do|della|di)\s+)*[A-ZÀ-Þ][\w'’-]*(?:\s(?:de\s+)?[A-ZÀ-Þ][\w'’-]*)?,?\s+(?:n[ºo°.]\s*)?\d{1,4}(?:,\s*\d{1,2}\s?[ºª°][A-Za-z]?\w*)?"
    r"|(?<!\w)[A-ZÀ-Þ][\wß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|chaussee|gatan|vägen|laan|straat)\s+\d{1,4}\s?[a-z]?(?!\w)(?:,\s*\d{4,5}\s+[A-ZÀ-Þ][\w-]+|,\s*[A-ZÀ-Þ][\w-]+)?"
)
# Lower-case words and word ends without which nothing above can match.
_ADDRESS_WORDS = set("street st road rd avenue ave lane ln drive close court ct terrace row bank way place pl square sq crescent cres gardens grove hill mews parade walk boulevard blvd rise wharf yard quay highway hwy parkway box postfach apartado postale bp rue chemin impasse allée quai calle c avenida avda plaza paseo via viale piazza rua carrer".split())
_ADDRESS_ENDS = ("straße ", "strasse ", "str. ", "weg ", "allee ", "gasse ", "platz ", "ring ", "damm ", "ufer ", "chaussee ", "gatan ", "vägen ", "laan ", "straat ")

_PHONE = [
    (0.9, re.compile(r"(?<![\w+])(?:tel:)?(?:\+|00)\s?[1-9]\d{0,2}[\s.(/-]*(?:\(0\)\s?)?(?:\(?\d{1,5}\)?[\s./-]{0,3}){1,6}\d{2,4}(?![\w-])")),
    (0.7, re.compile(r"(?<![\w)])\(0?\d{2,4}\)\s?\d{3,5}[ -]?\d{2,5}(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w-])")),
    (0.6, re.compile(r"(?<![\w.-])0[1-9](?:[ .]\d{2}){4}(?![\w-])")),
    (0.6, re.compile(r"(?<![\w.-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\w-])")),
    (0.55, re.compile(r"(?<![\w.-])[2-9]\d{2}\s?[./-]\s?[2-9]\d{2}\s?[./-]\s?\d{4}(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w-])")),
    (0.8, re.compile(r"(?<![\w.-])[2-9]\d{2}\W{1,3}(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[ -]){2}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\W{1,3}\d{4}(?![\w-])", re.I)),
    (0.5, re.compile(r"(?<![\w.-])[2-9]\d{2}[2-9]\d{6}(?![\w-])")),
    (0.25, re.compile(r"(?<![\w.-])[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w-])")),
]
_PHONE_GATE = re.compile(r"(?<!\w)(?:(?:tel:)?\+|00)\s?[1-9]|\(0?\d{2,4}\)\s?\d{3}|(?<![\w.-])(?:0[1-9][ .]\d{2}[ .]|0\d{2,4}[ /-]\d{3}|[2-9]\d{2}(?:\s?[./-]?\s?[2-9]\d{2}\s?[./-]?\s?\d{4}|\W{1,3}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)))", re.I)
_PHONE_CUE = re.compile(r"(?:\b(?:call|ring|text|phone|tel|telephone|mobile|cell|pager|fax|reach|direct|line|joignable|whatsapp|sms|desk|answers)\b)[^.!?]{0,25}$", re.I)
_PHONE_CUE_AFTER = re.compile(r"^\W{0,3}(?:is my (?:direct )?(?:line|number|cell)|ext\b|after clinic|if urgent)", re.I)
_COUNT_CUE = re.compile(r"(?:\b(?:order(?:\s+set)?|pmid|doi|lot|protocol|version|cost(?:\s+was)?|units?|isrctn|nct|no\.|item|ref|batch|invoice|record)\b|[np]=)[ :#=-]{0,3}(?:\w+[ :#-]{1,2})?$", re.I)
_COUNT_AFTER = re.compile(r"^\s*(?:units|mg|ml|gy|patients|participants|records|euros?|dollars|%)", re.I)

_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLED = re.compile(rf"(?<![\w@.+-]){_HONORIFICS}(?:[^\S\n]+{_HONORIFICS})*[^\S\n]+(?P<name>(?:[A-ZÀ-Þ]\.\s*)*[A-ZÀ-Þ][^\W\d_]*(?:[-'’][^\W\d_]+)*(?:,?[^\S\n]+[A-ZÀ-Þ](?:\.|[^\W\d_]*(?:[-'’][^\W\d_]+)*))?)")
_INITIALS = re.compile(r"(?<![\w@.+-])(?:[A-ZÀ-Þ]\.\s{0,3})+[A-ZÀ-Þ][^\W\d_]{2,}(?:[-'’][A-ZÀ-Þ][^\W\d_]+)?(?![\w@-])")
_NAME_CUE = re.compile(r"(?:\b(?:signed|greetings|regards|yours|sincerely|dear|hi|hello|hallo|bonjour|ask|thanks to|thank|my patient|patient|as|discussed this with|with|cc|from|by|colleague|contact|name is|named|called|merci à|danke|gracias a|frau|herr)[,:]?|--)\s*$", re.I)
_NAME_CUE_AFTER = re.compile(r"^[,\s]*(?:disagree|raised|said|say|had the same|yesterday|about dosing|for the reference|wrote|write|report|ask|told|suggest|argue|agree|note|think|call|present|confirm|MD\b|PhD\b|$|\n|\()", re.I)


def _dni(text: str) -> bool:
    digits = re.sub(r"\W", "", text.upper())
    number = digits[:-1].translate(str.maketrans("XYZ", "012"))
    return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == digits[-1]


def _mod11(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    return len(d) == 10 and (11 - sum((10 - i) * x for i, x in enumerate(d[:9])) % 11) % 11 == d[9]


def luhn(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()][::-1]
    return len(d) > 1 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97(text: str) -> bool:
    """The key of a French social security number."""
    d = re.sub(r"\D", "", text)
    return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])


_CHECKS = {"dni": (0.3, _dni, 0.3), "nhs": (0.1, _mod11, 0.35), "nir": (0.2, mod97, 0.5), "luhn": (0.2, luhn, 0.35), "ssn": (0.6, None, 0), "nino": (0.6, None, 0)}


def _emails(text: str) -> list[tuple[int, int, float]]:
    if not any(sign in text for sign in _AT_SIGNS):
        return []
    out, at = [], 0
    while m := _EMAIL.search(text, at):
        sign, dot, local = m["at"], m["dot"], m["local"]
        worded = sign.strip().lower() == "at"
        spelled = "dot" in dot.lower()
        score = 0.9 if sign.strip() in "@＠" else 0.8
        if worded:
            score = 0.75 if spelled else 0.15  # "look at the. end" is no address
        if sign.strip() in "@＠" and sign != sign.strip() and dot != dot.strip():
            score = 0.2  # "5 mg @ week. Then"
        if not any(c.isalpha() for c in local):
            score -= 0.5
        if score >= THRESHOLD:
            out.append((m.start(), m.end(), score))
            at = m.end()
        else:
            at = m.start("at") + len(sign)
    return out


def _ids(text: str, words: set[str]) -> list[tuple[int, int, float]]:
    out = []
    if not _ID_WORDS.isdisjoint(words):
        for m in _ID_LABELLED.finditer(text):
            value = m["value"]
            digits = sum(c.isdigit() for c in value)
            score = 0.85 if digits >= 5 else 0.2
            if m["label"].upper() in ("DNI", "NIE", "NIF") and not _dni(value):
                score -= 0.1
            out.append((m.start("value"), m.end("value"), score))
    if _ID_GATE.search(text):
        for kind, pattern in _ID_BARE:
            for m in pattern.finditer(text):
                base, check, bonus = _CHECKS[kind]
                score = base + (bonus if check and check(m[0]) else 0)
                if _COUNT_CUE.search(text[max(0, m.start() - 24) : m.start()]) or _COUNT_AFTER.match(text[m.end() : m.end() + 12]):
                    score -= 0.5
                out.append((m.start(), m.end(), score))
    return [x for x in out if x[2] >= THRESHOLD]


def _addresses(text: str, words: set[str], low: str) -> list[tuple[int, int, float]]:
    if _ADDRESS_WORDS.isdisjoint(words) and not any(end in low for end in _ADDRESS_ENDS):
        return []
    return [(m.start(), m.end(), 0.8) for m in _ADDRESS.finditer(text)]


def _phones(text: str) -> list[tuple[int, int, float]]:
    if not _PHONE_GATE.search(text):
        return []
    out = []
    for base, pattern in _PHONE:
        for m in pattern.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if not 7 <= digits <= 17 and base != 0.8:
                continue
            before, after, score = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 24], base
            if _PHONE_CUE.search(before) or _PHONE_CUE_AFTER.match(after):
                score += 0.3
            if base < 0.8 and (_COUNT_CUE.search(before) or _COUNT_AFTER.match(after)):
                score -= 0.6
            out.append((m.start(), m.end(), score))
    return [x for x in out if x[2] >= THRESHOLD]


def _names(text: str, display: bool, known: set[str], names: Container[str]) -> list[tuple[int, int, float]]:
    out = []
    if given := {w for w in known if w in names}:
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        lowered = [w.lower() for _, _, w in words]
        for i, (start, end, word) in enumerate(words):
            if lowered[i] not in given or (start and text[start - 1] in "@_+") or text[end : end + 1] in ("@", "_") or re.match(r"[-+.]?\d", text[end : end + 2]):
                continue
            first, last = start, end
            titled = word[0].isupper()
            partner = 0.0
            after, before = text[end : words[i + 1][0]] if i + 1 < len(words) else None, text[words[i - 1][1] : start] if i else None
            if after is not None and words[i + 1][2][0].isupper() == titled and re.fullmatch(r"\s+|\s+", after) and lowered[i + 1] not in _NOT_PERSON and lowered[i + 1] not in _STARTERS and words[i + 1][2].isupper() <= word.isupper() + (len(words[i + 1][2]) == 1):
                follower = words[i + 1]
                if len(follower[2]) == 1 and text[follower[1] : follower[1] + 1] == ".":
                    partner, last = 0.25, follower[1] + 1
                    if i + 2 < len(words) and words[i + 2][2][0].isupper() and re.fullmatch(r"\.\s+", text[follower[1] : words[i + 2][0]]) and _NAME_CUE_AFTER.match(text[words[i + 2][1] :]):
                        last = words[i + 2][1]
                elif len(follower[2]) > 2:
                    partner, last = (0.2 if titled else 0.15), follower[1]
            if not partner and before is not None and len(words[i - 1][2]) > 2 and words[i - 1][2][0].isupper() == titled and re.fullmatch(r",?\s+", before) and lowered[i - 1] not in _NOT_PERSON and lowered[i - 1] not in _STARTERS and not re.search(r"[^\W\d_]\W*$", text[: words[i - 1][0]][-1:] or ""):
                partner, first = (0.2 if titled else 0.1), words[i - 1][0]
            score = (0.4 if titled else 0.2) + partner + (0.25 if display else 0.0)
            left, right = text[max(0, first - 24) : first], text[last : last + 24]
            cue = _NAME_CUE.search(left) or _NAME_CUE.search(text[max(0, start - 24) : start])
            follow = _NAME_CUE_AFTER.match(right) or _NAME_CUE_AFTER.match(text[end : end + 24])
            score += 0.3 * bool(cue) + 0.25 * bool(follow)
            following = re.match(r"[\s-]*([^\W\d_]+)", text[end:])
            if following and following[1].lower() in _NOT_PERSON and not cue:
                score -= 0.6
            out.append((first, last, score))
    for m in _TITLED.finditer(text):
        name = m["name"]
        parts = _WORD.findall(name)
        if parts and parts[0].lower() not in _NOT_PERSON:
            over = parts[-1].lower() in _STARTERS and len(parts) > 1
            out.append((m.start("name"), m.start("name") + (len(name[: name.rindex(parts[-1])].rstrip(" ,")) if over else len(name)), 0.75))
    for m in _INITIALS.finditer(text):
        left, right = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 24]
        out.append((m.start(), m.end(), 0.3 + 0.25 * bool(_NAME_CUE.search(left)) + 0.25 * bool(_NAME_CUE_AFTER.match(right)) + (0.3 if display else 0.0)))
    if display and not out:
        m = re.fullmatch(rf"\s*(?P<name>[A-ZÀ-Þ][^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?,?\s+[A-ZÀ-Þ](?:\.|[^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?)){_DEGREES}\s*", re.sub(r"\W*\x00+\W*", " ", text))
        if m and not set(re.findall(r"[^\W\d_]+", m["name"].lower())) & _NOT_PERSON:
            out.append((0, len(text), 0.55))
    return [x for x in out if x[2] >= THRESHOLD]


class Names:
    """The given names of the list and those in a filter of learned ones."""

    def __init__(self, bits: bytes = b"", listed: set[str] | None = None):
        self.listed = GIVEN_NAMES if listed is None else listed
        self.bits = np.frombuffer(bits, np.uint8)
        self.learned = lru_cache(maxsize=1 << 17)(self._learned)

    def _learned(self, word: str) -> bool:
        return bool(len(self.bits)) and len(word) > 1 and all(self.bits[at >> 3] >> (at & 7) & 1 for at in _places(word))

    def __contains__(self, word: object) -> bool:
        return word in self.listed or self.learned(word)


def _places(word: str) -> tuple[int, int]:
    h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h % NAME_BITS, (h >> 32) % NAME_BITS


def _set_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.array([p for w in batch.column(0).to_pylist() for p in _places(w)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "one"])


def given_names(comments: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """given: the words that are given names by their place in display names of two words.

    Such a word has at least ``partners`` different words in the family name's
    place beside it, and more than it has beside itself when it stands there.
    Roles, honorifics and common first words are none.
    """
    shown = comments.select(F.lower("display_name").alias("shown")).distinct()
    word, tail = r"[^\W\d_]{2,}(?:-[^\W\d_]+)?", r"(?:,?\s*(?:md|phd|mbbs|frcr|msc|bsc|rn|do|dphil|jr|sr)\b\.?)*\s*$"
    plain, turned = rf"(?U)^\s*({word})\s+([^\W\d_]{{3,}}(?:[-'’][^\W\d_]+)?){tail}", rf"(?U)^\s*([^\W\d_]{{3,}}(?:[-'’][^\W\d_]+)?),\s+({word}){tail}"
    took = lambda pattern, given, family: F.struct(F.regexp_extract("shown", pattern, given).alias("given"), F.regexp_extract("shown", pattern, family).alias("family"))
    pairs = shown.select(F.when(F.col("shown").rlike(plain), took(plain, 1, 2)).when(F.col("shown").rlike(turned), took(turned, 2, 1)).alias("p")).where("p is not null").select("p.given", "p.family").distinct()
    roles = F.lit("|".join(["", *sorted(_NOT_PERSON | _STARTERS | {"dr", "prof", "doctor", "professor", "miss", "herr", "frau", "madame", "monsieur", "sir", "dame"}), ""]))
    pairs = pairs.where(~roles.contains(F.concat(F.lit("|"), "given", F.lit("|"))) & ~roles.contains(F.concat(F.lit("|"), "family", F.lit("|"))))
    # a row for each place a word has, so that a name beside very many others is counted in parts
    placed = pairs.select(F.col("given").alias("word"), F.lit(1).alias("first")).unionByName(pairs.select(F.col("family").alias("word"), F.lit(0).alias("first")))
    counts = placed.groupBy("word").agg(F.sum("first").alias("as_given"), F.count("*").alias("all"))
    return counts.where((F.col("as_given") >= partners) & (F.col("as_given") * 2 > F.col("all"))).select(F.col("word").alias("given"))


def learned_filter(comments: DataFrame) -> bytes:
    """The learned given names as a filter; at most NAME_BITS / 64 rows reach the driver."""
    got = given_names(comments).mapInArrow(_set_places, "word long, one long").groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    out = np.zeros(NAME_BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


_LISTED = Names()


def spans(text: str | None, display: bool = False, names: Container[str] = _LISTED) -> list[tuple[int, int, str, float]]:
    """Disjoint (start, end, kind, score) spans in order of place; none in a null or empty text."""
    if not text:
        return []
    left, found, low = text, [], text.lower()
    words = set(_PLAIN_WORD.findall(low))
    for kind in KINDS:
        hits = _emails(left) if kind == "email" else _ids(left, words) if kind == "id_number" else _addresses(left, words, low) if kind == "address" else _phones(left) if kind == "phone" else _names(left, display, words, names)
        for start, end, score in sorted(hits, key=lambda x: (-x[2], x[0], -x[1])):
            if "\x00" not in left[start:end]:
                found.append((start, end, kind, score))
                left = left[:start] + "\x00" * (end - start) + left[end:]
    return sorted(found)


def redact(text: str | None, display: bool = False, names: Container[str] = _LISTED) -> str | None:
    """The text with each span replaced by its kind in brackets, otherwise unchanged; null stays null."""
    found = spans(text, display, names)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind, _ in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _kinds(shared):  # noqa: ANN001, ANN202
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(shared.value)
        for batch in batches:
            ids, fields, kinds = [], [], []
            for field, display in (("content", False), ("display_name", True)):
                known: dict[str, list[str]] = {}
                for key, text in zip(batch.column("comment_id").to_pylist(), batch.column(field).to_pylist()):
                    if not text:
                        continue
                    if (mine := known.get(text)) is None:
                        mine = known[text] = sorted({k for _, _, k, _ in spans(text, display, names)})
                    for kind in mine:
                        ids.append(key)
                        fields.append(field)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(fields, pa.string()), pa.array(kinds, pa.string())], names=["comment_id", "field_name", "kind"])

    return give


def personal_kinds(comments: DataFrame) -> DataFrame:
    """comment_id, field_name and kind, once for each kind that occurs in a field; repeated rows count once."""
    shared = comments.sparkSession.sparkContext.broadcast(learned_filter(comments))
    return comments.select("comment_id", "content", "display_name").mapInArrow(_kinds(shared), "comment_id string, field_name string, kind string").distinct()


def _redacted(shared):  # noqa: ANN001, ANN202
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(shared.value)
        for batch in batches:
            content = pa.array([redact(t, False, names) for t in batch.column("content").to_pylist()], pa.string())
            display = pa.array([redact(t, True, names) for t in batch.column("display_name").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("comment_id"), display, content], names=["comment_id", "display_name", "content"])

    return give


def redacted(comments: DataFrame) -> DataFrame:
    """Each distinct comment row with typed placeholders; nulls and empty texts stay."""
    rows = comments.select("comment_id", "display_name", "content")
    shared = comments.sparkSession.sparkContext.broadcast(learned_filter(comments))
    return rows.mapInArrow(_redacted(shared), "comment_id string, display_name string, content string").distinct()
