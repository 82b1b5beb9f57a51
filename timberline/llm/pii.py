"""Personal information in free text: found by anchor expansion, replaced by typed placeholders.

Aho-Corasick automata find anchors (at-signs and their spelled forms, identifier, introduction and title
cues, street words, known names), and runs of digits are anchors of numbers; deterministic local parsers
expand each anchor to the borders of an email, phone number, identity number, street address or person name
and validate it. Nothing but the anchors' surroundings is parsed.

The name lexicon and the contexts of names are learned from the corpus itself, over all rows: words that
stand in naming slots ("my name is ...", "Dr. ...") are counted against their use as plain lower-case
words; what stands around sure names is counted in tables of a fixed number of hashed buckets and belongs to
names from a share of the counts on, whatever the size of the corpus. A word that
is also a common one ("Will", "Hope"), or stands in one naming slot only, counts as a name elsewhere only in
a context that sure names have too. What stands in a naming slot is a mention by itself, unless it is a word
of plain use. The lexicon is a table of any size; each chunk of texts is given the names that occur in it.

Defined results: null and empty texts hold no mention and stay as they are; offsets count code points;
of overlapping finds the one of the stronger kind stays; repeated rows give repeated mentions under their
own id; extra columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
BUCKETS = 1 << 20
#: Texts, and characters of texts, that share one lookup in the name lexicon.
CHUNK, CHUNK_CHARS = 2048, 1 << 19
#: Bits of the filter of lexicon words that goes to every executor (1 MB).
FILTER_BITS = 1 << 23
#: A context belongs to names if this share of the contexts of sure names is like it (and two at least are).
CONTEXT_SHARE = 5e-5

# Cue words and formats.
_AT = ("@", "(at)", "[at]", "{at}", " at ", "mailto:")
_STREET_EN = "street st road rd lane ln avenue ave close drive dr court ct row terrace way crescent square place hill gardens grove mews walk".split()
_STREET_LEAD = ("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "rue", "avenue", "impasse", "boulevard", "chemin", "allée", "quai", "via", "viale", "piazza", "corso", "vicolo", "largo", "rua", "av", "travessa", "praça", "estrada", "alameda", "am", "an der", "auf dem", "zum", "zur", "im", "ул", "улица", "проспект", "пр-т", "переулок", "площадь", "oude", "nieuwe")
_STREET_ANCHORS = ("route", "passage", "cours", "проезд", "бульвар", "набережная", "шоссе", "пер.", "пл.", "пр.")
_STREET_TAIL = ("straße", "strasse", "str", "weg", "kehre", "gasse", "allee", "platz", "ring", "graben", "ufer", "damm", "steig", "straat", "laan", "kade", "gracht", "plein", "dijk", "singel", "dreef", "pad")
_HOME_CUES = ("vivo en", "j'habite", "j’habite", "ich wohne", "ik woon", "abito in", "eu moro", "мой адрес", "живу", "address:", "adresse", "dirección", "indirizzo", "endereço", "адрес:", "adres:")
_ID_CUES = ("passport", "identity", "insurance", "health", "national id", "id:", "identidad", "identidade", "identité", "ausweis", "documento", "burgernummer", "паспорт", "снилс", "social security", "medicare", "patient")
_PHONE_CUES = ("call", "text me", "tel", "phone", "voicemail", "ring", "teléfono", "telefon", "telefone", "téléphone", "телефон", "llama", "chiama", "bel", "number is", "nummer", "numéro", "номер", "numero è", "mobile", "whatsapp")

_INTRODUCED = ("my name is", "i am called", "me llamo", "mi nombre es", "je m'appelle", "je m’appelle", "mon nom est", "ich heiße", "ich heisse", "mein name ist", "ik heet", "mijn naam is", "mi chiamo", "il mio nome è", "meu nome é", "me chamo", "меня зовут", "моё имя", "signed", "regards", "best wishes", "yours")
_RELATED = ("my friend", "my doctor", "my colleague", "my therapist", "my counsellor", "my nurse", "my partner", "my brother", "my sister", "my cousin", "my neighbour", "my boss", "my teacher")
_ASKED_FOR = ("llama a", "pregunta por", "chiama", "chiedi di", "bel", "vraag naar", "liga para", "appelle", "demande", "ask for", "frag nach", "спросить")
_TITLES = "dr dra prof mr mrs ms miss herr frau sr sra srta mme mlle dhr mevr mevrouw sig dott senhor senhora señor señora господин госпожа".split()

#: Titles and street words are no names, even in a naming slot; nor are the words of the cues themselves.
_NO_NAME = frozenset(_TITLES) | frozenset(_STREET_EN)
_CUE_WORDS = frozenset(_TITLES) | {w.strip(":.") for cue in (*_INTRODUCED, *_RELATED, *_ASKED_FOR, *_ID_CUES, *_PHONE_CUES, *_HOME_CUES, *_AT) for w in cue.split()}

_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_DIGIT_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_HOUSE_NO = re.compile(r"\d")
_SPOKEN = re.compile(rf"\b{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{6,}}\b", re.I)
_L, _R = r"(?<![\w@.,/+-])", r"(?![\w@]|[.,/-]\d)"
_PHONES = [re.compile(p) for p in (
    r"(?<![\w@.,/-])(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,8}){1,4}" + _R,
    r"(?<![\w@.,/-])(?:[0-9] )?\(\d{2,5}\)[ -]?\d{2,8}(?:[ -]\d{2,5}){0,3}" + _R,
    _L + r"\d{3}[-.]\d{3}[-.]\d{4}" + _R,
    _L + r"0\d{4}[ -/]\d{6}" + _R,
    _L + r"0\d{10}" + _R,
    _L + r"0\d{2} \d{4} \d{4}" + _R,
    _L + r"0\d{3} \d{3} \d{3}" + _R,
    _L + r"0\d(?:[ .]\d\d){4}" + _R,
    _L + r"0\d{2,4}[/ -]\d{5,8}" + _R,
    _L + r"[89]-?\d{3}-\d{3}-\d\d-\d\d" + _R,
    _L + r"\d{3}-\d{4}" + _R,
)]
_IDS = [re.compile(p) for p in (
    _L + r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]" + _R,
    _L + r"[A-Za-z]{2}\d{7}" + _R,
    _L + r"\d{3}-\d{2}-\d{4}" + _R,
    _L + r"\d{8}-?[A-Za-z]" + _R,
    _L + r"\d{2} \d{3} \d{3} \d{3}" + _R,
    _L + r"9\d{2} \d{3} \d{4}" + _R,
    _L + r"\d{9}" + _R,
)]

_LOCAL = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+'-]*[A-Za-z0-9À-ÿ+_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL_LEFT = re.compile(rf"({_LOCAL})\s?$")
_EMAIL_RIGHT = re.compile(rf"\s?{_LABEL}(?:(?:\.|\s?[\[({{]dot[\])}}]\s?| dot ){_LABEL})+", re.I)
_EMAIL_SPOKEN = re.compile(rf"{_LABEL}(?:(?:\.|\s?[\[({{]dot[\])}}]\s?| dot ){_LABEL})+", re.I)

_UNIT = r"(?:(?:flat|apt|apartment|unit|suite|room|no)\.? ?\d{1,4}[a-z]?,? )"
_HOUSE_NAME = r"(?:[A-Z][\w'’-]+ (?:House|Cottage|Lodge|Farm|Hall|Manor|Villa|Barn|Mill)\b,? )"
_NUM = r"\d{1,4} ?(?:bis|ter)?[a-z]?(?:[-/]\w{1,3})?"
_EN_ADDRESS = re.compile(rf"(?<![\w/-])(?:{_UNIT}?(?:\d{{1,4}}[a-z]?,? |{_HOUSE_NAME})|{_UNIT})(?:(?:St\.? )?[\w'’-]+ ){{1,3}}(?:{'|'.join(_STREET_EN)})\b", re.I)
_HOUSE_ADDRESS = re.compile(rf"\b{_UNIT}?[A-Z][\w'’-]+ (?:House|Cottage|Lodge|Farm|Hall|Manor|Villa|Barn|Mill), (?:(?:St\.? )?[\w'’.-]+ ){{1,3}}(?:{'|'.join(_STREET_EN)})\b", re.I)
_LEAD_ADDRESS = re.compile(rf"(?<![\w'’])(?:(?:{_NUM}),? )?(?:{'|'.join(re.escape(x) for x in sorted(_STREET_LEAD, key=len, reverse=True))})\.? ?(?:(?:de|des|du|del|della|delle|dei|di|da|do|dos|das|la|le|los|las|al)\s|d['’]|l['’])*(?:[\w'’-]+[ ,]{{0,2}}){{1,4}}?(?:дом |д\. ?|n[º°.]? ?)?\d{{1,4}}(?!\d)", re.I)
_NUM_LEAD_ADDRESS = re.compile(r"(?<![\w/-])\d{1,4}(?: ?(?:bis|ter|quater|[a-z]))?,? (?:rue|avenue|impasse|boulevard|chemin|allée|place|quai|cours|passage|route) (?:(?:de|des|du|la|le|les) |d['’]|l['’])*[\w'’-]+", re.I)
_TAIL_ADDRESS = re.compile(rf"(?<![\w/-])[A-ZÀ-Ýa-z][\w-]*?(?:{'|'.join(_STREET_TAIL)})\.? \d{{1,4}}(?!\d)", re.I)
_TOWN = re.compile(r"(?:, ?|\n)(?:(?:[A-ZÀ-Ý][\w-]+(?: [A-ZÀ-Ý][\w-]+(?=[,.\n]|$))?)(?:(?:, | )[A-Z]{1,2} ?\d{1,5}(?: ?\d[A-Z]{2})?)?|\d{5} [A-ZÀ-Ý][\w-]+)")
_RU_ADDRESS = re.compile(r"(?<![\w-])(?:[А-ЯЁ][а-яё-]+ (?:переулок|проезд|улица|проспект|бульвар|площадь|набережная|шоссе)|(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|пл\.|площадь|бульвар|набережная|шоссе) ?[А-ЯЁ][\w -]*?),? (?:дом |д\. ?)?\d{1,4}", re.I)

_PART = r"(?:de la|de los|de|del|della|di|da|dos|van der|van den|van de|van|von der|von|ter|ten|al|el|bin|la|le)"
_CAP = r"[A-ZÀ-ÝŠŽА-ЯЁ][\w’'-]*[\wа-яё]"
_NAME_SEQ = rf"(?:{_CAP}|{_PART} {_CAP}|[A-ZÀ-Ý]\.)(?:,? (?:{_CAP}|{_PART} {_CAP}|[A-ZÀ-Ý]\.)){{0,3}}"
_SLOT, _TITLED = re.compile(rf"[:,]? ({_NAME_SEQ})"), re.compile(rf"\.? ({_NAME_SEQ})")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_WITHIN = re.compile(r"[^\W\d_],? $")
_MID = re.compile(r"(?:(?<=[^\W\d_] )|(?<=[^\W\d_], ))[A-ZÀ-ÝŠŽА-ЯЁ][^\W\d_]*(?:[’'-][^\W\d_]+)*")
_MAIL_LIKE = re.compile(r"\S+ ?(?:@|[\[({]at[\])}]) ?\S+|\S+ at \S+ dot \S+", re.I)
_DIGITS = re.compile(r"\d(?:[\d ().,/+-]*\d)?")
_STOP_NAME = frozenset("i i'm the my a an it he she we they you and or but in on at to for of this that today sunday monday tuesday wednesday thursday friday saturday de la los del della di da dos van der den von ter ten al el bin le".split())


def fold(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _names_of(seq: str) -> list[str]:
    return [t for t in _TOKEN.findall(seq) if _may_be_name(t)]


def _may_be_name(token: str) -> bool:
    return len(token) > 1 and token.lower() not in _STOP_NAME and not re.fullmatch(_PART, token.lower())


def _own(token: str) -> str:
    return re.sub(r"['’]s$", "", token)


def _cues() -> ahocorasick.Automaton:
    """The fixed anchors; each has its length and its kinds."""
    kinds: dict[str, set[str]] = {}
    for kind, words in (("at", _AT), ("id", _ID_CUES), ("phone", _PHONE_CUES), ("street", (*_STREET_EN, *_STREET_LEAD, *_STREET_TAIL, *_STREET_ANCHORS)), ("slot", (*_INTRODUCED, *_RELATED, *_ASKED_FOR)), ("title", _TITLES)):
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    auto = ahocorasick.Automaton()
    for w, k in kinds.items():
        auto.add_word(w, (len(w), frozenset(k)))
    auto.make_automaton()
    return auto


_CUES = _cues()


def anchors_of(low: str) -> dict[str, list[tuple[int, int]]]:
    """Where the fixed anchors of each kind stand in a folded text."""
    out: dict[str, list[tuple[int, int]]] = {}
    for end, (size, kinds) in _CUES.iter(low):
        for k in kinds:
            out.setdefault(k, []).append((end + 1 - size, end + 1))
    return out


def slots_of(text: str, anchors: dict[str, list[tuple[int, int]]]) -> Iterator[re.Match]:
    """The name sequences that follow an introduction, a relation or a title."""
    for kind in ("slot", "title"):
        for s, e in anchors.get(kind, ()):
            if (s and text[s - 1].isalnum()) or (kind == "title" and not (text[s].isupper() or text[s] in "гс")):
                continue
            if kind == "slot" and text[s:e].isupper():
                continue  # within shouted words nothing marks a name
            if m := (_TITLED if kind == "title" else _SLOT).match(text, e):
                yield m


def count_words(texts: Iterator[str | None]) -> Counter:
    """(word, use) counts: ``slot`` in a naming slot, ``low`` as a lower-case word, ``cap`` capitalized, ``mid`` so within a sentence."""
    slot, low, cap, mid = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        if not t:
            continue
        folded = fold(t)
        for m in slots_of(t, anchors_of(folded)):
            slot.update(_own(w).lower() for w in _names_of(m.group(1)))
        if "@" in t or " dot " in folded or "at)" in folded or "at]" in folded or "at}" in folded:
            t = _MAIL_LIKE.sub(" ", t)  # names within addresses do not count
        words = _TOKEN.findall(t)
        low.update(w for w in words if w[0].islower())
        cap.update(w for w in words if not w[0].islower() and not w.isupper())
        mid.update(w for w in _MID.findall(t) if not w.isupper())
    n: Counter = Counter()
    for use, c in (("slot", slot), ("low", low), ("cap", cap), ("mid", mid)):
        for w, k in c.items():
            n[_own(w).lower(), use] += k
    return n


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


class Finder:
    """All mentions in a text, given what the corpus taught.

    ``common``: unsure words that hardly ever stand in a naming slot; names only where capitalized within a sentence. ``plain``: words that a slot alone doesn't make a name.
    """

    def __init__(self, sure: frozenset[str], unsure: frozenset[str], contexts: np.ndarray | None = None, common: frozenset[str] = frozenset(), plain: frozenset[str] | None = None) -> None:
        self.sure, self.unsure, self.contexts = sure, unsure, contexts
        self.common, self.plain = common, unsure if plain is None else plain
        self.names = None
        if sure or unsure:
            self.names = ahocorasick.Automaton()
            for word in sure | unsure:
                self.names.add_word(word, len(word))
            self.names.make_automaton()

    def known(self, low: str) -> list[tuple[int, int]]:
        return [(end + 1 - size, end + 1) for end, size in self.names.iter(low)] if self.names else []

    # -- emails

    def _email(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        spoken = text[start:end].lower() == " at "
        left = _EMAIL_LEFT.search(text, max(0, start - 80), start)  # a local part has 64 characters at most
        if not left:
            return None
        tail = text[end : end + 280]  # longer than a host may be
        right = (_EMAIL_SPOKEN if spoken else _EMAIL_RIGHT).match(tail)
        if not right or (spoken and not re.search(r"dot", right.group(), re.I)):
            return None
        begin = left.start(1)
        local = text[begin : left.end(1)]
        if (k := re.match(r"mailto:", local, re.I)) is not None:
            begin += k.end()
        stop = end + right.end()
        host = right.group()
        if "." in host and " dot " not in host.lower() and re.search(r"\.[A-Z][a-z]+$", host) and not re.search(r"[A-Z]", text[begin : end + right.start() + host.rfind(".")]):
            stop -= len(host) - host.rfind(".")
        return begin, stop

    # -- numbers

    def _numbers(self, text: str, low: str, id_cues: list[int], phone_cues: list[int]) -> Iterator[tuple[int, int, str]]:
        for run in _DIGITS.finditer(text):
            if sum(c.isdigit() for c in run.group()) < 6:
                continue
            lo, hi = max(0, run.start() - 4), min(len(text), run.end() + 4)
            for p in _IDS:
                for m in p.finditer(text, lo, hi):
                    kind = "id_number"
                    if m.group().isdigit():
                        near_id = max((c for c in id_cues if c <= m.end() + 40), default=-1)
                        near_phone = max((c for c in phone_cues if c <= m.start()), default=-1)
                        if near_id < m.start() - 60 and near_phone >= m.start() - 25:
                            kind = "phone"
                    yield m.start(), m.end(), kind
            for p in _PHONES:
                for m in p.finditer(text, lo, hi):
                    digits = sum(c.isdigit() for c in m.group())
                    if 7 <= digits <= 15:
                        yield m.start(), m.end(), "phone"
        if sum(low.count(w) for w in _DIGIT_WORDS) >= 7:
            for m in _SPOKEN.finditer(text):
                yield m.start(), m.end(), "phone"

    # -- addresses

    def _addresses(self, text: str, streets: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """Addresses around street words that stand at the border of a word and near a number."""
        parts: list[list[int]] = []
        for s, e in streets:
            if (s and text[s - 1].isalnum()) and (e < len(text) and text[e].isalnum()):
                continue
            lo, hi = max(0, s - 70), min(len(text), e + 70)
            if not _HOUSE_NO.search(text, lo, hi) and "," not in text[lo:s]:
                continue
            if parts and lo <= parts[-1][1]:
                parts[-1][1] = max(hi, parts[-1][1])
            else:
                parts.append([lo, hi])
        for lo, hi in parts:
            for p in (_EN_ADDRESS, _HOUSE_ADDRESS, _NUM_LEAD_ADDRESS, _RU_ADDRESS, _LEAD_ADDRESS, _TAIL_ADDRESS):
                for m in p.finditer(text, lo, hi):
                    yield m.start(), self._with_town(text, m.end()), "street_address"

    @staticmethod
    def _with_town(text: str, end: int) -> int:
        """The end with town and postcode, where they follow."""
        m = _TOWN.match(text, end)
        return m.end() if m else end

    # -- names

    def _is_name(self, word: str) -> bool:
        w = _own(word).lower()
        return w in self.sure or w in self.unsure and w not in self.common

    def _context_keys(self, text: str, start: int, end: int) -> tuple[str, str, str, str]:
        before = text[max(0, start - 60) : start]
        cut = re.split(r"[.!?…\n\xa0]+(?=\s|$)|\n|\xa0", before)[-1] if before else ""
        left = [w.lower() for w in re.findall(r"[^\W_]+(?:[’'-][^\W_]+)*|[:,(«“\"]", cut)][-2:]
        after = re.match(r"['’]s\b|[^\n]{0,40}", text[end : end + 40])
        right = []
        for m in re.finditer(r"['’]s\b|[^\W_]+(?:[’'-][^\W_]+)*|[:,()!?.]", text[end : end + 40] if after else ""):
            w = m.group()
            right.append("<name>" if w[0].isupper() and self._is_name(w) else w.lower() if not w.isdigit() else "0")
            if len(right) == 2 or w in ".!?":
                break
        left = ["<s>"] * (2 - len(left)) + left
        right += ["<e>"] * (2 - len(right))
        return f"l1 {left[1]}", f"l2 {left[0]} {left[1]}", f"r1 {right[0]}", f"r2 {right[0]} {right[1]}"

    def _fits(self, text: str, start: int, end: int, strict: bool = False) -> bool:
        if self.contexts is None:
            return False
        l1, l2, r1, r2 = self._context_keys(text, start, end)
        n = self.contexts
        if strict:
            return bool(n[_bucket(l2)] > 0 and n[_bucket(r2)] > 0)
        if l1 == "l1 <s>" or l1[3:] in ("and", "y", "e", "en", "und", "et", "и"):
            return n[_bucket(r2)] > 0
        return n[_bucket(l1)] > 0 and n[_bucket(r1)] > 0 and (n[_bucket(l2)] > 0 or n[_bucket(r2)] > 0)

    def _sequences(self, text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Runs of neighbouring name words with particles, initials and inverted order."""
        i = 0
        while i < len(hits):
            start, end = hits[i]
            parts = [hits[i]]
            j = i + 1
            while j < len(hits):
                gap = text[end : hits[j][0]]
                if re.fullmatch(rf"(?i: |, | (?:[a-zà-ý]\. )+(?:{_PART} )?|,? {_PART} )", gap):
                    inverted = gap.startswith(",")
                    if inverted and (len(parts) > 1 or text[hits[j][1] : hits[j][1] + 1].isalpha()):
                        break
                    parts.append(hits[j])
                    end = hits[j][1]
                    j += 1
                    if inverted:
                        break
                else:
                    break
            i = j
            if m := re.search(rf"(?<![\w’'])(?:{_PART} )$", text[max(0, start - 12) : start], re.I):
                start -= m.end() - m.start()
            initials = r"[A-ZÀ-Ý]" if text[parts[0][0]].isupper() else r"[a-zà-ý]"
            if m := re.search(rf"(?<![\w.’'])(?:{initials}\. ?){{1,2}}$", text[max(0, start - 9) : start]):
                start -= m.end() - m.start()
            yield start, end, parts

    def _slot_hits(self, text: str, anchors: dict[str, list[tuple[int, int]]]) -> set[tuple[int, int]]:
        """The words in naming slots, without those of plain use and what belongs to a street."""
        out = set()
        for m in slots_of(text, anchors):
            for w in _TOKEN.finditer(m.group(1)):
                word = _own(w.group())
                if _may_be_name(word) and word[0].isupper() and word.lower() not in self.plain and word.lower() not in _NO_NAME and word.lower() not in _CUE_WORDS:
                    out.add((m.start(1) + w.start(), m.start(1) + w.start() + len(word)))
        return out

    def _names(self, text: str, hits: list[tuple[int, int]], learn: bool = False, given: set[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, int, str]]:
        for start, end, parts in self._sequences(text, hits):
            words = [_own(text[s:e]).lower() for s, e in parts]
            sure = [w for w, at in zip(words, parts) if w in self.sure or at in given]
            shape = [text[s:e] for s, e in parts]
            follow = re.match(rf"\.? (?:{'|'.join(_STREET_EN)}|inn|choir|bus stop|house|cottage|hall)\b", text[end : end + 14], re.I)
            if follow or re.search(r"\d[a-z]?,? $", text[max(0, start - 6) : start]):
                continue
            if learn:
                if len(sure) == len(words) and shape[0][0].isupper():
                    yield start, end, "person_name"
                continue
            cased = all(s[0].isupper() for s in shape)
            if not sure and any(w in self.common for w in words) and not self._fits(text, start, end, strict=True):
                continue
            if len(parts) == 1 and not sure:
                sides = (text[max(0, start - 12) : start], text[end : end + 12])
                shouted = shape[0].isupper() and len(shape[0]) > 1 and any(re.search(r"[A-ZА-Я]", x) and not re.search(r"[a-zа-я]{2}", x) for x in sides)
                if not cased or shouted:
                    # written like the common word: only between words that stand around names
                    if not self._fits(text, start, end, strict=True):
                        continue
                initial = re.match(r" [A-ZÀ-Ý]\.(?!\w)", text[end:])
                if text[start] != text[parts[0][0]] or initial:
                    pass
                elif not self._fits(text, start, end):
                    continue
            elif not cased and not sure and len(parts) > 1 and not any(s[0].isupper() for s in shape):
                if not self._fits(text, start, end):
                    continue
            if (m := re.match(r" [A-ZÀ-Ý]\.(?![\w.])", text[end:])) and len(parts) == 1:
                end += m.end()
            yield start, end, "person_name"

    def _plainly(self, text: str, start: int, end: int) -> bool:
        """A common word, not written like a name within a sentence."""
        if _own(text[start:end]).lower() not in self.common:
            return False
        return not text[start].isupper() or text[start:end].isupper() or not _WITHIN.search(text, max(0, start - 3), start)

    def name_hits(self, text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in sorted(anchors, key=lambda x: (x[0], -x[1])):
            if (s and (text[s - 1].isalnum() or text[s - 1] in "-’'@_" and s > 1 and text[s - 2].isalnum())) or (e < len(text) and (text[e].isalnum() or text[e] in "-’'" and e + 1 < len(text) and text[e + 1].isalnum() and text[e : e + 2].lower() not in ("'s", "’s"))):
                continue
            if out and s < out[-1][1]:
                continue
            out.append((s, e))
        return out

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all mentions in order."""
        low = fold(text)
        anchors = anchors_of(low)
        names = self.known(low)
        found: list[tuple[int, int, str]] = []

        def add(spans: Iterator[tuple[int, int, str]]) -> None:
            for s, e, k in spans:
                if all(e <= a or s >= b for a, b, _ in found):
                    found.append((s, e, k))

        for s, e in anchors.get("at", ()):
            if low.startswith("mailto:", s):
                continue
            if got := self._email(text, s, e):
                add(iter([(*got, "email")]))
        add(self._numbers(text, low, [s for s, _ in anchors.get("id", ())], [s for s, _ in anchors.get("phone", ())]))
        if "street" in anchors:
            add(iter(sorted(self._addresses(text, anchors["street"]), key=lambda x: (x[0], -x[1]))))
        given = self._slot_hits(text, anchors)
        if names or given:
            known = [h for h in self.name_hits(text, names) if all(h[1] <= s or h[0] >= e for s, e in given) and not self._plainly(text, *h)]
            add(self._names(text, sorted({*known, *given}), given=given))
        return sorted(found)

    def context_counts(self, texts: Iterator[str | None]) -> Counter:
        n: Counter = Counter()
        for text in texts:
            if not text:
                continue
            low = fold(text)
            hits = [h for h in self.name_hits(text, self.known(low)) if not self._plainly(text, *h)]
            for s, e, _ in self._names(text, hits, learn=True):
                for key in self._context_keys(text, s, e):
                    n[_bucket(key)] += 1
        return n


def long_texts(parts: list[tuple[DataFrame, str, tuple[str, ...]]]) -> DataFrame:
    """``field, row_id, text`` of the given (table, id column, text columns); null texts are left out."""
    out = None
    for df, id_col, fields in parts:
        x = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
        one = df.select(F.col(id_col).cast("bigint").alias("row_id"), x.alias("x")).select("x.field", "row_id", "x.text").where("text is not null and text <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def _chunked(texts: DataFrame) -> DataFrame:
    """``field, row_id, text, chunk``, written down so that the chunks stay the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo = size = 0
            for i, n in enumerate(len(t) for t in pdf["text"]):
                size += n
                if size > CHUNK_CHARS or i - lo + 1 >= CHUNK or i == len(pdf) - 1:
                    yield pdf.iloc[lo : i + 1].assign(chunk=uuid.uuid4().hex)
                    lo, size = i + 1, 0

    return materialize(texts.select("field", "row_id", "text").mapInPandas(run, "field string, row_id bigint, text string, chunk string"), "texts")


def lexicon_of(texts: DataFrame, min_slots: int = 2) -> DataFrame:
    """``word, kind, plain``: every word of a naming slot; a sure, an unsure or a common one, and whether of plain use."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            n.update(count_words(pdf["text"]))
            if len(n) > 200_000:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["word", "use", "n"])
                n = Counter()
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["word", "use", "n"])

    counts = texts.select("text").mapInPandas(words, "word string, use string, n bigint").groupBy("word")
    table = counts.agg(*(F.sum(F.when(F.col("use") == u, F.col("n")).otherwise(0)).alias(u) for u in ("slot", "low", "cap", "mid")))
    slot, low, cap = F.col("slot"), F.col("low"), F.col("cap")
    # a word that a slot caught by chance is mostly used in lower case, or capitalized elsewhere
    plain = (low > 0.5 * cap) | (slot + F.col("mid") < 0.2 * cap)
    hardly = (slot < 0.002 * (low + cap)) | ((slot < min_slots) & plain)
    kind = F.when((slot >= min_slots) & (low <= 0.5 * slot) & (slot >= 0.04 * cap), "sure").when(hardly, "common").otherwise("unsure")
    seen = table.where((slot > 0) & (F.length("word") > 1) & ~F.col("word").isin(*sorted(_CUE_WORDS)) & ((slot >= min_slots) | ~F.col("word").isin(*sorted(_NO_NAME))))
    return materialize(seen.select("word", kind.alias("kind"), ((kind != "sure") & plain).alias("plain")), "lexicon")


def _words_in(text: str) -> set[str]:
    """All that a name of the lexicon can match in a text."""
    out = set(_TOKEN.findall(fold(text)))
    return out | {w[: m.start()] for w in out for m in re.finditer("['’]s", w)}


def _filter_of(lexicon: DataFrame) -> np.ndarray:
    """A bit for each hash of a lexicon word. To the driver: FILTER_BITS bits at most."""
    bit = F.pmod(F.crc32("word"), F.lit(FILTER_BITS)).cast("bigint") + 1  # buckets and bits are counted from 1
    got = lexicon.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS + (1 << 16), bool)
    for r in got:
        lo = (r["b"] - 1) * 32768
        out[lo : lo + 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[:32768]
    return np.packbits(out)


def look_up(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows of the lexicon for each chunk whose texts have the word. Words that a filter rules out are not shuffled."""
    shared = chunks.sparkSession.sparkContext.broadcast(_filter_of(lexicon))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = np.unpackbits(shared.value)
        for pdf in batches:
            for chunk, texts in pdf.groupby("chunk")["text"]:
                words: set[str] = set()
                for t in texts:
                    words |= _words_in(t)
                if kept := sorted(w for w in words if may[zlib.crc32(w.encode()) % FILTER_BITS]):
                    yield pd.DataFrame({"chunk": chunk, "word": kept})

    words = chunks.select("chunk", "text").mapInPandas(run, "chunk string, word string").distinct()
    return materialize(words.join(lexicon, "word").select("chunk", "word", "kind", "plain"), "names")


def _finder(names: pd.DataFrame, contexts: np.ndarray | None = None) -> Finder:
    of = {k: frozenset(names["word"][names["kind"] == k]) for k in ("sure", "unsure", "common")}
    return Finder(of["sure"], of["unsure"] | of["common"], contexts, of["common"], frozenset(names["word"][names["plain"].astype(bool)]))


def contexts_of(chunks: DataFrame, names: DataFrame) -> np.ndarray:
    """What stands around sure names again and again. To the driver: BUCKETS counts."""

    def run(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        n = _finder(own).context_counts(iter(texts["text"]))
        return pd.DataFrame({"bucket": list(n), "n": list(n.values())}).astype("int64")

    got = chunks.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    table_ = np.zeros(BUCKETS, np.int32)
    for r in got:
        table_[r["bucket"]] = r["n"]
    # what surrounds names again and again, not what stood there by chance
    table_[table_ < max(2, table_.sum() / 4 * CONTEXT_SHARE)] = 0  # a mention counts four contexts
    return table_


def fit(texts: DataFrame, min_slots: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Name lexicon and name contexts over all texts."""
    chunks = _chunked(texts)
    lexicon = lexicon_of(chunks, min_slots)
    return lexicon, contexts_of(chunks, look_up(chunks, lexicon))


def _each_chunk(texts: DataFrame, model: tuple | None, run: Callable[[Finder, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    chunks = _chunked(texts)
    names = look_up(chunks, model[0] if model else lexicon_of(chunks))
    shared = texts.sparkSession.sparkContext.broadcast(model[1] if model else contexts_of(chunks, names))
    return chunks.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInPandas(lambda pdf, own: run(_finder(own, shared.value), pdf), schema)


def find_pii(texts: DataFrame, model: tuple | None = None) -> DataFrame:
    """``field, row_id, kind, start_at, end_at`` of every mention."""

    def run(f: Finder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(a, i, k, s, e) for a, i, t in zip(pdf["field"], pdf["row_id"], pdf["text"]) for s, e, k in f.find(t)]
        return pd.DataFrame(rows, columns=["field", "row_id", "kind", "start_at", "end_at"])

    return _each_chunk(texts, model, run, "field string, row_id bigint, kind string, start_at int, end_at int")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], PLACEHOLDER[k]]
        at = e
    return "".join([*out, text[at:]])


def redact(texts: DataFrame, model: tuple | None = None) -> DataFrame:
    """``field, row_id, text, redacted, n_mentions``: mentions replaced by placeholders of their type."""

    def run(f: Finder, pdf: pd.DataFrame) -> pd.DataFrame:
        spans = [f.find(t) for t in pdf["text"]]
        pdf = pdf.assign(redacted=[redact_text(t, s) for t, s in zip(pdf["text"], spans)], n_mentions=[len(s) for s in spans])
        return pdf[["field", "row_id", "text", "redacted", "n_mentions"]]

    return _each_chunk(texts, model, run, "field string, row_id bigint, text string, redacted string, n_mentions int")
