"""Language and refusal dictionaries.

The language dictionary starts from function words (fixed values) and is completed by the corpus: texts
that the seeds settle clearly lend their words to their language, in a table of ``BUCKETS`` hashed words,
so its size does not depend on the data.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "es", "fr", "de", "pt", "it", "nl", "ru")
BUCKETS = 1 << 15

#: Function words. Fixed values.
SEEDS = {
    "en": "the and of to is was that with for my his her they their not but have has had this from by at an be are which when who will would i",
    "es": "el los las y que con por para una su mi pero como muy está del al lo se la en un más nada cuando desde",
    "fr": "le les et des une est pour dans avec mon ma sur pas que qui du au je il elle nous s'est j'ai d'un l'on ce cette après",
    "de": "der die das und ich nicht mit ein eine ist den dem zu auf für von im sich war es wir wird hat mein meine bei nach sie",
    "pt": "o os e um uma que com para por não meu minha da do das dos em no na se mais ao eu foi está já depois nos",
    "it": "il gli e che di un una per con non mio mia della del nel sono si ha è i da al le lo più anche dopo",
    "nl": "de het een en ik van met niet op is voor dat mijn was te bij aan zijn door naar ook die ze er uit heeft om",
    "ru": "и в не на что с по как это но из за от мы было был была у к о для всё автор меня",
}
_SEED_OF: dict[str, list[int]] = {}
for _k, _v in SEEDS.items():
    for _w in _v.split():
        _SEED_OF.setdefault(_w, []).append(LANGS.index(_k))

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.replace("’", "'").lower())


def seed_language(ws: list[str]) -> int:
    """The language the seeds settle clearly, or -1."""
    score = [0.0] * len(LANGS)
    for w in ws:
        if (of := _SEED_OF.get(w)) is not None:
            for k in of:
                score[k] += 1.0 / len(of)
    best, second = sorted(score, reverse=True)[:2]
    return score.index(best) if best >= 3 and best >= 1.8 * second else -1


@functools.lru_cache(maxsize=1 << 17)
def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def fit_language(texts: DataFrame) -> np.ndarray:
    """Word counts (BUCKETS x languages) over all texts of a one-column frame ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((BUCKETS, len(LANGS)), np.int64)
        for pdf in batches:
            hits: list[list[int]] = [[] for _ in LANGS]
            for t in pdf["text"]:
                ws = words(t) if t else []
                k = seed_language(ws)
                if k >= 0:
                    hits[k] += map(bucket, ws)
            for k, h in enumerate(hits):
                n[:, k] += np.bincount(np.array(h, np.int64), minlength=BUCKETS)
        at = np.nonzero(n.any(1))[0]
        yield pd.DataFrame({"bucket": at, **{k: n[at, i] for i, k in enumerate(LANGS)}})

    schema = "bucket int, " + ", ".join(f"{k} bigint" for k in LANGS)
    got = texts.mapInPandas(run, schema).groupBy("bucket").agg(*(F.sum(k).alias(k) for k in LANGS)).toPandas()
    table = np.zeros((BUCKETS, len(LANGS)), np.float64)
    table[got["bucket"].to_numpy(int)] = got[list(LANGS)].to_numpy(float)
    return table


class Languages:
    """Log-likelihood ratios of words by language; unknown words say nothing."""

    def __init__(self, table: np.ndarray) -> None:
        total = table.sum(0)
        p = (table + 0.05) / (total + 0.05 * BUCKETS)
        mean = p.mean(1, keepdims=True)
        self.score = np.log(p / mean)
        self.score[table.sum(1) < 2] = 0.0
        # a language that hardly occurs in the corpus has no counts to judge by
        self.score[:, total < 200] = np.minimum(self.score[:, total < 200], 0.0)
        for w, of in _SEED_OF.items():
            self.score[bucket(w), of] += 0.5

    def of(self, text: str) -> tuple[int, float, int]:
        """(language, gap to the second, number of words)."""
        ws = words(text)
        s = self.score.take([bucket(w) for w in ws], axis=0).sum(0) if ws else np.zeros(len(LANGS))
        second, best = np.partition(s, -2)[-2:]
        return int(s.argmax()), float(best - second), len(ws)


#: Refusals: first-person inability or refusal, and what is refused. Fixed values, by language.
REFUSAL_CUES = {
    "en": (
        r"\b(?:i|we)(?:'m| am| are|'re)? (?:really |very |so )?(?:sorry|afraid|unable|not able|not in a position|not comfortable)\b",
        r"\b(?:i|we) (?:really |simply )?(?:cannot|can't|can not|won't|will not|could not|am not able|don't feel comfortable|do not feel comfortable|prefer not|would prefer not|would rather not|refuse)\b",
        r"\bi'd (?:rather|prefer) not\b",
        r"\bi (?:must|have to|need to|will) (?:respectfully |politely )?(?:decline|pass on|refuse)\b",
        r"\bas an? (?:ai|large language|language|artificial)\b",
        r"\bgoes against my\b",
        r"\bnot (?:be )?(?:appropriate|possible|right) for me\b",
        r"(?:^|[.!?] )sorry\b.{0,60}\b(?:private|decline|can't|cannot|won't)\b",
    ),
    "es": (r"\blo siento\b", r"\bno (?:puedo|me es posible|podré)\b", r"\bprefiero no\b", r"\bcomo (?:un )?modelo\b", r"\blamento\b", r"\bdisculp"),
    "fr": (r"\bdésolée?\b", r"\bje (?:ne peux|ne suis pas en mesure|ne souhaite|préfère ne|refuse|regrette)", r"\bil m'est impossible\b", r"\ben tant que modèle\b"),
    "de": (r"\bes tut mir leid\b", r"\btut mir leid\b", r"\bich (?:kann|möchte|werde|darf)\b.{0,60}\bnicht\b", r"\bleider\b.{0,40}\bnicht\b", r"\bals (?:ki|sprachmodell)\b"),
    "pt": (r"\bdesculpe\b", r"\bnão (?:posso|consigo|me é possível|poderei)\b", r"\bprefiro não\b", r"\blamento\b", r"\bcomo (?:um )?modelo\b", r"\bsinto muito\b"),
    "it": (r"\bmi dispiace\b", r"\bnon (?:posso|riesco|mi è possibile|sono in grado)\b", r"\bpreferisco non\b", r"\bcome modello\b", r"\bspiacente\b"),
    "nl": (r"\bhet spijt me\b", r"\bik (?:kan|wil|mag|zal)\b.{0,60}\bniet\b", r"\bhelaas\b.{0,40}\bniet\b", r"\bals taalmodel\b", r"(?:^|[.!?] )sorry, (?:maar|ik)\b"),
    "ru": (r"\bизвините\b", r"\bпростите\b", r"\bне (?:могу|смогу|буду)\b", r"\bк сожалению\b", r"\bкак языковая\b"),
}
REFUSED = {
    "en": r"\b(?:help|assist|provid|summar|condens|describ|writ(?:e|ing) (?:up|this|such|about)|paraphras|comment|assess|process|content|text|post|request|task|entries|guidelines|decline|private|sensitive|such|this)\w*",
    "es": r"\b(?:ayud|resum|contenido|texto|publicaci|tarea|solicitud|describ|coment)\w*",
    "fr": r"\b(?:aid|résum|contenu|texte|publication|tâche|demande|trait|décri|comment)\w*",
    "de": r"\b(?:helfen|zusammenfass|inhalt|text|beitrag|aufgabe|anfrage|beschreib|komment|behilflich)\w*",
    "pt": r"\b(?:ajud|resum|conteúdo|texto|publicaç|tarefa|pedido|descrev|coment)\w*",
    "it": r"\b(?:aiut|riassum|contenut|testo|post|compito|richiest|descriv|comment)\w*",
    "nl": r"\b(?:help|samenvat|inhoud|tekst|bericht|taak|verzoek|beschrijv|hier|assist)\w*",
    "ru": r"\b(?:помо|излож|содержан|текст|пост|задач|запрос|опис|коммент|составить)\w*",
}
_CUES = {k: re.compile("|".join(v)) for k, v in REFUSAL_CUES.items()}
_OBJECTS = {k: re.compile(v) for k, v in REFUSED.items()}
#: A piece of every cue above, by language: only languages with a hint in the text are looked at closely. Fixed values.
HINTS = {
    "en": "sorry|afraid|unable|not able|not in a pos|comfortable|can't|cannot|can not|won't|will not|could not|don't feel|do not feel|refus|rather|prefer|declin|pass on|as an ai|as a language|as an artificial|as a large|as an language|goes against|for me",
    "es": "lo siento|no puedo|no me es|no podr|prefiero|como modelo|como un modelo|lament|disculp",
    "fr": "désol|je ne|je pr|je re|il m'est|en tant",
    "de": "leid|ich |leider|als ki|als sprach",
    "pt": "descul|não |prefiro|lamento|como modelo|como um modelo|sinto",
    "it": "dispiace|non |preferisco|come modello|spiacente",
    "nl": "spijt|ik |helaas|als taal|sorry, ",
    "ru": "извин|прост|не могу|не смогу|не буду|сожал|как языков",
}


def _hint_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k, v in HINTS.items():
        for h in v.split("|"):
            auto.add_word(h, (*auto.get(h, ()), k))
    auto.make_automaton()
    return auto


_AUTO = _hint_automaton()
_MARKS = re.compile("[\"“«„]")
_QUOTED = re.compile(r"\"[^\"]{2,300}\"|“[^”]{2,300}”|«[^»]{2,300}»|„[^“]{2,300}“")


def unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if _MARKS.search(text) else text


def is_refusal(text: str) -> bool:
    """A sentence outside quotes declines the task, in any of the languages."""
    t = text.replace("’", "'").lower()
    hinted = {k for _, ks in _AUTO.iter(t) for k in ks}
    if not hinted:
        return False
    t = unquoted(t)
    for k in hinted:
        for m in _CUES[k].finditer(t):
            around = t[max(0, m.start() - 60) : m.end() + 120]
            rest = around.replace(m.group(), " ", 1) if k != "en" else around
            if _OBJECTS[k].search(rest):
                return True
    return False
