"""Defects of answers to prompts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.languages import language, script

#: An answer is a copy if this share of its runs of words is.
COPIED = 0.7
DEFECTS = ["empty", "refusal", "copy", "other_language", "truncated"]

#: Labels of the three lines of an answer (prediction, probability, reasoning) by language; fixed values.
LABELS = {
    "en": ("prediction", "probability", "reasoning"),
    "de": ("vorhersage", "wahrscheinlichkeit", "begründung"),
    "fr": ("prédiction", "probabilité", "raisonnement"),
    "es": ("predicción", "probabilidad", "razonamiento"),
    "pt": ("previsão", "probabilidade", "justificativa"),
    "pl": ("prognoza", "prawdopodobieństwo", "uzasadnienie"),
    "ru": ("прогноз", "вероятность", "обоснование"),
    "zh": ("预测", "概率", "理由"),
}
#: Words for yes and no by language; fixed values.
ANSWERS = {
    "en": ("yes", "no"),
    "de": ("ja", "nein"),
    "fr": ("oui", "non"),
    "es": ("sí", "si", "no"),
    "pt": ("sim", "não", "nao"),
    "pl": ("tak", "nie"),
    "ru": ("да", "нет"),
    "zh": ("是", "否", "有", "无", "没有"),
}
#: Phrases that decline to answer; fixed values.
REFUSALS = [
    r"\bas an? (?:\w+ ){0,3}(?:language model|model|assistant|ai)\b",
    r"\b(?:i|we)(?: am|'m)? (?:really |very |truly )?(?:sorry|apologi[sz]e)\b.{0,60}\b(?:can't|cannot|can not|unable|not able|won't|decline|must|however|but)\b",
    r"\b(?:i|we) (?:can't|cannot|can not|won't|will not|must not|may not|do not|don't|couldn't|could not|shouldn't|should not) (?:feel comfortable|be able|in good conscience|give|provide|help|assist|answer|offer|make|comment|predict|share|respond|comply|do (?:that|this)|say|advise|judge|forecast|state|speculate|estimate|fulfil|complete|discuss|engage)\b",
    r"\bi(?: am|'m) (?:unable|not able|not in a position|not allowed|not permitted|not comfortable|not qualified|afraid)\b",
    r"\bi(?: must|'d| would| will| have to| need to)? (?:respectfully |politely )?(?:rather not|decline|prefer not|refuse|refrain)\b",
    r"\b(?:isn't|is not|not) possible for me\b",
    r"\b(?:would not|wouldn't) be (?:appropriate|right|responsible|safe|proper)\b",
    r"\b(?:guidelines|policy|policies|rules|instructions) (?:keep|prevent|prohibit|don't allow|do not allow|forbid|stop|bar)\b",
    r"\bfalls outside\b|\boutside (?:of )?(?:what i|my)\b",
    r"\b(?:that|this) is not something (?:i|we)\b",
    r"\bno (?:prediction|forecast|answer|estimate|diagnosis|advice|opinion|assessment|response) (?:can|could|will|may|shall|is) be\b|\bno (?:prediction|forecast|answer) (?:can|could|will|is)\b",
    r"^\W*(?:\w+ ?: ?)?(?:thank you[^.]{0,40}\. )?(?:sorry|unfortunately)\b",
    r"\bthis (?:assistant|model|system|tool|service|ai)\b|\bnot a (?:question|request|task) (?:i|this|that)\b",
    r"\b(?:predicting|forecasting|diagnosing|estimating|judging) (?:an?|any|the|someone's|somebody's|individual|patients?|people's|health|medical)\b",
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|werde|muss|bin)\b.{0,80}\b(?:nicht|keine?n?|ablehnen|verzichten|außerstande)\b",
    r"\b(?:dazu|hierzu|das) (?:darf|kann|möchte|muss) ich\b",
    r"\bes tut mir leid\b|\bentschuldigung\b|\bals (?:ki|sprachmodell|modell|assistent)\w*\b|\bnicht möglich, (?:hier|ihnen|eine)\b|\bleider\b",
    r"\bje (?:ne (?:peux|suis|saurais|souhaite|veux|dois)|refuse|dois (?:refuser|décliner)|préfère ne|regrette)\b|\bdésolée?\b|\ben tant que (?:modèle|ia|assistant)\b|\bil (?:ne m'est pas|m'est impossible)\b|\bmalheureusement\b",
    r"\b(?:no (?:puedo|debo|me es|estoy|es posible|voy a)|lo siento|lamentablemente|lamento|prefiero no|debo (?:rechazar|declinar)|me niego|tengo que (?:rechazar|declinar)|como (?:modelo|ia|asistente|inteligencia))\b",
    r"\b(?:não (?:posso|devo|consigo|me é|estou|é possível|vou)|infelizmente|lamento|desculpe|prefiro não|preciso recusar|devo recusar|tenho de recusar|sinto muito|como (?:modelo|ia|assistente|um modelo))\b",
    r"\b(?:nie (?:mogę|jestem w stanie|mam prawa|wolno mi)|przykro mi|przepraszam|niestety|muszę odmówić|jako model)\b",
    r"(?:к сожалению|извините|не могу|я не вправе|вынужден|как языковая модель|как модель)",
    r"(?:抱歉|对不起|无法|不能(?:提供|回答|给出|帮)|作为(?:一个)?(?:语言模型|人工智能|ai|模型))",
]
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS), re.I | re.S)
_LABEL_NAMES = sorted({x for v in LABELS.values() for x in v}, key=len, reverse=True)
_LABEL = re.compile(
    r"(?:^|\n)[^\w\n]*(" + "|".join(map(re.escape, _LABEL_NAMES)) + r")[^\w\n]*?[:：][ \t*_`]*", re.I
)
_LABEL_LANGUAGES: dict[str, list[tuple[str, int]]] = {}
for _k, _v in LABELS.items():
    for _i, _x in enumerate(_v):
        _LABEL_LANGUAGES.setdefault(_x, []).append((_k, _i))
_ANSWER_LANGUAGES: dict[str, set[str]] = {}
for _k, _w in ANSWERS.items():
    for _x in _w:
        _ANSWER_LANGUAGES.setdefault(_x, set()).add(_k)
_TAG = re.compile(r"</?[a-zA-Z][^>\n]{0,40}/?>|&nbsp;|&#?\w+;")
_ENDS = ".!?。！？…"
_CLOSERS = "\"'”’»)]}*_`~ \t\r\n​﻿"
#: Words that stand for nothing; fixed values.
NOTHING = {"null", "none", "nan", "n", "na", "nil", "undefined", "empty", "blank", "json", "text", "markdown", "plaintext", "br", "answer", "response", "output"}
_WORDS = re.compile(r"\w+")


#: Format and control signs but tab and line end.
_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if c not in (9, 10) and unicodedata.category(chr(c)) in ("Cf", "Cc")) + "]")


def _visible(text: str) -> str:
    """``text`` in one form of Unicode, without tags, format and control signs."""
    if text.isascii():
        text = text.replace("\r", "")
        return _TAG.sub(" ", text) if "<" in text or "&" in text else text
    text = unicodedata.normalize("NFC", text)
    return _HIDDEN.sub("", _TAG.sub(" ", text) if "<" in text or "&" in text else text)


def _plain(text: str) -> str:
    """Words of ``text`` alone, in lower case."""
    return " ".join(_WORDS.findall(text.lower()))


def _answer_word(text: str) -> str | None:
    """The word for yes or no that ``text`` begins with."""
    words = re.match(r"\W*([^\W\d_]+)", text)
    if words and words.group(1).lower() in _ANSWER_LANGUAGES:
        return words.group(1).lower()
    m = re.match(r"\W*(没有|[是否有无])", text)
    return m.group(1) if m else None


def parts(text: str) -> tuple[str, list[tuple[str, str]]]:
    """What stands before the first label, and (label, text after it) in order."""
    found = list(_LABEL.finditer(text))
    head = text[: found[0].start()] if found else text
    out = []
    for a, b in zip(found, [*found[1:], None], strict=False):
        out.append((a.group(1).lower(), text[a.end() : b.start() if b else len(text)].strip()))
    return head, out


_NAMED = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, _LABEL_NAMES)) + r")(?!\w)|预测|概率|理由")


def _question(prompt: str) -> str:
    """A prompt without the list of its record; the question tells the language best."""
    return "\n".join(x for x in prompt.split("\n") if not x.lstrip().startswith(("-", "*", "•")))


#: What recent questions, of 2,000 signs at most, ask for.
_SEEN: dict[str, tuple[str | None, tuple[str, ...]]] = {}


def _asked(question: str) -> tuple[str | None, tuple[str, ...]]:
    found = set(_NAMED.findall(question.lower()))
    named = {k: tuple(x for x in v if x in found) for k, v in LABELS.items()}
    best = max(named, key=lambda k: len(named[k]))
    labels = named[best] if len(named[best]) >= 2 else ()
    return (best if labels else language(question)), labels


def asked(prompt: str) -> tuple[str | None, tuple[str, ...]]:
    """Language of a prompt, and the labels of the lines that it asks for."""
    question = _question(prompt)
    if len(question) > 2000:
        got = _asked(question)
        return got[0] or language(prompt), got[1]
    got = _SEEN.get(question)
    if got is None:
        if len(_SEEN) >= 4096:
            _SEEN.clear()
        got = _SEEN[question] = _asked(question)
    return got[0] or language(prompt), got[1]


def _copied(words: list[str], plain_prompt: str) -> float:
    """The share of runs of three words that are in the prompt."""
    if len(words) < 3:
        return 0.0
    runs = [f" {a} {b} {c} " in plain_prompt for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    return sum(runs) / len(runs)


#: What providers give as the reason where an answer was held back, or was cut at a number of tokens; fixed values.
HELD_BACK = {"content_filter", "safety", "refusal", "blocked", "recitation", "prohibited_content"}
CUT_SHORT = {"length", "max_tokens", "max_length", "token_limit"}
#: To rule something out isn't to decline; fixed values.
_RULES_OUT = re.compile(r"exclu|rule out|descart|ausschlie|écart|esclud|wyklucz|исключ|排除", re.I)


def _declines(line: str, word: str) -> bool:
    """Whether the word for yes or no at the begin of ``line`` belongs to a phrase that declines, or is put before one by a comma."""
    if len(line) <= len(word) + (8 if line.isascii() else 2):
        return False
    low = line.lower()
    after = low.index(word) + len(word)
    found = _REFUSAL.search(low[after - len(word) : after + 160])
    if not found:
        return False
    between = low[after : after - len(word) + found.start()]
    if found.start() == 0:
        return found.end() > len(word)
    return between in (", ", ",", "，", "、") and not _RULES_OUT.search(low[after : after + 160])


def all_defects(prompt: str | None, text: str | None, reason: str | None = None) -> list[str]:
    """All defects of ``text`` as an answer to ``prompt``, in the order of ``DEFECTS``; each rule is judged by itself.

    ``reason`` is the provider's finish_reason, which may be wrong and is a hint only: an answer held back makes a
    phrase that declines count even beside a word for yes or no, and of one cut short a number or a
    single letter before a full stop is no end. Of a text without any word but marks, tags and words for nothing, only emptiness can be told.
    """
    if text is None:
        return ["empty"]
    seen = _visible(text)
    head, labelled = parts(seen)
    bodies = [b for _, b in labelled]
    body = " ".join([head, *bodies])
    words = _WORDS.findall(seen.lower())
    left = [w for w in (_WORDS.findall(body.lower()) if labelled else words) if w not in NOTHING]
    few = len(left) <= 3
    bare = [w for w in words if w in _LABEL_NAMES] if few else []
    if not left and not bare:
        return ["empty"]
    out = []
    if not left or (few and all(w in _LABEL_NAMES for w in left) and len(bare) >= len(left)):
        out.append("empty")
    hint = (reason or "").strip().lower()
    prompt = _visible(prompt or "")
    wanted, labels = asked(prompt)
    firsts = [b for x, b in labelled if any(i == 0 for _, i in _LABEL_LANGUAGES[x])]
    line = firsts[0] if firsts else ("" if labelled else seen)
    answer = _answer_word(line) if line else None
    body = body.replace("’", "'")
    if answer and ((hint in HELD_BACK and _REFUSAL.search(body)) or _declines(line.replace("’", "'"), answer)):
        answer = None
    if answer is None and not labels:
        lines = [_plain(x) for x in seen.split("\n") if len(x) < 40]
        answer = next((x for x in lines if x in _ANSWER_LANGUAGES), None)
    if answer is None and _REFUSAL.search(body):
        out.append("refusal")
    if answer is None and _copied(words, f" {_plain(prompt)} ") >= COPIED:
        out.append("copy")
    if _other_language(wanted, head, labelled, answer):
        out.append("other_language")
    if _truncated(seen, labels, labelled, answer, hint in CUT_SHORT):
        out.append("truncated")
    return out


def leading(found: list[str]) -> list[str]:
    """Of all defects those that count first: emptiness, a copy or a refusal alone, else all."""
    return next(([x] for x in ("empty", "copy", "refusal") if x in found), found)


def defects(prompt: str | None, text: str | None, reason: str | None = None) -> list[str]:
    """The ``leading`` defects of ``text`` as an answer to ``prompt``, in the order of ``DEFECTS``."""
    return leading(all_defects(prompt, text, reason))


def _other_language(wanted: str | None, head: str, labelled: list[tuple[str, str]], answer: str | None) -> bool:
    """Whether the answer, or all its reasoning, is in another language than ``wanted``."""
    if wanted is None:
        return False
    reasons = " ".join(b for x, b in labelled if any(i == 2 for _, i in _LABEL_LANGUAGES[x]))
    body = reasons or (head if not labelled else "")
    found = language(body) if len(_WORDS.findall(body)) >= 3 or script(body) in ("han", "cyrillic") else None
    if found:
        return found != wanted
    names = [{k for k, _ in _LABEL_LANGUAGES[x]} for x, _ in labelled]
    if names and all(wanted not in n for n in names):
        return True
    if not labelled and answer:
        return wanted not in _ANSWER_LANGUAGES[answer]
    return False


_NO_END = re.compile(r"(?:\d|\b[^\W\d_])\.$")


def _truncated(seen: str, labels: tuple[str, ...], labelled: list[tuple[str, str]], answer: str | None, cut: bool = False) -> bool:
    """Whether an answer stops before its end or before a line that was asked for."""
    there = {i for x, b in labelled for _, i in _LABEL_LANGUAGES[x] if _WORDS.search(b)}
    if labels:
        if len(labels) == 3 and there != {0, 1, 2}:
            return True
        end = labelled[-1][1] if labelled else seen
    else:
        end = seen
    end = end.rstrip(_CLOSERS)
    if cut and not answer and _NO_END.search(end):
        return True
    if seen.count("```") % 2 or seen.count("**") % 2:
        return True
    if seen.count("(") > seen.count(")"):
        return True
    if len(_WORDS.findall(end)) <= 2 and not labels:
        return answer is None and bool(end) and end[-1] not in _ENDS
    return bool(end) and end[-1] not in _ENDS


def flag_responses(
    df: DataFrame, key: str = "response_id", prompt: str = "prompt", text: str = "text", reason: str | None = "finish_reason"
) -> DataFrame:
    """Each defective answer with all its defects: ``key``, ``defects`` (array), ``defect`` (the leading one).

    Rules over the whole text, each judged by itself: ``empty`` (null, blank, or only labels, marks, tags,
    layout), ``refusal`` (a phrase that declines, in eight languages, and no answer), ``copy`` (most
    of it are lines of the prompt, and no answer), ``other_language`` (script, labels, answer
    word or reasoning of another language than the prompt) and ``truncated`` (an unclosed
    delimiter, an abrupt end, or a line missing that the prompt asks for).
    ``defect`` is emptiness, a copy or a refusal if found, else the first of the rest.
    ``reason`` names the column of the provider's reason to finish, a hint that decides nothing by itself; a table without that column has none.

    A null or empty prompt asks for nothing, so only emptiness, refusal and abrupt ends are
    found; rows with a null key are kept; repeated rows are judged one by one; an empty table
    gives an empty one; further columns aren't looked at. Work is row by row in Arrow batches, without a
    shuffle; prompts of blank answers aren't sent along.
    """
    kind = df.schema[key].dataType.simpleString()
    why = df[reason].cast("string") if reason and reason in df.columns else F.lit(None).cast("string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b["p"].to_pylist(), b["t"].to_pylist(), b["r"].to_pylist())
            found = [all_defects(p, t, r) for p, t, r in zip(*columns, strict=True)]
            hit = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays(
                [
                    b["k"].take(pa.array(hit, pa.int64())),
                    pa.array([found[i] for i in hit], pa.list_(pa.string())),
                    pa.array([leading(found[i])[0] for i in hit], pa.string()),
                ],
                names=[key, "defects", "defect"],
            )

    # A blank answer needs no prompt in Python.
    blank = F.coalesce(df[text].rlike(r"^\s*$"), F.lit(True))
    asked_for = F.when(~blank, df[prompt])
    return df.select(df[key].alias("k"), asked_for.alias("p"), df[text].alias("t"), why.alias("r")).mapInArrow(
        judge, f"`{key}` {kind}, defects array<string>, defect string"
    )
