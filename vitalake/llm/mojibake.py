"""Text that was decoded with a wrong character encoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vitalake.llm.languages import language

#: Encodings that UTF-8 is mistaken for. In those of one byte for which texts hold plenty
#: of letters from 0x80 to 0xbf (cp866, iso8859_5), correct words look like sequences.
LEGACY = ["cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r"]
#: Single-byte encodings taken for another: (taken for, really).
LATIN_PAIRS = [("cp1252", "iso8859_2"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"), ("cp1250", "cp1252")]
CYRILLIC_PAIRS = [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp866"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5")]

#: Runs of well-formed UTF-8 sequences of two to four bytes, a byte a sign.
_SEQUENCE = (
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_SPAN = re.compile(f"(?:{_SEQUENCE})+")
#: Signs that a single sequence may stand for: Latin and Greek letters, and usual marks and symbols.
_ALONE = re.compile(
    "[\x80-\u017f\u0192\u02c6\u02dc\u0300-\u0303\u0308\u030a\u030c\u0327\u0328\u0391-\u03c9\u1e00-\u1eff"
    "\u2010-\u2027\u2030-\u203a\u20ac\u2070-\u208e\u2116\u2122\u2126\u2150-\u215f\u2190-\u22ff\u2460-\u24ff\u2500-\u27bf"
    "\u3000-\u303f\ufe0f\ufeff\uff00-\uffef\ufffd\U0001f300-\U0001faff]+"
)
#: First words of the names of letters that are written together as one script; fixed values.
_TOGETHER = dict.fromkeys(["HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "BOPOMOFO", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH"], "CJK")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """The script of a letter, COMMON for other signs, and '' for what no text holds."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs") or (kind == "Cc" and not "\x80" <= c <= "\x9f"):
        return ""
    if kind[0] not in "LM":
        return "COMMON"
    name = unicodedata.name(c, "COMMON").split(" ")[0]
    return "COMMON" if name in ("COMBINING", "MODIFIER", "MICRO", "FEMININE", "MASCULINE", "VARIATION") else _TOGETHER.get(name, name)


_C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: Frequency of the Russian letters, in thousandths; fixed values.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 43, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1], strict=True))
_RU_LOG = {k: math.log(v / 1000) for k, v in RUSSIAN.items()}


def _bytes_of(codec: str) -> dict[int, int]:
    """Sign to byte of a legacy encoding; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)  # control signs, as Latin-1 has them in these places
    return table


class _Codec:
    def __init__(self, name: str) -> None:
        self.name = name
        table = _bytes_of(name)
        self.table = {s: chr(b) for s, b in table.items()}
        # Signs above 0x7f that the encoding doesn't have must not look like bytes.
        self.table |= {c: "\uffff" for c in range(0x80, 0x100) if c not in table}

        def signs(low: int, high: int) -> str:
            return "[" + "".join(re.escape(chr(s)) for s, b in table.items() if low <= b <= high) + "]"

        self.pair = re.compile(signs(0xC2, 0xF4) + signs(0x80, 0xBF))
        # Where letters are lead bytes, a sequence of correct letters and usual signs is no evidence.
        self.needs = re.compile(_UNUSUAL[name]) if name in _UNUSUAL else None


#: Signs that correct Russian text of these encodings doesn't hold; fixed values.
_UNUSUAL = {"koi8_r": "[─-▟■∙√≈]", "cp1251": "[ЂЃѓ‚†‡€‰Љ‹ЊЌЋЏђ™љ›њќћџЎўЈ¤Ґ¦ЄЇІіґ¶єјЅѕї¬]"}
_CODECS = [_Codec(x) for x in LEGACY]


#: Signs that close a quotation or a word in correct text, and so may follow its last letter; fixed values.
_CLOSING = set("”“’‘»›™®°º…–—·\xa0")


def _runs(codec: _Codec, text: str, as_bytes: str) -> list[tuple[int, int, str]]:
    """(begin, end, decoded) of the maximal runs of sequences that stand for signs of any text."""
    out = []
    for m in _SPAN.finditer(as_bytes):
        a, b = m.span()
        if codec.name == "koi8_r" and not codec.needs.search(text[a:b]):
            continue
        decoded = m.group().encode("latin-1").decode("utf-8")
        if all(map(_script, decoded)):
            out.append((a, b, decoded))
            continue
        at, begin, run = a, a, ""
        for c in decoded:
            n = len(c.encode("utf-8"))
            if _script(c):
                run += c
            else:
                if run:
                    out.append((begin, at, run))
                begin, run = at + n, ""
            at += n
        if run:
            out.append((begin, at, run))
    return out


_CYRILLIC_LETTER = re.compile("[\u0400-\u052f]")


def _plausible(codec: _Codec, text: str, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs that are text decoded wrongly.

    A script is proven where a run has two letters of it or more; single letters of scripts but Latin and Greek count only
    then. What correct text may hold by chance (a last letter with a closing sign, letters and signs of
    a Cyrillic encoding) counts only beside other evidence.
    """
    proven: set[str] = set()
    for _, _, got in runs:
        if len(got) > 1:
            scripts = [_script(c) for c in got]
            letters = [x for x in scripts if x != "COMMON"]
            proven |= {x for x in set(letters) - proven if letters.count(x) >= 2 and 2 * letters.count(x) > len(letters)}
    known = proven | {"COMMON"}
    runs = [r for r in runs if _ALONE.fullmatch(r[2]) or (any(_script(c) in proven for c in r[2]) and all(_ALONE.match(c) or _script(c) in known for c in r[2]))]
    cyrillic = codec.name == "cp1251" and len(_CYRILLIC_LETTER.findall(text)) > sum(len(_CYRILLIC_LETTER.findall(text[a:b])) for a, b, _ in runs)
    sure, unsure = [], []
    for run in runs:
        a, b, got = run
        before, after = text[a - 1 : a], text[b : b + 1]
        if cyrillic:
            alone = not (_CYRILLIC_LETTER.match(before) or _CYRILLIC_LETTER.match(after))
            if len(got) >= 3 or (codec.needs.search(text[a:b]) and (len(got) > 1 or alone)):
                sure.append(run)
            elif alone:
                unsure.append(run)
        elif len(got) == 1 and text[b - 1] in _CLOSING and "A" <= before <= "Z" and not after.isalpha():
            unsure.append(run)
        else:
            sure.append(run)
    return sorted(sure + unsure) if sure else []


def _unwrap(text: str) -> tuple[str, str | None]:
    """``text`` with the spans of the encoding that explains most of it decoded."""
    best: tuple[int, str, str] | None = None
    for codec in _CODECS:
        if not codec.pair.search(text):
            continue
        out, at, covered = [], 0, 0
        for a, b, got in _plausible(codec, text, _runs(codec, text, text.translate(codec.table))):
            out += [text[at:a], got]
            at = b
            covered += b - a - 2 * len(_C1.findall(got))
        if at and (best is None or covered > best[0]):
            best = (covered, "".join([*out, text[at:]]), codec.name)
    return (best[1], best[2]) if best else (text, None)


_SHARP_S = re.compile("(?<=[a-zà-ÿ])ß(?=[a-zà-ÿ])")
_L = "A-Za-zÀ-ÖØ-öø-ſ"
#: Signs that don't stand between two Latin letters, letters of other scripts among Latin
#: ones, accented capitals among small letters, and lone signs of boxes.
# All begin with a sign beyond ASCII, which is looked for first.
_ODD = re.compile(
    r"(?=[^\x00-\x7f])(?:"
    f"(?<=[{_L}])(?:[„·‡‚‰¸ˆ˜◊˙‹›∂√∑∏≈∆˚¨¯¬¦¤¢§¶¿¡†”“«»€£¥©®™⌠⌡≤≥±²³¹÷°∙■ⁿ]|[─-▟]|[Α-ωЀ-џ])+(?=[{_L}])"
    "|(?<=[a-zà-öø-ÿ])[À-ÖØ-Þ](?=[a-zà-öø-ÿ])"
    "|(?<![─-▟])[═-▟](?![─-▟])"
    r"|(?<!\w)ì[^\s]*[^\W\d_]î(?!\w)"
    r"|(?<=\d )∞C\b|(?<=[A-Z])…(?=[A-Z])"
    # Signs of cp1252 as mac_roman, cp437 or cp850 has them: quotes, dashes, apostrophes, a half, times, euro.
    "|(?<=[A-Z])[À-ÖØ-Þ](?=[a-z])|(?<=[a-z])[ΓΣΘΩΦδφεπστ]"
    r"|(?<=\d )◊(?= \d)|(?<=[A-Za-z] )Ω(?= [A-Za-z])|(?<=\d )[ÇÄ](?= )|(?<= )[ûùñ](?= )"
    r"|(?<=\d)[îö](?=\s)|(?<!\w)ô[^\s]*[^\W\d_]ö(?!\w)"
    r"|(?<=n)ít\b|(?<=o)íd\b|(?<=[a-z])í(?:ll|re|ve)\b"
    ")"
)
_LATIN_WORD = re.compile(rf"[\W\d_]*[{_L}µªº]+(?:[\W\d_]+[{_L}µªº]+)*[\W\d_]*|[\W\d_]*[µ°×½¼¾±–—…•”“’‘€™®©]\w*[\W\d_]*")
_TOKEN = re.compile(r"[^\s]+")
#: Signs that don't stand between letters once a word is restored, a capital within a name, and Greek letters.
_MISPLACED = re.compile(f"(?<=[{_L}])[‘“”…](?=[{_L}])")
_NAME = re.compile(r"(?:^|\W)[A-Z][a-z]{1,3}[À-ÖØ-Þ][a-z]+\W*$")
_GREEK = re.compile("[Α-ω]")
_LETTERS_RUN = re.compile(f"[{_L}]+")
#: Signs that a single-byte reading may well give, and signs that may be right as they are.
_USUAL = set("µ°×½¼¾±–—…•”“’‘€™®©ªº«»¿¡ \xa0")
_RIGHT = set("≥≤→←✓☐≠≈…–—“”‘’€°±µ½×²³")


def _latin(text: str) -> tuple[str, tuple[str, str] | None]:
    """Latin text of one single-byte encoding that was taken for another, read anew."""
    marked = _SHARP_S.search(text) and language(text, least=6.0) in ("en", "fr", "es", "pt", "pl")
    if not marked and not _ODD.search(text):
        return text, None
    # Signs whose neighbours tell are judged with them, the rest within its word.
    odd = [w for w in _TOKEN.findall(text) if _ODD.search(w) or (marked and _SHARP_S.search(w))]
    odd = odd or [m.group() for m in _ODD.finditer(text)]
    if len(odd) < 3 and all(map(_NAME.search, odd)):
        return text, None
    polish = language(text) == "pl"
    best, score = None, 0.0
    for pair in LATIN_PAIRS:
        good = 0.0
        for w in odd:
            new = _swap(w, *pair)
            if new != w and not _ODD.search(new) and not _MISPLACED.search(new) and (_LATIN_WORD.fullmatch(new) or set(new) <= _USUAL):
                if len(odd) == 1 and _GREEK.search(w) and 0 < max(map(len, _LETTERS_RUN.findall(new)), default=0) < 3:
                    continue
                changed = [c for a, c in zip(w, new, strict=False) if a != c]
                good += sum(c.lower() in _LETTERS[polish] or c in _USUAL for c in changed) / len(changed)
        if good > score and good >= (0.5 if len(odd) > 2 else 0.75) * len(odd):
            best, score = pair, good
    if best is None:
        return text, None

    def fix(m: re.Match) -> str:
        w = m.group()
        new = _swap(w, *best)
        same = [a for a, c in zip(w, new, strict=False) if a != c]
        if not same or (not any(map(str.isalpha, w)) and set(same) <= _RIGHT):
            return w
        return new if all(c.isalpha() or c in _USUAL or ord(c) < 128 for c in new) else w

    def wrong(line: str) -> bool:
        return bool(_ODD.search(line) or (marked and _SHARP_S.search(line)))

    return "\n".join(_TOKEN.sub(fix, x) if wrong(x) else x for x in text.split("\n")), best


#: Letters with marks of the languages of Western Europe, and of Polish; fixed values.
_LETTERS = {False: set("àáâãäåæçèéêëìíîïñòóôõöùúûüßœ"), True: set("ąćęłńóśźż")}
_FOREIGN = re.compile(r"[\x80-\u25ff]{4}")
_SENTENCE = re.compile(r"[^\n.!?]+[.!?]*")
#: Mean log frequency of letters from which a text passes for Russian, and by which it must gain.
RUSSIAN_ENOUGH, RUSSIAN_GAIN, RUSSIAN_LETTERS = -3.45, 0.45, 6


def _cyrillic(text: str) -> tuple[str, tuple[str, str] | None]:
    """Russian text of one single-byte encoding that was taken for another, read anew."""
    if not _FOREIGN.search(text):
        return text, None
    used: tuple[str, str] | None = None

    def fix(m: re.Match) -> str:
        nonlocal used
        s = m.group()
        letters = [c for c in s if c > "\x7f"]
        if len(letters) < RUSSIAN_LETTERS or len(letters) < 2 * sum(c.isascii() and c.isalpha() for c in s):
            return s
        now = russian_likeness(s)
        if now > RUSSIAN_ENOUGH:
            return s
        best, top = None, max(now + (RUSSIAN_GAIN if len(letters) > 7 else 1.5), RUSSIAN_ENOUGH)
        for pair in CYRILLIC_PAIRS:
            new = _swap(s, *pair)
            kept = sum(c.isalpha() for c in new) >= 0.9 * len(letters)
            if new != s and kept and (like := russian_likeness(new)) > top:
                best, top, used = new, like, pair
        return best or s

    return _SENTENCE.sub(fix, text), used


def russian_likeness(text: str) -> float:
    """Mean log frequency of the letters as Russian ones, with a penalty for case that jumps inside words."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return -9.0
    own = sum(_RU_LOG.get(c.lower(), -9.0) for c in letters) / len(letters)
    jumps = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
    return own - 2.0 * jumps / len(letters)


def _swaps(taken: str, really: str) -> dict[int, str]:
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(taken))] = bytes([b]).decode(really)
        except UnicodeDecodeError:
            continue
    return table


_SWAPS = {pair: _swaps(*pair) for pair in {*LATIN_PAIRS, *CYRILLIC_PAIRS}}


def _swap(text: str, taken: str, really: str) -> str:
    """``text`` read as ``really`` where it was taken for another single-byte encoding."""
    return text.translate(_SWAPS[taken, really])


def restore(text: str | None) -> tuple[str | None, list[str]]:
    """``text`` as far as it can be restored, and what was wrong with it (nothing: an empty list).

    Ways are the encodings taken for UTF-8 in order, ``a<b`` for an encoding b taken for a, ``lost``
    for signs that a decoder replaced and ``control`` for control signs left over.
    """
    if text is None or text.isascii():
        return text, []
    ways: list[str] = []
    text, pair = _cyrillic(text)
    if pair:
        ways.append("<".join(pair))
    while True:  # each pass shortens the text
        text, codec = _unwrap(text)
        if codec is None:
            break
        ways.append(codec)
    text, pair = _latin(text)
    if pair:
        ways.append("<".join(pair))
    if "\ufffd" in text:
        ways.append("lost")
    if _C1.search(text):
        ways.append("control")
    return text, ways


def restore_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text of which a part was decoded wrongly: ``key``, ``restored``, ``ways`` (array), ``whole``.

    Signs are mapped back to the bytes of a legacy encoding; the maximal spans of these
    that are well-formed UTF-8 sequences of likely signs are decoded, and nothing else,
    until none is left. Single-byte encodings taken for one another are found by signs between
    Latin letters, and by the frequency of letters in Russian. ``whole`` is false where
    signs are lost for good.

    Null, empty and correct texts give no row; rows with a null key are kept; repeated
    rows are looked at one by one; whole texts are read; an empty table gives an empty
    one; further columns aren't looked at. Work is row by row, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [restore(t) for t in b["t"].to_pylist()]
            hit = [i for i, (_, w) in enumerate(got) if w]
            yield pa.RecordBatch.from_arrays(
                [
                    b["k"].take(pa.array(hit, pa.int64())),
                    pa.array([got[i][0] for i in hit], pa.string()),
                    pa.array([got[i][1] for i in hit], pa.list_(pa.string())),
                    pa.array([not {"lost", "control"} & set(got[i][1]) for i in hit], pa.bool_()),
                ],
                names=[key, "restored", "ways", "whole"],
            )

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(
        run, f"`{key}` {kind}, restored string, ways array<string>, whole boolean"
    )
