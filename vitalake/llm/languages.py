"""Which of a few languages a short text is in, by script and frequent words."""

from __future__ import annotations

import re
from functools import lru_cache

#: The most frequent words of languages in Latin letters; fixed values.
WORDS = {
    "en": "the i am cannot of and to a in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now my made over did down only way find use may water long little very after words called just where most know get through back much before also around another came come work three word must because does part even place well such here take why help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next both few being nothing though since without against during within rather given".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle diesem seit muss wurden beim doch jetzt waren drei jahre mehrere ihr ihren ihrer weil ohne damit sehr oft hier da wegen kein keinen dies wenig viel weiter mein unser nichts etwa während jedoch sowie gehen".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ont aux d l cette mais comme ou si leur y dont on elle deux ses tout nous sa fait été aussi leurs bien peut ces entre même après sans encore était tous je très faire être avait où fut autres toute alors avant ainsi trois autre contre jours puis donc depuis faut ans quand selon chez fois moins peu lors car vers cela ceux toujours toutes rien vous lui celle ils cet étaient pendant déjà quelques non leurs notre votre aucun aucune n s qu j souvent possible".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi es son fue ha han era está están ser puede tiene hace dos cada así dado según aunque pues debe".split(),
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse dele isto são pode foram vir causa sobre após ainda cada".split(),
    "it": "di e il la che in un è per una sono non con del si da come le dei al nel della anche alla più ma gli lo ha se delle i o ai questo dal su ci sua suo l tra cui hanno era essere stato molto già dopo prima fatto due ancora così stata quando solo senza perché quale questa loro tutti ogni può nella sulla dalla fra degli nei sul chi mi ti vi ne io tu lui lei noi voi ad ed ed poi qui dove sempre poco nulla della dello negli suoi sue".split(),
    "pl": "w i z na do nie się jest że o to od a jak po za co ale przez dla są oraz tak przy może już czy tym tego jego lub był było jako który która które tylko ten ta te jej też być ze pod bez roku być nad przed ich kiedy mnie go bardzo więc można jednak będzie gdy mi jeszcze u we ma mają nic między tej tych temu gdzie wszystko sobie żeby często nowy ani niż oto".split(),
    "nl": "de het een van en in is dat op te zijn voor met die niet aan er om ook als bij door of uit maar naar heeft hij ze over deze werd worden nog wordt dan zou meer kan tot geen wel al was haar hun zich omdat tegen na onder veel zal moet mijn wij ik je dit hebben waren had".split(),
}
#: How many words a language has in its list: of a word that several have, each gets a share.
_OF: dict[str, tuple[str, ...]] = {}
for _k, _w in WORDS.items():
    for _x in dict.fromkeys(_w):
        _OF[_x] = (*_OF.get(_x, ()), _k)
#: Letters that only some of the languages use; fixed values.
LETTERS = {"de": "äöüß", "fr": "èêëàâçùœî", "es": "ñ¿¡", "pt": "ãõ", "pl": "ąćęłńśźż", "it": "ìò"}
_LETTER_OF: dict[str, tuple[str, ...]] = {}
for _k, _w in LETTERS.items():
    for _x in _w:
        _LETTER_OF[_x] = (*_LETTER_OF.get(_x, ()), _k)
#: Endings of longer words that are usual in one of the languages; fixed values.
ENDINGS = {
    "en": "ing ings ness ment ments ily ally ously ated", "de": "ung ungen lich liche lichen keit heit schaft isch ische ischen", "fr": "ement ements euse euses eaux aient ité ités ique iques",
    "es": "ción ciones dad dades miento mientos ando iendo", "pt": "ção ções dade dades mento mentos ância ência ões", "it": "zione zioni tà aggio ando endo ità ente enti ista",
    "pl": "anie enie ość ości uje ują ące ący ego owej owych ych ymi ami ach ków ek", "nl": "lijk lijke heid ingen atie eren",
}
_ENDS = [(k, tuple(v.split())) for k, v in ENDINGS.items()]
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_MARKED = re.compile("[" + "".join(_LETTER_OF) + "]")


def script(text: str) -> str | None:
    """``han``, ``cyrillic`` or ``latin``: the script of most letters; None without letters."""
    if text.isascii():
        return "latin" if _LATIN.search(text) else None
    han, cyr, lat = (len(r.findall(text)) for r in (_HAN, _CYRILLIC, _LATIN))
    if not han + cyr + lat:
        return None
    # One Han sign carries about as much as three letters.
    return max((3 * han, "han"), (cyr, "cyrillic"), (lat, "latin"))[1]


def scores(text: str) -> dict[str, float]:
    """Evidence for each language written in Latin letters."""
    out = dict.fromkeys(WORDS, 0.0)
    low = text.lower()
    for w in _WORD.findall(low):
        for k in _OF.get(w, ()):
            out[k] += 1.0
    if not low.isascii():
        for c in _MARKED.findall(low):
            for k in _LETTER_OF[c]:
                out[k] += 0.5
    return out


def language(text: str, least: float = 2.0, margin: float = 1.3) -> str | None:
    """The language of ``text``, or None where the evidence is slight."""
    return (_of_short if len(text) <= 400 else _language)(text, least, margin)


def _language(text: str, least: float, margin: float) -> str | None:
    kind = script(text)
    if kind == "han":
        return "zh"
    if kind == "cyrillic":
        return "ru"
    if kind is None:
        return None
    found = scores(text)
    best = _ahead(found, least, margin)
    if best is None:
        # Few frequent words: the endings of the others tell.
        for w in _WORD.findall(text.lower()):
            if len(w) > 5:
                for k, ends in _ENDS:
                    if w.endswith(ends):
                        found[k] += 0.75
        best = _ahead(found, least, margin)
    return best


@lru_cache(maxsize=8192)
def _of_short(text: str, least: float, margin: float) -> str | None:
    """``_language`` of a short text, as these come again and again."""
    return _language(text, least, margin)


def _ahead(found: dict[str, float], least: float, margin: float) -> str | None:
    ranked = sorted(((v, k) for k, v in found.items()), reverse=True)
    return ranked[0][1] if ranked[0][0] >= least and ranked[0][0] >= margin * ranked[1][0] else None
