"""Language of words and spans: scores per word, best segmentation by dynamic programming."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

LANGS = ("en", "de", "fr", "es", "pt", "pl", "ru", "zh", "ja")

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been being it its this that these those for with not no on by from as at has have had do does did done "
    "can could must may might will would should shall we you they he she i our your their his her my me us them when if then than so because since while until before after once unless "
    "there here who which what where how why each every only all some any none other another more most many few such same into out over under between through about against during "
    "but yet nor also still even just again always never already usually often sometimes first last next please keep use used skip call read write without within whether both either neither",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen ist sind war waren wird werden wurde wurden sein hat haben hatte wir ihr sie er es ich du "
    "man sich mit von zu zum zur im in an am auf aus bei nach vor für über unter durch gegen ohne um bis als wie wenn weil denn dass damit sonst danach dann erst schon noch nur auch hier dort "
    "jeder jede jedes jeden dieser diese dieses diesen darf muss kann soll bitte einmal höchstens warum was wer wo sobald bleibt lässt jetzt immer",
    "fr": "le la les un une des du de et ou mais ne pas plus est sont était être été a ont avait il elle on nous vous ils elles je tu se ce cet cette ces son sa ses leur leurs notre nos que qui quoi dont où "
    "dans par pour avec sans sur sous avant après entre vers chez au aux en si car parce lorsque quand afin donc ainsi alors aussi bien encore déjà ici là chaque tout tous toute toutes doit peut fois "
    "seule seul pourquoi comment impossible même très rien",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ser sido está están estaba ha han había hemos se lo le les me te nos que quien cual cuando donde como porque pues ya si sin con por para "
    "en a al ante sobre entre hasta desde hacia tras según este esta estos estas ese esa eso esto su sus mi tu cada todo todos toda todas solo sólo puede pueden debe hay más muy también luego aquí queda antes después vez qué por",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são era foi ser sido está estão estava tem têm havia se lhe nos que quem qual quando onde como porque pois já sem com por para pelo pela "
    "em no na nos nas ao à aos às ante sobre entre até desde este esta estes estas esse essa isso isto seu sua seus suas meu cada todo todos toda todas só pode podem deve há mais muito também depois aqui fica vez antes "
    "ele ela eles deixou foram fique",
    "pl": "i w we z ze na do od po za o u przez przed pod nad dla bez nie jest są był była było być został została zostało zostanie ma mają się to ten ta te tego tej tym tych że żeby aby bo ponieważ gdy kiedy jeśli "
    "jeżeli ale lub albo oraz tylko już jeszcze jak co kto gdzie tutaj tu tak musi może mogą można powinien najpierw potem każdy każda każde nasz nasza swój jego jej ich raz dlaczego dopóki niczego",
}
# Letters that few of the languages use.
LETTERS = {"de": "ßäöü", "fr": "èêàùœçîïûôë", "es": "ñ¿¡", "pt": "ãõçêôà", "pl": "łżśźćńąęó"}
# Endings that hint at a language.
ENDINGS = {
    "en": "ing tion ness ly ed ers ies able ful ment ous",
    "de": "ung ungen heit keit lich isch chen iert gung",
    "fr": "eur eux aux tion ment ée ées és ique oire eau",
    "es": "ción ado ada ido ida dad mente ero ería ces",
    "pt": "ção ado ada ido ida dade mente eiro ões agem",
    "pl": "any ana ane ony ona one anie enie ości ego emu ych ów",
}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_KANA = re.compile(r"[ぁ-ヿｦ-ﾝ]")
_HAN = re.compile(r"[㐀-䶿一-鿿々]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


_SETS = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
_FOLDED = {k: {fold(x) for x in v} for k, v in _SETS.items()}
_ENDS = {k: tuple(v.split()) for k, v in ENDINGS.items()}


@lru_cache(maxsize=200_000)
def word_scores(word: str) -> tuple[float, ...]:
    """One score per language of LANGS; the word holds letters only."""
    w = word.lower()
    if _KANA.search(w):
        return tuple(4.0 if x == "ja" else -2.0 for x in LANGS)
    if _HAN.search(w):
        return tuple({"zh": 1.5, "ja": 1.0}.get(x, -2.0) for x in LANGS)
    if _CYRILLIC.search(w):
        return tuple(3.0 if x == "ru" else -2.0 for x in LANGS)
    out = []
    parts = re.split(r"['’]", w)
    last, plain = parts[-1], fold(w)
    own = [x for x, s in _SETS.items() if w in s or (len(parts) > 1 and (last in s if x != "fr" else parts[0] in ("l", "d", "qu", "n", "s", "c", "j", "m", "t")))]
    near = [] if own else [x for x, s in _FOLDED.items() if plain in s]
    for x in LANGS:
        if x in ("ru", "zh", "ja"):
            out.append(-1.5)
            continue
        s = 0.0
        if x in own:
            s += 2.4 / (0.5 + 0.5 * len(own))
        elif x in near:
            s += 1.2 / (0.5 + 0.5 * len(near))
        odd = [c for c in w if c > "\x7f"]
        if odd:
            s += 1.0 if any(c in LETTERS.get(x, "") for c in odd) else -1.5 if x == "en" else 0.0
        if len(w) > 4 and w.endswith(_ENDS[x]):
            s += 0.4
        out.append(s)
    return tuple(out)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words with their spans; runs of Han and kana count as words of one character each."""
    out = []
    for m in WORD.finditer(text):
        w = m.group()
        if w[0] > "⹿" and (_HAN.search(w) or _KANA.search(w)):
            out += [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(w)]
        else:
            out.append((w, m.start(), m.end()))
    return out


def segments(text: str, switch: float = 4.0) -> list[tuple[str, int, int]]:
    """(language, start, end) spans of the text, in order: the segmentation of the words with the greatest sum of
    scores minus `switch` for each change of language."""
    words = words_of(text)
    if not words:
        return []
    n = len(LANGS)
    best, back = list(word_scores(words[0][0])), []
    for w, _, _ in words[1:]:
        top = max(range(n), key=best.__getitem__)
        limit, own, now, prev = best[top] - switch, word_scores(w), [], []
        for k in range(n):
            if best[k] >= limit:
                now.append(best[k] + own[k]), prev.append(k)
            else:
                now.append(limit + own[k]), prev.append(top)
        best = now
        back.append(prev)
    k = max(range(n), key=best.__getitem__)
    path = [k]
    for prev in reversed(back):
        k = prev[k]
        path.append(k)
    path.reverse()
    out: list[list] = []
    for (_, s, e), k in zip(words, path):
        if out and out[-1][0] == LANGS[k]:
            out[-1][2] = e
        else:
            out.append([LANGS[k], s, e])
    # Han without any kana around it is Chinese, with kana Japanese: the scores say so already, ties fall to zh.
    return [tuple(x) for x in out]


def main_language(text: str) -> str | None:
    """The language with the most bytes, or None without words."""
    sizes: dict[str, int] = {}
    for lang, s, e in segments(text):
        sizes[lang] = sizes.get(lang, 0) + len(text[s:e].encode())
    return max(sizes, key=lambda k: (sizes[k], k)) if sizes else None


def evidence(text: str, lang: str) -> int:
    """How many words of the text are function words of the language."""
    s, f = _SETS.get(lang, set()), _FOLDED.get(lang, set())
    return sum(w.lower() in s or fold(w) in f for w, _, _ in words_of(text))
