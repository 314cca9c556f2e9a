"""Snowball-style stemmers for seven languages, in plain Python, applied to arrays of lower-case words by batch."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """R1 and R2: behind the first non-vowel that follows a vowel, and the same again from there."""

    def after(i: int) -> int:
        while i < len(w) and w[i] not in vowels:
            i += 1
        while i < len(w) and w[i] in vowels:
            i += 1
        return min(i + 1, len(w))

    r1 = after(0)
    return r1, after(r1)


def _rv(w: str, vowels: str) -> int:
    """RV of the Romance languages."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _longest(w: str, suffixes, start: int = 0) -> str:
    """The longest of suffixes that ends w and begins at start or later."""
    best = ""
    for s in suffixes:
        if len(s) > len(best) and w.endswith(s) and len(w) - len(s) >= start:
            best = s
    return best


# -- English

_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_V = "aeiouy"


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def english(w: str) -> str:
    if len(w) < 3:
        return w
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = w.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _V) else c for i, c in enumerate(w))
    r1, r2 = _regions(w, _V)
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            r2 = max(r1, _regions(w[r1:], _V)[0] + r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _V for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    s = _longest(w, _EN_2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l")) and not (s == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + _EN_2[s]
    s = _longest(w, _EN_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _EN_3[s]
    s = _longest(w, _EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# -- German


def german(w: str) -> str:
    v = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v else c for i, c in enumerate(w))
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"), r1)
    if s and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"), r1)
    if s and (s != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) > 5)):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), r2)
    if s in ("end", "ung"):
        w = w[: -len(s)]
        if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
            w = w[:-2]
    elif s in ("ig", "ik", "isch"):
        if w[: -len(s)][-1:] != "e":
            w = w[: -len(s)]
    elif s in ("lich", "heit"):
        w = w[: -len(s)]
        if w.endswith(("er", "en")) and len(w) - 2 >= r1:
            w = w[:-2]
    elif s == "keit":
        w = w[:-4]
        t = _longest(w, ("lich", "ig"), r2)
        w = w[: len(w) - len(t)]
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


# -- Spanish

_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_DEL = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()


def spanish(w: str) -> str:
    v = "aeiouáéíóúü"
    r1, r2 = _regions(w, v)
    rv = _rv(w, v)
    plain = str.maketrans("áéíóú", "aeiou")
    s = _longest(w, ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"), rv)
    if s:
        stem = w[: -len(s)]
        for e in ("iéndo", "ándo", "ár", "ér", "ír"):
            if stem.endswith(e) and len(stem) - len(e) >= rv:
                w = stem[: -len(e)] + e.translate(plain)
                break
        else:
            if any(stem.endswith(e) and len(stem) - len(e) >= rv for e in ("ando", "iendo", "ar", "er", "ir")) or stem.endswith("uyendo"):
                w = stem
    start = w
    s = _longest(w, [*_ES_DEL, "adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias", "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    at = len(w) - len(s)
    if s:
        if s == "amente" and at >= r1:
            w = w[:at]
            t = _longest(w, ("iv", "os", "ic", "ad"), r2)
            w = w[: len(w) - len(t)]
            if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
        elif at >= r2 and s != "amente":
            w = w[:at] + ("log" if s.startswith("log") else "u" if s.startswith("uc") else "ente" if s.startswith("enc") else "")
            if s.startswith(("ador", "aci", "anc", "ante")) and w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
            elif s == "mente":
                w = w[: len(w) - len(_longest(w, ("ante", "able", "ible"), r2))]
            elif s.startswith("idad"):
                w = w[: len(w) - len(_longest(w, ("abil", "ic", "iv"), r2))]
            elif s.startswith("iv") and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    if w == start:
        s = _longest(w, _ES_Y, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w, [*_ES_VERB, "en", "es", "éis", "emos"], rv)
            if s in ("en", "es", "éis", "emos"):
                w = w[: -len(s)]
                if w.endswith("gu"):
                    w = w[:-1]
            elif s:
                w = w[: -len(s)]
    s = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


# -- French

_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(w: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    x = list(w)
    for i, c in enumerate(w):
        near = 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v
        if (c in "ui" and near) or (c == "y" and ((i and w[i - 1] in v) or (i + 1 < len(w) and w[i + 1] in v))) or (c == "u" and i and w[i - 1] == "q"):
            x[i] = c.upper()
    w = "".join(x)
    r1, r2 = _regions(w, v)
    if w.startswith(("par", "col", "tap")) or (len(w) > 2 and w[0] in v and w[1] in v):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    start, verbs = w, False
    s = _longest(w, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split())
    at = len(w) - len(s)
    if s in ("ement", "ements") and at >= rv:
        w = w[:at]
        if w.endswith("ativ") and len(w) - 4 >= r2:
            w = w[:-4]
        elif t := _longest(w, ("iv", "eus", "abl", "iqU", "ièr", "Ièr")):
            b = len(w) - len(t)
            if t in ("ièr", "Ièr"):
                w = w[:b] + "i" if b >= rv else w
            elif b >= r2:
                w = w[:b]
            elif t == "eus" and b >= r1:
                w = w[:b] + "eux"
    elif s in ("amment", "emment") and at >= rv:
        w, verbs = w[:at] + ("ant" if s[0] == "a" else "ent"), True
    elif s in ("ment", "ments") and at > rv and w[at - 1] in v:
        w, verbs = w[:at], True
    elif s == "eaux":
        w = w[:-1]
    elif s == "aux" and at >= r1:
        w = w[:at] + "al"
    elif s in ("euse", "euses"):
        w = w[:at] if at >= r2 else w[:at] + "eux" if at >= r1 else w
    elif s in ("issement", "issements") and at >= r1 and w[at - 1] not in v:
        w = w[:at]
    elif s and at >= r2 and s not in ("ement", "ements", "amment", "emment", "ment", "ments", "aux", "issement", "issements"):
        w = w[:at] + ("log" if s.startswith("log") else "u" if s[0] == "u" else "ent" if s.startswith("enc") else "")
        if s.startswith(("at", "at")) and w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif s.startswith("it"):
            for t, other in (("abil", "abl"), ("ic", "iqU"), ("iv", "iv")):
                if w.endswith(t):
                    w = w[: -len(t)] if len(w) - len(t) >= r2 else w[: -len(t)] + other
                    break
        elif s.startswith("if") or s.startswith("iv"):
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    changed = w != start
    if not changed or verbs:
        s = _longest(w, _FR_I, rv)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in v:
            w, changed = w[: -len(s)], True
        else:
            s = _longest(w, [*_FR_E, *_FR_A, "ions"], rv)
            if s == "ions":
                if len(w) - 4 >= r2:
                    w, changed = w[:-4], True
            elif s:
                w, changed = w[: -len(s)], True
                if s in _FR_A and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
    if changed:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        s = _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        if s == "ion":
            if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
                w = w[:-3]
        elif s in ("e",):
            w = w[:-1]
        elif s == "ë":
            w = w[:-1] if w.endswith("guë") else w
        elif s:
            w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] not in v:
        i -= 1
    if 0 < i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.lower()


# -- Italian

_IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(w: str) -> str:
    v = "aeiouàèìòù"
    w = w.translate(str.maketrans("áéíóú", "àèìòù"))
    w = "".join(c.upper() if (c == "u" and i and w[i - 1] == "q") or (c in "ui" and 0 < i < len(w) - 1 and w[i - 1] in v and w[i + 1] in v) else c for i, c in enumerate(w))
    r1, r2 = _regions(w, v)
    rv = _rv(w, v)
    s = _longest(w, "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
    if s:
        stem = w[: -len(s)]
        if any(stem.endswith(e) and len(stem) - len(e) >= rv for e in ("ando", "endo")):
            w = stem
        elif any(stem.endswith(e) and len(stem) - 2 >= rv for e in ("ar", "er", "ir")):
            w = stem + "e"
    start = w
    s = _longest(w, "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive".split())
    at = len(w) - len(s)
    if s in ("amento", "amenti", "imento", "imenti"):
        w = w[:at] if at >= rv else w
    elif s == "amente":
        if at >= r1:
            w = w[:at]
            t = _longest(w, ("iv", "os", "ic", "abil"), r2)
            w = w[: len(w) - len(t)]
            if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    elif s and at >= r2:
        w = w[:at] + ("log" if s.startswith("log") else "u" if s.startswith(("uz", "us")) else "ente" if s.startswith("enz") else "")
        if s.startswith(("azion", "ator")) and w.endswith("ic") and len(w) - 2 >= r2:
            w = w[:-2]
        elif s == "ità":
            w = w[: len(w) - len(_longest(w, ("abil", "ic", "iv"), r2))]
        elif s in ("ivo", "ivi", "iva", "ive") and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
            if w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
    if w == start:
        s = _longest(w, _IT_VERB, rv)
        w = w[: len(w) - len(s)]
    if w[-1:] in tuple("aeioàèìò") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


# -- Portuguese

_PT_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias "
    "arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(w: str) -> str:
    v = "aeiouáéíóúâêô"
    w = w.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, v)
    rv = _rv(w, v)
    start = w
    s = _longest(w, "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras".split())
    at = len(w) - len(s)
    if s == "amente":
        if at >= r1:
            w = w[:at]
            t = _longest(w, ("iv", "os", "ic", "ad"), r2)
            w = w[: len(w) - len(t)]
            if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    elif s in ("ira", "iras"):
        if at >= rv and w[at - 1 : at] == "e":
            w = w[:at] + "ir"
    elif s and at >= r2:
        w = w[:at] + ("log" if s.startswith("log") else "u" if s.startswith("uç") else "ente" if s.startswith("ênc") else "")
        if s == "mente":
            w = w[: len(w) - len(_longest(w, ("ante", "avel", "ível"), r2))]
        elif s.startswith("idad"):
            w = w[: len(w) - len(_longest(w, ("abil", "ic", "iv"), r2))]
        elif s.startswith("iv") and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    if w == start:
        s = _longest(w, _PT_VERB, rv)
        w = w[: len(w) - len(s)]
    if w != start:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _longest(w, ("os", "a", "i", "o", "á", "í", "ó"), rv)
        w = w[: len(w) - len(s)]
    if w[-1:] in ("e", "é", "ê") and len(w) - 1 >= rv:
        w = w[:-1]
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# -- Russian

_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJ = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PART = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(w: str) -> str:
    v = "аеиоуыэюя"
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    r2 = _regions(w, v)[1]

    def cut(w: str, groups: tuple) -> str:
        """w without the longest ending of either group; those of the first must follow а or я."""
        a, b = _longest(w, groups[0], rv), _longest(w, groups[1], rv)
        if len(b) >= len(a) and b:
            return w[: -len(b)]
        if a and len(w) - len(a) - 1 >= rv and w[-len(a) - 1] in "ая":
            return w[: -len(a)]
        return w[: len(w) - len(b)]

    new = cut(w, _RU_GERUND)
    if new == w:
        s = _longest(w, ("ся", "сь"), rv)
        w = w[: len(w) - len(s)]
        s = _longest(w, _RU_ADJ, rv)
        if s:
            new = cut(w[: -len(s)], _RU_PART)
        else:
            new = cut(w, _RU_VERB)
            if new == w:
                s = _longest(w, _RU_NOUN, rv)
                new = w[: len(w) - len(s)]
    w = new
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    s = _longest(w, ("ост", "ость"), r2)
    w = w[: len(w) - len(s)]
    if w.endswith("нн"):
        return w[:-1]
    s = _longest(w, ("ейш", "ейше"), rv)
    if s:
        w = w[: -len(s)]
        return w[:-1] if w.endswith("нн") else w
    return w[:-1] if w.endswith("ь") else w


_STEMMERS = {"en": english, "es": spanish, "fr": french, "de": german, "it": italian, "pt": portuguese, "ru": russian}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    return _STEMMERS[language](word)


def stemmed(words: Column, language: str) -> Column:
    """An array of words with each one stemmed. No word of a batch is a Python object but its distinct ones."""

    @F.arrow_udf("array<string>")
    def stems(col: pa.Array) -> pa.Array:
        return stem_lists(col, language)

    return stems(words)


def stem_lists(col: pa.ListArray, language: str, piece: int = 1 << 20) -> pa.ListArray:
    """Lists of words with each one stemmed, about so many words at a time."""
    out, at = [], 0
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(col), 0)).to_numpy()
    while at < len(col):
        end = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + piece, "right")))
        part = col.slice(at, end - at)
        words = part.flatten().dictionary_encode()
        stems = pa.array([None if w is None else stem(w, language) for w in words.dictionary.to_pylist()], pa.string())
        n = pc.fill_null(pc.list_value_length(part), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(n).cast(pa.int32())])
        out.append(pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=part.is_null()))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))
