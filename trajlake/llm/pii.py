"""Problem 4: personal information inside free text, found through disguises and replaced by typed placeholders.

A transducer rewrites a text to a plain form and keeps, for each character of the plain form, where it came from:
invisible characters go, homoglyphs and full-width forms become ASCII, spelled digits become digits, and at/dot
disguises become signs. Identifiers are detected in the plain form and their spans are mapped back, so that what is
reported and replaced is the text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajlake.runtime import table

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

#: Look-alikes of Latin letters and signs.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．·․•∙‐‑‒–－＋（）", "aeopcyxijsdqwhABEKMHOPCTXIJSaopvABEZHIKMNOPTYX@......-----+()"))
INVISIBLE = set("​‌‍⁠﻿­‎‏‪‬⁦⁩")
#: Spelled digits by language.
SPELLED = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
SPELLED_RUN = re.compile(r"(?i)\b(?:%s)(?:[ \-.]+(?:%s)){5,}\b" % (("|".join(sorted(SPELLED, key=len, reverse=True)),) * 2))
AT_DOT = re.compile(
    r"(?i)(?<=[\w+\-])\s*(?:[\[({<]\s*(?:at|arroba|chez|klammeraffe|@)\s*[\])}>]|\s(?:at|arroba)\s(?=\s*[\w\-]+(?:\s*[\[({<]?\s*(?:dot|punkt|point|punto)\b|\.\w)))\s*(?=\w)"
    r"|(?<=\w)\s*(?:[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]|\s(?:dot|punkt|point|punto)\s)\s*(?=\w)"
)
BARE_AT = re.compile(r"(?i)\s+(?:at|arroba)\s+")
HOST = re.compile(r"[\w\-]+\.\w")
LOOKALIKE = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "".join(INVISIBLE) + "０-９Ａ-ｚ]")


def plain_form(text: str, disguised: bool = True) -> tuple[str, list[int] | None]:
    """The plain form and the source offset of each of its characters (one more for the end); None: unchanged.

    ``disguised``: the text has cues of spelled digits or of at and dot written out.
    """
    if not disguised and (text.isascii() or not LOOKALIKE.search(text)):
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        if ch in INVISIBLE:
            continue
        if "０" <= ch <= "９" or "Ａ" <= ch <= "ｚ":
            ch = chr(ord(ch) - 0xFEE0)
        out.append(HOMOGLYPHS.get(ch, ch))
        at.append(i)
    at.append(len(text))
    s = "".join(out)
    for pattern, value in ((SPELLED_RUN, None), (AT_DOT, 0)):
        parts, spots, last = [], [], 0
        for m in pattern.finditer(s):
            a, b = m.span()
            if value == 0 and BARE_AT.fullmatch(m[0]) and HOST.match(s, b) and not user_before(s, a):
                continue
            new = "".join(SPELLED[w.lower()] for w in re.findall(r"[^\W\d_]+", m[0])) if value is None else ("@" if re.search(r"(?i)at|arroba|chez|klammeraffe|@", m[0]) else ".")
            parts += [s[last:a], new]
            # the replacement's characters spread over the source span: the first at its start, the others at its last character
            spots += at[last:a] + [at[a]] + [at[b - 1]] * (len(new) - 1)
            last = b
        if last:
            s, at = "".join(parts) + s[last:], spots + at[last:]
    return s, at


EMAIL = re.compile(r"(?<![\w.+\-@])[A-Za-z0-9À-ÿ][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![\w@])")
NUMERIC = re.compile(r"\d[\d ().\-/]{5,}\d")
ID_FORM = re.compile(
    r"(?<![\w./\-])(?:\d{10}/\d{3}|\d{2}\.\d{3}\.\d{3}-[\dKk]|\d{3}-\d{2}-\d{4}|[XYZ]\d{7,8}[A-Z]?|[A-Z]{2}\d{2} (?:[A-Z0-9]{4} ){2,6}[A-Z0-9]{1,4}|[A-Z]{2}\d{2}(?:[A-Z0-9]{4}){3,7}[A-Z0-9]{0,3}|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|\d{3} \d{2} \d{4})(?![\w/])(?!-\d)"
)
PHONE_FORM = re.compile(
    r"(?<![\w./\-+])(?:\(\+\d{1,3}\) ?\d(?:[ .\-]?\d){7,11}|(?:\+|00)\d{1,3}(?:[ .\-/]{0,3}\(0\))?(?:[ .\-/]{0,3}\(?\d\)?){7,12}|00\d[ \-]\d{3}[ \-]\d{3}[ \-]\d{4}|\(\d{3}\) ?\d{3}[ \-]\d{4}|\(0\d{1,4}\) ?\d{3,6}(?:[ \-]\d{2,5})?|"
    r"[2-9]\d{2}([\-. ])\d{3}\1\d{4}|0\d{4} \d{6}|0\d{2} \d{4} \d{4}|0\d{2,4} \d{3,6}[ \-]?\d{2,4}|0\d(?:([. ])\d{2})(?:\2\d{2}){3}|[6-9]\d{2}([ .\-])\d{3}\3\d{3}|[6-9]\d{2} \d{2} \d{2} \d{2}|[6-9]\d{8})(?![\w/])(?!-\d)(?!\.\d)"
)
PHONE_CUE = re.compile(r"(?i)(?:\b(?:call|ring|reached on|mobile|phone|tel|fax|answer at|appelez le|téléphone|tél|rufen sie|telefon|llama al|teléfono|móvil)\b\.?:? *(?:le |al )?)$")
ID_CUE = re.compile(r"(?i)(?:\b(?:ssn|id|no|nr|number|numéro|número|nummer|ausweisnummer|identité|identidad|passport|dni|nif|nie)\b\.?:? *)$")

CAP = r"[A-ZÀ-Ý][\wà-ÿ'’]*"
TOWN = rf"{CAP}(?:-{CAP})*(?: (?:del|de la|de|la|am|an der|on|upon|sur) {CAP})*"
ADDRESS = re.compile(
    rf"(?<![\w.\-/])(?:(?:Flat|Apt|Unit) \d+\w?, )?\d{{1,5}}[A-Z]? (?:{CAP} ){{1,2}}(?:Street|St|Lane|Ln|Avenue|Ave|Rd|Road|Drive|Court|Way|Place|Close|Square|Terrace|Crescent|Boulevard|Blvd)\b(?:, (?:Apt|Flat|Unit) \d+\w?)?(?:, {TOWN}(?: \d{{4,6}})?)?"
    rf"|\b(?:PO|P\.O\.) Box \d+(?:, {TOWN}(?: \d{{4,6}})?)?"
    rf"|(?<![\w.\-/])\d{{1,5}}(?: (?:bis|ter))?,? (?:rue|chemin|avenue|boulevard|place|allée|impasse|quai|route) (?:de la |de l'|des |du |de |d')?{CAP}(?:-{CAP})*(?:, (?:\d{{5}} )?{TOWN})?"
    rf"|\b(?:Am |An der |Im )?[A-ZÄÖÜ][\wäöüß]*(?:weg|straße|strasse|platz|gasse|allee) \d+[a-z]?\b(?:, (?:\d{{5}} )?{TOWN})?"
    rf"|\b(?:Calle|Plaza|Avda\.|Avenida|Paseo|C/) (?:de (?:la )?)?{CAP}(?:-{CAP})*,? (?:n\.º )?\d+\b(?:, \d+\.º [A-Z]\b)?(?:, (?:\d{{5}} )?{TOWN})?"
    rf"|\b(?:Postfach|Apartado(?: de correos)?|Boîte postale|BP) \d+(?:, (?:\d{{5}} )?{TOWN})?"
)

SUR = r"[A-ZÀ-Ý][a-zà-ÿ]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)*"
INIT = r"[A-ZÀ-Ý]\.(?:-?[A-ZÀ-Ý]\.)*"
FULL = re.compile(
    rf"(?:[A-ZÀ-Ý]{{2,}}(?:-[A-ZÀ-Ý]{{2,}})*, [A-ZÀ-Ý][a-zà-ÿ]+(?: {INIT})*"  # SURNAME, Given
    rf"|(?:[A-ZÀ-Ý][a-zà-ÿ]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)?|{INIT})(?: {INIT})* {SUR})(?![\wà-ÿ])"
)
LOWER = re.compile(r"[a-zà-ÿ]{3,} [a-zà-ÿ]{3,}(?:-[a-zà-ÿ]{3,})*(?![\wà-ÿ])")
ALONE = re.compile(rf"{SUR}(?![\wà-ÿ])")
#: What stands before a name (1: any case may follow; 2: a title, a surname alone will do; 3: a relation or an introduction, a given name and a surname must follow) and after it.
BEFORE = {
    1: "Thanks to |signed by |Ask for |Posted by |Tenant: |is kept for |Kind regards, |Owner: |Owner |Mit freundlichen Grüßen, |Un saludo, |Cordialement, |Merci à |Dank an |Gracias a |est signée |est signée par |unterschrieben von |firmada por |"
    "Inhaber: |Inhaber |Inhaberin: |Inhaberin |Titular: |Titular |Responsable: |Responsable |Locataire : |Mieter: |Mieterin: |Inquilino: |Inquilina: |Publié par |Publicado por |Demandez |Pregunta por |Fragen Sie nach |Regards, |Sincerely, |Yours, |written by |reserviert für |réservée pour |réservée à |reservada para |contact person: ",
    3: "colleague |neighbour |neighbor |friend |brother |sister |uncle |aunt |cousin |husband |wife |daughter |son |mother |father |manager |assistant |secretary |teacher |nurse |lawyer |my name is |I am |"
    "collègue |voisin |voisine |ami |amie |frère |sœur |oncle |tante |mari |femme |fille |fils |mère |père |je m'appelle |s'appelle |Kollege |Kollegin |Nachbar |Nachbarin |Freund |Freundin |Bruder |Schwester |Onkel |Tante |Mutter |Vater |ich heiße |"
    "heißt |namens |colega |vecino |vecina |amigo |amiga |hermano |hermana |tío |tía |marido |esposa |hija |hijo |madre |padre |me llamo |se llama ",
    2: "Mr. |Mrs. |Ms. |Dr. |Prof. |Mr |Mrs |Ms |Dr |Frau |Herrn |Herr |señora |señor |Sra. |Sr. |Madame |Monsieur |Mme |Mlle ",
}
AFTER = re.compile(
    r" (?:left a review|asked for a refund|wrote (?:a review|to us)|a laissé un avis|a demandé un remboursement|hat eine Bewertung|hat .{0,20}Erstattung|bat um|schrieb|dejó una (?:reseña|opinión)|pidió (?:un reembolso|la devolución)|a écrit|escribió)"
)
#: A pair of capitals after a relation is a name only without one of these in it.
PLACES = re.compile(r"(?:Street|Road|Lane|Park|Hall|House|Club|Union|League|City|Town|County|University|College|Church|Press|Times|News|Day|Week|Prize|Award|Cup|Company|Store|Shop|Market|Hotel|Museum|Bank|Office|Team|Support)\b")
NOT_NAMES = frozenset("the a an our your my all every everyone this that these those his her their its us them you it sale more details help price la le les el los las der die das den dem un une una ein eine velvet doctor baker".split())
FIRMS = re.compile(r"^(?:,? (?:& |and )?(?:Sons|Ltd|Inc|GmbH|LLC|Co|SA|SARL|Council|Group|Bank|Street|Lane|Road|Blend|Pass|Holdings|Association|Museum|School|Hotel)\b| (?:&|Ltd|at the paint))")


#: Parts of addresses (9) and of disguised identifiers (8), spelled digits (7).
STREETS = "Street|Lane|Avenue|avenue|Rd|Road|Drive|PO Box|P.O.|rue |chemin |boulevard |weg |straße|strasse|platz |gasse |allee |Calle|Plaza|Avda|Avenida|Paseo|C/|Postfach|Apartado|Boîte postale|BP |Court|Way|Place|Close|Square|Terrace|Crescent|Blvd|place |allée |impasse |quai |route "
DISGUISES = "(at)|[at]|{at}|<at>|( at )|[ at ]|(AT)|[AT]|(dot)|[dot]|[ dot ]|( dot )| dot | DOT | punkt | punto | point |arroba|(punkt)|[punkt]|(point)|[point]|(punto)|[punto]|(chez)|Klammeraffe|klammeraffe"


def _cues() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()

    def add(word: str, k: int) -> None:
        a.add_word(word, a.get(word, ()) + (k,))

    for k, words in BEFORE.items():
        for w in words.split("|"):
            add(w, k)
    for w in (" left a review", " asked for a refund", " wrote ", " a laissé", " a demandé", " hat ", " bat um", " schrieb", " dejó", " pidió", " a écrit", " escribió"):
        add(w, -len(w))
    for w in STREETS.split("|"):
        add(w, 9)
    for w in {v for w in DISGUISES.split("|") for v in (w, w.lower(), w.upper(), w.title())}:
        add(w, 8)
    for w in SPELLED:
        for sign in " -":
            add(sign + w, 7)
    a.make_automaton()
    return a


CUES = _cues()
ID_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ().-/+Kk")
#: " at " before a host name is an address only where a user name stands before it: one with a sign or a digit.
USER = re.compile(r"[\w.+\-]*[._+\-\d][\w.+\-]*\w$")
AFTER_AT = re.compile(r"[\w\-]+(?:\.[A-Za-z]{2}|\s*[\[({<]?\s*(?:dot|punkt|point|punto)\b)", re.I)


def plain_at(s: str) -> bool:
    """" at " stands somewhere between a user name and a host name."""
    for word in (" at ", " AT ", " At ", " arroba "):
        i = s.find(word)
        while i >= 0:
            if AFTER_AT.match(s, i + len(word)) and user_before(s, i):
                return True
            i = s.find(word, i + 1)
    return False


def user_before(s: str, at: int) -> bool:
    a = max(s.rfind(" ", 0, at), s.rfind("\n", 0, at)) + 1
    return bool(USER.fullmatch(s, a, at))
TITLES = re.compile(r"(?:(?:Mrs?|Ms|Dr|Prof|Sra?|Mme|Mlle)\.? |Frau |Herrn? |(?:la )?(?:señora|señor) |Madame |Monsieur )+")
NAME_END = re.compile(rf"(?:[A-ZÀ-Ý]{{2,}}(?:-[A-ZÀ-Ý]{{2,}})*, [A-ZÀ-Ý][a-zà-ÿ]+|(?:[A-ZÀ-Ý][a-zà-ÿ]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)?|{INIT})(?: {INIT})* {SUR}|[a-zà-ÿ]{{3,}} [a-zà-ÿ]{{3,}}(?:-[a-zà-ÿ]{{3,}})*)$")


#: Most words of a name, titles and initials among them.
NAME_WORDS = 12


def words_back(s: str, stop: int, n: int) -> int:
    """Where the last ``n`` words before ``stop`` begin, in the same line."""
    at = stop
    for _ in range(n):
        at = max(s.rfind(" ", 0, at), s.rfind("\n", 0, at))
        if at <= 0 or s[at] == "\n":
            break
    return max(at, 0)


def cue_before(cue: re.Pattern, s: str, at: int) -> bool:
    """``cue`` ends at ``at``, whatever blanks lie between; no cue is longer than forty characters."""
    a = at
    while a and s[a - 1] == " ":
        a -= 1
    return bool(cue.search(s, max(0, a - 40), min(at, a + 1)))


def names(s: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of names beside the cues ``hits``: (last offset, kind)."""
    for end, k in hits:
        i = end + 1
        if 0 < k < 4:
            t = TITLES.match(s, i)
            title = k == 2 or bool(t)
            if t:
                i = t.end()
            m = FULL.match(s, i) or (LOWER.match(s, i) if k == 1 else None) or (ALONE.match(s, i) if title else None)
            if m and k == 3 and not title and (" " not in m[0] or PLACES.search(m[0]) or PLACES.match(s, m.end() + 1)):
                continue
            if m and m[0].split()[0].lower().strip(",") not in NOT_NAMES and not FIRMS.match(s, m.end()):
                yield m.span()
        elif k < 0 and AFTER.match(s, i + k):
            stop = i + k
            m = NAME_END.search(s, words_back(s, stop, NAME_WORDS), stop)
            if m and m[0].split()[0].lower() not in NOT_NAMES:
                a = m.start()
                lead = TITLES.match(s, a)
                yield (lead.end() if lead and lead.end() < stop else a, stop)


def scan(s: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Cues of names with their kinds, and the other kinds of cues that occur."""
    hits, kinds, spelled = [], set(), 0
    for end, ks in CUES.iter(s):
        for k in ks:
            if k < 4:
                hits.append((end, k))
            elif k == 7:
                spelled += 1
            else:
                kinds.add(k)
    if spelled >= 5:
        kinds.add(8)
    return hits, kinds


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information in ``text``, in order, none overlapping."""
    hits, kinds = scan(text)
    s, at = plain_form(text, 8 in kinds or plain_at(text))
    if at is not None:
        hits, kinds = scan(s)
    taken: list[tuple[int, int, str]] = []
    i, last = s.find("@"), 0
    while i >= 0:
        a = i
        while a > last and (s[a - 1].isalnum() or s[a - 1] in "._+-"):
            a -= 1
        m = EMAIL.match(s, a)
        if m:
            taken.append((*m.span(), "EMAIL"))
            last = m.end()
        i = s.find("@", max(i + 1, last))
    if 9 in kinds:
        taken += [(*m.span(), "ADDRESS") for m in ADDRESS.finditer(s)]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    windows = []
    for m in NUMERIC.finditer(s):  # the whole stretch of characters that identifiers are made of, round each long run of digits
        a, b = m.span()
        if windows and a < windows[-1][1]:
            continue
        while a and (s[a - 1] in ID_SIGNS):
            a -= 1
        while b < len(s) and s[b] in ID_SIGNS:
            b += 1
        windows.append((a, min(b + 1, len(s))))
    for w in windows:
        for m in ID_FORM.finditer(s, *w):
            a, b = m.span()
            if free(a, b):
                taken.append((a, b, "PHONE" if cue_before(PHONE_CUE, s, a) else "ID_NUMBER"))
    for w in windows:
        for m in PHONE_FORM.finditer(s, *w):
            a, b = m.span()
            if free(a, b) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                taken.append((a, b, "ID_NUMBER" if cue_before(ID_CUE, s, a) else "PHONE"))
    for a, b in names(s, hits):
        if free(a, b):
            taken.append((a, b, "NAME"))
    taken.sort()
    if at is None:
        return taken
    return [(at[a], at[b - 1] + 1, k) for a, b, k in taken]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, ids, texts = (b.column(i).to_pylist() for i in range(3))
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for s, i, t in zip(src, ids, texts):
            for kind, value in dict.fromkeys((k, t[a:e]) for a, e, k in spans(t)):
                for c, v in zip(cols, (s, i, kind, value)):
                    c.append(v)
        yield pa.record_batch({"src": pa.array(cols[0], pa.string()), "row_id": pa.array(cols[1], pa.int64()), "pii_type": pa.array(cols[2], pa.string()), "pii_text": pa.array(cols[3], pa.string())})


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(2).to_pylist():
            parts, last = [], 0
            for a, e, k in spans(t):
                parts += [t[last:a], f"[{k}]"]
                last = e
            out.append("".join(parts) + t[last:])
        yield pa.record_batch({"src": b.column(0), "row_id": b.column(1), "clean_text": pa.array(out, pa.string())})


def free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, text) of observations and actions; null texts are left out."""
    o = table(spark, sf_dir, "observations").selectExpr("'observation' AS src", "obs_id AS row_id", "processed_text AS text")
    a = table(spark, sf_dir, "actions").selectExpr("'action' AS src", "action_id AS row_id", "response AS text")
    return o.unionByName(a).where("text is not null")


def find_pii(texts: DataFrame) -> DataFrame:
    """(src, row_id, pii_type, pii_text), once per row, type and text; whole texts, one pass, no shuffle."""
    return texts.select("src", "row_id", "text").mapInArrow(_found, "src string, row_id long, pii_type string, pii_text string")


def scrub_pii(texts: DataFrame) -> DataFrame:
    """(src, row_id, clean_text): the texts with a typed placeholder in place of each find, all else as it was."""
    return texts.select("src", "row_id", "text").mapInArrow(_clean, "src string, row_id long, clean_text string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, pii_type, pii_text) of every find."""
    return find_pii(free_texts(spark, sf_dir))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, clean_text) of every text of observations and actions."""
    return scrub_pii(free_texts(spark, sf_dir))
