"""Lines of a rendered page: what they are, and whether the page has content of its own (problems 1 and 5).

A page is parsed once. Raw HTML, where present, goes through the standard library's event parser; each text run gets
its text-to-tag ratio and its block. Lines of the rendered text take the ratio of their text run, or that of their own
link and heading marks. Lines that are furniture by their words split the page in regions. The ratios are smoothed with
a Gaussian and split in two clusters; a region stays when it reaches the upper cluster, or stands next to one that does
and is tied to it by ratio, title or HTML element. Other regions go, whatever their words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from html.parser import HTMLParser

import ahocorasick

#: Labels of site menus and footers, by language, lower case, counters removed.
MENU = set(
    """home|contact|about us|about|gift cards|shop|store|downloads|basket|cart|careers|jobs|news|sign in|log in|login|register|my account|account|help|faq|
community|press room|press|blog|store finder|site map|sitemap|privacy notice|privacy policy|privacy|back to top|terms of use|terms|terms and conditions|accessibility|
imprint|cookies|cookie settings|legal notice|newsletter|search|menu|skip to content|
accueil|contact|à propos|boutique|panier|se connecter|mon compte|aide|actualités|presse|mentions légales|plan du site|confidentialité|haut de page|
startseite|kontakt|über uns|laden|warenkorb|anmelden|mein konto|hilfe|neuigkeiten|presse|impressum|datenschutz|agb|nach oben|
inicio|contacto|quiénes somos|tienda|cesta|acceder|mi cuenta|ayuda|noticias|prensa|aviso legal|mapa del sitio|privacidad|volver arriba""".replace("\n", "").split("|")
)

#: Headings over lists that are not the page's own content.
SIDE = re.compile(
    r"(?i)^(?:most (?:read|popular|viewed|shared)\b.*|recently viewed|popular (?:tags|posts|articles|pages)|you (?:may|might) also (?:like|enjoy)|related(?: \w+){1,2}|latest from .+|"
    r"trending(?: now)?|more from .+|recommended(?: for you)?|see also|tags|categories|les plus (?:lus|vus)|à lire aussi|pages liées|derniers? articles? .*|verwandte (?:seiten|artikel)|meistgelesen|"
    r"das könnte sie auch interessieren|neues? (?:von|aus) .+|páginas relacionadas|lo más (?:leído|visto)|también te puede (?:gustar|interesar)|lo último de .+|actualité de .+)$"
)

#: Consent notices, notices about scripts, prompts, and owner and legal lines.
CONSENT = re.compile(
    r"(?i)\bcookies?\b.*\b(?:use|uses|set|settings|audience|réglages|einstellungen|ajustes|merken|recordar|mesurer|privacy|accept|besuche|visitas)\b|\buses? (?:small files|cookies)\b|\buse of cookies\b|"
    r"\bpartners? process data\b|\bpartenaires traitons\b|\bpartner verarbeiten\b|\bsocios tratamos\b|\boptional trackers\b|\bkeeps a session marker\b|\byour choices matter\b|\bchange this choice at any time\b"
)
SCRIPT_TIP = re.compile(
    r"(?i)^(?:tip: turn on scripting\b|some widgets are off\b|for the best view, please (?:allow|enable)\b|activez javascript pour utiliser\b|activa javascript para usar\b|für den chat bitte javascript\b)"
    r"|\b(?:turn on|allow|enable|activate) (?:scripting|scripts|javascript)\b.*\b(?:to use the|best view|chat|widget)"
)
PROMPT = re.compile(
    r"(?i)^(?:share this (?:page|article|story|post)\b|join \d[\d.,]* ?(?:thousand|million)? readers\b|sign up for the .{1,40}\b(?:letter|newsletter)\b|subscribe (?:to|for|now)\b|"
    r"follow (?:@?\w+ on your favourite networks|us\b)|follow .{1,40} on (?:your favourite networks|social|twitter|facebook|instagram)|download the .{1,40}\bapp\b|"
    r"partagez cette page\b|inscrivez-vous à la lettre\b|suivez(?:-nous)?\b.{1,40}(?:réseaux|offres)|teilen sie diese seite\b|melden sie sich zum rundbrief\b|folgen sie .{1,40}(?:netzwerken)?$|comparte esta página\b|"
    r"apúntate al boletín\b|síg(?:ue|a)nos\b|suscríbete\b)"
)
LEGAL = re.compile(
    r"(?i)^(?:©|\(c\) ?\d{4}|copyright\b.{0,60}\d{4})|\ball rights reserved\b|\btous droits réservés\b|\balle rechte vorbehalten\b|\btodos los derechos reservados\b|\bis a trading name of\b|"
    r"^made with care by\b|^prices include tax\b|\bregistered office\b|^(?:owner|responsable|inhaber|inhaberin|titular)(?::| )\s*\S|^fait avec soin par\b|^mit sorgfalt\b|^hecho con esmero\b"
)
#: A line can only match one of the patterns above (1) or of filler and fields below (2) if it has a cue.
CUES = {
    1: """cookie|small files|partner|partenaires|socios|optional trackers|session marker|choices|choice at any|turn on|scripts are|scripting|javascript|share this|join |sign up|subscribe|follow|download the|partagez|inscrivez|suivez|
teilen sie|melden sie|folgen sie|comparte|apúntate|sígue|sigue|síga|suscríbete|©|(c)|copyright|reserved|réservés|vorbehalten|reservados|trading name|made with care|prices include|registered office|owner|responsable|inhaber|titular|
fait avec|mit sorgfalt|hecho con""",
    2: """@@|{|[[|<<|<%|__|$!|%|[insert|[your|#{|headline|your text|your title|your content|your logo|your tagline|description|write something|sample|replace this|click edit|this first post|just another|heading |todo copy|body copy|tbc by|
votre texte|remplacez|à compléter|tu texto|sustituye|título de ejemplo|pendiente de|ihr text|ersetzen sie|überschrift eintragen|blindtext|text text|asdf|qwer|xxx|test test|foo foo|[object|null|undefined|lorem|ipsum|terrae|ventis|solum|maris|umbra|regis|
claris|portum|ligna|sedet|corpora|vestra|tempora|nullam|vitam|quaeri|molto""",
}


#: The invented Latin of filler text, and function words that real text has.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua felix terrae molto maris corpora sedet regis claris portum ligna umbra vestra tempora nullam vitam quaeri ventis solum
    veniam nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure voluptate velit esse cillum fugiat nulla pariatur""".split()
)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for bit, words in CUES.items():
        for w in words.replace("\n", "").split("|"):
            a.add_word(w, bit | (a.get(w, 0)))
    for w in LATIN | {"nan", "foo", "bar", "test", "text", "xx", "add a", "add your"}:  # what the patterns of filler also begin from
        a.add_word(w, 2 | a.get(w, 0))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def cues(text: str, starts: list[int]) -> list[int]:
    """Bits of the cues in each line; ``starts`` has the lines' offsets in ``text``."""
    bits, low = [0] * len(starts), text.lower()
    if len(low) != len(text):  # lower case changed the length: offsets are taken line by line
        return [_bits(line.lower()) for line in text.split("\n")]
    for end, bit in AUTOMATON.iter(low):
        bits[bisect_right(starts, end) - 1] |= bit
    return bits


def _bits(low: str) -> int:
    out = 0
    for _, bit in AUTOMATON.iter(low):
        out |= bit
    return out


ITEM = re.compile(r"\[id: ?\d+\] ?(.*?) ?(link|button|dropdown)?(?=\s*\[id: ?\d+\]|\s*$)")
COUNT = re.compile(r"\s*\(?\d*\)?\s*$")
HEAD = re.compile(r"^(#{1,6})\s+(.*)$")

BLANK, MENU_LINE, SIDE_HEAD, FURNITURE, HEADING, LINK, TEXT, NOTICE = range(8)


def label(text: str) -> str:
    return COUNT.sub("", text).strip().lower()


def kind_of(line: str, bits: int = 3) -> int:
    """What a line is by itself; context decides about links and lists. ``bits``: its cues."""
    s = line.strip()
    if not s:
        return BLANK
    if s.startswith("[id:"):
        items = ITEM.findall(s)
        if len(items) > 1:
            return MENU_LINE
        if items and (items[0][1] == "button" or label(items[0][0]) in MENU):
            return MENU_LINE
        return LINK
    m = HEAD.match(s)
    if m:
        return SIDE_HEAD if SIDE.match(m[2].strip()) else HEADING
    if bits & 1:
        if LEGAL.search(s) or CONSENT.search(s) or (len(s) < 110 and PROMPT.search(s)):
            return FURNITURE
        if SCRIPT_TIP.search(s):
            return NOTICE
    if len(s) < 30 and label(s) in MENU:
        return MENU_LINE
    return TEXT


class Runs(HTMLParser):
    """Text runs of an HTML page with the tags around them, the number of their block and the sectioning element they stand in."""

    BLOCKS = frozenset("nav main article aside footer header section div td table form ul ol".split())
    SECTIONS = frozenset("nav main article aside footer header section div td form".split())
    PLAIN = frozenset("div section td form".split())  # without attributes, these say nothing of what they hold
    SKIP = frozenset("script style title noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = self.block = self.skip = 0
        #: elements of one start tag in one place are one section: a body that a prompt interrupts is opened again
        self.sections: dict[tuple[int, str], int] = {}
        self.start = ""
        self.open: list[tuple[str, int]] = [("body", 0)]
        self.runs: dict[str, tuple[float, int, int]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in self.BLOCKS:
            self.block += 1
            if tag in self.SECTIONS:
                start = self.start or self.get_starttag_text() or tag
                at = (self.open[-1][1], start if len(start) > len(tag) + 2 or tag not in self.PLAIN else f"{tag}{self.block}")
                self.open.append((tag, self.sections.setdefault(at, len(self.sections) + 1)))
        elif tag in self.SKIP:
            self.skip += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in self.BLOCKS:
            self.block += 1
            if tag in self.SECTIONS:
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] == tag:
                        del self.open[i:]
                        break
        elif tag in self.SKIP and self.skip:
            self.skip -= 1

    OPEN = re.compile(r"<([a-z][a-z0-9]*)(?:\s[^<>\"'`]*(?:\"[^\"]*\"[^<>\"'`]*)*)?>")
    CLOSE = re.compile(r"</([a-z][a-z0-9]*)>")
    SLOW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())

    def parse_starttag(self, i: int) -> int:
        """Plain tags need no attributes; anything else goes the long way."""
        m = self.OPEN.match(self.rawdata, i)
        if not m or m[1] in self.SLOW or self.cdata_elem:
            return super().parse_starttag(i)
        self.start = m[0]
        self.handle_starttag(m[1], [])
        self.start = ""
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = self.CLOSE.match(self.rawdata, i)
        if not m or m[1] in self.SLOW or self.cdata_elem:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.skip:
            self.runs.setdefault(text, (len(text) / (1.0 + self.tags), self.block, self.open[-1][1]))
            self.tags = 0


def html_runs(html: str | None) -> dict[str, tuple[float, int, int]]:
    """Text run → (text-to-tag ratio, block, sectioning element); empty where there is no HTML; as far as it can be read."""
    if not html:
        return {}
    p = Runs()
    at = html.find("<body")
    try:
        p.feed(html[max(at, 0) :])
        p.close()
    except AssertionError:  # the parser gives up on some declarations; what it read stands
        pass
    return p.runs


#: Gaussian weights of a line and its three neighbours either side, standard deviation one line.
WEIGHTS = tuple(math.exp(-0.5 * d * d) for d in range(4))
KERNEL = tuple(w / (WEIGHTS[0] + 2 * sum(WEIGHTS[1:])) for w in WEIGHTS)


def smooth(x: list[float]) -> list[float]:
    """Gaussian smoothing; the ends are continued."""
    k0, k1, k2, k3 = KERNEL
    y = [x[0]] * 3 + x + [x[-1]] * 3
    return [k0 * y[i] + k1 * (y[i - 1] + y[i + 1]) + k2 * (y[i - 2] + y[i + 2]) + k3 * (y[i - 3] + y[i + 3]) for i in range(3, len(x) + 3)]


def two_means(x: list[float], rounds: int = 6) -> float:
    """Threshold between the two clusters of ``x``."""
    cut = (min(x) + max(x)) / 2
    for _ in range(rounds):
        above = [v for v in x if v > cut]
        if not above or len(above) == len(x):
            break
        up = sum(above)
        new = (up / len(above) + (sum(x) - up) / (len(x) - len(above))) / 2
        if abs(new - cut) < 0.01:
            break
        cut = new
    return cut


LINK_TEXT = re.compile(r"^\[id: ?\d+\] ?(.*?) ?(?:link|button|dropdown)?$")


def bare(line: str) -> str:
    """The line's text without link and heading marks."""
    s = line.strip()
    m = LINK_TEXT.match(s)
    if m:
        return m[1]
    return s.lstrip("#*> ").strip()


def tied(lines: list[str], ratio: list[float], section: list[int], cut: float, region: tuple[int, int], beside: list[tuple[int, int]]) -> bool:
    """A region of the lower cluster belongs to one beside it: by a line above the threshold, the page's title, or the same HTML element around both."""
    i, j = region
    if any(v > cut for v in ratio[i:j]) or any(s.lstrip().startswith("# ") for s in lines[i:j]):
        return True
    near = {section[x] for a, b in beside for x in range(a, b)} - {0}
    return any(x in near for x in section[i:j])


def body_lines(text: str, html: str | None, kinds: dict[str, int] | None = None) -> list[int]:
    """Numbers of the lines of the page's own body, whatever it says. ``kinds`` caches the kinds of repeated lines."""
    lines = text.split("\n")
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    bits = cues(text, starts)
    kind = []
    for s, bit in zip(lines, bits):
        if s.startswith("[id:"):
            k = kinds.get(s) if kinds is not None else None
            if k is None:
                k = kind_of(s, bit)
                if kinds is not None and len(s) < 80:
                    if len(kinds) > 100_000:
                        kinds.clear()
                    kinds[s] = k
        else:
            k = kind_of(s, bit)
        kind.append(k)
    runs = html_runs(html)
    ratio, block, section = [0.0] * len(lines), [None] * len(lines), [0] * len(lines)
    for i, s in enumerate(lines):
        hit = runs.get(bare(s)) if runs else None
        if hit:
            ratio[i], block[i], section[i] = hit
        else:
            tags = s.count("[id:")
            ratio[i] = (len(s) - 9 * tags) / (1.0 + 2 * tags)
        ratio[i] = min(ratio[i], 400.0)
    even = smooth(ratio)
    cut = two_means(even)
    core = [v > cut for v in even]
    # side lists: from their heading to a blank line, the next page heading, furniture, or the end of their HTML block
    side, home, shut = False, None, []
    for i, k in enumerate(kind):
        if k == SIDE_HEAD:
            side, home = True, block[i]
        elif side and (k in (BLANK, MENU_LINE, FURNITURE, NOTICE) or (k == HEADING and lines[i].lstrip().startswith("# ")) or (home is not None and block[i] is not None and block[i] != home)):
            side = False
        shut.append(side or k in (BLANK, MENU_LINE, SIDE_HEAD, FURNITURE, NOTICE))
    # regions: runs of open lines
    regions, i, n = [], 0, len(lines)
    while i < n:
        if shut[i]:
            i += 1
            continue
        j = i
        while j < n and not shut[j]:
            j += 1
        regions.append((i, j))
        i = j
    # the upper cluster; where menus around a short body smooth it away, by the lines' own ratios; in a page of one ratio, all
    above = [any(core[i:j]) for i, j in regions]
    if not any(above):
        above = [any(v > cut for v in ratio[i:j]) for i, j in regions]
    if not any(above):
        above = [True] * len(regions)
    keep = []
    for r, (i, j) in enumerate(regions):
        beside = [regions[x] for x in (r - 1, r + 1) if 0 <= x < len(regions) and above[x]]
        if above[r] or (beside and (not runs or tied(lines, ratio, section, cut, (i, j), beside))):
            keep.extend(range(i, j))
    return keep


#: What error pages and notices about scripts say.
ERROR = re.compile(
    r"(?i)\b(?:404|403|400|401|408|410|429|500|502|503|504|50x)\b|\bnot found\b|\bintrouvable\b|\bno encontrada\b|\bnicht gefunden\b|\b(?:http )?(?:error|erreur|fehler) ?\d*\b|\bbad gateway\b|\binternal server\b|"
    r"\bgateway time-?out\b|\bhost unreachable\b|\btimed out\b|\btoo long to respond\b|\bunable to connect\b|\bproxy refused\b|\bcan'?t be reached\b|\bconnection is not private\b|\bcertificate of\b|"
    r"\baccess denied\b|\bacceso denegado\b|\baccès refusé\b|\bzugriff verweigert\b|\bforbidden\b|\brequest blocked\b|\brequests?\b.*\btoo many\b|\btoo many requests\b|\bslow down and retry\b|\bsession expired\b|"
    r"\breload the window\b|\bsomething went wrong\b|\btry again later\b|\bplus tard\b|\bmás tarde\b|\bspäter erneut\b|\bservers? took a nap\b|\boops\b|\bmoved or never existed\b|\bitem you followed is gone\b|"
    r"\btemporarily unavailable\b|\bdown for maintenance\b|\bindisponible\b|\bno disponible\b|\bwartungsarbeiten\b|\bnicht erreichbar\b|\bdomain has been parked\b|\bnothing is published\b|\btraceback\b|"
    r"\bfatal error\b|\buncaught exception\b|\bwarning: undefined\b|\bcould not be rendered\b|\bno content was returned\b|\bthat'?s an error\b|\bquota exceeded\b|\bcaptcha\b|\bverify you are (?:a )?human\b|"
    r"\bchecking your browser\b|\bwe are sorry\b|\balgo ha fallado\b|\bun problème est survenu\b|\bkey ?error\b|\bdatabase connection\b|\bblocked\b|\bback shortly\b|\bclient may not fetch\b|\bincident [0-9a-f]{6,}"
)
SCRIPTS = re.compile(
    r"(?i)\b(?:java ?script|scripts?|scripting)\b.*\b(?:enable|disabled|activ|activez|activa|aktivier|einschalt|eingeschalt|turn on|switch|need|needs|needed|require|block|blocking|necesita|besoin|allow|off|funktioniert nur|properly without)|"
    r"\b(?:enable|activate|activez|activer|activa|activar|aktivieren|turn on|switch on|allow|needs?|requires?|blocking|without|necesita|besoin de|funktioniert nur)\b.*\b(?:java ?script|scripts?|scripting)\b|\bloading\.\.\.|^loading\b|"
    r"\bswitch it on and reload\b|\bneeds scripts and cookies\b|\bwe cannot show this page\b|\bto see the content\b"
)
#: Filler that stands where content should be.
FILLER = re.compile(
    r"(?i)\byour (?:headline|text|title|content|logo|tagline) (?:goes )?here\b|\badd (?:a|your) (?:short )?(?:description|text|title)\b.*\b(?:here|box|block)\b|\bwrite something about yourself\b|\bsample (?:product name|price|description|text)\b.*\bsample\b|"
    r"\bthis is a sample page\b|\breplace this (?:text|paragraph)\b|\bclick edit to change\b|\bedit or delete this first post\b|\bjust another (?:new )?site\b|^heading \d\.? ?(?:heading|$)|\btodo copy\b|\bbody copy to follow\b|\btbc by marketing\b|"
    r"\bvotre texte ici\b|\bremplacez ce paragraphe\b|\btitre de la page à compléter\b|\bescribe aquí tu texto\b|\bsustituye este párrafo\b|\btítulo de ejemplo\b|\bpendiente de rellenar\b|\bhier steht ihr text\b|\bersetzen sie diesen absatz\b|"
    r"\büberschrift eintragen\b|\bblindtext, blindtext\b|^(?:\W*(?:text|asdf|qwer|test|foo|bar|x{2,}|\d+)\b){4,}\W*$|^\W*(?:x{2,}\W*){4,}$|\[object object\]|\bnull, nan\b|\b(?:undefined|null|nan)\b[ ,]+(?:undefined|null|nan)\b|\blorem ipsum dolor\b"
)
#: An unfilled field in the notations of common template engines.
FIELD = re.compile(
    r"\{\{ ?[\w.\-]+ ?\}\}|\{% ?[\w.\-]+ ?%\}|<%= ?[\w.\-]+ ?%>|<<[\w.\-]+>>|\[\[[\w.\-]+\]\]|#\{[\w.\-]+\}|\$!?\{[\w.\-]+\}|\$![\w.\-]+|__[A-Z][A-Z0-9.\-]*(?:_[A-Z0-9.\-]+)*__|%[A-Z][A-Z0-9.\-]*(?:_[A-Z0-9.\-]+)*%|"
    r"@@[\w.\-]+@@|\[(?:Insert|insert) [\w.\- ]+ here\]|\[(?:your|Your) [\w.\-]+\]|(?<![\w$#{])\{(?:[A-Za-z_][\w.\-]*|\d)\}|(?<![\w%])%(?:\d\$)?s(?![\w%])|(?<!\w)%[A-Z][A-Z_]+%"
)
QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“")
WORDS = re.compile(r"[^\W\d_]+")


def latin_filler(line: str) -> bool:
    """Eight or more words, at least half of them filler Latin."""
    w = WORDS.findall(line.lower())
    return len(w) >= 8 and sum(x in LATIN for x in w) * 2 >= len(w)


def residue(line: str) -> bool:
    """An unfilled field or filler stands in the line, not shown as an example in quotation marks or code."""
    if not _bits(line.lower()) & 2:
        return False
    shown = QUOTED.sub(" ", line)
    return bool(FIELD.search(shown) or FILLER.search(shown) or latin_filler(shown))


PART = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ü¿¡:])")


#: A body that is nothing but an error message may say so many parts, and a third of them, in other words; so many words,
#: addresses aside, make a statement of its own.
OTHER_PARTS, OTHER_WORDS = 2, 10


ADDRESS = re.compile(r"(?i)\bhttps?://\S+")


def speaks_of_error(part: str) -> bool:
    part = " ".join(part.split())
    return bool(ERROR.search(part) or SCRIPTS.search(part))


def body_verdict(body: list[str]) -> str:
    """field, error or own: what the page's body is. ``body`` has its lines without link marks, blank ones left out."""
    if not body:
        return "empty"
    if any(residue(x) for x in body):
        return "field"
    parts = [p for x in body for p in PART.split(unicodedata.normalize("NFKC", x)) if WORDS.search(p) or re.search(r"\d{3}", p)]
    other = 0
    for p in parts:  # ends with the third part that speaks of something else, or the first that says more
        if not speaks_of_error(p):
            other += 1
            if other > OTHER_PARTS or len(WORDS.findall(ADDRESS.sub(" ", p))) > OTHER_WORDS:
                return "own"
    return "error" if parts and 3 * other <= len(parts) else "own"
