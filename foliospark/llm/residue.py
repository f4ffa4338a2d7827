"""Template residue, filler text and error, block or script messages in place of a page.

Labelled exemplars are kept in an inverted index from their rarer words to the exemplars. A passage window (a title, a
line, or a sentence of a line) that shares such a word with an exemplar is compared with it by TF-IDF containment: the
weight of the shared words over the weight of the window's words, and over the exemplar's. Weights come from the
document frequencies of the whole table. A record is excluded when a window of filler is covered, when a title is, or
when covered windows of messages make up most of what the page shows.

Placeholders are exemplars of the same index. Their words are shapes: the signs that open and close them, with ``name`` for
a name without blanks, ``phrase`` for words with them, ``gap`` for a blank beside a sign. A window is what stands between
an opening sign and the next closing one, read outside code, inline code, formulas and quotations; the opening sign
retrieves the exemplars, and containment decides as for words. Dummy Latin is one exemplar that windows of any of its
words are compared with.

Defined cases: a null or empty content or title has no residue; placeholders in code, inline code or quotation, wiki
templates in wiki text and messages beside own text are none; repeated rows are found each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .blocks import CODE_FORMS, INLINE_CODE, INLINE_FORMULA, scan, visible
from .markup import language

#: Labelled exemplars of messages that stand in place of a page; 0 stands for figures, x for a name.
MESSAGES = (
    "404 Not Found", "Not Found", "The page you requested could not be located on this server.", "The requested URL x was not found on this server.",
    "Page not found", "Sorry, we looked everywhere. Error code: 0", "Try the search or go back to the start page.", "Sorry, the page you are looking for could not be found.",
    "Oops! Something went wrong on our end. Please try again later.", "Something went wrong", "An unexpected error occurred. Please try again.", "This page isn't working", "This site can't be reached",
    "403 Forbidden", "Forbidden", "You do not have permission to access x on this server.", "Access denied", "Access to this page has been denied.", "Your request was blocked. Reference #0", "You have been blocked", "Request blocked",
    "500 Internal Server Error", "Internal Server Error", "Traceback id 0: template x raised an exception.", "Connection to database failed: could not reach backend x (0).", "Error establishing a database connection",
    "502 Bad Gateway", "Bad Gateway proxy/0", "proxy/0", "nginx/0", "Apache/0 Server at x Port 0", "504 Gateway Timeout", "The upstream server did not respond in time.", "503 Service Unavailable", "Service temporarily unavailable. We are down for maintenance and will be back in 0 minutes.", "The service is temporarily unavailable. Please try again later.",
    "429 Too Many Requests", "Too many requests. Slow down and retry after 0 seconds.", "Rate limit exceeded. Please try again later.", "This content has been removed or is no longer available. (0)", "410 Gone", "401 Unauthorized",
    "Checking your browser before accessing x. This takes about 0 seconds. Ray 0", "Just a moment...", "Please wait while we verify your browser", "Verify you are human", "Please complete the security check to access x", "Attention Required!", "Enable cookies to continue.",
    "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app. (x)", "JavaScript is disabled in your browser. Switch it on and reload x.", "JavaScript is required to view this page.", "Sorry, x does not work properly without scripts turned on.",
    "This application requires scripts to be active.", "Loading…", "Loading x …", "If nothing happens, your browser blocks scripts.", "This site requires JavaScript. Please turn it on in your browser settings.",
    "Bitte aktivieren Sie JavaScript, um x anzuzeigen.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "JavaScript ist in Ihrem Browser deaktiviert.", "Seite nicht gefunden", "Die angeforderte Adresse x existiert nicht (Fehler 404).", "Die angeforderte Seite wurde nicht gefunden.", "Zugriff verweigert", "Interner Serverfehler", "Dienst vorübergehend nicht verfügbar",
    "Veuillez activer JavaScript pour afficher cette page.", "JavaScript est désactivé dans votre navigateur.", "Erreur 404", "La page x est introuvable.", "Page introuvable", "Accès refusé", "Erreur interne du serveur", "Service momentanément indisponible",
    "Active JavaScript para continuar en x.", "Debe habilitar JavaScript para ver esta página.", "Página no encontrada", "El recurso x no existe. Código 0.", "Acceso denegado", "Error interno del servidor", "Servicio no disponible temporalmente",
    "Enable JavaScript in your browser to continue.", "Please turn on JavaScript and reload the page.", "This page needs JavaScript to be enabled.", "Your browser does not run scripts; this application requires them.", "Scripts must be active to run this app.", "The requested page could not be found on the server.", "We could not find the page you were looking for.", "The page you are looking for does not exist. Go back to the start page or try the search.", "Error code 0", "Reference 0",
    "We are down for scheduled maintenance. We will be back in a few minutes.", "The server is temporarily unavailable. Please retry after some time.", "You are sending requests too fast. Please slow down.", "Too many requests", "Your request has been blocked by the security rules. Reference 0", "You are not authorized to access this page on this server.", "You do not have access to x.", "This page has been removed and is no longer available.", "The server encountered an error. An exception was raised in template x.", "Failed to connect to the database server x.", "The gateway did not respond in time.",
    "Checking if your browser is secure before you access x. Ray 0", "Please wait a few seconds while the browser is checked.", "JavaScript is turned off in your browser. Please switch it on.", "x does not work without JavaScript turned on.",
    "Bitte schalten Sie JavaScript ein, um fortzufahren.", "Die Seite x existiert nicht.", "Zu viele Anfragen", "Wartungsarbeiten", "Activez JavaScript pour continuer sur x.", "La page demandée n'existe pas.", "Trop de requêtes", "Active JavaScript en su navegador para continuar.", "La página solicitada no existe.", "Demasiadas solicitudes", "Пожалуйста, включите JavaScript, чтобы просмотреть эту страницу.", "Запрошенная страница x не найдена.", "Слишком много запросов",
    "Страница не найдена", "Запрашиваемая страница x не существует. Ошибка 404.", "Доступ запрещён", "Включите JavaScript, чтобы продолжить.", "Внутренняя ошибка сервера", "Сервис временно недоступен",
)
#: Labelled exemplars of titles that say only that something failed.
TITLES = ("Error", "Oops", "Oops!", "Fehler", "Erreur", "Ошибка", "Untitled", "Untitled document", "Unbenannt", "Sans titre", "Sin título", "Без названия", "Insert page title here", "Page title", "Your title here", "New page", "Error 404", "404", "403", "500", "Error 500")
#: Labelled exemplars of filler.
FILLERS = (
    "This is a placeholder paragraph; the final copy follows later.", "Your text goes here. Replace this paragraph with your own words.", "Sample text. Click here to edit and tell visitors about yourself.", "Add your content here.", "This is dummy text.", "Click here to add text", "Type your paragraph here",
    "Hier steht später Ihr Text. Dies ist ein Blindtext.", "Hier könnte Ihr Text stehen.", "Texte à venir. Remplacez ce paragraphe.", "Ceci est un texte de remplissage.", "Texto de relleno. Sustituya este párrafo.", "Escriba aquí su texto.", "Здесь будет ваш текст. Замените этот абзац.", "Replace this text with your own.", "Placeholder text. The final text follows here.", "This paragraph is a placeholder for the final copy.", "Click to edit this text and tell your visitors something about you.", "Dies ist ein Platzhalter. Ihr Text steht später hier.", "Blindtext", "Le texte définitif est à venir. Remplacez ce texte.", "Aquí va su texto. Sustituya este texto de relleno.", "Текст будет позже. Замените этот текст своим.", "Insert page title here",
)
#: The words of the usual dummy Latin.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Words of dummy Latin from which a window is compared with it: single ones are words of other languages too.
LATIN_WORDS = 4
#: Window words covered by an exemplar, by weight, from which a window counts; and exemplar words covered by the window.
WINDOW_COVER = 0.75
EXEMPLAR_COVER = 0.5
#: The same where two exemplars cover a window together.
PAIR_COVER = 0.85
#: Share of a page's visible weight in covered windows of messages from which the page is a message.
PAGE_COVER = 0.6
#: The same for a whole title.
TITLE_COVER = 0.9
#: Letters that weigh as one word where a line is not compared.
LETTERS_A_WORD = 6.0

_WORD = re.compile(r"[^\W\d_]+|\d+")
#: Labelled exemplars of placeholders.
PLACEHOLDERS = (
    "{{name}}", "{{ name }}", "{{ some name }}", "${name}", "${some name}", "%name%", "{%name%}", "{% name %}", "#{name}", "{name}", "<%name%>", "<%= name %>", "<% some name %>", "@@name@@", "<<name>>", "__NAME__", "TBD: name",
    "[Insert name]", "[Insert some name]", "[INSERT SOME NAME]", "[Your name]", "[YOUR NAME]", "[Enter name]", "[Enter some name]", "[Add some name]", "[object Object]", "undefined NaN", "undefined name NaN",
)
#: Words of an instruction, which are not any word, and words that a program prints for lack of a value.
INSTRUCTIONS = frozenset(("insert", "your", "enter", "add"))
PRINTED = frozenset(("object", "undefined", "NaN"))
#: Characters and words that a window of a placeholder may hold.
PLACEHOLDER_CHARS, PRINTED_WORDS = 64, 4
#: Containment of a window of shapes in its exemplar, and of the exemplar in it: nothing else may stand there.
SHAPE_COVER = 0.999

#: What opens a window and what closes it.
_OPENERS = {"{{": "}}", "${": "}", "{%": "%}", "#{": "}", "<%": "%>", "@@": "@@", "<<": ">>", "__": "__", "%": "%", "{": "}", "[": "]", "TBD:": "", "undefined": "NaN"}
_OPENER = re.compile(r"\{\{|\$\{|\{%|#\{|<%=?|@@|<<|(?<!\w)__(?=[A-Z])|(?<![\w%])%(?=[A-Za-z])|(?:(?<=[\s(\"'>,;])|^)\{(?=[A-Za-z])|\[|\bTBD:|\bundefined\b")
_SHAPE = re.compile(r"\s+|[\w.\-]+|[^\w\s]")


def shapes(inner: str, opener: str) -> list[str]:
    """The shapes of what stands between two signs: names, phrases, blanks beside the signs, and all other signs."""
    parts = _SHAPE.findall(inner)
    kinds = ["gap"] if parts and parts[0].isspace() and parts[1:] else []
    named = [p for p in parts if not p.isspace()]
    if opener == "[" and named:
        if named[0] in PRINTED:
            return [f"printed {p.lower()}" for p in named]
        first = named[0].lower() if named[0].istitle() or named[0].isupper() else ""
        if first in INSTRUCTIONS:
            return ["instruct", "phrase"]
        return ["other"]
    if opener == "__":
        return ["capitals"] if len(named) == 1 and len(inner) > 2 and inner.isalpha() and inner.isupper() else ["other"]
    loose = opener in ("{{", "${", "<%")
    if not named or any(not re.match(r"[\w.\-]", p) for p in named):
        return kinds + (["phrase"] if opener == "<%" and named else ["other"])
    if len(named) == 1:
        plain = named[0].replace(".", "").isidentifier() if opener in ("%", "{") else re.fullmatch(r"\w+", named[0]) is not None if opener in ("@@", "<<", "{%", "TBD:") else True
        return ["name"] if plain and not (kinds and opener in ("%", "{", "@@", "<<", "#{")) else ["other"]
    return ["phrase"] if loose else ["other"]


def shape_windows(text: str) -> Iterator[tuple[str, list[str]]]:
    """(opening sign, shapes with the signs) of each window of a text that may be a placeholder."""
    for found in _OPENER.finditer(text):
        sign = found.group()
        opener = "<%" if sign == "<%=" else sign
        closer = _OPENERS[opener]
        start = found.end()
        if opener == "TBD:":
            word = re.match(r"\s*(\w+)", text[start:])
            if word:
                yield opener, [opener, "name"]
            continue
        if opener == "undefined":
            near = _WORD_OR_SIGN.findall(text[start : start + PLACEHOLDER_CHARS])
            if "NaN" in near[:PRINTED_WORDS]:
                yield opener, [opener, "NaN"]
            continue
        end = text.find(closer, start, start + PLACEHOLDER_CHARS)
        if end < 0 or "\n" in text[start:end]:
            continue
        after = text[end + len(closer) : end + len(closer) + 1]
        if opener == "[" and "[" in text[start:end]:
            continue
        if opener == "%" and (after.isalnum() or after in ("%", "_") and after) or opener == "{" and after and not re.match(r"[\s).,;:!?\"'<]", after) or opener == "[" and after == "(":
            continue
        yield opener, [opener, *shapes(text[start:end], opener), closer]


_WORD_OR_SIGN = re.compile(r"\w+")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}\s][^{}]*[^{}\s]\}\}|\{\{\w\}\}")
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|<blockquote\b[^>]*>.*?(?:</blockquote\s*>|$)|\\begin\{quot(?:e|ation)\}.*?(?:\\end\{quot(?:e|ation)\}|$)|``[^`\n]*''")
_SHAPES = re.compile(r"\{\{|\$\{|%[A-Za-z]\w*%|\{%|\{[A-Za-z]|\[(?:INSERT|Insert|YOUR|Your|Enter|ENTER|Add|ADD)\b|<%|&lt;%|@@|undefined|\[object|TBD:|<<|__[A-Z]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def words(text: str) -> list[str]:
    """Words in lower case; figures are one word, 0."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


@lru_cache(maxsize=1)
def vocabulary() -> tuple[str, ...]:
    return tuple(sorted({w for e in (*MESSAGES, *FILLERS, *TITLES) for w in words(e)} | LOREM))


def document_frequencies(pages: DataFrame) -> tuple[dict[str, int], int]:
    """In how many contents each word of the exemplars stands, and the number of contents: over the whole table. The
    result has one row for each word of the vocabulary at most."""
    texts = pages.where("content is not null").select(F.array_intersect(F.split(F.lower("content"), r"[^\p{L}]+"), F.array(*[F.lit(w) for w in vocabulary()])).alias("words"))
    counted = texts.select(F.explode(F.concat(F.array(F.lit("")), "words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}
    return found, found.pop("", 0)


class ResidueIndex:
    """The exemplars, weighted, in an inverted index."""

    def __init__(self, frequencies: dict[str, int], total: int):
        self.weights = {w: math.log((total + 2) / (frequencies.get(w, 0) + 1)) + 0.1 for w in vocabulary()}
        self.weights["0"] = 0.3
        self.weights["x"] = 0.0
        #: A word that no exemplar has weighs as much as the mean exemplar word.
        self.other = sum(self.weights[w] for w in vocabulary()) / len(vocabulary())
        self.exemplars: list[tuple[str, dict[str, int], float]] = []
        self.index: dict[str, list[int]] = {}
        self.shaped: dict[str, list[dict[str, int]]] = {}
        for text in PLACEHOLDERS:
            for opener, window in shape_windows(text):
                self.shaped.setdefault(opener, []).append(dict(Counter(window)))
        for kind, texts in (("message", MESSAGES), ("filler", FILLERS), ("title", TITLES)):
            for text in texts:
                bag = dict(Counter(words(text)))
                self.exemplars.append((kind, bag, sum(self.weights[w] * n for w, n in bag.items())))
                left = self.exemplars[-1][2]
                for w in sorted(set(bag) - {"x"}, key=lambda w: (-self.weights[w], w)):
                    # A text without the words listed so far has at most this weight of the exemplar.
                    if left < EXEMPLAR_COVER * self.exemplars[-1][2]:
                        break
                    self.index.setdefault(w, []).append(len(self.exemplars) - 1)
                    left -= self.weights[w] * bag[w]

    def candidates(self, present: set[str], kinds: tuple[str, ...]) -> list[int]:
        """The exemplars of these kinds that share an indexed word with a text and have at least EXEMPLAR_COVER of
        their weight among its words; no other exemplar can cover a window of it."""
        found, weights = [], self.weights
        for k in {k for w in present & self.index.keys() for k in self.index[w]}:
            kind, bag, size = self.exemplars[k]
            if kind in kinds and sum([weights[w] * n for w, n in bag.items() if w in present]) >= EXEMPLAR_COVER * size:
                found.append(k)
        return found

    def cover(self, window: list[str], chosen: list[int]) -> tuple[float, float]:
        """The containment of the window's words in the best of the chosen exemplars, and the window's weight. An
        exemplar's name may stand for up to three words of the window, the parts of one name."""
        bag = Counter(window)
        weights, other = self.weights, self.other
        total = sum([weights.get(w, other) * n for w, n in bag.items()])
        best, lead, lead_shared = 0.0, None, 0.0
        for k in chosen:
            _, exemplar, size = self.exemplars[k]
            shared = sum([weights[w] * min(n, exemplar[w]) for w, n in bag.items() if w in exemplar])
            if shared < EXEMPLAR_COVER * size:
                continue
            rest = total
            if "x" in exemplar:
                rest -= sum([weights.get(w, other) for w in bag if w not in exemplar][:3])
            best = max(best, shared / rest if rest > 0 else 0.0)
            if shared > lead_shared:
                lead, lead_shared = exemplar, shared
        if best < WINDOW_COVER and lead is not None and total > 0:
            # what one exemplar lacks another of the same message may have
            left = {w: n - min(n, lead.get(w, 0)) for w, n in bag.items()}
            more = max([sum([weights[w] * min(n, self.exemplars[k][1][w]) for w, n in left.items() if n and w in self.exemplars[k][1]]) for k in chosen])
            if lead_shared + more >= PAIR_COVER * total:
                best = (lead_shared + more) / total
        return min(best, 1.0), total

    def covered(self, window: list[str], kinds: tuple[str, ...]) -> float:
        chosen = self.candidates(set(window), kinds)
        return self.cover(window, chosen)[0] if chosen else 0.0

    def filler(self, window: list[str], wanted: bool) -> bool:
        latin = [self.weights[w] for w in window if w in LOREM]
        if len(latin) >= LATIN_WORDS and sum(latin) >= WINDOW_COVER * sum([self.weights.get(w, self.other) for w in window]):
            return True
        return wanted and self.covered(window, ("filler",)) >= WINDOW_COVER

    def placeholder(self, text: str, wiki: bool) -> bool:
        if not _SHAPES.search(text):
            return False
        text = _QUOTED.sub(" ", INLINE_FORMULA.sub(" ", INLINE_CODE.sub(" ", text)))
        if wiki:
            text = _WIKI_TEMPLATE.sub(" ", text)
        return self.shape_covered(visible(text.replace("<%", "\ue002").replace("&lt;%", "\ue002").replace("<<", "\ue003")).replace("\ue002", "<%").replace("\ue003", "<<"))

    def shape_covered(self, text: str) -> bool:
        """Whether a window of shapes is contained in an exemplar that its opening sign retrieves, and the exemplar in it.
        Signs weigh alike: which ones a corpus writes often says nothing of what they open."""
        for opener, window in shape_windows(text):
            bag = Counter(window)
            for exemplar in self.shaped.get(opener, ()):
                shared = sum([min(n, exemplar.get(w, 0)) for w, n in bag.items()])
                if shared >= SHAPE_COVER * len(window) and shared >= SHAPE_COVER * sum(exemplar.values()):
                    return True
        return False

    def title_residue(self, title: str | None) -> bool:
        if not title or title.isspace():
            return False
        if _SHAPES.search(title) and self.shape_covered(title):
            return True
        window = words(title)
        return self.filler(window, True) or self.covered(window, ("message", "title", "filler")) >= TITLE_COVER

    def content_residue(self, content: str | None) -> bool:
        if not content:
            return False
        present = set(words(content))
        messages = self.candidates(present, ("message",))
        fillers = bool(self.candidates(present, ("filler",)))
        latin = len(present & LOREM) >= LATIN_WORDS
        shapes = bool(_SHAPES.search(content))
        if not (messages or fillers or latin or shapes):
            return False
        wiki = shapes and "{{" in content and language(content) == "wiki"
        shown = taken = 0.0
        per_letter = self.other / LETTERS_A_WORD
        for form, _, _, text in scan(content):
            if form in ("container", "rule"):
                continue
            shown += per_letter * len(text)
            if form in CODE_FORMS or form == "quote" or form == "display":
                continue
            if shapes and self.placeholder(text, wiki):
                return True
            if not (messages or fillers or latin):
                continue
            line = set(words(text))
            trial = [k for k in messages if not line.isdisjoint(self.rare(k))] if messages else []
            doubt = (latin and len(line & LOREM) >= LATIN_WORDS) or (fillers and self.candidates(line, ("filler",)))
            if not (trial or doubt):
                continue
            seen = visible(text)
            if _QUOTE_LINE.match(seen) or _QUOTED.match(text):
                continue
            parts = [words(x) for x in _SENTENCE.split(seen)]
            if doubt and any(self.filler(w, fillers) for w in _windows(parts)):
                return True
            if trial:
                share, weight = self.cover([w for p in parts for w in p], trial)
                if share >= WINDOW_COVER:
                    taken += weight
                    shown += weight - per_letter * len(text)
                elif len(parts) > 1:
                    for part in parts:
                        share, weight = self.cover(part, trial)
                        taken += weight if share >= WINDOW_COVER else 0.0
        return taken > 0 and taken >= PAGE_COVER * shown

    @lru_cache(maxsize=None)  # noqa: B019  one index lives as long as its worker's task
    def rare(self, k: int) -> frozenset[str]:
        return frozenset(w for w, ks in self.index.items() if k in ks)


_QUOTE_LINE = re.compile(r"[“„«\"].*[”“»\"]$")


def _windows(parts: list[list[str]]) -> Iterator[list[str]]:
    """Sentences of a line, pairs of neighbours, and the line."""
    for k in range(len(parts)):
        yield parts[k]
        if k + 1 < len(parts):
            yield parts[k] + parts[k + 1]
    if len(parts) > 2:
        yield [w for p in parts for w in p]


def residue_records(pages: DataFrame, id_column: str = "fetch_id") -> DataFrame:
    """(id, in_title, in_content) of the records with residue."""
    index = ResidueIndex(*document_frequencies(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = [index.title_residue(t.as_py()) for t in batch.column(1)]
            contents = [index.content_residue(c.as_py()) for c in batch.column(2)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.bool_()), pa.array(contents, pa.bool_())], names=[id_column, "in_title", "in_content"])
            yield made.filter(pa.array([a or b for a, b in zip(titles, contents)], pa.bool_()))

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, "title", "content").mapInArrow(run, f"`{id_column}` {kind}, in_title boolean, in_content boolean")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_records(table(spark, folder, "fetch_cache")).select("fetch_id")


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The ids and urls of the records that stay."""
    pages = table(spark, folder, "fetch_cache")
    return pages.select("fetch_id", "url").join(residue_records(pages).select("fetch_id"), "fetch_id", "left_anti")
