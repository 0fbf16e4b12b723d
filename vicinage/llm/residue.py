"""Texts that are residue of templates and pages.

A multi-pattern automaton finds multilingual phrases of error pages, filler text
and notices that scripts are required, and the words that pages address their
reader with. A phrase alone proves nothing, as reports speak of failed fetches
and scripts too; what decides is the share of a text's unit (sentence, line or
marked-up block) that phrases cover, alone or together with those words: a
message says little besides, a report names what failed, where and when. Unfilled
slots are found by their notation.

Phrases and words are those of web servers, browsers and office templates in
general, in seven languages; none names what the texts of a project are about.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: phrases, in lower case, one blank between words; "#" stands for a number
ERROR_PHRASES = (
    # English
    "page not found", "not found", "cannot be displayed", "can't be displayed", "could not be displayed", "internal server error", "server error", "bad gateway", "gateway time-out", "gateway timeout", "gateway timed out", "service unavailable", "temporarily unavailable", "currently unavailable",
    "access denied", "access forbidden", "permission denied", "do not have permission", "don't have permission", "not authorized", "not authorised", "forbidden", "unauthorized", "http error", "error #", "# error", "error code", "bad request", "request blocked", "has been blocked", "too many requests", "rate limit exceeded",
    "connection timed out", "connection refused", "connection reset", "connection closed", "request timed out", "timed out", "did not answer in time", "did not respond", "took too long to respond", "unable to connect", "failed to load", "could not be loaded", "failed to fetch", "something went wrong", "unexpected error", "an error occurred", "an error has occurred", "error occurred",
    "try again later", "try again in", "please try again", "and try again", "and reload", "reload the page", "reload this page", "refresh the page", "refresh this page", "is under maintenance", "undergoing maintenance", "down for maintenance", "scheduled maintenance", "be back soon", "session has expired", "session expired", "session timed out", "session has ended",
    "sign in again", "log in again", "please log in", "please sign in", "log in to continue", "sign in to continue", "login required", "must be logged in", "not a robot", "you are human", "you are a human", "complete the captcha", "checking your browser", "link is broken", "broken link", "link has expired", "was removed", "has been removed", "has been deleted", "no longer available", "no longer exists",
    "does not exist", "doesn't exist", "or has moved", "has been moved", "may have moved", "has moved permanently", "requested url", "requested page", "you requested", "you asked for", "you are looking for", "were looking for", "could not be found", "cannot be found", "can't be found", "on this server", "return to the start page", "return to the home page", "back to the home page", "back to the homepage", "go to homepage", "oops", "processing your request", "complete your request", "contact the administrator", "contact support", "null pointer exception", "stack trace", "fatal error", "database connection", "http status #", "whoops", "looks like something", "be right back", "unhandled exception", "invalid request", "invalid url", "not allowed to", "are offline", "site is down", "page is missing", "page has moved", "nothing was found", "no results found", "page isn't available", "page isn't working", "is not available", "isn't available",
    # German
    "seite nicht gefunden", "nicht gefunden", "nicht verfügbar", "prüfen sie die adresse", "überprüfen sie die adresse", "zugriff verweigert", "keine berechtigung", "interner serverfehler", "serverfehler", "fehler ist aufgetreten", "etwas ist schiefgelaufen", "versuchen sie es später", "später erneut", "erneut versuchen", "angeforderte seite", "existiert nicht", "zeitüberschreitung", "sitzung ist abgelaufen", "melden sie sich erneut an", "bitte melden sie sich an", "wartungsarbeiten", "zurück zur startseite", "fehler #",
    # French
    "est introuvable", "page introuvable", "page non trouvée", "n'existe pas", "n'existe plus", "erreur #", "accès refusé", "accès interdit", "erreur interne", "erreur du serveur", "service indisponible", "indisponible", "erreur est survenue", "erreur s'est produite", "réessayer plus tard", "veuillez réessayer", "page demandée", "session a expiré", "veuillez vous reconnecter", "veuillez vous connecter", "délai d'attente", "en maintenance", "retour à l'accueil",
    # Spanish
    "no encontrada", "no encontrado", "no existe", "vuelva al inicio", "volver al inicio", "acceso denegado", "error interno", "error del servidor", "servicio no disponible", "no disponible", "ha producido un error", "ocurrió un error", "algo salió mal", "inténtelo de nuevo", "intente de nuevo", "intente nuevamente", "más tarde", "sesión ha caducado", "sesión ha expirado", "inicie sesión", "página solicitada", "tiempo de espera", "en mantenimiento",
    # Portuguese, Italian, Dutch
    "página não encontrada", "não encontrado", "acesso negado", "erro interno", "serviço indisponível", "ocorreu um erro", "tente novamente", "sessão expirou", "pagina non trovata", "non trovata", "accesso negato", "errore interno", "servizio non disponibile", "si è verificato un errore", "riprova più tardi", "sessione scaduta", "pagina niet gevonden", "niet gevonden", "toegang geweigerd", "interne serverfout", "er is een fout opgetreden", "probeer het later opnieuw", "sessie is verlopen",
)
SCRIPT_PHRASES = (
    "enable javascript", "enable scripts", "enable scripting", "enable js", "allow javascript", "allow scripts", "activate javascript", "activate scripts", "turn on javascript", "turn on scripts", "turn javascript on", "switch on javascript", "switch javascript on", "without javascript", "without scripts", "no javascript", "needs javascript", "need javascript", "requires javascript", "require javascript", "uses javascript", "relies on javascript", "needs scripts", "needs js", "requires scripts", "requires scripting", "requires js",
    "javascript is required", "javascript required", "javascript is needed", "javascript is disabled", "javascript disabled", "javascript is off", "javascript is turned off", "javascript is switched off", "javascript is blocked", "javascript seems to be", "javascript appears to be", "javascript must be", "javascript has to be", "javascript needs to be", "javascript support", "javascript enabled", "javascript-enabled",
    "js is required", "js is disabled", "js is off", "js is switched on", "js is turned on", "js is enabled", "js must be", "scripts are required", "scripts are disabled", "scripts are blocked", "scripts are turned off", "scripts are off", "scripts must be", "scripts have to be", "scripts need to be", "scripts enabled", "scripting is disabled", "scripting must be", "scripting is required", "scripting enabled",
    "not support scripts", "not support javascript", "not support scripting", "not run scripts", "not run javascript", "allow scripting", "scripting on", "scripting off", "script support", "scripts on", "scripts off", "scripts to be on", "javascript to be", "javascript on", "javascript off", "javascript to run", "javascript to view", "javascript to use", "javascript to continue", "turn them on", "switch them on", "noscript",
    "aktivieren sie javascript", "javascript aktivieren", "javascript ist deaktiviert", "javascript ist ausgeschaltet", "javascript muss", "muss javascript", "javascript wird benötigt", "ohne javascript", "benötigt javascript", "skripte sind deaktiviert", "skripte müssen", "skripte aktivieren",
    "activer javascript", "activez javascript", "javascript est désactivé", "javascript est requis", "javascript est nécessaire", "javascript doit être", "sans javascript", "nécessite javascript", "scripts sont désactivés", "activer les scripts",
    "active javascript", "habilite javascript", "activar javascript", "habilitar javascript", "javascript está desactivado", "javascript está deshabilitado", "javascript es necesario", "sin javascript", "requiere javascript", "necesita javascript",
    "ative o javascript", "habilite o javascript", "attiva javascript", "abilita javascript", "abilitare javascript", "schakel javascript in",
)
FILLER_PHRASES = (
    "lorem ipsum", "dolor sit amet", "placeholder paragraph", "placeholder text", "placeholder copy", "this is a placeholder", "to be replaced", "will be replaced", "dummy text", "dummy copy", "sample copy", "sample text", "this is sample", "example text", "filler text", "filler copy", "greeked text", "your text here", "text goes here", "content goes here", "title goes here", "goes here", "text here", "add your text", "the quick brown fox jumps over the lazy dog",
    "blindtext", "platzhaltertext", "platzhalter", "mustertext", "beispieltext", "fülltext", "texte de remplissage", "texte fictif", "faux-texte", "faux texte", "texte d'exemple", "texto de relleno", "texto de ejemplo", "texto ficticio", "texto de muestra", "texto de exemplo", "testo segnaposto", "testo di esempio", "voorbeeldtekst",
)
INSTRUCTION_PHRASES = (
    "click here to", "click or tap here", "click or tap to", "to enter text", "to add text", "enter text", "delete this instruction", "remove this instruction", "delete this text", "delete this line", "delete this paragraph", "replace this paragraph", "replace this text", "replace this sentence", "replace this line", "replace with", "overwrite this", "write your text", "type your text", "and type your", "type your", "type here", "write here", "enter here", "insert text", "insert here", "insert title", "describe here", "add text here", "to be completed", "to be filled in", "to be written", "to be added", "to be supplied", "to be determined", "before release", "before publication", "before publishing",
    "hier text eingeben", "text eingeben", "hier klicken", "klicken sie hier", "hier ausfüllen", "bitte ausfüllen", "noch auszufüllen", "cliquez ici", "saisir du texte", "saisissez", "à compléter", "à remplir", "haga clic aquí", "escriba aquí", "introduzca", "por completar", "a completar", "clique aqui", "fare clic qui",
)
# fixed values: words with which pages and templates address their reader; they
# count beside a phrase only
PAGE_WORDS = frozenset(
    (
        # English
        "a", "access", "account", "administrator", "all", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "below", "blank", "browser", "button", "by", "can", "cannot", "check", "click", "code", "connection", "contact", "content", "continue", "cookies", "could", "data", "device", "did", "disabled", "display", "displayed", "do", "does", "enabled", "enter", "error", "expired", "feature", "features", "few", "file", "for", "from", "full", "function", "functions", "go", "has", "have", "help", "hidden", "home", "http", "https", "id", "if", "in", "instruction", "internet", "is", "it", "its", "job", "later", "link", "load", "loading", "log", "login", "may", "minutes", "moment", "moved", "must", "network", "no", "not", "number", "of", "off", "on", "or", "our", "page", "paragraph", "part", "parts", "please", "portal", "press", "problem", "properly", "prove", "ref", "reference", "reload", "report", "request", "requested", "resource", "return", "run", "seconds", "see", "server", "service", "settings", "show", "shown", "sign", "site", "so", "some", "sorry", "start", "status", "stay", "support", "supported", "table", "team", "text", "that", "the", "them", "then", "there", "this", "title", "to", "try", "turn", "type", "under", "until", "upstream", "url", "us", "use", "user", "using", "via", "view", "viewer", "wait", "was", "we", "website", "were", "while", "will", "with", "work", "you", "your",
        # German
        "aktivieren", "auf", "aus", "bericht", "bitte", "browser", "das", "dem", "den", "der", "die", "diese", "diesem", "diesen", "dieser", "ein", "eine", "einen", "es", "für", "hier", "ihr", "ihre", "ihrem", "im", "in", "ist", "nicht", "oder", "seite", "sehen", "sie", "um", "und", "von", "wird", "wurde", "zu", "zum", "anzuzeigen", "später", "server", "steht",
        # French
        "afficher", "ce", "ceci", "cette", "dans", "de", "des", "du", "en", "est", "et", "ici", "la", "le", "les", "navigateur", "ou", "page", "plus", "pour", "rapport", "serveur", "site", "sur", "un", "une", "veuillez", "voir", "votre", "vous",
        # Spanish, Portuguese, Italian, Dutch
        "al", "con", "del", "el", "en", "es", "este", "esta", "informe", "la", "las", "lo", "los", "navegador", "o", "página", "para", "por", "que", "se", "servidor", "si", "sitio", "su", "un", "una", "usar", "ver", "y", "ao", "da", "do", "em", "navegador", "seu", "sua", "um", "uma", "browser", "di", "il", "per", "questa", "questo", "tuo", "de", "deze", "een", "het", "om", "te", "uw", "van", "voor",
    )
)
# fixed values: words and stems of the usual filler Latin
FILLER_STEMS = (
    "lorem", "ipsum", "dolor", "amet", "consect", "adipis", "elit", "eiusm", "tempor", "tempora", "incidid", "labor", "magn", "aliqu", "veniam", "nostru", "exercit", "ullamc", "nisi", "commod", "consequ", "aute", "irure", "repreh", "volupt", "velit", "esse", "cillum", "fugia", "nulla", "pariat", "except", "sint", "occaec", "cupidat", "proide", "sunt", "culpa", "officia", "deserun", "mollit", "anim", "lacin", "porta", "quaesta", "justum", "justo", "pellat", "pellent", "eratum", "vanet", "molum", "molest", "augus", "ornat", "veneat", "venenat", "curat", "curabit", "irum", "ligul", "ferment", "fermin", "vitam", "vitae", "congu", "phasel", "vestil", "vestibul", "semper", "nullam", "nibh", "tincid", "maecil", "maecen", "sodal",
)
#: share of a unit that phrases must cover
UNIT_SHARE = 0.45
#: share of a unit that phrases and page words together must cover
PAGE_SHARE = 0.72
#: the same where a unit starts with a phrase and holds neither numbers nor words that qualify
START_SHARE = 0.5
NARRATIVE = frozenset(("after", "although", "but", "during", "except", "however", "only", "since", "though", "when", "whereas", "which", "whose", "aber", "nachdem", "nur", "obwohl", "während", "après", "mais", "pendant", "seulement", "aunque", "después", "durante", "pero", "solo", "sólo"))
#: share of the words of a unit that must be filler Latin, and their least number
LATIN_SHARE, LATIN_WORDS = 0.6, 3

_NAME = r"[^\W\d_](?:[\w.\-]|\s(?=\w)){0,60}"
# notations of numbers, directions and lattice planes that stand in the same brackets
_NOT_NAME = r"(?!(?:[hkliuvwt0-9]{1,4}|[a-z])\s*[}>])"
_TAGS = "a abbr b blockquote body br button code dd div dl dt em footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input li link main meta nav noscript ol option p pre q s script section select small span strong style sub sup table tbody td textarea tfoot th thead title tr u ul video".split()
# fixed values: notations of slots
SLOTS = re.compile(
    "|".join(
        (
            # notations of templates only: whatever stands between the marks
            r"(?<![\w\\^{}])\{\{[^{}]*[^\W\d_][^{}]*\}\}(?!\})",
            r"\{%[^%{}]*[^\W\d_][^%{}]*%\}",
            r"<%[^%<>]*[^\W\d_][^%<>]*%>",
            r"\{\?\s*" + _NAME + r"\s*\?\}",
            r"[$#]\{\s*" + _NAME + r"\s*\}",
            r"\$\(\s*" + _NAME + r"\s*\)",
            r"(?<![\w\\^}$#{%])\{" + _NOT_NAME + _NAME + r"\}(?!\})",
            r"<!--\s*" + _NAME + r"\s+goes\s+here\s*-->",
            r"<(?:your|insert|enter|add)\s+" + _NAME + r">",
            r"<" + _NOT_NAME + r"(?!(?:" + "|".join(_TAGS) + r")\s*>)" + _NAME + r">",
            r"\[\[\s*[^\W\d_][^\[\]]*\]\]",
            r"\[\s*(?:insert|your|enter|add|write|describe|todo:|tbd:|type)[\s,:][^\[\]]+\]",
            r"\[\s*" + _NAME + r"\s+here\s*\]",
            r"\[\s*(?:fill\s+in|to\s+be\s+(?:filled|completed|added)[^\[\]\n]{0,40}|tbd|todo|à compléter|ausfüllen|completar)\s*\]",
            r"@@\s*" + _NAME + r"\s*@@",
            r"%%\s*" + _NAME + r"\s*%%",
            r"(?-i:(?<![\w%$#])([%$#])[A-Z][A-Z_]{2,}\1(?![\w%$#]))",
            r"%\(\s*" + _NAME + r"\s*\)[sdfr]\b",
            r"(?<!\w)__" + _NAME + r"(?<!_)__(?!\w)",
            r"«(?=\w)" + _NAME + r"»",
            r"\bxxx\s+" + _NAME + r"\s+xxx\b",
            r"\(\s*(?:enter|insert|type)\s+" + _NAME + r"\s*\)",
            r"\(\s*to\s+be\s+(?:filled\s+in|completed|added)\s*\)",
            r"(?<!_)_{4,}(?!_)",
            r"(?m:^[\s\-*>]*(?:todo|tbd|fixme)\s*[:\-–])",
        )
    ),
    re.IGNORECASE,
)
#: a text without any of these has no slot
_SLOT_MARKS = re.compile(r"[{<\[«%$#]|@@|__|xxx|\(\s*(?:enter|insert|type|to)\b|todo|tbd|fixme", re.IGNORECASE)
_TAG = r"</?(?:" + "|".join(_TAGS) + r")\b[^<>]*>"
_UNITS = re.compile(_TAG + r"|(?<=[.!?])\s+|[\r\n]+", re.IGNORECASE)
_UNITS_ACROSS_LINES = re.compile(_TAG + r"|(?<=[.!?])\s+", re.IGNORECASE)
_LEAD = re.compile(r"^[\s\-*>•|]+")
_NUMBER = re.compile(r"\d+")
#: marks of emphasis, and characters without width, that may stand anywhere in a message
_MARKS = re.compile(r"[*`~\u00ad\u200b-\u200d\u2060\ufeff]+")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+|#")
_KINDS = ("error", "script", "filler", "instruction")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, phrases in zip(_KINDS, (ERROR_PHRASES, SCRIPT_PHRASES, FILLER_PHRASES, INSTRUCTION_PHRASES)):
        for phrase in phrases:
            automaton.add_word(phrase, (kind, len(phrase)))
    for stem in FILLER_STEMS:
        if stem not in automaton:
            automaton.add_word(stem, ("latin", len(stem)))
    automaton.make_automaton()
    return automaton


def _plain(text: str) -> str:
    """``text`` as phrases are written: lower case, single blanks, no marks, ``#`` for numbers."""
    return _NUMBER.sub("#", " ".join(_MARKS.sub("", text).lower().replace("’", "'").split()))


def _spans(unit: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of phrases in a normalised unit, and their kinds."""
    spans, kinds = [], set()
    for end, (kind, length) in _automaton().iter(unit):
        if kind == "latin":
            continue
        start = end - length + 1
        if (start == 0 or not unit[start - 1].isalnum()) and (end + 1 == len(unit) or not unit[end + 1].isalnum()):
            spans.append((start, end + 1))
            kinds.add(kind)
    return spans, kinds


def _length(spans: list[tuple[int, int]]) -> int:
    covered, reach = 0, 0
    for start, end in sorted(spans):
        covered += max(0, end - max(start, reach))
        reach = max(reach, end)
    return covered


def _is_message(unit: str, spans: list[tuple[int, int]]) -> bool:
    """Whether phrases make up enough of a unit, alone or with page words beside them."""
    whole = len(unit.strip(" .!?:;"))
    if _length(spans) >= UNIT_SHARE * whole:
        return True
    words = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(unit)]
    beside = [(a, b) for a, b, w in words if w in PAGE_WORDS or w == "#"]
    letters = sum(b - a for a, b, _ in words)
    inside = [(max(a, c), min(b, d)) for a, b, _ in words for c, d in spans if max(a, c) < min(b, d)]
    # a message starts with what it has to say, counts nothing and qualifies nothing
    plain = "#" not in unit and not any(w in NARRATIVE for _, _, w in words)
    least = START_SHARE if min(spans)[0] == 0 and plain else PAGE_SHARE
    return _length(beside + inside) >= least * letters


def _unit_kinds(unit: str) -> set[str]:
    text = _plain(_LEAD.sub("", unit))
    if not text:
        return set()
    spans, kinds = _spans(text)
    found = kinds if spans and _is_message(text, spans) else set()
    words = _WORD.findall(text)
    if len(words) >= LATIN_WORDS and sum(w.startswith(FILLER_STEMS) for w in words) >= LATIN_SHARE * len(words):
        found = found | {"filler"}
    return found


def residue_of(text: str) -> tuple[list[str], float]:
    """Kinds of residue in a text (sorted) and the share of its characters in units that hold some."""
    flat = _plain(text)
    slots = _SLOT_MARKS.search(text) is not None and SLOTS.search(text) is not None
    phrases, latin = False, 0
    for _, (kind, _) in _automaton().iter(flat):
        latin += kind == "latin"
        phrases = phrases or kind != "latin"
    # units need a phrase, a slot or filler words, so most texts end here
    if not (slots or phrases or latin >= LATIN_WORDS):
        return [], 0.0
    kinds: set[str] = set()
    touched = 0
    for unit in _UNITS.split(text):
        found = _unit_kinds(unit)
        if slots and SLOTS.search(unit):
            found = found | {"slot"}
        if found:
            kinds |= found
            touched += len(unit)
    if not kinds:
        # a message may be broken over lines, as may a slot
        for unit in _UNITS_ACROSS_LINES.split(text):
            found = _unit_kinds(unit)
            if found:
                kinds |= found
                touched += len(unit)
        if slots:
            kinds.add("slot")
            touched += sum(len(m.group()) for m in SLOTS.finditer(text))
    return sorted(kinds), min(1.0, touched / max(1, len(text.strip())))


def _batches(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for frame in frames:
        found = [residue_of(t) for t in frame["text"]]
        out = pd.DataFrame({"doc": frame["doc"], "kinds": [k for k, _ in found], "coverage": [c for _, c in found]})
        yield out[out["kinds"].map(len) > 0]


def find_residue(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold residue: ``doc_id``, ``kinds`` and ``coverage``.

    ``kinds`` is a sorted list out of error, filler, instruction, script and slot;
    ``coverage`` is the share of the document that its residue makes up. Rows with
    a null id or text don't count; empty texts have no residue; a repeated row is
    reported again. Other columns are ignored. An empty table gives an empty
    result. One pass without any exchange; texts are read whole.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("doc"), docs[text].alias("text")).filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    found = rows.mapInPandas(_batches, f"doc {kind}, kinds array<string>, coverage double")
    return found.select(F.col("doc").alias(doc_id), "kinds", "coverage")


def without_residue(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: float = 0.0) -> DataFrame:
    """``docs`` without the documents whose residue covers more than ``most`` of them.

    Rows with a null id or text stay.
    """
    bad = find_residue(docs, doc_id=doc_id, text=text).filter(F.col("coverage") > most).select(F.col(doc_id).alias("__bad")).distinct()
    return docs.join(bad, docs[doc_id] == F.col("__bad"), "left_anti")


__all__: Sequence[str] = ("find_residue", "residue_of", "without_residue")
