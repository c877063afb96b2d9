"""Operator: template residue and error-page text.

Character trigram models are fitted of filler, of error notices and of unfilled placeholders, on the samples below, and of
natural prose, on the whole corpus. Each sentence is scored by windows of the log-likelihood ratio of a residue model
and the natural one; windows above a threshold localise residue, and a sentence is residue where they cover at least half of
it. Placeholders stand inside natural sentences, so that one window of the outline, in which each word is one letter, is
enough for them. What is fenced or quoted is mentioned, not used, and is taken out first.

The natural model is fitted in rounds: a sentence that the models of the last round call residue is no longer counted, and
of a text's copies one counts, so that residue can't make itself natural by its number.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.runtime import stored

#: Samples of residue that the models are fitted on, and of prose that speaks of such things, which the natural model learns beside the corpus.
SAMPLES = {
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "Tempor magna elit quis dolor enim amet labore sed nostrud adipiscing veniam aliqua ipsum consectetur eiusmod incididunt lorem sit.",
        "Text goes here. Description goes here. Title goes here. Content goes here. Placeholder text, replace before release. Your text here. Add a description here. Insert content here.",
    ],
    "notice": [
        "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "429 Too Many Requests", "401 Unauthorized", "Error 404", "HTTP Error 503",
        "Internal Server Error", "Bad Gateway", "Service Temporarily Unavailable", "<html><head><title>503 Service Temporarily Unavailable</title></head><body><center>server</center></body></html>",
        "<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1><hr><center>nginx/1.18</center></body></html>", "Please enable JavaScript to view this page.", "Please enable JavaScript and cookies to continue.",
        "You need to enable JavaScript to run this app.", "You need to turn on scripts and cookies to continue to the site.", "This site requires a browser with scripts enabled; your browser has them switched off.",
        "JavaScript is disabled in your browser.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Veuillez activer JavaScript pour continuer.", "Por favor, active JavaScript para continuar.", "Seite nicht gefunden",
        "Die angeforderte Seite existiert nicht (Fehler 404).", "Die angeforderte Datei existiert nicht.", "Página no encontrada. El enlace ya no existe.", "Page introuvable. Erreur 404.",
        "Erreur 503 : service momentanément indisponible. Réessayez dans 5 minutes.", "The requested URL was not found on this server.", "The requested path was not found on this server.",
        "The page you are looking for could not be found.", "This page could not be loaded. Reload this page afterwards.", "The server met a problem and could not complete your request.",
        "The server encountered an internal error and was unable to complete your request.", "Access denied. You do not have permission to view this page. Sign in or contact the owner.",
        "Session expired. Log in again to see the page.", "Your session has expired. Please sign in again.", "Checking your browser before accessing the site. Ray ID 4f3a9c", "Checking your connection before showing the page...",
        '{"error": {"code": 429, "message": "rate limit exceeded", "retry_after": 30}}', '{"error": "not found", "status": 404}', "Please enable JavaScript to view the project browser.",
        "You need to turn on scripts and cookies to continue to the project dashboard.", "Please turn on cookies and reload.", "Cookies are disabled in your browser.",
        "Checking your connection before showing the page... Ray 36b73a39d3ee", "Checking if the site connection is secure. Ray ID: 1e19cfde854c", "Verify you are human by completing the action below.",
        "Just a moment... Security check", "Try again later. (request 1e19cfde854c)", "Please try again later.", "Reload this page afterwards.", "This project page could not be loaded. Try again later.",
        "This content is not available.", "The requested file does not exist.", "You do not have permission to view this project.", "Please sign in to continue.", "Your browser is not supported. Please update it.",
        "Your request has been blocked.", "Too many requests. Slow down and retry.", "Esta página requiere JavaScript.", "Acceso denegado. No tiene permiso para ver esta página.",
        "Accès refusé. Vous n'avez pas l'autorisation de voir cette page.", "Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Sitzung abgelaufen. Bitte melden Sie sich erneut an.",
        "Su sesión ha caducado. Inicie sesión de nuevo.", "Votre session a expiré. Veuillez vous reconnecter.", "La page demandée n'existe pas.", "Le fichier demandé n'existe pas (erreur 404).",
        "El archivo solicitado no existe (error 404).", "El enlace a la página ya no existe.", "Error 503: servicio no disponible temporalmente. Inténtelo de nuevo en 5 minutos.",
        "Fehler 503: Dienst vorübergehend nicht verfügbar. Versuchen Sie es in 5 Minuten erneut.", "Error 503: service temporarily unavailable. Try again in 5 minutes.",
    ],
    "placeholder": [
        "{{ project_name }} {{name}} {{ title }} {{cookiecutter.project_slug}} {{ user.first_name }}", "<% page.title %> <%= name %> {% block content %}{% endblock %} {% include header %}",
        "<INSERT NAME HERE> <INSERT TITLE HERE> <your-project-name> <your-name> <YOUR NAME>", "[Your name here] [Your company here] [TODO: describe the change] [Insert title here] [Company Name] [Add text here]",
        "%%NAME%% %%TITLE%% @@project_owner@@ @@version@@ __PROJECT_TITLE__ __NAME__ ${PROJECT_NAME} ${AUTHOR} {name} {title} {user} {author} {project} {version}",
        "Dear {name}, this {product} contains the following changes: {changes}", "# {title}", "Maintainer: %%OWNER%%", "Signed-off: [Your name here]", "{author}: {subject}", "[Your name here]", "[Your title here]", "[Insert address here]", "[Enter text here]", "[TODO: describe the project]", "## [Your project here]", "Run the ${TOOL_NAME} installer.",
    ],
    "natural": [
        "Fix the 502 Bad Gateway seen when the proxy restarts: it now waits for the worker.", "The server now answers 404 Not Found instead of 500 when the object is gone, so clients stop retrying.", "The linter rejects lorem ipsum text in a page and names the file that holds it.",
        "Set Q in the shell before you start the service.", "Templates may contain Q; the renderer fills it from the config before publishing.", "Show Q only if the widget cannot load.", "The banner asks the reader to enable JavaScript, which confuses people whose browser has it enabled.",
        "We log a warning when access is denied and return 403 Forbidden to the caller.", "Users reported that the session expired message appears too early, because the clock of the server is wrong.", "Add a page that explains what to do when the requested file was not found.",
        "Retry with backoff when the upstream returns 503 Service Unavailable or 429 Too Many Requests.", "This change lets you enable scripts for each project in the settings.", "The text of the title goes into the header of the page, and the description goes below it.",
        "Please read the notes before you run the installer, because the server must be stopped first.", "You need to sign in once before you can continue with the setup.", "After the update the page loads in half the time and the browser keeps its cookies.",
        "Every template is checked for missing names when the project is built.", "The name field, the title field and the body field are required.", "This library provides a small set of functions to read, check and write records.", "See the documentation for a description of all options and their defaults.",
        "Der Server antwortet jetzt mit 404, wenn die Datei nicht mehr existiert.", "Wenn die Seite nicht gefunden wird, zeigt der Browser einen Hinweis.", "Le serveur renvoie maintenant une erreur 404 quand la page n'existe plus.", "El servidor responde ahora con un error 404 cuando la página ya no existe.",
        "The user opens the view, selects a file and presses the button; the request is sent to the server and the answer is shown.", "It was one of the most important changes of the last year, and there are still many people who have not heard of it.", "In this section we look at how the data is stored and what that means for those who want to query it.",
    ],
}
#: Times that each natural sample counts, beside the corpus.
WEIGHT = 20
#: Hash buckets of trigrams.
BUCKETS = 1 << 16
#: Rounds in which the natural model is fitted.
ROUNDS = 3
#: Share of a sentence that windows of a residue model must cover.
LEAST = 0.5
#: Characters of a sentence: a longer line is several sentences. Characters that are scored in one go.
SENTENCE, GO = 100_000, 1_000_000


@dataclass(frozen=True)
class View:
    """A residue model: its kind, whether it sees outlines, trigrams of a window, the mean log ratio from which a window is
    residue, and the sum from which a sentence shorter than a window is."""

    kind: str
    outline: bool
    window: int
    least: float
    short: float


VIEWS = (View("filler", False, 24, 1.0, 16.0), View("notice", False, 12, 0.6, 12.0), View("placeholder", True, 3, 2.45, 7.35))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _buckets(x: np.ndarray) -> np.ndarray:
    """Bucket of each trigram of code points; runs of digits weigh as one digit."""
    if len(x) < 3:
        return np.empty(0, np.uint32)
    x = np.where((x >= 48) & (x <= 57), np.uint32(48), x)
    with np.errstate(over="ignore"):
        h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        return h * np.uint32(0x2C1B3C6D) >> np.uint32(16)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points of the basic plane are letters, and which of them capitals."""
    chars = [chr(i) for i in range(0x10000)]
    return np.array([c.isalpha() for c in chars]), np.array([c.isupper() for c in chars])


def _outline(x: np.ndarray) -> np.ndarray:
    """The text with each run of letters, underscores inside it included, as one letter: A if it begins with a capital, else a."""
    alpha, capital = _letters()
    low = np.where(x < 0x10000, x, 0)
    letter = alpha[low]
    inner = np.zeros(len(x), bool)
    inner[1:-1] = (x[1:-1] == 95) & letter[:-2] & letter[2:]
    letter = letter | inner
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    return np.where(letter, np.where(capital[low], np.uint32(65), np.uint32(97)), x)[begins | ~letter]


_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_QUOTED = re.compile(r"``[^`]+``|`[^`\n]*`|\"[^\"\n]{3,}\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def |class |import |from \w+ import|#include|package |func |fn |pub |use |return\b|const |let |var |if .*:$|for .*:$|[+-]\s{2,})|^(?:---|\+\+\+|@@) ")
_SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")


def used(text: str) -> str:
    """The text without what it only mentions: fenced blocks, and quotes outside a line that is a record of its own."""
    text = _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", " "))
    return "\n".join(line if line.lstrip().startswith('{"') else _QUOTED.sub(" Q ", line) for line in text.split("\n"))


def is_code(lines: list[str]) -> bool:
    """Two in five lines end or begin as program or diff lines do."""
    return len(lines) > 2 and sum(bool(_CODE_LINE.search(line)) for line in lines) >= 0.4 * len(lines)


def sentences(plain: str) -> list[str]:
    return [s[i : i + SENTENCE] for x in _SENTENCE.split(plain) if (s := x.strip(" \t\r.!?…")) for i in range(0, len(s), SENTENCE)]


#: Words that ask for something to be filled in; an outline shows them as one mark of their own (fixed values).
_ASKS = re.compile(r"(?i)(?<![^\W_])(?:your|insert|enter|todo|fixme|tbd|fill)(?![^\W_])")


def _asked(text: str) -> str:
    """The text with one mark for each word of _ASKS. Most sentences have none, which is seen faster without the expression."""
    low = text.lower()
    if text.isascii() and not ("your" in low or "insert" in low or "enter" in low or "todo" in low or "fixme" in low or "tbd" in low or "fill" in low):
        return text
    return _ASKS.sub("¥", text)


#: Zeros between two sentences that are laid end to end: no window reaches over them.
_GAP = "\0" * (max(v.window for v in VIEWS) + 2)


@dataclass
class Laid:
    """Sentences laid end to end, as seen by one kind of view: bucket of each trigram (BUCKETS outside of sentences), begin and end of each sentence's trigrams."""

    buckets: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def lay(parts: list[str], outline: bool) -> Laid:
    x = _codes("".join(f"\n{_asked(p) if outline else p.lower()}\n{_GAP}" for p in parts))
    if outline:
        x = _outline(x)
    void = x == 0
    begin = np.flatnonzero(np.concatenate([[True], void[:-1]]) & ~void) if len(x) else np.empty(0, np.int64)
    stop = np.flatnonzero(~void & np.concatenate([void[1:], [True]])) if len(x) else np.empty(0, np.int64)
    buckets = _buckets(x)
    buckets[void[:-2] | void[1:-1] | void[2:]] = BUCKETS
    return Laid(buckets, begin, np.maximum(stop - 1, begin))


def covered(at: Laid, ratio: np.ndarray, v: View) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams under residue windows, trigrams) of each sentence."""
    size = at.end - at.begin
    total = np.concatenate([[0.0], np.cumsum(np.append(ratio, -1e4)[at.buckets])])
    n = np.zeros(len(size), np.int64)
    if len(at.buckets) >= v.window:
        over = np.flatnonzero(total[v.window :] - total[: -v.window] > v.least * v.window)
        # of windows that overlap each adds what the one before leaves; none reaches over a gap
        np.add.at(n, np.searchsorted(at.begin, over, "right") - 1, np.minimum(np.diff(over, prepend=-v.window), v.window))
    short = size < v.window
    return np.where(short, np.where(total[at.end] - total[at.begin] > v.short, size, 0), n), size


def count(parts: list[str], outline: bool, weight: list[int] | None = None) -> np.ndarray:
    """Trigrams of the sentences in each bucket, each as often as its sentence weighs."""
    at = lay(parts, outline)
    real = at.buckets[at.buckets < BUCKETS]
    return np.bincount(real, None if weight is None else np.repeat(weight, at.end - at.begin), BUCKETS).astype(np.int64)


@functools.cache
def _samples() -> tuple[np.ndarray, np.ndarray]:
    """Counts of the residue samples (view, bucket) and of the natural ones (without and with outlines, bucket)."""
    parts = {k: [p for t in ts for p in sentences(t)] for k, ts in SAMPLES.items()}
    return np.array([count(parts[v.kind], v.outline) for v in VIEWS]), WEIGHT * np.array([count(parts["natural"], o) for o in (False, True)])


def model(natural: np.ndarray) -> np.ndarray:
    """Log ratios (view, bucket) of the residue samples and the natural counts (seen without and with outlines, bucket).

    A trigram that the samples lack never speaks for residue, however rare it is in the corpus.
    """
    r, base = _samples()
    n = (natural + base)[[int(v.outline) for v in VIEWS]]
    total = np.maximum(n.sum(1, keepdims=True), 1.0)
    floor = np.maximum(1.0, total / 1e6)
    ratio = np.clip(np.log((r + 0.05) / (r.sum(1, keepdims=True) + 0.05 * BUCKETS)) - np.log((n + floor) / (total + floor * BUCKETS)), -4, 4)
    return np.where(r > 0, ratio, np.minimum(ratio, -0.5)).astype(np.float32)


def score_sentences(parts: list[str], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams under residue windows (view, sentence), trigrams (view, sentence))."""
    laid = {o: lay(parts, o) for o in {v.outline for v in VIEWS}}
    n = [covered(laid[v.outline], r, v) for v, r in zip(VIEWS, ratio)]
    return np.array([x for x, _ in n]), np.array([x for _, x in n])


def score(texts: list[str], ratio: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """Batches of (number of texts, owner of each sentence, sentences, and their scores). A text is never split between batches."""
    held, owner, parts, size = 0, [], [], 0
    for i, t in enumerate(texts):
        own = sentences(used(t))
        owner += [held] * len(own)
        held += 1
        parts += own
        size += sum(map(len, own))
        if size >= GO or i == len(texts) - 1:
            yield held, np.array(owner, np.int64), parts, *score_sentences(parts, ratio)
            held, owner, parts, size = 0, [], [], 0


def residue_sentences(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(view, sentence): whether the sentence is residue of that kind."""
    share = n / np.maximum(size, 1)
    return np.array([x > 0 if v.outline else x >= LEAST for v, x in zip(VIEWS, share)])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = Counter(p for t in b.column("text").to_pylist() for p in dict.fromkeys(sentences(used(t))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["sentence", "n"])


def _count(batches: Iterator[pa.RecordBatch], ratio: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Trigrams of the sentences that ratio calls residue, or of all."""
    n = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 2_000):
            part = b.slice(at, 2_000)
            parts, weight = part.column("sentence").to_pylist(), part.column("weight").to_pylist()
            if ratio is not None:
                bad = np.flatnonzero(residue_sentences(*score_sentences(parts, ratio)).any(0)).tolist()
                parts, weight = [parts[i] for i in bad], [weight[i] for i in bad]
            if parts:
                for k in (0, 1):
                    n[k] += count(parts, bool(k), weight)
    flat = n.reshape(-1)
    hit = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(flat[hit], pa.int64())], names=["bucket", "n"])


def fit(docs: DataFrame) -> np.ndarray:
    """The models, the natural one fitted on the different sentences of all different texts of docs (text).

    A text's copies weigh as one wherever they lie; a sentence of n different texts weighs 1 + log2(n), rounded down. The
    sentences are stored once in the shared folder while the rounds read them. The first round counts all of them, each later
    one those that the models of the last round call residue, which are then taken off; a round sends at most 2 * BUCKETS
    counts to the driver.
    """
    spark = docs.sparkSession
    every = docs.select("text").distinct().mapInArrow(_split, "sentence string, n long").groupBy("sentence").agg(F.length(F.bin(F.sum("n"))).alias("weight"))
    with stored(spark, every, "sentences") as kept:

        def counts(ratio: np.ndarray | None) -> np.ndarray:
            out = np.zeros(2 * BUCKETS)
            for r in kept.mapInArrow(functools.partial(_count, ratio=ratio), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
                out[r["bucket"]] = r["n"]
            return out.reshape(2, BUCKETS)

        whole = counts(None)
        ratio = model(whole)
        for _ in range(ROUNDS - 1):
            ratio = model(whole - counts(ratio))
    return ratio


def _residue(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_ids, texts, done = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), 0
        ids, why, cover = [], [], []
        for held, owner, parts, n, size in score(texts, ratio):
            bad = residue_sentences(n, size)
            n = n * bad
            for i in np.unique(owner[bad.any(0)]).tolist():
                a, z = np.searchsorted(owner, [i, i + 1])
                of = n[:, a:z].sum(1) / np.maximum(size[:, a:z].sum(1), 1)
                # among lines of a program a placeholder is a variable
                if not is_code([p for p, b in zip(parts[a:z], bad[:, a:z].any(0)) if not b]):
                    ids.append(all_ids[done + i])
                    why.append(VIEWS[int(of.argmax())].kind)
                    cover.append(round(float(of.max()), 4))
            done += held
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(why, pa.string()), pa.array(cover, pa.float64())], names=["doc_id", "reason", "coverage"])


def find_residue(docs: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """(doc_id, reason, coverage) of the texts of docs (doc_id, text) that are residue in whole or in part.

    A text is residue if a sentence of it is: one that windows of the filler or notice model cover by half or more, or one
    with a window of the placeholder model; texts that are program code are left out. coverage is the share of the text under the windows of its residue
    sentences, reason the kind that covers most; least_coverage leaves out texts of which less is covered. Null, empty and
    blank texts have no residue. Repeated rows give one row. Texts are shuffled once to find the different ones, and their
    sentences once, for the natural model; the verdicts shuffle none.
    """
    texts = docs.where("text IS NOT NULL AND trim(text) <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("text").where("text IS NOT NULL")))
    return texts.mapInArrow(lambda it: _residue(it, shared.value), "doc_id long, reason string, coverage double").where(F.col("coverage") >= least_coverage).distinct()
