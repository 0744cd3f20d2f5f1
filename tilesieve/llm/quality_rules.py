"""Quality rules, line first.

Every line is judged by itself: a line fails for its punctuation (three symbols
or runs of exclamation marks and more, and more than one to ten words, or thirty
words and more without any sentence mark of the world's scripts), as navigation (three separators and more, with three
words at most between two of them, or nothing but navigation words) or as
boilerplate (one of a list of phrases). Failed lines are taken out, and a
document that loses more than the given share of its word characters is
rejected, as is one that fails the base limits on its words.

A whole text is scanned once, as UTF-8 bytes; memory is bounded by the text.

Edge cases: null and empty texts have no words, fail the base and are rejected;
repeated rows are judged each by itself, ties cannot arise; an empty table gives
no rows; extra columns pass through ``clean`` untouched and are ignored by
``judge``; very long texts are judged whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tilesieve.llm.common import keyed_text, map_rows

SYMBOLS = b"#*$%&|<>"
#: Words of menus, and phrases of page frames, in English, French, German and Spanish.
NAVIGATION_WORDS = (
    "home menu login logout register search contact about sitemap next previous back top more share print help faq skip to content main navigation "
    "accueil connexion déconnexion inscription recherche rechercher panier plan du site suivant précédent retour haut imprimer partager aide "
    "startseite anmelden abmelden registrieren suche suchen kontakt impressum warenkorb weiter zurück oben drucken teilen hilfe "
    "inicio entrar salir registrarse buscar contacto carrito mapa del sitio siguiente anterior volver arriba imprimir compartir ayuda"
)
BOILERPLATE = (
    "all rights reserved",
    "tous droits réservés",
    "alle rechte vorbehalten",
    "todos los derechos reservados",
    "politique de confidentialité",
    "conditions d'utilisation",
    "accepter les cookies",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "política de privacidad",
    "condiciones de uso",
    "aceptar cookies",
    "accept cookies",
    "cookie policy",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
#: The same line rules as patterns, for a word, a separator, a sentence mark and a run of exclamation marks.
SEPARATOR = "\\||»|›|•"
SENTENCE_MARK = "[.?!:;…。！？।॥؟۔։።]"
SHOUT = "!!+"

_separator = re.compile(SEPARATOR.encode())
_mark = re.compile("[.?!:;]|…|。|！|？|।|॥|؟|۔|։|።".encode())
_shout = re.compile(SHOUT.encode())
_boilerplate = re.compile("|".join(BOILERPLATE).encode())
_navigation = frozenset(NAVIGATION_WORDS.encode().split())


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 30


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words breaks, if any."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    bars = len(_separator.findall(line))
    if bars >= 3 and n - bars <= 3 * (bars + 1):
        return "navigation"
    shouts = len(_shout.findall(line))
    if max(symbols, shouts) >= 3 and 10 * max(symbols, shouts) > n:
        return "punctuation"
    if n >= 30 and not _mark.search(line):
        return "punctuation"
    low = line.lower()
    if n <= 8 and _navigation.issuperset(low.split()):
        return "navigation"
    if _boilerplate.search(low):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, often = set(), set()
    for w in windows:
        (often if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def measure(text: str, limits: Limits = Limits()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, lines lost."""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    with_words, stay, lost_lines, lost = [], [], 0, 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            with_words.append(line)
            if line_fails(line, own):
                lost_lines += 1
                lost += sum(len(w.decode("utf-8")) for w in own)
                continue
        stay.append(line)
    n_dup = len(with_words) - len(set(with_words))
    n_repeat = repeated_words(words)
    base_failed = n < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n
    kept = not base_failed and 100 * lost <= limits.max_lost_percent * word_chars
    cleaned = b"\n".join(stay).decode("utf-8") if lost_lines else text
    return n, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, cleaned, lost_lines


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: the counts, the verdicts, and how many lines fail."""

    def start():
        def step(ids, texts):
            rows = [measure(t, limits) for t in texts]
            return [ids, *(list(c) for c in zip(*(r[:7] for r in rows))), [r[8] for r in rows]]

        return step

    schema = "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_failed_lines bigint"
    return map_rows(keyed_text(docs, id_col, text_col), schema, start).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", limits: Limits = Limits()) -> DataFrame:
    """The rows that stay, all columns kept, failed lines taken out of their texts.

    ``length_col``, where the input has it, is set anew for the texts that changed.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            rows = [measure(t or "", limits) for t in texts]
            stay = [i for i, r in enumerate(rows) if r[6]]
            if stay:
                columns = [c.take(pa.array(stay, pa.int64())) for c in batch.columns]
                columns[at] = pa.array([rows[i][7] for i in stay], batch.schema.field(at).type)
                if n_at is not None:
                    old = columns[n_at].to_pylist()
                    columns[n_at] = pa.array([len(rows[i][7]) if rows[i][8] else o for i, o in zip(stay, old)], batch.schema.field(n_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
