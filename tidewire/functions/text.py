"""Text normal forms, cleaning rules and text predicates.

Patterns name their classes in full, as `\\w` and `\\s` mean ASCII in Java and Unicode in the rules that are followed here.
A null is taken as an empty text, which is what the rules do with missing values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode has them.
WS = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
NOT_WS = r"[^\x09-\x0D\x1C-\x20\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x85\p{Z}]"

#: Boilerplate that is cut out wherever it stands, in this order.
BOILERPLATE = [
    r"\d+ vez(es)? compartido",
    r"Iniciar sesión",
    r"Me gusta",
    r"Comentar",
    r"Compartir",
    r"\d+ comentarios?",
    r"Más pertinentes",
    r"Autor",
    r"@seguidores",
    r"Seguir",
    r"Más populares",
    r"Publicación de",
    r"Buscar",
    r"Contraseña",
    r"Crear una cuenta",
    r"Registrarse",
    r"Recuperación de contraseña",
    r"Recupera tu contraseña",
    r"tu correo electrónico",
    r"Portada",
    r"Política",
    r"Nacional",
    r"Mundo",
    r"Buscar",
    r"Publicado por",
    r"Fecha:",
    r"Facebook Twitter Pinterest WhatsApp",
    r"- Publicidad -",
    r"Tags",
    r"Artículo anterior",
    r"Artículo siguiente",
    r"RELACIONADOS",
    r"Popular",
    r"Recien leídos",
    r"Recomendado",
    r"Más Noticias",
    r"Últimas noticias",
    r"Convierta a Diario .* en su fuente de noticias aquí",
    r"© \d+ Todos los Derechos Reservados",
    r"Debes Saber",
    r"Puedes leer",
    r"LEE MÁS",
    r"VER MÁS",
    r"LE PUEDE INTERESAR",
    r"TAGS RELACIONADOS",
    r"NO TE PIERDAS",
    r"Contenido de",
    r"Siguiente artículo",
    r"Saltar a contenido principal",
    r"reproducciones",
]
#: Texts that say nothing.
IRRELEVANT = [
    r"^image\d+\.\w{3}\s+\d+K?$",
    r"^https?:\/\/",
    r"^OneDrive$",
    r"^Este cont?[ e]?nido no está disponible$",
    r"^PDF\s+HTML\s+Cuadernillo$",
    r"^Saltar (a|al) contenido",
    r"^(PDF|HTML|XML|CSV|XLS|XLSX|DOC|DOCX|JSON)$",
    r"^\d+ veces compartida$",
    r"^Me [Gg]usta\s+Comentar\s+Compartir$",
    r"^\s*Iniciar sesión\s*$",
    r"^Ver (más|todo)$",
    r"^Leer más$",
    r"^Siguiente$",
    r"^Anterior$",
    r"^Volver$",
    r"^(Cerrar|Aceptar|Cancelar)$",
    r"^Mostrar\s+\d+\s+(comentarios?|respuestas?)$",
    r"^\d+\s+reproducciones$",
]
#: Section headers of the bulletin, and the shapes that pass for one.
HEADERS = ["NORMAS LEGALES", "NOTICIAS – SUNASS", "NOTICIAS - SUNASS", "ALERTAS", "SECTOR", "MEDIOAMBIENTE", "MEDIO AMBIENTE", "POLÍTICA / ECONOMÍA", "POLÍTICA/ECONOMÍA", "POLITICA / ECONOMIA"]
HEADER_SHAPE = r"^[A-ZÁÉÍÓÚÑ\s\-–\/]{5,}$"
URL_IN_TEXT = r"https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F][0-9a-fA-F])+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Letters with marks and what they fold to.
MARKED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűýÿçćĉċčñńňśŝşšžźżďťřľĺğģķ"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_all(c: Column) -> Column:
    """White space at both ends, of any kind."""
    return F.regexp_replace(_text(c), f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), f"{WS}+", " "))


def whitespace_lower(c: Column) -> Column:
    """The lower-case words joined by one space."""
    return collapse(F.lower(_text(c)))


def normalize_for_similarity(c: Column) -> Column:
    """Lower case without URLs, punctuation and digits."""
    c = F.regexp_replace(F.lower(_text(c)), f"https?://{NOT_WS}+", "")
    return collapse(F.regexp_replace(F.regexp_replace(c, NOT_WORD, " "), r"\p{Nd}+", " "))


def normalize_for_topics(c: Column) -> Column:
    """Lower case without URLs, tags and punctuation; digits stay."""
    c = F.regexp_replace(_text(c), f"https?://{NOT_WS}+|www\\.{NOT_WS}+", "")
    c = F.regexp_replace(c, r"<[^\n]*?>", "")
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(c, r"\n+", " "), NOT_WORD, " ")))


def is_irrelevant(c: Column) -> Column:
    """A caption, a bare URL, a button's label or a reference of under 15 characters."""
    shape = "(?iu)" + "|".join(p.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s", WS).replace(r"\d", r"\p{Nd}") for p in IRRELEVANT)
    short = (F.char_length(_text(c)) < 15) & _text(c).rlike(r"^[\p{L}\p{N}_\x09-\x0D\x1C-\x20\x85\p{Z}.]+$")
    return _text(c).rlike(shape) | short


def _literal_of(pattern: str) -> str:
    """The longest run of plain characters that every match of a boilerplate pattern holds."""
    return max(re.split(r"\\d\+|\([^)]*\)\?|.\?|\.\*", pattern), key=len).lower()


def clean_boilerplate(c: Column) -> Column:
    """The text without boilerplate; '' if it says nothing or fewer than 20 characters are left.

    The fifty patterns run one after another, as what one leaves may match the next, but only over texts that hold the plain part
    of one of them, which a substring search tells.
    """
    # lambdas name what is used several times, so that it is worked out once
    named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    holds = lambda low: reduce(lambda a, p: a | low.contains(_literal_of(p)), BOILERPLATE[1:], low.contains(_literal_of(BOILERPLATE[0])))
    cut = lambda t: reduce(lambda x, p: F.regexp_replace(x, "(?iu)" + p.replace(r"\d", r"\p{Nd}"), ""), BOILERPLATE, t)
    bare = lambda t: collapse(F.when(named(F.lower(t), holds), cut(t)).otherwise(t))
    long_enough = lambda x: F.when(F.char_length(x) < 20, "").otherwise(x)
    return F.when((_text(c) == "") | is_irrelevant(c), "").otherwise(named(named(_text(c), bare), long_enough))


def fold_marks(c: Column) -> Column:
    """Letters without their marks, either case."""
    return F.translate(_text(c), MARKED + MARKED.upper(), PLAIN + PLAIN.upper())


def plain_for_intent(c: Column) -> Column:
    """Lower case without marks, look-alike digits as letters, runs of three or more squeezed to two, only [a-z0-9] and single spaces."""
    c = F.translate(fold_marks(F.lower(_text(c))), "0134@$57¡!?¿", "oieaasst")
    c = F.regexp_replace(c, r"(.)\1{2,}", "$1$1")
    return collapse(F.regexp_replace(c, r"[^a-z0-9ñ ]+", " "))


def letters_only(c: Column) -> Column:
    """plain_for_intent without digits."""
    c = F.translate(fold_marks(F.lower(_text(c))), "0134@$57¡!?¿", "oieaasst")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"(.)\1{2,}", "$1$1"), r"[^a-z]+", " "))


def clean_paragraph(c: Column) -> Column:
    """Control characters to spaces, white space collapsed."""
    return collapse(F.regexp_replace(_text(c), r"[\x00-\x1F\x7F]", " "))


def words(c: Column) -> Column:
    """array<string> of what white space separates."""
    return F.filter(F.split(_text(c), f"{WS}+"), lambda w: w != "")


def brief_description(c: Column, most: int = 5) -> Column:
    """The first words without URLs and three dots; a text of no more words is given whole."""
    bare = F.regexp_replace(_text(c), URL_IN_TEXT, "")
    w = words(bare)
    return F.when(F.size(w) <= most, strip_all(bare)).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("...")))


def urls_in(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(URL_IN_TEXT), F.lit(0))


def holds_email(c: Column) -> Column:
    return _text(c).rlike(EMAIL)


def is_header(c: Column) -> Column:
    """A known section header, marks and case aside, or a short line in capitals without signs of an address."""
    t = strip_all(c)
    known = F.upper(collapse(fold_marks(t))).isin([h.translate(str.maketrans("ÁÉÍÓÚÑ", "AEIOUN")) for h in HEADERS])
    shaped = t.rlike(HEADER_SHAPE.replace(r"\s", r"\x09-\x0D\x1C-\x20\x85\p{Z}")) & F.char_length(t).between(5, 50) & ~t.rlike("[@:?=&%]")
    return (t != "") & (known | shaped)


def markdown_escape(c: Column) -> Column:
    """Signs of Markdown escaped, white space collapsed."""
    return collapse(F.regexp_replace(_text(c), r"([#*_`><])", r"\\$1"))


def truncate_tokens(c: Column, most: int) -> Column:
    """At most four characters a token."""
    return F.left(_text(c), F.lit(4 * most))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct character n-grams; none of shorter texts. The text is cut into characters once, so its length counts once."""
    t = _text(c)
    grams = F.transform(F.array(F.split(t, "")), lambda chars: F.transform(F.slice(chars, F.lit(1), F.size(chars) - (n - 1)), lambda x, i: F.array_join(F.slice(chars, i + 1, n), "")))
    return F.when(F.char_length(t) >= n, F.array_distinct(F.element_at(grams, 1))).otherwise(F.array().cast("array<string>"))


def gram_codes(text: str, n: int = 3) -> np.ndarray:
    """The distinct n-grams of a text's code points (n of 3 at most), as 64-bit numbers that tell them exactly."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(points) < n:
        return np.empty(0, dtype=np.int64)
    code = points[: len(points) - n + 1]
    for i in range(1, n):
        code = (code << 21) | points[i : len(points) - n + 1 + i]
    return np.unique(code)


def count_char_ngrams(c: Column, n: int = 3) -> Column:
    """The size of char_ngrams() (n of 3 at most), counted as numbers without making a string of each."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(gram_codes(t, n)) for t in texts], dtype="int32")

    return run(_text(c))


def title_of(c: Column, most: int = 70) -> Column:
    """The first line that isn't blank, cut."""
    line = F.element_at(F.concat(F.filter(F.split(_text(c), "\n"), lambda x: strip_all(x) != ""), F.array(F.lit(""))), 1)
    line = strip_all(line)
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("..."))).otherwise(line)


def label_of(c: Column) -> Column:
    """some_key -> Some key."""
    t = F.regexp_replace(_text(c), "_", " ")
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1_000_000)))


def ascii_terms(c: Column, stop: list[str]) -> Column:
    """Lower-case words without ASCII punctuation and stop words."""
    bare = F.translate(F.lower(_text(c)), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.filter(words(bare), lambda w: ~w.isin(stop))
