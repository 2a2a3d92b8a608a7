"""Keyword rules over texts and questions: relevance, event classes, topics, intents, prompt types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, fold_marks, letters_only, plain_for_intent

#: Keywords of relevance with their weight.
RELEVANCE = {"agua": 0.2, "alcantarillado": 0.2, "saneamiento": 0.2, "sunass": 0.5, "sedapal": 0.2, "regulación": 0.2, "servicios públicos": 0.2}
#: Event classes of texts, and of questions where they differ, in order.
EVENTS = {
    "interrupcion": ["interrupción", "interrupciones", "corte de agua", "suspensión", "sin agua"],
    "denuncia": ["denuncia", "reclamo"],
    "supervision": ["fiscalización", "supervisión", "monitoreo"],
}
PLURALS = {"interrupcion": "interrupciones", "denuncia": "denuncias", "supervision": "supervisiones"}
#: Keywords of topics; ties go to the first.
TOPICS = {
    "noticias_sunass": ["sunass", "superintendencia", "nacional", "servicios", "saneamiento", "módulo", "atención", "orientación", "ciudadano", "mac", "regulador"],
    "agua_saneamiento": ["agua", "potable", "desagüe", "alcantarillado", "eps", "sedapal", "sedalib", "epsel", "ptar", "planta", "tratamiento", "residuales"],
    "politica_economia": ["gobierno", "ministerio", "economía", "vivienda", "proyecto", "inversión", "millones", "presupuesto", "soles", "financiamiento"],
}
#: Vocabulary of the intents.
SMALLTALK = ["hola", "holi", "holaa", "ola", "buenas", "buenos dias", "buenas tardes", "buenas noches", "hey", "hi", "hello", "que tal", "qué tal", "gracias", "de nada", "saludos"]
SMALLTALK_TERMS = ["hola", "holi", "holaa", "ola", "buenas", "buenos dias", "buenas tardes", "buenas noches", "que tal", "qué tal", "como estas", "cómo estas", "como esta", "cómo esta", "gracias", "muchas gracias", "de nada", "hey", "hi", "hello", "sup"]
SMALLTALK_PATTERNS = [r"hola(?:\s+que tal)?", r"buen[oa]s(?:\s+dias|\s+tardes|\s+noches)?", r"gracias(?:\s+muchas|\s+por.*)?", r"muchas\s+gracias", "ok", "listo", "entendido", "de acuerdo", "presentate", r"quien eres\??", r"qu[ée]\s+puedes\s+hacer\??", "ayuda", "thanks?", "hello"]
INTRODUCTION = [
    r"\bpres[eé]ntate\b",
    r"\bpres[eé]ntese\b",
    r"\bqu[ií]en eres\b",
    r"\bc[oó]mo te llamas\b",
    r"\bcu[aá]l es tu nombre\b",
    r"\b(puedes|podrias|podr[ií]as|me puedes|me podr[ií]as)\s+present(ar(se|te)?|arte|arse)\b",
    r"\bte\s+puedes\s+present(ar(te)?)\b",
]
INTRODUCTION_WORDS = ["presentate", "presentese", "presentarte", "presentarse"]
HELP = ["ayuda", "help", "como funciona", "cómo funciona", "que puedes hacer", "qué puedes hacer"]
COUNTS = ["cuantas", "cuántas", "cuantos", "cuántos", "numero de", "número de", "conteo", "total", "cantidad"]
DATES = ["fecha", "fechas", "hoy", "ayer", "manana", "mañana", "semana", "mes", "periodo", "período", "rango"]
STATS = ["promedio", "tendencia", "variacion", "variación", "porcentaje", "proyeccion", "proyección"]
DOMAIN = ["sunass", "eps", "interrupcion", "interrupciones", "corte", "cortes", "abastecimiento", "servicio de agua", "suspension", "suspensión", "alerta", "reporte", "incidencia"]
COUNT_PATTERNS = [r"cu[aá]ntas?", r"cu[aá]ntos?", r"n[uú]mero de", r"total de", r"hubo.*(interrupciones|denuncias|supervisiones)"]
REFERENCES = [r"\b(respuesta pasada|respuesta anterior|de lo anterior|según lo anterior)\b", r"\b(resúmelo|resumen|tabla de resumen|hazme una tabla|puedes resumir)\b", r"\b(según el contexto anterior|analiza lo anterior)\b"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def relevance(c: Column, weights: dict[str, float] | None = None) -> Column:
    """The weights of the keywords that occur, 1 at most."""
    low, total = F.lower(_text(c)), F.lit(0.0)
    for word, w in (weights or RELEVANCE).items():
        total = total + F.when(low.contains(word.lower()), F.lit(w)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def event_class(c: Column, classes: dict[str, list[str]] | None = None) -> Column:
    """The first event class one of whose keywords occurs; marks matter. Null for none."""
    low, found = F.lower(_text(c)), None
    for name, keys in (classes or EVENTS).items():
        found = F.when(_any(low, keys), name) if found is None else found.when(_any(low, keys), name)
    return found


def plural(c: Column) -> Column:
    found = None
    for one, many in PLURALS.items():
        found = F.when(c == one, many) if found is None else found.when(c == one, many)
    return found.otherwise(F.concat(c, F.lit("s")))


def topic(c: Column, topics: dict[str, list[str]] | None = None, default: str = "otros") -> Column:
    """The topic with most keywords in the text; ties to the first, none to default."""
    low, topics = F.lower(_text(c)), topics or TOPICS
    hits = []
    for i, (name, keys) in enumerate(topics.items()):
        n = F.lit(0)
        for k in keys:
            n = n + F.when(low.contains(k), 1).otherwise(0)
        hits.append(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def is_introduction(p: Column) -> Column:
    return p.rlike("|".join(INTRODUCTION)) | _any(p, INTRODUCTION_WORDS)


def is_count_question(c: Column) -> Column:
    return F.lower(_text(c)).rlike("|".join(COUNT_PATTERNS))


def is_smalltalk(c: Column) -> Column:
    """A greeting, thanks or the like, alone or with a few characters more."""
    p = letters_only(c)
    t = collapse(fold_marks(F.lower(_text(c))))
    w = F.split(p, " ")
    near = F.lit(False)
    for term in SMALLTALK_TERMS:
        near = near | (p.startswith(term) & (F.char_length(p) <= len(term) + 5))
    full = t.rlike("^(" + "|".join(SMALLTALK_PATTERNS) + ")$")
    return (collapse(_text(c)) != "") & (p.isin(SMALLTALK_TERMS) | ((p != "") & F.forall(w, lambda x: x.isin(SMALLTALK_TERMS))) | near | full)


def intent(c: Column) -> Column:
    """struct<intent, should_retrieve, should_partition>; rules in order, the first that fits wins."""
    p = plain_for_intent(c)
    n = F.when(p == "", 0).otherwise(F.size(F.split(p, " ")))
    give = lambda name, retrieve, part: F.struct(F.lit(name).alias("intent"), F.lit(retrieve).alias("should_retrieve"), F.lit(part).alias("should_partition"))
    return (
        F.when(p.isin(SMALLTALK) | ((n <= 3) & _any(p, SMALLTALK)), give("SMALLTALK", False, False))
        .when(is_introduction(p), give("PRESENTACION", False, False))
        .when(_any(p, HELP), give("AYUDA", False, False))
        .when(_any(p, COUNTS), give("COUNT_QUERY", True, False))
        .when(_any(p, DATES), give("DATE_QUERY", True, False))
        .when(_any(p, STATS), give("STATS_QUERY", True, False))
        .when(_any(p, DOMAIN), give("DOMAIN_QUERY", True, True))
        .when(n <= 3, give("OTHER", False, False))
        .otherwise(give("DOMAIN_QUERY", True, False))
    )


def prompt_type(question: Column, n_rows: Column, last_message: Column, most: int = 6) -> Column:
    """'3' if the question refers to an answer before it and there is one, '2' if more than most rows were found, else '1'."""
    refers = F.lower(_text(question)).rlike("(?U)" + "|".join(REFERENCES))
    return F.when(refers & (collapse(last_message) != ""), "3").when(n_rows > most, "2").otherwise("1")
