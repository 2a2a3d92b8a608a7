"""Date encodings, day windows and the parser of dates in Spanish questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
MONTHS = {"enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07", "agosto": "08", "setiembre": "09", "septiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12"}
#: The year of a date that names none.
DEFAULT_YEAR = "2025"


def from_ddmmyyyy(c: Column) -> Column:
    """A date; null for what is none."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "ddMMyyyy"))


def day_number(c: Column) -> Column:
    """ddmmyyyy -> yyyymmdd as int."""
    return F.date_format(from_ddmmyyyy(c), "yyyyMMdd").cast("int")


def to_ddmmyyyy(d: Column) -> Column:
    return F.date_format(d, "ddMMyyyy")


def iso_to_ddmmyyyy(c: Column) -> Column:
    return F.date_format(F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd"), "ddMMyyyy")


def month_key(c: Column) -> Column:
    """ddmmyyyy -> mmyyyy."""
    return F.substring(c, 3, 6)


def is_day(c: Column) -> Column:
    return from_ddmmyyyy(c).isNotNull()


def date_in_name(c: Column) -> Column:
    """The first eight digits of a file's name; null without."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{8})", 1), F.lit(""))


def shown_day(c: Column) -> Column:
    """ddmmyyyy -> dd/mm/yyyy."""
    return F.concat_ws("/", F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 4))


def shown_time(c: Column) -> Column:
    """ISO time -> dd/MM/yyyy HH:mm:ss; as it stands if it is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd/MM/yyyy HH:mm:ss"), c)


def local_time(c: Column, zone: str = "America/Lima") -> Column:
    return F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss")


def days_between(first: Column, last: Column) -> Column:
    """Each day from first to last; none if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))


def windows(first: Column, last: Column, days: int) -> Column:
    """array<struct<idx, start, end>>: windows of so many days anchored at first, the last cut at last."""
    starts = F.when(first <= last, F.sequence(first, last, F.make_interval(days=F.lit(days)))).otherwise(F.array().cast("array<date>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.least(F.date_add(s, days - 1), last).alias("end")))


def window_index(day: Column, first: Column, days: int) -> Column:
    return F.floor(F.datediff(day, first) / F.lit(days)).cast("int")


def per_window(k_total: int, n_days: int, days: int, least: int = 3) -> int:
    """Rows of a window: at least `least` a day, so that all windows together give about k_total."""
    return max(1, max(k_total // max(1, n_days), least) * days)


def spellings(d: Column) -> Column:
    """A day as ddmmyyyy, ISO and dd/mm/yyyy."""
    return F.array(F.date_format(d, "ddMMyyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"))


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def question_date(question: Column) -> Column:
    """struct<tipo, inicio, fin, valor>: a range (rango), a day (exacta) or a month (mes) that a question names; null for none.

    Rules are tried in order: three wordings of a day range, two of a month range, numeric month and day ranges, a day in words, a
    month, a numeric day. A second year takes the first's place if missing, never the other way round; a rule whose month is no
    month gives way to the next.
    """
    s = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    month = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    number = lambda name: F.try_element_at(month, name)
    # The wordings below, which must be those that questions are matched by.
    word, year = r"([\p{L}\p{N}_]+)", r"(?:\s+de\s+(\d{4}))?"
    nothing = F.lit(None).cast("string")
    two = lambda c: F.lpad(c, 2, "0")

    def result(kind: str, start: Column = nothing, end: Column = nothing, value: Column = nothing) -> Column:
        return F.struct(F.lit(kind).alias("tipo"), start.alias("inicio"), end.alias("fin"), value.alias("valor"))

    def day_range(opening: str, middle: str) -> tuple[Column, Column]:
        p = rf"(?U)\b{opening}\s+(\d{{1,2}})\s+de\s+{word}{year}{middle}(\d{{1,2}})\s+de\s+{word}{year}"
        d1, n1, a1, d2, n2, a2 = (_group(s, p, k) for k in range(1, 7))
        m1, m2 = number(n1), number(n2)
        a1 = F.coalesce(a1, F.lit(DEFAULT_YEAR))
        return m1.isNotNull() & m2.isNotNull(), result("rango", F.concat(two(d1), m1, a1), F.concat(two(d2), m2, F.coalesce(a2, a1)))

    def month_range(p: str, names: bool = True) -> tuple[Column, Column]:
        n1, a1, n2, a2 = (_group(s, p, k) for k in range(1, 5))
        m1, m2 = (number(n1), number(n2)) if names else (F.when(n1.cast("int").between(1, 12), two(n1)), F.when(n2.cast("int").between(1, 12), two(n2)))
        a1 = F.coalesce(a1, F.lit(DEFAULT_YEAR))
        a2 = F.coalesce(a2, a1)
        end = F.date_format(F.last_day(F.try_to_date(F.concat(F.lit("01"), m2, a2), "ddMMyyyy")), "ddMMyyyy")
        return m1.isNotNull() & m2.isNotNull(), result("rango", F.concat(F.lit("01"), m1, a1), end)

    numeric = r"(\d{1,2})[/\-.\s](\d{1,2})[/\-.\s](\d{4})\s*(?:al|a|hasta|–|-|—)\s*(\d{1,2})[/\-.\s](\d{1,2})[/\-.\s](\d{4})"
    n = [_group(s, numeric, k) for k in range(1, 7)]
    worded = rf"(?U)(\d{{1,2}})\s+de\s+{word}(?:\s+de\s*(\d{{4}}))?"
    slashed = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    rules = [
        day_range("del", r"\s+al\s+"),
        day_range(r"desde\s+el", r"\s+hasta\s+el\s+"),
        day_range(r"entre\s+el", r"\s+(?:y|al)\s+el?\s*"),
        month_range(rf"(?U)\bdesde\s+el\s+mes\s+de\s+{word}{year}\s+(?:hasta|a|al)\s+(?:el\s+)?mes\s+de\s+{word}{year}"),
        month_range(rf"(?U)\b{word}{year}\s+(?:hasta|a|al)\s+{word}{year}\b"),
        month_range(r"\b(\d{1,2})[/\-](\d{4})\s+(?:hasta|a|al)\s+(\d{1,2})[/\-](\d{4})\b", names=False),
        (n[0].isNotNull(), result("rango", F.concat(two(n[0]), two(n[1]), n[2]), F.concat(two(n[3]), two(n[4]), n[5]))),
        (number(_group(s, worded, 2)).isNotNull(), result("exacta", value=F.concat(two(_group(s, worded, 1)), number(_group(s, worded, 2)), F.coalesce(_group(s, worded, 3), F.lit(DEFAULT_YEAR))))),
        *[(s.rlike(rf"(?U)\b{name}\b"), result("mes", value=F.concat(F.lit(m), F.coalesce(_group(s, r"(\d{4})", 1), F.lit(DEFAULT_YEAR))))) for name, m in MONTHS.items()],
        (_group(s, slashed, 1).isNotNull(), result("exacta", value=F.concat(two(_group(s, slashed, 1)), two(_group(s, slashed, 2)), _group(s, slashed, 3)))),
    ]
    found = None
    for hit, value in rules:
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found
