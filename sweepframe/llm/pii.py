"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is DataFrame functions. The pieces between the matches of a kind and the
matches themselves give each span's place as a running sum of lengths, which is a
window over the rows that documents with matches unfold into, one for each match with
the characters around it; texts are not shuffled.

The base kinds are always reported. The further kinds count only from a score on:
a start value for the kind, more if a word that belongs to it stands near the span.

Patterns are possessive and begin where a run of their characters does, so that a
long run is read once and nothing is tried again.

Defined results: a NULL text is empty; a row without spans has zero counts and empty
lists; equal rows give equal rows; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepframe.session import write_table

#: Characters before and after a span in which a context word counts.
NEAR = 48
THRESHOLD = 0.5
BONUS = 0.25


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Do up to 19 digits pass the Luhn check?"""
    padded = F.lpad(digits, 19, "0")

    def add(total: Column, i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Does an account number (letters and digits) leave 1 when divided by 97?"""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        v = F.when(code < 65, code - 48).otherwise(code - 55)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


BYTE = "(?:0++(?![1-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"


#: Countries by the length of their account numbers.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Numbers of their country's length, or else of any; a word behind is not taken in."""
    every = []
    for n, countries in LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        every.append(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{last}(?![A-Za-z0-9])")
    every.append(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(every)})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Characters a text must hold for the pattern to be tried.
    needs: str
    start: float
    #: Words that belong to the kind, as an alternation.
    words: str

    def valid(self, value: Column) -> Column:
        n = F.length(only_digits(value))
        if self.name == "ip":
            return F.regexp_like(value, F.lit(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z"))
        if self.name == "card":
            return F.when(n.between(14, 19), luhn(only_digits(value))).otherwise(False)
        if self.name == "phone":
            return n.between(10, 15)
        if self.name == "iban":
            return mod97(value)
        return F.lit(True)


#: In the order in which spans that start together are listed.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, "mail|e-mail|email|contact|kontakt|correo",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 0.6, "ip|host|server|address|adresse",
    ),
    Kind(
        "card",
        r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
        "", 0.8, "card|credit|visa|karte|carte|tarjeta|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", 0.6, "phone|tel|call|mobile|fax|telefon|teléfono",
    ),
    Kind(
        "iban",
        _iban(),
        "", 0.6, "iban|account|bank|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-", 0.3, "ssn|social|security",
    ),
)
BASE = ("email", "ip", "card", "phone")


def _tried(text: Column, k: int, kind: Kind) -> Column:
    """One struct in an array: the kind's matches and what lies between them; or NULL."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind.needs:
        none = F.array().cast("array<string>")
        matches = F.when(F.contains(text, F.lit(kind.needs)), matches).otherwise(none)

    def both(m: Column) -> Column:
        found = F.struct(F.lit(k).alias("k"), m.alias("matches"), F.split(text, pattern, -1).alias("pieces"))
        return F.when(F.size(m) > 0, found)

    # through an array, so that the pattern runs once
    return F.transform(F.array(matches), both)


def _joined(places: Column, cut) -> Column:
    """Pieces and matches of ``found`` at some places; single ones, as slices copy whole arrays."""
    each = lambda name, j: cut(F.coalesce(F.get(name, j), F.lit("")))
    return F.array_join(
        F.transform(places, lambda j: F.concat(each("found.pieces", j), each("found.matches", j))), ""
    )


def _before(i: Column) -> Column:
    """The last ``NEAR`` characters before match ``i`` of ``found``, other matches included."""
    cut = lambda x: F.right(x, F.lit(NEAR))
    # a match has two characters at least
    places = F.sequence(F.greatest(i - NEAR // 2, F.lit(0)), i - 1)
    both = F.when(i > 0, _joined(places, cut)).otherwise("")
    return cut(F.concat(both, cut(F.get("found.pieces", i))))


def _behind(i: Column) -> Column:
    """The first ``NEAR`` characters behind match ``i`` of ``found``, other matches included."""
    cut = lambda x: F.substring(x, 1, NEAR)
    return cut(_joined(F.sequence(i + 1, i + NEAR // 2 + 1), cut))


def _items() -> Column:
    """What is needed of each match of ``found``, so that no match carries all others."""
    places = F.sequence(F.lit(0), F.size("found.matches") - 1)
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("i"),
            F.length(F.get("found.pieces", i)).alias("gap"),
            F.get("found.matches", i).alias("value"),
            F.lower(F.concat(_before(i), F.lit(" "), _behind(i))).alias("context"),
        ),
    )


def _of_kind(items: Column, kind: str) -> Column:
    return F.filter(items, lambda s: s.kind == kind)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its spans (``kind, start, end, value, score``) in order of
    start and kind. Places count characters, ends are exclusive."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _spans(rows).select(F.col("id").alias(id_col), "spans")


def _spans(rows: DataFrame) -> DataFrame:
    """``row``, ``id`` and ``spans`` for ``rows`` (row, id, text)."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    tried = [_tried(F.col("text"), k, kind) for k, kind in enumerate(KINDS)]
    found = F.filter(F.concat(*tried), lambda x: x.isNotNull())
    rows = rows.select("row", "id", F.explode_outer(found).alias("found"))
    rows = rows.select("row", "id", F.col("found.k").alias("k"), F.explode_outer(_items()).alias("item"))
    rows = rows.select("row", "id", "k", "item.*").repartition("row")
    upto = Window.partitionBy("row", "k").orderBy("i")
    size = F.coalesce(F.length("value"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    chosen, score, name = F.lit(False), F.lit(0.0), F.lit("")
    for k, kind in enumerate(KINDS):
        here = F.col("k") == k
        near = F.regexp_like("context", F.lit(rf"(?<![\p{{L}}])(?:{kind.words})(?![\p{{L}}])"))
        points = F.lit(kind.start) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
        sure = kind.valid(F.col("value"))
        if kind.name not in BASE:
            sure = sure & (points >= THRESHOLD)
        chosen = F.when(here, sure).otherwise(chosen)
        score = F.when(here, points).otherwise(score)
        name = F.when(here, F.lit(kind.name)).otherwise(name)
    span = F.struct("start", "k", "end", name.alias("kind"), "value", F.round(score, 2).alias("score"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull() & chosen, span)))
    listed = F.transform(ordered, lambda s: F.struct(s.kind, s.start, s.end, s.value, s.score))
    return rows.groupBy("row", "id").agg(listed.alias("spans"))


def _written(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: spans counted by base kind and written out."""
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    counts = [F.size(_of_kind(F.col("spans"), kind.name)).cast("long").alias(f"n_{kind.name}") for kind in KINDS]
    return spans(docs, id_col, text_col).select(
        id_col, *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets. Runs a job.

    Of overlapping spans the one that starts first (then by kind) is replaced and the
    others as far as they go beyond it.
    """
    # written, so that a row has the same number on both sides
    rows = write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered").df
    found = _spans(rows.select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = found.where(F.size("spans") > 0).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    text = F.col(text_col)

    def add(done: Column, s: Column) -> Column:
        gap = F.substring(text, done.place + 1, F.greatest(s.start - done.place, F.lit(0)))
        out = F.concat(done.out, gap, F.lit("["), s.kind, F.lit("]"))
        return F.struct(out.alias("out"), F.greatest(done.place, s.end).alias("place"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("place"))
    clean = F.aggregate(
        "__spans", start, add, lambda done: F.concat(done.out, F.substring(text, done.place + 1, F.length(text)))
    )
    joined = rows.join(found, "__row", "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*docs.columns)
