"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score. DataFrame functions only.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are kept once their own check holds (parts at
most 255; 12 to 19 digits that pass Luhn; 9 to 15 digits). ``iban``, compact or in groups of four, must pass
mod-97. ``idnumber`` (3-2-4 digits) and ``secret`` (a run of 32 or more letters, digits, + / _ -, with
letters and digits among them) have no checksum. Every confirmed span has a score in hundredths: that of its kind, and ``BOOST`` more
if words around it speak for the kind. Spans of the base kinds stay whatever their score; others go below ``LEAST_SCORE``,
so that an ``idnumber`` or a ``secret`` needs such words. Matches of a kind are the leftmost ones that don't overlap; one that fails
its check is dropped and not tried again.

Work is linear in the text and in its spans, whose number is not bounded: patterns are written so that the scan is
(repeats that can't be given back are possessive, and a run of mail name characters is tried at its beginning
only, or where the last match ended, not at each of its characters), and context and what is left of a redacted text are cut
from chunks of ``CHUNK`` code points, never from the whole text.

Defined results: a null text counts as empty and has no span; spans of different kinds may overlap
and all are reported; rows with null or repeated ids keep their rows; extra columns are
not read, and ``redact`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "idnumber", "secret")
LEAST_SCORE = 50
BEFORE, AFTER = 48, 24  # code points of context
CHUNK = 512  # code points; more than BEFORE and AFTER
STEP = 64  # elements of an array that are worked on at a time

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9_])",
    "idnumber": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+",
}
#: A cheap test that a text without it has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "idnumber": "-"}
SCORES = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 80, "idnumber": 30, "secret": 30}
CONTEXT = {
    "email": "mail|contact",
    "ip": "address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank",
    "idnumber": "ssn|social security|identity",
    "secret": "token|secret|password|api.?key|access.?key|bearer",
}
BOOST = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _scan(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``add`` over an array, by chunks, so that long arrays cost little more than short ones."""
    upto = lambda xs: F.aggregate(xs, start, add)

    def heads(s: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STEP).cast("int"))
        return F.aggregate(chunks, F.array(start), lambda acc, c: F.concat(acc, F.array(add(F.element_at(acc, -1), upto(F.slice(s, c * STEP + 1, STEP))))))

    return let(values, lambda s: let(heads(s), lambda h: F.transform(s, lambda _, i: add(F.get(h, F.floor(i / STEP).cast("int")), upto(F.slice(s, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1))))))


def _running(steps: Column) -> Column:
    """Running totals of an array of long."""
    return _scan(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _furthest(ends: Column) -> Column:
    """Running maxima of an array of long."""
    return _scan(ends, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))


def _chunks(text: Column) -> Column:
    """``text`` in pieces of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in chunks, at the cost of what is asked for."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(start < end, F.substring(near, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def proposed(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points, end exclusive."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    pairs = F.filter(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda x: x["value"].isNotNull())
    sized = F.transform(pairs, lambda x: F.struct(x["value"].alias("value"), F.char_length(x["value"]).cast("long").alias("n"), F.char_length(x["gap"]).cast("long").alias("gap")))

    def placed(z: Column) -> Column:
        ends = _running(F.transform(z, lambda x: x["n"] + x["gap"]))
        return F.zip_with(z, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["value"].alias("value")))

    has = text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        has = F.contains(text, F.lit(NEEDS[kind])) & has
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return F.when(has, let(sized, placed)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)
    worth = lambda i: F.substring(turned, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.floor(worth(i) / 10).cast("int") + worth(i) % 10)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 when read, first four characters last, letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, 1)) - 1
    rest = F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), lambda acc, i: (acc * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97)
    return rest == 1


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return let(F.regexp_replace(value, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mod97(F.regexp_replace(value, " ", "")) if kind == "iban" else F.lit(True)


def _chosen(kind_order: Column, of: Callable[[str], Column]) -> Column:
    out = F.when(kind_order == 0, of(KINDS[0]))
    for order, kind in enumerate(KINDS[1:], 1):
        out = out.when(kind_order == order, of(kind))
    return out


def _score(chunks: Column, length: Column, x: Column) -> Column:
    around = F.concat_ws(" ", _between(chunks, F.greatest(x["start"] - BEFORE, F.lit(0).cast("long")), x["start"]), _between(chunks, x["end"], F.least(x["end"] + AFTER, length)))
    return let(F.lower(around), lambda words: _chosen(x["kind_order"], lambda kind: F.lit(SCORES[kind]) + F.when(words.rlike(CONTEXT[kind]), BOOST).otherwise(0)))


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind: array of (start, kind_order, end, kind)."""
    held = F.filter(proposed(text, kind), lambda x: confirmed(kind, x["value"]))
    return F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def spans(text: Column) -> Column:
    """All spans of a text, sorted by start, then kind: array of (start, kind_order, end, kind, score)."""
    text = F.coalesce(text, F.lit(""))

    def scored(found: Column) -> Column:
        with_score = lambda chunks, length: F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind_order", "end", "kind")], _score(chunks, length, x).alias("score")))
        kept = F.filter(let(_chunks(text), lambda chunks: let(F.char_length(text), lambda length: with_score(chunks, length))), lambda x: (x["kind_order"] < len(BASE)) | (x["score"] >= LEAST_SCORE))
        none = F.expr("cast(array() as array<struct<start:bigint,kind_order:int,end:bigint,kind:string,score:int>>)")
        return F.when(F.size(found) > 0, F.array_sort(kept)).otherwise(none)

    return let(F.concat(*[spans_of(text, kind) for kind in KINDS]), scored)


def count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans and their scores as text, and counts of the other kinds."""
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), spans(F.col("text").cast("string")).alias("found"))
    counts = [count_of(kind) for kind in KINDS]
    base = F.filter("found", lambda x: x["kind_order"] < len(BASE))
    scores = F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), scores.alias("scores"), *counts[len(BASE) :])


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span, overlapping ones as one, replaced by its first kind in brackets."""
    length = F.char_length(text)

    def heads(ends: Column) -> Column:
        """(start, kind, at) of each span that doesn't overlap what is before it."""
        marked = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), i.alias("at"), ((i == 0) | (x["start"] >= F.get(ends, i - 1))).alias("new")))
        return F.filter(marked, lambda x: x["new"])

    def rebuilt(ends: Column, first: Column, chunks: Column) -> Column:
        # Before head k: what lies between the end of all spans before it and its start.
        since = lambda k: F.when(k > 0, F.get(ends, F.get(first, k)["at"] - 1)).otherwise(F.lit(0).cast("long"))
        parts = F.transform(first, lambda m, k: F.concat(_between(chunks, since(k), m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _between(chunks, F.element_at(ends, -1), length))

    whole = let(_furthest(F.transform(found, lambda x: x["end"])), lambda ends: let(heads(ends), lambda first: let(_chunks(text), lambda chunks: rebuilt(ends, first, chunks))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span in text replaced; other columns and null texts stay."""
    text = F.col("text").cast("string")
    return documents.withColumn("text", let(spans(text), lambda found: redacted(text, found)))
