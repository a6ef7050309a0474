"""Secret scans: patterns, and sliding-window Shannon entropy of what looks random, in DataFrame functions only.

Base kinds are ``assign`` (a key word, a sign and a value), ``access`` (access keys) and ``hex`` (long hexadecimal runs). The
entropy kind takes candidate strings (long runs of letters, digits and a few signs), places each in the narrowest character class
that holds it, slides a window of ``WINDOW`` characters over it and flags the candidate if the entropy within some window reaches
the threshold of its class. The counts of the window, fields of ``FIELD`` bits in a few numbers, change by one character out and one
in; what they add up to, the sum of c log2 c, is kept in whole millionths, so that no rounding depends on the order of steps.

Base spans always stay. Suspect candidates that the allow list does not name are added to them, those aside that base spans cover
whole; so are suspect parts that base spans leave over of other candidates. Redaction removes what is listed.

Every row is judged by itself: no shuffle. Work is in proportion to a text's length, however many spans it holds: what base spans
leave of a candidate is seen from a copy of the text in which they are blank.

Defined results: a null text is an empty one, without spans, and stays null in redaction; repeated rows give repeated rows; an empty
table gives none; spans are in order of start, then kind; other columns are ignored by ``scan`` and kept, whatever their names, by
``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import chunked, let, matches, part, replaced
from .common import text_or_empty

#: The base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits of a count, and counts in a number of 64 bits.
FIELD, FIELDS = 5, 12
#: Character classes, narrowest first, and the bits a character from which a window is suspect.
CLASSES = (("[0-9a-f]+|[0-9A-F]+", 3.0), ("[a-z0-9]+|[A-Z0-9]+", 3.5), ("[A-Za-z0-9]+", 3.7), (".+", 3.8))
#: A change of case as words seldom have: one small letter between capitals, or a capital behind a small letter and before none.
ODD_CASE = "(?:[A-Z][a-z](?=[A-Z])|[a-z][A-Z](?![a-z]))"
#: What is never a secret: words (at most one odd case) and numbers joined by signs, UUIDs, placeholders.
ALLOWED = (f"(?!.*{ODD_CASE}.*{ODD_CASE})[A-Za-z+/_=-]+", "[0-9+/_=-]+", "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "(?i).*(example|dummy|sample|placeholder|x{6}).*")
#: c log2 c in millionths for each count that a window can hold.
WEIGHTS = tuple(round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1))


def _suspect(candidate: Column) -> Column:
    """Whether some window of the candidate has the entropy that its class needs."""
    full = lambda p: candidate.rlike(f"^({p})$")
    bits = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES):
        bits = F.when(full(pattern), F.lit(least)).otherwise(bits)
    # H = log2(WINDOW) - sum / WINDOW, so H >= bits means sum <= WINDOW * (log2(WINDOW) - bits)
    most = F.floor((F.lit(math.log2(WINDOW)) - bits) * (WINDOW * 1_000_000))
    numbers = -(-len(SYMBOLS) // FIELDS)
    bits_of = lambda place: (place % FIELDS * FIELD).cast("int")
    one = lambda place, i: F.when(i == F.floor(place / FIELDS), F.call_function("shiftleft", F.lit(1).cast("long"), bits_of(place))).otherwise(F.lit(0).cast("long"))
    count = lambda counts, place: F.call_function("shiftright", counts[F.floor(place / FIELDS).cast("int")], bits_of(place)).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")

    def slid(places: Column, weight: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"))

        def step(state: Column, i: Column) -> Column:
            coming, full = places[i], i >= WINDOW
            leaving = F.when(full, F.get(places, i - WINDOW))

            out, into = count(state["counts"], leaving), count(state["counts"], coming)
            less = F.when(full, weight[out - 1] - weight[out]).otherwise(F.lit(0))
            counts = F.transform(state["counts"], lambda n, k: n + one(coming, k) - F.when(full, one(leaving, k)).otherwise(F.lit(0).cast("long")))
            moved = lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(i >= WINDOW - 1, F.least(state["least"], t)).otherwise(state["least"]).alias("least"))
            return F.when(full & (leaving == coming), state).otherwise(let(state["sum"] + less + weight[into + 1] - weight[into], moved))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda state: state["least"])

    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    weights = F.array(*map(F.lit, WEIGHTS))
    return let(weights, lambda w: let(F.filter(places, lambda p: p >= 0), lambda at: slid(at, w))) <= most


def _kind(found: Column, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def _allowed(candidate: Column) -> Column:
    return candidate.rlike("^(" + "|".join(f"({p})" for p in ALLOWED) + ")$")


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["inner"]) >= ASSIGN_VALUE)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["found"]) >= ACCESS_LENGTH)
    return F.array_sort(F.concat(_kind(assign, 0), _kind(access, 1), _kind(matches(text, HEX), 2)))


def _suspects(text: Column) -> Column:
    """Spans of all suspect candidates."""
    return _kind(F.filter(matches(text, CANDIDATE), lambda m: ~_allowed(m["found"]) & _suspect(m["found"])), 3)


def blanked(text: Column, base: Column, blank: str) -> Column:
    """``text`` with ``blank`` in place of each character of a base span."""
    return replaced(text, base, lambda size: F.repeat(F.lit(blank), size))


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``text``, none of it null, and ``base`` and ``spans``: arrays of start, kind (its place in ``KINDS``), end.

    To the base spans come suspect candidates that they do not cover, and suspect parts that they leave of other candidates."""
    text, base, whole, some = F.col("text"), F.col("base"), F.col("whole"), F.size("base") > 0
    rows = rows.withColumn("base", base_spans(text)).withColumn("whole", _suspects(text))
    rows = rows.withColumn("without_base", F.when(some & (F.size(whole) > 0), chunked(blanked(text, base, " "))))
    rows = rows.withColumn("without_both", F.when(some, blanked(text, F.array_sort(F.concat(base, whole)), " ")))
    uncovered = F.filter(whole, lambda m: part(F.col("without_base"), m["start"], m["end"] - m["start"]).rlike("[^ ]"))
    rows = rows.withColumn("parts", F.when(some, _suspects(F.col("without_both"))))
    more = F.when(some, F.concat(F.when(F.size(whole) > 0, uncovered).otherwise(whole), "parts")).otherwise(whole)
    return rows.withColumn("spans", F.array_sort(F.concat(base, more))).drop("whole", "without_base", "without_both", "parts")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` of each row."""
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return with_spans(docs.select("doc_id", text_or_empty().alias("text"))).select("doc_id", *map(number, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, of ``text`` replaced by ``mark``; null texts stay null."""
    rows = with_spans(docs.select(F.struct("*").alias("row"), text_or_empty().alias("text")))
    changed = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), lambda _: F.lit(mark))).otherwise(F.col("row.text"))
    return rows.select(F.col("row").withField("text", changed).alias("row")).select("row.*")
