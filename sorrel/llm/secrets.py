"""Secret spans in text, by SQL functions only: fixed patterns and sliding-window entropy."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 and more characters from its leftmost AKIA on
HEX = r"[0-9a-f]{24,}"  # a whole run, as a run's leftmost character starts it
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character that a window must reach, by the class of the candidate's characters.
MIN_BITS = {"hex": 3.2, "mixed": 3.9}
#: Candidates that are left alone: identifiers and fillers that aren't secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefghij",
    r"^sha(1|256|384|512)-",
    r"^/?([A-Za-z_-]+/){2,}",
)
_STEP = 512


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(items: Column, empty: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Aggregate that appends to an array; ``step`` gives struct(at, out)."""
    return F.aggregate(items, F.struct(start.alias("at"), F.expr(empty).alias("out")), step, lambda s: s)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, found string>> of the non-overlapping matches; code points, end exclusive.

    The pieces between matches and the matches give the places as running sums of lengths. The
    sums are built by blocks, as appending to one long array would copy it each time.
    """
    empty = "CAST(array() AS array<struct<start:int,end:int,found:string>>)"

    def places(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("p"))

        def of_block(b: Column, all_pairs: Column) -> Column:
            return _scan(
                F.slice(all_pairs, b * _STEP + 1, F.lit(_STEP)), empty, F.lit(0),
                lambda s, x: F.struct(
                    (s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("at"),
                    F.concat(s["out"], F.array(F.struct((s["at"] + F.char_length(x["p"])).alias("start"), (s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("found")))).alias("out"),
                ),
            )

        blocks = _let(pairs, lambda ps: F.transform(F.sequence(F.lit(0), ((F.size(ps) - 1) / _STEP).cast("int")), lambda b: of_block(b, ps)))
        joined = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<struct<start:int,end:int,found:string>>>)").alias("out")),
            lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(x["out"], lambda y: F.struct((y["start"] + s["at"]).alias("start"), (y["end"] + s["at"]).alias("end"), y["found"].alias("found"))))).alias("out")),
            lambda s: F.flatten(s["out"]),
        )
        return F.when(F.size(found) > 0, joined).otherwise(F.expr(empty))

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), places)


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of ``s`` (``window`` or more characters of +..z).

    A window's entropy is log2(window) less the sum of c*log2(c) over its characters' counts,
    divided by the window. When the window moves, only the counts of the character that leaves
    and of the one that enters change, and the sum by the difference of their terms.
    """
    term = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(window + 1)])
    low, span = ord("+"), ord("z") - ord("+") + 1

    def code(chars: Column, i: Column) -> Column:
        return F.ascii(F.get(chars, i)) - low

    def begin(chars: Column) -> Column:
        first = F.transform(F.slice(chars, 1, window), lambda c: F.ascii(c) - low)
        counts = _let(first, lambda codes: F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.size(F.filter(codes, lambda c: c == k))))
        return _let(counts, lambda c: F.struct(c.alias("n"), F.aggregate(c, F.lit(0.0), lambda a, v: a + F.get(term, v)).alias("sum")))

    def move(state: Column, i: Column, chars: Column) -> Column:
        return _let(F.struct(code(chars, i - window).alias("out"), code(chars, i).alias("in")), lambda x: F.when(x["out"] == x["in"], state).otherwise(
            _let(state["sum"] + F.get(term, F.get(state["n"], x["out"]) - 1) - F.get(term, F.get(state["n"], x["out"])) + F.get(term, F.get(state["n"], x["in"]) + 1) - F.get(term, F.get(state["n"], x["in"])),
                 lambda total: F.struct(F.transform(state["n"], lambda v, k: v + (k == x["in"]).cast("int") - (k == x["out"]).cast("int")).alias("n"), total.alias("sum"), F.least(state["best"], total).alias("best")))))

    def run(chars: Column) -> Column:
        return _let(begin(chars), lambda b: F.aggregate(
            F.when(F.size(chars) > window, F.sequence(F.lit(window), F.size(chars) - 1)).otherwise(F.expr("CAST(array() AS array<int>)")),
            F.struct(b["n"].alias("n"), b["sum"].alias("sum"), b["sum"].alias("best")), lambda st, i: move(st, i, chars), lambda st: st["best"]))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.lit(math.log2(window)) - _let(chars, run) / window


def secret_spans(text: Column, allow: tuple[str, ...] = ALLOW, window: int = WINDOW, min_bits: dict[str, float] | None = None) -> Column:
    """array<struct<start int, kind int, end int>> sorted by start, then kind (its place in KINDS)."""
    bits = min_bits or MIN_BITS

    def spans(kind: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    value = F.regexp_extract_all(text, F.lit(ASSIGN), 1)
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    assign = _let(match_spans(text, ASSIGN), lambda found: F.when(F.size(found) > 0, _let(value, lambda vs: spans(0, F.filter(found, lambda x, i: F.char_length(F.get(vs, i)) >= 6)))).otherwise(none))

    def high(x: Column) -> Column:
        c = x["found"]
        two = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | c.rlike(p)
        need = F.when(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$"), bits["hex"]).otherwise(bits["mixed"])
        return F.when(two & ~allowed, max_window_entropy(c, window) >= need - 1e-9).otherwise(False)

    entropy = spans(3, F.filter(match_spans(text, CANDIDATE), high))
    return F.array_sort(F.concat(assign, spans(1, match_spans(text, ACCESS)), spans(2, match_spans(text, HEX)), entropy))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<start, kind, end>>.

    A null or empty text has no spans. Repeated rows and null ids are scanned like others; texts of
    any length are scanned whole; an empty table gives an empty one. A column named secret_spans
    is replaced.
    """
    return docs.withColumn("secret_spans", secret_spans(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by [SECRET] (spans that touch or overlap: once), n_chars kept right.

    A null text stays null; a text without secrets stays as it is.
    """
    whole = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    def merged(spans: Column) -> Column:
        return F.aggregate(
            spans, F.struct(whole.alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
            lambda s, x: F.when(x["start"] <= s["end"], F.struct(s["out"].alias("out"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end")))
            .otherwise(F.struct(F.when(s["start"] >= 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"]).alias("out"), x["start"].alias("start"), x["end"].alias("end"))),
            lambda s: F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        )

    text = F.col("text")

    def rebuilt(m: Column) -> Column:
        kept = F.transform(m, lambda x, i: F.substring(text, F.when(i == 0, 1).otherwise(F.get(m, i - 1)["end"] + 1), x["start"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])))
        return F.concat(F.array_join(kept, "[SECRET]"), F.lit("[SECRET]"), F.substring(text, F.element_at(m, -1)["end"] + 1, F.lit(2**31 - 1)))

    found = secret_spans(F.coalesce(text.cast("string"), F.lit("")))
    out = docs.withColumn("text", _let(found, lambda spans: F.when(F.size(spans) > 0, _let(merged(spans), rebuilt)).otherwise(text)))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of spans per document, as the query returns them."""
    found = find_secrets(docs.select(F.col("doc_id"), F.col("text")))

    def joined(keep: Callable[[Column], Column]) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.filter("secret_spans", keep), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [number(k) for k in range(4)]
    return found.select("doc_id", *n[:3], F.sha2(joined(lambda x: x["kind"] < 3).cast("binary"), 256).alias("base_sha256"), joined(lambda x: F.lit(True)).alias("spans"), n[3])
