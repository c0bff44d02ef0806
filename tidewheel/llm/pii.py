"""Personal data and secrets, in DataFrame functions alone.

Regular expressions propose spans, checksum validators confirm them, and context words near a
span adjust its score. Base kinds (email, ip, card, phone) stay whatever their context; kinds
that the method adds need ``least`` points: iban by mod-97, ssn by its blocks and context, key
by the fixed form of its issuer, secret by its variety of characters and context.

Spans come from splitting a text at a pattern's matches: the lengths of the pieces between
and of the matches give the places. Places are summed in blocks of matches, so that the work
follows the number of matches; texts with many are cut into characters once, and pieces are
taken from those. Patterns use possessive loops and start at the front of a run, so a long run
of digits or letters costs one pass and no recursion. An expression is evaluated only where a
cheap test finds what its kind needs, and a text is split only where there is a match.

Defined results: null text is empty and has no spans; rows are independent, so repeated rows
and ties need no rule; an empty table gives an empty result; input columns with the name of
an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order of equal starts, and their patterns. A run's front is
# where no character of the run stands before, or where the last match ended.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: What a text must hold for a kind to be looked for: a string, or a pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
NEEDS_PATTERN = {"card": "[0-9]", "iban": "[0-9]", "key": "AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY", "secret": r"[0-9][A-Za-z0-9+/_-]{9}|[A-Za-z0-9+/_-]{9}[0-9]"}
#: Words that raise a span's score when they stand within ``REACH`` characters of it, on either side.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|server|host|address", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security",
    "key": "key|token|secret", "secret": "token|secret|password|passwd|pwd|credential|bearer|api.?key|access.?key|private.?key",
}
REACH = 40
#: Points of a confirmed span, by kind, and for a context word.
POINTS = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.9, "secret": 0.3}
CONTEXT_POINTS = 0.3
#: Matches whose places are summed at once; spans beyond which a text is cut into characters.
BLOCK = 256
MANY = 64
#: Different characters that a secret must have at least.
VARIETY = 8
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN without spaces: its first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r).otherwise(
            F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
        ),
    )


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.coalesce(luhn(digits), F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        return F.char_length(bare).between(15, 34) & (mod97(bare) == 1)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= VARIETY)
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though it is named often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column, spans: Column) -> Column:
    """The characters of a text with many spans, else null."""
    return F.when(F.size(spans) > MANY, F.split(text, ""))


def piece(text: Column, chars: Column, start: Column, length: Column) -> Column:
    """``length`` characters behind the first ``start``, without a walk from the front if cut."""
    return F.when(chars.isNull(), F.substring(text, start + 1, length)).otherwise(F.array_join(F.slice(chars, start + 1, length), ""))


def _places(found: Column, between: Column) -> Column:
    """Spans of matches, from their lengths and those of what stands between them."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def block(k):
        pairs = F.zip_with(F.slice(found, k * BLOCK + 1, BLOCK), F.slice(between, k * BLOCK + 1, BLOCK), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g")))
        return F.aggregate(
            F.filter(pairs, lambda x: x["m"].isNotNull()),  # a last piece has no match
            F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.char_length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.char_length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out"),
            ),
        )

    def joined_up(blocks):
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        shift = lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))
        moved = bound(starts, lambda at: F.flatten(F.zip_with(blocks, F.slice(at, 1, F.size(blocks)), shift)))
        return F.when(F.size(blocks) == 1, F.element_at(blocks, 1)["out"]).otherwise(moved)

    return bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), block), joined_up)


def proposals(kind: str, text: Column) -> Column:
    """All matches of a kind as (start, end, value) in code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(NEEDS_PATTERN[kind])
    split_at = lambda found: bound(F.split(text, PATTERNS[kind], -1), lambda between: _places(found, between))
    spans = bound(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), lambda found: F.when(F.size(found) > 0, split_at(found)).otherwise(empty))
    return F.when(needed, spans).otherwise(empty)


def scored(kind: str, text: Column, least: float) -> Column:
    """Confirmed spans as (start, rank, end, kind, score)."""
    near = rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})"
    rank = KINDS.index(kind)

    def one(s, chars):
        before = piece(text, chars, F.greatest(F.lit(0), s["start"] - REACH), F.least(F.lit(REACH), s["start"]))
        after = piece(text, chars, s["end"], F.lit(REACH))
        score = F.lit(POINTS[kind]) + F.when(before.rlike(near) | after.rlike(near), F.lit(CONTEXT_POINTS)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), score).alias("score"))

    sure = F.filter(proposals(kind, text), lambda s: confirmed(kind, s["value"]))
    spans = bound(sure, lambda some: bound(characters(text, some), lambda chars: F.transform(some, lambda s: one(s, chars))))
    return spans if rank < 4 else F.filter(spans, lambda s: s["score"] >= least)


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.5, out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: confirmed spans by start and kind, with their scores."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[scored(k, clean, least) for k in KINDS]))
    return docs.withColumn(out, spans)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; spans that overlap an
    earlier one only extend what is removed. Texts without spans, null too, stay as they are."""
    found = find_pii(docs, text, least, "__pii")
    t = F.col(text).cast("string")
    kind = "array<struct<start:int,end:int,kind:string>>"

    # spans that overlap are one, under the first one's kind; sums of blocks as above
    def block(spans, k):
        return F.aggregate(
            F.slice(spans, k * BLOCK + 1, BLOCK),
            F.array().cast(kind),
            lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_grown(F.element_at(acc, -1), s["end"]))))
            .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
        )

    def replaced(spans, chars):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda k: block(spans, k))
        reach = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.element_at(b, -1)["end"]))))

        def each(b, at):
            """What stands before each span, and its kind; ``at`` is where the last block ended."""
            return F.transform(
                b,
                lambda s, i: bound(
                    F.when(i == 0, at).otherwise(F.get(b, i - 1)["end"]),
                    lambda last: F.when(s["start"] >= last, F.concat(piece(t, chars, last, s["start"] - last), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")),
                ),
            )

        return bound(
            blocks,
            lambda bs: bound(
                reach(bs),
                lambda at: F.concat(F.array_join(F.flatten(F.zip_with(bs, F.slice(at, 1, F.size(bs)), each)), ""), piece(t, chars, F.element_at(at, -1), F.char_length(t))),
            ),
        )

    done = bound(F.col("__pii"), lambda spans: bound(characters(t, spans), lambda chars: replaced(spans, chars)))
    return found.withColumn(text, F.when(F.size("__pii") > 0, done).otherwise(t)).drop("__pii")


def _grown(span: Column, end: Column) -> Column:
    return F.struct(span["start"].alias("start"), F.greatest(span["end"], end).alias("end"), span["kind"].alias("kind"))
