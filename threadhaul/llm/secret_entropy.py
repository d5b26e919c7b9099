"""Secrets in texts, in DataFrame functions only.

Three fixed patterns (assignments, access keys, hex runs) and an entropy scan. For the
scan, candidate strings of each character class (base 64, hex, small letters with digits) are cut out; a window
slides over a candidate with the count of each character kept up to date, and with it
the sum of c * log2(c), so that the Shannon entropy of every window follows from the
one before. A long candidate is cut into stretches that overlap by a window, so that the
work grows with its length. A candidate is a secret if its highest window entropy reaches the limit
of its class, and it is on no allow-list (fixed patterns of harmless strings).

Positions are code points: the pieces between the matches, as `split` leaves them, and
the matches themselves alternate, so that running sums of their lengths give the spans.

Defined results: a NULL text is empty; repeated rows are scanned each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the contract, with the length that a match needs.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS = 8
KINDS = ("assign", "access", "hex", "entropy64", "entropy16", "entropy36")


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class, and the window entropy in bits that makes one a secret."""

    kind: str
    candidate: str
    alphabet: str
    window: int
    bits: float


BASE64 = CharClass(
    "entropy64",
    # At least one digit, one small and one capital letter; borders of the run are kept out of words.
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
    20,
    3.6,
)
BASE16 = CharClass(
    "entropy16",
    r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{20,}(?![A-Za-z0-9])",
    "0123456789abcdefABCDEF",
    16,
    3.0,
)
BASE36 = CharClass(
    "entropy36",
    # Small letters and digits that are not hex: at least one digit and one letter behind f.
    r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[0-9a-z]{24,}(?![A-Za-z0-9])",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    20,
    3.6,
)

# Harmless strings: UUIDs, digests named as such, paths of small words, runs of one character.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-_=]",
    r"^[a-z]+([/_-][a-z]+)+$",
    r"^(.)\1*$",
)


def _spans(text: Column, pattern: str, kind: str, lead: int | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, found>> of the matches in `text`; group `lead` must have `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(lead or 0))
    start = F.lit(0).cast("int")
    walked = F.aggregate(
        F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("between"), groups.alias("part")),
        F.struct(start.alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,found:string>>").alias("spans")),
        lambda state, x: F.struct(
            (state["at"] + F.length(x["between"]) + F.length(x["found"])).alias("at"),
            F.when(
                F.length(x["part"]) >= least,
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(x["between"])).alias("start"),
                            F.lit(KINDS.index(kind)).alias("rank"),
                            F.lit(kind).alias("kind"),
                            (state["at"] + F.length(x["between"]) + F.length(x["found"])).alias("end"),
                            x["found"].alias("found"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(
        F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,found:string>>")
    )


# Parts of one bit that entropies are counted in; whole numbers, so that sums do not depend on the way to them.
_BIT = 1 << 32
# A candidate is worked on in stretches of so many characters, each with the window's reach of the next one.
_STRETCH = 256


def _clog(count: int) -> int:
    return round(count * math.log2(count) * _BIT) if count else 0


def least_sum(value: Column, chars: CharClass) -> Column:
    """The smallest sum of count * log2(count), over all windows of `value`; NULL without a whole window.

    The entropy of a window of w characters is log2(w) - sum / w bits. Kept from step to step: the
    count of each character of the class in the window, and the sum.
    """
    w, size = chars.window, len(chars.alphabet)
    clogs = F.array(*(F.lit(_clog(n)) for n in range(w + 1)))
    first = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("n"),
        F.lit(None).cast("long").alias("least"),
    )

    def placed(counts: Column, at: Column, count: Column) -> Column:
        return F.concat(F.slice(counts, 1, at), F.array(count), F.slice(counts, at + 2, F.lit(size)))

    def step(state: Column, x: Column) -> Column:
        counts, enters, leaves = state["counts"], x["enters"], x["leaves"]
        more, less = F.get(counts, enters), F.get(counts, leaves)
        total = state["sum"] + F.when(leaves.eqNullSafe(enters), 0).otherwise(
            F.get(clogs, more + 1) - F.get(clogs, more) + F.coalesce(F.get(clogs, less - 1) - F.get(clogs, less), F.lit(0))
        )
        after = (
            F.when(leaves.isNull(), placed(counts, enters, more + 1))
            .when(leaves == enters, counts)
            .otherwise(placed(placed(counts, enters, more + 1), leaves, less - 1))
        )
        return F.struct(
            after.alias("counts"),
            total.alias("sum"),
            (state["n"] + 1).alias("n"),
            F.when(state["n"] + 1 >= w, F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
        )

    def in_stretch(stretch: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(stretch, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(chars.alphabet), c) - 1)
        pairs = F.transform(
            F.array(codes),
            lambda c: F.arrays_zip(
                c.alias("enters"), F.concat(F.array_repeat(F.lit(None).cast("int"), w), F.slice(c, 1, F.greatest(F.size(c) - w, F.lit(0)))).alias("leaves")
            ),
        )
        # Shorter stretches than a window have one pair for each place of the window: those without a character go.
        return F.aggregate(F.filter(F.get(pairs, 0), lambda x: x["enters"].isNotNull()), first, step)["least"]

    pieces = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{_STRETCH}}}"), F.lit(0))
    reach = F.transform(F.array(pieces), lambda p: F.transform(p, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(p, i + 1), F.lit("")), 1, w - 1))))
    return F.array_min(F.transform(F.get(reach, 0), in_stretch))


def enough_entropy(value: Column, chars: CharClass) -> Column:
    """Whether a window of `value` has `bits` bits a character or more; errors of the whole numbers count as equal."""
    limit = math.floor((math.log2(chars.window) - chars.bits) * chars.window * _BIT) + chars.window
    return F.coalesce(least_sum(value, chars) <= limit, F.lit(False))


def entropy_spans(text: Column, chars: CharClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    spans = _spans(text, chars.candidate, chars.kind)

    def secret(span: Column) -> Column:
        harmless = F.lit(False)
        for pattern in allowed:
            harmless = harmless | span["found"].rlike(pattern)
        return ~harmless & enough_entropy(span["found"], chars)

    return F.filter(spans, secret)


def scan(docs: DataFrame, text_column: str = "text", classes: tuple[CharClass, ...] = (BASE64, BASE16, BASE36)) -> DataFrame:
    """`docs` with `base_spans` and `all_spans`: arrays of (start, rank, kind, end, found) by start, then kind."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, "assign", 2, ASSIGN_CHARS), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")
    )
    more = F.concat(*(entropy_spans(text, chars) for chars in classes))
    return docs.withColumn("base_spans", F.array_sort(base)).withColumn(
        "all_spans", F.array_sort(F.concat(F.col("base_spans"), more))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mark`; spans that overlap become one mark."""
    state = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(
                x["start"] >= s["at"],
                F.concat(s["pieces"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))),
            )
            .otherwise(s["pieces"])
            .alias("pieces"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(F.array_join(s["pieces"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(state)
