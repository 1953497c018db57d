"""Secret scan: fixed patterns, and sliding-window entropy per character class; DataFrame functions only.

Candidates of a character class are the maximal runs of its characters. A window of fixed width slides along each;
the window's symbol counts, and with them its entropy, are updated by the one symbol that enters and the one that leaves.
Windows at or above the class's threshold are merged into spans. Allow-list: candidates that as a whole are no secrets are left out, and so are
windows that overlap a placeholder word, and spans that lie inside a span of a fixed pattern.

Entropy is kept as a sum of integers: H = log2(w) - sum(c * log2 c) / w, each term scaled by 2**20 and rounded, so that
incremental and direct computation agree to the last digit.

Cases
-----
* null text is scanned as empty; empty text gives no spans; texts are scanned whole, offsets count code points
* repeated rows and repeated or null doc_ids are each scanned and reported; an empty table gives an empty report
* ``find_secrets`` keeps other columns and puts ``base`` and ``added`` in place of columns of these names; ``scan`` ignores other columns
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, text_or_empty

#: Patterns of the contract (fixed values): kind, pattern, least length of the group given.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
LEAST_VALUE = 6
SCALE = 2**20


@dataclass(frozen=True)
class CharClass:
    """A character class: its symbols, the width of the window, the entropy in bits from which a window counts."""

    kind: str
    symbols: str
    pattern: str
    window: int
    bits: float

    @property
    def terms(self) -> list[int]:
        return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, self.window + 2)]

    @property
    def limit(self) -> int:
        """A window's sum of terms must not be above this."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", "[0-9A-Fa-f]", 20, 3.2),
    CharClass("entropy_base64", UPPER + LOWER + DIGITS + "+/_=-", "[A-Za-z0-9+/_=-]", 20, 3.8),
)
#: Candidates that match as a whole are no secrets: one kind of symbol alone, UUIDs, times.
ALLOWED = (
    r"^[0-9+/_=-]*$",
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]*Z?$",
)
#: Words of placeholders, in either case: what stands beside one is judged without it.
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "lorem")
#: Matches whose places are summed up together.
PLACED = 256


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, found)`` of all matches, leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than there are matches: the last has no match behind it
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("found")))
    nothing = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["long"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("spans"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])

    # in blocks, since a list that grows by each match of a long text takes time by its square
    def in_blocks(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 2) / PLACED).cast("int")), lambda k: F.slice(p, k * PLACED + 1, F.least(F.lit(PLACED), F.size(p) - 1 - k * PLACED)))
        return _with(cut, lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), lambda b, at: F.when(b.isNotNull(), placed(b, at)).otherwise(nothing))))

    def starts(blocks: Column) -> Column:
        def after(acc: Column, b: Column) -> Column:
            return F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["long"])))

        return F.aggregate(blocks, F.array(F.lit(0)), after)

    return F.when(text.rlike(pattern), _with(pairs, in_blocks)).otherwise(nothing)


def _hot_windows(candidate: Column, c: CharClass) -> Column:
    """Array of ``(start, end)`` within ``candidate``: merged windows at or above the class's entropy."""
    chars = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.symbols), ch))
    terms = F.array(*[F.lit(t).cast("long") for t in c.terms])

    def term(n: Column) -> Column:
        return F.element_at(terms, n + 1)

    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.symbols)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(-1).alias("from"), F.lit(-1).alias("to"), none.alias("spans"),
    )

    def step(acc: Column, x: Column) -> Column:
        entering, leaving, at = x["entering"], x["leaving"], x["at"]
        n_in = F.element_at(acc["counts"], entering)
        n_out = F.element_at(acc["counts"], F.greatest(leaving, F.lit(1))) + F.when(leaving == entering, 1).otherwise(0)
        left = F.when(leaving > 0, term(F.greatest(n_out - 1, F.lit(0))) - term(n_out)).otherwise(F.lit(0).cast("long"))
        total = acc["sum"] + term(n_in + 1) - term(n_in) + left
        changed = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == entering, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0))
        hot = (at >= c.window) & (total <= c.limit)
        begin = at - c.window
        joins = (acc["to"] >= begin) & (acc["from"] >= 0)
        closed = F.when(hot & ~joins & (acc["from"] >= 0), F.concat(acc["spans"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["spans"])
        return F.struct(
            changed.alias("counts"), total.alias("sum"),
            F.when(hot & ~joins, begin).otherwise(acc["from"]).alias("from"), F.when(hot, at).otherwise(acc["to"]).alias("to"), closed.alias("spans"),
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end")))
        return F.when(acc["from"] >= 0, F.concat(acc["spans"], last)).otherwise(acc["spans"])

    lagged = F.concat(F.array_repeat(F.lit(0), c.window), chars)
    moves = F.zip_with(chars, F.slice(lagged, 1, F.size(chars)), lambda e, lv: F.struct(e.alias("entering"), lv.alias("leaving")))
    moves = F.transform(moves, lambda m, i: F.struct(m["entering"].alias("entering"), m["leaving"].alias("leaving"), (i + 1).alias("at")))
    return F.aggregate(moves, zero, step, finish)


def _shifted(c: CharClass):
    """From a candidate to its hot windows, placed in the text."""

    def spans(m: Column) -> Column:
        return F.transform(_hot_windows(m["found"], c), lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end")))

    return spans


def find_secrets(docs: DataFrame, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``(start, kind_no, end, kind)``, sorted."""
    docs = docs.drop("base", "added")
    text, assign, access, hexes, *runs = spare(docs, "whole", "assign", "access", "hex", *[f"runs_{c.kind}" for c in classes])
    out = docs.withColumn(text, text_or_empty())
    out = out.withColumns({n: _positions(F.col(text), p) for n, p in ((assign, ASSIGN), (access, ACCESS), (hexes, HEX))})
    out = out.withColumn(assign, F.filter(assign, lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST_VALUE))

    def named(spans, kind: str) -> Column:
        no = KINDS.index(kind)
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    out = out.withColumn("base", F.array_sort(F.concat(*[named(F.col(n), k) for n, k in zip((assign, access, hexes), KINDS)])))

    def beside(run: str):
        """From a run to the runs that placeholders leave of it."""

        def parts(m: Column) -> Column:
            blanked = m["found"]
            for word in placeholders:
                blanked = F.regexp_replace(blanked, F.lit(f"(?i:{word})"), F.lit(" " * len(word)))
            return F.transform(_positions(blanked, run), lambda p: F.struct((m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["found"].alias("found")))

        return parts

    added = []
    for c, name in zip(classes, runs):
        run = f"{c.pattern}{{{c.window},}}"
        out = out.withColumn(name, F.flatten(F.transform(_positions(F.col(text), run), beside(run))))
        kept = F.filter(name, lambda m: ~F.coalesce(*[F.when(m["found"].rlike(a), True) for a in allowed], F.lit(False)))
        added.append(named(F.flatten(F.transform(kept, _shifted(c))), c.kind))
    out = out.withColumn("added", F.array_sort(F.concat(*added)))
    inside = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])))
    return out.withColumn("added", inside).select(*docs.columns, "base", "added")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row for each row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"), **options)

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
