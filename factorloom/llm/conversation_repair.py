"""Repair of conversation structure by a min-plus matrix scan.

A repaired conversation's roles begin with ``s`` at most once, then ``u`` and ``a`` take turns and ``a`` is last; it may be empty.
Four states tell how far that is: nothing yet, after ``s``, after ``u``, after ``a``. Each turn is a 4 x 4 matrix from the state
before it to the state after it, over elements (cost, audit): keep, rerole or delete the turn, followed by the closure of
inserts. Elements are added by taking the smaller one and multiplied by adding costs and joining audits. The product over a
conversation is associative, so a partition reduces what it holds of a conversation to one matrix, by a balanced tree, and the
matrices of a conversation that spans partitions are reduced by rounds of groups of neighbours. Counts of faults, of illegal
neighbours and of missing turns are carried through the same reduction.

Equal costs never have one audit that begins another, as each turn gives one letter and each further insert costs; so
the smaller audit stays smaller whatever follows. In every state one role alone can be inserted or reroled to,
so an audit tells the repaired turns.

Turns go to partitions by ranges of (conversation, turn, role, digest of the text) and carry no text; equal ones are counted first
and travel once. Texts move once more for the repaired turns, which are written in one sorted pass.

Cases
-----
* the turns of a conversation go by ``turn``, null first; those of one turn by role, then by the text's SHA-256; null role or text counts as one space
* a null ``conv_id`` is a conversation of its own; an empty table gives no rows; other columns are ignored
* a role's initial is its first character; an empty role, or one with another initial than ``s``, ``u`` or ``a``, cannot be kept
* repeated rows are duplicates of the first; a blank turn is blank before it is a duplicate
* texts may have any length; an audit has a letter for each turn, so it must fit a string
* ``gaps`` ignores null turns, and is at most 2^63 - 1
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, stage

#: White space, and the marks that a whole turn ends with.
SPACES, ENDS = " \t\n\x0b\x0c\r", r"[.!?]"
START, S, U, A = range(4)
#: The state after a role's initial, from each state that allows it.
NEXT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
DONE = (START, A)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Matrices reduced at once, and neighbours that a round joins.
BLOCK, FAN = 512, 16

Matrix = tuple[tuple[int, str] | None, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; None is no way at all."""
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None:
                    way = x[0] + y[0], x[1] + y[1]
                    if best is None or way < best:
                        best = way
            out.append(best)
    return tuple(out)


def _matrix(ways: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(ways.get((i, j)) for i in range(4) for j in range(4))


def _sum(*matrices: Matrix) -> Matrix:
    return tuple(min((x for x in found if x is not None), default=None) for found in zip(*matrices))


UNIT = _matrix({(i, i): (0, "") for i in range(4)})
#: No insert, one, or two: more never help, as they come back to a state that was passed.
ONE_INSERT = _matrix({(i, j): (INSERT, "I") for role in "ua" for i, j in NEXT[role].items()})
CLOSURE = _sum(UNIT, ONE_INSERT, product(ONE_INSERT, ONE_INSERT))


def deletes(n: int) -> Matrix:
    """``n`` turns that must go, then inserts (deletes first, as the smaller audit has them)."""
    return product(_matrix({(i, i): (DELETE * n, "D" * n) for i in range(4)}), CLOSURE)


def turn_matrix(initial: str, truncated: bool) -> Matrix:
    """A turn that may be kept, reroled or deleted, then inserts."""
    late = TRUNCATED * truncated
    keep = _matrix({(i, j): (late, "K") for i, j in NEXT.get(initial, {}).items()})
    rerole = _matrix({(i, j): (REROLE + late, "R") for role in "ua" for i, j in NEXT[role].items()})
    return product(_sum(keep, rerole, _matrix({(i, i): (DELETE, "D") for i in range(4)})), CLOSURE)


TURNS = {(c, t): turn_matrix(c, t) for c in ("s", "u", "a", "") for t in (False, True)}


def reduce(matrices: list[Matrix]) -> Matrix:
    """Product of all, neighbours first, so that audits of like length are joined."""
    while len(matrices) > 1:
        matrices = [product(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else UNIT


class Part:
    """A run of neighbouring turns of one conversation: its matrix and what it counts."""

    def __init__(self) -> None:
        self.waiting: list[Matrix] = []
        self.tree: list[tuple[int, Matrix]] = []  # sizes fall from bottom to top
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, n: int, blank: bool, truncated: bool, earlier: bool) -> None:
        """``n`` equal turns; ``earlier``: such turns came before."""
        self._neighbours(initial, initial, turn, turn, 0 if turn is None else 1, n - 1)
        if blank:
            self.blank += n
            self.waiting.append(deletes(n))
        else:
            again = n - (not earlier)
            self.duplicate += again
            if not earlier:
                self.truncated += truncated
                self.waiting.append(TURNS[initial if initial in NEXT else "", truncated])
            if again:
                self.waiting.append(deletes(again))
        if len(self.waiting) >= BLOCK:
            self._settle()

    def _neighbours(self, first: str, last: str, low: int | None, high: int | None, distinct: int, illegal: int) -> None:
        if self.first is not None:
            illegal += self.last + first not in ("su", "ua", "au")
        else:
            self.first = first
        self.last = last
        self.illegal += illegal
        if low is not None:
            self.distinct += distinct - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def _settle(self) -> None:
        if self.waiting:
            n, block = len(self.waiting), reduce(self.waiting)
            self.waiting = []
            while self.tree and self.tree[-1][0] <= n:
                m, before = self.tree.pop()
                n, block = m + n, product(before, block)
            self.tree.append((n, block))

    @property
    def matrix(self) -> Matrix:
        self._settle()
        while len(self.tree) > 1:
            (m, before), (n, last) = self.tree[-2:]
            self.tree[-2:] = [(m + n, product(before, last))]
        return self.tree[0][1] if self.tree else UNIT

    def join(self, row: dict) -> None:
        """Append a later run, as ``stored`` gives it."""
        self._neighbours(row["first"], row["last"], row["low"], row["high"], row["distinct"], row["illegal"])
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + row[name])
        self.waiting.append(tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])))

    def stored(self) -> dict:
        costs, audits = zip(*(x or (None, None) for x in self.matrix))
        return {name: getattr(self, name) for name in ("blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "low", "high")} | {"costs": costs, "audits": audits}

    def report(self) -> dict:
        whole = product(CLOSURE, self.matrix)
        cost, audit = min(x for j in DONE if (x := whole[j]) is not None)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, 2**63 - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
PART = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")), *(T.StructField(n, T.StringType()) for n in ("first", "last")),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
])
REPORT = T.StructType([*(T.StructField(n, T.LongType()) for n in (*COUNTS, "cost")), T.StructField("audit", T.StringType())])


def digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _read(turns: DataFrame) -> DataFrame:
    blank_for_null = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), *blank_for_null)


def _ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, n, initial, blank, truncated, earlier``: equal turns once."""
    visible = F.rtrim("text", F.lit(SPACES))
    slim = turns.select(
        "conv_id", "turn", "role", digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), (F.length(visible) == 0).alias("blank"),
        (~F.substring(visible, -1, 1).isin(*ENDS.strip("[]"))).alias("truncated"),
    )
    counted = stage(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = stage(counted.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "first-turns").alias("f")
    again = counted.alias("t").hint("merge").join(first, F.expr("t.conv_id <=> f.conv_id AND t.role = f.role AND t.digest = f.digest"), "left")
    earlier = F.coalesce(~F.col("first").eqNullSafe(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))), F.lit(False))
    return stage(again.select("t.*", F.when(F.col("f.times").isNull(), False).otherwise(earlier).alias("earlier")), "ordered-turns")


def _parts(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition. The first and the last one may go on in other partitions: they stay parts."""
    place, part, conv, rows, first = TaskContext.get().partitionId(), None, None, [], True

    def row(edge: bool) -> dict:
        return {"conv_id": conv, "place": place, "part": part.stored() if edge else None, "report": None if edge else part.report()}

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "blank", "truncated", "earlier"))):
            if part is None or r[0] != conv:
                if part is not None:
                    rows.append(row(first))
                    first = False
                conv, part = r[0], Part()
            part.add(*r[1:])
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if part is not None:
        rows.append(row(True))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _round(last: bool) -> Callable[[pa.Table], pa.Table]:
    """Joins a group of neighbouring parts of one conversation; ``last``: into its report."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["g"])
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        part = Part()
        for r in rows:
            part.join(r["part"])
        out = {"conv_id": rows[0]["conv_id"], "place": rows[0]["place"] // FAN, "part": None if last else part.stored(), "report": part.report() if last else None}
        return pa.Table.from_pylist([out], table.schema)

    return joined


def plan_repairs(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of ``turns`` (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _ordered(_read(turns))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("part", PART), T.StructField("report", REPORT)])
    arrow = to_arrow_schema(schema)
    n = parallelism(turns.sparkSession)
    ranged = rows.repartitionByRange(n, "conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    found = stage(ranged.mapInArrow(lambda batches: _parts(batches, arrow), schema), "parts")
    edges = found.where("part IS NOT NULL")
    places = (edges.agg(F.max("place")).first()[0] or 0) + 1
    while True:
        places = -(-places // FAN)
        last = places == 1
        groups = edges.withColumn("g", F.floor(F.col("place") / FAN)).groupBy("conv_id", "g")
        edges = groups.applyInArrow(_round(last), schema)
        if last:
            break
    whole = found.where("report IS NOT NULL").unionByName(edges)
    return whole.select("conv_id", *(f"report.{c}" for c in REPORT.names))


def _repaired(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit stands before its turns and is spent on them."""
    rows, conv, audit, at, state, place, size = [], None, "", 0, START, 0, 0

    def inserted() -> Iterator[dict]:
        nonlocal at, state, place
        while audit[at : at + 1] == "I":
            role, state = ("assistant", A) if state == U else ("user", U)
            yield {"conv_id": conv, "place": place, "turn": None, "role": role, "text": "", "edit": "I"}
            at, place = at + 1, place + 1

    for batch in batches:
        for c, own, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "turn", "role", "text"))):
            if own is not None:
                conv, audit, at, state, place = c, own, 0, START, 0
                rows.extend(inserted())
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = "assistant" if state == U else "user"
                state = NEXT[role[0]][state]
                rows.append({"conv_id": c, "place": place, "turn": turn, "role": role, "text": text, "edit": edit})
                place, size = place + 1, size + len(text)
            rows.extend(inserted())
            if len(rows) >= 2000 or size >= 1 << 24:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit``: the turns that ``plans`` leave or insert (null turn), numbered from 0; a partition holds whole conversations in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = _read(turns)
    heads = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    both = own.select("*", digest().alias("digest"), F.lit(None).cast("string").alias("audit")).unionByName(heads)
    schema = T.StructType([own.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit"))])
    arrow = to_arrow_schema(schema)
    by_conversation = both.repartition(parallelism(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
    return by_conversation.select("conv_id", "audit", "turn", "role", "text").mapInArrow(lambda batches: _repaired(batches, arrow), schema)


def _digests(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import hashlib

    rows, conv, running = [], None, None
    for batch in batches:
        for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if running is not None:
                    rows.append({"conv_id": conv, "repaired_sha256": running.hexdigest()})
                conv, running = c, hashlib.sha256()
            running.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(rows, schema)
        rows = []
    if running is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": running.hexdigest()}], schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of what ``repaired`` returned: SHA-256 of ``role:text`` lines. The digest is a running one, so a long conversation takes one task's time but no memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)
    return turns.mapInArrow(lambda batches: _digests(batches, arrow), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults to test repairs on, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops the turn, 1 empties its text, 2 removes its marks, 3 repeats it, 4 makes its role ``user``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = _read(turns).withColumn("fault", F.crc32(key) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).withColumn("copy", F.explode("copies")).drop("copy", "copies")
