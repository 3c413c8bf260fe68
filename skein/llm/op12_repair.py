"""Conversation structure repair: a DP over role/fault signatures that share the layers of a prefix trie.

A row's symbol is its role's initial (s, u, a, or o for any other), a capital if the row is truncated, or d if it must go. A
conversation's signature is the row of its symbols, and fixes its cheapest edits. Signatures are sorted and inserted into a
prefix trie in that order; a node holds the DP layer of its prefix (for each state of the grammar the least cost and, among
the cheapest, the ASCII-least audit), so a prefix that many conversations share is computed once. Answers are emitted at the
terminal nodes. Sorted insertion visits the trie depth first, so only the layers of the current path are held.

Conversations are dealt by conv_id and solved in batches of bounded size. One that has more than `long_rows` rows or
`long_bytes` bytes is dealt by ranges of its order instead and cut into chunks: a chunk's layers start from each of the four
states, equal signatures again share them, and the chunks' answers are folded in order, one state at a time. SHA-256 runs
through a conversation's text in order, so a long one's repaired text streams through one task, chunk after chunk, and is
never held; its audit, a letter for each row, is.

Results: null roles and texts are one space, as are nulls in the key that decides the damage; a null conv_id is a
conversation of its own, with a null conv_id; rows of equal turns come by role, then text; equal rows are duplicates of
the first; a blank row's copies are blank. Very long texts are hashed whole; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: What one task solves whole, what a batch of conversations holds, and what a chunk of a long one holds.
LONG_ROWS, LONG_BYTES = 2_000, 4 << 20
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
CHUNK_ROWS, CHUNK_BYTES = 500, 1 << 20
#: Copies of one row in a long conversation are first told apart within so many parts.
SALTS = 64

KEEP, DELETE, REROLE, INSERT, TRUNCATED = 0, 4, 3, 3, 3  # fixed values: costs
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Where each initial leads.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
FINAL = (0, 3)
LEGAL = (b"su", b"ua", b"au")
ANSWER = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

Layer = list[tuple[int, str] | None]


# --- damage ----------------------------------------------------------------------------------------------------


def _space(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def _fault():
    return F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _space("role").alias("role"), _space("text").alias("text"), _fault().alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


# --- the DP ----------------------------------------------------------------------------------------------------


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    have = layer[state]
    if have is None or (cost, audit) < have:
        layer[state] = (cost, audit)


def inserted(layer: Layer) -> Layer:
    """layer with rows inserted wherever that is cheaper: three in a row pass through every state."""
    for _ in range(3):
        for role in "ua":
            for p, q in NEXT[role].items():
                if layer[p] is not None:
                    _better(layer, q, layer[p][0] + INSERT, layer[p][1] + "I")
    return layer


def step(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row."""
    out: Layer = [None] * 4
    more = TRUNCATED if symbol.isupper() else 0
    for p, have in enumerate(layer):
        if have is None:
            continue
        cost, audit = have
        _better(out, p, cost + DELETE, audit + "D")
        if symbol == "d":
            continue
        if (q := NEXT[symbol.lower()].get(p)) is not None:
            _better(out, q, cost + KEEP + more, audit + "K")
        for role in "ua":
            if (q := NEXT[role].get(p)) is not None:
                _better(out, q, cost + REROLE + more, audit + "R")
    return inserted(out)


def _first() -> list[Layer]:
    return [inserted([(0, ""), None, None, None])]


def _every() -> list[Layer]:
    return [[(0, "") if p == q else None for q in range(4)] for p in range(4)]


def solved(signatures: Iterable[str], start: list[Layer]) -> Iterator[tuple[str, list[Layer]]]:
    """Each distinct signature with the layers at its terminal node, one for each layer of start."""
    path, last = [start], ""
    for signature in sorted(set(signatures)):
        shared = 0
        while shared < len(last) and shared < len(signature) and last[shared] == signature[shared]:
            shared += 1
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append([step(layer, symbol) for layer in path[-1]])
        yield signature, path[-1]
        last = signature


def cheapest(layer: Layer) -> tuple[int, str]:
    return min(layer[q] for q in FINAL if layer[q] is not None)


class Repaired:
    """The SHA-256 of `role:text` rows joined by newlines, as an audit makes them of the rows it is fed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, 0, hashlib.sha256(), False

    def _row(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.begun else b"") + role + b":")
        self.hash.update(text)
        self.begun = True
        self.state = {b"s": 1, b"u": 2, b"a": 3}[role[:1]]

    def _wanted(self) -> bytes:
        return b"assistant" if self.state == 2 else b"user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._row(self._wanted(), b"")
            self.at += 1

    def feed(self, rows: Iterable[tuple[bytes, bytes]]) -> None:
        for role, text in rows:
            self._inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                self._row(role if letter == "K" else self._wanted(), text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


# --- rows in order ------------------------------------------------------------------------------------------------


class Run:
    """Rows of one conversation in order: their symbols, counts and turns, and the rows themselves."""

    def __init__(self):
        self.rows: list[tuple[bytes, bytes]] = []
        self.symbols: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None
        self.turn = None

    def add(self, turn: int | None, role: bytes, text: bytes, seen: bool) -> None:
        body = text.strip()  # bytes.strip() takes just \x20 and \x09-\x0D
        initial = role[:1]
        if not body:
            symbol, self.blank = "d", self.blank + 1
        elif seen:
            symbol, self.duplicate = "d", self.duplicate + 1
        else:
            symbol = initial.decode("latin-1") if initial in (b"s", b"u", b"a") else "o"
            if body[-1:] not in (b".", b"!", b"?"):
                symbol, self.truncated = symbol.upper(), self.truncated + 1
        self.symbols.append(symbol)
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first, self.last = (initial if self.first is None else self.first), initial
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.distinct = (turn if self.low is None else self.low), turn, turn, self.distinct + 1
        self.rows.append((role, text))
        self.size += len(role) + len(text)

    def signature(self) -> str:
        return "".join(self.symbols)

    def info(self) -> tuple:
        """What of() needs: counts, first and last initial, first and last turn."""
        return self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.first, self.last, self.low, self.high


def merged(a: tuple, b: tuple) -> tuple:
    """info() of two runs of which b follows a."""
    blank, duplicate, truncated, illegal, distinct = (x + y for x, y in zip(a[:5], b[:5], strict=True))
    return blank, duplicate, truncated, illegal + (a[6] + b[5] not in LEGAL), distinct - (a[8] is not None and a[8] == b[7]), a[5], b[6], b[7] if a[7] is None else a[7], a[8] if b[8] is None else b[8]


def counts_of(info: tuple) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated, illegal."""
    return (0 if info[7] is None else info[8] - info[7] + 1 - info[4]), *info[:4]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def _repair(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWER rows of whole conversations, whose rows come one after the other and in order."""
    held: list[tuple[int | None, Run]] = []
    rows = size = 0
    seen: set[bytes] = set()

    def answers() -> pa.RecordBatch:
        found = {s: cheapest(layers[0]) for s, layers in solved((r.signature() for _, r in held), _first())}
        out = []
        for conv, run in held:
            cost, audit = found[run.signature()]
            text = Repaired(audit)
            text.feed(run.rows)
            out.append((conv, *counts_of(run.info()), cost, audit, text.digest()))
        return _table(out, ANSWER)

    for b in it:
        for conv, turn, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not held or held[-1][0] != conv:
                if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield answers()
                    held, rows, size = [], 0, 0
                held.append((conv, Run()))
                seen = set()
            key = hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest()
            held[-1][1].add(turn, role, text, key in seen)
            seen.add(key)
            rows, size = rows + 1, size + len(role) + len(text)
    if held:
        yield answers()


# --- long conversations ---------------------------------------------------------------------------------------------

CHUNK = "conv_id long, pid int, part int, signature string, info binary, rows binary"


def _chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, which are in order, cut into chunks."""
    context = TaskContext.get()
    pid, part, conv, run = context.partitionId() if context else 0, 0, None, None

    def chunk() -> pa.RecordBatch:
        return _table([(conv, pid, part, run.signature(), pickle.dumps(run.info(), 5), pickle.dumps(run.rows, 5))], CHUNK)

    for b in it:
        for c, turn, role, text, seen in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if run is not None and (c != conv or len(run.rows) >= CHUNK_ROWS or run.size >= CHUNK_BYTES):
                yield chunk()
                part, run = part + 1, None
            if run is None:
                conv, run = c, Run()
            run.add(turn, role, text, seen)
    if run is not None:
        yield chunk()


def _layers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layers of each chunk's signature from each state."""
    for whole in it:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            signatures = b.column(3).to_pylist()
            found = {s: pickle.dumps(layers, 5) for s, layers in solved(signatures, _every())}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array([found[s] for s in signatures], pa.binary())], ["conv_id", "pid", "part", "info", "layers"])


FOLDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Fold:
    """The chunks of one conversation, in order. What all states' audits begin with is put aside once they have it in common."""

    def __init__(self):
        self.layer, self.aside, self.info = _first()[0], [], None

    def add(self, info: tuple, layers: list[Layer]) -> None:
        out, come = [None] * 4, [None] * 4
        for p, have in enumerate(self.layer):
            for q, more in enumerate(layers[p]):
                if have is not None and more is not None:
                    new = (have[0] + more[0], have[1] + more[1])
                    if out[q] is None or new < out[q]:
                        out[q], come[q] = new, p
        origins = {p for p in come if p is not None}
        if len(origins) == 1:
            p = origins.pop()
            self.aside.append(self.layer[p][1])
            out = [None if v is None else (v[0], layers[p][q][1]) for q, v in enumerate(out)]
        self.layer, self.info = out, info if self.info is None else merged(self.info, info)

    def row(self, conv) -> pa.RecordBatch:
        cost, tail = cheapest(self.layer)
        return _table([(conv, *counts_of(self.info), cost, "".join([*self.aside, tail]))], FOLDED)


def _folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, fold = None, None
    for b in it:
        for c, info, layers in zip(b.column(0).to_pylist(), b.column(3), b.column(4), strict=True):
            if fold is not None and c != conv:
                yield fold.row(conv)
                fold = None
            conv, fold = c, fold or Fold()
            fold.add(pickle.loads(info.as_py()), pickle.loads(layers.as_py()))
    if fold is not None:
        yield fold.row(conv)


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation from its audit, which comes first, and its chunks in order."""
    conv, text = None, None
    for b in it:
        for c, pid, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if pid < 0:
                if text is not None:
                    yield _table([(conv, text.digest())], "conv_id long, repaired_sha256 string")
                conv, text = c, Repaired(rows.as_py().decode())
            else:
                text.feed(pickle.loads(rows.as_py()))
    if text is not None:
        yield _table([(conv, text.digest())], "conv_id long, repaired_sha256 string")


def _again(rows: DataFrame) -> DataFrame:
    """rows (with a row number `rid`) and whether an equal row comes earlier; copies are told apart within salts, then over them."""
    same, order = ["conv_id", "role", "text"], [F.asc_nulls_first("turn"), "rid"]
    salted = rows.withColumn("salt", F.pmod("rid", F.lit(SALTS))).withColumn("n", F.row_number().over(Window.partitionBy(*same, "salt").orderBy(*order)))
    firsts = salted.where("n = 1").withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
    return salted.where("n > 1").unionByName(firsts).select("conv_id", "turn", "role", "text", (F.col("n") > 1).alias("again"), "rid")


def _repair_long(rows: DataFrame) -> DataFrame:
    """ANSWER rows of the conversations in rows, dealt by ranges of their order."""
    numbered = common.staged(rows.withColumn("rid", F.monotonically_increasing_id()), "repair-long")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "rid"]
    ranged = _again(numbered).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = common.staged(ranged.select("conv_id", "turn", common.utf8("role"), common.utf8("text"), "again").mapInArrow(_chunks, CHUNK), "repair-chunks")
    layers = chunks.select("conv_id", "pid", "part", "signature", "info").mapInArrow(_layers, "conv_id long, pid int, part int, info binary, layers binary")

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "part")

    folded = common.staged(in_order(layers).mapInArrow(_folded, FOLDED), "repair-folded")
    audits = folded.select("conv_id", F.lit(-1).alias("pid"), F.lit(0).alias("part"), common.utf8("audit").alias("rows"))
    texts = in_order(audits.unionByName(chunks.select("conv_id", "pid", "part", "rows"))).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    return folded.join(texts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


# --- the operator --------------------------------------------------------------------------------------------------


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """ANSWER rows, one for each conv_id of the conversations before damage."""
    rows = damaged(conversations)
    size = F.when(_fault() == 0, 0).when(_fault() == 3, 2).otherwise(1)
    sizes = conversations.select(F.col("conv_id").cast("long").alias("c"), size.alias("n"), (size * (F.length(_space("text").cast("binary")) + F.length(_space("role").cast("binary")))).alias("bytes"))
    sizes = common.staged(sizes.groupBy("c").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "repair-sizes")
    gone = sizes.where("n = 0").select(F.col("c").alias("conv_id"), *(F.lit(0).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit(EMPTY_HASH).alias("repaired_sha256"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("c")
    out = gone
    rest = rows.drop("copy")
    if not long.isEmpty():
        of = rest["conv_id"].eqNullSafe(F.col("c"))
        out = out.unionByName(_repair_long(rest.join(long, of, "left_semi")))
        rest = rest.join(long, of, "left_anti")
    whole = rest.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return out.unionByName(whole.select("conv_id", "turn", common.utf8("role"), common.utf8("text")).mapInArrow(_repair, ANSWER))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
