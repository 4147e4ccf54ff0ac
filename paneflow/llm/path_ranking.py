"""Repair of conversation structure: the cheapest edits, least audit string among equals.

``damage`` spoils rows by a checksum, ``faults`` marks blank, repeated and cut rows, ``repair``
finds the edits (Keep, Rerole, Delete, Insert) that give role initials ``(s?(ua)+)?``.

A node of the repair graph is (rows consumed, state); states are: nothing yet, after the system row,
after a user row, after an assistant row.  A cost DP from the end gives every node its cost;
an arc is optimal if its cost and that of its target add up to the node's.  The least audit string
comes by prefix doubling: nodes are ranked by the first letter of their least audit, then, through
pointers to the node 1, 2, 4, ... letters on, by the first 2, 4, 8, ... letters.  Among a node's
optimal arcs the one with the least (letter, rank of its target) is taken; step t of a path is reached
by the pointers of t's binary digits, so all steps of all paths of a block are found together.
(A node has at most one optimal arc of each letter, so the ranks order whole audits and
the letters alone tell the arcs of one node apart.)

Scale: rows are range-partitioned by (conversation, turn, ...) once and numbered there; a
conversation is cut into chunks of 2**``CHUNK_BITS`` rows of one partition.  A chunk's DP is a 4 x 4
matrix of costs (min-plus); one pass over the chunks from the last to the first gives each chunk the costs
at its end, a pass from the first to the last the state at its begin.  No task holds a whole
conversation: both passes carry four numbers, and the repaired text streams through a hash.  The hash of a
conversation is sequential by its definition, so one task reads that conversation's texts.

Defined results: a null conversation, turn, role or text is one blank in the checksum's key and in
the repaired rows; a null conversation is a conversation, null turns come first.  Rows of one turn go by
role, then by the hash of role and text; a repeated row directly follows its original.  Initials are
the first letters of the roles as they are (case counts); a row whose role has another initial or
none cannot be kept.  An empty table has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.llm.common import parallelism, ship, stored

CHUNK_BITS = 11            # a chunk has at most 2**11 rows
BLOCK_ROWS = 1 << 17       # rows that a task ranks together
RULE = 20                  # damage goes by the checksum modulo this
DROP, EMPTY, UNPUNCTUATED, REPEAT, USER = range(5)
SPACE = " \t\n\x0b\x0c\r"

# Costs of the edits and states of the graph: fixed values.
REROLE, DELETE, INSERT, CUT_KEPT = 2, 3, 2, 1
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
LETTERS = "DIKR"           # in the order of their codes in ASCII
FAR = np.int64(1 << 40)    # cost of what cannot be
END_COSTS = (0, 2 * INSERT, INSERT, 0)  # of the states after the last row: missing rows are inserted
NEXT_INITIAL = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ROLE_AFTER = {AFTER_U: "user", AFTER_A: "assistant"}
#: The state behind a user or assistant row that is inserted or reroled in each state.
FOLLOWING = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])


# ---------------------------------------------------------------- rows

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage by crc32('conv_id:turn') modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % RULE
    text = F.when(F.col("_k") == EMPTY, "").when(F.col("_k") == UNPUNCTUATED, F.regexp_replace("text", "[.!?]", "")) \
            .otherwise(F.col("text"))
    copies = F.when(F.col("_k") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    src = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_k"))
    return src.where(F.col("_k") != DROP).select(
        "conv_id", "turn", F.when(F.col("_k") == USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows in conversation order, stored: ``place`` orders them over all partitions, ``same`` is
    the hash of conversation, role and text; ``blank``, ``cut`` and ``initial`` are of the row."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    same = F.sha2(F.concat(conv, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.col("role").substr(1, 1)
    code = F.lit(0)
    for x, state in NEXT_INITIAL.items():
        code = F.when(initial == x, state).otherwise(code)
    wide = rows.select("conv_id", "turn", "role", "text", "copy", F.unhex(same).alias("same"), (seen == "").alias("blank"),
                       ((seen != "") & ~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"), code.cast("int").alias("initial"),
                       F.monotonically_increasing_id().alias("_row"))
    # the row's own number comes last: equal rows have no order, but spread over partitions
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "same", "copy", "_row"]
    ordered = wide.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ordered.drop("_row", "copy").withColumn("place", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, initial, fault) of placed rows; fault: 0 none, 1 blank, 2 duplicate, 3 cut."""
    narrow = rows.select("conv_id", "turn", "place", "same", "initial", "blank", "cut")
    many = stored(narrow.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).select("same", "first"))
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    return stored(narrow.join(many, "same", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault")))


# ---------------------------------------------------------------- cost DP and ranking

def _arcs(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, target state) of the row arcs D, I (none here), K, R per state and letter: rows x 4 x 4."""
    n = len(initial)
    cost = np.full((n, 4, 4), FAR)
    target = np.broadcast_to(np.arange(4)[None, :, None], (n, 4, 4)).copy()
    stays = ~np.isin(fault, (1, 2))
    extra = np.where(fault == 3, CUT_KEPT, 0)
    cost[:, :, 0] = DELETE
    for state in range(4):
        nxt = int(FOLLOWING[state])
        keeps = stays & ((initial == nxt) | ((state == NOTHING) & (initial == AFTER_S)))
        cost[keeps, state, 2] = extra[keeps]
        target[:, state, 2] = np.where(initial == AFTER_S, AFTER_S, nxt)
        cost[stays, state, 3] = REROLE + extra[stays]
        target[:, state, 3] = nxt
    return cost, target


def _with_inserts(w: np.ndarray) -> np.ndarray:
    """Node costs from the costs by row arcs: one or two inserts may come first (last axis: states)."""
    u = np.minimum(w[..., AFTER_U], INSERT + w[..., AFTER_A])
    a = np.minimum(w[..., AFTER_A], INSERT + u)
    return np.stack([np.minimum(w[..., NOTHING], INSERT + u), np.minimum(w[..., AFTER_S], INSERT + u), u, a], axis=-1)


def node_costs(cost: np.ndarray, target: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs of all nodes from the end of their chunk back: rows x ends x states.

    ``end`` (chunks x ends x 4) holds the costs behind the last row.  All chunks go back together, row
    by row from their ends; the longest ones first in the order, so that the open ones are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    stop = np.cumsum(sizes)[order]
    size, now = sizes[order], end[order].copy()
    out = np.empty((len(cost), end.shape[1], 4), np.int64)
    for back in range(int(sizes.max(initial=0))):
        open_ = int(np.searchsorted(-size, -back, "left"))       # chunks with more than ``back`` rows
        at = stop[:open_] - 1 - back
        c, t = cost[at], target[at]                              # open x 4 x 4
        v = now[:open_]                                          # open x ends x 4
        reach = np.take_along_axis(v[:, :, None, :], t.reshape(open_, 1, 1, 16), axis=3).reshape(open_, -1, 4, 4)
        now[:open_] = _with_inserts(np.minimum((reach + c[:, None]).min(axis=3), FAR))
        out[at] = now[:open_]
    return out


def matrices(initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Min-plus matrix of each chunk: cost from a state at its begin to a state at its end."""
    end = np.full((4, 4), FAR)
    np.fill_diagonal(end, 0)
    nodes = node_costs(*_arcs(initial, fault), sizes, np.broadcast_to(end, (len(sizes), 4, 4)))
    return nodes[np.cumsum(sizes) - sizes].transpose(0, 2, 1)    # chunks x begin x end


class Ranked:
    """Least audits of all nodes of a block of chunks: rows + 1 layers of 4 nodes for each chunk."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray, end: np.ndarray):
        cost, target = _arcs(initial, fault)
        self.sizes = sizes
        self.layer = np.cumsum(sizes + 1) - (sizes + 1)          # first layer of each chunk
        n = int((sizes + 1).sum())
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        row = np.arange(len(initial)) + chunk                    # layer of each row
        best = np.empty((n, 4), np.int64)
        best[row] = node_costs(cost, target, sizes, end[:, None, :])[:, 0]
        best[self.layer + sizes] = end
        # arcs by letter: D, K, R go to the next layer, I stays; the last layer has none
        to = np.tile(np.arange(n * 4).reshape(n, 4, 1), (1, 1, 4))
        price = np.full((n, 4, 4), FAR)
        price[row], to[row] = cost, (row[:, None, None] + 1) * 4 + target
        price[row, :, 1], to[row, :, 1] = INSERT, row[:, None] * 4 + FOLLOWING
        flat = best.ravel()
        self.optimal = (price < FAR) & (price + flat[to] == best[:, :, None]) & (best < FAR)[:, :, None]
        self.optimal, self.to = self.optimal.reshape(-1, 4), to.reshape(-1, 4)
        self._double()

    def _double(self) -> None:
        """Ranks of audits by their first 1, 2, 4, ... letters, with pointers as many letters on."""
        some = self.optimal.any(axis=1)
        nodes = np.arange(len(some))
        first = np.where(some, self.optimal.argmax(axis=1), -1)  # no letter sorts before all letters
        rank, pointer = first + 1, np.where(some, self.to[nodes, first], nodes)
        self.pointers = [pointer]
        longest = 2 * int(self.sizes.max(initial=0)) + 2         # an insert before every row at most
        while 1 << len(self.pointers) <= longest:
            key = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(key, return_inverse=True)[1]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        # the arc of each node: the least (letter, rank of the target) among the optimal ones
        by = np.where(self.optimal, np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[self.to], np.iinfo(np.int64).max)
        self.letter = np.where(some, by.argmin(axis=1), -1)

    def exits(self) -> np.ndarray:
        """State at the end of each chunk (rows) for each state at its begin (columns)."""
        node = self.layer[:, None] * 4 + np.arange(4)
        for pointer in reversed(self.pointers):                  # ends point to themselves
            node = pointer[node]
        return node % 4

    def audits(self, begin: np.ndarray) -> list[str]:
        """The audit of each chunk from its begin state: all steps of all paths at once."""
        start = self.layer * 4 + begin
        most = 2 * self.sizes + 2
        path = np.repeat(np.arange(len(start)), most)
        step = np.arange(len(path)) - np.repeat(np.cumsum(most) - most, most)
        node = start[path]
        for k, pointer in enumerate(self.pointers):
            node = np.where(step >> k & 1, pointer[node], node)
        letter = self.letter[node]
        cut = np.bincount(path[letter >= 0], minlength=len(start))
        text = np.frombuffer(LETTERS.encode(), np.uint8)[letter[letter >= 0]].tobytes().decode()
        ends = np.cumsum(cut)
        return [text[a:b] for a, b in zip(ends - cut, ends, strict=True)]


# ---------------------------------------------------------------- chunks

def chunks(marked: DataFrame) -> DataFrame:
    """One row per chunk: (conv_id, chunk, initials, faults) in row order, at most 2**``CHUNK_BITS`` rows each."""
    rows = marked.withColumn("chunk", F.shiftright("place", CHUNK_BITS))
    rows = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))).alias("r"))
    return rows.select("conv_id", "chunk", F.col("r.initial").alias("initials"), F.col("r.fault").alias("faults"))


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with at most ``BLOCK_ROWS`` rows (or one chunk), and their chunk sizes."""
    for batch in batches:
        sizes = batch.column("initials").value_lengths().to_numpy().astype(np.int64)
        ends, k = np.cumsum(sizes), 0
        while k < len(sizes):
            n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK_ROWS, "right")) - k)
            yield batch.slice(k, n), sizes[k:k + n]
            k += n


def _more(df: DataFrame, lists: list[str], longs: list[str] = ()) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in lists),
                         *(T.StructField(c, T.LongType()) for c in longs)])


def _costs(part: DataFrame) -> DataFrame:
    """Chunks with ``matrix``: 16 costs, begin state by end state."""
    def run(batches):
        for batch, sizes in _slices(batches):
            m = matrices(_flat(batch, "initials"), _flat(batch, "faults"), sizes).reshape(len(sizes), 16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 16, pa.int32()), pa.array(m.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "matrix"])
    return part.mapInArrow(run, _more(part, ["matrix"]))


def _end_costs(part: DataFrame) -> DataFrame:
    """``matrix`` replaced by ``end_costs`` (4 numbers) and ``cost`` (of the whole conversation, at its
    first chunk; the chunks of a conversation come last one first)."""
    schema = _more(part.drop("matrix"), ["end_costs"], ["cost"])

    def run(batches):
        conv, ends = object(), None
        for batch in batches:
            at, cost = [], []
            for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if c != conv:
                    conv, ends = c, list(END_COSTS)
                at.append(ends)
                ends = [min(x + e for x, e in zip(m[4 * s:4 * s + 4], ends, strict=True)) for s in range(4)]
                cost.append(ends[NOTHING])
            keep = [batch.column(c) for c in batch.schema.names if c != "matrix"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(at, pa.list_(pa.int64())), pa.array(cost, pa.int64())], names=schema.names)
    return part.mapInArrow(run, schema)


DECISIONS = "conv_id long, chunk long, audit string, cost long, illegal long, first boolean"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[AFTER_S, AFTER_U] = _LEGAL[AFTER_U, AFTER_A] = _LEGAL[AFTER_A, AFTER_U] = True


def _decide(part: DataFrame) -> DataFrame:
    """(conv_id, chunk, audit, cost, illegal, first): the least audit of each chunk, first chunk first."""
    def run(batches):
        conv, state, last = object(), NOTHING, 0
        for batch, sizes in _slices(batches):
            initial, fault = _flat(batch, "initials"), _flat(batch, "faults")
            end = np.array(batch.column("end_costs").flatten(), np.int64).reshape(-1, 4)
            ranked = Ranked(initial, fault, sizes, end)
            ids, exits = batch.column("conv_id").to_pylist(), ranked.exits().tolist()
            stop = np.cumsum(sizes)
            # neighbours inside a chunk, then those across the chunks of a conversation
            bad = np.concatenate([[0], np.cumsum(~_LEGAL[initial[:-1], initial[1:]])])
            illegal = bad[stop - 1] - bad[stop - sizes]
            begin, first = [], []
            for k, c in enumerate(ids):
                first.append(c != conv)
                if c != conv:
                    conv, state = c, NOTHING
                else:
                    illegal[k] += not _LEGAL[last, initial[stop[k] - sizes[k]]]
                begin.append(state)
                state, last = exits[k][state], int(initial[stop[k] - 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("chunk"), pa.array(ranked.audits(np.array(begin, np.int64)), pa.string()),
                 batch.column("cost"), pa.array(illegal, pa.int64()), pa.array(first, pa.bool_())],
                names=["conv_id", "chunk", "audit", "cost", "illegal", "first"])
    return part.mapInArrow(run, DECISIONS)


def repair(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired_sha256) of each conversation with rows, from
    :func:`placed` rows and their :func:`faults`."""
    ship(rows.sparkSession)
    n = parallelism(rows.sparkSession)
    dealt = _costs(chunks(marked)).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc())
    decided = stored(_decide(_end_costs(dealt).sortWithinPartitions("conv_id", "chunk")))
    lines = rows.select("conv_id", "place", F.lit(True).alias("is_row"), "role", "text").unionByName(
        decided.select("conv_id", F.shiftleft("chunk", CHUNK_BITS).alias("place"), F.lit(False).alias("is_row"), F.lit("").alias("role"),
                       F.col("audit").alias("text"), "cost", "illegal", "first"), allowMissingColumns=True)
    lines = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place", "is_row")

    def run(batches):
        conv, one, done = object(), None, []
        names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for c, _, is_row, role, text, cost, illegal, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if one:
                        done.append((conv, *one.result()))
                    conv, one = c, Repaired()
                if is_row:
                    one.row(role, text)
                else:
                    one.chunk(text, cost if first else 0, illegal)
            if done:
                yield out()
                done = []
        if one:
            done.append((conv, *one.result()))
            yield out()

    return lines.select("conv_id", "place", "is_row", "role", "text", "cost", "illegal", "first").mapInArrow(
        run, "conv_id long, illegal long, cost long, audit string, repaired_sha256 string")


class Repaired:
    """A conversation's repaired rows as a running hash: rows and audits stream through."""

    def __init__(self):
        self.hash, self.audit, self.letters, self.at = hashlib.sha256(), [], "", 0
        self.state, self.empty, self.cost, self.illegal = NOTHING, True, 0, 0

    def chunk(self, audit: str, cost: int, illegal: int) -> None:
        self._inserts()
        self.letters, self.at = audit, 0
        self.audit.append(audit)
        self.cost += cost
        self.illegal += illegal

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self._put(NEXT_INITIAL[role[0]], role, text)
        elif letter == "R":
            state = int(FOLLOWING[self.state])
            self._put(state, ROLE_AFTER[state], text)

    def _inserts(self) -> None:
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            state = int(FOLLOWING[self.state])
            self._put(state, ROLE_AFTER[state], "")

    def _put(self, state: int, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.state, self.empty = state, False

    def result(self) -> tuple[int, int, str, str]:
        self._inserts()
        while self.state in (AFTER_S, AFTER_U):          # what is missing behind the last row
            self.audit.append("I")
            state = int(FOLLOWING[self.state])
            self._put(state, ROLE_AFTER[state], "")
        return self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _counts(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated), counted per turn first."""
    n = lambda k: F.sum(F.when(F.col("fault") == k, 1).otherwise(0))
    turns = marked.groupBy("conv_id", "turn").agg(n(1).alias("blank"), n(2).alias("duplicate"), n(3).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def digest(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: faults, cost, audit and hash of its cheapest repair."""
    rows = placed(damage(conversations))
    marked = faults(rows)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (_counts(marked), repair(rows, marked)):
        all_ = all_.unionByName(part, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    empty = F.lit(hashlib.sha256().hexdigest())
    return all_.groupBy("conv_id").agg(*[zero(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                       F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


def audit_of(initials: str, faulty: list[int]) -> tuple[int, str]:
    """(cost, audit) of one small conversation; the helper of the tests and of other callers."""
    init = np.array([NEXT_INITIAL.get(x, 0) for x in initials], np.int64)
    sizes, fault = np.array([len(init)]), np.array(faulty, np.int64)
    end = np.array([END_COSTS], np.int64)
    ranked = Ranked(init, fault, sizes, end)
    cost = (matrices(init, fault, sizes)[0] + end).min(axis=1)[NOTHING]
    state = int(ranked.exits()[0, NOTHING])
    return int(cost), ranked.audits(np.array([NOTHING]))[0] + "I" * (END_COSTS[state] // INSERT)

