"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then text). Each row's first fault counts: *blank* (no character
but white space), *duplicate* (its role and text were seen earlier) or *truncated* (its last such character is not one of ``.!?``). Edits: Keep 0, Rerole to user or assistant 2,
Delete 3 (required for blank and duplicate rows), Insert an empty user or assistant turn 2; an undeleted truncated row adds 1. Of the
cheapest edit scripts the one whose initials (D, I, K, R) are least as a string is taken.

*Viterbi with survivor coalescence.* States say what has been put out so far: nothing, s, ``..u``, ``..a``. Each state keeps one survivor: the leaf of a
backpointer tree whose nodes count their branches. A branch without survivors is pruned at once; as soon as all survivors share their
first edits, these are emitted and leave memory, while the conversation is still being read. A task holds the rows between the last common ancestor and the row it reads, not a conversation.

*Ties.* Survivors of equal cost are compared by their complete unresolved suffixes. Since survivors end with an edit that consumes the same row, none is a
prefix of another, so their order can be kept as a rank from row to row; a longer script is then ordered by (rank, edits since), which equals comparing whole suffixes.

*Spark.* One shuffle by conversation, two sorts in it (equal role and text next to each other, then turns), both of which spill. Duplicate flags are a
window over (conversation, role, text), so no set of seen texts is held. A conversation is one stream in one task because its script and its hash
are sequential; that task's memory does not grow with it. One kind of conversation is the exception: in an unbroken run of turns of one role
two scripts of nearly equal cost stay apart (an insert early, or late), and the rows of that run are held until it ends.

Defined cases: null ids, roles and texts are one space each in the hash that picks the damage, and null roles and texts are one space afterwards (such a text is blank, such a role is never kept); a null
conv_id is one conversation and is returned as null; rows that repeat in full are duplicates of each other; a conversation without rows (all dropped) has
one row with a null edit; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
FAULTS = ("blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: State after an output: nothing yet, "s", "..u", "..a"; which initials may follow each, and the state that they lead to.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEEDED = "uuau"
LEGAL_END = (START, ASSISTANT)
#: Inserts that can pay: as many as lead to a state not met before.
INSERTS = (2, 2, 1, 1)
#: Whatever a survivor in the second state can still do, one in the first can do for at most so much more (by inserts, or by deleting a
#: system row). A survivor that costs more than that above another one can never win, nor tie, and is dropped.
CATCH_UP = {
    (START, SYSTEM): 0, (START, USER): 2, (START, ASSISTANT): 0,
    (SYSTEM, START): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
    (USER, START): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2,
    (ASSISTANT, START): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2,
}


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)``: rows after the fixed damage; a dropped row stays as a marker with ``alive`` false."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return hit.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (null, or the first of blank, duplicate and truncated); partitions hold whole conversations in order.

    ``rows`` has conv_id, turn, role, text and optionally ``alive`` (false: no row, but its conversation exists).
    """
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), alive.alias("alive"))
    same = Window.partitionBy("conv_id", "alive", "role", "text").orderBy(F.asc_nulls_first("turn"))
    seen = rows.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    fault: Column = (
        F.when(~F.col("text").rlike(NOT_SPACE), F.lit("blank"))
        .when(F.col("again"), F.lit("duplicate"))
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), F.lit("truncated"))
    )
    order = [F.asc_nulls_first("conv_id"), F.asc("alive"), F.asc_nulls_first("turn"), "role", "text", "again"]
    return seen.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "alive", fault.alias("fault"))


class Node:
    """An edit in the backpointer tree; ``branches`` are the edits that follow it in some survivor's script."""

    __slots__ = ("branches", "edit", "initial", "parent", "row")

    def __init__(self, parent: Node | None, edit: str, initial: str, row):
        self.parent, self.edit, self.initial, self.row = parent, edit, initial, row
        self.branches: list[Node] = []
        if parent is not None:
            parent.branches.append(self)


class Repair:
    """Reads the rows of one conversation in order and gives ``(edit, role, text, row)`` as soon as they are certain."""

    def __init__(self):
        self.root = Node(None, "", "", None)
        #: state -> (cost, rank of the complete suffix among survivors, leaf)
        self.survivors = {START: (0, 0, self.root)}

    def _reachable(self):
        """Survivors and what inserts make of them: (cost, rank, inserts, state, leaf)."""
        for state, (cost, rank, leaf) in self.survivors.items():
            yield cost, rank, "", state, leaf
            at = state
            for n in range(1, INSERTS[state] + 1):
                at = FOLLOW[at][NEEDED[at]]
                yield cost + n * INSERT, rank, "I" * n, at, leaf

    def _inserted(self, leaf: Node, state: int, n: int, made: dict) -> Node:
        for k in range(n):
            initial = NEEDED[state]
            key = (id(leaf), initial)
            if key not in made:
                made[key] = Node(leaf, "I", initial, None)
            leaf, state = made[key], FOLLOW[state][initial]
        return leaf

    def read(self, row, initial: str, fault: str | None):
        best: dict[int, tuple] = {}

        def offer(target, cost, rank, edits, leaf, origin, out):
            held = best.get(target)
            if held is None or (cost, rank, edits) < held[:3]:
                best[target] = (cost, rank, edits, leaf, origin, out)

        extra = TRUNCATED if fault == "truncated" else 0
        origin = {id(leaf): state for state, (_, _, leaf) in self.survivors.items()}
        for cost, rank, inserts, state, leaf in self._reachable():
            start = origin[id(leaf)]
            offer(state, cost + DELETE, rank, inserts + "D", leaf, start, "")
            if fault in ("blank", "duplicate"):
                continue
            follow = FOLLOW[state]
            if initial in follow:
                offer(follow[initial], cost + KEEP + extra, rank, inserts + "K", leaf, start, initial)
            needed = NEEDED[state]
            offer(follow[needed], cost + REROLE + extra, rank, inserts + "R", leaf, start, needed)
        costs = {state: x[0] for state, x in best.items()}
        for (ahead, behind), most in CATCH_UP.items():
            if ahead in costs and behind in costs and costs[ahead] + most < costs[behind]:
                best.pop(behind, None)
        made: dict = {}
        old = [leaf for _, _, leaf in self.survivors.values()]
        order = sorted(best, key=lambda s: best[s][1:3])
        self.survivors = {}
        for rank, state in enumerate(order):
            cost, _, edits, leaf, start, out = best[state]
            leaf = self._inserted(leaf, start, len(edits) - 1, made)
            self.survivors[state] = (cost, rank, Node(leaf, edits[-1], out, row))
        live = {id(leaf) for _, _, leaf in self.survivors.values()}
        for leaf in old:
            self._prune(leaf, live)
        return self._settled(live)

    def _prune(self, node: Node, live: set):
        while not node.branches and node.parent is not None and id(node) not in live:
            parent = node.parent
            parent.branches.remove(node)
            node.parent = None
            node = parent

    def _settled(self, live: set):
        while id(self.root) not in live and len(self.root.branches) == 1:
            self.root = self.root.branches[0]
            self.root.parent = None
            yield self._edit(self.root)

    def _edit(self, node: Node):
        row = node.row
        if node.edit == "I":
            return "I", ROLES[node.initial], "", None
        return node.edit, ROLES[node.initial] if node.edit == "R" else row[1], row[2], row

    def finish(self):
        ends = [x for x in self._reachable() if x[3] in LEGAL_END]
        _, _, inserts, _, leaf = min(ends, key=lambda x: x[:3])
        state = next(s for s, x in self.survivors.items() if x[2] is leaf)
        leaf = self._inserted(leaf, state, len(inserts), {})
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            yield self._edit(node)


def _repair(schema: pa.Schema, rows_per_batch: int = 4096):
    """Sorted (conv_id, turn, role, text, alive, fault) -> the edit script, row by row."""

    def run(batches):
        out: list[tuple] = []
        current, work, steps, any_row = None, None, 0, False

        def emit(edits):
            nonlocal steps
            for edit, role, text, row in edits:
                turn, before, fault = (row[0], row[1], row[3]) if row else (None, None, None)
                out.append((current[0], steps, edit, role, text, turn, before, fault))
                steps += 1

        def close():
            if current is not None:
                emit(work.finish())
                if not any_row:
                    out.append((current[0], 0, None, None, None, None, None, None))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, turn, role, text, alive, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current[0] != conv:
                    close()
                    current, work, steps, any_row = (conv,), Repair(), 0, False
                if alive:
                    any_row = True
                    emit(work.read((turn, role, text, fault), role[:1], fault))
                if len(out) >= rows_per_batch:
                    yield batch_of(out)
                    out = []
        close()
        if out:
            yield batch_of(out)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """The edit script of every conversation, one row per edit, in order within partitions.

    ``(conv_id, step, edit, role, text, turn, role_before, fault)``: role and text are those after the edit (of the deleted row for D); the repaired
    conversation is the rows that are not D, by step. A conversation without rows has one row whose edit is null.
    """
    faults = with_faults(rows)
    conv, turn = (faults.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    out = f"conv_id {conv}, step long, edit string, role string, text string, turn {turn}, role_before string, fault string"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    schema = pa.schema(
        [("conv_id", arrow[conv]), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
         ("turn", arrow[turn]), ("role_before", pa.string()), ("fault", pa.string())]
    )
    return faults.mapInArrow(_repair(schema), out)


def _summaries(schema: pa.Schema):
    """Edit scripts in order -> one row per conversation, in memory that does not grow with it but for the script itself."""

    def run(batches):
        current, seen = None, None
        done: list[tuple] = []

        def close():
            if current is None:
                return
            turns = seen["turns"]
            gaps = seen["last"] - seen["first"] + 1 - turns if turns else 0
            faults = [seen[name] for name in FAULTS]
            done.append((current[0], gaps, *faults, seen["illegal"], seen["cost"], "".join(seen["audit"]), seen["hash"].hexdigest()))

        for batch in batches:
            for conv, _, edit, role, text, turn, before, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current[0] != conv:
                    close()
                    current = (conv,)
                    seen = {"turns": 0, "first": None, "last": None, "illegal": 0, "cost": 0, "audit": [], "before": None, "any": False}
                    seen |= {name: 0 for name in FAULTS} | {"hash": hashlib.sha256()}
                if edit is None:
                    continue
                seen["audit"].append(edit)
                seen["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "D":
                    seen["hash"].update((("\n" if seen["any"] else "") + f"{role}:{text}").encode())
                    seen["any"] = True
                    seen["cost"] += TRUNCATED if fault == "truncated" else 0
                if edit == "I":
                    continue
                if fault is not None:
                    seen[fault] += 1
                if seen["before"] is not None and seen["before"][:1] + before[:1] not in ("su", "ua", "au"):
                    seen["illegal"] += 1
                seen["before"] = before
                if turn is not None and turn != seen["last"]:
                    seen["turns"] += 1
                    seen["first"] = turn if seen["first"] is None else seen["first"]
                    seen["last"] = turn
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def summaries(script: DataFrame) -> DataFrame:
    """One row per conversation from ``repair``'s script, which has to come straight from it: its partitions are read in order.

    Gaps are missing turns between the least and the greatest (turns that are no integers are cast to long).
    """
    script = script.withColumn("turn", F.col("turn").cast("long"))
    conv = script.schema["conv_id"].dataType.simpleString()
    columns = ("gaps", *FAULTS, "illegal", "cost")
    types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    schema = pa.schema([("conv_id", types[conv]), *((c, pa.int64()) for c in columns), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = f"conv_id {conv}, {', '.join(f'{c} long' for c in columns)}, audit string, repaired_sha256 string"
    return script.mapInArrow(_summaries(schema), out)
