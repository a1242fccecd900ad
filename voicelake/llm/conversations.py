"""Conversation structure repair by a rank-convergence parallel Viterbi search.

The turns of a repaired conversation follow `(s?(ua)+)?`: an optional system turn, then pairs of user and assistant. Rows
are kept, given another role, deleted, or turns with empty text are inserted; the cheapest edits win. The backward costs
of a row are four numbers, one for each state of that pattern, and a step over a row is a (min, +) product. A long
conversation is cut into chunks that are searched in parallel from speculative cost vectors (those of the end of a
conversation). Fix-up passes give a chunk the vector its successor came to and run it again only if that differs from
the assumed one by more than a constant, because a constant changes no decision. A few rows with a user or assistant role
make all vectors equal up to a constant, so one or two passes are the rule. The entering state of every chunk is found
from the chunks' state maps by doubling; then each chunk walks the least audit through its stitched costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.operators.prefix import null_safe, running
from voicelake.session import cut

#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The only user or assistant turn a state allows leads here.
ALTERNATE = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Cost to end from each state.
FINISH = [0, 4, 2, 0]
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Place of the turns inserted behind the last row.
END = 1 << 62
CHUNK_ROWS = 4096
NOT_BLANK = r"[^\x20\x09-\x0D]"


def keep_to(state: int, initial: str) -> int | None:
    """The state after a kept row, None where the pattern forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def step_back(initial: str, truncated: bool, after: Sequence[int]) -> list[int]:
    """Costs to the end before a row, inserts in front of it included, from those behind it."""
    extra = TRUNCATED if truncated else 0
    costs = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + extra + after[ALTERNATE[state]])
        kept = keep_to(state, initial)
        costs.append(best if kept is None else min(best, extra + after[kept]))
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


def costs_of(initials: Sequence[str], truncated: Sequence[bool], end: Sequence[int]) -> list[list[int]]:
    """The cost vector before each row and behind the last one."""
    vectors = [list(end)]
    for initial, cut_off in zip(reversed(initials), reversed(truncated)):
        vectors.append(step_back(initial, cut_off, vectors[-1]))
    return vectors[::-1]


def walk(initials: Sequence[str], truncated: Sequence[bool], costs: list[list[int]], state: int) -> tuple[list[tuple[str, list[str], str | None]], int]:
    """Least audit from a state: per row its letters, the roles inserted before it and its new role (None: as it is, "": deleted)."""
    edits = []
    for i, (initial, cut_off) in enumerate(zip(initials, truncated)):
        before, here, after, extra = [], costs[i], costs[i + 1], TRUNCATED if cut_off else 0
        while True:
            if here[state] == DELETE + after[state]:
                edits.append(("I" * len(before) + "D", before, ""))
                break
            turn, kept = ALTERNATE[state], keep_to(state, initial)
            if here[state] == INSERT + here[turn]:
                before.append(ROLE_OF[turn])
                state = turn
            elif kept is not None and here[state] == extra + after[kept]:
                edits.append(("I" * len(before) + "K", before, None))
                state = kept
                break
            else:
                edits.append(("I" * len(before) + "R", before, ROLE_OF[turn]))
                state = turn
                break
    return edits, state


def damage(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of `id:turn` modulo 20; a null reads as one blank.

    0 drops a row, 1 empties its text, 2 takes its marks `.!?`, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(id), F.lit(":"), blank(turn)).cast("binary")) % 20
    read = rows.select(F.col(id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), fault.alias("fault"))
    return read.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, texts): distinct rows in order, and their texts by (conv_id, turn, role, digest).

    Places have the number of copies, the fault of the first copy, whether it is live (neither blank nor a duplicate) and
    the running number of live rows. Equal rows of one turn become one row first, so a row repeated without end is no
    hot group. Texts stay behind and meet their places once, at the end.
    """
    texts = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256)))
    fault = F.when(~F.col("text").rlike(NOT_BLANK), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    same = texts.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))
    # min over structs puts nulls first, as the order of turns does
    first = same.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).getField("turn").alias("turn")).withColumn("first", F.lit(True))
    marked = null_safe(same, first, ["conv_id", "turn", "role", "digest"], "left")
    blank, again = F.coalesce(F.col("fault") == "blank", F.lit(False)), F.col("first").isNull()
    flagged = marked.withColumns({
        "fault": F.when(again & ~blank, "duplicate").otherwise(F.col("fault")), "is_live": F.when(blank | again, 0).otherwise(1).cast("bigint"),
    }).drop("first")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return cut(running(flagged, ["conv_id"], order, place=F.lit(1).cast("bigint"), live=F.col("is_live"))), texts.select("conv_id", "turn", "role", "digest", "text")


TYPES = {
    "end": pa.list_(pa.int64()), "start": pa.list_(pa.int64()), "exits": pa.list_(pa.int64()), "place": pa.int64(),
    "edit": pa.string(), "before": pa.string(), "new_role": pa.string(),
}


def _grouped(rows: DataFrame, function, out: str) -> DataFrame:
    """Apply `function(initials, truncated, places, end, enter)` to the rows of every chunk.

    Chunks follow one another in a sorted partition: a call of Python per Arrow batch, not per conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [part.split()[0] for part in out.split(", ")]
    ordered = rows.select("conv_id", "chunk", "place", "initial", "truncated", "end", "enter").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, type_ = None, [], None
        columns: dict[str, list] = {n: [] for n in ("conv_id", "chunk", *names)}

        def close() -> None:
            places, initials, truncated, ends, enters = zip(*group)
            found = function(initials, truncated, places, ends[0], enters[0])
            for name in names:
                columns[name].extend(found[name])
            n = len(found[names[0]])
            columns["conv_id"].extend([key[0]] * n)
            columns["chunk"].extend([key[1]] * n)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, TYPES.get(n, type_ if n == "conv_id" else pa.int64())) for n, v in columns.items()], list(columns))
            for v in columns.values():
                v.clear()
            return batch

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for conv, chunk, *values in zip(*[batch[c].to_pylist() for c in ("conv_id", "chunk", "place", "initial", "truncated", "end", "enter")]):
                if key != (conv, chunk):
                    if group:
                        close()
                    key, group = (conv, chunk), []
                group.append(values)
            if columns["chunk"]:
                yield flush()
        if group:
            close()
            yield flush()

    return ordered.mapInArrow(run, f"conv_id {kind}, chunk bigint, {out}")


def _vectors(initials, truncated, places, end, enter):
    return {"end": [end], "start": [costs_of(initials, truncated, end)[0]]}


def _exits(initials, truncated, places, end, enter):
    costs = costs_of(initials, truncated, end)
    return {"exits": [[walk(initials, truncated, costs, state)[1] for state in range(4)]]}


def _edits(initials, truncated, places, end, enter):
    edits, state = walk(initials, truncated, costs_of(initials, truncated, end), enter)
    letters, before, roles = [e[0] for e in edits], ["\n".join(r + ":" for r in e[1]) for e in edits], [e[2] for e in edits]
    return {"place": [*places, END], "edit": [*letters, ""], "before": [*before, str(state)], "new_role": [*roles, ""]}


def _shape(vector: Column) -> Column:
    """A cost vector without its constant."""
    return F.transform(vector, lambda x: x - F.element_at(vector, 1))


def stitched(live: DataFrame) -> DataFrame:
    """(conv_id, chunk, end): the cost vector behind every chunk, right up to a constant.

    A chunk runs again while its successor came to another vector. A vector crosses a chunk whose rows all have an
    unknown role in one pass, so the passes are at most as many as the chunks of the longest conversation.
    """
    final = F.array(*[F.lit(x).cast("bigint") for x in FINISH])
    vectors = cut(_grouped(live.withColumn("end", final).withColumn("enter", F.lit(0)), _vectors, "end array<bigint>, start array<bigint>"))
    while True:
        wanted = vectors.where("chunk > 0").select("conv_id", (F.col("chunk") - 1).alias("chunk"), _shape(F.col("start")).alias("wanted"))
        stale = cut(null_safe(vectors, wanted, ["conv_id", "chunk"]).where(_shape(F.col("end")) != F.col("wanted")).select("conv_id", "chunk", F.col("wanted").alias("end")))
        if stale.isEmpty():
            return vectors.select("conv_id", "chunk", "end")
        again = _grouped(null_safe(live, stale, ["conv_id", "chunk"]).withColumn("enter", F.lit(0)), _vectors, "end array<bigint>, start array<bigint>")
        right = null_safe(vectors, stale.select("conv_id", "chunk", F.lit(True).alias("stale")), ["conv_id", "chunk"], "left").where("stale IS NULL").drop("stale")
        vectors = cut(right.unionByName(again), replaces=vectors)


def entered(live: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, chunk, end, enter): the state in which the least audit enters every chunk, by doubling over state maps."""
    if ends.where("chunk > 0").isEmpty():
        return ends.withColumn("enter", F.lit(START).cast("bigint"))
    maps = _grouped(null_safe(live, ends, ["conv_id", "chunk"]).withColumn("enter", F.lit(0)), _exits, "exits array<bigint>")
    at_start = F.transform("exits", lambda x: F.element_at("exits", START + 1))
    maps = cut(maps.withColumn("exits", F.when(F.col("chunk") == 0, at_start).otherwise(F.col("exits"))))
    span, known = 1, F.size(F.array_distinct("exits")) == 1
    while not maps.where(~known).isEmpty():
        earlier = maps.select("conv_id", (F.col("chunk") + span).alias("chunk"), F.col("exits").alias("earlier"))
        through = F.transform("earlier", lambda x: F.element_at("exits", (x + 1).cast("int")))
        joined = null_safe(maps.where(~known), earlier, ["conv_id", "chunk"])
        maps = cut(maps.where(known).unionByName(joined.select("conv_id", "chunk", through.alias("exits"))), replaces=maps)
        span *= 2
    before = maps.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.element_at("exits", 1).alias("enter"))
    return cut(null_safe(ends, before, ["conv_id", "chunk"], "left").withColumn("enter", F.coalesce("enter", F.lit(START).cast("bigint"))))


def edits(rows: DataFrame, texts: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The placed rows with their texts and `edit` (letters), `before` (inserted turns, one a line) and `new_role` ("" if deleted).

    A row at place END of a conversation has the turns inserted behind its last row.
    """
    live = rows.where("is_live = 1").select(
        "conv_id", F.floor((F.col("live") - 1) / chunk_rows).alias("chunk"), "place", F.substring("role", 1, 1).alias("initial"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated")
    )
    known = entered(live, stitched(live))
    found = cut(_grouped(null_safe(live, known, ["conv_id", "chunk"]), _edits, "place bigint, edit string, before string, new_role string"))
    last = found.where(F.col("place") == END).groupBy("conv_id").agg(F.max_by("before", "chunk").cast("int").alias("state"))
    inserted = F.when(F.col("state") == SYSTEM, "user:\nassistant:").when(F.col("state") == USER, "assistant:")
    ending = last.where(F.col("state").isin(SYSTEM, USER)).select(
        "conv_id", F.lit(END).alias("place"), F.when(F.col("state") == SYSTEM, "II").otherwise("I").alias("edit"), inserted.alias("before"), F.lit("").alias("new_role")
    )
    own = found.where(F.col("place") < END).select("conv_id", "place", "edit", "before", "new_role")
    whole = null_safe(null_safe(rows, own, ["conv_id", "place"], "left"), texts, ["conv_id", "turn", "role", "digest"])
    deleted = whole.withColumns({"edit": F.coalesce("edit", F.lit("D")), "new_role": F.when(F.col("edit").isNull(), "").otherwise(F.col("new_role"))})
    return deleted.unionByName(ending, allowMissingColumns=True)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Report:
    """Running figures of one conversation; the texts pass through the hash one by one."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.initial = None
        self.turns, self.audit, self.hash, self.open = 0, [], hashlib.sha256(), False

    def line(self, text: str) -> None:
        self.hash.update(("\n" + text if self.open else text).encode())
        self.open = True

    def add(self, turn, role, text, copies, fault, edit, before, new_role) -> None:
        if before:
            self.line(before)
        self.counts["cost"] += INSERT * edit.count("I")
        if copies is None:
            self.audit.append(edit)
            return
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1
        self.initial = initial
        if fault in ("blank", "duplicate"):
            self.counts[fault] += copies
        else:
            self.counts["truncated"] += fault == "truncated"
            self.counts["duplicate"] += copies - 1
        self.audit.append(edit + "D" * (copies - 1))
        self.counts["cost"] += DELETE * (copies - 1)
        if new_role == "":
            self.counts["cost"] += DELETE
        else:
            self.counts["cost"] += REROLE * (new_role is not None) + TRUNCATED * (fault == "truncated")
            self.line(f"{role if new_role is None else new_role}:{text}")

    def row(self) -> dict:
        if self.first_turn is not None:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return {**self.counts, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


READ = ("turn", "role", "text", "copies", "fault", "edit", "before", "new_role")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, copies): faults, cost, audit and digest of the repair.

    Rows stand by turn (nulls first), then role, then the SHA-256 of the text; `copies` says how often a row stands there. Blank rows and
    rows whose role and text stood earlier are always deleted. A null conv_id is a conversation of its own. A digest
    over a whole conversation is one pass over its rows: a task streams them in order and holds one letter a row and
    one batch of texts.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    done = edits(*placed(rows), chunk_rows).select("conv_id", "place", *READ)
    ordered = done.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    fields = ", ".join([f"conv_id {kind}", *[f"{c} bigint" for c in COUNTS], "audit string", "repaired_sha256 string"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, conv, finished, type_ = None, None, [], None
        def emit():
            names = [*COUNTS, "audit", "repaired_sha256"]
            ids = pa.array([c for c, _ in finished], type_)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([r[n] for _, r in finished], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]], ["conv_id", *names])

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for row_conv, *values in zip(batch["conv_id"].to_pylist(), *[batch[c].to_pylist() for c in READ]):
                if report is None or row_conv != conv:
                    if report is not None:
                        finished.append((conv, report.row()))
                    report, conv = Report(), row_conv
                report.add(*values)
            if finished:
                yield emit()
                finished = []
        if report is not None:
            finished.append((conv, report.row()))
            yield emit()

    return ordered.mapInArrow(stream, fields)


def damaged_and_repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every conversation of `rows` (conv_id, turn, role, text), damaged by `damage` and repaired; zeros where no row is left.

    Other columns are not read; the order of the rows and of equal rows changes nothing.
    """
    all_ids = rows.select("conv_id").distinct()
    found = null_safe(all_ids, repair(damage(rows), chunk_rows), ["conv_id"], "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
