"""Commands on finite state machines, replayed as a parallel prefix.

A command is a map from states to states, and maps compose: so blocks of commands are composed first, then blocks of blocks,
and then the state that each block meets is handed down again. A case of any number of commands is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import materialize, release

from .ordering import placed

REFUSED = -1


def table_of(states: Sequence[tuple], actions: Sequence[str], step: Callable[[tuple, str], tuple | None]) -> list[list[int]]:
    """For each action the number of the next state by state; REFUSED where step() gives none."""
    number = {s: n for n, s in enumerate(states)}
    return [[REFUSED if (to := step(s, a)) is None else number[to] for s in states] for a in actions]


def replay(commands: DataFrame, case: str, order: list[str], code: str, tables: list[list[int]], start: int = 0, block: int = 256) -> DataFrame:
    """commands (case, order, code: an index of tables) with before, after (numbers of states) and refused.

    Within a case commands follow `order`, which has no ties. A refused command changes nothing; so does one whose code is
    null or no index, which is refused. Rows without a case are one case. Other columns are kept, but for `before`, `after`
    and `refused`. Levels grow with the logarithm of the longest case. No join broadcasts: tables of states are small files
    of as many rows as there are commands.
    """
    n = len(tables[0])
    total = F.lit([[s if to == REFUSED else to for s, to in enumerate(t)] for t in tables] + [list(range(n))])
    known = F.when(F.col(code).between(0, len(tables) - 1), F.col(code)).otherwise(len(tables)).cast("int")
    rows = placed(commands.withColumn("__code", known).drop("before", "after", "refused"), [case, *order], "__place")
    first = rows.groupBy(case).agg(F.min("__place").alias("__first")).withColumnRenamed(case, "__case")
    rows = rows.join(first.hint("merge"), rows[case].eqNullSafe(first["__case"])).withColumn("__at", F.col("__place") - F.col("__first")).drop("__place", "__first", "__case")
    rows = materialize(rows, "commands")

    group = F.floor(F.col("at") / block).alias("group")
    after = lambda row, s: F.element_at(F.element_at(total, row["code"] + 1), s + 1) if "code" in fields else F.element_at(row["moves"], s + 1)
    gathered = lambda df, what: df.groupBy("case", group).agg(F.sort_array(F.collect_list(F.struct("at", what))).alias("rows"))
    levels, fields = [rows.select(F.col(case).alias("case"), F.col("__at").alias("at"), F.col("__code").alias("code"))], ["code"]
    while True:
        blocks = materialize(gathered(levels[-1], fields[0]), "blocks")
        levels[-1] = blocks
        if not blocks.where("group > 0").limit(1).count():
            break
        state = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.aggregate("rows", s, lambda a, r: after(r, a)))  # noqa: B023
        levels.append(blocks.select("case", F.col("group").alias("at"), state.alias("moves")))
        fields = ["moves"]
    met = blocks.select("case", "group", F.lit(start).alias("state"))
    for depth in range(len(levels) - 1, -1, -1):
        fields = ["code"] if depth == 0 else ["moves"]
        begin = F.struct(F.col("state").alias("now"), F.array().cast("array<struct<at:bigint,before:int,after:int>>").alias("out"))

        def onward(a, r):  # noqa: ANN001, ANN202
            to = after(r, a["now"])
            return F.struct(to.alias("now"), F.concat(a["out"], F.array(F.struct(r["at"].alias("at"), a["now"].alias("before"), to.alias("after")))).alias("out"))

        here = met.withColumnsRenamed({"case": "c", "group": "g"})
        joined = levels[depth].join(here.hint("merge"), F.col("case").eqNullSafe(F.col("c")) & (F.col("group") == F.col("g")))
        met = materialize(joined.select("case", F.explode(F.aggregate("rows", begin, onward)["out"]).alias("x")).select("case", F.col("x.at").alias("group"), F.col("x.before").alias("state"), F.col("x.after").alias("after")), "states")
    met = met.select(F.col("case").alias("__case"), F.col("group").alias("__group"), F.col("state").alias("before"), "after")
    done = rows.join(met.hint("merge"), F.col(case).eqNullSafe(F.col("__case")) & (F.col("__at") == F.col("__group"))).drop("__case", "__group")
    legal = F.lit([[to != REFUSED for to in t] for t in tables] + [[False] * n])
    out = done.withColumn("refused", ~F.element_at(F.element_at(legal, F.col("__code") + 1), F.col("before") + 1)).drop("__code", "__at")
    release(*levels)
    return out


#: A moderation case's visibility, membership, audit, appeal and whether it is closed, and its actions.
PARTS = {"visibility": ("shown", "hidden"), "membership": ("active", "paused"), "audit": ("none", "open", "completed"), "appeal": ("none", "filed", "decided"), "closed": ("no", "yes")}
MODERATION_STATES = list(product(*PARTS.values()))
MODERATION_ACTIONS = ("content_hidden", "content_restored", "reviewer_suspended", "reviewer_reinstated", "review_audit_opened", "review_audit_completed", "appeal_filed", "appeal_upheld", "appeal_denied", "case_closed")


def moderate(state: tuple, action: str) -> tuple | None:
    """A moderation case's next state, None where the action isn't legal.

    Content is hidden once and restored only if hidden, a membership likewise; an audit is opened and completed once. An
    appeal is filed once, against hidden content or a suspension, and decided once; upheld, it undoes both. A closed case
    doesn't change.
    """
    visibility, membership, audit, appeal, closed = state
    if closed == "yes":
        return None
    rules = {
        "content_hidden": (visibility != "hidden", {0: "hidden"}), "content_restored": (visibility == "hidden", {0: "shown"}),
        "reviewer_suspended": (membership == "active", {1: "paused"}), "reviewer_reinstated": (membership == "paused", {1: "active"}),
        "review_audit_opened": (audit == "none", {2: "open"}), "review_audit_completed": (audit == "open", {2: "completed"}),
        "appeal_filed": (appeal == "none" and (visibility == "hidden" or membership == "paused"), {3: "filed"}),
        "appeal_upheld": (appeal == "filed", {0: "shown", 1: "active", 3: "decided"}), "appeal_denied": (appeal == "filed", {3: "decided"}), "case_closed": (True, {4: "yes"}),
    }
    legal, change = rules[action]
    return tuple(change.get(k, x) for k, x in enumerate(state)) if legal else None


def replay_moderation(commands: DataFrame, case: str, order: list[str], action: str, block: int = 256) -> DataFrame:
    """commands with refused and the case's PARTS after each. An unknown action is refused."""
    codes = F.array_position(F.lit(list(MODERATION_ACTIONS)), F.col(action)) - 1
    done = replay(commands.withColumn("__action", codes), case, order, "__action", table_of(MODERATION_STATES, MODERATION_ACTIONS, moderate), block=block)
    part = lambda k: F.element_at(F.lit([s[k] for s in MODERATION_STATES]), F.col("after") + 1)
    return done.withColumns({p: part(k) for k, p in enumerate(PARTS)}).drop("__action", "before", "after")
