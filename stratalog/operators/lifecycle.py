"""Generations: transitions, ancestry, and the atomic pointer to the active one."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

def latest_committed(generations: DataFrame) -> DataFrame:
    """workspace_id, generation_id, sequence_no of each workspace's last committed generation."""
    best = F.max(F.struct("sequence_no", "generation_id")).alias("b")
    return generations.where("state = 'committed'").groupBy("workspace_id").agg(best).select("workspace_id", "b.generation_id", "b.sequence_no")


def doctor(generations: DataFrame) -> DataFrame:
    """The generations, with candidates that are older than their workspace's last committed one abandoned."""
    last = latest_committed(generations).select("workspace_id", F.col("sequence_no").alias("_last"))
    rows = generations.join(last, "workspace_id", "left")
    left = (F.col("state") == "candidate") & (F.col("sequence_no") < F.col("_last"))
    return rows.withColumn("state", F.when(left, "abandoned").otherwise(F.col("state"))).drop("_last")


def judge_transitions(generations: DataFrame, active: DataFrame, asked: DataFrame) -> DataFrame:
    """workspace_id, generation_id, action, state, accepted, active_id: only a candidate can be activated, failed or abandoned.

    active: workspace_id, active_id. Each request is judged by itself; a rejected or failed candidate leaves the active
    generation as it is.
    """
    on = ["workspace_id", "generation_id"]
    rows = asked.join(generations.select(*on, "state"), on, "left").join(active.select("workspace_id", "active_id"), "workspace_id", "left")
    accepted = F.coalesce(F.col("state") == "candidate", F.lit(False))
    now = F.when(accepted & (F.col("action") == "activate"), F.col("generation_id")).otherwise(F.col("active_id"))
    return rows.select(*on, "action", F.coalesce("state", F.lit("absent")).alias("state"), accepted.alias("accepted"), now.alias("active_id"))


class Ancestry:
    """Ancestors by pointer doubling: `up` of level k leads 2^k parents up, so chains of any length take log rounds.

    Every join is shuffled and sorted: a level is small on disk and would be broadcast at each of the rounds, through the driver.

    generations: generation_id (unique) and parent_id (null, or one that is not there, at a root). Raises where parents form a
    cycle: after more rounds than the nodes' number has bits, a node in or above a cycle still has an ancestor.
    """

    def __init__(self, generations: DataFrame):
        rows = generations.select(F.col("generation_id").alias("node"), F.col("parent_id").alias("up"))
        known = rows.select(F.col("node").alias("up"))
        self._up = [cut(rows.where("up IS NOT NULL").join(known.hint("merge"), "up", "left_semi").select("node", "up"), "ancestors")]
        self.nodes, n = known.withColumnRenamed("up", "node"), self._up[0].count()
        most = n.bit_length()  # a chain has n parents at most, fewer than 2^most
        while True:
            last = self._up[-1]
            above = cut(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("next")).hint("merge"), "up").select("node", F.col("next").alias("up")), "ancestors")
            if above.isEmpty():
                break
            if len(self._up) > most:
                raise ValueError("the parents form a cycle")
            self._up.append(above)

    def depths(self) -> DataFrame:
        """generation_id, depth: how many ancestors each has. Far parents first: who has one 2^k up moves there."""
        at = self.nodes.withColumn("at", F.col("node")).withColumn("depth", F.lit(0).cast("long"))
        for k in range(len(self._up) - 1, -1, -1):
            step = self._up[k].select(F.col("node").alias("at"), F.col("up").alias("higher"))
            at = at.join(step.hint("merge"), "at", "left").select("node", F.coalesce("higher", "at").alias("at"), (F.col("depth") + F.when(F.col("higher").isNotNull(), 2**k).otherwise(0)).alias("depth"))
            at = cut(at, "depths")
        return at.select(F.col("node").alias("generation_id"), "depth")

    def judge(self, pairs: DataFrame) -> DataFrame:
        """older, newer, is_ancestor, distance (null where it is none; 0 for a generation and itself)."""
        d = self.depths()
        rows = pairs.select("older", "newer").distinct().join(d.select(F.col("generation_id").alias("older"), F.col("depth").alias("d_old")).hint("merge"), "older", "left")
        rows = rows.join(d.select(F.col("generation_id").alias("newer"), F.col("depth").alias("d_new")).hint("merge"), "newer", "left")
        rows = rows.withColumn("distance", F.col("d_new") - F.col("d_old")).withColumn("at", F.when(F.col("distance") >= 0, F.col("newer")))
        for k, up in enumerate(self._up):  # lift the newer one by the bits of the distance
            step = up.select(F.col("node").alias("at"), F.col("up").alias("higher"))
            rows = rows.join(step.hint("merge"), "at", "left")
            rows = cut(rows.withColumn("at", F.when(F.shiftright("distance", k) % 2 == 1, F.col("higher")).otherwise(F.col("at"))).drop("higher"), "lifted")
        yes = F.coalesce(F.col("at") == F.col("older"), F.lit(False))
        return rows.select("older", "newer", yes.alias("is_ancestor"), F.when(yes, F.col("distance")).alias("distance"))


class Manifest:
    """The active generation of a folder of snapshots, swapped by renaming one small file."""

    def __init__(self, folder: str):
        self._file = Path(folder) / "manifest.json"

    def read(self) -> dict:
        return json.loads(self._file.read_text()) if self._file.exists() else {"active": None, "generations": {}}

    def _write(self, state: dict) -> None:
        self._file.parent.mkdir(parents=True, exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=self._file.parent)
        with os.fdopen(fd, "w") as f:
            json.dump(state, f, sort_keys=True)
        os.replace(tmp, self._file)

    def begin(self, generation: str) -> None:
        state = self.read()
        if generation in state["generations"]:
            raise ValueError(f"{generation} exists")
        state["generations"][generation] = {"state": "candidate", "parent": state["active"], "sequence": 1 + len(state["generations"])}
        self._write(state)

    def finish(self, generation: str, state_name: str) -> None:
        """`committed` makes it the active one; `failed` and `abandoned` leave that as it is."""
        state = self.read()
        if state["generations"].get(generation, {}).get("state") != "candidate":
            raise ValueError(f"{generation} is no candidate")
        state["generations"][generation]["state"] = state_name
        if state_name == "committed":
            state["active"] = generation
        self._write(state)
