"""Inductive discovery of process trees, one Spark job set per tree level.

All open nodes of all logs are handled together. The table `sublog` holds one
row per event of one trace per variant, with the variant's trace count as
weight. Per level, Spark counts directly-follows pairs per node; the counts are
at most the square of the number of activities, and the driver reads them node by
node and picks a cut from each; Spark then moves every event to its part. Sequences are
never held as a whole, neither in a row nor in a task.

Method: Leemans, Fahland and van der Aalst, inductive miner (2013) and its
variant for infrequent behaviour (2014).
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from alarmloom.operators.cuts import FollowsGraph, choose_cut
from alarmloom.operators.ordering import join_per_group, next_row, previous_row, running_total
from alarmloom.operators.sizing import cut_lineage, held_side
from alarmloom.operators.trees import Net, read_trees


def mark_frequent(pairs: DataFrame, noise: float, keys: list[str]) -> DataFrame:
    """Column `kept`: false on pairs rarer than the noise share of the strongest pair from the same source."""
    strongest = F.max("n").over(Window.partitionBy(*keys, "a"))
    return pairs.withColumn("kept", F.col("n") >= F.lit(float(noise)) * strongest)


def _count(sublog: DataFrame, log: list[str], noise: float, split: int | None) -> DataFrame:
    """Weighted counts per node, of two kinds.

    `pair`: a is directly followed by b; a is null before the first event, b
    after the last. `holds`: subtraces that hold a, however often.
    """
    node = [*log, "node"]
    sid = [*node, "sid"]
    placed = next_row(sublog, sid, "pos", ["activity"], "_next", split)
    placed = previous_row(placed, sid, "pos", ["activity"], "_prev", split)
    onward = F.struct(F.col("activity").alias("a"), F.col("_next.activity").alias("b"))
    opening = F.struct(F.lit(None).cast("string").alias("a"), F.col("activity").alias("b"))
    both = F.when(F.col("_prev").isNull(), F.array(onward, opening)).otherwise(F.array(onward))
    pairs = (
        placed.select(*node, "weight", F.explode(both).alias("_p"))
        .groupBy(*node, "_p.a", "_p.b")
        .agg(F.sum("weight").alias("n"))
    )
    once = sublog.groupBy(*sid, F.col("activity").alias("a")).agg(F.max("weight").alias("_w"))
    holds = once.groupBy(*node, "a").agg(F.sum("_w").alias("n"))
    return (
        mark_frequent(pairs, noise, node)
        .withColumn("kind", F.lit("pair"))
        .unionByName(holds.withColumns({"kind": F.lit("holds"), "b": F.lit(None).cast("string"), "kept": F.lit(True)}))
    )


def _graphs(counts: DataFrame, log: list[str]) -> Iterator[tuple[tuple, FollowsGraph]]:
    """Open nodes with their graphs, one at a time: the driver holds the pairs of one node only."""
    key, graph = None, FollowsGraph()
    for row in counts.orderBy(*log, "node").toLocalIterator():
        own = (*(row[c] for c in log), row["node"])
        if key is not None and own != key:
            yield key, graph
            graph = FollowsGraph()
        key = own
        graph.add(row["kind"], row["a"], row["b"], row["n"], row["kept"])
    if key is not None:
        yield key, graph


def discover_trees(
    steps: DataFrame, log: list[str], noise: float = 0.0, split: int | None = None
) -> DataFrame:
    """Process tree per log as a table of nodes.

    steps holds log, sid, pos, activity and weight. With noise 0 every trace
    fits its tree.
    """
    spark = steps.sparkSession
    sublog = steps.select(*log, F.lit("0").alias("node"), "sid", "pos", "activity", "weight")
    sublog = cut_lineage(sublog)
    total: dict[tuple, int] = {}
    tree_rows: list[tuple] = []
    schema = _tree_schema(steps, log)
    assign_type = _assign_schema(steps, log)
    while True:
        assigned: list[tuple] = []
        for key, graph in _graphs(_count(sublog, log, noise, split), log):
            _Place(key, graph, noise, total, tree_rows, assigned).grow()
        if not assigned:
            break
        moves = {row[-3] for row in assigned}
        targets = held_side(spark.createDataFrame(assigned, assign_type), len(assigned))
        # A level reads the one before several times, so plans would double with every level.
        sublog = cut_lineage(_move(sublog, targets, moves, log, split))
    return spark.createDataFrame(tree_rows, schema)


class _Place:
    """One open node: adds its tree rows, and the moves of its events to new nodes."""

    def __init__(self, key: tuple, graph: FollowsGraph, noise: float, total: dict, tree_rows: list, assigned: list):
        self.key, self.node, self.graph, self.noise = key[:-1], key[-1], graph, noise
        self.everything = total.pop(key, graph.n_traces)
        self.total, self.tree_rows, self.assigned = total, tree_rows, assigned

    def grow(self) -> None:
        graph = self.graph
        if self._optional(self.everything, graph.n_traces):
            self._row(self.node, "xor")
            self._row(f"{self.node}.0", "tau")
            self._child(1, sorted(graph.activities), graph.n_traces)
        elif len(graph.activities) == 1:
            self._single(self.node, *graph.activities, repeated=graph.n_events > graph.n_traces)
        elif cut := choose_cut(graph):
            operator, parts = cut
            self._row(self.node, operator)
            move = "loop" if operator == "loop" else "choose" if operator == "xor" and self.noise > 0 else "keep"
            shared = graph.n_traces if operator in ("sequence", "parallel") else None
            for i, part in enumerate(parts):
                self._child(i, part, shared, move)
        else:
            self._fall_through()

    def _fall_through(self) -> None:
        """No cut: an activity that every trace has once, else rounds, else any order."""
        graph = self.graph
        once = [a for a in sorted(graph.activities) if graph.n_traces == graph.holds[a] == graph.occurrences[a]]
        turns = any((e, s) in graph.edges for e in graph.ends for s in graph.starts)
        restarts = any(s in graph.starts for _, s in graph.edges)
        if once:
            self._row(self.node, "parallel")
            self._row(f"{self.node}.0", "activity", once[0])
            self._child(1, sorted(graph.activities - {once[0]}), graph.n_traces)
            return
        self._row(self.node, "loop")
        self._row(f"{self.node}.1", "tau")
        if turns or restarts:
            self._child(0, sorted(graph.activities), None, "turn" if turns else "start")
        else:
            self._row(f"{self.node}.0", "xor")
            for j, activity in enumerate(sorted(graph.activities)):
                self._row(f"{self.node}.0.{j}", "activity", activity)

    def _row(self, node: str, operator: str, activity: str | None = None) -> None:
        parent, _, position = node.rpartition(".")
        self.tree_rows.append((*self.key, node, parent or None, int(position), operator, activity))

    def _optional(self, everything: int, present: int) -> bool:
        return everything - present > self.noise * everything

    def _single(self, node: str, activity: str, repeated: bool, optional: bool = False) -> None:
        """Leaf rows of a part with one activity."""
        if optional:
            self._row(node, "xor")
            self._row(f"{node}.0", "tau")
            node = f"{node}.1"
        if repeated:
            self._row(node, "loop")
            self._row(f"{node}.0", "activity", activity)
            self._row(f"{node}.1", "tau")
        else:
            self._row(node, "activity", activity)

    def _child(self, i: int, activities: list[str], weight: int | None, move: str = "keep") -> None:
        """Part i. One activity is settled by the counts at hand; events of more go on to a new node.

        weight is the number of subtraces of the part, empty ones included.
        """
        graph, name = self.graph, f"{self.node}.{i}"
        if len(activities) == 1 and move in ("keep", "loop"):
            (activity,) = activities
            held = graph.holds[activity]
            if move == "loop":
                self._single(name, activity, activity in graph.own_successors)
            else:
                optional = weight is not None and self._optional(weight, held)
                self._single(name, activity, graph.occurrences[activity] > held, optional)
            return
        if weight is not None:
            self.total[(*self.key, name)] = weight
        for activity in activities:
            starts, ends = activity in graph.starts, activity in graph.ends
            self.assigned.append((*self.key, self.node, activity, name, i, move, starts, ends))


def _log_types(steps: DataFrame, log: list[str]) -> str:
    return "".join(f"{c} {steps.schema[c].dataType.simpleString()}, " for c in log)


def _tree_schema(steps: DataFrame, log: list[str]) -> str:
    return _log_types(steps, log) + "node string, parent string, position int, operator string, activity string"


def _assign_schema(steps: DataFrame, log: list[str]) -> str:
    return (
        _log_types(steps, log)
        + "node string, activity string, child string, part int, move string, is_start boolean, is_end boolean"
    )


def _move(
    sublog: DataFrame, assigned: DataFrame, moves: set[str], log: list[str], split: int | None
) -> DataFrame:
    """Events of the nodes that were cut, under their new node and subtrace id."""
    sid = [*log, "node", "sid"]
    placed = sublog.join(assigned, [*log, "node", "activity"])
    kept = placed.where("move = 'keep'")
    if "choose" in moves:
        kept = kept.unionByName(_main_part(placed.where("move = 'choose'"), sid, split))
    if moves & {"loop", "turn", "start"}:
        looped = placed.where("move in ('loop', 'turn', 'start')")
        before = previous_row(looped, sid, "pos", ["part", "is_end"], "_prev", split)
        opens = (
            F.when(F.col("_prev").isNull(), True)
            .when(F.col("move") == "loop", F.col("_prev.part") != F.col("part"))
            .when(F.col("move") == "turn", F.col("_prev.is_end") & F.col("is_start"))
            .otherwise(F.col("is_start"))
        )
        flagged = before.withColumn("_opens", opens.cast("bigint")).drop("_prev")
        rounds = running_total(flagged, sid, "pos", F.col("_opens"), "_round", split)
        kept = kept.unionByName(
            rounds.withColumn("sid", F.concat_ws("/", "sid", F.col("_round").cast("string"))).drop("_opens", "_round")
        )
    return kept.select(*log, F.col("child").alias("node"), "sid", "pos", "activity", "weight")


def _main_part(placed: DataFrame, sid: list[str], split: int | None) -> DataFrame:
    """With noise, a trace goes to the part that holds most of its events; the others are dropped."""
    counts = placed.groupBy(*sid, "part").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    chosen = counts.groupBy(*sid).agg(
        F.max_by("part", F.struct("_n", -F.col("part"))).alias("_main"), F.max("_last").alias("_last")
    )
    return join_per_group(placed, chosen, sid, "pos", split, "inner").where("part = _main").drop("_main")


def net_tables(tree: DataFrame, log: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of the workflow net of every tree."""
    spark = tree.sparkSession
    nodes, arcs = [], []
    for key, root in sorted(read_trees([r.asDict() for r in tree.collect()], log).items()):
        net = Net(root)
        for place in range(net.n_places):
            marking = "initial" if place == net.source else "final" if place == net.sink else None
            nodes.append((*key, f"p{place}", "place", None, marking))
        for number, (label, sources, targets) in enumerate(net.transitions):
            nodes.append((*key, f"t{number}", "transition", label, None))
            arcs.extend((*key, f"p{place}", f"t{number}") for place in sources)
            arcs.extend((*key, f"t{number}", f"p{place}") for place in targets)
    keys = _log_types(tree, log)
    return (
        spark.createDataFrame(nodes, keys + "node string, kind string, activity string, marking string"),
        spark.createDataFrame(arcs, keys + "source string, target string"),
    )
