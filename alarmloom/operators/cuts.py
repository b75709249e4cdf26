"""Choice of a cut for one directly-follows graph (a few dozen activities)."""

from collections import Counter
from dataclasses import dataclass, field


@dataclass
class FollowsGraph:
    """Directly-follows counts of one sublog."""

    edges: dict[tuple[str, str], int] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)
    ends: set[str] = field(default_factory=set)
    activities: set[str] = field(default_factory=set)
    occurrences: Counter = field(default_factory=Counter)
    holds: Counter = field(default_factory=Counter)
    own_successors: set[str] = field(default_factory=set)
    n_events: int = 0
    n_traces: int = 0

    def add(self, kind: str, a: str | None, b: str | None, n: int, kept: bool) -> None:
        """Take in one count; pairs that are not kept count as events but not as edges."""
        if kind == "holds":
            self.holds[a] += n
        elif a is None:
            self.n_traces += n
            if kept:
                self.starts.add(b)
        else:
            self.activities.add(a)
            self.occurrences[a] += n
            self.n_events += n
            if a == b:
                self.own_successors.add(a)
            if kept and b is None:
                self.ends.add(a)
            elif kept:
                self.edges[a, b] = n

    def follows(self, a: str, b: str) -> bool:
        return (a, b) in self.edges


def _components(items: list[str], linked) -> list[list[str]]:
    """Connected components under a symmetric relation, in order of first item."""
    left, found = list(items), []
    while left:
        group, frontier = [], [left.pop(0)]
        while frontier:
            item = frontier.pop()
            group.append(item)
            near = [other for other in left if linked(item, other)]
            left = [other for other in left if other not in near]
            frontier.extend(near)
        found.append(sorted(group))
    return found


def _reachable(graph: FollowsGraph) -> dict[str, set[str]]:
    after = {a: {b for b in graph.activities if graph.follows(a, b)} for a in graph.activities}
    reach = {}
    for a in graph.activities:
        seen, stack = set(), list(after[a])
        while stack:
            b = stack.pop()
            if b not in seen:
                seen.add(b)
                stack.extend(after[b] - seen)
        reach[a] = seen
    return reach


def exclusive_cut(graph: FollowsGraph) -> list[list[str]]:
    return _components(
        sorted(graph.activities), lambda a, b: graph.follows(a, b) or graph.follows(b, a)
    )


def sequence_cut(graph: FollowsGraph) -> list[list[str]]:
    """Groups that are reached in one direction only, in that direction."""
    reach = _reachable(graph)

    def mixed(xs: list[str], ys: list[str]) -> bool:
        forward = any(y in reach[x] for x in xs for y in ys)
        backward = any(x in reach[y] for x in xs for y in ys)
        return forward == backward

    groups = [[a] for a in sorted(graph.activities)]
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            j = next((j for j in range(i + 1, len(groups)) if mixed(groups[i], groups[j])), None)
            if j is not None:
                groups[i] = sorted(groups[i] + groups.pop(j))
                merged = True
                break
    return sorted(groups, key=lambda g: -sum(any(y in reach[x] for x in g for y in h) for h in groups if h is not g))


def concurrent_cut(graph: FollowsGraph) -> list[list[str]]:
    """Groups whose activities follow each other both ways; each can start and end a trace."""
    groups = _components(
        sorted(graph.activities), lambda a, b: not (graph.follows(a, b) and graph.follows(b, a))
    )
    whole = [g for g in groups if graph.starts & set(g) and graph.ends & set(g)]
    rest = sorted(a for g in groups if g not in whole for a in g)
    if rest and whole:
        whole[0] = sorted(whole[0] + rest)
    return whole


def loop_cut(graph: FollowsGraph) -> list[list[str]]:
    """A body that starts and ends every round, and the redo parts between rounds."""
    body = graph.starts | graph.ends
    inner = sorted(graph.activities - body)
    redo = []
    for group in _components(inner, lambda a, b: graph.follows(a, b) or graph.follows(b, a)):
        entered = {(b, a) for a in group for b in body if graph.follows(b, a)}
        left = {(a, b) for a in group for b in body if graph.follows(a, b)}
        into, out_of = {a for _, a in entered}, {a for a, _ in left}
        fits = (
            entered
            and left
            and all(b in graph.ends for b, _ in entered)
            and all(b in graph.starts for _, b in left)
            and all((b, a) in entered for a in into for b in graph.ends)
            and all((a, b) in left for a in out_of for b in graph.starts)
        )
        if fits:
            redo.append(group)
        else:
            body |= set(group)
    return [sorted(body), *redo]


def choose_cut(graph: FollowsGraph) -> tuple[str, list[list[str]]] | None:
    """First cut with at least two parts: exclusive, sequence, concurrent, loop."""
    for operator, cut in (
        ("xor", exclusive_cut),
        ("sequence", sequence_cut),
        ("parallel", concurrent_cut),
        ("loop", loop_cut),
    ):
        parts = cut(graph)
        if len(parts) > 1:
            return operator, parts
    return None
