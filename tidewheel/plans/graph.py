"""The graph of a program: same-step edges, history edges, cycles, order, and renderings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass
class Graph:
    """Edges (from, to, label): ``same`` must be acyclic; ``history`` reads committed rows."""

    nodes: list[str]
    same: list[tuple[str, str, str]] = field(default_factory=list)
    history: list[tuple[str, str, str]] = field(default_factory=list)

    def order(self) -> list[str]:
        """Nodes after all they read in the same step, else in the given order."""
        needs = {n: [a for a, b, _ in self.same if b == n] for n in self.nodes}
        out, state = [], {}

        for start in self.nodes:
            path = [(start, iter(needs[start]))]
            if start in state:
                continue
            state[start] = "open"
            while path:
                node, rest = path[-1]
                for n in rest:
                    if n not in needs:
                        raise ValueError(f"{node!r} reads {n!r}, which isn't there")
                    if state.get(n) == "open":
                        raise ValueError("same-step cycle: " + " -> ".join([x for x, _ in path] + [n]))
                    if n not in state:
                        state[n] = "open"
                        path.append((n, iter(needs[n])))
                        break
                else:
                    state[node] = "done"
                    out.append(node)
                    path.pop()
        return out

    def feedback(self) -> list[set[str]]:
        """Groups of partitions that read each other, through history too: their rows can only
        be made in sequence."""
        edges: dict[str, set[str]] = {n: set() for n in self.nodes}
        for a, b, _ in [*self.same, *self.history]:
            edges[a].add(b)
        reach = {n: _reach(n, edges) for n in self.nodes}
        groups, seen = [], set()
        for n in self.nodes:
            if n not in seen and n in reach[n]:
                group = {m for m in reach[n] if n in reach[m]}
                groups.append(group)
                seen |= group
        return groups

    def mermaid(self) -> str:
        ids = {n: f"p{i}" for i, n in enumerate(self.nodes)}
        lines = ["graph TD", *[f'    {ids[n]}["{n}"]' for n in self.nodes]]
        lines += [f"    {ids[a]} -->|{x}| {ids[b]}" for a, b, x in self.same]
        lines += [f"    {ids[a]} -.->|{x}| {ids[b]}" for a, b, x in self.history]
        return "\n".join(lines)

    def dot(self) -> str:
        lines = ["digraph program {", *[f'  "{n}";' for n in self.nodes]]
        lines += [f'  "{a}" -> "{b}" [label="{x}"];' for a, b, x in self.same]
        lines += [f'  "{a}" -> "{b}" [label="{x}", style=dashed];' for a, b, x in self.history]
        return "\n".join([*lines, "}"])


def _reach(start: str, edges: dict[str, set[str]]) -> set[str]:
    seen: set[str] = set()
    todo: list[str] = list(edges[start])
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += edges[n]
    return seen


def of(partitions: Iterable) -> Graph:
    ps = list(partitions)
    g = Graph([p.name for p in ps])
    for p in ps:
        g.same += [(u["upstream"], p.name, k) for k, u in p.params_from_upstream.items()]
        g.history += [(n, p.name, k) for k, names in p.params_as_partitions.items() for n in names]
    return g
