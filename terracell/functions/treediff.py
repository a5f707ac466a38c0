"""Edit distance between nested schemas, as a minimum-cost script.

A schema is a tree: a node has a name, a kind and children. Children have no order, so the
distance is the constrained one for unordered trees: fields of one name under matched
parents are matched, the fields left over on both sides are matched with each other at
least total cost (Hungarian method), and the rest is deleted or added with all below it. A
node that is deleted in one place and added under another parent with the same values has
moved. Costs: one for each node deleted or added, one for a rename or a move, one half for a
changed kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

RENAME, RETYPE = 1.0, 0.5
NEVER = 1e9

Path = tuple[str, ...]


@dataclass
class Node:
    name: str
    kind: str
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def walk(self, path: Path) -> Iterator[tuple[Path, Node]]:
        """The node at ``path`` and all below it."""
        yield path, self
        for c in self.children:
            yield from c.walk((*path, c.name))


@dataclass
class Edit:
    kind: str  # added, removed, renamed, retyped, moved
    old: Path
    new: Path
    cost: float
    old_kind: str = ""
    new_kind: str = ""


def tree(fields: list[tuple[Path, str]]) -> Node:
    """The schema tree of all paths and their kinds; a parent that is not listed is an object."""
    root = Node("", "object")
    at: dict[Path, Node] = {(): root}

    def place(path: Path) -> Node:
        if path not in at:
            at[path] = Node(path[-1], "object")
            place(path[:-1]).children.append(at[path])
        return at[path]

    for path, kind in sorted(fields):
        place(path).kind = kind
    return root


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a least-cost matching of a square matrix."""
    n = len(cost)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0] = i
        j0, least, used = 0, [NEVER * 10] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], NEVER * 10, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def diff(old: Node, new: Node, same_values: Callable[[Path, Path], bool]) -> list[Edit]:
    """The least-cost script from one schema to the other.

    ``same_values(a, b)`` says whether the field at path ``a`` of the old and ``b`` of the
    new schema hold the same values: only then may one be a rename of the other, where their
    parents are matched, or have moved to the other, where they are not.
    """
    gone: list[tuple[Path, Node]] = []
    come: list[tuple[Path, Node]] = []
    script = _children(old, new, (), (), same_values, gone, come)
    below = [(path, node, top) for top, start in gone for path, node in start.walk(top)]
    above = [(path, node, top) for top, start in come for path, node in start.walk(top)]
    pairs = [(x, y) for x in below for y in above if x[0][:-1] != y[0][:-1] and same_values(x[0], y[0])]
    cost = {("old", path): float(node.size()) for path, node in gone} | {("new", path): float(node.size()) for path, node in come}
    taken: set[tuple[str, Path]] = set()

    def free(side: str, path: Path) -> bool:
        """Neither the node nor one above or below it has moved."""
        return not any(s == side and (path[: len(t)] == t or t[: len(path)] == path) for s, t in taken)

    # the same name before another one, whole subtrees before their parts
    for (was, a, top), (now, b, over) in sorted(pairs, key=lambda p: (p[0][0][-1] != p[1][0][-1], len(p[0][0]), p[0][0], p[1][0])):
        if free("old", was) and free("new", now):
            taken |= {("old", was), ("new", now)}
            cost["old", top] -= a.size()
            cost["new", over] -= b.size()
            script.append(Edit("moved", was, now, RENAME, a.kind, b.kind))
    script += [Edit("removed", p, (), cost["old", p], n.kind, "") for p, n in gone if ("old", p) not in taken]
    script += [Edit("added", (), p, cost["new", p], "", n.kind) for p, n in come if ("new", p) not in taken]
    return sorted(script, key=lambda e: (e.old, e.new))


def _children(old: Node, new: Node, at: Path, to: Path, same: Callable, gone: list, come: list) -> list[Edit]:
    """The edits below two matched nodes; what is left over goes to ``gone`` and ``come``."""
    script: list[Edit] = []
    was, now = {c.name: c for c in old.children}, {c.name: c for c in new.children}
    for name in sorted(was.keys() & now.keys()):
        x, y = was[name], now[name]
        if x.kind != y.kind and "null" not in (x.kind, y.kind):
            script.append(Edit("retyped", (*at, name), (*to, name), RETYPE, x.kind, y.kind))
        if {"array", "object"} & set(x.kind.split("|")) & set(y.kind.split("|")):  # else what lies below went with the kind
            script += _children(x, y, (*at, name), (*to, name), same, gone, come)
    a = [was[n] for n in sorted(was.keys() - now.keys())]
    b = [now[n] for n in sorted(now.keys() - was.keys())]
    n = len(a) + len(b)
    alike = [[same((*at, x.name), (*to, y.name)) for y in b] for x in a]
    if any(map(any, alike)):
        cost = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                if i < len(a) and j < len(b):
                    cost[i][j] = RENAME if alike[i][j] else NEVER
                elif i < len(a):
                    cost[i][j] = float(a[i].size()) if j - len(b) == i else NEVER
                elif j < len(b):
                    cost[i][j] = float(b[j].size()) if i - len(a) == j else NEVER
        match = assign(cost)
    else:
        match = [len(b) + i for i in range(len(a))] + list(range(len(b)))
    kept = set()
    for i, x in enumerate(a):
        j = match[i]
        if j < len(b):
            y = b[j]
            kept.add(j)
            script.append(Edit("renamed", (*at, x.name), (*to, y.name), RENAME, x.kind, y.kind))
            script += _children(x, y, (*at, x.name), (*to, y.name), same, gone, come)
        else:
            gone.append(((*at, x.name), x))
    come += [((*to, y.name), y) for j, y in enumerate(b) if j not in kept]
    return script
