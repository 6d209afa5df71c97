"""Many literals at once: an automaton that finds all overlapping hits, its stored form, a prefix gate, and covers proven from patterns.

The automaton is built on the driver from a dictionary and goes to the executors as arrays; texts that no literal's beginning is found in are
left out before any Python runs.
"""

from __future__ import annotations

import re._parser as parser
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exact strings that a part of a pattern may stand for before only its cover is kept.
EXACT = 16
#: Characters of a literal's beginning that the gate looks for.
PREFIX = 4


class Automaton:
    """Trie with failure links. `find` gives every (literal number, start, end), overlapping ones too, in order of end, then longest first."""

    def __init__(self, literals: Iterable[str]) -> None:
        self.literals = sorted({x for x in literals if x})
        self.next: list[dict[str, int]] = [{}]
        self.out: list[list[int]] = [[]]
        for number, literal in enumerate(self.literals):
            at = 0
            for c in literal:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append([])
                at = self.next[at][c]
            self.out[at].append(number)
        self._link()

    def _link(self) -> None:
        self.fail = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0) if self.next[back].get(c, 0) != to else 0
                self.out[to] = self.out[to] + self.out[self.fail[to]]
                todo.append(to)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        at, hits = 0, []
        step, fail, out, literals = self.next, self.fail, self.out, self.literals
        for i, c in enumerate(text):
            while at and c not in step[at]:
                at = fail[at]
            at = step[at].get(c, 0)
            if out[at]:
                hits += [(n, i + 1 - len(literals[n]), i + 1) for n in out[at]]
        return hits

    def store(self) -> dict[str, list]:
        """Stable arrays: literals, and the trie's edges in order of their source and character."""
        edges = [(a, c, b) for a, d in enumerate(self.next) for c, b in sorted(d.items())]
        return {"literals": list(self.literals), "source": [e[0] for e in edges], "character": [e[1] for e in edges], "target": [e[2] for e in edges]}

    @classmethod
    def restore(cls, stored: dict[str, list]) -> Automaton:
        """From store(); bounds, counts and the place of every literal are checked."""
        source, character, target, literals = (list(stored[k]) for k in ("source", "character", "target", "literals"))
        if not len(source) == len(character) == len(target):
            raise ValueError("edge arrays differ in length")
        if sorted(target) != list(range(1, len(target) + 1)) or any(not 0 <= s <= len(target) or s >= t for s, t in zip(source, target, strict=True)):
            raise ValueError("edges do not make a tree")
        new = cls([])
        new.literals = literals
        new.next, new.out = [{} for _ in range(len(target) + 1)], [[] for _ in range(len(target) + 1)]
        for a, c, b in zip(source, character, target, strict=True):
            new.next[a][c] = b
        for number, literal in enumerate(literals):
            at = 0
            for c in literal:
                if c not in new.next[at]:
                    raise ValueError(f"literal without a path: {literal!r}")
                at = new.next[at][c]
            new.out[at].append(number)
        if any(not d and not o for d, o in zip(new.next[1:], new.out[1:], strict=True)):
            raise ValueError("a path ends without a literal")
        new._link()
        return new


def gate(text: Column, literals: Iterable[str]) -> Column:
    """Whether the beginning of some literal is found: a test that no text with a hit fails."""
    starts = sorted({x[:PREFIX] for x in literals if x})
    kept = [p for p in starts if not any(p != q and p.startswith(q) for q in starts)]
    return F.exists(F.array(*[F.lit(p) for p in kept]), lambda p: F.contains(text, p)) if kept else F.lit(False)


def literal_hits(texts: DataFrame, keys: list[str], text: str, automaton: Automaton) -> DataFrame:
    """keys, literal, start, end: every hit of every literal, overlapping ones too. Null and empty texts have none."""
    kinds = dict(texts.dtypes)
    sent = texts.sparkSession.sparkContext.broadcast(automaton.store())  # grows with the dictionary, not with the texts
    some = texts.where(F.col(text).isNotNull() & gate(F.col(text), automaton.literals)).select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.restore(sent.value)
        for batch in batches:
            rows, found = [], []
            for i, x in enumerate(batch.column(len(keys)).to_pylist()):
                hits = machine.find(x)
                rows += [i] * len(hits)
                found += hits
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keys))), pa.array([machine.literals[n] for n, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.int32()), pa.array([e for _, _, e in found], pa.int32())], [*keys, "literal", "start", "end"])

    return some.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "literal string", "start int", "end int"]))


# -- covers -----------------------------------------------------------------------------------------------------------


def cover_cost(cover: frozenset[str]) -> tuple[int, int, int]:
    """Smaller is better: the shortest literal as long as can be, then few of them, then long ones in all."""
    return (-min(map(len, cover)), len(cover), -sum(map(len, cover)))


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    some = [x for x in (a, b) if x and all(x)]
    return min(some, key=lambda x: (cover_cost(x), sorted(x))) if some else None


def _strings(op, value) -> frozenset[str] | None:
    """All strings that one node of a pattern stands for, where they are few."""
    kind = str(op)
    if kind == "LITERAL":
        return frozenset([chr(value)])
    if kind == "AT":
        return frozenset([""])
    if kind == "IN":
        return frozenset(chr(v) for _, v in value) if all(str(o) == "LITERAL" for o, _ in value) else None
    if kind == "SUBPATTERN":
        return _all_strings(value[3])
    if kind == "BRANCH":
        every = [_all_strings(x) for x in value[1]]
        return frozenset().union(*every) if None not in every else None
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        inner = _all_strings(value[2])
        return inner if value[0] or inner is None else inner | {""}
    return None


def _all_strings(tree) -> frozenset[str] | None:
    out = frozenset([""])
    for node in tree:
        part = _strings(*node)
        if part is None or len(out) * len(part) > EXACT:
            return None
        out = frozenset(a + b for a in out for b in part)
    return out


def _mandatory(tree) -> frozenset[str] | None:
    """The best set of which each match of a sequence contains one: runs of known strings, and what is mandatory inside the other nodes."""
    best, run = None, frozenset([""])
    for op, value in tree:
        part = _strings(op, value)
        if part is not None and len(run) * len(part) <= EXACT:
            run = frozenset(a + b for a in run for b in part)
            continue
        best, run = _better(best, run), part if part is not None and len(part) <= EXACT else frozenset([""])
        if part is None:
            kind, inside = str(op), None
            if kind == "SUBPATTERN":
                inside = _mandatory(value[3])
            elif kind == "BRANCH":
                every = [_mandatory(x) for x in value[1]]
                inside = frozenset().union(*every) if all(every) else None
            elif kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                inside = _mandatory(value[2])
            best = _better(best, inside)
    return _better(best, run)


def triggers(pattern: str) -> tuple[str, ...]:
    """Literals of which every match contains one at least, longest first; empty where none can be proven (such a rule is always tried)."""
    try:
        tree = parser.parse(pattern)
    except Exception:  # noqa: BLE001  what this engine can't parse is always tried
        return ()
    if tree.state.flags & 2:  # case is ignored: letters prove nothing
        return ()
    cover = _mandatory(tree)
    cover = cover and [x for x in cover if not any(y != x and y in x for y in cover)]  # one that holds another says no more
    return tuple(sorted(cover, key=lambda x: (-len(x), x))) if cover else ()
