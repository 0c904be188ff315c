"""LR automaton of the role grammar and weighted repair over its stacks.

    conversation -> (nothing) | pairs | s pairs
    pairs        -> u a | pairs u a

Terminals are the initials of the roles.  A parse stack is a chain of LR
states; stacks share their lower parts, which makes the live stacks a graph.
Every input row offers several edits (keep, rerole, delete, and inserts before
it), each of which leads a stack to others at a cost.  Of the stacks with equal
tops only the one with the least (cost, audit) stays: what may follow depends
on the top alone.  The audit is the string of the edits' initials.
"""

from __future__ import annotations

from functools import lru_cache

GRAMMAR = (("conversation", ()), ("conversation", ("pairs",)), ("conversation", ("s", "pairs")),
           ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))
START = "conversation"
#: Costs of the edits; an undeleted truncated row costs KEPT_TRUNCATED more.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 1, 2, 5, 5
#: Terminals that an insert or a rerole can give.
GIVEN = ("u", "a")

SOUND, TRUNCATED, BROKEN = 0, 1, 2

#: (cost, audit) by stack top.
Frontier = dict[int, tuple[int, str]]


class Automaton:
    """LR(0) states of a grammar: sets of (production, dot)."""

    def __init__(self, grammar=GRAMMAR, start=START):
        self.grammar, self.start = grammar, start
        self.heads = {head for head, _ in grammar}
        first = self._closed({(i, 0) for i, (head, _) in enumerate(grammar) if head == start})
        self.states, self.goto = [first], {}
        for number, state in enumerate(self.states):  # grows while it is walked
            for symbol in sorted({grammar[p][1][dot] for p, dot in state if dot < len(grammar[p][1])}):
                moved = self._closed({(p, dot + 1) for p, dot in state if grammar[p][1][dot:dot + 1] == (symbol,)})
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[number, symbol] = self.states.index(moved)

    def _closed(self, items) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            p, dot = todo.pop()
            ahead = self.grammar[p][1][dot:dot + 1]
            for i, (head, _) in enumerate(self.grammar):
                if ahead == (head,) and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _finished(self, state: int) -> list[int]:
        return [p for p, dot in self.states[state] if dot == len(self.grammar[p][1])]

    def accepts(self, state: int) -> bool:
        return any(self.grammar[p][0] == self.start for p in self._finished(state))

    def shift(self, stack: tuple, terminal: str) -> list[tuple]:
        """The stacks after ``terminal``, with every reduction below the start symbol made."""
        if (stack[0], terminal) not in self.goto:
            return []
        todo, out = [(self.goto[stack[0], terminal], stack)], []
        while todo:
            stack = todo.pop()
            reduced = False
            for p in self._finished(stack[0]):
                head, body = self.grammar[p]
                if head == self.start:
                    continue
                below = stack
                for _ in body:
                    below = below[1]
                if (below[0], head) in self.goto:
                    todo.append((self.goto[below[0], head], below))
                    reduced = True
            if not reduced or any(self.grammar[p][0] == self.start for p in self._finished(stack[0])):
                out.append(stack)
        return out


def merge(into: dict, top, value: tuple) -> None:
    if top not in into or value < into[top]:
        into[top] = value


class Repairs:
    """Edits of single rows as moves between stack tops, derived from the automaton."""

    def __init__(self, automaton: Automaton | None = None):
        self.automaton = automaton or Automaton()
        self.stacks = {0: (0, None)}  # one stack for every top that can be reached
        todo = [0]
        while todo:
            for terminal in "sua":
                for stack in self.automaton.shift(self.stacks[todo[-1]], terminal):
                    if stack[0] not in self.stacks:
                        self.stacks[stack[0]] = stack
                        todo.insert(0, stack[0])
            todo.pop()
        self.inserts = {top: self._inserted(top) for top in self.stacks}
        self.moves = lru_cache(maxsize=None)(self._moves)

    def _shifted(self, top: int, terminal: str) -> list[int]:
        return [stack[0] for stack in self.automaton.shift(self.stacks[top], terminal)]

    def _inserted(self, top: int) -> Frontier:
        """What inserts alone reach (none included); more inserts than tops only repeat tops."""
        found: Frontier = {top: (0, "")}
        for _ in self.stacks:
            for at, (cost, audit) in list(found.items()):
                for terminal in GIVEN:
                    for to in self._shifted(at, terminal):
                        merge(found, to, (cost + INSERT, audit + "I"))
        return found

    def _moves(self, top: int, initial: str, fault: int) -> tuple:
        """(top after, cost, audit) of every best way over one row.  Inserts come
        before a kept or reroled row: after a deleted one they are as good."""
        found: Frontier = {top: (DELETE, "D")}
        if fault != BROKEN:
            more = KEPT_TRUNCATED if fault == TRUNCATED else 0
            for at, (cost, audit) in self.inserts[top].items():
                for to in self._shifted(at, initial) if initial in ("s", *GIVEN) else []:
                    merge(found, to, (cost + more, audit + "K"))
                for terminal in GIVEN:
                    for to in self._shifted(at, terminal):
                        merge(found, to, (cost + more + REROLE, audit + "R"))
        return tuple((to, cost, audit) for to, (cost, audit) in found.items())

    def over(self, frontier: Frontier, initial: str, fault: int) -> Frontier:
        """The frontier after one row."""
        out: Frontier = {}
        for top, (cost, audit) in frontier.items():
            for to, more, edits in self.moves(top, initial, fault):
                merge(out, to, (cost + more, audit + edits))
        return out

    def deleted(self, frontier: Frontier, rows: int) -> Frontier:
        """The frontier after ``rows`` rows that have to go."""
        return {top: (cost + DELETE * rows, audit + "D" * rows) for top, (cost, audit) in frontier.items()}

    def joined(self, frontier: Frontier, segment: dict[int, Frontier]) -> Frontier:
        """``frontier`` led through a segment given by its result for every top at its start."""
        out: Frontier = {}
        for top, (cost, audit) in frontier.items():
            for to, (more, edits) in segment[top].items():
                merge(out, to, (cost + more, audit + edits))
        return out

    def best(self, frontier: Frontier) -> tuple[int, str]:
        """The least (cost, audit) of an accepted end, inserts after the last row included."""
        ends = [(cost + more, audit + edits) for top, (cost, audit) in frontier.items()
                for to, (more, edits) in self.inserts[top].items() if self.automaton.accepts(to)]
        return min(ends)

    def apply(self, audit: str, rows):
        """(role, text) of the repaired conversation; ``rows`` gives (role, text) in order.
        Which role an insert or rerole gives follows from the stack."""
        rows, stack = iter(rows), (0, None)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            terminal = role[:1] if edit == "K" else next(t for t in GIVEN if self.automaton.shift(stack, t))
            stack = self.automaton.shift(stack, terminal)[0]
            yield (role if edit == "K" else {"u": "user", "a": "assistant"}[terminal], text)
