"""A generalised LL recogniser with graph-structured stacks, and what its error correction needs.

A grammar in EBNF becomes a recursive transition network. A descriptor is a network state and a node of the
graph-structured stack; nodes are interned, so stacks with a common tail share it. The set of descriptors before a
token is one column of the chart. Columns are interned, too, and keep the columns that follow them by terminal: where a
column was met before, in any file, the step is one lookup, and the chart of a valid file is built at the speed of a
deterministic automaton. Rules must not be left recursive; loops are written with ``*``.

For error correction a column also gives the column behind any one terminal (an insertion or replacement), and every
descriptor the least number of terminals that complete it. ``Inside`` charts a part of a text whose beginning is unknown.
"""

from __future__ import annotations

import bisect
import copy
import re

_EBNF = re.compile(r"\s+|#[^\n]*|'(?:[^'\\]|\\.)+'|[A-Z][A-Z_0-9]*\b|[a-z][a-z_0-9]*|[|()*+?=;]")
END, ANY = "END", "ANY_TOKEN"
FREE = {END, "ASI", "ARM_END"}  # terminals that no text has
_BRACKETS = {"(", ")", "[", "]", "{", "}", END}


class Node:
    """A node of the graph-structured stack: where to go on, the node below, and the least number of terminals that
    complete both."""

    __slots__ = ("back", "below", "lacks")

    def __init__(self, back: int, below, least: int):
        self.back, self.below, self.lacks = back, below, least + (0 if below is None else below.lacks)


class Column:
    """A chart column: descriptors that stand behind the terminal just taken."""

    __slots__ = ("items", "after", "ends", "past")

    def __init__(self, items, ends):
        self.items, self.ends, self.after, self.past = items, ends, {}, None


class Grammar:
    def __init__(self, text: str, start: str, limit: int = 300_000):
        self.edges: list[list[tuple[str, object, int]]] = []
        self.final: set[int] = set()
        self.start_of: dict[str, int] = {}
        self.limit = limit
        self._parse(text)
        self._shorten()
        for edges in self.edges:
            for k, s, _ in edges:
                if k == "n" and s not in self.start_of:
                    raise ValueError(f"no rule {s}")
        self.tables: list = [None] * len(self.edges)
        self.all_edges: dict[int, tuple] = {}
        self.rule_past: dict = {}
        self.terminals = {s for edges in self.edges for k, s, _ in edges if k == "t"}
        self._least = self._least_costs()
        self._pops = [self._only_pops(i) for i in range(len(self.edges))]
        self.start = start
        self._reset()

    def _reset(self):
        self.nodes: dict = {}
        self.columns: dict = {}
        self.behind: dict[str, dict] = {}  # by terminal and descriptor: the descriptors behind it
        self.past: dict[str, dict] = {}  # the same behind any one terminal and this one
        self.any_of: dict = {}  # by descriptor: the descriptors behind any one terminal
        self.least_of: dict = {}  # by descriptor and number: as many of these as lack least
        self.close_of: dict = {}  # by descriptor: the descriptors behind one terminal that ends a rule
        self.held = 0  # descriptors in all of these
        self.first = self._column({(self.start_of[self.start], None)})
        self.inside = Inside(self)

    # building

    def _new(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _parse(self, text: str):
        tokens, at = [], 0
        while at < len(text):
            m = _EBNF.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 30]!r}")
            at = m.end()
            if not m.group().isspace() and m.group()[0] != "#":
                tokens.append(m.group())
        k = 0
        while k < len(tokens):
            name = tokens[k]
            if tokens[k + 1] != "=":
                raise ValueError(f"grammar: {name} {tokens[k + 1]}")
            a, b = self._new(), self._new()
            self.start_of[name] = a
            self.final.add(b)
            k = self._choice(tokens, k + 2, a, b)
            if tokens[k] != ";":
                raise ValueError(f"grammar: in {name} at {tokens[k]}")
            k += 1

    def _choice(self, tokens, k, a, b):
        k = self._sequence(tokens, k, a, b)
        while tokens[k] == "|":
            k = self._sequence(tokens, k + 1, a, b)
        return k

    def _sequence(self, tokens, k, a, b):
        at = a
        while tokens[k] not in ("|", ")", ";"):
            x, y = self._new(), self._new()
            if tokens[k] == "(":
                k = self._choice(tokens, k + 1, x, y) + 1
            else:
                t = tokens[k]
                if t[0] == "'":
                    self.edges[x].append(("t", t[1:-1].replace("\\'", "'"), y))
                elif t[0].isupper():
                    self.edges[x].append(("t", t, y))
                else:
                    self.edges[x].append(("n", t, y))
                k += 1
            self.edges[at].append(("e", None, x))
            if tokens[k] in ("*", "+", "?"):
                if tokens[k] != "+":
                    self.edges[x].append(("e", None, y))
                if tokens[k] != "?":
                    self.edges[y].append(("e", None, x))
                k += 1
            at = y
        self.edges[at].append(("e", None, b))
        return k

    def _shorten(self):
        """Edges pass over states from which only one empty edge leads: the ends of alternatives become one state."""

        def past(s: int) -> int:
            while len(self.edges[s]) == 1 and self.edges[s][0][0] == "e":
                s = self.edges[s][0][2]
            return s

        self.edges = [[(k, x, past(n)) for k, x, n in edges] for edges in self.edges]

    def _only_pops(self, state: int) -> bool:
        """Whether nothing but the end of the rule follows: a call from here needs no stack node."""
        seen, todo = set(), [state]
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            for k, _, n in self.edges[s]:
                if k != "e":
                    return False
                todo.append(n)
        return True

    # chart

    def _table(self, state: int):
        """(by terminal: next state and the calls entered on the way; whether the rule can end here)."""
        got = self.tables[state]
        if got is not None:
            return got
        table: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        ends = False
        seen, todo = set(), [(state, ())]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            s, calls = at
            if s in self.final:
                if calls:
                    todo.append((calls[-1], calls[:-1]))
                else:
                    ends = True
                continue
            for kind, x, n in self.edges[s]:
                if kind == "e":
                    todo.append((n, calls))
                elif kind == "n":
                    todo.append((self.start_of[x], calls if self._pops[n] else (*calls, n)))
                else:
                    table.setdefault(x, []).append((n, calls))
        got = self.tables[state] = (table, ends)
        return got

    def _column(self, items) -> Column:
        ends = False
        for state, node in items:
            while self._table(state)[1]:
                if node is None:
                    ends = True
                    break
                state, node = node.back, node.below
        key = frozenset(items)
        got = self.columns.get(key)
        if got is None:
            got = self.columns[key] = Column(tuple(items), ends)
            self.held += len(key) + 8
        return got

    def step(self, column: Column, terminal: str) -> Column | None:
        """The column after a terminal, or None where no descriptor takes it."""
        try:
            return column.after[terminal]
        except KeyError:
            pass
        memo = self.behind.get(terminal)
        if memo is None:
            memo = self.behind[terminal] = {}
        out: set = set()
        for item in column.items:
            got = memo.get(item)
            out.update(self._behind_item(item, terminal, memo) if got is None else got)
        got = column.after[terminal] = self._column(out) if out else None
        return got

    def _behind_item(self, item, terminal: str, memo: dict) -> tuple:
        """Descriptors behind a terminal taken by one descriptor or, where its rule can end, by those below it."""
        chain, loose = [], terminal not in _BRACKETS
        while item not in memo:
            state, node = item
            table, ends = self._table(state)
            out: set = set()
            for n, calls in (*table.get(terminal, ()), *(table.get(ANY, ()) if loose else ())):
                out.add(self._called(n, calls, node))
            chain.append((item, out))
            if not ends or node is None:
                got: tuple = ()
                break
            item = (node.back, node.below)
        else:
            got = memo[item]
        for item, out in reversed(chain):
            if out:
                got = tuple(out.union(got))
            memo[item] = got
            self.held += (len(got) if out else 0) + 2
        return got

    def _called(self, n: int, calls, top):
        """The descriptor in state ``n`` upon the stack ``top`` and the calls entered; ended calls are left."""
        nodes, pops = self.nodes, self._pops
        for back in calls:
            key = (back, id(top))
            below = top
            top = nodes.get(key)
            if top is None:
                top = nodes[key] = Node(back, below, self._least[back])
        while pops[n] and top is not None:
            n, top = top.back, top.below
        return n, top

    def behind_all(self, items, terminal: str) -> set:
        """Descriptors behind a terminal taken by any of some descriptors."""
        memo = self.behind.get(terminal)
        if memo is None:
            memo = self.behind[terminal] = {}
        out: set = set()
        for item in items:
            got = memo.get(item)
            if got is None:
                got = self._behind_item(item, terminal, memo)
            if got:
                out.update(got)
        return out

    def past_all(self, items, terminal: str) -> set:
        """Descriptors behind any one terminal, the end aside, and the given one after it."""
        memo = self.past.get(terminal)
        if memo is None:
            memo = self.past[terminal] = {}
        out: set = set()
        for item in items:
            got = memo.get(item)
            if got is None:
                got = self._past_item(item, terminal, memo)
            if got:
                out.update(got)
        return out

    def past_column(self, column: Column, terminal: str) -> set:
        """The same for a column, which keeps them."""
        if column.past is None:
            column.past = {}
        got = column.past.get(terminal)
        if got is None:
            got = column.past[terminal] = self.past_all(column.items, terminal)
            self.held += len(got) + 8
        return got

    def _past_item(self, item, terminal: str, memo: dict) -> tuple:
        chain = []
        while item not in memo:
            state, node = item
            direct, leaves = self._past_rule(state, terminal)
            out = {self._called(n, calls, node) for n, calls in direct}
            below = None if node is None else (node.back, node.below)
            if leaves and below is not None:
                out |= self.behind_all((below,), terminal)
            chain.append((item, out))
            if below is None or not self._table(state)[1]:
                got: tuple = ()
                break
            item = below
        else:
            got = memo[item]
        for item, out in reversed(chain):
            if out:
                got = tuple(out.union(got))
            memo[item] = got
            self.held += (len(got) if out else 0) + 2
        return got

    def _past_rule(self, state: int, terminal: str):
        """(states and calls behind any one terminal and the given one within the rule, whether it can end between them)."""
        got = self.rule_past.get((state, terminal))
        if got is None:
            loose = terminal not in _BRACKETS
            out, leaves, seen, todo = set(), False, set(), list(self._any_edges(state))
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                n, calls = at
                table, ends = self._table(n)
                for m, more in (*table.get(terminal, ()), *(table.get(ANY, ()) if loose else ())):
                    out.add((m, (*calls, *more)))
                if ends and calls:
                    todo.append((calls[-1], calls[:-1]))
                elif ends:
                    leaves = True
            got = self.rule_past[state, terminal] = (tuple(out), leaves)
        return got

    def _any_edges(self, state: int) -> tuple:
        edges = self.all_edges.get(state)
        if edges is None:
            edges = self.all_edges[state] = tuple({x for t, edges in self._table(state)[0].items() if t != END for x in edges})
        return edges

    def any_all(self, items) -> set:
        """Descriptors behind any one terminal but the end."""
        out: set = set()
        for item in items:
            got = self.any_of.get(item)
            if got is None:
                found, at = set(), item
                while True:
                    state, node = at
                    found.update(self._called(n, calls, node) for n, calls in self._any_edges(state))
                    if node is None or not self._table(state)[1]:
                        break
                    at = (node.back, node.below)
                got = self.any_of[item] = tuple(found)
                self.held += len(got) + 2
            out.update(got)
        return out

    def any_least(self, items, most: int):
        """Of the descriptors behind any one terminal the ``most`` that lack least; every descriptor keeps its own."""
        out: set = set()
        for item in items:
            got = self.least_of.get((item, most))
            if got is None:
                got = self.least_of[item, most] = tuple(self.shallow(self.any_all((item,)), most))
                self.held += len(got) + 2
            out.update(got)
        return self.shallow(out, most)

    def close_all(self, items) -> set:
        """Descriptors behind one terminal that ends a rule, as a closing bracket does."""
        out: set = set()
        for item in items:
            got = self.close_of.get(item)
            if got is None:
                found = []
                state, node = item
                while node is not None and self._least[state] <= 1:
                    found.append((node.back, node.below))
                    if self._least[state] == 1:
                        break
                    state, node = node.back, node.below
                got = self.close_of[item] = tuple(found)
                self.held += len(got) + 2
            out.update(got)
        return out

    def shallow(self, items, most: int):
        """The ``most`` descriptors that lack least: readings of wrong text multiply with every bracket."""
        if len(items) <= most:
            return items
        least = self._least
        lacks = [least[state] + (0 if node is None else node.lacks) for state, node in items]
        cut = sorted(lacks)[most - 1]
        out = {x for x, k in zip(items, lacks) if k < cut}
        ties = sorted((x for x, k in zip(items, lacks) if k == cut), key=lambda x: x[0])
        out.update(ties[: most - len(out)])
        return out

    def finish(self, items) -> int:
        """The least number of terminals, the end aside, that complete one of the descriptors."""
        return min(map(self.finish_item, items), default=1 << 30)

    def finish_item(self, item) -> int:
        state, node = item
        return self._least[state] + (0 if node is None else node.lacks)

    def _least_costs(self) -> list[int]:
        """Of every state the least number of terminals up to its rule's end; the end and virtual terminals cost nothing."""
        far = 1 << 20
        least = [0 if s in self.final else far for s in range(len(self.edges))]
        changed = True
        while changed:
            changed = False
            for s, edges in enumerate(self.edges):
                for kind, x, n in edges:
                    own = 0 if kind == "e" or x in FREE else 1 if kind == "t" else least[self.start_of[x]]
                    if own + least[n] < least[s]:
                        least[s] = own + least[n]
                        changed = True
        return least

    def takes(self, column: Column) -> set[str]:
        out: set[str] = set()
        for state, node in column.items:
            while True:
                table, ends = self._table(state)
                out.update(table)
                if not ends or node is None:
                    break
                state, node = node.back, node.below
        return out - {ANY}

    def trim(self):
        """Forget the interned columns when there are too many; called between files."""
        if len(self.columns) > self.limit or len(self.nodes) > 2 * self.limit or self.held > 10 * self.limit:
            self._reset()

    def apart(self, limit: int):
        """The same grammar with columns of its own."""
        other = copy.copy(self)
        other.limit = limit
        other._reset()
        return other

    def depth(self, column: Column) -> int:
        """Open calls of the shallowest descriptor."""

        def size(n):
            k = 0
            while n is not None:
                n, k = n.below, k + 1
            return k

        return min((size(n) for _, n in column.items), default=0)


class Inside:
    """The recogniser of parts of texts: a chart that begins in every state, upon a stack of which nothing is known, so that
    a rule that ends there goes on wherever the grammar calls it. What it refuses is part of no text of the language.

    Columns are interned sets of descriptors with the columns that follow them.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.columns: dict = {}
        self._first = None

    @property
    def first(self):
        if self._first is None:
            g = self.grammar
            starts = sorted((a, name) for name, a in g.start_of.items())
            at = [a for a, _ in starts]
            self.rule = [starts[bisect.bisect(at, s) - 1][1] for s in range(len(g.edges))]
            self.returns: dict[str, set] = {name: set() for name in g.start_of}
            self.over: dict = {}
            for edges in g.edges:
                for kind, x, n in edges:
                    if kind == "n":
                        self.returns[x].add(n)
            self._first = self._column(frozenset((s, None) for s in range(len(g.edges))))
        return self._first

    def _column(self, items: frozenset):
        got = self.columns.get(items)
        if got is None:
            got = self.columns[items] = (items, {})
            self.grammar.held += len(items) + 8
        return got

    def step(self, column, terminal: str, between: str | None = None):
        """The column after a terminal, with or without the terminal ``between`` before it; None where nothing takes it."""
        after = column[1]
        key = terminal if between is None else (between, terminal)
        try:
            return after[key]
        except KeyError:
            pass
        out = self._behind(column[0], terminal)
        if between is not None:
            out |= self._behind(self._behind(column[0], between), terminal)
        got = after[key] = self._column(frozenset(out)) if out else None
        return got

    def _behind(self, items, terminal: str) -> set:
        g, rule, loose = self.grammar, self.rule, terminal not in _BRACKETS
        out, seen, left = set(), set(), set()
        for item in items:
            while item not in seen:
                seen.add(item)
                state, node = item
                table, ends = g._table(state)
                if terminal in table or loose and ANY in table:
                    for n, calls in (*table.get(terminal, ()), *(table.get(ANY, ()) if loose else ())):
                        out.add(g._called(n, calls, node))
                if not ends:
                    break
                if node is None:
                    left.add(rule[state])
                    break
                item = (node.back, node.below)
        for name in left:
            out |= self._outside(name, terminal)
        return out

    def _outside(self, name: str, terminal: str) -> set:
        """Descriptors behind a terminal wherever a rule that ended upon an unknown stack can go on."""
        got = self.over.get((name, terminal))
        if got is None:
            g, loose = self.grammar, terminal not in _BRACKETS
            got, rules, todo = set(), {name}, [name]
            while todo:
                for state in self.returns[todo.pop()]:
                    table, ends = g._table(state)
                    for n, calls in (*table.get(terminal, ()), *(table.get(ANY, ()) if loose else ())):
                        got.add(g._called(n, calls, None))
                    if ends and self.rule[state] not in rules:
                        rules.add(self.rule[state])
                        todo.append(self.rule[state])
            self.over[name, terminal] = got
        return got
