"""LALR(1) tables from grammar text, and two parsers that run on them.

``Tables.parse_many`` drives many token streams in lockstep: one numpy step advances every stream of a batch by one
parser action, so the cost of Python is shared by thousands of files. Where a grammar isn't LALR(1), a table cell keeps
all its actions; the lockstep parser follows the preferred one. What it accepts is derivable, hence valid; what it
rejects without having met such a cell is invalid; only the rest goes through ``Tables.parse_general``, which follows
all actions on shared stacks (generalised LR) and decides exactly.

Grammar text: ``Name: alternative | alternative ;`` with 'quoted' terminals, UPPER token classes, groups in parentheses,
the suffixes ? * +, and ``X % ','`` for lists with a separator. The first rule is the start.
"""

from __future__ import annotations

import re

import numpy as np

_TOKEN = re.compile(r"'[^']+'|[A-Za-z_]\w*|[:|;()?*+%]|#[^\n]*")


#: Streams below which a lockstep step costs more than stepping each by itself.
FEW = 192


class _Reader:
    def __init__(self, text: str):
        self.toks = [t for t in _TOKEN.findall(text) if t[0] != "#"]
        self.at = 0
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.made: dict[tuple, str] = {}
        while self.at < len(self.toks):
            name = self.next()
            assert self.next() == ":", name
            self.rules.setdefault(name, []).extend(self.alternatives(";"))
            assert self.next() == ";", name

    def next(self) -> str:
        self.at += 1
        return self.toks[self.at - 1]

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def alternatives(self, end: str) -> list[tuple[str, ...]]:
        out = self.sequence(end)
        while self.peek() == "|":
            self.next()
            out += self.sequence(end)
        return out

    def sequence(self, end: str) -> list[tuple[str, ...]]:
        """Optional parts are written out as separate alternatives: without empty rules the tables have far fewer split cells."""
        outs: list[tuple[str, ...]] = [()]
        while self.peek() not in ("|", end):
            t = self.next()
            if t == "(":
                alts = self.alternatives(")")
                self.next()
            else:
                alts = [(t,)]
            optional = False
            while self.peek() in ("?", "*", "+", "%"):
                op = self.next()
                if op in "?*":
                    optional = True
                if op != "?":
                    t = alts[0][0] if len(alts) == 1 and len(alts[0]) == 1 else self.make(("alt", *alts), alts)
                    sep = (self.next(),) if op == "%" else ()
                    n = self.make(("list", t, *sep), None)
                    self.rules[n] = [(t,), (n, *sep, t)]
                    alts = [(n,)]
            if optional:
                alts = [*alts, ()]
            outs = [o + a for o in outs for a in dict.fromkeys(alts)]
        return outs

    def make(self, key: tuple, alts) -> str:
        if key not in self.made:
            self.made[key] = f"_{len(self.made)}"
            if alts is not None:
                self.rules[self.made[key]] = list(alts)
        return self.made[key]


class Tables:
    """Tables of one grammar. Terminals: 0 is a character no token has, 1 the end; ``term`` maps spellings and classes.

    prefer: rules whose reduction the lockstep parser tries first in a split cell; otherwise it shifts, or reduces the rule
    that comes first in the grammar.
    """

    def __init__(self, text: str, prefer: tuple[str, ...] = ()):
        self.prefer = prefer
        rules = _Reader(text).rules
        start = next(iter(rules))
        self.prods: list[tuple[str, tuple[str, ...]]] = [("_start", (start, "EOF"))]
        of: dict[str, list[int]] = {"_start": [0]}
        for name, alts in rules.items():
            for a in dict.fromkeys(alts):
                of.setdefault(name, []).append(len(self.prods))
                self.prods.append((name, a))
        terms = dict.fromkeys(s for _, rhs in self.prods for s in rhs if s not in of)
        terms.pop("EOF")
        bad = [t for t in terms if t[0] != "'" and not t.isupper()]
        assert not bad, f"no rule for {bad}"
        self.term = {"": 0, "EOF": 1} | {t.strip("'"): i for i, t in enumerate(terms, 2)}
        tid = {"EOF": 1} | {t: i for i, t in enumerate(terms, 2)}
        nid = {n: i for i, n in enumerate(of)}
        self._build(of, tid, nid)

    def _build(self, of, tid, nid) -> None:
        prods = self.prods
        # symbols as ints: terminals t, nonterminals T + n
        T = len(self.term)
        code = lambda s: tid[s] if s in tid else T + nid[s]
        rhs = [tuple(code(s) for s in r) for _, r in prods]
        lhs = [nid[n] for n, _ in prods]
        own = [of[n] for n in nid]
        nullable, grew = set(), True
        while grew:
            grew = False
            for p, r in enumerate(rhs):
                if T + lhs[p] not in nullable and all(s in nullable for s in r):
                    nullable.add(T + lhs[p])
                    grew = True
        # what each nonterminal adds to a closure
        begins: list[set[int]] = []
        for n in range(len(own)):
            seen, todo = {n}, [n]
            while todo:
                for p in own[todo.pop()]:
                    if rhs[p] and rhs[p][0] >= T and (m := rhs[p][0] - T) not in seen:
                        seen.add(m)
                        todo.append(m)
            begins.append({p for m in seen for p in own[m]})
        kernel0 = frozenset([(0, 0)])
        number, kernels, goto = {kernel0: 0}, [kernel0], []
        for k in kernels:
            moves: dict[int, set] = {}
            items, added = list(k), set()
            for p, d in k:
                if d < len(rhs[p]) and rhs[p][d] >= T:
                    added |= begins[rhs[p][d] - T]
            items += [(p, 0) for p in added]
            for p, d in items:
                if d < len(rhs[p]):
                    moves.setdefault(rhs[p][d], set()).add((p, d + 1))
            row = {}
            for s in sorted(moves):
                f = frozenset(moves[s])
                if f not in number:
                    number[f] = len(kernels)
                    kernels.append(f)
                row[s] = number[f]
            goto.append(row)
        # lookaheads after DeRemer and Pennello
        trans = {(q, s): i for i, (q, s) in enumerate((q, s) for q, row in enumerate(goto) for s in row if s >= T)}
        direct, reads = [0] * len(trans), [[] for _ in trans]
        for (q, s), i in trans.items():
            r = goto[q][s]
            for t in goto[r]:
                if t < T:
                    direct[i] |= 1 << t
                elif t in nullable:
                    reads[i].append(trans[r, t])
        includes, lookback = [[] for _ in trans], {}
        for (q, s), i in trans.items():
            for p in own[s - T]:
                at, path = q, []
                for x in rhs[p]:
                    path.append(at)
                    at = goto[at][x]
                lookback.setdefault((at, p), []).append(i)
                for j in range(len(rhs[p]) - 1, -1, -1):
                    if rhs[p][j] >= T:
                        includes[trans[path[j], rhs[p][j]]].append(i)
                    if rhs[p][j] not in nullable:
                        break
        look = _spread(_spread(direct, reads), includes)
        n = len(kernels)
        self.action = np.zeros((n, T), np.int32)
        self.goto = np.zeros((n, len(own)), np.int32)
        more: dict[tuple[int, int], list[int]] = {}
        for q, row in enumerate(goto):
            for s, to in row.items():
                if s < T:
                    self.action[q, s] = to + 1
                else:
                    self.goto[q, s - T] = to
        for (q, p), backs in sorted(lookback.items(), key=lambda x: (x[0][0], x[0][1])):
            bits = 0
            for i in backs:
                bits |= look[i]
            while bits:
                t = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if self.action[q, t]:
                    more.setdefault((q, t), [int(self.action[q, t])]).append(-p)
                else:
                    self.action[q, t] = -p
        first = {n: i for i, n in enumerate(self.prefer)}
        for cell, acts in more.items():
            best = [a for a in acts if a < 0 and prods[-a][0] in first]
            if best:
                self.action[cell] = min(best, key=lambda a: first[prods[-a][0]])
        self.more = more
        self.split = np.zeros((n, T), bool)
        for q, t in more:
            self.split[q, t] = True
        self.size = np.array([len(r) for r in rhs], np.int32)
        self.left = np.array(lhs, np.int32)
        self.asi = self.term.get("ASI", 0)

    def parse_many(self, streams: list[np.ndarray], soft: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each stream of terminals that ends with 1: the place of its first error or -1, and whether it met a split cell.

        soft marks tokens before which an ASI terminal may be put where the token itself doesn't fit.
        """
        n = len(streams)
        failed, met = np.full(n, -1, np.int64), np.zeros(n, bool)
        if not n:
            return failed, met
        order = np.argsort([-len(s) for s in streams], kind="stable")
        flat = np.concatenate([streams[i] for i in order]).astype(np.int32)
        gentle = np.concatenate([soft[i] for i in order]) if soft is not None else None
        lens = np.array([len(streams[i]) for i in order])
        base = np.concatenate([[0], np.cumsum(lens)[:-1]])
        depth = 64
        stack = np.zeros((n, depth), np.int32)
        ids, pos, top = np.arange(n), base.copy(), np.zeros(n, np.int64)
        pend, last = np.zeros(n, bool), np.full(n, -1, np.int64)
        rows = np.arange(n)
        bad, conf = np.full(n, -1, np.int64), np.zeros(n, bool)
        action, goto, size, left, split, hard = self.action, self.goto, self.size, self.left, self.split, bool(self.more)
        states = stack[rows, top]
        while len(ids):
            if len(ids) < FEW:
                for k in range(len(ids)):
                    i = ids[k]
                    at, split_met = self._finish(flat[base[i] : base[i] + lens[i]].tolist(), None if gentle is None else gentle[base[i] : base[i] + lens[i]].tolist(), stack[rows[k], : top[k] + 1].tolist(), int(pos[k] - base[i]), bool(pend[k]), int(last[k] - base[i]))
                    bad[i] = at
                    conf[i] |= split_met
                break
            tok = flat[pos]
            if self.asi:
                tok = np.where(pend, self.asi, tok)
            act = action[states, tok]
            if hard and (s := split[states, tok]).any():
                conf[ids[s]] = True
            gone = act == 0
            if gone.any():
                if gentle is not None and self.asi:
                    again = gone & ~pend & gentle[pos] & (last != pos)
                    if again.any():
                        alt = action[states, self.asi]
                        again &= alt != 0
                        if hard:
                            conf[ids[again & split[states, self.asi]]] = True
                        act = np.where(again, alt, act)
                        tok = np.where(again, self.asi, tok)
                        pend |= again
                        last = np.where(again, pos, last)
                        gone &= ~again
                bad[ids[gone]] = (pos - base[ids])[gone]
            shift = act > 0
            ended = shift & (tok == 1)
            drop = gone | ended
            prod = np.where(shift, 0, -act)
            pop = np.where(shift, 0, size[prod])
            top = top - pop
            under = stack[rows, top]
            to = np.where(shift, act - 1, goto[under, left[prod]])
            top = top + 1
            if int(top.max()) >= depth:
                stack = np.concatenate([stack, np.zeros_like(stack)], axis=1)
                depth *= 2
            stack[rows, top] = to
            states = to
            pos = pos + (shift & ~pend)
            pend &= ~shift
            if drop.any():
                keep = ~drop
                ids, pos, top, pend, last, states, rows = ids[keep], pos[keep], top[keep], pend[keep], last[keep], states[keep], rows[keep]
                if len(ids) and len(ids) * 2 < len(stack):
                    stack, rows = stack[rows], np.arange(len(ids))
        failed[order], met[order] = bad, conf
        return failed, met

    def _finish(self, toks: list[int], soft: list[bool] | None, stack: list[int], pos: int, pend: bool, last: int) -> tuple[int, bool]:
        """Parse one stream on from the given point: (place of its first error or -1, whether it met a split cell)."""
        action, goto, size, left, more = self._plain()
        asi, met = self.asi, False
        push, pop = stack.append, stack.pop
        while True:
            state = stack[-1]
            tok = asi if pend else toks[pos]
            act = action[state][tok]
            if more and (state, tok) in more:
                met = True
            if act > 0:
                if tok == 1:
                    return -1, met
                push(act - 1)
                if pend:
                    pend = False
                else:
                    pos += 1
            elif act < 0:
                n = size[-act]
                if n == 1:
                    pop()
                elif n:
                    del stack[-n:]
                push(goto[stack[-1]][left[-act]])
            elif soft is not None and asi and not pend and last != pos and soft[pos] and action[state][asi]:
                pend, last = True, pos
            else:
                return pos, met

    def parse_general(self, stream: np.ndarray, soft: np.ndarray | None = None) -> int:
        """The place of the first token at which no parse can go on, or -1."""
        action, goto, size, left, more = self._plain()
        front: dict[tuple[int, int], tuple] = {}
        front[0, 0] = (0, None)
        for at, tok in enumerate(stream.tolist()):
            nxt = self._advance(front, tok, action, goto, size, left, more)
            if not nxt and soft is not None and self.asi and soft[at]:
                mid = self._advance(front, self.asi, action, goto, size, left, more)
                nxt = self._advance(mid, tok, action, goto, size, left, more) if mid else mid
            if not nxt:
                return at
            front = nxt
        return -1

    def _plain(self):
        if not hasattr(self, "_lists"):
            self._lists = (self.action.tolist(), self.goto.tolist(), self.size.tolist(), self.left.tolist(), self.more)
        return self._lists

    @staticmethod
    def _advance(front, tok, action, goto, size, left, more):
        """Nodes are (state, parent node); equal ones are shared, so that readings of the same tokens merge."""
        nodes, todo, out = dict(front), list(front.values()), {}
        while todo:
            node = todo.pop()
            state = node[0]
            for act in more.get((state, tok)) or (action[state][tok],):
                if act > 0:
                    out[act - 1, id(node)] = (act - 1, node)
                elif act < 0:
                    under = node
                    for _ in range(size[-act]):
                        under = under[1]
                    to = goto[under[0]][left[-act]]
                    if (to, id(under)) not in nodes:
                        new = (to, under)
                        nodes[to, id(under)] = new
                        todo.append(new)
        return out


def _spread(first: list[int], relation: list[list[int]]) -> list[int]:
    """Smallest sets with out[i] = first[i] and out[j] for every j related to i (iterative, strong components share)."""
    out, depth, stack = list(first), [0] * len(first), []
    inf = len(first) + 1
    for s in range(len(first)):
        if depth[s]:
            continue
        stack.append(s)
        depth[s] = len(stack)
        calls = [(s, iter(relation[s]), len(stack))]
        while calls:
            x, todo, d = calls[-1]
            y = next(todo, None)
            if y is not None:
                if not depth[y]:
                    stack.append(y)
                    depth[y] = len(stack)
                    calls.append((y, iter(relation[y]), len(stack)))
                else:
                    depth[x] = min(depth[x], depth[y])
                    out[x] |= out[y]
                continue
            calls.pop()
            if depth[x] == d:
                while True:
                    z = stack.pop()
                    depth[z] = inf
                    out[z] = out[x]
                    if z == x:
                        break
            if calls:
                up = calls[-1][0]
                depth[up] = min(depth[up], depth[x])
                out[up] |= out[x]
    return out
