"""Secrets found by one deterministic automaton for all rules.

The rules' regular expressions become one nondeterministic automaton over bytes; reversed, by subset construction and
minimisation, it turns into a transition array that is run once over the texts from their ends: its state at a byte tells which
rules match from there on. A buffer of many texts is cut into lanes that numpy steps through side by side, and a lane whose true
entry state differs from the assumed one is run again until it agrees. From the leftmost start that no earlier match covers, the
forward automaton goes on to the first accepting byte, and the closing run of the rule's last class gives the end; lengths are
counted on those runs.
"""

from __future__ import annotations

import hashlib
import re._constants as op
import re._parser as sre

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import append_columns

#: The base rules (kind, pattern, letters in either case, measured group, least length).
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    ("hex", r"[0-9a-f]+", False, 0, 16),
]
#: Further rules of the method: private key headers, version-control and chat tokens, JSON web tokens.
MORE = [
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", False, 0, 1),
    ("git_token", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 30),
]
LANE = 1024


class Nfa:
    """Thompson construction from the standard library's parse of a regular expression, over bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.tail: frozenset | None = None  # the class of the last unbounded repeat

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Build the parsed sequence from state at; the state where it ends."""
        for kind, arg in tree:
            if kind is op.LITERAL:
                at = self.byte(at, {arg}, fold)
            elif kind is op.IN:
                at = self.byte(at, members(arg), fold)
            elif kind is op.SUBPATTERN:
                at = self.add(arg[3], at, fold)
            elif kind is op.BRANCH:
                end = self.state()
                for tree_ in arg[1]:
                    self.free[self.add(tree_, at, fold)].append(end)
                at = end
            elif kind is op.MAX_REPEAT:
                low, high, tree_ = arg
                for _ in range(low):
                    at = self.add(tree_, at, fold)
                end = self.state()
                if high == op.MAXREPEAT:
                    self.free[at].append(end)
                    again = self.add(tree_, end, fold)
                    self.free[again].append(end)
                    self.tail = self.steps[end][0][0] if len(tree_) == 1 and self.steps[end] else None
                else:
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(tree_, at, fold)
                    self.free[at].append(end)
                at = end
            else:
                raise ValueError(f"{kind} is not used in rules")
            if kind not in (op.MAX_REPEAT, op.SUBPATTERN):
                self.tail = None
        return at

    def byte(self, at: int, chars: set[int], fold: bool) -> int:
        if fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
        end = self.state()
        self.steps[at].append((frozenset(chars), end))
        return end

    def reversed(self) -> Nfa:
        other = Nfa()
        other.free, other.steps = [[] for _ in self.free], [[] for _ in self.steps]
        for s in range(len(self.free)):
            for n in self.free[s]:
                other.free[n].append(s)
            for chars, n in self.steps[s]:
                other.steps[n].append((chars, s))
        return other

    def closed(self, states) -> frozenset:
        todo = list(states)
        seen = set(todo)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def members(items) -> set[int]:
    out: set[int] = set()
    for kind, arg in items:
        out |= {arg} if kind is op.LITERAL else set(range(arg[0], arg[1] + 1))
    return out


def deterministic(nfa: Nfa, starts: list[frozenset], accept: dict[int, int], search: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transitions[state, class], class of each byte, accepted rules of each state as bits); the first states are the starts.

    A state stands for the set of places in the rules that the bytes so far can have led to; with search the (only) start is
    added again at every byte.
    """
    sets = {s for steps in nfa.steps for s, _ in steps}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.int32)
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]
    number, table = {}, []
    for s in starts:
        number.setdefault(s, len(number))
    todo, again = list(number), starts[0] if search else frozenset()
    while todo:
        here = todo.pop(0)
        row = []
        for c in example:
            nxt = nfa.closed(again | {n for s in here for chars, n in nfa.steps[s] if c in chars})
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        table.append(row)
    bits = np.zeros(len(number), np.int32)
    for states, k in number.items():
        for s in states:
            bits[k] |= accept.get(s, 0)
    return np.array(table, np.int32), classes, bits


def minimised(steps: np.ndarray, classes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same automaton with as few states as can be: classes of equal acceptance are refined until equal ones go to equal ones."""
    block = np.unique(bits, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[steps]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {b: k for k, b in enumerate(dict.fromkeys(block.tolist()))}
    block = np.array([order[b] for b in block.tolist()])
    one = [int(np.flatnonzero(block == k)[0]) for k in range(len(order))]
    return block[steps[one]].astype(np.int32), classes, bits[one]


class Machine:
    """All rules: the reversed automaton that finds starts, and the forward one that goes from a start to the first accepting byte."""

    def __init__(self, rules):
        nfa, accept, starts, firsts, self.tails = Nfa(), {}, [], {}, []
        for r, (_, pattern, fold, _, _) in enumerate(rules):
            first = nfa.state()
            nfa.tail = None
            end = nfa.add(sre.parse(pattern), first, fold)
            accept[end] = 1 << r
            firsts[first] = 1 << r
            starts.append(first)
            self.tails.append(nfa.tail)
        back = nfa.reversed()
        self.back = minimised(*deterministic(back, [back.closed(accept)], firsts, True))
        steps, classes, bits = deterministic(nfa, [nfa.closed([s]) for s in starts], accept, False)
        self.steps, self.classes, self.bits = steps.tolist(), classes.tolist(), bits.tolist()
        dead = next((k for k, row in enumerate(steps.tolist()) if not bits[k] and all(n == k for n in row)), -1)
        for k, row in enumerate(self.steps):  # a match is over at its first accepting byte but for the run of its last class
            for c, n in enumerate(row):
                tail = self.tails[bits[k].item().bit_length() - 1] if bits[k] else None
                if bits[k] and (n != dead) != (tail is not None and int(np.flatnonzero(classes == c)[0]) in tail):
                    raise ValueError("a rule must end in a fixed text or in one repeated class")
        self.one_run = [tail is not None and all(self.bits[self.steps[r][self.classes[b]]] >> r & 1 for b in tail) for r, tail in enumerate(self.tails)]
        self.rules = rules

    def spans(self, buffer: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of each rule's leftmost matches that do not overlap, those too short left out."""
        data = np.frombuffer(buffer, np.uint8)
        got = self.back[2][scan(np.ascontiguousarray(data[::-1]), *self.back[:2])][::-1]
        hit, found = int(np.bitwise_or.reduce(got)), []
        for r, (_, _, _, group, length) in enumerate(self.rules):
            if not hit >> r & 1:
                continue
            starts = np.flatnonzero(got >> r & 1)
            stops = np.flatnonzero(~np.isin(data, list(self.tails[r]))) if self.tails[r] else None
            if self.one_run[r]:  # every byte of the run is a start, and the run is the match
                starts = starts[np.append(True, np.diff(starts) > 1)]
                ends = stops[np.searchsorted(stops, starts)]
                long = ends - starts >= length
                found += [(s, r, e) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
                continue
            done = 0
            for start in starts.tolist():
                if start < done:
                    continue
                state, at = r, start
                while not self.bits[state] >> r & 1:
                    state = self.steps[state][self.classes[buffer[at]]]
                    at += 1
                done = int(stops[np.searchsorted(stops, at)]) if stops is not None else at
                if done - (at - 1 if group else start) >= length:
                    found.append((start, r, done))
        return sorted(found)


def scan(buffer: np.ndarray, steps: np.ndarray, classes: np.ndarray, lane: int = LANE) -> np.ndarray:
    """The automaton's state after each byte of the buffer."""
    n = len(buffer)
    lanes = max(1, -(-n // lane))
    width = steps.shape[1]
    kinds = np.zeros(lanes * lane, np.int32)
    kinds[:n] = classes[buffer]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, lane).T)
    flat = (steps * width).ravel()  # states are kept times width
    out = np.zeros((lane, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(lane):
        state = flat[state + kinds[t]]
        out[t] = state
    entry = np.zeros(lanes, np.int32)  # the state each lane was run from
    while True:
        true = np.append(np.int32(0), out[-1, :-1])
        wrong = np.flatnonzero(true != entry)
        if not len(wrong):
            break
        entry[wrong] = state = true[wrong]
        for t in range(lane):
            state = flat[state + kinds[t, wrong]]
            differs = state != out[t, wrong]
            if not differs.any():
                break
            wrong, state = wrong[differs], state[differs]
            out[t, wrong] = state
    return (out.T.reshape(-1)[:n]) // width


def spans_of(texts: list[str | None], machine: Machine) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points. Texts are parted by a byte that no rule matches."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    buffer = b"\0".join(parts) + b"\0"
    found, out = machine.spans(buffer), [[] for _ in texts]
    if found:
        points = np.append(0, np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80))
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        owner = np.searchsorted(begins, [s for s, _, _ in found], "right") - 1
        for (s, r, e), k in zip(found, owner.tolist()):
            out[k].append((int(points[s] - points[begins[k]]), r, int(points[e] - points[begins[k]])))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, more=MORE) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start (code points, end exclusive), the base rules' and those of `more`; base_sha256 is the
    SHA-256 of the base rules' spans alone, joined in the same way. Null and empty texts have none. Ids are not looked at, so
    repeated rows give repeated results. Each rule must end in a fixed text or in one repeated class, the measured group (if
    any) being that class's run.
    """
    rules = [*BASE, *more]
    machine = docs.sparkSession.sparkContext.broadcast(Machine(rules))

    def run(texts):
        n, digests, spans = [[], [], []], [], []
        for found in spans_of(texts, machine.value):
            text = lambda x: f"{rules[x[1]][0]}:{x[0]}:{x[2]}"
            base = [x for x in found if x[1] < len(BASE)]
            for r in range(3):
                n[r].append(sum(x[1] == r for x in base))
            digests.append(hashlib.sha256(",".join(map(text, base)).encode()).hexdigest())
            spans.append(",".join(map(text, found)))
        return *n, digests, spans

    base = docs.select(F.col(id_col), F.col(text_col).alias("text__"))
    return append_columns(base, "text__", run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string").drop("text__")
