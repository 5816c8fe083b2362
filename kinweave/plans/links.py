"""Counts and classes of the links between names, without a row for each pair.

Distinct names are dealt into groups, and each pair of groups of a block is a tile, which one task holds against itself in arrays.
A pair's score depends on which of its characters are equal, and digits are all alike to it, so pairs that differ by a
renaming of digits only ("No12 No13", "No45 No46") are one pattern, scored once. A tile gives back a number of links for each
name and a spanning forest of them, so what is shuffled follows the number of names and tiles, not that of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

#: Pairs that a tile looks at in one step, at most; their keys fit into 63 bits then.
STEP = 1 << 22
#: Verdicts of patterns that a worker remembers.
MEMORY = 2_000_000
_DIGITS = "0123456789"

Verdict = Callable[[str, str], bool]


def digit_form(name: str) -> tuple[str, str]:
    """The name with its digits numbered by first occurrence, and these digits in order."""
    seen = "".join(dict.fromkeys(c for c in name if c in _DIGITS))
    return name.translate(str.maketrans(seen, _DIGITS[: len(seen)])), seen


def shares_word(left: list[tuple[str, ...]], right: list[tuple[str, ...]]) -> np.ndarray:
    """text.share_word() for each of the left word lists with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    by_word: dict[str, list[int]] = {}
    by_start: dict[str, list[int]] = {}
    for j, words in enumerate(right):
        for w in set(words):
            by_word.setdefault(w, []).append(j)
        for start in {w[:k] for w in words for k in range(len(w) + 1)}:
            by_start.setdefault(start, []).append(j)
    for i, words in enumerate(left):
        for w in set(words):
            out[i, by_start.get(w, [])] = True
            for k in range(len(w)):
                out[i, by_word.get(w[:k], [])] = True
    return out


class _Side:
    """The names of one side of a tile: forms, digits and word lists as numbers."""

    def __init__(self, names: list[str], words: list[tuple[str, ...]], relabel: bool):
        made = [digit_form(n) if relabel else (n, "") for n in names]
        self.names = names
        self.form, self.forms = pd.factorize(np.array([m[0] for m in made], dtype=object))
        #: Which digit stands at each place of the order of first occurrence; 10 for none.
        self.digits = np.full((len(names), 10), 10, dtype=np.int64)
        #: The number of each digit in the name's own form; 15 for one it does not have.
        self.number = np.full((len(names), 11), 15, dtype=np.int64)
        self.number[:, 10] = 0
        for k, (_, seen) in enumerate(made):
            for place, digit in enumerate(seen):
                self.digits[k, place] = int(digit)
                self.number[k, int(digit)] = place
        self.words, self.lists = pd.factorize(pd.Series(words, dtype=object))


def linked_pairs(first: _Side, second: _Side, ordered: np.ndarray, verdict: Verdict, known: dict, only: np.ndarray | None = None) -> np.ndarray:
    """A matrix: which names of the first side link with which of the second. ordered: where the first side's comes before the second's; only: which pairs to look at."""
    asked = shares_word(list(first.lists), list(second.lists))[np.ix_(first.words, second.words)]
    if only is not None:
        asked &= only
    key = (first.form[:, None] * np.int64(len(second.forms)) + second.form[None, :]) * 2 + ordered
    key <<= 40
    for place in range(int((second.digits < 10).sum(axis=1).max(initial=0))):
        key |= (first.number << 4 * place)[:, second.digits[:, place]]
    at = np.flatnonzero(asked.ravel())
    codes, patterns = pd.factorize(key.ravel()[at])
    where = np.zeros(len(patterns), dtype=np.int64)
    where[codes[::-1]] = at[::-1]
    answers = np.zeros(len(patterns), dtype=bool)
    for k, (place, pattern) in enumerate(zip(where.tolist(), patterns.tolist(), strict=True)):
        i, j = divmod(place, len(second.names))
        of = (first.forms[first.form[i]], second.forms[second.form[j]], pattern & (1 << 41) - 1)
        answer = known.get(of)
        if answer is None:
            one, two = first.names[i], second.names[j]
            answer = verdict(one, two) if ordered[i, j] else verdict(two, one)
            if len(known) >= MEMORY:
                known.clear()
            known[of] = answer
        answers[k] = answer
    out = np.zeros(key.shape, dtype=bool)
    out.ravel()[at] = answers[codes]
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of links that hold together what all links of the matrix do."""
    out: list[tuple[int, int]] = []
    new_rows, new_columns = linked.any(axis=1), np.ones(linked.shape[1], dtype=bool)
    while new_rows.any():
        rows = [int(new_rows.argmax())]
        new_rows[rows[0]] = False
        while rows:
            i = rows.pop()
            for j in np.flatnonzero(linked[i] & new_columns).tolist():
                new_columns[j] = False
                out.append((i, j))
                more = np.flatnonzero(linked[:, j] & new_rows).tolist()
                new_rows[more] = False
                out += [(k, j) for k in more]
                rows += more
    return out


#: Verdicts so far in this worker, by what they depend on besides the names.
_KNOWN: dict = {}


def tile_links(tile: pa.Table, verdict: Verdict, relabel: bool, what: tuple) -> pa.Table:
    """(node, other, n): a number of links for each name of the tile (node, id, name, words, weight, mine, lo), and its forest."""
    known = _KNOWN.setdefault(what, {})
    inside = tile.column("lo")[0].as_py() == tile.column("hi")[0].as_py()
    at_lo = np.array(tile.column("mine")) == np.array(tile.column("lo"))
    sides = [tile.filter(pa.array(at_lo)), tile.filter(pa.array(at_lo if inside else ~at_lo))]
    node, other, n = [], [], []
    if all(s.num_rows for s in sides):
        second, right = sides[1], _Side(sides[1].column("name").to_pylist(), _words(sides[1]), relabel)
        nodes, weights = (np.array(second.column(c)) for c in ("node", "weight"))
        # Of names with one id the smaller comes first, so that the order does not depend on the run.
        places = [list(zip(s.column("id").to_pylist(), s.column("name").to_pylist(), strict=True)) for s in sides]
        order = {place: k for k, place in enumerate(sorted({*places[0], *places[1]}))}
        all_ranks, rank = (np.array([order[x] for x in p]) for p in places)
        seconds = np.zeros(second.num_rows, dtype=np.int64)
        step = max(1, STEP // second.num_rows)
        for low in range(0, sides[0].num_rows, step):
            part = sides[0].slice(low, step)
            left = _Side(part.column("name").to_pylist(), _words(part), relabel)
            mine, mine_weights = (np.array(part.column(c)) for c in ("node", "weight"))
            ordered = all_ranks[low : low + step, None] < rank
            linked = linked_pairs(left, right, ordered, verdict, known, ordered if inside else None)
            node += mine.tolist()
            n += (linked @ weights).tolist()
            other += [None] * len(mine)
            seconds += mine_weights @ linked
            edges = forest(linked)
            node += [int(mine[i]) for i, _ in edges]
            other += [int(nodes[j]) for _, j in edges]
            n += [None] * len(edges)
        node += nodes.tolist()
        n += seconds.tolist()
        other += [None] * len(nodes)
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "n": pa.array(n, pa.int64())})


def _words(part: pa.Table) -> list[tuple[str, ...]]:
    return [tuple(w) for w in part.column("words").to_pylist()]
