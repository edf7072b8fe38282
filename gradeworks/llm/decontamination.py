"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A document is contaminated by a benchmark item if some stretch of it is within
the item's error budget in edit distance. Each item is split into one piece
more than its budget, so at least one piece stands unchanged in any such
stretch. An Aho-Corasick automaton finds all pieces in a text at once, and
Myers' bit-parallel distance verifies the stretch around a hit, first for the
short run of pieces that holds it and then for runs twice as long, up to the item.

Texts and items are compared in lower case with single spaces. The benchmark
is a stated query set: it is taken in blocks of bounded size, each matched
against all documents without a shuffle.

Defined results: a very long text is one row's work, linear in its length but for
the stretches around hits; of stretches the least distance counts; null or blank
texts match nothing, null or blank items are
skipped, equal items are all reported, ids may be null (a null item id is listed
as null) or repeat, an empty table gives no rows, an empty
benchmark leaves all documents clean; further columns are left alone.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import fresh

#: Edits allowed for each character of an item.
BUDGET = 0.1
#: Characters of benchmark text that one pass holds.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of the item cut into budget + 1 pieces of near equal length."""
    n = budget + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance_within(masks: dict[str, int], m: int, text: str, budget: int) -> int | None:
    """Least edit distance of the item to any stretch of the text, None if above the budget (Myers, search form)."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score, best = full, 0, m, m if m <= budget else None
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score <= budget and (best is None or score < best):
            best = score
            if not best:
                return 0
    return best


class Node:
    """A run of an item's pieces: n pieces may hold n - 1 edits, so in any match one half of a matching run matches too."""

    __slots__ = ("item", "masks", "size", "start", "up", "width")

    def __init__(self, item: str, cuts: list[tuple[int, str]], up: Node | None):
        self.item, self.up, self.start, self.width = item, up, cuts[0][0], len(cuts)
        self.size = sum(len(p) for _, p in cuts)
        self.masks: dict[str, int] | None = None  # made at the first hit: most runs never have one

    def near(self, text: str, origin: int) -> int | None:
        """Its distance to a stretch of the text in which the item starts near ``origin``."""
        e, at = self.width - 1, origin + self.start
        if self.masks is None:
            self.masks = peq(self.item[self.start : self.start + self.size])
        return distance_within(self.masks, self.size, text[max(0, at - e) : max(0, at + self.size + e)], e)


def leaves(item: str, cuts: list[tuple[int, str]], up: Node | None = None):
    """(piece, offset, parent) of all pieces under a balanced tree of runs."""
    if len(cuts) == 1:
        yield cuts[0][1], cuts[0][0], up
        return
    node, half = Node(item, cuts, up), len(cuts) // 2
    yield from leaves(item, cuts[:half], node)
    yield from leaves(item, cuts[half:], node)


class Matcher:
    """Finds which items of one benchmark block stand in a text."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float):
        self.ids: list[int | None] = []
        at: dict[str, list[tuple[int, int, Node | None]]] = {}
        for item_id, text in items:
            if text:
                for piece, offset, parent in leaves(text, pieces(text, math.floor(len(text) * budget))):
                    at.setdefault(piece, []).append((len(self.ids), offset, parent))
                self.ids.append(item_id)
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item id, distance) of every item within its budget.

        A hit is verified upwards from its piece, through runs twice as long
        each time; a chance hit ends at a short run. Hits of an item that start
        it at a place where it was already found are not verified again.
        """
        if not self.ids or not (t := normal(text)):
            return []
        best: dict[int, int] = {}
        known: set[tuple[int, int]] = set()
        for end, (n, where) in self.automaton.iter(t):
            for i, offset, node in where:
                origin = end + 1 - n - offset
                if best.get(i) == 0 or (i, origin) in known:
                    continue
                d: int | None = 0
                while node and d is not None:
                    d = node.near(t, origin)
                    node = node.up
                if d is not None:
                    known.add((i, origin))
                    best[i] = min(d, best.get(i, d))
        return [(self.ids[i], d) for i, d in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about bounded size, by a hash of their text."""
    rows = benchmark.select(F.col("item_id"), F.col("text").alias("text")).where("text is not null")
    n = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).collect()
        yield sorted(((r.item_id, normal(r.text)) for r in got), key=lambda x: ((1,) if x[0] is None else (0, x[0])) + (x[1],))


def matched(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of the documents, and ``__items`` (ids of the items found) and ``__distances``; where the documents have such columns, more underscores stand before these names."""
    kind = dict(benchmark.dtypes)["item_id"]
    names = fresh(docs, "__items", "__distances")
    out = docs.withColumns({names[0]: F.array().cast(f"array<{kind}>"), names[1]: F.array().cast("array<int>")})
    for items in benchmark_blocks(benchmark, block_chars):
        matcher: list[Matcher] = []

        def work(batches, items=items, matcher=matcher):
            matcher = matcher or [Matcher(items, budget)]
            for b in batches:
                at = b.schema.get_field_index("text")
                got = [matcher[0].found(t.as_py()) for t in b.column(at)]
                before = (b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())
                ids = [old + [x[0] for x in new] for old, new in zip(before[0], got, strict=True)]
                ds = [old + [x[1] for x in new] for old, new in zip(before[1], got, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(ids, b.schema.types[-2]), pa.array(ds, b.schema.types[-1])], schema=b.schema)

        out = out.mapInArrow(work, out.schema)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with their own columns, without those that hold a benchmark item."""
    out = docs
    for items in benchmark_blocks(benchmark, block_chars):
        matcher: list[Matcher] = []

        def keep(batches, items=items, matcher=matcher):
            matcher = matcher or [Matcher(items, budget)]
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not matcher[0].found(t.as_py()) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out
